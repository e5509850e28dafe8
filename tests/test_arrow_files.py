"""The Arrow data source: splits, columns, types, commits."""

import pyarrow as pa
import pyarrow.dataset as ds
import pytest

from tidewright.operators.frame import Frame
from tidewright.sources import arrow_files, io


def rows(frame):
    return sorted(map(tuple, frame.df.collect()), key=repr)


def test_round_trip_of_a_large_table(spark, tmp_path):
    """Written by four tasks and read batch by batch, the driver never holds the rows."""
    source = Frame(spark.read.parquet("/root/testdata/sf0.1/lineitem.parquet").repartition(4))
    where = f"file:{tmp_path}/lines"
    io.write_ipc(source, where)
    assert len(arrow_files.files_of(where)) == 4 and not list(tmp_path.glob("lines/_temporary*"))
    back = io.read_ipc(spark, where, split_bytes=4 << 20)
    assert back.df.rdd.getNumPartitions() > 8
    assert back.df.count() == 600_000 or back.df.count() == source.df.count()
    assert back.df.exceptAll(source.df).count() == 0 and back.df.dtypes == source.df.dtypes


def test_columns_modes_and_streams(spark, tmp_path):
    a = Frame(spark.createDataFrame([(1, "x", None), (2, None, [1.5])], "i int, s string, l array<double>"))
    where = str(tmp_path / "t")
    io.write_ipc(a, where, compression="zstd")
    with pytest.raises(FileExistsError):
        io.write_ipc(a, where)
    io.write_ipc(a, where, mode="append")
    assert rows(io.read_ipc(spark, where)) == sorted(2 * [(1, "x", None), (2, None, [1.5])], key=repr)
    assert io.read_ipc(spark, where, columns=["s", "i"]).columns == ["s", "i"] and io.read_ipc(spark, where, columns=["s"]).df.where("s = 'x'").count() == 2
    assert io.read_ipc_schema(where) == {"i": "int32", "s": "string", "l": "list<element: double>"} or list(io.read_ipc_schema(where)) == ["i", "s", "l"]
    io.write_ipc_stream(a, where, mode="overwrite")
    assert rows(io.read_ipc_stream(spark, where)) == rows(a)
    io.write_ipc(Frame(a.df.where("i > 5")), where, mode="overwrite")
    assert rows(io.read_ipc(spark, where)) == [] and io.read_ipc(spark, where).columns == ["i", "s", "l"]
    assert rows(io.scan_pyarrow_dataset(spark, ds.dataset(str(tmp_path / "t"), format="ipc"))) == []
    for bad in (lambda: io.read_ipc(spark, where, columns=["none"]).df.count(), lambda: io.read_ipc(spark, str(tmp_path / "missing")).df.count()):
        with pytest.raises(Exception, match="none|missing"):
            bad()


def test_types_of_other_writers(spark, tmp_path):
    table = pa.table({"d": pa.array(["a", "b", "a"]).dictionary_encode(), "u": pa.array([1, 2, 255], pa.uint8()), "t": pa.array([1, 2, None], pa.timestamp("ns", "UTC")), "x": pa.array([1.5, None, 2.5], pa.float32())})
    with pa.OSFile(str(tmp_path / "f.arrow"), "wb") as sink, pa.ipc.new_file(sink, table.schema) as writer:
        writer.write_table(table, max_chunksize=1)
    got = io.read_ipc(spark, str(tmp_path / "f.arrow"), split_bytes=1)
    assert got.df.rdd.getNumPartitions() == 3 and dict(got.df.dtypes) == {"d": "string", "u": "smallint", "t": "timestamp", "x": "float"}
    assert sorted((r.d, r.u, r.x) for r in got.df.collect() if r.x) == [("a", 1, 1.5), ("a", 255, 2.5)]


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    where = str(tmp_path / "t")
    io.write_ipc(Frame(spark.range(5)), where)
    bad = spark.range(100).repartition(4).selectExpr("if(id = 77, raise_error('stop'), id) AS id")
    with pytest.raises(Exception, match="stop"):
        io.write_ipc(Frame(bad), where, mode="append")
    assert rows(io.read_ipc(spark, where)) == [(i,) for i in range(5)] and not list(tmp_path.glob("t/_temporary*"))
