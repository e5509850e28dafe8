"""Queries over readers and writers: each writes into the shared folder and reads back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import vectors as v
from ..functions.expr import col
from ..operators import joins as j
from ..sources import io
from .catalog import query
from .shared import shared_folder


def _place(t, name: str) -> str:
    """A new folder below the checkpoints, which all executors share."""
    shared_folder(t.spark)
    return f"{t.spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def csv_files(t):
    where = _place(t, "csv")
    io.write_csv(t.customer.select("c_custkey", "c_name", "c_acctbal"), where)
    return io.read_csv(t.spark, where, na="NA", schema="c_custkey bigint, c_name string, c_acctbal double")


@query("SELECT l_orderkey, l_linenumber, l_shipdate, l_extendedprice FROM lineitem")
def arrow_files(t):
    """Written by tasks, split at record batches, and only the columns that are wanted read."""
    where = _place(t, "arrow")
    io.write_ipc(t.lineitem, where, compression="lz4")
    return io.read_ipc(t.spark, where, columns=["l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice"], split_bytes=1 << 20)


@query("SELECT * FROM orders")
def arrow_streams(t):
    where = _place(t, "arrows")
    io.write_ipc_stream(t.orders, where)
    return io.read_ipc_stream(t.spark, where)


@query("SELECT p_partkey, p_brand, p_size FROM part")
def json_lines(t):
    where = _place(t, "json")
    io.write_ndjson(t.part.select("p_partkey", "p_brand", "p_size"), where)
    return io.scan_ndjson(t.spark, where, "p_partkey bigint, p_brand string, p_size int").select("p_partkey", "p_brand", "p_size")


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def partitioned_parquet(t):
    where = _place(t, "parquet")
    io.write_parquet(t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice"), where, partition_by=["o_orderstatus"])
    return io.scan_parquet(t.spark, where, order_by="o_orderkey").filter(o_orderstatus="F").select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def orc_files(t):
    where = _place(t, "orc")
    io.write_orc(t.supplier.select("s_suppkey", "s_name", "s_acctbal"), where)
    return io.read_orc(t.spark, where)


@query("SELECT n_name AS value FROM nation")
def text_lines(t):
    where = _place(t, "text")
    t.nation.df.select("n_name").write.text(where)
    return io.read_lines(t.spark, where)


@query("SELECT column_name AS name, CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' ELSE 'string' END AS kind FROM (DESCRIBE customer)")
def schema_of_files(t):
    found = io.read_parquet_schema(t.spark, f"{t.folder}/customer.parquet")
    assert set(io.read_parquet_metadata(t.spark, f"{t.folder}/customer.parquet")) == set(found)
    return t.spark.createDataFrame(list(found.items()), "name string, kind string")


@query("SELECT r_regionkey AS a, r_name AS b, 5 AS made FROM region")
def made_frames(t):
    """The same rows from lists, dictionaries, records, pandas, Arrow, NumPy and nested JSON."""
    import pandas as pd
    import pyarrow as pa

    rows = sorted((r[0], r[1]) for r in t.region.df.select("r_regionkey", "r_name").collect())
    keys, names = [r[0] for r in rows], [r[1] for r in rows]
    schema = "a int, b string"
    frames = [
        io.from_dict(t.spark, {"a": keys, "b": names}, schema), io.from_dicts(t.spark, [{"a": a, "b": b} for a, b in rows], schema), io.from_records(t.spark, rows, schema),
        io.from_pandas(t.spark, pd.DataFrame({"a": keys, "b": names})), io.from_arrow(t.spark, pa.table({"a": keys, "b": names})), io.from_dataframe(t.spark, pa.table({"a": keys, "b": names})),
        io.json_normalize(t.spark, [{"a": a, "in": {"b": b}} for a, b in rows]).rename(b="in.b"),
    ]
    every = frames[0].df
    for f in frames[1:]:
        every = every.unionByName(f.df.select(F.col("a").cast("int").alias("a"), "b"))
    numbers = io.from_numpy(t.spark, pd.DataFrame({"a": keys}).to_numpy(), ["a"]).df
    counted = every.groupBy("a", "b").count().where(f"count = {len(frames)}").select("a", "b")
    return counted.join(numbers.select(F.col("a").cast("int").alias("a")), "a").select("a", "b", F.lit(5).alias("made"))


@query("SELECT CAST(i AS DOUBLE) / 4 + 2000 AS time, i * i * 1.0::DOUBLE AS value FROM range(0, 12) g(i)")
def time_series(t):
    return io.ts(t.spark, [i * i for i in range(12)], start=2000.0, frequency=4.0)


@query("SELECT a, b, c, d FROM (VALUES (0, 1.0::DOUBLE, 3, 4), (1, 1.5, 2, 3), (2, 2.0, 1, 2)) v(a, b, c, d)")
def sequences(t):
    columns = {"a": v.seq_len(3), "b": v.seq(1, 2, length_out=3), "c": v.rev([1, 2, 3]), "d": v.rep([4, 3, 2], each=1)}
    assert v.seq_along(columns["c"]) == [0, 1, 2] and v.matrix([1, 2, 3, 4], nrow=2).tolist() == [[1, 3], [2, 4]]
    return t.spark.createDataFrame([(int(a), float(b), int(c), int(d)) for a, b, c, d in zip(*columns.values(), strict=True)], "a int, b double, c int, d int")


# ---------------------------------------------------------------- interval joins over whole tables
_SPANS = "(SELECT s_suppkey, s_acctbal AS lo, s_acctbal + 400 AS hi FROM supplier)"


@query(f"SELECT a.s_suppkey, b.s_suppkey AS other FROM {_SPANS} a JOIN {_SPANS} b ON a.lo <= b.hi AND a.hi >= b.lo")
def interval_overlaps(t):
    f = t.supplier.select("s_suppkey", lo="s_acctbal", hi=col("s_acctbal") + 400)
    return j.inner_join(f, f.rename(other="s_suppkey", x="lo", y="hi"), j.join_by(j.overlaps("lo", "hi", "x", "y"))).select("s_suppkey", "other")


@query(f"SELECT c_custkey, s_suppkey FROM customer JOIN {_SPANS} ON c_acctbal BETWEEN lo AND hi")
def interval_between(t):
    f = t.supplier.select("s_suppkey", lo="s_acctbal", hi=col("s_acctbal") + 400)
    return j.inner_join(t.customer.select("c_custkey", "c_acctbal"), f, j.join_by(j.join_between("c_acctbal", "lo", "hi"))).select("c_custkey", "s_suppkey")


@query(f"SELECT a.s_suppkey, b.s_suppkey AS other FROM {_SPANS} a JOIN (SELECT s_suppkey, s_acctbal - 200 AS lo, s_acctbal + 900 AS hi FROM supplier) b ON a.lo >= b.lo AND a.hi <= b.hi")
def interval_within(t):
    f = t.supplier.select("s_suppkey", lo="s_acctbal", hi=col("s_acctbal") + 400)
    wide = t.supplier.select(other="s_suppkey", x=col("s_acctbal") - 200, y=col("s_acctbal") + 900)
    return j.inner_join(f, wide, j.join_by(j.within("lo", "hi", "x", "y"))).select("s_suppkey", "other")
