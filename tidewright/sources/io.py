"""Readers and writers: thin, lazy, and with the options of a tidy reader."""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import quote
from ..functions.factors import factor
from ..operators.frame import Frame
from . import arrow_files


def read_csv(spark: SparkSession, source: str | Sequence[str], na: str | Sequence[str] = ("", "NA"), skip: int = 0, comment: str | None = None,
             col_names: bool | Sequence[str] = True, schema: T.StructType | str | None = None, sep: str = ",") -> Frame:
    """CSV files, or inline text (with a line feed).  A schema avoids the pass that infers one."""
    nulls = [na] if isinstance(na, str) else list(na)
    reader = spark.read.option("sep", sep).option("header", col_names is True and not skip).option("comment", comment or "")
    reader = reader.option("nullValue", nulls[-1]) if len(nulls) == 1 else reader
    if schema is not None:
        reader = reader.schema(schema)
    else:
        reader = reader.option("inferSchema", len(nulls) == 1)
    inline = isinstance(source, str) and "\n" in source
    if inline or skip:
        lines = spark.createDataFrame([(i, x) for i, x in enumerate(source.splitlines())], "i bigint, value string") if inline else _numbered_lines(spark, source)
        text = lines.where(F.col("i") >= skip).orderBy("i").select("value").rdd.map(lambda r: r[0])
        df = spark.read.option("sep", sep).option("header", col_names is True).option("comment", comment or "").option("inferSchema", len(nulls) == 1).csv(text)
    else:
        df = reader.csv(source if isinstance(source, str) else list(source))
    if not isinstance(col_names, bool):
        df = df.toDF(*col_names)
    if len(nulls) > 1:
        df = df.select(*[F.when(~F.col(quote(c)).isin(nulls), F.col(quote(c))).alias(c) if isinstance(df.schema[c].dataType, T.StringType) else F.col(quote(c)) for c in df.columns])
        if schema is None:
            df = _inferred(df)
    return Frame(df)


def _numbered_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return spark.read.text(path).rdd.zipWithIndex().map(lambda p: (p[1], p[0][0])).toDF("i bigint, value string")


def _inferred(df: DataFrame) -> DataFrame:
    """Text columns as numbers where every value is one, from one aggregate."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df
    bad = df.agg(*[F.count_if(F.col(quote(c)).isNotNull() & F.col(quote(c)).try_cast(k).isNull()).alias(f"{k}|{c}") for c in texts for k in ("bigint", "double")]).first()
    kind = {c: next((k for k in ("bigint", "double") if not bad[f"{k}|{c}"]), "string") for c in texts}
    return df.select(*[F.col(quote(c)).cast(kind[c]).alias(c) if c in kind else F.col(quote(c)) for c in df.columns])


def read_parquet(spark: SparkSession, path: str | Sequence[str], order_by: Sequence[str] | str = ()) -> Frame:
    return Frame(spark.read.parquet(*([path] if isinstance(path, str) else path)), [(c, False) for c in ([order_by] if isinstance(order_by, str) else order_by)])


def read_parquet_schema(spark: SparkSession, path: str) -> dict[str, str]:
    return dict(spark.read.parquet(path).dtypes)


def read_json(spark: SparkSession, path: str, schema: Any = None) -> Frame:
    reader = spark.read.option("multiLine", True)
    return Frame((reader.schema(schema) if schema is not None else reader).json(path))


def read_ndjson(spark: SparkSession, path: str, schema: Any = None) -> Frame:
    return Frame((spark.read.schema(schema) if schema is not None else spark.read).json(path))


def read_lines(spark: SparkSession, path: str) -> Frame:
    return Frame(spark.read.text(path))


def read_format(spark: SparkSession, kind: str, path: str | None = None, **options: Any) -> Frame:
    """Any source that the session has: orc, avro, delta, iceberg, jdbc."""
    reader = spark.read.format(kind).options(**options)
    return Frame(reader.load(path) if path else reader.load())


def read_orc(spark: SparkSession, path: str) -> Frame:
    return Frame(spark.read.orc(path))


def read_avro(spark: SparkSession, path: str) -> Frame:
    return read_format(spark, "avro", path)


def read_delta(spark: SparkSession, path: str) -> Frame:
    return read_format(spark, "delta", path)


def read_database(spark: SparkSession, url: str, query: str, **options: Any) -> Frame:
    return Frame(spark.read.format("jdbc").options(url=url, query=query, **options).load())


def read_ipc(spark: SparkSession, path: str, columns: Sequence[str] | None = None, split_bytes: int | None = None) -> Frame:
    """Arrow files, of the file or the stream format: one, or all in a folder; large files are split at their record batches."""
    arrow_files.register(spark)
    reader = spark.read.format("arrow_files").option("path", path)
    if columns is not None:
        reader = reader.option("columns", "\x1f".join(columns))
    if split_bytes is not None:
        reader = reader.option("split_bytes", split_bytes)
    return Frame(reader.load())


read_ipc_stream = scan_ipc = read_ipc


def read_ipc_schema(path: str) -> dict[str, str]:
    """Column names and Arrow types of the first file."""
    return {f.name: str(f.type) for f in arrow_files.file_schema(path)}


def scan_pyarrow_dataset(spark: SparkSession, dataset: Any) -> Frame:
    """A dataset of Parquet, ORC, CSV or Arrow files, by its files; its own filters and expressions are not taken over."""
    kind = dataset.format.default_extname
    if kind in ("arrow", "ipc", "feather"):
        frames = [read_ipc(spark, f).df for f in dataset.files]
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return Frame(out)
    reader = spark.read.option("header", True).option("inferSchema", True) if kind == "csv" else spark.read
    return Frame(reader.format(kind).load(dataset.files))


def read_excel(spark: SparkSession, path: str, **options: Any) -> Frame:
    import pandas as pd

    return Frame(spark.createDataFrame(pd.read_excel(path, **options)))


def read_ods(spark: SparkSession, path: str, **options: Any) -> Frame:
    return read_excel(spark, path, engine="odf", **options)


def read_csv_batched(spark: SparkSession, source: str, batch_size: int = 50_000, **options: Any):
    """An iterator of Arrow tables of at most so many rows each, one partition after the other."""
    import pyarrow as pa

    rows, schema = [], None
    frame = read_csv(spark, source, **options)
    schema = frame.columns
    for row in frame.df.toLocalIterator():
        rows.append(row)
        if len(rows) == batch_size:
            yield pa.table({c: [r[i] for r in rows] for i, c in enumerate(schema)})
            rows = []
    if rows:
        yield pa.table({c: [r[i] for r in rows] for i, c in enumerate(schema)})


def read_parquet_metadata(spark: SparkSession, path: str) -> dict[str, str]:
    """What each column of the schema carries: its comment and its other metadata, as text."""
    return {f.name: json.dumps(f.metadata, sort_keys=True) for f in spark.read.parquet(path).schema.fields}


def scan_iceberg(spark: SparkSession, table: str, **options: Any) -> Frame:
    return read_format(spark, "iceberg", table, **options)


def read_database_uri(spark: SparkSession, query: str, uri: str, **options: Any) -> Frame:
    return read_database(spark, uri, query, **options)


def json_normalize(spark: SparkSession, data: Sequence[dict[str, Any]], separator: str = ".") -> Frame:
    """Nested dictionaries as flat columns."""

    def flat(d: dict[str, Any], head: str = "") -> dict[str, Any]:
        out: dict[str, Any] = {}
        for key, value in d.items():
            out |= flat(value, f"{head}{key}{separator}") if isinstance(value, dict) else {f"{head}{key}": value}
        return out

    rows = [flat(d) for d in data]
    names = list(dict.fromkeys(k for r in rows for k in r))
    return Frame(spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], names))


def from_dataframe(spark: SparkSession, data: Any) -> Frame:
    """Any table that offers itself as Arrow, or as pandas."""
    import pyarrow as pa

    if hasattr(data, "__arrow_c_stream__"):
        return from_arrow(spark, pa.table(data))
    return from_pandas(spark, data.to_pandas() if hasattr(data, "to_pandas") else data)


# scans are lazy, as all reading is
scan_csv, scan_parquet, scan_ndjson, scan_lines, scan_ipc, scan_delta = read_csv, read_parquet, read_ndjson, read_lines, read_ipc, read_delta


def from_dict(spark: SparkSession, data: dict[str, Sequence[Any]], schema: Any = None) -> Frame:
    rows = list(zip(*data.values(), strict=True))
    return Frame(spark.createDataFrame(rows, schema or list(data)))


def from_dicts(spark: SparkSession, data: Sequence[dict[str, Any]], schema: Any = None) -> Frame:
    return Frame(spark.createDataFrame(list(data), schema))


def from_records(spark: SparkSession, data: Sequence[Sequence[Any]], schema: Any) -> Frame:
    return Frame(spark.createDataFrame([tuple(r) for r in data], schema))


def from_pandas(spark: SparkSession, data: Any) -> Frame:
    return Frame(spark.createDataFrame(data))


def from_arrow(spark: SparkSession, data: Any) -> Frame:
    return Frame(spark.createDataFrame(data))


def from_numpy(spark: SparkSession, data: Any, columns: Sequence[str] | None = None) -> Frame:
    import pandas as pd

    return Frame(spark.createDataFrame(pd.DataFrame(data, columns=columns or [f"column_{i}" for i in range(data.shape[1])])))


def ts(spark: SparkSession, data: Sequence[float], start: float = 1.0, frequency: float = 1.0) -> Frame:
    """(time, value) of an even series."""
    out = Frame(spark.createDataFrame([(start + i / frequency, float(v)) for i, v in enumerate(data)], "time double, value double"), [("time", False)])
    out.ts = (start, start + (len(data) - 1) / frequency, frequency)
    return out


class Catalog:
    """Named datasets: files in a folder with optional JSON sidecars that restore factors."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def data(self, name: str) -> Frame:
        frame = Frame(self.spark.read.parquet(f"{self.folder}/{name}.parquet"))
        sidecar = self.spark.read.option("wholetext", True).text(f"{self.folder}/{name}*.json").limit(1).collect() if self._has(f"{name}.json") else []
        if sidecar:
            for column, spec in json.loads(sidecar[0][0]).get("factors", {}).items():
                frame = factor(frame, column, spec["levels"], ordered=spec.get("ordered", False))
        return frame

    def _has(self, file: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{file}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)


# ---------------------------------------------------------------- sinks
def write_parquet(frame: Frame, path: str, partition_by: Sequence[str] = (), mode: str = "errorifexists") -> None:
    frame.df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def write_csv(frame: Frame, path: str, mode: str = "errorifexists", header: bool = True) -> None:
    frame.df.write.mode(mode).option("header", header).csv(path)


def write_ndjson(frame: Frame, path: str, mode: str = "errorifexists") -> None:
    frame.df.write.mode(mode).json(path)


def write_orc(frame: Frame, path: str, mode: str = "errorifexists") -> None:
    frame.df.write.mode(mode).orc(path)


def write_format(frame: Frame, kind: str, path: str, mode: str = "errorifexists", **options: Any) -> None:
    frame.df.write.format(kind).mode(mode).options(**options).save(path)


def write_json(frame: Frame, path: str) -> None:
    """One JSON array, of a frame that the driver can hold."""
    from pathlib import Path

    Path(path).write_text("[" + ",".join(frame.df.toJSON().collect()) + "]")


def write_avro(frame: Frame, path: str, mode: str = "errorifexists") -> None:
    write_format(frame, "avro", path, mode)


def write_delta(frame: Frame, path: str, mode: str = "errorifexists", **options: Any) -> None:
    write_format(frame, "delta", path, mode, **options)


def write_iceberg(frame: Frame, table: str, mode: str = "errorifexists", **options: Any) -> None:
    write_format(frame, "iceberg", table, mode, **options)


def write_ipc(frame: Frame, path: str, mode: str = "errorifexists", compression: str | None = None, stream: bool = False) -> None:
    """A folder of Arrow files, one for each task that has rows; modes are errorifexists, append and overwrite."""
    arrow_files.register(frame.df.sparkSession)
    if mode not in ("error", "errorifexists", "append", "overwrite"):
        raise ValueError(f"no mode {mode}")
    if mode.startswith("error") and arrow_files.exists(path):
        raise FileExistsError(path)
    writer = frame.df.write.format("arrow_files").mode("overwrite" if mode == "overwrite" else "append").option("path", path).option("stream", str(stream).lower())
    (writer.option("compression", compression) if compression else writer).save()


def write_ipc_stream(frame: Frame, path: str, mode: str = "errorifexists", compression: str | None = None) -> None:
    write_ipc(frame, path, mode, compression, stream=True)


def write_excel(frame: Frame, path: str, **options: Any) -> None:
    frame.df.toPandas().to_excel(path, index=False, **options)


# sinks write where the rows are, as all writing does
sink_parquet, sink_csv, sink_ndjson, sink_delta, sink_iceberg, sink_ipc = write_parquet, write_csv, write_ndjson, write_delta, write_iceberg, write_ipc


def write_database(frame: Frame, url: str, table: str, mode: str = "errorifexists", **options: Any) -> None:
    frame.df.write.format("jdbc").mode(mode).options(url=url, dbtable=table, **options).save()


def write_bucketed(frame: Frame, table: str, keys: Sequence[str], buckets: int = 64, mode: str = "errorifexists") -> None:
    """A table that later joins and groups on ``keys`` read without a shuffle."""
    frame.df.write.mode(mode).bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)


def sink_batches(frame: Frame, function: Any) -> None:
    """Calls ``function`` on each row batch, where the rows are."""
    frame.df.foreachPartition(function)
