"""The grouped verbs over streams: watermarked windows, sessions, deduplication."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import Context


def stream_parquet(spark: SparkSession, path: str, schema: Any) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def windowed_summary(df: DataFrame, time: str, every: str, late: str, by: Sequence[str] = (), period: str | None = None, **made: Any) -> DataFrame:
    """Aggregates of time windows; rows later than ``late`` are left out.  The same plan serves batch and stream."""
    c = Context("agg")
    out = df.withWatermark(time, late).groupBy(*by, F.window(time, period or every, every).alias("w"))
    return out.agg(*[e.build(c).alias(k) for k, e in made.items()]).select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), *made)


def sessions(df: DataFrame, time: str, gap: str, late: str, by: Sequence[str], **made: Any) -> DataFrame:
    c = Context("agg")
    out = df.withWatermark(time, late).groupBy(*by, F.session_window(time, gap).alias("w"))
    return out.agg(*[e.build(c).alias(k) for k, e in made.items()]).select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), *made)


def distinct_within(df: DataFrame, keys: Sequence[str], time: str, late: str) -> DataFrame:
    return df.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))
