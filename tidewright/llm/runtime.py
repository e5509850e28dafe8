"""What the operators share of Spark: the shared folder, cut lineage, Arrow maps, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shared import cut
from ..plans.shipping import ship


def arrow_map(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with the package shipped."""
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node of an edge between integers.

    Alternating large-star and small-star steps: every step is a distinct and
    a grouped minimum whose rows are at most the edges, so a node of very many
    edges costs its own row count and its links are never held in one value.
    """

    def both(e: DataFrame) -> DataFrame:
        return e.select(F.col("u"), F.col("v")).union(e.select(F.col("v"), F.col("u")))

    e = edges.select(F.least(a, b).alias("v"), F.greatest(a, b).alias("u")).where("u <> v").distinct()
    e = cut(e.select("u", "v"))
    before = None
    while True:
        # large star: every larger neighbour of u is linked to u's smallest neighbour (or u).
        twice = both(e)
        least = cut(twice.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        e = cut(twice.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # small star: every smaller neighbour of u, and u, is linked to the smallest.
        least = cut(e.groupBy("u").agg(F.min("v").alias("m")))
        e = cut(e.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m"))).where("u <> v").distinct())
        # the same edges twice over are the fixed point: stars
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v"), F.col("v")).distinct())
