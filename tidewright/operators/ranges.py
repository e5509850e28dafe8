"""Global order without a global task: range partitions, written once, and what runs over them.

The bounds of a range exchange are sampled when it runs, so a plan that holds
it twice may deal its rows in two ways.  Here the sorted partitions are written
to the shared folder first; a row's partition and place are read from there,
and every later branch sees the same.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.shared import cut

#: Bits of monotonically_increasing_id() that count within a partition.
_WITHIN = 33
#: Groups, at most, that are broadcast to the rows; more are joined to salted rows.
MOST_BROADCAST = 10_000
SALTS = 32


def beside(rows: DataFrame, groups: DataFrame, keys: Sequence[str], how: str = "inner", broadcast: bool | None = None) -> DataFrame:
    """rows with the other columns of their group's row, nulls in keys being equal; no task holds a large group's rows.

    An equal join would sort the rows by group, with all of a group in one task.
    Here few groups are broadcast, and rows of many are dealt by a salt too.
    Unless ``broadcast`` tells, groups are counted, so they should be written already.
    """
    own = [f"__g{i}" for i in range(len(keys))]
    known = groups.select(*[F.col(f"`{k}`").alias(o) for k, o in zip(keys, own, strict=True)], *[F.col(f"`{c}`") for c in groups.columns if c not in keys])
    same = F.lit(True)
    for k, o in zip(keys, own, strict=True):
        same = same & F.col(f"`{k}`").eqNullSafe(F.col(o))
    if groups.count() <= MOST_BROADCAST if broadcast is None else broadcast:
        return rows.join(F.broadcast(known), same, how).drop(*own)
    # equal rows of several partitions get several salts; a task run again gives its rows the same ones
    plain = [F.col(f"`{f.name}`") for f in rows.schema if isinstance(f.dataType, T.NumericType | T.StringType | T.DateType | T.TimestampType)]
    rows = rows.withColumn("__salt", F.pmod(F.xxhash64(F.spark_partition_id(), *plain), F.lit(SALTS)))
    known = known.withColumn("__salts", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(known, same & (F.col("__salt") == F.col("__salts")), how).drop("__salt", "__salts", *own)


def ranged(df: DataFrame, *order: Column, names: tuple[str, str] = ("__p", "__i")) -> DataFrame:
    """df in range partitions of the order, with ``__p``, the partition, and ``__i``, the 0-based place in it, or columns of other names."""
    rows = cut(df.repartitionByRange(*order).sortWithinPartitions(*order)).withColumn("__m", F.monotonically_increasing_id())
    at = F.col("__m")
    return rows.select(*[F.col(f"`{c}`") for c in df.columns], F.shiftright(at, _WITHIN).cast("int").alias(names[0]), F.expr(f"__m & {(1 << _WITHIN) - 1}").alias(names[1]))


def _offsets(rows: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """For each partition the sums over all partitions before it: as many rows as partitions."""
    totals = rows.groupBy("__p").agg(*[c.alias(f"{k}") for k, c in sums.items()])
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(totals.select(F.col("__p").alias("__q"), *[F.coalesce(F.sum(k).over(before), F.lit(0)).alias(k) for k in sums]))


def row_numbers(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """df with the 0-based place of each row in the whole order, as its first column."""
    rows = ranged(df, *order)
    offsets = _offsets(rows, {"__o": F.count(F.lit(1))})
    return rows.join(offsets, F.col("__p") == F.col("__q")).select((F.col("__o") + F.col("__i")).alias(name), *[F.col(f"`{c}`") for c in df.columns])


def running_sums(df: DataFrame, columns: Sequence[str], *order: Column) -> DataFrame:
    """df with ``__before_<c>``: the sum of column c over all rows strictly before in the order.

    A partition is one sorted run, so its own sums are taken batch by batch as
    it is read; nothing is shuffled again.
    """
    rows = ranged(df, *order)
    whole = [isinstance(df.schema[c].dataType, T.IntegralType) for c in columns]
    schema = T.StructType([*rows.schema.fields, *[T.StructField(f"__s_{c}", T.LongType() if w else T.DoubleType()) for c, w in zip(columns, whole, strict=True)]])
    names = schema.names

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = [0] * len(columns)
        for batch in batches:
            made = []
            for k, c in enumerate(columns):
                values = batch.column(c).fill_null(0).to_numpy(zero_copy_only=False)
                sums = np.cumsum(values, dtype=np.int64 if whole[k] else np.float64)
                made.append(pa.array(np.concatenate(([0], sums[:-1])).astype(sums.dtype) + carried[k] if len(sums) else sums))
                carried[k] += sums[-1] if len(sums) else 0
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=names)

    summed = rows.mapInArrow(over, schema)
    offsets = _offsets(rows, {f"__o_{c}": F.sum(F.col(f"`{c}`")) for c in columns})
    joined = summed.join(offsets, F.col("__p") == F.col("__q"))
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], *[(F.col(f"`__o_{c}`") + F.col(f"`__s_{c}`")).alias(f"__before_{c}") for c in columns])


def least_gap(df: DataFrame, column: str) -> float | None:
    """The smallest difference of neighbouring values, within partitions and across their edges; None for fewer than two."""
    c = F.col(f"`{column}`")
    rows = ranged(df.select(c.alias("v")), F.col("v"))
    inside = rows.withColumn("d", F.col("v") - F.lag("v").over(Window.partitionBy("__p").orderBy("__i"))).agg(F.min("d").alias("d"))
    edges = rows.groupBy("__p").agg(F.min("v").alias("a"), F.max("v").alias("b"))
    across = edges.withColumn("d", F.col("a") - F.lag("b").over(Window.orderBy("__p"))).agg(F.min("d").alias("d"))
    return inside.unionByName(across).agg(F.min("d")).first()[0]


def quantiles(df: DataFrame, column: str, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by, q, n): exact type 7 quantiles of a column, as an array in the order of ``probs``, and the count of its values.

    Different values are counted, and a running count over range partitions
    finds those at the places wanted: no task holds all values, of a group
    neither.
    """
    keys = [F.col(f"`{k}`") for k in by]
    counts = df.where(F.col(f"`{column}`").isNotNull()).groupBy(*keys, F.col(f"`{column}`").cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    placed = running_sums(counts, ["__c"], *[k.asc_nulls_first() for k in keys], F.col("__v"))
    groups = cut(placed.groupBy(*keys).agg(F.min("__before___c").alias("__first"), F.sum("__c").alias("n")))
    low = F.col("__before___c") - F.col("__first")
    high = low + F.col("__c")
    at = beside(placed, groups, by)
    ends = []
    for j, p in enumerate(probs):
        h = (F.col("n") - 1) * F.lit(float(p))
        for part, k in (("a", F.floor(h)), ("b", F.ceil(h))):
            ends.append(F.max(F.when((k >= low) & (k < high), F.col("__v"))).alias(f"__{part}{j}"))
    found = at.groupBy(*keys, "n").agg(*ends)
    values = [F.col(f"__a{j}") + (F.col(f"__b{j}") - F.col(f"__a{j}")) * (((F.col("n") - 1) * F.lit(float(p))) - F.floor((F.col("n") - 1) * F.lit(float(p)))) for j, p in enumerate(probs)]
    return found.select(*keys, F.array(*values).alias("q"), "n")
