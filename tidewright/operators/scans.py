"""Functions of the rows before or behind, over a whole frame in its order.

Rows stand in range partitions that are written once (see ``ranges``).  A
function runs over each partition by itself; what a partition leaves to the
next ones (a sum, the last value, a count) is one row for each partition.  Those
few rows pass through the driver, are put together and joined back, so that a
plan of several scans names its rows once.  No task sees all rows.

Each function takes rows of ``laid_out`` and adds a column.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shared import cut
from .ranges import ranged

#: Rows up to which those looked up from other partitions are broadcast.
MOST_BROADCAST = 100_000


def _few(df: DataFrame) -> DataFrame:
    """The rows worked out now, one for each range partition, as a broadcast."""
    return F.broadcast(df.sparkSession.createDataFrame(df.collect(), df.schema))


def _within():
    return Window.partitionBy("__scan_p").orderBy("__scan_i")


#: Columns that a scan adds for its own use.
_OWN = ("__sq", "__so", "__sl", "__ss", "__sn", "__sv", "__sc")


def laid_out(df: DataFrame, *order: Column) -> DataFrame:
    """df in range partitions, with ``__scan_p``, the partition, and ``__scan_i``, the place in it."""
    return ranged(df, *order, names=("__scan_p", "__scan_i"))


def step(order: Sequence[Column], run: Callable[[DataFrame, str], DataFrame], apart: bool = False) -> Callable[[DataFrame, str], DataFrame]:
    """``run`` over the rows in order.  The range partitions stay for the next step, unless the order is one of its own (``apart``)."""

    def add(df: DataFrame, name: str) -> DataFrame:
        if apart:
            return run(laid_out(df.drop("__scan_p", "__scan_i"), *order), name).drop("__scan_p", "__scan_i")
        return run(df if "__scan_p" in df.columns else laid_out(df, *order), name)

    return add


def running(rows: DataFrame, name: str, value: Column, function: Callable[[Column], Column], merge: Callable[[Column, Column], Column]) -> DataFrame:
    """``function`` (a sum, product, maximum or minimum) of all rows up to each one; ``merge`` puts two such results together and passes over nulls."""
    rows = rows.withColumn("__sv", value)
    kind = rows.select(function(F.col("__sv"))).schema[0].dataType
    totals = rows.groupBy("__scan_p").agg(function(F.col("__sv")).alias("__t"))
    before = Window.orderBy("__scan_p").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(F.col("__scan_p").alias("__sq"), function(F.col("__t")).over(before).alias("__sc"))
    local = function(F.col("__sv")).over(_within().rowsBetween(Window.unboundedPreceding, 0))
    joined = rows.join(_few(carried), F.col("__scan_p") == F.col("__sq"), "left")
    return joined.withColumn(name, merge(local, F.col("__sc")).cast(kind)).drop(*_OWN)


def running_sum(rows: DataFrame, name: str, value: Column) -> DataFrame:
    return running(rows, name, value, F.sum, lambda a, b: F.coalesce(a + b, a, b))


def running_product(rows: DataFrame, name: str, value: Column) -> DataFrame:
    return running(rows, name, value, F.product, lambda a, b: F.coalesce(a * b, a, b))


def running_max(rows: DataFrame, name: str, value: Column) -> DataFrame:
    return running(rows, name, value, F.max, F.greatest)


def running_min(rows: DataFrame, name: str, value: Column) -> DataFrame:
    return running(rows, name, value, F.min, F.least)


def nearest(rows: DataFrame, name: str, value: Column, ahead: bool = False, itself: bool = True) -> DataFrame:
    """The last value that is not null up to each row, or the first one from it on (``ahead``); ``itself`` counts the row's own."""
    rows = rows.withColumn("__sv", value)
    known = F.when(F.col("__sv").isNotNull(), F.col("__scan_i"))
    totals = rows.groupBy("__scan_p").agg((F.min_by if ahead else F.max_by)("__sv", known).alias("__t"))
    pick = F.first if ahead else F.last
    far, gap = ((1, Window.unboundedFollowing), 0 if itself else 1) if ahead else ((Window.unboundedPreceding, -1), 0 if itself else -1)
    carried = totals.select(F.col("__scan_p").alias("__sq"), pick("__t", ignorenulls=True).over(Window.orderBy("__scan_p").rowsBetween(*far)).alias("__sc"))
    # looking ahead is looking back in the turned order: a frame up to the last row is gone through anew for each row
    order = F.col("__scan_i").desc() if ahead else F.col("__scan_i")
    frame = Window.partitionBy("__scan_p").orderBy(order).rowsBetween(Window.unboundedPreceding, -abs(gap))
    joined = rows.join(_few(carried), F.col("__scan_p") == F.col("__sq"), "left")
    return joined.withColumn(name, F.coalesce(F.last("__sv", ignorenulls=True).over(frame), F.col("__sc"))).drop(*_OWN)


def _offsets(rows: DataFrame) -> DataFrame:
    """(__sq, __so, __sl, __ss) of each partition: counts before it, in it, and of all."""
    counts = rows.groupBy("__scan_p").agg(F.count(F.lit(1)).alias("__sl"))
    before = Window.orderBy("__scan_p").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("__scan_p").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return counts.select(F.col("__scan_p").alias("__sq"), F.coalesce(F.sum("__sl").over(before), F.lit(0)).alias("__so"), "__sl", F.sum("__sl").over(every).alias("__ss"))


def _numbered(rows: DataFrame) -> DataFrame:
    """rows with ``__sn``, the 0-based place of each in the whole order, and the columns of ``_offsets``."""
    return rows.join(_few(_offsets(rows)), F.col("__scan_p") == F.col("__sq")).withColumn("__sn", F.col("__so") + F.col("__scan_i"))


def place(rows: DataFrame, name: str, value: Column | None = None) -> DataFrame:
    """The 0-based place of each row and the number of rows (of those where ``value`` is known), as a struct (at, size)."""
    joined = _numbered(rows)
    size = F.col("__ss") if value is None else F.lit(rows.agg(F.count(value)).first()[0])
    return joined.withColumn(name, F.struct(F.col("__sn").alias("at"), size.alias("size"))).drop(*_OWN)


def shifted(rows: DataFrame, name: str, value: Column, k: int, default: Column | None = None) -> DataFrame:
    """The value k places before each row (behind it, for a negative k), or ``default`` where there is none.

    Rows less than k from the edge of their partition are looked up by place:
    those of an equality join on different whole numbers, whatever k is.
    """
    rows = _numbered(rows.withColumn("__sv", value))
    back = k >= 0
    inner = F.lag("__sv", k).over(_within()) if back else F.lead("__sv", -k).over(_within())
    near = F.col("__scan_i") < k if back else F.col("__scan_i") >= F.col("__sl") + k
    wanted = rows.where(near).select((F.col("__sn") - k).alias("__k"))
    found = cut(rows.select(F.col("__sn").alias("__f"), F.col("__sv").alias("__x")).join(wanted, F.col("__f") == F.col("__k"), "left_semi"))
    if found.count() <= MOST_BROADCAST:
        found = F.broadcast(found)
    # rows that need nothing from elsewhere get keys of their own below zero, so that no key is hot
    at = F.when(near & (F.col("__sn") >= k), F.col("__sn") - k).otherwise(-1 - F.col("__sn"))
    joined = rows.withColumn("__near", inner).join(found, at == F.col("__f"), "left")
    inside = (F.col("__sn") - k >= 0) & (F.col("__sn") - k < F.col("__ss"))
    there = F.when(near, F.col("__x")).otherwise(F.col("__near"))
    return joined.withColumn(name, there if default is None else F.when(inside, there).otherwise(default)).drop("__near", "__f", "__x", *_OWN)


def rolling(rows: DataFrame, name: str, value: Column, width: int, function: Callable[[Column], Column]) -> DataFrame:
    """``function`` of the last ``width`` rows, null before so many values are known.

    The last width - 1 rows before a partition are copied into it.
    """
    rows = _numbered(rows.withColumn("__sv", value))
    firsts = rows.groupBy("__scan_p").agg(F.min("__sn").alias("__first")).withColumnRenamed("__scan_p", "__to")
    tails = cut(rows.where(F.col("__sl") - F.col("__scan_i") < width).select("__sn", "__sv"))
    copied = tails.join(_few(firsts), (F.col("__sn") < F.col("__first")) & (F.col("__sn") > F.col("__first") - width))
    copies = copied.select(F.col("__to").alias("__scan_p"), (F.col("__sn") - F.col("__first")).alias("__scan_i"), "__sv")
    every = rows.withColumn("__own", F.lit(True)).unionByName(copies, allowMissingColumns=True)
    over = _within().rowsBetween(1 - width, 0)
    made = every.withColumn(name, F.when(F.count("__sv").over(over) >= width, function(F.col("__sv")).over(over)))
    return made.where("__own").drop("__own", *_OWN)


def value_places(df: DataFrame, name: str, value: Column) -> DataFrame:
    """For each value that is not null a struct: rows below it (before), rows of it (same), different values below it (steps), rows with a value (size)."""
    df = df.withColumn("__x", value)
    counts = df.where("__x is not null").groupBy(F.col("__x").alias("__y")).agg(F.count(F.lit(1)).alias("__same"))
    placed = _numbered(running_sum(laid_out(counts, F.col("__y")), "__upto", F.col("__same")))
    size = placed.agg(F.sum("__same")).first()[0] or 0
    made = placed.select("__y", F.struct((F.col("__upto") - F.col("__same")).alias("before"), F.col("__same").alias("same"), F.col("__sn").alias("steps"), F.lit(size).cast("bigint").alias("size")).alias(name))
    return df.join(made, F.col("__x") == F.col("__y"), "left").drop("__x", "__y")
