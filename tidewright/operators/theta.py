"""Joins on inequalities alone, by tiles instead of a nested loop over all rows.

Both sides are cut into tiles of some thousand rows: strips by the first
compared column, blocks by the second one within a strip.  Tiles are compared
by their bounds first, and only pairs that can hold a match meet, by an
equality join on tiles with the comparisons behind it.  Whether a row has a
match at all is told by one scan, without any pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import quote
from ..plans.shared import cut
from . import scans

#: A tile has two to this power of rows.
TILE_BITS = 11
#: Pairs of rows up to which a nested loop is as quick.
FEW_PAIRS = 10_000_000

OPS: dict[str, Callable[[Column, Column], Column]] = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
TURNED = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}


#: Rows of a block: those of a key are dealt to blocks, and two blocks meet in one task.
BLOCK = 4096
#: Pairs of rows that a task compares.
TASK_PAIRS = 32_000_000
#: Rows of a pack, a multiple of 8 so that their repeated numbers in a file are the same bytes; fewer where rows may be long.
PACK = 256
PACK_OF_TEXTS = 32
#: Rows that a task holds to leave out others, and up to which what is left meets every row.
MOST_LEADING = 1000
#: Pairs of tiles, or right rows, that one task may hold.
MOST_BROADCAST = 500_000
#: Keys up to which their numbers of rows pass through the driver.
MOST_GROUPS = 100_000


def _tasks(spark: SparkSession, pairs: int) -> int:
    return max(spark.sparkContext.defaultParallelism, math.ceil(pairs / TASK_PAIRS))


def many_pairs(left: DataFrame, right: DataFrame, same: Sequence[tuple[Column, Column]]) -> bool:
    """Whether an equality join makes far more pairs than there are rows, by the numbers of rows and different keys."""
    sizes = [d.agg(F.count(F.lit(1)), F.approx_count_distinct(F.xxhash64(*keys))).first() for d, keys in ((left, [a for a, _ in same]), (right, [b for _, b in same]))]
    (n, p), (m, q) = sizes
    return n * m / max(p, q, 1) > max(FEW_PAIRS, 20 * (n + m))


class Dealt(NamedTuple):
    """Two sides dealt to blocks.  ``packs`` holds the rows of the side with more of them, some hundred to a row, with an array ``__p<i>`` for each of its columns."""

    rows: DataFrame
    packs: DataFrame
    columns: list[str]
    #: whether the left side is the one in packs
    turned: bool
    #: comparisons (column of rows, op, bound of a pack) that hold wherever a row of the pack matches
    bounds: list[tuple[str, str, str]]

    def met(self) -> tuple[DataFrame, Any, Any]:
        """The pairs of rows with equal keys, and what gives the columns of the left and of the right side by their quoted names.

        A pack meets one row after another, so that pairs come in runs: one
        side's row stays while the other side's pack is repeated, which files
        by columns hold in a tenth of a byte a pair.
        """
        condition = F.col("__u") == F.col("__v")
        for a, op, b in self.bounds:
            condition = condition & OPS[op](self.rows[quote(a)], F.col(b))
        first, *others = [f"__p{i}" for i in range(len(self.columns))]
        ours = [self.rows[quote(c)] for c in self.rows.columns]
        # the coalesce leaves the partitions as they are and ends Spark's fused stage, which else holds all pairs of a pack at once
        met = self.packs.join(self.rows.hint("shuffle_hash"), condition).select(*ours, first, *others).coalesce(1 << 30)
        pairs = met.select(*[F.col(quote(c)) for c in self.rows.columns], F.posexplode(first).alias("__at", "__q0"), *others)
        pairs = pairs.select(*ours, "__q0", *[F.get(c, "__at").alias(f"__q{i}") for i, c in enumerate(others, 1)])
        theirs = {quote(c): F.col(f"__q{i}") for i, c in enumerate(self.columns)}
        return (pairs, theirs, self.rows) if self.turned else (pairs, self.rows, theirs)


def dealt(left: DataFrame, right: DataFrame, same: Sequence[tuple[Column, Column]], nulls: bool, thetas: Sequence[tuple[str, str, str]] = ()) -> Dealt | None:
    """Both sides dealt to blocks, so that a task's pairs of rows with equal keys are bounded.

    The rows of a key are dealt to blocks, and a row is copied for each block
    of the other side: rows divided by the size of a block.  The side with more
    rows is packed in the order of its compared columns, and packs that cannot
    hold a match by ``thetas`` (column of the left side, op, column of the
    right one) meet nothing.  None for too many keys.  ``nulls``: whether they
    are equal.
    """
    spark = left.sparkSession
    names = [f"__g{i}" for i in range(len(same))]
    sides = []
    for df, keys in ((left, [a for a, _ in same]), (right, [b for _, b in same])):
        kept = df.select("*", *[k.alias(c) for k, c in zip(keys, names, strict=True)])
        sides.append(cut(kept if nulls else kept.dropna(subset=names)).withColumn("__id", F.monotonically_increasing_id()))
    counts = [d.groupBy(*names).agg(F.count(F.lit(1)).alias(c)) for d, c in zip(sides, ("__n", "__m"), strict=True)]
    both = counts[0].join(counts[1].toDF(*[f"__h{i}" for i in range(len(names))], "__m"), reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__h{i}")) for i, c in enumerate(names)]))
    groups = both.select(*names, "__n", "__m").limit(MOST_GROUPS + 1).collect()
    if len(groups) > MOST_GROUPS:
        return None
    turned = sum(g["__n"] for g in groups) > sum(g["__m"] for g in groups)
    across = max(1, TASK_PAIRS // BLOCK)  # packed rows of a block
    made, first, pairs = [], 0, 0
    for *key, n, m in groups:
        i, j = -(-(m if turned else n) // BLOCK), -(-(n if turned else m) // across)
        made.append((*key, first, i, j))
        first, pairs = first + i * j, pairs + n * m
    schema = T.StructType([*[T.StructField(f"__h{i}", sides[0].schema[c].dataType) for i, c in enumerate(names)], *[T.StructField(c, T.LongType()) for c in ("__first", "__br", "__bp")]])
    few = F.broadcast(spark.createDataFrame(made, schema))
    l, r = (d.join(few, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__h{i}")) for i, c in enumerate(names)])) for d in sides)
    rows, packed, ours, columns = (r, l, right.columns, left.columns) if turned else (l, r, left.columns, right.columns)
    rows = rows.select(*[F.col(quote(c)) for c in ours], F.explode(F.sequence(F.lit(0), F.col("__bp") - 1)).alias("__j"), F.col("__id").alias("__o"), "__first", "__br", "__bp")
    rows = rows.select(*[F.col(quote(c)) for c in ours], (F.col("__first") + F.pmod("__o", "__br") * F.col("__bp") + F.col("__j")).alias("__u"))
    # equal rows of a key go to several tasks by their number, so that no task sorts them all
    compared = list(dict.fromkeys(a if turned else b for a, _, b in thetas))
    packed = packed.select(*[F.col(quote(c)).alias(f"__c{i}") for i, c in enumerate(columns)], *[F.col(c) for c in ("__first", "__br", "__bp")], *[F.col(quote(c)).alias(f"__s{i}") for i, c in enumerate(compared)], "__id")
    order = ["__first", *[f"__s{i}" for i in range(len(compared))], "__id"]
    laid = cut(packed.repartitionByRange(*order).sortWithinPartitions(*order).drop("__id"))
    fixed = all(isinstance(f.dataType, T.NumericType | T.BooleanType | T.DateType | T.TimestampType | T.TimestampNTZType) for f in laid.schema)
    size = min(PACK if fixed else PACK_OF_TEXTS, across)
    laid = laid.withColumn("__t", F.expr(f"monotonically_increasing_id() div {size}"))
    bounds, ends = [], []
    for k, (a, op, b) in enumerate(thetas):
        mine, other = (b, a) if turned else (a, b)
        x, y = (d.schema[c].dataType for d, c in ((left, a), (right, b)))
        if x != y and not (isinstance(x, T.NumericType) and isinstance(y, T.NumericType)):
            continue  # a text's order is not that of the number in it
        low = (op in ("<", "<=")) == turned
        ends.append((F.min if low else F.max)(f"__s{compared.index(other)}").alias(f"__e{k}"))
        bounds.append((mine, TURNED[op] if turned else op, f"__e{k}"))
    packs = laid.groupBy("__first", "__br", "__bp", "__t").agg(F.collect_list(F.struct(*[f"__c{i}" for i in range(len(columns))])).alias("__rows"), *ends)
    packs = packs.select(*[F.col(f"__rows.__c{i}").alias(f"__p{i}") for i in range(len(columns))], *[b for _, _, b in bounds], "__first", "__bp", "__t", F.explode(F.sequence(F.lit(0), F.col("__br") - 1)).alias("__i"))
    packs = packs.select(*[f"__p{i}" for i in range(len(columns))], *[b for _, _, b in bounds], (F.col("__first") + F.col("__i") * F.col("__bp") + F.pmod("__t", "__bp")).alias("__v"))
    n = _tasks(spark, pairs)
    return Dealt(rows.repartition(n, "__u"), packs.repartition(n, "__v"), columns, turned, bounds)


def _keys(side: str, ops: Sequence[str]) -> list[str]:
    return [f"__{side}{i}" for i in range(len(ops))]


def _tiled(df: DataFrame, side: str, ops: Sequence[str]) -> DataFrame:
    """Rows whose compared columns are all known, with ``__<side>t``, their tile: neighbours in the first two of these columns."""
    keys = _keys(side, ops)
    known = df.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))
    tiles = known.count() / (1 << TILE_BITS)
    strips = max(1, math.ceil(math.sqrt(tiles)))
    # equal values of the first column may be many: the second one deals them to several strips
    laid = known.repartitionByRange(strips, *keys[:2]).sortWithinPartitions(*reversed(keys[:2]))
    return cut(laid).withColumn(f"__{side}t", F.shiftright(F.monotonically_increasing_id(), TILE_BITS))


def _meeting(left: DataFrame, right: DataFrame, ops: Sequence[str]) -> DataFrame:
    """(__u, __v): pairs of tiles whose bounds allow a match.  A row of bounds stands for a whole tile."""
    bounds = []
    for df, side in ((left, "l"), (right, "r")):
        made = [f(k).alias(f"{k}{end}") for k in _keys(side, ops) for f, end in ((F.min, "a"), (F.max, "z"))]
        bounds.append(cut(df.groupBy(f"__{side}t").agg(*made)))
    can = [OPS[op](F.col(f"__l{i}a"), F.col(f"__r{i}z")) if op in ("<", "<=") else OPS[op](F.col(f"__l{i}z"), F.col(f"__r{i}a")) for i, op in enumerate(ops)]
    pairs = bounds[0].join(bounds[1], reduce(lambda a, b: a & b, can))
    return cut(pairs.select(F.col("__lt").alias("__u"), F.col("__rt").alias("__v")))


def _met(left: DataFrame, right: DataFrame, ops: Sequence[str], how: str) -> DataFrame:
    """The join of both sides by pairs of tiles.  Each pair is a key of its own, so that a tile which meets many others doesn't hold up a task."""
    l, r = _tiled(left, "l", ops), _tiled(right, "r", ops)  # noqa: E741
    pairs = _meeting(l, r, ops).withColumn("__w", F.monotonically_increasing_id())
    many = pairs.count()
    few = F.broadcast(pairs) if many <= MOST_BROADCAST else pairs
    n = _tasks(left.sparkSession, many << (2 * TILE_BITS))
    l = l.join(few, F.col("__lt") == F.col("__u")).drop("__u", "__v").withColumnRenamed("__w", "__wl").repartition(n, "__wl")  # noqa: E741
    r = r.join(few, F.col("__rt") == F.col("__v")).drop("__u", "__v").withColumnRenamed("__w", "__wr").repartition(n, "__wr")
    holds = [OPS[op](F.col(f"__l{i}"), F.col(f"__r{i}")) for i, op in enumerate(ops)]
    return l.join(r.hint("shuffle_hash"), reduce(lambda a, b: a & b, holds, F.col("__wl") == F.col("__wr")), how)


def matches(left: DataFrame, right: DataFrame, ops: Sequence[str]) -> DataFrame:
    """All columns of both sides for each pair of rows whose columns ``__l<i>`` and ``__r<i>`` compare by ``ops[i]``; nulls match nothing."""
    return _met(left, right, ops, "inner")


def _leading(known: DataFrame, ops: Sequence[str]) -> DataFrame:
    """The compared columns of right rows, without many of those that another row matches for: it is as good in each comparison.

    Tasks hold at most MOST_LEADING rows to compare with; what they leave in is no fault.
    """
    keys = _keys("r", ops)
    rows = known.select(*keys)
    if not all(isinstance(rows.schema[k].dataType, (T.IntegralType, T.DoubleType, T.FloatType, T.DateType, T.TimestampType, T.TimestampNTZType)) for k in keys):
        return rows

    def pruned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            values = []
            for c, op in zip(batch.columns, ops, strict=True):
                v = c.cast(pa.int32() if pa.types.is_date32(c.type) else pa.int64() if pa.types.is_timestamp(c.type) else c.type).to_numpy(zero_copy_only=False)
                # smaller is better: ~v turns the order of whole numbers without an overflow
                values.append((~v if v.dtype.kind == "i" else -v) if op in ("<", "<=") else v)
            odd = reduce(np.logical_or, [np.isnan(v) for v in values if v.dtype.kind == "f"], np.zeros(batch.num_rows, bool))
            left = ~odd
            if held is None:
                held = [v[:0] for v in values]
            for place in range(0, batch.num_rows, 1024):
                part = slice(place, place + 1024)
                left[part] &= ~reduce(np.logical_and, [h[None, :] <= v[part, None] for h, v in zip(held, values, strict=True)]).any(axis=1)
            at = np.flatnonzero(left)
            order = at[np.lexsort([v[at] for v in reversed(values)])]
            kept, fresh = [], [np.empty(len(order), v.dtype) for v in values]
            for i in order:
                m = min(len(kept), max(0, MOST_LEADING - len(held[0])))
                if not m or not reduce(np.logical_and, [f[:m] <= v[i] for f, v in zip(fresh, values, strict=True)]).any():
                    for f, v in zip(fresh, values, strict=True):
                        f[len(kept)] = v[i]
                    kept.append(i)
            room = max(0, MOST_LEADING - len(held[0]))
            held = [np.concatenate([h, f[: min(room, len(kept))]]) for h, f in zip(held, fresh, strict=True)]
            yield batch.take(pa.array(np.concatenate([np.flatnonzero(odd), np.array(kept, dtype=np.int64)])))

    some = cut(rows.mapInArrow(pruned, rows.schema))
    return cut(some.repartition(1).mapInArrow(pruned, rows.schema)) if some.count() <= MOST_BROADCAST else some


def matched(left: DataFrame, right: DataFrame, ops: Sequence[str], mark: str) -> DataFrame:
    """left with the boolean column ``mark``: whether any row of the right side matches.

    For one comparison the right side's extreme value tells.  For two, rows of
    both sides stand in the order of the first, so that the right rows that
    satisfy it come before a left row, and the running extreme of the second
    tells.  For more, right rows go that others stand for, and left rows are
    looked for in pairs with the rest, up to their first match in a pair of tiles.
    """
    known = right.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in _keys("r", ops)]))
    if len(ops) == 1:
        extreme = known.agg((F.max if ops[0] in ("<", "<=") else F.min)("__r0").alias("__best"))
        return left.join(F.broadcast(extreme), F.lit(True)).withColumn(mark, F.coalesce(OPS[ops[0]](F.col("__l0"), F.col("__best")), F.lit(False))).drop("__best")
    if len(ops) == 2:
        first, second = ops
        whole = left.select(F.col("__l0").alias("__t"), F.lit(0 if "=" not in first else 1).alias("__s"), F.struct("*").alias("__row"))
        theirs = known.select(F.col("__r0").alias("__t"), F.lit(1 if "=" not in first else 0).alias("__s"), F.col("__r1").alias("__y"))
        # equal values: the right row comes first only where equality satisfies the comparison
        order = F.col("__t").desc_nulls_last() if first in ("<", "<=") else F.col("__t").asc_nulls_first()
        both = scans.laid_out(whole.unionByName(theirs, allowMissingColumns=True), order, F.col("__s"))
        run = scans.running_max if second in ("<", "<=") else scans.running_min
        told = run(both, "__best", F.col("__y")).where("__row IS NOT NULL")
        found = F.col("__t").isNotNull() & OPS[second](F.col("__row.__l1"), F.col("__best"))
        return told.select("__row.*", F.coalesce(found, F.lit(False)).alias(mark))
    numbered = cut(left).withColumn("__id", F.monotonically_increasing_id())
    leading = _leading(known, ops)
    if leading.limit(MOST_LEADING + 1).count() <= MOST_LEADING:
        holds = reduce(lambda a, b: a & b, [OPS[op](F.col(f"__l{i}"), F.col(f"__r{i}")) for i, op in enumerate(ops)])
        ids = numbered.join(F.broadcast(leading), holds, "left_semi").select(F.col("__id").alias("__has"))
    else:
        ids = _met(numbered, leading, ops, "left_semi").select(F.col("__id").alias("__has")).distinct()
    return numbered.join(ids, F.col("__id") == F.col("__has"), "left").withColumn(mark, F.col("__has").isNotNull()).drop("__id", "__has")
