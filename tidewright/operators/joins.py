"""Joins: equi with null-safe keys, inequality, interval, and rolling."""

from __future__ import annotations

import sys
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import Comparison, Name, quote
from . import theta
from .frame import Frame
from .scans import laid_out, nearest

_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


@dataclass
class JoinSpec:
    equal: list[tuple[str, str]] = field(default_factory=list)
    theta: list[tuple[str, str, str]] = field(default_factory=list)  # left, op, right
    rolling: tuple[str, str, str] | None = None
    #: columns (x low, x high, y low, y high) of intervals that have to meet
    interval: tuple[str, str, str, str] | None = None


class Closest:
    def __init__(self, condition: Comparison):
        self.condition = condition


def closest(condition: Comparison) -> Closest:
    """The nearest right row: >= and > look back, <= and < ahead, == both ways."""
    return Closest(condition)


class Thetas(list):
    """Comparisons of an interval (or point) on the left with one on the right, which meet wherever they hold."""

    def __init__(self, pairs: list, interval: tuple[str, str, str, str]):
        super().__init__(pairs)
        self.interval = interval


def overlaps(x_lower: str, x_upper: str, y_lower: str, y_upper: str) -> Thetas:
    return Thetas([(x_lower, "<=", y_upper), (x_upper, ">=", y_lower)], (x_lower, x_upper, y_lower, y_upper))


def within(x_lower: str, x_upper: str, y_lower: str, y_upper: str) -> Thetas:
    return Thetas([(x_lower, ">=", y_lower), (x_upper, "<=", y_upper)], (x_lower, x_upper, y_lower, y_upper))


def join_between(x: str, y_lower: str, y_upper: str) -> Thetas:
    return Thetas([(x, ">=", y_lower), (x, "<=", y_upper)], (x, x, y_lower, y_upper))


def _sides(c: Comparison) -> tuple[str, str, str]:
    if not isinstance(c.left, Name) or not isinstance(c.right, Name):
        raise TypeError("a join condition compares a column with a column")
    return c.left.column, c.op, c.right.column


def join_by(*args: Any) -> JoinSpec:
    """A conjunction of names, ``col(l) == col(r)``, comparisons, intervals and at most one closest()."""
    spec = JoinSpec()
    for a in args:
        if isinstance(a, str):
            spec.equal.append((a, a))
        elif isinstance(a, Thetas):
            spec.theta += a
            spec.interval = spec.interval or a.interval
        elif isinstance(a, Closest):
            if spec.rolling:
                raise ValueError("only one closest() in a join")
            spec.rolling = _sides(a.condition)
        elif isinstance(a, Comparison):
            left, op, right = _sides(a)
            if op == "==":
                spec.equal.append((left, right))
            else:
                spec.theta.append((left, op, right))
        else:
            raise TypeError(f"not a join condition: {a!r}")
    return spec


def _spec(by: Any, left: Frame, right: Frame) -> JoinSpec:
    if isinstance(by, JoinSpec):
        return by
    if by is None:
        shared = [c for c in left.columns if c in right.columns]
        if not shared:
            raise ValueError("no columns in common; give by=")
        print(f"Joining with by = {shared}", file=sys.stderr)
        return JoinSpec([(c, c) for c in shared])
    if isinstance(by, str):
        return JoinSpec([(by, by)])
    if isinstance(by, dict):
        return JoinSpec(list(by.items()))
    return JoinSpec([(c, c) for c in by])


def _aligned(l: DataFrame, r: DataFrame, a: str, b: str) -> tuple[Column, Column]:  # noqa: E741
    """Key columns of one type; numbers widen, a string never meets a number."""
    x, y = l.schema[a].dataType, r.schema[b].dataType
    number = (*_INTEGERS, T.FloatType, T.DoubleType, T.DecimalType)
    if isinstance(x, number) != isinstance(y, number) or (isinstance(x, T.StringType) != isinstance(y, T.StringType)):
        raise TypeError(f"join keys {a} ({x.simpleString()}) and {b} ({y.simpleString()}) have different types")
    lc, rc = l[quote(a)], r[quote(b)]
    if type(x) is not type(y) and isinstance(x, number):
        wide = "bigint" if isinstance(x, _INTEGERS) and isinstance(y, _INTEGERS) else "double"
        return lc.cast(wide), rc.cast(wide)
    return lc, rc


def _renamed(left: Frame, right: Frame, keys: Sequence[tuple[str, str]], suffix: tuple[str, str], coalesce: bool, how: str, l: DataFrame, r: DataFrame) -> list[Column]:  # noqa: E741
    """Left columns, then right ones without the keys; equal names take suffixes on both sides."""
    right_keys = {b for _, b in keys} if coalesce else set()
    rest = [c for c in right.columns if c not in right_keys]
    left_keys = {a for a, _ in keys} if coalesce else set()
    clash = {c for c in left.columns if c in rest and c not in left_keys} | ({c for c in left_keys if c in rest})
    partner = dict(keys)
    out = []
    for c in left.columns:
        column = l[quote(c)]
        if c in left_keys and how in ("right", "full"):
            column = F.coalesce(l[quote(c)], r[quote(partner[c])]) if how == "full" else r[quote(partner[c])]
        out.append(column.alias(c + suffix[0] if c in clash else c))
    return [*out, *[r[quote(c)].alias(c + suffix[1] if c in clash else c) for c in rest]]



def _bucket_width(l: DataFrame, r: DataFrame, interval: tuple[str, str, str, str]) -> float | None:  # noqa: E741
    """The mean length of both sides' intervals, or a thousandth of the longest, for numbers; None for others, which are compared in a nested loop."""
    x0, x1, y0, y1 = interval
    if not all(isinstance(d.schema[c].dataType, (*_INTEGERS, T.FloatType, T.DoubleType)) for d, c in ((l, x0), (l, x1), (r, y0), (r, y1))):
        return None
    mean, longest, reach = 0.0, 0.0, 0.0
    for d, a, b in ((l, x0, x1), (r, y0, y1)):
        size = F.abs(F.col(quote(b)).cast("double") - F.col(quote(a)).cast("double"))
        m, most, low, high = d.agg(F.avg(size), F.max(size), F.min(F.col(quote(a)).cast("double")), F.max(F.col(quote(b)).cast("double"))).first()
        mean, longest, reach = max(mean, m or 0.0), max(longest, most or 0.0), max(reach, (high or 0.0) - (low or 0.0))
    width = max(mean, longest / 1000, reach / 1e12)
    return width if 0 < width < float("inf") else None


def _bucketed(df: DataFrame, low: str, high: str, width: float, name: str) -> DataFrame:
    """A row for each bucket ``name`` that an interval touches, with the first of them in ``name``0; rows with a null or NaN end meet nothing."""
    a, b = F.col(quote(low)).cast("double"), F.col(quote(high)).cast("double")
    first, last = F.floor(F.least(a, b) / width), F.floor(F.greatest(a, b) / width)
    known = df.where(a.isNotNull() & b.isNotNull() & ~F.isnan(a) & ~F.isnan(b))
    if low == high:  # a point's only bucket
        return known.withColumn(name, first)
    return known.withColumn(name + "0", first).withColumn(name, F.explode(F.sequence(first, last)))


def _first_shared(l: Any, r: Any, points: bool) -> Column:  # noqa: E741
    """Whether the bucket of a pair is the first that both sides touch; points touch one."""
    return F.lit(True) if points else l[quote("__bx")] == F.greatest(l[quote("__bx0")], r[quote("__by0")])


def _join(left: Frame, right: Frame, by: Any, how: str, suffix: tuple[str, str], keep: bool, na_matches: str) -> Frame:
    if na_matches not in ("na", "never") or len(suffix) != 2:
        raise ValueError("na_matches is 'na' or 'never', and suffix has two parts")
    spec = _spec(by, left, right)
    if spec.rolling:
        if how not in ("inner", "left", "left_semi", "left_anti"):
            raise NotImplementedError("a rolling join is inner, left, semi or anti")
        return _rolling(left, right, spec, how, suffix, na_matches)
    l, r = left.df.alias("l"), right.df.alias("r")  # noqa: E741
    l, r = l.select(*[F.col(f"l.{quote(c)}").alias(c) for c in left.columns]), r.select(*[F.col(f"r.{quote(c)}").alias(c) for c in right.columns])  # noqa: E741
    condition = F.lit(True)
    width = _bucket_width(l, r, spec.interval) if spec.interval and how == "inner" and not spec.equal else None
    if spec.theta and not spec.equal and not width and l.count() * r.count() > theta.FEW_PAIRS:
        return _unequal(left, right, spec.theta, how, suffix, l, r)
    points = False
    if width:
        x0, x1, y0, y1 = spec.interval
        l, r = _bucketed(l, x0, x1, width, "__bx"), _bucketed(r, y0, y1, width, "__by")  # noqa: E741
        points = x0 == x1 or y0 == y1
    same = [(F.col("__bx"), F.col("__by"))] if width else [_aligned(l, r, a, b) for a, b in spec.equal]
    both = theta.dealt(l, r, same, na_matches == "na", spec.theta) if how == "inner" and same and theta.many_pairs(l, r, same) else None
    if both:
        pairs, l, r = both.met()  # noqa: E741
    elif width:
        condition = F.col("__bx") == F.col("__by")
    else:
        for x, y in same:
            condition = condition & (x.eqNullSafe(y) if na_matches == "na" else x == y)
    if width:
        condition = condition & _first_shared(l, r, points)
    for a, op, b in spec.theta:
        condition = condition & theta.OPS[op](l[quote(a)], r[quote(b)])
    joined = pairs.where(condition) if both else l.join(r, condition, how)
    if how in ("left_semi", "left_anti"):
        return left._new(joined)
    return left._new(joined.select(*_renamed(left, right, spec.equal, suffix, not keep, how, l, r)))


def _unequal(left: Frame, right: Frame, pairs: Sequence[tuple[str, str, str]], how: str, suffix: tuple[str, str], l: DataFrame, r: DataFrame) -> Frame:  # noqa: E741
    """A join on comparisons alone by tiles of rows; rows without a match are told apart by a scan and added."""
    sides = [_aligned(l, r, a, b) for a, _, b in pairs]
    ops = [op for _, op, _ in pairs]
    lk = l.select("*", *[x.alias(f"__l{i}") for i, (x, _) in enumerate(sides)])
    rk = r.select("*", *[y.alias(f"__r{i}") for i, (_, y) in enumerate(sides)])
    if how in ("left_semi", "left_anti"):
        found = F.col("__found") if how == "left_semi" else ~F.col("__found")
        return left._new(theta.matched(lk, rk, ops, "__found").where(found).select(*map(quote, left.columns)))
    # columns of both sides go by numbers while they stand beside each other
    final = l.join(r).select(*_renamed(left, right, [], suffix, False, how, l, r)).columns
    size = len(left.columns)
    lk = lk.toDF(*[f"__c{i}" for i in range(size)], *[f"__l{i}" for i in range(len(ops))])
    rk = rk.toDF(*[f"__c{i}" for i in range(size, len(final))], *[f"__r{i}" for i in range(len(ops))])
    columns = [f"__c{i}" for i in range(len(final))]
    out = theta.matches(lk, rk, ops).select(*columns)
    if how in ("left", "full"):
        alone = theta.matched(lk, rk, ops, "__found").where("NOT __found").select(*columns[:size])
        out = out.unionByName(alone, allowMissingColumns=True)
    if how in ("right", "full"):
        turned = [theta.TURNED[op] for op in ops]
        flipped = [d.withColumnsRenamed({f"__{a}{i}": f"__{b}{i}" for i in range(len(ops))}) for d, a, b in ((rk, "r", "l"), (lk, "l", "r"))]
        alone = theta.matched(*flipped, turned, "__found").where("NOT __found").select(*columns[size:])
        out = out.unionByName(alone, allowMissingColumns=True)
    return left._new(out.select(*[F.col(c).alias(name) for c, name in zip(columns, final, strict=True)]))


def inner_join(left: Frame, right: Frame, by: Any = None, suffix: tuple[str, str] = (".x", ".y"), keep: bool = False, na_matches: str = "na", unmatched: str = "drop", relationship: str | None = None) -> Frame:
    """Matching rows.  unmatched="error" and a relationship (like "many-to-one") are checked before, by jobs of their own."""
    spec = _spec(by, left, right)
    if unmatched == "error" and not _join(left, right, spec, "left_anti", suffix, keep, na_matches).df.isEmpty():
        raise ValueError("rows of the left frame have no match")
    if relationship and spec.equal:
        for side, frame, keys in (("one-to", left, [a for a, _ in spec.equal]), ("to-one", right, [b for _, b in spec.equal])):
            one = relationship.startswith("one-") if side == "one-to" else relationship.endswith("-one")
            if one and not frame.df.groupBy(*map(quote, keys)).count().where("count > 1").isEmpty():
                raise ValueError(f"keys are repeated, which {relationship} doesn't allow")
    return _join(left, right, spec, "inner", suffix, keep, na_matches)


def left_join(left: Frame, right: Frame, by: Any = None, suffix: tuple[str, str] = (".x", ".y"), keep: bool = False, na_matches: str = "na") -> Frame:
    return _join(left, right, by, "left", suffix, keep, na_matches)


def right_join(left: Frame, right: Frame, by: Any = None, suffix: tuple[str, str] = (".x", ".y"), keep: bool = False, na_matches: str = "na") -> Frame:
    return _join(left, right, by, "right", suffix, keep, na_matches)


def full_join(left: Frame, right: Frame, by: Any = None, suffix: tuple[str, str] = (".x", ".y"), keep: bool = False, na_matches: str = "na") -> Frame:
    return _join(left, right, by, "full", suffix, keep, na_matches)


def semi_join(left: Frame, right: Frame, by: Any = None, na_matches: str = "na") -> Frame:
    return _join(left, right, by, "left_semi", (".x", ".y"), False, na_matches)


def anti_join(left: Frame, right: Frame, by: Any = None, na_matches: str = "na") -> Frame:
    return _join(left, right, by, "left_anti", (".x", ".y"), False, na_matches)


def cross_join(left: Frame, right: Frame, suffix: tuple[str, str] = (".x", ".y")) -> Frame:
    clash = set(left.columns) & set(right.columns)
    l = left.df.toDF(*[c + suffix[0] if c in clash else c for c in left.columns])  # noqa: E741
    r = right.df.toDF(*[c + suffix[1] if c in clash else c for c in right.columns])
    return left._new(l.crossJoin(r))


def _rolling(left: Frame, right: Frame, spec: JoinSpec, how: str, suffix: tuple[str, str], na_matches: str) -> Frame:
    """Both sides in one sorted pass: each left row takes the last (or next) right row before (behind) it."""
    a, op, b = spec.rolling
    keys = [f"__k{i}" for i in range(len(spec.equal))]
    pairs = [_aligned(left.df, right.df, x, y) for x, y in spec.equal]
    lk, rk = _aligned(left.df, right.df, a, b)
    # a left row stands behind equal right rows when it may take them from before, and ahead of them otherwise
    look_back = op in (">=", ">", "==")
    place = {">=": 1, ">": -1, "<=": -1, "<": 1, "==": 1}[op]
    l = left.df.select(*[p[0].alias(k) for p, k in zip(pairs, keys, strict=True)], lk.alias("__t"), F.lit(place).alias("__s"), F.struct(*[left.df[quote(c)] for c in left.columns]).alias("__l"))  # noqa: E741
    ordinal = F.struct(*[right.df[quote(c)] for c, _ in right.order]) if right.order else F.lit(0)
    r = right.df.where(rk.isNotNull()).select(*[p[1].alias(k) for p, k in zip(pairs, keys, strict=True)], rk.alias("__t"), F.lit(0).alias("__s"), ordinal.alias("__o"), F.struct(*[right.df[quote(c)] for c in right.columns]).alias("__r"))
    both = l.unionByName(r, allowMissingColumns=True)
    if keys:
        w = Window.partitionBy(*keys).orderBy("__t", "__s", "__o")
        back = F.last("__r", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
        # equal places hold left rows alone, or right ones without an order, so the turned order serves as well
        turned = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in ("__t", "__s", "__o")])
        ahead = F.last("__r", ignorenulls=True).over(turned.rowsBetween(Window.unboundedPreceding, -1))
    else:  # range partitions that hand their last (or first) right row on
        both = laid_out(both, F.col("__t"), F.col("__s"), F.col("__o"))
        if look_back:
            both = nearest(both, "__back", F.col("__r"), itself=False)
        if op == "==" or not look_back:
            both = nearest(both, "__ahead", F.col("__r"), ahead=True, itself=False)
        back, ahead = F.col("__back"), F.col("__ahead")
    if op == "==":
        both = both.withColumn("__b", back).withColumn("__a", ahead)
        near_back = (F.col("__b").isNotNull()) & (F.col("__a").isNull() | ((F.col("__t") - F.col(f"__b.{quote(b)}")) <= (F.col(f"__a.{quote(b)}") - F.col("__t"))))
        match = F.when(near_back, F.col("__b")).otherwise(F.col("__a"))
    else:
        match = back if look_back else ahead
    out = both.withColumn("__m", match).where("__l is not null")
    usable = F.col("__t").isNotNull()
    if na_matches == "never":
        for k in keys:
            usable = usable & F.col(k).isNotNull()
    out = out.withColumn("__m", F.when(usable, F.col("__m")))
    if how in ("inner", "left_semi"):
        out = out.where("__m is not null")
    elif how == "left_anti":
        out = out.where("__m is null")
    if how in ("left_semi", "left_anti"):
        return left._new(out.select("__l.*"))
    drop = {y for _, y in spec.equal}
    rest = [c for c in right.columns if c not in drop]
    clash = {c for c in left.columns if c in rest}
    columns = [F.col(f"__l.{quote(c)}").alias(c + suffix[0] if c in clash else c) for c in left.columns]
    return left._new(out.select(*columns, *[F.col(f"__m.{quote(c)}").alias(c + suffix[1] if c in clash else c) for c in rest]))


def range_join(left: Frame, right: Frame, x: tuple[str, str], y: tuple[str, str], width: float, suffix: tuple[str, str] = (".x", ".y")) -> Frame:
    """Overlapping numeric intervals by buckets of ``width``: an equi join with the exact test behind it.

    A pair that shares several buckets is taken from the first one they share.
    """
    l, r = _bucketed(left.df, x[0], x[1], width, "__bx"), _bucketed(right.df, y[0], y[1], width, "__by")  # noqa: E741
    same, meet = [(F.col("__bx"), F.col("__by"))], [(x[0], "<=", y[1]), (x[1], ">=", y[0])]
    both = theta.dealt(l, r, same, False, meet) if theta.many_pairs(l, r, same) else None
    if both:
        pairs, l, r = both.met()  # noqa: E741
    condition = reduce(lambda a, b: a & b, [theta.OPS[op](l[quote(a)], r[quote(b)]) for a, op, b in meet], _first_shared(l, r, x[0] == x[1] or y[0] == y[1]))
    joined = pairs.where(condition) if both else l.join(r, (F.col("__bx") == F.col("__by")) & condition)
    return left._new(joined.select(*_renamed(left, right, [], suffix, False, "inner", l, r)))
