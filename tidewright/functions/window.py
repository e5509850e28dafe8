"""Ranks, shifts, running values and positions; ranks and positions count from 0."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..operators import scans
from .expr import Comparison, Context, Expr, aggregate, as_expr, compose, named, windowed


def _ranked(function, x: Any, whole=None, ordered: bool = False) -> Expr:
    """Nulls stand apart and have no rank.  ``whole`` is the function of a frame without groups, from counts of its values (or places, with ``ordered``)."""

    def build(c: Context, a: Column) -> Column:
        if not c.keys:
            if ordered:
                at = c.hoist(scans.step([a.asc_nulls_last(), *c.order], lambda df, name: scans.place(df, name, a), apart=True))
            else:
                at = c.hoist(lambda df, name: scans.value_places(df, name, a))
            return F.when(a.isNotNull(), whole(at))
        return F.when(a.isNotNull(), function(c, a, Window.partitionBy(*[F.col(k) for k in c.keys], a.isNull())))

    return windowed(build, named(x))


def row_number(x: Any = None) -> Expr:
    if x is None:
        return windowed(lambda c: F.row_number().over(c.ordered()) - 1 if c.keys else c.scan(scans.place)["at"])
    return _ranked(lambda c, a, w: F.row_number().over(w.orderBy(a, *c.order)) - 1, x, lambda at: at["at"], ordered=True)


def min_rank(x: Any) -> Expr:
    return _ranked(lambda c, a, w: F.rank().over(w.orderBy(a)) - 1, x, lambda at: at["before"])


def dense_rank(x: Any) -> Expr:
    return _ranked(lambda c, a, w: F.dense_rank().over(w.orderBy(a)) - 1, x, lambda at: at["steps"])


def percent_rank(x: Any) -> Expr:
    """min_rank / (n - 1); NaN for a single value."""

    def build(c: Context, a: Column, w) -> Column:
        size = F.count(F.lit(1)).over(w)
        return F.when(size > 1, (F.rank().over(w.orderBy(a)) - 1) / F.greatest(size - 1, F.lit(1))).otherwise(F.lit(float("nan")))

    def whole(at: Column) -> Column:
        return F.when(at["size"] > 1, at["before"] / F.greatest(at["size"] - 1, F.lit(1))).otherwise(F.lit(float("nan")))

    return _ranked(build, x, whole)


def cume_dist(x: Any) -> Expr:
    return _ranked(lambda c, a, w: F.count(F.lit(1)).over(w.orderBy(a).rangeBetween(Window.unboundedPreceding, 0)) / F.count(F.lit(1)).over(w), x, lambda at: (at["before"] + at["same"]) / at["size"])


def ntile(x: Any, n: int) -> Expr:
    def whole(at: Column) -> Column:
        """The first size % n parts have a row more than the others."""
        least, more = F.floor(at["size"] / n), at["size"] % n
        edge = more * (least + 1)
        return F.when(at["at"] < edge, F.floor(at["at"] / (least + 1))).otherwise(more + F.floor((at["at"] - edge) / F.greatest(least, F.lit(1))))

    return _ranked(lambda c, a, w: F.ntile(n).over(w.orderBy(a, *c.order)) - 1, x, whole, ordered=True)


def rank(x: Any) -> Expr:
    """Average rank of ties, from 1."""
    return _ranked(lambda c, a, w: F.rank().over(w.orderBy(a)) + (F.count(F.lit(1)).over(Window.partitionBy(*[F.col(k) for k in c.keys], a)) - 1) / 2, x, lambda at: at["before"] + (at["same"] + 1) / 2)


def signed_rank(x: Any) -> Expr:
    e = named(x)
    return compose(lambda a, b: F.signum(a) * b, e, rank(compose(F.abs, e)))


def _shift(x: Any, k: int, default: Any, order_by: Any) -> Expr:
    def build(c: Context, a: Column, d: Column, *order: Column) -> Column:
        if not c.keys:
            return c.scan(lambda df, name: scans.shifted(df, name, a, k, None if default is None else d), order)
        w = c.ordered(order)
        moved = F.lag(a, k).over(w) if k >= 0 else F.lead(a, -k).over(w)
        if default is None:
            return moved
        at = F.row_number().over(w)
        outside = at <= k if k >= 0 else at > F.count(F.lit(1)).over(Window.partitionBy(*c.keys)) + k
        return F.when(outside, d).otherwise(moved)

    return windowed(build, named(x), as_expr(default), *([] if order_by is None else [named(order_by)]))


def lag(x: Any, n: int = 1, default: Any = None, order_by: Any = None) -> Expr:
    return _shift(x, n, default, order_by)


def lead(x: Any, n: int = 1, default: Any = None, order_by: Any = None) -> Expr:
    return _shift(x, -n, default, order_by)


def diff(x: Any, lag: int = 1, differences: int = 1) -> Expr:
    out = named(x)
    for _ in range(differences):
        out = out - _shift(out, lag, None, None)
    return out


def _running(c: Context):
    return c.ordered().rowsBetween(Window.unboundedPreceding, 0)


def _cumulative(function, x: Any, whole) -> Expr:
    """Running value over the non-null ones, null where the value is."""
    return windowed(lambda c, a: F.when(a.isNotNull(), _over(c, a, function, whole)), named(x))


def _over(c: Context, a: Column, function, whole) -> Column:
    """A running aggregate of a group, or ``whole``, its scan, of the whole frame."""
    return function(a).over(_running(c)) if c.keys else c.scan(lambda df, name: whole(df, name, a))


def cumsum(x: Any) -> Expr:
    """Running sum; TRUE counts as 1."""
    return _cumulative(F.sum, _as_number(x), scans.running_sum)


def _as_number(x: Any) -> Expr:
    e = named(x)
    return compose(lambda a: a.cast("bigint"), e) if isinstance(e, Comparison) else e


def cumprod(x: Any) -> Expr:
    return _cumulative(F.product, x, scans.running_product)


def cummax(x: Any) -> Expr:
    return _cumulative(F.max, x, scans.running_max)


def cummin(x: Any) -> Expr:
    return _cumulative(F.min, x, scans.running_min)


def _any_so_far(c: Context, test: Column) -> Column:
    return _over(c, test, F.max, scans.running_max)


def cummean(x: Any) -> Expr:
    """Running mean; a null makes the rest null."""

    def build(c: Context, a: Column) -> Column:
        place = F.row_number().over(c.ordered()) if c.keys else c.scan(scans.place)["at"] + 1
        return F.when(_any_so_far(c, a.isNull()), F.lit(None)).otherwise(_over(c, a, F.sum, scans.running_sum) / place)

    return windowed(build, named(x))


def cumall(x: Any) -> Expr:
    """Running AND in three-valued logic."""

    def build(c: Context, a: Column) -> Column:
        return F.when(F.coalesce(_any_so_far(c, ~a), F.lit(False)), False).when(_any_so_far(c, a.isNull()), None).otherwise(True)

    return windowed(build, named(x))


def cumany(x: Any) -> Expr:
    """Running OR in three-valued logic."""

    def build(c: Context, a: Column) -> Column:
        return F.when(F.coalesce(_any_so_far(c, a), F.lit(False)), True).when(_any_so_far(c, a.isNull()), None).otherwise(False)

    return windowed(build, named(x))


def between(x: Any, left: Any, right: Any) -> Expr:
    return named(x).between(left, right)


def na_if(x: Any, y: Any) -> Expr:
    return compose(lambda a, b: F.nullif(a, b), named(x), y)


def near(x: Any, y: Any, tol: float = 1.5e-8) -> Expr:
    return compose(lambda a, b: F.abs(a - b) < tol, named(x), y)


def nth(x: Any, n: int, order_by: Any = None, default: Any = None, na_rm: bool = True) -> Expr:
    """The n-th value from 0, or from the end for negatives; nulls take no place with na_rm."""
    ordering = [] if order_by is None else [named(order_by)]

    def build(c: Context) -> Column:
        row = Context("row", c.keys, c.order, c.plain, c.hoisted, c.totals)
        a = named(x).build(row)
        plain = [(o.build(row), False) for o in ordering] or c.plain
        if not plain or len({d for _, d in plain}) > 1:
            raise ValueError("first, last and nth need an order, all of it ascending or all descending")
        k = n if not plain[0][1] else -n - 1
        order = [o for o, _ in plain]
        if c.mode == "agg" or not c.keys:
            tagged = F.when(a.isNotNull() if na_rm else F.lit(True), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], a.alias("v")))
            if k in (0, -1):  # no list for the ends
                made = (F.min(tagged) if k == 0 else F.max(tagged))["v"]
            else:
                made = F.try_element_at(F.array_sort(F.collect_list(tagged)), F.lit(k + 1 if k >= 0 else k))["v"]
            if c.mode != "agg":
                made = c.total(made)
        else:
            w = Window.partitionBy(*c.keys).orderBy(*[o if k >= 0 else o.desc() for o in order])
            made = F.nth_value(a, (k if k >= 0 else -k - 1) + 1, na_rm).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        return made if default is None else F.coalesce(made, as_expr(default).build(row))

    return Expr(build, named(x).uses, True, named(x).name, True)


def first(x: Any, default: Any = None, order_by: Any = None, na_rm: bool = True) -> Expr:
    return nth(x, 0, order_by, default, na_rm)


def last(x: Any, default: Any = None, order_by: Any = None, na_rm: bool = True) -> Expr:
    return nth(x, -1, order_by, default, na_rm)


def consecutive_id(*args: Any) -> Expr:
    """0-based number of the run of equal values (nulls are equal)."""

    def build(c: Context, *columns: Column) -> Column:
        whole = F.struct(*[a.alias(f"c{i}") for i, a in enumerate(columns)])
        if not c.keys:
            before = c.scan(lambda df, name: scans.shifted(df, name, whole, 1))
            start = c.scan(scans.place)["at"] == 0
            changed = F.when(start | whole.eqNullSafe(before), 0).otherwise(1)
            return c.scan(lambda df, name: scans.running_sum(df, name, changed))
        w = c.ordered()
        start = F.row_number().over(w) == 1
        change = c.hoist(F.when(start | whole.eqNullSafe(F.lag(whole).over(w)), 0).otherwise(1))
        return F.sum(change).over(_running(c))

    return windowed(build, *(named(a) for a in args))


def duplicated(x: Any) -> Expr:
    """TRUE for the second and later occurrences."""
    return windowed(lambda c, a: F.row_number().over(Window.partitionBy(*[F.col(k) for k in c.keys], a).orderBy(*(c.order or [F.lit(0)]))) > 1, named(x))


def fill_forward(x: Any) -> Expr:
    return windowed(lambda c, a: _over(c, a, lambda v: F.last(v, ignorenulls=True), scans.nearest), named(x))


def fill_backward(x: Any) -> Expr:
    def build(c: Context, a: Column) -> Column:
        if not c.keys:
            return c.scan(lambda df, name: scans.nearest(df, name, a, ahead=True))
        place = c.hoist(F.row_number().over(c.ordered()))
        return F.last(a, ignorenulls=True).over(Window.partitionBy(*c.keys).orderBy(place.desc()).rowsBetween(Window.unboundedPreceding, 0))

    return windowed(build, named(x))


def rolling_mean(x: Any, window: int) -> Expr:
    """Mean of the last ``window`` rows, null before there are so many."""

    def build(c: Context, a: Column) -> Column:
        if not c.keys:
            return c.scan(lambda df, name: scans.rolling(df, name, a, window, F.avg))
        w = c.ordered().rowsBetween(-(window - 1), 0)
        return F.when(F.count(a).over(w) >= window, F.avg(a).over(w))

    return windowed(build, named(x))


def which_max(x: Any) -> Expr:
    """0-based place of the first largest value, as an aggregate over (place, value) columns made by the frame."""
    return aggregate(lambda a, p: F.min(F.struct((-a).alias("v"), p.alias("p")))["p"], named(x), named("__place"))


def which_min(x: Any) -> Expr:
    return aggregate(lambda a, p: F.min(F.struct(a.alias("v"), p.alias("p")))["p"], named(x), named("__place"))

