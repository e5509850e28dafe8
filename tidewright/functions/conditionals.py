"""Conditionals, coercion, predicates and elementwise mathematics."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import Expr, compose, named


def if_else(condition: Expr, true_value: Any, false_value: Any, missing: Any = None) -> Expr:
    """Where the condition is null, ``missing``; strings are literals."""
    return compose(lambda c, t, f, m: F.when(c.isNull(), m).when(c, t).otherwise(f), condition, true_value, false_value, missing)


def case_when(*pairs: tuple[Any, Any], default: Any = None) -> Expr:
    """The value of the first true condition."""
    flat = [x for p in pairs for x in p]

    def build(*columns: Column) -> Column:
        out = F.when(columns[0], columns[1])
        for i in range(2, len(columns) - 1, 2):
            out = out.when(columns[i], columns[i + 1])
        return out.otherwise(columns[-1])

    return compose(build, *flat, default)


def coalesce(*args: Any) -> Expr:
    return compose(F.coalesce, *(named(a) for a in args))


def _horizontal(function):
    return lambda *args: compose(function, *(named(a) for a in args))


all_horizontal = _horizontal(lambda *c: _fold(c, lambda a, b: a & b))
any_horizontal = _horizontal(lambda *c: _fold(c, lambda a, b: a | b))
max_horizontal = _horizontal(lambda *c: F.greatest(*c) if len(c) > 1 else c[0])
min_horizontal = _horizontal(lambda *c: F.least(*c) if len(c) > 1 else c[0])
sum_horizontal = _horizontal(lambda *c: _fold([F.coalesce(x, F.lit(0)) for x in c], lambda a, b: a + b))
mean_horizontal = _horizontal(lambda *c: F.try_divide(_fold([F.coalesce(x.cast("double"), F.lit(0.0)) for x in c], lambda a, b: a + b), _fold([x.isNotNull().cast("int") for x in c], lambda a, b: a + b)))
concat_list = _horizontal(F.array)


def rowSums(*args: Any, na_rm: bool = False) -> Expr:  # noqa: N802
    return sum_horizontal(*args) if na_rm else compose(lambda *c: _fold(c, lambda a, b: a + b), *(named(a) for a in args))


def rowMeans(*args: Any, na_rm: bool = False) -> Expr:  # noqa: N802
    return mean_horizontal(*args) if na_rm else rowSums(*args) / len(args)


def _fold(columns, function):
    out = columns[0]
    for c in columns[1:]:
        out = function(out, c)
    return out


# coercion
def as_numeric(x: Any) -> Expr:
    return named(x).cast("double")


def as_integer(x: Any) -> Expr:
    return named(x).cast("bigint")


def as_character(x: Any) -> Expr:
    return named(x).cast("string")


def as_logical(x: Any) -> Expr:
    return named(x).cast("boolean")


# predicates
def is_na(x: Any) -> Expr:
    return named(x).is_null()


def is_finite(x: Any) -> Expr:
    return compose(lambda a: ~F.isnan(a.cast("double")) & (F.abs(a.cast("double")) < float("inf")), named(x))


# mathematics: logarithms of 0 and of negatives are -inf and NaN, as in floating point
def _logarithm(function, floor: float = 0.0):
    def build(a: Column) -> Column:
        a = a.cast("double")
        return F.when(a == floor, F.lit(float("-inf"))).when(a < floor, F.lit(float("nan"))).otherwise(function(a))

    return lambda x: compose(build, named(x))


ln = _logarithm(F.ln)
log2 = _logarithm(F.log2)
log10 = _logarithm(F.log10)
log1p = _logarithm(F.log1p, -1.0)


def log(x: Any, base: float | None = None) -> Expr:
    return ln(x) if base is None else ln(x) / float(__import__("math").log(base))


def _math(function):
    return lambda x: compose(function, named(x))


sqrt, exp, expm1 = _math(F.sqrt), _math(F.exp), _math(F.expm1)
sin, cos, tan, asin, acos, atan = (_math(f) for f in (F.sin, F.cos, F.tan, F.asin, F.acos, F.atan))
abs_, sign = _math(F.abs), _math(F.signum)
floor, ceiling = _math(lambda a: F.floor(a).cast("double")), _math(lambda a: F.ceil(a).cast("double"))
trunc = _math(lambda a: F.when(a >= 0, F.floor(a)).otherwise(F.ceil(a)).cast("double"))


def atan2(y: Any, x: Any) -> Expr:
    return compose(F.atan2, named(y), named(x))


def round_(x: Any, digits: int = 0) -> Expr:
    """Half to even."""
    return compose(lambda a: F.bround(a, digits), named(x))


def findInterval(x: Any, vec: list[float], rightmost_closed: bool = False, all_inside: bool = False, left_open: bool = False) -> Expr:  # noqa: N802
    """How many of the sorted breaks are at or below x (below, when left_open)."""

    def build(a: Column) -> Column:
        breaks = F.array(*[F.lit(float(v)) for v in vec])
        at = F.size(F.filter(breaks, (lambda b: b < a) if left_open else (lambda b: b <= a)))
        if rightmost_closed and len(vec) > 1:
            edge = vec[0] if left_open else vec[-1]
            at = F.when(a == float(edge), F.lit(1 if left_open else len(vec) - 1)).otherwise(at)
        if all_inside:
            at = F.least(F.greatest(at, F.lit(1)), F.lit(len(vec) - 1))
        return F.when(a.isNotNull(), at)

    return compose(build, named(x))


def cut(x: Any, breaks: list[float], labels: list[str] | bool | None = None, right: bool = True, include_lowest: bool = False) -> Expr:
    """The interval that x falls into; null outside.  ``labels=False`` gives 0-based codes."""
    pairs = list(zip(breaks[:-1], breaks[1:], strict=True))

    def show(v: float) -> str:
        return f"{v:g}"

    def label(i: int, lo: float, hi: float) -> Any:
        if labels is False:
            return i
        if labels:
            return labels[i]
        first, last = include_lowest and right and i == 0, include_lowest and not right and i == len(pairs) - 1
        return ("[" if first or not right else "(") + f"{show(lo)},{show(hi)}" + ("]" if right or last else ")")

    def build(a: Column) -> Column:
        out = None
        for i, (lo, hi) in enumerate(pairs):
            inside = (a > lo) & (a <= hi) if right else (a >= lo) & (a < hi)
            if include_lowest and (i == 0 if right else i == len(pairs) - 1):
                inside = inside | (a == (lo if right else hi))
            out = F.when(inside, F.lit(label(i, lo, hi))) if out is None else out.when(inside, F.lit(label(i, lo, hi)))
        return out

    return compose(build, named(x))


