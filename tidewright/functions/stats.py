"""Statistical aggregates: nulls are left out unless na_rm is false, which makes the result null where there is one."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import Expr, aggregate, divide, named


def _guarded(function: Callable[..., Column], na_rm: bool) -> Callable[..., Column]:
    if na_rm:
        return function
    return lambda *a: F.when(F.count_if(_any_null(a)) > 0, F.lit(None)).otherwise(function(*a))


def _any_null(columns: Sequence[Column]) -> Column:
    out = columns[0].isNull()
    for c in columns[1:]:
        out = out | c.isNull()
    return out


def _stat(function: Callable[..., Column], na_rm: bool, *args: Any) -> Expr:
    return aggregate(_guarded(function, na_rm), *(named(a) for a in args))


def mean(x: Any, na_rm: bool = True) -> Expr:
    return _stat(F.avg, na_rm, x)


def sum_(x: Any, na_rm: bool = True) -> Expr:
    return _stat(F.sum, na_rm, x)


def min_(x: Any, na_rm: bool = True) -> Expr:
    return _stat(F.min, na_rm, x)


def max_(x: Any, na_rm: bool = True) -> Expr:
    return _stat(F.max, na_rm, x)


def median(x: Any, na_rm: bool = True) -> Expr:
    return _stat(F.median, na_rm, x)


def var(x: Any, y: Any = None, na_rm: bool = True) -> Expr:
    return cov(x, y, na_rm) if y is not None else _stat(F.var_samp, na_rm, x)


def sd(x: Any, na_rm: bool = True) -> Expr:
    return _stat(F.stddev_samp, na_rm, x)


def cov(x: Any, y: Any, na_rm: bool = True) -> Expr:
    return _stat(F.covar_samp, na_rm, x, y)


def cor(x: Any, y: Any, na_rm: bool = True) -> Expr:
    """Pearson correlation over pairs without a null."""
    return _stat(lambda a, b: F.corr(F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)), na_rm, x, y)


def quantile(x: Any, probs: float | Sequence[float] = (0, 0.25, 0.5, 0.75, 1.0), na_rm: bool = True, approximate: bool = False) -> Expr:
    """Type 7 quantiles, one or an array; ``approximate`` bounds the memory of a group."""
    if approximate:
        return _stat(lambda a: F.percentile_approx(a, list(probs) if not isinstance(probs, int | float) else probs), na_rm, x)
    return _stat(lambda a: F.percentile(a, F.array(*[F.lit(float(p)) for p in probs]) if not isinstance(probs, int | float) else F.lit(float(probs))), na_rm, x)


#: Index offset m = a + b * p of the continuous types.
_OFFSETS = {4: (0.0, 0.0), 5: (0.5, 0.0), 6: (0.0, 1.0), 7: (1.0, -1.0), 8: (1 / 3, 1 / 3), 9: (3 / 8, 1 / 4)}


def _typed_quantile(x: Column, p: float, kind: int) -> Column:
    """A quantile of types 1 to 9 from the sorted values of a group."""
    values = F.array_sort(F.collect_list(x.cast("double")))
    n = F.size(values)

    def at(i: Column) -> Column:
        return F.element_at(values, F.least(F.greatest(i, F.lit(1)), n).cast("int"))

    if kind == 7:
        return F.percentile(x, F.lit(p))
    if kind in (1, 2, 3):
        h = n * p + (-0.5 if kind == 3 else 0.0)
        j = F.floor(h + 1e-12)
        g = h - j
        even = F.abs(g) < 1e-9
        if kind == 1:
            return F.when(n == 0, None).otherwise(at(F.when(even, j).otherwise(j + 1)))
        if kind == 2:
            return F.when(n == 0, None).when(even, (at(j) + at(j + 1)) / 2).otherwise(at(j + 1))
        return F.when(n == 0, None).otherwise(at(F.when(even & (j % 2 == 0), j).otherwise(j + 1)))
    a, b = _OFFSETS[kind]
    h = n * p + (a + b * p)
    j = F.floor(h + 4e-16)
    g = F.when(F.abs(h - j) < 1e-12, F.lit(0.0)).otherwise(h - j)
    return F.when(n == 0, None).otherwise(at(j) * (1 - g) + at(j + 1) * g)


def IQR(x: Any, na_rm: bool = True, type: int = 7) -> Expr:  # noqa: A002, N802
    return _stat(lambda a: _typed_quantile(a, 0.75, type) - _typed_quantile(a, 0.25, type), na_rm, x)


def weighted_mean(x: Any, w: Any) -> Expr:
    return aggregate(lambda a, b: divide(F.sum(a * b), F.sum(F.when(a.isNotNull(), b))), named(x), named(w))


def R_range(x: Any) -> Expr:  # noqa: N802
    """[min, max]."""
    return aggregate(lambda a: F.array(F.min(a), F.max(a)), named(x))


def any_(x: Any) -> Expr:
    return aggregate(F.bool_or, named(x))


def all_(x: Any) -> Expr:
    return aggregate(F.bool_and, named(x))
