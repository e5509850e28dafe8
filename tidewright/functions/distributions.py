"""Densities, distribution functions, quantiles and draws as expressions over columns."""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..models import special as s
from ..plans.shipping import ship
from .expr import Expr, compose, named


def _by_value(function: Callable[[float], float]) -> Callable[[Any], Expr]:
    """An Arrow UDF over single values; null gives null."""

    @F.pandas_udf(DoubleType())
    def over(x: pd.Series) -> pd.Series:
        codes, values = pd.factorize(x)  # nulls have the code -1; a value that comes back is computed once
        return pd.Series([function(float(v)) for v in values] + [float("nan")], dtype="float64").take(codes).where(codes >= 0, None).set_axis(x.index)

    def build(a: Column) -> Column:
        ship(SparkSession.active())
        return over(a.cast("double"))

    return lambda x: compose(build, named(x))


def _tail(value: Callable[[float], float], lower_tail: bool) -> Callable[[float], float]:
    return value if lower_tail else lambda q: 1 - value(q)


def _quantile(value: Callable[[float], float], lower_tail: bool) -> Callable[[float], float]:
    return value if lower_tail else lambda p: value(1 - p)


# normal: density in SQL, the rest by value
def dnorm(x: Any, mean: float = 0.0, sd: float = 1.0) -> Expr:
    return compose(lambda a: F.exp(-(((a - mean) / sd) ** 2) / 2) / (sd * math.sqrt(2 * math.pi)), named(x))


def pnorm(q: Any, mean: float = 0.0, sd: float = 1.0, lower_tail: bool = True) -> Expr:
    return _by_value(_tail(lambda v: s.pnorm((v - mean) / sd), lower_tail))(q)


def qnorm(p: Any, mean: float = 0.0, sd: float = 1.0, lower_tail: bool = True) -> Expr:
    return _by_value(_quantile(lambda v: mean + sd * s.qnorm(v), lower_tail))(p)


def rnorm(mean: float = 0.0, sd: float = 1.0, seed: int | None = None) -> Expr:
    return compose(lambda: F.randn(seed) * sd + mean)


# uniform and exponential: SQL
def dunif(x: Any, low: float = 0.0, high: float = 1.0) -> Expr:
    return compose(lambda a: F.when(a.isNotNull(), F.when(a.between(low, high), 1 / (high - low)).otherwise(0.0)), named(x))


def punif(q: Any, low: float = 0.0, high: float = 1.0, lower_tail: bool = True) -> Expr:
    made = compose(lambda a: F.when(a.isNotNull(), F.least(F.greatest((a - low) / (high - low), F.lit(0.0)), F.lit(1.0))), named(q))
    return made if lower_tail else 1 - made


def qunif(p: Any, low: float = 0.0, high: float = 1.0, lower_tail: bool = True) -> Expr:
    e = named(p) if lower_tail else 1 - named(p)
    return compose(lambda a: F.when(a.between(0, 1), a * (high - low) + low).when(a.isNotNull(), float("nan")), e)


def runif(low: float = 0.0, high: float = 1.0, seed: int | None = None) -> Expr:
    return compose(lambda: F.rand(seed) * (high - low) + low)


def dexp(x: Any, rate: float = 1.0) -> Expr:
    return compose(lambda a: F.when(a.isNotNull(), F.when(a >= 0, F.exp(-a * rate) * rate).otherwise(0.0)), named(x))


def pexp(q: Any, rate: float = 1.0, lower_tail: bool = True) -> Expr:
    made = compose(lambda a: F.when(a.isNotNull(), F.when(a > 0, -F.expm1(-a * rate)).otherwise(0.0)), named(q))
    return made if lower_tail else 1 - made


def qexp(p: Any, rate: float = 1.0, lower_tail: bool = True) -> Expr:
    e = named(p) if lower_tail else 1 - named(p)
    return compose(lambda a: F.when(a == 1, float("inf")).when(a.between(0, 1), -F.log1p(-a) / rate).when(a.isNotNull(), float("nan")), e)


def rexp(rate: float = 1.0, seed: int | None = None) -> Expr:
    return compose(lambda: -F.log1p(-F.rand(seed)) / rate)


# continuous families by value
def dt(x: Any, df: float) -> Expr:
    k = math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(df * math.pi)
    return compose(lambda a: F.exp(F.lit(k) - (df + 1) / 2 * F.log1p(a * a / df)), named(x))


def pt(q: Any, df: float, lower_tail: bool = True) -> Expr:
    return _by_value(lambda v: s.pt(v if lower_tail else -v, df))(q)


def qt(p: Any, df: float, lower_tail: bool = True) -> Expr:
    return _by_value(_quantile(lambda v: s.qt(v, df), lower_tail))(p)


def pf(q: Any, df1: float, df2: float, lower_tail: bool = True) -> Expr:
    return _by_value(lambda v: s.pf(v, df1, df2) if lower_tail else s.pf_upper(v, df1, df2))(q)


def qf(p: Any, df1: float, df2: float, lower_tail: bool = True) -> Expr:
    return _by_value(_quantile(lambda v: s.qf(v, df1, df2), lower_tail))(p)


def dgamma(x: Any, shape: float, rate: float = 1.0, scale: float | None = None) -> Expr:
    r = rate if scale is None else 1 / scale
    k = shape * math.log(r) - math.lgamma(shape)
    return _by_value(lambda v: 0.0 if v < 0 else (math.exp(k + (shape - 1) * math.log(v) - r * v) if v > 0 else (math.inf if shape < 1 else r if shape == 1 else 0.0)))(x)


def pgamma(q: Any, shape: float, rate: float = 1.0, scale: float | None = None, lower_tail: bool = True) -> Expr:
    r = rate if scale is None else 1 / scale
    return _by_value(_tail(lambda v: s.gamma_lower(shape, v * r), lower_tail))(q)


def qgamma(p: Any, shape: float, rate: float = 1.0, scale: float | None = None, lower_tail: bool = True) -> Expr:
    r = rate if scale is None else 1 / scale
    return _by_value(_quantile(lambda v: s.qgamma(v, shape, r), lower_tail))(p)


def dchisq(x: Any, df: float) -> Expr:
    return dgamma(x, df / 2, 0.5)


def pchisq(q: Any, df: float, lower_tail: bool = True) -> Expr:
    return pgamma(q, df / 2, 0.5, lower_tail=lower_tail)


def qchisq(p: Any, df: float, lower_tail: bool = True) -> Expr:
    return qgamma(p, df / 2, 0.5, lower_tail=lower_tail)


def dbeta(x: Any, a: float, b: float) -> Expr:
    k = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    return _by_value(lambda v: math.exp(k + (a - 1) * math.log(v) + (b - 1) * math.log1p(-v)) if 0 < v < 1 else 0.0)(x)


def pbeta(q: Any, a: float, b: float, lower_tail: bool = True) -> Expr:
    return _by_value(lambda v: s.beta_lower(a, b, v) if lower_tail else s.beta_lower(b, a, 1 - v))(q)


def qbeta(p: Any, a: float, b: float, lower_tail: bool = True) -> Expr:
    return _by_value(_quantile(lambda v: s.qbeta(v, a, b), lower_tail))(p)


# discrete families by value
def _binomial(k: float, size: int, prob: float) -> float:
    if k != int(k) or k < 0 or k > size:
        return 0.0
    if prob in (0.0, 1.0):
        return float(k == (0 if prob == 0 else size))
    return math.exp(math.lgamma(size + 1) - math.lgamma(k + 1) - math.lgamma(size - k + 1) + k * math.log(prob) + (size - k) * math.log1p(-prob))


def binomial_cdf(k: float, size: int, prob: float) -> float:
    k = math.floor(k + 1e-7)
    return 0.0 if k < 0 else 1.0 if k >= size else 1 - s.beta_lower(k + 1, size - k, prob)


def _poisson_cdf(k: float, mean: float) -> float:
    k = math.floor(k + 1e-7)
    return 0.0 if k < 0 else 1 - s.gamma_lower(k + 1, mean)


def _least(cdf: Callable[[float], float], p: float, most: float) -> float:
    """The least integer with cdf of at least p."""
    if math.isnan(p) or not 0 <= p <= 1:
        return math.nan
    low, high = -1, 1
    while high < most and cdf(high) < p * (1 - 1e-14):
        low, high = high, high * 2
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (low, middle) if cdf(middle) >= p * (1 - 1e-14) else (middle, high)
    return float(min(high, most))


def dbinom(x: Any, size: int, prob: float) -> Expr:
    return _by_value(lambda v: _binomial(v, size, prob))(x)


def pbinom(q: Any, size: int, prob: float, lower_tail: bool = True) -> Expr:
    return _by_value(_tail(lambda v: binomial_cdf(v, size, prob), lower_tail))(q)


def qbinom(p: Any, size: int, prob: float, lower_tail: bool = True) -> Expr:
    return _by_value(_quantile(lambda v: _least(lambda k: binomial_cdf(k, size, prob), v, size), lower_tail))(p)


def dpois(x: Any, mean: float) -> Expr:
    return _by_value(lambda v: math.exp(v * math.log(mean) - mean - math.lgamma(v + 1)) if v >= 0 and v == int(v) else 0.0)(x)


def ppois(q: Any, mean: float, lower_tail: bool = True) -> Expr:
    return _by_value(_tail(lambda v: _poisson_cdf(v, mean), lower_tail))(q)


def qpois(p: Any, mean: float, lower_tail: bool = True) -> Expr:
    return _by_value(_quantile(lambda v: math.inf if v == 1 else _least(lambda k: _poisson_cdf(k, mean), v, math.inf), lower_tail))(p)


# draws by inverting a uniform one
def rgamma(shape: float, rate: float = 1.0, seed: int | None = None) -> Expr:
    return qgamma(runif(seed=seed), shape, rate)


def rchisq(df: float, seed: int | None = None) -> Expr:
    return qchisq(runif(seed=seed), df)


def rt(df: float, seed: int | None = None) -> Expr:
    return qt(runif(seed=seed), df)


def rf(df1: float, df2: float, seed: int | None = None) -> Expr:
    return qf(runif(seed=seed), df1, df2)


def rbeta(a: float, b: float, seed: int | None = None) -> Expr:
    return qbeta(runif(seed=seed), a, b)


def rbinom(size: int, prob: float, seed: int | None = None) -> Expr:
    return qbinom(runif(seed=seed), size, prob)


def rpois(mean: float, seed: int | None = None) -> Expr:
    return qpois(runif(seed=seed), mean)
