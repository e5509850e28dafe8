"""Distribution functions of single numbers, from the standard library alone."""

from __future__ import annotations

import math
from collections.abc import Callable
from statistics import NormalDist

_NORMAL = NormalDist()


def pnorm(q: float) -> float:
    return 0.5 * math.erfc(-q / math.sqrt(2))


def qnorm(p: float) -> float:
    if math.isnan(p) or p < 0 or p > 1:
        return math.nan
    return -math.inf if p == 0 else math.inf if p == 1 else _NORMAL.inv_cdf(p)


def gamma_lower(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function."""
    if math.isnan(x) or a <= 0:
        return math.nan
    if x <= 0:
        return 0.0
    if math.isinf(x):
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-17:
            k += 1
            term *= x / k
            total += term
        return min(1.0, total * scale)
    # continued fraction by the modified method of Lentz
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 100_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return max(0.0, 1 - scale * h)


def beta_lower(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if math.isnan(x):
        return math.nan
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_lower(b, a, 1 - x)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) - (math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b))) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    h = d
    for m in range(1, 100_000):
        for an in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + an * d or 1e-300)
            c = 1 + an / c or 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


def pt(q: float, df: float) -> float:
    if math.isinf(df):
        return pnorm(q)
    tail = 0.5 * beta_lower(df / 2, 0.5, df / (df + q * q))
    return 1 - tail if q > 0 else tail


def pt_upper(q: float, df: float) -> float:
    return pt(-q, df)


def pf(q: float, df1: float, df2: float) -> float:
    return 0.0 if q <= 0 else beta_lower(df1 / 2, df2 / 2, df1 * q / (df1 * q + df2))


def pf_upper(q: float, df1: float, df2: float) -> float:
    return 1.0 if q <= 0 else beta_lower(df2 / 2, df1 / 2, df2 / (df1 * q + df2))


def pchisq(q: float, df: float) -> float:
    return gamma_lower(df / 2, q / 2)


def pchisq_upper(q: float, df: float) -> float:
    return 1 - pchisq(q, df)


def solve(cdf: Callable[[float], float], p: float, low: float, high: float) -> float:
    """The point where an increasing function reaches p."""
    if math.isnan(p) or p < 0 or p > 1:
        return math.nan
    if p == 0:
        return low
    if p == 1:
        return high
    a = low if math.isfinite(low) else -1.0
    b = high if math.isfinite(high) else 1.0
    while not math.isfinite(low) and cdf(a) > p:
        a *= 2
    while not math.isfinite(high) and cdf(b) < p:
        b *= 2
    for _ in range(300):
        middle = 0.5 * (a + b)
        if middle in (a, b):
            break
        if cdf(middle) < p:
            a = middle
        else:
            b = middle
    return 0.5 * (a + b)


def qt(p: float, df: float) -> float:
    return solve(lambda x: pt(x, df), p, -math.inf, math.inf)


def qf(p: float, df1: float, df2: float) -> float:
    return solve(lambda x: pf(x, df1, df2), p, 0.0, math.inf)


def qchisq(p: float, df: float) -> float:
    return solve(lambda x: pchisq(x, df), p, 0.0, math.inf)


def qbeta(p: float, a: float, b: float) -> float:
    return solve(lambda x: beta_lower(a, b, x), p, 0.0, 1.0)


def qgamma(p: float, shape: float, rate: float = 1.0) -> float:
    return solve(lambda x: gamma_lower(shape, x * rate), p, 0.0, math.inf)


def _range_cdf(w: float, k: int) -> float:
    """The range of k standard normal values, by Simpson's rule."""
    if w <= 0:
        return 0.0
    n, low, high = 400, -8.0, 8.0
    h = (high - low) / n
    total = 0.0
    for i in range(n + 1):
        z = low + i * h
        weight = 1 if i in (0, n) else 4 if i % 2 else 2
        total += weight * math.exp(-z * z / 2) * max(pnorm(z) - pnorm(z - w), 0.0) ** (k - 1)
    return min(1.0, k * total * h / 3 / math.sqrt(2 * math.pi))


def ptukey(q: float, k: int, df: float) -> float:
    """The studentised range: the range's distribution averaged over the deviation's."""
    if math.isinf(df) or df > 25_000:
        return _range_cdf(q, k)
    n = 120
    low, high = max(1e-6, 1 - 8 / math.sqrt(2 * df)), 1 + 8 / math.sqrt(2 * df)
    if df < 30:
        low, high = 1e-6, math.sqrt(qchisq(1 - 1e-10, df) / df)
    h = (high - low) / n
    constant = df / 2 * math.log(df) - math.lgamma(df / 2) - (df / 2 - 1) * math.log(2)
    total = 0.0
    for i in range(n + 1):
        s = low + i * h
        weight = 1 if i in (0, n) else 4 if i % 2 else 2
        total += weight * math.exp(constant + (df - 1) * math.log(s) - df * s * s / 2) * _range_cdf(q * s, k)
    return min(1.0, total * h / 3)
