"""Hypothesis tests from aggregates; only statistics reach the driver."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.expr import quote
from ..operators.frame import Frame
from ..operators.ranges import running_sums
from ..plans.shared import cut
from . import special as s
from .concordance import discordant


@dataclass
class HTest:
    method: str
    statistic: float
    parameter: float | tuple[float, ...] | None
    p_value: float
    estimate: dict[str, float] = field(default_factory=dict)
    conf_int: tuple[float, float] | None = None
    alternative: str = "two.sided"


def _tails(lower: float, alternative: str, upper: float | None = None) -> float:
    upper = 1 - lower if upper is None else upper
    return min(1.0, {"less": lower, "greater": upper, "two.sided": 2 * min(lower, upper)}[alternative])


def _moments(frame: Frame, x: str) -> tuple[int, float, float]:
    n, m, v = frame.df.agg(F.count(quote(x)), F.avg(quote(x)), F.var_samp(quote(x))).first()
    return int(n), float(m), float(v)


def t_test(frame: Frame, x: str, y: str | None = None, group: str | None = None, paired: bool = False, var_equal: bool = True, mu: float = 0.0, alternative: str = "two.sided", conf_level: float = 0.95) -> HTest:
    """One column, two columns, or one column by a group of two values; variances are pooled by default."""
    if paired:
        frame, x, y = Frame(frame.df.select((F.col(quote(x)) - F.col(quote(y))).alias("d"))), "d", None
    if y is None and group is None:
        n, m, v = _moments(frame, x)
        estimate, se, df, method = {"mean": m}, math.sqrt(v / n), n - 1, "Paired t-test" if paired else "One Sample t-test"
    else:
        if group is not None:
            rows = frame.df.where(F.col(quote(group)).isNotNull()).groupBy(quote(group)).agg(F.count(quote(x)), F.avg(quote(x)), F.var_samp(quote(x))).orderBy(quote(group)).limit(3).collect()
            if len(rows) != 2:
                raise ValueError("the group needs two values")
            (n1, m1, v1), (n2, m2, v2) = (tuple(r)[1:] for r in rows)
        else:
            (n1, m1, v1), (n2, m2, v2) = _moments(frame, x), _moments(frame, y)
        m, estimate = m1 - m2, {"mean of x": m1, "mean of y": m2}
        if var_equal:
            df = n1 + n2 - 2
            se, method = math.sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / df * (1 / n1 + 1 / n2)), "Two Sample t-test"
        else:
            a, b = v1 / n1, v2 / n2
            se, df, method = math.sqrt(a + b), (a + b) ** 2 / (a * a / (n1 - 1) + b * b / (n2 - 1)), "Welch Two Sample t-test"
    t = (m - mu) / se
    reach = s.qt((1 + conf_level) / 2 if alternative == "two.sided" else conf_level, df) * se
    ci = {"two.sided": (m - reach, m + reach), "less": (-math.inf, m + reach), "greater": (m - reach, math.inf)}[alternative]
    return HTest(method, t, df, _tails(s.pt(t, df), alternative, s.pt_upper(t, df)), estimate, ci, alternative)


def var_test(frame: Frame, x: str, y: str, ratio: float = 1.0, alternative: str = "two.sided", conf_level: float = 0.95) -> HTest:
    (n1, _, v1), (n2, _, v2) = _moments(frame, x), _moments(frame, y)
    f = v1 / v2 / ratio
    a = (1 - conf_level) / 2 if alternative == "two.sided" else 1 - conf_level
    low, high = v1 / v2 / s.qf(1 - a, n1 - 1, n2 - 1), v1 / v2 / s.qf(a, n1 - 1, n2 - 1)
    ci = {"two.sided": (low, high), "less": (0.0, high), "greater": (low, math.inf)}[alternative]
    return HTest("F test to compare two variances", f, (n1 - 1, n2 - 1), _tails(s.pf(f, n1 - 1, n2 - 1), alternative, s.pf_upper(f, n1 - 1, n2 - 1)), {"ratio": v1 / v2}, ci, alternative)


def bartlett_test(frame: Frame, x: str, group: str) -> HTest:
    rows = frame.df.groupBy(quote(group)).agg(F.count(quote(x)).alias("n"), F.var_samp(quote(x)).alias("v")).where("n > 1")
    k, total, inner, logs, inverse = rows.agg(F.count(F.lit(1)), F.sum(F.col("n") - 1), F.sum((F.col("n") - 1) * F.col("v")), F.sum((F.col("n") - 1) * F.ln("v")), F.sum(1 / (F.col("n") - 1))).first()
    stat = (total * math.log(inner / total) - logs) / (1 + (inverse - 1 / total) / (3 * (k - 1)))
    return HTest("Bartlett test of homogeneity of variances", stat, k - 1, s.pchisq_upper(stat, k - 1))


def cor_test(frame: Frame, x: str, y: str, method: str = "pearson", alternative: str = "two.sided", conf_level: float = 0.95) -> HTest:
    df = frame.df.where(F.col(quote(x)).isNotNull() & F.col(quote(y)).isNotNull()).select(F.col(quote(x)).alias("x"), F.col(quote(y)).alias("y"))
    if method == "kendall":
        return _kendall(df, alternative)
    if method == "spearman":
        return _spearman(df, alternative)
    r, n = df.agg(F.corr("x", "y"), F.count(F.lit(1))).first()
    t = r * math.sqrt((n - 2) / max(1 - r * r, 1e-300))
    p = _tails(s.pt(t, n - 2), alternative, s.pt_upper(t, n - 2))
    ci = None
    if n > 3:
        z, reach = math.atanh(r), s.qnorm((1 + conf_level) / 2 if alternative == "two.sided" else conf_level) / math.sqrt(n - 3)
        ci = {"two.sided": (math.tanh(z - reach), math.tanh(z + reach)), "less": (-1.0, math.tanh(z + reach)), "greater": (math.tanh(z - reach), 1.0)}[alternative]
    return HTest("Pearson's product-moment correlation", t, n - 2, p, {"cor": r}, ci, alternative)


def _spearman(df, alternative: str) -> HTest:
    """Pearson's correlation of average ranks, by sums over the different pairs of values; each column's ranks are joined to them once."""
    cells = df.groupBy("x", "y").agg(F.count(F.lit(1)).alias("c"))
    rx, ry = (value_ranks(df, c).select(F.col("__v").alias(f"v{c}"), F.col("__r").alias(f"r{c}")) for c in ("x", "y"))
    ranked = cells.join(rx, F.col("x") == F.col("vx")).join(ry, F.col("y") == F.col("vy"))
    c, a, b = (F.col(k).cast("double") for k in ("c", "rx", "ry"))
    n = df.count()
    mid = (n + 1) / 2  # the mean of either column's ranks
    xy, xx, yy = ranked.agg(F.sum(c * (a - mid) * (b - mid)), F.sum(c * (a - mid) ** 2), F.sum(c * (b - mid) ** 2)).first()
    r = xy / math.sqrt(xx * yy)
    t = r * math.sqrt((n - 2) / max(1 - r * r, 1e-300))
    return HTest("Spearman's rank correlation rho", (n**3 - n) * (1 - r) / 6, None, _tails(s.pt(t, n - 2), alternative, s.pt_upper(t, n - 2)), {"rho": r}, None, alternative)


def _kendall(df, alternative: str) -> HTest:
    """tau-b, from the counts of tied and of discordant pairs."""
    cells = cut(df.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")))
    pairs = lambda rows: rows.agg(F.sum(F.col("n").cast("double") * (F.col("n") - 1) / 2)).first()[0] or 0.0
    tx, ty = (pairs(cells.groupBy(c).agg(F.sum("n").alias("n"))) for c in ("x", "y"))
    n = cells.agg(F.sum("n")).first()[0] or 0
    n0 = n * (n - 1) / 2
    score = n0 - tx - ty + pairs(cells) - 2 * discordant(cells)  # pairs tied in both were taken off twice
    tau = score / math.sqrt((n0 - tx) * (n0 - ty)) if min(n0 - tx, n0 - ty) > 0 else math.nan
    z = 3 * score / math.sqrt(n * (n - 1) * (2 * n + 5) / 2) if n > 1 else math.nan
    return HTest("Kendall's rank correlation tau", z, None, _tails(s.pnorm(z), alternative, s.pnorm(-z)), {"tau": tau}, None, alternative)


def average_ranks(df, column: str, name: str, by: tuple[str, ...] = ()):
    """df with average ranks from 1.

    Different values are counted first, and their running counts are taken
    over range partitions, so that no task sorts all rows.
    """
    if by:
        w = Window.partitionBy(*map(quote, by))
        return df.withColumn(name, F.rank().over(w.orderBy(quote(column))) + (F.count(F.lit(1)).over(Window.partitionBy(*map(quote, by), quote(column))) - 1) / 2)
    placed = value_ranks(df, column)
    return df.join(placed, F.col(quote(column)) == F.col("__v")).withColumnRenamed("__r", name).drop("__v")


def value_ranks(df, column: str):
    """(__v, __r): the average rank, from 1, of each different value."""
    counts = df.where(F.col(quote(column)).isNotNull()).groupBy(F.col(quote(column)).alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    summed = running_sums(counts, ["__c"], F.col("__v"))
    return summed.select("__v", (F.col("__before___c") + (F.col("__c") + 1) / 2).alias("__r"))


def _tie_sum(df, column: str) -> float:
    return float(df.groupBy(quote(column)).count().agg(F.sum(F.pow("count", F.lit(3)) - F.col("count"))).first()[0] or 0.0)


def wilcox_test(frame: Frame, x: str, y: str | None = None, group: str | None = None, paired: bool = False, mu: float = 0.0, alternative: str = "two.sided", correct: bool = True) -> HTest:
    """Signed ranks of one column (or of differences), or rank sums of two; normal approximation with ties."""
    if group is None and (y is None or paired):
        d = frame.df.select(((F.col(quote(x)) - F.col(quote(y))) if y else F.col(quote(x)) - mu).alias("d")).where("d <> 0").withColumn("a", F.abs("d"))
        ranked = average_ranks(d, "a", "r")
        n, v = ranked.agg(F.count(F.lit(1)), F.sum(F.when(F.col("d") > 0, F.col("r")).otherwise(0.0))).first()
        mean, var = n * (n + 1) / 4, n * (n + 1) * (2 * n + 1) / 24 - _tie_sum(d, "a") / 48
        stat, method = v, "Wilcoxon signed rank test"
    else:
        if group is None:
            both = frame.df.select(F.col(quote(x)).alias("v"), F.lit(0).alias("g")).union(frame.df.select(quote(y), F.lit(1))).where("v is not null")
        else:
            known = frame.df.where(F.col(quote(group)).isNotNull() & F.col(quote(x)).isNotNull())
            levels = [r[0] for r in known.select(quote(group)).distinct().orderBy(quote(group)).limit(3).collect()]
            if len(levels) != 2:
                raise ValueError("the group must have two values")
            both = known.select(F.col(quote(x)).alias("v"), (F.col(quote(group)) == F.lit(levels[1])).cast("int").alias("g"))
        ranked = average_ranks(both, "v", "r")
        n1, n2, w = ranked.agg(F.count_if(F.col("g") == 0), F.count_if(F.col("g") == 1), F.sum(F.when(F.col("g") == 0, F.col("r")))).first()
        stat = w - n1 * (n1 + 1) / 2
        n = n1 + n2
        mean, var, method = n1 * n2 / 2, n1 * n2 / 12 * (n + 1 - _tie_sum(both, "v") / (n * (n - 1))), "Wilcoxon rank sum test"
    shift = 0.0
    if correct:
        shift = {"two.sided": math.copysign(0.5, stat - mean) if stat != mean else 0.0, "greater": 0.5, "less": -0.5}[alternative]
    z = (stat - mean - shift) / math.sqrt(var)
    return HTest(method, stat, None, _tails(s.pnorm(z), alternative, s.pnorm(-z)), {}, None, alternative)


def kruskal_test(frame: Frame, y: str, group: str) -> HTest:
    df = frame.df.where(F.col(quote(y)).isNotNull() & F.col(quote(group)).isNotNull())
    ranked = average_ranks(df, y, "__r")
    k, n, total = ranked.groupBy(quote(group)).agg(F.sum("__r").alias("r"), F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)), F.sum("n"), F.sum(F.col("r") ** 2 / F.col("n"))).first()
    h = (12 / (n * (n + 1)) * total - 3 * (n + 1)) / (1 - _tie_sum(df, y) / (n**3 - n))
    return HTest("Kruskal-Wallis rank sum test", h, k - 1, s.pchisq_upper(h, k - 1))


def friedman_test(frame: Frame, y: str, group: str, block: str) -> HTest:
    ranked = average_ranks(frame.df, y, "__r", (block,))
    sums = ranked.groupBy(quote(group)).agg(F.sum("__r").alias("r")).agg(F.count(F.lit(1)), F.sum(F.col("r") ** 2), F.sum("r")).first()
    b = frame.df.select(quote(block)).distinct().count()
    ties = ranked.groupBy(quote(block), "__r").count().agg(F.sum(F.pow("count", F.lit(3)) - F.col("count"))).first()[0]
    k = sums[0]
    stat = 12 * (sums[1] - k * (b * (k + 1) / 2) ** 2) / (b * k * (k + 1) - ties / (k - 1))
    return HTest("Friedman rank sum test", stat, k - 1, s.pchisq_upper(stat, k - 1))


def _cells(frame: Frame, x: str, y: str) -> tuple[list, list, dict]:
    rows = frame.df.where(F.col(quote(x)).isNotNull() & F.col(quote(y)).isNotNull()).groupBy(quote(x), quote(y)).count().limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("more than 100000 cells")
    return sorted({r[0] for r in rows}, key=str), sorted({r[1] for r in rows}, key=str), {(r[0], r[1]): r[2] for r in rows}


def chisq_test(frame: Frame, x: str, y: str | None = None, p: list[float] | None = None, correct: bool = True) -> HTest:
    """Goodness of fit of one column, or independence of two (with Yates' correction for 2 x 2)."""
    if y is None:
        counts = [r[1] for r in frame.df.where(F.col(quote(x)).isNotNull()).groupBy(quote(x)).count().orderBy(quote(x)).limit(100_001).collect()]
        if len(counts) > 100_000:
            raise ValueError("more than 100000 cells")
        n = sum(counts)
        expected = [n / len(counts)] * len(counts) if p is None else [n * q for q in p]
        stat = sum((o - e) ** 2 / e for o, e in zip(counts, expected, strict=True))
        return HTest("Chi-squared test for given probabilities", stat, len(counts) - 1, s.pchisq_upper(stat, len(counts) - 1))
    xs, ys, cells = _cells(frame, x, y)
    rows, cols = {a: sum(cells.get((a, b), 0) for b in ys) for a in xs}, {b: sum(cells.get((a, b), 0) for a in xs) for b in ys}
    n = sum(rows.values())
    diffs = [(abs(cells.get((a, b), 0) - rows[a] * cols[b] / n), rows[a] * cols[b] / n) for a in xs for b in ys]
    yates = min(0.5, min(d for d, _ in diffs)) if correct and len(xs) == len(ys) == 2 else 0.0
    stat, df = sum((d - yates) ** 2 / e for d, e in diffs), (len(xs) - 1) * (len(ys) - 1)
    return HTest("Pearson's Chi-squared test", stat, df, s.pchisq_upper(stat, df))


def fisher_test(frame: Frame, x: str, y: str, alternative: str = "two.sided") -> HTest:
    """Exact test of a 2 x 2 table."""
    xs, ys, cells = _cells(frame, x, y)
    if len(xs) != 2 or len(ys) != 2:
        raise ValueError("the table must be 2 x 2")
    a, b, c, d = (cells.get((u, v), 0) for u in xs for v in ys)
    row, col, n = a + b, a + c, a + b + c + d
    log = lambda k: math.lgamma(row + 1) - math.lgamma(k + 1) - math.lgamma(row - k + 1) + math.lgamma(n - row + 1) - math.lgamma(col - k + 1) - math.lgamma(n - row - col + k + 1) - math.lgamma(n + 1) + math.lgamma(col + 1) + math.lgamma(n - col + 1)
    support = range(max(0, col + row - n), min(row, col) + 1)
    prob = {k: math.exp(log(k)) for k in support}
    p = sum(v for k, v in prob.items() if {"less": k <= a, "greater": k >= a, "two.sided": v <= prob[a] * (1 + 1e-7)}[alternative])
    return HTest("Fisher's Exact Test for Count Data", a, None, min(1.0, p), {"odds ratio": a * d / (b * c) if b * c else math.inf}, None, alternative)


def mcnemar_test(frame: Frame, x: str, y: str, correct: bool = True) -> HTest:
    xs, ys, cells = _cells(frame, x, y)
    levels = sorted({*xs, *ys}, key=str)
    if len(levels) != 2:
        raise ValueError("the table must be 2 x 2")
    b, c = cells.get((levels[0], levels[1]), 0), cells.get((levels[1], levels[0]), 0)
    stat = (max(abs(b - c) - (1 if correct else 0), 0)) ** 2 / (b + c)
    return HTest("McNemar's Chi-squared test", stat, 1, s.pchisq_upper(stat, 1))


def binom_test(x: int, n: int, p: float = 0.5, alternative: str = "two.sided", conf_level: float = 0.95) -> HTest:
    """Exact test of a share, with Clopper-Pearson limits."""
    from ..functions.distributions import _binomial, binomial_cdf

    if alternative == "two.sided":
        own = _binomial(x, n, p) * (1 + 1e-7)
        value = min(1.0, sum(q for k in range(n + 1) if (q := _binomial(k, n, p)) <= own)) if n <= 100_000 else _tails(binomial_cdf(x, n, p), alternative, 1 - binomial_cdf(x - 1, n, p))
    else:
        value = binomial_cdf(x, n, p) if alternative == "less" else 1 - binomial_cdf(x - 1, n, p)
    a = (1 - conf_level) / 2 if alternative == "two.sided" else 1 - conf_level
    low = 0.0 if x == 0 or alternative == "less" else s.qbeta(a, x, n - x + 1)
    high = 1.0 if x == n or alternative == "greater" else s.qbeta(1 - a, x + 1, n - x)
    return HTest("Exact binomial test", x, n, value, {"probability of success": x / n}, (low, high), alternative)


def prop_test(x: list[int], n: list[int], p: float | None = None, alternative: str = "two.sided", conf_level: float = 0.95, correct: bool = True) -> HTest:
    """One share against p, or several against each other."""
    k, share = len(x), [a / b for a, b in zip(x, n, strict=True)]
    if k == 1:
        p = 0.5 if p is None else p
        yates = min(0.5, abs(x[0] - n[0] * p)) if correct else 0.0
        stat = (abs(x[0] - n[0] * p) - yates) ** 2 / (n[0] * p * (1 - p))
        z = math.copysign(math.sqrt(stat), share[0] - p)
        q = s.qnorm((1 + conf_level) / 2 if alternative == "two.sided" else conf_level)
        yc = min(0.5, abs(x[0] - n[0] * p)) if correct else 0.0
        q2 = q * q / (2 * n[0])
        up, down = share[0] + yc / n[0], share[0] - yc / n[0]
        hi = (up + q2 + q * math.sqrt(up * (1 - up) / n[0] + q2 / (2 * n[0]))) / (1 + 2 * q2)
        lo = (down + q2 - q * math.sqrt(down * (1 - down) / n[0] + q2 / (2 * n[0]))) / (1 + 2 * q2)
        ci = {"two.sided": (max(lo, 0), min(hi, 1)), "less": (0.0, min(hi, 1)), "greater": (max(lo, 0), 1.0)}[alternative]
        value = s.pchisq_upper(stat, 1) if alternative == "two.sided" else _tails(s.pnorm(z), alternative, s.pnorm(-z))
        return HTest("1-sample proportions test", stat, 1, value, {"p": share[0]}, ci, alternative)
    pooled = sum(x) / sum(n)
    yates = min(0.5, abs(share[0] - share[1]) / (1 / n[0] + 1 / n[1])) if correct and k == 2 else 0.0
    stat = sum((abs(a - b * pooled) - yates) ** 2 / (b * pooled) + (abs((b - a) - b * (1 - pooled)) - yates) ** 2 / (b * (1 - pooled)) for a, b in zip(x, n, strict=True))
    z = math.copysign(math.sqrt(stat), share[0] - share[1])
    value = s.pchisq_upper(stat, k - 1) if k > 2 or alternative == "two.sided" else _tails(s.pnorm(z), alternative, s.pnorm(-z))
    return HTest(f"{k}-sample test for equality of proportions", stat, k - 1, value, {f"prop {i + 1}": v for i, v in enumerate(share)}, None, alternative)


def ks_test(frame: Frame, x: str, y: str) -> HTest:
    """Largest distance of two samples' distribution functions."""
    both = frame.df.select(F.col(quote(x)).alias("v"), F.lit(1).alias("a"), F.lit(0).alias("b")).union(frame.df.select(quote(y), F.lit(0), F.lit(1))).where("v is not null")
    cells = both.groupBy("v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    n1, n2 = cells.agg(F.sum("a"), F.sum("b")).first()
    summed = running_sums(cells, ["a", "b"], F.col("v"))
    d = summed.agg(F.max(F.abs((F.col("a") + F.col("__before_a")) / n1 - (F.col("b") + F.col("__before_b")) / n2))).first()[0]
    scale = d * math.sqrt(n1 * n2 / (n1 + n2))
    p = 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * scale * scale) for k in range(1, 101)) if scale > 0.2 else 1.0
    return HTest("Asymptotic two-sample Kolmogorov-Smirnov test", d, None, min(1.0, max(0.0, p)))


def shapiro_test(frame: Frame, x: str) -> HTest:
    """Shapiro-Wilk for 12 to 5000 values by Royston's approximation; the values, bounded so, come to the driver."""
    values = sorted(r[0] for r in frame.df.where(F.col(quote(x)).isNotNull()).select(F.col(quote(x)).cast("double")).limit(5001).collect())
    n = len(values)
    if not 12 <= n <= 5000:
        raise ValueError("between 12 and 5000 values")
    m = [s.qnorm((i + 1 - 0.375) / (n + 0.25)) for i in range(n)]
    mm, u = sum(v * v for v in m), 1 / math.sqrt(n)
    last = m[-1] / math.sqrt(mm) + 0.221157 * u - 0.147981 * u**2 - 2.071190 * u**3 + 4.434685 * u**4 - 2.706056 * u**5
    second = m[-2] / math.sqrt(mm) + 0.042981 * u - 0.293762 * u**2 - 1.752461 * u**3 + 5.682633 * u**4 - 3.582633 * u**5
    phi = (mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
    a = [v / math.sqrt(phi) for v in m]
    a[0], a[1], a[-2], a[-1] = -last, -second, second, last
    mean = sum(values) / n
    w = sum(c * v for c, v in zip(a, values, strict=True)) ** 2 / sum((v - mean) ** 2 for v in values)
    k = math.log(n)
    mu, sd = 0.0038915 * k**3 - 0.083751 * k**2 - 0.31082 * k - 1.5861, math.exp(0.0030302 * k**2 - 0.082676 * k - 0.4803)
    return HTest("Shapiro-Wilk normality test", w, None, s.pnorm(-(math.log(1 - w) - mu) / sd))
