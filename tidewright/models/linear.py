"""Linear and generalised linear models from sums of products.

A fit never collects rows: one aggregate gives the Gramian of the design, the
response and the weights, and the rest is algebra on matrices of the number of
columns.  Fitted values, residuals and influence are expressions over the
model's frame.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import quote
from ..operators.frame import Frame
from . import special
from .formula import Design, Formula, design, parse, sql_of

#: Relative size below which a pivot counts as zero: the column is a sum of earlier ones.
TOLERANCE = 1e-9


def gramian(df: DataFrame, columns: Sequence[Column], weight: Column | None = None) -> np.ndarray:
    """Sums of products of all pairs of columns, in one aggregate of partial sums."""
    return gramian_and_sums(df, columns, weight, ())[0]


def gramian_and_sums(df: DataFrame, columns: Sequence[Column], weight: Column | None, more: Sequence[Column]) -> tuple[np.ndarray, list]:
    """The Gramian and the sums of further columns, in one pass."""
    k = len(columns)
    named = df.select(*[c.alias(f"x{i}") for i, c in enumerate(columns)], (F.lit(1.0) if weight is None else weight).alias("w"), *[c.alias(f"m{i}") for i, c in enumerate(more)])
    sums = [F.sum(F.col(f"x{i}") * F.col(f"x{j}") * F.col("w")) for i in range(k) for j in range(i, k)]
    values = list(named.agg(*sums, *[F.sum(f"m{i}") for i in range(len(more))]).first())
    out = np.zeros((k, k))
    at = 0
    for i in range(k):
        for j in range(i, k):
            out[i, j] = out[j, i] = values[at] or 0.0
            at += 1
    return out, values[at:]


def independent(g: np.ndarray, tolerance: float = TOLERANCE) -> list[int]:
    """Columns, from the left, that are no sums of earlier ones."""
    a, kept = g.astype(float).copy(), []
    scale = np.diag(g).copy()
    for j in range(len(g)):
        if a[j, j] > tolerance * max(scale[j], 1e-300):
            kept.append(j)
            a = a - np.outer(a[:, j], a[j, :]) / a[j, j]
    return kept


@dataclass
class Fit:
    """Coefficients and the matrices that the generics need."""

    names: list[str]
    beta: np.ndarray
    inverse: np.ndarray  # of X'WX
    kept: list[int]
    rss: float


def solve_gramian(g: np.ndarray, p: int) -> tuple[list[int], np.ndarray, np.ndarray, float]:
    """From the Gramian of (X, y): kept columns, coefficients, inverse and residual sum of squares."""
    kept = independent(g[:p, :p])
    xx, xy = g[np.ix_(kept, kept)], g[kept, p]
    scale = 1 / np.sqrt(np.diag(xx))
    inverse = np.linalg.inv(xx * np.outer(scale, scale)) * np.outer(scale, scale)
    beta = inverse @ xy
    beta = beta + inverse @ (xy - xx @ beta)  # one refinement
    return kept, beta, inverse, max(0.0, float(g[p, p] - beta @ xy))


class lm:  # noqa: N801
    """Least squares: ``lm("y ~ a + b", frame)``, weighted by a column's name or expression text."""

    def __init__(self, formula: str, data: Frame | DataFrame, weights: str | None = None, method: str = "qr", contrasts: dict[str, str] | None = None):
        df = data.df if isinstance(data, Frame) else data
        self.source, self.text, self.weights, self.contrasts = df, formula, weights, contrasts or {}
        self.formula: Formula = parse(formula, df.columns)
        self.design: Design = design(self.formula, df, self.contrasts)
        self.y = F.expr(sql_of(self.formula.response)).cast("double")
        self.offset = sum((F.expr(sql_of(o)).cast("double") for o in self.formula.offsets), F.lit(0.0))
        self.w = F.expr(sql_of(weights)).cast("double") if weights else F.lit(1.0)
        complete = self.y.isNotNull() & self.w.isNotNull()
        for c in self.design.needs:
            complete = complete & F.col(quote(c)).isNotNull()
        self.data = df.where(complete)
        self._fit()

    def _fit(self) -> None:
        p = len(self.design.columns)
        # centred on the first pass's means, so that large means cost no digits
        y = self.y - self.offset
        means = [0.0] * p
        center = 0.0
        if self.formula.intercept:
            row = self.data.agg(F.count(F.lit(1)), *[F.avg(c) for c in [*self.design.columns, y]]).first()
            means, center = [0.0, *[m or 0.0 for m in row[2 : p + 1]]], row[p + 1] or 0.0
        columns = [c - F.lit(float(m)) if m else c for c, m in zip(self.design.columns, means, strict=True)]
        extra = [F.lit(1.0)] if not self.formula.intercept else []
        g = gramian(self.data, [*columns, y - F.lit(float(center)), *extra], self.w)
        n = self.data.agg(F.count(F.lit(1)), F.sum(F.when(self.w > 0, F.ln(self.w)).otherwise(0.0))).first()
        self.n, self._log_weights = int(n[0]), float(n[1] or 0.0)
        self.gram = g
        kept, beta, inverse, rss = solve_gramian(g, p)
        self.kept, self.rss = kept, rss
        self.names = [self.design.names[j] for j in kept]
        self.columns = [self.design.columns[j] for j in kept]
        self.assign = [self.design.assign[j] for j in kept]
        shift = np.eye(len(kept))
        if self.formula.intercept:
            shift[0, 1:] = [-means[j] for j in kept[1:]]
            beta = shift @ beta
            beta[0] += center
            inverse = shift @ inverse @ shift.T
        self.beta, self.inverse = beta, inverse
        self.rank = len(kept)
        self.df_residual = self.n - self.rank
        self.sigma2 = rss / self.df_residual if self.df_residual > 0 else math.nan
        total = g[p, p]
        if self.formula.intercept:
            total = float(g[p, p] - g[0, p] ** 2 / g[0, 0])
        self.tss = total
        k = int(self.formula.intercept)
        self.r_squared = 1 - rss / total if total > 0 else math.nan
        self.adj_r_squared = 1 - (1 - self.r_squared) * (self.n - k) / self.df_residual if self.df_residual > 0 else math.nan
        self.f = ((total - rss) / (self.rank - k)) / self.sigma2 if self.rank > k and self.sigma2 else math.nan
        self.dispersion = self.sigma2

    # ------------------------------------------------------------ tables
    @property
    def vcov(self) -> np.ndarray:
        return self.inverse * self.dispersion

    def coefficients(self) -> dict[str, float]:
        return dict(zip(self.names, self.beta.tolist(), strict=True))

    def _p(self, t: float) -> float:
        return 2 * special.pt_upper(abs(t), self.df_residual)

    def coef_table(self) -> list[dict[str, float | str]]:
        se = np.sqrt(np.diag(self.vcov))
        return [{"term": n, "estimate": b, "std_error": s, "statistic": b / s, "p_value": self._p(b / s)} for n, b, s in zip(self.names, self.beta.tolist(), se.tolist(), strict=True)]

    def confint(self, level: float = 0.95) -> dict[str, tuple[float, float]]:
        t = special.qt((1 + level) / 2, self.df_residual)
        return {r["term"]: (r["estimate"] - t * r["std_error"], r["estimate"] + t * r["std_error"]) for r in self.coef_table()}

    def log_likelihood(self) -> float:
        return 0.5 * (self._log_weights - self.n * (math.log(2 * math.pi) + 1 + math.log(self.rss / self.n)))

    def AIC(self, k: float = 2.0) -> float:  # noqa: N802
        return -2 * self.log_likelihood() + k * (self.rank + 1)

    def BIC(self) -> float:  # noqa: N802
        return self.AIC(math.log(self.n))

    def extract_aic(self, k: float = 2.0) -> float:
        return self.n * math.log(self.rss / self.n) + k * self.rank

    def deviance(self) -> float:
        return self.rss

    # ------------------------------------------------------------ rows
    def eta(self, columns: Sequence[Column] | None = None) -> Column:
        columns = self.columns if columns is None else columns
        out = self.offset
        for b, c in zip(self.beta.tolist(), columns, strict=True):
            out = out + F.lit(b) * c
        return out

    def fitted_column(self) -> Column:
        return self.eta()

    def working_weight(self) -> Column:
        return self.w

    def hat_column(self, columns: Sequence[Column] | None = None, weighted: bool = True) -> Column:
        """Leverage, with the inverse Gramian as constants."""
        columns = self.columns if columns is None else columns
        total = F.lit(0.0)
        for i, a in enumerate(columns):
            for j in range(i, len(columns)):
                total = total + F.lit(float(self.inverse[i, j] * (1 if i == j else 2))) * a * columns[j]
        return total * self.working_weight() if weighted else total

    def residual_column(self, type: str = "response") -> Column:  # noqa: A002
        raw = self.y - self.fitted_column()
        return raw if type in ("response", "working") else raw * F.sqrt(self.w)

    def augment(self) -> Frame:
        """The model's rows with fitted values, residuals and influence."""
        base = self.data.withColumn(".fitted", self.fitted_column()).withColumn(".resid", self.residual_column()).withColumn(".hat", self.hat_column())
        p, s2 = self.rank, self.dispersion
        e = self.residual_column("pearson")
        hat = F.col("`.hat`")
        base = base.withColumn(".std_resid", e / F.sqrt(F.lit(s2) * (1 - hat)))
        base = base.withColumn(".cooksd", F.col("`.std_resid`") ** 2 * hat / (p * (1 - hat)))
        sigma = F.sqrt((F.lit(s2 * self.df_residual) - e * e / (1 - hat)) / (self.df_residual - 1))
        base = base.withColumn(".sigma", sigma).withColumn(".student_resid", e / (F.col("`.sigma`") * F.sqrt(1 - hat)))
        return Frame(base.withColumn(".dffits", F.col("`.student_resid`") * F.sqrt(hat / (1 - hat))))

    def dfbetas(self) -> Frame:
        """Scaled changes of each coefficient when a row is left out."""
        df = self.augment().df
        out = []
        for k, name in enumerate(self.names):
            row = F.lit(0.0)
            for j, c in enumerate(self.columns):
                row = row + F.lit(float(self.inverse[k, j])) * c
            change = row * self.working_weight() * F.col("`.resid`") / (1 - F.col("`.hat`"))
            out.append((change / (F.col("`.sigma`") * math.sqrt(self.inverse[k, k]))).alias(name))
        return Frame(df.select(*out))

    def _new_columns(self, newdata: DataFrame) -> tuple[DataFrame, list[Column]]:
        d = design(self.formula, newdata, self.contrasts, self.design.factors)
        return newdata, [d.columns[j] for j in self.kept]

    def predict(self, newdata: Frame | DataFrame | None = None, interval: str | None = None, level: float = 0.95) -> Frame:
        """fit, and with an interval ("confidence" or "prediction") lwr and upr."""
        df = self.data if newdata is None else newdata.df if isinstance(newdata, Frame) else newdata
        df, columns = self._new_columns(df)
        out = df.withColumn("fit", self.eta(columns))
        if interval:
            variance = self.hat_column(columns, weighted=False) + (1.0 if interval == "prediction" else 0.0)
            reach = F.sqrt(variance * self.sigma2) * special.qt((1 + level) / 2, self.df_residual)
            out = out.withColumn("lwr", F.col("fit") - reach).withColumn("upr", F.col("fit") + reach)
        return Frame(out)

    def model_matrix(self) -> Frame:
        return Frame(self.data.select(*[c.alias(n) for n, c in zip(self.names, self.columns, strict=True)]))

    def update(self, formula: str | None = None, **changes) -> lm:
        """The same model with a changed formula, in which dots stand for what was there."""
        text = self.text if formula is None else _updated(self.text, formula)
        args = {"data": self.source, "weights": self.weights, "contrasts": self.contrasts} | changes
        return type(self)(text, **args)

    def __repr__(self) -> str:
        rows = [f"{r['term']:<24}{r['estimate']:>14.6g}{r['std_error']:>14.6g}{r['statistic']:>10.3f}{r['p_value']:>12.3g}" for r in self.coef_table()]
        return "\n".join([self.text, f"{'':<24}{'estimate':>14}{'std error':>14}{'stat':>10}{'p':>12}", *rows])


def _updated(old: str, new: str) -> str:
    left, _, right = old.partition("~")
    a, tilde, b = new.partition("~")
    if not tilde:
        a, b = ".", new
    a = left.strip() if a.strip() == "." or not a.strip() else a.strip()
    return f"{a} ~ {re.sub(r'(?<![\w.])[.](?![\w.])', '(' + right.strip() + ')', b.strip())}".replace("()", "1")


# ---------------------------------------------------------------- families
@dataclass
class Family:
    """A family as expressions: link, its inverse and derivative, variance, unit deviance."""

    name: str
    link: str
    start: Callable[[Column, Column], Column]
    linkfun: Callable[[Column], Column]
    linkinv: Callable[[Column], Column]
    mu_eta: Callable[[Column], Column]
    variance: Callable[[Column], Column]
    dev: Callable[[Column, Column], Column]
    known_scale: bool = False


def _normal_density(z: Column) -> Column:
    return F.exp(-z * z / 2) / math.sqrt(2 * math.pi)


def _one_over(x: Column) -> Column:
    return F.when(x == 0, F.lit(math.inf)).otherwise(F.try_divide(F.lit(1.0), x))


_LINKS: dict[str, tuple] = {
    "identity": (lambda m: m, lambda e: e, lambda e: F.lit(1.0)),
    "log": (F.ln, F.exp, F.exp),
    "logit": (lambda m: F.ln(m / (1 - m)), lambda e: 1 / (1 + F.exp(-e)), lambda e: F.exp(-F.abs(e)) / (1 + F.exp(-F.abs(e))) ** 2),
    "inverse": (_one_over, _one_over, lambda e: -_one_over(e * e)),
    "1/mu^2": (lambda m: _one_over(m * m), lambda e: _one_over(F.sqrt(e)), lambda e: -_one_over(2 * F.pow(e, F.lit(1.5)))),
    "sqrt": (F.sqrt, lambda e: e * e, lambda e: 2 * e),
    "cloglog": (lambda m: F.ln(-F.ln(1 - m)), lambda e: -F.expm1(-F.exp(e)), lambda e: F.exp(e - F.exp(e))),
    "cauchit": (lambda m: F.tan(math.pi * (m - 0.5)), lambda e: F.atan(e) / math.pi + 0.5, lambda e: 1 / (math.pi * (1 + e * e))),
}


def _ylogy(y: Column, m: Column) -> Column:
    return F.when(y > 0, y * F.ln(F.greatest(y, F.lit(1e-300)) / m)).otherwise(0.0)


def _family(name: str, default: str, start, variance, dev, known: bool):
    def make(link: str = default) -> Family:
        f, inv, slope = _LINKS[link]
        return Family(name, link, start, f, inv, slope, variance, dev, known)

    return make


gaussian = _family("gaussian", "identity", lambda y, w: y, lambda m: F.lit(1.0), lambda y, m: (y - m) ** 2, False)
poisson = _family("poisson", "log", lambda y, w: y + 0.1, lambda m: m, lambda y, m: 2 * (_ylogy(y, m) - (y - m)), True)
binomial = _family("binomial", "logit", lambda y, w: (w * y + 0.5) / (w + 1), lambda m: m * (1 - m), lambda y, m: 2 * (_ylogy(y, m) + _ylogy(1 - y, 1 - m)), True)
Gamma = _family("Gamma", "inverse", lambda y, w: y, lambda m: m * m, lambda y, m: -2 * (F.ln(y / m) - (y - m) / m), False)
inverse_gaussian = _family("inverse.gaussian", "1/mu^2", lambda y, w: y, lambda m: m**3, lambda y, m: (y - m) ** 2 / (y * m * m), False)


def quasi(base: Family) -> Family:
    """A family with its dispersion estimated."""
    return Family(f"quasi{base.name}", base.link, base.start, base.linkfun, base.linkinv, base.mu_eta, base.variance, base.dev, False)


def tweedie(power: float = 1.5, link: str = "log") -> Family:
    f, inv, slope = _LINKS[link]
    p = power
    dev = lambda y, m: 2 * (F.when(y > 0, F.pow(y, F.lit(2 - p)) / ((1 - p) * (2 - p))).otherwise(0.0) - y * F.pow(m, F.lit(1 - p)) / (1 - p) + F.pow(m, F.lit(2 - p)) / (2 - p))
    return Family("tweedie", link, lambda y, w: y + 0.1, f, inv, slope, lambda m: F.pow(m, F.lit(p)), dev, False)


class glm(lm):  # noqa: N801
    """Iteratively reweighted least squares, one aggregate over the rows for each step."""

    def __init__(self, formula: str, data: Frame | DataFrame, family: Family | None = None, weights: str | None = None, offset: str | None = None,
                 contrasts: dict[str, str] | None = None, maxit: int = 25, epsilon: float = 1e-8):
        self.family = family or gaussian()
        self.maxit, self.epsilon, self.offset_text = maxit, epsilon, offset
        counts = re.fullmatch(r"\s*cbind\(([^,]+),([^)]+)\)\s*", formula.partition("~")[0])
        self._counts = counts
        text = formula if not counts else f"{counts[1]}/({counts[1]}+{counts[2]})~{formula.partition('~')[2]}"
        if counts:
            total = f"(({counts[1]})+({counts[2]}))"
            weights = total if weights is None else f"({weights})*{total}"
        if offset:
            text += f" + offset({offset})"
        self._own = formula
        super().__init__(text, data, weights, contrasts=contrasts)
        self.text = formula

    def _fit(self) -> None:
        p, fam = len(self.design.columns), self.family
        # inputs once in columns of their own
        rows = self.data.select(*[c.cast("double").alias(f"x{i}") for i, c in enumerate(self.design.columns)], self.y.alias("y"), self.w.alias("w"), self.offset.cast("double").alias("o")).persist()
        x = [F.col(f"x{i}") for i in range(p)]
        try:
            first = rows.agg(F.count(F.lit(1)), F.sum(F.col("w") * F.col("y")) / F.sum("w"), F.sum("w")).first()
            self.n, mean = int(first[0]), float(first[1])
            mu = fam.start(F.col("y"), F.col("w"))
            eta = fam.linkfun(mu)

            def pass_at(eta: Column, mu: Column) -> tuple[np.ndarray, float | None]:
                """The working model's Gramian and the deviance, from one pass over the rows."""
                slope = fam.mu_eta(eta)
                z = eta - F.col("o") + (F.col("y") - mu) / slope
                working = F.col("w") * slope * slope / fam.variance(mu)
                g, (deviance,) = gramian_and_sums(rows, [*x, z], working, [F.col("w") * fam.dev(F.col("y"), mu)])
                return g, deviance

            last, beta, kept, inverse = math.inf, None, None, None
            self.converged = False
            g, _ = pass_at(eta, mu)
            for step in range(1, self.maxit + 1):  # noqa: B007
                kept, new, inverse, _ = solve_gramian(g, p)
                for _ in range(20):  # halve a step that leaves the family's range or worsens the deviance
                    eta = F.col("o")
                    for b, j in zip(new.tolist(), kept, strict=True):
                        eta = eta + F.lit(b) * x[j]
                    mu = fam.linkinv(eta)
                    g, deviance = pass_at(eta, mu)
                    if deviance is not None and math.isfinite(deviance) and (beta is None or deviance <= last + 1e-7 * (abs(last) + 0.1)):
                        break
                    if beta is None or len(beta) != len(new):
                        break
                    new = (new + beta) / 2
                beta = new
                if deviance is not None and abs(deviance - last) / (abs(deviance) + 0.1) < self.epsilon:
                    self.converged = True
                    last = deviance
                    break
                last = deviance
            self.iterations, self.beta, self.inverse, self.kept = step, beta, inverse, kept
            self.names = [self.design.names[j] for j in kept]
            self.columns = [self.design.columns[j] for j in kept]
            self.assign = [self.design.assign[j] for j in kept]
            self.rank, self.df_residual = len(kept), self.n - len(kept)
            base = mean if self.formula.intercept else None
            null_mu = F.lit(base) if base is not None else fam.linkinv(F.col("o"))
            pearson = rows.agg(
                F.sum(F.col("w") * (F.col("y") - mu) ** 2 / fam.variance(mu)), F.sum(_aic_term(fam, mu)), F.sum(F.ln("w")), F.sum(F.col("w") * fam.dev(F.col("y"), null_mu))
            ).first()
            self.rss = self._deviance = float(last)
            self.pearson = float(pearson[0])
            self.dispersion = 1.0 if fam.known_scale else self.pearson / self.df_residual if self.df_residual else math.nan
            self.sigma2 = self.dispersion
            self._aic_sum, self._log_weights, self._sum_weights = pearson[1], float(pearson[2] or 0.0), float(first[2])
            null = pearson[3]
            self.null_deviance = math.inf if null is None else float(null)  # a mean of infinity, where a link has no other
            if self.formula.offsets and self.formula.intercept and self.formula.terms:
                only = " + ".join(["1", *(f"offset({o})" for o in self.formula.offsets)])
                self.null_deviance = glm(f"{self.formula.response} ~ {only}", self.data, fam, self.weights).deviance()
        finally:
            rows.unpersist()

    def _p(self, t: float) -> float:
        return 2 * special.pnorm(-abs(t)) if self.family.known_scale else 2 * special.pt_upper(abs(t), self.df_residual)

    def deviance(self) -> float:
        return self._deviance

    def log_likelihood(self) -> float:
        k = self.rank + (0 if self.family.known_scale else 1)
        return k - self.AIC() / 2

    def AIC(self, k: float = 2.0) -> float:  # noqa: N802
        fam, n, d = self.family.name, self.n, self._deviance
        if fam == "gaussian":
            base = n * (math.log(2 * math.pi * d / n) + 1) - self._log_weights + 2
        elif fam in ("poisson", "binomial"):
            base = self._aic_sum
        elif fam == "Gamma":
            shape = self._sum_weights / d
            total = self.data.agg(F.sum(self.w * F.ln(self.y)), F.sum(self.w * F.ln(self.fitted_column())), F.sum(self.w * self.y / self.fitted_column())).first()
            base = -2 * (self._sum_weights * (shape * math.log(shape) - math.lgamma(shape)) + (shape - 1) * total[0] - shape * total[1] - shape * total[2]) + 2
        elif fam == "inverse.gaussian":
            logs = self.data.agg(F.sum(self.w * F.ln(self.y))).first()[0]
            base = self._sum_weights * (math.log(d / self._sum_weights * 2 * math.pi) + 1) + 3 * logs + 2
        else:
            return math.nan
        return base + k * self.rank

    def extract_aic(self, k: float = 2.0) -> float:
        return self.AIC(k)

    def fitted_column(self) -> Column:
        return self.family.linkinv(self.eta())

    def working_weight(self) -> Column:
        mu = self.fitted_column()
        return self.w * self.family.mu_eta(self.eta()) ** 2 / self.family.variance(mu)

    def residual_column(self, type: str = "deviance") -> Column:  # noqa: A002
        mu = self.fitted_column()
        raw = self.y - mu
        if type == "response":
            return raw
        if type == "working":
            return raw / self.family.mu_eta(self.eta())
        if type == "pearson":
            return raw * F.sqrt(self.w / self.family.variance(mu))
        return F.signum(raw) * F.sqrt(F.greatest(self.w * self.family.dev(self.y, mu), F.lit(0.0)))

    def predict(self, newdata: Frame | DataFrame | None = None, type: str = "response", se_fit: bool = False) -> Frame:  # noqa: A002
        df = self.data if newdata is None else newdata.df if isinstance(newdata, Frame) else newdata
        df, columns = self._new_columns(df)
        eta = self.eta(columns)
        out = df.withColumn("fit", eta if type == "link" else self.family.linkinv(eta))
        if se_fit:
            se = F.sqrt(self.hat_column(columns, weighted=False) * self.dispersion)
            out = out.withColumn("se_fit", se if type == "link" else se * F.abs(self.family.mu_eta(eta)))
        return Frame(out)

    def update(self, formula: str | None = None, **changes) -> glm:
        text = self._own if formula is None else _updated(self._own, formula)
        args = {"data": self.source, "family": self.family, "offset": self.offset_text, "contrasts": self.contrasts}
        if not self._counts:
            args["weights"] = self.weights
        return glm(text, **(args | changes))


def _lfactorial(k: Column) -> Column:
    """ln k! by Stirling's series shifted by eight places, exact to double precision from 0 up."""
    z = k + 9.0
    series = (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    product = F.lit(1.0)
    for i in range(1, 9):
        product = product * (k + float(i))
    return series - F.ln(product)


def _aic_term(fam: Family, mu: Column) -> Column:
    y, w = F.col("y"), F.col("w")
    if fam.name == "poisson":
        return -2 * w * (y * F.ln(mu) - mu - _lfactorial(y))
    if fam.name == "binomial":
        k = F.round(w * y)
        choose = _lfactorial(w) - _lfactorial(k) - _lfactorial(w - k)
        return -2 * (choose + F.when(k > 0, k * F.ln(mu)).otherwise(0.0) + F.when(w - k > 0, (w - k) * F.ln(1 - mu)).otherwise(0.0))
    return F.lit(0.0)
