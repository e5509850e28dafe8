"""Linear mixed models from sums by group: with one grouping factor here, with several in crossed.py.

One aggregate gives each group's products of its random-effect columns, fixed
columns and response; the profiled criterion at a covariance is then a sum over
groups of small matrix algebra.  A step of the search evaluates many
covariances in one pass over the groups, so rows are read once and groups some
tens of times, wherever they are.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import quote
from ..operators.frame import Frame
from ..plans.shared import cut
from ..plans.shipping import ship
from . import special
from .formula import design, parse, sql_of

_BAR = re.compile(r"\(([^()|]+)(\|\|?)\s*([^()]+?)\s*\)")
#: Groups whose algebra is done at once.
_CHUNK = 4096


def _random_terms(text: str) -> tuple[str, list[tuple[str, bool]], str]:
    """The fixed formula, the random terms (columns' text, correlated) and the grouping column."""
    bars = [(m[1].strip(), m[2] == "|", m[3]) for m in _BAR.finditer(text)]
    groups = {g for *_, g in bars}
    if not bars or len(groups) > 1 or any("/" in g for g in groups):
        raise ValueError("a mixed model needs random terms, like (1 | g)")
    left, _, right = _BAR.sub("", text).partition("~")
    parts = [p for p in (x.strip() for x in re.split(r"\+", right)) if p]
    return f"{left} ~ {' + '.join(parts) or '1'}", [(t, correlated) for t, correlated, _ in bars], groups.pop()


def _triples(pdf: pd.DataFrame, q: int, p: int) -> tuple[np.ndarray, ...]:
    """Z'Z, Z'[X, y] and [X, y]'[X, y] of each group."""
    k = q + p + 1
    flat = pdf[[c for c in pdf.columns if c.startswith("s")]].to_numpy(dtype=float)
    full = np.zeros((len(flat), k, k))
    i, j = np.triu_indices(k)
    full[:, i, j] = flat
    full[:, j, i] = flat
    return full[:, :q, :q], full[:, :q, q:], full[:, q:, q:]


class _Groups:
    """Statistics of each group, as the flat upper triangles of products of [Z, X, y], and the criterion over them."""

    def __init__(self, rows: DataFrame, q: int, p: int):
        self.rows, self.q, self.p = rows, q, p

    def sums(self, factors: list[np.ndarray]) -> list[tuple[float, np.ndarray]]:
        """For each covariance factor the sum of log determinants and of what is left of [X, y]' [X, y]: one pass over the groups."""
        q, p = self.q, self.p
        size = p + 1
        i, j = np.triu_indices(size)

        def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((len(factors), 1 + len(i)))
            for pdf in batches:
                for start in range(0, len(pdf), _CHUNK):
                    zz, zx, xx = _triples(pdf.iloc[start : start + _CHUNK], q, p)
                    for f, factor in enumerate(factors):
                        low = np.linalg.cholesky(factor.T @ zz @ factor + np.eye(len(factor)))
                        part = np.linalg.solve(low, factor.T @ zx)
                        rest = (xx - part.transpose(0, 2, 1) @ part).sum(axis=0)
                        total[f, 0] += 2 * np.log(np.diagonal(low, axis1=1, axis2=2)).sum()
                        total[f, 1:] += rest[i, j]
            out = pd.DataFrame(total, columns=[f"v{c}" for c in range(total.shape[1])])
            out.insert(0, "f", np.arange(len(factors)))
            yield out

        ship(self.rows.sparkSession)
        names = [f"v{c}" for c in range(1 + len(i))]
        made = self.rows.mapInPandas(over, "f int, " + ", ".join(f"{n} double" for n in names)).groupBy("f").agg(*[F.sum(n).alias(n) for n in names])
        out = []
        for row in sorted(made.collect()):
            full = np.zeros((size, size))
            full[i, j] = row[2:]
            out.append((row[1], full + np.triu(full, 1).T))
        return out


class lme:  # noqa: N801
    """``y ~ x + (x | g)``: fixed effects and normal random effects, by REML or ML, or at a given ``theta``.

    A formula with several grouping factors gives a model of crossed.py.
    """

    def __new__(cls, formula: str, *args, **kwargs):
        from .crossed import crossed, several

        return object.__new__(crossed if cls is lme and several(formula) else cls)

    def __init__(self, formula: str, data: Frame | DataFrame, REML: bool = True, contrasts: dict[str, str] | None = None, theta: list[float] | None = None):  # noqa: N803
        df = data.df if isinstance(data, Frame) else data
        self.text, self.source, self.REML, self.contrasts = formula, df, REML, contrasts or {}
        fixed, random, self.group = _random_terms(formula)
        self.formula = parse(fixed, [c for c in df.columns if c != self.group])
        self.design = design(self.formula, df, self.contrasts)
        y = F.expr(sql_of(self.formula.response)).cast("double")
        z, self.effects, blocks = [], [], []
        needs = [*self.design.needs, self.group]
        for text, correlated in random:
            d = design(parse(f"~ {text}", df.columns), df, self.contrasts)
            needs += d.needs
            z += d.columns
            self.effects += d.names
            blocks += [len(d.names)] if correlated else [1] * len(d.names)
        complete = y.isNotNull()
        for c in needs:
            complete = complete & F.col(quote(c)).isNotNull()
        columns = [*z, *self.design.columns, y]
        q, p = len(z), len(self.design.columns)
        named = df.where(complete).select(F.col(quote(self.group)).alias("g"), *[c.cast("double").alias(f"x{i}") for i, c in enumerate(columns)])
        pairs = list(itertools.combinations_with_replacement(range(q + p + 1), 2))
        grouped = cut(named.groupBy("g").agg(F.count(F.lit(1)).alias("m"), *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{n}") for n, (i, j) in enumerate(pairs)]))
        self.groups = _Groups(grouped, q, p)
        self.n, self.n_groups = (int(v) for v in grouped.agg(F.sum("m"), F.count("*")).first())
        # theta: the lower triangles of the blocks of the relative covariance factor
        self._slots = [(start + i, start + j) for start, size in zip(np.cumsum([0, *blocks[:-1]]).tolist(), blocks, strict=True) for j in range(size) for i in range(j, size)]
        self._q, self._p = q, p
        self.theta = self._search() if theta is None else np.array(theta, dtype=float)
        self._finish()

    def factor(self, theta: np.ndarray) -> np.ndarray:
        out = np.zeros((self._q, self._q))
        for v, (i, j) in zip(theta, self._slots, strict=True):
            out[i, j] = abs(v) if i == j else v
        return out

    def _criterion(self, logdet: float, rest: np.ndarray) -> tuple[float, np.ndarray, float, np.ndarray]:
        """Deviance or REML criterion, fixed effects, residual scale and the fixed effects' information."""
        p = self._p
        a, b, c = rest[:p, :p], rest[:p, p], rest[p, p]
        beta = np.linalg.solve(a, b)
        rss = max(float(c - b @ beta), 1e-300)
        k = self.n - p if self.REML else self.n
        value = logdet + k * (1 + math.log(2 * math.pi * rss / k))
        if self.REML:
            value += float(np.linalg.slogdet(a)[1])
        return value, beta, math.sqrt(rss / k), a

    def _values(self, thetas: list[np.ndarray]) -> np.ndarray:
        return np.array([self._criterion(*s)[0] for s in self.groups.sums([self.factor(t) for t in thetas])])

    def _search(self) -> np.ndarray:
        """A grid of scales, then damped Newton steps with differences, the points of each step in one pass."""
        m = len(self._slots)
        unit = np.array([1.0 if i == j else 0.0 for i, j in self._slots])
        scales = [0.0, *np.geomspace(0.01, 100, 25).tolist()]
        starts = [unit * s for s in scales]
        best = starts[int(np.argmin(self._values(starts)))]
        for _ in range(40):
            # differences near by for the gradient, wider ones for the curvature, which rounding would drown otherwise
            size = np.maximum(np.abs(best), 1e-2)
            near, wide = np.diag(1e-3 * size), np.diag(1e-2 * size)
            cross = list(itertools.combinations(range(m), 2))
            points = [best, *[best + e for e in near], *[best - e for e in near], *[best + e for e in wide], *[best - e for e in wide], *[best + wide[i] + wide[j] for i, j in cross]]
            f = self._values(points)
            parts = [f[1 + k * m : 1 + (k + 1) * m] for k in range(4)]
            gradient = (parts[0] - parts[1]) / (2 * np.diag(near))
            h = np.diag(wide)
            hessian = np.diag((parts[2] - 2 * f[0] + parts[3]) / h**2)
            for (i, j), v in zip(cross, f[1 + 4 * m :], strict=True):
                hessian[i, j] = hessian[j, i] = (v - parts[2][i] - parts[2][j] + f[0]) / (h[i] * h[j])
            w, v = np.linalg.eigh(hessian)
            step = -v @ ((v.T @ gradient) / np.maximum(np.abs(w), 1e-6))
            tries = [best + step * s for s in (1.0, 0.5, 0.25, 0.1, 0.03, 0.01, 1.5, 2.0)] + [best - gradient * s for s in (1e-2, 1e-4)]
            found = self._values(tries)
            # near the optimum values differ by less than their rounding; the whole step is taken there
            k = 0 if found[0] <= f[0] + 1e-10 * abs(f[0]) else int(np.argmin(found))
            if found[k] > f[0] + 1e-10 * abs(f[0]):
                break
            best = np.where([i == j for i, j in self._slots], np.abs(tries[k]), tries[k])
            if np.all(np.abs(step) < 1e-6 * size):
                break
        return best

    def _finish(self) -> None:
        (sums,) = self.groups.sums([self.factor(self.theta)])
        self.criterion, self.beta, self.sigma, information = self._criterion(*sums)
        self.vcov = self.sigma**2 * np.linalg.inv(information)
        self.names = list(self.design.names)
        cov = self.sigma**2 * self.factor(self.theta) @ self.factor(self.theta).T
        self.covariance = cov
        self.sd = dict(zip(self.effects, np.sqrt(np.diag(cov)).tolist(), strict=True))
        self.rank = self._p

    # ------------------------------------------------------------ what a fit tells
    def fixef(self) -> dict[str, float]:
        return dict(zip(self.names, self.beta.tolist(), strict=True))

    coefficients = fixef

    def coef_table(self) -> list[dict[str, float | str]]:
        se = np.sqrt(np.diag(self.vcov))
        return [{"term": t, "estimate": b, "std_error": s, "statistic": b / s} for t, b, s in zip(self.names, self.beta.tolist(), se.tolist(), strict=True)]

    def ranef(self) -> Frame:
        """(group, an effect each): the conditional means of the random effects."""
        factor, beta, effects, q, p = self.factor(self.theta), self.beta, self.effects, self._q, self._p

        def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                zz, zx, _ = _triples(pdf, q, p)
                left = factor.T @ zz @ factor + np.eye(len(factor))
                right = (factor.T @ (zx[:, :, -1] - zx[:, :, :-1] @ beta)[:, :, None])
                u = (factor @ np.linalg.solve(left, right))[:, :, 0]
                out = pd.DataFrame(u, columns=effects)
                out.insert(0, "group", pdf["g"].to_numpy())
                yield out

        kind = self.groups.rows.schema["g"].dataType.simpleString()
        return Frame(self.groups.rows.mapInPandas(over, f"group {kind}, " + ", ".join(f"{quote(e)} double" for e in effects)))

    def df(self) -> int:
        return self._p + len(self.theta) + 1

    def log_likelihood(self) -> float:
        return -self.criterion / 2

    def deviance(self) -> float:
        return self.criterion

    def AIC(self, k: float = 2.0) -> float:  # noqa: N802
        return self.criterion + k * self.df()

    def BIC(self) -> float:  # noqa: N802
        return self.AIC(math.log(self.n))

    def refit(self, REML: bool) -> lme:  # noqa: N803
        return self if self.REML == REML else lme(self.text, self.source, REML, self.contrasts)


def anova_lme(*models: lme) -> list[dict]:
    """Likelihood ratio tests of models, refitted by ML, from the smallest to the largest."""
    fits = sorted((m.refit(False) for m in models), key=lambda m: m.df())
    out: list[dict] = []
    for i, m in enumerate(fits):
        row = {"model": m.text, "npar": m.df(), "aic": m.AIC(), "bic": m.BIC(), "log_likelihood": m.log_likelihood(), "deviance": m.deviance()}
        if i:
            change, df = fits[i - 1].deviance() - m.deviance(), m.df() - fits[i - 1].df()
            row |= {"chisq": max(change, 0.0), "df": df, "p_value": special.pchisq_upper(max(change, 0.0), df) if df else math.nan}
        out.append(row)
    return out
