"""Additive models: penalised smooths in generalised linear models, fitted from Gramians.

A smooth is a basis of bounded size whose knots come from the data, with one
or several penalties.  A step of the fit is one pass over the rows: tasks
evaluate the bases of their rows and send sums of products, Spark adds them,
and everything else - coefficients, effective degrees of freedom, Newton steps
on the smoothing parameters by REML or GCV - is algebra on matrices of the
number of columns.  With normal responses one pass is enough; otherwise the
smoothing parameters are chosen anew for the working model of each step.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import quote
from ..operators import ranges
from ..operators.frame import Frame
from ..plans.shipping import ship
from . import special
from .formula import MOST_LEVELS, design, parse, sql_of, variables
from .linear import Family, _aic_term, gaussian
from .splines import Pieces, arguments, b_splines, natural_splines, numbers, roughness

#: Most columns of a model: a pass sends as many sums as pairs of them.
MOST_COLUMNS = 1000
#: Knots of a thin plate basis, and the rows that a task evaluates at once.
PLATE_KNOTS, _ROWS = 100, 4096

# ---------------------------------------------------------------- families over arrays
_inv_logit = lambda e: 1 / (1 + np.exp(-e))
#: link: (link, inverse, derivative of the inverse)
_LINKS: dict[str, tuple[Callable, Callable, Callable]] = {
    "identity": (lambda m: m, lambda e: e, np.ones_like),
    "log": (np.log, np.exp, np.exp),
    "logit": (lambda m: np.log(m / (1 - m)), _inv_logit, lambda e: _inv_logit(e) * _inv_logit(-e)),
    "inverse": (lambda m: 1 / m, lambda e: 1 / e, lambda e: -1 / (e * e)),
    "sqrt": (np.sqrt, np.square, lambda e: 2 * e),
    "cloglog": (lambda m: np.log(-np.log1p(-m)), lambda e: -np.expm1(-np.exp(e)), lambda e: np.exp(e - np.exp(e))),
}


def _ylogy(y: np.ndarray, m: np.ndarray) -> np.ndarray:
    return np.where(y > 0, y * np.log(np.where(y > 0, y, 1) / m), 0.0)


#: family: (start, variance, unit deviance)
_FAMILIES: dict[str, tuple[Callable, Callable, Callable]] = {
    "gaussian": (lambda y, w: y, np.ones_like, lambda y, m: (y - m) ** 2),
    "poisson": (lambda y, w: y + 0.1, lambda m: m, lambda y, m: 2 * (_ylogy(y, m) - (y - m))),
    "binomial": (lambda y, w: (w * y + 0.5) / (w + 1), lambda m: m * (1 - m), lambda y, m: 2 * (_ylogy(y, m) + _ylogy(1 - y, 1 - m))),
    "Gamma": (lambda y, w: y, np.square, lambda y, m: -2 * (np.log(y / m) - (y - m) / m)),
}


# ---------------------------------------------------------------- bases
@dataclass
class Plate:
    """A thin plate basis of one or two variables: the leading eigenvectors of the knots' distances, and the plane."""

    knots: np.ndarray
    by: np.ndarray  # from distances to functions
    shift: np.ndarray

    def array(self, *x: np.ndarray) -> np.ndarray:
        at = np.stack(x, axis=1)
        plane = np.concatenate([np.ones((len(at), 1)), at - self.shift], axis=1)
        return np.concatenate([_plate(at, self.knots) @ self.by, plane], axis=1)


def _plate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    r = np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2))
    if a.shape[1] == 1:
        return r**3 / 12
    return np.where(r > 0, r * r * np.log(np.where(r > 0, r, 1)), 0.0) / (8 * math.pi)


def plate(knots: np.ndarray, k: int) -> tuple[Plate, np.ndarray]:
    shift = knots.mean(axis=0)
    plane = np.concatenate([np.ones((len(knots), 1)), knots - shift], axis=1)
    values, vectors = np.linalg.eigh(_plate(knots, knots))
    lead = np.argsort(-np.abs(values))[:k]
    u, d = vectors[:, lead], values[lead]
    q, _ = np.linalg.qr(u.T @ plane, mode="complete")
    z = q[:, plane.shape[1] :]
    size = z.shape[1] + plane.shape[1]
    s = np.zeros((size, size))
    s[: z.shape[1], : z.shape[1]] = z.T @ (d[:, None] * z)
    return Plate(knots, u @ z, shift), s


def cubic_regression(knots: np.ndarray) -> tuple[Pieces, np.ndarray]:
    """Natural cubic splines, each one at its own knot and zero at the others."""
    p = natural_splines(list(knots[1:-1]), (float(knots[0]), float(knots[-1])), True)
    p = p.rotated(np.linalg.inv(p.array(np.asarray(knots, float))))
    return p, roughness(p)


def p_splines(low: float, high: float, k: int, degree: int = 3, order: int = 2) -> tuple[Pieces, np.ndarray]:
    """B-splines over even knots, with a penalty on differences of neighbours; straight outside."""
    low, high = low - (high - low) * 0.001, high + (high - low) * 0.001
    step = (high - low) / (k - degree)
    p = b_splines(low + step * np.arange(-degree, k + 1), degree).linear_outside(low, high)
    d = np.diff(np.eye(k), order, axis=0)
    return p, d.T @ d


class Levels:
    """Indicators of the numbers 0 .. n - 1."""

    def __init__(self, n: int):
        self.n = n

    def array(self, x: np.ndarray) -> np.ndarray:
        return (x[:, None] == np.arange(self.n)).astype(float)


@dataclass
class Product:
    """The products of all functions of several bases of one variable each."""

    parts: list

    def array(self, *x: np.ndarray) -> np.ndarray:
        out = self.parts[0].array(x[0])
        for p, v in zip(self.parts[1:], x[1:], strict=True):
            out = (out[:, :, None] * p.array(v)[:, None, :]).reshape(len(out), -1)
        return out


@dataclass
class Smooth:
    """A term of the model: what it reads, its basis with constraints absorbed, its penalties."""

    label: str
    inputs: list[int]  # columns of covariates
    by: int | None  # a column that multiplies the basis
    basis: object
    penalties: list[np.ndarray]
    centred: bool
    sp: list[float] | None
    by_matrix: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    def raw(self, c: np.ndarray) -> np.ndarray:
        out = self.basis.array(*(c[:, i] for i in self.inputs))
        return out if self.by is None else out * c[:, self.by, None]

    def array(self, c: np.ndarray) -> np.ndarray:
        return self.raw(c) @ self.by_matrix


def split_formula(text: str) -> tuple[str, list[tuple[str, list[str], dict[str, str]]]]:
    """The formula without its smooths, and each smooth's kind, covariates and named arguments."""
    left, _, right = text.partition("~")
    found, rest, at = [], "", 0
    for m in re.finditer(r"(?<![\w.])(s|te|ti)\(", right):
        if m.start() < at:
            continue
        depth, i = 0, m.end() - 1
        while True:
            depth += {"(": 1, ")": -1}.get(right[i], 0)
            i += 1
            if not depth:
                break
        names, named = arguments(right[m.start() : i])
        found.append((m[1], names, named))
        rest += right[at : m.start()]
        at = i
    rest += right[at:]
    parts = [p for p in (x.strip() for x in re.split(r"\+(?![^()]*\))", rest)) if p]
    return f"{left} ~ {' + '.join(parts) or '1'}", found


# ---------------------------------------------------------------- the passes
def _sums(rows: DataFrame, made: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of what ``made`` gives for a block of them, as one flat array; one pass."""
    ship(rows.sparkSession)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                block = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns], axis=1)
                for i in range(0, len(block), _ROWS):
                    part = made(block[i : i + _ROWS])
                    total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total.astype(float))], names=["cell", "v"])

    found = rows.mapInArrow(over, "cell bigint, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(len(found))
    for r in found:
        out[r.cell] = r.v
    return out


def _packed_gram(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    g = x.T @ (x * w[:, None])
    return g[np.triu_indices(len(g))]


def _unpacked_gram(flat: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, n))
    i, j = np.triu_indices(n)
    out[i, j] = out[j, i] = flat
    return out


def _matrix(smooths: list[Smooth], block: np.ndarray, first: int, parametric: int) -> np.ndarray:
    """[row, column] of the whole model: parametric columns, which begin at ``first``, then the smooths'."""
    k = first + parametric
    return np.concatenate([block[:, first:k], *(s.array(block[:, k:]) for s in smooths)], axis=1)


# ---------------------------------------------------------------- smoothing parameters from a Gramian
@dataclass
class Solved:
    """A penalised fit of a working model at given smoothing parameters."""

    beta: np.ndarray
    inverse: np.ndarray  # of X'WX + S
    edf: np.ndarray  # of each coefficient
    rss: float
    score: float
    gradient: np.ndarray


class Working:
    """The working model's Gramian of (X, z) with the penalties; criteria and their derivatives in the logarithms of the parameters."""

    def __init__(self, g: np.ndarray, n: int, penalties: list[np.ndarray], ranks: list[tuple[list[int], np.ndarray]], method: str, scale: float | None):
        p = len(g) - 1
        self.xx, self.xz, self.zz, self.n, self.p = g[:p, :p], g[:p, p], float(g[p, p]), n, p
        self.penalties, self.ranks, self.method, self.scale = penalties, ranks, method, scale
        #: columns that no penalty reaches
        self.free = p - sum(q.shape[1] for _, q in ranks)

    def solve(self, rho: np.ndarray) -> Solved:
        lam = np.exp(rho)
        s = sum((v * m for v, m in zip(lam, self.penalties, strict=True)), np.zeros((self.p, self.p)))
        a = self.xx + s
        d = 1 / np.sqrt(np.maximum(np.diag(a), 1e-300))
        low = np.linalg.cholesky(a * np.outer(d, d) + np.eye(self.p) * 1e-14)
        half = np.linalg.solve(low, np.diag(d))
        inverse = half.T @ half
        beta = inverse @ self.xz
        beta += inverse @ (self.xz - a @ beta)
        rss = max(self.zz - 2 * beta @ self.xz + beta @ self.xx @ beta, 1e-300)
        moves = [-v * inverse @ (m @ beta) for v, m in zip(lam, self.penalties, strict=True)]
        hat = inverse @ self.xx
        edf = np.diag(hat).copy()
        if self.method == "GCV":
            tau = edf.sum()
            d_rss = np.array([-2 * (s @ beta) @ b for b in moves])
            d_tau = np.array([-v * np.sum((inverse @ m) * hat.T) for v, m in zip(lam, self.penalties, strict=True)])
            if self.scale is None:
                left = self.n - tau
                return Solved(beta, inverse, edf, rss, self.n * rss / left**2, self.n * (d_rss / left**2 + 2 * rss * d_tau / left**3))
            return Solved(beta, inverse, edf, rss, rss / self.n + 2 * self.scale * tau / self.n - self.scale, (d_rss + 2 * self.scale * d_tau) / self.n)
        whole = rss + beta @ s @ beta
        df = self.n - self.free
        phi = whole / df if self.scale is None else self.scale
        log_a = 2 * np.log(np.diag(low)).sum() - 2 * np.log(d).sum()
        log_s, d_log_s = 0.0, np.zeros(len(rho))
        for which, q in self.ranks:
            inner = sum(lam[j] * q.T @ self.penalties[j] @ q for j in which)
            log_s += np.linalg.slogdet(inner)[1]
            back = np.linalg.inv(inner)
            for j in which:
                d_log_s[j] = lam[j] * np.sum(back * (q.T @ self.penalties[j] @ q))
        score = (whole / phi + df * math.log(2 * math.pi * phi) + log_a - log_s) / 2
        quadratic = np.array([v * beta @ m @ beta for v, m in zip(lam, self.penalties, strict=True)])
        traces = np.array([v * np.sum(inverse * m) for v, m in zip(lam, self.penalties, strict=True)])
        return Solved(beta, inverse, edf, rss, score, (quadratic / phi + traces - d_log_s) / 2)

    def search(self, rho: np.ndarray, fixed: np.ndarray) -> np.ndarray:
        """Newton steps from the gradient and its differences, halved until the score falls; a grid gives the start."""
        live, start = np.flatnonzero(~fixed), rho
        if not len(live):
            return rho
        now = self.solve(rho)
        for move in (-9.0, -6.0, -3.0, 3.0, 6.0, 9.0):
            tried = start.copy()
            tried[live] += move
            found = self.solve(tried)
            if found.score < now.score:
                rho, now = tried, found
        for _ in range(100):
            g = now.gradient[live]
            hessian = np.zeros((len(live), len(live)))
            for c, j in enumerate(live):
                step = np.zeros(len(rho))
                step[j] = 1e-4
                hessian[:, c] = (self.solve(rho + step).gradient[live] - self.solve(rho - step).gradient[live]) / 2e-4
            values, vectors = np.linalg.eigh((hessian + hessian.T) / 2)
            move = -vectors @ ((vectors.T @ g) / np.maximum(np.abs(values), 1e-7 * max(1.0, abs(now.score))))
            move *= min(1.0, 5 / max(1e-300, np.abs(move).max()))
            for _ in range(30):
                tried = rho.copy()
                tried[live] = np.clip(rho[live] + move, -40, 40)
                found = self.solve(tried)
                if found.score <= now.score + 1e-13 * abs(now.score):
                    break
                move /= 2
            else:
                break
            done = abs(found.score - now.score) < 1e-12 * (abs(now.score) + 1e-12) and np.abs(found.gradient[live]).max() < 1e-6 * (abs(now.score) + 1)
            rho, now = tried, found
            if done:
                break
        return rho


class gam:  # noqa: N801
    """``y ~ a + s(x) + te(u, v)``: a generalised additive model.

    Smooths: ``s(x, bs=, k=, by=, sp=)`` with bases tp (default; one or two
    variables), cr, ps and re, tensor products ``te`` and ``ti`` of cr or ps
    margins.  Smoothing parameters are chosen by REML or GCV (UBRE where the
    family's scale is known) unless given by ``sp``, one for each penalty.
    select=True adds a penalty on what each smooth's own penalty leaves free.
    scale_penalty=False leaves penalties as integrals and differences are.
    Rows with a null in any variable are left out.
    """

    def __init__(self, formula: str, data: Frame | DataFrame, family: Family | None = None, method: str = "REML", weights: str | None = None, sp: Sequence[float] | None = None,
                 select: bool = False, scale_penalty: bool = True, contrasts: dict[str, str] | None = None, maxit: int = 50, epsilon: float = 1e-8):
        df = data.df if isinstance(data, Frame) else data
        if method not in ("REML", "GCV"):
            raise ValueError("method is REML or GCV")
        self.text, self.method, self.family = formula, method, family or gaussian()
        if self.family.name not in _FAMILIES or self.family.link not in _LINKS:
            raise NotImplementedError(f"no additive models with {self.family.name}({self.family.link})")
        plain, terms = split_formula(formula)
        self.formula = parse(plain, df.columns)
        self.design = design(self.formula, df, contrasts or {})
        self._covariates: list[Column] = []
        self._needs = list(self.design.needs)
        y = F.expr(sql_of(self.formula.response)).cast("double")
        w = F.expr(sql_of(weights)).cast("double") if weights else F.lit(1.0)
        self.offset = sum((F.expr(sql_of(o)).cast("double") for o in self.formula.offsets), F.lit(0.0))
        for _, names, named in terms:
            for t in [*names, *([named["by"]] if "by" in named else [])]:
                self._needs += variables(t)
        complete = y.isNotNull() & w.isNotNull()
        for c in dict.fromkeys(self._needs):
            complete = complete & F.col(quote(c)).isNotNull()
        self.data = df.where(complete)
        self.smooths: list[Smooth] = []
        for kind, names, named in terms:
            self.smooths += self._smooths(kind, names, named)
        rows = self._inputs(self.data, [y.alias("y"), w.alias("w"), self.offset.cast("double").alias("o")]).persist()
        try:
            self._constrain(rows, select, scale_penalty)
            self._fit(rows, None if sp is None else list(sp), maxit, epsilon)
        finally:
            rows.unpersist()
        self.y, self.w = y, w

    # ------------------------------------------------------------ smooths from the formula
    def _covariate(self, made: Column) -> int:
        self._covariates.append(made)
        return len(self._covariates) - 1

    def _levels(self, text: str) -> list | None:
        """Levels of a factor (None for a number)."""
        kind = dict(self.data.dtypes).get(text, "double")
        m = re.fullmatch(r"factor\((.*)\)", text)
        if not m and kind not in ("string", "boolean"):
            return None
        base = F.col(quote(m[1] if m else text))
        found = [r[0] for r in self.data.select(base.alias("v")).distinct().orderBy("v").limit(MOST_LEVELS + 1).collect()]
        if len(found) > MOST_LEVELS:
            raise ValueError(f"{text} has more than {MOST_LEVELS} levels")
        return found

    def _number_of(self, text: str, levels: list) -> Column:
        m = re.fullmatch(r"factor\((.*)\)", text)
        return (F.array_position(F.array(*[F.lit(v) for v in levels]), F.col(quote(m[1] if m else text))) - 1).cast("double")

    def _knots(self, x: Column, k: int) -> np.ndarray:
        """Even quantiles of the different values."""
        values = self.data.select(x.alias("v")).distinct()
        found = ranges.quantiles(values, "v", [i / (k - 1) for i in range(k)]).first()
        if found is None or found.n < k:
            raise ValueError(f"a smooth of {k} functions needs as many different values, not {0 if found is None else found.n}")
        return np.array(found.q)

    def _margin(self, x: Column, bs: str, k: int) -> tuple[object, np.ndarray]:
        if bs == "cr":
            return cubic_regression(self._knots(x, k))
        if bs == "ps":
            low, high = self.data.agg(F.min(x), F.max(x)).first()
            return p_splines(low, high, k)
        if bs == "tp":
            n = self.data.select(x.alias("v")).distinct().limit(PLATE_KNOTS).count()
            if n < k:
                raise ValueError(f"a smooth of {k} functions needs as many different values, not {n}")
            return plate(self._knots(x, n)[:, None], k)
        raise NotImplementedError(f"no basis {bs!r}; there are tp, cr, ps and re")

    def _smooths(self, kind: str, names: list[str], named: dict[str, str]) -> list[Smooth]:
        unknown = set(named) - {"bs", "k", "by", "sp", "m"}
        if unknown:
            raise ValueError(f"{kind}() has no argument {', '.join(sorted(unknown))}")
        label = f"{kind}({','.join(names)})"
        kinds = re.findall(r"[\"'](\w+)[\"']", named.get("bs", "")) or (["tp"] if kind == "s" else ["cr"])
        sizes = [int(v) for v in numbers(named["k"])] if "k" in named else [30 if kind == "s" and len(names) == 2 else 10 if kind == "s" else 5]
        sp = numbers(named["sp"]) if "sp" in named else None
        x = [F.expr(sql_of(n)).cast("double") for n in names] if kinds != ["re"] else []
        if kind == "s" and kinds == ["re"]:
            found = [(n, self._levels(n)) for n in names]
            at = [self._covariate(F.expr(sql_of(n)).cast("double") if v is None else self._number_of(n, v)) for n, v in found]
            factors = [i for i, (_, v) in enumerate(found) if v is not None]
            if len(factors) != 1 or len(found) > 2:
                raise NotImplementedError("a random effect is s(g, bs='re') or s(g, x, bs='re')")
            n = len(found[factors[0]][1])
            slope = next((at[i] for i in range(len(at)) if i not in factors), None)
            return [Smooth(label, [at[factors[0]]], slope, Levels(n), [np.eye(n)], False, sp)]
        if kind == "s" and len(names) == 2:
            points = self.data.select(*[c.alias(f"c{i}") for i, c in enumerate(x)]).distinct()
            # a bounded set of knots: the points of the smallest hashes
            chosen = points.orderBy(F.xxhash64("c0", "c1"), "c0", "c1").limit(2 * PLATE_KNOTS).collect()
            if len(chosen) < sizes[0]:
                raise ValueError(f"a smooth of {sizes[0]} functions needs as many different points, not {len(chosen)}")
            basis, s = plate(np.array([tuple(r) for r in chosen], dtype=float), sizes[0])
            penalties = [s]
        elif len(names) == 1:
            basis, s = self._margin(x[0], kinds[0], sizes[0])
            penalties = [s]
        else:
            kinds, sizes = (v * len(names) if len(v) == 1 else v for v in (kinds, sizes))
            margins = []
            for c, b, k in zip(x, kinds, sizes, strict=True):
                if b not in ("cr", "ps"):
                    raise NotImplementedError("margins of tensor products are cr or ps")
                p, s = self._margin(c, b, k)
                if kind == "ti":  # margins without constants, by the mean over the rows
                    means = self._column_means(p, c)
                    z = np.linalg.qr(means[:, None], mode="complete")[0][:, 1:]
                    p, s = p.rotated(z), z.T @ s @ z
                margins.append((p, s / np.linalg.eigvalsh(s)[-1]))
            basis = Product([p for p, _ in margins])
            penalties = []
            for i in range(len(margins)):
                made = np.eye(1)
                for j, (p, s) in enumerate(margins):
                    made = np.kron(made, s if i == j else np.eye(p.coefs.shape[1]))
                penalties.append(made)
        at = [self._covariate(c) for c in x]
        centred = kind != "ti"
        if "by" not in named:
            return [Smooth(label, at, None, basis, penalties, centred, sp)]
        by = named["by"]
        levels = self._levels(by)
        if levels is None:
            return [Smooth(f"{label}:{by}", at, self._covariate(F.expr(sql_of(by)).cast("double")), basis, penalties, False, sp)]
        m = re.fullmatch(r"factor\((.*)\)", by)
        base = F.col(quote(m[1] if m else by))
        return [Smooth(f"{label}:{by}{v}", at, self._covariate((base == F.lit(v)).cast("double")), basis, penalties, centred, sp) for v in levels]

    def _column_means(self, p: Pieces, x: Column) -> np.ndarray:
        rows = self.data.select(x.alias("c"), F.lit(1.0).alias("one"))
        found = _sums(rows, lambda block: np.append(p.array(block[:, 0]).sum(axis=0), len(block)))
        return found[:-1] / found[-1]

    # ------------------------------------------------------------ set-up
    def _inputs(self, df: DataFrame, more: list[Column], columns: list[Column] | None = None) -> DataFrame:
        parametric = [c.cast("double").alias(f"x{i}") for i, c in enumerate(self.design.columns if columns is None else columns)]
        return df.select(*more, *parametric, *[c.alias(f"c{i}") for i, c in enumerate(self._covariates)])

    def _constrain(self, rows: DataFrame, select: bool, scale_penalty: bool) -> None:
        """Sums of the bases' columns and their largest absolute row sums, from one pass; then constraints and scaled penalties."""
        smooths, k = self.smooths, 3 + len(self.design.columns)
        sizes = [len(s.penalties[0]) for s in smooths]

        def made(block: np.ndarray) -> np.ndarray:
            return np.concatenate([[len(block)], *(s.raw(block[:, k:]).sum(axis=0) for s in smooths)])

        found = _sums(rows, made)
        if not len(found) or found[0] == 0:
            raise ValueError("no complete rows")
        self.n = int(found[0])
        at = 1
        largest = self._largest_rows(rows, k) if scale_penalty and smooths else [1.0] * len(smooths)
        for s, size, most in zip(smooths, sizes, largest, strict=True):
            sums = found[at : at + size]
            at += size
            s.by_matrix = np.eye(size)
            if scale_penalty:
                s.penalties = [m * (most**2 / np.linalg.norm(m, 1)) for m in s.penalties]
            if s.centred and np.abs(sums).max() > 0:
                s.by_matrix = np.linalg.qr(sums[:, None] / self.n, mode="complete")[0][:, 1:]
                s.penalties = [s.by_matrix.T @ m @ s.by_matrix for m in s.penalties]
            if select:
                values, vectors = np.linalg.eigh(sum(m / np.linalg.norm(m) for m in s.penalties))
                left = vectors[:, values < 1e-10 * values[-1]]
                if left.shape[1]:
                    s.penalties = [*s.penalties, left @ left.T]

    def _largest_rows(self, rows: DataFrame, k: int) -> list[float]:
        smooths = self.smooths
        names = ", ".join(f"m{i} double" for i in range(len(smooths)))

        def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            most = np.zeros(len(smooths))
            for batch in batches:
                if batch.num_rows:
                    block = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns], axis=1)[:, k:]
                    for i in range(0, len(block), _ROWS):
                        most = np.maximum(most, [np.abs(s.raw(block[i : i + _ROWS])).sum(axis=1).max() for s in smooths])
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in most], names=[f"m{i}" for i in range(len(smooths))])

        return list(rows.mapInArrow(over, names).agg(*[F.max(f"m{i}") for i in range(len(smooths))]).first())

    # ------------------------------------------------------------ the fit
    def _fit(self, rows: DataFrame, sp: list[float] | None, maxit: int, epsilon: float) -> None:
        start, variance, unit = _FAMILIES[self.family.name]
        link, inverse_link, slope = _LINKS[self.family.link]
        self.slices, at = [], len(self.design.columns)
        for s in self.smooths:
            self.slices.append(slice(at, at + s.by_matrix.shape[1]))
            at += s.by_matrix.shape[1]
        p = at
        if p > MOST_COLUMNS:
            raise ValueError(f"the model has {p} columns; at most {MOST_COLUMNS} are allowed")
        penalties, ranks, given = [], [], []
        for s, where in zip(self.smooths, self.slices, strict=True):
            which = []
            for m in s.penalties:
                whole = np.zeros((p, p))
                whole[where, where] = m
                which.append(len(penalties))
                penalties.append(whole)
            values, vectors = np.linalg.eigh(sum(m / np.linalg.norm(m) for m in s.penalties))
            q = np.zeros((p, int((values > 1e-10 * values[-1]).sum())))
            q[where] = vectors[:, values > 1e-10 * values[-1]]
            ranks.append((which, q))
            given += (s.sp or []) + [math.nan] * (len(s.penalties) - len(s.sp or []))
        if sp is not None:
            if len(sp) != len(penalties):
                raise ValueError(f"sp needs a value for each of the {len(penalties)} penalties")
            given = [math.nan if v is None or v < 0 else v for v in sp]
        given = np.array(given, dtype=float)
        fixed = ~np.isnan(given)
        normal = self.family.name == "gaussian" and self.family.link == "identity"
        smooths, parametric, size = self.smooths, len(self.design.columns), p + 1

        def pass_at(beta: np.ndarray | None) -> tuple[np.ndarray, float]:
            """The working model's Gramian and the deviance at coefficients."""

            def made(block: np.ndarray) -> np.ndarray:
                y, w, o = block[:, 0], block[:, 1], block[:, 2]
                x = _matrix(smooths, block, 3, parametric)
                if beta is None:
                    mu = start(y, w)
                    eta = link(mu)
                else:
                    eta = x @ beta + o
                    mu = inverse_link(eta)
                g = slope(eta)
                z = eta - o + (y - mu) / g
                working = w * g * g / variance(mu)
                return np.append(_packed_gram(np.column_stack([x, z]), working), (w * unit(y, mu)).sum())

            flat = _sums(rows, made)
            return _unpacked_gram(flat[:-1], size), float(flat[-1])

        scale = 1.0 if self.family.known_scale else None
        g, _ = pass_at(None)
        diagonal = np.diag(g)[:p]
        rho = np.array([math.log(max(1e-12, diagonal[np.flatnonzero(np.diag(m))].mean() / np.diag(m)[np.flatnonzero(np.diag(m))].mean())) for m in penalties])
        rho[fixed] = np.log(np.maximum(given[fixed], 1e-17))
        beta, last, self.converged = None, math.inf, False
        for step in range(1, maxit + 1):  # noqa: B007
            working = Working(g, self.n, penalties, ranks, self.method, scale)
            rho = working.search(rho, fixed)
            solved = working.solve(rho)
            if normal:
                self.converged, deviance = True, solved.rss
                break
            new = solved.beta
            for _ in range(20):
                g, deviance = pass_at(new)
                whole = deviance + sum(math.exp(r) * new @ m @ new for r, m in zip(rho, penalties, strict=True))
                if math.isfinite(whole) and np.isfinite(g).all():
                    break
                if beta is None:
                    raise ValueError("the first step leaves the family's range")
                new = (new + beta) / 2
            beta = new
            if abs(whole - last) < epsilon * (abs(whole) + 0.1):
                self.converged = True
                working = Working(g, self.n, penalties, ranks, self.method, scale)
                solved = working.solve(rho)
                break
            last = whole
        self.iterations, self._deviance = step, float(deviance)
        self.beta, self.sp, self.score = solved.beta if normal else beta, np.exp(rho).tolist(), solved.score
        self.edf_columns = solved.edf
        self.edf = {s.label: float(solved.edf[w].sum()) for s, w in zip(self.smooths, self.slices, strict=True)}
        self.edf_total = float(solved.edf.sum())
        self.df_residual = self.n - self.edf_total
        self.dispersion = scale or solved.rss / self.df_residual
        self.vcov = solved.inverse * self.dispersion
        self.names = [*self.design.names, *(f"{s.label}.{i + 1}" for s, w in zip(self.smooths, self.slices, strict=True) for i in range(w.stop - w.start))]
        self.working = working

    # ------------------------------------------------------------ what a fit tells
    def coefficients(self) -> dict[str, float]:
        return dict(zip(self.names, self.beta.tolist(), strict=True))

    def deviance(self) -> float:
        return self._deviance

    def coef_table(self) -> list[dict]:
        """Parametric terms, tested by their Bayesian standard errors."""
        out = []
        for i, name in enumerate(self.design.names):
            se = math.sqrt(self.vcov[i, i])
            t = float(self.beta[i]) / se
            p = 2 * special.pnorm(-abs(t)) if self.family.known_scale else 2 * special.pt_upper(abs(t), self.df_residual)
            out.append({"term": name, "estimate": float(self.beta[i]), "std_error": se, "statistic": t, "p_value": p})
        return out

    def smooth_table(self) -> list[dict]:
        """Each smooth's edf and a test of it being zero: a Wald statistic in the leading directions of its values over the rows, as many as the edf rounded."""
        out = []
        for s, w in zip(self.smooths, self.slices, strict=True):
            root = np.linalg.cholesky(self.working.xx[w, w] / max(1e-300, np.trace(self.working.xx[w, w])) + 1e-12 * np.eye(w.stop - w.start)).T
            values, vectors = np.linalg.eigh(root @ self.vcov[w, w] @ root.T)
            rank = max(1, min(int(round(self.edf[s.label])), int((values > 1e-12 * values[-1]).sum())))
            lead = np.argsort(-values)[:rank]
            stat = float((((vectors[:, lead].T @ root @ self.beta[w]) ** 2) / values[lead]).sum())
            p = special.pchisq_upper(stat, rank) if self.family.known_scale else special.pf_upper(stat / rank, rank, self.df_residual)
            out.append({"term": s.label, "edf": self.edf[s.label], "ref_df": rank, "statistic": stat if self.family.known_scale else stat / rank, "p_value": p})
        return out

    def predict(self, newdata: Frame | DataFrame | None = None, type: str = "response", se_fit: bool = False) -> Frame:  # noqa: A002
        """newdata with ``fit`` (and ``se_fit``) by "response" or "link", or with a column for each smooth by "terms"; nulls give null."""
        df = self.data if newdata is None else newdata.df if isinstance(newdata, Frame) else newdata
        d = design(self.formula, df, self.design.coded, self.design.factors)
        made = [F.struct(*[F.col(quote(c)) for c in df.columns]).alias("row")]
        rows = self._inputs(df, [*made, self.offset.cast("double").alias("o")], d.columns)
        beta, vcov, smooths, slices, parametric = self.beta, self.vcov, self.smooths, self.slices, len(self.design.columns)
        _, inverse_link, slope = _LINKS[self.family.link]
        names = [s.label for s in self.smooths] if type == "terms" else ["fit", *(["se_fit"] if se_fit else [])]

        def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                block = np.stack([c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in batch.columns[1:]], axis=1).astype(float) if batch.num_rows else np.zeros((0, batch.num_columns - 1))
                bad = np.isnan(block).any(axis=1)
                block = np.where(bad[:, None], 0.0, block)
                x = np.concatenate([_matrix(smooths, block[i : i + _ROWS], 1, parametric) for i in range(0, len(block), _ROWS)] or [np.zeros((0, len(beta)))])
                if type == "terms":
                    values = [x[:, w] @ beta[w] for w in slices]
                else:
                    eta = x @ beta + block[:, 0]
                    values = [eta if type == "link" else inverse_link(eta)]
                    if se_fit:
                        se = np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", x, vcov, x), 0))
                        values.append(se if type == "link" else se * np.abs(slope(eta)))
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, mask=bad) for v in values)], names=["row", *(f"v{i}" for i in range(len(values)))])

        ship(df.sparkSession)
        schema = f"row {rows.schema['row'].dataType.simpleString()}, " + ", ".join(f"v{i} double" for i in range(len(names)))
        out = rows.mapInArrow(over, schema)
        kept = [c for c in df.columns if c not in names]
        return Frame(out.select(*[F.col("row").getField(c).alias(c) for c in kept], *[F.col(f"v{i}").alias(c) for i, c in enumerate(names)]))

    def AIC(self, k: float = 2.0) -> float:  # noqa: N802
        fam = self.family.name
        if fam == "gaussian":
            return self.n * (math.log(2 * math.pi * self._deviance / self.n) + 1) + k * (self.edf_total + 1)
        if fam in ("poisson", "binomial"):
            rows = self.predict().df.select(self.y.alias("y"), self.w.alias("w"), F.col("fit"))
            return float(rows.agg(F.sum(_aic_term(self.family, F.col("fit")))).first()[0]) + k * self.edf_total
        return math.nan

    def __repr__(self) -> str:
        rows = [f"{r['term']:<24}{r['estimate']:>14.6g}{r['std_error']:>14.6g}{r['statistic']:>10.3f}{r['p_value']:>12.3g}" for r in self.coef_table()]
        smooths = [f"{r['term']:<24}{r['edf']:>14.4g}{r['ref_df']:>14}{r['statistic']:>10.3f}{r['p_value']:>12.3g}" for r in self.smooth_table()]
        return "\n".join([self.text, *rows, f"{'':<24}{'edf':>14}{'ref df':>14}{'stat':>10}{'p':>12}", *smooths, f"{self.method} {self.score:.6g}, scale {self.dispersion:.6g}, n {self.n}"])


def anova_gam(*models: gam) -> list[dict]:
    """One model: its tables of terms.  Several: deviances and tests of the changes, from the smallest to the largest."""
    if len(models) == 1:
        return [*models[0].coef_table(), *models[0].smooth_table()]
    fits = sorted(models, key=lambda m: m.edf_total)
    best = fits[-1]
    out: list[dict] = []
    for before, m in itertools.pairwise([None, *fits]):
        row = {"model": m.text, "resid_df": m.df_residual, "resid_dev": m.deviance()}
        if before is not None:
            df, change = m.edf_total - before.edf_total, before.deviance() - m.deviance()
            row |= {"df": df, "deviance": change}
            if df > 0:
                row["p_value"] = special.pchisq_upper(max(change, 0.0), df) if m.family.known_scale else special.pf_upper(max(change, 0.0) / df / best.dispersion, df, best.df_residual)
        out.append(row)
    return out
