"""Spline bases as piecewise polynomials: one table of coefficients, evaluated as Spark columns or as arrays.

A basis is fixed by its knots.  What it is between two knots is worked out once
on the driver, from the recursion over the degree; rows then cost a choice of
the piece and a polynomial, inside the generated code.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import ranges


@dataclass
class Pieces:
    """Functions that are polynomials between edges: ``coefs[piece, function, power]`` of x less the piece's origin."""

    edges: np.ndarray
    origins: np.ndarray
    coefs: np.ndarray

    def array(self, x: np.ndarray) -> np.ndarray:
        """[row, function]; not-a-number stays so."""
        piece = np.searchsorted(self.edges, x, "right")
        t = x - self.origins[piece]
        out = np.zeros((len(x), self.coefs.shape[1]))
        for power in range(self.coefs.shape[2] - 1, -1, -1):
            out = out * t[:, None] + self.coefs[piece, :, power]
        return out

    def columns(self, x: Column) -> list[Column]:
        """One column a function; null where x is null."""
        out = []
        for f in range(self.coefs.shape[1]):
            made = None
            for k in range(len(self.origins)):
                value = self._polynomial(x, k, f)
                if k == len(self.edges):
                    made = value if made is None else made.otherwise(value)
                else:
                    test = x < F.lit(float(self.edges[k]))
                    made = F.when(test, value) if made is None else made.when(test, value)
            out.append(F.when(x.isNotNull(), made))
        return out

    def _polynomial(self, x: Column, piece: int, f: int) -> Column:
        c = self.coefs[piece, f]
        last = int(np.flatnonzero(c)[-1]) if c.any() else 0
        out = F.lit(float(c[last]))
        t = x - F.lit(float(self.origins[piece]))
        for power in range(last - 1, -1, -1):
            out = out * t + F.lit(float(c[power]))
        return out

    def rotated(self, by: np.ndarray) -> Pieces:
        """The functions combined by the columns of a matrix."""
        return Pieces(self.edges, self.origins, np.einsum("pfk,fg->pgk", self.coefs, by))

    def at(self, x: float, derivative: int = 0, piece: int | None = None) -> np.ndarray:
        """The derivative of each function at a place, seen from a piece."""
        k = int(np.searchsorted(self.edges, x, "right")) if piece is None else piece
        c = self.coefs[k]
        for _ in range(derivative):
            c = c[:, 1:] * np.arange(1, c.shape[1])
        return c @ (x - self.origins[k]) ** np.arange(c.shape[1]) if c.shape[1] else np.zeros(len(c))

    def linear_outside(self, low: float, high: float) -> Pieces:
        """The same between two places, with straight lines outside."""
        ends = []
        for x, piece in ((low, 0), (high, len(self.origins) - 1)):
            line = np.zeros(self.coefs.shape[1:])
            line[:, 0], line[:, 1] = self.at(x, 0, piece), self.at(x, 1, piece)
            ends.append(line)
        return Pieces(np.concatenate([[low], self.edges, [high]]), np.concatenate([[low], self.origins, [high]]), np.concatenate([ends[:1], self.coefs, ends[1:]]))


def b_splines(knots: np.ndarray, degree: int) -> Pieces:
    """All B-splines of a knot vector, on the intervals where they sum to one; outside, the end pieces go on."""
    knots = np.asarray(knots, dtype=float)
    n = len(knots) - degree - 1
    breaks = np.unique(knots[degree : len(knots) - degree])
    coefs = np.zeros((len(breaks) - 1, n, degree + 1))
    for s, a in enumerate(breaks[:-1]):
        start = int(np.searchsorted(knots, a, "right")) - 1
        made = {start: np.array([1.0])}
        for d in range(1, degree + 1):
            new = {}
            for i in range(start - d, start + 1):
                total = np.zeros(d + 1)
                if i in made and knots[i + d] > knots[i]:
                    total += np.convolve(made[i], [a - knots[i], 1.0]) / (knots[i + d] - knots[i])
                if i + 1 in made and knots[i + d + 1] > knots[i + 1]:
                    total += np.convolve(made[i + 1], [knots[i + d + 1] - a, -1.0]) / (knots[i + d + 1] - knots[i + 1])
                new[i] = total
            made = new
        for i, c in made.items():
            if 0 <= i < n:
                coefs[s, i] = c
    return Pieces(breaks[1:-1], breaks[:-1], coefs)


def natural_splines(inner: list[float], ends: tuple[float, float], intercept: bool) -> Pieces:
    """Cubic splines that are straight at and outside the end knots."""
    low, high = ends
    whole = b_splines(np.array([low] * 4 + sorted(inner) + [high] * 4), 3)
    keep = np.eye(whole.coefs.shape[1])[:, 0 if intercept else 1 :]
    kept = whole.rotated(keep)
    bends = np.stack([kept.at(low, 2, 0), kept.at(high, 2, len(kept.origins) - 1)], axis=1)
    q, _ = np.linalg.qr(bends, mode="complete")
    return kept.rotated(q[:, 2:]).linear_outside(low, high)


def roughness(p: Pieces) -> np.ndarray:
    """The integrals of products of second derivatives, of functions that are cubic between edges and straight outside."""
    n = p.coefs.shape[1]
    out = np.zeros((n, n))
    for k in range(1, len(p.origins) - 1):
        h = p.edges[k] - p.edges[k - 1]
        a, b = 2 * p.coefs[k, :, 2], 2 * p.coefs[k, :, 2] + 6 * p.coefs[k, :, 3] * h
        out += h / 6 * (2 * np.outer(a, a) + np.outer(a, b) + np.outer(b, a) + 2 * np.outer(b, b))
    return out


# ---------------------------------------------------------------- bs() and ns() in formulas
def arguments(text: str) -> tuple[list[str], dict[str, str]]:
    """Positional and named arguments of ``f(a, b=c(1, 2))``, as texts."""
    inner, depth, parts, start = text[text.index("(") + 1 : -1], 0, [], 0
    for i, c in enumerate(inner + ","):
        depth += {"(": 1, ")": -1}.get(c, 0)
        if c == "," and not depth:
            parts.append(inner[start:i].strip())
            start = i + 1
    found = [re.fullmatch(r"([A-Za-z_.][\w.]*)\s*=(?!=)\s*(.*)", p, re.S) for p in parts]
    return [p for p, m in zip(parts, found, strict=True) if p and not m], {m[1]: m[2] for m in found if m}


def numbers(text: str) -> list[float]:
    """``3`` or ``c(1, 2.5)``."""
    inner = re.fullmatch(r"c\((.*)\)", text.strip())
    return [float(v) for v in (inner[1] if inner else text).split(",")]


def formula_basis(kind: str, df: DataFrame, x: Column, given: dict[str, str]) -> Pieces:
    """The basis of ``bs(x, df, knots, degree, intercept, Boundary.knots)`` or ``ns(x, df, knots, intercept, Boundary.knots)``.

    Inner knots are quantiles of the values of x unless given; the ends are
    its least and largest value.  Outside the ends, the polynomials of bs() go
    on as they are, those of ns() as straight lines.
    """
    known = {"df", "knots", "intercept", "Boundary.knots", *(["degree"] if kind == "bs" else [])}
    if set(given) - known:
        raise ValueError(f"{kind}() has no argument {', '.join(sorted(set(given) - known))}")
    degree = int(given.get("degree", 3)) if kind == "bs" else 3
    intercept = given.get("intercept", "FALSE") in ("TRUE", "True", "T")
    values = df.select(x.alias("v")).where("v is not null and not isnan(v)")
    if "Boundary.knots" in given:
        low, high = sorted(numbers(given["Boundary.knots"]))
    else:
        low, high = values.agg(F.min("v"), F.max("v")).first()
        if low is None or low == high:
            raise ValueError(f"{kind}() needs at least two different values")
    if "knots" in given:
        inner = sorted(numbers(given["knots"]))
    else:
        n = int(float(given["df"])) - (degree + intercept if kind == "bs" else 1 + intercept) if "df" in given else 0
        if n < 0:
            raise ValueError(f"{kind}() needs a df of at least {degree + intercept if kind == 'bs' else 1 + intercept}")
        inner = ranges.quantiles(values, "v", [(i + 1) / (n + 1) for i in range(n)]).first()[0] if n else []
    if any(not low < k < high for k in inner):
        raise ValueError("inner knots must lie between the ends")
    if kind == "ns":
        return natural_splines(inner, (low, high), intercept)
    whole = b_splines(np.array([low] * (degree + 1) + list(inner) + [high] * (degree + 1)), degree)
    return whole if intercept else whole.rotated(np.eye(whole.coefs.shape[1])[:, 1:])
