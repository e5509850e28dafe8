"""Local and bootstrap fits; groups of bounded size are fitted where their rows are, larger ones from moments at vertices."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import quote
from ..operators.frame import Frame
from ..operators.ranges import beside
from ..plans.shared import cut
from ..plans.shipping import ship
from .vertices import LocalSurface

#: Cells of rows that a bootstrap weighs.
CELLS = 1024
#: Rows of a group up to which it is fitted by one task.
MOST_ROWS = 100_000


def local_fit(x: np.ndarray, y: np.ndarray, at: np.ndarray, span: float = 0.75, degree: int = 2, weights: np.ndarray | None = None) -> np.ndarray:
    """Weighted polynomials about each point, tricube weights over the nearest share of the values."""
    n = len(x)
    q = min(n, max(degree + 1, int(np.floor(span * n + 1e-5))))
    prior = np.ones(n) if weights is None else weights
    out = np.empty(len(at))
    for i, p in enumerate(at):
        distance = np.abs(x - p)
        reach = np.partition(distance, q - 1)[q - 1]
        reach = reach * (span if span > 1 else 1.0) or 1e-12
        w = np.clip(1 - (distance / reach) ** 3, 0, None) ** 3 * prior
        use = w > 0
        basis = np.vander(x[use] - p, degree + 1, increasing=True)
        root = np.sqrt(w[use])
        out[i] = np.linalg.lstsq(basis * root[:, None], y[use] * root, rcond=None)[0][0]
    return out


def loess(x: np.ndarray, y: np.ndarray, at: np.ndarray | None = None, span: float = 0.75, degree: int = 2, family: str = "gaussian", iterations: int = 4) -> np.ndarray:
    """Local regression; ``symmetric`` weighs residuals down by Tukey's biweight and fits again."""
    at = x if at is None else at
    weights = np.ones(len(x))
    for _ in range(iterations - 1 if family == "symmetric" else 0):
        residual = y - local_fit(x, y, x, span, degree, weights)
        scale = 6 * np.median(np.abs(residual)) or 1e-12
        weights = np.clip(1 - (residual / scale) ** 2, 0, None) ** 2
    return local_fit(x, y, at, span, degree, weights)


def stat_smooth(
    frame: Frame, x: str, y: str, by: Sequence[str] = (), n: int = 80, span: float = 0.75, degree: int = 2, family: str = "gaussian", surface: str = "interpolate", most_rows: int = MOST_ROWS
) -> Frame:
    """A loess curve on n points for each group.

    Groups of at most ``most_rows`` rows are fitted where their rows are, at
    each point; larger ones from local moments at vertices (see ``vertices``):
    the points themselves with surface="direct", else fewer, and cubics between.
    """
    if surface not in ("interpolate", "direct"):
        raise ValueError("surface is interpolate or direct")
    keys = list(by)
    if {"x", "y"} & set(keys):
        raise ValueError("a key can't be named x or y")
    df = frame.df.select(*map(quote, keys), F.col(quote(x)).cast("double").alias("x"), F.col(quote(y)).cast("double").alias("y")).where("abs(x) < double('inf') AND abs(y) < double('inf')")
    ship(df.sparkSession)
    sizes = cut(df.groupBy(*map(quote, keys)).agg(F.count(F.lit(1)).alias("__n")))
    least, largest = (size or 0 for size in sizes.agg(F.min("__n"), F.max("__n")).first())

    def of_size(rows: DataFrame, fits: Column) -> DataFrame:
        return beside(rows, cut(sizes.where(fits).select(*map(quote, keys))), keys, "left_semi") if keys else rows

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf["x"].to_numpy(), pdf["y"].to_numpy()
        grid = np.linspace(a.min(), a.max(), n)
        out = pd.DataFrame({"x": grid, "y": loess(a, b, grid, span, degree, family)})
        for name, value in zip(keys, key, strict=False):
            out[name] = value
        return out[[*keys, "x", "y"]]

    small = df if largest <= most_rows else of_size(df, F.col("__n") <= most_rows) if least <= most_rows else df.limit(0)
    kinds = "".join(f"{quote(c)} {frame.df.schema[c].dataType.simpleString()}, " for c in keys)
    curves = (small.groupBy(*map(quote, keys)) if keys else small.withColumn("__all", F.lit(1)).groupBy("__all")).applyInPandas(fit, f"{kinds}x double, y double")
    if largest > most_rows:
        places = [i / max(n - 1, 1) for i in range(n)] if surface == "direct" else None
        large = LocalSurface(of_size(df, F.col("__n") > most_rows) if least <= most_rows else df, keys, span, degree, family, places=places)
        made = large.grid(n, surface == "direct")
        curves = curves.unionByName(made) if keys else made
    return frame._new(curves, [("x", False)])


def lowess(x: np.ndarray, y: np.ndarray, frac: float = 2 / 3, it: int = 3) -> np.ndarray:
    """Locally linear, with ``it`` rounds of robust weights."""
    return loess(x, y, None, frac, 1, "symmetric", it + 1)


def mean_cl_boot(frame: Frame, x: str, y: str, conf: float = 0.95, reps: int = 1000, seed: int = 0) -> Frame:
    """Bootstrap limits of each group's mean by Poisson weights, one aggregate for all rounds: rows never leave their tasks."""
    c = F.col(quote(y)).cast("double")
    rows = frame.df.where(c.isNotNull()).select(F.col(quote(x)).alias("k"), c.alias("v"), F.monotonically_increasing_id().alias("i"))
    # resampling the sums of many small cells of rows at random stands for resampling rows
    cells = rows.groupBy("k", F.pmod(F.xxhash64("i"), F.lit(CELLS)).alias("cell")).agg(F.sum("v").alias("s"), F.count("v").alias("n"))
    spread = cells.select("k", "s", "n", "cell", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("round"))
    u = F.pmod(F.xxhash64("cell", "round", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    weight = F.lit(8)
    for value in range(7, -1, -1):  # Poisson(1) by its distribution function
        limit = math.exp(-1) * sum(1 / math.factorial(m) for m in range(value + 1))
        weight = F.when(u < limit, F.lit(value)).otherwise(weight)
    means = spread.withColumn("w", weight).groupBy("k", "round").agg((F.sum(F.col("w") * F.col("s")) / F.sum(F.col("w") * F.col("n"))).alias("m"))
    tails = F.percentile("m", F.array(F.lit((1 - conf) / 2), F.lit((1 + conf) / 2))).alias("q")
    limits = means.groupBy("k").agg(tails)
    whole = rows.groupBy("k").agg(F.avg("v").alias("y"))
    return frame._new(whole.join(limits, "k").select(F.col("k").alias(x), "y", F.col("q")[0].alias("ymin"), F.col("q")[1].alias("ymax")), ())
