"""Local regression of groups of any size.

A curve is worked out at some vertices: places at even ranks of the different
values of x and at even distances.  What a vertex needs are sums over rows (moments of x and y under
tricube weights), so a pass over the rows gives those of all vertices of all
groups, and no task holds a group.  The weights reach as far as the q-th
nearest row; its distance is found exactly, by counting distances in bins of a
bracket that shrinks to one value.  Between vertices the curve is cubic, with
the slopes of parabolas through three neighbouring vertices: the slope of a
local fit is not that of the curve, and cubics that take it lie several times
as far off.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import quote
from ..operators.frame import Frame
from ..operators.ranges import beside, quantiles
from ..plans.shared import cut
from ..plans.shipping import ship

#: Cells of even ranks, and as many of even width.
CELLS = 32
#: Bins that a bracket of distances is cut into in a pass.
BINS = 1024
#: Groups up to which their vertices are broadcast; more are joined to salted rows.
MOST_BROADCAST = 2000


def _beside(rows: DataFrame, groups: DataFrame, keys: Sequence[str], count: int, how: str = "inner") -> DataFrame:
    """rows with the columns of their group's row, which are more than a number or two."""
    return beside(rows, groups, keys, how, count <= MOST_BROADCAST)


def _spread(rows: DataFrame, vertices: DataFrame, keys: Sequence[str], columns: Sequence[str], count: int) -> DataFrame:
    """A row for each row and vertex of its group; ``columns`` are those of the vertices."""
    arrays = vertices.groupBy(*keys).agg(F.collect_list(F.struct(*columns)).alias("__at"))
    return _beside(rows, arrays, keys, count).select(*rows.columns, F.inline("__at"))


def _reaches(rows: DataFrame, vertices: DataFrame, keys: Sequence[str], count: int) -> DataFrame:
    """(keys, v, h): the distance of each vertex's q-th nearest row, which the bracket from lo to hi holds."""
    group = [*keys, "v", "q", "below"]
    left, found = cut(vertices), None
    while True:
        d = F.abs(F.col("x") - F.col("v"))
        near = _spread(rows.select(*keys, "x", "c"), left, keys, ["v", "q", "below", "lo", "hi"], count).withColumn("d", d).where("d BETWEEN lo AND hi")
        # a bin is a growing function of the distance, so one bin's least and largest distances bound a bracket that holds its rows and no others
        place = F.when(F.col("lo") == F.col("hi"), F.lit(0)).otherwise(F.least(F.lit(BINS - 1), F.floor((F.col("d") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS)))
        counts = near.groupBy(*group, place.alias("bin")).agg(F.sum("c").alias("c"), F.min("d").alias("lo"), F.max("d").alias("hi"))
        upto = F.sum("c").over(Window.partitionBy(*group).orderBy("bin")) + F.col("below")
        chosen = counts.withColumn("upto", upto).where("upto >= q AND upto - c < q")
        narrowed = cut(chosen.select(*keys, "v", "q", (F.col("upto") - F.col("c")).alias("below"), "lo", "hi"))
        settled = narrowed.where("lo = hi").select(*keys, "v", F.col("lo").alias("h"))
        found = settled if found is None else found.unionByName(settled)
        left = narrowed.where("lo < hi")
        if left.isEmpty():
            return found


def solve(moments: np.ndarray, degree: int) -> np.ndarray:
    """The fit's value at each vertex; where x doesn't tell coefficients apart, from the shortest ones."""
    k = np.arange(degree + 1)
    gram, cross = moments[:, k[:, None] + k[None, :]], moments[:, 2 * degree + 1 :]
    return np.einsum("mj,mj->m", np.linalg.pinv(gram, rcond=1e-13, hermitian=True)[:, 0], cross)


def _sloped(points: str) -> Column:
    """The points (v, f) with the slope at each of the parabola through it and its neighbours, or the nearest three."""
    size = F.size(points)

    def of(p: Column, i: Column) -> Column:
        first = F.greatest(F.lit(1), F.least(i, size - 2))  # the first of the three, counted from 1
        a, b, c = (F.element_at(points, F.least(first + k, size)) for k in range(3))
        one, two = (b["f"] - a["f"]) / (b["v"] - a["v"]), (c["f"] - b["f"]) / (c["v"] - b["v"])
        bent = one + (two - one) / (c["v"] - a["v"]) * (2 * p["v"] - a["v"] - b["v"])
        return F.struct(p["v"].alias("v"), p["f"].alias("f"), F.when(size >= 3, bent).when(size == 2, one).otherwise(0.0).alias("s"))

    return F.transform(points, of)


def _curves(rows: DataFrame, vertices: DataFrame, keys: Sequence[str], degree: int, count: int) -> DataFrame:
    """(keys, curve): each group's vertices with values and slopes, in their order."""
    near = _spread(rows.select(*keys, "x", "w", "wy"), vertices, keys, ["v", "h"], count).withColumn("u", (F.col("x") - F.col("v")) / F.col("h")).where("abs(u) < 1")
    tricube = F.pow(1 - F.pow(F.abs("u"), F.lit(3.0)), F.lit(3.0))

    def moment(k: int, of: str) -> Column:
        power = F.lit(1.0)
        for _ in range(k):
            power = power * F.col("u")
        return F.sum(tricube * power * F.col(of))

    sums = [moment(k, "w") for k in range(2 * degree + 1)] + [moment(k, "wy") for k in range(degree + 1)]
    local = near.groupBy(*keys, "v", "h").agg(F.array(*sums).alias("m"))

    @F.pandas_udf("double")
    def fit(m: pd.Series) -> pd.Series:
        return pd.Series(solve(np.stack(m.to_numpy()), degree) if len(m) else [])

    points = local.select(*keys, F.struct("v", fit("m").alias("f")).alias("p")).groupBy(*keys).agg(F.sort_array(F.collect_list("p")).alias("points"))
    return cut(points.select(*keys, _sloped("points").alias("curve")))


def blended(x: Column) -> Column:
    """The curve at x, from the column ``curve``."""
    size = F.size("curve")
    at = F.greatest(F.lit(1), F.least(size - 1, F.size(F.filter("curve", lambda p: p["v"] <= x))))
    a, b = F.element_at("curve", at), F.element_at("curve", F.least(at + 1, size))
    width = b["v"] - a["v"]
    t = (x - a["v"]) / width
    inside = a["f"] * (2 * t * t * t - 3 * t * t + 1) + b["f"] * (3 * t * t - 2 * t * t * t) + width * (a["s"] * (t * t * t - 2 * t * t + t) + b["s"] * (t * t * t - t * t))
    return F.when(size == 1, F.col("curve")[0]["f"]).otherwise(inside)


class LocalSurface:
    """Curves of all groups of ``df``, which has the columns x and y and keys of any type.

    Rows in which x or y is missing or infinite take no part.  ``places`` are
    the shares of the range of x at which vertices stand, None for the ends of
    ``cells`` cells of even ranks and of as many of even width.  ``symmetric`` weighs residuals from the curve down by Tukey's
    biweight and fits again; groups whose residuals' median is zero keep the rows that fit.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], span: float = 0.75, degree: int = 2, family: str = "gaussian", iterations: int = 4, cells: int = CELLS, places: Sequence[float] | None = None):
        if degree not in (0, 1, 2) or span <= 0 or cells < 1 or family not in ("gaussian", "symmetric"):
            raise ValueError("degree is 0, 1 or 2, span and cells are positive, family is gaussian or symmetric")
        ship(df.sparkSession)
        self.names = list(keys)
        self.keys = [f"__k{i}" for i in range(len(self.names))]
        keys = self.keys
        x, y = F.col("x").cast("double"), F.col("y").cast("double")
        pairs = df.select(*[F.col(quote(c)).alias(k) for c, k in zip(self.names, keys, strict=True)], x.alias("x"), y.alias("y")).where("abs(x) < double('inf') AND abs(y) < double('inf')")
        robust = family == "symmetric"
        if robust:
            rows = cut(pairs).select("*", F.lit(1).alias("c"), F.lit(1.0).alias("w"), F.col("y").alias("wy"))
        else:  # equal x of a group are one row: their count and sum are all that is needed
            rows = cut(pairs.groupBy(*keys, "x").agg(F.count(F.lit(1)).alias("c"), F.count(F.lit(1)).cast("double").alias("w"), F.sum("y").alias("wy")))
        self.groups = cut(rows.groupBy(*keys).agg(F.sum("c").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")))
        self.count = self.groups.count()
        q = F.least(F.col("n"), F.greatest(F.lit(degree + 1), F.floor(F.col("n") * span + 1e-5)))
        ends = [i / cells for i in range(cells + 1)]
        shares = F.array(*[F.lit(float(s)) for s in (ends if places is None else places)])
        at = self.groups.withColumn("vs", F.transform(shares, lambda s: F.col("low") + s * (F.col("high") - F.col("low"))))
        if places is None:
            ranks = quantiles(rows.select(*keys, "x").distinct(), "x", ends, keys).select(*keys, F.col("q").alias("ranks"))
            at = _beside(at, ranks, keys, self.count).withColumn("vs", F.concat("vs", "ranks"))
        # vertices that rounding alone tells apart would make slopes of noise
        near = F.expr("array_sort(vs)")
        far = F.filter(near, lambda v, i: (i == 0) | (v - F.element_at(near, F.greatest(i, F.lit(1))) > (F.col("high") - F.col("low")) * 1e-6))
        at = at.withColumn("vs", F.array_distinct(near if places is not None else far))
        vertices = at.select(*keys, q.alias("q"), F.lit(0).cast("bigint").alias("below"), "low", "high", F.explode("vs").alias("v"))
        vertices = vertices.withColumn("hi", F.greatest(F.abs(F.col("v") - F.col("low")), F.abs(F.col("high") - F.col("v")))).withColumn("lo", F.lit(0.0)).drop("low", "high")
        reach = F.col("h") * max(span, 1.0)
        reached = cut(_reaches(rows, vertices, keys, self.count).select(*keys, "v", F.when(reach > 0, reach).otherwise(1e-12).alias("h"))) if self.count else vertices.withColumn("h", F.col("hi"))
        self.curves = _curves(rows, reached, keys, degree, self.count)
        for _ in range(iterations - 1 if robust else 0):
            off = F.col("y") - blended(F.col("x"))
            residuals = _beside(rows.drop("w", "wy"), self.curves, keys, self.count).withColumn("r", off).drop("curve")
            middle = quantiles(residuals.withColumn("r", F.abs("r")), "r", [0.5], keys).select(*keys, F.greatest(6 * F.col("q")[0], F.lit(1e-12)).alias("scale"))
            weight = F.pow(F.greatest(1 - F.pow(F.col("r") / F.col("scale"), F.lit(2.0)), F.lit(0.0)), F.lit(2.0))
            weighed = _beside(residuals, cut(middle), keys, self.count).withColumn("w", weight).withColumn("wy", F.col("w") * F.col("y"))
            self.curves = _curves(weighed, reached, keys, degree, self.count)

    def at(self, rows: DataFrame, name: str, x: Column) -> DataFrame:
        """rows, which hold the keys under their own names, with the curve at x; rows of other groups get null."""
        marked = rows.select("*", *[F.col(quote(c)).alias(k) for c, k in zip(self.names, self.keys, strict=True)], x.cast("double").alias("__x"))
        known = self.groups.select(*self.keys, F.col("low").alias("__low"), F.col("high").alias("__high"))
        curves = _beside(self.curves, known, self.keys, self.count)
        joined = _beside(marked, curves, self.keys, self.count, "left")
        value = F.when(F.col("__x").between(F.col("__low"), F.col("__high")), blended(F.col("__x")))
        return joined.withColumn(name, value).drop("curve", "__x", "__low", "__high", *self.keys)

    def grid(self, n: int, direct: bool) -> DataFrame:
        """(keys, x, y): each group's curve at n even places, the vertices themselves where they are ``direct``."""
        named = [F.col(k).alias(c) for c, k in zip(self.names, self.keys, strict=True)]
        if direct:
            return self.curves.select(*self.keys, F.explode("curve").alias("p")).select(*named, F.col("p.v").alias("x"), F.col("p.f").alias("y"))
        share = F.explode(F.array(*[F.lit(i / max(n - 1, 1)) for i in range(n)]))
        places = self.groups.select(*named, "low", "high", share.alias("t")).select(*self.names, F.least(F.col("low") + F.col("t") * (F.col("high") - F.col("low")), F.col("high")).alias("x"))
        return self.at(places, "y", F.col("x"))


def loess_fit(frame: Frame, x: str, y: str, by: Sequence[str] = (), span: float = 0.75, degree: int = 2, family: str = "gaussian", cells: int = CELLS) -> Frame:
    """The frame with ``.fitted`` and ``.resid`` of a local regression of y on x in each group, of any size; null where x is missing."""
    chosen = frame.df.select(*[F.col(quote(k)) for k in by], F.col(quote(x)).alias("x"), F.col(quote(y)).alias("y")) if not {"x", "y"} & set(by) else None
    if chosen is None:
        raise ValueError("a key can't be named x or y")
    surface = LocalSurface(chosen, by, span, degree, family, cells=cells)
    made = surface.at(frame.df, ".fitted", F.col(quote(x)))
    return frame._new(made.withColumn(".resid", F.col(quote(y)).cast("double") - F.col("`.fitted`")))
