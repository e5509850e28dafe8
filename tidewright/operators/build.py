"""Plot layers as plans: mapping, grouping, scale transforms, statistic, position and panel, for each layer one lazy frame.

Nothing is drawn.  A built layer has the columns PANEL and group, its
aesthetics, and what its statistic computes; ranges of the scales come from
one aggregate for each layer.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import Expr, as_expr, col, quote
from ..plans.shared import cut
from . import layers as stats
from .frame import NUMERIC, Frame
from .ranges import beside, quantiles

#: Aesthetics whose discrete values make groups.
GROUPING = ("colour", "fill", "shape", "linetype")


@dataclass(frozen=True)
class Deferred:
    """An expression over what a statistic (or a scale) has made."""

    expression: Expr
    stage: str


def after_stat(expression: Any) -> Deferred:
    return Deferred(col(expression) if isinstance(expression, str) else as_expr(expression), "stat")


def after_scale(expression: Any) -> Deferred:
    return Deferred(col(expression) if isinstance(expression, str) else as_expr(expression), "scale")


def aes(x: Any = None, y: Any = None, **others: Any) -> dict[str, Any]:
    """Aesthetics by name: a column's name, an expression, or one of after_stat() and after_scale()."""
    return {k: v for k, v in {"x": x, "y": y, **others}.items() if v is not None}


@dataclass(frozen=True)
class Layer:
    stat: str = "identity"
    position: str = "identity"
    mapping: dict[str, Any] = field(default_factory=dict)
    data: Frame | None = None
    params: dict[str, Any] = field(default_factory=dict)
    inherit: bool = True


@dataclass(frozen=True)
class Scale:
    """A transform of a position aesthetic, and the limits beyond which values are nulls."""

    transform: str = "identity"
    limits: tuple[float, float] | None = None

    def forward(self, c: Column) -> Column:
        return {"identity": lambda v: v, "log10": F.log10, "sqrt": F.sqrt, "reverse": lambda v: -v}[self.transform](c)


@dataclass(frozen=True)
class Plot:
    data: Frame
    mapping: dict[str, Any] = field(default_factory=dict)
    layers: tuple[Layer, ...] = ()
    scales: dict[str, Scale] = field(default_factory=dict)
    facets: tuple[str, ...] = ()

    def add(self, layer: Layer) -> Plot:
        return replace(self, layers=(*self.layers, layer))

    def scale(self, aesthetic: str, transform: str = "identity", limits: tuple[float, float] | None = None) -> Plot:
        return replace(self, scales={**self.scales, aesthetic: Scale(transform, limits)})

    def facet(self, *by: str) -> Plot:
        return replace(self, facets=by)


@dataclass(frozen=True)
class Built:
    """The frame of each layer, and (panel, aesthetic, low, high) of the continuous positions."""

    layers: list[Frame]
    ranges: DataFrame | None


def ggplot(data: Frame, mapping: dict[str, Any] | None = None, **aesthetics: Any) -> Plot:
    return Plot(data, {**(mapping or {}), **aesthetics})


def compute_aesthetics(data: Frame, mapping: dict[str, Any], facets: tuple[str, ...]) -> Frame:
    """The mapped columns alone, and those that panels need."""
    now = {k: v for k, v in mapping.items() if not isinstance(v, Deferred)}
    keep = {f"__facet{i}": col(c) for i, c in enumerate(facets)}
    return data.select(**{k: (col(v) if isinstance(v, str) else as_expr(v)) for k, v in now.items()}, **keep)


def _numbered(df: DataFrame, keys: list[str], name: str, first: int = 1) -> DataFrame:
    """df with the place of its combination of keys among those that occur."""
    found = df.select(*map(quote, keys)).distinct()
    numbers = cut(found.withColumn(name, F.row_number().over(Window.orderBy(*map(quote, keys))) + (first - 1)))
    return beside(df, numbers, keys).select(*[F.col(quote(c)) for c in df.columns], name)


def add_group(df: DataFrame) -> DataFrame:
    """A number for each combination of discrete grouping aesthetics (or the mapped group itself); -1 without any."""
    if "group" in df.columns:
        return _numbered(df.withColumnRenamed("group", "__g"), ["__g"], "group").drop("__g")
    keys = [c for c in GROUPING if c in df.columns and not isinstance(df.schema[c].dataType, NUMERIC)]
    keys += [c for c in ("x",) if c in df.columns and isinstance(df.schema[c].dataType, T.StringType | T.BooleanType)]
    return _numbered(df, keys, "group") if keys else df.withColumn("group", F.lit(-1))


def apply_limits(df: DataFrame, scales: dict[str, Scale]) -> DataFrame:
    for name, scale in scales.items():
        if scale.limits and name in df.columns:
            low, high = scale.limits
            df = df.withColumn(name, F.when(F.col(name).between(low, high), F.col(name)))
    return df


def transform_positions(df: DataFrame, scales: dict[str, Scale]) -> DataFrame:
    """Positions on their scale: statistics see transformed values."""
    for name, scale in scales.items():
        if name in df.columns and scale.transform != "identity":
            df = df.withColumn(name, scale.forward(F.col(name).cast("double")))
    return df


def transform_made(df: DataFrame, scales: dict[str, Scale], before: list[str]) -> DataFrame:
    """Positions that the statistic made, on their scale, where nothing was mapped to their axis before it."""
    for name, scale in scales.items():
        if name in ("x", "y") and scale.transform != "identity" and name not in before:
            for c in (name, f"{name}min", f"{name}max", f"{name}end"):
                if c in df.columns:
                    df = df.withColumn(c, scale.forward(F.col(c).cast("double")))
    return df


def drop_missing(df: DataFrame) -> DataFrame:
    """Rows with all of their aesthetics; NaN is none."""
    for c in df.columns:
        if c not in ("PANEL", "group"):
            df = df.where(F.col(quote(c)).isNotNull() & (~F.isnan(quote(c)) if isinstance(df.schema[c].dataType, T.FloatType | T.DoubleType) else F.lit(True)))
    return df


def _density(frame: Frame, keys: list[str], n: int = 512) -> Frame:
    """Densities of x for each group on the grid of all x, each with its own bandwidth."""
    own = stats._group_bandwidths(frame, "x", keys)
    low, high = frame.df.agg(F.min("x").cast("double"), F.max("x").cast("double")).first()
    rows = frame.df.select(*map(quote, keys), F.col("x").cast("double").alias("v"))
    points = stats._spread(beside(rows, own.select(*map(quote, keys), "low", "high"), keys), keys, n)
    grid = own.select(*map(quote, keys), "m", "h", F.lit(low).alias("start"), F.lit((high - low) / (n - 1)).alias("step"))
    out = stats._kernel_sums(points, grid, keys, n)
    return Frame(out.select(*map(quote, keys), F.col("at").alias("x"), "density", (F.col("density") * F.col("m")).alias("count")))


def _boxplot(frame: Frame, keys: list[str], **params: Any) -> Frame:
    return stats.stat_boxplot(frame, "y", [*keys, *(["x"] if "x" in frame.columns and "x" not in keys else [])], **params)


def _summary(frame: Frame, keys: list[str], mult: float = 1.0) -> Frame:
    c = F.col("y").cast("double")
    out = frame.df.groupBy(*map(quote, keys), "x").agg(F.avg(c).alias("mean"), (F.stddev_samp(c) / F.sqrt(F.count(c)) * mult).alias("se"))
    return Frame(out.select(*map(quote, keys), "x", F.col("mean").alias("y"), (F.col("mean") - F.col("se")).alias("ymin"), (F.col("mean") + F.col("se")).alias("ymax")))


def _count(frame: Frame, keys: list[str]) -> Frame:
    out = frame.df.groupBy(*map(quote, keys), *([] if "x" in keys else ["x"])).agg(F.count(F.lit(1)).alias("count"))
    return Frame(out.withColumn("prop", F.col("count") / F.sum("count").over(Window.partitionBy("PANEL", "group"))))


def _bin(frame: Frame, keys: list[str], **params: Any) -> Frame:
    out = stats.stat_bin(frame, "x", group=keys, **params)
    return Frame(out.df.withColumn("x", (F.col("xmin") + F.col("xmax")) / 2))


def _quantile(frame: Frame, keys: list[str], probs: tuple[float, ...] = (0.25, 0.5, 0.75)) -> Frame:
    q = quantiles(frame.df, "y", probs, keys)
    return Frame(q.select(*map(quote, keys), F.posexplode("q").alias("i", "y")).withColumn("quantile", F.element_at(F.array(*[F.lit(float(p)) for p in probs]), F.col("i") + 1)).drop("i"))


STATS: dict[str, Callable[..., Frame]] = {
    "identity": lambda frame, keys: frame, "unique": lambda frame, keys: frame.distinct(), "count": _count, "bin": _bin, "boxplot": _boxplot, "summary": _summary, "density": _density, "quantile": _quantile,
    "ecdf": lambda frame, keys: stats.stat_ecdf(frame, "x", keys), "sum": lambda frame, keys: Frame(frame.df.groupBy(*map(quote, keys), "x", "y").agg(F.count(F.lit(1)).alias("n"))),
}
#: What a statistic puts on an axis that nothing is mapped to.
DEFAULT_Y = {"count": "count", "bin": "count", "density": "density", "ecdf": "ecdf"}


def place(df: DataFrame, position: str, width: float = 0.9, amount: float = 0.4, seed: int | None = None, x: float = 0.0, y: float = 0.0) -> DataFrame:
    """Positions within a panel: bars on top of each other (stack, fill), side by side (dodge), moved at random (jitter) or by a step (nudge)."""
    if position in ("stack", "fill"):
        w = Window.partitionBy("PANEL", "x")
        top = F.sum("y").over(w.orderBy(F.col("group").desc()).rowsBetween(Window.unboundedPreceding, 0))
        out = df.withColumn("ymax", top).withColumn("ymin", top - F.col("y"))
        if position == "fill":
            total = F.sum("y").over(w)
            out = out.withColumn("ymax", F.try_divide("ymax", total)).withColumn("ymin", F.try_divide("ymin", total))
        return out.withColumn("y", F.col("ymax"))
    if position == "dodge":
        w = Window.partitionBy("PANEL", "x")
        size = F.size(F.collect_set("group").over(w))
        rank = F.dense_rank().over(w.orderBy("group"))
        at = F.dense_rank().over(Window.partitionBy("PANEL").orderBy("x")).cast("double") if isinstance(df.schema["x"].dataType, T.StringType) else F.col("x").cast("double")
        return df.withColumn("__at", at).withColumn("__x", F.col("__at") + (rank - 0.5) * width / size - width / 2).drop("x", "__at").withColumnRenamed("__x", "x")
    if position == "jitter":
        return df.withColumn("x", F.col("x") + (F.rand(seed) * 2 - 1) * amount)
    if position == "nudge":
        return df.withColumn("x", F.col("x") + x).withColumn("y", F.col("y") + y)
    if position != "identity":
        raise ValueError(f"unknown position {position}")
    return df


def build_layer(plot: Plot, layer: Layer) -> Frame:
    """A layer's rows: aesthetics, panels and groups, limits, transforms, missing rows, statistic, deferred mappings, position."""
    mapping = {**(plot.mapping if layer.inherit else {}), **layer.mapping}
    df = compute_aesthetics(layer.data or plot.data, mapping, plot.facets).df
    facets = [f"__facet{i}" for i in range(len(plot.facets))]
    df = _numbered(df, facets, "PANEL").drop(*facets) if facets else df.withColumn("PANEL", F.lit(1))
    df = drop_missing(transform_positions(apply_limits(add_group(df), plot.scales), plot.scales))
    keys = ["PANEL", "group", *(c for c in df.columns if c in GROUPING and not isinstance(df.schema[c].dataType, NUMERIC))]
    placement = {k: v for k, v in layer.params.items() if k in ("width", "amount", "seed", "x", "y")}
    out = STATS[layer.stat](Frame(df), keys, **{k: v for k, v in layer.params.items() if k not in placement})
    later = {k: v.expression for k, v in mapping.items() if isinstance(v, Deferred) and v.stage == "stat"}
    if "y" not in out.columns and "y" not in later and layer.stat in DEFAULT_Y:
        later["y"] = col(DEFAULT_Y[layer.stat])
    out = out.mutate(**later) if later else out
    out = Frame(place(transform_made(out.df, plot.scales, df.columns), layer.position, **placement))
    last = {k: v.expression for k, v in mapping.items() if isinstance(v, Deferred) and v.stage == "scale"}
    return out.mutate(**last) if last else out


def panel_ranges(built: list[Frame]) -> DataFrame | None:
    """(PANEL, aesthetic, low, high) over all layers: what each panel's continuous scales have to cover."""
    every = None
    for f in built:
        for name in ("x", "y"):
            ends = [c for c in (name, f"{name}min", f"{name}max") if c in f.columns and isinstance(f.schema[c].dataType, NUMERIC)]
            if ends:
                low, high = (F.least(*e) if len(e) > 1 else e[0] for e in ([F.min(c).cast("double") for c in ends],) * 2)
                high = F.greatest(*[F.max(c).cast("double") for c in ends]) if len(ends) > 1 else F.max(ends[0]).cast("double")
                one = f.df.groupBy("PANEL").agg(low.alias("low"), high.alias("high")).select("PANEL", F.lit(name).alias("aesthetic"), "low", "high")
                every = one if every is None else every.unionByName(one)
    return None if every is None else every.groupBy("PANEL", "aesthetic").agg(F.min("low").alias("low"), F.max("high").alias("high"))


def build(plot: Plot) -> Built:
    built = [build_layer(plot, layer) for layer in plot.layers]
    return Built(built, panel_ranges(built))
