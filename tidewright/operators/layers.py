"""The statistics behind plot layers: bins, counts, box plots, densities, summaries, positions."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expr import col, quote
from ..plans.shared import cut
from .frame import Frame
from .ranges import beside, quantiles, row_numbers


#: Panels that are numbered in one task.
MOST_PANELS = 10_000


def join_groups(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """left with right's other columns, joined on keys of which nulls are equal."""
    own = [f"__k{i}" for i in range(len(keys))]
    named = right.select(*[F.col(quote(k)).alias(o) for k, o in zip(keys, own, strict=True)], *[F.col(quote(c)) for c in right.columns if c not in keys])
    same = F.lit(True)
    for k, o in zip(keys, own, strict=True):
        same = same & F.col(quote(k)).eqNullSafe(F.col(o))
    return (left.join(named, same, how) if keys else left.crossJoin(named)).drop(*own)


def bin_breaks(low: float, high: float, bins: int | None = 30, width: float | None = None, boundary: float | None = None) -> list[float]:
    if width is None:
        width = (high - low) / max(bins - 1, 1) if high > low else 1.0
        boundary = width / 2 if boundary is None else boundary
    boundary = width / 2 if boundary is None else boundary
    start = boundary + math.floor((low - boundary) / width) * width
    out = [start]
    while out[-1] < high - 1e-9 * width:
        out.append(start + len(out) * width)
    return out if len(out) > 1 else [start, start + width]


def bin_index(x: Column, breaks: Sequence[float], right: bool = True) -> Column:
    """0-based number of an even bin, the lowest (or highest) edge included; null outside."""
    n, start, width = len(breaks) - 1, breaks[0], (breaks[-1] - breaks[0]) / (len(breaks) - 1)
    raw = F.ceil((x - start) / width) - 1 if right else F.floor((x - start) / width)
    k = F.least(F.greatest(raw, F.lit(0)), F.lit(n - 1))
    # the division may be off by one bin at an edge; the breaks themselves decide
    edges = F.array(*[F.lit(float(b)) for b in breaks])
    low, high = F.element_at(edges, (k + 1).cast("int")), F.element_at(edges, (k + 2).cast("int"))
    fixed = F.when((x <= low) & (k > 0), k - 1).when(x > high, k + 1).otherwise(k) if right else F.when(x < low, k - 1).when((x >= high) & (k < n - 1), k + 1).otherwise(k)
    return F.when((x >= float(breaks[0])) & (x <= float(breaks[-1])), fixed).cast("int")


def stat_bin(frame: Frame, x: str, bins: int = 30, binwidth: float | None = None, boundary: float | None = None, breaks: Sequence[float] | None = None, closed: str = "right", group: Sequence[str] = ()) -> Frame:
    """Histogram with empty bins: bin, xmin, xmax, count, density, ncount, ndensity."""
    df = frame.df
    if breaks is None:
        low, high = df.agg(F.min(x).cast("double"), F.max(x).cast("double")).first()
        breaks = bin_breaks(low, high, bins, binwidth, boundary)
    spark = df.sparkSession
    counts = df.withColumn("bin", bin_index(F.col(quote(x)).cast("double"), breaks, closed == "right")).where("bin is not null").groupBy(*map(quote, group), "bin").agg(F.count(F.lit(1)).alias("count"))
    grid = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(breaks[:-1], breaks[1:], strict=True))], "bin int, xmin double, xmax double")
    if group:
        grid = df.select(*map(quote, group)).distinct().crossJoin(F.broadcast(grid))
    out = join_groups(grid, counts, [*group, "bin"], "left").withColumn("count", F.coalesce("count", F.lit(0)))
    w = Window.partitionBy(*map(quote, group))
    density = F.try_divide(F.col("count"), (F.col("xmax") - F.col("xmin")) * F.sum("count").over(w))
    out = out.withColumn("density", density).withColumn("ncount", F.try_divide(F.col("count"), F.max("count").over(w))).withColumn("ndensity", F.try_divide(F.col("density"), F.max("density").over(w)))
    return frame._new(out, [("bin", False)])


def hist_breaks(frame: Frame, x: str, rule: str | int = "sturges") -> list[float]:
    """Even breaks by Sturges' rule, Scott's, or Freedman and Diaconis' (any other name), or of so many bins."""
    n, low, high, sd = frame.df.agg(F.count(x), F.min(x), F.max(x), F.stddev_samp(x)).first()
    if isinstance(rule, int):
        k = rule
    elif rule == "sturges":
        k = math.ceil(math.log2(n) + 1)
    else:
        if rule == "scott":
            h = 3.49 * sd * n ** (-1 / 3)
        else:
            q1, q3 = quantiles(frame.df, x, (0.25, 0.75)).first()["q"]
            h = 2 * (q3 - q1) * n ** (-1 / 3)
        k = max(1, math.ceil((high - low) / h)) if h > 0 else 1
    return [low + (high - low) * i / k for i in range(k + 1)]


def stat_count(frame: Frame, x: str, group: Sequence[str] = ()) -> Frame:
    """Rows of each x, and their share of the group."""
    out = frame.df.groupBy(*map(quote, dict.fromkeys([*group, x]))).agg(F.count(F.lit(1)).alias("count"))
    return frame._new(out.withColumn("prop", F.col("count") / F.sum("count").over(Window.partitionBy(*map(quote, group)))), ())


def stat_sum(frame: Frame, x: str, y: str) -> Frame:
    """Rows of each point, and their share of all."""
    out = frame.df.groupBy(quote(x), quote(y)).agg(F.count(F.lit(1)).alias("n"))
    total = frame.df.agg(F.count(F.lit(1)).alias("__n"))
    return frame._new(out.crossJoin(F.broadcast(total)).select(quote(x), quote(y), "n", (F.col("n") / F.col("__n")).alias("prop")), ())


def _hinged(frame: Frame, y: str, by: Sequence[str], coef: float) -> DataFrame:
    """The rows that have a y, with lower, middle, upper and n of their group, and whether y lies within coef * IQR of the hinges."""
    c = F.col(quote(y))
    q = quantiles(frame.df, y, (0.25, 0.5, 0.75), by)
    hinges = cut(q.select(*map(quote, by), *[F.col("q")[i].alias(name) for i, name in enumerate(("lower", "middle", "upper"))], "n"))
    df = beside(frame.df.where(c.isNotNull()), hinges, by)
    reach = (F.col("upper") - F.col("lower")) * coef
    return df.withColumn("__in", (c >= F.col("lower") - reach) & (c <= F.col("upper") + reach))


def stat_boxplot(frame: Frame, y: str, by: Sequence[str] = (), coef: float = 1.5, outliers: bool = True) -> Frame:
    """Hinges by type 7, whiskers to the last values within coef * IQR, notches, and outliers as a list.

    A group with very many outliers should leave the list out and take them as
    rows from boxplot_outliers().
    """
    keys, c = list(map(quote, by)), F.col(quote(y))
    ends = [F.min(F.when(F.col("__in"), c)).alias("ymin"), F.max(F.when(F.col("__in"), c)).alias("ymax")]
    if outliers:
        ends.append(F.array_sort(F.collect_list(F.when(~F.col("__in"), c))).alias("outliers"))
    out = _hinged(frame, y, by, coef).groupBy(*keys, "lower", "middle", "upper", "n").agg(*ends)
    half = F.lit(1.58) * (F.col("upper") - F.col("lower")) / F.sqrt("n")
    made = [*keys, "ymin", "lower", "middle", "upper", "ymax", "n", (F.col("middle") - half).alias("notchlower"), (F.col("middle") + half).alias("notchupper")]
    return frame._new(out.select(*made, *(["outliers"] if outliers else [])), ())


def boxplot_outliers(frame: Frame, y: str, by: Sequence[str] = (), coef: float = 1.5) -> Frame:
    """The rows that stat_boxplot's whiskers leave out."""
    return frame._new(_hinged(frame, y, by, coef).where("not __in").select(*map(quote, frame.columns)))


def bandwidth(n: int, sd: float, iqr: float, rule: str | float = "nrd0") -> float:
    if not isinstance(rule, str):
        return float(rule)
    if rule == "scott":
        return sd * n ** (-1 / 5)
    if rule == "silverman":
        return sd * (n * 3 / 4) ** (-1 / 5)
    low = min(sd, iqr / 1.34) if iqr > 0 else sd
    return 0.9 * (low or sd or 1.0) * n ** (-1 / 5)


def density(frame: Frame, x: str, bw: str | float = "nrd0", n: int = 512, from_: float | None = None, to: float | None = None, cut: float = 3.0, exact: bool = False) -> Frame:
    """Gaussian kernel density on an even grid.

    Values are first spread linearly over the grid's cells (so that one
    aggregate of n rows stands for all data) unless ``exact``, which sums over
    every value in one aggregate for each row.
    """
    df = frame.df.where(F.col(quote(x)).isNotNull()).select(F.col(quote(x)).cast("double").alias("v"))
    m, low, high, sd = df.agg(F.count("v"), F.min("v"), F.max("v"), F.stddev_samp("v")).first()
    q1, q3 = quantiles(df, "v", (0.25, 0.75)).first()["q"] if bw == "nrd0" else (0.0, 0.0)
    h = bandwidth(m, sd or 0.0, q3 - q1, bw)
    a, b = (low - cut * h if from_ is None else from_), (high + cut * h if to is None else to)
    step = (b - a) / (n - 1)
    grid = F.broadcast(df.sparkSession.range(n).select(F.col("id").alias("i"), (F.lit(a) + F.col("id") * step).alias("x")))
    if exact:
        points = df.select("v", F.lit(1.0).alias("w"))
    else:
        lo_edge, hi_edge = min(a, low), max(b, high)
        fine = (hi_edge - lo_edge) / (4 * n)
        at = (F.col("v") - lo_edge) / fine
        k = F.floor(at)
        split = F.explode(F.array(F.struct(k.alias("k"), (1 - (at - k)).alias("w")), F.struct((k + 1).alias("k"), (at - k).alias("w"))))
        points = df.select(split.alias("s")).groupBy("s.k").agg(F.sum("s.w").alias("w")).select((F.lit(lo_edge) + F.col("k") * fine).alias("v"), "w")
    z = (F.col("x") - F.col("v")) / h
    out = points.crossJoin(grid).groupBy("i", "x").agg((F.sum(F.col("w") * F.exp(-z * z / 2)) / (m * h * math.sqrt(2 * math.pi))).alias("density"))
    return frame._new(out.select("x", "density"), [("x", False)])


def stat_ecdf(frame: Frame, x: str, by: Sequence[str] = ()) -> Frame:
    """One row for each observation: its place among the values over their number.  Places are counted over range partitions, in groups too."""
    keys = [F.col(quote(k)) for k in by]
    rows = row_numbers(frame.df.where(F.col(quote(x)).isNotNull()), "__at", *[k.asc_nulls_first() for k in keys], F.col(quote(x)))
    sizes = cut(rows.groupBy(*keys).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n")))
    joined = beside(rows, sizes, by)
    return frame._new(joined.select(*map(quote, frame.columns), ((F.col("__at") - F.col("__first") + 1) / F.col("__n")).alias("ecdf")))


def stat_bin2d(frame: Frame, x: str, y: str, bins: int = 30) -> Frame:
    a, b, c, d = frame.df.agg(F.min(x).cast("double"), F.max(x).cast("double"), F.min(y).cast("double"), F.max(y).cast("double")).first()
    bx, by = ([lo + (hi - lo) * i / bins for i in range(bins + 1)] for lo, hi in ((a, b), (c, d)))
    df = frame.df.select(bin_index(F.col(quote(x)).cast("double"), bx).alias("xbin"), bin_index(F.col(quote(y)).cast("double"), by).alias("ybin"))
    out = df.where("xbin is not null and ybin is not null").groupBy("xbin", "ybin").agg(F.count(F.lit(1)).alias("count"))
    total = Window.partitionBy()
    return frame._new(out.withColumn("density", F.col("count") / F.sum("count").over(total)), ())


def stat_binhex(frame: Frame, x: str, y: str, bins: int = 30) -> Frame:
    """Counts by the nearer of two staggered lattices."""
    a, b, c, d = frame.df.agg(F.min(x).cast("double"), F.max(x).cast("double"), F.min(y).cast("double"), F.max(y).cast("double")).first()
    dx, dy = (b - a) / bins or 1.0, (d - c) / bins / math.sqrt(3) * 2 or 1.0
    u, v = (F.col(quote(x)).cast("double") - a) / dx, (F.col(quote(y)).cast("double") - c) / dy
    i1, j1, i2, j2 = F.round(u), F.round(v), F.floor(u) + 0.5, F.floor(v) + 0.5
    near = ((u - i1) ** 2 + 3 * (v - j1) ** 2) <= ((u - i2) ** 2 + 3 * (v - j2) ** 2)
    df = frame.df.select((F.lit(a) + F.when(near, i1).otherwise(i2) * dx).alias("x"), (F.lit(c) + F.when(near, j1).otherwise(j2) * dy).alias("y"))
    return frame._new(df.groupBy("x", "y").agg(F.count(F.lit(1)).alias("count")), ())


def stat_summary(frame: Frame, x: str, y: str, fun: str = "mean_se", conf: float = 0.95, mult: float = 1.0) -> Frame:
    """y, ymin, ymax of each x: mean_se, mean_cl_normal or median_hilow."""
    from ..functions.distributions import _by_value
    from ..models.special import qt

    c = F.col(quote(y)).cast("double")
    if fun == "median_hilow":
        tails = F.percentile(c, F.array(F.lit(0.5), F.lit((1 - conf) / 2), F.lit((1 + conf) / 2)))
        out = frame.df.groupBy(quote(x)).agg(tails.alias("q")).select(quote(x), F.col("q")[0].alias("y"), F.col("q")[1].alias("ymin"), F.col("q")[2].alias("ymax"))
        return frame._new(out, ())
    one = frame.df.groupBy(quote(x)).agg(F.avg(c).alias("y"), (F.stddev_samp(c) / F.sqrt(F.count(c))).alias("se"), F.count(c).alias("n"))
    if fun == "mean_se":
        reach = F.col("se") * mult
    else:
        # by an Arrow UDF over the different sizes, joined back by size
        factor = _by_value(lambda s: qt((1 + conf) / 2, s - 1) if s > 1 else float("nan"))("n")
        one = one.join(Frame(one.select("n").distinct()).mutate(__t=factor).df, "n")
        reach = F.col("se") * F.col("__t")
    return frame._new(one.select(quote(x), "y", (F.col("y") - reach).alias("ymin"), (F.col("y") + reach).alias("ymax")), ())


def stat_qq(frame: Frame, x: str) -> Frame:
    """Sample and normal quantiles."""
    from ..functions.distributions import qnorm

    indexed = Frame(frame.df.where(F.col(quote(x)).isNotNull()), [(x, False)]).with_row_index("__i")
    n = indexed.nrow()
    a = 0.5 if n > 10 else 3 / 8
    out = indexed.df.select(F.col(quote(x)).alias("sample"), ((F.col("__i") + 1 - a) / (n + 1 - 2 * a)).alias("__p"))
    return Frame(out).mutate(theoretical=qnorm("__p")).drop("__p")


def stat_qq_line(frame: Frame, x: str, probs: tuple[float, float] = (0.25, 0.75)) -> Frame:
    """The ends, over the range of stat_qq's theoretical quantiles, of the line through two quantiles of the sample and of the normal."""
    from ..models.special import qnorm

    row = quantiles(frame.df, x, probs).first()
    (low, high), n = row["q"], row["n"]
    a, b = qnorm(probs[0]), qnorm(probs[1])
    slope = (high - low) / (b - a) if b != a else 0.0
    shift = 0.5 if n > 10 else 3 / 8
    edge = qnorm((n - shift) / (n + 1 - 2 * shift))
    ends = [(t, low + slope * (t - a)) for t in (-edge, edge)]
    return Frame(frame.df.sparkSession.createDataFrame(ends, "x double, y double"), [("x", False)])


def stat_function(spark: SparkSession, fun: Callable[[Any], Any], xlim: tuple[float, float], n: int = 101) -> Frame:
    """(x, y) of an expression maker, like conditionals.sqrt, on an even grid."""
    low, high = xlim
    grid = Frame(spark.range(n).select((F.lit(float(low)) + F.col("id") * F.lit((high - low) / max(n - 1, 1))).alias("x")), [("x", False)])
    return grid.mutate(y=fun(col("x")))


def _kernel_sums(points: DataFrame, grid: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """Gaussian densities of weighted points (keys, v, w) at n places of their group's grid (keys, m, h, start, step)."""
    # a point meets its group's places where it is, so a task holds no group's pairs, and sums alone leave it
    pairs = beside(points, grid, keys).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("at", F.col("start") + F.col("i") * F.col("step"))
    z = (F.col("at") - F.col("v")) / F.col("h")
    total = F.sum(F.col("w") * F.exp(-z * z / 2)) / (F.col("m") * F.col("h") * math.sqrt(2 * math.pi))
    return pairs.groupBy(*map(quote, keys), "i", "at", "h", "m").agg(total.alias("density"))


def _group_bandwidths(frame: Frame, x: str, keys: Sequence[str]) -> DataFrame:
    """(keys, m, low, high, h): size, range and nrd0 bandwidth of each group of two values or more, written once."""
    c = F.col(quote(x)).cast("double")
    stats = frame.df.where(c.isNotNull()).groupBy(*map(quote, keys)).agg(F.count(c).alias("m"), F.min(c).alias("low"), F.max(c).alias("high"), F.stddev_samp(c).alias("sd"))
    q = quantiles(frame.df, x, (0.25, 0.75), keys).select(*map(quote, keys), ((F.col("q")[1] - F.col("q")[0]) / 1.34).alias("iqr"))
    joined = join_groups(stats, q, keys)
    least = F.when(F.col("iqr") > 0, F.least("sd", "iqr")).otherwise(F.col("sd"))
    return cut(joined.where("m > 1").select(*map(quote, keys), "m", "low", "high", (0.9 * F.when(least > 0, least).otherwise(1.0) * F.pow("m", F.lit(-0.2))).alias("h")))


def _spread(rows: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """(keys, v, w): values spread linearly over 4 n cells of their group's range, so that at most so many points stand for a group."""
    fine = (F.col("high") - F.col("low")) / (4 * n)
    at = F.when(fine > 0, (F.col("v") - F.col("low")) / fine).otherwise(0.0)
    cell = F.floor(at)
    both = F.explode(F.array(F.struct(cell.alias("k"), (1 - (at - cell)).alias("w")), F.struct((cell + 1).alias("k"), (at - cell).alias("w"))))
    parts = rows.select(*map(quote, keys), "low", fine.alias("fine"), both.alias("s")).groupBy(*map(quote, keys), "low", "fine", "s.k").agg(F.sum("s.w").alias("w"))
    return parts.select(*map(quote, keys), (F.col("low") + F.col("k") * F.col("fine")).alias("v"), "w")


def stat_ydensity(frame: Frame, x: str, y: str, bw: float | None = None, adjust: float = 1.0, n: int = 512, exact: bool = False) -> Frame:
    """A violin for each x: y on an even grid with density, ndensity, count and violinwidth.

    Values are first spread over cells of their group's range, unless ``exact``.
    """
    width = _group_bandwidths(frame, y, [x]).withColumn("h", (F.col("h") if bw is None else F.lit(float(bw))) * adjust)
    rows = frame.df.where(F.col(quote(y)).isNotNull()).select(quote(x), F.col(quote(y)).cast("double").alias("v"))
    points = rows.withColumn("w", F.lit(1.0)) if exact else _spread(beside(rows, width.select(quote(x), "low", "high"), [x]), [x], n)
    step = (F.col("high") - F.col("low") + 6 * F.col("h")) / (n - 1)
    grid = width.select(quote(x), "m", "h", (F.col("low") - 3 * F.col("h")).alias("start"), step.alias("step"))
    found = _kernel_sums(points, grid, [x], n)
    share = F.try_divide(F.col("density"), F.max("density").over(Window.partitionBy(quote(x))))
    return frame._new(found.select(quote(x), F.col("at").alias(y), "density", share.alias("ndensity"), (F.col("density") * F.col("m")).alias("count"), share.alias("violinwidth")), ())


def stat_density_ridges(frame: Frame, x: str, y: str, bandwidth: float | None = None, n: int = 512, from_: float | None = None, to: float | None = None, exact: bool = False) -> Frame:
    """Densities of x for each y on one grid, with one bandwidth: the mean of the groups' own."""
    own = _group_bandwidths(frame, x, [y])
    low, high, mean = own.agg(F.min("low"), F.max("high"), F.avg("h")).first()
    h = float(mean if bandwidth is None else bandwidth)
    a, b = (low - 3 * h if from_ is None else from_), (high + 3 * h if to is None else to)
    rows = frame.df.where(F.col(quote(x)).isNotNull()).select(quote(y), F.col(quote(x)).cast("double").alias("v"))
    points = rows.withColumn("w", F.lit(1.0)) if exact else _spread(beside(rows, own.select(quote(y), "low", "high"), [y]), [y], n)
    grid = own.select(quote(y), "m", F.lit(h).alias("h"), F.lit(float(a)).alias("start"), F.lit((b - a) / (n - 1)).alias("step"))
    return frame._new(_kernel_sums(points, grid, [y], n).select(quote(y), F.col("at").alias(x), "density"), ())


def stat_unique(frame: Frame) -> Frame:
    return frame.distinct()


# ---------------------------------------------------------------- positions
def position_stack(frame: Frame, x: str, y: str, group: str, fill: bool = False) -> Frame:
    """ymin and ymax of bars on top of each other, the last group at the bottom; ``fill`` makes heights sum to 1."""
    w = Window.partitionBy(quote(x))
    top = F.sum(quote(y)).over(w.orderBy(F.col(quote(group)).desc()).rowsBetween(Window.unboundedPreceding, 0))
    bottom = top - F.col(quote(y))
    if fill:
        total = F.sum(quote(y)).over(w)
        top, bottom = F.try_divide(top, total), F.try_divide(bottom, total)
    return frame._new(frame.df.withColumn("ymax", top).withColumn("ymin", bottom))


def position_dodge(frame: Frame, x: str, group: str, width: float = 0.9) -> Frame:
    """x moved aside by the group's place among the groups at x."""
    w = Window.partitionBy(quote(x))
    place, size = F.dense_rank().over(w.orderBy(quote(group))), F.size(F.collect_set(quote(group)).over(w))
    return frame._new(frame.df.withColumn("x_dodged", F.col(quote(x)) + (place - 0.5) * width / size - width / 2))


def position_jitter(frame: Frame, x: str, amount: float = 0.4, seed: int | None = None) -> Frame:
    return frame._new(frame.df.withColumn(x, F.col(quote(x)) + (F.rand(seed) * 2 - 1) * amount))


def position_nudge(frame: Frame, x: str, by: float) -> Frame:
    return frame._new(frame.df.withColumn(x, F.col(quote(x)) + by))


def _with_panels(frame: Frame, panels: DataFrame, keys: Sequence[str]) -> Frame:
    """Rows with the 1-based number of their panel, nulls first and equal; many panels are numbered over range partitions."""
    panels = cut(panels)
    if panels.count() <= MOST_PANELS:
        numbered = panels.withColumn("panel", F.row_number().over(Window.orderBy(*map(quote, keys))))
    else:
        numbered = row_numbers(panels, "panel", *[F.col(quote(k)).asc_nulls_first() for k in keys]).withColumn("panel", (F.col("panel") + 1).cast("int"))
    return frame._new(beside(frame.df, cut(numbered), keys))


def facet_wrap(frame: Frame, *by: str) -> Frame:
    """Rows with the 1-based number of their panel, one for each combination that occurs."""
    return _with_panels(frame, frame.df.select(*map(quote, by)).distinct(), by)


def facet_grid(frame: Frame, row: str, column: str) -> Frame:
    """Rows with the panel's number in the grid of all row and column values.

    With many values, a panel's place comes from the places of its two values; the grid itself is never made.
    """
    rows = row_numbers(frame.df.select(quote(row)).distinct(), "__r", F.col(quote(row)).asc_nulls_first())
    columns = row_numbers(frame.df.select(quote(column)).distinct(), "__c", F.col(quote(column)).asc_nulls_first())
    columns = cut(columns)
    width = columns.count()
    out = beside(beside(frame.df, cut(rows), [row]), columns, [column])
    return frame._new(out.withColumn("panel", (F.col("__r") * width + F.col("__c") + 1).cast("bigint")).drop("__r", "__c"))
