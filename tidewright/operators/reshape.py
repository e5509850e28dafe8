"""Reshaping, binding, set operations, grids and contingency tables."""

from __future__ import annotations

import itertools
import re
import warnings
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import named, quote
from .frame import Frame, resolve


def pivot_longer(frame: Frame, cols: Any, names_to: str | Sequence[str] = "name", values_to: str = "value", names_prefix: str | None = None,
                 names_sep: str | None = None, names_pattern: str | None = None, values_drop_na: bool = False) -> Frame:
    """Wide to long by one explode; ``.value`` in names_to takes that part of a name as the output column."""
    chosen = resolve(frame.df, [cols])
    names = [names_to] if isinstance(names_to, str) else list(names_to)
    parts: dict[str, list[str]] = {}
    for c in chosen:
        short = re.sub(f"^{names_prefix}", "", c) if names_prefix else c
        if names_pattern:
            found = re.search(names_pattern, short)
            parts[c] = list(found.groups()) if found else [None] * len(names)
        elif names_sep:
            parts[c] = short.split(names_sep, len(names) - 1)
        else:
            parts[c] = [short]
        if len(parts[c]) != len(names):
            raise ValueError(f"{c} has {len(parts[c])} parts for {len(names)} names")
    ids = [c for c in frame.columns if c not in chosen]
    if ".value" in names:
        at = names.index(".value")
        outputs = list(dict.fromkeys(p[at] for p in parts.values()))
        keys = list(dict.fromkeys(tuple(x for i, x in enumerate(p) if i != at) for p in parts.values()))
        source = {(tuple(x for i, x in enumerate(p) if i != at), p[at]): c for c, p in parts.items()}
        labels = [n for n in names if n != ".value"]
        kinds = {o: next(frame.df.schema[c].dataType for (_, v), c in source.items() if v == o) for o in outputs}
        rows = [
            F.struct(
                *[F.lit(x).alias(n) for n, x in zip(labels, key, strict=True)],
                *[(F.col(quote(source[key, o])) if (key, o) in source else F.lit(None).cast(kinds[o])).alias(o) for o in outputs],
            )
            for key in keys
        ]
    else:
        labels, outputs = names, [values_to]
        rows = [F.struct(*[F.lit(x).alias(n) for n, x in zip(names, parts[c], strict=True)], F.col(quote(c)).alias(values_to)) for c in chosen]
    out = frame.df.select(*map(quote, ids), F.explode(F.array(*rows)).alias("__row")).select(*map(quote, ids), *[F.col(f"__row.{quote(c)}") for c in [*labels, *outputs]])
    if values_drop_na:
        out = out.where(F.coalesce(*[F.col(quote(o)).cast("string") for o in outputs]).isNotNull())
    return frame._new(out)


def pivot_wider(frame: Frame, id_cols: Any = None, names_from: Any = "name", values_from: Any = "value", values_fill: Any = None, names_prefix: str = "",
                names_sep: str = "_", names: Sequence[Any] | None = None) -> Frame:
    """Long to wide.  The new columns' names are read from the data once (or given by ``names``); repeated cells become lists, with a warning."""
    from_, values = resolve(frame.df, [names_from]), resolve(frame.df, [values_from])
    ids = resolve(frame.df, [id_cols]) if id_cols is not None else [c for c in frame.columns if c not in from_ and c not in values]
    df = frame.df.withColumn("__key", F.concat_ws(names_sep, *[F.coalesce(F.col(quote(c)).cast("string"), F.lit("null")) for c in from_]))
    if names is None:
        seen = [F.min(F.struct(*[F.col(quote(c)) for c, _ in frame.order])).alias("o")] if frame.order else [F.min("__key").alias("o")]
        names = [r["__key"] for r in df.groupBy("__key").agg(*seen).orderBy("o").limit(10_001).collect()]
        if len(names) > 10_000:
            raise ValueError("more than 10000 new columns")
    twice = not df.groupBy(*map(quote, ids), "__key").count().where("count > 1").isEmpty()
    if twice:
        warnings.warn("cells have several values; they become lists", stacklevel=2)
    made = []
    for v, key in itertools.product(values, names):
        cell = F.when(F.col("__key") == str(key), F.col(quote(v)))
        column = F.collect_list(cell) if twice else F.first(cell, ignorenulls=True)
        if values_fill is not None and not twice:
            column = F.coalesce(column, F.lit(values_fill))
        made.append(column.alias(names_prefix + (str(key) if len(values) == 1 else f"{v}{names_sep}{key}")))
    return frame._new(df.groupBy(*map(quote, ids)).agg(*made) if ids else df.agg(*made))


def unstack(frame: Frame, step: int) -> Frame:
    """Columns of ``step`` rows: row i of the result holds rows i, i + step, ... of the frame."""
    indexed = frame.with_row_index("__i").df
    groups = -(-frame.nrow() // step)
    made = [F.max(F.when(F.floor(F.col("__i") / step) == g, F.col(quote(c)))).alias(f"{c}_{g}") for c in frame.columns for g in range(groups)]
    return frame._new(indexed.groupBy((F.col("__i") % step).alias("__r")).agg(*made).orderBy("__r").drop("__r"), ())


# ---------------------------------------------------------------- binding
def rbind(*frames: Frame, relaxed: bool = False) -> Frame:
    """Rows below each other by name; relaxed fills absent columns with null."""
    out = frames[0].df
    for f in frames[1:]:
        out = out.unionByName(f.df, allowMissingColumns=relaxed)
    return frames[0]._new(out)


def cbind(*frames: Frame) -> Frame:
    """Columns side by side by place in the frames' order."""
    out = frames[0].with_row_index("__i").df
    for f in frames[1:]:
        out = out.join(f.with_row_index("__i").df, "__i")
    return frames[0]._new(out.drop("__i"))


def union(x: Frame, y: Frame) -> Frame:
    return x._new(x.df.unionByName(y.df).distinct())


def intersect(x: Frame, y: Frame) -> Frame:
    return x._new(x.df.intersect(y.df.select(*map(quote, x.columns))))


def setdiff(x: Frame, y: Frame) -> Frame:
    return x._new(x.df.subtract(y.df.select(*map(quote, x.columns))))


def merge_sorted(x: Frame, y: Frame, key: str) -> Frame:
    return Frame(x.df.unionByName(y.df), [(key, False)]).arrange(key)


def update(left: Frame, right: Frame, on: str | Sequence[str]) -> Frame:
    """Left rows with the right's values where it has them."""
    keys = [on] if isinstance(on, str) else list(on)
    new = [c for c in right.columns if c not in keys and c in left.columns]
    joined = left.df.join(right.df.select(*map(quote, keys), *[F.col(quote(c)).alias(f"__{c}") for c in new]), keys, "left")
    return left._new(joined.select(*[F.coalesce(F.col(f"`__{c}`"), F.col(quote(c))).alias(c) if c in new else F.col(quote(c)) for c in left.columns]))


def expand_grid(spark, **values: Sequence[Any]) -> Frame:
    """All combinations; the first varies fastest."""
    rows = [tuple(reversed(r)) for r in itertools.product(*reversed(list(values.values())))]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], ["__i", *values])
    return Frame(df.orderBy("__i").drop("__i"))


def complete_grid(frame: Frame, *cols: str) -> Frame:
    """All combinations of the columns' values, absent ones with nulls."""
    grid: DataFrame | None = None
    for c in cols:
        values = frame.df.select(quote(c)).distinct()
        grid = values if grid is None else grid.crossJoin(values)
    return frame._new(grid.join(frame.df, list(cols), "left"))


def rollup(frame: Frame, keys: Sequence[str], **made: Any) -> Frame:
    c = frame.context("agg")
    return frame._new(frame.df.rollup(*map(quote, keys)).agg(*[e.build(c).alias(k) for k, e in made.items()]), ())


def cube(frame: Frame, keys: Sequence[str], **made: Any) -> Frame:
    c = frame.context("agg")
    return frame._new(frame.df.cube(*map(quote, keys)).agg(*[e.build(c).alias(k) for k, e in made.items()]), ())


def to_dummies(frame: Frame, *cols: str) -> Frame:
    """0 and 1 columns for each value of the columns; more than 1000 values of a column raise."""
    made: list[Column] = []
    for c in frame.columns:
        if c not in cols:
            made.append(F.col(quote(c)))
            continue
        values = [r[0] for r in frame.df.select(quote(c)).where(F.col(quote(c)).isNotNull()).distinct().orderBy(quote(c)).limit(1001).collect()]
        if len(values) > 1000:
            raise ValueError(f"more than 1000 values of {c}")
        for v in values:
            made.append(F.coalesce((F.col(quote(c)) == F.lit(v)).cast("int"), F.lit(0)).alias(f"{c}_{v}"))
    return frame._new(frame.df.select(*made))


def upsample(frame: Frame, time: str, every: str) -> Frame:
    """One row for each step from the first to the last time."""
    edges = frame.df.agg(F.min(time).alias("a"), F.max(time).alias("b"))
    grid = edges.select(F.explode(F.expr(f"sequence(a, b, interval {every})")).alias(time))
    return frame._new(grid.join(frame.df, time, "left"))


def group_by_dynamic(frame: Frame, time: str, every: str, period: str | None = None, by: Sequence[str] = (), **made: Any) -> Frame:
    """Aggregates of time windows, named by their start."""
    c = frame.context("agg")
    w = F.window(F.col(time), period or every, every)
    out = frame.df.groupBy(*map(quote, by), w.alias("__w")).agg(*[e.build(c).alias(k) for k, e in made.items()])
    return frame._new(out.select(*map(quote, by), F.col("__w.start").alias(time), *made), ())


def rolling(frame: Frame, time: str, period_seconds: int, by: Sequence[str] = (), **made: Any) -> Frame:
    """Aggregates of the rows of the last ``period_seconds``, own row included, the far edge not."""
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    w = Window.partitionBy(*map(quote, by)).orderBy(micros).rangeBetween(-period_seconds * 1_000_000 + 1, 0)
    c = frame.context("agg")
    return frame._new(frame.df.select("*", *[e.build(c).over(w).alias(k) for k, e in made.items()]))


# ---------------------------------------------------------------- tables
def table(frame: Frame, x: str, y: str | None = None) -> Frame:
    """Counts of values, as text, nulls left out: long for one column, wide for two."""
    text = frame.df.where(F.col(quote(x)).isNotNull()).withColumn(x, F.col(quote(x)).cast("string"))
    if y is None:
        return frame._new(text.groupBy(quote(x)).agg(F.count(F.lit(1)).alias("n")).orderBy(quote(x)), [(x, False)])
    return xtabs(frame, None, x, y)


def xtabs(frame: Frame, weight: str | None, x: str, y: str | None = None) -> Frame:
    """Counts, or sums of ``weight``, by one or two columns; more than 10000 values of y raise."""
    df = frame.df.where(F.col(quote(x)).isNotNull() & (F.col(quote(y)).isNotNull() if y else F.lit(True)))
    made = F.count(F.lit(1)) if weight is None else F.sum(quote(weight))
    if y is None:
        return frame._new(df.groupBy(F.col(quote(x)).cast("string").alias(x)).agg(made.alias("n")).orderBy(quote(x)), ())
    levels = [r[0] for r in df.select(F.col(quote(y)).cast("string").alias("y")).distinct().orderBy("y").limit(10_001).collect()]
    if len(levels) > 10_000:
        raise ValueError(f"more than 10000 values of {y}")
    cells = [F.coalesce((F.count_if(F.col(quote(y)).cast("string") == v) if weight is None else F.sum(F.when(F.col(quote(y)).cast("string") == v, F.col(quote(weight))))), F.lit(0)).alias(v) for v in levels]
    return frame._new(df.groupBy(F.col(quote(x)).cast("string").alias(x)).agg(*cells).orderBy(quote(x)), ())


def prop_table(frame: Frame, margin: int | None = None, label: str | None = None) -> Frame:
    """Shares of a wide table, of all (None), of rows (1) or of columns (2); 0 where the total is."""
    label = label or frame.columns[0]
    cells = [c for c in frame.columns if c != label]
    row = sum((F.col(quote(c)) for c in cells[1:]), F.col(quote(cells[0])))
    sums = frame.df.agg(*[F.sum(quote(c)).alias(f"__{c}") for c in cells], F.sum(row).alias("__all"))
    df = frame.df.crossJoin(F.broadcast(sums))
    total = {c: F.col("__all") if margin is None else row if margin == 1 else F.col(f"`__{c}`") for c in cells}
    return frame._new(df.select(quote(label), *[F.when(total[c] == 0, F.lit(0.0)).otherwise(F.try_divide(F.col(quote(c)).cast("double"), total[c])).alias(c) for c in cells]), ())


def addmargins(frame: Frame, margin: int | None = None, label: str | None = None) -> Frame:
    """A wide table with the sums of rows (a column), of columns (a row), or both."""
    label = label or frame.columns[0]
    cells = [c for c in frame.columns if c != label]
    df = frame.df
    if margin in (None, 1):
        df = df.unionByName(df.agg(*[F.sum(quote(c)).alias(c) for c in cells]).select(F.lit("Sum").alias(label), *map(quote, cells)))
    if margin in (None, 2):
        df = df.withColumn("Sum", sum((F.col(quote(c)) for c in cells[1:]), F.col(quote(cells[0]))))
    return frame._new(df, ())


# ---------------------------------------------------------------- frame statistics
def describe(frame: Frame) -> Frame:
    """count, null_count, mean, std, min, quartiles and max of the numeric columns, from one aggregate."""
    cells = [n for n, k in frame.df.dtypes if k in ("tinyint", "smallint", "int", "bigint", "float", "double") or k.startswith("decimal")]
    statistics = {
        "count": F.count, "null_count": lambda c: F.count_if(F.col(c).isNull()), "mean": F.avg, "std": F.stddev_samp, "min": F.min,
        "25%": lambda c: F.percentile(c, F.lit(0.25)), "50%": lambda c: F.percentile(c, F.lit(0.5)), "75%": lambda c: F.percentile(c, F.lit(0.75)), "max": F.max,
    }
    one = frame.df.agg(*[f(quote(c)).cast("double").alias(f"{s}|{c}") for c in cells for s, f in statistics.items()])
    rows = F.array(*[F.struct(F.lit(s).alias("statistic"), *[F.col(f"`{s}|{c}`").alias(c) for c in cells]) for s in statistics])
    return frame._new(one.select(F.explode(rows).alias("r")).select("r.*"), ())


def corr(frame: Frame) -> Frame:
    """Pearson correlations of the numeric columns, from one aggregate."""
    cells = [n for n, k in frame.df.dtypes if k in ("int", "bigint", "float", "double") or k.startswith("decimal")]
    one = frame.df.agg(*[F.corr(quote(a), quote(b)).alias(f"{a}|{b}") for a, b in itertools.combinations_with_replacement(cells, 2)])
    pair = lambda a, b: F.col(f"`{a}|{b}`") if cells.index(a) <= cells.index(b) else F.col(f"`{b}|{a}`")
    return frame._new(one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("column"), *[pair(a, b).alias(b) for b in cells]) for a in cells])).alias("r")).select("r.*"), ())


def value_counts(frame: Frame, column: str) -> Frame:
    return frame.count(column, sort=True)


def tabulate(frame: Frame, column: str, nbins: int) -> Frame:
    """Counts of 0 to nbins - 1, absent ones 0."""
    grid = frame.df.sparkSession.range(nbins).withColumnRenamed("id", column)
    counts = frame.df.groupBy(F.col(quote(column)).cast("bigint").alias(column)).agg(F.count(F.lit(1)).alias("n"))
    return frame._new(grid.join(counts, column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n")), ())


def colSums(frame: Frame, na_rm: bool = False) -> Frame:  # noqa: N802
    return frame._new(frame.df.agg(*[(F.sum(quote(c)) if na_rm else F.when(F.count_if(F.col(quote(c)).isNull()) == 0, F.sum(quote(c)))).alias(c) for c in frame.columns]), ())


def colMeans(frame: Frame, na_rm: bool = False) -> Frame:  # noqa: N802
    return frame._new(frame.df.agg(*[(F.avg(quote(c)) if na_rm else F.when(F.count_if(F.col(quote(c)).isNull()) == 0, F.avg(quote(c)))).alias(c) for c in frame.columns]), ())


def tapply(frame: Frame, x: str, index: str, function: Any, schema: str = "value double") -> Frame:
    """An expression maker (like stats.mean) becomes an aggregate; a plain callable gets each group's values as a pandas Series."""
    made = None
    try:
        made = function(named(x))
    except Exception:  # noqa: BLE001  a callable for values, not for expressions
        made = None
    if hasattr(made, "build"):
        return frame.group_by(index).summarize(value=made)
    import pandas as pd

    def of(key, pdf):
        return pd.DataFrame({index: [key[0]], "value": [function(pdf[x])]})

    kind = frame.df.schema[index].dataType.simpleString()
    return frame._new(frame.df.select(quote(index), quote(x)).groupBy(quote(index)).applyInPandas(of, f"{quote(index)} {kind}, {schema}"), ())


