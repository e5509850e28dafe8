"""The rest of a data frame's surface: short names for what Spark has, as methods of Frame."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import Name, quote
from .frame import NUMERIC, Frame, desc, order_columns


def _numeric(frame: Frame) -> list[str]:
    return [f.name for f in frame.schema.fields if isinstance(f.dataType, NUMERIC)]


def _floats(frame: Frame) -> list[str]:
    return [f.name for f in frame.schema.fields if isinstance(f.dataType, T.FloatType | T.DoubleType)]


def _each(frame: Frame, made: dict[str, Column]) -> Frame:
    return frame._new(frame.df.select(*[made[c].alias(c) if c in made else F.col(quote(c)) for c in frame.columns]))


def _aggregate(function, columns=lambda f: f.columns):
    def method(self: Frame) -> Frame:
        return self._new(self.df.agg(*[function(F.col(quote(c))).alias(c) for c in columns(self)]), ())

    return method


def _parallel(self: Frame, pairs: Sequence[tuple[str, Any]]) -> Frame:
    from ..functions.expr import as_expr

    df, made = self.lower([as_expr(e) for _, e in pairs])
    new = dict(zip([k for k, _ in pairs], made, strict=True))
    columns = [*self.columns, *(k for k in new if k not in self.columns)]
    return self._new(df.select(*[new[c].alias(c) if c in new else F.col(quote(c)) for c in columns]))


def sort(self: Frame, *keys: str, descending: bool = False) -> Frame:
    return self.arrange(*[desc(k) if descending else k for k in keys])


def unique(self: Frame, *subset: str, keep: str = "first") -> Frame:
    """Different rows, or the first or last (or none of the repeated) of each key."""
    keys = list(subset) or self.columns
    if keep == "none":
        w = Window.partitionBy(*map(quote, keys))
        return self._new(self.df.withColumn("__n", F.count(F.lit(1)).over(w)).where("__n = 1").drop("__n"))
    if not subset:
        return self.distinct()
    order = order_columns(self.order if keep == "first" else [(c, not d) for c, d in self.order])
    self._require_order()
    return self._numbered(keys, lambda n: n == 1, order)


def cast(self: Frame, kinds: str | dict[str, str]) -> Frame:
    pairs = kinds if isinstance(kinds, dict) else {c: kinds for c in self.columns}
    return _each(self, {c: F.col(quote(c)).cast(k) for c, k in pairs.items()})


def fill_null(self: Frame, value: Any = None, strategy: str | None = None) -> Frame:
    """A value for nulls of its own kind of column, or a strategy: forward, backward, min, max, mean, zero, one."""
    if strategy in ("forward", "backward"):
        return self.fill(direction="down" if strategy == "forward" else "up")
    if strategy in ("zero", "one"):
        value = int(strategy == "one")
    if strategy in ("min", "max", "mean"):
        function = {"min": F.min, "max": F.max, "mean": F.avg}[strategy]
        cells = _numeric(self)
        df = self.df.crossJoin(F.broadcast(self.df.agg(*[function(quote(c)).alias(f"__{c}") for c in cells])))
        return self._new(df.select(*[F.coalesce(F.col(quote(c)), F.col(quote(f"__{c}"))).alias(c) if c in cells else F.col(quote(c)) for c in self.columns]))
    kind = T.BooleanType if isinstance(value, bool) else NUMERIC if isinstance(value, int | float) else T.StringType
    return _each(self, {f.name: F.coalesce(F.col(quote(f.name)), F.lit(value).cast(f.dataType)) for f in self.schema.fields if isinstance(f.dataType, kind)})


def fill_nan(self: Frame, value: float | None) -> Frame:
    return _each(self, {c: F.when(F.isnan(quote(c)), F.lit(value)).otherwise(F.col(quote(c))) for c in _floats(self)})


def drop_nans(self: Frame) -> Frame:
    test = F.lit(True)
    for c in _floats(self):
        test = test & ~F.coalesce(F.isnan(quote(c)), F.lit(False))
    return self._new(self.df.where(test))


def interpolate(self: Frame, *cols: str, by: Sequence[str] = ()) -> Frame:
    """Nulls between two values on the line between them, by place in the frame's order."""
    order = self._require_order()
    w = Window.partitionBy(*map(quote, by)).orderBy(*order)
    place = F.row_number().over(w)
    df = self.df.withColumn("__i", place)
    before = w.rowsBetween(Window.unboundedPreceding, 0)
    behind = Window.partitionBy(*map(quote, by)).orderBy(F.col("__i").desc()).rowsBetween(Window.unboundedPreceding, 0)
    made = {}
    for c in cols or _numeric(self):
        x = F.col(quote(c)).cast("double")
        at = F.when(x.isNotNull(), F.col("__i"))
        a, b = F.last(x, ignorenulls=True).over(before), F.last(x, ignorenulls=True).over(behind)
        i, j = F.last(at, ignorenulls=True).over(before), F.last(at, ignorenulls=True).over(behind)
        made[c] = F.when(x.isNotNull(), x).when(j > i, a + (b - a) * (F.col("__i") - i) / F.greatest(j - i, F.lit(1)))
    return self._new(df.select(*[made[c].alias(c) if c in made else F.col(quote(c)) for c in self.columns]))


def shift(self: Frame, n: int = 1) -> Frame:
    """All columns but the order's moved by n places of the frame's order: rows are numbered and joined to those n places before."""
    keys = {c for c, _ in self.order}
    rows = self.with_row_index("__i").df
    moved = rows.select((F.col("__i") + n).alias("__j"), *[F.col(quote(c)).alias(f"__v{i}") for i, c in enumerate(self.columns) if c not in keys])
    joined = rows.join(moved, F.col("__i") == F.col("__j"), "left")
    return self._new(joined.select(*[F.col(quote(c)) if c in keys else F.col(f"__v{i}").alias(c) for i, c in enumerate(self.columns)]))


def gather_every(self: Frame, n: int, offset: int = 0) -> Frame:
    indexed = self.with_row_index("__i").df
    return self._new(indexed.where((F.col("__i") >= offset) & ((F.col("__i") - offset) % n == 0)).drop("__i"))


def reverse(self: Frame) -> Frame:
    self._require_order()
    back = [(c, not d) for c, d in self.order]
    return self._new(self.df.orderBy(*order_columns(back)), back)


def slice_(self: Frame, offset: int, length: int) -> Frame:
    """Rows by place; few rows from the front need no index."""
    return self._new(self.df.orderBy(*self._require_order()).offset(offset).limit(length))


def top_k(self: Frame, k: int, by: str) -> Frame:
    return self.slice_max(by, k, with_ties=False)


def bottom_k(self: Frame, k: int, by: str) -> Frame:
    return self.slice_min(by, k, with_ties=False)


def quantile(self: Frame, q: float) -> Frame:
    """A value that occurs: of the two about the quantile, the nearer one."""

    def nearest(c: Column) -> Column:
        values = F.array_sort(F.collect_list(c))
        return F.element_at(values, (F.floor((F.size(values) - 1) * q + 0.5) + 1).cast("int"))

    return self._new(self.df.agg(*[nearest(F.col(quote(c))).alias(c) for c in _numeric(self)]), ())


def explode(self: Frame, *cols: str) -> Frame:
    """List columns of equal lengths to rows; an empty or null list is a null."""
    zipped = F.explode_outer(F.arrays_zip(*[F.col(quote(c)).alias(c) for c in cols])).alias("__z")
    rest = [F.col(quote(c)) for c in self.columns if c not in cols]
    df = self.df.select(*rest, zipped)
    return self._new(df.select(*[F.col(f"__z.{quote(c)}").alias(c) if c in cols else F.col(quote(c)) for c in self.columns]))


def unnest(self: Frame, *cols: str) -> Frame:
    """Struct columns to their fields."""
    out: list[Column] = []
    for f in self.schema.fields:
        out += [F.col(f"{quote(f.name)}.{quote(x.name)}") for x in f.dataType.fields] if f.name in cols else [F.col(quote(f.name))]
    return self._new(self.df.select(*out))


def unpivot(self: Frame, on: Sequence[str], index: Sequence[str] = (), variable: str = "variable", value: str = "value") -> Frame:
    return self._new(self.df.unpivot(list(index), list(on), variable, value))


def partition_by(self: Frame, *keys: str) -> list[Frame]:
    """A lazy frame for each of at most 1000 key combinations."""
    found = self.df.select(*map(quote, keys)).distinct().orderBy(*map(quote, keys)).limit(1001).collect()
    if len(found) > 1000:
        raise ValueError("more than 1000 parts; group_by instead")
    out = []
    for row in found:
        test = F.lit(True)
        for k in keys:
            test = test & F.col(quote(k)).eqNullSafe(F.lit(row[k]))
        out.append(self._new(self.df.where(test)))
    return out


def extend(self: Frame, other: Frame) -> Frame:
    return self._new(self.df.unionByName(other.df))


def equals(self: Frame, other: Frame) -> bool:
    """The same rows, in any order."""
    if self.columns != other.columns:
        return False
    return self.df.exceptAll(other.df).isEmpty() and other.df.exceptAll(self.df).isEmpty()


def insert_column(self: Frame, at: int, name: str, value: Any) -> Frame:
    made = self.mutate(**{name: value})
    order = [*self.columns[:at], name, *self.columns[at:]]
    return made._new(made.df.select(*map(quote, order)))


def persist(self: Frame) -> Frame:
    return self._new(self.df.persist())


def to_dicts(self: Frame) -> list[dict[str, Any]]:
    return [r.asDict() for r in self.df.collect()]


def join_asof(self: Frame, other: Frame, on: str | None = None, left_on: str | None = None, right_on: str | None = None, by: str | Sequence[str] = (), strategy: str = "backward", suffix: str = "_right") -> Frame:
    """Each left row with the last right row at or before it, the next at or behind it, or the nearest; right columns of equal name take the suffix."""
    from . import joins

    a, b = left_on or on, right_on or on
    keys = [by] if isinstance(by, str) else list(by)
    clash = {c: f"{c}{suffix}" for c in other.columns if c in self.columns and c not in keys}
    right = other.rename(clash) if clash else other
    b = clash.get(b, b)
    op = {"backward": ">=", "forward": "<=", "nearest": "=="}[strategy]
    left, near = Name(a), Name(b)
    spec = joins.join_by(*keys, joins.closest({">=": left >= near, "<=": left <= near, "==": left == near}[op]))
    out = joins.left_join(self, right, spec)
    return out.drop(b) if on else out


def join_where(self: Frame, other: Frame, *predicates: Any, suffix: str = "_right") -> Frame:
    """Pairs of rows for which comparisons of a left with a right column hold; equalities become the join's keys."""
    from . import joins

    clash = {c: f"{c}{suffix}" for c in other.columns if c in self.columns}
    return joins.inner_join(self, other.rename(clash) if clash else other, joins.join_by(*predicates), keep=True)


def transpose(self: Frame, names: str) -> Frame:
    """Columns as rows: one for each column but ``names``, whose values name the new columns; at most 1000."""
    labels = [str(r[0]) for r in self.df.select(quote(names)).limit(1001).collect()]
    if len(labels) > 1000 or len(set(labels)) < len(labels):
        raise ValueError("transpose needs at most 1000 different names")
    rest = [c for c in self.columns if c != names]
    long = self.df.select(F.col(quote(names)).cast("string").alias("__n"), F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c).alias("column"), F.col(quote(c)).cast("double").alias("v")) for i, c in enumerate(rest)])).alias("c"))
    out = long.groupBy("c.i", "c.column").agg(*[F.max(F.when(F.col("__n") == n, F.col("c.v"))).alias(n) for n in labels])
    return self._new(out.orderBy("i").drop("i"), ())


def map_rows(self: Frame, function: Any, schema: str) -> Frame:
    """A callable over tuples, called in Arrow batches."""
    import pandas as pd

    names = [part.split()[0] for part in schema.split(",")]

    def over(batches):
        for pdf in batches:
            made = [function(tuple(row)) for row in pdf.itertuples(index=False)]
            yield pd.DataFrame([m if isinstance(m, tuple) else (m,) for m in made], columns=names)

    return self._new(self.df.mapInPandas(over, schema), ())


def map_columns(self: Frame, columns: Sequence[str], function: Any) -> Frame:
    """An expression maker over each of the columns."""
    return self.mutate(**{c: function(c) for c in columns})


def concat(frames: Sequence[Frame], how: str = "vertical") -> Frame:
    """Rows below each other (vertical, vertical_relaxed, diagonal), or columns side by side by place (horizontal)."""
    from . import reshape

    if how == "horizontal":
        return reshape.cbind(*frames)
    return reshape.rbind(*frames, relaxed=how.startswith("diagonal"))


def align_frames(*frames: Frame, on: str | Sequence[str]) -> list[Frame]:
    """Frames with the same keys in the same order: all that any of them has, nulls where a frame has none."""
    keys = [on] if isinstance(on, str) else list(on)
    every = frames[0].df.select(*map(quote, keys))
    for f in frames[1:]:
        every = every.union(f.df.select(*map(quote, keys)))
    every = every.distinct()
    return [f._new(every.join(f.df, keys, "left").select(*map(quote, f.columns)), [(k, False) for k in keys]).arrange(*keys) for f in frames]


def concat_str(*values: Any, separator: str = "") -> Any:
    from ..functions.strings import str_c

    return str_c(*values, sep=separator)


class When:
    """when(test).then(value), more of them, and otherwise(value)."""

    def __init__(self, pairs: tuple = (), test: Any = None):
        self.pairs, self.test = pairs, test

    def then(self, value: Any) -> When:
        return When((*self.pairs, (self.test, value)))

    def when(self, test: Any) -> When:
        return When(self.pairs, test)

    def otherwise(self, value: Any) -> Any:
        from ..functions.conditionals import case_when

        return case_when(*self.pairs, default=value)


def when(test: Any) -> When:
    return When((), test)


METHODS = {
    "join_asof": join_asof, "join_where": join_where, "transpose": transpose, "map_rows": map_rows, "map_columns": map_columns, "hstack": lambda self, other: concat([self, other], "horizontal"),
    "with_columns": lambda self, *a, **k: _parallel(self, [*((x.name, x) for x in a), *k.items()]), "sort": sort, "unique": unique, "cast": cast, "fill_null": fill_null, "fill_nan": fill_nan,
    "drop_nans": drop_nans, "interpolate": interpolate, "shift": shift, "gather_every": gather_every, "reverse": reverse, "slice": slice_, "top_k": top_k, "bottom_k": bottom_k, "quantile": quantile,
    "explode": explode, "unnest": unnest, "unpivot": unpivot, "partition_by": partition_by, "extend": extend, "vstack": extend, "equals": equals, "insert_column": insert_column, "cache": persist,
    "to_dicts": to_dicts, "clone": lambda self: self._new(self.df), "clear": lambda self: self._new(self.df.limit(0)), "rechunk": lambda self: self, "sum": _aggregate(F.sum, _numeric), "mean": _aggregate(F.avg, _numeric),
    "median": _aggregate(F.median, _numeric), "std": _aggregate(F.stddev_samp, _numeric), "var": _aggregate(F.var_samp, _numeric), "min": _aggregate(F.min), "max": _aggregate(F.max), "product": _aggregate(F.product, _numeric),
    "null_count": _aggregate(lambda c: F.count_if(c.isNull())), "n_unique": _aggregate(lambda c: F.count_distinct(c) + F.max(c.isNull().cast("int"))), "approx_n_unique": _aggregate(F.approx_count_distinct),
}

for _name, _method in METHODS.items():
    if not hasattr(Frame, _name):
        setattr(Frame, _name, _method)
