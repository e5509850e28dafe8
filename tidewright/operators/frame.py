"""Frame and Grouped: tidy verbs over a lazy Spark plan.

A verb extends the logical plan and runs nothing.  A frame may carry an order
key, declared when it is read or by arrange(); verbs and functions that depend
on the order of rows use it, and nothing is sorted before it has to be.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import Context, Expr, Name, as_expr, col, named, quote
from .ranges import row_numbers

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


class Desc:
    """A descending sort key."""

    def __init__(self, key: Any):
        self.key = key


def desc(key: Any) -> Desc:
    return Desc(key)


class Selector:
    """Columns chosen by a test on their field."""

    def __init__(self, test: Callable[[T.StructField], bool]):
        self.test = test

    def resolve(self, df: DataFrame) -> list[str]:
        return [f.name for f in df.schema.fields if self.test(f)]

    def __invert__(self) -> Selector:
        return Selector(lambda f: not self.test(f))

    def __or__(self, other: Selector) -> Selector:
        return Selector(lambda f: self.test(f) or other.test(f))

    def __and__(self, other: Selector) -> Selector:
        return Selector(lambda f: self.test(f) and other.test(f))


def starts_with(*prefixes: str) -> Selector:
    return Selector(lambda f: f.name.startswith(prefixes))


def ends_with(*suffixes: str) -> Selector:
    return Selector(lambda f: f.name.endswith(suffixes))


def contains(*parts: str) -> Selector:
    return Selector(lambda f: any(p in f.name for p in parts))


def matches(pattern: str) -> Selector:
    return Selector(lambda f: re.search(pattern, f.name) is not None)


def everything() -> Selector:
    return Selector(lambda f: True)


def where_type(*kinds: str) -> Selector:
    """By type name: 'numeric', or Spark's simple name."""
    return Selector(lambda f: ("numeric" in kinds and isinstance(f.dataType, NUMERIC)) or f.dataType.simpleString() in kinds)


def exclude(*columns: Any) -> Selector:
    names = {n for c in columns for n in (c.columns if isinstance(c, Frame) else [c])}
    return Selector(lambda f: f.name not in names)


class Range:
    """All columns from one to another by position, in either direction."""

    def __init__(self, start: str, end: str):
        self.start, self.end = start, end

    def resolve(self, df: DataFrame) -> list[str]:
        a, b = df.columns.index(self.start), df.columns.index(self.end)
        return df.columns[min(a, b) : max(a, b) + 1]

    def __invert__(self) -> Selector:
        return _NotRange(self)


class _NotRange(Selector):
    def __init__(self, inner: Range):
        self.inner = inner

    def resolve(self, df: DataFrame) -> list[str]:
        gone = self.inner.resolve(df)
        return [c for c in df.columns if c not in gone]


def cols_between(start: str, end: str) -> Range:
    return Range(start, end)


def resolve(df: DataFrame, cols: Sequence[Any]) -> list[str]:
    """Names, selectors, ranges, lists and frames as names of df, in order and once each."""
    out: list[str] = []
    for c in cols:
        if isinstance(c, str):
            out.append(c)
        elif isinstance(c, Selector | Range):
            out += c.resolve(df)
        elif isinstance(c, Frame):
            out += c.columns
        elif isinstance(c, Name):
            out.append(c.column)
        elif isinstance(c, list | tuple):
            out += resolve(df, c)
        else:
            raise TypeError(f"not a column selection: {c!r}")
    missing = [c for c in out if c not in df.columns]
    if missing:
        raise KeyError(f"no such column: {', '.join(missing)}")
    return list(dict.fromkeys(out))


def clean_name(name: str) -> str:
    snake = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name.strip()).replace("%", "_percent_").replace("#", "_number_")
    snake = re.sub(r"[^0-9a-zA-Z]+", "_", snake).strip("_").lower() or "x"
    return f"x{snake}" if snake[0].isdigit() else snake


class Frame:
    """A lazy table."""

    def __init__(self, df: DataFrame, order: Sequence[tuple[str, bool]] = ()):
        self.df, self.order = df, [o for o in order if o[0] in df.columns]
        self.ts: tuple[float, float, float] | None = None
        #: the same rows in range partitions of the order, where a function has written them
        self.placed: DataFrame | None = None

    # ------------------------------------------------------------ making
    @classmethod
    def parquet(cls, spark, path: str, order_by: Sequence[str] | str = ()) -> Frame:
        """A scan; ``order_by`` names the columns that order its rows uniquely."""
        return cls(spark.read.parquet(path), [(c, False) for c in ([order_by] if isinstance(order_by, str) else order_by)])

    def _new(self, df: DataFrame, order: Sequence[tuple[str, bool]] | None = None) -> Frame:
        return Frame(df, self.order if order is None else order)

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    @property
    def schema(self) -> T.StructType:
        return self.df.schema

    def __invert__(self) -> Selector:
        return exclude(*self.columns)

    # ------------------------------------------------------------ lowering
    def context(self, mode: str, keys: Sequence[str] = ()) -> Context:
        return Context(mode, [quote(k) for k in keys], order_columns(self.order), [(F.col(quote(c)), d) for c, d in self.order])

    def lower(self, exprs: Sequence[Expr], keys: Sequence[str] = ()) -> tuple[DataFrame, list[Column]]:
        """Columns over a frame to which what they need has been added."""
        c = self.context("window", keys)
        made = [e.build(c) for e in exprs]
        scans = any(not isinstance(column, Column) for _, column in c.hoisted)
        return c.added(self.placed if scans and self.placed is not None else self.df), made

    # ------------------------------------------------------------ rows
    def filter(self, *predicates: Any, **equal: Any) -> Frame:
        """Rows for which everything is true."""
        return self._filter(predicates, equal, ())

    def _filter(self, predicates: Sequence[Any], equal: dict[str, Any], keys: Sequence[str]) -> Frame:
        tests = [*predicates, *(col(k) == v for k, v in equal.items())]
        if not tests:
            return self
        test = tests[0]
        for t in tests[1:]:
            test = test & t
        df, (made,) = self.lower([test], keys)
        if df is self.df and not test.windowed:
            return self._new(df.where(made))
        return self._new(df.withColumn("__keep", made).where("__keep").select(*[quote(c) for c in self.columns]))

    def remove(self, *predicates: Any) -> Frame:
        """Rows for which not everything is true; unknown ones stay."""
        test = predicates[0]
        for t in predicates[1:]:
            test = test & t
        return self.filter(~test.fill_null(False))

    def arrange(self, *keys: Any) -> Frame:
        """Sorts; null and NaN come last in either direction.  The keys become the order key."""
        order, df = [], self.df
        sort = []
        for i, k in enumerate(keys):
            down, key = isinstance(k, Desc), k.key if isinstance(k, Desc) else k
            if isinstance(key, str) or isinstance(key, Name):
                name = key if isinstance(key, str) else key.column
                order.append((name, down))
                sort.append(_last(df, name, down))
            else:
                df, (made,) = Frame(df, self.order).lower([key])
                df = df.withColumn(f"__s{i}", made)
                sort.append(F.col(f"__s{i}").desc_nulls_last() if down else F.col(f"__s{i}").asc_nulls_last())
        known = {n for n, _ in order}
        tail = [(n, d) for n, d in self.order if n not in known]
        sort += [_last(df, n, d) for n, d in tail]
        return self._new(df.orderBy(*sort).select(*[quote(c) for c in self.columns]), [*order, *tail])

    def distinct(self, *cols: Any, keep_all: bool = False) -> Frame:
        """Different rows or key combinations; keep_all keeps the other columns of the first row."""
        keys = resolve(self.df, cols) if cols else self.columns
        if not cols:
            return self._new(self.df.distinct())
        if not keep_all:
            return self._new(self.df.select(*map(quote, keys)).distinct())
        return self._numbered(keys, lambda n: n == 1, self._require_order())

    def _require_order(self) -> list[Column]:
        if not self.order:
            raise ValueError("this verb needs an order: arrange() the frame or declare order_by")
        return order_columns(self.order)

    def _numbered(self, keys: Sequence[str], test: Callable[[Column], Column], order: Sequence[Column], function=F.row_number) -> Frame:
        w = Window.partitionBy(*map(quote, keys)).orderBy(*order)
        return self._new(self.df.withColumn("__n", function().over(w)).where(test(F.col("__n"))).drop("__n"))

    def slice_head(self, n: int = 1) -> Frame:
        return self._new((self.df.orderBy(*order_columns(self.order)) if self.order else self.df).limit(n))

    def slice_tail(self, n: int = 1) -> Frame:
        back = [(c, not d) for c, d in self.order]
        self._require_order()
        return self._new(self.df.orderBy(*order_columns(back)).limit(n).orderBy(*order_columns(self.order)))

    head, limit = slice_head, slice_head
    tail = slice_tail

    def slice_min(self, by: Any, n: int = 1, with_ties: bool = True) -> Frame:
        return self._extreme(by, n, with_ties, False, ())

    def slice_max(self, by: Any, n: int = 1, with_ties: bool = True) -> Frame:
        return self._extreme(by, n, with_ties, True, ())

    def _extreme(self, by: Any, n: int, with_ties: bool, down: bool, keys: Sequence[str]) -> Frame:
        df, (made,) = self.lower([named(by)], keys)
        df = df.withColumn("__by", made)
        by_column = F.col("__by").desc_nulls_last() if down else F.col("__by").asc_nulls_last()
        if not keys:  # top k by a bounded sort; ties by comparing with the k-th value
            top = df.orderBy(by_column, *order_columns(self.order)).limit(n)
            if with_ties:
                edge = top.agg(F.min("__by").alias("__lo"), F.max("__by").alias("__hi"), F.count(F.lit(1)).alias("__n"), F.count("__by").alias("__v"))
                df = df.crossJoin(F.broadcast(edge))
                inside = F.col("__by") >= F.col("__lo") if down else F.col("__by") <= F.col("__hi")
                df = df.where(F.when(F.col("__v") < F.col("__n"), F.lit(True)).otherwise(inside) & (F.col("__n") > 0))
            else:
                df = top
            return self._new(df.select(*map(quote, self.columns)))
        w = Window.partitionBy(*map(quote, keys))
        rank = F.rank().over(w.orderBy(by_column)) if with_ties else F.row_number().over(w.orderBy(by_column, *order_columns(self.order)))
        return self._new(df.withColumn("__n", rank).where(F.col("__n") <= n).select(*map(quote, self.columns)))

    def slice_sample(self, n: int | None = None, prop: float | None = None, replace: bool = False, seed: int | None = None) -> Frame:
        """Rows at random, whole; an exact number of them."""
        if (n is None) == (prop is None):
            raise ValueError("give one of n and prop")
        if n is None:
            n = int(self.df.count() * prop)
        if not replace:
            return self._new(self.df.orderBy(F.rand(seed)).limit(n))
        # how often each of all rows is drawn: places drawn at random, counted, and joined to numbered rows
        numbered = row_numbers(self.df, "__i", F.rand(seed))
        picks = self.df.sparkSession.range(n).select(F.floor(F.rand(seed) * self.df.count()).cast("bigint").alias("__i"))
        return self._new(numbered.join(picks, "__i").drop("__i"))

    # ------------------------------------------------------------ columns
    def mutate(self, *args: Expr, _before: Any = None, _after: Any = None, _keep: str = "all", _by: Any = None, **kwargs: Any) -> Frame:
        """Adds or replaces columns, one after the other; ``_by`` gives groups to every expression."""
        keys = resolve(self.df, [_by]) if _by is not None else []
        frame, new, used = self, [], set()
        for name, value in [*((a.name, a) for a in args), *kwargs.items()]:
            if name is None:
                raise ValueError("an expression needs a name: .alias() it or pass it by keyword")
            e = value.resolve_in(frame) if hasattr(value, "resolve_in") else as_expr(value)
            used |= e.uses
            df, (made,) = frame.lower([e], keys)
            columns = list(dict.fromkeys([*frame.columns, name]))
            meta = getattr(e, "metadata", None)
            df = df.withColumn(name, made.alias(name, metadata=meta) if meta else made)
            frame = frame._new(df if df.columns == columns else df.select(*map(quote, columns)))
            if "__scan_p" in df.columns and name not in dict(self.order):
                frame.placed = df.select(*map(quote, columns), "__scan_p", "__scan_i")
            new.append(name)
        new = list(dict.fromkeys(new))
        if _before is not None or _after is not None:
            frame = frame.relocate(*new, _before=_before, _after=_after)
        if _keep == "all":
            return frame
        stay = {"used": used, "unused": set(self.columns) - used, "none": set()}[_keep] | set(keys)
        return frame._new(frame.df.select(*[quote(c) for c in frame.columns if c in new or c in stay]))

    def transmute(self, *args: Expr, **kwargs: Any) -> Frame:
        return self.mutate(*args, _keep="none", **kwargs)

    def select(self, *cols: Any, **new: Any) -> Frame:
        """Columns by name, selector or range; ``new="old"`` renames, ``new=expression`` computes."""
        names = resolve(self.df, [c for c in cols if not isinstance(c, Expr) or isinstance(c, Name)])
        exprs = [c for c in cols if isinstance(c, Expr) and not isinstance(c, Name)]
        pairs = [(e.name, e) for e in exprs] + [(k, named(v) if isinstance(v, str) and v in self.columns else as_expr(v)) for k, v in new.items()]
        df, made = self.lower([e for _, e in pairs])
        return self._new(df.select(*map(quote, names), *[m.alias(k) for (k, _), m in zip(pairs, made, strict=True)]))

    def drop(self, *cols: Any, strict: bool = True) -> Frame:
        if not strict:
            return self._new(self.df.drop(*[c for c in cols if isinstance(c, str)]))
        return self._new(self.df.drop(*resolve(self.df, cols)))

    def rename(self, mapping: dict[str, str] | None = None, /, **new: str) -> Frame:
        """``{old: new}`` or ``new="old"``."""
        if mapping and new:
            raise ValueError("give a mapping or keywords, not both")
        pairs = mapping or {old: name for name, old in new.items()}
        resolve(self.df, list(pairs))
        return self._new(self.df.withColumnsRenamed(pairs), [(pairs.get(c, c), d) for c, d in self.order])

    def relocate(self, *cols: Any, _before: Any = None, _after: Any = None) -> Frame:
        """Moves columns, in the frame's order, to the front or next to an anchor (a name or a 1-based place) that is none of them."""
        if _before is not None and _after is not None:
            raise ValueError("give one of _before and _after")
        moved = set(resolve(self.df, cols))
        anchor = _before if _before is not None else _after
        # every column gets a place; movers take one just before or behind the anchor's
        place = {c: (float(i), 0) for i, c in enumerate(self.columns)}
        target = -1.0
        if anchor is not None:
            name = self.columns[anchor - 1] if isinstance(anchor, int) else resolve(self.df, [anchor])[0]
            if name in moved:
                raise ValueError(f"{name} can't be moved next to itself")
            target = place[name][0] + (-0.5 if _before is not None else 0.5)
        place |= {c: (target, i) for i, c in enumerate(self.columns) if c in moved}
        return self._new(self.df.select(*map(quote, sorted(self.columns, key=place.__getitem__))))

    def clean_names(self) -> Frame:
        seen: dict[str, int] = {}
        out = []
        for c in self.columns:
            name = clean_name(c)
            seen[name] = seen.get(name, 0) + 1
            out.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
        pairs = dict(zip(self.columns, out, strict=True))
        return self._new(self.df.toDF(*out), [(pairs[c], d) for c, d in self.order])

    def pull(self, column: str | int | None = None) -> DataFrame:
        """One column, lazily: by name or 1-based place, negative from the right; the last by default."""
        if column is None:
            column = self.columns[-1]
        elif isinstance(column, int):
            column = self.columns[column - 1 if column > 0 else column]
        return self.df.select(quote(column))

    # ------------------------------------------------------------ groups
    def group_by(self, *cols: Any, **derived: Any) -> Grouped:
        frame = self.mutate(**derived) if derived else self
        keys = [*resolve(frame.df, cols), *derived]
        if not keys:
            raise ValueError("group_by needs a key")
        return Grouped(frame, list(dict.fromkeys(keys)))

    def summarize(self, *args: Expr, _by: Any = None, _groups: str = "drop", **kwargs: Any) -> Frame | Grouped:
        """One row, or one for each group of ``_by``."""
        if _by is not None:
            return self.group_by(_by).summarize(*args, _groups=_groups, **kwargs)
        return self._new(aggregate_frame(self, [], args, kwargs), ())

    summarise = summarize

    def ungroup(self) -> Frame:
        return self

    def count(self, *cols: Any, wt: Any = None, sort: bool = False, name: str = "n", **derived: Any) -> Frame:
        """Rows, or the sum of ``wt``, of each combination."""
        frame = self.mutate(**derived) if derived else self
        keys = [*resolve(frame.df, cols), *derived]
        df, (weight,) = frame.lower([named(wt) if wt is not None else as_expr(1)])
        made = F.count(F.lit(1)) if wt is None else F.sum(weight)
        out = df.groupBy(*map(quote, keys)).agg(made.alias(name))
        return self._new(out.orderBy(F.col(name).desc(), *map(quote, keys)), [(name, True)]) if sort else self._new(out, ())

    # ------------------------------------------------------------ shape
    def nrow(self) -> int:
        return self.df.count()

    def ncol(self) -> int:
        return len(self.columns)

    def dim(self) -> tuple[int, int]:
        return self.nrow(), self.ncol()

    def complete_cases(self) -> DataFrame:
        return self.df.select(_complete(self.df).alias("complete"))

    def na_omit(self) -> Frame:
        """Rows without a null; NaN is a value."""
        return self._new(self.df.where(_complete(self.df)))

    drop_nulls = na_omit

    def fill(self, *cols: Any, direction: str = "down", _by: Any = None) -> Frame:
        """Carries the last (down) or next (up) value into nulls, in frame order."""
        order = self._require_order()
        part_by = list(map(quote, resolve(self.df, [_by]) if _by is not None else []))
        part = Window.partitionBy(*part_by).orderBy(*order)
        down = part.rowsBetween(Window.unboundedPreceding, 0)
        df = self.df if direction == "down" else self.df.withColumn("__at", F.row_number().over(part))
        up = Window.partitionBy(*part_by).orderBy(F.col("__at").desc()).rowsBetween(Window.unboundedPreceding, 0)
        made = {}
        for c in resolve(self.df, cols) if cols else self.columns:
            forward, backward = F.last(quote(c), ignorenulls=True).over(down), F.last(quote(c), ignorenulls=True).over(up)
            made[c] = {"down": forward, "up": backward, "downup": F.coalesce(forward, backward), "updown": F.coalesce(backward, forward)}[direction]
        return self._new(df.select(*[made[c].alias(c) if c in made else F.col(quote(c)) for c in self.columns]))

    def sql(self, query: str) -> Frame:
        """SQL over the frame, which is called ``self``."""
        return self._new(self.df.sparkSession.sql(re.sub(r"\bself\b", "{frame}", query), frame=self.df), ())

    def match_to_schema(self, schema: T.StructType) -> Frame:
        return self._new(self.df.to(schema))

    def pipe(self, function: Callable, *args: Any, **kwargs: Any) -> Any:
        return function(self, *args, **kwargs)

    def map_batches(self, function, schema) -> Frame:
        return self._new(self.df.mapInPandas(function, schema), ())

    def with_row_index(self, name: str = "index") -> Frame:
        """0-based place in the frame's order: sorted range partitions, written once, and the counts of those before."""
        return self._new(row_numbers(self.df, name, *self._require_order()))

    def collect(self):
        return self.df.toPandas()

    def lazy(self) -> Frame:
        return self

    def as_ts(self, start: float = 1.0, frequency: float = 1.0) -> Frame:
        out = self._new(self.df)
        out.ts = (start, start + (self.nrow() - 1) / frequency, frequency)
        return out

    def drop_ts(self) -> Frame:
        return self._new(self.df)

    def __repr__(self) -> str:
        return f"Frame[{', '.join(f'{n}: {t}' for n, t in self.df.dtypes)}]"


class Grouped:
    """A frame with grouping columns; expressions see one group at a time."""

    def __init__(self, frame: Frame, keys: list[str]):
        self.frame, self.keys = frame, keys

    @property
    def df(self) -> DataFrame:
        return self.frame.df

    @property
    def columns(self) -> list[str]:
        return self.frame.columns

    def groups(self) -> list[str]:
        return list(self.keys)

    def n_groups(self) -> int:
        return self.df.select(*map(quote, self.keys)).distinct().count()

    def ungroup(self) -> Frame:
        return self.frame

    def _again(self, frame: Frame, keys: list[str] | None = None) -> Grouped:
        return Grouped(frame, self.keys if keys is None else keys)

    def summarize(self, *args: Expr, _groups: str = "drop", **kwargs: Any) -> Frame | Grouped:
        out = self.frame._new(aggregate_frame(self.frame, self.keys, args, kwargs))
        if _groups == "drop":
            return out
        if _groups == "drop_last":
            return Grouped(out, self.keys[:-1]) if len(self.keys) > 1 else out
        if _groups in ("keep", "rowwise"):
            return Grouped(out, self.keys)
        raise ValueError("_groups is one of drop, drop_last, keep, rowwise")

    summarise = summarize

    def count(self, *cols: Any, sort: bool = False, name: str = "n", wt: Any = None) -> Frame:
        return self.frame.count(*self.keys, *cols, sort=sort, name=name, wt=wt)

    def mutate(self, *args: Expr, **kwargs: Any) -> Grouped:
        """All expressions see the frame as it was."""
        pairs = [*((a.name, a) for a in args), *((k, as_expr(v)) for k, v in kwargs.items())]
        df, made = self.frame.lower([e for _, e in pairs], self.keys)
        new = dict(zip([k for k, _ in pairs], made, strict=True))
        columns = [*self.columns, *(k for k in new if k not in self.columns)]
        return self._again(self.frame._new(df.select(*[new[c].alias(c) if c in new else F.col(quote(c)) for c in columns])))

    def transmute(self, *args: Expr, **kwargs: Any) -> Grouped:
        out = self.mutate(*args, **kwargs)
        new = [*(a.name for a in args), *kwargs]
        return self._again(out.frame._new(out.df.select(*map(quote, dict.fromkeys([*self.keys, *new])))))

    def filter(self, *predicates: Any, **equal: Any) -> Grouped:
        return self._again(self.frame._filter(predicates, equal, self.keys))

    def arrange(self, *keys: Any) -> Grouped:
        return self._again(self.frame.arrange(*keys))

    def select(self, *cols: Any, **new: Any) -> Grouped:
        chosen = resolve(self.df, cols)
        missing = [k for k in self.keys if k not in chosen and k not in new.values()]
        return self._again(self.frame.select(*missing, *chosen, **new))

    def distinct(self, *cols: Any, keep_all: bool = False) -> Grouped:
        return self._again(self.frame.distinct(*dict.fromkeys([*self.keys, *(resolve(self.df, cols) if cols else self.columns)]), keep_all=keep_all))

    def rename(self, mapping: dict[str, str] | None = None, /, **new: str) -> Grouped:
        pairs = mapping or {old: name for name, old in new.items()}
        return self._again(self.frame.rename(pairs), [pairs.get(k, k) for k in self.keys])

    def relocate(self, *cols: Any, **where: Any) -> Grouped:
        return self._again(self.frame.relocate(*cols, **where))

    def drop(self, *cols: Any, strict: bool = True) -> Grouped:
        if set(resolve(self.df, cols)) & set(self.keys):
            raise ValueError("a grouping column can't be dropped")
        return self._again(self.frame.drop(*cols, strict=strict))

    def slice_head(self, n: int = 1) -> Grouped:
        return self._again(self.frame._numbered(self.keys, lambda i: i <= n, self.frame._require_order()))

    def slice_tail(self, n: int = 1) -> Grouped:
        self.frame._require_order()
        return self._again(self.frame._numbered(self.keys, lambda i: i <= n, order_columns([(c, not d) for c, d in self.frame.order])))

    def slice_min(self, by: Any, n: int = 1, with_ties: bool = True) -> Grouped:
        return self._again(self.frame._extreme(by, n, with_ties, False, self.keys))

    def slice_max(self, by: Any, n: int = 1, with_ties: bool = True) -> Grouped:
        return self._again(self.frame._extreme(by, n, with_ties, True, self.keys))

    def slice_sample(self, n: int | None = None, prop: float | None = None, seed: int | None = None) -> Grouped:
        """n rows, or a share, of each group; rows stay whole."""
        if (n is None) == (prop is None):
            raise ValueError("give one of n and prop")
        w = Window.partitionBy(*map(quote, self.keys))
        df = self.df.withColumn("__r", F.rand(seed)).withColumn("__n", F.row_number().over(w.orderBy("__r")))
        most = F.lit(n) if n is not None else F.floor(F.count(F.lit(1)).over(w) * prop)
        return self._again(self.frame._new(df.withColumn("__m", most).where("__n <= __m").drop("__r", "__n", "__m")))

    def fill(self, *cols: Any, direction: str = "down") -> Grouped:
        return self._again(self.frame.fill(*cols, direction=direction, _by=self.keys))

    def __repr__(self) -> str:
        return f"{self.frame!r} by {', '.join(self.keys)}"


def order_columns(order: Sequence[tuple[str, bool]]) -> list[Column]:
    return [F.col(quote(c)).desc_nulls_last() if d else F.col(quote(c)).asc_nulls_last() for c, d in order]


def _last(df: DataFrame, name: str, down: bool) -> Column:
    """A sort key that puts null and NaN last and leaves the value alone."""
    c = F.col(quote(name))
    field = df.schema[name]
    levels = (field.metadata or {}).get("levels")
    if levels:
        c = F.array_position(F.array(*[F.lit(v) for v in levels]), c)
    elif isinstance(field.dataType, T.FloatType | T.DoubleType):
        c = F.nanvl(c, F.lit(None).cast(field.dataType))
    return c.desc_nulls_last() if down else c.asc_nulls_last()


def _complete(df: DataFrame) -> Column:
    out = F.lit(True)
    for c in df.columns:
        out = out & F.col(quote(c)).isNotNull()
    return out


def aggregate_frame(frame: Frame, keys: Sequence[str], args: Sequence[Expr], kwargs: dict[str, Any]) -> DataFrame:
    pairs = [*((a.name, a) for a in args), *((k, as_expr(v)) for k, v in kwargs.items())]
    c = frame.context("agg", keys)
    made = [e.build(c).alias(k) for k, e in pairs]
    df = c.added(frame.df)
    if not made:
        return df.select(*map(quote, keys)).distinct()
    return df.groupBy(*map(quote, keys)).agg(*made) if keys else df.agg(*made)


def tbl(obj: Any, spark=None) -> Frame:
    """A frame of a Spark or pandas frame, an Arrow table, or a dict of columns."""
    if isinstance(obj, Frame):
        return obj
    if isinstance(obj, DataFrame):
        return Frame(obj)
    import pandas as pd

    return Frame(spark.createDataFrame(pd.DataFrame(obj) if isinstance(obj, dict) else obj))


def glimpse(frame: Frame, n: int = 8) -> None:
    """A preview with one line for each column."""
    rows = frame.df.limit(n).collect()
    for name, kind in frame.df.dtypes:
        print(f"{name:<20} <{kind}> " + ", ".join(str(r[name]) for r in rows), file=sys.stdout)
