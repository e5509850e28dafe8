"""Expressions that know where they stand.

An Expr is lowered to a Column in one of three places: within rows, as an
aggregate of a group, or as a window over a frame's groups.  ``mean(x)`` is
``avg(x)`` in summarize, ``avg(x) OVER (PARTITION BY keys)`` in a grouped
mutate or filter, and a value joined in from one aggregate row where there are
no groups.  Windows inside windows or aggregates are put into columns of their
own first, because Spark doesn't nest them.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..operators.scans import step

_serial = itertools.count()


@dataclass
class Context:
    """Where an expression is lowered: mode is 'row', 'agg' or 'window'."""

    mode: str
    keys: list[str] = field(default_factory=list)
    order: list[Column] = field(default_factory=list)
    #: the same as comparable columns, each with whether it descends
    plain: list[tuple[Column, bool]] = field(default_factory=list)
    #: columns to add first, one after the other: expressions, or functions (frame, name) that return the frame with the column
    hoisted: list[tuple[str, Column | Callable[[DataFrame, str], DataFrame]]] = field(default_factory=list)
    #: aggregates over the whole frame
    totals: list[tuple[str, Column]] = field(default_factory=list)

    def hoist(self, column: Column | Callable[[DataFrame, str], DataFrame]) -> Column:
        name = f"__h{next(_serial)}"
        self.hoisted.append((name, column))
        return F.col(name)

    def total(self, column: Column) -> Column:
        name = f"__t{next(_serial)}"
        self.totals.append((name, column))
        return F.col(name)

    def needed_order(self, order_by: Sequence[Column] = ()) -> list[Column]:
        order = list(order_by) or self.order
        if not order:
            raise ValueError("an order-sensitive function needs an order: arrange() the frame, declare order_by, or pass order_by=")
        return order

    def ordered(self, order_by: Sequence[Column] = ()) -> WindowSpec:
        """The window of a group's rows in order; a frame without groups takes scan() instead."""
        return Window.partitionBy(*self.keys).orderBy(*self.needed_order(order_by))

    def scan(self, run: Callable[[DataFrame, str], DataFrame], order_by: Sequence[Column] = ()) -> Column:
        """A column that ``run`` adds to the rows of the whole frame, in range partitions of the order."""
        return self.hoist(step(self.needed_order(order_by), run, bool(order_by)))

    def added(self, df: DataFrame) -> DataFrame:
        """df with the totals and the hoisted columns."""
        if self.totals:
            df = df.crossJoin(F.broadcast(df.agg(*[column.alias(name) for name, column in self.totals])))
        for name, column in self.hoisted:
            df = df.withColumn(name, column) if isinstance(column, Column) else column(df, name)
        return df


class Expr:
    """A deferred column; ``windowed`` tells whether lowering it makes a window."""

    def __init__(self, build: Callable[[Context], Column], uses: frozenset[str] = frozenset(), windowed: bool = False, name: str | None = None, aggregate: bool = False):
        self.build, self.uses, self.windowed, self.name, self.aggregate = build, uses, windowed, name, aggregate

    def alias(self, name: str) -> Expr:
        return Expr(self.build, self.uses, self.windowed, name, self.aggregate)

    def __bool__(self) -> bool:
        raise TypeError("an expression has no truth value; use & | ~")

    def __hash__(self) -> int:
        return id(self)

    def _with(self, other: Any, op: Callable[[Column, Column], Column]) -> Expr:
        return compose(op, self, other)

    def __add__(self, o):
        return compose(lambda a, b: a + b, self, o)

    def __radd__(self, o):
        return compose(lambda a, b: b + a, self, o)

    def __sub__(self, o):
        return compose(lambda a, b: a - b, self, o)

    def __rsub__(self, o):
        return compose(lambda a, b: b - a, self, o)

    def __mul__(self, o):
        return compose(lambda a, b: a * b, self, o)

    def __rmul__(self, o):
        return compose(lambda a, b: b * a, self, o)

    def __truediv__(self, o):
        return compose(divide, self, o)

    def __rtruediv__(self, o):
        return compose(lambda a, b: divide(b, a), self, o)

    def __floordiv__(self, o):
        return compose(lambda a, b: F.floor(divide(a, b)), self, o)

    def __mod__(self, o):
        return compose(lambda a, b: F.try_mod(F.try_mod(a, b) + b, b), self, o)

    def __pow__(self, o):
        return compose(lambda a, b: F.pow(a, b), self, o)

    def __neg__(self):
        return compose(lambda a: -a, self)

    def __eq__(self, o):  # noqa: PLW1641
        return Comparison("==", self, o)

    def __ne__(self, o):
        return compose(lambda a, b: a != b, self, o)

    def __lt__(self, o):
        return Comparison("<", self, o)

    def __le__(self, o):
        return Comparison("<=", self, o)

    def __gt__(self, o):
        return Comparison(">", self, o)

    def __ge__(self, o):
        return Comparison(">=", self, o)

    def __and__(self, o):
        return compose(lambda a, b: a & b, self, o)

    def __rand__(self, o):
        return compose(lambda a, b: b & a, self, o)

    def __or__(self, o):
        return compose(lambda a, b: a | b, self, o)

    def __ror__(self, o):
        return compose(lambda a, b: b | a, self, o)

    def __invert__(self):
        return compose(lambda a: ~a, self)

    # methods
    def is_null(self) -> Expr:
        return compose(lambda a: a.isNull(), self)

    is_na = is_null

    def is_not_null(self) -> Expr:
        return compose(lambda a: a.isNotNull(), self)

    def is_nan(self) -> Expr:
        return compose(F.isnan, self)

    def fill_null(self, value: Any) -> Expr:
        return compose(lambda a, b: F.coalesce(a, b), self, value)

    def cast(self, kind: str) -> Expr:
        return compose(lambda a: a.cast(kind), self)

    def is_in(self, values: Sequence[Any], nulls_equal: bool = False) -> Expr:
        """Membership; values may be expressions, aggregates among them."""
        tests = [compose((lambda a, b: a.eqNullSafe(b)) if nulls_equal else (lambda a, b: a == b), self, v) for v in values]
        if not tests:
            return compose(lambda a: F.lit(False), self)
        out = tests[0]
        for t in tests[1:]:
            out = out | t
        return out

    def eq_missing(self, o: Any) -> Expr:
        return compose(lambda a, b: a.eqNullSafe(b), self, o)

    def is_close(self, o: Any, abs_tol: float = 0.0, rel_tol: float = 1e-9) -> Expr:
        return compose(lambda a, b: F.abs(a - b) <= F.lit(abs_tol) + F.lit(rel_tol) * F.abs(b), self, o)

    def between(self, low: Any, high: Any) -> Expr:
        return compose(lambda a, b, c: a.between(b, c), self, low, high)

    def sum(self) -> Expr:
        return aggregate(F.sum, self)

    def mean(self) -> Expr:
        return aggregate(F.avg, self)

    def min(self) -> Expr:
        return aggregate(F.min, self)

    def max(self) -> Expr:
        return aggregate(F.max, self)

    def count(self) -> Expr:
        return aggregate(F.count, self)

    def any(self) -> Expr:
        return aggregate(F.bool_or, self)

    def all(self) -> Expr:
        return aggregate(F.bool_and, self)


class Comparison(Expr):
    """A comparison that remembers its sides, for join conditions."""

    def __init__(self, op: str, left: Expr, right: Any):
        ops = {"==": lambda a, b: a == b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
        made = compose(ops[op], left, right)
        super().__init__(made.build, made.uses, made.windowed, None, made.aggregate)
        self.op, self.left, self.right = op, left, right

    def __bool__(self) -> bool:
        if self.op == "==":
            return self.left is self.right
        raise TypeError("an expression has no truth value; use & | ~")


class Name(Expr):
    """A column by name."""

    def __init__(self, column: str):
        super().__init__(lambda c: F.col(quote(column)), frozenset([column]), name=column)
        self.column = column


def quote(name: str) -> str:
    return name if name.replace("_", "a").isalnum() else "`" + name.replace("`", "``") + "`"


def col(name: str) -> Name:
    return Name(name)


def lit(value: Any) -> Expr:
    return Expr(lambda c: F.lit(value))


def sql(text: str, *uses: str) -> Expr:
    """A Spark SQL expression within rows."""
    return Expr(lambda c: F.expr(text), frozenset(uses))


def as_expr(value: Any) -> Expr:
    """Expressions as they are, anything else as a literal."""
    return value if isinstance(value, Expr) else lit(value)


def named(value: Any) -> Expr:
    """Strings as columns, expressions as they are."""
    return value if isinstance(value, Expr) else col(value)


def compose(function: Callable[..., Column], *args: Any) -> Expr:
    """A function of values in the same row."""
    parts = [as_expr(a) for a in args]
    return Expr(
        lambda c: function(*(p.build(c) for p in parts)), frozenset().union(*(p.uses for p in parts)),
        any(p.windowed for p in parts), next((p.name for p in parts if p.name), None), any(p.aggregate for p in parts),
    )


def _rows(parts: list[Expr], c: Context) -> list[Column]:
    """Arguments of an aggregate or window: within rows, with their own windows put into columns."""
    inner = Context("window" if any(p.windowed for p in parts) else "row", c.keys, c.order, c.plain, c.hoisted, c.totals)
    return [c.hoist(p.build(inner)) if p.windowed else p.build(inner) for p in parts]


def aggregate(function: Callable[..., Column], *args: Any) -> Expr:
    """A function of a group."""
    parts = [as_expr(a) for a in args]

    def build(c: Context) -> Column:
        made = function(*_rows(parts, c))
        if c.mode == "agg":
            return made
        return made.over(Window.partitionBy(*c.keys)) if c.keys else c.total(made)

    return Expr(build, frozenset().union(*(p.uses for p in parts)) if parts else frozenset(), True, next((p.name for p in parts if p.name), None), True)


def windowed(function: Callable[..., Column], *args: Any) -> Expr:
    """A function (context, columns...) that makes windows itself."""
    parts = [as_expr(a) for a in args]

    def build(c: Context) -> Column:
        return function(c, *_rows(parts, c))

    return Expr(build, frozenset().union(*(p.uses for p in parts)) if parts else frozenset(), True, next((p.name for p in parts if p.name), None))


def divide(a: Column, b: Column) -> Column:
    """IEEE division: infinities and NaN instead of an error."""
    a, b = a.cast("double"), b.cast("double")
    by_zero = F.when(a.isNull(), None).when((a == 0) | F.isnan(a), F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(b == 0, by_zero).otherwise(F.try_divide(a, b))


def n() -> Expr:
    """Rows of the group."""
    return aggregate(lambda: F.count(F.lit(1))).alias("n")


def n_distinct(x: Any) -> Expr:
    """Different values; null counts as one."""
    return aggregate(lambda a: F.count_distinct(a) + F.max(F.when(a.isNull(), 1).otherwise(0)), named(x))
