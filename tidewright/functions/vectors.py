"""Small vectors on the driver: sequences, repetition, permutations; and their columns where a frame is given."""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Sequence
from typing import Any

import numpy as np
from pyspark.sql import functions as F

from ..operators.frame import NUMERIC, Frame
from ..operators.ranges import least_gap
from .expr import quote

_random = random.Random()


def set_seed(seed: int) -> None:
    _random.seed(seed)


def seq(start: float, stop: float | None = None, by: float | None = None, length_out: int | None = None) -> list[float]:
    """0 to n - 1 for one number; both ends included for two."""
    if stop is None:
        return list(range(int(start)))
    if length_out is not None:
        return [start + (stop - start) * i / (length_out - 1) for i in range(length_out)] if length_out > 1 else [start]
    by = (1 if stop >= start else -1) if by is None else by
    return [start + by * i for i in range(int(math.floor((stop - start) / by + 1e-10)) + 1)]


def seq_len(n: int) -> list[int]:
    return list(range(n))


def rep(x: Any, times: int | Sequence[int] = 1, each: int = 1, length_out: int | None = None) -> list[Any]:
    values = list(x) if isinstance(x, list | tuple) else [x]
    out = [v for v in values for _ in range(each)]
    out = out * times if isinstance(times, int) else [v for v, k in zip(out, times, strict=True) for _ in range(k)]
    return out if length_out is None else [out[i % len(out)] for i in range(length_out)]


def seq_along(x: Sequence[Any]) -> list[int]:
    return list(range(len(x)))


def matrix(data: Any, nrow: int | None = None, ncol: int | None = None, byrow: bool = False) -> np.ndarray:
    """A small matrix, filled by columns; short data is repeated."""
    values = np.atleast_1d(np.asarray(data))
    size = values.size
    if nrow is None:
        nrow = -(-size // ncol) if ncol else size
    ncol = -(-size // nrow) if ncol is None else ncol
    return np.resize(values.ravel(), nrow * ncol).reshape((nrow, ncol), order="C" if byrow else "F")


def apply(frame: Frame, margin: int, function: Callable[[Any], float], *columns: str) -> Frame:
    """A callable over the columns (2): each is an expression maker and gives one aggregate; or over rows (1): it gets a NumPy row and gives a double, in Arrow batches."""
    names = list(columns) or frame.columns
    if margin == 2:
        return frame.summarize(**{c: function(c) for c in names})
    import pandas as pd

    def over(batches):
        for pdf in batches:
            yield pd.DataFrame({"value": [float(function(row)) for row in pdf.to_numpy()]})

    return Frame(frame.df.select(*map(quote, names)).mapInPandas(over, "value double"))


def is_numeric(frame: Frame, column: str) -> bool:
    return isinstance(frame.schema[column].dataType, NUMERIC)


def str_sort(frame: Frame, column: str, decreasing: bool = False, na_last: bool = True) -> Frame:
    """The values of a column in order, by code point."""
    c = F.col(quote(column))
    key = (c.desc_nulls_last() if na_last else c.desc_nulls_first()) if decreasing else (c.asc_nulls_last() if na_last else c.asc_nulls_first())
    return Frame(frame.df.select(quote(column)).orderBy(key), [(column, decreasing)])


def rev(x: Sequence[Any]) -> list[Any]:
    return list(x)[::-1]


def sample(x: int | Sequence[Any], size: int | None = None, replace: bool = False, prob: Sequence[float] | None = None) -> list[Any]:
    """Draws; a number stands for 1 to n."""
    values = list(range(1, x + 1)) if isinstance(x, int) else list(x)
    size = len(values) if size is None else size
    if replace:
        return _random.choices(values, weights=prob, k=size)
    if prob is None:
        return _random.sample(values, size)
    keys = sorted(range(len(values)), key=lambda i: -math.log(1 - _random.random()) / prob[i] if prob[i] > 0 else math.inf)
    return [values[i] for i in keys[:size]]


def sapply(x: Sequence[Any], function: Callable[[Any], Any]) -> list[Any]:
    return [function(v) for v in x]


# ---------------------------------------------------------------- over frames
def unique(frame: Frame, column: str) -> Frame:
    """Values in the order in which they first come."""
    order = [F.col(quote(c)) for c, _ in frame.order] or [F.lit(0)]
    out = frame.df.groupBy(quote(column)).agg(F.min(F.struct(*order)).alias("__o"))
    return frame._new(out.orderBy("__o").select(quote(column)), ())


def order(frame: Frame, *keys: str, decreasing: bool = False) -> Frame:
    """0-based places in the frame of its rows in sorted order."""
    indexed = frame.with_row_index("place")
    return Frame(indexed.df.orderBy(*[F.col(quote(k)).desc_nulls_last() if decreasing else F.col(quote(k)).asc_nulls_last() for k in keys], "place").select("place"))


def which(frame: Frame, condition: Any) -> Frame:
    """0-based places of the rows for which a condition holds."""
    return frame.with_row_index("place").filter(condition).select("place")


def which_max(frame: Frame, column: str) -> int:
    """0-based place of the first largest value."""
    return frame.with_row_index("place").df.where(F.col(quote(column)).isNotNull()).agg(F.min(F.struct((-F.col(quote(column))).alias("v"), F.col("place"))).alias("m")).first()["m"]["place"]


def which_min(frame: Frame, column: str) -> int:
    return frame.with_row_index("place").df.where(F.col(quote(column)).isNotNull()).agg(F.min(F.struct(F.col(quote(column)).alias("v"), F.col("place"))).alias("m")).first()["m"]["place"]


def sweep(frame: Frame, columns: Sequence[str], statistics: Sequence[float], function: str = "-") -> Frame:
    """A number for each column taken from it (or added, multiplied, divided)."""
    made = {"-": lambda a, b: a - b, "+": lambda a, b: a + b, "*": lambda a, b: a * b, "/": lambda a, b: a / b}[function]
    new = {c: made(F.col(quote(c)), F.lit(s)) for c, s in zip(columns, statistics, strict=True)}
    return frame._new(frame.df.select(*[new[c].alias(c) if c in new else F.col(quote(c)) for c in frame.columns]))


def resolution(frame: Frame, column: str) -> float:
    """The smallest gap between different values; 1 for fewer than two."""
    values = frame.df.select(F.col(quote(column)).cast("double").alias("v")).where("v is not null").distinct()
    gap = least_gap(values, "v")
    return 1.0 if gap is None else float(gap)
