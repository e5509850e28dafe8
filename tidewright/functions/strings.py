"""String, parsing and date functions within rows."""

from __future__ import annotations

import re
import textwrap
from typing import Any

import pandas as pd
from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .expr import Context, Expr, as_expr, compose, named

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def parse_number(x: Any) -> Expr:
    """The first number in a text, without thousands separators."""
    return compose(lambda a: F.nullif(F.regexp_extract(F.replace(a, F.lit(","), F.lit("")), r"(-?\d+(?:\.\d+)?)", 1), F.lit("")).try_cast("double"), named(x))


def parse_double(x: Any) -> Expr:
    """The whole text as a number, or null."""
    return compose(lambda a: F.when(F.trim(a).rlike(NUMBER), F.trim(a).try_cast("double")), named(x))


def str_c(*args: Any, sep: str = "", collapse: str | None = None) -> Expr:
    """Texts side by side, null where one is; strings are literals."""
    parts = [as_expr(a) for a in args]

    def build(*columns: Column) -> Column:
        cells = []
        for i, c in enumerate(columns):
            cells += ([F.lit(sep)] if i and sep else []) + [c.cast("string")]
        return F.concat(*cells)

    joined = compose(build, *parts)
    return joined if collapse is None else str_flatten(joined, collapse)


def str_glue(template: str, **values: Any) -> Expr:
    """``{name}`` stands for a value given here, else for the column."""
    parts: list[Any] = []
    for text, field in re.findall(r"([^{}]*)(?:\{([^{}]+)\})?", template):
        parts += ([text] if text else []) + ([as_expr(values[field]) if field in values else named(field)] if field else [])
    return str_c(*parts) if parts else as_expr("")


def str_flatten(x: Any, collapse: str = "", last: str | None = None) -> Expr:
    """All values of a group in the frame's order, nulls left out; ``last`` joins the last two."""

    e = named(x)

    def build(c: Context) -> Column:
        row = Context("row", c.keys, c.order, c.plain, c.hoisted, c.totals)
        a = e.build(row)
        order = [o.alias(f"o{i}") for i, (o, _) in enumerate(c.plain)]
        cells = F.transform(F.array_sort(F.collect_list(F.when(a.isNotNull(), F.struct(*order, a.cast("string").alias("v"))))), lambda s: s["v"])
        if last is None:
            made = F.array_join(cells, collapse)
        else:
            n = F.size(cells)
            head = F.array_join(F.slice(cells, 1, F.greatest(n - 1, F.lit(0))), collapse)
            made = F.when(n > 1, F.concat(head, F.lit(last), F.element_at(cells, -1))).otherwise(F.array_join(cells, collapse))
        if c.mode == "agg":
            return made
        return made.over(Window.partitionBy(*c.keys)) if c.keys else c.total(made)

    return Expr(build, e.uses, True, e.name, True)


def str_length(x: Any) -> Expr:
    return compose(F.char_length, named(x))


def str_sub(x: Any, start: int = 0, end: int | None = None) -> Expr:
    """From start up to end, counted from 0, negatives from the end of the text."""

    def build(a: Column) -> Column:
        size = F.char_length(a)
        low = F.lit(start) if start >= 0 else F.greatest(size + start, F.lit(0))
        high = size if end is None else (F.lit(end) if end >= 0 else size + end)
        return F.substring(a, low + 1, F.greatest(high - low, F.lit(0)))

    return compose(build, named(x))


def str_to_upper(x: Any) -> Expr:
    return compose(F.upper, named(x))


def str_to_lower(x: Any) -> Expr:
    return compose(F.lower, named(x))


def str_to_title(x: Any) -> Expr:
    """A capital behind anything that is no letter."""

    @F.pandas_udf(StringType())
    def title(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else v.title())

    return compose(title, named(x))


def str_wrap(x: Any, width: int = 80, indent: int = 0, exdent: int = 0) -> Expr:
    @F.pandas_udf(StringType())
    def wrap(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else textwrap.fill(" ".join(v.split()), width, initial_indent=" " * indent, subsequent_indent=" " * exdent, break_long_words=False, break_on_hyphens=False))

    return compose(wrap, named(x))


def str_equal(x: Any, y: Any, ignore_case: bool = False) -> Expr:
    return compose((lambda a, b: F.lower(a) == F.lower(b)) if ignore_case else (lambda a, b: a == b), named(x), y)


def str_detect(x: Any, pattern: str, negate: bool = False) -> Expr:
    return compose((lambda a: ~a.rlike(pattern)) if negate else (lambda a: a.rlike(pattern)), named(x))


def str_count(x: Any, pattern: str = r"\s+") -> Expr:
    return compose(lambda a: F.regexp_count(a, F.lit(pattern)), named(x))


def str_replace_all(x: Any, pattern: str, replacement: str) -> Expr:
    return compose(lambda a: F.regexp_replace(a, pattern, replacement), named(x))


# dates: formats that an order of parts accepts, fixed values
_DATES = {
    "ymd": ("yyyy-M-d", "yyyy/M/d", "yyyy.M.d", "yyyyMMdd", "yyyy MMM d", "yyyy MMMM d"),
    "mdy": ("M-d-yyyy", "M/d/yyyy", "M.d.yyyy", "MMddyyyy", "MMM d yyyy", "MMMM d yyyy"),
    "dmy": ("d-M-yyyy", "d/M/yyyy", "d.M.yyyy", "ddMMyyyy", "d MMM yyyy", "d MMMM yyyy"),
}


#: What the letters of a format can stand for, at the widest; months are named in English.
_SHAPES = {"yyyy": r"[+-]?\d+", "M": r"[+-]?\d+", "d": r"[+-]?\d+", "H": r"[+-]?\d+", "m": r"[+-]?\d+", "s": r"[+-]?\d+", "MMM": r"\D{3}", "MMMM": r"\D{3,}"}


def _shape(form: str) -> str:
    """A pattern that every text of the format fits."""
    letters = re.sub("yyyyMMdd|MMddyyyy|ddMMyyyy", "yyyy", form)  # digits without a sign between them
    parts = re.findall(r"([a-zA-Z])(\1*)|([^a-zA-Z])", letters)
    return "^" + "".join(re.escape(sign) if sign else _SHAPES[first + more] for first, more, sign in parts) + "$"


def _parsed(order: str, clock: str | None, quiet: bool):
    formats = [f if clock is None else f"{f} {clock}" for f in _DATES[order]]

    def build(a: Column) -> Column:
        text = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(a.cast("string")), r"(\d)(st|nd|rd|th)\b", "$1"), ",", " "), r"[\sT]+", " ")

        def read(t: Column) -> Column:
            # a format is tried only on texts of its shape: one that doesn't fit costs a Java exception
            tries = [F.when(t.rlike(_shape(f)), F.try_to_timestamp(t, F.lit(f))) for f in formats]
            if not quiet:
                tries.append(F.when(t.isNotNull(), F.raise_error(F.concat(F.lit(f"not a date in the order {order}: "), t)).cast("timestamp")))
            return F.coalesce(*tries)

        # the variable of a lambda function is worked out once, a column anew in each place
        found = F.transform(F.array(text), read)[0]
        return found.cast("date") if clock is None else found.cast("timestamp_ntz")

    return build


def _date(order: str, clock: str | None = None):
    return lambda x, quiet=False: compose(_parsed(order, clock, quiet), named(x))


ymd, mdy, dmy = _date("ymd"), _date("mdy"), _date("dmy")
ymd_hms, mdy_hms, dmy_hms = (_date(o, "H:m:s") for o in ("ymd", "mdy", "dmy"))
ymd_hm, mdy_hm, dmy_hm = (_date(o, "H:m") for o in ("ymd", "mdy", "dmy"))

_STRPTIME = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%b": "MMM", "%B": "MMMM", "%y": "yy", "%j": "DDD"}


def as_date(x: Any, format: str | None = None) -> Expr:  # noqa: A002
    if format is None:
        return compose(lambda a: a.cast("date"), named(x))
    for a, b in _STRPTIME.items():
        format = format.replace(a, b)  # noqa: A001
    return compose(lambda a: F.to_date(a, format), named(x))


def today(tzone: str = "") -> Expr:
    return compose(lambda: F.to_date(F.convert_timezone(None, F.lit(tzone), F.current_timestamp().cast("timestamp_ntz"))) if tzone else F.current_date())


def now(tzone: str = "") -> Expr:
    return compose(lambda: F.convert_timezone(None, F.lit(tzone), F.current_timestamp().cast("timestamp_ntz")) if tzone else F.current_timestamp())


def from_epoch(x: Any, unit: str = "s") -> Expr:
    """A time from seconds, milliseconds, microseconds or days (a date)."""
    made = {"s": F.timestamp_seconds, "ms": F.timestamp_millis, "us": F.timestamp_micros, "d": F.date_from_unix_date}[unit]
    return compose(made, named(x))


