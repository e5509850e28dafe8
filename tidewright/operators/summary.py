"""Printed summaries: a block for each column, made from one aggregate and a count for each factor."""

from __future__ import annotations

import math
import platform
from dataclasses import dataclass

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import quote
from .frame import NUMERIC, Frame


@dataclass
class Summary:
    """(label, value) lines by column."""

    blocks: dict[str, list[tuple[str, object]]]

    def __repr__(self) -> str:
        return "\n".join(f"{name}\n" + "\n".join(f"  {label:<10}{_show(value)}" for label, value in lines) for name, lines in self.blocks.items())


def _show(value: object) -> str:
    return format_signif(value) if isinstance(value, float) else str(value)


def summary(frame: Frame, maxsum: int = 7) -> Summary:
    """Six numbers for numbers and times, counts for booleans and factors, the shape of text; nulls are counted apart."""
    df = frame.df
    parts, kinds = [F.count(F.lit(1)).alias("__n")], {}
    for f in df.schema.fields:
        c = F.col(quote(f.name))
        parts.append(F.count_if(c.isNull()).alias(f"na|{f.name}"))
        if (f.metadata or {}).get("levels"):
            kinds[f.name] = "factor"
        elif isinstance(f.dataType, NUMERIC) or isinstance(f.dataType, T.DateType | T.TimestampType | T.TimestampNTZType):
            kinds[f.name] = "number" if isinstance(f.dataType, NUMERIC) else "time"
            x = c.cast("double") if kinds[f.name] == "number" else (F.unix_date(c) if isinstance(f.dataType, T.DateType) else F.unix_micros(c.cast("timestamp"))).cast("double")
            parts += [F.percentile(x, F.array(*[F.lit(p) for p in (0.0, 0.25, 0.5, 0.75, 1.0)])).alias(f"q|{f.name}"), F.avg(x).alias(f"m|{f.name}")]
        elif isinstance(f.dataType, T.BooleanType):
            kinds[f.name] = "boolean"
            parts += [F.count_if(~c).alias(f"f|{f.name}"), F.count_if(c).alias(f"t|{f.name}")]
        else:
            kinds[f.name] = "text"
    row = df.agg(*parts).first()
    blocks = {}
    for f in df.schema.fields:
        name, kind = f.name, kinds[f.name]
        if kind in ("number", "time"):
            q, m = row[f"q|{name}"] or [None] * 5, row[f"m|{name}"]
            values = [q[0], q[1], q[2], m, q[3], q[4]]
            if kind == "time":
                values = [None if v is None else _time(v, isinstance(f.dataType, T.DateType)) for v in values]
            lines = list(zip(("Min.", "1st Qu.", "Median", "Mean", "3rd Qu.", "Max."), values, strict=True))
        elif kind == "boolean":
            lines = [("FALSE", row[f"f|{name}"]), ("TRUE", row[f"t|{name}"])]
        elif kind == "factor":
            counts = {r[0]: r[1] for r in df.where(F.col(quote(name)).isNotNull()).groupBy(quote(name)).count().limit(10_000).collect()}
            ordered = sorted(f.metadata["levels"], key=lambda v: -counts.get(v, 0))
            shown = ordered if len(ordered) <= maxsum else ordered[: maxsum - 1]
            lines = [(v, counts.get(v, 0)) for v in (f.metadata["levels"] if shown is ordered else shown)]
            if shown is not ordered:
                lines.append(("(Other)", sum(counts.get(v, 0) for v in ordered[maxsum - 1 :])))
        else:
            lines = [("Length", row["__n"]), ("Class", f.dataType.simpleString())]
        if row[f"na|{name}"]:
            lines.append(("NA's", row[f"na|{name}"]))
        blocks[name] = lines
    return Summary(blocks)


def _time(value: float, date: bool):
    import datetime as dt

    start = dt.datetime(1970, 1, 1)
    return (start + dt.timedelta(days=value)).date() if date else start + dt.timedelta(microseconds=value)


# ---------------------------------------------------------------- formatting
def significance_code(p: float) -> str:
    return "***" if p < 0.001 else "**" if p < 0.01 else "*" if p < 0.05 else "." if p < 0.1 else ""


def format_signif(value: float, digits: int = 4) -> str:
    return f"{value:.{digits}g}"


def format_signif_jointly(columns: list[list[float | None]], digits: int = 4) -> list[list[str]]:
    """Columns with one number of decimals, with which the smallest number but 0 has ``digits`` digits; at least one."""
    sizes = [abs(v) for column in columns for v in column if v is not None and math.isfinite(v) and v != 0 and 1e-5 <= abs(v) < 1e15]
    places = min(max(1, digits - 1 - math.floor(math.log10(min(sizes)))), 15) if sizes else 1
    show = lambda v: "" if v is None else "NaN" if math.isnan(v) else ("Inf" if v > 0 else "-Inf") if math.isinf(v) else f"{v:.{places}f}" if v == 0 or abs(v) >= 1e-5 else format_signif(v, digits)
    return [[show(v) for v in column] for column in columns]


def cat(*args: object, sep: str = " ", end: str = "") -> str:
    """Prints values next to each other, without quotes; lists are spread."""
    parts = [str(v) for a in args for v in (a if isinstance(a, list | tuple) else [a])]
    text = sep.join(parts) + end
    print(text, end="" if end or text.endswith("\n") else "\n")
    return text


def format_pval(p: float, digits: int = 4, eps: float = 2.2e-16) -> str:
    return f"<{eps:.2g}" if p < eps else format_signif(p, digits)


def format_df(frame: Frame, n: int = 20) -> str:
    return frame.df.limit(n).toPandas().to_string(index=False)


def session_info(spark) -> dict[str, str]:
    import numpy
    import pandas
    import pyarrow

    return {"python": platform.python_version(), "platform": platform.platform(), "spark": spark.version, "numpy": numpy.__version__, "pandas": pandas.__version__, "pyarrow": pyarrow.__version__}
