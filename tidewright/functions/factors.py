"""Factors: text columns whose levels, and whether they are ordered, travel in the column's metadata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import functions as F

from ..operators.frame import Frame
from .expr import quote

#: Levels that a factor may have.
MOST_LEVELS = 10_000


def _levels_of(frame: Frame, column: str) -> list[str]:
    meta = frame.df.schema[column].metadata or {}
    if "levels" in meta:
        return list(meta["levels"])
    rows = frame.df.select(F.col(quote(column)).alias("v")).where("v is not null").distinct().orderBy("v").limit(MOST_LEVELS + 1).collect()
    if len(rows) > MOST_LEVELS:
        raise ValueError(f"{column} has more than {MOST_LEVELS} levels")
    return [str(r[0]) for r in rows]


def _with(frame: Frame, column: str, values, levels: Sequence[str], ordered: bool | None = None) -> Frame:
    keep = (frame.df.schema[column].metadata or {}).get("ordered", False) if ordered is None else ordered
    return frame._new(frame.df.withColumn(column, values.alias(column, metadata={"levels": list(levels), "ordered": keep})))


def factor(frame: Frame, column: str, levels: Sequence[str] | None = None, labels: Sequence[str] | None = None, ordered: bool = False, strict: bool = False) -> Frame:
    """Makes a factor: numbers sort as numbers, text as text; other values become null, or an error when strict."""
    found = _levels_of(frame, column) if levels is None else [str(v) for v in levels]
    text = F.col(quote(column)).cast("string")
    if strict:
        text = F.when(text.isin(found) | text.isNull(), text).otherwise(F.raise_error(F.concat(F.lit("not a level: "), text)))
    if labels is None:
        return _with(frame, column, F.when(text.isin(found), text), found, ordered)
    pairs = dict(zip(found, labels, strict=True))
    return _with(frame, column, _mapped(text, pairs, None), list(dict.fromkeys(labels)), ordered)


def _mapped(text, pairs: dict[str, str], other):
    out = None
    for a, b in pairs.items():
        out = F.when(text == a, F.lit(b)) if out is None else out.when(text == a, F.lit(b))
    return out if out is None else out.otherwise(other)


def ordered(frame: Frame, column: str, levels: Sequence[str] | None = None) -> Frame:
    return factor(frame, column, levels, ordered=True)


fct = factor


def is_factor(frame: Frame, column: str) -> bool:
    return "levels" in (frame.df.schema[column].metadata or {})


def levels(frame: Frame, column: str) -> list[str]:
    return _levels_of(frame, column)


def nlevels(frame: Frame, column: str) -> int:
    return len(_levels_of(frame, column))


def _reordered(frame: Frame, column: str, order: list[str]) -> Frame:
    return _with(frame, column, F.col(quote(column)).cast("string"), order)


def _by_aggregate(frame: Frame, column: str, made, down: bool) -> Frame:
    rows = frame.df.where(F.col(quote(column)).isNotNull()).groupBy(F.col(quote(column)).cast("string").alias("l")).agg(made.alias("v")).limit(MOST_LEVELS).collect()
    known = _levels_of(frame, column)
    value = {r["l"]: r["v"] for r in rows}
    seen = [v for v in known if value.get(v) is not None]
    seen.sort(key=lambda v: value[v], reverse=down)
    return _reordered(frame, column, [*seen, *(v for v in known if v not in seen)])


def fct_reorder(frame: Frame, column: str, by: str, fn=F.median, desc: bool = False) -> Frame:
    """Levels by an aggregate of another column."""
    return _by_aggregate(frame, column, fn(quote(by)), desc)


def fct_reorder2(frame: Frame, column: str, x: str, y: str, desc: bool = True) -> Frame:
    """Levels by y at the largest x."""
    return _by_aggregate(frame, column, F.max_by(quote(y), quote(x)), desc)


def fct_rev(frame: Frame, column: str) -> Frame:
    return _reordered(frame, column, _levels_of(frame, column)[::-1])


def fct_relevel(frame: Frame, column: str, *first: str) -> Frame:
    return _reordered(frame, column, [*first, *(v for v in _levels_of(frame, column) if v not in first)])


def _counts(frame: Frame, column: str) -> list[tuple[str, int]]:
    rows = frame.df.where(F.col(quote(column)).isNotNull()).groupBy(F.col(quote(column)).cast("string").alias("l")).count().limit(MOST_LEVELS).collect()
    known = {v: i for i, v in enumerate(_levels_of(frame, column))}
    return sorted(((r["l"], r["count"]) for r in rows), key=lambda p: (-p[1], known.get(p[0], 0)))


def fct_infreq(frame: Frame, column: str) -> Frame:
    seen = [v for v, _ in _counts(frame, column)]
    return _reordered(frame, column, [*seen, *(v for v in _levels_of(frame, column) if v not in seen)])


def fct_recode(frame: Frame, column: str, **renames: str) -> Frame:
    """``new="old"``."""
    pairs = {old: new for new, old in renames.items()}
    text = F.col(quote(column)).cast("string")
    return _with(frame, column, _mapped(text, pairs, text), list(dict.fromkeys(pairs.get(v, v) for v in _levels_of(frame, column))))


def fct_collapse(frame: Frame, column: str, other_level: str | None = None, **groups: Sequence[str]) -> Frame:
    pairs = {old: new for new, olds in groups.items() for old in olds}
    known, text = _levels_of(frame, column), F.col(quote(column)).cast("string")
    if other_level is None:
        return _with(frame, column, _mapped(text, pairs, text), list(dict.fromkeys(pairs.get(v, v) for v in known)))
    values = F.when(text.isNotNull(), _mapped(text, pairs, F.lit(other_level)))
    return _with(frame, column, values, [*dict.fromkeys(pairs[v] for v in known if v in pairs), other_level])


def _lump(frame: Frame, column: str, stay: list[str], other: str) -> Frame:
    known, text = _levels_of(frame, column), F.col(quote(column)).cast("string")
    if len(stay) == len(known):
        return _reordered(frame, column, known)
    return _with(frame, column, F.when(text.isNull() | text.isin(stay), text).otherwise(F.lit(other)), [*(v for v in known if v in stay), other])


def fct_lump_n(frame: Frame, column: str, n: int, other_level: str = "Other") -> Frame:
    """The n most frequent levels, those as frequent as the n-th included."""
    counts = _counts(frame, column)
    edge = counts[n - 1][1] if len(counts) >= n else 0
    return _lump(frame, column, [v for v, c in counts if c >= edge], other_level)


def fct_lump_lowfreq(frame: Frame, column: str, other_level: str = "Other") -> Frame:
    """Lumps the rarest levels as long as their sum stays below every other level."""
    counts, stay = _counts(frame, column), []
    for i, (v, c) in enumerate(counts):
        stay.append(v)
        if sum(x for _, x in counts[i + 1 :]) < c:
            break
    return _lump(frame, column, stay, other_level)


def interaction(frame: Frame, *columns: str, name: str = "interaction", sep: str = ".") -> Frame:
    made = F.concat(*[x for i, c in enumerate(columns) for x in ([F.lit(sep)] if i else []) + [F.col(quote(c)).cast("string")]])
    out = frame._new(frame.df.withColumn(name, made))
    import itertools

    combos = [sep.join(p) for p in itertools.product(*[_levels_of(frame, c) for c in columns])]
    return _with(out, name, F.col(quote(name)), combos)


# ---------------------------------------------------------------- binning
def _even(frame: Frame, x: str) -> tuple[float, float]:
    low, high = frame.df.agg(F.min(quote(x)).cast("double"), F.max(quote(x)).cast("double")).first()
    return float(low), float(high)


def _binned(frame: Frame, x: str, breaks: list[float], closed: str, name: str) -> Frame:
    from .conditionals import cut

    return frame.mutate(**{name: cut(x, breaks, right=closed == "right", include_lowest=True)})


def cut_width(frame: Frame, x: str, width: float, center: float | None = None, boundary: float | None = None, closed: str = "right", name: str = "bin") -> Frame:
    import math

    low, high = _even(frame, x)
    at = width / 2 if boundary is None and center is None else (boundary if boundary is not None else center - width / 2)
    start = at + math.floor((low - at) / width) * width
    breaks = [start]
    while breaks[-1] < high:
        breaks.append(start + len(breaks) * width)
    return _binned(frame, x, breaks if len(breaks) > 1 else [start, start + width], closed, name)


def cut_interval(frame: Frame, x: str, n: int | None = None, length: float | None = None, closed: str = "right", name: str = "bin") -> Frame:
    low, high = _even(frame, x)
    if length is not None:
        import math

        start = math.floor(low / length) * length
        return _binned(frame, x, [start + i * length for i in range(int(math.ceil((high - start) / length)) + 1)], closed, name)
    return _binned(frame, x, [low + (high - low) * i / n for i in range(n + 1)], closed, name)


def cut_number(frame: Frame, x: str, n: int, closed: str = "right", name: str = "bin") -> Frame:
    breaks = frame.df.agg(F.percentile(quote(x), F.array(*[F.lit(i / n) for i in range(n + 1)]))).first()[0]
    if len(set(breaks)) != len(breaks):
        raise ValueError("not enough different values for so many bins")
    return _binned(frame, x, list(breaks), closed, name)
