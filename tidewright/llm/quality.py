"""Quality rules: counts of a text, and repetition by a suffix array over its words.

The suffix array of every text of a block is built at once by prefix doubling
(only suffixes that still share their rank are sorted again; words of
different texts never compare equal).  Longest common prefixes of neighbours
are measured in the order of the text, where each is at least one word shorter
than the one before, so memory is some arrays of the words.  An interval of the LCP array whose value is v is a
maximal repeated substring of v words, occurring at each suffix inside; the
deepest interval around a suffix has the larger of its two neighbouring LCP
values, so the union of the spans of all intervals is the union of
[i, i + that value).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textblocks as tb
from .runtime import arrow_map

#: Base rule: fewest words, and most percent of words in repeated 3-word windows.
LEAST_WORDS, MOST_REPEAT_PERCENT = 50, 50
#: A repeated substring counts towards the covered fraction from so many words.
LEAST_REPEAT = 6
#: The method's limits: percent of words covered, and words of the longest repeat.
#: Covered words all lie in repeated 3-word windows, so a limit of MOST_REPEAT_PERCENT
#: or more has no effect.  Texts labelled good that pass the other rules have at most
#: 28.6 % covered (327 at sf0.01, 3243 at sf0.1).
MOST_COVERED_PERCENT, MOST_LONGEST = 30, 100

#: Suffixes between two that are measured in turn; words compared at once.
_LANE, _CELLS = 64, 1 << 20

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[np.frombuffer(b"#*$%&|<>", dtype=np.uint8)] = True

SCHEMA = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, covered_words bigint, longest_repeat bigint"


def suffix_order(ids: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The suffixes in lexicographic order, each up to the end of its text, by prefix doubling."""
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    new = np.ones(n, dtype=bool)
    new[1:] = ids[order[1:]] != ids[order[:-1]]
    starts = np.flatnonzero(new)
    size = np.diff(np.append(starts, n))
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.repeat(starts, size)
    step = 1
    active = order[np.repeat(size > 1, size)]
    while len(active):
        ahead = active + step
        second = np.where(ahead < end[active], rank[np.minimum(ahead, n - 1)] + 1, 0)
        key = rank[active] << 32 | second
        order = np.argsort(key, kind="stable")
        active, key = active[order], key[order]
        m = len(active)
        new = np.ones(m, dtype=bool)
        new[1:] = key[1:] != key[:-1]
        starts = np.flatnonzero(new)
        size = np.diff(np.append(starts, m))
        old = key >> 32
        group = np.ones(m, dtype=bool)
        group[1:] = old[1:] != old[:-1]
        group_at = np.flatnonzero(group)
        offset = starts - group_at[np.searchsorted(group_at, starts, "right") - 1]
        rank[active] = old + np.repeat(offset, size)
        step *= 2
        active = active[np.repeat(size > 1, size)]
    suffix = np.empty(n, dtype=np.int64)
    suffix[rank] = np.arange(n)
    return suffix


def _extended(ids: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """The common prefixes of the suffixes a and b, known to agree for ``length`` words, up to ``limit``."""
    live = np.flatnonzero(length < limit)
    live = live[ids[a[live] + length[live]] == ids[b[live] + length[live]]]
    length[live] += 1
    width = 8
    while len(live):
        width = max(1, min(2 * width, _CELLS // len(live)))
        far = length[live, None] + np.arange(width)
        inside = far < limit[live, None]
        last = len(ids) - 1
        same = inside & (ids[np.minimum(a[live, None] + far, last)] == ids[np.minimum(b[live, None] + far, last)])
        run = np.where(same.all(axis=1), width, same.argmin(axis=1))
        length[live] += run
        live = live[run == width]
    return length


def neighbour_lcp(ids: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each suffix the longest prefix, in words, that another suffix of its text has too.

    ``ids``: words as integers that differ between texts.  ``end``: for each
    word the end of its text.  A suffix shares with its predecessor in the
    suffix array at least one word less than the suffix before it in the text
    shares with its own.  So every _LANE-th suffix is measured in turn, going
    on from the one before, and from there the lanes go on in step.
    """
    n = len(ids)
    if n == 0:
        return np.zeros(0, np.int64)
    suffix = suffix_order(ids, end)
    before = np.full(n, -1, dtype=np.int64)
    before[suffix[1:]] = suffix[:-1]
    limit = np.where(before >= 0, np.minimum(end - np.arange(n), end[before] - before), 0)
    head = np.arange(0, n, _LANE)
    shared = np.zeros(n, dtype=np.int64)
    known = 0
    for i, b, most in zip(head.tolist(), before[head].tolist(), limit[head].tolist(), strict=True):
        known = max(known - _LANE, 0)
        if known < most and ids[i + known] == ids[b + known]:
            known = int(_extended(ids, np.array([i]), np.array([b]), np.array([known]), np.array([most]))[0])
        shared[i] = known
    for step in range(1, min(_LANE, n)):
        at = head[head + step < n] + step
        shared[at] = _extended(ids, at, before[at], np.maximum(shared[at - 1] - 1, 0), limit[at])
    out = shared.copy()
    has = np.flatnonzero(before >= 0)
    out[before[has]] = np.maximum(out[before[has]], shared[has])
    return out


def covered(at: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in a span."""
    edge = np.bincount(at, minlength=n + 1) - np.bincount(at + length, minlength=n + 1)
    return np.cumsum(edge[:n]) > 0


def measure(data: np.ndarray, offs: np.ndarray, least_repeat: int = LEAST_REPEAT) -> dict[str, np.ndarray]:
    """The counts of every text of a block."""
    n_docs = len(offs) - 1
    starts, ends, doc = tb.words(data, offs)
    per_doc = lambda flags: np.bincount(doc[flags], minlength=n_docs)
    n_words = np.bincount(doc, minlength=n_docs)

    def of_bytes(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flags)))
        return total[offs[1:]] - total[offs[:-1]]

    word_chars = of_bytes(~tb.SPACE[data] & ((data & 0xC0) != 0x80))
    n_symbols = of_bytes(SYMBOLS[data])
    # lines: the pieces between line feeds, those with a word
    feed = np.flatnonzero(data == 10)
    line_start = np.unique(np.concatenate([offs[:-1], feed + 1]))
    line_start = line_start[line_start < len(data)]
    if len(line_start):
        with_word = np.zeros(len(line_start), dtype=bool)
        with_word[np.searchsorted(line_start, starts, "right") - 1] = True
        begin = line_start[with_word]
        limit = np.append(line_start[1:], len(data))[with_word]
        owner = np.searchsorted(offs, begin, "right") - 1
        stop = np.minimum(limit, offs[owner + 1])
        stop = stop - (data[stop - 1] == 10)
        line = tb.hash_spans(data, begin, stop)
        _, first = np.unique(tb.mix64(line + owner.astype(np.uint64)), return_index=True)
        n_dup_lines = np.bincount(owner, minlength=n_docs) - np.bincount(owner[first], minlength=n_docs)
    else:
        n_dup_lines = np.zeros(n_docs, np.int64)
    word = tb.hash_spans(data, starts, ends)
    end = np.cumsum(n_words)[doc] if len(doc) else np.zeros(0, np.int64)
    longest = neighbour_lcp(tb.mix64(word + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), end)
    window = np.flatnonzero(longest >= 3)
    repeat = np.flatnonzero(longest >= least_repeat)
    most = np.zeros(n_docs, np.int64)
    np.maximum.at(most, doc[repeat], longest[repeat])
    return {
        "n_words": n_words,
        "word_chars": word_chars,
        "n_symbols": n_symbols,
        "n_dup_lines": n_dup_lines,
        "n_repeat_words": per_doc(covered(window, np.full(len(window), 3), len(doc))),
        "covered_words": per_doc(covered(repeat, longest[repeat], len(doc))),
        "longest_repeat": most,
    }


def judge_quality(
    df: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (),
    most_covered_percent: int = MOST_COVERED_PERCENT, most_longest: int = MOST_LONGEST, least_repeat: int = LEAST_REPEAT,
) -> DataFrame:
    """One row for each row of df: key, the columns named in ``keep``, the counts and the verdict.

    base_failed: fewer than 50 words, or more than half of the words in
    3-word windows that the text has twice.  kept: not base_failed, at most
    ``most_covered_percent`` of the words covered by repeats of
    ``least_repeat`` words or more, and no repeat longer than
    ``most_longest`` words.  A null or empty text has counts of 0 and fails
    the base rule.  Repeated rows are judged alike, other columns not read.
    """
    names = [key, *keep]

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offs in tb.blocks(batch.column(len(names))):
                m = measure(data, offs, least_repeat)
                failed = (m["n_words"] < LEAST_WORDS) | (100 * m["n_repeat_words"] > MOST_REPEAT_PERCENT * m["n_words"])
                kept = ~failed & (100 * m["covered_words"] <= most_covered_percent * m["n_words"]) & (m["longest_repeat"] <= most_longest)
                counts = [pa.array(m[c].astype(np.int64)) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
                more = [pa.array(m[c].astype(np.int64)) for c in ("covered_words", "longest_repeat")]
                own = [batch.column(i).slice(first, end - first) for i in range(len(names))]
                out = [*own, *counts, pa.array(failed), pa.array(kept), *more]
                yield pa.RecordBatch.from_arrays(out, names=[*names, *(c.split()[0] for c in SCHEMA.split(", "))])

    picked = df.select(*[df[c].alias(f"k{i}") for i, c in enumerate(names)], df[text].alias("t"))
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names)
    return arrow_map(picked, over, f"{kinds}, {SCHEMA}")
