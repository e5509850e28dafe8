"""Exact substring dedup by distributed prefix doubling.

A byte goes if a string of THRESHOLD bytes covers it that also starts in a
document with a smaller id.  Positions are ranked by ever longer strings that
start at them; a rank is a name that equal strings share, and the rank of a
longer string is the pair of two shorter ones' at a growing offset.  After each
round Spark brings equal ranks together, and positions whose rank one document
alone has drop out, until the threshold is reached.

Ranking all positions in the first round would write many times the corpus, so
it ranks a sample that no match can miss:

1. Of any THRESHOLD bytes the least hash among the SEED-byte strings inside
   picks one position, the anchor, alike wherever the bytes stand.  Each
   window start belongs to one anchor, and the starts of one anchor are
   adjacent: a stretch.  Anchors are ranked by their SEED bytes.
2. The stretches of the surviving anchors are ranked by all the bytes that
   their windows cover.  Where a smaller document has the same, the stretch is
   settled; only the first of equal stretches goes on, and only if its anchor's
   rank has stretches of other documents too.
3. What is left is ranked by single window starts, a pair of ranks at a growing
   offset each, which makes THRESHOLD bytes.  The stretches of one anchor's rank
   are sent as bytes and ranked together, as neighbouring starts share most of
   theirs; where a rank has very many stretches, its starts are sent as ranks
   and dealt by them.

Equal ranks within a chunk of a task are combined before they are sent: the
reducers see few rows for a rank that very many documents share, and the others
are dealt by a salt, as their fate is known.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textblocks as tb
from .runtime import arrow_map, cut

#: Bytes of a string that counts as repeated, and of those that are ranked first.
THRESHOLD, SEED = 50, 16
#: Ranks of anchors keep 48 bits; the others hold the salt of rows whose fate is known.  Two seeds of one rank only meet in round two.
_SEED_BITS, _SALTS = np.uint64(0xFFFFFFFFFFFF0000), np.uint64(0xFFFF)
_SPAN = THRESHOLD - SEED + 1  # seeds in a window
_HELD_ROWS = 1 << 19  # ranks that a task combines at once
_BLOCK_BYTES = 1 << 18  # covered bytes are several times those of a block
#: Stretches of one anchor's rank in a chunk, and in all, from which its starts are dealt one by one.
_HOT_IN_CHUNK, _HOT = 256, 4096
_SETTLED, _OPEN, _HOT_OPEN = 0, 1, 2
_SEGMENT = 1 << 22  # window starts that are anchored at once, below the bits kept for places


def anchors(data: np.ndarray, offs: np.ndarray):
    """For each anchor of a block: first and last window start, place, and the hash of its seed.

    Anchors come in the order of their window starts; texts below THRESHOLD
    bytes have none.
    """
    found = [_anchors(data, offs, s, min(s + _SEGMENT, len(data) - THRESHOLD + 1)) for s in range(0, max(len(data) - THRESHOLD + 1, 0), _SEGMENT)]
    if not found:
        return tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _anchors(data, offs, begin, stop):
    part = data[begin : stop + THRESHOLD - 1]
    prefix = tb.prefix_hash(part)
    at = np.arange(len(part) - SEED + 1)
    seeds = tb.span_hashes(prefix, at, at + SEED)
    bits = np.uint64(23)
    least = (seeds >> bits) << bits | at.astype(np.uint64)
    step = 1
    while 2 * step <= _SPAN:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if step < _SPAN:
        least = np.minimum(least[: -(_SPAN - step)], least[_SPAN - step :])
    place = (least & np.uint64((1 << 23) - 1)).astype(np.int64)
    start = np.arange(begin, stop)
    fits = start + THRESHOLD <= offs[np.searchsorted(offs, start, "right")]
    change = place[1:] != place[:-1]
    opens, closes = fits.copy(), fits.copy()
    opens[1:] &= change | ~fits[:-1]
    closes[:-1] &= change | ~fits[1:]
    lo, hi = np.flatnonzero(opens), np.flatnonzero(closes)
    return lo + begin, hi + begin, place[lo] + begin, seeds[place[lo]] & _SEED_BITS


def _usable(batch: pa.RecordBatch, listed: bool = False) -> pa.RecordBatch:
    """Rows with a key that are no copy; columns: key, text, copy, and a list that rows may have to have."""
    keep = np.asarray(batch.column(0).is_valid()) & ~np.asarray(batch.column(2).is_valid())
    if listed:
        keep &= np.asarray(batch.column(3).is_valid())
    return batch if keep.all() else batch.filter(pa.array(keep))


def _combining(rows_of: Callable, combined: Callable, listed: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A map over texts in blocks whose rows are combined some _HELD_ROWS at a time."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            batch = _usable(batch, listed)
            ids = batch.column(0).to_numpy()
            for first, end, data, offs in tb.blocks(batch.column(1), _BLOCK_BYTES):
                lists = batch.column(3).slice(first, end - first) if listed else None
                found = rows_of(data, offs, ids[first:end], lists)
                held.append(found)
                rows += len(found[0])
                if rows >= _HELD_ROWS:
                    yield combined(*(np.concatenate(x) for x in zip(*held, strict=True)))
                    held, rows = [], 0
        if rows:
            yield combined(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return over


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by the keys, the heads of equal ones in it, and the group of each row in it."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), dtype=bool)
    if len(order):
        new[1:] = np.logical_or.reduce([k[order[1:]] != k[order[:-1]] for k in keys])
    return order, np.flatnonzero(new), np.cumsum(new) - 1


def _salt(doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    return tb.mix64(doc.view(np.uint64) + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % _SALTS + np.uint64(1)


def _anchor_rows(data, offs, ids, _):
    """The different (seed, doc) of a block, in the order of the texts, where neighbours pack well."""
    lo, _, _, seed = anchors(data, offs)
    doc = np.searchsorted(offs, lo, "right") - 1
    _, once = np.unique(tb.mix64(seed + doc.astype(np.uint64)), return_index=True)
    once.sort()
    return seed[once], ids[doc[once]]


def _combined_anchors(seed, doc) -> pa.RecordBatch:
    """Seeds that both a smaller and a larger document of the chunk have get a salt, which says that they are shared."""
    seed = np.where(_between(doc, seed), seed | _salt(doc, np.zeros(len(doc), np.int64)), seed)
    return pa.RecordBatch.from_arrays([pa.array(seed.view(np.int64)), pa.array(doc)], names=["seed", "doc"])


def _listed(keys: tuple[np.ndarray, np.ndarray], lists: pa.ListArray) -> np.ndarray:
    """Rows (number, text) whose number the text's list has."""
    n = len(lists)
    theirs = lists.flatten().to_numpy().astype(np.int64) & 0xFFFFFFFF
    return np.flatnonzero(np.isin(keys[0] * n + keys[1], theirs * n + np.repeat(np.arange(n), lists.value_lengths().to_numpy())))


def _between(doc: np.ndarray, *ranks: np.ndarray) -> np.ndarray:
    """Rows of a rank that both a smaller and a larger document of the chunk have: the smallest and the largest stand for all."""
    order, heads, group = _groups(*ranks)
    by_rank = doc[order]
    out = np.zeros(len(doc), dtype=bool)
    out[order] = (by_rank != np.minimum.reduceat(by_rank, heads)[group]) & (by_rank != np.maximum.reduceat(by_rank, heads)[group])
    return out


def _stretch_rows(data, offs, ids, lists):
    """(seed, name, doc, lo, n) of the stretches whose seed the text's list has; lists hold half of a seed: a false match costs a row and changes nothing."""
    lo, hi, _, seed = anchors(data, offs)
    doc = np.searchsorted(offs, lo, "right") - 1
    live = _listed(((seed >> np.uint64(32)).astype(np.int64), doc), lists)
    lo, hi, seed, doc = lo[live], hi[live], seed[live], doc[live]
    name = tb.span_hashes(tb.prefix_hash(data), lo, hi + THRESHOLD)
    return seed, name, ids[doc], lo - offs[doc], hi - lo + 1


def _combined_stretches(seed, name, doc, lo, n) -> pa.RecordBatch:
    """Stretches that a smaller document of the chunk has are settled and get a salt.

    So do the others of a seed with many different ones, by their names, but
    for those of the smallest and the largest document, which tell the rest.
    """
    order, heads, group = _groups(seed, name)
    first = np.minimum.reduceat(doc[order], heads)
    settled = np.zeros(len(seed), dtype=bool)
    settled[order] = doc[order] > first[group]
    head_seed = seed[order][heads]
    by_seed = np.append(0, np.flatnonzero(head_seed[1:] != head_seed[:-1]) + 1)
    many = np.diff(np.append(by_seed, len(heads)))
    of_head = np.repeat(np.arange(len(by_seed)), many)
    apart = (first != np.minimum.reduceat(first, by_seed)[of_head]) & (first != np.maximum.reduceat(first, by_seed)[of_head])
    hot, salted = np.zeros((2, len(seed)), dtype=bool)
    hot[order] = (many > _HOT_IN_CHUNK)[of_head][group]
    salted[order] = apart[group]
    seed = np.where(settled, seed | _salt(doc, lo), np.where(hot & salted, seed | (name % _SALTS + np.uint64(1)), seed))
    return pa.RecordBatch.from_arrays(
        [pa.array(seed.view(np.int64)), pa.array(name.view(np.int64)), pa.array(doc), pa.array((lo << 6 | n).astype(np.int64)), pa.array(settled), pa.array(hot)],
        names=["seed", "name", "doc", "place", "sure", "hot"],
    )


def _in_state(lists: pa.ListArray, states: tuple[int, ...]):
    """(text, seed, lo, n) of the listed stretches in one of the states."""
    flat = lists.flatten()
    seed, place = flat.field(0).to_numpy(), flat.field(1).to_numpy()
    row = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy())
    here = np.flatnonzero(np.isin(seed & 3, states))
    return row[here], seed[here] & ~3, place[here] >> 6, place[here] & 63


def _context_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(seed, context, doc, lo): the bytes that the windows of the open stretches cover."""
    for batch in batches:
        batch = _usable(batch, True)
        ids = batch.column(0).to_numpy()
        for first, end, data, offs in tb.blocks(batch.column(1), _BLOCK_BYTES):
            doc, seed, lo, n = _in_state(batch.column(3).slice(first, end - first), (_OPEN,))
            size = n + (THRESHOLD - 1)
            until = np.concatenate(([0], np.cumsum(size)))
            raw = data[np.repeat(lo + offs[doc] - until[:-1], size) + np.arange(until[-1])]
            context = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lo), [None, pa.py_buffer(until.astype(np.int64)), pa.py_buffer(raw)])
            yield pa.RecordBatch.from_arrays([pa.array(seed), context.cast(pa.binary()), pa.array(ids[first:end][doc]), pa.array(lo.astype(np.int32))], names=["seed", "context", "doc", "lo"])


def _ranked_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(at, lo, n): runs of starts that a smaller document has too; rows come by seed, and at most _HOT of one."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        seed = batch.column(0).to_numpy()
        change = np.flatnonzero(seed[1:] != seed[:-1])
        if not len(change):
            held.append(batch)
            continue
        cut_at = int(change[-1]) + 1
        yield _ranked(pa.Table.from_batches([*held, batch.slice(0, cut_at)]))
        held = [batch.slice(cut_at)]
    if held:
        yield _ranked(pa.Table.from_batches(held))


def _ranked(rows: pa.Table) -> pa.RecordBatch:
    seed, doc, lo = (rows[c].to_numpy() for c in ("seed", "doc", "lo"))
    data, offs = tb.arrow_bytes(rows["context"])
    n = np.diff(offs) - (THRESHOLD - 1)
    row = np.repeat(np.arange(len(n)), n)
    i = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    one, two = _pair_of(data, offs[:-1][row] + i)
    order, heads, group = _groups(seed[row], one, two)
    hit = np.zeros(len(row), dtype=bool)
    hit[order] = doc[row][order] > np.minimum.reduceat(doc[row][order], heads)[group] if len(heads) else False
    opens, closes = hit.copy(), hit.copy()
    if len(hit):
        same = row[1:] == row[:-1]
        opens[1:] &= ~(hit[:-1] & same)
        closes[:-1] &= ~(hit[1:] & same)
    a, z = np.flatnonzero(opens), np.flatnonzero(closes)
    return pa.RecordBatch.from_arrays([pa.array(doc[row[a]]), pa.array((lo[row[a]] + i[a]).astype(np.int32)), pa.array((z - a + 1).astype(np.int32))], names=["at", "lo", "n"])


def _pair_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ranks of the 2 * SEED bytes at a start and at the offset where they reach THRESHOLD."""
    prefix = tb.prefix_hash(data)
    return tuple(tb.span_hashes(prefix, at + k, at + k + 2 * SEED) for k in (0, THRESHOLD - 2 * SEED))


def _start_rows(data, offs, ids, lists):
    """(rank, doc, tail) of the window starts of the hot stretches; tail: 32 more bits of the rank, and the place."""
    doc, _, lo, n = _in_state(lists, (_HOT_OPEN,))
    doc = np.repeat(doc, n)
    at = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    one, two = _pair_of(data, at + offs[doc])
    rank = tb.mix64(one * np.uint64(0x9E3779B97F4A7C15) + two)
    return rank, ids[doc], (tb.mix64(one + two * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32) << np.uint64(32)) | at.astype(np.uint64)


def _combined_starts(rank, doc, tail) -> pa.RecordBatch:
    """Starts whose rank both a smaller and a larger document of the chunk have get a salt, and a bit of the tail that tells."""
    known = _between(doc, rank, tail >> np.uint64(32))
    rank = np.where(known, rank ^ _salt(doc, tail.view(np.int64) & 0xFFFFFFFF), rank)
    tail = np.where(known, tail | np.uint64(1 << 31), tail)
    return pa.RecordBatch.from_arrays([pa.array(rank.view(np.int64)), pa.array(doc), pa.array(tail.view(np.int64))], names=["rank", "doc", "tail"])


def _copies(base: DataFrame) -> DataFrame:
    """(copy, doc): documents whose whole text a smaller one has."""
    digests = base.where("doc is not null and t is not null").select("doc", F.md5(F.col("t").cast("binary")).alias("m"))
    first = digests.groupBy("m").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").select("m", "first")
    return cut(digests.join(cut(first), "m").where("doc > first").select(F.col("doc").alias("copy")).distinct())


def _lists(rows: DataFrame, value: Column) -> DataFrame:
    """(_d, list): the values of each document's rows."""
    return rows.groupBy(F.col("doc").alias("_d")).agg(F.collect_list(value).alias("list"))


def _with_lists(main: DataFrame, lists: DataFrame) -> DataFrame:
    return main.join(lists, F.col("doc") == F.col("_d"), "left").select("doc", "t", "copy", "list")


def judged_stretches(main: DataFrame) -> DataFrame:
    """(_d, list): for each document its stretches that are settled or open, as (seed and state, lo << 6 | n)."""
    salts = int(_SALTS)
    by_seed = Window.partitionBy("seed")

    # anchors by SEED bytes
    seeds = arrow_map(main.select("doc", "t", "copy"), _combining(_anchor_rows, _combined_anchors, False), "seed bigint, doc bigint").repartition("seed")
    shared = seeds.select("seed", "doc", F.min("doc").over(by_seed).alias("a"), F.max("doc").over(by_seed).alias("z")).where(f"a < z or seed & {salts} <> 0")
    lists = _lists(shared, F.shiftright("seed", 32).cast("int"))

    # stretches by all their bytes
    stretches = arrow_map(_with_lists(main, lists), _combining(_stretch_rows, _combined_stretches, True), "seed bigint, name bigint, doc bigint, place bigint, sure boolean, hot boolean")
    ranked = stretches.repartition("seed").withColumn("first", F.min("doc").over(Window.partitionBy("seed", "name")))
    ranked = ranked.select(
        "*", F.min("first").over(by_seed).alias("a"), F.max("first").over(by_seed).alias("z"),
        (F.max("hot").over(by_seed) | (F.count("*").over(by_seed) > _HOT)).alias("many"),
    )
    state = F.when(F.expr("sure or doc > first"), _SETTLED).when(F.expr("many"), _HOT_OPEN).when(F.expr("a < z"), _OPEN)
    judged = ranked.select("doc", "seed", "place", state.alias("state")).where("state is not null")
    return _lists(judged, F.struct(F.expr(f"seed & {~salts} | state").alias("s"), "place"))


def repeated_starts(listed: DataFrame) -> DataFrame:
    """(at, lo, n): runs of n window starts, from lo on, in open stretches, whose strings start in a smaller document too.

    ``listed``: doc, t, copy (not null for rows that take no part), list of judged stretches.
    """
    contexts = arrow_map(listed, _context_rows, "seed bigint, context binary, doc bigint, lo int").repartition("seed").sortWithinPartitions("seed")
    some = arrow_map(contexts, _ranked_contexts, "at bigint, lo int, n int")
    starts = arrow_map(listed, _combining(_start_rows, _combined_starts, True), "rank bigint, doc bigint, tail bigint").repartition("rank")
    ranked = starts.withColumn("first", F.min("doc").over(Window.partitionBy("rank", F.shiftright("tail", 31))))
    found = ranked.where(f"doc > first or tail & {1 << 31} <> 0").select(F.col("doc").alias("at"), F.expr(f"int(tail & {(1 << 31) - 1})").alias("lo"), F.lit(1).alias("n"))
    return some.unionByName(found)


def dedup_suffixes(docs: DataFrame, key: str = "doc_id", text: str = "text", with_bytes: bool = False) -> DataFrame:
    """One row for each row of docs: key, n_bytes, n_removed, n_spans, kept_sha256, and with with_bytes the kept bytes.

    Strings are judged on the input, never across documents.  Null and empty
    texts have no bytes.  Keys are integers; rows without one are left whole
    and take nothing from others; rows of equal key are one document, so they
    take nothing from each other.
    """
    base = docs.select(docs[key].alias("doc"), docs[text].alias("t"))
    base = base.withColumn("doc", F.col("doc").cast("bigint")) if docs.schema[key].dataType.simpleString() != "bigint" else base
    main = base.join(_copies(base), F.col("doc") == F.col("copy"), "left")
    listed = _with_lists(main, judged_stretches(main))
    starts = repeated_starts(listed).groupBy("at").agg(F.collect_list(F.struct("lo", "n")).alias("s")).select("at", F.col("s.lo").alias("lo"), F.col("s.n").alias("n"))
    joined = listed.join(starts, F.col("doc") == F.col("at"), "left").select("doc", "t", "copy", "list", "lo", "n")

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offs in tb.blocks(batch.column(1), _BLOCK_BYTES):
                n = end - first
                gone = np.zeros(len(data) + 1, dtype=np.int64)
                copy = np.asarray(batch.column(2).slice(first, n).is_valid()) & (np.diff(offs) >= THRESHOLD)
                np.add.at(gone, offs[:-1][copy], 1)
                np.add.at(gone, offs[1:][copy], -1)
                row, _, lo, size = _in_state(batch.column(3).slice(first, n), (_SETTLED,))
                begin, runs = [lo + offs[row]], [size]
                lists, sizes = batch.column(4).slice(first, n), batch.column(5).slice(first, n)
                begin.append(lists.flatten().to_numpy() + np.repeat(offs[:-1], lists.value_lengths().fill_null(0).to_numpy()))
                runs.append(sizes.flatten().to_numpy())
                begin, runs = np.concatenate(begin), np.concatenate(runs)
                np.add.at(gone, begin, 1)
                np.add.at(gone, begin + runs + (THRESHOLD - 1), -1)
                stay = np.cumsum(gone[:-1]) == 0
                rest = np.concatenate(([0], np.cumsum(stay)))[offs]
                opens = ~stay
                if len(opens):
                    opens[1:] &= stay[:-1]
                    heads = offs[:-1][np.diff(offs) > 0]
                    opens[heads] = ~stay[heads]
                spans = np.concatenate(([0], np.cumsum(opens)))[offs]
                kept = np.ascontiguousarray(data[stay])
                view, cuts = memoryview(kept), list(zip(rest[:-1].tolist(), rest[1:].tolist(), strict=True))
                out = [
                    batch.column(0).slice(first, n), pa.array(np.diff(offs)), pa.array(np.diff(offs) - np.diff(rest)), pa.array(np.diff(spans)),
                    pa.array([hashlib.sha256(view[a:b]).hexdigest() for a, b in cuts]),
                ]
                if with_bytes:
                    out.append(pa.array([bytes(view[a:b]) for a, b in cuts], pa.binary()))
                yield pa.RecordBatch.from_arrays(out, names=names)

    names = [key, "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept_bytes"] if with_bytes else [])]
    return arrow_map(joined, over, f"`{key}` bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + (", kept_bytes binary" if with_bytes else ""))
