"""Substring dedup by content-defined chunks.

A gear hash rolls over the bytes; a chunk ends where the hash is larger than
at all places near before and not smaller than at those near behind.  Whether
a place is an end depends on a few bytes around it only, so an insertion moves
the ends around it and no others, and a passage is cut alike wherever it
stands.  A chunk whose digest
also occurs in a document with a smaller id is a duplicate.  Runs of adjacent
duplicates of enough bytes are removed; shorter ones, which ordinary phrases
make by chance, stay (``least_run=0`` removes them all).

Equal chunks within a block of a task are combined before they are sent: only
the smallest document's goes to where the digest is judged, the others are
known to be duplicates and are dealt by a salt.  So a chunk that very many
documents share is no large group anywhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textblocks as tb
from .runtime import arrow_map

#: Bytes that the gear hash sees, and places on either side among which an end has the largest hash.
WINDOW, RADIUS = 16, 16
#: Bytes of adjacent duplicate chunks from which they are removed.
LEAST_RUN = 100
#: Chunks that a task combines at once; bits of a digest that hold the salt of known duplicates.
_HELD_ROWS, _SALTS = 1 << 18, 0xFFFF

GEAR = (tb.mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) & np.uint64(0xFFFF)).astype(np.uint32)


def chunk_ends(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Ends of all chunks of a block of texts; every text that is not empty ends one, and none lies within a code point."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    h = GEAR[data]
    step = 1
    while step < WINDOW:  # h is the sum of the last 2 * step gear values, shifted by age
        h[step:] += h[:-step] << np.uint32(step)
        step *= 2
    # largest value of each 2 * RADIUS + 1 places; 0 stands for places outside a text or with another text in the window
    place = np.arange(n) - offs[np.searchsorted(offs, np.arange(n), "right") - 1]
    h = np.where(place >= WINDOW - 1, (h & np.uint32((1 << WINDOW) - 1)) + np.uint32(1), np.uint32(0))
    padded = np.concatenate([np.zeros(RADIUS, np.uint32), h, np.zeros(RADIUS, np.uint32)])
    most, step = padded, 1
    while 2 * step <= RADIUS:
        most = np.maximum(most[:-step], most[step:])
        step *= 2
    if step < RADIUS:
        most = np.maximum(most[: -(RADIUS - step)], most[RADIUS - step :])
    before, behind = most[:n], most[RADIUS + 1 : RADIUS + 1 + n]  # of the RADIUS places on either side
    at = np.flatnonzero((h > before) & (h >= behind) & (h > 0)) + 1
    for _ in range(3):  # move behind the code point
        at = at + ((at < n) & ((data[np.minimum(at, n - 1)] & 0xC0) == 0x80))
    return np.unique(np.concatenate([at, offs[1:][np.diff(offs) > 0]]))


def chunks(data: np.ndarray, offs: np.ndarray):
    """Starts, ends, texts and 112-bit digests (two integers, 16 bits of the first 0) of the chunks of a block."""
    ends = chunk_ends(data, offs)
    starts = np.concatenate(([0], ends[:-1])).astype(np.int64) if len(ends) else ends
    raw, digest = memoryview(np.ascontiguousarray(data)), xxhash.xxh3_128_digest
    joined = b"".join([digest(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
    digests = np.frombuffer(joined, dtype="<i8").reshape(-1, 2) & np.array([~_SALTS, -1])
    return starts, ends, np.searchsorted(offs, starts, "right") - 1, digests


def _chunk_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(hi, lo, doc): the different chunks of each document that has a key; hi with a salt for those that a smaller one is known to have."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for first, end, data, offs in tb.blocks(batch.column(1)):
                _, _, doc, digest = chunks(data, offs)
                _, once = np.unique(tb.mix64(digest[:, 0].view(np.uint64) + doc.astype(np.uint64)) ^ digest[:, 1].view(np.uint64), return_index=True)
                once.sort()  # rows of a text side by side pack well
                held.append((digest[once, 0], digest[once, 1], ids[first:end][doc[once]]))
                n += len(once)
                if n >= _HELD_ROWS:
                    yield _combined(*(np.concatenate(x) for x in zip(*held, strict=True)))
                    held, n = [], 0
        if n:
            yield _combined(*(np.concatenate(x) for x in zip(*held, strict=True)))

    rows = docs.where(docs[key].isNotNull()).select(docs[key].cast("bigint"), docs[text])
    return arrow_map(rows, over, "hi bigint, lo bigint, doc bigint")


def _combined(hi: np.ndarray, lo: np.ndarray, doc: np.ndarray) -> pa.RecordBatch:
    order = np.lexsort((lo, hi))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (hi[order[1:]] != hi[order[:-1]]) | (lo[order[1:]] != lo[order[:-1]])
    least = np.minimum.reduceat(doc[order], np.flatnonzero(new))[np.cumsum(new) - 1]
    known = np.zeros(len(order), dtype=bool)
    known[order] = doc[order] > least
    salt = (tb.mix64(doc.view(np.uint64) ^ lo.view(np.uint64)) % np.uint64(_SALTS) + np.uint64(1)).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.where(known, hi | salt, hi)), pa.array(lo), pa.array(doc)], names=["hi", "lo", "doc"])


def dedup_substrings(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), with_text: bool = False, least_run: int = LEAST_RUN) -> DataFrame:
    """One row for each row of docs: key, the columns in ``keep``, n_bytes, n_chunks, n_dup_chunks, n_removed, n_spans, kept_sha256.

    With with_text also ``kept_text``, the remaining bytes.  The document of
    smallest key keeps a passage, all others lose it; repeats within one
    document stay.  Keys are integers; a row without one is left as it is,
    and repeated rows of a key are one document.  Null and empty texts have no
    chunks (kept_text is null for null).
    """
    rows = _chunk_rows(docs, key, text).repartition("hi", "lo").withColumn("first", F.min("doc").over(Window.partitionBy("hi", "lo")))
    later = rows.where(f"doc > first or hi & {_SALTS} <> 0").select("doc", F.expr(f"hi & {~_SALTS}").alias("hi"), "lo")
    lists = later.groupBy("doc").agg(F.collect_list(F.struct("hi", "lo")).alias("dup")).select(F.col("doc").alias("_doc"), F.col("dup.hi").alias("hi"), F.col("dup.lo").alias("lo"))
    own = docs.select(docs[key].alias("_key"), *[docs[c].alias(f"_keep{i}") for i, c in enumerate(keep)], docs[text].alias("_text"))
    joined = own.join(lists, F.col("_key") == F.col("_doc"), "left").drop("_doc")
    names = [key, *keep]

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = len(names)
            for begin, end, data, offs in tb.blocks(batch.column(k)):
                starts, ends, doc, digest = chunks(data, offs)
                dup = np.zeros(len(starts), dtype=bool)
                until = np.searchsorted(doc, np.arange(end - begin + 1))
                his, los = batch.column(k + 1).slice(begin, end - begin), batch.column(k + 2).slice(begin, end - begin)
                for r in np.flatnonzero(np.asarray(his.is_valid())).tolist():
                    a, b = until[r], until[r + 1]
                    theirs = np.stack([his[r].values.to_numpy(), los[r].values.to_numpy()], axis=1)
                    mine = np.ascontiguousarray(digest[a:b]).view("i8,i8").ravel()
                    dup[a:b] = np.isin(mine, np.ascontiguousarray(theirs).view("i8,i8").ravel())
                gone, spans = _runs(starts, ends, doc, dup, least_run)
                lost = np.zeros(len(data) + 1, dtype=np.int32)
                np.add.at(lost, starts[gone], 1)
                np.add.at(lost, ends[gone], -1)
                stay = np.cumsum(lost[:-1]) == 0
                rest = np.concatenate(([0], np.cumsum(stay)))[offs]
                kept = np.ascontiguousarray(data[stay])
                view = memoryview(kept)
                n = end - begin
                count = lambda flags: np.bincount(doc[flags], minlength=n)
                out = [
                    *(batch.column(i).slice(begin, n) for i in range(k)), pa.array(np.diff(offs)), pa.array(count(slice(None))), pa.array(count(dup)),
                    pa.array(np.diff(offs) - np.diff(rest)), pa.array(np.bincount(spans, minlength=n)),
                    pa.array([hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(rest[:-1].tolist(), rest[1:].tolist(), strict=True)]),
                ]
                if with_text:
                    null = batch.column(k).slice(begin, n).is_null()
                    text_out = tb.to_strings(kept, rest).cast(pa.string())
                    out.append(pa.array([None if x else t for x, t in zip(null.to_pylist(), text_out.to_pylist(), strict=True)], pa.string()) if batch.column(k).null_count else text_out)
                yield pa.RecordBatch.from_arrays(out, names=[*names, *columns])

    columns = ["n_bytes", "n_chunks", "n_dup_chunks", "n_removed", "n_spans", "kept_sha256", *(["kept_text"] if with_text else [])]
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    return arrow_map(joined, over, f"{kinds}, n_bytes bigint, n_chunks bigint, n_dup_chunks bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + (", kept_text string" if with_text else ""))


def _runs(starts: np.ndarray, ends: np.ndarray, doc: np.ndarray, dup: np.ndarray, least_run: int) -> tuple[np.ndarray, np.ndarray]:
    """Which chunks lie in removed runs, and the text of each run."""
    if not dup.any():
        return np.zeros(len(dup), dtype=bool), np.zeros(0, dtype=np.int64)
    opens = dup.copy()
    opens[1:] &= ~(dup[:-1] & (doc[1:] == doc[:-1]))
    run = np.cumsum(opens) - 1
    size = np.bincount(run[dup], weights=(ends - starts)[dup])
    gone = dup & (size[np.maximum(run, 0)] >= least_run)
    return gone, doc[np.flatnonzero(opens)][size >= least_run]
