"""Product codes of vectors: float32 screening with rounding-error intervals, exact integers after it.

Components become integers, vectors four parts, and each part position has a
codebook of at most 256 entries.  The nearest entry of a part is the one of
least |c|^2 - 2 x.c.  A float32 matrix product gives that for all entries at
once, with an error that the norms bound; every entry whose interval reaches
down to the least upper end is computed again in int64, and ties go to the
lower index.  So codes are exact, and a float64 or integer product of all
pairs is never made.

A round is one pass: tasks send sums and counts of the entries they used, and
Spark adds them.  Codebooks have a fixed size (256 entries, the length of a
vector), so they pass through the driver and are broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import arrow_map, cut

#: A component x counts as floor(SCALE * x).
SCALE = 1024
PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: Parts screened at once, and components computed again at once.
_ROWS, _EXACT = 2048, 1 << 22
#: A label of more than one in HOT_SHARE of the vectors is joined by broadcast; there are fewer than HOT_SHARE.
HOT_SHARE = 1000


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x the index of the nearest row of entries (int64 both), the lower of ties, and the squared distance."""
    if not x.size:
        return np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    once, lowest = np.unique(entries, axis=0, return_index=True)
    order = np.argsort(lowest)
    once, lowest = once[order], lowest[order]
    index, distance = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    for a in range(0, len(x), _ROWS):
        k, d = _nearest(x[a : a + _ROWS], once)
        index[a : a + _ROWS], distance[a : a + _ROWS] = lowest[k], d
    return index, distance


def intervals(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[row, entry]: lower and upper ends that hold |c|^2 - 2 x.c of the exact integers.

    A float32 product of n terms, whose factors were rounded too, is off by at
    most g = (n + 2) u / (1 - (n + 2) u) times |x| |c|, u = 2**-24, in any
    order of summation.  The rest is done in float64; n 2**-51 of the terms
    covers its rounding.
    """
    n = x.shape[1] + 2
    u, t = 2.0**-24, n * 2.0**-51
    g = n * u / (1 - n * u)
    far = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
    squares = (entries.astype(np.float64) ** 2).sum(axis=1)
    product = (x.astype(np.float32) @ entries.astype(np.float32).T).astype(np.float64)
    middle = squares[None, :] - 2 * product
    off = far[:, None] * (np.sqrt(squares) * (1 + 4 * t) * (2 * g + t))[None, :] + (squares * t)[None, :]
    return middle - off, middle + off


def _nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low, high = intervals(x, entries)
    row, entry = np.nonzero(low <= high.min(axis=1)[:, None])
    exact = np.empty(len(row), np.int64)
    step = max(1, _EXACT // max(1, x.shape[1]))
    for a in range(0, len(row), step):
        off = x[row[a : a + step]] - entries[entry[a : a + step]]
        exact[a : a + step] = np.einsum("ij,ij->i", off, off)
    first = np.searchsorted(row, np.arange(len(x)))
    least = np.minimum.reduceat(exact, first)
    place = np.where(exact == least[row], np.arange(len(row)), len(row))
    return entry[np.minimum.reduceat(place, first)], least


def integers(column: pa.Array, width: int) -> np.ndarray:
    """[row, component] from lists of floats without nulls.

    Raises ValueError for other lengths than ``width``, and for components so
    large that a squared distance between two vectors could reach 2**63.
    """
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    if (sizes != width).any():
        raise ValueError(f"vectors of {int(sizes[sizes != width][0])} components among those of {width}")
    x = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    most = 2.0**30 / max(1, width) ** 0.5
    if len(x) and np.abs(x).max() > most:
        raise ValueError(f"components of vectors of {width} must be at most {most / SCALE:.0f} in size")
    return x.astype(np.int64).reshape(len(column), width)


def usable(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(key, vector, label) of the rows whose vector and all of its components are there and finite."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    rows = df.select(df[key].alias("key"), df[vector].cast("array<double>").alias("vector"), df[label].alias("label"))
    return rows.where(F.col("vector").isNotNull() & F.forall("vector", fine))


def first_codebooks(rows: DataFrame, entries: int = ENTRIES) -> np.ndarray:
    """[part, entry, position]: the parts of the vectors of the smallest keys; of rows that share a key the least vector."""

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, np.int64)
        for batch in batches:
            held = np.unique(np.concatenate([held, batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)]))[:entries]
        yield pa.RecordBatch.from_arrays([pa.array(held)], names=["key"])

    keyed = rows.where("key is not null")
    keys = [r[0] for r in arrow_map(keyed.select(F.col("key").cast("bigint")), smallest, "key bigint").distinct().orderBy("key").limit(entries).collect()]
    if not keys:
        return np.zeros((PARTS, 0, 0), np.int64)
    # the range reaches the scan, the grouping leaves one row a key
    chosen = keyed.where(F.col("key").between(keys[0], keys[-1])).groupBy("key").agg(F.min("vector").alias("vector")).orderBy("key").limit(len(keys)).collect()
    width = len(chosen[0].vector)
    if width % PARTS:
        raise ValueError(f"vectors of {width} components can't be cut into {PARTS} equal parts")
    found = integers(pa.array([r.vector for r in chosen], pa.list_(pa.float64())), width)
    return np.ascontiguousarray(found.reshape(len(keys), PARTS, width // PARTS).transpose(1, 0, 2))


def next_codebooks(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: parts go to their nearest entries, entries to the floors of the means; unused entries stay."""
    _, n, size = books.shape
    given = rows.sparkSession.sparkContext.broadcast(books)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = given.value
        total = np.zeros((PARTS, n, size + 1), np.int64)  # a count behind the sums
        for batch in batches:
            x = integers(batch.column(0), PARTS * size).reshape(batch.num_rows, PARTS, size)
            for p in range(PARTS if len(x) else 0):
                index, _ = nearest(x[:, p], books[p])
                order = np.argsort(index, kind="stable")
                used, first, count = np.unique(index[order], return_index=True, return_counts=True)
                if size:
                    total[p, used, :size] += np.add.reduceat(x[order, p], first, axis=0)
                total[p, used, size] += count
        used = np.repeat(total[:, :, size].ravel() > 0, size + 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(used)), pa.array(total.ravel()[used])], names=["cell", "n"])

    found = arrow_map(rows.select("vector"), sums, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # at most PARTS * n * (size + 1) rows
    total = np.zeros(PARTS * n * (size + 1), np.int64)
    total[[r.cell for r in found]] = [r.n for r in found]
    total = total.reshape(PARTS, n, size + 1)
    count = total[:, :, size:]
    return np.where(count > 0, total[:, :, :size] // np.maximum(count, 1), books)


def codebooks(rows: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    books = first_codebooks(rows, entries)
    for _ in range(rounds if books.size else 0):
        books = next_codebooks(rows, books)
    return books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components as decimal numbers by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """(key, code, error, label) of usable rows."""
    size = books.shape[2]
    given = rows.sparkSession.sparkContext.broadcast(books)
    digits = np.array([f"{i:02x}" for i in range(256)])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = given.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = integers(batch.column(1), PARTS * size).reshape(batch.num_rows, PARTS, size)
            code, error = np.full(len(x), "", dtype="U8"), np.zeros(len(x), np.int64)
            for p in range(PARTS):
                index, distance = nearest(x[:, p], books[p])
                code = np.char.add(code, digits[index])
                error += distance
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(code.tolist(), pa.string()), pa.array(error), batch.column(2)], names=["key", "code", "error", "label"])

    kinds = dict(rows.dtypes)
    return arrow_map(rows.select("key", "vector", "label"), over, f"key {kinds['key']}, code string, error bigint, label {kinds['label']}")


def with_label_sums(coded: DataFrame) -> DataFrame:
    """coded with ``label_error``, the error summed over equal labels, nulls together.

    Sums are combined in the map tasks.  Labels that hold many rows are few,
    so theirs come back by broadcast; no other label has more than one row in
    HOT_SHARE, so theirs come back by a shuffle of even parts.
    """
    sums = cut(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")).withColumnRenamed("label", "of"))
    least = (sums.agg(F.sum("n")).first()[0] or 0) // HOT_SHARE
    hot, rest = F.broadcast(sums.where(F.col("n") > least).drop("n")), sums.where(F.col("n") <= least).drop("n")
    same = F.col("label").eqNullSafe(F.col("of"))
    return coded.join(hot, same).drop("of").union(coded.join(hot, same, "left_anti").join(rest, same).drop("of"))


def compress(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """One row for each usable row of df: key, code, error, label_error, codebooks_sha256.

    Rows whose vector is null or holds a null, NaN or infinity are dropped.
    Keys are integers; rows without a key are coded but start no entry, and of
    rows that share a key the least vector can start one.  With fewer than
    ``entries`` keys the codebooks are smaller; without any, code, error and
    label_error are null.  Repeated rows stay repeated; an empty table gives
    none; vectors of no components have the code 00000000.  Vectors of
    different lengths, of lengths that four doesn't divide and components that
    are too large (see integers()) raise ValueError.  Other columns are not
    read.
    """
    if not 0 < entries <= ENTRIES:
        raise ValueError(f"a codebook has 1 to {ENTRIES} entries, as a code has two hex digits")
    rows = usable(df, key, vector, label)
    books = codebooks(rows, entries, rounds)
    out = lambda d: d.select(F.col("key").alias(key), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
    if not books.shape[1]:
        return out(rows.select("key", F.lit(None).cast("string").alias("code"), F.lit(None).cast("bigint").alias("error"), F.lit(None).cast("bigint").alias("label_error")))
    return out(with_label_sums(cut(encode(rows, books))))
