"""Text columns as byte arrays: the vectorised ground the Arrow operators stand on.

An Arrow batch is cut into blocks of bounded bytes.  A block holds whole
texts only: ``data`` are the concatenated UTF-8 bytes, ``offs`` the limits of
each text.  A null text is an empty one.  Every kernel below works on a block
at once, so the temporaries are bounded by the block, or by one text where a
single text is longer than the bound.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes of text in a block; the kernels hold some hundred bytes for each.
BLOCK_BYTES = 1 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C17 | 2  # odd and 3 mod 4, so that base - 1 is twice an odd number
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser (xor-shift and multiply) on uint64."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


#: A random 64-bit value for each byte.
BYTE_VALUES = mix64(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
#: The same with A-Z valued as a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER_VALUES = BYTE_VALUES[LOWER]
#: The white space of the word contracts: \x20 and \x09-\x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True

_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, BLOCK_BYTES + 2)
        with np.errstate(over="ignore"):
            for k, base in enumerate((_BASE, _INVERSE)):
                steps = np.full(size, base % (1 << 64), dtype=np.uint64)
                steps[0] = 1
                _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def arrow_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a string or binary array; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type) and not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_large_string(column.type) else b"")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, values = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64, count=n + 1, offset=8 * column.offset)
    data = np.frombuffer(values, dtype=np.uint8) if values is not None and values.size else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def blocks(column: pa.Array, block_bytes: int = BLOCK_BYTES):
    """Yields (first row, end row, data, offs) over whole texts."""
    data, offs = arrow_bytes(column)
    n, row = len(offs) - 1, 0
    while row < n:
        end = int(np.searchsorted(offs, offs[row] + block_bytes, "right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end, data[offs[row] : offs[end]], offs[row : end + 1] - offs[row]
        row = end


def _edges(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of ``inside``, none of which spans two texts."""
    n = len(inside)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(n + 1, dtype=bool)
    cut[offs] = True
    before = np.empty(n, dtype=bool)
    before[0] = True
    np.logical_not(inside[:-1], out=before[1:])
    before |= cut[:n]
    after = np.empty(n, dtype=bool)
    after[-1] = True
    np.logical_not(inside[1:], out=after[:-1])
    after |= cut[1:]
    return np.flatnonzero(inside & before), np.flatnonzero(inside & after) + 1


def words(data: np.ndarray, offs: np.ndarray, separators: np.ndarray = SPACE):
    """Starts, ends and text numbers of the maximal runs of bytes that separate nothing.

    Separators are ASCII, so cutting bytes is cutting code points.
    """
    starts, ends = _edges(~separators[data], offs)
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def prefix_hash(data: np.ndarray, values: np.ndarray = BYTE_VALUES) -> np.ndarray:
    """P with P[e] - P[s] = base**s times the polynomial hash of data[s:e]."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(values[data] * up[: len(data)], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end], the same wherever it lies."""
    _, down = powers(len(prefix))
    return mix64((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = BYTE_VALUES) -> np.ndarray:
    """span_hashes of spans that don't overlap, in their order, some BLOCK_BYTES at a time however long the data or a span is."""
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        begin = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, begin + BLOCK_BYTES, "right")))
        if ends[j - 1] - begin <= BLOCK_BYTES:
            out[i:j] = span_hashes(prefix_hash(data[begin : ends[j - 1]], values), starts[i:j] - begin, ends[i:j] - begin)
        else:
            size, total = int(ends[i]) - begin, 0
            for at in range(0, size, BLOCK_BYTES):
                part = prefix_hash(data[begin + at : begin + min(at + BLOCK_BYTES, size)], values)
                total += int(part[-1]) * pow(_BASE, at, 1 << 64)
            mixed = (total + size * 0xD6E8FEB86659FD93) % (1 << 64)
            out[i : i + 1] = mix64(np.array([mixed], dtype=np.uint64))
        i = j
    return out


def shingle_hashes(word_hashes: np.ndarray, doc: np.ndarray, n_docs: int, width: int):
    """Hash and text number of each run of ``width`` words of a text.

    A text with fewer words, but not none, has its whole sequence as one.
    """
    n = len(word_hashes)
    counts = np.bincount(doc, minlength=n_docs)
    first = np.concatenate(([0], np.cumsum(counts)))[:-1]
    acc = np.zeros(n, dtype=np.uint64)
    short = (counts > 0) & (counts < width)
    for j in range(width):
        c = _U((0xA0761D6478BD642F * (2 * j + 1)) & 0xFFFFFFFFFFFFFFFF | 1)
        part = mix64(word_hashes * c)
        if j == 0:
            acc += part
        elif n > j:
            acc[:-j] += part[j:]
    left = counts[doc] - (np.arange(n) - first[doc])
    full = left >= width
    hashes, owners = mix64(acc[full]), doc[full]
    if short.any():
        rows = np.flatnonzero(short)
        salted = []
        for r in rows:
            h = counts[r : r + 1].astype(np.uint64)
            for w in word_hashes[first[r] : first[r] + counts[r], None]:
                h = mix64(h * _U(0xE7037ED1A0B428DB) + w)
            salted.append(h[0])
        hashes = np.concatenate([hashes, np.array(salted, dtype=np.uint64)])
        owners = np.concatenate([owners, rows])
        order = np.argsort(owners, kind="stable")
        hashes, owners = hashes[order], owners[order]
    return hashes, owners


def to_strings(data: np.ndarray, offs: np.ndarray) -> pa.Array:
    """Concatenated UTF-8 bytes as a string array."""
    return pa.LargeStringArray.from_buffers(len(offs) - 1, pa.py_buffer(np.ascontiguousarray(offs, np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
