"""Byte-level BPE: vectorised pre-tokenisation, cached pair merging, decoding by offsets.

Pre-tokenisation uses no regular expression.  A block of texts becomes an
array of code points and that an array of classes; every class is a function
from states to states of a small automaton, and functions compose
associatively, so all states come from a scan over function numbers in a
composition table.  A token starts where the state says so.  The slices
between starts are hashed at once, each different slice is merged once,
with the ranks of pairs in a hash table, and token ids are laid out by offsets, which
decoding uses to put the bytes back.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import textblocks as tb
from .runtime import arrow_map

#: Slices longer than this are merged one by one with a heap.
LONG_SLICE = 64
_STRIDE = 128

# ---------------------------------------------------------------- classes
# Fixed values of the pattern: letters, numbers, white space, the rest; the
# apostrophes that open 's 't 'm 'd and 're 've 'll; a space before a
# non-space; the first code point of a text.
LETTER, NUMBER, OTHER, GAP, LEAD, SHORT, LONG = range(7)
N_CLASSES = 7
WHITE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


@lru_cache(1)
def class_table() -> np.ndarray:
    """The class of every code point, from the properties of the installed Unicode tables."""
    table = np.full(0x110000, OTHER, dtype=np.uint8)
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    for kind, name in ((LETTER, "L"), (NUMBER, "N")):
        for run in regex.finditer(rf"\p{{{name}}}+", every):
            points = np.frombuffer(run[0].encode("utf-32-le"), dtype=np.uint32)
            table[points] = kind
    table[list(WHITE)] = GAP
    return table


# ---------------------------------------------------------------- automaton
# States after a code point: inside a letter, number or other run; behind
# white space that stays with itself; behind a space that leads a token; one
# or two code points before the end of a contraction; behind a contraction.
S_LETTER, S_NUMBER, S_OTHER, S_GAP, S_LEAD, S_ONE, S_TWO, S_DONE = range(8)
N_STATES = 8


def _step(state: int, kind: int) -> int:
    if state == S_TWO:
        return S_ONE
    if state == S_ONE:
        return S_DONE
    if kind in (LETTER, NUMBER):
        return (S_LETTER, S_NUMBER)[kind]
    if kind == GAP:
        return S_GAP
    if kind == LEAD:
        return S_LEAD
    if kind == OTHER or state in (S_OTHER, S_LEAD):
        return S_OTHER
    return S_ONE if kind == SHORT else S_TWO


def _starts(state: int, kind: int) -> bool:
    """A token starts at a code point of this class that comes in this state."""
    if state in (S_ONE, S_TWO):
        return False
    if kind in (LETTER, NUMBER):
        return state not in ((S_LETTER, S_NUMBER)[kind], S_LEAD)
    if kind == GAP:
        return state != S_GAP
    if kind == LEAD:
        return True
    return state not in (S_OTHER, S_LEAD)


@lru_cache(1)
def monoid():
    """Numbers of the class functions, the composition table (first, then second), their value at S_DONE."""
    base = [tuple(_step(s, k) for s in range(N_STATES)) for k in range(N_CLASSES)]
    reset = [tuple(base[k][S_DONE] for _ in range(N_STATES)) for k in range(N_CLASSES)]
    found = list(dict.fromkeys([tuple(range(N_STATES)), *base, *reset]))
    number = {f: i for i, f in enumerate(found)}
    i = 0
    while i < len(found):
        for g in [*base, *reset]:
            h = tuple(g[x] for x in found[i])
            if h not in number:
                number[h] = len(found)
                found.append(h)
        i += 1
    n = len(found)
    table = np.zeros((n, n), dtype=np.uint8 if n < 256 else np.uint16)
    for a, f in enumerate(found):
        for b, g in enumerate(found):
            table[a, b] = number[tuple(g[x] for x in f)]
    at_start = np.array([f[S_DONE] for f in found], dtype=np.uint8)
    # class + N_CLASSES for the first code point of a text: whatever came before, the state is S_DONE
    functions = np.array([number[f] for f in [*base, *reset]], dtype=table.dtype)
    opens = np.array([[_starts(s, k) for k in range(N_CLASSES)] for s in range(N_STATES)])
    return functions, table, at_start, opens


def scan_states(functions: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Inclusive associative scan: the composition of all functions up to each position."""
    n = len(functions)
    if n <= 2 * _STRIDE:
        out = functions.copy()
        step = 1
        while step < n:
            out[step:] = table[out[:-step], out[step:]]
            step *= 2
        return out
    rows = -(-n // _STRIDE)
    grid = np.zeros(rows * _STRIDE, dtype=table.dtype)  # 0 is the identity
    grid[:n] = functions
    grid = np.ascontiguousarray(grid.reshape(rows, _STRIDE).T)
    flat, width = table.ravel(), np.intp(table.shape[1])
    for k in range(1, _STRIDE):
        grid[k] = flat[grid[k - 1] * width + grid[k]]
    before = np.zeros(rows, dtype=table.dtype)
    before[1:] = scan_states(grid[-1], table)[:-1]
    grid = flat[before[None, :] * width + grid]
    return np.ascontiguousarray(grid.T).ravel()[:n]


def code_points(data: np.ndarray, offs: np.ndarray):
    """Code points, their byte positions and the numbers of each text's first one."""
    lead = (data & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    return points, at, np.searchsorted(at, offs)


def token_starts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Byte positions at which a match of the pattern starts, over all texts of a block."""
    if not len(data):
        return np.zeros(0, np.int64)
    points, at, first = code_points(data, offs)
    n = len(points)
    kinds = class_table()[points]
    last = np.zeros(n + 3, dtype=bool)  # the last code point of a text
    last[first[1:][first[1:] > 0] - 1] = True
    ahead = np.zeros(n + 2, dtype=np.uint32)
    ahead[:n] = points
    # look ahead by shifted comparison: contractions, and a space before a non-space of the same text
    quote = np.flatnonzero((points == 39) & ~last[:n])
    one, two = ahead[quote + 1], ahead[quote + 2]
    kinds[quote[np.isin(one, [ord(c) for c in "stmd"])]] = SHORT
    pair = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    kinds[quote[pair & ~last[quote + 1]]] = LONG
    gap = np.flatnonzero((kinds == GAP) & ~last[:n])
    gap = gap[kinds[gap + 1] != GAP]
    kinds[gap[points[gap] == 32]] = LEAD
    # the last of several white code points is a token of its own, space or not
    alone = gap[points[gap] != 32]
    functions, table, at_start, opens = monoid()
    numbers = functions[kinds]
    heads = np.unique(first[:-1][first[:-1] < n])
    numbers[heads] = functions[kinds[heads] + N_CLASSES]
    states = at_start[scan_states(numbers, table)]
    before = np.empty(n, dtype=np.uint8)
    before[0] = S_DONE
    before[1:] = states[:-1]
    before[heads] = S_DONE
    start = opens[before, kinds]
    start[heads] = True
    start[alone] = True
    return at[start]


# ---------------------------------------------------------------- vocabulary
_NONE = np.int32(np.iinfo(np.int32).max)


class PairTable:
    """Rank of the token that two tokens make, by open addressing over the key left * 2**32 + right.

    ``found`` has the ranks by key; by default all pairs of tokens that make one count.
    """

    def __init__(self, rank: dict[bytes, int], found: dict[int, int] | None = None):
        if found is None:
            found = {}
            for token, k in rank.items():
                for cut in range(1, len(token)):
                    a, b = rank.get(token[:cut]), rank.get(token[cut:])
                    if a is not None and b is not None:
                        found[a << 32 | b] = k
        bits = max(10, (8 * len(found)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, -1, dtype=np.int64)
        self.ranks = np.full(1 << bits, _NONE, dtype=np.int32)
        keys, ranks = np.fromiter(found, np.int64, len(found)), np.fromiter(found.values(), np.int32, len(found))
        at = self._home(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[at] < 0)
            _, one = np.unique(at[free], return_index=True)
            put = free[one]
            self.keys[at[put]], self.ranks[at[put]] = keys[put], ranks[put]
            left = np.ones(len(keys), dtype=bool)
            left[put] = False
            keys, ranks, at = keys[left], ranks[left], (at[left] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks; the largest int32 where the pair makes no token or a side is negative."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = self._home(keys)
        seen = self.keys[at]
        out = np.where(seen == keys, self.ranks[at], _NONE)
        open_ = np.flatnonzero((seen != keys) & (seen >= 0))
        at = at[open_]
        while len(open_):
            at = (at + 1) & self.mask
            seen = self.keys[at]
            hit = seen == keys[open_]
            out[open_[hit]] = self.ranks[at[hit]]
            go = ~hit & (seen >= 0)
            open_, at = open_[go], at[go]
        out[(left < 0) | (right < 0)] = _NONE
        return out


class Vocabulary:
    """Ranks of a tiktoken file; merging, and the bytes of every id with offsets."""

    def __init__(self, lines: bytes):
        rank = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines.splitlines() if x)}
        self.fill(rank, PairTable(rank))
        # tokens that merging does not reach are still taken whole
        self.unreached: dict[bytes, int] = {}
        flat, until = self.merge(self.bytes, self.places[:-1], self.places[1:])
        for k in np.flatnonzero(np.diff(until) > 1).tolist():
            self.unreached[self.bytes[self.places[k] : self.places[k + 1]].tobytes()] = k

    def fill(self, rank: dict[bytes, int], pairs: PairTable) -> None:
        self.rank, self.pairs = rank, pairs
        size = max(self.rank.values()) + 1
        self.lengths = np.zeros(size, dtype=np.int64)
        for token, k in self.rank.items():
            self.lengths[k] = len(token)
        self.places = np.concatenate(([0], np.cumsum(self.lengths)))
        self.bytes = np.zeros(self.places[-1], dtype=np.uint8)
        for token, k in self.rank.items():
            self.bytes[self.places[k] : self.places[k + 1]] = np.frombuffer(token, dtype=np.uint8)
        self.byte_ids = np.array([self.rank[bytes([b])] for b in range(256)], dtype=np.int32)

    def merge(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of the slices, concatenated, and the offsets of each slice's ids.

        All slices of a length class are merged in step: in every slice the
        pair of least rank, the leftmost of equals, becomes one token.
        """
        lengths = ends - starts
        sizes = np.ones(len(starts), dtype=np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        low = 0
        for high in (1, 4, 8, 12, 20, 36, LONG_SLICE):
            rows = np.flatnonzero((lengths > low) & (lengths <= high))
            low = high
            for some in np.array_split(rows, -(-len(rows) * high // 1_000_000)) if len(rows) else ():
                ids, n = self._merge_class(data, starts[some], lengths[some], high)
                sizes[some] = n
                parts.append((some, ids))
        for r in np.flatnonzero(lengths > LONG_SLICE).tolist():
            ids = np.array(self._merge_long(data[starts[r] : ends[r]].tobytes()), dtype=np.int32)
            sizes[r] = len(ids)
            parts.append((np.array([r]), ids[None, :]))
        until = np.concatenate(([0], np.cumsum(sizes)))
        flat = np.zeros(until[-1], dtype=np.uint32)
        for rows, ids in parts:
            keep = np.arange(ids.shape[1])[None, :] < sizes[rows][:, None]
            flat[(until[rows][:, None] + np.arange(ids.shape[1])[None, :])[keep]] = ids[keep]
        return flat, until

    def _merge_class(self, data, starts, lengths, width):
        columns = np.arange(width)
        inside = columns[None, :] < lengths[:, None]
        ids = np.where(inside, self.byte_ids[data[np.where(inside, starts[:, None] + columns[None, :], 0)]], np.int32(-1))
        n = lengths.copy()
        if width == 1:
            return ids, n
        ranks = np.full(ids.shape, _NONE, dtype=np.int32)
        ranks[:, :-1] = self.pairs.get(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), width - 1)
        live = np.arange(len(ids))
        work, rank = ids, ranks
        while len(live):
            at = rank.argmin(axis=1)
            line = np.arange(len(live))
            best = rank[line, at]
            go = best != _NONE
            if not go.all():
                ids[live[~go]] = work[~go]
                live, work, rank, at, best = live[go], work[go], rank[go], at[go], best[go]
                line = line[: len(live)]
                if not len(live):
                    break
            shift = columns[None, :-1] > at[:, None]
            work[:, :-1] = np.where(shift, work[:, 1:], work[:, :-1])
            rank[:, :-1] = np.where(shift, rank[:, 1:], rank[:, :-1])
            work[:, -1], rank[:, -1] = -1, _NONE
            work[line, at] = best
            n[live] -= 1
            right = work[line, np.minimum(at + 1, width - 1)]
            right[at + 1 >= width] = -1
            rank[line, at] = self.pairs.get(best, right)
            left = np.flatnonzero(at > 0)
            rank[left, at[left] - 1] = self.pairs.get(work[left, at[left] - 1], best[left])
        return ids, n

    def _merge_long(self, piece: bytes) -> list[int]:
        """One long slice in O(n log n): a heap of pairs over linked parts."""
        rank, n = self.rank, len(piece)
        after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        alive, heap = bytearray(b"\1") * n, []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (r := rank.get(piece[i : end[j]])) is not None:
                heapq.heappush(heap, (r, i, end[i], end[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, e, f = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or end[i] != e or j >= n or end[j] != f:
                continue
            alive[j], end[i], after[i] = 0, f, after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        out, i = [], 0
        while i < n:
            out.append(rank[piece[i : end[i]]])
            i = after[i]
        return out

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of a block of texts and the offsets of each text's ids."""
        starts = token_starts(data, offs)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
        ends = np.append(starts[1:], len(data))
        hashes = tb.span_hashes(tb.prefix_hash(data), starts, ends)
        _, pick, which = np.unique(hashes, return_index=True, return_inverse=True)
        # the cache of a block: each different slice is merged once; equal hashes are trusted only for equal bytes
        lengths = ends - starts
        model = starts[pick][which]
        same = lengths == lengths[pick][which]
        if same.all():
            shift = np.repeat(model - starts, lengths)
            same = np.logical_and.reduceat(data[np.arange(len(data)) + shift] == data, starts)
        odd = np.flatnonzero(~same)
        if len(odd):
            which[odd] = len(pick) + np.arange(len(odd))
            pick = np.concatenate([pick, odd])
        flat, place = self.merge(data, starts[pick], ends[pick])
        sizes = np.diff(place)
        if self.unreached:
            for k in np.flatnonzero(sizes > 1).tolist():
                whole = self.unreached.get(data[starts[pick[k]] : ends[pick[k]]].tobytes())
                if whole is not None:
                    flat[place[k]], sizes[k] = whole, 1
        counts = sizes[which]
        until = np.concatenate(([0], np.cumsum(counts)))
        tokens = flat[np.repeat(place[which] - until[:-1], counts) + np.arange(until[-1])]
        return tokens, until[np.searchsorted(starts, offs)]

    def decode(self, tokens: np.ndarray) -> np.ndarray:
        """The bytes of token ids."""
        counts = self.lengths[tokens]
        until = np.cumsum(counts)
        return self.bytes[np.repeat(self.places[tokens] - (until - counts), counts) + np.arange(until[-1] if len(until) else 0)]


_loaded: dict[bytes, Vocabulary] = {}


def read_file(path: str) -> bytes:
    """The content of a vocabulary file by a path that the driver opens."""
    with open(path, "rb") as f:
        return f.read()


def encode_documents(df: DataFrame, ranks: bytes, key: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row for each row of df: key, n_tokens, ids_sha256, decoded_sha256, and with keep_ids the token ids.

    ``ranks`` is the content of a rank file; it is broadcast (its size is the
    vocabulary's).  A null text is an empty one: no tokens and the digests of
    nothing.  Repeated keys stay repeated, other columns are not read.
    """
    vocabulary = df.sparkSession.sparkContext.broadcast(ranks)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = vocabulary.value
        name = hashlib.sha256(lines).digest()
        voc = _loaded.get(name)
        if voc is None:
            _loaded.clear()
            voc = _loaded[name] = Vocabulary(lines)
        for batch in batches:
            for first, end, data, offs in tb.blocks(batch.column(1)):
                tokens, until = voc.encode(data, offs)
                decoded = voc.decode(tokens)
                places = np.concatenate(([0], np.cumsum(voc.lengths[tokens])))[until]
                ids_bytes, text_bytes = memoryview(tokens.astype("<u4", copy=False)).cast("B"), memoryview(np.ascontiguousarray(decoded))
                columns = [
                    batch.column(0).slice(first, end - first),
                    pa.array(np.diff(until)),
                    pa.array([hashlib.sha256(ids_bytes[4 * a : 4 * b]).hexdigest() for a, b in zip(until[:-1].tolist(), until[1:].tolist(), strict=True)]),
                    pa.array([hashlib.sha256(text_bytes[a:b]).hexdigest() for a, b in zip(places[:-1].tolist(), places[1:].tolist(), strict=True)]),
                ]
                names = [key, "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(until, pa.int32()), pa.array(tokens.astype(np.int32))))
                    names.append("token_ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", token_ids array<int>" if keep_ids else "")
    return arrow_map(df.select(df[key], df[text]), over, schema)
