"""Alignment of two tokenizers: groups between common token ends, and how often ids meet in them.

Both tokenizers cut the same bytes, so the places where a token of each ends
cut a text into groups.  An id of the one and an id of the other are linked
where a group holds both.  Texts are tokenized once: the different linked
pairs of each text, with their multiplicities, go to a table in the shared
folder.  From it each task counts its packed pairs (one int64 each) with
np.unique, the counts are sorted over ranges of the keys, runs are summed, and
each range becomes a shard: a file of sorted keys and their counts.  A second
pass maps the shards into memory and looks its pairs up by binary search, so a
worker holds no more of them than it touches, and the system's page cache
holds them once for all workers of a machine.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shared import shared_folder
from . import byte_bpe
from . import textblocks as tb
from .runtime import arrow_map, cut

#: Pairs written out at once; a text of more goes to several rows.
MOST_PAIRS = 1 << 22
#: Bytes of text aligned at once, and of a row group of the table of links, for bounded memory.
BLOCK_BYTES, _GROUP_BYTES = 1 << 18, 32 << 20
#: Links of a group from which repeated ids are combined before pairs are made.
_MANY = 64
#: Different keys that a task holds while it counts, and keys of a shard.
_HELD_KEYS, SHARD_KEYS = 1 << 21, 1 << 22


# ---------------------------------------------------------------- the two tokenizers
def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: itself if printable, else the letters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class MergeVocabulary(byte_bpe.Vocabulary):
    """A byte-level BPE file: its own list of merges says which pairs make a token."""

    def __init__(self, content: bytes):
        model, letters = json.loads(content)["model"], byte_letters()
        ids = model["vocab"]
        rank = {bytes(letters[c] for c in name): k for name, k in ids.items()}
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        made = [ids[a + b] for a, b in merges]
        if made != sorted(made) or len(rank) != len(ids):
            raise ValueError("merges must make tokens in the order of their ids")
        self.found = {ids[a] << 32 | ids[b]: k for (a, b), k in zip(merges, made, strict=True)}
        self.fill(rank, byte_bpe.PairTable(rank, self.found))
        self.unreached = {}

    def _merge_long(self, piece: bytes) -> list[int]:
        """One long slice with a heap of pairs of ids over linked places."""
        n, found = len(piece), self.found
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        after, before, heap = list(range(1, n + 1)), list(range(-1, n - 1)), []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (k := found.get(ids[i] << 32 | ids[j])) is not None:
                heapq.heappush(heap, (k, i, ids[i], ids[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            k, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue
            ids[i], ids[j], after[i] = k, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [k for k in ids if k >= 0]


class PieceVocabulary:
    """A sentencepiece model, and the bytes of every piece with offsets."""

    def __init__(self, content: bytes):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_proto=content)
        pieces = []
        for k in range(self.processor.get_piece_size()):
            name = self.processor.id_to_piece(k)
            pieces.append(bytes([int(name[3:5], 16)]) if self.processor.is_byte(k) else name.replace("▁", " ").encode())
        self.lengths = np.array([len(p) for p in pieces], dtype=np.int64)
        self.places = np.concatenate(([0], np.cumsum(self.lengths)))
        self.bytes = np.frombuffer(b"".join(pieces), dtype=np.uint8)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.processor.encode(texts, num_threads=1)
        until = np.concatenate(([0], np.cumsum([len(x) for x in found], dtype=np.int64)))
        return np.concatenate([np.zeros(0, np.int64), *(np.array(x, np.int64) for x in found)]), until

    decode = byte_bpe.Vocabulary.decode


class Decimals:
    """The decimal digits of small numbers, laid out at once."""

    def __init__(self, size: int):
        numbers = np.arange(size)
        self.count = np.maximum(1, np.ceil(np.log10(numbers + 1))).astype(np.int64)
        width = int(self.count.max())
        self.digits = np.zeros((size, width), np.uint8)
        for j in range(width):
            power = 10 ** np.maximum(self.count - 1 - j, 0)
            self.digits[:, j] = 48 + numbers // power % 10

    def joined(self, numbers: np.ndarray, behind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all numbers, each with the byte ``behind`` it (0 for none), and where each ends."""
        count = self.count[numbers]
        ends = np.cumsum(count + (behind > 0))
        starts = ends - count - (behind > 0)
        out = np.zeros(ends[-1] if len(ends) else 0, np.uint8)
        for j in range(self.digits.shape[1]):
            some = np.flatnonzero(count > j)
            out[starts[some] + j] = self.digits[numbers[some], j]
        some = np.flatnonzero(behind)
        out[ends[some] - 1] = behind[some]
        return out, ends


class Tokenizers:
    """Both tokenizers of a worker."""

    _loaded: dict[bytes, Tokenizers] = {}

    def __init__(self, first: bytes, second: bytes):
        self.first, self.second = MergeVocabulary(first), PieceVocabulary(second)
        self.decimals = Decimals(max(len(self.first.lengths), len(self.second.lengths)))

    @classmethod
    def of(cls, first: bytes, second: bytes) -> Tokenizers:
        name = hashlib.sha256(first).digest() + hashlib.sha256(second).digest()
        if name not in cls._loaded:
            cls._loaded.clear()
            cls._loaded[name] = cls(first, second)
        return cls._loaded[name]


# ---------------------------------------------------------------- groups and pairs of a block
@dataclass
class Aligned:
    """Tokens of the texts of a block that both tokenizers cut: ids, groups of ids, texts of groups."""

    rows: np.ndarray  # the texts, by their place in the block
    a: np.ndarray
    b: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray
    n_a: np.ndarray  # ids in each group
    n_b: np.ndarray
    text: np.ndarray  # the place of each group's text in rows


def _take(flat: np.ndarray, until: np.ndarray, which: np.ndarray) -> np.ndarray:
    return flat if which.all() else flat[np.repeat(which, np.diff(until))]


def align_block(both: Tokenizers, data: np.ndarray, offs: np.ndarray, texts: list[str | None]) -> Aligned:
    """Groups of a block of texts; texts that are empty, or whose pieces don't spell them, are left out."""
    full = np.diff(offs) > 0
    spaces = np.cumsum(full)
    spaced = np.full(len(data) + int(spaces[-1]), 32, np.uint8)
    spaced[np.arange(len(data)) + np.repeat(spaces, np.diff(offs))] = data
    starts = offs + np.concatenate(([0], spaces))
    a, until_a = both.first.encode(spaced, starts)
    a = a.astype(np.int64)
    b, short = both.second.encode([t for t in texts if t])
    until_b = np.zeros(len(offs), np.int64)
    until_b[1:] = short[spaces]
    ends = np.concatenate(([0], np.cumsum(both.second.lengths[b])))[until_b]
    good = full & (np.diff(ends) == np.diff(starts))
    b, b_sizes = _take(b, until_b, good), np.diff(until_b)[good]
    spelt, wanted = both.second.decode(b), _take(spaced, starts, good)
    sizes = np.diff(starts)[good]
    equal = np.logical_and.reduceat(spelt == wanted, np.cumsum(sizes) - sizes) if len(sizes) else np.zeros(0, bool)
    if not equal.all():
        b = b[np.repeat(equal, b_sizes)]
        good[np.flatnonzero(good)[~equal]] = False
        sizes = sizes[equal]
    a = _take(a, until_a, good)
    end_a, end_b = np.cumsum(both.first.lengths[a]), np.cumsum(both.second.lengths[b])
    common = np.zeros(int(sizes.sum()) + 1, np.int8)
    common[end_a] = 1
    common[end_b] += 1
    last_a, last_b = common[end_a] == 2, common[end_b] == 2
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    n = int(last_a.sum())
    return Aligned(
        np.flatnonzero(good), a, b, group_a, group_b, np.bincount(group_a, minlength=n), np.bincount(group_b, minlength=n), np.searchsorted(np.cumsum(sizes), end_a[last_a])
    )


def group_strings(x: Aligned, decimals: Decimals) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of ``a1,a2|b1;a3|b2`` of all texts, and the limits of each."""
    n = len(x.a) + len(x.b)
    ids, behind = np.zeros(n, np.int64), np.full(n, ord(","), np.uint8)
    at_a = np.arange(len(x.a)) + (np.cumsum(x.n_b) - x.n_b)[x.group_a]
    at_b = np.arange(len(x.b)) + np.cumsum(x.n_a)[x.group_b]
    ids[at_a], ids[at_b] = x.a, x.b
    group_ends = np.cumsum(x.n_a + x.n_b)
    behind[group_ends - x.n_b - 1] = ord("|")
    behind[group_ends - 1] = ord(";")
    text_ends = group_ends[np.flatnonzero(np.diff(x.text, append=len(x.rows)))]
    behind[text_ends - 1] = 0
    out, ends = decimals.joined(ids, behind)
    return out, np.concatenate(([0], ends[text_ends - 1]))


def _items(group: np.ndarray, ids: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, id, times) in the order of groups; ids of groups of many links are combined."""
    heavy = many[group]
    if not heavy.any():
        return group, ids, np.ones(len(ids), np.int64)
    packed, times = np.unique(group[heavy] << 32 | ids[heavy], return_counts=True)
    light = ~heavy
    g = np.concatenate([group[light], packed >> 32])
    order = np.argsort(g, kind="stable")
    return g[order], np.concatenate([ids[light], packed & 0xFFFFFFFF])[order], np.concatenate([np.ones(int(light.sum()), np.int64), times])[order]


def _counted(keys: np.ndarray, times: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Different keys, sorted, and the sum of the times of each."""
    if times is None or (times == 1).all():
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(times, first) if len(first) else times


def pair_pieces(x: Aligned, most: int = MOST_PAIRS) -> Iterator[tuple[int, int, bool, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, end text, whether texts go on in the next piece, text, pair, times): the different pairs of each text.

    A piece holds several texts of together at most ``most`` pairs before they
    are made different, or a part of one text; its pairs are sorted within a
    text, and no pair of a text is in two pieces.
    """
    many = x.n_a * x.n_b > _MANY
    ga, a, ta = _items(x.group_a, x.a, many)
    gb, b, tb_ = _items(x.group_b, x.b, many)
    in_group = np.bincount(gb, minlength=len(x.n_b))
    first_b = np.cumsum(in_group) - in_group
    weight = in_group[ga]
    text = x.text[ga]
    limits = np.searchsorted(text, np.arange(len(x.rows) + 1))
    total = np.concatenate(([0], np.cumsum(weight)))
    per_text = total[limits]

    def expand(some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        w = weight[some]
        item = np.repeat(some, w)
        at = first_b[ga[item]] + np.arange(len(item)) - np.repeat(np.cumsum(w) - w, w)
        return text[item], a[item] << 32 | b[at], ta[item] * tb_[at]

    t = 0
    while t < len(x.rows):
        end = max(t + 1, int(np.searchsorted(per_text, per_text[t] + most, "right")) - 1)
        items = np.arange(limits[t], limits[end])
        if per_text[end] - per_text[t] <= most:
            of, pair, times = expand(items)
            # text, first and second id in one key: both vocabularies have fewer than 2**17 ids
            key, times = _counted((of - t) << 34 | (pair >> 32) << 17 | pair & 0x1FFFF, times)
            yield t, end, False, (key >> 34) + t, ((key >> 17) & 0x1FFFF) << 32 | key & 0x1FFFF, times
        else:
            items = items[np.argsort(a[items], kind="stable")]
            until = np.cumsum(weight[items])
            held, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
            i = 0
            while i < len(items):
                j = max(i + 1, int(np.searchsorted(until, (until[i - 1] if i else 0) + most, "right")))
                _, pair, times = expand(items[i:j])
                held, n = _counted(np.concatenate([held, pair]), np.concatenate([n, times]))
                # pairs of the last first id can go on
                ready = len(held) if j == len(items) else int(np.searchsorted(held, a[items[j - 1]] << 32))
                if ready:
                    yield t, end, j < len(items), np.full(ready, t), held[:ready], n[:ready]
                held, n = held[ready:], n[ready:]
                i = j
        t = end


# ---------------------------------------------------------------- the passes
def link_table(docs: DataFrame, first: bytes, second: bytes, folder: str, key: str, text: str, keep_groups: bool) -> DataFrame:
    """Writes one row for each text (several for very many pairs) with its groups' figures and its pairs (a, b, times)."""
    spark = docs.sparkSession
    given = spark.sparkContext.broadcast((first, second))  # two vocabularies: their size is fixed

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = Tokenizers.of(*given.value)
        for batch in batches:
            for begin, end, data, offs in tb.blocks(batch.column(2), BLOCK_BYTES):
                n = end - begin
                x = align_block(both, data, offs, batch.column(2).slice(begin, n).to_pylist())
                string, limits = group_strings(x, both.decimals)
                view = memoryview(string)
                sha, groups = [""] * n, [""] * n
                for row, i, j in zip(x.rows.tolist(), limits[:-1].tolist(), limits[1:].tolist(), strict=True):
                    sha[row] = hashlib.sha256(view[i:j]).hexdigest()
                    if keep_groups:
                        groups[row] = bytes(view[i:j]).decode()
                opens = np.searchsorted(x.text, np.arange(len(x.rows)))
                figures = np.zeros((4, n), np.int64)
                for k, values in enumerate((x.n_a, x.n_b, np.ones_like(x.n_a), x.n_a.astype(np.int64) * x.n_b)):
                    if len(x.rows):
                        figures[k, x.rows] = np.add.reduceat(values, opens)
                fresh = np.ones(n, bool)
                lists = lambda until, values, kind: pa.ListArray.from_arrays(pa.array(until, pa.int32()), pa.array(values, kind))
                for t, u, on, of, pair, times in pair_pieces(x):
                    rows = x.rows[t:u]
                    until = np.searchsorted(of, np.arange(t, u + 1))
                    yield rows_out(batch, begin, rows, figures, sha, groups, on or not fresh[rows].all(), lists(until, pair >> 32, pa.int32()), lists(until, pair & 0xFFFFFFFF, pa.int32()), lists(until, times, pa.int64()))
                    figures[:, rows], fresh[rows] = 0, False  # the further pieces of a text add nothing to them
                rest = np.flatnonzero(fresh)
                if len(rest):
                    none = np.zeros(len(rest) + 1, np.int64)
                    yield rows_out(batch, begin, rest, figures, sha, groups, False, lists(none, [], pa.int32()), lists(none, [], pa.int32()), lists(none, [], pa.int64()))

    def rows_out(batch, begin, rows, figures, sha, groups, split, a, b, times) -> pa.RecordBatch:
        at = pa.array(rows + begin)
        columns = [batch.column(0).take(at), batch.column(1).take(at), *(pa.array(f[rows]) for f in figures), pa.array([sha[r] for r in rows.tolist()], pa.string())]
        columns += [pa.array([groups[r] for r in rows.tolist()], pa.string())] if keep_groups else []
        return pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(rows), split)), a, b, times], names=names)

    kinds = [("mark", "bigint"), ("key", docs.schema[key].dataType.simpleString()), *((c, "bigint") for c in FIGURES), ("groups_sha256", "string")]
    kinds += [("groups", "string")] if keep_groups else []
    kinds += [("split", "boolean"), ("a", "array<int>"), ("b", "array<int>"), ("times", "array<bigint>")]
    names = [c for c, _ in kinds]
    rows = docs.select(F.monotonically_increasing_id().alias("mark"), docs[key].alias("key"), docs[text].alias("text"))
    arrow_map(rows, over, ", ".join(f"{c} {k}" for c, k in kinds)).write.option("compression", "zstd").option("parquet.block.size", _GROUP_BYTES).parquet(folder)
    return spark.read.parquet(folder)


FIGURES = ("n_a", "n_b", "n_groups", "n_links")


@dataclass
class Shards:
    """Sorted files of packed pairs and their counts, in the order of their keys, and the highest count of each first id."""

    files: list[str]
    first: np.ndarray
    sizes: list[int]
    highest: np.ndarray

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """The count of each packed pair; raises KeyError for one that was never counted."""
        out = np.zeros(len(keys), np.int64)
        which = np.searchsorted(self.first, keys, "right") - 1
        order = np.argsort(which, kind="stable")
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(which[order])) + 1, [len(order)])) if len(order) else [0]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            some = order[i:j]
            shard = int(which[some[0]])
            n = self.sizes[shard]
            mapped = np.memmap(self.files[shard], dtype=np.int64, mode="r", shape=(2, n))
            at = np.searchsorted(mapped[0], keys[some])
            if shard < 0 or at.max() >= n or (mapped[0][at] != keys[some]).any():
                raise KeyError("a pair that no shard holds")
            out[some] = mapped[1][at]
        return out


def packed(batch: pa.RecordBatch, a: int, b: int) -> np.ndarray:
    first, second = (batch.column(i).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for i in (a, b))
    return first << 32 | second


def count_shards(links: DataFrame, folder: str, shard_keys: int = SHARD_KEYS) -> Shards:
    """How many texts hold each pair: np.unique by task, a sort over ranges, sums of runs, a file for each range."""
    spark = links.sparkSession

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        held, size = [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            new, times = np.unique(np.concatenate([np.zeros(0, np.int64), *held]), return_counts=True)
            return _counted(np.concatenate([keys, new]), np.concatenate([n, times])) if len(keys) else (new, times)

        for batch in batches:
            held.append(packed(batch, 0, 1))
            size += len(held[-1])
            if size >= _HELD_KEYS:
                keys, n = merged()
                held, size = [], 0
                if len(keys) >= _HELD_KEYS:
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["pair", "n"])
                    keys, n = keys[:0], n[:0]
        keys, n = merged()
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["pair", "n"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [_counted(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches if b.num_rows]
        if not held:
            return
        keys, n = _counted(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))
        context = TaskContext.get()
        name = os.path.join(folder, f"shard-{context.partitionId():06d}")
        os.makedirs(folder, exist_ok=True)
        trial = f"{name}-{context.taskAttemptId()}.part"
        with open(trial, "wb") as f:
            f.write(keys.tobytes())
            f.write(n.tobytes())
        os.replace(trial, name)  # a task that runs again writes the same
        first = np.flatnonzero(np.concatenate(([True], np.diff(keys >> 32) != 0)))
        top = np.maximum.reduceat(n, first)
        yield pa.RecordBatch.from_arrays(
            [pa.array([name] * len(first)), pa.array(np.full(len(first), keys[0])), pa.array(np.full(len(first), len(keys))), pa.array(keys[first] >> 32), pa.array(top)],
            names=["name", "least", "size", "a", "top"],
        )

    counts = cut(arrow_map(links.select("a", "b"), partial, "pair bigint, n bigint"))
    rows = counts.count()
    n = max(1, -(-rows // shard_keys), min(int(spark.conf.get("spark.sql.shuffle.partitions")), rows >> 14))
    ranges = counts.repartitionByRange(n, "pair").sortWithinPartitions("pair")
    # a row for each first id of each shard: at most the vocabulary and the shards
    told = arrow_map(ranges, write, "name string, least bigint, size bigint, a bigint, top bigint").collect()
    shards = sorted({(r.least, r.name, r["size"]) for r in told})
    highest = np.zeros(max((r.a for r in told), default=0) + 1, np.int64)
    for r in told:
        highest[r.a] = max(highest[r.a], r.top)
    return Shards([s[1] for s in shards], np.array([s[0] for s in shards], np.int64), [s[2] for s in shards], highest)


def with_counts(links: DataFrame, shards: Shards) -> DataFrame:
    """links with n_best and count_sum in place of the pairs."""
    given = links.sparkSession.sparkContext.broadcast(shards)
    kept = [c for c in links.columns if c not in ("a", "b", "times", "split")]

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, k = given.value, len(kept)
        for batch in batches:
            keys, times = packed(batch, k, k + 1), batch.column(k + 2).flatten().to_numpy(zero_copy_only=False)
            n = shards.counts(keys)
            best = np.where(n == shards.highest[keys >> 32], times, 0)
            until = np.concatenate(([0], np.cumsum(batch.column(k).value_lengths().to_numpy(zero_copy_only=False))))
            sums = [np.concatenate(([0], np.cumsum(v)))[until] for v in (best, times * n)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], *(pa.array(np.diff(s)) for s in sums)], names=[*kept, "n_best", "count_sum"])

    kinds = dict(links.dtypes)
    return arrow_map(links.select(*kept, "a", "b", "times"), over, ", ".join(f"{c} {kinds[c]}" for c in kept) + ", n_best bigint, count_sum bigint")


def working_folder(spark: SparkSession) -> str:
    """A new folder below the shared one, as a path that tasks can map into memory."""
    shared_folder(spark)
    where = urlparse(spark.sparkContext._jsc.sc().getCheckpointDir().get())
    if where.scheme not in ("", "file"):
        raise ValueError(f"shards are mapped into memory: spark.checkpoint.dir must be a mounted folder, not {where.scheme}:")
    return os.path.join(where.path, f"alignment-{uuid.uuid4().hex}")


def align(docs: DataFrame, first: bytes, second: bytes, key: str = "doc_id", text: str = "text", keep_groups: bool = False) -> DataFrame:
    """One row for each row of docs: key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``first`` is the content of a byte-level BPE file, which encodes a space
    and the text, ``second`` that of a piece model, which adds the space
    itself.  Null and empty texts, and texts that the pieces don't spell (a
    U+2581 in the text, say), have no tokens: zeros and ''.  A pair's count is
    the number of rows whose text links it, repeated rows and rows without a
    key included; n_best counts the links whose pair has the highest count of
    its first id, ties included; count_sum adds the counts of all links.  With
    keep_groups also ``groups``, the string that groups_sha256 is of.  An
    empty table gives none; other columns are not read.

    The pairs of each text and the shards stay in the shared folder, which
    must be mounted on all machines.
    """
    folder = working_folder(docs.sparkSession)
    links = link_table(docs, first, second, f"file://{folder}/links", key, text, keep_groups)
    shards = count_shards(links, f"{folder}/shards")
    groups = ["groups"] if keep_groups else []
    out = with_counts(links.where("not split"), shards)
    columns = ["key", *FIGURES, "n_best", "count_sum", "groups_sha256", *groups]
    if links.where("split").limit(1).count():
        parts = with_counts(links.where("split"), shards).groupBy("mark")
        sums = parts.agg(F.max("key").alias("key"), *[F.sum(c).alias(c) for c in (*FIGURES, "n_best", "count_sum")], *[F.max(c).alias(c) for c in ("groups_sha256", *groups)])
        out = out.select(columns).union(sums.select(columns))
    return out.select(F.col("key").alias(key), *columns[1:])
