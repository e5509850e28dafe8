"""Near-duplicates by MinHash with tensored banding, confirmed on full shingle sets.

A document has two small collections of keys, each key a hash of a few
minimum hashes.  Its table keys are all pairs of a key of the one collection
and a key of the other, so k x k tables need 2 x k keys.  Pairs are formed
only from keys that another document has as well.

Documents with equal sets are one class, of which the smallest id stands for
all.  Classes that meet in tables form groups; the members of a group are
compared on their full sets in blocks, and each pair of blocks sends on at
most one link for each member: enough to span what it found connected.  No
pair of a group is ever written out as a row, and none is left uncompared.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblocks as tb
from .runtime import arrow_map, components, cut, ship

#: Words of a shingle; percent of the union that must be shared.
WIDTH, PERCENT = 5, 80
#: Minimum hashes of a key, and the fewest keys of each of the two collections.
ROWS, KEYS = 4, 12
#: Most probability that a pair at the threshold is missed.
MOST_MISSED = 0.0003
#: Members of a group that a block holds.
BLOCK = 384
#: Shingles compared at once.
_COLUMNS = 4096


def keys_for(percent: int) -> int:
    """Keys of each collection with which 2 * (1 - s**ROWS)**keys is at most MOST_MISSED: 12 at 85 %, 17 at 80 %."""
    if not 0 < percent <= 100:
        raise ValueError("percent must be over 0 and at most 100")
    hit = (percent / 100) ** ROWS
    return KEYS if hit == 1 else max(KEYS, math.ceil(math.log(MOST_MISSED / 2) / math.log1p(-hit)))


def shingle_sets(data: np.ndarray, offs: np.ndarray, width: int = WIDTH) -> list[np.ndarray]:
    """The sorted different shingle hashes of each text of a block."""
    starts, ends, doc = tb.words(data, offs)
    words = tb.hash_spans(data, starts, ends, tb.LOWER_VALUES)
    hashes, owner = tb.shingle_hashes(words, doc, len(offs) - 1, width)
    until = np.searchsorted(owner, np.arange(len(offs)))
    return [np.unique(hashes[a:b]) for a, b in zip(until[:-1], until[1:], strict=True)]


def collection_keys(sets: list[np.ndarray], rows: int = ROWS, keys: int = KEYS) -> np.ndarray:
    """[set, 2 * keys]: the keys of both collections of each set; sets must not be empty."""
    flat = np.concatenate(sets)
    at = np.cumsum([0, *map(len, sets[:-1])])
    seeds = tb.mix64(np.arange(1, 2 * rows * keys + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
    out = np.zeros((len(sets), 2 * keys), dtype=np.uint64)
    for k in range(2 * keys):
        acc = np.full(len(sets), k + 1, dtype=np.uint64)
        for seed in seeds[k * rows : (k + 1) * rows]:
            least = np.minimum.reduceat((flat ^ seed) * (seed | np.uint64(1)), at)
            acc = tb.mix64(acc * np.uint64(0x9E3779B97F4A7C15) + least)
        out[:, k] = acc
    return out


def sketches(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, keys: int = KEYS) -> DataFrame:
    """(key, n_shingles, set_id, a, b): the size and digest of each row's set, and its keys (null for an empty set)."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offs in tb.blocks(batch.column(1)):
                sets = shingle_sets(data, offs, width)
                full = [i for i, s in enumerate(sets) if len(s)]
                ids: list = [None] * len(sets)
                for i in full:
                    ids[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
                a: list = [None] * len(sets)
                b: list = [None] * len(sets)
                if full:
                    found = collection_keys([sets[i] for i in full], keys=keys).view(np.int64)
                    for i, row in zip(full, found, strict=True):
                        a[i], b[i] = row[:keys], row[keys:]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, end - first), pa.array([len(s) for s in sets], pa.int64()), pa.array(ids, pa.binary()), pa.array(a, pa.list_(pa.int64())), pa.array(b, pa.list_(pa.int64()))],
                    names=[key, "n_shingles", "set_id", "a", "b"],
                )

    kind = docs.schema[key].dataType.simpleString()
    return arrow_map(docs.select(docs[key], docs[text]), over, f"`{key}` {kind}, n_shingles bigint, set_id binary, a array<bigint>, b array<bigint>")


def candidate_groups(classes: DataFrame) -> DataFrame:
    """(node, component): groups of classes (rep, a, b) that meet in a table, by way of others too."""
    collections = classes.select("rep", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("keys")), F.struct(F.lit(1).alias("side"), F.col("b").alias("keys")))).alias("c"))
    collections = collections.select("rep", "c.side", F.explode("c.keys").alias("part"))
    shared = cut(collections.groupBy("part").agg(F.count("*").alias("n")).where("n > 1").select("part"))
    met = collections.join(shared, "part")
    pairs = met.groupBy("rep").agg(F.collect_set(F.when(F.col("side") == 0, F.col("part"))).alias("a"), F.collect_set(F.when(F.col("side") == 1, F.col("part"))).alias("b"))
    table_keys = cut(pairs.select("rep", F.explode("a").alias("x"), "b").select("rep", "x", F.explode("b").alias("y")).select("rep", F.xxhash64("x", "y").alias("bucket")))
    centres = cut(table_keys.groupBy("bucket").agg(F.min("rep").alias("centre"), F.count("*").alias("n")).where("n > 1").select("bucket", "centre"))
    links = table_keys.join(centres, "bucket").where("rep <> centre").select("rep", "centre").distinct()
    return components(links, "rep", "centre")


def spanning_links(sets: list[np.ndarray], blocks: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """For each set the first one that it is connected with by links, given by position.

    With two blocks, only pairs across them are compared, otherwise all.
    """
    m = len(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(m), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.ones(len(flat), dtype=bool)
    new[1:] = flat[1:] != flat[:-1]
    column = np.cumsum(new) - 1
    often = np.bincount(column)[column] > 1
    column, owner = column[often], owner[often]
    _, column = np.unique(column, return_inverse=True)
    both = np.zeros((m, m), dtype=np.float32)
    n_columns = int(column.max()) + 1 if len(column) else 0
    for low in range(0, n_columns, _COLUMNS):
        a, b = np.searchsorted(column, (low, low + _COLUMNS))
        grid = np.zeros((m, min(_COLUMNS, n_columns - low)), dtype=np.float32)
        grid[owner[a:b], column[a:b] - low] = 1
        both += grid @ grid.T
    shared = np.rint(both).astype(np.int64)
    linked = 100 * shared >= percent * (sizes[:, None] + sizes[None, :] - shared)
    if blocks.min() != blocks.max():
        linked &= blocks[:, None] != blocks[None, :]
    np.fill_diagonal(linked, False)
    root = np.arange(m)
    seen = np.zeros(m, dtype=bool)
    for start in range(m):
        if seen[start]:
            continue
        front = np.array([start])
        seen[start] = True
        while len(front):
            near = linked[front].any(axis=0) & ~seen
            front = np.flatnonzero(near)
            seen[front] = True
            root[front] = start
    return root


def confirmed_links(docs: DataFrame, groups: DataFrame, key: str, text: str, width: int = WIDTH, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """(a, b): links that span what full comparison connects within each pair of blocks of a group."""
    groups = cut(groups)
    sizes = cut(groups.groupBy("component").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")))
    members = groups.join(sizes, "component").select("node", "component", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))
    texts = docs.select(docs[key].alias("_key"), docs[text].alias("t")).join(cut(members), F.col("_key") == F.col("node")).select("node", "component", "blocks", "block", "t")
    spread = texts.select("node", "component", "block", "t", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    spread = spread.select("node", "component", "block", "t", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))

    def compare(group: pa.Table) -> pa.Table:
        node = group.column("node").to_numpy()
        sets = [s for _, _, data, offs in tb.blocks(group.column("t").combine_chunks()) for s in shingle_sets(data, offs, width)]
        some = np.flatnonzero([len(s) > 0 for s in sets])
        order = some[np.argsort(node[some], kind="stable")]
        if not len(order):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        root = spanning_links([sets[i] for i in order], group.column("block").to_numpy()[order], percent)
        linked = np.flatnonzero(root != np.arange(len(root)))
        return pa.table({"a": node[order[linked]], "b": node[order[root[linked]]]})

    ship(docs.sparkSession)
    return spread.groupBy("component", "i", "j").applyInArrow(compare, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row for each row of docs: key, n_shingles, component_id, kept.

    Shingles are ``width`` lower-cased (A-Z) words; a text of fewer words is
    one shingle; a null or empty text, or white space, has none and is linked
    with nothing.  component_id is the smallest key reachable over links of
    ``percent`` or more of the union, kept whether that is the row's own.
    Keys are integers that tell documents apart; repeated rows are judged
    alike, and a row without a key stands for itself: component_id is null
    and kept true.  Other columns are not read.
    """
    marks = cut(sketches(docs, key, text, width, keys_for(percent)).withColumnRenamed(key, "_key"))
    usable = marks.where("set_id is not null and _key is not null")
    # MIN over the struct takes the smallest key; equal sets have equal keys
    classes = cut(usable.groupBy("set_id").agg(F.min(F.struct("_key", "a", "b")).alias("m")).select("set_id", F.col("m._key").cast("bigint").alias("rep"), "m.a", "m.b"))
    groups = candidate_groups(classes)
    links = confirmed_links(docs, groups, key, text, width, percent)
    found = components(links)
    named = cut(classes.select("set_id", "rep").join(found, F.col("rep") == F.col("node"), "left").select("set_id", F.coalesce("component", "rep").alias("component")))
    out = marks.select("_key", "n_shingles", "set_id").join(named, "set_id", "left")
    component = F.when(F.col("_key").isNotNull(), F.coalesce("component", F.col("_key").cast("bigint")))
    return out.select(F.col("_key").alias(key), "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("_key"), F.lit(True)).alias("kept"))
