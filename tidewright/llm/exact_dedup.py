"""Exact dedup over an extendible-hash index on shared files, by DataFrame functions only.

The index's pages hold one short entry for each row: its hash, its length and
its digest, no text.  They are written once to the shared folder.  Keys that
very many rows share are taken out and settled by a grouped minimum, which is
combined in the map tasks; there is a fixed most of them, so they are
broadcast.  The directory starts with one bucket; an overfull bucket splits
by its next leading bit, and where it already uses all bits of the directory,
the directory doubles.  Neighbouring buckets go to one owner task, so an owner
has a range of keys, and settles each key from its own entries.

Equal hashes are not taken for equal texts: a grouping by hash and whole text
compares the bytes, one copy of a text from each map task.  Hashes that turn
out to chain several texts are settled again by the texts themselves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shared import cut

#: Leading bits that the directory can use at most: it has at most 2**BITS slots.
BITS = 16
#: Entries of a bucket at most, unless all BITS are used.
BUCKET_ROWS = 1 << 18
#: A key of more than one in HOT_SHARE of the rows (and more than HOT_LEAST) is settled apart; there are fewer than HOT_SHARE of them.
HOT_SHARE, HOT_LEAST = 1000, 64
#: \x20 and \x09-\x0D.
SPACES = " \t\n\x0b\x0c\r"


def without_spaces(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for c in SPACES:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def directory(cells: list[int], capacity: int) -> tuple[int, list[int], list[int]]:
    """(depth, slots, rows): the bucket of each slot of the leading ``depth`` bits, and each bucket's rows.

    ``cells`` are the rows of each value of the finest leading bits; their
    number is a power of two.  Buckets are numbered in the order of their keys.
    """
    bits = (len(cells) - 1).bit_length()
    before = [0]
    for n in cells:
        before.append(before[-1] + n)
    depth, slots = 0, [0]
    first, local = [0], [0]  # a bucket's first cell, and the bits that it uses
    full = [0]
    while full:
        b = full.pop()
        size = 1 << (bits - local[b])
        if local[b] == bits or before[first[b] + size] - before[first[b]] <= capacity:
            continue
        if local[b] == depth:
            slots, depth = [s for s in slots for _ in range(2)], depth + 1
        local[b] += 1
        first.append(first[b] + size // 2)
        local.append(local[b])
        upper = first[-1] >> (bits - depth)
        slots[upper : upper + (1 << (depth - local[b]))] = [len(first) - 1] * (1 << (depth - local[b]))
        full += [b, len(first) - 1]
    order = {b: i for i, b in enumerate(dict.fromkeys(slots))}
    rows = [before[first[b] + (1 << (bits - local[b]))] - before[first[b]] for b in order]
    return depth, [order[b] for b in slots], rows


def owners(rows: list[int], most: int) -> list[int]:
    """The owner task of each bucket: neighbours, of about the same number of rows for each owner."""
    total, seen, out = max(1, sum(rows)), 0, []
    for n in rows:
        out.append(min(most - 1, (2 * seen + n) * most // (2 * total)))
        seen += n
    return out


def exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", hashed: Callable[[Column], Column] = F.xxhash64, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row for each row of docs: key, keep_id, group_size, kept, text_sha256.

    Texts are equal when the same without white space (\\x20, \\x09-\\x0D); a
    null text is an empty one, and empty texts are equal.  Of equal texts the
    row with the most code points stays, of those the one with the smallest
    key; a row without a key comes last.  Of rows that agree in key and text
    one stays.  keep_id is the key of the row that stays, group_size the
    number of equal rows.  An empty table gives none; other columns are not
    read, whatever they are called.  ``hashed`` turns the stripped text into a
    bigint; any function gives the same result.
    """
    spark = docs.sparkSession
    own = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    stripped = own.select("key", F.char_length(F.coalesce("text", F.lit(""))).alias("points"), without_spaces(F.col("text")).alias("body"))
    hashes = stripped.withColumn("h", hashed(F.col("body")).cast("bigint"))

    pages = cut(hashes.select("key", F.monotonically_increasing_id().alias("mark"), "points", "h", F.unhex(F.sha2(F.col("body").cast("binary"), 256)).alias("digest")))
    chained = cut(hashes.groupBy("h").agg(F.count_distinct("body").alias("texts")).where("texts > 1").select("h"))
    total = pages.count()
    collisions = chained.count()
    hot = cut(pages.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > max(HOT_LEAST, total // HOT_SHARE)).select("h"))
    if collisions:
        hot = cut(hot.join(chained, "h", "left_anti"))

    cool = pages.join(F.broadcast(hot), "h", "left_anti")
    if collisions:
        cool = cool.join(chained, "h", "left_anti")
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cell = F.shiftrightunsigned("h", 64 - BITS)
    cells = [0] * (1 << BITS)
    for value, n in cool.groupBy(cell.alias("cell")).count().collect():  # at most 2**BITS rows
        cells[value] = n
    depth, slots, rows = directory(cells, max(1, min(bucket_rows, sum(cells) // (4 * most))))
    owner = owners(rows, most)
    table = spark.range(1, numPartitions=1).select(F.posexplode(F.split(F.lit(",".join(str(owner[b]) for b in slots)), ",")).alias("slot", "owner"))
    table = table.select("slot", F.col("owner").cast("int").alias("owner"))

    slot = F.shiftrightunsigned("h", 64 - depth) if depth else F.lit(0)
    owned = cool.withColumn("slot", slot.cast("int")).join(F.broadcast(table), "slot").drop("slot").repartitionById(most, F.col("owner"))
    by_key = Window.partitionBy("owner", "h").orderBy(F.col("points").desc(), F.col("key").asc_nulls_last(), "mark")
    every = by_key.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    settled = owned.select("key", F.first("key").over(every).alias("keep_id"), F.count("*").over(every).alias("n"), (F.row_number().over(by_key) == 1).alias("kept"), "digest")

    def by_groups(rows: DataFrame, groups: DataFrame, on: list[str]) -> DataFrame:
        joined = rows.join(groups, on)
        return joined.select("key", F.col("best.key").alias("keep_id"), "n", (F.col("mark") == F.col("best.mark")).alias("kept"), "digest")

    best = F.min(F.struct((-F.col("points")).alias("fewer"), F.col("key").isNull().alias("last"), "key", "mark")).alias("best")
    apart = pages.join(F.broadcast(hot), "h")
    out = settled.union(by_groups(apart, F.broadcast(apart.groupBy("h").agg(F.count("*").alias("n"), best)), ["h"]))
    if collisions:
        numbered = hashes.withColumn("mark", F.monotonically_increasing_id()).withColumn("digest", F.unhex(F.sha2(F.col("body").cast("binary"), 256)))
        texts = cut(numbered.join(chained, "h", "left_semi"))
        out = out.union(by_groups(texts, texts.groupBy("h", "body").agg(F.count("*").alias("n"), best), ["h", "body"]))
    return out.select(F.col("key").alias(key), "keep_id", F.col("n").alias("group_size"), "kept", F.lower(F.hex("digest")).alias("text_sha256"))
