"""Benchmark decontamination as a prefix-filtered containment join, in DataFrame operations alone.

A window is so many consecutive words of a benchmark item.  Containing a
window means containing all of its shingles, so one necessary shingle is
enough to find every candidate: the rarest one, by its count over the whole
corpus.  Candidates keep the shingle's place in the window, which fixes where
the window would start; it has to lie within the text.  A candidate counts
only if the words there equal the window's.

The texts are read three times: to count the benchmark's shingles, to find the
places of the rarest ones alone, and to compare.  No place of any other
shingle is ever written, however frequent it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import cut

#: Words of a window, and of the shingles that find candidates.
WINDOW, SHINGLE = 10, 5
#: Rows and bytes of a table of benchmark shingles or windows, at most, that are broadcast.
MOST_BROADCAST, MOST_BROADCAST_BYTES = 500_000, 64 << 20

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: ASCII characters that end words, behind A-Z, and what stands for them.
_ENDS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())


def words_of(text: Column) -> Column:
    """A-Z lower-cased words; none for null.  One pass over the characters, and a split at spaces, find what WORD matches."""
    plain = F.translate(F.coalesce(text, F.lit("")), _UPPER + _ENDS, _LOWER + " " * len(_ENDS))
    return F.array_remove(F.split(plain, " "), "")


def _small(df: DataFrame, size: Column) -> DataFrame:
    """Broadcast behind a check of its rows and bytes, else left to a shuffled join."""
    rows, held = df.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if rows <= MOST_BROADCAST and held <= MOST_BROADCAST_BYTES else df


def _starts(n: Column, width: Column | int) -> Column:
    """0 to n - width, or nothing."""
    width = F.lit(width) if isinstance(width, int) else width
    return F.when(n >= width, F.sequence(F.lit(0), n - width)).otherwise(F.array().cast("array<int>"))


def _tokens(words: str, n: Column, width: Column | int) -> Column:
    """The hash of each run of ``width`` words of an array column of n words."""
    size = F.lit(width) if isinstance(width, int) else width
    return F.transform(_starts(n, width), lambda i: F.xxhash64(F.slice(F.col(words), i + 1, size)))


def item_windows(benchmark: DataFrame, item: str, text: str, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(item, first, size, words, width): the different windows of each item; ``width`` is its shingles' words."""
    b = benchmark.select(benchmark[item].cast("string").alias("item"), words_of(benchmark[text]).alias("w")).distinct()
    size = F.least(F.size("w"), F.lit(window))
    rows = b.where("size(w) > 0").withColumn("size", size).withColumn("first", F.explode(_starts(F.size("w"), F.col("size"))))
    return rows.select("item", "size", F.slice("w", F.col("first") + 1, F.col("size")).alias("words"), F.least("size", F.lit(shingle)).alias("width")).distinct()


def contamination(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
    keep: tuple[str, ...] = (), window: int = WINDOW, shingle: int = SHINGLE,
) -> DataFrame:
    """One row for each row of docs: key, the columns in ``keep``, n_words, n_hit, n_items, items_sha256, contaminated.

    n_hit: words inside an occurrence of a window of any item; items_sha256:
    the digest of the items' ids, sorted as text and joined by commas.  Null
    and empty texts have no words; an item without words has no window; an
    item of fewer words than a window is one window.  Items with a null id
    count as one item, whose id is left out of the digest.
    Repeated items count once; repeated documents are judged one by one, and
    a null key is a key.  Without items nothing is contaminated.
    """
    windows = item_windows(benchmark, item, item_text, window, shingle).groupBy("size", "width", "words").agg(F.collect_set(F.struct("item")).alias("items"))
    windows = cut(windows)
    parts = windows.select("size", "words", "width", F.posexplode(_tokens("words", F.col("size"), F.col("width"))).alias("off", "token"))
    tokens = cut(parts.select("token", "width").distinct())
    widths = sorted(r[0] for r in windows.select("width").distinct().collect()) or [shingle]  # at most ``shingle`` numbers

    listed = docs.select(docs[key].alias("_key"), words_of(docs[text]).alias("w")).withColumn("n", F.size("w"))
    counts = None
    for width in widths:
        at = listed.select(F.explode(_tokens("w", F.col("n"), width)).alias("token"))
        found = at.join(_small(tokens.where(F.col("width") == width).select("token"), F.lit(8)), "token").groupBy("token").agg(F.count("*").alias("df")).withColumn("width", F.lit(width))
        counts = found if counts is None else counts.unionByName(found)

    # the rarest shingle of each window; a window with a shingle that no text has occurs nowhere
    ranked = parts.join(counts, ["token", "width"], "left").withColumn("df", F.coalesce("df", F.lit(0)))
    rare = ranked.groupBy("size", "width", "words").agg(F.min(F.struct("df", "off", "token")).alias("rare")).where("rare.df > 0")
    prefix = windows.join(rare, ["size", "width", "words"]).select("size", "width", "items", F.array_join("words", " ").alias("wanted"), F.col("rare.off").alias("off"), F.col("rare.token").alias("token"))
    prefix = cut(prefix)

    start = F.col("pos") - F.col("off")
    candidates = None
    for width in widths:
        at = listed.select("_key", "n", F.posexplode(_tokens("w", F.col("n"), width)).alias("pos", "token"))
        near = _small(prefix.where(F.col("width") == width), F.octet_length("wanted") + 40 * F.size("items") + 40)
        met = at.join(near, "token").where((start >= 0) & (start + F.col("size") <= F.col("n"))).select("_key", start.alias("start"), "size", "wanted", "items")
        candidates = met if candidates is None else candidates.unionByName(met)
    per_doc = candidates.groupBy("_key").agg(F.collect_set(F.struct("start", "size", "wanted", "items")).alias("c")).withColumnRenamed("_key", "_at")

    held_as = {key: "_key", text: "_text"} | {c: f"_keep{i}" for i, c in enumerate(keep) if c not in (key, text)}
    own = docs.select(*[docs[c].alias(name) for c, name in held_as.items()])
    joined = own.join(per_doc, F.col("_key").eqNullSafe(F.col("_at")), "left").withColumn("w", words_of(F.col("_text")))
    held = F.filter(F.coalesce("c", F.array().cast(per_doc.schema["c"].dataType)), lambda x: F.array_join(F.slice(F.col("w"), x["start"] + 1, x["size"]), " ") == x["wanted"])
    judged = joined.withColumn("n_words", F.size("w")).withColumn("hits", held)
    spans = F.array_sort(F.transform("hits", lambda x: F.struct(x["start"].alias("a"), (x["start"] + x["size"]).alias("b"))))
    cover = F.aggregate(
        spans, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(x["a"], s["end"]))).alias("n"), F.greatest(s["end"], x["b"]).alias("end")),
        lambda s: s["n"],
    )
    items = F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda x: F.transform(x["items"], lambda i: i["item"])))))
    return judged.select(
        F.col("_key").alias(key), *[F.col(held_as[c]).alias(c) for c in keep],
        F.col("n_words").cast("bigint").alias("n_words"), cover.cast("bigint").alias("n_hit"), F.size(items).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
    )
