"""The corpus pipeline: quality rules, near-dedup, substring dedup, decontamination, byte-level BPE.

Each stage takes and returns the columns of documents, whatever else a table
has and however its columns are called; the last returns a row of digests for
each document.  Stages work on positional names, so an extra column never
clashes with one that an operator adds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm import byte_bpe, chunk_dedup, decontamination, near_dedup, quality
from tidewright.llm.queries import table, vocabulary_path


#: Percent of the union of the shingles that near-duplicates of the pipeline share; op1 has its own.
NEAR_PERCENT = 80


def _plain(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with its columns called c0, c1, ..., and the new name of each old one (the first of equals)."""
    names = {}
    for i, c in enumerate(docs.columns):
        names.setdefault(c, f"c{i}")
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]), names


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; a null or empty text is rejected."""
    plain, name = _plain(docs)
    key, text = name["doc_id"], name["text"]
    judged = quality.judge_quality(plain, key, text, keep=tuple(c for c in plain.columns if c != key))
    return judged.where("kept").select(*plain.columns).toDF(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, 0.8 or more): the one of smallest doc_id.  Repeated rows of it and rows without doc_id stay."""
    plain, name = _plain(docs)
    key, text = name["doc_id"], name["text"]
    gone = near_dedup.near_duplicates(plain, key, text, percent=NEAR_PERCENT).where("not kept").select(F.col(key).alias("gone")).distinct()
    return plain.join(gone, plain[key] == gone["gone"], "left_anti").toDF(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that one of smaller doc_id has; those of which nothing is left go.  n_chars follows the text."""
    plain, name = _plain(docs)
    key, text = name["doc_id"], name["text"]
    cut = chunk_dedup.dedup_substrings(plain, key, text, keep=tuple(c for c in plain.columns if c not in (key, text)), with_text=True)
    cut = cut.where("n_removed < n_bytes or n_bytes = 0")
    new = {text: F.col("kept_text")}
    if "n_chars" in name:
        size = name["n_chars"]
        new[size] = F.when(F.col("n_removed") > 0, F.length("kept_text")).otherwise(F.col(size)).cast(plain.schema[size].dataType)
    return cut.select(*[new.get(c, F.col(c)).alias(c) for c in plain.columns]).toDF(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    plain, name = _plain(docs)
    key = name["doc_id"]
    judged = decontamination.contamination(plain, table(spark, sf_dir, "benchmark"), key, name["text"], keep=tuple(c for c in plain.columns if c != key))
    return judged.where("not contaminated").select(*plain.columns).toDF(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded bytes of each document."""
    plain, name = _plain(docs)
    found = byte_bpe.encode_documents(plain, byte_bpe.read_file(vocabulary_path()), name["doc_id"], name["text"])
    return found.withColumnRenamed(name["doc_id"], "doc_id")


STAGES = [
    ("quality_rules", quality_rules),
    ("minhash_near_dedup", near_dedup_stage),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", decontaminate),
    ("byte_level_bpe", encode),
]

#: Content-defined chunks and BPE have no SQL form; tests hold the rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
