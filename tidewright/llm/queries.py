"""The operators of this subpackage as queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, chunk_dedup, decontamination, exact_dedup, language, near_dedup, quality, sharding, suffix_dedup, token_alignment, toxicity, url_filter, vector_codes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return sharding.shard_rows(docs, "doc_id")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", language.held_out(F.col("doc_id")).alias("held_out"))
    model = toxicity.train(docs.where("not held_out"), table(spark, sf_dir, "labels"))
    return toxicity.score_texts(docs, model, keep=("held_out",))


def op6_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.dedup_substrings(table(spark, sf_dir, "documents"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", language.held_out(F.col("doc_id")).alias("held_out"))
    model = language.train(docs.where("not held_out"), byte_bpe.read_file(vocabulary_path()))
    return language.identify(docs, model, keep=("held_out",))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_suffixes(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = byte_bpe.read_file(vocabulary_path())
    return byte_bpe.encode_documents(table(spark, sf_dir, "documents"), ranks)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second = (byte_bpe.read_file(vocabulary_path(name)) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return token_alignment.align(table(spark, sf_dir, "documents"), first, second)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_quality": op2_quality,
    "op3_sharding": op3_sharding,
    "op4_url_filter": op4_url_filter,
    "op5_toxicity": op5_toxicity,
    "op6_chunk_dedup": op6_chunk_dedup,
    "op7_language": op7_language,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_decontamination": op9_decontamination,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_token_alignment": op11_token_alignment,
    "op12_vector_codes": op12_vector_codes,
    "op13_exact_dedup": op13_exact_dedup,
}


def _op3_sql() -> str:
    owner = ",".join(map(str, sharding.lookup_table()))
    names = ",".join(f"'{s}'" for s in sharding.SHARDS)
    return f"""
        WITH t AS (SELECT string_split('{owner}', ',') AS owner, [{names}] AS names),
             d AS (SELECT doc_id, CAST(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) % {sharding.TABLE_SIZE} AS INTEGER) AS slot FROM documents)
        SELECT doc_id, slot, names[CAST(owner[slot + 1] AS INTEGER) + 1] AS shard FROM d, t"""


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_OP4_SQL = rf"""
    WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
         p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
                      regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path FROM r),
         m AS (SELECT *, '.' || host AS dotted FROM p),
         w AS (SELECT page_id, host, path,
                      CASE WHEN ends_with(dotted, '.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
                           WHEN ends_with(dotted, '.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
                           WHEN ends_with(dotted, '.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
                           WHEN ends_with(dotted, '.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM m)
    SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM w"""

_OP1_SQL = rf"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
         s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                                   ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
         sets AS (SELECT doc_id, len(s) AS n, list_sort(s) AS s FROM s),
         reps AS (SELECT s, any_value(n) AS n, min(doc_id) AS rep FROM sets WHERE n > 0 GROUP BY s),
         x AS (SELECT rep, n, unnest(s) AS g FROM reps),
         i AS (SELECT a.rep AS a, b.rep AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM x a JOIN x b ON a.g = b.g AND a.rep < b.rep GROUP BY a.rep, b.rep),
         l AS (SELECT a, b FROM i WHERE 100 * k >= 85 * (na + nb - k)),
         e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
         r(n, c) AS (SELECT rep, rep FROM reps UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.n AND r.c < e.b),
         m AS (SELECT n, min(c) AS c FROM r GROUP BY n)
    SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_shingles, coalesce(m.c, d.doc_id) AS component_id, coalesce(m.c, d.doc_id) = d.doc_id AS kept
    FROM sets d LEFT JOIN reps ON reps.s = d.s LEFT JOIN m ON m.n = reps.rep"""

_OP9_SQL = rf"""
    WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{decontamination.WORD}') AS w FROM documents),
         bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{decontamination.WORD}') AS w FROM benchmark),
         bl AS (SELECT item_id, w, least(len(w), 10) AS size FROM bw WHERE len(w) > 0),
         win AS (SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS words FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS i FROM bl)),
         sizes AS (SELECT DISTINCT size FROM bl),
         dwin AS (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS words FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM dw, sizes WHERE len(w) >= size)),
         hit AS (SELECT DISTINCT doc_id, item_id, i, size FROM dwin JOIN win USING (size, words)),
         pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hit) GROUP BY doc_id),
         it AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id)
    SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
    FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)"""

#: A word lies in a repeat of 6 words or more just if it lies in a 6-word window that the text has twice; the longest repeat is the longest run of equal windows at one distance.
_OP2_SQL = rf"""
    WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
         lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t),
         l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
         p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM t),
         g AS (SELECT doc_id, i, len(w) AS n, hash(w[i:i + 2]) AS h3, hash(w[i:i + 5]) AS h6 FROM p),
         s3 AS (SELECT doc_id, unnest(range(i, i + 3)) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, h3) AS k FROM g WHERE i <= n - 2) WHERE k > 1),
         r3 AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM s3 GROUP BY doc_id),
         k6 AS (SELECT doc_id, i, h6, count(*) OVER (PARTITION BY doc_id, h6) AS k FROM g WHERE i <= n - 5),
         s6 AS (SELECT doc_id, unnest(range(i, i + 6)) AS p FROM k6 WHERE k > 1),
         r6 AS (SELECT doc_id, count(DISTINCT p) AS covered_words FROM s6 GROUP BY doc_id),
         pairs AS (SELECT a.doc_id, a.i, b.i - a.i AS gap FROM k6 a JOIN k6 b ON a.doc_id = b.doc_id AND a.h6 = b.h6 AND a.i < b.i WHERE a.k > 1 AND b.k > 1),
         runs AS (SELECT doc_id, count(*) + 5 AS words FROM (SELECT doc_id, gap, i - row_number() OVER (PARTITION BY doc_id, gap ORDER BY i) AS island FROM pairs) GROUP BY doc_id, gap, island),
         m AS (SELECT doc_id, max(words) AS longest_repeat FROM runs GROUP BY doc_id),
         c AS (SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
                      CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                      coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(covered_words, 0) AS covered_words, CAST(coalesce(longest_repeat, 0) AS BIGINT) AS longest_repeat
               FROM t LEFT JOIN l USING (doc_id) LEFT JOIN r3 USING (doc_id) LEFT JOIN r6 USING (doc_id) LEFT JOIN m USING (doc_id))
    SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
           NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * covered_words <= {quality.MOST_COVERED_PERCENT} * n_words AND longest_repeat <= {quality.MOST_LONGEST} AS kept
    FROM c"""

_OP8_SQL = r"""
    WITH b AS (SELECT doc_id, coalesce(encode(text), ''::BLOB) AS x FROM documents),
         w AS (SELECT doc_id, i, x[i:i + 49] AS s FROM (SELECT doc_id, x, unnest(range(1, octet_length(x) - 48)) AS i FROM b)),
         r AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS least FROM w) WHERE least < doc_id),
         o AS (SELECT doc_id, i, CAST(coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50, true) AS INT) AS opens FROM r),
         p AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS z FROM (SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM o) GROUP BY doc_id, run),
         k AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 1) AS f, a AS t FROM p UNION ALL SELECT doc_id, max(z), CAST(NULL AS BIGINT) FROM p GROUP BY doc_id),
         h AS (SELECT doc_id, string_agg(hex(x[f:coalesce(t - 1, octet_length(x))]), '' ORDER BY f) AS rest FROM k JOIN b USING (doc_id) GROUP BY doc_id),
         n AS (SELECT doc_id, CAST(sum(z - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM p GROUP BY doc_id)
    SELECT doc_id, CAST(octet_length(x) AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(coalesce(unhex(rest), x)) AS kept_sha256
    FROM b LEFT JOIN n USING (doc_id) LEFT JOIN h USING (doc_id)"""



def _op12_sql() -> str:
    """Rounds as common table expressions; m holds a distance and, below it, the index, so that ties go to the lower one."""
    steps = [
        """v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
             WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        "p AS MATERIALIZED (SELECT vec_id, part, v[part * len(v) // 4 + 1:(part + 1) * len(v) // 4] AS x FROM v, range(4) t(part))",
        "c0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS c FROM p QUALIFY entry < 256)",
    ]
    for r in range(5):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, part, any_value(x) AS x, min(CAST(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) * 256 + entry) AS m
             FROM p JOIN c{r} USING (part) GROUP BY vec_id, part)""")
        if r < 4:
            steps.append(f"s{r} AS (SELECT part, m % 256 AS entry, unnest(x) AS x, unnest(range(len(x))) AS i FROM a{r})")
            steps.append(f"n{r} AS (SELECT part, entry, list(f ORDER BY i) AS c FROM (SELECT part, entry, i, CAST(floor(CAST(sum(x) AS DOUBLE) / count(*)) AS BIGINT) AS f FROM s{r} GROUP BY part, entry, i) GROUP BY part, entry)")
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT part, entry, coalesce(n{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN n{r} USING (part, entry))")
    steps.append("e AS (SELECT vec_id, string_agg(lpad(lower(to_hex(m % 256)), 2, '0'), '' ORDER BY part) AS code, CAST(sum(m // 256) AS BIGINT) AS error FROM a4 GROUP BY vec_id)")
    steps.append("h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c4)")
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM e JOIN v USING (vec_id), h"


_OP13_SQL = r"""
    WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents),
         g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY body ORDER BY points DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size FROM d)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM g"""

ORACLE_SQL = {
    "op1_minhash_dedup": _OP1_SQL,
    "op2_quality": _OP2_SQL,
    "op3_sharding": _op3_sql(),
    "op4_url_filter": _OP4_SQL,
    "op8_suffix_dedup": _OP8_SQL,
    "op9_decontamination": _OP9_SQL,
    "op12_vector_codes": _op12_sql(),
    "op13_exact_dedup": _OP13_SQL,
}
