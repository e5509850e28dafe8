"""Exact dedup and its directory, against plain versions."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tidewright.llm import exact_dedup


def plain(data):
    """(key, text) rows to a sorted list of result rows."""
    groups = {}
    for i, (key, text) in enumerate(data):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), key is None, key or 0, i))
    out = []
    for body, rows in groups.items():
        first = min(rows)
        out += [(data[i][0], data[first[3]][0], len(rows), i == first[3], hashlib.sha256(body.encode()).hexdigest()) for *_, i in rows]
    return sorted(out, key=repr)


def found(df):
    assert df.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


def rows(seed=3, n=600):
    rng = random.Random(seed)
    texts = [" ".join(rng.choice(("a", "b", "ü", "\U0001f600")) for _ in range(rng.randint(0, 4))) for _ in range(60)]
    texts += [t.replace(" ", rng.choice(("\t", "\n ", "", "\x0b", "\x0c\r"))) for t in texts] + ["", None, "   ", "\xa0", "x\x00y", "long " * 50_000]
    return [(i, rng.choice(texts)) for i in range(n)] + [(1000 + i, "hot text") for i in range(n // 2)] + [(3000 + i, "hot  text") for i in range(5)]


@pytest.mark.parametrize("hashed", [F.xxhash64, lambda c: F.char_length(c) % 3, lambda c: F.lit(-1)])
def test_equal_plain(spark, hashed):
    data = rows()
    df = spark.createDataFrame(data, "doc_id bigint, text string").repartition(5)
    assert found(exact_dedup.exact_duplicates(df, hashed=hashed, bucket_rows=16)) == plain(data)


def test_odd_rows(spark):
    data = [(7, "a b"), (7, "a b"), (7, "a  b"), (None, "a    b"), (None, None), (None, ""), (9, "c"), (8, "c")]
    df = spark.createDataFrame([(*r, i, "t", 0, 1) for i, r in enumerate(data)], "doc_id bigint, text string, mark int, body string, h int, owner int")
    got = exact_dedup.exact_duplicates(df)
    assert found(got) == plain(data)
    assert found(got.where("kept")) == [r for r in plain(data) if r[3]] and got.where("kept").count() == 3
    assert found(exact_dedup.exact_duplicates(df.limit(0))) == []


def test_native(spark):
    plan = exact_dedup.exact_duplicates(spark.createDataFrame([(1, "a")], "doc_id bigint, text string"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|MapPartitions", plan)


def test_directory():
    rng = random.Random(5)
    cells = [rng.choice((0, 0, 1, 3, 40)) for _ in range(64)]
    depth, slots, sizes = exact_dedup.directory(cells, 50)
    assert len(slots) == 2**depth and slots == sorted(slots) and sum(sizes) == sum(cells)
    width = 64 >> depth
    for b, n in enumerate(sizes):
        first, many = slots.index(b), slots.count(b)
        assert n == sum(cells[first * width : (first + many) * width]) and many & (many - 1) == 0 and first % many == 0
        assert n <= 50 or many * width == 1
        if many < len(slots):  # its parent was overfull
            lower = first // (2 * many) * 2 * many
            assert sum(cells[lower * width : (lower + 2 * many) * width]) > 50
    assert exact_dedup.directory([0] * 8, 1) == (0, [0], [0])
    owner = exact_dedup.owners(sizes, 4)
    assert owner == sorted(owner) and set(owner) == {0, 1, 2, 3}
