"""Vector codes against plain integer arithmetic."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException

from tidewright.llm import vector_codes as vc

SCHEMA = "vec_id bigint, embedding array<float>, label int, code int, error string"


def plain(rows, entries=256, rounds=4):
    kept = [(k, [math.floor(1024 * x) for x in v], lab, v) for k, v, lab, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    size = len(kept[0][1]) // 4
    part = lambda v, p: v[p * size : (p + 1) * size]
    first = {}
    for k, v, *_ in sorted((r for r in kept if r[0] is not None), key=lambda r: (r[0], r[3])):
        first.setdefault(k, v)
    first = [first[k] for k in sorted(first)[:entries]]
    books = [[part(v, p) for v in first] for p in range(4)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v, p: min((far(part(v, p), c), i) for i, c in enumerate(books[p]))
    for _ in range(rounds):
        new = []
        for p in range(4):
            members = [[] for _ in books[p]]
            for _, v, *_ in kept:
                members[near(v, p)[1]].append(part(v, p))
            new.append([[sum(x) // len(m) for x in zip(*m, strict=True)] if m else c for m, c in zip(members, books[p], strict=True)])
        books = new
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    out = [(k, "".join(f"{near(v, p)[1]:02x}" for p in range(4)), sum(near(v, p)[0] for p in range(4)), lab) for k, v, lab, _ in kept]
    sums = {}
    for *_, e, lab in out:
        sums[lab] = sums.get(lab, 0) + e
    return sorted(((k, c, e, sums[lab], sha) for k, c, e, lab in out), key=repr)


def found(df):
    assert df.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


def rows(n=400, seed=1):
    rng = random.Random(seed)
    grid = lambda: [rng.choice((-1, 0, 0.5, 1)) / 1024 * rng.choice((1, 300)) for _ in range(8)]  # noqa: E731  many ties
    out = [(i, grid(), rng.choice((0, 0, 0, 1, None)), i, "x") for i in range(n)]
    out += [(-5 + i, out[7][1], 2, 0, None) for i in range(60)]
    out += [(n, None, 1, 0, ""), (n + 1, [1.0, None] * 4, 1, 0, ""), (n + 2, [math.nan] * 8, 1, 0, ""), (n + 3, [-math.inf] * 8, 1, 0, ""), (None, [0.25] * 8, None, 0, ""), (3, grid(), 5, 0, ""), (3, out[3][1], 5, 0, "")]
    return out


@pytest.mark.parametrize("entries", [256, 5])
def test_equal_plain(spark, entries):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(4)
    assert found(vc.compress(df, entries=entries)) == plain(data, entries)


def test_many_labels(spark, monkeypatch):
    data = [(i, [float(i % 7), 1.0, 2.0, 3.0], i % 40 if i % 2 else 99) for i in range(300)]
    monkeypatch.setattr(vc, "HOT_SHARE", 10)  # most labels come back by a shuffle
    assert found(vc.compress(spark.createDataFrame(data, "vec_id bigint, embedding array<double>, label bigint"), entries=3)) == plain(data, 3)


def test_odd_tables(spark):
    df = spark.createDataFrame(rows(10), SCHEMA)
    assert found(vc.compress(df.limit(0))) == []
    assert found(vc.compress(df.where("embedding is null"))) == []
    keyless = vc.compress(df.where("vec_id is null"))
    assert [r[:4] for r in found(keyless)] == [(None, None, None, None)]
    assert [r[1:4] for r in found(vc.compress(spark.createDataFrame([(1, [], 1)], "vec_id bigint, embedding array<float>, label int")))] == [("00000000", 0, 0)]
    with pytest.raises(ValueError):
        vc.compress(spark.createDataFrame([(1, [1.0] * 6, 1)], "vec_id bigint, embedding array<float>, label int"))
    for bad in ([1.0] * 8, [1e30] * 4):
        with pytest.raises(PySparkException, match="components"):
            vc.compress(spark.createDataFrame([(1, [1.0] * 4, 1), (2, bad, 1)], "vec_id bigint, embedding array<float>, label int"), entries=1).collect()


@pytest.mark.parametrize("size,most", [(16, 200), (16, 2**27), (300, 2**20), (1, 2**29)])
def test_intervals_hold_and_ties_go_low(size, most):
    rng = np.random.default_rng(size)
    x, c = rng.integers(-most, most, (500, size)), rng.integers(-most, most, (64, size))
    c[40] = c[3]
    x[:50] = c[rng.integers(0, 64, 50)] + rng.integers(-1, 2, (50, size))
    exact = [[sum(int(b) * (int(b) - 2 * int(a)) for a, b in zip(u, v, strict=True)) for v in c] for u in x]
    low, high = vc.intervals(x, c)
    assert all(l <= e <= h for r in zip(low, exact, high, strict=True) for l, e, h in zip(*r, strict=True))
    index, distance = vc.nearest(x, c)
    assert index.tolist() == [r.index(min(r)) for r in exact]
    assert distance.tolist() == [min(r) + sum(int(a) ** 2 for a in u) for r, u in zip(exact, x, strict=True)]
