"""Joins of many pairs dealt by blocks, against plain loops."""

import random

import pytest

from tidewright.functions.expr import col
from tidewright.operators import joins as j
from tidewright.operators import theta
from tidewright.operators.frame import Frame


@pytest.fixture
def sides(spark, monkeypatch):
    """One key with most rows, missing keys and ends, rows that are equal, and blocks of four rows."""
    monkeypatch.setattr(theta, "many_pairs", lambda *a: True)
    monkeypatch.setattr(theta, "BLOCK", 4)
    monkeypatch.setattr(theta, "TASK_PAIRS", 64)
    dealt = []
    plain = theta.dealt
    monkeypatch.setattr(theta, "dealt", lambda *a: dealt.append(plain(*a)) or dealt[-1])
    rng = random.Random(11)
    left = [(i // 2, rng.choice([1, 1, 1, 1, 2, 3, None]), None if i % 17 == 0 else float(rng.randrange(9))) for i in range(130)]
    right = [(i, rng.choice([1, 1, 1, 2, 4, None]), None if i % 19 == 0 else float(rng.randrange(9))) for i in range(110)]
    yield left, right, Frame(spark.createDataFrame(left, "a int, k int, x double")), Frame(spark.createDataFrame(right, "b int, k int, y double")), dealt
    assert dealt and dealt[-1] is not None


def told(frame, *columns):
    return sorted(tuple(r) for r in frame.df.select(*columns).collect())


@pytest.mark.parametrize("na", ["na", "never"])
def test_equal_keys(sides, na):
    left, right, f, g, dealt = sides
    wanted = sorted((a, b) for a, k, _ in left for b, m, _ in right if k == m and (na == "na" or k is not None))
    assert told(j.inner_join(f, g, "k", na_matches=na), "a", "b") == wanted
    assert dealt[-1][0].rdd.getNumPartitions() >= len(wanted) / 64  # tasks grow with the pairs, not the rows


def test_equal_keys_and_a_comparison(sides):
    left, right, f, g, _ = sides
    made = j.inner_join(f, g, j.join_by("k", col("x") < col("y")))
    assert told(made, "a", "b") == sorted((a, b) for a, k, x in left for b, m, y in right if k == m and x is not None and y is not None and x < y)


def test_intervals(sides):
    left, right, f, g, _ = sides
    f, g = f.select("a", lo="x", hi=col("x") + 2), g.select("b", lo2="y", hi2=col("y") + 1.5)
    meet = sorted((a, b) for a, _, x in left for b, _, y in right if x is not None and y is not None and x <= y + 1.5 and y <= x + 2)
    assert told(j.inner_join(f, g, j.join_by(j.overlaps("lo", "hi", "lo2", "hi2"))), "a", "b") == meet
    assert told(j.range_join(f, g, ("lo", "hi"), ("lo2", "hi2"), 1.0), "a", "b") == meet
    inside = sorted((a, b) for a, _, x in left for b, _, y in right if x is not None and y is not None and x <= y and y + 1.5 <= x + 2)
    assert told(j.inner_join(g, f, j.join_by(j.within("lo2", "hi2", "lo", "hi"))), "a", "b") == inside


def written(frame, folder):
    """The rows written as a file, and its bytes a row."""
    frame.df.write.parquet(str(folder))
    made = frame.df.sparkSession.read.parquet(str(folder))
    return made, sum(p.stat().st_size for p in folder.glob("*.parquet")) / made.count()


def test_pairs_of_equal_keys_come_in_runs(spark, tmp_path):
    """The pairs' files grow with the square of the rows, so a pair may take some bits only."""
    f, g = Frame(spark.range(2000).selectExpr("id AS a", "1 AS k")), Frame(spark.range(6000).selectExpr("id * 7 AS b", "1 AS k"))
    made, size = written(j.inner_join(f, g, "k").select("a", "b"), tmp_path / "pairs")
    assert size < 0.3
    assert tuple(made.selectExpr("count(*)", "sum(a)", "sum(b)", "count(DISTINCT a * 42000 + b)").first()) == (12_000_000, 6000 * 1999 * 1000, 2000 * 7 * 5999 * 3000, 12_000_000)


@pytest.mark.parametrize("turned", [False, True])
@pytest.mark.parametrize("pack", [1, 3, 256])
def test_either_side_is_packed(spark, sides, monkeypatch, turned, pack):
    """Texts, equal names, missing values and several comparisons, with the left or the right side in packs."""
    left, right, f, g, dealt = sides
    monkeypatch.setattr(theta, "PACK_OF_TEXTS", pack)
    f = Frame(spark.createDataFrame([(a, k, x, None if a % 7 == 0 else f"t{a % 5}") for a, k, x in left], "a int, k int, x double, t string"))
    g = Frame(spark.createDataFrame([(b, k, y, None if b % 9 == 0 else f"t{b % 6}") for b, k, y in right], "a int, k int, x double, t string"))
    if not turned:
        f, g = g, f
    made = j.inner_join(f, g, j.join_by("k", col("x") >= col("x"), col("t") < col("t")), na_matches="never")
    assert made.columns == ["a.x", "k", "x.x", "t.x", "a.y", "x.y", "t.y"] and dealt[-1].turned is turned
    rows = [[tuple(r) for r in d.df.collect()] for d in (f, g)]
    wanted = [(*p, q[0], *q[2:]) for p in rows[0] for q in rows[1] if p[1] is not None and p[1] == q[1] and None not in (p[2], q[2], p[3], q[3]) and p[2] >= q[2] and p[3] < q[3]]
    assert wanted and sorted(tuple(r) for r in made.df.collect()) == sorted(wanted)


def test_pairs_of_intervals_come_in_runs(spark, tmp_path):
    """A point's packs stand in the order of the points, so that most are met whole or not at all."""
    f = Frame(spark.range(12000).selectExpr("id AS a", "double(id * 7919 % 12000) AS x"))
    g = Frame(spark.range(4000).selectExpr("id AS b", "double(id * 7919 % 12000) AS lo", "double(id * 7919 % 12000 + 2500) AS hi"))
    made, size = written(j.inner_join(f, g, j.join_by(j.join_between("x", "lo", "hi"))).select("a", "b"), tmp_path / "pairs")
    low = [b * 7919 % 12000 for b in range(4000)]
    assert made.count() == sum(min(12000, x + 2501) - x for x in low) and size < 0.5
    assert made.distinct().count() == made.count()


def test_packs_without_a_match_are_left_out(sides):
    """The bounds of packs join before their rows do."""
    _, _, f, g, dealt = sides
    j.inner_join(f, g, j.join_by("k", col("x") < col("y")))
    assert [(a, op) for a, op, _ in dealt[-1].bounds] == [("y", ">")] and dealt[-1].turned
