"""Joins on inequalities by tiles against plain loops."""

import random

import pytest

from tidewright.functions.expr import col
from tidewright.operators import joins as j
from tidewright.operators import theta
from tidewright.operators.frame import Frame

OPS = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


@pytest.fixture(scope="module")
def sides(spark):
    draw = random.Random(5)

    def rows(n):  # many ties, a hot value, nulls, repeated rows
        return [(draw.choice([None, 3, 3, 3, *range(12)]), draw.choice([None, *[x / 2 for x in range(15)]]), draw.randrange(9), k // 2) for k in range(n)]

    left, right = rows(160), rows(120)
    a = Frame(spark.createDataFrame(left, "a int, x double, s int, i int"))
    b = Frame(spark.createDataFrame(right, "b bigint, x double, t int, i int"))
    return left, right, a, b


@pytest.mark.parametrize("ops", [("<",), ("<=", "<"), (">", ">="), ("<", ">", "<=")])
def test_tiles_equal_loops(sides, monkeypatch, ops):
    left, right, a, b = sides
    monkeypatch.setattr(theta, "FEW_PAIRS", 0)
    monkeypatch.setattr(theta, "TILE_BITS", 3)
    columns = [("a", "b"), ("x", "x"), ("s", "t")][: len(ops)]
    by = j.join_by(*[{"<": col(p) < col(q), "<=": col(p) <= col(q), ">": col(p) > col(q), ">=": col(p) >= col(q)}[op] for op, (p, q) in zip(ops, columns, strict=True)])

    def meets(p, q):
        return all(u is not None and v is not None and OPS[op](u, v) for op, u, v in zip(ops, p, q, strict=False))

    pairs = [(*p, *q) for p in left for q in right if meets(p, q)]
    has = [any(meets(p, q) for q in right) for p in left]
    lone = [(*p, *[None] * 4) for p, h in zip(left, has, strict=True) if not h]
    other = [(*[None] * 4, *q) for q in right if not any(meets(p, q) for p in left)]
    expected = {j.inner_join: pairs, j.left_join: pairs + lone, j.right_join: pairs + other, j.full_join: pairs + lone + other}
    for join, rows in expected.items():
        out = join(a, b, by).df
        assert out.columns == ["a", "x.x", "s", "i.x", "b", "x.y", "t", "i.y"]
        assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, rows))
    for join, wanted in ((j.semi_join, True), (j.anti_join, False)):
        assert sorted(map(repr, map(tuple, join(a, b, by).df.collect()))) == sorted(repr(p) for p, h in zip(left, has, strict=True) if h is wanted)


def test_no_nested_loop_and_empty_sides(sides, monkeypatch):
    _, _, a, b = sides
    monkeypatch.setattr(theta, "FEW_PAIRS", -1)
    by = j.join_by(col("a") < col("b"), col("x") > col("x"))
    plan = j.inner_join(a, b, by).df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    nothing = Frame(b.df.limit(0))
    assert j.inner_join(a, nothing, by).df.isEmpty() and j.left_join(a, nothing, by).df.count() == 160 and j.anti_join(a, nothing, by).df.count() == 160


def test_self_join_of_odd_names(spark, monkeypatch):
    monkeypatch.setattr(theta, "FEW_PAIRS", 0)
    f = Frame(spark.createDataFrame([(k, k % 7) for k in range(40)], "`a.b` int, `c d` int"))
    out = j.left_join(f, f, j.join_by(col("a.b") < col("a.b"), col("c d") > col("c d"))).df
    assert out.columns == ["a.b.x", "c d.x", "a.b.y", "c d.y"]
    rows = [(k, k % 7) for k in range(40)]
    pairs = [(*p, *q) for p in rows for q in rows if p[0] < q[0] and p[1] > q[1]]
    assert sorted(tuple(r) for r in out.collect() if r[2] is not None) == pairs


@pytest.mark.parametrize("most", [1000, 20, 0])
@pytest.mark.parametrize("ops", [("<=", ">", ">"), ("<", "<", ">="), (">=", "<=", "<")])
def test_three_comparisons_make_no_pairs_of_all(spark, monkeypatch, most, ops):
    """Right rows that others stand for go first; pairs of tiles are told apart without the pairs of their rows."""
    import datetime as dt
    import operator
    import random

    def pairs(*_):
        raise AssertionError("the pairs of rows are made")

    monkeypatch.setattr(theta, "matches", pairs)
    monkeypatch.setattr(theta, "MOST_LEADING", most)
    monkeypatch.setattr(theta, "TILE_BITS", 4)
    rng = random.Random(5)
    day = dt.datetime(2024, 1, 1)

    def made(n):
        return [(None if rng.random() < 0.03 else day + dt.timedelta(hours=rng.randrange(60)), rng.choice([None, float("nan"), -5.5] + [rng.random() * 9 for _ in range(30)]), rng.choice([-(1 << 63), rng.randrange(50), rng.randrange(50)])) for _ in range(n)]

    left, right = made(150), made(200)
    l, r = (spark.createDataFrame(rows, f"__{s}0 timestamp, __{s}1 double, __{s}2 bigint") for rows, s in ((left, "l"), (right, "r")))
    out = theta.matched(l, r, ops, "found").select("__l0", "__l1", "__l2", "found").collect()
    how = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}

    def place(v):  # NaN is the greatest, and equal to itself
        return (1, 0) if isinstance(v, float) and v != v else (0, v)

    def found(a):
        return any(all(x is not None and y is not None and how[op](place(x), place(y)) for op, x, y in zip(ops, a, b, strict=True)) for b in right)

    assert sorted(map(str, out)) == sorted(map(str, [type(out[0])(__l0=a[0], __l1=a[1], __l2=a[2], found=found(a)) for a in left]))
