"""Functions of a whole frame in order, over range partitions, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from tidewright.functions import window as w
from tidewright.functions.expr import col
from tidewright.operators import joins as j
from tidewright.operators.frame import Frame


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    return [(i, None if rng.random() < 0.4 else rng.randrange(-9, 10), rng.choice("ab")) for i in range(300)]


@pytest.fixture
def frame(spark, rows):
    """300 rows in many small range partitions, some of them shorter than the shifts."""
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    shuffled = rows[:]
    random.Random(5).shuffle(shuffled)
    yield Frame(spark.createDataFrame(shuffled, "i int, x int, g string"), [("i", False)])
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def column(made, name="v"):
    return [r[0] for r in made.df.orderBy("i").select(name).collect()]


def partitionless(made):
    """Windows without a partition that read more than one row for each range partition."""
    plan = made.df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Window [" in line and "__scan_p#" not in line and "__scan_i#" not in line]


def test_running_values(frame, rows):
    made = frame.mutate(s=w.cumsum("x"), hi=w.cummax("x"), lo=w.cummin("x"), up=w.fill_forward("x"), down=w.fill_backward("x"), at=w.row_number(), all_=w.cumall(col("x") > -9), any_=w.cumany(col("x") > 8))
    assert not partitionless(made)
    total, high, low, last = 0, None, None, None
    ahead = [None] * 301
    for i in range(299, -1, -1):
        ahead[i] = rows[i][1] if rows[i][1] is not None else ahead[i + 1]
    every, some, unknown = True, False, False
    for (i, x, _), r in zip(rows, made.df.orderBy("i").collect(), strict=True):
        if x is not None:
            total, high, low, last = total + x, x if high is None else max(high, x), x if low is None else min(low, x), x
            every, some = every and x > -9, some or x > 8
        unknown = unknown or x is None
        known = x is not None
        assert (r["s"], r["hi"], r["lo"]) == ((total, high, low) if known else (None, None, None))
        assert (r["up"], r["down"], r["at"]) == (last, ahead[i], i)
        assert r["all_"] == (False if not every else None if unknown else True)
        assert r["any_"] == (True if some else None if unknown else False)


def test_products_and_means(frame, rows):
    made = frame.mutate(y=col("x").fill_null(1)).mutate(p=w.cumprod(1 + col("i") / 1000.0), m=w.cummean("y"), n=w.cummean("x"))
    p, total, null = 1.0, 0, False
    for (i, x, _), r in zip(rows, made.df.orderBy("i").collect(), strict=True):
        p, total, null = p * (1 + i / 1000.0), total + (1 if x is None else x), null or x is None
        assert r["p"] == pytest.approx(p) and r["m"] == pytest.approx(total / (i + 1))
        assert (r["n"] is None) == null


@pytest.mark.parametrize("k", [1, 40])
def test_shifts_longer_than_partitions(frame, rows, k):
    made = frame.mutate(b=w.lead("x", k), c=w.lag("x", k, default=77))
    values = [x for _, x, _ in rows]
    for i, r in enumerate(made.df.orderBy("i").collect()):
        before, behind = i - k, i + k
        assert r["c"] == (values[before] if before >= 0 else 77)
        assert r["b"] == (values[behind] if behind < 300 else None)


def test_shift_in_another_order(frame, rows):
    made = frame.mutate(v=w.lag("i", 1, order_by=-col("i")), s=w.cumsum(col("i")))
    assert column(made) == [*range(1, 300), None]
    assert column(made, "s") == [i * (i + 1) // 2 for i in range(300)]


@pytest.mark.parametrize("width", [60])
def test_rolling_means(frame, width):
    made = frame.mutate(v=w.rolling_mean(col("i") * col("i"), width))
    want = [None if i < width - 1 else sum(q * q for q in range(i - width + 1, i + 1)) / width for i in range(300)]
    assert column(made) == pytest.approx(want)


def test_runs(frame, rows):
    made, want, run = frame.mutate(v=w.consecutive_id("x", "g")), [], 0
    for i, r in enumerate(rows):
        run += i > 0 and r[1:] != rows[i - 1][1:]
        want.append(run)
    assert column(made) == want


def test_ranks(frame, rows):
    made = frame.mutate(n=w.row_number("x"), lo=w.min_rank("x"), dense=w.dense_rank("x"), share=w.percent_rank("x"), below=w.cume_dist("x"), part=w.ntile("x", 7), mean=w.rank("x"))
    assert not partitionless(made)
    known = sorted((x, i) for i, x, _ in rows if x is not None)
    places = {i: at for at, (_, i) in enumerate(known)}
    values = [x for x, _ in known]
    size = len(values)
    short, more = divmod(size, 7)
    for (i, x, _), r in zip(rows, made.df.orderBy("i").collect(), strict=True):
        if x is None:
            assert tuple(r)[3:] == (None,) * 7
            continue
        low, same, at = values.index(x), values.count(x), places[i]
        part = at // (short + 1) if at < more * (short + 1) else more + (at - more * (short + 1)) // short
        assert (r["n"], r["lo"], r["dense"], r["part"]) == (at, low, len(set(values[:low])), part)
        assert (r["share"], r["below"], r["mean"]) == pytest.approx((low / (size - 1), (low + same) / size, low + (same + 1) / 2))


def test_few_rows_and_parts(spark):
    tiny = Frame(spark.createDataFrame([(1, 5), (2, 5)], "i int, x int"), [("i", False)])
    assert column(tiny.mutate(v=w.ntile("x", 5))) == [0, 1]
    none = Frame(spark.createDataFrame([], "i int, x int"), [("i", False)])
    made = none.mutate(a=w.cumsum("x"), b=w.lag("x"), c=w.rolling_mean("x", 3), d=w.min_rank("x"), e=w.fill_backward("x"), f=w.consecutive_id("x"))
    assert made.columns == ["i", "x", "a", "b", "c", "d", "e", "f"] and made.df.count() == 0


def test_helper_columns_of_the_frame(frame):
    """Columns called like those of range partitions stay as they are."""
    made = frame.mutate(__p=col("i") + 1, __i=col("i") + 2).mutate(s=w.cumsum("i"), v=w.lag("__p"), at=w.row_number())
    assert [tuple(r) for r in made.df.orderBy("i").select("__p", "__i", "v", "at").take(3)] == [(1, 2, None, 0), (2, 3, 1, 1), (3, 4, 2, 2)]


def test_order_column_replaced(frame):
    """The written order no longer holds once its key is another."""
    made = frame.mutate(s=w.cumsum("i"), i=-col("i"), at=w.row_number())
    assert [r["at"] for r in made.df.orderBy(F.col("i")).collect()] == list(range(300))


@pytest.mark.parametrize(("op", "pick"), [(">=", lambda t, ts: max((s for s in ts if s <= t), default=None)), ("<", lambda t, ts: min((s for s in ts if s > t), default=None)),
                                          ("==", lambda t, ts: min(ts, key=lambda s: (abs(s - t), s), default=None))])
def test_rolling_join_without_a_key(spark, frame, op, pick):
    times = sorted({random.Random(8).randrange(300) * 3 % 311 for _ in range(1)} | {k * k % 293 for k in range(25)})
    right = Frame(spark.createDataFrame([(t, f"r{t}") for t in times] + [(None, "none")], "t int, name string"), [("t", False)])
    ops = {">=": lambda a, b: a >= b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, "<": lambda a, b: a < b, "==": lambda a, b: a == b}
    made = j.left_join(frame, right, j.join_by(j.closest(ops[op](col("i"), col("t")))))
    assert not partitionless(made)
    assert column(made, "t") == [pick(i, times) for i in range(300)]


def test_filling_backward_takes_time_in_proportion_to_the_rows(spark):
    """A frame that reaches to the last row is gone through for each row: minutes for these."""
    import time

    rows = Frame(spark.range(0, 200_000, 1, 1).selectExpr("id AS i", "id % 2 AS g", "CASE WHEN id % 1000 = 999 THEN id END AS x"), [("i", False)])
    began = time.monotonic()
    made = rows.mutate(e=w.fill_backward("x")).df.agg(F.sum(F.col("e") - F.col("i")), F.count("e")).first()
    assert tuple(made) == (200 * 999 * 500, 200_000)
    grouped = rows.group_by("g").mutate(e=w.fill_backward("x")).df.where("g = 1").agg(F.sum(F.col("e") - F.col("i"))).first()[0]
    filled = rows.fill("x", direction="up", _by="g").df.where("g = 1").agg(F.sum(F.col("x") - F.col("i"))).first()[0]
    assert grouped == filled == 200 * 500 * 499
    assert time.monotonic() - began < 60
