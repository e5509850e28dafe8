"""Local regression by vertices against fits at each point."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewright.models import smooth, vertices
from tidewright.models.smooth import local_fit, loess, stat_smooth
from tidewright.models.vertices import LocalSurface, loess_fit
from tidewright.operators import ranges
from tidewright.operators.frame import Frame


@pytest.fixture(scope="module")
def wave(spark):
    rng = np.random.default_rng(7)
    x = np.round(rng.gamma(2.0, 2.0, 20_000), 3)
    y = np.sin(x) + x / 4 + rng.normal(0, 0.3, len(x))
    pdf = pd.DataFrame({"i": np.arange(len(x)), "u": x, "v": y})
    return pdf, Frame(spark.createDataFrame(pdf))


@pytest.mark.parametrize(("span", "degree"), [(0.75, 2), (0.3, 1)])
def test_blended_fits_equal_direct_ones(wave, span, degree):
    pdf, frame = wave
    out = loess_fit(frame, "u", "v", span=span, degree=degree).df.where("i % 400 = 0").orderBy("i").toPandas()
    direct = local_fit(pdf["u"].to_numpy(), pdf["v"].to_numpy(), out["u"].to_numpy(), span, degree)
    assert np.abs(out[".fitted"] - direct).max() < 1e-3 * np.ptp(direct)
    assert np.allclose(out[".resid"], out["v"] - out[".fitted"])


def test_points_as_vertices_are_exact(wave):
    pdf, frame = wave
    for span, degree in ((0.5, 2), (0.2, 0), (1.5, 1)):
        out = stat_smooth(frame, "u", "v", n=9, span=span, degree=degree, surface="direct", most_rows=100).df.orderBy("x").toPandas()
        assert np.allclose(out["y"], local_fit(pdf["u"].to_numpy(), pdf["v"].to_numpy(), np.linspace(pdf["u"].min(), pdf["u"].max(), 9), span, degree), atol=1e-8)


def test_robust_fits(wave):
    pdf, frame = wave
    some = pdf.head(1500).copy()
    some.loc[some["i"] % 10 == 0, "v"] += 40
    rows = Frame(frame.df.sparkSession.createDataFrame(some))
    out = stat_smooth(rows, "u", "v", n=7, span=0.5, degree=1, family="symmetric", most_rows=10).df.orderBy("x").toPandas()
    x, y = some["u"].to_numpy(), some["v"].to_numpy()
    assert np.abs(out["y"] - loess(x, y, out["x"].to_numpy(), 0.5, 1, "symmetric")).max() < 0.02
    assert np.abs(out["y"] - loess(x, y, out["x"].to_numpy(), 0.5, 1)).max() > 1


def test_groups_large_small_missing_and_constant(spark, monkeypatch):
    rows = [("a", float(i % 97), float((i % 97) ** 2)) for i in range(600)] + [(None, float(i), 3.0 * i) for i in range(500)]
    rows += [("b", float(i), 2.0 * i) for i in range(30)] + [("c", 5.0, float(i % 2)) for i in range(400)] + [("b", None, 1.0), ("b", 1.0, None), ("b", float("nan"), 1.0), ("d", None, None)]
    frame = Frame(spark.createDataFrame(rows, "g string, u double, v double"))
    for most in (vertices.MOST_BROADCAST, 0):  # broadcast, then salted
        monkeypatch.setattr(vertices, "MOST_BROADCAST", most)
        out = stat_smooth(frame, "u", "v", ["g"], n=5, most_rows=100).df.toPandas()
        a, nothing, b, c = (out[out["g"].isna()] if g is None else out[out["g"] == g] for g in ("a", None, "b", "c"))
        assert np.allclose(a["y"], a["x"] ** 2, atol=1e-6) and np.allclose(nothing["y"], 3 * nothing["x"]) and np.allclose(b["y"], 2 * b["x"])
        assert len(nothing) == 5 and len(b) == 5 and np.allclose(c["y"], 0.5) and set(out["g"].dropna()) == {"a", "b", "c"}
    fitted = loess_fit(frame, "u", "v", ["g"]).df
    assert fitted.count() == len(rows) and fitted.where("g = 'd' AND `.fitted` IS NOT NULL").isEmpty()
    assert fitted.where(F.col("g").isNull()).agg(F.max(F.abs("`.resid`"))).first()[0] < 1e-6


def test_no_rows_and_wrong_arguments(spark):
    empty = Frame(spark.createDataFrame([], "g string, u double, v double"))
    assert stat_smooth(empty, "u", "v", ["g"]).df.isEmpty() and loess_fit(empty, "u", "v").df.isEmpty()
    with pytest.raises(ValueError, match="degree"):
        LocalSurface(empty.df.toDF("g", "x", "y"), [], degree=3)
    with pytest.raises(ValueError, match="key"):
        stat_smooth(Frame(empty.df.toDF("x", "u", "v")), "u", "v", ["x"])


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def nothing_is_small(spark):
    """Only joins that ask for it broadcast a side."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("sizes", [(600, 400), (600, 30)])
def test_large_groups_are_not_sorted_into_one_task(spark, monkeypatch, nothing_is_small, sizes):
    seen = []
    monkeypatch.setattr(smooth, "LocalSurface", lambda df, *a, **k: seen.append(plan(df)) or LocalSurface(df, *a, **k))
    rows = [(g, float(i), 3.0 * i) for g, n in zip((None, "b"), sizes, strict=True) for i in range(n)]
    out = stat_smooth(Frame(spark.createDataFrame(rows, "g string, u double, v double")), "u", "v", ["g"], n=5, surface="direct", most_rows=100).df
    assert seen and "SortMergeJoin" not in seen[0] and "SortMergeJoin" not in plan(out)
    assert out.count() == 10 and out.where("abs(y - 3 * x) > 1e-6").isEmpty()


def test_quantiles_of_few_groups_and_many(spark, monkeypatch, nothing_is_small):
    rows = [(None if i % 3 == 0 else i % 3, float(i * i % 101)) for i in range(900)] + [(7, 1.0), (8, None)]
    df = spark.createDataFrame(rows, "g int, v double")
    for most in (ranges.MOST_BROADCAST, 0):  # broadcast, then salted
        monkeypatch.setattr(ranges, "MOST_BROADCAST", most)
        made = ranges.quantiles(df, "v", [0.1, 0.5], ["g"])
        assert ("SortMergeJoin" in plan(made)) == (most == 0)
        found = {r["g"]: (r["q"], r["n"]) for r in made.collect()}
        assert set(found) == {None, 1, 2, 7}
        for g, (q, n) in found.items():
            values = [v for k, v in rows if k == g and v is not None]
            assert n == len(values) and np.allclose(q, np.quantile(values, [0.1, 0.5]))


@pytest.mark.parametrize("broadcast", [True, False])
def test_rows_beside_their_group(spark, broadcast):
    rows = spark.createDataFrame([(i % 3 or None, f"t{i % 2}", {"m": i}) for i in range(60)] + [(9, "t", None)], "g int, `a.b` string, m map<string,int>")
    groups = spark.createDataFrame([(None, 10), (1, 11), (5, 12)], "g int, w int")
    joined = [(r["g"], r["w"]) for r in ranges.beside(rows, groups, ["g"], broadcast=broadcast).collect()]
    assert sorted(joined, key=str) == sorted([(None, 10), (1, 11)] * 20, key=str)
    left = ranges.beside(rows, groups, ["g"], "left", broadcast)
    assert left.columns == ["g", "a.b", "m", "w"] and left.count() == 61 and left.where("w IS NULL").count() == 21
    semi = ranges.beside(rows, groups, ["g"], "left_semi", broadcast)
    assert semi.columns == rows.columns and semi.count() == 40
