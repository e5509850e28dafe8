"""Verbs and functions on small literal frames."""

import datetime as dt
import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewright.functions import conditionals as k
from tidewright.functions import distributions as d
from tidewright.functions import factors as fct
from tidewright.functions import stats as st
from tidewright.functions import strings as s
from tidewright.functions import window as w
from tidewright.functions.expr import col, lit, n, n_distinct
from tidewright.models import special
from tidewright.operators import joins as j
from tidewright.operators import layers
from tidewright.operators import reshape as r
from tidewright.operators.frame import Frame, cols_between, desc, exclude


def frame(spark, schema, *rows, order=()):
    return Frame(spark.createDataFrame(list(rows), schema), [(c, False) for c in order])


def got(x, *cols):
    df = x.df if not hasattr(x, "toPandas") else x
    return [tuple(row) for row in (df.select(*cols) if cols else df).collect()]


@pytest.fixture
def df(spark):
    return frame(spark, "g string, x bigint, y bigint", *[(g, i, 10 * i) for i, g in enumerate("aaabbb", 1)], order=["x"])


@pytest.fixture
def ranks(spark):
    return frame(spark, "i int, x int", *enumerate([1, 5, 5, 17, 22, None]), order=["i"])


def test_filter_mutate_select(df):
    assert got(df.filter(col("x") > 2, g="a").select("x")) == [(3,)]
    assert df.mutate(z=col("x") + 1, q=col("z") * 2).columns == ["g", "x", "y", "z", "q"]
    assert got(df.mutate(z=col("x") / 0).select("z").slice_head(1)) == [(math.inf,)]
    assert df.mutate(z=col("x") + col("y"), _keep="used").columns == ["x", "y", "z"]
    assert df.mutate(z=col("x"), _before=1).columns == ["z", "g", "x", "y"]
    assert df.select(new="x", c=3).columns == ["new", "c"]
    assert df.select(cols_between("y", "x")).columns == ["x", "y"] and df.select(exclude("g")).columns == ["x", "y"]
    assert df.relocate("y", _before="x").columns == ["g", "y", "x"] and df.relocate("g", _after="y").columns == ["x", "y", "g"]
    assert df.rename(z="x").order == [("z", False)]
    for bad in (lambda: df.drop("zzz"), lambda: df.rename(a="zzz"), lambda: df.select("zzz"), lambda: df.group_by()):
        with pytest.raises((KeyError, ValueError)):
            bad()


def test_clean_names(spark):
    f = frame(spark, "`Foo Bar` int, `fooBar` int, `2nd %` int", (1, 2, 3))
    assert f.clean_names().columns == ["foo_bar", "foo_bar_2", "x2nd_percent"]


def test_arrange_puts_missing_last(spark):
    f = frame(spark, "x double", (2.0,), (float("nan"),), (1.0,), (None,))
    up, down = [v for (v,) in got(f.arrange("x"))], [v for (v,) in got(f.arrange(desc("x")))]
    assert up[:2] == [1.0, 2.0] and down[:2] == [2.0, 1.0] and {str(v) for v in up[2:]} == {str(v) for v in down[2:]} == {"nan", "None"}


def test_groups(df):
    assert sorted(got(df.group_by("g").slice_max("y", 1).select("y"), "g", "y")) == [("a", 30), ("b", 60)]
    assert sorted(got(df.group_by("g").summarize(m=st.mean("x"), c=n()))) == [("a", 2.0, 3), ("b", 5.0, 3)]
    assert sorted(got(df.group_by("g").mutate(dev=col("x") - st.mean("x")).ungroup(), "dev")) == [(-1.0,), (-1.0,), (0.0,), (0.0,), (1.0,), (1.0,)]
    assert sorted(got(df.group_by("g").filter(col("x") == st.max_("x")).ungroup(), "x")) == [(3,), (6,)]
    assert sorted(got(df.mutate(m=st.mean("x")), "m"))[0] == (3.5,)
    assert df.group_by("g").summarize(c=n(), _groups="keep").groups() == ["g"]
    with pytest.raises(ValueError):
        df.group_by("g").drop("g")
    # grouped mutate sees the input, flat mutate what came before
    assert sorted(got(df.group_by("g").mutate(x=col("x") * 0, z=st.sum_("x")).ungroup(), "g", "z"))[0] == ("a", 6)


def test_slices(spark, df):
    tied = frame(spark, "x bigint", (1,), (1,), (2,), (5,))
    assert got(tied.slice_min("x", 1)) == [(1,), (1,)] and got(tied.slice_min("x", 1, with_ties=False)) == [(1,)]
    nothing = frame(spark, "x int", (None,), (None,))
    assert len(got(nothing.slice_max("x", 1))) == 2 and len(got(nothing.slice_max("x", 1, with_ties=False))) == 1
    null_group = frame(spark, "g string, x int", ("a", 3), ("a", 1), ("a", 2), ("b", None))
    assert sorted(got(null_group.group_by("g").slice_max("x", 1))) == [("a", 3), ("b", None)]
    assert got(df.slice_tail(2), "x") == [(5,), (6,)] and len(got(df.slice_sample(n=3, seed=1))) == 3 and len(got(df.slice_sample(prop=0.5, seed=1))) == 3
    assert got(df.with_row_index("i").arrange("i"), "i") == [(i,) for i in range(6)]


def test_rank_family(ranks, spark):
    out = got(ranks.mutate(a=w.min_rank("x"), b=w.dense_rank("x"), c=w.percent_rank("x"), d=w.cume_dist("x"), e=w.ntile("x", 3)).arrange("i"), "a", "b", "c", "d", "e")
    assert [x[0] for x in out] == [0, 1, 1, 3, 4, None] and [x[1] for x in out] == [0, 1, 1, 2, 3, None]
    assert [x[2] for x in out] == [0.0, 0.25, 0.25, 0.75, 1.0, None] and [x[3] for x in out] == [0.2, 0.6, 0.6, 0.8, 1.0, None] and [x[4] for x in out] == [0, 0, 1, 1, 2, None]
    one = frame(spark, "x int", (4,))
    assert math.isnan(got(one.mutate(p=w.percent_rank("x")), "p")[0][0])


def test_shifts(spark):
    f = frame(spark, "i int, x int", *enumerate([2, 5, 11, 11, 19, 35]), order=["i"])
    out = got(f.mutate(a=w.lag("x"), b=w.lag("x", 2, 0), c=w.lead("x", 2, -1)).arrange("i"), "a", "b", "c")
    assert [x[0] for x in out] == [None, 2, 5, 11, 11, 19] and [x[1] for x in out] == [0, 0, 2, 5, 11, 11] and [x[2] for x in out] == [11, 11, 19, 35, -1, -1]
    g = frame(spark, "t int, x string", (3, "c"), (1, "a"), (2, "b"))
    assert dict(got(g.mutate(p=w.lag("x", order_by="t")), "x", "p")) == {"a": None, "b": "a", "c": "b"}


def test_running(spark):
    gaps = frame(spark, "time int", *[(t,) for t in (0, 1, 2, 3, 5, 10, 11, 12, 14, 15, 20, 21, 24, 25)], order=["time"])
    out = got(gaps.mutate(g=w.cumsum(col("time") - w.lag("time", 1, col("time")) >= 5)).arrange("time"), "g")
    assert [x[0] for x in out] == [0] * 5 + [1] * 5 + [2] * 4
    f = frame(spark, "i int, b boolean", (0, True), (1, None), (2, True), order=["i"])
    assert [x[0] for x in got(f.mutate(a=w.cumall("b")).arrange("i"), "a")] == [True, None, None] and [x[0] for x in got(f.mutate(a=w.cumany("b")).arrange("i"), "a")] == [True] * 3
    h = frame(spark, "i int, x int", *enumerate([1, 1, 2, 2, 2, 1, 1]), order=["i"])
    assert [x[0] for x in got(h.mutate(r=w.consecutive_id("x")).arrange("i"), "r")] == [0, 0, 1, 1, 1, 2, 2]
    m = frame(spark, "i int, x double", (0, 1.0), (1, 3.0), (2, None), (3, 5.0), order=["i"])
    assert [x[0] for x in got(m.mutate(c=w.cummean("x")).arrange("i"), "c")] == [1.0, 2.0, None, None]
    assert got(m.summarize(f=w.first("x"), l=w.last("x"), t=w.nth("x", 1), miss=w.nth("x", 9, default=-1.0))) == [(1.0, 5.0, 3.0, -1.0)]
    assert [x[0] for x in got(m.fill("x").arrange("i"), "x")] == [1.0, 3.0, 3.0, 5.0]


def test_aggregates(spark):
    f = frame(spark, "x double, y double", (1.0, 2.0), (2.0, None), (None, 3.0), (4.0, 9.0))
    assert got(f.summarize(a=st.mean("x", na_rm=False), b=st.mean("x"), c=n_distinct("x"), d=st.median("x"), e=st.cov("x", "y"))) == [(None, 7 / 3, 4, 2.0, 10.5)]
    q = frame(spark, "x double", *[(float(v),) for v in (1, 2, 3, 4, 5, 7, 11, 19)])
    iqr = [got(q.summarize(i=st.IQR("x", type=t)))[0][0] for t in range(1, 10)]
    assert iqr[6] == pytest.approx(5.25) and iqr[0] == 5.0 and iqr[5] == pytest.approx(7.75)


def test_joins(spark):
    a, b = frame(spark, "g string, t int", ("a", 1), ("a", 4), ("b", 1)), frame(spark, "g string, u int, v string", ("a", 0, "x"), ("a", 3, "y"), ("b", 2, "z"))
    assert sorted(got(j.left_join(a, b, j.join_by("g", j.closest(col("t") >= col("u")))), "g", "t", "v")) == [("a", 1, "x"), ("a", 4, "y"), ("b", 1, None)]
    t, u = frame(spark, "t int", (1,), (3,), (5,), (7,)), frame(spark, "u int", (2,), (4,), (8,))
    assert sorted(got(j.left_join(t, u, j.join_by(j.closest(col("t") <= col("u")))))) == [(1, 2), (3, 4), (5, 8), (7, 8)]
    people = frame(spark, "id int, name string", *enumerate("abcd"))
    other = people.rename(id2="id")
    assert len(got(j.inner_join(people, other, j.join_by(col("id") < col("id2"))))) == 6
    assert j.inner_join(people, other, j.join_by(col("id") < col("id2"))).columns == ["id", "name.x", "id2", "name.y"]
    na, nb = frame(spark, "k int, x int", (None, 1), (1, 2)), frame(spark, "k int, y int", (None, 7), (1, 8))
    assert len(got(j.inner_join(na, nb, "k"))) == 2 and len(got(j.inner_join(na, nb, "k", na_matches="never"))) == 1
    assert sorted(got(j.full_join(na.filter(col("x") == 2), nb, "k")), key=str) == [(1, 2, 8), (None, None, 7)]
    with pytest.raises(TypeError):
        j.inner_join(frame(spark, "k string", ("1",)), frame(spark, "k int", (1,)), "k")
    wide = j.inner_join(frame(spark, "k bigint", (1,)), frame(spark, "k double, z int", (1.0, 5)), "k")
    assert got(wide, "z") == [(5,)]
    iv, jv = frame(spark, "n string, a int, b int", ("A", 10, 12), ("B", 20, 50)), frame(spark, "m string, c int, d int", ("x", 0, 15), ("y", 0, 100))
    assert sorted(got(j.inner_join(iv, jv, j.join_by(j.within("a", "b", "c", "d"))), "n", "m")) == [("A", "x"), ("A", "y"), ("B", "y")]
    assert sorted(got(j.range_join(iv, jv, ("a", "b"), ("c", "d"), 7), "n", "m")) == [("A", "x"), ("A", "y"), ("B", "y")]
    with pytest.raises(ValueError):
        j.inner_join(na, nb.filter(col("y") == 8), "k", unmatched="error")


def test_reshape(spark):
    bp = frame(spark, "id string, bp1 int, bp2 int", ("A", 1, 2), ("B", 3, 4), ("C", 5, 6))
    long = r.pivot_longer(bp, ["bp1", "bp2"], "measurement", "value")
    assert [x[0] for x in got(long, "id")] == list("AABBCC")
    assert sorted(got(r.pivot_wider(long, id_cols="id", names_from="measurement", values_from="value"), "id", "bp1", "bp2")) == [("A", 1, 2), ("B", 3, 4), ("C", 5, 6)]
    weeks = frame(spark, "id int, wk1 int, wk2 int", (1, 5, 6))
    assert [x[0] for x in got(r.pivot_longer(weeks, ["wk1", "wk2"], names_prefix="wk"), "name")] == ["1", "2"]
    house = frame(spark, "family int, name_child1 string, name_child2 string, dob_child1 string, dob_child2 string", (1, "S", "J", "d1", "d2"), (2, "M", None, "d3", None))
    out = r.pivot_longer(house, exclude("family"), names_to=[".value", "child"], names_sep="_", values_drop_na=True)
    assert sorted(got(out)) == [(1, "child1", "S", "d1"), (1, "child2", "J", "d2"), (2, "child1", "M", "d3")]
    sparse = frame(spark, "id int, k string, v int", (1, "a", 1), (2, "b", 2))
    assert sorted(got(r.pivot_wider(sparse, names_from="k", values_from="v", values_fill=0), "id", "a", "b")) == [(1, 1, 0), (2, 0, 2)]
    with pytest.warns(UserWarning):
        twice = r.pivot_wider(frame(spark, "id int, k string, v int", (1, "a", 1), (1, "a", 2)), names_from="k", values_from="v")
    assert sorted(got(twice, "a")[0][0]) == [1, 2]
    assert got(r.expand_grid(spark, x=[1, 2], y=[5, 6])) == [(1, 5), (2, 5), (1, 6), (2, 6)]


def test_tables(spark):
    f = frame(spark, "a string, b string", ("x", "p"), ("x", "q"), ("y", "p"), ("x", None))
    assert got(r.table(f, "a", "b")) == [("x", 1, 1), ("y", 1, 0)]
    assert sorted(got(r.addmargins(r.table(f, "a", "b")))) == [("Sum", 2, 1, 3), ("x", 1, 1, 2), ("y", 1, 0, 1)]
    assert got(r.prop_table(r.table(f, "a", "b"), 1)) == [("x", 0.5, 0.5), ("y", 1.0, 0.0)]


def test_strings_and_dates(spark):
    f = frame(spark, "age string", ("25",), ("five",), ("30 yo",), ("$1,234.56",), ("12.5",), (None,))
    assert [x[0] for x in got(f.mutate(v=s.parse_number("age")), "v")] == [25.0, None, 30.0, 1234.56, 12.5, None]
    g = frame(spark, "t string", ("1.2",), ("1e3",), ("-0.5",), ("$1.99",), ("1,234",), ("",), ("1.5d",))
    assert [x[0] for x in got(g.mutate(v=s.parse_double("t")), "v")] == [1.2, 1000.0, -0.5, None, None, None, None]
    h = frame(spark, "x string, y string", ("a-b c1d", "hello"), (None, "w"))
    out = got(h.mutate(t=s.str_to_title("x"), c=s.str_c(col("x"), col("y"), sep="_"), g=s.str_glue("<{y}>"), b=s.str_sub("y", -3, -1)), "t", "c", "g", "b")
    assert out == [("A-B C1D", "a-b c1d_hello", "<hello>", "ll"), (None, None, "<w>", "")]
    z = frame(spark, "d string", ("2024-03-05",), ("2024/3/5",), ("20240305",), (None,))
    assert [x[0] for x in got(z.mutate(v=s.ymd("d")), "v")] == [dt.date(2024, 3, 5)] * 3 + [None]
    assert got(frame(spark, "d string", ("March 5th, 2024",)).mutate(v=s.mdy("d")), "v") == [(dt.date(2024, 3, 5),)]
    with pytest.raises(Exception, match="not a date"):
        got(frame(spark, "d string", ("soon",)).mutate(v=s.ymd("d")), "v")


def test_conditionals_and_math(spark):
    f = frame(spark, "x double", (2.5,), (-1.0,), (0.0,), (None,))
    out = got(f.mutate(r=k.round_("x"), l=k.log("x"), i=k.if_else(col("x") > 0, "p", "n", "?"), t=k.trunc("x")), "r", "l", "i", "t")
    assert [o[0] for o in out] == [2.0, -1.0, 0.0, None] and out[2][1] == -math.inf and math.isnan(out[1][1]) and [o[2] for o in out] == ["p", "n", "n", "?"] and out[1][3] == -1.0
    assert got(f.mutate(c=k.cut("x", [-1, 0, 3], include_lowest=True)), "c") == [("(0,3]",), ("[-1,0]",), ("[-1,0]",), (None,)]
    assert got(f.filter(col("x").is_in([0.0, st.max_("x")])), "x") == [(2.5,), (0.0,)]


def test_factors(spark):
    f = frame(spark, "c string, v int", ("b", 1), ("a", 9), ("a", 8), ("c", 2), ("c", 3), ("c", 1))
    assert fct.levels(fct.factor(f, "c"), "c") == ["a", "b", "c"] and fct.levels(fct.fct_infreq(f, "c"), "c") == ["c", "a", "b"]
    assert fct.levels(fct.fct_reorder(f, "c", "v"), "c") == ["b", "c", "a"] and fct.levels(fct.fct_rev(f, "c"), "c") == ["c", "b", "a"]
    lumped = fct.fct_lump_n(f, "c", 1)
    assert fct.levels(lumped, "c") == ["c", "Other"] and sorted(got(lumped.count("c"))) == [("Other", 3), ("c", 3)]
    ordered = fct.ordered(f, "c", ["c", "a", "b"])
    assert [x[0] for x in got(ordered.arrange("c", "v"), "c")] == ["c", "c", "c", "a", "a", "b"]
    assert sorted(got(fct.fct_recode(f, "c", z="a"), "c")) == [("b",), ("c",), ("c",), ("c",), ("z",), ("z",)]


def test_distributions(spark):
    f = frame(spark, "x double", (0.3,))
    made = f.mutate(
        a=d.pnorm("x"), b=d.qnorm("x"), c=d.pt("x", 5), e=d.qt("x", 5), f=d.pchisq("x", 3), g=d.qchisq("x", 3), h=d.pf("x", 3, 7), i=d.pbeta("x", 2, 3), j=d.pgamma("x", 2, 3), k=d.ppois("x", 2.0), l=d.qbinom("x", 10, 0.4), m=d.dbinom(lit(4), 10, 0.4)
    )
    out = got(made, *"abcefghijklm")[0]
    wanted = [0.6179114222, -0.5244005127, 0.6118955, -0.5594296, 0.0400284845, 1.4236522430, 0.1754, 0.3483, 0.2275, 0.1353352832, 3.0, 0.2508226560]
    assert out == pytest.approx(wanted, rel=2e-3)
    assert out[:2] == pytest.approx(wanted[:2], rel=1e-9)


def test_set_operations_and_sql(df):
    assert sorted(got(r.intersect(df.select("g"), df.filter(g="a").select("g")))) == [("a",)] and sorted(got(r.setdiff(df.select("g"), df.filter(g="a").select("g")))) == [("b",)]
    assert got(df.sql("select sum(x) as s from self")) == [(21,)]
    assert got(r.colSums(df.select("x", "y"))) == [(21, 210)]
    assert {row[0]: row[1] for row in got(r.corr(df.select("x", "y")), "column", "y")} == {"x": pytest.approx(1.0), "y": pytest.approx(1.0)}
    assert got(r.describe(df.select("x")).filter(statistic="50%"), "x") == [(3.5,)]
    assert df.df.select(F.lit(1)).count() == 6


def test_surface(spark, df):
    import tidewright.operators.surface  # noqa: F401

    nulls = frame(spark, "i int, x double, s string", (0, 1.0, "a"), (1, None, None), (2, 3.0, "c"), (3, float("nan"), "d"), order=["i"])
    assert got(nulls.fill_null(0.0).fill_nan(-1.0).arrange("i"), "x") == [(1.0,), (0.0,), (3.0,), (-1.0,)]
    assert [x[0] for x in got(nulls.drop_nans().interpolate("x").arrange("i"), "x")] == [1.0, 2.0, 3.0]
    assert got(nulls.null_count(), "x", "s") == [(1, 1)] and got(nulls.fill_null(strategy="forward").arrange("i"), "s") == [("a",), ("a",), ("c",), ("d",)]
    assert got(df.gather_every(2).arrange("x"), "x") == [(1,), (3,), (5,)] and got(df.reverse(), "x")[0] == (6,) and got(df.slice(1, 2), "x") == [(2,), (3,)]
    assert got(df.top_k(2, "x").arrange("x"), "x") == [(5,), (6,)] and got(df.quantile(0.5), "x") == [(4,)]
    assert got(df.unique("g", keep="last").arrange("x"), "x") == [(3,), (6,)] and got(df.with_columns(x=col("x") * 0, z=col("x")).arrange("z"), "x", "z")[0] == (0, 1)
    assert df.equals(df.reverse()) and not df.equals(df.filter(g="a")) and len(df.partition_by("g")) == 2
    lists = Frame(spark.createDataFrame([(1, [1, 2], ["x", "y"]), (2, [], [])], "i int, a array<int>, b array<string>"))
    assert sorted(got(lists.explode("a", "b")), key=str) == [(1, 1, "x"), (1, 2, "y"), (2, None, None)]
    assert df.insert_column(1, "k", lit(1)).columns == ["g", "k", "x", "y"] and got(df.sum()) == [(21, 210)] and df.clear().nrow() == 0


def test_io(spark, tmp_path):
    from tidewright.sources import io

    inline = io.read_csv(spark, "# c\na,b\n1,x\nNA,y\n", comment="#")
    assert got(inline) == [(1, "x"), (None, "y")] or [tuple(map(str, t)) for t in got(inline)] == [("1", "x"), ("None", "y")]
    f = frame(spark, "a int, b string", (1, "x"), (2, None))
    io.write_parquet(f, str(tmp_path / "p"))
    io.write_csv(f, str(tmp_path / "c"))
    io.write_ndjson(f, str(tmp_path / "j"))
    assert sorted(got(io.read_parquet(spark, str(tmp_path / "p"), "a"))) == [(1, "x"), (2, None)] and io.read_parquet_schema(spark, str(tmp_path / "p")) == {"a": "int", "b": "string"}
    assert sorted(got(io.read_csv(spark, str(tmp_path / "c"), schema="a int, b string"), "a")) == [(1,), (2,)] and sorted(got(io.read_ndjson(spark, str(tmp_path / "j")), "a")) == [(1,), (2,)]
    assert got(io.ts(spark, [5, 6], 2000, 12), "value") == [(5.0,), (6.0,)] and sorted(got(io.from_dict(spark, {"u": [1, 2]}))) == [(1,), (2,)]


def test_streams(spark, tmp_path):
    from tidewright.functions.expr import n as size
    from tidewright.streaming import windows

    rows = [(dt.datetime(2024, 1, 1, 0, m), "a" if m % 2 else "b", 1.0) for m in range(0, 60, 7)]
    spark.createDataFrame(rows, "t timestamp, k string, v double").write.parquet(str(tmp_path / "in"))
    stream = windows.stream_parquet(spark, str(tmp_path / "in"), "t timestamp, k string, v double")
    made = windows.windowed_summary(stream, "t", "30 minutes", "10 minutes", ["k"], c=size())
    q = made.writeStream.format("memory").queryName("made").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    batch = windows.windowed_summary(spark.read.parquet(str(tmp_path / "in")), "t", "30 minutes", "10 minutes", ["k"], c=size())
    assert sorted(map(tuple, spark.table("made").collect())) == sorted(map(tuple, batch.collect())) and sum(r["c"] for r in batch.collect()) == len(rows)


def test_vectors_and_summary(spark, df):
    from tidewright.functions import vectors as v
    from tidewright.operators.summary import format_pval, significance_code, summary

    assert v.seq(3) == [0, 1, 2] and v.seq(1, 3) == [1, 2, 3] and v.seq(0, 1, by=0.25) == [0, 0.25, 0.5, 0.75, 1] and v.seq(0, 1, length_out=3) == [0, 0.5, 1]
    assert v.rep([1, 2], 2) == [1, 2, 1, 2] and v.rep([1, 2], each=2) == [1, 1, 2, 2] and v.rep([1, 2], [2, 1]) == [1, 1, 2] and v.rep(7, length_out=3) == [7, 7, 7]
    v.set_seed(1)
    assert sorted(v.sample(5)) == [1, 2, 3, 4, 5] and len(v.sample("abc", 2)) == 2 and v.sample([1, 2], 1, prob=[0, 1]) == [2]
    assert got(v.unique(df, "g")) == [("a",), ("b",)] and got(v.order(df, "y", decreasing=True))[0] == (5,) and sorted(got(v.which(df, col("x") > 4))) == [(4,), (5,)]
    assert v.which_max(df, "x") == 5 and v.which_min(df, "x") == 0 and v.resolution(df, "y") == 10 and got(v.sweep(df, ["x"], [1]), "x")[0] == (0,)
    f = fct.factor(frame(spark, "g string, b boolean, d date, x double", ("u", True, dt.date(2024, 1, 1), 1.0), ("u", False, dt.date(2024, 1, 3), None), ("w", None, None, 3.0)), "g")
    s_ = summary(f)
    assert dict(s_.blocks["g"]) == {"u": 2, "w": 1} and dict(s_.blocks["b"]) == {"FALSE": 1, "TRUE": 1, "NA's": 1} and dict(s_.blocks["x"])["Median"] == 2.0 and dict(s_.blocks["d"])["Max."] == dt.date(2024, 1, 3)
    assert "Median" in repr(s_) and significance_code(0.003) == "**" and format_pval(1e-20).startswith("<")


def test_many_levels_raise(spark):
    many = Frame(spark.range(10_001).selectExpr("'a' AS x", "id AS y"))
    for f in (lambda: r.xtabs(many, None, "x", "y"), lambda: r.table(many, "x", "y")):
        with pytest.raises(ValueError, match="more than 10000"):
            f()


def test_stat_summary_of_many_sizes(spark):
    data = spark.range(2, 10_003, 1, 8).selectExpr("id AS g", "explode(sequence(1, id)) AS y")
    out = layers.stat_summary(Frame(data), "g", "y", "mean_cl_normal").df.cache()
    assert out.count() == 10_001 and out.where("ymin is null or ymax is null or isnan(ymin)").isEmpty()
    for x in out.where("g in (2, 3, 10002)").collect():
        assert x["ymax"] - x["y"] == pytest.approx(special.qt(0.975, x["g"] - 1) * math.sqrt((x["g"] + 1) / 12))


def test_many_dummies_raise(spark):
    ids = Frame(spark.range(1001).selectExpr("id AS x"))
    with pytest.raises(ValueError, match="more than 1000"):
        r.to_dummies(ids, "x")
    assert len(r.to_dummies(ids.filter(col("x") < 1000), "x").columns) == 1000


def test_row_index_of_whole_tables(spark):
    """All rows and columns come back, with every place once, at a size where range bounds are sampled."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        orders = Frame.parquet(spark, "/root/testdata/sf0.1/orders.parquet", "o_orderkey")
        n = orders.nrow()
        indexed = orders.with_row_index("at")
        found = indexed.df.agg(F.count("*"), F.countDistinct("at"), F.min("at"), F.max("at"), F.countDistinct("o_orderkey")).first()
        assert tuple(found) == (n, n, 0, n - 1, n) and indexed.columns == ["at", *orders.columns]
        w = Window.orderBy("o_orderkey")
        assert indexed.df.withColumn("n", F.row_number().over(w) - 1).where("n <> at").isEmpty()
        assert orders.gather_every(7).df.count() == -(-n // 7)
        bound = r.cbind(orders.select("o_orderkey", "o_totalprice"), orders.select("o_orderkey", "o_orderdate").rename(key="o_orderkey", date="o_orderdate"))
        assert bound.df.where("o_orderkey = key").count() == n
        shifted = orders.shift(1).df
        assert shifted.count() == n and shifted.where("o_custkey is null").count() == 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_ranges(spark):
    from tidewright.functions import vectors
    from tidewright.operators import ranges

    rows = [(i % 3, float((i * 37) % 101)) for i in range(1000)] + [(None, 5.0), (None, 9.0), (1, None)]
    df = spark.createDataFrame(rows, "g int, v double")
    q = {r["g"]: (list(r["q"]), r["n"]) for r in ranges.quantiles(df, "v", (0.0, 0.1, 0.5, 1.0), ("g",)).collect()}
    wanted = {r["g"]: (list(r["q"]), r["n"]) for r in df.groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, (0.0, 0.1, 0.5, 1.0)))).alias("q"), F.count("v").alias("n")).collect()}
    assert q == wanted
    summed = ranges.running_sums(df.where("v is not null"), ["v"], F.col("v"), F.col("g")).agg(F.max("__before_v")).first()[0]
    assert summed == sum(v for _, v in rows if v is not None) - 100.0
    assert vectors.resolution(Frame(df), "v") == 1.0
    assert ranges.least_gap(df.limit(1), "v") is None


def test_relocate_anchor_among_movers_raises(spark):
    frame = Frame(spark.createDataFrame([(1, 2, 3)], "a int, b int, c int"))
    with pytest.raises(ValueError):
        frame.relocate("a", "b", _before="a")
    assert frame.relocate("a", _after="b").columns == ["b", "a", "c"]
    assert frame.mutate(b=col("a") + 1, _before="a").columns == ["b", "a", "c"]


def test_quantile_plot_goes_by_the_number_of_rows(spark):
    from tidewright.functions.distributions import pnorm
    from tidewright.operators import layers

    made = layers.stat_qq(Frame(spark.range(1000).select(F.col("id").cast("double").alias("v"))), "v").mutate(p=pnorm("theoretical"))
    assert all(abs(r["p"] - (r["sample"] + 0.5) / 1000) < 1e-6 for r in made.df.collect())


def test_dates_are_tried_by_formats_of_their_shape(spark):
    """Every format reads what it wrote, with the clock and without, and the shapes of others keep them out."""
    import datetime as dt
    import re

    from tidewright.functions import strings

    at = spark.sql("SELECT explode(sequence(timestamp'2023-12-28 23:01:02', timestamp'2024-10-15 00:00:00', interval 37 days)) AS t")
    for order, formats in strings._DATES.items():
        for clock in (None, "H:m:s", "H:m"):
            parse = getattr(strings, order if clock is None else f"{order}_{'hms' if clock == 'H:m:s' else 'hm'}")
            texts = at.select("t", F.explode(F.array(*[F.date_format("t", f if clock is None else f"{f} {clock}") for f in formats])).alias("d"))
            wanted = F.col("t").cast("date") if clock is None else F.col("t").cast("timestamp_ntz") if clock == "H:m:s" else F.date_trunc("minute", "t").cast("timestamp_ntz")
            assert Frame(texts).mutate(v=parse("d")).df.where(~F.col("v").eqNullSafe(wanted)).isEmpty()
        assert [f for f in formats if re.match(strings._shape(f), "3/5/2024")] == [f for f in formats if "/" in f]
    odd = Frame(spark.createDataFrame([("20240305",), ("2024 Mar 5",), ("2024-13-01",), ("soon",), ("",), (None,), ("2024-3-5 x",), ("12024-03-05",)], "d string"))
    assert [r["v"] for r in odd.mutate(v=strings.ymd("d", quiet=True)).df.collect()] == [dt.date(2024, 3, 5)] * 2 + [None] * 6


def test_panels_of_a_grid_are_broadcast(spark):
    """Rows aren't sorted by their panel, which would put those of a large one into one task."""
    from tidewright.operators import layers

    rows = Frame(spark.range(1000).selectExpr("id", "nullif(id % 3, 0) AS g", "id % 2 AS h"))
    made = layers.facet_grid(rows, "g", "h").df
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    assert made.where("panel <> coalesce(g, 0) * 2 + h + 1").isEmpty() and made.count() == 1000


@pytest.fixture
def nothing_is_small(spark):
    """Only joins that ask for it broadcast a side."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_layers_of_few_groups_and_many(spark, monkeypatch, nothing_is_small):
    """Rows aren't sorted by their group: what is known of few groups is broadcast, rows of many are salted."""
    import numpy as np

    from tidewright.operators import build as b
    from tidewright.operators import layers, ranges

    values = [("abc"[i % 3] if i % 3 else None, float(i * i % 89)) for i in range(600)]
    frame = Frame(spark.createDataFrame(values, "g string, v double"))
    named = Frame(frame.df.where("g IS NOT NULL"))
    made, wanted = [], [v for g, v in values if g == "b"]
    for most in (ranges.MOST_BROADCAST, 0):
        monkeypatch.setattr(ranges, "MOST_BROADCAST", most)
        built = b.build(b.ggplot(named, x="v", fill="g").add(b.Layer("density", params={"n": 16}))).layers[0].df
        violins = layers.stat_ydensity(frame, "g", "v", bw=5.0, n=9, exact=True).df
        ridges = layers.stat_density_ridges(frame, "v", "g", bandwidth=5.0, n=9, exact=True).df
        boxes = layers.stat_boxplot(frame, "v", ["g"]).df
        places = layers.stat_ecdf(frame, "v", ["g"]).df
        frames = [(built, ["fill", "x"]), (violins, ["g", "v"]), (ridges, ["g", "v"]), (boxes, ["g"]), (places, ["g", "ecdf"])]
        for df, _ in frames[1:] if most else ():
            assert "SortMergeJoin" not in df._jdf.queryExecution().executedPlan().toString()
        assert ("SortMergeJoin" in built._jdf.queryExecution().executedPlan().toString()) == (most == 0)
        made.append([df.orderBy(*order).toPandas() for df, order in frames])
    for few, many in zip(*made, strict=True):
        assert len(few) == len(many) > 0
        for c in few.columns:
            same = np.allclose(few[c], many[c]) if few[c].dtype.kind in "if" else few[c].astype(str).equals(many[c].astype(str))
            assert same, c
    violin = made[0][1][made[0][1]["g"] == "b"]
    z = (violin["v"].to_numpy()[:, None] - np.array(wanted)) / 5.0
    assert len(violin) == 9 and np.allclose(violin["density"], np.exp(-z * z / 2).sum(1) / (len(wanted) * 5.0 * np.sqrt(2 * np.pi)))
    box = made[0][3].set_index("g").loc["b"]
    assert np.allclose([box["lower"], box["middle"], box["upper"]], np.quantile(wanted, [0.25, 0.5, 0.75])) and box["n"] == 200
    assert made[0][4]["g"].isna().sum() == 200 and len(made[0][4]) == 600
