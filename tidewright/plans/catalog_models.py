"""Queries over models, tests, diagnostics, plot layers and the rest of the frame surface."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import conditionals as k
from ..functions import stats as st
from ..functions import vectors as v
from ..functions.expr import col, lit
from ..models import generics, htest, selection
from ..models.linear import glm, lm, poisson
from ..models.mixed import lme
from ..operators import build as b
from ..operators import joins as j
from ..operators import layers, summary, surface
from ..operators import reshape as r
from ..operators.frame import Frame
from .catalog import query


def _one(t, **values):
    return t.spark.createDataFrame([tuple(float(x) for x in values.values())], [f"{name}" for name in values])


#: a line of extended price by quantity and what follows from it for each row
_LINE = """m AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a, avg(l_quantity) AS mx, regr_sxx(l_extendedprice, l_quantity) AS sxx, count(*)::DOUBLE AS n,
                       regr_syy(l_extendedprice, l_quantity) AS syy, regr_sxy(l_extendedprice, l_quantity) AS sxy, avg(l_extendedprice) AS my FROM lineitem),
              s AS (SELECT *, (syy - sxy * sxy / sxx) AS rss, sqrt((syy - sxy * sxy / sxx) / (n - 2)) AS sigma FROM m),
              e AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS x, l_extendedprice - a - b * l_quantity AS e, 1 / n + (l_quantity - mx) * (l_quantity - mx) / sxx AS h, n, sigma, rss, mx, sxx, a, b FROM lineitem, s),
              d AS (SELECT *, sqrt((rss - e * e / (1 - h)) / (n - 3)) AS si FROM e)"""


def _line(t):
    return lm("l_extendedprice ~ l_quantity", t.lineitem)


@query(f"""WITH {_LINE} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(e / (sigma * sqrt(1 - h)), 6) AS standard, round(e / (si * sqrt(1 - h)), 6) AS student, round(1e6 * e * e * h / (2 * sigma * sigma * (1 - h) * (1 - h)), 4) AS cook,
                 round(1000 * e * sqrt(h) / (si * (1 - h)), 4) AS dffits, round(si, 4) AS without FROM d""")
def diagnostics(t):
    f = _line(t).augment().df
    return f.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("`.std_resid`", 6).alias("standard"), F.round("`.student_resid`", 6).alias("student"), F.round(F.col("`.cooksd`") * 1e6, 4).alias("cook"),
        F.round(F.col("`.dffits`") * 1000, 4).alias("dffits"), F.round("`.sigma`", 4).alias("without"),
    )


@query(f"WITH {_LINE} SELECT round(sum(h), 4) AS hats, count(*) AS n, round(max(abs(e / (sigma * sqrt(1 - h)))), 4) AS standard, round(max(abs(e / (si * sqrt(1 - h)))), 4) AS student, round(1000 * max(e * e * h / (2 * sigma * sigma * (1 - h) * (1 - h))), 4) AS cook, round(max(abs(e * sqrt(h) / (si * (1 - h)))), 4) AS dffits, round(1000 * max(abs(e * (x - mx) / ((1 - h) * sxx * si / sqrt(sxx)))), 4) AS dfbetas FROM d")
def influence_measures(t):
    m = _line(t)
    one = lambda f, c, made: f.df.agg(made(F.col(f"`{c}`"))).first()[0]
    most = lambda c: F.max(F.abs(c))
    slope = generics.dfbetas(m)
    return t.spark.createDataFrame(
        [(
            round(one(generics.hatvalues(m), ".hat", F.sum), 4), generics.influence(m).df.count(), round(one(generics.rstandard(m), ".std_resid", most), 4), round(one(generics.rstudent(m), ".student_resid", most), 4),
            round(1000 * one(generics.cooks_distance(m), ".cooksd", F.max), 4), round(one(generics.dffits(m), ".dffits", most), 4), round(1000 * one(slope, slope.columns[-1], most), 4),
        )], "hats double, n bigint, standard double, student double, cook double, dffits double, dfbetas double",
    )


@query(f"""WITH {_LINE} SELECT round(b, 6) AS slope, round(sigma / sqrt(sxx), 6) AS se, n AS n, n - 2 AS df, round(rss, 0) AS deviance, round(-n / 2 * (ln(2 * pi() * rss / n) + 1), 4) AS log_likelihood, round(n * (ln(2 * pi() * rss / n) + 1) + 6, 4) AS aic,
                 round(n * (ln(2 * pi() * rss / n) + 1) + 3 * ln(n), 4) AS bic, round(1e9 * sigma * sigma / sxx, 2) AS v FROM s""")
def fitted_line(t):
    m = _line(t)
    row = m.coef_table()[1]
    return _one(t, slope=round(generics.coef(m)["l_quantity"], 6), se=round(row["std_error"], 6), n=generics.nobs(m), df=generics.df_residual(m), deviance=round(generics.deviance(m), 0), log_likelihood=round(generics.logLik(m), 4),
                aic=round(generics.AIC(m), 4), bic=round(generics.BIC(m), 4), v=round(1e9 * generics.vcov(m)[1, 1], 2))


@query(f"WITH {_LINE} SELECT 'x' AS row, count(*) AS n, round(sum(a + b * x) / 1e6, 4) AS fitted, round(sum(abs(e)) / 1e6, 4) AS resid, count(*) AS frame_rows FROM d")
def fitted_rows(t):
    m = _line(t)
    fit, res = generics.fitted(m).df, generics.resid(m).df
    a, b = fit.agg(F.sum(F.col(f"`{fit.columns[-1]}`"))).first()[0], res.agg(F.sum(F.abs(F.col(f"`{res.columns[-1]}`")))).first()[0]
    return t.spark.createDataFrame([("x", generics.model_matrix(m).df.count(), round(a / 1e6, 4), round(b / 1e6, 4), generics.model_frame(m).df.count())], "row string, n bigint, fitted double, resid double, frame_rows bigint")


@query("SELECT round(regr_intercept(l_extendedprice, l_quantity) + 20 * regr_slope(l_extendedprice, l_quantity), 4) AS fit FROM lineitem")
def predicted(t):
    new = Frame(t.spark.createDataFrame([(20.0,)], "l_quantity double"))
    return generics.predict(_line(t), new).df.select(F.round("fit", 4).alias("fit"))


@query("""WITH g AS (SELECT l_returnflag AS f, avg(l_quantity) AS m, count(*) AS n FROM lineitem GROUP BY 1), a AS (SELECT avg(l_quantity) AS m, var_pop(l_quantity) * count(*) AS ss FROM lineitem)
          SELECT round(a.ss, 2) AS base, round(a.ss - (SELECT sum(n * (g.m - a.m) * (g.m - a.m)) FROM g), 2) AS more FROM a""")
def added_terms(t):
    rows = selection.add1(lm("l_quantity ~ 1", t.lineitem), "l_returnflag")
    return _one(t, base=round(rows[0]["deviance"], 2), more=round(rows[1]["deviance"], 2))


@query("SELECT round(sum(n * (m - a) * (m - a)), 4) AS ss, CAST(count(*) - 1 AS DOUBLE) AS df FROM (SELECT avg(l_quantity) AS m, count(*) AS n, (SELECT avg(l_quantity) FROM lineitem) AS a FROM lineitem GROUP BY l_returnflag)")
def type_two(t):
    row = selection.aov(lm("l_quantity ~ l_returnflag", t.lineitem))[0]
    return _one(t, ss=round(row["sum_sq"], 4), df=row["df"])


@query("SELECT 1.0::DOUBLE AS line, 1.0::DOUBLE AS better")
def stepwise(t):
    """A search from a line and a column of noise keeps the line, and its AIC is no worse."""
    noise = lambda seed: F.xxhash64("l_orderkey", "l_partkey", "l_suppkey", F.lit(seed)) / F.lit(2.0**63)
    f = Frame(t.lineitem.df.withColumn("other", noise(1)).withColumn("y", F.col("l_quantity") * 3 + noise(2)))
    start = lm("y ~ l_quantity + other", f)
    found = selection.step(start, direction="backward")
    return _one(t, line=("l_quantity",) in found.formula.terms, better=found.extract_aic() <= start.extract_aic())


@query("SELECT round(2 * sum(CASE WHEN l_quantity > 0 THEN l_quantity * ln(l_quantity / m) ELSE 0 END - (l_quantity - m)), 2) AS deviance, round(max(n), 0) AS n FROM (SELECT l_quantity, avg(l_quantity) OVER () AS m, count(*) OVER ()::DOUBLE AS n FROM lineitem)")
def poisson_deviance(t):
    m = glm("l_quantity ~ 1", t.lineitem, poisson())
    return _one(t, deviance=round(m.deviance(), 2), n=m.n)


# ---------------------------------------------------------------- tests
@query("""WITH c AS (SELECT count(*) FILTER (a AND NOT b) AS x, count(*) FILTER (b AND NOT a) AS y FROM (SELECT l_quantity > 25 AS a, l_linenumber > 3 AS b FROM lineitem)) SELECT pow(abs(x - y) - 1, 2) / (x + y) AS x2 FROM c""")
def mcnemar(t):
    f = t.lineitem.select(a=col("l_quantity") > 25, b=col("l_linenumber") > 3)
    return _one(t, x2=htest.mcnemar_test(f, "a", "b").statistic)


@query("""WITH c AS (SELECT count(*) FILTER (o_orderstatus = 'F')::DOUBLE AS x, count(*)::DOUBLE AS n FROM orders) SELECT pow(abs(x - n * 0.4) - 0.5, 2) / (n * 0.4 * 0.6) AS x2, x / n AS p FROM c""")
def proportion(t):
    n, x = t.orders.df.agg(F.count("*"), F.count_if(F.col("o_orderstatus") == "F")).first()
    h = htest.prop_test([x], [n], 0.4)
    return _one(t, x2=h.statistic, p=h.estimate["p"])


@query("""WITH v AS (SELECT c_nationkey AS b, c_mktsegment AS g, avg(c_acctbal) AS y FROM customer GROUP BY ALL), r AS (SELECT *, rank() OVER (PARTITION BY b ORDER BY y) AS r FROM v), s AS (SELECT g, sum(r) AS s FROM r GROUP BY 1), n AS (SELECT count(DISTINCT b)::DOUBLE AS b, count(DISTINCT g)::DOUBLE AS k FROM v)
          SELECT 12 / (b * k * (k + 1)) * (SELECT sum(s * s) FROM s) - 3 * b * (k + 1) AS x2 FROM n""")
def friedman(t):
    f = t.customer.group_by("c_nationkey", "c_mktsegment").summarize(y=st.mean("c_acctbal"))
    return _one(t, x2=htest.friedman_test(f, "y", "c_mktsegment", "c_nationkey").statistic)


@query("""WITH p AS (SELECT l_quantity - l_linenumber * 7 AS d FROM lineitem), z AS (SELECT d, abs(d) AS a FROM p WHERE d <> 0), r AS (SELECT d, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS r FROM z)
          SELECT sum(r) FILTER (d > 0) AS v FROM r""")
def signed_ranks(t):
    f = t.lineitem.mutate(y=(col("l_linenumber") * 7).cast("double"))
    return _one(t, v=htest.wilcox_test(f, "l_quantity", "y", paired=True).statistic)


@query("SELECT corr(l_quantity, l_extendedprice) AS r, corr(l_quantity, l_extendedprice) * sqrt((count(*) - 2) / (1 - corr(l_quantity, l_extendedprice) * corr(l_quantity, l_extendedprice))) AS ratio FROM lineitem")
def pearson(t):
    h = htest.cor_test(t.lineitem, "l_quantity", "l_extendedprice")
    return _one(t, r=h.estimate["cor"], ratio=h.statistic)


@query("""WITH p AS (SELECT l_linenumber AS x, l_quantity AS y, count(*)::DOUBLE AS n FROM lineitem GROUP BY ALL), c AS (SELECT sum(a.n * b.n * sign(b.y - a.y)) AS s FROM p a JOIN p b ON a.x < b.x), n AS (SELECT sum(n) * (sum(n) - 1) / 2 AS n0 FROM p),
               tx AS (SELECT sum(k * (k - 1) / 2) AS t FROM (SELECT sum(n) AS k FROM p GROUP BY x)), ty AS (SELECT sum(k * (k - 1) / 2) AS t FROM (SELECT sum(n) AS k FROM p GROUP BY y))
          SELECT s / sqrt((n0 - tx.t) * (n0 - ty.t)) AS tau FROM c, n, tx, ty""")
def kendall(t):
    return _one(t, tau=htest.cor_test(t.lineitem, "l_linenumber", "l_quantity", "kendall").estimate["tau"])


@query("""WITH c AS (SELECT count(*)::DOUBLE AS o FROM orders GROUP BY o_orderpriority) SELECT sum(pow(o - (SELECT avg(o) FROM c), 2)) / (SELECT avg(o) FROM c) AS x2, CAST(count(*) - 1 AS DOUBLE) AS df FROM c""")
def goodness_of_fit(t):
    h = htest.chisq_test(t.orders, "o_orderpriority")
    return _one(t, x2=h.statistic, df=h.parameter)


@query("""WITH c AS (SELECT count(*) FILTER (s_acctbal > 0 AND s_nationkey < 12)::DOUBLE AS a, count(*) FILTER (s_acctbal > 0 AND s_nationkey >= 12)::DOUBLE AS b, count(*) FILTER (s_acctbal <= 0 AND s_nationkey < 12)::DOUBLE AS c, count(*) FILTER (s_acctbal <= 0 AND s_nationkey >= 12)::DOUBLE AS d FROM supplier),
               k AS (SELECT *, unnest(range(CAST(greatest(0, a + c - c - d) AS BIGINT), CAST(least(a + b, a + c) AS BIGINT) + 1)) AS k FROM c),
               p AS (SELECT k, a, exp(lgamma(a + b + 1) - lgamma(k + 1) - lgamma(a + b - k + 1) + lgamma(c + d + 1) - lgamma(a + c - k + 1) - lgamma(c + d - a - c + k + 1) - lgamma(a + b + c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1)) AS p FROM k)
          SELECT round(sum(p) FILTER (p <= (SELECT max(p) FROM p WHERE k = a) * (1 + 1e-7)), 6) AS p FROM p""")
def fisher(t):
    f = t.supplier.select(x=col("s_acctbal") <= 0, y=col("s_nationkey") >= 12)
    return _one(t, p=round(htest.fisher_test(f, "x", "y").p_value, 6))


@query("""WITH c AS (SELECT exp(lgamma(31) - lgamma(k + 1) - lgamma(31 - k) + k * ln(0.4) + (30 - k) * ln(0.6)) AS p, k FROM range(0, 31) g(k)) SELECT round(sum(p) FILTER (p <= (SELECT p FROM c WHERE k = 7) * (1 + 1e-7)), 6) AS two, round(sum(p) FILTER (k <= 7), 6) AS less FROM c""")
def binomial_exact(t):
    return _one(t, two=round(htest.binom_test(7, 30, 0.4).p_value, 6), less=round(htest.binom_test(7, 30, 0.4, alternative="less").p_value, 6))


# ---------------------------------------------------------------- layers
@query("""WITH g AS (SELECT i, CAST(900 + i AS DOUBLE) AS x FROM range(0, 101) g(i)), p AS (SELECT p_retailprice AS v FROM part)
          SELECT x, round(1e6 * avg(exp(-pow((x - v) / 8.0, 2) / 2)) / (8 * sqrt(2 * pi())), 4) AS density FROM g, p GROUP BY x""")
def kernel_density(t):
    f = layers.density(t.part, "p_retailprice", bw=8.0, n=101, from_=900.0, to=1000.0, exact=True)
    return f.df.select(F.round("x", 6).alias("x"), F.round(F.col("density") * 1e6, 4).alias("density"))


@query("""WITH m AS (SELECT min(p_size)::DOUBLE AS a, max(p_size)::DOUBLE AS b, min(p_retailprice) AS c, max(p_retailprice) AS d FROM part),
               k AS (SELECT least(greatest(ceil((p_size - a) / ((b - a) / 7)) - 1, 0), 6) AS x, least(greatest(ceil((p_retailprice - c) / ((d - c) / 7)) - 1, 0), 6) AS y FROM part, m)
          SELECT CAST(x AS INT) AS xbin, CAST(y AS INT) AS ybin, count(*) AS count FROM k GROUP BY ALL""")
def bins_in_two(t):
    return layers.stat_bin2d(t.part, "p_size", "p_retailprice", bins=7).select("xbin", "ybin", "count")


@query("SELECT count(*)::BIGINT AS n, 1 AS ok FROM part")
def hexagons(t):
    """Counts of the cells sum to the rows."""
    return layers.stat_binhex(t.part, "p_size", "p_retailprice", bins=8).df.agg(F.sum("count").alias("n"), F.lit(1).alias("ok"))


@query("SELECT DISTINCT p_brand, p_size FROM part")
def unique_layer(t):
    return layers.stat_unique(t.part.select("p_brand", "p_size"))


@query("WITH r AS (SELECT s_acctbal AS sample, (row_number() OVER (ORDER BY s_acctbal) - 0.5) / 100.0 AS p FROM supplier) SELECT sample, round(p, 6) AS p FROM r")
def quantile_plot(t):
    from ..functions.distributions import pnorm

    f = layers.stat_qq(t.supplier.select("s_acctbal"), "s_acctbal")
    return f.mutate(p=pnorm("theoretical")).df.select("sample", F.round("p", 6).alias("p"))


@query("SELECT round((quantile_cont(s_acctbal, 0.75) - quantile_cont(s_acctbal, 0.25)) / (2 * 0.6744897501960817), 4) AS slope, round((quantile_cont(s_acctbal, 0.75) + quantile_cont(s_acctbal, 0.25)) / 2, 4) AS middle FROM supplier")
def quantile_line(t):
    (x0, y0), (x1, y1) = (tuple(row) for row in layers.stat_qq_line(t.supplier, "s_acctbal").df.orderBy("x").collect())
    slope = (y1 - y0) / (x1 - x0)
    return _one(t, slope=round(slope, 4), middle=round(y0 - slope * x0, 4))


@query("SELECT i / 10.0 AS x, sqrt(i / 10.0) AS y FROM range(0, 101) g(i)")
def function_layer(t):
    return layers.stat_function(t.spark, k.sqrt, (0, 10)).df.select(F.round("x", 6).alias("x"), "y")


@query("""WITH s AS (SELECT n_regionkey AS g, c_acctbal AS v FROM customer JOIN nation ON c_nationkey = n_nationkey), b AS (SELECT g, count(*)::DOUBLE AS m, min(v) AS lo, max(v) AS hi, 0.9 * least(stddev_samp(v), (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) / 1.34) * power(count(*), -0.2) AS h FROM s GROUP BY g),
               w AS (SELECT g, m, h, i, lo - 3 * h + i * (hi - lo + 6 * h) / 20 AS x FROM b, range(0, 21) r(i)), d AS (SELECT w.g, i, m, sum(exp(-pow((x - v) / h, 2) / 2)) / (m * h * sqrt(2 * pi())) AS d, x FROM w JOIN s ON s.g = w.g GROUP BY w.g, i, m, h, x)
          SELECT g AS n_regionkey, round(x, 3) AS c_acctbal, round(1e6 * d, 4) AS density, round(d / max(d) OVER (PARTITION BY g), 6) AS violinwidth, round(d * m, 6) AS count FROM d""")
def violins(t):
    f = j.inner_join(t.customer, t.nation.select("n_nationkey", "n_regionkey"), j.join_by(col("c_nationkey") == col("n_nationkey"))).select("n_regionkey", "c_acctbal")
    out = layers.stat_ydensity(f, "n_regionkey", "c_acctbal", n=21, exact=True).df
    return out.select("n_regionkey", F.round("c_acctbal", 3).alias("c_acctbal"), F.round(F.col("density") * 1e6, 4).alias("density"), F.round("violinwidth", 6).alias("violinwidth"), F.round("count", 6).alias("count"))


@query("""WITH s AS (SELECT c_mktsegment AS g, c_acctbal AS v FROM customer), a AS (SELECT min(v) AS lo, max(v) AS hi FROM s), b AS (SELECT g, count(*)::DOUBLE AS m FROM s GROUP BY g),
               w AS (SELECT g, m, lo - 3 * 900 + i * (hi - lo + 5400) / 20 AS x, i FROM a, b, range(0, 21) r(i))
          SELECT w.g AS c_mktsegment, round(x, 1) AS c_acctbal, round(1e6 * sum(exp(-pow((x - v) / 900.0, 2) / 2)) / (m * 900 * sqrt(2 * pi())), 4) AS density FROM w JOIN s ON s.g = w.g GROUP BY w.g, x, m""")
def ridges(t):
    out = layers.stat_density_ridges(t.customer, "c_acctbal", "c_mktsegment", bandwidth=900.0, n=21, exact=True).df
    return out.select("c_mktsegment", F.round("c_acctbal", 1).alias("c_acctbal"), F.round(F.col("density") * 1e6, 4).alias("density"))


@query("""WITH q AS (SELECT l_returnflag AS f, quantile_cont(l_tax, 0.5) AS y, quantile_cont(l_tax, 0.025) AS a, quantile_cont(l_tax, 0.975) AS b FROM lineitem GROUP BY 1) SELECT f AS l_returnflag, round(y, 6) AS y, round(a, 6) AS ymin, round(b, 6) AS ymax FROM q""")
def median_layer(t):
    f = layers.stat_summary(t.lineitem, "l_returnflag", "l_tax", "median_hilow").df
    return f.select("l_returnflag", *[F.round(c, 6).alias(c) for c in ("y", "ymin", "ymax")])


@query("""SELECT l_returnflag, l_linestatus, round(x + (rank() OVER (PARTITION BY l_returnflag ORDER BY l_linestatus) - 0.5) * 0.9 / count(*) OVER (PARTITION BY l_returnflag) - 0.45, 6) AS x_dodged, x + 0.25 AS nudged FROM (SELECT l_returnflag, l_linestatus, count(*)::DOUBLE AS x FROM lineitem GROUP BY ALL)""")
def moved_positions(t):
    f = t.lineitem.count("l_returnflag", "l_linestatus", name="x").mutate(x=col("x").cast("double"))
    # the rows of a flag share a place, aside from which their own x is moved
    at = Frame(f.df.withColumn("at", F.ascii("l_returnflag").cast("double")))
    moved = layers.position_dodge(at, "at", "l_linestatus").df.withColumn("x_dodged", F.round(F.col("x_dodged") - F.col("at") + F.col("x"), 6))
    return layers.position_nudge(Frame(moved.withColumn("nudged", F.col("x"))), "nudged", 0.25).df.select("l_returnflag", "l_linestatus", "x_dodged", "nudged")


@query("SELECT c_custkey, true AS near, dense_rank() OVER (ORDER BY c_mktsegment) AS panel FROM customer")
def jittered_panels(t):
    f = layers.position_jitter(t.customer.mutate(x=col("c_acctbal")), "x", amount=0.4, seed=5)
    return layers.facet_wrap(f, "c_mktsegment").df.select("c_custkey", (F.abs(F.col("x") - F.col("c_acctbal")) <= 0.4).alias("near"), "panel")


@query("WITH r AS (SELECT DISTINCT o_orderstatus AS s FROM orders), c AS (SELECT DISTINCT o_orderpriority AS p FROM orders), g AS (SELECT s, p, row_number() OVER (ORDER BY s, p) AS panel FROM r, c) SELECT o_orderkey, panel FROM orders JOIN g ON s = o_orderstatus AND p = o_orderpriority")
def panel_grid(t):
    return layers.facet_grid(t.orders, "o_orderstatus", "o_orderpriority").select("o_orderkey", "panel")


@query("SELECT b AS bin, count(v) AS count FROM range(17) g(b) LEFT JOIN (SELECT least(floor((p_size - 1) / 3.0), 16) AS v FROM part) ON v = b GROUP BY b")
def left_closed_bins(t):
    f = layers.stat_bin(t.part, "p_size", breaks=[1 + 3.0 * i for i in range(18)], closed="left").select("bin", "count")
    return f.mutate(bin=col("bin").cast("bigint"))


# ---------------------------------------------------------------- summaries and the surface
@query("""SELECT 'Min.' AS label, min(c_acctbal) AS value FROM customer UNION ALL SELECT '1st Qu.', quantile_cont(c_acctbal, 0.25) FROM customer UNION ALL SELECT 'Median', median(c_acctbal) FROM customer UNION ALL SELECT 'Mean', round(avg(c_acctbal), 6) FROM customer
          UNION ALL SELECT '3rd Qu.', quantile_cont(c_acctbal, 0.75) FROM customer UNION ALL SELECT 'Max.', max(c_acctbal) FROM customer UNION ALL SELECT 'Length', count(*)::DOUBLE FROM customer""")
def summary_of_columns(t):
    blocks = summary.summary(t.customer.select("c_acctbal", "c_name")).blocks
    rows = [(label, round(float(value), 6)) for label, value in blocks["c_acctbal"]] + [(label, float(value)) for label, value in blocks["c_name"] if label == "Length"]
    return t.spark.createDataFrame(rows, "label string, value double")


@query("SELECT 0 AS c_custkey, count(*) FILTER (c_nationkey = 3) AS k FROM customer")
def counted_nulls(t):
    from ..functions import window as w

    return t.customer.select("c_custkey", k=w.na_if("c_nationkey", 3)).null_count()


@query("SELECT e.event_id, (SELECT max(o.o_orderkey) FROM orders o WHERE o.o_orderkey <= e.event_id) AS o_orderkey FROM events e")
def nearest_before(t):
    right = Frame(t.orders.df.select(F.col("o_orderkey").alias("k"), "o_orderkey"), [("k", False)])
    return t.events.select("event_id").join_asof(right, left_on="event_id", right_on="k").select("event_id", "o_orderkey")


@query("SELECT a.s_suppkey, b.s_suppkey AS s_suppkey_right FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_acctbal < b.s_acctbal")
def pairs_where(t):
    f = t.supplier.select("s_suppkey", "s_nationkey", "s_acctbal")
    return f.join_where(f, col("s_nationkey") == col("s_nationkey_right"), col("s_acctbal") < col("s_acctbal_right")).select("s_suppkey", "s_suppkey_right")


@query("SELECT 'low' AS \"column\", min(p_size)::DOUBLE AS part, min(s_nationkey)::DOUBLE AS supplier FROM part, supplier UNION ALL SELECT 'high', max(p_size)::DOUBLE, max(s_nationkey)::DOUBLE FROM part, supplier")
def turned(t):
    a = t.part.df.agg(F.lit("part").alias("of"), F.min("p_size").alias("low"), F.max("p_size").alias("high"))
    b = t.supplier.df.agg(F.lit("supplier").alias("of"), F.min("s_nationkey").alias("low"), F.max("s_nationkey").alias("high"))
    return Frame(a.union(b)).transpose("of")


@query("SELECT s_suppkey, s_acctbal * 2 AS twice, CASE WHEN s_acctbal > 5000 THEN 'rich' WHEN s_acctbal > 0 THEN 'fair' ELSE 'poor' END AS class, s_name || '/' || s_nationkey AS tag FROM supplier")
def row_functions(t):
    classes = surface.when(col("s_acctbal") > 5000).then("rich").when(col("s_acctbal") > 0).then("fair").otherwise("poor")
    f = t.supplier.mutate(**{"class": classes, "tag": surface.concat_str(col("s_name"), col("s_nationkey").cast("string"), separator="/")})
    twice = t.supplier.select("s_suppkey", "s_acctbal").map_rows(lambda row: (row[0], row[1] * 2), "s_suppkey bigint, twice double")
    return f.select("s_suppkey", "class", "tag").df.join(twice.df, "s_suppkey")


@query("SELECT n_nationkey, n_name, r_name FROM nation LEFT JOIN region ON r_regionkey = n_nationkey")
def aligned_frames(t):
    a, b = surface.align_frames(t.nation.select(key="n_nationkey", n_name="n_name"), t.region.select(key="r_regionkey", r_name="r_name"), on="key")
    return a.df.join(b.df, "key").withColumnRenamed("key", "n_nationkey")


@query("SELECT s_nationkey, s_name FROM supplier UNION ALL SELECT c_nationkey, NULL FROM customer")
def diagonal_rows(t):
    return surface.concat([t.supplier.select("s_nationkey", "s_name"), t.customer.select(s_nationkey="c_nationkey")], "diagonal")


@query("SELECT CAST(max(p_size) AS BIGINT) AS p_size, (SELECT count(*) FROM part WHERE p_size + p_partkey > 100) AS far FROM part")
def applied_margins(t):
    columns = v.apply(t.part, 2, st.max_, "p_size").df.select(F.col("p_size").cast("bigint").alias("p_size"))
    rows = v.apply(t.part, 1, lambda row: row[0] + row[1], "p_size", "p_partkey").df
    return columns.crossJoin(rows.agg(F.count_if(F.col("value") > 100).alias("far")))


@query("SELECT r_name FROM region")
def sorted_text(t):
    return v.str_sort(t.region, "r_name")


@query("SELECT o_orderkey, greatest(o_totalprice, 1000.0) AS o_totalprice, o_custkey FROM orders")
def mapped_columns(t):
    return t.orders.select("o_orderkey", "o_totalprice", "o_custkey").map_columns(["o_totalprice"], lambda c: k.max_horizontal(col(c), lit(1000.0)))


@query("SELECT l_linenumber, l_returnflag, CAST(sum(l_quantity) AS DOUBLE) AS q FROM lineitem GROUP BY ROLLUP (l_linenumber, l_returnflag)")
def rolled_up(t):
    return r.rollup(t.lineitem, ["l_linenumber", "l_returnflag"], q=st.sum_("l_quantity"))


# ---------------------------------------------------------------- built layers
@query("""SELECT dense_rank() OVER (ORDER BY c_mktsegment) AS "PANEL", k AS x, n AS count, n / sum(n) OVER (PARTITION BY c_mktsegment) AS y FROM (SELECT c_mktsegment, c_nationkey AS k, count(*) AS n FROM customer GROUP BY ALL)""")
def built_counts(t):
    plot = b.ggplot(t.customer, b.aes("c_nationkey", y=b.after_stat("prop"))).facet("c_mktsegment").add(b.Layer("count"))
    return b.build(plot).layers[0].select("PANEL", "x", "count", "y")


@query("""WITH c AS (SELECT o_orderpriority AS p, o_orderstatus AS s, count(*) AS n FROM orders GROUP BY ALL) SELECT p AS x, s AS fill, sum(n) OVER w / sum(n) OVER (PARTITION BY p) AS ymax, (sum(n) OVER w - n) / sum(n) OVER (PARTITION BY p) AS ymin FROM c WINDOW w AS (PARTITION BY p ORDER BY s DESC)""")
def built_shares(t):
    plot = b.ggplot(t.orders, x="o_orderpriority", fill="o_orderstatus").add(b.Layer("count", "fill"))
    return b.build(plot).layers[0].select("x", "fill", "ymax", "ymin")


@query("""WITH p AS (SELECT p_brand AS f, log10(p_retailprice) AS y FROM part WHERE p_retailprice BETWEEN 910 AND 980), q AS (SELECT f, quantile_cont(y, 0.25) AS lower, quantile_cont(y, 0.5) AS middle, quantile_cont(y, 0.75) AS upper FROM p GROUP BY 1)
          SELECT f AS fill, round(lower, 6) AS lower, round(middle, 6) AS middle, round(upper, 6) AS upper FROM q""")
def built_boxes_on_a_log_scale(t):
    plot = b.ggplot(t.part, y="p_retailprice", fill="p_brand").scale("y", "log10", (910, 980)).add(b.Layer("boxplot"))
    return b.build(plot).layers[0].df.select("fill", *[F.round(c, 6).alias(c) for c in ("lower", "middle", "upper")])


@query("""WITH c AS (SELECT l_returnflag AS f, l_linestatus AS s, least(greatest(ceil(l_quantity / 5) - 1, 0), 9) AS b FROM lineitem), g AS (SELECT DISTINCT f, s FROM c), n AS (SELECT f, s, b, count(*) AS n FROM c GROUP BY ALL)
          SELECT g.f AS fill, g.s AS colour, CAST(5 * k + 2.5 AS DOUBLE) AS x, coalesce(n, 0) AS y, coalesce(n, 0) * 2 AS twice FROM g CROSS JOIN range(0, 10) r(k) LEFT JOIN n ON n.f = g.f AND n.s = g.s AND n.b = k""")
def built_histogram(t):
    layer = b.Layer("bin", mapping=b.aes(twice=b.after_scale(col("y") * 2)), params={"breaks": [5.0 * i for i in range(11)]})
    out = b.build(b.ggplot(t.lineitem, x="l_quantity", fill="l_returnflag", colour="l_linestatus").add(layer)).layers[0].df
    return out.select("fill", "colour", F.col("x").cast("decimal(5,1)").cast("double").alias("x"), "y", "twice")


@query("""SELECT dense_rank() OVER (ORDER BY n_regionkey) AS "PANEL", 'x' AS aesthetic, min(n_nationkey)::DOUBLE AS low, max(n_nationkey)::DOUBLE AS high FROM nation GROUP BY n_regionkey
          UNION ALL SELECT dense_rank() OVER (ORDER BY n_regionkey), 'y', min(least(n_regionkey, n_nationkey))::DOUBLE, max(greatest(n_regionkey, n_nationkey))::DOUBLE FROM nation GROUP BY n_regionkey""")
def built_ranges(t):
    plot = b.ggplot(t.nation, x="n_nationkey", y="n_regionkey").facet("n_regionkey").add(b.Layer()).add(b.Layer(mapping=b.aes(y="n_nationkey")))
    return b.build(plot).ranges


@query("SELECT l_returnflag AS colour, l_linenumber AS x, round(avg(l_quantity), 6) AS y, round(avg(l_quantity) + stddev_samp(l_quantity) / sqrt(count(*)), 6) AS ymax FROM lineitem GROUP BY ALL")
def built_summary(t):
    out = b.build(b.ggplot(t.lineitem, b.aes("l_linenumber", "l_quantity", colour="l_returnflag")).add(b.Layer("summary"))).layers[0].df
    return out.select("colour", "x", F.round("y", 6).alias("y"), F.round("ymax", 6).alias("ymax"))


@query("SELECT round(count(*) / 1000.0, 1)::DOUBLE AS rows, 3 AS groups FROM range(0, 192) g(i)")
def built_densities(t):
    """Densities of three groups on one grid of 64 places."""
    out = b.build(b.ggplot(t.lineitem, x="l_extendedprice", fill="l_returnflag").add(b.Layer("density", params={"n": 64}))).layers[0].df
    return out.agg(F.round(F.count("*") / 1000, 1).alias("rows"), F.countDistinct("fill").cast("int").alias("groups"))


# ---------------------------------------------------------------- mixed models
#: balanced groups, where the REML estimates are those of the analysis of variance
_BALANCED = """d AS (SELECT p_partkey % 10 AS g, p_size + 3.0 * (p_partkey % 10) AS y FROM part), g AS (SELECT g, avg(y) AS m, count(*)::DOUBLE AS n, var_samp(y) AS v FROM d GROUP BY g),
                  s AS (SELECT avg(v) AS mse, any_value(n) AS n, any_value(n) * var_samp(m) AS msb, avg(m) AS mean, count(*)::DOUBLE AS k FROM g)"""


def _balanced(t):
    return t.part.select(g=col("p_partkey") % 10, y=col("p_size") + 3.0 * (col("p_partkey") % 10))


@query(f"WITH {_BALANCED} SELECT round(mean, 4) AS mean, round(sqrt(msb / (n * k)), 4) AS se, round(sqrt(mse), 4) AS sigma, round(sqrt((msb - mse) / n), 4) AS sd FROM s")
def mixed_intercepts(t):
    m = lme("y ~ 1 + (1 | g)", _balanced(t))
    row = m.coef_table()[0]
    return _one(t, mean=round(row["estimate"], 4), se=round(row["std_error"], 4), sigma=round(m.sigma, 4), sd=round(m.sd["(Intercept)"], 4))


@query(f'WITH {_BALANCED} SELECT g AS "group", round((m - mean) * (msb - mse) / msb, 4) AS effect FROM g, s')
def random_effects(t):
    out = generics.ranef(lme("y ~ 1 + (1 | g)", _balanced(t))).df
    return out.select("group", F.round("`(Intercept)`", 4).alias("effect"))


@query(f"""WITH {_BALANCED}, e AS (SELECT count(*)::DOUBLE AS t, var_pop(y) * count(*) AS ss FROM d)
           SELECT round(t * (ln(2 * pi() * ss / t) + 1), 2) AS plain, 3.0::DOUBLE AS npar,
                  round(t * (ln(2 * pi()) + 1) + (t - k) * ln(mse) + k * ln(msb * (k - 1) / k), 2) AS deviance FROM e, s""")
def mixed_likelihoods(t):
    """By ML the between-group mean square has k, not k - 1, below it."""
    from ..models.mixed import anova_lme

    rows = anova_lme(lme("y ~ 1 + (1 | g)", _balanced(t)))
    plain = lm("y ~ 1", _balanced(t))
    return _one(t, plain=round(-2 * plain.log_likelihood(), 2), npar=rows[0]["npar"], deviance=round(rows[0]["deviance"], 2))
