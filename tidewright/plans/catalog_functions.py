"""Queries over scalar functions: distributions, mathematics, coercion, dates, strings, factors and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import conditionals as k
from ..functions import distributions as d
from ..functions import factors as fct
from ..functions import stats as st
from ..functions import strings as s
from ..functions import vectors as v
from ..functions import window as w
from ..functions.expr import col, compose, lit, n
from ..operators import reshape as r
from ..operators.frame import Frame
from .catalog import query


def _six(**made):
    """Rounded to six places, which sums of different order share."""
    return {name: compose(lambda a: F.round(a, 6), e) for name, e in made.items()}


#: p in (0, 1) and x from 0 up, from the size of a part, which is 1 to 50
_P = "(SELECT p_partkey, p_size, p_size / 51.0 AS p, p_size / 10.0 AS x FROM part)"


def _sized(t):
    return t.part.mutate(p=col("p_size") / 51.0, x=col("p_size") / 10.0)


#: the normal distribution function by Simpson's rule on 400 steps
def _phi(z: str) -> str:
    return f"(0.5 + {z} / 1200.0 * list_sum(list_transform(range(0, 401), lambda i: (CASE WHEN i IN (0, 400) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-power({z} * i / 400.0, 2) / 2))) / sqrt(2 * pi()))"


# ---------------------------------------------------------------- distributions
@query(f"SELECT p_partkey, round({_phi('(x - 2) / 1.5')}, 6) AS p_low, round(1 - {_phi('(x - 2) / 1.5')}, 6) AS p_high FROM {_P}")
def normal_probabilities(t):
    return _sized(t).select("p_partkey", **_six(p_low=d.pnorm("x", 2, 1.5), p_high=d.pnorm("x", 2, 1.5, lower_tail=False)))


@query(f"SELECT p_partkey, round(p, 6) AS back FROM {_P}")
def normal_quantiles(t):
    return _sized(t).mutate(q=d.qnorm("p", 3, 2)).select("p_partkey", **_six(back=d.pnorm("q", 3, 2)))


@query(f"""SELECT p_partkey, CASE WHEN x BETWEEN 1 AND 4 THEN 1 / 3.0 ELSE 0 END AS du, least(greatest((x - 1) / 3.0, 0), 1) AS pu, 1 + 3 * p AS qu, 2 * exp(-2 * x) AS de, exp(-2 * x) AS pe, -ln(1 - p) / 2 AS qe FROM {_P}""")
def uniform_and_exponential(t):
    return _sized(t).select("p_partkey", du=d.dunif("x", 1, 4), pu=d.punif("x", 1, 4), qu=d.qunif("p", 1, 4), de=d.dexp("x", 2), pe=d.pexp("x", 2, lower_tail=False), qe=d.qexp("p", 2))


@query(f"""SELECT p_partkey, round(1 / (2 * sqrt(2) * power(1 + x * x / 2, 1.5)), 6) AS dt2, round(0.5 + x / (2 * sqrt(2 + x * x)), 6) AS pt2, round(0.5 - atan(x) / pi(), 6) AS pt1, round((2 * p - 1) / sqrt(2 * p * (1 - p)), 6) AS qt2 FROM {_P}""")
def student(t):
    return _sized(t).select("p_partkey", **_six(dt2=d.dt("x", 2), pt2=d.pt("x", 2), pt1=d.pt("x", 1, lower_tail=False), qt2=d.qt("p", 2)))


@query(f"""SELECT p_partkey, round(1 - power(7 / (7 + 2 * x), 3.5), 6) AS pf2, round(power(7 / (7 + 2 * x), 3.5), 6) AS upper, round((power(1 - p, -2.0 / 7) - 1) * 7 / 2, 6) AS qf2 FROM {_P}""")
def f_distribution(t):
    return _sized(t).select("p_partkey", **_six(pf2=d.pf("x", 2, 7), upper=d.pf("x", 2, 7, lower_tail=False), qf2=d.qf("p", 2, 7)))


@query(f"""SELECT p_partkey, round(x * exp(-x / 2) / 4, 6) AS d4, round(1 - exp(-x / 2) * (1 + x / 2), 6) AS p4, round(exp(-x / 2), 6) AS p2, round(-2 * ln(1 - p), 6) AS q2 FROM {_P}""")
def chi_squared(t):
    return _sized(t).select("p_partkey", **_six(d4=d.dchisq("x", 4), p4=d.pchisq("x", 4), p2=d.pchisq("x", 2, lower_tail=False), q2=d.qchisq("p", 2)))


@query(f"""SELECT p_partkey, round(power(1.5, 3) * x * x * exp(-1.5 * x) / 2, 6) AS d3, round(1 - exp(-1.5 * x) * (1 + 1.5 * x), 6) AS p2, round(-ln(1 - p) * 2, 6) AS q1, round(30 * p * power(1 - p, 4), 6) AS db, round(p * p * (6 - 8 * p + 3 * p * p), 6) AS pb, round(sqrt(p), 6) AS qb FROM {_P}""")
def gamma_and_beta(t):
    return _sized(t).select("p_partkey", **_six(d3=d.dgamma("x", 3, 1.5), p2=d.pgamma("x", 2, 1.5), q1=d.qgamma("p", 1, scale=2), db=d.dbeta("p", 2, 5), pb=d.pbeta("p", 2, 3), qb=d.qbeta("p", 2, 1)))


def _binom(k: str) -> str:
    return f"exp(lgamma(51) - lgamma({k} + 1) - lgamma(51 - {k}) + {k} * ln(0.3) + (50 - {k}) * ln(0.7))"


def _pois(k: str) -> str:
    return f"exp({k} * ln(12.5) - 12.5 - lgamma({k} + 1))"


_DISCRETE = f"""c AS (SELECT k, {_binom('k')} AS db, {_pois('k')} AS dp FROM range(0, 51) g(k)),
                s AS (SELECT k, db, dp, sum(db) OVER (ORDER BY k) AS pb, sum(dp) OVER (ORDER BY k) AS pp FROM c)"""


@query(f"WITH {_DISCRETE} SELECT p_partkey, round(db, 6) AS db, round(pb, 6) AS pb, round(dp, 6) AS dp, round(pp, 6) AS pp FROM part JOIN s ON k = p_size")
def binomial_and_poisson(t):
    return _sized(t).select("p_partkey", **_six(db=d.dbinom("p_size", 50, 0.3), pb=d.pbinom("p_size", 50, 0.3), dp=d.dpois("p_size", 12.5), pp=d.ppois("p_size", 12.5)))


@query(f"WITH {_DISCRETE} SELECT p_partkey, CAST((SELECT min(k) FROM s WHERE pb >= p) AS DOUBLE) AS qb, CAST((SELECT min(k) FROM s WHERE pp >= p) AS DOUBLE) AS qp FROM {_P}")
def discrete_quantiles(t):
    return _sized(t).select("p_partkey", qb=d.qbinom("p", 50, 0.3), qp=d.qpois("p", 12.5))


@query("""SELECT * FROM (VALUES ('rnorm', true), ('runif', true), ('rexp', true), ('rgamma', true), ('rchisq', true), ('rt', true), ('rf', true), ('rbeta', true), ('rbinom', true), ('rpois', true)) v(name, near)""")
def draws(t):
    """Means of 20000 draws each lie within six standard errors of the distributions' own."""
    drawn = {
        "rnorm": (d.rnorm(3, 2, 1), 3, 2), "runif": (d.runif(1, 5, 2), 3, 1.16), "rexp": (d.rexp(0.5, 3), 2, 2), "rgamma": (d.rgamma(4, 2, 4), 2, 1), "rchisq": (d.rchisq(3, 5), 3, 2.45), "rt": (d.rt(9, 6), 0, 1.14),
        "rf": (d.rf(5, 20, 7), 20 / 18, 0.87), "rbeta": (d.rbeta(2, 6, 8), 0.25, 0.145), "rbinom": (d.rbinom(20, 0.4, 9), 8, 2.2), "rpois": (d.rpois(6, 10), 6, 2.45),
    }
    frame = Frame(t.spark.range(20000)).select(**{name: e for name, (e, _, _) in drawn.items()})
    means = frame.summarize(**{name: st.mean(name) for name in drawn}).df
    rows = F.array(*[F.struct(F.lit(name).alias("name"), (F.abs(F.col(name) - m) < 6 * sd / 20000**0.5).alias("near")) for name, (_, m, sd) in drawn.items()])
    return means.select(F.explode(rows).alias("r")).select("r.*")


# ---------------------------------------------------------------- mathematics and coercion
@query("""SELECT p_partkey, exp(p_size / 10.0) AS ex, exp(p_size / 10.0) - 1 AS em, log2(p_size) AS l2, log10(p_size) AS l10, ln(1 + p_size) AS l1, ln(p_size) / ln(3) AS l3, sin(p_size) AS si, cos(p_size) AS co, tan(p_size) AS ta,
                 asin(p_size / 60.0) AS asi, acos(p_size / 60.0) AS aco, atan(p_size) AS ata, atan2(p_size, 20) AS at2 FROM part""")
def elementary(t):
    x, y = col("p_size") / 10.0, col("p_size") / 60.0
    return t.part.select("p_partkey", ex=k.exp(x), em=k.expm1(x), l2=k.log2("p_size"), l10=k.log10("p_size"), l1=k.log1p("p_size"), l3=k.log("p_size", 3), si=k.sin("p_size"), co=k.cos("p_size"), ta=k.tan("p_size"),
                         asi=k.asin(y), aco=k.acos(y), ata=k.atan("p_size"), at2=k.atan2("p_size", lit(20)))


@query("""SELECT c_custkey, abs(c_acctbal) AS a, CAST(sign(c_acctbal) AS DOUBLE) AS s, CAST(ceil(c_acctbal / 7) AS DOUBLE) AS up, CAST(floor(c_acctbal / 7) AS DOUBLE) AS down, CAST(trunc(c_acctbal / 7) AS DOUBLE) AS t, round_even(c_acctbal, 0) AS r,
                 abs(c_acctbal - 5000) < 1000 AS close FROM customer""")
def rounding(t):
    x = col("c_acctbal") / 7
    return t.customer.select("c_custkey", a=k.abs_("c_acctbal"), s=k.sign("c_acctbal"), up=k.ceiling(x), down=k.floor(x), t=k.trunc(x), r=k.round_("c_acctbal"), close=w.near("c_acctbal", lit(5000.0), tol=1000))


@query("""SELECT o_orderkey, CAST(o_orderkey AS DOUBLE) AS num, CAST(trunc(o_totalprice) AS BIGINT) AS whole, CAST(o_custkey AS VARCHAR) AS txt, o_custkey % 2 = 1 AS odd, strftime(o_orderdate, '%Y-%m-%d') AS day,
                 nullif(o_orderstatus, 'P') IS NULL AS gone, o_custkey % 3 <> 0 AS finite FROM orders""")
def coercion(t):
    f = t.orders.mutate(status=w.na_if("o_orderstatus", "P"), ratio=k.if_else(col("o_custkey") % 3 == 0, lit(float("inf")), col("o_totalprice")))
    return f.select("o_orderkey", num=k.as_numeric("o_orderkey"), whole=k.as_integer("o_totalprice"), txt=k.as_character("o_custkey"), odd=k.as_logical(col("o_custkey") % 2), day=k.as_character(s.as_date("o_orderdate")),
                    gone=k.is_na("status"), finite=k.is_finite("ratio"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS a, strftime(o_orderdate, '%Y-%m-%d') AS b, strftime(o_orderdate, '%Y-%m-%d') AS c, strftime(o_orderdate, '%Y-%m-%d') AS e, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS f,
                 strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS g, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS h, strftime(o_orderdate, '%Y-%m-%d %H:%M:00') AS i, strftime(o_orderdate, '%Y-%m-%d %H:%M:00') AS j, strftime(o_orderdate, '%Y-%m-%d %H:%M:00') AS l FROM orders""")
def parsed_dates(t):
    def as_text(form):
        return compose(lambda a: F.date_format(a, form), col("o_orderdate"))

    def shown(e):
        return compose(lambda a: F.date_format(a, "yyyy-MM-dd HH:mm:ss"), e)

    day = lambda e: compose(lambda a: F.date_format(a, "yyyy-MM-dd"), e)
    return t.orders.select(
        "o_orderkey", a=day(s.mdy(as_text("M/d/yyyy"))), b=day(s.dmy(as_text("d.M.yyyy"))), c=day(s.dmy(as_text("d MMMM yyyy"))), e=day(s.as_date(as_text("yyyy|MM|dd"), "%Y|%m|%d")),
        f=shown(s.ymd_hms(as_text("yyyy-MM-dd HH:mm:ss"))), g=shown(s.mdy_hms(as_text("MM/dd/yyyy HH:mm:ss"))), h=shown(s.dmy_hms(as_text("dd-MM-yyyy HH:mm:ss"))),
        i=shown(s.ymd_hm(as_text("yyyy-MM-dd HH:mm"))), j=shown(s.mdy_hm(as_text("M/d/yyyy HH:mm"))), l=shown(s.dmy_hm(as_text("d-M-yyyy HH:mm"))),
    )


@query("SELECT 1 AS one, true AS today, true AS now, TIMESTAMP '1970-01-02 00:00:01' AS epoch, 19000 AS days")
def clock(t):
    f = Frame(t.spark.range(1)).select(one=lit(1), a=s.today("UTC"), b=s.now("UTC"), e=s.from_epoch(lit(86401)), z=s.from_epoch(lit(19000), "d"))
    near = lambda c: F.abs(F.unix_timestamp(F.col(c).cast("timestamp")) - F.unix_timestamp()) < 2 * 86400
    return f.df.select("one", near("a").alias("today"), near("b").alias("now"), F.col("e").cast("timestamp_ntz").alias("epoch"), F.datediff("z", F.lit("1970-01-01")).alias("days"))


# ---------------------------------------------------------------- strings
@query("""SELECT c_custkey, lower(c_mktsegment) AS low, upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) AS title, c_custkey = 7 AS same, len(regexp_extract_all(c_name, '0')) AS zeros, regexp_replace(c_name, '0+', '-', 'g') AS dashed,
                 CAST(c_custkey AS VARCHAR) || ' of ' || c_mktsegment AS glued, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE CAST(c_custkey + 0.5 AS DOUBLE) END AS num, true AS wrapped FROM customer""")
def string_forms(t):
    f = t.customer.mutate(txt=k.if_else(col("c_custkey") % 5 == 0, lit("$1,0"), s.str_c(k.as_character("c_custkey"), lit(".5"))), words=lit("some words that go on for longer than a line does"))
    return f.select(
        "c_custkey", low=s.str_to_lower("c_mktsegment"), title=s.str_to_title("c_mktsegment"), same=s.str_equal(s.str_to_upper("c_name"), lit("customer#000000007"), ignore_case=True),
        zeros=s.str_count("c_name", "0").cast("bigint"), dashed=s.str_replace_all("c_name", "0+", "-"), glued=s.str_glue("{c_custkey} of {c_mktsegment}"), num=s.parse_double("txt"),
        wrapped=compose(lambda a: a == F.lit("some words that go\non for longer than\na line does"), s.str_wrap("words", 19)),
    )


# ---------------------------------------------------------------- factors
def _as_rows(t, **levels):
    return t.spark.createDataFrame([(name, ",".join(map(str, found))) for name, found in levels.items()], "made string, levels string")


@query("""WITH c AS (SELECT c_mktsegment AS s, count(*) AS n, median(c_acctbal) AS m FROM customer GROUP BY 1)
          SELECT 'plain' AS made, string_agg(s, ',' ORDER BY s) AS levels FROM c UNION ALL SELECT 'rev', string_agg(s, ',' ORDER BY s DESC) FROM c UNION ALL SELECT 'infreq', string_agg(s, ',' ORDER BY n DESC, s) FROM c
          UNION ALL SELECT 'reorder', string_agg(s, ',' ORDER BY m, s) FROM c UNION ALL SELECT 'relevel', string_agg(s, ',' ORDER BY s <> 'HOUSEHOLD', s) FROM c UNION ALL SELECT 'nlevels', CAST(count(*) AS VARCHAR) FROM c
          UNION ALL SELECT 'is_factor', 'True,False'""")
def factor_levels(t):
    f = fct.factor(t.customer, "c_mktsegment")
    return _as_rows(
        t, plain=fct.levels(f, "c_mktsegment"), rev=fct.levels(fct.fct_rev(f, "c_mktsegment"), "c_mktsegment"), infreq=fct.levels(fct.fct_infreq(f, "c_mktsegment"), "c_mktsegment"),
        reorder=fct.levels(fct.fct_reorder(f, "c_mktsegment", "c_acctbal"), "c_mktsegment"), relevel=fct.levels(fct.fct_relevel(f, "c_mktsegment", "HOUSEHOLD"), "c_mktsegment"),
        nlevels=[fct.nlevels(f, "c_mktsegment")], is_factor=[fct.is_factor(f, "c_mktsegment"), fct.is_factor(t.customer, "c_mktsegment")],
    )


@query("""WITH c AS (SELECT o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1), k AS (SELECT p, n, rank() OVER (ORDER BY n DESC) AS i FROM c)
          SELECT CASE WHEN i <= 2 THEN p ELSE 'Rest' END AS o_orderpriority, CAST(sum(n) AS BIGINT) AS n FROM k GROUP BY 1""")
def factor_lump_n(t):
    return fct.fct_lump_n(t.orders, "o_orderpriority", 2, other_level="Rest").count("o_orderpriority")


@query("SELECT CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS o_orderstatus, o_orderstatus || '.' || o_orderpriority AS both, count(*) AS n FROM orders GROUP BY ALL")
def factor_recode(t):
    f = fct.interaction(t.orders, "o_orderstatus", "o_orderpriority", name="both")
    return fct.fct_recode(f, "o_orderstatus", done="F", open="O").count("o_orderstatus", "both")


@query("SELECT CAST(least(floor((c_acctbal - lo) / ((hi - lo) / 8)), 7) AS BIGINT) AS i, count(*) AS n FROM customer, (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer) GROUP BY 1")
def binned_by_interval(t):
    f = fct.cut_interval(t.customer, "c_acctbal", n=8, closed="left", name="bin")
    first = f.df.groupBy("bin").agg(F.count("*").alias("n"), F.min("c_acctbal").alias("low")).orderBy("low")
    return Frame(first, [("low", False)]).with_row_index("i").select("i", "n")


# ---------------------------------------------------------------- vectors and rows
@query("""SELECT c_custkey, c_nationkey, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) > 1) AS again, (c_acctbal > 0 AND c_custkey > 10) AS both FROM customer""")
def repeated_values(t):
    return t.customer.select("c_custkey", "c_nationkey", again=w.duplicated("c_nationkey"), both=(col("c_acctbal") > 0) & (col("c_custkey") > 10))


@query("WITH r AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS i, o_totalprice AS p FROM orders) SELECT i AS place FROM r WHERE p > 400000")
def places_where(t):
    return v.which(t.orders, col("o_totalprice") > 400000)


@query("""WITH r AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS i, c_acctbal AS b FROM customer)
          SELECT (SELECT i FROM r ORDER BY b DESC, i LIMIT 1) AS most, (SELECT i FROM r ORDER BY b, i LIMIT 1) AS least, (SELECT round(min(d), 6) FROM (SELECT b - lag(b) OVER (ORDER BY b) AS d FROM (SELECT DISTINCT b FROM r))) AS gap""")
def extreme_places(t):
    gap = round(v.resolution(t.customer, "c_acctbal"), 6)
    return t.spark.createDataFrame([(v.which_max(t.customer, "c_acctbal"), v.which_min(t.customer, "c_acctbal"), gap)], "most bigint, least bigint, gap double")


@query("WITH r AS (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS i, s_acctbal AS b FROM supplier) SELECT i AS place, row_number() OVER (ORDER BY b DESC, i) - 1 AS at FROM r")
def sorted_places(t):
    ordered = v.order(t.supplier, "s_acctbal", decreasing=True)
    values = [row["place"] for row in ordered.df.collect()]  # one for each supplier
    return t.spark.createDataFrame(list(zip(values, range(len(values)), strict=True)), "place bigint, at bigint")


@query("SELECT sum(p_size) AS p_size, round(sum(p_retailprice), 2) AS price, round(avg(p_size), 6) AS mean_size, round(avg(p_retailprice), 6) AS mean_price FROM part")
def column_sums(t):
    f = t.part.select("p_size", price="p_retailprice")
    sums = Frame(r.colSums(f).df.select(F.col("p_size").cast("bigint").alias("p_size"), F.round("price", 2).alias("price")))
    means = Frame(r.colMeans(f).df.select(F.round("p_size", 6).alias("mean_size"), F.round("price", 6).alias("mean_price")))
    return sums.df.crossJoin(means.df)


@query("SELECT p_partkey, p_size - 10 AS p_size, p_retailprice - 900 AS p_retailprice, (p_size + p_retailprice) / 2 AS mean FROM part")
def swept(t):
    f = t.part.select("p_partkey", "p_size", "p_retailprice", mean=k.rowMeans("p_size", "p_retailprice"))
    return v.sweep(f, ["p_size", "p_retailprice"], [10, 900])


@query("SELECT p_brand, round(avg(p_size), 6) AS value FROM part GROUP BY 1")
def applied_by_group(t):
    return r.tapply(t.part, "p_size", "p_brand", st.mean).df.select("p_brand", F.round("value", 6).alias("value"))


@query("SELECT p_brand, CAST(max(p_size) - min(p_size) AS DOUBLE) AS value FROM part GROUP BY 1")
def applied_callable(t):
    return r.tapply(t.part, "p_size", "p_brand", lambda x: float(max(list(x)) - min(list(x))) if hasattr(x, "iloc") else None)


@query("SELECT user_id, event_id, product(b) OVER o AS product, min(x) OVER o AS low FROM (SELECT *, 1 + (event_id % 3) / 100.0 AS b, event_id % 7 AS x FROM events) WINDOW o AS (PARTITION BY user_id ORDER BY event_id)")
def running_products(t):
    f = t.events.mutate(b=1 + (col("event_id") % 3) / 100.0, x=col("event_id") % 7).group_by("user_id").mutate(product=w.cumprod("b"), low=w.cummin("x")).ungroup()
    return f.select("user_id", "event_id", "product", "low")


@query("SELECT DISTINCT c_nationkey AS k, s_nationkey AS j, 10 * c_nationkey + s_nationkey AS code FROM (SELECT c_nationkey FROM customer WHERE c_nationkey < 3), (SELECT s_nationkey FROM supplier WHERE s_nationkey < 2)")
def grid_of_values(t):
    return r.expand_grid(t.spark, k=[0, 1, 2], j=[0, 1]).mutate(code=10 * col("k") + col("j"))


@query("SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1")
def counted_values(t):
    return r.value_counts(t.customer, "c_mktsegment")


@query("SELECT c_mktsegment, bool_or(c_acctbal < -900) AS anyone, bool_and(c_acctbal > -999) AS everyone, min(c_acctbal) AS low, max(c_acctbal) AS high, round(sum(c_acctbal * c_nationkey) / sum(c_nationkey), 4) AS wm FROM customer GROUP BY 1")
def boolean_aggregates(t):
    f = t.customer.group_by("c_mktsegment").summarize(anyone=st.any_(col("c_acctbal") < -900), everyone=st.all_(col("c_acctbal") > -999), range=st.R_range("c_acctbal"), wm=st.weighted_mean("c_acctbal", "c_nationkey"), n=n())
    return f.df.select("c_mktsegment", "anyone", "everyone", F.col("range")[0].alias("low"), F.col("range")[1].alias("high"), F.round("wm", 4).alias("wm"))
