"""Named queries over the star schema, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import conditionals as k
from ..functions import distributions as d
from ..functions import factors as fct
from ..functions import stats as st
from ..functions import strings as s
from ..functions import window as w
from ..functions.expr import col, compose, lit, n, n_distinct
from ..models import htest, selection
from ..models.linear import Gamma, binomial, glm, lm, poisson
from ..operators import joins as j
from ..operators import layers
from ..operators import reshape as r
from ..operators import surface as _surface  # noqa: F401  methods of Frame
from ..operators.frame import Frame, cols_between, desc, ends_with, exclude, starts_with, where_type

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """The tables as frames with their order keys."""

    ORDER = {
        "lineitem": ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), "orders": ("o_orderkey",), "customer": ("c_custkey",), "events": ("event_id",),
        "part": ("p_partkey",), "supplier": ("s_suppkey",), "nation": ("n_nationkey",), "region": ("r_regionkey",),
    }

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> Frame:
        return Frame.parquet(self.spark, f"{self.folder}/{name}.parquet", self.ORDER.get(name, ()))


def query(sql: str | None = None):
    def register(f: Callable[[Tables], Frame | DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(Tables(spark, sf_dir))
            return out if isinstance(out, DataFrame) else out.df

        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def half_up(x, digits: int):
    """Rounds away from zero, as SQL does, where sums are compared."""
    return compose(lambda a: F.round(a, digits), x)


def _levels(t: Tables, model: lm) -> DataFrame:
    return t.spark.createDataFrame([(x.removeprefix("l_returnflag"), float(b)) for x, b in model.coefficients().items()], "l_returnflag string, eta double")


def _one(spark: SparkSession, **values) -> DataFrame:
    return spark.createDataFrame([tuple(float(v) if isinstance(v, int | float) and not isinstance(v, bool) else v for v in values.values())], list(values))


# ---------------------------------------------------------------- rows and columns
@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_quantity), 4) AS avg_qty, count(*) AS n
          FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(t):
    f = t.lineitem.filter(col("l_shipdate") <= lit("1998-09-02").cast("timestamp_ntz")).group_by("l_returnflag", "l_linestatus")
    return f.summarize(sum_qty=st.sum_("l_quantity"), revenue=half_up(st.sum_(col("l_extendedprice") * (1 - col("l_discount"))), 2), avg_qty=half_up(st.mean("l_quantity"), 4), n=n())


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 200000")
def filter_rows(t):
    return t.orders.filter(col("o_totalprice") > 200000, o_orderstatus="O").select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT c_custkey FROM customer WHERE NOT coalesce(nullif(c_nationkey, 3) > 10, false)")
def remove_rows(t):
    return t.customer.mutate(k=w.na_if("c_nationkey", 3)).remove(col("k") > 10).select("c_custkey")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice * (1 - l_discount) AS net, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS gross FROM lineitem")
def mutate_sequential(t):
    f = t.lineitem.mutate(net=col("l_extendedprice") * (1 - col("l_discount")), gross=col("net") * (1 + col("l_tax")))
    return f.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "net", "gross")


@query("SELECT o_orderkey, o_totalprice / avg(o_totalprice) OVER (PARTITION BY o_orderstatus) AS rel FROM orders")
def mutate_by(t):
    return t.orders.mutate(rel=col("o_totalprice") / st.mean("o_totalprice"), _by="o_orderstatus").select("o_orderkey", "rel")


@query("SELECT o_orderkey, o_totalprice - (SELECT avg(o_totalprice) FROM orders) AS dev FROM orders")
def mutate_total(t):
    return t.orders.mutate(dev=col("o_totalprice") - st.mean("o_totalprice")).select("o_orderkey", "dev")


@query("SELECT o_orderkey, o_totalprice * 2 AS twice FROM orders")
def transmute(t):
    return t.orders.group_by("o_orderkey").transmute(twice=col("o_totalprice") * 2)


@query("SELECT c_custkey, c_name, c_acctbal AS balance FROM customer")
def select_rename(t):
    return t.customer.select("c_custkey", "c_name", balance="c_acctbal")


@query("SELECT p_partkey, p_size, p_retailprice FROM part")
def select_types(t):
    return t.part.select(where_type("numeric"))


@query("SELECT s_suppkey, s_name FROM supplier")
def select_helpers(t):
    return t.supplier.select(starts_with("s_supp"), ends_with("_name"))


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def select_range(t):
    return t.orders.select(cols_between("o_orderkey", "o_orderstatus"))


@query("SELECT c_custkey, c_name, c_nationkey FROM customer")
def drop_columns(t):
    return t.customer.drop("c_acctbal", "c_mktsegment").select(exclude("x"))


@query("SELECT n_nationkey AS key, n_name AS name, n_regionkey FROM nation")
def rename_relocate(t):
    return t.nation.rename(key="n_nationkey", name="n_name").relocate("n_regionkey", _before=1)


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct_keys(t):
    return t.orders.distinct("o_orderstatus", "o_orderpriority")


@query("SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) WHERE rn = 1")
def distinct_keep_all(t):
    return t.orders.distinct("o_custkey", keep_all=True)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def arrange_head(t):
    return t.orders.arrange(desc("o_totalprice")).slice_head(20).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 7")
def slice_tail(t):
    return t.orders.slice_tail(7).select("o_orderkey")


@query("SELECT p_partkey, p_size FROM (SELECT *, rank() OVER (ORDER BY p_size DESC) AS r FROM part) WHERE r <= 3")
def slice_max_ties(t):
    return t.part.slice_max("p_size", 3).select("p_partkey", "p_size")


@query("SELECT p_brand, p_partkey, p_retailprice FROM (SELECT *, rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) AS r FROM part) WHERE r <= 2")
def slice_min_grouped(t):
    return t.part.group_by("p_brand").slice_min("p_retailprice", 2).select("p_partkey", "p_retailprice")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) WHERE r <= 2")
def slice_head_grouped(t):
    return t.events.group_by("user_id").slice_head(2).select("event_id")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 2")
def slice_tail_grouped(t):
    return t.events.group_by("user_id").slice_tail(2).select("event_id")


@query("SELECT 100 AS n")
def slice_sample_size(t):
    return t.orders.slice_sample(100, seed=1).df.agg(F.count("*").cast("int").alias("n"))


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey <> 5")
def na_omit(t):
    return t.customer.select("c_custkey", c_nationkey=w.na_if("c_nationkey", 5)).na_omit()


# ---------------------------------------------------------------- groups
@query("""SELECT p_brand, avg(p_retailprice) AS mean, median(p_retailprice) AS median, stddev_samp(p_retailprice) AS sd, var_samp(p_retailprice) AS var,
                 quantile_cont(p_retailprice, 0.75) - quantile_cont(p_retailprice, 0.25) AS iqr, min(p_retailprice) AS lo, max(p_retailprice) AS hi,
                 count(DISTINCT p_size) AS sizes, count(*) AS n FROM part GROUP BY p_brand""")
def summarize_statistics(t):
    x = "p_retailprice"
    return t.part.group_by("p_brand").summarize(mean=st.mean(x), median=st.median(x), sd=st.sd(x), var=st.var(x), iqr=st.IQR(x), lo=st.min_(x), hi=st.max_(x), sizes=n_distinct("p_size"), n=n())


@query("SELECT c_nationkey, CASE WHEN count(*) FILTER (c_mktsegment = 'BUILDING') > 0 THEN NULL ELSE sum(c_acctbal) END AS strict, sum(c_acctbal) FILTER (c_mktsegment <> 'BUILDING') AS loose FROM customer GROUP BY c_nationkey")
def summarize_na_rules(t):
    f = t.customer.mutate(x=k.if_else(col("c_mktsegment") == "BUILDING", None, col("c_acctbal")))
    return f.group_by("c_nationkey").summarize(strict=st.sum_("x", na_rm=False), loose=st.sum_("x"))


@query("SELECT corr(l_quantity, l_extendedprice) AS cor, covar_samp(l_quantity, l_extendedprice) AS cov, quantile_cont(l_quantity, 0.9) AS q90 FROM lineitem")
def summarize_pairs(t):
    return t.lineitem.summarize(cor=st.cor("l_quantity", "l_extendedprice"), cov=st.cov("l_quantity", "l_extendedprice"), q90=st.quantile("l_quantity", 0.9))


@query("SELECT l_returnflag, sum(l_quantity) AS n FROM lineitem GROUP BY l_returnflag")
def count_weighted(t):
    return t.lineitem.count("l_returnflag", wt="l_quantity")


@query("SELECT o_totalprice > 100000 AS big, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL")
def count_derived(t):
    return t.orders.count("o_orderstatus", big=col("o_totalprice") > 100000)


@query("SELECT o_orderkey, o_totalprice - avg(o_totalprice) OVER (PARTITION BY o_custkey) AS dev, o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey) AS share FROM orders")
def grouped_mutate(t):
    g = t.orders.group_by("o_custkey").mutate(dev=col("o_totalprice") - st.mean("o_totalprice"), share=col("o_totalprice") / st.sum_("o_totalprice"))
    return g.ungroup().select("o_orderkey", "dev", "share")


@query("SELECT o_orderkey, o_custkey FROM orders QUALIFY o_totalprice = max(o_totalprice) OVER (PARTITION BY o_custkey) AND count(*) OVER (PARTITION BY o_custkey) > 5")
def grouped_filter(t):
    return t.orders.group_by("o_custkey").filter(col("o_totalprice") == st.max_("o_totalprice"), n() > 5).ungroup().select("o_orderkey", "o_custkey")


@query("""SELECT o_custkey, min_by(o_totalprice, o_orderkey) AS first, max_by(o_totalprice, o_orderkey) AS last,
                 list(o_totalprice ORDER BY o_orderkey)[2] AS second FROM orders GROUP BY o_custkey""")
def summarize_positions(t):
    return t.orders.group_by("o_custkey").summarize(first=w.first("o_totalprice"), last=w.last("o_totalprice"), second=w.nth("o_totalprice", 1))


# ---------------------------------------------------------------- windows
@query("""SELECT p_partkey, rank() OVER (ORDER BY p_size) - 1 AS mr, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) - 1 AS dr,
                 percent_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS pr, cume_dist() OVER (PARTITION BY p_brand ORDER BY p_size) AS cd,
                 ntile(4) OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) - 1 AS nt,
                 row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS rn,
                 rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2 AS ar FROM part""")
def ranks(t):
    f = t.part.mutate(mr=w.min_rank("p_size"))
    g = f.group_by("p_brand").mutate(dr=w.dense_rank("p_size"), pr=w.percent_rank("p_size"), cd=w.cume_dist("p_size"), nt=w.ntile("p_size", 4), rn=w.row_number(), ar=w.rank("p_size"))
    return g.ungroup().select("p_partkey", "mr", "dr", "pr", "cd", "nt", "rn", "ar")


@query("""SELECT event_id, CASE WHEN x IS NOT NULL THEN rank() OVER (PARTITION BY user_id, x IS NULL ORDER BY x) - 1 END AS r
          FROM (SELECT *, nullif(event_type, 'click') AS x FROM events)""")
def ranks_with_nulls(t):
    return t.events.mutate(x=w.na_if("event_type", "click")).group_by("user_id").mutate(r=w.min_rank("x")).ungroup().select("event_id", "r")


@query("""SELECT event_id, lag(value) OVER o AS prev, lead(value, 2, -1) OVER o AS next2, value - lag(value) OVER o AS change FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts)""")
def shifts(t):
    f = Frame(t.events.df, [("ts", False)])
    return f.group_by("user_id").mutate(prev=w.lag("value"), next2=w.lead("value", 2, -1.0), change=w.diff("value")).ungroup().select("event_id", "prev", "next2", "change")


@query("""SELECT event_id, CAST(sum(cents) OVER o AS BIGINT) AS cs, max(value) OVER o AS cx, min(value) OVER o AS cn, avg(cents) OVER o AS cm,
                 bool_and(value > 5) OVER o AS al, bool_or(value > 400) OVER o AS an
          FROM (SELECT *, CAST(round(value * 100) AS BIGINT) AS cents FROM events) WINDOW o AS (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING)""")
def running_values(t):
    g = Frame(t.events.df, [("ts", False)]).mutate(cents=half_up(col("value") * 100, 0).cast("bigint")).group_by("user_id")
    g = g.mutate(cs=w.cumsum("cents"), cx=w.cummax("value"), cn=w.cummin("value"), cm=w.cummean("cents"), al=w.cumall(col("value") > 5), an=w.cumany(col("value") > 400))
    return g.ungroup().select("event_id", "cs", "cx", "cn", "cm", "al", "an")


@query("""SELECT event_id, CAST(sum(c) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM (
            SELECT *, CASE WHEN row_number() OVER o = 1 OR event_type = lag(event_type) OVER o THEN 0 ELSE 1 END AS c FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts))""")
def runs(t):
    return Frame(t.events.df, [("ts", False)]).group_by("user_id").mutate(run=w.consecutive_id("event_type")).ungroup().select("event_id", "run")


@query("""SELECT event_id, CAST(sum(c) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM (
            SELECT *, CASE WHEN epoch_us(ts) - coalesce(epoch_us(lag(ts) OVER o), epoch_us(ts)) >= 3600000000 THEN 1 ELSE 0 END AS c FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts))""")
def sessions_by_gap(t):
    f = Frame(t.events.df.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))), [("ts", False)])
    g = f.group_by("user_id").mutate(session=w.cumsum(col("us") - w.lag("us", 1, col("us")) >= 3600000000))
    return g.ungroup().select("event_id", "session")


@query("""SELECT event_id, last_value(x IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS x
          FROM (SELECT *, CASE WHEN value > 50 THEN value END AS x FROM events)""")
def fill_down(t):
    f = t.events.mutate(x=k.if_else(col("value") > 50, col("value"), None)).group_by("user_id").fill("x")
    return f.ungroup().select("event_id", "x")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders")
def row_index(t):
    return t.orders.with_row_index("i").select("o_orderkey", "i")


# ---------------------------------------------------------------- joins
_BIG = "(SELECT * FROM orders WHERE o_totalprice > 250000)"


def _big(t):
    return t.orders.filter(col("o_totalprice") > 250000)


@query(f"SELECT c_custkey, c_name, o_orderkey FROM customer JOIN {_BIG} ON c_custkey = o_custkey")
def join_inner(t):
    return j.inner_join(t.customer, _big(t), {"c_custkey": "o_custkey"}).select("c_custkey", "c_name", "o_orderkey")


@query(f"SELECT c_custkey, o_orderkey FROM customer LEFT JOIN {_BIG} ON c_custkey = o_custkey")
def join_left(t):
    return j.left_join(t.customer, _big(t), {"c_custkey": "o_custkey"}).select("c_custkey", "o_orderkey")


@query("SELECT o_custkey AS c_custkey, o_orderkey, c_name FROM (SELECT * FROM customer WHERE c_acctbal > 5000) RIGHT JOIN orders ON c_custkey = o_custkey")
def join_right(t):
    return j.right_join(t.customer.filter(col("c_acctbal") > 5000), t.orders, {"c_custkey": "o_custkey"}).select("c_custkey", "o_orderkey", "c_name")


@query(f"SELECT coalesce(c_custkey, o_custkey) AS c_custkey, c_name, o_orderkey FROM (SELECT * FROM customer WHERE c_acctbal > 5000) FULL JOIN {_BIG} ON c_custkey = o_custkey")
def join_full(t):
    return j.full_join(t.customer.filter(col("c_acctbal") > 5000), _big(t), {"c_custkey": "o_custkey"}).select("c_custkey", "c_name", "o_orderkey")


@query(f"SELECT c_custkey FROM customer SEMI JOIN {_BIG} ON c_custkey = o_custkey")
def join_semi(t):
    return j.semi_join(t.customer, _big(t), {"c_custkey": "o_custkey"}).select("c_custkey")


@query(f"SELECT c_custkey FROM customer ANTI JOIN {_BIG} ON c_custkey = o_custkey")
def join_anti(t):
    return j.anti_join(t.customer, _big(t), {"c_custkey": "o_custkey"}).select("c_custkey")


@query("SELECT a.s_suppkey, b.c_custkey FROM (SELECT s_suppkey, nullif(s_nationkey, 1) AS k FROM supplier) a JOIN (SELECT c_custkey, nullif(c_nationkey, 1) AS k FROM customer) b ON a.k IS NOT DISTINCT FROM b.k")
def join_null_keys(t):
    a, b = t.supplier.select("s_suppkey", k=w.na_if("s_nationkey", 1)), t.customer.select("c_custkey", k=w.na_if("c_nationkey", 1))
    return j.inner_join(a, b, "k").select("s_suppkey", "c_custkey")


@query("SELECT r_name, n_name FROM region, nation")
def join_cross(t):
    return j.cross_join(t.region, t.nation).select("r_name", "n_name")


@query("""SELECT a.p_partkey AS "p_partkey.x", b.p_partkey AS "p_partkey.y" FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_retailprice < b.p_retailprice AND a.p_size = b.p_size""")
def join_inequality(t):
    f = t.part.select("p_partkey", "p_brand", "p_size", "p_retailprice")
    g = f.rename(price2="p_retailprice")
    return j.inner_join(f, g, j.join_by("p_brand", "p_size", col("p_retailprice") < col("price2"))).select("p_partkey.x", "p_partkey.y")


@query("""SELECT e.event_id, o.event_id AS prior FROM events e ASOF JOIN (SELECT * FROM events WHERE event_type = 'purchase') o ON e.user_id = o.user_id AND e.ts >= o.ts""")
def join_rolling(t):
    e = t.events.select("event_id", "user_id", "ts")
    o = t.events.filter(event_type="purchase").select("user_id", prior="event_id", pts="ts")
    return j.inner_join(e, o, j.join_by("user_id", j.closest(col("ts") >= col("pts")))).select("event_id", "prior")


@query("""SELECT a.s_suppkey, b.p_partkey FROM (SELECT s_suppkey, s_acctbal AS lo, s_acctbal + 50 AS hi FROM supplier) a JOIN (SELECT p_partkey, p_retailprice AS lo2, p_retailprice + 20 AS hi2 FROM part) b ON a.lo <= b.hi2 AND b.lo2 <= a.hi""")
def join_overlaps(t):
    a = t.supplier.select("s_suppkey", lo="s_acctbal", hi=col("s_acctbal") + 50)
    b = t.part.select("p_partkey", lo2="p_retailprice", hi2=col("p_retailprice") + 20)
    return j.range_join(a, b, ("lo", "hi"), ("lo2", "hi2"), 100.0).select("s_suppkey", "p_partkey")


# ---------------------------------------------------------------- reshape and tables
@query("SELECT p_partkey, name, value FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS size, p_retailprice AS price FROM part) UNPIVOT (value FOR name IN (size, price))")
def longer(t):
    return r.pivot_longer(t.part.select("p_partkey", size=col("p_size").cast("double"), price="p_retailprice"), ["size", "price"])


@query("""SELECT l_returnflag, 'qty' AS what, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY 1 UNION ALL
          SELECT l_returnflag, 'tax', min(l_tax), max(l_tax) FROM lineitem GROUP BY 1""")
def longer_value(t):
    f = t.lineitem.group_by("l_returnflag").summarize(lo_qty=st.min_("l_quantity"), hi_qty=st.max_("l_quantity"), lo_tax=st.min_("l_tax"), hi_tax=st.max_("l_tax"))
    return r.pivot_longer(f, exclude("l_returnflag"), names_to=[".value", "what"], names_sep="_")


@query("SELECT o_orderstatus, count(*) FILTER (o_orderpriority = '1-URGENT') AS p_1, count(*) FILTER (o_orderpriority = '5-LOW') AS p_5 FROM orders GROUP BY 1")
def wider(t):
    f = t.orders.filter(col("o_orderpriority").is_in(["1-URGENT", "5-LOW"])).count("o_orderstatus", "o_orderpriority").mutate(p=s.str_sub("o_orderpriority", 0, 1)).drop("o_orderpriority")
    out = r.pivot_wider(f, id_cols="o_orderstatus", names_from="p", values_from="n", names_prefix="p_", values_fill=0)
    return out.select("o_orderstatus", "p_1", "p_5")


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def rollup_counts(t):
    return r.rollup(t.orders, ["o_orderstatus", "o_orderpriority"], n=n())


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube_counts(t):
    return r.cube(t.orders, ["o_orderstatus", "o_orderpriority"], n=n())


@query("SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS F, count(*) FILTER (l_linestatus = 'O') AS O, count(*) AS Sum FROM lineitem GROUP BY l_returnflag UNION ALL SELECT 'Sum', count(*) FILTER (l_linestatus = 'F'), count(*) FILTER (l_linestatus = 'O'), count(*) FROM lineitem")
def table_margins(t):
    return r.addmargins(r.table(t.lineitem, "l_returnflag", "l_linestatus"))


@query("SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') / count(*) AS F, count(*) FILTER (l_linestatus = 'O') / count(*) AS O FROM lineitem GROUP BY l_returnflag")
def table_shares(t):
    return r.prop_table(r.table(t.lineitem, "l_returnflag", "l_linestatus"), margin=1)


@query("SELECT l_returnflag, round(sum(l_quantity) FILTER (l_linestatus = 'F'), 2) AS F, round(sum(l_quantity) FILTER (l_linestatus = 'O'), 2) AS O FROM lineitem GROUP BY l_returnflag")
def table_weighted(t):
    return r.xtabs(t.lineitem, "l_quantity", "l_returnflag", "l_linestatus")


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union(t):
    return r.union(t.customer.select(k="c_nationkey"), t.supplier.select(k="s_nationkey"))


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def set_intersect(t):
    return r.intersect(t.customer.select(k="c_nationkey"), t.supplier.filter(col("s_acctbal") > 5000).select(k="s_nationkey"))


@query("SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000")
def set_difference(t):
    return r.setdiff(t.customer.select(k="c_nationkey"), t.supplier.filter(col("s_acctbal") > 8000).select(k="s_nationkey"))


@query("SELECT p_partkey, CASE WHEN p_brand = 'Brand#11' THEN 1 ELSE 0 END AS b11 FROM part")
def dummies(t):
    f = t.part.select("p_partkey", b=k.if_else(col("p_brand") == "Brand#11", "11", "other"))
    return r.to_dummies(f, "b").select("p_partkey", b11="b_11")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS ts, count(*) AS n, round(sum(value), 2) AS v FROM events GROUP BY 1")
def dynamic_groups(t):
    f = Frame(t.events.df.withColumn("ts", F.col("ts").cast("timestamp")))
    out = r.group_by_dynamic(f, "ts", "1 hour", n=n(), v=half_up(st.sum_("value"), 2))
    return out.df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '86399.999999' SECOND PRECEDING AND CURRENT ROW) AS n FROM events")
def rolling_counts(t):
    return r.rolling(t.events, "ts", 86400, ["user_id"], n=n()).select("event_id", "n")


# ---------------------------------------------------------------- scalars
@query("""SELECT c_custkey, CAST(regexp_extract(c_name, '(\\d+)', 1) AS DOUBLE) AS num, upper(c_mktsegment) AS up, length(c_name) AS len, substr(c_name, 1, 4) AS head,
                 substr(c_name, length(c_name) - 2, 3) AS tail, c_name || '-' || c_mktsegment AS joined, regexp_matches(c_mktsegment, '^(AUTO|BUILD)') AS hit FROM customer""")
def strings(t):
    return t.customer.select(
        "c_custkey", num=s.parse_number("c_name"), up=s.str_to_upper("c_mktsegment"), len=s.str_length("c_name"), head=s.str_sub("c_name", 0, 4), tail=s.str_sub("c_name", -3),
        joined=s.str_c(col("c_name"), col("c_mktsegment"), sep="-"), hit=s.str_detect("c_mktsegment", "^(AUTO|BUILD)"),
    )


@query("SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_nationkey) AS names FROM nation GROUP BY n_regionkey")
def flatten(t):
    return t.nation.group_by("n_regionkey").summarize(names=s.str_flatten("n_name", ", "))


@query("SELECT o_orderkey, strftime(o_orderdate + INTERVAL 1 DAY, '%Y-%m-%d') AS d FROM orders")
def dates(t):
    return t.orders.mutate(txt=col("o_orderdate").cast("date").cast("string")).select("o_orderkey", d=compose(lambda a: F.date_add(a, 1), s.ymd("txt")).cast("string"))


@query("""SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS size, ln(p_retailprice) AS ln, sqrt(p_size) AS root,
                 floor(p_retailprice / 7) AS fl, round_even(p_retailprice, 1) AS rd, p_size BETWEEN 5 AND 9 AS mid, greatest(p_size, 20) AS big FROM part""")
def scalars(t):
    size = col("p_size")
    return t.part.select(
        "p_partkey", size=k.case_when((size < 10, "small"), (size < 30, "medium"), default="large"), ln=k.log("p_retailprice"), root=k.sqrt("p_size"),
        fl=k.floor(col("p_retailprice") / 7), rd=k.round_("p_retailprice", 1), mid=w.between("p_size", 5, 9), big=k.max_horizontal(size, lit(20)),
    )


@query("SELECT p_partkey, CASE WHEN p_size <= 10 THEN '(0,10]' WHEN p_size <= 25 THEN '(10,25]' ELSE '(25,50]' END AS bin, CASE WHEN p_size >= 40 THEN 3 WHEN p_size >= 20 THEN 2 WHEN p_size >= 10 THEN 1 ELSE 0 END AS i FROM part")
def cuts(t):
    return t.part.select("p_partkey", bin=k.cut("p_size", [0, 10, 25, 50]), i=k.findInterval("p_size", [10, 20, 40]))


@query("SELECT o_orderstatus, count(*) AS n FROM (SELECT CASE WHEN o_orderstatus = 'P' THEN 'Other' ELSE o_orderstatus END AS o_orderstatus FROM orders) GROUP BY 1")
def factor_lump(t):
    return fct.fct_collapse(t.orders, "o_orderstatus", "Other", F="F", O="O").count("o_orderstatus")


@query("SELECT p_partkey, 1 - exp(-p_size * 0.1) AS pe, exp(-power((p_size - 25) / 10.0, 2) / 2) / (10 * sqrt(2 * pi())) AS dn FROM part")
def distributions(t):
    return t.part.select("p_partkey", pe=d.pexp("p_size", 0.1), dn=d.dnorm("p_size", 25, 10))


# ---------------------------------------------------------------- layers
@query("""WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) AS lower, quantile_cont(l_extendedprice, 0.5) AS middle, quantile_cont(l_extendedprice, 0.75) AS upper FROM lineitem GROUP BY 1)
          SELECT l.l_returnflag, any_value(lower) AS lower, any_value(middle) AS middle, any_value(upper) AS upper,
                 min(l_extendedprice) FILTER (l_extendedprice >= lower - 1.5 * (upper - lower)) AS ymin, max(l_extendedprice) FILTER (l_extendedprice <= upper + 1.5 * (upper - lower)) AS ymax, count(*) AS n
          FROM lineitem l JOIN q ON l.l_returnflag = q.l_returnflag GROUP BY 1""")
def box_plot(t):
    return layers.stat_boxplot(t.lineitem, "l_extendedprice", ["l_returnflag"]).select("l_returnflag", "lower", "middle", "upper", "ymin", "ymax", "n")


@query("SELECT b AS bin, count(v) AS count FROM range(10) g(b) LEFT JOIN (SELECT least(greatest(ceil(l_quantity / 5) - 1, 0), 9) AS v FROM lineitem) ON v = b GROUP BY b")
def histogram(t):
    return layers.stat_bin(t.lineitem, "l_quantity", breaks=[5.0 * i for i in range(11)]).select("bin", "count").mutate(bin=col("bin").cast("bigint"))


@query("SELECT o_orderpriority, count(*) AS count, count(*) / sum(count(*)) OVER () AS prop FROM orders GROUP BY 1")
def count_layer(t):
    return layers.stat_count(t.orders, "o_orderpriority")


@query("SELECT p_retailprice, row_number() OVER (ORDER BY p_retailprice) / count(*) OVER () AS ecdf FROM part")
def ecdf(t):
    return layers.stat_ecdf(t.part, "p_retailprice").select("p_retailprice", "ecdf")


@query("SELECT p_brand, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice) / count(*) OVER (PARTITION BY p_brand) AS ecdf FROM part")
def ecdf_with_ties(t):
    return layers.stat_ecdf(t.part, "p_retailprice", ["p_brand"]).select("p_brand", "p_retailprice", "ecdf")


@query("SELECT p_brand, avg(p_retailprice) AS y, avg(p_retailprice) - stddev_samp(p_retailprice) / sqrt(count(*)) AS ymin, avg(p_retailprice) + stddev_samp(p_retailprice) / sqrt(count(*)) AS ymax FROM part GROUP BY 1")
def summary_layer(t):
    return layers.stat_summary(t.part, "p_brand", "p_retailprice")


@query("SELECT p_brand, p_size, CAST(sum(n) OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS BIGINT) AS ymax, CAST(sum(n) OVER (PARTITION BY p_brand ORDER BY p_size DESC) - n AS BIGINT) AS ymin FROM (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY ALL)")
def stacked(t):
    return layers.position_stack(t.part.count("p_brand", "p_size"), "p_brand", "n", "p_size").select("p_brand", "p_size", "ymax", "ymin")


# ---------------------------------------------------------------- frame statistics and models
@query("SELECT count(p_size) AS count, avg(p_size) AS mean, stddev_samp(p_size) AS std, quantile_cont(p_size, 0.25) AS q1 FROM part")
def describe_part(t):
    wide = r.describe(t.part.select("p_size")).df.groupBy().pivot("statistic", ["count", "mean", "std", "25%"]).agg(F.first("p_size"))
    return wide.select(F.col("count").cast("bigint").alias("count"), "mean", "std", F.col("25%").alias("q1"))


@query("SELECT regr_intercept(l_extendedprice, l_quantity) AS a, regr_slope(l_extendedprice, l_quantity) AS b, regr_r2(l_extendedprice, l_quantity) AS r2 FROM lineitem")
def lm_simple(t):
    m = lm("l_extendedprice ~ l_quantity", t.lineitem)
    return _one(t.spark, a=m.beta[0], b=m.beta[1], r2=m.r_squared)


@query("SELECT l_returnflag, avg(l_quantity) AS mean FROM lineitem GROUP BY 1")
def lm_factor(t):
    m = lm("l_quantity ~ l_returnflag - 1", t.lineitem)
    return t.spark.createDataFrame([(name.removeprefix("l_returnflag"), float(b)) for name, b in m.coefficients().items()], "l_returnflag string, mean double")


@query("SELECT l_returnflag, ln(avg(l_quantity)) AS eta FROM lineitem GROUP BY 1")
def glm_poisson(t):
    m = glm("l_quantity ~ 0 + l_returnflag", t.lineitem, poisson())
    return _levels(t, m)


@query("SELECT l_returnflag, ln(avg(CAST(l_linestatus = 'F' AS INT)) / (1 - avg(CAST(l_linestatus = 'F' AS INT)))) AS eta FROM lineitem WHERE l_shipdate < TIMESTAMP '2100-01-01' GROUP BY 1")
def glm_binomial(t):
    f = Frame(t.lineitem.df.withColumn("hit", (F.col("l_linestatus") == "F").cast("int")))
    m = glm("hit ~ 0 + l_returnflag", f, binomial())
    return _levels(t, m)


@query("SELECT l_returnflag, 1 / avg(l_extendedprice) AS eta FROM lineitem GROUP BY 1")
def glm_gamma(t):
    m = glm("l_extendedprice ~ 0 + l_returnflag", t.lineitem, Gamma())
    return _levels(t, m)


@query("SELECT (avg(c_acctbal) - 4500) / (stddev_samp(c_acctbal) / sqrt(count(*))) AS t, CAST(count(*) - 1 AS DOUBLE) AS df FROM customer")
def t_test_one(t):
    h = htest.t_test(t.customer, "c_acctbal", mu=4500)
    return _one(t.spark, t=h.statistic, df=h.parameter)


@query("""WITH c AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS o FROM orders GROUP BY ALL), m AS (SELECT *, sum(o) OVER (PARTITION BY a) * sum(o) OVER (PARTITION BY b) / sum(o) OVER () AS e FROM c)
          SELECT sum((o - e) * (o - e) / e) AS x2 FROM m""")
def chi_square(t):
    return _one(t.spark, x2=htest.chisq_test(t.orders, "o_orderstatus", "o_orderpriority").statistic)


@query("""WITH r AS (SELECT p_brand, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2 AS r FROM part),
               g AS (SELECT p_brand, sum(r) AS s, count(*) AS n FROM r GROUP BY 1), t AS (SELECT sum(c * c * c - c) AS ties FROM (SELECT count(*)::DOUBLE AS c FROM part GROUP BY p_retailprice)), nn AS (SELECT count(*)::DOUBLE AS n FROM part)
          SELECT (12 / (nn.n * (nn.n + 1)) * (SELECT sum(s * s / n) FROM g) - 3 * (nn.n + 1)) / (1 - ties / (nn.n * nn.n * nn.n - nn.n)) AS h FROM t, nn""")
def kruskal(t):
    return _one(t.spark, h=htest.kruskal_test(t.part, "p_retailprice", "p_brand").statistic)


@query("""WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS a, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2 AS b FROM lineitem)
          SELECT corr(a, b) AS rho FROM r""")
def spearman(t):
    return _one(t.spark, rho=htest.cor_test(t.lineitem, "l_quantity", "l_extendedprice", "spearman").estimate["rho"])


@query("SELECT l_returnflag AS term, sum(q) AS ss FROM (SELECT 'l_returnflag' AS l_returnflag, (m - a) * (m - a) * n AS q FROM (SELECT l_returnflag, avg(l_quantity) AS m, count(*) AS n, (SELECT avg(l_quantity) FROM lineitem) AS a FROM lineitem GROUP BY 1)) GROUP BY 1")
def anova_one_way(t):
    table = selection.anova(lm("l_quantity ~ l_returnflag", t.lineitem))
    return t.spark.createDataFrame([(table[0]["term"], float(table[0]["sum_sq"]))], "term string, ss double")


# ---------------------------------------------------------------- more of the surface
@query("SELECT c_custkey, coalesce(nullif(c_nationkey, 3), -1) AS k, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS seg FROM customer")
def fill_values(t):
    f = t.customer.select("c_custkey", k=w.na_if("c_nationkey", 3), seg=w.na_if("c_mktsegment", "BUILDING"))
    return f.fill_null(-1).fill_null("none")


@query("SELECT o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1")
def unique_last(t):
    return t.orders.unique("o_custkey", keep="last").select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, lag(o_totalprice, 2) OVER (ORDER BY o_orderkey) AS o_totalprice FROM orders")
def shift_rows(t):
    return t.orders.select("o_orderkey", "o_totalprice").shift(2)


@query("SELECT o_orderkey FROM orders QUALIFY (row_number() OVER (ORDER BY o_orderkey) - 1) % 7 = 2")
def every_seventh(t):
    return t.orders.gather_every(7, 2).select("o_orderkey")


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 5")
def top_rows(t):
    return t.part.top_k(5, "p_retailprice").select("p_partkey", "p_retailprice")


@query("SELECT CAST(sum(l_linenumber) AS BIGINT) AS l_linenumber, count(DISTINCT l_partkey) AS parts FROM lineitem")
def frame_totals(t):
    a, b = t.lineitem.select("l_linenumber").sum(), t.lineitem.select(parts="l_partkey").n_unique()
    return j.cross_join(a, b)


@query("SELECT n_regionkey, n_name FROM nation")
def explode_lists(t):
    f = Frame(t.nation.df.groupBy("n_regionkey").agg(F.collect_list("n_name").alias("n_name")))
    return f.explode("n_name")


@query("SELECT c_custkey, c_acctbal + coalesce(nullif(c_nationkey, 3), 0) AS loose, c_acctbal + nullif(c_nationkey, 3) AS strict FROM customer")
def row_sums(t):
    f = t.customer.mutate(k=w.na_if("c_nationkey", 3))
    return f.select("c_custkey", loose=k.rowSums("c_acctbal", "k", na_rm=True), strict=k.rowSums("c_acctbal", "k"))


@query("SELECT x AS c_nationkey, count(c_custkey) AS n FROM range(30) g(x) LEFT JOIN customer ON c_nationkey = x GROUP BY x")
def tabulated(t):
    return r.tabulate(t.customer, "c_nationkey", 30)


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer")
def updated(t):
    zero = t.customer.filter(col("c_custkey") % 2 == 0).select("c_custkey", c_acctbal=lit(0.0))
    return r.update(t.customer.select("c_custkey", "c_acctbal"), zero, "c_custkey")


@query("SELECT o.o_orderkey, c.c_custkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS i FROM orders) o JOIN (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS i FROM customer) c USING (i)")
def bind_columns(t):
    return r.cbind(t.orders.select("o_orderkey"), t.customer.select("c_custkey"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def bind_whole_tables(t):
    right = Frame(t.orders.df.select(F.col("o_orderkey").alias("key"), "o_totalprice"), [("key", False)])
    return r.cbind(t.orders.select("o_orderkey", "o_custkey"), right).select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT c_nationkey AS k, c_acctbal AS bal FROM customer UNION ALL SELECT s_nationkey, s_acctbal FROM supplier")
def bind_rows(t):
    return r.rbind(t.customer.select(k="c_nationkey", bal="c_acctbal"), t.supplier.select(k="s_nationkey", bal="s_acctbal"))


@query("SELECT 'l_quantity' AS \"column\", corr(l_quantity, l_extendedprice) AS l_extendedprice FROM lineitem UNION ALL SELECT 'l_extendedprice', 1.0")
def correlations(t):
    return r.corr(t.lineitem.select("l_quantity", "l_extendedprice")).select("column", "l_extendedprice")


@query("SELECT lo, hi, count(*) AS n FROM (SELECT quantile_cont(p_retailprice, 0.0) AS lo, quantile_cont(p_retailprice, 0.5) AS hi FROM part) q JOIN part ON p_retailprice <= hi GROUP BY ALL")
def binned_by_number(t):
    lo, hi = t.part.df.agg(F.min("p_retailprice"), F.median("p_retailprice")).first()
    f = fct.cut_number(t.part, "p_retailprice", 2).count("bin")
    return f.filter(s.str_detect("bin", "^\\[")).select(n="n", lo=lit(float(lo)), hi=lit(float(hi)))


@query("SELECT least(greatest(ceil(p_size / 10.0) - 1, 0), 4) * 10 AS lo, count(*) AS n FROM part GROUP BY 1")
def binned_by_width(t):
    f = fct.cut_width(t.part, "p_size", 10, boundary=0).count("bin")
    return f.select("n", lo=s.parse_number(s.str_replace_all("bin", ",.*", ""))).df.select((F.col("lo")).cast("double").alias("lo"), "n")


@query("SELECT n_nationkey, regexp_replace(n_name, '[AEIOU]', '', 'g') AS short, length(n_name) - length(replace(n_name, 'A', '')) AS a, n_name || '/' || n_regionkey AS tag FROM nation")
def more_strings(t):
    return t.nation.select("n_nationkey", short=s.str_replace_all("n_name", "[AEIOU]", ""), a=s.str_count("n_name", "A"), tag=s.str_glue("{n_name}/{n_regionkey}"))


@query("SELECT p_size, p_brand, count(*) AS n, count(*) / (SELECT count(*) FROM part) AS prop FROM part GROUP BY ALL")
def sum_layer(t):
    return layers.stat_sum(t.part, "p_size", "p_brand")


@query("""WITH s AS (SELECT o_orderstatus AS g, count(*) AS n, avg(o_totalprice) AS m, var_samp(o_totalprice) AS v FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1),
               p AS (SELECT max(m) FILTER (g = 'F') - max(m) FILTER (g = 'O') AS d, max(v / n) FILTER (g = 'F') AS a, max(v / n) FILTER (g = 'O') AS b, max(n) FILTER (g = 'F') AS n1, max(n) FILTER (g = 'O') AS n2 FROM s)
          SELECT d / sqrt(a + b) AS t, (a + b) * (a + b) / (a * a / (n1 - 1) + b * b / (n2 - 1)) AS df FROM p""")
def t_test_welch(t):
    h = htest.t_test(t.orders.filter(col("o_orderstatus").is_in(["F", "O"])), "o_totalprice", group="o_orderstatus", var_equal=False)
    return _one(t.spark, t=h.statistic, df=h.parameter)


@query("SELECT var_samp(l_quantity) / var_samp(l_linenumber) AS f FROM lineitem")
def variance_ratio(t):
    return _one(t.spark, f=htest.var_test(t.lineitem, "l_quantity", "l_linenumber").statistic)


@query("""WITH g AS (SELECT count(*)::DOUBLE AS n, var_samp(p_retailprice) AS v FROM part GROUP BY p_brand), s AS (SELECT count(*) AS k, sum(n - 1) AS d, sum((n - 1) * v) AS i, sum((n - 1) * ln(v)) AS l, sum(1 / (n - 1)) AS r FROM g)
          SELECT (d * ln(i / d) - l) / (1 + (r - 1 / d) / (3 * (k - 1))) AS k2 FROM s""")
def bartlett(t):
    return _one(t.spark, k2=htest.bartlett_test(t.part, "p_retailprice", "p_brand").statistic)


@query("""WITH r AS (SELECT o_orderstatus AS g, rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2 AS r FROM orders WHERE o_orderstatus IN ('F', 'O'))
          SELECT sum(r) FILTER (g = 'F') - count(*) FILTER (g = 'F') * (count(*) FILTER (g = 'F') + 1) / 2 AS w FROM r""")
def rank_sum(t):
    return _one(t.spark, w=htest.wilcox_test(t.orders.filter(col("o_orderstatus").is_in(["F", "O"])), "o_totalprice", group="o_orderstatus").statistic)


@query("""WITH b AS (SELECT l_quantity AS v, 1 AS a, 0 AS b FROM lineitem UNION ALL SELECT l_linenumber * 8, 0, 1 FROM lineitem),
               c AS (SELECT v, sum(a) AS a, sum(b) AS b FROM b GROUP BY v), d AS (SELECT sum(a) OVER (ORDER BY v) / sum(a) OVER () - sum(b) OVER (ORDER BY v) / sum(b) OVER () AS d FROM c)
          SELECT max(abs(d)) AS d FROM d""")
def distribution_distance(t):
    f = t.lineitem.mutate(x=(col("l_linenumber") * 8).cast("double"))
    return _one(t.spark, d=htest.ks_test(f, "l_quantity", "x").statistic)


@query("""WITH m AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a, avg(l_quantity) AS mx, regr_sxx(l_extendedprice, l_quantity) AS sxx, count(*) AS n FROM lineitem)
          SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(a + b * l_quantity, 4) AS fit, round(1e6 * (1 / n + (l_quantity - mx) * (l_quantity - mx) / sxx), 4) AS hat FROM lineitem, m""")
def lm_rows(t):
    f = lm("l_extendedprice ~ l_quantity", t.lineitem).augment()
    return f.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", fit=half_up(col(".fitted"), 4), hat=half_up(col(".hat") * 1e6, 4))


@query("SELECT '<none>' AS term, round(sum(pow(l_quantity - m, 2)), 2) AS rss FROM (SELECT l_quantity, avg(l_quantity) OVER (PARTITION BY l_returnflag) AS m FROM lineitem) UNION ALL SELECT 'l_returnflag', round(var_pop(l_quantity) * count(*), 2) FROM lineitem")
def dropped_terms(t):
    rows = selection.drop1(lm("l_quantity ~ l_returnflag", t.lineitem))
    return t.spark.createDataFrame([(x["term"], round(float(x["deviance"]), 2)) for x in rows], "term string, rss double")


@query("SELECT l_returnflag, avg(l_quantity) AS emmean FROM lineitem GROUP BY 1")
def marginal_means(t):
    found = selection.emmeans(lm("l_quantity ~ l_returnflag", t.lineitem), "l_returnflag").means
    return t.spark.createDataFrame([(x["l_returnflag"], float(x["emmean"])) for x in found], "l_returnflag string, emmean double")


@query("SELECT count(*) AS n FROM orders")
def sql_over_self(t):
    return t.orders.sql("SELECT count(*) AS n FROM self")
