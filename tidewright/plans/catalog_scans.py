"""Queries over whole frames in order, and over pairs of rows that are counted, not made."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import window as w
from ..functions.expr import col
from ..models import htest
from ..operators import joins as j
from .catalog import _one, query

_O = "OVER (ORDER BY o_orderkey)"


@query(f"""WITH o AS (SELECT *, nullif(o_orderstatus, 'F') AS open, CASE WHEN o_orderpriority <> '1-URGENT' THEN o_custkey END AS calm FROM orders)
    SELECT o_orderkey, CASE WHEN calm IS NOT NULL THEN CAST(sum(calm) {_O} AS BIGINT) END AS total, CASE WHEN calm IS NOT NULL THEN max(calm) {_O} END AS most, CASE WHEN calm IS NOT NULL THEN min(calm) {_O} END AS least,
    last_value(open IGNORE NULLS) {_O} AS last_open, first_value(open IGNORE NULLS) OVER (ORDER BY o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_open,
    round(avg(o_custkey) {_O}, 6) AS mean FROM o""")
def running_over_all_orders(t):
    rows = t.orders.mutate(open=w.na_if(col("o_orderstatus"), "F"), calm=w.na_if(col("o_orderpriority"), "1-URGENT"))
    rows = rows._new(rows.df.withColumn("calm", F.when(F.col("calm").isNotNull(), F.col("o_custkey"))))
    made = rows.mutate(total=w.cumsum("calm"), most=w.cummax("calm"), least=w.cummin("calm"), last_open=w.fill_forward("open"), next_open=w.fill_backward("open"), mean=w.cummean("o_custkey"))
    return made.df.select("o_orderkey", "total", "most", "least", "last_open", "next_open", F.round("mean", 6).alias("mean"))


@query(f"""WITH o AS (SELECT o_orderkey, o_custkey, o_orderstatus, lag(o_custkey, 5) {_O} AS back, lead(o_custkey, 2, -1) {_O} AS ahead,
    CASE WHEN row_number() {_O} >= 30 THEN avg(o_custkey) OVER (ORDER BY o_orderkey ROWS 29 PRECEDING) END AS month,
    CASE WHEN row_number() {_O} > 1 AND o_orderstatus <> lag(o_orderstatus) {_O} THEN 1 ELSE 0 END AS turn, row_number() {_O} - 1 AS place FROM orders)
    SELECT o_orderkey, back, ahead, round(month, 6) AS month, CAST(sum(turn) {_O} AS BIGINT) AS run, place FROM o""")
def shifts_over_all_orders(t):
    made = t.orders.mutate(back=w.lag("o_custkey", 5), ahead=w.lead("o_custkey", 2, default=-1), month=w.rolling_mean("o_custkey", 30), run=w.consecutive_id("o_orderstatus"), place=w.row_number())
    return made.df.select("o_orderkey", "back", "ahead", F.round("month", 6).alias("month"), "run", "place")


@query("""SELECT p_partkey, row_number() OVER (ORDER BY p_size, p_partkey) - 1 AS place, rank() OVER s - 1 AS low, dense_rank() OVER s - 1 AS dense, round(percent_rank() OVER s, 10) AS share,
    round(cume_dist() OVER s, 10) AS below, ntile(9) OVER (ORDER BY p_size, p_partkey) - 1 AS part, rank() OVER s + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS mean FROM part WINDOW s AS (ORDER BY p_size)""")
def ranks_over_all_parts(t):
    made = t.part.mutate(place=w.row_number("p_size"), low=w.min_rank("p_size"), dense=w.dense_rank("p_size"), share=w.percent_rank("p_size"), below=w.cume_dist("p_size"), part=w.ntile("p_size", 9), mean=w.rank("p_size"))
    return made.df.select("p_partkey", "place", "low", "dense", F.round("share", 10).alias("share"), F.round("below", 10).alias("below"), "part", "mean")


@query("""SELECT o_orderkey, o_totalprice, c_acctbal AS before FROM orders ASOF LEFT JOIN (SELECT DISTINCT c_acctbal FROM customer) ON o_totalprice >= c_acctbal""")
def nearest_without_key(t):
    """A rolling join of whole tables without an equal key."""
    balances = t.customer.distinct("c_acctbal")
    return j.left_join(t.orders, balances, j.join_by(j.closest(col("o_totalprice") >= col("c_acctbal")))).df.select("o_orderkey", "o_totalprice", F.col("c_acctbal").alias("before"))


@query("""WITH p AS (SELECT o_custkey AS x, o_totalprice AS y FROM orders), d AS (SELECT CAST(count(*) AS DOUBLE) AS d FROM p a JOIN p b ON a.x < b.x AND a.y > b.y), n AS (SELECT count(*) * (count(*) - 1) / 2.0 AS n0 FROM p),
    tx AS (SELECT sum(k * (k - 1) / 2.0) AS t FROM (SELECT count(*) AS k FROM p GROUP BY x)), ty AS (SELECT sum(k * (k - 1) / 2.0) AS t FROM (SELECT count(*) AS k FROM p GROUP BY y)),
    b AS (SELECT sum(k * (k - 1) / 2.0) AS t FROM (SELECT count(*) AS k FROM p GROUP BY x, y))
    SELECT round((n0 - tx.t - ty.t + b.t - 2 * d) / sqrt((n0 - tx.t) * (n0 - ty.t)), 10) AS tau FROM d, n, tx, ty, b""")
def kendall_of_orders(t):
    """Some 10^8 pairs at the smallest scale of the check, none of which is made."""
    return _one(t.spark, tau=round(htest.cor_test(t.orders, "o_custkey", "o_totalprice", "kendall").estimate["tau"], 10))
