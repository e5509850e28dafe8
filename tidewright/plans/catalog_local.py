"""Queries over local regression of large groups and joins on inequalities alone."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import col
from ..models.smooth import stat_smooth
from ..models.vertices import loess_fit
from ..operators import joins as j
from .catalog import query

#: local lines at the places p(g, v, q) over the rows s(g, x, y), tricube weights up to the q-th nearest row
_LINES = """d AS (SELECT p.g, v, q, x, y, abs(x - v) AS d, row_number() OVER (PARTITION BY p.g, v ORDER BY abs(x - v)) AS k FROM p JOIN s ON p.g = s.g),
    h AS (SELECT g, v, max(d) AS h FROM d WHERE k <= q GROUP BY g, v),
    u AS (SELECT d.g, d.v, (x - d.v) / h AS u, y, pow(1 - pow(d / h, 3), 3) AS w FROM d JOIN h ON d.g = h.g AND d.v = h.v WHERE d < h),
    m AS (SELECT g, v, sum(w) AS s0, sum(w * u) AS s1, sum(w * u * u) AS s2, sum(w * y) AS t0, sum(w * u * y) AS t1 FROM u GROUP BY g, v),
    f AS (SELECT g, v, (s2 * t0 - s1 * t1) / (s0 * s2 - s1 * s1) AS f FROM m)"""


@query(f"""WITH s AS (SELECT l_returnflag AS g, l_quantity AS x, l_extendedprice AS y FROM lineitem), b AS (SELECT g, min(x) AS lo, max(x) AS hi, count(*) AS n FROM s GROUP BY g),
    p AS (SELECT g, lo + i / 8.0::DOUBLE * (hi - lo) AS v, floor(0.5 * n + 1e-5) AS q FROM b, range(0, 9) r(i)), {_LINES}
    SELECT g AS l_returnflag, round(v, 6) AS x, round(f, 3) AS y FROM f""")
def loess_of_lines(t):
    """Curves of groups beyond the bound of one task, at the points themselves."""
    out = stat_smooth(t.lineitem, "l_quantity", "l_extendedprice", ["l_returnflag"], n=9, span=0.5, degree=1, surface="direct", most_rows=1000)
    return out.df.select("l_returnflag", F.round("x", 6).alias("x"), F.round("y", 3).alias("y"))


@query(f"""WITH s AS (SELECT 0 AS g, o_custkey::DOUBLE AS x, o_totalprice AS y FROM orders), b AS (SELECT min(x) AS lo, max(x) AS hi, count(*) AS n FROM s),
    e AS (SELECT unnest(quantile_cont(x, [0, 0.25, 0.5, 0.75, 1])) AS v FROM (SELECT DISTINCT x FROM s) UNION ALL SELECT lo + i / 4.0::DOUBLE * (hi - lo) FROM b, range(0, 5) r(i)),
    z AS (SELECT v, v - lag(v) OVER (ORDER BY v) AS gap FROM e), p AS (SELECT 0 AS g, v, floor(0.4 * n + 1e-5) AS q FROM z, b WHERE gap IS NULL OR gap > 1e-6 * (hi - lo)), {_LINES},
    i AS (SELECT v, f, row_number() OVER (ORDER BY v) AS i, count(*) OVER () AS m FROM f),
    g AS (SELECT p.i, p.v, p.f, (b.f - a.f) / (b.v - a.v) + ((c.f - b.f) / (c.v - b.v) - (b.f - a.f) / (b.v - a.v)) / (c.v - a.v) * (2 * p.v - a.v - b.v) AS s
          FROM i p JOIN i a ON a.i = greatest(1, least(p.i - 1, p.m - 2)) JOIN i b ON b.i = a.i + 1 JOIN i c ON c.i = a.i + 2),
    c AS (SELECT a.v AS v, b.v - a.v AS w, a.f AS f0, b.f AS f1, a.s AS s0, b.s AS s1 FROM g a JOIN g b ON b.i = a.i + 1),
    o AS (SELECT o_orderkey, o_totalprice, (o_custkey - c.v) / w AS t, c.* FROM orders ASOF JOIN c ON o_custkey >= c.v),
    r AS (SELECT o_orderkey, o_totalprice, f0 * (2 * t * t * t - 3 * t * t + 1) + f1 * (3 * t * t - 2 * t * t * t) + w * (s0 * (t * t * t - 2 * t * t + t) + s1 * (t * t * t - t * t)) AS y FROM o)
    SELECT o_orderkey, round(y, 3) AS fitted, round(o_totalprice - y, 3) AS resid FROM r""")
def loess_of_orders(t):
    """A fitted value of each row of a whole frame, by cubics between vertices."""
    out = loess_fit(t.orders, "o_custkey", "o_totalprice", span=0.4, degree=1, cells=4)
    return out.df.select("o_orderkey", F.round("`.fitted`", 3).alias("fitted"), F.round("`.resid`", 3).alias("resid"))


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_acctbal > o_totalprice AND c_custkey > o_orderkey")
def unequal_left(t):
    """Pairs of tiles that can meet, and customers without a match by a scan."""
    left, right = t.customer.select("c_custkey", "c_acctbal"), t.orders.select("o_orderkey", "o_totalprice")
    return j.left_join(left, right, j.join_by(col("c_acctbal") > col("o_totalprice"), col("c_custkey") > col("o_orderkey"))).select("c_custkey", "o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders a WHERE NOT EXISTS (SELECT 1 FROM orders b WHERE a.o_orderdate < b.o_orderdate AND a.o_totalprice < b.o_totalprice)")
def unequal_skyline(t):
    """Orders that no later one exceeds, without a pair of rows."""
    prices = t.orders.select(day="o_orderdate", price="o_totalprice")
    return j.anti_join(t.orders, prices, j.join_by(col("o_orderdate") < col("day"), col("o_totalprice") < col("price"))).select("o_orderkey", "o_totalprice")


@query("""SELECT a.o_orderkey FROM orders a WHERE EXISTS (SELECT 1 FROM orders b WHERE a.o_orderdate <= b.o_orderdate AND a.o_totalprice > b.o_totalprice * 80 AND a.o_custkey > b.o_custkey)""")
def unequal_three(t):
    cheap = t.orders.select(day="o_orderdate", price=col("o_totalprice") * 80, who="o_custkey")
    return j.semi_join(t.orders, cheap, j.join_by(col("o_orderdate") <= col("day"), col("o_totalprice") > col("price"), col("o_custkey") > col("who"))).select("o_orderkey")
