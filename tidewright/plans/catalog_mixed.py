"""Queries over mixed models; their SQL solves the mixed model equations of the cells of levels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import col
from ..models.mixed import lme
from .catalog import query
from .catalog_smooths import normal_equations

_CUSTOMERS = """s AS (SELECT c_mktsegment, row_number() OVER (ORDER BY c_mktsegment) - 1 AS seg FROM (SELECT DISTINCT c_mktsegment FROM customer)),
    d AS MATERIALIZED (SELECT c_nationkey * 10 + seg AS x, CAST(count(*) AS DOUBLE) AS n, avg(c_acctbal) AS m FROM customer JOIN s USING (c_mktsegment) GROUP BY 1)"""


@query(f"""WITH {_CUSTOMERS},
    f AS MATERIALIZED (SELECT x, 0 AS i, 1.0::DOUBLE AS b FROM d UNION ALL SELECT x, 1 + CAST(x // 10 AS INTEGER), 0.05 FROM d UNION ALL SELECT x, 26 + CAST(x % 10 AS INTEGER), 0.08 FROM d),
    {normal_equations(31, 'SELECT i, i, 1.0 FROM range(1, 31) t(i)')}
    SELECT CAST(x // 10 AS BIGINT) AS nation, c_mktsegment AS segment, round(fit, 4) AS fit FROM fit JOIN s ON seg = x % 10""")
def crossed_effects(t):
    """Two crossed factors at given covariances: fixed effect and both conditional means, for each cell that occurs."""
    m = lme("c_acctbal ~ (1 | c_nationkey) + (1 | c_mktsegment)", t.customer, theta=[0.05, 0.08])
    u = m.ranef()
    nations, segments = (u[g].df.select(F.col("group").alias(g), F.col("`(Intercept)`").alias(f"u_{g}")) for g in ("c_nationkey", "c_mktsegment"))
    cells = t.customer.distinct("c_nationkey", "c_mktsegment").df.join(F.broadcast(nations), "c_nationkey").join(F.broadcast(segments), "c_mktsegment")
    fit = F.lit(m.fixef()["(Intercept)"]) + F.col("u_c_nationkey") + F.col("u_c_mktsegment")
    return cells.select(F.col("c_nationkey").cast("bigint").alias("nation"), F.col("c_mktsegment").alias("segment"), F.round(fit, 4).alias("fit"))


@query(f"""WITH g AS (SELECT l_returnflag, row_number() OVER (ORDER BY l_returnflag) - 1 AS g FROM (SELECT DISTINCT l_returnflag FROM lineitem)),
    d AS MATERIALIZED (SELECT g * 1000 + CAST(l_quantity AS INTEGER) AS x, CAST(count(*) AS DOUBLE) AS n, avg(l_extendedprice) AS m FROM lineitem JOIN g USING (l_returnflag) GROUP BY 1),
    q AS (SELECT x, x // 1000 AS g, x % 1000 / 50.0 AS q FROM d),
    f AS MATERIALIZED (SELECT x, 0 AS i, 1.0::DOUBLE AS b FROM q UNION ALL SELECT x, 1, q FROM q UNION ALL SELECT x, 2 + 2 * CAST(g AS INTEGER), 0.02 - 0.01 * q FROM q UNION ALL SELECT x, 3 + 2 * CAST(g AS INTEGER), 0.03 * q FROM q),
    {normal_equations(8, 'SELECT i, i, 1.0 FROM range(2, 8) t(i)')}
    SELECT l_returnflag, CAST(x % 1000 AS BIGINT) AS quantity, round(fit, 2) AS fit FROM fit JOIN g ON g = x // 1000""")
def slopes_of_unbalanced_groups(t):
    """Correlated intercepts and slopes of groups of different sizes, at a given covariance."""
    m = lme("l_extendedprice ~ q + (1 + q | l_returnflag)", t.lineitem.mutate(q=col("l_quantity") / 50.0), theta=[0.02, -0.01, 0.03])
    u = m.ranef().df.select(F.col("group").alias("l_returnflag"), F.col("`(Intercept)`").alias("u0"), F.col("q").alias("u1"))
    b = m.fixef()
    rows = t.lineitem.distinct("l_returnflag", "l_quantity").df.join(F.broadcast(u), "l_returnflag")
    q = F.col("l_quantity") / 50.0
    return rows.select("l_returnflag", F.col("l_quantity").cast("bigint").alias("quantity"), F.round(F.lit(b["(Intercept)"]) + F.col("u0") + (F.lit(b["q"]) + F.col("u1")) * q, 2).alias("fit"))
