"""Queries over spline bases and additive models; their SQL solves the normal equations of another basis of the same functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import col
from ..models.additive import anova_gam, gam
from ..models.linear import lm
from .catalog import query


def solved(first: str, size: int) -> str:
    """Common table expressions that solve a system held as (i, j, v), its right side at j = size; the last one is ``beta(i, v)``."""
    steps = []
    for k in range(size):
        now = first if k == 0 else f"{first}{k}"
        steps.append(f"""{first}{k + 1} AS MATERIALIZED (SELECT t.i, t.j, CASE WHEN t.i = {k} THEN t.v / p.v ELSE t.v - c.v * r.v / p.v END AS v
            FROM {now} t JOIN (SELECT v FROM {now} WHERE i = {k} AND j = {k}) p ON true JOIN {now} c ON c.i = t.i AND c.j = {k} JOIN {now} r ON r.i = {k} AND r.j = t.j)""")
    return ", ".join([*steps, f"beta AS (SELECT i, v FROM {first}{size} WHERE j = {size})"])


def normal_equations(size: int, penalty: str = "") -> str:
    """The system of a weighted fit: ``f(x, i, b)`` has the functions, ``d(x, n, m)`` counts and means; ``penalty`` adds (i, j, v) rows."""
    more = f" UNION ALL {penalty}" if penalty else ""
    return f"""e AS MATERIALIZED (SELECT i, j, sum(v) AS v FROM (SELECT a.i, b.i AS j, a.b * b.b * n AS v FROM f a JOIN f b USING (x) JOIN d USING (x)
        UNION ALL SELECT i, {size}, b * n * m FROM f JOIN d USING (x) UNION ALL SELECT i, j, 0.0 FROM range({size}) r(i), range({size + 1}) c(j){more}) GROUP BY i, j), {solved('e', size)},
        fit AS (SELECT x, sum(b * v) AS fit FROM f JOIN beta USING (i) GROUP BY x)"""


_LINES = "d AS MATERIALIZED (SELECT CAST(l_quantity AS DOUBLE) AS x, CAST(count(*) AS DOUBLE) AS n, avg(l_extendedprice) AS m FROM lineitem GROUP BY l_quantity)"


@query(f"""WITH {_LINES}, k AS (SELECT quantile_cont(CAST(l_quantity AS DOUBLE), 0.5) AS k FROM lineitem),
    f AS MATERIALIZED (SELECT x, 0 AS i, 1.0::DOUBLE AS b FROM d UNION ALL SELECT x, 1, x / 25 - 1 FROM d UNION ALL SELECT x, 2, (x / 25 - 1) ** 2 FROM d UNION ALL SELECT x, 3, (x / 25 - 1) ** 3 FROM d
                       UNION ALL SELECT x, 4, greatest((x - k) / 25, 0) ** 3 FROM d, k), {normal_equations(5)}
    SELECT x, round(fit, 2) AS fit FROM fit""")
def b_spline_fit(t):
    m = lm("l_extendedprice ~ bs(l_quantity, df=4)", t.lineitem)
    new = t.lineitem.distinct("l_quantity")
    return m.predict(new).df.select(F.col("l_quantity").cast("double").alias("x"), F.round("fit", 2).alias("fit"))


#: straight outside the end knots: 1, x and differences of truncated cubes, over the knots k(j, k)
_STRAIGHT = """z AS (SELECT max(k) AS z, max(j) AS last FROM k),
    c AS (SELECT x, j, (greatest(x - k, 0) ** 3 - greatest(x - z, 0) ** 3) / (z - k) / 100 AS c FROM (SELECT DISTINCT x FROM d), k, z WHERE j < last),
    f AS MATERIALIZED (SELECT x, 0 AS i, 1.0::DOUBLE AS b FROM d UNION ALL SELECT x, 1, x / 25 - 1 FROM d
                       UNION ALL SELECT a.x, a.j + 2, a.c - b.c FROM c a JOIN c b USING (x), z WHERE b.j = last - 1 AND a.j < last - 1)"""
_PARTS = "d AS MATERIALIZED (SELECT CAST(p_size AS DOUBLE) AS x, CAST(count(*) AS DOUBLE) AS n, avg(p_retailprice) AS m FROM part GROUP BY p_size)"


@query(f"""WITH {_PARTS}, q AS (SELECT quantile_cont(CAST(p_size AS DOUBLE), [0.0, 1 / 3, 2 / 3, 1.0]) AS q FROM part), k AS MATERIALIZED (SELECT unnest(q) AS k, unnest(range(4)) AS j FROM q),
    {_STRAIGHT}, {normal_equations(4)} SELECT x, round(fit, 3) AS fit FROM fit""")
def natural_spline_fit(t):
    m = lm("p_retailprice ~ ns(p_size, df=3)", t.part)
    return m.predict(t.part.distinct("p_size")).df.select(F.col("p_size").cast("double").alias("x"), F.round("fit", 3).alias("fit"))


#: second derivatives of the functions at the knots, and the integrals of their products
_BENDS = """s AS (SELECT a.j, b.j AS pos, b.k, 6 * (greatest(b.k - a.k, 0) - greatest(b.k - z, 0)) / (z - a.k) / 100 AS s FROM k a, k b, z WHERE a.j < last),
    g AS MATERIALIZED (SELECT a.j + 2 AS i, a.pos, a.k, a.s - b.s AS g FROM s a JOIN s b USING (pos), z WHERE b.j = last - 1 AND a.j < last - 1),
    w AS (SELECT a.i, b.i AS j, sum((c.k - a.k) / 6 * (2 * a.g * b.g + a.g * e.g + c.g * b.g + 2 * c.g * e.g)) AS v
          FROM g a JOIN g c ON c.i = a.i AND c.pos = a.pos + 1 JOIN g b ON b.pos = a.pos JOIN g e ON e.i = b.i AND e.pos = a.pos + 1 GROUP BY a.i, b.i)"""


@query(f"""WITH {_PARTS}, q AS (SELECT quantile_cont(x, [0.0, 0.25, 0.5, 0.75, 1.0]) AS q FROM d), k AS MATERIALIZED (SELECT unnest(q) AS k, unnest(range(5)) AS j FROM q),
    {_STRAIGHT}, {_BENDS}, {normal_equations(5, 'SELECT i, j, 50000 * v FROM w')} SELECT x, round(fit, 3) AS fit FROM fit""")
def penalised_smooth(t):
    """A cubic regression smooth at a given smoothing parameter."""
    m = gam("p_retailprice ~ s(p_size, bs='cr', k=5)", t.part, sp=[50000.0], scale_penalty=False)
    return m.predict(t.part.distinct("p_size")).df.select(F.col("p_size").cast("double").alias("x"), F.round("fit", 3).alias("fit"))


@query("""WITH d AS (SELECT p_partkey % 10 AS g, p_size + 3.0 * (p_partkey % 10) AS y FROM part), g AS (SELECT g, avg(y) AS m, count(*)::DOUBLE AS n, var_samp(y) AS v FROM d GROUP BY g),
               s AS (SELECT avg(v) AS mse, any_value(n) AS n, any_value(n) * var_samp(m) AS msb, avg(m) AS mean, count(*)::DOUBLE AS k FROM g)
          SELECT g."g" AS g, round(mean + (m - mean) * (msb - mse) / msb, 3) AS fit, round(mse, 2) AS scale FROM g, s""")
def smooth_random_effects(t):
    """Groups as a penalised term: the penalty that REML chooses gives the shrunken means of the analysis of variance."""
    rows = t.part.select(g=col("p_partkey") % 10, y=col("p_size") + 3.0 * (col("p_partkey") % 10))
    m = gam("y ~ s(factor(g), bs='re')", rows)
    return m.predict(rows.distinct("g")).df.select("g", F.round("fit", 3).alias("fit"), F.lit(round(m.dispersion, 2)).alias("scale"))


@query("""WITH d AS (SELECT CAST(p_size AS DOUBLE) AS x, p_retailprice AS y FROM part), r AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_syy(y, x) - regr_sxy(y, x) ** 2 / regr_sxx(y, x) AS rss, regr_syy(y, x) AS syy, count(*) AS n FROM d)
          SELECT round(n - 1.0, 3) AS resid_df_0, round(syy, 1) AS resid_dev_0, round(n - 2.0, 3) AS resid_df_1, round(rss, 1) AS resid_dev_1 FROM r""")
def additive_models_compared(t):
    """A smooth under an all but infinite penalty is a straight line."""
    rows = anova_gam(gam("p_retailprice ~ 1", t.part), gam("p_retailprice ~ s(p_size, bs='cr', k=6)", t.part, sp=[1e12]))
    values = {f"{c}_{i}": round(r[c], 3 if c == "resid_df" else 1) for i, r in enumerate(rows) for c in ("resid_df", "resid_dev")}
    return t.spark.createDataFrame([tuple(values.values())], [*values])
