"""Queries over layer statistics with missing groups, on the default paths of large data."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import window as w
from ..functions.expr import col
from ..operators import build as b
from ..operators import layers
from .catalog import query

_ORDERS = "o AS (SELECT *, nullif(o_orderpriority, '1-URGENT') AS g FROM orders)"


def _orders(t):
    return t.orders.mutate(g=w.na_if(col("o_orderpriority"), "1-URGENT"))


@query(f"""WITH {_ORDERS}, bins AS (SELECT unnest(range(12)) AS bin), groups AS (SELECT DISTINCT g FROM o),
    c AS (SELECT g, CAST(least(greatest(ceil(o_totalprice / 50000) - 1, 0), 11) AS INTEGER) AS bin, count(*) AS n FROM o WHERE o_totalprice BETWEEN 0 AND 600000 GROUP BY ALL)
    SELECT s.g, CAST(s.bin AS INTEGER) AS bin, CAST(coalesce(n, 0) AS BIGINT) AS count FROM (groups CROSS JOIN bins) s LEFT JOIN c ON c.g IS NOT DISTINCT FROM s.g AND c.bin = s.bin""")
def bins_with_missing_group(t):
    out = layers.stat_bin(_orders(t), "o_totalprice", breaks=[50000.0 * i for i in range(13)], group=["g"])
    return out.df.select("g", "bin", "count")


@query(f"""WITH {_ORDERS} SELECT g, o_orderstatus, dense_rank() OVER (ORDER BY g NULLS FIRST, o_orderstatus) AS panel, count(*) AS n FROM o GROUP BY g, o_orderstatus""")
def wrapped_panels_with_nulls(t):
    return layers.facet_wrap(_orders(t), "g", "o_orderstatus").df.groupBy("g", "o_orderstatus", "panel").agg(F.count("*").alias("n"))


@query(f"""WITH {_ORDERS}, r AS (SELECT g, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS r FROM (SELECT DISTINCT g FROM o)), c AS (SELECT h, row_number() OVER (ORDER BY h NULLS FIRST) AS c, count(*) OVER () AS k FROM (SELECT DISTINCT nullif(o_orderstatus, 'P') AS h FROM o))
    SELECT o.g, nullif(o_orderstatus, 'P') AS h, r * k + c AS panel, count(*) AS n FROM o JOIN r ON r.g IS NOT DISTINCT FROM o.g JOIN c ON c.h IS NOT DISTINCT FROM nullif(o_orderstatus, 'P') GROUP BY ALL""")
def panel_grid_with_nulls(t):
    rows = _orders(t).mutate(h=w.na_if(col("o_orderstatus"), "P"))
    return layers.facet_grid(rows, "g", "h").df.groupBy("g", "h", "panel").agg(F.count("*").alias("n"))


_KERNEL = "exp(-pow(x - p_size, 2) / 8) / (2 * sqrt(2 * pi()))"


@query(f"""WITH g AS (SELECT unnest(range(32)) * 128.0 / 31 - 10 AS x) SELECT round(x, 4) AS x, round(sum({_KERNEL}) / count(*), 8) AS density FROM g, part GROUP BY x""")
def density_from_cells(t):
    """The default path spreads values over cells first; here they lie on the cells' edges, so nothing may be lost."""
    out = layers.density(t.part, "p_size", bw=2.0, n=32, from_=-10.0, to=118.0)
    return out.df.select(F.round("x", 4).alias("x"), F.round("density", 8).alias("density"))


@query(f"""WITH p AS (SELECT nullif(p_type, 'ECONOMY') AS g, p_size FROM part), s AS (SELECT g, min(p_size) - 6.0 AS a, max(p_size) + 6.0 AS b FROM p GROUP BY g),
    v AS (SELECT g, a + i * (b - a) / 48 AS x FROM s, (SELECT unnest(range(49)) AS i)),
    d AS (SELECT v.g, x, sum({_KERNEL}) / count(*) AS density, count(*) AS n FROM v JOIN p ON p.g IS NOT DISTINCT FROM v.g GROUP BY v.g, x)
    SELECT g, round(x, 4) AS y, round(density, 7) AS density, round(density * n, 4) AS count FROM d""")
def violins_with_missing_group(t):
    rows = t.part.mutate(g=w.na_if(col("p_type"), "ECONOMY"))
    out = layers.stat_ydensity(rows, "g", "p_size", bw=2.0, n=49)
    return out.df.select("g", F.round("p_size", 4).alias("y"), F.round("density", 7).alias("density"), F.round("count", 4).alias("count"))


@query(f"""WITH {_ORDERS} SELECT o_orderstatus AS x, g AS colour, round(log10(count(*)), 8) AS y FROM o WHERE g IS NOT NULL GROUP BY ALL""")
def bars_on_log_scale(t):
    """Rows without a colour go, as they lack a mapped aesthetic; the counts go on the scale of their axis."""
    plot = b.ggplot(_orders(t), b.aes(x="o_orderstatus", colour="g")).add(b.Layer("count")).scale("y", "log10")
    return b.build(plot).layers[0].df.select("x", "colour", F.round("y", 8).alias("y"))
