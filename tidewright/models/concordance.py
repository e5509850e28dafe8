"""Discordant pairs, counted over range partitions of two orders.

Two rows are discordant if the one comes first by (x, y) and last by (y, x);
rows equal in x or in y are in the same order both ways.  Rows are put into
range partitions of either order.  A pair of rows differs in both partitions,
which a table of counts settles, or shares one of them, and then a task that
holds that partition counts it.  No pairs are made.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranges import ranged

#: Range partitions of an order beyond which the table of counts is not put together on the driver.
MOST_PARTITIONS = 5000


def weighted_inversions(values: np.ndarray, weights: np.ndarray) -> float:
    """Sum of the products of weights over pairs whose earlier value is the larger; values are different.

    At each level, positions fall into blocks of two halves.  In descending
    order of values within a block, the weight of the left half so far is that
    of the larger values to the left.
    """
    if len(values) < 2:
        return 0.0
    down = np.argsort(-values, kind="stable")
    total = 0.0
    for level in range(1, int(len(values) - 1).bit_length() + 1):
        at = down[np.argsort(down >> level, kind="stable")]
        left = (at >> (level - 1)) & 1 == 0
        w = weights[at]
        so_far = np.cumsum(np.where(left, w, 0.0))
        block = at >> level
        starts = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
        before = np.concatenate(([0.0], so_far))[starts]
        larger = so_far - np.repeat(before, np.diff(np.append(starts, len(at))))
        total += float(np.dot(np.where(left, 0.0, w), larger))
    return total


def _within(cells: DataFrame, group: str, first: str, second: str) -> float:
    """Discordant pairs of rows in the same partition of one order, by their places in both."""

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([first, second])
        return pd.DataFrame({"d": [weighted_inversions(rows[second].to_numpy(), rows["n"].to_numpy(dtype=np.float64))]})

    return cells.groupBy(group).applyInPandas(count, "d double").agg(F.sum("d")).first()[0] or 0.0


def discordant(cells: DataFrame) -> float:
    """Discordant pairs of the rows that cells (x, y, n) stand for; each (x, y) is there once, without nulls."""
    by_x = ranged(cells, F.col("x"), F.col("y")).withColumnsRenamed({"__p": "px", "__i": "ix"})
    both = ranged(by_x, F.col("y"), F.col("x")).withColumnsRenamed({"__p": "py", "__i": "iy"})
    px, py = both.agg(F.max("px"), F.max("py")).first()
    if px is None:
        return 0.0
    if max(px, py) >= MOST_PARTITIONS:
        raise ValueError(f"more than {MOST_PARTITIONS} range partitions; lower spark.sql.shuffle.partitions")
    table = np.zeros((px + 2, py + 2))
    for i, j, n in both.groupBy("px", "py").agg(F.sum("n")).collect():
        table[i + 1, j] = n
    # weight of the cells of smaller px and larger py than each
    smaller = np.cumsum(table, axis=0)
    corner = np.cumsum(smaller[:, ::-1], axis=1)[:, ::-1]
    apart = float((table[1:-1, :-1] * corner[:-2, 1:]).sum())
    places = both.withColumn("y_place", F.shiftleft(F.col("py").cast("bigint"), 33) + F.col("iy"))
    return apart + _within(places, "px", "ix", "y_place") + _within(both, "py", "px", "iy")
