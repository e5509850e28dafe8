"""Discordant pairs against all pairs."""

import math
import random

import numpy as np
import pytest

from tidewright.models import htest
from tidewright.models.concordance import weighted_inversions
from tidewright.operators.frame import Frame


@pytest.mark.parametrize("size", [0, 1, 2, 3, 8, 9, 257])
def test_inversions(size):
    rng = np.random.default_rng(size)
    values, weights = rng.permutation(size * 3)[:size], rng.integers(1, 9, size).astype(float)
    want = sum(weights[i] * weights[k] for k in range(size) for i in range(k) if values[i] > values[k])
    assert weighted_inversions(values, weights) == want


def plain(rows):
    sign = lambda a: (a > 0) - (a < 0)
    score = tx = ty = 0
    for k, (x, y) in enumerate(rows):
        for a, b in rows[:k]:
            score += sign(x - a) * sign(y - b)
            tx += x == a
            ty += y == b
    n0 = len(rows) * (len(rows) - 1) / 2
    return score / math.sqrt((n0 - tx) * (n0 - ty))


@pytest.mark.parametrize("kind", ["ties", "hot x", "different"])
def test_tau(spark, kind):
    rng = random.Random(2)
    rows = {
        "ties": [(rng.randrange(6), rng.randrange(5)) for _ in range(150)],
        "hot x": [(0 if i % 3 else i, rng.randrange(99)) for i in range(200)],
        "different": [(i, (i * 37) % 211) for i in range(211)],
    }[kind]
    frame = Frame(spark.createDataFrame([*rows, (None, 1), (2, None)], "x int, y int"))
    assert htest.cor_test(frame, "x", "y", "kendall").estimate["tau"] == pytest.approx(plain(rows))


def test_tau_without_pairs(spark):
    for rows in ([], [(1, 2)], [(1, 2), (1, 3)]):
        assert math.isnan(htest.cor_test(Frame(spark.createDataFrame(rows, "x int, y int")), "x", "y", "kendall").estimate["tau"])
