"""Mixed models with several grouping factors against dense algebra."""

import numpy as np
import pytest

from tidewright.models import crossed
from tidewright.models.mixed import anova_lme, lme
from tidewright.operators.frame import Frame


def dense(y, x, zs, factors, reml=True):
    """Criterion, fixed effects, scale and random effects at relative covariance factors."""
    n, p = x.shape
    v = np.eye(n) + sum(z @ np.kron(np.eye(z.shape[1] // len(f)), f @ f.T) @ z.T for z, f in zip(zs, factors, strict=True))
    inverse = np.linalg.inv(v)
    a = x.T @ inverse @ x
    beta = np.linalg.solve(a, x.T @ inverse @ y)
    r = y - x @ beta
    k = n - p if reml else n
    rss = r @ inverse @ r
    value = np.linalg.slogdet(v)[1] + k * (1 + np.log(2 * np.pi * rss / k)) + (np.linalg.slogdet(a)[1] if reml else 0)
    u = [np.kron(np.eye(z.shape[1] // len(f)), f @ f.T) @ z.T @ inverse @ r for z, f in zip(zs, factors, strict=True)]
    return value, beta, np.sqrt(rss / k), u


def indicators(g, slopes=None):
    levels = np.unique(g, axis=0) if np.ndim(g) > 1 else np.unique(g)
    one = np.array([[(row == l).all() if np.ndim(g) > 1 else row == l for l in levels] for row in g], dtype=float)
    return one if slopes is None else np.stack([one, one * slopes[:, None]], axis=2).reshape(len(one), -1)


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(11)
    n = 240
    a, b = rng.integers(0, 17, n), np.minimum(rng.geometric(0.4, n), 6)
    c = rng.integers(0, 3, n)
    x = rng.normal(size=n).round(3)
    y = 1 + 0.5 * x + rng.normal(0, 1.2, 17)[a] + rng.normal(0, 0.8, 7)[b] + rng.normal(0, 0.6, 17)[a] * x + rng.normal(0, 1, n)
    rows = [(int(i), f"b{j}", int(k), float(v), float(w)) for i, j, k, v, w in zip(a, b, c, x, y, strict=True)] + [(None, "b1", 0, 1.0, 1.0), (1, None, 0, 1.0, 1.0)]
    return Frame(spark.createDataFrame(rows, "a int, b string, c int, x double, y double").repartition(3)), a, b, c, x, y


@pytest.mark.parametrize("reml", [True, False])
def test_at_given_theta(data, reml):
    frame, a, b, _, x, y = data
    m = lme("y ~ x + (1 + x | a) + (1 | b)", frame, REML=reml, theta=[1.1, 0.3, 0.5, 0.7])
    assert isinstance(m, crossed.crossed) and m.order == ["a", "b"]
    factors = [np.array([[1.1, 0], [0.3, 0.5]]), np.array([[0.7]])]
    value, beta, sigma, u = dense(y, np.column_stack([np.ones_like(x), x]), [indicators(a, x), indicators(b)], factors, reml)
    assert np.isclose(m.criterion, value) and np.allclose(list(m.fixef().values()), beta) and np.isclose(m.sigma, sigma)
    found = m.ranef()
    large = {r.group: (r["(Intercept)"], r.x) for r in found["a"].df.collect()}
    small = {r.group: r["(Intercept)"] for r in found["b"].df.collect()}
    assert np.allclose(np.array([large[k] for k in sorted(large)]).ravel(), u[0]) and np.allclose([small[k] for k in sorted(small)], u[1])


def test_search_finds_the_best(data):
    frame, a, b, _, x, y = data
    m = lme("y ~ x + (1 | a) + (1 | b)", frame)
    design, zs = np.column_stack([np.ones_like(x), x]), [indicators(a), indicators(b)]
    value = lambda t: dense(y, design, zs, [np.array([[v]]) for v in t])[0]
    assert np.isclose(m.criterion, value(m.theta))
    for k in (0, 1):
        for f in (0.95, 1.05):
            near = m.theta.copy()
            near[k] *= f
            assert value(m.theta) <= value(near)
    rows = anova_lme(lme("y ~ x + (1 | a)", frame), m)
    assert rows[1]["df"] == 1 and rows[1]["p_value"] < 0.05 and rows[1]["log_likelihood"] > rows[0]["log_likelihood"]


def test_nested_and_three_factors(data):
    frame, a, b, c, x, y = data
    m = lme("y ~ x + (1 | c/b) + (1 | a)", frame, theta=[0.4, 0.6, 0.9])
    assert m.order == ["c:b", "c", "a"] or m.order == ["a", "c", "c:b"]
    pairs = np.column_stack([c, b])
    by = {"a": indicators(a), "c": indicators(c), "c:b": indicators(pairs)}
    value, beta, _, _ = dense(y, np.column_stack([np.ones_like(x), x]), [by[g] for g in m.order], [np.array([[v]]) for v in (0.4, 0.6, 0.9)])
    assert np.isclose(m.criterion, value) and np.allclose(list(m.fixef().values()), beta)
    assert sum(f.df.count() for f in m.ranef().values()) == 17 + 3 + len(np.unique(pairs, axis=0))


def test_many_levels(spark):
    """One factor of many levels; the estimates come near what made the data."""
    df = spark.range(60_000).selectExpr("id % 20011 AS a", "id * 7 % 13 AS b", "cast(id % 101 AS double) / 100 AS x", "id")
    noise = "(pmod(xxhash64({0}), 1000003) / 1000003.0 + pmod(xxhash64({0}, 1), 1000003) / 1000003.0 + pmod(xxhash64({0}, 2), 1000003) / 1000003.0 - 1.5) * 2"
    df = df.selectExpr("a", "b", "x", f"2 + 3 * x + 1.5 * {noise.format('a')} + {noise.format('b + 1000000')} + {noise.format('id + 5000000')} AS y")
    m = lme("y ~ x + (1 | a) + (1 | b)", Frame(df))
    assert abs(m.fixef()["x"] - 3) < 0.05 and abs(m.sigma - 1) < 0.02 and abs(m.sd["a.(Intercept)"] - 1.5) < 0.03 and m.n_groups == 20011


def test_limits(data, monkeypatch):
    monkeypatch.setattr(crossed, "MOST_SMALL", 3)
    with pytest.raises(ValueError):
        lme("y ~ x + (1 | a) + (1 | b)", data[0])
    with pytest.raises(ValueError):
        lme("y ~ x", data[0])
