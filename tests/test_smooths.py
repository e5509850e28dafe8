"""Spline bases and additive models against plain numpy."""

import numpy as np
import pytest

from tidewright.models import splines
from tidewright.models.additive import anova_gam, gam
from tidewright.models.linear import binomial, lm, poisson
from tidewright.models.mixed import lme
from tidewright.operators.frame import Frame


def recursion(knots, degree, i, x):
    if degree == 0:
        return ((knots[i] <= x) & (x < knots[i + 1])).astype(float)
    out = np.zeros_like(x)
    if knots[i + degree] > knots[i]:
        out += (x - knots[i]) / (knots[i + degree] - knots[i]) * recursion(knots, degree - 1, i, x)
    if knots[i + degree + 1] > knots[i + 1]:
        out += (knots[i + degree + 1] - x) / (knots[i + degree + 1] - knots[i + 1]) * recursion(knots, degree - 1, i + 1, x)
    return out


def natural(x, knots):
    """1, x and the truncated cubes that are straight outside."""
    cube = lambda k: np.maximum(x - k, 0) ** 3
    d = lambda j: (cube(knots[j]) - cube(knots[-1])) / (knots[-1] - knots[j])
    return np.column_stack([np.ones_like(x), x, *(d(j) - d(len(knots) - 2) for j in range(len(knots) - 2))])


def bend(knots, n=20001):
    """The penalty of natural(), by numeric integration of second differences' exact counterpart."""
    x = np.linspace(knots[0], knots[-1], n)
    second = lambda k: 6 * np.maximum(x - k, 0)
    d = lambda j: (second(knots[j]) - second(knots[-1])) / (knots[-1] - knots[j])
    f = np.column_stack([0 * x, 0 * x, *(d(j) - d(len(knots) - 2) for j in range(len(knots) - 2))])
    h = x[1] - x[0]
    return h / 3 * (f[:1].T @ f[:1] + f[-1:].T @ f[-1:] + 4 * f[1:-1:2].T @ f[1:-1:2] + 2 * f[2:-1:2].T @ f[2:-1:2])


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    n = 300
    x, z = rng.uniform(0, 10, n).round(2), rng.uniform(-1, 1, n).round(2)
    g = rng.integers(0, 12, n)
    effect = rng.normal(0, 1.5, 12)
    y = np.sin(x) + z * z + rng.normal(0, 0.4, n)
    count = rng.poisson(np.exp(0.3 * np.sin(x) + 1))
    hit = rng.uniform(size=n) < 1 / (1 + np.exp(-np.sin(x)))
    h = rng.choice(["a", "b"], n)
    rows = [(*map(float, v[:6]), int(v[6]), str(v[7]), int(v[8])) for v in zip(x, z, y, y + effect[g], count, hit, g, h, range(n), strict=True)]
    rows.append((None, 0.5, 1.0, 1.0, 1.0, 1.0, 0, "a", n))
    frame = spark.createDataFrame(rows, "x double, z double, y double, v double, count double, hit double, g int, h string, i int").repartition(4)
    return frame, {"x": x, "z": z, "y": y, "v": y + effect[g], "count": count, "hit": hit.astype(float), "g": g, "h": h}


def values(frame, name="fit"):
    return np.array([r[0] for r in frame.df.where("x is not null").orderBy("i").select(f"`{name}`").collect()])


def test_b_splines_follow_the_recursion():
    knots = np.array([0, 0, 0, 0, 1, 2.5, 4, 4, 4, 4.0])
    x = np.linspace(0, 3.999, 57)
    p = splines.b_splines(knots, 3)
    assert np.allclose(p.array(x), np.column_stack([recursion(knots, 3, i, x) for i in range(6)]))
    assert np.allclose(p.array(np.array([4.0, 5.0, -1.0])).sum(axis=1), 1)  # the end pieces go on


@pytest.mark.parametrize("text", ["bs(x, df=5)", "bs(x, knots=c(3, 7), degree=2)", "ns(x, df=3)", "ns(x, knots=c(2,5,8), Boundary.knots=c(1, 9))"])
def test_formula_bases(data, text):
    frame, a = data
    m = lm(f"y ~ z + {text}", Frame(frame))
    x = a["x"]
    q = np.quantile(x, [1 / 3, 2 / 3])
    if text.startswith("bs(x, df"):
        basis = np.column_stack([x**k for k in range(4)] + [np.maximum(x - k, 0) ** 3 for k in q])
    elif text.startswith("bs"):
        basis = np.column_stack([x**k for k in range(3)] + [np.maximum(x - k, 0) ** 2 for k in (3, 7)])
    elif "df=3" in text:
        basis = natural(x, [x.min(), *q, x.max()])
    else:
        basis = natural(x, [1, 2, 5, 8, 9])
    design = np.column_stack([basis, a["z"]])
    beta, *_ = np.linalg.lstsq(design, a["y"], rcond=None)
    assert np.allclose(values(m.predict()), design @ beta, atol=1e-6)
    new = frame.sparkSession.createDataFrame([(-3.0, 0.0, 0), (12.0, 0.0, 1), (None, 0.0, 2)], "x double, z double, i int")
    got = [r.fit for r in m.predict(Frame(new)).df.orderBy("i").collect()]
    out = np.array([-3.0, 12.0])
    if text.startswith("bs(x, df"):
        far = np.column_stack([out**k for k in range(4)] + [np.maximum(out - k, 0) ** 3 for k in q])
    elif text.startswith("bs"):
        far = np.column_stack([out**k for k in range(3)] + [np.maximum(out - k, 0) ** 2 for k in (3, 7)])
    else:
        far = natural(out, [x.min(), *q, x.max()] if "df=3" in text else [1, 2, 5, 8, 9])
    assert got[2] is None and np.allclose(got[:2], np.column_stack([far, [0, 0]]) @ beta, atol=1e-4)


def test_bad_bases(data):
    for text in ("bs(x, df=1)", "ns(x, knots=c(50))", "ns(x, degree=2)"):
        with pytest.raises(ValueError):
            lm(f"y ~ {text}", Frame(data[0]))


def knots_of(x, k):
    return np.quantile(np.unique(x), np.linspace(0, 1, k))


def test_cubic_regression_at_given_sp(data):
    frame, a = data
    m = gam("y ~ s(x, bs='cr', k=8)", Frame(frame), sp=[2.0], scale_penalty=False)
    knots = knots_of(a["x"], 8)
    basis, s = natural(a["x"], knots), bend(knots)
    inverse = np.linalg.inv(basis.T @ basis + 2 * s)
    fit = basis @ inverse @ basis.T @ a["y"]
    assert np.allclose(values(m.predict()), fit, atol=1e-6)
    assert np.isclose(m.edf_total, np.trace(inverse @ basis.T @ basis)) and np.isclose(m.deviance(), ((a["y"] - fit) ** 2).sum())


def test_gcv_and_reml_find_the_best(data):
    frame, a = data
    knots = knots_of(a["x"], 9)
    basis, s = natural(a["x"], knots), bend(knots)
    y, n = a["y"], len(a["y"])
    grid = np.exp(np.linspace(-8, 8, 801))

    def gcv(lam):
        hat = basis @ np.linalg.solve(basis.T @ basis + lam * s, basis.T)
        return n * ((y - hat @ y) ** 2).sum() / (n - np.trace(hat)) ** 2

    values_, vectors = np.linalg.eigh(s)
    keep = values_ > 1e-9 * values_[-1]
    z, x0 = basis @ vectors[:, keep] / np.sqrt(values_[keep]), basis[:, :2]

    def reml(lam):
        v = np.eye(n) + z @ z.T / lam
        inverse = np.linalg.inv(v)
        a0 = x0.T @ inverse @ x0
        beta = np.linalg.solve(a0, x0.T @ inverse @ y)
        r = y - x0 @ beta
        return ((n - 2) * np.log(r @ inverse @ r) + np.linalg.slogdet(v)[1] + np.linalg.slogdet(a0)[1]) / 2

    for method, score in (("GCV", gcv), ("REML", reml)):
        m = gam("y ~ s(x, bs='cr', k=9)", Frame(frame), method=method, scale_penalty=False)
        best = min(map(score, grid[::20]))
        assert score(m.sp[0]) <= best + 1e-8 * abs(best)
        around = [score(m.sp[0] * f) for f in (0.9, 1.1)]
        assert score(m.sp[0]) <= min(around)
    assert np.isclose(gam("y ~ s(x, bs='cr', k=9)", Frame(frame), method="GCV", scale_penalty=False).score, min(map(gcv, grid)), rtol=1e-5)


@pytest.mark.parametrize("response,family", [("count", poisson), ("hit", binomial)])
def test_other_families_at_given_sp(data, response, family):
    frame, a = data
    m = gam(f"{response} ~ z + s(x, bs='cr', k=7)", Frame(frame), family=family(), sp=[3.0], scale_penalty=False)
    knots = knots_of(a["x"], 7)
    basis, y = np.column_stack([natural(a["x"], knots), a["z"]]), a[response]
    s = np.zeros((8, 8))
    s[:7, :7] = bend(knots)
    beta = np.zeros(8)
    for _ in range(60):
        eta = basis @ beta
        mu = np.exp(eta) if response == "count" else 1 / (1 + np.exp(-eta))
        w = mu if response == "count" else mu * (1 - mu)
        beta = np.linalg.solve(basis.T @ (w[:, None] * basis) + 3 * s, basis.T @ (w * eta + y - mu))
    assert m.converged and np.allclose(values(m.predict(type="link")), basis @ beta, atol=1e-4)
    assert m.edf_total < 8 and all(0 <= r["p_value"] <= 1 for r in anova_gam(m))
    # chosen by REML and UBRE: best for the working model of the last step
    for method in ("REML", "GCV"):
        free = gam(f"{response} ~ s(x, bs='ps', k=8)", Frame(frame), family=family(), method=method)
        score = lambda f: free.working.solve(np.log([free.sp[0] * f])).score  # noqa: E731, B023
        assert free.converged and score(1) <= min(score(0.8), score(1.25)) and 2 < free.edf_total < 9


def test_random_effects_equal_mixed_model(data):
    frame, _ = data
    m = gam("v ~ z + s(g, bs='re')".replace("s(g", "s(factor(g)"), Frame(frame), scale_penalty=False)
    other = lme("v ~ z + (1 | g)", Frame(frame.where("x is not null or true")))
    wanted = other.fixef()
    got = m.coefficients()
    assert np.isclose(got["z"], wanted["z"], rtol=1e-4)
    assert np.isclose(np.sqrt(m.dispersion / m.sp[0]), other.sd["(Intercept)"], rtol=2e-2)


def test_tensor_products_by_and_plates(data):
    frame, a = data
    sums = gam("y ~ s(x, bs='cr') + s(z, bs='cr')", Frame(frame))
    tensor = gam("y ~ te(x, z, k=c(7, 4))", Frame(frame))
    parts = gam("y ~ s(x, bs='cr', k=7) + s(z, bs='cr', k=4) + ti(x, z, k=c(5, 4))", Frame(frame))
    plates = gam("y ~ s(x, z, k=25)", Frame(frame))
    truth = np.sin(a["x"]) + a["z"] ** 2
    for m in (sums, tensor, parts, plates):
        assert np.sqrt(((values(m.predict()) - truth) ** 2).mean()) < 0.3, m.text
        assert np.isclose(values(m.predict()).mean(), a["y"].mean(), atol=1e-6)  # smooths are centred
    terms = sums.predict(type="terms")
    whole = values(terms, "s(x)") + values(terms, "s(z)") + sums.coefficients()["(Intercept)"]
    assert np.allclose(whole, values(sums.predict()))
    split = gam("y ~ h + s(x, bs='cr', k=6, by=h)", Frame(frame))
    assert [r["term"] for r in split.smooth_table()] == ["s(x):ha", "s(x):hb"]
    slope = gam("y ~ s(x, bs='cr', k=6, by=z)", Frame(frame), select=True)
    assert len(slope.sp) == 2 and slope.edf_total > 1
    rows = anova_gam(gam("y ~ s(x, bs='cr')", Frame(frame)), sums)
    assert rows[1]["p_value"] < 1e-3 and rows[1]["df"] > 0
    new = frame.sparkSession.createDataFrame([(1.0, None, 0), (2.0, 0.0, 1)], "x double, z double, i int")
    got = sums.predict(Frame(new), se_fit=True).df.orderBy("i").collect()
    assert got[0].fit is None and got[0].se_fit is None and got[1].se_fit > 0


def test_gam_arguments(data):
    frame, _ = data
    for text, error in (("y ~ s(x, bs='cc')", NotImplementedError), ("y ~ s(x, bs='cr', q=3)", ValueError), ("y ~ s(g, bs='cr', k=40)", ValueError)):
        with pytest.raises(error):
            gam(text, Frame(frame))
    with pytest.raises(ValueError):
        gam("y ~ s(x)", Frame(frame), sp=[1.0, 2.0])
