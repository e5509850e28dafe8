"""Models and tests against direct algebra and textbook numbers."""

import math

import numpy as np
import pytest

from tidewright.models import htest, selection, special
from tidewright.models.formula import parse
from tidewright.models.linear import binomial, glm, lm, poisson
from tidewright.operators.frame import Frame


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    n = 200
    x, z = rng.normal(50, 5, n), rng.normal(0, 1, n)
    g = rng.choice(["a", "b", "c"], n)
    y = 3 + 0.5 * x - z + (g == "b") * 2 + rng.normal(0, 1, n)
    k = rng.poisson(np.exp(0.3 + 0.4 * z))
    hit = (rng.random(n) < 1 / (1 + np.exp(-z))).astype(int)
    rows = [(float(a), float(b), str(c), float(e), int(f), int(h)) for a, b, c, e, f, h in zip(x, z, g, y, k, hit, strict=True)]
    return Frame(spark.createDataFrame(rows, "x double, z double, g string, y double, k int, hit int")), (x, z, g, y, k, hit)


def test_formula_terms():
    assert parse("y ~ a * b").terms == [("a",), ("b",), ("a", "b")]
    assert parse("y ~ (a + b + c)^2 - a:b").terms == [("a",), ("b",), ("c",), ("a", "c"), ("b", "c")]
    assert parse("y ~ a / b").terms == [("a",), ("a", "b")] and not parse("y ~ a - 1").intercept and not parse("y ~ 0 + a").intercept
    assert parse("y ~ .", ["y", "u", "v"]).terms == [("u",), ("v",)] and parse("y ~ log(a) + I(b^2) + offset(c)").offsets == ["c"]


def test_lm_equals_least_squares(data):
    frame, (x, z, g, y, *_) = data
    m = lm("y ~ x + z + g", frame)
    design = np.column_stack([np.ones(len(x)), x, z, g == "b", g == "c"])
    beta, rss, *_ = np.linalg.lstsq(design, y, rcond=None)
    assert m.names == ["(Intercept)", "x", "z", "gb", "gc"] and np.allclose(m.beta, beta, rtol=1e-9) and m.rss == pytest.approx(rss[0])
    cov = np.linalg.inv(design.T @ design) * rss[0] / (len(x) - 5)
    assert np.allclose(m.vcov, cov, rtol=1e-8)
    hat = np.diag(design @ np.linalg.inv(design.T @ design) @ design.T)
    out = m.augment().df.toPandas()
    assert sorted(out[".hat"]) == pytest.approx(sorted(hat)) and out[".resid"].sum() == pytest.approx(0, abs=1e-8)
    assert m.r_squared == pytest.approx(1 - rss[0] / ((y - y.mean()) ** 2).sum())
    reach = special.qt(0.975, len(x) - 5) * math.sqrt(cov[1, 1])
    assert m.confint()["x"] == pytest.approx((beta[1] - reach, beta[1] + reach))
    pred = m.predict(interval="prediction").df.toPandas()
    assert ((pred.lwr < pred.y) & (pred.y < pred.upr)).mean() > 0.9


def test_lm_drops_aliased_columns(data):
    frame, _ = data
    m = lm("y ~ x + I(2*x) + z", frame)
    assert m.names == ["(Intercept)", "x", "z"]


def test_anova_drop_step(data):
    frame, (x, z, g, y, *_) = data
    m = lm("y ~ x + z + g", frame)
    table = selection.anova(m)
    assert sum(r["sum_sq"] for r in table) == pytest.approx(((y - y.mean()) ** 2).sum())
    without = lm("y ~ x + g", frame)
    assert next(r for r in selection.drop1(m) if r["term"] == "z")["deviance"] == pytest.approx(without.rss)
    assert next(r for r in selection.aov(m) if r["term"] == "z")["sum_sq"] == pytest.approx(without.rss - m.rss)
    noisy = lm("y ~ x + z + g + k", frame)
    assert "k" not in [t[0] for t in selection.step(noisy).formula.terms] or noisy.extract_aic() < m.extract_aic()
    means = selection.emmeans(m, "g")
    assert [r["contrast"] for r in means.contrasts] == ["a - b", "a - c", "b - c"] and means.contrasts[0]["estimate"] == pytest.approx(-m.coefficients()["gb"])


def irls(x, y, inverse, slope, variance, link):
    beta, mu = None, (y + 0.5) / 2 if variance is None else y + 0.1
    for _ in range(50):
        eta = link(mu) if beta is None else x @ beta
        mu = mu if beta is None else inverse(eta)
        w = slope(eta) ** 2 / variance(mu)
        beta = np.linalg.solve(x.T @ (x * w[:, None]), x.T @ (w * (eta + (y - mu) / slope(eta))))
    return beta


def test_glm_equals_plain(data):
    frame, (_, z, _, _, k, hit) = data
    x = np.column_stack([np.ones(len(z)), z])
    m = glm("k ~ z", frame, poisson())
    assert np.allclose(m.beta, irls(x, k.astype(float), np.exp, np.exp, lambda v: v, np.log), rtol=1e-6) and m.converged
    mu = np.exp(x @ m.beta)
    aic = -2 * sum(a * math.log(b) - b - math.lgamma(a + 1) for a, b in zip(k, mu, strict=True)) + 4
    assert m.AIC() == pytest.approx(aic, rel=1e-8)
    b = glm("hit ~ z", frame, binomial())
    p = 1 / (1 + np.exp(-(x @ b.beta)))
    assert b.deviance() == pytest.approx(-2 * np.sum(hit * np.log(p) + (1 - hit) * np.log(1 - p)), rel=1e-8)
    assert np.allclose(x.T @ (hit - p), 0, atol=1e-5)
    c = glm("cbind(hit, 1 - hit) ~ z", frame, binomial())
    assert np.allclose(c.beta, b.beta, rtol=1e-6)


def test_special_functions():
    assert special.pt(2.0, 10) == pytest.approx(0.963306, abs=1e-6) and special.qt(0.975, 10) == pytest.approx(2.228139, abs=1e-6)
    assert special.pf(3.0, 2, 20) == pytest.approx(1 - 0.072538, abs=1e-5) and special.qchisq(0.95, 3) == pytest.approx(7.814728, abs=1e-6)
    assert special.ptukey(3.5, 3, 20) == pytest.approx(1 - 0.0568, abs=2e-3)


def test_hypothesis_tests(spark):
    sleep = [(0.7, 1.9), (-1.6, 0.8), (-0.2, 1.1), (-1.2, 0.1), (-0.1, -0.1), (3.4, 4.4), (3.7, 5.5), (0.8, 1.6), (0.0, 4.6), (2.0, 3.4)]
    f = Frame(spark.createDataFrame(sleep, "x double, y double"))
    pooled, welch, paired = htest.t_test(f, "x", "y"), htest.t_test(f, "x", "y", var_equal=False), htest.t_test(f, "x", "y", paired=True)
    assert pooled.statistic == pytest.approx(-1.8608, abs=1e-4) and pooled.p_value == pytest.approx(0.07919, abs=1e-5)
    assert welch.parameter == pytest.approx(17.776, abs=1e-3) and paired.statistic == pytest.approx(-4.0621, abs=1e-4) and paired.p_value == pytest.approx(0.002833, abs=1e-6)
    assert htest.cor_test(f, "x", "y").estimate["cor"] == pytest.approx(0.7951702, abs=1e-6)
    assert htest.binom_test(7, 20, 0.5).p_value == pytest.approx(0.263176, abs=1e-5)
    tea = Frame(spark.createDataFrame([("m", "m")] * 3 + [("m", "t")] + [("t", "m")] + [("t", "t")] * 3, "a string, b string"))
    assert htest.fisher_test(tea, "a", "b").p_value == pytest.approx(0.4857, abs=1e-4)
    assert htest.chisq_test(tea, "a", "b").statistic == pytest.approx(0.5)


def test_local_and_bootstrap_fits(spark):
    from tidewright.models.smooth import loess, lowess, mean_cl_boot, stat_smooth

    x = np.linspace(0, 10, 60)
    assert np.allclose(loess(x, 3 + 2 * x - x**2, span=0.5), 3 + 2 * x - x**2) and np.allclose(lowess(x, 1 + x), 1 + x)
    bent = 1 + x + np.where(np.arange(60) == 30, 50, 0)
    assert abs(loess(x, bent, span=0.4, degree=1, family="symmetric")[30] - (1 + x[30])) < 0.5
    f = Frame(spark.createDataFrame([(g, float(a), float(2 * a)) for g in "ab" for a in x], "g string, x double, y double"))
    out = stat_smooth(f, "x", "y", ["g"], n=5).df.toPandas()
    assert len(out) == 10 and np.allclose(out.y, 2 * out.x)
    row = mean_cl_boot(f, "g", "x", reps=400).df.toPandas().set_index("g").loc["a"]
    se = x.std(ddof=1) / math.sqrt(60)
    assert row.y == pytest.approx(5) and row.ymin == pytest.approx(5 - 1.96 * se, abs=0.35) and row.ymax == pytest.approx(5 + 1.96 * se, abs=0.35)


def test_generics(data):
    from tidewright.models import generics as g

    m = lm("y ~ x + z", data[0])
    assert g.coef(m) == m.coefficients() and g.nobs(m) == 200 and g.df_residual(m) == 197 and g.terms(m)["labels"] == ["x", "z"] and g.formula(m) == "y ~ x + z"
    bigger = g.update(m, ". ~ . + g")
    assert [r["value"] for r in g.AIC(m, bigger)] == [m.AIC(), bigger.AIC()] and g.BIC(m) > g.AIC(m) and g.logLik(bigger) > g.logLik(m)
    assert g.model_matrix("~ x + g", data[0]).columns == ["(Intercept)", "x", "gb", "gc"] and g.model_matrix(m).columns == ["(Intercept)", "x", "z"]
    assert g.resid(m).df.agg({"`.resid`": "sum"}).first()[0] == pytest.approx(0, abs=1e-7) and g.hatvalues(m).df.agg({"`.hat`": "sum"}).first()[0] == pytest.approx(3)
    assert g.glance(m)["r_squared"] == m.r_squared and len(g.residual_summary(m)) == 5 and g.dfbetas(m).columns == m.names


def test_mixed_model_equals_the_marginal_likelihood(spark):
    """Correlated slopes: the criterion is that of the normal with covariance Z S Z' + s^2 I, and no covariance nearby is better."""
    from tidewright.models import generics
    from tidewright.models.mixed import anova_lme, lme

    rng = np.random.default_rng(3)
    g = np.repeat(np.arange(12), rng.integers(5, 15, 12))
    x = rng.normal(size=len(g))
    u = rng.multivariate_normal([0, 0], [[4.0, 1.2], [1.2, 1.0]], 12)
    y = 2 + 3 * x + u[g, 0] + u[g, 1] * x + rng.normal(size=len(g))
    frame = Frame(spark.createDataFrame([(f"g{a}", float(b), float(c)) for a, b, c in zip(g, x, y, strict=True)] + [(None, 1.0, 1.0), ("g1", None, 1.0)], "g string, x double, y double"))

    design = np.column_stack([np.ones(len(x)), x])

    def criterion(m, theta):
        """By the dense covariance of each group."""
        factor, logdet, cross = m.factor(np.asarray(theta)), 0.0, np.zeros((3, 3))
        for k in range(12):
            z, both = design[g == k], np.column_stack([design, y])[g == k]
            v = z @ factor @ factor.T @ z.T + np.eye(len(z))
            logdet += np.linalg.slogdet(v)[1]
            cross += both.T @ np.linalg.solve(v, both)
        info, beta = cross[:2, :2], np.linalg.solve(cross[:2, :2], cross[:2, 2])
        k = len(y) - 2 if m.REML else len(y)
        rss = cross[2, 2] - cross[:2, 2] @ beta
        return logdet + k * (1 + np.log(2 * np.pi * rss / k)) + (np.linalg.slogdet(info)[1] if m.REML else 0), beta

    m = lme("y ~ x + (x | g)", frame, REML=False)
    assert (m.n, m.n_groups) == (len(y), 12)
    value, _ = criterion(m, m.theta)
    assert all(criterion(m, m.theta + rng.normal(size=3) * s)[0] >= value - 1e-6 for s in (0.01, 0.1, 0.5) for _ in range(20))
    for fit in (m, lme("y ~ x + (x | g)", frame, theta=[1.5, 0.3, 0.8])):
        value, beta = criterion(fit, fit.theta)
        assert np.isclose(fit.criterion, value) and np.allclose(list(generics.fixef(fit).values()), beta)
    effects = generics.ranef(m).df.toPandas().set_index("group")
    factor = m.factor(m.theta)
    for k in range(12):
        z = np.column_stack([np.ones((g == k).sum()), x[g == k]])
        own = factor @ factor.T @ z.T @ np.linalg.solve(z @ factor @ factor.T @ z.T + np.eye(len(z)), y[g == k] - z @ m.beta)
        assert np.allclose(effects.loc[f"g{k}"].to_numpy(dtype=float), own)
    table = anova_lme(lme("y ~ x + (1 | g)", frame, REML=False, theta=[2.0]), m)
    assert table[1]["df"] == 2 and table[1]["p_value"] < 0.05
    free = lme("y ~ x + (x || g)", frame, theta=[1.0, 0.5])
    assert len(free.theta) == 2 and free.covariance[0, 1] == 0
    # several factors, which once raised, are tested in test_crossed.py
    assert lme("y ~ x + (1 | g) + (1 | x)", frame, theta=[0.5, 0.5]).order == ["x", "g"]
