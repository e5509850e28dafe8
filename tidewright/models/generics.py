"""One name for the same question to any model."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from ..operators.frame import Frame
from .formula import design, parse
from .linear import glm, lm


def coef(model: lm) -> dict[str, float]:
    return model.coefficients()


coefficients = coef


def fixef(model) -> dict[str, float]:
    """Fixed effects of a mixed model."""
    return model.fixef()


def ranef(model) -> Frame:
    """Random effects of a mixed model, a row for each group."""
    return model.ranef()


def resid(model: lm, type: str | None = None) -> Frame:  # noqa: A002
    """The model's rows with a column ``.resid`` of the type (deviance for glm, response for lm)."""
    kind = type or ("deviance" if isinstance(model, glm) else "response")
    return Frame(model.data.withColumn(".resid", model.residual_column(kind)))


residuals = resid


def fitted(model: lm) -> Frame:
    return Frame(model.data.withColumn(".fitted", model.fitted_column()))


fitted_values = fitted


def predict(model: lm, *args, **kwargs) -> Frame:
    return model.predict(*args, **kwargs)


def confint(model: lm, level: float = 0.95) -> dict[str, tuple[float, float]]:
    return model.confint(level)


def vcov(model: lm) -> np.ndarray:
    return model.vcov


def logLik(model: lm) -> float:  # noqa: N802
    return model.log_likelihood()


def deviance(model: lm) -> float:
    return model.deviance()


def nobs(model: lm) -> int:
    return model.n


def df_residual(model: lm) -> int:
    return model.df_residual


def formula(model: lm) -> str:
    return model.text


def terms(model: lm) -> dict:
    f = model.formula
    return {"response": f.response, "labels": [":".join(t) for t in f.terms], "intercept": f.intercept, "offsets": f.offsets}


def model_frame(model: lm) -> Frame:
    return Frame(model.data)


def model_matrix(model: lm | str, data: Frame | None = None) -> Frame:
    """Design columns of a model, or of a formula over a frame."""
    if isinstance(model, lm):
        return model.model_matrix()
    d = design(parse(model, data.columns), data.df)
    return Frame(data.df.select(*[c.alias(n) for n, c in zip(d.names, d.columns, strict=True)]))


def update(model: lm, formula: str | None = None, **changes) -> lm:
    return model.update(formula, **changes)


def _compare(models: tuple[lm, ...], value) -> float | list[dict]:
    if len(models) == 1:
        return value(models[0])
    return [{"model": m.text, "df": m.rank + (0 if isinstance(m, glm) and m.family.known_scale else 1), "value": value(m)} for m in models]


def AIC(*models: lm) -> float | list[dict]:  # noqa: N802
    return _compare(models, lambda m: m.AIC())


def BIC(*models: lm) -> float | list[dict]:  # noqa: N802
    return _compare(models, lambda m: m.AIC(math.log(m.n)))


def hatvalues(model: lm) -> Frame:
    return model.augment().select(".hat")


def rstandard(model: lm) -> Frame:
    return model.augment().select(".std_resid")


def rstudent(model: lm) -> Frame:
    return model.augment().select(".student_resid")


def cooks_distance(model: lm) -> Frame:
    return model.augment().select(".cooksd")


def dffits(model: lm) -> Frame:
    return model.augment().select(".dffits")


def dfbetas(model: lm) -> Frame:
    return model.dfbetas()


def influence(model: lm) -> Frame:
    """Leverage, residuals and the deviation without each row."""
    return model.augment().select(".hat", ".resid", ".sigma", ".cooksd")


def glance(model: lm) -> dict[str, float]:
    """The figures of a whole fit."""
    out = {"n": model.n, "df_residual": model.df_residual, "deviance": model.deviance(), "aic": model.AIC(), "log_likelihood": model.log_likelihood()}
    if not isinstance(model, glm):
        out |= {"r_squared": model.r_squared, "adj_r_squared": model.adj_r_squared, "sigma": math.sqrt(model.sigma2), "statistic": model.f}
    return out


def residual_summary(model: lm) -> list[float]:
    """Minimum, quartiles and maximum of the residuals."""
    return model.data.agg(F.percentile(model.residual_column(), F.array(*[F.lit(p) for p in (0.0, 0.25, 0.5, 0.75, 1.0)]))).first()[0]
