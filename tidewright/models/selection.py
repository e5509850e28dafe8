"""Comparison and selection of models, and marginal means."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import functions as F

from ..functions.expr import quote
from . import special as s
from .linear import glm, lm, solve_gramian


def _term_name(term: tuple[str, ...]) -> str:
    return ":".join(term)


def _rss_without(model: lm, gone: set[int]) -> tuple[float, int]:
    """Residual sum of squares and rank without some terms, from the model's own Gramian."""
    p = len(model.design.columns)
    stay = [j for j in range(p) if model.design.assign[j] not in gone]
    index = [*stay, p]
    if not stay:
        return float(model.gram[p, p]), 0
    kept, _, _, rss = solve_gramian(model.gram[np.ix_(index, index)], len(stay))
    return rss, len(kept)


def anova(*models: lm, test: str | None = None) -> list[dict]:
    """Sequential sums of squares of one linear model, or comparisons of nested models."""
    if len(models) == 1 and not isinstance(models[0], glm):
        m = models[0]
        out, terms = [], m.formula.terms
        last, rank = _rss_without(m, set(range(1, len(terms) + 1)))
        for k, term in enumerate(terms, 1):
            rss, now = _rss_without(m, set(range(k + 1, len(terms) + 1)))
            df = now - rank
            f = (last - rss) / df / m.sigma2 if df else math.nan
            out.append({"term": _term_name(term), "df": df, "sum_sq": last - rss, "statistic": f, "p_value": s.pf_upper(f, df, m.df_residual) if df else math.nan})
            last, rank = rss, now
        return [*out, {"term": "Residuals", "df": m.df_residual, "sum_sq": m.rss, "statistic": math.nan, "p_value": math.nan}]
    if len(models) == 1:
        m = models[0]
        steps = [m.update(" + ".join(["1", *map(_term_name, m.formula.terms[:k])])) for k in range(len(m.formula.terms))] + [m]
        return anova(*steps, test=test or "Chisq")
    largest = min(models, key=lambda m: m.df_residual)
    test = test or ("Chisq" if isinstance(largest, glm) and largest.family.known_scale else "F")
    out, before = [], None
    for m in models:
        row = {"formula": m.text, "df_residual": m.df_residual, "deviance": m.deviance()}
        if before is not None:
            df, change = before.df_residual - m.df_residual, before.deviance() - m.deviance()
            if test == "F":
                f = change / df / largest.dispersion if df else math.nan
                row |= {"df": df, "change": change, "statistic": f, "p_value": s.pf_upper(f, abs(df), largest.df_residual) if df else math.nan}
            else:
                row |= {"df": df, "change": change, "statistic": change / largest.dispersion, "p_value": s.pchisq_upper(abs(change) / largest.dispersion, abs(df)) if df else math.nan}
        out.append(row)
        before = m
    return out


def _droppable(terms: list[tuple[str, ...]]) -> list[tuple[str, ...]]:
    """Terms that are part of no larger one."""
    return [t for t in terms if not any(set(t) < set(u) for u in terms)]


def drop1(model: lm, test: str | None = None, k: float = 2.0) -> list[dict]:
    """The model without each term that may go; a linear model's come from one Gramian."""
    out = [{"term": "<none>", "df": 0, "deviance": model.deviance(), "aic": model.extract_aic(k)}]
    terms = model.formula.terms
    for t in _droppable(terms):
        if isinstance(model, glm):
            rest = [_term_name(u) for u in terms if u != t]
            small = model.update(" + ".join(["1" if model.formula.intercept else "0", *rest]))
            deviance, rank, aic = small.deviance(), small.rank, small.extract_aic(k)
        else:
            deviance, rank = _rss_without(model, {terms.index(t) + 1})
            aic = model.n * math.log(deviance / model.n) + k * rank
        df = model.rank - rank
        row = {"term": _term_name(t), "df": df, "deviance": deviance, "aic": aic}
        if test == "F":
            f = (deviance - model.deviance()) / df / model.dispersion
            row |= {"statistic": f, "p_value": s.pf_upper(f, df, model.df_residual)}
        elif test in ("Chisq", "LRT"):
            change = (deviance - model.deviance()) / model.dispersion if isinstance(model, glm) else model.n * math.log(deviance / model.rss)
            row |= {"statistic": change, "p_value": s.pchisq_upper(change, df)}
        out.append(row)
    return out


def add1(model: lm, scope: str | list[str], test: str | None = None, k: float = 2.0) -> list[dict]:
    """The model with each further term of the scope whose parts it has."""
    from .formula import parse

    upper = parse(scope if "~" in scope else f"~ {scope}", model.source.columns).terms if isinstance(scope, str) else [tuple(t.split(":")) for t in scope]
    have = {frozenset(t) for t in model.formula.terms}
    addable = [t for t in upper if frozenset(t) not in have and all(frozenset(set(t) - {v}) in have for v in t if len(t) > 1)]
    # a common set of rows, so that the fits compare
    needed = sorted({v for t in addable for v in t if v in model.source.columns})
    data = model.source.where(" and ".join(f"{quote(v)} is not null" for v in needed)) if needed else model.source
    base = model.update(data=data)
    out = [{"term": "<none>", "df": 0, "deviance": base.deviance(), "aic": base.extract_aic(k)}]
    for t in addable:
        big = base.update(f". + {_term_name(t)}")
        df, row = big.rank - base.rank, {"term": _term_name(t), "df": big.rank - base.rank, "deviance": big.deviance(), "aic": big.extract_aic(k)}
        if test == "F" and df:
            f = (base.deviance() - big.deviance()) / df / big.dispersion
            row |= {"statistic": f, "p_value": s.pf_upper(f, df, big.df_residual)}
        elif test in ("Chisq", "LRT") and df:
            change = base.deviance() - big.deviance() if isinstance(model, glm) else base.n * math.log(base.rss / big.rss)
            row |= {"statistic": change, "p_value": s.pchisq_upper(change, df)}
        out.append(row)
    return out


def step(model: lm, scope: str | None = None, direction: str = "both", k: float = 2.0, steps: int = 1000) -> lm:
    """Greedy search by AIC."""
    scope = scope or model.text.partition("~")[2]
    current, best = model, model.extract_aic(k)
    for _ in range(steps):
        moves = []
        if direction in ("both", "backward"):
            moves += [(r["aic"], "-", r["term"]) for r in drop1(current, k=k)[1:]]
        if direction in ("both", "forward"):
            moves += [(r["aic"], "+", r["term"]) for r in add1(current, scope, k=k)[1:]]
        if not moves or min(moves)[0] >= best - 1e-7:
            return current
        best, sign, term = min(moves)
        current = current.update(f". {sign} {term}")
    return current


def aov(model: lm) -> list[dict]:
    """Type II sums of squares: each term against the model of all terms that don't contain it."""
    terms, out = model.formula.terms, []
    for i, t in enumerate(terms, 1):
        larger = {j for j, u in enumerate(terms, 1) if set(t) < set(u)}
        with_, r1 = _rss_without(model, larger)
        without, r0 = _rss_without(model, larger | {i})
        df, ss = r1 - r0, without - with_
        f = ss / df / model.sigma2
        out.append({"term": _term_name(t), "df": df, "sum_sq": ss, "statistic": f, "p_value": s.pf_upper(f, df, model.df_residual)})
    return [*out, {"term": "Residuals", "df": model.df_residual, "sum_sq": model.rss, "statistic": math.nan, "p_value": math.nan}]


@dataclass
class Means:
    means: list[dict]
    contrasts: list[dict]


def emmeans(model: lm, factor: str, adjust: str = "tukey", ref: str | None = None, level: float = 0.95) -> Means:
    """Means of a factor's levels over an even grid of the other factors, numbers at their means; pairs, or differences from ``ref``."""
    others = {f: v for f, v in model.design.factors.items() if f != factor and f in model.source.columns}
    numbers = [c for c in model.design.needs if c not in model.design.factors]
    row = model.data.agg(*[F.avg(quote(c)) for c in numbers]).first() if numbers else ()
    levels = model.design.factors[factor]
    spark = model.source.sparkSession
    grid = [{}]
    for f, values in {factor: levels, **others}.items():
        grid = [{**g, f: v} for g in grid for v in values]
    frame = spark.createDataFrame([{**g, **{c: float(v) for c, v in zip(numbers, row, strict=True)}} for g in grid])
    _, columns = model._new_columns(frame)
    rows = frame.select(F.col(quote(factor)).alias("__f"), *[c.cast("double").alias(f"x{i}") for i, c in enumerate(columns)]).collect()
    l = {v: np.mean([list(r)[1:] for r in rows if r["__f"] == v], axis=0) for v in levels}  # noqa: E741
    df = model.df_residual if not (isinstance(model, glm) and model.family.known_scale) else math.inf
    t = s.qt((1 + level) / 2, df) if math.isfinite(df) else s.qnorm((1 + level) / 2)

    def value(x: np.ndarray) -> tuple[float, float]:
        return float(x @ model.beta), float(math.sqrt(max(x @ model.vcov @ x, 0.0)))

    means = [{factor: v, "emmean": (e := value(l[v]))[0], "se": e[1], "df": df, "lower": e[0] - t * e[1], "upper": e[0] + t * e[1]} for v in levels]
    pairs = [(a, b) for i, a in enumerate(levels) for b in levels[i + 1 :]] if ref is None else [(v, ref) for v in levels if v != ref]
    out = []
    for a, b in pairs:
        est, se = value(l[a] - l[b])
        ratio = est / se
        p = 2 * s.pt_upper(abs(ratio), df) if math.isfinite(df) else 2 * s.pnorm(-abs(ratio))
        if adjust == "bonferroni":
            p = min(1.0, p * len(pairs))
        elif adjust == "tukey" and ref is None and len(levels) > 2:
            p = 1 - s.ptukey(abs(ratio) * math.sqrt(2), len(levels), df)
        out.append({"contrast": f"{a} - {b}", "estimate": est, "se": se, "df": df, "t_ratio": ratio, "p_value": max(0.0, p)})
    return Means(means, out)
