"""Model formulas: text to terms, terms to design columns over a Spark frame."""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import quote

_TOKEN = re.compile(r"\s*(%in%|[A-Za-z_.][\w.]*|\d+\.?\d*|[~+\-*/:^()`,]|[<>=!]+)")
#: Most levels of a factor in a model.
MOST_LEVELS = 500
Terms = list[tuple[str, ...]]


@dataclass
class Formula:
    response: str | None
    terms: Terms
    intercept: bool
    offsets: list[str] = field(default_factory=list)
    text: str = ""


class _Parser:
    """Terms are tuples of variable texts; sets of terms combine by the operators' rules."""

    def __init__(self, text: str, names: list[str]):
        self.text, self.at, self.names = text, 0, names

    def peek(self) -> str:
        m = _TOKEN.match(self.text, self.at)
        return m[1] if m else ""

    def take(self) -> str:
        m = _TOKEN.match(self.text, self.at)
        if not m:
            raise SyntaxError(f"can't read the formula at {self.text[self.at :]!r}")
        self.at = m.end()
        return m[1]

    def sum(self) -> tuple[Terms, bool | None, list[str]]:
        terms: Terms = []
        intercept: bool | None = None
        offsets: list[str] = []
        sign = "+"
        if self.peek() in ("+", "-"):
            sign = self.take()
        while True:
            if self.peek() in ("0", "1"):
                one = self.take() == "1"
                intercept = one if sign == "+" else not one
            else:
                made = self.product()
                off = [t for t in made if t[0].startswith("offset(")]
                offsets += [t[0][7:-1] for t in off]
                made = [t for t in made if t not in off]
                terms = _plus(terms, made) if sign == "+" else [t for t in terms if t not in made]
            if self.peek() not in ("+", "-"):
                return terms, intercept, offsets
            sign = self.take()

    def product(self) -> Terms:
        left = self.colon()
        while self.peek() in ("*", "/", "%in%"):
            op, right = self.take(), None
            right = self.colon()
            if op == "*":
                left = _plus(_plus(left, right), _cross(left, right))
            elif op == "/":
                base = tuple(dict.fromkeys(itertools.chain(*left)))
                left = _plus(left, _cross([base], right))
            else:
                left = _cross(left, right)
        return left

    def colon(self) -> Terms:
        left = self.power()
        while self.peek() == ":":
            self.take()
            left = _cross(left, self.power())
        return left

    def power(self) -> Terms:
        left = self.atom()
        if self.peek() == "^":
            self.take()
            out = left
            for _ in range(int(self.take()) - 1):
                out = _plus(out, _cross(out, left))
            return out
        return left

    def atom(self) -> Terms:
        if self.peek() == "(":
            self.take()
            terms, _, _ = self.sum()
            if self.take() != ")":
                raise SyntaxError("a parenthesis is not closed")
            return terms
        if self.peek() == "`":
            end = self.text.index("`", self.text.index("`", self.at) + 1)
            name = self.text[self.text.index("`", self.at) + 1 : end]
            self.at = end + 1
            return [(name,)]
        name = self.take()
        if name == ".":
            return [(n,) for n in self.names]
        if self.peek() == "(":
            start = self.text.index("(", self.at)
            depth, i = 0, start
            while True:
                depth += {"(": 1, ")": -1}.get(self.text[i], 0)
                i += 1
                if not depth:
                    break
            self.at = i
            return [(name + self.text[start:i].replace(" ", ""),)]
        return [(name,)]


def _plus(a: Terms, b: Terms) -> Terms:
    seen = {frozenset(t) for t in a}
    out = list(a)
    for t in b:
        if frozenset(t) not in seen:
            seen.add(frozenset(t))
            out.append(t)
    return out


def _cross(a: Terms, b: Terms) -> Terms:
    return _plus([], [tuple(dict.fromkeys((*x, *y))) for x in a for y in b])


def parse(text: str, names: list[str] = ()) -> Formula:
    """``y ~ a + b:c``; terms come out by their order, main effects first."""
    left, _, right = text.rpartition("~")
    response = left.strip() or None
    rest = [n for n in names if response is None or n not in re.findall(r"[\w.]+", response)]
    p = _Parser(right.strip(), rest)
    terms, intercept, offsets = p.sum()
    if p.peek():
        raise SyntaxError(f"can't read the formula at {right[p.at :]!r}")
    ordered = sorted(terms, key=len)
    return Formula(response, ordered, intercept is not False, offsets, text)


# ---------------------------------------------------------------- variables
_FUNCTIONS = {"log": F.ln, "exp": F.exp, "sqrt": F.sqrt, "sin": F.sin, "cos": F.cos, "log1p": F.log1p, "log2": F.log2, "log10": F.log10, "abs": F.abs, "expm1": F.expm1}


def sql_of(text: str) -> str:
    """Arithmetic text as Spark SQL: ``^`` is power, names with dots are quoted."""
    text = re.sub(r"\bI\(", "(", text).replace("**", "^")
    text = re.sub(r"([\w.`]+|\([^()]*\))\^(\d+(?:\.\d+)?)", r"power(\1, \2)", text)
    text = re.sub(r"\blog\(", "ln(", text)
    return re.sub(r"(?<![\w.])([A-Za-z_]\w*(?:\.\w+)+)(?!\w*\()", r"`\1`", text)


def variables(text: str) -> list[str]:
    """Column names in a term's text."""
    return [m for m in re.findall(r"(?<![\w.])([A-Za-z_.][\w.]*)(?![\w.]*\()", text) if not re.fullmatch(r"[\d.eE]+", m)]


@dataclass
class Variable:
    """A term's part: numeric columns, or a factor with its levels."""

    text: str
    columns: list[tuple[str, Column]]
    levels: list | None = None
    base: Column | None = None


def contrasts(levels: list, kind: str) -> tuple[list[str], list[list[float]]]:
    """Names and values (a row for each level) of k - 1 columns."""
    k = len(levels)
    if kind == "treatment":
        return [str(v) for v in levels[1:]], [[float(i == j) for j in range(1, k)] for i in range(k)]
    if kind == "sas":
        return [str(v) for v in levels[:-1]], [[float(i == j) for j in range(k - 1)] for i in range(k)]
    if kind == "sum":
        return [str(j + 1) for j in range(k - 1)], [[float(i == j) if i < k - 1 else -1.0 for j in range(k - 1)] for i in range(k)]
    if kind == "helmert":
        return [str(j + 1) for j in range(k - 1)], [[-1.0 if i <= j else float(j + 1) if i == j + 1 else 0.0 for j in range(k - 1)] for i in range(k)]
    if kind == "poly":
        import numpy as np

        x = np.arange(k) - (k - 1) / 2
        q, r = np.linalg.qr(np.vander(x, k, increasing=True))
        z = q * np.sign(np.diag(r))
        names = [".L", ".Q", ".C", *(f"^{d}" for d in range(4, k))][: k - 1]
        return names, z[:, 1:].tolist()
    raise ValueError(f"no such contrasts: {kind}")


def _pick(base: Column, values: list, codes: list[float]) -> Column:
    out = None
    for v, code in zip(values, codes, strict=True):
        if code:
            out = F.when(base == F.lit(v), F.lit(code)) if out is None else out.when(base == F.lit(v), F.lit(code))
    return out.otherwise(F.lit(0.0))


@dataclass
class Design:
    """Named numeric columns in the order of the terms; ``assign`` gives each one's term, 0 for the intercept."""

    formula: Formula
    names: list[str]
    columns: list[Column]
    assign: list[int]
    needs: list[str]
    factors: dict[str, list]
    coded: dict[str, str]


def design(formula: Formula, df: DataFrame, kinds: dict[str, str] | None = None, levels: dict[str, list] | None = None) -> Design:
    """Design columns of a formula over df; factor levels are read once, or given."""
    kinds, known = kinds or {}, dict(levels or {})
    cache: dict[str, Variable] = {}
    needs: list[str] = []

    def variable(text: str) -> Variable:
        if text in cache:
            return cache[text]
        m = re.fullmatch(r"(\w+)\((.*)\)", text)
        name = m[1] if m else ""
        if name in ("factor", "as.factor", "C"):
            inner = m[2].split(",")[0]
            needs.extend(variables(inner))
            base, is_factor = F.col(quote(inner)), True
        elif name == "poly":
            inner, degree = m[2].split(",")[0], int(re.search(r"(\d+)$", m[2])[1])
            needs.extend(variables(inner))
            made = _poly(df, F.expr(sql_of(inner)).cast("double"), degree, known, text)
            cache[text] = Variable(text, [(f"{text}{i + 1}", c) for i, c in enumerate(made)])
            return cache[text]
        elif name in ("bs", "ns"):
            from .splines import arguments, formula_basis

            (inner, *more), named = arguments(text)
            needs.extend(variables(inner))
            x = F.expr(sql_of(inner)).cast("double")
            if text not in known:
                known[text] = formula_basis(name, df, x, dict(zip(("df", "knots"), more, strict=False)) | named)
            cache[text] = Variable(text, [(f"{text}{i + 1}", c) for i, c in enumerate(known[text].columns(x))])
            return cache[text]
        elif name == "scale":
            needs.extend(variables(m[2]))
            x = F.expr(sql_of(m[2])).cast("double")
            if text not in known:
                known[text] = list(df.agg(F.avg(x), F.stddev_samp(x)).first())
            cache[text] = Variable(text, [(text, (x - known[text][0]) / known[text][1])])
            return cache[text]
        elif m or not re.fullmatch(r"[\w.]+", text):
            needs.extend(variables(text))
            cache[text] = Variable(text, [(text, F.expr(sql_of(text)).cast("double"))])
            return cache[text]
        else:
            needs.append(text)
            base = F.col(quote(text))
            is_factor = isinstance(df.schema[text].dataType, T.StringType | T.BooleanType) or bool((df.schema[text].metadata or {}).get("levels"))
        if not is_factor:
            cache[text] = Variable(text, [(text, base.cast("double"))])
            return cache[text]
        if text not in known:
            meta = (df.schema[text].metadata or {}).get("levels") if text in df.columns else None
            found = meta or [r[0] for r in df.select(base.alias("v")).where("v is not null").distinct().orderBy("v").limit(MOST_LEVELS + 1).collect()]
            if len(found) > MOST_LEVELS:
                raise ValueError(f"{text} has more than {MOST_LEVELS} levels")
            known[text] = found
        cache[text] = Variable(text, [], known[text], base)
        return cache[text]

    names, columns, assign = [], [], []
    if formula.intercept:
        names, columns, assign = ["(Intercept)"], [F.lit(1.0)], [0]
    present = {frozenset(t) for t in formula.terms}
    full = not formula.intercept  # the first factor of a model without intercept keeps all levels
    for k, term in enumerate(formula.terms, 1):
        blocks = []
        for part in term:
            v = variable(part)
            if v.levels is None:
                blocks.append(v.columns)
                continue
            # contrasts where the term without this factor is in the model, all levels otherwise
            rest = frozenset(term) - {part}
            if rest in present if rest else not full:
                labels, codes = contrasts(v.levels, kinds.get(part, "treatment"))
                blocks.append([(part + label, _pick(v.base, v.levels, [row[j] for row in codes])) for j, label in enumerate(labels)])
            else:
                blocks.append([(f"{part}{value}", (v.base == F.lit(value)).cast("double")) for value in v.levels])
                full = full and bool(rest)
        for combo in itertools.product(*reversed(blocks)):
            parts = tuple(reversed(combo))
            names.append(":".join(n for n, _ in parts))
            made = parts[0][1]
            for _, c in parts[1:]:
                made = made * c
            columns.append(made)
            assign.append(k)
    for o in formula.offsets:
        needs.extend(variables(o))
    return Design(formula, names, columns, assign, list(dict.fromkeys(needs)), known, kinds)


def _poly(df: DataFrame, x: Column, degree: int, known: dict, text: str) -> list[Column]:
    """Orthogonal polynomials by their three-term recurrence, whose coefficients come from the sums of powers."""
    import numpy as np

    if text not in known:
        mean = df.agg(F.avg(x)).first()[0]
        d = x - mean
        sums = np.array(df.agg(*[F.sum(F.pow(d, F.lit(k))) for k in range(2 * degree + 1)]).first(), dtype=float)
        gram = np.array([[sums[i + j] for j in range(degree + 1)] for i in range(degree + 1)])
        r = np.linalg.cholesky(gram).T
        known[text] = [mean, np.linalg.inv(r)[:, 1:].tolist()]
    mean, weights = known[text]
    d = x - mean
    return [sum((F.pow(d, F.lit(i)) * float(weights[i][k]) for i in range(1, degree + 1)), F.lit(float(weights[0][k]))) for k in range(degree)]
