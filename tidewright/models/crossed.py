"""Linear mixed models with several grouping factors, crossed or nested.

The mixed model equations are sparse: a level of one factor meets the levels
of the others in the cells that occur.  Cells are summed by Spark; the factor
of the most levels, of any number, is eliminated level by level in one pass
over its rows, which leaves a dense system over the levels of all other
factors and the fixed effects.  That system has a bounded size, so the driver
solves it, with its determinant, exactly.  Only the covariance of the large
factor needs a pass; that of the others is algebra on what the pass left.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import quote
from ..operators.frame import Frame
from ..plans.shared import cut
from ..plans.shipping import ship
from .formula import design, parse, sql_of
from .linear import gramian
from .mixed import _BAR, lme

#: Most columns (levels times effects) of all factors but the largest.
MOST_SMALL = 600
#: Levels of the large factor whose algebra is done at once, and covariances evaluated in one pass.
_CHUNK, _AT_ONCE = 512, 8


def random_terms(text: str) -> tuple[str, dict[str, list[tuple[str, bool]]]]:
    """The fixed formula, and for each grouping factor its terms (columns' text, correlated); ``a/b`` is ``a`` and ``a:b``."""
    out: dict[str, list[tuple[str, bool]]] = {}
    for m in _BAR.finditer(text):
        parts = [p.strip() for p in m[3].split("/")]
        for i in range(len(parts)):
            out.setdefault(":".join(parts[: i + 1]), []).append((m[1].strip(), m[2] == "|"))
    left, _, right = _BAR.sub("", text).partition("~")
    fixed = [p for p in (x.strip() for x in right.split("+")) if p]
    return f"{left} ~ {' + '.join(fixed) or '1'}", out


def _flat(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), width)


class crossed(lme):  # noqa: N801
    """``y ~ x + (1 | a) + (1 | b)``, ``y ~ x + (1 | a/b)``: by REML or ML, or at a given ``theta``.

    theta has the lower triangles of the relative covariance factors, the
    largest factor's first, the others' in the order of the formula.  Rows
    with a null in any variable are left out.
    """

    def __init__(self, formula: str, data: Frame | DataFrame, REML: bool = True, contrasts: dict[str, str] | None = None, theta: list[float] | None = None):  # noqa: N803
        df = data.df if isinstance(data, Frame) else data
        self.text, self.source, self.REML, self.contrasts = formula, df, REML, contrasts or {}
        fixed, terms = random_terms(formula)
        keys = {g: g.split(":") for g in terms}
        self.formula = parse(fixed, [c for c in df.columns if c not in itertools.chain(*keys.values())])
        self.design = design(self.formula, df, self.contrasts)
        y = F.expr(sql_of(self.formula.response)).cast("double")
        needs, z, effects, blocks = [*self.design.needs, *itertools.chain(*keys.values())], {}, {}, {}
        for g, some in terms.items():
            z[g], effects[g], blocks[g] = [], [], []
            for text, correlated in some:
                d = design(parse(f"~ {text}", df.columns), df, self.contrasts)
                needs += d.needs
                z[g] += d.columns
                effects[g] += d.names
                blocks[g] += [len(d.names)] if correlated else [1] * len(d.names)
        complete = y.isNotNull()
        for c in dict.fromkeys(needs):
            complete = complete & F.col(quote(c)).isNotNull()

        def key(g: str) -> Column:
            return F.col(quote(keys[g][0])) if len(keys[g]) == 1 else F.struct(*[F.col(quote(c)) for c in keys[g]])

        order = list(terms)
        rows = df.where(complete).select(
            *[key(g).alias(f"g{f}") for f, g in enumerate(order)], *[c.cast("double").alias(f"x{i}") for i, c in enumerate([*self.design.columns, y])],
            *[c.cast("double").alias(f"z{f}_{j}") for f, g in enumerate(order) for j, c in enumerate(z[g])],
        )
        counts = rows.agg(F.count(F.lit(1)), *[F.count_distinct(f"g{f}") for f in range(len(order))]).first()
        self.n, sizes = int(counts[0]), [int(v) for v in counts[1:]]
        if not self.n:
            raise ValueError("no complete rows")
        large = int(np.argmax(sizes))
        self.order = [order[large], *(g for f, g in enumerate(order) if f != large)]
        self.effects_of, self._names = effects, {g: keys[g] for g in order}
        small = [f for f in range(len(order)) if f != large]
        self._p, self._large, self._q = len(self.design.columns), large, len(z[order[large]])
        self._starts = np.cumsum([0, *(sizes[f] * len(z[order[f]]) for f in small)])
        self._size = int(self._starts[-1])
        if self._size > MOST_SMALL:
            raise ValueError(f"all factors but the largest have {self._size} columns; at most {MOST_SMALL} are allowed")
        self._small = [(order[f], sizes[f], len(z[order[f]])) for f in small]
        self._sum_up(rows, small)
        self._slots, self._parts, at = [], [], 0
        for g in self.order:
            own = [(at + start + i, at + start + j) for start, size in zip(np.cumsum([0, *blocks[g][:-1]]).tolist(), blocks[g], strict=True) for j in range(size) for i in range(j, size)]
            self._parts.append((at, len(z[g]), len(self._slots), len(own)))
            self._slots += own
            at += len(z[g])
        self.effects = [f"{g}.{e}" for g in self.order for e in effects[g]]
        self.n_groups = sizes[large]
        self.theta = self._search() if theta is None else np.array(theta, dtype=float)
        self._finish()

    # ------------------------------------------------------------ sums
    def _sum_up(self, rows: DataFrame, small: list[int]) -> None:
        """The cells of each level of the large factor, and the dense products of all other columns."""
        p1, q, a = self._p + 1, self._q, f"g{self._large}"
        self.levels = {}
        for f, (g, n, _) in zip(small, self._small, strict=True):
            levels = cut(rows.select(F.col(f"g{f}").alias(f"v{f}")).distinct().coalesce(1).sortWithinPartitions(f"v{f}").withColumn(f"l{f}", F.monotonically_increasing_id().cast("int")))  # at most MOST_SMALL rows
            self.levels[g] = levels
            rows = rows.join(F.broadcast(levels), F.col(f"g{f}") == F.col(f"v{f}")).drop(f"v{f}")
        entries = [
            F.struct((F.col(f"l{f}") * width + int(start) + j).cast("int").alias("c"), F.col(f"z{f}_{j}").alias("v"))
            for f, (_, _, width), start in zip(small, self._small, self._starts, strict=False) for j in range(width)
        ]
        za = [F.col(f"z{self._large}_{i}") for i in range(q)]
        pairs = list(itertools.combinations_with_replacement(range(q), 2))
        own = rows.groupBy(F.col(a).alias("g")).agg(
            F.array(*[F.sum(za[i] * za[j]) for i, j in pairs]).alias("zz"), F.array(*[F.sum(za[i] * F.col(f"x{k}")) for i in range(q) for k in range(p1)]).alias("zx")
        )
        full = np.zeros((self._size + p1, self._size + p1))
        full[self._size :, self._size :] = gramian(rows, [F.col(f"x{k}") for k in range(p1)])
        if entries:
            spread = rows.select(F.col(a).alias("g"), *[c.alias(f"a{i}") for i, c in enumerate(za)], *[f"x{k}" for k in range(p1)], F.array(*entries).alias("all")).withColumn("e", F.explode("all"))
            cells = spread.groupBy("g", "e.c").agg(*[F.sum(F.col(f"a{i}") * F.col("e.v")).alias(f"s{i}") for i in range(q)])
            # a level has at most MOST_SMALL cells
            lists = cells.groupBy(F.col("g").alias("h")).agg(F.collect_list(F.struct("c", *[f"s{i}" for i in range(q)])).alias("cells"))
            own = own.join(lists, F.col("g") == F.col("h")).drop("h")
            for r in spread.groupBy("e.c").agg(*[F.sum(F.col(f"x{k}") * F.col("e.v")).alias(f"x{k}") for k in range(p1)]).collect():
                full[r.c, self._size :] = full[self._size :, r.c] = r[1:]
            both = spread.withColumn("o", F.explode("all")).where("e.c <= o.c").groupBy(F.col("e.c").alias("c"), F.col("o.c").alias("d")).agg(F.sum(F.col("e.v") * F.col("o.v")).alias("v")).toArrow()
            c, d, v = (both.column(i).to_numpy() for i in range(3))
            full[c, d] = full[d, c] = v
        else:
            own = own.withColumn("cells", F.array().cast(f"array<struct<c:int,{','.join(f's{i}:double' for i in range(q))}>>"))
        self._full, self._rows = full, cut(own.select("g", "zz", "zx", F.col("cells.c").alias("c"), *[F.col(f"cells.s{i}").alias(f"s{i}") for i in range(q)]))

    # ------------------------------------------------------------ the criterion
    def large_factor(self, theta: np.ndarray, which: int = 0) -> np.ndarray:
        at, width, slot, n = self._parts[which]
        out = np.zeros((width, width))
        for v, (i, j) in zip(theta[slot : slot + n], self._slots[slot : slot + n], strict=True):
            out[i - at, j - at] = abs(v) if i == j else v
        return out

    def factor(self, theta: np.ndarray) -> np.ndarray:
        """The relative covariance factors of all groups, one after another."""
        out = np.zeros((len(self.effects), len(self.effects)))
        for k, (at, width, _, _) in enumerate(self._parts):
            out[at : at + width, at : at + width] = self.large_factor(theta, k)
        return out

    def _eliminated(self, factors: list[np.ndarray]) -> list[tuple[float, np.ndarray]]:
        """For each covariance factor of the large group its log determinants, and the products of all other columns that are left: one pass for some of them."""
        q, p, size = self._q, self._p, self._size
        width = size + p + 1
        i, j = np.triu_indices(width)
        out = []
        ship(self._rows.sparkSession)
        for start in range(0, len(factors), _AT_ONCE):
            some = factors[start : start + _AT_ONCE]

            def over(batches: Iterator[pa.RecordBatch], some=some) -> Iterator[pa.RecordBatch]:
                logs, gone = np.zeros(len(some)), np.zeros((len(some), width, width))
                for batch in batches:
                    for _, zz, zx in level_blocks(batch, q, p, size):
                        for f, factor in enumerate(some):
                            low = np.linalg.cholesky(factor.T @ zz @ factor + np.eye(q))
                            part = np.linalg.solve(low, factor.T @ zx).reshape(-1, width)
                            gone[f] += part.T @ part
                            logs[f] += 2 * np.log(np.diagonal(low, axis1=1, axis2=2)).sum()
                flat = np.concatenate([logs[:, None], gone[:, i, j]], axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(flat.size)), pa.array(flat.ravel())], names=["cell", "v"])

            # as many rows as pairs of columns of the dense system
            found = self._rows.mapInArrow(over, "cell bigint, v double").groupBy("cell").agg(F.sum("v").alias("v")).toArrow()
            flat = np.zeros(len(some) * (1 + len(i)))
            flat[found.column(0).to_numpy()] = found.column(1).to_numpy()
            for row in flat.reshape(len(some), -1):
                gone = np.zeros((width, width))
                gone[i, j] = gone[j, i] = row[1:]
                out.append((float(row[0]), self._full - gone))
        return out

    def _small_factor(self, theta: np.ndarray) -> np.ndarray:
        out = np.zeros((self._size, self._size))
        for k, ((_, n, width), start) in enumerate(zip(self._small, self._starts, strict=False), 1):
            out[start : start + n * width, start : start + n * width] = np.kron(np.eye(n), self.large_factor(theta, k))
        return out

    def _left(self, logdet: float, full: np.ndarray, theta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        """Log determinants of all random effects, what is left of [X, y], and the small factors' solution for it."""
        s, f = self._size, self._small_factor(theta)
        inner = f.T @ full[:s, :s] @ f + np.eye(s)
        low = np.linalg.cholesky(inner)
        part = np.linalg.solve(low, f.T @ full[:s, s:])
        logdet += 2 * np.log(np.diag(low)).sum()
        return logdet, full[s:, s:] - part.T @ part, f, np.linalg.solve(low.T, part)

    def _values(self, thetas: list[np.ndarray]) -> np.ndarray:
        n = self._parts[0][3]
        # covariances that share the large factor's part share a pass
        own = list(dict.fromkeys(tuple(t[:n]) for t in thetas))
        found = dict(zip(own, self._eliminated([self.large_factor(np.array(t)) for t in own]), strict=True))
        return np.array([self._criterion(*self._left(*found[tuple(t[:n])], t)[:2])[0] for t in thetas])

    def _finish(self) -> None:
        ((logdet, full),) = self._eliminated([self.large_factor(self.theta)])
        logdet, rest, factor, solved = self._left(logdet, full, self.theta)
        self.criterion, self.beta, self.sigma, information = self._criterion(logdet, rest)
        self.vcov = self.sigma**2 * np.linalg.inv(information)
        self.names, self.rank = list(self.design.names), self._p
        self._u = factor @ (solved[:, -1] - solved[:, :-1] @ self.beta)
        whole = self.factor(self.theta)
        self.covariance = self.sigma**2 * whole @ whole.T
        self.sd = dict(zip(self.effects, np.sqrt(np.diag(self.covariance)).tolist(), strict=True))

    # ------------------------------------------------------------ what a fit tells
    def ranef(self) -> dict[str, Frame]:
        """For each factor (group, an effect each): the conditional means of the random effects; a nested group is a struct."""
        spark, out = self._rows.sparkSession, {}
        for (g, n, width), start in zip(self._small, self._starts, strict=False):
            values = self._u[start : start + n * width].reshape(n, width)
            made = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(values)], "l int, " + ", ".join(f"{quote(e)} double" for e in self.effects_of[g]))
            levels = self.levels[g]
            v, index = levels.columns
            out[g] = Frame(levels.join(F.broadcast(made), F.col(index) == F.col("l")).select(F.col(v).alias("group"), *map(quote, self.effects_of[g])))
        q, p, size, beta, u = self._q, self._p, self._size, self.beta, self._u
        factor, names = self.large_factor(self.theta), self.effects_of[self.order[0]]

        def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for first, zz, zx in level_blocks(batch, q, p, size):
                    right = zx[:, :, -1] - zx[:, :, size:-1] @ beta - zx[:, :, :size] @ u
                    left = factor.T @ zz @ factor + np.eye(q)
                    made = (factor @ np.linalg.solve(left, (factor.T @ right[:, :, None])))[:, :, 0]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(zz)), *(pa.array(made[:, k]) for k in range(q))], names=["group", *names])

        kind = self._rows.schema["g"].dataType.simpleString()
        return {self.order[0]: Frame(self._rows.mapInArrow(over, f"group {kind}, " + ", ".join(f"{quote(e)} double" for e in names)))} | out

    def refit(self, REML: bool) -> lme:  # noqa: N803
        return self if self.REML == REML else crossed(self.text, self.source, REML, self.contrasts)


def level_blocks(batch: pa.RecordBatch, q: int, p: int, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, Z'Z and Z'[small columns, X, y] of some levels of the large factor at a time."""
    i, j = np.triu_indices(q)
    for start in range(0, batch.num_rows, _CHUNK):
        part = batch.slice(start, _CHUNK)
        n = part.num_rows
        zz = np.zeros((n, q, q))
        zz[:, i, j] = zz[:, j, i] = _flat(part.column(1), len(i))
        zx = np.zeros((n, q, size + p + 1))
        zx[:, :, size:] = _flat(part.column(2), q * (p + 1)).reshape(n, q, p + 1)
        column = part.column(3)
        level = np.repeat(np.arange(n), column.value_lengths().to_numpy(zero_copy_only=False))
        at = column.flatten().to_numpy(zero_copy_only=False)
        for k in range(q):
            zx[level, k, at] = part.column(4 + k).flatten().to_numpy(zero_copy_only=False)
        yield start, zz, zx


def several(text: str) -> bool:
    """Whether a formula has more than one grouping factor."""
    return len(random_terms(text)[1]) > 1 if re.search(r"\|", text) else False
