"""Toxicity by a linear classifier whose training penalises counterfactual score changes.

Features are the presence, in a text, of lower-cased words and of word starts
of four to six bytes, hashed into a fixed number of buckets.  Counts by label
over all training rows choose the features, to which those of the identity
terms always belong; weights are then fitted on a bounded sample of the rows.

A counterfactual pair is a sentence of a labelled text and the same sentence
with its identity terms swapped for others of their kinds.  A sampled text
that mentions no term makes pairs as well: in place of a word that carries no
weight, one of its sentences takes a term, and makes a pair with each other
term of that kind.  The text's own row stays as it is, unless ``fill_own``.  The square of the difference of a pair's
scores is part of the loss: a term that merely goes along with the label in the
training data gets no weight of its own, so neutral mentions of a group are
not held against a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblocks as tb
from .runtime import arrow_map

#: Buckets of the feature hash.
BUCKETS = 1 << 20
#: Bytes of the word starts that are features beside the whole word.
STARTS = (4, 5, 6)
#: Features that get a weight, at most, and the least root of their likelihood ratio against the label.
MOST_FEATURES, LEAST_Z = 2048, 4.5
#: Rows on which weights are fitted, at most (all, if there are fewer): those of the smallest hashes of their keys.
SAMPLE_ROWS = 20_000
#: Labelled rows, at most, that are broadcast to the texts (some 60 bytes each); more are joined by a shuffle.
MOST_BROADCAST_LABELS = 500_000
#: Strength of the ridge and of the counterfactual penalty; gradient steps.
RIDGE, COUNTERFACTUAL, STEPS = 1e-4, 30.0, 300
#: Identity terms by kind; a term is swapped for another of its kind.
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("female", "male"), ("girls", "boys"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"), ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "arab", "african", "european"), ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "natives", "refugees"), ("blind", "deaf", "disabled"), ("old", "young"),
    ("frauen", "männer"), ("femmes", "hommes"), ("mujeres", "hombres"),
)

SEPARATORS = np.zeros(256, dtype=bool)
SEPARATORS[:128] = True
SEPARATORS[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False


BREAKS = np.zeros(256, dtype=bool)  # ends of sentences
BREAKS[[10, 33, 46, 63]] = True


@dataclass(frozen=True)
class Model:
    """Weight of each bucket (0 for most), the intercept, and how many rows and counterfactual pairs they were fitted on."""

    buckets: np.ndarray
    weights: np.ndarray
    intercept: float
    n_rows: int = 0
    n_pairs: int = 0

    def dense(self) -> np.ndarray:
        out = np.zeros(BUCKETS)
        out[self.buckets] = self.weights
        return out


def _bucket(hashes: np.ndarray, kind: int) -> np.ndarray:
    return (tb.mix64(hashes + np.uint64(kind * 0x632BE59BD9B4E019 & (2**64 - 1))) >> np.uint64(44)).astype(np.int64)


def word_features(data: np.ndarray, offs: np.ndarray):
    """The words (starts, texts, hashes) of a block, and (word, bucket) of all their features, repeats included."""
    starts, ends, doc = tb.words(data, offs, SEPARATORS)
    hashes = tb.hash_spans(data, starts, ends, tb.LOWER_VALUES)
    found = [(np.arange(len(starts)), _bucket(hashes, 0))]
    for k, size in enumerate(STARTS, 1):
        long = np.flatnonzero(ends - starts >= size)
        found.append((long, _bucket(tb.hash_spans(data, starts[long], starts[long] + size, tb.LOWER_VALUES), k)))
    return starts, doc, hashes, np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def features_of(words: list[str]) -> list[tuple[int, np.ndarray]]:
    """Hash of each word and the buckets of its features."""
    out = []
    for word in words:
        raw = np.frombuffer(word.lower().encode(), dtype=np.uint8)
        _, _, hashes, _, buckets = word_features(raw, np.array([0, len(raw)]))
        out.append((int(hashes[0]), buckets))
    return out


def distinct(doc: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique(doc * BUCKETS + bucket)
    return both // BUCKETS, both % BUCKETS


def _labelled(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str) -> DataFrame:
    """(key, text, y): a document's label is the largest of its own; rows without one are left out."""
    truth = labels.where(labels[label].isNotNull() & labels[key].isNotNull()).groupBy(labels[key].alias("_key")).agg(F.max(F.col(label).cast("int")).alias("_y"))
    if labels.count() <= MOST_BROADCAST_LABELS:
        truth = F.broadcast(truth)
    return docs.select(docs[key].alias("_id"), docs[text].alias("_text")).join(truth, F.col("_id") == F.col("_key")).select("_id", "_text", "_y")


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
          sample_rows: int = SAMPLE_ROWS, counterfactual: float = COUNTERFACTUAL, identity_terms=IDENTITY_TERMS, fill_own: bool = False,
          most_features: int | None = MOST_FEATURES, least_z: float | None = LEAST_Z) -> Model:
    """Weights from the labelled texts of ``docs``; without rows of both labels, a model that scores 0.5 or the one label.

    ``most_features`` and ``least_z`` bound the features by the roots of their
    likelihood ratios; None keeps all.  ``fill_own`` puts the terms that texts
    without one take for their pairs into their own rows too.
    """
    rows = _labelled(docs, labels, key, text, label)

    def counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((2, BUCKETS), dtype=np.int64)
        n = np.zeros(2, dtype=np.int64)
        for batch in batches:
            truth = np.asarray(batch.column(1).to_numpy(zero_copy_only=False), dtype=np.int64) > 0
            for first, end, data, offs in tb.blocks(batch.column(0)):
                y = truth[first:end]
                _, doc, _, word, bucket = word_features(data, offs)
                doc, bucket = distinct(doc[word], bucket)
                count[1] += np.bincount(bucket[y[doc]], minlength=BUCKETS)
                count[0] += np.bincount(bucket[~y[doc]], minlength=BUCKETS)
                n += [int((~y).sum()), int(y.sum())]
        some = np.flatnonzero(count.any(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(some, -1)), pa.array(np.append(count[0][some], n[0])), pa.array(np.append(count[1][some], n[1]))], names=["bucket", "n0", "n1"]
        )

    counts = arrow_map(rows.select("_text", "_y"), counting, "bucket bigint, n0 bigint, n1 bigint").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    # at most BUCKETS + 1 rows reach the driver
    table = counts.toArrow()
    bucket, n0, n1 = (table[c].to_numpy() for c in ("bucket", "n0", "n1"))
    whole = np.flatnonzero(bucket < 0)
    total0, total1 = (int(n0[whole].sum()), int(n1[whole].sum()))
    if not total0 or not total1:
        return Model(np.zeros(0, np.int64), np.zeros(0), 0.0 if total0 == total1 else (20.0 if total1 else -20.0))
    inside = bucket >= 0
    bucket, n0, n1 = bucket[inside], n0[inside], n1[inside]
    # signed root of the likelihood ratio of the 2 x 2 table of presence and label
    cells = np.array([n0, n1, total0 - n0, total1 - n1], dtype=float)
    sides, rows_of = np.array([total0, total1] * 2, dtype=float), np.array([n0 + n1] * 2 + [total0 + total1 - n0 - n1] * 2, dtype=float)
    z = np.sqrt(np.maximum(2 * (cells * np.log(np.maximum(cells, 1e-9) * (total0 + total1) / np.maximum(sides[:, None] * rows_of, 1e-9))).sum(axis=0), 0))
    order = np.lexsort((bucket, -z))[:most_features]
    chosen = np.sort(bucket[order if least_z is None else order[z[order] >= least_z]])

    kinds = [features_of(list(kind)) for kind in identity_terms if len(kind) > 1]
    chosen = np.unique(np.concatenate([chosen, *(f for kind in kinds for _, f in kind)]))
    share = min(1.0, 1.05 * sample_rows / (total0 + total1))

    def sampling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(BUCKETS, -1, dtype=np.int32)
        place[chosen] = np.arange(len(chosen), dtype=np.int32)
        places = [[(name, place[f]) for name, f in kind] for kind in kinds]
        for batch in batches:
            truth = np.asarray(batch.column(1).to_numpy(zero_copy_only=False), dtype=np.int64) > 0
            for first, end, data, offs in tb.blocks(batch.column(0)):
                rows = counterfactual_rows(data, offs, place, places, fill_own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(truth[first:end]), batch.column(2).slice(first, end - first), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.list_(pa.binary()))],
                    names=["y", "h", "own", "pairs"],
                )

    drawn = rows.withColumn("_h", F.xxhash64("_id")).where(F.pmod("_h", F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).select("_text", "_y", F.pmod("_h", F.lit(1 << 30)).alias("_h"))
    sample = arrow_map(drawn, sampling, "y boolean, h bigint, own binary, pairs array<binary>").toArrow()
    return _fit(chosen, sample, counterfactual, sample_rows)


def counterfactual_rows(data: np.ndarray, offs: np.ndarray, place: np.ndarray, kinds: list[list[tuple[int, np.ndarray]]], fill_own: bool = False) -> list[tuple[bytes, list[bytes]]]:
    """For each text of a block its features, and those of both sides of its counterfactual pairs, one after the other.

    ``place``: the number of a bucket's feature, or -1; ``kinds``: hash and
    features of each identity term.
    """
    starts, doc, hashes, word, bucket = word_features(data, offs)
    hit = place[bucket] >= 0
    word, feature = word[hit], place[bucket[hit]]
    order = np.argsort(word, kind="stable")
    word, feature = word[order], feature[order]
    until = np.searchsorted(word, np.arange(len(starts) + 1))
    sentence = np.searchsorted(np.flatnonzero(BREAKS[data]), starts)
    text_at = np.searchsorted(doc, np.arange(len(offs)))
    kind_of = {name: (k, i) for k, kind in enumerate(kinds) for i, (name, _) in enumerate(kind)}
    names = np.array(sorted(kind_of), dtype=np.uint64)
    mention = np.isin(hashes, names)
    draw = tb.mix64(hashes ^ np.uint64(0x9E3779B97F4A7C15))

    def with_terms(a: int, b: int, at: list[int], terms: list[np.ndarray]) -> bytes:
        """Features of the words a to b with those at ``at`` replaced by terms."""
        own = feature[until[a] : until[b]][~np.isin(word[until[a] : until[b]], at)]
        return np.unique(np.concatenate([own, *terms])).astype(np.int32).tobytes()

    out = []
    for t in range(len(offs) - 1):
        a, b = int(text_at[t]), int(text_at[t + 1])
        pairs: list[bytes] = []
        fill: tuple = ([], [])
        told = np.flatnonzero(mention[a:b]) + a
        if len(told):
            for s in np.unique(sentence[told]):
                at = [int(w) for w in told[sentence[told] == s]]
                shift = int(draw[at].sum() >> np.uint64(33))
                swapped = []
                for w in at:
                    k, i = kind_of[int(hashes[w])]
                    swapped.append(kinds[k][(i + 1 + shift % (len(kinds[k]) - 1)) % len(kinds[k])][1])
                low, high = a + np.searchsorted(sentence[a:b], [s, s + 1])
                pairs += [with_terms(low, high, [], []), with_terms(low, high, at, swapped)]
        elif kinds:
            free = np.flatnonzero(until[a + 1 : b + 1] == until[a:b]) + a
            if len(free):
                w = int(free[np.argmin(draw[free])])
                dice = int(tb.mix64(draw[a:b].sum(keepdims=True))[0])
                kind = kinds[dice % len(kinds)]
                i = (dice >> 8) % len(kind)
                low, high = a + np.searchsorted(sentence[a:b], [sentence[w], sentence[w] + 1])
                if fill_own:
                    fill = ([w], [kind[i][1]])
                one = with_terms(low, high, [w], [kind[i][1]])
                pairs = [x for j in range(len(kind)) if j != i for x in (one, with_terms(low, high, [w], [kind[j][1]]))]
        out.append((with_terms(a, b, *fill), pairs))
    return out


def _rows(lists: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of concatenated int32 lists."""
    size = np.array([len(x) // 4 for x in lists], dtype=np.int64)
    return np.repeat(np.arange(len(lists)), size), np.frombuffer(b"".join(lists), dtype=np.int32).astype(np.int64)


def _fit(chosen: np.ndarray, sample: pa.Table, counterfactual: float, sample_rows: int) -> Model:
    """The fit over the sampled rows of the smallest hashes, ordered by their features, so that the result doesn't hang on the partitions."""
    rows = sorted(zip(sample["h"].to_pylist(), sample["own"].to_pylist(), sample["y"].to_pylist(), sample["pairs"].to_pylist(), strict=True))[:sample_rows]
    rows.sort(key=lambda r: r[1:])
    own, y, pairs = [r[1] for r in rows], np.array([r[2] for r in rows], dtype=float), [p for r in rows for p in r[3]]
    weights, intercept = fit(own, y, pairs[::2], pairs[1::2], len(chosen), counterfactual)
    return Model(chosen, weights, intercept, len(own), len(pairs) // 2)


def fit(own: list[bytes], y: np.ndarray, left: list[bytes], right: list[bytes], k: int, counterfactual: float, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights of k features and the intercept: Adam on the mean logistic loss of the rows, a ridge, and the mean square of the pairs' score changes."""
    n, m = len(own), len(left)
    if not n or y.min() == y.max():
        share = float(np.clip(y.mean() if n else 0.5, 1e-6, 1 - 1e-6))
        return np.zeros(k), float(np.log(share / (1 - share)))
    (r, f), (r0, f0), (r1, f1) = _rows(own), _rows(left), _rows(right)
    w, b = np.zeros(k), float(np.log(y.mean() / (1 - y.mean())))
    mean, square = np.zeros(k + 1), np.zeros(k + 1)
    for step in range(1, steps + 1):
        s = 1 / (1 + np.exp(-np.clip(np.bincount(r, weights=w[f], minlength=n) + b, -30, 30)))
        slope = (s - y) / n
        g = np.append(np.bincount(f, weights=slope[r], minlength=k) + RIDGE * w, slope.sum())
        if m:
            change = np.bincount(r0, weights=w[f0], minlength=m) - np.bincount(r1, weights=w[f1], minlength=m)
            pull = 2 * counterfactual * change / m
            g[:-1] += np.bincount(f0, weights=pull[r0], minlength=k) - np.bincount(f1, weights=pull[r1], minlength=k)
        mean, square = 0.9 * mean + 0.1 * g, 0.999 * square + 0.001 * g * g
        move = 0.05 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def score_texts(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of df: key, the columns in ``keep``, score and predicted.

    A null or empty text has no features and the score of the intercept.
    Repeated rows are scored alike, other columns not read.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    names = [key, *keep]

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        weight = model.dense()
        for batch in batches:
            for first, end, data, offs in tb.blocks(batch.column(len(names))):
                _, doc, _, word, bucket = word_features(data, offs)
                some = weight[bucket] != 0
                doc, bucket = distinct(doc[word[some]], bucket[some])
                total = np.bincount(doc, weights=weight[bucket], minlength=end - first) + model.intercept
                score = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
                own = [batch.column(i).slice(first, end - first) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays([*own, pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=[*names, "score", "predicted"])

    picked = df.select(*[df[c].alias(f"k{i}") for i, c in enumerate(names)], df[text].alias("t"))
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names)
    return arrow_map(picked, over, f"{kinds}, score double, predicted int")
