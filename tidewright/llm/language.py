"""Language identification by unigram pieces, summed over all segmentations.

A fixed public vocabulary gives the pieces, all of them.  In each language a
piece has a probability, and a word's probability is the sum over all ways to
cut it into pieces, found by the forward algorithm; a text's is the product
over its words.  A word goes with one space before it, which stands for all
the white space there; no piece runs on behind white space, so the product is
the sum over all segmentations of the text.  Training is one step of
expectation-maximisation from a prior that is the same for every language:
forward and backward sums over the words of all training texts give the
expected count of each piece, with a smoothing that keeps every piece possible
in every language.

Words are the units of work: a block's different words are scored once each,
in step, for all languages.  A long word is cut where no piece of the
vocabulary could cross, which leaves the sum as it is; what then is still long
is summed by itself, in logarithms.  The model has languages times vocabulary
numbers; its size is known before it is broadcast.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textblocks as tb
from .runtime import arrow_map

#: Words of more bytes are cut where no piece crosses; units of more bytes than the second are summed one by one.
CUT_BYTES, LONG_BYTES = 48, 256
#: Sums below this are found again in logarithms: what plain products lose stays far below it.
LEAST_SUM = 1e-200
#: Expected count added to all pieces of a language together, spread by the counts of all languages.
SMOOTHING = 1000.0
#: Larger blocks repeat more words.
BLOCK_BYTES = 4 << 20
#: Words, and partial sums, that are held at once; bytes of a long unit.
_CHUNK, _CELLS, _WINDOW = 8192, 4_000_000, 1 << 18
#: What a text without a letter gets.
UNKNOWN = "und"
#: Numbers in a model, at most, that travel with a task.
MOST_PARAMETERS = 40_000_000


def vocabulary(ranks: bytes) -> list[bytes]:
    """The tokens of a rank file; every byte is one."""
    tokens = (base64.b64decode(x.split()[0]) for x in ranks.splitlines() if x)
    return list(dict.fromkeys([*tokens, *(bytes([b]) for b in range(256))]))


class Pieces:
    """A trie over the pieces, whose edges are one hash table of (node, byte)."""

    def __init__(self, pieces: list[bytes]):
        self.count = len(pieces)
        size = np.array([len(p) for p in pieces])
        self.longest = int(size.max())
        order = np.argsort(-size, kind="stable")
        flat = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        at = np.concatenate(([0], np.cumsum(size)))[:-1][order]
        size = size[order]
        node, nodes = np.zeros(len(pieces), dtype=np.int64), 1
        keys, numbers, ends = [], [], []
        for depth in range(1, self.longest + 1):
            n = int(np.searchsorted(-size, -depth, "right"))
            key, which = np.unique(node[:n] << 8 | flat[at[:n] + depth - 1], return_inverse=True)
            keys.append(key)
            numbers.append(nodes + np.arange(len(key)))
            node[:n] = nodes + which
            nodes += len(key)
            here = np.flatnonzero(size[:n] == depth)
            ends.append((node[here], order[here]))
        self.piece = np.full(nodes, -1, dtype=np.int32)
        for where, which in ends:
            self.piece[where] = which
        key, number = np.concatenate(keys), np.concatenate(numbers).astype(np.int32)
        self.inner = np.zeros(nodes, dtype=bool)
        self.inner[key >> 8] = True
        self.first = np.zeros(256, dtype=np.int32)
        self.first[keys[0] & 255] = numbers[0]
        bits = (2 * len(key)).bit_length() + 1
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.next = np.full(1 << bits, -1, dtype=np.int64), np.full(1 << bits, -1, dtype=np.int32)
        home, left = self._home(key), np.arange(len(key))
        while len(left):
            free = self.keys[home[left]] < 0
            self.keys[home[left[free]]] = key[left[free]]
            mine = self.keys[home[left]] == key[left]
            self.next[home[left[mine]]] = number[left[mine]]
            left = left[~mine]
            home[left] = home[left] + 1 & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def _children(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        key = node.astype(np.int64) << 8 | byte
        at = self._home(key)
        seen = self.keys[at]
        out = np.where(seen == key, self.next[at], np.int32(-1))
        left = np.flatnonzero((seen != key) & (seen >= 0))
        at = at[left]
        while len(left):
            at = at + 1 & self.mask
            seen = self.keys[at]
            hit = seen == key[left]
            out[left[hit]] = self.next[at[hit]]
            go = ~hit & (seen >= 0)
            left, at = left[go], at[go]
        return out

    def walk(self, data: np.ndarray, stop: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(size, places, pieces): all pieces that stand in the data, by size; ``stop``: the end of each place's unit."""
        place, node = np.arange(len(data)), self.first[data]
        size = 1
        while len(place):
            piece = self.piece[node]
            some = np.flatnonzero(piece >= 0)
            yield size, place[some], piece[some]
            go = self.inner[node]
            go &= place + size < stop[place]
            place, node = place[go], node[go]
            node = self._children(node, data[place + size])
            place, node = place[node >= 0], node[node >= 0]
            size += 1


def block_words(data: np.ndarray, offs: np.ndarray):
    """The words of a block: bytes of the different ones, each behind a space, with their starts and lengths, and per word of a text which and whose."""
    starts, ends, doc = tb.words(data, offs)
    _, pick, which = np.unique(tb.hash_spans(data, starts, ends), return_index=True, return_inverse=True)
    starts, lengths = starts[pick], (ends - starts)[pick] + 1
    at = np.concatenate(([0], np.cumsum(lengths)))[:-1].astype(np.int64)
    flat = np.full(int(lengths.sum()), 32, dtype=np.uint8)
    inside = np.ones(len(flat), dtype=bool)
    inside[at] = False
    flat[inside] = data[np.repeat(starts - at - 1, lengths)[inside] + np.flatnonzero(inside)]
    return flat, at, lengths, which, doc


def units_of(flat: np.ndarray, at: np.ndarray, lengths: np.ndarray, pieces: Pieces):
    """Starts, lengths and words of the units: words of up to CUT_BYTES, and longer ones in parts between which no piece crosses."""
    long = np.flatnonzero(lengths > CUT_BYTES)
    short = np.flatnonzero(lengths <= CUT_BYTES)
    parts = [(at[short], lengths[short], short)]
    for w in long.tolist():
        text = flat[at[w] : at[w] + lengths[w]]
        open_ = np.zeros(len(text) + 1, dtype=np.int64)
        for low in range(0, len(text), _WINDOW):
            seen = text[low : low + _WINDOW + pieces.longest]
            for size, place, _ in pieces.walk(seen, np.full(len(seen), len(seen))):
                if size > 1:
                    np.add.at(open_, low + place + 1, 1)
                    np.add.at(open_, low + place + size, -1)
        cuts = np.flatnonzero(np.cumsum(open_)[: len(text)] == 0)
        parts.append((at[w] + cuts, np.diff(np.append(cuts, len(text))), np.full(len(cuts), w)))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def lattices(flat: np.ndarray, at: np.ndarray, lengths: np.ndarray, pieces: Pieces, n_columns: int = 1):
    """Chunks of units, the longest first, with cells (end, size, units, piece of each) by end."""
    order = np.argsort(-lengths, kind="stable")
    first = 0
    while first < len(order):
        n = max(1, min(_CHUNK, _CELLS // (int(lengths[order[first]] + 1) * n_columns)))
        rows = order[first : first + n]
        first += n
        size_of = lengths[rows]
        until = np.cumsum(size_of)
        begin = until - size_of
        text = flat[np.repeat(at[rows] - begin, size_of) + np.arange(until[-1])]
        owner = np.repeat(np.arange(len(rows)), size_of)
        cells = []
        for size, place, piece in pieces.walk(text, until[owner]):
            if not len(place):
                continue
            end = (place - begin[owner[place]] + size).astype(np.int16)  # at most LONG_BYTES
            by_end = np.argsort(end, kind="stable")
            end = end[by_end]
            limits = np.flatnonzero(np.append(True, end[1:] != end[:-1]))
            units, piece = owner[place[by_end]], piece[by_end]
            cells += [(int(end[a]), size, units[a:b], piece[a:b]) for a, b in zip(limits.tolist(), [*limits[1:].tolist(), len(end)], strict=True)]
        cells.sort(key=lambda c: c[0])
        yield rows, cells


def forward(cells: list, probabilities: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums over all segmentations of each prefix [end, unit, language], and of each whole unit; ``probabilities``: [piece, language]."""
    alpha = np.zeros((int(lengths[0]) + 1, len(lengths), probabilities.shape[1]))
    alpha[0] = 1.0
    for end, size, use, piece in cells:
        alpha[end, use] += alpha[end - size, use] * probabilities[piece]
    return alpha, alpha[lengths, np.arange(len(lengths))]


def _pieces_by_end(text: np.ndarray, pieces: Pieces, low: int, high: int):
    """(ends, sizes, pieces) of all pieces that end behind ``low`` and up to ``high``, by end."""
    begin = max(low - pieces.longest, 0)
    seen = text[begin:high]
    found = [(place + begin + size, np.full(len(place), size), piece) for size, place, piece in pieces.walk(seen, np.full(len(seen), len(seen)))]
    end, size, piece = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(end, kind="stable")
    order = order[end[order] > low]
    return end[order], size[order], piece[order]


def long_sums(text: np.ndarray, logs: np.ndarray, pieces: Pieces) -> np.ndarray:
    """[end, language]: the logarithm of the sum over all segmentations of each prefix of one unit; ``logs``: [piece, language]."""
    out = np.zeros((len(text) + 1, logs.shape[1]))
    for low in range(0, len(text), _WINDOW):
        high = min(low + _WINDOW, len(text))
        end, size, piece = _pieces_by_end(text, pieces, low, high)
        limits = np.searchsorted(end, np.arange(low + 1, high + 2))
        begin = end - size
        for e in range(low + 1, high + 1):
            cell = slice(limits[e - low - 1], limits[e - low])
            terms = out[begin[cell]] + logs[piece[cell]]
            most = terms.max(axis=0)
            out[e] = most + np.log(np.exp(terms - most).sum(axis=0))
    return out


def long_counts(text: np.ndarray, logs: np.ndarray, pieces: Pieces) -> np.ndarray:
    """[piece]: the expected number of uses of each piece in one unit."""
    alpha = long_sums(text, logs[:, None], pieces)[:, 0]
    n = len(text)
    beta = np.full(n + 1, -np.inf)
    beta[n] = -alpha[n]
    out = np.zeros(len(logs))
    for low in reversed(range(0, n, _WINDOW)):
        end, size, piece = _pieces_by_end(text, pieces, low, min(low + _WINDOW, n))
        for k in range(len(end) - 1, -1, -1):
            at = end[k] - size[k]
            beta[at] = np.logaddexp(beta[at], logs[piece[k]] + beta[end[k]])
        out += np.bincount(piece, weights=np.exp(alpha[end - size] + logs[piece] + beta[end]), minlength=len(logs))
    return out


def unit_logs(flat: np.ndarray, at: np.ndarray, lengths: np.ndarray, pieces: Pieces, probabilities: np.ndarray) -> np.ndarray:
    """[unit, language]: the logarithm of each unit's sum."""
    out = np.zeros((len(at), probabilities.shape[1]))
    slow = lengths > LONG_BYTES
    fast = np.flatnonzero(~slow)
    for rows, cells in lattices(flat, at[fast], lengths[fast], pieces, probabilities.shape[1]):
        whole = forward(cells, probabilities, lengths[fast[rows]])[1]
        out[fast[rows]] = np.log(np.maximum(whole, LEAST_SUM))
        slow[fast[rows]] = (whole < LEAST_SUM).any(axis=1)
    if slow.any():
        logs = np.log(probabilities)
        for u in np.flatnonzero(slow).tolist():
            out[u] = long_sums(flat[at[u] : at[u] + lengths[u]], logs, pieces)[-1]
    return out


def expected_counts(cells: list, prior: np.ndarray, lengths: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[language, piece]: the expected number of uses of each piece, and units too small for it; weights [language, unit] are the units' counts."""
    alpha, whole = forward(cells, prior[:, None], lengths)
    alpha, whole = alpha[:, :, 0], whole[:, 0]
    small = whole < LEAST_SUM
    beta = np.zeros(alpha.shape)
    beta[lengths, np.arange(len(lengths))] = np.where(small, 0.0, 1.0 / np.where(small, 1.0, whole))
    used = []
    for end, size, use, piece in reversed(cells):  # all cells that start at or behind ``end`` come before those that end there
        through = prior[piece] * beta[end, use]
        beta[end - size, use] += through
        used.append((piece, use, alpha[end - size, use] * through))
    piece, use, share = (np.concatenate(x) for x in zip(*used, strict=True))
    out = np.zeros((weights.shape[0], len(prior)))
    for k in np.flatnonzero(weights.any(axis=1)):
        out[k] = np.bincount(piece, weights=share * weights[k, use], minlength=len(prior))
    return out, np.flatnonzero(small)


def block_counts(data: np.ndarray, offs: np.ndarray, own: np.ndarray, n_lang: int, pieces: Pieces, prior: np.ndarray) -> np.ndarray:
    """[language, piece]: the expected uses in a block of texts, whose languages are ``own``."""
    total = np.zeros((n_lang, pieces.count))
    flat, at, lengths, which, doc = block_words(data, offs)
    if not len(which):
        return total
    weights = np.bincount(own[doc] * len(at) + which, minlength=n_lang * len(at)).reshape(n_lang, len(at))
    start, size, word = units_of(flat, at, lengths, pieces)
    slow = np.flatnonzero(size > LONG_BYTES).tolist()
    fast = np.flatnonzero(size <= LONG_BYTES)
    for rows, cells in lattices(flat, start[fast], size[fast], pieces):
        found, small = expected_counts(cells, prior, size[fast[rows]], weights[:, word[fast[rows]]])
        total += found
        slow += fast[rows[small]].tolist()
    for u in slow:
        total += weights[:, word[u], None] * long_counts(flat[start[u] : start[u] + size[u]], np.log(prior), pieces)
    return total


def block_scores(data: np.ndarray, offs: np.ndarray, pieces: Pieces, probabilities: np.ndarray) -> np.ndarray:
    """[language, text]: the logarithm of the sum over all segmentations; ``probabilities``: [piece, language]."""
    n, n_lang = len(offs) - 1, probabilities.shape[1]
    out = np.zeros((n_lang, n))
    if not n_lang:
        return out
    flat, at, lengths, which, doc = block_words(data, offs)
    if len(which):
        start, size, word = units_of(flat, at, lengths, pieces)
        of_unit = unit_logs(flat, start, size, pieces, probabilities)
        for k in range(n_lang):
            of_word = np.bincount(word, weights=of_unit[:, k], minlength=len(at))
            out[k] = np.bincount(doc, weights=of_word[which], minlength=n)
    return out


def prior_of(pieces: list[bytes]) -> np.ndarray:
    """The first probabilities: by a piece's length alone, so that longer pieces win."""
    size = np.array([len(p) for p in pieces])
    p = 1.0 / np.bincount(size)[size] / 2.0 ** np.minimum(size, 900)
    return p / p.sum()


def train(df: DataFrame, ranks: bytes, lang: str = "lang", text: str = "text"):
    """(languages, pieces, probabilities [language, piece]) from the rows with a lang and a text.

    Blocks send the expected counts of their own words, which Spark adds up by
    language and piece: at most languages x pieces rows, however large the
    corpus or one language in it.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary(ranks))

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, int] = {}
        pieces = Pieces(shared.value)
        prior = prior_of(shared.value)
        total: list[np.ndarray] = []
        for batch in batches:
            spoken = batch.column(0).to_pylist()
            for first, end, data, offs in tb.blocks(batch.column(1), BLOCK_BYTES):
                own = np.array([names.setdefault(x, len(names)) for x in spoken[first:end]], dtype=np.int64)
                while len(total) < len(names):
                    total.append(np.zeros(pieces.count))
                for k, x in enumerate(block_counts(data, offs, own, len(names), pieces, prior)):
                    total[k] += x
        for name, k in names.items():
            some = np.flatnonzero(total[k])
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(total[k][some])], names=["lang", "piece", "uses"])

    rows = arrow_map(df.where(df[lang].isNotNull() & df[text].isNotNull()).select(df[lang], df[text]), over, "lang string, piece int, uses double")
    # added up in fixed point, so that the order of the partitions doesn't show
    counts = rows.groupBy("lang", "piece").agg(F.sum(F.round(F.col("uses") * 1e6).cast("bigint")).alias("uses")).toArrow()
    languages = sorted(set(counts["lang"].to_pylist()))
    n = len(shared.value)
    if len(languages) * n > MOST_PARAMETERS:
        raise ValueError(f"{len(languages)} languages and {n} pieces make more than {MOST_PARAMETERS} parameters")
    uses = np.zeros((len(languages), n))
    number = {x: k for k, x in enumerate(languages)}
    uses[[number[x] for x in counts["lang"].to_pylist()], counts["piece"].to_numpy()] = counts["uses"].to_numpy() / 1e6
    back = uses.sum(axis=0) + prior_of(shared.value) * 100
    back /= back.sum()
    uses += SMOOTHING * back
    uses /= uses.sum(axis=1, keepdims=True)
    return languages, shared.value, uses


_LETTER = regex.compile(r"\p{L}")


def identify(df: DataFrame, model, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of df: key, the columns in ``keep``, lang_pred and score.

    score is the language's posterior under equal shares of the languages.
    Null, empty and letterless texts, and all where nothing was learned, get
    ``und`` and 0.  Ties go to the language that sorts first.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    names = [key, *keep]

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, piece_list, probabilities = shared.value
        pieces, probabilities = Pieces(piece_list), np.ascontiguousarray(probabilities.T)
        label = np.array([*languages, UNKNOWN], dtype=object)
        for batch in batches:
            for first, end, data, offs in tb.blocks(batch.column(len(names)), BLOCK_BYTES):
                n, n_lang = end - first, len(languages)
                scores = block_scores(data, offs, pieces, probabilities)
                raw = data.tobytes()
                lettered = _with_letter(data, offs, raw)
                if n_lang:
                    best = scores.argmax(axis=0)
                    share = 1.0 / np.exp(scores - scores.max(axis=0)).sum(axis=0)
                else:
                    best, share = np.zeros(n, dtype=np.int64), np.zeros(n)
                    lettered[:] = False
                best = np.where(lettered, best, n_lang)
                own = [batch.column(i).slice(first, n) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays([*own, pa.array(label[best].tolist(), pa.string()), pa.array(np.where(lettered, share, 0.0))], names=[*names, "lang_pred", "score"])

    picked = df.select(*[df[c].alias(f"k{i}") for i, c in enumerate(names)], df[text].alias("t"))
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names)
    return arrow_map(picked, over, f"{kinds}, lang_pred string, score double")


def _with_letter(data: np.ndarray, offs: np.ndarray, raw: bytes) -> np.ndarray:
    """Whether a text has a letter: an ASCII one is seen at once, others by their property."""
    low = data | 32
    total = np.concatenate(([0], np.cumsum((low >= 97) & (low <= 122))))
    found = total[offs[1:]] > total[offs[:-1]]
    for r in np.flatnonzero(~found & (offs[1:] > offs[:-1])).tolist():
        found[r] = bool(_LETTER.search(raw[offs[r] : offs[r + 1]].decode("utf-8")))
    return found


def held_out(key: Column) -> Column:
    """Rows that are never learned from: CRC-32 of the key's text is a multiple of 5.  A null key has the empty text, whose CRC-32 is 0."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 == 0
