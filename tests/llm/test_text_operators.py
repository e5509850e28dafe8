"""Operators of one text at a time, against plain versions."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewright.llm import byte_bpe, language, quality, sharding, toxicity, url_filter
from tidewright.llm import textblocks as tb
from tidewright.llm.queries import vocabulary_path


def rows(df):
    return [r.asDict() for r in df.collect()]


@pytest.fixture(scope="module")
def odd_docs(spark):
    data = [(1, "one two three", "x", 5), (2, None, "x", None), (3, "", None, 1), (None, "no key here", "x", 1), (1, "one two three", "x", 5), (4, " \n\t", "x", 0), (5, "word " * 30_000, "x", 9)]
    return spark.createDataFrame(data, "doc_id bigint, text string, kept string, n_words int")


# ---------------------------------------------------------------- byte-level BPE
def test_bpe_equals_tiktoken():
    import base64

    import public_tokenizers
    import tiktoken

    lines = byte_bpe.read_file(vocabulary_path())
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())}
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    voc = byte_bpe.Vocabulary(lines)
    rng = random.Random(3)
    parts = ["'", "s", "t", "re", "ve", "ll", "l", "r", "e", "d", "m", " ", "  ", "\n", "\t", "1", "23", "!", "?", "é", "ß", " ", "　", "漢", "🙂", "A", "\x00", "\x1c", "½", "_", "​", "́", "hello", "<|endoftext|>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["", "a" * 3000, "ab" * 1500, "é" * 900, " " * 500, None]
    at = 0
    for first, end, data, offs in tb.blocks(pa.array(texts), 4000):
        tokens, until = voc.encode(data, offs)
        assert voc.decode(tokens).tobytes() == data.tobytes()
        for i in range(end - first):
            assert tokens[until[i] : until[i + 1]].tolist() == reference.encode_ordinary(texts[at] or ""), texts[at]
            at += 1
    assert at == len(texts)


def test_bpe_rows(spark, odd_docs):
    out = rows(byte_bpe.encode_documents(odd_docs, byte_bpe.read_file(vocabulary_path()), keep_ids=True))
    assert len(out) == 7
    nothing = hashlib.sha256(b"").hexdigest()
    by_id = {r["doc_id"]: r for r in out}
    assert by_id[2]["n_tokens"] == by_id[3]["n_tokens"] == 0 and by_id[2]["ids_sha256"] == by_id[2]["decoded_sha256"] == nothing
    assert by_id[5]["decoded_sha256"] == hashlib.sha256(b"word " * 30_000).hexdigest()
    ids = np.array(by_id[1]["token_ids"], dtype="<u4").tobytes()
    assert by_id[1]["ids_sha256"] == hashlib.sha256(ids).hexdigest()
    assert byte_bpe.encode_documents(odd_docs.limit(0), byte_bpe.read_file(vocabulary_path())).count() == 0


def test_scan_is_a_fold():
    functions, table, _, _ = byte_bpe.monoid()
    kinds = np.random.default_rng(1).integers(0, byte_bpe.N_CLASSES, 1000)
    scanned = byte_bpe.scan_states(functions[kinds], table)
    acc = functions[kinds[0]]
    for i, kind in enumerate(kinds):
        acc = functions[kind] if i == 0 else table[acc, functions[kind]]
        assert scanned[i] == acc


# ---------------------------------------------------------------- quality
def plain_quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    longest = [0] * len(words)
    for i in range(len(words)):
        for j in range(len(words)):
            k = 0
            while i != j and max(i, j) + k < len(words) and words[i + k] == words[j + k]:
                k += 1
            longest[i] = max(longest[i], k)
    covered = {j for i, m in enumerate(longest) if m >= quality.LEAST_REPEAT for j in range(i, i + m)}
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), len(covered), max([m for m in longest if m >= quality.LEAST_REPEAT], default=0)]


def test_quality_equals_plain():
    rng = random.Random(2)
    texts = ["", None, " \n ", "a", "a b c a b c", "x " * 60, "é é\té\n\né é\té"]
    texts += ["".join(rng.choice(["a", "b", "c", "é", "#", "<", " ", " ", " ", "\n", "\t", "\x0b"]) for _ in range(rng.randint(0, 120))) for _ in range(150)]
    for _ in range(20):
        passage = " ".join(rng.choice("abcdefghij") for _ in range(30))
        texts.append(f"{passage} zz {passage}\n{passage}")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat")
    for first, end, data, offs in tb.blocks(pa.array(texts), 500):
        m = quality.measure(data, offs)
        for i in range(end - first):
            assert [int(m[c][i]) for c in names] == plain_quality(texts[first + i]), texts[first + i]


def test_quality_of_a_very_long_text():
    """10 MB of one word, and of ever the same line, in some arrays of the words."""
    import resource

    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    for text, period in ((b"word " * 2_000_000, 1), ((" ".join(f"w{i}" for i in range(2000)) + "\n").encode() * 1000, 2000)):
        data = np.frombuffer(text, dtype=np.uint8)
        m = quality.measure(data, np.array([0, len(data)]))
        n = len(text.split())
        assert m["n_words"][0] == n == m["n_repeat_words"][0] == m["covered_words"][0]
        assert m["longest_repeat"][0] == n - period
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 900_000


def test_hashes_of_spans_do_not_hang_on_the_block():
    rng = np.random.default_rng(2)
    data = rng.integers(0, 256, 3 << 20).astype(np.uint8)
    cuts = np.unique(np.concatenate([[0, 1 << 20, (5 << 19) + 7], rng.integers(0, 5000, 200), rng.integers(5 << 19, 3 << 20, 500), [len(data)]]))
    assert (tb.hash_spans(data, cuts[:-1], cuts[1:]) == tb.span_hashes(tb.prefix_hash(data), cuts[:-1], cuts[1:])).all()


def test_quality_rows(spark, odd_docs):
    out = rows(quality.judge_quality(odd_docs))
    assert len(out) == 7 and not any(r["kept"] for r in out)
    assert {r["n_words"] for r in out if r["doc_id"] in (2, 3, 4)} == {0}
    long = next(r for r in out if r["doc_id"] == 5)
    assert long["n_words"] == 30_000 and long["n_repeat_words"] == 30_000 and long["base_failed"]
    clean = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(80))), (2, " ".join(f"w{i % 120}" for i in range(240)) + " x" * 0)], "doc_id bigint, text string")
    verdict = {r["doc_id"]: r for r in rows(quality.judge_quality(clean))}
    assert verdict[1]["kept"] and not verdict[2]["kept"] and verdict[2]["longest_repeat"] == 120
    assert quality.judge_quality(odd_docs.limit(0)).count() == 0


def test_quality_covered_fraction_rejects_alone(spark):
    def text(n_passages):
        passages = [" ".join(f"p{i}x{k}" for k in range(20)) for i in range(n_passages)]
        parts = [x for i, p in enumerate(passages + passages) for x in (p, f"s{i}")]
        return " ".join(parts + [f"u{i}" for i in range(1000 - 42 * n_passages)])

    out = {r["doc_id"]: r for r in rows(quality.judge_quality(spark.createDataFrame([(1, text(10)), (2, text(7))], "doc_id bigint, text string")))}
    assert all(r["n_words"] == 1000 and r["longest_repeat"] == 20 and not r["base_failed"] for r in out.values())
    assert (out[1]["covered_words"], out[1]["kept"], out[2]["covered_words"], out[2]["kept"]) == (400, False, 280, True)


# ---------------------------------------------------------------- sharding
def test_lookup_table_is_even_and_stable():
    table = sharding.lookup_table()
    counts = Counter(table)
    assert len(table) == sharding.TABLE_SIZE and max(counts.values()) - min(counts.values()) <= 1
    fewer = sharding.lookup_table(sharding.SHARDS[:-1])
    moved = sum(a != b for a, b in zip(table, fewer, strict=True) if a != len(sharding.SHARDS) - 1)
    assert moved < 0.1 * len(table)
    for bad in ((), ("a", "a")):
        with pytest.raises(ValueError):
            sharding.lookup_table(bad)
    with pytest.raises(ValueError):
        sharding.lookup_table(("a",), 10)


def test_sharding_rows(spark, odd_docs):
    out = rows(sharding.shard_rows(odd_docs.withColumnRenamed("kept", "slot"), "doc_id", ("a", "b", "c"), 101))
    assert len(out) == 7 and {r["shard"] for r in out} <= {"a", "b", "c"}
    assert len({(r["slot"], r["shard"]) for r in out if r["doc_id"] == 1}) == 1
    assert sharding.shard_rows(odd_docs.limit(0), "doc_id").count() == 0
    clash = odd_docs.toDF("doc_id", "_slot", "c0", "_shard")
    placed = sharding.shard_rows(clash, "doc_id")
    assert placed.columns == ["doc_id", "_slot", "c0", "_shard", "slot", "shard"] and placed.count() == 7
    twice = odd_docs.select("doc_id", "text", "text", "n_words").toDF("doc_id", "Slot", "at", "at")
    assert sharding.shard_rows(twice, "doc_id").columns == ["doc_id", "at", "at", "slot", "shard"]


# ---------------------------------------------------------------- URLs
@pytest.mark.parametrize(
    ("url", "host", "path", "rule", "verdict"),
    [
        (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("no scheme", "", "", None, "allow"), ("http://A.Example.NET/en/x?q#f", "a.example.net", "/en/x", "example.net/en/", "allow"),
        ("http://example.net/enx", "example.net", "/enx", "net/", "block"), ("http://example.net", "example.net", "", None, "allow"), ("http://notexample.net/en/", "notexample.net", "/en/", "net/", "block"),
        ("https://m.example.com/de/1#top", "m.example.com", "/de/1", "example.com/de/", "block"), ("https://m.example.com/en/", "m.example.com", "/en/", None, "allow"),
        ("http://x.org/fr/", "x.org", "/fr/", "org/fr/", "allow"), ("http://x.org?/fr/", "x.org", "", None, "allow"), ("http://net/", "net", "/", "net/", "block"), ("http:///a", "", "/a", None, "allow"),
    ],
)
def test_url_rules(url, host, path, rule, verdict):
    assert url_filter.parts(url) == (host, path)
    assert url_filter.Trie().match(host, path) == (rule, verdict)


def test_url_rules_of_odd_hosts_and_ties():
    trie = url_filter.Trie([("block", "net", ""), ("allow", "a.net", "/x/"), ("block", "a.net", "/x/"), ("block", "b.net", "/"), ("allow", "b.net", "/"), ("block", "B.ORG", "/")])
    for host in ("x..\0ends.\0paths.net", "\0paths.net", "\0ends.net", "..net", ".net"):
        assert trie.match(host, "/\0ends/") == ("net", "block")
    assert trie.match("\0paths", "/") == (None, "allow") and trie.match("", "") == (None, "allow")
    assert trie.match("a.net", "/x/") == ("a.net/x/", "block") and trie.match("b.net", "/") == ("b.net/", "allow")  # the last one holds
    assert trie.match("c.b.org", "/") == ("B.ORG/", "block")


def test_url_trie_equals_plain(spark):
    rng = random.Random(5)
    labels, pieces = ["a", "b", "c"], ["", "x", "xy", "y"]
    make = lambda: (".".join(rng.choice(labels) for _ in range(rng.randint(1, 3))), "/" + "/".join(rng.choice(pieces) for _ in range(rng.randint(0, 3))))
    rules = [(rng.choice(["allow", "block"]), *r) for r in dict.fromkeys(make() for _ in range(30))]
    trie = url_filter.Trie(rules)
    for _ in range(2000):
        host, path = make()
        fits = [(h.count("."), len(p), h, p, v) for v, h, p in rules if ("." + host).endswith("." + h) and path.startswith(p)]
        best = max(fits, default=None)
        assert trie.match(host, path) == ((best[2] + best[3], best[4]) if best else (None, "allow"))
    pages = spark.createDataFrame([(1, "http://a.net/", "h"), (1, "http://a.net/", "h"), (None, None, None)], "page_id bigint, url string, rule string")
    assert url_filter.judge_urls(pages).count() == 3 and url_filter.judge_urls(pages.limit(0)).count() == 0
    with pytest.raises(ValueError):
        url_filter.Trie([("block", "x", "/")] * (url_filter.MOST_RULES + 1))


# ---------------------------------------------------------------- language
def plain_log(text, logs, number, longest):
    """The logarithm of the sum over all segmentations of the words of a text, each behind a space."""
    total = 0.0
    for word in re.findall(rb"[^\x20\x09-\x0D]+", text):
        word = b" " + word
        alpha = [0.0]
        for e in range(1, len(word) + 1):
            alpha.append(np.logaddexp.reduce([alpha[s] + logs[number[word[s:e]]] for s in range(max(0, e - longest), e) if word[s:e] in number]))
        total += alpha[-1]
    return total


@pytest.fixture(scope="module")
def pieces():
    listed = language.vocabulary(byte_bpe.read_file(vocabulary_path()))
    assert len(listed) == 50_256
    return listed, {p: i for i, p in enumerate(listed)}, language.Pieces(listed)


def test_text_score_sums_all_segmentations(pieces):
    listed, number, trie = pieces
    rng = np.random.default_rng(4)
    chance = rng.random((len(listed), 3)) ** 8 + 1e-12
    chance /= chance.sum(axis=0)
    noise = bytes(rng.integers(33, 127, 700).astype(np.uint8)).decode()
    texts = ["Hello wörld, a thing\n\n in the  house", "", " \t ", "a" * 900, "=" * 300 + "the" * 40, noise, "漢字仮名交じり文" * 30, "x", None, "internationalisation " * 50]
    for first, end, data, offs in tb.blocks(pa.array(texts), 2000):
        scores = language.block_scores(data, offs, trie, chance)
        for i in range(end - first):
            raw = (texts[first + i] or "").encode()
            for k in range(3):
                assert np.isclose(scores[k, i], plain_log(raw, np.log(chance[:, k]), number, trie.longest), rtol=1e-10, atol=1e-9), raw[:30]


def test_expected_uses_equal_plain(pieces):
    listed, number, trie = pieces
    prior = language.prior_of(listed)
    words = [b" the", b" thing", b" w\xc3\xb6rld", b" abab"]

    def segmentations(word):
        return [[]] if not word else [[word[:k], *rest] for k in range(1, len(word) + 1) if word[:k] in number for rest in segmentations(word[k:])]

    expected = np.zeros(len(listed))
    for word in words:
        ways = segmentations(word)
        weights = [np.prod([prior[number[p]] for p in way]) for way in ways]
        for way, weight in zip(ways, weights, strict=True):
            for p in way:
                expected[number[p]] += weight / sum(weights)
    text = b"".join(words)
    data = np.frombuffer(text, dtype=np.uint8)
    found = language.block_counts(data, np.array([0, len(data)]), np.zeros(1, np.int64), 1, trie, prior)[0]
    assert np.allclose(found, expected, rtol=1e-10)
    # every byte of a text, and the space of each word, lies in one piece; long units go one by one
    for text in (b"a" * 1000, b"=" * 600 + b" the " * 30, "é".encode() * 400):
        data = np.frombuffer(text, dtype=np.uint8)
        found = language.block_counts(data, np.array([0, len(data)]), np.zeros(1, np.int64), 1, trie, prior)[0]
        units = re.findall(rb"[^\x20\x09-\x0D]+", text)
        assert np.isclose((found * [len(p) for p in listed]).sum(), sum(len(u) + 1 for u in units))
    for one in (b" the", b" abababab"):
        data = np.frombuffer(one, dtype=np.uint8)
        fast = language.block_counts(data, np.array([0, len(data)]), np.zeros(1, np.int64), 1, trie, prior)[0]
        assert np.allclose(fast, language.long_counts(data, np.log(prior), trie), rtol=1e-9, atol=1e-15)


def test_language_rows(spark):
    learn = spark.createDataFrame([("en", "the cat and the dog with the hat"), ("de", "der Hund und die Katze mit dem Hut"), (None, "the"), ("fr", None)] * 20, "lang string, text string")
    ranks = byte_bpe.read_file(vocabulary_path())
    model = language.train(learn, ranks)
    assert model[0] == ["de", "en"]
    docs = spark.createDataFrame([(1, "the hat and the dog"), (2, "die Katze und der Hut"), (3, None), (4, "123 !"), (5, ""), (6, "the " * 20_000), (1, "the hat and the dog")], "doc_id bigint, text string")
    out = {r["doc_id"]: r for r in rows(language.identify(docs, model))}
    assert [out[i]["lang_pred"] for i in range(1, 7)] == ["en", "de", "und", "und", "und", "en"]
    assert out[3]["score"] == 0.0 and all(0 <= r["score"] <= 1 for r in out.values())
    nothing = language.train(learn.limit(0), ranks)
    assert {r["lang_pred"] for r in rows(language.identify(docs, nothing))} == {"und"}


# ---------------------------------------------------------------- toxicity
def toxic_data(spark):
    rng = random.Random(7)
    docs, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        words = [f"w{rng.randint(0, 60)}" for _ in range(20)]
        if bad:
            words += ["idiot"]
        # an identity term goes along with the label, and is neutral by itself
        if rng.random() < (0.9 if bad else 0.05):
            words += ["muslim"]
        elif rng.random() < 0.3:
            words += ["christian"]
        rng.shuffle(words)
        docs.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id bigint, toxic int")


def test_toxicity_learns_and_ignores_identity(spark):
    docs, labels = toxic_data(spark)
    model = toxicity.train(docs, labels)
    loose = toxicity.train(docs, labels, counterfactual=0.0)
    probe = spark.createDataFrame([(1, "w1 w2 muslim w3"), (2, "w1 idiot w2"), (3, None), (4, ""), (5, "w1 w2 w3")], "doc_id bigint, text string")
    with_, without = ({r["doc_id"]: r for r in rows(toxicity.score_texts(probe, m))} for m in (model, loose))
    assert with_[2]["predicted"] == 1 and with_[1]["predicted"] == 0 and with_[5]["predicted"] == 0
    assert with_[1]["score"] - with_[5]["score"] < 0.2 * max(without[1]["score"] - without[5]["score"], 0.05)
    assert with_[3]["score"] == with_[4]["score"] and 0 <= with_[3]["score"] <= 1


def test_toxicity_fit_equals_plain():
    """Adam on dense arrays, with the gradient of the loss written out row by row."""
    rng = np.random.default_rng(5)
    k, n, m = 12, 40, 15
    rows = [np.flatnonzero(rng.random(k) < 0.3).astype(np.int32) for _ in range(n + 2 * m)]
    y = (rng.random(n) < 0.4).astype(float)
    own, left, right = ([r.tobytes() for r in part] for part in (rows[:n], rows[n : n + m], rows[n + m :]))
    dense = np.zeros((n + 2 * m, k))
    for i, r in enumerate(rows):
        dense[i, r] = 1
    x, change = dense[:n], dense[n : n + m] - dense[n + m :]
    w, b, first, second = np.zeros(k), np.log(y.mean() / (1 - y.mean())), np.zeros(k + 1), np.zeros(k + 1)
    for step in range(1, 51):
        slope = (1 / (1 + np.exp(-(x @ w + b))) - y) / n
        g = np.append(x.T @ slope + toxicity.RIDGE * w + 2 * 7.0 / m * change.T @ (change @ w), slope.sum())
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g**2
        move = 0.05 * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    weights, intercept = toxicity.fit(own, y, left, right, k, 7.0, steps=50)
    assert np.allclose(weights, w, atol=1e-10) and np.isclose(intercept, b)


def test_toxicity_pairs_are_sentences_with_swapped_terms():
    kinds = [toxicity.features_of(list(kind)) for kind in (("muslim", "christian"), ("old", "young"))]
    buckets = np.unique(np.concatenate([f for kind in kinds for _, f in kind] + [f for _, f in toxicity.features_of(["idiot", "nice"])]))
    place = np.full(toxicity.BUCKETS, -1, dtype=np.int32)
    place[buckets] = np.arange(len(buckets), dtype=np.int32)
    places = [[(name, place[f]) for name, f in kind] for kind in kinds]
    number = lambda *words: sorted({int(i) for _, f in toxicity.features_of(list(words)) for i in place[f] if i >= 0})
    texts = ["A muslim idiot. An old, nice man. No term here.", "Nothing but words. An idiot too.", "", "idiot"]
    data = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    rows = toxicity.counterfactual_rows(data, np.cumsum([0, *map(len, texts)]), place, places, fill_own=True)
    shown = [(np.frombuffer(own, np.int32).tolist(), [np.frombuffer(p, np.int32).tolist() for p in pairs]) for own, pairs in rows]
    assert shown[0] == (number("muslim", "idiot", "old", "nice"), [number("muslim", "idiot"), number("christian", "idiot"), number("old", "nice"), number("young", "nice")])
    terms = [number(name) for name in ("muslim", "christian", "old", "young")]
    own, (a, b) = shown[1]
    rest = number("idiot")
    filled = [t for t in terms if set(t) <= set(own)]
    assert len(filled) == 1 and set(own) == set(filled[0]) | set(rest)  # one term stands in place of a word without weight
    assert set(a) - set(rest) == set(filled[0]) and [t for t in terms if set(t) <= set(b)] != filled and (set(a) >= set(rest)) == (set(b) >= set(rest))
    assert shown[2] == ([], []) and shown[3] == (rest, [])


def test_toxicity_query_uses_its_penalty(spark):
    """With terms put into the rows of the corpus, which mentions none: neutral mentions in held-out texts move the score far less than without the penalty."""
    folder = "/root/testdata/sf0.01"
    held = language.held_out(F.col("doc_id"))
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{folder}/labels.parquet")
    model, loose = (toxicity.train(docs.where(~held), labels, counterfactual=c, fill_own=True) for c in (toxicity.COUNTERFACTUAL, 0.0))
    assert model.n_pairs > 0.9 * model.n_rows > 0 and not np.allclose(model.weights, loose.weights)
    terms = F.array(*[F.lit(x) for kind in toxicity.IDENTITY_TERMS for x in kind])
    neutral = docs.where(held).select("doc_id", F.concat(F.element_at(terms, (F.col("doc_id") % F.size(terms) + 1).cast("int")), F.lit(" "), "text").alias("text"))

    def moved(m):
        odds = lambda d: {r["doc_id"]: np.log(r["score"] / (1 - r["score"])) for r in rows(toxicity.score_texts(d, m))}
        a, b = odds(docs.where(held)), odds(neutral)
        return np.mean([abs(a[i] - b[i]) for i in a])

    assert moved(model) < 0.5 * moved(loose)


def planted(spark, folder):
    """Held-out texts, labels, and training texts of which 80 % of the toxic and 10 % of the clean ones take a term."""
    held = language.held_out(F.col("doc_id"))
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{folder}/labels.parquet")
    terms = F.array(*[F.lit(x) for kind in toxicity.IDENTITY_TERMS for x in kind])
    term = F.element_at(terms, (F.pmod(F.xxhash64("doc_id"), F.size(terms)) + 1).cast("int"))
    share = F.when(F.col("toxic") > 0, 80).otherwise(10)
    taught = docs.where(~held).join(labels, "doc_id").select("doc_id", F.when(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(100)) < share, F.concat(term, F.lit(" "), "text")).otherwise(F.col("text")).alias("text"))
    return docs.where(held), labels, taught, term


def shifts(model, apart, labels, term):
    """Mean change of the log odds of held-out texts by a neutral mention, and accuracy on them."""
    odds = lambda d: {r["doc_id"]: np.log(r["score"] / (1 - r["score"])) for r in rows(toxicity.score_texts(d, model))}
    a, b = odds(apart), odds(apart.select("doc_id", F.concat(term, F.lit(" "), "text").alias("text")))
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    return np.mean([abs(a[i] - b[i]) for i in a]), np.mean([(a[i] >= 0) == truth[i] for i in a if i in truth])


def test_toxicity_penalty_on_a_planted_correlation(spark):
    """Terms that go along with the label in training texts: the penalty beats both a fit without it and the rows filled with terms."""
    apart, labels, taught, term = planted(spark, "/root/testdata/sf0.01")
    (moved, right), (loose, loose_right), (filled, _) = (
        shifts(toxicity.train(taught, labels, **kw), apart, labels, term) for kw in ({}, {"counterfactual": 0.0}, {"counterfactual": 0.0, "fill_own": True})
    )
    assert moved < 0.5 * min(loose, filled) and right >= loose_right - 0.01
    # the corpus as it is mentions no term: what moves is what words share with terms, and less than in filled rows
    plain = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where(~language.held_out(F.col("doc_id")))
    kept, filled = (shifts(toxicity.train(plain, labels, fill_own=f), apart, labels, term)[0] for f in (False, True))
    assert kept < filled and kept < 0.1


def test_toxicity_features_can_be_kept(spark):
    docs, labels = toxic_data(spark)
    few, every = toxicity.train(docs, labels), toxicity.train(docs, labels, most_features=None, least_z=None)
    assert len(every.buckets) > len(few.buckets) and set(few.buckets) < set(every.buckets)


def test_toxicity_odd_rows(spark):
    docs, labels = toxic_data(spark)
    long = spark.createDataFrame([(1, "w1 idiot " * 300_000), (1, "w1 idiot " * 300_000), (None, "idiot"), (2, None)], "doc_id bigint, text string")
    model = toxicity.train(docs.unionByName(long), labels)
    out = rows(toxicity.score_texts(long.withColumn("held_out", F.lit(True)), model, keep=("held_out",)))
    assert [r["held_out"] for r in out] == [True] * 4 and len({r["score"] for r in out if r["doc_id"] == 1}) == 1
    assert spark.range(1).select(language.held_out(F.lit(None).cast("bigint"))).first()[0] is True


def test_toxicity_without_labels(spark):
    docs, labels = toxic_data(spark)
    empty = toxicity.train(docs, labels.limit(0))
    assert {r["score"] for r in rows(toxicity.score_texts(docs, empty))} == {0.5}
    one = toxicity.train(docs, labels.where("toxic = 1"))
    assert all(r["predicted"] == 1 for r in rows(toxicity.score_texts(docs, one)))
    assert toxicity.score_texts(docs.limit(0), one).count() == 0
