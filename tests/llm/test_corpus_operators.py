"""Operators across texts, and the pipeline, against plain versions."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from tidewright.llm import byte_bpe, chunk_dedup, decontamination, near_dedup, quality, runtime, suffix_dedup
from tidewright.llm import textblocks as tb
from tidewright.llm.queries import vocabulary_path

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def collect(df, key="doc_id"):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: (r[key] is None, r[key] or 0))


def words(rng, n, vocabulary=400):
    return [f"w{rng.randint(0, vocabulary)}{rng.choice('abc')}" for _ in range(n)]


def corpus(seed=1):
    """Clean texts, exact and near copies, shared passages, odd texts."""
    rng = random.Random(seed)
    texts = [" ".join(words(rng, rng.randint(60, 160))) for _ in range(25)]
    base = words(rng, 150)
    for _ in range(12):
        copy = list(base)
        for _ in range(rng.randint(0, 6)):
            copy[rng.randrange(150)] = "changed"
        texts.append(" ".join(copy))
    texts += [texts[0], texts[0], texts[3]]
    passage = " ".join(words(rng, 70))
    texts += [f"{' '.join(words(rng, 60))} {passage} {' '.join(words(rng, 50))}" for _ in range(4)]
    texts += ["", None, "   ", "one", "one", "ONE two three", "one two three", "tail " * 400, "é" * 300, "é" * 300 + "!"]
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(i, texts[k], "en", "s", len(texts[k] or "")) for i, k in enumerate(order)], passage


@pytest.fixture(scope="module")
def docs(spark):
    data, _ = corpus()
    return spark.createDataFrame(data, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def odd(spark):
    """Null keys, repeated rows, extra columns."""
    text = " ".join(f"q{i}" for i in range(120))
    return spark.createDataFrame([(7, text, 1), (7, text, 1), (None, text, 2), (None, None, 3), (8, text + " end", 4), (9, None, 5)], "doc_id bigint, text string, seed int")


# ---------------------------------------------------------------- near-duplicates
def shingles(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(found[i : i + 5]) for i in range(len(found) - 4)} if len(found) >= 5 else ({tuple(found)} if found else set())


def plain_components(data, percent=85):
    sets = {i: shingles(t) for i, t, *_ in data}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates_equal_plain(docs):
    for percent in (85, near_dedup.PERCENT):
        wanted = plain_components([tuple(r) for r in docs.collect()], percent)
        out = collect(near_dedup.near_duplicates(docs, percent=percent))
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == wanted
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)


def test_near_duplicates_in_blocks(spark):
    rng = random.Random(4)
    base, data = words(rng, 100), []
    for i in range(60):
        copy = list(base)
        for _ in range(rng.randint(0, 5)):
            copy[rng.randrange(100)] = f"x{rng.randint(0, 9)}"
        data.append((i, " ".join(copy)))
    frame = spark.createDataFrame(data, "doc_id bigint, text string")
    groups = spark.createDataFrame([(i, 0) for i in range(60)], "node bigint, component bigint")
    links = near_dedup.confirmed_links(frame, groups, "doc_id", "text", percent=85, block=7)
    found = {r["node"]: r["component"] for r in runtime.components(links).collect()}
    assert {i: found.get(i, i) for i in range(60)} == {i: c for i, (_, c) in plain_components(data).items()}


def test_near_duplicates_odd_rows(spark, odd, docs):
    out = collect(near_dedup.near_duplicates(odd))
    assert [(r["doc_id"], r["component_id"], r["kept"]) for r in out] == [(7, 7, True), (7, 7, True), (8, 7, False), (9, 9, True), (None, None, True), (None, None, True)]
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(60)] + [(200, k) for k in range(201, 260)] + [(i, i + 1) for i in range(300, 340)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    out = runtime.components(spark.createDataFrame(edges, "a bigint, b bigint"))
    assert {r["node"]: r["component"] for r in out.collect()} == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert runtime.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# ---------------------------------------------------------------- chunks
def plain_chunks(raw):
    """Chunk ends by looking at each place alone."""
    gear = chunk_dedup.GEAR.tolist()
    h = [0] * len(raw)
    for i in range(chunk_dedup.WINDOW - 1, len(raw)):
        h[i] = 1 + sum(gear[raw[i - k]] << k for k in range(chunk_dedup.WINDOW)) % (1 << chunk_dedup.WINDOW)
    ends = set()
    r = chunk_dedup.RADIUS
    for i, x in enumerate(h):
        if x and all(x > y for y in h[max(0, i - r) : i]) and all(x >= y for y in h[i + 1 : i + r + 1]):
            e = i + 1
            while e < len(raw) and raw[e] & 0xC0 == 0x80:
                e += 1
            ends.add(e)
    return sorted(ends | {len(raw)}) if raw else []


def plain_chunk_dedup(data, least_run=chunk_dedup.LEAST_RUN):
    cuts, first = {}, {}
    for i, t, *_ in data:
        raw, at, own = (t or "").encode(), 0, []
        for e in plain_chunks(raw):
            own.append(raw[at:e])
            first[raw[at:e]] = min(first.get(raw[at:e], i), i)
            at = e
        cuts[i] = own
    out = {}
    for i, own in cuts.items():
        dup, kept, run = [first[c] < i for c in own], b"", []
        for c, d in [*zip(own, dup, strict=True), (b"", False)]:
            if d:
                run.append(c)
                continue
            joined = b"".join(run)
            kept += joined if len(joined) < least_run else b""
            run = []
            kept += c
        out[i] = kept
    return out


def test_chunks_equal_plain(docs):
    data = [tuple(r) for r in docs.collect()]
    wanted = plain_chunk_dedup(data)
    for r in collect(chunk_dedup.dedup_substrings(docs, with_text=True)):
        assert (r["kept_text"] or "").encode() == wanted[r["doc_id"]]
        assert r["kept_sha256"] == hashlib.sha256(wanted[r["doc_id"]]).hexdigest() and r["n_removed"] == r["n_bytes"] - len(wanted[r["doc_id"]])


def test_chunks_without_a_least_run_and_in_hot_groups(spark, docs):
    data = [tuple(r) for r in docs.collect()]
    wanted = plain_chunk_dedup(data, 0)
    for r in collect(chunk_dedup.dedup_substrings(docs, with_text=True, least_run=0)):
        assert (r["kept_text"] or "").encode() == wanted[r["doc_id"]]
    rng = random.Random(13)
    line = " ".join(words(rng, 30, 5000))
    hot = [(i, f"{' '.join(words(rng, 12, 5000))} {line} {' '.join(words(rng, 8, 5000))}", "en", "s", 1) for i in range(300)]
    wanted = plain_chunk_dedup(hot)
    out = collect(chunk_dedup.dedup_substrings(spark.createDataFrame(hot, SCHEMA).repartition(3)))
    assert {r["doc_id"]: r["kept_sha256"] for r in out} == {i: hashlib.sha256(t).hexdigest() for i, t in wanted.items()}


def test_chunks_catch_passages_and_leave_the_rest():
    rng = random.Random(11)
    passage = " ".join(words(rng, 60, 5000))
    first, second = (" ".join(words(rng, 80, 5000)) for _ in range(2))
    kept = plain_chunk_dedup([(1, f"{first} {passage} tail"), (2, f"{second} {passage} end"), (3, first.upper())])
    assert len(kept[2]) < len(second) + 0.45 * len(passage) and kept[1].decode().endswith("tail") and kept[3] == first.upper().encode()


def test_chunks_odd_rows(odd, docs):
    out = collect(chunk_dedup.dedup_substrings(odd, with_text=True))
    by = [(r["doc_id"], r["n_removed"] > 0) for r in out]
    assert by == [(7, False), (7, False), (8, True), (9, False), (None, False), (None, False)]
    assert out[3]["kept_text"] is None
    assert chunk_dedup.dedup_substrings(docs.limit(0)).count() == 0


# ---------------------------------------------------------------- suffixes
def plain_suffixes(data, size=suffix_dedup.THRESHOLD):
    first, out = {}, {}
    texts = sorted((i, (t or "").encode()) for i, t, *_ in data)
    for i, raw in texts:
        for p in range(len(raw) - size + 1):
            first.setdefault(raw[p : p + size], i)
    for i, raw in texts:
        gone = np.zeros(len(raw), dtype=bool)
        for p in range(len(raw) - size + 1):
            if first[raw[p : p + size]] < i:
                gone[p : p + size] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out[i] = (len(raw), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(raw, np.uint8)[~gone])).hexdigest())
    return out


def test_suffixes_equal_plain(docs):
    wanted = plain_suffixes([tuple(r) for r in docs.collect()])
    out = collect(suffix_dedup.dedup_suffixes(docs))
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out} == wanted


def test_suffixes_around_frequent_lines(spark):
    """More stretches of one anchor than are sent as bytes, in one chunk and in several."""
    rng = random.Random(8)
    line = "this very line of text stands in every one of the documents of the table"
    data = [(3 * i, f"{rng.randint(0, 10**12):x} {rng.randint(0, 10**9):x} {line[: 40 + i % 33]} {rng.randint(0, 10**12):x}") for i in range(700)] + [(3 * i + 1, f"{i} {line} {i}") for i in range(5)]
    for partitions in (1, 5):
        frame = spark.createDataFrame(data, "doc_id bigint, text string").repartition(partitions)
        out = collect(suffix_dedup.dedup_suffixes(frame))
        assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out} == plain_suffixes(data)


def test_suffixes_of_edited_and_periodic_texts(spark):
    rng = random.Random(6)
    base = "".join(rng.choice("ab ") for _ in range(700))
    data = [(100, base)]
    for i in range(30):
        text = list(base)
        for _ in range(rng.randint(0, 9)):
            text[rng.randrange(len(text))] = rng.choice("abc é")
        at = rng.randrange(600)
        data.append((rng.randint(0, 10_000) * 40 + i, "".join(text)[at : at + rng.randint(30, 400)]))
    data += [(1, "xy" * 40), (2, "yx" * 60), (3, "z" * 49), (4, "z" * 50), (5, "z" * 51)]
    frame = spark.createDataFrame(data, "doc_id bigint, text string").repartition(4)
    out = collect(suffix_dedup.dedup_suffixes(frame, with_bytes=True))
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out} == plain_suffixes(data)


def test_anchors_across_segments(monkeypatch):
    rng = random.Random(8)
    raw = "".join(rng.choice("abcd") for _ in range(5000)).encode()
    data, offs = np.frombuffer(raw, np.uint8), np.array([0, 2000, 2000, 2030, 5000])
    whole = suffix_dedup.anchors(data, offs)
    monkeypatch.setattr(suffix_dedup, "_SEGMENT", 700)
    parts = suffix_dedup.anchors(data, offs)
    spread = lambda a: {p: (int(x), int(s)) for lo, hi, x, s in zip(*a, strict=True) for p in range(lo, hi + 1)}
    assert spread(whole) == spread(parts)
    assert set(spread(whole)) == {p for a, b in zip(offs[:-1], offs[1:], strict=True) for p in range(a, b - 49)}


def test_suffixes_odd_rows(odd, docs):
    out = collect(suffix_dedup.dedup_suffixes(odd))
    assert [(r["doc_id"], r["n_removed"] > 0) for r in out] == [(7, False), (7, False), (8, True), (9, False), (None, False), (None, False)]
    assert suffix_dedup.dedup_suffixes(docs.limit(0)).count() == 0


# ---------------------------------------------------------------- decontamination
def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_contamination(data, items, size=10):
    windows = {}
    for item, text in items:
        found = plain_words(text)
        if found:
            k = min(size, len(found))
            for i in range(len(found) - k + 1):
                windows.setdefault(tuple(found[i : i + k]), set()).add(None if item is None else str(item))
    out = {}
    for i, t, *_ in data:
        found, hit, ids = plain_words(t), set(), set()
        for k in {len(x) for x in windows}:
            for p in range(len(found) - k + 1):
                if (w := tuple(found[p : p + k])) in windows:
                    hit |= set(range(p, p + k))
                    ids |= windows[w]
        out[i] = (len(found), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids - {None})).encode()).hexdigest(), bool(hit))
    return out


def test_contamination_equals_plain(spark):
    rng = random.Random(12)
    items = [(i, " ".join(words(rng, n, 8))) for i, n in enumerate([3, 1, 5, 9, 10, 14, 25, 25, 30, 12])] + [(20, None), (21, "..."), (None, "lost item"), (5, "again"), (10, "Ünder the SEA")]
    data = []
    for i in range(60):
        text = words(rng, rng.randint(0, 40), 8)
        if i % 3 == 0:
            found = plain_words(rng.choice(items)[1])
            text[5:5] = found[rng.randint(0, 3) :]
        data.append((i, " ".join(text).replace("w1", "W1") + rng.choice(["", "!", " ünder, the sea"])))
    data += [(100, None), (101, ""), (102, "-- --")]
    frame, bench = spark.createDataFrame(data, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    out = collect(decontamination.contamination(frame, bench))
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in out}
    assert got == plain_contamination(data, items)
    assert not any(r["contaminated"] for r in decontamination.contamination(frame, bench.limit(0)).collect())
    assert decontamination.contamination(frame.limit(0), bench).count() == 0


def test_contamination_odd_rows(spark, odd):
    bench = spark.createDataFrame([(1, " ".join(f"q{i}" for i in range(20, 40)))], "item_id bigint, text string")
    out = collect(decontamination.contamination(odd, bench, keep=("seed", "text")))
    assert [(r["doc_id"], r["n_hit"], r["seed"]) for r in out[:4]] == [(7, 20, 1), (7, 20, 1), (8, 20, 4), (9, 0, 5)]
    assert sorted((r["seed"], r["n_hit"]) for r in out[4:]) == [(2, 20), (3, 0)]


def test_contamination_by_items_without_id_equals_sql(spark):
    import duckdb

    from tidewright.llm.queries import ORACLE_SQL

    passage = [f"n{i}" for i in range(14)]
    items = [(None, " ".join(passage)), (None, "two lost words"), (3, "known item text")]
    data = [(1, "a " + " ".join(passage[2:]) + " b"), (2, "the known item text and two lost words"), (3, "known item text"), (4, "nothing"), (5, " ".join(passage) + " two lost words")]
    frame, bench = spark.createDataFrame(data, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    out = sorted(tuple(r) for r in decontamination.contamination(frame, bench).collect())
    with duckdb.connect() as db:
        db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
        db.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
        db.executemany("INSERT INTO documents VALUES (?, ?)", data)
        db.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
        wanted = sorted(db.execute(ORACLE_SQL["op9_decontamination"]).fetchall())
    assert out == wanted and [(r[2], r[5]) for r in out] == [(12, True), (6, True), (3, True), (0, False), (17, True)]


def test_contamination_is_native(spark, docs):
    bench = spark.createDataFrame([(1, "a b c d e f g h i j k")], "item_id bigint, text string")
    plan = decontamination.contamination(docs, bench)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ---------------------------------------------------------------- against SQL
@pytest.mark.parametrize("name", ["op2_quality", "op8_suffix_dedup"])
def test_query_equals_sql(spark, tmp_path, name):
    import duckdb

    from tidewright.llm import queries

    data, _ = corpus(41)
    spark.createDataFrame([*data, (900, "é" * 60 + "\n" * 3, "en", "s", 1), (901, "a b c d e f g " * 40, "en", "s", 1)], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        found = db.execute(queries.ORACLE_SQL[name])
        columns = [c[0] for c in found.description]
        wanted = sorted(found.fetchall())
    assert sorted(tuple(r) for r in queries.QUERIES[name](spark, str(tmp_path)).select(*columns).collect()) == wanted


# ---------------------------------------------------------------- pipeline
def plain_pipeline(data, items):
    import base64

    import public_tokenizers
    import tiktoken

    kept = []
    for r in data:
        for _, _, raw, offs in tb.blocks(pa.array([r[1]], pa.string())):
            m = {k: int(v[0]) for k, v in quality.measure(raw, offs).items()}
            n = m["n_words"]
            if n >= 50 and 100 * m["n_repeat_words"] <= 50 * n and 100 * m["covered_words"] <= quality.MOST_COVERED_PERCENT * n and m["longest_repeat"] <= quality.MOST_LONGEST:
                kept.append(r)
    groups = plain_components(kept, corpus_pipeline.NEAR_PERCENT)
    kept = [r for r in kept if groups[r[0]][1] == r[0]]
    text = plain_chunk_dedup(kept)
    kept = [(r[0], text[r[0]].decode()) for r in kept if text[r[0]]]
    judged = plain_contamination(kept, items)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, byte_bpe.read_file(vocabulary_path()).splitlines())}
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = {}
    for i, t in kept:
        if not judged[i][4]:
            ids = reference.encode_ordinary(t)
            out[i] = (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    return out


def test_pipeline_equals_plain(spark, tmp_path):
    data, _ = corpus(21)
    items = [(1, " ".join((data[2][1] or "x").split()[5:25])), (2, " ".join(next(r[1] for r in data if r[1] and len(r[1]) > 500).split()[3:20]))]
    spark.createDataFrame(data, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert out == plain_pipeline(data, items) and len(out) > 10


def test_pipeline_stages_keep_columns(spark, tmp_path):
    data, _ = corpus(22)
    spark.createDataFrame([(1, "nothing here at all")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    frame = spark.createDataFrame([(*r, True, 1) for r in data] + [(None, None, None, None, None, None, None)], SCHEMA + ", kept boolean, n_words int")
    last = corpus_pipeline.STAGES[-1][1]
    digests = last(spark, frame, str(tmp_path))
    assert digests.count() == frame.count() and digests.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    nothing = hashlib.sha256(b"").hexdigest()
    assert {(r["n_tokens"], r["decoded_sha256"]) for r in digests.where("doc_id is null").collect()} == {(0, nothing)}
    assert last(spark, frame.limit(0), str(tmp_path)).count() == 0
    clash = frame.toDF(*["ids_sha256" if c == "source" else c for c in frame.columns])
    assert last(spark, clash, str(tmp_path)).columns == digests.columns
    for (name, stage), empty in [(s, e) for s in corpus_pipeline.STAGES[:-1] for e in (False, True)]:
        out = stage(spark, frame.limit(0) if empty else frame, str(tmp_path))
        assert out.schema.simpleString() == frame.schema.simpleString(), name
        assert (out.count() == 0) == empty


def test_pipeline_links_from_80_percent(spark, tmp_path):
    rng = random.Random(31)
    data = []
    for i, changed in enumerate([10, 10, 10, 12, 12]):  # of 100 shingles 90 are shared (0.818) or 88 (0.786)
        text = [f"p{i}x{rng.randint(0, 10**9)}" for _ in range(104)]
        data += [(2 * i, " ".join(text), "en", "s", 1), (2 * i + 1, " ".join(text[:-changed] + [f"q{i}x{k}" for k in range(changed)]), "en", "s", 1)]
    out = corpus_pipeline.near_dedup_stage(spark, spark.createDataFrame(data, SCHEMA), str(tmp_path))
    assert sorted(r["doc_id"] for r in out.collect()) == [0, 2, 4, 6, 7, 8, 9]
    assert near_dedup.keys_for(85) == 12 and near_dedup.keys_for(80) == 17
