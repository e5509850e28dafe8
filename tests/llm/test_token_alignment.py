"""Alignment of two tokenizers against the libraries and plain counting."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidewright.llm import byte_bpe, token_alignment
from tidewright.llm import textblocks as tb
from tidewright.llm.queries import vocabulary_path


@pytest.fixture(scope="module")
def files():
    return tuple(byte_bpe.read_file(vocabulary_path(n)) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=vocabulary_path("piece_bpe_32k.model"))


def plain(data, libraries):
    first, second = libraries
    letters = token_alignment.byte_letters()
    texts = []
    for _, text in data:
        a = b = []
        if text:
            a = [(k, bytes(letters[c] for c in t)) for k, t in ((k, first.id_to_token(k)) for k in first.encode(" " + text, add_special_tokens=False).ids)]
            b = [(k, bytes([int(second.id_to_piece(k)[3:5], 16)]) if second.is_byte(k) else second.id_to_piece(k).replace("▁", " ").encode()) for k in second.encode(text)]
            if any(b"".join(t for _, t in x) != (" " + text).encode() for x in (a, b)):
                a = b = []
        ends = [set(np.cumsum([len(t) for _, t in x]).tolist()) for x in (a, b)]
        groups, i, j, at_a, at_b = [], 0, 0, 0, 0
        for e in sorted(ends[0] & ends[1]):
            ga, gb = [], []
            while at_a < e:
                at_a += len(a[i][1])
                ga.append(a[i][0])
                i += 1
            while at_b < e:
                at_b += len(b[j][1])
                gb.append(b[j][0])
                j += 1
            groups.append((ga, gb))
        texts.append((len(a), len(b), groups))
    links = [[(x, y) for ga, gb in g for x in ga for y in gb] for *_, g in texts]
    count = Counter(p for x in links for p in set(x))
    most = {}
    for (x, _), n in count.items():
        most[x] = max(most.get(x, 0), n)
    out = []
    for (key, _), (n_a, n_b, groups), found in zip(data, texts, links, strict=True):
        string = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        sha = hashlib.sha256(string.encode()).hexdigest() if groups else ""
        out.append((key, n_a, n_b, len(groups), len(found), sum(count[p] == most[p[0]] for p in found), sum(count[p] for p in found), sha))
    return sorted(out, key=repr)


def found(df):
    assert df.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


ODD = ["", None, " ", "a", "  two  spaces ", "<|endoftext|> and </s> <s> <unk>", "a▁b", "▁", "naïve café 日本語のテキスト 한국어 😀👍🏽", "x\u0000y", "ﬁ ½ 　 é", "aaaa" * 200, "12345 678.90", "tab\tand\nline\r\n\n", "​﻿", "ÿþ"]


def corpus(seed=2):
    rng = random.Random(seed)
    words = ["the", "Quelle", "straße", "don't", "we'll", "1984", "naïve", "日本", "x=y+1", "...", "supercalifragilistic", "\n", "  "]
    texts = [*ODD, *(" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(80)), "the one", "the one"]
    return [(i, t) for i, t in enumerate(texts)] + [(None, "the one"), (3, "repeated"), (3, "repeated")]


def test_equal_plain(spark, files, libraries, monkeypatch):
    data = corpus()
    df = spark.createDataFrame([(*r, 0, "x", 1) for r in data], "doc_id bigint, text string, mark int, a string, split int").repartition(4)
    wanted = plain(data, libraries)
    assert found(token_alignment.align(df, *files)) == wanted
    # many shards, texts in several rows
    monkeypatch.setattr(token_alignment, "_HELD_KEYS", 50)
    counted = token_alignment.count_shards
    monkeypatch.setattr(token_alignment, "count_shards", lambda links, folder: counted(links, folder, shard_keys=40))
    written = token_alignment.pair_pieces
    monkeypatch.setattr(token_alignment, "pair_pieces", lambda x: written(x, 30))
    assert found(token_alignment.align(df, *files)) == wanted


def test_empty_table(spark, files):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert found(token_alignment.align(df, *files)) == []
    one = token_alignment.align(spark.createDataFrame([(1, "a b")], df.schema), *files, keep_groups=True).collect()
    assert hashlib.sha256(one[0].groups.encode()).hexdigest() == one[0].groups_sha256 and one[0].groups.count("|") == 2


def aligned(files, texts):
    both = token_alignment.Tokenizers.of(*files)
    (block,) = tb.blocks(pa.array(texts, pa.string()), 1 << 30)
    return token_alignment.align_block(both, block[2], block[3], texts)


@pytest.mark.parametrize("most,many", [(1 << 22, 64), (1 << 22, 1), (40, 64), (40, 2), (3, 1)])
def test_pieces(files, monkeypatch, most, many):
    monkeypatch.setattr(token_alignment, "_MANY", many)
    x = aligned(files, [t for _, t in corpus() if t is None or len(t) < 500])
    wanted = Counter()
    for g in range(len(x.n_a)):
        for a in x.a[x.group_a == g].tolist():
            for b in x.b[x.group_b == g].tolist():
                wanted[int(x.text[g]), a << 32 | b] += 1
    got = Counter()
    for t, u, _, of, pair, times in token_alignment.pair_pieces(x, most):
        assert len(of) == 0 or (t <= of.min() and of.max() < u)
        keys = list(zip(of.tolist(), pair.tolist(), strict=True))
        assert keys == sorted(set(keys)) and not set(keys) & set(got)
        got.update(dict(zip(keys, times.tolist(), strict=True)))
    assert got == wanted


def test_large_group(files):
    """One group of very many links is combined before pairs are made."""
    n = 4000
    x = token_alignment.Aligned(np.array([0]), np.arange(n) % 7, np.arange(n) % 5, np.zeros(n, np.int64), np.zeros(n, np.int64), np.array([n]), np.array([n]), np.array([0]))
    ((*_, pair, times),) = token_alignment.pair_pieces(x)
    assert len(pair) == 35 and times.sum() == n * n


def test_first_tokenizer_equals_library(files, libraries):
    """Every code point, between letters, numbers and spaces; long slices; random bytes of text."""
    voc = token_alignment.Tokenizers.of(*files).first
    points = [chr(c) for c in (*range(0xD800), *range(0xE000, 0x30000))]
    texts = ["".join(f"a{c}1{c} {c}\n" for c in points[i : i + 500]) for i in range(0, len(points), 500)]
    rng = random.Random(1)
    texts += ["ab" * 3000, "=" * 500, "日" * 300, "".join(rng.choice("aeintho 'sdlv\n1é中") for _ in range(20000))]
    for _, _, data, offs in tb.blocks(pa.array(texts)):
        ids, until = voc.encode(data, offs)
        for k in range(len(offs) - 1):
            text = data[offs[k] : offs[k + 1]].tobytes().decode()
            assert ids[until[k] : until[k + 1]].tolist() == libraries[0].encode(text, add_special_tokens=False).ids
