"""Alignment of two tokenizers against the libraries and a plain walk over all pairs of tokens."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from inkveil.llm import alignment
from inkveil.llm.alignment import align_tokenizers, pair_counts, token_groups
from inkveil.llm.bpe import byte_characters


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    return a, b


def tokens(libraries, text):
    """``(A, B)`` as lists of ``(id, bytes)``, or two empty lists."""
    if not text:
        return [], []
    a, b = libraries
    byte_of = {c: k for k, c in enumerate(byte_characters())}
    out_a = [(i, bytes(byte_of[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    out_b = []
    for i in b.encode(text):
        p = b.id_to_piece(i)
        out_b.append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
    whole = (" " + text).encode()
    if b"".join(t for _, t in out_a) != whole or b"".join(t for _, t in out_b) != whole:
        return [], []
    return out_a, out_b


def spans(some):
    at, out = 0, []
    for i, t in some:
        out.append((i, at, at + len(t)))
        at += len(t)
    return out


def brute(libraries, rows):
    made = []
    for doc, text in rows:
        a, b = map(spans, tokens(libraries, text))
        links, j = [], 0
        for i, s, e in a:
            while j and b[j - 1][2] > s:
                j -= 1
            while j < len(b) and b[j][1] < e:
                if b[j][2] > s:
                    links.append((i, b[j][0]))
                j += 1
        ends = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups, s = [], 0
        for e in ends:
            groups.append("|".join(",".join(str(i) for i, x, y in side if s <= x and y <= e) for side in (a, b)) if len(a) < 2000 else None)
            s = e
        made.append((doc, len(a), len(b), len(ends), links, ";".join(groups) if None not in groups else None))
    count = Counter(p for *_, links, _ in made for p in set(links))
    best = {}
    for (a, _), n in count.items():
        best[a] = max(best.get(a, 0), n)
    return [
        (doc, n_a, n_b, n_groups, len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links),
         hashlib.sha256(groups.encode()).hexdigest() if groups else "" if groups == "" else None)
        for doc, n_a, n_b, n_groups, links, groups in made
    ], count


def check(spark, libraries, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("batch", "keys", "n_a", "pair"):
        df = df.withColumn(c, F.lit("x"))
    got = sorted(map(tuple, align_tokenizers(df.repartition(5)).collect()), key=repr)
    want, _ = brute(libraries, rows)
    # Groups of long texts are not written out plainly.
    want = sorted(want, key=repr)
    assert [g[:7] for g in got] == [w[:7] for w in want]
    assert all(g[7] == w[7] for g, w in zip(got, want, strict=True) if w[7] is not None)


ODD = [
    "", None, " ", "\n", "\n\n", "a", " a", "a ", "a\nb", "\na", "a\n", "a  b", "a \n b", "a\n\nb", "\t x\ty ", "x\r\ny",
    "<|endoftext|>", "a <|endoftext|> b <s> </s> <unk> <0x41>", "▁", "a ▁b", "x▁ y z", "naïve café     q",
    "日本語のテキスト と 漢字", "😀😀 👩‍👩‍👧 x", "aaaa aaa aa a", "it's we'll 'tis don't", "\x00", "a \x00b\x00 c", "\x00\n\x00",
    "a​b", "　x", "1234567 12,345.67 +1 (555) 123-4567", "ﬁ ² ½ é é", "\x1c\x1d a\x85b c", "﻿x",
]


def test_odd_texts(spark, libraries):
    check(spark, libraries, [(i, t) for i, t in enumerate(ODD)] + [(None, "a b c"), (None, "a b c"), (3, "a b c")])


@pytest.mark.parametrize("seed", range(2))
def test_random_texts(spark, libraries, seed):
    rng = random.Random(seed)
    parts = ["the ", "quick", "Brown", " ", "  ", "\n", "\t", "é", "ß", "ing", "_", "7", "▁", " ", "'s", "日", "😀", "-", "aa", "\r"]
    weights = [9, 5, 5, 20, 2, 3, 1, 2, 2, 3, 1, 3, 0.05, 0.3, 1, 1, 1, 2, 3, 0.2]
    check(spark, libraries, [(i, "".join(rng.choices(parts, weights, k=rng.randint(1, 60)))) for i in range(600)])


def test_documents(spark, sf_dir, libraries):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    want, count = brute(libraries, rows)
    got = sorted(map(tuple, align_tokenizers(docs).collect()))
    assert [g[:7] for g in got] == [w[:7] for w in sorted(want)]
    assert {(r.a, r.b): r.n_docs for r in pair_counts(docs).collect()} == count


def test_groups_and_long_texts(spark, libraries, sf_dir):
    long = "x" * 30_000 + " " + "lorem ipsum  dolor\n" * 5_000
    df = spark.createDataFrame([(1, "hello world again"), (2, None), (3, long)], "doc_id long, text string")
    groups = dict(map(tuple, token_groups(df).collect()))
    assert groups[2] == ""
    for doc, text in ((1, "hello world again"), (3, long)):
        a, b = tokens(libraries, text)
        parts = [p.split("|") for p in groups[doc].split(";")]
        assert [int(x) for p, _ in parts for x in p.split(",")] == [i for i, _ in a]
        assert [int(x) for _, p in parts for x in p.split(",")] == [i for i, _ in b]
    assert align_tokenizers(df.limit(0)).collect() == []


def test_words_are_forgotten(libraries, monkeypatch):
    monkeypatch.setattr(alignment, "REMEMBERED", 10)
    known = alignment.Words(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    for some in (["some words of one text", "and more"], ["others", "a b c d e f g h i j k l m n"], ["others", "some words"]):
        w, n = alignment._texts(known, [t.encode() for t in some])
        for text, groups in zip(some, alignment._written(known, w, n), strict=True):
            assert groups.decode().replace(";", "|").split("|")[0].split(",")[0] == str(tokens(libraries, text)[0][0][0])
    assert len(known.of) <= 20


def test_same_bytes_array(libraries):
    known = alignment.known_words(alignment.VOCABULARY, alignment.OTHER_VOCABULARY)
    for a in range(0, len(known.same), 97):
        b = int(known.same[a])
        assert b < 0 or known.bytes_a[a] == known.bytes_b[b]
    assert (known.same >= 0).sum() > 10_000
