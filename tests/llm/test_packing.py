import random
import zlib
from collections import defaultdict

import public_tokenizers
from tokenizers import Tokenizer

from inkveil.llm.packing import differencing, pack, pieces, windows


def test_differencing_levels_groups():
    rng = random.Random(1)
    sizes = [rng.randint(1, 900) for _ in range(300)]
    groups = differencing(sizes, 20)
    assert sorted(i for g in groups for i in g) == list(range(300))
    totals = [sum(sizes[i] for i in g) for g in groups]
    assert max(totals) - min(totals) <= 20


def test_differencing_known_example():
    # Two-way: 8 7 6 5 4 leaves a difference of 2 by this method.
    totals = sorted(sum([8, 7, 6, 5, 4][i] for i in g) for g in differencing([8, 7, 6, 5, 4], 2))
    assert totals == [14, 16]


def test_windows_rise_when_one_exceeds():
    assert len(windows([6, 6, 6], 10)) == 3  # 18 ids need two windows, but none holds two pieces
    assert windows([], 10) == []


def test_pieces_add_up():
    for rest in range(1, 300):
        for fine in (False, True):
            assert sum(pieces(rest, 64, fine)) == rest
            assert all(0 < p <= 64 for p in pieces(rest, 64, fine))


def check(rows, texts, capacity=2048):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.length * 4 == len(r.ids)
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for doc, own in by_doc.items():
        own.sort(key=lambda r: r.start)
        ids = library.encode(texts[doc] or "", add_special_tokens=False).ids + [1]
        data = b"".join(i.to_bytes(4, "little") for i in ids)
        assert b"".join(r.ids for r in own) == data
        assert zlib.crc32(b"".join(r.ids for r in own)) == zlib.crc32(data)
        assert {r.doc_tokens for r in own} == {len(ids)}
        assert [r.start for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
        assert sum(r.length for r in own) <= capacity
    used = sum(r.length for r in rows)
    return 1 - used / (capacity * len(by_sequence))


def test_round_trip(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert check(pack(docs.coalesce(1)).collect(), texts) < 0.02


def test_small_capacity(spark):
    texts = {1: "a b c d e f g", 2: None, 3: "", 4: "word " * 50}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    check(pack(docs, capacity=16).collect(), texts, 16)
