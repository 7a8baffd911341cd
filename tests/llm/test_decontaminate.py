import random

import pytest
from conftest import shingle_set, words

from inkveil.llm import decontaminate as module
from inkveil.llm.decontaminate import contamination, sketch_size


@pytest.mark.parametrize("block", [2_000_000, 30])
def test_as_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(module, "BLOCK_SHINGLES", block)
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(50)]
    items = {i: " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 4, 5, 9, 20, 40]))) for i in range(25)}
    items |= {25: None, 26: "", 27: items[3], 28: items[20].upper()}
    docs = {}
    for d in range(40):
        text = rng.choices(vocabulary, k=rng.choice([2, 30, 300]))
        for _ in range(2):
            part = words(items[rng.randrange(25)])
            cut = rng.choice([0, 0, 1, 2, len(part) // 3])
            text += part[cut:] + rng.choices(vocabulary, k=3)
        docs[d] = " ".join(text)
    docs |= {40: None, 41: "", 42: items[3]}
    want = set()
    for i, t in items.items():
        w = words(t)
        own = shingle_set(t)
        for d, text in docs.items():
            v = words(text)
            width = min(5, len(w))
            inside = {tuple(v[k : k + width]) for k in range(len(v) - width + 1)} if width else set()
            n = len(own & inside)
            if own and 100 * n >= 75 * len(own):
                want.add((d, i, len(own), n))
    assert len(want) > 30
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    item_df = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = [tuple(r)[:4] for r in contamination(df, item_df).collect()]
    assert len(got) == len(set(got))
    assert set(got) == want


def test_sketch_is_enough():
    for n in range(1, 400):
        missing = n - -(-75 * n // 100)  # what a document at the limit may lack
        assert sketch_size(n, 75) > missing or sketch_size(n, 75) == n
