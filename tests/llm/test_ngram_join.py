import random
from itertools import combinations

import numpy as np
import pytest
from conftest import Groups, shingle_set

from inkveil.llm import ngram_join as module
from inkveil.llm.ngram_join import elements, ngram_components, search


def brute(texts, percent=75):
    sets = {i: shingle_set(t) for i, t in texts.items()}
    groups = Groups(sets)
    for a, b in combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            groups.join(a, b)
    return {i: (len(s), groups.find(i)) for i, s in sets.items()}


def made(seed):
    """Families of edited copies around the limit, a passage that many share, exact copies, short texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = " ".join(rng.choices(vocabulary, k=55))
    texts, i = {}, 0
    for _ in range(14):
        base = rng.choices(vocabulary, k=rng.choice([5, 8, 30, 64, 90, 200]))
        for _ in range(rng.choice([1, 2, 5, 12])):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 18))):
                at = rng.randrange(len(copy))
                copy[at : at + rng.randint(0, 2)] = rng.choices(vocabulary, k=rng.randint(0, 2))
            texts[i] = " ".join(copy)
            if rng.random() < 0.4:
                texts[i] += " " + passage
            i += 1
    for t in (None, "", "  \n", "a b", "A  B", "a b c", "a b c d e", "a b c d E", passage, passage):
        texts[i] = t
        i += 1
    keys = list(texts)
    rng.shuffle(keys)
    return {k: texts[k] for k in keys}


@pytest.mark.parametrize(("seed", "part"), [(1, 4096), (2, 4096), (3, 2)])
def test_as_brute_force(spark, monkeypatch, seed, part):
    monkeypatch.setattr(module, "PART_SETS", part)
    texts = made(seed)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_components(docs).collect()}
    assert got == brute(texts)


def test_full_filter_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(module, "FILTER_BITS", 64)
    texts = made(4)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_components(docs).collect()}
    assert got == brute(texts)


@pytest.mark.parametrize("seed", range(8))
def test_similar_sets_share_what_is_kept(seed):
    """Pairs exactly at the limit keep an element in common, in any order of elements."""
    rng = np.random.default_rng(seed)
    for n in (1, 2, 3, 7, 8, 21, 64, 100, 127, 128, 500):
        m = int(rng.integers(n, 4 * n // 3 + 1))
        both = -(-3 * (n + m) // 7)
        if both > n:
            continue
        pool = rng.integers(1, 2**48, n + m - both, dtype=np.uint64)
        a, b = np.sort(pool[:n]), np.sort(pool[n - both :])
        doc = np.repeat([0, 1], [n, m])
        em, key, of, _, spare = elements(doc, np.concatenate((a, b)), np.array([n, m]), 75)
        kept = [set(), set()]
        for e in range(len(of)):
            own = np.sort(key[em == e])
            kept[of[e]] |= set(own[: len(own) - spare[e]].tolist())
        assert kept[0] & kept[1]


def test_search_is_exact():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**40, 60)
    sets = [np.unique(np.where(rng.random(60) < 0.1, rng.integers(0, 2**40, 60), base)).astype("<u8") for _ in range(50)]
    groups = Groups(range(50))
    for a, b in combinations(range(50), 2):
        both = len(np.intersect1d(sets[a], sets[b]))
        if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            groups.join(a, b)
    root = search(sets, 75)
    same = {(a, b) for a, b in combinations(range(50), 2) if root[a] == root[b]}
    assert same == {(a, b) for a, b in combinations(range(50), 2) if groups.find(a) == groups.find(b)}
