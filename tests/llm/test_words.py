import numpy as np
from conftest import shingle_set, words
from hypothesis import given, settings
from hypothesis import strategies as st

from inkveil.llm import words as module
from inkveil.llm.words import shingle_sets, words_of

TEXT = st.text(st.sampled_from("aAbÉé \t\n\x0b\x1c\x00.中"), max_size=60)


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=6))
def test_words_and_shingles_as_by_hand(texts):
    got = words_of([t.encode() for t in texts])
    want = [words(t) for t in texts]
    assert got.counts().tolist() == [len(w) for w in want]
    flat = [x for w in want for x in w]
    # Hashes are equal exactly where words are.
    assert len(set(got.hash.tolist())) == len(set(flat))
    assert len(set(zip(flat, got.hash.tolist(), strict=True))) == len(set(flat))
    doc, h = shingle_sets(got)
    sets = [shingle_set(t) for t in texts]
    assert np.bincount(doc, minlength=len(texts)).tolist() == [len(s) for s in sets]
    by_doc = [set(h[doc == k].tolist()) for k in range(len(texts))]
    for a in range(len(texts)):
        for b in range(len(texts)):
            assert len(by_doc[a] & by_doc[b]) == len(sets[a] & sets[b])


def test_blocks_do_not_matter(monkeypatch):
    texts = [b"one two three four five six", b"", b"x" * 3000, b" a  b\n", b"one two three four five six"]
    whole = words_of(texts)
    monkeypatch.setattr(module, "BLOCK", 16)
    monkeypatch.setattr(module, "_powers", {})
    small = words_of(texts)
    assert whole.doc.tolist() == small.doc.tolist()
    assert whole.hash.tolist() == small.hash.tolist()
