import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from inkveil.llm import pieces
from inkveil.llm.bpe import merger
from inkveil.llm.pieces import Encoder
from inkveil.llm.token_counts import token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["the", " of", " ", "  ", "\n", "\t", "é", "中文", "'s", "12", "<|endoftext|>", "<|end", "aaaa", ".", "\x00", "\xa0", "Ab"]
LIBRARY = Tokenizer.from_file(PATH)


@pytest.fixture
def library():
    return LIBRARY


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=12).map("".join))
def test_ids_as_the_library(text):
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(Encoder(PATH)([text])[0], "<u4").tolist() == want
    assert Encoder(PATH, count_only=True)([text])[0] == len(want)


def test_long_word(library):
    text = "ab" * 3000 + "xyzzy" * 500
    ids, counts = merger(PATH).encode([text.encode()])
    assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
    assert counts.tolist() == [len(ids)]


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 3)
    monkeypatch.setattr(pieces, "REMEMBERED_TOKENS", 2)
    encode = Encoder(PATH)
    for k in range(5):
        texts = [f"word{k} and another one{k}\nline two.", f"x{k}  y"]
        got = [np.frombuffer(b, "<u4").tolist() for b in encode(texts)]
        assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_counts_on_documents(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in token_counts(docs).collect():
        n = len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(texts[r.doc_id].encode()), n > 1024)
