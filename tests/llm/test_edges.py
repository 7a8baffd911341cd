"""Nulls in any column, empty and very long texts, repeated rows, empty tables, clashing column names."""

import pytest
from pyspark.sql import functions as F

from inkveil.llm.decontaminate import contamination
from inkveil.llm.embedding_dedup import embedding_components
from inkveil.llm.license_scan import license_scan
from inkveil.llm.lm_scoring import lm_scores
from inkveil.llm.ngram_join import ngram_components
from inkveil.llm.packing import pack
from inkveil.llm.pii import mask_pii, pii_spans
from inkveil.llm.quality import keep_good, quality_scores
from inkveil.llm.token_counts import token_counts
from inkveil.llm.url_filter import filter_urls

LONG = "lorem ipsum dolor sit amet " * 40_000
DOCS = [(1, "one two three four five six"), (1, "one two three four five six"), (2, None), (3, ""), (None, "one two three four five six"),
        (None, None), (4, LONG), (5, "x" * 20_000), (6, "One two THREE four five six"), (7, "tie tie tie")]
CLASH = "score label bucket set n key node root block part text2 component_id words items docs batch host path rule".split()


def labels(spark):
    rows = [(1, 1, 0), (1, 1, 0), (3, 0, None), (None, 1, 1), (4, None, 0), (6, 1, 0), (7, 0, 0), (99, 7, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def items(spark):
    return spark.createDataFrame(
        [(1, "one two three four five six"), (1, "one two three four five six"), (2, None), (None, "tie tie tie"), (3, "")],
        "item_id long, text string",
    )


OPERATORS = {
    "token_counts": lambda s, d: token_counts(d),
    "pii": lambda s, d: pii_spans(d),
    "mask": lambda s, d: mask_pii(d),
    "license": lambda s, d: license_scan(d),
    "lm": lambda s, d: lm_scores(d),
    "quality": lambda s, d: quality_scores(d, labels(s)),
    "keep": lambda s, d: keep_good(d, labels(s), threshold=0.0),
    "ngram": lambda s, d: ngram_components(d),
    "contamination": lambda s, d: contamination(d, items(s)),
    "pack": lambda s, d: pack(d),
}
PER_ROW = set(OPERATORS) - {"contamination", "pack"}


def docs(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for k, c in enumerate(CLASH):
        df = df.withColumn(c, F.lit(k) if k % 2 else F.lit(None).cast("string"))
    return df


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    out = OPERATORS[name](spark, docs(spark, DOCS)).collect()
    if name in PER_ROW:
        assert sorted(repr(r.doc_id) for r in out) == sorted(repr(i) for i, _ in DOCS)
    if name == "ngram":
        assert {(r.doc_id, r.component_id) for r in out} == {(1, 1), (2, 2), (3, 3), (None, None), (4, 4), (5, 5), (6, 1), (7, 7)}
    if name == "contamination":
        got = sorted((repr(r.doc_id), repr(r.item_id)) for r in out)
        assert got == sorted([("1", "1")] * 4 + [("None", "1")] * 2 + [("6", "1")] * 2 + [("7", "None")])
    if name == "pack":
        assert len({r.sequence_id for r in out}) > 100
        assert {r.doc_id for r in out} == {1, 2, 3, 4, 5, 6, 7, None}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, docs(spark, [])).collect() == []


@pytest.mark.parametrize("name", OPERATORS)
def test_null_texts_only(spark, name):
    out = OPERATORS[name](spark, docs(spark, [(None, None), (1, None)])).collect()
    assert len(out) == (0 if name == "contamination" else 2)


def test_other_tables(spark):
    vectors = spark.createDataFrame(
        [(1, [1.0, 0.0], 1, 5), (1, [1.0, 0.0], 1, 6), (None, [1.0, 0.0], 1, 7), (2, None, None, 8)],
        "vec_id long, embedding array<float>, label int, node int",
    )
    got = sorted(map(repr, ((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_components(vectors).collect())))
    assert got == sorted(map(repr, [(1, 1, 1, True), (1, 1, 1, True), (None, 0, None, False), (2, 0, 2, True)]))
    assert embedding_components(vectors.limit(0)).collect() == []
    pages = spark.createDataFrame([(1, None, 3), (1, None, 3), (None, "http://a.com/", None)], "page_id long, url string, host int")
    got = sorted(map(repr, ((r.page_id, r.host, r.rule, r.verdict) for r in filter_urls(pages).collect())))
    assert got == sorted(map(repr, [(1, "", None, "allow")] * 2 + [(None, "a.com", "com/", "allow")]))
    assert filter_urls(pages.limit(0)).collect() == []


def test_no_items_and_no_labels(spark):
    d = docs(spark, DOCS)
    assert contamination(d, items(spark).limit(0)).collect() == []
    assert {r.score for r in quality_scores(d, labels(spark).limit(0)).collect()} == {0.5}
