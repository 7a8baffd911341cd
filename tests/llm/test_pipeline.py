import shutil

import public_tokenizers
import pytest
from conftest import shingle_set
from test_ngram_join import brute
from test_packing import check
from tokenizers import Tokenizer

import corpus_pipeline
from inkveil.llm.pii import base_spans
from inkveil.llm.quality import quality_scores


@pytest.fixture(scope="module")
def tables(spark, sf_dir, tmp_path_factory):
    """The test tables with rows added: copies, repeated rows, nulls, a benchmark item, extra columns."""
    d = tmp_path_factory.mktemp("tables")
    for name in ("labels", "benchmark"):
        shutil.copy(f"{sf_dir}/{name}.parquet", d)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first().text
    good = docs.where("doc_id = 1").first().text
    rows = [
        (9001, good, "en", "s", 1),
        (9002, good + " more words at the end", "en", "s", 1),
        (9003, f"{good[:400]} {item} {good[400:800]}", "en", "s", 1),
        (9003, f"{good[:400]} {item} {good[400:800]}", "en", "s", 1),
        (9004, None, None, None, None),
        (None, "a few words", None, None, None),
        (9005, "It byanthblely anreed hestwh of. Mail me@x.com or +1 (555) 555-1234 now. Ontionndnt the, nd thores.", "en", "s", 1),
        (9005, "It byanthblely anreed hestwh of. Mail me@x.com or +1 (555) 555-1234 now. Ontionndnt the, nd thores.", "en", "s", 1),
    ]
    more = spark.createDataFrame(rows, docs.schema)
    docs.unionAll(more).selectExpr("*", "doc_id % 3 AS score").write.parquet(f"{d}/documents.parquet")
    return str(d)


def one_of_each(rows):
    """By brute force: the row of the smallest id (null ids last) of each group."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    groups = brute({k: r[1] for k, r in enumerate(rows)})
    return sorted(repr(rows[k]) for k, (_, c) in groups.items() if c == k)


def test_rows_are_decided_by_their_own_text(spark, sf_dir):
    """Null ids, two texts under one id, repeated rows, empty texts and no rows at all."""
    item = next(r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect() if len(r.text.split()) > 20)
    rows = [
        (1, f"some words before {item} and behind"), (1, "a clean second text under the id of a dirty one it is"),
        (None, f"{item}"), (None, "clean words of a row without any id at all"), (2, "one two three four five six seven"),
        (2, "another text of id two that is like no other here"), (3, "one two three four five six seven"),
        (None, "one two three four five six seven"), (5, ""), (5, ""), (None, None), (6, "w"), (7, "w"),
        (None, "only rows without an id have this text here"), (None, "only rows without an id have this text here"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    df = df.selectExpr("*", "1 AS __place", "'x' AS component_id", "2 AS n_shingles")
    got = corpus_pipeline.near_duplicates(spark, df, sf_dir)
    assert got.columns == df.columns
    assert sorted(repr(tuple(r)[:2]) for r in got.collect()) == one_of_each(rows)
    sets = [shingle_set(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    clean = [r for r in rows if not any(100 * len(shingle_set(r[1]) & s) >= 75 * len(s) for s in sets)]
    got = corpus_pipeline.decontamination(spark, df, sf_dir).collect()
    assert sorted(repr(tuple(r)[:2]) for r in got) == sorted(map(repr, clean))
    assert {r for r in rows} - set(clean) == {rows[0], rows[2]}
    for stage in (corpus_pipeline.near_duplicates, corpus_pipeline.decontamination):
        assert stage(spark, df.limit(0), sf_dir).collect() == []


def test_stages_as_brute_force(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.collect()]
        out = stage(spark, docs, tables)
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{tables}/{name}")
        docs = spark.read.parquet(f"{tables}/{name}")
        kept[name] = before, [tuple(r) for r in docs.collect()] if name != "packing" else docs.collect()

    before, after = kept["quality"]
    scored = quality_scores(spark.read.parquet(f"{tables}/documents.parquet"), spark.read.parquet(f"{tables}/labels.parquet"))
    good = sorted(repr(r.doc_id) for r in scored.collect() if r.score >= 0.7)
    assert sorted(repr(r[0]) for r in after) == good
    assert 0 < len(after) < len(before)

    before, after = kept["near_duplicates"]
    assert sorted(map(repr, after)) == one_of_each(before)
    assert 9001 not in {r[0] for r in after}

    before, after = kept["decontamination"]
    sets = [shingle_set(r.text) for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    clean = [r for r in before if not any(100 * len(shingle_set(r[1]) & s) >= 75 * len(s) for s in sets)]
    assert 0 < len(clean) < len(before)
    assert sorted(map(repr, after)) == sorted(map(repr, clean))

    before, after = kept["pii"]
    assert [r[0] for r in sorted(after, key=repr)] == [r[0] for r in sorted(before, key=repr)]
    old = {r[0]: r[1] for r in before}
    changed = 0
    for r in after:
        assert not any(base_spans(r[1] or ""))
        assert r[4] == (None if r[1] is None else len(r[1]))
        if old[r[0]] is not None and any(base_spans(old[r[0]])):
            changed += 1
        elif "[SECRET]" not in (r[1] or ""):
            assert r[1] == old[r[0]]
    assert changed

    before, after = kept["packing"]
    assert {r.doc_id for r in after} == {r[0] for r in before}
    check(after, {r[0]: r[1] for r in before})


def test_run(spark, tables):
    rows = corpus_pipeline.run(spark, tables).collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert rows
    assert all(len(r.ids) == 4 * r.length for r in rows)
    assert library.get_vocab_size() > max(int.from_bytes(r.ids[:4], "little") for r in rows)
