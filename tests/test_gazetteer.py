"""Long lists of names: the index by rarest word against the list in the expression."""

import time

import pytest
from pyspark.sql import functions as F

from inkveil.operators import detect as D
from inkveil.operators import gazetteer as G


def test_rarest_word(spark):
    words = spark.createDataFrame([(w,) for w in "The The The of of Bank River".split()], "word string")
    names = spark.createDataFrame([("The Bank of River",), ("The of",), ("The",), ("The Nowhere",), ("Bank of The",)], "name string")
    got = {r.name: (r.word, r.n) for r in G.names_by_rarest_word(words, names).collect()}
    assert got == {"The Bank of River": ("Bank", 1), "The of": ("of", 2), "The": ("The", 3), "Bank of The": ("Bank", 1)}


@pytest.mark.parametrize("hot", [G.HOT, 1 << 30])
def test_null_and_repeated_ids_and_any_size(spark, monkeypatch, hot):
    """The same rows whether the list stands in the expression or is joined, whatever the ids."""
    monkeypatch.setattr(G, "HOT", hot)
    names = ["The House", "The House of Cards", "The", "The Big Firm", "Yahoo!", "St. Jude", "金山 办公", "Big & Small", "a_b c"]
    texts = [f"we like {n} and {n}s or x{n} ({n})." for n in names] + ["The", "", None, "The The The House of cards", "nothing"]
    rows = [(None if i % 3 else 7, t) for i, t in enumerate(texts * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit(1)).withColumn("found", F.lit("x"))
    more = [(f"The Firm{i}",) for i in range(2000)]
    got = []
    for extra, inline in (([], 1 << 20), ([], 0), (more, 0)):
        monkeypatch.setattr(D, "INLINE_BYTES", inline)
        found = D.detect_company(df, spark.createDataFrame([(n,) for n in names] + extra, "name string"))
        got.append(sorted((r.doc_id is None, r.start, r.value) for r in found.collect()))
    assert got[0] == got[1] == got[2]
    values = {v for _, _, v in got[0]}
    assert values == set(names)
    assert D.detect_company(df.limit(0), spark.createDataFrame(more, "name string")).collect() == []


def test_a_million_names_that_begin_alike(spark, monkeypatch):
    monkeypatch.setattr(D, "INLINE_BYTES", 1000)
    names = spark.range(1_000_000).select(F.concat(F.lit("The Q"), F.col("id").cast("string"), F.lit(" Works")).alias("name"))

    def took(n):
        texts = spark.range(n).select(
            F.lit(None).cast("long").alias("doc_id"),
            F.concat(F.lit("The note: The Q"), (F.col("id") * 7).cast("string"), F.lit(" Works, The Nobody Works")).alias("text"),
        )
        begin = time.time()
        found = D.detect_company(texts, names).collect()
        assert {r.value for r in found} == {f"The Q{7 * i} Works" for i in range(n)}
        return time.time() - begin

    took(10)
    small = took(500)
    assert took(8000) < max(20, 4 * small)


def test_texts_without_names_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(D, "INLINE_BYTES", 0)
    names = spark.createDataFrame([("Zork Works",)], "name string")
    df = spark.createDataFrame([(i, f"plain text {i}" if i else "at Zork Works") for i in range(500)], "doc_id long, text string")
    out, _ = D.gazetteer_words(df, names, "text", "names")
    assert out.where("names is not null").count() == 1
    plan = out._jdf.queryExecution().executedPlan().toString()
    union = plan.index("Union")
    first_branch = plan[union : plan.index("SortMergeJoin" if "SortMergeJoin" in plan[union:] else "BroadcastHashJoin [_key", union)]
    assert "Exchange hashpartitioning" not in first_branch.split("BroadcastExchange")[0]


def test_names_without_a_chance_are_not_shuffled(spark, tmp_path):
    """A name with a word that no text has goes before it is cut into words: the lists here would write 60,000 rows."""
    words = spark.createDataFrame([("The",), ("River",)], "word string")
    names = spark.range(20_000).select(F.concat(F.lit("The Firm"), F.col("id").cast("string"), F.lit(" Works")).alias("name"))
    names = names.unionAll(spark.createDataFrame([("The River",), ("The River",), ("...",)], "name string"))
    found = G.names_by_rarest_word(words, names)
    assert [tuple(r) for r in found.collect()] == [("The River", "The", 1)] or [tuple(r) for r in found.collect()] == [("The River", "River", 1)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    generate = plan[plan.index("Generate") :]
    assert "BroadcastNestedLoopJoin" in generate and "LeftSemi" in generate


def test_bit_table(spark, monkeypatch):
    """Every value's bit is found at any size; few others are, unless the table is full."""
    values = spark.range(50_000).select(F.concat(F.lit("w"), "id").alias("word"))
    asked = spark.range(100_000).select(F.concat(F.lit("w"), "id").alias("word")).unionAll(spark.createDataFrame([(None,)], "word string"))
    small = G.BitTable(values)
    assert 50_000 <= asked.where(small.may_have(F.col("word"))).count() < 56_000
    monkeypatch.setattr(G, "MOST_BITS", 1 << 16)
    full = G.BitTable(values)
    assert full.bits < small.bits and asked.where(full.may_have(F.col("word"))).count() >= 50_000
    none = G.BitTable(values.limit(0))
    assert asked.where(none.may_have(F.col("word"))).count() == 0


def test_words_of_a_text(spark):
    row = spark.createDataFrame([("  St. Jude_2, 金山 办公—St. áb",), ("",), ("..",), (None,)], "t string")
    got = [r.w for r in row.select(G.text_words(F.col("t")).alias("w")).collect()]
    assert got == [["St", "Jude_2", "金山", "办公", "a", "b"], [], [], None]
