"""Mixing of sources against a plain version: targets by repeated sharing, sorted lists, running sums."""

import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from inkveil.llm.mixing import LEAST_QUALITY, MARKUP, mix_sources

WORD = re.compile("[^\x20\x09-\x0d]+")


def targets_of(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, target, open_ = float(sum(sizes.values())), {}, set(sizes)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 3 * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in open_}
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def quality(text):
    if not text:
        return LEAST_QUALITY
    lines = text.split("\n")
    plain = sum(c not in MARKUP for c in text) / len(text)
    return max(LEAST_QUALITY, plain * (len(set(lines)) / len(lines)))


def brute(rows):
    sizes = {}
    docs = {}
    for doc, text, source in rows:
        text = text or ""
        size = len(WORD.findall(text))
        drawn = hashlib.md5(f"mix|{'' if doc is None else doc}|{hashlib.md5(text.encode()).hexdigest()}".encode()).hexdigest()
        key = -math.log((int(drawn[:13], 16) + 0.5) / 2**52) / quality(text)
        sizes[source] = sizes.get(source, 0) + size
        docs.setdefault(source, []).append((key, drawn, doc, size))
    targets, out = targets_of(sizes), []
    for source, some in docs.items():
        whole = int(targets[source] // sizes[source]) if sizes[source] else 0
        rest, before = targets[source] - whole * sizes[source], 0
        for _, _, doc, size in sorted(some, key=lambda d: d[:2]):
            times = whole + (whole < 3 and size > 0 and 2 * before + size <= 2 * rest)
            out.append((repr(doc), source, size, sizes[source], round(targets[source], 6), size * times))
            before += size
    return sorted(out, key=repr)


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    df = df.withColumn("size", F.lit("x")).withColumn("target", F.lit(None).cast("int")).withColumn("name", F.lit(1))
    got = mix_sources(df.repartition(5), **options).collect()
    return sorted(((repr(r.doc_id), r.source, r.size, r.source_size, round(r.target, 6), r.taken) for r in got), key=repr)


def some_rows(n, sources, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = sources[min(int(rng.expovariate(0.5)), len(sources) - 1)]
        words = ["w" * rng.randint(1, 6) + rng.choice(["", "7", "{x}"]) for _ in range(rng.randint(0, 40))]
        rows.append((i, rng.choice([" ", "\n", "\t"]).join(words), source))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    names = ["", "Zed", "alpha", "beta", "é", "\U0001f600", "￿", None, "gamma"]
    rows = some_rows(300, names, seed)
    assert run(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", None), (None, "x y z", "a"), (None, "x y z", "a"), (None, None, None)]
    rows += [(7, "same text here", "b")] * 400 + [(8, "word " * 50_000, "c"), (9, "\x0b \t", "d")]
    assert run(spark, rows) == brute(rows)


def test_alike_rows_come_out_as_often_as_they_come_in(spark):
    df = spark.range(25_003).select(F.lit(1).alias("doc_id"), F.lit("a b c").alias("text"), F.lit("s").alias("source"))
    other = spark.createDataFrame([(2, "a " * 100_000, "t")], "doc_id int, text string, source string")
    got = mix_sources(df.unionAll(other)).groupBy("doc_id", "epochs").count().collect()
    assert sum(r["count"] for r in got if r.doc_id == 1) == 25_003
    target = mix_sources(df.unionAll(other)).where("doc_id = 1").agg(F.max("target"), F.sum("taken")).first()
    assert abs(target[0] - target[1]) <= 1.5


def test_empty_and_sizeless_tables(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None, "a"), (2, "", None)]) == [("1", "a", 0, 0, 0.0, 0), ("2", None, 0, 0, 0.0, 0)]


def test_sources_come_near_their_targets_and_better_documents_go_first(spark):
    rows = [(i, "plain words of prose " * 5 if i % 2 else "{0} [1] (2) <3> = " * 4, "s") for i in range(2000)]
    rows += [(i, "other words " * 30, "t") for i in range(2000, 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mix_sources(df).toPandas()
    for _, part in out.groupby("source"):
        assert abs(part.taken.sum() - part.target.iloc[0]) <= part["size"].max() / 2
        assert (part.taken <= 3 * part["size"]).all()
    t = out[out.source == "t"]
    assert 0 < (t.taken > 0).sum() < len(t)
    s = mix_sources(df, weights=(1, 3)).toPandas()
    s = s[s.source == "s"]
    prose, marks = s[s.doc_id % 2 == 1], s[s.doc_id % 2 == 0]
    assert prose.epochs.mean() > 1.3 * marks.epochs.mean()


def test_weights_other_than_dealt(spark):
    rows = some_rows(200, ["a", "b", "c"], 9)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mix_sources(df, weights=(1,), share=0.5, epochs=1, quality=F.lit(1.0)).toPandas()
    assert out.epochs.max() <= 1
    whole = out["size"].sum() / 2
    assert abs(out.groupby("source").target.first().sum() - whole) < 1e-6
