import random

import pytest
from conftest import Groups

from inkveil.llm import components as module
from inkveil.llm.components import components


@pytest.mark.parametrize("per_task", [1_000_000, 20])
def test_as_union_find(spark, monkeypatch, per_task):
    monkeypatch.setattr(module, "EDGES_PER_TASK", per_task)
    rng = random.Random(per_task)
    edges = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 140)]  # a path and a star
    edges += [(rng.randint(200, 300), rng.randint(200, 300)) for _ in range(60)] + [(500, 500), (-5, 7), (-5, 7)]
    rng.shuffle(edges)
    groups = Groups({x for e in edges for x in e})
    for a, b in edges:
        groups.join(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "x long, y long")).collect()}
    assert got == {x: groups.find(x) for x in groups.of}


def test_packed_edges(spark):
    import numpy as np

    rows = [(bytearray(np.array(p, "<i8").tobytes()),) for p in ([[1, 2], [5, 5]], [[2, 3]], [])]
    got = {r.node: r.root for r in components(spark.createDataFrame(rows, "edges binary")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 5: 5}


def test_without_ids(spark, monkeypatch):
    from inkveil.llm import common

    docs = spark.createDataFrame([(k, "t") for k in [*range(300), 7, 8, None]], "doc_id long, text string")
    gone = spark.createDataFrame([(k,) for k in [*range(0, 300, 7), 999, None]], "g long")
    for bits in (common.ID_BITS, 64):
        monkeypatch.setattr(common, "ID_BITS", bits)
        got = sorted((r.doc_id for r in common.without_ids(docs, gone).collect()), key=repr)
        assert got == sorted((k for k in [*range(300), 7, 8, None] if k is None or k % 7), key=repr)


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "x long, y long")).collect() == []
