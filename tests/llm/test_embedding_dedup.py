from itertools import combinations

import numpy as np
import pytest
from conftest import Groups

from inkveil.llm import embedding_dedup as module
from inkveil.llm.embedding_dedup import embedding_components


@pytest.mark.parametrize("part", [1024, 3])
def test_as_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(module, "PART", part)
    rng = np.random.default_rng(part)
    rows = []
    for label in (0, 1, None):
        for _ in range(6):
            base = rng.standard_normal(16)
            for _ in range(int(rng.integers(1, 9))):
                rows.append((len(rows), (base + rng.standard_normal(16) * 0.12).tolist(), label))
            rows.append((len(rows), (base * 2.5).tolist(), label))
    rows.append((len(rows), rows[0][1], 0))  # an exact copy
    rows.append((len(rows), rows[0][1], 1))  # the same under another label
    for bad in (None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0] * 3):
        rows.append((len(rows), bad, 0))
    groups, links = Groups([r[0] for r in rows]), dict.fromkeys((r[0] for r in rows), 0)
    good = [(i, np.array(v, float), y) for i, v, y in rows if v and y is not None and None not in v]
    good = [(i, v, y) for i, v, y in good if np.isfinite(v).all() and v.any()]
    for (a, u, x), (b, v, y) in combinations(good, 2):
        if x == y and len(u) == len(v) and u @ v / np.sqrt((u @ u) * (v @ v)) >= 0.98:
            groups.join(a, b)
            links[a] += 1
            links[b] += 1
    assert sum(links.values()) > 40
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_components(df).collect()}
    assert got == {i: (links[i], groups.find(i), groups.find(i) == i) for i in links}


def test_layout_bounds_misses():
    for n in (10, 10_000, 10**9):
        signs, tables = module.layout(n, 0.98)
        alike = (1 - np.arccos(0.98) / np.pi) ** signs
        assert (1 - alike) ** tables <= module.MISS
