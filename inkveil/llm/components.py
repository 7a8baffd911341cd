"""Connected components of an edge table, distributed.

Every partition of a bounded number of edges is first replaced by its spanning stars
(union by smallest label, in numpy); what several partitions know of the same node is
joined by alternating large-star and small-star rounds until nothing changes. The
state of each round is a table in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import batch_of, saved

EDGES_PER_TASK = 1_000_000
SCHEMA = pa.schema([("node", pa.int64()), ("root", pa.int64())])


def local_components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(nodes, smallest node of each one's component)`` for edges ``a[i] - b[i]``."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return nodes, nodes[label]


def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of one partition as ``(node, root)``, nodes that are their own root included."""
    parts = []
    for b in batches:
        if b.num_columns == 1:
            pairs = np.frombuffer(b"".join(b.column(0).to_pylist()), "<i8").reshape(-1, 2)
            parts.append((pairs[:, 0], pairs[:, 1]))
        else:
            parts.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
    if parts:
        nodes, roots = local_components(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        for k in range(0, len(nodes), 100_000):
            yield batch_of(SCHEMA, nodes[k : k + 100_000], roots[k : k + 100_000])


def _with_low(edges: DataFrame) -> DataFrame:
    """Each edge in both directions with the smallest label near its first end."""
    both = edges.unionAll(edges.select(F.col("root").alias("node"), F.col("node").alias("root")))
    low = both.groupBy("node").agg(F.least(F.min("root"), F.first("node")).alias("low"))
    return both.join(low, "node")


def _state(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))).first()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``(node, root)`` for every node of ``edges``; ``root`` is the smallest id reachable.

    ``edges`` has two columns of long ids, or one binary column of many such pairs
    (little-endian) a row. Edges from a node to itself are allowed and make it a node; repeated edges do no harm.
    No edges give no rows. Null ends are not allowed.
    """
    edges = saved(edges, name)
    size = F.count("*") if len(edges.columns) == 2 else F.sum(F.octet_length(edges.columns[0])) / 16
    parts = max(1, -(-int(edges.agg(size).first()[0] or 0) // EDGES_PER_TASK))
    state = saved(edges.repartition(parts).mapInArrow(stars, "node long, root long"), name)
    if parts == 1:
        return state
    before = None
    while (now := _state(state)) != before:
        before = now
        large = _with_low(state).where("root > node").select(F.col("root").alias("node"), F.col("low").alias("root"))
        lows = state.where("node = root")  # nodes that are a root already
        large = saved(large.unionAll(lows).distinct(), name)
        near = _with_low(large).where("root <= node")
        state = saved(
            near.select(F.col("root").alias("node"), F.col("low").alias("root"))
            .unionAll(near.select("node", F.col("low").alias("root")))
            .unionAll(large.where("node = root"))
            .distinct(),
            name,
        )
    # At the end every node has one edge to its root, besides roots' edges to themselves.
    return state.groupBy("node").agg(F.min("root").alias("root"))
