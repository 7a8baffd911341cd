"""Near-duplicate embeddings: random-hyperplane sign hashing, exact cosine, connected components.

Equal vectors of one label are one node with a multiplicity. Each of several tables
hashes a node to the signs of its products with random hyperplanes. The number of signs
grows with the logarithm of the number of nodes, the number of tables follows from it, so
that a pair at the limit is missed with probability ``MISS`` at most, whatever the size.
Nodes that share a bucket are compared exactly in blocks; a pair counts in the first table
that has it in one bucket. Large buckets are dealt out as pairs of parts; no pairs are
emitted, only each node's number of links and the stars of each block's components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import batch_of, saved
from inkveil.llm.components import components, local_components

COSINE = 0.98
MISS = 1e-6
PART = 1024
ROWS_PER_TASK = 20_000
SEED = 20_240_801


def layout(nodes: int, cosine: float) -> tuple[int, int]:
    """``(signs per table, tables)``."""
    signs = min(60, max(8, math.ceil(math.log2(max(2, nodes)))))
    alike = (1 - math.acos(cosine) / math.pi) ** signs
    return signs, math.ceil(math.log(MISS) / math.log1p(-alike))


PLAIN = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("vector", pa.binary())])


def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as bytes of doubles; null where one can't link."""
    for batch in batches:
        out = []
        for v in batch.column(2).to_pylist():
            x = np.array(v, np.float64) if v else np.zeros(0)  # null components become nan
            good = len(x) and np.isfinite(x).all() and x.any() and np.isfinite(x @ x) and x @ x > 0
            out.append(x.astype("<f8").tobytes() if good else None)
        yield batch_of(PLAIN, batch.column(0), batch.column(1), out)


def signs_of(signs: int, tables: int):
    schema = pa.schema([("key", pa.int64()), ("signs", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(signs, dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = [np.frombuffer(b, "<f8") for b in batch.column(1).to_pylist()]
            out = np.zeros((len(vectors), tables), np.int64)
            width = np.array([len(v) for v in vectors])
            for d in np.unique(width).tolist():
                if d not in planes:
                    planes[d] = np.random.default_rng([SEED, d]).standard_normal((d, signs * tables))
                rows = np.flatnonzero(width == d)
                side = np.stack([vectors[i] for i in rows.tolist()]) @ planes[d] > 0
                out[rows] = side.reshape(len(rows), tables, signs) @ weights
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * tables, pa.int32()), pa.array(out.ravel()))
            yield batch_of(schema, batch.column(0), flat)

    return run


FOUND = pa.schema([("node", pa.int64()), ("root", pa.int64()), ("links", pa.int64())])


def compare(cosine: float):
    """Links inside the blocks of one task: for each node its links and its component's smallest node."""

    def run(t: pa.Table) -> pa.Table:
        key, label = t["key"].to_numpy(), t["label"].to_numpy()
        pair, chunk = t["pair"].to_numpy(), t["chunk"].to_numpy()
        node, copies, tables = t["node"].to_numpy(), t["copies"].to_numpy(), t["number"].to_numpy()
        signs = np.stack(t["signs"].to_numpy())
        vectors = t["vector"].to_pylist()
        width = np.array([len(v) for v in vectors])
        order = np.lexsort((chunk, pair, width, label, key))
        columns = [c[order] for c in (key, label, width, pair)]
        new = np.any([c[1:] != c[:-1] for c in columns], axis=0)
        got_a, got_b, got_nodes, got_links = [], [], [], []
        for some in np.split(order, np.flatnonzero(new) + 1):
            if len(some) < 2:
                continue
            x = np.stack([np.frombuffer(vectors[i], "<f8") for i in some.tolist()])
            x = x / np.sqrt((x * x).sum(1))[:, None]
            cut = int(np.searchsorted(chunk[some], chunk[some][-1]))  # rows of the first part; 0: one part only
            left, right = (some[:cut], some[cut:]) if cut else (some, some)
            near = (x[:cut] if cut else x) @ x[cut:].T >= cosine
            i, j = np.nonzero(near if cut else np.triu(near, 1))
            a, b = left[i], right[j]
            for k in range(int(tables[some[0]])):
                fresh = signs[a, k] != signs[b, k]
                a, b = a[fresh], b[fresh]
            if len(a):
                got_nodes += [node[a], node[b]]
                got_links += [copies[b], copies[a]]
                got_a.append(node[a])
                got_b.append(node[b])
        if not got_a:
            return FOUND.empty_table()
        nodes, roots = local_components(np.concatenate(got_a), np.concatenate(got_b))
        at = np.searchsorted(nodes, np.concatenate(got_nodes))
        links = np.bincount(at, np.concatenate(got_links).astype(float), len(nodes)).astype(np.int64)
        return pa.table([pa.array(nodes), pa.array(roots), pa.array(links)], schema=FOUND)

    return run


def embedding_components(
    vectors: DataFrame,
    cosine: float = COSINE,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row per input row.

    Vectors of equal label link when their cosine, in double precision, is at least
    ``cosine``; ``n_links`` counts the other rows linked directly, ``component_id`` is the
    smallest id reachable, ``kept`` says whether it is the row's own. Rows with a null
    label, a vector that is null, empty, zero or holds null or non-finite components, or
    a null id link with nothing (a null id has a null component and is not kept). Vectors
    of different length do not link. Repeated rows are linked with each other; other
    columns are ignored.
    """
    spark = vectors.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = saved(
        vectors.select(
            F.col(id_col).cast("long").alias("vec_id"),
            F.col(label_col).cast("long").alias("label"),
            F.col(vector_col).cast("array<double>").alias("vector"),
        ).mapInArrow(plain, "vec_id long, label long, vector binary"),
        "vectors",
    )
    able = rows.where("vec_id is not null and label is not null and vector is not null")
    nodes = saved(
        able.groupBy("label", "vector").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies")), "nodes"
    )
    # Rows of one id may hold several vectors; a node's own key tells them apart.
    nodes = nodes.withColumn("key", F.xxhash64("label", "vector"))
    signs, tables = layout(nodes.count(), cosine)
    signed = saved(
        nodes.select("key", "vector").mapInArrow(signs_of(signs, tables), "key long, signs array<long>"), "signs"
    )
    places = signed.select("key", F.posexplode("signs").alias("number", "value")).join(nodes.select("key", "label"), "key")
    places = places.select("key", "number", F.xxhash64("label", "number", "value").alias("bucket"))
    shared = places.groupBy("bucket").count().where("count > 1")
    members = saved(places.join(shared, "bucket"), "members")
    parts = F.ceil(F.col("count") / PART)
    members = members.withColumn("parts", parts).withColumn("chunk", F.pmod(F.xxhash64("key", "bucket"), "parts"))
    pairs = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("parts") - 1),
        lambda k: F.least(k, F.col("chunk")) * F.col("parts") + F.greatest(k, F.col("chunk")),
    )
    dealt = members.select(F.explode(pairs).alias("pair"), "key", "number", "bucket", "chunk")
    n_tasks = max(partitions, -(-members.agg(F.sum("parts")).first()[0] // ROWS_PER_TASK) if shared.head(1) else 1)
    found = saved(
        dealt.join(nodes.join(signed, "key"), "key")
        .select(
            F.col("key").alias("node"), F.col("bucket").alias("key"), "label", "pair", "chunk", "copies", "number",
            "signs", "vector",
        )
        .withColumn("task", F.pmod(F.xxhash64("key", "pair"), F.lit(n_tasks)))
        .groupBy("task")
        .applyInArrow(compare(cosine), "node long, root long, links long"),
        "links",
    )
    comps = components(found.select("node", "root"), "vector-components")
    of_node = (
        nodes.select(F.col("key").alias("node"), F.col("node").alias("smallest"), "copies", "label", "vector")
        .join(found.groupBy("node").agg(F.sum("links").alias("links")), "node", "left")
        .join(comps, "node", "left")
        .withColumn("root", F.coalesce("root", "node"))
    )
    of_node = saved(of_node, "of-node")
    least = of_node.groupBy("root").agg(F.min("smallest").alias("component_id"))
    of_node = of_node.join(least, "root").select(
        "label", "vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"
    )
    out = rows.where("vec_id is not null").join(of_node, ["label", "vector"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
    )
    nameless = rows.where("vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), "vec_id")
    return out.unionAll(nameless).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
