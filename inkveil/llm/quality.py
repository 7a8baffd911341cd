"""Quality classifier: histogram gradient-boosted trees over statistics of a document.

Statistics of whole texts are computed batch by batch as arrays. Trees are grown on
binned statistics from histograms of gradients and laid out as flat arrays (feature,
bin, left child, value), through which numpy walks all rows at once, level by level.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import BATCH_BYTES, batch_of, crc_mod, cut_batches, id_and_text, map_texts, saved, text_batches
from inkveil.llm.words import shingles, words_of

THRESHOLD = 0.7
SAMPLE = 50_000
BINS, TREES, DEPTH, RATE, L2 = 64, 80, 4, 0.15, 1.0
FOLDS, HELD_OUT = 4, 2

CLASSES = {
    "upper": range(65, 91),
    "digit": range(48, 58),
    "space": [32, *range(9, 14)],
    "line": [10],
    "stop": b".!?",
    "comma": b",;:",
    "symbol": b"#$%&*@^~_=+\\",
    "bracket": b"()[]{}<>|/",
    "bang": b"!",
    "quote": b"\"'`",
    "non_ascii": range(128, 256),
}
TABLE = np.zeros((256, len(CLASSES)), np.int8)
for _k, _bytes in enumerate(CLASSES.values()):
    TABLE[list(_bytes), _k] = 1
STATISTICS = (
    *(f"share_{c}" for c in CLASSES),
    "log_bytes",
    "log_words",
    "word_length",
    "distinct_words",
    "top_word",
    "repeated_word",
    "distinct_triples",
    "line_words",
    "sentence_words",
)


def statistics(texts: list[bytes]) -> np.ndarray:
    """A row of :data:`STATISTICS` for each text; all 0 for an empty one but for a constant few."""
    n = len(texts)
    size = np.array([len(t) for t in texts])
    counts = np.zeros((n, len(CLASSES)))
    filled = np.flatnonzero(size)
    if len(filled):
        data = np.frombuffer(b"".join(texts), np.uint8)
        starts = np.concatenate(([0], np.cumsum(size[filled])))[:-1]
        for k in range(len(CLASSES)):
            counts[filled, k] = np.add.reduceat(TABLE[:, k][data], starts, dtype=np.int32)
    words = words_of(texts)
    n_words = words.counts()
    order = np.lexsort((words.hash, words.doc))
    d, h = words.doc[order], words.hash[order]
    first = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (h[1:] != h[:-1]))) if len(d) else [])
    often = np.diff(first, append=len(d))
    top = np.zeros(n)
    np.maximum.at(top, d[first], often)
    again = np.flatnonzero((words.doc[1:] == words.doc[:-1]) & (words.hash[1:] == words.hash[:-1]))
    doc3, h3 = shingles(words, 3)
    key = np.sort((doc3.astype(np.uint64) << np.uint64(48)) | (h3 >> np.uint64(16)))
    new = key[np.concatenate(([True], key[1:] != key[:-1]))] if len(key) else key
    triples = np.bincount((new >> np.uint64(48)).astype(np.int64), minlength=n)
    some, any_words = np.maximum(size, 1), np.maximum(n_words, 1)
    columns = list(CLASSES)
    return np.column_stack(
        (
            counts / some[:, None],
            np.log1p(size),
            np.log1p(n_words),
            (size - counts[:, columns.index("space")]) / any_words,
            np.bincount(d[first], minlength=n) / any_words,
            top / any_words,
            np.bincount(words.doc[again], minlength=n) / any_words,
            triples / np.maximum(np.bincount(doc3, minlength=n), 1),
            n_words / (counts[:, columns.index("line")] + 1),
            n_words / (counts[:, columns.index("stop")] + 1),
        )
    )


@dataclass
class Trees:
    """A forest as flat arrays: ``left`` is a node's left child, the right one follows; leaves point to themselves."""

    edges: list[np.ndarray]
    feature: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    start: float

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)])

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for rows of statistics."""
        bins, rows = self.binned(x), np.arange(len(x))
        total = np.full(len(x), self.start)
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                right = bins[rows, self.feature[node]] > self.bin[node]
                node = np.where(self.left[node] == node, node, self.left[node] + right)
            total += self.value[node]
        return 1 / (1 + np.exp(-np.clip(total, -60, 60)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Trees:
    """Boosted trees for labels 0 and 1; with one label only, or no rows, a constant."""
    share = (y.sum() + 1) / (len(y) + 2)
    start = float(np.log(share / (1 - share)))
    width = x.shape[1]
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(width)]
    feature, bin_, left, value, roots = [], [], [], [], []
    forest = Trees(edges, *(np.zeros(0, int),) * 3, np.zeros(0), np.zeros(0, int), depth, start)
    if len(x) and 0 < y.sum() < len(y):
        bins = forest.binned(x)
        flat = bins + np.arange(width) * BINS
        score = np.full(len(x), start)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-score))
            g, h = p - y, p * (1 - p)
            node = np.zeros(len(x), int)  # numbers within the level
            ids = [len(feature)]  # tree nodes of the level; -1: no such node
            roots.append(ids[0])
            feature, bin_, left, value = feature + [0], bin_ + [0], left + [ids[0]], value + [0.0]
            for level in range(depth + 1):
                live = node >= 0
                cells = len(ids) * width * BINS
                at = (node[live, None] * (width * BINS) + flat[live]).ravel()
                sum_g = np.bincount(at, np.repeat(g[live], width), cells).reshape(len(ids), width, BINS)
                sum_h = np.bincount(at, np.repeat(h[live], width), cells).reshape(len(ids), width, BINS)
                left_g, left_h = sum_g.cumsum(2), sum_h.cumsum(2)
                all_g, all_h = left_g[:, :1, -1:], left_h[:, :1, -1:]
                right_g, right_h = all_g - left_g, all_h - left_h
                gain = left_g**2 / (left_h + L2) + right_g**2 / (right_h + L2) - all_g**2 / (all_h + L2)
                gain[(left_h < 1.0) | (right_h < 1.0)] = 0
                next_ids, goes = [], np.full((len(ids), 3), -1)
                for k, i in enumerate(ids):
                    value[i] = float(-rate * all_g[k, 0, 0] / (all_h[k, 0, 0] + L2))
                    best = int(gain[k].argmax())
                    if level < depth and gain[k].flat[best] > 1e-6:
                        feature[i], bin_[i] = divmod(best, BINS)
                        left[i] = len(feature)
                        goes[k] = feature[i], bin_[i], len(next_ids)
                        for _side in range(2):
                            next_ids.append(len(feature))
                            left.append(len(feature))
                            feature, bin_, value = feature + [0], bin_ + [0], value + [0.0]
                done = live & (goes[node, 0] < 0)
                score[done] += np.array([value[i] for i in ids])[node[done]]
                moves = live & ~done
                rule = goes[node[moves]]
                node[done] = -1
                node[moves] = rule[:, 2] + (bins[moves, rule[:, 0]] > rule[:, 1])
                ids = next_ids
                if not ids:
                    break
    return Trees(edges, *map(np.array, (feature, bin_, left, value, roots)), depth, start) if roots else forest


ROW = pa.schema([("doc_id", pa.int64()), ("statistics", pa.list_(pa.float64()))])


def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, texts in text_batches(batches, BATCH_BYTES):
        x = statistics(texts)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
        yield batch_of(ROW, ids, flat)


def score_rows(forest: Trees):
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
                yield batch_of(schema, batch.column(0), forest.probability(x))

    return run


def training_labels(
    ids: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", label_col: str = "quality"
) -> DataFrame:
    """``(doc_id, y)`` of the training folds whose hash is small enough that about ``1.2 * sample`` rows of ``ids`` have one.

    So what is sorted for the sample does not grow with the labels.
    """
    label = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y"))
    label = label.where("doc_id is not null and y in (0, 1)").where(crc_mod(F.col("doc_id"), FOLDS) != HELD_OUT)
    n = ids.join(label, "doc_id").count()
    part = min(1.0, (1.2 * sample + 1000) / max(1, n))
    return label.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 32)) < int(part * (1 << 32)))


def fit(found: DataFrame, label: DataFrame, sample: int = SAMPLE) -> Trees:
    """Trees from measured documents and :func:`training_labels`, on at most ``sample`` rows, those of the smallest hash."""
    chosen = (
        found.join(label, "doc_id")
        .orderBy(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 32)), "doc_id", "y", "statistics")
        .limit(sample)
        .select("statistics", "y")
        .toPandas()
    )
    x = np.array(chosen["statistics"].tolist()).reshape(len(chosen), len(STATISTICS))
    return grow(x, chosen["y"].to_numpy(float))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    rows = id_and_text(docs, id_col, text_col)
    return saved(rows.mapInArrow(measure, "doc_id long, statistics array<double>"), "quality")


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    sample: int = SAMPLE,
    threshold: float = THRESHOLD,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``, one row per input row; ``score`` is the probability of label 1.

    Trees are fitted on at most ``sample`` labelled rows, those of the smallest hash of
    their id, out of the folds other than the held-out one (``crc32(id as text) mod 4
    = 2``). Only the text is an input. Null and empty texts are scored like any other;
    rows of a null id are scored, their ``held_out`` is null and they are no training
    rows. Null labels, and labels other than 0 and 1, are left out; repeated rows come
    out as often as they come in; other columns are ignored. Without labels of both
    kinds every document gets the smoothed share of label 1.
    """
    found = measured(docs, id_col, text_col)
    forest = fit(found, training_labels(found.select("doc_id"), labels, sample, id_col, label_col), sample)
    return found.mapInArrow(score_rows(forest), "doc_id long, score double").select(
        "doc_id",
        (crc_mod(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"),
        "score",
        F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"),
    )


def keep_good(
    docs: DataFrame,
    labels: DataFrame,
    sample: int = SAMPLE,
    threshold: float = THRESHOLD,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs``, with all columns, whose text scores at least ``threshold``.

    Fitted as in :func:`quality_scores`, on documents that are measured for it: those of
    the training labels, at most about ``1.2 * sample`` unless ids repeat. Every row is decided by
    its own text, where it is: texts are not shuffled, repeated rows and null ids need no care.
    """
    rows = id_and_text(docs, id_col, text_col)
    label = saved(training_labels(rows.select("doc_id"), labels, sample, id_col), "training")
    some = rows.join(F.broadcast(label.select("doc_id").distinct()), "doc_id", "left_semi")
    forest = fit(measured(some), label, sample)

    def good(texts: list[str]):
        data, out = [t.encode() for t in texts], []
        for _, some in cut_batches(data):
            out.append(forest.probability(statistics(some)) >= threshold)
        return np.concatenate(out) if out else np.zeros(0, bool), None

    return map_texts(docs, text_col, good)
