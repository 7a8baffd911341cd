"""Benchmark items inside documents, by size-partitioned MinHash containment search.

Items are partitioned by the size of their shingle set. An item's sketch is its ``k``
smallest hash values, ``k`` fixed per partition: a document that holds at least
``percent`` of an item lacks fewer than ``k`` of its shingles, so it holds one of the
``k`` smallest. Sketches are an inverted index; a document's shingles look themselves up
in it, whatever the document's length, and each hit is verified on the exact sets.
No containment above the limit is missed.

The items are a stated query set. They go to the tasks in blocks of bounded size; each
block is one pass over the documents. Documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import batch_of, cut_batches, id_and_text, map_texts, saved, text_batches
from inkveil.llm.words import Words, shingle_sets, shingles, words_of

PERCENT = 75
WIDTH = 5
BLOCK_SHINGLES = 2_000_000  # of 8 bytes, broadcast at once
ITEM = pa.schema([("item_id", pa.int64()), ("width", pa.int32()), ("n", pa.int64()), ("hashes", pa.binary())])
FOUND = pa.schema(
    [("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_item", pa.int64()), ("n_shared", pa.int64())]
)


def item_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_batches(batches):
            words = words_of(texts)
            doc, h = shingle_sets(words, width)
            ends = np.searchsorted(doc, np.arange(len(ids) + 1))
            widths = np.minimum(words.counts(), width).astype(np.int32)
            hashes = [h[a:b].astype("<u8").tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield batch_of(ITEM, ids, widths, np.diff(ends), hashes)

    return run


def sketch_size(n: int, percent: int) -> int:
    """Smallest hashes of an item in the partition of sizes ``2**b .. 2**(b+1) - 1``."""
    largest = (1 << n.bit_length()) - 1
    return min(n, largest * (100 - percent) // 100 + 1)


class Index:
    """Inverted index of item sketches, one for each width of shingles."""

    def __init__(self, items: list, percent: int):
        self.percent = percent
        self.ids = [i.item_id for i in items]
        self.sets = [np.frombuffer(i.hashes, "<u8") for i in items]  # sorted
        self.n = np.array([len(s) for s in self.sets])
        self.of_width = {}
        for width in sorted({i.width for i in items}):
            mine = [k for k, i in enumerate(items) if i.width == width]
            parts = [self.sets[k][: sketch_size(len(self.sets[k]), percent)] for k in mine]
            value = np.concatenate(parts)
            item = np.repeat(mine, [len(p) for p in parts])
            order = np.argsort(value, kind="stable")
            self.of_width[width] = value[order], item[order]

    def search(self, words: Words, width: int) -> Iterator[tuple[int, int, int]]:
        """``(document, item, shared shingles)``."""
        for w, (value, item) in self.of_width.items():
            if w == width:
                doc, h = shingle_sets(words, w)
            else:
                doc, h = shingles(words, w)
                order = np.lexsort((h, doc))
                doc, h = doc[order], h[order] >> np.uint64(16)
            first = np.searchsorted(value, h, side="left")
            hit = np.flatnonzero(value[np.minimum(first, len(value) - 1)] == h)
            count = np.searchsorted(value, h[hit], side="right") - first[hit]
            at = np.repeat(first[hit] - np.cumsum(count) + count, count) + np.arange(count.sum())
            pairs = np.unique(np.stack((np.repeat(doc[hit], count), item[at]), 1), axis=0)
            ends = np.searchsorted(doc, np.arange(words.n_docs + 1))
            for d, k in pairs.tolist():
                mine = h[ends[d] : ends[d + 1]]
                where = np.minimum(np.searchsorted(mine, self.sets[k]), len(mine) - 1)
                shared = int((mine[where] == self.sets[k]).sum())
                if 100 * shared >= self.percent * self.n[k]:
                    yield d, k, shared


def indexes(items: DataFrame, percent: int, width: int, id_col: str, text_col: str) -> Iterator[Broadcast]:
    """Broadcast indexes over the items, in blocks of about ``BLOCK_SHINGLES`` shingles; documents are read once for each."""
    spark = items.sparkSession
    sets = saved(
        id_and_text(items, id_col, text_col)
        .mapInArrow(item_sets(width), "item_id long, width int, n long, hashes binary")
        .where("n > 0"),
        "items",
    )
    total = sets.agg(F.sum("n")).first()[0] or 0
    n_blocks = max(1, -(-2 * total // BLOCK_SHINGLES))
    for k in range(n_blocks if total else 0):
        block = sets.where(F.pmod(F.xxhash64("hashes"), F.lit(n_blocks)) == k).collect()
        if block:
            yield spark.sparkContext.broadcast(Index(block, percent))


def contamination(
    docs: DataFrame,
    items: DataFrame,
    percent: int = PERCENT,
    width: int = WIDTH,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """``(doc_id, item_id, n_item, n_shared, containment)``: items of which a document holds enough.

    A pair comes out when ``100 * n_shared >= percent * n_item``; ``n_item`` counts the
    item's distinct ``width``-word shingles (an item of fewer words: its whole sequence,
    looked up as a run of as many words), ``n_shared`` those in the document. Null and
    empty items match nothing, null and empty documents hold nothing; repeated rows on
    either side come out as often as they come in, null ids stay null.
    """
    spark = docs.sparkSession
    rows = id_and_text(docs, id_col, text_col)
    found = None
    for index in indexes(items, percent, width, item_id_col, item_text_col):

        def search(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for ids, texts in text_batches(batches):
                i = index.value
                got = [(ids[d], i.ids[k], int(i.n[k]), n) for d, k, n in i.search(words_of(texts), width)]
                if got:
                    yield batch_of(FOUND, *map(list, zip(*got, strict=True)))

        part = rows.mapInArrow(search, "doc_id long, item_id long, n_item long, n_shared long")
        found = part if found is None else found.unionAll(part)
    if found is None:
        found = spark.createDataFrame([], "doc_id long, item_id long, n_item long, n_shared long")
    return found.withColumn("containment", F.col("n_shared") / F.col("n_item"))


def keep_clean(
    docs: DataFrame,
    items: DataFrame,
    percent: int = PERCENT,
    width: int = WIDTH,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs``, with all columns, whose text holds no item; see :func:`contamination`.

    Every row is decided by its own text, where it is: ids do not matter (they may be null
    or shared by other texts), repeated rows all stay or all go, null and empty texts stay,
    and texts are not shuffled. Without items all rows stay.
    """
    for index in indexes(items, percent, width, item_id_col, item_text_col):

        def clean(texts: list[str], index=index):
            keep, first = np.ones(len(texts), bool), 0
            for ids, some in cut_batches([t.encode() for t in texts]):
                for d, _, _ in index.value.search(words_of(some), width):
                    keep[first + d] = False
                first += len(ids)
            return keep, None

        docs = map_texts(docs, text_col, clean)
    return docs
