"""Packing token ids into sequences of near-equal length by Karmarkar-Karp differencing.

Each task packs its own documents: no shuffle. What a document has beyond whole
sequences is cut into pieces, pieces are held until they fill about ``WINDOWS``
sequences, and the batch is divided into that many windows by multiway differencing;
when a window comes out above the capacity, the batch is divided into one more. Every
``FINE``-th document is cut into halves of halves, as differencing needs small pieces to
level the windows, and a batch ends ``SLACK`` ids a window short of full.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from inkveil.llm.common import batch_of, id_and_text, text_batches
from inkveil.llm.pieces import ENCODE_BYTES, encoder
from inkveil.llm.token_counts import VOCABULARY, vocabulary_path

CAPACITY = 2048
END = 1
WINDOWS = 128
PIECE = 1024
FINE, SMALLEST = 4, 8
SLACK = 4
SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
        ("ids", pa.binary()),
    ]
)
COLUMNS = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Divide items into ``k`` groups of near-equal total: indices of ``sizes`` by group.

    Every item begins as a partial partition with one filled group. The two partitions
    with the largest imbalance (largest less smallest group) are merged, the largest
    groups of one with the smallest of the other, until one partition is left.
    """
    if not sizes:
        return [[] for _ in range(k)]
    heap = []
    for i, size in enumerate(sizes):
        totals = np.zeros(k, np.int64)
        totals[0] = size
        heap.append((-size, i, totals))
    heapq.heapify(heap)
    # A merge is remembered by the two partitions and the order of its groups.
    merges = []
    for age in range(len(sizes), 2 * len(sizes) - 1):
        _, a, totals_a = heapq.heappop(heap)
        _, b, totals_b = heapq.heappop(heap)
        totals = totals_a + totals_b[::-1]  # both descend
        order = np.argsort(-totals, kind="stable")
        totals = totals[order]
        merges.append((a, b, order))
        heapq.heappush(heap, (int(totals[-1] - totals[0]), age, totals - totals[-1]))
    # From the last merge back: which group of the whole each group of a partition ends up in.
    ends_in = {heap[0][1]: np.arange(k)}
    for age in range(2 * len(sizes) - 2, len(sizes) - 1, -1):
        a, b, order = merges.pop()
        of_a = np.empty(k, np.int64)
        of_a[order] = ends_in.pop(age)
        ends_in[a], ends_in[b] = of_a, of_a[::-1]
    groups: list[list[int]] = [[] for _ in range(k)]
    for i in range(len(sizes)):
        groups[ends_in[i][0]].append(i)
    return groups


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Near-equal groups of at most ``capacity``: as few as the total needs, more if one exceeds it.

    No single item may exceed the capacity; with as many groups as items all fit.
    """
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        groups = differencing(sizes, k)
        if all(sum(sizes[i] for i in g) <= capacity for g in groups):
            return [g for g in groups if g]
        k += 1


def pieces(rest: int, largest: int, fine: bool) -> list[int]:
    """Lengths that ``rest`` ids are cut into: equal ones, or each half of what is left."""
    if not fine:
        n = -(-rest // largest)
        return [rest // n + (k < rest % n) for k in range(n)]
    out = []
    while rest > SMALLEST:
        out.append(min(largest, -(-rest // 2)))
        rest -= out[-1]
    return out + [rest] * (rest > 0)


def pack(
    docs: DataFrame,
    vocabulary: str = VOCABULARY,
    capacity: int = CAPACITY,
    end: int = END,
    piece: int = PIECE,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces of documents in sequences of at most ``capacity`` token ids.

    A document's ids are those of its whole text and ``end``. Returns ``(doc_id, start,
    length, doc_tokens, sequence_id, offset, ids)``: ``start`` counts the document's ids
    before the piece, ``offset`` the sequence's ids before it, ``ids`` are little-endian
    unsigned 32-bit integers. Each id lies in exactly one piece. Null and empty texts
    give one piece with ``end`` alone; repeated rows are packed as often as they come.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary_path(vocabulary))
        stop = np.array([end], "<u4").tobytes()
        sequence = TaskContext.get().partitionId() << 40
        held: list[tuple] = []  # doc_id, start, doc_tokens, ids
        held_tokens = documents = 0
        out: list[tuple] = []

        def close() -> None:
            nonlocal sequence, held, held_tokens
            for group in windows([len(h[3]) // 4 for h in held], capacity):
                offset = 0
                for i in group:
                    doc, start, total, ids = held[i]
                    out.append((doc, start, len(ids) // 4, total, sequence, offset, ids))
                    offset += len(ids) // 4
                sequence += 1
            held, held_tokens = [], 0

        def flush() -> pa.RecordBatch:
            made = batch_of(SCHEMA, *map(list, zip(*out, strict=True)))
            out.clear()
            return made

        for docs_of, texts in text_batches(batches, ENCODE_BYTES):
            for doc, ids in zip(docs_of, encode(texts), strict=True):
                ids += stop
                total = len(ids) // 4
                whole = total // capacity * capacity
                for start in range(0, whole, capacity):
                    out.append((doc, start, capacity, total, sequence, 0, ids[4 * start : 4 * (start + capacity)]))
                    sequence += 1
                start = whole
                while start < total:
                    room = WINDOWS * max(1, capacity - SLACK) - held_tokens
                    for n in pieces(min(total - start, room), piece, documents % FINE == 0):
                        held.append((doc, start, total, ids[4 * start : 4 * (start + n)]))
                        held_tokens += n
                        start += n
                    if held_tokens == WINDOWS * max(1, capacity - SLACK):
                        close()
                documents += 1
            if out:
                yield flush()
        close()
        if out:
            yield flush()

    return id_and_text(docs, id_col, text_col).mapInArrow(run, COLUMNS)
