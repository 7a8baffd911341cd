"""Documents of similar word shingles, by a parity-sketch join.

1. *Sketch.* A document's distinct shingles are hashed to ``K`` words; a word is the XOR of
   the 64-bit hashes of its shingles, so each bit is a parity. A shingle in one set only
   changes one word, so the number of words in which two sketches differ (their Hamming
   distance by words) is at most ``|A xor B|``. A similarity of ``t`` allows ``|A xor B| <= (1 - t) / (1 + t) * (|A| + |B|)``: any
   two similar documents have all words but ``d`` in common (pigeonhole). ``K`` is fixed
   per size band (sizes ``2**b .. 2**(b+1) - 1``); a document that may have a partner in
   the band below is sketched for that band too.
2. *Prefix.* Two documents that share all elements ``(word number, value)`` but ``d`` share
   one among the first ``d + 1`` of each in any common order. Elements are counted over
   the whole corpus and ordered by how many sets have them, so what many documents share
   (a common passage) comes last and is not used unless a set has little else.
3. *Candidates.* Sets with a kept element in common form blocks (connected components).
4. *Verify.* Each block is searched exactly, from set to set, until no unvisited set is
   similar to a visited one. Large blocks are dealt out as pairs of parts.

Elements travel in arrays: one row holds what a batch of documents has for one bucket.
Documents of equal sets are one set from the first step on. No step drops a link: the
result is exact but for collisions of 48-bit shingle hashes within a pair of documents
and of 63-bit hashes between whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import batch_of, id_and_text, mix, packed, saved, text_batches, unpacked, without_ids
from inkveil.llm.components import components, local_components
from inkveil.llm.words import shingle_sets, words_of

PERCENT = 75
BUCKET_BYTES = 32 << 20
# Of a block in one task; of a larger block, in each of the two parts a task gets.
PART_SETS, PART_SHINGLES = 4096, 1 << 20

U8, I8 = np.uint64, np.int64
FILTER_BITS = 1 << 26  # of a filter of fixed size, 8 MB
ROWS = pa.schema([("bucket", pa.int32()), ("heads", pa.binary()), ("items", pa.binary()), ("docs", pa.binary())])
ROWS_DDL = "bucket int, heads binary, items binary, docs binary"
DOC = np.dtype([("doc_id", "<i8"), ("known", "<i8"), ("set", "<u8"), ("n", "<i8")])


def partner(n: np.ndarray, percent: int) -> np.ndarray:
    """The largest size similar to ``n``."""
    return 100 * n // percent


def differing(total: np.ndarray, percent: int) -> np.ndarray:
    """The most that two similar sets of ``total`` elements together may differ by."""
    return (100 - percent) * total // (100 + percent)


def set_ids(doc: np.ndarray, h: np.ndarray, n_docs: int) -> np.ndarray:
    """A hash of each whole set, even."""
    sums = np.concatenate((np.zeros(1, U8), np.cumsum(mix(h))))
    ends = np.searchsorted(doc, np.arange(n_docs + 1))
    return mix(sums[ends[1:]] - sums[ends[:-1]]) & U8(0xFFFFFFFFFFFFFFFE)


def elements(doc: np.ndarray, h: np.ndarray, n: np.ndarray, percent: int):
    """Sketch elements: ``(emission, key)``, and for each emission its document, whether in the
    band below its own, and how many of its elements may be spared."""
    band = np.frexp(n.astype(float))[1] - 1
    low = 1 << np.maximum(band, 0)
    below = np.flatnonzero((n > 0) & (band > 0) & (n <= partner(low - 1, percent)))
    own = np.flatnonzero(n > 0)
    of = np.concatenate((own, below))
    lower = np.concatenate((np.zeros(len(own), bool), np.ones(len(below), bool)))
    base = np.where(lower, band[of] - 1, band[of])
    words = (12 * (1 << base)) // 10 + 2
    most = np.where(lower, differing(n[of] + low[of] - 1, percent), differing(n[of] + partner(n[of], percent), percent))
    # Shingles of each emission.
    first, size = np.searchsorted(doc, of), n[of]
    em = np.repeat(np.arange(len(of)), size)
    at = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
    x = mix(h[at])
    offset = np.concatenate(([0], np.cumsum(words)))
    word = ((x >> U8(32)) * words[em].astype(U8) >> U8(32)).astype(I8) + offset[em]
    order = np.argsort(word)
    word = word[order]
    starts = np.flatnonzero(np.diff(word, prepend=-1))
    value = np.zeros(offset[-1], U8)
    if len(starts):
        value[word[starts]] = np.bitwise_xor.reduceat(mix(x[order]), starts)
    em = np.repeat(np.arange(len(of)), words)
    filled = np.bincount(em[value != 0], minlength=len(of))
    # Words without a shingle are alike everywhere; they count only where the others do not suffice.
    scarce = filled < most + 1
    used = (value != 0) | scarce[em]
    spare = np.where(scarce, 0, filled - most - 1)
    number = (np.arange(len(em)) - offset[em])[used].astype(U8)
    key = mix(value[used] ^ mix(number | base[em[used]].astype(U8) << U8(40)))
    return em[used], key, of, lower, spare


def sections(*parts) -> bytes:
    """Arrays or bytes in one value, their lengths first."""
    parts = [p if isinstance(p, bytes) else p.tobytes() for p in parts]
    return np.array([len(parts), *map(len, parts)], "<u4").tobytes() + b"".join(parts)


def sections_of(data: bytes) -> list[bytes]:
    n = int(np.frombuffer(data, "<u4", 1)[0])
    ends = 4 + 4 * n + np.cumsum([0, *np.frombuffer(data, "<u4", n, 4).tolist()])
    return [data[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def runs(of: np.ndarray, order: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each value of ``of`` that occurs, with its places; ``order`` sorts ``of``. The work does not
    depend on how many values there could be."""
    if len(order):
        sorted_ = of[order]
        starts = np.concatenate(([0], np.flatnonzero(sorted_[1:] != sorted_[:-1]) + 1))
        yield from zip(sorted_[starts].tolist(), np.split(order, starts[1:]), strict=True)


def sketch(n_buckets: int, percent: int, width: int):
    """Rows of elements by bucket, and rows of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_batches(batches, 3 << 20):
            doc, h = shingle_sets(words_of(texts), width)
            n = np.bincount(doc, minlength=len(ids))
            sets = set_ids(doc, h, len(ids))
            docs = np.zeros(len(ids), DOC)
            docs["doc_id"] = [0 if i is None else i for i in ids]
            docs["known"] = [i is not None for i in ids]
            docs["set"], docs["n"] = sets, n
            # One document of each set in the batch stands for it.
            stands = np.zeros(len(ids), bool)
            known = np.flatnonzero(docs["known"])
            stands[known[np.unique(sets[known], return_index=True)[1]]] = True
            kept = stands[doc]
            em, key, of, lower, spare = elements(doc[kept], h[kept], np.where(stands, n, 0), percent)
            bucket = (key >> U8(33)) % U8(n_buckets)
            order = np.argsort(bucket.astype(np.uint16) if n_buckets < 65536 else bucket, kind="stable")
            rows = [(-1 - int(sets[0] % U8(n_buckets)), b"", b"", docs.tobytes())]
            for k, some in runs(bucket, order):
                # Elements stand in the order of their sets, so a set needs only say how many it has.
                mine, count = np.unique(em[some], return_counts=True)
                heads = sections(sets[of[mine]] | lower[mine].astype(U8), packed(spare[mine]), packed(count))
                rows.append((k, heads, (key[some] & U8(0xFFFFFFFF)).astype("<u4").tobytes(), None))
            yield batch_of(ROWS, *map(list, zip(*rows, strict=True)))

    return run


def counted(n_buckets: int):
    """For each element of at least two sets: how many sets have it; rows by set."""

    def run(t: pa.Table) -> pa.Table:
        bucket = t["bucket"][0].as_py()
        if bucket < 0:
            return t
        set_of, spare, keys, heads, base = [], [], [], [], 0
        for a, b in zip(t["heads"].to_pylist(), t["items"].to_pylist(), strict=True):
            ids, spared, count = sections_of(a)
            set_of.append(np.frombuffer(ids, "<u8"))
            spare.append(unpacked(spared))
            keys.append(np.frombuffer(b, "<u4"))
            heads.append(np.repeat(np.arange(base, base + len(set_of[-1])), unpacked(count)))
            base += len(set_of[-1])
        set_of, spare, key, head = map(np.concatenate, (set_of, spare, keys, heads))
        order = np.argsort(key)
        key, head = key[order], head[order]
        same = key[1:] == key[:-1]
        shared = np.concatenate((same, [False])) | np.concatenate(([False], same))
        key, head = key[shared], head[shared]
        # Equal sets of several batches count once.
        order = np.lexsort((set_of[head], key))
        key, head = key[order], head[order]
        sets = set_of[head]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (sets[1:] != sets[:-1])
        key, head = key[new], head[new]
        starts = np.flatnonzero(np.diff(key.astype(I8), prepend=-1))
        size = np.repeat(np.diff(starts, append=len(key)), np.diff(starts, append=len(key)))
        key, head, size = key[size > 1], head[size > 1], size[size > 1]
        to = (mix(set_of[head]) >> U8(20)) % U8(n_buckets)
        order = np.lexsort((set_of[head], to))
        rows = []
        for k, some in runs(to, order):
            mine, first, count = np.unique(set_of[head[some]], return_index=True, return_counts=True)
            row = sections(mine, packed(spare[head[some[first]]]), packed(count), packed(np.array([bucket])))
            rows.append((k, row, sections(key[some], packed(size[some])), None))
        return pa.Table.from_batches([batch_of(ROWS, *map(list, zip(*rows, strict=True)))] if rows else [], ROWS)

    return run


def kept(t: pa.Table) -> pa.Table:
    """The elements that stay of each set when its most common ones are spared; rows by the keys' bucket."""
    sets, spare, keys, sizes, buckets = [], [], [], [], []
    for a, b in zip(t["heads"].to_pylist(), t["items"].to_pylist(), strict=True):
        ids, spared, count, bucket = sections_of(a)
        count = unpacked(count)
        own, size = sections_of(b)
        keys.append(np.frombuffer(own, "<u4"))
        sizes.append(unpacked(size))
        sets.append(np.repeat(np.frombuffer(ids, "<u8"), count))
        spare.append(np.repeat(unpacked(spared), count))
        buckets.append(np.full(len(keys[-1]), unpacked(bucket)[0], np.int32))
    sets, spare, keys, sizes, buckets = map(np.concatenate, (sets, spare, keys, sizes, buckets))
    order = np.lexsort((keys, sizes, sets))
    sets, spare, keys, buckets = sets[order], spare[order], keys[order], buckets[order]
    starts = np.flatnonzero(np.concatenate(([True], sets[1:] != sets[:-1])))
    count = np.diff(starts, append=len(sets))
    rank = np.arange(len(sets)) - np.repeat(starts, count)
    stays = rank < np.repeat(count, count) - spare
    sets, keys, buckets = sets[stays], keys[stays], buckets[stays]
    order = np.argsort(buckets, kind="stable")
    rows = []
    for k, some in runs(buckets, order):
        mine, count = np.unique(sets[some], return_counts=True)
        rows.append((k, sections(mine, packed(count)), keys[some].tobytes(), None))
    return pa.Table.from_batches([batch_of(ROWS, *map(list, zip(*rows, strict=True)))] if rows else [], ROWS)


EDGES = pa.schema([("edges", pa.binary())])


def edge_row(a: np.ndarray, b: np.ndarray) -> pa.Table:
    return pa.table({"edges": pa.array([np.stack((a, b), 1).astype("<i8").tobytes()], pa.binary())}, EDGES)


def linked(t: pa.Table) -> pa.Table:
    """Sets that share a kept element, as stars of this bucket's components."""
    sets, keys = [], []
    for a, b in zip(t["heads"].to_pylist(), t["items"].to_pylist(), strict=True):
        own, count = sections_of(a)
        keys.append(np.frombuffer(b, "<u4"))
        sets.append(np.repeat(np.frombuffer(own, "<u8"), unpacked(count)) & U8(0xFFFFFFFFFFFFFFFE))
    sets, keys = np.concatenate(sets), np.concatenate(keys)
    sets = sets.view(I8)
    order = np.argsort(keys, kind="stable")
    keys, sets = keys[order], sets[order]
    next_ = np.flatnonzero((keys[1:] == keys[:-1]) & (sets[1:] != sets[:-1]))
    nodes, roots = local_components(sets[next_], sets[next_ + 1])
    return edge_row(nodes, roots)


MEMBER = pa.schema([("set", pa.int64()), ("shingles", pa.binary())])


def filter_of(ids: DataFrame) -> np.ndarray:
    """Bits set for the ids of a table. Its size is fixed: with very many ids more bits are set and more
    documents pass, to be sorted out by a join; none is missed."""
    words = (
        ids.select(F.pmod(F.xxhash64(ids.columns[0]), F.lit(FILTER_BITS)).alias("place"))
        .select(F.shiftright("place", 6).alias("word"), F.expr("shiftleft(1L, cast(place & 63 as int))").alias("bit"))
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bits"))
        .toArrow()
    )
    bits = np.zeros(FILTER_BITS // 64, I8)
    bits[words["word"].to_numpy()] = words["bits"].to_numpy()
    return bits


def block_sets(width: int, wanted):
    """Shingles of the documents whose ids pass the filter (third column: the id's place in it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = wanted.value

        def passing() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                place = batch.column(2).to_numpy()
                yield batch.filter(pa.array((bits[place >> 6] >> (place & 63) & 1).astype(bool)))

        for _, texts in text_batches(passing()):
            doc, h = shingle_sets(words_of(texts), width)
            sets = set_ids(doc, h, len(texts)).view(I8)
            ends = np.searchsorted(doc, np.arange(len(texts) + 1)).tolist()
            yield batch_of(MEMBER, sets, [h[a:b].astype("<u8").tobytes() for a, b in zip(ends, ends[1:], strict=False)])

    return run


def search(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set the index of the first visited one in its component.

    Every set is compared with all that are not visited when its turn comes; those it
    is similar to join its component and are next. So no link between components is missed.
    """
    size = np.array([len(s) for s in sets])
    values, at, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    ends = np.concatenate(([0], np.cumsum(size)))
    root = np.full(len(sets), -1)
    flag = np.zeros(len(values), np.int32)
    # Sets with most in common come first, so that most are visited soon.
    left = np.argsort(-np.add.reduceat(often[at], ends[:-1]) / size, kind="stable")
    flat = bounds = None
    seed, queue = 0, []
    while True:
        while not queue and seed < len(left):
            if root[left[seed]] < 0:
                root[left[seed]] = left[seed]
                queue = [int(left[seed])]
            seed += 1
        if not queue:
            return root
        open_ = root[left] < 0
        if flat is None or open_.sum() * 4 < len(left) * 3:
            left, seed = left[open_], 0
            if not len(left):
                return root
            flat = np.concatenate([at[ends[i] : ends[i + 1]] for i in left.tolist()])
            bounds = np.cumsum(size[left]) - size[left]
        probe = queue.pop()
        mine = at[ends[probe] : ends[probe + 1]]
        flag[mine] = 1
        both = np.add.reduceat(flag[flat], bounds)
        flag[mine] = 0
        near = 100 * both >= percent * (size[left] + size[probe] - both)
        found = left[near & (root[left] < 0)]
        root[found] = root[probe]
        queue += found.tolist()


def verified(percent: int):
    def run(t: pa.Table) -> pa.Table:
        block = t["block"].to_numpy()
        part = t["part"].to_numpy()
        ids = t["set"].to_numpy()
        shingles = t["shingles"].to_pylist()
        order = np.lexsort((ids, part, block))
        b, p = block[order], part[order]
        starts = np.flatnonzero(np.concatenate(([True], (b[1:] != b[:-1]) | (p[1:] != p[:-1]))))
        nodes, roots = [], []
        for some in np.split(order, starts[1:]):
            # A set may come from several documents.
            some = some[np.concatenate(([True], ids[some][1:] != ids[some][:-1]))]
            if len(some) > 1:
                root = search([np.frombuffer(shingles[i], "<u8") for i in some.tolist()], percent)
                nodes.append(ids[some])
                roots.append(ids[some][root])
        got = [np.concatenate(x) if x else np.zeros(0, I8) for x in (nodes, roots)]
        return edge_row(*got)

    return run


def doc_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("set", pa.int64()), ("n", pa.int64())])
    for batch in batches:
        for blob in batch.column(0).to_pylist():
            d = np.frombuffer(blob, DOC)
            ids = pa.array(d["doc_id"].copy(), mask=d["known"] == 0)
            yield batch_of(schema, ids, d["set"].view(I8).copy(), d["n"].copy())


def ngram_components(
    docs: DataFrame, percent: int = PERCENT, width: int = 5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``, one row per input row.

    Documents link when ``100 * |A and B| >= percent * |A or B|`` over their sets of
    distinct ``width``-word shingles (fewer words: the whole sequence as one shingle);
    ``component_id`` is the smallest ``doc_id`` reachable by links, its own included.
    Null and empty texts have no shingles and link with nothing, nor do rows of a null
    ``doc_id``, whose ``component_id`` is null. Repeated rows come out as often as they
    come in; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = id_and_text(docs, id_col, text_col)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    step = saved(
        rows.mapInArrow(sketch(n_buckets, percent, width), ROWS_DDL)
        .groupBy("bucket")
        .applyInArrow(counted(n_buckets), ROWS_DDL),
        "ngram-counted",
    )
    of_doc = saved(
        step.where("docs is not null").select("docs").mapInArrow(doc_rows, "doc_id long, set long, n long"), "ngram-docs"
    )
    edges = (
        step.where("docs is null")
        .groupBy("bucket")
        .applyInArrow(kept, ROWS_DDL)
        .groupBy("bucket")
        .applyInArrow(linked, "edges binary")
    )
    blocks = components(edges, "ngram-blocks")
    # One document stands for each set of a block.
    known = of_doc.where("n > 0 and doc_id is not null")
    smallest = known.groupBy("set").agg(F.min("doc_id").alias("smallest"), F.first("n").alias("n"))
    blocks = blocks.select(F.col("node").alias("set"), F.col("root").alias("block"))
    members = saved(smallest.withColumnRenamed("smallest", "doc_id").join(blocks, "set"), "ngram-members")
    sizes = members.groupBy("block").agg(
        F.ceil(F.greatest(F.count("*") / PART_SETS, F.sum("n") / PART_SHINGLES)).alias("parts")
    )
    members = members.join(sizes, "block").select(
        "doc_id", "set", "block", "parts", F.pmod(F.xxhash64("set"), "parts").alias("chunk")
    )
    # A block of k > 1 parts is searched as pairs of parts; each part meets every other one.
    pairs = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("parts") - 1),
        lambda k: F.least(k, F.col("chunk")) * F.col("parts") + F.greatest(k, F.col("chunk")),
    )
    wanted = spark.sparkContext.broadcast(filter_of(members.select("doc_id")))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    sets = rows.where("doc_id is not null").select("doc_id", "text", place.alias("place"))
    sets = sets.mapInArrow(block_sets(width, wanted), "set long, shingles binary")
    sets = sets.join(members, "set").select(F.explode(pairs).alias("part"), "block", "set", "shingles")
    found = (
        sets.withColumn("bucket", F.pmod(F.xxhash64("block", "part"), F.lit(n_buckets)))
        .groupBy("bucket")
        .applyInArrow(verified(percent), "edges binary")
    )
    comps = components(found, "ngram-found").select(F.col("node").alias("set"), "root")
    in_comp = saved(smallest.join(comps, "set"), "ngram-smallest")
    least = in_comp.groupBy("root").agg(F.min("smallest").alias("component"))
    of_set = in_comp.join(least, "root").select("set", "component")
    of_set = smallest.join(of_set, "set", "left").select("set", F.coalesce("component", "smallest").alias("component"))
    # Written, so that the join with documents is a plain one, in which a set of many copies can be split.
    of_set = saved(of_set, "ngram-sets")
    return of_doc.join(of_set, "set", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))).alias(
            "component_id"
        ),
    )


def keep_one(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    percent: int = PERCENT,
    row: Column | None = None,
) -> DataFrame:
    """The rows of ``docs``, with all columns, one of each group of similar texts: that of the smallest id.

    Rows are told apart by ``row``, a non-negative number that is theirs in every run; without one the
    rows are written down with a number. So two texts under one id are two documents, and rows
    of a null id count like others (of a group they stay only if it has no id). Repeated rows
    are a group. Null and empty texts are in no group: all stay. Texts are shuffled only
    where a row may have to go.
    """
    if row is None:
        numbered = saved(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    else:
        numbered = docs.withColumn("__row", row)
    found = ngram_components(numbered.select(F.col("__row").alias("doc_id"), F.col(text_col).alias("text")), width=width, percent=percent)
    groups = found.where("n_shingles > 0").select(F.col("doc_id").alias("row"), F.col("component_id").alias("group"))
    groups = saved(groups, "groups")
    many = groups.groupBy("group").agg(F.count("*").alias("n")).where("n > 1").select("group")
    # Only rows of groups of several are looked at again.
    of_row = numbered.select(F.col("__row").alias("row"), F.col(id_col).alias("id"))
    members = saved(groups.join(many, "group").join(of_row, "row"), "members")
    first = members.groupBy("group").agg(F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "row")).alias("first"))
    gone = members.select("row").join(first.select(F.col("first.row").alias("row")), "row", "left_anti")
    return without_ids(numbered, saved(gone, "gone"), "__row").select(docs.columns)
