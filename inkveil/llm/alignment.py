"""Alignment of two tokenizers over a corpus, with a fast path for tokens both have.

Both vocabularies cut the same bytes; where tokens of both end, a group ends. Texts are
cut at single spaces and line ends between other characters: no token of either crosses
such a place, so a text's groups are those of its words in a row, and each word is
aligned once per worker while it is remembered.

An array gives for each id of A the id of B with the same bytes. Documents with such a
pair are counted in one vector as long as A's vocabulary; only other pairs are shuffled,
each once per batch of documents with the number of documents it stands in. Their counts
go back to the batches, of which each asks once for a pair however many documents hold it.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.llm.bpe import byte_characters, merger
from inkveil.llm.common import batch_of, id_and_text, packed, saved, text_batches, unpacked
from inkveil.llm.token_counts import VOCABULARY, vocabulary_path

OTHER_VOCABULARY = "piece_bpe_32k.model"
BLANK = "▁"  # stands for a space in the pieces of B
REMEMBERED, REMEMBERED_CHARACTERS = 300_000, 16_000_000
AT_ONCE = 20_000
FIRST = "\x00"  # marks a word at the start of a text
ODD = [c for c in map(chr, range(0x3001)) if c not in " \n" and (c.isspace() or re.match(r"\s", c))] + [BLANK]
_INNER = "[^ \n" + re.escape("".join(ODD)) + "]"
CUT = re.compile(f"(?<={_INNER})(?: (?={_INNER})|(?=\n{_INNER}))")


def words(text: str) -> list[str]:
    """What a text falls into. A word stands for itself behind a space; one that begins with a line end for
    itself, one that begins with ``FIRST`` for the rest of it behind a space."""
    if (
        text[0] in " \n"
        or text[-1] in " \n"
        or any(run in text for run in ("  ", " \n", "\n ", "\n\n", FIRST))
        or any(c in text for c in ODD)
    ):
        out = CUT.split(text)
        return [FIRST + w if w[0] == FIRST or (k == 0 and w[0] == "\n") else w for k, w in enumerate(out)]
    return (text.replace("\n", " \n") if "\n" in text else text).split(" ")


def piece(word: str) -> str:
    """The characters that a word stands for."""
    return word if word[0] == "\n" else " " + (word[1:] if word[0] == FIRST else word)


class Words:
    """Alignments of words, kept per worker process and forgotten together when they are too many.

    Per word: numbers of A tokens, B tokens, groups and links, its links as ``a << 16 | b``
    (``links[at[w]:at[w + 1]]``), its groups as text, and whether B gives other bytes back.
    """

    def __init__(self, path_a: str, path_b: str):
        import public_tokenizers
        import regex
        import sentencepiece

        self.merger = merger(path_a)
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte_of = {c: k for k, c in enumerate(byte_characters())}
        self.bytes_a = [bytes(byte_of.get(c, 0) for c in t) for t in self.merger.tokens]
        size = self.pieces.get_piece_size()
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.pieces.is_byte(i) else p.replace(BLANK, " ").encode()
            for i, p in enumerate(map(self.pieces.id_to_piece, range(size)))
        ]
        if max(len(self.bytes_a), size) > 1 << 16:
            raise ValueError("vocabularies of more than 65,536 ids")
        self.blank = self.pieces.piece_to_id(BLANK)
        self.length_a = np.array([len(b) for b in self.bytes_a], np.int64)
        self.length_b = np.array([len(b) for b in self.bytes_b], np.int64)
        # Of ids of B with the same bytes the one that is no byte token.
        by_bytes = {self.bytes_b[i]: i for i in sorted(range(size), key=lambda i: (not self.pieces.is_byte(i), -i))}
        self.same = np.array([by_bytes.get(b, -1) for b in self.bytes_a], np.int64)
        # An id with what stands behind it: inside A's part of a group, at its end, and the same for B.
        self.signs = [b"%d%s" % (i, end) for n, ends in ((len(self.bytes_a), (b",", b"|")), (size, (b",", b";"))) for end in ends for i in range(n)]
        self.sizes = (len(self.bytes_a), size)
        self.forget()

    def forget(self) -> None:
        self.of: dict[str, int] = {}
        self.characters = 0
        self.n_a = self.n_b = self.n_groups = self.n_links = np.zeros(0, np.int64)
        self.bad = np.zeros(0, bool)
        self.links, self.at = np.zeros(0, np.int64), np.zeros(1, np.int64)
        self.text: list[bytes] = []

    def learn(self, needed: set[str]) -> None:
        if len(self.of) > REMEMBERED or self.characters > REMEMBERED_CHARACTERS:
            self.forget()
        new = [w for w in needed if w not in self.of]
        made = [self._align(new[k : k + AT_ONCE]) for k in range(0, len(new), AT_ONCE)]
        if not made:
            return
        self.of.update(zip(new, range(len(self.text), len(self.text) + len(new)), strict=True))
        self.characters += sum(map(len, new))
        for k, name in enumerate(("n_a", "n_b", "n_groups", "n_links", "bad", "links")):
            setattr(self, name, np.concatenate([getattr(self, name), *[m[k] for m in made]]))
        for m in made:
            self.text += m[6]
        self.at = np.concatenate([[0], np.cumsum(self.n_links)])

    def _ids_a(self, pieces: list[str], plain: list[bool]) -> tuple[np.ndarray, np.ndarray]:
        cut = [[p] if whole else self.split(p) for p, whole in zip(pieces, plain, strict=True)]
        ids, counts = self.merger.encode([t.encode() for some in cut for t in some])
        starts = np.cumsum([0, *map(len, cut)])[:-1]
        return ids.astype(np.int64), np.add.reduceat(counts, starts)

    def _ids_b(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # The library puts a space before each text; a word without one loses it again.
        texts = [w[1:] if w[0] == FIRST else w for w in new]
        ids = [x[1:] if w[0] == "\n" else x for w, x in zip(new, self.pieces.encode(texts, num_threads=1), strict=True)]
        return np.array(list(itertools.chain.from_iterable(ids)), np.int64), np.array([len(x) for x in ids], np.int64)

    def _align(self, new: list[str]) -> tuple:
        pieces = [piece(w) for w in new]
        whole = [p.encode() for p in pieces]
        a, n_a = self._ids_a(pieces, [w.isalpha() for w in new])
        b, n_b = self._ids_b(new)
        ends = np.cumsum(n_b)
        bad = np.array([
            b"".join(map(self.bytes_b.__getitem__, b[e - n : e].tolist())) != text
            for e, n, text in zip(ends.tolist(), n_b.tolist(), whole, strict=True)
        ], bool)
        # Words that B gives back in other bytes have no tokens here.
        a, b = a[np.repeat(~bad, n_a)], b[np.repeat(~bad, n_b)]
        n_a, n_b = np.where(bad, 0, n_a), np.where(bad, 0, n_b)
        size = np.where(bad, 0, [len(t) for t in whole])
        total = int(size.sum())
        end_a, end_b = np.cumsum(self.length_a[a]) - 1, np.cumsum(self.length_b[b]) - 1
        marks_a, marks_b = np.zeros(total, bool), np.zeros(total, bool)
        marks_a[end_a], marks_b[end_b] = True, True
        both = marks_a & marks_b
        word_end = np.cumsum(size)

        def per_word(marks: np.ndarray) -> np.ndarray:
            return np.diff(np.concatenate([[0], np.cumsum(marks)])[np.concatenate([[0], word_end])])

        # A link is a stretch of bytes within one token of each, so it ends where either ends.
        stops = np.flatnonzero(marks_a | marks_b)
        links = a[np.searchsorted(end_a, stops)] << 16 | b[np.searchsorted(end_b, stops)]
        # Groups in order: each one's tokens of A, then those of B.
        groups = np.flatnonzero(both)
        of_a, of_b = np.searchsorted(groups, end_a), np.searchsorted(groups, end_b)
        in_a, in_b = np.bincount(of_a, minlength=len(groups)), np.bincount(of_b, minlength=len(groups))
        signs = np.zeros(len(a) + len(b), np.int64)
        kinds_a, kinds_b = self.sizes
        signs[np.arange(len(a)) + (np.cumsum(in_b) - in_b)[of_a]] = a + kinds_a * both[end_a]
        signs[np.arange(len(b)) + np.cumsum(in_a)[of_b]] = 2 * kinds_a + b + kinds_b * both[end_b]
        written = list(map(self.signs.__getitem__, signs.tolist()))
        cut = np.concatenate([[0], np.cumsum(n_a + n_b)]).tolist()
        text = [b"".join(written[s:e]) for s, e in itertools.pairwise(cut)]
        return n_a, n_b, per_word(both), per_word(marks_a | marks_b), bad, links, text


_words: dict[tuple[str, str], Words] = {}


def known_words(vocabulary: str, other: str) -> Words:
    """The worker process's words for two vocabularies."""
    paths = vocabulary_path(vocabulary), vocabulary_path(other)
    if paths not in _words:
        _words[paths] = Words(*paths)
    return _words[paths]


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``starts[0], starts[0] + 1, ...``: ``counts[k]`` numbers from each ``starts[k]``."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def _by_document(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of ``values``, of which ``counts[k]`` belong to document ``k``."""
    sums = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(counts)
    return sums[ends] - sums[ends - counts]


def _texts(known: Words, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """``(words, number of words of each text)``; texts that B gives back in other bytes have none."""
    cut = [words(t.decode()) if t else [] for t in texts]
    known.learn(set(itertools.chain.from_iterable(cut)))
    of = known.of.__getitem__
    n = np.array([len(c) for c in cut], np.int64)
    w = np.fromiter(map(of, itertools.chain.from_iterable(cut)), np.int64, int(n.sum()))
    good = _by_document(known.bad[w], n) == 0
    return w[np.repeat(good, n)], np.where(good, n, 0)


def _written(known: Words, w: np.ndarray, n: np.ndarray) -> Iterator[bytes]:
    """The groups of each text."""
    text, ends = list(map(known.text.__getitem__, w.tolist())), np.cumsum(n).tolist()
    for e, k in zip(ends, n.tolist(), strict=True):
        yield b"".join(text[e - k : e])[:-1]


NUMBERS = ("n_a", "n_b", "n_groups", "n_links")
ENCODED = pa.schema(
    [
        ("batch", pa.int64()),  # null: what a task counted of pairs with the same bytes
        ("keys", pa.list_(pa.int64())),  # pairs of the batch, or ids of A
        ("held", pa.list_(pa.int64())),  # how many documents hold each
        ("doc_id", pa.list_(pa.int64())),
        *[(c, pa.list_(pa.int64())) for c in NUMBERS],
        ("groups_sha256", pa.list_(pa.string())),
        ("n_pairs", pa.binary()),  # distinct pairs of each document
        ("pairs", pa.binary()),  # them, as places in keys; behind these in same
        ("times", pa.binary()),  # and how often the document holds each
        ("same", pa.binary()),  # ids of A whose pair has the same bytes
    ]
)
ENCODED_COLUMNS = (
    "batch long, keys array<long>, held array<long>, doc_id array<long>, "
    + "".join(f"{c} array<long>, " for c in NUMBERS)
    + "groups_sha256 array<string>, n_pairs binary, pairs binary, times binary, same binary"
)
RESULT = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in (*NUMBERS, "n_best", "count_sum")], ("groups_sha256", pa.string())])
RESULT_COLUMNS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _encode(docs: DataFrame, vocabulary: str, other: str) -> DataFrame:
    """One row per batch of documents, and one per task that counts the pairs with the same bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = known_words(vocabulary, other)
        counted = np.zeros(len(known.same), np.int64)
        number = TaskContext.get().partitionId() << 32
        for ids, texts in text_batches(batches):
            w, n = _texts(known, texts)
            doc = np.repeat(np.arange(len(n)), n)
            shas = [hashlib.sha256(g).hexdigest() if g else "" for g in _written(known, w, n)]
            numbers = [_by_document(getattr(known, c)[w], n) for c in NUMBERS]
            # Words of each document with how often it has them, then their links.
            seen, often = np.unique(doc << 32 | w, return_counts=True)
            doc, w = seen >> 32, seen & 0xFFFFFFFF
            count = known.n_links[w]
            links = np.repeat(doc << 32, count) | known.links[_ranges(known.at[w], count)]
            order = np.argsort(links, kind="stable")
            links, often = links[order], np.repeat(often, count)[order]
            first = np.flatnonzero(np.diff(links, prepend=-1))
            times = np.add.reduceat(often, first) if len(first) else often
            doc, pair = links[first] >> 32, links[first] & 0xFFFFFFFF
            pairs, place, held = np.unique(pair, return_inverse=True, return_counts=True)
            alike = known.same[pairs >> 16] == pairs & 0xFFFF
            counted[pairs[alike] >> 16] += held[alike]
            to = np.where(alike, (~alike).sum() + np.cumsum(alike) - 1, np.cumsum(~alike) - 1)
            yield batch_of(
                ENCODED, [number], [pairs[~alike]], [held[~alike]], [ids], *[[x] for x in numbers], [shas],
                [packed(np.bincount(doc, minlength=len(n)))], [packed(to[place])], [packed(times)], [packed(pairs[alike] >> 16)],
            )
            number += 1
        some = np.flatnonzero(counted)
        yield batch_of(ENCODED, [None], [some], [counted[some]], *[[None]] * (len(ENCODED) - 3))

    return id_and_text(docs).mapInArrow(run, ENCODED_COLUMNS)


def _counted(encoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(pair, n)`` of pairs with other bytes, and ``(a, n)`` of those with the same."""

    def counts(rows: DataFrame, name: str) -> DataFrame:
        each = rows.select(F.explode(F.arrays_zip("keys", "held")).alias("x"))
        return each.groupBy(F.col("x.keys").alias(name)).agg(F.sum("x.held").alias("n"))

    return counts(encoded.where("batch is not null"), "pair"), counts(encoded.where("batch is null"), "a")


def pair_counts(docs: DataFrame, vocabulary: str = VOCABULARY, other: str = OTHER_VOCABULARY) -> DataFrame:
    """``(a, b, n_docs)``: ids of both vocabularies whose tokens overlap somewhere, and in how many documents."""
    pairs, same = _counted(saved(_encode(docs, vocabulary, other), "encoded"))
    known = known_words(vocabulary, other)
    partner = docs.sparkSession.createDataFrame([(k, int(b)) for k, b in enumerate(known.same) if b >= 0], "a long, b long")
    split = pairs.select(F.shiftright("pair", 16).alias("a"), F.col("pair").bitwiseAND(0xFFFF).alias("b"), F.col("n").alias("n_docs"))
    return split.unionAll(same.join(F.broadcast(partner), "a").select("a", "b", F.col("n").alias("n_docs")))


def token_groups(docs: DataFrame, vocabulary: str = VOCABULARY, other: str = OTHER_VOCABULARY) -> DataFrame:
    """``(doc_id, groups)``: each document's groups as ``a1,a2|b1;a3|b2,b3``, empty without tokens."""
    schema = pa.schema([("doc_id", pa.int64()), ("groups", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = known_words(vocabulary, other)
        for ids, texts in text_batches(batches):
            yield batch_of(schema, ids, [g.decode() for g in _written(known, *_texts(known, texts))])

    return id_and_text(docs).mapInArrow(run, "doc_id long, groups string")


def align_tokenizers(docs: DataFrame, vocabulary: str = VOCABULARY, other: str = OTHER_VOCABULARY) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)``, one row per input row.

    Tokens are those of a space and the text, by A (a byte-level vocabulary, special strings
    being plain text) and by B (a piece vocabulary, which adds the space itself). Null and
    empty texts, and those that B gives back in other bytes, have no tokens: zeros and an
    empty ``groups_sha256``. Null ids stay null; repeated rows count and come out as often as
    they come in; other columns are ignored.
    """
    spark = docs.sparkSession
    encoded = saved(_encode(docs, vocabulary, other), "encoded")
    pairs, same = _counted(encoded)
    pairs = saved(pairs, "pairs")
    size = len(known_words(vocabulary, other).same)
    of_same, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
    # Both tables have a row per id of A at most.
    for a, n in same.collect():
        of_same[a] = best[a] = n
    for a, n in pairs.groupBy(F.shiftright("pair", 16).alias("a")).agg(F.max("n")).collect():
        best[a] = max(best[a], n)
    vectors = spark.sparkContext.broadcast((of_same, best))
    batches = encoded.where("batch is not null")
    asked = batches.select("batch", F.posexplode("keys").alias("place", "pair"))
    told = asked.join(pairs, "pair").groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("place", "n"))).alias("told"))
    told = told.select("batch", F.col("told.n").alias("counts"))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_same, best = vectors.value
        for row in (r for batch in rows for r in batch.to_pylist()):
            n, pair, times, alike = (unpacked(row[c]) for c in ("n_pairs", "pairs", "times", "same"))
            count = np.concatenate([np.array(row["counts"] or [], np.int64), of_same[alike]])
            a = np.concatenate([np.array(row["keys"], np.int64) >> 16, alike])
            yield batch_of(
                RESULT, row["doc_id"], *[row[c] for c in NUMBERS], _by_document(times * (count == best[a])[pair], n),
                _by_document(times * count[pair], n), row["groups_sha256"],
            )

    return batches.drop("held").join(told, "batch", "left").mapInArrow(run, RESULT_COLUMNS)
