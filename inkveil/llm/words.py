"""Words and word shingles of many texts at once, as arrays of 64-bit hashes.

A word is a run of bytes other than space and ``\\x09-\\x0D``; A-Z count as a-z.
The hash of a word is a polynomial over its bytes modulo 2**64, read off a running
sum, then mixed; a shingle's hash is a polynomial over its words' hashes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from inkveil.llm.common import mix

Q = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
Q_INVERSE = pow(Q, -1, 1 << 64)
BLOCK = 1 << 20
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base**0 .. base**(n-1)`` modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(BLOCK, 1 << (n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size == BLOCK:
            _powers[base] = have
    return have[:n]


@dataclass
class Words:
    """Words of a batch in order: the document each is in, and its hash."""

    doc: np.ndarray
    hash: np.ndarray
    n_docs: int

    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.n_docs)


def _hash_block(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up = powers(Q, len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(Q_INVERSE, len(data) + 1)[starts])


def words_of(texts: list[bytes]) -> Words:
    """The words of UTF-8 texts."""
    docs, hashes, first = [], [], 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or size + len(texts[last]) < BLOCK - 1):
            size += len(texts[last]) + 1
            last += 1
        block = texts[first:last]
        data = np.frombuffer(b" ".join(block).lower() + b" ", np.uint8)
        gap = SPACES[data]
        edge = np.diff(gap.astype(np.int8), prepend=1)
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        if len(starts):
            bounds = np.cumsum([len(t) + 1 for t in block])
            docs.append(np.searchsorted(bounds, starts, side="right") + first)
            hashes.append(_hash_block(data, starts, ends))
        first = last
    return Words(
        np.concatenate(docs) if docs else np.zeros(0, np.int64),
        np.concatenate(hashes) if hashes else np.zeros(0, np.uint64),
        len(texts),
    )


def combine(parts: list[np.ndarray]) -> np.ndarray:
    """One hash from the hashes of consecutive words; depends on order and count."""
    h = np.full(len(parts[0]), len(parts), np.uint64)
    for p in parts:
        h = mix(h * np.uint64(Q) + p)
    return h


def shingles(words: Words, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """``(doc, hash)`` of all runs of ``width`` words, repeats included, in text order."""
    n = len(words.hash) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    whole = np.flatnonzero(words.doc[:n] == words.doc[width - 1 :])
    return words.doc[whole], combine([words.hash[whole + k] for k in range(width)])


def shingle_sets(words: Words, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """``(doc, hash)`` of the distinct shingles of each document, sorted by both.

    The hash is cut to 48 bits, so that one 64-bit sort does; a batch holds at most
    65,536 documents (:func:`common.text_batches` sees to it). A document of fewer than ``width`` words has its whole sequence as one shingle,
    a document without words has none.
    """
    doc, h = shingles(words, width)
    counts = words.counts()
    first = np.concatenate(([0], np.cumsum(counts)))[:-1]
    for n in range(1, width):
        short = np.flatnonzero(counts == n)
        if len(short):
            doc = np.concatenate((doc, short))
            h = np.concatenate((h, combine([words.hash[first[short] + k] for k in range(n)])))
    key = np.sort((doc.astype(np.uint64) << np.uint64(48)) | (h >> np.uint64(16)))
    if len(key):
        key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    return (key >> np.uint64(48)).astype(np.int64), key & np.uint64((1 << 48) - 1)
