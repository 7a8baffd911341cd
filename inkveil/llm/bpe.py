"""Byte-level BPE by rank-synchronous merging of ragged numpy arrays.

Pre-tokens of a batch lie one after another in one array of symbols. A round looks
up the rank of every pair of neighbours, takes the lowest rank within each sequence,
and merges all places of that pair in all sequences at once. Sequences without a
mergeable pair are done; what is left of them are their tokens.
"""

from __future__ import annotations

import functools
import json

import numpy as np

NONE = np.int32(2**31 - 1)
SLOTS = 1 << 18


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    of = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}
    return [of[b] for b in range(256)]


class Merger:
    """Merges of one vocabulary file (tokenizers' JSON), with pair ranks in a hash table."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        vocab, merges = model["model"]["vocab"], model["model"]["merges"]
        self.special = {a["content"]: a["id"] for a in model["added_tokens"]}
        self.of_byte = np.array([vocab[c] for c in byte_characters()], np.int32)
        self.tokens = [t for t, _ in sorted((vocab | self.special).items(), key=lambda x: x[1])]
        space = byte_characters()[32]
        self.space_first = np.array([i for t, i in vocab.items() if t.startswith(space)], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        self.keys, self.ranks = np.full(SLOTS, -1, np.int64), np.full(SLOTS, NONE, np.int32)
        left = np.arange(len(keys))
        slot = self._slot(keys)
        while len(left):
            free = self.keys[slot] == -1
            at, who = np.unique(slot[free], return_index=True)
            placed = left[free][who]
            self.keys[at], self.ranks[at] = keys[placed], placed
            rest = ~np.isin(left, placed)
            left, slot = left[rest], (slot[rest] + 1) % SLOTS

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)).astype(np.int64)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a.astype(np.int64) << 32 | b
        slot = self._slot(keys)
        found = self.keys[slot]
        ranks = np.where(found == keys, self.ranks[slot], NONE)
        open_ = np.flatnonzero((found != keys) & (found != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) % SLOTS
            found = self.keys[slot[open_]]
            hit = found == keys[open_]
            ranks[open_[hit]] = self.ranks[slot[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return ranks

    def encode(self, pre_tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, number of ids of each pre-token)``."""
        offsets = np.concatenate(([0], np.cumsum([len(p) for p in pre_tokens])))
        return self.merge(np.frombuffer(b"".join(pre_tokens), np.uint8), offsets.astype(np.int64))

    def merge(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As :meth:`encode`, of pre-tokens one after another in an array."""
        sizes = np.diff(offsets)
        symbols = self.of_byte[data]
        seq = np.repeat(np.arange(len(sizes)), sizes)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            ranks = np.full(len(symbols), NONE, np.int32)
            inner = np.flatnonzero(seq[:-1] == seq[1:])
            ranks[inner] = self.pair_ranks(symbols[inner], symbols[inner + 1])
            starts = np.flatnonzero(np.diff(seq, prepend=-1))
            lengths = np.diff(starts, append=len(seq))
            lowest = np.repeat(np.minimum.reduceat(ranks, starts), lengths)
            over = lowest == NONE
            if over.any():
                done.append((seq[over], symbols[over]))
                keep = ~over
                symbols, seq, ranks, lowest = symbols[keep], seq[keep], ranks[keep], lowest[keep]
                if not len(symbols):
                    break
            at = np.flatnonzero(ranks == lowest)
            # Of places that overlap (a a a), every second one merges, from the left.
            touching = np.diff(at, prepend=-2) == 1
            if touching.any():
                run = np.cumsum(~touching) - 1
                first = at[~touching]
                at = at[(at - first[run]) % 2 == 0]
            symbols[at] = self.merged[ranks[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, seq = symbols[keep], seq[keep]
        if not done:
            return np.zeros(0, np.int32), np.zeros(len(sizes), np.int64)
        seq = np.concatenate([s for s, _ in done])
        ids = np.concatenate([x for _, x in done])
        order = np.argsort(seq, kind="stable")
        return ids[order], np.bincount(seq, minlength=len(sizes))


@functools.lru_cache(maxsize=2)
def merger(path: str) -> Merger:
    return Merger(path)
