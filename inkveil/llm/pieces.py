"""Token ids of whole texts by a byte-level BPE vocabulary, remembered by word.

Texts are cut before every space and line end that has a character other than white
space behind it. No token crosses such a place and none on its left depends on what
stands on its right, so the ids of a text are the ids of its words in a row; a word has
the space or line end before it and what white space follows. The words of a batch are
one column, which is dictionary-encoded; the distinct ones are looked up in a column of words
that the worker process remembers, with their ids in one array. Of words of letters with
a mark behind them the letters are looked up. Letters that are new are merged as
arrays (:mod:`bpe`), other words are split by the vocabulary's pattern first. Beyond a
fixed number all words but those of the texts at hand are forgotten.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from inkveil.llm.bpe import merger

REMEMBERED, REMEMBERED_TOKENS = 1_000_000, 100_000  # words, and what words are cut into
ENCODE_BYTES = 8 << 20  # of texts at a time
LONGEST = 256  # bytes of a word that is remembered
ENDS = ",.;:!?"  # behind letters each of these is a piece of its own
LETTERS, ENDED = r"^ \pL+$", rf"^ \pL+[{ENDS}]$"
# No cut before these: white space, or bytes that other white space begins with.
UNCUT = np.zeros(256, bool)
UNCUT[[*range(9, 14), *range(28, 33), 0xC2, 0xE1, 0xE2, 0xE3]] = True


def binary(data: bytes | np.ndarray, offsets: np.ndarray) -> pa.BinaryArray:
    offsets = offsets.astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def bytes_of(column: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """``(all bytes, offsets)`` of a column, the first offset 0."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``starts[0], starts[0] + 1, ...``: ``counts[k]`` numbers from each ``starts[k]``."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(int(ends[-1]) if len(ends) else 0)


def matches(column: pa.BinaryArray, pattern: str) -> np.ndarray:
    return pc.match_substring_regex(column.cast(pa.string()), pattern).to_numpy(zero_copy_only=False)


def cut_words(texts: list[bytes], uncut: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Words of all texts in a row, and where each text's words begin (one more: their number)."""
    data = b"".join(texts)
    x = np.frombuffer(data, np.uint8)
    bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    cut = np.zeros(len(x) + 1, bool)
    if len(x):
        cut[: len(x) - 1] = ((x[:-1] == 32) | (x[:-1] == 10)) & ~uncut[x[1:]]
        cut[np.maximum(bounds[1:] - 1, 0)] = False  # the last byte of a text
        cut[bounds] = True
        cut[len(x)] = False
    starts = np.flatnonzero(cut)
    return binary(data, np.append(starts, len(x))).dictionary_encode(), np.searchsorted(starts, bounds)


class Encoder:
    """Ids (or only their number) of texts; keep one per worker process."""

    def __init__(self, path: str, count_only: bool = False):
        import public_tokenizers
        import regex

        self.merger = merger(path)
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.special = re.compile("(" + "|".join(map(re.escape, self.merger.special)) + ")")
        self.marks = [s[:2] for s in self.merger.special]
        self.uncut = UNCUT.copy()
        self.uncut[[s.encode()[0] for s in self.merger.special]] = True  # white space before one is a piece
        self.of_end = np.zeros(256, "<u4")
        self.of_end[list(ENDS.encode())] = self.merger.of_byte[list(ENDS.encode())]
        self.count_only = count_only
        self.of_token: dict[str, np.ndarray] = {s: np.array([i], "<u4") for s, i in self.merger.special.items()}
        # Words, how many ids each has, and all their ids.
        self.words, self.sizes, self.ids = pa.array([], pa.binary()), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def pre_tokens(self, text: str) -> list[str]:
        """Special strings stay whole, as the library takes them by default."""
        if any(m in text for m in self.marks):
            parts = self.special.split(text)
            return [t for k, p in enumerate(parts) if p for t in ([p] if k % 2 else self.split(p))]
        return self.split(text)

    def merge(self, pre_tokens: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, number of ids of each)``, some pre-tokens at a time."""
        done = [self.merger.merge(*bytes_of(pre_tokens[k : k + 20_000])) for k in range(0, len(pre_tokens), 20_000)]
        if not done:
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        return np.concatenate([ids for ids, _ in done]).astype("<u4"), np.concatenate([n for _, n in done])

    def split_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same of words, by the pattern."""
        cut = [self.pre_tokens(w.decode()) for w in words]
        needed = {t for some in cut for t in some}
        if len(self.of_token) > REMEMBERED_TOKENS:
            self.of_token = {s: self.of_token[s] for s in self.merger.special}
        new = list(needed.difference(self.of_token))
        ids, n = self.merge(pa.array([t.encode() for t in new], pa.binary()))
        self.of_token.update(zip(new, np.split(ids, np.cumsum(n)[:-1]), strict=True) if new else ())
        found = [self.of_token[t] for some in cut for t in some]
        ends = np.cumsum([0, *map(len, found)])[np.cumsum([0, *map(len, cut)])]
        return np.concatenate(found) if found else ids, np.diff(ends)

    def learn(self, new: pa.BinaryArray) -> np.ndarray:
        """Remember words with their ids, letters first; where they stand now."""
        letters = matches(new, LETTERS)
        plain, other = new.filter(pa.array(letters)), new.filter(pa.array(~letters))
        ids, n = self.merge(plain)
        more, m = self.split_words(other.to_pylist())
        place = np.empty(len(new), np.int64)
        place[letters] = len(self.words) + np.arange(len(plain))
        place[~letters] = len(self.words) + len(plain) + np.arange(len(other))
        self.words = pa.concat_arrays([self.words, plain, other])
        self.sizes = np.concatenate((self.sizes, n, m))
        if not self.count_only:
            self.ids = np.concatenate((self.ids, ids, more))
        return place

    def keep(self, some: np.ndarray) -> None:
        """Forget all words but these."""
        if not self.count_only:
            first = np.cumsum(self.sizes) - self.sizes
            self.ids = self.ids[ranges(first[some], self.sizes[some])]
        self.words, self.sizes = self.words.take(pa.array(some)), self.sizes[some]

    def look_up(self, words: pa.BinaryArray) -> np.ndarray:
        """Places of the words among those remembered, new ones included."""
        found = pc.index_in(words, value_set=self.words)
        new = found.is_null()
        place, is_new = found.fill_null(0).to_numpy().astype(np.int64), new.to_numpy(zero_copy_only=False)
        if is_new.any():
            if len(self.words) > REMEMBERED:
                self.keep(place[~is_new])
                place[~is_new] = np.arange(len(self.words))
            place[is_new] = self.learn(words.filter(new))
        return place

    def __call__(self, texts: list[str] | list[bytes]) -> list:
        """For each text its ids as little-endian unsigned 32-bit integers, or their number."""
        column, begins = cut_words([t.encode() if isinstance(t, str) else t for t in texts], self.uncut)
        at = column.indices.to_numpy()
        words = column.dictionary
        data, offsets = bytes_of(words)
        ended = matches(words, ENDED)
        # Letters with a mark behind them stand for themselves and the mark.
        length = np.diff(offsets) - ended
        bare = binary(data[ranges(offsets[:-1], length)], np.concatenate(([0], np.cumsum(length)))).dictionary_encode()
        place = self.look_up(bare.dictionary)[bare.indices.to_numpy()]
        size = self.sizes[place] + ended
        ends = np.concatenate(([0], np.cumsum(size[at])))  # ids before each word
        of_text = ends[begins]
        if self.count_only:
            out = np.diff(of_text).tolist()
        else:
            first = np.cumsum(self.sizes) - self.sizes
            own = np.empty(size.sum(), "<u4")
            stops = np.cumsum(size)
            letters = np.ones(len(own), bool)
            letters[stops[ended] - 1] = False
            own[letters] = self.ids[ranges(first[place], self.sizes[place])]
            own[stops[ended] - 1] = self.of_end[data[offsets[1:][ended] - 1]]
            ids = own[ranges((stops - size)[at], size[at])].tobytes()
            of_text = (4 * of_text).tolist()
            out = [ids[a:b] for a, b in zip(of_text, of_text[1:], strict=False)]
        if LONGEST < np.diff(bytes_of(self.words)[1]).max(initial=0):
            self.keep(np.flatnonzero(np.diff(bytes_of(self.words)[1]) <= LONGEST))
        return out


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, count_only: bool = False) -> Encoder:
    """The worker process's encoder for a vocabulary."""
    if (path, count_only) not in _encoders:
        _encoders[path, count_only] = Encoder(path, count_only)
    return _encoders[path, count_only]
