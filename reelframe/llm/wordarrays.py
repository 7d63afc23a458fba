"""The white-space words of texts as arrays, and numbers for them: in a fixed index, or as they come."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .tokens import WordTable

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


class Words:
    """Words of UTF-8 texts, A-Z lower-cased: what stands between space, tab, line feed, vertical tab, form feed, return.

    starts and lengths in `raw`; those of text i are starts[bounds[i]:bounds[i + 1]].
    """

    def __init__(self, texts: list[bytes]):
        self.raw = b"\n".join([b"", *texts, bytes(16)]).lower()
        data = np.frombuffer(self.raw, np.uint8)
        space = _SPACE[data[:-16]]
        edges = np.flatnonzero(space[1:] != space[:-1]) + 1
        self.data, self.starts = data, edges[::2]
        self.lengths = edges[1::2] - self.starts
        begins = np.cumsum([1, *(len(t) + 1 for t in texts)])
        self.bounds = np.searchsorted(self.starts, begins)
        self.long = np.flatnonzero(self.lengths > 15)

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """The short words as integers; of long ones the length is 0."""
        return WordTable.keys(self.data, self.starts, np.where(self.lengths > 15, 0, self.lengths))

    def __getitem__(self, i: int) -> bytes:
        return self.raw[self.starts[i] : self.starts[i] + self.lengths[i]]

    def array(self, at: np.ndarray) -> pa.Array:
        """The words at the given places."""
        return _gathered(self.data, self.starts[at], self.lengths[at])


def _gathered(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    ends = np.r_[0, np.cumsum(lengths)]
    flat = data[np.repeat(starts - ends[:-1], lengths) + np.arange(ends[-1])]
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(flat)])


def _as_words(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(data with 16 bytes more, starts, lengths) of an array of words."""
    words = words.cast(pa.binary())
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64) if len(words) else np.zeros(1, np.int64)
    raw = words.buffers()[2]
    return np.frombuffer((raw.to_pybytes() if raw else b"") + bytes(16), np.uint8), ends[:-1], np.diff(ends)


class WordIndex:
    """Numbers of given words: their places in the list. Small when pickled, as only the words are kept then."""

    def __init__(self, words: pa.Array):
        self.words = words
        self._build()

    def _build(self) -> None:
        data, starts, lengths = _as_words(self.words)
        short = np.flatnonzero((lengths > 0) & (lengths < 16))
        self.table = WordTable("<u4", max(4, (2 * len(short)).bit_length()))
        self.table.add(*WordTable.keys(data, starts[short], lengths[short]), short, np.zeros(len(short), np.uint8))
        self.rest = {self.words[int(i)].as_py(): int(i) for i in np.flatnonzero(lengths > 15)}

    def __getstate__(self):
        return self.words

    def __setstate__(self, words):
        self.words = words
        self._build()

    def __len__(self) -> int:
        return len(self.words)

    def __call__(self, words: Words) -> np.ndarray:
        """The number of each word, -1 for others."""
        low, high = words.keys()
        slot = self.table.find(low, high)
        out = np.where((self.table.high[slot] != 0) & (high >> np.uint64(56) != 0), self.table.at[slot].astype(np.int64), -1)
        for i in words.long.tolist():
            out[i] = self.rest.get(words[i], -1)
        return out


class Interner:
    """Numbers for words as they come, from 0."""

    def __init__(self):
        self.table, self.rest, self.n = WordTable("<u4"), {}, 0

    def __call__(self, words: Words, at: np.ndarray) -> np.ndarray:
        """The numbers of the words at the given places."""
        out = np.empty(len(at), np.int64)
        lengths = words.lengths[at]
        short = np.flatnonzero(lengths < 16)
        low, high = WordTable.keys(words.data, words.starts[at[short]], lengths[short])
        slot = self.table.find(low, high)
        new = np.flatnonzero(self.table.high[slot] == 0)
        if len(new):
            self.table.add(low[new], high[new], self.n + np.arange(len(new)), np.zeros(len(new), np.uint8))  # repeats leave gaps
            self.n += len(new)
            slot = self.table.find(low, high)
        out[short] = self.table.at[slot]
        for i in np.flatnonzero(lengths > 15).tolist():
            w = words[int(at[i])]
            if w not in self.rest:
                self.rest[w] = self.n
                self.n += 1
            out[i] = self.rest[w]
        return out

    def words(self, numbers: np.ndarray) -> pa.Array:
        """The words of given numbers."""
        full = np.flatnonzero(self.table.high)
        place = np.full(self.n, -1, np.int64)
        place[self.table.at[full]] = np.arange(len(full))
        data = np.stack([self.table.low[full], self.table.high[full]], 1).astype("<u8").view(np.uint8).reshape(-1)
        lengths = (self.table.high[full] >> np.uint64(56)).astype(np.int64)
        tails = list(self.rest)
        place[list(self.rest.values())] = len(full) + np.arange(len(tails))
        sizes = np.array([len(w) for w in tails], np.int64)
        starts = np.r_[16 * np.arange(len(full)), len(data) + np.cumsum(sizes) - sizes]
        data = np.concatenate([data, np.frombuffer(b"".join(tails), np.uint8)])
        at = place[numbers]
        return _gathered(data, starts[at], np.r_[lengths, sizes][at])
