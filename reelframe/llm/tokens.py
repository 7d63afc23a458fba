"""Token ids as the tokenizers library gives them, for a byte-level vocabulary, with a table of the words met before."""

from __future__ import annotations

import gc
import re
import sys
import types

import numpy as np
from tokenizers import Tokenizer

#: Fixed value: how byte-level tokenizer files cut a text into words.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Any other characters than these letters and marks, whose kinds are in _RANGES.
_OTHER = re.compile("[^\x00-ɏ‐-‧‰-⁞₠-₿]")
_RANGES = {r"\p{L}": r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ", r"\p{N}": r"0-9\xb2\xb3\xb9\xbc-\xbe", r"\s": r"\t-\r \x85\xa0"}


def beyond_ranges(text: str) -> bool:
    return _OTHER.search(text) is not None


#: A character of each kind that word patterns know: letter, number, other, white space.
STANDS = "b2!\n"


def _cuts(pre, c: str) -> tuple:
    """How a library's pre-tokenizer cuts a text in which c stands twice; it tells c's kind."""
    return tuple(span for _, span in pre.pre_tokenize_str(f"a{c}{c}1"))


class WordFinder:
    """A text's words by a pattern in which \\p{L}, \\p{N}, \\s and \\S may stand, as the library `pre` belongs to cuts them.

    Characters outside of explicit ranges are asked of the library when they are first met, as Unicode's tables differ
    between versions, and one of the same kind stands for each in the search.
    """

    def __init__(self, pattern: str, pre):
        plain = pattern.replace(r"\S", rf"[^{_RANGES[chr(92) + 's']}]")
        for name, chars in _RANGES.items():
            plain = re.sub(r"\[[^\]]*\]|" + re.escape(name), lambda m: m[0].replace(name, chars) if m[0][0] == "[" else f"[{chars}]", plain)  # noqa: B023
        self.plain, self.pre, self.stand = re.compile(plain), pre, {}
        self.kinds = {_cuts(pre, c): c for c in STANDS}

    def __call__(self, text: str) -> list[str]:
        if not _OTHER.search(text):
            return self.plain.findall(text)
        for c in set(_OTHER.findall(text)):
            if ord(c) not in self.stand:
                self.stand[ord(c)] = self.kinds[_cuts(self.pre, c)]
        return [text[m.start() : m.end()] for m in self.plain.finditer(text.translate(self.stand))]


class KindsOfChars:
    """What a byte-level file's words are made of: the kind of each code point, as the library itself cuts it.

    A code point beyond ASCII is asked for when it is first met, so no other library's Unicode tables are relied on.
    """

    LETTER, NUMBER, OTHER, SPACE = 1, 2, 3, 4

    def __init__(self, pre):
        self.pre, self.of = pre, np.zeros(0x110000, np.uint8)
        self.kinds = {_cuts(pre, c): k for k, c in enumerate(STANDS, 1)}
        self.of[32] = self.SPACE  # the one character that is cut in a way of its own
        self.ask(np.arange(128))
        self.bytes = np.r_[self.of[:128], np.zeros(128, np.uint8)]

    def ask(self, points: np.ndarray) -> None:
        for c in np.unique(points[self.of[points] == 0]).tolist():
            self.of[c] = self.kinds[_cuts(self.pre, chr(c))]

    def of_bytes(self, data: np.ndarray, n: int) -> np.ndarray:
        """The kind of the character that each of the first n bytes of UTF-8 data belongs to; data has a few bytes more."""
        kind = self.bytes[data[:n]]
        lead = np.flatnonzero(data[:n] >= 0xC0)
        if len(lead):
            b0, b1, b2, b3 = (data[lead + i].astype(np.int32) & 63 for i in range(4))
            size = 2 + (b0 >= 0x20) + (b0 >= 0x30)
            point = np.where(size == 2, b0 << 6 | b1, np.where(size == 3, (b0 & 15) << 12 | b1 << 6 | b2, (b0 & 7) << 18 | b1 << 12 | b2 << 6 | b3))
            found = self.of[point]
            if not found.all():
                self.ask(point)
                found = self.of[point]
            for i in range(4):
                here = size > i
                kind[lead[here] + i] = found[here]
        return kind


def word_starts(kinds: KindsOfChars, data: np.ndarray, n: int, begins: np.ndarray) -> np.ndarray:
    """Where the words of BYTE_LEVEL start in the first n bytes of UTF-8 data; texts begin at `begins` (data[n:]: zeros)."""
    kind = kinds.of_bytes(data, n)
    first = np.zeros(n + 8, bool)
    first[begins] = True
    first[n:] = True
    start = np.ones(n + 8, bool)
    np.not_equal(kind[1:], kind[:-1], out=start[1:n])
    start[begins] = True
    space = kind == kinds.SPACE
    # the last white-space character before a word is cut off the ones before it, and belongs to the word if it is a blank
    word = np.flatnonzero(space[:-1] & ~space[1:] & ~first[1:n]) + 1
    last = word - 1
    while (inside := (data[last] & 0xC0) == 0x80).any():
        last[inside] -= 1
    start[last] = True
    start[word[data[last] == 32]] = False
    quote = np.flatnonzero((data[:n] == 39) & start[:n])
    quote = quote[~first[quote + 1]]
    if len(quote):
        a, b = data[quote + 1], data[quote + 2]
        one = (a == 115) | (a == 116) | (a == 109) | (a == 100)  # 's 't 'm 'd
        two = (((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108)) & ~first[quote + 2]  # 're 've 'll
        start[quote[one | two] + 1] = False
        start[quote[one] + 2] = True
        start[quote[two] + 3] = True
    return np.flatnonzero(start[:n])


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, .. (sizes[0] numbers), starts[1], .."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


_LOW = np.array([(1 << 8 * min(k, 8)) - 1 for k in range(16)], np.uint64)
_HIGH = np.array([(1 << 8 * max(0, k - 8)) - 1 for k in range(16)], np.uint64)


class WordTable:
    """Ids of words of up to 15 bytes: open addressing on the words themselves, looked up for whole arrays at once."""

    def __init__(self, kind: str, bits: int = 16):
        self.kind, self.n = np.dtype(kind), 0
        self._room(bits)
        self.pool, self.used = np.empty(1 << bits, self.kind), 0

    def _room(self, bits: int) -> None:
        self.bits = bits
        self.low, self.high = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint64)  # high: length on top, 0 if free
        self.at, self.size = np.zeros(1 << bits, np.uint32), np.zeros(1 << bits, np.uint8)

    @staticmethod
    def keys(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words as two integers; data has 16 bytes more."""
        eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
        return eight[starts] & _LOW[sizes], eight[starts + 8] & _HIGH[sizes] | sizes.astype(np.uint64) << np.uint64(56)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The slot of each word: its own, or the free one where it would go."""
        h = (low * np.uint64(0x9E3779B97F4A7C15)) ^ (high * np.uint64(0xC2B2AE3D27D4EB4F))
        slot = ((h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F) >> np.uint64(64 - self.bits)).astype(np.int64)
        held = self.high[slot]
        left = np.flatnonzero((held != 0) & ((held != high) | (self.low[slot] != low)))
        while len(left):
            at = slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            held = self.high[at]
            left = left[(held != 0) & ((held != high[left]) | (self.low[at] != low[left]))]
        return slot

    def add(self, low: np.ndarray, high: np.ndarray, at: np.ndarray, size: np.ndarray) -> None:
        """Words that aren't held yet; of one that repeats, one of its places counts."""
        if (self.n + len(low)) * 3 > 2 << self.bits:
            full = np.flatnonzero(self.high)
            old = self.low[full], self.high[full], self.at[full], self.size[full]
            self._room(max(self.bits + 1, int((self.n + len(low)) * 2).bit_length()))
            self.n = 0
            self.add(*old)
        left = np.arange(len(low))
        while len(left):
            slot = self.find(low[left], high[left])
            free = self.high[slot] == 0  # else it came in meanwhile
            left, slot = left[free], slot[free]
            self.high[slot] = left  # of words that want one slot the last gets it
            won = self.high[slot] == left
            mine, slot = left[won], slot[won]
            self.low[slot], self.high[slot], self.at[slot], self.size[slot] = low[mine], high[mine], at[mine], size[mine]
            self.n += len(mine)
            left = left[~won]

    def keep(self, ids: bytes) -> int:
        """Put ids into the pool; where they begin."""
        new = np.frombuffer(ids, self.kind)
        begin, self.used = self.used, self.used + len(new)
        if self.used > len(self.pool):
            self.pool = np.r_[self.pool[:begin], np.empty(max(len(self.pool), 2 * len(new)), self.kind)]
        self.pool[begin : self.used] = new
        return begin


class CachedTokenizer:
    """The tokenizers library for one byte-level file; words met before aren't encoded again.

    Byte-level BPE never merges across words, so a text's ids are those of its words. Words are cut and looked up in
    arrays. New words that begin with a space, and those of letters only, go to the library as one text, which it cuts
    at the same places; others go one by one. Texts that hold an added token go to it whole. At `most` words the table
    starts anew.
    """

    def __init__(self, path: str, most: int = 1_200_000):
        self.lib, self.most = Tokenizer.from_file(path), most
        self.lib.no_truncation()
        self.lib.no_padding()
        self.added = [t.content.encode() for t in self.lib.get_added_tokens_decoder().values()]
        vocab = self.lib.get_vocab(with_added_tokens=False)
        self.opens = np.zeros(max(vocab.values()) + 1, bool)
        self.opens[[i for t, i in vocab.items() if t.startswith("Ġ")]] = True  # the letter that stands for a space
        self.line = vocab["Ċ"]  # the letter that stands for a line end
        self.kind = "<u2" if self.lib.get_vocab_size() <= 1 << 16 else "<u4"
        self.kinds = KindsOfChars(self.lib.pre_tokenizer)
        self._forget()

    def _forget(self) -> None:
        self.table, self.long = WordTable(self.kind), {}

    def _ask(self, words: list[bytes]) -> list[bytes]:
        """The library's ids of each word."""
        found: dict[str, bytes] = {}
        new = [w.decode() for w in words]
        spaced = [w for w in new if w[0] == " " and w[1:].isalpha()]
        letters = [w for w in new if w.isalpha()]
        alone = [w for w in new if not (w[1:].isalpha() if w[0] == " " else w.isalpha())]
        for lead, keys in ((" ", spaced), ("\n", letters)):
            if not keys:
                continue
            text = "".join(keys) if lead == " " else lead + lead.join(keys)
            ids = np.array(self.lib.encode_batch_fast([text], add_special_tokens=False)[0].ids)
            starts = np.flatnonzero(self.opens[ids] if lead == " " else ids == self.line)
            if len(starts) != len(keys):
                alone += keys
                continue
            flat, size = ids.astype(self.kind).tobytes(), np.dtype(self.kind).itemsize
            begins, ends = (starts + (lead != " ")) * size, np.append(starts[1:], len(ids)) * size
            found.update(zip(keys, map(flat.__getitem__, map(slice, begins.tolist(), ends.tolist())), strict=True))
        for w, e in zip(alone, self.lib.encode_batch_fast(alone, add_special_tokens=False), strict=True):
            found[w] = np.array(e.ids, self.kind).tobytes()
        return [found[w] for w in new]

    def _learn(self, words: list[bytes], slots: bool) -> None:
        """Have the ids of new words at hand, in the table (slots) or beside it."""
        ids = self._ask(words)
        size = np.array([len(x) for x in ids], np.int64) // self.table.kind.itemsize
        first = self.table.keep(b"".join(ids))
        at = first + np.cumsum(size) - size
        if not slots:
            self.long.update(zip(words, zip(at.tolist(), size.tolist(), strict=True), strict=True))
            return
        data = np.frombuffer(b"".join(words) + bytes(16), np.uint8)
        length = np.array([len(w) for w in words], np.int64)
        self.table.add(*WordTable.keys(data, np.cumsum(length) - length, length), at, size)

    def encode_bytes(self, texts: list[bytes], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of UTF-8 texts, one after the other and without special tokens around them; the number of each text's.

        end_id, if given, stands behind the ids of each text and counts.
        """
        collects = gc.isenabled()
        gc.disable()  # many words are made here and no cycles
        try:
            out, sizes, run, held = [], [], [], 0
            for t in [*texts, None]:
                odd = t is not None and any(map(t.__contains__, self.added))
                if run and (t is None or odd or held + len(t) > 1 << 20):
                    ids, size = self._encode(run)
                    out.append(ids)
                    sizes.append(size)
                    run, held = [], 0
                if odd:
                    out.append(np.array(self.lib.encode(t.decode(), add_special_tokens=False).ids, self.kind))
                    sizes.append([len(out[-1])])
                elif t is not None:
                    run.append(t)
                    held += len(t)
            ids, sizes = np.concatenate(out or [np.empty(0, self.kind)]), np.concatenate(sizes or [[]]).astype(np.int64)
            return (ids, sizes) if end_id is None else (np.insert(ids, np.cumsum(sizes), end_id), sizes + 1)
        finally:
            if collects:
                gc.enable()

    def _encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        size = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(size)
        n = int(ends[-1])
        if not n:
            return np.empty(0, self.kind), np.zeros(len(texts), np.int64)
        raw = b"".join([*texts, bytes(32)])
        data = np.frombuffer(raw, np.uint8)
        begin = ends - size
        starts = word_starts(self.kinds, data, n, begin[size > 0])
        length = np.diff(starts, append=n)
        if self.table.n + len(self.long) > self.most:
            self._forget()
        short = length < 16
        at, count = np.empty(len(starts), np.int64), np.empty(len(starts), np.int64)
        where = slice(None) if short.all() else np.flatnonzero(short)
        low, high = WordTable.keys(data, starts[where], length[where])
        slot = self.table.find(low, high)
        missing = np.flatnonzero(self.table.high[slot] == 0)
        if len(missing):
            s, k = starts[where][missing], length[where][missing]
            self._learn(list({raw[i:j] for i, j in zip(s.tolist(), (s + k).tolist(), strict=True)}), True)
            slot = self.table.find(low, high)
        at[where], count[where] = self.table.at[slot], self.table.size[slot]
        if not short.all():
            far = np.flatnonzero(~short)
            words = [raw[i : i + k] for i, k in zip(starts[far].tolist(), length[far].tolist(), strict=True)]
            if new := list(set(words) - self.long.keys()):
                self._learn(new, False)
            at[far], count[far] = np.array([self.long[w] for w in words], np.int64).T
        ids = self.table.pool[ranges(at, count)]
        total = np.r_[0, np.cumsum(count)]
        return ids, np.diff(total[np.searchsorted(starts, np.r_[begin, n])])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, without special tokens around it."""
        ids, sizes = self.encode_bytes([t.encode() for t in texts])
        return np.split(ids, np.cumsum(sizes)[:-1]) if texts else []


def tokenizer_of(path: str) -> CachedTokenizer:
    """The tokenizer at path, read once in each Python process."""
    kept = sys.modules.setdefault("_reelframe_tokenizers", types.ModuleType("_reelframe_tokenizers"))
    if path not in vars(kept):
        vars(kept)[path] = CachedTokenizer(path)
    return vars(kept)[path]
