"""BPE encoding and decoding of a public tokenizer file, by speculation and verification.

Per distinct word, greedy longest match proposes tokens; every adjacent pair of all proposals is then tested at once for
compatibility (whether plain merging of the two tokens' text would leave that boundary alone); only words with a failing
pair are merged exactly. A proposal whose tokens all encode to themselves and whose pairs are all compatible is what
merging would give, so the result is exact in every case.
"""

from __future__ import annotations

import heapq
import json
import re
import sys
import types
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import map_texts, strings_of
from .tokens import BYTE_LEVEL, WordFinder, beyond_ranges

_NEVER = np.int64(1) << 40


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes as they are, others from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class BpeModel:
    """Vocabulary, merges and text rules of one tokenizers JSON file (byte-level BPE, with or without word ends)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("unk_token") or model.get("byte_fallback") or model.get("continuing_subword_prefix") or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError("only plain byte-level BPE files are supported")
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.letters = _byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in (self.vocab | self.special).items()}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._text_rules(spec, Tokenizer.from_file(path))
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {m: i for i, m in enumerate(merges)}
        self._tables(merges)
        self._ids: dict[str, bytes] = {}
        self._texts: dict[str, str] = {}

    def _text_rules(self, spec: dict, lib: Tokenizer) -> None:
        """How texts become words. Unicode's tables, which differ between versions, are the library's."""
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        pre = spec["pre_tokenizer"]
        if kinds == ["NFC", "Replace", "Lowercase"]:
            first = pre["pretokenizers"][0]
            if first["type"] != "Split" or first["behavior"] != "Removed" or not first["invert"]:
                raise ValueError("unknown pre-tokenizer")
            self.words = WordFinder(first["pattern"]["Regex"], lib.pre_tokenizer)
            own = lambda t: unicodedata.normalize("NFC", t).replace("Σ", "σ").lower()  # noqa: E731  letter by letter, so no final sigma
            self.normal = lambda t: lib.normalizer.normalize_str(t) if beyond_ranges(t) else own(t)
        elif not kinds and pre["type"] == "ByteLevel" and not pre["add_prefix_space"]:
            self.words = WordFinder(BYTE_LEVEL, lib.pre_tokenizer)
            self.normal = lambda t: t
        else:
            raise ValueError("unknown normalizer")
        self.joint = "" if spec["decoder"] else " "

    def _tables(self, merges: list[tuple[str, str]]) -> None:
        """Arrays by id: rank of the merge that makes a token, its two halves; sorted keys of all merges."""
        top = max(self.names) + 1
        self.made = np.full(top, -1, np.int64)
        self.left, self.right = np.full(top, -1, np.int64), np.full(top, -1, np.int64)
        ids = np.array([(self.vocab[a], self.vocab[b], self.vocab[a + b]) for a, b in merges], np.int64)
        self.made[ids[:, 2]] = np.arange(len(ids))
        self.left[ids[:, 2]], self.right[ids[:, 2]] = ids[:, 0], ids[:, 1]
        keys = (ids[:, 0] << 32) | ids[:, 1]
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        stable = np.zeros(top, bool)
        stable[[i for t, i in self.vocab.items() if self.made[i] < 0 and len(t.removesuffix(self.end) if self.end else t) == 1]] = True
        alone = self._compatible(ids[:, 0], ids[:, 1], np.arange(len(ids), dtype=np.int64))
        for (a, b, t), ok in zip(ids.tolist(), alone.tolist(), strict=True):
            stable[t] = ok and stable[a] and stable[b]
        self.longest = 1
        self.match: dict[str, int] = {}
        for t, i in self.vocab.items():
            if stable[i]:
                self.match[t] = i
                self.longest = max(self.longest, len(t))

    def _merge_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        want = (a << 32) | b
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.ranks[at], _NEVER)

    def _compatible(self, a: np.ndarray, b: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """Whether merging the joint text of a[i] and b[i] keeps the boundary (up to merge rank before[i], if given).

        The two tokens are taken apart again, the later made first. Between two such steps the tokens at the boundary
        are fixed, and they would have been merged if their merge ranks before the one that ended that state. Of equal
        ranks the left is merged first, so the right is taken apart first.
        """
        a, b = a.copy(), b.copy()
        limit = np.full(len(a), _NEVER) if before is None else before.astype(np.int64).copy()
        ok = np.ones(len(a), bool)
        left = np.arange(len(a))
        while len(left):
            x, y = a[left], b[left]
            ok[left] = self._merge_rank(x, y) >= limit[left]
            made_x, made_y = self.made[x], self.made[y]
            go = ok[left] & (np.maximum(made_x, made_y) >= 0)
            left, x, y, made_x, made_y = left[go], x[go], y[go], made_x[go], made_y[go]
            back = made_x > made_y
            a[left] = np.where(back, self.right[x], x)
            b[left] = np.where(back, y, self.left[y])
            limit[left] = np.where(back, made_x, made_y + 1)
        return ok

    def symbols(self, word: str) -> str:
        return "".join(self.letters[b] for b in word.encode())

    def merge(self, word: str) -> list[int]:
        """Exact merging of one word: lowest rank first, leftmost of equals."""
        parts = list(self.symbols(word))
        parts[-1] += self.end
        if len(parts) > 64:
            return self._merge_long(parts)
        while len(parts) > 1:
            ranks = [self.rank.get(p, _NEVER) for p in zip(parts, parts[1:], strict=False)]
            best = min(ranks)
            if best == _NEVER:
                break
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.vocab[p] for p in parts]

    def _merge_long(self, parts: list[str]) -> list[int]:
        """The same with a heap, for words whose length would make repeated scans slow."""
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := self.rank.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue  # one of the two was merged meanwhile
            parts[i], parts[j], after[i] = a + b, "", after[j]
            if after[j] < n:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n and (r := self.rank.get((parts[left], parts[right]))) is not None:
                    heapq.heappush(heap, (r, left, parts[left], parts[right]))
        return [self.vocab[p] for p in parts if p]

    def _propose(self, word: str) -> list[int] | None:
        """Greedy longest match; None if some place has no match."""
        text, ids, at = self.symbols(word), [], 0
        n = len(text)
        while at < n:
            for to in range(min(n, at + self.longest), at, -1):
                piece = text[at:to]
                if (i := self.match.get(piece + self.end if to == n else piece)) is not None:
                    ids.append(i)
                    at = to
                    break
            else:
                return None
        return ids

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Token ids of each (non-empty, pre-tokenized) word."""
        found = [self._propose(w) for w in words]
        sizes = np.array([len(f) if f else 0 for f in found], np.int64)
        flat = np.array([i for f in found if f for i in f], np.int64)
        if len(flat) > 1:
            owner = np.repeat(np.arange(len(words)), sizes)
            inner = np.flatnonzero(owner[1:] == owner[:-1])
            bad = inner[~self._compatible(flat[inner], flat[inner + 1])]
            for i in np.unique(owner[bad]).tolist():
                found[i] = None
        return [self.merge(w) if f is None else f for w, f in zip(words, found, strict=True)]

    def know(self, words: set[str], most: int = 600_000) -> None:
        """Have the ids (little-endian bytes) and decoded text of at least the given words at hand; forget at `most`."""
        new = [w for w in words if w not in self._ids]
        if new:
            if len(self._ids) + len(new) > most:
                self._ids, self._texts, new = {}, {}, list(words)
            for w, ids in zip(new, self.encode_words(new), strict=True):
                self._ids[w] = np.array(ids, "<u4").tobytes()
                self._texts[w] = self.joint.join([self.names[i] for i in ids])

    def segments(self, text: str) -> list[tuple[int | None, list[str]]]:
        """(special id or None, words) of each stretch of text."""
        parts = self.split_special.split(text) if self.split_special and "<|" in text else [text]
        return [(self.special[p], []) if p in self.special else (None, self.words(self.normal(p))) for p in parts if p]

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids, special tokens included, as the file's decoder joins them."""
        text = self.joint.join([self.names[i] for i in ids.tolist()])
        if self.joint:
            return text
        back = {c: b for b, c in enumerate(self.letters)}
        return bytes(back[c] for c in text).decode("utf-8", "replace")

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        return [ids for ids, _ in self._both(texts, False)]

    def _both(self, texts: list[str], decode: bool):
        split = [self.segments(t) for t in texts]
        self.know(set().union(*(words for s in split for _, words in s)))
        ids_of, text_of = self._ids.__getitem__, self._texts.__getitem__
        for s in split:
            ids = b"".join([np.array([i], "<u4").tobytes() if i is not None else b"".join(map(ids_of, words)) for i, words in s])
            if not decode:
                yield ids, ""
            elif self.joint:
                yield ids, self.joint.join([x for i, words in s for x in ([self.names[i]] if i is not None else map(text_of, words))])
            else:
                yield ids, self.decode(np.frombuffer(ids, "<u4"))

    def round_trip(self, texts: list[str]):
        """(ids, decoded text) of each text; words are decoded once each where the decoder only joins tokens."""
        return self._both(texts, True)


def model_of(path: str) -> BpeModel:
    """The model at path, read once in each Python process."""
    kept = sys.modules.setdefault("_reelframe_bpe", types.ModuleType("_reelframe_bpe"))
    if path not in vars(kept):
        vars(kept)[path] = BpeModel(path)
    return vars(kept)[path]


def chunks(items: list[str], most: int = 4_000_000):
    """Runs of items of about `most` characters at least one item each."""
    run, size = [], 0
    for x in items:
        run.append(x)
        size += len(x)
        if size >= most:
            yield run
            run, size = [], 0
    if run:
        yield run


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens long, ids array<int>) for each row of docs; path is the tokenizer file on every executor.

    Null texts are empty and have no ids. Strings of the file's added tokens in a text become those tokens. Row by row:
    repeated rows, null ids and further columns need nothing special; an empty table gives no rows.
    """

    def run(batches):
        model = model_of(path)
        for b in batches:
            at = 0
            for texts in chunks(strings_of(b.column(1))):
                ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in model.encode_batch(texts)]
                sizes = np.array([len(x) for x in ids], np.int64)
                flat = pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32))
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), flat)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)), pa.array(sizes), lists], names=["doc_id", "n_tokens", "ids"])
                at += len(texts)

    return map_texts(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, n_tokens long, ids array<int>", 1)


def bpe_decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of bpe_encode's rows; null ids decode to the empty text.

    Row by row: repeated rows, null doc_ids and further columns need nothing special; an empty table gives no rows.
    """

    def run(batches):
        model = model_of(path)
        for b in batches:
            texts = [model.decode(np.array(x or [], np.int64)) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def bpe_round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens long, ids binary, decoded string): encoding and decoding in one pass over the texts.

    ids are little-endian unsigned 32-bit integers. Odd rows as in bpe_encode.
    """

    def run(batches):
        model = model_of(path)
        for b in batches:
            at = 0
            for texts in chunks(strings_of(b.column(1))):
                both = list(model.round_trip(texts))
                ids = [x for x, _ in both]
                cols = [b.column(0).slice(at, len(texts)), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([t for _, t in both], pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "ids", "decoded"])
                at += len(texts)

    return map_texts(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, n_tokens long, ids binary, decoded string", 1)
