import random

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import regex
from tokenizers import Tokenizer

from reelframe.llm.tokens import BYTE_LEVEL, CachedTokenizer, KindsOfChars, WordFinder, word_starts

from .test_bpe import ODD


def test_equals_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib, own = Tokenizer.from_file(path), CachedTokenizer(path, most=3000)
    rng = random.Random(0)
    spaces = ["".join(rng.choice("ab.1'  \n\té\u00a0\u2003s") for _ in range(12)) for _ in range(3000)]
    texts = spaces + ODD + [t or "" for t in pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()]
    for i in range(0, len(texts), 7):
        for t, ids in zip(texts[i : i + 7], own.encode(texts[i : i + 7]), strict=True):
            assert ids.tolist() == lib.encode(t, add_special_tokens=False).ids, t


def test_ranges_equal_properties():
    path = public_tokenizers.path("byte_bpe_50k.json")
    pre = Tokenizer.from_file(path).pre_tokenizer
    find, want = WordFinder(BYTE_LEVEL, pre), regex.compile(BYTE_LEVEL).findall
    for c in [*range(0x250), *range(0x2010, 0x2028), *range(0x2030, 0x205F), *range(0x20A0, 0x20C0), 0x1680, 0x2003, 0x2028, 0x3000, 0x300, 0x4E00]:
        for t in (chr(c), f"a{chr(c)}b 1{chr(c)}{chr(c)}\n {chr(c)} .", f"{chr(c)}'s  {chr(c)}  "):
            assert find(t) == want(t), (hex(c), t)


def test_every_code_point():
    """Also those that Unicode versions disagree on."""
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    kinds = KindsOfChars(lib.pre_tokenizer)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(points), 2000):
        text = "".join(f"a{chr(c)}b {chr(c)}1\n{chr(c)}  {chr(c)}{chr(c)}'s" for c in points[i : i + 2000])
        raw = text.encode()
        starts = word_starts(kinds, np.frombuffer(raw + bytes(32), np.uint8), len(raw), np.array([0]))
        ends = [j for _, (_, j) in lib.pre_tokenizer.pre_tokenize_str(text)]
        at = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)  # bytes where characters start
        assert starts.tolist() == at[[0, *ends[:-1]]].tolist()


def test_table_grows_and_starts_anew():
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    for most in (10, 50_000):
        own = CachedTokenizer(path, most=most)
        for i in range(0, 120_000, 30_000):
            text = " ".join(f"w{k * 7919}" + "y" * (k % 20) for k in range(i, i + 30_000))
            for _ in range(2):
                assert own.encode([text, "", text[:50]])[0].tolist() == lib.encode(text, add_special_tokens=False).ids
