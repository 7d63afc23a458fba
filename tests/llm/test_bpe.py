import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from reelframe.llm.bpe import BpeModel, bpe_decode, bpe_encode
from reelframe.llm.queries import op1_bpe


@pytest.fixture(scope="module", params=["word_bpe_49k.json", "byte_bpe_50k.json"])
def both(request):
    path = public_tokenizers.path(request.param)
    return BpeModel(path), Tokenizer.from_file(path), path


def same(both, texts):
    model, lib, _ = both
    for text, (ids, decoded) in zip(texts, model.round_trip(texts), strict=True):
        want = lib.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, text
        assert decoded == lib.decode(want, skip_special_tokens=False), text
    assert [x for x, _ in model.round_trip(texts)] == model.encode_batch(texts)


ODD = ["", " ", "a", "  two  spaces \n\n tabs\t", "don't I'LL we've", "ΣΑΣ ΟΔΟΣ İstanbul ſtraße", "é café", "日本語テキスト 123 ½²", "👩‍👩‍👧 emoji ☕", "x\x00y\x1cz\x85w v u",
       "a<|endoftext|>b <|startoftext|><|endoftext|>", "<|endoftex", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "the " * 3000, "İıẞ", "z" * 5000, "xyz" * 40_000, "banana" * 30 + " " + "ñandú" * 50]


def test_odd_texts(both):
    same(both, ODD)


def test_every_code_point(both):
    """Alone, and after a combining mark: Unicode versions differ in letters, cases and the order of marks."""
    model, lib, _ = both
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for form in ("a{}b ", "A\u0323{}\u0301 "):
        texts = ["".join(form.format(chr(c)) for c in points[i : i + 400]) for i in range(0, len(points), 400)]
        for t in texts:
            want = lib.pre_tokenizer.pre_tokenize_str(lib.normalizer.normalize_str(t) if lib.normalizer else t)
            assert list(map(model.symbols, model.words(model.normal(t)))) == [w for w, _ in want], t
        same(both, texts[::97])


def test_random_texts(both):
    rng = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyzéüñß ABC'.,-0123\n\tаб中Σ"
    same(both, ["".join(rng.choice(letters) for _ in range(rng.randrange(200))) for _ in range(300)])
    same(both, ["".join(rng.choice("aeinst ") for _ in range(300)) for _ in range(100)])


def test_documents(both):
    same(both, [t or "" for t in pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()])


def test_compatibility_equals_merging(both):
    model = both[0]
    rng = np.random.default_rng(0)
    inner = [i for t, i in model.match.items() if not (model.end and t.endswith(model.end))]
    last = [i for t, i in model.match.items() if not model.end or t.endswith(model.end)]
    a, b = rng.choice(inner, 1500), rng.choice(last, 1500)
    back = {c: k for k, c in enumerate(model.letters)}
    for x, y, ok in zip(a.tolist(), b.tolist(), model._compatible(a, b).tolist(), strict=True):
        text = bytes(back[c] for c in model.names[x] + model.names[y].removesuffix(model.end or "\0"))
        try:
            word = text.decode()
        except UnicodeDecodeError:
            continue
        assert (model.merge(word) == [x, y]) == ok


def test_speculation_mostly_holds(both):
    model = both[0]
    words = [w for t in pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()[:50] for _, ws in model.segments(t or "") for w in ws]
    words = sorted(set(words))
    ids = model.encode_words(words)
    assert np.mean([p == i for p, i in zip(map(model._propose, words), ids, strict=True)]) > 0.5


def test_encode_decode_frames(spark, both):
    _, lib, path = both
    rows = [(i, t, 0) for i, t in enumerate(ODD)] + [(None, None, 1), (0, ODD[4], 2), (0, ODD[4], 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    enc = bpe_encode(df, path)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.ids, r.n_tokens) for r in enc.collect())
    want = sorted((d if d is not None else -1, (e := lib.encode(t or "", add_special_tokens=False).ids), len(e)) for d, t, _ in rows)
    assert got == want
    texts = sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in bpe_decode(enc, path).collect())
    assert texts == sorted((d, lib.decode(i, skip_special_tokens=False)) for d, i, _ in want)
    assert bpe_encode(df.where("false"), path).count() == 0


def test_query(spark, sf):
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op1_bpe(spark, sf).collect():
        ids = lib.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
