import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from reelframe.llm.common import work_dir
from reelframe.llm.queries import op6_repair
from reelframe.llm.repair import Grammar, compress, read_ids, read_range, write_ids
from reelframe.llm.tokens import tokenizer_of

PATH = public_tokenizers.path("byte_bpe_50k.json")
RNG = np.random.default_rng(0)


@pytest.mark.parametrize(
    "ids",
    [[], [7], [5, 5], [1] * 1000, [1, 2] * 5000, list(range(3000)), RNG.integers(0, 40, 20_000).tolist(), RNG.zipf(1.5, 30_000).clip(0, 50_000).tolist(), RNG.integers(0, 90_000, 100_000).tolist(), [2**31, 2**31, 3] * 100, ([4, 4, 4, 9] * 37 + [4]) * 50],
)
def test_grammar_round_trip(ids):
    ids = np.array(ids, np.int64)
    g = Grammar(compress(ids, least=3))
    assert g.ids().tolist() == ids.tolist() and len(g) == len(ids)
    for _ in range(20):
        a, b = sorted(RNG.integers(0, len(ids) + 1, 2).tolist())
        assert g.ids(a, b).tolist() == ids[a:b].tolist()
    for k, (left, right) in enumerate(zip(g.lengths, g.lengths, strict=True)):
        assert left == right == g.places[k + 1] - g.places[k]


@pytest.mark.parametrize("least", [2, 3, 12])
def test_no_pair_repeats_in_the_end(least):
    rng = np.random.default_rng(least)
    for ids in (rng.integers(0, 30, 20_000), rng.zipf(1.3, 30_000).clip(0, 50_000), np.repeat(rng.integers(0, 5, 3000), rng.integers(1, 9, 3000)), np.tile(rng.integers(0, 50_000, 700), 30), np.arange(70_000) % 66_000):
        g = Grammar(compress(ids, least))
        assert (g.ids() == ids).all()
        counts, last, seq = {}, {}, g.seq.tolist()
        for i, pair in enumerate(zip(seq, seq[1:], strict=False)):
            if last.get(pair) != i - 1 or pair[0] != pair[1]:  # pairs of equal symbols don't overlap
                counts[pair] = counts.get(pair, 0) + 1
                last[pair] = i
        assert not counts or max(counts.values()) < least


def test_copies_of_a_long_document():
    """Many copies of one document shrink to about a symbol each."""
    one = np.random.default_rng(1).integers(0, 50_000, 3000)
    g = Grammar(compress(np.tile(one, 300)))
    assert len(g.seq) <= 300 + 12 and len(g) == 900_000


def test_real_ids():
    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist()]
    ids, _ = tokenizer_of(PATH).encode_bytes([t.encode() for t in texts], 2)
    blob = compress(ids)
    assert (Grammar(blob).ids() == ids).all() and len(blob) < 0.7 * 2 * len(ids)


def test_repetition_is_compressed():
    ids = np.tile(RNG.integers(0, 50_000, 500), 200)
    assert len(compress(ids)) < len(ids) * 2 / 6


def test_files(spark):
    lib = Tokenizer.from_file(PATH)
    rows = [(5, "b b b"), (None, "nul"), (3, None), (3, ""), (9, "long " * 30_000), (5, "a"), (5, "a"), (1, "x<|endoftext|>y é")] + [(100 + i, f"text number {i} " * (i % 50)) for i in range(300)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, part int").repartition(5)
    path = work_dir(spark, "ids")
    write_ids(df, path, PATH, shard_ids=500)
    got = sorted(read_ids(spark, path).collect(), key=lambda r: r.start)
    want = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    at = 0
    assert len(got) == len(want)
    for r, (d, t) in zip(got, want, strict=True):
        ids = [*lib.encode(t, add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids) == (d, at, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    assert read_range(spark, path, 9, 10, 20).tolist() == lib.encode("long " * 30_000, add_special_tokens=False).ids[10:20]
    assert read_range(spark, path, 77).tolist() == []


def test_empty_table(spark):
    path = work_dir(spark, "ids")
    write_ids(spark.createDataFrame([], "doc_id long, text string"), path, PATH)
    assert read_ids(spark, path).count() == 0


def test_query(spark, sf):
    lib = Tokenizer.from_file(PATH)
    at = 0
    got = {r.doc_id: r for r in op6_repair(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect():
        ids = [*lib.encode(r.text or "", add_special_tokens=False).ids, 2]
        g = got.pop(r.doc_id)
        assert (g.start, g.n_tokens, g.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert not got
