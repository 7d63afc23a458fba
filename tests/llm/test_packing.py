import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from reelframe.llm.packing import Limits, pack_documents, place, plan
from reelframe.llm.queries import op7_packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def simulate(steps, histogram, limits):
    """Contents of each sequence; checks that steps give every piece one place and respect every capacity."""
    bins, ranks = defaultdict(list), Counter()
    for s in steps:
        assert s.first_rank == ranks[s.length]
        ranks[s.length] += s.bins * s.each
        for b in range(s.first_bin, s.first_bin + s.bins):
            assert s.offset == sum(bins[b])
            bins[b] += [s.length] * s.each
    assert ranks == Counter(histogram)
    for c in bins.values():
        assert sum(c) <= limits.tokens and len(c) <= limits.documents and sum(x * x for x in c) <= limits.attention
    return bins


def one_by_one(histogram, limits, weights=(1.0, 0.25, 0.25)):
    """Best fit decreasing of single pieces by the norm of what is left."""
    top, bins = limits.vector(), []
    for length in sorted(histogram, reverse=True):
        need = np.array([length, 1, length * length])
        for _ in range(histogram[length]):
            ok = [b for b in bins if (b >= need).all()]
            if ok:
                best = min(ok, key=lambda b: sum(w * ((x - y) / t) ** 2 for w, x, y, t in zip(weights, b, need, top)))
                best -= need
            else:
                bins.append(top - need)
    return len(bins)


@pytest.mark.parametrize("limits", [Limits(), Limits(100, 5, 4000), Limits(64, 100, 10**9), Limits(50, 1, 10**6)])
@pytest.mark.parametrize("score", ["norm", "dot"])
def test_plan_respects_every_capacity(limits, score):
    rng = random.Random(2)
    for _ in range(20):
        top = min(limits.tokens, int(limits.attention**0.5))
        histogram = Counter(rng.randint(1, top) for _ in range(rng.randrange(400)))
        bins = simulate(plan(histogram, limits, score), histogram, limits)
        if score == "norm" and histogram:
            assert len(bins) <= one_by_one(histogram, limits) + 1


def test_plan_is_close_to_the_bound():
    rng = random.Random(1)
    histogram = Counter(rng.randint(1, 1024) for _ in range(20_000))
    need = sum(k * n for k, n in histogram.items()) / 1024
    assert len(simulate(plan(histogram), histogram, Limits())) <= 1.01 * need + 1


def test_too_long_for_a_capacity():
    with pytest.raises(ValueError):
        plan({90: 1}, Limits(100, 5, 4000))


def check_rows(rows, texts):
    lib = Tokenizer.from_file(PATH)
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(texts)
    for d, found in by_doc.items():
        ids = np.array([*lib.encode(texts[d] or "", add_special_tokens=False).ids, 2], "<u4")
        found.sort(key=lambda r: r.piece)
        assert [r.piece for r in found] == list(range(len(found))) and [r.length for r in found][1:] == [1024] * (len(found) - 1)
        at = 0
        for r in found:
            assert r.start == at and 1 <= r.length <= 1024 and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for places in by_seq.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    return len(by_seq)


def test_query(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op7_packing(spark, sf).collect()
    n = check_rows(rows, texts)
    assert n <= 1.02 * sum(r.length for r in rows) / 1024 + 1


def test_odd_rows(spark):
    texts = {1: None, 2: "", 3: "word " * 5000, 4: "a<|endoftext|>b", None: "same", **{i: "same" for i in range(10, 400)}}
    df = spark.createDataFrame([(d, t, 7) for d, t in texts.items()], "doc_id long, text string, length int").repartition(6)
    check_rows(pack_documents(df, PATH).collect(), texts)
    assert pack_documents(df.where("false"), PATH).count() == 0
    twice = pack_documents(df.where("doc_id = 3").union(df.where("doc_id = 3")), PATH, keep_ids=True).collect()
    assert len(twice) == 10 and len({(r.sequence_id, r.offset) for r in twice}) == 10 and all(len(r.ids) == r.length for r in twice)


def test_place_with_few_documents_each(spark):
    df = spark.range(1000).selectExpr("id AS name", "CAST(1 + id % 7 AS int) AS length").repartition(5)
    rows = place(df, Limits(100, 4, 10_000)).collect()
    assert max(Counter(r.sequence_id for r in rows).values()) == 4 and len({r.sequence_id for r in rows}) == 250


def test_columns_of_any_name(spark):
    rows = [(7, 300, "a", 1, None, 5), (8, 300, "b", 2, 3, 6), (8, 1000, "c", 3, 4, 7), (None, 24, None, None, None, None)]
    df = spark.createDataFrame(rows, "_part int, length int, rank string, part int, offset int, c0 int")
    got = place(df)
    assert got.columns == ["_part", "length", "rank", "part", "c0", "sequence_id", "offset"]
    assert sorted((r._part or 0, r.length, r["rank"], r.part, r.c0) for r in got.collect()) == sorted((a or 0, b, c, d, f) for a, b, c, d, _, f in rows)
