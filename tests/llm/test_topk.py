import math
from fractions import Fraction

import numpy as np
import pytest

from reelframe.llm.queries import op5_topk
from reelframe.llm.topk import SlicedBlock, top_k


def slow(rows, k=10, mod=100):
    ok = [(i, np.floor(1024 * np.array(v, float)).astype(int)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, qv in {(i, tuple(v)) for i, v in ok if i % mod == 0}:
        found = sorted((-int(np.dot(qv, v)), i) for i, v in ok if i != q and len(v) == len(qv))[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("drop", [0, 3, 8])
def test_block_equals_brute_force(drop):
    rng = np.random.default_rng(drop)
    for n, d, span in ((1, 3, 5), (70, 8, 600), (500, 16, 3), (200, 4, 2)):
        rows, ids = rng.integers(-span, span + 1, (n, d)), rng.permutation(n) * 3
        b = SlicedBlock(ids, rows, drop)
        for _ in range(10):
            q, skip = rng.integers(-span, span + 1, d), int(rng.choice(ids))
            want = sorted((-int(r @ q), int(i)) for i, r in zip(ids, rows) if i != skip)[:7]
            got = b.top(q, 7, skip)
            assert list(zip((-got[1]).tolist(), got[0].tolist())) == want
        assert b.top(np.zeros(d, int), 3)[0].tolist() == sorted(ids.tolist())[:3]


def test_frames(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).round(3).tolist()) for i in range(350)]
    rows += [(400, rows[0][1]), (401, rows[0][1]), (401, rows[0][1]), (500, None), (502, []), (503, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (600, [float("nan")] * 6), (601, [float("inf")] + [0.0] * 5), (700, [0.0] * 6), (None, [1.0] * 6), (800, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, id int")
    for block, qb in ((64, 2), (10_000, 100)):
        assert sorted(map(tuple, top_k(df, block=block, query_block=qb).drop("wide_score").collect())) == slow(rows)
    assert top_k(df.where("false")).count() == 0


def test_large_components(spark):
    """Products beyond 64 bits rank exactly among the others."""
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=3) * 10.0 ** rng.choice([-1, 6, 9, 15, 30, 300], 3)).tolist()) for i in range(240)]
    rows += [(300, [2.0**53, 0.0, 0.0]), (301, [2.0**53 / 1024, 0.0, 0.0]), (302, [-(2.0**52), 0.0, 0.0])]
    whole = lambda x: math.floor(Fraction(x) * 1024)
    ints = [(i, [whole(x) for x in v]) for i, v in rows]
    want = []
    for q, v in ints:
        if q % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ints if i != q)[:10]
            want += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for block, qb in ((50, 2), (8192, 8192)):
        got = [(r.query_id, r.rank, r.vec_id, int(r.wide_score) if r.score is None else r.score) for r in top_k(df, block=block, query_block=qb).collect()]
        assert sorted(got) == sorted(want)
    small = spark.createDataFrame([(0, [1.0, 2.0]), (1, [-1e30, 0.0]), (2, [-2e30, 0.0])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in top_k(small).orderBy("rank").collect()] == [(1, None), (2, None)]


def test_query(spark, sf):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(map(tuple, op5_topk(spark, sf).collect())) == slow(rows)
