import itertools

import numpy as np
import pytest

from reelframe.llm.lattice import STEPS, Lattice, near_vectors, nearest_e8, unit_rows
from reelframe.llm.queries import op2_lattice


def slow(rows, least=0.98):
    """{vec_id: (n_links, component, kept)} of rows (id, vector, label), all pairs; repeated rows count once."""
    fine = lambda v: v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    nodes = [*dict.fromkeys((i, tuple(v), lab) for i, v, lab in rows if i is not None and lab is not None and fine(v))]
    up, links = list(range(len(nodes))), [0] * len(nodes)
    for a, b in itertools.combinations(range(len(nodes)), 2):
        (_, x, lx), (_, y, ly) = nodes[a], nodes[b]
        if lx == ly and len(x) == len(y):
            x, y = np.array(x, float), np.array(y, float)
            if x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                links[a] += 1
                links[b] += 1
                ra, rb = up[a], up[b]
                up = [min(ra, rb) if u in (ra, rb) else u for u in up]
    out = {}
    for i, _, _ in rows:
        at = [k for k, n in enumerate(nodes) if n[0] == i]
        comp = min((nodes[k][0] for k in range(len(nodes)) if up[k] in {up[a] for a in at}), default=i)
        out[i] = (sum(links[a] for a in at), comp, comp == i or i is None)
    return out


def make(seed, d=64):
    rng = np.random.default_rng(seed)
    rows, i = [], 0
    for size in [1] * 60 + [2, 3, 5, 40]:
        base, label = rng.normal(size=d), int(rng.integers(0, 3))
        for _ in range(size):
            rows.append((i, (base + rng.normal(size=d) * rng.choice([0.0, 0.05, 0.1, 0.13])).astype(np.float32).tolist(), label))
            i += 1
    return rows


def result(df, **kw):
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(df, **kw).collect()}


SCHEMA = "vec_id long, embedding array<float>, label int, node string, n int"


def test_decoder_finds_the_nearest_point():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 8)) * 3
    p = nearest_e8(x)
    twice = 2 * p
    assert (twice == np.round(twice)).all() and ((twice % 2).ptp(1) if hasattr(twice, "ptp") else np.ptp(twice % 2, axis=1)).max() == 0 and (p.sum(1) % 2 == 0).all()
    best = ((x - p) ** 2).sum(1)
    assert (best <= 1 + 1e-9).all()
    for v in STEPS:
        assert (((x - p - v) ** 2).sum(1) >= best - 1e-9).all()
    assert len(np.unique(STEPS, axis=0)) == 240 and (nearest_e8(STEPS) == STEPS).all()


@pytest.mark.parametrize("block", [4096, 7])
def test_equals_brute_force(spark, block):
    rows = make(1) + [(500, None, 1), (501, [], 1), (502, [0.0] * 64, 1), (503, [None] + [1.0] * 63, 1), (504, [float("nan")] * 64, 1), (505, [float("inf")] + [0.0] * 63, 1)]
    one, other = rows[0], rows[-10]
    rows += [(600, one[1], one[2]), (600, one[1], one[2]), (601, one[1], None), (602, one[1], (one[2] + 1) % 3), (603, one[1], one[2]), (604, [2 * x for x in one[1]], one[2])]
    rows += [(605, [1.0, 2.0], 0), (606, [2.0, 4.0], 0), (None, one[1], one[2]), (other[0], other[1], other[2])]
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], SCHEMA).repartition(3)
    assert result(df, block=block) == slow(rows)
    assert near_vectors(df, block=block).count() == len(rows)


def test_empty_table(spark):
    assert near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_recall_at_the_threshold():
    rng = np.random.default_rng(3)
    x = unit_rows(rng.normal(size=(2000, 64)))
    z = rng.normal(size=x.shape)
    z = unit_rows(z - (z * x).sum(1, keepdims=True) * x)
    y = 0.9801 * x + (1 - 0.9801**2) ** 0.5 * z
    lattice = Lattice()
    a, b = lattice.cells(x), lattice.cells(y)
    met = [((a[:, t, :1] == b[:, t]) | (b[:, t, :1] == a[:, t])).any(1) for t in range(lattice.tables)]
    assert np.any(met, axis=0).mean() >= 0.99


def test_query(spark, sf):
    rows = [(r.vec_id, list(r.embedding), r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in op2_lattice(spark, sf).collect()}
    assert got == slow(rows)
