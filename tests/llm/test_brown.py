import math
import zlib
from collections import Counter

import numpy as np
import pytest

from reelframe.llm.brown import END, exchange, fit_brown, place, score_brown
from reelframe.llm.queries import op4_brown


def tokens(text):
    return [w for w in (text or "").encode().lower().split()] + [END]


def likelihood(pairs, cls, k):
    n = np.zeros((k, k))
    for (a, b), v in np.ndenumerate(pairs):
        n[cls[a], cls[b]] += v
    f = lambda x: (x * np.log(np.maximum(x, 1))).sum()
    return f(n) - f(n.sum(0)) - f(n.sum(1))


def test_exchange_reaches_a_local_best():
    rng = np.random.default_rng(0)
    pairs = rng.integers(0, 9, (14, 14)) * (rng.random((14, 14)) < 0.5)
    cls = exchange(pairs, 3, sweeps=50)
    assert cls[-2:].tolist() == [3, 4]
    best = likelihood(pairs, cls, 5)
    assert best >= likelihood(pairs, np.r_[np.arange(12) % 3, 3, 4], 5)
    for w in range(12):
        for k in range(3):
            other = cls.copy()
            other[w] = k
            assert likelihood(pairs, other, 5) <= best + 1e-6


def test_place_takes_the_class_of_the_best_likelihood():
    rng = np.random.default_rng(3)
    m, k = 12, 3
    pairs = rng.integers(0, 6, (m + 2, m + 2)) * (rng.random((m + 2, m + 2)) < 0.5)
    cls = np.r_[rng.integers(0, k, m - 4), [k] * 4, k, k + 1]  # four words to place
    n = np.zeros((k + 2, k + 2))
    np.add.at(n, (cls[:, None], cls[None]), pairs)
    table = np.zeros((4, 2 * (k + 2) + 1))
    for slots, w in zip(table, range(m - 4, m)):
        for o in range(m + 2):
            if o != w:
                slots[cls[o]] += pairs[w, o]
                slots[k + 2 + cls[o]] += pairs[o, w]
        slots[-1] = pairs[w, w]
    got = place(n, table)
    for i, w in enumerate(range(m - 4, m)):
        found = []
        for c in range(k):
            other = cls.copy()
            other[w] = c
            found.append(likelihood(pairs, other, k + 2))
        assert found[got[i]] >= max(found) - 1e-9


def test_exchange_finds_planted_classes():
    group = np.arange(20) % 2
    pairs = np.where(group[:, None] != group[None, :], 50, 1)
    pairs = np.pad(pairs, (0, 2))
    cls = exchange(pairs[:, :], 2)
    assert len({(g, c) for g, c in zip(group, cls[:20])}) == 2


def slow(train, text, model):
    """(n_tokens, n_known, base, score) token by token from the model's classes and plain counts."""
    c = Counter(w for t in train for w in tokens(t))
    n, v = sum(c.values()), len(c)
    classes = lambda w: model.classed.get(w, len(model.transitions) - 2)
    in_class = Counter()
    for w, k in c.items():
        in_class[classes(w)] += k
    other = len(model.transitions) - 2
    v_other = sum(1 for w in c if classes(w) == other)
    base = score = 0.0
    before = other + 1
    for w in tokens(text):
        k = classes(w)
        uni = (c[w] + 1) / (n + v + 1)
        emit = 1.0 if w == END else (c[w] + 1) / (in_class[other] + v_other + 1) if k == other else c[w] / in_class[k]
        base += math.log10(uni)
        score += math.log10(model.mix * model.transitions[before, k] * emit + (1 - model.mix) * uni)
        before = k
    return len(tokens(text)), sum(c[w] > 0 for w in tokens(text)), base, score


TEXTS = [None, "", "A b\ta\x0bB c", "a b c a b d", "é É x y", "the cat sat on the mat", "the dog sat on the cat", "word " * 30_000, "a b c a b d", " \r\n", "one two three two one"]


@pytest.mark.parametrize("frequent", [200_000, 6])
def test_equals_token_by_token(spark, frequent):
    rows = [(i, t, 1) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, word int").repartition(3)
    train = df.where("doc_id % 3 <> 1")
    model = fit_brown(train, classes=3, clustered=6, frequent=frequent)
    held = spark.createDataFrame([(None, "zz the yy a zz", 0), (50, "qq", 0), (50, "qq", 0)], "doc_id long, text string, word int")
    got = score_brown(df.union(held), model).collect()
    texts = {**dict(enumerate(TEXTS)), None: "zz the yy a zz", 50: "qq"}
    assert len(got) == len(TEXTS) + 3
    for r in got:
        n, known, base, score = slow([t for i, t in enumerate(TEXTS) if i % 3 != 1], texts[r.doc_id], model)
        assert (r.n_tokens, r.n_known) == (n, known)
        assert abs(r.base_score - base) < 1e-6 and abs(r.score - score) < 1e-6
        assert abs(r.perplexity - 10 ** (-r.score / n)) < 1e-6 * r.perplexity


def test_transitions_and_emissions_sum_to_one(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    model = fit_brown(df, classes=2, clustered=5)
    assert np.allclose(model.transitions.sum(1), 1)
    for k in range(2):
        words = [w for w, c in model.classed.items() if c == k]
        counts = dict(zip(model.frequent.to_pylist(), model.c.tolist()))
        assert abs(sum(counts[w] for w in words) - model.sizes[k]) < 1e-9


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    model = fit_brown(none)
    assert score_brown(none, model).count() == 0
    r = score_brown(spark.createDataFrame([(1, "a")], "doc_id long, text string"), model).first()
    assert (r.n_tokens, r.n_known, r.base_score) == (2, 0, 0.0)


def test_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 7 == 2 for r in rows}
    c = Counter(w for r in rows if not held[r.doc_id] for w in tokens(r.text))
    n, v = sum(c.values()), len(c)
    got = {r.doc_id: r for r in op4_brown(spark, sf).collect()}
    assert len(got) == len(rows)
    for r in rows:
        g, t = got[r.doc_id], tokens(r.text)
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (held[r.doc_id], len(t), sum(c[w] > 0 for w in t), n)
        assert abs(g.base_score - sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)) < 1e-6 * len(t)
    out = [g for g in got.values() if g.held_out]
    assert sum(g.score for g in out) > sum(g.base_score for g in out)


@pytest.mark.parametrize("frequent", [200_000, 3])
def test_later_words_get_the_class_of_their_kind(spark, frequent):
    """Words of two kinds take turns; only the two most frequent are exchanged, the later ones behave like one of them."""
    texts = ["a b " * 40] + [f"a y{i} a y{i} x{i} b x{i} b" for i in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    model = fit_brown(df, classes=2, clustered=2, frequent=frequent)
    cls = model.classed
    assert len(cls) == len({w for t in texts for w in tokens(t)}) and max(k for w, k in cls.items() if w != END) < 2
    assert cls[b"a"] != cls[b"b"]
    assert {cls[b"x%d" % i] for i in range(30)} == {cls[b"a"]} and {cls[b"y%d" % i] for i in range(30)} == {cls[b"b"]}
    size = Counter()
    for w, c in Counter(w for t in texts for w in tokens(t)).items():
        size[cls[w]] += c
    assert [size[k] for k in range(4)] == model.sizes.tolist()


def test_exchange_sweeps_until_nothing_moves():
    rng = np.random.default_rng(1)
    pairs = np.pad(rng.poisson(0.3, (400, 400)), (0, 2))
    assert exchange(pairs, 12).tolist() == exchange(pairs, 12, sweeps=1000).tolist()
