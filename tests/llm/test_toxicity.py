import math
from collections import Counter

import numpy as np

from reelframe.llm.queries import op10_toxicity
from reelframe.llm.toxicity import SeverityModel, drop_toxic, fit_cumulative, fit_severity, score_severity, words_of


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = fit_severity(docs, labels.where("doc_id % 2 = 0"))
    truth = {r.doc_id: r.toxic for r in labels.where("doc_id % 2 = 1").collect()}
    got = {r.doc_id: r for r in score_severity(docs, model).collect()}
    assert np.mean([got[d].toxic == bool(t) for d, t in truth.items()]) >= 0.97
    clean = [d for d, t in truth.items() if not t]
    assert sum(got[d].toxic for d in clean) <= 0.01 * len(clean)
    for r in got.values():
        assert abs(sum(r.p_grade) - 1) < 1e-9 and abs(r.severity - sum(k * p for k, p in enumerate(r.p_grade))) < 1e-9
    kept = {r.doc_id for r in drop_toxic(docs, model).collect()}
    assert kept == {d for d, r in got.items() if not r.toxic}


def test_fit_recovers_order():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 6, 600)
    y = np.digitize(x + rng.logistic(0, 0.3, 600), [1.5, 3.5])
    w, cuts = fit_cumulative(np.arange(600), np.zeros(600, int), x.astype(float), y, 1)
    assert w[0] > 1 and cuts[0] < cuts[1] and abs(cuts[0] / w[0] - 1.5) < 0.3 and abs(cuts[1] / w[0] - 3.5) < 0.3


def test_gradient_is_that_of_the_likelihood():
    rows, cols, values, grades = np.array([0, 1, 2, 2]), np.array([0, 0, 1, 0]), np.ones(4), np.array([0, 1, 2])
    best = fit_cumulative(rows, cols, values, grades, 2, penalty=0.1, steps=4000)

    def loss(w, cuts):
        z = np.array([w[0], w[0], w[0] + w[1]])
        s = lambda v: 1 / (1 + np.exp(-v))
        edges = [-np.inf, *cuts, np.inf]
        each = np.array([1, 2**-0.5, 2**-0.5]) / (1 + 2**0.5)
        return -each @ np.log([s(edges[g + 1] - t) - s(edges[g] - t) for g, t in zip(grades, z)]) + 0.05 * (w @ w)

    at = loss(*best)
    for d in (-0.05, 0.05):
        for k in range(2):
            w, c = best[0].copy(), best[1].copy()
            w[k] += d
            assert loss(w, best[1]) > at - 1e-4
            c[k] += d
            if c[0] < c[1]:
                assert loss(best[0], c) > at - 1e-4


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (None, "idiot idiot", "x"), (2, "", "x"), (2, "fine " * 50_000, "x")], "doc_id long, text string, toxic string")
    model = SeverityModel({b"idiot ": 9.0}, (3.0, 8.0))
    got = [(r.doc_id, r.toxic, r.grade) for r in score_severity(docs, model).collect()]
    assert got == [(1, False, 0), (None, True, 2), (2, False, 0), (2, False, 0)]
    assert drop_toxic(docs, model).count() == 3
    none = spark.createDataFrame([], "doc_id long, toxic int")
    plain = fit_severity(docs, none)
    assert not plain.weights and not any(r.toxic for r in score_severity(docs, plain).collect())
    assert score_severity(docs.where("false"), model).count() == 0


def test_words():
    assert words_of("The IDIOT's, é9x".encode()) == [b"the", b"idiot", b"s", "é".encode(), b"x"]


def test_rarer_sure_words_come_before_frequent_unsure_ones(spark):
    """Of few features, those that tell the classes apart for sure are kept, not those of the largest gap in shares."""
    def text(i):
        toxic = i % 2
        often = (i // 2) % 10 < (8 if toxic else 5)  # gap 0.3, in most rows of both classes
        return ("often " if often else "") + ("zog " if toxic and (i // 2) % 5 == 0 else "") + f"w{i}"
    docs = spark.createDataFrame([(i, text(i)) for i in range(1000)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "CAST(doc_id % 2 AS INT) AS toxic")
    assert set(fit_severity(docs, labels, most_features=1).weights) == {b"zog "}


def test_query_equals_plain_computation(spark):
    """Features, selection, grades, logits, probabilities and severity again, text by text, on whole tables."""
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    toxic = {r.doc_id: int(r.toxic > 0) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.toxic is not None and r.doc_id in docs}

    def features(text):
        out, word = Counter(), []
        for c in [*text.encode(), 32]:
            if chr(c).isascii() and not chr(c).isalpha():
                if word:
                    w = bytes(word).lower()
                    out[w + b" "] += 1
                    out.update(w[:k] for k in (4, 5, 6, 7) if k < len(w))
                word = []
            else:
                word.append(c)
        return out

    ids = sorted(toxic)
    found = {d: features(docs[d]) for d in ids}
    sizes = Counter(toxic.values())
    held = [Counter(w for d in ids if toxic[d] == y for w in found[d]) for y in (0, 1)]
    chosen = []
    for w in held[0].keys() | held[1].keys():
        a, b = held[0][w], held[1][w]
        share, gap = (a + b) / len(ids), b / sizes[1] - a / sizes[0]
        spread = math.sqrt(share * (1 - share) * (1 / sizes[1] + 1 / sizes[0]))
        if a + b >= 5 and abs(gap) >= 7 * spread:
            chosen.append((-(abs(gap) / spread if spread > 0 else 0.0), w, gap))
    chosen = sorted(chosen)[:4096]
    place, leans = {w: i for i, (_, w, _) in enumerate(chosen)}, {w: g for _, w, g in chosen}
    heavy = [sum(n for w, n in found[d].items() if leans.get(w, 0) > 0) for d in ids]
    middle = np.median([h for d, h in zip(ids, heavy) if toxic[d]])
    grades = np.array([0 if not toxic[d] else 1 + (h > middle) for d, h in zip(ids, heavy)])
    cells = [(i, place[w], 1 + math.log(n)) for i, d in enumerate(ids) for w, n in found[d].items() if w in place]
    weights, cuts = fit_cumulative(*(np.array(c) for c in zip(*cells)), grades, len(place))
    got = {r.doc_id: r for r in op10_toxicity(spark, sf).collect()}
    assert got.keys() == docs.keys()
    for d, text in docs.items():
        z = sum(weights[place[w]] * (1 + math.log(n)) for w, n in features(text).items() if w in place)
        above = [1 - 1 / (1 + math.exp(z - c)) for c in cuts]
        p = [1 - above[0], above[0] - above[1], above[1]]
        assert np.allclose(got[d].p_grade, p, atol=1e-6) and abs(got[d].severity - (p[1] + 2 * p[2])) < 1e-6
        if abs(above[0] - 0.5) > 1e-6:
            assert got[d].toxic == (above[0] >= 0.5)
        if sorted(p)[2] - sorted(p)[1] > 1e-6:
            assert got[d].grade == int(np.argmax(p))
