"""Toxicity: cumulative-link ordinal regression on sparse word features, giving expected severity.

P(grade <= k) = sigmoid(cut_k - w.x): one weight vector shared by all ordered thresholds. Labels only tell toxic from
not; the grades of toxic training rows come from how many toxic-leaning words they hold (grade 1 up to the median,
grade 2 above it).
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_texts, texts_of

_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters (lower-cased) and non-ASCII bytes."""
    return text.translate(_LETTERS).split()


PREFIXES = (4, 5, 6, 7)


def features_of(text: bytes) -> Counter[bytes]:
    """Counts of the sparse features of a text: its words, and the words' prefixes (inflected forms share them).

    A word stands for itself with a space behind it; a prefix, in bytes, is shorter than its word.
    """
    found: Counter[bytes] = Counter()
    for w, n in Counter(words_of(text)).items():
        found[w + b" "] += n
        for k in PREFIXES:
            if k < len(w):
                found[w[:k]] += n
    return found


@dataclass
class SeverityModel:
    """weights: feature -> weight; cuts: ascending thresholds, one fewer than there are grades."""

    weights: dict[bytes, float] = field(default_factory=dict)
    cuts: tuple[float, ...] = (50.0, 60.0)

    def logit(self, text: bytes) -> float:
        found = features_of(text)
        return sum(self.weights[w] * (1 + float(np.log(found[w]))) for w in sorted(self.weights.keys() & found.keys()))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def fit_cumulative(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, grades: np.ndarray, width: int, penalty: float = 2e-5, steps: int = 1000) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending cuts by penalised maximum likelihood; (rows, cols, values) is a sparse feature matrix.

    Rows of grade 0, and of the grades above it, count by one over the root of their number, so that the smaller class
    isn't drowned and the larger one not overruled.
    """
    n, top = len(grades), int(grades.max())
    params = np.zeros(width + top)
    each = np.where(grades > 0, max(1, (grades > 0).sum()) ** -0.5, max(1, (grades == 0).sum()) ** -0.5)
    each = each / each.sum()
    share = np.clip(np.cumsum(np.bincount(grades, each, minlength=top + 1))[:-1], 1e-3, 1 - 1e-3)
    first = np.log(share / (1 - share))
    params[width] = first[0]
    params[width + 1 :] = np.log(np.maximum(np.diff(first), 1e-3))  # later cuts as logs of gaps, so they stay in order
    m, v = np.zeros_like(params), np.zeros_like(params)
    for t in range(1, steps + 1):
        w, gaps = params[:width], np.exp(params[width + 1 :])
        cuts = params[width] + np.r_[0, np.cumsum(gaps)]
        z = np.bincount(rows, values * w[cols], minlength=n)
        upper = np.where(grades < top, _sigmoid(cuts[np.minimum(grades, top - 1)] - z), 1.0)
        lower = np.where(grades > 0, _sigmoid(cuts[np.maximum(grades - 1, 0)] - z), 0.0)
        p = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p  # of log p by its two cuts
        dz = (du - dl) * each
        gw = np.bincount(cols, values * dz[rows], minlength=width) + penalty * w
        gc = np.array([(dl * each)[grades == k + 1].sum() - (du * each)[grades == k].sum() for k in range(top)])
        later = gc[::-1].cumsum()[::-1]
        grad = np.r_[gw, later[0], later[1:] * gaps]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        params = params - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return params[:width], params[width] + np.r_[0, np.cumsum(np.exp(params[width + 1 :]))]


def fit_severity(docs: DataFrame, labels: DataFrame, per_class: int = 10_000, least_df: int = 5, least_z: float = 7.0, most_features: int = 4096) -> SeverityModel:
    """Learn severity from a bounded sample: the `per_class` toxic and clean labelled rows of smallest xxhash64(doc_id).

    Features enter if at least `least_df` sampled rows hold them and their shares in the two classes differ by `least_z`
    standard errors; at most `most_features` do, those of the most standard errors. So the driver gets at most
    2 * per_class rows of at most most_features features. Labels with null doc_id or toxic, and repeats of a doc_id, don't
    count. If a class is missing, or no feature tells them apart, the model calls everything clean.
    """
    spark = docs.sparkSession
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    known = known.join(docs.where("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi")
    pick = lambda toxic: known.where(F.col("toxic") > 0 if toxic else F.col("toxic") <= 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).select("doc_id", F.lit(int(toxic)).alias("toxic")).collect()
    picked = {r.doc_id: r.toxic for r in [*pick(True), *pick(False)]}
    if len(set(picked.values())) < 2:
        return SeverityModel()
    ids = spark.createDataFrame(sorted(picked.items()), "doc_id long, toxic int")  # 2 * per_class rows at most
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id")
    rows = cut(rows.groupBy("doc_id", "toxic").agg(F.max("text").alias("text")))

    def count(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):  # few texts at a time: most features stand in one text only
                part = b.slice(at, 256)
                held: list[Counter[bytes]] = [Counter(), Counter()]
                for toxic, t in zip(part.column(0).to_pylist(), texts_of(part.column(1)), strict=True):
                    held[toxic].update(features_of(t).keys())
                names = sorted(held[0].keys() | held[1].keys())
                cols = [pa.array(names, pa.binary()), *(pa.array([h[w] for w in names], pa.int64()) for h in held)]
                yield pa.RecordBatch.from_arrays(cols, names=["word", "clean", "toxic"])

    sizes = Counter(picked.values())
    told = map_texts(rows.select("toxic", "text"), count, "word binary, clean long, toxic long", 1)
    told = told.groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    share = (F.col("clean") + F.col("toxic")) / F.lit(float(sum(sizes.values())))
    gap, spread = F.col("toxic") / F.lit(float(sizes[1])) - F.col("clean") / F.lit(float(sizes[0])), F.sqrt(share * (1 - share) * F.lit(1 / sizes[1] + 1 / sizes[0]))
    told = told.where((F.col("clean") + F.col("toxic") >= least_df) & (F.abs(gap) >= least_z * spread))
    told = told.select("word", gap.alias("gap"), F.when(spread > 0, F.abs(gap) / spread).otherwise(0.0).alias("z")).orderBy(F.desc("z"), "word").limit(most_features)
    vocab = {bytes(r.word): (i, r.gap) for i, r in enumerate(told.collect())}
    if not any(gap > 0 for _, gap in vocab.values()):
        return SeverityModel()
    sent = spark.sparkContext.broadcast({w: i for w, (i, _) in vocab.items()})

    def pack(batches):
        for b in batches:
            packed = []
            for t in texts_of(b.column(2)):
                found = [(sent.value[w], n) for w, n in features_of(t).items() if w in sent.value]
                packed.append(np.array(found, "<i4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(packed, pa.binary())], names=["doc_id", "toxic", "found"])

    sample = map_texts(rows.select("doc_id", "toxic", "text"), pack, "doc_id long, toxic int, found binary", 2).orderBy("doc_id").toArrow()
    y, found = sample["toxic"].to_numpy(), [np.frombuffer(x, "<i4").reshape(-1, 2) for x in sample["found"].to_pylist()]
    rows = np.repeat(np.arange(len(y)), [len(x) for x in found])
    cols, counts = np.concatenate(found).T.astype(np.int64)
    gaps = np.array([gap for _, gap in vocab.values()])[cols]
    heavy = np.bincount(rows, np.where(gaps > 0, counts, 0), minlength=len(y))
    grades = np.where(y > 0, 1 + (heavy > np.median(heavy[y > 0])), 0)
    if grades.max() < 2:
        grades[np.flatnonzero(y > 0)[-1]] = 2
    w, cuts = fit_cumulative(rows, cols, 1 + np.log(counts), grades, len(vocab))
    return SeverityModel({k: float(w[i]) for k, (i, _) in vocab.items()}, tuple(float(c) for c in cuts))


SCORES = "doc_id long, p_grade array<double>, severity double, grade int, toxic boolean"


def _judge(model: SeverityModel, text: bytes) -> tuple[list[float], float, int, bool]:
    above = [1 - c for c in _sigmoid(np.array(model.cuts) - model.logit(text)).tolist()]
    p = [hi - lo for hi, lo in zip([1.0, *above], [*above, 0.0], strict=True)]
    return p, sum(above), int(np.argmax(p)), above[0] >= 0.5


def score_severity(docs: DataFrame, model: SeverityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, p_grade, severity, grade, toxic) for each row: probabilities of the grades, the expected and the most
    probable grade, and whether grade 1 or more has probability 0.5 or more.

    Null, empty and word-less texts have no features, so they get the model's base rates. Repeated rows and null ids
    are scored like any other; further columns are ignored; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            found = [_judge(sent.value, t) for t in texts_of(b.column(1))]
            cols = list(zip(*found, strict=True)) or [(), (), (), ()]
            kinds = (pa.list_(pa.float64()), pa.float64(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "p_grade", "severity", "grade", "toxic"])

    return map_texts(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, SCORES, 1)


def drop_toxic(docs: DataFrame, model: SeverityModel) -> DataFrame:
    """docs without the rows whose text the model calls toxic; columns are those of docs.

    Row by row: null and empty texts stay, repeated rows stay or go together, an empty table gives no rows.
    """
    names, sent = docs.columns, docs.sparkSession.sparkContext.broadcast(model)
    at = names.index("text")

    def run(batches):
        for b in batches:
            keep = pa.array([not (t and _judge(sent.value, t)[3]) for t in texts_of(b.column(at))], pa.bool_())
            yield pa.RecordBatch.from_arrays(b.columns, names=names).filter(keep)

    return map_texts(docs, run, docs.schema, at)
