"""Best-fit packing under several capacities at once: tokens, documents and attention cost of a sequence.

Pieces of one length are the same to every capacity, so the packing is planned on the histogram of lengths (at most
`capacity` rows, whatever the corpus) and the plan is then dealt out: each piece takes the place of its rank among the
pieces of its length. The plan is what best-fit decreasing over all pieces gives.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, map_texts, texts_of
from .tokens import tokenizer_of


@dataclass(frozen=True)
class Limits:
    """Capacities of one sequence; attention is the sum of squared piece lengths."""

    tokens: int = 1024
    documents: int = 1024
    attention: int = 1024 * 1024

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.documents, self.attention], np.int64)


@dataclass
class Step:
    """`bins` sequences from `first_bin` on each take `each` pieces of one length, the first of them at `offset`."""

    length: int
    first_rank: int
    first_bin: int
    bins: int
    each: int
    offset: int


def plan(histogram: dict[int, int], limits: Limits = Limits(), score: str = "norm", weights: tuple[float, float, float] = (1.0, 0.25, 0.25)) -> list[Step]:
    """Place `histogram[length]` pieces of each length, longest first.

    A piece goes to the open sequence that has room in every capacity and the best score: "norm" takes the smallest
    weighted norm of what would be left, "dot" the largest weighted dot product of the piece and what is left (both by
    shares of the capacities). Sequences in the same state are handled together. Only if none has room are new ones
    opened. ValueError if a piece alone exceeds a capacity.
    """
    top, w = limits.vector(), np.array(weights)
    left = np.empty((0, 3), np.int64)  # residual capacities of each group of sequences
    first, count, filled = (np.empty(0, np.int64) for _ in range(3))
    steps: list[Step] = []
    opened = 0
    for length in sorted(histogram, reverse=True):
        need, n, rank = np.array([length, 1, length * length], np.int64), histogram[length], 0
        if (need > top).any():
            raise ValueError(f"a piece of {length} exceeds {limits}")
        fits = np.maximum(need, 1)
        room = (left // fits).min(1)
        open_ = np.flatnonzero(room > 0)
        if score == "norm":
            order = open_[np.argsort((w * ((left[open_] - need) / top) ** 2).sum(1), kind="stable")]
        elif score == "dot":
            order = open_[np.argsort(-(w * (need / top) * (left[open_] / top)).sum(1), kind="stable")]
        else:
            raise ValueError(score)
        more: list[tuple[np.ndarray, int, int, int]] = []

        def put(residual, begin, bins, offset, each):
            nonlocal rank, n
            steps.append(Step(length, rank, begin, bins, each, offset))
            rank, n = rank + bins * each, n - bins * each
            more.append((residual - each * need, begin, bins, offset + each * length))

        for g in order.tolist():
            if not n:
                break
            each, bins = int(room[g]), int(count[g])
            use = min(bins, n // each)
            if use:
                put(left[g], int(first[g]), use, int(filled[g]), each)
            if n and use < bins:
                put(left[g], int(first[g]) + use, 1, int(filled[g]), n)
                use += 1
            first[g], count[g] = first[g] + use, bins - use
        if n:
            each = int((top // fits).min())
            for bins, k in ((n // each, each), (1 if n % each else 0, n % each)):
                if bins:
                    put(top, opened, bins, 0, k)
                    opened += bins
        if more:
            res, a, b, c = zip(*more, strict=True)
            left, first = np.r_[left, np.array(res, np.int64)], np.r_[first, np.array(a, np.int64)]
            count, filled = np.r_[count, np.array(b, np.int64)], np.r_[filled, np.array(c, np.int64)]
        stay = (count > 0) & (left[:, :2] > 0).all(1) & (left[:, 2] > 0)
        left, first, count, filled = left[stay], first[stay], count[stay], filled[stay]
    return steps


def place(pieces: DataFrame, limits: Limits = Limits(), score: str = "norm", weights: tuple[float, float, float] = (1.0, 0.25, 0.25)) -> DataFrame:
    """pieces (length int >= 1, and any other columns) with sequence_id long and offset int.

    Columns of these two names, if pieces has them, are replaced. Repeated rows are as many pieces, nulls in other
    columns are kept, and an empty table gives no rows. Ranks among pieces of one length come from counts by partition,
    so no length, however frequent, meets in one task. The driver gets one row for each length.
    """
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    kinds, own = dict(pieces.dtypes), [f"c{i}" for i in range(len(names))]  # no clash with the columns made here
    rows = cut(pieces.select(*names).toDF(*own)).withColumn("length", F.col(own[names.index("length")])).withColumn("part", F.spark_partition_id())
    counts = cut(rows.groupBy("part", "length").agg(F.count("*").alias("n")))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    steps = plan(histogram, limits, score, weights)
    spark = pieces.sparkSession
    ahead = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "length", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    by = {}
    for s in steps:
        by.setdefault(s.length, []).append((s.first_rank, s.first_bin, s.each, s.offset))
    sent = spark.sparkContext.broadcast({k: np.array(v, np.int64) for k, v in by.items()})

    def deal(batches):
        for b in batches:
            length, rank = b.column(0).to_numpy(), b.column(1).to_numpy()
            where, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for k in np.unique(length).tolist():
                at, table = np.flatnonzero(length == k), sent.value[k]
                row = table[np.searchsorted(table[:, 0], rank[at], side="right") - 1]
                within = rank[at] - row[:, 0]
                where[at], offset[at] = row[:, 1] + within // row[:, 2], row[:, 3] + within % row[:, 2] * k
            yield pa.RecordBatch.from_arrays([*b.columns[2:], pa.array(where), pa.array(offset.astype(np.int32))], names=[*own, "sequence_id", "offset"])

    order = [c for c, n in zip(own, names, strict=True) if not kinds[n].startswith(("map", "variant"))]
    local = F.row_number().over(Window.partitionBy("part", "length").orderBy(*order)) - 1
    ranked = rows.withColumn("local", local).join(base, ["part", "length"]).select("length", (F.col("base") + F.col("local")).alias("rank"), *own)
    kind = ", ".join(f"{c} {kinds[n]}" for c, n in zip(own, names, strict=True))
    return ranked.mapInArrow(deal, f"{kind}, sequence_id long, offset int").toDF(*names, "sequence_id", "offset")


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int | None = 2, keep_ids: bool = False) -> DataFrame:
    """Pieces (doc_id, piece int, start long, length int, ids_crc32 long[, ids array<int>]) of each document's ids.

    A document longer than capacity is cut into pieces of capacity ids; only its first piece may be shorter. Null texts
    are empty and consist of end_id alone (without an end_id they have no piece). Repeated rows and null ids are kept.
    """

    def run(batches):
        tok = tokenizer_of(tokenizer)
        for b in batches:
            ids, sizes = tok.encode_bytes(texts_of(b.column(1)), end_id)
            flat, to = ids.astype("<u4"), np.cumsum(sizes)
            raw = memoryview(flat.tobytes())
            count = -(-sizes // capacity)  # pieces of each document
            of = np.repeat(np.arange(len(sizes)), count)
            piece = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
            ends = sizes[of] - (count[of] - 1 - piece) * capacity
            starts = np.maximum(ends - capacity, 0)
            first = (to - sizes)[of]
            crcs = [zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip((first + starts).tolist(), (first + ends).tolist(), strict=True)]
            cols = [b.column(0).take(pa.array(of)), pa.array(piece.astype(np.int32)), pa.array(starts), pa.array((ends - starts).astype(np.int32)), pa.array(crcs, pa.int64())]
            if keep_ids:  # pieces stand one after the other
                cols.append(pa.ListArray.from_arrays(pa.array(np.append(first + starts, len(flat)).astype(np.int32)), pa.array(flat.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(cols)])

    kind = "doc_id long, piece int, start long, length int, ids_crc32 long" + ", ids array<int>" * keep_ids
    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, kind, 1)


def pack_documents(docs: DataFrame, tokenizer: str, limits: Limits = Limits(), end_id: int | None = 2, keep_ids: bool = False) -> DataFrame:
    """cut_pieces' rows with sequence_id and offset: all documents in as few sequences as best fit finds.

    An empty table gives no rows; further columns of docs are ignored.
    """
    return place(cut_pieces(docs, tokenizer, limits.tokens, end_id, keep_ids), limits)
