"""Exact top-k inner products of integer vectors by a bit-sliced index.

Rows are cut into blocks. A block's index holds, for each attribute, its quantised values (v >> drop, from the block's
lowest up) as bit slices: bit s of all rows in one bitmap. A query adds the slices of its attributes, shifted and with
the sign of its weights, by bitmap arithmetic into slices of the coarse score. The top rows are selected from the most
significant slice downward; what quantisation may have cost bounds how far below the k-th coarse score a top row can
lie, and all rows down to there are resolved exactly.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut


class SlicedBlock:
    """Bit slices of a block of integer rows (n, d)."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, drop: int = 4):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows, self.drop = ids[order], rows[order].astype(np.int64), drop
        n = len(self.ids)
        self.n, self.words = n, (n + 63) // 64
        coarse = self.rows >> drop
        self.low = coarse.min(0)
        up = coarse - self.low
        self.bits = [int(m).bit_length() for m in up.max(0)]
        self.slices = [[self._bitmap((up[:, j] >> s) & 1) for s in range(b)] for j, b in enumerate(self.bits)]

    def _bitmap(self, flags: np.ndarray) -> np.ndarray:
        full = np.zeros(self.words * 64, np.uint8)
        full[: self.n] = flags
        return np.packbits(full, bitorder="little").view(np.uint64)

    def _flags(self, bitmap: np.ndarray) -> np.ndarray:
        return np.unpackbits(bitmap.view(np.uint8), bitorder="little")[: self.n].astype(bool)

    def _sum(self, weights: np.ndarray) -> list[np.ndarray]:
        """Slices of sum_j weights[j] * up_j for non-negative weights: one slice of each column at a time, 3 to 2."""
        columns: list[list[np.ndarray]] = []
        for j, w in enumerate(weights.tolist()):
            shift = 0
            while w:
                if w & 1:
                    for s, bitmap in enumerate(self.slices[j]):
                        while len(columns) <= s + shift:
                            columns.append([])
                        columns[s + shift].append(bitmap)
                w, shift = w >> 1, shift + 1
        out: list[np.ndarray] = []
        at = 0
        while at < len(columns):
            column = columns[at]
            carries: list[np.ndarray] = []
            while len(column) > 2:  # full adders
                a, b, c = column.pop(), column.pop(), column.pop()
                half = a ^ b
                column.append(half ^ c)
                carries.append((a & b) | (half & c))
            if len(column) == 2:
                a, b = column
                column = [a ^ b]
                carries.append(a & b)
            out.append(column[0] if column else np.zeros(self.words, np.uint64))
            if carries:
                if at + 1 == len(columns):
                    columns.append([])
                columns[at + 1] += carries
            at += 1
        return out

    def _minus(self, a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
        """Slices of a - b + 2**width (width: the slices given, plus one), so that order is kept and nothing is negative."""
        width = max(len(a), len(b)) + 1
        zero = np.zeros(self.words, np.uint64)
        out, borrow = [], zero
        for s in range(width):
            x, y = a[s] if s < len(a) else zero, b[s] if s < len(b) else zero
            half = x ^ y
            out.append(half ^ borrow)
            borrow = (~x & y) | (~half & borrow)
        out[-1] = ~out[-1]  # the sign: turned round, it is the offset
        return out

    def _at_least(self, score: list[np.ndarray], bound: int) -> np.ndarray:
        """Bitmap of rows whose score, in slices, is >= bound."""
        if bound <= 0:
            return np.full(self.words, ~np.uint64(0))
        if bound >= 1 << len(score):
            return np.zeros(self.words, np.uint64)
        above, equal = np.zeros(self.words, np.uint64), np.full(self.words, ~np.uint64(0))
        for s in range(len(score) - 1, -1, -1):
            if bound >> s & 1:
                equal = equal & score[s]
            else:
                above, equal = above | (equal & score[s]), equal & ~score[s]
        return above | equal

    def top(self, query: np.ndarray, k: int, skip: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best rows, best first, ties to the smaller id; rows with id `skip` don't count."""
        q = query.astype(np.int64)
        valid = np.ones(self.n, bool) if skip is None else self.ids != skip
        left = int(valid.sum())
        if not left or k < 1:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        k = min(k, left)
        score = self._minus(self._sum(np.maximum(q, 0)), self._sum(np.maximum(-q, 0)))
        live = self._bitmap(valid)
        bound, chosen, taken = 0, np.zeros(self.words, np.uint64), 0
        for s in range(len(score) - 1, -1, -1):  # the k-th largest coarse score, most significant slice first
            ones = live & score[s]
            n = int(np.bitwise_count(ones).sum())
            if taken + n >= k:
                bound |= 1 << s
                live = ones
            else:
                chosen, taken, live = chosen | ones, taken + n, live & ~score[s]
        lost = int(np.abs(q).sum()) * ((1 << self.drop) - 1)  # most that exact scores can differ by for equal coarse ones
        slack = -(-lost >> self.drop) if self.drop else 0
        near = np.flatnonzero(self._flags(self._at_least(score, bound - slack)) & valid)
        exact = self.rows[near] @ q
        best = np.lexsort((self.ids[near], -exact))[:k]
        return self.ids[near][best], exact[best]


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id long, v array<double>) of the rows whose vector isn't null, is not empty and holds finite numbers only."""
    v = F.col(vec_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0) & fine & F.col("id").isNotNull())


def _matrices(table: pa.Table, scale: int):
    """(ids, forms, int64 rows) and (ids, forms, rows of Python integers) by length; the latter may overflow 64 bits.

    A pair of the former can't: its components are at most the root of 2**62 over the length.
    """
    out: dict[int, tuple] = {}
    ids, forms = table["id"].to_numpy(), table["form"].to_numpy()
    lists = table["v"].combine_chunks()
    sizes, flat = pc.list_value_length(lists).to_numpy(), lists.flatten().to_numpy()
    starts = np.cumsum(sizes) - sizes
    for d in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == d)
        x = flat[starts[at, None] + np.arange(d)]
        with np.errstate(over="ignore"):
            ints = np.floor(x * scale)
        narrow = (np.abs(ints) <= (2**62 / d) ** 0.5).all(1)
        wide = np.flatnonzero(~narrow)
        big = np.array([[math.floor(c) * scale if abs(c) >= 2**53 else math.floor(c * scale) for c in row] for row in x[wide].tolist()], object).reshape(-1, d)
        out[d] = (ids[at[narrow]], forms[at[narrow]], ints[narrow].astype(np.int64)), (ids[at[wide]], forms[at[wide]], big)
    return out


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> list[tuple[int, int]]:
    return sorted(zip(ids.tolist(), scores.tolist(), strict=True), key=lambda x: (-x[1], x[0]))[:k]


def _ordered(score: int) -> tuple[int, int, str | None]:
    """(-1, 0 or 1: below, within or above 64 bits; the score if within; else a text that sorts as the score does)."""
    if -(2**63) <= score < 2**63:
        return 0, score, None
    text = str(abs(score))
    text = f"{len(text):05d}{text}"
    return (1, 0, text) if score > 0 else (-1, 0, text.translate({48 + i: 57 - i for i in range(10)}))


def top_k(vectors: DataFrame, k: int = 10, query_mod: int = 100, scale: int = 1024, block: int = 8192, query_block: int = 8192, drop: int = 4, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score, wide_score): the k rows of largest integer inner product for each query.

    Components are floor(scale * x). Queries are the rows whose id is divisible by query_mod, candidates all rows but
    those with the query's id. Ties go to the smaller id. Vectors that are null, empty or hold null or non-finite
    components, and rows without id, take no part; nor do candidates whose length differs from the query's. Repeated
    ids are as many candidates; as queries they give one list for each different vector. An empty table: no rows.
    Vectors with components so large that a product could leave 64 bits are multiplied as Python integers and ranked
    with the others; a score that does leave them is null, and wide_score, else null, is its text.

    Rows are dealt evenly into blocks, whatever repeats in them, and so are queries; every block of rows meets every
    block of queries once, in a task that holds these two only. At most k rows of each meeting go on to the ranking.
    """
    found = usable(vectors, id_col, vec_col).withColumn("row", F.monotonically_increasing_id())
    rows = cut(found.withColumn("form", F.xxhash64("v")))
    queries = rows.where(F.col("id") % query_mod == 0).select("id", "form", "v").distinct()
    blocks = lambda df, most: max(1, -(-df.count() // most))
    n_rows, n_queries = blocks(rows, block), blocks(queries, query_block)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = rows.select(F.pmod(F.xxhash64("row"), F.lit(n_rows)).cast("int").alias("part"), each(n_queries).alias("asked"), "id", "form", "v")
    asked = queries.select(each(n_rows).alias("part"), F.pmod(F.xxhash64("id", "form"), F.lit(n_queries)).cast("int").alias("asked"), "id", "form", "v")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(left) and len(right):
            candidates = _matrices(left, scale)
            for d, (narrow, wide) in _matrices(right, scale).items():
                if d not in candidates:
                    continue
                (ids, _, ints), (big_ids, _, big) = candidates[d]
                index = SlicedBlock(ids, ints, drop) if len(ids) else None
                for q, form, v in zip(*narrow, strict=True):
                    best = list(zip(*(x.tolist() for x in index.top(v, k, q)), strict=True)) if index else []
                    if len(big_ids):
                        other = big_ids != q
                        best += _best(big_ids[other], big[other] @ v.astype(object), k)
                    out += [(q, form, i, *_ordered(s)) for i, s in best]
                for q, form, v in zip(*wide, strict=True):
                    best = []
                    for some, them in ((ids, ints), (big_ids, big)):
                        for at in range(0, len(some), 512):
                            part = np.flatnonzero(some[at : at + 512] != q) + at
                            best = sorted(best + _best(some[part], them[part].astype(object) @ v, k), key=lambda x: (-x[1], x[0]))[:k]
                    out += [(q, form, i, *_ordered(s)) for i, s in best]
        cols = list(zip(*out, strict=True)) or [()] * 6
        kinds = dict(zip(("query_id", "form", "vec_id", "over", "score", "text"), (*[pa.int64()] * 3, pa.int32(), pa.int64(), pa.string()), strict=True))
        return pa.table({n: pa.array(c, t) for (n, t), c in zip(kinds.items(), cols, strict=True)})

    met = held.groupBy("part", "asked").cogroup(asked.groupBy("part", "asked")).applyInArrow(meet, "query_id long, form long, vec_id long, over int, score long, text string")
    order = Window.partitionBy("query_id", "form").orderBy(F.desc("over"), F.desc("score"), F.desc("text"), "vec_id")
    best = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    digits = F.substring("text", 6, 100_000)
    wide = F.when(F.col("over") > 0, digits).when(F.col("over") < 0, F.concat(F.lit("-"), F.translate(digits, "0123456789", "9876543210")))
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.when(F.col("over") == 0, F.col("score")).alias("score"), wide.alias("wide_score"))
