"""Embedding near-duplicates by E8 lattice hashing: projections decoded to lattice points, neighbouring cells probed.

Each table projects the unit vectors to eight dimensions and decodes them to points of E8. A vector lives in the cell
of its nearest point (its home) and also looks into the cells of the next nearest ones (its probes). What shares a cell
is compared by cosine in double precision. A pair met in several cells counts in the first of them only, which each
task finds out by decoding the pair's cells again, so pairs are counted where they are met and never sent anywhere.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Forest, connected_components, cut


def _minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8, by rule: two entries +-1, or all +-1/2 with an even number of minus signs."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) / 2 for s in product((1, -1), repeat=8) if s.count(-1) % 2 == 0]
    return np.array(out)


STEPS = _minimal_vectors()


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest integer points of even sum: rounded, and if the sum is odd the worst coordinate rounded the other way."""
    y = np.floor(x + 0.5)
    odd = np.flatnonzero(y.sum(1) % 2 != 0)
    if len(odd):
        off = x[odd] - y[odd]
        worst = np.abs(off).argmax(1)
        y[odd, worst] += np.where(off[np.arange(len(odd)), worst] >= 0, 1, -1)
    return y


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest E8 points of the rows of x (n, 8): the better of the integer and the half-integer candidate."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


@dataclass(frozen=True)
class Lattice:
    """tables projections of unit vectors times scale; probes cells looked into besides the home cell."""

    tables: int = 8
    probes: int = 8
    scale: float = 4.2
    seed: int = 7

    def cells(self, unit: np.ndarray) -> np.ndarray:
        """(n, tables, 1 + probes) cell numbers of unit vectors (n, d); the first of each table is the home."""
        rng = np.random.default_rng(self.seed)
        n, d = unit.shape
        out = np.empty((n, self.tables, 1 + self.probes), np.int64)
        mix = rng.integers(-(2**62), 2**62, 8, dtype=np.int64) | 1
        for t in range(self.tables):
            basis = np.linalg.qr(rng.normal(size=(max(d, 8), 8)))[0][:d] * (self.scale * (max(d, 8) / 8) ** 0.5)
            x = unit @ basis + rng.uniform(0, 1, 8)
            home = nearest_e8(x)
            near = np.argsort(-((x - home) @ STEPS.T), axis=1, kind="stable")[:, : self.probes]
            points = np.concatenate([home[:, None], home[:, None] + STEPS[near]], 1)
            with np.errstate(over="ignore"):
                number = ((2 * points).astype(np.int64) * mix).sum(2) * np.int64(2 * t + 3) + np.int64(t * 0x5DEECE66D)
            out[:, t] = number ^ (number >> np.int64(29))
        return out


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.float64)
    x = x / np.abs(x).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _shares(cells: np.ndarray, i: np.ndarray, j: np.ndarray, t: int) -> np.ndarray:
    """Whether pairs (i, j) meet in table t: the home of one is the home or a probe of the other."""
    a, b = cells[i, t], cells[j, t]
    return (a[:, :1] == b).any(1) | (b[:, :1] == a).any(1)


def _meeting(table: pa.Table, lattice: Lattice, least: float, rows_at_once: int = 256) -> pa.Table:
    """Links between the members of one cell (or of two blocks of it), for each member: what its links weigh, an edge.

    Rows of the result: (u, v, weight): weight is added to u's links; v is null or a neighbour in a spanning forest.
    """
    ids, home = table["rid"].to_numpy(), table["home"].to_numpy(zero_copy_only=False)
    side, weight = table["side"].to_numpy(), table["w"].to_numpy()
    cell, t = table["cell"][0].as_py(), table["t"][0].as_py()
    flat = table["v"].combine_chunks()
    x = unit_rows(flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1))
    links, forest, edges = np.zeros(len(ids), np.int64), Forest(len(ids)), []
    cells = None
    for s in range(0, len(ids), rows_at_once):
        near = x[s : s + rows_at_once] @ x[s:].T >= least - 1e-9
        i, j = np.nonzero(near)
        i, j = i + s, j + s
        fine = (j > i) & (home[i] | home[j])
        if side.any():  # two blocks of one large cell: pairs across only
            fine &= side[i] != side[j]
        i, j = i[fine], j[fine]
        if not len(i):
            continue
        exact = np.einsum("ij,ij->i", x[i], x[j]) >= least
        i, j = i[exact], j[exact]
        if cells is None:
            cells = lattice.cells(x)
        first = ~np.any([_shares(cells, i, j, k) for k in range(t)], axis=0) if t else np.ones(len(i), bool)
        # in table t itself a pair may meet in both homes: the smaller cell counts
        a, b = cells[i, t], cells[j, t]
        at_a, at_b = (a[:, :1] == b).any(1), (b[:, :1] == a).any(1)
        where = np.where(at_a & at_b, np.minimum(a[:, 0], b[:, 0]), np.where(at_a, a[:, 0], b[:, 0]))
        first &= where == cell
        i, j = i[first], j[first]
        np.add.at(links, i, weight[j])
        np.add.at(links, j, weight[i])
        for p, q in zip(i.tolist(), j.tolist(), strict=True):
            if forest.join(p, q):
                edges.append((p, q))
    on = np.flatnonzero(links)
    u = np.r_[ids[on], ids[[p for p, _ in edges]]] if edges else ids[on]
    v = pa.array([None] * len(on) + ids[[q for _, q in edges]].tolist() if edges else [None] * len(on), pa.int64())
    return pa.table({"u": pa.array(u), "v": v, "n": pa.array(np.r_[links[on], np.zeros(len(edges), np.int64)])})


def near_vectors(vectors: DataFrame, least: float = 0.98, lattice: Lattice = Lattice(), block: int = 4096, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links long, component_id long, kept boolean) for each row of vectors.

    Vectors link when their labels are equal and not null, their lengths are equal and their cosine is `least` or more.
    Null, empty and zero vectors, those with null or non-finite components and rows without id or label link with
    nothing. Rows that repeat id, label and vector count once; all rows are returned. Rows that repeat an id with other
    vectors share one result, the sum of their links. A null id has a null component_id and is kept. Further columns are
    ignored; an empty table gives no rows.

    Equal vectors are merged before hashing and weigh as many as they are. Cells with one member end there, without
    their vector having moved. A cell of more than `block` members is cut into blocks that meet two at a time, so no
    task holds more than two blocks.
    """
    spark = vectors.sparkSession
    v = F.col(vec_col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), v.alias("v"))
    good = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v_ok(fine)).distinct()
    merged = cut(good.groupBy("label", "v").agg(F.min("vec_id").alias("rid"), F.count("*").alias("w")).withColumn("node", F.monotonically_increasing_id()))
    merged = merged.select("label", F.size("v").alias("d"), "v", "node", "rid", "w")

    def hash_cells(batches):
        for b in batches:
            node, label, d = b.column(0).to_numpy(), b.column(1), b.column(2).to_numpy()
            lists = b.column(3)
            for size in np.unique(d).tolist():
                at = np.flatnonzero(d == size)
                x = np.array(lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(at), size)
                for s in range(0, len(at), 2048):
                    part = at[s : s + 2048]
                    cells = lattice.cells(unit_rows(x[s : s + 2048]))
                    k = cells.shape[1] * cells.shape[2]
                    who = np.repeat(part, k)
                    cols = [pa.array(node[who]), label.take(pa.array(who)), pa.array(d[who]), pa.array(np.tile(np.repeat(np.arange(cells.shape[1], dtype=np.int32), cells.shape[2]), len(part))), pa.array(cells.reshape(-1)), pa.array(np.tile(np.arange(cells.shape[2]) == 0, len(part) * cells.shape[1]))]
                    yield pa.RecordBatch.from_arrays(cols, names=["node", "label", "d", "t", "cell", "home"])

    label_type = dict(rows.dtypes)["label"]
    key = ["label", "d", "t", "cell"]
    placed = cut(merged.select("node", "label", "d", "v").mapInArrow(hash_cells, f"node long, label {label_type}, d int, t int, cell long, home boolean"))
    full = placed.groupBy(*key).agg(F.count("*").alias("m"), F.max("home").alias("lived")).where("m > 1 AND lived").drop("lived")
    member = placed.join(full, key).withColumn("nb", F.ceil(F.col("m") / F.lit(block)).cast("int")).withColumn("b", F.pmod(F.xxhash64("node"), "nb").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("nb") - 1))
    member = member.withColumn("o", other).select(*key, "node", "home", F.least("b", "o").alias("lo"), F.greatest("b", "o").alias("hi"), (F.col("b") > F.col("o")).cast("int").alias("side"))
    met = member.join(merged.select("node", "v", "w"), "node").withColumnRenamed("node", "rid")
    found = cut(met.groupBy(*key, "lo", "hi").applyInArrow(lambda t: _meeting(t, lattice, least), "u long, v long, n long"))
    counts = found.groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("n"))
    roots = connected_components(found.where("v IS NOT NULL").select("u", "v"))
    tree = merged.join(counts, "node", "left").join(roots, "node", "left").select("label", "v", "rid", "w", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("root", "node").alias("root"))
    least_id = tree.groupBy("root").agg(F.min("rid").alias("component_id"))
    told = tree.join(least_id, "root").select("label", "v", (F.col("n") + F.col("w") - 1).alias("n_links"), "component_id")
    per_id = good.join(told, ["label", "v"]).groupBy("vec_id").agg(F.sum("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = rows.select("vec_id").join(per_id, "vec_id", "left")
    own = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(F.col("vec_id") == own, F.lit(True)).alias("kept"))


def v_ok(fine):
    return F.coalesce(fine, F.lit(False))
