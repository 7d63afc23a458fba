"""Shared helpers of the training-data operators: work folders, text batches, connected components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, set here only where nothing set it.

    Without it a temporary folder serves in local mode; elsewhere executors couldn't read it, so that is a ValueError.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="reelframe-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def work_dir(spark: SparkSession, label: str) -> str:
    """A path below the shared folder at which nothing is yet; what is written there goes when the driver ends."""
    top = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(top)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(path)
    system.deleteOnExit(path)
    return f"{top}/rows"


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared folder and cut its lineage."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch, at: int, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Runs of a batch's rows whose texts (column `at`) hold about `most` bytes, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def release() -> None:
    """Give memory that this Python process no longer uses back to the system; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def map_texts(df: DataFrame, run: Callable, schema, at: int) -> DataFrame:
    """df.mapInArrow(run, schema), where run gets slices of the batches by the bytes of their texts, column `at`."""

    def outer(batches):
        yield from run(part for b in batches for part in slices(b, at))
        release()

    return df.mapInArrow(outer, schema)


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def strings_of(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def key_bits(column: Column, low: int, width: int) -> Column:
    """Bits low .. low+width-1 of a long column."""
    return F.shiftrightunsigned(column, low).bitwiseAND(F.lit((1 << width) - 1))


class Forest:
    """Union-find over 0..n-1 that keeps the smallest member as root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True

    def roots(self) -> np.ndarray:
        return np.fromiter((self.find(i) for i in range(len(self.up))), np.int64, len(self.up))


def _shrink(batches):
    """Replace the edges of one partition by stars with the same components."""
    us, vs = [], []
    for b in batches:
        us.append(b.column(0).to_numpy())
        vs.append(b.column(1).to_numpy())
    if not us:
        return
    u, v = np.concatenate(us), np.concatenate(vs)
    names, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    forest = Forest(len(names))
    for a, b in zip(flat[: len(u)].tolist(), flat[len(u) :].tolist(), strict=True):
        forest.join(a, b)
    root = forest.roots()
    moved = np.flatnonzero(root != np.arange(len(names)))
    yield pa.RecordBatch.from_arrays([pa.array(names[moved]), pa.array(names[root[moved]])], names=["u", "v"])


def join_groups(rows: DataFrame, groups: DataFrame, key: str, total: int) -> DataFrame:
    """rows joined with groups (a row for each key, n: how many rows it has), `total` being the rows' number or more.

    Groups of over a thousandth of the rows, 1,000 at most, are sent to where their rows are; the others meet them.
    """
    bound = max(100, total // 1000)
    many = F.broadcast(groups.where(F.col("n") >= bound).drop("n"))
    few = rows.join(many.select(key), key, "left_anti").join(groups.where(F.col("n") < bound).drop("n"), key)
    return few.unionByName(rows.join(many, key))


def connected_components(edges: DataFrame, rounds: int = 60, link: Callable | None = None) -> DataFrame:
    """(node long, root long) for each node of edges (u long, v long); root is the component's smallest node.

    link, if given, makes the edges from the Arrow batches of each partition of `edges`, which then may be any rows.
    Star contraction: every round hangs larger neighbours on the smallest one known (large step) and then does the
    same with the smaller neighbours (small step). Stops when a round changes nothing. A hub is never gathered in one
    task: its smallest neighbour comes from partial aggregation, and nodes with over a thousandth of the ends (so there
    are 1,000 at most) have it sent to their edges. Self-loops and null ends are ignored.
    """
    if link is None:
        edges = edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select("u", "v")
    e = cut(edges.mapInArrow(lambda batches: _shrink(link(batches) if link else batches), "u long, v long").distinct())

    def hang(rows: DataFrame, low: DataFrame, ends: int) -> DataFrame:
        """(v, m) of each row (u, v): m is that of u."""
        return join_groups(rows, low, "u", ends).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")

    now, last = _state(e), None
    for _ in range(rounds):
        if now == last:
            break
        last, ends = now, 2 * now[0]
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = hang(both.where("v > u"), low, ends)
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = hang(large, low, ends).union(low.select("u", F.col("m").alias("v")))
        e = cut(small.distinct())
        now = _state(e)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    own = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(own)


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
