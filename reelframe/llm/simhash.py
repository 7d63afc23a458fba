"""SimHash near-duplicates: fingerprints of word shingles, pigeonhole blocks, Hamming verification.

Fingerprints are cut into five blocks. Two that differ in at most three bits agree in at least two whole blocks, so
they meet under at least one of the ten block pairs. Equal fingerprints are merged before the join, the fingerprints
of one bucket are linked by a spanning forest (never by all their pairs), and the forests are joined into components.

Three of 64 bits are a very close match: half of the copies with a similarity of 0.95 are further apart. For a given
similarity of shingles there are wide prints, sixteen fingerprints side by side: texts whose prints share two whole
blocks of any of the sixteen are compared by the Hamming distance of the whole prints, which estimates the similarity.
"""

from __future__ import annotations

from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Forest, connected_components, cut, join_groups, key_bits, map_texts, texts_of
from .wordarrays import Words

BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
_ONES = np.uint64(0x0101010101010101)


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """SimHash of one UTF-8 text: a bit is 1 if set in over half of the shingles' XXH64 values; no words: 0."""
    tokens = text.lower().split()  # bytes: lower-cases A-Z only and splits at the six ASCII white-space bytes only
    if not tokens:
        return 0
    if len(tokens) < words:
        shingles = [b" ".join(tokens)]
    else:
        shingles = map(b" ".join, zip(*(tokens[i:] for i in range(words)), strict=False))
    h = np.frombuffer(b"".join(map(partial(xxhash.xxh64_digest, seed=seed), shingles)), ">u8").astype(np.uint64)
    starts, bits = np.arange(0, len(h), 255), 0
    for k in range(8):  # eight one-byte counters side by side, summed over at most 255 values at a time
        lanes = np.add.reduceat((h >> np.uint64(k)) & _ONES, starts).view(np.uint8).reshape(-1, 8).sum(0, dtype=np.int64)
        for j in np.flatnonzero(2 * lanes > len(h)):
            bits |= 1 << (8 * int(j) + k)
    return bits


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp long) for each row; null texts are empty and get fingerprint zero."""

    def run(batches):
        for b in batches:
            fps = [fingerprint(t, words, seed) for t in texts_of(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return map_texts(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, fp long", 1)


def bucket_edges(fps: np.ndarray, most: int, dense: int = 1024) -> list[tuple[int, int]]:
    """A spanning forest, as index pairs, of the distinct fingerprints that differ in at most `most` (<= 3) bits.

    Small buckets are compared in full. Large ones are first joined along single-bit flips and then re-split by
    16-bit blocks, where only members of different trees are compared, so a dense ball of copies costs n log n.
    """
    n, forest, edges = len(fps), Forest(len(fps)), []

    def compare(members: np.ndarray) -> None:
        if len(members) <= dense:
            near = np.bitwise_count(fps[members, None] ^ fps[None, members]) <= most
            for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(near, 1))), strict=True):
                if forest.join(a := int(members[i]), b := int(members[j])):
                    edges.append((a, b))
            return
        trees = np.fromiter((forest.find(int(i)) for i in members), np.int64, len(members))
        names, counts = np.unique(trees, return_counts=True)
        largest = names[counts.argmax()]
        for i in members[trees != largest].tolist():  # pairs inside the largest tree need no check
            for j in members[np.bitwise_count(fps[members] ^ fps[i]) <= most].tolist():
                if forest.join(i, j):
                    edges.append((i, j))

    if n <= dense:
        compare(np.arange(n))
        return edges
    order = np.argsort(fps)
    ranked = fps[order]
    for bit in range(64):
        want = ranked ^ np.uint64(1 << bit)
        at = np.minimum(np.searchsorted(ranked, want), n - 1)
        for i in np.flatnonzero((ranked[at] == want) & (want > ranked)).tolist():
            if forest.join(a := int(order[i]), b := int(order[at[i]])):
                edges.append((a, b))
    for low in (0, 16, 32, 48):
        part = (fps >> np.uint64(low)) & np.uint64(0xFFFF)
        order = np.argsort(part, kind="stable")
        for members in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
            if len(members) > 1 and len({forest.find(int(i)) for i in members}) > 1:
                compare(members)
    return edges


def _link(batches, most: int):
    """Edges between the fingerprints of each key; rows come sorted by (key, fp) and a key stays in one partition."""
    held: list[tuple[np.ndarray, np.ndarray]] = []  # batches of the key that is open; put together once, when it ends

    def linked(keys, fps):
        if not len(keys):
            return
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        sizes = np.diff(np.r_[starts, len(keys)])
        two = starts[sizes == 2]
        two = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= most]
        u, v = [fps[two]], [fps[two + 1]]
        for s, k in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            group = fps[s : s + k]
            if pairs := bucket_edges(group.view(np.uint64), most):
                i, j = np.array(pairs).T
                u.append(group[i])
                v.append(group[j])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], names=["u", "v"])

    def told():
        k, f = (np.concatenate(x) for x in zip(*held, strict=True)) if held else (np.empty(0, np.int64),) * 2
        held.clear()
        return linked(k, f)

    for b in batches:
        k, f = b.column(0).to_numpy(), b.column(1).to_numpy()
        if not len(k):
            continue
        if held and held[0][0][0] != k[0]:
            yield from told()
        if k[0] != k[-1]:
            last = np.searchsorted(k, k[-1])
            held.append((k[:last], f[:last]))
            yield from told()
            k, f = k[last:], f[last:]
        held.append((k, f))
    yield from told()


def link_fingerprints(distinct: DataFrame, most: int = 3) -> DataFrame:
    """(node, root): components of distinct fingerprints `fp`, linked at `most` (0..3) or fewer differing bits."""
    if not 0 <= most <= 3:
        raise ValueError("most must be 0..3: five blocks in pairs cover three differing bits")
    fp = F.col("fp")
    keys = [
        F.shiftleft(key_bits(fp, *BLOCKS[a]), 13).bitwiseOR(key_bits(fp, *BLOCKS[b])).bitwiseOR(F.lit(n << 26))
        for n, (a, b) in enumerate(combinations(range(len(BLOCKS)), 2))
    ]
    rows = distinct.select(F.explode(F.array(*keys)).alias("key"), "fp")
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "key").sortWithinPartitions("key", "fp")
    return connected_components(rows, link=lambda batches: _link(batches, most))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, most: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp long, component_id) for each row of docs; component_id is the smallest id reachable by links.

    Null, empty and blank texts have fingerprint zero and link like any other. Repeated rows each give a row. A null
    id never becomes a component_id unless every id of the component is null. An empty table gives an empty result;
    further columns of docs are ignored.
    """
    prints = cut(fingerprints(docs, id_col, text_col, words, seed))
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    roots = link_fingerprints(distinct.select("fp"), most)
    tree = cut(distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "rep", F.coalesce("root", "fp").alias("root")))
    least = tree.groupBy("root").agg(F.min("rep").alias("component_id"), F.count("*").alias("n"))
    named = cut(join_groups(tree, least, "root", tree.count()).select("fp", "component_id"))
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


PRINTS = 16
_PAIRS = tuple(combinations(range(len(BLOCKS)), 2))
_SPREAD = tuple((0x9E3779B97F4A7C15 * (2 * i + 1)) & ((1 << 64) - 1) for i in range(PRINTS))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    for factor in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x = (x ^ (x >> np.uint64(29))) * np.uint64(factor)
    return x ^ (x >> np.uint64(32))


def wide_prints(texts: list[bytes], words: int = 5) -> np.ndarray:
    """(texts, PRINTS) fingerprints of each text's shingles, repeats included; shorter texts are one shingle, blank ones 0."""
    found = Words(texts)
    low, high = found.keys()
    each = _mixed(low ^ _mixed(high))
    for i in found.long.tolist():
        each[i] = xxhash.xxh64_intdigest(found[i], seed=42)
    n = np.diff(found.bounds)
    count = np.where(n == 0, 0, np.maximum(n - words + 1, 1))
    text = np.repeat(np.arange(len(n)), count)
    place = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    first = found.bounds[:-1][text] + place
    h = np.zeros(len(text), np.uint64)
    for k in range(words):
        at = first + k
        here = at < found.bounds[1:][text]
        h = _mixed(h + np.uint64(1)) + np.where(here, each[np.minimum(at, len(each) - 1)], np.uint64(0)) if len(each) else h
    out = np.zeros((len(texts), PRINTS), np.uint64)
    if not len(text):
        return out
    begins = np.flatnonzero(place % 255 == 0)  # one-byte counters hold 255
    owners = text[begins]
    starts = np.flatnonzero(np.r_[True, owners[1:] != owners[:-1]])
    for p, spread in enumerate(_SPREAD):
        x = _mixed(h ^ np.uint64(spread))
        for k in range(8):
            lanes = np.add.reduceat((x >> np.uint64(k)) & _ONES, begins).view(np.uint8).reshape(-1, 8)
            sums = np.add.reduceat(lanes.astype(np.int64), starts)
            ones = 2 * sums > count[owners[starts]][:, None]
            out[owners[starts], p] |= (ones.astype(np.uint64) << (8 * np.arange(8, dtype=np.uint64) + np.uint64(k))).sum(1, dtype=np.uint64)
    return out


def most_bits(least: float) -> int:
    """The distance of wide prints that texts of equal length have whose shingles' similarity (Jaccard) is `least`."""
    return int(64 * PRINTS * np.arccos(2 * least / (1 + least)) / np.pi)


def print_keys(prints: np.ndarray, first: int = 0, last: int = PRINTS) -> np.ndarray:
    """(texts, 10 each) bucket keys of the prints first..last-1: two whole blocks of one, with the numbers of both in front."""
    of, prints = np.arange(first, last, dtype=np.uint64), prints[:, first:last]
    block = [(prints >> np.uint64(low)) & np.uint64((1 << width) - 1) for low, width in BLOCKS]
    out = [block[a] << np.uint64(13) | block[b] | np.uint64(n << 26) | (of << np.uint64(30))[None] for n, (a, b) in enumerate(_PAIRS)]
    return np.stack(out, 2).reshape(len(prints), -1).astype(np.int64)


def near_forest(prints: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Index pairs of a spanning forest of the prints within `most` bits of each other.

    Each tree is grown from one print: what is near to it joins and is looked from in turn, always among those that no
    tree has. So in a group of copies, where the first print is near to most, the work is little more than its size.
    """
    left, edges = np.arange(len(prints)), []
    while len(left):
        grow, left = [int(left[0])], left[1:]
        while grow and len(left):
            at = grow.pop()
            near = np.bitwise_count(prints[left] ^ prints[at]).sum(1, dtype=np.int64) <= most
            edges += [(at, j) for j in left[near].tolist()]
            grow += left[near].tolist()
            left = left[~near]
    return edges


def _groups(batches):
    """Tables of the rows of each key, which come sorted by their first column; a key's rows are put together once."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        k = b.column(0).to_numpy()
        edges = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)] if len(k) else []
        for i, j in zip(edges, edges[1:], strict=False):
            if held and held[0].column(0)[0].as_py() != k[i]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held)


def _buckets(batches):
    """(bucket, node) of the buckets that hold two nodes or more, from (key, node) sorted by key.

    Buckets of the same nodes get the same number.
    """

    def told(keys, nodes):
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        sizes = np.diff(np.r_[starts, len(keys)])
        with np.errstate(over="ignore"):
            name = np.add.reduceat(_mixed(nodes.view(np.uint64)), starts) + _mixed(sizes.astype(np.uint64))
        more = np.repeat(sizes > 1, sizes)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(name, sizes)[more].view(np.int64)), pa.array(nodes[more])], names=["bucket", "node"])

    held: list[tuple[np.ndarray, ...]] = []
    for b in batches:
        cols = tuple(c.to_numpy() for c in b.columns)
        k = cols[0]
        if not len(k):
            continue
        if k[-1] == (held[0][0][0] if held else k[0] - 1):
            held.append(cols)  # the open key goes on
            continue
        last = np.searchsorted(k, k[-1])
        parts = [*held, tuple(c[:last] for c in cols)]
        held = [tuple(c[last:] for c in cols)]
        if sum(len(p[0]) for p in parts):
            yield told(*(np.concatenate(x) for x in zip(*parts, strict=True)))
    if held:
        yield told(*(np.concatenate(x) for x in zip(*held, strict=True)))


def similar_documents(docs: DataFrame, words: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id) for each row: texts link whose word shingles have a similarity (Jaccard) of `least` or more.

    The similarity is what the distance of wide prints tells: 1,024 bits, so within 0.03 of the true one (two standard
    errors) at 0.8. Pairs are looked at that share two whole blocks in one of sixteen prints: by their distances 0.87 of
    those at 0.8, 0.98 at 0.85 and over 0.999 at 0.9. component_id is the smallest id reachable by links. Odd rows as in
    near_duplicates.

    Equal prints are merged first. A bucket's rows are sorted, and only the nodes of buckets with two or more go on; each
    node is joined with its print once, with the list of its buckets (160 at most).
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        for b in batches:
            prints = wide_prints(texts_of(b.column(1)), words)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in prints], pa.binary())], names=["doc_id", "print"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    prints = cut(map_texts(rows, run, "doc_id long, print binary", 1))
    distinct = cut(prints.groupBy("print").agg(F.min("doc_id").alias("rep")).withColumn("node", F.monotonically_increasing_id()))

    def keys_of(batches):
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                keys = print_keys(_as_prints(part.column(1)))
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(np.repeat(part.column(0).to_numpy(), keys.shape[1]))], names=["key", "node"])

    def link(batches):
        for t in _groups(batches):
            t = t.combine_chunks()
            nodes = t["node"].to_numpy()
            edges = near_forest(_as_prints(t["print"]), most_bits(least))
            u, v = np.array(edges, np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([pa.array(nodes[u]), pa.array(nodes[v])], names=["u", "v"])

    keys = distinct.select("node", "print").mapInArrow(keys_of, "key long, node long")
    keys = keys.repartition(parts, "key").sortWithinPartitions("key", "node")
    members = keys.mapInArrow(_buckets, "bucket long, node long").groupBy("node").agg(F.collect_set("bucket").alias("buckets"))
    met = members.join(distinct.select("node", "print"), "node").select(F.explode("buckets").alias("bucket"), "node", "print")
    met = met.repartition(parts, "bucket").sortWithinPartitions("bucket", "node")
    roots = connected_components(met, link=link)
    tree = cut(distinct.join(roots, "node", "left").select("print", "rep", F.coalesce("root", "node").alias("root")))
    least = tree.groupBy("root").agg(F.min("rep").alias("component_id"), F.count("*").alias("n"))
    named = join_groups(tree, least, "root", tree.count()).select("print", "component_id")
    return prints.join(cut(named), "print").select("doc_id", "component_id")


def _as_prints(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, PRINTS)


def drop_near_duplicates(docs: DataFrame, words: int = 5, least: float | None = 0.8, most: int = 3) -> DataFrame:
    """docs without all but one row of each near-duplicate group: the row of the smallest doc_id stays, whole.

    Groups are those of similar_documents, or with least=None those of near_duplicates, at `most` differing bits.

    Of several rows with that doc_id the one that is first by its columns stays; rows without a doc_id all stay, as
    nothing tells them apart. Columns are those of docs, whatever their names; an empty table gives no rows.

    Rows of ids that occur once, the usual case, pass a semi-join with the ids that stay, without being sorted. Only
    repeated ids are ranked: each is dealt to several tasks first, whose first rows are then compared.
    """
    found = near_duplicates(docs, words=words, most=most) if least is None else similar_documents(docs, words, least)
    ids = found.where("doc_id IS NOT NULL").groupBy("doc_id")
    ids = cut(ids.agg(F.count("*").alias("n"), F.max(F.col("doc_id") == F.col("component_id")).alias("stays")).where("stays"))
    once = ids.where("n = 1").select(F.col("doc_id").alias("id")).hint("shuffle_hash")
    key = docs["doc_id"].cast("long")
    out = docs.where(docs["doc_id"].isNull()).union(docs.join(once, key == once["id"], "left_semi"))
    if ids.where("n > 1").isEmpty():
        return out
    names = [f"c{i}" for i in range(len(docs.columns))]
    parts = 16
    rows = docs.toDF(*names)
    at = names[docs.columns.index("doc_id")]
    again = ids.where("n > 1").select(F.col("doc_id").alias("id"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    rows = rows.withColumn("part", F.floor(F.rand(7) * parts).cast("int"))
    rows = rows.join(again, (rows[at].cast("long") == again["id"]) & (rows["part"] == again["part"])).select("id", again["part"], *names)
    whole = F.struct(*names)
    sortable = all(not kind.startswith(("map", "variant")) for _, kind in docs.dtypes)
    first = F.min(whole) if sortable else F.min_by(whole, F.xxhash64(F.to_json(whole)))
    one = rows.groupBy("id", "part").agg(first.alias("row"))
    one = one.groupBy("id").agg((F.min("row") if sortable else F.min_by("row", F.xxhash64(F.to_json("row")))).alias("row"))
    return out.union(one.select(*(F.col(f"row.{c}").alias(n) for c, n in zip(names, docs.columns, strict=True))))
