"""Token-id files compressed by a Re-Pair grammar per shard, with random access to documents.

A shard holds the ids of consecutive documents. Pairs of neighbouring symbols that repeat are replaced by new
nonterminals, the more frequent first, until no pair repeats often enough to pay for its rule; the rules, the length
each symbol expands to and where each document starts are stored with the remaining sequence, so any range of ids is
decoded from the few symbols that cover it.

A file set is a folder of Parquet files with one row per shard:
  part, shard  place of the shard in document order
  base         ids before the shard within its part
  doc_ids      ids of the documents, in order (null allowed)
  sizes        ids in each document
  blob         the grammar: magic "RPG1", then little-endian uint32 counts (alphabet, rules, symbols), the alphabet
               (uint32 terminals), the rules (two uint32 each: an index below the alphabet's size is a terminal, others
               are earlier rules), the expansion lengths of the rules (uint32) and the sequence (uint16 if alphabet plus
               rules fit, else uint32)
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, texts_of
from .tokens import ranges, tokenizer_of

MAGIC = b"RPG1"


def _second_of_runs(on: np.ndarray) -> np.ndarray:
    """Every other one of neighbouring places, from the second of each run on."""
    first = np.flatnonzero(np.r_[True, np.diff(on) != 1])
    within = np.arange(len(on)) - np.repeat(first, np.diff(np.r_[first, len(on)]))
    return on[within % 2 == 1]


def _ranks(keys: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """The place of each key in pairs (all different), len(pairs) if it isn't there."""
    top, bits = len(pairs), max(18, (16 * len(pairs)).bit_length())
    kind, down = keys.dtype.type, keys.dtype.type(8 * keys.itemsize - bits)
    held, rank, left, spread = np.append(pairs, kind(0)), None, np.arange(top, dtype=np.int32), 0x9E3779B97F4A7C15
    while len(left):
        table = np.full(1 << bits, top, np.int32)
        factor = kind(spread & ((1 << 8 * keys.itemsize) - 1) | 1)
        slots = held[left] * factor >> down
        table[slots] = left
        if rank is None:
            rank = table[keys * factor >> down]
            rank[held[rank] != keys] = top
        else:
            rest = np.flatnonzero(rank == top)
            found = table[keys[rest] * factor >> down]
            good = held[found] == keys[rest]
            rank[rest[good]] = found[good]
        left, spread = left[table[slots] != left], spread * 0xD6E8FEB86659FD93 >> 1 & ((1 << 64) - 1)  # those that lost their slot
    return rank


def compress(ids: np.ndarray, least: int = 12, rounds: int | None = None) -> bytes:
    """The grammar blob of a sequence of ids. No pair stands `least` times or more without overlap in what remains.

    In each round every pair is counted. Those counted `least` times or more are ranked, the most frequent first; a
    place is replaced if its pair ranks before the pairs it overlaps with, and if the pair has `least` such places. So
    the first pair of a round loses no place, and the rounds end with the first that finds no pair. After a round only
    places that can have come to hold a repeating pair are counted again: those beside new symbols, and those of ranked
    pairs that were not replaced. A rule takes 12 bytes and each place saves two: `least` below seven doesn't pay.
    `rounds` is a faster mode, which ends earlier.
    """
    if len(ids) and ids.max() < 1 << 20:
        alphabet = np.flatnonzero(np.bincount(ids))
        index = np.zeros(int(alphabet[-1]) + 1, np.uint32)
        index[alphabet] = np.arange(len(alphabet), dtype=np.uint32)
        seq = index[ids]
    else:
        alphabet, seq = np.unique(ids, return_inverse=True)
        seq = seq.astype(np.uint32)
    left, right, lengths = [], [], np.ones(len(alphabet), np.int64)
    places = None  # where pairs are counted; None: everywhere
    while len(seq) >= 2 * least and len(left) != rounds:
        on = np.arange(len(seq) - 1) if places is None else places
        a, b = (seq[:-1], seq[1:]) if places is None else (seq[on], seq[on + 1])
        wide = len(lengths) > 1 << 16
        kind, half = (np.uint64, 32) if wide else (np.uint32, 16)
        keys = a.astype(kind) << kind(half) | b
        odd = np.zeros(0, np.int64)
        if (same := a == b).any():
            odd = np.searchsorted(on, _second_of_runs(on[same]))
        counted = np.sort(np.delete(keys, odd) if len(odd) else keys)
        at = np.flatnonzero(np.r_[True, counted[1:] != counted[:-1]]) if len(counted) else odd
        n = np.diff(at, append=len(counted))
        often = np.flatnonzero(n >= least)
        if not len(often):
            break
        often = often[np.argsort(-n[often], kind="stable")]
        pairs = counted[at[often]]
        rank, whole = _ranks(keys, pairs), np.full(len(seq) + 1, len(pairs), np.int32)
        ranked = np.flatnonzero(rank < len(pairs))
        again = np.zeros(len(seq), bool)
        again[on[ranked]] = True
        rank[odd] = len(pairs)
        whole[on + 1 if places is not None else slice(1, -1)] = rank  # one place on, so that each has a neighbour
        put, rank = on[ranked], rank[ranked]
        best = np.flatnonzero((rank < len(pairs)) & (rank < whole[put]) & (rank <= whole[put + 2]))
        put, rank = put[best], rank[best]
        used = np.bincount(rank, minlength=len(pairs)) >= least
        put, rank, pairs = put[used[rank]], rank[used[rank]], pairs[used]
        size = len(lengths)
        x, y = (pairs >> kind(half)).astype(np.uint32), (pairs & kind((1 << half) - 1)).astype(np.uint32)
        left.append(x)
        right.append(y)
        lengths = np.r_[lengths, lengths[x] + lengths[y]]
        seq[put] = (np.cumsum(used) - 1 + size).astype(np.uint32)[rank]
        stay = np.ones(len(seq), bool)
        stay[put + 1] = False
        seq = seq[stay]
        new = seq >= size
        places = np.flatnonzero(new[:-1] | new[1:] | again[stay][:-1])
        if 3 * len(places) > len(seq):
            places = None
    rules = np.stack([np.concatenate(left), np.concatenate(right)], 1) if left else np.empty((0, 2), np.uint32)
    narrow = len(lengths) <= 1 << 16
    counts = np.array([len(alphabet), len(rules), len(seq)], "<u4")
    parts = [counts, alphabet.astype("<u4"), rules.astype("<u4"), lengths[len(alphabet) :].astype("<u4"), seq.astype("<u2" if narrow else "<u4")]
    return MAGIC + b"".join(p.tobytes() for p in parts)


class Grammar:
    """A decoded blob; ids(start, end) gives any range of the sequence's ids."""

    def __init__(self, blob: bytes):
        if blob[:4] != MAGIC:
            raise ValueError("not a grammar blob")
        n, r, s = np.frombuffer(blob, "<u4", 3, 4).tolist()
        at = 16
        self.alphabet = np.frombuffer(blob, "<u4", n, at)
        rules = np.frombuffer(blob, "<u4", 2 * r, at := at + 4 * n).reshape(-1, 2)
        lengths = np.frombuffer(blob, "<u4", r, at := at + 8 * r)
        self.seq = np.frombuffer(blob, "<u2" if n + r <= 1 << 16 else "<u4", s, at + 4 * r)
        self.lengths = np.r_[np.ones(n, np.int64), lengths.astype(np.int64)]
        self.ends = np.cumsum(self.lengths[self.seq]) if s else np.empty(0, np.int64)
        self.places = np.r_[0, np.cumsum(self.lengths)]  # of each symbol's expansion in flat
        self.flat = np.empty(self.places[-1], np.uint32)
        self.flat[:n] = self.alphabet
        start, rules = n, rules.astype(np.int64)
        while start < n + r:  # rules that refer only to what is expanded already, as many as there are in a row
            refers = rules[start - n :].max(1)
            stop = start + (int(np.argmax(refers >= start)) if (refers >= start).any() else len(refers))
            for half, shift in ((0, 0), (1, 1)):
                sym = rules[start - n : stop - n, half]
                size = self.lengths[sym]
                to = self.places[start:stop] + (self.lengths[rules[start - n : stop - n, 0]] if shift else 0)
                self.flat[ranges(to, size)] = self.flat[ranges(self.places[sym], size)]
            start = stop

    def __len__(self) -> int:
        return int(self.ends[-1]) if len(self.ends) else 0

    def ids(self, start: int = 0, end: int | None = None) -> np.ndarray:
        end = len(self) if end is None else min(end, len(self))
        if start >= end:
            return np.empty(0, np.uint32)
        i, j = np.searchsorted(self.ends, [start, end - 1], side="right")
        sym = self.seq[i : j + 1]
        out = self.flat[ranges(self.places[sym], self.lengths[sym])]
        skip = start - int(self.ends[i] - self.lengths[self.seq[i]])
        return out[skip : skip + end - start]


FILE = "part int, shard int, base long, doc_ids array<bigint>, sizes array<bigint>, blob binary"


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 2, shard_ids: int = 1_000_000) -> None:
    """Encode docs (doc_id long, text string) with the tokenizer file, append end_id, write the file set at path.

    Documents are in ascending doc_id order, over all parts; null ids come first, rows of one doc_id in the order of
    their texts. Null texts are empty. Shards end with the document that takes them to shard_ids ids or more.
    Repeated rows are all written; further columns are ignored; an empty table gives a file set without shards.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))

    def run(batches):
        part, shard, base = TaskContext.get().partitionId(), 0, 0
        names, sizes, pieces, held = [], [], [], 0
        tok = tokenizer_of(tokenizer)

        def flush():
            nonlocal shard, base, names, sizes, pieces, held
            cols = [[part], [shard], [base], [names], [sizes], [compress(np.concatenate(pieces))]]
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["part", "shard", "base", "doc_ids", "sizes", "blob"])
            shard, base, names, sizes, pieces, held = shard + 1, base + held, [], [], [], 0
            return out

        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
        for b in batches:
            ids, size = tok.encode_bytes(texts_of(b.column(1)), end_id)
            docs, ends = b.column(0).to_pylist(), np.r_[0, np.cumsum(size)]
            at = 0
            while at < len(docs):
                to = min(len(docs), int(np.searchsorted(ends, ends[at] + shard_ids - held)))
                names += docs[at:to]
                sizes += size[at:to].tolist()
                pieces.append(ids[ends[at] : ends[to]])
                held += len(pieces[-1])
                at = to
                if held >= shard_ids:
                    yield flush()
        if names:
            yield flush()

    ordered = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    map_texts(ordered, run, FILE, 1).write.option("compression", "zstd").parquet(path)


def read_ids(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """(doc_id, start long, n_tokens long, ids_crc32 long[, ids array<int>]) of each document in the file set at path.

    start counts the ids of all documents before it. Only the totals of the parts are gathered to order them. Null
    doc_ids and repeated ones are as many rows, in the order they were written; a file set without shards gives none.
    """
    files = spark.read.schema(FILE).parquet(path)
    totals = files.groupBy("part").agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).orderBy("part").collect()
    before, ahead = {}, 0
    for r in totals:
        before[r.part] = ahead
        ahead += r.n
    sent = spark.sparkContext.broadcast(before)

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                part, base, names, sizes, blob = (b.column(k)[i].as_py() for k in (0, 1, 2, 3, 4))
                flat = Grammar(blob).ids().astype("<u4")
                ends = np.cumsum(np.array(sizes, np.int64))
                starts, raw = ends - sizes, memoryview(flat.tobytes())
                crcs = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                cols = [pa.array(names, pa.int64()), pa.array(starts + base + sent.value[part]), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())]
                if ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(flat.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(cols)])

    kind = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids
    return files.select("part", "base", "doc_ids", "sizes", "blob").mapInArrow(run, kind)


def read_range(spark: SparkSession, path: str, doc_id: int, start: int = 0, end: int | None = None) -> np.ndarray:
    """Ids start..end of one document, decoded from the symbols that cover them only.

    Empty if there is no such document; of a doc_id that repeats, the first document in the file that holds it counts.
    """
    row = spark.read.schema(FILE).parquet(path).where(F.array_contains("doc_ids", F.lit(doc_id).cast("long"))).select("doc_ids", "sizes", "blob").first()
    if row is None:
        return np.empty(0, np.uint32)
    k = row.doc_ids.index(doc_id)
    first, size = sum(row.sizes[:k]), row.sizes[k]
    return Grammar(bytes(row.blob)).ids(first + start, first + (size if end is None else min(end, size)))
