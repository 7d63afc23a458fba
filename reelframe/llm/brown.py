"""Language-model scores by a Brown class-based bigram model, beside an add-one unigram base.

The frequent words are assigned to classes by the exchange algorithm: each in turn moves to the class that raises the
likelihood of the class bigrams most, until a sweep moves none. Every later word then goes to the class of the largest
exchange gain over the frequent words' class bigrams, from its own counts by the classes before and after it. These are
a sparse table by word, so that the words are placed side by side. Only words unseen in training have a class of their
own, and so does the end of a text. A token's probability is the class transition times the word's emission by its
class, mixed with the add-one unigram. Counts are over the whole training text, and transitions over all its words:
those of all words stay a distributed table; only the most frequent ones, of a fixed number, are sent to the tasks, and
the rest is joined.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, texts_of, work_dir
from .wordarrays import Interner, WordIndex, Words

END = b""  # no word is empty


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def _gains(n: np.ndarray, rows: np.ndarray, cols: np.ndarray, after: np.ndarray, before: np.ndarray, own: float, classes: int) -> np.ndarray:
    """Gain in log likelihood of each of the classes by taking a word that n, rows and cols don't hold.

    after, before: the word's counts by class; own: its pairs with itself.
    """
    x, y = np.flatnonzero(after), np.flatnonzero(before)  # the other terms are nought
    total_after, total_before = after.sum() + own, before.sum() + own
    a, b, d = n[:classes, x], n[y, :classes].T, np.diagonal(n)[:classes]
    gain = (_xlogx(a + after[x]) - _xlogx(a)).sum(1) + (_xlogx(b + before[y]) - _xlogx(b)).sum(1)
    gain -= _xlogx(d + after[:classes]) + _xlogx(d + before[:classes]) - 2 * _xlogx(d)
    gain += _xlogx(d + after[:classes] + before[:classes] + own) - _xlogx(d)
    gain -= _xlogx(rows[:classes] + total_after) - _xlogx(rows[:classes]) + _xlogx(cols[:classes] + total_before) - _xlogx(cols[:classes])
    return gain


def exchange(pairs: np.ndarray, classes: int, sweeps: int | None = None) -> np.ndarray:
    """Class of each word by exchange clustering on bigram counts pairs (m + 2, m + 2), until a sweep moves none.

    The last two rows and columns are the other words and the text end; they keep classes of their own (classes and
    classes + 1). Words start round robin in their order. Ties, as far as rounding tells, keep a word where it is, else
    the lowest class takes it. Every move raises the likelihood, so the sweeps end; `sweeps` bounds them if given.
    """
    m, k = len(pairs) - 2, classes + 2
    cls = np.r_[np.arange(m) % classes, classes, classes + 1]
    member = np.zeros((m + 2, k))
    member[np.arange(m + 2), cls] = 1
    pairs = pairs.astype(np.float64)
    to_class, from_class = pairs @ member, pairs.T @ member  # of each word: counts by the class after and before it
    n = member.T @ pairs @ member
    rows, cols = n.sum(1), n.sum(0)
    least = 1e-9 + 1e-14 * float(_xlogx(n.sum()))
    done, moved = 0, m
    while moved and (sweeps is None or done < sweeps):
        moved, done = 0, done + 1
        for w in range(m):
            g, own = int(cls[w]), pairs[w, w]
            after, before = to_class[w].copy(), from_class[w].copy()
            after[g] -= own
            before[g] -= own
            n[g] -= after
            n[:, g] -= before
            n[g, g] -= own
            rows[g] -= after.sum() + own
            cols[g] -= before.sum() + own
            gain = _gains(n, rows, cols, after, before, own, classes)
            best = int(gain.argmax())
            if gain[best] <= gain[g] + least:
                best = g
            n[best] += after
            n[:, best] += before
            n[best, best] += own
            rows[best] += after.sum() + own
            cols[best] += before.sum() + own
            if best != g:
                moved += 1
                cls[w] = best
                for table, counts in ((to_class, pairs[:, w]), (from_class, pairs[w])):
                    table[:, g] -= counts
                    table[:, best] += counts
    return cls


def place(n: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The class of the largest exchange gain for each word, each for itself, a word for each row of table.

    n, the class bigrams, holds them among the other words, last but one. A row holds a word's pairs: by the class after
    it, by the class before it (from k = len(n) on) and with itself (2 k).
    """
    k, classes, words = len(n), len(n) - 2, len(table)
    after, before, own = table[:, :k], table[:, k : 2 * k], table[:, 2 * k :]
    gain = np.zeros((words, classes))
    for side, by, across in ((after, n, before), (before, n.T, after)):
        w, x = np.nonzero(side)
        if not len(w):
            continue
        now, c = by[:classes, x].T.copy(), side[w, x][:, None]
        other = np.flatnonzero(x == classes)
        now[other] -= across[w[other], :classes]  # the word itself doesn't stand there any more
        first = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
        gain[w[first]] += np.add.reduceat(_xlogx(now + c) - _xlogx(now), first)
    d, rows, cols = np.diagonal(n)[:classes], n.sum(1)[:classes], n.sum(0)[:classes]
    a, b = after[:, :classes], before[:, :classes]
    gain -= _xlogx(d + a) + _xlogx(d + b) - _xlogx(d + a + b + own) - _xlogx(d)
    for sums, side in ((rows, after), (cols, before)):  # of the classes: a word's neighbours stay its neighbours
        gain -= _xlogx(sums + side.sum(1, keepdims=True) + own) - _xlogx(sums)
    return gain.argmax(1)


@dataclass
class BrownModel:
    """What scoring needs: all words' counts and classes as a table, those of the frequent words, class transitions."""

    counts: DataFrame  # word binary, c long, class int: all training words, and END
    tokens: int
    distinct: int
    frequent: pa.Array  # every word counted at least `least` times, in no more than a fixed number; without END
    c: np.ndarray  # their counts
    group: np.ndarray  # their classes
    least: int
    transitions: np.ndarray  # smoothed P(class | class before), (classes + 2) squared; the last two: unseen words, END
    sizes: np.ndarray  # training tokens of each class
    mix: float = 0.9

    @cached_property
    def classed(self) -> dict[bytes, int]:
        """Word -> class of all training words; gathers them, so for small tables only."""
        return {bytes(r.word): r["class"] for r in self.counts.collect()}


def _count(batches):
    """(word, n) of each partition, and of END a row with the number of texts."""
    local, held, texts = Interner(), np.zeros(0, np.int64), 0
    for b in batches:
        words = Words(texts_of(b.column(0)))
        ids = local(words, np.arange(len(words.starts)))
        held = np.pad(held, (0, local.n - len(held))) + np.bincount(ids, minlength=local.n)
        texts += b.num_rows
        if local.n > 2_000_000:
            yield _counted(local, held)
            local, held = Interner(), np.zeros(0, np.int64)
    yield _counted(local, held)
    yield pa.RecordBatch.from_arrays([pa.array([END] if texts else [], pa.binary()), pa.array([texts] if texts else [], pa.int64())], names=["word", "n"])


def _counted(local: Interner, held: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(held)
    return pa.RecordBatch.from_arrays([local.words(at), pa.array(held[at])], names=["word", "n"])


_SLOT = np.dtype([("slot", "<u2"), ("n", "<u4")])


def _sequence(ids: np.ndarray, words: Words, end: int) -> np.ndarray:
    """Numbers of all words with `end` before the first text and after each."""
    return np.insert(ids, words.bounds, end)


def _around(batches, index: WordIndex, cls: np.ndarray, k: int):
    """(word, slots) for words that index doesn't hold, of each partition: counts by the class after, before and with itself."""
    local, held, size, side = Interner(), [], 0, 2 * k + 1

    def told():
        keys, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.int64),) * 2
        cells = np.empty(len(keys), _SLOT)
        cells["slot"], cells["n"] = keys % side, n
        who, first = np.unique(keys // side, return_index=True)
        ends = np.append(first, len(keys)).astype(np.int32) * _SLOT.itemsize
        blobs = pa.Array.from_buffers(pa.binary(), len(who), [None, pa.py_buffer(ends), pa.py_buffer(cells.tobytes())])
        return pa.RecordBatch.from_arrays([local.words(who), blobs], names=["word", "slots"])

    for b in batches:
        words = Words(texts_of(b.column(0)))
        known = index(words)
        later = np.flatnonzero(known < 0)
        by = np.where(known < 0, k - 2, np.r_[cls, 0][known])
        own = np.full(len(known), -1, np.int64)
        own[later] = local(words, later)
        by, own = _sequence(by, words, k - 1), _sequence(own, words, -1)
        at = np.flatnonzero(own >= 0)
        base = own[at] * side
        held += [base + np.where(own[at + 1] == own[at], 2 * k, by[at + 1]), (base + k + by[at - 1])[own[at - 1] != own[at]]]
        size += len(at)
        if size >= 4_000_000:
            yield told()
            local, held, size = Interner(), [], 0
    yield told()


def _placed(batches, n: np.ndarray):
    """(word, c, class) of _around's rows, which come sorted by word, a word's in one partition."""
    k = len(n)
    side, last, sums = 2 * k + 1, None, None

    def told(words: pa.Array, table: np.ndarray):
        c = table[:, :k].sum(1) + table[:, 2 * k]
        return pa.RecordBatch.from_arrays([words, pa.array(c.astype(np.int64)), pa.array(place(n, table).astype(np.int32))], names=["word", "c", "class"])

    for b in batches:
        words, blobs = b.column(0), b.column(1)
        first = np.flatnonzero(np.r_[True, pc.not_equal(words[1:], words[:-1]).to_numpy(zero_copy_only=False)]) if len(words) else []
        if not len(first):
            continue
        cells = np.frombuffer(b"".join(blobs.to_pylist()), _SLOT)
        row = np.repeat(np.cumsum(np.isin(np.arange(len(words)), first)) - 1, pc.binary_length(blobs).to_numpy() // _SLOT.itemsize)
        table = np.bincount(row * side + cells["slot"], cells["n"], len(first) * side).reshape(-1, side)
        if last is not None and words[0].as_py() == last:
            table[0] += sums
        elif last is not None:
            yield told(pa.array([last], pa.binary()), sums[None])
        yield told(words.take(pa.array(first[:-1])), table[:-1])
        last, sums = words[int(first[-1])].as_py(), table[-1]
    if last is not None:
        yield told(pa.array([last], pa.binary()), sums[None])


def _most(counts: DataFrame, most: int) -> tuple[pa.Array, np.ndarray, int]:
    """The words of the highest counts, whole counts only, so that there are at most `most`; their counts; the least one."""
    rows = counts.orderBy(F.desc("c"), "word").limit(most + 1).toArrow().combine_chunks()
    words, c = (rows[x].combine_chunks() if rows[x].num_chunks else pa.array([], rows[x].type) for x in ("word", "c"))
    c = c.to_numpy()
    least = int(c[-1]) + 1 if len(c) > most else 1
    taken = int((c >= least).sum())
    return words.slice(0, taken), c[:taken], least


def fit_brown(docs: DataFrame, text_col: str = "text", classes: int = 48, clustered: int = 1024, frequent: int = 500_000, mix: float = 0.9, add: float = 0.5) -> BrownModel:
    """Learn from all texts of docs (null: empty): counts and classes of all words, and the transitions of all tokens.

    The `clustered` most frequent words are exchanged with each other, all later ones placed by the same gain. The driver
    gets at most `frequent` words and one more, and at most (clustered + 2) squared pair counts; what grows with the
    vocabulary stays in tables. An empty table gives a model that knows no word.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(text_col).alias("text"))
    path = work_dir(spark, "word-counts")
    map_texts(texts, _count, "word binary, n long", 0).groupBy("word").agg(F.sum("n").alias("c")).write.parquet(path)
    counts = spark.read.schema("word binary, c long").parquet(path)
    tokens, distinct = (x or 0 for x in counts.agg(F.sum("c"), F.count("*")).first())
    known, known_c, least = _most(counts, frequent)
    named = np.flatnonzero(pc.binary_length(known).to_numpy() > 0)[:clustered]  # END is empty
    names, m, k = known.take(pa.array(named)), len(named), classes + 2
    sent = spark.sparkContext.broadcast(WordIndex(names))

    def pairs_of(batches):
        side = m + 2
        total = np.zeros(side * side, np.int64)
        for b in batches:
            words = Words(texts_of(b.column(0)))
            ids = sent.value(words)
            seq = _sequence(np.where(ids < 0, m, ids), words, m + 1)
            total += np.bincount(seq[:-1] * side + seq[1:], minlength=side * side)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array((at // side).astype(np.int32)), pa.array((at % side).astype(np.int32)), pa.array(total[at])], names=["a", "b", "n"])

    found = map_texts(texts, pairs_of, "a int, b int, n long", 0).groupBy("a", "b").agg(F.sum("n").alias("n")).toArrow()
    pairs = np.zeros((m + 2, m + 2), np.int64)
    pairs[found["a"].to_numpy(), found["b"].to_numpy()] = found["n"].to_numpy()
    cls = exchange(pairs, classes)
    member = np.zeros((m + 2, k))
    member[np.arange(m + 2), cls] = 1
    n = member.T @ pairs @ member
    kind = "word binary, c long, class int"
    path = work_dir(spark, "word-classes")
    later = map_texts(texts, lambda batches: _around(batches, sent.value, cls, k), "word binary, slots binary", 0)
    later = later.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "word").sortWithinPartitions("word")
    later.mapInArrow(lambda batches: _placed(batches, n), kind).write.parquet(path)
    first = [(bytearray(w), int(c), int(g)) for w, c, g in zip(names.to_pylist(), known_c[named].tolist(), cls[:m].tolist(), strict=True)]
    if tokens:
        first.append((bytearray(END), int(pairs[m + 1].sum()), classes + 1))
    spark.createDataFrame(first, kind).coalesce(1).write.mode("append").parquet(path)
    counts = spark.read.schema(kind).parquet(path)
    rows = counts.where((F.col("c") >= least) & (F.length("word") > 0)).orderBy("word").toArrow().combine_chunks()
    words, c, group = (rows[x].combine_chunks() if rows[x].num_chunks else pa.array([], rows[x].type) for x in ("word", "c", "class"))
    whole = spark.sparkContext.broadcast((WordIndex(words), group.to_numpy().astype(np.int64)))

    def moves_of(batches):
        """Class bigrams; where a word wasn't sent, it stands in the place of its class."""
        index, group = whole.value
        total, schema = np.zeros(k * k, np.int64), pa.schema([("a", pa.binary()), ("b", pa.binary()), ("ka", pa.int32()), ("kb", pa.int32()), ("n", pa.int64())])
        for b in batches:
            words = Words(texts_of(b.column(0)))
            ids = index(words)
            by = _sequence(np.where(ids < 0, -1, np.r_[group, 0][ids]), words, k - 1)
            place = _sequence(np.arange(len(ids)), words, -1)
            x, y = by[:-1], by[1:]
            sure = (x >= 0) & (y >= 0)
            total += np.bincount(x[sure] * k + y[sure], minlength=k * k)
            at = np.flatnonzero(~sure)
            if len(at):
                ends = [words.array(np.maximum(place[at + i], 0)) if len(ids) else None for i in (0, 1)]
                a, b2 = (pc.if_else(pa.array(by[at + i] < 0), w, pa.scalar(None, pa.binary())) for i, w in enumerate(ends))
                told = pa.table([a, b2, pa.array(x[at].astype(np.int32)), pa.array(y[at].astype(np.int32))], names=["a", "b", "ka", "kb"])
                told = told.group_by(["a", "b", "ka", "kb"]).aggregate([([], "count_all")]).rename_columns(["a", "b", "ka", "kb", "n"])
                yield from told.cast(schema).to_batches()
        at = np.flatnonzero(total)
        none = pa.nulls(len(at), pa.binary())
        yield pa.RecordBatch.from_arrays([none, none, pa.array((at // k).astype(np.int32)), pa.array((at % k).astype(np.int32)), pa.array(total[at])], schema=schema)

    found = map_texts(texts, moves_of, "a binary, b binary, ka int, kb int, n long", 0)
    if len(known) < distinct:
        path = work_dir(spark, "class-pairs")
        found.write.parquet(path)
        found = spark.read.schema("a binary, b binary, ka int, kb int, n long").parquet(path)
        rare = counts.where(F.col("c") < least)
        for x in "ab":  # no null keys in the joins
            by = rare.select(F.col("word").alias(x), F.col("class").alias("to"))
            found = found.where(F.col(x).isNull()).union(found.where(F.col(x).isNotNull()).join(by, x).withColumn(f"k{x}", F.col("to")).select("a", "b", "ka", "kb", "n"))
    moves = np.zeros((k, k))
    for r in found.groupBy("ka", "kb").agg(F.sum("n").alias("n")).collect():
        moves[r.ka, r.kb] = r.n
    return BrownModel(counts, tokens, distinct, words, c.to_numpy(), group.to_numpy(), least, (moves + add) / (moves.sum(1, keepdims=True) + add * k), moves.sum(0), mix)


def score_brown(docs: DataFrame, model: BrownModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score, perplexity) for each row of docs.

    Scores are log10 probabilities of the words and the end of the text: base_score by the add-one unigram, score by
    the class model. Null and empty texts consist of the end alone. Repeated rows and null ids each give a row; further
    columns are ignored; an empty table gives no rows. Words that were not sent to the tasks are joined with the table
    of counts and classes, once for each text they stand in, if the table holds more words than were sent.
    """
    spark = docs.sparkSession
    other = len(model.transitions) - 2
    cls = np.r_[model.group, other, other + 1].astype(np.int64)  # frequent words, others, END
    c = np.r_[model.c, 0, 0].astype(np.float64)
    whole = model.tokens + model.distinct + 1
    ends = int(model.sizes[other + 1])  # texts seen in training
    c[-1] = ends
    more = len(model.frequent) + (ends > 0) < model.distinct
    emit = c / np.maximum(model.sizes[cls], 1)
    emit[-2:] = 1.0  # unseen words count as one
    sent = spark.sparkContext.broadcast((WordIndex(model.frequent), cls, c, emit, model.transitions, model.sizes, model.mix, whole))
    term = np.dtype([("a", "<i4"), ("b", "<i4"), ("emit", "<f8"), ("base", "<f8")])  # a, b: class, or -1 - place of a word
    names = ["row", "doc_id", "word", "n_tokens", "n_known", "base_score", "score", "terms", "place", "tf"]
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.int32(), pa.int64())

    def run(batches):
        index, cls, c, emit, trans, _, mix, whole = sent.value
        n, end, other = len(index), len(index) + 1, len(trans) - 2
        log_c, row = np.log10(c + 1), TaskContext.get().partitionId() << 33
        for b in batches:
            words = Words(texts_of(b.column(1)))
            ids = index(words)
            bounds, size = words.bounds, np.diff(words.bounds) + 1
            text = np.repeat(np.arange(len(size)), size)
            seq = np.insert(np.where(ids < 0, n, ids), bounds[1:], end)
            first = np.cumsum(size) - size
            k = cls[seq]
            before = np.r_[other + 1, k[:-1]]
            before[first] = other + 1
            p = mix * trans[before, k] * emit[seq] + (1 - mix) * (c[seq] + 1) / whole
            base = np.bincount(text, log_c[seq], len(size)) - size * np.log10(whole)
            known = np.bincount(text, c[seq] > 0, len(size)).astype(np.int64)
            terms = [None] * len(size)
            rest = []
            if more and (ids < 0).any():
                rare = np.flatnonzero(ids < 0)  # among the words; text t's stand t places further on in seq
                at = rare + np.searchsorted(bounds[1:], rare, side="right")
                local = Interner()
                who = text[at] * (len(rare) + 1) + local(words, rare)
                same, inverse, tf = np.unique(who, return_inverse=True, return_counts=True)
                some = np.empty(len(same), np.int64)
                some[inverse] = rare  # one place of each word of a text
                owner = same // (len(rare) + 1)
                place = np.arange(len(same)) - np.searchsorted(owner, owner)
                k = k.copy()
                k[at] = -1 - place[inverse]
                before = np.r_[other + 1, k[:-1]]
                before[first] = other + 1
                late = np.flatnonzero((k < 0) | (before < 0))
                found = np.zeros(len(late), term)
                found["a"], found["b"], found["emit"], found["base"] = before[late], k[late], emit[seq[late]], (c[seq[late]] + 1) / whole
                p[late] = 1.0
                cut = np.searchsorted(text[late], np.arange(len(size) + 1))
                terms = [found[i:j].tobytes() if j > i else None for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                owned = b.column(0).take(pa.array(owner))
                none = [pa.nulls(len(same), t) for t in kinds]
                rest = [pa.RecordBatch.from_arrays([pa.array(row + owner), owned, words.array(some), *none[3:8], pa.array(place.astype(np.int32)), pa.array(tf.astype(np.int64))], names=names)]
            score = np.bincount(text, np.log10(p), len(size))
            cols = [pa.array(row + np.arange(len(size))), b.column(0), pa.nulls(len(size), pa.binary()), pa.array(size), pa.array(known), pa.array(base), pa.array(score), pa.array(terms, pa.binary()), pa.nulls(len(size), pa.int32()), pa.nulls(len(size), pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=names)
            yield from rest
            row += len(size)

    def finish(batches):
        _, _, _, _, trans, sizes, mix, whole = sent.value
        other = len(trans) - 2
        for b in batches:
            n = b.num_rows
            count = pc.fill_null(pc.list_value_length(b.column(6)), 0).to_numpy()
            first, text = np.cumsum(count) - count, np.repeat(np.arange(n), count)
            found = b.column(6).flatten()
            seen = found.field("c").is_valid().to_numpy(zero_copy_only=False)
            at = first[text] + found.field("place").to_numpy()  # a text's words by their places
            c, k = np.zeros(len(at)), np.full(len(at), other)
            c[at[seen]] = pc.fill_null(found.field("c"), 0).to_numpy()[seen]
            k[at[seen]] = pc.fill_null(found.field("class"), 0).to_numpy()[seen]
            tf = found.field("tf").to_numpy()
            emit = np.where(k == other, 1.0, c / np.maximum(sizes[k], 1))
            known = b.column(2).to_numpy() + np.bincount(text, tf * seen, n).astype(np.int64)
            base = b.column(3).to_numpy() + np.bincount(text, tf * np.log10(c[at] + 1), n)
            terms = np.frombuffer(b"".join(x or b"" for x in b.column(5).to_pylist()), term)
            text = np.repeat(np.arange(n), pc.fill_null(pc.binary_length(b.column(5)), 0).to_numpy() // term.itemsize)
            k, c, emit = np.append(k, other), np.append(c, 0), np.append(emit, 1.0)  # for terms that look nothing up
            place = lambda x: np.where(x < 0, first[text] - 1 - x, len(k) - 1)
            x, y = (np.where(t < 0, k[place(t)], t) for t in (terms["a"], terms["b"]))
            mine, to = terms["b"] < 0, place(terms["b"])
            e, u = np.where(mine, emit[to], terms["emit"]), np.where(mine, (c[to] + 1) / whole, terms["base"])
            score = b.column(4).to_numpy() + np.bincount(text, np.log10(mix * trans[x, y] * e + (1 - mix) * u), n)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(known), pa.array(base), pa.array(score)], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    kind = "row long, doc_id long, word binary, n_tokens long, n_known long, base_score double, score double, terms binary, place int, tf long"
    got = map_texts(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, kind, 1)
    fields = ("doc_id", "n_tokens", "n_known", "base_score", "score")
    if more:
        path = work_dir(spark, "scores")
        got.write.parquet(path)
        both = spark.read.schema(kind).parquet(path)
        rare = model.counts.where(F.col("c") < model.least)
        tail = both.where("word IS NOT NULL").select("row", "word", "place", "tf").join(rare, "word", "left")
        tail = tail.groupBy("row").agg(F.collect_list(F.struct("place", "c", "class", "tf")).alias("found"))
        got = both.where("word IS NULL").join(tail, "row", "left").select(*fields, "terms", "found")
        got = got.mapInArrow(finish, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return got.select(*fields).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
