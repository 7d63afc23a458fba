import random

import numpy as np
import pyarrow as pa
import xxhash

from reelframe.llm.common import connected_components, slices
from reelframe.llm.queries import op9_simhash
from reelframe.llm.simhash import BLOCKS, PRINTS, bucket_edges, drop_near_duplicates, fingerprint, most_bits, near_duplicates, near_forest, print_keys, similar_documents, wide_prints


def slow_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def slow_components(rows):
    prints = [slow_print(t) for _, t in rows]
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3 and comp[i] != comp[j]:
                a, b = comp[i], comp[j]
                comp = [min(a, b) if c in (a, b) else c for c in comp]
    return {k: (f, min(d for (d, _), c in zip(rows, comp, strict=True) if c == comp[k] and d is not None)) for k, f in enumerate(prints)}


def make_rows():
    rng = random.Random(3)
    words = ["alpha", "Beta", "gamma", "É", "delta", "eps", "zeta", "x"]
    rows = []
    for i in range(60):
        base = [rng.choice(words) + str(rng.randrange(40)) for _ in range(rng.choice([1, 2, 3, 60, 200]))]
        rows.append((3 * i, " ".join(base)))
        if i % 4 == 0:
            rows.append((3 * i + 1, "\n".join(base).upper() if i % 8 else " ".join(base[:-1] + ["end"])))
    return rows + [(1000, None), (1001, ""), (1002, " \t\r\n\x0b\x0c"), (1003, "a b \x1cc"), (7, rows[0][1]), (7, rows[0][1]), (1004, "word " * 40000)]


def test_equals_brute_force(spark):
    rows = make_rows()
    want = sorted((rows[k][0], f, c) for k, (f, c) in slow_components(rows).items())
    df = spark.createDataFrame([(d, t, 1, "k") for d, t in rows], "doc_id long, text string, fp int, key string").repartition(3)
    got = sorted((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in near_duplicates(df).collect())
    assert got == want


def test_long_text_counts_do_not_overflow():
    assert fingerprint(b"q w e " * 5000) == slow_print("q w e " * 5000)


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_null_ids(spark):
    df = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (None, "other words here now")], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.component_id) for r in near_duplicates(df).collect() if r.component_id)
    assert got == [(False, 5), (True, 5)]
    assert sorted((str(r.doc_id), r.text) for r in drop_near_duplicates(df).collect()) == [("5", "a b c d"), ("None", "a b c d"), ("None", "other words here now")]


def test_drop_keeps_one_whole_row(spark):
    df = spark.createDataFrame([(1, "a b c d e", "x"), (1, "a b c d e", "w"), (2, "a b c d e", "y"), (3, "q r s t u v", "z")], "doc_id long, text string, source string")
    assert sorted(map(tuple, drop_near_duplicates(df).collect())) == [(1, "a b c d e", "w"), (3, "q r s t u v", "z")]


def test_blocks_cover_the_fingerprint():
    assert [b for low, w in BLOCKS for b in range(low, low + w)] == list(range(64))


def test_large_bucket_equals_full_comparison():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 3, dtype=np.uint64)
    fps = {int(b) for b in rng.integers(0, 2**63, 900, dtype=np.uint64)}
    for b in base:
        for _ in range(500):
            x = int(b)
            for bit in rng.integers(0, 64, rng.integers(1, 9)):
                x ^= 1 << int(bit)
            fps.add(x)
    fps = np.array(sorted(fps), np.uint64)

    def trees(edges):
        up = list(range(len(fps)))
        for a, b in edges:
            ra, rb = up[a], up[b]
            if ra != rb:
                up = [min(ra, rb) if x in (ra, rb) else x for x in up]
        return up

    small = bucket_edges(fps, 3, dense=10**9)
    assert trees(bucket_edges(fps, 3, dense=64)) == trees(small)


def test_dense_groups_of_copies(spark):
    """Thousands of near copies of one text, which meet in the same buckets."""
    rng = random.Random(2)
    base = [f"w{rng.randrange(5000)}" for _ in range(400)]
    rows = []
    for i in range(3000):
        t = list(base)
        for _ in range(3):
            t[rng.randrange(400)] = f"w{rng.randrange(5000)}"
        rows.append((i, " ".join(t)))
    got = similar_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert {r.component_id for r in got.collect()} == {0}


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = sorted((rows[k][0], f"{f:016x}", c) for k, (f, c) in slow_components(rows).items())
    assert sorted(map(tuple, op9_simhash(spark, sf).collect())) == want


def test_columns_of_any_name(spark):
    """Columns named like those that the operator makes, repeated ids, a hot id, a null id."""
    rows = [(5, "one two three four", 7, 1, "b"), (5, "one two three four", 7, 0, "a"), (5, "one two three four", None, 9, "z"), (6, "one two three four", 1, 1, "c"), (None, "x", 2, 2, "n"), (9, "other words stand here", 3, 3, "o")]
    rows += [(7, f"hot id {i} {i} {i}", i, i, "h") for i in range(300)]
    df = spark.createDataFrame([(d, t, a, b, c, a) for d, t, a, b, c in rows], "doc_id long, text string, _rank int, part int, id string, n int").repartition(3)
    got = drop_near_duplicates(df)
    assert got.columns == df.columns and got.dtypes == df.dtypes
    got = got.collect()
    assert sorted((r.doc_id or 0) for r in got) == [0, 5, 7, 9]
    assert next(tuple(r) for r in got if r.doc_id == 5) == (5, "one two three four", None, 9, "z", None)
    assert next(r._rank for r in got if r.doc_id == 7) == 0


def test_hubs_of_the_component_search(spark):
    """Stars with more edges than a hub may have, chains between them, and a long path."""
    edges = [(0, i) for i in range(1, 3000)] + [(5000, i) for i in range(5001, 9000)] + [(2999, 5001)] + [(10_000 + i, 10_001 + i) for i in range(300)] + [(20_000, 20_000), (None, 3)]
    rng = random.Random(0)
    edges = [(a, b) if rng.random() < 0.5 else (b, a) for a, b in edges]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "u long, v long").repartition(6)).collect()))
    assert got == {**dict.fromkeys([*range(3000), *range(5000, 9000)], 0), **dict.fromkeys(range(10_000, 10_301), 10_000)}


def test_the_session_is_left_as_it_was(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    near_duplicates(spark.createDataFrame(make_rows(), "doc_id long, text string")).count()
    assert spark.conf.get(key) == before


def test_slices():
    batch = pa.RecordBatch.from_pydict({"t": ["a" * 10, None, "", "b" * 100, "c", "é" * 3]})
    assert [[len((x or "").encode()) for x in s.column(0).to_pylist()] for s in slices(batch, 0, 12)] == [[10, 0, 0], [100], [1, 6]]
    assert list(slices(batch.slice(0, 0), 0)) == []


ONES = (1 << 64) - 1


def slow_mixed(x):
    for factor in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x = (x ^ x >> 29) * factor & ONES
    return x ^ x >> 32


def slow_wide(text, k=5):
    """The wide print of a text, shingle by shingle and bit by bit."""
    each = []
    for w in (text or "").encode().lower().split():
        low, high = int.from_bytes(w[:8], "little"), int.from_bytes(w[8:15], "little") | len(w) << 56
        each.append(slow_mixed(low ^ slow_mixed(high)) if len(w) < 16 else xxhash.xxh64_intdigest(w, seed=42))
    if not each:
        return [0] * PRINTS
    hs = []
    for i in range(max(1, len(each) - k + 1)):
        h = 0
        for j in range(i, i + k):
            h = (slow_mixed((h + 1) & ONES) + (each[j] if j < len(each) else 0)) & ONES
        hs.append(h)
    out = []
    for p in range(PRINTS):
        xs = [slow_mixed(h ^ (0x9E3779B97F4A7C15 * (2 * p + 1) & ONES)) for h in hs]
        out.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in xs) > len(xs)))
    return out


def slow_groups(rows):
    """Row -> smallest id of its group: all pairs that share a bucket, by the distance of their wide prints."""
    prints = [slow_wide(t) for _, t in rows]
    keys = [set(print_keys(np.array([p], np.uint64))[0].tolist()) for p in prints]
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if comp[i] != comp[j] and (prints[i] == prints[j] or (keys[i] & keys[j] and sum((a ^ b).bit_count() for a, b in zip(prints[i], prints[j])) <= most_bits(0.8))):
                a, b = comp[i], comp[j]
                comp = [min(a, b) if c in (a, b) else c for c in comp]
    return [min((d for (d, _), c in zip(rows, comp, strict=True) if c == comp[k] and d is not None), default=None) for k in range(len(rows))]


def jaccard(a, b, k=5):
    x, y = ({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} for w in (a.split(), b.split()))
    return len(x & y) / len(x | y)


def test_wide_prints_equal_plain_ones():
    texts = [t or "" for _, t in make_rows()[:60]] + ["", "a", "one two three four", "one two three four five", "averyveryverylongword " * 3, "w " * 300, "É " * 700]
    got = wide_prints([t.encode() for t in texts])
    assert got.tolist() == [slow_wide(t) for t in texts]


def test_similar_documents_equal_brute_force(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for i in range(40):
        base = [rng.choice(words) for _ in range(rng.choice([30, 90, 300]))]
        rows.append((10 * i + 5, " ".join(base)))
        for j in range(rng.randrange(4)):
            for _ in range(rng.randrange(1, 2 + len(base) // 30)):
                base[rng.randrange(len(base))] = rng.choice(words)
            rows.append((10 * i + j, " ".join(base).upper()))
    rows += [(1000, None), (1001, " "), (2, rows[0][1]), (2, rows[3][1]), (None, rows[5][1]), (1002, "short"), (1003, "SHORT")]
    df = spark.createDataFrame([(d, t, 1, "k") for d, t in rows], "doc_id long, text string, node int, print string").repartition(3)
    key = lambda r: (r[0] is None, r)
    assert sorted(map(tuple, similar_documents(df).collect()), key=key) == sorted(((d, c) for (d, _), c in zip(rows, slow_groups(rows))), key=key)
    assert similar_documents(df.where("false")).count() == 0


def test_copies_by_similarity():
    """Nearly all copies well above 0.8 are found, and what is found has about that similarity."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(4000)]
    found, wrong, all_near = 0, 0, 0
    for _ in range(500):
        a = [rng.choice(words) for _ in range(rng.choice([60, 150, 400]))]
        b = list(a)
        for _ in range(rng.randrange(len(a) // 20)):
            b[rng.randrange(len(b))] = rng.choice(words)
        a, b = " ".join(a), " ".join(b)
        j, prints = jaccard(a, b), wide_prints([a.encode(), b.encode()])
        keys = print_keys(prints)
        hit = bool(set(keys[0].tolist()) & set(keys[1].tolist())) and np.bitwise_count(prints[0] ^ prints[1]).sum() <= most_bits(0.8)
        all_near, found, wrong = all_near + (j >= 0.85), found + (hit and j >= 0.85), wrong + (hit and j < 0.72)
    assert found >= 0.97 * all_near > 50 and not wrong


def test_near_forest_spans_what_all_pairs_do():
    rng = np.random.default_rng(5)
    for n in (1, 2, 60, 300):
        base = rng.integers(0, 1 << 63, (max(1, n // 15), PRINTS), dtype=np.int64).astype(np.uint64)
        prints = base[rng.integers(0, len(base), n)]
        for row in prints:
            for b in rng.integers(0, 1024, rng.integers(0, 120)):
                row[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
        near = np.bitwise_count(prints[:, None] ^ prints[None]).sum(2) <= 100
        edges, tree = near_forest(prints, 100), list(range(n))
        for pairs in (edges, list(zip(*np.nonzero(near)))):
            comp = list(range(n))
            for i, j in pairs:
                a, b = comp[i], comp[j]
                comp = [min(a, b) if c in (a, b) else c for c in comp] if a != b else comp
            tree, last = comp, tree
        assert last == tree and all(near[i, j] for i, j in edges)
