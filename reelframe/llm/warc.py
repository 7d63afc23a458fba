"""WARC archives: written with Spark's text writer, read back by boundary-chain verification.

A reading task cuts its split at every record magic and gives one candidate for each: where the record would start and,
from its header, where its successor would. Candidates inside payloads are told from records by pointer jumping over
those offsets from the start of each file: only what the chain reaches is a record. Payload bytes don't take part in
that; they are hashed where they are read, and only records whose payload holds the magic are put together from
several pieces afterwards.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, work_dir

MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record(page_id: Column, url: Column, payload: Column, digest: Column, refers: Column) -> Column:
    """One WARC record as text, without the two line ends that close it."""
    size = F.octet_length(payload).cast("string")
    uri = F.regexp_replace(F.coalesce(url, F.lit("urn:none")), r"[\x00-\x20]", "%20")
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    head = F.concat(F.lit("\r\nWARC-Record-ID: "), name(page_id), F.lit("\r\nWARC-Target-URI: "), uri, F.lit("\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Payload-Digest: sha256:"), digest)
    full = F.concat(F.lit(MAGIC + "WARC-Type: response"), head, F.lit("\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size, F.lit(END), payload)
    again = F.concat(F.lit(MAGIC + "WARC-Type: revisit"), head, F.lit("\r\nWARC-Refers-To: "), name(refers), F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nX-Payload-Length: "), size, F.lit("\r\nContent-Length: 0" + END))
    return F.when(refers.isNull(), full).otherwise(again)


def write_warc(pages: DataFrame, path: str, least: int = 100, most_records: int = 100_000) -> None:
    """Write one record per row of pages (page_id long, url string, html string) to WARC files below path.

    Of equal payloads of at least `least` bytes the row with the smallest page_id becomes a response and the others
    revisits of it; shorter payloads are all responses. A null html is an empty payload. Rows that repeat both the
    smallest page_id and the payload are all responses. A null page_id is written as "none"; such a row is a revisit
    where a row with an id has its payload, else a response. Further columns are ignored.

    The table of repeated payloads is written first, so its size is known to the planner: it is broadcast only below
    spark.sql.autoBroadcastJoinThreshold and joined by digest (hot digests split by adaptive execution) above.
    """
    spark = pages.sparkSession
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    same = rows.where(F.octet_length("html") >= least).groupBy(F.col("digest").alias("key")).agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    at = work_dir(spark, "warc-repeats")
    same.where("n > 1 AND first IS NOT NULL").drop("n").write.parquet(at)
    same = spark.read.schema("key string, first long").parquet(at)
    key = F.when(F.octet_length("html") >= least, F.col("digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "digest").cast("string")))
    told = rows.withColumn("key", key).join(same, "key", "left")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first")), F.col("first"))
    out = told.select(_record(F.col("page_id"), F.col("url"), F.col("html"), F.col("digest"), refers).alias("value"))
    out.write.option("lineSep", END).option("maxRecordsPerFile", most_records).text(path)


def _chain(table: pa.Table) -> pa.Table:
    """Keep the candidates of one file that the chain from offset 0 reaches.

    piece: number of the candidate in its file; last: that of its record's last piece (more than one if the magic
    stands in the payload).
    """
    table = table.sort_by([("block", "ascending"), ("row", "ascending")])
    size = table["size"].to_numpy()
    start = np.cumsum(size + len(MAGIC)) - size - len(MAGIC)  # of each piece, were there a magic before it
    if len(start):
        start = start - len(MAGIC)  # the first piece, before the first magic, has none
    total = start[-1] + len(MAGIC) + size[-1]
    n, head, length = len(start), table["head"].to_numpy(), table["length"].to_numpy()
    goes = np.where(length >= 0, start + len(MAGIC) + head + length + len(END), -1)
    ends = np.r_[start, total]
    at = np.searchsorted(ends, goes)
    jump = np.r_[np.where((goes > start) & (ends[np.minimum(at, n)] == goes), at, n + 1), n, n + 1]
    after = jump.copy()
    reached = np.zeros(n + 2, bool)
    first = 0 if size[0] else 1  # an empty first piece: the file starts with the magic
    if first < n and start[first] == 0:
        reached[first] = True
    hops = 1
    while hops <= n:
        reached[jump[reached]] = True
        jump = jump[jump]
        hops *= 2
    found = np.flatnonzero(reached[:n] & (after[:n] <= n))
    out = table.take(pa.array(found))
    for name, values in (("offset", start[found]), ("piece", found), ("last", after[found] - 1)):
        out = out.append_column(name, pa.array(values.astype(np.int64)))
    return out.drop_columns(["size", "head"])


def read_warc(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """Records of the WARC files below path, in no order.

    Columns: file, offset (of the record in its file), record_type, record_id, target_uri, header_digest, refers_to,
    payload_length (of a revisit, as its header says), length (of the block), sha256 (hex, of the block as read) and,
    if asked for, payload (binary). Files are read in splits. A record whose header or length doesn't lead to another
    record or the end of the file is dropped, and so is what is reached through it only. No files: no rows.
    """
    raw = spark.read.option("lineSep", MAGIC).text(path)
    raw = raw.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    head = F.substring_index("value", END, 1)
    bytes_ = F.col("value").cast("binary")
    field = lambda name: F.nullif(F.regexp_extract(F.col("text"), rf"(?im)^{name}:[ \t]*([^\r\n]*?)[ \t]*\r?$", 1), F.lit(""))
    rows = raw.withColumns({"text": head, "size": F.octet_length("value").cast("long"), "head": F.octet_length(head) + F.lit(len(END))})
    whole = F.col("size") >= F.col("head")
    rows = rows.withColumn("length", F.when(whole, F.expr("try_cast(regexp_extract(text, '(?im)^Content-Length:[ \\t]*([0-9]{1,18})[ \\t]*\\r?$', 1) AS long)")))
    rows = rows.withColumns({"head": F.col("head").cast("long"), "length": F.coalesce("length", F.lit(-1))})
    body = F.expr("CASE WHEN length >= 0 AND length <= size - head THEN substring(CAST(value AS binary), CAST(head AS int) + 1, CAST(length AS int)) END")
    plain = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "header_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To"}
    cols = [field(v).alias(k) for k, v in plain.items()] + [F.expr("try_cast(x AS long)".replace("x", "regexp_extract(text, '(?im)^X-Payload-Length:[ \\t]*([0-9]{1,18})', 1)")).alias("payload_length")]
    cols += [F.sha2(body, 256).alias("sha256")] + [body.alias("payload")] * payloads
    cand = rows.select("file", "block", "row", "size", "head", "length", *cols)
    kinds = "file string, block long, row long, length long, record_type string, record_id string, target_uri string, header_digest string, refers_to string, payload_length long, sha256 string, " + "payload binary, " * payloads
    found = cut(cand.groupBy("file").applyInArrow(_chain, kinds + "offset long, piece long, last long"))
    out = ["file", "offset", "record_type", "record_id", "target_uri", "header_digest", "refers_to", "payload_length", "length", "sha256"] + ["payload"] * payloads
    split = found.where("last > piece")
    if split.isEmpty():
        return found.select(*out)
    return found.where("last = piece").select(*out).union(_assemble(raw, cand, split, out, payloads))


def _assemble(raw: DataFrame, cand: DataFrame, split: DataFrame, out: list[str], payloads: bool) -> DataFrame:
    """Blocks of the records that hold the magic, from their pieces; only those pieces are moved."""

    def number(table: pa.Table) -> pa.Table:
        table = table.sort_by([("block", "ascending"), ("row", "ascending")])
        return table.append_column("piece", pa.array(np.arange(len(table), dtype=np.int64)))

    files = split.select("file").distinct()
    places = cand.select("file", "block", "row").join(files, "file", "left_semi").groupBy("file").applyInArrow(number, "file string, block long, row long, piece long")
    want = split.select("file", F.col("piece").alias("of"), F.explode(F.sequence("piece", "last")).alias("piece"))
    wanted = cut(places.join(want, ["file", "piece"]).select("file", "block", "row", "of", "piece"))
    texts = raw.join(wanted, ["file", "block", "row"]).select("file", "of", "piece", F.col("value").cast("binary").alias("bytes"))

    def together(table: pa.Table) -> pa.Table:
        table = table.sort_by("piece")
        text = MAGIC.encode().join(table["bytes"].to_pylist())
        return pa.table({"file": table["file"][:1], "of": table["of"][:1], "whole": pa.array([text[text.index(END.encode()) + len(END) :]], pa.binary())})

    whole = texts.groupBy("file", "of").applyInArrow(together, "file string, of long, whole binary").withColumnRenamed("of", "piece")
    body = F.expr("substring(whole, 1, CAST(length AS int))")
    fresh = {"sha256": F.sha2(body, 256)} | ({"payload": body} if payloads else {})
    return split.join(whole, ["file", "piece"]).withColumns(fresh).select(*out)
