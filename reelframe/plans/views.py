"""The driver's tables read as media relations: packets, streams, sample indexes, chapters, audio and video frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STREAMS = ("click", "error", "purchase", "signup", "view")
INDEX_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as packets: path, seq (arrival order), stream_index, pts in microseconds, keyframe flag, size."""
    e = table(spark, sf_dir, "events")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    stream = F.array_position(F.array(*map(F.lit, STREAMS)), F.col("event_type")).cast("int") - 1
    return e.select(
        F.col("user_id").alias("path"),
        (F.row_number().over(order) - 1).cast("long").alias("seq"),
        stream.alias("stream_index"),
        F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01', ts)").alias("pts"),
        F.lit(1).alias("tb_num"),
        F.lit(1_000_000).alias("tb_den"),
        (F.col("event_id") % 10 == 0).alias("is_keyframe"),
        F.length("props").cast("long").alias("size"),
    )


def streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streams of the packets, with their media types."""
    kind = F.when(F.col("stream_index") < 2, "video").when(F.col("stream_index") < 4, "audio").otherwise("subtitle")
    return packets(spark, sf_dir).select("path", "stream_index").distinct().withColumn("media_type", kind)


def sample_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as sample tables: track, idx, delta, cts, sync, size, chunk."""
    li = table(spark, sf_dir, "lineitem")
    idx = (F.row_number().over(Window.partitionBy("l_suppkey").orderBy(*INDEX_ORDER)) - 1).cast("long")
    rows = li.select(
        F.col("l_suppkey").alias("track"), idx.alias("idx"), F.col("l_quantity").cast("int").alias("delta"), F.col("l_linenumber").alias("cts"),
        (F.col("l_returnflag") == "A").alias("sync"), F.floor("l_extendedprice").alias("size"),
    )
    return rows.withColumn("chunk", F.floor(F.col("idx") / 5))


def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as chapters: path, idx, start in whole seconds."""
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    start = F.expr("timestampdiff(SECOND, timestamp_ntz'1990-01-01', o_orderdate)").cast("double")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("path"), (F.row_number().over(order) - 1).alias("idx"), start.alias("start"))


def audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as mono f32 frames of 64 samples at 44100 Hz: frame_no, pts, samples."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame_no"), (F.col("vec_id") * 64).alias("pts"), F.transform("embedding", lambda x: x.cast("double")).alias("samples"))


def gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 8x8 gray frames: frame_no, px (row-major array of 0..255)."""
    level = lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(x.cast("double") * 256).cast("int") + 128))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame_no"), F.transform("embedding", level).alias("px"))


def rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three gray frames in a row as the r, g and b planes of one: frame_no, r, g, b (complete triples only)."""
    g = gray(spark, sf_dir).select(F.floor(F.col("frame_no") / 3).alias("frame_no"), (F.col("frame_no") % 3).alias("k"), "px")
    plane = lambda k, name: F.max(F.when(F.col("k") == k, F.col("px"))).alias(name)
    return g.groupBy("frame_no").agg(plane(0, "r"), plane(1, "g"), plane(2, "b")).where("r IS NOT NULL AND g IS NOT NULL AND b IS NOT NULL")


#: The same relations for DuckDB, each to stand in a WITH clause.
DUCK = {
    "packets": """packets AS (SELECT user_id AS path, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq,
        CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS stream_index,
        epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') AS pts, 1 AS tb_num, 1000000 AS tb_den, event_id % 10 = 0 AS is_keyframe, length(props) AS size FROM events)""",
    "streams": """streams AS (SELECT DISTINCT path, stream_index, CASE WHEN stream_index < 2 THEN 'video' WHEN stream_index < 4 THEN 'audio' ELSE 'subtitle' END AS media_type FROM packets)""",
    "sample_index": """sample_index AS (SELECT *, idx // 5 AS chunk FROM (SELECT l_suppkey AS track,
        row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) - 1 AS idx,
        CAST(trunc(l_quantity) AS INT) AS delta, l_linenumber AS cts, l_returnflag = 'A' AS sync, CAST(floor(l_extendedprice) AS BIGINT) AS size FROM lineitem))""",
    "chapters": """chapters AS (SELECT o_custkey AS path, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS idx,
        CAST((epoch_us(o_orderdate) - epoch_us(TIMESTAMP '1990-01-01')) // 1000000 AS DOUBLE) AS start FROM orders)""",
    "audio": """audio AS (SELECT vec_id AS frame_no, vec_id * 64 AS pts, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS samples FROM embeddings)""",
    "gray": """gray AS (SELECT vec_id AS frame_no, list_transform(embedding, lambda x: greatest(0, least(255, CAST(floor(CAST(x AS DOUBLE) * 256) AS INT) + 128))) AS px FROM embeddings)""",
    "rgb": """rgb AS (SELECT a.frame_no // 3 AS frame_no, a.px AS r, b.px AS g, c.px AS b FROM gray a JOIN gray b ON b.frame_no = a.frame_no + 1 JOIN gray c ON c.frame_no = a.frame_no + 2 WHERE a.frame_no % 3 = 0)""",
}


def duck(*names: str) -> str:
    return "WITH " + ", ".join(DUCK[n] for n in names)
