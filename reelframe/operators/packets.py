"""Packet operators: trimming, routing, counting, merging, sample tables, seeking, muxing order.

Packets carry path, seq (arrival order in the file), stream_index, pts/dts, tb_num and tb_den. All order comes from
columns; windows are by file or track, so files are processed side by side.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timebase import rescale, seconds_multiplied

_TIME = ("pts", "tb_num", "tb_den")


def trim_start(packets: DataFrame, ss: float) -> DataFrame:
    """Packets at or after ss seconds; unknown times go if ss > 0. Sits below decoding, so it prunes before any kernel."""
    return packets.where(seconds_multiplied(*_TIME) >= ss) if ss > 0 else packets


def limit_duration(packets: DataFrame, t: float, ss: float = 0.0) -> DataFrame:
    """Packets before the first, in arrival order of its file, that lies more than t seconds after ss."""
    over = F.coalesce((seconds_multiplied(*_TIME) - ss > t).cast("int"), F.lit(0))
    seen = F.max(over).over(Window.partitionBy("path").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    return packets.withColumn("_over", seen).where("_over = 0").drop("_over")


def route(packets: DataFrame, outputs: DataFrame) -> DataFrame:
    """Packets of the streams in outputs (path, stream_index, out_index), relabelled to out_index; payloads untouched.

    The planner broadcasts the outputs if they are below its threshold.
    """
    return packets.join(outputs, ["path", "stream_index"]).withColumn("stream_index", F.col("out_index")).drop("out_index")


def default_streams(streams: DataFrame, video: bool = False) -> DataFrame:
    """Streams that are processed: audio always, video only if one of its options is given, others never."""
    return streams.where(F.col("media_type").isin("audio", "video") if video else F.col("media_type") == "audio")


def count_by_stream(streams: DataFrame, packets: DataFrame) -> DataFrame:
    """Every stream with its number of packets, 0 if it has none."""
    n = packets.groupBy("path", "stream_index").agg(F.count("*").alias("nb_read_packets"))
    return streams.join(n, ["path", "stream_index"], "left").withColumn("nb_read_packets", F.coalesce("nb_read_packets", F.lit(0)))


def totals(packets: DataFrame) -> DataFrame:
    """Packets and bytes of each file."""
    return packets.groupBy("path").agg(F.count("*").alias("packets"), F.sum("size").alias("bytes"))


def container_bit_rate(files: DataFrame) -> DataFrame:
    """files (bytes, duration in seconds) with bit_rate: whole bits a second, null without a positive duration."""
    return files.withColumn("bit_rate", F.when(F.col("duration") > 0, F.round(F.col("bytes") * 8 / F.col("duration")).cast("long")))


def merge_by_dts(packets: DataFrame) -> DataFrame:
    """Place of each packet in its file when streams are merged by decoding time in microseconds, then place in the file."""
    us = rescale("dts", F.col("tb_num"), F.col("tb_den"), F.lit(1), F.lit(1_000_000))
    order = Window.partitionBy("path").orderBy("dts_us", "pos", "stream_index")
    return packets.withColumn("dts_us", us).withColumn("merged", F.row_number().over(order) - 1)


def _track():
    return Window.partitionBy("track").orderBy("idx")


def sample_times(index: DataFrame) -> DataFrame:
    """Sample table with dts (sum of the deltas before) and pts = dts + cts."""
    dts = F.coalesce(F.sum("delta").over(_track().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return index.withColumn("dts", dts).withColumn("pts", F.col("dts") + F.col("cts"))


def chunk_offsets(index: DataFrame) -> DataFrame:
    """Sample table with the byte offset of each sample in its chunk."""
    w = Window.partitionBy("track", "chunk").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    return index.withColumn("offset", F.coalesce(F.sum("size").over(w), F.lit(0)))


def expand_runs(runs: DataFrame, value: str) -> DataFrame:
    """Run-length rows (track, run, n, value) as one row for each sample: track, idx, value."""
    first = F.coalesce(F.sum("n").over(Window.partitionBy("track").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = runs.withColumn("_first", first).where("n > 0")
    return rows.select("track", F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("n") - 1)).alias("idx"), value)


def keyframe_before(index: DataFrame) -> DataFrame:
    """Sample table with keyframe: the nearest sync sample at or before each sample, 0 if there is none."""
    last = F.last(F.when(F.col("sync"), F.col("idx")), ignorenulls=True).over(_track().rowsBetween(Window.unboundedPreceding, 0))
    return index.withColumn("keyframe", F.coalesce(last, F.lit(0)))


def sample_chunks(index: DataFrame, runs: DataFrame, chunks: int | None = None) -> DataFrame:
    """Sample table (track, idx) with chunk and in_chunk, from runs (track, first_chunk from 1, samples_per_chunk).

    A run goes on to the next one's first chunk, the last to `chunks` (null: on and on). Samples are merged with the
    starts of the runs in order, as every run begins where the samples of those before it end; samples beyond the last
    chunk, and those of tracks without runs, are in chunk 0 as its first.
    """
    w = Window.partitionBy("track").orderBy("first_chunk")
    span = F.lead("first_chunk").over(w) - F.col("first_chunk")
    starts = runs.withColumn("span", span).withColumn("n", F.coalesce(F.col("span") * F.col("samples_per_chunk"), F.lit(0)))
    starts = starts.withColumn("idx", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    starts = starts.where("span IS NULL OR n > 0").select("track", "idx", F.lit(0).alias("k"), F.struct(F.col("idx").alias("from"), F.col("first_chunk").alias("chunk"), F.col("samples_per_chunk").alias("each")).alias("run"))
    both = starts.unionByName(index.select("track", "idx", F.lit(1).alias("k"), F.lit(None).cast(starts.schema["run"].dataType).alias("run")))
    run = F.last("run", ignorenulls=True).over(Window.partitionBy("track").orderBy("idx", "k").rowsBetween(Window.unboundedPreceding, 0))
    rows = both.withColumn("run", run).where("k = 1")
    place = F.col("idx") - F.col("run.from")
    chunk = F.col("run.chunk") - 1 + F.floor(place / F.nullif(F.col("run.each"), F.lit(0)))
    out = rows.withColumn("chunk", chunk).withColumn("in_chunk", place % F.nullif(F.col("run.each"), F.lit(0)))
    inside = F.col("chunk").isNotNull() & (F.lit(True) if chunks is None else F.col("chunk") < chunks)
    return out.select("track", "idx", F.when(inside, F.col("chunk")).otherwise(0).cast("long").alias("chunk"), F.when(inside, F.col("in_chunk")).otherwise(0).cast("long").alias("in_chunk"))


def sync_samples(index: DataFrame, syncs: DataFrame) -> DataFrame:
    """Sample table (track, idx) with sync: whether syncs (track, idx) names it; tracks that syncs doesn't have: all are."""
    marked = syncs.select("track", "idx").distinct().withColumn("named", F.lit(True))
    listed = syncs.select("track").distinct().withColumn("listed", F.lit(True))
    rows = index.join(marked, ["track", "idx"], "left").join(listed, "track", "left")
    return rows.withColumn("sync", F.col("named").isNotNull() | F.col("listed").isNull()).drop("named", "listed")


def keyframe_entry(entries: DataFrame, targets: DataFrame) -> DataFrame:
    """targets (path, stream_index, target: n-th packet) with entry: where reading starts in an index of packets.

    entries are (path, pos, stream_index, media_type, is_keyframe). Video starts at the last keyframe at or before the
    target, or at the last of all if the target lies beyond the end; other streams at the target itself, or at entry 0.
    """
    w = Window.partitionBy("path", "stream_index").orderBy("pos")
    rows = entries.withColumn("n", F.row_number().over(w) - 1)
    rows = rows.withColumn("last_key", F.last(F.when(F.col("is_keyframe"), F.col("pos")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ends = rows.groupBy("path", "stream_index").agg(F.max("media_type").alias("media"), F.max("n").alias("most"), F.max(F.when(F.col("is_keyframe"), F.col("pos"))).alias("final_key"))
    out = targets.join(ends, ["path", "stream_index"], "left").join(rows.select("path", "stream_index", F.col("n").alias("target"), "pos", "last_key"), ["path", "stream_index", "target"], "left")
    video = F.col("media") == "video"
    entry = F.when(video, F.when(F.col("target") > F.col("most"), F.col("final_key")).otherwise(F.col("last_key"))).otherwise(F.col("pos"))
    return out.select("path", "stream_index", "target", F.coalesce(entry, F.lit(0)).cast("long").alias("entry"))


def seek(times: DataFrame, targets: DataFrame) -> DataFrame:
    """targets (track, target) with sample: the last one whose dts is not after target, in its run by whole deltas.

    Targets join the timeline as rows of their own and take the last sample before them, so neither side is crossed
    with the other. A target before the first sample gets 0.
    """
    both = times.select("track", F.col("dts").alias("_t"), F.lit(0).alias("_kind"), "idx").unionByName(targets.select("track", F.col("target").alias("_t"), F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("idx")))
    w = Window.partitionBy("track").orderBy("_t", "_kind", "idx").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("sample", F.coalesce(F.last("idx", ignorenulls=True).over(w), F.lit(0)))
    return found.where("_kind = 1").select("track", F.col("_t").alias("target"), "sample")


def mux_durations(packets: DataFrame) -> DataFrame:
    """Durations a muxer writes: the dts step from the packet before (at least 0); the first takes the second's."""
    w = Window.partitionBy("path", "stream_index").orderBy("seq")
    back, ahead = F.lag("dts").over(w), F.lead("dts").over(w)
    step = F.when(back.isNotNull(), F.greatest(F.col("dts") - back, F.lit(0)))  # greatest() would pass over the null
    following = F.when(ahead.isNotNull(), F.greatest(ahead - F.col("dts"), F.lit(0)))
    return packets.withColumn("mux_duration", F.coalesce(step, following, F.lit(0)))


def chapter_ends(chapters: DataFrame, total: DataFrame | None = None) -> DataFrame:
    """Chapters with `end`: the next one's start, or the file's total duration (path, duration), or null."""
    out = chapters.withColumn("end", F.lead("start").over(Window.partitionBy("path").orderBy("idx")))
    if total is not None:
        out = out.join(total, "path", "left").withColumn("end", F.coalesce("end", "duration")).drop("duration")
    return out


def chapter_at(chapters: DataFrame, times: DataFrame) -> DataFrame:
    """times (path, time) with the idx of the first chapter that holds each (start <= time < end, null: open), else null.

    Chapters follow each other in time, so the one that holds a time is the last that starts at or before it (of several
    with one start the first that ends later): both sides are merged in order, none is crossed with the other.
    """
    begin = F.coalesce("start", F.lit(0.0)).cast("double")
    until = F.coalesce("end", F.lit(float("inf"))).cast("double")
    held = chapters.select("path", begin.alias("t"), until.alias("until"), "idx").where("t < until").groupBy("path", "t").agg(F.min_by(F.struct("idx", "until"), "idx").alias("c"))
    kind = held.schema["c"].dataType
    both = held.select("path", "t", F.lit(0).alias("k"), "c").unionByName(times.select("path", F.col("time").cast("double").alias("t"), F.lit(1).alias("k"), F.lit(None).cast(kind).alias("c")))
    last = F.last("c", ignorenulls=True).over(Window.partitionBy("path").orderBy("t", "k").rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("c", last).where("k = 1")
    return found.select("path", F.col("t").alias("time"), F.when(F.col("t") < F.col("c.until"), F.col("c.idx")).alias("chapter"))


def typed_index(streams: DataFrame) -> DataFrame:
    """Streams with their number among those of their type."""
    w = Window.partitionBy("path", "media_type").orderBy("stream_index")
    return streams.withColumn("type_index", F.row_number().over(w) - 1)


def psi_marks(packets: DataFrame, every: int = 40) -> DataFrame:
    """Packets with psi: whether the program tables are repeated before it (each `every`-th written packet)."""
    n = F.row_number().over(Window.partitionBy("path").orderBy("seq")) - 1
    return packets.withColumn("psi", n % every == 0)


def continuity(packets: DataFrame) -> DataFrame:
    """Packets with the 4-bit continuity counter of their stream."""
    n = F.row_number().over(Window.partitionBy("path", "stream_index").orderBy("seq")) - 1
    return packets.withColumn("cc", n % 16)


def clusters(packets: DataFrame, threshold_ms: int = 5000) -> DataFrame:
    """(path, seq, cluster): a new cluster starts when a packet lies threshold_ms or more after the cluster's start.

    Packets without a time stay in the running cluster. Every start depends on the one before, so files are folded in
    order: rows come sorted by file and place, batch by batch, and only the running start is kept.
    """

    def run(batches):
        path, start, cluster = object(), None, -1
        for b in batches:
            out = []
            for p, t in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if p != path:
                    path, start, cluster = p, None, -1
                if cluster < 0 or None not in (t, start) and t - start >= threshold_ms:
                    start, cluster = t, cluster + 1
                elif start is None:
                    start = t
                out.append(cluster)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.int32())], names=["path", "seq", "cluster"])

    ms = rescale("pts", F.col("tb_num"), F.col("tb_den"), F.lit(1), F.lit(1000))
    rows = packets.select("path", "seq", ms.alias("ms"))
    kinds = dict(rows.dtypes)
    parts = int(packets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "path").sortWithinPartitions("path", "seq")
    return rows.mapInArrow(run, f"path {kinds['path']}, seq {kinds['seq']}, cluster int")


def reassemble(fragments: DataFrame) -> DataFrame:
    """Fragments (path, stream_index, seq, start flag, size) as units: number, fragments and bytes; leading ones without a start go."""
    w = Window.partitionBy("path", "stream_index").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    unit = F.sum(F.col("start").cast("int")).over(w)
    return fragments.withColumn("unit", unit).where("unit > 0").groupBy("path", "stream_index", "unit").agg(F.count("*").alias("fragments"), F.sum("size").alias("bytes"), F.min("seq").alias("first_seq"))


def presentation_order(frames: DataFrame) -> DataFrame:
    """Frames (path, sequence, poc, decode_order) with their place in the order of showing."""
    return frames.withColumn("shown", F.row_number().over(Window.partitionBy("path", "sequence").orderBy("poc", "decode_order")) - 1)


def frame_durations(frames: DataFrame, longest: float = 10.0) -> DataFrame:
    """Frames (path, seq, time) with duration: the step from the one before, 0 if not positive or over `longest` seconds."""
    step = F.col("time") - F.lag("time").over(Window.partitionBy("path").orderBy("seq"))
    return frames.withColumn("duration", F.when((step > 0) & (step <= longest), step).otherwise(0.0))
