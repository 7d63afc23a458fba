"""What a player does with frames, as batch operators: clock, synchronisation, seeking, volume, counters.

All order comes from columns and all work is by path, so files are played side by side.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values, in seconds: bounds of the threshold within which nothing is done, the delay from which frames are not
#: repeated but held, and the difference from which synchronising is given up.
LEAST, MOST, HOLD, GIVE_UP = 0.04, 0.1, 0.1, 10.0


def target_delay(delay: Column, video: Column, audio: Column) -> Column:
    """How long a video frame stays, given its nominal delay and the two clocks: shorter if late, longer if early."""
    diff = video - audio
    bound = F.greatest(F.lit(LEAST), F.least(F.lit(MOST), delay))
    early = F.when(delay > HOLD, delay + diff).otherwise(delay * 2)
    return F.when(F.isnan(diff) | (F.abs(diff) >= GIVE_UP), delay).when(diff <= -bound, F.greatest(delay + diff, F.lit(0.0))).when(diff >= bound, early).otherwise(delay)


def with_audio_clock(frames: DataFrame, updates: DataFrame) -> DataFrame:
    """frames (path, seq, now) with audio: the last update (path, now, pts) at or before now, moved on to now; null before.

    An as-of join: both sides are merged in order, neither is crossed with the other. Times are seconds.
    """
    kind = "struct<now:double,pts:double>"
    a = updates.select("path", "now", F.lit(0).alias("k"), F.lit(None).cast("long").alias("seq"), F.struct(F.col("now").cast("double").alias("now"), F.col("pts").cast("double").alias("pts")).alias("u"))
    b = frames.select("path", "now", F.lit(1).alias("k"), F.col("seq").cast("long").alias("seq"), F.lit(None).cast(kind).alias("u"))
    last = F.last("u", ignorenulls=True).over(Window.partitionBy("path").orderBy("now", "k", "seq").rowsBetween(Window.unboundedPreceding, 0))
    return a.union(b).withColumn("u", last).where("k = 1").select("path", "seq", "now", (F.col("u.pts") + F.col("now") - F.col("u.now")).alias("audio"))


def skip_until(frames: DataFrame, threshold: float) -> DataFrame:
    """frames (path, seq, time) from the first on whose time is at least the threshold; those before are decoded only."""
    reached = F.max((F.col("time") >= threshold).cast("int")).over(Window.partitionBy("path").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    return frames.withColumn("_reached", reached).where("_reached = 1").drop("_reached")


def output_volume(samples: Column | str, percent: Column, muted: Column) -> Column:
    """Samples at the output: times percent / 100, at most 1; 0 while muted."""
    gain = F.when(muted, F.lit(0.0)).otherwise(F.least(percent, F.lit(100)) / 100)
    return F.transform(F.col(samples) if isinstance(samples, str) else samples, lambda x: x * gain)


CLOCK = ("audio", "seek", "confirm", "pause")


def clock(events: DataFrame) -> DataFrame:
    """events (path, seq, now, kind, pts) with time: what the player's clock shows after each; now and pts in microseconds.

    audio sets the clock to pts unless a seek is pending; seek freezes it at pts until confirm; pause stops it at the last
    pts and lets it go on from there. Before the first audio it shows the time since the file's first event. Files are
    folded in order, batch by batch, with the running state only.
    """

    def run(batches):
        path, state = object(), None
        for b in batches:
            out = []
            for p, now, kind, pts in zip(*(b.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                if p != path:
                    path, state = p, [now, 0, None, False, False]  # begin, pts, set at, seek pending, paused
                if kind == "audio" and not state[3]:
                    state[1], state[2] = pts, now
                elif kind == "seek":
                    state[1], state[2], state[3] = pts, None, True
                elif kind == "confirm":
                    state[2], state[3] = now, False
                elif kind == "pause":
                    if state[4] and state[2] is not None:
                        state[2] = now
                    state[4] = not state[4]
                begin, base, at, pending, paused = state
                out.append(base if paused or pending else now - begin if at is None else base + now - at)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.int64())], names=["path", "seq", "time"])

    rows = events.select("path", F.col("seq").cast("long").alias("seq"), F.col("now").cast("long").alias("now"), "kind", F.col("pts").cast("long").alias("pts"))
    parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = dict(rows.dtypes)["path"]
    return rows.repartition(parts, "path").sortWithinPartitions("path", "seq").mapInArrow(run, f"path {kind}, seq long, time long")


def back_in_chapters(now: Column, target: Column, start: Column, before: Column, grace: float = 3.0) -> Column:
    """Where a step back from now to target ends, in a chapter that starts at start, the one before at before (or null).

    Past the chapter's start the step ends there; within `grace` seconds of it, at the start of the one before.
    """
    out = F.when(now - start > grace, start).when(before.isNotNull(), before).otherwise(target)
    return F.when(target < start, out).otherwise(target)


def counters(frames: DataFrame) -> DataFrame:
    """(path, frames, gops, sent, dropped) of frames (path, is_keyframe, shown)."""
    return frames.groupBy("path").agg(F.count("*").alias("frames"), F.sum(F.col("is_keyframe").cast("long")).alias("gops"), F.sum(F.col("shown").cast("long")).alias("sent"), F.sum((~F.col("shown")).cast("long")).alias("dropped"))


def seek_point(packets: DataFrame, targets: DataFrame) -> DataFrame:
    """targets (path, stream_index, target in the stream's time base) with seq: the packet where reading starts.

    That is the last keyframe at or before the target in time, or the stream's first packet if there is none. Packets
    without pts go by dts. Both sides are merged in order.
    """
    time = F.coalesce("pts", "dts")
    p = packets.select("path", "stream_index", time.alias("t"), F.lit(0).alias("k"), "seq", "is_keyframe")
    t = targets.select("path", "stream_index", F.col("target").cast("long").alias("t"), F.lit(1).alias("k"), F.lit(None).cast("long").alias("seq"), F.lit(False).alias("is_keyframe"))
    w = Window.partitionBy("path", "stream_index").orderBy("t", "k", "seq")
    found = F.last(F.when(F.col("is_keyframe"), F.col("seq")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    first = F.min("seq").over(Window.partitionBy("path", "stream_index"))
    return p.where("t IS NOT NULL").unionByName(t).withColumn("found", F.coalesce(found, first)).where("k = 1").select("path", "stream_index", F.col("t").alias("target"), F.col("found").alias("seq"))
