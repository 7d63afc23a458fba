"""Cue sheets joined with their audio, raw picture dumps, and chapter navigation."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..codecs.pcm import encode_raw
from ..functions.text import decode_sheet, parse_cue
from ..operators.packets import chapter_at
from . import media as M


def read_cues(media: DataFrame) -> DataFrame:
    """Chapters of the .cue files of media, with the path of the audio file each refers to and the last chapter's end.

    A sheet's FILE is resolved beside the sheet and joined with the audio files by path; sheets whose audio is missing
    keep null ends and streams.
    """

    def text(batches):
        for b in batches:
            out = [decode_sheet(c or b"") for c in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["path", "content"])

    cue = F.lower("path").endswith(".cue")
    chapters = parse_cue(media.where(cue).select("path", "content").mapInArrow(text, "path string, content string"))
    audio = F.concat(F.regexp_extract("path", r"^(.*[/\\])?[^/\\]*$", 1), "file")
    chapters = chapters.withColumn("audio", F.when(F.col("file").startswith("/"), F.col("file")).otherwise(audio))
    s = M.streams(media.where(~cue)).where("status = 'ok' AND index = 0")
    s = s.select(F.col("path").alias("audio"), (F.col("duration") * F.col("tb_num") / F.col("tb_den")).alias("_total"), "codec", "rate")
    return chapters.join(s, "audio", "left").withColumn("end", F.coalesce("end", "_total")).drop("_total", "file")


def cue_packets(media: DataFrame) -> DataFrame:
    """Packets of the audio files that sheets refer to, under the sheet's path, each with the chapter that it begins in."""
    chapters = read_cues(media).where("codec IS NOT NULL")
    sheets = chapters.select(F.col("path").alias("sheet"), F.col("audio").alias("path")).distinct()
    p = M.packets(media.where(~F.lower("path").endswith(".cue"))).where("status = 'ok'").join(sheets, "path")
    p = p.withColumn("time", F.col("pts") * F.col("tb_num") / F.col("tb_den")).drop("path").withColumnRenamed("sheet", "path")
    at = chapter_at(chapters.select("path", "idx", "start", "end"), p.select("path", "time").distinct())
    return p.join(at, ["path", "time"], "left").drop("time")


def previous_chapter(chapters: DataFrame, now: float, grace: float = 3.0) -> DataFrame:
    """Where 'back' leads in each file: the current chapter's start, or within `grace` seconds of it the one before."""
    at = chapters.where(F.col("start") <= now - grace).groupBy("path").agg(F.max("start").alias("target"))
    return chapters.select("path").distinct().join(at, "path", "left").select("path", F.coalesce("target", F.lit(0.0)).alias("target"))


def next_chapter(chapters: DataFrame, now: float) -> DataFrame:
    """Where 'on' leads in each file: the first chapter that starts after now; files without one are left out."""
    return chapters.where(F.col("start") > now).groupBy("path").agg(F.min("start").alias("target"))


def raw_dump(frames: DataFrame, most: int = 10, fmt: str | None = None) -> DataFrame:
    """(path, content): the planes of the first `most` frames of each file one after the other.

    Frames of another pixel format than yuv420p, if it is told, are converted to it.
    """
    if fmt not in (None, "yuv420p"):
        from ..plans.pictures import Pictures

        frames = Pictures(frames, fmt).yuv420().run()
    first = frames.withColumn("_n", F.row_number().over(_by_frame())).where(F.col("_n") <= most)

    def run(table: pa.Table) -> pa.Table:
        import numpy as np

        rows = sorted(table.to_pylist(), key=lambda r: r["frame_no"])
        body = b"".join(encode_raw([np.frombuffer(p, np.uint8) for p in r["planes"]]) for r in rows)
        return pa.table({"path": [rows[0]["path"]], "content": pa.array([body], pa.binary())})

    return first.select("path", "frame_no", "planes").groupBy("path").applyInArrow(run, "path string, content binary")


def _by_frame():
    from pyspark.sql import Window

    return Window.partitionBy("path").orderBy("frame_no")
