"""Subtitle and sheet texts, names and option strings."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .timebase import ass_time, msf_time, srt_time


def parse_srt(tracks: DataFrame) -> DataFrame:
    """tracks (track, content) as cues (track, line_no, start_ms, end_ms, text, status), by start and place.

    Blocks are split at blank lines; the second line holds the times, the rest is text. A block with a bad time makes
    its whole track an error: one row with status 'error' and no cue.
    """
    text = F.regexp_replace(F.regexp_replace("content", "\r\n?", "\n"), "^﻿", "")
    blocks = tracks.select("track", F.posexplode(F.split(text, r"\n\n+")).alias("line_no", "block"))
    lines = F.filter(F.split("block", "\n"), lambda x: F.lit(True))
    rows = blocks.where(F.trim("block") != "").select("track", "line_no", lines.alias("l")).where(F.size("l") >= 2)
    at = F.split(F.element_at("l", 2), "-->")
    rows = rows.select("track", "line_no", srt_time(F.get(at, 0)).alias("start_ms"), srt_time(F.get(at, 1)).alias("end_ms"), F.array_join(F.slice("l", 3, 1_000_000), "\n").alias("text"))
    bad = rows.groupBy("track").agg(F.max((F.col("start_ms").isNull() | F.col("end_ms").isNull()).cast("int")).alias("bad"))
    both = rows.join(bad, "track")
    fine = both.where("bad = 0").select("track", "line_no", "start_ms", "end_ms", "text", F.lit("ok").alias("status"))
    wrong = bad.where("bad = 1").select("track", F.lit(None).cast("int").alias("line_no"), F.lit(None).cast("long").alias("start_ms"), F.lit(None).cast("long").alias("end_ms"), F.lit(None).cast("string").alias("text"), F.lit("error").alias("status"))
    return fine.unionByName(wrong)


def strip_ass_tags(text: Column | str) -> Column:
    """Without {\\...} override blocks; other braces stay; an unclosed block takes the rest of the text.

    A block may hold braces of its own, however deep: the text is cut before each brace and folded with the depth.
    """
    c = F.col(text) if isinstance(text, str) else text
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("depth"))

    def step(s, part):
        opens, closes, inside = part.startswith("{"), part.startswith("}"), s["depth"] > 0
        kept = F.when(inside & closes & (s["depth"] == 1), F.substring(part, 2, 2**31 - 1)).when(inside | part.startswith("{\\"), F.lit("")).otherwise(part)
        depth = F.when(inside, s["depth"] + opens.cast("int") - closes.cast("int")).otherwise(part.startswith("{\\").cast("int"))
        return F.struct(F.concat(s["out"], kept).alias("out"), depth.alias("depth"))

    folded = F.aggregate(F.split(c, r"(?=[{}])"), start, step)["out"]
    return F.when(c.contains("{\\"), folded).otherwise(c)


def split_dialogue(line: Column) -> Column:
    """The ten fields of an ASS event: the text may hold commas."""
    return F.transform(F.split(line, ",", 10), lambda x: F.trim(x))


def parse_ass(tracks: DataFrame) -> DataFrame:
    """tracks (track, content) as events (track, line_no, start_ms, end_ms, text, style); lines with bad times are skipped.

    The columns of [Events] are those of its Format line, if it has one; the text, which may hold commas, is the last.
    """
    body = F.regexp_replace(F.regexp_replace("content", "\r\n?", "\n"), "^\ufeff", "")
    names = F.transform(F.split(F.lower(F.regexp_extract(body, r"(?ms)^\[Events\][^\[]*?^Format:([^\n]*)$", 1)), ","), lambda x: F.trim(x))
    named = F.size(names) > 1
    at = lambda name, usual: F.when(named & (F.array_position(names, name) > 0), F.array_position(names, name).cast("int") - 1).otherwise(F.lit(usual))
    places = F.named_struct(F.lit("start"), at("start", 1), F.lit("end"), at("end", 2), F.lit("style"), at("style", 3), F.lit("text"), at("text", 9))
    rows = tracks.select("track", places.alias("p"), F.posexplode(F.split(body, "\n")).alias("line_no", "line"))
    rows = rows.where(F.col("line").startswith("Dialogue:")).withColumn("rest", F.substring("line", 10, 2**31 - 1))
    f = F.transform(F.split("rest", ",", F.col("p.text") + 1), lambda x: F.trim(x))
    field = lambda name: F.get(f, F.col(f"p.{name}"))
    text = strip_ass_tags(F.regexp_replace(field("text"), r"\\[Nn]", "\n"))
    out = rows.select("track", "line_no", ass_time(field("start")).alias("start_ms"), ass_time(field("end")).alias("end_ms"), text.alias("text"), field("style").alias("style"))
    return out.where("start_ms IS NOT NULL AND end_ms IS NOT NULL")


def parse_cue(sheets: DataFrame) -> DataFrame:
    """sheets (path, content) as chapters (path, idx, track, title, performer, start, end, file).

    A track's fields are those between its TRACK line and the next; its performer defaults to the sheet's. Tracks
    without INDEX 01 are no chapters. end is the next start, null for the last.
    """
    text = F.regexp_replace("content", "\r\n?", "\n")
    parts = F.split(text, r"(?m)^[ \t]*(?=TRACK )")
    one = lambda c, name: F.nullif(F.trim(F.regexp_replace(F.regexp_extract(c, rf"(?m)^[ \t]*{name}[ \t]+(.*?)[ \t]*$", 1), '"', "")), F.lit(""))
    rows = sheets.select("path", one(F.get(parts, 0), "PERFORMER").alias("artist"), F.nullif(F.regexp_extract(text, r'(?m)^[ \t]*FILE[ \t]+"?(.*?)"?(?:[ \t]+[A-Z0-9]+)?[ \t]*$', 1), F.lit("")).alias("file"), F.posexplode(parts).alias("n", "part")).where("n > 0")
    out = rows.select("path", F.regexp_extract("part", r"^TRACK[ \t]+(\d+)", 1).try_cast("int").alias("track"), one("part", "TITLE").alias("title"), F.coalesce(one("part", "PERFORMER"), "artist").alias("performer"), msf_time(F.regexp_extract("part", r"(?m)^[ \t]*INDEX[ \t]+01[ \t]+([0-9:]+)", 1)).alias("start"), "file", "n")
    out = out.where("start IS NOT NULL").withColumn("idx", F.expr("CAST(row_number() OVER (PARTITION BY path ORDER BY n) - 1 AS INT)"))
    return out.withColumn("end", F.expr("lead(start) OVER (PARTITION BY path ORDER BY n)")).select("path", "idx", "track", "title", "performer", "start", "end", "file")


def decode_sheet(data: bytes) -> str:
    """Text of a sheet: by its byte order mark, else the first of UTF-8, GBK, Big5, UTF-16 that fits."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if data.startswith(mark):
            return data[len(mark) :].decode(name, "replace")
    for name in ("utf-8", "gbk", "big5", "utf-16-le", "utf-16-be"):
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            continue
    return data.decode("gbk", "replace")


#: Format -> extensions, in the order in which they are tried.
EXTENSIONS = {
    "mp4": ["mp4", "m4a", "m4v", "mov"], "matroska": ["mkv", "mka"], "webm": ["webm"], "avi": ["avi"], "flv": ["flv"],
    "mpegts": ["ts", "m2ts", "mts"], "mpeg": ["mpg", "mpeg", "vob"], "mxf": ["mxf"], "3gp": ["3gp", "3g2"],
    "ogg": ["ogg", "ogv", "oga", "ogx"], "asf": ["asf", "wmv", "wma"], "wav": ["wav"], "flac": ["flac"], "mp3": ["mp3"],
    "aac": ["aac"], "aiff": ["aiff", "aif"], "cue": ["cue"], "image2": ["png", "jpg", "jpeg", "bmp"],
    "rawvideo": ["yuv", "rgb"], "rawaudio": ["pcm", "raw"], "m4v": ["m4v"], "h264": ["h264", "264"],
}


def format_of_name(name: Column | str) -> Column:
    """Format of a file name by what follows its last dot (or the whole name); null if unknown."""
    first: dict[str, str] = {}
    for fmt, exts in EXTENSIONS.items():
        for e in exts:
            first.setdefault(e, fmt)
    c = F.col(name) if isinstance(name, str) else name
    table = F.create_map(*(F.lit(x) for pair in first.items() for x in pair))
    return F.try_element_at(table, F.lower(F.element_at(F.split(c, r"\."), -1)))


@dataclass
class FilterSpec:
    name: str
    args: list[str] = field(default_factory=list)


def parse_filter_chain(text: str) -> list[FilterSpec]:
    """'volume=0.5,fade=in:0:2' as filters with their arguments; empty parts are dropped."""
    out = []
    for part in filter(None, map(str.strip, text.split(","))):
        name, _, args = part.partition("=")
        if name.strip():
            out.append(FilterSpec(name.strip(), [a.strip() for a in args.split(":") if a.strip()]))
    return out


def parse_size(text: str) -> tuple[int, int] | None:
    parts = text.split("x")
    return (int(parts[0]), int(parts[1])) if len(parts) == 2 and all(p.isdigit() for p in parts) else None


def is_url(path: Column | str) -> Column:
    return (F.col(path) if isinstance(path, str) else path).rlike("^https?://")


def file_name(path: Column | str) -> Column:
    """What follows the last slash, of an address without its query; without a name (a trailing slash of a path is none
    of it) the whole."""
    c = F.col(path) if isinstance(path, str) else path
    url = F.regexp_extract(c, r"([^/?]*)(?:\?[^/]*)?$", 1)
    name = F.regexp_extract(F.regexp_replace(c, "/+$", ""), r"([^/]*)$", 1)
    return F.when(is_url(c), url).when(name.isin("", ".", ".."), c).otherwise(name)
