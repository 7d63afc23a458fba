"""Queries on probing, selection, report writers, subtitles and codecs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..codecs import flac, pcm
from ..functions import bits as B
from ..functions import text as X
from ..operators import packets as P
from ..operators import report as R
from ..sources.probe import probe
from . import views as V
from .registry import query

#: A head for each kind of file, by doc_id modulo 8, and what it is.
HEADS = ("RIFF0000WAVEfmt ", "FORM0000AIFFCOMM", "fLaC000000000000", "OggS000000000000", "0000ftypisom0000", "FLV\x01000000000000", "RIFF0000AVI LIST", "0000mdat00000000")
KINDS = ("wav", "aiff", "flac", "ogg", "mp4", "flv", "avi", "mp4")


def _media(spark, d):
    head = F.element_at(F.array(*map(F.lit, HEADS)), (F.col("doc_id") % 8 + 1).cast("int"))
    return V.table(spark, d, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".bin")).alias("path"), F.concat(head, "text").cast("binary").alias("content"))


_KIND = "[" + ", ".join(f"'{k}'" for k in KINDS) + "][doc_id % 8 + 1]"


@query(f"SELECT CAST(doc_id AS VARCHAR) || '.bin' AS path, {_KIND} AS format, CASE WHEN doc_id % 8 = 7 THEN 75 ELSE 100 END AS score FROM documents")
def probe_magic_argmax(spark, d):
    return probe(_media(spark, d))


_NAMES = ("a.MP4", "b.m4v", "c.mkv", "d", "wav", "e.tar.h264", "f.ogx", "g.xyz")
_WANT = ("mp4", "mp4", "matroska", None, "wav", "h264", "ogg", None)


@query("SELECT p_partkey, [" + ", ".join(f"'{n}'" for n in _NAMES) + "][p_partkey % 8 + 1] AS name, [" + ", ".join(f"'{n}'" if n else "NULL" for n in _WANT) + "][p_partkey % 8 + 1] AS format FROM part")
def format_from_extension(spark, d):
    name = F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("p_partkey") % 8 + 1).cast("int"))
    return V.table(spark, d, "part").select("p_partkey", name.alias("name")).withColumn("format", X.format_of_name("name"))


@query("WITH n AS (SELECT p_brand || ' ' || p_size AS n, p_retailprice AS r FROM part) SELECT coalesce(a.n, b.n) AS name, (CASE WHEN a.n IS NULL THEN '.' ELSE 'D' END) || (CASE WHEN b.n IS NULL THEN '.' ELSE 'E' END) AS flags FROM (SELECT DISTINCT n FROM n WHERE r < 1400) a FULL JOIN (SELECT DISTINCT n FROM n WHERE r >= 1200) b ON a.n = b.n")
def codec_dim_full_outer(spark, d):
    """Names of the cheaper and of the dearer parts, which overlap, as lists of readers and writers."""
    p = V.table(spark, d, "part").select(F.concat_ws(" ", "p_brand", F.col("p_size").cast("string")).alias("name"), "p_retailprice")
    return R.flags_table(p.where("p_retailprice < 1400"), p.where("p_retailprice >= 1200"))


_S = V.duck("packets", "streams")


@query(f"{_S} SELECT path, stream_index FROM (SELECT *, row_number() OVER (PARTITION BY path, media_type ORDER BY stream_index) - 1 AS k FROM streams) WHERE media_type = 'video' AND k = 1")
def select_streams(spark, d):
    return R.select_streams(V.streams(spark, d), "v:1").select("path", "stream_index")


def _fields(spark, d):
    """Report fields of the packets' streams: path, section, number, ordinal, key, value."""
    s = P.typed_index(V.streams(spark, d))
    pairs = F.array(*(F.struct(F.lit(k).alias("key"), F.col(c).cast("string").alias("value")) for k, c in (("index", "stream_index"), ("codec_type", "media_type"), ("tag", "note"))))
    s = s.withColumn("note", F.concat(F.lit('say "hi", '), F.col("media_type")))
    s = s.withColumn("number", F.expr("CAST(row_number() OVER (PARTITION BY path ORDER BY stream_index) - 1 AS INT)"))
    return s.select("path", F.lit("STREAM").alias("section"), "number", F.posexplode(pairs).alias("ordinal", "p")).select("path", "section", "number", "ordinal", "p.key", "p.value")


_F = f"""{_S}, f AS (SELECT path, 'STREAM' AS section, CAST(row_number() OVER (PARTITION BY path ORDER BY stream_index) - 1 AS INT) AS number,
    stream_index, media_type FROM streams), l AS (SELECT path, section, number, 0 AS ordinal, 'index' AS key, CAST(stream_index AS VARCHAR) AS value FROM f
    UNION ALL SELECT path, section, number, 1, 'codec_type', media_type FROM f UNION ALL SELECT path, section, number, 2, 'tag', 'say "hi", ' || media_type FROM f)"""


@query(f"{_F} SELECT path, section, number, key, value FROM l WHERE key IN ('index', 'tag')")
def show_entries_projection(spark, d):
    return R.show_entries(_fields(spark, d), "streams=index,tag:format").select("path", "section", "number", "key", "value")


@query(f"""{_F} SELECT path, string_agg('stream.' || number || '.' || key || '="' || replace(value, '"', '\\"') || '"', chr(10) ORDER BY number, ordinal) || chr(10) AS report FROM l GROUP BY path""")
def writer_flat(spark, d):
    return R.write_report(_fields(spark, d), "flat")


@query(f"""{_F} SELECT path, 'section,key,value' || chr(10) || string_agg('stream,' || key || ',' || CASE WHEN value LIKE '%"%' OR value LIKE '%,%' THEN '"' || replace(value, '"', '""') || '"' ELSE value END, chr(10) ORDER BY number, ordinal) || chr(10) AS report FROM l GROUP BY path""")
def writer_csv(spark, d):
    return R.write_report(_fields(spark, d), "csv")


@query(f"""{_F}, s AS (SELECT path, number, string_agg(key || '=' || value, chr(10) ORDER BY ordinal) AS b, string_agg('|' || key || '=' || value, '' ORDER BY ordinal) AS c FROM l GROUP BY path, number) SELECT path, string_agg('[STREAM]' || chr(10) || b || chr(10) || '[/STREAM]', chr(10) ORDER BY number) || chr(10) AS report FROM s GROUP BY path""")
def writer_default(spark, d):
    return R.write_report(_fields(spark, d), "default")


@query(f"""{_F}, s AS (SELECT path, number, string_agg('|' || key || '=' || value, '' ORDER BY ordinal) AS c FROM l GROUP BY path, number) SELECT path, string_agg('stream' || c, chr(10) ORDER BY number) || chr(10) AS report FROM s GROUP BY path""")
def writer_compact(spark, d):
    return R.write_report(_fields(spark, d), "compact")


@query(f"""{_F}, s AS (SELECT path, number, string_agg(key || '=' || value, chr(10) ORDER BY ordinal) AS b FROM l GROUP BY path, number) SELECT path, string_agg('[stream]' || chr(10) || b || chr(10), chr(10) ORDER BY number) || chr(10) AS report FROM s GROUP BY path""")
def writer_ini(spark, d):
    return R.write_report(_fields(spark, d), "ini")


@query(f"""{_F}, s AS (SELECT path, number, string_agg('    <' || key || '>' || replace(value, '"', '&quot;') || '</' || key || '>', chr(10) ORDER BY ordinal) AS b FROM l GROUP BY path, number)
    SELECT path, '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<ffprobe>' || chr(10) || string_agg('  <stream>' || chr(10) || b || chr(10) || '  </stream>', chr(10) ORDER BY number) || chr(10) || '</ffprobe>' || chr(10) AS report FROM s GROUP BY path""")
def writer_xml(spark, d):
    return R.write_report(_fields(spark, d), "xml")


_JSON = f"""{_F}, s AS (SELECT path, number, string_agg('            "' || key || '": ' || CASE WHEN key = 'index' THEN value ELSE '"' || replace(value, '"', '\\"') || '"' END, ',' || chr(10) ORDER BY ordinal) AS b FROM l GROUP BY path, number),
    j AS (SELECT path, '{{' || chr(10) || '    "streams": [' || chr(10) || string_agg('        {{' || chr(10) || b || chr(10) || '        }}', ',' || chr(10) ORDER BY number) || chr(10) || '    ]' || chr(10) || '}}' || chr(10) AS report FROM s GROUP BY path)"""


def _typed(spark, d):
    return _fields(spark, d).withColumn("value_type", F.when(F.col("key") == "index", "unsigned").otherwise("string"))


@query(f"{_JSON} SELECT path, report FROM j")
def writer_json(spark, d):
    return R.write_report(_typed(spark, d), "json")


@query(f"{_JSON} SELECT path, json(report) || chr(10) AS report FROM j")
def writer_json_compact(spark, d):
    form, options = R.output_format("json=compact=1")
    return R.write_report(_typed(spark, d), form, options.get("compact") == "1")


def _cues(spark, d):
    t = F.col("turn")
    clock = lambda ms, tail: F.format_string("%02d:%02d:%02d" + tail, F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, *([ms % 1000] if tail == ",%03d" else [F.floor(ms % 1000 / 10)]))
    return V.table(spark, d, "conversations").select("conv_id", "turn", F.trim(F.regexp_replace("text", r"[\s\p{Z}]+", " ")).alias("line"), *(clock(x, tail).alias(n) for n, x, tail in (("s0", t * 2000, ",%03d"), ("s1", t * 2000 + 1500, ",%03d"), ("a0", t * 2000, ".%02d"), ("a1", t * 2000 + 1500, ".%02d"))))


_TURNS = "SELECT CAST(conv_id AS VARCHAR) AS track, turn * 2000 AS start_ms, turn * 2000 + 1500 AS end_ms, length(trim(regexp_replace(text, '[\\s\\p{Z}]+', ' ', 'g'))) AS chars FROM conversations"


@query(_TURNS)
def srt_parse(spark, d):
    c = _cues(spark, d)
    block = F.concat_ws("\n", (F.col("turn") + 1).cast("string"), F.concat("s0", F.lit(" --> "), "s1"), "line")
    tracks = c.groupBy(F.col("conv_id").cast("string").alias("track")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("content"))
    return X.parse_srt(tracks).select("track", "start_ms", "end_ms", F.length("text").cast("long").alias("chars"))


@query(_TURNS)
def ass_parse(spark, d):
    c = _cues(spark, d)
    line = F.concat(F.lit("Dialogue: 0,"), "a0", F.lit(","), "a1", F.lit(",Default,,0,0,0,,{\\b1}"), F.regexp_replace("line", r"[{}\\]", "_"))
    tracks = c.groupBy(F.col("conv_id").cast("string").alias("track")).agg(F.concat(F.lit("[Events]\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("b")))), lambda x: x["b"]), "\n")).alias("content"))
    return X.parse_ass(tracks).select("track", "start_ms", "end_ms", F.length("text").cast("long").alias("chars"))


@query("SELECT p_partkey, p_brand || p_type || ' {x} ' AS text FROM part")
def strip_ass_tags(spark, d):
    text = F.concat(F.lit("{\\an8}"), "p_brand", F.lit("{\\c&H{1}&}"), "p_type", F.lit(" {x} {\\open"), "p_name")
    return V.table(spark, d, "part").select("p_partkey", X.strip_ass_tags(text).alias("text"))


@query(
    """WITH o AS (SELECT o_custkey AS c, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders), s AS (SELECT *, CAST(n * 60 + k % 60 AS DOUBLE) + CAST(k % 75 AS DOUBLE) / 75 AS start FROM o)
    SELECT CAST(c AS VARCHAR) AS path, CAST(n - 1 AS INT) AS idx, CAST(n AS INT) AS track, 'Song ' || k AS title, 'Band ' || c AS performer, round(start, 9) AS start, round(lead(start) OVER (PARTITION BY c ORDER BY n), 9) AS "end", 'disc ' || c || '.wav' AS file FROM s"""
)
def cue_parse(spark, d):
    o = V.table(spark, d, "orders").select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("k")).withColumn("n", F.expr("row_number() OVER (PARTITION BY c ORDER BY k)"))
    part = F.format_string('  TRACK %02d AUDIO\n    TITLE "Song %d"\n    INDEX 01 %02d:%02d:%02d', "n", "k", "n", F.col("k") % 60, F.col("k") % 75)
    sheets = o.groupBy("c").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", part.alias("p")))), lambda x: x["p"]), "\n").alias("tracks"))
    sheets = sheets.select(F.col("c").cast("string").alias("path"), F.format_string('PERFORMER "Band %d"\nTITLE "Disc"\nFILE "disc %d.wav" WAVE\n%s\n', "c", "c", "tracks").alias("content"))
    return X.parse_cue(sheets).withColumns({"start": F.round("start", 9), "end": F.round("end", 9)})


_A = V.duck("audio")
_S16 = "list_transform(samples, lambda x: CAST(greatest(-32768, least(32767, round(x * 32768))) AS BIGINT))"


def _s16(spark, d):
    from ..operators.audio import convert

    return V.audio(spark, d).select("frame_no", convert("samples", "f32", "s16").alias("s"))


def _kernel(df, column, f, kind="long"):
    """A pandas UDF over an integer array column."""
    @F.pandas_udf(kind)
    def run(x: pd.Series) -> pd.Series:
        return x.map(f)

    return df.withColumn("out", run(column))


@query(f"{_A}, o AS (SELECT frame_no, {_S16} AS s FROM audio) SELECT frame_no, CAST(unnest(range(64)) AS INT) AS i, unnest(s) AS v FROM o")
def pcm_roundtrip(spark, d):
    out = _kernel(_s16(spark, d), "s", lambda s: pcm.decode(pcm.encode(np.asarray(s), "pcm_s16le"), "pcm_s16le")[:, 0].astype(np.int64), "array<bigint>")
    return out.select("frame_no", F.posexplode("out").alias("i", "v"))


@query("SELECT event_id, CASE WHEN v >= 8388608 THEN v - 16777216 ELSE v END AS v FROM (SELECT event_id, event_id * 2654435 % 16777216 AS v FROM events)")
def pcm_s24_extend(spark, d):
    raw = F.col("event_id") * 2654435 % 16777216
    return V.table(spark, d, "events").select("event_id", pcm.sign_extended(raw, 24).alias("v"))


@query(f"{_A}, o AS (SELECT frame_no, {_S16} AS s FROM audio) SELECT frame_no, CAST(i AS INT) AS i, s[i + 3] - 2 * s[i + 2] + s[i + 1] AS v FROM o, range(62) t(i)")
def flac_fixed_residuals(spark, d):
    return _s16(spark, d).select("frame_no", F.posexplode(flac.residual_column("s", 2)).alias("i", "v"))


def _best_order_sql() -> str:
    """Rice bits of each order of differences: by the parameter that their mean asks for."""
    steps = [f"r0 AS (SELECT frame_no, 0 AS ord, {_S16} AS r FROM audio)"]
    steps += [f"r{k} AS (SELECT frame_no, {k} AS ord, list_transform(range(len(r) - 1), lambda i: r[i + 2] - r[i + 1]) AS r FROM r{k - 1})" for k in range(1, 5)]
    union = " UNION ALL ".join(f"SELECT * FROM r{k}" for k in range(5))
    mean = "CAST(trunc(list_avg(list_transform(r, lambda e: abs(e)))) AS BIGINT)"
    return f"""{_A}, {", ".join(steps)}, u AS ({union}), m AS (SELECT *, {mean} AS mean FROM u), k AS (SELECT *, CASE WHEN mean = 0 THEN 0 ELSE least(14, length(bin(mean))) END AS k FROM m),
        c AS (SELECT frame_no, ord, list_sum(list_transform(r, lambda e: (CASE WHEN e >= 0 THEN 2 * e ELSE -2 * e - 1 END) >> k)) + len(r) * (k + 1) AS bits FROM k)
        SELECT frame_no, ord AS "order" FROM c QUALIFY row_number() OVER (PARTITION BY frame_no ORDER BY bits, ord) = 1"""


@query(_best_order_sql())
def flac_best_order(spark, d):
    return _kernel(_s16(spark, d), "s", lambda s: flac.best_order(np.asarray(s))[0], "int").select("frame_no", F.col("out").alias("order"))


@query(f"{_A}, o AS (SELECT frame_no, {_S16} AS s FROM audio) SELECT frame_no, CAST(unnest(range(64)) AS INT) AS i, unnest(s) AS v FROM o")
def flac_roundtrip(spark, d):
    out = _kernel(_s16(spark, d), "s", lambda s: flac.decode_frame(flac.encode_frame(np.asarray(s)[:, None], 7, 16))[1][:, 0], "array<bigint>")
    return out.select("frame_no", F.posexplode("out").alias("i", "v"))


@query(f"{_A}, o AS (SELECT frame_no, {_S16} AS s FROM audio), x AS (SELECT frame_no, CAST(unnest(range(64)) AS INT) AS i, unnest(s) AS v FROM o) SELECT frame_no, i, CASE WHEN v >= 0 THEN v * 2 ELSE -2 * v - 1 END AS folded, v FROM x")
def rice_fold(spark, d):
    x = _s16(spark, d).select("frame_no", F.posexplode("s").alias("i", "v")).withColumn("folded", B.rice_fold(F.col("v")))
    return x.select("frame_no", "i", "folded", B.rice_unfold(F.col("folded")).alias("v"))


def _crc_sql(width: int, poly: int) -> str:
    bit = f"CASE WHEN v & {1 << (width - 1)} <> 0 THEN xor((v << 1) & {(1 << width) - 1}, {poly}) ELSE (v << 1) & {(1 << width) - 1} END"
    return f"""WITH RECURSIVE t AS (SELECT event_id, CAST(event_id AS VARCHAR) AS s FROM events),
        c AS (SELECT event_id, s, 0 AS step, CAST(0 AS BIGINT) AS v FROM t UNION ALL
        SELECT event_id, s, step + 1, CASE WHEN step % 9 = 0 THEN xor(v, CAST(ascii(substr(s, step // 9 + 1, 1)) AS BIGINT) << {width - 8}) ELSE {bit} END FROM c WHERE step < 9 * length(s))
        SELECT event_id, v AS crc FROM c WHERE step = 9 * length(s)"""


def _crc(spark, d, width):
    rows = V.table(spark, d, "events").withColumn("s", F.col("event_id").cast("string"))
    codes = F.transform(F.split("s", ""), lambda x: F.ascii(x))
    return rows.select("event_id", B.crc_fold(F.filter(codes, lambda x: x > 0), width).alias("crc"))


@query(_crc_sql(8, 7))
def crc8(spark, d):
    return _crc(spark, d, 8)


@query(_crc_sql(16, 0x8005))
def crc16(spark, d):
    return _crc(spark, d, 16)


@query(_crc_sql(32, 0x04C11DB7))
def crc32_ogg(spark, d):
    return _crc(spark, d, 32)
