"""Round trips through containers: the driver's packets are written into files, one for each path, and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import video as K
from ..sources import media as M
from . import views as V
from .pipeline import Transcode
from .registry import query


def _packets(spark, d, streams=5):
    """Packets, their seconds taken as milliseconds, with payloads; of the first streams where a format holds no more."""
    p = V.packets(spark, d).where(F.col("stream_index") < streams)
    t = F.floor(F.col("pts") / 1_000_000)
    body = F.concat(F.lit("x"), F.repeat(F.lit("payload "), (F.col("seq") % 60).cast("int")), F.col("seq").cast("string")).cast("binary")
    return p.select(F.col("path").cast("string").alias("path"), "seq", "stream_index", t.alias("pts"), t.alias("dts"), F.lit(1).cast("long").alias("duration"), "is_keyframe", body.alias("data"))


def _streams(p):
    video = F.col("index") == 0
    s = p.select("path", F.col("stream_index").alias("index")).distinct()
    return s.select(
        "path", "index", F.when(video, "video").otherwise("audio").alias("media_type"), F.when(video, "h264").otherwise("aac").alias("codec"), F.lit(1).alias("tb_num"), F.lit(1000).alias("tb_den"),
        F.lit(None).cast("binary").alias("extra"), F.when(video, 0).otherwise(44100).alias("rate"), F.when(video, 0).otherwise(2).alias("channels"), F.lit(0).alias("bits"), F.when(video, 64).otherwise(0).alias("width"), F.when(video, 48).otherwise(0).alias("height"),
    )


def _back(spark, d, fmt, forced, streams=5):
    p = _packets(spark, d, streams)
    files = M.mux(_streams(p), p, fmt)
    return M.packets(files, forced).where("status = 'ok'")


def _sql(streams=5):
    return V.duck("packets") + f""", k AS (SELECT CAST(path AS VARCHAR) AS path, seq, stream_index, pts // 1000000 AS pts, is_keyframe,
    strlen('x' || repeat('payload ', CAST(seq % 60 AS INT)) || seq) AS size FROM packets WHERE stream_index < {streams}),
    n AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY path ORDER BY stream_index) - 1 AS INT) AS s FROM k)"""


_SQL = _sql()


@query(f"{_SQL} SELECT path, s AS stream_index, pts, is_keyframe, size FROM n")
def mkv_roundtrip(spark, d):
    return _back(spark, d, "matroska", "matroska").select("path", "stream_index", "pts", "is_keyframe", "size")


@query(f"{_SQL} SELECT path, s AS stream_index, pts, is_keyframe, size FROM n")
def webm_roundtrip(spark, d):
    return _back(spark, d, "webm", "matroska").select("path", "stream_index", "pts", "is_keyframe", "size")


@query(f"{_SQL} SELECT path, s AS stream_index, pts * 90 AS pts, size FROM n")
def ts_roundtrip(spark, d):
    return _back(spark, d, "mpegts", "mpegts").select("path", "stream_index", "pts", "size")


@query(f"{_sql(2)} SELECT path, pts, size FROM n")
def flv_roundtrip(spark, d):
    """Two streams, one of video and one of audio, as the format holds no more."""
    return _back(spark, d, "flv", "flv", 2).select("path", "pts", "size")


@query(f"{_SQL} SELECT path, s AS stream_index, pts - min(pts) OVER (PARTITION BY path, s) AS pts, is_keyframe, size FROM n")
def mp4_roundtrip(spark, d):
    return _back(spark, d, "mp4", "mp4").select("path", "stream_index", "pts", "is_keyframe", "size")


def _one_kind_files(spark, d, fmt, codec, media="audio"):
    """Files of one stream of a codec for each path."""
    p = _packets(spark, d, 1)
    s = p.select("path").distinct()
    video = media == "video"
    cells = {"index": 0, "media_type": media, "codec": codec, "tb_num": 1, "tb_den": 1000 if video else 44100, "rate": 0 if video else 44100, "channels": 0 if video else 2, "bits": 0 if video else 16, "width": 64 if video else 0, "height": 48 if video else 0}
    s = s.select("path", *(F.lit(v).alias(k) for k, v in cells.items()), F.lit(None).cast("binary").alias("extra"))
    return M.mux(s, p, fmt)


def _one_kind(spark, d, fmt, codec, media="audio"):
    return M.packets(_one_kind_files(spark, d, fmt, codec, media), fmt).where("status = 'ok'")


@query(f"{_sql(1)}, g AS (SELECT path, count(*) AS n, max(pts) + 1 AS last FROM n GROUP BY path) SELECT path, 'matroska' AS format, last AS duration FROM g UNION ALL SELECT path, 'avi', n FROM g UNION ALL SELECT path, 'aac', 1024 * n FROM g")
def container_durations(spark, d):
    """Durations by the latest end, by the number of frames, and by the samples of all frames."""
    out = None
    for fmt, codec, media in (("matroska", "h264", "video"), ("avi", "h264", "video"), ("aac", "aac", "audio")):
        rows = M.streams(_one_kind_files(spark, d, fmt, codec, media), fmt).select("path", "format", "duration")
        out = rows if out is None else out.union(rows)
    return out


@query(f"{_sql(1)} SELECT path, row_number() OVER (PARTITION BY path ORDER BY seq) - 1 AS pts, is_keyframe, size FROM n")
def avi_roundtrip(spark, d):
    """Video of one stream; times count frames."""
    return _one_kind(spark, d, "avi", "h264", "video").select("path", "pts", "is_keyframe", "size")


@query(f"{_sql(1)} SELECT path, 1024 * (row_number() OVER (PARTITION BY path ORDER BY seq) - 1) AS pts, size FROM n")
def adts_roundtrip(spark, d):
    """Packets of AAC; times count 1,024 samples for each."""
    return _one_kind(spark, d, "aac", "aac").select("path", "pts", "size")


@query(f"{_sql(1)} SELECT path, pts + 1 AS pts, size FROM n")
def ogg_roundtrip(spark, d):
    """A packet a page, whose granule is where the packet ends."""
    head = b"OpusHead\x01\x02" + bytes(9)
    p = _packets(spark, d, 1)
    s = p.select("path").distinct().select("path", F.lit(0).alias("index"), F.lit("audio").alias("media_type"), F.lit("opus").alias("codec"), F.lit(1).alias("tb_num"), F.lit(48000).alias("tb_den"), F.lit(bytearray(head)).alias("extra"), F.lit(48000).alias("rate"), F.lit(2).alias("channels"), F.lit(0).alias("bits"), F.lit(0).alias("width"), F.lit(0).alias("height"))
    tags = p.select("path").distinct().select("path", F.lit(-1).cast("long").alias("seq"), F.lit(0).alias("stream_index"), F.lit(0).cast("long").alias("pts"), F.lit(0).cast("long").alias("dts"), F.lit(0).cast("long").alias("duration"), F.lit(True).alias("is_keyframe"), F.lit(bytearray(b"OpusTags")).alias("data"))
    return M.packets(M.mux(s, p.unionByName(tags), "ogg"), "ogg").where("status = 'ok'").select("path", "pts", "size")


def _samples_files(spark, d, fmt, codec, bits=16):
    """Files of ten frames each, written with a codec in a format."""
    n = F.col("frame_no")
    frames = V.audio(spark, d).select(F.floor(n / 10).cast("string").alias("path"), F.lit(0).alias("stream_index"), n.alias("frame_no"), (n % 10 * 64).alias("pts"), F.lit(64).alias("nb_samples"), F.lit(44100).alias("rate"), F.lit(1).alias("channels"), "samples")
    cells = {"index": 0, "media_type": "audio", "codec": codec, "tb_num": 1, "tb_den": 44100, "rate": 44100, "channels": 1, "bits": bits, "width": 0, "height": 0}
    streams = frames.select("path").distinct().select("path", *(F.lit(v).alias(k) for k, v in cells.items()), F.lit(None).cast("binary").alias("extra"))
    return M.mux(streams, M.encode_audio(frames, codec), fmt)


def _samples(spark, d, fmt, codec, bits=16):
    """The files probed, read and decoded again: (path, i, v)."""
    files = _samples_files(spark, d, fmt, codec, bits)
    back = M.decode_audio(M.packets(files, coded=True)).where("status = 'ok'")
    return back.select("path", "pts", F.posexplode("samples").alias("i", "v")).select("path", (F.col("pts") + F.col("i")).alias("i"), (F.round("v", 9) + F.lit(0.0)).alias("v"))


def _samples_sql(bits=16):
    full = 1 << (bits - 1)
    return V.duck("audio") + f", o AS (SELECT frame_no // 10 AS f, frame_no, list_transform(samples, lambda x: round(greatest(-{full}, least({full - 1}, round(x * {full}))) / {full}, 9)) AS s FROM audio) SELECT CAST(f AS VARCHAR) AS path, frame_no % 10 * 64 + i AS i, s[i + 1] + 0.0 AS v FROM o, range(64) t(i)"


@query(_samples_sql())
def aiff_roundtrip(spark, d):
    return _samples(spark, d, "aiff", "pcm_s16be")


@query(_samples_sql(24))
def aiff24_roundtrip(spark, d):
    return _samples(spark, d, "aiff", "pcm_s24be", 24)


@query(_samples_sql())
def flac_file_roundtrip(spark, d):
    return _samples(spark, d, "flac", "flac")


_POS = "(i * (CAST(44100 AS DOUBLE) / 48000))"
_LOW = f"CAST(floor({_POS}) AS INT)"
_PLAIN = V.duck("audio") + """, f AS (SELECT frame_no // 10 AS f, frame_no, list_transform(samples, lambda x: greatest(-32768, least(32767, round(x * 32768))) / 32768 * 0.5) AS s FROM audio),
    w AS (SELECT f, flatten(list(s ORDER BY frame_no)) AS s, max(len(s)) * count(*) AS n FROM f GROUP BY f)"""


@query(f"{_PLAIN}, r AS (SELECT f, i, c, s[{_LOW} + 1] + (s[least({_LOW} + 1, n - 1) + 1] - s[{_LOW} + 1]) * ({_POS} - {_LOW}) AS v FROM w, range(697) t(i), (VALUES (0), (1)) k(c)) SELECT CAST(f AS VARCHAR) AS path, 2 * i + c AS i, round(greatest(-32768, least(32767, round(v * 32768))) / 32768, 9) + 0.0 AS v FROM r")
def transcode_flac(spark, d):
    """WAV files of 640 samples: halved, to stereo, to 48 kHz, into FLAC files, and these decoded."""
    plan = Transcode(_samples_files(spark, d, "wav", "pcm_s16le")).chain("volume=0.5").resample(48000, 2)
    files = plan.files("flac", "out.flac")
    back = M.decode_audio(M.packets(files, coded=True)).where("status = 'ok'")
    return back.select("path", (F.col("pts") * 2).alias("first"), F.posexplode("samples").alias("i", "v")).select("path", (F.col("first") + F.col("i")).alias("i"), (F.round("v", 9) + F.lit(0.0)).alias("v"))


@query(V.duck("audio") + ", o AS (SELECT frame_no // 10 AS f, frame_no, list_transform(samples, lambda x: round(greatest(-32768, least(32767, round(x * 32768))) / 32768, 9)) AS s FROM audio) SELECT CAST(f AS VARCHAR) AS path, frame_no % 10 * 64 + i AS i, s[i + 1] + 0.0 AS v FROM o, range(64) t(i)")
def wav_roundtrip(spark, d):
    """Ten frames a file, written as 16-bit WAV, probed, read and decoded again."""
    return _samples(spark, d, "wav", "pcm_s16le")


@query(V.duck("gray") + ", grid AS (SELECT CAST(y AS INT) AS y, CAST(x AS INT) AS x FROM range(8) a(y), range(8) b(x)) SELECT frame_no, y, x, CASE WHEN (x IN (1, 5) AND y BETWEEN 1 AND 7) OR (y = 4 AND x BETWEEN 1 AND 5) THEN 255 ELSE px[y * 8 + x + 1] END AS v FROM gray, grid")
def drawtext(spark, d):
    """The letter H of a given font on gray frames read as rgb."""
    font = {"H": [0x7F, 0x08, 0x08, 0x08, 0x7F]}
    kernel = lambda x: K.draw_text(K.gray_to_rgb(x), "H", 1, 1, (255, 255, 255), font)[..., :1]
    return K.explode_pixels(K.map_pixels(V.gray(spark, d), "px", (8, 8, 1), kernel), "px", 8)
