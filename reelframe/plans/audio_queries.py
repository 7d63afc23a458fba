"""Queries on audio frames; results are exploded to one row for each sample."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.timebase import seconds
from ..operators import audio as A
from . import views as V
from .registry import query

_A = V.duck("audio")


def _rows(df, out, digits=6):
    value = F.round(F.col("v"), digits) + F.lit(0.0) if digits else F.col("v")
    return df.select("frame_no", F.posexplode(out).alias("i", "v")).select("frame_no", "i", value.alias("v"))


def _sql(out: str, digits=6, source: str = _A, extra: str = "") -> str:
    value = f"round(v, {digits}) + 0.0" if digits else "v"
    return f"{source}{extra}, o AS (SELECT frame_no, {out} AS o FROM audio) SELECT frame_no, i, {value} AS v FROM (SELECT frame_no, CAST(unnest(range(len(o))) AS INT) AS i, unnest(o) AS v FROM o)"


def _each(expr: str, of: str = "samples") -> str:
    return f"list_transform({of}, lambda x: {expr})"


_S16 = "CAST(greatest(-32768, least(32767, round(x * 32768))) AS BIGINT)"
_GAIN = "(CASE WHEN t < {0} THEN 0.0 WHEN t >= {0} + {1} THEN 1.0 ELSE (t - {0}) / {1} END)"
_T = "(pts * (CAST(1 AS DOUBLE) / 44100))"


@query(_sql(_each("x * 0.5")))
def volume_linear(spark, d):
    return _rows(V.audio(spark, d), A.volume("samples", 0.5))


@query(_sql(_each("CAST(greatest(-32768.0, least(32767.0, round(x * pow(10, 6.0 / 20)))) AS BIGINT)", _each(_S16)), 0))
def volume_db_s16(spark, d):
    return _rows(V.audio(spark, d), A.volume_db(A.convert("samples", "f32", "s16"), 6.0, "s16"), 0)


@query(_sql(_each("x * " + _GAIN.format(0.1, 0.3).replace("t ", f"{_T} ").replace("(t", f"({_T}"))))
def fade_in(spark, d):
    return _rows(V.audio(spark, d), A.fade("samples", seconds("pts", F.lit(1), F.lit(44100)), 0.1, 0.3, True))


@query(_sql(_each("x * (1 - " + _GAIN.format(0.1, 0.3).replace("t ", f"{_T} ").replace("(t", f"({_T}") + ")")))
def fade_out(spark, d):
    return _rows(V.audio(spark, d), A.fade("samples", seconds("pts", F.lit(1), F.lit(44100)), 0.1, 0.3, False))


_RUN = """, e AS (SELECT *, list_sum(list_transform(samples, lambda x: x * x)) AS e FROM audio),
    r AS (SELECT frame_no, samples, -0.691 + 10 * log10(greatest(sum(e) OVER w / sum(len(samples)) OVER w, 1e-10)) AS lufs FROM e WINDOW w AS (ORDER BY frame_no ROWS UNBOUNDED PRECEDING))"""


@query(f"{_A}{_RUN} SELECT frame_no, round(lufs, 6) AS lufs, round(pow(10, (-23 - lufs) / 20), 6) AS gain FROM r")
def loudness(spark, d):
    out = A.loudnorm(V.audio(spark, d).withColumn("stream", F.lit(0)))
    return out.select("frame_no", F.round("lufs", 6).alias("lufs"), F.round("gain", 6).alias("gain"))


@query(_sql(_each("greatest(-pow(10, -1.0 / 20), least(pow(10, -1.0 / 20), x * pow(10, (-23 - lufs) / 20)))"), extra=_RUN).replace("FROM audio) SELECT", "FROM r) SELECT"))
def loudnorm(spark, d):
    return _rows(A.loudnorm(V.audio(spark, d).withColumn("stream", F.lit(0))), F.col("samples"))


@query(_sql(_each(_S16), 0))
def convert_f32_s16(spark, d):
    return _rows(V.audio(spark, d), A.convert("samples", "f32", "s16"), 0)


@query(_sql(_each("CAST(greatest(0, least(255, round(x * 128) + 128)) AS BIGINT)"), 0))
def convert_f32_u8(spark, d):
    return _rows(V.audio(spark, d), A.convert("samples", "f32", "u8"), 0)


@query(_sql(_each("CAST(greatest(-2147483648.0, least(2147483647.0, round(x / 32768 * 2147483648))) AS BIGINT)", _each(_S16)), 0))
def convert_s16_s32(spark, d):
    return _rows(V.audio(spark, d), A.convert(A.convert("samples", "f32", "s16"), "s16", "s32"), 0)


@query(_sql("flatten(list_transform(samples, lambda x: [x, x]))"))
def mix_mono_stereo(spark, d):
    return _rows(V.audio(spark, d), A.mix("samples", 1, 2))


@query(_sql("list_transform(range(32), lambda i: (samples[2 * i + 1] + samples[2 * i + 2]) / 2)"))
def mix_stereo_mono(spark, d):
    return _rows(V.audio(spark, d), A.mix("samples", 2, 1))


@query(_sql("flatten(list_transform(range(32), lambda i: [samples[2 * i + 1], samples[2 * i + 2], 0.0]))"))
def mix_stereo_three(spark, d):
    return _rows(V.audio(spark, d), A.mix("samples", 2, 3))


@query(_sql("flatten(list_transform(range(10), lambda i: [samples[6 * i + k] + samples[6 * i + 3] * 0.70710677 + samples[6 * i + 4 + k] * 0.70710677 for k in [1, 2]]))"))
def downmix51(spark, d):
    return _rows(V.audio(spark, d), A.downmix("samples", 6))


@query(_sql("flatten(list_transform(range(8), lambda i: [samples[8 * i + k] + samples[8 * i + 3] * 0.70710677 + samples[8 * i + 4 + k] * 0.70710677 + samples[8 * i + 6 + k] * 0.5 for k in [1, 2]]))"))
def downmix71(spark, d):
    return _rows(V.audio(spark, d), A.downmix("samples", 8))


@query(_sql("flatten(list_transform(range(32), lambda i: [samples[2*i+1], samples[2*i+2], (samples[2*i+1] + samples[2*i+2]) * 0.5, (samples[2*i+1] + samples[2*i+2]) * 0.5 * 0.1, samples[2*i+1] * 0.5, samples[2*i+2] * 0.5]))"))
def upmix51(spark, d):
    return _rows(V.audio(spark, d), A.upmix("samples"))


_POS = "(i * CAST(44100.0 / 48000.0 AS DOUBLE))"
_LOW = f"CAST(floor({_POS}) AS INT)"


@query(_sql(f"list_transform(range(70), lambda i: samples[{_LOW} + 1] + (samples[least({_LOW} + 1, 63) + 1] - samples[{_LOW} + 1]) * ({_POS} - {_LOW}))"))
def resample_linear_48k(spark, d):
    return _rows(V.audio(spark, d), A.resample("samples", 44100, 48000))


@query(
    """WITH b AS (SELECT p_partkey, CAST(100 + p_partkey % 8000 AS DOUBLE) AS f, CAST(p_size % 25 - 12 AS DOUBLE) AS g, 0.5 + p_size % 4 AS q FROM part),
    w AS (SELECT *, pow(10, g / 40) AS a, f * (2 * pi()) / 44100 AS w0 FROM b), s AS (SELECT *, sin(w0) / (q * 2) AS al FROM w)
    SELECT p_partkey, round((1 + al * a) / (1 + al / a), 9) AS b0, round(-2 * cos(w0) / (1 + al / a), 9) AS b1, round((1 - al * a) / (1 + al / a), 9) AS b2, round(-2 * cos(w0) / (1 + al / a), 9) AS a1, round((1 - al / a) / (1 + al / a), 9) AS a2 FROM s"""
)
def eq_coefficients(spark, d):
    p = V.table(spark, d, "part")
    cols = A.peaking_columns((F.col("p_partkey") % 8000 + 100).cast("double"), (F.col("p_size") % 25 - 12).cast("double"), F.col("p_size") % 4 + 0.5, 44100)
    return p.select("p_partkey", *(F.round(c, 9).alias(n) for n, c in cols.items()))


_BANDS = [(1000.0, 6.0, 1.0), (4000.0, -3.0, 0.7)]


def _equalizer_sql() -> str:
    """Two bands one after the other, sample by sample along each stream."""
    p, q = ([f"CAST({c!r} AS DOUBLE)" for c in A.peaking(*band, 44100)] for band in _BANDS)
    first = f"({p[0]} * e.v + {p[1]} * r.x1 + {p[2]} * r.x2 - {p[3]} * r.y1 - {p[4]} * r.y2)"
    second = f"({q[0]} * y + {q[1]} * y1 + {q[2]} * y2 - {q[3]} * z1 - {q[4]} * z2)"
    return f"""WITH RECURSIVE {_A[5:]}, e AS (SELECT frame_no // 50 AS stream, frame_no, CAST(i AS INT) AS i, frame_no % 50 * 64 + i AS n, samples[i + 1] AS v FROM audio, range(64) t(i)),
        r AS (SELECT stream, n, v AS x1, CAST(0 AS DOUBLE) AS x2, {p[0]} * v AS y1, CAST(0 AS DOUBLE) AS y2, {q[0]} * ({p[0]} * v) AS z1, CAST(0 AS DOUBLE) AS z2 FROM e WHERE n = 0
            UNION ALL SELECT stream, n, v, x1, y, y1, {second}, z1 FROM (SELECT e.stream, e.n, e.v, r.x1, r.y1, r.y2, r.z1, r.z2, {first} AS y FROM r JOIN e ON e.stream = r.stream AND e.n = r.n + 1))
        SELECT e.frame_no, e.i, round(r.z1, 6) + 0.0 AS v FROM r JOIN e ON e.stream = r.stream AND e.n = r.n"""


@query(_equalizer_sql())
def equalizer(spark, d):
    frames = V.audio(spark, d).withColumn("stream", F.floor(F.col("frame_no") / 50))
    return _rows(A.equalize(frames, _BANDS), F.col("samples"))


@query(_sql(_each("x / 8388608", _each("CAST(greatest(-2147483648.0, least(2147483647.0, round(x * 2147483648))) AS BIGINT)")), 9))
def player_extract(spark, d):
    return _rows(V.audio(spark, d), A.player_samples(A.convert("samples", "f32", "s32"), "s32", 24), 9)


@query(f"{_A}, v AS (SELECT frame_no, list_transform(samples, lambda x: CAST(greatest(-32768, least(32767, round(x * 0.5 * (CASE WHEN {_T} >= 0.5 THEN 1.0 ELSE {_T} / 0.5 END) * 32768))) AS BIGINT)) AS o FROM audio) SELECT frame_no, CAST(list_sum(o) AS BIGINT) AS total, list_max(o) AS peak FROM v")
def volume_fade_s16(spark, d):
    """The flagship: decode, halve, fade in, convert to 16 bits; a summary of each frame."""
    frames = V.audio(spark, d)
    faded = A.fade(A.volume("samples", 0.5), seconds("pts", F.lit(1), F.lit(44100)), 0.0, 0.5, True)
    out = frames.select("frame_no", A.convert(faded, "f32", "s16").alias("o"))
    return out.select("frame_no", F.aggregate("o", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.array_max("o").alias("peak"))
