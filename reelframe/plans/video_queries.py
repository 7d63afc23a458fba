"""Queries on 8x8 frames; results are exploded to one row for each pixel."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.timebase import fade_gain
from ..operators import metrics as M
from ..operators import video as K
from . import views as V
from .pictures import Pictures
from .registry import query

_G, _R = V.duck("gray"), V.duck("gray", "rgb")


def _gray(spark, d, kernel, width):
    return K.explode_pixels(K.map_pixels(V.gray(spark, d), "px", (8, 8, 1), kernel), "px", width)


def _rgb(spark, d):
    """Packed rgb frames: frame_no, px (8 * 8 * 3)."""
    return V.rgb(spark, d).select("frame_no", F.flatten(F.transform(F.arrays_zip("r", "g", "b"), lambda p: F.array(p["r"], p["g"], p["b"]))).alias("px"))


def _pixels(expr: str, width: int, height: int, source: str = _G, of: str = "gray") -> str:
    """SQL of one value for each (y, x); expr may use px, r, g, b (lists), y and x."""
    return f"{source}, grid AS (SELECT CAST(y AS INT) AS y, CAST(x AS INT) AS x FROM range({height}) a(y), range({width}) b(x)) SELECT frame_no, y, x, CAST({expr} AS INT) AS v FROM {of}, grid"


def _at(y: str, x: str, of: str = "px") -> str:
    return f"{of}[CAST(({y}) * 8 + ({x}) + 1 AS INT)]"


@query(_pixels(_at("y + 1", "x + 2"), 4, 5))
def crop(spark, d):
    return _gray(spark, d, lambda x: K.crop(x, 2, 1, 4, 5), 4)


@query(_pixels(f"CASE WHEN y BETWEEN 1 AND 8 AND x BETWEEN 2 AND 9 THEN {_at('y - 1', 'x - 2')} ELSE (77 * 200 + 150 * 100 + 29 * 50) >> 8 END", 12, 10))
def pad(spark, d):
    return _gray(spark, d, lambda x: K.pad(x, 12, 10, 2, 1, (200, 100, 50)), 12)


@query(_pixels(f"CASE WHEN y BETWEEN 3 AND 6 AND x >= 5 THEN round(CAST(((y - 3) * 4 + x - 5) * 16 AS FLOAT) * CAST(0.25 AS FLOAT) + CAST({_at('y', 'x')} AS FLOAT) * CAST(0.75 AS FLOAT)) ELSE {_at('y', 'x')} END", 8, 8))
def overlay_alpha(spark, d):
    image = (np.arange(16) * 16).astype(np.uint8).reshape(4, 4, 1)
    return _gray(spark, d, lambda x: K.overlay(x, image, 5, 3, 0.25), 8)


@query(_pixels(f"round({_at('y', 'x')} * CASE WHEN frame_no / 100.0 >= 2 THEN 1.0 ELSE frame_no / 100.0 / 2 END)", 8, 8))
def fade_video(spark, d):
    gain = fade_gain(F.col("frame_no") / 100.0, 0.0, 2.0, True)
    frames = V.gray(spark, d).select("frame_no", F.transform("px", lambda v: F.greatest(F.lit(0), F.least(F.lit(255), F.round(v * gain).cast("int")))).alias("px"))
    return K.explode_pixels(frames, "px", 8)


def _luma(y: str, x: str) -> str:
    return f"(77 * {_at(y, x, 'r')} + 150 * {_at(y, x, 'g')} + 29 * {_at(y, x, 'b')} + 128) >> 8"


@query(_pixels(f"least(255, greatest(0, ({_luma('y', 'x')})))", 8, 8, _R, "rgb"))
def rgb_to_gray(spark, d):
    return K.explode_pixels(K.map_pixels(_rgb(spark, d), "px", (8, 8, 3), K.rgb_to_gray), "px", 8)


def _chroma(k, r, g, b):
    return f"least(255, greatest(0, (({k[0]} * {r} + {k[1]} * {g} + {k[2]} * {b} + 128) >> 8) + 128))"


def _yuv(u: str, v: str, size: int) -> str:
    each = lambda e, n: f"SELECT frame_no, y, x, CAST({e} AS INT) AS v, {n} AS plane FROM rgb, grid" + (f" WHERE y < {size} AND x < {size}" if n else "")
    return f"{_R}, grid AS (SELECT CAST(y AS INT) AS y, CAST(x AS INT) AS x FROM range(8) a(y), range(8) b(x)) {each('least(255, greatest(0, (' + _luma('y', 'x') + ')))', 0)} UNION ALL {each(u, 1)} UNION ALL {each(v, 2)}"


def _planes(frames, shape, kernel, sizes):
    """One row for each value of all planes, (height, width) in sizes; the kernel runs once."""
    whole = K.map_pixels(frames, "px", shape, lambda x: np.concatenate([p.reshape(len(x), -1) for p in kernel(x)], 1))
    return K.explode_planes(whole, "px", sizes)


_CB, _CR = (-43, -85, 128), (128, -107, -21)
_P = [_at("y", "x", c) for c in "rgb"]
_M = [f"(({_at('2 * y', '2 * x', c)} + {_at('2 * y', '2 * x + 1', c)} + {_at('2 * y + 1', '2 * x', c)} + {_at('2 * y + 1', '2 * x + 1', c)}) // 4)" for c in "rgb"]


@query(_yuv(_chroma(_CB, *_P), _chroma(_CR, *_P), 8))
def rgb_to_yuv444(spark, d):
    return _planes(_rgb(spark, d), (8, 8, 3), K.rgb_to_yuv444, [(8, 8)] * 3)


@query(_yuv(_chroma(_CB, *_M), _chroma(_CR, *_M), 4))
def rgb_to_yuv420(spark, d):
    return _planes(_rgb(spark, d), (8, 8, 3), K.rgb_to_yuv420, [(8, 8), (4, 4), (4, 4)])


@query(f"{_R}, grid AS (SELECT CAST(y AS INT) AS y, CAST(x AS INT) AS x FROM range(8) a(y), range(8) b(x)) " + " UNION ALL ".join(f"SELECT frame_no, y, x, {k} AS c, {_at('y', 'x', n)} AS v FROM rgb, grid" for k, n in enumerate("bgr")))
def bgr_swap(spark, d):
    return K.explode_pixels(K.map_pixels(_rgb(spark, d), "px", (8, 8, 3), K.swap_rb), "px", 8, 3)


@query(f"{_G}, grid AS (SELECT CAST(y AS INT) AS y, CAST(x AS INT) AS x FROM range(8) a(y), range(4) b(x)) SELECT frame_no, y, x, {_at('y', '2 * x')} AS v, 0 AS plane FROM gray, grid UNION ALL SELECT frame_no, y, x, {_at('y', '2 * x + 1')}, 1 FROM gray, grid")
def nv12_split(spark, d):
    return _planes(V.gray(spark, d), (8, 4, 2), K.split_nv12, [(8, 4)] * 2)


@query(_pixels(_at("y * 8 // 5", "x * 8 // 11"), 11, 5))
def scale_nearest(spark, d):
    return _gray(spark, d, lambda x: K.scale_nearest(x, 11, 5), 11)


def _axis(v: str, n: int) -> tuple[str, str, str]:
    pos = f"greatest(({v} * 2 + 1) * 8 * 128 // {n} - 128, 0)"
    return f"least({pos} >> 8, 7)", f"least(({pos} >> 8) + 1, 7)", f"({pos} & 255)"


(_Y0, _Y1, _FY), (_X0, _X1, _FX) = _axis("y", 5), _axis("x", 11)


@query(_pixels(f"({_at(_Y0, _X0)} * (256 - {_FX}) * (256 - {_FY}) + {_at(_Y0, _X1)} * {_FX} * (256 - {_FY}) + {_at(_Y1, _X0)} * (256 - {_FX}) * {_FY} + {_at(_Y1, _X1)} * {_FX} * {_FY} + 32768) >> 16", 11, 5))
def scale_bilinear(spark, d):
    return _gray(spark, d, lambda x: K.scale_bilinear(x, 11, 5), 11)


@query(f"{_G}, p AS (SELECT frame_no, i // 8 AS sy, i % 8 AS sx, px[i + 1] AS v FROM gray, range(64) t(i)), grid AS (SELECT y, x FROM range(3) a(y), range(5) b(x)) SELECT frame_no, CAST(y AS INT) AS y, CAST(x AS INT) AS x, CAST((sum(v) + count(*) // 2) // count(*) AS INT) AS v FROM p JOIN grid ON sy >= y * 8 // 3 AND sy < (y + 1) * 8 // 3 AND sx >= x * 8 // 5 AND sx < (x + 1) * 8 // 5 GROUP BY ALL")
def scale_area(spark, d):
    return _gray(spark, d, lambda x: K.scale_area(x, 5, 3), 5)


def _kernel_sql(taps: tuple[int, int], weight: str) -> str:
    """Scaling 8x8 to 11x5 by separable weights: `weight` is of t, the distance in 256ths."""
    def axis(v: str, n: int) -> str:
        return f"""{v}p AS (SELECT {v}, (({v} * 2 + 1) * 1024 // {n}) - 128 AS pos FROM range({n}) r({v})), {v}k AS (SELECT {v}, greatest(0, least(7, lo + k)) AS s{v}, abs(k * 256 - (pos - lo * 256)) AS t
            FROM (SELECT *, CAST(floor(pos / 256.0) AS BIGINT) AS lo FROM {v}p), range({taps[0]}, {taps[1]}) t(k)), {v}w AS (SELECT {v}, s{v}, {weight} AS w FROM {v}k)"""
    return f"""{_G}, {axis("y", 5)}, {axis("x", 11)}, w AS (SELECT y, x, sy, sx, CAST(floor(yw.w * xw.w / 256.0) AS BIGINT) AS w FROM yw, xw),
        s AS (SELECT frame_no, y, x, CAST(sum(px[sy * 8 + sx + 1] * w) AS BIGINT) AS total, CAST(sum(w) AS BIGINT) AS norm FROM gray, w GROUP BY ALL)
        SELECT frame_no, CAST(y AS INT) AS y, CAST(x AS INT) AS x, CAST(CASE WHEN norm > 0 THEN greatest(0, least(255, floor((total + norm // 2) / CAST(norm AS DOUBLE)))) ELSE 0 END AS INT) AS v FROM s"""


_T2, _T3 = "(t * t >> 8)", "((t * t >> 8) * t >> 8)"
_U = "(t / 256.0)"


@query(_kernel_sql((-1, 3), f"CAST(round(256 * CASE WHEN t < 256 THEN 1.5 * {_U} * {_U} * {_U} - 2.5 * {_U} * {_U} + 1 WHEN t < 512 THEN -0.5 * {_U} * {_U} * {_U} + 2.5 * {_U} * {_U} - 4 * {_U} + 2 ELSE 0 END) AS BIGINT)"))
def scale_bicubic(spark, d):
    return _gray(spark, d, lambda x: K.scale_bicubic(x, 11, 5), 11)


@query(_kernel_sql((-1, 3), f"CAST(trunc(CASE WHEN t <= 256 THEN 3 * {_T3} - 10 * {_T2} + 512 WHEN t <= 512 THEN 5 * {_T2} - {_T3} - 8 * t + 1024 ELSE 0 END / 2.0) AS BIGINT)"))
def scale_bicubic_compat(spark, d):
    return _gray(spark, d, lambda x: K.scale_bicubic(x, 11, 5, True), 11)


_V = "(pi() * greatest(t, 1) / 256)"


@query(_kernel_sql((-2, 4), f"CASE WHEN t = 0 THEN 256 WHEN t >= 768 THEN 0 ELSE CAST(trunc(sin({_V}) / {_V} * sin({_V} / 3) / ({_V} / 3) * 256) AS BIGINT) END"))
def scale_lanczos(spark, d):
    return _gray(spark, d, lambda x: K.scale_lanczos(x, 11, 5), 11)


def _back_sql(group: str) -> str:
    """Planes of 4:2:0 and back; `group`: the two chroma columns of which a pixel takes the mean."""
    value = lambda e: f"least(255, greatest(0, ({e} + 128) >> 8))"
    return f"""{_R}, grid AS (SELECT y, x FROM range(8) a(y), range(8) b(x)), half AS (SELECT y, x FROM range(4) a(y), range(4) b(x)),
        l AS (SELECT frame_no, y, x, least(255, greatest(0, {_luma('y', 'x')})) AS l FROM rgb, grid),
        c AS (SELECT frame_no, y AS cy, x AS cx, {_chroma(_CB, *_M)} - 128 AS u, {_chroma(_CR, *_M)} - 128 AS v FROM rgb, half),
        p AS (SELECT l.frame_no, y, x, 298 * (l - 16) AS s, (a.u + b.u + 256) // 2 - 128 AS u, (a.v + b.v + 256) // 2 - 128 AS v
            FROM l JOIN c a ON a.frame_no = l.frame_no AND a.cy = y // 2 AND a.cx = {group.split(';')[0]} JOIN c b ON b.frame_no = l.frame_no AND b.cy = y // 2 AND b.cx = {group.split(';')[1]})
        SELECT frame_no, CAST(y AS INT) AS y, CAST(x AS INT) AS x, c, CAST(CASE c WHEN 0 THEN {value('s + 409 * v')} WHEN 1 THEN {value('s - 100 * u - 208 * v')} ELSE {value('s + 516 * u')} END AS INT) AS v FROM p, (VALUES (0), (1), (2)) k(c)"""


@query(_back_sql("x // 2; x // 2"))
def yuv420_to_rgb(spark, d):
    back = K.map_pixels(_rgb(spark, d), "px", (8, 8, 3), lambda x: K.yuv_to_rgb(K.rgb_to_yuv420(x)))
    return K.explode_pixels(back, "px", 8, 3)


@query(_back_sql("0; CASE WHEN x >= 4 THEN 3 ELSE 0 END"))
def yuv420_to_rgb_compat(spark, d):
    back = K.map_pixels(_rgb(spark, d), "px", (8, 8, 3), lambda x: K.yuv_to_rgb(K.rgb_to_yuv420(x), compat=True))
    return K.explode_pixels(back, "px", 8, 3)


@query(f"{_G}, p AS (SELECT frame_no, i // 8 AS y, i % 8 AS x, px[i + 1] AS v FROM gray, range(64) t(i)), s AS (SELECT frame_no, CAST(y // 2 AS INT) AS y, CAST(x // 2 AS INT) AS x, CAST((sum(v) + 2) // 4 AS INT) AS v FROM p GROUP BY ALL) SELECT frame_no, y, x, c, v FROM s, (VALUES (0), (1), (2)) k(c)")
def scale_and_convert(spark, d):
    """Scaled in the source format by half, then converted."""
    back = K.map_pixels(V.gray(spark, d), "px", (8, 8, 1), lambda x: K.scale_and_convert([x], "gray8", 4, 4, "rgb24", "area")[0])
    return K.explode_pixels(back, "px", 4, 3)


@query(f"{_G}, q AS (SELECT frame_no, px FROM gray), l AS (SELECT frame_no, y, x, px[CAST(y * 2 * 8 + x * 2 + 1 AS INT)] AS v, 0 AS plane FROM q, range(4) a(y), range(4) b(x)), c AS (SELECT frame_no, y, x, px[CAST(p * 16 + y * 2 * 4 + x * 2 + 1 AS INT)] AS v, p AS plane FROM q, range(2) a(y), range(2) b(x), (VALUES (1), (2)) k(p)) SELECT frame_no, CAST(y AS INT) AS y, CAST(x AS INT) AS x, v, plane FROM l UNION ALL SELECT frame_no, CAST(y AS INT), CAST(x AS INT), v, plane FROM c")
def scale_planes(spark, d):
    """Luma of 8x8 and chroma planes of 4x4 (taken from the second and third row quarter) to half their size."""
    def kernel(x):
        planes = [x, x.reshape(len(x), 64)[:, 16:32].reshape(-1, 4, 4, 1), x.reshape(len(x), 64)[:, 32:48].reshape(-1, 4, 4, 1)]
        return K.scale_planes(planes, "yuv420p", 4, 4, "nearest")

    return _planes(V.gray(spark, d), (8, 8, 1), kernel, [(4, 4), (2, 2), (2, 2)])


@query("WITH f(name) AS (VALUES ('yuv420p'), ('yuv422p'), ('yuv444p'), ('nv12'), ('nv21'), ('rgb24'), ('bgr24'), ('rgba'), ('bgra'), ('argb'), ('gray8')), p(source, target) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in sorted(K.CONVERSIONS)) + ") SELECT a.name AS source, b.name AS target, a.name = b.name OR p.source IS NOT NULL AS supported FROM f a CROSS JOIN f b LEFT JOIN p ON p.source = a.name AND p.target = b.name")
def conversion_supported(spark, d):
    """Every pair of pixel formats (a fixed list) with whether the first can be converted to the second."""
    names = spark.createDataFrame([(n,) for n in K.FORMATS], "source string")
    pairs = names.select("source", F.explode(F.array(*map(F.lit, K.FORMATS))).alias("target"))
    return pairs.withColumn("supported", K.is_supported("source", "target"))


@query(
    f"""{_G}, q AS (SELECT a.frame_no, list_transform(range(64), lambda i: a.px[i + 1] - b.px[i + 1]) AS e FROM gray a JOIN gray b ON b.frame_no = a.frame_no + 1),
    m AS (SELECT frame_no, list_max(list_transform(e, lambda x: abs(x))) AS max_error, CAST(list_sum(list_transform(e, lambda x: x * x)) AS DOUBLE) / 64 AS mse FROM q)
    SELECT frame_no, CAST(max_error AS INT) AS max_error, round(mse, 6) AS mse, round(CASE WHEN mse = 0 THEN 'inf' ELSE 20 * log10(255.0 / sqrt(mse)) END, 6) AS psnr FROM m"""
)
def frame_psnr(spark, d):
    g = V.gray(spark, d)
    both = g.join(g.select((F.col("frame_no") - 1).alias("frame_no"), F.col("px").alias("other")), "frame_no")
    e = M.frame_error("px", "other")
    return both.select("frame_no", e["max_error"].alias("max_error"), F.round(e["mse"], 6).alias("mse"), F.round(e["psnr"], 6).alias("psnr"))


_A = V.duck("audio")


@query(
    f"""{_A}, q AS (SELECT frame_no, samples, list_transform(samples, lambda x: round(x * 128) / 128) AS t FROM audio),
    m AS (SELECT frame_no, list_sum(list_transform(range(64), lambda i: (samples[i + 1] - t[i + 1]) * (samples[i + 1] - t[i + 1]))) / 64 AS mse, list_sum(list_transform(samples, lambda x: x * x)) / 64 AS p FROM q)
    SELECT frame_no, round(-10 * log10(mse), 6) AS psnr, round(p / (p + mse) * 100, 6) AS "precision" FROM m"""
)
def audio_precision(spark, d):
    q = V.audio(spark, d).withColumn("t", F.transform("samples", lambda x: F.round(x * 128) / 128))
    e = M.audio_error("samples", "t")
    return q.select("frame_no", F.round(e["psnr"], 6).alias("psnr"), F.round(e["precision"], 6).alias("precision"))


@query(f"{_A}, s AS (SELECT frame_no, i % 4 AS channel, i // 4 AS i, samples[i + 1] AS v FROM audio, range(64) t(i)) SELECT CAST(p.channel AS INT) AS a, CAST(q.channel AS INT) AS b, round(corr(p.v, q.v), 9) AS corr FROM s p JOIN s q ON q.frame_no = p.frame_no AND q.i = p.i AND p.channel <= q.channel GROUP BY ALL")
def channel_corr(spark, d):
    s = V.audio(spark, d).select("frame_no", F.posexplode("samples").alias("k", "v")).select("frame_no", (F.col("k") % 4).cast("int").alias("channel"), F.floor(F.col("k") / 4).alias("i"), "v")
    return M.channel_correlation(s).withColumn("corr", F.round("corr", 9))


@query(
    f"""{_A}, t AS (SELECT frame_no, samples AS r, list_concat(samples[4:], samples[1:3]) AS t FROM audio),
    s AS (SELECT frame_no, lag, round(list_sum(list_transform(range(64), lambda i: CASE WHEN i + lag BETWEEN 0 AND 63 THEN r[i + 1] * t[CAST(i + lag + 1 AS INT)] ELSE 0.0 END)), 9) AS score FROM t, range(-6, 7) l(lag))
    SELECT frame_no, CAST(lag AS INT) AS lag FROM s QUALIFY row_number() OVER (PARTITION BY frame_no ORDER BY score DESC, lag) = 1"""
)
def best_lag(spark, d):
    t = V.audio(spark, d).withColumn("t", F.concat(F.slice("samples", 4, 61), F.slice("samples", 1, 3)))
    return t.select("frame_no", M.best_lag("samples", "t", 6).alias("lag"))


@query(f"{_G}, grid AS (SELECT y, x FROM range(4) a(y), range(4) b(x)) SELECT frame_no, CAST(y AS INT) AS y, CAST(x AS INT) AS x, c, CASE WHEN y BETWEEN 1 AND 2 AND x BETWEEN 1 AND 2 THEN px[CAST(((y - 1) * 4 // 2 + 2) * 8 + ((x - 1) * 4 // 2 + 1) + 1 AS INT)] ELSE 0 END AS v FROM gray, grid, (VALUES (0), (1), (2)) k(c)")
def picture_chain(spark, d):
    """Cropped to 4x4, scaled to 2x2, converted to rgb and padded, in one pass over the frames."""
    g = V.gray(spark, d)
    rows = g.select("frame_no", F.lit(8).alias("width"), F.lit(8).alias("height"), F.array(F.unhex(F.array_join(F.transform("px", lambda v: F.lpad(F.hex(v), 2, "0")), ""))).alias("planes"))
    out = Pictures(rows, "gray8").chain("crop=4:4:1:2, unknown=1").scale(2, 2, "nearest").convert("rgb24").pad(4, 4, 1, 1).run()
    codes = F.transform(F.sequence(F.lit(0), F.lit(4 * 4 * 3 - 1)), lambda i: F.conv(F.substring(F.hex(F.col("planes")[0]), i * 2 + 1, F.lit(2)), 16, 10).cast("int"))
    return K.explode_pixels(out.select("frame_no", codes.alias("px")), "px", 4, 3)
