"""Queries on playing: clocks, synchronisation, seeking, volume, counters, and sample tables by chunk."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import packets as P
from ..operators import player as Y
from . import views as V
from .registry import query

_P, _I, _C, _A = V.duck("packets"), V.duck("sample_index"), V.duck("chapters"), V.duck("audio")
_T = "CAST(pts AS DOUBLE) / 1e9"


def _times(spark, d):
    return V.packets(spark, d).select("path", "seq", "is_keyframe", (F.col("pts").cast("double") / 1e9).alias("time"))


@query(f"{_P}, t AS (SELECT path, seq, {_T} AS time FROM packets), f AS (SELECT path, min(seq) AS first FROM t WHERE time >= 1000 GROUP BY path) SELECT t.path, t.seq FROM t JOIN f ON f.path = t.path AND t.seq >= f.first")
def seek_skip(spark, d):
    return Y.skip_until(_times(spark, d), 1000.0).select("path", "seq")


_CLOCKS = f"""{_P}, v AS (SELECT path, seq, {_T} AS now FROM packets WHERE stream_index < 2), a AS (SELECT path, {_T} AS now, {_T} + (seq % 9 - 4) * 0.03 AS pts FROM packets WHERE stream_index >= 2),
    u AS (SELECT v.path, v.seq, v.now, arg_max(struct_pack(n := a.now, p := a.pts), a.now) AS u FROM v LEFT JOIN a ON a.path = v.path AND a.now <= v.now GROUP BY ALL)"""
_DELAY = """CASE WHEN isnan(diff) OR abs(diff) >= 10 THEN delay WHEN diff <= -greatest(0.04, least(0.1, delay)) THEN greatest(delay + diff, 0) WHEN diff >= greatest(0.04, least(0.1, delay)) THEN CASE WHEN delay > 0.1 THEN delay + diff ELSE delay * 2 END ELSE delay END"""


@query(f"{_CLOCKS}, s AS (SELECT path, seq, now - (u.p + now - u.n) AS diff, 0.02 + seq % 5 * 0.03 AS delay FROM u WHERE u IS NOT NULL) SELECT path, seq, round({_DELAY}, 6) AS delay FROM s")
def video_sync(spark, d):
    """Delays of video frames by the audio clock that was last set before them."""
    p = V.packets(spark, d).select("path", "seq", "stream_index", (F.col("pts").cast("double") / 1e9).alias("now"))
    updates = p.where("stream_index >= 2").select("path", "now", (F.col("now") + (F.col("seq") % 9 - 4) * 0.03).alias("pts"))
    frames = Y.with_audio_clock(p.where("stream_index < 2"), updates).where("audio IS NOT NULL")
    return frames.select("path", "seq", F.round(Y.target_delay(0.02 + F.col("seq") % 5 * 0.03, F.col("now"), F.col("audio")), 6).alias("delay"))


_KIND = "CASE stream_index WHEN 0 THEN 'audio' WHEN 1 THEN 'seek' WHEN 2 THEN 'confirm' WHEN 3 THEN 'pause' ELSE 'none' END"


@query(f"""WITH RECURSIVE {_P[5:]}, e AS (SELECT path, seq, pts AS now, {_KIND} AS kind, pts // 7 AS p FROM packets),
    r AS (SELECT path, seq, now AS begin, CAST(CASE WHEN kind IN ('audio', 'seek') THEN p ELSE 0 END AS BIGINT) AS base, CAST(CASE WHEN kind IN ('audio', 'confirm') THEN now END AS BIGINT) AS set_at, kind = 'seek' AS pending, kind = 'pause' AS paused, now, kind FROM e WHERE seq = 0
        UNION ALL SELECT e.path, e.seq, r.begin, CAST(CASE WHEN (e.kind = 'audio' AND NOT r.pending) OR e.kind = 'seek' THEN e.p ELSE r.base END AS BIGINT),
            CAST(CASE WHEN e.kind = 'audio' AND NOT r.pending THEN e.now WHEN e.kind = 'seek' THEN NULL WHEN e.kind = 'confirm' THEN e.now WHEN e.kind = 'pause' AND r.paused AND r.set_at IS NOT NULL THEN e.now ELSE r.set_at END AS BIGINT),
            CASE e.kind WHEN 'seek' THEN true WHEN 'confirm' THEN false ELSE r.pending END, CASE WHEN e.kind = 'pause' THEN NOT r.paused ELSE r.paused END, e.now, e.kind
        FROM r JOIN e ON e.path = r.path AND e.seq = r.seq + 1)
    SELECT path, seq, CASE WHEN paused OR pending THEN base WHEN set_at IS NULL THEN now - begin ELSE base + now - set_at END AS time FROM r""")
def player_clock(spark, d):
    kind = F.element_at(F.array(*map(F.lit, (*Y.CLOCK, "none"))), F.col("stream_index") + 1)
    return Y.clock(V.packets(spark, d).select("path", "seq", F.col("pts").alias("now"), kind.alias("kind"), F.floor(F.col("pts") / 7).alias("pts")))


@query(f"{_A} SELECT frame_no, i, round(v, 6) + 0.0 AS v FROM (SELECT frame_no, CAST(unnest(range(64)) AS INT) AS i, unnest(list_transform(samples, lambda x: x * CASE WHEN frame_no % 5 = 0 THEN 0.0 ELSE least(frame_no % 130, 100) / 100.0 END)) AS v FROM audio)")
def output_volume(spark, d):
    n = F.col("frame_no")
    out = Y.output_volume("samples", n % 130, n % 5 == 0)
    return V.audio(spark, d).select("frame_no", F.posexplode(out).alias("i", "v")).select("frame_no", "i", (F.round("v", 6) + F.lit(0.0)).alias("v"))


@query(f"""{_C}, c AS (SELECT path, idx, start, lag(start) OVER (PARTITION BY path ORDER BY idx) AS before FROM chapters), t AS (SELECT *, start + idx % 3 * 2.5 AS now, start + idx % 3 * 2.5 - 10 AS target FROM c)
    SELECT path, idx, CASE WHEN target < start THEN CASE WHEN now - start > 3 THEN start WHEN before IS NOT NULL THEN before ELSE target END ELSE target END AS target FROM t""")
def chapter_back(spark, d):
    c = V.chapters(spark, d).withColumn("before", F.lag("start").over(Window.partitionBy("path").orderBy("idx")))
    now = F.col("start") + F.col("idx") % 3 * 2.5
    return c.select("path", "idx", Y.back_in_chapters(now, now - 10, F.col("start"), F.col("before")).alias("target"))


@query(f"{_P} SELECT path, count(*) AS frames, CAST(sum(CAST(is_keyframe AS INT)) AS BIGINT) AS gops, CAST(sum(CAST(seq % 3 > 0 AS INT)) AS BIGINT) AS sent, CAST(sum(CAST(seq % 3 = 0 AS INT)) AS BIGINT) AS dropped FROM packets GROUP BY path")
def frame_counters(spark, d):
    return Y.counters(V.packets(spark, d).select("path", "is_keyframe", (F.col("seq") % 3 > 0).alias("shown")))


_TARGETS = "t AS (SELECT DISTINCT path, stream_index, pts + k AS target FROM packets, (VALUES (0), (500000000), (-9000000000000)) v(k) WHERE seq % 4 = 0)"


@query(f"{_P}, {_TARGETS} SELECT t.path, t.stream_index, target, coalesce(arg_max(p.seq, struct_pack(a := p.pts, b := p.seq)), any_value(f.first)) AS seq FROM t JOIN (SELECT path, stream_index, min(seq) AS first FROM packets GROUP BY ALL) f ON f.path = t.path AND f.stream_index = t.stream_index LEFT JOIN packets p ON p.path = t.path AND p.stream_index = t.stream_index AND p.is_keyframe AND p.pts <= target GROUP BY t.path, t.stream_index, target")
def container_seek(spark, d):
    """Where reading starts for times in each stream: at keyframes, before them, and before the start."""
    p = V.packets(spark, d).withColumn("dts", F.col("pts"))
    shifts = F.explode(F.array(*(F.lit(k).cast("long") for k in (0, 500_000_000, -9_000_000_000_000))))
    targets = p.where("seq % 4 = 0").select("path", "stream_index", "pts", shifts.alias("k")).select("path", "stream_index", (F.col("pts") + F.col("k")).alias("target")).distinct()
    return Y.seek_point(p, targets)


@query(f"""{_I}, n AS (SELECT track, count(*) AS n FROM sample_index GROUP BY track) SELECT s.track, s.idx, CASE WHEN idx < 12 THEN idx // 3 WHEN idx < 26 THEN 4 + (idx - 12) // 7 WHEN (idx - 26) // 2 + 6 < 40 THEN 6 + (idx - 26) // 2 ELSE 0 END AS chunk,
    CASE WHEN idx < 12 THEN idx % 3 WHEN idx < 26 THEN (idx - 12) % 7 WHEN (idx - 26) // 2 + 6 < 40 THEN (idx - 26) % 2 ELSE 0 END AS in_chunk FROM sample_index s""")
def sample_to_chunk(spark, d):
    """Three runs for each track: chunks of 3, of 7 from the fifth on, of 2 from the seventh on, 40 chunks in all."""
    index = V.sample_index(spark, d).select("track", "idx")
    run = F.explode(F.array(*(F.struct(F.lit(a).alias("first_chunk"), F.lit(b).alias("samples_per_chunk")) for a, b in ((1, 3), (5, 7), (7, 2)))))
    runs = index.select("track").distinct().select("track", run.alias("r")).select("track", "r.*")
    return P.sample_chunks(index, runs, 40)


@query(f"{_I} SELECT track, idx, track % 4 = 0 OR sync AS sync FROM sample_index")
def sync_sample(spark, d):
    """Three of four tracks name their sync samples; all samples of the others are."""
    s = V.sample_index(spark, d)
    return P.sync_samples(s.select("track", "idx"), s.where("sync AND track % 4 <> 0").select("track", "idx")).select("track", "idx", "sync")


@query(f"""{_P}, e AS (SELECT path, seq AS pos, stream_index, CASE WHEN stream_index < 2 THEN 'video' ELSE 'audio' END AS media, is_keyframe, row_number() OVER (PARTITION BY path, stream_index ORDER BY seq) - 1 AS n FROM packets),
    t AS (SELECT DISTINCT path, stream_index, media, k AS target FROM e, (VALUES (0), (3), (9), (100000)) v(k))
    SELECT t.path, t.stream_index, t.target, coalesce(CASE WHEN t.media = 'video' THEN (SELECT max(pos) FROM e WHERE e.path = t.path AND e.stream_index = t.stream_index AND is_keyframe AND n <= t.target) ELSE (SELECT max(pos) FROM e WHERE e.path = t.path AND e.stream_index = t.stream_index AND n = t.target) END, 0) AS entry FROM t""")
def keyframe_carry(spark, d):
    p = V.packets(spark, d).select("path", F.col("seq").alias("pos"), "stream_index", F.when(F.col("stream_index") < 2, "video").otherwise("audio").alias("media_type"), "is_keyframe")
    targets = p.select("path", "stream_index").distinct().select("path", "stream_index", F.explode(F.array(*(F.lit(k).cast("long") for k in (0, 3, 9, 100_000)))).alias("target"))
    return P.keyframe_entry(p, targets)
