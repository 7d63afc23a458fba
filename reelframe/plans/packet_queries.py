"""Queries on time, packets and sample indexes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import timebase as T
from ..operators import packets as P
from . import views as V
from .registry import query

_P, _I, _C = V.duck("packets"), V.duck("sample_index"), V.duck("chapters")
_SEC = "(CAST(pts AS DOUBLE) * tb_num / tb_den)"
SS, DUR = 3 * 86400.0, 10 * 86400.0


@query(f"{_P} SELECT path, seq, CAST(trunc(CAST(pts AS HUGEINT) * 90000 // 1000000) AS BIGINT) AS pts_90k, CAST(CAST(pts AS HUGEINT) * 1000 // 1000000 AS BIGINT) AS pts_ms FROM packets")
def rescale_90k_ms(spark, d):
    p = V.packets(spark, d)
    to = lambda den: T.rescale("pts", "tb_num", "tb_den", F.lit(1), F.lit(den))
    return p.select("path", "seq", to(90_000).alias("pts_90k"), to(1000).alias("pts_ms"))


@query(f"{_P} SELECT path, seq, pts * (CAST(tb_num AS DOUBLE) / tb_den) AS sec, {_SEC} AS sec_multiplied, printf('%.6fs', pts * (CAST(tb_num AS DOUBLE) / tb_den)) AS sec_text FROM packets")
def pts_seconds(spark, d):
    p = V.packets(spark, d)
    t = ("pts", "tb_num", "tb_den")
    return p.select("path", "seq", T.seconds(*t).alias("sec"), T.seconds_multiplied(*t).alias("sec_multiplied"), T.seconds_text(*t).alias("sec_text"))


@query("SELECT p_partkey, CAST(p_size * 6 // gcd(p_size * 6, p_partkey) AS BIGINT) AS num, CAST(p_partkey // gcd(p_size * 6, p_partkey) AS BIGINT) AS den FROM part")
def rational_reduce(spark, d):
    r = T.rational_reduce(F.col("p_size") * 6, F.col("p_partkey"))
    return V.table(spark, d, "part").select("p_partkey", r["num"].alias("num"), r["den"].alias("den"))


@query(
    """SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN '-' ELSE '' END || printf('%02d:%02d:%02d.%06d', (u // 1000000) // 3600, (u // 1000000) // 60 % 60, (u // 1000000) % 60, u % 1000000) AS clock
    FROM (SELECT c_custkey, c_acctbal, CAST(round(abs(c_acctbal) * 1e6) AS BIGINT) AS u FROM customer)"""
)
def sexagesimal(spark, d):
    return V.table(spark, d, "customer").select("c_custkey", T.sexagesimal("c_acctbal").alias("clock"))


@query(
    """SELECT o_orderkey, CASE WHEN r < 1e3 THEN printf('%.3f b/s', r) WHEN r < 1e6 THEN printf('%.3f kb/s', r / 1e3) WHEN r < 1e9 THEN printf('%.3f Mb/s', r / 1e6) ELSE printf('%.3f Gb/s', r / 1e9) END AS rate
    FROM (SELECT o_orderkey, CAST(o_orderkey * o_orderkey * 64 AS DOUBLE) AS r FROM orders)"""
)
def rate_prefix(spark, d):
    return V.table(spark, d, "orders").select("o_orderkey", T.rate_text(F.col("o_orderkey") * F.col("o_orderkey") * 64).alias("rate"))


_TIMES = "SELECT conv_id, turn, printf('%02d:%02d:%02d,%03d', turn // 4, turn * 7 % 60, conv_id % 60, conv_id * 37 % 1100) AS srt, printf('%d:%02d:%02d.%02d', turn // 4, turn * 7 % 60, conv_id % 60, conv_id * 3 % 110) AS ass, printf('%02d:%02d:%02d', turn, conv_id % 60, conv_id % 75) AS msf FROM conversations"


def _times(spark, d):
    t, c = F.col("turn"), F.col("conv_id")
    q = F.floor(t / 4)
    return V.table(spark, d, "conversations").select(
        "conv_id", "turn",
        F.format_string("%02d:%02d:%02d,%03d", q, t * 7 % 60, c % 60, c * 37 % 1100).alias("srt"),
        F.format_string("%d:%02d:%02d.%02d", q, t * 7 % 60, c % 60, c * 3 % 110).alias("ass"),
        F.format_string("%02d:%02d:%02d", t, c % 60, c % 75).alias("msf"),
    )


@query(f"SELECT conv_id, turn, srt, CASE WHEN conv_id * 37 % 1100 < 1000 THEN ((turn // 4 * 60 + turn * 7 % 60) * 60 + conv_id % 60) * 1000 + conv_id * 37 % 1100 END AS ms FROM ({_TIMES})")
def srt_time(spark, d):
    return _times(spark, d).select("conv_id", "turn", "srt", T.srt_time("srt").alias("ms"))


@query(f"SELECT conv_id, turn, ass, CASE WHEN conv_id * 3 % 110 < 100 THEN ((turn // 4 * 60 + turn * 7 % 60) * 60 + conv_id % 60) * 1000 + conv_id * 3 % 110 * 10 END AS ms FROM ({_TIMES})")
def ass_time(spark, d):
    return _times(spark, d).select("conv_id", "turn", "ass", T.ass_time("ass").alias("ms"))


@query(f"SELECT conv_id, turn, msf, round(CAST(turn * 60 + conv_id % 60 AS DOUBLE) + CAST(conv_id % 75 AS DOUBLE) / 75, 9) AS sec FROM ({_TIMES})")
def msf_time(spark, d):
    return _times(spark, d).select("conv_id", "turn", "msf", F.round(T.msf_time("msf"), 9).alias("sec"))


@query("SELECT p_partkey, CASE WHEN p_retailprice = floor(p_retailprice) THEN printf('%d', CAST(p_retailprice AS BIGINT)) ELSE regexp_replace(printf('%.6f', p_retailprice), '\\.?0+$', '') END AS text FROM part")
def float_text(spark, d):
    return V.table(spark, d, "part").select("p_partkey", T.float_text("p_retailprice").alias("text"))


@query("SELECT o_orderkey, printf('%02d:%02d:%02d.%03d', m // 3600000, m // 60000 % 60, m // 1000 % 60, m % 1000) AS hud FROM (SELECT o_orderkey, CAST(floor(o_totalprice * 1000) AS BIGINT) AS m FROM orders)")
def hms_text(spark, d):
    return V.table(spark, d, "orders").select("o_orderkey", T.hms_millis("o_totalprice").alias("hud"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_size WHEN p_partkey % 3 = 1 THEN p_size * 1000 + 500 END AS num, CASE WHEN p_partkey % 3 = 0 THEN 1001 WHEN p_partkey % 3 = 1 THEN 1000 END AS den FROM part")
def parse_rate(spark, d):
    k = F.col("p_partkey") % 3
    text = F.when(k == 0, F.concat("p_size", F.lit("/1001"))).when(k == 1, F.concat("p_size", F.lit(".5"))).otherwise(F.lit("0/0"))
    r = T.parse_rate(text)
    return V.table(spark, d, "part").select("p_partkey", r["num"].alias("num"), r["den"].alias("den"))


@query("SELECT event_id, (e >> 24 & 127) * 2097152 + (e >> 16 & 127) * 16384 + (e >> 8 & 127) * 128 + (e & 127) AS size FROM (SELECT event_id, event_id * 2654435761 % 4294967296 AS e FROM events)")
def syncsafe(spark, d):
    v = F.col("event_id") * 2654435761 % 4294967296
    return V.table(spark, d, "events").select("event_id", T.syncsafe(v).alias("size"))


@query("SELECT event_id, event_id * 7919 % 8589934592 AS pts FROM events")
def pes_timestamp(spark, d):
    t = F.col("event_id") * 7919 % 8589934592
    part = lambda low, n: F.shiftrightunsigned(t, low).bitwiseAND(F.lit((1 << n) - 1))
    coded = (part(30, 3) * 2 + 1) * (1 << 32) + (part(15, 15) * 2 + 1) * (1 << 16) + part(0, 15) * 2 + 1
    return V.table(spark, d, "events").select("event_id", T.pes_timestamp(coded).alias("pts"))


@query(f"{_P} SELECT path, seq, stream_index, pts FROM packets WHERE {_SEC} >= {SS}")
def trim_ss(spark, d):
    return P.trim_start(V.packets(spark, d), SS).select("path", "seq", "stream_index", "pts")


@query(f"{_P}, k AS (SELECT * FROM packets WHERE {_SEC} >= {SS}), f AS (SELECT *, max(CASE WHEN {_SEC} - {SS} > {DUR} THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY seq ROWS UNBOUNDED PRECEDING) AS over_ FROM k) SELECT path, seq, pts FROM f WHERE over_ = 0")
def limit_t_prefix(spark, d):
    return P.limit_duration(P.trim_start(V.packets(spark, d), SS), DUR, SS).select("path", "seq", "pts")


_S = V.duck("packets", "streams")


@query(f"{_S}, o AS (SELECT path, stream_index, row_number() OVER (PARTITION BY path ORDER BY stream_index) - 1 AS out_index FROM streams WHERE media_type IN ('audio', 'video')) SELECT p.path, seq, p.stream_index AS source, CAST(o.out_index AS INT) AS stream_index FROM packets p JOIN o ON o.path = p.path AND o.stream_index = p.stream_index")
def stream_route(spark, d):
    out = P.default_streams(V.streams(spark, d), video=True)
    out = out.withColumn("out_index", F.expr("CAST(row_number() OVER (PARTITION BY path ORDER BY stream_index) - 1 AS INT)")).select("path", "stream_index", "out_index")
    p = V.packets(spark, d).withColumn("source", F.col("stream_index"))
    return P.route(p, out).select("path", "seq", "source", "stream_index")


@query(f"{_S} SELECT path, stream_index, media_type FROM streams WHERE media_type = 'audio'")
def default_streams(spark, d):
    return P.default_streams(V.streams(spark, d)).select("path", "stream_index", "media_type")


@query(f"{_S} SELECT s.path, s.stream_index, media_type, coalesce(n, 0) AS nb_read_packets FROM streams s LEFT JOIN (SELECT path, stream_index, count(*) AS n FROM packets GROUP BY ALL) p ON p.path = s.path AND p.stream_index = s.stream_index")
def packet_count_by_stream(spark, d):
    return P.count_by_stream(V.streams(spark, d), V.packets(spark, d)).select("path", "stream_index", "media_type", "nb_read_packets")


@query(f"{_P} SELECT path, seq, stream_index + 10 AS stream_index, pts, size FROM packets WHERE stream_index < 3")
def copy_relabel(spark, d):
    outs = V.streams(spark, d).where("stream_index < 3").select("path", "stream_index", (F.col("stream_index") + 10).alias("out_index"))
    return P.route(V.packets(spark, d), outs).select("path", "seq", "stream_index", "pts", "size")


@query(f"{_P} SELECT path, seq, pts AS dts_us, row_number() OVER (PARTITION BY path ORDER BY pts, seq, stream_index) - 1 AS merged FROM packets")
def dts_merge(spark, d):
    p = V.packets(spark, d).withColumn("dts", F.col("pts")).withColumn("pos", F.col("seq"))
    return P.merge_by_dts(p).select("path", "seq", "dts_us", "merged")


@query(f"{_P} SELECT path, count(*) AS packets, CAST(sum(size) AS BIGINT) AS bytes FROM packets GROUP BY path")
def bytes_total(spark, d):
    return P.totals(V.packets(spark, d))


@query(f"{_P} SELECT path, CASE WHEN max(pts) > min(pts) THEN CAST(round(sum(size) * 8 / ((max(pts) - min(pts)) / 1e10)) AS BIGINT) END AS bit_rate FROM packets GROUP BY path")
def container_bitrate(spark, d):
    files = V.packets(spark, d).groupBy("path").agg(F.sum("size").alias("bytes"), ((F.max("pts") - F.min("pts")) / 1e10).alias("duration"))
    return P.container_bit_rate(files).select("path", "bit_rate")


@query(f"{_I} SELECT track, idx, CAST(coalesce(sum(delta) OVER w, 0) AS BIGINT) AS dts, CAST(coalesce(sum(delta) OVER w, 0) + cts AS BIGINT) AS pts FROM sample_index WINDOW w AS (PARTITION BY track ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def stts_dts_ctts_pts(spark, d):
    return P.sample_times(V.sample_index(spark, d)).select("track", "idx", "dts", "pts")


@query(f"{_I} SELECT track, idx, chunk, CAST(coalesce(sum(size) OVER (PARTITION BY track, chunk ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM sample_index")
def chunk_offset(spark, d):
    return P.chunk_offsets(V.sample_index(spark, d)).select("track", "idx", "chunk", "offset")


@query(f"{_I}, r AS (SELECT track, idx // 3 AS run, count(*) AS n, max(delta) AS delta FROM sample_index GROUP BY ALL) SELECT track, unnest(range(CAST(f AS BIGINT), CAST(f + n AS BIGINT))) AS idx, delta FROM (SELECT *, coalesce(sum(n) OVER (PARTITION BY track ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f FROM r)")
def expand_stts_runs(spark, d):
    runs = V.sample_index(spark, d).groupBy("track", F.floor(F.col("idx") / 3).alias("run")).agg(F.count("*").alias("n"), F.max("delta").alias("delta"))
    return P.expand_runs(runs, "delta").select("track", "idx", "delta")


@query(f"{_I} SELECT track, idx, coalesce(last_value(CASE WHEN sync THEN idx END IGNORE NULLS) OVER (PARTITION BY track ORDER BY idx ROWS UNBOUNDED PRECEDING), 0) AS keyframe FROM sample_index")
def seek_keyframe_asof(spark, d):
    return P.keyframe_before(V.sample_index(spark, d)).select("track", "idx", "keyframe")


@query(
    f"""{_I}, t AS (SELECT track, idx, CAST(coalesce(sum(delta) OVER (PARTITION BY track ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS dts FROM sample_index),
    g AS (SELECT DISTINCT l_suppkey AS track, l_partkey % 1000 AS target FROM lineitem)
    SELECT g.track, g.target, coalesce(t.idx, 0) AS sample FROM g ASOF LEFT JOIN t ON t.track = g.track AND t.dts <= g.target"""
)
def timestamp_to_sample(spark, d):
    times = P.sample_times(V.sample_index(spark, d))
    targets = V.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("track"), (F.col("l_partkey") % 1000).alias("target")).distinct()
    return P.seek(times, targets)


@query(f"{_P} SELECT path, seq, coalesce(greatest(pts - lag(pts) OVER w, 0), greatest(lead(pts) OVER w - pts, 0), 0) AS mux_duration FROM packets WINDOW w AS (PARTITION BY path, stream_index ORDER BY seq)".replace("greatest(pts - lag(pts) OVER w, 0)", "CASE WHEN lag(pts) OVER w IS NOT NULL THEN greatest(pts - lag(pts) OVER w, 0) END").replace("greatest(lead(pts) OVER w - pts, 0)", "CASE WHEN lead(pts) OVER w IS NOT NULL THEN greatest(lead(pts) OVER w - pts, 0) END"))
def mux_duration_lag(spark, d):
    return P.mux_durations(V.packets(spark, d).withColumn("dts", F.col("pts"))).select("path", "seq", "mux_duration")


@query(f"{_C} SELECT path, CAST(idx AS INT) AS idx, start, coalesce(lead(start) OVER (PARTITION BY path ORDER BY idx), max(start) OVER (PARTITION BY path) + 60) AS \"end\" FROM chapters")
def chapter_lead(spark, d):
    ch = V.chapters(spark, d)
    return P.chapter_ends(ch, ch.groupBy("path").agg((F.max("start") + 60).alias("duration"))).select("path", "idx", "start", "end")


@query(f"{_C}, e AS (SELECT *, lead(start) OVER (PARTITION BY path ORDER BY idx) AS stop FROM chapters), t AS (SELECT DISTINCT path, start + k AS time FROM chapters, (VALUES (5000), (-5000000)) v(k)) SELECT t.path, t.time, CAST(min(idx) AS INT) AS chapter FROM t LEFT JOIN e ON e.path = t.path AND coalesce(start, 0) <= time AND time < coalesce(stop, 'inf') GROUP BY ALL")
def chapter_lookup_range(spark, d):
    ch = V.chapters(spark, d)
    return P.chapter_at(P.chapter_ends(ch), ch.select("path", F.explode(F.array(F.col("start") + 5000, F.col("start") - 5_000_000)).alias("time")).distinct())


@query(f"{_P} SELECT path, seq, seq % 40 = 0 AS psi FROM packets")
def psi_every_40(spark, d):
    return P.psi_marks(V.packets(spark, d)).select("path", "seq", "psi")


@query(f"{_P} SELECT path, seq, stream_index, CAST((row_number() OVER (PARTITION BY path, stream_index ORDER BY seq) - 1) % 16 AS INT) AS cc FROM packets")
def continuity_counter(spark, d):
    return P.continuity(V.packets(spark, d)).select("path", "seq", "stream_index", "cc")


@query(f"{_S} SELECT path, stream_index, media_type, CAST(row_number() OVER (PARTITION BY path, media_type ORDER BY stream_index) - 1 AS INT) AS type_index FROM streams")
def typed_stream_index(spark, d):
    return P.typed_index(V.streams(spark, d))


@query(
    f"""WITH RECURSIVE {V.DUCK["packets"]}, p AS (SELECT path, seq, pts // 1000 AS ms FROM packets),
    c AS (SELECT path, seq, ms AS start, 0 AS cluster FROM p WHERE seq = 0
      UNION ALL SELECT p.path, p.seq, CASE WHEN p.ms - c.start >= 86400000 THEN p.ms ELSE c.start END, c.cluster + CASE WHEN p.ms - c.start >= 86400000 THEN 1 ELSE 0 END FROM c JOIN p ON p.path = c.path AND p.seq = c.seq + 1)
    SELECT path, seq, cluster FROM c"""
)
def mkv_cluster_assign(spark, d):
    return P.clusters(V.packets(spark, d), 86_400_000)


@query(f"{_P}, u AS (SELECT *, sum(CASE WHEN is_keyframe THEN 1 ELSE 0 END) OVER (PARTITION BY path, stream_index ORDER BY seq ROWS UNBOUNDED PRECEDING) AS unit FROM packets) SELECT path, stream_index, CAST(unit AS BIGINT) AS unit, count(*) AS fragments, CAST(sum(size) AS BIGINT) AS bytes, min(seq) AS first_seq FROM u WHERE unit > 0 GROUP BY ALL")
def pes_reassembly(spark, d):
    return P.reassemble(V.packets(spark, d).withColumn("start", F.col("is_keyframe")))


@query(f"{_P}, f AS (SELECT path, seq, seq // 16 AS sequence, pts * 7919 % 64 AS poc FROM packets) SELECT path, seq, sequence, poc, CAST(row_number() OVER (PARTITION BY path, sequence ORDER BY poc, seq) - 1 AS INT) AS shown FROM f")
def reorder_poc(spark, d):
    f = V.packets(spark, d).select("path", "seq", F.floor(F.col("seq") / 16).alias("sequence"), (F.col("pts") * 7919 % 64).alias("poc"), F.col("seq").alias("decode_order"))
    return P.presentation_order(f).drop("decode_order")


@query(f"{_P}, t AS (SELECT path, seq, pts / 1e9 AS time, pts / 1e9 - lag(pts / 1e9) OVER (PARTITION BY path ORDER BY seq) AS step FROM packets) SELECT path, seq, round(CASE WHEN step > 0 AND step <= 10 THEN step ELSE 0.0 END, 6) AS duration FROM t")
def frame_duration_lag(spark, d):
    f = V.packets(spark, d).select("path", "seq", (F.col("pts") / 1e9).alias("time"))
    return P.frame_durations(f).select("path", "seq", F.round("duration", 6).alias("duration"))
