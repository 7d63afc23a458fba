import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelframe.codecs import pcm
from reelframe.functions import text as X
from reelframe.operators import audio as A
from reelframe.operators import packets as P
from reelframe.operators import player as Y
from reelframe.plans.pictures import Pictures
from reelframe.plans.pipeline import Transcode
from reelframe.sources import containers as C
from reelframe.sources import media as M
from reelframe.sources import sheets as S


def wav(n, channels, rate):
    x = (np.sin(np.arange(n)[:, None] * 0.05 + np.arange(channels)) * 9000).astype(np.int64)
    s = C.Stream(0, "audio", "pcm_s16le", (1, rate), b"", rate, channels, 16)
    return C.mux_wav([s], [C.Packet(0, 0, 0, pcm.encode(x, "pcm_s16le"), n)]), x


@pytest.mark.parametrize(("channels", "rate"), [(9, 44100), (1, 24000), (2, 192000), (3, 12000), (2, 48000)])
def test_any_rate_and_channel_count(spark, channels, rate):
    data, x = wav(1000, channels, rate)
    rows = Transcode(M.memory(spark, {"a.wav": data})).resample(48000, 2).frames().collect()
    n = math.ceil(1000 * 48000 / rate)
    assert sum(r.nb_samples for r in rows) == n and all((r.rate, r.channels, len(r.samples)) == (48000, 2, 2 * r.nb_samples) for r in rows)
    got = np.array(rows[0].samples).reshape(-1, 2)
    pair = (x if channels > 1 else np.repeat(x, 2, 1))[:, :2] / 32768
    want = np.stack([np.interp(np.minimum(np.arange(len(got)) * rate / 48000, 999), np.arange(1000), pair[:, c]) for c in (0, 1)], 1)
    assert np.allclose(got, want, atol=1e-9)


def test_to_mono_of_many(spark):
    data, x = wav(100, 9, 8000)
    row = Transcode(M.memory(spark, {"a.wav": data})).resample(None, 1).frames().first()
    assert np.allclose(row.samples, (x / 32768).mean(1)) and row.channels == 1


def test_a_broken_packet_is_a_row(spark):
    good, x = wav(300, 1, 8000)
    streams = M.streams(M.memory(spark, {"a.wav": good, "b.wav": good}))
    p = M.packets(M.memory(spark, {"a.wav": good, "b.wav": good}))
    p = p.withColumn("data", F.when(F.col("path") == "b.wav", F.expr("substring(data, 1, 3)")).otherwise(F.col("data")))
    rows = {r.path: r for r in M.decode_audio(p, streams).collect()}
    assert rows["a.wav"].status == "ok" and np.allclose(np.array(rows["a.wav"].samples) * 32768, x[:, 0])
    assert rows["b.wav"].status == "error" and rows["b.wav"].samples is None and "ValueError" in rows["b.wav"].error


def test_aiff_beside_wav(spark):
    """A 24-bit AIFF and a WAV in one job."""
    x = np.arange(-50, 50) * 70_000
    s = C.Stream(0, "audio", "pcm_s24be", (1, 8000), b"", 8000, 1, 24)
    files = {"a.aiff": C.mux_aiff([s], [C.Packet(0, 0, 0, pcm.encode(x, "pcm_s24be"), 100)]), "b.wav": wav(100, 1, 8000)[0]}
    rows = {r.path: r for r in Transcode(M.memory(spark, files)).frames().collect()}
    assert np.allclose(np.array(rows["a.aiff"].samples) * (1 << 23), x) and len(rows) == 2


def test_stream_copy(spark):
    data, _ = wav(9000, 2, 44100)
    media = M.memory(spark, {"a.wav": data})
    out = {r.path: bytes(r.content) for r in Transcode(media).copied("wav").collect()}
    assert out["a.wav"] == data
    _, _, packets = C.demux(next(bytes(r.content) for r in Transcode(media).trim(ss=0.09).copied("wav").collect()))
    assert sum(len(p.data) for p in packets) == (9000 - 4096) * 4


def test_pictures(spark):
    px = np.arange(6 * 4 * 3, dtype=np.uint8).reshape(4, 6, 3)
    rows = spark.createDataFrame([("a", i, 6, 4, [bytearray((px + i).tobytes())]) for i in range(12)], "path string, frame_no int, width int, height int, planes array<binary>")
    got = {r.frame_no: r for r in Pictures(rows, "rgb24").chain("scale=3:2,format=gray8").run().collect()}
    assert (got[0].width, got[0].height, len(got[0].planes[0])) == (3, 2, 6)
    with pytest.raises(ValueError):
        Pictures(rows, "rgb24").convert("nv21")
    assert Pictures(rows, "gray8").text("x", 0, 0, (1, 1, 1), {}).steps == []
    dump = S.raw_dump(rows, 10, "rgb24").first()
    assert len(dump.content) == 10 * (24 + 6 + 6)


def test_loudness_runs_equal_one_run(spark):
    rng = np.random.default_rng(0)
    data = [(s, int(n), rng.normal(size=5).tolist()) for s in (0, 1) for n in rng.choice(20_000, 60, replace=False)]
    rows = A.loudnorm(spark.createDataFrame(data, "stream int, frame_no long, samples array<double>")).collect()
    for r in rows:
        before = np.concatenate([x for s, n, x in data if s == r.stream and n <= r.frame_no])
        assert abs(r.lufs - (-0.691 + 10 * math.log10((before**2).mean()))) < 1e-9


def test_packet_counts_of_streams_without_packets(spark):
    streams = spark.createDataFrame([("a", 0), ("a", 1)], "path string, stream_index int")
    packets = spark.createDataFrame([("a", 0), ("a", 0)], "path string, stream_index int")
    assert {r.stream_index: r.nb_read_packets for r in P.count_by_stream(streams, packets).collect()} == {0: 2, 1: 0}


def test_clusters_without_times(spark):
    rows = [("a", i, t, 1, 1000) for i, t in enumerate([None, 10, None, 5009, 5010, 2, 10_011])]
    got = P.clusters(spark.createDataFrame(rows, "path string, seq long, pts long, tb_num int, tb_den int")).orderBy("seq").collect()
    assert [r.cluster for r in got] == [0, 0, 0, 0, 1, 1, 2]


def test_chapters_before_the_first_and_without_any(spark):
    ch = spark.createDataFrame([("a", 0, 5.0, 9.0), ("a", 1, 9.0, None)], "path string, idx int, start double, end double")
    times = spark.createDataFrame([("a", 1.0), ("a", 5.0), ("a", 8.9), ("a", 50.0), ("b", 3.0)], "path string, time double")
    assert {(r.path, r.time): r.chapter for r in P.chapter_at(ch, times).collect()} == {("a", 1.0): None, ("a", 5.0): 0, ("a", 8.9): 0, ("a", 50.0): 1, ("b", 3.0): None}


def test_ass_formats_and_nesting(spark):
    sheet = "[Script Info]\n[Events]\nFormat: Start, Style, End, Text\nDialogue: 0:00:01.00,Top,0:00:02.50,{\\b1{x{y}}z}Hi, {there}\\Nyou{\\i\nDialogue: bad,Top,0:00:02.50,no"
    plain = "[Events]\nDialogue: 0,0:00:01.00,0:00:02.50,Main,,0,0,0,,One, two"
    got = {r.track: r for r in X.parse_ass(spark.createDataFrame([("a", sheet), ("b", plain)], "track string, content string")).collect()}
    assert (got["a"].start_ms, got["a"].end_ms, got["a"].style, got["a"].text) == (1000, 2500, "Top", "Hi, {there}\nyou")
    assert (got["b"].style, got["b"].text) == ("Main", "One, two")
    deep = "a{\\" + "{" * 40 + "x" + "}" * 41 + "b{c}"
    assert spark.createDataFrame([(deep,)], "t string").select(X.strip_ass_tags("t")).first()[0] == "ab{c}"


def test_seek_without_keyframes(spark):
    p = spark.createDataFrame([("a", 0, i, None if i == 2 else i * 10, i * 10, False) for i in range(4)], "path string, stream_index int, seq long, pts long, dts long, is_keyframe boolean")
    t = spark.createDataFrame([("a", 0, 25), ("a", 0, -1)], "path string, stream_index int, target long")
    assert [r.seq for r in Y.seek_point(p, t).collect()] == [0, 0]


def test_cue_packets(spark):
    data, _ = wav(44100 * 3, 1, 44100)
    sheet = b'FILE "a.wav" WAVE\n TRACK 01 AUDIO\n  INDEX 01 00:00:00\n TRACK 02 AUDIO\n  INDEX 01 00:01:00\n'
    rows = S.cue_packets(M.memory(spark, {"d/a.wav": data, "d/x.cue": sheet, "d/y.cue": sheet.replace(b"a.wav", b"none.wav")})).orderBy("seq").collect()
    assert {r.path for r in rows} == {"d/x.cue"} and [r.chapter for r in rows] == [int(r.pts >= 44100) for r in rows] and len(rows) == 33


def test_format_by_file_name(spark):
    data, _ = wav(100, 1, 8000)
    t = Transcode(M.memory(spark, {"a.wav": data}))
    assert bytes(t.files("flac", "x/y.FLAC").first().content[:4]) == b"fLaC"
    for name in ("x.yuv", "x.3gp", "noformat"):
        with pytest.raises(ValueError):
            t.files("flac", name)


def test_blocks_of_a_filter_equal_the_recursion():
    rng = np.random.default_rng(1)
    c = A.peaking(900.0, 5.0, 0.8, 8000)
    f, x, state, parts = A.Biquad(c, 32), rng.normal(size=(500, 2)), np.zeros((4, 2)), []
    for a, b in ((0, 1), (1, 2), (2, 70), (70, 103), (103, 500)):
        parts.append(f.run(x[a:b], state))
    got, want = np.concatenate(parts), np.zeros((502, 2))
    x = np.r_[np.zeros((2, 2)), x]
    for i in range(2, 502):
        want[i] = c[0] * x[i] + c[1] * x[i - 1] + c[2] * x[i - 2] - c[3] * want[i - 1] - c[4] * want[i - 2]
    assert np.allclose(got, want[2:], atol=1e-12)
