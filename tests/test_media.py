import numpy as np
import pytest

from reelframe.codecs import flac, pcm
from reelframe.plans.pipeline import Transcode
from reelframe.sources import containers as C
from reelframe.sources import media as M
from reelframe.sources.probe import probe_bytes

RNG = np.random.default_rng(4)
AUDIO = lambda codec, **kw: C.Stream(0, "audio", codec, (1, 44100), b"", 44100, 2, kw.get("bits", 0))


def sine(n=10_000, channels=2):
    t = np.arange(n)[:, None] / 44100
    return (np.sin(2 * np.pi * 440 * t + np.arange(channels)) * 12000).astype(np.int64)


def wav(n=10_000, channels=2):
    x = sine(n, channels)
    s = C.Stream(0, "audio", "pcm_s16le", (1, 44100), b"", 44100, channels, 16)
    return C.mux_wav([s], [C.Packet(0, 0, 0, pcm.encode(x, "pcm_s16le"), n)]), x


def same(packets, found, times=True):
    assert [p.data for p in found] == [p.data for p in packets]
    assert [p.stream for p in found] == [p.stream for p in packets]
    if times:
        assert [p.pts for p in found] == [p.pts for p in packets]


def test_wav():
    data, x = wav()
    fmt, streams, packets = C.demux(data)
    assert fmt == "wav" and streams[0].duration == 10_000 and [p.pts for p in packets] == [0, 4096, 8192] and packets[-1].duration == 1808
    assert np.array_equal(np.concatenate([pcm.decode(p.data, "pcm_s16le", 2) for p in packets]), x)
    assert C.mux_wav(streams, packets) == data
    with pytest.raises(ValueError):
        C.demux(b"RIFF\0\0\0\0WAVE")


def test_aiff():
    s = C.Stream(0, "audio", "pcm_s16be", (1, 48000), b"", 48000, 1, 16)
    data = C.mux_aiff([s], [C.Packet(0, 0, 0, sine(5000, 1).astype(">i2").tobytes(), 5000)])
    fmt, streams, packets = C.demux(data)
    assert fmt == "aiff" and (streams[0].rate, streams[0].codec, streams[0].duration) == (48000, "pcm_s16be", 5000) and len(packets) == 2


def test_flac():
    x = sine(9000)
    parts = [x[i : i + 4096] for i in range(0, 9000, 4096)]
    packets = [C.Packet(0, 4096 * i, 4096 * i, flac.encode_frame(p, i, 16), len(p)) for i, p in enumerate(parts)]
    fmt, streams, found = C.demux(C.mux_flac([AUDIO("flac", bits=16)], packets))
    assert fmt == "flac" and (streams[0].rate, streams[0].channels, streams[0].bits, streams[0].duration) == (44100, 2, 16, 9000)
    same(packets, found)


def test_adts_and_mp3():
    packets = [C.Packet(0, 1024 * i, 1024 * i, RNG.bytes(50 + i), 1024) for i in range(6)]
    fmt, streams, found = C.demux(C.mux_adts([AUDIO("aac")], packets))
    assert fmt == "aac" and (streams[0].rate, streams[0].channels) == (44100, 2)
    same(packets, found)
    frame = b"\xff\xfb\x90\x64" + bytes(413)
    fmt, streams, found = C.demux(frame * 5)
    assert fmt == "mp3" and [p.pts for p in found] == [1152 * i for i in range(5)] and streams[0].rate == 44100


VIDEO = C.Stream(0, "video", "h264", (1, 90000), b"\1\x42\0\x1e\xff\xe1\0\0\1\0\0", width=640, height=360)


def av_packets():
    out = []
    for i in range(90):
        nal = b"\0\0\0\1" + (b"\x65" if i % 30 == 0 else b"\x41") + RNG.bytes(RNG.integers(5, 700)).replace(b"\0", b"\1")
        out.append(C.Packet(0, 9000 * i + 18000, 9000 * i + (0 if i % 3 else 9000), nal, 9000, i % 30 == 0))
        out.append(C.Packet(1, 9000 * i, 9000 * i, RNG.bytes(100), 9000, True))
    return out


def av_streams(tb):
    return [C.Stream(0, "video", "h264", tb, VIDEO.extra, width=640, height=360), C.Stream(1, "audio", "aac", tb, b"\x12\x10", 44100, 2)]


def test_ts():
    packets = av_packets()
    fmt, streams, found = C.demux(C.mux_ts(av_streams((1, 90000)), packets))
    assert fmt == "mpegts" and [s.codec for s in streams] == ["h264", "aac"]
    for k in (0, 1):
        same([p for p in packets if p.stream == k], [p for p in found if p.stream == k])
    assert [p.key for p in found if p.stream == 0] == [p.key for p in packets if p.stream == 0]


def test_flv_and_matroska():
    for mux, want in ((C.mux_flv, "flv"), (C.mux_mkv, "matroska"), (C.mux_webm, "matroska")):
        packets = [C.Packet(p.stream, p.pts // 90, p.dts // 90, p.data, p.duration // 90, p.key) for p in av_packets()]
        fmt, streams, found = C.demux(mux(av_streams((1, 1000)), packets))
        assert fmt == want
        if fmt == "flv":
            kinds = {s.media_type: s.index for s in streams}
            found = [C.Packet({kinds["video"]: 0, kinds["audio"]: 1}[p.stream], p.pts, p.dts, p.data, 0, p.key) for p in found]
        else:
            assert (streams[0].width, streams[0].height, streams[1].rate, streams[1].channels) == (640, 360, 44100, 2)
        same(packets, found)
        assert [p.key for p in found] == [p.key for p in packets]


def test_mp4():
    packets = av_packets()
    for p in packets:
        p.dts = p.pts if p.stream else p.pts - 18000
    fmt, streams, found = C.demux(C.mux_mp4(av_streams((1, 90000)), packets))
    assert fmt == "mp4" and streams[0].extra == VIDEO.extra and (streams[0].width, streams[0].height) == (640, 360)
    for k in (0, 1):
        same([p for p in packets if p.stream == k], [p for p in found if p.stream == k])
    assert [p.key for p in found if p.stream == 0] == [p.key for p in packets if p.stream == 0]
    assert all(a.dts <= b.dts for a, b in zip(found, found[1:], strict=False))


def test_avi():
    streams = [C.Stream(0, "video", "h264", (1, 25), width=320, height=240), C.Stream(1, "audio", "pcm_s16le", (1, 44100), b"", 44100, 2, 16)]
    packets = [C.Packet(i % 2, None, None, RNG.bytes(40 * (1 + i % 3) if i % 2 else 31 + i), 1, i % 10 == 0 or i % 2 == 1) for i in range(40)]
    fmt, found_streams, found = C.demux(C.mux_avi(streams, packets))
    assert fmt == "avi" and [(s.codec, s.width, s.rate) for s in found_streams] == [("h264", 320, 0), ("pcm_s16le", 0, 44100)]
    same(packets, found, times=False)
    assert [p.key for p in found] == [p.key for p in packets] and [p.pts for p in found if p.stream == 0] == list(range(20))


def test_ogg():
    head = b"OpusHead\1\2" + bytes(9)
    s = C.Stream(0, "audio", "opus", (1, 48000), head, 48000, 2)
    packets = [C.Packet(0, 960 * i, 960 * i, RNG.bytes(n), 960) for i, n in enumerate([10, 255, 510, 70_000, 0, 3])]
    data = C.mux_ogg([s], [C.Packet(0, None, None, b"OpusTags", 0), *packets])
    fmt, streams, found = C.demux(data)
    assert fmt == "ogg" and (streams[0].codec, streams[0].channels) == ("opus", 2)
    assert [p.data for p in found] == [p.data for p in packets] and [p.pts for p in found] == [p.pts + 960 for p in packets]
    broken = bytearray(data)
    broken[data.rindex(b"OggS") + 30] ^= 1
    assert len(C.demux(bytes(broken))[2]) == len(packets) - 1


def test_laces():
    assert C.split_laces(b"abc", 0) == [b"abc"]
    assert C.split_laces(b"\2\1\2abbccc", 1) == [b"a", b"bb", b"ccc"]
    assert C.split_laces(b"\1aabb", 2) == [b"aa", b"bb"]
    assert C.split_laces(b"\2\x81" + bytes([0x80 | 63 + 1]) + b"abbccc", 3) == [b"a", b"bb", b"ccc"]


def test_elementary_streams():
    au = [b"\0\0\0\1\x67\x42\0\x1e\xda\2\x80\xbf\xe5\0\0\0\1\x68\xce\0\0\0\1\x65\x88abc", b"\0\0\0\1\x41\x9aefg", b"\0\0\0\1\x41\x9bxyz"]
    _, _, found = C.demux(b"".join(au), forced="h264")
    assert [p.key for p in found] == [True, False, False] and [p.pts for p in found] == [0, 1, 2]
    vol = b"\0\0\1\xb0\1\0\0\1\xb5\x09\0\0\1\0\0\0\1\x20abc"
    fmt, streams, found = C.demux(vol + b"\0\0\1\xb6one" + b"\0\0\1\xb6two" + b"\0\0\1\xb3g\0\0\1\xb6three")
    assert fmt == "m4v" and [p.data[-3:] for p in found] == [b"one", b"two", b"ree"] and streams[0].extra == vol


def test_probes():
    assert probe_bytes(b"", "x.mkv") == ("matroska", 50) and probe_bytes(b"abc", "x.bin") == (None, 0)
    assert probe_bytes(b"\0\0\0\x18ftypisom") == ("mp4", 100) and probe_bytes(b"\0\0\0\x18mdat....") == ("mp4", 75)
    assert probe_bytes(b"PERFORMER\nFILE x WAVE\n TRACK 01", "a.txt") == ("cue", 100) and probe_bytes(b"FILE TRACK", "a.cue") == ("cue", 50)
    assert probe_bytes(b"\0\0\1\x67ab\0\0\1\x65") == ("h264", 100)


def test_tables(spark):
    data, x = wav()
    media = M.memory(spark, {"a.wav": data, "bad.wav": b"RIFFxxxxWAVEjunk", "none.xyz": b"?", "empty.wav": b""})
    s = {r.path: r for r in M.streams(media).collect()}
    assert (s["a.wav"].status, s["a.wav"].codec, s["a.wav"].duration) == ("ok", "pcm_s16le", 10_000)
    assert {s[k].status for k in ("bad.wav", "none.xyz", "empty.wav")} == {"error"}
    frames = sorted(M.decode_audio(M.packets(media), M.streams(media)).collect(), key=lambda r: r.frame_no)
    got = np.concatenate([r.samples for r in frames]).reshape(-1, 2)
    assert np.array_equal(got * 32768, x)


def test_transcode(spark, tmp_path):
    data, x = wav()
    media = M.memory(spark, {"a.wav": data, "b.wav": wav(3000, 1)[0]})
    out = {r.path: bytes(r.content) for r in Transcode(media).chain("volume=0.5,volume=2,nonsense").files("pcm_s16le", "wav").collect()}
    assert out["a.wav"] == data
    out = {r.path: bytes(r.content) for r in Transcode(media).volume(0.5).files("flac", "flac").collect()}
    _, _, packets = C.demux(out["a.wav"])
    y = np.concatenate([flac.decode_frame(p.data, {"bits": 16, "rate": 44100})[1] for p in packets])
    assert np.abs(y - x / 2).max() <= 0.5
    M.save(Transcode(media).resample(48000, 1).files("pcm_s16le", "wav"), str(tmp_path))
    back = {r.path.rsplit("/", 1)[-1]: r for r in M.streams(M.load(spark, f"file://{tmp_path}", "*.wav")).collect()}
    assert (back["a.wav"].rate, back["a.wav"].channels) == (48000, 1) and back["b.wav"].duration == -(-3000 * 48000 // 44100)


def test_trim_is_below_decoding(spark):
    media = M.memory(spark, {"a.wav": wav(50_000)[0]})
    pts = sorted(r.pts for r in Transcode(media).trim(0.2, 0.5).frames().collect())
    assert pts == [p for p in range(0, 50_000, 4096) if p / 44100 >= 0.2 and p / 44100 - 0.2 <= 0.5]
