import http.server
import threading

import numpy as np
import pytest

from reelframe import registry as G
from reelframe.functions import headers as H
from reelframe.functions.bits import ByteReader, BitWriter
from reelframe.sources import containers as C
from reelframe.sources import http as U


def test_first_registered_wins():
    r = G.Registry("demuxer")
    r.add("b", lambda: 1)
    r.add("a", lambda: 2, "A")
    r.add("b", lambda: 3)
    assert r.find("b")() == 1 and "a" in r and "c" not in r
    assert r.names() == [("a", "A"), ("b", "b"), ("b", "b")]
    with pytest.raises(G.NotRegistered):
        r.find("c")


def test_send_and_receive():
    e, d = G.encoder("pcm_s16le"), G.decoder("pcm_s16le", channels=2)
    with pytest.raises(G.NeedMore):
        e.receive()
    x = np.arange(8).reshape(4, 2)
    e.send(x)
    d.send(e.receive())
    d.send(b"")
    assert np.array_equal(d.receive(), x)
    with pytest.raises(G.NeedMore):
        d.receive()
    d.send(None)
    with pytest.raises(G.Ended):
        d.receive()
    with pytest.raises(G.Ended):
        d.send(b"ab")
    d.flush()
    d.send(bytes(4))
    assert d.receive().shape == (1, 2)
    late = G.Exchange(lambda x: [], lambda: ["rest"])
    late.send(1)
    late.send(None)
    assert late.receive() == "rest"


def test_flac_by_the_protocol():
    x = (np.sin(np.arange(500)) * 9000).astype(np.int64)[:, None]
    e, d = G.encoder("flac"), G.decoder("flac", bits=16, rate=44100)
    e.send(x)
    d.send(e.receive())
    assert np.array_equal(d.receive(), x)


def test_typed_reads():
    r = ByteReader(b"\x01\xff\xfe\x01\x02\x03abcdZ", "big")
    assert (r.u8(), r.i16(), r.u24(), r.tag(), r.u8()) == (1, -2, 0x010203, "abcd", 90)
    with pytest.raises(EOFError):
        r.u8()
    assert ByteReader(b"\xff\xff\xff\xff").i32() == -1 and ByteReader(b"\1\2\3\4").u32() == 0x04030201


def test_hvcc():
    w = BitWriter()
    for v, n in ((0x4201, 16), (0, 4), (0, 3), (1, 1), (0, 2), (0, 1), (1, 5), (0x60000000, 32), (0, 48), (93, 8)):
        w.bits(v, n)
    ue = lambda v: w.bits(v + 1, 2 * (v + 1).bit_length() - 1)
    for v in (0, 1, 64, 48):
        ue(v)
    w.bits(0, 1)
    ue(2)
    ue(2)
    unit = w.bytes()
    assert H.hevc_sps(unit)["width"] == 64 and H.hevc_sps(unit)["bit_depth"] == 10
    record = H.build_hvcc([b"\x40\1v"], [unit], [b"\x44\1p", b"\x44\1q"])
    got = H.parse_hvcc(record)
    assert got["profile"] == 1 and got["level"] == 93 and got["length_size"] == 4
    assert got["units"] == {32: [b"\x40\1v"], 33: [unit], 34: [b"\x44\1p", b"\x44\1q"]}
    with pytest.raises(ValueError):
        H.parse_hvcc(record[:-1])
    with pytest.raises(ValueError):
        H.build_hvcc([], [], [])


def test_tags_of_mp3_and_flv():
    frame = b"\xff\xfb\x90\x64" + bytes(413)
    tag = bytearray(frame)
    tag[36:48] = b"Xing" + (1).to_bytes(4, "big") + (5).to_bytes(4, "big")
    tag[48 + 21 : 48 + 24] = (576 << 12 | 1000).to_bytes(3, "big")
    _, streams, packets = C.demux(bytes(tag) + frame * 5)
    assert len(packets) == 5 and streams[0].duration == 5 * 1152 - 1576
    assert streams[0].metadata == {"frames": "5", "encoder_delay": "576", "encoder_padding": "1000"}
    s = [C.Stream(0, "video", "h264", (1, 1000), b"\1", width=0, height=0)]
    data = C.mux_flv(s, [C.Packet(0, 0, 0, b"abc", 40, True)])
    import struct

    body = b"\2\0\x0aonMetaData\x08\0\0\0\3" + b"\0\x08duration\0" + struct.pack(">d", 1.5) + b"\0\5width\0" + struct.pack(">d", 320.0) + b"\0\6height\0" + struct.pack(">d", 200.0)
    script = bytes([18]) + len(body).to_bytes(3, "big") + bytes(7) + body + (11 + len(body)).to_bytes(4, "big")
    _, streams, packets = C.demux(data[:13] + script + data[13:])
    assert (streams[0].duration, streams[0].width, streams[0].height, len(packets)) == (1500, 320, 200, 1)


@pytest.fixture(scope="module")
def server():
    data = bytes(range(256)) * 2000

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            if self.path != "/a.bin":
                self.send_error(404)
                return
            start, end, code = 0, len(data) - 1, 200
            if r := self.headers.get("Range"):
                a, b = r.removeprefix("bytes=").split("-")
                start, end, code = int(a), int(b) if b else end, 206
                if start >= len(data):
                    self.send_error(416)
                    return
            body = data[start : end + 1]
            self.send_response(code)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", data
    s.shutdown()


def test_urls(spark, server):
    root, data = server
    assert U.read_url(f"{root}/a.bin") == data and U.read_url(f"{root}/a.bin", 100, 50) == data[100:150] and U.read_url(f"{root}/a.bin", 1 << 30) == b""
    rows = {r.path: r for r in U.load_urls(spark.createDataFrame([(f"{root}/a.bin",), (f"{root}/b.bin",)], "url string")).collect()}
    assert bytes(rows[f"{root}/a.bin"].content) == data and rows[f"{root}/b.bin"].status == "error"


def test_url_stream(spark, server, tmp_path):
    root, data = server
    U.register(spark)
    stream = spark.readStream.format("media_url").option("bytes_per_trigger", 200_000).load(f"{root}/a.bin")
    q = stream.writeStream.format("memory").queryName("chunks").option("checkpointLocation", str(tmp_path)).start()
    for _ in range(60):
        q.processAllAvailable()
        rows = sorted(spark.table("chunks").collect(), key=lambda r: r.pos)
        if rows and rows[-1].pos + len(rows[-1].data) == len(data):
            break
    q.stop()
    assert b"".join(bytes(r.data) for r in rows) == data and len(rows) >= 3
