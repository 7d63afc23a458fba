import numpy as np
import pytest

from reelframe.codecs import mdct
from reelframe.functions import bits as B
from reelframe.functions import headers as H
from reelframe.operators import video as K
from reelframe.sources import media as M
from reelframe.sources import sheets
from reelframe.sources.datasource import register

from .test_media import wav


def test_mdct_gives_the_signal_back():
    x = np.random.default_rng(0).normal(size=5000)
    assert np.allclose(mdct.synthesise(mdct.analyse(x, 256), len(x)), x)
    q, scale = mdct.quantise(np.array([0.0, -2.0, 1.0]))
    assert q.tolist() == [0, -127, 64] and scale == 63.5 and mdct.quantise(np.zeros(3))[1] == 1.0


def test_mpeg4_headers():
    w = B.BitWriter()
    for v, n in ((0, 1), (1, 8), (0, 1), (1, 4), (0, 1), (0, 2), (1, 1), (25, 16), (1, 1), (0, 1), (1, 1), (352, 13), (1, 1), (288, 13), (1, 1), (0, 1)):
        w.bits(v, n)
    layer = w.bytes()
    assert {k: H.mpeg4_layer(layer)[k] for k in ("width", "height", "ticks")} == {"width": 352, "height": 288, "ticks": 25}
    units = H.mpeg4_units(b"\0\0\1\x20" + layer + b"\0\0\1\xb6\x10a\0\0\1\xb6\x50b\0\0\1\xb6\x90c")
    assert [c for _, c, _ in units] == [0x20, 0xB6, 0xB6, 0xB6] and [H.mpeg4_picture(b) for _, c, b in units if c == 0xB6] == ["I", "P", "B"]


def test_hevc_headers():
    w = B.BitWriter()

    def ue(v):
        n = (v + 1).bit_length()
        w.bits(v + 1, 2 * n - 1)

    for v, n in ((0, 4), (0, 3), (1, 1), (0, 3), (1, 5), (0x60000000, 32), (0x900000000000, 48), (93, 8)):
        w.bits(v, n)
    for v in (0, 1, 1920, 1088):
        ue(v)
    w.bits(1, 1)
    for v in (0, 0, 0, 4, 2):
        ue(v)
    raw, out, zeros = w.bytes(), bytearray(b"\x42\x01"), 0
    for b in raw:  # emulation prevention
        if zeros == 2 and b <= 3:
            out.append(3)
            zeros = 0
        out.append(b)
        zeros = zeros + 1 if b == 0 else 0
    s = H.hevc_sps(bytes(out))
    assert (s["width"], s["height"], s["level"], s["profile"], s["bit_depth"]) == (1920, 1080, 93, 1, 10)
    assert [k for *_, k in H.hevc_units(b"\0\0\1\x40\x01a\0\0\1" + bytes(out) + b"\0\0\1\x26\x01z")] == ["VPS", "SPS", "IDR"]


def test_data_source(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(wav()[0])
    (tmp_path / "bad.wav").write_bytes(b"RIFFxxxxWAVE")
    register(spark)
    p = spark.read.format("media").load(str(tmp_path))
    assert p.where("status = 'ok'").count() == 3 and p.where("status = 'error'").count() == 1
    s = spark.read.format("media").option("relation", "streams").load(str(tmp_path)).where("status = 'ok'").first()
    assert (s.codec, s.rate, s.duration) == ("pcm_s16le", 44100, 10_000)


def test_cue_sheet_meets_its_audio(spark):
    text = 'PERFORMER "B"\nFILE "a.wav" WAVE\n  TRACK 01 AUDIO\n    TITLE "x"\n    INDEX 01 00:00:00\n  TRACK 02 AUDIO\n    INDEX 00 00:00:01\n    INDEX 01 00:00:06\n  TRACK 03 AUDIO\n    TITLE "no index"\n'
    media = M.memory(spark, {"d/s.cue": text.encode("utf-16"), "d/a.wav": wav()[0]})
    got = sorted((r.idx, r.track, r.title, r.performer, round(r.start, 6), round(r.end, 6), r.rate) for r in sheets.read_cues(media).collect())
    assert got == [(0, 1, "x", "B", 0.0, 0.08, 44100), (1, 2, None, "B", 0.08, round(10_000 / 44100, 6), 44100)]
    chapters = spark.createDataFrame([("f", 0.0), ("f", 60.0), ("f", 120.0)], "path string, start double")
    assert [sheets.previous_chapter(chapters, t).first().target for t in (61.0, 65.0, 1.0)] == [0.0, 60.0, 0.0]
    assert sheets.next_chapter(chapters, 61.0).first().target == 120.0


def test_planes_and_dump(spark):
    rng = np.random.default_rng(1)
    planes = [rng.integers(0, 256, s, dtype=np.uint8) for s in (48, 12, 12)]
    df = spark.createDataFrame([("a", i, 8, 6, [bytearray(p.tobytes()) for p in planes]) for i in range(12)], "path string, frame_no long, width int, height int, planes array<binary>")
    small = K.map_planes(df, "yuv420p", lambda x: K.scale_planes(x, "yuv420p", 4, 4, "area")).first()
    assert (small.width, small.height, [len(p) for p in small.planes]) == (4, 4, [16, 4, 4])
    assert len(sheets.raw_dump(df).first().content) == 10 * 72


@pytest.mark.parametrize("method", sorted(K.SCALERS))
def test_uniform_frames_stay_uniform(method):
    x = np.full((1, 9, 7, 3), 93, np.uint8)
    for w, h in ((3, 4), (20, 15), (7, 9)):
        assert (K.SCALERS[method](x, w, h) == 93).all()


def test_conversions_keep_shapes():
    rng = np.random.default_rng(2)
    for a, b in K.CONVERSIONS:
        planes = [rng.integers(0, 256, (2, *K.plane_shape(a, 8, 6, p)), dtype=np.uint8) for p in range(K.FORMATS[a][3])]
        out = K.convert_planes(planes, a, b)
        assert [p.shape[1:] for p in out] == [K.plane_shape(b, 8, 6, p) for p in range(K.FORMATS[b][3])]
    with pytest.raises(ValueError):
        K.convert_planes(planes, "gray8", "nv12")


def test_probed_files_hold_whole_texts(spark, sf):
    from pyspark.sql import functions as F

    from reelframe.plans.probe_queries import HEADS, _media

    texts = {f"{r.doc_id}.bin": HEADS[r.doc_id % 8] + r.text for r in spark.read.parquet(f"{sf}/documents.parquet").where(F.length("text") > 200).collect()}
    got = {r.path: bytes(r.content) for r in _media(spark, sf).collect()}
    assert texts and all(got[p] == t.encode() for p, t in texts.items())
