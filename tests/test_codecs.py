import numpy as np
import pytest

from reelframe.codecs import flac, pcm
from reelframe.functions import bits as B

RNG = np.random.default_rng(0)


@pytest.mark.parametrize("codec", sorted(pcm.CODECS))
def test_pcm_round_trip(codec):
    size, kind = pcm.CODECS[codec]
    x = RNG.integers(-(1 << 23), 1 << 23, (50, 2)) if kind is None else RNG.integers(0, 256, 100 * size, dtype=np.uint8).view(kind).reshape(50, 2)
    y = pcm.decode(pcm.encode(x, codec), codec, 2)
    assert np.array_equal(x, y, equal_nan=codec.startswith("pcm_f32"))
    with pytest.raises(ValueError):
        pcm.decode(b"123", "pcm_s16le", 1)


def test_raw_video_round_trip():
    data = RNG.integers(0, 256, 5 * 3 + 2 * 3 * 2, dtype=np.uint8).tobytes()
    assert pcm.encode_raw(pcm.decode_raw(data, "yuv420p", 5, 3)) == data


@pytest.mark.parametrize("bits", [8, 16, 24])
@pytest.mark.parametrize("kind", ["zero", "sine", "noise", "saw"])
def test_flac_round_trip(bits, kind):
    n, top = 777, 1 << (bits - 1)
    t = np.arange(n)
    mono = {"zero": t * 0, "sine": (np.sin(t / 9) * top * 0.7).astype(int), "noise": RNG.integers(-top, top, n), "saw": t * 3 % (top // 2)}[kind]
    x = np.stack([mono, mono[::-1]], 1)
    data = flac.encode_frame(x, 3000, bits)
    h, y = flac.decode_frame(data)
    assert (h["number"], h["block"], h["channels"], h["bits"]) == (3000, n, 2, bits) and np.array_equal(x, y)
    broken = bytearray(data)
    broken[len(data) // 2] ^= 4
    with pytest.raises((ValueError, EOFError)):
        flac.decode_frame(bytes(broken))
    if kind == "sine" and bits == 16:
        assert len(data) < 0.8 * x.size * 2


def test_stereo_decorrelation_and_lpc():
    left, right = RNG.integers(-900, 900, 16), RNG.integers(-900, 900, 16)
    for mode, pair in ((8, (left, left - right)), (9, (left - right, right)), (10, ((left + right) >> 1, left - right))):
        w = B.BitWriter()
        for v, n in ((0b11111111111110, 14), (0, 2), (6, 4), (9, 4), (mode, 4), (4, 3), (0, 1), (0, 8), (15, 8)):
            w.bits(v, n)
        w.bits(B.crc(w.bytes(), 8), 8)
        for c, x in enumerate(pair):
            wide = 16 + (c == {8: 1, 9: 0, 10: 1}[mode])
            e = [int(x[i]) - ((2 * int(x[i - 1]) - int(x[i - 2])) >> 0) for i in range(2, 16)]
            for v, n in ((0, 1), (33, 6), (0, 1), (int(x[0]), wide), (int(x[1]), wide), (3, 4), (0, 5), (2, 4), (-1, 4), (0, 2), (0, 4), (15, 4), (20, 5)):
                w.bits(v, n)
            for v in e:
                w.bits(v, 20)
        w.align()
        data = w.bytes()
        _, y = flac.decode_frame(data + B.crc(data, 16).to_bytes(2, "big"))
        assert np.array_equal(y, np.stack([left, right], 1))


def test_bits():
    w = B.BitWriter()
    for v, n in ((5, 3), (0, 1), (1023, 10), (2**40 + 7, 44)):
        w.bits(v, n)
    r = B.BitReader(w.bytes())
    assert [r.bits(n) for n in (3, 1, 10, 44)] == [5, 0, 1023, 2**40 + 7]
    for v in (0, 127, 128, 2047, 2048, 65535, 2**20, 2**31 - 1, 2**36 - 1):
        w = B.BitWriter()
        w.utf8(v)
        assert B.BitReader(w.bytes()).utf8() == v
    r = B.BitReader(bytes([0b10100110, 0b01000010, 0b10000000]))
    assert [r.ue() for _ in range(4)] == [0, 1, 2, 3] and B.BitReader(bytes([0b01001101])).se() == 1
    assert B.BitReader(b"\xff").signed(4) == -1
    with pytest.raises(EOFError):
        B.BitReader(b"a").bits(9)


def test_checksums():
    assert (B.crc(b"123456789", 8), B.crc(b"123456789", 16), B.crc(b"123456789", 32)) == (0xF4, 0xFEE8, 0x89A1897F)


def test_numbers():
    for v in (0, 1, 126, 127, 16382, 2**40):
        assert B.ebml_size(B.ebml_coded(v)) == (v, len(B.ebml_coded(v)))
    assert B.ebml_size(b"\xff") == (None, 1)
    for x in (0.0, 1.0, -1.5, 44100.0, 96000.0, 1e-9):
        assert B.extended_double(B.extended_bytes(x)) == x


def test_nal_units():
    stream = b"\0\0\0\1\x67ab\0\0\0\1\x68c\0\0\1\x65\0\0\3\1d\0"
    assert B.split_annexb(stream) == [b"\x67ab", b"\x68c", b"\x65\0\0\3\1d"]
    assert B.sized_to_units(B.annexb_to_sized(stream)) == B.split_annexb(stream)
    assert B.unescape_nal(b"\0\0\3\1\0\0\3\0\0\3") == b"\0\0\1\0\0\0\0"
    assert [t for _, t, _, _ in B.nal_rows(stream)] == [7, 8, 5]
    assert B.parse_avcc(B.build_avcc(b"\x67abcd", b"\x68e")) == {"length_size": 4, "sps": [b"\x67abcd"], "pps": [b"\x68e"]}


def test_sps():
    w = B.BitWriter()

    def ue(v):
        n = (v + 1).bit_length()
        w.bits(v + 1, 2 * n - 1)

    w.bits(66, 8), w.bits(0, 8), w.bits(30, 8)
    for v in (0, 0, 2, 1):  # id, frame number bits, order type 2, references
        ue(v)
    w.bits(0, 1)
    ue(119), ue(67)
    w.bits(1, 1), w.bits(1, 1), w.bits(1, 1)
    for v in (0, 0, 0, 4):
        ue(v)
    w.bits(0, 1), w.bits(1, 1)
    s = B.parse_h264_sps(b"\x67" + w.bytes())
    assert (s["width"], s["height"], s["profile"], s["level"]) == (1920, 1080, 66, 30)
