"""Streams made by hand: a writer of headers and packets, and a decoder of plain sums to compare with."""

import math
import random

import numpy as np
import pytest

from reelframe.codecs import vorbis as W
from reelframe.plans.pipeline import Transcode
from reelframe.sources import containers as C
from reelframe.sources import media as M

RANGES = (256, 128, 86, 64)


class Bits:
    def __init__(self):
        self.value = self.size = 0

    def put(self, v, n):
        self.value |= (v & ((1 << n) - 1)) << self.size
        self.size += n

    def bytes(self):
        return self.value.to_bytes((self.size + 7) // 8, "little")


def float32(x):
    """A number of few bits in the headers' own float form."""
    if not x:
        return 0
    sign, x, e = (1 << 31 if x < 0 else 0), abs(x), 788
    while x != int(x):
        x, e = x * 2, e - 1
    return sign | e << 21 | int(x)


def book(w, dims, lengths, lookup=None, ordered=False):
    w.put(0x564342, 24)
    w.put(dims, 16)
    w.put(len(lengths), 24)
    w.put(int(ordered), 1)
    if ordered:
        w.put(lengths[0] - 1, 5)
        at = 0
        for n in range(lengths[0], lengths[-1] + 1):
            w.put(lengths.count(n), (len(lengths) - at).bit_length())
            at += lengths.count(n)
    else:
        w.put(1, 1)
        for n in lengths:
            w.put(1 if n else 0, 1)
            if n:
                w.put(n - 1, 5)
    kind, low, step, values, sums = lookup or (0, 0, 0, [], 0)
    w.put(kind, 4)
    if kind:
        w.put(float32(low), 32)
        w.put(float32(step), 32)
        w.put(3, 4)
        w.put(sums, 1)
        for v in values:
            w.put(v, 4)


#: Words of five entries of lengths 1, 3, 3, 3, 3: 0, 100, 101, 110, 111; of eight of length 3; of sixteen of length 4.
UNEVEN = [1, 3, 3, 3, 3]
UNEVEN_WORDS = ["0", "100", "101", "110", "111"]
GRID = [-1.5, -0.5, 0.5, 1.5]


def word(w, bits):
    for b in bits:
        w.put(int(b), 1)


def headers(channels, kind):
    a = Bits()
    a.put(0, 32)
    a.put(channels, 8)
    a.put(8000, 32)
    a.put(0, 96)
    a.put(6, 4)
    a.put(8, 4)
    a.put(1, 1)
    s = Bits()
    s.put(4, 8)  # five books
    book(s, 2, [2, 2, 2, 2])  # 0: groups of two parts: two groups each
    book(s, 2, [4] * 16, (1, -1.5, 1.0, [0, 1, 2, 3], 0))  # 1: pairs of the grid
    book(s, 1, [7] * 128, ordered=True)  # 2: floor values
    book(s, 1, UNEVEN)  # 3: the floor's master book
    book(s, 2, [3] * 8, (2, 0.25, 0.25, list(range(16)), 1))  # 4: listed vectors, sums along
    s.put(0, 6)
    s.put(0, 16)
    s.put(0, 6)  # one floor
    s.put(1, 16)
    s.put(2, 5)  # of two parts, of classes 0 and 1
    s.put(0, 4)
    s.put(1, 4)
    s.put(1, 3)  # class 0: two values, no choice of books
    s.put(0, 2)
    s.put(3, 8)
    s.put(1, 3)  # class 1: two values, a choice of two books by the master book
    s.put(1, 2)
    s.put(3, 8)
    s.put(3, 8)
    s.put(0, 8)
    s.put(1, 2)  # steps of two
    s.put(7, 4)  # places in seven bits
    for x in (40, 10, 90, 70):
        s.put(x, 7)
    s.put(0, 6)  # one residue
    s.put(kind, 16)
    s.put(0, 24)
    s.put(24 * channels if kind == 2 else 24, 24)
    s.put(3, 24)  # parts of four
    s.put(1, 6)  # two groups
    s.put(0, 8)
    for low, high in ((1, None), (3, None)):  # group 0: the first turn, group 1: two turns
        s.put(low, 3)
        s.put(0, 1)
    s.put(1, 8)
    s.put(1, 8)
    s.put(4, 8)
    s.put(0, 6)  # one mapping
    s.put(0, 16)
    s.put(0, 1)
    s.put(int(channels == 2), 1)
    if channels == 2:
        s.put(0, 8)
        s.put(0, 1)
        s.put(1, 1)
    s.put(0, 2)
    for v in (0, 0, 0):
        s.put(v, 8)
    s.put(1, 6)  # two modes, short and long
    for long in (0, 1):
        s.put(long, 1)
        s.put(0, 32)
        s.put(0, 8)
    s.put(1, 1)
    return [b"\x01vorbis" + a.bytes(), b"\x03vorbis" + bytes(8) + b"\1", b"\x05vorbis" + s.bytes()]


XS = [0, 128, 40, 10, 90, 70]


def point(x0, y0, x1, y1, x):
    off = abs(y1 - y0) * (x - x0) // (x1 - x0)
    return y0 - off if y1 < y0 else y0 + off


def plain_floor(y, n):
    """Point by point as the format's text says it, lines by their running error."""
    final, shown = y[:2], [True, True]
    for i in range(2, 6):
        a = max((j for j in range(i) if XS[j] < XS[i]), key=lambda j: XS[j])
        b = min((j for j in range(i) if XS[j] > XS[i]), key=lambda j: XS[j])
        guess = point(XS[a], final[a], XS[b], final[b], XS[i])
        high, low, v = 128 - guess, guess, y[i]
        room = 2 * min(high, low)
        if not v:
            final.append(guess)
            shown.append(False)
            continue
        shown[a] = shown[b] = True
        shown.append(True)
        if v >= room:
            final.append(v - low + guess if high > low else guess - v + high - 1)
        else:
            final.append(guess - (v + 1) // 2 if v % 2 else guess + v // 2)
    out = [0] * 4096
    at = sorted((XS[i], final[i] * 2) for i in range(6) if shown[i])
    for (x0, y0), (x1, y1) in zip(at, at[1:]):
        dy, adx = y1 - y0, x1 - x0
        base = int(dy / adx)
        err, yy, ady = 0, y0, abs(dy) - abs(base) * adx
        for x in range(x0, x1):
            out[x] = yy
            err += ady
            if err >= adx:
                err -= adx
                yy += base - 1 if dy < 0 else base + 1
            else:
                yy += base
    for x in range(at[-1][0], n):
        out[x] = at[-1][1]
    return np.array([1.0649863e-07 ** (1 - min(255, max(0, v)) / 255) for v in out[:n]])


def make_packet(rng, channels, kind, long, before, after):
    """(bytes, residues before coupling (channels, n / 2), floors) of a random packet."""
    w, half = Bits(), 128 if long else 32
    w.put(0, 1)
    w.put(long, 1)
    if long:
        w.put(before, 1)
        w.put(after, 1)
    floors = []
    for _ in range(channels):
        if rng.random() < 0.2:
            w.put(0, 1)
            floors.append(None)
            continue
        w.put(1, 1)
        y = [rng.randrange(128), rng.randrange(128)]
        for v in y:
            w.put(v, 7)
        for c in (0, 1):
            choice = 0
            if c:
                entry = rng.randrange(5)
                word(w, UNEVEN_WORDS[entry])
                choice = entry
            for _ in range(2):
                book_used = True if not c else bool(choice & 1 == 0)
                choice >>= 1
                v = rng.randrange(128) if book_used else 0
                if book_used:
                    word(w, format(v, "07b"))
                y.append(v)
        floors.append(y)
    silent = [f is None for f in floors]
    if channels == 2 and not all(silent):
        silent = [False, False]
    joint = kind == 2
    x = np.zeros((1, half * channels) if joint else (channels, half))
    live = [] if joint and all(silent) else [0] if joint else [c for c in range(channels) if not silent[c]]
    parts = min(24 * channels if joint else 24, x.shape[1]) // 4
    groups = {}
    for turn in range(8):
        for first in range(0, parts, 2):
            if not turn:
                for c in live:
                    e = rng.randrange(4)
                    word(w, format(e, "02b"))
                    groups[c, first], groups[c, first + 1] = e // 2, e % 2
            for k in range(first, min(first + 2, parts)):
                for c in live:
                    g = groups[c, k]
                    if turn > 1 or (turn == 1 and g == 0):
                        continue
                    for i in range(2):
                        if turn == 0:
                            e = rng.randrange(16)
                            word(w, format(e, "04b"))
                            v = [GRID[e % 4], GRID[e // 4]]
                        else:
                            e = rng.randrange(8)
                            word(w, format(e, "03b"))
                            a, b = 0.25 + 0.25 * (2 * e), 0.25 + 0.25 * (2 * e + 1)
                            v = [a, a + b]
                        for j in range(2):
                            x[c, 4 * k + (i + 2 * j if kind == 0 else 2 * i + j)] += v[j]
    if joint:
        x = np.array([[x[0, i * channels + c] for i in range(half)] for c in range(channels)])
    return w.bytes(), x, floors


def plain_decode(told, channels):
    """Samples by plain sums: coupling, floor, cosine sums, windows and overlap."""
    out, last = [], None
    for i, (long, x, floors) in enumerate(told):
        half = x.shape[1]
        n = 2 * half
        x = x.copy()
        if channels == 2:
            for k in range(half):
                m, a = x[0, k], x[1, k]
                if m > 0:
                    x[0, k], x[1, k] = (m, m - a) if a > 0 else (m + a, m)
                else:
                    x[0, k], x[1, k] = (m, m + a) if a > 0 else (m - a, m)
        for c in range(channels):
            x[c] = x[c] * plain_floor(floors[c], half) if floors[c] else 0 * x[c]
        t, k = np.arange(n)[:, None], np.arange(half)[None]
        y = x @ np.cos(np.pi / (2 * n) * (2 * t + 1 + half) * (2 * k + 1)).T
        sizes = [256 if told[j][0] else 64 for j in (i - 1 if i else i, min(i + 1, len(told) - 1))]
        win = np.ones(n)
        for side, other in enumerate(sizes):
            m = min(n, other) // 2
            rise = [math.sin(math.pi / 2 * math.sin((j + 0.5) / m * math.pi / 2) ** 2) for j in range(m)]
            edge = np.r_[np.zeros(n // 4 - m // 2), rise, np.ones(n // 4 - m // 2)]
            win[: half] = win[: half] * edge if side == 0 else win[: half]
            win[half:] = win[half:] * edge[::-1] if side == 1 else win[half:]
        y = y * win
        if last is not None:
            p, q = last.shape[1] // 4, n // 4
            whole = np.zeros((channels, p + q))
            for j in range(p + q):
                if j + 2 * p < 4 * p:
                    whole[:, j] += last[:, j + 2 * p]
                if j - p + q >= 0:
                    whole[:, j] += y[:, j - p + q]
            out.append(whole.T)
        last = y
    return out


@pytest.mark.parametrize("channels", [1, 2])
@pytest.mark.parametrize("kind", [0, 1, 2])
def test_packets_equal_plain_sums(channels, kind):
    rng = random.Random(channels * 10 + kind)
    longs = [rng.randrange(2) for _ in range(14)]
    told, packets = [], []
    for i, long in enumerate(longs):
        data, x, floors = make_packet(rng, channels, kind, long, longs[i - 1] if i else long, longs[min(i + 1, 13)])
        packets.append(data)
        told.append((long, x, floors))
    d = W.Decoder()
    for h in headers(channels, kind):
        assert len(d.decode(h)) == 0
    got = [d.decode(p) for p in packets]
    assert len(got[0]) == 0
    for a, b in zip(got[1:], plain_decode(told, channels), strict=True):
        assert a.shape == b.shape and np.allclose(a, b, rtol=1e-6, atol=1e-12)


def test_codewords():
    assert W._codewords([2, 4, 4, 4, 4, 2, 3, 3]) == {(2, 0): 0, (4, 4): 1, (4, 5): 2, (4, 6): 3, (4, 7): 4, (2, 2): 5, (3, 6): 6, (3, 7): 7}
    with pytest.raises(ValueError):
        W._codewords([1, 1, 1])


def test_broken_streams():
    with pytest.raises(ValueError):
        W.Decoder().decode(b"\0abc")
    with pytest.raises(ValueError):
        W.split_headers(b"\x01vorbis")
    d = W.Decoder()
    for h in headers(1, 1):
        d.decode(h)
    assert d.decode(b"\0").shape == (0, 1)  # an empty packet is silence
    with pytest.raises(ValueError):
        d.decode(b"\1")


def test_files_through_the_plan(spark):
    rng = random.Random(3)
    packets, told = [], []
    for _ in range(6):
        data, x, floors = make_packet(rng, 2, 2, 1, 1, 1)
        packets.append(data)
        told.append((1, x, floors))
    a, b, c = headers(2, 2)
    stream = C.Stream(0, "audio", "vorbis", (1, 8000), a, 8000, 2)
    parts = [C.Packet(0, 0, 0, b), C.Packet(0, 0, 0, c), *(C.Packet(0, 128 * i, 128 * i, p, 128) for i, p in enumerate(packets))]
    media = M.memory(spark, {"a.ogg": C.mux_ogg([stream], parts)})
    rows = Transcode(media, in_order=True).frames().orderBy("frame_no").collect()
    want = plain_decode(told, 2)
    assert [r.pts for r in rows] == [128 * i for i in range(5)] and all(r.rate == 8000 for r in rows)
    for r, x in zip(rows, want, strict=True):
        assert np.allclose(np.array(r.samples).reshape(-1, 2), x, rtol=1e-6, atol=1e-12)
    broken = M.packets(media).selectExpr("path", "stream_index", "seq", "data", "status")
    heads = M.streams(media).selectExpr("path", "index", "codec", "substring(extra, 1, 40) AS extra", "rate", "channels", "bits", "status")
    assert [r.status for r in M.decode_in_order(broken, heads).collect()] == ["error"]
