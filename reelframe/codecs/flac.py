"""FLAC: frames decoded with every subframe kind; encoded by the best fixed predictor. Lossless both ways."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.bits import BitReader, BitWriter, crc

BLOCK = 4096
#: Fixed values of the frame header.
_RATES = {1: 88200, 2: 176400, 3: 192000, 4: 8000, 5: 16000, 6: 22050, 7: 24000, 8: 32000, 9: 44100, 10: 48000, 11: 96000}
_BITS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}


def frame_header(data: bytes, at: int, info: dict | None = None) -> dict | None:
    """The frame header at a place, checked by its CRC-8; info gives what it leaves to the stream's header."""
    if at + 5 > len(data) or data[at] != 0xFF or data[at + 1] & 0xFC != 0xF8:
        return None
    r = BitReader(data[at : at + 32])
    r.skip(15)
    try:
        variable, size, rate, channels, bits = r.bits(1), r.bits(4), r.bits(4), r.bits(4), r.bits(3)
        if r.bits(1) or not size or rate == 15 or channels > 10:
            return None
        number = r.utf8()
        block = 192 if size == 1 else 576 << (size - 2) if size <= 5 else r.bits(8) + 1 if size == 6 else r.bits(16) + 1 if size == 7 else 256 << (size - 8)
        hz = r.bits(8) * 1000 if rate == 12 else r.bits(16) if rate == 13 else r.bits(16) * 10 if rate == 14 else _RATES.get(rate) or (info or {}).get("rate", 0)
        end = r.at // 8
        if crc(data[at : at + end], 8) != r.bits(8):
            return None
    except (EOFError, ValueError):
        return None
    depth = _BITS.get(bits) or (info or {}).get("bits", 0)
    if not depth:
        return None
    return {"variable": bool(variable), "number": number, "block": block, "rate": hz, "mode": channels, "channels": 2 if channels >= 8 else channels + 1, "bits": depth, "size": end + 1}


def _rice(r: BitReader, order: int, block: int) -> list[int]:
    wide = r.bits(2)
    if wide > 1:
        raise ValueError("reserved residual coding")
    width, parts = 5 if wide else 4, r.bits(4)
    out: list[int] = []
    for p in range(1 << parts):
        n = (block >> parts) - (order if p == 0 else 0)
        k = r.bits(width)
        if k == (1 << width) - 1:
            size = r.bits(5)
            out += [r.signed(size) if size else 0 for _ in range(n)]
        else:
            for _ in range(n):
                v = r.unary() << k | r.bits(k)
                out.append(v >> 1 ^ -(v & 1))
    return out


def _predict(warm: list[int], residual: list[int], weights: list[int], shift: int) -> list[int]:
    out, n = warm[:], len(weights)
    for e in residual:
        out.append(e + (sum(w * x for w, x in zip(weights, out[: -n - 1 : -1], strict=True)) >> shift) if n else e)
    return out


#: Weights of the fixed predictors, newest sample first.
_FIXED = ([], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1])


def _subframe(r: BitReader, block: int, bits: int) -> np.ndarray:
    if r.bits(1):
        raise ValueError("a set padding bit")
    kind, waste = r.bits(6), 0
    if r.bits(1):
        waste = r.unary() + 1
        bits -= waste
    if kind == 0:
        out = [r.signed(bits)] * block
    elif kind == 1:
        out = [r.signed(bits) for _ in range(block)]
    elif 8 <= kind <= 12:
        order = kind - 8
        warm = [r.signed(bits) for _ in range(order)]
        out = _predict(warm, _rice(r, order, block), _FIXED[order], 0)
    elif kind >= 32:
        order = kind - 31
        warm = [r.signed(bits) for _ in range(order)]
        precision, shift = r.bits(4) + 1, r.signed(5)
        weights = [r.signed(precision) for _ in range(order)]
        out = _predict(warm, _rice(r, order, block), weights, shift)
    else:
        raise ValueError("reserved subframe")
    return np.array(out, np.int64) << waste


def decode_frame(data: bytes, info: dict | None = None) -> tuple[dict, np.ndarray]:
    """(header, samples (block, channels)) of one whole frame; both checksums must hold."""
    h = frame_header(data, 0, info)
    if h is None:
        raise ValueError("not a FLAC frame")
    r = BitReader(data)
    r.skip(8 * h["size"])
    mode = h["mode"]
    side = {8: 1, 9: 0, 10: 1}.get(mode)
    ch = [_subframe(r, h["block"], h["bits"] + (c == side)) for c in range(h["channels"])]
    r.align()
    end = r.at // 8
    if crc(data[:end], 16) != r.bits(16):
        raise ValueError("wrong frame checksum")
    if mode == 8:
        ch[1] = ch[0] - ch[1]
    elif mode == 9:
        ch[0] = ch[0] + ch[1]
    elif mode == 10:
        mid = ch[0] * 2 + (ch[1] & 1)
        ch = [(mid + ch[1]) >> 1, (mid - ch[1]) >> 1]
    return h, np.stack(ch, 1)


def residuals(x: np.ndarray, order: int) -> np.ndarray:
    """Finite differences of the samples."""
    return np.diff(np.asarray(x, np.int64), order)


def residual_column(samples: Column | str, order: int) -> Column:
    """The same of an array column: one difference after the other, in the JVM."""
    c = F.col(samples) if isinstance(samples, str) else samples
    for _ in range(order):
        n = F.greatest(F.size(c) - 1, F.lit(0))
        c = F.zip_with(F.slice(c, 2, n), F.slice(c, 1, n), lambda b, a: b - a)
    return c


def rice_parameter(e: np.ndarray) -> int:
    mean = float(np.abs(e).mean()) if len(e) else 0.0
    return max(0, min(14, int(mean).bit_length()))


def rice_bits(e: np.ndarray, k: int) -> int:
    folded = np.where(e >= 0, 2 * e, -2 * e - 1)
    return int((folded >> k).sum() + len(e) * (k + 1))


def best_order(x: np.ndarray) -> tuple[int, int]:
    """(order, bits) of the fixed predictor that needs the fewest Rice bits; ties take the lowest order."""
    costs = []
    for order in range(min(4, len(x) - 1) + 1):
        e = residuals(x, order)
        costs.append((rice_bits(e, rice_parameter(e)), order))
    bits, order = min(costs)
    return order, bits


def encode_frame(samples: np.ndarray, number: int, bits: int) -> bytes:
    """One frame of (block, channels) samples, its channels coded independently."""
    block, channels = samples.shape
    w = BitWriter()
    w.bits(0b11111111111110, 14)
    w.bits(0, 2)
    w.bits(7, 4)
    w.bits(0, 4)  # the rate is the stream's
    w.bits(channels - 1, 4)
    w.bits({v: k for k, v in _BITS.items()}[bits], 3)
    w.bits(0, 1)
    w.utf8(number)
    w.bits(block - 1, 16)
    w.bits(crc(w.bytes(), 8), 8)
    head = w.bytes()
    body = BitWriter()
    for x in np.asarray(samples, np.int64).T:
        if (x == x[0]).all():
            body.bits(0, 8)
            body.bits(int(x[0]), bits)
            continue
        order, cost = best_order(x)
        if cost + 100 >= block * bits:
            body.bits(1 << 1, 8)
            for v in x.tolist():
                body.bits(v, bits)
            continue
        e = residuals(x, order)
        k = rice_parameter(e)
        body.bits((8 + order) << 1, 8)
        for v in x[:order].tolist():
            body.bits(v, bits)
        body.bits(0, 6)  # four-bit parameters, one partition
        body.bits(k, 4)
        part = BitWriter()  # flushed now and then, so that no number gets long
        for v in np.where(e >= 0, 2 * e, -2 * e - 1).tolist():
            part.unary(v >> k)
            part.bits(v, k)
            if part.size > 4096:
                body.bits(part.value, part.size)
                part = BitWriter()
        body.bits(part.value, part.size)
    frame = head + body.bytes()
    return frame + crc(frame, 16).to_bytes(2, "big")


def stream_header(rate: int, channels: int, bits: int, total: int, sizes: list[int], block: int = BLOCK) -> bytes:
    """The magic and STREAMINFO; the checksum of the samples stays zero."""
    w = BitWriter()
    for v, n in ((block, 16), (block, 16), (min(sizes, default=0), 24), (max(sizes, default=0), 24), (rate, 20), (channels - 1, 3), (bits - 1, 5), (total, 36)):
        w.bits(v, n)
    return b"fLaC\x80\x00\x00\x22" + w.bytes() + bytes(16)
