"""Bits and bytes: readers, checksums, variable-length numbers, NAL units. Plain functions and pandas UDFs over them."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class BitReader:
    """Most significant bit first."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0
        self.size = 8 * len(data)

    def left(self) -> int:
        return self.size - self.at

    def bits(self, n: int) -> int:
        if n < 0 or self.at + n > self.size:
            raise EOFError
        first, last = self.at >> 3, (self.at + n + 7) >> 3
        value = int.from_bytes(self.data[first:last], "big") >> (8 * last - self.at - n)
        self.at += n
        return value & ((1 << n) - 1)

    def signed(self, n: int) -> int:
        v = self.bits(n)
        return v - (1 << n) if n and v >> (n - 1) else v

    def flag(self) -> bool:
        return self.bits(1) == 1

    def peek(self, n: int) -> int:
        at = self.at
        v = self.bits(n)
        self.at = at
        return v

    def skip(self, n: int) -> None:
        if self.at + n > self.size:
            raise EOFError
        self.at += n

    def align(self) -> None:
        self.at = (self.at + 7) & ~7

    def unary(self) -> int:
        """Zeros before the next one, which is read too."""
        n = 0
        while not self.bits(1):
            n += 1
        return n

    def ue(self) -> int:
        """Unsigned Exp-Golomb."""
        n = self.unary()
        return (1 << n) - 1 + self.bits(n)

    def se(self) -> int:
        """Signed Exp-Golomb: 0, 1, -1, 2, -2, .."""
        v = self.ue()
        return (v + 1) // 2 if v % 2 else -(v // 2)

    def utf8(self) -> int:
        """A number coded like a UTF-8 character of up to seven bytes."""
        first = self.bits(8)
        if first < 0x80:
            return first
        n = 0
        while first & (0x80 >> n):
            n += 1
        if not 2 <= n <= 7:
            raise ValueError("not a coded number")
        v = first & ((0x7F >> n) if n < 7 else 0)
        for _ in range(n - 1):
            b = self.bits(8)
            if b >> 6 != 2:
                raise ValueError("not a coded number")
            v = v << 6 | b & 0x3F
        return v


class ByteReader:
    """Typed reads of either byte order, one after the other; EOFError beyond the end."""

    def __init__(self, data: bytes, order: str = "little"):
        self.data, self.at, self.order = data, 0, order

    def bytes(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise EOFError
        self.at += n
        return self.data[self.at - n : self.at]

    def skip(self, n: int) -> None:
        self.bytes(n)

    def number(self, size: int, signed: bool = False) -> int:
        return int.from_bytes(self.bytes(size), self.order, signed=signed)

    def u8(self) -> int:
        return self.number(1)

    def u16(self) -> int:
        return self.number(2)

    def u24(self) -> int:
        return self.number(3)

    def u32(self) -> int:
        return self.number(4)

    def i16(self) -> int:
        return self.number(2, True)

    def i32(self) -> int:
        return self.number(4, True)

    def tag(self) -> str:
        return self.bytes(4).decode("latin-1")


def number_column(data: Column | str, at: int, size: int, order: str = "little", signed: bool = False) -> Column:
    """The number in `size` (up to 7) bytes at a place of a binary column, in the JVM; null beyond the end."""
    c = F.col(data) if isinstance(data, str) else data
    part = F.substring(c, at + 1, size)
    digits = F.hex(part)
    if order == "little":
        digits = F.concat(*(F.substring(digits, 2 * k + 1, 2) for k in range(size - 1, -1, -1)))
    value = F.conv(digits, 16, 10).cast("long")
    value = F.when(value >= 1 << (8 * size - 1), value - (1 << 8 * size)).otherwise(value) if signed else value
    return F.when(F.length(c) >= at + size, value)


class BitWriter:
    """Most significant bit first."""

    def __init__(self):
        self.value, self.size = 0, 0

    def bits(self, v: int, n: int) -> None:
        self.value, self.size = self.value << n | v & ((1 << n) - 1), self.size + n

    def unary(self, n: int) -> None:
        self.bits(1, n + 1)

    def utf8(self, v: int) -> None:
        if v < 0x80:
            return self.bits(v, 8)
        n = next(k for k in range(2, 8) if v < 1 << (5 * k + 1))
        self.bits((0xFF << (8 - n)) & 0xFF | v >> (6 * (n - 1)), 8)
        for k in range(n - 2, -1, -1):
            self.bits(0x80 | v >> (6 * k) & 0x3F, 8)

    def align(self) -> None:
        self.bits(0, -self.size % 8)

    def bytes(self) -> bytes:
        pad = -self.size % 8
        return (self.value << pad).to_bytes((self.size + pad) // 8, "big")


def _crc_table(poly: int, width: int) -> list[int]:
    top, mask, out = 1 << (width - 1), (1 << width) - 1, []
    for b in range(256):
        v = b << (width - 8)
        for _ in range(8):
            v = (v << 1) ^ poly if v & top else v << 1
        out.append(v & mask)
    return out


_TABLES = {8: _crc_table(0x07, 8), 16: _crc_table(0x8005, 16), 32: _crc_table(0x04C11DB7, 32)}


def crc(data: bytes, width: int) -> int:
    """CRC without reflection, from 0: 8 bits (0x07), 16 bits (0x8005), 32 bits (0x04C11DB7, of Ogg pages)."""
    table, v, shift, mask = _TABLES[width], 0, width - 8, (1 << width) - 1
    for b in data:
        v = (v << 8 & mask) ^ table[v >> shift ^ b]
    return v


def crc_column(data: Column | str, width: int) -> Column:
    """The same as a column, by a pandas UDF."""
    @F.pandas_udf("long")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else crc(bytes(x), width)).astype("Int64")

    return run(data)


def crc_fold(codes: Column | str, width: int) -> Column:
    """The same on an array of byte values, without Python: a bitwise fold."""
    poly, top, mask = {8: 0x07, 16: 0x8005, 32: 0x04C11DB7}[width], 1 << (width - 1), (1 << width) - 1
    step = lambda v: F.when(v.bitwiseAND(F.lit(top)) != 0, F.shiftleft(v, 1).bitwiseXOR(F.lit(poly))).otherwise(F.shiftleft(v, 1)).bitwiseAND(F.lit(mask))
    byte = lambda a, b: F.aggregate(F.sequence(F.lit(1), F.lit(8)), a.bitwiseXOR(F.shiftleft(b.cast("long"), width - 8)), lambda v, _: step(v))
    return F.aggregate(codes, F.lit(0).cast("long"), byte)


def ebml_size(data: bytes, at: int = 0) -> tuple[int | None, int]:
    """(value, bytes read) of an EBML variable-size number; all value bits set is unknown (None)."""
    first = data[at]
    if not first:
        raise ValueError("an EBML number of more than eight bytes")
    n = 9 - first.bit_length()
    if at + n > len(data):
        raise EOFError
    v = int.from_bytes(data[at : at + n], "big") & ((1 << 7 * n) - 1)
    return (None if v == (1 << 7 * n) - 1 else v), n


def ebml_coded(v: int) -> bytes:
    n = next(k for k in range(1, 9) if v < (1 << 7 * k) - 1)
    return (v | 1 << 7 * n).to_bytes(n, "big")


def extended_double(data: bytes) -> float:
    """An 80-bit IEEE number as a double."""
    head, mantissa = struct.unpack(">HQ", data)
    exponent = head & 0x7FFF
    if not exponent and not mantissa:
        return 0.0
    value = float("inf") if exponent == 0x7FFF else float(mantissa) * 2.0 ** (exponent - 16383 - 63)
    return -value if head >> 15 else value


def extended_bytes(x: float) -> bytes:
    if not x:
        return bytes(10)
    m, e = np.frexp(abs(x))
    return struct.pack(">HQ", (0x8000 if x < 0 else 0) | int(e) + 16382, int(m * 2.0**64))


def unescape_nal(data: bytes) -> bytes:
    """Without emulation prevention: 00 00 03 is 00 00, left to right."""
    return data.replace(b"\0\0\3", b"\0\0")


def split_annexb(data: bytes) -> list[bytes]:
    """NAL units between start codes (00 00 01), trailing zero bytes cut off."""
    return [u for u in (p.rstrip(b"\0") for p in data.split(b"\0\0\1")[1:]) if u]


def annexb_to_sized(data: bytes, size: int = 4) -> bytes:
    return b"".join(len(u).to_bytes(size, "big") + u for u in split_annexb(data))


def sized_to_units(data: bytes, size: int = 4) -> list[bytes]:
    out, at = [], 0
    while at + size <= len(data):
        n = int.from_bytes(data[at : at + size], "big")
        out.append(data[at + size : at + size + n])
        at += size + n
    return out


def nal_rows(data: bytes) -> list[tuple[int, int, int, bytes]]:
    """(number, type, reference idc, payload) of each H.264 NAL unit of an Annex B stream."""
    return [(i, u[0] & 31, u[0] >> 5 & 3, u[1:]) for i, u in enumerate(split_annexb(data))]


_HIGH_PROFILES = frozenset((100, 110, 122, 244, 44, 83, 86, 118, 128))


def _skip_scaling_list(r: BitReader, size: int) -> None:
    last = following = 8
    for _ in range(size):
        if following:
            following = (last + r.se()) % 256
        last = following or last


def parse_h264_sps(unit: bytes) -> dict:
    """Profile, level and picture size of an H.264 sequence parameter set (with its NAL header byte)."""
    r = BitReader(unescape_nal(unit[1:]))
    profile, constraints, level = r.bits(8), r.bits(8), r.bits(8)
    sps_id, chroma = r.ue(), 1
    depth = 8
    if profile in _HIGH_PROFILES:
        chroma = r.ue()
        if chroma == 3:
            r.skip(1)
        depth = 8 + r.ue()
        r.ue()
        r.skip(1)
        if r.flag():
            for i in range(12 if chroma == 3 else 8):
                if r.flag():
                    _skip_scaling_list(r, 16 if i < 6 else 64)
    r.ue()
    order = r.ue()
    if order == 0:
        r.ue()
    elif order == 1:
        r.skip(1)
        r.se()
        r.se()
        for _ in range(r.ue()):
            r.se()
    refs = r.ue()
    r.skip(1)
    width, rows = 16 * (r.ue() + 1), r.ue() + 1
    frames_only = r.flag()
    height = 16 * rows * (1 if frames_only else 2)
    if not frames_only:
        r.skip(1)
    r.skip(1)
    if r.flag():
        left, right, top, bottom = (r.ue() for _ in range(4))
        sx = 2 if chroma in (1, 2) else 1
        sy = (2 if chroma == 1 else 1) * (1 if frames_only else 2)
        width, height = width - sx * (left + right), height - sy * (top + bottom)
    return {"sps_id": sps_id, "profile": profile, "constraints": constraints, "level": level, "chroma_format": chroma, "bit_depth": depth, "ref_frames": refs, "width": width, "height": height, "frames_only": frames_only}


def build_avcc(sps: bytes, pps: bytes) -> bytes:
    return bytes([1, sps[1], sps[2], sps[3], 0xFF, 0xE1]) + struct.pack(">H", len(sps)) + sps + b"\1" + struct.pack(">H", len(pps)) + pps


def parse_avcc(data: bytes) -> dict:
    """length_size, sps and pps lists of an avcC record."""
    if len(data) < 7 or data[0] != 1:
        raise ValueError("not an avcC record")
    at, found = 6, {"length_size": (data[4] & 3) + 1, "sps": [], "pps": []}
    for key, count in (("sps", data[5] & 31), ("pps", None)):
        if count is None:
            count, at = data[at], at + 1
        for _ in range(count):
            n = int.from_bytes(data[at : at + 2], "big")
            found[key].append(data[at + 2 : at + 2 + n])
            at += 2 + n
    return found


def rice_fold(x: Column) -> Column:
    """Signed to unsigned: 0, -1, 1, -2, .. as 0, 1, 2, 3, .."""
    return F.when(x >= 0, x * 2).otherwise(-2 * x - 1)


def rice_unfold(x: Column) -> Column:
    return F.when(x % 2 == 0, F.shiftright(x, 1)).otherwise(-F.shiftright(x + 1, 1))
