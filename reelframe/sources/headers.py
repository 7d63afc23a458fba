"""Headers of audio frames."""

from __future__ import annotations

#: Kilobits a second by index, of MPEG-1 layers 1 to 3 and of the lower rates; sample rates.
_V1 = {
    1: (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    2: (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    3: (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
}
_LOW = (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)
_RATES = (44100, 48000, 32000)
ADTS_RATES = (96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000, 7350)


def mp3_header(data: bytes, at: int = 0) -> dict | None:
    """Size, rate, channels and samples of the MPEG audio frame at a place, or None."""
    if at + 4 > len(data):
        return None
    h = int.from_bytes(data[at : at + 4], "big")
    version, layer, kind, rate = h >> 19 & 3, 4 - (h >> 17 & 3), h >> 12 & 15, h >> 10 & 3
    if h >> 21 != 0x7FF or version == 1 or layer == 4 or kind in (0, 15) or rate == 3:
        return None
    first = version == 3
    kbps = _V1[layer][kind] if first else _V1[2][kind] if layer == 1 else _LOW[kind]
    hz, pad = _RATES[rate] >> {3: 0, 2: 1, 0: 2}[version], h >> 9 & 1
    size = (12 * kbps * 1000 // hz + pad) * 4 if layer == 1 else (144 if first else 72) * kbps * 1000 // hz + pad
    samples = 384 if layer == 1 else 576 if layer == 3 and not first else 1152
    mono = h >> 6 & 3 == 3
    return {"size": size, "rate": hz, "channels": 1 if mono else 2, "samples": samples, "kbps": kbps, "layer": layer, "mpeg1": first} if size >= 4 else None


def adts_header(data: bytes, at: int = 0) -> dict | None:
    """Size, head, rate and channels of the ADTS frame at a place, or None."""
    if at + 7 > len(data) or data[at] != 0xFF or data[at + 1] & 0xF6 != 0xF0:
        return None
    rate = data[at + 2] >> 2 & 15
    size = (data[at + 3] & 3) << 11 | data[at + 4] << 3 | data[at + 5] >> 5
    if rate >= len(ADTS_RATES) or size < 7:
        return None
    return {"size": size, "head": 7 if data[at + 1] & 1 else 9, "rate": ADTS_RATES[rate], "rate_index": rate, "profile": data[at + 2] >> 6, "channels": (data[at + 2] & 1) << 2 | data[at + 3] >> 6, "samples": 1024 * ((data[at + 6] & 3) + 1)}


def adts_bytes(size: int, rate: int, channels: int, profile: int = 1) -> bytes:
    """A seven-byte ADTS header for a payload of `size` bytes."""
    n, r = size + 7, ADTS_RATES.index(rate)
    return bytes([0xFF, 0xF1, profile << 6 | r << 2 | channels >> 2, (channels & 3) << 6 | n >> 11, n >> 3 & 0xFF, (n & 7) << 5 | 0x1F, 0xFC])
