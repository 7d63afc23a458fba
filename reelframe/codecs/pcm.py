"""PCM and raw video: packet bytes to samples or planes and back."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.video import FORMATS, plane_shape

#: Codec -> (bytes a sample, NumPy type; None: 24 bits).
CODECS = {
    "pcm_u8": (1, "u1"), "pcm_s16le": (2, "<i2"), "pcm_s16be": (2, ">i2"), "pcm_s24le": (3, None), "pcm_s24be": (3, None), "pcm_s32le": (4, "<i4"),
    "pcm_s32be": (4, ">i4"), "pcm_f32le": (4, "<f4"), "pcm_f32be": (4, ">f4"),
}


def decode(data: bytes, codec: str, channels: int = 1) -> np.ndarray:
    """Samples (n, channels); 24-bit ones are sign-extended, not shifted. ValueError for a broken block."""
    size, kind = CODECS[codec]
    if len(data) % (size * channels):
        raise ValueError("the packet isn't a whole number of blocks")
    if kind:
        return np.frombuffer(data, kind).reshape(-1, channels)
    b = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int32)[:, :: -1 if codec.endswith("be") else 1]
    v = b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16
    return (v - ((v >> 23) << 24)).reshape(-1, channels)


def encode(samples: np.ndarray, codec: str) -> bytes:
    """Bytes of samples; 24 bits drop the top byte of 32."""
    kind = CODECS[codec][1]
    if kind:
        return np.ascontiguousarray(samples).astype(kind).tobytes()
    low = np.ascontiguousarray(samples).astype("<i4").view(np.uint8).reshape(-1, 4)[:, :3]
    return (low[:, ::-1] if codec.endswith("be") else low).tobytes()


def sign_extended(raw: Column, bits: int) -> Column:
    """An unsigned number of so many bits as the signed one, as a column."""
    return F.when(raw >= 1 << (bits - 1), raw - (1 << bits)).otherwise(raw)


def decode_raw(data: bytes, fmt: str, width: int, height: int) -> list[np.ndarray]:
    out, at = [], 0
    for p in range(FORMATS[fmt][3]):
        shape = plane_shape(fmt, width, height, p)
        n = int(np.prod(shape))
        if at + n > len(data):
            raise ValueError("the packet is too short")
        out.append(np.frombuffer(data, np.uint8, n, at).reshape(shape))
        at += n
    return out


def encode_raw(planes: list[np.ndarray]) -> bytes:
    """Planes without padding between rows."""
    return b"".join(np.ascontiguousarray(p).tobytes() for p in planes)
