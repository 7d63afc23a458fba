"""Format detection: every format scores the head of a file and its name, the best score wins, ties go to the first."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import EXTENSIONS
from .headers import adts_header, mp3_header

WINDOW = 256 * 1024
#: Scores of a matching extension, of a likely and of a certain magic.
EXTENSION, LIKELY, CERTAIN = 50, 75, 100


def _syncsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def after_id3(data: bytes) -> int:
    return 10 + _syncsafe(data[6:10]) if len(data) >= 10 and data[:3] == b"ID3" else 0


def _wav(d, ext):
    return CERTAIN if d[:4] == b"RIFF" and d[8:12] == b"WAVE" else 0


def _aiff(d, ext):
    return CERTAIN if d[:4] == b"FORM" and d[8:12] in (b"AIFF", b"AIFC") else 0


def _cue(d, ext):
    if ext == "cue":
        return EXTENSION  # the name is asked first
    text = d.decode("utf-8", "replace")
    return CERTAIN if "FILE" in text and "TRACK" in text else 0


def _flac(d, ext):
    return CERTAIN if d[:4] == b"fLaC" else 0


def _ogg(d, ext):
    at = after_id3(d)
    return CERTAIN if d[:4] == b"OggS" else 98 if at and d[at : at + 4] == b"OggS" else 0


def _mp4(d, ext):
    return CERTAIN if d[4:8] == b"ftyp" else LIKELY if d[4:8] in (b"moov", b"mdat", b"free", b"wide") else 0


def _mp3(d, ext):
    at = after_id3(d)
    while (at := d.find(b"\xff", at)) >= 0 and at + 4 <= len(d):
        h = mp3_header(d, at)
        if h and mp3_header(d, at + h["size"]):
            return 95
        at += 1
    return 0


def _mkv(d, ext):
    return CERTAIN if d[:4] == b"\x1aE\xdf\xa3" else 0


def _aac(d, ext):
    at = after_id3(d)
    h = adts_header(d, at)
    if not h:
        return 0
    after = d[at + h["size"] : at + h["size"] + 2]
    return CERTAIN if len(after) == 2 and after[0] == 0xFF and after[1] & 0xF0 == 0xF0 else 90


def _flv(d, ext):
    return CERTAIN if d[:4] == b"FLV\x01" else 0


def _ts(d, ext):
    if ext == "mp3" or len(d) < 2 * 188:
        return 0
    best = 0
    for at in range(min(len(d), 1024)):
        n = 0
        while n < 3 and at + 188 * (n + 1) <= len(d) and d[at + 188 * n] == 0x47:
            n += 1
        if n >= 2:
            best = CERTAIN if n == 3 else 90
            break
    return best


def _avi(d, ext):
    return CERTAIN if d[:4] == b"RIFF" and d[8:12] == b"AVI " else 0


def _m4v(d, ext):
    if d[:3] != b"\0\0\1" or len(d) < 4:
        return 0
    c = d[3]
    return {0xB0: 90, 0xB5: 80, 0xB3: 60, 0xB6: 50}.get(c, 70 if c <= 0x2F else 0)


def _h264(d, ext):
    n, at, end = 0, 0, min(len(d), 4096)
    while (at := d.find(b"\0\0\1", at, end)) >= 0 and at + 3 < len(d):
        c = d[at + 3]
        n += c < 0x80 and 1 <= c & 31 <= 13
        at += 3
    return CERTAIN if n >= 2 else 95 if n else 0


#: In the order of registration, which breaks ties.
PROBES = {"wav": _wav, "aiff": _aiff, "cue": _cue, "flac": _flac, "ogg": _ogg, "mp4": _mp4, "mp3": _mp3, "matroska": _mkv, "aac": _aac, "flv": _flv, "mpegts": _ts, "avi": _avi, "m4v": _m4v, "h264": _h264}
_NO_NAME = frozenset(("m4v",))


def probe_bytes(data: bytes, name: str | None = None) -> tuple[str | None, int]:
    """(format, score) of the head of a file; (None, 0) if nothing knows it or it has fewer than twelve bytes and no name."""
    ext = name.rsplit(".", 1)[-1].lower() if name else None
    best, top = None, 0
    for fmt, score in PROBES.items():
        s = score(data, ext)
        if not s and ext and fmt not in _NO_NAME and ext in EXTENSIONS[fmt] + (["webm"] if fmt == "matroska" else []) and not (fmt == "mpegts" and ext == "mp3"):
            s = EXTENSION
        if s > top:
            best, top = fmt, s
    return best, top


def probe(media: DataFrame, forced: str | None = None) -> DataFrame:
    """media (path, content) with format and score, from the first 256 KiB; a forced format skips probing.

    Only the head of each file goes to Python.
    """
    if forced:
        return media.select("path", F.lit(forced).alias("format"), F.lit(CERTAIN).alias("score"))

    def run(batches):
        for b in batches:
            found = [probe_bytes(d or b"", n) for n, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f for f, _ in found], pa.string()), pa.array([s for _, s in found], pa.int32())], names=["path", "format", "score"])

    return media.select("path", F.substring("content", 1, WINDOW).alias("head")).mapInArrow(run, "path string, format string, score int")
