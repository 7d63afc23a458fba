"""Secret scans: three base patterns, and encoded keys and signed tokens confirmed by their decoded structure."""

from __future__ import annotations

import base64
import binascii
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, strings_of

KINDS = ("assign", "access", "hex", "jwt", "der", "ssh")
BASE = KINDS[:3]

_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_DOTTED = re.compile(r"[A-Za-z0-9_-]++(?:\.[A-Za-z0-9_-]++)*+")
_RUN64 = re.compile(r"M[A-I][A-Za-z0-9+/]{38,}={0,2}")  # base64 of 0x30 and a length byte
_RUN16 = re.compile(r"30[0-9A-Fa-f]{78,}")
_SSH = re.compile(r"b3BlbnNzaC1rZXktdjEA[A-Za-z0-9+/\s]*={0,2}")  # base64 of "openssh-key-v1" and a zero byte
_PEM = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----([A-Za-z0-9+/=\s]+)-----END [A-Z0-9 ]*PRIVATE KEY-----")
_IN64, _IN16 = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"), frozenset("0123456789abcdefABCDEF")


def _decode64(text: str, url: bool = False) -> bytes | None:
    text = "".join(text.split()).rstrip("=")
    if url:
        text = text.replace("-", "+").replace("_", "/")
    if len(text) % 4 == 1:
        return None
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _element(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, start of content, end) of the DER element at `at`, if it lies within `end`."""
    if at + 2 > end:
        return None
    tag, size, at = data[at], data[at + 1], at + 2
    if size >= 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or at + n > end:
            return None
        size, at = int.from_bytes(data[at : at + n], "big"), at + n
        if size < 0x80:
            return None  # DER has one, the shortest, form
    return (tag, at, at + size) if at + size <= end else None


def _children(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    out = []
    while start < end:
        if (e := _element(data, start, end)) is None:
            return None
        out.append(e)
        start = e[2]
    return out


def is_private_key(data: bytes) -> bool:
    """Whether data is one DER structure of a private key: PKCS#8 (plain or encrypted), PKCS#1, SEC 1 or DSA."""
    top = _element(data, 0, len(data))
    if top is None or top[0] != 0x30 or top[2] != len(data):
        return False
    parts = _children(data, top[1], top[2])
    if not parts or any(s == e for t, s, e in parts if t == 0x02):
        return False
    tags = [t for t, _, _ in parts]

    def begins_with_oid(part):
        inner = _children(data, part[1], part[2])
        return bool(inner) and inner[0][0] == 0x06 and inner[0][2] > inner[0][1]

    if tags == [0x30, 0x04]:  # encrypted PKCS#8
        return begins_with_oid(parts[0]) and parts[1][2] - parts[1][1] >= 16
    if tags[0] != 0x02:
        return False
    version = int.from_bytes(data[parts[0][1] : parts[0][2]], "big")
    if tags[1:3] == [0x30, 0x04]:  # PKCS#8
        return version in (0, 1) and begins_with_oid(parts[1])
    if tags[1:2] == [0x04]:  # SEC 1
        return version == 1 and parts[1][2] - parts[1][1] >= 16 and all(t in (0xA0, 0xA1) for t in tags[2:])
    if len(tags) in (6, 9) and set(tags) == {0x02}:  # DSA, PKCS#1
        return version == 0 and parts[1][2] - parts[1][1] >= 32
    return False


def is_openssh_key(data: bytes) -> bool:
    """Whether data is an OpenSSH private key container whose nested lengths add up."""
    if not data.startswith(b"openssh-key-v1\0"):
        return False
    at = 15

    def text():
        nonlocal at
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            raise ValueError
        at += 4 + size
        return data[at - size : at]

    try:
        if not text() or not text():  # cipher, key derivation
            return False
        text()
        count = int.from_bytes(data[at : at + 4], "big")
        at += 4
        if not 1 <= count <= 16:
            return False
        for _ in range(count):
            if not text():
                return False
        return len(text()) >= 8 and at <= len(data)
    except ValueError:
        return False


def is_signed_token(text: str) -> bool:
    """Whether text is header.payload.signature with JSON objects in base64url, the header naming its algorithm."""
    head, body, sign = text.split(".")
    try:
        head, body = (json.loads((_decode64(x, True) or b"").decode()) for x in (head, body))
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(body, dict) and len(_decode64(sign, True) or b"") >= 16


def _three_parts(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping spans of eyJ[A-Za-z0-9_-]+, a dot, a run of such characters, a dot and one more run.

    Each maximal dotted chain of runs is matched once and its parts are then looked at in order, so that a long run
    without a dot isn't tried from each of its places.
    """
    out = []
    for m in _DOTTED.finditer(text):
        if "eyJ" not in m[0]:
            continue
        parts, at, i = m[0].split("."), m.start(), 0
        while i + 2 < len(parts):
            begin = parts[i].find("eyJ")
            if 0 <= begin < len(parts[i]) - 3:
                end = at + len(parts[i]) + len(parts[i + 1]) + len(parts[i + 2]) + 2
                out.append((at + begin, end))
                at, i = end + 1, i + 3
            else:
                at, i = at + len(parts[i]) + 1, i + 1
    return out


def find_secrets(text: str) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) in code points, end exclusive, by start and then by KINDS.

    The base kinds are found whether or not they decode to anything. jwt, der and ssh are candidates that passed
    structural confirmation; der takes base64, hex and PEM, and each of them only as a whole run.
    """
    out: list[tuple[str, int, int]] = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    if "eyJ" in text:
        out += [("jwt", start, end) for start, end in _three_parts(text) if is_signed_token(text[start:end])]
    der = set()
    if "M" in text:
        for m in _RUN64.finditer(text):
            if (m.start() == 0 or text[m.start() - 1] not in _IN64) and (data := _decode64(m[0])) and is_private_key(data):
                der.add(m.span())
    if "30" in text:
        for m in _RUN16.finditer(text):
            if (m.start() == 0 or text[m.start() - 1] not in _IN16) and len(m[0]) % 2 == 0 and is_private_key(bytes.fromhex(m[0])):
                der.add(m.span())
    if "PRIVATE KEY-----" in text:
        for m in _PEM.finditer(text):
            if (data := _decode64(m[1])) and is_private_key(data):
                der = {x for x in der if not m.start() <= x[0] < m.end()} | {m.span()}
    out += [("der", *x) for x in der]
    if "b3BlbnNzaC1rZXktdjEA" in text:
        for m in _SSH.finditer(text):
            if (data := _decode64(m[0])) and is_openssh_key(data):
                out.append(("ssh", m.start(), m.start() + len(m[0].rstrip())))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


SPANS = "array<struct<kind:string,start:int,end:int>>"


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans array<struct<kind,start,end>>) for each row; null texts are empty and have no spans.

    Row by row: repeated rows, null ids and further columns need nothing special; an empty table gives no rows.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for b in batches:
            spans = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in find_secrets(t)] for t in strings_of(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, kind)], names=["doc_id", "spans"])

    return map_texts(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, f"doc_id long, spans {SPANS}", 1)


def redact(text: str, spans: list[tuple[str, int, int]], mark: str = "[secret]") -> str:
    out, at = [], 0
    for _, start, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]


def redact_secrets(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """docs with every span of `text` replaced by `mark` (overlapping spans by one) and n_chars, if there, set anew.

    Every row stays; rows without spans are unchanged, null texts stay null. Columns are those of docs.
    """
    names = docs.columns
    text_at, size_at = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches):
        for b in batches:
            cols, texts = list(b.columns), b.column(text_at).to_pylist()
            spans = [find_secrets(t) if t else [] for t in texts]
            if any(spans):
                clean = [redact(t, s, mark) if s else t for t, s in zip(texts, spans, strict=True)]
                cols[text_at] = pa.array(clean, b.column(text_at).type)
                if size_at is not None:
                    old = b.column(size_at).to_pylist()
                    cols[size_at] = pa.array([len(t) if s else n for t, s, n in zip(clean, spans, old, strict=True)], b.column(size_at).type)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return map_texts(docs, run, docs.schema, text_at)
