"""Header tables of MPEG-4 visual and HEVC streams: start codes, pictures, sizes, unit kinds."""

from __future__ import annotations

from .bits import BitReader, split_annexb, unescape_nal


def mpeg4_units(data: bytes) -> list[tuple[int, int, bytes]]:
    """(position, code, body) of each start code of an MPEG-4 visual stream."""
    at, marks = 0, []
    while (at := data.find(b"\0\0\1", at)) >= 0 and at + 3 < len(data):
        marks.append(at)
        at += 3
    ends = [*marks[1:], len(data)]
    return [(p, data[p + 3], data[p + 4 : e]) for p, e in zip(marks, ends, strict=True)]


def mpeg4_layer(body: bytes) -> dict:
    """Size and clock of a video object layer (body of codes 20..2F), rectangular shape."""
    r = BitReader(body)
    r.skip(9)
    version = 1
    if r.flag():
        version = r.bits(4)
        r.skip(3)
    if r.bits(4) == 15:
        r.skip(16)
    if r.flag():
        r.skip(3)
        if r.flag():
            r.skip(79)
    shape = r.bits(2)
    if shape:
        raise ValueError("only rectangular layers are read")
    r.skip(1)
    ticks = r.bits(16)
    r.skip(1)
    fixed = r.flag()
    step = r.bits(max(1, (ticks - 1).bit_length())) if fixed else 0
    r.skip(1)
    width = r.bits(13)
    r.skip(1)
    height = r.bits(13)
    r.skip(1)
    return {"version": version, "ticks": ticks, "step": step, "width": width, "height": height, "interlaced": r.flag()}


def mpeg4_picture(body: bytes) -> str:
    """Kind of a video object plane: I, P, B or S."""
    return "IPBS"[body[0] >> 6]


#: Names of the HEVC unit kinds that are told apart.
HEVC_KINDS = {32: "VPS", 33: "SPS", 34: "PPS", 35: "AUD", 39: "SEI", 40: "SEI", 19: "IDR", 20: "IDR", 21: "CRA"}


def hevc_units(data: bytes) -> list[tuple[int, int, int, str]]:
    """(type, layer, temporal id, kind) of each unit of an Annex B HEVC stream."""
    out = []
    for u in split_annexb(data):
        if len(u) >= 2:
            kind = u[0] >> 1 & 63
            out.append((kind, (u[0] & 1) << 5 | u[1] >> 3, (u[1] & 7) - 1, HEVC_KINDS.get(kind, "slice" if kind < 32 else "other")))
    return out


def hevc_sps(unit: bytes) -> dict:
    """Profile, level, chroma and picture size of an HEVC sequence parameter set (with its two header bytes)."""
    r = BitReader(unescape_nal(unit[2:]))
    r.skip(4)
    layers = r.bits(3)
    r.skip(1)
    r.skip(3)
    profile = r.bits(5)
    r.skip(32 + 48)
    level = r.bits(8)
    present = [(r.flag(), r.flag()) for _ in range(layers)]
    if layers:
        r.skip(2 * (8 - layers))
    for has_profile, has_level in present:
        r.skip(88 * has_profile + 8 * has_level)
    number, chroma = r.ue(), r.ue()
    if chroma == 3:
        r.skip(1)
    width, height = r.ue(), r.ue()
    if r.flag():
        left, right, top, bottom = (r.ue() for _ in range(4))
        sx, sy = 2 if chroma in (1, 2) else 1, 2 if chroma == 1 else 1
        width, height = width - sx * (left + right), height - sy * (top + bottom)
    return {"sps_id": number, "profile": profile, "level": level, "chroma_format": chroma, "width": width, "height": height, "bit_depth": 8 + r.ue()}


def hevc_vps(unit: bytes) -> dict:
    """Number, sub-layers, profile, tier and level of an HEVC video parameter set (with its two header bytes)."""
    r = BitReader(unescape_nal(unit[2:]))
    number = r.bits(4)
    r.skip(2 + 6)
    layers, nested = r.bits(3) + 1, r.flag()
    r.skip(16 + 2)
    tier, profile = r.flag(), r.bits(5)
    r.skip(32 + 48)
    return {"vps_id": number, "sub_layers": layers, "nested": nested, "profile": profile, "high_tier": tier, "level": r.bits(8)}


def parse_hvcc(data: bytes) -> dict:
    """Profile, level, size of lengths and units by type of an hvcC record."""
    if len(data) < 23 or data[0] != 1:
        raise ValueError("not an hvcC record")
    out = {"profile": data[1] & 31, "level": data[12], "length_size": (data[21] & 3) + 1, "units": {}}
    at = 23
    for _ in range(data[22]):
        kind, n, at = data[at] & 63, int.from_bytes(data[at + 1 : at + 3], "big"), at + 3
        for _ in range(n):
            size = int.from_bytes(data[at : at + 2], "big")
            if at + 2 + size > len(data):
                raise ValueError("an hvcC unit is cut off")
            out["units"].setdefault(kind, []).append(data[at + 2 : at + 2 + size])
            at += 2 + size
    return out


def build_hvcc(vps: list[bytes], sps: list[bytes], pps: list[bytes], length_size: int = 4) -> bytes:
    """An hvcC record of parameter sets (with their header bytes); profile and level are those of the first SPS."""
    if not sps:
        raise ValueError("an hvcC record needs an SPS")
    ptl = unescape_nal(sps[0][2:])[1:13]  # the general profile, tier and level, after number, layers and nesting
    head = hevc_sps(sps[0])
    depth = (head["bit_depth"] - 8) & 7
    layers = (unescape_nal(sps[0][2:])[0] >> 1 & 7) + 1
    out = b"\1" + ptl + b"\xf0\0\xfc" + bytes([0xFC | head["chroma_format"], 0xF8 | depth, 0xF8 | depth, 0, 0, layers << 3 | length_size - 1])
    arrays = [(k, units) for k, units in ((32, vps), (33, sps), (34, pps)) if units]
    out += bytes([len(arrays)])
    for kind, units in arrays:
        out += bytes([0x80 | kind]) + len(units).to_bytes(2, "big") + b"".join(len(u).to_bytes(2, "big") + u for u in units)
    return out


def mpeg4_user_data(data: bytes) -> list[str]:
    """Texts of the user data sections (code B2), up to the first zero byte."""
    return [body.split(b"\0")[0].decode("latin-1") for _, code, body in mpeg4_units(data) if code == 0xB2]
