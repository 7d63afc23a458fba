"""Containers: file bytes to streams and packets (demuxers) and back (muxers).

Demuxers take a whole file and give (streams, packets). Times are in the stream's time base; an unknown time is None.
"""

from __future__ import annotations

import struct
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from ..codecs import flac
from ..functions.bits import crc, ebml_coded, ebml_size, extended_bytes, extended_double, split_annexb
from .headers import adts_bytes, adts_header, mp3_header
from .probe import after_id3, probe_bytes


@dataclass
class Stream:
    index: int
    media_type: str
    codec: str
    tb: tuple[int, int]
    extra: bytes = b""
    rate: int = 0
    channels: int = 0
    bits: int = 0
    width: int = 0
    height: int = 0
    duration: int | None = None
    metadata: dict[str, str] = field(default_factory=dict)


@dataclass
class Packet:
    stream: int
    pts: int | None
    dts: int | None
    data: bytes
    duration: int = 0
    key: bool = True
    pos: int = -1


Media = tuple[list[Stream], list[Packet]]
#: Codec of (format tag, bits) in WAV files, and of bits in AIFF files.
WAV_CODECS = {(1, 8): "pcm_u8", (1, 16): "pcm_s16le", (1, 24): "pcm_s24le", (1, 32): "pcm_s32le", (3, 32): "pcm_f32le"}
AIFF_CODECS = {8: "pcm_u8", 16: "pcm_s16be", 24: "pcm_s24be", 32: "pcm_s32be"}
PER_PACKET = 4096


def _pcm_packets(data: bytes, at: int, size: int, block: int) -> list[Packet]:
    out, n = [], 0
    size = min(size, len(data) - at) // block * block
    while n * block < size:
        part = data[at + n * block : at + min(size, (n + PER_PACKET) * block)]
        out.append(Packet(0, n, n, part, len(part) // block, True, at + n * block))
        n += PER_PACKET
    return out


def _chunks(data: bytes, at: int, order: str):
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack(order + "I", data[at + 4 : at + 8])[0]
        yield name, at + 8, size
        at += 8 + size + size % 2


def demux_wav(data: bytes) -> Media:
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    form, body = None, None
    for name, at, size in _chunks(data, 12, "<"):
        if name == b"fmt ":
            tag, channels, rate, _, block, bits = struct.unpack("<HHIIHH", data[at : at + 16])
            form = (struct.unpack("<H", data[at + 24 : at + 26])[0] if tag == 0xFFFE and size >= 40 else tag, channels, rate, block, bits)
        elif name == b"data":
            body = (at, size)
            break
    if not form or not body:
        raise ValueError("no fmt or no data chunk")
    tag, channels, rate, block, bits = form
    if (tag, bits) not in WAV_CODECS:
        raise ValueError(f"WAV format {tag} with {bits} bits isn't supported")
    block = block or channels * bits // 8
    packets = _pcm_packets(data, *body, block)
    return [Stream(0, "audio", WAV_CODECS[tag, bits], (1, rate), b"", rate, channels, bits, duration=body[1] // block)], packets


def mux_wav(streams: list[Stream], packets: list[Packet]) -> bytes:
    s = streams[0]
    tag, bits = {v: k for k, v in WAV_CODECS.items()}[s.codec]
    body = b"".join(p.data for p in packets)
    block = s.channels * bits // 8
    form = struct.pack("<HHIIHH", tag, s.channels, s.rate, s.rate * block, block, bits)
    chunk = b"WAVEfmt " + struct.pack("<I", 16) + form + b"data" + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)
    return b"RIFF" + struct.pack("<I", len(chunk)) + chunk


def demux_aiff(data: bytes) -> Media:
    if data[:4] != b"FORM" or data[8:12] not in (b"AIFF", b"AIFC"):
        raise ValueError("not an AIFF file")
    form, body = None, None
    for name, at, size in _chunks(data, 12, ">"):
        if name == b"COMM":
            channels, _, bits = struct.unpack(">HIH", data[at : at + 8])
            kind = data[at + 18 : at + 22] if data[8:12] == b"AIFC" else b"NONE"
            form = (channels, bits, int(extended_double(data[at + 8 : at + 18])), kind)
        elif name == b"SSND":
            skip = struct.unpack(">I", data[at : at + 4])[0]
            body = (at + 8 + skip, size - 8 - skip)
    if not form or not body:
        raise ValueError("no COMM or no SSND chunk")
    channels, bits, rate, kind = form
    codec = {b"NONE": AIFF_CODECS.get(bits), b"sowt": {16: "pcm_s16le", 24: "pcm_s24le", 32: "pcm_s32le"}.get(bits), b"fl32": "pcm_f32be", b"FL32": "pcm_f32be"}.get(kind)
    if codec is None:
        raise ValueError(f"AIFF compression {kind!r} with {bits} bits isn't supported")
    block = channels * bits // 8
    return [Stream(0, "audio", codec, (1, rate), b"", rate, channels, bits, duration=body[1] // block)], _pcm_packets(data, *body, block)


def mux_aiff(streams: list[Stream], packets: list[Packet]) -> bytes:
    """Payloads are written as they are."""
    s, body = streams[0], b"".join(p.data for p in packets)
    bits = s.bits or int("".join(c for c in s.codec if c.isdigit()))
    comm = struct.pack(">HIH", s.channels, len(body) // (s.channels * bits // 8), bits) + extended_bytes(float(s.rate))
    chunk = b"AIFFCOMM" + struct.pack(">I", len(comm)) + comm + b"SSND" + struct.pack(">I", 8 + len(body)) + bytes(8) + body + b"\0" * (len(body) % 2)
    return b"FORM" + struct.pack(">I", len(chunk)) + chunk


def demux_flac(data: bytes) -> Media:
    at = after_id3(data)
    if data[at : at + 4] != b"fLaC":
        raise ValueError("not a FLAC file")
    at, info, tags, last = at + 4, None, {}, False
    while not last:
        last, kind, size = bool(data[at] >> 7), data[at] & 127, int.from_bytes(data[at + 1 : at + 4], "big")
        body = data[at + 4 : at + 4 + size]
        if kind == 0:
            v = int.from_bytes(body[10:18], "big")
            info = {"rate": v >> 44, "channels": (v >> 41 & 7) + 1, "bits": (v >> 36 & 31) + 1, "total": v & (1 << 36) - 1, "raw": body}
        elif kind == 4:
            tags = vorbis_comments(body)
        at += 4 + size
    if not info:
        raise ValueError("no STREAMINFO")
    stream = Stream(0, "audio", "flac", (1, info["rate"]), info["raw"], info["rate"], info["channels"], info["bits"], duration=info["total"] or None, metadata=tags)
    packets, n = [], 0
    while at < len(data):
        head = flac.frame_header(data, at, info)
        if head is None:
            at += 1
            continue
        end = at + head["size"]
        while True:  # the frame ends where another starts, or the file, and its checksum is right
            end = data.find(b"\xff", end)
            stop = len(data) if end < 0 else end
            if (end < 0 or flac.frame_header(data, end, info)) and crc(data[at : stop - 2], 16) == int.from_bytes(data[stop - 2 : stop], "big"):
                break
            if end < 0:
                break
            end += 1
        packets.append(Packet(0, n, n, data[at:stop], head["block"], True, at))
        n, at = n + head["block"], stop
    return [stream], packets


def vorbis_comments(body: bytes) -> dict[str, str]:
    """KEY=VALUE fields, keys in lower case."""
    out, at = {}, 4 + int.from_bytes(body[:4], "little")
    count, at = int.from_bytes(body[at : at + 4], "little"), at + 4
    for _ in range(count):
        n = int.from_bytes(body[at : at + 4], "little")
        key, eq, value = body[at + 4 : at + 4 + n].decode("utf-8", "replace").partition("=")
        if eq:
            out[key.lower()] = value
        at += 4 + n
    return out


def mux_flac(streams: list[Stream], packets: list[Packet]) -> bytes:
    s = streams[0]
    total = sum(p.duration for p in packets)
    return flac.stream_header(s.rate, s.channels, s.bits, total, [len(p.data) for p in packets], max([p.duration for p in packets], default=flac.BLOCK)) + b"".join(p.data for p in packets)


def demux_adts(data: bytes) -> Media:
    at, packets, n, first = after_id3(data), [], 0, None
    while at + 7 <= len(data):
        h = adts_header(data, at)
        if h is None or at + h["size"] > len(data):
            at += 1
            continue
        first = first or h
        packets.append(Packet(0, n, n, data[at + h["head"] : at + h["size"]], h["samples"], True, at))
        n, at = n + h["samples"], at + h["size"]
    if first is None:
        raise ValueError("no ADTS frame")
    config = ((first["profile"] + 1) << 11 | first["rate_index"] << 7 | first["channels"] << 3).to_bytes(2, "big")
    return [Stream(0, "audio", "aac", (1, first["rate"]), config, first["rate"], first["channels"], duration=n)], packets


def mux_adts(streams: list[Stream], packets: list[Packet]) -> bytes:
    s = streams[0]
    return b"".join(adts_bytes(len(p.data), s.rate, s.channels) + p.data for p in packets)


def demux_mp3(data: bytes) -> Media:
    at, packets, n, first = after_id3(data), [], 0, None
    while at + 4 <= len(data):
        h = mp3_header(data, at)
        if h is None or (first is None and at + h["size"] + 4 <= len(data) and mp3_header(data, at + h["size"]) is None):
            at += 1
            continue
        frame = data[at : at + h["size"]]
        if first is None:
            first, vbr = h, mp3_vbr(frame, h)
            if vbr:
                at += h["size"]
                continue
        packets.append(Packet(0, n, n, frame, h["samples"], True, at))
        n, at = n + h["samples"], at + h["size"]
    if first is None:
        raise ValueError("no MP3 frame")
    stream = Stream(0, "audio", "mp3", (1, first["rate"]), b"", first["rate"], first["channels"], duration=n)
    if vbr:  # what the tag says counts, without the samples that the encoder added
        total, delay, padding = vbr
        stream.duration = max(0, (total * first["samples"] if total else n) - delay - padding)
        stream.metadata = {"frames": str(total or len(packets)), "encoder_delay": str(delay), "encoder_padding": str(padding)}
    return [stream], packets


def mp3_vbr(frame: bytes, head: dict) -> tuple[int, int, int] | None:
    """(frames, or 0 if not told, encoder delay, padding) of a first frame that holds a Xing, Info or VBRI tag."""
    side = (17 if head["channels"] == 1 else 32) if head["mpeg1"] else (9 if head["channels"] == 1 else 17)
    at = 4 + side
    if frame[at : at + 4] in (b"Xing", b"Info"):
        flags, at = int.from_bytes(frame[at + 4 : at + 8], "big"), at + 8
        frames = int.from_bytes(frame[at : at + 4], "big") if flags & 1 else 0
        at += 4 * (flags & 1) + 4 * (flags >> 1 & 1) + 100 * (flags >> 2 & 1) + 4 * (flags >> 3 & 1)
        d = int.from_bytes(frame[at + 21 : at + 24], "big") if len(frame) >= at + 24 else 0
        delay, padding = d >> 12, d & 0xFFF
        return frames, *((delay, padding) if max(delay, padding) <= 2880 else (0, 0))
    if frame[36:40] == b"VBRI":
        return int.from_bytes(frame[50:54], "big"), 0, 0
    return None


def mux_mp3(streams: list[Stream], packets: list[Packet]) -> bytes:
    return b"".join(p.data for p in packets)


#: Stream types of MPEG transport streams.
TS_TYPES = {0x01: "mpeg1video", 0x02: "mpeg2video", 0x03: "mp3", 0x04: "mp3", 0x0F: "aac", 0x10: "mpeg4", 0x1B: "h264", 0x24: "h265", 0x81: "ac3"}
VIDEO = frozenset(("mpeg1video", "mpeg2video", "mpeg4", "h264", "h265", "vp8", "vp9", "av1", "theora", "rawvideo", "mjpeg"))


def _kind(codec: str) -> str:
    return "video" if codec in VIDEO else "audio"


def _pes_time(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | (b[2] >> 1) << 15 | b[3] << 7 | b[4] >> 1


def demux_ts(data: bytes) -> Media:
    at = next((i for i in range(min(len(data), 1024)) if all(data[i + 188 * k : i + 188 * k + 1] == b"\x47" for k in range(min(3, (len(data) - i) // 188)))), None)
    if at is None or len(data) < 188:
        raise ValueError("no transport packets")
    programs: set[int] = set()
    streams: dict[int, Stream] = {}
    held: dict[int, tuple[int, bytearray]] = {}
    packets: list[Packet] = []

    def finish(pid):
        pos, body = held.pop(pid, (0, b""))
        if len(body) < 9 or body[:3] != b"\0\0\1":
            return
        flags, head = body[7] >> 6, body[8]
        pts = _pes_time(body[9:14]) if flags & 2 else None
        dts = _pes_time(body[14:19]) if flags == 3 else pts
        size = int.from_bytes(body[4:6], "big")
        payload = bytes(body[9 + head : 6 + size if size else None])
        codec = streams[pid].codec
        key = codec not in VIDEO or any(u[0] & 31 == 5 for u in split_annexb(payload)) if codec == "h264" else True
        packets.append(Packet(streams[pid].index, pts, dts, payload, 0, key, pos))

    while at + 188 <= len(data):
        p = data[at : at + 188]
        if p[0] != 0x47:
            at += 1
            continue
        start, pid, control = bool(p[1] & 0x40), (p[1] & 31) << 8 | p[2], p[3] >> 4 & 3
        body = p[4:] if control == 1 else p[5 + p[4] :] if control == 3 else b""
        if pid == 0 and start and body:
            t = body[1 + body[0] :]
            end = 3 + ((t[1] & 15) << 8 | t[2]) - 4
            programs |= {(t[i + 2] & 31) << 8 | t[i + 3] for i in range(8, end, 4) if t[i] << 8 | t[i + 1]}
        elif pid in programs and start and body:
            t = body[1 + body[0] :]
            end, i = 3 + ((t[1] & 15) << 8 | t[2]) - 4, 12 + ((t[10] & 15) << 8 | t[11])
            while i + 5 <= end:
                kind, es = t[i], (t[i + 1] & 31) << 8 | t[i + 2]
                if es not in streams and kind in TS_TYPES:
                    streams[es] = Stream(len(streams), _kind(TS_TYPES[kind]), TS_TYPES[kind], (1, 90000))
                i += 5 + ((t[i + 3] & 15) << 8 | t[i + 4])
        elif pid in streams:
            if start:
                finish(pid)
                held[pid] = (at, bytearray(body))
            elif pid in held:
                held[pid][1].extend(body)
        at += 188
    for pid in list(held):
        finish(pid)
    return list(streams.values()), packets


def _mpeg_crc(data: bytes) -> bytes:
    v = 0xFFFFFFFF
    for b in data:
        v ^= b << 24
        for _ in range(8):
            v = (v << 1 ^ 0x04C11DB7 if v >> 31 else v << 1) & 0xFFFFFFFF
    return v.to_bytes(4, "big")


def _table(number: int, body: bytes) -> bytes:
    t = bytes([number, 0xB0 | (len(body) + 9) >> 8, (len(body) + 9) & 255, 0, 1, 0xC1, 0, 0]) + body
    return b"\0" + t + _mpeg_crc(t)


def mux_ts(streams: list[Stream], packets: list[Packet]) -> bytes:
    """Program tables before every 40th packet, continuity counters by stream, payloads in PES packets of 188 bytes."""
    kinds = {v: k for k, v in reversed(TS_TYPES.items())}
    counters: dict[int, int] = {}
    out: list[bytes] = []

    def send(pid, body, start=True):
        while body or start:
            n = counters[pid] = counters.get(pid, -1) + 1
            room, part = 184, body[:184]
            head = bytes([0x47, (0x40 if start else 0) | pid >> 8, pid & 255])
            if len(part) < room:
                fill = room - len(part) - 1
                stuff = bytes([fill]) + (b"\0" + b"\xff" * (fill - 1) if fill else b"")
                out.append(head + bytes([0x30 | n & 15]) + stuff + part)
            else:
                out.append(head + bytes([0x10 | n & 15]) + part)
            body, start = body[len(part) :], False

    program = b"\xe1\x00\xf0\x00" + b"".join(bytes([kinds[s.codec], 0xE1, s.index + 1, 0xF0, 0]) for s in streams)
    for i, p in enumerate(packets):
        if i % 40 == 0:
            for pid, t in ((0, _table(0, b"\0\1\xf0\0")), (0x1000, _table(2, program))):
                send(pid, t + b"\xff" * (184 - len(t)))
        s = streams[p.stream]
        stamp = lambda t, mark: bytes([mark << 4 | (t >> 30 & 7) << 1 | 1, t >> 22 & 255, (t >> 15 & 127) << 1 | 1, t >> 7 & 255, (t & 127) << 1 | 1])
        ticks = [None if t is None else t * s.tb[0] * 90000 // s.tb[1] for t in (p.pts, p.dts)]
        times, flags = b"", 0
        if ticks[0] is not None:
            both = ticks[1] is not None and ticks[1] != ticks[0]
            times, flags = (stamp(ticks[0], 3) + stamp(ticks[1], 1), 0xC0) if both else (stamp(ticks[0], 2), 0x80)
        size = 3 + len(times) + len(p.data)
        send(0x101 + s.index, b"\0\0\1" + bytes([0xE0 if s.media_type == "video" else 0xC0]) + (size if size < 65536 else 0).to_bytes(2, "big") + bytes([0x80, flags, len(times)]) + times + p.data)
    return b"".join(out)


def demux_ogg(data: bytes) -> Media:
    """Packets from pages; only the last packet that ends on a page has the page's granule position as its time."""
    at, streams, held, packets, heads = after_id3(data), {}, {}, [], {}
    while (at := data.find(b"OggS", at)) >= 0 and at + 27 <= len(data):
        flags, granule, serial = data[at + 5], int.from_bytes(data[at + 6 : at + 14], "little", signed=True), data[at + 14 : at + 18]
        count = data[at + 26]
        lacing = data[at + 27 : at + 27 + count]
        body = at + 27 + count
        size = body + sum(lacing) - at
        page = data[at : at + size]
        if len(page) < size or crc(page[:22] + bytes(4) + page[26:], 32) != int.from_bytes(page[22:26], "little"):
            at += 4
            continue
        part, done, pos = held.pop(serial, b"") if flags & 1 else b"", [], body
        for n in lacing:
            part += data[pos : pos + n]
            pos += n
            if n < 255:
                done.append(part)
                part = b""
        if count and lacing[-1] == 255:
            held[serial] = part
        for i, d in enumerate(done):
            if serial not in streams:
                streams[serial] = s = _ogg_stream(len(streams), d)
                heads[serial] = {"vorbis": 3, "theora": 3, "opus": 2, "flac": 2}.get(s.codec, 0)
            if heads[serial]:
                heads[serial] -= 1
                streams[serial].extra += d
                continue
            last = i == len(done) - 1
            packets.append(Packet(streams[serial].index, granule if last and granule >= 0 else None, granule if last and granule >= 0 else None, d, 0, True, at))
        if granule > 0 and serial in streams:
            streams[serial].duration = max(streams[serial].duration or 0, granule)
        at += size
    if not streams:
        raise ValueError("no Ogg page")
    return list(streams.values()), packets


def _ogg_stream(index: int, head: bytes) -> Stream:
    if head[:7] == b"\x01vorbis":
        rate = int.from_bytes(head[12:16], "little")
        return Stream(index, "audio", "vorbis", (1, rate or 1), b"", rate, head[11])
    if head[:8] == b"OpusHead":
        return Stream(index, "audio", "opus", (1, 48000), b"", 48000, head[9])
    if head[:5] == b"\x7fFLAC":
        v = int.from_bytes(head[27:35], "big")
        return Stream(index, "audio", "flac", (1, v >> 44 or 1), b"", v >> 44, (v >> 41 & 7) + 1, (v >> 36 & 31) + 1)
    if head[:7] == b"\x80theora":
        num, den = int.from_bytes(head[22:26], "big"), int.from_bytes(head[26:30], "big")
        return Stream(index, "video", "theora", (den or 1, num or 1), b"", width=int.from_bytes(head[14:17], "big"), height=int.from_bytes(head[17:20], "big"))
    return Stream(index, "data", "none", (1, 1000))


def mux_ogg(streams: list[Stream], packets: list[Packet]) -> bytes:
    """One packet a page; the granule is the packet's end, or where the last one ended plus its duration."""
    out, number, ends = [], dict.fromkeys((s.index for s in streams), 0), dict.fromkeys((s.index for s in streams), 0)

    def page(serial, body, granule, flags):
        first, lacing = True, [255] * (len(body) // 255) + [len(body) % 255]
        while lacing:
            part, lacing = lacing[:255], lacing[255:]
            size = sum(part)
            head = b"OggS\0" + bytes([flags if first else 1 | flags & 4]) + (granule if not lacing else -1).to_bytes(8, "little", signed=True) + struct.pack("<IIIB", serial, number[serial], 0, len(part)) + bytes(part)
            whole = head + body[:size]
            out.append(whole[:22] + crc(whole, 32).to_bytes(4, "little") + whole[26:])
            body, first = body[size:], False
            number[serial] += 1

    for s in streams:
        page(s.index, s.extra, 0, 2)
    left = {s.index: sum(p.stream == s.index for p in packets) for s in streams}
    for p in packets:
        ends[p.stream] = (p.pts if p.pts is not None else ends[p.stream]) + p.duration
        left[p.stream] -= 1
        page(p.stream, p.data, ends[p.stream], 0 if left[p.stream] else 4)
    return b"".join(out)


def demux_m4v(data: bytes) -> Media:
    """A packet for each picture, with the headers before it; times count pictures."""
    marks = []
    at = 0
    while (at := data.find(b"\0\0\1", at)) >= 0 and at + 3 < len(data):
        marks.append((at, data[at + 3]))
        at += 3
    if not marks:
        raise ValueError("no start code")
    packets, begin, seen = [], marks[0][0], False
    for pos, code in marks:
        if seen and (code == 0xB6 or code >= 0xB0 or code <= 0x2F):
            packets.append(Packet(0, len(packets), len(packets), data[begin:pos], 1, True, begin))
            begin, seen = pos, False
        seen = seen or code == 0xB6
    if seen:
        packets.append(Packet(0, len(packets), len(packets), data[begin:], 1, True, begin))
    first = next((p for p, c in marks if c == 0xB6), len(data))
    return [Stream(0, "video", "mpeg4", (1, 25), data[marks[0][0] : first])], packets


def demux_h264(data: bytes) -> Media:
    """Access units of an Annex B stream; times count pictures at 25 a second."""
    from ..functions.bits import parse_h264_sps

    units = split_annexb(data)
    if not units:
        raise ValueError("no NAL unit")
    packets, held, coded = [], [], False
    stream = Stream(0, "video", "h264", (1, 25))

    def finish():
        nonlocal held, coded
        if coded:
            key = any(u[0] & 31 == 5 for u in held)
            packets.append(Packet(0, len(packets), len(packets), b"".join(b"\0\0\0\1" + u for u in held), 1, key))
            held, coded = [], False

    for u in units:
        kind = u[0] & 31
        slice_ = kind in (1, 5)
        if coded and (kind in (6, 7, 8, 9) or slice_ and len(u) > 1 and u[1] & 0x80):
            finish()
        if kind == 7 and not stream.width:
            sps = parse_h264_sps(u)
            stream.width, stream.height = sps["width"], sps["height"]
        held.append(u)
        coded = coded or slice_
    finish()
    return [stream], packets


FLV_AUDIO = {2: "mp3", 10: "aac", 11: "speex", 0: "pcm_s16le", 3: "pcm_s16le"}
FLV_VIDEO = {2: "flv1", 4: "vp6", 7: "h264", 12: "h265"}


def demux_flv(data: bytes) -> Media:
    if data[:3] != b"FLV":
        raise ValueError("not an FLV file")
    at, streams, packets, told = int.from_bytes(data[5:9], "big") + 4, {}, [], {}
    while at + 11 <= len(data):
        kind, size = data[at] & 31, int.from_bytes(data[at + 1 : at + 4], "big")
        time = int.from_bytes(data[at + 4 : at + 7], "big") | data[at + 7] << 24
        body = data[at + 11 : at + 11 + size]
        if kind == 18:
            told = {k: v for k in ("duration", "width", "height") if (v := amf_number(body, k)) is not None} | told
        if kind in (8, 9) and body:
            codec = (FLV_AUDIO.get(body[0] >> 4) if kind == 8 else FLV_VIDEO.get(body[0] & 15)) or "none"
            if kind not in streams:
                s = streams[kind] = Stream(len(streams), "audio" if kind == 8 else "video", codec, (1, 1000))
                if kind == 8:
                    s.rate, s.channels, s.bits = (5512, 11025, 22050, 44100)[body[0] >> 2 & 3], 1 + (body[0] & 1), 16 if body[0] & 2 else 8
            s, skip, cts = streams[kind], 1, 0
            config = False
            if codec == "aac":
                skip, config = 2, body[1] == 0
            elif codec in ("h264", "h265"):
                skip, config = 5, body[1] != 1
                cts = int.from_bytes(body[2:5], "big", signed=True)
                if body[1] == 2:
                    config, skip = True, len(body)
            if config:
                s.extra = body[skip:] or s.extra
            else:
                packets.append(Packet(s.index, time + cts, time, body[skip:], 0, kind == 8 or body[0] >> 4 == 1, at))
        at += 11 + size + 4
    for kind, s in streams.items():
        s.duration = int(told["duration"] * 1000) if "duration" in told else s.duration
        if kind == 9:
            s.width, s.height = int(told.get("width", s.width)), int(told.get("height", s.height))
    return list(streams.values()), packets


def amf_number(body: bytes, key: str) -> float | None:
    """The positive finite number that follows a key in the metadata of a script tag."""
    at = body.find(key.encode()) + len(key)
    if at < len(key) or len(body) < at + 9 or body[at]:
        return None
    value = struct.unpack(">d", body[at + 1 : at + 9])[0]
    return value if 0 < value < float("inf") else None


def mux_flv(streams: list[Stream], packets: list[Packet]) -> bytes:
    kinds = {s.index: 8 if s.media_type == "audio" else 9 for s in streams}
    has = sum({8: 4, 9: 1}[k] for k in set(kinds.values()))
    out = [b"FLV\1" + bytes([has]) + b"\0\0\0\x09\0\0\0\0"]

    def tag(kind, time, body):
        head = bytes([kind]) + len(body).to_bytes(3, "big") + (time & 0xFFFFFF).to_bytes(3, "big") + bytes([time >> 24 & 255, 0, 0, 0])
        out.append(head + body + (len(head) + len(body)).to_bytes(4, "big"))

    def head(s, key, config, cts=0):
        if s.media_type == "audio":
            rate = {5512: 0, 11025: 1, 22050: 2}.get(s.rate, 3)
            code = {v: k for k, v in FLV_AUDIO.items()}[s.codec]
            return bytes([code << 4 | rate << 2 | 2 | (s.channels > 1)]) + (bytes([not config]) if s.codec == "aac" else b"")
        code = {v: k for k, v in FLV_VIDEO.items()}[s.codec]
        return bytes([(1 if key else 2) << 4 | code]) + (bytes([not config]) + (cts & 0xFFFFFF).to_bytes(3, "big") if code in (7, 12) else b"")

    for s in streams:
        if s.extra and s.codec in ("aac", "h264", "h265"):
            tag(kinds[s.index], 0, head(s, True, True) + s.extra)
    for p in packets:
        s = streams[p.stream]
        ms = lambda t, s=s: t * s.tb[0] * 1000 // s.tb[1]
        dts = ms(p.dts if p.dts is not None else p.pts or 0)
        tag(kinds[p.stream], dts, head(s, p.key, False, ms(p.pts) - dts if p.pts is not None else 0) + p.data)
    return b"".join(out)


#: Codec ids of Matroska.
MKV_CODECS = {"V_MPEG4/ISO/AVC": "h264", "V_MPEGH/ISO/HEVC": "h265", "V_VP8": "vp8", "V_VP9": "vp9", "V_AV1": "av1", "V_THEORA": "theora", "V_MPEG4/ISO/ASP": "mpeg4", "A_AAC": "aac", "A_MPEG/L3": "mp3", "A_VORBIS": "vorbis", "A_OPUS": "opus", "A_FLAC": "flac", "A_PCM/INT/LIT": "pcm_s16le", "A_PCM/FLOAT/IEEE": "pcm_f32le", "A_AC3": "ac3", "S_TEXT/UTF8": "srt"}
_MASTERS = frozenset((0x18538067, 0x1549A966, 0x1654AE6B, 0xAE, 0xE0, 0xE1, 0x1F43B675, 0xA0))


def _elements(data: bytes, at: int, end: int):
    while at < end:
        n = 9 - data[at].bit_length() if data[at] else 9
        if n > 4 or at + n >= end:
            return
        ident = int.from_bytes(data[at : at + n], "big")
        size, m = ebml_size(data, at + n)
        body = at + n + m
        stop = end if size is None else min(end, body + size)
        yield ident, body, stop
        at = body if size is None and ident in _MASTERS and ident == 0x18538067 else stop


def split_laces(block: bytes, lacing: int) -> list[bytes]:
    """Frames of a block's body: 0 none, 1 Xiph, 2 fixed size, 3 EBML."""
    if not lacing:
        return [block]
    n, at, sizes = block[0] + 1, 1, []
    if lacing == 2:
        size = (len(block) - 1) // n
        sizes = [size] * (n - 1)
    elif lacing == 1:
        for _ in range(n - 1):
            v = 0
            while block[at] == 255:
                v, at = v + 255, at + 1
            sizes.append(v + block[at])
            at += 1
    else:
        for k in range(n - 1):
            v, m = ebml_size(block, at)
            if v is None:
                v = (1 << 7 * m) - 1
            sizes.append(v if not k else sizes[-1] + v - ((1 << 7 * m - 1) - 1))
            at += m
    out = []
    for s in sizes:
        out.append(block[at : at + s])
        at += s
    return [*out, block[at:]]


def demux_mkv(data: bytes) -> Media:
    if data[:4] != b"\x1aE\xdf\xa3":
        raise ValueError("not a Matroska file")
    streams, numbers, packets, scale, length = [], {}, [], [1_000_000], [None]
    num = lambda a, b: int.from_bytes(data[a:b], "big")

    def real(a, b):
        return struct.unpack(">f" if b - a == 4 else ">d", data[a:b])[0] if b > a else 0.0

    def block(a, b, base, simple):
        track, m = ebml_size(data, a)
        time, flags = struct.unpack(">hB", data[a + m : a + m + 3])
        if track in numbers:
            for part in split_laces(data[a + m + 3 : b], flags >> 1 & 3):
                t = (base + time) * scale[0] // 1_000_000
                packets.append(Packet(numbers[track], t, t, part, 0, bool(flags & 0x80), a))

    def walk(a, b, base=0):
        for ident, s, e in _elements(data, a, b):
            if ident in (0x18538067, 0x1549A966, 0x1654AE6B):
                walk(s, e)
            elif ident == 0x1F43B675:
                walk(s, e, 0)
            elif ident == 0xE7:
                base = num(s, e)
            elif ident == 0xA3:
                block(s, e, base, True)
            elif ident == 0xA0:
                last = [(x, y) for i, x, y in _elements(data, s, e) if i == 0xA1][-1:]
                for x, y in last:
                    block(x, y, base, False)
            elif ident == 0x2AD7B1:
                scale[0] = num(s, e)
            elif ident == 0x4489:
                length[0] = real(s, e)
            elif ident == 0xAE:
                track(s, e)

    def track(a, b):
        number, codec, st = 0, "", Stream(len(streams), "data", "none", (1, 1000))
        for ident, s, e in _elements(data, a, b):
            if ident == 0xD7:
                number = num(s, e)
            elif ident == 0x83:
                st.media_type = {1: "video", 2: "audio", 17: "subtitle"}.get(num(s, e), "data")
            elif ident == 0x86:
                codec = data[s:e].rstrip(b"\0").decode()
            elif ident == 0x63A2:
                st.extra = data[s:e]
            elif ident in (0xE0, 0xE1):
                for i, x, y in _elements(data, s, e):
                    if i == 0xB0:
                        st.width = num(x, y)
                    elif i == 0xBA:
                        st.height = num(x, y)
                    elif i == 0xB5:
                        st.rate = int(real(x, y))
                    elif i == 0x9F:
                        st.channels = num(x, y)
                    elif i == 0x6264:
                        st.bits = num(x, y)
        st.codec = MKV_CODECS.get(codec, "none")
        numbers[number] = st.index
        streams.append(st)

    walk(0, len(data))
    if length[0]:
        streams = [replace(s, duration=int(length[0] * scale[0] / 1e6)) for s in streams]
    return streams, packets


def mux_mkv(streams: list[Stream], packets: list[Packet], doc: str = "matroska", threshold: int = 5000) -> bytes:
    """Clusters begin when a packet lies `threshold` ms or more after the last one's start."""
    el = lambda ident, body: ident.to_bytes((ident.bit_length() + 7) // 8, "big") + ebml_coded(len(body)) + body
    uint = lambda v: v.to_bytes(max(1, (v.bit_length() + 7) // 8), "big")
    names = {v: k for k, v in MKV_CODECS.items()}
    head = el(0x1A45DFA3, el(0x4286, b"\1") + el(0x42F7, b"\1") + el(0x42F2, b"\4") + el(0x42F3, b"\x08") + el(0x4282, doc.encode()) + el(0x4287, b"\4") + el(0x4285, b"\2"))
    tracks = b""
    for s in streams:
        t = el(0xD7, uint(s.index + 1)) + el(0x73C5, uint(s.index + 1)) + el(0x83, uint({"video": 1, "audio": 2}.get(s.media_type, 17))) + el(0x86, names[s.codec].encode())
        t += el(0x63A2, s.extra) if s.extra else b""
        if s.media_type == "video":
            t += el(0xE0, el(0xB0, uint(s.width)) + el(0xBA, uint(s.height)))
        elif s.media_type == "audio":
            t += el(0xE1, el(0xB5, struct.pack(">d", s.rate)) + el(0x9F, uint(s.channels)) + (el(0x6264, uint(s.bits)) if s.bits else b""))
        tracks += el(0xAE, t)
    clusters, start, body, top = b"", None, b"", 0
    for p in packets:
        s = streams[p.stream]
        t = (p.pts if p.pts is not None else p.dts or 0) * s.tb[0] * 1000 // s.tb[1]
        top = max(top, t + p.duration * s.tb[0] * 1000 // s.tb[1])
        if start is None or t - start >= threshold:
            clusters += el(0x1F43B675, body) if start is not None else b""
            start, body = t, el(0xE7, uint(t))
        body += el(0xA3, ebml_coded(p.stream + 1) + struct.pack(">hB", t - start, 0x80 if p.key else 0) + p.data)
    clusters += el(0x1F43B675, body) if start is not None else b""
    info = el(0x1549A966, el(0x2AD7B1, uint(1_000_000)) + el(0x4489, struct.pack(">d", top)) + el(0x4D80, b"reelframe") + el(0x5741, b"reelframe"))
    return head + el(0x18538067, info + el(0x1654AE6B, tracks) + clusters)


def mux_webm(streams: list[Stream], packets: list[Packet]) -> bytes:
    return mux_mkv(streams, packets, "webm")


#: Sample entries of MP4 files.
MP4_CODECS = {b"avc1": "h264", b"avc3": "h264", b"hev1": "h265", b"hvc1": "h265", b"mp4v": "mpeg4", b"vp09": "vp9", b"av01": "av1", b"mp4a": "aac", b"Opus": "opus", b"fLaC": "flac", b"ac-3": "ac3", b"sowt": "pcm_s16le", b".mp3": "mp3"}
_BOXES = frozenset((b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts"))


def _boxes(data: bytes, at: int, end: int):
    while at + 8 <= end:
        size, name = struct.unpack(">I4s", data[at : at + 8])
        body = at + 8
        if size == 1:
            size, body = struct.unpack(">Q", data[at + 8 : at + 16])[0], at + 16
        stop = end if size == 0 else at + size
        if stop < body or stop > end:
            return
        yield name, body, stop
        at = stop


def demux_mp4(data: bytes) -> Media:
    """Samples of all tracks merged by decoding time in microseconds, then place in the file."""
    tracks: list[dict] = []

    def walk(a, b, t):
        for name, s, e in _boxes(data, a, b):
            if name == b"trak":
                t = {"edit": 0}
                walk(s, e, t)
                tracks.append(t)
            elif name in _BOXES:
                walk(s, e, t)
            elif t is not None:
                read(name, s, e, t)

    def runs(s, kind="II"):
        n = struct.unpack(">I", data[s + 4 : s + 8])[0]
        size = struct.calcsize(">" + kind)
        return [struct.unpack(">" + kind, data[s + 8 + size * i : s + 8 + size * (i + 1)]) for i in range(n)]

    def read(name, s, e, t):
        if name == b"mdhd":
            wide = data[s] == 1
            t["scale"], t["length"] = struct.unpack(">IQ" if wide else ">II", data[s + 20 : s + 32] if wide else data[s + 12 : s + 20])
        elif name == b"hdlr":
            t["kind"] = {b"vide": "video", b"soun": "audio", b"sbtl": "subtitle", b"text": "subtitle"}.get(data[s + 8 : s + 12], "data")
        elif name == b"elst":
            for entry in runs(s, "Qqi" if data[s] == 1 else "Iii"):
                if entry[1] >= 0:
                    t["edit"] = entry[1]
                    break
        elif name == b"stsd":
            entry = s + 8
            size, code = struct.unpack(">I4s", data[entry : entry + 8])
            t["codec"], body = MP4_CODECS.get(code, "none"), entry + 8
            if t.get("kind") == "video":
                t["width"], t["height"] = struct.unpack(">HH", data[body + 24 : body + 28])
                inner = body + 78
            else:
                t["channels"], t["bits"], t["rate"] = *struct.unpack(">HH", data[body + 16 : body + 20]), struct.unpack(">I", data[body + 24 : body + 28])[0] >> 16
                inner = body + 28
            t["extra"] = next((data[x:y] for n, x, y in _boxes(data, inner, entry + size) if n in (b"avcC", b"hvcC", b"esds", b"dOps", b"dfLa")), b"")
        elif name in (b"stts", b"ctts", b"stsc", b"stco", b"co64", b"stss"):
            t[name.decode()] = runs(s, {b"ctts": "Ii", b"stsc": "III", b"stco": "I", b"co64": "Q", b"stss": "I"}.get(name, "II"))
        elif name == b"stsz":
            same, n = struct.unpack(">II", data[s + 4 : s + 12])
            t["sizes"] = [same] * n if same else list(struct.unpack(f">{n}I", data[s + 12 : s + 12 + 4 * n]))

    walk(0, len(data), None)
    if not tracks:
        raise ValueError("no track")
    streams, merged = [], []
    for i, t in enumerate(tracks):
        scale = t.get("scale") or 1
        streams.append(Stream(i, t.get("kind", "data"), t.get("codec", "none"), (1, scale), t.get("extra", b""), t.get("rate", 0), t.get("channels", 0), t.get("bits", 0), t.get("width", 0), t.get("height", 0), t.get("length")))
        sizes = t.get("sizes", [])
        deltas = [d for n, d in t.get("stts", []) for _ in range(n)]
        shifts = [d for n, d in t.get("ctts", []) for _ in range(n)]
        keys = {k for (k,) in t["stss"]} if "stss" in t else None
        chunks = [c for (c,) in t.get("stco", t.get("co64", []))]
        starts = t.get("stsc", [])
        k, dts = 0, 0
        for c, pos in enumerate(chunks, 1):
            per = next((n for first, n, _ in reversed(starts) if first <= c), 1)
            for _ in range(per):
                if k >= len(sizes):
                    break
                delta = deltas[k] if k < len(deltas) else 0
                pts = dts + (shifts[k] if k < len(shifts) else 0) - t["edit"]
                merged.append((dts * 1_000_000 // scale, pos, i, Packet(i, pts, dts - t["edit"], data[pos : pos + sizes[k]], delta, keys is None or k + 1 in keys, pos)))
                pos, dts, k = pos + sizes[k], dts + delta, k + 1
    merged.sort(key=lambda x: x[:3])
    return streams, [p for *_, p in merged]


def mux_mp4(streams: list[Stream], packets: list[Packet]) -> bytes:
    """ftyp, mdat, moov; one sample a chunk; durations are decoding-time steps, composition offsets pts - dts."""
    box = lambda name, *parts: struct.pack(">I4s", 8 + sum(map(len, parts)), name) + b"".join(parts)
    full = lambda name, *parts: box(name, bytes(4), *parts)
    names = {v: k for k, v in reversed(MP4_CODECS.items())}
    out = bytearray(box(b"ftyp", b"isom\0\0\2\0isomiso2mp41"))
    out += struct.pack(">I4s", 8 + sum(len(p.data) for p in packets), b"mdat")
    samples: dict[int, list] = {s.index: [] for s in streams}
    for p in packets:
        samples[p.stream].append((len(out), p))
        out += p.data
    matrix = struct.pack(">9i", 65536, 0, 0, 0, 65536, 0, 0, 0, 1 << 30)
    traks, longest = b"", 0
    for s in streams:
        own = samples[s.index]
        dts = [p.dts if p.dts is not None else p.pts or 0 for _, p in own]
        steps = [max(0, b - a) for a, b in zip(dts, dts[1:], strict=False)]
        steps.append(own[-1][1].duration or (steps[-1] if steps else 0)) if own else None
        total = sum(steps)
        longest = max(longest, total * 1000 * s.tb[0] // s.tb[1])
        shifts = [(p.pts if p.pts is not None else d) - d for (_, p), d in zip(own, dts, strict=True)]
        if s.media_type == "video":
            entry = bytes(6) + b"\0\1" + bytes(16) + struct.pack(">HHIIIH", s.width, s.height, 0x480000, 0x480000, 0, 1) + bytes(32) + b"\0\x18\xff\xff"
            inner = box(b"avcC", s.extra) if s.codec == "h264" and s.extra else b""
            media = full(b"vmhd", bytes(8))
        else:
            entry = bytes(6) + b"\0\1" + bytes(8) + struct.pack(">HHII", s.channels, s.bits or 16, 0, (s.rate & 0xFFFF) << 16)
            inner = box(b"esds", s.extra) if s.extra else b""
            media = full(b"smhd", bytes(4))
        runs = lambda values: [(sum(1 for _ in g), k) for k, g in __import__("itertools").groupby(values)]
        table = lambda name, rows, kind: full(name, struct.pack(">I", len(rows)), *(struct.pack(">" + kind, *r) for r in rows))
        stbl = full(b"stsd", struct.pack(">I", 1), box(names[s.codec], entry, inner)) + table(b"stts", runs(steps), "II")
        if any(shifts):
            stbl += table(b"ctts", runs(shifts), "Ii")
        if not all(p.key for _, p in own):
            stbl += table(b"stss", [(i,) for i, (_, p) in enumerate(own, 1) if p.key], "I")
        stbl += table(b"stsc", [(1, 1, 1)] if own else [], "III") + full(b"stsz", struct.pack(">II", 0, len(own)), *(struct.pack(">I", len(p.data)) for _, p in own)) + table(b"stco", [(a,) for a, _ in own], "I")
        kind = {"video": b"vide", "audio": b"soun"}.get(s.media_type, b"text")
        mdia = box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, s.tb[1] // s.tb[0], total, 0x55C4, 0)), full(b"hdlr", bytes(4), kind, bytes(12), b"\0"), box(b"minf", media, box(b"dinf", full(b"dref", struct.pack(">I", 1), box(b"url ", b"\0\0\0\1"))), box(b"stbl", stbl)))
        tkhd = box(b"tkhd", b"\0\0\0\7", struct.pack(">IIIII", 0, 0, s.index + 1, 0, total * 1000 * s.tb[0] // s.tb[1]), bytes(16), matrix, struct.pack(">II", s.width << 16, s.height << 16))
        traks += box(b"trak", tkhd, mdia)
    mvhd = full(b"mvhd", struct.pack(">IIIIIH", 0, 0, 1000, longest, 0x10000, 0x100), bytes(10), matrix, bytes(24), struct.pack(">I", len(streams) + 1))
    return bytes(out) + box(b"moov", mvhd, traks)


#: Codes of video streams in AVI files.
AVI_VIDEO = {b"H264": "h264", b"h264": "h264", b"avc1": "h264", b"XVID": "mpeg4", b"DIVX": "mpeg4", b"DX50": "mpeg4", b"FMP4": "mpeg4", b"MJPG": "mjpeg", bytes(4): "rawvideo"}


def demux_avi(data: bytes) -> Media:
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    streams, packets, keys, movi = [], [], {}, None

    def header(a, b):
        s = Stream(len(streams), "data", "none", (1, 1))
        for name, at, size in _chunks(data[:b], a, "<"):
            if name == b"strh":
                kind, code = data[at : at + 4], data[at + 4 : at + 8]
                s.media_type = {b"vids": "video", b"auds": "audio"}.get(kind, "data")
                scale, rate = struct.unpack("<II", data[at + 20 : at + 28])
                s.duration = int.from_bytes(data[at + 32 : at + 36], "little") or None
                s.tb, s.codec = (scale or 1, rate or 1), AVI_VIDEO.get(code, "none") if kind == b"vids" else "none"
            elif name == b"strf" and s.media_type == "video":
                s.width, s.height = (abs(x) for x in struct.unpack("<ii", data[at + 4 : at + 12]))
                s.codec = AVI_VIDEO.get(data[at + 16 : at + 20], s.codec) if s.codec == "none" else s.codec
            elif name == b"strf" and s.media_type == "audio":
                tag, s.channels, s.rate, _, _, s.bits = struct.unpack("<HHIIHH", data[at : at + 16])
                s.codec = {0x55: "mp3", 0xFF: "aac", 0x2000: "ac3"}.get(tag) or WAV_CODECS.get((tag, s.bits), "none")
        streams.append(s)

    for name, at, size in _chunks(data, 12, "<"):
        kind = data[at : at + 4]
        if name == b"LIST" and kind == b"hdrl":
            for n, x, m in _chunks(data[: at + size], at + 4, "<"):
                if n == b"LIST" and data[x : x + 4] == b"strl":
                    header(x + 4, x + m)
        elif name == b"LIST" and kind == b"movi":
            movi = (at, at + size)
        elif name == b"idx1":
            for i in range(0, size - 15, 16):
                _, flags, offset, _ = struct.unpack("<4sIII", data[at + i : at + i + 16])
                keys[offset] = bool(flags & 0x10)
    counts = [0] * len(streams)

    def chunks(a, b):
        for name, at, size in _chunks(data[:b], a, "<"):
            if name == b"LIST" and data[at : at + 4] == b"rec ":
                chunks(at + 4, at + size)
            elif name[:2].isdigit() and int(name[:2]) < len(streams):
                s = streams[int(name[:2])]
                body = data[at : at + size]
                n = len(body) // (s.channels * s.bits // 8) if s.codec.startswith("pcm") and s.channels * s.bits else 1
                t = counts[s.index]
                packets.append(Packet(s.index, t, t, body, n, keys.get(at - 8 - movi[0], keys.get(at - 8, True)), at - 8))
                counts[s.index] += n

    if movi is None:
        raise ValueError("no movi list")
    chunks(movi[0] + 4, movi[1])
    return streams, packets


def mux_avi(streams: list[Stream], packets: list[Packet]) -> bytes:
    chunk = lambda name, body: name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)
    heads = b""
    for s in streams:
        n = sum(p.stream == s.index for p in packets)
        if s.media_type == "video":
            code = {v: k for k, v in reversed(AVI_VIDEO.items())}[s.codec]
            form = struct.pack("<IiiHH4sIIIII", 40, s.width, s.height, 1, 24, code, 0, 0, 0, 0, 0)
        elif s.codec.startswith("pcm"):
            tag, bits = {v: k for k, v in WAV_CODECS.items()}[s.codec]
            code, block = bytes(4), s.channels * bits // 8
            form = struct.pack("<HHIIHH", tag, s.channels, s.rate, s.rate * block, block, bits)
        else:
            raise ValueError(f"{s.codec} doesn't go into AVI")
        head = (b"vids" if s.media_type == "video" else b"auds") + code + struct.pack("<IHHIIIIIIIIHHHH", 0, 0, 0, 0, s.tb[0], s.tb[1], 0, n, 0, 0xFFFFFFFF, 0, 0, 0, s.width, s.height)
        heads += chunk(b"LIST", b"strl" + chunk(b"strh", head) + chunk(b"strf", form))
    main = struct.pack("<14I", 0, 0, 0, 0x10, len(packets), 0, len(streams), 0, max((s.width for s in streams), default=0), max((s.height for s in streams), default=0), 0, 0, 0, 0)
    body, index = b"movi", b""
    for p in packets:
        name = b"%02d" % p.stream + (b"dc" if streams[p.stream].media_type == "video" else b"wb")
        index += struct.pack("<4sIII", name, 0x10 if p.key else 0, len(body), len(p.data))
        body += chunk(name, p.data)
    whole = b"AVI " + chunk(b"LIST", b"hdrl" + chunk(b"avih", main) + heads) + chunk(b"LIST", body) + chunk(b"idx1", index)
    return b"RIFF" + struct.pack("<I", len(whole)) + whole


DEMUXERS: dict[str, Callable[[bytes], Media]] = {"wav": demux_wav, "aiff": demux_aiff, "flac": demux_flac, "ogg": demux_ogg, "mp4": demux_mp4, "mp3": demux_mp3, "matroska": demux_mkv, "aac": demux_adts, "flv": demux_flv, "mpegts": demux_ts, "avi": demux_avi, "m4v": demux_m4v, "h264": demux_h264}
MUXERS: dict[str, Callable[[list[Stream], list[Packet]], bytes]] = {"wav": mux_wav, "aiff": mux_aiff, "flac": mux_flac, "mp4": mux_mp4, "matroska": mux_mkv, "webm": mux_webm, "ogg": mux_ogg, "flv": mux_flv, "mpegts": mux_ts, "avi": mux_avi, "aac": mux_adts, "mp3": mux_mp3}


def demux(data: bytes, name: str | None = None, forced: str | None = None) -> tuple[str, list[Stream], list[Packet]]:
    """(format, streams, packets) of a file, its format probed unless forced."""
    fmt = forced or probe_bytes(data[: 256 * 1024], name)[0]
    if fmt not in DEMUXERS:
        raise ValueError("unknown format" if fmt is None else f"{fmt} can't be read")
    return fmt, *DEMUXERS[fmt](data)
