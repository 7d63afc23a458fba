"""Names of codecs, sample formats and container codes as lookups on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

C = Column | str

#: Codes of containers -> codec; codes that aren't here are 'none'.
FOURCC = {
    "avc1": "h264", "avc3": "h264", "h264": "h264", "hvc1": "h265", "hev1": "h265", "vp08": "vp8", "vp09": "vp9", "av01": "av1", "mp4v": "mpeg4", "mjpa": "mjpeg", "mjpb": "mjpeg",
    "mp4a": "aac", "Opus": "opus", "fLaC": "flac", "alac": "alac", "ac-3": "ac3", "ec-3": "eac3", ".mp3": "mp3",
}
STREAM_TYPES = {0x01: "mpeg1video", 0x02: "mpeg2video", 0x1B: "h264", 0x24: "h265", 0x03: "mp3", 0x04: "mp3", 0x0F: "aac", 0x11: "aac", 0x81: "ac3", 0x87: "eac3", 0x86: "dts"}
CODEC_IDS = {
    "V_MPEG4/ISO/AVC": "h264", "V_MPEGH/ISO/HEVC": "h265", "V_VP8": "vp8", "V_VP9": "vp9", "V_AV1": "av1", "V_MPEG4/ISO/SP": "mpeg4", "V_MPEG4/ISO/ASP": "mpeg4", "V_MPEG4/ISO/AP": "mpeg4",
    "V_MPEG1": "mpeg1video", "V_MPEG2": "mpeg2video", "V_THEORA": "theora", "V_MS/VFW/FOURCC": "rawvideo", "A_AAC": "aac", "A_MPEG/L3": "mp3", "A_MPEG/L2": "mp2", "A_OPUS": "opus",
    "A_OPUS/EXPERIMENTAL": "opus", "A_VORBIS": "vorbis", "A_FLAC": "flac", "A_ALAC": "alac", "A_AC3": "ac3", "A_EAC3": "eac3", "A_DTS": "dts", "A_PCM/INT/LIT": "pcm_s16le",
    "A_PCM/INT/BIG": "pcm_s16be", "A_PCM/FLOAT/IEEE": "pcm_f32le", "S_TEXT/UTF8": "ass", "S_TEXT/SSA": "ass", "S_TEXT/ASS": "ass", "S_TEXT/WEBVTT": "webvtt",
}
AVI_HANDLERS = {
    "H264": "h264", "X264": "h264", "AVC1": "h264", "H265": "h265", "HEVC": "h265", "HVC1": "h265", "VP80": "vp8", "VP90": "vp9", "AV01": "av1", "MP4V": "mpeg4", "XVID": "mpeg4",
    "DIVX": "mpeg4", "MJPG": "mjpeg", "JPEG": "mjpeg", "THEO": "theora",
}
WAV_TAGS = {(1, 8): "pcm_u8", (1, 16): "pcm_s16le", (1, 24): "pcm_s24le", (1, 32): "pcm_s32le", (3, 32): "pcm_f32le"}
COMPRESSED_TAGS = {0x50: "mp3", 0x55: "mp3", 0x160: "aac"}
#: Codecs that can be asked for by name, and the sample format that an encoder of each takes.
ENCODERS = ("pcm_u8", "pcm_s16le", "pcm_s16be", "pcm_s24le", "pcm_s32le", "pcm_f32le", "rawvideo", "aac", "flac", "mp3")
SAMPLE_FORMATS = {"pcm_u8": "u8", "pcm_s16le": "s16", "pcm_s16be": "s16", "pcm_s24le": "s32", "pcm_s32le": "s32", "pcm_f32le": "f32", "aac": "f32", "flac": "s16"}
SAMPLE_BITS = {"u8": 8, "s16": 16, "s32": 32, "flt": 32, "dbl": 64}
LONG_NAMES = {"pcm_s16le": "PCM signed 16-bit little-endian"}
TAGS = {"pcm_s16le": ("[1][0][0][0]", "0x0001")}
#: The flags of a stream's disposition, all 0 where nothing else is known.
DISPOSITION = (
    "default", "dub", "original", "comment", "lyrics", "karaoke", "forced", "hearing_impaired", "visual_impaired", "clean_effects",
    "attached_pic", "timed_thumbnails", "non_diegetic", "captions", "descriptions", "metadata", "dependent", "still_image", "multilayer",
)


def _c(x: C) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lookup(key: C, table: dict, default=None) -> Column:
    """table[key]; the default, or null, for keys that it doesn't hold."""
    pairs = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    found = F.try_element_at(pairs, _c(key))
    return found if default is None else F.coalesce(found, F.lit(default))


def codec_of_fourcc(code: C) -> Column:
    return lookup(code, FOURCC, "none")


def codec_of_stream_type(kind: C) -> Column:
    return lookup(_c(kind).cast("int"), STREAM_TYPES, "none")


def codec_of_id(text: C) -> Column:
    return lookup(text, CODEC_IDS, "none")


def codec_of_handler(handler: C, compression: C) -> Column:
    """Codec of an AVI video stream: by its handler, else by the compression field's four characters; 0 is raw video."""
    n = _c(compression).cast("long")
    letters = F.concat(*(F.char(F.shiftright(n, 8 * k).bitwiseAND(F.lit(255))) for k in range(4)))
    inner = {k: v for k, v in AVI_HANDLERS.items() if k in ("H264", "AVC1", "HEVC", "HVC1", "VP80", "VP90", "MJPG", "MP4V", "XVID", "DIVX")} | {"DX50": "mpeg4"}
    named = lookup(F.upper(F.trim(F.regexp_replace(_c(handler), "\x00+$", ""))), AVI_HANDLERS)
    return F.coalesce(named, F.when(n == 0, F.lit("rawvideo")).otherwise(lookup(F.upper(letters), inner, "none")))


def codec_of_wav_tag(tag: C, bits: C) -> Column:
    """Codec of a WAV format tag; null where the tag, or its bits, aren't supported."""
    pcm = lookup(F.concat_ws("/", _c(tag).cast("string"), _c(bits).cast("string")), {f"{a}/{b}": v for (a, b), v in WAV_TAGS.items()})
    return F.coalesce(pcm, lookup(_c(tag).cast("int"), COMPRESSED_TAGS))


def codec_of_name(name: C) -> Column:
    """The codec that a name asks for, in any case; pcm_s16le for names that nothing is known of."""
    low = F.lower(_c(name))
    return F.when(low.isin(*ENCODERS), low).otherwise(F.lit("pcm_s16le"))


def sample_format_of(codec: C) -> Column:
    return lookup(codec, SAMPLE_FORMATS)


def bits_of_sample_format(fmt: C) -> Column:
    return lookup(fmt, SAMPLE_BITS)


def long_name_of(codec: C) -> Column:
    return lookup(codec, LONG_NAMES)


def tag_of(codec: C) -> Column:
    """struct<text,value> of the codec's tag; null if it isn't known."""
    text, value = (lookup(codec, {k: v[i] for k, v in TAGS.items()}) for i in (0, 1))
    return F.when(text.isNotNull(), F.struct(text.alias("text"), value.alias("value")))


def disposition() -> Column:
    """map of the disposition's flags, all 0."""
    return F.create_map(*(F.lit(x) for name in DISPOSITION for x in (name, 0)))
