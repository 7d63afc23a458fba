"""Transcoding as one plan: read, trim, decode, filter, resample, encode, mux.

Steps are recorded and then put together so that trimming sits below decoding, steps that change nothing are left out,
and neighbouring volumes of float samples are one.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import EXTENSIONS, parse_filter_chain
from ..functions.timebase import seconds
from ..operators import audio as A
from ..operators import packets as P
from ..sources import media as M


def container_of(name: str) -> str:
    """The format that a name means: its own, or that of a file name's extension; a ValueError if none can be written."""
    found = name if name in M.MUXERS else next((fmt for fmt, exts in EXTENSIONS.items() if name.rsplit(".", 1)[-1].lower() in exts), None)
    if found not in M.MUXERS:
        raise ValueError(f"{name}: no format that can be written")
    return found


@dataclass
class Transcode:
    """Audio transcoding of media files; in_order: of codecs whose packets depend on the ones before (Vorbis)."""

    media: DataFrame
    ss: float = 0.0
    t: float | None = None
    rate: int | None = None
    channels: int | None = None
    filters: list[tuple] = field(default_factory=list)
    in_order: bool = False

    def trim(self, ss: float = 0.0, t: float | None = None) -> Transcode:
        self.ss, self.t = ss, t
        return self

    def volume(self, gain: float) -> Transcode:
        if self.filters and self.filters[-1][0] == "volume":
            gain *= self.filters.pop()[1]
        if gain != 1.0:
            self.filters.append(("volume", gain))
        return self

    def fade(self, kind: str, start: float, duration: float) -> Transcode:
        if duration > 0:
            self.filters.append(("fade", kind == "in", start, duration))
        return self

    def chain(self, text: str) -> Transcode:
        """Filters as text: volume=0.5 (or 6dB), fade=in:start:duration; unknown ones are skipped."""
        for f in parse_filter_chain(text):
            if f.name == "volume" and f.args:
                v = f.args[0]
                self.volume(10 ** (float(v[:-2]) / 20) if v.lower().endswith("db") else float(v))
            elif f.name in ("fade", "afade") and len(f.args) >= 3:
                self.fade(f.args[0], float(f.args[1]), float(f.args[2]))
        return self

    def resample(self, rate: int | None = None, channels: int | None = None) -> Transcode:
        self.rate, self.channels = rate, channels
        return self

    def frames(self) -> DataFrame:
        """Decoded and filtered frames, of any rate and number of channels; packets that can't be decoded are left out."""
        p = P.trim_start(M.packets(self.media, coded=True).where("status = 'ok'"), self.ss)
        if self.t is not None:
            p = P.limit_duration(p, self.t, self.ss)
        decode = M.decode_in_order if self.in_order else M.decode_audio
        out = decode(p).where("status = 'ok'")
        time = seconds("pts", F.lit(1), F.col("rate"))
        for f in self.filters:
            s = A.volume("samples", f[1]) if f[0] == "volume" else A.fade("samples", time, f[2], f[3], f[1])
            out = out.withColumn("samples", s)
        if self.channels:
            out = out.withColumn("samples", A.mix_any("samples", F.col("channels"), self.channels)).withColumn("channels", F.lit(self.channels))
        if self.rate:
            out = out.withColumn("samples", A.resample("samples", F.col("rate"), self.rate, F.col("channels")))
            out = out.withColumn("pts", F.expr(f"pts * {self.rate} div rate")).withColumn("rate", F.lit(self.rate))
        return out.withColumn("nb_samples", (F.size("samples") / F.col("channels")).cast("int"))

    def copied(self, fmt: str) -> DataFrame:
        """(path, content) of the files in another container, packets as they are; trimming applies, filters don't."""
        fmt = container_of(fmt)
        p = P.trim_start(M.packets(self.media).where("status = 'ok'"), self.ss)
        if self.t is not None:
            p = P.limit_duration(p, self.t, self.ss)
        return M.mux(M.streams(self.media).where("status = 'ok'"), p, fmt)

    def files(self, codec: str, fmt: str) -> DataFrame:
        """(path, content) of the transcoded files, in a format by its name or by that of a file."""
        fmt = container_of(fmt)
        frames = self.frames()
        bits = {"pcm_u8": 8, "pcm_s24le": 24, "pcm_s32le": 32, "pcm_f32le": 32}.get(codec, 16)
        heads = frames.groupBy("path").agg(F.max("rate").alias("rate"), F.max("channels").alias("channels"))
        streams = heads.select("path", F.lit(0).alias("index"), F.lit("audio").alias("media_type"), F.lit(codec).alias("codec"), F.lit(1).alias("tb_num"), F.col("rate").alias("tb_den"), F.lit(None).cast("binary").alias("extra"), "rate", "channels", F.lit(bits).alias("bits"), F.lit(0).alias("width"), F.lit(0).alias("height"))
        return M.mux(streams, M.encode_audio(frames, codec), fmt)
