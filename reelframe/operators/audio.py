"""Audio kernels on frames whose samples are arrays of doubles (interleaved if there are several channels).

All but the equaliser are higher-order array expressions: they stay in the JVM, need no shuffle and prune with the scan.
Integer formats round half away from zero and saturate.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timebase import fade_gain

#: Full scale of the integer sample formats.
SCALE = {"u8": 128.0, "s16": 32768.0, "s32": 2147483648.0}


def _each(samples: Column | str, f) -> Column:
    return F.transform(F.col(samples) if isinstance(samples, str) else samples, f)


def to_int(x: Column, fmt: str) -> Column:
    """A double in -1..1 as an integer sample of the format: rounded half away from zero, clamped."""
    full = SCALE[fmt]
    low, high = (0.0, 255.0) if fmt == "u8" else (-full, full - 1)
    value = F.round(x * full) + (128 if fmt == "u8" else 0)
    return F.greatest(F.lit(low), F.least(F.lit(high), value)).cast("long")


def to_float(x: Column, fmt: str) -> Column:
    """An integer sample of the format as a double in -1..1."""
    return (x - (128 if fmt == "u8" else 0)) / SCALE[fmt]


def convert(samples: Column | str, source: str, target: str) -> Column:
    """Samples in another format; f32 and f64 are doubles in -1..1."""
    if source == target:
        return _each(samples, lambda x: x)
    floats = (lambda x: x) if source.startswith("f") else (lambda x: to_float(x, source))
    ints = (lambda x: x) if target.startswith("f") else (lambda x: to_int(x, target))
    return _each(samples, lambda x: ints(floats(x)))


def volume(samples: Column | str, gain: float, fmt: str = "f32") -> Column:
    """Samples times gain; integer formats are rounded and clamped, floats aren't. u8 isn't supported."""
    if fmt == "u8":
        raise ValueError("u8 has no volume")
    if fmt.startswith("f"):
        return _each(samples, lambda x: x * F.lit(gain))
    full = SCALE[fmt]
    return _each(samples, lambda x: F.greatest(F.lit(-full), F.least(F.lit(full - 1), F.round(x * F.lit(gain)))).cast("long"))


def volume_db(samples: Column | str, db: float, fmt: str = "f32") -> Column:
    return volume(samples, 10 ** (db / 20), fmt)


def fade(samples: Column | str, time: Column, start: float, duration: float, fade_in: bool, fmt: str = "f32") -> Column:
    """Samples under one fade gain for the whole frame, from the frame's time."""
    gain = fade_gain(time, start, duration, fade_in)
    out = (lambda x: x * gain) if fmt.startswith("f") else (lambda x: F.round(x * gain).cast("long"))
    return _each(samples, out)


def mean_square(samples: Column | str) -> Column:
    s = F.col(samples) if isinstance(samples, str) else samples
    return F.aggregate(s, F.lit(0.0), lambda a, x: a + x * x) / F.size(s)


def loudness(square: Column) -> Column:
    """Loudness of a mean square, unweighted; silence is bounded below."""
    return F.lit(-0.691) + 10 * F.log10(F.greatest(square, F.lit(1e-10)))


def loudnorm(frames: DataFrame, target: float = -23.0, peak: float = -1.0) -> DataFrame:
    """Frames (stream, frame_no, samples) with lufs and gain of the running loudness, and samples under that gain.

    The loudness covers all frames of the stream up to and with the current one; the result is clamped to the peak. A
    stream may be as long as the whole table: its frames are cut into runs of 4,096 numbers, whose sums (a row each) are
    added up first, so that no task has more than a run of samples at once. Repeated frame numbers are as one place.
    """
    limit = 10 ** (peak / 20)
    energy = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x * x)
    rows = frames.withColumns({"_run": F.floor(F.col("frame_no") / 4096), "_energy": energy, "_count": F.size("samples").cast("long")})
    sums = rows.groupBy("stream", "_run").agg(F.sum("_energy").alias("_e"), F.sum("_count").alias("_n"))
    before = Window.partitionBy("stream").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("stream", "_run", F.coalesce(F.sum("_e").over(before), F.lit(0.0)).alias("_e"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n"))
    w = Window.partitionBy("stream", "_run").orderBy("frame_no").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(sums, ["stream", "_run"])
    out = out.withColumn("lufs", loudness((F.col("_e") + F.sum("_energy").over(w)) / (F.col("_n") + F.sum("_count").over(w))))
    out = out.select(*frames.columns, "lufs")
    out = out.withColumn("gain", F.pow(F.lit(10.0), (F.lit(target) - F.col("lufs")) / 20))
    return out.withColumn("samples", _each("samples", lambda x: F.greatest(F.lit(-limit), F.least(F.lit(limit), x * F.col("gain")))))


def mix(samples: Column | str, source: int, target: int) -> Column:
    """Interleaved samples with another number of channels: one to many copies, many to one averages, else channels are
    taken over in order and missing ones are silent."""
    s = F.col(samples) if isinstance(samples, str) else samples
    if source == target:
        return s
    frames = F.sequence(F.lit(0), (F.size(s) / source).cast("int") - 1)
    at = lambda i, c: F.element_at(s, i * source + c + 1)
    if target == 1:
        return F.transform(frames, lambda i: sum((at(i, c) for c in range(1, source)), at(i, 0)) / source)
    pick = lambda i: F.array(*(at(i, 0 if source == 1 else c) if source == 1 or c < source else F.lit(0.0) for c in range(target)))
    return F.flatten(F.transform(frames, pick))


def mix_any(samples: Column | str, source: Column, target: int) -> Column:
    """mix() where the number of channels is a column, so that frames of all kinds go through one expression."""
    s = F.col(samples) if isinstance(samples, str) else samples
    frames = F.when(F.size(s) >= source, F.sequence(F.lit(0), (F.size(s) / source).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    at = lambda i, c: F.get(s, (i * source + c).cast("int"))
    if target == 1:
        mixed = F.transform(frames, lambda i: F.aggregate(F.sequence(F.lit(1), source), F.lit(0.0), lambda a, c: a + at(i, c - 1)) / source)
    else:
        pick = lambda i: F.array(*(F.when(source == 1, at(i, F.lit(0))).when(source > c, at(i, F.lit(c))).otherwise(F.lit(0.0)) for c in range(target)))
        mixed = F.flatten(F.transform(frames, pick))
    return F.when(source == target, s).otherwise(mixed)


_CENTRE, _SIDE, _LFE = 0.70710677, 0.5, 0.1


def downmix(samples: Column | str, source: int) -> Column:
    """5.1 (6) or 7.1 (8 channels) to stereo: centre and surrounds mixed in, the low-frequency channel dropped, no clamp."""
    s = F.col(samples) if isinstance(samples, str) else samples
    at = lambda i, c: F.element_at(s, i * source + c + 1)

    def pair(i):
        side = [at(i, k) + at(i, 2) * _CENTRE + at(i, 4 + k) * _CENTRE for k in (0, 1)]
        return F.array(*(x + at(i, 6 + k) * _SIDE if source == 8 else x for k, x in enumerate(side)))

    return F.flatten(F.transform(F.sequence(F.lit(0), (F.size(s) / source).cast("int") - 1), pair))


def upmix(samples: Column | str) -> Column:
    """Stereo to 5.1: the centre is the mean, the low-frequency channel a tenth of it, surrounds half of their sides."""
    s = F.col(samples) if isinstance(samples, str) else samples

    def six(i):
        left, right = F.element_at(s, 2 * i + 1), F.element_at(s, 2 * i + 2)
        centre = (left + right) * 0.5
        return F.array(left, right, centre, centre * _LFE, left * _SIDE, right * _SIDE)

    return F.flatten(F.transform(F.sequence(F.lit(0), (F.size(s) / 2).cast("int") - 1), six))


def resample(samples: Column | str, source_rate: int | Column, target_rate: int, channels: int | Column = 1) -> Column:
    """Linear interpolation of each frame by itself: ceil(n * target / source) samples, the last index clamped.

    The source rate and the number of channels may be columns.
    """
    s = F.col(samples) if isinstance(samples, str) else samples
    if isinstance(source_rate, Column) or isinstance(channels, Column):
        return _resample_any(s, F.lit(source_rate), target_rate, F.lit(channels))
    if source_rate == target_rate:
        return s
    n = (F.size(s) / channels).cast("int")
    count = F.ceil(n.cast("double") * target_rate / source_rate).cast("int")
    at = lambda i, c: F.element_at(s, (i * channels + c + 1).cast("int"))

    def one(i):
        pos = i * (source_rate / target_rate)
        low = F.floor(pos).cast("int")
        high = F.least(low + 1, n - 1)
        return F.array(*(at(low, c) + (at(high, c) - at(low, c)) * (pos - low) for c in range(channels)))

    return F.flatten(F.transform(F.sequence(F.lit(0), count - 1), one))


def _resample_any(s: Column, rate: Column, target: int, channels: Column) -> Column:
    n = (F.size(s) / channels).cast("int")
    count = F.ceil(n.cast("double") * target / rate).cast("int")
    at = lambda i, c: F.get(s, (i * channels + c).cast("int"))

    def one(i):
        pos = i * (rate.cast("double") / target)
        low = F.floor(pos).cast("int")
        high = F.least(low + 1, n - 1)
        return F.transform(F.sequence(F.lit(0), channels - 1), lambda c: at(low, c) + (at(high, c) - at(low, c)) * (pos - low))

    out = F.when(n > 0, F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), one))).otherwise(s)
    return F.when(rate == target, s).otherwise(out)


def peaking(frequency: float, gain_db: float, q: float, rate: int) -> tuple[float, float, float, float, float]:
    """Coefficients b0, b1, b2, a1, a2 of a peaking equaliser band."""
    a, w = 10 ** (gain_db / 40), 2 * math.pi * frequency / rate
    alpha = math.sin(w) / (2 * q)
    scale = 1 + alpha / a
    return (1 + alpha * a) / scale, -2 * math.cos(w) / scale, (1 - alpha * a) / scale, -2 * math.cos(w) / scale, (1 - alpha / a) / scale


def peaking_columns(frequency: Column, gain_db: Column, q: Column, rate: int) -> dict[str, Column]:
    """The same as columns."""
    a, w = F.pow(F.lit(10.0), gain_db / 40), frequency * (2 * math.pi) / rate
    alpha = F.sin(w) / (q * 2)
    scale = alpha / a + 1
    return {"b0": (alpha * a + 1) / scale, "b1": F.cos(w) * -2 / scale, "b2": (1 - alpha * a) / scale, "a1": F.cos(w) * -2 / scale, "a2": (1 - alpha / a) / scale}


class Biquad:
    """A two-pole filter over blocks: what a block gives is a matrix times its samples plus one times the state before.

    The state is the last two inputs and outputs of each channel.
    """

    def __init__(self, coefficients: tuple[float, float, float, float, float], block: int = 256):
        self.c, self.block = coefficients, block
        first = self._plain(np.r_[1.0, np.zeros(block - 1)], np.zeros(4))
        at = np.arange(block)[:, None] - np.arange(block)[None]
        self.inside = np.where(at >= 0, first[np.maximum(at, 0)], 0.0)
        self.before = np.stack([self._plain(np.zeros(block), np.eye(4)[k]) for k in range(4)], 1)

    def _plain(self, x: np.ndarray, state: np.ndarray) -> np.ndarray:
        (b0, b1, b2, a1, a2), (x1, x2, y1, y2), out = self.c, state, []
        for v in x.tolist():
            y = b0 * v + b1 * x1 + b2 * x2 - a1 * y1 - a2 * y2
            x2, x1, y2, y1 = x1, v, y1, y
            out.append(y)
        return np.array(out)

    def run(self, x: np.ndarray, state: np.ndarray) -> np.ndarray:
        """(n, channels) samples; state (4, channels) goes on."""
        out = np.empty_like(x)
        for at in range(0, len(x), self.block):
            part = x[at : at + self.block]
            n = len(part)
            y = out[at : at + n] = self.inside[:n, :n] @ part + self.before[:n] @ state
            state[:] = np.array([part[-1], part[-2] if n > 1 else state[0], y[-1], y[-2] if n > 1 else state[2]])
        return out


def equalize(frames: DataFrame, bands: list[tuple[float, float, float]], rate: int = 44100, channels: int = 1) -> DataFrame:
    """Frames (stream, frame_no, samples) through a cascade of peaking bands (frequency, gain_db, q).

    The filters' state runs through a stream, so each stream is folded in order, batch by batch: its rows come sorted to
    one task and only the state is kept between batches.
    """
    names, schema = frames.columns, frames.schema
    at, order, key = names.index("samples"), names.index("frame_no"), names.index("stream")
    filters = [Biquad(peaking(*b, rate)) for b in bands]

    def run(batches):
        stream, state = None, None
        for b in batches:
            out = []
            for k, s in zip(b.column(key).to_pylist(), b.column(at).to_pylist(), strict=True):
                if state is None or k != stream:
                    stream, state = k, np.zeros((len(filters), 4, channels))
                y = np.array(s, np.float64).reshape(-1, channels)
                for band, f in zip(state, filters, strict=True):
                    y = f.run(y, band) if len(y) else y
                out.append(y.reshape(-1))
            cols = list(b.columns)
            cols[at] = pa.array(out, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(cols, names=names)

    parts = int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return frames.repartition(parts, "stream").sortWithinPartitions("stream", names[order]).mapInArrow(run, schema)


def player_samples(samples: Column | str, fmt: str, nominal_bits: int | None = None) -> Column:
    """Samples as the player hears them: s32 scaled by its nominal bits, formats it doesn't know silent."""
    if fmt in ("f32", "f64"):
        return _each(samples, lambda x: x)
    if fmt == "s16":
        return _each(samples, lambda x: x / 32768.0)
    if fmt == "s32":
        full = float(1 << (nominal_bits - 1)) if nominal_bits and 1 <= nominal_bits < 32 else 2147483648.0
        return _each(samples, lambda x: x / full)
    return _each(samples, lambda x: x * 0.0)
