"""Column functions for rationals, timestamps, durations and their texts.

Times are `pts` (bigint, null where unknown) in units of num/den seconds. Nothing here moves data: every function maps
columns to a column inside code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

C = Column | str


def _c(x: C) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rational_double(num: C, den: C) -> Column:
    """num/den; NaN where den is 0."""
    return F.when(_c(den) == 0, F.lit(float("nan"))).otherwise(_c(num).cast("double") / F.nullif(_c(den), F.lit(0)))


def gcd(a: C, b: C) -> Column:
    """Greatest common divisor of two integers, by Euclid's steps (int needs 47 at most)."""
    start = F.struct(F.abs(_c(a).cast("long")).alias("a"), F.abs(_c(b).cast("long")).alias("b"))
    step = lambda s, _: F.struct(F.when(s["b"] == 0, s["a"]).otherwise(s["b"]).alias("a"), F.when(s["b"] == 0, F.lit(0).cast("long")).otherwise(s["a"] % F.nullif(s["b"], F.lit(0))).alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(47)), start, step)["a"]


def rational_reduce(num: C, den: C) -> Column:
    """struct<num,den> in lowest terms with a positive denominator; 0/0 stays."""
    g = gcd(num, den)
    sign = F.when(_c(den) < 0, F.lit(-1)).otherwise(F.lit(1))
    part = lambda x: F.when(g == 0, _c(x).cast("long")).otherwise((_c(x) / F.nullif(g, F.lit(0))).cast("long") * sign)
    return F.struct(part(num).alias("num"), part(den).alias("den"))


def rational_invert(num: C, den: C) -> Column:
    """struct<num,den> of den/num."""
    return F.struct(_c(den).cast("long").alias("num"), _c(num).cast("long").alias("den"))


def rational_multiply(num: C, den: C, other_num: C, other_den: C) -> Column:
    """struct<num,den> of the product, in lowest terms; as longs, so that ints don't overflow."""
    return rational_reduce(_c(num).cast("long") * _c(other_num), _c(den).cast("long") * _c(other_den))


_WRAP = 1 << 64


def rescale(pts: C, num: C, den: C, new_num: C, new_den: C) -> Column:
    """pts in the new time base, truncated toward zero; null where a base is invalid or pts is null.

    What doesn't fit in 64 bits wraps.
    """
    d = lambda x: _c(x).cast("decimal(19,0)")
    n = lambda x: F.lit(str(x)).cast("decimal(38,0)")
    top = ((d(pts) * d(num)).cast("decimal(38,0)") * d(new_den)).cast("decimal(38,0)")
    low = F.nullif((d(den) * d(new_num)).cast("decimal(38,0)"), n(0))
    whole = ((top - top % low) / low).cast("decimal(38,0)")
    rest = whole % n(_WRAP)
    signed = F.when(rest >= n(_WRAP // 2), rest - n(_WRAP)).when(rest < n(-_WRAP // 2), rest + n(_WRAP)).otherwise(rest)
    return signed.cast("decimal(20,0)").cast("long")


def seconds(pts: C, num: C, den: C) -> Column:
    """pts * (num / den), dividing first; NaN for an invalid base."""
    return _c(pts) * rational_double(num, den)


def seconds_multiplied(pts: C, num: C, den: C) -> Column:
    """pts * num / den, multiplying first; 0.0 for den = 0."""
    return F.when(_c(den) == 0, F.lit(0.0)).otherwise(_c(pts).cast("double") * _c(num) / F.nullif(_c(den), F.lit(0)))


def microseconds(pts: C, num: C, den: C) -> Column:
    """Whole microseconds of pts, truncated."""
    return rescale(pts, num, den, F.lit(1), F.lit(1_000_000))


def seconds_text(pts: C, num: C, den: C) -> Column:
    """'1.500000s', or NOPTS for null."""
    return F.when(_c(pts).isNull(), F.lit("NOPTS")).otherwise(F.format_string("%.6fs", seconds(pts, num, den)))


def from_db(db: C) -> Column:
    return F.pow(F.lit(10.0), _c(db) / 20)


def fade_gain(time: Column, start: float, duration: float, fade_in: bool) -> Column:
    """Gain of a linear fade at a time in seconds; a duration of 0 or less is no fade."""
    if duration <= 0:
        return F.lit(1.0)
    rise = F.when(time < start, F.lit(0.0)).when(time >= start + duration, F.lit(1.0)).otherwise((time - start) / duration)
    return rise if fade_in else 1 - rise


def _clock(text: Column, pattern: str, unit: int, scale: int) -> Column:
    part = lambda k: F.nullif(F.regexp_extract(text, pattern, k), F.lit("")).cast("long")
    rest = part(4)
    return F.when(rest < unit, ((part(1) * 60 + part(2)) * 60 + part(3)) * 1000 + rest * scale)


def srt_time(text: C) -> Column:
    """Milliseconds of HH:MM:SS,mmm; null if it isn't one or mmm is 1000 or more."""
    return _clock(F.trim(_c(text)), r"^([0-9]{1,9}):([0-9]{1,9}):([0-9]{1,9}),([0-9]{1,9})$", 1000, 1)


def ass_time(text: C) -> Column:
    """Milliseconds of H:MM:SS.cc; null if it isn't one or cc is 100 or more."""
    return _clock(F.trim(_c(text)), r"^([0-9]{1,9}):([0-9]{1,9}):([0-9]{1,9})\.([0-9]{1,9})$", 100, 10)


def msf_time(text: C) -> Column:
    """Seconds of MM:SS:FF at 75 frames a second."""
    part = lambda k: F.nullif(F.regexp_extract(F.trim(_c(text)), r"^([0-9]{1,9}):([0-9]{1,9}):([0-9]{1,9})$", k), F.lit("")).cast("double")
    return part(1) * 60 + part(2) + part(3) / 75


def sexagesimal(sec: C) -> Column:
    """[-]H:MM:SS.uuuuuu, rounded to microseconds."""
    us = F.round(F.abs(_c(sec)) * 1e6).cast("long")
    whole = F.floor(us / 1_000_000)
    body = F.format_string("%02d:%02d:%02d.%06d", F.floor(whole / 3600), F.floor(whole / 60) % 60, whole % 60, us % 1_000_000)
    return F.concat(F.when(_c(sec) < 0, F.lit("-")).otherwise(F.lit("")), body)


def time_value_text(sec: C, in_sexagesimal: bool = False, unit: bool = False) -> Column:
    """A time of a report: H:MM:SS.uuuuuu if asked for, else six decimals, with its unit if asked for."""
    return sexagesimal(sec) if in_sexagesimal else F.format_string("%.6f s" if unit else "%.6f", _c(sec))


def rate_text(rate: C, base: int = 1000, unit: bool = True, prefix: bool = True) -> Column:
    """A bit rate of a report: 1.500 Mb/s; base 1000 or 1024 (Kib, Mib, Gib). Without unit the space goes; without
    prefix it is the whole number."""
    if not prefix:
        return F.concat(_c(rate).cast("long").cast("string"), F.lit(" b/s" if unit else ""))
    names = ("", "k", "M", "G") if base == 1000 else ("", "Ki", "Mi", "Gi")
    r, gap = _c(rate).cast("double"), " " if unit else ""
    out = F.format_string(f"%.3f{gap}{names[3]}b/s", r / base**3)
    for k in (2, 1, 0):
        out = F.when(r < base ** (k + 1), F.format_string(f"%.3f{gap}{names[k]}b/s", r / base**k)).otherwise(out)
    return out


def float_text(x: C) -> Column:
    """Whole numbers without decimals, others with up to six, trailing zeros cut."""
    v = _c(x)
    return F.when(v == F.floor(v), F.format_string("%d", v.cast("long"))).otherwise(F.regexp_replace(F.format_string("%.6f", v), r"\.?0+$", ""))


def hms_millis(sec: C) -> Column:
    """HH:MM:SS.mmm of a time in seconds, truncated; negative times are 0."""
    ms = F.floor(F.greatest(_c(sec), F.lit(0.0)) * 1000)
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def progress_text(sec: C, total: C) -> Column:
    """Time played of total time; an unknown total is dashes."""
    return F.concat(hms_millis(sec), F.lit("/"), F.when(_c(total) > 0, hms_millis(total)).otherwise(F.lit("--:--:--.---")))


def volume_text(level: C, muted: C) -> Column:
    return F.when(_c(muted), F.lit("MUTE")).otherwise(F.format_string("VOL %d%%", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), _c(level))) * 100).cast("long")))


def parse_rate(text: C) -> Column:
    """struct<num,den> of a/b, or of a decimal in thousandths; null unless both are positive."""
    t = F.trim(_c(text))
    num = F.when(t.contains("/"), F.regexp_extract(t, r"^([0-9]{1,9})/([0-9]{1,9})$", 1).try_cast("int")).otherwise((t.try_cast("double") * 1000).try_cast("int"))
    den = F.when(t.contains("/"), F.regexp_extract(t, r"^([0-9]{1,9})/([0-9]{1,9})$", 2).try_cast("int")).otherwise(F.lit(1000))
    return F.when((num > 0) & (den > 0), F.struct(num.alias("num"), den.alias("den")))


def syncsafe(value: C) -> Column:
    """The integer whose four 7-bit groups stand in the bytes of value (an unsigned 32-bit number as a long)."""
    v = _c(value)
    return sum(((F.shiftrightunsigned(v, 8 * k).bitwiseAND(F.lit(127))) * (1 << (7 * k)) for k in range(4)), F.lit(0).cast("long"))


def pes_timestamp(value: C) -> Column:
    """The 33-bit time in the five bytes (as a long) of a PES header: 3, 15 and 15 bits, each closed by a marker bit."""
    v = _c(value)
    bits = lambda low, n: F.shiftrightunsigned(v, low).bitwiseAND(F.lit((1 << n) - 1))
    return bits(33, 3) * (1 << 30) + bits(17, 15) * (1 << 15) + bits(1, 15)
