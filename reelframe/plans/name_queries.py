"""Queries on names, codes and option texts: fixed cases, dealt over a table's rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions import bits as B
from ..functions import headers as H
from ..functions import names as N
from ..functions import text as X
from ..functions import timebase as T
from ..operators import report as R
from ..registry import codecs, formats
from ..sources.containers import amf_number, mp3_vbr, vorbis_comments
from ..sources.probe import probe_bytes
from . import views as V
from .registry import query


def _sql(v) -> str:
    return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"CAST({v} AS DOUBLE)" if isinstance(v, float) else str(v)


def _cases(name: str, cases: list[tuple], expr) -> None:
    """A query that runs expr on the cases' inputs, in turn along the part table, against what they are known to give."""
    inputs, wants = [c[:-1] for c in cases], [c[-1] for c in cases]
    n, cols = len(cases), [f"a{i}" for i in range(len(inputs[0]))]
    pick = lambda values: "[" + ", ".join(map(_sql, values)) + f"][p_partkey % {n} + 1]"
    sql = "SELECT p_partkey, " + ", ".join(f"{pick([x[i] for x in inputs])} AS {c}" for i, c in enumerate(cols)) + f", {pick(wants)} AS found FROM part"

    def run(spark, d):
        at = (F.col("p_partkey") % n + 1).cast("int")
        rows = V.table(spark, d, "part").select("p_partkey", *(F.element_at(F.array(*(F.lit(x[i]) for x in inputs)), at).alias(c) for i, c in enumerate(cols)))
        return rows.withColumn("found", expr(*(F.col(c) for c in cols)))

    run.__name__ = name
    query(sql)(run)


def _python(f, kind="string"):
    """f on single values, as a column."""

    def column(*cols):
        @F.pandas_udf(kind)
        def run(*parts: pd.Series) -> pd.Series:
            return pd.Series([f(*x) for x in zip(*parts, strict=True)], dtype=object)

        return run(*cols)

    return column


_cases("codec_of_fourcc", [("avc1", "h264"), ("hev1", "h265"), ("mp4a", "aac"), ("Opus", "opus"), ("opus", "none"), (".mp3", "mp3"), ("mjpb", "mjpeg"), ("", "none")], N.codec_of_fourcc)
_cases("codec_of_stream_type", [(1, "mpeg1video"), (27, "h264"), (36, "h265"), (4, "mp3"), (17, "aac"), (6, "none"), (135, "eac3"), (0, "none")], N.codec_of_stream_type)
_cases("codec_of_id", [("V_VP9", "vp9"), ("A_PCM/INT/BIG", "pcm_s16be"), ("S_TEXT/SSA", "ass"), ("V_MPEG4/ISO/SP", "mpeg4"), ("v_vp9", "none"), ("A_DTS", "dts")], N.codec_of_id)
_cases("codec_of_handler", [("xvid", 0, "mpeg4"), ("", 0, "rawvideo"), ("zzzz", 0x34363248, "h264"), ("zzzz", 0x30355844, "mpeg4"), ("MJPG", 5, "mjpeg"), ("zzzz", 7, "none")], N.codec_of_handler)
_cases("codec_of_wav_tag", [(1, 16, "pcm_s16le"), (1, 24, "pcm_s24le"), (3, 32, "pcm_f32le"), (3, 64, None), (85, 0, "mp3"), (352, 16, "aac"), (1, 12, None)], N.codec_of_wav_tag)
_cases("codec_of_name", [("FLAC", "flac"), ("pcm_F32le", "pcm_f32le"), ("h264", "pcm_s16le"), ("", "pcm_s16le"), ("mp3", "mp3"), ("rawvideo", "rawvideo")], N.codec_of_name)
_cases("sample_format_of_codec", [("pcm_s24le", "s32"), ("aac", "f32"), ("flac", "s16"), ("mp3", None), ("pcm_u8", "u8")], N.sample_format_of)
_cases("bits_of_sample_format", [("u8", 8), ("s16", 16), ("flt", 32), ("dbl", 64), ("s32", 32), ("fltp", None)], N.bits_of_sample_format)
_cases("codec_long_name", [("pcm_s16le", "PCM signed 16-bit little-endian"), ("flac", None)], N.long_name_of)
_cases("codec_tag", [("pcm_s16le", "[1][0][0][0] 0x0001"), ("flac", None)], lambda c: F.when(N.tag_of(c).isNotNull(), F.concat_ws(" ", N.tag_of(c)["text"], N.tag_of(c)["value"])))
_cases("is_url_and_name", [("http://h/a/b.mp4?x=1", "true b.mp4"), ("https://h/", "true "), ("/data/a.wav", "false a.wav"), ("a.wav", "false a.wav"), ("ftp://h/x", "false x"), ("/data/dir/", "false dir"), ("HTTP://h/x", "false x")], lambda p: F.concat_ws(" ", X.is_url(p).cast("string"), X.file_name(p)))
_cases("filter_chain_parse", [("volume=0.5,fade=in:0:2", "volume(0.5) fade(in|0|2)"), (" a , ,b= ", "a() b()"), ("=x,crop=1:2:3:4", "crop(1|2|3|4)"), ("", "")], _python(lambda t: " ".join(f"{f.name}({'|'.join(f.args)})" for f in X.parse_filter_chain(t))))
_cases("parse_size", [("640x480", "640 480"), ("640X480", None), ("1x2x3", None), ("ax2", None), ("0x0", "0 0")], _python(lambda t: (s := X.parse_size(t)) and f"{s[0]} {s[1]}"))
_cases("output_format_parse", [("json", "json"), ("json=compact=1", "json compact=1"), ("csv:nk:p=0", "csv nk=1 p=0"), ("default=nw=1:nk=1", "default nk=1 nw=1")], _python(lambda t: " ".join([R.output_format(t)[0], *(f"{k}={v}" for k, v in sorted(R.output_format(t)[1].items()))])))
_cases("sheet_decoding", [("Käse 日本", "utf-8", "Käse 日本"), ("中文", "gbk", "中文"), ("Tür", "utf-16-le", "Tür"), ("Tür", "utf-16-be", "Tür"), ("plain", "utf-8", "plain")], _python(lambda t, e: X.decode_sheet({"utf-16-le": b"\xff\xfe", "utf-16-be": b"\xfe\xff"}.get(e, b"") + t.encode(e))))
_cases(
    "probe_signatures",
    [("1A45DFA3" + "00" * 12, "matroska 100"), ("FFF15080" + "017FFC" + "00" * 4 + "FFF15080", "aac 100"), ("47" + "00" * 187 + "47" + "00" * 187 + "47" + "00" * 187, "mpegts 100"), ("000001B0" + "00" * 12, "m4v 90"), ("00000167" + "64" * 8 + "00000165" + "80" * 8, "h264 100"), ("464C4143" + "00" * 12, None), ("FFFB9064" + "00" * 413 + "FFFB9064" + "00" * 413, "mp3 95"), ("545241434B2046494C45" + "20" * 6, "cue 100")],
    _python(lambda h: (r := probe_bytes(bytes.fromhex(h))) and r[0] and f"{r[0]} {r[1]}"),
)


def _comments(text: str) -> str:
    fields = [x.encode() for x in text.split(";") if x]
    block = bytes(4) + len(fields).to_bytes(4, "little") + b"".join(len(x).to_bytes(4, "little") + x for x in fields)
    return " ".join(f"{k}={v}" for k, v in sorted(vorbis_comments(block).items()))


_cases("vorbis_comment_parse", [("TITLE=A;artist=b=c;none", "artist=b=c title=A"), ("x=1;X=2", "x=2"), ("", "")], _python(_comments))


@query("SELECT p_partkey, name, 0 AS flag FROM part, (VALUES " + ", ".join(f"('{n}')" for n in N.DISPOSITION) + ") d(name)")
def disposition_flags(spark, d):
    return V.table(spark, d, "part").select("p_partkey", F.explode(N.disposition()).alias("name", "flag"))


@query("SELECT p_partkey, CAST(p_partkey AS BIGINT) AS inv_num, CAST(p_size AS BIGINT) AS inv_den, CAST(a // gcd(a, b) AS BIGINT) AS num, CAST(b // gcd(a, b) AS BIGINT) AS den FROM (SELECT *, p_size * 6 * 7 AS a, p_partkey * (p_size + 1) AS b FROM part)")
def rational_arithmetic(spark, d):
    inv, mul = T.rational_invert("p_size", "p_partkey"), T.rational_multiply(F.col("p_size") * 6, "p_partkey", F.lit(7), F.col("p_size") + 1)
    return V.table(spark, d, "part").select("p_partkey", inv["num"].alias("inv_num"), inv["den"].alias("inv_den"), mul["num"].alias("num"), mul["den"].alias("den"))


@query("""WITH v AS (SELECT o_orderkey, (CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END) * (CAST(9000000000000000000 AS HUGEINT) - o_orderkey * 1000003) AS pts FROM orders),
    q AS (SELECT o_orderkey, CAST(pts AS BIGINT) AS pts, pts * 1001 // 30 AS q FROM v), r AS (SELECT *, q % 18446744073709551616 AS r FROM q)
    SELECT o_orderkey, pts, CAST(CASE WHEN r >= 9223372036854775808 THEN r - 18446744073709551616 WHEN r < -9223372036854775808 THEN r + 18446744073709551616 ELSE r END AS BIGINT) AS rescaled FROM r""")
def rescale_wraps(spark, d):
    """Times whose rescaled value doesn't fit in 64 bits."""
    sign = F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(-1)
    rows = V.table(spark, d, "orders").select("o_orderkey", (sign * (F.lit(9_000_000_000_000_000_000) - F.col("o_orderkey") * 1_000_003)).alias("pts"))
    return rows.withColumn("rescaled", T.rescale("pts", F.lit(1001), F.lit(30), F.lit(1), F.lit(1)))


@query("SELECT c_custkey, printf('%.6f', abs(c_acctbal)) AS plain, printf('%.6f s', abs(c_acctbal)) AS with_unit FROM customer")
def time_value_text(spark, d):
    x = F.abs("c_acctbal")
    return V.table(spark, d, "customer").select("c_custkey", T.time_value_text(x).alias("plain"), T.time_value_text(x, unit=True).alias("with_unit"))


_MS = "CAST(floor(greatest({0}, 0) * 1000) AS BIGINT)"
_HMS = "printf('%02d:%02d:%02d.%03d', {0} // 3600000, {0} // 60000 % 60, {0} // 1000 % 60, {0} % 1000)"


@query(f"SELECT c_custkey, {_HMS.format('a')} || '/' || CASE WHEN t > 0 THEN {_HMS.format('b')} ELSE '--:--:--.---' END AS progress, CASE WHEN c_nationkey = 3 THEN 'MUTE' ELSE 'VOL ' || CAST(round(greatest(0, least(1, c_acctbal / 9000)) * 100) AS BIGINT) || '%' END AS volume FROM (SELECT *, c_nationkey - 2 AS t, {_MS.format('c_acctbal')} AS a, {_MS.format('CAST(c_nationkey - 2 AS DOUBLE)')} AS b FROM customer)")
def hud_text(spark, d):
    c = V.table(spark, d, "customer")
    total = (F.col("c_nationkey") - 2).cast("double")
    return c.select("c_custkey", T.progress_text("c_acctbal", total).alias("progress"), T.volume_text(F.col("c_acctbal") / 9000, F.col("c_nationkey") == 3).alias("volume"))


@query("SELECT o_orderkey, printf('%.3fGib/s', r / 1073741824.0) AS binary, CAST(o_orderkey AS VARCHAR) || ' b/s' AS plain FROM (SELECT o_orderkey, CAST(o_orderkey + 1 AS DOUBLE) * 4294967296 AS r FROM orders)")
def rate_value_text(spark, d):
    o = V.table(spark, d, "orders")
    return o.select("o_orderkey", T.rate_text((F.col("o_orderkey") + 1) * F.lit(4_294_967_296.0), 1024, unit=False).alias("binary"), T.rate_text("o_orderkey", prefix=False).alias("plain"))


@query("SELECT p_partkey, p_retailprice AS value, '00' AS tail FROM part")
def extended_double(spark, d):
    """Eighty-bit numbers: prices written and read back; the last byte of a price's mantissa is 0."""
    back = _python(lambda x: B.extended_double(B.extended_bytes(x)), "double")
    tail = _python(lambda x: B.extended_bytes(x)[-1:].hex())
    return V.table(spark, d, "part").select("p_partkey", back("p_retailprice").alias("value"), tail("p_retailprice").alias("tail"))


_V = "(event_id * event_id * 37)"


@query(f"""WITH v AS (SELECT event_id, {_V} AS v FROM events), n AS (SELECT *, CASE WHEN v < 127 THEN 1 WHEN v < 16383 THEN 2 WHEN v < 2097151 THEN 3 WHEN v < 268435455 THEN 4 WHEN v < 34359738367 THEN 5 ELSE 6 END AS n FROM v)
    SELECT event_id, lpad(printf('%x', v | (CAST(1 AS BIGINT) << (7 * n))), CAST(2 * n AS INT), '0') AS vint, repeat('0', length(bin(v + 1)) - 1) || bin(v + 1) AS golomb, v AS back FROM n""")
def coded_numbers(spark, d):
    """EBML numbers and Exp-Golomb bits of event numbers, and the numbers read back from both."""

    def golomb(v):
        w = B.BitWriter()
        n = (v + 1).bit_length()
        w.unary(n - 1) if n > 1 else w.bits(1, 1)
        w.bits(v + 1 - (1 << n - 1), n - 1)
        return format(w.value, f"0{w.size}b"), w.bytes()

    e = V.table(spark, d, "events").select("event_id", (F.col("event_id") * F.col("event_id") * 37).alias("v"))
    back = _python(lambda v: v if B.ebml_size(B.ebml_coded(v))[0] == v == B.BitReader(golomb(v)[1]).ue() else -1, "long")
    return e.select("event_id", _python(lambda v: B.ebml_coded(v).hex())("v").alias("vint"), _python(lambda v: golomb(v)[0])("v").alias("golomb"), back("v").alias("back"))


_cases("flv_script_number", [("00086475726174696F6E" + "00" + "4028800000000000", "duration", 12.25), ("77696474680040840000000000000006", "width", 640.0), ("776964746801", "width", None), ("", "height", None), ("68656967687400" + "BFF0000000000000", "height", None)], _python(lambda h, k: amf_number(bytes.fromhex(h), k), "double"))
_XING = "FFFB9064" + "00" * 32 + "58696E67"
_cases("mp3_vbr_tag", [(_XING + "00000001" + "00000064" + "4C414D45" + "00" * 17 + "240" + "1FF" + "00" * 30, "100 576 511"), (_XING + "0000000F" + "00000007" + "00" * 4 + "00" * 100 + "00" * 4 + "00" * 21 + "FFF000" + "00" * 9, "7 0 0"), ("FFFB9064" + "00" * 32 + "56425249" + "00" * 10 + "0000012C" + "00" * 8, "300 0 0"), ("FFFB9064" + "00" * 60, None)], _python(lambda h: (v := mp3_vbr(bytes.fromhex(h), {"channels": 2, "mpeg1": True})) and " ".join(map(str, v))))
_VPS = "40010C01FFFF016000000300000300000300000300" + "5D" + "AC09"
_cases("hevc_vps", [(_VPS, "0 1 1 1 0 93")], _python(lambda h: " ".join(str(int(v)) for v in H.hevc_vps(bytes.fromhex(h)).values())))
_cases("mpeg4_user_data", [("000001B2" + "58766964" + "0030" + "000001B6" + "10", "Xvid"), ("000001B0F5", "")], _python(lambda h: " ".join(H.mpeg4_user_data(bytes.fromhex(h)))))


@query("SELECT o_orderkey, o_orderkey * 77 % 65536 AS u16, o_orderkey * 70001 % 16777216 AS u24, CASE WHEN o_orderkey * 77 % 65536 >= 32768 THEN o_orderkey * 77 % 65536 - 65536 ELSE o_orderkey * 77 % 65536 END AS i16 FROM orders")
def typed_reads(spark, d):
    """Numbers read from bytes that they were written to: two little-endian, three big-endian."""
    key = F.col("o_orderkey")
    text = F.concat(F.lpad(F.hex(key * 77 % 65536), 4, "0"), F.lpad(F.hex(key * 70001 % 16777216), 6, "0"))
    data = F.unhex(F.concat(F.substring(text, 3, 2), F.substring(text, 1, 2), F.substring(text, 5, 6)))
    rows = V.table(spark, d, "orders").select("o_orderkey", data.alias("data"))
    return rows.select("o_orderkey", B.number_column("data", 0, 2).alias("u16"), B.number_column("data", 2, 3, "big").alias("u24"), B.number_column("data", 0, 2, signed=True).alias("i16"))


_READ, _WRITE = formats()
_DEC, _ENC = codecs()


@query("SELECT name, readable, writable FROM (VALUES ('aac', true, true), ('aiff', true, true), ('avi', true, true), ('flac', true, true), ('flv', true, true), ('h264', true, false), ('m4v', true, false), ('matroska', true, true), ('mp3', true, true), ('mp4', true, true), ('mpegts', true, true), ('ogg', true, true), ('wav', true, true), ('webm', false, true)) f(name, readable, writable) ORDER BY name")
def format_registry(spark, d):
    names = sorted({n for n, _ in _READ.names()} | {n for n, _ in _WRITE.names()})
    return spark.createDataFrame([(n, n in _READ, n in _WRITE) for n in names], "name string, readable boolean, writable boolean").orderBy("name")


@query("SELECT name, flags FROM (VALUES " + ", ".join(f"('{n}', 'DE')" for n in sorted([*("pcm_" + x for x in ("u8", "s16le", "s16be", "s24le", "s24be", "s32le", "s32be", "f32le", "f32be")), "flac"])) + ") c(name, flags) ORDER BY name")
def codec_registry(spark, d):
    names = lambda r: spark.createDataFrame([(n,) for n, _ in r.names()], "name string")
    return R.flags_table(names(_DEC), names(_ENC))
