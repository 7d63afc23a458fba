"""Metadata reports: stream selection, entry projection, and documents of sections in seven text forms.

A document is long-form rows: path, section, number (of the section in the document), ordinal (of the field), key, value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Letters of stream specifiers.
TYPES = {"v": "video", "a": "audio", "s": "subtitle", "d": "data", "t": "attachment"}


def select_streams(streams: DataFrame, spec: str | None) -> DataFrame:
    """Streams (path, stream_index, media_type) that a specifier names: N, or v, a, s, d, t with an optional :k."""
    if spec is None:
        return streams
    token = spec.strip()
    kind, _, number = token.partition(":")
    if token.isdigit():
        return streams.where(F.col("stream_index") == int(token))
    if kind not in TYPES or (":" in token and not number.isdigit()):
        raise ValueError(f"Invalid stream specifier: {token}.")
    k = F.row_number().over(Window.partitionBy("path", "media_type").orderBy("stream_index")) - 1
    found = streams.withColumn("_k", k).where(F.col("media_type") == TYPES[kind])
    return (found.where(F.col("_k") == int(number)) if number else found).drop("_k")


def parse_entries(text: str) -> dict[str, set[str] | None]:
    """'stream=index,codec_name:format' as section -> fields (None: all); a later section replaces an earlier one."""
    plural = {"streams": "stream", "formats": "format", "program_versions": "program_version", "library_versions": "library_version"}
    out: dict[str, set[str] | None] = {}
    for part in filter(None, map(str.strip, text.split(":"))):
        name, eq, fields = part.partition("=")
        name = plural.get(name.strip().lower(), name.strip().lower())
        if not name:
            raise ValueError(f"Invalid show entries string: '{text}'")
        out[name] = {f.strip() for f in fields.split(",") if f.strip()} if eq else None
    return out


def show_entries(fields: DataFrame, text: str) -> DataFrame:
    """Only the sections and fields that the text names."""
    keep = F.lit(False)
    for section, names in parse_entries(text).items():
        hit = F.lower("section") == section
        keep = keep | (hit if names is None else hit & F.col("key").isin(*sorted(names)))
    return fields.where(keep)


def flags_table(readers: DataFrame, writers: DataFrame) -> DataFrame:
    """Names with D and E flags for being in the first and the second list, a dot where they aren't, by name."""
    a, b = readers.select("name").distinct().withColumn("_d", F.lit("D")), writers.select("name").distinct().withColumn("_e", F.lit("E"))
    both = a.join(b, "name", "full_outer")
    return both.select("name", F.concat(F.coalesce("_d", F.lit(".")), F.coalesce("_e", F.lit("."))).alias("flags")).orderBy("name")


#: JSON names of sections that differ, and those that are arrays whatever their number.
_JSON = {"stream": "streams", "packet": "packets", "frame": "frames", "program": "programs", "stream_group": "stream_groups", "chapter": "chapters", "library_version": "library_versions"}
_ARRAYS = frozenset((*_JSON.values(), "log"))


def _quoted(c):
    return F.when(c.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def _xml(c):
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _json_string(c: Column) -> Column:
    """A JSON string; what must be escaped is, nothing else."""
    whole = F.to_json(F.array(c))
    return F.substring(whole, F.lit(2), F.length(whole) - 2)


#: Fields that are strings in JSON whatever their type.
_FORCED = {"format": ("start_time", "duration", "size", "bit_rate"), "stream": ("sample_rate", "time_base", "start_time", "duration", "bit_rate", "r_frame_rate", "avg_frame_rate")}


def _write_json(rows: DataFrame, compact: bool) -> DataFrame:
    """Sections by their JSON names in order, those that are lists as arrays, fields in order.

    A field with the value_type (an optional column) integer, unsigned, float or boolean is written bare unless its key
    is one of those that are always strings.
    """
    low, nl = F.lower("section"), (lambda n: F.lit("" if compact else "\n" + " " * n))
    forced = F.lit(False)
    for section, keys in _FORCED.items():
        forced = forced | ((low == section) & F.col("key").isin(*keys))
    plain = F.col("value_type").isin("integer", "unsigned", "float", "boolean") & ~forced if "value_type" in rows.columns else F.lit(False)
    colon = F.lit(":" if compact else ": ")
    field = F.concat(_json_string(F.col("key")), colon, F.coalesce(F.when(plain, F.col("value")).otherwise(_json_string(F.col("value"))), F.lit("null")))
    name = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in _JSON.items() for x in pair)), low), low)
    last = rows.withColumn("name", name).groupBy("path", "name", "number", "key").agg(F.max_by(F.struct("ordinal", field.alias("t")), "ordinal").alias("f"), F.min("ordinal").alias("ordinal"))
    parts = last.groupBy("path", "name", "number").agg(F.array_sort(F.collect_list(F.struct("ordinal", F.col("f.t").alias("t")))).alias("f"))
    array = F.col("name").isin(*sorted(_ARRAYS))
    body = lambda pad: F.concat(F.lit("{"), nl(pad + 4), F.array_join(F.transform("f", lambda x: x["t"]), "," if compact else ",\n" + " " * (pad + 4)), nl(pad), F.lit("}"))
    groups = parts.groupBy("path", "name").agg(F.array_sort(F.collect_list(F.struct("number", body(8).alias("deep"), body(4).alias("flat")))).alias("s"))
    many = F.concat(F.lit("["), nl(8), F.array_join(F.transform("s", lambda x: x["deep"]), "," if compact else ",\n        "), nl(4), F.lit("]"))
    entry = F.concat(_json_string(F.col("name")), colon, F.when(array | (F.size("s") > 1), many).otherwise(F.get("s", F.lit(0))["flat"]))
    whole = groups.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", entry.alias("e")))), lambda x: x["e"]), "," if compact else ",\n    ").alias("b"))
    return whole.select("path", F.concat(F.lit("{"), nl(4), "b", nl(0), F.lit("}\n")).alias("report"))


def output_format(text: str | None) -> tuple[str, dict[str, str]]:
    """'json=compact=1' or 'csv:nk=1' as a form and its options; an option without a value is '1'; None is default."""
    parts = ("default" if text is None else text).split(":")
    name, eq, first = parts[0].partition("=")
    if name not in ("default", "compact", "csv", "flat", "ini", "json", "xml"):
        raise ValueError(f"Unknown output format with name '{name}'")
    found = [p.partition("=") for p in [first, *parts[1:]] if p]
    return name, {k: v if e else "1" for k, e, v in found}


def write_report(fields: DataFrame, form: str, compact: bool = False) -> DataFrame:
    """(path, report): each document as text: default, compact, csv, flat, ini, json (compact: in one line) or xml.

    Sections are put together by their number and fields by their ordinal; documents are groups of their own, so this is
    two aggregations with partial ones before the shuffle.
    """
    low, key, value = F.lower("section"), F.col("key"), F.coalesce("value", F.lit("N/A"))
    line = {
        "default": F.concat(key, F.lit("="), value), "ini": F.concat(key, F.lit("="), value), "compact": F.concat(key, F.lit("="), value),
        "csv": F.concat_ws(",", _quoted(low), _quoted(key), _quoted(value)),
        "xml": F.concat(F.lit("    <"), key, F.lit(">"), _xml(value), F.lit("</"), key, F.lit(">")),
        "json": F.lit(""),
    }
    rows = fields
    if form == "flat":
        firsts = Window.partitionBy("path", low).orderBy("number")
        rows = rows.withColumn("_nth", F.dense_rank().over(firsts) - 1)
        line["flat"] = F.concat(low, F.lit("."), F.col("_nth").cast("string"), F.lit("."), key, F.lit('="'), F.replace(value, F.lit('"'), F.lit('\\"')), F.lit('"'))
    if form not in line:
        raise ValueError(form)
    if form == "json":
        return _write_json(rows, compact)
    lines = rows.select("path", "number", "section", F.struct("ordinal", line[form].alias("l")).alias("x"))
    parts = lines.groupBy("path", "number", "section").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["l"]).alias("l"))
    body = F.array_join("l", "|" if form == "compact" else "\n")
    block = {
        "default": F.concat(F.lit("["), "section", F.lit("]\n"), body, F.lit("\n[/"), "section", F.lit("]\n")),
        "ini": F.concat(F.lit("["), low, F.lit("]\n"), body, F.lit("\n\n")),
        "compact": F.concat(low, F.lit("|"), body, F.lit("\n")),
        "xml": F.concat(F.lit("  <"), low, F.lit(">\n"), body, F.lit("\n  </"), low, F.lit(">\n")),
    }.get(form, F.concat(body, F.lit("\n")))
    whole = parts.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", block.alias("b")))), lambda x: x["b"]), "").alias("report"))
    head = {"csv": "section,key,value\n", "xml": '<?xml version="1.0" encoding="UTF-8"?>\n<ffprobe>\n'}.get(form, "")
    return whole.select("path", F.concat(F.lit(head), "report", F.lit("</ffprobe>\n" if form == "xml" else "")).alias("report"))


def describe(streams: DataFrame, probed: DataFrame, sizes: DataFrame, packets: DataFrame | None = None) -> DataFrame:
    """The fields of each file's report: one FORMAT section, then a STREAM section for each stream.

    streams are those of sources.media, probed has (path, format, score), sizes (path, length); packets, if given, are
    counted for nb_read_packets. Fields without a value (no positive duration, no rate) are left out; files that can't
    be read have an ERROR section.
    """
    ok = streams.where("status = 'ok'")
    seconds = F.when(F.col("duration") > 0, F.col("duration") * F.col("tb_num") / F.col("tb_den"))
    if packets is not None:
        n = packets.where("status = 'ok'").groupBy("path", F.col("stream_index").alias("index")).agg(F.count("*").alias("_packets"))
        ok = ok.join(n, ["path", "index"], "left").withColumn("_packets", F.coalesce("_packets", F.lit(0)))
    else:
        ok = ok.withColumn("_packets", F.lit(None).cast("long"))
    video, audio = F.col("media_type") == "video", F.col("media_type") == "audio"
    layout = F.when(F.col("channels") == 1, "mono").when(F.col("channels") == 2, "stereo").when(F.col("channels") == 6, "5.1").when(F.col("channels") == 8, "7.1").otherwise(F.concat(F.col("channels").cast("string"), F.lit("ch")))
    text = lambda c: c.cast("string")
    pairs = (
        ("index", text(F.col("index"))), ("codec_name", F.col("codec")), ("codec_type", F.col("media_type")),
        ("time_base", F.concat_ws("/", text(F.col("tb_num")), text(F.col("tb_den")))),
        ("duration_ts", F.when(F.col("duration") > 0, text(F.col("duration")))), ("duration", F.format_string("%.6f", seconds)),
        ("width", F.when(video, text(F.col("width")))), ("height", F.when(video, text(F.col("height")))),
        ("sample_rate", F.when(audio, text(F.col("rate")))), ("channels", F.when(audio, text(F.col("channels")))), ("channel_layout", F.when(audio, layout)),
        ("bits_per_sample", F.when(audio & (F.col("bits") > 0), text(F.col("bits")))),
        ("bit_rate", F.when(F.col("codec").startswith("pcm") & (F.col("bits") > 0), text(F.col("rate").cast("long") * F.col("channels") * F.col("bits")))),
        ("nb_read_packets", text(F.col("_packets"))),
    )

    def rows(df, section, number, fields):
        cells = F.filter(F.array(*(F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in fields)), lambda x: x["value"].isNotNull())
        return df.select("path", F.lit(section).alias("section"), number.cast("int").alias("number"), F.posexplode(cells).alias("ordinal", "f")).select("path", "section", "number", "ordinal", "f.key", "f.value")

    whole = ok.groupBy("path").agg(F.count("*").alias("n"), F.max(seconds).alias("sec"))
    whole = whole.join(probed, "path").join(sizes.select("path", F.col("length").alias("size")), "path")
    rate = F.when(F.col("sec") > 0, text(F.round(F.col("size") * 8 / F.col("sec")).cast("long")))
    top = (("filename", F.col("path")), ("nb_streams", text(F.col("n"))), ("format_name", F.col("format")), ("duration", F.format_string("%.6f", F.when(F.col("sec") > 0, F.col("sec")))), ("size", text(F.col("size"))), ("bit_rate", rate), ("probe_score", text(F.col("score"))))
    bad = streams.where("status = 'error'")
    out = rows(whole, "FORMAT", F.lit(0), top).union(rows(ok, "STREAM", F.col("index") + 1, pairs)).union(rows(bad, "ERROR", F.lit(0), (("string", F.col("error")),)))
    return out.where(F.col("value").isNotNull())
