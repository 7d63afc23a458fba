"""Files as tables: media -> streams, packets, frames; and packets back to files.

A file is one row of `media` (path, content); files are worked on side by side, each within one task. A file that can't
be read doesn't fail the job: its rows carry status 'error' and the reason.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..codecs import flac, pcm
from .containers import MUXERS, Packet, Stream, demux

STREAMS = "path string, format string, index int, media_type string, codec string, tb_num int, tb_den int, extra binary, rate int, channels int, bits int, width int, height int, duration long, metadata map<string,string>, status string, error string"
PACKETS = "path string, seq long, stream_index int, pts long, dts long, duration long, tb_num int, tb_den int, is_keyframe boolean, pos long, size long, data binary, status string, error string"


def load(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """media (path, length, content) of the files below a path; pattern is a glob on their names."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    reader = reader.option("pathGlobFilter", pattern) if pattern else reader
    return reader.load(path).select("path", "length", "content")


def memory(spark: SparkSession, files: dict[str, bytes]) -> DataFrame:
    """media of files given as bytes."""
    rows = [(k, len(v), bytearray(v)) for k, v in files.items()]
    return spark.createDataFrame(rows, "path string, length long, content binary")


def _schema(text: str) -> list[tuple[str, pa.DataType]]:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "map<string,string>": pa.map_(pa.string(), pa.string())}
    return [(n, kinds[t]) for n, t in (f.split(" ", 1) for f in text.split(", "))]


def _table(rows: list[tuple], text: str) -> pa.RecordBatch:
    fields = _schema(text)
    cols = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, fields, strict=True)], names=[n for n, _ in fields])


def _parsed(batches, forced):
    for b in batches:
        for i in range(b.num_rows):  # one file at a time in memory as Python objects
            path, content = b.column(0)[i].as_py(), b.column(1)[i].as_py()
            try:
                yield path, *demux(content or b"", path, forced), None
            except Exception as e:  # noqa: BLE001  a broken file is data
                yield path, None, [], [], f"{type(e).__name__}: {e}"


def streams(media: DataFrame, forced: str | None = None) -> DataFrame:
    """One row for each stream; a file that can't be read has one row with status 'error'."""

    def run(batches):
        for path, fmt, found, _, error in _parsed(batches, forced):
            if error:
                yield _table([(path, *[None] * 14, "error", error)], STREAMS)
            else:
                yield _table([(path, fmt, s.index, s.media_type, s.codec, *s.tb, s.extra, s.rate, s.channels, s.bits, s.width, s.height, s.duration, list(s.metadata.items()), "ok", None) for s in found], STREAMS)

    return media.select("path", "content").mapInArrow(run, STREAMS)


#: What decoding needs to know of a packet's stream.
CODED = "codec string, rate int, channels int, bits int, extra binary"


def packets(media: DataFrame, forced: str | None = None, coded: bool = False) -> DataFrame:
    """One row for each packet, in arrival order by seq; coded: with the columns of its stream that decoding needs.

    So a plan that decodes reads each file once and joins nothing.
    """
    schema = f"{PACKETS}, {CODED}" if coded else PACKETS

    def run(batches):
        for path, _, found, parts, error in _parsed(batches, forced):
            more = [(s.codec, s.rate, s.channels, s.bits, s.extra) if coded else () for s in found]
            if error:
                yield _table([(path, *[None] * 11, "error", error, *([None] * 5 if coded else ()))], schema)
                continue
            for at in range(0, len(parts), 1000):
                rows = [(path, n, p.stream, p.pts, p.dts, p.duration, *found[p.stream].tb, p.key, p.pos, len(p.data), p.data, "ok", None, *more[p.stream]) for n, p in enumerate(parts[at : at + 1000], at)]
                yield _table(rows, schema)

    return media.select("path", "content").mapInArrow(run, schema)


def _with_streams(packets: DataFrame, streams: DataFrame | None) -> DataFrame:
    """Good packets with the columns of CODED: their own, or those of streams."""
    rows = packets.where("status = 'ok'")
    if streams is None:
        return rows
    meta = streams.where("status = 'ok'").select("path", F.col("index").alias("stream_index"), "codec", "rate", "channels", "bits", "extra")
    return rows.select("path", "stream_index", "seq", *(["pts"] if "pts" in rows.columns else []), "data").join(meta, ["path", "stream_index"])


FRAMES = "path string, stream_index int, frame_no long, pts long, nb_samples int, rate int, channels int, samples array<double>, status string, error string"


def decode_audio(packets: DataFrame, streams: DataFrame | None = None) -> DataFrame:
    """Audio frames of PCM and FLAC packets as interleaved doubles in -1..1; every packet is decoded by itself.

    A packet that can't be decoded doesn't fail the job: its row has status 'error', the reason, and no samples. Packets
    are coded ones, or streams are given: these are few and joined by the planner's choice.
    """
    rows = _with_streams(packets, streams).where("codec = 'flac' OR codec LIKE 'pcm%'").select("path", "stream_index", "seq", "pts", "data", "codec", "rate", "channels", "bits")

    def samples(codec, data, channels, bits, rate):
        if codec == "flac":
            head, x = flac.decode_frame(data, {"rate": rate, "bits": bits})
            return x / float(1 << (head["bits"] - 1))
        x = pcm.decode(data, codec, channels).astype(np.float64)
        size, kind = pcm.CODECS[codec]
        return x if codec.startswith("pcm_f32") else (x - 128) / 128 if codec == "pcm_u8" else x / float(1 << (8 * size - 1))

    def run(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                head = (r["path"], r["stream_index"], r["seq"], r["pts"])
                try:
                    x = samples(r["codec"], r["data"], r["channels"], r["bits"], r["rate"])
                    out.append((*head, len(x), r["rate"], x.shape[1], x.reshape(-1), "ok", None))
                except Exception as e:  # noqa: BLE001  a broken packet is data
                    out.append((*head, None, r["rate"], r["channels"], None, "error", f"{type(e).__name__}: {e}"))
            cols = list(zip(*out, strict=True)) or [()] * 10
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["path", "stream_index", "frame_no", "pts", "nb_samples", "rate", "channels", "samples", "status", "error"])

    return rows.mapInArrow(run, FRAMES)


#: Codecs whose packets depend on the ones before.
STATEFUL = ("vorbis",)


def decode_in_order(packets: DataFrame, streams: DataFrame | None = None) -> DataFrame:
    """Audio frames of codecs whose packets depend on the ones before (Vorbis), as decode_audio gives them.

    The packets of a stream come sorted to one task, batch by batch; only the decoder's state is kept between them. Times
    count samples from the stream's first. A stream whose headers are broken has one row with status 'error'; so has each
    packet that can't be decoded.
    """
    rows = _with_streams(packets, streams).where(F.col("codec").isin(*STATEFUL)).select("path", "stream_index", "seq", "data", "extra", "rate", "channels")

    def run(batches):
        from ..codecs import vorbis

        key, decoder, at = None, None, 0
        for b in batches:
            out = []
            for r in b.to_pylist():
                head = (r["path"], r["stream_index"], r["seq"])
                if (r["path"], r["stream_index"]) != key:
                    key, at, decoder = (r["path"], r["stream_index"]), 0, vorbis.Decoder()
                    try:
                        for part in vorbis.split_headers(r["extra"] or b""):
                            decoder.decode(part)
                    except Exception as e:  # noqa: BLE001  a broken stream is data
                        decoder = None
                        out.append((*head, None, None, r["rate"], r["channels"], None, "error", f"{type(e).__name__}: {e}"))
                if decoder is None:
                    continue
                try:
                    x = decoder.decode(r["data"] or b"")
                    if len(x):
                        out.append((*head, at, len(x), r["rate"], x.shape[1], x.reshape(-1), "ok", None))
                        at += len(x)
                except Exception as e:  # noqa: BLE001
                    out.append((*head, None, None, r["rate"], r["channels"], None, "error", f"{type(e).__name__}: {e}"))
            cols = list(zip(*out, strict=True)) or [()] * 10
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["path", "stream_index", "frame_no", "pts", "nb_samples", "rate", "channels", "samples", "status", "error"])

    parts = int(packets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "path", "stream_index").sortWithinPartitions("path", "stream_index", "seq").mapInArrow(run, FRAMES)


def encode_audio(frames: DataFrame, codec: str) -> DataFrame:
    """Packets (path, seq, stream_index, pts, dts, duration, tb_num, tb_den, is_keyframe, data) of interleaved frames."""
    bits = {"pcm_u8": 8, "pcm_s24le": 24, "pcm_s24be": 24, "pcm_s32le": 32, "pcm_s32be": 32}.get(codec, 16)

    def run(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                x = np.array(r["samples"], np.float64).reshape(-1, r["channels"])
                if codec.startswith("pcm_f32"):
                    data = pcm.encode(x, codec)
                else:
                    full = float(1 << (bits - 1))
                    q = np.clip(np.floor(np.abs(x * full) + 0.5) * np.sign(x), -full, full - 1).astype(np.int64)
                    data = flac.encode_frame(q, r["frame_no"], 16) if codec == "flac" else pcm.encode(q + 128 if codec == "pcm_u8" else q, codec)
                out.append((r["path"], r["frame_no"], r["stream_index"], r["pts"], r["pts"], len(x), 1, r["rate"], True, data))
            cols = list(zip(*out, strict=True)) or [()] * 10
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["path", "seq", "stream_index", "pts", "dts", "duration", "tb_num", "tb_den", "is_keyframe", "data"])

    kind = "path string, seq long, stream_index int, pts long, dts long, duration long, tb_num int, tb_den int, is_keyframe boolean, data binary"
    return frames.mapInArrow(run, kind)


def mux(streams: DataFrame, packets: DataFrame, fmt: str) -> DataFrame:
    """Files (path, content) of a format from streams and packets; one file is one task's work, as its bytes are one value."""
    writer = MUXERS[fmt]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = sorted(left.to_pylist(), key=lambda r: r["index"])
        found = [Stream(i, r["media_type"], r["codec"], (r["tb_num"], r["tb_den"]), r["extra"] or b"", r["rate"] or 0, r["channels"] or 0, r["bits"] or 0, r["width"] or 0, r["height"] or 0) for i, r in enumerate(rows)]
        place = {r["index"]: i for i, r in enumerate(rows)}
        parts = [Packet(place[r["stream_index"]], r["pts"], r["dts"], r["data"], r["duration"] or 0, r["is_keyframe"]) for r in sorted(right.to_pylist(), key=lambda r: r["seq"]) if r["stream_index"] in place]
        if not rows:
            return pa.table({"path": pa.array([], pa.string()), "content": pa.array([], pa.binary())})
        return pa.table({"path": [rows[0]["path"]], "content": pa.array([writer(found, parts)], pa.binary())})

    left = streams.select("path", "index", "media_type", "codec", "tb_num", "tb_den", "extra", "rate", "channels", "bits", "width", "height")
    right = packets.select("path", "seq", "stream_index", "pts", "dts", "duration", "is_keyframe", "data")
    return left.groupBy("path").cogroup(right.groupBy("path")).applyInArrow(run, "path string, content binary")


def save(files: DataFrame, folder: str) -> None:
    """Write files (path, content) below a folder of any file system that Arrow knows, each under its base name.

    Each file is written under another name and moved, so a task that runs again leaves whole files.
    """

    def run(rows):
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder)
        system.create_dir(root, recursive=True)
        for r in rows:
            name = r["path"].rsplit("/", 1)[-1]
            with system.open_output_stream(f"{root}/.{name}.part") as out:
                out.write(bytes(r["content"]))
            system.move(f"{root}/.{name}.part", f"{root}/{name}")

    files.select("path", "content").foreachPartition(run)
