"""The `media` data source: spark.read.format("media").option("relation", "packets").load(folder), and files back.

Files open through Arrow's file systems (local, s3, gs, hdfs). Small ones share a partition, up to bytes_per_partition.
`relation` chooses packets (default), streams, formats or chapters. With the option pushdown=true, in a session that
pushes filters into Python sources (spark.sql.python.filterPushdown.enabled), comparisons on path leave files unopened,
and those on stream_index and pts keep packets from being sent.

df.write.format("media").mode("append").save(folder) writes rows (path, content), each file under its base name.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from ..functions.text import decode_sheet
from .containers import demux
from .media import PACKETS, STREAMS
from .probe import WINDOW, probe_bytes

FORMATS = "path string, length long, format string, score int, streams int, status string, error string"
CHAPTERS = "path string, idx int, track int, start double, file string, status string, error string"
_RELATIONS = {"packets": PACKETS, "streams": STREAMS, "formats": FORMATS, "chapters": CHAPTERS}
_TESTS = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le, In: lambda x, values: x in values}


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path)


@dataclass
class FilesPartition(InputPartition):
    paths: tuple[str, ...]


class MediaReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.relation, self.forced = options.get("path"), options.get("relation", "packets"), options.get("format_name")
        self.most = int(options.get("bytes_per_partition", 64 << 20))
        self.tests: list[tuple] = []  # (column, function, value)

    def _passes(self, **values) -> bool:
        return all(values[c] is not None and _TESTS[kind](values[c], v) for c, kind, v in self.tests if c in values)

    def partitions(self):
        from pyarrow import fs

        system, root = _system(self.path)
        info = system.get_file_info(root)
        files = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        out, group, held = [], [], 0
        for f in sorted(files, key=lambda f: f.path):
            if f.type != fs.FileType.File or f.base_name.startswith((".", "_")) or not self._passes(path=f.path):
                continue
            if group and held + f.size > self.most:
                out.append(FilesPartition(tuple(group)))
                group, held = [], 0
            group.append(f.path)
            held += f.size
        return [*out, FilesPartition(tuple(group))] if group else out or [FilesPartition(())]

    def read(self, partition):
        system, _ = _system(self.path)
        for path in partition.paths:
            try:
                with system.open_input_stream(path) as f:
                    rows = list(getattr(self, "_" + self.relation)(path, f.read()))
            except Exception as e:  # noqa: BLE001  a broken file is data
                width = len(_RELATIONS[self.relation].split(", ")) - 3
                rows = [(path, *[None] * width, "error", f"{type(e).__name__}: {e}")]
            yield from rows

    def _packets(self, path, data):
        _, streams, packets = demux(data, path, self.forced)
        for n, p in enumerate(packets):
            if self._passes(stream_index=p.stream, pts=p.pts):
                yield (path, n, p.stream, p.pts, p.dts, p.duration, *streams[p.stream].tb, p.key, p.pos, len(p.data), p.data, "ok", None)

    def _streams(self, path, data):
        fmt, streams, _ = demux(data, path, self.forced)
        for s in streams:
            yield (path, fmt, s.index, s.media_type, s.codec, *s.tb, s.extra, s.rate, s.channels, s.bits, s.width, s.height, s.duration, dict(s.metadata), "ok", None)

    def _formats(self, path, data):
        fmt, score = (self.forced, 100) if self.forced else probe_bytes(data[:WINDOW], path)
        try:
            n, status, error = len(demux(data, path, fmt)[1]), "ok", None
        except Exception as e:  # noqa: BLE001  what was told of the format stays
            n, status, error = None, "error", f"{type(e).__name__}: {e}"
        yield (path, len(data), fmt, score, n, status, error)

    def _chapters(self, path, data):
        """Those of cue sheets; other files have none."""
        if not path.lower().endswith(".cue"):
            return
        track, n, file = None, 0, None
        for line in map(str.split, decode_sheet(data).splitlines()):
            if line[:1] == ["FILE"]:
                file = " ".join(line[1:-1]).strip('"')
            elif line[:1] == ["TRACK"]:
                track = int(line[1])
            elif line[:2] == ["INDEX", "01"]:
                m, s, f = map(int, line[2].split(":"))
                yield (path, n, track, m * 60 + s + f / 75, file, "ok", None)
                n += 1


class PushingReader(MediaReader):
    """The same with filters taken over; Spark allows it only where the session pushes them."""

    def pushFilters(self, filters):
        """Takes comparisons of one column with a value that can be made before a row is sent; gives back the others."""
        known = {"path"} | ({"stream_index", "pts"} if self.relation == "packets" else set())
        for f in filters:
            if type(f) in _TESTS and len(f.attribute) == 1 and f.attribute[0] in known:
                self.tests.append((f.attribute[0], type(f), f.value))
            else:
                yield f


@dataclass
class Written(WriterCommitMessage):
    names: tuple[str, ...]


class MediaWriter(DataSourceWriter):
    """Each file is written under another name and moved, so a task that runs again leaves whole files."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, iterator):
        system, root = _system(self.path)
        system.create_dir(root, recursive=True)
        names = []
        for r in iterator:
            name = r["path"].rsplit("/", 1)[-1]
            with system.open_output_stream(f"{root}/.{name}.part") as out:
                out.write(bytes(r["content"] or b""))
            system.move(f"{root}/.{name}.part", f"{root}/{name}")
            names.append(name)
        return Written(tuple(names))


class MediaSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "media"

    def schema(self) -> str:
        return _RELATIONS[self.options.get("relation", "packets")]

    def reader(self, schema) -> MediaReader:
        return (PushingReader if self.options.get("pushdown") == "true" else MediaReader)(dict(self.options))

    def writer(self, schema, overwrite: bool) -> MediaWriter:
        return MediaWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MediaSource)
