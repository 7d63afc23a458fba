"""Files behind http(s) addresses: fetched by the executors, or followed as a stream by byte ranges."""

from __future__ import annotations

import urllib.request

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

CHUNK = 32 * 1024


def read_url(url: str, start: int = 0, most: int | None = None, timeout: float = 30.0) -> bytes:
    """Bytes of an address from start on, at most `most`; empty where the range lies beyond the end."""
    request = urllib.request.Request(url, headers={"Range": f"bytes={start}-{'' if most is None else start + most - 1}"} if start or most else {})
    parts, held = [], 0
    try:
        with urllib.request.urlopen(request, timeout=timeout) as r:
            skip = start if r.status == 200 and start else 0  # a server that knows no ranges sends all
            while most is None or held < most + skip:
                part = r.read(CHUNK)
                if not part:
                    break
                parts.append(part)
                held += len(part)
    except urllib.error.HTTPError as e:
        if e.code == 416:
            return b""
        raise
    data = b"".join(parts)[skip:]
    return data if most is None else data[:most]


def load_urls(urls: DataFrame, column: str = "url", most: int | None = None) -> DataFrame:
    """media (path, length, content, status, error) of the addresses in a column; one that fails is a row with its reason."""

    def run(batches):
        for b in batches:
            for url in b.column(0).to_pylist():
                try:
                    data, status, error = read_url(url, 0, most), "ok", None
                except Exception as e:  # noqa: BLE001  an address that can't be read is data
                    data, status, error = None, "error", f"{type(e).__name__}: {e}"
                yield pa.RecordBatch.from_arrays([pa.array([url]), pa.array([len(data) if data is not None else None], pa.int64()), pa.array([data], pa.binary()), pa.array([status]), pa.array([error], pa.string())], names=["path", "length", "content", "status", "error"])

    return urls.select(F.col(column).alias("url")).mapInArrow(run, "path string, length long, content binary, status string, error string")


class UrlReader(SimpleDataSourceStreamReader):
    """Chunks of one address; the offset is the number of bytes read, so a restart goes on where it ended."""

    def __init__(self, options: dict):
        self.url, self.most = options["path"], int(options.get("bytes_per_trigger", 8 * CHUNK))

    def initialOffset(self) -> dict:
        return {"at": 0}

    def read(self, start: dict):
        data = read_url(self.url, start["at"], self.most)
        return iter([(self.url, start["at"], data)] if data else []), {"at": start["at"] + len(data)}

    def readBetweenOffsets(self, start: dict, end: dict):
        n = end["at"] - start["at"]
        return iter([(self.url, start["at"], read_url(self.url, start["at"], n))] if n else [])


class UrlSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "media_url"

    def schema(self) -> str:
        return "path string, pos long, data binary"

    def simpleStreamReader(self, schema) -> UrlReader:
        return UrlReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(UrlSource)
