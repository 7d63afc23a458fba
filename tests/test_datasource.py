import numpy as np
import pytest
from pyspark.sql import functions as F

from reelframe.codecs import pcm
from reelframe.sources import containers as C
from reelframe.sources import datasource as D


@pytest.fixture
def folder(spark, tmp_path):
    D.register(spark)
    x = np.arange(9000) % 100
    s = C.Stream(0, "audio", "pcm_s16le", (1, 8000), b"", 8000, 1, 16)
    wav = C.mux_wav([s], [C.Packet(0, 0, 0, pcm.encode(x, "pcm_s16le"), 9000)])
    rows = [(f"x/{k}.wav", bytearray(wav)) for k in "abc"] + [("bad.wav", bytearray(b"RIFF0000WAVE")), ("d.cue", bytearray(b'FILE "a b.wav" WAVE\n  TRACK 01 AUDIO\n    INDEX 00 00:00:00\n    INDEX 01 00:01:15\n'))]
    spark.createDataFrame(rows, "path string, content binary").repartition(3).write.format("media").mode("append").save(str(tmp_path))
    return str(tmp_path), wav


def test_written_files_are_read(spark, folder):
    path, wav = folder
    read = lambda **o: spark.read.format("media").options(**o).load(path)
    name = F.regexp_extract("path", "([^/]*)$", 1).alias("name")
    formats = {r.name: r for r in read(relation="formats").select(name, "*").collect()}
    assert formats.keys() == {"a.wav", "b.wav", "c.wav", "bad.wav", "d.cue"}
    assert (formats["a.wav"].format, formats["a.wav"].score, formats["a.wav"].length, formats["a.wav"].streams) == ("wav", 100, len(wav), 1)
    assert formats["bad.wav"].status == "error" and formats["bad.wav"].format == "wav"
    chapters = [(r.name, r.idx, r.track, r.start, r.file) for r in read(relation="chapters").select(name, "*").collect()]
    assert chapters == [("d.cue", 0, 1, 1.2, "a b.wav")]
    assert read(relation="streams").where("status = 'ok'").count() == 3
    assert read().where("status = 'ok'").count() == 9
    assert read(bytes_per_partition=1).rdd.getNumPartitions() == 5 and read().rdd.getNumPartitions() == 1


def test_pushed_filters(spark, folder):
    path, _ = folder
    key = "spark.sql.python.filterPushdown.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        df = spark.read.format("media").option("pushdown", "true").load(path)
        assert [r.pts for r in df.where((F.col("path") == f"{path}/a.wav") & (F.col("pts") >= 4096) & F.col("stream_index").isin(0, 7)).orderBy("pts").collect()] == [4096, 8192]
        assert df.where("pts < 4096 AND status = 'ok'").count() == 3
    finally:
        spark.conf.set(key, before)
    reader = D.PushingReader({"path": path})
    rest = list(reader.pushFilters([D.EqualTo(("path",), f"{path}/a.wav"), D.EqualTo(("size",), 3)]))
    assert [f.attribute for f in rest] == [("size",)] and [p.paths for p in reader.partitions()] == [(f"{path}/a.wav",)]
