import json

import pytest

from reelframe.functions.text import FilterSpec, parse_filter_chain, parse_size
from reelframe.operators import report as R
from reelframe.sources import media as M
from reelframe.sources.probe import probe

from .test_media import wav


def test_file_report(spark):
    data = wav()[0]
    media = M.memory(spark, {"a.wav": data, "bad.wav": b"RIFFxxxxWAVE"})
    fields = R.describe(M.streams(media), probe(media), media, M.packets(media))
    docs = {r.path: json.loads(r.report) for r in R.write_report(fields, "json").collect()}
    f, s = docs["a.wav"]["format"], docs["a.wav"]["streams"][0]
    assert f["format_name"] == "wav" and f["size"] == str(len(data)) and f["probe_score"] == "100" and f["duration"] == "0.226757"
    assert (s["codec_name"], s["sample_rate"], s["channels"], s["channel_layout"], s["duration_ts"], s["nb_read_packets"], s["bit_rate"]) == ("pcm_s16le", "44100", "2", "stereo", "10000", "3", "1411200")
    assert "width" not in s and "error" in docs["bad.wav"]
    few = R.show_entries(fields, "stream=codec_name:format=filename")
    assert {r.path: r.report for r in R.write_report(few, "compact").collect()}["a.wav"] == "format|filename=a.wav\nstream|codec_name=pcm_s16le\n"


def test_options():
    assert R.parse_entries("streams=index, codec_name:format:streams=tag") == {"stream": {"tag"}, "format": None}
    with pytest.raises(ValueError):
        R.parse_entries("=x")
    assert parse_filter_chain(" volume=0.5 ,, fade=in:0 : 2,x") == [FilterSpec("volume", ["0.5"]), FilterSpec("fade", ["in", "0", "2"]), FilterSpec("x")]
    assert parse_size("640x360") == (640, 360) and parse_size("640") is None and parse_size("axb") is None


@pytest.mark.parametrize("spec", ["", "x", "v:", "a:b"])
def test_bad_stream_specifiers(spark, spec):
    with pytest.raises(ValueError):
        R.select_streams(spark.createDataFrame([("a", 0, "video")], "path string, stream_index int, media_type string"), spec)
