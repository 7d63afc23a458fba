import glob
import hashlib

import pytest

from reelframe.llm.common import work_dir
from reelframe.llm.warc import END, MAGIC, read_warc, write_warc

BIG = "<html>" + "é" * 300 + "</html>"
TRAP = f"x {MAGIC}WARC-Type: response\r\nWARC-Record-ID: <urn:page:666>\r\nContent-Length: 3{END}abc{END}{MAGIC} tail {MAGIC}"
ROWS = [(5, "http://a", BIG), (3, "http://b c", BIG), (9, None, BIG), (None, "u", BIG), (1, "u", "short"), (2, "u", "short"), (4, "u", None), (6, "u", TRAP * 3), (7, "u", TRAP * 3), (8, "u", MAGIC), (10, "u", "\r\n\r\n" * 50), (11, "u", "z" * 200_000), (11, "u", "z" * 200_000)]


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, sha256 string")


@pytest.mark.parametrize("split", ["128m", "64", "1000"])
def test_round_trip(spark, split):
    path = work_dir(spark, "w")
    write_warc(frame(spark).repartition(2), path)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split if split != "64" else "4096")
    try:
        got = read_warc(spark, path, payloads=True).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(got) == len(ROWS)
    by = {}
    for r in got:
        by.setdefault(r.record_id[10:-1], []).append(r)
    for page, _, html in ROWS:
        for r in by[str(page) if page is not None else "none"]:
            want = (html or "").encode()
            if r.record_type == "response":
                assert bytes(r.payload) == want and r.sha256 == hashlib.sha256(want).hexdigest() and r.length == len(want)
            else:
                assert r.header_digest == "sha256:" + hashlib.sha256(want).hexdigest() and r.payload_length == len(want) and r.length == 0
    kinds = {k: ([r.record_type for r in v], v[0].refers_to) for k, v in by.items()}
    assert kinds["3"] == (["response"], None) and kinds["5"] == (["revisit"], "<urn:page:3>") and kinds["none"] == (["revisit"], "<urn:page:3>")
    assert kinds["7"] == (["revisit"], "<urn:page:6>") and kinds["1"][0] == kinds["2"][0] == ["response"] and kinds["11"][0] == ["response"] * 2


def test_files_are_plain_warc(spark):
    path = work_dir(spark, "w")
    write_warc(frame(spark, ROWS[:5]).coalesce(1), path)
    text = b"".join(open(f, "rb").read() for f in sorted(glob.glob(path.removeprefix("file://") + "/part-*")))
    n = 0
    while text:  # a plain sequential reader
        head, _, rest = text.partition(END.encode())
        assert head.startswith(MAGIC.encode())
        size = int(dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])[b"Content-Length"])
        assert rest[size : size + 4] == END.encode()
        text, n = rest[size + 4 :], n + 1
    assert n == 5


def test_broken_chain_keeps_what_is_reached(spark, tmp_path):
    def rec(i, n, body):
        return f"{MAGIC}WARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\nContent-Length: {n}{END}{body}{END}"

    (tmp_path / "a.warc").write_bytes((rec(1, 3, "abc") + rec(2, 99, "abc") + rec(3, 3, "abc")).encode())
    (tmp_path / "b.warc").write_bytes(("junk" + rec(4, 3, "abc")).encode())
    assert [r.record_id for r in read_warc(spark, f"file://{tmp_path}").collect()] == ["<urn:page:1>"]


def test_empty_table(spark):
    path = work_dir(spark, "w")
    write_warc(frame(spark, []), path)
    assert read_warc(spark, path).count() == 0
