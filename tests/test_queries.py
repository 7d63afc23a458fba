"""Every registered query against its DuckDB text on the smallest tables."""

import math
import os

import duckdb
import pytest

from reelframe.plans import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else repr(v) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows, cols = [tuple(r) for r in df.collect()], df.columns
    if name not in ORACLE_SQL:
        assert rows
        return
    cur = duck.execute(ORACLE_SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(cols)
    mine, theirs = (sorted(tuple(plain(r[c.index(n)]) for n in sorted(cols)) for r in data) for c, data in ((cols, rows), (names, cur.fetchall())))
    assert mine == theirs
