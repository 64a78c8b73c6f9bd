"""Every registered query of the engine against its SQL."""

import math
import os

import duckdb
import pytest

from larkspur.queries_more import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return v if isinstance(v, (bool, str)) else round(float(v), 6)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    got = [tuple(r) for r in df.collect()]
    if name not in ORACLE_SQL:
        assert got
        return
    found = duck.execute(ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, got) == rows(columns, found.fetchall())


def test_the_stream_gets_all_events(spark, monkeypatch):
    from larkspur.engine import Engine

    fed = []
    ingest = Engine.ingest_stream
    monkeypatch.setattr(Engine, "ingest_stream", lambda self, name, path, *more: fed.append(spark.read.json(path).count()) or ingest(self, name, path, *more))
    QUERIES["i_stream_availablenow"](spark, DIR).count()
    assert fed == [spark.read.parquet(f"{DIR}/events.parquet").count()]
