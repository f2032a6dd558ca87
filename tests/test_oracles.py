"""Every query with SQL gives the rows that DuckDB gives for it, on the tables of sf0.01."""

import os
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=str)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows_equal(spark, duck, name):
    got = entry.queries()[name](spark, DATA)
    cur = duck.execute(ORACLES[name])
    columns = [d[0] for d in cur.description]
    want = rows_of(columns, cur.fetchall())
    assert sorted(got.columns) == sorted(columns)
    have = rows_of(got.columns, got.collect())
    assert len(have) == len(want)
    for a, b in zip(have, want, strict=True):
        assert a == b
    assert have, "nothing to compare"


def test_entry(spark):
    assert entry.entry(spark).count() > 0
