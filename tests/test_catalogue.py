"""Every query with SQL gives what DuckDB gives on the smallest tables."""

import decimal
import math
import os

import duckdb
import pytest

from quadloom import catalogue

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "null" if math.isnan(v) else repr(round(v, 8) + 0.0)
    return "null" if v is None else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in catalogue.ORACLES:
        return
    found = duck.execute(catalogue.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())
