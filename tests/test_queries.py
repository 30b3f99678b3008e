"""Every query against DuckDB on the smallest tables, as the driver does at a larger size."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(k for k in entry.oracle_sql() if not k.startswith("op") and k != "pipeline"))
def test_oracle(spark, con, name):
    df = entry.queries()[name](spark, SF)
    r = con.sql(entry.oracle_sql()[name])
    cols = sorted(df.columns)
    assert sorted(r.columns) == cols
    at = [r.columns.index(c) for c in cols]
    want = sorted((repr(tuple(plain(x[i]) for i in at)) for x in r.fetchall()))
    got = sorted(repr(tuple(plain(x[c]) for c in cols)) for x in df.collect())
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_grid_query(spark):
    d = entry.queries()["grid_reconstruct"](spark, SF)
    assert d.where("html like '<table>%' and n_rows >= 1").count() == d.count() > 0
