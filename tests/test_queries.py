"""Every query with SQL against DuckDB on the smallest tables; the others give rows with a stable schema."""

import datetime as dt
import math
import os

import pytest

import __spark_entry__
from shopweave.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (dt.date, dt.datetime)):
        return v.isoformat()
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v or 0.0)
    return repr(v)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, duck, name):
    got = registry.queries()[name](spark, DIR)
    want = duck.sql(registry.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    rows = sorted([plain(r[c]) for c in columns] for r in got.collect())
    assert rows == sorted([plain(r[i]) for i in at] for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(registry.queries().keys() - registry.oracle_sql().keys()))
def test_gives_rows(spark, name):
    a = registry.queries()[name](spark, DIR)
    assert a.columns and a.count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
