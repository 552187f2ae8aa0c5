"""Batches whose numbers meet, as they do with more than a thousand suppliers: each counts as a batch of its own, as in SQL."""

import datetime as dt
import os

import duckdb
import pytest

from shopweave.operators import inventory
from shopweave.plans import registry

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("customer", "supplier", "part", "orders", "lineitem", "events")


@pytest.fixture(scope="module")
def shared(tmp_path_factory):
    """The smallest tables, each product's lines dealt to suppliers a thousand apart."""
    if not os.path.isdir(DIR):
        pytest.skip("the driver's tables are not here")
    folder, con = str(tmp_path_factory.mktemp("shared")), duckdb.connect()
    for t in TABLES:
        new = "select * replace (l_suppkey % 3 + 1000 * (l_orderkey % 3) as l_suppkey, l_shipdate - interval (l_orderkey % 2 * 40) day as l_shipdate)" if t == "lineitem" else "select *"
        con.sql(f"copy ({new} from '{DIR}/{t}.parquet') to '{folder}/{t}.parquet'")
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return folder, con


def same(spark, shared, name):
    folder, con = shared
    got, want = registry.queries()[name](spark, folder), con.sql(registry.oracle_sql()[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = sorted(repr([r[c] for c in columns]) for r in got.collect())
    assert rows and rows == sorted(repr(list(r)) for r in want.select(*columns).fetchall())


def test_batches_share_numbers(spark, shared):
    assert shared[1].sql("select max(n) from (select count(distinct l_suppkey) as n from lineitem group by l_partkey, l_suppkey % 1000)").fetchall()[0][0] == 3


def test_each_batch_of_a_number_takes_each_adjustment(spark):
    """Two batches of one number, the second received later: an adjustment counts by the dates of each, for either batch's stock."""
    day = lambda n: dt.date(2024, 1, n)
    b = spark.createDataFrame([(1, 9.0, 5.0, "available", day(31), day(1)), (1, 9.0, 3.0, "available", day(31), day(10))], "batch_id long, initial double, remaining double, status string, expiry date, received date")
    a = spark.createDataFrame([(1, 1, "damage", 2.0, day(5)), (1, 2, "damage", 2.0, day(12))], "batch_id long, id long, kind string, quantity double, day date")
    rows = inventory.adjustment_replay(a, b).collect()
    got = sorted((r.id, r.accepted, r.left) for r in rows)
    # At first only the batch already there counts; later both do, and the stock of 3 is then too little.
    assert got == sorted([(1, True, 3.0), (1, False, 3.0), (1, True, 1.0), (1, False, 1.0), (2, True, 1.0), (2, False, 1.0), (2, False, 1.0), (2, False, 1.0)])


def test_adjustments_are_as_many_as_in_sql(spark, shared):
    """Which of the batches of a number comes first is open in SQL, how many rows there are is not."""
    folder, con = shared
    got = {r.batch_id: r["count"] for r in registry.queries()["adjustment_replay"](spark, folder).groupBy("batch_id").count().collect()}
    assert got == dict(con.sql(f"select batch_id, count(*) from ({registry.oracle_sql()['adjustment_replay']}) group by 1").fetchall())


def test_adjustments_equal_sql_where_batches_of_a_number_have_an_order(spark, shared):
    """With the ties of the SQL's ORDER BY broken as the docstring says (first received first), all rows are the same."""
    folder, con = shared
    sql = registry.oracle_sql()["adjustment_replay"]
    told = sql.replace("a.kind, a.quantity) AS k", "a.kind, a.quantity, b.received, b.expiry, b.initial) AS k")
    assert told != sql
    got, want = registry.queries()["adjustment_replay"](spark, folder), con.sql(told)
    columns = sorted(want.columns)
    rows = sorted(repr([r[c] for c in columns]) for r in got.collect())
    assert rows and rows == sorted(repr(list(r)) for r in want.select(*columns).fetchall())


def test_an_alert_noted_twice_is_one_alert(spark, shared):
    live = spark.createDataFrame([("7", "critical"), ("8", "critical")], "key string, revision string")
    seen = spark.createDataFrame([(1, "7", "critical", False), (1, "7", "critical", True)], "user_id int, key string, revision string, dismissed boolean")
    rows = sorted((r.key, r.unread, r.dismissed) for r in inventory.acknowledged(live, seen).collect())
    assert rows == [("7", False, True), ("8", True, None)]
    same(spark, shared, "alert_ack")


def test_demands_over_batches_of_one_number(spark, shared):
    same(spark, shared, "fefo_allocate")


def test_refused_demands_over_batches_of_one_number(spark, shared):
    same(spark, shared, "fefo_refusals")


def test_lines_back_to_batches_of_one_number(spark, shared):
    same(spark, shared, "void_returns")
