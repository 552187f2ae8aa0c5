"""Streams batch by batch: verdicts, late rows, state that is dropped; sinks that a second run does not change."""

import datetime as dt

import pytest

from shopweave.operators import ledger
from shopweave.streaming import jobs

START = dt.datetime(2024, 1, 1)


def minutes(n):
    return START + dt.timedelta(minutes=n)


def fed(spark, tmp_path, batches, schema, run):
    """Each batch as one file that arrives after the former was processed; rows and progress of every run."""
    out, progress = [], []
    spark.createDataFrame([], schema).coalesce(1).write.parquet(f"{tmp_path}/empty")
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        got = []
        progress += jobs.drained(run(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")), "append", lambda b, _, got=got: got.extend(b.collect()), f"{tmp_path}/checkpoint")
        out.append(got)
    return out, progress


@pytest.fixture
def state_store(spark):
    key, store = jobs.STATE_STORE
    before = spark.conf.get(key)
    spark.conf.set(key, store)
    yield
    spark.conf.set(key, before)


def test_submissions_are_labelled(spark, tmp_path, state_store):
    schema = "event_id long, user_id long, request_id long, ts timestamp, content string"
    batches = [
        [(1, 1, 1, minutes(0), "a"), (3, 1, 1, minutes(9), "b"), (2, 1, 1, minutes(5), "a"), (4, 1, 2, minutes(5), "b")],
        [(5, 1, 1, minutes(20), "a"), (6, 1, 1, minutes(30), "c")],
        # The content of the first batch has been kept for half an hour: the next row is the first again.
        [(7, 1, 1, minutes(40), "c"), (8, 2, 1, minutes(200), "z")],
        # Before the watermark (190 minutes): dropped, whatever it holds.
        [(9, 1, 1, minutes(41), "c"), (10, 1, 2, minutes(195), "b")],
    ]
    out, progress = fed(spark, tmp_path, batches, schema, lambda s: jobs.label_submissions(s, "10 minutes", 30 * 60_000))
    verdicts = [{r.event_id: r.verdict for r in got} for got in out]
    assert verdicts == [{1: "new", 2: "replay", 3: "conflict", 4: "new"}, {5: "replay", 6: "new"}, {7: "replay", 8: "new"}, {10: "new"}]
    assert jobs.dropped(progress) == 1


def test_bursts_close_once_and_leave_the_state(spark, tmp_path):
    batches = [
        [(minutes(0), "a"), (minutes(3), "a"), (minutes(4), "b")],
        [(minutes(6), "a"), (minutes(100), "a")],
        [(minutes(7), "a"), (minutes(101), "a"), (minutes(300), "b")],
        [(minutes(600), "b")],
    ]
    out, progress = fed(spark, tmp_path, batches, "ts timestamp, event_type string", lambda s: jobs.bursts(s, "5 minutes", "30 minutes"))
    bursts = sorted((r.kind, r.start, r.end, r.changes) for got in out for r in got)
    assert bursts == [("a", minutes(0), minutes(11), 3), ("a", minutes(100), minutes(106), 2), ("b", minutes(4), minutes(9), 1), ("b", minutes(300), minutes(305), 1)]
    assert jobs.dropped(progress) == 1  # minute 7 came when minute 70 was the watermark
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] == 1  # the last burst is open


def test_append_once_keeps_what_is_stored(spark, tmp_path):
    folder, schema = f"{tmp_path}/t", "k long, j string, v string"
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    assert ledger.append_once(rows((1, "a", "x"), (2, "a", "x"), (2, "a", "b")), folder, "k", "j", buckets=4) == 2
    assert ledger.append_once(rows((2, "a", "changed"), (3, None, "y"), (4, "a", "z")), folder, "k", "j", buckets=4) == 2
    assert ledger.append_once(rows((4, "a", "again"), (3, None, "again")), folder, "k", "j", buckets=4) == 0
    assert ledger.append_once(rows((1, "a", "x")).filter("false"), folder, "k", "j", buckets=4) == 0
    got = sorted((r.k, r.v) for r in spark.read.parquet(folder).collect())
    assert got == [(1, "x"), (2, "b"), (3, "y"), (4, "z")]
    # Keys alone make a table too.
    assert ledger.append_once(spark.createDataFrame([(1,), (1,), (2,)], "k long"), f"{tmp_path}/keys", "k") == 2


def test_export_is_verified(spark, tmp_path):
    receipts = spark.createDataFrame([(i, dt.date(1996 + i % 2, 5, 1 + i % 9), f"r{i}") for i in range(40)], "id long, day date, reference string")
    lines = spark.createDataFrame([(i, i % 40) for i in range(90)], "line long, receipt_id long")
    tables = {"receipt": receipts, "line": lines}
    manifest = ledger.export_years(tables, f"{tmp_path}/x")
    assert {(r.table_name, r.rows, r.verified) for r in ledger.verified_export(manifest, tables, f"{tmp_path}/x").collect()} == {("receipt", 40, True), ("line", 90, True)}
    lines.limit(89).write.mode("overwrite").parquet(f"{tmp_path}/x/line")
    assert {(r.table_name, r.verified) for r in ledger.verified_export(manifest, tables, f"{tmp_path}/x").collect()} == {("receipt", True), ("line", False)}
    assert {r.year for r in spark.read.parquet(f"{tmp_path}/x/receipt").collect()} == {1996, 1997}


def test_keys_of_one_lot_end_by_themselves(spark, tmp_path, state_store, monkeypatch):
    monkeypatch.setattr(jobs, "LOTS", 1)
    batches = [[(1, 1, 1, minutes(0), "a"), (2, 2, 1, minutes(20), "b")], [(3, 1, 1, minutes(45), "c"), (4, 2, 1, minutes(46), "b")], [(5, 1, 1, minutes(50), "a"), (6, 2, 1, minutes(60), "x")]]
    out, progress = fed(spark, tmp_path, batches, "event_id long, user_id long, request_id long, ts timestamp, content string", lambda s: jobs.label_submissions(s, "10 minutes", 30 * 60_000))
    assert [{r.event_id: r.verdict for r in got} for got in out] == [{1: "new", 2: "new"}, {3: "new", 4: "replay"}, {5: "conflict", 6: "new"}]
    # Two keys are one row of state.
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] <= 2
