"""Streams over the driver's files, each drained once, and their batch twins as SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from shopweave.plans.prelude import sql
from shopweave.plans.sales import money
from shopweave.sources.scratch import shared_dir
from shopweave.streaming import jobs

#: How long a submission's content is kept, in event time.
KEPT_DAYS = 7


def dedup(s):
    at = shared_dir(s.spark)
    content = F.concat_ws("/", "event_type", F.floor(F.col("value") / 100).cast("long"))
    events = jobs.arriving(s.spark, s.dir, "events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("long"), (F.col("event_id") % 700).cast("long").alias("request_id"), content.alias("content"))
    key, store = jobs.STATE_STORE
    before = s.spark.conf.get(key)
    s.spark.conf.set(key, store)
    try:
        jobs.drained(jobs.label_submissions(events, "1 hour", KEPT_DAYS * 86_400_000), "append", jobs.append_to(f"{at}/out"), f"{at}/checkpoint")
    finally:
        s.spark.conf.set(key, before)
    return s.spark.read.parquet(f"{at}/out").select("event_id", "user_id", "request_id", "verdict")


def coalesced(s):
    at = shared_dir(s.spark)
    events = jobs.arriving(s.spark, s.dir, "events.parquet").selectExpr("cast(ts as timestamp) as ts", "event_type")
    jobs.drained(jobs.bursts(events, "5 minutes", "1 hour"), "append", jobs.append_to(f"{at}/out"), f"{at}/checkpoint")
    return s.spark.read.parquet(f"{at}/out").groupBy("kind", "changes").agg(F.count("*").alias("bursts"))


def rollup(s):
    at = shared_dir(s.spark)
    stream = jobs.arriving(s.spark, s.dir, "orders.parquet").select(F.to_date("o_orderdate").alias("day"))
    jobs.drained(stream, "append", jobs.restate_buckets(lambda: s.receipts, f"{at}/out"), f"{at}/checkpoint")
    return jobs.latest_versions(s.spark, f"{at}/out")


QUERIES = {
    "stream_dedup_submissions": (dedup, sql(f""", ranked AS (SELECT *, epoch_ms(ts) AS ms, concat_ws('/', endpoint, payload) AS content, row_number() OVER (PARTITION BY user_id, request_id ORDER BY epoch_ms(ts), event_id) AS k FROM submission),
            told AS (SELECT r.*, content AS held, ms AS since, 'new' AS verdict FROM ranked r WHERE k = 1
                UNION ALL SELECT r.*, CASE WHEN r.ms >= t.since + {KEPT_DAYS} * 86400000 THEN r.content ELSE t.held END, CASE WHEN r.ms >= t.since + {KEPT_DAYS} * 86400000 THEN r.ms ELSE t.since END,
                    CASE WHEN r.ms >= t.since + {KEPT_DAYS} * 86400000 THEN 'new' WHEN r.content = t.held THEN 'replay' ELSE 'conflict' END
                FROM told t JOIN ranked r ON r.user_id = t.user_id AND r.request_id = t.request_id AND r.k = t.k + 1)
            SELECT event_id, user_id, request_id, verdict FROM told""").replace("WITH ", "WITH RECURSIVE ", 1)),
    "stream_change_coalesce": (
        coalesced,
        sql(""", g AS (SELECT endpoint, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 5 MINUTE THEN 1 ELSE 0 END AS new FROM submission WINDOW w AS (PARTITION BY endpoint ORDER BY ts)),
            n AS (SELECT endpoint, ts, sum(new) OVER (PARTITION BY endpoint ORDER BY ts) AS b FROM g), c AS (SELECT endpoint, b, count(*) AS changes FROM n GROUP BY 1, 2 HAVING max(ts) + INTERVAL 5 MINUTE <= (SELECT max(ts) - INTERVAL 1 HOUR FROM submission))
            SELECT endpoint AS kind, changes, count(*) AS bursts FROM c GROUP BY 1, 2"""),
    ),
    "stream_sales_rollup": (
        rollup,
        sql(f"SELECT day, {money('sum(CASE WHEN NOT voided THEN amount END)')} AS revenue, count(CASE WHEN NOT voided THEN 1 END) AS receipts FROM receipt GROUP BY 1"),
    ),
}
