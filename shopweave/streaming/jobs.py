"""Continuous jobs: files arrive, each run takes what is new and stops; state and progress are kept in the checkpoint folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor


def arriving(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A stream of the Parquet files of this name (a glob) in a folder, with the schema they have now."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def drained(stream: DataFrame, mode: str, each: Callable[[DataFrame, int], None], checkpoint: str) -> list:
    """Process what has arrived, then stop; returns the progress of each batch."""
    query = stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query.recentProgress


def dropped(progress: list) -> int:
    """Rows that came too late for the state."""
    return sum(state["numRowsDroppedByWatermark"] for p in progress for state in p["stateOperators"])


def accept_once(events: DataFrame, delay: str) -> DataFrame:
    """The first of each (user_id, request_id) within `delay` of event time; keys older than that are forgotten."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["user_id", "request_id"])


VERDICTS = "event_id long, user_id long, request_id long, verdict string"
#: What keeps timers and values of a key.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


#: Keys share the state of one of so many lots: a lot's rows are read and its state is written at once, not key by key.
LOTS = 8192


class FirstContent(StatefulProcessor):
    """Keeps the first content of each key of a lot for a time: a later row is a replay of it, or a conflict; after that time the next row is new.

    The time is event time. A lot's timer stands at the first end of its keys and drops those that have ended; no row that comes before
    the watermark reaches them any more. The state of a lot is the list of its keys, which a batch that brings it rows reads and writes whole.
    """

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", "keys array<struct<user_id long, request_id long, content string, until long>>, timer long")

    def kept(self, held: list, timer: int | None) -> None:
        """Writes what is held and sets the timer to its first end; timer is where it stands."""
        due = min((h[3] for h in held), default=None)
        if timer is not None and timer != due:
            self.handle.deleteTimer(timer)
        if not held:
            self.first.clear()
            return
        self.first.update((held, due))
        if timer != due:
            self.handle.registerTimer(due)

    def handleInputRows(self, key, rows, timerValues):
        held, timer = self.first.get() or ([], None)
        first = {(h[0], h[1]): (h[2], h[3]) for h in held}
        out = []
        for event_id, user, request, content, ts_ms in sorted(((r.event_id, r.user_id, r.request_id, r.content, r.ts_ms) for r in rows), key=lambda r: (r[4], r[0])):
            was = first.get((user, request))
            if was is None or ts_ms >= was[1]:
                first[user, request], verdict = (content, ts_ms + self.keep_ms), "new"
            else:
                verdict = "replay" if was[0] == content else "conflict"
            out.append(Row(event_id=event_id, user_id=user, request_id=request, verdict=verdict))
        self.kept([(*k, *v) for k, v in first.items()], timer)
        return iter(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        held, _ = self.first.get() or ([], None)
        now = expiredTimerInfo.getExpiryTimeInMs()
        self.kept([tuple(h) for h in held if h[3] > max(now, timerValues.getCurrentWatermarkInMs())], None)
        return iter(())

    def close(self) -> None:
        pass


def label_submissions(events: DataFrame, delay: str, keep_ms: int) -> DataFrame:
    """new, replay or conflict for each submission (event_id, user_id, request_id, ts, content); the session's state store has to be STATE_STORE."""
    rows = events.withWatermark("ts", delay).withColumn("ts_ms", F.unix_millis("ts")).withColumn("lot", F.pmod(F.xxhash64("user_id", "request_id"), F.lit(LOTS)))
    return rows.groupBy("lot").transformWithState(FirstContent(keep_ms), VERDICTS, "Append", "EventTime")


def bursts(events: DataFrame, gap: str, delay: str) -> DataFrame:
    """Changes of one kind with less than `gap` between them as one notification: (kind, start, end, changes).

    In append mode a burst is given once, when the watermark has passed its end, and leaves the state; later rows are dropped.
    """
    sessions = events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("s"), "event_type").agg(F.count("*").alias("changes"))
    return sessions.select(F.col("event_type").alias("kind"), F.col("s.start").alias("start"), F.col("s.end").alias("end"), "changes")


def append_to(folder: str) -> Callable[[DataFrame, int], None]:
    """Writes each batch to a folder of its number, so that a batch that runs again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return write


def restate_buckets(history: Callable[[], DataFrame], folder: str) -> Callable[[DataFrame, int], None]:
    """Recomputes the days that a batch touches from the stored receipts: late, changed and voided ones restate their day."""

    def write(batch: DataFrame, number: int) -> None:
        touched = batch.select("day").distinct()
        sums = history().filter("not voided").join(touched, "day", "left_semi").groupBy("day").agg(F.sum("amount").cast("double").alias("revenue"), F.count("*").alias("receipts"))
        full = touched.join(sums, "day", "left").select("day", F.coalesce("revenue", F.lit(0.0)).alias("revenue"), F.coalesce("receipts", F.lit(0)).alias("receipts"), F.lit(number).alias("version"))
        full.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return write


def latest_versions(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.read.parquet(folder)
    return rows.groupBy("day").agg(F.max(F.struct("version", "revenue", "receipts")).alias("l")).select("day", "l.revenue", "l.receipts")
