"""Rate limits on streams that come out of order: events wait in state until the watermark passes them.

Each user's waiting events are state, and an event-time timer stands at the first. When the watermark passes it,
all it has passed is judged in order of time, so micro-batches in any order, within the allowed lateness, give what the sorted
stream gives. A limit's own state goes with a last timer once it would judge a new event as no state does.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lodestone.registry import query
from lodestone.sources.sinks import folder
from lodestone.streaming.events import stream
from lodestone.views import table

JUDGED = "event_id long, user_id long, ts double, allowed boolean"


class Limit:
    """A limit's rule: state is two numbers, or None for a user who is new or long silent."""

    def judge(self, state: tuple | None, at: float) -> tuple[tuple, bool]:
        raise NotImplementedError

    def forgotten(self, state: tuple) -> float:
        """The time from which on no state judges alike."""
        raise NotImplementedError


class FixedWindow(Limit):
    """So many hits in a window that starts at its first hit."""

    def __init__(self, limit: int, seconds: float):
        self.limit, self.seconds = limit, seconds

    def judge(self, state, at):
        start, used = state if state is not None and at - state[0] < self.seconds else (at, 0)
        return (start, used + 1), used < self.limit

    def forgotten(self, state):
        return state[0] + self.seconds


class Bucket(Limit):
    """A bucket that refills steadily; each hit takes one token or is refused."""

    def __init__(self, capacity: float, per_second: float):
        self.capacity, self.per_second = capacity, per_second

    def judge(self, state, at):
        level = self.capacity if state is None else min(self.capacity, state[0] + self.per_second * max(0.0, at - state[1]))
        return (level - (level >= 1), at), level >= 1

    def forgotten(self, state):
        return state[1] + (self.capacity - state[0]) / self.per_second


class Judge(StatefulProcessor):
    """Holds a user's events until the watermark has passed them; then the limit judges them in order.

    A waiting event is put once and is read once it is due; one timer a user stands at the first of them, and when it goes
    off, all that the watermark has passed is judged, so the calls of state grow with the events.
    """

    def __init__(self, limit: Limit):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at long, event_id long", "none boolean")
        self.first = handle.getValueState("first", "at long")
        self.used = handle.getValueState("used", "x double, y double")

    def wait(self, at: int) -> None:
        """Sets the timer for what waits from a time on."""
        self.first.update((at,))
        self.handle.registerTimer(at // 1000 + 1)  # in milliseconds; events are in microseconds

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        least = None
        for batch in rows:
            for at, event in zip(batch["at"].tolist(), batch["event_id"].tolist(), strict=True):
                self.waiting.updateValue((at, event), (False,))
            low = int(batch["at"].min())
            least = low if least is None else min(least, low)
        first = self.first.get()
        if least is not None and (first is None or least < first[0]):
            self.wait(least)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        first, state = self.first.get(), self.used.get()
        due, later = [], []
        if first is not None and first[0] < passed * 1000:
            for at, event in self.waiting.keys():
                (due if at < passed * 1000 else later).append((at, event))
            due.sort()
            if later:
                for event in due:
                    self.waiting.removeKey(event)
                self.wait(min(later)[0])
            else:
                self.waiting.clear()
                self.first.clear()
        rows = []
        for at, event in due:
            state, allowed = self.limit.judge(state, at / 1e6)
            rows.append((event, key[0], at / 1e6, allowed))
        over = None if state is None else int(self.limit.forgotten(state) * 1000) + 2
        if over is not None and over <= passed and not later and (due or first is None):
            self.used.clear()
        elif due:
            self.used.update(tuple(map(float, state)))
            self.handle.registerTimer(over)
        if rows:
            yield pd.DataFrame(rows, columns=["event_id", "user_id", "ts", "allowed"])

    def close(self) -> None:
        pass


def limited(events: DataFrame, limit: Limit, late: str) -> DataFrame:
    """event_id, user_id, ts, allowed of events (event_id, user_id, ts) that come at most so late; later ones are dropped by the watermark."""
    rows = events.select("event_id", "user_id", "ts", F.unix_micros("ts").alias("at")).withWatermark("ts", late)
    return rows.groupBy("user_id").transformWithStateInPandas(Judge(limit), JUDGED, "Append", "EventTime")


@contextlib.contextmanager
def rocksdb(spark: SparkSession):
    """State with timers needs this store; what the session had comes back afterwards."""
    key, old = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, old) if old else spark.conf.unset(key)


def disorder(events: DataFrame) -> int:
    """By how many seconds a stored table's files are out of order as a stream reads them: the most by which a file begins before an earlier one ends."""
    files = events.groupBy(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("written")).agg(F.min("ts").alias("low"), F.max("ts").alias("high"))
    before = Window.orderBy("written", "file").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    behind = files.select((F.unix_seconds(F.max("high").over(before).cast("timestamp")) - F.unix_seconds(F.col("low").cast("timestamp"))).alias("s"))
    return max(0, behind.agg(F.max("s")).first()[0] or 0) + 2


def replayed(spark: SparkSession, sf: str, limit: Limit) -> DataFrame:
    """The limit over all stored events.

    The stream runs over the table and then, from the same checkpoint, over one more event far ahead, which moves the
    watermark past all that still waits.
    """
    at, late = folder(spark, "limited"), disorder(table(spark, sf, "events"))
    columns = "event_id long, user_id long, ts timestamp"
    spark.createDataFrame([], columns).write.parquet(f"{at}/closing")
    closing = spark.readStream.schema(columns).parquet(f"{at}/closing")
    judged = limited(stream(spark, sf).select("event_id", "user_id", "ts").union(closing), limit, f"{late} seconds")
    with rocksdb(spark):
        for last in (False, True):
            if last:
                end = table(spark, sf, "events").select(F.lit(-1).cast("long"), F.lit(-1).cast("long"), F.max(F.col("ts").cast("timestamp")) + F.make_dt_interval(secs=F.lit(late + 3600)))
                end.where(F.col(end.columns[2]).isNotNull()).toDF("event_id", "user_id", "ts").coalesce(1).write.mode("append").parquet(f"{at}/closing")
            judged.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(JUDGED).parquet(f"{at}/out").select("event_id", "user_id", "allowed")


_ORDERED = ", o AS (SELECT event_id, user_id, epoch_us(ts) / 1000000 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)"


@query(_ORDERED + """, f AS (SELECT user_id, i, event_id, t AS start, 1 AS used FROM o WHERE i = 1
 UNION ALL SELECT o.user_id, o.i, o.event_id, CASE WHEN o.t - start >= 86400 THEN o.t ELSE start END, CASE WHEN o.t - start >= 86400 THEN 1 ELSE used + 1 END FROM f JOIN o ON o.user_id = f.user_id AND o.i = f.i + 1)
SELECT event_id, user_id, used <= 5 AS allowed FROM f""")
def rate_fixed_window(spark, sf):
    """Five events a day for each user, from the first event of a window on."""
    return replayed(spark, sf, FixedWindow(5, 86400.0))


@query(_ORDERED + """, f AS (SELECT user_id, i, event_id, t, 4.0::DOUBLE AS level, true AS allowed FROM o WHERE i = 1
 UNION ALL SELECT user_id, i, event_id, t, CASE WHEN had >= 1 THEN had - 1 ELSE had END, had >= 1 FROM (SELECT o.user_id, o.i, o.event_id, o.t, least(5.0::DOUBLE, level + (5 / 86400) * (o.t - f.t)) AS had FROM f JOIN o ON o.user_id = f.user_id AND o.i = f.i + 1))
SELECT event_id, user_id, allowed FROM f""")
def token_bucket(spark, sf):
    """Five tokens a user, refilled over a day."""
    return replayed(spark, sf, Bucket(5.0, 5 / 86400))
