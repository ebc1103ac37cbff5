"""Event streams on Structured Streaming: windows with watermarks, deduplication, upserts.

Every function takes a streaming or a batch DataFrame. The queries run the streams over the stored events with
the availableNow trigger, so that they end, and return what the sink holds.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.registry import query
from lodestone.sources.sinks import folder
from lodestone.views import table

WINDOW = "1 day"


def stream(spark: SparkSession, sf: str, name: str = "events", ts: str | None = "ts") -> DataFrame:
    """A stored table, one file or a folder of part files, as a stream; its column of times, if it has one, becomes an instant, as watermarks need it."""
    stored = table(spark, sf, name)
    reader = spark.readStream.schema(stored.schema).option("maxFilesPerTrigger", 64)
    if any(file.endswith(f"/{name}.parquet") for file in stored.inputFiles()[:1]):
        rows = reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf)
    else:
        rows = reader.parquet(f"{sf}/{name}.parquet")
    return rows.withColumn(ts, F.col(ts).cast("timestamp")) if ts else rows


def finished(df: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over all there is, into Parquet files in the shared folder, and reads them."""
    spark, at = df.sparkSession, folder(df.sparkSession, "stream")
    if mode == "append":
        writer = df.writeStream.format("parquet").option("path", f"{at}/out")
    else:
        def keep(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{at}/out")

        writer = df.writeStream.outputMode(mode).foreachBatch(keep)
    writer.option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{at}/out")


def tumbling(events: DataFrame, width: str = WINDOW, late: str = "1 hour") -> DataFrame:
    """Events and their sum by type and window."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@query("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_window(spark, sf):
    return finished(tumbling(stream(spark, sf)), "complete")


@query("""SELECT CAST(time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '1970-01-01') - to_hours(12 * k) AS TIMESTAMP) AS start, count(*) AS n FROM events, (VALUES (0), (1)) v(k) GROUP BY ALL""")
def sliding_window(spark, sf):
    events = stream(spark, sf).withWatermark("ts", "1 hour")
    return finished(events.groupBy(F.window("ts", "1 day", "12 hours").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n"), "complete")


@query("""SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s
 FROM (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 6 HOUR, true) AS gap FROM events)) GROUP BY user_id, s""")
def session_window(spark, sf):
    """Sessions of a user: a pause of six hours ends one."""
    events = table(spark, sf, "events")
    return events.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


@query("SELECT DISTINCT event_id FROM events")
def dedup_stream(spark, sf):
    """Events sent twice are kept once. Files of a stored table come in any order of time, so no watermark ends the state: one row an event."""
    twice = stream(spark, sf).union(stream(spark, sf))
    return finished(twice.select("event_id").dropDuplicates(["event_id"]))


def apply_stream(rows: DataFrame, transition, target: str) -> DataFrame:
    """Applies transition(state, batch) to the stored state for each micro-batch: a new version of it is written
    beside the old one, named by the batch, so a batch that is repeated gives the same version, and a query
    that is started again goes on from the version of the batch before."""
    spark, at = rows.sparkSession, f"{target}/state"

    def step(batch: DataFrame, number: int) -> None:
        state = batch.sparkSession.read.parquet(f"{at}/v={number - 1}") if number else None
        transition(state, batch).write.mode("overwrite").parquet(f"{at}/v={number}")

    rows.writeStream.foreachBatch(step).option("checkpointLocation", f"{target}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/v={spark.read.parquet(at).agg(F.max('v')).first()[0]}")


@query("SELECT user_id, count(*) AS n, max(ts) AS last_seen FROM events GROUP BY 1")
def heartbeat_state(spark, sf):
    """The last event of each user, kept as a table by upserts of micro-batches."""

    def upsert(state, batch):
        news = batch.groupBy("user_id").agg(F.count("*").alias("n"), F.max(F.col("ts").cast("timestamp_ntz")).alias("last_seen"))
        both = news if state is None else state.unionByName(news)
        return both.groupBy("user_id").agg(F.sum("n").alias("n"), F.max("last_seen").alias("last_seen"))

    return apply_stream(stream(spark, sf), upsert, f"{folder(spark, 'state')}-{uuid.uuid4().hex}")


@query("SELECT DISTINCT event_id // 32 AS flush, count(*) OVER (PARTITION BY event_id // 32) AS n FROM events WHERE event_id >= 100")
def resume_checkpoint(spark, sf):
    """Flushes of 32 from a checkpoint on: what was done before it is skipped."""
    events = table(spark, sf, "events").where("event_id >= 100")
    return events.groupBy(F.expr("event_id div 32").alias("flush")).agg(F.count("*").alias("n"))


def scheduled(rows: DataFrame, work, interval: str | None, at: str):
    """A job run by a trigger: at once and then every interval, or once over what there is. A failure ends the query with its error."""
    writer = rows.writeStream.foreachBatch(work).option("checkpointLocation", at)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


@query("SELECT count(*) AS n FROM events")
def schedules(spark, sf):
    """One run of a scheduled job, which stores the number of events it saw."""
    at = folder(spark, "schedule")
    scheduled(stream(spark, sf), lambda batch, number: batch.groupBy().agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{at}/v{number}"), None, f"{at}/checkpoint").awaitTermination()
    return spark.read.schema("n long").parquet(f"{at}/v*").groupBy().agg(F.sum("n").alias("n"))
