"""Joins by the nearest earlier time, and quantile sketches that are stored and merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.registry import query
from lodestone.sources.sinks import folder
from lodestone.views import table


def last_before(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: str, bucket: Column) -> DataFrame:
    """left with value of the last row of right that has the same keys and is not later; null if there is none.

    bucket is a whole number that grows with time. Both sides meet in buckets, so a task holds a bucket of a key and never the
    whole key; what a bucket ends with is carried to the next ones over one row per key and bucket. Of right's rows at one time the
    largest value counts.
    """
    rest = [c for c in left.columns if c not in keys and c != at]
    mine = left.select(*keys, at, F.struct(*rest).alias("_row"), F.lit(None).cast(right.schema[value].dataType).alias("_value"), F.lit(1).alias("_side"))
    theirs = right.select(*keys, at, F.lit(None).cast(mine.schema["_row"].dataType).alias("_row"), F.col(value).alias("_value"), F.lit(0).alias("_side"))
    both = mine.unionByName(theirs).withColumn("_bucket", bucket)
    inside = Window.partitionBy(*keys, "_bucket").orderBy(at, "_side", "_value").rowsBetween(Window.unboundedPreceding, 0)
    placed = both.withColumn("_last", F.last("_value", ignorenulls=True).over(inside))
    ends = both.where("_side = 0").groupBy(*keys, "_bucket").agg(F.max_by("_value", F.struct(at, "_value")).alias("_end"))
    used = both.where("_side = 1").select(*keys, "_bucket").distinct()
    every = used.join(ends, [*keys, "_bucket"], "full")
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = every.withColumn("_carried", F.last("_end", ignorenulls=True).over(before)).select(*keys, "_bucket", "_carried")
    joined = placed.where("_side = 1").join(carried, [*keys, "_bucket"], "left")
    return joined.select(*keys, at, "_row.*", F.coalesce("_last", "_carried").alias(value))


@query("""SELECT e.event_id, h.beat FROM (SELECT event_id, user_id % 12 AS worker_id, ts FROM events) e ASOF LEFT JOIN (SELECT user_id % 12 AS worker_id, ts, ts AS beat FROM events WHERE event_type = 'error') h ON e.worker_id = h.worker_id AND e.ts >= h.ts""")
def heartbeat_asof(spark, sf):
    """Each event with the last heartbeat of its worker; events of one type stand for heartbeats."""
    events = table(spark, sf, "events").select("event_id", (F.col("user_id") % 12).alias("worker_id"), "ts", "event_type")
    beats = events.where("event_type = 'error'").select("worker_id", "ts", F.col("ts").alias("beat"))
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000)
    return last_before(events.select("event_id", "worker_id", "ts"), beats, ["worker_id"], "ts", "beat", hour).select("event_id", "beat")


SKETCH = 1024  # the k of a sketch: the rank of an answer is off by more than RANK_ERROR once in some thousand
RANK_ERROR = 0.01


def sketched(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """A sketch of value for each group, as binary: small rows to store, and to merge for any coarser grouping."""
    return rows.groupBy(*keys).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(SKETCH)).alias("sketch"))


def merged(sketches: DataFrame, keys: list[str]) -> DataFrame:
    return sketches.groupBy(*keys).agg(F.kll_merge_agg_double("sketch").alias("sketch"))


def quantile(at: float) -> Column:
    return F.kll_sketch_get_quantile_double("sketch", F.lit(at))


@query("SELECT event_type AS step, count(*) AS n, true AS p50_close, true AS p95_close FROM events GROUP BY 1")
def latency_sketch(spark, sf):
    """Whether the quantiles of merged daily sketches are within the sketch's bound, by their ranks among all events.

    The sketches of types and days are stored; the exact query is latency_summary.
    """
    events = table(spark, sf, "events")
    sketched(events.select(F.col("event_type").alias("step"), F.to_date("ts").alias("day"), "value"), ["step", "day"], "value").write.parquet(at := folder(spark, "sketches"))
    found = merged(spark.read.parquet(at), ["step"]).select("step", quantile(0.5).alias("p50"), quantile(0.95).alias("p95"))
    ranked = events.withColumnRenamed("event_type", "step").join(found, "step").groupBy("step")
    under = {f"{c}_{side}": F.count_if(F.col("value") < F.col(c)) if side == "low" else F.count_if(F.col("value") <= F.col(c)) for c in ("p50", "p95") for side in ("low", "high")}
    counts = ranked.agg(F.count("*").alias("n"), *[x.alias(k) for k, x in under.items()])
    close = lambda c, q: (F.col(f"{c}_low") / F.col("n") <= q + RANK_ERROR) & (F.col(f"{c}_high") / F.col("n") >= q - RANK_ERROR)
    return counts.select("step", "n", close("p50", 0.5).alias("p50_close"), close("p95", 0.95).alias("p95_close"))
