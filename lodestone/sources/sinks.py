"""Idempotent writes: insert-ignore, keep-latest upserts, merge-add, partition replacement.

Each gives the target's next state as a DataFrame; `replace` stores it. Shuffles are on the key only, and
both sides aggregate before they meet.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.registry import query
from lodestone.views import article_pages, chunks, table, view


def shared(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, which a cluster must set; a temporary one in local runs."""
    if not (base := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.conf.get("spark.master", "").startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.conf.set("spark.checkpoint.dir", base := f"file://{tempfile.mkdtemp(prefix='lodestone-')}")
    return base.rstrip("/")


def folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared(spark)}/lodestone/{name}-{uuid.uuid4().hex}"


def insert_ignore(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """target and the rows whose key it has not; of rows with one key any stays."""
    return target.unionByName(rows.join(target.select(keys), keys, "left_anti").dropDuplicates(keys))


def keep_latest(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """target with rows put over it: the later one of a key wins; an aggregate that combines before the shuffle."""
    rest = [c for c in target.columns if c not in keys]
    both = target.select(*keys, F.struct(*rest).alias("v"), F.lit(0).alias("o")).unionByName(rows.select(*keys, F.struct(*rest).alias("v"), F.lit(1).alias("o")))
    return both.groupBy(*keys).agg(F.max_by("v", "o").alias("v")).select(*keys, "v.*")


def merge_add(target: DataFrame, rows: DataFrame, keys: list[str], counters: list[str]) -> DataFrame:
    """Counters of equal keys added up."""
    return target.unionByName(rows).groupBy(*keys).agg(*[F.sum(c).cast("long").alias(c) for c in counters])


def replace_partitions(rows: DataFrame, path: str, by: str) -> DataFrame:
    """Stores rows by partition; partitions that rows has none of stay as they are. Large partitions are split over tasks."""
    rows.hint("rebalance", by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
    return rows.sparkSession.read.parquet(path)


@query("SELECT article_id, seq, length(text) AS size FROM article_pages WHERE seq % 2 = 1 UNION ALL SELECT article_id, seq, 0 FROM article_pages WHERE seq % 2 = 0")
def page_insert_ignore(spark, sf):
    """Odd pages are stored; of all pages sent again without text only the even ones go in."""
    pages = article_pages(spark, sf).select("article_id", "seq", F.char_length("text").alias("size"))
    return insert_ignore(pages.where("seq % 2 = 1"), pages.withColumn("size", F.lit(0)), ["article_id", "seq"])


@query("SELECT point_id, CASE WHEN point_id % 3 = 0 THEN -article_id ELSE article_id END AS article_id FROM points UNION ALL SELECT point_id + 1000000, -article_id FROM points WHERE point_id % 3 = 0")
def point_upsert(spark, sf):
    """Every third point is written again, and as a new point too; all vectors must have one length."""
    points = view(spark, sf, "points")
    sound = F.when(F.size("embedding") == 64, F.col("article_id")).otherwise(F.raise_error(F.lit("a vector has another length")).cast("long"))
    stored = points.select("point_id", sound.alias("article_id"))
    again = stored.where("point_id % 3 = 0").select("point_id", (-F.col("article_id")).alias("article_id"))
    return keep_latest(stored, again.union(again.select(F.col("point_id") + 1000000, "article_id")), ["point_id"])


@query("SELECT article_id, section, m + CASE WHEN article_id % 2 = 0 THEN 1000 ELSE 0 END AS start_chunk FROM (SELECT article_id, chunk_index // 3 AS section, min(chunk_index) AS m FROM chunks GROUP BY ALL)")
def section_upsert(spark, sf):
    rows = chunks(spark, sf).groupBy("article_id", F.expr("chunk_index div 3").alias("section")).agg(F.min("chunk_index").alias("start_chunk"))
    return keep_latest(rows, rows.where("article_id % 2 = 0").withColumn("start_chunk", F.col("start_chunk") + 1000), ["article_id", "section"])


@query("SELECT source, count(*) AS n FROM (SELECT source FROM documents UNION ALL SELECT source FROM documents WHERE source IN (SELECT min(source) FROM documents)) WHERE true GROUP BY 1")
def section_replace(spark, sf):
    """All sources are stored; the first one's partition is then replaced by its rows twice."""
    docs = table(spark, sf, "documents").select("doc_id", "source")
    path = folder(spark, "sections")
    replace_partitions(docs, path, "source")
    least = docs.agg(F.min("source").alias("source"))
    twice = docs.join(F.broadcast(least), "source").select("doc_id", "source")  # one row
    return replace_partitions(twice.union(twice), path, "source").groupBy("source").agg(F.count("*").alias("n"))


def first_of(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with one key the first by an order; an aggregate that combines before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("v")).select(*keys, "v.*").select(rows.columns)


@query(""", d AS (SELECT user_id, day, site, provider, model, calls, tokens FROM usage UNION ALL SELECT user_id, day, site, provider, model, calls, tokens FROM (SELECT *, row_number() OVER (PARTITION BY day, site, provider, model ORDER BY event_id) AS rn FROM usage) WHERE rn = 1)
SELECT user_id, day, site, provider, model, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(tokens) AS BIGINT) AS tokens FROM d GROUP BY ALL""")
def usage_merge_add(spark, sf):
    """Stored usage, and the same rows sent again as one report: of its rows with one day, site, provider and model the first counts, and adds up with what is stored."""
    keys = ["user_id", "day", "site", "provider", "model"]
    stored = view(spark, sf, "usage")
    report = first_of(stored, keys[1:], "event_id")
    columns = [*keys, "calls", "tokens"]
    return merge_add(stored.select(columns), report.select(columns), keys, ["calls", "tokens"])


@query("SELECT md5(text) AS h, count(*) AS chunk_count FROM documents GROUP BY 1")
def cache_put(spark, sf):
    """Texts put into a cache; those already there count up."""
    rows = table(spark, sf, "documents").select("doc_id", F.md5(F.encode("text", "UTF-8")).alias("h"), F.lit(1).alias("chunk_count"))
    return merge_add(rows.where("doc_id % 2 = 0").drop("doc_id"), rows.where("doc_id % 2 = 1").drop("doc_id"), ["h"], ["chunk_count"])


@query("SELECT o_orderkey AS id, CAST(count(l_linenumber) AS BIGINT) AS pages FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def counted_insert(spark, sf):
    """Jobs and pages are appended, and each job's pages are counted as stored."""
    at = folder(spark, "jobs")
    view(spark, sf, "jobs").select("id").write.parquet(f"{at}/jobs")
    view(spark, sf, "job_pages").select(F.col("job_id").alias("id"), "page_num").write.parquet(f"{at}/pages")
    counts = spark.read.parquet(f"{at}/pages").groupBy("id").agg(F.count("*").alias("pages"))
    return spark.read.parquet(f"{at}/jobs").join(counts, "id", "left").select("id", F.coalesce("pages", F.lit(0)).alias("pages"))
