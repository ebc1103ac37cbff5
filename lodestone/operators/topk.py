"""Sorted pages, keyset cursors and top-k: all end in TakeOrderedAndProject, none in a global sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.filters import alive
from lodestone.registry import query
from lodestone.views import NOW, article_pages, chunks, table, view


def page(df: DataFrame, limit: int, offset: int, *order, default: int = 20, most: int = 100) -> DataFrame:
    """One page: a limit of 0 or less is the default, one over `most` is cut, a negative offset is 0."""
    limit = default if limit <= 0 else min(limit, most)
    return df.orderBy(*order).offset(max(0, offset)).limit(limit)


@query("SELECT id, created_at FROM articles WHERE deleted_at IS NULL ORDER BY created_at DESC, id LIMIT 100 OFFSET 0")
def page_offset(spark, sf):
    return page(alive(view(spark, sf, "articles")), 500, -3, F.desc("created_at"), "id").select("id", "created_at")


@query("SELECT event_id, slot FROM (SELECT event_id, user_id % 50 AS slot FROM events) WHERE (slot, event_id) < (SELECT (user_id % 50, event_id) FROM events WHERE event_id = 77) ORDER BY slot DESC, event_id DESC LIMIT 30")
def keyset_conversations(spark, sf):
    """Rows after a cursor in (time, id) order, newest first; many times are equal."""
    rows = table(spark, sf, "events").select("event_id", (F.col("user_id") % 50).alias("slot"))
    cursor = rows.where("event_id = 77").select(F.struct("slot", "event_id").alias("c"), F.lit(1).alias("k"))
    after = rows.withColumn("k", F.lit(1)).join(F.broadcast(cursor), "k").where(F.struct("slot", "event_id") < F.col("c"))  # the cursor is one row
    return after.orderBy(F.desc("slot"), F.desc("event_id")).limit(30).select("event_id", "slot")


@query("SELECT id, role FROM messages WHERE id < 5000 ORDER BY id DESC LIMIT 25")
def keyset_messages(spark, sf):
    return view(spark, sf, "messages").where("id < 5000").orderBy(F.desc("id")).limit(25).select("id", "role")


@query("SELECT id, updated_at FROM articles WHERE deleted_at IS NULL ORDER BY updated_at DESC, id LIMIT 5")
def recent_documents(spark, sf):
    return alive(view(spark, sf, "articles")).orderBy(F.desc("updated_at"), "id").limit(5).select("id", "updated_at")


@query("SELECT article_id, seq FROM article_pages WHERE article_id = 3 AND seq >= 1 ORDER BY seq LIMIT 20")
def page_range_scan(spark, sf):
    return article_pages(spark, sf).where("article_id = 3 AND seq >= 1").orderBy("seq").limit(20).select("article_id", "seq")


def clamped(start: int, limit: int, most: int = 20) -> tuple[int, int]:
    """First and last index of a range: limits of 0 or less, or over `most`, become `most`."""
    start = max(0, start)
    return start, start + (most if limit <= 0 or limit > most else limit) - 1


@query("SELECT article_id, chunk_index FROM chunks WHERE article_id = 5 AND chunk_index BETWEEN 0 AND 19")
def scroll_range(spark, sf):
    return chunks(spark, sf).where((F.col("article_id") == 5) & F.col("chunk_index").between(*clamped(-2, 90))).select("article_id", "chunk_index")


@query("SELECT article_id, chunk_index FROM chunks WHERE article_id IN (5, 9) AND chunk_index BETWEEN 1 AND 5")
def scroll_neighbors(spark, sf):
    return chunks(spark, sf).where(F.col("article_id").isin(5, 9) & F.col("chunk_index").between(3 - 2, 3 + 2)).select("article_id", "chunk_index")


@query("SELECT point_id, article_id FROM points WHERE user_id = 4")
def scroll_all(spark, sf):
    return view(spark, sf, "points").where("user_id = 4").select("point_id", "article_id")


@query("""SELECT article_id, total, least(n, 20) AS shown, CASE WHEN least(n, 20) < 20 OR 10 + least(n, 20) >= total THEN 0 ELSE 10 + least(n, 20) END AS next_from
 FROM (SELECT article_id, count(*) AS total, count(*) FILTER (chunk_index >= 10) AS n FROM chunks GROUP BY 1)""")
def article_page_next(spark, sf):
    """Where reading goes on after the chunks 10 to 29; 0 at the end."""
    counted = chunks(spark, sf).groupBy("article_id").agg(F.count("*").alias("total"), F.count_if(F.expr("chunk_index >= 10")).alias("n"))
    shown = F.least("n", F.lit(20))
    return counted.select("article_id", "total", shown.alias("shown"), F.when((shown < 20) | (shown + 10 >= F.col("total")), 0).otherwise(shown + 10).alias("next_from"))


@query(f"SELECT id FROM articles WHERE extract_status IN ('pending', 'processing') AND next_retry_at <= {NOW} AND deleted_at IS NULL ORDER BY id LIMIT 50")
def claim_batch(spark, sf):
    due = alive(view(spark, sf, "articles")).where(F.col("extract_status").isin("pending", "processing") & (F.col("next_retry_at") <= NOW))
    return due.orderBy("id").limit(50).select("id")


@query("SELECT c_custkey AS id, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) // 20 AS batch FROM customer")
def batching(spark, sf):
    """Batches of 20 within each nation."""
    rn = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey"))
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.floor((rn - 1) / 20).alias("batch"))


@query("SELECT job_id, page_num, status FROM job_pages WHERE job_id = 7 AND page_num >= 1 ORDER BY page_num LIMIT 20")
def scan_pages(spark, sf):
    return view(spark, sf, "job_pages").where("job_id = 7 AND page_num >= 1").orderBy("page_num").limit(20).select("job_id", "page_num", "status")
