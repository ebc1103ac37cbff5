"""Predicates and projections over articles, pages, usage, jobs and messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.registry import query
from lodestone.views import NOW, article_pages, table, view

BLANKS = " \t\r\n\f\v"


def alive(df: DataFrame) -> DataFrame:
    """Without soft-deleted rows."""
    return df.where("deleted_at IS NULL")


def in_scope(user_id: int, category_ids: tuple[int, ...] = (), article_id: int = 0) -> Column:
    """Owner, and the categories and article if any are named."""
    cond = F.col("user_id") == user_id
    if category_ids:
        cond &= F.col("category_id").isin(*category_ids)
    if article_id > 0:
        cond &= F.col("article_id") == article_id
    return cond


@query("SELECT point_id, article_id FROM points WHERE user_id = 1 AND category_id IN (1, 2, 3)")
def scope_filter(spark, sf):
    return view(spark, sf, "points").where(in_scope(1, (1, 2, 3))).select("point_id", "article_id")


@query("SELECT id, category_id IN (2, 4, 6) AS allowed FROM articles")
def allows_category(spark, sf):
    return view(spark, sf, "articles").select("id", F.col("category_id").isin(2, 4, 6).alias("allowed"))


@query("SELECT id, name FROM articles WHERE id = 36 AND user_id = 1 AND deleted_at IS NULL")
def owner_get(spark, sf):
    return alive(view(spark, sf, "articles")).where("id = 36 AND user_id = 1").select("id", "name")


@query("SELECT user_id, count(*) > 0 AS found FROM articles WHERE url = 'http://site/6/doc' AND deleted_at IS NULL GROUP BY 1")
def exists_by_url(spark, sf):
    return alive(view(spark, sf, "articles")).where("url = 'http://site/6/doc'").groupBy("user_id").agg((F.count("*") > 0).alias("found"))


@query("SELECT user_id, count(*) > 0 AS found FROM articles WHERE storage_key LIKE 'up/1%' AND deleted_at IS NULL GROUP BY 1")
def exists_by_key(spark, sf):
    return alive(view(spark, sf, "articles")).where(F.col("storage_key").startswith("up/1")).groupBy("user_id").agg((F.count("*") > 0).alias("found"))


@query(", ask AS (SELECT unnest(range(0, 60, 3)) * 40 AS id) SELECT ask.id, a.id IS NOT NULL AND a.deleted_at IS NULL AS alive FROM ask LEFT JOIN articles a USING (id)")
def is_alive(spark, sf):
    ask = spark.range(0, 60, 3).select((F.col("id") * 40).alias("id"))
    found = view(spark, sf, "articles").select("id", "deleted_at", F.lit(True).alias("there"))
    return ask.join(found, "id", "left").select("id", (F.col("there").isNotNull() & F.col("deleted_at").isNull()).alias("alive"))


@query("SELECT article_id, seq, CAST(length(trim(text, ' ' || chr(9) || chr(13) || chr(10) || chr(12) || chr(11))) AS BIGINT) AS chars FROM article_pages WHERE length(trim(text, ' ' || chr(9) || chr(13) || chr(10) || chr(12) || chr(11))) < 120")
def page_issues(spark, sf):
    """Pages with fewer than 120 characters between blanks."""
    chars = F.char_length(F.btrim("text", F.lit(BLANKS))).cast("long")
    return article_pages(spark, sf).select("article_id", "seq", chars.alias("chars")).where("chars < 120")


@query("SELECT id, extract_status, index_status, compile_status FROM articles WHERE user_id = 3 AND deleted_at IS NULL")
def status_projection(spark, sf):
    return alive(view(spark, sf, "articles")).where("user_id = 3").select("id", "extract_status", "index_status", "compile_status")


@query("SELECT event_id, day, tokens FROM usage WHERE day >= '2024-01-05' AND user_id = 7 ORDER BY day DESC, event_id DESC LIMIT 200")
def usage_filter(spark, sf):
    """At most 200 usage rows of a user from a day on, newest first."""
    return view(spark, sf, "usage").where("day >= '2024-01-05' AND user_id = 7").orderBy(F.desc("day"), F.desc("event_id")).limit(200).select("event_id", "day", "tokens")


@query("SELECT id, CASE WHEN 'failed' IN (extract_status, index_status, compile_status) THEN 'failed' WHEN 'processing' IN (extract_status, index_status, compile_status) THEN 'running' WHEN 'pending' IN (extract_status, index_status, compile_status) THEN 'waiting' ELSE 'done' END AS stage FROM articles")
def article_stage(spark, sf):
    phases = F.array("extract_status", "index_status", "compile_status")
    has = lambda s: F.array_contains(phases, s)
    return view(spark, sf, "articles").select("id", F.when(has("failed"), "failed").when(has("processing"), "running").when(has("pending"), "waiting").otherwise("done").alias("stage"))


@query("SELECT id FROM articles WHERE contains(lower(name), 'src1') OR contains(lower(coalesce(storage_key, url, '')), '17')")
def article_search(spark, sf):
    return view(spark, sf, "articles").where(F.contains(F.lower("name"), F.lit("src1")) | F.contains(F.lower(F.coalesce("storage_key", "url", F.lit(""))), F.lit("17"))).select("id")


@query("SELECT article_id, seq, length(text) < 200 OR article_id % 10 = 0 AS needs_ocr FROM article_pages")
def needs_ocr(spark, sf):
    return article_pages(spark, sf).select("article_id", "seq", ((F.char_length("text") < 200) | (F.col("article_id") % 10 == 0)).alias("needs_ocr"))


@query(f"SELECT id, {NOW} > next_retry_at AS expired, CAST(({NOW} - updated_at) // 60 AS BIGINT) AS minutes FROM articles WHERE extract_status = 'processing'")
def lease_expired(spark, sf):
    return view(spark, sf, "articles").where("extract_status = 'processing'").select("id", (F.lit(NOW) > F.col("next_retry_at")).alias("expired"), F.floor((NOW - F.col("updated_at")) / 60).alias("minutes"))


@query(f"SELECT id, deleted_at + 300 AS undo_until, {NOW} < deleted_at + 300 AS can_undo FROM articles WHERE deleted_at IS NOT NULL")
def undo_window(spark, sf):
    until = F.col("deleted_at") + 300
    return view(spark, sf, "articles").where("deleted_at IS NOT NULL").select("id", until.alias("undo_until"), (F.lit(NOW) < until).alias("can_undo"))


@query(f"SELECT coalesce(max(last_seen_at) >= {NOW} - 45, false) AS online FROM heartbeats")
def worker_online(spark, sf):
    return view(spark, sf, "heartbeats").agg(F.coalesce(F.max("last_seen_at") >= NOW - 45, F.lit(False)).alias("online"))


MARKERS = ("the same", "above", "that", "them")


@query("SELECT id, turn > 0 AND (contains(lower(content), 'the same') OR contains(lower(content), 'above') OR contains(lower(content), 'that') OR contains(lower(content), 'them')) AS follow_up FROM messages WHERE role = 'user'")
def follow_up_flag(spark, sf):
    """User messages after the first that refer back."""
    refers = F.exists(F.array(*[F.lit(m) for m in MARKERS]), lambda m: F.contains(F.lower("content"), m))
    return view(spark, sf, "messages").where("role = 'user'").select("id", ((F.col("turn") > 0) & refers).alias("follow_up"))


@query("SELECT id FROM articles WHERE deleted_at >= 99700 ORDER BY deleted_at DESC, id LIMIT 100")
def purge_undoing(spark, sf):
    return view(spark, sf, "articles").where("deleted_at >= 99700").orderBy(F.desc("deleted_at"), "id").limit(100).select("id")


@query("SELECT id FROM articles WHERE deleted_at < 99700 ORDER BY deleted_at, id LIMIT 100")
def purge_candidates(spark, sf):
    return view(spark, sf, "articles").where("deleted_at < 99700").orderBy("deleted_at", "id").limit(100).select("id")


@query("SELECT id FROM articles WHERE index_status = 'failed' AND deleted_at IS NULL ORDER BY created_at DESC, id LIMIT 20 OFFSET 10")
def list_by_status(spark, sf):
    return alive(view(spark, sf, "articles")).where("index_status = 'failed'").orderBy(F.desc("created_at"), "id").offset(10).limit(20).select("id")


@query("SELECT id FROM articles WHERE user_id = 2 AND category_id = 7 AND deleted_at IS NULL")
def ids_by_category(spark, sf):
    return alive(view(spark, sf, "articles")).where("user_id = 2 AND category_id = 7").select("id")


@query(f"SELECT id, CASE WHEN deleted_at IS NULL AND category_id IN (3, 5) THEN {NOW} ELSE deleted_at END AS deleted_at FROM articles")
def delete_by_categories(spark, sf):
    return view(spark, sf, "articles").select("id", F.when(F.col("deleted_at").isNull() & F.col("category_id").isin(3, 5), NOW).otherwise(F.col("deleted_at")).alias("deleted_at"))


@query("SELECT id FROM articles WHERE id % 17 <> 4")
def hard_delete(spark, sf):
    articles = view(spark, sf, "articles").select("id")
    return articles.join(articles.where("id % 17 = 4"), "id", "left_anti")


@query("SELECT id, name FROM categories WHERE user_id = 1 AND deleted_at IS NULL ORDER BY created_at, id")
def category_lookup(spark, sf):
    return alive(view(spark, sf, "categories")).where("user_id = 1").orderBy("created_at", "id").select("id", "name")


@query("SELECT id FROM categories WHERE id IN (1, 3, 5, 8) AND deleted_at IS NULL")
def list_categories(spark, sf):
    return alive(view(spark, sf, "categories")).where(F.col("id").isin(1, 3, 5, 8)).select("id")


@query("SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_name = 'Customer#000000007' OR c_custkey = 11")
def user_lookup(spark, sf):
    return table(spark, sf, "customer").where("c_name = 'Customer#000000007' OR c_custkey = 11").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))


@query("SELECT token_hash FROM tokens WHERE expires_at <= 100000 OR revoked_at < 95000")
def ttl_purge(spark, sf):
    return view(spark, sf, "tokens").where("expires_at <= 100000 OR revoked_at < 95000").select("token_hash")


@query("SELECT s_suppkey AS key FROM supplier WHERE s_suppkey % 3 <= 1 AND s_nationkey < 10")
def cache_purge(spark, sf):
    """Cache entries used at most once and made before the cutoff."""
    return table(spark, sf, "supplier").where("s_suppkey % 3 <= 1 AND s_nationkey < 10").select(F.col("s_suppkey").alias("key"))
