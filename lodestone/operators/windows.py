"""Window functions: numbering, carrying forward, gaps and islands, history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.registry import query
from lodestone.views import NOW, article_pages, chunks, table, view


@query(", n AS (SELECT article_id, seq AS id, CASE WHEN seq % 2 = 1 THEN seq END AS seq FROM article_pages) SELECT n.article_id, n.id, coalesce(n.seq, coalesce(m.top, 0) + row_number() OVER (PARTITION BY n.article_id, n.seq IS NULL ORDER BY n.id)) AS seq FROM n LEFT JOIN (SELECT article_id, max(seq) AS top FROM n GROUP BY 1) m USING (article_id)")
def backfill_seq(spark, sf):
    """Unnumbered pages go after the numbered ones of their article, by id; here every second page has no number."""
    pages = article_pages(spark, sf).select("article_id", F.col("seq").alias("id"), F.when(F.col("seq") % 2 == 1, F.col("seq")).alias("seq"))
    of = Window.partitionBy("article_id")
    place = F.count_if(F.col("seq").isNull()).over(of.orderBy("id"))
    return pages.select("article_id", "id", F.coalesce("seq", F.coalesce(F.max("seq").over(of), F.lit(0)) + place).alias("seq"))


@query("SELECT c_custkey AS id, c_mktsegment AS name, c_nationkey AS email FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_custkey) AS rn FROM customer) WHERE rn = 1")
def dedup_users(spark, sf):
    """The first user of each name and address; an aggregate, as it combines before the shuffle."""
    users = table(spark, sf, "customer")
    return users.groupBy(F.col("c_mktsegment").alias("name"), F.col("c_nationkey").alias("email")).agg(F.min("c_custkey").alias("id"))


def carried(first: Column, last: Column, of: str, order: str) -> Column:
    """A chunk's section: its own first heading, else the last heading before it."""
    before = Window.partitionBy(of).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(first, F.last(last, ignorenulls=True).over(before))


def ranges(missing: DataFrame, key: str, number: str, most: int = 200) -> DataFrame:
    """Runs of consecutive numbers, cut into ranges of at most `most`."""
    rn = F.row_number().over(Window.partitionBy(key).orderBy(number))
    island = missing.withColumn("island", F.col(number) - rn)
    part = F.floor((F.row_number().over(Window.partitionBy(key, "island").orderBy(number)) - 1) / most)
    return island.withColumn("part", part).groupBy(key, "island", "part").agg(F.min(number).alias("first"), F.max(number).alias("last")).drop("island", "part")


@query(", m AS (SELECT article_id, chunk_index AS p FROM chunks WHERE length(text) % 5 <> 0), i AS (SELECT *, p - row_number() OVER (PARTITION BY article_id ORDER BY p) AS g FROM m), q AS (SELECT *, (row_number() OVER (PARTITION BY article_id, g ORDER BY p) - 1) // 4 AS part FROM i) SELECT article_id, min(p) AS first, max(p) AS last FROM q GROUP BY article_id, g, part")
def pending_ranges(spark, sf):
    missing = chunks(spark, sf).where("char_length(text) % 5 <> 0").select("article_id", F.col("chunk_index").alias("p"))
    return ranges(missing, "article_id", "p", 4)


@query("SELECT user_id, day, site, provider, model, event_id, tokens FROM (SELECT *, row_number() OVER (PARTITION BY user_id, day, site, provider, model ORDER BY event_id) AS rn FROM usage) WHERE rn = 1")
def first_wins(spark, sf):
    key = ["user_id", "day", "site", "provider", "model"]
    first = view(spark, sf, "usage").groupBy(*key).agg(F.min_by(F.struct("event_id", "tokens"), "event_id").alias("f"))
    return first.select(*key, "f.event_id", "f.tokens")


@query("SELECT worker_id, last_seen_at FROM heartbeats ORDER BY last_seen_at DESC, worker_id LIMIT 1")
def latest_heartbeat(spark, sf):
    return view(spark, sf, "heartbeats").orderBy(F.desc("last_seen_at"), "worker_id").limit(1)


@query("""SELECT conv_id, article, CASE WHEN n <= 3 THEN n ELSE 0 END AS cite FROM (SELECT conv_id, article, row_number() OVER (PARTITION BY conv_id ORDER BY first) AS n
 FROM (SELECT conv_id, length(text) % 10 AS article, min(turn) AS first FROM conversations GROUP BY ALL))""")
def cite_numbering(spark, sf):
    """Cited articles of each conversation, numbered as first seen; beyond the cap they get 0."""
    cites = table(spark, sf, "conversations").select("conv_id", "turn", (F.char_length("text") % 10).cast("long").alias("article"))
    first = cites.groupBy("conv_id", "article").agg(F.min("turn").alias("first"))
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("first"))
    return first.withColumn("n", n).select("conv_id", "article", F.when(F.col("n") <= 3, F.col("n")).otherwise(0).alias("cite"))


@query("SELECT l_orderkey AS series, coalesce(bool_and(up), true) AS ordered FROM (SELECT l_orderkey, l_partkey > lag(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS up FROM lineitem) GROUP BY 1")
def ordered_labels(spark, sf):
    """Whether each series' labels rise strictly."""
    up = F.col("l_partkey") > F.lag("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
    return table(spark, sf, "lineitem").select("l_orderkey", up.alias("up")).groupBy(F.col("l_orderkey").alias("series")).agg(F.coalesce(F.bool_and("up"), F.lit(True)).alias("ordered"))


@query("""SELECT event_id, CASE WHEN d <= 0 THEN 'today' WHEN d = 1 THEN 'yesterday' WHEN d <= 7 THEN 'week' ELSE 'older' END AS bucket
 FROM (SELECT event_id, date_diff('day', CAST(ts AS DATE), (SELECT CAST(max(ts) AS DATE) - 2 FROM events)) AS d FROM events)""")
def session_buckets(spark, sf):
    """Days before the day before last; later times count as today."""
    events = table(spark, sf, "events")
    now = events.agg(F.date_sub(F.max("ts").cast("date"), 2).alias("now"))
    days = F.datediff("now", F.col("ts").cast("date"))
    joined = events.withColumn("k", F.lit(1)).join(F.broadcast(now.withColumn("k", F.lit(1))), "k")  # one row
    return joined.select("event_id", F.when(days <= 0, "today").when(days == 1, "yesterday").when(days <= 7, "week").otherwise("older").alias("bucket"))


@query("SELECT conversation_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY turn DESC) AS rn FROM messages) WHERE rn <= 2")
def recent_history(spark, sf):
    """The last messages of each conversation; Spark cuts each partition before the shuffle."""
    rn = F.row_number().over(Window.partitionBy("conversation_id").orderBy(F.desc("turn")))
    return view(spark, sf, "messages").withColumn("rn", rn).where("rn <= 2").select("conversation_id", "turn", "role")


@query(f"SELECT id, {NOW} - updated_at AS age, CASE WHEN {NOW} - updated_at < 3600 THEN 'minutes' WHEN {NOW} - updated_at < 86400 THEN 'hours' ELSE 'days' END AS unit FROM articles")
def time_ago(spark, sf):
    age = F.lit(NOW) - F.col("updated_at")
    return view(spark, sf, "articles").select("id", age.alias("age"), F.when(age < 3600, "minutes").when(age < 86400, "hours").otherwise("days").alias("unit"))
