"""Aggregations over articles, job pages, messages, usage and document lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.filters import alive
from lodestone.registry import query
from lodestone.views import NOW, article_pages, table, view


@query("SELECT " + ", ".join(f"count(*) FILTER ({p}_status = '{s}') AS {p}_{s}" for p in ("extract", "index") for s in ("pending", "processing", "done", "failed")) + " FROM articles WHERE deleted_at IS NULL")
def queue_stats(spark, sf):
    """Counts of each status of two phases, in one pass."""
    counts = [F.count_if(F.col(f"{p}_status") == s).alias(f"{p}_{s}") for p in ("extract", "index") for s in ("pending", "processing", "done", "failed")]
    return alive(view(spark, sf, "articles")).agg(*counts)


def progress(pages: DataFrame) -> DataFrame:
    """Per job: pages in all, done, failed, pending and running."""
    is_in = lambda *s: F.count_if(F.col("status").isin(*s))
    return pages.groupBy("job_id").agg(F.count("*").alias("total"), is_in("ocr_done", "edited", "skipped_has_text").alias("done"), is_in("failed").alias("failed"), is_in("pending").alias("pending"), is_in("processing").alias("running"))


_PROGRESS = "SELECT job_id, count(*) AS total, count(*) FILTER (status IN ('ocr_done', 'edited', 'skipped_has_text')) AS done, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'processing') AS running FROM job_pages GROUP BY job_id"


@query(_PROGRESS)
def job_progress(spark, sf):
    return progress(view(spark, sf, "job_pages"))


@query(f"SELECT job_id, CASE WHEN running + pending > 0 THEN 'processing' WHEN total > 0 AND failed = total THEN 'failed' ELSE 'done' END AS status FROM ({_PROGRESS})")
def job_status(spark, sf):
    return progress(view(spark, sf, "job_pages")).select("job_id", F.when(F.col("running") + F.col("pending") > 0, "processing").when((F.col("total") > 0) & (F.col("failed") == F.col("total")), "failed").otherwise("done").alias("status"))


@query(", ask AS (SELECT unnest(range(0, 100)) * 7 AS id) SELECT ask.id AS conversation_id, count(m.id) AS n FROM ask LEFT JOIN messages m ON m.conversation_id = ask.id GROUP BY 1")
def message_counts(spark, sf):
    """Messages of each conversation asked for; 0 where there are none."""
    ask = spark.range(100).select((F.col("id") * 7).alias("conversation_id"))
    found = view(spark, sf, "messages").join(ask, "conversation_id", "left_semi").groupBy("conversation_id").agg(F.count("*").alias("n"))
    return ask.join(found, "conversation_id", "left").select("conversation_id", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT count(*) AS entries, CAST(coalesce(sum(4 * len(embedding)), 0) AS BIGINT) AS bytes FROM points")
def cache_stats(spark, sf):
    return view(spark, sf, "points").agg(F.count("*").alias("entries"), F.coalesce(F.sum(4 * F.size("embedding")), F.lit(0)).alias("bytes"))


@query("SELECT a.id, coalesce(max(seq), -1) AS last_seq FROM articles a LEFT JOIN article_pages p ON p.article_id = a.id AND a.id % 4 <> 1 GROUP BY 1")
def page_progress(spark, sf):
    """Last page of each article, or -1; every fourth article has none yet."""
    last = article_pages(spark, sf).where("article_id % 4 <> 1").groupBy(F.col("article_id").alias("id")).agg(F.max("seq").alias("last_seq"))
    return view(spark, sf, "articles").select("id").join(last, "id", "left").select("id", F.coalesce("last_seq", F.lit(-1)).alias("last_seq"))


@query("SELECT count(*) AS n, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(tokens) AS BIGINT) AS tokens FROM (SELECT * FROM usage WHERE user_id = 3 ORDER BY day DESC, event_id DESC LIMIT 50)")
def usage_totals(spark, sf):
    """Sums of the page that is shown, not of all rows."""
    page = view(spark, sf, "usage").where("user_id = 3").orderBy(F.desc("day"), F.desc("event_id")).limit(50)
    return page.agg(F.count("*").alias("n"), F.sum("calls").cast("long").alias("calls"), F.sum("tokens").cast("long").alias("tokens"))


@query("SELECT user_id, site, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(tokens) AS BIGINT) AS tokens FROM usage GROUP BY ALL HAVING sum(tokens) > 0")
def usage_by_site(spark, sf):
    return view(spark, sf, "usage").groupBy("user_id", "site").agg(F.sum("calls").cast("long").alias("calls"), F.sum("tokens").cast("long").alias("tokens")).where("tokens > 0")


@query(f"SELECT count(*) AS documents, count(DISTINCT category_id) AS folders, count(DISTINCT nullif(doc_type, '')) AS types, count(*) FILTER (updated_at >= {NOW} - 604800 / 7) AS recent FROM articles WHERE deleted_at IS NULL")
def overview_stats(spark, sf):
    return alive(view(spark, sf, "articles")).agg(F.count("*").alias("documents"), F.countDistinct("category_id").alias("folders"), F.countDistinct(F.nullif("doc_type", F.lit(""))).alias("types"), F.count_if(F.col("updated_at") >= NOW - 604800 / 7).alias("recent"))


@query("SELECT l_orderkey AS page, count(*) AS words, round(avg(l_quantity * 2), 6) AS mean_conf, count(*) FILTER (l_quantity < 15) AS low FROM lineitem GROUP BY 1")
def word_stats(spark, sf):
    """Words of each page, their mean confidence and how many are under 30; line items stand for words."""
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("page")).agg(F.count("*").alias("words"), F.round(F.avg(F.col("l_quantity") * 2), 6).alias("mean_conf"), F.count_if(F.expr("l_quantity < 15")).alias("low"))


@query("SELECT l_orderkey AS line, min(l_partkey) AS x0, min(l_suppkey) AS y0, max(l_partkey + l_quantity) AS x1, max(l_suppkey + 10) AS y1, round(avg(l_quantity), 6) AS conf, string_agg(l_shipmode, ' ' ORDER BY l_linenumber, l_shipmode) AS text FROM (SELECT *, l_returnflag || l_linestatus AS l_shipmode FROM lineitem) GROUP BY 1")
def line_union(spark, sf):
    """Box around the words of each line, their mean confidence, and the words in order."""
    words = table(spark, sf, "lineitem").withColumn("w", F.concat("l_returnflag", "l_linestatus"))
    ordered = F.array_sort(F.collect_list(F.struct("l_linenumber", "w")))
    return words.groupBy(F.col("l_orderkey").alias("line")).agg(F.min("l_partkey").alias("x0"), F.min("l_suppkey").alias("y0"), F.max(F.col("l_partkey") + F.col("l_quantity")).alias("x1"), F.max(F.col("l_suppkey") + 10).alias("y1"), F.round(F.avg("l_quantity"), 6).alias("conf"), F.array_join(F.transform(ordered, lambda x: x["w"]), " ").alias("text"))


def repeat_key(line: Column) -> Column:
    """What makes two edge lines the same: case, numbers and blanks don't count; long ones and those without letters have none."""
    trimmed = F.btrim(line)
    key = F.regexp_replace(F.regexp_replace(F.lower(trimmed), "[0-9]+", "#"), "[ \t]", "")
    return F.when((F.char_length(trimmed) > 80) | ~F.regexp_like(key, F.lit("[a-zà-ỹ]")), "").otherwise(key)


def lines_of(text: str = "text") -> Column:
    return F.filter(F.split(text, "\n"), lambda x: F.btrim(x) != "")


def at_edge(i: Column, n: Column, edge: int = 3) -> Column:
    return (i < edge) | (i >= n - edge)


_PAGES8 = ", pg AS (SELECT article_id // 8 AS article_id, article_id * 1000 + seq AS seq, text FROM article_pages), ls AS (SELECT article_id, seq, generate_subscripts(l, 1) - 1 AS p, len(l) AS n, unnest(l) AS line FROM (SELECT article_id, seq, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM pg)), ks AS (SELECT *, CASE WHEN length(trim(line)) > 80 OR NOT regexp_matches(regexp_replace(regexp_replace(lower(trim(line)), '[0-9]+', '#', 'g'), '[ \t]', '', 'g'), '[a-zà-ỹ]') THEN '' ELSE regexp_replace(regexp_replace(lower(trim(line)), '[0-9]+', '#', 'g'), '[ \t]', '', 'g') END AS key FROM ls WHERE p < 3 OR p >= n - 3), big AS (SELECT article_id FROM pg GROUP BY 1 HAVING count(*) >= 5), rep AS (SELECT article_id, key, count(*) AS c FROM ks JOIN big USING (article_id) WHERE key <> '' GROUP BY ALL HAVING count(*) >= 3)"


def eight_to_one(pages: DataFrame) -> DataFrame:
    """Pages of eight documents as those of one article, so that articles have many pages."""
    return pages.select(F.expr("article_id div 8").alias("article_id"), (F.col("article_id") * 1000 + F.col("seq")).alias("seq"), "text")


def repeated(pages: DataFrame, least: int = 3, least_pages: int = 5) -> DataFrame:
    """Keys of edge lines that repeat in articles of enough pages. One aggregation counts both: each page has the key '' once."""
    edges = F.filter(F.col("lines"), lambda x, i: at_edge(i, F.size("lines")))
    keys = F.concat(F.array(F.lit("")), F.filter(F.transform(edges, lambda x: repeat_key(x)), lambda k: k != ""))
    counts = pages.withColumn("lines", lines_of()).select("article_id", F.explode(keys).alias("key")).groupBy("article_id", "key").agg(F.count("*").alias("c"))
    enough = counts.where((F.col("key") == "") & (F.col("c") >= least_pages)).select("article_id")
    return counts.where((F.col("key") != "") & (F.col("c") >= least)).join(enough, "article_id", "left_semi")


@query(_PAGES8 + " SELECT article_id, key, c FROM rep")
def repeat_lines(spark, sf):
    return repeated(eight_to_one(article_pages(spark, sf)))


@query(_PAGES8 + """, drops AS (SELECT article_id, seq, p FROM ks JOIN rep USING (article_id, key)), hit AS (SELECT DISTINCT article_id, seq FROM drops)
SELECT article_id, seq, CASE WHEN h THEN coalesce(joined, '') ELSE text END AS text FROM (
 SELECT pg.article_id, pg.seq, pg.text, hit.seq IS NOT NULL AS h, (SELECT string_agg(line, chr(10) ORDER BY p) FROM ls WHERE ls.article_id = pg.article_id AND ls.seq = pg.seq AND NOT EXISTS (SELECT 1 FROM drops d WHERE d.article_id = ls.article_id AND d.seq = ls.seq AND d.p = ls.p)) AS joined
 FROM pg LEFT JOIN hit ON hit.article_id = pg.article_id AND hit.seq = pg.seq)""")
def strip_repeats(spark, sf):
    """Pages without repeated edge lines; those with none stay as they are, blank lines included."""
    pages = eight_to_one(article_pages(spark, sf))
    gone = repeated(pages).groupBy("article_id").agg(F.collect_set("key").alias("gone"))
    rows = pages.join(gone, "article_id", "left").withColumn("lines", lines_of())
    left = F.filter("lines", lambda x, i: ~(at_edge(i, F.size("lines")) & F.array_contains("gone", repeat_key(x))))
    rows = rows.withColumn("left", F.when(F.col("gone").isNotNull(), left))
    return rows.select("article_id", "seq", F.when(F.size("left") < F.size("lines"), F.array_join("left", "\n")).otherwise(F.col("text")).alias("text"))


@query(""", ls AS (SELECT doc_id, list_filter(regexp_split_to_array(l, '[ ]+'), lambda x: x <> '') AS t FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents)),
sc AS (SELECT doc_id, (len(list_filter(t, lambda x: length(x) = 1)) + 0.5 * len(list_filter(t, lambda x: length(x) = 2))) / len(t) AS s FROM ls WHERE len(t) >= 4)
SELECT d.doc_id, coalesce(count(*) FILTER (s >= 0.3) >= 4 AND count(*) FILTER (s >= 0.3) > 0.15 * count(s), false) AS spaced FROM documents d LEFT JOIN sc USING (doc_id) GROUP BY 1""")
def doc_spaced(spark, sf):
    """Whether a document's letters stand apart: enough of its longer lines are short tokens mostly."""
    lines = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("l"))
    tokens = lines.select("doc_id", F.filter(F.split("l", "[ ]+"), lambda x: x != "").alias("t")).where("size(t) >= 4")
    of = lambda n: F.size(F.filter("t", lambda x: F.char_length(x) == n))
    score = (of(1) + 0.5 * of(2)) / F.size("t")
    counted = tokens.select("doc_id", score.alias("s")).groupBy("doc_id").agg(F.count_if(F.expr("s >= 0.3")).alias("k"), F.count("*").alias("n"))
    return table(spark, sf, "documents").select("doc_id").join(counted, "doc_id", "left").select("doc_id", F.coalesce((F.col("k") >= 4) & (F.col("k") > 0.15 * F.col("n")), F.lit(False)).alias("spaced"))


GAP = r"^[ \t]*[^ \t].*(\t|  )"
NUMERIC = r"^[(\[]*[0-9][0-9.,/-]*%?[)\].,;:]*$"
RULE = r"^[-_=|+ \t]*$"


def layout_signals_of(pages: DataFrame, *keys: str) -> DataFrame:
    """Lines, and those that look like table rows: column gaps, three or more numbers, rules; and a score of them."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(" \t\r")) != "")
    numbers = lambda x: F.size(F.filter(F.split(x, "[ \t]+"), lambda t: F.regexp_like(t, F.lit(NUMERIC))))
    ruled = lambda x: F.regexp_like(x, F.lit(RULE)) & (F.char_length(F.regexp_replace(x, "[ \t]", "")) >= 3)
    counted = pages.select(*keys, lines.alias("l")).select(*keys, F.size("l").alias("lines"), F.size(F.filter("l", lambda x: F.regexp_like(x, F.lit(GAP)))).alias("gap_rows"), F.size(F.filter("l", lambda x: numbers(x) >= 3)).alias("numeric_rows"), F.size(F.filter("l", ruled)).alias("rule_rows"))
    part = lambda c, most, w: F.least(F.col(c) / most, F.lit(1.0)) * w
    score = F.when(F.col("lines") < 5, 0.0).otherwise(F.round(part("gap_rows", 3, 0.4) + part("numeric_rows", 3, 0.4) + part("rule_rows", 2, 0.2), 6))
    return counted.withColumn("score", score)


@query(rf""", l AS (SELECT article_id, seq, list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13)) <> '') AS l FROM article_pages),
c AS (SELECT article_id, seq, len(l) AS lines, len(list_filter(l, lambda x: regexp_matches(x, '{GAP}'))) AS gap_rows,
 len(list_filter(l, lambda x: len(list_filter(regexp_split_to_array(x, '[ \t]+'), lambda t: regexp_matches(t, '{NUMERIC}'))) >= 3)) AS numeric_rows,
 len(list_filter(l, lambda x: regexp_matches(x, '{RULE}') AND length(regexp_replace(x, '[ \t]', '', 'g')) >= 3)) AS rule_rows FROM l)
SELECT *, CASE WHEN lines < 5 THEN 0.0 ELSE round(least(gap_rows / 3, 1.0) * 0.4 + least(numeric_rows / 3, 1.0) * 0.4 + least(rule_rows / 2, 1.0) * 0.2, 6) END AS score FROM c""")
def layout_signals(spark, sf):
    return layout_signals_of(article_pages(spark, sf), "article_id", "seq")


@query("SELECT category_id, count(*) AS points, count(DISTINCT article_id) AS articles FROM points GROUP BY ROLLUP (category_id)")
def collection_count(spark, sf):
    """Points and articles of each category, and of all."""
    return view(spark, sf, "points").rollup("category_id").agg(F.count("*").alias("points"), F.countDistinct("article_id").alias("articles"))


@query("SELECT d.lang AS provider, count(*) AS n, count(*) FILTER (quality = 1 AND toxic = 0) AS passed, count(*) FILTER (quality = 0 AND toxic = 0) AS fail0, count(*) FILTER (toxic = 1) AS fail1, count(*) FILTER (quality IS NULL) AS errors, round(avg(n_chars), 6) AS avg_secs FROM documents d LEFT JOIN labels USING (doc_id) GROUP BY 1")
def eval_summary(spark, sf):
    """Verdicts of each provider; languages stand for providers, labels for verdicts."""
    both = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return both.groupBy(F.col("lang").alias("provider")).agg(F.count("*").alias("n"), F.count_if(F.expr("quality = 1 AND toxic = 0")).alias("passed"), F.count_if(F.expr("quality = 0 AND toxic = 0")).alias("fail0"), F.count_if(F.expr("toxic = 1")).alias("fail1"), F.count_if(F.expr("quality IS NULL")).alias("errors"), F.round(F.avg("n_chars"), 6).alias("avg_secs"))


@query("SELECT event_type AS step, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, max(value) AS most, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def latency_summary(spark, sf):
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("step")).agg(F.count("*").alias("n"), F.round(F.percentile("value", F.lit(0.5)), 6).alias("p50"), F.round(F.percentile("value", F.lit(0.95)), 6).alias("p95"), F.max("value").alias("most"), F.round(F.avg("value"), 6).alias("mean"))


@query("SELECT user_id, count(DISTINCT storage_key) AS objects FROM articles WHERE storage_key <> '' GROUP BY 1")
def upload_dedup_objects(spark, sf):
    return view(spark, sf, "articles").where("storage_key <> ''").groupBy("user_id").agg(F.countDistinct("storage_key").alias("objects"))


@query("SELECT id, total, page FROM (SELECT id, count(*) OVER () AS total, row_number() OVER (ORDER BY id DESC) AS page FROM jobs WHERE user_id = 1 AND status = 'pending' AND deleted_at IS NULL) WHERE page <= 20")
def scan_job_list(spark, sf):
    """The newest jobs of an owner with the count of all; the count is an aggregate of its own."""
    mine = alive(view(spark, sf, "jobs")).where("user_id = 1 AND status = 'pending'").select("id")
    total = mine.agg(F.count("*").alias("total"), F.lit(1).alias("k"))
    top = mine.orderBy(F.desc("id")).limit(20)
    return top.withColumn("k", F.lit(1)).join(F.broadcast(total), "k").select("id", "total", F.row_number().over(Window.partitionBy("total").orderBy(F.desc("id"))).alias("page"))


@query("SELECT job_id, count(*) AS total, count(*) FILTER (status <> 'skipped_has_text') AS target, count(*) FILTER (status = 'skipped_has_text') AS skipped FROM job_pages GROUP BY 1")
def scan_plan(spark, sf):
    return view(spark, sf, "job_pages").groupBy("job_id").agg(F.count("*").alias("total"), F.count_if(F.expr("status <> 'skipped_has_text'")).alias("target"), F.count_if(F.expr("status = 'skipped_has_text'")).alias("skipped"))


@query("SELECT user_id, least(count(DISTINCT category_id), 5) AS providers FROM articles WHERE deleted_at IS NULL GROUP BY 1")
def provider_count(spark, sf):
    return alive(view(spark, sf, "articles")).groupBy("user_id").agg(F.least(F.countDistinct("category_id"), F.lit(5)).alias("providers"))


@query("SELECT count(*) AS total FROM (SELECT id FROM articles WHERE user_id = 2 AND deleted_at IS NULL ORDER BY created_at DESC, id LIMIT 20)")
def article_response(spark, sf):
    """The total is that of the page shown."""
    return alive(view(spark, sf, "articles")).where("user_id = 2").orderBy(F.desc("created_at"), "id").limit(20).agg(F.count("*").alias("total"))
