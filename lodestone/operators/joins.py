"""Joins between articles, categories, pages, points, jobs and users, and the consistency checks built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.filters import alive
from lodestone.registry import query
from lodestone.views import article_pages, chunks, table, view


@query("SELECT a.id FROM articles a JOIN categories c ON a.category_id = c.id WHERE c.name = 'NATION_3' AND a.user_id = 3 AND c.user_id = 3 AND a.deleted_at IS NULL ORDER BY a.created_at DESC, a.id LIMIT 20")
def articles_by_category_name(spark, sf):
    """Soft-deleted categories still match."""
    named = view(spark, sf, "categories").where("name = 'NATION_3' AND user_id = 3").select(F.col("id").alias("category_id"))
    return alive(view(spark, sf, "articles")).where("user_id = 3").join(named, "category_id").orderBy(F.desc("created_at"), "id").limit(20).select("id")


@query("SELECT u.event_id, u.tokens, c.c_name AS user_name FROM usage u LEFT JOIN customer c ON c.c_custkey = u.user_id AND c.c_custkey % 4 <> 0")
def usage_with_user(spark, sf):
    users = table(spark, sf, "customer").where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("user_name"))
    return view(spark, sf, "usage").join(users, "user_id", "left").select("event_id", "tokens", "user_name")


@query("SELECT p.job_id, p.page_num FROM job_pages p JOIN jobs j ON j.id = p.job_id AND j.deleted_at IS NULL WHERE p.status = 'pending' AND j.status IN ('pending', 'processing')")
def claimable_pages(spark, sf):
    jobs = alive(view(spark, sf, "jobs")).where("status IN ('pending', 'processing')").select(F.col("id").alias("job_id"))
    return view(spark, sf, "job_pages").where("status = 'pending'").join(jobs, "job_id").select("job_id", "page_num")


@query("SELECT p.job_id, p.page_num, j.user_id FROM job_pages p JOIN jobs j ON j.id = p.job_id AND j.deleted_at IS NULL WHERE p.attempts > 8")
def attach_jobs(spark, sf):
    """Rows without a job are dropped."""
    jobs = alive(view(spark, sf, "jobs")).select(F.col("id").alias("job_id"), "user_id")
    return view(spark, sf, "job_pages").where("attempts > 8").join(jobs, "job_id").select("job_id", "page_num", "user_id")


def neighbours(all_chunks: DataFrame, hits: DataFrame, span: int = 1) -> DataFrame:
    """Chunks of the hits' articles within span, that are no hits: an equi-join on article and offset."""
    shifted = hits.select("article_id", F.explode(F.sequence(F.col("chunk_index") - span, F.col("chunk_index") + span)).alias("chunk_index")).distinct()
    return all_chunks.join(shifted, ["article_id", "chunk_index"], "left_semi").join(hits, ["article_id", "chunk_index"], "left_anti")


@query(", hits AS (SELECT article_id, chunk_index FROM chunks WHERE length(text) > 500) SELECT DISTINCT c.article_id, c.chunk_index FROM chunks c JOIN hits h ON c.article_id = h.article_id AND abs(c.chunk_index - h.chunk_index) <= 1 WHERE NOT EXISTS (SELECT 1 FROM hits x WHERE x.article_id = c.article_id AND x.chunk_index = c.chunk_index)")
def hit_neighbors(spark, sf):
    rows = chunks(spark, sf)
    return neighbours(rows.select("article_id", "chunk_index"), rows.where(F.char_length("text") > 500).select("article_id", "chunk_index"))


@query(", ranked AS (SELECT point_id, article_id FROM points WHERE user_id = 1 ORDER BY point_id LIMIT 40) SELECT point_id FROM ranked r WHERE EXISTS (SELECT 1 FROM articles a WHERE a.id = r.article_id AND a.deleted_at IS NULL AND a.index_status = 'done')")
def drop_unfinished(spark, sf):
    """After the cut, so fewer may be left."""
    hits = view(spark, sf, "points").where("user_id = 1").orderBy("point_id").limit(40)
    done = alive(view(spark, sf, "articles")).where("index_status = 'done'").select(F.col("id").alias("article_id"))
    return hits.join(done, "article_id", "left_semi").select("point_id")


@query(", ask AS (SELECT unnest(range(0, 40)) AS id) SELECT id FROM ask WHERE id NOT IN (SELECT id FROM articles WHERE user_id = 2)")
def foreign_ids(spark, sf):
    return spark.range(40).join(view(spark, sf, "articles").where("user_id = 2").select("id"), "id", "left_anti")


@query("SELECT id FROM articles WHERE deleted_at IS NULL AND category_id NOT IN (SELECT id FROM categories)")
def orphan_articles(spark, sf):
    """Soft-deleted categories count as there."""
    cats = view(spark, sf, "categories").select(F.col("id").alias("category_id"))
    return alive(view(spark, sf, "articles")).join(cats, "category_id", "left_anti").select("id")


@query("SELECT article_id, seq FROM article_pages WHERE article_id NOT IN (SELECT id FROM articles WHERE id % 8 <> 3)")
def orphan_pages(spark, sf):
    """Pages without any article row, once every eighth article is taken out."""
    there = view(spark, sf, "articles").where("id % 8 <> 3").select(F.col("id").alias("article_id"))
    return article_pages(spark, sf).join(there, "article_id", "left_anti").select("article_id", "seq")


@query("SELECT article_id, seq FROM article_pages WHERE article_id NOT IN (SELECT id FROM articles WHERE deleted_at IS NULL)")
def delete_orphan_pages(spark, sf):
    """Here pages of soft-deleted articles are orphans too."""
    there = alive(view(spark, sf, "articles")).select(F.col("id").alias("article_id"))
    return article_pages(spark, sf).join(there, "article_id", "left_anti").select("article_id", "seq")


@query("SELECT id FROM jobs j WHERE deleted_at IS NULL AND status IN ('pending', 'processing') AND NOT EXISTS (SELECT 1 FROM job_pages p WHERE p.job_id = j.id AND p.status IN ('pending', 'processing'))")
def ready_to_build(spark, sf):
    busy = view(spark, sf, "job_pages").where("status IN ('pending', 'processing')").select(F.col("job_id").alias("id"))
    return alive(view(spark, sf, "jobs")).where("status IN ('pending', 'processing')").join(busy, "id", "left_anti").select("id")


@query(", g AS (SELECT index_done_chunks FROM articles a WHERE index_status = 'done' AND index_done_chunks > 0 AND NOT EXISTS (SELECT 1 FROM points p WHERE p.article_id = a.id)) SELECT count(*) AS ghosts, CAST(coalesce(sum(index_done_chunks), 0) AS BIGINT) AS claimed FROM g")
def ghost_articles(spark, sf):
    """Articles that claim chunks of which the index has none."""
    points = view(spark, sf, "points").select(F.col("article_id").alias("id"))
    ghosts = view(spark, sf, "articles").where("index_status = 'done' AND index_done_chunks > 0").join(points, "id", "left_anti")
    return ghosts.agg(F.count("*").alias("ghosts"), F.coalesce(F.sum("index_done_chunks"), F.lit(0)).alias("claimed"))


@query("SELECT a.id, coalesce(o.s, a.index_status) AS index_status FROM articles a LEFT JOIN (SELECT doc_id AS id, CASE quality WHEN 1 THEN 'done' ELSE 'failed' END AS s FROM labels) o USING (id)")
def merge_statuses(spark, sf):
    newer = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "done").otherwise("failed").alias("s"))
    return view(spark, sf, "articles").join(newer, "id", "left").select("id", F.coalesce("s", "index_status").alias("index_status"))


_CACHED = "SELECT a.doc_id, coalesce(a.doc_id > b.doc_id, false) AS hit FROM documents a LEFT JOIN (SELECT md5(text) AS h, min(doc_id) AS doc_id FROM documents GROUP BY 1) b ON md5(a.text) = b.h"


@query(_CACHED)
def cache_lookup(spark, sf):
    """Every document, and whether one of a smaller id has cached its text."""
    docs = table(spark, sf, "documents").select("doc_id", F.md5(F.encode("text", "UTF-8")).alias("h"))
    cached = docs.groupBy("h").agg(F.min("doc_id").alias("first"))
    return docs.join(cached, "h", "left").select("doc_id", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).alias("hit"))


@query(", a AS (SELECT DISTINCT lower(trim(p_brand)) AS slug, 'config' AS u FROM part WHERE p_size < 25), b AS (SELECT DISTINCT lower(trim(p_brand)) AS slug, CASE WHEN length(p_brand) % 2 = 0 THEN ' ' ELSE 'db' END AS u FROM part WHERE p_size >= 20) SELECT coalesce(a.slug, b.slug) AS slug, coalesce(nullif(trim(b.u), ''), a.u) AS url FROM a FULL OUTER JOIN b USING (slug)")
def provider_overlay(spark, sf):
    """Settings of both places by normalised name; non-blank values of the second win."""
    part = table(spark, sf, "part")
    slug = F.lower(F.trim("p_brand")).alias("slug")
    a = part.where("p_size < 25").select(slug, F.lit("config").alias("au")).distinct()
    b = part.where("p_size >= 20").select(slug, F.when(F.length("p_brand") % 2 == 0, " ").otherwise("db").alias("bu")).distinct()
    return a.join(b, "slug", "full").select("slug", F.coalesce(F.nullif(F.trim("bu"), F.lit("")), "au").alias("url"))


@query("""SELECT *, orphan_articles + orphan_pages + cycles + lost_points + without_vectors + unsound_vectors = 0 AS healthy FROM (SELECT (SELECT count(*) FROM articles WHERE deleted_at IS NULL AND category_id NOT IN (SELECT id FROM categories)) AS orphan_articles,
 (SELECT count(*) FROM article_pages WHERE article_id NOT IN (SELECT id FROM articles)) AS orphan_pages,
 (SELECT count(*) FROM closure WHERE ancestor_id = descendant_id AND depth > 0) AS cycles,
 (SELECT count(*) FROM points WHERE article_id NOT IN (SELECT id FROM articles WHERE deleted_at IS NULL)) AS lost_points,
 (SELECT count(*) FROM (SELECT id FROM articles WHERE index_status = 'done' AND index_done_chunks > 0 AND deleted_at IS NULL AND id NOT IN (SELECT article_id FROM points))) AS without_vectors,
 (SELECT count(*) FROM points WHERE len(embedding) <> 64 OR list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) = 0) AS unsound_vectors)""")
def consistency_report(spark, sf):
    """What does not fit together, counted, and whether nothing is."""
    from lodestone.operators.closure import closure

    ids = view(spark, sf, "articles").select(F.col("id").alias("article_id"))
    live = alive(view(spark, sf, "articles")).select(F.col("id").alias("article_id"))
    parts = {
        "orphan_articles": orphan_articles(spark, sf),
        "orphan_pages": article_pages(spark, sf).join(ids, "article_id", "left_anti"),
        "cycles": closure(spark, sf).where("ancestor_id = descendant_id AND depth > 0"),
        "lost_points": view(spark, sf, "points").join(live, "article_id", "left_anti"),
        "without_vectors": alive(view(spark, sf, "articles")).where("index_status = 'done' AND index_done_chunks > 0").select(F.col("id").alias("article_id")).join(view(spark, sf, "points"), "article_id", "left_anti"),
        "unsound_vectors": view(spark, sf, "points").where((F.size("embedding") != 64) | F.forall("embedding", lambda x: x == 0)),
    }
    named = None
    for name, df in parts.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
        named = row if named is None else named.union(row)
    counts = named.groupBy().agg(*[F.max(F.when(F.col("what") == n, F.col("n"))).alias(n) for n in parts])
    return counts.withColumn("healthy", sum((F.col(n) for n in parts), F.lit(0)) == 0)


@query("SELECT id FROM articles WHERE user_id = 2 AND category_id = 7 AND deleted_at IS NULL AND NOT EXISTS (SELECT 1 FROM articles x WHERE x.id IN (7, 37) AND x.user_id <> 2)")
def resolve_scope(spark, sf):
    """The category's articles, unless one of the named ids is another owner's."""
    rows = view(spark, sf, "articles")
    foreign = rows.where("id IN (7, 37) AND user_id <> 2").agg(F.count("*").alias("foreign"), F.lit(1).alias("k"))
    return alive(rows).where("user_id = 2 AND category_id = 7").withColumn("k", F.lit(1)).join(F.broadcast(foreign), "k").where("foreign = 0").select("id")
