"""Questions an assistant asks of a collection, with the checks of their parameters: compositions of the other operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators import retrieval, tables, topk, windows
from lodestone.operators.filters import BLANKS, alive
from lodestone.operators.joins import neighbours
from lodestone.registry import query
from lodestone.views import article_pages, chunks, view


def clamp(value: int, low: int, high: int, default: int | None = None) -> int:
    """value within [low, high]; 0 or less becomes the default, if there is one."""
    return default if default is not None and value <= 0 else max(low, min(value, high))


def scoped(wanted: tuple[int, ...], scope: tuple[int, ...]) -> tuple[int, ...]:
    """A caller's scope overrides the categories that were asked for."""
    return scope or wanted


CITES = 3  # articles that get a number


@query(f""", f AS ({retrieval.HYBRID_SQL}), h AS (SELECT f.article_id, p.chunk_index, max(f.score) AS score FROM f JOIN points p USING (point_id) GROUP BY ALL),
 n AS (SELECT article_id, row_number() OVER (ORDER BY max(score) DESC, article_id) AS n FROM h GROUP BY 1),
 b AS (SELECT article_id, chunk_index, true AS hit FROM h UNION ALL SELECT DISTINCT c.article_id, c.chunk_index, false FROM chunks c JOIN h ON c.article_id = h.article_id AND abs(c.chunk_index - h.chunk_index) = 1
  WHERE NOT EXISTS (SELECT 1 FROM h x WHERE x.article_id = c.article_id AND x.chunk_index = c.chunk_index))
 SELECT article_id, chunk_index, hit, CASE WHEN n <= {CITES} THEN n ELSE 0 END AS cite FROM b JOIN n USING (article_id)""")
def knowledge_search(spark, sf):
    """The chunks of the fused hits, those beside them, and the number each article is cited by: best first, 0 beyond the cap."""
    points = view(spark, sf, "points").select("point_id", "chunk_index")
    fused = retrieval.hybrid_search(spark, sf)  # 20 rows at most
    hits = points.join(F.broadcast(fused.select("point_id", "article_id", "score")), "point_id").groupBy("article_id", "chunk_index").agg(F.max("score").alias("score"))
    best = hits.groupBy("article_id").agg(F.max("score").alias("best"))
    cites = retrieval.ranked(best, F.desc("best"), "article_id").select("article_id", F.when(F.col("rank") <= CITES, F.col("rank")).otherwise(0).alias("cite"))
    found = hits.select("article_id", "chunk_index")
    beside = neighbours(chunks(spark, sf).select("article_id", "chunk_index"), found)
    return found.withColumn("hit", F.lit(True)).union(beside.withColumn("hit", F.lit(False))).join(F.broadcast(cites), "article_id")


def context(rows: DataFrame, article: int, chunk: int, window: int) -> DataFrame:
    """Chunks around one; windows run from 1 to 3."""
    w = clamp(window, 1, 3)
    return rows.where((F.col("article_id") == article) & F.col("chunk_index").between(max(0, chunk - w), chunk + w))


@query("SELECT article_id, chunk_index, text FROM chunks WHERE article_id = 12 AND chunk_index BETWEEN 0 AND 4")
def read_context(spark, sf):
    return context(chunks(spark, sf), 12, 1, 9).select("article_id", "chunk_index", "text")


@query("SELECT id, name, n FROM (SELECT a.id, a.name, a.created_at, a.category_id, (SELECT count(*) FROM points p WHERE p.article_id = a.id) AS n, row_number() OVER (PARTITION BY a.category_id ORDER BY a.created_at DESC, a.id) AS k FROM articles a WHERE a.category_id IN (1, 4) AND a.deleted_at IS NULL) WHERE k <= 50")
def article_info(spark, sf):
    """Articles of the categories in scope with their points, at most 50 of each; without any category there are none."""
    wanted = scoped((2, 3), (1, 4))
    rank = F.row_number().over(Window.partitionBy("category_id").orderBy(F.desc("created_at"), "id"))
    mine = alive(view(spark, sf, "articles")).where(F.col("category_id").isin(*wanted)).withColumn("k", rank).where("k <= 50")
    counts = view(spark, sf, "points").groupBy(F.col("article_id").alias("id")).agg(F.count("*").alias("n"))
    return mine.join(counts, "id", "left").select("id", "name", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT chunk_index, text FROM chunks WHERE article_id = 21 AND chunk_index BETWEEN 2 AND 21")
def read_article(spark, sf):
    """Twenty chunks at most, from one on; a larger limit is cut before anything is compared with it."""
    return chunks(spark, sf).where((F.col("article_id") == 21) & F.col("chunk_index").between(*topk.clamped(2, 500))).select("chunk_index", "text")


@query("SELECT article_id, seq FROM article_pages WHERE length(trim(text, ' ' || chr(9) || chr(13) || chr(10) || chr(12) || chr(11))) < 1000 AND article_id IN (SELECT id FROM articles WHERE user_id = 3) ORDER BY article_id, seq LIMIT 50")
def list_unreadable_pages(spark, sf):
    """Short pages of an owner, the first 50; the least length runs from 1 to 1,000 and is 40 by default."""
    least = clamp(99_999, 1, 1000, 40)
    mine = view(spark, sf, "articles").where("user_id = 3").select(F.col("id").alias("article_id"))
    short = article_pages(spark, sf).where(F.char_length(F.btrim("text", F.lit(BLANKS))) < least)
    return short.join(mine, "article_id", "left_semi").orderBy("article_id", "seq").limit(50).select("article_id", "seq")


@query(tables._ROWS + " SELECT article_id, sheet, count(*) FILTER (r > 0) AS n_rows FROM rws WHERE article_id IN (1, 3) GROUP BY ALL")
def list_sheets(spark, sf):
    return tables.sheet_rows(tables.sheets(spark, sf)).where("article_id IN (1, 3)").groupBy("article_id", "sheet").agg(F.count_if(F.col("r") > 0).alias("n_rows"))


@query(tables._ROWS + ", b AS (SELECT max(r) AS top FROM rws WHERE article_id = 1 AND sheet = 1) SELECT r, line, CASE WHEN top > 2 THEN 3 ELSE 0 END AS next_from FROM rws, b WHERE article_id = 1 AND sheet = 1 AND (r = 0 OR r BETWEEN 1 AND 2)")
def read_sheet(spark, sf):
    """The header and two rows of a sheet, and where to go on; 0 at the end."""
    rows = tables.sheet_rows(tables.sheets(spark, sf)).where("article_id = 1 AND sheet = 1")
    top = F.max("r").over(Window.partitionBy("article_id", "sheet"))
    limit = clamp(2, 1, 300, 60)
    return rows.withColumn("top", top).where((F.col("r") == 0) | F.col("r").between(1, limit)).select("r", "line", F.when(F.col("top") > limit, limit + 1).otherwise(0).alias("next_from"))


@query(tables._SERIES + " SELECT d.article_id, d.sheet, d.kind, d.note, count(value) AS n_points FROM drawn d LEFT JOIN pts USING (article_id, sheet) WHERE d.article_id = 4 GROUP BY ALL")
def chart_from_cite(spark, sf):
    """The charts of a cited article's tables, or why there is none."""
    pages = tables.sheets(spark, sf).where("article_id = 4")
    asked = tables.sheet_rows(pages).select("article_id", "sheet").distinct().selectExpr("article_id", "sheet", f"{tables._WANTED} AS wanted", f"{tables._KIND} AS kind")
    return tables.series(pages, asked).select("article_id", "sheet", "kind", "note", F.coalesce(F.size("points"), F.lit(0)).cast("long").alias("n_points"))
