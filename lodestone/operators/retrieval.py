"""Retrieval: cosine top-k, lexical coverage, and their fusion by reciprocal rank.

Scores are computed and cut by TakeOrderedAndProject; ranks are numbered only on what the cut leaves,
which the parameters bound.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.operators.filters import alive, in_scope
from lodestone.operators.postings import Index, by_score, index_of, terms_of, tokens
from lodestone.operators.vectors import cells_of
from lodestone.registry import query
from lodestone.views import table, view

K = 60  # reciprocal-rank constant
QUERY_VECTOR = 0
QUERY_STEP = 100


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: str, b: str) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def vector_topk(points: DataFrame, query_point: DataFrame, k: int, threshold: float | None = None, embedding: str = "embedding") -> DataFrame:
    """point_id, score of the k points nearest to the one vector of query_point (column q); ties by point_id."""
    # query_point is one row, so the broadcast has a proven size
    scored = points.withColumn("_k", F.lit(1)).join(F.broadcast(query_point.select("q").limit(1).withColumn("_k", F.lit(1))), "_k").drop("_k")
    scored = scored.withColumn("score", F.round(cosine(embedding, "q"), 9))
    if threshold is not None:
        scored = scored.where(F.col("score") >= threshold)
    return scored.orderBy(F.desc("score"), "point_id").limit(k).select("point_id", "article_id", "score")


def nearest(spark: SparkSession, sf: str, k: int, users: list[int]) -> DataFrame:
    """point_id, article_id, score of the k stored points of some users that are nearest to the query's vector, from the index of cells."""
    points = view(spark, sf, "points")
    cells = cells_of(spark, sf, points.select(F.col("point_id").alias("id"), F.col("user_id").alias("scope"), F.col("embedding").alias("vector")), "embeddings")
    found = cells.search(query_vector(spark, sf).select(F.lit(0).alias("query"), F.col("q").alias("vector")), k, users)
    return points.select("point_id", "article_id").join(F.broadcast(found.select(F.col("id").alias("point_id"), "score")), "point_id").select("point_id", "article_id", "score")  # k rows


def query_vector(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").where(F.col("vec_id") == QUERY_VECTOR).select(F.col("embedding").alias("q"))


_Q = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"


def _cos(vector: str) -> str:
    x, q = f"CAST({vector} AS DOUBLE[])", f"CAST({_Q} AS DOUBLE[])"
    return f"round(list_dot_product({x}, {q}) / (sqrt(list_dot_product({x}, {x})) * sqrt(list_dot_product({q}, {q}))), 9)"


_COS = _cos("embedding")


@query(f"SELECT point_id, article_id, {_COS} AS score FROM points WHERE user_id IN (1, 2) ORDER BY score DESC, point_id LIMIT 10", name="vector_topk")
def _vector_topk(spark, sf):
    return nearest(spark, sf, 10, [1, 2])


@query(f"""SELECT query, id, score, rank FROM (SELECT q.vec_id AS query, v.vec_id AS id, round(list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])))), 9) AS score,
 row_number() OVER (PARTITION BY q.vec_id ORDER BY score DESC, v.vec_id) AS rank FROM embeddings q, embeddings v WHERE q.vec_id % {QUERY_STEP} = 0) WHERE rank <= 10""")
def vector_topk_all(spark, sf):
    """The ten nearest of all vectors for every query vector: those whose id is divisible by 100."""
    points = view(spark, sf, "points").select(F.col("point_id").alias("id"), F.col("user_id").alias("scope"), F.col("embedding").alias("vector"))
    asked = points.where(F.col("id") % QUERY_STEP == 0).select(F.col("id").alias("query"), "vector")
    return cells_of(spark, sf, points, "embeddings").search(asked, 10)


_TOKENS = "SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{Nd}]+') AS tokens FROM documents"


@query(_TOKENS)
def tokenize(spark, sf):
    """The tokens of every document."""
    return table(spark, sf, "documents").select("doc_id", tokens(F.col("text")).alias("tokens"))


def lexical_scores(docs: DataFrame, text: str, id_col: str) -> DataFrame:
    """Of docs with any term: covered (distinct terms), mentions (each term up to 3) and score (share of the terms' letters).

    Only the terms' own words leave a text, and one aggregation counts them. A question without a term has no rows.
    """
    if not (terms := terms_of(text)):
        return docs.where(F.lit(False)).select(id_col, F.lit(0).alias("covered"), F.lit(0).alias("mentions"), F.lit(0.0).alias("score"))
    found = docs.select(id_col, F.explode(F.filter(tokens(F.col("text")), lambda x: x.isin(*terms))).alias("_t"))
    counts = found.groupBy(id_col).agg(*[F.count_if(F.col("_t") == t).alias(f"_c{i}") for i, t in enumerate(terms)])
    add = lambda f: sum((f(F.col(f"_c{i}"), len(t)) for i, t in enumerate(terms)), F.lit(0))
    score = add(lambda c, w: F.when(c > 0, w).otherwise(0)) / F.lit(float(sum(map(len, terms))))
    return counts.select(id_col, add(lambda c, w: (c > 0).cast("int")).cast("int").alias("covered"), add(lambda c, w: F.least(c, F.lit(3))).cast("int").alias("mentions"), F.round(score, 9).alias("score"))


def lexically_ranked(index: Index, text: str, limit: int) -> DataFrame:
    """The best ids of an index for a question, by score, terms covered, mentions and id; for a question without a term, the first by id, with a score of 0."""
    if not terms_of(text):
        return index.entries().select("id", F.lit(0).alias("covered"), F.lit(0).alias("mentions"), F.lit(0.0).alias("score")).orderBy("id").limit(limit)
    return index.best(text, limit)[0]


QUESTION = "model data the benchmark of secret and information"


def _lexical_sql(ids: str, source: str, text: str) -> str:
    terms = ", ".join(f"('{t}', {len(t)})" for t in terms_of(text))
    total = sum(map(len, terms_of(text)))
    return f"""(WITH t(term, w) AS (VALUES {terms}), tok AS (SELECT {ids}, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{Nd}}]+')) AS term FROM {source}),
 c AS (SELECT {ids}, term, w, count(*) AS c FROM tok JOIN t USING (term) GROUP BY ALL)
 SELECT {ids}, CAST(count(*) AS INT) AS covered, CAST(sum(least(c, 3)) AS INT) AS mentions, round(sum(w) / {total}.0, 9) AS score FROM c GROUP BY ALL)"""


@query(f"SELECT * FROM {_lexical_sql('doc_id', 'documents', QUESTION)}")
def lexical_score(spark, sf):
    return index_of(spark, sf, "documents", "doc_id").scores(terms_of(QUESTION)).withColumnRenamed("id", "doc_id")


_ORDER = "score DESC, covered DESC, mentions DESC, doc_id"


@query(f"SELECT doc_id, score FROM {_lexical_sql('doc_id', 'documents', QUESTION)} ORDER BY {_ORDER} LIMIT 20")
def lexical_topk(spark, sf):
    return lexically_ranked(index_of(spark, sf, "documents", "doc_id"), QUESTION, 20).select(F.col("id").alias("doc_id"), "score")


@query(f"SELECT item_id, score FROM {_lexical_sql('item_id', 'benchmark', 'the of data and with')} ORDER BY score DESC, covered DESC, mentions DESC, item_id LIMIT 10")
def rank_lexical(spark, sf):
    return lexically_ranked(index_of(spark, sf, "benchmark", "item_id"), "the of data and with", 10).select(F.col("id").alias("item_id"), "score")


@query("SELECT doc_id FROM documents WHERE len(list_intersect(regexp_extract_all(lower(text), '[\\p{L}\\p{Nd}]+'), ['benchmark', 'secret', 'token'])) > 0 ORDER BY doc_id LIMIT 200")
def text_match(spark, sf):
    """Documents with at least one of the words."""
    found = index_of(spark, sf, "documents", "doc_id").postings(["benchmark", "secret", "token"])
    return found.select(F.col("id").alias("doc_id")).distinct().orderBy("doc_id").limit(200)


@query("SELECT term, CAST(length(term) AS INT) AS weight FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{Nd}]+')) AS term FROM benchmark) WHERE length(term) >= 2")
def term_weights(spark, sf):
    terms = table(spark, sf, "benchmark").select(F.explode(tokens(F.col("text"))).alias("term")).distinct()
    return terms.select("term", F.char_length("term").alias("weight")).where("weight >= 2")


def reciprocal_rank_fusion(lists: list[DataFrame], id_col: str = "point_id", k: int = K) -> DataFrame:
    """id, score summed over lists of (id, rank), as a 4-byte float; and the first list that has it."""
    out = None
    for i, ranked in enumerate(lists):
        rows = ranked.select(id_col, (1.0 / (k + F.col("rank"))).alias("part"), F.lit(i).alias("list"))
        out = rows if out is None else out.unionAll(rows)
    return out.groupBy(id_col).agg(F.round(F.sum("part"), 12).cast("float").alias("score"), F.min("list").alias("list"))


def ranked(df: DataFrame, *order) -> DataFrame:
    """df, which a limit has bounded, with its rank from 1."""
    return df.withColumn("_one", F.lit(1)).withColumn("rank", F.row_number().over(Window.partitionBy("_one").orderBy(*order))).drop("_one")


_DENSE = f"(SELECT point_id, article_id, {_COS} AS score FROM points WHERE user_id = 1 ORDER BY score DESC, point_id LIMIT 15)"
_TITLES = """(SELECT article_id, list(m ORDER BY i) AS title FROM (SELECT article_id, i, round(avg(x), 9) AS m FROM
 (SELECT article_id, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS i FROM points WHERE user_id = 1) GROUP BY ALL) GROUP BY 1)"""
_TITLE = f"(SELECT point_id, article_id, {_cos('title')} AS score FROM points JOIN {_TITLES} USING (article_id) WHERE user_id = 1 ORDER BY score DESC, point_id LIMIT 15)"


def title_topk(points: DataFrame, query_point: DataFrame, k: int) -> DataFrame:
    """The k points whose articles' title vectors are nearest; the mean of an article's points stands for its title. Points of one article go by id."""
    parts = points.select("article_id", F.posexplode("embedding").alias("i", "x")).groupBy("article_id", "i").agg(F.round(F.avg(F.col("x").cast("double")), 9).alias("m"))
    titles = parts.groupBy("article_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("title"))
    return vector_topk(points.join(titles, "article_id"), query_point, k, embedding="title")


@query(f"""SELECT point_id, CAST(round(sum(1.0::DOUBLE / (60 + r)), 12) AS FLOAT) AS score, min(l) AS list FROM (
 SELECT point_id, row_number() OVER (ORDER BY score DESC, point_id) AS r, 0 AS l FROM {_DENSE} UNION ALL SELECT point_id, row_number() OVER (ORDER BY score DESC, point_id), 1 FROM {_TITLE}) GROUP BY 1""")
def rrf_union(spark, sf):
    mine = view(spark, sf, "points").where(in_scope(1))
    dense = nearest(spark, sf, 15, [1])
    title = title_topk(mine, query_vector(spark, sf), 15)
    return reciprocal_rank_fusion([ranked(x, F.desc("score"), "point_id").select("point_id", "rank") for x in (dense, title)])


@query(f"SELECT point_id, row_number() OVER (ORDER BY score DESC, point_id) AS rank FROM {_DENSE}")
def rrf_rank(spark, sf):
    return ranked(nearest(spark, sf, 15, [1]), F.desc("score"), "point_id").select("point_id", "rank")


@query(f"""SELECT point_id, CAST(round(sum(1.0::DOUBLE / (60 + r)), 12) AS FLOAT) AS score FROM (
 SELECT point_id, row_number() OVER (ORDER BY score DESC, point_id) AS r FROM {_DENSE} WHERE score >= 0.1
 UNION ALL SELECT point_id, r FROM (SELECT point_id, score, row_number() OVER (ORDER BY score DESC, point_id) AS r FROM {_TITLE}) WHERE score >= 0.05) GROUP BY 1 ORDER BY score DESC, point_id LIMIT 10""")
def dense_dual_rrf(spark, sf):
    """Content and title vectors fused; titles under the gate are skipped but keep their rank."""
    mine = view(spark, sf, "points").where(in_scope(1))
    dense = nearest(spark, sf, 15, [1]).where("score >= 0.1")
    title = title_topk(mine, query_vector(spark, sf), 15)
    a = ranked(dense, F.desc("score"), "point_id").select("point_id", "rank")
    b = ranked(title, F.desc("score"), "point_id").where("score >= 0.05").select("point_id", "rank")
    return reciprocal_rank_fusion([a, b]).orderBy(F.desc("score"), "point_id").limit(10).select("point_id", "score")


def hybrid(points: DataFrame, dense: Callable[[int], DataFrame], index: Index, text: str, done: DataFrame, limit: int = 5) -> DataFrame:
    """Dense and lexical hits fused by reciprocal rank, cut, and then without hits of unfinished articles.

    points (point_id, article_id), dense (the nearest so many of them, with their score), index (of the points' texts by point_id), done (article_id). The dense list
    and the cut follow limit (5 by default, 20 at most); lexical hits are the best of all points' texts, and as many go into
    the fusion as dense hits. A question without a term leaves the dense list alone. Fewer than limit may be left.
    """
    limit = 5 if limit <= 0 else min(limit, 20)
    fetch = min(3 * limit, 20)
    lexical = index.best(text, fetch, points.select(F.col("point_id").alias("id")))[0].withColumnRenamed("id", "point_id")
    a = ranked(dense(fetch), F.desc("score"), "point_id").select("point_id", "rank")
    b = ranked(lexical, *by_score("point_id")).select("point_id", "rank")
    top = reciprocal_rank_fusion([a, b]).orderBy(F.desc("score"), "point_id").limit(limit)
    hits = points.select("point_id", "article_id").join(F.broadcast(top), "point_id")  # at most limit rows
    return hits.join(done, "article_id", "left_semi").select("point_id", "article_id", "score", "list")


HYBRID_SQL = f"""SELECT t.point_id, p.article_id, t.score, t.list FROM (SELECT point_id, CAST(round(sum(1.0::DOUBLE / (60 + r)), 12) AS FLOAT) AS score, min(l) AS list FROM (
  SELECT point_id, row_number() OVER (ORDER BY score DESC, point_id) AS r, 0 AS l FROM (SELECT point_id, {_COS} AS score FROM points WHERE user_id < 4 ORDER BY score DESC, point_id LIMIT 20)
  UNION ALL SELECT point_id, row_number() OVER (ORDER BY score DESC, covered DESC, mentions DESC, point_id), 1 FROM (SELECT doc_id AS point_id, covered, mentions, score FROM {_lexical_sql('doc_id', 'documents', QUESTION)} WHERE doc_id IN (SELECT point_id FROM points WHERE user_id < 4) ORDER BY score DESC, covered DESC, mentions DESC, point_id LIMIT 20))
  GROUP BY 1 ORDER BY score DESC, point_id LIMIT 20) t JOIN points p USING (point_id) WHERE p.article_id IN (SELECT id FROM articles WHERE index_status = 'done' AND deleted_at IS NULL)"""


@query(HYBRID_SQL)
def hybrid_search(spark, sf):
    """Points are the embeddings; a document's text goes with the point of the same id."""
    points = view(spark, sf, "points").where("user_id < 4")
    done = alive(view(spark, sf, "articles")).where("index_status = 'done'").select(F.col("id").alias("article_id"))
    return hybrid(points, lambda k: nearest(spark, sf, k, [0, 1, 2, 3]), index_of(spark, sf, "documents", "doc_id"), QUESTION, done, 20)
