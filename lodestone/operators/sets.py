"""Set operations on arrays and on rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import beside
from lodestone.registry import query
from lodestone.views import table, view

NUMBERS = "[0-9]+"


def numbers(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(NUMBERS), F.lit(0)))


_PAIRS = ", n AS (SELECT doc_id, list_distinct(regexp_extract_all(text, '[0-9]+')) AS n FROM documents), p AS (SELECT a.doc_id, a.n AS x, b.n AS y FROM n a JOIN n b ON b.doc_id = a.doc_id + 1)"


def _pairs(spark, sf):
    """Each document's numbers beside those of the next one."""
    rows = beside(table(spark, sf, "documents").select("doc_id", numbers(F.col("text")).alias("n")), "n")
    return rows.withColumnsRenamed({"xn": "x", "yn": "y"})


@query(_PAIRS + " SELECT doc_id, list_sort(list_filter(x, lambda v: NOT list_contains(y, v))) AS only_a, list_sort(list_filter(y, lambda v: NOT list_contains(x, v))) AS only_b FROM p")
def set_diff(spark, sf):
    return _pairs(spark, sf).select("doc_id", F.array_sort(F.array_except("x", "y")).alias("only_a"), F.array_sort(F.array_except("y", "x")).alias("only_b"))


@query(_PAIRS + " SELECT doc_id, len(list_intersect(x, y)) AS shared, len(list_distinct(list_concat(x, y))) AS both FROM p")
def set_intersect_size(spark, sf):
    return _pairs(spark, sf).select("doc_id", F.size(F.array_intersect("x", "y")).alias("shared"), F.size(F.array_union("x", "y")).alias("both"))


@query("SELECT DISTINCT slug FROM (SELECT lower(trim(p_brand)) AS slug FROM part WHERE p_size < 25 UNION SELECT lower(trim(c_mktsegment)) FROM customer)")
def slug_union(spark, sf):
    a = table(spark, sf, "part").where("p_size < 25").select(F.lower(F.trim("p_brand")).alias("slug"))
    return a.union(table(spark, sf, "customer").select(F.lower(F.trim("c_mktsegment")))).distinct()


def first_seen(items: Column, most: int) -> Column:
    """Trimmed, without blanks and repeats, in order, at most `most`: the limit is the feature."""
    return F.slice(F.array_distinct(F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != "")), 1, most)


_FIRST = "list_filter(list_transform({s}, lambda x: trim(x)), lambda x: x <> '')"


def _first_sql(parts: str, most: int) -> str:
    listed = _FIRST.format(s=parts)
    return f"list_transform(list_filter(list_zip({listed}, range(1, len({listed}) + 1)), lambda z: list_position({listed}, z[1]) = z[2]), lambda z: z[1])[1:{most}]"


@query("SELECT p_partkey AS id, " + _first_sql("string_split(p_name || ' ' || p_type || ' ' || p_name, ' ')", 300) + " AS models FROM part")
def model_distinct(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), first_seen(F.split(F.concat_ws(" ", "p_name", "p_type", "p_name"), " "), 300).alias("models"))


@query(""", w AS (SELECT doc_id, trim(unnest(p)) AS w, generate_subscripts(p, 1) AS i FROM (SELECT doc_id, string_split(text, ',') AS p FROM documents)),
f AS (SELECT doc_id, list(w ORDER BY i)[1:8] AS keywords FROM (SELECT doc_id, w, min(i) AS i FROM w WHERE w <> '' GROUP BY 1, 2) GROUP BY 1) SELECT doc_id, coalesce(keywords, []) AS keywords FROM documents LEFT JOIN f USING (doc_id)""")
def keyword_distinct(spark, sf):
    """Up to eight distinct parts between a text's commas, as they come."""
    return table(spark, sf, "documents").select("doc_id", first_seen(F.split("text", ","), 8).alias("keywords"))


@query("SELECT doc_id, list_filter(string_split('EN+de+xx+' || lang, '+'), lambda l: NOT list_contains(['en', 'fr'], lower(l))) AS missing FROM documents WHERE lang NOT IN ('de', 'xx')")
def missing_langs(spark, sf):
    wanted = F.array_distinct(F.split(F.concat(F.lit("EN+de+xx+"), "lang"), "\\+"))
    lacking = F.filter(wanted, lambda x: ~F.array_contains(F.array(F.lit("en"), F.lit("fr")), F.lower(x)))
    return table(spark, sf, "documents").where("lang NOT IN ('de', 'xx')").select("doc_id", lacking.alias("missing"))


@query("SELECT user_id FROM (SELECT user_id FROM articles WHERE category_id = 3 INTERSECT SELECT user_id FROM points)")
def owners_intersect(spark, sf):
    return view(spark, sf, "articles").where("category_id = 3").select("user_id").intersect(view(spark, sf, "points").select("user_id"))


@query("SELECT id FROM (SELECT id FROM articles EXCEPT SELECT article_id FROM points)")
def articles_without_points(spark, sf):
    return view(spark, sf, "articles").select("id").subtract(view(spark, sf, "points").select("article_id"))
