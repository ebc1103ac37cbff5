"""Chunks by meaning: sentences with their neighbours as hashed vectors, cut where two are furthest apart.

Vectors are signed sums of hashed words, so they need no model and are the same wherever they are made. A text's
sentences join to it again, and so do its chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.chunking import windows_of
from lodestone.registry import query
from lodestone.views import table

SIZE = 64  # of a vector
BUFFER = 1  # sentences on either side that go into a sentence's vector
PERCENTILE = 0.9
LEAST = 100  # characters of a chunk; a smaller one goes with its neighbour
ENDS = "([.!?…]+[ \\t]+|\\n+)"
WORDS = "[\\p{L}\\p{Nd}]+"


def sentences(text: Column) -> Column:
    """Sentences with what ends them: marks with blanks, or line ends."""
    return F.filter(F.split(F.regexp_replace(text, ENDS, "$1\x01"), "\x01"), lambda x: x != "")


def hashed(words: DataFrame, keys: list[str]) -> DataFrame:
    """keys, vector: of each group of words (keys, word) the sums of their signs by place, both from the word's MD5."""
    h = F.md5(F.col("word").cast("binary"))
    place = F.conv(F.substring(h, 1, 4), 16, 10).cast("int") % SIZE
    sign = F.when(F.substring(h, 5, 1) < "8", 1).otherwise(-1)
    placed = words.select(*keys, place.alias("place"), sign.alias("sign"))
    sums = [F.sum(F.when(F.col("place") == i, F.col("sign")).otherwise(0)).cast("double") for i in range(SIZE)]
    return placed.groupBy(*keys).agg(F.array(*sums).alias("vector"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def pieces(docs: DataFrame) -> DataFrame:
    """id, n, sentence, piece of docs (id, text): a piece ends where the distance to the next sentence is above the text's percentile.

    Sentences without words, and those whose words' signs cancel, are at no distance from their neighbours.
    """
    rows = docs.select("id", F.posexplode(sentences(F.col("text"))).alias("n", "sentence"))
    near = F.explode(F.sequence(F.col("n") - BUFFER, F.col("n") + BUFFER)).alias("n")
    words = rows.select("id", near, F.explode(F.regexp_extract_all(F.lower("sentence"), F.lit(WORDS), F.lit(0))).alias("word"))
    vectors = hashed(words, ["id", "n"])
    of = Window.partitionBy("id").orderBy("n")
    following = F.lead("vector").over(of)
    cosine = F.try_divide(dot(F.col("vector"), F.col("next")), F.sqrt(dot(F.col("vector"), F.col("vector")) * dot(F.col("next"), F.col("next"))))
    apart = rows.select("id", "n").join(vectors, ["id", "n"], "left").withColumn("next", following).withColumn("last", F.lead("n").over(of).isNull())
    apart = apart.select("id", "n", F.when(~F.col("last"), F.round(F.coalesce(1 - cosine, F.lit(0.0)), 9)).alias("d"))
    limits = apart.groupBy("id").agg(F.round(F.percentile("d", F.lit(PERCENTILE)), 9).alias("limit"))
    cut = apart.join(limits, "id").select("id", "n", F.coalesce(F.col("d") > F.col("limit"), F.lit(False)).cast("int").alias("cut"))
    before = F.coalesce(F.sum("cut").over(of.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(cut.withColumn("piece", before.cast("int")).drop("cut"), ["id", "n"])


def chunked(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """id, chunk_index, chunk of docs (id, text): pieces put together until they hold least characters; a last one that does not goes with the one before."""
    rows = pieces(docs).groupBy("id", "piece").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "sentence"))), lambda x: x["sentence"]), "").alias("text"))
    sizes = rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("piece", F.char_length("text").alias("size")))).alias("p"))
    placed = sizes.select("id", "p", windows_of(F.col("p.size"), 1 << 30, least).alias("w"))
    last = F.element_at("w", -1)
    held = F.aggregate(F.zip_with("w", F.col("p.size"), lambda w, s: F.when(w == last, s).otherwise(0)), F.lit(0), lambda a, x: a + x)
    placed = placed.withColumn("short", (held < least) & (last > 0))
    merged = placed.select("id", F.explode(F.zip_with("p", "w", lambda p, w: F.struct(p["piece"].alias("piece"), F.when(F.col("short") & (w == last), w - 1).otherwise(w).alias("chunk_index")))).alias("x"))
    joined = rows.join(merged.select("id", "x.*"), ["id", "piece"])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "text"))), lambda x: x["text"]), "")
    return joined.groupBy("id", "chunk_index").agg(text.alias("chunk"))


_PLACES = ", ".join(f"sum(CASE WHEN place = {i} THEN sign ELSE 0 END)" for i in range(SIZE))


@query(f""", s AS (SELECT doc_id AS id, generate_subscripts(s, 1) - 1 AS n, unnest(s) AS sentence FROM (SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?…]+[ \\t]+|\\n+)', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS s FROM documents)),
w AS (SELECT id, n + k AS n, md5(unnest(regexp_extract_all(lower(sentence), '{WORDS}'))) AS h FROM s, (VALUES (-1), (0), (1)) v(k)),
p AS (SELECT id, n, ('0x' || substr(h, 1, 4))::INT % {SIZE} AS place, CASE WHEN substr(h, 5, 1) < '8' THEN 1 ELSE -1 END AS sign FROM w),
v AS (SELECT id, n, [{_PLACES}]::DOUBLE[] AS vector FROM p GROUP BY ALL),
a AS (SELECT s.id, s.n, vector, lead(vector) OVER o AS next, lead(s.n) OVER o IS NULL AS last FROM s LEFT JOIN v ON v.id = s.id AND v.n = s.n WINDOW o AS (PARTITION BY s.id ORDER BY s.n)),
d AS (SELECT id, n, CASE WHEN NOT last THEN round(coalesce(1 - list_dot_product(vector, next) / nullif(sqrt(list_dot_product(vector, vector) * list_dot_product(next, next)), 0), 0), 9) END AS d FROM a),
c AS (SELECT id, n, coalesce(d > round(quantile_cont(d, {PERCENTILE}) OVER (PARTITION BY id), 9), false)::INT AS cut FROM d),
q AS (SELECT id, n, coalesce(sum(cut) OVER (PARTITION BY id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS piece FROM c),
t AS (SELECT id, piece, string_agg(sentence, '' ORDER BY n) AS text FROM q JOIN s USING (id, n) GROUP BY ALL), u AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY piece) AS i FROM t),
f AS (SELECT id, i, piece, 0 AS g, length(text) AS held FROM u WHERE i = 1 UNION ALL
 SELECT u.id, u.i, u.piece, CASE WHEN held >= {LEAST} THEN g + 1 ELSE g END, CASE WHEN held >= {LEAST} THEN length(text) ELSE held + length(text) END FROM f JOIN u ON u.id = f.id AND u.i = f.i + 1),
l AS (SELECT id, max(g) AS g, arg_max(held, i) AS held FROM f GROUP BY 1)
SELECT f.id AS doc_id, CASE WHEN f.g = l.g AND l.held < {LEAST} AND l.g > 0 THEN f.g - 1 ELSE f.g END AS chunk_index, string_agg(text, '' ORDER BY piece) AS chunk FROM f JOIN l USING (id) JOIN t USING (id, piece) GROUP BY ALL""")
def chunk_semantic(spark, sf):
    """The stored texts in chunks by meaning."""
    return chunked(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")).withColumnRenamed("id", "doc_id")
