"""Chunks and page windows as table functions, callable from SQL in LATERAL and over partitioned tables.

Rows come out as they are found: a function holds one text, or three numbers of a partition.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from lodestone.operators.chunking import PLAIN, VIETNAMESE, parts
from lodestone.registry import query
from lodestone.views import article_pages, table

PAGES, ROOM = 8, 2000


@udtf(returnType="chunk_index int, chunk string")
class ChunkText:
    """chunk_text(text, size, overlap, vietnamese): chunks of at most size characters, each begun with the end of the one before."""

    def eval(self, text: str, size: int, overlap: int, vietnamese: bool):
        n, before, held, length, room = 0, None, [], 0, size - overlap - 1
        for p in [*parts(text or "", room, VIETNAMESE if vietnamese else PLAIN), None]:
            if held and (p is None or length + 1 + len(p) > room):
                chunk = " ".join(held)
                yield n, chunk if before is None or not overlap else f"{before[-overlap:]} {chunk}"
                n, before, held, length = n + 1, chunk, [], 0
            if p is not None:
                length += len(p) + bool(held)
                held.append(p)


@udtf(returnType="article_id long, seq int, window int")
class PageWindows:
    """page_windows(TABLE(pages) PARTITION BY article_id ORDER BY seq): the window of each page, eight pages at most and closed once they hold 2,000 bytes."""

    def __init__(self):
        self.window, self.pages, self.held = 0, 0, 0

    def eval(self, row):
        if self.pages >= PAGES or self.held >= ROOM:
            self.window, self.pages, self.held = self.window + 1, 0, 0
        self.pages += 1
        self.held += row["size"]
        yield row["article_id"], row["seq"], self.window


def register(spark: SparkSession) -> None:
    spark.udtf.register("chunk_text", ChunkText)
    spark.udtf.register("page_windows", PageWindows)


@query()
def chunk_lateral(spark, sf):
    """The chunks of chunk_recursive, from SQL."""
    register(spark)
    return spark.sql("SELECT doc_id, c.chunk_index, c.chunk FROM {docs}, LATERAL chunk_text(text, 1000, 200, false) c", docs=table(spark, sf, "documents"))


@query(""", n AS (SELECT article_id, row_number() OVER (PARTITION BY article_id ORDER BY seq) AS i, seq, CAST(strlen(text) AS BIGINT) AS b FROM article_pages),
f AS (SELECT article_id, i, seq, 0 AS w, 1 AS k, b AS s FROM n WHERE i = 1 UNION ALL
 SELECT n.article_id, n.i, n.seq, f.w + CASE WHEN f.k >= 8 OR f.s >= 2000 THEN 1 ELSE 0 END, CASE WHEN f.k >= 8 OR f.s >= 2000 THEN 1 ELSE f.k + 1 END, CASE WHEN f.k >= 8 OR f.s >= 2000 THEN n.b ELSE f.s + n.b END FROM f JOIN n ON n.article_id = f.article_id AND n.i = f.i + 1)
SELECT article_id, CAST(seq AS INT) AS seq, w AS "window" FROM f""")
def page_windows_table(spark, sf):
    """The window of every page, from SQL over a partitioned table."""
    register(spark)
    pages = article_pages(spark, sf).selectExpr("article_id", "seq", "octet_length(text) AS size")
    return spark.sql("SELECT w.article_id, w.seq, w.window FROM page_windows(TABLE(SELECT * FROM {pages}) PARTITION BY article_id ORDER BY seq) w", pages=pages)
