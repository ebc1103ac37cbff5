"""Headings, blocks and chunks of texts, and the pages they come from.

Headings and blocks are native expressions. Recursive chunking is a small fold in Arrow batches; page cuts
are relational.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from lodestone.operators.windows import carried
from lodestone.registry import query
from lodestone.views import article_pages, chunks, table, view

#: Headwords of legal texts: fixed values.
HEADWORDS = "ĐIỀU|Điều|MỤC|Mục|CHƯƠNG|Chương|PHẦN|Phần|BÀI|Bài"
UPPER = "ĐIỀU|MỤC|CHƯƠNG|PHẦN|BÀI"
NUMBER = "[IVXLCDM0-9]++"
#: At a line's start any heading counts; inside a line only capitals with a mark or the end after the number.
#: All headwords begin with one of five letters; other places are left at once, without a look behind.
HEADING = rf"(?m)(?=[ĐMCPB])(?:(?<=^[ \t\r>]{{0,40}})(?:{HEADWORDS})\s+{NUMBER}|(?:{UPPER})\s+{NUMBER}(?=\s*(?:[:.)\]-]|\z)))"
MARK = "\x01"

def headings(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(HEADING), F.lit(0))


def blocks(text: Column) -> Column:
    """The text cut before each heading: pieces that join to the text again; what stands before the first is one too."""
    return F.filter(F.split(F.regexp_replace(text, HEADING, f"{MARK}$0"), MARK), lambda x: x != "")


def heading_title(block: Column, most: int = 120) -> Column:
    """A heading's name: up to the line's end, a clause mark or a stray headword; white space as one, cut at a word."""
    line = F.regexp_extract(block, rf"^((?:{HEADWORDS})\s+{NUMBER}.*?)(?:\n|\s[0-9]+\.\s|\s(?:{UPPER})\s|\z)", 1)
    flat = F.btrim(F.regexp_replace(line, "\\s+", " "))
    return F.when(F.char_length(flat) > most, F.regexp_extract(F.left(flat, F.lit(most)), "^(.*)\\s", 1)).otherwise(flat)


def section_level(name: Column) -> Column:
    """By the first word's letters: chapters and parts 1, divisions 2, anything else 3."""
    head = F.upper(F.regexp_extract(name, "^\\s*(\\p{L}+)", 1))
    return F.when(head.isin("CHƯƠNG", "PHẦN"), 1).when(head == "MỤC", 2).otherwise(3)


def with_offsets(docs: DataFrame, id_col: str = "id") -> DataFrame:
    """id, n, block, first, last: blocks with their byte offsets, from running sums."""
    rows = docs.select(id_col, blocks(F.col("text")).alias("b")).select(id_col, F.posexplode("b").alias("n", "block"))
    size = F.octet_length("block")
    last = F.sum(size).over(Window.partitionBy(id_col).orderBy("n"))
    return rows.withColumn("last", last).withColumn("first", F.col("last") - size).select(id_col, "n", "block", "first", "last")


def parts(text: str, room: int, separators: list[str]) -> list[str]:
    """Pieces of at most room characters, cut at the largest separator that does it."""
    if len(text) <= room:
        return [text] if text.strip() else []
    mark, rest = separators[0], separators[1:]
    if not mark:
        return [text[i : i + room] for i in range(0, len(text), room)]
    return [p for piece in text.split(mark) for p in parts(piece, room, rest)]


def recursive_chunks(text: str | None, size: int, overlap: int, separators: list[str]) -> list[str]:
    """Chunks of at most size characters; each begins with the end of the one before."""
    out: list[str] = []
    held, length = [], 0
    for p in parts(text or "", size - overlap - 1, separators):
        if held and length + 1 + len(p) > size - overlap - 1:
            out.append(" ".join(held))
            held, length = [], 0
        length += len(p) + bool(held)
        held.append(p)
    if held:
        out.append(" ".join(held))
    return [out[i] if not i or not overlap else f"{out[i - 1][-overlap:]} {out[i]}" for i in range(len(out))]


PLAIN = ["\n\n", "\n", " ", ""]
#: From the largest to the smallest boundary of Vietnamese prose: fixed values.
VIETNAMESE = ["\n\n", "\n", "…", "...", ".", "?", "!", ";", ":", " ", ""]


SLICE = 1 << 20  # characters of chunks that leave a task at once


def chunker(size: int, overlap: int, separators: list[str]):
    """Of batches whose last column is a text: the other columns, number and text of each chunk. A text is cut at a time, and chunks leave in slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.columns[:-1], batch.columns[-1]
            rows, numbers, out, held = [], [], [], 0

            def chunks_of(rows, numbers, out, keys=keys, names=(*batch.schema.names[:-1], "number", "chunk")):
                at = pa.array(rows, pa.int64())
                return pa.RecordBatch.from_arrays([*(k.take(at) for k in keys), pa.array(numbers, pa.int32()), pa.array(out, pa.string())], names=list(names))

            for row in range(batch.num_rows):
                found = recursive_chunks(texts[row].as_py(), size, overlap, separators)
                rows += [row] * len(found)
                numbers += range(len(found))
                out += found
                held += sum(map(len, found))
                if held > SLICE:
                    yield chunks_of(rows, numbers, out)
                    rows, numbers, out, held = [], [], [], 0
            if out:
                yield chunks_of(rows, numbers, out)

    return run


def cut(rows: DataFrame, text: str, number: str, separators: list[str], size: int, overlap: int) -> DataFrame:
    """rows with the chunks of a text in its place: their number and chunk."""
    keys = [c for c in rows.columns if c != text]
    schema = StructType([*(rows.schema[c] for c in keys), StructField("number", IntegerType()), StructField("chunk", StringType())])
    return rows.select(*keys, text).mapInArrow(chunker(size, overlap, separators), schema).withColumnRenamed("number", number)


def chunked(docs: DataFrame, separators: list[str], size: int = 1000, overlap: int = 200, id_col: str = "doc_id") -> DataFrame:
    return cut(docs.select(id_col, "text"), "text", "chunk_index", separators, size, overlap)


@query()
def chunk_recursive(spark, sf):
    return chunked(table(spark, sf, "documents"), PLAIN)


@query()
def chunk_recursive_vi(spark, sf):
    return chunked(table(spark, sf, "documents"), VIETNAMESE)


def chunked_blocks(docs: DataFrame, size: int = 1000, overlap: int = 200) -> DataFrame:
    """Blocks of docs (id, text) chunked on their own; each chunk is headed by its section."""
    rows = with_offsets(docs).withColumn("title", heading_title(F.col("block")))
    pieces = cut(rows.select("id", "n", "title", "block"), "block", "i", PLAIN, size, overlap)
    return pieces.select("id", "n", "i", F.concat(F.when(F.col("title") == "", "").otherwise(F.concat(F.lit("["), "title", F.lit("]\n"))), "chunk").alias("chunk"))


def overlaps(a: DataFrame, b: DataFrame, width: int = 4096) -> DataFrame:
    """Rows (key, an, bn, lo, hi) of intervals (key, n, lo, hi) of a and b that overlap, with the part they share.

    Both sides are dealt to bins of the axis, so a pair meets in a bin by an equi-join; it is kept in the
    first bin that both have, so it comes once.
    """
    bins = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor((F.col(hi) - 1) / width)))
    x = a.where("hi > lo").select("key", F.col("n").alias("an"), F.col("lo").alias("alo"), F.col("hi").alias("ahi"), bins("lo", "hi").alias("bin"))
    y = b.where("hi > lo").select("key", F.col("n").alias("bn"), F.col("lo").alias("blo"), F.col("hi").alias("bhi"), bins("lo", "hi").alias("bin"))
    lo, hi = F.greatest("alo", "blo"), F.least("ahi", "bhi")
    return x.join(y, ["key", "bin"]).where((lo < hi) & (F.col("bin") == F.floor(lo / width))).select("key", "an", "bn", lo.alias("lo"), hi.alias("hi"))


_PAGE_SPANS = "p AS (SELECT article_id, seq, sum(strlen(text) + 2) OVER (PARTITION BY article_id ORDER BY seq) - strlen(text) - 2 AS lo, sum(strlen(text) + 2) OVER (PARTITION BY article_id ORDER BY seq) - 2 AS hi FROM article_pages)"


@query(f", {_PAGE_SPANS}, b AS (SELECT article_id, n, n * 700 AS lo, n * 700 + 700 AS hi FROM (SELECT article_id, unnest(range(0, CAST(max(hi) AS BIGINT) // 700 + 1)) AS n FROM p GROUP BY 1)) SELECT b.article_id, n AS block, seq, CAST(greatest(b.lo, p.lo) AS BIGINT) AS lo, CAST(least(b.hi, p.hi) AS BIGINT) AS hi FROM b JOIN p ON b.article_id = p.article_id AND b.lo < p.hi AND p.lo < b.hi AND p.lo < p.hi")
def page_cuts(spark, sf):
    """Which bytes of each page stand in which block of 700; pages are joined by two bytes that belong to none."""
    size = F.octet_length("text") + 2
    end = F.sum(size).over(Window.partitionBy("article_id").orderBy("seq"))
    pages = article_pages(spark, sf).select(F.col("article_id").alias("key"), F.col("seq").alias("n"), (end - size).alias("lo"), (end - 2).alias("hi"))
    last = pages.groupBy("key").agg(F.max("hi").alias("m"))
    cut = last.select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("m") / 700))).alias("n")).withColumn("lo", F.col("n") * 700).withColumn("hi", F.col("n") * 700 + 700)
    return overlaps(cut, pages).select(F.col("key").alias("article_id"), F.col("an").alias("block"), F.col("bn").alias("seq"), "lo", "hi")


def windows_of(sizes: Column, pages: int = 8, room: int = 2000) -> Column:
    """The window of each of these sizes: pages at most, closed once they hold room bytes. n sizes are folded in blocks of sqrt(n), as each step copies what its block has so far."""
    empty = F.array().cast("array<int>")

    def step(acc, x):
        full = (acc["k"] >= pages) | (acc["s"] >= room)
        w = acc["w"] + full.cast("int")
        used = lambda c: F.when(full, 0).otherwise(acc[c])
        return F.struct(w.alias("w"), (used("k") + 1).alias("k"), (used("s") + x).alias("s"), F.concat(acc["out"], F.array(w)).alias("out"))

    def block(acc, part):
        begin = F.struct(acc["w"].alias("w"), acc["k"].alias("k"), acc["s"].alias("s"), empty.alias("out"))
        inner = F.aggregate(part, begin, step)
        return F.struct(inner["w"].alias("w"), inner["k"].alias("k"), inner["s"].alias("s"), F.concat(acc["out"], inner["out"]).alias("out"))

    size = F.ceil(F.sqrt(F.size(sizes))).cast("int")
    blocks = F.transform(F.sequence(F.lit(1), F.size(sizes), size), lambda i: F.slice(sizes, i, size))
    start = F.struct(F.lit(0).alias("w"), F.lit(0).alias("k"), F.lit(0).alias("s"), empty.alias("out"))
    return F.aggregate(blocks, start, block, lambda acc: acc["out"])


@query(""", n AS (SELECT article_id, row_number() OVER (PARTITION BY article_id ORDER BY seq) AS i, seq, CAST(strlen(text) AS BIGINT) AS b FROM article_pages),
f AS (SELECT article_id, i, seq, 0 AS w, 1 AS k, b AS s FROM n WHERE i = 1 UNION ALL
 SELECT n.article_id, n.i, n.seq, f.w + CASE WHEN f.k >= 8 OR f.s >= 2000 THEN 1 ELSE 0 END, CASE WHEN f.k >= 8 OR f.s >= 2000 THEN 1 ELSE f.k + 1 END, CASE WHEN f.k >= 8 OR f.s >= 2000 THEN n.b ELSE f.s + n.b END FROM f JOIN n ON n.article_id = f.article_id AND n.i = f.i + 1)
SELECT article_id, w AS "window", min(seq) AS first, max(seq) AS last FROM f GROUP BY ALL""")
def page_windows(spark, sf):
    """Pages of each article in windows: eight pages at most, closed once they hold 2,000 bytes."""
    pages = article_pages(spark, sf).groupBy("article_id").agg(F.array_sort(F.collect_list(F.struct("seq", F.octet_length("text").alias("b")))).alias("p"))
    placed = pages.select("article_id", F.explode(F.arrays_zip(F.col("p.seq").alias("seq"), windows_of(F.col("p.b")).alias("w"))).alias("x"))
    return placed.groupBy("article_id", F.col("x.w").alias("window")).agg(F.min("x.seq").alias("first"), F.max("x.seq").alias("last"))


@query()
def piece_split(spark, sf):
    """Texts in pieces of at most 4,096 characters, cut after the last line end within; an empty text is one piece."""
    @F.pandas_udf("array<string>")
    def cut(text: pd.Series) -> pd.Series:
        def one(t: str) -> list[str]:
            out = []
            while len(t) > 4096:
                at = t.rfind("\n", 0, 4096) + 1 or 4096
                out.append(t[:at])
                t = t[at:]
            return [*out, t] if t or not out else out

        return text.fillna("").map(one)

    return table(spark, sf, "documents").select("doc_id", F.posexplode(cut("text")).alias("seq", "piece"))


def with_sections(rows: DataFrame) -> DataFrame:
    """rows (article_id, chunk_index, chunk, ...) with the name of each chunk's section: its first heading, else the last before it, else ''."""
    titles = F.filter(F.transform(blocks(F.col("chunk")), lambda b: heading_title(b)), lambda t: t != "")
    named = rows.withColumn("_titles", titles)
    section = carried(F.try_element_at("_titles", F.lit(1)), F.try_element_at("_titles", F.lit(-1)), "article_id", "chunk_index")
    return named.withColumn("section", F.coalesce(section, F.lit(""))).drop("_titles")


@query()
def index_article(spark, sf):
    """Clean pages to chunks with sections and identifiers: the whole indexing phase."""
    from lodestone.functions.text import clean_lines, point_id

    pages = article_pages(spark, sf).select("article_id", "seq", clean_lines(F.col("text")).alias("text")).where("text <> ''")
    pieces = cut(pages, "text", "i", PLAIN, 1000, 200)
    numbered = pieces.withColumn("chunk_index", F.row_number().over(Window.partitionBy("article_id").orderBy("seq", "i")) - 1)
    rows = with_sections(numbered)
    return rows.select("article_id", "chunk_index", "seq", "section", point_id(F.col("article_id"), F.col("chunk_index")).alias("point_id"), F.concat(F.when(F.col("section") == "", "").otherwise(F.concat(F.lit("["), "section", F.lit("]\n"))), "chunk").alias("text"))


@query("SELECT 'counts' AS list, status AS item, n FROM (SELECT extract_status AS status, count(*) AS n FROM articles WHERE deleted_at IS NULL GROUP BY 1) UNION ALL SELECT 'failed', CAST(id AS VARCHAR), attempts FROM (SELECT id, attempts FROM articles WHERE extract_status = 'failed' AND deleted_at IS NULL ORDER BY id LIMIT 20) UNION ALL SELECT 'purge', CAST(id AS VARCHAR), deleted_at FROM (SELECT id, deleted_at FROM articles WHERE deleted_at IS NOT NULL ORDER BY deleted_at, id LIMIT 20)")
def queue_dashboard(spark, sf):
    """Status counts, the first failed articles and the next ones to purge, as one list."""
    rows = view(spark, sf, "articles")
    alive = rows.where("deleted_at IS NULL")
    counts = alive.groupBy("extract_status").agg(F.count("*").alias("n")).select(F.lit("counts").alias("list"), F.col("extract_status").alias("item"), "n")
    failed = alive.where("extract_status = 'failed'").orderBy("id").limit(20).select(F.lit("failed"), F.col("id").cast("string"), F.col("attempts").cast("long"))
    purge = rows.where("deleted_at IS NOT NULL").orderBy("deleted_at", "id").limit(20).select(F.lit("purge"), F.col("id").cast("string"), F.col("deleted_at").cast("long"))
    return counts.union(failed).union(purge)
