"""Sections of articles by their headings: carried over chunks, spans, the tree they make, and what is compiled from them.

All run over the chunks of legal texts (views.law_chunks). Texts leave a shuffle once, by article; what follows carries names and places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.chunking import HEADWORDS, UPPER, chunked_blocks, heading_title, headings, section_level, with_offsets, with_sections
from lodestone.registry import query
from lodestone.views import law_chunks, table, view

MOST_CHUNKS = 6  # of a section that go into its summary
BATCH = 8  # sections of one call
LEVELS = 3

_NUM = "[IVXLCDM0-9]+"
_MARKED = f"""regexp_replace(regexp_replace(regexp_replace(text, '(?m)^([ \\t\\r>]{{0,40}})((?:{HEADWORDS})\\s+{_NUM})', '\\1' || chr(1) || '\\2', 'g'), '((?:{UPPER})\\s+{_NUM})(\\s*(?:[:.)\\]-]|$))', chr(1) || '\\1\\2', 'g'), chr(1) || '+', chr(1), 'g')"""
_TITLE = f"trim(regexp_replace(regexp_extract(x, '^((?:{HEADWORDS})\\s+{_NUM}.*?)(?:\\n|\\s[0-9]+\\.\\s|\\s(?:{UPPER})\\s|$)', 1), '\\s+', ' ', 'g'))"
_CUT = f"CASE WHEN length({_TITLE}) > 120 THEN regexp_extract(left({_TITLE}, 120), '^(.*)\\s', 1) ELSE {_TITLE} END"
#: named (article_id, chunk_index, text, section), sections (article_id, section, start_chunk), in DuckDB.
SQL = f""", titled AS (SELECT article_id, chunk_index, text, list_filter(list_transform(string_split({_MARKED}, chr(1)), lambda x: {_CUT}), lambda x: x <> '') AS titles FROM law_chunks),
named AS (SELECT article_id, chunk_index, text, coalesce(titles[1], last_value(titles[-1] IGNORE NULLS) OVER (PARTITION BY article_id ORDER BY chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS section FROM titled),
sections AS (SELECT article_id, section, min(chunk_index) AS start_chunk FROM named WHERE section <> '' GROUP BY ALL),
leveled AS (SELECT *, CASE WHEN upper(regexp_extract(section, '^\\s*(\\p{{L}}+)', 1)) IN ('CHƯƠNG', 'PHẦN') THEN 1 WHEN upper(regexp_extract(section, '^\\s*(\\p{{L}}+)', 1)) = 'MỤC' THEN 2 ELSE 3 END AS level FROM sections),
spans AS (SELECT *, greatest(1, least({MOST_CHUNKS}, coalesce(lead(start_chunk) OVER w - start_chunk, {MOST_CHUNKS}))) AS span, row_number() OVER w - 1 AS place FROM sections WINDOW w AS (PARTITION BY article_id ORDER BY start_chunk, section))"""


#: blocks (id, n, block) of the texts of law_chunks by a number of their own, in DuckDB.
_BLOCKS = f", b AS (SELECT article_id * 100000 + chunk_index AS id, list_filter(string_split({_MARKED}, chr(1)), lambda x: x <> '') AS b FROM law_chunks), blocks AS (SELECT id, generate_subscripts(b, 1) - 1 AS n, unnest(b) AS x FROM b)"


def law_texts(spark, sf) -> DataFrame:
    return law_chunks(spark, sf).select((F.col("article_id") * 100000 + F.col("chunk_index")).alias("id"), "text")


@query(_BLOCKS + f" SELECT id, row_number() OVER (PARTITION BY id ORDER BY n) - 1 AS n, regexp_extract(x, '^(?:{HEADWORDS})\\s+{_NUM}') AS heading FROM blocks WHERE regexp_matches(x, '^(?:{HEADWORDS})\\s+{_NUM}')")
def find_headings(spark, sf):
    return law_texts(spark, sf).select("id", F.posexplode(headings(F.col("text"))).alias("n", "heading"))


@query(_BLOCKS + f" SELECT id, n, {_CUT} AS title FROM blocks", name="heading_title")
def _heading_title(spark, sf):
    return with_offsets(law_texts(spark, sf)).select("id", "n", heading_title(F.col("block")).alias("title"))


@query(_BLOCKS + " SELECT id, n, x AS block, sum(strlen(x)) OVER w - strlen(x) AS first, sum(strlen(x)) OVER w AS last FROM blocks WINDOW w AS (PARTITION BY id ORDER BY n)")
def split_blocks(spark, sf):
    """The blocks of each text, which begin at headings, with their byte offsets."""
    return with_offsets(law_texts(spark, sf))


@query()
def chunk_laws(spark, sf):
    """Blocks chunked on their own; each chunk is headed by its section."""
    return chunked_blocks(law_texts(spark, sf), 60, 10)


def named(spark, sf) -> DataFrame:
    """article_id, chunk_index, text, section of every chunk."""
    return with_sections(law_chunks(spark, sf).withColumnRenamed("text", "chunk")).withColumnRenamed("chunk", "text").select("article_id", "chunk_index", "text", "section")


def starts(chunks: DataFrame) -> DataFrame:
    """article_id, section, start_chunk: where each section of an article begins."""
    return chunks.where("section <> ''").groupBy("article_id", "section").agg(F.min("chunk_index").alias("start_chunk"))


def spanned(sections: DataFrame) -> DataFrame:
    """Sections with their place in the article and how many chunks they take: up to the next one, from 1 to MOST_CHUNKS."""
    order = Window.partitionBy("article_id").orderBy("start_chunk", "section")
    following = F.lead("start_chunk").over(order) - F.col("start_chunk")
    return sections.withColumns({"span": F.greatest(F.lit(1), F.least(F.lit(MOST_CHUNKS), F.coalesce(following, F.lit(MOST_CHUNKS)))), "place": F.row_number().over(order) - 1})


def header(section: Column) -> Column:
    return F.when(section == "", "").otherwise(F.concat(F.lit("["), section, F.lit("]\n")))


@query(SQL + " SELECT article_id, chunk_index, section FROM named")
def section_carry(spark, sf):
    """Each chunk's section: its first heading, else the last one before it."""
    return named(spark, sf).select("article_id", "chunk_index", "section")


@query(SQL + " SELECT article_id, chunk_index, CASE WHEN section = '' THEN '' ELSE '[' || section || ']' || chr(10) END AS header FROM named")
def section_header(spark, sf):
    return named(spark, sf).select("article_id", "chunk_index", header(F.col("section")).alias("header"))


@query(SQL + " SELECT article_id, section, start_chunk FROM sections")
def section_spans(spark, sf):
    """Where each section of an article begins."""
    return starts(named(spark, sf))


@query(SQL + " SELECT article_id, section, span FROM spans")
def section_span_len(spark, sf):
    return spanned(starts(named(spark, sf))).select("article_id", "section", "span")


@query(SQL + " SELECT section, start_chunk FROM sections WHERE article_id = 9")
def list_sections(spark, sf):
    """An article's sections, in order."""
    return starts(named(spark, sf).where("article_id = 9")).select("section", "start_chunk").orderBy("start_chunk")


@query(SQL + " SELECT article_id, section, level FROM leveled", name="section_level")
def _section_level(spark, sf):
    return starts(named(spark, sf)).select("article_id", "section", section_level(F.col("section")).alias("level"))


def nested(sections: DataFrame) -> DataFrame:
    """Sections (article_id, section, start_chunk) with level, parent (null for a root), depth and place among the parent's children.

    A section hangs under the nearest one before it of a smaller level. For a level that is the last section before of all
    smaller ones, so a new chapter takes over from the parts of the chapter before by itself. Levels are few, and
    there is one window per level; a row's depth is its parent's, which is known when the parent's level is done.
    """
    before = Window.partitionBy("article_id").orderBy("start_chunk", "section").rowsBetween(Window.unboundedPreceding, -1)
    rows = sections.withColumns({"level": section_level(F.col("section")), "up": F.lit(None).cast("struct<section:string,depth:int>"), "depth": F.lit(0)})
    for level in range(2, LEVELS + 1):
        last = F.last(F.when(F.col("level") < level, F.struct("section", "depth")), ignorenulls=True).over(before)
        rows = rows.withColumn("last", last)
        here = F.col("level") == level
        rows = rows.withColumns({"up": F.when(here, F.col("last")).otherwise(F.col("up")), "depth": F.when(here, F.coalesce(F.col("last.depth") + 1, F.lit(0))).otherwise(F.col("depth"))}).drop("last")
    place = F.row_number().over(Window.partitionBy("article_id", "up.section").orderBy("start_chunk", "section"))
    return rows.select("article_id", "section", "start_chunk", "level", F.col("up.section").alias("parent"), "depth", place.alias("place"))


@query(SQL + """, p AS (SELECT a.article_id, a.section, a.start_chunk, a.level, arg_max(b.section, b.start_chunk) AS parent FROM leveled a LEFT JOIN leveled b ON a.article_id = b.article_id AND b.start_chunk < a.start_chunk AND b.level < a.level GROUP BY ALL),
d AS (SELECT article_id, section, 0 AS depth FROM p WHERE parent IS NULL UNION ALL SELECT p.article_id, p.section, depth + 1 FROM p JOIN d ON p.article_id = d.article_id AND p.parent = d.section)
SELECT article_id, section, start_chunk, level, parent, depth, row_number() OVER (PARTITION BY article_id, parent ORDER BY start_chunk, section) AS place FROM p JOIN d USING (article_id, section)""")
def tree_parent(spark, sf):
    """The tree of each article's sections."""
    return nested(starts(named(spark, sf)))


@query(SQL + " SELECT s.article_id, s.section, s.start_chunk, CASE WHEN a.compile_status = 'done' THEN coalesce(n.summary, '') ELSE '' END AS summary FROM sections s JOIN articles a ON a.id = s.article_id LEFT JOIN (SELECT m.article_id, section, concat('q', quality, ':', section) AS summary FROM sections m JOIN labels ON doc_id = m.article_id WHERE start_chunk % 2 = 0) n ON n.article_id = s.article_id AND n.section = s.section")
def section_summaries(spark, sf):
    """Sections with the stored summary of that name, where their article is compiled; every second chunk's section has one."""
    sections = starts(named(spark, sf))
    notes = table(spark, sf, "labels").select(F.col("doc_id").alias("article_id"), "quality").join(sections.where("start_chunk % 2 = 0"), "article_id")
    notes = notes.select("article_id", "section", F.concat(F.lit("q"), "quality", F.lit(":"), "section").alias("note"))
    status = view(spark, sf, "articles").select(F.col("id").alias("article_id"), "compile_status")
    joined = sections.join(status, "article_id").join(notes, ["article_id", "section"], "left")
    return joined.select("article_id", "section", "start_chunk", F.when(F.col("compile_status") == "done", F.coalesce("note", F.lit(""))).otherwise("").alias("summary"))


def compiled(chunks: DataFrame, model: str) -> DataFrame:
    """Each section with its batch of eight, the chunks of its span that are not blank joined by an empty line, and the hash its summary is cached under (null if blank)."""
    spans = spanned(starts(chunks)).withColumnRenamed("section", "own")
    at = chunks.join(spans.withColumnRenamed("start_chunk", "chunk_index"), ["article_id", "chunk_index"], "left")
    upto = Window.partitionBy("article_id").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("own").isNotNull(), F.struct("own", F.col("chunk_index").alias("start_chunk"), "span", "place")), ignorenulls=True).over(upto)
    inside = at.withColumn("s", last).where(F.col("chunk_index") < F.col("s.start_chunk") + F.col("s.span"))
    kept = F.collect_list(F.when(F.btrim("text") != "", F.struct("chunk_index", "text")))
    text = F.array_join(F.transform(F.array_sort(kept), lambda x: x["text"]), "\n\n")
    rows = inside.groupBy("article_id", F.col("s.own").alias("section"), F.col("s.start_chunk").alias("start_chunk"), F.col("s.place").alias("place")).agg(text.alias("text"))
    h = F.when(F.col("text") != "", F.sha2(F.concat_ws("|", F.lit(model), "section", "text"), 256))
    return rows.select("article_id", "section", "start_chunk", F.expr(f"place div {BATCH}").alias("batch"), "text", h.alias("h"))


@query(SQL + f""", c AS (SELECT s.article_id, s.section, s.start_chunk, s.place // {BATCH} AS batch, coalesce(string_agg(n.text, chr(10) || chr(10) ORDER BY chunk_index) FILTER (trim(n.text) <> ''), '') AS text FROM spans s JOIN named n ON n.article_id = s.article_id AND chunk_index >= s.start_chunk AND chunk_index < s.start_chunk + span GROUP BY ALL),
k AS (SELECT *, CASE WHEN text <> '' THEN sha256('m1|' || section || '|' || text) END AS h FROM c),
o AS (SELECT *, h IN (SELECT h FROM k WHERE article_id % 2 = 0 AND h IS NOT NULL) AS hit FROM k)
SELECT article_id, batch, section, start_chunk, h, CASE WHEN h IS NULL THEN 'blank' WHEN hit THEN 'hit' ELSE 'pending' END AS state, CASE WHEN h IS NOT NULL AND NOT hit THEN row_number() OVER (PARTITION BY article_id, batch, h IS NOT NULL AND NOT hit ORDER BY start_chunk) END AS asked FROM o""")
def compile_sections(spark, sf):
    """What a compilation does with each section: blank ones keep a blank summary, those in the cache take it, the others of a batch are asked for in one call, in order.

    The cache holds the sections of articles with an even id.
    """
    rows = compiled(named(spark, sf), "m1").drop("text")
    cache = rows.where("article_id % 2 = 0 AND h IS NOT NULL").select("h", F.lit(True).alias("hit")).distinct()
    rows = rows.join(cache, "h", "left").withColumn("state", F.when(F.col("h").isNull(), "blank").when(F.col("hit"), "hit").otherwise("pending"))
    asked = F.row_number().over(Window.partitionBy("article_id", "batch", "state").orderBy("start_chunk"))
    return rows.select("article_id", "batch", "section", "start_chunk", "h", "state", F.when(F.col("state") == "pending", asked).alias("asked"))
