"""The entities of a document service, laid over the source tables.

Each view is given once as Spark columns and once as SQL, so both sides read the same rows. Times are
seconds of an epoch; NOW is the fixed present of all queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = 100_000
STATUS = ("pending", "processing", "done", "failed")
OCR_STATUS = ("pending", "processing", "ocr_done", "edited", "failed", "skipped_has_text", "cancelled")


def _pick(values: tuple[str, ...], expr: str) -> str:
    return "CASE " + " ".join(f"WHEN ({expr}) % {len(values)} = {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


#: Plain expressions that mean the same in both dialects.
ARTICLE = {
    "id": "doc_id",
    "user_id": "doc_id % 5",
    "category_id": "doc_id % 30",
    "name": "concat(source, '-', lang, '-', doc_id)",
    "url": "CASE WHEN doc_id % 3 = 0 THEN concat('http://site/', doc_id % 50, '/doc') END",
    "storage_key": "CASE WHEN doc_id % 3 <> 0 THEN concat('up/', doc_id, '.', lang) END",
    "doc_type": "CASE WHEN doc_id % 6 = 0 THEN '' ELSE lang END",
    "extract_status": _pick(STATUS, "doc_id"),
    "index_status": _pick(STATUS, "doc_id * 7 + 3"),
    "compile_status": _pick(STATUS, "doc_id * 5 + 2"),
    "attempts": "doc_id % 12",
    "next_retry_at": "doc_id * 131 % 120000",
    "index_done_chunks": "doc_id % 9",
    "deleted_at": "CASE WHEN doc_id % 11 = 0 THEN 99000 + doc_id % 900 END",
    "created_at": "doc_id * 37 % 100000",
    "updated_at": "doc_id * 53 % 100000",
    "n_chars": "n_chars",
}
CATEGORY = {"id": "n_nationkey", "user_id": "n_nationkey % 5", "name": "n_name", "parent_id": "n_regionkey", "deleted_at": "CASE WHEN n_nationkey % 9 = 4 THEN 99500 END", "created_at": "n_nationkey * 11 % 70"}
POINT = {"point_id": "vec_id", "article_id": "vec_id % 50", "user_id": "vec_id % 5", "category_id": "label", "chunk_index": "vec_id % 10", "embedding": "embedding"}
USAGE = {"event_id": "event_id", "user_id": "user_id", "day": "substr(CAST(ts AS STRING), 1, 10)", "site": "event_type", "provider": "concat('p', user_id % 3)", "model": "concat('m', user_id % 2)", "calls": "1", "tokens": "CASE WHEN event_id % 7 = 0 THEN 0 ELSE event_id % 900 END"}
JOB = {"id": "o_orderkey", "user_id": "o_custkey % 5", "status": "CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'processing' ELSE 'done' END", "deleted_at": "CASE WHEN o_orderkey % 13 = 0 THEN 1 END", "expires_at": "o_orderkey * 17 % 200000"}
JOB_PAGE = {"job_id": "l_orderkey", "page_num": "l_linenumber", "status": _pick(OCR_STATUS, "l_partkey + l_linenumber"), "attempts": "l_suppkey % 11", "next_retry_at": "l_partkey * 29 % 120000"}
MESSAGE = {"conversation_id": "conv_id", "id": "conv_id * 100 + turn", "user_id": "conv_id % 5", "turn": "turn", "role": "role", "content": "text"}
TOKEN = {"token_hash": "c_custkey", "user_id": "c_custkey % 40", "family_id": "c_custkey % 300", "expires_at": "c_custkey * 97 % 200000", "family_expires_at": "c_custkey * 41 % 250000", "rotated_at": "CASE WHEN c_custkey % 4 = 1 THEN 5 END", "revoked_at": "CASE WHEN c_custkey % 7 = 2 THEN 90000 + c_custkey % 9000 END"}
HEARTBEAT = {"worker_id": "s_suppkey % 12", "last_seen_at": "99900 + s_suppkey * 7 % 110"}

_SOURCES = {
    "articles": ("documents", ARTICLE),
    "categories": ("nation", CATEGORY),
    "points": ("embeddings", POINT),
    "usage": ("events", USAGE),
    "jobs": ("orders", JOB),
    "job_pages": ("lineitem", JOB_PAGE),
    "messages": ("conversations", MESSAGE),
    "tokens": ("customer", TOKEN),
    "heartbeats": ("supplier", HEARTBEAT),
}


def _cte(name: str) -> str:
    source, columns = _SOURCES[name]
    return f"{name} AS (SELECT " + ", ".join(f"{x.replace('AS STRING', 'AS VARCHAR')} AS {c}" for c, x in columns.items()) + f" FROM {source})"


#: What stands before and after every twelfth line of a document, by the sum of its number and the document's: a legal text's headings and references.
_LAW = {
    0: "'PHẦN ', {n}, '\n', {t}",
    1: "'Điều ', {n}, '. ', {short}, '\n', {t}",
    3: "'> CHƯƠNG ', {roman}, ': Quyền và nghĩa vụ\nĐiều ', {n}, '. Phạm vi 1. ', {t}",
    4: "{t}, ' theo ĐIỀU 4, khoản 2 và Điều 5. Hết'",
    5: "'\tMục ', {n}, ' - Quy định\n', {t}",
    7: "{t}, ' ĐIỀU ', {n}, ': ', {short}",
    8: "'Bài ', {n}, ') ', {t}",
    10: "'chương: II không phải mục\n', {t}, '\nĐiều ', {n}, ' cuối'",
}


def _law(text: str, as_text: str, left: str) -> str:
    """The text of a line of law_chunks, in the dialect of the given forms."""
    roman = f"CASE chunk_index % 5 WHEN 0 THEN 'I' WHEN 1 THEN 'II' WHEN 2 THEN 'IX' WHEN 3 THEN 'XL' ELSE 'CD' END"
    names = {"t": text, "n": as_text.format("chunk_index + 1"), "short": left.format(text, 30), "roman": roman}
    return "CASE (article_id + chunk_index) % 12 " + " ".join(f"WHEN {k} THEN concat({v.format(**names)})" for k, v in _LAW.items()) + f" ELSE {text} END"


CTES = (
    ", ".join(_cte(n) for n in _SOURCES)
    + f""",
article_pages AS (SELECT doc_id AS article_id, generate_subscripts(p, 1) AS seq, unnest(p) AS text FROM (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS p FROM documents)),
chunks AS (SELECT doc_id AS article_id, generate_subscripts(p, 1) - 1 AS chunk_index, unnest(p) AS text, source FROM (SELECT doc_id, source, string_split(text, chr(10)) AS p FROM documents)),
law_chunks AS (SELECT article_id, chunk_index, {_law('text', 'CAST({} AS VARCHAR)', 'left({}, {})')} AS text FROM chunks),
edges AS (SELECT r_regionkey AS id, CAST(NULL AS BIGINT) AS parent_id FROM region UNION ALL SELECT 100 + n_nationkey, n_regionkey FROM nation UNION ALL SELECT 1000 + c_custkey, 100 + c_nationkey FROM customer),
closure AS (SELECT CAST(id AS BIGINT) AS ancestor_id, CAST(id AS BIGINT) AS descendant_id, 0 AS depth FROM edges UNION ALL
  SELECT CAST(parent_id AS BIGINT), CAST(id AS BIGINT), 1 FROM edges WHERE parent_id IS NOT NULL UNION ALL
  SELECT CAST(p.parent_id AS BIGINT), CAST(e.id AS BIGINT), 2 FROM edges e JOIN edges p ON e.parent_id = p.id WHERE p.parent_id IS NOT NULL)"""
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, columns = _SOURCES[name]
    return table(spark, sf_dir, source).selectExpr(*[f"{x} AS {c}" for c, x in columns.items()])


def article_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of articles, numbered from 1: the parts between blank lines."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("article_id"), F.posexplode(F.split("text", "\n\n")).alias("p", "text")).select("article_id", (F.col("p") + 1).alias("seq"), "text")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of articles, numbered from 0: their lines."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("article_id"), F.posexplode(F.split("text", "\n")).alias("chunk_index", "text"), "source")


def law_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of articles as those of legal texts: with headings at line starts and inside lines, and with references that are none."""
    return chunks(spark, sf_dir).selectExpr("article_id", "chunk_index", f"{_law('text', 'CAST({} AS STRING)', 'left({}, {})')} AS text")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folder tree as (id, parent_id): regions, nations, customers."""
    get = lambda t, *c: table(spark, sf_dir, t).selectExpr(*c)
    roots = get("region", "CAST(r_regionkey AS BIGINT) AS id", "CAST(NULL AS BIGINT) AS parent_id")
    inner = get("nation", "CAST(100 + n_nationkey AS BIGINT) AS id", "CAST(n_regionkey AS BIGINT) AS parent_id")
    return roots.union(inner).union(get("customer", "CAST(1000 + c_custkey AS BIGINT) AS id", "CAST(100 + c_nationkey AS BIGINT) AS parent_id"))
