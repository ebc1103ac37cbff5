"""Scalar functions on text: cleaning, comparison, names, identifiers, snippets and routing. All are native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.filters import alive
from lodestone.registry import query
from lodestone.views import article_pages, chunks, table, view

BLANK = " \t\r\f\v"


def clean_lines(text: Column) -> Column:
    """Trimmed lines without the blank ones."""
    return F.array_join(F.filter(F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANK))), lambda x: x != ""), "\n")


_TRIM = "trim({x}, ' ' || chr(9) || chr(13) || chr(12) || chr(11))"


@query("SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: " + _TRIM.format(x="x") + "), lambda x: x <> ''), chr(10)) AS text FROM documents")
def page_text_clean(spark, sf):
    return table(spark, sf, "documents").select("doc_id", clean_lines(F.col("text")).alias("text"))


@query("SELECT article_id, chunk_index, CASE WHEN length(trim(text)) > 80 OR NOT regexp_matches(k, '[a-zà-ỹ]') THEN '' ELSE k END AS key FROM (SELECT *, regexp_replace(regexp_replace(lower(trim(text)), '[0-9]+', '#', 'g'), '[ \t]', '', 'g') AS k FROM chunks)")
def repeat_key(spark, sf):
    from lodestone.operators.aggregates import repeat_key as key

    return chunks(spark, sf).select("article_id", "chunk_index", key(F.col("text")).alias("key"))


BLANKS = " \t\n\v\f\r"


def words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[\\p{L}\\p{M}0-9]+"), F.lit(0)))


def merged(layer: Column, ocr: Column, enough: float = 0.7) -> Column:
    """The text layer alone if it holds enough of the distinct OCR words, else both; a blank side gives the other. Both are trimmed; words are letters, marks and digits."""
    layer, ocr = F.btrim(layer, F.lit(BLANKS)), F.btrim(ocr, F.lit(BLANKS))
    seen = words(ocr)
    covered = (F.size(seen) == 0) | (F.size(F.array_intersect(seen, words(layer))) >= enough * F.size(seen))
    return F.when(ocr == "", layer).when(layer == "", ocr).when(covered, layer).otherwise(F.concat(layer, F.lit("\n"), ocr))


_NEXT = "(SELECT a.doc_id, a.text AS x, b.text AS y FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1)"


def pairs(spark, sf):
    """Each document's text beside that of the next."""
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("x"))
    return docs.join(docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("x").alias("y")), "doc_id")


def beside(rows: DataFrame, *columns: str) -> DataFrame:
    """doc_id, and columns x<name> of each row and y<name> of the next, from one pass: each row goes to its own id and to the one before; doc_id is a key."""
    ends = F.explode(F.array(F.struct(F.col("doc_id").alias("at"), F.lit("x").alias("side")), F.struct((F.col("doc_id") - 1).alias("at"), F.lit("y").alias("side"))))
    dealt = rows.select(ends.alias("to"), *columns)
    both = [F.any_value(F.when(F.col("to.side") == side, F.col(c)), F.lit(True)).alias(side + c) for side in "xy" for c in columns]
    return dealt.groupBy(F.col("to.at").alias("doc_id")).agg(F.min("to.side").alias("_first"), F.max("to.side").alias("_last"), *both).where("_first = 'x' AND _last = 'y'").drop("_first", "_last")


@query(f"""SELECT doc_id, md5(CASE WHEN y = '' THEN x WHEN x = '' THEN y WHEN len(w) = 0 OR len(list_intersect(w, v)) >= 0.7 * len(w) THEN x ELSE x || chr(10) || y END) AS merged
 FROM (SELECT doc_id, x, y, list_distinct(regexp_extract_all(lower(y), '[\\p{{L}}\\p{{M}}0-9]+')) AS w, list_distinct(regexp_extract_all(lower(x), '[\\p{{L}}\\p{{M}}0-9]+')) AS v FROM (SELECT doc_id, trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS x, trim(y, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS y FROM {_NEXT}))""")
def merge_ocr(spark, sf):
    return pairs(spark, sf).select("doc_id", F.md5(F.encode(merged(F.col("x"), F.col("y")), "UTF-8")).alias("merged"))


NUMBER = "[0-9]+([.,][0-9]+)*"


def canonical_number(x: Column) -> Column:
    """Digits with separators in one spelling: groups of three are thousands, a last odd group a fraction."""
    plain = F.regexp_replace(x, "[.,]", "")
    seps = F.char_length(x) - F.char_length(plain)
    last = F.regexp_extract(x, "[.,]([0-9]+)$", 1)
    head = F.regexp_replace(F.regexp_replace(x, "[.,][0-9]+$", ""), "[.,]", "")
    decimal = F.concat(head, F.lit("."), last)
    return F.when(seps == 0, x).when(seps >= 2, F.when(F.regexp_like(x, F.lit("^[0-9]+([.,][0-9]{3})+$")), plain).otherwise(decimal)).when(F.regexp_like(x, F.lit("^[0-9]{1,3}[.,][0-9]{3}$")), plain).otherwise(decimal)


_CANON = """CASE WHEN regexp_replace({x}, '[.,]', '', 'g') = {x} THEN {x} WHEN regexp_full_match({x}, '[0-9]+([.,][0-9]{{3}}){{2,}}') OR regexp_full_match({x}, '[0-9]{{1,3}}[.,][0-9]{{3}}') THEN regexp_replace({x}, '[.,]', '', 'g')
 ELSE regexp_replace(regexp_replace({x}, '[.,][0-9]+$', ''), '[.,]', '', 'g') || '.' || regexp_extract({x}, '[.,]([0-9]+)$', 1) END"""


@query(", n AS (SELECT DISTINCT unnest(['7', '1.000.000', '1,5', '1.234', '1234.567', '1.234,56', '12.34.56', '0,05'] || regexp_extract_all(p_name || ' ' || CAST(p_retailprice AS VARCHAR), '[0-9]+([.,][0-9]+)*')) AS x FROM part) SELECT x AS raw, " + _CANON.format(x="x") + " AS number FROM n", name="canonical_number")
def _canonical_number(spark, sf):
    raw = F.regexp_extract_all(F.concat_ws(" ", "p_name", F.col("p_retailprice").cast("string")), F.lit(NUMBER), F.lit(0))
    fixed = F.array(*[F.lit(x) for x in ("7", "1.000.000", "1,5", "1.234", "1234.567", "1.234,56", "12.34.56", "0,05")])
    return table(spark, sf, "part").select(F.explode(F.concat(fixed, raw)).alias("raw")).distinct().select("raw", canonical_number(F.col("raw")).alias("number"))


def compare_parts(text: Column) -> tuple[Column, Column]:
    """Canonical numbers and lower-case words ('%' is one) of a text in NFC."""
    nums = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), canonical_number))
    return nums, F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[\\p{L}\\p{M}]+|%"), F.lit(0)))


_WORDS = "list_distinct(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{M}}]+|%'))"
_NUMS = "list_distinct(list_transform(regexp_extract_all({x}, '[0-9]+([.,][0-9]+)*'), lambda v: " + _CANON.format(x="v").replace("{", "{{").replace("}", "}}") + "))"


@query("SELECT item_id, list_sort(" + _NUMS.format(x="text") + ") AS numbers, list_sort(" + _WORDS.format(x="text") + ") AS words FROM benchmark")
def compare_tokens(spark, sf):
    nums, found = compare_parts(F.col("text"))
    return table(spark, sf, "benchmark").select("item_id", F.array_sort(nums).alias("numbers"), F.array_sort(found).alias("words"))


@query(f""", p AS (SELECT doc_id, {_NUMS.format(x='x')} AS xn, {_NUMS.format(x='y')} AS yn, {_WORDS.format(x='x')} AS xw, {_WORDS.format(x='y')} AS yw FROM {_NEXT}),
 s AS (SELECT *, CASE WHEN len(xw) + len(yw) = 0 THEN 1.0::DOUBLE ELSE round(len(list_intersect(xw, yw)) / len(list_distinct(list_concat(xw, yw))), 6) END AS score FROM p)
 SELECT doc_id, score, CASE WHEN list_sort(xn) <> list_sort(yn) THEN 'conflict' WHEN score >= 0.9 THEN 'agree' WHEN score >= 0.7 THEN 'minor' ELSE 'conflict' END AS verdict FROM s""")
def cross_check(spark, sf):
    """Whether two readings of a page agree: numbers must be the same, words nearly."""
    nums, found = compare_parts(F.col("text"))
    parts = beside(table(spark, sf, "documents").select("doc_id", nums.alias("n"), found.alias("w")), "n", "w")
    both = F.size(F.array_union("xw", "yw"))
    score = F.when(both == 0, 1.0).otherwise(F.round(F.size(F.array_intersect("xw", "yw")) / both, 6))
    differ = F.array_sort("xn") != F.array_sort("yn")
    return parts.select("doc_id", "xn", "yn", score.alias("score")).select("doc_id", "score", F.when(differ, "conflict").when(F.col("score") >= 0.9, "agree").when(F.col("score") >= 0.7, "minor").otherwise("conflict").alias("verdict"))


VERSION = r"(?i)(?:version|phiên bản)[ \t]*[:.]?[ \t]*([0-9][0-9A-Za-z._-]*)"
EFFECTIVE = r"(?i)(?:effective|hiệu lực)[^0-9\n]{0,40}([0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{4})"
#: Heads of documents, with versions and dates written into every few of them.
_META = """CASE doc_id % 5 WHEN 0 THEN concat('Handbook version: ', doc_id % 90, '.', n_chars % 7, ', effective from ', 1 + doc_id % 28, '/', 1 + doc_id % 12, '/2024. ', text) WHEN 1 THEN concat('Version - none ', text)
 WHEN 2 THEN concat(left(text, 90), ' phiên bản ', doc_id, '-b hiệu lực từ ngày ', 1 + doc_id % 9, '-6-2023 ', text) WHEN 3 THEN concat(text, ' version 9') ELSE text END"""


@query(f"SELECT doc_id, regexp_extract(substr(t, 1, 3000), '{VERSION}', 1) AS version, regexp_extract(substr(t, 1, 3000), '{EFFECTIVE}', 1) AS effective FROM (SELECT doc_id, {_META} AS t FROM documents)")
def extract_meta(spark, sf):
    """Version and effective date in the head of a text, as written."""
    head = F.left(F.col("t"), F.lit(3000))
    return table(spark, sf, "documents").selectExpr("doc_id", f"{_META} AS t").select("doc_id", F.regexp_extract(head, VERSION, 1).alias("version"), F.regexp_extract(head, EFFECTIVE, 1).alias("effective"))


@query("""SELECT page_id, CASE WHEN contains(lower(url), 'pdf') AND contains(lower(url), '/en/') THEN 'laws' WHEN contains(lower(url), 'csv') OR ends_with(lower(url), '5') THEN 'table' WHEN contains(lower(url), '/de/') THEN 'paper' ELSE 'general' END AS doc_type FROM pages""")
def detect_doc_type(spark, sf):
    """Document type by content type and name; the url stands for both."""
    u = F.lower("url")
    return table(spark, sf, "pages").select("page_id", F.when(F.contains(u, F.lit("pdf")) & F.contains(u, F.lit("/en/")), "laws").when(F.contains(u, F.lit("csv")) | F.endswith(u, F.lit("5")), "table").when(F.contains(u, F.lit("/de/")), "paper").otherwise("general").alias("doc_type"))


TYPES = ("general", "laws", "table", "paper", "book", "qa", "manual")


@query(f"SELECT id, CASE WHEN lower(trim(doc_type)) IN {TYPES + ('en', 'de')} THEN lower(trim(doc_type)) ELSE 'general' END AS doc_type FROM articles")
def normalize_type(spark, sf):
    t = F.lower(F.trim("doc_type"))
    return view(spark, sf, "articles").select("id", F.when(t.isin(*TYPES, "en", "de"), t).otherwise("general").alias("doc_type"))


OID = "6ba7b8129dad11d180b400c04fd430c8"


def point_id(article: Column, chunk: Column) -> Column:
    """The name-based UUID (version 5, OID name space) of a chunk."""
    name = F.concat(F.lit("article:"), article.cast("string"), F.lit(":chunk:"), chunk.cast("string"))
    h = F.sha1(F.concat(F.unhex(F.lit(OID)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


@query(f"""SELECT article_id, chunk_index, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', CAST(('0x' || substr(h, 17, 1)) AS INT) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id
 FROM (SELECT article_id, chunk_index, sha1(unhex('{OID}') || encode('article:' || article_id || ':chunk:' || chunk_index)) AS h FROM chunks)""", name="point_id")
def _point_id(spark, sf):
    return chunks(spark, sf).select("article_id", "chunk_index", point_id(F.col("article_id"), F.col("chunk_index")).alias("point_id"))


@query("SELECT doc_id, sha256('m1|' || text) AS h FROM documents")
def content_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(F.concat_ws("|", F.lit("m1"), "text"), 256).alias("h"))


def file_ext(name: Column) -> Column:
    """Lower-case extension with its dot: none for names that begin or end with the last dot, or long ones."""
    ext = F.lower(F.regexp_extract(name, r"^.+(\.[^.]+)$", 1))
    return F.when(F.octet_length(ext) <= 11, ext).otherwise("")


#: File names of documents, and the first bytes that their uploads begin with.
_NAME = "CASE doc_id % 11 WHEN 0 THEN concat('.', source) WHEN 1 THEN concat(source, doc_id) WHEN 2 THEN concat(doc_id, '.tar.gz') WHEN 3 THEN concat(lang, '.') WHEN 4 THEN concat(source, '.averyverylongextension') WHEN 5 THEN concat('é ', doc_id, '.docx') WHEN 6 THEN concat(doc_id, '.PDF') WHEN 7 THEN concat(doc_id, '.md') WHEN 8 THEN concat(doc_id, '.JSON') WHEN 9 THEN concat(doc_id, '.png') ELSE concat(doc_id, '.exe') END"
_HEAD = "CASE doc_id % 4 WHEN 0 THEN concat('%PDF-1.', doc_id % 8) WHEN 1 THEN concat('PK', chr(3), chr(4), lang) ELSE left(text, 40) END"
_EXT = "CASE WHEN strlen(lower(regexp_extract(name, '^.+(\\.[^.]+)$', 1))) <= 11 THEN lower(regexp_extract(name, '^.+(\\.[^.]+)$', 1)) ELSE '' END"


@query(f"SELECT doc_id, name, {_EXT} AS ext FROM (SELECT doc_id, {_NAME} AS name FROM documents)", name="file_ext")
def _file_ext(spark, sf):
    return table(spark, sf, "documents").selectExpr("doc_id", f"{_NAME} AS name").select("doc_id", "name", file_ext(F.col("name")).alias("ext"))


@query("SELECT page_id, regexp_replace(url, '[^A-Za-z0-9._-]', '_', 'g') AS name FROM pages")
def sanitize_name(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.regexp_replace("url", "[^A-Za-z0-9._-]", "_").alias("name"))


@query("SELECT id, trim(regexp_replace(content || ' [^1] x[^22]', '\\[\\^[0-9]+\\]', '', 'g')) AS content FROM messages")
def strip_citations(spark, sf):
    return view(spark, sf, "messages").select("id", F.trim(F.regexp_replace(F.concat("content", F.lit(" [^1] x[^22]")), r"\[\^[0-9]+\]", "")).alias("content"))


def snippet(text: Column, most: int = 200) -> Column:
    return F.when(F.char_length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("…"))).otherwise(text)


@query("SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '…' ELSE text END AS snippet FROM documents", name="snippet")
def _snippet(spark, sf):
    return table(spark, sf, "documents").select("doc_id", snippet(F.col("text")).alias("snippet"))


QUESTIONS = ("lookup", "summary", "compare", "reasoning", "procedure", "scenario", "chitchat", "calculation")
_ASKED = "CASE id % 7 WHEN 0 THEN concat(' ', 'Summary') WHEN 1 THEN concat(content, ' it is a COMPARE of two') WHEN 2 THEN concat('lookup then summary ', content) WHEN 3 THEN '' WHEN 4 THEN 'CHITCHAT ' WHEN 5 THEN concat('calculation by procedure ', role) ELSE content END"


@query("SELECT id, CASE " + " ".join(f"WHEN lower(trim(a)) = '{q}' THEN '{q}'" for q in QUESTIONS) + " " + " ".join(f"WHEN contains(lower(a), '{q}') THEN '{q}'" for q in QUESTIONS) + f" ELSE 'lookup' END AS kind FROM (SELECT id, {_ASKED} AS a FROM messages)")
def parse_question_type(spark, sf):
    """The kind named exactly, else the first one mentioned, else lookup."""
    low = F.lower(F.trim("a"))
    mentioned = F.get(F.filter(F.array(*[F.lit(q) for q in QUESTIONS]), lambda q: F.contains(low, q)), F.lit(0))
    return view(spark, sf, "messages").selectExpr("id", f"{_ASKED} AS a").select("id", F.when(low.isin(*QUESTIONS), low).otherwise(F.coalesce(mentioned, F.lit("lookup"))).alias("kind"))


@query("SELECT event_id, CASE WHEN event_type IN ('purchase', 'view') THEN 10 WHEN event_type IN ('click') THEN 8 ELSE 5 END AS lim FROM events WHERE event_type <> 'logout'")
def route_limit(spark, sf):
    """Hits to fetch for each kind of question; kinds that need none are skipped. Event types stand for kinds."""
    return table(spark, sf, "events").where("event_type <> 'logout'").select("event_id", F.when(F.col("event_type").isin("purchase", "view"), 10).when(F.col("event_type") == "click", 8).otherwise(5).alias("lim"))


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN l_suppkey % 7 = 0 THEN 0 ELSE l_partkey / (l_suppkey % 7 * 100.0) END, 9) AS x FROM lineitem")
def norm_box(spark, sf):
    """A position relative to its page; 0 for pages without a size."""
    size = F.col("l_suppkey") % 7 * 100.0
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.when(size > 0, F.col("l_partkey") / size).otherwise(0.0), 9).alias("x"))


_FLEX = "CASE l_partkey % 7 WHEN 0 THEN concat(l_partkey, '.9') WHEN 1 THEN concat('-', l_suppkey, '.5') WHEN 2 THEN concat(l_suppkey % 9, 'e2') WHEN 3 THEN concat('00', l_partkey) WHEN 4 THEN '' WHEN 5 THEN concat(l_returnflag, l_partkey) ELSE concat(l_partkey, '') END"


@query(f"SELECT raw, coalesce(CAST(trunc(TRY_CAST(raw AS DOUBLE)) AS BIGINT), 0) AS value FROM (SELECT DISTINCT {_FLEX} AS raw FROM lineitem)")
def flex_int(spark, sf):
    """Whole numbers from what stands for one, cut towards zero; 0 for anything else."""
    number = F.col("raw").try_cast("double")
    rows = table(spark, sf, "lineitem").selectExpr(f"{_FLEX} AS raw").distinct()
    return rows.select("raw", F.coalesce(F.when(number < 0, F.ceil(number)).otherwise(F.floor(number)), F.lit(0)).cast("long").alias("value"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_id_list(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))


def backoff(attempts: Column) -> Column:
    """Minutes until the next try: doubled each time, 30 at most."""
    return F.least(F.pow(F.lit(2.0), F.greatest(attempts - 1, F.lit(0))), F.lit(30.0)).cast("long")


@query("SELECT id, CAST(least(pow(2, greatest(attempts - 1, 0)), 30) AS BIGINT) AS minutes, attempts >= 10 AS failed FROM articles", name="backoff")
def _backoff(spark, sf):
    return view(spark, sf, "articles").select("id", backoff(F.col("attempts")).alias("minutes"), (F.col("attempts") >= 10).alias("failed"))


@query("SELECT doc_id, strlen(text) AS bytes FROM documents")
def strip_nul(spark, sf):
    """Byte length without NUL characters."""
    return table(spark, sf, "documents").select("doc_id", F.octet_length(F.replace("text", F.lit("\0"), F.lit(""))).cast("long").alias("bytes"))


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice / 7, 6) AS x FROM lineitem")
def round6(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") / 7, 6).alias("x"))


ALLOWED = (".pdf", ".docx", ".xlsx", ".csv", ".txt", ".md", ".html", ".json", ".png", ".jpg", ".jpeg", ".pptx")


MAX_FILE = 500 << 20
#: What the content of a file must look like, by its extension; text is all that nothing else is recognised in.
CONTENT = {"pdf": (".pdf",), "zip": (".docx", ".xlsx", ".pptx"), "png": (".png",), "jpeg": (".jpg", ".jpeg"), "text": (".csv", ".txt", ".md", ".html", ".json")}
MAGIC = {"pdf": "%PDF-", "zip": "PK\x03\x04", "png": "\x89PNG", "jpeg": "\xff\xd8\xff"}


def sniffed(head: Column) -> Column:
    """What the first bytes of a file, as Latin-1 text, show it to be."""
    out = F.lit("text")
    for kind, magic in MAGIC.items():
        out = F.when(F.startswith(head, F.lit(magic)), kind).otherwise(out)
    return out


def refused(name: Column, head: Column, size: Column) -> Column:
    """Why an upload is refused, '' if it isn't: empty, too large, a type that is not taken, or content of another type."""
    ext = file_ext(name)
    fits = F.lit(False)
    for kind, extensions in CONTENT.items():
        fits = fits | (ext.isin(*extensions) & (sniffed(head) == kind))
    return F.when((size <= 0) | (head == ""), "empty").when(size > MAX_FILE, "too large").when(~ext.isin(*ALLOWED), "type").when(~fits, "content").otherwise("")


_BYTES = "CASE WHEN doc_id % 23 = 0 THEN 0 WHEN doc_id % 29 = 0 THEN 600000000 ELSE n_chars END"
_FITS = " OR ".join(f"(ext IN ({', '.join(repr(e) for e in x)}) AND kind = '{k}')" for k, x in CONTENT.items())


@query(f"""SELECT doc_id, name, CASE WHEN size <= 0 OR head = '' THEN 'empty' WHEN size > {MAX_FILE} THEN 'too large' WHEN ext NOT IN {ALLOWED} THEN 'type' WHEN NOT ({_FITS}) THEN 'content' ELSE '' END AS refused
FROM (SELECT *, {_EXT} AS ext, CASE WHEN starts_with(head, '%PDF-') THEN 'pdf' WHEN starts_with(head, 'PK' || chr(3) || chr(4)) THEN 'zip' ELSE 'text' END AS kind FROM (SELECT doc_id, {_NAME} AS name, {_HEAD} AS head, {_BYTES} AS size FROM documents))""")
def upload_guard(spark, sf):
    """Uploads of documents under many names: by extension, by what their first bytes show, and by size."""
    rows = table(spark, sf, "documents").selectExpr("doc_id", f"{_NAME} AS name", f"{_HEAD} AS head", f"{_BYTES} AS size")
    return rows.select("doc_id", "name", refused(F.col("name"), F.col("head"), F.col("size")).alias("refused"))


@query("SELECT page_id, substr(regexp_replace(url, '[?#].*$', ''), 1, 60) AS url FROM pages")
def hide_url_query(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.left(F.regexp_replace("url", "[?#].*$", ""), F.lit(60)).alias("url"))


_URL = "concat(url, CASE page_id % 5 WHEN 0 THEN '/v1/chat/completions?x=1' WHEN 1 THEN '//' WHEN 2 THEN '/v2/embeddings/' WHEN 3 THEN '/api#f' ELSE '/chat/completions/x' END)"


@query(f"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(raw, '[?#].*$', ''), '/+$', ''), '/(chat/completions|embeddings)$', '') AS base FROM (SELECT page_id, {_URL} AS raw FROM pages)")
def normalize_base_url(spark, sf):
    base = F.regexp_replace(F.regexp_replace(F.regexp_replace("raw", "[?#].*$", ""), "/+$", ""), "/(chat/completions|embeddings)$", "")
    return table(spark, sf, "pages").selectExpr("page_id", f"{_URL} AS raw").select("page_id", base.alias("base"))


@query("SELECT article_id, substr(string_agg(text, chr(10) || chr(10) ORDER BY seq) FILTER (trim(text) <> ''), 1, 500) AS text FROM article_pages GROUP BY 1")
def attachment_text(spark, sf):
    """The pages of an article joined, cut at 500 characters as the attachment shows them."""
    filled = article_pages(spark, sf)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.btrim("text") != "", F.struct("seq", "text")))), lambda x: x["text"]), "\n\n")
    return filled.groupBy("article_id").agg(F.nullif(F.left(joined, F.lit(500)), F.lit("")).alias("text"))


@query("SELECT id, replace('Owner {user}: ' || name, '{user}', CAST(user_id AS VARCHAR)) || CASE WHEN deleted_at IS NULL THEN '' ELSE ' (gone)' END AS prompt FROM articles")
def prompt_render(spark, sf):
    text = F.replace(F.concat(F.lit("Owner {user}: "), "name"), F.lit("{user}"), F.col("user_id").cast("string"))
    return view(spark, sf, "articles").select("id", F.concat(text, F.when(F.col("deleted_at").isNull(), "").otherwise(" (gone)")).alias("prompt"))


GAP = r"^[ \t]*[^ \t].*(\t|  )"


@query(f"SELECT article_id, chunk_index, regexp_matches(text, '{GAP}') AS gap FROM chunks")
def column_gap(spark, sf):
    return chunks(spark, sf).select("article_id", "chunk_index", F.regexp_like("text", F.lit(GAP)).alias("gap"))


@query("SELECT article_id, chunk_index, regexp_matches(text, '^[-_=|+ \t]*$') AND length(regexp_replace(text, '[ \t]', '', 'g')) >= 3 AS rule FROM chunks")
def rule_line(spark, sf):
    return chunks(spark, sf).select("article_id", "chunk_index", (F.regexp_like("text", F.lit("^[-_=|+ \t]*$")) & (F.char_length(F.regexp_replace("text", "[ \t]", "")) >= 3)).alias("rule"))


@query("SELECT article_id, chunk_index, len(list_filter(regexp_split_to_array(text, '[ \t]+'), lambda t: regexp_matches(t, '^[(\\[]*[0-9][0-9.,/-]*%?[)\\].,;:]*$'))) AS n FROM chunks")
def numeric_tokens(spark, sf):
    return chunks(spark, sf).select("article_id", "chunk_index", F.size(F.filter(F.split("text", "[ \t]+"), lambda t: F.regexp_like(t, F.lit(r"^[(\[]*[0-9][0-9.,/-]*%?[)\].,;:]*$")))).cast("long").alias("n"))


@query("SELECT conversation_id, id, CASE WHEN role = 'user' THEN 1 ELSE 0 END AS scope, coalesce(nullif(trim(CASE WHEN id % 3 = 0 THEN ' ' ELSE 'p' || id % 2 END), ''), 'default') AS provider FROM messages")
def plan_session(spark, sf):
    """A request's non-blank settings override the session's."""
    asked = F.when(F.col("id") % 3 == 0, " ").otherwise(F.concat(F.lit("p"), (F.col("id") % 2).cast("string")))
    return view(spark, sf, "messages").select("conversation_id", "id", F.when(F.col("role") == "user", 1).otherwise(0).alias("scope"), F.coalesce(F.nullif(F.trim(asked), F.lit("")), F.lit("default")).alias("provider"))


def ordered_fields(fields: Column) -> Column:
    """Log fields (array of struct key, value) as key=value: the trace id, then ids, then others, the error last; within these by key."""
    key = lambda x: x["key"]
    place = lambda x: F.when(key(x) == "trace_id", 0).when((key(x) == "id") | F.endswith(key(x), F.lit("_id")), 1).when(key(x) == "error", 3).otherwise(2)
    return F.transform(F.array_sort(F.transform(fields, lambda x: F.struct(place(x).alias("place"), key(x).alias("key"), x["value"].alias("value")))), lambda x: F.concat(x["key"], F.lit("="), x["value"]))


@query("SELECT id, ['trace_id=t' || id % 7, 'category_id=' || category_id, 'id=' || id, 'user_id=' || user_id, 'name=' || name, 'stage=' || extract_status, 'error=' || (attempts > 5)] AS fields FROM articles WHERE deleted_at IS NULL")
def field_order(spark, sf):
    """Fields of a log line in the order in which they are written."""
    values = {"error": F.col("attempts") > 5, "name": F.col("name"), "user_id": F.col("user_id"), "stage": F.col("extract_status"), "id": F.col("id"), "trace_id": F.concat(F.lit("t"), F.col("id") % 7), "category_id": F.col("category_id")}
    fields = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in values.items()])
    return alive(view(spark, sf, "articles")).select("id", ordered_fields(fields).alias("fields"))
