"""Functions on Vietnamese text, citations and answers: native where a pattern does it, small Arrow UDFs elsewhere."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType, StringType

from lodestone.registry import query
from lodestone.views import chunks, table, view

def is_spaced(line: Column) -> Column:
    """Ten tokens of one letter, or four that are half of all."""
    tokens = F.filter(F.split(line, "[ \t]+"), lambda t: t != "")
    ones = F.size(F.filter(tokens, lambda t: F.char_length(t) == 1))
    return (ones >= 10) | ((ones >= 4) & (ones * 2 >= F.size(tokens)))


def despaced(line: Column, whole: Column | None = None) -> Column:
    """Single letters side by side are joined, on lines whose letters stand apart, or on all where the document's do (whole); others stay as they are."""
    apart = is_spaced(line) if whole is None else whole | is_spaced(line)
    return F.when(apart, F.regexp_replace(line, r"(?<=(?<![\p{L}\p{M}])[\p{L}\p{M}]) (?=[\p{L}\p{M}](?![\p{L}\p{M}]))", "")).otherwise(line)


def scattered(spark, sf):
    """Lines of documents, those of every third apart letter by letter, of every other third from a place on."""
    apart = F.regexp_replace("text", r"([\p{L}\p{M}])(?=[\p{L}\p{M}])", "$1 ")
    k = (F.col("article_id") + F.col("chunk_index")) % 3
    line = F.when(k == 0, apart).when(k == 1, F.concat(F.left("text", F.lit(60)), F.lit(" "), F.left(apart, F.lit(60)))).otherwise(F.col("text"))
    return chunks(spark, sf).select("article_id", "chunk_index", line.alias("line"))


@query()
def despace_line(spark, sf):
    """Each line by itself, and as a line of a document whose letters stand apart."""
    return scattered(spark, sf).select("article_id", "chunk_index", despaced(F.col("line")).alias("joined"), despaced(F.col("line"), F.lit(True)).alias("forced"))


#: Letters and onsets of Vietnamese: fixed values.
VOWELS = "aeiouyăâêôơưàáảãạằắẳẵặầấẩẫậèéẻẽẹềếểễệìíỉĩịòóỏõọồốổỗộờớởỡợùúủũụừứửữựỳýỷỹỵ"
TONED = "àáảãạằắẳẵặầấẩẫậèéẻẽẹềếểễệìíỉĩịòóỏõọồốổỗộờớởỡợùúủũụừứửữựỳýỷỹỵ"
ONSETS = "ngh|ch|gh|gi|kh|ng|nh|ph|qu|th|tr|[bcdđghklmnpqrstvx]"


def syllables(token: Column) -> Column:
    """A run-together token split before each onset between vowels, if it has a tone; digits count as vowels."""
    split = F.regexp_replace(token, f"(?i)(?<=[{VOWELS}0-9])(?=(?:{ONSETS})[{VOWELS}0-9])", " ")
    return F.when(F.regexp_like(token, F.lit(f"(?i)[{TONED}]")), split).otherwise(token)


#: Syllables that are run together by the numbers of a document and a line: fixed values.
SYLLABLES = ("thông", "quy", "định", "cơ", "sở", "hợp", "đồng", "banana", "nghiệp", "kha")


@query()
def split_syllables(spark, sf):
    """Tokens made of one to three syllables, by stored numbers."""
    pick = lambda x: F.get(F.array(*[F.lit(t) for t in SYLLABLES]), (x % len(SYLLABLES)).cast("int"))
    a, b = F.col("article_id"), F.col("chunk_index")
    token = F.concat(pick(a + b), F.when(b % 3 > 0, pick(a * 7 + b)).otherwise(""), F.when(b % 3 > 1, pick(a + b * 3)).otherwise(""))
    return chunks(spark, sf).select(token.alias("token")).distinct().select("token", syllables(F.col("token")).alias("split"))


#: A citation mark, what names an internal id, and what an emptied bracket may still hold: fixed values.
MARK = re.compile(r"\[\s*[*^]?\s*(\d{1,3})\s*\]")
ID_NAMES = ("article id", "bài viết id", "mã bài viết", "nguồn id", "source id")
EMPTIED = ("", "theo", "theo kết quả đọc:")


def found_name(text: str, at: int) -> int:
    """Where the id name ends that begins at a place, its words apart by any white space or _, or by none; -1 if none does."""
    for words in (name.split() for name in ID_NAMES):
        end = at
        for i, word in enumerate(words):
            while i and end < len(text) and (text[end].isspace() or text[end] == "_"):
                end += 1
            if text[end : end + len(word)].lower() != word:
                break
            end += len(word)
        else:
            return end
    return -1


def skip(text: str, at: int, step: int = 1) -> int:
    """The next place that holds no white space, forwards or backwards."""
    while 0 <= at < len(text) and text[at].isspace():
        at += step
    return at


def leaked(text: str) -> list[tuple[int, int]]:
    """Spans of internal ids: a name, a sign or none, and a number, with white space before and a bracket on either side."""
    out, at, firsts = [], 0, {name[0] for name in ID_NAMES}
    while at < len(text):
        end = found_name(text, at) if text[at].lower() in firsts else -1
        if end < 0:
            at += 1
            continue
        digits = skip(text, end)
        digits = skip(text, digits + 1) if text[digits : digits + 1] in tuple(":=#") else digits
        stop = digits
        while stop < len(text) and text[stop].isdecimal():
            stop += 1
        if stop == digits:
            at += 1
            continue
        start = skip(text, at - 1, -1)
        start = start - 1 if start >= 0 and text[start] in "([" else start
        start = skip(text, start, -1) + 1
        after = skip(text, stop)
        stop = after + 1 if text[after : after + 1] in tuple(")]") else stop
        out.append((max(start, out[-1][1] if out else 0), stop))
        at = stop
    return out


def without_hollow(line: str) -> str:
    """A line without the brackets that hold nothing, or nothing but an introduction."""
    return re.sub(r"\(([^()]*)\)", lambda m: "" if " ".join(m[1].lower().split()) in EMPTIED else m[0], line)


def tidy(text: str) -> str:
    """Without hollow brackets, runs of blanks, and blanks before a closing mark."""
    lines = [re.sub("[ \t][ \t]+", " ", line) for line in without_hollow(text).split("\n")]
    return re.sub(r"\s+(?=[,.:;?!])", "", "\n".join(lines)).strip()


def cited(answer: str | None, n: int) -> tuple[str, int]:
    """Citation marks in one form and how many were out of range, which go; of marks side by side each number stays once.

    Internal ids are blanked. Only a text that lost something is tidied.
    """
    text = answer or ""
    out, at, dropped, seen = [], 0, 0, set()
    for m in MARK.finditer(text):
        between = text[at : m.start()]
        if not at or between.strip():  # not beside the mark before
            out.append(between)
            seen = set()
        number, at = int(m[1]), m.end()
        if not 1 <= number <= n:
            dropped += 1
        elif number not in seen:
            seen.add(number)
            out.append(f"[^{number}]")
    marked = "".join([*out, text[at:]])
    spans = leaked(marked)
    edges = [0, *(x for span in spans for x in span), len(marked)]
    blanked = " ".join(marked[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))
    return (tidy(blanked) if dropped or blanked != marked else marked), dropped


_ANSWER = "CASE turn % 6 WHEN 0 THEN concat('see [*2] and [ ^ 1 ] [1][3]. ', text) WHEN 1 THEN concat(text, ' [0] out [9]') WHEN 2 THEN concat(role, ' (Article ID: ', conv_id, ') says  [2] ', left(text, 30)) WHEN 3 THEN concat('a [1] [1] [2] b ( theo ) nguồn_id ', conv_id) WHEN 4 THEN concat('keep  this [1] ', text) ELSE text END"


def answers(spark, sf):
    """Stored messages as answers with citation marks and leaked ids."""
    return table(spark, sf, "conversations").selectExpr("conv_id", "turn", f"{_ANSWER} AS raw")


@query()
def normalize_citations(spark, sf):
    @F.pandas_udf("answer string, dropped int")
    def run(answer: pd.Series, n: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([cited(a, k) for a, k in zip(answer, n, strict=True)], columns=["answer", "dropped"])

    return answers(spark, sf).select("conv_id", "turn", run("raw", F.lit(3)).alias("x")).select("conv_id", "turn", "x.*")


@F.pandas_udf(StringType())
def norm_vi_udf(text: pd.Series) -> pd.Series:
    """Lower case without marks, white space as one; đ stays."""
    flat = lambda t: None if t is None else " ".join("".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn").lower().split())
    return text.map(flat)


@query()
def norm_vi(spark, sf):
    return table(spark, sf, "documents").select("doc_id", norm_vi_udf("text").alias("text"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN n < 1000 THEN [CAST(n AS VARCHAR)] ELSE [CAST(n AS VARCHAR), format('{:,}', n), replace(format('{:,}', n), ',', '.')] END AS spellings
 FROM (SELECT l_orderkey, l_linenumber, CAST(l_partkey * 1000 + l_linenumber AS BIGINT) AS n FROM lineitem)""")
def num_variants(spark, sf):
    """Spellings of a whole number: bare, and with either mark between thousands."""
    n = F.col("l_partkey") * 1000 + F.col("l_linenumber")
    grouped = F.format_number(n, 0)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.array_distinct(F.array(n.cast("string"), grouped, F.replace(grouped, F.lit(","), F.lit(".")))).alias("spellings"))


@F.pandas_udf(BinaryType())
def encode_vector(v: pd.Series) -> pd.Series:
    return v.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())


@F.pandas_udf(ArrayType(FloatType()))
def decode_vector(b: pd.Series) -> pd.Series:
    """Little-endian 4-byte floats; a length that is no multiple of 4 is an error."""
    return b.map(lambda x: None if x is None else np.frombuffer(x, "<f4"))


@query("SELECT vec_id, 4 * len(embedding) AS bytes, true AS same FROM embeddings")
def vector_codec(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding", encode_vector("embedding").alias("b"))
    return rows.select("vec_id", F.octet_length("b").cast("long").alias("bytes"), (decode_vector("b") == F.col("embedding")).alias("same"))


def disposition(name: Column) -> Column:
    """A header-safe name: an ASCII fallback and the percent-encoded one."""
    percent = F.url_encode(name)
    for written, wanted in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        percent = F.replace(percent, F.lit(written), F.lit(wanted))
    plain = F.regexp_replace(name, '[^ -~]|["\\\\]', "_")
    return F.concat(F.lit('attachment; filename="'), plain, F.lit("\"; filename*=UTF-8''"), percent)


@query("""SELECT id, 'attachment; filename="' || regexp_replace(n, '[^ -~]|["\\\\]', '_', 'g') || '"; filename*=UTF-8''''' || url_encode(n) AS header FROM (SELECT id, name || ' é~*+".pdf' AS n FROM articles)""")
def ascii_filename(spark, sf):
    return view(spark, sf, "articles").select("id", disposition(F.concat("name", F.lit(' é~*+".pdf'))).alias("header"))


@query("SELECT doc_id, regexp_matches(text, '[0-9]') AS has_numbers, regexp_matches(text, 'https?://') AS has_links, length(text) <= 4000 AS short, CAST(regexp_matches(text, '[0-9]') AS INT) + CAST(NOT regexp_matches(text, 'https?://') AS INT) + CAST(length(text) <= 4000 AS INT) AS checks FROM documents")
def answer_grade(spark, sf):
    """Style checks of an answer and how many it passes; texts stand for answers."""
    numbers, links, short = F.regexp_like("text", F.lit("[0-9]")), F.regexp_like("text", F.lit("https?://")), F.char_length("text") <= 4000
    return table(spark, sf, "documents").select("doc_id", numbers.alias("has_numbers"), links.alias("has_links"), short.alias("short"), (numbers.cast("int") + (~links).cast("int") + short.cast("int")).alias("checks"))


_SUMMARY = "CASE conv_id % 5 WHEN 0 THEN concat('[S1] ', left(text, 40), ' [S2] ', role) WHEN 1 THEN concat('[S1] ', role, ' only') WHEN 2 THEN concat('[S1] [S2] ', role) WHEN 3 THEN text ELSE concat('x [S2] b [S1]  ', role, '  ') END"


@query(f"SELECT conv_id, turn, CASE WHEN trim(a) = '' OR trim(b) = '' THEN NULL ELSE trim(a) || '|' || trim(b) END AS parsed FROM (SELECT conv_id, turn, regexp_extract(raw, '\\[S1\\]([^\\[]*)', 1) AS a, regexp_extract(raw, '\\[S2\\]([^\\[]*)', 1) AS b FROM (SELECT conv_id, turn, {_SUMMARY} AS raw FROM conversations))")
def batch_summary_parse(spark, sf):
    """Summaries of a batch by their marks; null if one is missing or blank."""
    part = lambda i: F.trim(F.regexp_extract("raw", rf"\[S{i}\]([^\[]*)", 1))
    rows = table(spark, sf, "conversations").selectExpr("conv_id", "turn", f"{_SUMMARY} AS raw")
    return rows.select("conv_id", "turn", F.when((part(1) == "") | (part(2) == ""), None).otherwise(F.concat_ws("|", part(1), part(2))).alias("parsed"))
