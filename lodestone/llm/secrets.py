"""Secret scans over an incremental ledger of content-addressed text versions.

Every version of every path is named by the SHA-256 of its text. The ledger holds one row per
(blob, rule, rule version) already scanned, with the spans found. Only unseen combinations are
scanned, once per distinct blob; the findings are then joined back to all paths. DataFrame
functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, work_path


@dataclass(frozen=True)
class Rule:
    """A pattern whose group `group` must have at least `least` characters; base rules make up the digest."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1
    base: bool = True


RULES = (
    Rule("assign", "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", "AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", "[0-9a-f]+", 0, 24),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, 1, False),
    Rule("bearer", "[Bb]earer\\x20+[A-Za-z0-9._~+/-]{16,}", 0, 24, 1, False),
)

SPAN = "array<struct<s:int,e:int>>"
LEDGER = "blob string, kind string, version int, spans array<struct<s:int,e:int>>"


def spans(text: Column, rule: Rule) -> Column:
    """Start and end, in code points, of the leftmost non-overlapping matches that are long enough.

    The pieces between the matches (split) and the matches give the offsets by running sums; n matches are
    gathered in blocks of sqrt(n), as each step copies what its block has so far.
    """
    if rule.kind == "hex":  # a run of [0-9a-f] of 24 or more is a match of its own; shorter ones need not be listed
        pattern = F.lit(f"[0-9a-f]{{{rule.least},}}")
    elif rule.kind == "access":
        pattern = F.lit(f"AKIA[A-Z0-9]{{{rule.least - 4},}}")
    else:
        pattern = F.lit(rule.pattern)
    gaps = F.split(text, pattern, -1)
    begin = lambda at: F.struct(at.alias("at"), F.array().cast(SPAN).alias("out"))

    def lengths(found: Column) -> Column:
        value = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else found
        return F.zip_with(F.slice(gaps, 1, F.size(found)), F.arrays_zip(found.alias("m"), value.alias("v")), lambda g, m: F.struct(F.length(g).alias("g"), F.length(m["m"]).alias("m"), F.length(m["v"]).alias("v")))

    def add(acc, x):
        start = acc["at"] + x["g"]
        end = start + x["m"]
        kept = F.when(x["v"] >= rule.least, F.array(F.struct(start.alias("s"), end.alias("e")))).otherwise(F.array().cast(SPAN))
        return F.struct(end.alias("at"), F.concat(acc["out"], kept).alias("out"))

    def add_block(acc, block):
        inner = F.aggregate(block, begin(acc["at"]), add)
        return F.struct(inner["at"].alias("at"), F.concat(acc["out"], inner["out"]).alias("out"))

    def placed(steps: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(steps))).cast("int")
        blocks = F.transform(F.sequence(F.lit(1), F.size(steps), size), lambda i: F.slice(steps, i, size))
        return F.aggregate(blocks, begin(F.lit(0)), add_block, lambda acc: acc["out"])

    some = let(let(F.regexp_extract_all(text, pattern, F.lit(0)), lengths), placed)
    return F.when(F.regexp_like(text, pattern), some).otherwise(F.array().cast(SPAN))


def let(value: Column, body) -> Column:
    """body(value), with value taken once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Ledger rows of blobs (blob, text, done: kinds that need no scan, or null): one per rule that is due, also where nothing is found."""
    each = []
    for r in rules:
        due = ~F.coalesce(F.array_contains("done", r.kind), F.lit(False))
        each.append(F.when(due, F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), spans(F.col("text"), r).alias("spans"))))
    return blobs.select("blob", F.explode(F.array_compact(F.array(*each))).alias("r")).select("blob", "r.kind", "r.version", "r.spans")


def ledger_rows(spark: SparkSession, ledger: str, rules: tuple[Rule, ...]) -> DataFrame | None:
    """The ledger's rows of these rules' versions; None where there is no ledger yet."""
    try:
        known = spark.read.schema(LEDGER).parquet(ledger)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    current = F.lit(False)
    for r in rules:
        current = current | ((F.col("kind") == r.kind) & (F.col("version") == r.version))
    return known.where(current)


def scan_versions(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, path_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scans what the ledger has not seen, appends it, and returns (path, blob, found) for all versions.

    found is a map from kind to spans. A null text counts as an empty one; equal texts share a blob;
    repeated rows and null paths are returned as often as they come. ledger is a folder in shared
    storage; a missing one is an empty ledger. A run that fails before the append leaves it as it was.
    """
    spark = versions.sparkSession
    named = versions.select(F.col(path_col).alias("path"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    named = named.withColumn("blob", F.sha2("text", 256))
    paths = named.select("path", "blob")
    wanted = paths.groupBy("blob").agg(F.min("path").alias("first")).withColumn("done", F.lit(None).cast("array<string>"))
    if (seen := ledger_rows(spark, ledger, rules)) is not None:
        done = seen.groupBy("blob").agg(F.collect_set("kind").alias("done"))  # as many as there are rules at most
        wanted = wanted.drop("done").join(done, "blob", "left").where(F.coalesce(F.size("done") < len(rules), F.lit(True)))
    # one row of each unseen blob: the text travels keyed by blob and path, so copies of one text are spread
    texts = named.join(wanted.withColumnRenamed("blob", "own"), (named["blob"] == F.col("own")) & named["path"].eqNullSafe(F.col("first"))).select("blob", "text", "done")
    scan(texts, rules).dropDuplicates(["blob", "kind", "version"]).write.mode("append").parquet(ledger)
    found = ledger_rows(spark, ledger, rules).where(F.size("spans") > 0).groupBy("blob").agg(F.map_from_entries(F.collect_set(F.struct("kind", "spans"))).alias("found"))
    return paths.join(found, "blob", "left").select("path", "blob", "found")


def digest(kinds: list[str], found: Column) -> Column:
    """kind:start:end of the named kinds, by start and then kind as listed, comma-joined."""

    def tagged(i: int, kind: str) -> Column:
        return F.transform(F.coalesce(found[kind], F.array().cast(SPAN)), lambda x: F.struct(x["s"].alias("s"), F.lit(i).alias("i"), x["e"].alias("e"), F.lit(kind).alias("k")))

    listed = F.array_sort(F.concat(*[tagged(i, k) for i, k in enumerate(kinds)]))
    return F.array_join(F.transform(listed, lambda x: F.concat_ws(":", x["k"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_versions(table(spark, sf_dir, "documents"), work_path(spark, "ledger"))
    base = [r.kind for r in RULES if r.base]
    counts = [F.when(F.col("found")[k].isNotNull(), F.size(F.col("found")[k])).otherwise(0).cast("long").alias(f"n_{k}") for k in base]
    return found.select(F.col("path").alias("doc_id"), *counts, F.sha2(digest(base, F.col("found")), 256).alias("base_sha256"), digest([r.kind for r in RULES], F.col("found")).alias("spans"))


def _sql_spans(kind: str, pattern: str, group: int, least: int, at: int, flags: str) -> str:
    pattern = pattern.replace("'", "''")
    return f"""
    SELECT doc_id, '{kind}' AS kind, {at} AS k, s, s + m AS e FROM (
        SELECT doc_id, v, m, CAST(sum(g + m) OVER (PARTITION BY doc_id ORDER BY i) - m AS BIGINT) AS s FROM (
            SELECT doc_id, i, length(gaps[i]) AS g, length(found[i]) AS m, length(vals[i]) AS v FROM (
                SELECT doc_id, unnest(range(1, len(found) + 1)) AS i, found, vals, gaps FROM (
                    SELECT doc_id, regexp_extract_all(t, '{pattern}', 0{flags}) AS found, regexp_extract_all(t, '{pattern}', {group}{flags}) AS vals,
                           string_split_regex(t, '{pattern}'{flags}) AS gaps
                    FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))))) WHERE v >= {least}"""


_LISTED = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k)"
ORACLE = (
    "WITH spans AS ("
    + " UNION ALL ".join(
        _sql_spans(r.kind, r.pattern if r.kind not in ("hex", "access") else {"hex": "[0-9a-f]{24,}", "access": "AKIA[A-Z0-9]{16,}"}[r.kind], r.group, r.least, i, "") for i, r in enumerate(RULES)
    )
    + f"""), per AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
        coalesce({_LISTED} FILTER (k < 3), '') AS base, {_LISTED} AS spans FROM spans GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
        sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents d LEFT JOIN per USING (doc_id)"""
)
