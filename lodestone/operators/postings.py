"""An inverted index of a stored table: (term, id, n), n being how often the id's texts hold the term, counted up to 3.

Postings lie in buckets by term, sorted by term and id, so a question reads its terms' buckets and of these the pages that can hold
its terms. The index follows its table by content: of each id a digest of its texts is kept, only ids with a new digest are
split into words again, and postings of an earlier state are told from living ones by their generation. Texts move once, by id, and are split and
counted where they arrive; a bucket's postings are spread over files by id, so a frequent term is in all of them.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.sinks import folder, shared
from lodestone.views import table

WORDS = "[\\p{L}\\p{Nd}]+"
BUCKETS = 64
PART = 4 << 20  # bytes of text that a task splits and counts
SPREAD = 256 << 20  # bytes of text for each file of a bucket
MOST = 3  # mentions of a term that count
POSTING = "generation int, bucket int, term string, id long, n int"
LEDGER = "id long, digest decimal(38,0), generation int"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORDS), F.lit(0))


def terms_of(text: str) -> list[str]:
    """Distinct words of two letters or more of a query, which is the caller's and short."""
    import regex

    return list(dict.fromkeys(t for t in regex.findall(r"[\p{L}\p{Nd}]+", text.lower()) if len(t) > 1))


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


@dataclass
class Index:
    spark: SparkSession
    path: str
    ledger: str = ""
    generation: int = -1
    dead: int = 0
    state: str = ""

    @property
    def manifest(self) -> str:
        return f"{self.path}/manifest"

    def load(self) -> Index:
        """The latest state that was written in full, or none."""
        try:
            rows = self.spark.read.schema("generation int, ledger string, dead long, state string").parquet(self.manifest)
            if last := rows.orderBy(F.desc("generation")).first():
                self.generation, self.ledger, self.dead, self.state = last
        except AnalysisException:  # no index yet
            pass
        return self

    def entries(self) -> DataFrame:
        """The ids of the index with the digests of their texts."""
        return self.spark.read.schema(LEDGER).parquet(self.ledger) if self.ledger else self.spark.createDataFrame([], LEDGER)

    def extend(self, docs: DataFrame, state: str = "") -> int:
        """Brings the index to docs (id, text) and returns how many ids were split into words.

        Rows of one id count as one text after the other; rows without an id are left out. What is there already is not
        touched, and the manifest's row comes last, so a job that ends before leaves the earlier state.
        """
        generation = self.generation + 1
        docs = docs.where("id IS NOT NULL")
        size = F.octet_length(F.coalesce("text", F.lit("")))
        now = docs.groupBy("id").agg(F.sum(F.xxhash64(F.coalesce("text", F.lit(""))).cast("decimal(38,0)")).alias("digest"), F.sum(size).alias("bytes"))
        old = self.entries()
        fresh = now.join(old, ["id", "digest"], "left_anti").withColumn("generation", F.lit(generation))
        fresh.write.parquet(at := folder(self.spark, "fresh"))
        held = self.spark.read.schema("bytes long").parquet(at).agg(F.sum("bytes")).first()[0] or 0
        fresh = self.spark.read.schema(LEDGER).parquet(at)
        whole = docs.join(fresh.select("id"), "id", "left_semi").repartition(1 + held // PART, "id")
        words = whole.select("id", F.explode(tokens(F.col("text"))).alias("term"))
        counted = words.groupBy("id", "term").agg(F.least(F.count("*"), F.lit(MOST)).cast("int").alias("n"))
        spread = F.pmod(F.xxhash64("id"), F.lit(1 + held // SPREAD))
        rows = counted.select(bucket_of(F.col("term")).alias("bucket"), "term", "id", "n").repartition("bucket", spread).select(F.lit(generation).alias("generation"), "bucket", "term", "id", "n")
        rows.sortWithinPartitions("generation", "bucket", "term", "id").write.mode("append").partitionBy("generation", "bucket").parquet(f"{self.path}/postings")
        now = now.drop("bytes")
        living = old.join(now, ["id", "digest"], "left_semi")
        gone = old.join(now, ["id", "digest"], "left_anti")
        gone.select("id", "generation").write.mode("append").parquet(f"{self.path}/dead")
        living.union(fresh).write.parquet(ledger := f"{self.path}/ledger-{generation}")
        dead = self.spark.read.schema("id long, generation int").parquet(f"{self.path}/dead").count()
        self.spark.createDataFrame([(generation, ledger, dead, state)], "generation int, ledger string, dead long, state string").coalesce(1).write.mode("append").parquet(self.manifest)
        self.generation, self.ledger, self.dead, self.state = generation, ledger, dead, state
        return fresh.count()

    def postings(self, terms: list[str]) -> DataFrame:
        """term, id, n of the terms; others' buckets are not read. No terms: no rows."""
        if not terms:
            return self.spark.createDataFrame([], "term string, id long, n int")
        wanted = [r[0] for r in self.spark.createDataFrame([(t,) for t in terms], "term string").select(bucket_of(F.col("term"))).distinct().collect()]
        rows = self.spark.read.schema(POSTING).parquet(f"{self.path}/postings")
        rows = rows.where(F.col("bucket").isin(*wanted) & F.col("term").isin(*terms) & (F.col("generation") <= self.generation))
        if self.dead:
            rows = rows.join(self.spark.read.schema("id long, generation int").parquet(f"{self.path}/dead"), ["id", "generation"], "left_anti")
        return rows.select("term", "id", "n")

    def scores(self, terms: list[str], among: DataFrame | None = None, all_terms: list[str] | None = None) -> DataFrame:
        """id, covered (distinct terms), mentions, score (their part of the letters of all_terms) of ids with any of terms."""
        rows = self.postings(terms)
        if among is not None:
            rows = rows.join(among.select("id"), "id", "left_semi")
        return scored(rows, sum(map(len, all_terms or terms)))

    def best(self, text: str, k: int, among: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
        """The k best ids for a question, and the terms whose ids were all candidates.

        Terms are taken up from the longest on. When k ids score more with those read than all unread terms weigh together, no
        other id can come in: of the unread terms only the postings of candidates count from then on.
        """
        terms = sorted(terms_of(text), key=lambda t: (-len(t), t))
        if not terms:
            return self.spark.createDataFrame([], "id long, covered int, mentions int, score double"), []
        total, used = sum(map(len, terms)), len(terms)
        for m in range(1, len(terms)):
            rest = sum(map(len, terms[m:]))
            if total - rest <= rest:
                continue  # not even an id with all terms read could be ahead
            ahead = self.scores(terms[:m], among, terms).where(F.col("score") * total > rest + 1e-6)
            if ahead.limit(k).count() >= k:
                used = m
                break
        if used == len(terms):
            found = self.scores(terms, among)
        else:
            read = self.postings(terms[:used])
            read = read if among is None else read.join(among.select("id"), "id", "left_semi")
            more = self.postings(terms[used:]).join(read.select("id").distinct(), "id", "left_semi")
            found = scored(read.unionByName(more), total)
        return found.orderBy(*by_score("id")).limit(k), terms[:used]


def scored(rows: DataFrame, total: int) -> DataFrame:
    """id, covered, mentions and score of postings; total is the letters of all terms of the question."""
    sums = rows.groupBy("id").agg(F.count("*").cast("int").alias("covered"), F.sum("n").cast("int").alias("mentions"), F.sum(F.char_length("term")).alias("letters"))
    return sums.select("id", "covered", "mentions", F.round(F.col("letters") / F.lit(float(total)), 9).alias("score"))


def by_score(id_col: str) -> list[Column]:
    return [F.desc("score"), F.desc("covered"), F.desc("mentions"), F.col(id_col)]


def files_of(df: DataFrame) -> str:
    """A digest of the names, sizes and times of a stored table's files, from their listing; no column is read."""
    listed = df.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    n, digest = listed.agg(F.count("*"), F.sum(F.xxhash64(*listed.columns).cast("decimal(38,0)"))).first()
    return f"{n}:{digest}"


def index_of(spark: SparkSession, sf_dir: str, name: str, id_col: str, text_col: str = "text") -> Index:
    """The index of a stored table, in the shared folder; brought up to date where the table's files have changed."""
    key = hashlib.md5("\n".join((sf_dir, name, id_col, text_col)).encode(), usedforsecurity=False).hexdigest()
    found, stored = Index(spark, f"{shared(spark)}/lodestone/postings-{key}").load(), table(spark, sf_dir, name)
    if found.state != (state := files_of(stored)):
        found.extend(stored.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), state)
    return found
