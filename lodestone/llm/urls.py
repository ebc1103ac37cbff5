"""URL filters: a blocked Bloom filter of listed keys in front of an exact hash join.

A rule is a host and a path prefix; it fits the host and its subdomains. The keys of a URL are its
host's suffixes joined with its path's prefixes, of the lengths that occur in the list. A blocked
Bloom filter (one 512-bit block per key, all its bits in that block) lets possible hits through;
an exact join with the list removes false positives, and the longest rule that fits wins.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLOOM_WORDS, bloom_blocks, bloom_filter, bloom_hits, table, written

MAX_FILTER_BYTES = 64 << 20  # a longer list goes without the filter, by the exact join alone
MAX_BROADCAST = 100_000  # rules that go to every task; of a longer list only those with a thousandth of the hits each
HOT = 1000


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str


RULES = (Rule("com", "/en/", "block"), Rule("example.com", "/en/7", "allow"), Rule("net", "/de/", "allow"), Rule("example.net", "/de/8", "block"), Rule("org", "/es/", "block"))


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for a null url or none with ://."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def hashes(keys: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(k.encode()) for k in keys), np.uint64, len(keys))


def hashed(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(hashes(batch.column(0).to_pylist()).view(np.int64))], names=["h"])


def keys_of(host: str, path: str, lengths: list[int], levels: list[int]) -> list[str]:
    """Host suffixes of the listed numbers of labels with path prefixes of the listed lengths."""
    labels = host.split(".")
    suffixes = [".".join(labels[-n:]) for n in levels if n <= len(labels)]
    return [s + p for p in [path[:n] for n in lengths if n <= len(path)] for s in suffixes]


def exact(hits: DataFrame, listed: DataFrame, size: int, most: int) -> DataFrame:
    """hits (url, key) that are listed, with their verdicts.

    A short list goes to every task. Of a long one only the rules with a thousandth of the hits or more do, no more than a
    thousand; the others are joined by key, and none of those is hot.
    """
    if size <= most:
        return hits.join(F.broadcast(listed), "key")
    hits = written(hits, "hits")
    total = hits.count()
    often = hits.groupBy("key").count().where(F.col("count") * HOT >= F.lit(total)).select("key", F.lit(True).alias("often"))
    marked = listed.join(F.broadcast(often), "key", "left")
    hot = F.broadcast(marked.where("often").drop("often"))
    rest = hits.join(F.broadcast(often), "key", "left_anti").join(listed, "key")
    return hits.join(hot, "key").unionByName(rest)


def judged(urls: DataFrame, rules: DataFrame, default: str = "allow", most: int = MAX_BROADCAST) -> DataFrame:
    """urls (url) with host, path, rule (host and path of the rule that fits, else null) and verdict.

    rules (host, path, verdict). Longest rule wins; of equally long ones block before allow, then
    the last in text order. Every row of urls is kept, also repeated ones and null urls, which have
    an empty host and path. Other columns of urls are kept; columns named host, path, rule or verdict are replaced. Rules with a null or empty host, or a path that doesn't begin with /, fit nothing; an empty list judges all by default.
    """
    spark = urls.sparkSession
    urls = urls.drop("_lodestone_best", "_lodestone_url")
    path = F.coalesce("path", F.lit(""))
    usable = rules.where((F.col("host") != "") & ~F.contains("host", F.lit("/")) & ((path == "") | F.startswith(path, F.lit("/"))))
    listed = usable.select(F.concat("host", path).alias("key"), F.char_length(path).alias("n"), F.size(F.split("host", "\\.")).alias("labels"), "verdict")
    listed = listed.groupBy("key", "n", "labels").agg(F.max("verdict").alias("verdict"))
    parsed = urls.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))

    size = listed.agg(F.count("*").alias("k"), F.array_sort(F.collect_set("n")).alias("lengths"), F.array_sort(F.collect_set("labels")).alias("levels")).first()
    blocks = bloom_blocks(size["k"])
    bits = spark.sparkContext.broadcast(bloom_filter(listed.select("key").mapInArrow(hashed, "h long"), blocks)) if blocks * BLOOM_WORDS * 8 <= MAX_FILTER_BYTES else None
    lengths, levels = list(size["lengths"]), list(size["levels"])

    def possible(batches):
        for batch in batches:
            hosts, paths = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            rows, keys = [], []
            for i, (h, p) in enumerate(zip(hosts, paths, strict=True)):
                found = keys_of(h, p, lengths, levels)
                keys += found
                rows += [i] * len(found)
            if keys and bits is not None:
                hit = np.flatnonzero(bloom_hits(bits.value, hashes(keys)))
                rows, keys = [rows[i] for i in hit], [keys[i] for i in hit]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(keys, pa.string())], names=["url", "key"])

    hits = parsed.where("host <> ''").select("url", "host", "path").mapInArrow(possible, "url string, key string")
    best = exact(hits, listed, size["k"], most).groupBy(F.col("url").alias("_lodestone_url")).agg(F.max(F.struct(F.char_length("key").alias("length"), F.col("verdict").alias("verdict"), F.col("key").alias("rule"))).alias("_lodestone_best"))
    # what has no host can have no rule: such rows are spread by a key of their own that no url equals
    alone = F.concat(F.lit("\0"), F.monotonically_increasing_id().cast("string"))
    parsed = parsed.withColumn("_lodestone_url", F.when(F.col("host") != "", F.col("url")).otherwise(alone))
    out = parsed.join(best, "_lodestone_url", "left").select(*[c for c in parsed.columns if c.lower() not in ("rule", "verdict", "_lodestone_url")], "_lodestone_best")
    return out.withColumn("rule", F.col("_lodestone_best.rule")).withColumn("verdict", F.coalesce("_lodestone_best.verdict", F.lit(default))).drop("_lodestone_best")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame([(r.host, r.path, r.verdict) for r in RULES], "host string, path string, verdict string")
    return judged(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


_VALUES = ", ".join(f"('{r.host}', '{r.path}', '{r.verdict}')" for r in RULES)
ORACLE = f"""
WITH rules(h, p, v) AS (VALUES {_VALUES}),
u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
m AS (SELECT page_id, host, path, h || p AS rule, v, row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(h || p) DESC) AS k
    FROM u LEFT JOIN rules ON (host = h OR suffix(host, '.' || h)) AND prefix(path, p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m WHERE k = 1"""
