"""Mixing sources by temperature, under an entropy target or a limit on repetition.

A source with a share p of the tokens gets the weight p**t / sum(p**t). The exponent t is bisected
either to the least t in [0, 1] whose largest repetition stays within a limit, which only takes the
largest and the smallest share, or to the t in [0, 1] at which the weights have a given entropy, in ten aggregations
over the sources that halve six times each. Each source then runs through whole epochs and
a part of one; every epoch orders a source by keyed blocks, and the last one stops at its token budget.
DataFrame functions only. Plans of up to MAX_BROADCAST sources are broadcast, larger ones joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, table, written

STEPS = 60
HALVINGS = 6  # of the bisection by entropy in one aggregation
MAX_BROADCAST = 100_000  # sources, at some 100 bytes each


def order_key(identity: Column, epoch: Column, seed: int) -> Column:
    """60 keyed bits that order the documents of an epoch; the first 12 name the block."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed).cast("string"), epoch.cast("string"), F.coalesce(identity.cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")


def block_of(key: Column) -> Column:
    return F.shiftright(key, 48).cast("int")


def facts(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """id, source and tokens of each row: words and one end token. Null sources count as the source ''."""
    words = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(source_col), F.lit("")).alias("source"), (words + 1).alias("tokens"))


def even_exponent(top: float, low: float, max_repeats: float) -> float:
    """The least exponent in [0, 1] at which no source is seen more than max_repeats times as often as another, from the largest and the smallest share."""
    lo, hi = 0.0, 1.0
    for _ in range(STEPS):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (top / low) ** (1 - mid) > max_repeats else (lo, mid)
    return round(hi, 12)


def entropy_exponent(shares: DataFrame, entropy: float) -> float:
    """The least exponent in [0, 1] at which the weights of shares (p) have no more than that entropy; 1 if they have more there."""
    lo, hi = 0.0, 1.0
    for _ in range(STEPS // HALVINGS):
        step = (hi - lo) / 2**HALVINGS
        grid = F.explode(F.array(*[F.lit(lo + step * i) for i in range(1, 2**HALVINGS)]))
        z = F.sum(F.pow("p", F.col("t")))
        spread = F.log(z) - F.sum(F.pow("p", F.col("t")) * F.col("t") * F.log("p")) / z
        above = shares.select("p", grid.alias("t")).groupBy("t").agg((spread > entropy).alias("above")).where("above").agg(F.max("t")).first()[0]
        lo = lo if above is None else above
        hi = min(hi, lo + step)
    return round(hi, 12)


def weights(sizes: DataFrame, max_repeats: float | None, entropy: float | None, budget: float | None) -> DataFrame:
    """source, n, exponent, weight, repeats from sizes (source, n).

    repeats is the number of epochs: with a token budget, weight * budget / n; without one, scaled
    so that the source repeated least is seen exactly once and no document is left out. Only sums and extremes
    come to the driver.
    """
    total, top, low = sizes.agg(F.sum("n"), F.max("n"), F.min("n")).first()
    if not total:
        return sizes.select("source", "n", *[F.lit(0.0).alias(c) for c in ("exponent", "weight", "repeats")])
    share = F.col("n") / F.lit(float(total))
    exponent = entropy_exponent(sizes.select(share.alias("p")), entropy) if entropy is not None else even_exponent(top / float(total), low / float(total), max_repeats)
    z = sizes.agg(F.sum(F.pow(share, F.lit(exponent)))).first()[0]
    weight = F.pow(share, F.lit(exponent)) / F.lit(z)
    repeats = weight * F.lit(budget) / F.col("n") if budget is not None else F.pow(share / F.lit(top / float(total)), F.lit(exponent) - 1)
    return sizes.select("source", "n", F.lit(exponent).alias("exponent"), weight.alias("weight"), F.round(repeats, 9).alias("repeats"))


def sized(plan: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(plan) if rows <= MAX_BROADCAST else plan


def mixing_plan(rows: DataFrame, seed: int, max_repeats: float | None = 2.0, entropy: float | None = None, budget: float | None = None) -> DataFrame:
    """Per source: exponent, weight, repeats, whole epochs, and the last order key inside the part of an epoch.

    The part's budget is floor(fraction * n) tokens; documents enter in key order while their
    running sum fits. Sums of 4,096 blocks per source find the block where it ends, and only
    that block is read by document.
    """
    sizes = written(rows.groupBy("source").agg(F.sum("tokens").alias("n")), "sizes")
    plan = written(weights(sizes, max_repeats, entropy, budget), "weights")
    sources = plan.count()
    plan = plan.withColumn("whole", F.floor("repeats").cast("int")).withColumn("part", F.floor(F.round((F.col("repeats") - F.floor("repeats")) * F.col("n"), 3)).cast("long"))
    keyed = rows.join(sized(plan.select("source", "whole", "part"), sources), "source").withColumn("key", order_key(F.col("id"), F.col("whole"), seed)).withColumn("block", block_of(F.col("key")))
    sums = keyed.groupBy("source", "part", "block").agg(F.sum("tokens").alias("t"))
    before = F.sum("t").over(Window.partitionBy("source").orderBy("block")) - F.col("t")
    edge = sums.withColumn("before", before).where((F.col("before") <= F.col("part")) & (F.col("before") + F.col("t") > F.col("part"))).select("source", "block", (F.col("part") - F.col("before")).alias("room"))
    inside = keyed.join(sized(edge, sources), ["source", "block"])
    running = F.sum("tokens").over(Window.partitionBy("source", "block").orderBy("key"))
    last = inside.withColumn("running", running).where(F.col("running") <= F.col("room")).groupBy("source").agg(F.max("key").alias("last"))
    floor_key = edge.select("source", (F.shiftleft(F.col("block").cast("long"), 48) - 1).alias("floor"))
    out = plan.join(floor_key, "source", "left").join(last, "source", "left")
    return out.select("source", "n", "exponent", "weight", "repeats", "whole", F.coalesce("last", "floor").alias("last"))


def realise(docs: DataFrame, plan: DataFrame, seed: int, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """docs with mix_epoch, mix_block and mix_key: one row per epoch a document is in.

    Sorting by mix_epoch and mix_key gives the training order, with the sources interleaved. Columns of docs that
    have these names are replaced.
    """
    own = ["_lodestone_source", "_lodestone_whole", "_lodestone_last", "_lodestone_copies"]
    listed = sized(plan.select(F.col("source").alias(own[0]), F.col("whole").alias(own[1]), F.col("last").alias(own[2])), plan.count())
    docs = docs.drop("mix_epoch", "mix_block", "mix_key")
    wide = docs.join(listed, F.coalesce(F.col(source_col), F.lit("")) == F.col(own[0]))
    more = F.coalesce(order_key(F.col(id_col), F.col(own[1]), seed) <= F.col(own[2]), F.lit(False)).cast("int")
    wide = wide.withColumn(own[3], F.col(own[1]) + more).where(F.col(own[3]) > 0)
    wide = wide.withColumn("mix_epoch", F.explode(F.sequence(F.lit(0), F.col(own[3]) - 1)))
    return wide.withColumn("mix_key", order_key(F.col(id_col), F.col("mix_epoch"), seed)).withColumn("mix_block", block_of(F.col("mix_key"))).select(*docs.columns, "mix_epoch", "mix_block", "mix_key")


def mix(docs: DataFrame, seed: int = 17, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **targets) -> DataFrame:
    """docs repeated to their sources' target weights; targets as in mixing_plan.

    Null sources are one source with ''; a null id is ordered as ''. Rows that repeat an id go
    together. Null and empty texts weigh one token. An empty table gives no rows.
    """
    rows = written(facts(docs, id_col, source_col, text_col), "facts")
    return realise(docs, written(mixing_plan(rows, seed, **targets), "plan"), seed, id_col, source_col)


MAX_REPEATS = 2.0
SEED = 17


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(facts(table(spark, sf_dir, "documents"), "doc_id", "source", "text"), "facts")
    plan = written(mixing_plan(rows, SEED, max_repeats=MAX_REPEATS), "plan")
    mixed = realise(rows, plan, SEED, "id", "source")
    return mixed.select(F.col("id").alias("doc_id"), "source", "tokens", F.col("mix_epoch").alias("epoch"), F.col("mix_block").alias("block"), F.col("mix_key").alias("order_key"))


_KEY = "('0x' || substr(md5('{seed}:' || {epoch} || ':' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT"
ORACLE = f"""
WITH RECURSIVE f AS (SELECT doc_id, coalesce(source, '') AS source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) + 1 AS BIGINT) AS tokens FROM documents),
s AS (SELECT source, CAST(sum(tokens) AS BIGINT) AS n FROM f GROUP BY source),
p AS (SELECT source, n, n / (SELECT sum(n) FROM s)::DOUBLE AS p FROM s),
r AS (SELECT max(p) / min(p) AS r, max(p) AS top FROM p),
b AS (SELECT 0 AS i, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi UNION ALL
    SELECT i + 1, CASE WHEN pow(r, 1 - (lo + hi) / 2) > {MAX_REPEATS} THEN (lo + hi) / 2 ELSE lo END, CASE WHEN pow(r, 1 - (lo + hi) / 2) > {MAX_REPEATS} THEN hi ELSE (lo + hi) / 2 END
    FROM b, r WHERE i < {STEPS}),
t AS (SELECT round(hi, 12) AS t FROM b WHERE i = {STEPS}),
q AS (SELECT source, n, round(pow(p / top, t - 1), 9) AS repeats FROM p, r, t),
w AS (SELECT source, CAST(floor(repeats) AS INT) AS whole, CAST(floor(round((repeats - floor(repeats)) * n, 3)) AS BIGINT) AS part FROM q),
k AS (SELECT f.*, whole, part, sum(tokens) OVER (PARTITION BY source ORDER BY {_KEY.format(seed=SEED, epoch="whole")}) AS running FROM f JOIN w USING (source)),
c AS (SELECT doc_id, source, tokens, unnest(range(0, whole + CASE WHEN running <= part THEN 1 ELSE 0 END)) AS epoch FROM k)
SELECT doc_id, source, tokens, CAST(epoch AS INT) AS epoch, CAST({_KEY.format(seed=SEED, epoch="epoch")} >> 48 AS INT) AS block, {_KEY.format(seed=SEED, epoch="epoch")} AS order_key FROM c"""
