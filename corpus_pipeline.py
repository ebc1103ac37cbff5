"""From raw documents to token shards: toxicity, near-duplicates, benchmark passages, source mixing, token output.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last
return the columns of documents. Run from the command line or through ``run``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import decontaminate, minhash, mixing, shards, toxicity
from lodestone.llm.common import table, work_path, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose toxicity is 0.5 or more; null and empty texts stay, and without toxic labels all do."""
    docs = docs.select(COLUMNS)
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.where("toxic_score < 0.5").select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8): the one with the smallest id.

    Of rows that repeat that id, each different text stays once; rows without an id are compared too and go as copies
    of others or of each other; null and empty texts stay.
    """
    return minhash.without_copies(docs.select(COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item within its edit budget; null and empty texts stay."""
    return decontaminate.clean(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"), **decontaminate.WHOLE)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, small sources more often, no source more than twice as often as another."""
    return mixing.mix(docs.select(COLUMNS), seed=mixing.SEED, max_repeats=mixing.MAX_REPEATS).select(COLUMNS)


def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards in training order; returns where each sequence is, read back and compared."""
    folder = work_path(spark, "pipeline-shards")
    return shards.verified(spark, folder, shards.materialise(docs, folder))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_shards", token_shards),
]

#: Trained, hashed and tokenised stages have no SQL; tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
