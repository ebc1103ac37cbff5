"""The pipeline's stages on planted documents, and its whole run."""

import corpus_pipeline
import pytest

from lodestone.llm.common import table, written

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def planted(spark):
    """The documents with planted copies and a benchmark passage; ids from 10,000 on are ours."""
    docs = table(spark, SF, "documents").select(corpus_pipeline.COLUMNS)
    item = table(spark, SF, "benchmark").first().text
    base = " ".join(f"planted{n}" for n in range(80))
    rows = [(10_000, base), (10_001, base), (10_002, base.replace("planted40", "other")), (10_003, f"{base[:200]} unlike {item} after"), (10_004, None), (10_005, ""), (None, base)]
    own = spark.createDataFrame([(i, t, "en", None if i == 10_005 else "own", len(t or "")) for i, t in rows], docs.schema)
    return written(docs.union(own), "planted")


def ids(df):
    return {r[0] for r in df.select("doc_id").collect()}


def test_near_duplicates_keep_one(spark, planted):
    kept = ids(corpus_pipeline.drop_near_duplicates(spark, planted, SF))
    assert 10_000 in kept and not kept & {10_001, 10_002, None} and {10_003, 10_004, 10_005} <= kept


def test_near_duplicates_keep_rows_not_ids(spark, planted):
    a, b, c = (" ".join(f"{x}{n}" for n in range(60)) for x in "abc")
    rows = [(1, a), (1, a), (1, b), (2, a), (3, b.upper()), (4, c), (None, c), (None, "only " + a[::-1]), (None, "only " + a[::-1]), (None, None), (None, None), (5, ""), (5, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], planted.schema)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF).select("doc_id", "text").collect()
    assert sorted(map(tuple, kept), key=str) == sorted([(1, a), (1, b), (4, c), (None, "only " + a[::-1]), (None, None), (None, None), (5, ""), (5, "")], key=str)


def test_benchmark_passages_go(spark, planted):
    kept = ids(corpus_pipeline.drop_contaminated(spark, planted, SF))
    assert 10_003 not in kept and {10_000, 10_001, 10_004, 10_005, None} <= kept


def test_every_document_is_mixed_in(spark, planted):
    mixed = corpus_pipeline.mix_sources(spark, planted, SF)
    assert mixed.columns == corpus_pipeline.COLUMNS and ids(mixed) == ids(planted)


def test_toxic_documents_go(spark, planted):
    kept = corpus_pipeline.drop_toxic(spark, planted, SF)
    assert kept.columns == corpus_pipeline.COLUMNS and {10_000, 10_004, 10_005, None} <= ids(kept)


def test_empty_table_runs_through(spark, planted):
    docs = written(planted.limit(0), "none")
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), name)
    assert docs.count() == 0


def test_whole_run(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows))) and len(rows) > 10
