"""Extra columns with the operators' own names, null rows, empty and very long texts, ties and repeated rows: the results are those of the plain table."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, embeddings, lm, minhash, mixing, secrets, shards, toxicity, urls, warc
from lodestone.llm.common import work_path, written

#: Names that the operators use inside; those of the columns an operator reads are left out where it is called.
OWN = """id fp n sig version key k rep comp component component_id hub top h set x kept partners n_shingles host path rule verdict best labels levels
toxic_score toxic_passages label best n_toxic whole last part budget block mix_epoch mix_key mix_block mix_source mix_copies copies repeats weight exponent
slot shard row position sequence n_tokens doc_ids tokens crc digest first bytes sha1 packed payload header record blob kind spans found done own
vector node weight hash links other word c shared parcel data mid right score base_score n_known item_id distance match_start match_end lang source n_chars
_lodestone_id _lodestone_best""".split()

LONG = "word secret = abcdefgh " * 40_000
BASE = " ".join(f"b{n}" for n in range(70))
TEXTS = [(1, BASE), (2, BASE), (2, BASE), (3, BASE.replace("b30", "z")), (4, None), (5, ""), (None, "null id " + BASE[:90]), (6, LONG), (7, LONG), (8, "   "), (None, None), (9, "passage to find in here " * 3)]


def crowded(df, keep):
    """df with a column of another type under each name that it hasn't, texts and numbers in turn."""
    have = {c.lower() for c in df.columns} | set(keep)
    return df.select("*", *[(F.lit("clash") if i % 2 else F.lit(-1)).alias(c) for i, c in enumerate(dict.fromkeys(OWN)) if c.lower() not in have])


@pytest.fixture(scope="module")
def docs(spark):
    return written(spark.createDataFrame(TEXTS, "doc_id long, text string").repartition(2), "edges")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "passage to find in here"), (2, None), (None, "null id b0 b1")], "item_id long, text string")


@pytest.fixture(scope="module")
def marks(spark):
    return spark.createDataFrame([(1, 1), (2, 0), (3, 0), (4, 0), (None, 1), (6, None)], "doc_id long, toxic int").withColumn("text", F.lit("clash"))


def near(spark, docs, items, marks):
    return minhash.near_duplicates(docs)


def alone(spark, docs, items, marks):
    return minhash.without_copies(docs).select("doc_id", "text")


def contaminated(spark, docs, items, marks):
    return decontaminate.contaminated(docs, crowded(items, ()), **decontaminate.WHOLE)


def clean(spark, docs, items, marks):
    return decontaminate.clean(docs, items, **decontaminate.WHOLE).select("doc_id", "text")


def token_rows(spark, docs, items, marks):
    """Positions depend on the files; what is written doesn't."""
    folder = work_path(spark, "shards")
    found = shards.verified(spark, folder, shards.materialise(written(docs, "docs"), folder, seq_len=64, shard_rows=100))
    return found.agg(F.sum("n_tokens").alias("tokens"), F.countDistinct("slot").alias("slots"), F.count("*").alias("n"))


def secret(spark, docs, items, marks):
    found = secrets.scan_versions(docs, work_path(spark, "ledger"))
    return found.select("path", "blob", secrets.digest(["assign", "access", "hex"], F.col("found")).alias("found"))


def toxic(spark, docs, items, marks):
    return toxicity.score(docs, toxicity.fit(docs, crowded(marks, ()))).select("doc_id", F.round("toxic_score", 6).alias("score"))


def scored(spark, docs, items, marks):
    meta = lm.train(docs, folder := work_path(spark, "trie"))
    return lm.score(written(docs, "docs"), folder, meta).select("doc_id", "n_tokens", "n_known", F.round("base_score", 3).alias("base"), F.round("score", 3).alias("score"))


def mixed(spark, docs, items, marks):
    return mixing.mix(docs.withColumn("source", F.when(F.col("doc_id") < 4, "a"))).select("doc_id", "text", "mix_epoch", "mix_key")


OPERATORS = [near, alone, contaminated, clean, token_rows, secret, toxic, scored, mixed]


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("operator", OPERATORS, ids=lambda f: f.__name__)
def test_columns_with_the_operators_names(spark, docs, items, marks, operator):
    plain = rows(operator(spark, docs, items, marks))
    assert plain
    assert rows(operator(spark, crowded(docs, ()), items, marks)) == plain
    if operator not in (token_rows,):
        assert rows(operator(spark, crowded(docs, ()).limit(0), items, marks)) == []


def test_pages(spark):
    long = "x" * 300_000
    pages = spark.createDataFrame([(1, "http://a.com/en/1", "<p>"), (1, "http://a.com/en/1", "<p>"), (2, None, None), (None, f"http://{long}.com/en/", long), (3, "http://b.org/es/" + long, "")], "page_id long, url string, html string")
    rules = spark.createDataFrame([(r.host, r.path, r.verdict) for r in urls.RULES], "host string, path string, verdict string")
    judged = lambda df, r: rows(urls.judged(df, r).select("page_id", "url", "host", "path", "rule", "verdict"))
    assert judged(crowded(pages, ()), crowded(rules, ())) == judged(pages, rules)
    assert [r[5] for r in judged(pages, rules)].count("block") == 4

    def archived(df):
        warc.archive(df, at := work_path(spark, "archive"))
        return rows(warc.read_back(spark, at))

    assert archived(crowded(pages, ())) == archived(pages) and len(archived(pages)) == 5
    assert archived(crowded(pages, ()).limit(0)) == []


def test_vectors(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.01]), (2, [1.0, 0.01]), (3, None), (None, [1.0, 0.0]), (4, [0.0, 0.0])], "vec_id long, embedding array<double>")
    found = rows(embeddings.near_duplicate_vectors(vectors))
    assert rows(embeddings.near_duplicate_vectors(crowded(vectors, ()))) == found and len(found) == 6


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES, ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, docs, items, marks, tmp_path, name, stage):
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    marks.select("doc_id", F.lit(1).alias("quality"), "toxic").write.parquet(f"{tmp_path}/labels.parquet")
    full = written(docs.select("doc_id", "text", F.when(F.col("doc_id") > 3, "en").alias("lang"), F.when(F.col("doc_id") < 5, "s").alias("source"), F.char_length("text").cast("long").alias("n_chars")), "full")
    plain, more = (stage(spark, df, str(tmp_path)) for df in (full, written(crowded(full, ()), "crowded")))
    if name == "token_shards":
        assert plain.agg(F.sum("n_tokens")).first() == more.agg(F.sum("n_tokens")).first()
        assert {i for r in plain.collect() for i in r.doc_ids} == {r[0] for r in TEXTS}
    else:
        assert plain.columns == corpus_pipeline.COLUMNS and rows(plain) == rows(more)
        kept = {r[0] for r in rows(plain)}
        assert {4, 5, 8, None} <= kept if name != "mixing" else kept == {r[0] for r in TEXTS}
