"""Chunks by meaning: they join to the text, and topics are told apart."""

from pyspark.sql import functions as F

from lodestone.operators import semantic
from lodestone.views import table


def test_chunks_join_to_the_text(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").select(F.col("doc_id").alias("id"), "text")
    joined = {}
    for r in semantic.chunked(docs).orderBy("id", "chunk_index").collect():
        joined.setdefault(r.id, []).append(r.chunk)
    texts = {r.id: r.text for r in docs.collect() if r.text}
    assert {i: "".join(c) for i, c in joined.items()} == texts
    assert all(len(x) >= semantic.LEAST for c in joined.values() if len(c) > 1 for x in c)


def test_topics_are_told_apart(spark):
    cats = " ".join(f"The cat sat with other cats near the cat door {w}." for w in ("today", "again", "later", "soon", "then", "now"))
    rates = " ".join(f"Bond yields rose as central banks lifted interest rates {w}." for w in ("sharply", "mildly", "twice", "fast", "slowly", "once"))
    rows = spark.createDataFrame([(1, f"{cats} {rates}"), (2, None), (3, ""), (4, "One short text."), (5, "\n\n")], "id int, text string")
    found = {}
    for r in semantic.chunked(rows).orderBy("id", "chunk_index").collect():
        found.setdefault(r.id, []).append(r.chunk)
    assert found[4] == ["One short text."] and found[5] == ["\n\n"] and set(found) == {1, 4, 5}
    assert any(c.startswith("Bond") or "Bond" not in c for c in found[1]) and len(found[1]) >= 2


def test_signs_that_cancel_divide_nothing(spark):
    words = spark.range(4000).select(F.concat(F.lit("w"), "id").alias("word"))
    found = {}
    for r in semantic.hashed(words, ["word"]).collect():
        place = next(i for i, x in enumerate(r.vector) if x)
        found.setdefault((place, r.vector[place]), r.word)
    place = next(p for p, sign in found if sign > 0 and (p, -1.0) in found)
    text = f"{found[place, 1.0]} {found[place, -1.0]}."
    rows = spark.createDataFrame([(1, f"{text} {text} {text}")], "id int, text string")
    assert [r.chunk for r in semantic.chunked(rows).collect()] == [f"{text} {text} {text}"]
