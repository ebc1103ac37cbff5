"""The inverted index: scores against counting by hand, terms left out, new and changed texts, and how much is read."""

import random
import re
from collections import Counter

import pytest

from lodestone.operators.postings import Index, terms_of
from lodestone.sources.sinks import folder

VOCABULARY = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda omicron of".split()


def plain(docs, question):
    terms = terms_of(question)
    out = []
    for i, text in docs:
        n = Counter(re.findall(r"\w+", (text or "").lower()))
        hit = [t for t in terms if n[t]]
        if i is not None and hit:
            out.append((i, len(hit), sum(min(3, n[t]) for t in hit), round(sum(map(len, hit)) / sum(map(len, terms)), 9)))
    return sorted(out, key=lambda r: (-r[3], -r[1], -r[2], r[0]))


def made(seed, n):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choices(VOCABULARY, k=rng.randint(0, 12)))) for i in range(n)]


def frame(spark, docs):
    return spark.createDataFrame(docs, "id long, text string")


def tuples(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def built(spark):
    docs = [*made(1, 400), (400, None), (401, ""), (None, "alpha beta")]
    index = Index(spark, folder(spark, "index"))
    assert index.extend(frame(spark, docs)) == 402
    return index, docs


@pytest.mark.parametrize("question", ["alpha", "omicron lambda epsilon of", "Of of OF", "eta zeta nothing", "nothing here", "omicron a of eta iota zeta"])
@pytest.mark.parametrize("k", [1, 5, 1000])
def test_best_is_the_start_of_all(built, question, k):
    index, docs = built
    found, used = index.best(question, k)
    assert tuples(found) == plain(docs, question)[:k]
    assert k < 1000 or len(used) == len(terms_of(question))


def test_short_terms_are_left_out_where_long_ones_decide(spark, built):
    index, docs = built
    found, used = index.best("omicron epsilon of", 3)
    assert used == ["epsilon", "omicron"] and tuples(found) == plain(docs, "omicron epsilon of")[:3]
    few = [(i, t) for i, t in docs if i is not None and i % 50 == 0]
    found, used = index.best("omicron epsilon of", 3, frame(spark, few))
    assert tuples(found) == plain(few, "omicron epsilon of")[:3]


def test_only_new_texts_are_split(spark):
    docs = dict(made(2, 60))
    index = Index(spark, folder(spark, "index"))
    assert index.extend(frame(spark, list(docs.items()))) == 60
    docs |= {3: "alpha alpha alpha alpha changed", 60: "new text alpha"}
    del docs[7]
    assert index.extend(frame(spark, list(docs.items()))) == 2
    again = Index(spark, index.path).load()
    for one in (index, again):
        assert tuples(one.best("alpha changed lambda", 100)[0]) == plain(docs.items(), "alpha changed lambda")
    assert again.extend(frame(spark, list(docs.items()))) == 0
    docs[3] = dict(made(2, 60))[3]  # back to the first text: its first postings stay dead
    assert again.extend(frame(spark, list(docs.items()))) == 1
    assert tuples(again.best("alpha changed lambda", 100)[0]) == plain(docs.items(), "alpha changed lambda")


def rows_scanned(df):
    """Rows that left the scans of a plan."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    while plan.nodeName() == "AdaptiveSparkPlan":
        plan = plan.executedPlan()
    total, todo = 0, [plan]
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("Scan parquet"):
            total += node.metrics().apply("numOutputRows").value()
        children = node.children() if not node.nodeName().endswith("QueryStage") else None
        todo += [children.apply(i) for i in range(children.size())] if children is not None else [node.plan()]
    return total


def test_rows_read_do_not_grow_with_texts_that_lack_the_terms(spark):
    docs, other = made(3, 50), [(1000 + i, " ".join(f"w{i * 40 + j}" for j in range(40))) for i in range(5000)]
    small, large = (Index(spark, folder(spark, "index")) for _ in range(2))
    small.extend(frame(spark, docs))
    large.extend(frame(spark, docs + other))
    a, b = (rows_scanned(x.postings(["epsilon", "omicron"])) for x in (small, large))
    assert b <= a + 2 * 20_000 and tuples(small.best("epsilon omicron", 9)[0]) == tuples(large.best("epsilon omicron", 9)[0])
    assert large.spark.read.parquet(f"{large.path}/postings").count() > 200_000


def test_empty(spark):
    index = Index(spark, folder(spark, "index"))
    index.extend(frame(spark, []))
    assert tuples(index.best("alpha", 3)[0]) == [] == tuples(index.best("? !", 3)[0])


def test_words_are_counted_where_the_texts_are(spark, tmp_path, monkeypatch):
    from pyspark.sql import DataFrameWriter

    plans, write = [], DataFrameWriter.parquet

    def spied(self, path, *args, **kw):
        plans.append((path, self._df._jdf.queryExecution().executedPlan().toString()))
        return write(self, path, *args, **kw)

    monkeypatch.setattr(DataFrameWriter, "parquet", spied)
    index = Index(spark, f"file://{tmp_path}/index")
    index.extend(spark.createDataFrame([(1, "one two two"), (1, "two two"), (2, None), (3, "two")], "id long, text string"))
    plan = next(p for path, p in plans if path.endswith("/postings"))
    assert "rangepartitioning" not in plan and "hashpartitioning(term" not in plan  # words moved twice, and a range was sampled first
    assert sorted(tuple(r) for r in index.postings(["one", "two"]).collect()) == [("one", 1, 1), ("two", 1, 3), ("two", 3, 1)]
