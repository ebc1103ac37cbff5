"""Near-duplicate documents against brute force over all pairs."""

import random
import re

import numpy as np

from lodestone.llm import minhash
from lodestone.llm.common import components, table, word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def shingles(text, k):
    w = WORD.findall(lower(text or ""))
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(rows, k, percent=80):
    sets = [(i, shingles(t, k)) for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = root(i), root(j)
                parent[max(p, q)] = min(p, q)
    return sorted(((i, len(s), root(i) if i is not None else None, i is None or root(i) == i) for i, s in sets), key=str)


def texts():
    r = random.Random(5)
    words = [f"w{n}" for n in range(400)]
    out = []
    for n in range(40):
        base = [r.choice(words) for _ in range(r.choice([3, 8, 30, 80, 200]))]
        out.append(" ".join(base))
        for rate in (0.0, 0.02, 0.05, 0.1):
            out.append(" ".join(r.choice(words) if r.random() < rate else w for w in base))
    common = [r.choice(words) for _ in range(100)]
    for _ in range(60):  # one large group of near copies
        copy = list(common)
        copy[r.randrange(100)] = r.choice(words)
        out.append(" ".join(copy))
    return out + ["", "   ", None, "One", "one", "ONE two", "one TWO", "é É", "x" * 5000, " ".join(["same"] * 500)]


def rows_of(df):
    return sorted(map(tuple, df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)


def test_same_groups_as_brute_force(spark):
    rows = [(i * 3 % 1009, t) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for k in (2, 5):
        assert rows_of(minhash.near_duplicates(docs, shingle=k)) == brute(rows, k)


def test_recall_over_every_stored_document(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for k, found in ((2, minhash.op1_minhash_near_dedup(spark, "/root/testdata/sf0.01")), (5, minhash.near_duplicates(docs))):
        want = brute(rows, k)
        assert sum(not r[3] for r in want) > 20 and rows_of(found) == want  # recall and precision of 1


def test_nulls_repeats_and_other_columns(spark):
    base = " ".join(f"a{n}" for n in range(30))
    rows = [(1, base, 0), (1, base, 1), (2, base + " z", 2), (None, base, 3), (4, None, 4), (4, "", 5), (9, " ".join(f"b{n}" for n in range(30)), 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_shingles long").withColumnRenamed("n_shingles", "sig")
    found = rows_of(minhash.near_duplicates(docs))
    assert [r[0] for r in found].count(1) == 2 and len(found) == 7
    assert {r[2] for r in found if r[0] in (1, 2)} == {1}
    assert all(r[2] is None and r[3] for r in found if r[0] is None)
    assert all(r[3] for r in found if r[0] in (4, 9))


def test_empty_table(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_word_hashes_cross_blocks():
    text = "Ab cd " * 300_000
    assert len(word_hashes(text)) == 600_000
    assert len(np.unique(word_hashes(text))) == 2
    assert list(word_hashes("AB\tx")) == list(word_hashes("ab x"))
    assert len(word_hashes("y" * 3_000_000)) == 1


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "a long, b long")
    found = dict(map(tuple, components(edges).collect()))
    assert found == {i: 0 for i in range(201)} | {500: 500, 501: 500}
    assert components(edges.limit(0)).count() == 0
