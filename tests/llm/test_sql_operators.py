"""Operators that SQL can express: their queries against DuckDB, and the cases that the tables don't hold."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import embeddings, mixing, registry, secrets, shards, urls, warc
from lodestone.llm.common import work_path
from tests.oracle import connect, difference

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows_as_sql(spark, con, name):
    assert not difference(registry.QUERIES[name](spark, SF), con, registry.ORACLES[name])


def test_urls(spark):
    rows = [
        (1, "http://A.example.COM/en/7?x"), (2, "http://example.com/en/8"), (3, "com/en/"), (4, None), (5, "x://net/de/8"), (6, "ftp://a.example.net/de/8#f"),
        (7, "http://notcom/en/"), (8, "http://org"), (9, "http://x.org/es/"), (9, "http://x.org/es/"), (10, ""), (11, "http:///en/"), (12, "h://u\nv.com/en/ü"),
    ]
    rules = spark.createDataFrame([(r.host, r.path, r.verdict) for r in urls.RULES] + [(None, "/x", "block"), ("", "/", "block"), ("or", "g/es/", "block"), ("a/b.com", None, "block")], "host string, path string, verdict string")
    df = urls.judged(spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'k' AS key"), rules)
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in df.collect()}
    assert df.count() == 13
    assert found[1] == ("a.example.com", "/en/7", "example.com/en/7", "allow")
    assert found[2] == ("example.com", "/en/8", "com/en/", "block")
    assert found[3] == found[4] == found[10] == ("", "", None, "allow")
    assert found[5][2:] == ("net/de/", "allow") and found[6][2:] == ("example.net/de/8", "block")
    assert found[7][2:] == (None, "allow") and found[8][2:] == (None, "allow") and found[9][2:] == ("org/es/", "block")
    assert found[11][:2] == ("", "/en/") and found[12][2:] == ("com/en/", "block")
    assert urls.judged(df.limit(0).select("page_id", "url"), rules).count() == 0
    assert {r.verdict for r in urls.judged(df.select("page_id", "url"), rules.limit(0)).collect()} == {"allow"}


def test_archive_round_trip(spark):
    rows = [(5, "u1", "same"), (2, "u2\r\nX: y", "same"), (9, None, "same"), (1, "u", None), (3, "u", ""), (7, "u", "é\r\n\r\nWARC/1.1 é"), (7, "u", "é\r\n\r\nWARC/1.1 é"), (None, "n", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS digest", "2 AS first")
    path = work_path(spark, "archive")
    warc.archive(pages, path)
    found = sorted((tuple(r) for r in warc.read_back(spark, path).collect()), key=str)
    assert len(found) == 8
    kinds = {r[0]: (r[1], r[3], r[4]) for r in found}
    assert kinds[2] == (4, "response", None) and kinds[5] == (4, "revisit", 2) and kinds[9] == (4, "revisit", 2)
    assert kinds[1] == (0, "response", None) and kinds[3] == (0, "revisit", 1) and kinds[7][1] == "response" and kinds[None][1] == "response"
    import base64

    for r in found:
        text = next(h or "" for i, _, h in rows if i == r[0])
        assert r[2] == base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()
    records = warc.records(spark, path)
    assert sorted(bytes(r.payload) for r in records.collect()) == sorted((h or "").encode() for _, _, h in rows)
    for raw in (bytes(r.record) for r in records.collect()):
        head, _, block = raw.partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\n") and len(block) == int(re.search(rb"Content-Length: (\d+)", head)[1]) + 4
        fields, body = warc.opened(raw)
        assert block.startswith(b"HTTP/1.1 200 OK\r\n") and (fields["WARC-Type"] == "response" or not body)
        with pytest.raises(ValueError, match="length"):
            warc.opened(raw[:-5] + raw[-4:])
    folder = work_path(spark, "warc")
    files = warc.export(spark, path, folder).collect()
    whole = b"".join(shards.read_bytes(f"{folder}/{f.file}") for f in files)
    assert sum(f.records for f in files) == whole.count(b"WARC/1.1\r\nWARC-Type: ") == 8 and sum(f.bytes for f in files) == len(whole)
    assert spark.read.parquet(f"{path}/payloads").count() <= 4
    empty = work_path(spark, "archive")
    warc.archive(pages.limit(0), empty)
    assert warc.read_back(spark, empty).count() == 0


def python_spans(text):
    out = []
    for k, (name, pattern, group, least) in enumerate([("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6), ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24)]):
        out += [(m.start(), k, f"{name}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text) if len(m[group]) >= least]
    return [s for _, _, s in sorted(out)]


def test_secrets_and_ledger(spark):
    texts = ["password = 'hunter22' token:abc", "😀 Api_Key: \"ABCDEF123\" and apikey=12345", "AKIA" + "A" * 16 + " AKIA" + "B" * 15, "f" * 24 + "g" + "0" * 23, "passwordpassword=secret=abcdef token = token:tokens1", None, "", "x" * 200_000 + " secret=abcdef1", "password = 'hunter22' token:abc"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "secret: zzzzzzz"), (0, texts[0])]
    versions = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'b' AS blob", "1 AS kind")
    ledger = work_path(spark, "ledger")
    base = ["assign", "access", "hex"]

    def run(df):
        found = secrets.scan_versions(df, ledger)
        return {r.path: r.d for r in found.select("path", secrets.digest(base, found["found"]).alias("d")).collect()}

    found = run(versions)
    for i, t in rows:
        assert found[i] == ",".join(python_spans(t or "")), t
    size = spark.read.parquet(ledger).count()
    assert run(versions) == found and spark.read.parquet(ledger).count() == size  # nothing is scanned again
    run(spark.createDataFrame([(99, "secret = newsecret")], "doc_id long, text string"))
    assert spark.read.parquet(ledger).count() == size + len(secrets.RULES)
    assert run(versions.limit(0)) == {}
    newer = tuple(secrets.Rule(r.kind, r.pattern, r.group, r.least, 2 if r.kind == "hex" else r.version, r.base) for r in secrets.RULES)
    before, scanned = spark.read.parquet(ledger).count(), spark.read.parquet(ledger).selectExpr("count(DISTINCT blob)").first()[0]
    both = versions.select("doc_id", "text").union(spark.createDataFrame([(99, "secret = newsecret"), (100, "unseen " + "e" * 30)], "doc_id long, text string"))
    again = {r.path: r.d for r in secrets.scan_versions(both, ledger, newer).select("path", secrets.digest(base, F.col("found")).alias("d")).collect()}
    assert again == found | {99: "assign:0:18", 100: "hex:7:37"}  # a new version of one rule, and a new text for all rules, in one pass
    assert spark.read.parquet(ledger).count() == before + scanned + len(newer)


def test_many_secrets_in_one_text(spark):
    text = " ".join(["secret: abcdef0 x", "😀 " + "f" * 30, "AKIA" + "Z" * 20] * 3000)
    found = secrets.scan_versions(spark.createDataFrame([(1, text)], "doc_id long, text string"), work_path(spark, "ledger"))
    assert found.select(secrets.digest(["assign", "access", "hex"], F.col("found")).alias("d")).first().d == ",".join(python_spans(text))


def test_vectors(spark):
    import numpy as np

    r = np.random.default_rng(3)
    base = r.normal(size=(60, 16))
    near = base[:30] + r.normal(size=(30, 16)) * 0.05
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.vstack([base, near, base[:5], base[:5] * 3]))]
    odd = [(1000, None), (1001, [0.0] * 16), (1002, [math.nan] + [1.0] * 15), (1003, [math.inf] + [1.0] * 15), (1004, []), (1005, [None] + [1.0] * 15), (1006, [1.0] * 8), (None, [9.0] * 16)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").selectExpr("*", "'x' AS node", "1 AS hash")
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicate_vectors(df).collect()}
    x = np.array([v for _, v in rows])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.95) & ~np.eye(len(x), dtype=bool)
    low = np.arange(len(x))
    for _ in range(len(x)):
        low = np.minimum(low, np.where(links, low[None, :], len(x)).min(axis=1))
    for i in range(len(x)):
        assert found[i] == (int(links[i].sum()), int(low[i]), bool(low[i] == i))
    assert all(found[i] == (0, i, True) for i, _ in odd[:7])
    assert found[None][1:] == (None, True)
    assert embeddings.near_duplicate_vectors(df.limit(0)).count() == 0


def test_quantisation_bound():
    import numpy as np

    r = np.random.default_rng(1)
    a, b = embeddings.unit_rows(r.normal(size=(300, 48))), embeddings.unit_rows(r.normal(size=(200, 48)) * r.uniform(0, 5, 48))
    (qa, sa, ea), (qb, sb, eb) = embeddings.quantise(a), embeddings.quantise(b)
    guess = (qa.astype(float) @ qb.T) * sa[:, None] * sb[None, :]
    assert (np.abs(a @ b.T - guess) <= ea[:, None] + (1 + ea[:, None]) * eb[None, :]).all()


def test_mixing_targets(spark):
    rows = [(i, "big" if i < 900 else "mid" if i < 990 else None, "a b c") for i in range(1000)] + [(None, "big", None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "'e' AS epoch")
    facts = mixing.facts(docs, "doc_id", "source", "text")
    plan = {r.source: r for r in mixing.mixing_plan(facts, 1, max_repeats=4.0).collect()}
    total = sum(p.weight for p in plan.values())
    assert abs(total - 1) < 1e-9 and max(p.repeats for p in plan.values()) <= 4.0001
    assert abs(plan[""].repeats / plan["big"].repeats - 4) < 1e-6  # the limit is met
    target = 0.9
    flat = {r.source: r for r in mixing.mixing_plan(facts, 1, max_repeats=None, entropy=target).collect()}
    assert abs(-sum(p.weight * math.log(p.weight) for p in flat.values()) - target) < 1e-6
    budget = {r.source: r for r in mixing.mixing_plan(facts, 1, max_repeats=4.0, budget=2000.0).collect()}
    mixed = mixing.realise(docs, spark.createDataFrame(list(budget.values())), 1).selectExpr("coalesce(source, '') AS source", "size(split(coalesce(text, 'x'), ' ')) AS w")
    spent = {r.source: r.n for r in mixed.groupBy("source").count().withColumnRenamed("count", "n").collect()}
    for source, p in budget.items():
        assert abs(spent.get(source, 0) * 4 - p.weight * 2000) <= 8
    assert mixing.mix(docs).selectExpr("count(DISTINCT doc_id)").first()[0] == 1000  # nothing is left out
    assert mixing.mix(docs.limit(0)).count() == 0


def test_a_long_list_of_rules_is_joined_by_key_but_for_its_hot_rules(spark):
    """The same verdicts whether the rules are broadcast or joined, with a third of the urls null and most under one rule."""
    rows = [(i, None if i % 3 == 0 else f"http://a{i % 7}.com/en/{i}" if i % 5 else f"http://b{i}.org/x/{i}") for i in range(3000)]
    listed = [(r.host, r.path, r.verdict) for r in urls.RULES] + [(f"b{i}.org", f"/x/{i}", "block") for i in range(0, 3000, 10)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    rules = spark.createDataFrame(listed, "host string, path string, verdict string")
    short, long_ = (Counter(map(tuple, urls.judged(pages, rules, most=n).collect())) for n in (urls.MAX_BROADCAST, 0))
    assert short == long_ and sum(short.values()) == 3000
    assert sum(n for r, n in short.items() if r[-1] == "block") == sum(1 for _, u in rows if u and (".com/en/" in u or int(u.rpartition("/")[2]) % 10 == 0))


def test_vectors_whose_squares_overflow_or_vanish(spark):
    pairs = [(1, [1e200, 1e200]), (2, [1e200, 1.01e200]), (3, [1e-200, 1e-200]), (4, [1e-200, 1.01e-200]), (5, [5e-324, 0.0]), (6, [-1e308, 1e308]), (7, [math.inf, 1.0]), (8, [1.0, -1.0])]
    found = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicate_vectors(spark.createDataFrame(pairs, "vec_id long, embedding array<double>")).collect()}
    assert found == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 5: (0, 5), 6: (0, 6), 7: (0, 7), 8: (0, 8)}


@pytest.mark.parametrize("seed", range(5))
def test_forest_joins_what_links_join(seed):
    rng = np.random.default_rng(seed)
    i, j = rng.integers(0, 60, 80 * seed), rng.integers(0, 60, 80 * seed)
    groups = {n: {n} for n in {*i.tolist(), *j.tolist()}}
    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        if groups[x] is not groups[y]:
            groups[x] |= groups[y]
            for n in groups[y]:
                groups[n] = groups[x]
    tree = embeddings.forest(i, j)
    parts = len({id(g) for g in groups.values()})
    assert len(tree) == len(groups) - parts
    joined = {n: {n} for n in groups}
    for x, y in zip(i[tree].tolist(), j[tree].tolist(), strict=True):
        assert joined[x] is not joined[y]
        joined[x] |= joined[y]
        for n in joined[y]:
            joined[n] = joined[x]
