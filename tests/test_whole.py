"""Queries that cover every row of their tables, by plain Python."""

import re
import shutil

from pyspark.sql import functions as F

from lodestone import catalog
from lodestone.views import table

SF = "/root/testdata/sf0.001"


def test_every_document_is_tokenised_and_looked_up(spark):
    docs = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    found = {r.doc_id: r.tokens for r in catalog.QUERIES["tokenize"](spark, SF).collect()}
    assert found.keys() == docs.keys()
    ascii_only = [i for i, t in docs.items() if t and t.isascii()]
    assert ascii_only and all(found[i] == re.findall("[a-z0-9]+", docs[i].lower()) for i in ascii_only)
    first = {}
    for i in sorted(docs):
        first.setdefault(docs[i], i)
    hits = {r.doc_id: r.hit for r in catalog.QUERIES["cache_lookup"](spark, SF).collect()}
    assert hits == {i: t is not None and first[t] < i for i, t in docs.items()}
    same = {(i % 2, first[t] % 2) for i, t in docs.items() if hits[i]}
    assert same & {(0, 0), (1, 1)}  # copies of one parity are hits


def test_streams_read_tables_of_many_files(spark, tmp_path):
    events = table(spark, SF, "events")
    events.coalesce(1).write.parquet(f"{tmp_path}/once")
    (one := tmp_path / "file").mkdir()
    shutil.copy(next((tmp_path / "once").glob("part-*.parquet")), one / "events.parquet")
    many = tmp_path / "folder"
    ages = events.withColumn("ts", F.col("ts") - F.expr("make_dt_interval(20 * (event_id % 70))"))
    ages.repartitionByRange(70, F.col("event_id") % 70).write.parquet(f"{many}/events.parquet")
    assert len(list((many / "events.parquet").glob("part-*.parquet"))) > 64
    for at in (one, many):
        stored = {r.event_id: r for r in table(spark, str(at), "events").collect()}
        get = lambda name, at=at: catalog.QUERIES[name](spark, str(at)).collect()
        assert get("schedules")[0].n == len(stored)
        assert sorted(r.event_id for r in get("dedup_stream")) == sorted(stored)
        assert sum(r.n for r in get("heartbeat_state")) == sum(r.n for r in get("tumbling_window")) == len(stored)
        assert sum(r.n for r in get("sliding_window")) == 2 * len(stored)
        assert all({r.event_id for r in get(x)} == stored.keys() for x in ("rate_fixed_window", "token_bucket"))


def test_chunks_leave_in_slices():
    import pyarrow as pa

    from lodestone.operators import chunking

    texts = ["word " * 100_000, None, "", "a b", "end " * 100_000]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(texts)], names=["id", "text"])
    slices = list(chunking.chunker(1000, 200, chunking.PLAIN)(iter([batch] * 4)))
    assert len(slices) == 4 and {b.num_columns for b in slices} == {3}
    many = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array([texts[0]] * 8)], names=["id", "text"])
    slices = list(chunking.chunker(1000, 200, chunking.PLAIN)(iter([many])))
    assert len(slices) >= 4 and max(sum(map(len, b.column(2).to_pylist())) for b in slices) < 2 * chunking.SLICE
    assert [(r["id"], r["number"], r["chunk"]) for b in slices for r in b.to_pylist()] == [(i, n, c) for i in range(8) for n, c in enumerate(chunking.recursive_chunks(texts[0], 1000, 200, chunking.PLAIN))]


def test_vectors_meet_centres_in_slices(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from lodestone.operators import vectors

    rows = np.random.default_rng(1).normal(size=(2000, 8))
    centres, seen, angles = vectors.units(rows[:50]), [], vectors.angles
    monkeypatch.setattr(vectors, "angles", lambda a, b: seen.append(len(a)) or angles(a, b))
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000)), pa.array([0] * 2000), pa.array(rows.tolist())], names=["id", "scope", "vector"])
    found = [c for b in vectors.placed(centres)(iter([batch])) for c in b.column(3).to_pylist()]
    assert found == angles(vectors.units(rows), centres).argmin(axis=1).tolist() and max(seen) <= 512


def test_small_files_share_a_task():
    from lodestone.sources import pages

    files = [(i, f"f{i}", 1000) for i in range(6400)] + [(7000, "large", 100_000_000)]
    found = pages.groups(files)
    assert [p for g in found for p in g.paths] == [f for _, f, _ in files] and 2 <= len(found) < 100
    assert pages.groups([]) == [] and len(pages.groups(files[:64])) == 64
