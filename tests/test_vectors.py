"""The index of vectors against sorting all cosines."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators.vectors import Cells
from lodestone.sources.sinks import folder


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, scope long, vector array<float>")


def plain(rows, queries, k, scopes=None):
    out = []
    good = [(i, np.array(v, np.float32).astype(float)) for i, s, v in rows if i is not None and v and np.isfinite(v).all() and any(v) and (scopes is None or s in scopes)]
    for q, u in queries:
        u = np.array(u, np.float32).astype(float)
        found = sorted((-round(float(v @ u / np.sqrt((v @ v) * (u @ u))), 9), i) for i, v in good)[:k]
        out += [(q, i, -s, n) for n, (s, i) in enumerate(found, 1)]
    return sorted(out)


def clusters(n, size=16, groups=20, seed=0, spread=0.1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, size))
    return [(i, i % 3, (centres[i % groups] + spread * rng.normal(size=size)).astype(np.float32).tolist()) for i in range(n)]


ODD = [(None, 0, [1.0] * 16), (9001, 0, None), (9002, 0, [0.0] * 16), (9003, 0, [float("nan")] + [1.0] * 15), (9004, 0, [])]


@pytest.fixture(scope="module")
def built(spark):
    rows = clusters(3000) + [(5000 + i, 1, [0.5] * 16) for i in range(1500)] + ODD  # more equal vectors than a tile holds
    return Cells(spark, folder(spark, "cells")).build(frame(spark, rows).repartition(5), cells=24), rows


@pytest.mark.parametrize("k, scopes", [(1, None), (7, [1, 2]), (60, None)])
def test_nearest(spark, built, k, scopes):
    cells, rows = built
    queries = [(i, v) for i, _, v in rows[:3000:97]] + [(8000, [0.5] * 16), (8001, (-np.array(rows[5][2])).tolist())]
    found = cells.search(spark.createDataFrame(queries, "query long, vector array<float>"), k, scopes).select("query", "id", "score", "rank")
    assert sorted(map(tuple, found.collect())) == plain(rows, queries, k, scopes)


def test_cells_are_skipped(spark, built):
    cells, rows = built
    queries = spark.createDataFrame([(i, v) for i, _, v in rows[:3000:97]], "query long, vector array<float>")
    to_beat = cells.search(queries, 5).where("rank = 5").select("query", F.col("score").alias("to_beat"))
    opened = {r.query: r.cells for r in cells.opened(queries, 5, to_beat).collect()}
    assert sum(opened.get(i, 0) for i, _, _ in rows[:3000:97]) < 0.2 * 24 * len(rows[:3000:97])


def test_bounds_hold_without_clusters(spark):
    rng = np.random.default_rng(5)
    rows = [(i, 0, rng.normal(size=8).astype(np.float32).tolist()) for i in range(700)]
    cells = Cells(spark, folder(spark, "cells")).build(frame(spark, rows))
    queries = [(i, v) for i, _, v in rows[::50]]
    assert sorted(map(tuple, cells.search(spark.createDataFrame(queries, "query long, vector array<float>"), 9).collect())) == plain(rows, queries, 9)


def test_empty_and_few(spark):
    none = Cells(spark, folder(spark, "cells")).build(frame(spark, ODD))
    few = Cells(spark, folder(spark, "cells")).build(frame(spark, clusters(3)))
    queries = spark.createDataFrame([(1, [1.0] * 16), (2, None), (3, [1.0])], "query long, vector array<float>")
    assert none.search(queries, 3).collect() == []
    assert sorted(map(tuple, few.search(queries, 9).collect())) == plain(clusters(3), [(1, [1.0] * 16)], 9)

