"""As-of joins, sketches and table functions against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone import catalog
from lodestone.operators import asof
from lodestone.operators.functions import register

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_last_before(spark, width):
    rng = random.Random(width)
    left = [(i, rng.choice(["a", "b", None]), rng.randrange(200)) for i in range(300)]
    right = [(rng.choice(["a", "b", "c"]), rng.randrange(200), n) for n in range(40)]
    found = asof.last_before(spark.createDataFrame(left, "id int, k string, t int"), spark.createDataFrame(right, "k string, t int, v int"), ["k"], "t", "v", F.floor(F.col("t") / width))
    want = {i: max(((t2, v) for k2, t2, v in right if k2 == k and t2 <= t), default=(0, None))[1] for i, k, t in left}
    assert {r.id: r.v for r in found.collect()} == want


def test_sketches_merge(spark):
    rng = random.Random(1)
    rows = [(i % 7, rng.gauss(0, 1)) for i in range(20_000)]
    daily = asof.sketched(spark.createDataFrame(rows, "day int, x double"), ["day"], "x")
    got = asof.merged(daily.withColumn("all", F.lit(1)), ["all"]).select(*[asof.quantile(q).alias(f"q{i}") for i, q in enumerate((0.01, 0.5, 0.99))]).first()
    ordered = sorted(x for _, x in rows)
    for q, value in zip((0.01, 0.5, 0.99), got, strict=True):
        assert abs(sum(x <= value for x in ordered) / len(ordered) - q) <= asof.RANK_ERROR
    assert daily.limit(0).count() == 0


def test_chunks_from_sql(spark):
    lateral, plain = (sorted(map(tuple, catalog.QUERIES[n](spark, SF).collect())) for n in ("chunk_lateral", "chunk_recursive"))
    assert lateral == plain
    register(spark)
    assert spark.sql("SELECT * FROM chunk_text(CAST(NULL AS STRING), 10, 2, true)").collect() == []
