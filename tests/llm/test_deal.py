"""Sharding: the laws, the order by content, places and numbers both ways, texts written in order."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import deal, registry
from lodestone.llm.common import work_path, written
from tests.oracle import connect, difference

SF = "/root/testdata/sf0.001"


def test_query_is_its_sql(spark):
    assert not difference(deal.op13_sharding(spark, SF), connect(SF), registry.ORACLES["op13_sharding"])


ROWS = [(i, f"text {i} é") for i in range(300)] + [(None, None), (None, ""), (7, "other"), (8, "x" * 500_000)] + [(5, "same")] * 400


@pytest.mark.parametrize("parts, files", [(1, 1), (4, 3), (7, 5)])
def test_laws_whatever_the_partitions(spark, parts, files):
    rows = random.Random(parts).sample(ROWS, len(ROWS))
    docs = written(spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("number", "hash", "id", "slot", "size")}).repartition(files), "docs")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        found = deal.dealt(docs, shards=9).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert Counter((r.id, r.size, r.text_crc32) for r in found) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in ROWS)
    slots = defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
    assert sorted(slots) == list(range(9)) and all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    by_content = sorted(found, key=lambda r: (r.id is not None, r.id or 0, r.hash))
    assert [r.number for r in sorted(found, key=lambda r: r.number)] == list(range(len(ROWS)))
    assert sorted((r.number, r.id, r.hash) for r in found if r.id is not None) == [(n, r.id, r.hash) for n, r in enumerate(by_content) if r.id is not None]
    places = sorted((str(r.id), r.text_crc32, r.shard, r.slot) for r in found)
    assert places == _first.setdefault("places", places)


_first = {}


def test_places_and_numbers_are_inverse():
    for size in (1, 2, 3, 40, 41, 1000, 65_537):
        n = np.arange(size)
        shard, slot = deal.place(n, size)
        assert (deal.number(shard, slot, size) == n).all()
        assert sorted(zip(shard.tolist(), slot.tolist(), strict=True)) == sorted((p % 40, p // 40) for p in range(size))
    shard, slot = deal.place(np.arange(1000), 1000)
    other = deal.place(np.arange(1000), 1000, key=1)
    assert (shard != other[0]).any() and (np.diff(slot * 40 + shard) == 1).sum() < 20


def test_shuffled_rows_are_written_whole(spark):
    docs = written(spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("slot", F.lit("clash")).withColumn("more", F.monotonically_increasing_id()), "docs")
    found = deal.materialise(docs, work_path(spark, "dealt"), shards=5)
    assert Counter((r.doc_id, r.text) for r in found.collect()) == Counter(ROWS)
    assert found.select("shard", "slot").distinct().count() == len(ROWS) and found.columns == ["doc_id", "text", "more", "shard", "slot"]


def test_empty_table(spark):
    assert deal.dealt(spark.createDataFrame([], "doc_id long, text string")).collect() == []
