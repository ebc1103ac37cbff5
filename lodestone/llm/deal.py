"""A reproducible shuffle into shards: a keyed permutation of global row numbers.

Rows are numbered 0..N-1 in the order of id and content, so the numbers depend on the rows alone and not on the files or
partitions that hold them. The row with the number x goes to the position P(x) of a Feistel network that is applied again while
its value is outside 0..N-1 (cycle-walking), and position p is slot p // shards of shard p % shards: shards differ by one row
at most and their slots have no gaps. Number, shard and slot follow from each other by arithmetic alone, both ways.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written
from .shards import Permutation

SHARDS = 40
KEY = 1313
ROUNDS = 4
EXTRA = 16  # bytes of a row beside its text
PART_BITS = 33  # of the row number that monotonically_increasing_id gives within a partition


def place(number: np.ndarray, size: int, shards: int = SHARDS, key: int = KEY) -> tuple[np.ndarray, np.ndarray]:
    """Shard and slot of row numbers, of size rows in all."""
    position = Permutation(size, key, ROUNDS).positions(number)
    return position % shards, position // shards


def number(shard: np.ndarray, slot: np.ndarray, size: int, shards: int = SHARDS, key: int = KEY) -> np.ndarray:
    """Row numbers at places: what a reader needs to find the rows of a shard, from any slot on."""
    return Permutation(size, key, ROUNDS).numbers(np.asarray(slot) * shards + shard)


def facts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, size, text_crc32, the text's MD5, and the row's place in the scan, which only tells apart rows that are equal."""
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(data) + EXTRA).cast("long").alias("size"),
        F.crc32(data).cast("long").alias("text_crc32"),
        F.md5(data).alias("hash"),
        F.monotonically_increasing_id().alias("scan"),
    )


def numbered(rows: DataFrame) -> tuple[DataFrame, int]:
    """rows (of facts) with number, their place in the order of id (nulls first) and content, and how many there are.

    A range shuffle of these few columns sorts them; the sorted rows are stored, and one count per partition, summed up
    here, tells where each partition begins. Equal rows, however many, are split by their place in the scan, which
    changes nothing but which of them has which number.
    """
    order = ["id", "hash", "scan"]
    ranged = rows.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order]).sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in order])
    ranged = written(ranged.withColumn("at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("at", PART_BITS)
    counts = dict(ranged.groupBy(part.alias("part")).count().collect())  # one number a partition
    starts, total = [], 0
    for p in sorted(counts):
        starts.append((p, total))
        total += counts[p]
    first = ranged.sparkSession.createDataFrame(starts, "part long, start long")
    inside = F.col("at").bitwiseAND(F.lit((1 << PART_BITS) - 1))
    return ranged.withColumn("part", part).join(F.broadcast(first), "part").select(*rows.columns, (F.col("start") + inside).alias("number")), total


def dealt(docs: DataFrame, shards: int = SHARDS, key: int = KEY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32, hash, scan, number, shard, slot of every row of docs.

    Null texts count as empty ones (size 16); null ids come first; equal rows each have a place of their own; an empty
    table gives no rows; other columns of docs do not matter. Texts are read once and not shuffled.
    """
    rows = written(facts(docs, id_col, text_col), "facts")
    counted, total = numbered(rows)

    def run(batches):
        for batch in batches:
            shard, slot = place(batch.column(batch.schema.get_field_index("number")).to_numpy(), total, shards, key)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard), pa.array(slot)], names=[*batch.schema.names, "shard", "slot"])

    columns = ["id", "size", "text_crc32", "hash", "scan", "number"]
    kind = rows.schema["id"].dataType.simpleString()
    return counted.select(columns).mapInArrow(run, f"id {kind}, " + ", ".join(f"{c} {'string' if c == 'hash' else 'long'}" for c in [*columns[1:], "shard", "slot"]))


def materialise(docs: DataFrame, folder: str, shards: int = SHARDS, key: int = KEY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes docs (a scan of a stored table) as Parquet under folder, sorted by shard and slot, and returns it read back.

    Partitions are ranges of (shard, slot), so a shard of any size is written by as many tasks as it takes and each file
    holds a run of slots. A row meets its place by its position in the scan; a row that is another one by then is an error.
    Columns _lodestone_* are reserved; shard and slot replace columns of docs with these names.
    """
    places = written(dealt(docs, shards, key, id_col, text_col).select(F.col("scan").alias("_lodestone_scan"), F.col("hash").alias("_lodestone_hash"), F.col("shard").alias("_lodestone_shard"), F.col("slot").alias("_lodestone_slot")), "places")
    rows = docs.withColumn("_lodestone_scan", F.monotonically_increasing_id()).withColumn("_lodestone_own", F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
    kept = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    moved = F.raise_error(F.lit("docs must be a scan of a stored table: its rows have moved"))
    joined = rows.join(places, "_lodestone_scan").withColumn("shard", F.when(F.col("_lodestone_own") == F.col("_lodestone_hash"), F.col("_lodestone_shard")).otherwise(moved.cast("long"))).withColumn("slot", F.col("_lodestone_slot"))
    joined.select(*kept, "shard", "slot").repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.parquet(folder)
    return docs.sparkSession.read.parquet(folder)


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dealt(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"), "number")


def _mixed(h: str) -> str:
    """common.mix in SQL, modulo 2**64."""
    for _ in range(2):
        h = f"(((xor({h}, {h} >> 32))::UHUGEINT * {0xD6E8FEB86659FD93}::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT"
    return f"xor({h}, {h} >> 32)"


def _rounds() -> str:
    """Nested queries, one for a round: n, x, lo and hi become those after it."""
    sql = "SELECT n, half, size, step, x >> half AS lo, x & ((1::UBIGINT << half) - 1) AS hi FROM w WHERE step = 0 OR x >= size"
    for k in np.random.default_rng(KEY).integers(0, 2**64, ROUNDS, np.uint64).tolist():
        h = f"((hi::UHUGEINT + {k}::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT"
        sql = f"SELECT n, half, size, step, hi AS lo, xor(lo, {_mixed('h')} & ((1::UBIGINT << half) - 1)) AS hi FROM (SELECT *, {h} AS h FROM ({sql}))"
    return sql


ORACLE = f"""
WITH RECURSIVE d AS (SELECT doc_id, encode(coalesce(text, '')) AS data, row_number() OVER (ORDER BY doc_id NULLS FIRST, md5(coalesce(text, ''))) - 1 AS n FROM documents),
c AS (SELECT count(*)::UBIGINT AS size, greatest(1, (length(bin(greatest(count(*) - 1, 1))) + 1) // 2) AS half FROM documents),
w AS (SELECT n::UBIGINT AS n, half, size, 0 AS step, n::UBIGINT AS x FROM d, c
    UNION ALL SELECT n, half, size, step + 1, (hi << half) | lo FROM ({_rounds()})),
p AS (SELECT n, x::BIGINT AS position FROM w WHERE step > 0 AND x < size),
t AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
b AS (SELECT doc_id, n, octet_length(data)::BIGINT + {EXTRA} AS size, list_prepend(4294967295, list_transform(range(octet_length(data)), lambda i: ('0x' || substr(hex(data), 2 * i + 1, 2))::BIGINT)) AS bytes FROM d)
SELECT doc_id, b.size, xor(list_reduce(bytes, lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1])), 4294967295)::BIGINT AS text_crc32, 'rows' AS law,
    (position % {SHARDS})::INT AS shard, position // {SHARDS} AS slot, NULL::INT AS grown_shard, n::BIGINT AS number
FROM b JOIN p USING (n), t"""
