"""What the operators share: work folders, tables that cut lineage, token words, connected components."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space; only A-Z is lower-cased.
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, which a cluster must set; a temporary one in local runs."""
    if not (base := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.conf.get("spark.master", "").startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='lodestone-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/lodestone/{name}-{uuid.uuid4().hex}"


ROWS_PER_FILE = 200_000


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back: the lineage ends there and survives lost executors.

    rows, where a bound or an estimate is known, keeps a small table to a few files, one for each core at least.
    """
    spark, schema = df.sparkSession, df.schema
    if rows is not None:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, -(-rows // ROWS_PER_FILE)))
    df.write.parquet(path := work_path(spark, name))
    return spark.read.schema(schema).parquet(path)


def crc_fold(column: str, parts: int):
    """crc32 of the id as text, modulo parts."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(parts))


def components(edges: DataFrame, max_rounds: int = 60, rows: int | None = None) -> DataFrame:
    """Connected components of edges (a, b): one row (node, component) per node, component being its smallest node.

    Alternates large-star and small-star steps until the edges no longer change; each step is an
    aggregation and a join, and each round is written to the shared folder. Only a count and a
    checksum come to the driver. No edges: no rows. rows bounds the edges, where it is known.
    """
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", rows)
    seen = None
    for _ in range(max_rounds):
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = written(small.union(low.select("a", "m")).distinct(), "edges", seen[0] if seen else rows)  # a round makes no edges more
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())


def filesystem(uri: str):
    """pyarrow's file system and path of a shared URI, for tasks that write or map binary files."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else "file://" + uri[5:])


def put(uri: str, parts) -> None:
    """Writes a file under another name and then renames it: a repeated task leaves one whole file."""
    store, path = filesystem(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    with store.open_output_stream(own := f"{path}.{uuid.uuid4().hex}") as out:
        for part in parts:
            out.write(part)
    with contextlib.suppress(FileNotFoundError, OSError):
        if store.get_file_info(path).type.name == "File":
            store.delete_file(path)
    store.move(own, path)


_P = 0x9E3779B97F4A7C15  # odd, and 5 modulo 8: powers of it stay apart in the high bits
_MASK = 2**64 - 1
_BLOCK = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_BYTE = np.random.default_rng(7).integers(0, 2**64, 256, np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, base, np.uint64)]), dtype=np.uint64)


_POWER, _BACK = _powers(_P, _BLOCK), _powers(pow(_P, -1, 2**64), _BLOCK)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word of a text, A-Z lower-cased; none for a null text.

    A word's hash is a polynomial over random values of its bytes, taken for all words at once from
    running sums; texts are read in blocks that end at white space.
    """
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    if len(data) <= _BLOCK:
        return _block_hashes(data)
    out, at = [], 0
    while at < len(data):
        end = min(at + _BLOCK, len(data))
        if end < len(data):
            cut = max(data.rfind(x, at, end) for x in (b" ", b"\t", b"\n", b"\v", b"\f", b"\r"))
            if cut > at:
                end = cut + 1
            else:  # one word fills the block: take it whole
                ends = [i for x in (b" ", b"\t", b"\n", b"\v", b"\f", b"\r") if (i := data.find(x, end)) >= 0]
                end = min(ends, default=len(data))
        out.append(_block_hashes(data[at:end]))
        at = end
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _block_hashes(data: bytes) -> np.ndarray:
    if not data:
        return np.empty(0, np.uint64)
    raw = np.frombuffer(data, np.uint8)
    n = len(raw)
    power, back = (_POWER, _BACK) if n <= _BLOCK else (_powers(_P, n), _powers(pow(_P, -1, 2**64), n))
    word = np.empty(n + 2, bool)
    word[0] = word[-1] = False
    np.logical_not(_SPACE[raw], out=word[1:-1])
    edges = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = edges[::2], edges[1::2]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[raw] * power[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


# A blocked Bloom filter of 64-bit hashes: all bits of a hash lie in one block of 512.
BLOOM_WORDS, BLOOM_PROBES, BLOOM_BITS = 8, 6, 12


def bloom_blocks(n: int) -> int:
    return max(1, -(-n * BLOOM_BITS // (64 * BLOOM_WORDS)))


def bloom_positions(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Block, words and bits of each hash's probes."""
    block = ((h >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    probe = mix(h)[:, None] >> (np.arange(BLOOM_PROBES, dtype=np.uint64) * np.uint64(9)) & np.uint64(511)
    return block.astype(np.int64), (probe >> np.uint64(6)).astype(np.int64), np.uint64(1) << (probe & np.uint64(63))


def bloom_hits(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    block, word, bit = bloom_positions(h, len(bits))
    return (bits[block[:, None], word] & bit != 0).all(axis=1)


def bloom_filter(hashes: DataFrame, blocks: int) -> np.ndarray:
    """The filter of hashes (h long): each task fills blocks of its own, and equal blocks are joined by OR on the cluster.

    Only the filter comes to the driver; the caller bounds blocks.
    """

    def part(batches):
        bits = np.zeros((blocks, BLOOM_WORDS), np.uint64)
        for batch in batches:
            if batch.num_rows:
                block, word, bit = bloom_positions(batch.column(0).to_numpy().view(np.uint64), blocks)
                np.bitwise_or.at(bits, (block[:, None], word), bit)
        used = np.flatnonzero(bits.any(axis=1))
        for at in range(0, len(used), 10_000):
            rows = used[at : at + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(rows), *[pa.array(bits[rows, w].view(np.int64)) for w in range(BLOOM_WORDS)]], names=["block", *[f"w{w}" for w in range(BLOOM_WORDS)]])

    parts = hashes.select("h").mapInArrow(part, "block long, " + ", ".join(f"w{w} long" for w in range(BLOOM_WORDS)))
    joined = parts.groupBy("block").agg(*[F.bit_or(f"w{w}").alias(f"w{w}") for w in range(BLOOM_WORDS)])
    out = np.zeros((blocks, BLOOM_WORDS), np.uint64)
    for row in joined.toLocalIterator():
        out[row[0]] = np.array(row[1:], np.int64).view(np.uint64)
    return out
