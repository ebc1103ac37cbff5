"""Token ids in training order: fixed-stride binary shards placed by a keyed permutation.

Each input partition is one stream of tokens, every document followed by the end token, cut into
sequences of seq_len; the last is filled up with end tokens. Sequence i of partition p has the number
p * 2**40 + i, and its position is P(number), where P is a Feistel network on the least even number of bits
that holds partitions * 2**40, applied again while its value lies outside (cycle-walking): a permutation
that needs no table, can be inverted, and needs no count of the sequences beforehand, so texts are tokenised
once. Positions are range-partitioned into shards, some shards to a task; a sequence's global slot is its place among all in
order of position: the slot its shard starts at, and its row there. Row r of a shard is at byte r * stride, and
reading may begin or resume at any slot; the shards' starts are a table beside them.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections import deque
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import filesystem, mix, put, table, work_path, written

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern of the vocabulary's words, and its end token: fixed values.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END = 50256
DTYPE = np.dtype("<u2")
PER_PART = 1 << 40  # sequences a partition may have
BYTES_PER_TOKEN = 3  # of text, about: it only sets how many shards there are
TASKS = 20_000  # that write shards, before one writes more than one


class Tokenizer:
    """Token bytes of texts."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("shards", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str | None) -> bytes:
        return self.encoding.encode_to_numpy(text).astype(DTYPE).tobytes() if text else b""


@lru_cache(2)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


class Permutation:
    """A keyed permutation of 0..size-1."""

    def __init__(self, size: int, key: int, rounds: int = 4):
        self.size, self.half = size, max(1, -(-max(1, (size - 1).bit_length()) // 2))
        self.keys = np.random.default_rng(key).integers(0, 2**64, rounds, np.uint64)
        self.mask = np.uint64((1 << self.half) - 1)

    def _network(self, x: np.ndarray, keys) -> np.ndarray:
        left, right = x >> np.uint64(self.half), x & self.mask
        for k in keys:
            left, right = right, left ^ (mix(right + k) & self.mask)
        return right << np.uint64(self.half) | left  # halves swapped, so the reversed keys invert it

    def _walk(self, x: np.ndarray, keys) -> np.ndarray:
        x = self._network(np.asarray(x, np.uint64), keys)
        while (out := np.flatnonzero(x >= np.uint64(self.size))).size:
            x[out] = self._network(x[out], keys)
        return x.astype(np.int64)

    def positions(self, index: np.ndarray) -> np.ndarray:
        return self._walk(index, self.keys)

    def numbers(self, position: np.ndarray) -> np.ndarray:
        return self._walk(position, self.keys[::-1])


SEQUENCES = "position long, sequence long, n_tokens int, doc_ids array<long>, tokens binary"


def make_sequences(path: str, seq_len: int, parts: int, key: int):
    """Sequences of a partition with their positions."""

    def run(batches):
        tokens, permutation, stride = tokenizer(path), Permutation(parts * PER_PART, key), seq_len * DTYPE.itemsize
        at, end = TaskContext.get().partitionId() * PER_PART, np.array([END], DTYPE).tobytes()
        buffer, owners = bytearray(), deque()  # owners: (document, its tokens' bytes still in the buffer)

        def cut(force: bool):
            nonlocal at
            rows, begin = [], 0
            while len(buffer) - begin >= stride or force and len(buffer) > begin:
                piece = bytes(buffer[begin : begin + stride])
                left, ids = len(piece), []
                while left:
                    doc, n = owners[0]
                    ids.append(doc)
                    if n > left:
                        owners[0] = (doc, n - left)
                        left = 0
                    else:
                        owners.popleft()
                        left -= n
                rows.append((at, len(piece) // DTYPE.itemsize, ids, piece + end * ((stride - len(piece)) // DTYPE.itemsize)))
                at += 1
                begin += stride
            del buffer[:begin]
            if rows:
                index, n, ids, data = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(permutation.positions(np.array(index))), pa.array(index, pa.int64()), pa.array(n, pa.int32()), pa.array(ids, pa.list_(pa.int64())), pa.array(data, pa.binary())], names=["position", "sequence", "n_tokens", "doc_ids", "tokens"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = tokens(text.as_py()) + end
                buffer += data
                owners.append((doc, len(data)))
                if len(buffer) >= 2_000_000:
                    yield from cut(False)
        yield from cut(True)

    return run


def write_shards(folder: str, width: int):
    """Writes each shard of a partition sorted by position, and returns where every sequence is."""

    def run(batches):
        shard, parts = None, []

        def close():
            if parts:
                put(f"{folder}/shard-{shard:08d}.bin", parts)
                parts.clear()

        for batch in batches:
            rows, crcs, own = [], [], (batch.column(0).to_numpy() // width).tolist()
            for s, data in zip(own, batch.column(4), strict=True):
                if s != shard:
                    close()
                    shard = s
                rows.append(len(parts))
                parts.append(raw := data.as_py())
                crcs.append(zlib.crc32(raw))
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(rows, pa.int64()), *batch.columns[1:4], pa.array(crcs, pa.int64())], names=["shard", "row", "sequence", "n_tokens", "doc_ids", "crc"])
        close()

    return run


def materialise(docs: DataFrame, folder: str, seq_len: int = 512, shard_rows: int = 4096, key: int = 2024, tokenizer_path: str = TOKENIZER, id_col: str = "doc_id", text_col: str = "text", tasks: int = TASKS) -> DataFrame:
    """Writes docs as shards under folder (shared storage) and returns the index: slot, shard, row, sequence, n_tokens, doc_ids, crc.

    docs must be a scan of a stored table, which gives the same partitions each time, so a repeated task
    makes the same sequences. Shards have about shard_rows sequences. Null and empty texts are one end
    token; null ids stay null in doc_ids; repeated rows are written as often as they come; an empty
    table gives a meta.json and no shards.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(0))).first()[0]
    parts = max(1, rows.rdd.getNumPartitions())
    shards = max(1, size // (BYTES_PER_TOKEN * seq_len * shard_rows))
    width = -(-parts * PER_PART // shards)
    sequences = rows.mapInArrow(make_sequences(tokenizer_path, seq_len, parts, key), SEQUENCES)
    each = -(-shards // tasks)  # shards a task writes
    placed = sequences.repartitionById(-(-shards // each), F.expr(f"CAST(position div {width * each} AS INT)")).sortWithinPartitions("position")
    stored_rows = written(placed.mapInArrow(write_shards(folder, width), "shard long, row long, sequence long, n_tokens int, doc_ids array<long>, crc long"), "index")
    counts = stored_rows.groupBy("shard").agg(F.count("*").alias("n")).withColumn("range", F.floor(F.col("shard") / each))
    starts, total = [], 0
    longest = 0
    for row in counts.groupBy("range").agg(F.sum("n").alias("n"), F.max("n").alias("longest")).orderBy("range").collect():  # two numbers a task
        starts.append((row["range"], total))
        total += row["n"]
        longest = max(longest, row["longest"])
    ranges = F.broadcast(spark.createDataFrame(starts, "range long, first long"))
    before = F.sum("n").over(Window.partitionBy("range").orderBy("shard")) - F.col("n")
    places = counts.withColumn("before", before).join(ranges, "range").select("shard", (F.col("first") + F.col("before")).alias("start"), "n")
    places.repartitionByRange("shard").sortWithinPartitions("shard").write.parquet(f"{folder}/starts")
    put(f"{folder}/meta.json", [json.dumps({"sequences": total, "seq_len": seq_len, "shards": shards, "longest": longest, "dtype": DTYPE.str, "end": END, "key": key, "partitions": parts}).encode()])
    first = spark.read.schema("shard long, start long, n long").parquet(f"{folder}/starts")
    return stored_rows.join(first, "shard").select((F.col("start") + F.col("row")).alias("slot"), "shard", "row", "sequence", "n_tokens", "doc_ids", "crc")


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """Every row as it stands in the shards: shard, row, byte_offset, tokens (binary)."""
    meta = json.loads(read_bytes(f"{folder}/meta.json"))
    stride = meta["seq_len"] * np.dtype(meta["dtype"]).itemsize

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw, shard = data.as_py(), int(re.search(r"shard-(\d+)", name)[1])
                n = len(raw) // stride
                at = np.arange(n, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, shard, np.int64)), pa.array(at), pa.array(at * stride), pa.array([raw[i * stride : (i + 1) * stride] for i in range(n)], pa.binary())], names=["shard", "row", "byte_offset", "tokens"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder).select("path", "content")
    return files.mapInArrow(run, "shard long, row long, byte_offset long, tokens binary")


def read_bytes(uri: str, offset: int = 0, length: int | None = None) -> bytes:
    store, path = filesystem(uri)
    with store.open_input_file(path) as f:
        f.seek(offset)
        return f.read(length) if length is not None else f.read()


def read_slots(folder: str, first: int, count: int) -> np.ndarray:
    """Sequences first..first+count-1 as rows of token ids, read by offset: how a loader starts or resumes."""
    from pyarrow import parquet

    meta = json.loads(read_bytes(f"{folder}/meta.json"))
    dtype = np.dtype(meta["dtype"])
    stride, stop, out = meta["seq_len"] * dtype.itemsize, min(first + count, meta["sequences"]), []
    store, path = filesystem(f"{folder}/starts")
    found = parquet.read_table(path, filesystem=store, filters=[("start", "<", stop), ("start", ">", first - meta["longest"])]) if first < stop else None
    for shard, start, n in sorted(zip(*(found.column(c).to_pylist() for c in ("shard", "start", "n")), strict=True)) if found else ():
        low, high = max(first, start), min(stop, start + n)
        if low < high:
            out.append(read_bytes(f"{folder}/shard-{shard:08d}.bin", (low - start) * stride, (high - low) * stride))
    return np.frombuffer(b"".join(out), dtype).reshape(-1, meta["seq_len"])


def verified(spark: SparkSession, folder: str, index: DataFrame) -> DataFrame:
    """The index with the place of each sequence, after its bytes were read back and compared by checksum."""
    back = stored(spark, folder).select("shard", "row", "byte_offset", F.crc32("tokens").alias("read"))
    wrong = F.raise_error(F.concat(F.lit("stored sequence differs at slot "), F.col("slot").cast("string")))
    joined = index.join(back, ["shard", "row"], "left")
    return joined.select("slot", "shard", "byte_offset", "sequence", "n_tokens", "doc_ids", F.when(F.col("read") == F.col("crc"), F.col("crc")).otherwise(wrong).alias("crc"))


def op4_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_path(spark, "shards")
    index = materialise(table(spark, sf_dir, "documents"), folder)
    return verified(spark, folder, index)
