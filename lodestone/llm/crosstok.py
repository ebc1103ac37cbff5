"""Aligning the tokens of two tokenizers: groups of tokens that cover the same bytes, and how often ids meet.

The byte offsets at which tokens of A end and those at which tokens of B end are two sorted lists. Their merging is
cut into pieces of equal work by binary searches along diagonals (merge path): the first d ends of the merged order
are i ends of A and d - i of B for exactly one i, found without merging. A piece needs its own slices only; it emits
the groups that begin and end inside, and what it holds before its first common end and after its last is stitched
to the neighbours'. A piece holds PIECE ends, so a text's length does not matter for what is held beside its tokens.

A document's pairs are kept as packed ids, counted over the corpus by key; at most a million pairs make up
a millionth of all rows or more each, and these go to every task; the others, none of which is a hot key, are joined.
"""

from __future__ import annotations

import base64
import hashlib
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written
from .shards import PATTERN

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_BPE = "/opt/tokenizers/piece_bpe_32k.model"
PIECE = 1 << 16  # ends of A and B together in a piece
DENSE = 1 << 12  # pairs of a group, above which its equal ids are counted before they are paired
SHARE = 1_000_000  # a pair with this part of all rows or more goes to every task: no more than so many can
KEY_BITS = 32


def printable_bytes() -> dict[str, int]:
    """The characters by which a byte-level vocabulary writes bytes: printable Latin-1 as itself, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class ByteBpe:
    """Ids and byte lengths of a byte-level BPE file. Where its merges are numbered in their order, as here, the faster
    library gives the same ids; it splits and merges slices of the text, so their bytes always join to it."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            content = json.load(f)
        special = {x["id"] for x in content["added_tokens"]}
        of = printable_bytes()
        ranks = {bytes(of[c] for c in word): i for word, i in content["model"]["vocab"].items() if i not in special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in content["model"]["merges"]]
        made = [content["model"]["vocab"]["".join(m)] for m in merges]
        if made != sorted(made) or len(made) + 256 != len(ranks):
            raise ValueError(f"{path}: ids do not follow the order of merges")
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for word, i in ranks.items():
            self.bytes[i] = word
        self.lengths = np.array([len(x) for x in self.bytes], np.int64)

    def __call__(self, text: str) -> np.ndarray:
        return np.array(self.encoding.encode_ordinary(" " + text), np.int64)


class PieceBpe:
    """Ids and byte lengths of a piece BPE file with byte fallback, which puts a space before the text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(self.model.get_piece_size())
        self.bytes = [bytes([int(p[3:-1], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, self.model.id_to_piece(i)) for i in ids)]
        self.lengths = np.array([len(x) for x in self.bytes], np.int64)

    def __call__(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text), np.int64)


@lru_cache(2)
def tokenizers(path_a: str, path_b: str) -> tuple[ByteBpe, PieceBpe]:
    return ByteBpe(path_a), PieceBpe(path_b)


def encoded(text: str | None, a: ByteBpe, b: PieceBpe) -> tuple[np.ndarray, np.ndarray] | None:
    """Both token lists of a text; None if it is null or empty or if either's bytes are not a space and the text."""
    if not text:
        return None
    data = b" " + text.encode("utf-8", "surrogatepass")
    ids_a, ids_b = a(text), b(text)
    if a.lengths[ids_a].sum() != len(data) or b"".join(map(b.bytes.__getitem__, ids_b.tolist())) != data:
        return None
    return ids_a, ids_b


def merge_path(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """How many ends of a are among the first 0, size, 2 * size, ... and all of the merged ends (a first among equals)."""
    d = np.append(np.arange(0, len(a) + len(b), size), len(a) + len(b))
    low, high = np.maximum(d - len(b), 0), np.minimum(d, len(a))
    while (open_ := low < high).any():
        mid = (low + high) // 2
        at = np.minimum(mid, len(a) - 1), np.clip(d - mid - 1, 0, len(b) - 1)
        more = open_ & (a[at[0]] <= b[at[1]])
        low, high = np.where(more, mid + 1, low), np.where(open_ & ~more, mid, high)
    return low


def piece(a: np.ndarray, b: np.ndarray, before: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Sizes in tokens of a piece's groups on both sides, the last of them open, and its number of common ends.

    before is the end of a just ahead of the piece: its equal in b may be this piece's first.
    """
    cuts = b[np.isin(b, np.append(a, before), assume_unique=True)] if len(a) < 64 else b[_found(a, b, before)]
    n = len(cuts)
    return np.bincount(np.searchsorted(cuts, a), minlength=n + 1), np.bincount(np.searchsorted(cuts, b), minlength=n + 1), n


def _found(a: np.ndarray, b: np.ndarray, before: int) -> np.ndarray:
    at = np.searchsorted(a, b)
    return (a[np.minimum(at, len(a) - 1)] == b) | (b == before)


def groups(ids_a: np.ndarray, ends_a: np.ndarray, ids_b: np.ndarray, ends_b: np.ndarray, size: int = PIECE):
    """Runs of whole groups in order: ids of a, their number in each group, ids of b, their number in each group.

    Each run comes from one piece, its first group completed by what earlier pieces left open.
    """
    split = merge_path(ends_a, ends_b, size)
    left_a, left_b = [], []
    for k in range(len(split) - 1):
        i, stop = split[k], split[k + 1]
        j, last = k * size - i, min((k + 1) * size, len(ids_a) + len(ids_b)) - stop
        na, nb, n = piece(ends_a[i:stop], ends_b[j:last], ends_a[i - 1] if i else -1)
        ia, ib = stop - na[n], last - nb[n]
        left_a.append(ids_a[i : ia if n else stop])
        left_b.append(ids_b[j : ib if n else last])
        if n:
            a, b = np.concatenate(left_a), np.concatenate(left_b)
            na[0] += len(a) - na[:n].sum()
            nb[0] += len(b) - nb[:n].sum()
            yield a, na[:n], b, nb[:n]
            left_a, left_b = [ids_a[ia:stop]], [ids_b[ib:last]]


def linked(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different id pairs (a << 32 | b) that share a group, in order, and how often they do."""
    dense = na * nb > DENSE
    found, times = [], []
    if dense.any():
        stop_a, stop_b = np.cumsum(na), np.cumsum(nb)
        for g in np.flatnonzero(dense):
            (ua, ca), (ub, cb) = (np.unique(x[stop[g] - n[g] : stop[g]], return_counts=True) for x, n, stop in ((a, na, stop_a), (b, nb, stop_b)))
            found.append((ua[:, None] << KEY_BITS | ub).ravel())
            times.append((ca[:, None] * cb).ravel())
        a, b = a[~np.repeat(dense, na)], b[~np.repeat(dense, nb)]
        na, nb = na[~dense], nb[~dense]
    each = np.repeat(nb, na)  # of every token of a, the tokens of b in its group
    first = np.repeat(np.cumsum(nb) - nb, na)
    other = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each - first, each)
    found.append(np.repeat(a, each) << KEY_BITS | b[other])
    times.append(np.ones(len(other), np.int64))
    return summed(np.concatenate(found), np.concatenate(times))


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys in order and the sums of their numbers."""
    if not len(keys):
        return keys, n
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(n, first)


@lru_cache(1)
def names(size_a: int, size_b: int) -> np.ndarray:
    """Each id with the sign after it, inside a group or at its end, padded with NUL."""
    return np.array([f"{i}{sign}" for n, signs in ((size_a, ",|"), (size_b, ",;")) for i in range(n) for sign in signs], "S")


def rendered(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray, size_a: int, size_b: int) -> bytes:
    """A run of groups as a1,a2|b1;a3|b2,b3; with a sign after the last one too."""
    codes = np.empty(len(a) + len(b), np.int64)
    ga, gb = np.repeat(np.arange(len(na)), na), np.repeat(np.arange(len(nb)), nb)
    last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    last_a[np.cumsum(na) - 1] = last_b[np.cumsum(nb) - 1] = 1
    codes[np.arange(len(a)) + (np.cumsum(nb) - nb)[ga]] = 2 * a + last_a
    codes[np.arange(len(b)) + np.cumsum(na)[gb]] = 2 * (size_a + b) + last_b
    return names(size_a, size_b)[codes].tobytes().translate(None, b"\0")


def packed(keys: np.ndarray) -> bytes:
    """Ordered keys as the four planes of the differences of their 32-bit forms (ids of b below 2**15), which compress well."""
    short = ((keys >> KEY_BITS) << 15 | keys & 0x7FFF).astype(np.uint32)
    return np.diff(short, prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    short = np.cumsum(np.frombuffer(data, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel(), dtype=np.int64)
    return (short >> 15) << KEY_BITS | short & 0x7FFF


ALIGNED = "row long, id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, keys binary, times binary"


def align_texts(path_a: str, path_b: str, size: int):
    """One row per document with its sums, the digest of its groups and its packed pairs."""

    def run(batches):
        a, b = tokenizers(path_a, path_b)
        if len(a.bytes) > 1 << 17 or len(b.bytes) > 1 << 15:
            raise ValueError("ids do not fit packed keys")
        for batch in batches:
            rows = []
            for row, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if (ids := encoded(text.as_py(), a, b)) is None:
                    rows.append((row, doc, 0, 0, 0, 0, "", b"", b""))
                    continue
                digest, n_groups, n_links, ahead = hashlib.sha256(), 0, 0, b""
                keys, times = np.empty(0, np.int64), np.empty(0, np.int64)
                for run_ in groups(ids[0], np.cumsum(a.lengths[ids[0]]), ids[1], np.cumsum(b.lengths[ids[1]]), size):
                    text_ = rendered(*run_, len(a.bytes), len(b.bytes))
                    digest.update(ahead + text_[:-1])
                    ahead = text_[-1:]
                    n_groups += len(run_[1])
                    n_links += int((run_[1] * run_[3]).sum())
                    more = linked(*run_)
                    keys, times = summed(np.concatenate([keys, more[0]]), np.concatenate([times, more[1]])) if len(keys) else more
                rows.append((row, doc, len(ids[0]), len(ids[1]), n_groups, n_links, digest.hexdigest(), packed(keys), times.astype("<i8").reshape(-1, 1).view(np.uint8).T.tobytes()))
                if len(rows) == 1000:
                    yield as_batch(rows)
                    rows = []
            if rows:
                yield as_batch(rows)

    return run


_KINDS = [pa.int64()] * 6 + [pa.string(), pa.binary(), pa.binary()]
_NAMES = [x.split()[0] for x in ALIGNED.split(", ")]


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=_NAMES)


def times_of(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(8, -1).T.copy().view("<i8").ravel()


def source_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))


def align(docs: DataFrame, path_a: str = BYTE_BPE, path_b: str = PIECE_BPE, piece_size: int = PIECE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: row, id, n_a, n_b, n_groups, n_links, groups_sha256 and its packed id pairs (keys, times).

    Texts that are null or empty, or that the tokens of either side do not spell, have no tokens: zeros, '' and no
    pairs. Repeated rows and null ids count as documents of their own; an empty table gives no rows; other columns
    of docs do not matter.
    """
    return source_rows(docs, id_col, text_col).mapInArrow(align_texts(path_a, path_b, piece_size), ALIGNED)


def token_groups(docs: DataFrame, path_a: str = BYTE_BPE, path_b: str = PIECE_BPE, piece_size: int = PIECE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The groups themselves: row, id, group (from 0), start and stop in bytes of a space and the text, ids of A and of B.

    Rows come out piece by piece, so no text's groups are held at once; texts without tokens give no rows.
    """

    def run(batches):
        a, b = tokenizers(path_a, path_b)
        for batch in batches:
            for row, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                ids, at, number = encoded(text.as_py(), a, b), 0, 0
                for ia, na, ib, nb in groups(ids[0], np.cumsum(a.lengths[ids[0]]), ids[1], np.cumsum(b.lengths[ids[1]]), piece_size) if ids else ():
                    stops = at + np.cumsum(a.lengths[ia])[np.cumsum(na) - 1]
                    lists = [pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(x, pa.int64())) for x, n in ((ia, na), (ib, nb))]
                    m = len(na)
                    yield pa.RecordBatch.from_arrays([pa.array([row] * m, pa.int64()), pa.array([doc] * m, pa.int64()), pa.array(np.arange(number, number + m)), pa.array(np.append(at, stops[:-1])), pa.array(stops), *lists], names=["row", "id", "group", "start", "stop", "a_ids", "b_ids"])
                    at, number = int(stops[-1]), number + m

    return source_rows(docs, id_col, text_col).mapInArrow(run, "row long, id long, group long, start long, stop long, a_ids array<long>, b_ids array<long>")


def count_pairs(batches):
    """How many documents hold each key, summed up within the task whenever two million more came in."""
    keys, n, more = np.empty(0, np.int64), np.empty(0, np.int64), []

    def out():
        for at in range(0, len(keys), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + 100_000]), pa.array(n[at : at + 100_000])], names=["key", "n"])

    for batch in batches:
        for data in batch.column(0):
            if len(data.as_buffer()):
                more.append(unpacked(data.as_py()))
        if sum(map(len, more)) > 2_000_000:
            keys, n = summed(np.concatenate([keys, *more]), np.concatenate([n, np.ones(sum(map(len, more)), np.int64)]))
            more = []
            if len(keys) > 4_000_000:
                yield from out()
                keys, n = keys[:0], n[:0]
    keys, n = summed(np.concatenate([keys, *more]), np.concatenate([n, np.ones(sum(map(len, more)), np.int64)]))
    yield from out()


def pair_counts(aligned: DataFrame) -> DataFrame:
    """a_id, b_id, key, n_documents of every pair that a row of aligned holds."""
    counted = aligned.select("keys").mapInArrow(count_pairs, "key long, n long").groupBy("key").agg(F.sum("n").alias("n_documents"))
    return counted.select(F.shiftright("key", KEY_BITS).alias("a_id"), F.col("key").bitwiseAND(2**KEY_BITS - 1).alias("b_id"), "key", "n_documents")


def known_sums(common):
    """Sums over a document's common pairs, and its other pairs one by one (n_best and count_sum null) beside them."""

    def run(batches):
        keys, n, best = common.value
        for batch in batches:
            rows, sums, pairs = batch.column(0).to_numpy(), np.zeros((2, batch.num_rows), np.int64), []
            for i, (data, times) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                if not data:
                    continue
                own, m = unpacked(data), times_of(times)
                at = np.searchsorted(keys, own)  # keys end with one above all others
                hit = keys[at] == own
                sums[0, i], sums[1, i] = (m * best[at])[hit].sum(), (m * n[at])[hit].sum()
                if not hit.all():
                    pairs.append((np.full((~hit).sum(), rows[i]), own[~hit], m[~hit]))
            nothing = pa.nulls(batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(rows), nothing, nothing, pa.array(sums[0]), pa.array(sums[1])], names=_SUMS)
            if pairs:
                row, key, m = map(np.concatenate, zip(*pairs, strict=True))
                nothing = pa.nulls(len(row), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(key), pa.array(m), nothing, nothing], names=_SUMS)

    return run


_SUMS = ["row", "key", "m", "n_best", "count_sum"]


def scored(aligned: DataFrame, counts: DataFrame, share: int = SHARE) -> DataFrame:
    """aligned (a stored table) with n_best and count_sum from counts (a stored table of pair_counts).

    The highest count of an A id is one number per id of its vocabulary. Pairs with a share of 1/share of all rows or
    more, at most share many, reach all tasks; the others are joined by key, and no such key has a larger share.
    """
    spark = aligned.sparkSession
    total = counts.agg(F.sum("n_documents")).first()[0] or 0
    top = counts.groupBy("a_id").agg(F.max("n_documents").alias("top"))
    marked = counts.join(F.broadcast(top), "a_id").select("key", "n_documents", (F.col("n_documents") == F.col("top")).cast("long").alias("best"))
    is_common = F.col("n_documents") * F.lit(share) >= F.lit(total)
    found = marked.where(is_common).toArrow()
    keys, n, best = (np.append(found.column(i).to_numpy(), end) for i, end in enumerate((np.iinfo(np.int64).max, 0, 0)))
    order = np.argsort(keys)
    common = spark.sparkContext.broadcast((keys[order], n[order], best[order]))
    parts = written(aligned.select("row", "keys", "times").mapInArrow(known_sums(common), ", ".join(f"{x} long" for x in _SUMS)), "pair-sums")
    rest = parts.where("key IS NOT NULL").join(marked.where(~is_common), "key").select("row", (F.col("m") * F.col("best")).alias("n_best"), (F.col("m") * F.col("n_documents")).alias("count_sum"))
    sums = parts.where("key IS NULL").select("row", "n_best", "count_sum").union(rest).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return aligned.drop("keys", "times").join(sums, "row")


def op12_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = written(align(table(spark, sf_dir, "documents")), "aligned")
    counts = written(pair_counts(aligned), "pairs")
    return scored(aligned, counts).select(F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
