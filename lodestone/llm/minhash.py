"""Near-duplicate documents by MinHash signatures and a multi-index Hamming join.

A document's set of word shingles gives one signature: chunks * width slots of 16 bits, which make
the index, and `extra` slots of 8 bits, which only sharpen the distance. Two signatures that differ
in at most chunks * (errors + 1) - 1 of the index slots agree, by pigeonhole, in all but `errors`
slots of some chunk; each chunk is therefore indexed under every choice of the slots left out, and
equal keys give every pair under that distance. At similarity 0.8 a slot differs with probability
0.2, so with the defaults 6 of a million pairs at exactly 0.8 share no key (fewer above).

Sets that are equal are one class before anything else, and buckets with equal members one bucket. In
a bucket every member is first compared with the smallest one, then all outside the largest component
with one more member of it: pairs in proportion to the bucket's size, which join large groups
of near copies. Then the members outside a bucket's largest component are compared with all members of other
components: signatures are packed into blocks, each pair of blocks is one row, and only pairs whose
signatures are near leave the tasks. Every link is confirmed on the full sets.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLOOM_WORDS, WORD, bloom_blocks, bloom_filter, bloom_hits, components, table, word_hashes, written

MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; fewer words than width are one shingle, none are no set."""
    h = word_hashes(text)
    if not len(h):
        return h
    k = min(width, len(h))
    n = len(h) - k + 1
    acc = h[:n].copy()
    for j in range(1, k):
        acc ^= acc >> np.uint64(31)
        acc *= MIX
        acc += h[j : j + n]
    acc ^= acc >> np.uint64(29)
    acc *= MIX
    acc ^= acc >> np.uint64(32)
    return np.unique(acc)


def coefficients(slots: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    return r.integers(0, 2**64, slots, np.uint64) | np.uint64(1), r.integers(0, 2**64, slots, np.uint64)


def minima(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Signatures of non-empty sets: rows of 16-bit slots."""
    joined = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), len(a)), np.uint16)
    for i in range(len(a)):
        out[:, i] = np.minimum.reduceat(joined * a[i] + b[i], starts) >> np.uint64(16) & np.uint64(0xFFFF)
    return out


def sign(width: int, index_slots: int, extra: int, seed: int):
    def run(batches):
        a, b = coefficients(index_slots + extra, seed)
        for batch in batches:
            fps, counts, sigs, group, size = [], [], [], [], 0

            def flush(sigs=sigs, group=group):
                if group:
                    slots = minima(group, a, b)
                    sigs.extend(x.tobytes() + y.tobytes() for x, y in zip(slots[:, :index_slots], slots[:, index_slots:].astype(np.uint8), strict=True))
                    group.clear()

            for x in batch.column(1):
                s = shingle_hashes(x.as_py(), width)
                counts.append(len(s))
                fps.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                if len(s):
                    group.append(s)
                    size += len(s)
                if not len(s) or size > 30_000:
                    flush()
                    size = 0
                if not len(s):
                    sigs.append(b"")
            flush()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fps, pa.binary()), pa.array(counts, pa.int64()), pa.array(sigs, pa.binary())], names=["id", "version", "fp", "n", "sig"])

    return run


def sets_of(width: int):
    def run(batches):
        for batch in batches:
            found = [np.sort(shingle_hashes(x.as_py(), width).view(np.int64)) for x in batch.column(1)]
            ends = np.cumsum([0] + [len(x) for x in found]).astype(np.int32)
            values = np.concatenate(found) if found else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], names=["id", "set"])

    return run


def choices(chunks: int, width: int, errors: int) -> list[tuple[int, ...]]:
    """The index slots of each key: every chunk with every choice of `errors` slots left out."""
    return [tuple(c * width + s for s in left) for c in range(chunks) for left in combinations(range(width), width - errors)]


def keys(slots: list[tuple[int, ...]]):
    each = [F.struct(F.lit(k).alias("k"), F.xxhash64(F.lit(k), F.concat(*[F.substring("sig", 2 * s + 1, 2) for s in chosen])).alias("key")) for k, chosen in enumerate(slots)]
    return F.explode(F.array(*each))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept. Parameters are those of judged.

    component_id is the smallest id reachable by links. Null or empty texts have an empty set, are linked with
    nothing and kept. Rows with a null id get a null component and are kept. Rows that repeat an id are one node,
    linked by the links of any of their texts. Other columns of docs are ignored; an empty table gives no rows.
    """
    return judged(docs, id_col, text_col, **parameters).drop("fp", "version")


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """The rows of docs, with all their columns, that have the smallest id of their component; near_duplicates tells what a component is.

    Of rows with that id all different shingle sets stay, of equal sets one row: the one whose text has the smallest hash.
    Rows without an id count as having one made of their text, above all others, so their copies go too. Rows
    without words stay, however often they come. Texts are joined by id and hash of the text.
    """
    own = {"_lodestone_id": F.coalesce(F.col(id_col).cast("long"), F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64(text_col), 2)), "_lodestone_version": F.xxhash64(text_col)}
    worded = F.coalesce(F.col(text_col).rlike(WORD), F.lit(False))
    named = docs.where(worded).withColumns(own)
    found = judged(named, "_lodestone_id", text_col, **parameters).where("kept")
    kept = written(found.groupBy(F.col("doc_id").alias("_lodestone_id"), "fp").agg(F.min("version").alias("_lodestone_version")).drop("fp"), "kept")
    rows = named.join(kept, list(own), "left_semi").dropDuplicates(list(own))
    return rows.select(docs.columns).union(docs.where(~worded))


def judged(docs: DataFrame, id_col: str, text_col: str, shingle: int = 5, percent: int = 80, chunks: int = 9, width: int = 5, errors: int = 1, extra: int = 166, max_distance: int = 90, seed: int = 20240229) -> DataFrame:
    """near_duplicates' columns, and of each row the hash of its text (version) and the digest of its set (fp).

    Links: 100 * |intersection| >= percent * |union| of the shingle sets. max_distance is the signature distance of the
    last comparison, of 211 slots: at similarity 0.8 or more, fewer than one pair in 10**12 differs in more than 90.
    """
    least = -(-percent // (100 - percent)) if percent < 100 else 1 << 62  # smaller sets are linked only if equal
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signer = sign(shingle, chunks * width, extra, seed)
    signed = written(texts.withColumn("version", F.xxhash64("text")).mapInArrow(signer, "id long, version long, fp binary, n long, sig binary"), "signatures")
    classes = written(signed.where("n > 0 AND id IS NOT NULL").groupBy("fp", "n", "sig").agg(F.min("id").alias("rep")), "classes")
    chosen = choices(chunks, width, errors)
    n = classes.count()
    most = n * len(chosen)  # rows of the index

    keyed = classes.where(F.col("n") >= least).select("rep", keys(chosen).alias("x")).select("rep", "x.k", "x.key")
    held = keyed.groupBy("key").agg(F.min("k").alias("k"), F.min("rep").alias("hub"), F.max("rep").alias("top"), F.count("*").alias("c"), F.bit_xor(F.xxhash64("rep")).alias("x")).where("hub <> top")
    hubs = held.groupBy("hub", "top", "c", "x").agg(F.min(F.struct("k", "key")).alias("least")).select("least.key", "hub")
    buckets = written(keyed.join(hubs, "key").select("key", "k", "rep", "hub"), "buckets", most)
    stars = buckets.where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    comps = components(confirmed(written(stars, "stars", most), texts, shingle, percent, n), rows=most)

    second = written(further(buckets, comps, most), "second", most)
    comps = joined(comps, confirmed(second, texts, shingle, percent, n), n)
    near = written(across(buckets, comps, classes, chosen, percent, max_distance, most), "across")
    placed = joined(comps, confirmed_in_tiles(near, texts, shingle, percent, n), n).toDF("rep", "component_id")

    labelled = classes.join(placed, "rep", "left").select("fp", F.coalesce("component_id", "rep").alias("component_id"))
    out = signed.select("id", "version", "n", F.when(F.col("n") > 0, F.col("fp")).alias("fp")).join(labelled, "fp", "left")
    out = out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"), "fp", "version")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


TILE_OUT, TILE_ALL = 128, 512


def joined(comps: DataFrame, links: DataFrame, n: int) -> DataFrame:
    """Components (node, component), joined by links (a, b) between nodes, of which there are n at most."""
    ends = links.join(comps.toDF("a", "ca"), "a", "left").join(comps.toDF("b", "cb"), "b", "left")
    final = components(ends.select(F.coalesce("ca", "a"), F.coalesce("cb", "b")).toDF("a", "b")).toDF("component", "low")
    old = comps.join(final, "component", "left").select("node", F.coalesce("low", "component").alias("component"))
    new = final.join(comps.select("node"), F.col("component") == F.col("node"), "left_anti")
    return written(old.union(new.select("component", "low")), "components", n)


def in_components(buckets: DataFrame, comps: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Members but for their bucket's smallest, which all are compared with: (key, k, rep, comp); and per bucket of several components
    its members c, those of the largest component, its name main and one member of it, centre."""
    rest = buckets.where("rep <> hub").join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    placed = written(rest.select("key", "k", "rep", F.coalesce("component", "rep").alias("comp")), "placed", most)
    sizes = placed.groupBy("key", "comp").agg(F.count("*").alias("c"), F.min_by("rep", F.xxhash64("rep")).alias("centre"))
    largest = F.max_by(F.struct("comp", "centre"), F.struct("c", "comp"))
    mixed = sizes.groupBy("key").agg(F.sum("c").alias("c"), F.max("c").alias("most"), largest.alias("main"), F.count("*").alias("comps")).where("comps > 1")
    return placed, mixed.select("key", "c", "most", F.col("main.comp").alias("main"), "main.centre")


def further(buckets: DataFrame, comps: DataFrame, most: int) -> DataFrame:
    """Pairs (a, b) of the members outside their bucket's largest component with one member of it."""
    placed, mixed = in_components(buckets, comps, most)
    pairs = placed.join(mixed, "key").where("comp <> main")
    return pairs.select(F.least("centre", "rep").alias("a"), F.greatest("centre", "rep").alias("b")).distinct()


def across(buckets: DataFrame, comps: DataFrame, classes: DataFrame, chosen: list[tuple[int, ...]], percent: int, max_distance: int, most: int) -> DataFrame:
    """Members of one bucket, of different components, whose signatures are within max_distance.

    Of each bucket, the members outside its largest component meet all members in tiles of about
    TILE_OUT by TILE_ALL, each side one block of signatures. Rows (key, o, t, rep, partners): per tile, one for each
    member that has a partner in it or is one. A pair is listed only in the first bucket that holds both, so once.
    """
    placed, mixed = in_components(buckets, comps, most)
    tiles = mixed.select("key", "main", F.ceil((F.col("c") - F.col("most")) / TILE_OUT).cast("int").alias("outs"), F.ceil(F.col("c") / TILE_ALL).cast("int").alias("alls"))
    # a member is in at most as many buckets as it has keys; its signature is fetched once for all of them
    where = placed.join(tiles, "key").groupBy("rep").agg(F.collect_list(F.struct("key", "k", "comp", "main", "outs", "alls")).alias("b"))
    rows = where.join(classes.select("rep", "n", "sig"), "rep").select("rep", "n", "sig", F.inline("b"))
    rows = written(rows.withColumn("h", F.xxhash64("rep", "k")), "members", most)
    block = [F.collect_list(c).alias(c) for c in ("rep", "comp", "n", "sig")]

    def blocks(members: DataFrame, own: str, count: str, other: str, others: str) -> DataFrame:
        packed = members.withColumn(own, F.expr(f"CAST(pmod(h, {count}) AS INT)")).groupBy("key", "k", own, others).agg(*block)
        return packed.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(others) - 1))).drop(others)

    outer = blocks(rows.where("comp <> main"), "o", "outs", "t", "alls").drop("k")
    every = blocks(rows, "t", "alls", "o", "outs").select("key", "k", "o", "t", *[F.col(c).alias(f"{c}s") for c in ("rep", "comp", "n", "sig")])
    return outer.join(every, ["key", "o", "t"]).mapInArrow(near_in_tiles(chosen, percent, max_distance), "key long, o int, t int, rep long, partners array<long>")


def near_in_tiles(chosen: list[tuple[int, ...]], percent: int, max_distance: int):
    index_slots = max(map(max, chosen)) + 1

    def slots(sigs):
        raw = np.frombuffer(b"".join(sigs), np.uint8).reshape(len(sigs), -1)
        return raw[:, : 2 * index_slots].copy().view(np.uint16), raw[:, 2 * index_slots :]

    def partners_of(k, left, right):
        (reps, comps, sizes, sigs), (rep, comp, n, sig) = left, right
        (wide, slim), (wides, slims) = slots(sigs), slots(sig)
        out: dict[int, list[int]] = {}
        for i in range(len(reps)):
            j = np.flatnonzero((comp != comps[i]) & (100 * np.minimum(n, sizes[i]) >= percent * np.maximum(n, sizes[i])))
            differ = wides[j] != wide[i]
            near = differ.sum(1) + (slims[j] != slim[i]).sum(1) <= max_distance
            j, differ = j[near], differ[near]
            if len(j) and k:
                shared = np.zeros(len(j), bool)
                for earlier in chosen[:k]:
                    shared |= ~differ[:, earlier].any(1)
                j = j[~shared]
            if len(j):
                out[int(reps[i])] = rep[j].tolist()
                for x in rep[j].tolist():
                    out.setdefault(x, [])
        return out

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda name, row=row, batch=batch: batch.column(name)[row]
                sides = [[*(get(c + s).values.to_numpy() for c in ("rep", "comp", "n")), get("sig" + s).as_py()] for s in ("", "s")]
                found = partners_of(get("k").as_py(), *sides)
                if found:
                    size = len(found)
                    at = [pa.array([get(c).as_py()] * size, t) for c, t in (("key", pa.int64()), ("o", pa.int32()), ("t", pa.int32()))]
                    yield pa.RecordBatch.from_arrays([*at, pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.list_(pa.int64()))], names=["key", "o", "t", "rep", "partners"])

    return run


def tiles(batches):
    """(key, o, t) and the rows of one tile after another, from batches sorted by tile."""
    rest = None
    for batch in batches:
        part = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch])
        at = np.column_stack([part.column(c).to_numpy() for c in ("key", "o", "t")])
        cuts = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(1)) + 1).tolist()]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield at[a].tolist(), part.slice(a, b - a)
        rest = part.slice(cuts[-1])
    if rest is not None and rest.num_rows:
        yield [rest.column(c)[0].as_py() for c in ("key", "o", "t")], rest


def links_in_tiles(percent: int):
    """Links (a, b) among the partners listed in each tile, by their full sets."""

    def run(batches):
        for _, part in tiles(batches):
            a, b = [], []
            reps, partners = part.column("rep").to_pylist(), part.column("partners").to_pylist()
            sets = {}
            for r, x in zip(reps, part.column("set").combine_chunks(), strict=True):
                sets.setdefault(r, []).append(x.values.to_numpy())
            for r, others in zip(reps, partners, strict=True):
                each = [(o, y) for o in others or [] for y in sets.get(o, [])]
                for x in sets[r] if each else []:
                    sizes = np.array([len(y) for _, y in each])
                    joined = np.concatenate([y for _, y in each])
                    at = np.minimum(np.searchsorted(x, joined), len(x) - 1)
                    common = np.add.reduceat(x[at] == joined, np.append(0, np.cumsum(sizes)[:-1]))
                    for i in np.flatnonzero(100 * common >= percent * (sizes + len(x) - common)):
                        a.append(min(r, each[i][0]))
                        b.append(max(r, each[i][0]))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def confirmed_in_tiles(near: DataFrame, texts: DataFrame, shingle: int, percent: int, n: int) -> DataFrame:
    """The links among the partners of near (key, o, t, rep, partners), as (a, b)."""
    sets = sets_for(near.select(F.col("rep").alias("id")), texts, shingle, n).withColumnRenamed("id", "rep")
    return near.join(sets, "rep").select("key", "o", "t", "rep", "partners", "set").repartition("key", "o", "t").sortWithinPartitions("key", "o", "t").mapInArrow(links_in_tiles(percent), "a long, b long").distinct()


MAX_FILTER_BYTES = 32 << 20  # beyond it the texts are joined by id


def sets_for(ids: DataFrame, texts: DataFrame, shingle: int, n: int) -> DataFrame:
    """Shingle sets of the texts with these ids, and of a few others: (id, set).

    A Bloom filter of the ids picks the texts where they are read, so they don't move; the joins that follow
    are exact. Too many ids for a filter of bounded size are joined instead.
    """
    ids = written(ids.distinct(), "ids", n)
    blocks = bloom_blocks(ids.count())
    if blocks * BLOOM_WORDS * 8 > MAX_FILTER_BYTES:
        return written(texts.join(ids, "id", "left_semi").mapInArrow(sets_of(shingle), "id long, set array<long>"), "sets")
    bits = texts.sparkSession.sparkContext.broadcast(bloom_filter(ids.select(F.xxhash64("id").alias("h")), blocks))

    def picked(batches):
        def kept():
            for batch in batches:
                rows = np.flatnonzero(bloom_hits(bits.value, batch.column(2).to_numpy().view(np.uint64)))
                if len(rows):
                    yield batch.take(pa.array(rows))

        yield from sets_of(shingle)(kept())

    return written(texts.where("id IS NOT NULL").select("id", "text", F.xxhash64("id").alias("h")).mapInArrow(picked, "id long, set array<long>"), "sets")


def confirmed(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int, n: int) -> DataFrame:
    """The pairs (a, b) that are links by their full sets, which are made for the documents in pairs only."""
    sets = sets_for(pairs.select(F.col("a").alias("id")).union(pairs.select("b")), texts, shingle, n)
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")
    common = both.select("a", "b", F.size(F.array_intersect("x", "y")).cast("long").alias("c"), (F.size("x") + F.size("y")).cast("long").alias("t"))
    return common.where(100 * F.col("c") >= percent * (F.col("t") - F.col("c"))).select("a", "b").distinct()


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2)
