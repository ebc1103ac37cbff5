"""Near-duplicate vectors by int8 tile products with proven error bounds.

A unit vector x is stored as a scale and int8 values q with x = s q + e. For two of them
|x.y - s t q.r| <= |e| + (1 + |e|) |f|, so a pair whose quantised product plus that bound is under the
threshold is no link; only the others are computed again in double precision. Vectors are cut into
tiles; each pair of tiles is one row, and the tiles' products run as matrix products inside the
tasks. Equal vectors are one class first. A pair of tiles returns link counts per vector and a
spanning forest of its links, never the links themselves.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, table, written

TILE = 2048


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, scales and upper bounds of the errors' lengths, for rows of unit vectors."""
    scale = np.abs(unit).max(axis=1) / 127
    scale[scale == 0] = 1
    q = np.clip(np.rint(unit / scale[:, None]), -127, 127)
    error = np.linalg.norm(unit - q * scale[:, None], axis=1) * (1 + 1e-9) + 1e-12
    return q.astype(np.int8), scale, error


def scaled(rows: np.ndarray) -> np.ndarray:
    """Rows times powers of two, so that their largest components are about 1: exact, and squares neither overflow nor vanish."""
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1, keepdims=True))[1])


def unit_rows(rows: np.ndarray) -> np.ndarray:
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def tile_links(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Row indexes (i, j) with cosine of a[i] and b[j] at least threshold."""
    a, b = scaled(a), scaled(b)
    ua, ub = unit_rows(a), unit_rows(b)
    qa, sa, ea = quantise(ua)
    qb, sb, eb = quantise(ub)
    product = qa.astype(np.float32) @ qb.T.astype(np.float32)  # exact: whole numbers under 2**24 up to 1,040 dimensions
    if a.shape[1] > 1000:
        product = qa.astype(np.float64) @ qb.T.astype(np.float64)
    # possible where product * sa * sb + ea + (1 + ea) * eb >= threshold; the worst eb and the rounding are taken for all
    slack = ea[:, None] + (1 + ea[:, None]) * eb.max() + 1e-6
    least = ((threshold - slack) / sa[:, None]).astype(np.float32)
    i, j = np.nonzero(product * sb.astype(np.float32)[None, :] >= least)
    if not len(i):
        return i, j
    keep = np.zeros(len(i), bool)
    for at in range(0, len(i), 200_000):
        x, y = a[i[at : at + 200_000]], b[j[at : at + 200_000]]
        cosine = (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))
        keep[at : at + 200_000] = cosine >= threshold
    return i[keep], j[keep]


def forest(i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Positions of links that join what is not yet joined, until all that is linked is joined.

    In every round each tree with a link to a tree of a lower label hangs itself under the lowest such, and links inside
    a tree are left out from then on.
    """
    nodes, place = np.unique(np.concatenate([i, j]), return_inverse=True)
    x, y = place[: len(i)], place[len(i) :]
    label, left, out = np.arange(len(nodes)), np.arange(len(i)), []
    while len(left):
        high, low = np.maximum(label[x[left]], label[y[left]]), np.minimum(label[x[left]], label[y[left]])
        apart = high != low
        left, high, low = left[apart], high[apart], low[apart]
        order = np.argsort(high * len(nodes) + low)
        first = order[np.flatnonzero(np.append(True, np.diff(high[order]) > 0))] if len(order) else order
        out.append(left[first])
        up = np.arange(len(nodes))
        up[high[first]] = low[first]
        while (up[up] != up).any():
            up = up[up]
        label = up[label]
    return np.concatenate(out) if out else np.empty(0, np.int64)


def usable(dtype: str):
    """(id, the vector's bytes, or null if it can't be linked)."""

    def run(batches):
        for batch in batches:
            blobs = []
            for x in batch.column(1):
                v = None if not x.is_valid or x.values.null_count else x.values.to_numpy(zero_copy_only=False).astype(dtype)
                blobs.append((v + v.dtype.type(0)).tobytes() if v is not None and np.isfinite(v).all() and v.any() else None)  # -0 becomes 0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.binary())], names=["id", "vector"])

    return run


TILES = "tile string, size int, nodes array<long>, hashes array<long>, weights array<long>, vectors binary"


def make_tiles(batches):
    """Packs rows (node, hash, weight, vector) whose vectors have one length into tiles of at most TILE rows."""
    groups: dict[int, list] = {}

    def pack(size, rows):
        node, h, weight, vector = zip(*rows, strict=True)
        longs = lambda x: pa.array([list(x)], pa.list_(pa.int64()))
        name = hashlib.md5(vector[0], usedforsecurity=False).hexdigest()
        return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size], pa.int32()), longs(node), longs(h), longs(weight), pa.array([b"".join(vector)], pa.binary())], names=["tile", "size", "nodes", "hashes", "weights", "vectors"])

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows = groups.setdefault(len(row[3]), [])
            rows.append(row)
            if len(rows) == TILE:
                yield pack(len(row[3]), rows)
                groups[len(row[3])] = []
    for size, rows in groups.items():
        if rows:
            yield pack(size, rows)


def compare(threshold: float, dtype: str):
    """Of each pair of tiles: rows (node, hash, links, null), and rows (node, null, 0, other) of a spanning forest."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                a, b = (np.frombuffer(row[v], dtype).reshape(len(row[n]), -1).astype(float) for v, n in (("va", "na"), ("vb", "nb")))
                na, nb, ha, hb = (np.array(row[n], np.int64) for n in ("na", "nb", "ha", "hb"))
                x, y = tile_links(a, b, threshold)
                if row["ta"] == row["tb"]:
                    x, y = x[x < y], y[x < y]
                links = np.concatenate([np.bincount(x, np.array(row["wb"], float)[y], len(na)), np.bincount(y, np.array(row["wa"], float)[x], len(nb))]).astype(np.int64)
                some = np.flatnonzero(links)
                tree = forest(na[x], nb[y])
                edges = np.stack([na[x][tree], nb[y][tree]], axis=1)
                if len(some):
                    n, m = len(some), len(edges)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.concatenate([na, nb])[some], edges[:, 0]])), pa.array([*np.concatenate([ha, hb])[some].tolist(), *[None] * m], pa.int64()), pa.array(np.concatenate([links[some], np.zeros(m, np.int64)])), pa.array([None] * n + edges[:, 1].tolist(), pa.int64())], names=["node", "hash", "links", "other"])

    return run


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept.

    Links: cosine in double precision of at least threshold; vectors of different length are not
    linked. Vectors that are null, empty, zero, or hold null or non-finite components are linked with nothing and
    kept. Rows that repeat an id have their own links and one component. Rows with a null id get a null component
    and are kept, and count as links of the others. An empty table gives no rows; other columns are ignored.

    Every pair of tiles is compared: tiles are dealt to groups, and each pair of groups is one key, so the
    work is spread evenly and a tile is copied once per group.
    """
    dtype = "<f4" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "<f8"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    rows = written(rows.mapInArrow(usable(dtype), "id long, vector binary").withColumn("key", F.md5("vector")), "vectors")
    classes = rows.where("vector IS NOT NULL").groupBy("key", "vector").agg(F.min("id").alias("low"), F.count("*").alias("weight"))
    classes = written(classes.withColumn("hash", F.xxhash64("vector")).withColumn("node", F.coalesce("low", "hash")), "classes")

    tiles = -(-classes.count() // TILE)
    groups = max(1, math.isqrt(2 * tiles))
    packed = written(classes.select("node", "hash", "weight", "vector").repartition(max(1, tiles)).mapInArrow(make_tiles, TILES), "tiles")
    dealt = packed.withColumn("g", F.expr(f"CAST(pmod(xxhash64(tile), {groups}) AS INT)"))
    names = {"tile": "t", "nodes": "n", "hashes": "h", "weights": "w", "vectors": "v"}
    left = dealt.select("size", F.col("g").alias("ga"), F.explode(F.sequence(F.col("g"), F.lit(groups - 1))).alias("gb"), *[F.col(k).alias(f"{v}a") for k, v in names.items()])
    right = dealt.select("size", F.explode(F.sequence(F.lit(0), F.col("g"))).alias("ga"), F.col("g").alias("gb"), *[F.col(k).alias(f"{v}b") for k, v in names.items()])
    met = left.join(right, ["ga", "gb", "size"]).where("ga < gb OR ta <= tb").drop("ga", "gb", "size")
    found = written(met.mapInArrow(compare(threshold, dtype), "node long, hash long, links long, other long"), "links")

    joined = components(found.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")))
    placed = classes.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = placed.groupBy("component").agg(F.min("low").alias("component_id"))
    counts = found.where("other IS NULL").groupBy("node", "hash").agg(F.sum("links").alias("links"))
    facts = placed.join(lowest, "component").join(counts, ["node", "hash"], "left")
    facts = facts.select("key", "component_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    out = rows.select("id", "key").join(facts, "key", "left")
    out = out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings WHERE embedding IS NOT NULL),
u AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM e),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND a.n > 0 AND b.n > 0 AND list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.95),
r(id, low) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.low FROM r JOIN l ON l.a = r.id WHERE r.low < l.b),
c AS (SELECT id, min(low) AS component_id FROM r GROUP BY id)
SELECT e.vec_id, coalesce(k.n_links, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c ON c.id = e.vec_id LEFT JOIN (SELECT a, count(*) AS n_links FROM l GROUP BY a) k ON k.a = e.vec_id"""
