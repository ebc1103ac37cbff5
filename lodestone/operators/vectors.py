"""Exact nearest vectors from an index of cells, with most cells left out.

Unit vectors are given to the nearest of some centres, which are fitted on a bounded sample; every row is in the index. A
cell's rows are sorted by their angle to its centre and packed into tiles. No vector of a tile whose angles lie in [low, high]
can be nearer to a query at angle a from the centre than max(0, a - high, low - a), so a first look into each query's
own cell gives a score, and only cells and tiles that may hold a better one are opened. There int8 codes with
the length of their error give an upper bound of every score; what passes is scored in double precision from the vector itself.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.operators.postings import files_of
from lodestone.sources.sinks import folder, shared

SAMPLE = 10_000  # vectors, the least by a digest of their id, that centres are fitted on
MOST_CELLS = 1024
ROUNDS = 12
TILE = 1024
BLOCK = 256  # queries that meet a tile at once
SLICE = 512  # rows of a batch that meet the centres at once
SLACK = 1e-6  # of angles and bounds, above the rounding of single precision
TILES = "cell int, n int, low double, high double, ids binary, scopes binary, codes binary, scales binary, errors binary, vectors binary"
HITS = "query long, id long, score double"


def usable(column: pa.Array, size: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Places and rows (double) of the vectors that have a direction: not null, finite, not zero, and of the given size."""
    at, rows = [], []
    for i, x in enumerate(column):
        v = None if not x.is_valid or x.values.null_count or not len(x.values) else x.values.to_numpy(zero_copy_only=False).astype(float)
        if v is not None and (size is None or len(v) == size) and np.isfinite(v).all() and v.any():
            at.append(i)
            rows.append(v)
    return np.array(at, np.int64), np.array(rows) if rows else np.empty((0, size or 1))


def slices(batches):
    """The batches in slices, so that a task's arrays do not grow with cells and batches."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def units(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1, 1))


def fit(rows: np.ndarray, cells: int) -> np.ndarray:
    """Centres of cells by rounds of spherical k-means, begun at rows evenly apart in the sample."""
    rows = units(rows)
    centres = rows[np.linspace(0, len(rows) - 1, min(cells, len(rows))).astype(int)]
    for _ in range(ROUNDS):
        own = (rows @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        some = np.linalg.norm(sums, axis=1) > 1e-9
        centres[some] = sums[some] / np.linalg.norm(sums[some], axis=1, keepdims=True)
    return centres


def coded(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, their scales, and the lengths of what they miss."""
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    return codes, scale, np.linalg.norm(unit - codes * scale[:, None], axis=1)


def placed(centres: np.ndarray):
    """Each usable row's cell and angle to its centre."""

    def run(batches):
        for batch in slices(batches):
            at, rows = usable(batch.column(2), centres.shape[1])
            if len(at):
                found = angles(units(rows), centres)
                cell = found.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(at)) for i in range(3)), pa.array(cell.astype(np.int32)), pa.array(found[np.arange(len(at)), cell])], names=["id", "scope", "vector", "cell", "angle"])

    return run


def packed(batches):
    """Tiles of rows that are sorted by cell and angle."""
    held, current = [], None

    def out():
        ids, scopes, vectors, _, angle = zip(*held, strict=True)
        rows = np.array(vectors, float)
        codes, scale, error = coded(units(rows))
        binary = [np.array(ids, np.int64), np.array([-1 if s is None else s for s in scopes], np.int64), codes, scale, error, rows]
        return pa.RecordBatch.from_arrays([pa.array([current], pa.int32()), pa.array([len(ids)], pa.int32()), pa.array([min(angle)]), pa.array([max(angle)]), *(pa.array([x.tobytes()], pa.binary()) for x in binary)], names=[x.split()[0] for x in TILES.split(", ")])

    for batch in slices(batches):
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and (row[3] != current or len(held) == TILE):
                yield out()
                held = []
            current = row[3]
            held.append(row)
    if held:
        yield out()


def blocks_of(centres: np.ndarray, bounds: np.ndarray, k: int, first: bool):
    """Queries dealt to cells in blocks: to the nearest cells that together hold k vectors (first), or to all others that may hold a better one.

    bounds: of each cell its number of rows and the least and largest angle. Queries come with the score to beat.
    """
    n, low, high = bounds

    def nearest(found: np.ndarray) -> np.ndarray:
        order = np.argsort(found + np.where(n > 0, 0, 10))
        return order[: np.searchsorted(np.cumsum(n[order]), k) + 1]

    def run(batches):
        groups: dict[int, list] = {}

        def out(cell):
            ids, scores, vectors, angle = zip(*groups.pop(cell), strict=True)
            return pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), *(pa.array([np.array(x).tobytes()], pa.binary()) for x in (np.array(ids, np.int64), np.array(scores, float), np.array(vectors, float), np.array(angle, float)))], names=["cell", "queries", "to_beat", "directions", "away"])

        for batch in slices(batches):
            at, rows = usable(batch.column(1), centres.shape[1])
            if not len(at):
                continue
            unit = units(rows)
            found = angles(unit, centres)
            ids, beat = batch.column(0).to_numpy(zero_copy_only=False)[at], batch.column(2).to_numpy(zero_copy_only=False)[at]
            for i in range(len(at)):
                near, own = nearest(found[i]), unit[i].copy()  # a view would keep its whole slice
                if not first:
                    least = np.maximum(0, np.maximum(found[i] - high, low - found[i]))
                    open_ = (n > 0) & (np.cos(np.minimum(np.pi, least)) >= beat[i] - SLACK)
                    open_[near] = False
                    near = np.flatnonzero(open_)
                for cell in near.tolist():
                    group = groups.setdefault(cell, [])
                    group.append((ids[i], beat[i], own, found[i, cell]))
                    if len(group) == BLOCK:
                        yield out(cell)
        for cell in list(groups):
            yield out(cell)

    return run


def looked_up(k: int, scopes: list[int] | None):
    """Of each tile and block of queries: the k best rows a query has there, if they may be among its best."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: x[i].as_buffer() if pa.types.is_binary(x.type) else x[i].as_py() for name, x in zip(batch.schema.names, batch.columns, strict=True)}
                ids, own = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["scopes"], np.int64)
                vectors = np.frombuffer(row["vectors"], float).reshape(len(ids), -1)
                codes = np.frombuffer(row["codes"], np.int8).reshape(len(ids), -1).astype(np.float32)
                scale, error = np.frombuffer(row["scales"], float), np.frombuffer(row["errors"], float)
                queries, beat = np.frombuffer(row["queries"], np.int64), np.frombuffer(row["to_beat"], float)
                directions, away = np.frombuffer(row["directions"], float).reshape(len(queries), -1), np.frombuffer(row["away"], float)
                least = np.maximum(0, np.maximum(away - row["high"], row["low"] - away))
                some = np.flatnonzero(np.cos(np.minimum(np.pi, least)) >= beat - SLACK)
                upper = (directions[some].astype(np.float32) @ codes.T) * scale + error + SLACK
                allowed = np.ones(len(ids), bool) if scopes is None else np.isin(own, scopes)
                found = []
                for j, q in enumerate(some.tolist()):
                    hit = np.flatnonzero((upper[j] >= beat[q]) & allowed)
                    if len(hit):
                        score = np.round((vectors[hit] @ directions[q]) / np.linalg.norm(vectors[hit], axis=1), 9)
                        best = np.lexsort((ids[hit], -score))[:k]
                        found.append((np.full(len(best), queries[q]), ids[hit][best], score[best]))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], names=["query", "id", "score"])

    return run


@dataclass
class Cells:
    """An index at a path; build() writes it, the rest reads it."""

    spark: SparkSession
    path: str

    def build(self, vectors: DataFrame, cells: int | None = None) -> Cells:
        """From vectors (id, scope, vector), all of one size. Rows without an id or a direction are not in the index and never found."""
        vectors = vectors.select(F.col("id").cast("long"), F.col("scope").cast("long"), "vector").where("id IS NOT NULL AND vector IS NOT NULL")
        sample = vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vector").toArrow().column(0).combine_chunks()
        sizes = [n for x in sample if (n := len(x))]
        size = max(set(sizes), key=sizes.count) if sizes else 1
        rows = usable(sample, size)[1] if sizes else np.empty((0, 1))
        n = vectors.count()
        centres = fit(rows, cells or min(MOST_CELLS, max(1, int(np.sqrt(n))))) if len(rows) else np.empty((0, size))
        at = vectors.mapInArrow(placed(centres), f"id long, scope long, {vectors.select('vector').schema.simpleString()[7:-1].replace(':', ' ')}, cell int, angle double") if len(rows) else vectors.limit(0).selectExpr("id", "scope", "vector", "0 AS cell", "0D AS angle")
        at.write.parquet(stored := folder(self.spark, "placed"))
        at = self.spark.read.parquet(stored)
        ranged = at.repartitionByRange("cell", "angle", "id").sortWithinPartitions("cell", "angle", "id").select("id", "scope", "vector", "cell", "angle")
        ranged.mapInArrow(packed, TILES).write.partitionBy("cell").parquet(f"{self.path}/tiles")
        kept = [(i, c.tolist()) for i, c in enumerate(centres)]
        self.spark.createDataFrame(kept, "cell int, centre array<double>").coalesce(1).write.parquet(f"{self.path}/centres")
        return self

    @cached_property
    def tiles(self) -> DataFrame:
        return self.spark.read.schema(TILES).parquet(f"{self.path}/tiles")

    @cached_property
    def centres(self) -> np.ndarray:
        found = sorted(self.spark.read.schema("cell int, centre array<double>").parquet(f"{self.path}/centres").collect())
        return np.array([r.centre for r in found]) if found else np.empty((0, 1))

    @cached_property
    def bounds(self) -> np.ndarray:
        """Rows, least and largest angle of every cell: three numbers for each of at most MOST_CELLS."""
        out = np.zeros((3, len(self.centres)))
        for r in self.tiles.groupBy("cell").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).collect():
            out[:, r.cell] = r.n, r.low, r.high
        return out

    def _look(self, queries: DataFrame, k: int, scopes: list[int] | None, first: bool) -> tuple[DataFrame, DataFrame]:
        """Blocks of queries by cell, and what they find there."""
        schema = "cell int, queries binary, to_beat binary, directions binary, away binary"
        dealt = queries.select("query", "vector", "to_beat").mapInArrow(blocks_of(self.centres, self.bounds, k, first), schema)
        return dealt, dealt.join(self.tiles, "cell").drop("cell").mapInArrow(looked_up(k, scopes), HITS)

    def search(self, queries: DataFrame, k: int, scopes: list[int] | None = None) -> DataFrame:
        """query, id, score, rank of the k vectors of largest cosine of each of queries (query, vector); ties by id.

        scopes: only vectors of these. Fewer than k come back where no more are there; queries without a direction have no rows.
        """
        if not len(self.centres):
            return self.spark.createDataFrame([], HITS + ", rank int")
        queries = queries.select(F.col("query").cast("long"), "vector", F.lit(-2.0).alias("to_beat"))
        near = self._look(queries, k, scopes, True)[1]
        near.write.parquet(at := folder(self.spark, "near"))
        near = self.spark.read.schema(HITS).parquet(at)
        by_query = Window.partitionBy("query").orderBy(F.desc("score"), "id")
        last = near.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") == k).select("query", F.col("score").alias("found"))
        again = queries.join(last, "query", "left").select("query", "vector", F.coalesce("found", "to_beat").alias("to_beat"))
        both = near.unionByName(self._look(again, k, scopes, False)[1])
        return both.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k).select("query", "id", "score", "rank")

    def opened(self, queries: DataFrame, k: int, to_beat: DataFrame) -> DataFrame:
        """query, cells (opened in the second look) for queries and the scores (query, to_beat) that the first look gave."""
        dealt = self._look(queries.join(to_beat, "query").select("query", "vector", "to_beat"), k, None, False)[0]
        ids = F.expr("transform(sequence(0, octet_length(queries) div 8 - 1), i -> conv(hex(reverse(substring(queries, i * 8 + 1, 8))), 16, 10))")
        return dealt.select(F.explode(ids).alias("query")).groupBy(F.col("query").cast("long").alias("query")).agg(F.count("*").alias("cells"))


def cells_of(spark: SparkSession, sf_dir: str, vectors: DataFrame, name: str) -> Cells:
    """The index of a stored table's vectors (id, scope, vector), in the shared folder under a digest of its files, built where there is none."""
    key = hashlib.md5(f"{sf_dir}\n{name}\n{files_of(spark.read.parquet(f'{sf_dir}/{name}.parquet'))}".encode(), usedforsecurity=False).hexdigest()
    path = f"{shared(spark)}/lodestone/cells-{key}"
    try:
        at = spark.read.schema("at string").parquet(f"{path}/built").agg(F.max("at")).first()[0]
    except AnalysisException:  # nothing there yet
        at = None
    if at is None:
        Cells(spark, at := folder(spark, "cells")).build(vectors)
        spark.createDataFrame([(at,)], "at string").coalesce(1).write.mode("append").parquet(f"{path}/built")
    return Cells(spark, at)
