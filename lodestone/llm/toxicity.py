"""Toxic passages as maximal-scoring segments of token log-odds.

Each word scores its log-odds of standing in a toxic document against a clean one, smoothed by a
Dirichlet prior in proportion to its overall frequency, less a fixed cost per word. Words whose
two rates do not differ significantly for the number of words tested, or that were not seen, score the
cost only. All maximal-scoring
segments of a text are found in linear time. Under chance the best segment of n words follows an
extreme-value law with parameters lambda and K; a segment's normalised score is
lambda * S - ln(K * n), and the significant ones are the passages. A logistic curve
fitted on the training rows turns a document's best normalised score into a probability.

The model is fitted on a bounded sample of labelled rows (max_labelled), whose words bound it; it is
the only thing sent to the tasks. The prior's frequencies of the sample's words are counted over all documents.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, crc_fold, table, word_hashes, written

EULER = 0.5772156649015329


@dataclass
class Model:
    words: np.ndarray  # sorted word hashes
    scores: np.ndarray  # their scores, cost included
    cost: float
    lam: float
    log_k: float
    slope: float
    offset: float
    top: float = math.inf  # greater normalised scores count as this in the probability

    def word_scores(self, text: str | None) -> np.ndarray:
        h = word_hashes(text)
        if not len(self.words) or not len(h):
            return np.full(len(h), -self.cost)
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return np.where(self.words[at] == h, self.scores[at], -self.cost)

    def normalised(self, segment_score: float, n: int) -> float:
        return self.lam * segment_score - self.log_k - math.log(max(n, 1))

    def probability(self, x: float) -> float:
        z = self.slope * min(x, self.top) + self.offset
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end exclusive, score), in linear time.

    Runs of equal sign are joined first; the candidates are kept on a stack with the running sums
    before and after each, and a new one is joined with earlier ones while that raises its score.
    """
    if not (scores > 0).any():
        return []
    sign = scores > 0
    edges = np.concatenate([[0], np.flatnonzero(sign[1:] != sign[:-1]) + 1])
    sums = np.add.reduceat(scores, edges)
    ends = np.append(edges[1:], len(scores))
    total, stack = 0.0, []  # of (start, end, sum before, sum after)
    for start, end, s in zip(edges.tolist(), ends.tolist(), sums.tolist(), strict=True):
        before, total = total, total + s
        if s <= 0:
            continue
        new = (start, end, before, total)
        while True:
            j = len(stack) - 1
            passed = []
            while j >= 0 and stack[j][2] >= new[2]:
                passed.append(j)
                j -= 1
            if j < 0 or stack[j][3] >= new[3]:
                stack.append(new)
                break
            new = (stack[j][0], new[1], stack[j][2], new[3])
            del stack[j:]
    return [(a, b, after - before) for a, b, before, after in stack]


def count_words(batches):
    """Per word hash: documents of each label that hold it."""
    for batch in batches:
        labels = batch.column(1).to_numpy(zero_copy_only=False)
        hashes = [np.unique(word_hashes(t.as_py())) for t in batch.column(0)]
        sizes = [len(h) for h in hashes]
        if not sum(sizes):
            continue
        words, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
        of = np.repeat(labels, sizes).astype(np.float64)
        toxic = np.bincount(inverse, of, len(words)).astype(np.int64)
        alls = np.bincount(inverse, minlength=len(words))
        yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(toxic), pa.array(alls - toxic)], names=["word", "toxic", "clean"])


def count_in_all(shared):
    """Of each of the shared sorted words, in how many of a task's documents it is."""

    def run(batches):
        words, counts = shared.value, np.zeros(len(shared.value), np.int64)
        for batch in batches:
            for text in batch.column(0):
                h = np.unique(word_hashes(text.as_py()))
                at = np.minimum(np.searchsorted(words, h), len(words) - 1)
                counts[at[words[at] == h]] += 1
        some = np.flatnonzero(counts)
        for at in range(0, len(some), 10_000):
            i = some[at : at + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(words[i].view(np.int64)), pa.array(counts[i])], names=["word", "n"])

    return run


def best_segments(model: Model):
    def run(batches):
        for batch in batches:
            rows = []
            for text, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                s = model.word_scores(text.as_py())
                rows.append((max((x[2] for x in segments(s)), default=0.0), len(s), label))
            best, n, label = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(best, pa.float64()), pa.array(n, pa.int64()), pa.array(label, pa.int32())], names=["best", "n", "label"])

    return run


def chance_lambda(scores: np.ndarray, share: np.ndarray) -> float:
    """The positive lambda with sum(share * exp(lambda * score)) = 1, by bisection."""
    f = lambda x: float((share * np.exp(np.minimum(x * scores, 700))).sum()) - 1
    lo, hi = 1e-6, 1.0
    if scores.max(initial=0) <= 0 or f(lo) >= 0:
        return 1.0
    while f(hi) < 0 and hi < 100:
        hi *= 2
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return hi


def significance(tests: int) -> float:
    """The deviation beyond which one of that many words is expected by chance, on either side."""
    lo, hi = 0.0, 40.0
    while hi - lo > 1e-9:
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if math.erfc(mid / math.sqrt(2)) * max(tests, 1) > 1 else (lo, mid)
    return hi


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset by damped Newton steps with a small ridge."""
    mean, sd = (x.mean(), x.std() or 1.0) if len(x) else (0.0, 1.0)
    design = np.column_stack([(x - mean) / sd, np.ones(len(x))])
    w = np.zeros(2)
    ridge = np.array([1e-2, 1e-2])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + np.diag(ridge), design.T @ (p - y) + ridge * w)
        w -= np.clip(step, -2, 2)
    return float(w[0] / sd), float(w[1] - w[0] * mean / sd)


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, max_labelled: int = 20_000, prior: float = 50.0, least_docs: int = 3, cost: float = 0.7) -> Model:
    """Fits on at most max_labelled labelled documents outside the held-out fold, taken in hash order.

    Ties in hash order are taken by id. A document with several labels counts as toxic if any is; null labels and ids don't count. Without
    any labelled document, or without toxic ones, every text gets the same low score.
    """
    spark = docs.sparkSession
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    sample = known.where(crc_fold("doc_id", folds) != held).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # at most max_labelled ids
    rows = written(rows.select("text", "label"), "labelled")
    totals = rows.agg(F.coalesce(F.sum("label"), F.lit(0)), F.count("*")).first()
    n_toxic, n_clean = int(totals[0]), int(totals[1] - totals[0])
    if not n_toxic or not n_clean:
        return Model(np.empty(0, np.uint64), np.empty(0), cost, 1.0, 0.0, 0.0, -4.0)

    counts = rows.mapInArrow(count_words, "word long, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    counts = written(counts.where(F.col("t") + F.col("c") >= least_docs), "counts")
    listed = np.sort(counts.select("word").toPandas()["word"].to_numpy(np.int64).view(np.uint64))  # words of the sample
    if not len(listed):
        return Model(np.empty(0, np.uint64), np.empty(0), cost, 1.0, 0.0, 0.0, -4.0)
    everywhere = docs.select("text").mapInArrow(count_in_all(spark.sparkContext.broadcast(listed)), "word long, n long").groupBy("word").agg(F.sum("n").alias("all"))
    counts = counts.join(written(everywhere, "everywhere"), "word")
    share = F.col("all") / F.lit(docs.count())
    alpha = share * prior * n_toxic / (n_toxic + n_clean) + 0.01
    beta = share * prior * n_clean / (n_toxic + n_clean) + 0.01
    odds = F.log((F.col("t") + alpha) / (n_toxic + prior)) - F.log((F.col("c") + beta) / (n_clean + prior))
    # twice the log-likelihood ratio of one rate for both labels against one each
    part = lambda k, e: F.when(k > 0, k * F.log(k / e)).otherwise(0.0)
    t, c, both, n = F.col("t"), F.col("c"), F.col("t") + F.col("c"), n_toxic + n_clean
    ratio = 2 * (part(t, both * n_toxic / n) + part(c, both * n_clean / n) + part(n_toxic - t, (n - both) * n_toxic / n) + part(n_clean - c, (n - both) * n_clean / n))
    scored = written(counts.select("word", "t", "c", odds.alias("s"), ratio.alias("g")), "words")
    least = significance(scored.count()) ** 2
    picked = scored.where(F.col("g") >= least).toPandas()  # words of the sample
    order = np.argsort(words := picked["word"].to_numpy(np.int64).view(np.uint64))
    s = np.clip(picked["s"].to_numpy(float)[order], -4, 6) - cost
    model = Model(words[order], s, cost, 1.0, 0.0, 1.0, 0.0)

    clean = picked["c"].to_numpy(float)[order] / n_clean
    length = rows.where("label = 0").agg(F.avg(F.regexp_count("text", F.lit(WORD)))).first()[0] or 0.0
    neutral = max(length - clean.sum(), 1.0)  # words of a clean document beside the picked ones
    chance = np.append(clean, neutral) / (clean.sum() + neutral)
    model.lam = chance_lambda(np.append(s, -cost), chance)
    best = rows.select("text", "label").mapInArrow(best_segments(model), "best double, n long, label int").toPandas()  # at most max_labelled rows
    top, n, y = best["best"].to_numpy(float), np.maximum(best["n"].to_numpy(float), 1), best["label"].to_numpy(float)
    null = (model.lam * top - np.log(n))[(y == 0) & (top > 0)]
    model.log_k = float(null.mean() - EULER) if len(null) else 0.0
    x = model.lam * top - model.log_k - np.log(n)
    model.top = float(np.median(x[y == 1]))  # far beyond it, scores say no more
    model.slope, model.offset = logistic(np.minimum(x, model.top), y)
    return model


def score(docs: DataFrame, model: Model, alpha: float = 1e-3) -> DataFrame:
    """docs with toxic_score, toxic_passages (first word, end, normalised score of the significant segments).

    A segment is significant if chance gives as good a one with probability under alpha. Null and empty
    texts have no passages and the score of a text without any. Columns of docs with these names are replaced.
    """
    docs = docs.drop("toxic_score", "toxic_passages")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    least = -math.log(-math.log1p(-alpha))
    passages = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    columns = docs.columns
    schema = docs.select("*", F.lit(0.0).alias("toxic_score"), F.lit(None).cast("array<struct<start:int,end:int,score:double>>").alias("toxic_passages")).schema
    at = columns.index("text")

    def rows(batches):
        m = shared.value
        for batch in batches:
            scores, found = [], []
            for text in batch.column(at):
                s = m.word_scores(text.as_py())
                each = [(a, b, m.normalised(x, len(s))) for a, b, x in segments(s)]
                scores.append(m.probability(max((x[2] for x in each), default=m.normalised(0.0, len(s)))))
                found.append([{"start": a, "end": b, "score": x} for a, b, x in each if x >= least])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array(found, passages)], names=[*columns, "toxic_score", "toxic_passages"])

    return docs.mapInArrow(rows, schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(crc_fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"), F.size("toxic_passages").alias("n_passages"))
