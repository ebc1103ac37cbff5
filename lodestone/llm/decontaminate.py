"""Benchmark decontamination: test items found in documents within an edit budget.

An item with a budget of k edits is split into k + 1 pieces; a document that holds the item within
k edits holds one piece unchanged (pigeonhole). All pieces are searched at once with an
Aho-Corasick automaton; around each hit, Myers' bit-parallel distance decides, first on the few pieces
next to it: of p pieces of a match that may have p - 1 edits, one half has less edits than pieces too.
Items travel to the tasks in blocks of bounded size; documents are never shuffled.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

WORDS = re.compile(r"\w+")
#: Letters of scripts that put no space between words, or none before endings.
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af\uf900-\ufaff\U00020000-\U0003ffff]")
#: Every item that has a letter, and the whole rate as its budget.
WHOLE = {"least_piece": 1, "least_item": 1}


def normalised(text: str | None) -> str:
    """Lower case, and one space between runs of letters, digits and underscores."""
    return " ".join(WORDS.findall((text or "").lower()))


def budget(length: int, rate: float, least_piece: int) -> int:
    return max(0, min(int(length * rate + 1e-9), length // least_piece - 1))


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 consecutive pieces of nearly equal length, with their offsets."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def halves(n: int) -> list[list[tuple[int, int]]]:
    """For each of n pieces, the groups (first, last + 1) it lies in when n pieces are halved again and again, smallest first; without itself and the whole."""
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    todo = [(0, n)]
    while todo:
        a, b = todo.pop()
        if b - a > 1:
            todo += [(a, (a + b) // 2), ((a + b) // 2, b)]
            if b - a < n:
                for i in range(a, b):
                    out[i].insert(0, (a, b))
    return out


def within_words(text: str, start: int, end: int) -> bool:
    """Whether text[start:end] begins or ends inside a word of a script with spaces."""
    return any(0 < at < len(text) and text[at - 1] != " " and text[at] != " " and not (UNSPACED.match(text[at - 1]) or UNSPACED.match(text[at])) for at in (start, end))


@lru_cache(4096)
def masks(pattern: str) -> dict[str, int]:
    """Where each character stands in a pattern, as bits; made when first asked for, as most parts of items never are."""
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def best_end(pattern: str, peq: dict[str, int], text: str, anchored: bool = False) -> tuple[int, int]:
    """Least edit distance of pattern to a part of text, and where the first such part ends (Myers 1999).

    anchored: the part must begin where text begins.
    """
    m = len(pattern)
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = (ph << 1 | anchored) & full
        mh = mh << 1 & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


class Searcher:
    """Items (id, normalised text) of one block."""

    def __init__(self, items: list[tuple[int, str]], rate: float, least_piece: int):
        import ahocorasick

        self.items = [(i, t, budget(len(t), rate, least_piece)) for i, t in items]
        found: dict[str, list[tuple[int, int, list]]] = {}
        for n, (_, t, k) in enumerate(self.items):
            parts = pieces(t, k)
            cuts, groups = [*(at for at, _ in parts), len(t)], {}
            for (at, piece), around in zip(parts, halves(k + 1), strict=True):
                for a, b in around:
                    if (a, b) not in groups:
                        part = t[cuts[a] : cuts[b]]
                        groups[a, b] = cuts[a], cuts[b], b - a - 1, part
                found.setdefault(piece, []).append((n, at, [groups[x] for x in around]))
        self.automaton = ahocorasick.Automaton()
        for piece, where in found.items():
            self.automaton.add_word(piece, (len(piece), where))
        if found:
            self.automaton.make_automaton()
        self.empty = not found

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item id, distance, start, end) of the best match of each item within its budget; offsets in text."""
        if self.empty or not text:
            return []
        begins: dict[int, set[int]] = {}
        for last, (length, where) in self.automaton.iter(text):
            for n, at, around in where:
                s = last + 1 - length - at
                if s in begins.get(n, ()):
                    continue
                for a, b, k, part in around:
                    if best_end(part, masks(part), text[max(0, s + a - k) : max(0, s + b + k)])[0] > k:
                        break
                else:
                    begins.setdefault(n, set()).add(s)
        out = []
        for n, starts in sorted(begins.items()):
            item, pattern, k = self.items[n]
            if (m := self.best(n, pattern, k, text, sorted(starts))) is not None:
                out.append((item, *m))
        return out

    def best(self, n: int, pattern: str, k: int, text: str, starts: list[int]) -> tuple[int, int, int] | None:
        for s in starts:
            if s >= 0 and text.startswith(pattern, s) and (k or not within_words(text, s, s + len(pattern))):
                return 0, s, s + len(pattern)
        if not k:
            return None
        best = None
        i = 0
        while i < len(starts):  # windows that overlap are read once
            j = i
            while j + 1 < len(starts) and starts[j + 1] - starts[j] <= 2 * k:
                j += 1
            lo, hi = max(0, starts[i] - k), min(len(text), starts[j] + len(pattern) + k)
            d, end = best_end(pattern, masks(pattern), text[lo:hi])
            if d <= k and (best is None or d < best[0]):
                back = pattern[::-1]
                _, length = best_end(back, masks(back), text[max(0, lo + end - len(pattern) - k) : lo + end][::-1], True)
                best = d, lo + end - length, lo + end
            i = j + 1
        return best


def item_blocks(spark: SparkSession, items: DataFrame, least_item: int, block_chars: int):
    """Broadcast lists of items (id, normal form), of about block_chars characters each; at least one list."""
    sized = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text")).where("text IS NOT NULL").dropDuplicates()
    blocks = max(1, -(-(sized.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]) // block_chars))
    for b in range(blocks):
        rows = sized.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()  # about block_chars
        yield spark.sparkContext.broadcast([(r[0], t) for r in rows if len(t := normalised(r[1])) >= least_item])


def contaminated(docs: DataFrame, items: DataFrame, rate: float = 0.1, least_piece: int = 14, least_item: int = 28, block_chars: int = 4_000_000) -> DataFrame:
    """doc_id, item_id, distance, match_start, match_end: each item found in each document, at its best place; of equally good ones, the first.

    Texts and items are compared in normal form (normalised), to which the offsets refer. The budget of an
    item of n characters is min(rate * n, n // least_piece - 1) edits: the whole rate if least_piece is 1, as
    in the query and the pipeline (WHOLE); items without an edit are found as whole words only. Null or
    empty items and items under least_item characters in normal form are not searched; an item without an id
    is reported with a null one; null and empty texts hold nothing; rows that repeat are reported as often as
    they come. Items are read in blocks of about block_chars characters, one pass over the documents each.
    """
    named = docs.select("doc_id", "text")
    out = None
    for shared in item_blocks(docs.sparkSession, items, least_item, block_chars):

        def run(batches, shared=shared):
            search = Searcher(shared.value, rate, least_piece)
            for batch in batches:
                found = [(i, *m) for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for m in search.matches(normalised(t.as_py()))]
                ids, item, d, a, e = zip(*found, strict=True) if found else ((),) * 5
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(item, pa.int64()), pa.array(d, pa.int32()), pa.array(a, pa.int64()), pa.array(e, pa.int64())], names=["doc_id", "item_id", "distance", "match_start", "match_end"])

        part = named.mapInArrow(run, "doc_id long, item_id long, distance int, match_start long, match_end long")
        out = part if out is None else out.union(part)
    return out


def clean(docs: DataFrame, items: DataFrame, rate: float = 0.1, least_piece: int = 14, least_item: int = 28, block_chars: int = 4_000_000) -> DataFrame:
    """The rows of docs, with all their columns, that hold no item as contaminated has it; null ids are judged like others.

    Rows are dropped where they are read: nothing is joined or shuffled.
    """
    at = docs.columns.index("text")
    for shared in item_blocks(docs.sparkSession, items, least_item, block_chars):

        def kept(batches, shared=shared):
            search = Searcher(shared.value, rate, least_piece)
            for batch in batches:
                yield batch.filter(pa.array([not search.matches(normalised(t.as_py())) for t in batch.column(at)], pa.bool_()))

        docs = docs.mapInArrow(kept, docs.schema)
    return docs


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), **WHOLE)
