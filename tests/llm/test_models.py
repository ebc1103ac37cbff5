"""Decontamination, token shards, toxicity and language-model scores against brute force, round trips and held-out rows."""

import base64
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lodestone.llm import decontaminate, lm, shards, toxicity
from lodestone.llm.common import table, work_path

SF, SF1 = "/root/testdata/sf0.01", "/root/testdata/sf0.1"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def edit_distance_in(pattern, text):
    """Least edits between pattern and any part of text, by the plain table."""
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(pattern, 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (p != c)))
        row = new
        best = min(best, row[-1])
    return best


def test_myers_distance():
    r = random.Random(2)
    for _ in range(200):
        p = "".join(r.choice("abc") for _ in range(r.randint(1, 90)))
        t = "".join(r.choice("abc") for _ in range(r.randint(0, 120)))
        assert decontaminate.best_end(p, decontaminate.masks(p), t)[0] == edit_distance_in(p, t)


def test_decontamination_against_brute_force(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(r.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([5, 8, 12, 30, 60, 3, 1])] + [(7, None), (8, ""), (None, "x" * 60)]
    docs = []
    for d in range(120):
        text = " ".join(word() for _ in range(r.randint(0, 60)))
        if d % 2:
            part = list(items[r.randrange(6)][1].upper())
            for _ in range(r.randint(0, 8)):
                part[r.randrange(len(part))] = r.choice(["", "x", "ab"])
            text = f"{text}\n{''.join(part)}, {text}"
        docs.append((d, text))
    docs += [(500, None), (501, ""), (None, items[3][1]), (502, "pad " * 50_000 + items[4][1])]
    rate, piece, least = 0.1, 14, 28
    want = set()
    for d, text in docs[:-1]:
        for i, item in items:
            pattern = decontaminate.normalised(item)
            if i is not None and len(pattern) >= least and text and (e := edit_distance_in(pattern, decontaminate.normalised(text))) <= decontaminate.budget(len(pattern), rate, piece):
                want.add((d, i, e))
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS item_id")
    table_ = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contaminated(df, table_).collect()
    assert {(x.doc_id, x.item_id, x.distance) for x in found} - {(502, 4, 0), (None, 3, 0)} == want - {(None, 3, 0)}
    assert len(want) > 15 and any(e for _, _, e in want)
    for x in found:
        text = decontaminate.normalised(dict(docs)[x.doc_id])
        pattern = decontaminate.normalised(dict(items)[x.item_id])
        assert edit_distance_in(pattern, text[x.match_start : x.match_end]) == x.distance
    assert decontaminate.contaminated(df, table_, block_chars=200).count() == len(found)  # several blocks give the same
    bad = {x.doc_id for x in found}
    for size in (200, 4_000_000):
        assert sorted(x.doc_id for x in decontaminate.clean(df, table_, block_chars=size).collect()) == sorted(d for d, _ in docs if d not in bad)
    assert decontaminate.contaminated(df, table_.limit(0)).count() == 0 and decontaminate.contaminated(df.limit(0), table_).count() == 0


def plain_tokens(texts):
    import tiktoken

    with open(shards.TOKENIZER, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("plain", pat_str=shards.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return [encoding.encode_ordinary(t or "") + [shards.END] for t in texts]


@pytest.mark.parametrize("size", [1, 2, 3, 17, 1000, 4097])
def test_permutation(size):
    p = shards.Permutation(size, 9)
    slots = p.positions(np.arange(size))
    assert sorted(slots.tolist()) == list(range(size))
    assert p.numbers(slots).tolist() == list(range(size))
    assert size < 100 or (slots != np.arange(size)).mean() > 0.9


@pytest.mark.parametrize("tasks", [1, 3, shards.TASKS])
def test_shards_round_trip(spark, tasks):
    texts = ["Hello  world ", "a b\n\nc  d", None, "", "naïve 東京 " * 30, " lead", "x" * 40_000, "tab\t end  ", "word " * 3000] * 3
    rows = [(i if i != 5 else None, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 AS slot", "'t' AS tokens").repartition(3).write.parquet(at := work_path(spark, "docs"))
    docs, folder = spark.read.parquet(at), work_path(spark, "shards")
    index = shards.materialise(docs, folder, seq_len=64, shard_rows=50, tasks=tasks)
    placed = sorted(shards.verified(spark, folder, index).collect())
    n = len(placed)
    assert [r.slot for r in placed] == list(range(n)) and len({r.sequence for r in placed}) == n
    assert [r.shard for r in placed] == sorted(r.shard for r in placed) and len({(r.shard, r.byte_offset) for r in placed}) == n
    assert len({r.shard for r in placed}) > 5
    order = shards.Permutation(docs.rdd.getNumPartitions() * shards.PER_PART, 2024).positions(np.array([r.sequence for r in placed]))
    assert (np.diff(order) > 0).all()  # slots follow the keyed positions
    data = shards.read_slots(folder, 0, n)
    assert data.shape == (n, 64) and all((shards.read_slots(folder, at, 20) == data[at : at + 20]).all() for at in (0, 45, n - 7))
    by_sequence = data[[r.slot for r in sorted(placed, key=lambda r: r.sequence)]]
    sizes = [r.n_tokens for r in sorted(placed, key=lambda r: r.sequence)]
    stream = [int(t) for row, k in zip(by_sequence, sizes, strict=True) for t in row[:k]]
    split, one = [], []
    for t in stream:
        one.append(t)
        if t == shards.END:
            split.append(tuple(one))
            one = []
    assert not one and Counter(split) == Counter(map(tuple, plain_tokens(texts)))
    assert all(zlib.crc32(data[r.slot].tobytes()) == r.crc for r in placed)
    empty = shards.materialise(docs.limit(0), work_path(spark, "shards"))
    assert empty.count() == 0


def auc(score, label):
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    pos = np.asarray(label) == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_segments_are_all_maximal_ones():
    def recursive(x, at=0):
        """The definition: the best segment (the leftmost shortest), then the same to its left and right."""
        best = None
        for i in range(len(x)):
            s = 0
            for j in range(i, len(x)):
                s += x[j]
                if s > 0 and (best is None or s > best[0] + 1e-9):
                    best = (s, i, j + 1)
        if best is None:
            return []
        s, i, j = best
        return recursive(x[:i], at) + [(at + i, at + j, s)] + recursive(x[j:], at + j)

    r = np.random.default_rng(0)
    for _ in range(200):
        x = r.normal(size=r.integers(0, 25)) - 0.2
        found = toxicity.segments(x)
        assert [(a, b) for a, b, _ in found] == [(a, b) for a, b, _ in recursive(x.tolist())]
        assert all(abs(s - x[a:b].sum()) < 1e-9 for a, b, s in found)


def test_toxicity_on_held_out_rows(spark):
    docs, labels = table(spark, SF1, "documents"), table(spark, SF1, "labels")
    scored = toxicity.op7_toxicity(spark, SF1)
    rows = scored.join(labels, "doc_id").where("held_out").collect()
    assert scored.count() == docs.count() and scored.where("score < 0 OR score > 1 OR score IS NULL").count() == 0
    assert auc([r.score for r in rows], [r.toxic for r in rows]) > 0.9
    assert sum(r.predicted == r.toxic for r in rows) / len(rows) > 0.97
    model = toxicity.fit(docs, labels)
    odd = spark.createDataFrame([(1, None, 1), (2, "", 2), (None, "word " * 100_000, 3), (2, "", 2)], "doc_id long, text string, label int")
    assert toxicity.score(odd, model).count() == 4
    assert toxicity.score(odd.limit(0), model).count() == 0
    assert toxicity.score(odd, toxicity.fit(docs, labels.limit(0))).select("toxic_score").distinct().count() == 1


def test_language_model(spark):
    docs = table(spark, SF, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    fold = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    words = lambda t: WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) + [None]
    counts = Counter(w for i, t in rows if not fold(i) for w in words(t))
    total, size = sum(counts.values()), len(counts)
    found = {r.doc_id: r for r in lm.op9_lm_scoring(spark, SF).collect()}
    assert len(found) == len(rows)
    for i, t in rows:
        r, w = found[i], words(t)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (fold(i), len(w), sum(x in counts for x in w), total)
        assert abs(r.base_score - sum(np.log10((counts[x] + 1) / (total + size + 1)) for x in w)) < 1e-6 * len(w)
    held = [r for r in found.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)  # the context helps on texts not learnt from


class Plain:
    """The same interpolated model in dictionaries."""

    def __init__(self, texts):
        self.one, self.two, self.three, self.of2, self.of3 = (Counter() for _ in range(5))
        for w in texts:
            self.one.update(w)
            for i in range(1, len(w)):
                self.two[w[i - 1], w[i]] += 1
                if i > 1:
                    self.three[w[i - 2], w[i - 1], w[i]] += 1
        self.total = sum(self.one.values()) + len(self.one) + 1
        self.sums2, self.sums3 = Counter(), Counter()
        for (a, _), c in self.two.items():
            self.sums2[a] += c
            self.of2[a] += 1
        for (a, b, _), c in self.three.items():
            self.sums3[a, b] += c
            self.of3[a, b] += 1

    def p(self, before, w):
        p = (self.one[w] + 1) / self.total
        if before and self.sums2[before[-1]]:
            n = self.sums2[before[-1]]
            p = max(self.two[before[-1], w] - 0.75, 0) / n + 0.75 * self.of2[before[-1]] / n * p
        if len(before) > 1 and self.sums3[before[-2:]]:
            n = self.sums3[before[-2:]]
            p = max(self.three[(*before[-2:], w)] - 0.75, 0) / n + 0.75 * self.of3[before[-2:]] / n * p
        return p


def plain_words(text):
    return (*WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")), None)


def test_scores_are_those_of_a_plain_model(spark):
    """Over every document, with shards of so few tokens that common words are split over several."""
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    rows = [(i, plain_words(t)) for i, t in docs.collect()]
    model = Plain([w for i, w in rows if i % 7])
    for context in (rows[1][1][:1], rows[1][1][:2], rows[2][1][4:6]):
        assert abs(sum(model.p(context, w) for w in model.one) + model.p(context, "no such word") - 1) < 1e-6
    for size in (2_000_000, 5_000):
        folder = work_path(spark, "trie")
        meta = lm.train(docs.where("doc_id % 7 <> 0"), folder, tokens_per_shard=size)
        found = {r.doc_id: r.score for r in lm.score(docs, folder, meta).collect()}
        for i, w in rows:
            want = sum(np.log10(model.p(w[max(0, j - 2) : j], x)) for j, x in enumerate(w))
            assert abs(found[i] - want) < 0.02 * len(w) ** 0.5 + 0.004 * len(w), (i, len(w), found[i], want)


def test_split_words_give_the_same_scores(spark):
    r = random.Random(3)
    texts = [" ".join("hot" if r.random() < 0.4 else f"w{r.randrange(30)}" for _ in range(r.randrange(60))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)
    docs.write.parquet(at := work_path(spark, "docs"))
    docs, model = spark.read.parquet(at), Plain([plain_words(t) for t in texts])
    for size, top in ((1_000_000, 1000), (100, 5), (100, 1000)):
        meta = lm.train(docs, folder := work_path(spark, "trie"), tokens_per_shard=size, top_words=top, words_per_shard=10)
        assert size > 100 or lm.Vocabulary(folder).splits(np.arange(1))[0] > 4
        for d, score in lm.score(docs, folder, meta).select("doc_id", "score").collect():
            w = plain_words(texts[d])
            assert abs(score - sum(np.log10(model.p(w[max(0, j - 2) : j], x)) for j, x in enumerate(w))) < 0.01 * len(w)


def test_elias_fano():
    r = np.random.default_rng(0)
    for n, universe in ((0, 5), (1, 1), (1000, 1 << 40), (1000, 1100), (5000, 1 << 61)):
        values = np.unique(r.integers(0, universe, n).astype(np.uint64))
        ef = lm.EliasFano.build(values, universe)
        assert (ef.find(values) == np.arange(len(values))).all()
        other = r.integers(0, universe, 500).astype(np.uint64)
        want = np.searchsorted(values, other)
        hit = (want < len(values)) & (values[np.minimum(want, max(len(values) - 1, 0))] == other) if len(values) else np.zeros(500, bool)
        assert (ef.find(other) == np.where(hit, want, -1)).all()


def test_language_model_edge_cases(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "a b"), (2, "A"), (2, "A")], "doc_id long, text string").selectExpr("*", "1 AS shard", "2 AS c")
    folder = work_path(spark, "trie")
    meta = lm.train(docs, folder)
    found = lm.score(docs, folder, meta).collect()
    assert sorted(r.n_tokens for r in found) == [1, 1, 2, 2, 3] and all(r.score < 0 for r in found)
    empty = work_path(spark, "trie")
    nothing = lm.train(docs.limit(0), empty)
    assert nothing["tokens"] == 0 and lm.score(docs, empty, nothing).where("n_known > 0").count() == 0
    assert lm.score(docs.limit(0), folder, meta).count() == 0
