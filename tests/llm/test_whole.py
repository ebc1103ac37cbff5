"""Training-data operators on the whole job, against plain definitions written apart from the code."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from lodestone.llm import decontaminate, lm, toxicity
from lodestone.llm.common import table, word_hashes


def plain(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def discounted(train, order):
    """log10 of a token's probability after a context (tuple of up to order - 1 tokens), by absolute discounting over all n-grams."""
    counts = Counter(tuple(t[i : i + n]) for n in range(1, order + 1) for t in train for i in range(len(t) - n + 1))
    total, size = sum(c for g, c in counts.items() if len(g) == 1), sum(len(g) == 1 for g in counts)
    kept = Counter()
    for g, c in counts.items():
        if len(g) > 1:
            kept[g[:-1]] += c - 0.75

    def p(context, word):
        if not context:
            return (counts[(word,)] + 1) / (total + size + 1)
        lower = p(context[1:], word)
        if not counts[context] or not counts[(word,)]:
            return lower
        return max(0, counts[(*context, word)] - 0.75) / counts[context] + (1 - kept[context] / counts[context]) * lower

    return lambda t: sum(np.log10(p(tuple(t[max(0, i - order + 1) : i]), t[i])) for i in range(len(t)))


def test_language_model_counts_every_trigram(spark, tmp_path):
    r = random.Random(5)
    names = [f"w{i}" for i in range(40)]
    texts = {i: " ".join(r.choice(names[: r.randint(2, 40)]) for _ in range(30)) for i in range(60)}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    train = [[*t.split(), None] for i, t in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    three, two = discounted(train, 3), discounted(train, 2)
    found = {x.doc_id: x.score for x in lm.op9_lm_scoring(spark, str(tmp_path)).collect()}
    assert found.keys() == texts.keys()
    for i, t in texts.items():
        assert abs(found[i] - three([*t.split(), None])) < 0.6, i  # 31 tokens in 8-bit codes
    assert sum(found.values()) > sum(two([*t.split(), None]) for t in texts.values()) + 60


def best_edits(pattern, text):
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(pattern, 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (p != c)))
        row, best = new, min(best, new[-1])
    return best


def test_decontamination_uses_the_whole_rate(spark, tmp_path):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7)))
    phrase = lambda n: " ".join(word() for _ in range(n))
    items = {1: (phrase(18) + " zzzzzzz " + phrase(4))[:80].strip(), 2: phrase(25), 3: phrase(60), 4: "中国的首都是哪一座城市请写出它的名字", 5: phrase(4), 6: "kitten"}
    eight = phrase(6) + " absolute " + phrase(8)
    items[7] = eight + " " + "q" * max(0, 79 - len(eight))
    docs = {1: "so " + items[7].replace("absolute", "zzzzzzzz") + " end", 2: "问：" + items[4] + "？答", 3: f"a {items[5]} b", 4: "one kitten here", 5: "kittens", 6: "x " + "n" * 60 + " y", 7: phrase(80)}
    for d in range(10, 70):
        part = list(items[r.randrange(1, 6)])
        for _ in range(r.randint(0, len(part) // 8)):
            part[r.randrange(len(part))] = r.choice(["", "z", "ab"])
        docs[d] = f"{phrase(r.randint(0, 20))} {''.join(part)} {phrase(r.randint(0, 20))}"
    null = "n" * 60
    want = set()
    for d, t in docs.items():
        text = decontaminate.normalised(t)
        for i, x in [*items.items(), (None, null)]:
            x = decontaminate.normalised(x)
            e, most = (best_edits(x, text), len(x) * 10 // 100) if i != 6 else (0 if f" {x} " in f" {text} " else 9, 0)
            if e <= most:
                want.add((d, i, e))
    assert {(1, 7), (2, 4), (3, 5), (4, 6), (6, None)} <= {w[:2] for w in want} and len(want) > 40
    spark.createDataFrame(list(docs.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([*items.items(), (None, null), (8, ""), (9, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = decontaminate.op3_decontamination(spark, str(tmp_path)).collect()
    assert {(x.doc_id, x.item_id, x.distance) for x in found} == want and len(found) == len(want)

    import corpus_pipeline

    left = corpus_pipeline.drop_contaminated(spark, spark.read.parquet(f"{tmp_path}/documents.parquet").selectExpr("*", "'en' AS lang", "'s' AS source", "1L AS n_chars"), str(tmp_path))
    assert {x.doc_id for x in left.collect()} == docs.keys() - {w[0] for w in want}


def test_toxicity_is_the_plain_model(spark):
    """Word scores, lambda, K and every document's probability, worked out again in plain Python."""
    docs, labels = (table(spark, "/root/testdata/sf0.01", n) for n in ("documents", "labels"))
    texts = {r.doc_id: plain(r.text) for r in docs.collect()}
    known = {r.doc_id: r.toxic for r in labels.collect() if r.toxic is not None and r.doc_id in texts and zlib.crc32(str(r.doc_id).encode()) % 5}
    n = {y: sum(v == y for v in known.values()) for y in (0, 1)}
    held = {y: Counter(w for i, v in known.items() if v == y for w in set(texts[i])) for y in (0, 1)}
    everywhere = Counter(w for t in texts.values() for w in set(t))
    tested = {w: everywhere[w] / len(texts) for w in held[0] | held[1] if held[0][w] + held[1][w] >= 3}

    def odds(w, share):
        part = lambda y: math.log((held[y][w] + share * 50 * n[y] / len(known) + 0.01) / (n[y] + 50))
        return part(1) - part(0)

    def ratio(w):
        part = lambda k, e: k * math.log(k / e) if k else 0.0
        both = held[0][w] + held[1][w]
        return 2 * sum(part(held[y][w], both * n[y] / len(known)) + part(n[y] - held[y][w], (len(known) - both) * n[y] / len(known)) for y in (0, 1))

    least = toxicity.significance(len(tested))
    assert abs(math.erfc(least / math.sqrt(2)) * len(tested) - 1) < 1e-3
    words = {w: max(-4, min(6, odds(w, s))) - 0.7 for w, s in tested.items() if ratio(w) >= least**2}
    model = toxicity.fit(docs, labels)
    found = dict(zip(model.words.tolist(), model.scores.tolist(), strict=True))
    assert len(words) > 5 and len(found) == len(words)
    assert all(abs(found[int(word_hashes(w)[0])] - s) < 1e-6 for w, s in words.items())

    rates = {w: held[0][w] / n[0] for w in words}
    neutral = sum(len(texts[i]) for i, v in known.items() if not v) / n[0] - sum(rates.values())
    chance = sum(r * math.exp(model.lam * words[w]) for w, r in rates.items()) + neutral * math.exp(-0.7 * model.lam)
    assert abs(chance / (sum(rates.values()) + neutral) - 1) < 1e-6

    def best(t):
        top = run = 0.0
        for w in t:
            run = max(0.0, run + words.get(w, -0.7))
            top = max(top, run)
        return top

    raw = {i: model.lam * best(t) - math.log(max(len(t), 1)) for i, t in texts.items()}
    null = [raw[i] for i, v in known.items() if not v and best(texts[i]) > 0]
    assert abs(model.log_k - (sum(null) / len(null) - 0.5772156649015329)) < 1e-6
    assert abs(model.top - np.median([raw[i] - model.log_k for i, v in known.items() if v])) < 1e-6
    scored = {r.doc_id: r.score for r in toxicity.op7_toxicity(spark, "/root/testdata/sf0.01").collect()}
    assert scored.keys() == texts.keys()
    for i, x in raw.items():
        assert abs(scored[i] - 1 / (1 + math.exp(-model.slope * min(x - model.log_k, model.top) - model.offset))) < 1e-6
