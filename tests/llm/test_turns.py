"""Repair of conversations against a plain search over edits, grammar state by grammar state."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.llm import registry, turns
from lodestone.llm.common import table
from tests.oracle import connect, difference

COLUMNS = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
NO_END = 10**9


def plain_edits(roles, kinds):
    """The cheapest audit, ties to the least, by recursion over (turn, letters put out so far as a state)."""
    n = len(roles)
    follow = {("", "u"): "u", ("", "s"): "s", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @lru_cache(None)
    def go(i, state, inserts):
        found = [(0, "")] if i == n and state in ("", "a") else []
        steps = []
        if i < n:
            steps.append((2, "D", i + 1, state, 0))
            if kinds[i] in ("fine", "truncated"):
                more = 5 if kinds[i] == "truncated" else 0
                if roles[i][:1] and (state, roles[i][:1]) in follow:
                    steps.append((more, "K", i + 1, follow[state, roles[i][:1]], 0))
                for letter in "ua":
                    if (state, letter) in follow:
                        steps.append((1 + more, "R", i + 1, letter, 0))
        if inserts < 3:
            steps.extend((5, "I", i, letter, inserts + 1) for letter in "ua" if (state, letter) in follow)
        for cost, edit, *rest in steps:
            more, audit = go(*rest)
            if more < NO_END:
                found.append((cost + more, edit + audit))
        return min(found, default=(NO_END, ""))

    return go(0, "", 0)


def plain(rows):
    """Columns of one conversation: rows (turn, role, text) after damage, in any order."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    kinds, seen = [], set()
    for _, role, text in rows:
        signs = re.findall(r"[^\x20\x09-\x0D]", text)
        kinds.append("blank" if not signs else "duplicate" if (role, text) in seen else "fine" if signs[-1] in ".!?" else "truncated")
        seen.add((role, text))
    cost, audit = plain_edits([r[1] for r in rows], kinds)
    left, out, letter = list(rows), [], ""
    for edit in audit:
        wanted = "u" if letter in ("", "s", "a") else "a"
        if edit == "I":
            out.append(({"u": "user", "a": "assistant"}[wanted], ""))
        else:
            _, role, text = left.pop(0)
            if edit == "D":
                continue
            out.append((role if edit == "K" else {"u": "user", "a": "assistant"}[wanted], text))
        letter = out[-1][0][0]
    assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in out))
    numbers = [t for t, _, _ in rows if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return (gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest), out


def plain_damage(conv, turn, role, text):
    role, text = (" " if x is None else x for x in (role, text))
    kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
    text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
    return [] if kind == 0 else [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)


TURN = st.tuples(st.sampled_from(["user", "assistant", "system", "tool", ""]), st.sampled_from(["A.", "b", "", "c!", "d?", " "]))


@settings(max_examples=400, deadline=None)
@given(st.lists(TURN, max_size=9))
def test_whole_conversations(rows):
    told, (_, roles, texts) = turns.whole(list(range(len(rows))), *(list(x) for x in zip(*rows, strict=True))) if rows else turns.whole([], [], [])
    expected, out = plain([(i, *r) for i, r in enumerate(rows)])
    assert told == expected and list(zip(roles, texts, strict=True)) == out


def test_a_long_conversation_needs_a_wide_band():
    rows = [("user", f"{i}.") for i in range(40)] + [("assistant", "")] * 30 + [("assistant", f"{i}x") for i in range(40)]
    told, _ = turns.whole(list(range(len(rows))), *(list(x) for x in zip(*rows, strict=True)))
    assert told == plain([(i, *r) for i, r in enumerate(rows)])[0]


def made(seed, n):
    rng = random.Random(seed)
    return [(rng.choice([None, *range(n)]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None]), rng.choice([None, "", "Yes.", "no", f"line {rng.random()}.", f"cut {rng.random()}"])) for _ in range(n)]


@pytest.mark.parametrize("block", [1, 3, turns.BLOCK])
def test_blocks_and_partitions(spark, block):
    """One conversation holds most rows and spans all partitions, one has no id, one no rows that are present."""
    rows = [(c, *r) for c in range(30) for r in made(c, c % 7 + 1)] + [(99, *r) for r in made(99, 120)] + [(None, *r) for r in made(7, 25)] + [(99, 5, "user", "again.")] * 9
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    docs = docs.withColumns({c: F.lit("clash") for c in ("conv", "block", "open", "head", "hash", "scan", "key", "place", "last", "audit")})
    by_id = defaultdict(list)
    for c, *r in rows:
        by_id[c].append(tuple(" " if x is None and i else x for i, x in enumerate(r)))
    found = {r[0]: tuple(r)[1:] for r in turns.audited(docs, block=block).select(COLUMNS).collect()}
    assert found == {c: plain(x)[0] for c, x in by_id.items()}
    kept = defaultdict(list)
    for r in turns.repaired(docs, block=block).orderBy("conv", "turn").collect():
        kept[r.conv].append((r.role, r.text))
    assert dict(kept) == {c: out for c, x in by_id.items() if (out := plain(x)[1])}


def test_absent_rows_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, 0, "user", "a.", False), (2, 0, "user", "a.", True), (2, 1, "assistant", "x" * 300_000 + ".", True)], "conv_id long, turn long, role string, text string, here boolean")
    found = {r[0]: tuple(r)[1:] for r in turns.audited(docs, F.col("here")).select(COLUMNS).collect()}
    assert found[1] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) and found[2][5:7] == (0, "KK")
    assert turns.audited(docs.limit(0)).collect() == [] and turns.repaired(docs.limit(0)).collect() == []


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01"])
def test_query_over_the_whole_table(spark, sf):
    by_id = defaultdict(list)
    for r in table(spark, sf, "conversations").collect():
        by_id[r.conv_id].extend(plain_damage(r.conv_id, r.turn, r.role, r.text))
    found = turns.op11_conversation_repair(spark, sf)
    assert found.columns == ["conv_id", *COLUMNS[1:]]
    assert {r[0]: tuple(r)[1:] for r in found.collect()} == {c: plain(x)[0] for c, x in by_id.items()}


def test_query_is_its_sql(spark):
    sf = "/root/testdata/sf0.01"
    assert not difference(turns.op11_conversation_repair(spark, sf), connect(sf), registry.ORACLES["op11_conversation_repair"])
