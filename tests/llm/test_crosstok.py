"""Token alignment against a plain version: offsets in sets, groups by loops, counts in dictionaries, the vocabulary's own library."""

import hashlib
import json
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestone.llm import crosstok
from lodestone.llm.common import table, written

LONG = "".join(f"wörd{n * 7919 % 1013} " for n in range(60_000))
EDGES = [None, "", " ", "a", "  two  spaces\n\n\tand tabs ", "▁ is no space", "<|endoftext|> and <s> </s> <unk> <0x41>", "日本語のテキスト 🙂🙂", "x" * 3000, "ab" * 5000, "\x00\x01 nul", "é é ﬁ  　", "Repeated row", "Repeated row", LONG]


def plain_tokens(texts):
    """Ids and bytes of both sides, by the files' own libraries."""
    a = Tokenizer.from_file(crosstok.BYTE_BPE)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=crosstok.PIECE_BPE)
    with open(crosstok.BYTE_BPE, encoding="utf-8") as f:
        vocabulary = {i: w for w, i in json.load(f)["model"]["vocab"].items()}
    printable = {}
    extra = 0
    for byte in range(256):
        if 33 <= byte <= 126 or 161 <= byte <= 172 or 174 <= byte <= 255:
            printable[chr(byte)] = byte
        else:
            printable[chr(256 + extra)] = byte
            extra += 1
    for text in texts:
        if not text:
            yield [], []
            continue
        one = [(i, bytes(printable[c] for c in vocabulary[i])) for i in a.encode(" " + text, add_special_tokens=False).ids]
        two = []
        for i in b.encode(text):
            p = b.id_to_piece(i)
            two.append((i, bytes.fromhex(p[3:5]) if b.is_byte(i) else p.replace("▁", " ").encode()))
        whole = (" " + text).encode()
        yield (one, two) if b"".join(x for _, x in one) == whole == b"".join(x for _, x in two) else ([], [])


def plain_groups(one, two):
    """Pairs of id lists between the offsets where both sides end."""
    ends = []
    for side in (one, two):
        at, own = 0, []
        for i, data in side:
            at += len(data)
            own.append((at, i))
        ends.append(own)
    both = sorted({x for x, _ in ends[0]} & {x for x, _ in ends[1]})
    out, low = [], 0
    for cut in both:
        out.append(tuple([i for x, i in own if low < x <= cut] for own in ends) if len(both) < 300 else None)
        low = cut
    if out and out[0] is None:  # long texts: one walk in place of a scan for each group
        out, i, j = [], 0, 0
        for cut in both:
            pair = ([], [])
            while i < len(ends[0]) and ends[0][i][0] <= cut:
                pair[0].append(ends[0][i][1])
                i += 1
            while j < len(ends[1]) and ends[1][j][0] <= cut:
                pair[1].append(ends[1][j][1])
                j += 1
            out.append(pair)
    return out


def plain(rows):
    found, holders = [], Counter()
    for (doc, _), sides in zip(rows, plain_tokens([t for _, t in rows]), strict=True):
        cut = plain_groups(*sides)
        links = Counter()
        for a, b in cut:
            for x, n in Counter(a).items():
                for y, m in Counter(b).items():
                    links[x, y] += n * m
        found.append((doc, *map(len, sides), cut, links))
        holders.update(links.keys())
    top = defaultdict(int)
    for (x, _), n in holders.items():
        top[x] = max(top[x], n)
    for doc, n_a, n_b, cut, links in found:
        told = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in cut)
        yield (doc, n_a, n_b, len(cut), sum(links.values()), sum(n for p, n in links.items() if holders[p] == top[p[0]]), sum(n * holders[p] for p, n in links.items()), hashlib.sha256(told.encode()).hexdigest() if n_a else "")


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=str)


def test_query_over_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    assert rows_of(crosstok.op12_cross_tokenizer(spark, sf)) == sorted(plain(rows), key=str)


@pytest.mark.parametrize("piece_size, share", [(crosstok.PIECE, crosstok.SHARE), (7, 20), (64, 1)])
def test_edges_in_pieces_with_and_without_common_pairs(spark, piece_size, share):
    rows = [(None if i == 3 else i // 2, t) for i, t in enumerate(EDGES)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("clash")).withColumn("keys", F.lit(1)).repartition(3)
    aligned = written(crosstok.align(docs, piece_size=piece_size), "aligned")
    found = crosstok.scored(aligned, written(crosstok.pair_counts(aligned), "pairs"), share).withColumnRenamed("id", "doc_id")
    assert rows_of(found) == sorted(plain(rows), key=str)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    aligned = written(crosstok.align(docs), "aligned")
    assert crosstok.scored(aligned, written(crosstok.pair_counts(aligned), "pairs")).collect() == []
    assert crosstok.token_groups(docs).collect() == []


def test_groups_are_the_texts_bytes(spark):
    rows = [(i, t) for i, t in enumerate(EDGES)]
    found = defaultdict(list)
    for r in crosstok.token_groups(spark.createDataFrame(rows, "doc_id long, text string"), piece_size=50).orderBy("id", "group").collect():
        found[r.id].append(r)
    for (i, text), sides in zip(rows, plain_tokens(EDGES), strict=True):
        assert [(r.a_ids, r.b_ids) for r in found[i]] == [tuple(x) for x in plain_groups(*sides)]
        if found[i]:
            assert [r.start for r in found[i]] == [0, *[r.stop for r in found[i]][:-1]] and found[i][-1].stop == len((" " + text).encode())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=40), st.lists(st.integers(1, 60), max_size=40), st.integers(1, 9))
def test_merge_path_is_a_merge(a, b, size):
    """Each split takes as many of a as a stable merge of both has by then."""
    a, b = np.unique(np.array(a, np.int64)), np.unique(np.array(b, np.int64))
    merged = sorted([(x, 0) for x in a.tolist()] + [(x, 1) for x in b.tolist()])
    marks = [*range(0, len(merged), size), len(merged)]
    assert crosstok.merge_path(a, b, size).tolist() == [sum(1 for _, s in merged[:d] if s == 0) for d in marks]


@settings(max_examples=300, deadline=None)
@given(st.sets(st.integers(1, 80), max_size=40), st.sets(st.integers(1, 80), max_size=40), st.integers(1, 9))
def test_pieces_stitch_to_the_same_groups(a, b, size):
    ends = [np.array(sorted(x | {90}), np.int64) for x in (a, b)]
    ids = [np.arange(len(x)) for x in ends]
    found = []
    for ia, na, ib, nb in crosstok.groups(ids[0], ends[0], ids[1], ends[1], size):
        i = j = 0
        for n, m in zip(na.tolist(), nb.tolist(), strict=True):
            found.append((ia[i : i + n].tolist(), ib[j : j + m].tolist()))
            i, j = i + n, j + m
    cuts, low, expected = sorted((a & b) | {90}), 0, []
    for cut in cuts:
        expected.append(tuple([int(t) for t, e in zip(x, y, strict=True) if low < e <= cut] for x, y in zip(ids, ends, strict=True)))
        low = cut
    assert found == expected


def test_dense_groups_and_packing():
    a, b = np.arange(100) % 7, np.arange(90) % 5
    whole = crosstok.linked(a, np.array([100]), b, np.array([90]))
    expected = Counter((int(x), int(y)) for x in a for y in b)
    assert {(int(k >> 32), int(k & 0xFFFFFFFF)): int(n) for k, n in zip(*whole, strict=True)} == expected
    assert crosstok.unpacked(crosstok.packed(whole[0])).tolist() == whole[0].tolist()
    high = np.array([0, 5, (50256 << 32) | 31999])
    assert crosstok.unpacked(crosstok.packed(high)).tolist() == high.tolist()
