"""Sections and their tree against a walk by hand."""

import random

import pytest

from lodestone.operators import chunking, sections


def stack_tree(names):
    """Parent, depth and place by a stack of open sections."""
    level = lambda n: 1 if n.split()[0].upper().rstrip(":") in ("CHƯƠNG", "PHẦN") else 2 if n.split()[0].upper().rstrip(":") == "MỤC" else 3
    stack, out, children = [], [], {}
    for name in names:
        while stack and level(stack[-1]) >= level(name):
            stack.pop()
        parent = stack[-1] if stack else None
        children[parent] = children.get(parent, 0) + 1
        out.append((name, level(name), parent, len(stack), children[parent]))
        stack.append(name)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_tree_is_that_of_a_stack(spark, seed):
    rng = random.Random(seed)
    articles = {a: [f"{rng.choice(['CHƯƠNG:', 'Phần', 'Mục', 'MỤC', 'Điều', 'Bài', 'Annex'])} {i}" for i in range(rng.randint(1, 25))] for a in range(20)}
    rows = [(a, n, 2 * i) for a, names in articles.items() for i, n in enumerate(names)]
    found = sections.nested(spark.createDataFrame(rows, "article_id int, section string, start_chunk int")).orderBy("article_id", "start_chunk").collect()
    expected = [(a, *r) for a, names in articles.items() for r in stack_tree(names)]
    assert [(r.article_id, r.section, r.level, r.parent, r.depth, r.place) for r in found] == expected


def test_level_reads_letters_only(spark):
    names = ["CHƯƠNG: II", "  phần-1", "Mục3", "Điều 4", "", "Phụ lục", "12 MỤC"]
    rows = spark.createDataFrame(list(enumerate(names)), "n int, name string").select("n", chunking.section_level(sections.F.col("name")).alias("level"))
    assert [r.level for r in rows.orderBy("n").collect()] == [1, 1, 2, 3, 3, 3, 3]


def test_spans_and_compiled_text(spark):
    texts = ["no heading", "Điều 1. One\na", " ", "b", "c", "d", "e", "f beyond the span", "Điều 2. Two", "Mục 3 x\ny"]
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "article_id int, chunk_index int, chunk string")
    named = chunking.with_sections(rows).withColumnRenamed("chunk", "text").select("article_id", "chunk_index", "text", "section")
    found = {r.section: (r.start_chunk, r.batch, r.text) for r in sections.compiled(named, "m1").collect()}
    assert found == {"Điều 1. One": (1, 0, "Điều 1. One\na\n\nb\n\nc\n\nd\n\ne"), "Điều 2. Two": (8, 0, "Điều 2. Two"), "Mục 3 x": (9, 0, "Mục 3 x\ny")}
    assert {r.section: r.span for r in sections.spanned(sections.starts(named)).collect()} == {"Điều 1. One": 6, "Điều 2. Two": 1, "Mục 3 x": 6}


def test_places_without_a_headword_are_left_at_once():
    from lodestone.operators import chunking

    assert chunking.HEADING.startswith("(?m)(?=[ĐMCPB])")
    assert {w[0] for w in f"{chunking.HEADWORDS}|{chunking.UPPER}".split("|")} == set("ĐMCPB")
