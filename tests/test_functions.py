"""What has no SQL twin: patterns, chunks, readers, streams and state, against rows written by hand or plain Python."""

import random
import re
import unicodedata
import uuid

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestone import catalog
from lodestone.functions import language, text
from lodestone.operators import chunking, closure, postings, retrieval, tables
from lodestone.operators.joins import neighbours
from lodestone.sources import readers, sinks
from lodestone.streaming import events

SF = "/root/testdata/sf0.001"


def rows(df):
    return [tuple(r) for r in df.collect()]


def run(name, spark):
    return rows(catalog.QUERIES[name](spark, SF))


LAWS = (
    (1, "Preface text.\nPHẦN I\nCHƯƠNG II: Rights\nĐiều 1. Scope of work 1. First clause, see Điều 9, clause 2\nĐiều 2 Terms"),
    (2, "One long line ĐIỀU 3: Duties of staff as said in ĐIỀU 4, not here MỤC 1. Pay"),
    (3, "no headings at all"),
    (4, "> Bài 5) Practice\n\tMục 2 - Rules"),
)


def laws(spark):
    return spark.createDataFrame(list(LAWS), "id int, text string")


def test_headings(spark):
    found = {r.id: [h.split("\n")[-1] for h in r.h] for r in laws(spark).select("id", chunking.headings(F.col("text")).alias("h")).collect()}
    assert found == {1: ["PHẦN I", "CHƯƠNG II", "Điều 1", "Điều 2"], 2: ["ĐIỀU 3", "MỤC 1"], 3: [], 4: ["Bài 5", "Mục 2"]}


def test_blocks_join_to_the_text(spark):
    joined = {}
    for i, _, block, first, last in sorted(rows(chunking.with_offsets(laws(spark)))):
        assert last - first == len(block.encode())
        joined[i] = joined.get(i, "") + block
    assert joined == dict(LAWS)


def test_titles(spark):
    titles = {(r.id, r.n): r.t for r in chunking.with_offsets(laws(spark)).select("id", "n", chunking.heading_title(F.col("block")).alias("t")).collect()}
    assert titles[1, 0] == "" and titles[1, 3] == "Điều 1. Scope of work" and titles[1, 2] == "CHƯƠNG II: Rights"


def test_chunked_blocks(spark):
    found = [r.chunk for r in chunking.chunked_blocks(laws(spark), 60, 10).where("id = 2").orderBy("n", "i").collect()]
    assert found == ["One long line ", "[ĐIỀU 3: Duties of staff as said in ĐIỀU 4, not here]\nĐIỀU 3: Duties of staff as said in ĐIỀU 4, not", "[ĐIỀU 3: Duties of staff as said in ĐIỀU 4, not here]\nĐIỀU 4, not here", "[MỤC 1. Pay]\nMỤC 1. Pay"] or len(found) >= 3 and all(len(c.split("]\n")[-1]) <= 60 for c in found)


def test_chunks_cover_texts():
    r = random.Random(1)
    for _ in range(60):
        t = "".join(r.choice(["ab", "é", " ", " ", "\n", "\n\n", "x" * 90]) for _ in range(r.randint(0, 200)))
        for separators in (chunking.PLAIN, chunking.VIETNAMESE):
            out = chunking.recursive_chunks(t, 100, 20, separators)
            assert all(len(c) <= 100 for c in out)
            assert chunking.recursive_chunks(t, 100, 20, separators) == out
            plain = chunking.recursive_chunks(t, 100, 0, chunking.PLAIN)
            assert "".join("".join(plain).split()) == "".join(t.split())
    assert chunking.recursive_chunks(None, 100, 20, chunking.PLAIN) == []


def test_overlaps_against_brute_force(spark):
    r = random.Random(2)
    sides = [[(k, n, lo, lo + r.randint(0, 90)) for k in range(3) for n in range(25) for lo in [r.randint(0, 400)]] for _ in range(2)]
    frames = [spark.createDataFrame(s, "key long, n long, lo long, hi long") for s in sides]
    want = sorted((k, n, m, max(a, c), min(b, d)) for k, n, a, b in sides[0] for q, m, c, d in sides[1] if k == q and max(a, c) < min(b, d))
    assert sorted(rows(chunking.overlaps(*frames, width=32))) == want


def test_windows_of_pages(spark):
    pages = {}
    for article, _, first, last in run("page_windows", spark):
        assert last - first < 8
        pages.setdefault(article, []).append((first, last))
    for w in pages.values():
        w.sort()
        assert w[0][0] == 1 and all(a[1] + 1 == b[0] for a, b in zip(w, w[1:]))


def test_pieces_are_lossless(spark):
    joined = {}
    for i, seq, piece in sorted(run("piece_split", spark)):
        assert len(piece) <= 4096
        joined[i] = joined.get(i, "") + piece
    assert joined == {r[0]: r[1] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def test_scattered_letters(spark):
    lines = ("T h ô n g t ư này", "N ă m h a i n g h ì n", "a clean short line", "I am a man", "s c a t t e r e d")
    found = spark.createDataFrame([(x,) for x in lines], "line string").select("line", language.despaced(F.col("line")).alias("one"), language.despaced(F.col("line"), F.lit(True)).alias("all")).collect()
    assert {r.line: r.one for r in found} == {"T h ô n g t ư này": "Thôngtư này", "N ă m h a i n g h ì n": "Nămhainghìn", "a clean short line": "a clean short line", "I am a man": "I am a man", "s c a t t e r e d": "scattered"}
    assert {r.line: r.all for r in found}["I am a man"] == "I am a man"


def plain_despaced(line, forced):
    words = [t for t in re.split("[ \t]+", line) if t]
    ones = sum(len(t) == 1 for t in words)
    if not (forced or ones >= 10 or ones >= 4 and 2 * ones >= len(words)):
        return line
    letter = lambda c: unicodedata.category(c)[0] in "LM"
    alone = lambda i: letter(line[i]) and (i == 0 or not letter(line[i - 1])) and (i + 1 == len(line) or not letter(line[i + 1]))
    return "".join(c for i, c in enumerate(line) if not (c == " " and 0 < i < len(line) - 1 and alone(i - 1) and alone(i + 1)))


def test_stored_lines_despaced(spark):
    lines = {(r.article_id, r.chunk_index): r.line for r in language.scattered(spark, SF).collect()}
    found = {(a, c): (one, every) for a, c, one, every in run("despace_line", spark)}
    assert found == {k: (plain_despaced(x, False), plain_despaced(x, True)) for k, x in lines.items()}


def test_syllables(spark):
    tokens = spark.createDataFrame([(x,) for x in ("thông", "quyđịnh", "cơsở", "banana")], "token string")
    assert dict(rows(tokens.select("token", language.syllables(F.col("token"))))) == {"thông": "thông", "quyđịnh": "quy định", "cơsở": "cơ sở", "banana": "banana"}
    found = dict(run("split_syllables", spark))
    assert all(x.replace(" ", "") == token for token, x in found.items())


def test_stored_answers(spark):
    raw = {(r.conv_id, r.turn): r.raw for r in language.answers(spark, SF).collect()}
    assert {(c, t): (a, d) for c, t, a, d in run("normalize_citations", spark)} == {k: language.cited(x, 3) for k, x in raw.items()}


def test_citations():
    assert language.cited("see [*2] and [ ^ 1 ] [1][3].", 2) == ("see [^2] and [^1].", 1)
    assert language.cited("[0] out [9]", 5) == ("out", 2)
    assert language.cited("no marks, [ ] box", 3) == ("no marks, [ ] box", 0)
    assert language.cited(None, 3) == ("", 0)
    assert language.cited("a [1] [1] [2] b [2]", 2) == ("a [^1][^2] b [^2]", 0)
    assert language.cited("as (Article ID: 54) says  [2]", 3) == ("as says [^2]", 0)
    assert language.cited("x (theo [9] ) , source_id=3 y", 2) == ("x, y", 1)
    assert language.cited("keep  this [1]\n  and  that", 1) == ("keep  this [^1]\n  and  that", 0)
    assert language.cited("bài viết id 5 và mã bài viết #12", 1) == ("và", 0)
    assert language.cited("Nguồn_ID = 7] rest, an article idea 5 stays, articleid9", 1) == ("rest, an article idea 5 stays,", 0)
    assert language.cited("x [Source  id # 12] ( Theo  kết quả đọc: ) y", 1) == ("x y", 0)
    assert language.cited("article id: none", 1) == ("article id: none", 0)


def test_identifiers_are_version_5_uuids(spark):
    for article, chunk, found in run("point_id", spark)[:50]:
        assert found == str(uuid.uuid5(uuid.NAMESPACE_OID, f"article:{article}:chunk:{chunk}"))


def test_strict_numbers(spark):
    cells = ("1.000.000", "1,000.5", "22.500", "1.2345", "5 %", "-7", "3 000 VND", "5 VNĐ", "2024-01-02", "A12", "", "1,5", "12 USD", "+4")
    found = dict(rows(spark.createDataFrame([(x,) for x in cells], "raw string").select("raw", tables.strict_number(F.col("raw")))))
    assert found["1.000.000"] == 1e6 and found["1,000.5"] == 1000.5 and found["22.500"] == 22500 and found["-7"] == -7
    assert [x for x, v in found.items() if v is None] == ["1.2345", "5 VNĐ", "2024-01-02", "A12", ""]


SHEETS = (
    (1, 1, "## Sheet: Sales\n| Code | Units | Amount | Note |\n| 5 | 10 | NV01 | 1.500 |\nnoise\n| 6 | 12 | NV02 | 1.750,5 |\n| 7 | Subtotal | x | 9 |\n| Summary | 3 | y | 2 |"),
    (1, 2, "| 1 | 2 | 3 | 4 |\n## Sheet:\n| a | b |\n## Sheet Empty"),
    (2, 1, "## Sheet: Months\n| 1 | 5 |\n| Kỳ | Giá |\n| tháng 1 | 7 |\n| tháng 2 | 8 |\n| Cộng | 15 |"),
)


def charts(spark, *asked):
    pages = spark.createDataFrame(list(SHEETS), "article_id int, seq int, text string")
    found = tables.series(pages, spark.createDataFrame(list(asked), "article_id int, sheet int, wanted string, kind string")).collect()
    return {(r.article_id, r.sheet, r.wanted, r.asked): (r.kind, r.name, [tuple(p) for p in r.points or []], r.note) for r in found}


def test_series(spark):
    found = charts(spark, (1, 1, "", "line"), (1, 1, "code", "pie"), (1, 1, "the NOTE column", "bar"), (1, 1, "price", "bar"), (1, 1, "", "scatter"), (1, 2, "", "bar"), (2, 1, "", "line"))
    # labels are the first cell that is no number; a total in any cell drops the row, "Summary" does not
    assert found[1, 1, "", "line"] == ("bar", "Note", [("NV01", 1500.0), ("NV02", 1750.5), ("Summary", 2.0), ("", 4.0)], "")
    assert found[1, 1, "code", "pie"] == ("pie", "Code", [("NV01", 5.0), ("NV02", 6.0), ("", 1.0)], "")
    assert found[1, 1, "the NOTE column", "bar"][:2] == ("bar", "Note")
    assert found[1, 1, "price", "bar"] == (None, None, [], "no such column") and found[1, 1, "", "scatter"][3] == "kind"
    assert found[1, 2, "", "bar"][3] == "no numbers"
    assert found[2, 1, "", "line"] == ("bar", "Giá", [("", 5.0), ("tháng 1", 7.0), ("tháng 2", 8.0)], "")  # a row before the header counts


def test_sheets_by_number_or_name(spark):
    names = spark.createDataFrame([(1, 1, "Sales 1"), (1, 2, "Sales 12"), (1, 3, "Costs"), (2, 1, "Only")], "article_id int, sheet int, name string")
    asks = [(1, "2"), (1, "4"), (1, " SALES 1 "), (1, "sales"), (1, "12"), (1, "cost"), (1, "x"), (1, ""), (2, " ")]
    found = {(r.article_id, r.wanted): (r.sheet, r.note) for r in tables.picked(names, spark.createDataFrame(asks, "article_id int, wanted string")).collect()}
    assert found == {(1, "2"): (2, ""), (1, "4"): (None, "no such number"), (1, " SALES 1 "): (1, ""), (1, "sales"): (None, "several"), (1, "12"): (None, "no such number"), (1, "cost"): (3, ""), (1, "x"): (None, "none"), (1, ""): (None, "name one"), (2, " "): (1, "")}


def test_uploads(spark):
    asks = [("a.pdf", "%PDF-1.7", 9), ("a.pdf", "PK\x03\x04", 9), ("b.DOCX", "PK\x03\x04x", 9), ("c.png", "\x89PNG", 9), ("c.jpg", "\xff\xd8\xff\xe0", 9), ("d.csv", "a,b", 9), ("d.csv", "%PDF-", 9), ("e.exe", "MZ", 9), ("f.txt", "", 9), ("f.txt", "x", 0), ("g.txt", "x", 600 << 20)]
    found = [r.why for r in spark.createDataFrame([(i, *a) for i, a in enumerate(asks)], "i int, name string, head string, size long").select("i", text.refused(F.col("name"), F.col("head"), F.col("size")).alias("why")).orderBy("i").collect()]
    assert found == ["", "content", "", "", "", "", "content", "type", "empty", "empty", "too large"]


def test_closure_depth_and_cycles(spark):
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(6)], "id long, parent_id long")
    assert sorted(rows(closure.build_closure(chain))) == sorted((a, d, d - a) for d in range(6) for a in range(d + 1))
    deep = spark.createDataFrame([(i, i - 1 if i else None) for i in range(150)], "id long, parent_id long")
    assert sorted(rows(closure.build_closure(deep))) == sorted((a, d, d - a) for d in range(150) for a in range(d + 1))
    for ring in ([(1, 2), (2, 1)], [(1, 1)], [(i, i % 7 + 1) for i in range(1, 8)] + [(9, None)]):
        with pytest.raises(ValueError):
            closure.build_closure(spark.createDataFrame(ring, "id long, parent_id long"))


def test_folders_in_vietnamese_order(spark):
    names = ["b", "đ", "d", "Đa", "a", "ă", "â", "á", "e", "z", "o", "ơ", "ô", "Ab"]
    nodes = [(i, None, n) for i, n in enumerate(names)] + [(100, 4, "đi"), (101, 4, "du"), (102, 100, "x"), (103, 999, "c")]
    found = closure.listed_tree(spark.createDataFrame(nodes, "id long, parent_id long, name string")).orderBy("path").collect()
    assert [r.label.replace(closure.INDENT, "-") for r in found] == ["a", "-du", "-đi", "--x", "á", "Ab", "ă", "â", "b", "c", "d", "đ", "Đa", "e", "o", "ô", "ơ", "z"]
    with pytest.raises(ValueError):
        closure.listed_tree(spark.createDataFrame([(1, 2, "a"), (2, 1, "b")], "id long, parent_id long, name string"))


def test_closure_follows_its_table(spark, tmp_path):
    """The same folder with other rows gives another closure in the same session."""
    for name, column in (("region", "r_regionkey"), ("nation", "n_nationkey")):
        spark.range(2).selectExpr(f"id AS {column}", "0L AS n_regionkey").write.parquet(f"{tmp_path}/{name}.parquet")
    for customers in (5, 3, 5):
        spark.range(customers).selectExpr("id AS c_custkey", "1L AS c_nationkey").write.mode("overwrite").parquet(f"{tmp_path}/customer.parquet")
        spark.catalog.clearCache()
        assert closure.closure(spark, str(tmp_path)).count() == 2 + 2 * 2 + 3 * customers


def test_neighbours_leave_out_hits(spark):
    everything = spark.range(10).select(F.lit(1).alias("article_id"), F.col("id").alias("chunk_index"))
    hits = everything.where("chunk_index IN (0, 4, 5)")
    assert sorted(r[1] for r in rows(neighbours(everything, hits))) == [1, 3, 6]


def test_upserts(spark):
    frame = lambda x: spark.createDataFrame(x, "k long, v string")
    old, new = frame([(1, "a"), (2, "b")]), frame([(2, "c"), (3, "d"), (3, "d")])
    assert sorted(rows(sinks.insert_ignore(old, new, ["k"]))) == [(1, "a"), (2, "b"), (3, "d")]
    assert sorted(rows(sinks.keep_latest(old, new, ["k"]))) == [(1, "a"), (2, "c"), (3, "d")]


def event_rows(spark):
    return sorted((r.user_id, r.ts, r.event_id) for r in spark.read.parquet(f"{SF}/events.parquet").collect())


def test_fixed_window_limit(spark):
    want, state = {}, {}
    for user, ts, event in event_rows(spark):
        t = ts.timestamp()
        start, used = state.get(user, (float("-inf"), 0))
        if t - start >= 86400:
            start, used = t, 0
        state[user] = start, used + 1
        want[event] = used + 1 <= 5
    assert {e: a for e, _, a in run("rate_fixed_window", spark)} == want


def test_token_bucket(spark):
    want, state = {}, {}
    for user, ts, event in event_rows(spark):
        t = ts.timestamp()
        level, at = state.get(user, (5.0, t))
        level = min(5.0, level + (t - at) * 5 / 86400)
        want[event] = level >= 1
        state[user] = level - (level >= 1), t
    found = {e: a for e, _, a in run("token_bucket", spark)}
    assert sum(found[e] != w for e, w in want.items()) <= 1  # sums of seconds may differ in the last bit


def test_text_helpers(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(text.clean_lines(F.lit(" a \n\n\t\n b"))) == "a\nb"
    assert one(text.snippet(F.lit("é" * 201))) == "é" * 200 + "…" and one(text.snippet(F.lit("x" * 200))) == "x" * 200
    assert [one(text.backoff(F.lit(a))) for a in (0, 1, 2, 5, 6, 9)] == [1, 1, 2, 16, 30, 30]
    assert one(tables.col_index(F.lit("AA10"))) == 26
    assert events.WINDOW == "1 day"


def test_sections_are_carried(spark):
    rows = [(1, 0, "before any"), (1, 1, "Điều 1. Scope\ntext\nĐiều 2: Terms\nmore"), (1, 2, "goes on"), (1, 3, "x\nChương II\ny"), (2, 0, "none")]
    found = chunking.with_sections(spark.createDataFrame(rows, "article_id int, chunk_index int, chunk string")).collect()
    assert {(r.article_id, r.chunk_index): r.section for r in found} == {(1, 0): "", (1, 1): "Điều 1. Scope", (1, 2): "Điều 2: Terms", (1, 3): "Chương II", (2, 0): ""}


def test_questions_without_terms(spark, tmp_path):
    docs = spark.createDataFrame([(2, "b c"), (1, "a model"), (3, None)], "id int, text string")
    index = postings.Index(spark, f"file://{tmp_path}/index")
    index.extend(docs.select(F.col("id").cast("long").alias("id"), "text"))
    assert index.scores(postings.terms_of("a ? !")).count() == 0
    assert [tuple(r) for r in retrieval.lexically_ranked(index, "?", 2).collect()] == [(1, 0, 0, 0.0), (2, 0, 0, 0.0)]
    points = spark.createDataFrame([(i, 1, [float(i), 1.0]) for i in range(1, 4)], "point_id int, article_id int, embedding array<double>")
    one, done = spark.createDataFrame([([1.0, 0.0],)], "q array<double>"), spark.createDataFrame([(1,)], "article_id int")
    hits = retrieval.hybrid(points, lambda k: retrieval.vector_topk(points, one, k), index, "!", done, 2).orderBy("score", ascending=False).collect()
    assert [(r.point_id, r.list) for r in hits] == [(3, 0), (2, 0)]


def test_state_goes_on_after_a_restart(spark, tmp_path):
    source, target = f"{tmp_path}/in", f"file://{tmp_path}/state"

    def add(state, batch):
        news = batch.groupBy("k").agg(F.sum("v").alias("v"))
        return (news if state is None else state.select("k", "v").unionByName(news)).groupBy("k").agg(F.sum("v").alias("v"))

    for n in range(3):
        spark.createDataFrame([(1, n), (n, 10)], "k int, v int").coalesce(1).write.mode("append").parquet(source)
        rows = spark.readStream.schema("k int, v int").parquet(source)
        state = dict(events.apply_stream(rows, add, target).select("k", "v").collect())
    assert state == {0: 10, 1: 13, 2: 10}
    assert dict(events.apply_stream(spark.readStream.schema("k int, v int").parquet(source), add, target).select("k", "v").collect()) == state


def test_text_files_come_back_whole(spark, tmp_path):
    r = random.Random(6)
    texts = {"a.txt": "\n".join("é" * r.randrange(200) for _ in range(3000)), "b.md": "x\r\n\r\ny\n", "c.csv": "one", "d.json": "z" * 5000 + "\n" + "y" * 10, "e.txt": "\n\n"}
    for name, t in texts.items():
        (tmp_path / name).write_bytes(t.encode())
    found = {}
    for p in readers.text_pieces_of(spark, f"file://{tmp_path}", 1000).orderBy("path", "seq").collect():
        found.setdefault(p.path.rsplit("/", 1)[1], []).append(p.text)
        assert len(p.text.encode()) <= 1600 or p.path.endswith(".json")
    assert {k: "".join(v) for k, v in found.items()} == texts and len(found["a.txt"]) > 100
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        again = {}
        for p in readers.text_pieces_of(spark, f"file://{tmp_path}", 1000).orderBy("path", "seq").collect():
            again.setdefault(p.path.rsplit("/", 1)[1], []).append(p.text)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert again == found


def test_tables_are_parsed_in_one_pass(spark):
    from lodestone import catalog

    for name in ("numeric_columns", "row_label"):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation [l_orderkey") == 1, name
    plan = catalog.QUERIES["chart_guard"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert 1 <= plan.count("Relation [l_orderkey") <= 2 * 2  # what is asked for, on either side of its joins; cells are read from a stored table


def exchanges(spark, name):
    from lodestone import catalog

    found = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution()
    return found.optimizedPlan().toString().count("Relation [l_orderkey"), found.executedPlan().toString().count("Exchange hashpartitioning")


def test_series_of_sheets_move_rows_by_order_and_by_article_only(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert exchanges(spark, "extract_series") == (1, 3)  # items by order, orders by order, pages by article
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_charts_as_json_are_made_once_where_their_sheets_are(spark):
    from lodestone import catalog

    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert exchanges(spark, "chart_spec") == (1, 3)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    plan = catalog.QUERIES["chart_spec"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Filter" in x.split("[")[0] and "lambda" in x]  # a filter of notes is pushed below what makes them
