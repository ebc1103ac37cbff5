"""Queue writes on rows written by hand."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.sources import sinks
from lodestone.streaming import queues

STATE = "job_id long, page_num int, status string, attempts int, error string"
RESULT = "job_id long, page_num int, text string, words array<struct<text:string,conf:double>>, status string"


def test_pages_are_saved_with_words_and_confidence(spark):
    state = spark.createDataFrame([(1, 1, "processing", 3, "slow"), (1, 2, "processing", 1, None), (1, 3, "failed", 9, "bad"), (2, 1, "pending", 0, None)], STATE)
    results = spark.createDataFrame([(1, 1, "a b", [("a", 90.0), (" ", 1.0), ("b", 70.0)], None), (1, 2, "", [("  ", 5.0)], None), (1, 3, "by hand", [], "edited")], RESULT)
    found = {(r.job_id, r.page_num): tuple(r)[2:] for r in queues.pages_saved(state, results).collect()}
    assert found == {(1, 1): ("ocr_done", 0, None, "a b", ["a", "b"], 80.0), (1, 2): ("ocr_done", 0, None, "", [], None), (1, 3): ("edited", 0, None, "by hand", [], None), (2, 1): ("pending", 0, None, None, None, None)}


@pytest.mark.parametrize("page", [(9, 9), (1, 1)])
def test_a_result_without_a_page_is_an_error(spark, page):
    state = spark.createDataFrame([(1, 1, "pending", 0, None)], STATE)
    with pytest.raises(PySparkException, match="no page to save"):
        queues.pages_saved(state, spark.createDataFrame([(*page, "x", [], None)], RESULT)).collect()


def test_a_title_is_set_only_where_there_is_none(spark):
    conversations = spark.createDataFrame([(1, 7, "all", 0, ""), (2, 7, "all", 5, "mine"), (3, 8, "all", 2, "")], "conversation_id long, user_id long, scope string, last_turn long, title string")
    turns = spark.createDataFrame([(1, 7, 2, "second", "b"), (1, 7, 1, "first " * 20, "a"), (2, 7, 3, "x", "c"), (3, 7, 9, "not the owner", "d")], "conversation_id long, user_id long, turn long, content string, scope string")
    found = {r.conversation_id: tuple(r)[1:] for r in queues.touched(conversations, turns).collect()}
    assert found == {1: (7, "b", 2, ("first " * 20)[:60]), 2: (7, "c", 5, "mine"), 3: (8, "all", 2, "")}


def test_fields_in_their_order(spark):
    keys = ["name", "error", "user_id", "id", "trace_id", "a_id", "alpha"]
    fields = F.array(*[F.struct(F.lit(k).alias("key"), F.lit("x").alias("value")) for k in keys])
    assert [f.split("=")[0] for f in spark.range(1).select(text.ordered_fields(fields)).first()[0]] == ["trace_id", "a_id", "id", "user_id", "alpha", "name", "error"]


def test_words_of_marked_letters_and_digits(spark):
    rows = [("Đạo đức 12", "đạo đức 12 "), ("đạo đức", "Đạo đức 12 ba bốn"), ("  ", " x\n"), (" a ", "\t"), ("số 12", "12 số !!")]
    found = [r[0] for r in spark.createDataFrame(rows, "layer string, ocr string").select(text.merged(F.col("layer"), F.col("ocr"))).collect()]
    assert found == ["Đạo đức 12", "đạo đức\nĐạo đức 12 ba bốn", "x", "a", "số 12"]


def test_the_first_row_of_a_report_counts(spark):
    report = spark.createDataFrame([(1, "d", "s", 5, 2), (2, "d", "s", 7, 1), (3, "d", "t", 1, 3)], "user_id int, day string, site string, tokens int, event_id int")
    assert sorted(map(tuple, sinks.first_of(report, ["day", "site"], "event_id").collect())) == [(2, "d", "s", 7, 1), (3, "d", "t", 1, 3)]
