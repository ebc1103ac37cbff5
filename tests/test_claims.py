"""Claims: two claimers, a repeated batch, a killed batch, a replaced writer."""

import pytest
from pyspark.sql import functions as F

from lodestone.sources.sinks import folder
from lodestone.streaming.claims import Fenced, Queue
from lodestone.views import NOW


def queue_of(spark, n=40):
    state = spark.range(n).select("id", F.lit(None).cast("long").alias("deleted_at"), F.lit("pending").alias("extract_status"), F.lit(0).cast("long").alias("next_retry_at"))
    queue = Queue(spark, folder(spark, "queue"))
    return queue, queue.begin(state)


def requests(spark, *rows):
    return spark.createDataFrame(list(rows), "request long, worker long, wanted long")


def given(queue):
    return sorted((r.request, r.id) for r in queue.grants().collect())


def test_two_claimers_never_get_one_row(spark, tmp_path):
    queue, epoch = queue_of(spark)
    for n in range(3):
        requests(spark, (2 * n, 1, 5), (2 * n + 1, 2, 4)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    asked = spark.readStream.schema("request long, worker long, wanted long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    queue.run(asked, f"{tmp_path}/checkpoint", epoch)
    found = given(queue)
    assert [i for _, i in sorted(found, key=lambda x: x[1])] == list(range(27)) and len(found) == 27
    state = {r.id: (r.extract_status, r.next_retry_at) for r in queue.state().collect()}
    assert all(state[i] == ("processing", NOW + 900) for i in range(27)) and all(state[i][0] == "pending" for i in range(27, 40))
    queue.run(asked, f"{tmp_path}/checkpoint", epoch)
    assert given(queue) == found
    assert len({r.state for r in queue.manifest().collect()}) <= 3  # old versions are written over


def test_a_repeated_batch_changes_nothing(spark):
    queue, epoch = queue_of(spark)
    assert queue.claim(epoch, "a", 0, requests(spark, (1, 1, 3)))
    assert not queue.claim(epoch, "a", 0, requests(spark, (1, 1, 3)))
    assert queue.claim(epoch, "b", 0, requests(spark, (2, 2, 0), (3, 2, 2)))
    assert given(queue) == [(1, 0), (1, 1), (1, 2), (3, 3), (3, 4)]


def test_a_killed_batch_leaves_nothing(spark, monkeypatch):
    queue, epoch = queue_of(spark)
    queue.claim(epoch, "a", 0, requests(spark, (1, 1, 3)))
    with monkeypatch.context() as m:
        m.setattr(Queue, "check", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            queue.claim(epoch, "a", 1, requests(spark, (2, 1, 3)))
        m.setattr(Queue, "check", lambda *_: None)
        m.setattr(Queue, "_append", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):  # its state and grants are written, its row is not
            queue.claim(epoch, "a", 1, requests(spark, (2, 1, 3)))
    assert given(queue) == [(1, 0), (1, 1), (1, 2)]
    queue.claim(epoch, "a", 1, requests(spark, (2, 1, 3)))
    assert given(queue) == [(1, 0), (1, 1), (1, 2), (2, 3), (2, 4), (2, 5)]


def test_a_replaced_writer_is_refused(spark, monkeypatch):
    queue, old = queue_of(spark)
    queue.claim(old, "a", 0, requests(spark, (1, 1, 2)))
    new = Queue(spark, queue.target).begin()
    with pytest.raises(Fenced):
        queue.claim(old, "a", 1, requests(spark, (2, 1, 2)))
    Queue(spark, queue.target).claim(new, "a", 1, requests(spark, (2, 1, 2)))
    with monkeypatch.context() as m:  # it looked before it was replaced, and writes after
        m.setattr(Queue, "check", lambda *_: None)
        queue.claim(old, "a", 2, requests(spark, (3, 1, 2)))
    Queue(spark, queue.target).claim(new, "a", 2, requests(spark, (4, 2, 2)))
    assert given(queue) == [(1, 0), (1, 1), (2, 2), (2, 3), (4, 4), (4, 5)]
    assert queue.state().where("extract_status = 'processing'").count() == 6
