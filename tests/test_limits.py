"""Rate limits with timers: shuffled micro-batches give the sorted stream's result, and state of silent users goes."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestone.streaming import limits

RULES = [limits.FixedWindow(3, 60.0), limits.Bucket(2.0, 1 / 30)]


def made(seed, n=240, users=6):
    rng = random.Random(seed)
    return sorted((round(rng.random() * 1500 + 5, 3), i, rng.randrange(users)) for i in range(n))


def plain(rule, rows):
    state, out = {}, {}
    for at, event, user in sorted(rows):
        state[user], out[event] = rule.judge(state.get(user), at)
    return out


def write(spark, rows, path):
    df = spark.createDataFrame([(e, u, float(at)) for at, e, u in rows], "event_id long, user_id long, t double")
    df.select("event_id", "user_id", F.timestamp_millis((F.col("t") * 1000).cast("long")).alias("ts")).coalesce(1).write.mode("append").parquet(path)


def judged(spark, path, rule, late):
    rows = spark.readStream.schema("event_id long, user_id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    out = limits.limited(rows, rule, late)
    with limits.rocksdb(spark):
        query = out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    return {r.event_id: r.allowed for r in spark.read.schema(out.schema).parquet(f"{path}/out").collect()}, query.recentProgress


@pytest.mark.parametrize("rule", RULES, ids=lambda r: type(r).__name__)
def test_shuffled_batches(spark, tmp_path, rule):
    rows = made(1)
    random.Random(2).shuffle(rows)
    for k in range(3):
        write(spark, rows[k::3], f"{tmp_path}/in")
    write(spark, [(1e7, -1, -1)], f"{tmp_path}/in")
    found, progress = judged(spark, str(tmp_path), rule, "2 hours")
    assert found == plain(rule, [(round(at * 1000) / 1000, e, u) for at, e, u in rows])
    counts = [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]
    assert max(counts) >= len(rows) and counts[-1] <= 4  # only the last event waits; nothing is kept of users who fell silent


@pytest.mark.parametrize("rule", RULES, ids=lambda r: type(r).__name__)
def test_no_state_judges_as_forgotten_state(rule):
    for _, rows in ((s, made(s)) for s in range(5)):
        state = None
        for at, _, _ in rows:
            after = rule.judge(state, at)
            if state is not None and at >= rule.forgotten(state):
                fresh = rule.judge(None, at)
                assert fresh[0] == pytest.approx(after[0]) and fresh[1] == after[1]
            state = after[0]


def test_disorder_of_files(spark, tmp_path):
    for rows in ([(10, 1, 1), (50, 2, 1)], [(45, 3, 1), (90, 4, 1)], [(20, 5, 1)]):
        write(spark, rows, f"{tmp_path}/in")
    assert limits.disorder(spark.read.parquet(f"{tmp_path}/in")) in (72, 32, 47, 7)  # files written in one second go by name


def test_one_timer_judges_all_that_is_due():
    class Map(dict):
        def updateValue(self, k, v):
            self[k] = v

        def removeKey(self, k):
            del self[k]

    class Value:
        held = None

        def get(self):
            return self.held

        def update(self, x):
            self.held = x

        def clear(self):
            self.held = None

    judge, timers = limits.Judge(limits.FixedWindow(3, 60.0)), []
    handle = type("Handle", (), {"getMapState": lambda *_: Map(), "getValueState": lambda *_: Value(), "registerTimer": lambda _, t: timers.append(t)})()
    judge.init(handle)
    at = lambda t: type("Time", (), {"getCurrentWatermarkInMs": lambda _: t})()
    events = [(i * 1_000_000, i) for i in range(200)]
    list(judge.handleInputRows((7,), iter([pd.DataFrame(events[::-1], columns=["at", "event_id"])]), at(0)))
    assert timers == [1]  # one, not one an event
    first = list(judge.handleExpiredTimer((7,), at(100_500), None))
    assert [len(x) for x in first] == [101] and len(judge.waiting) == 99 and timers[1:] == [101_001, 120_002]
    rest = list(judge.handleExpiredTimer((7,), at(10**6), None))
    found = {r.event_id: r.allowed for x in first + rest for r in x.itertuples()}
    assert found == plain(limits.FixedWindow(3, 60.0), [(a / 1e6, e, 7) for a, e in events])
    assert not judge.waiting and judge.used.get() is None and judge.first.get() is None
