import datetime as dt

import pytest
from pyspark.sql import functions as F

from sourceloom.operators import analytics as an
from sourceloom.streaming import stateful as sf, windows as sw

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture(autouse=True)
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKS)
    yield
    spark.conf.set(key, before)


def test_state_equals_batch(spark, tmp_path):
    outcome = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "empty").otherwise("ok")
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", F.floor("value").cast("long").alias("tokens"), outcome.alias("outcome"))
    # files in time order, one a trigger
    early = events.agg(F.expr("percentile_approx(ts, 0.5)").alias("m")).first().m
    events.where(F.col("ts") <= early).coalesce(1).write.parquet(str(tmp_path / "in"))
    events.where(F.col("ts") > early).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = sw.stream_of(spark, str(tmp_path / "in"), events.schema)
    got = sw.drained(sf.running_budget(stream, 800), "budgets", str(tmp_path / "c1"))
    want = an.running_budget(events, 800)
    key = lambda df: sorted((r.user_id, r.event_id, r.spent, r.level) for r in df.collect())
    assert key(got) == key(want)
    got = sw.drained(sf.cooldowns(stream), "cooling", str(tmp_path / "c2"))
    longest = {}
    for r in got.collect():
        longest[r.user_id] = max(longest.get(r.user_id, (0, 0)), (r.failures, r.cooldown))
    runs = {}
    for r in an.failure_runs(events).collect():
        runs[r.user_id] = max(runs.get(r.user_id, (0, 0)), (r.failures, r.cooldown))
    assert longest == runs


SCHEMA = "user_id long, event_id long, ts timestamp, outcome string, tokens long"


def _files(spark, folder, triggers):
    for n, rows in enumerate(triggers):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return sw.stream_of(spark, folder, spark.createDataFrame([], SCHEMA).schema)


def test_cooldowns_end_by_timer(spark, tmp_path):
    at = lambda minutes: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)
    # 1 fails twice, is free after ten minutes, and fails anew; 2 goes on failing within its cooldown; 3 recovers by itself
    triggers = [
        [(1, 1, at(0), "failed", 0), (1, 2, at(1), "failed", 0), (2, 3, at(1), "failed", 0), (3, 4, at(1), "failed", 0)],
        [(2, 5, at(3), "failed", 0), (3, 6, at(2), "ok", 0), (9, 7, at(40), "ok", 0)],
        [(9, 8, at(41), "ok", 0)],
        [(1, 9, at(42), "failed", 0), (9, 10, at(90), "ok", 0)],
        [(9, 11, at(91), "ok", 0)],
    ]
    stream = _files(spark, str(tmp_path / "in"), triggers)
    got = sw.drained(sf.cooldowns(stream, late="1 minute"), "freed", str(tmp_path / "c")).collect()
    by = lambda user: [(r.event_id, r.failures, r.cooldown) for r in got if r.user_id == user and not r.free]
    assert by(1) == [(1, 1, 300), (2, 2, 600), (9, 1, 300)] and by(2) == [(3, 1, 300), (5, 2, 600)] and by(3) == [(4, 1, 300)]
    assert sorted(r.user_id for r in got if r.free) == [1, 1, 2]


def test_expired_owners_leave_the_store(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    stream = _files(spark, str(tmp_path / "in"), [[(1, 1, at, "ok", 700)], [(1, 2, at, "ok", 50), (2, 3, at + dt.timedelta(hours=3), "ok", 5)], [(2, 5, at + dt.timedelta(hours=5), "ok", 0)], [(1, 4, at + dt.timedelta(hours=9), "ok", 5)]])
    kept = sw.drained(sf.running_budget(stream, 800, late="1 minute"), "held", str(tmp_path / "c1")).collect()
    assert {r.event_id: r.spent for r in kept} == {1: 700, 2: 750, 3: 5, 5: 5, 4: 755}
    gone = sw.drained(sf.running_budget(stream, 800, late="1 minute", ttl_ms=3_600_000), "forgot", str(tmp_path / "c2")).collect()
    assert {r.event_id: r.spent for r in gone} == {1: 700, 2: 750, 3: 5, 5: 5, 4: 5}
    left = spark.read.format("statestore").option("stateVarName", "number").load(str(tmp_path / "c2"))
    assert left.count() == 1  # of the owner who came last
