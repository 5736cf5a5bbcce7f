"""Batches that run twice give the same rows; state lets go of what has expired."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from skein.streaming import jobs


def run_twice(spark, batches, write, out, schema):
    """Each batch fails after its write, runs again, and once more after its commit, as after a lost driver."""
    store = jobs.Batches(spark, out)
    for k, rows in enumerate(batches):
        write(rows, k, store)
        assert store.rows(schema).where(F.col("batch") == k).count() == 0  # not committed, not seen
        write(rows, k, store)
        store.commit(k)
        write(rows, k, store)
        store.commit(k)
    return store.rows(schema)


def run_once(spark, batches, write, out, schema):
    store = jobs.Batches(spark, out)
    for k, rows in enumerate(batches):
        write(rows, k, store)
        store.commit(k)
    return store.rows(schema)


@pytest.mark.parametrize(("write", "schema", "made"), [
    (jobs.add_memory, jobs.MEMORY, lambda s, k: s.range(k * 5, k * 5 + 8).selectExpr("concat('{\"content\":\"t', id, '\"}') AS value")),
    (jobs.add_engagement, jobs.ENGAGEMENT, lambda s, k: s.range(k * 5, k * 5 + 8).selectExpr("id % 3 AS user_id", "IF(id % 2 = 0, 'view', 'click') AS event_type")),
    (jobs.split_late, jobs.LATE, lambda s, k: s.range(k * 5, k * 5 + 8).selectExpr("id AS event_id", "timestamp_seconds(86400 * (id * 7 % 11)) AS ts")),
])
def test_a_batch_that_runs_again_replaces_itself(spark, tmp_path, write, schema, made):
    batches = [made(spark, k) for k in range(3)]
    twice = run_twice(spark, batches, write, str(tmp_path / "twice"), schema)
    once = run_once(spark, batches, write, str(tmp_path / "once"), schema)
    assert sorted(map(repr, twice.collect())) == sorted(map(repr, once.collect())) and once.count() > 0


def test_entries_leave_the_state(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    begin = datetime(2024, 1, 1)
    parts = [[(1, 0, True), (2, 0, True), (3, 50, False)], [(1, 200, True), (4, 290, True), (5, 4000, False)], [(6, 8000, True)]]
    live = []
    for part in parts:
        rows = [(k, begin + timedelta(seconds=s), p) for k, s, p in part]
        spark.createDataFrame(rows, "key long, ts timestamp, put boolean").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("key long, ts timestamp, put boolean").parquet(source).withWatermark("ts", "0 seconds")
        jobs.each_batch(jobs.cache_entries(stream, 300), "entries", lambda b, k, s: s.write(b, k), out, "update")
        held = spark.read.format("statestore").load(f"{out}/state").select("key.*").count()
        now = {r["key"]: r["live"] for r in jobs.entries_now(jobs.Batches(spark, out)).collect()}
        live.append(now)
        assert held == sum(now.values())
    assert live == [{1: True, 2: True}, {1: False, 2: False, 4: False}, {1: False, 2: False, 4: False, 6: True}]


def test_entries_share_state_rows(spark, tmp_path):
    """Keys of a group share a row of the state and a call of Python; null keys and times, and rows that only move the watermark."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    begin = datetime(2024, 1, 1)
    last = {}
    for half in range(2):
        rows = [(k, 1000 * half + k, True) for k in range(3_000) if half == 0 or k % 3 == 0] + [(None, 1000 * half + 7, True), (None, 5, True), (1, None, True), (2, 4000 * half, None), (4, 2000 * half, False)]
        for k, s, p in rows:
            if p and s is not None:
                last[k] = max(last.get(k, 0), s)
        spark.createDataFrame([(k, None if s is None else begin + timedelta(seconds=s), p) for k, s, p in rows], "key long, ts timestamp, put boolean").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("key long, ts timestamp, put boolean").parquet(source).withWatermark("ts", "1 hour")
        jobs.each_batch(jobs.cache_entries(stream, 300), "entries", lambda b, k, s: s.write(b, k), out, "update")
    rows = jobs.entries_now(jobs.Batches(spark, out)).collect()
    held = spark.read.format("statestore").load(f"{out}/state").selectExpr("key.part", "size(value.groupState.keys) AS n").collect()
    edge = 4000 - 3600
    assert {r["key"]: (r["expires_at"] - int(begin.timestamp()) * 1_000_000) // 1_000_000 for r in rows} == {k: s + 300 for k, s in last.items()}
    assert {r["key"]: r["live"] for r in rows} == {k: s + 300 > edge for k, s in last.items()}
    assert sum(r["n"] for r in held) == sum(r["live"] for r in rows) and len(held) <= jobs.GROUPS + 1


def test_last_samples_keep_n(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for lo in (0, 100):
        rows = spark.range(lo, lo + 100).selectExpr("IF(id % 10 = 0, 'rare', 'hot') AS event_type", "timestamp_seconds(id * 37 % 211) AS ts", "id AS event_id", "CAST(id AS double) AS value")
        rows.write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows.schema).parquet(source)
        jobs.each_batch(jobs.last_samples(stream, 5), "samples", lambda b, k, s: s.write(b, k), out, "update")
    got = {}
    for r in jobs.samples_now(jobs.Batches(spark, out), 5).collect():
        got.setdefault(r["event_type"], []).append(r["event_id"])
    for kind, ids in got.items():
        mine = sorted((i for i in range(200) if (i % 10 == 0) == (kind == "rare")), key=lambda i: (i * 37 % 211, i))[-5:]
        assert sorted(ids) == sorted(mine)
    assert set(got) == {"rare", "hot"}
