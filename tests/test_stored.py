"""Stored tables that change, payloads, and scans that resume."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from skein.plans import governance
from skein.sources import payload, resume, stored


def files(path):
    return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in path.rglob("*.parquet")}


def test_updates_leave_other_folders(spark, tmp_path):
    t = stored.Stored(spark, str(tmp_path), "k", {"status": "last", "hits": "sum"}, buckets=8)
    rows = lambda ids, seq, s: spark.createDataFrame([(i, seq, s, 1) for i in ids], "k long, seq long, status string, hits long")
    t.update(rows(range(40), 1, "old"), 0)
    assert t.compact() == list(range(8))
    before = files(tmp_path / "base")
    t.update(rows([3, 3], 5, "new").unionByName(rows([3], 4, "between")), 1)
    t.update(rows([3], 2, "late"), 2)
    t.update(rows([3], 2, "late"), 2)  # runs again under its number
    assert t.rows().where("k = 3").first()[:] == (3, 5, "new", 5)
    assert len(t.compact()) == 1
    after = files(tmp_path / "base")
    same = {f for f in before if after.get(f) == before[f]}
    assert len({f.split("/")[0] for f in set(before) - same}) == 1 and len({f.split("/")[0] for f in same}) == 7
    got = {r["k"]: (r["status"], r["hits"]) for r in t.rows().collect()}
    assert got == {i: ("new", 5) if i == 3 else ("old", 1) for i in range(40)} and t.compact() == []
    t.update(rows([3, 99], 9, None), 7)
    assert {r["k"]: r["status"] for r in t.rows().where("k IN (3, 99)").collect()} == {3: None, 99: None}


def test_stale_days_go(spark, tmp_path):
    path = tmp_path / "days"
    v = spark.range(200).selectExpr("id", "timestamp_seconds(1704067200 + id * 3600) AS ts").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    v.write.partitionBy("day").parquet(str(path))
    before = files(path)
    assert stored.drop_older(spark, str(path), "ts", "day", datetime(2024, 1, 3, 5)) == (2, 1)
    assert sorted(r["id"] for r in spark.read.parquet(str(path)).collect()) == list(range(53, 200))
    after = files(path)
    assert all(after[f] == before[f] for f in after if not f.startswith("day=2024-01-03"))
    assert stored.drop_older(spark, str(path), "ts", "day", datetime(2024, 1, 4)) == (1, 0)


def test_payloads(spark):
    rows = [
        (1, '[{"id": 5, "text": "a"}, {"id": "x", "text": "b", "more": [1]}, 7, null, {"text": "c"}, {"id": 1}, {"id": 1, "text": 9}, {"id": 1, "text": "  "}, {"id": 2, "text": "long text"}]'),
        (2, "[]"), (3, '{"id": 1, "text": "a"}'), (4, "[{"), (5, None), (6, "7"), (7, ""),
    ]
    good, bad = payload.documents(spark.createDataFrame(rows, "payload_id long, payload string"), longest=5)
    assert sorted(map(tuple, good.collect())) == [(1, 0, "5", "a"), (1, 1, "x", "b")]
    got = sorted(((r["payload_id"], r["place"], r["reason"]) for r in bad.collect()), key=lambda r: (r[0], r[1] or 0))
    assert got == [
        (1, 2, "not an object"), (1, 3, "not an object"), (1, 4, "no id"), (1, 5, "no text"), (1, 6, "text is no string"), (1, 7, "empty text"), (1, 8, "text too long"),
        (3, None, "not an array"), (4, None, "malformed"), (5, None, "no payload"), (6, None, "not an array"), (7, None, "malformed"),
    ]


@pytest.mark.parametrize("chunk", [1, 7, 1 << 20])
def test_scans_resume(spark, tmp_path, monkeypatch, chunk):
    monkeypatch.setattr(resume, "CHUNK", chunk)
    (tmp_path / "in").mkdir()
    a, b = tmp_path / "in" / "a.jsonl", tmp_path / "in" / "b.jsonl"
    a.write_bytes("one\n\nthrée\r\nha".encode())
    tail = resume.Tail(spark, str(tmp_path / "ledger"))
    scan = lambda: (lambda x: (sorted((r["path"][-7], r["value"]) for r in x[0].collect()), x[1]))(tail.lines(str(tmp_path / "in")))
    assert scan() == ([("a", ""), ("a", "one"), ("a", "thrée")], 15)
    with a.open("ab") as f:
        f.write(b"lf\nfour\n")
    b.write_text("x\n")
    assert scan() == ([("a", "four"), ("a", "half"), ("b", "x")], 12)  # the bytes since the last whole line
    assert scan() == ([], 0)
    a.write_text("new\n")  # written anew
    assert scan() == ([("a", "new")], 4)


def test_who_may_write(spark):
    rows = [("insert", None, "t"), ("insert", None, "u"), ("update", "t", "t"), ("update", "t", "u"), ("update", "u", "t"), ("delete", "t", None), ("delete", None, None), ("delete", "u", None), ("other", "t", "t"), (None, "t", "t")]
    df = spark.createDataFrame(rows, "op string, old string, new string")
    of = lambda role, require=True: [r[0] for r in df.select(governance.may_write(F.col("op"), F.col("old"), F.col("new"), "t", require, role)).collect()]
    assert of("user") == [True, False, True, False, False, False, False, False, False, False]
    assert of("admin") == [True, False, True, False, False, True, True, False, False, False]
    assert all(of("user", False))
