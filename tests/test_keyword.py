"""The stored inverted index: equal to scoring everything, reads few folders, skips blocks."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from skein.operators import keyword
from skein.operators.keyword import UNIT, InvertedIndex


def brute(docs, queries, k):
    rows = {i: Counter(w for w in (t or "").lower().split(" ") if w) for i, t in docs}
    rows = {i: c for i, c in rows.items() if c}
    mean = sum(sum(c.values()) for c in rows.values()) / len(rows)
    df = Counter(t for c in rows.values() for t in c)
    out = {}
    for q, text in queries:
        found = []
        for i, c in rows.items():
            s = sum(round(c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) * math.log(1 + (len(rows) - df[t] + 0.5) / (df[t] + 0.5)) * UNIT) for t in {w for w in (text or "").lower().split(" ") if w} if t in c)
            if s:
                found.append((-s, i))
        out[q] = [(i, -s / UNIT) for s, i in sorted(found)[:k]]
    return {q: f for q, f in out.items() if f}


@pytest.fixture(scope="module")
def case(spark, tmp_path_factory):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(300)]
    docs = [(i, " ".join(["the", "The", *rng.choices(words, k=rng.randrange(3, 40))])) for i in range(600)] + [(1000, None), (1001, " "), (1002, "the")]
    queries = [(q, " ".join(["the", *rng.choices(words, k=4)])) for q in range(12)] + [(20, "the"), (21, "nothing-here"), (22, None), (23, "the the w1  W1")]
    table = spark.createDataFrame(docs, "id long, text string").repartition(5)
    index = InvertedIndex.build(table, str(tmp_path_factory.mktemp("kw") / "index"), buckets=16, size=4)
    return docs, queries, index, spark.createDataFrame(queries, "query_id long, text string")


def test_search_equals_scoring_everything(case):
    docs, queries, index, asked = case
    for k in (1, 10):
        got = {}
        for r in index.search(asked, k).orderBy("query_id", F.desc("score"), "id").collect():
            got.setdefault(r["query_id"], []).append((r["id"], r["score"]))
        assert got == brute(docs, queries, k)


def test_blocks_are_skipped_and_other_folders_unread(case):
    _, _, index, asked = case
    mine = index.of(index.asked(asked.where("query_id < 12")))
    all_, opened = index.opened(mine, 5).agg(F.count("*"), F.count_if("opens")).first()
    assert opened < 0.5 * all_
    one = index.of(index.asked(asked.where("query_id = 20")))
    scan = one._jdf.queryExecution().executedPlan().toString()
    assert {r["term"] for r in one.select("term").distinct().collect()} == {"the"}
    assert re.search(r"PartitionFilters: \[isnotnull\(bucket\S*\), \(bucket\S* = \d+\)\]", scan), scan


def test_blend(spark):
    a = spark.createDataFrame([(1, 5, 4.0), (1, 6, 2.0)], "query_id long, id long, score double")
    b = spark.createDataFrame([(1, 6, 0.0), (1, 7, 1.0), (2, 9, 3.0)], "query_id long, id long, distance double")
    got = [tuple(r) for r in keyword.blended(a, b, 2).select("query_id", "id", "blend", "rank").orderBy("query_id", "rank").collect()]
    assert got == [(1, 6, 0.7, 1), (1, 5, 0.6, 2), (2, 9, 0.1, 1)]


@pytest.mark.parametrize("pairs", [7, 20_000])
def test_no_document_is_joined_to_its_queries(spark, case, monkeypatch, pairs):
    """Scores are added up in the tasks, in passes of some queries; equal to scoring everything, ids twice and ties included."""
    docs, queries, index, asked = case
    monkeypatch.setattr(keyword, "PAIRS", pairs)
    monkeypatch.setattr(keyword, "TEXT", 2_000)
    twice = [(2_000 + i, t) for i, t in docs[:40]]
    halves = [(5_000, "the w1 w2"), (5_000, "w3 THE  w1")]
    table = spark.createDataFrame(docs + twice + halves, "id long, text string").repartition(3)
    found = keyword.scored(table, asked, 10)
    assert "query_id" not in found._jdf.queryExecution().analyzed().toString().split("MapInArrow", 1)[1].split("Relation")[0].split("\n", 1)[1]
    whole = [*docs, *twice, (5_000, "the w1 w2 w3 THE  w1")]
    every = brute(whole, queries, 10**6)
    rows = {i: Counter(w for w in (t or "").lower().split(" ") if w) for i, t in whole}
    rows = {i: c for i, c in rows.items() if c}
    mean, df = sum(sum(c.values()) for c in rows.values()) / len(rows), Counter(t for c in rows.values() for t in c)
    want = {}
    for q, text in queries:
        terms = {w for w in (text or "").lower().split(" ") if w}
        s = {i: round(sum(math.log(1 + (len(rows) - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) for t in terms if t in c), 4) for i, c in rows.items() if terms & set(c)}
        if s:
            want[q] = sorted(s.items(), key=lambda x: (-x[1], x[0]))[:10]
    got = {}
    for r in found.orderBy("query_id", F.desc("score"), "id").collect():
        got.setdefault(r["query_id"], []).append((r["id"], r["score"]))
    assert got == want and set(want) == set(every)
    assert "query_id" not in index.search(asked.where("query_id = 0"))._jdf.queryExecution().analyzed().toString().split("MapInArrow", 1)[1].split("\n", 1)[1]


def test_ranges_stay_whole():
    import pyarrow as pa

    at = [0, 0, 0, 1, 2, 2, 3, 3, 3, 3, 4, 7, 7, 9]
    for size in (1, 2, 5, 20):
        for most in (1, 2, 3, 20):
            batches = [pa.RecordBatch.from_pydict({"range": at[k : k + size]}) for k in range(0, len(at), size)]
            parts = [t.column("range").to_pylist() for t in keyword._ranges(batches, most)]
            assert sum(parts, []) == at and all(0 < len(set(p)) <= most for p in parts)
            assert sum(len(set(p)) for p in parts) == len(set(at))


def test_frequent_terms_are_few(spark):
    often = spark.createDataFrame([(f"t{k}", k) for k in range(1, 65)] + [("x" * 65, 900)], "term string, df long")
    assert {r["df"] for r in keyword.frequent(often, 33).collect()} == set(range(32, 65))
    assert keyword.frequent(often, 0).count() == 0 and keyword.frequent(often).count() == 64


def test_keyphrases_with_many_terms(spark, sf, monkeypatch):
    """With more terms than a broadcast may hold the frequent ones alone are broadcast, and the same rows come out."""
    from skein.plans import features

    whole = sorted(map(tuple, features.pl9(spark, sf).collect()))
    monkeypatch.setattr(keyword, "BROADCAST_ROWS", 300)
    monkeypatch.setattr(features, "broadcastable", lambda t: False)
    made = features.pl9(spark, sf)
    assert sorted(map(tuple, made.collect())) == whole and len(whole) > 0
