"""Operators on hand-made rows."""

import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from skein.catalog import QUERIES
from skein.functions import scores, text
from skein.operators import ann, curation, embedding, ranking, spread
from skein.plans import base, governance
from skein.sources import files


@pytest.mark.parametrize("n", [0, 1, 80, 800, 801, 1520, 1521, 3000])
def test_chunks_cover_the_text(spark, n):
    source = "".join(chr(97 + k % 26) for k in range(n))
    got = spark.createDataFrame([(source,)], "t string").select(text.chunks(F.col("t"))).first()[0]
    back = got[0] + "".join(c[80:] for c in got[1:])
    assert back == source and all(len(c) <= 800 for c in got)


def test_weights_and_recency(spark):
    w = spark.range(1).select(*scores.fusion_weights(F.lit(0.0), F.lit(0.0))).first()
    assert tuple(w) == (0.5, 0.5)
    r = spark.createDataFrame([(None,), (0.0,), (100.0,)], "t double")
    assert [x[0] for x in r.select(scores.recency(F.col("t"))).collect()] == [0.5, 0.5, 1.0]
    assert round(r.select(scores.recency(F.col("t"), F.lit(100.0 + 604800))).collect()[2][0], 3) == 0.368


def test_equal_scores_normalise_to_a_half(spark):
    c = spark.createDataFrame([(1, 1, "abc", 0.5), (1, 2, "abc", 0.5)], "query_id long, id long, chunk string, distance double")
    got = ranking.fused(c, 0, 0).orderBy("rank").collect()
    assert [r["ltr_norm"] for r in got] == [0.5, 0.5] and [r["id"] for r in got] == [1, 2]
    with pytest.raises(ValueError):
        ranking.fused(c, -1, 1)
    with pytest.raises(ValueError):
        ranking.check_k(0)


def test_config_snapshot(spark):
    rows = [("RAG_FUSION_LTR_WEIGHT", "0.7"), ("RAG_API_KEY", "x"), ("RAG_SERVICE_TOKEN", "x"), ("SUPABASE_URL", "u"), ("RAG_LONG", "x" * 250), ("OTHER", "x")]
    got = dict(map(tuple, governance.snapshot(spark.createDataFrame(rows, "key string, value string")).collect()))
    assert set(got) == {"RAG_FUSION_LTR_WEIGHT", "SUPABASE_URL", "RAG_LONG"} and got["RAG_LONG"] == "x" * 197 + "..."


def test_memory_lines(spark, tmp_path):
    lines = ['{"id":1,"content":"plain"}', '{"content":{"text":"nested"}}', '{"z":"one","n":3,"a":"two"}', "", "{broken", "7", '{"content":null}']
    (tmp_path / "m.jsonl").write_text("\n".join(lines))
    assert [r["text"] for r in files.memory_lines(spark, str(tmp_path)).collect()] == ["plain", "nested", "one | two"]
    rows = spark.createDataFrame([("a",), ("a",), ("b",)], "text string")
    once = files.append_new(rows, None)
    assert once.count() == 2 and files.append_new(rows, once.select("content_hash")).count() == 0


def test_timed_log(spark):
    rows = spark.createDataFrame([("- 2024-01-02T03:04:05Z hello there",), ("junk",)], "value string")
    assert [r["message"] for r in files.timed_log(rows).collect()] == ["hello there"]


def test_quality_without_factors(spark):
    schema = "row_id long, language string, content string, path string, repository_name string, alphanum_fraction double, avg_line_length double, size int, licenses array<string>"
    s = spark.createDataFrame([(1, "python", None, None, None, None, None, None, None), (2, "python", "import redis, numpy", "api/main.py", "redis-tools", 0.7, 50.0, 300, ["MIT"])], schema)
    got = {r["row_id"]: r for r in curation.scored(s, curation.language_config(spark)).collect()}
    assert got[1]["quality"] == 0.7 and got[2]["quality"] == 1.0 and got[2]["relevance"] > 1


def test_quality_of_a_language_without_config(spark):
    schema = "row_id long, language string, content string, path string, repository_name string, alphanum_fraction double, avg_line_length double, size int, licenses array<string>"
    s = spark.createDataFrame([(1, "cobol", "react redis", "a.py", "redis", 0.2, 10.0, 10, [])], schema)
    r = curation.scored(s, curation.language_config(spark)).first()
    assert r["quality"] == round((0 + 0.2 + 0.2) / 3, 6) and r["relevance"] == 0 and r["combined"] == r["quality"]


def test_sidecar_of_the_full_config(spark):
    stats = spark.createDataFrame([("python", 9, 4, 0.4444, 0.7, 0.5, 1.0, 0.3)], "language string, total long, kept long, ratio double, mean_quality double, min_quality double, max_quality double, mean_relevance double")
    meta = json.loads(curation.sidecar(stats, curation.language_config(spark), "our-stack").first()["meta"])
    assert meta["tags"] == ["programming", "lang-python", "our-stack", "curated", "quality-filtered", "relevance-scored", "fastapi", "uvicorn", "pydantic"]
    assert meta["sample_count"] == 4 and meta["filter_stats"]["quality_stats"]["mean_quality"] == 0.7 and meta["quality_boost"] == 0.2 and meta["priority"] == "critical"


@pytest.mark.parametrize("block", [3, 7, 1000])
def test_spread_windows_equal_plain_ones(spark, block):
    rnd = random.Random(block)
    rows = [(rnd.choice(["a", "a", "a", "b", None]), rnd.randint(0, 40), k, rnd.randint(0, 9)) for k in range(200)]
    df = spread.numbered(spark.createDataFrame(rows, "key string, at long, id long, value long"), ["key"], ["at", "id"], block)
    summed = {r["id"]: r for r in spread.running_sum(df, ["key"], "value", "sum", block).collect()}
    framed, keys, own = spread.framed(df, ["key"], 2, block)
    w = Window.partitionBy(*keys).orderBy("pos")
    near = {r["id"]: r for r in framed.withColumn("near", F.sum("value").over(w.rowsBetween(-2, 0))).withColumn("before", F.lag("value").over(w)).where(own).collect()}
    assert len(summed) == len(near) == 200
    for key in ("a", "b", None):
        mine = sorted(r for r in rows if r[0] == key) if key else sorted((r for r in rows if r[0] is None), key=lambda r: r[1:])
        for n, r in enumerate(mine):
            assert summed[r[2]]["pos"] == n + 1 and summed[r[2]]["total"] == len(mine) and summed[r[2]]["sum"] == sum(x[3] for x in mine[: n + 1])
            assert near[r[2]]["near"] == sum(x[3] for x in mine[max(0, n - 2) : n + 1]) and near[r[2]]["before"] == (mine[n - 1][3] if n else None)


@pytest.mark.parametrize("block", [2, 50, 10_000])
def test_quantiles_equal_sorted_places(spark, block):
    rnd = random.Random(block)
    rows = [(rnd.choice(["a", "a", "b", None]), rnd.choice([rnd.gauss(0, 1), 10 ** rnd.uniform(-300, 300), 3.0, -0.0, float("inf"), float("-inf"), float("nan"), None])) for _ in range(600)]
    rows += [("same", 7.0)] * 80 + [("one", 1.5)] + [("none", None)] + [("wide", x) for x in (-1.7e308, 1.7e308, 0.0, 5e-324)]
    shares = {"low": 0.0, "mid": 0.5, "p99": 0.99, "top": 1.0}
    got = {r["k"]: r for r in spread.quantiles(spark.createDataFrame(rows, "k string, x double").repartition(7), ["k"], "x", shares, block).collect()}
    assert set(got) == {"a", "b", None, "same", "one", "wide"}
    for k, r in got.items():
        x = sorted((x for q, x in rows if q == k and x is not None), key=lambda x: (x != x, x))
        assert [repr(r[s] + 0.0) for s in shares] == [repr(x[int(p * (len(x) - 1))] + 0.0) for p in shares.values()], k


def test_ranks_over_a_thousand_ranges(spark):
    """Hot ties in the first column are parted by the others, and any projection survives."""
    rows = spark.range(20_000).selectExpr("timestamp_seconds(id % 3) AS ts", "hash(id) AS h", "id")
    got = [r["id"] for r in spread.ranked(rows, ["ts", "h"], 20).orderBy("rank").collect()]
    want = sorted(rows.collect(), key=lambda r: (r["ts"], r["h"]))
    assert got == [r["id"] for r in want]
    v = spread.numbered(rows.selectExpr("'k' AS k", "*"), ["k"], ["ts", "h"], 1_000)
    assert v.agg(F.sum("pos"), F.max("total")).first()[:] == (20_000 * 20_001 // 2, 20_000)
    v, keys, own = spread.framed(v, ["k"], 199)
    mean = v.withColumn("mean", F.avg("id").over(Window.partitionBy(*keys).orderBy("pos").rowsBetween(-199, 0))).where(own)
    assert mean.agg(F.sum("mean")).first()[0] > 0 and mean.select("mean").count() == 20_000


def test_embedders(spark):
    rows = spark.createDataFrame([(1, "a b a"), (2, None), (3, "")], "id long, text string").repartition(1)
    got = {r["id"]: r["embedding"] for r in embedding.embed(rows, embedding.hashing, dim=8).collect()}
    bucket = lambda w: int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 8
    want = np.zeros(8)
    for x in "aba":
        want[bucket(x)] += 1
    assert np.allclose(got[1], want / np.linalg.norm(want)) and got[3] == [0.0] * 8

    def fails(texts):
        raise RuntimeError("no model")

    assert [r["embedding"] for r in embedding.embed(rows, fails, dim=2, allow_zero=True).collect()] == [[0.0, 0.0]] * 3
    with pytest.raises(Exception, match="no model"):
        embedding.embed(rows, fails, dim=2).collect()
    with pytest.raises(ValueError):
        embedding.embed(rows, fails)


def test_approximate_search_finds_enough(spark):
    """Both approximate forms against brute force, on the largest given table."""
    big = "/root/testdata/sf0.1"
    rows = [r["recall"] for r in QUERIES["an3_recall"](spark, big).collect()]
    assert len(rows) == 40 and sum(rows) / len(rows) >= 0.9
    corpus, asked = base.corpus_vectors(spark, big), base.query_vectors(spark, big)
    exact = ranking.knn(corpus, asked, 10)
    index = ann.SignIndex.build(corpus, bucket_rows=300)
    candidates = index.calibrated(asked, exact)
    found = [r["recall"] for r in ann.recall(index.knn(asked, 10, None, candidates), exact, 10).collect()]
    assert len(found) == 40 and sum(found) / len(found) >= 0.9
    assert candidates < 0.2 * corpus.count(), candidates
    assert index.candidates(asked, None, candidates).count() == 40 * candidates
    assert index.buckets.agg(F.max("rows"), F.sum("rows")).first()[:] == (300, corpus.count())
    some = ann.recall(index.knn(asked, 10, index.n // 2, candidates), exact, 10).agg(F.avg("recall")).first()[0]
    assert some > 0.5  # half the buckets hold more than half of the neighbours


def test_lists_take_appends(spark, tmp_path):
    """Two appends give the recall of one build; crowded lists are split; an unfinished append changes nothing."""
    big = "/root/testdata/sf0.1"
    corpus, asked = base.corpus_vectors(spark, big).cache(), base.query_vectors(spark, big)
    exact = ranking.knn(corpus, asked, 10).select("query_id", "id", "distance").cache()
    whole = ann.Index.build(corpus, str(tmp_path / "whole"))
    index = ann.Index.build(corpus.where("label % 2 = 0 AND id % 2 = 0"), str(tmp_path / "parts"), whole.lists // 2)
    index = index.append(corpus.where("label % 2 = 0 AND id % 2 = 1"), overfull=1.5)
    ann.Index._store(corpus.limit(50).withColumn("list_id", F.lit(0)), index.path, index.last + 1)  # left by a failed append
    assert ann.Index(spark, index.path).vectors.count() == corpus.where("label % 2 = 0").count()
    index = ann.Index(spark, index.path).append(corpus.where("label % 2 <> 0"), overfull=1.5)
    assert index.lists > whole.lists // 2
    rows = index.vectors.groupBy("list_id").count()
    assert rows.agg(F.sum("count")).first()[0] == corpus.count() == index.vectors.select("id").distinct().count()
    mean = lambda i, n: ann.recall(i.knn(asked, 10, n), exact, 10).agg(F.avg("recall")).first()[0]
    half = mean(index, index.lists // 2)
    assert half >= mean(whole, whole.lists // 2) - 0.1 and mean(index, None) == 1.0
    small = index.compacted()
    assert [p.name for p in (tmp_path / "parts" / "vectors").iterdir() if p.name.startswith("gen=")] == [f"gen={small.last}"]
    assert mean(small, None) == 1.0 and mean(small, small.lists // 2) == half


def test_diverse_equals_a_plain_loop(spark):
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(12, 4))
    score = rnd.random(12)
    rows = [(q, i, float(score[i]), [float(v) for v in x[i]]) for q in range(2) for i in range(12)]
    got = ranking.diverse(spark.createDataFrame(rows, "query_id long, id long, score double, embedding array<double>"), 5, 0.6, block=spark.createDataFrame([(3,)], "id long"))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    taken, left = [], [i for i in range(12) if i != 3]
    while len(taken) < 5:
        best = max(left, key=lambda i: (round(0.6 * score[i] - 0.4 * max((unit[i] @ unit[j] for j in taken), default=0), 9), -i))
        taken.append(best)
        left.remove(best)
    for q in range(2):
        assert [r["id"] for r in got.where(f"query_id = {q}").orderBy("rank").collect()] == taken


def test_clusters_have_the_nearest_centre(spark, sf):
    rows = QUERIES["pl10_clusters"](spark, sf).collect()
    assert len({r["cluster"] for r in rows}) <= 16 and all(r["distance"] >= 0 for r in rows)
    again = {r["vec_id"]: (r["cluster"], r["distance"]) for r in QUERIES["pl10_clusters"](spark, sf).collect()}
    assert all(again[r["vec_id"]] == (r["cluster"], r["distance"]) for r in rows)


def test_undecodable_bytes_are_dropped(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "a.txt").write_bytes(b"good \xff\xfe bytes\nsecond line")
    (tmp_path / "b.md").write_text("other")
    assert [r["text"] for r in files.text_corpus(spark, str(tmp_path), "*.txt").collect()] == ["good  bytes\nsecond line"]
    store = str(tmp_path / "store")
    texts = spark.createDataFrame([("p", "one chunk"), ("q", "one chunk"), ("r", "x" * 2000)], "path string, text string")
    assert files.ingest(texts, store) == 3 and files.ingest(texts, store) == 0
    assert files.ingest(texts.union(spark.createDataFrame([("s", "new")], texts.schema)), store) == 1


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_nearest_equal_brute_force(spark, metric, monkeypatch):
    """Ties, repeated and odd vectors, many batches and blocks of queries."""
    rnd = np.random.default_rng(3)
    x = np.round(rnd.normal(size=(300, 4)), 1)
    rows = [(i, [float(v) for v in x[i % 250]], f"c{i}") for i in range(300)] + [(900, None, "none"), (901, [1.0], "short"), (902, [0.0] * 4, "zero")]
    corpus = spark.createDataFrame(rows, "id long, embedding array<double>, chunk string").repartition(6)
    queries = spark.createDataFrame([(q, [float(v) for v in x[q * 7]]) for q in range(20)], "query_id long, query_vector array<double>")
    monkeypatch.setattr(ranking, "QUERY_BLOCK", 7)
    got = sorted((r["query_id"], r["distance"], r["id"], r["chunk"]) for r in ranking.knn(corpus, queries, 5, metric).collect())
    want = []
    for q in range(20):
        y, found = x[q * 7], []
        for i, v, c in rows:
            if v is None or len(v) != 4 or metric == "cosine" and not any(v):
                continue
            d = np.linalg.norm(np.array(v) - y) if metric == "l2" else 1 - np.dot(v, y) / np.linalg.norm(v) / np.linalg.norm(y)
            found.append((q, round(float(d), 6) + 0.0, i, c))
        want += sorted(found)[:5]
    assert [(a, round(b, 6) + 0.0, i, c) for a, b, i, c in got] == want
    assert ranking.knn(corpus, queries.limit(0), 5, metric).count() == 0 and ranking.knn(corpus.limit(0), queries, 5, metric).count() == 0
