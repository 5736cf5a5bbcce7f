"""Nearest neighbours in batches: exact, in lists and by codes, on tables of made vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.operators import ann, ranking, spread
from skein.sources import tables


def plan(df):
    return df._jdf.queryExecution().toString()


def vectors_of(spark, n, dim=8, seed=5):
    x = np.random.default_rng(seed).normal(size=(n, dim))
    corpus = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(n)], "id long, embedding array<float>").repartition(5)
    return corpus, corpus.where("id % 50 = 0").selectExpr("id AS query_id", "embedding AS query_vector")


def rows_of(df):
    return sorted((r["query_id"], r["id"], r["distance"]) for r in df.collect())


@pytest.mark.parametrize("block", [3, 2_000])
def test_codes_are_ranked_in_their_tasks(spark, monkeypatch, block):
    """No pair of a query and a code is joined or shuffled as such; with every code a candidate the ranking is exact, and candidates are those of the least differing bits."""
    monkeypatch.setattr(ranking, "QUERY_BLOCK", block)
    corpus, asked = vectors_of(spark, 600)
    exact, index = ranking.knn(corpus, asked, 10), ann.SignIndex.build(corpus, bucket_rows=90)
    found = index.knn(asked, 10, None, 600)
    assert "Join" not in plan(found) and rows_of(found) == rows_of(exact)
    every, some = rows_of(ranking.knn(corpus, asked, 600)), rows_of(index.knn(asked, 10, None, 37))
    codes = {r["id"]: [int(w) % 2**64 for w in r["code"]] for r in index.codes.collect()}
    got = {}
    for r in index.candidates(asked, None, 37).collect():
        got.setdefault(r["query_id"], set()).add(r["id"])
    for q in range(0, 600, 50):
        apart = sorted((sum((a ^ b).bit_count() for a, b in zip(codes[q], codes[i])), i) for i in codes)
        assert got[q] == {i for _, i in apart[:37]}
        like = {i for d, i in apart if d <= apart[36][0]}
        near = sorted((d, i) for p, i, d in every if p == q and i in like)[:10]
        assert sorted((d, i) for p, i, d in some if p == q) == near


def test_probes_and_candidates_are_set_without_searches(spark, tmp_path, monkeypatch):
    """The numbers that reach a recall are told by places, and are the least ones that do."""
    corpus, asked = vectors_of(spark, 600)
    exact = ranking.knn(corpus, asked, 10).select("query_id", "id").cache()
    for index in (ann.Index.build(corpus, str(tmp_path / "lists")), ann.SignIndex.build(corpus)):
        with monkeypatch.context() as m:
            m.setattr(type(index), "knn", None)
            n = index.calibrated(asked, exact)
        mean = lambda n: ann.recall(index.knn(asked, 10, n) if isinstance(index, ann.Index) else index.knn(asked, 10, None, n), exact, 10).agg(F.avg("recall")).first()[0]  # noqa: E731, B023
        less = n - 1 if isinstance(index, ann.Index) else n - 10
        assert mean(n) >= 0.9 and (isinstance(index, ann.SignIndex) or mean(less) < 0.9)
    assert ann._least_place(spark.createDataFrame([(1, 0.5), (3, 0.4), (7, 0.1)], "place long, weight double"), exact.where("query_id = 0"), 9, 0.9) == 3


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_lists_are_searched_in_batches(spark, tmp_path, monkeypatch, metric):
    """No pair of a query and a vector is joined; all lists probed are exact, some hold the rows of the nearest centres."""
    monkeypatch.setattr(ranking, "QUERY_BLOCK", 5)
    monkeypatch.setattr(ranking, "_CELLS", 40)
    corpus, asked = vectors_of(spark, 600)
    index = ann.Index.build(corpus, str(tmp_path / "lists"), metric=metric)
    found = index.knn(asked, 10)
    assert "query_vector" not in plan(found.select("query_id", "id", "distance")) and rows_of(found) == rows_of(ranking.knn(corpus, asked, 10, metric))
    ids, points = index._points()
    member = {r["id"]: r["list_id"] for r in index.vectors.collect()}
    q = {r["query_id"]: np.array(r["query_vector"], float) for r in asked.collect()}
    want = []
    for p, i, d in rows_of(ranking.knn(corpus, asked, 600, metric)):
        near = ann._distances(q[p][None], points, metric)[0]
        if member[i] in ids[np.argsort(near, kind="stable")[:4]]:
            want.append((p, d, i))
    want = sorted((p, i, d) for at in q for _, d, i in sorted(w for w in want if w[0] == at)[:10] for p in [at])
    assert rows_of(index.knn(asked, 10, 4)) == want


def test_stored_lists_are_few_files(spark, tmp_path):
    """One file a list, and one list for each root of the rows, copies or none; the driver gets centres alone."""
    corpus, _ = vectors_of(spark, 400)
    corpus = corpus.unionByName(corpus.where("id < 20").selectExpr("id + 1000 AS id", "array(1f, 0f, 0f, 0f, 0f, 0f, 0f, 0f) AS embedding"))
    index = ann.Index.build(corpus, str(tmp_path))
    assert index.lists == 20 and index.vectors.count() == 420 == index.vectors.select("id").distinct().count()
    assert len(list((tmp_path / "vectors").rglob("*.parquet"))) <= 20


def test_distances_are_summed_in_their_tasks(spark, monkeypatch):
    monkeypatch.setattr(ranking, "QUERY_BLOCK", 2)
    x = np.random.default_rng(2).normal(size=(40, 4))
    rows = [(i, [float(v) for v in x[i]]) for i in range(40)] + [(100, None), (101, [1.0])]
    corpus = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(3)
    asked = spark.createDataFrame([(q, [float(v) for v in x[q]]) for q in range(5)] + [(9, None)], "query_id long, query_vector array<double>")
    got = {r["query_id"]: (r["n"], r["total"]) for r in ranking.distance_sums(corpus, asked).collect()}
    for q in range(5):
        assert got[q][0] == 42 and abs(got[q][1] - sum(round(float(np.linalg.norm(x[i] - x[q])), 6) for i in range(40))) < 1e-5
    assert got[9] == (42, None)


def test_a_task_holds_few_distances(spark):
    """What a task has at a time doesn't grow with the queries of a block."""
    import tracemalloc

    most = []
    for n in (200, 2_000):
        rnd = np.random.default_rng(n)
        near, x = ranking.Nearest(rnd.normal(size=(n, 64)), 10, "l2", 6), rnd.normal(size=(10_000, 64))
        tracemalloc.start()
        for at in range(0, len(x), step := ranking._CELLS // n):
            near.sift(x[at : at + step])
        most.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert max(most) < 60 << 20, most


def test_blocks_of_queries_share_a_shuffle(spark, tmp_path, monkeypatch):
    """Blocks of queries are put together before ranks are cut and sums are made: shuffled one by one they all ended up in a single task."""
    corpus, asked = vectors_of(spark, 600)
    index = ann.Index.build(corpus, str(tmp_path / "lists"))
    makes = [lambda: ranking.knn(corpus, asked, 10), lambda: index.knn(asked, 10, 4), lambda: ann.SignIndex.build(corpus).knn(asked, 10, None, 37), lambda: ranking.distance_sums(corpus, asked)]
    whole = [sorted(map(tuple, make().collect())) for make in makes]
    monkeypatch.setattr(ranking, "QUERY_BLOCK", 3)
    for make, want in zip(makes, whole):
        found = make()
        physical = found._jdf.queryExecution().sparkPlan().toString()
        assert physical.count("Window [") + physical.count("HashAggregate") <= 2 and physical.count("MapInArrow") >= 2, physical
        assert sorted(map(tuple, found.collect())) == want


def test_codes_keep_one_copy_of_the_vectors(spark, monkeypatch):
    """Codes are shuffled and written once with their vectors, not three times; a query's other tables hold none."""
    kept, write = [], tables.written

    def spy(df, name):
        kept.append((name, set(df.columns)))
        return write(df, name)

    for module in (ann, spread):
        monkeypatch.setattr(module, "written", spy)
    corpus, asked = vectors_of(spark, 600)
    index = ann.SignIndex.build(corpus, bucket_rows=90)
    assert [n for n, c in kept if "embedding" in c] == ["ranged"]
    assert index.buckets.agg(F.max("rows"), F.sum("rows"), F.count("*")).first()[:] == (90, 600, 7)
    exact = index.exact(asked, 10)
    assert rows_of(exact) == rows_of(ranking.knn(corpus, asked, 10))
    index.calibrated(asked, exact)
    index.knn(asked, 10, 3, 40).collect()
    assert [n for n, c in kept if "embedding" in c] == ["ranged"]


@pytest.mark.parametrize("nprobe", [None, 3])
def test_more_splits_send_no_more_rows(spark, monkeypatch, nprobe):
    """What tasks send of a query grows with their number, so blocks of queries share the tasks a core; counts stop at the farthest neighbour."""
    corpus, asked = vectors_of(spark, 600)
    index = ann.SignIndex.build(corpus, bucket_rows=20)
    whole = rows_of(index.knn(asked, 10, nprobe, 37))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        assert index.codes.rdd.getNumPartitions() >= 30
        monkeypatch.setattr(ann.SignIndex, "TASKS", 1)
        cores = spark.sparkContext.defaultParallelism
        assert [index.gathered(n).rdd.getNumPartitions() for n in (1, 2, 100)] == [cores, -(-cores // 2), 1]
        monkeypatch.setattr(ranking, "QUERY_BLOCK", 3)
        assert rows_of(index.knn(asked, 10, nprobe, 37)) == whole
        all_bits, few = (index._counted(asked.withColumn("cut", F.lit(c)), nprobe).collect() for c in (255, 110))
        assert sorted(map(tuple, few)) == sorted(tuple(r) for r in all_bits if r["apart"] <= 110) and len(few) < len(all_bits)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_ids_without_a_document_are_left_out_where_they_lie(spark, monkeypatch):
    """Few unknown ids are broadcast, so vectors aren't shuffled; many are joined by sorting, with the same rows."""
    rows = spark.createDataFrame([(1, [1.0]), (2, [2.0]), (2, [3.0]), (3, [4.0]), (None, [5.0])], "id long, embedding array<float>")
    docs = spark.createDataFrame([(2,), (2,), (3,), (None,), (7,)], "id long")
    want = [(2, [2.0]), (2, [3.0]), (3, [4.0])]
    few = tables.known(rows, docs, "id")
    assert "BroadcastHashJoin" in (p := few._jdf.queryExecution().executedPlan().toString()) and "SortMergeJoin" not in p
    assert sorted(map(tuple, few.collect())) == want
    monkeypatch.setattr(tables, "BROADCAST_ROWS", 0)
    many = tables.known(rows, docs, "id")
    assert "BroadcastHashJoin" not in many._jdf.queryExecution().executedPlan().toString() and sorted(map(tuple, many.collect())) == want
