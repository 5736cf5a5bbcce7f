"""Interval joins and traces on hand-made rows."""

import random

from pyspark.sql import functions as F

from skein.operators import graph, intervals
from skein.plans import governance


def test_overlaps_of_any_length(spark):
    rng = random.Random(8)
    pick = lambda: (a := rng.randrange(-200, 5000), a + int(2 ** rng.uniform(-1, 12)) - 1)
    left = [(rng.choice("ab"), i, *pick()) for i in range(150)] + [("a", 900, -5, 10**9), ("b", 901, 7, 7), ("a", 902, 9, 8), ("a", 903, None, 5), (None, 904, 1, 9)]
    right = [(rng.choice("ab"), i, *pick()) for i in range(150)] + [("a", 900, 0, 10**15), ("a", 901, 10**9, 10**9 + 1), ("a", 902, 5, None), ("b", 903, 8, 3), (None, 904, 1, 9)]
    dl, dr = spark.createDataFrame(left, "file string, c_id long, a long, b long"), spark.createDataFrame(right, "file string, s_id long, c long, d long")
    got = sorted((r["c_id"], r["s_id"]) for r in intervals.overlapping(dl, dr, ["file"], ("a", "b"), ("c", "d")).collect())
    ok = lambda a, b: a is not None and b is not None and a <= b
    assert got == sorted((i, j) for f, i, a, b in left for g, j, c, d in right if f and f == g and ok(a, b) and ok(c, d) and a <= d and c <= b)
    assert intervals._cut(dl.where("c_id = 900"), "a", "b", 60).count() <= 2 * 31
    assert intervals.overlapping(dl.limit(0), dr, ["file"], ("a", "b"), ("c", "d")).count() == 0


def test_traces_end_in_cycles(spark):
    pairs = [(1, 2), (2, 3), (3, 1), (3, 4), (5, 5), (6, 7), (6, 7)] + [(k, k + 1) for k in range(100, 170)]
    edges = spark.createDataFrame(pairs, "src long, dst long")
    out = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
    want = set()
    for a in out:
        seen, ahead = set(), [a]
        while ahead:
            ahead = [y for x in ahead for y in out.get(x, ()) if y not in seen and not seen.add(y)]
        want |= {(a, b) for b in seen}
    assert set(map(tuple, graph.closure(edges).collect())) == want
    found = graph.reached(edges, spark.createDataFrame([(1,), (1,), (5,), (9,)], "start long"))
    assert sorted(map(tuple, found.collect())) == [(1, 1, 0), (1, 2, 1), (1, 3, 2), (1, 4, 3), (5, 5, 0), (9, 9, 0)]
    assert graph.closure(edges.limit(0)).count() == 0 and found.agg(F.max("depth")).first()[0] == 3


def test_a_task_of_the_trace_holds_few_lines(spark, tmp_path, monkeypatch):
    """Lines meet orders in as many parts as their number asks for, and parts meet counts alone; odd keys as in SQL."""
    lines = [(k % 7, k % 40) for k in range(200)] * 2 + [(None, 1), (3, None), (99, 1), (5, 400)]
    for name, rows, schema in (("lineitem", lines, "l_partkey long, l_orderkey long"), ("orders", [(k,) for k in range(0, 60, 2)] + [(None,), (4,)], "o_orderkey long"), ("part", [(k,) for k in range(6)] + [(2,), (50,)], "p_partkey long")):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    monkeypatch.setattr(governance, "parts_of", lambda rows: -(-rows // 20))
    made = governance.jn7(spark, str(tmp_path))
    assert "REPARTITION_BY_NUM" in (plan := made._jdf.queryExecution().executedPlan().toString()) and "hashpartitioning(l_orderkey#" in plan and ", 21)" in plan
    want = {}
    for p, o in lines:
        if p is not None and p < 6 and o is not None and o < 60 and o % 2 == 0:
            want.setdefault(p, set()).add(o)
    assert {r["p_partkey"]: (r["decisions"], r["last_one"]) for r in made.collect()} == {p: (len(s), max(s)) for p, s in want.items()}
