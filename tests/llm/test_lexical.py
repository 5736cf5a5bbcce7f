"""Ranked lexical search against exhaustive scoring in plain Python."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import lexical_blocks as lex
from skein.llm import queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(t):
    return WORD.findall((t or "").translate(LOWER))


def brute(docs, items, k=10):
    tokens = [(i, words(t)) for i, t in docs]
    counts = [(i, len(w), {x: w.count(x) for x in set(w)} if len(w) < 500 else dict(zip(*np.unique(np.array(w, object), return_counts=True), strict=True))) for i, w in tokens]
    n, length, df = sum(bool(c) for _, c, _ in counts), sum(c for _, c, _ in counts), {}
    for _, _, c in counts:
        for t in c:
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        scores = []
        for i, size, c in counts:
            s = 0
            for t in set(words(text)):
                if t in c:
                    tf = int(c[t])
                    s += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * size * n) // length))))
            if s > 0:
                scores.append((-s, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return out


def same(df, want):
    assert sorted(map(repr, map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()))) == sorted(map(repr, want))


def test_terms():
    t = "It's ÉA_b-9 漢字x\x7f[Z]~0\tİ ſ"
    assert [x.decode() for x in lex.terms_of(t.encode())] == words(t)


def test_query(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    got = queries.QUERIES["op11_lexical_search"](spark, sf)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    same(got, brute(docs, items))


@pytest.mark.parametrize("small", [False, True])
def test_odd_rows(spark, docs, rows, empty, monkeypatch, small):
    segments = {}
    if small:  # many segments, blocks and passes
        segments = {"most": (13, 300), "block": 3}
        monkeypatch.setattr(lex, "PASS_TERMS", 60)
    plain = docs.select("doc_id", "text")
    odd = [(None, "word common"), (None, "word common"), (5, "word common"), (5, "word common"), (4, "word word word common")]
    table = plain.unionByName(spark.createDataFrame(odd, plain.schema)).selectExpr("*", "1 AS n", "2 AS terms", "3 AS rank", "4 AS q", "5 AS item_id").repartition(6)
    items = [(1, "word COMMON word"), (1, "word COMMON word"), (2, None), (3, ""), (None, "the of and"), (4, "nowhere-to-be-found"), (5, rows[3][1][:300]), (6, rows[40][1])]
    asked = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS doc_id")
    have = [tuple(r) for r in table.select("doc_id", "text").collect()]
    same(lex.ranked(table, asked, **segments), brute(have, items))
    if not small:
        assert lex.ranked(empty, asked).count() == 0 and lex.ranked(table, asked.limit(0)).count() == 0
        same(lex.ranked(table.where("doc_id = 5"), asked, k=3), brute([r for r in have if r[0] == 5], items, 3))


def test_bounds_hold_and_blocks_are_skipped():
    """Documents of topics: each document's score stays within the bounds of its blocks, and most blocks are skipped."""
    rng = random.Random(3)
    rows = []
    for _ in range(3_000):
        topic = rng.randrange(10)
        rows.append({**{topic * 20 + rng.randrange(20): rng.randrange(1, 10**9) for _ in range(12)}, **{600 + rng.randrange(5): rng.randrange(1, 10**7) for _ in range(2)}})
    indptr = np.cumsum([0, *map(len, rows)])
    terms, values = (np.array([x for r in rows for x in f(r)], t) for f, t in ((dict.keys, np.int32), (dict.values, np.int64)))
    made = lex.build_segment(indptr, terms, values, 60)
    segment = lex.Segment(made, list(range(len(rows))))
    dense = np.zeros((len(rows), 605), np.int64)
    for d, r in enumerate(rows):
        dense[d, list(r)] = list(r.values())
    full = np.flatnonzero(np.diff(made["blocks"]) > lex.BARE_DOCS)
    assert len(full) == len(made["summaries"]) > 100
    for row, b in enumerate(full):
        inside = made["members"][made["blocks"][b] : made["blocks"][b + 1]]
        assert (made["summaries"][row].astype(np.int64) * made["scale"] >= dense[inside][:, made["active"]].max(0)).all()
    assert sorted(map(tuple, zip(np.repeat(np.arange(len(made["active"])), np.diff(made["blocks"][made["lists"]])), made["members"], strict=True))) == sorted((int(np.searchsorted(made["active"], t)), d) for d, r in enumerate(rows) for t in r)
    for q in range(10):
        asked = np.array([*range(q * 20, q * 20 + 6), 600, 601], np.int32)
        best = lex.Best(1, 10, {})
        segment.search(0, asked, best)
        exact = sorted(((int(s), -i) for i, s in enumerate(dense[:, asked].sum(1)) if s > 0), reverse=True)[:10]
        assert best.found[0] == [(s, -i) for s, i in exact]
    assert segment.skipped > segment.opened and segment.scored < 0.15 * 10 * len(rows), (segment.opened, segment.skipped, segment.scored)


def test_a_common_word_is_spread(spark):
    """A word that every document holds lies in as many segments as there are tasks, none of them over its bound."""
    docs = spark.range(9_000).selectExpr("id AS doc_id", "concat('the w', id % 977) AS text").repartition(5)
    rows = lex.forward(docs, {b"the": 0, b"w3": 1})
    stored = lex.index(rows, lex.weights({0: 9_000, 1: 10}, 9_000, 2), 9_000, 18_000)
    sizes = [r[0] for r in stored.select(F.size("ids")).collect()]
    assert sum(sizes) == 9_000 and len(sizes) >= 5 and max(sizes) <= lex.SEGMENT_DOCS
