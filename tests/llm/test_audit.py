"""The filter audit against plain Python and DuckDB."""

import random
import re
from itertools import permutations

import duckdb
import numpy as np

from skein.llm import filter_audit, queries
from skein.llm.filter_audit import count_bytes


def plain(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    return [len(words), len(set(words)), len(re.findall("[A-Z]", t)), len(t), len(re.findall(r"[#$%&*|]", t))]


def counted(texts, step):
    raw = [t.encode() for t in texts]
    return count_bytes(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(r) for r in raw], dtype=np.int64), step).tolist()


def test_counts():
    rng = random.Random(5)
    pool = ["a", "b", "Word", "word", "é漢😀", "x" * 9, "x" * 8, "x" * 8 + "y", "z" * 70, "z" * 69 + "y", "#$", "A\x00B", "q" * 300, "abcdefgh12345678", "abcdefgh12345679"]
    texts = ["", " ", "one", "one", "\n\t x\x0b\x0c\r"]
    texts += ["".join(rng.choice(pool) + rng.choice([" ", "  ", "\n", "", "\t"]) for _ in range(rng.randrange(60))) for _ in range(300)]
    for step in (64, 1000, 1 << 20):
        assert counted(texts, step) == [plain(t) for t in texts]
    assert counted([], 64) == []
    long = " ".join(f"w{rng.randrange(40_000)}" for _ in range(400_000)) + " " + "y" * 3_000_000
    assert counted([long, "a a", long[:100]], 1 << 20) == [plain(t) for t in (long, "a a", long[:100])]


def test_no_collision_merges(monkeypatch):
    """With one hash for all words the table is slow and still right."""
    monkeypatch.setattr(filter_audit.WordTable, "_hashes", lambda self, doc, *_: np.zeros(len(doc), np.uint64))
    texts = ["a b c a longer-than-eight longer-than-eighty", "a b", "z" * 70 + " " + "z" * 71 + " " + "z" * 70]
    assert counted(texts, 1 << 20) == [plain(t) for t in texts]


def brute(rows, labels):
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, x in labels if x == 1}
    least, seen = {}, []
    for i, _, t in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    for i, part, t in rows:
        t = t or ""
        words, distinct, capitals, points, symbols = plain(t)
        fails = dict(A=words < 100, B=100 * distinct < 80 * words, C=100 * capitals > 10 * points, D=symbols > 0, E=i is not None and least[t] < i)
        seen.append((part or "", {f for f in fails if fails[f]}, i is not None and i in good, i is not None and i in toxic))
    out, shapley = {}, {}
    for part in {s[0] for s in seen}:
        for order in permutations("ABCDE"):
            for k, f in enumerate(order):
                mine, before = [s for s in seen if s[0] == part], set(order[:k])
                gone = [s for s in mine if f in s[1] and not s[1] & before]
                out[part, "".join(order), k + 1] = [sum(not s[1] & (before | {f}) for s in mine), len(gone), sum(f in s[1] and bool(s[1] & before) for s in mine), sum(s[1] == {f} for s in mine), sum(s[2] for s in gone), sum(s[3] for s in gone)]
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_with_odd_rows(spark, docs, empty):
    rows = [(r["doc_id"], r["lang"], r["text"]) for r in docs.select("doc_id", "lang", "text").collect()]
    odd = [(None, "en", "same text"), (None, None, "same text"), (5, "", "same text"), (7, "en", "same text"), (7, "en", "same text"), (7, "fr", "same text"), (5, "en", None), (4, "en", "")]
    marks = [(7, 1, 0), (7, 0, 1), (5, None, 1), (None, 1, 1), (900001, 1, 1), (1, 1, 0)]
    table = spark.createDataFrame(rows + odd, "doc_id long, lang string, text string").selectExpr("*", "1 AS part", "2 AS mask", "3 AS words", "4 AS n").repartition(5)
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int").selectExpr("*", "1 AS good")
    got = filter_audit.audit(filter_audit.masks(table, labels)).collect()
    want = brute(rows + odd, marks)
    assert len(got) == len(want) and {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in got} == want
    assert filter_audit.audit(filter_audit.masks(empty, labels)).count() == 0
    assert filter_audit.audit(filter_audit.masks(table, labels.limit(0))).agg({"good_lost": "sum", "toxic_lost": "sum"}).first()[:] == (0, 0)


def test_query(spark, sf):
    for t in ("documents", "labels"):
        duckdb.execute(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = duckdb.execute(queries.ORACLE_SQL["op12_filter_audit"])
    names = [d[0] for d in want.description]
    got = queries.QUERIES["op12_filter_audit"](spark, sf)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want.fetchall())
