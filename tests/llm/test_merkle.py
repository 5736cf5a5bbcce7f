"""Merkle fingerprints against plain Python."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from skein.llm import merkle, queries


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def plain_tree(text):
    """(root, sections, paragraphs, leaves) by splitting at blank lines, lines and sentence ends."""
    sections, paragraphs, leaves = [], [], []
    for s in re.findall(r"\n\n+|.+?(?:\n\n+|\Z)", text, re.DOTALL):
        of_section = []
        for p in re.findall(r"[^\n]*\n+|[^\n]+", s):
            own = [sha("leaf:" + x) for x in re.findall(r"[^.!?\n]*[.!?\n]+|[^.!?\n]+", p)]
            of_section.append(sha("paragraph:" + "".join(own)))
            leaves += own
        sections.append(sha("section:" + "".join(of_section)))
        paragraphs += of_section
    short = lambda x: [y[:16] for y in x]
    return sha("root:" + "".join(sections)), short(sections), short(paragraphs), short(leaves)


def plain_likeness(a, b):
    if a[0] == b[0]:
        return 1.0
    x, y = set(a[3]), set(b[3])
    return 2 * len(x & y) / (len(x) + len(y)) if x or y else 0.0


def plain_edit(a, b, level):
    if a[0] == b[0]:
        return None
    x, y, first, behind = a[level], b[level], 0, 0
    while first < min(len(x), len(y)) and x[first] == y[first]:
        first += 1
    while behind < min(len(x), len(y)) - first and x[-1 - behind] == y[-1 - behind]:
        behind += 1
    return first, len(y) - behind - 1


def check(got, rows):
    """Every column of every row, by a full sort in Python; rows that share an id may stand in any order among themselves."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0]))
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, by_id.values())) == len(rows)
    ids = [i for i, _ in order]
    for k, (i, t) in enumerate(order):
        followers = [order[(k + 1) % len(order)][1]] if ids.count(i) == 1 and ids.count(ids[(k + 1) % len(ids)]) == 1 else [x for j, x in order if j == i or j == ids[(max(n for n, y in enumerate(ids) if y == i) + 1) % len(ids)]]
        half, a, fits = len(t) // 2, plain_tree(t), []
        for nxt in followers:
            edited = t[: len(t) - half] + nxt[:half]
            b, c = plain_tree(edited), plain_tree(nxt)
            fits.append((len(t), sha(edited), a[0], b[0], round(plain_likeness(a, b), 9), round(plain_likeness(a, c), 9), plain_edit(a, b, 1), plain_edit(a, b, 2)))
        mine = [(r["n_chars"], r["edited_sha256"], r["fingerprint"].split("/")[0], r["edited_fingerprint"].split("/")[0], round(r["near_edited"], 9), round(r["near_next"], 9), r["edited_sections"], r["edited_paragraphs"]) for r in by_id[i]]
        mine = [x[:6] + tuple(y and tuple(y) for y in x[6:]) for x in mine]
        assert any(x in fits for x in mine), (i, mine, fits)
    fps = {}
    for r in got:
        fps.setdefault(r["fingerprint"], set()).add((r["n_chars"], r["fingerprint"].split("/")[0]))
    assert all(len(x) == 1 for x in fps.values()) and len(fps) == len({t for _, t in rows})


@pytest.mark.parametrize("chars", [merkle.RANGE_CHARS, 50_000])
def test_edits_equal_plain_python(docs, rows, chars):
    check(merkle.edits(docs, range_chars=chars).collect(), rows)


def test_query(spark, sf):
    got = queries.op6_merkle(spark, sf)
    assert got.columns[:7] == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    check(got.collect(), [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()])


def test_ids_of_other_types_and_few_rows(spark, empty):
    assert merkle.edits(empty).count() == 0
    one = spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")
    assert merkle.edits(one).first()["edited_sha256"] == sha("abcabc")
    rows = [(f"id-{k:03}", f"Text {k}. More\n\nand {k % 7} more! " * (k % 5)) for k in range(60)] + [(None, "without id"), (None, "nor this")]
    check(merkle.edits(spark.createDataFrame(rows, "doc_id string, text string"), range_chars=200).collect(), rows)
    same = spark.createDataFrame([(1, f"row {k}") for k in range(200)], "doc_id long, text string")
    ranges = merkle.with_next(same, 300)
    assert ranges.count() == 200 and {r["next_text"] for r in ranges.collect()} == {f"row {k}" for k in range(200)}


def test_insertions_are_located(spark):
    old = "one. two.\nthree.\n\nfour.\n\nfive. six."
    new = "brand new.\n\none. two.\nthree.\n\nfour!\n\nfive. six."
    df = spark.createDataFrame([(old, new), (old, old), (new, old)], "a string, b string").select(merkle.fingerprint(F.col("a")).alias("a"), merkle.fingerprint(F.col("b")).alias("b"))
    got = df.select(merkle.edited(F.col("a"), F.col("b")).alias("s"), merkle.edited(F.col("a"), F.col("b"), merkle.paragraphs).alias("p")).collect()
    assert tuple(got[0]["s"]) == (0, 2) and tuple(got[0]["p"]) == (0, 3) and got[1]["s"] is None and tuple(got[2]["s"]) == (0, 1)
    dropped = spark.createDataFrame([("a.\n\nb.\n\nc.", "a.\n\nc.")], "a string, b string").select(merkle.edited(merkle.fingerprint(F.col("a")), merkle.fingerprint(F.col("b"))).alias("s"))
    assert tuple(dropped.first()["s"]) == (1, 0)


def test_many_ranges_stay_out_of_the_plan(spark):
    """Each key finds its range among 50,000, and the plan holds about the square root of their cuts."""
    cuts = [(None, 5), *((10 * k, 0) for k in range(50_000))]
    keys = [(None, 5), (None, 9), (0, 0), (0, 3), (9, -1), (4_321, 7), (250_000, 0), (499_990, 0), (10**9, 1)]
    rows = spark.createDataFrame([(k,) for k in keys], "key struct<id: bigint, h: bigint>")
    got = {tuple(r["key"]): (r["at"], r["is_least"]) for r in merkle._placed(rows, cuts).collect()}
    assert got == {k: (0 if k[0] is None else 1 + min(49_999, (k[0] if k[0] % 10 or k[1] >= 0 else k[0] - 1) // 10), k in cuts) for k in keys}
