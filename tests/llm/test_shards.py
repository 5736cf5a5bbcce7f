"""Hilbert shards: the curve's own laws, and the query against plain Python."""

import zlib
from itertools import product

import pytest
from pyspark.sql import functions as F

from skein.llm import hilbert_shards, queries


def walk(cells, bits):
    """The index by turning and mirroring coordinates level by level, without tables."""
    n, e, d, h = len(cells), 0, 0, 0
    for k in reversed(range(bits)):
        level = sum((c >> k & 1) << j for j, c in enumerate(cells)) ^ e
        r = (d + 1) % n
        t = (level >> r | level << (n - r)) & (1 << n) - 1
        w, x = 0, t
        while x:
            w ^= x
            x >>= 1
        g = 0 if w == 0 else (2 * ((w - 1) // 2)) ^ ((w - 1) // 2)
        e ^= (g << r | g >> (n - r)) & (1 << n) - 1
        tail = 0 if w == 0 else (w if w % 2 else w - 1)
        d = (d + (0 if w == 0 else len(bin(tail)) - len(bin(tail).rstrip("1"))) + 1) % n
        h = h << n | w
    return h


@pytest.mark.parametrize(("n", "bits"), [(2, 4), (3, 2), (4, 2)])
def test_neighbours_on_the_curve_are_neighbours_in_the_grid(spark, n, bits):
    points = list(product(range(1 << bits), repeat=n))
    df = spark.createDataFrame(points, ", ".join(f"c{k} int" for k in range(n)))
    got = {tuple(r)[:n]: r["h"] for r in df.withColumn("h", hilbert_shards.hilbert_index([F.col(f"c{k}") for k in range(n)], bits)).collect()}
    assert sorted(got.values()) == list(range(len(points)))
    path = sorted(got, key=got.get)
    assert all(sum(abs(x - y) for x, y in zip(a, b, strict=True)) == 1 for a, b in zip(path, path[1:], strict=False))
    assert all(got[p] == walk(p, bits) for p in points)


def code(value, same):
    return float(int.from_bytes(value.encode()[same : same + 6].ljust(6, b"\0"), "big"))


def brute(rows, shards=40, bits=4):
    """rows: (doc_id, text, lang, source)."""
    dims = []
    for i, t, lang, source in rows:
        dims.append([lang, source, len((t or "").encode()) + 16, i])
    numbers = []
    for k in range(4):
        column = [d[k] for d in dims]
        if k < 2:
            known = [v.encode() for v in column if v is not None]
            lo, hi = min(known), max(known)
            same = next((j for j, (a, b) in enumerate(zip(lo, hi, strict=False)) if a != b), min(len(lo), len(hi)))
            numbers.append([None if v is None else code(v, same) for v in column])
        else:
            numbers.append([None if v is None else float(v) for v in column])
    cells = []
    for column in numbers:
        x = sorted(v for v in column if v is not None)
        cuts = [x[int(k / (1 << bits) * (len(x) - 1))] for k in range(1, 1 << bits)]
        cells.append([0 if v is None else sum(c <= v for c in cuts) for v in column])
    low = lambda v: (v is not None, v)
    keyed = []
    for r, d, *c in zip(rows, dims, *cells, strict=True):
        crc = zlib.crc32((r[1] or "").encode())
        keyed.append((walk(c, bits), crc, low(d[3]), low(d[0]), low(d[1]), d[2]))
    keyed.sort()
    n, out, sizes = len(keyed), [], {}
    for rank, (h, crc, i, _, _, size) in enumerate(keyed):
        s = rank * shards // n
        out.append((i[1], size, crc, "rows", s, sizes.get(s, 0), None, h))
        sizes[s] = sizes.get(s, 0) + 1
    return out


def known(rows):
    return sorted(map(repr, map(tuple, rows)))


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    got = queries.QUERIES["op13_hilbert_shards"](spark, sf)
    assert got.dtypes[:7] == [("doc_id", "bigint"), ("size", "bigint"), ("text_crc32", "bigint"), ("law", "string"), ("shard", "int"), ("slot", "bigint"), ("grown_shard", "int")]
    assert known(got.collect()) == known(brute(rows))


def test_odd_rows(spark, docs, empty):
    odd = [(None, None, None, None), (None, "x", "en", None), (3, "same", "en", "s"), (3, "same", "en", "s"), (3, "same", "en", "s"), (3, "other", None, "s")]
    plain = docs.select("doc_id", "text", "lang", "source")
    table = plain.unionByName(spark.createDataFrame(odd, plain.schema)).repartition(5)
    rows = [tuple(r) for r in table.collect()]
    clashing = table.selectExpr("*", "1 AS size", "2 AS rank", "3 AS curve", "4 AS shard", "5 AS _part", "6 AS text_crc32")
    cols = ["doc_id", "size", "text_crc32", "shard", "slot", "curve"]
    want = known((r[0], r[1], r[2], r[4], r[5], r[7]) for r in brute(rows))
    assert known(hilbert_shards.shards(clashing).select(*cols).collect()) == want
    assert hilbert_shards.shards(empty).count() == 0
    few = hilbert_shards.shards(table.where("doc_id = 3 AND lang = 'en' AND source = 's'")).collect()
    assert len({r["shard"] for r in few}) == len(few) and {r["slot"] for r in few} == {0}


def test_files_and_pruning(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    path = str(tmp_path / "shards")
    hilbert_shards.write_shards(docs, path)
    stored = spark.read.parquet(path)
    assert known(stored.select(*docs.columns).collect()) == known(docs.collect())
    files = hilbert_shards.manifest(stored).cache()
    assert files.agg(F.sum("rows")).first()[0] == docs.count()
    opened = total = 0
    for ranges in ({"lang": ("de", "de")}, {"source": ("src3", "src3")}, {"size": (0, 600)}, {"doc_id": (100, 150), "lang": ("en", "en")}):
        keep = files.where(hilbert_shards.may_hold(ranges))
        cond = " AND ".join(f"{d} BETWEEN {a!r} AND {b!r}" for d, (a, b) in ranges.items())
        hits = stored.where(cond).select(F.col("_metadata.file_path").alias("file")).distinct()
        assert hits.join(keep, "file", "left_anti").count() == 0
        opened, total = opened + keep.count(), total + files.count()
    assert opened < 0.6 * total, (opened, total)
