"""The pipeline against its decisions in plain Python, on the smallest tables with odd rows added."""

import collections
import hashlib
import re

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from skein.llm import pii_crf, toxicity_ws

pipeline = pytest.importorskip("corpus_pipeline")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text.translate({c: c + 32 for c in range(65, 91)}))


def fingerprint(text):
    w = words(text)
    if not w:
        return 0
    h = np.array([xxhash.xxh64_intdigest(" ".join(w[k : k + 4]), seed=42) for k in range(max(1, len(w) - 3))], np.uint64)
    return sum(1 << b for b in range(64) if 2 * int((h >> np.uint64(b) & np.uint64(1)).sum()) > len(h))


def text_hash(text):
    h = 42 if text is None else xxhash.xxh64_intdigest(text.encode(), seed=42)
    return h - (1 << 64) if h >> 63 else h


def one_of_each_group(rows):
    """Rows by all pairs of fingerprints: of each component the least by (id is null, id, hash of the text)."""
    fps = [fingerprint(t or "") for _, t in rows]
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = list(root)
    for k, x in enumerate(keys):
        for y in keys[k + 1 :]:
            if (x ^ y).bit_count() <= 4:
                root[find(y)] = find(x)
    groups = collections.defaultdict(list)
    for row, f in zip(rows, fps, strict=True):
        groups[find(f)].append(row)
    return [min(g, key=lambda r: (r[0] is None, r[0] or 0, text_hash(r[1]))) for g in groups.values()]


def tokens(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower())


def contains(doc, item):
    """Whether greedy tiles of five words, found by full search, cover half of the item."""
    doc, n_item, free, covered = list(doc), len(item), [True] * len(item), 0
    k = min(5, n_item)
    if not n_item or not any(doc[j : j + k] == item[i : i + k] for j in range(len(doc) - k + 1) for i in range(n_item - k + 1)):
        return False
    while True:
        best = (0, 0, 0)
        for i in range(n_item):
            for j in range(len(doc)):
                n = 0
                while i + n < n_item and j + n < len(doc) and free[i + n] and item[i + n] == doc[j + n]:
                    n += 1
                best = max(best, (n, -i, -j))
        n, i, j = best[0], -best[1], -best[2]
        if n < k:
            return covered >= 0.5 * n_item
        free[i : i + n], doc[j : j + n] = [False] * n, [None] * n
        covered += n


@pytest.fixture(scope="module")
def tables(spark, sf, tmp_path_factory):
    """The smallest tables, with odd rows and planted ones."""
    out = f"file://{tmp_path_factory.mktemp('tables')}"
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    item = max((r["text"] for r in bench.collect()), key=len).split()
    turned = " ".join([*item[len(item) // 2 :], "and", *item[: len(item) // 2]])
    texts = [None, "", "  \n", "word", "a lonely text that is about rivers and stones alone", "mail some.one.77@mail.example.com now, not some.one.77@intern. Call +1 (243) 555-5526 or 243-555-5526.", turned, "é漢😀 <|endoftext|> it's", "again again again again " * 3000]
    ids = [None, 900001, 900002, 900003, 900004, 900005, 900006, None, 900008]
    odd = [(i, t, "en", "odd", len(t or "")) for i, t in zip(ids, texts, strict=True)] + [(900003, "word", "en", "odd", 4), (900003, "another text under an id that is shared", "en", "odd", 40)]
    docs.unionByName(spark.createDataFrame(odd, docs.schema)).selectExpr("*", "1 AS found", "'x' AS fp", "2 AS score").repartition(3).write.parquet(f"{out}/documents.parquet")
    bench.write.parquet(f"{out}/benchmark.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{out}/labels.parquet")
    return out


def test_run_equals_plain_python(spark, tables):
    raw = spark.read.parquet(f"{tables}/documents.parquet")
    judged = toxicity_ws.scores(raw.withColumn("own", raw["text"]), spark.read.parquet(f"{tables}/labels.parquet"), row_col="own").collect()
    rows = [(r["doc_id"], r["own"]) for r in judged if not r["predicted"]]
    rows = one_of_each_group(rows)
    items = [tokens(r["text"]) for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    grams = [{tuple(x[k : k + 5]) for k in range(len(x) - 4)} for x in items]
    kept = []
    for i, t in rows:
        doc = tokens(t)
        mine = {tuple(doc[k : k + 5]) for k in range(len(doc) - 4)}
        near = [k for k, g in enumerate(grams) if len(g & mine) * 5 >= 0.5 * len(items[k])]
        if not any(contains([w if any(tuple(doc[max(0, j) : max(0, j) + 5]) in grams[k] for j in range(n - 4, n + 1)) else None for n, w in enumerate(doc)], items[k]) for k in near):
            kept.append((i, t))
    assert len(kept) < len(rows) < len([r for r in judged if not r["predicted"]])
    g = pii_crf.Graph()
    base = [pii_crf.base_spans(t or "") for _, t in kept]
    for k, ((_, t), b) in enumerate(zip(kept, base, strict=True)):
        g.add(k, t or "", b)
    counts = g.patterns()
    field = pii_crf.Field.learn(sorted(counts.items(), key=lambda x: repr(x[0])))
    extra = field.added([t or "" for _, t in kept], base, pii_crf.MIN_POSTERIOR)
    tokenizer, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), []
    for (i, t), b, e in zip(kept, base, extra, strict=True):
        clean = pii_crf.redacted_text(t or "", b + e)
        ids = tokenizer.encode(clean, add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest(), ids))
    got = [tuple(r[c] for c in ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids")) for r in pipeline.run(spark, tables).collect()]
    order = lambda x: (x[0] is None, x[0] or 0, x[2])
    assert sorted(got, key=order) == sorted(want, key=order)
    assert any(i is None for i, *_ in got)


def test_stages_keep_columns_and_stand_empty_tables(spark, tables):
    raw = spark.read.parquet(f"{tables}/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        assert stage(spark, raw, tables).columns == raw.columns
        assert stage(spark, raw.limit(0), tables).count() == 0
    assert pipeline.STAGES[-1][1](spark, raw.limit(0), tables).count() == 0
