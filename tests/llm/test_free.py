"""Decontamination, tokens and near-duplicates."""

import hashlib
import os
import random
import re
import subprocess
import sys
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from skein.llm import bpe_stream, common, decontam_gst, queries, simhash_grid, unigram_count

def test_tiles_catch_reordering(spark):
    item = " ".join(f"w{k}" for k in range(20))
    words = item.split()
    texts = [item, " ".join([*words[10:], "and", *words[:10]]), " ".join(words[:9]), "x " * 50, None, "", "W0, w1; " + " ".join(words[2:])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, None), (9, ""), (10, "zz yy")], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontam_gst.contaminated(docs, bench).collect()}
    assert set(got) == {0, 1, 6} and got[1]["reordered"] and got[1]["n_tiles"] == 2 and got[0]["coverage"] == 1.0
    blocks = decontam_gst.contaminated(docs, bench, block_chars=30)
    assert {r["doc_id"] for r in blocks.collect()} == {0, 1, 6}
    assert decontam_gst.contaminated(docs.limit(0), bench).count() == 0 and decontam_gst.contaminated(docs, bench.limit(0)).count() == 0
    for chars in (decontam_gst.BLOCK_CHARS, 30):
        assert sorted(r["doc_id"] for r in decontam_gst.clean(docs, bench, block_chars=chars).collect()) == [2, 3, 4, 5]
    odd = spark.createDataFrame([(None, item, 1), (None, "clean", 2), (3, item, 3), (3, "clean", 4), (3, "clean", 4)], "doc_id long, text string, item_id int")
    assert sorted(r["item_id"] for r in decontam_gst.clean(odd, bench).collect()) == [2, 4, 4]
    assert decontam_gst.clean(odd, bench).columns == odd.columns and decontam_gst.clean(odd.limit(0), bench).count() == 0


def brute_tiles(doc, item, k):
    """Greedy string tiling by full search."""
    a, b, found = [False] * len(doc), [False] * len(item), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and not a[j + n] and not b[i + n]:
                    n += 1
                best = max(best, (n, -i, -j))
        n, i, j = best[0], -best[1], -best[2]
        if n < k:
            return found
        for x in range(n):
            a[j + x] = b[i + x] = True
        found.append((i, j, n))


def test_tiles_equal_full_search():
    rnd = random.Random(5)
    for _ in range(300):
        letters = "abcdefg"[: rnd.randint(1, 7)]
        item = [rnd.choice(letters) for _ in range(rnd.randint(5, 25))]
        doc = sum((item[(s := rnd.randrange(len(item))) : s + rnd.randint(1, 9)] + [rnd.choice("abxyz")] for _ in range(6)), [])
        want = brute_tiles([object() if c in "xyz" else c for c in doc], item, 3)
        numbers = lambda x: np.array([-1 if c in "xyz" else ord(c) for c in x])
        assert decontam_gst.tiles(numbers(doc), numbers(item), 3) == want
        for share in (1e-9, 0.5, 1.0):
            got = decontam_gst.Items([(1, " ".join(item))], 3, share).matches(" ".join(doc))
            covered = sum(x[2] for x in want)
            assert (round(got[0][1] * len(item)) if got else 0) == (covered if covered and covered >= share * len(item) else 0)


def test_repetitive_texts_stay_small():
    """Seed pairs of these texts are about 150 million each; memory is linear in the texts."""
    rnd = random.Random(1)
    for word in (lambda k: "w", lambda k: f"w{k % 7}", lambda k: rnd.choice("ab")):
        doc, item = [word(k) for k in range(100_000)], [word(k) for k in range(1_500)]
        items = decontam_gst.Items([(1, " ".join(item))], 5, 0.5)
        tracemalloc.start()
        got = items.matches(" ".join(doc))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert got[0][1] > 0.9 and peak < 200e6


def test_decontamination_query(spark, sf):
    """The registered query equals a scan in plain Python: an item is contained if the greedy tiles of its words cover at least half of it."""
    words = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", t.lower())
    items = [(r["item_id"], words(r["text"])) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = set()
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        doc = words(r["text"])
        grams = {tuple(doc[k : k + 5]) for k in range(len(doc) - 4)}
        for i, item in items:
            hits = {x for k in range(len(item) - 4) if tuple(item[k : k + 5]) in grams for x in range(k, k + 5)}
            if len(hits) >= 0.5 * len(item):
                near = [w if any(tuple(doc[j : j + 5]) in grams and set(doc[j : j + 5]) <= set(item) for j in range(max(0, k - 4), k + 1)) else object() for k, w in enumerate(doc)]
                if sum(x[2] for x in brute_tiles(near, item, 5)) >= 0.5 * len(item):
                    want.add((r["doc_id"], i))
    got = queries.op3_decontamination(spark, sf).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want) > 0


@pytest.fixture(scope="module")
def vocab():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return bpe_stream.Vocabulary(f.read())


def test_bpe_query(docs, rows, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    want = []
    for i, t in rows:
        ids = tokenizer.encode(t, add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, bpe_stream.encode_documents(docs, path).collect())) == sorted(want)
    assert bpe_stream.encode_documents(empty, path).count() == 0


def test_bpe_streams_in_any_pieces(vocab):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encoder, decoder, rnd = bpe_stream.Encoder(vocab), bpe_stream.Decoder(vocab), random.Random(1)
    parts = ["a", "the", " ", "  ", "\n", "'s", "'ll", "'", "1", "é", "漢", "!", "<|endoftext|>", "<|endof", "\t", "ing", "\xa0"]
    for k in range(600):
        text = "".join(rnd.choices(parts, k=rnd.randint(0, 120))) if k % 3 else rnd.choice(" a!1\n") * rnd.randint(1, 3000) + "".join(rnd.choices("abcde tion", k=300))
        got, at = b"", 0
        while at < len(text):
            n = rnd.randint(1, 80)
            got += encoder.feed(text[at : at + n])
            at += n
        ids = np.frombuffer(got + encoder.finish(), "<u4").tolist()
        assert ids == tokenizer.encode(text, add_special_tokens=False).ids
        assert decoder.feed(ids) + decoder.finish() == tokenizer.decode(ids, skip_special_tokens=False)
    assert 0 < bpe_stream.sufficient_lookahead(vocab) < 5000
    words = ["".join(rnd.choices("abcdefgtion", k=rnd.randint(1, 30))).encode() for _ in range(300)]
    assert [np.frombuffer(x, "<u4").tolist() for x in bpe_stream.merge_many(words, vocab)] == [bpe_stream.merge(w, vocab) for w in words]


def test_counts_equal_a_unigram_tokenizer(docs, rows, empty):
    pieces = unigram_count.piece_scores(public_tokenizers.path("piece_bpe_32k.model"))
    tokenizer = Tokenizer(models.Unigram(pieces, 0, True))
    tokenizer.pre_tokenizer = pre_tokenizers.Metaspace()
    want = sorted((i, len(tokenizer.encode(t).ids)) for i, t in rows)
    assert sorted((r["doc_id"], r["n_tokens"]) for r in unigram_count.count_tokens(docs, pieces).collect()) == want
    assert unigram_count.count_tokens(empty, pieces).count() == 0
    small = [("<unk>", 0.0), ("▁", -1.0), ("a", -2.0), ("b", -2.0), ("ab", -4.0), ("aba", -6.0), ("▁a", -3.0)]
    t2, counter, rnd = Tokenizer(models.Unigram(small, 0, False)), unigram_count.Counter(small), random.Random(2)
    t2.pre_tokenizer = pre_tokenizers.Metaspace()
    for _ in range(500):
        text = "".join(rnd.choices("ab xé\n", k=rnd.randint(0, 12)))
        counter.learn([text])
        assert counter.count(text)[0] == len(t2.encode(text).ids), text


def test_simhash_equals_brute_force(docs, rows, empty):
    def fp(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text.translate({c: c + 32 for c in range(65, 91)}))
        if not words:
            return 0
        h = [xxhash.xxh64_intdigest(" ".join(words[k : k + 4]), seed=42) for k in range(max(1, len(words) - 3))]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = [(i, fp(t)) for i, t in rows if len(t) < 150_000] + [(i, simhash_grid.fingerprint(t)) for i, t in rows if len(t) >= 150_000]
    parent = {f: f for _, f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = list(parent)
    for k, x in enumerate(keys):
        for y in keys[k + 1 :]:
            if (x ^ y).bit_count() <= 4:
                parent[find(y)] = find(x)
    least = {}
    for i, f in fps:
        least[find(f)] = min(i, least.get(find(f), i))
    want = sorted((i, f"{f:016x}", least[find(f)]) for i, f in fps)
    assert sorted(map(tuple, simhash_grid.near_duplicates(docs).collect())) == want
    assert simhash_grid.near_duplicates(empty).count() == 0
    kept = simhash_grid.keep_one(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.select("doc_id").collect()} == set(least.values())


def test_one_row_of_each_component_stays(spark):
    alone = ["one lonely text about rivers and stones", "quite other words on music and late trains", "third of them speaks of bread or salt"]
    copied, shared = "copies of this line stand here more than once", "rows that share an id share this text too"
    rows = [(None, alone[0], "a"), (None, alone[1], "b"), (7, alone[2], "c"), (None, copied, "d"), (3, copied, "e"), (5, copied, "f"), (9, shared, "g"), (9, shared, "g"), (9, shared, "h"), (None, "null ids alone", "i"), (None, "null ids alone", "j")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    kept = simhash_grid.keep_one(docs)
    got = [tuple(r) for r in kept.collect()]
    assert kept.columns == docs.columns and set(got) <= set(rows)
    assert sorted(t for _, t, _ in got) == sorted([*alone, copied, shared, "null ids alone"])
    assert (3, copied, "e") in got
    # one id over two groups keeps a row of each, and no more
    twice = spark.createDataFrame([(1, alone[0]), (1, alone[1]), (1, alone[1])], "doc_id long, text string")
    assert sorted(r["text"] for r in simhash_grid.keep_one(twice).collect()) == sorted(alone[:2])


@pytest.mark.parametrize("block, hot", [(1_000, 10_000), (3, 2)])
def test_links_are_exact(spark, block, hot):
    """Classes equal those of all pairs; blocks of three fingerprints split every cell, and cells of over two are hot."""
    rnd = random.Random(4)
    fps = {0, 1 << 63, (1 << 64) - 1}
    for _ in range(60):
        centre = rnd.getrandbits(64)
        for _ in range(8):
            x = centre
            for b in rnd.sample(range(64), rnd.randint(0, 6)):
                x ^= 1 << b
            fps.add(x)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    table = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    want = {tuple(sorted((signed(x), signed(y)))) for x in fps for y in fps if x < y and (x ^ y).bit_count() <= 4}
    alone = simhash_grid.links(simhash_grid.cells(table, hot).withColumn("root", F.col("fp")), block).collect()
    assert {tuple(sorted(r)) for r in alone} == want and len(alone) == len(want)
    root = {x: x for p in want for x in p}
    for _ in root:
        for x, y in want:
            root[x] = root[y] = min(root[x], root[y])
    assert {tuple(r) for r in simhash_grid.linked(table, block, hot).collect()} == set(root.items())


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 20)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["root"] for r in simhash_grid.components(edges).collect()}
    assert all(got[k] == 1 for k in range(1, 21)) and got[101] == 100


def test_slices_are_bounded_by_bytes():
    texts = ["x" * 300_000] * 9 + [None, "", "y" * 3_000_000, "é" * 10] + ["z"] * 1_200
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"]).slice(1)
    parts = list(common.rows_of([batch], "doc_id", "text"))
    assert [i for ids, _ in parts for i in ids] == list(range(1, len(texts))) and [t for _, rows in parts for t in rows] == texts[1:]
    assert all(len(ids) <= common.STEP_ROWS and (len(ids) == 1 or sum(len((t or "").encode()) for t in rows) <= common.STEP_BYTES) for ids, rows in parts)
    assert list(common.rows_of([batch.slice(0, 0)], "doc_id", "text")) == []


def test_many_long_texts_in_little_memory():
    """512 texts of 30 KB full of numbers, tokens held as ids: the process stays under 600 MB."""
    code = """
import resource, random
import pyarrow as pa
from skein.llm import bpe_stream, common, pii_crf
from skein.llm.queries import tokenizer_path
rng = random.Random(1)
texts = [" ".join(f"call +{rng.randrange(10**9, 10**12)} or {rng.randrange(10**15, 10**16)}." for _ in range(800)) for _ in range(512)]
encoder, decoder = bpe_stream.transducers(open(tokenizer_path("byte_bpe_50k.json"), encoding="utf-8").read())
batch = pa.RecordBatch.from_arrays([pa.array(range(512)), pa.array(texts)], ["doc_id", "text"])
n = 0
for ids, rows in common.rows_of([batch], "doc_id", "text"):
    encoder.learn(rows)
    held = bytearray()
    for t in rows:
        for part in encoder.encode(t):
            held += part
            decoder.feed(__import__("numpy").frombuffer(part, "<u4"))
        decoder.finish()
    n += len(held) // 4
    for t in rows:
        pii_crf.base_spans(t)
print(n, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    got = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=os.path.dirname(os.path.dirname(os.path.dirname(__file__)))).stdout.split()
    assert int(got[0]) > 1_000_000 and int(got[1]) < 600, got
