"""Toxicity: the label model on votes of known rates, held-out rows, and odd rows."""

import zlib

import numpy as np
import pytest

from skein.llm import queries, toxicity_ws


def simulated(n=20_000, seed=1):
    """(codes, classes) of six voters: five of known rates, the last a copy of the one before it."""
    rnd = np.random.default_rng(seed)
    y = (rnd.random(n) < 0.15).astype(int)
    toxic = np.array([[0.02, 0.8], [0.05, 0.6], [0.01, 0.3], [0.1, 0.5], [0.05, 0.7]])
    votes = np.stack([2 * (rnd.random(n) < toxic[k, y]) for k in range(5)], 1).astype(int)
    votes = np.concatenate((votes, votes[:, 4:]), 1)
    return (votes * 3 ** np.arange(6)).sum(1), y, toxic


def test_label_model_finds_rates_and_correlations():
    codes, y, toxic = simulated()
    every, counts = np.unique(codes, return_counts=True)
    seen = np.arange(len(y)) % 40 == 0  # one row in forty is labelled
    gold = {}
    for c, k in zip(codes[seen], y[seen], strict=True):
        gold[c, k] = gold.get((c, k), 0) + 1
    model = toxicity_ws.LabelModel(np.array([[c, k, n] for (c, k), n in gold.items()]), 6).fit(lambda m: m.sums(every, counts))
    assert np.abs(model.rates[:5, 1, 2] - toxic[:, 1]).max() < 0.08 and np.abs(model.rates[:5, 0, 2] - toxic[:, 0]).max() < 0.03
    assert model.correlation[4, 5] > 0.9 and (model.correlation[:4, :4] - np.eye(4)).max() < 0.2
    assert np.allclose(model.weight[4:], 0.5, atol=0.06) and (model.weight[:4] > 0.9).all()
    # two that say the same count as one: the posterior is that of the model without the copy
    alone = toxicity_ws.LabelModel(np.array([[c % 3**5, k, n] for (c, k), n in gold.items()]), 5).fit(lambda m: m.sums(codes % 3**5, np.ones(len(codes))))
    p, q = model.posterior(toxicity_ws._unpack(codes, 6)), alone.posterior(toxicity_ws._unpack(codes % 3**5, 5))
    assert np.abs(p - q).mean() < 0.02 and ((p > 0.5) == y).mean() > 0.95


def test_posterior_column_equals_the_model(spark):
    codes, y, _ = simulated(500)
    gold = {(c, k): 1 for c, k in zip(codes.tolist(), y.tolist(), strict=True)}
    model = toxicity_ws.LabelModel(np.array([[c, k, n] for (c, k), n in gold.items()]), 6)
    model.weight = np.linspace(0.3, 1, 6)
    rows = spark.createDataFrame([(int(c),) for c in set(codes.tolist())], "code long")
    got = {r["code"]: r["p"] for r in rows.select("code", model.column(rows.code).alias("p")).collect()}
    want = model.posterior(toxicity_ws._unpack(np.array(list(got)), 6))
    assert np.abs(np.array(list(got.values())) - want).max() < 1e-9
    table = rows.selectExpr("code", "2L AS n").repartition(3)
    soft, products = toxicity_ws._gather(table)(model)
    a, b = model.sums(np.array(list(got)), np.full(len(got), 2))
    assert np.allclose(soft, a) and np.allclose(products, b)


def test_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    out = queries.op2_toxicity(spark, sf)
    assert out.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    rows = {r["doc_id"]: r for r in out.collect()}
    ids = [r["doc_id"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()]
    assert sorted(rows) == sorted(ids)
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for i, r in rows.items())
    labels = [(r["doc_id"], r["toxic"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    held = [(rows[i]["predicted"], y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    caught, wrong = [p for p, y in held if y], [p for p, y in held if not y]
    assert sum(p == y for p, y in held) / len(held) > 0.97 and sum(caught) / len(caught) > 0.8 and sum(wrong) / len(wrong) < 0.01


def test_odd_rows(spark, sf, docs, empty):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    odd = docs.unionByName(docs.where("doc_id = 900003").selectExpr("CAST(null AS long) AS doc_id", *docs.columns[1:])).cache()
    kept = toxicity_ws.keep_clean(odd, labels)
    assert kept.columns == odd.columns
    scores = toxicity_ws.scores(odd, labels).collect()
    assert len(scores) == odd.count() and kept.count() == sum(not r["predicted"] for r in scores)
    of = {}
    for r in scores:
        if r["doc_id"] in (900003, 900004, 900005):
            of.setdefault(r["doc_id"], set()).add(r["score"])
    assert all(len(x) == 1 for x in of.values()) and of[900004] == of[900005]
    assert toxicity_ws.scores(empty, labels).count() == 0 and toxicity_ws.keep_clean(empty, labels).count() == 0
    none = toxicity_ws.scores(docs.limit(5), labels.limit(0)).collect()
    assert len(none) == 5 and all(r["score"] == 0 for r in none)
    unsure = spark.createDataFrame([(1, 0), (1, 1), (2, None)], "doc_id long, toxic int")
    assert all(r["score"] == 0 for r in toxicity_ws.scores(docs.limit(3), unsure).collect())
    with pytest.raises(ValueError):
        toxicity_ws.LabelModel(np.array([[0, 1]]), 2)
