"""The blob ledger against plain Python."""

import hashlib
import re
import time

import pytest

from skein.llm import queries, secret_ledger

BASE_ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def base_secrets(text):
    out = []
    for m in re.finditer(BASE_ASSIGN, text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, "assign", m.end()))
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def every_secret(text):
    """All kinds by one scan a rule in Python, whose patterns know possessive repeats too."""
    out = base_secrets(text)
    for k, r in enumerate(secret_ledger.RULES[secret_ledger.BASE :], secret_ledger.BASE):
        out += [(m.start(), k, r.kind, m.end()) for m in re.finditer(r.pattern, text, re.ASCII)]
    return sorted(out)


def told(found):
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in found)


def expected(i, t):
    base, n = base_secrets(t), []
    for k in range(3):
        n.append(sum(x[1] == k for x in base))
    return (i, *n, sha(told(base)), told(every_secret(t)))


SECRETS = [
    "x -----BEGIN RSA PRIVATE KEY----- y ghp_" + "aZ" * 18, "xoxb-" + "1a-" * 9 + " notxoxb-" + "b" * 20, "eyJ" + "a" * 9 + ".eyJ" + "b" * 9 + "." + "c" * 9 + " eyJ.eyJ.x", "AIza" + "Q" * 40,
    "sk_live_" + "9" * 20 + " PASSWORD: 'a=b=c/d'", "see https://me:secret99@host.org/x and zhttps://no", "é漢😀 token=abcdef0123 😀 api_key = \"zzzzzz\"",
]


def test_query_equals_brute_force(spark, sf, docs, rows, tmp_path):
    """The registered query on the given table, then its steps on odd rows too."""
    plain = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    out = queries.op4_secrets(spark, sf)
    assert out.columns == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    assert sorted(map(tuple, out.collect())) == sorted(expected(i, t) for i, t in plain)
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(950000 + k, t) for k, t in enumerate(SECRETS)], "doc_id long, text string"))
    secret_ledger.update(both, f"file://{tmp_path}")
    got = secret_ledger.digest(secret_ledger.by_path(both, f"file://{tmp_path}"))
    want = [expected(i, t) for i, t in [*rows, *((950000 + k, t) for k, t in enumerate(SECRETS))]]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert {x.split(":")[0] for w in want for x in w[-1].split(",")} >= {r.kind for r in secret_ledger.RULES}


def test_later_runs_keep_earlier_findings_and_scan_only_new_blobs(spark, docs, tmp_path):
    store, old = f"file://{tmp_path}", docs.select("doc_id", "text").where("doc_id % 3 > 0 OR doc_id >= 900000")
    version = secret_ledger.rule_version()
    secret_ledger.update(old, store)
    first = sorted(map(tuple, secret_ledger.digest(secret_ledger.by_path(old, store)).collect()))
    ledger = secret_ledger.read_ledger(spark, store)
    size = ledger.count()
    assert size == ledger.select("blob").distinct().count() == old.selectExpr("coalesce(text, '')").distinct().count()
    assert secret_ledger.unseen(old.selectExpr("doc_id", "coalesce(text, '') AS text"), ledger, version).count() == 0
    secret_ledger.update(old, store)
    assert secret_ledger.read_ledger(spark, store).count() == size
    assert sorted(map(tuple, secret_ledger.digest(secret_ledger.by_path(old, store)).collect())) == first
    # a path's next version: old and new versions both keep their findings
    versions = old.unionByName(old.selectExpr("doc_id", "concat(text, ' token=changed', doc_id) AS text"))
    secret_ledger.update(versions, store)
    assert set(first) <= set(map(tuple, secret_ledger.digest(secret_ledger.by_path(versions, store)).collect()))
    rules = (*secret_ledger.RULES, secret_ledger.Rule("word", "hexahedron", "hexa"))
    assert secret_ledger.unseen(old.selectExpr("doc_id", "coalesce(text, '') AS text"), ledger, secret_ledger.rule_version(rules)).count() == size


@pytest.mark.parametrize("rule", secret_ledger.RULES, ids=lambda r: r.kind)
def test_rules_are_linear(spark, rule, tmp_path):
    """A million characters of what a rule nearly matches end in seconds; a quadratic pattern would take hours."""
    starts = {"assign": "password ", "access": "AKIA", "hex": "0123456789abcdef" + "x", "private_key": "-----BEGIN AB ", "host_token": "ghp_", "chat_token": "xoxb-", "web_token": "eyJ", "cloud_key": "AIza", "payment_key": "sk_live_", "url_password": "a://b"}
    start = starts[rule.kind]
    texts = [start * (1_000_000 // len(start)), start + " " * 1_000_000, start + "a" * 1_000_000, "a" * 1_000_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    began = time.time()
    secret_ledger.update(df, f"file://{tmp_path}/{rule.kind}", rules=(rule,))
    assert time.time() - began < 20


def test_hot_blob_and_empty_table(spark, empty, tmp_path):
    store = f"file://{tmp_path}"
    many = spark.range(3000).selectExpr("id AS doc_id", "if(id % 3 = 0, concat('x', id), 'secret: abcdefgh') AS text")
    secret_ledger.update(many, store)
    assert secret_ledger.digest(secret_ledger.by_path(many, store)).where("n_assign = 1 AND spans = 'assign:0:16'").count() == 2000
    secret_ledger.update(empty, f"{store}/none")
    assert secret_ledger.by_path(empty, f"{store}/none").count() == 0
