"""Secret scans with an incremental blob ledger.

Each version of a document is a blob, named by the SHA-256 of its text. The ledger is a table in a folder that
outlives a run: one row for each (blob, rule version) that was scanned, with its findings, so a row is either there whole or not at all. A run
reads the texts of its documents, drops copies, leaves out the blobs that the ledger has under the present rules, scans the rest and appends them. Findings
of this and of all earlier runs join back to every path that holds the blob. Only built-in functions run on the rows.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm.common import join_split, texts
from skein.llm.matches import pieces


class Rule(NamedTuple):
    kind: str
    pattern: str
    prefilter: str  # a cheaper pattern that every match contains
    keep: str = ""  # what a match must hold besides


_ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""

#: Base kinds, in the order in which places are told, then what the method adds. The minimum lengths of access and hex are part of
#: their patterns: a shorter run could hold no match within it. Every pattern is linear in the text: what repeats without a bound either starts at the
#: edge of its run and gives nothing back, or can't start again within it.
RULES = (
    Rule("assign", _ASSIGN, r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", _ASSIGN.removesuffix("+)") + "{6,})"),
    Rule("access", r"AKIA[A-Z0-9]{16,}", "AKIA"),
    Rule("hex", r"[0-9a-f]{24,}", r"[0-9a-f]{24}"),
    Rule("private_key", r"-----BEGIN (?:[A-Z0-9]{1,20} ){0,3}PRIVATE KEY-----", "PRIVATE KEY-----"),
    Rule("host_token", r"gh[pousr]_[A-Za-z0-9]{36,}+", "gh[pousr]_"),
    Rule("chat_token", r"(?<![A-Za-z0-9-])xox[abprs]-[A-Za-z0-9-]{10,}+", "xox[abprs]-"),
    Rule("web_token", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", r"eyJ[A-Za-z0-9_-]{8}"),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]{35}", "AIza"),
    Rule("payment_key", r"[sr]k_live_[A-Za-z0-9]{16,}+", "k_live_"),
    Rule("url_password", r"(?<![a-z0-9+.-])[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,64}:[^\s/@]{3,64}@", "://[^\\s/:@]{1,64}:"),
)
BASE = 3
FOUND = "array<struct<start:long,kind_no:int,kind:string,stop:long>>"


def rule_version(rules: tuple[Rule, ...] = RULES) -> str:
    return hashlib.sha256("\0".join("\1".join(r) for r in rules).encode()).hexdigest()[:16]


def blob(text: Column) -> Column:
    return F.sha2(text, 256)


def read_ledger(spark: SparkSession, store: str) -> DataFrame:
    """(blob, found, version) of all runs so far; none where there is no ledger yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/ledger")
    schema = f"blob string, found {FOUND}, version string"
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.read.schema(schema).parquet(f"{store}/ledger")
    return spark.range(0).selectExpr("CAST(null AS string) AS blob", f"CAST(null AS {FOUND}) AS found", "CAST(null AS string) AS version")


def _numbered(k: int, rule: Rule):
    def struct(m, i):
        ok = m.match.rlike(rule.keep) if rule.keep else F.lit(True)
        return F.struct(F.lit(k).alias("rule"), i.alias("ord"), m.gap.alias("gap"), m["size"].alias("size"), ok.alias("ok"))

    return struct


def findings(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, found) for every row of blobs (blob, text), one row a blob: its findings by start, then kind as in rules; places in code points."""
    found = []
    for k, r in enumerate(rules):
        every = F.transform(pieces(F.col("text"), F.lit(r.pattern), F.length), _numbered(k, r))
        found.append(F.when(F.col("text").rlike(r.prefilter), every))
    none = F.expr("CAST(array() AS array<struct<rule:int,ord:int,gap:int,size:int,ok:boolean>>)")
    rows = blobs.select("blob", F.inline_outer(F.flatten(F.array(*(F.coalesce(x, none) for x in found)))))
    w = Window.partitionBy("blob", "rule").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stop = F.sum(F.col("gap") + F.col("size")).over(w).cast("long")
    kind = F.element_at(F.array(*(F.lit(r.kind) for r in rules)), F.col("rule") + 1)
    place = F.struct((F.col("stop") - F.col("size")).alias("start"), F.col("rule").alias("kind_no"), kind.alias("kind"), "stop")
    return rows.withColumn("stop", stop).groupBy("blob").agg(F.array_sort(F.collect_list(F.when(F.col("ok"), place))).cast(FOUND).alias("found"))


def unseen(docs: DataFrame, ledger: DataFrame, version: str) -> DataFrame:
    """(blob, text): one row for each blob of docs that the ledger lacks under this version. Copies meet before the shuffle, so a blob of very many paths is one row in each map task."""
    every = docs.select(blob(F.col("text")).alias("blob"), "text").groupBy("blob").agg(F.first("text").alias("text"))
    done = ledger.where(F.col("version") == version).select("blob").distinct()
    return every.join(done.hint("merge"), "blob", "left_anti")


def update(docs: DataFrame, store: str, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> None:
    """Scans the blobs of docs that the ledger in folder store lacks and appends them to it.

    A null text is the empty blob. Ids play no part. A run that is broken off leaves the ledger as it was; one that is run again appends nothing.
    """
    docs = texts(docs, id_col, text_col)
    version = rule_version(rules)
    fresh = findings(unseen(docs, read_ledger(docs.sparkSession, store), version), rules)
    fresh.withColumn("version", F.lit(version)).write.mode("append").partitionBy("version").parquet(f"{store}/ledger")


def by_path(docs: DataFrame, store: str, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, blob, found): every row with the findings that the ledger holds for its blob, whichever run made them; empty where there are none.

    Each row is a version of its path, so a path may have several. Equal texts get equal findings, repeated rows stay repeated, an empty table gives an empty result.
    """
    paths = texts(docs, id_col, text_col).select("doc_id", blob(F.col("text")).alias("blob"))
    known = read_ledger(docs.sparkSession, store).where((F.col("version") == rule_version(rules)) & (F.size("found") > 0))
    # two runs at once may both append a blob
    known = known.groupBy("blob").agg(F.first("found").alias("known"))
    return join_split(paths, known, ["blob"], "left").select("doc_id", "blob", F.coalesce("known", F.expr(f"CAST(array() AS {FOUND})")).alias("found"))


def told(found: Column) -> Column:
    """kind:start:stop of an array of findings, comma-joined."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.stop.cast("string"))), ",")


def digest(paths: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The columns of the query: counts of base kinds, hash of the base places, all places."""
    count = lambda k: F.size(F.filter("found", lambda x: x.kind_no == k)).cast("long")
    base = F.filter("found", lambda x: x.kind_no < BASE)
    return paths.select("doc_id", *(count(k).alias(f"n_{rules[k].kind}") for k in range(BASE)), F.sha2(told(base), 256).alias("base_sha256"), told(F.col("found")).alias("spans"))
