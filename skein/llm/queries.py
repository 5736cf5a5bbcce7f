"""The registered queries of this package; each applies an operator to its whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import bpe_stream, decontam_gst, filter_audit, hilbert_shards, lexical_blocks, license_rules, merkle, pii_crf, secret_ledger, simhash_grid, toxicity_ws, unigram_count, url_templates
from skein.llm.common import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _told(spans: str):
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.stop.cast("string"))), ",")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = pii_crf.find(docs, pii_crf.fit(docs))
    count = lambda k: F.size(F.filter("base", lambda x: x.kind == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, pii_crf.KINDS), F.sha2(_told("base"), 256).alias("base_sha256"), _told("spans").alias("spans"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_ws.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam_gst.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over a ledger of their own: the older half of the ids, then the whole table, of which only new blobs are scanned. Findings of both join back to all paths."""
    docs, store = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/secrets-{uuid.uuid4().hex}"
    middle = docs.agg(((F.min("doc_id") + F.max("doc_id")) / 2).alias("m")).first()["m"]
    secret_ledger.update(docs.where(F.col("doc_id") <= F.lit(middle)), store)
    secret_ledger.update(docs, store)
    return secret_ledger.digest(secret_ledger.by_path(docs, store))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_rules.scan(table(spark, sf_dir, "documents")).drop("detections")


def op6_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.edits(table(spark, sf_dir, "documents"))


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_templates.judge(table(spark, sf_dir, "pages"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_stream.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram_count.count_tokens(table(spark, sf_dir, "documents"), unigram_count.piece_scores(tokenizer_path("piece_bpe_32k.model")))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_grid.near_duplicates(table(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_blocks.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(filter_audit.masks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def op13_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = hilbert_shards.shards(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


AUDIT_SQL = """WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
 w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM d),
 g AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
 f AS (SELECT part, good, toxic, (len(words) < 100)::INT + 2 * (100 * len(list_distinct(words)) < 80 * len(words))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::INT
  + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), false)::INT AS mask FROM w LEFT JOIN g ON w.doc_id = g.doc_id),
 l AS (SELECT unnest(range(5))::INT AS k), o AS (SELECT a.k AS a, b.k AS b, c.k AS c, d.k AS d, e.k AS e FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
 s AS (SELECT chr(65 + a) || chr(65 + b) || chr(65 + c) || chr(65 + d) || chr(65 + e) AS filter_order, unnest([1, 2, 3, 4, 5]) AS step, unnest([1 << a, 1 << b, 1 << c, 1 << d, 1 << e]) AS bit,
  unnest([0, 1 << a, (1 << a) | (1 << b), (1 << a) | (1 << b) | (1 << c), (1 << a) | (1 << b) | (1 << c) | (1 << d)]) AS before FROM o),
 r AS (SELECT part, filter_order, step, bit, count(*) FILTER (mask & (before | bit) = 0) AS kept, count(*) FILTER (mask & bit <> 0 AND mask & before = 0) AS removed, count(*) FILTER (mask & bit <> 0 AND mask & before <> 0) AS redundant,
  count(*) FILTER (mask = bit) AS unique_fails, count(*) FILTER (mask & bit <> 0 AND mask & before = 0 AND good = 1) AS good_lost, count(*) FILTER (mask & bit <> 0 AND mask & before = 0 AND toxic = 1) AS toxic_lost FROM f, s GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r"""

QUERIES = {f.__name__: f for f in (op1_pii, op2_toxicity, op3_decontamination, op4_secrets, op5_licenses, op6_merkle, op7_urls, op8_bpe, op9_token_counts, op10_simhash, op11_lexical_search, op12_filter_audit, op13_hilbert_shards)}
#: The other operators have no full SQL form; tests/llm holds each against a brute-force version.
ORACLE_SQL: dict[str, str] = {"op12_filter_audit": AUDIT_SQL}
