"""Tables derived from the given ones, in Spark and as DuckDB common table expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def sql(name: str, spark_sql: str, oracle: str | None = None) -> None:
    """A query that is one SQL statement over the given tables; oracle is the same statement unless dialects differ."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for t in TABLES:
            if t in spark_sql:
                table(spark, sf_dir, t).createOrReplaceTempView(t)
        return spark.sql(spark_sql)

    query(name, oracle or spark_sql)(run)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _with_meta(e: DataFrame) -> DataFrame:
    k = F.col("vec_id") % 4
    tags = F.when(k == 1, F.array(F.lit("core"))).when(k == 2, F.array(F.lit("core"), F.lit("schema"))).when(k == 3, F.array(F.lit("other")))
    return e.select(
        "*", F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 3 == 0, "memory").otherwise("docs").alias("source"),
        (F.col("vec_id") * 3600 + 1704067200).cast("double").alias("ts"), tags.alias("tags"),
        F.when(F.col("vec_id") % 5 != 0, F.concat(F.lit("tenant_"), (F.col("vec_id") % 3).cast("string"))).alias("tenant_id"),
    )


def doc_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, chunk, source, embedding, label, ts (epoch seconds), tags, tenant_id."""
    e, d = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), F.col("text").alias("chunk"))
    return _with_meta(e.join(d, "vec_id")).select("id", "chunk", "source", "embedding", "label", "ts", "tags", "tenant_id")


DE = """de AS (SELECT vec_id AS id, text AS chunk, CASE WHEN vec_id % 3 = 0 THEN 'memory' ELSE 'docs' END AS source, embedding::DOUBLE[] AS embedding, label,
 (vec_id * 3600 + 1704067200)::DOUBLE AS ts, CASE vec_id % 4 WHEN 1 THEN ['core'] WHEN 2 THEN ['core', 'schema'] WHEN 3 THEN ['other'] END AS tags,
 CASE WHEN vec_id % 5 <> 0 THEN 'tenant_' || (vec_id % 3) END AS tenant_id FROM embeddings JOIN documents ON vec_id = doc_id)"""


def corpus_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_embeddings without the texts, which candidates alone need: only ids of documents are read."""
    e, d = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id")).distinct()
    return _with_meta(e.join(d, "vec_id", "left_semi")).select("id", "source", "embedding", "label", "ts", "tags", "tenant_id")


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 50."""
    return table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


QV = "qv AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS query_vector FROM embeddings WHERE vec_id % 50 = 0)"
KNN = f"""WITH {DE}, {QV}, pairs AS (SELECT query_id, de.*, round(list_distance(embedding, query_vector), 6) AS distance FROM de, qv),
 cand AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, id) <= 10)"""
FUSED = KNN + """, f1 AS (SELECT *, round(1 / (1 + distance), 6) AS similarity, round(ln(greatest(length(chunk), 1)), 6) AS log_length FROM cand),
 f2 AS (SELECT *, round(similarity + log_length + 1, 6) AS ltr FROM f1),
 f3 AS (SELECT *, round(CASE WHEN max(ltr) OVER w - min(ltr) OVER w <= 1e-9 THEN 0.5 ELSE (ltr - min(ltr) OVER w) / (max(ltr) OVER w - min(ltr) OVER w) END, 6) AS ltr_norm FROM f2 WINDOW w AS (PARTITION BY query_id)),
 f4 AS (SELECT *, round(0.6 * ltr_norm + 0.4 * similarity, 6) AS fused FROM f3),
 fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, distance, id) AS rank FROM f4)"""


def chunk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    rows = d.select("doc_id", "source", F.posexplode(text.chunks(F.col("text"))).alias("ordinal", "chunk"))
    return rows.where("chunk <> ''")


CHUNKS = r"""chunks AS (SELECT doc_id, source, CAST(k AS INT) AS ordinal, regexp_replace(substring(text, CAST(k * 720 + 1 AS INT), 800), '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g') AS chunk
 FROM (SELECT *, unnest(range(greatest(CAST(ceil((length(text) - 80) / 720.0) AS INT), 1))) AS k FROM documents) WHERE regexp_replace(substring(text, CAST(k * 720 + 1 AS INT), 800), '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g') <> '')"""


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunk_id, event_type, dwell_time_ms, session_id, occurred_at."""
    v = table(spark, sf_dir, "events")
    kind = F.expr("CASE event_type WHEN 'view' THEN 'impression' WHEN 'click' THEN 'click' WHEN 'purchase' THEN 'upvote' WHEN 'error' THEN 'downvote' ELSE 'other' END")
    return v.select(
        "event_id", F.col("ts").alias("occurred_at"), F.col("user_id").alias("chunk_id"), kind.alias("event_type"),
        F.when(F.col("event_type") != "error", F.floor(F.col("value") * 10).cast("int")).alias("dwell_time_ms"),
        F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMdd")).alias("session_id"), "value", F.col("user_id").alias("user_id"),
    )


IX = """ix AS (SELECT event_id, ts AS occurred_at, user_id AS chunk_id, CASE event_type WHEN 'view' THEN 'impression' WHEN 'click' THEN 'click' WHEN 'purchase' THEN 'upvote' WHEN 'error' THEN 'downvote' ELSE 'other' END AS event_type,
 CASE WHEN event_type <> 'error' THEN floor(value * 10)::INT END AS dwell_time_ms, user_id || '-' || strftime(ts, '%Y%m%d') AS session_id, value, user_id FROM events)"""
