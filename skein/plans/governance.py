"""Queries: tenants, configuration, data quality, the knowledge graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators import graph, intervals
from skein.plans.base import CHUNKS, DE, chunk_rows, doc_embeddings, query, sql, table
from skein.sources import payload, stored
from skein.sources.tables import folder, parts_of

# Fixed values of the configuration snapshot: prefixes that are shown, markers that are not, the one exception.
PREFIXES = ("RAG_", "OLLAMA_", "REDIS_", "PG_", "DATABASE_URL", "CHROMA_", "SUPABASE_URL")
MARKERS = ("KEY", "SECRET", "PASS", "TOKEN", "PASSWORD")
EXCEPTION = "SUPABASE_URL"


def visible(row_tenant: Column, tenant: str | None, require: bool, role: str = "user") -> Column:
    """Whether a row may be read: always, unless tenants are required; then equal tenants, and rows without one for an admin alone."""
    if not require:
        return F.lit(True)
    own = F.coalesce(row_tenant == F.lit(tenant), F.lit(False))
    return own | row_tenant.isNull() if role == "admin" else own


def snapshot(config: DataFrame) -> DataFrame:
    """(key, value) that may be shown; values over 200 characters are cut to 197 and three dots."""
    k = F.col("key")
    shown = F.lit(False)
    for p in PREFIXES:
        shown = shown | k.startswith(p)
    secret = F.upper(k).rlike("|".join(MARKERS))
    value = F.when((F.length("value") > 200) & (k != EXCEPTION), F.concat(F.left("value", F.lit(197)), F.lit("..."))).otherwise(F.col("value"))
    return config.where(shown & ((k == EXCEPTION) | ~secret)).select("key", value.alias("value"))


def renamed(config: DataFrame, names: DataFrame) -> DataFrame:
    """config (key, value) with a row under the new name of each (old, new) whose new name is absent."""
    fresh = names.join(config.select(F.col("key").alias("new")), "new", "left_anti")
    return config.unionByName(config.join(fresh, config.key == fresh.old).select(F.col("new").alias("key"), "value"))


@query("fp4_tenant_visible", f"WITH {DE} SELECT id FROM de WHERE tenant_id = 'tenant_1' OR tenant_id IS NULL")
def fp4(spark, sf):
    return doc_embeddings(spark, sf).where(visible(F.col("tenant_id"), "tenant_1", True, "admin")).select("id")


@query("fp5_tenant_writes", f"WITH {DE} SELECT id, coalesce(tenant_id = 'tenant_1', false) AS accepted FROM de")
def fp5(spark, sf):
    return doc_embeddings(spark, sf).select("id", visible(F.col("tenant_id"), "tenant_1", True).alias("accepted"))


def may_write(operation: Column, old_tenant: Column, new_tenant: Column, tenant: str | None, require: bool, role: str = "user") -> Column:
    """Whether a change may be made: an insert if the new row's tenant is the caller's, an update if both are, a delete if the row is visible and the caller an admin."""
    if not require:
        return F.lit(True)
    mine = lambda t: F.coalesce(t == F.lit(tenant), F.lit(False))
    delete = visible(old_tenant, tenant, True, role) if role == "admin" else F.lit(False)
    return F.coalesce(F.when(operation == "insert", mine(new_tenant)).when(operation == "update", mine(old_tenant) & mine(new_tenant)).when(operation == "delete", delete), F.lit(False))


_CHANGES = "SELECT id, CASE id % 3 WHEN 0 THEN 'insert' WHEN 1 THEN 'update' ELSE 'delete' END AS operation, CASE WHEN id % 3 > 0 THEN tenant_id END AS old_tenant, CASE WHEN id % 3 = 0 OR id % 4 > 0 THEN tenant_id ELSE 'tenant_2' END AS new_tenant FROM de"


@query("fp5_writes_by_operation", f"""WITH {DE}, c AS ({_CHANGES}), m AS (SELECT *, coalesce(old_tenant = 'tenant_1', false) AS had, coalesce(new_tenant = 'tenant_1', false) AS has FROM c)
 SELECT id, role, CASE operation WHEN 'insert' THEN has WHEN 'update' THEN had AND has ELSE role = 'admin' AND (had OR old_tenant IS NULL) END AS accepted FROM m, (SELECT unnest(['user', 'admin']) AS role)""")
def fp5_operations(spark, sf):
    """Inserts, updates and deletes of a batch, as a user and as an admin of one tenant."""
    doc_embeddings(spark, sf).select("id", "tenant_id").createOrReplaceTempView("de")
    changes = spark.sql(_CHANGES)
    asked = lambda role: changes.select("id", F.lit(role).alias("role"), may_write(F.col("operation"), F.col("old_tenant"), F.col("new_tenant"), "tenant_1", True, role).alias("accepted"))
    return asked("user").unionByName(asked("admin"))


sql("fp3_source", "SELECT doc_id FROM documents WHERE source = 'src3'")
sql("fp6_not_deleted", "SELECT doc_id FROM (SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN doc_id END AS deleted_at FROM documents) t WHERE deleted_at IS NULL")
sql("fp7_active_covering", "SELECT doc_id, text, n_chars FROM documents WHERE doc_id % 6 <> 0 AND source = 'src1'")
sql("fp8_latest_by_hash", "SELECT md5(text) AS h, max(doc_id) AS latest, count(*) AS versions FROM documents GROUP BY 1")

_CFG = "SELECT concat(CASE event_id % 4 WHEN 0 THEN 'RAG_' WHEN 1 THEN 'REDIS_' WHEN 2 THEN 'OTHER_' ELSE 'PG_' END, upper(event_type), CASE WHEN event_id % 5 = 0 THEN '_KEY' WHEN event_id % 5 = 1 THEN '_TOKEN' ELSE concat('_', cast(event_id AS {s})) END) AS key, repeat('x', CAST(event_id % 250 AS INT)) AS value FROM events"


@query("fp12_config_snapshot", f"SELECT key, CASE WHEN length(value) > 200 THEN left(value, 197) || '...' ELSE value END AS value FROM ({_CFG.format(s='VARCHAR')}) WHERE (starts_with(key, 'RAG_') OR starts_with(key, 'REDIS_') OR starts_with(key, 'PG_')) AND NOT regexp_matches(key, 'KEY|SECRET|PASS|TOKEN')")
def fp12(spark, sf):
    table(spark, sf, "events").createOrReplaceTempView("events")
    return snapshot(spark.sql(_CFG.format(s="string")))


@query("fp13_renamed_keys", "WITH c AS (SELECT DISTINCT 'k' || user_id AS key, 'v' || user_id AS value FROM events), n AS (SELECT DISTINCT 'k' || user_id AS old, 'k' || (user_id + 40) AS new FROM events) SELECT key, value FROM c UNION ALL SELECT n.new, c.value FROM c JOIN n ON c.key = n.old WHERE n.new NOT IN (SELECT key FROM c)")
def fp13(spark, sf):
    u = table(spark, sf, "events").select("user_id").distinct()
    k = lambda x: F.concat(F.lit("k"), x.cast("string"))
    return renamed(u.select(k(F.col("user_id")).alias("key"), F.concat(F.lit("v"), F.col("user_id").cast("string")).alias("value")), u.select(k(F.col("user_id")).alias("old"), k(F.col("user_id") + 40).alias("new")))


def check_rows(checks: list[tuple[str, DataFrame]]) -> DataFrame:
    """(check_name, status, details): one row for each check, whose frame has one row of figures (failed, ...); details are the figures as JSON."""
    rows = [df.select(F.lit(name).alias("check_name"), F.when(F.col("failed") > 0, "fail").otherwise("pass").alias("status"), F.to_json(F.struct("*")).alias("details")) for name, df in checks]
    return reduce(DataFrame.unionByName, rows)


def _missing(spark, sf) -> DataFrame:
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(1).alias("there"))
    both = table(spark, sf, "documents").select("doc_id").join(e, "doc_id", "left")
    return both.agg(F.count_if(F.col("there").isNull()).alias("failed"), F.count("*").alias("total"))


def _orphans(spark, sf) -> DataFrame:
    """Keys of either side of three links that the other side lacks: orders and their lines, documents and their vectors, documents and their labels."""
    keys = lambda t, c: table(spark, sf, t).select(F.col(c).alias("key")).where("key IS NOT NULL").distinct()
    o, i, d, e, l = keys("orders", "o_orderkey"), keys("lineitem", "l_orderkey"), keys("documents", "doc_id"), keys("embeddings", "vec_id"), keys("labels", "doc_id")
    lacks = lambda a, b, side: a.join(b.hint("merge"), "key", "left_anti").withColumn("side", F.lit(side))
    return reduce(DataFrame.unionByName, [lacks(o, i, "order"), lacks(i, o, "line"), lacks(d, e, "document without vector"), lacks(e, d, "vector"), lacks(d, l, "document without label"), lacks(l, d, "label")])


_D1 = "SELECT count(*) - count(e.vec_id) AS failed, count(*) AS total FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id"


_O = " UNION ALL ".join(
    f"SELECT DISTINCT {a} AS key, '{side}' AS side FROM {t} WHERE {a} NOT IN (SELECT {b} FROM {u} WHERE {b} IS NOT NULL)"
    for t, a, u, b, side in (
        ("orders", "o_orderkey", "lineitem", "l_orderkey", "order"), ("lineitem", "l_orderkey", "orders", "o_orderkey", "line"), ("documents", "doc_id", "embeddings", "vec_id", "document without vector"),
        ("embeddings", "vec_id", "documents", "doc_id", "vector"), ("documents", "doc_id", "labels", "doc_id", "document without label"), ("labels", "doc_id", "documents", "doc_id", "label"),
    )
)


@query("dq1_null_embeddings", f"SELECT failed, total, round(failed / total::DOUBLE, 6) AS rate FROM ({_D1})")
def dq1(spark, sf):
    return _missing(spark, sf).withColumn("rate", F.round(F.col("failed") / F.col("total"), 6))


@query("dq1_check_rows", f"""SELECT 'null_embeddings' AS check_name, CASE WHEN failed > 0 THEN 'fail' ELSE 'pass' END AS status, '{{"failed":' || failed || ',"total":' || total || '}}' AS details FROM ({_D1})
 UNION ALL SELECT 'orphan_links', CASE WHEN count(*) > 0 THEN 'fail' ELSE 'pass' END, '{{"failed":' || count(*) || '}}' FROM ({_O})
 UNION ALL SELECT 'null_text', CASE WHEN count(*) FILTER (text IS NULL) > 0 THEN 'fail' ELSE 'pass' END, '{{"failed":' || count(*) FILTER (text IS NULL) || ',"total":' || count(*) || '}}' FROM documents""")
def dq1_rows(spark, sf):
    null_text = table(spark, sf, "documents").agg(F.count_if(F.col("text").isNull()).alias("failed"), F.count("*").alias("total"))
    return check_rows([("null_embeddings", _missing(spark, sf)), ("orphan_links", _orphans(spark, sf).agg(F.count("*").alias("failed"))), ("null_text", null_text)])


sql("dq2_stale", "SELECT event_id, ts < (SELECT max(ts) FROM events) - INTERVAL 30 DAY AS stale FROM events")


@query("dq3_orphans", _O)
def dq3(spark, sf):
    return _orphans(spark, sf)


sql("dq4_domains", "SELECT event_type, count(*) AS n FROM events WHERE event_type NOT IN ('view', 'click', 'purchase') GROUP BY 1")
sql("dq4_unique_keys", "SELECT md5(text) AS h, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
sql("dq5_required_keys", "SELECT r.key FROM (SELECT 'view' AS key UNION ALL SELECT 'refund' UNION ALL SELECT 'click') r LEFT ANTI JOIN events v ON v.event_type = r.key",
    "SELECT r.key FROM (SELECT 'view' AS key UNION ALL SELECT 'refund' UNION ALL SELECT 'click') r WHERE r.key NOT IN (SELECT event_type FROM events)")
sql("so7_backfill_batch", "SELECT d.doc_id FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id WHERE e.vec_id IS NULL ORDER BY d.doc_id LIMIT 100")
sql("jn6_mission_chain", "SELECT r_name, n_name, count(c_custkey) AS logs FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2")


@query("jn7_impact_trace", "SELECT p_partkey, count(DISTINCT o_orderkey) AS decisions, max(o_orderkey) AS last_one FROM part JOIN lineitem ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def jn7(spark, sf):
    """Lines meet their orders in parts of bounded size, where each pair of a part and an order is left once; counts of a task go on to the parts."""
    lines, orders = table(spark, sf, "lineitem").select("l_partkey", "l_orderkey"), table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    n = parts_of(lines.count())
    found = lines.repartition(n, "l_orderkey").join(orders.repartition(n, "l_orderkey").hint("merge"), "l_orderkey", "left_semi").distinct()
    per = found.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("decisions"), F.max("l_orderkey").alias("last_one"))
    # An inner join, since Spark takes a semi join below the counts, where it would meet all lines.
    return per.join(table(spark, sf, "part").select("p_partkey").distinct().hint("merge"), "p_partkey")


@query("jn4_documents_with_chunks", f"WITH {CHUNKS} SELECT d.doc_id, d.lang, count(*) AS n FROM documents d JOIN chunks c ON d.doc_id = c.doc_id GROUP BY 1, 2")
def jn4(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang")
    return d.join(chunk_rows(spark, sf).select("doc_id").hint("merge"), "doc_id").groupBy("doc_id", "lang").agg(F.count("*").alias("n"))


def span_overlap(changes: DataFrame, spans: DataFrame) -> DataFrame:
    """Pairs of (file, c_id, c_start, c_end) and (file, s_id, s_start, s_end) that overlap, whatever their lengths."""
    return intervals.overlapping(changes, spans, ["file"], ("c_start", "c_end"), ("s_start", "s_end"))


_C12, _S12 = ("source AS file, doc_id AS c_id, doc_id * 37 AS c_start, doc_id * 37 + 40 AS c_end", "source AS file, doc_id AS s_id, doc_id * 37 + 15 AS s_start, doc_id * 37 + 15 + n_chars % 1500 AS s_end")


@query("jn12_span_overlap", f"WITH c AS (SELECT {_C12} FROM documents), s AS (SELECT {_S12} FROM documents) SELECT c.file, c_id, s_id FROM c JOIN s ON c.file = s.file AND c_start <= s_end AND s_start <= c_end")
def jn12(spark, sf):
    d = table(spark, sf, "documents")
    return span_overlap(d.selectExpr(*_C12.split(", ")), d.selectExpr(*_S12.split(", "))).select("file", "c_id", "s_id")


@query("jn6_chain_of_any_length", """WITH RECURSIVE e AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders),
 t AS (SELECT 'r' || r_regionkey AS start, 'r' || r_regionkey AS node, 0 AS depth FROM region UNION SELECT start, dst, depth + 1 FROM t JOIN e ON node = src) SELECT start, depth, count(*) AS n, min(node) AS first_node FROM t GROUP BY 1, 2""")
def jn6_chain(spark, sf):
    """All that hangs below each region, however deep."""
    of = lambda t, a, x, b, y: table(spark, sf, t).select(F.concat(F.lit(a), F.col(x)).alias("src"), F.concat(F.lit(b), F.col(y)).alias("dst"))
    edges = of("nation", "r", "n_regionkey", "n", "n_nationkey").unionByName(of("customer", "n", "c_nationkey", "c", "c_custkey")).unionByName(of("orders", "c", "o_custkey", "o", "o_orderkey"))
    found = graph.reached(edges, table(spark, sf, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("start")))
    return found.groupBy("start", "depth").agg(F.count("*").alias("n"), F.min("node").alias("first_node"))


@query("jn7_trace_of_any_length", """WITH RECURSIVE f AS (SELECT l_partkey AS src, max(l_orderkey) AS o FROM lineitem WHERE l_linenumber = 1 GROUP BY 1), e AS (SELECT DISTINCT src, l_partkey AS dst FROM f JOIN lineitem ON l_orderkey = o AND l_linenumber = 2),
 t AS (SELECT src, dst FROM e UNION SELECT t.src, e.dst FROM t JOIN e ON t.dst = e.src) SELECT src AS part, count(*) AS reached, min(dst) AS least, count(*) FILTER (src = dst) > 0 AS returns FROM t GROUP BY 1""")
def jn7_trace(spark, sf):
    """From each part over the last order that it heads to the part named second there, and on; many traces end in cycles."""
    lines = table(spark, sf, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber")
    last = lines.where("l_linenumber = 1").groupBy(F.col("l_partkey").alias("src")).agg(F.max("l_orderkey").alias("l_orderkey"))
    edges = last.join(lines.where("l_linenumber = 2").hint("merge"), "l_orderkey").select("src", F.col("l_partkey").alias("dst"))
    found = graph.closure(edges)
    return found.groupBy(F.col("src").alias("part")).agg(F.count("*").alias("reached"), F.min("dst").alias("least"), (F.count_if(F.col("src") == F.col("dst")) > 0).alias("returns"))


sql("pl7_lag_features", "SELECT event_id, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, CAST(sum(CAST(value AS DECIMAL(18, 2))) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS DOUBLE) / count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS mean5 FROM events")
sql("pl4_stale_cleanup", "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 3 DAY")
@query("pl4_overwritten", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 3 DAY")
def pl4_overwritten(spark, sf):
    """Stale rows are deleted from a stored table by day: older folders go, one is written again, the rest stay as they are."""
    v, path = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), folder(spark, "memory")
    v.withColumn("day", F.date_format("ts", "yyyy-MM-dd")).write.partitionBy("day").parquet(path)
    stored.drop_older(spark, path, "ts", "day", v.agg((F.max("ts") - F.expr("INTERVAL 3 DAYS")).alias("t")).first()["t"])
    return spark.read.parquet(path).select("event_id", F.col("day").cast("string").alias("day"))


_ELEMENT = "CASE doc_id % 6 WHEN 0 THEN '7' WHEN 1 THEN '{\"text\":\"a\"}' WHEN 2 THEN '{\"id\":\"x\",\"text\":null}' WHEN 3 THEN '{\"id\":1,\"text\":5}' WHEN 4 THEN '{\"id\":2,\"text\":\" \"}' ELSE '{\"id\":true}' END"
_REASON = "CASE doc_id % 6 WHEN 0 THEN 'not an object' WHEN 1 THEN 'no id' WHEN 3 THEN 'text is no string' WHEN 4 THEN 'empty text' ELSE 'no text' END"


def _payloads(spark, sf):
    """Two elements from each document, its own text and one that is bad; some payloads are cut short, some no array, some null."""
    d = table(spark, sf, "documents")
    own = F.to_json(F.struct(F.col("doc_id").alias("id"), "text"))
    both = F.concat(F.lit("["), own, F.lit(", "), F.expr(_ELEMENT), F.lit("]"))
    k = F.col("doc_id") % 11
    return d.select(F.col("doc_id").alias("payload_id"), F.when(k == 0, F.concat(F.lit("["), own)).when(k == 1, own).when(k == 2, F.lit(None)).otherwise(both).alias("payload"))


@query("pl8_accepted", "SELECT doc_id AS payload_id, 0 AS place, CAST(doc_id AS VARCHAR) AS id, text FROM documents WHERE doc_id % 11 > 2 AND text IS NOT NULL AND trim(text) <> '' AND length(text) <= 100000")
def pl8_accepted(spark, sf):
    return payload.documents(_payloads(spark, sf))[0]


@query("pl8_rejected", f"""SELECT doc_id AS payload_id, 1 AS place, {_REASON} AS reason FROM documents WHERE doc_id % 11 > 2
 UNION ALL SELECT doc_id, NULL, CASE doc_id % 11 WHEN 0 THEN 'malformed' WHEN 1 THEN 'not an array' ELSE 'no payload' END FROM documents WHERE doc_id % 11 <= 2
 UNION ALL SELECT doc_id, 0, CASE WHEN text IS NULL THEN 'no text' WHEN trim(text) = '' THEN 'empty text' ELSE 'text too long' END FROM documents WHERE doc_id % 11 > 2 AND (text IS NULL OR trim(text) = '' OR length(text) > 100000)""")
def pl8_rejected(spark, sf):
    return payload.documents(_payloads(spark, sf))[1].drop("raw")


sql("pl11_daily_rollup", "SELECT date_format(ts, 'yyyy-MM-dd') AS day, event_id % 4 AS experiment_id, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) / count(*) AS mean, avg(value) > 60 AS slow FROM events GROUP BY 1, 2",
    "SELECT strftime(ts, '%Y-%m-%d') AS day, event_id % 4 AS experiment_id, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) / count(*) AS mean, avg(value) > 60 AS slow FROM events GROUP BY 1, 2")
sql("pl8_rejected_documents", "SELECT doc_id, CASE WHEN n_chars < 200 THEN 'short' WHEN n_chars > 10000 THEN 'long' ELSE 'accepted' END AS state FROM documents")
