"""Queries: engagement, telemetry, windows, joins of events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skein.operators import ranking, spread
from skein.plans.base import DE, IX, corpus_vectors, doc_embeddings, interactions, query, sql, table
from skein.sources import files
from skein.sources.stored import Stored
from skein.sources.tables import folder

#: Upper bounds of the latency histogram, in seconds.
BOUNDS = (0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.0, 5.0)
_KIND = "CASE event_id % 3 WHEN 0 THEN 'full' WHEN 1 THEN 'feature' ELSE 'none' END"


def engagement(events):
    """Conditional counts, mean dwell time and click rate of each chunk, in one partial and one final aggregate."""
    n = lambda k: F.count_if(F.col("event_type") == k)
    return events.groupBy("chunk_id", "tenant_id").agg(
        n("impression").alias("impressions"), n("click").alias("clicks"), n("upvote").alias("upvotes"), n("downvote").alias("downvotes"),
        F.round(F.avg("dwell_time_ms"), 4).alias("avg_dwell"), F.round(n("click") / F.nullif(n("impression"), F.lit(0)), 6).alias("ctr"),
    )


AG1 = f"""WITH {DE}, {IX} SELECT de.id AS chunk_id, tenant_id, count(*) FILTER (event_type = 'impression') AS impressions, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'upvote') AS upvotes,
 count(*) FILTER (event_type = 'downvote') AS downvotes, round(avg(dwell_time_ms), 4) AS avg_dwell, round(count(*) FILTER (event_type = 'click') / nullif(count(*) FILTER (event_type = 'impression'), 0)::DOUBLE, 6) AS ctr FROM de LEFT JOIN ix ON de.id = ix.chunk_id GROUP BY 1, 2"""


@query("ag1_engagement", AG1)
def ag1(spark, sf):
    de = doc_embeddings(spark, sf).select(F.col("id").alias("chunk_id"), "tenant_id")
    return engagement(de.join(interactions(spark, sf).select("chunk_id", "event_type", "dwell_time_ms"), "chunk_id", "left"))


@query("jn1_chunks_with_events", f"WITH {DE}, {IX} SELECT de.id AS chunk_id, count(event_id) AS n FROM de LEFT JOIN ix ON de.id = ix.chunk_id GROUP BY 1")
def jn1(spark, sf):
    de = doc_embeddings(spark, sf).select(F.col("id").alias("chunk_id"))
    return de.join(interactions(spark, sf).select("chunk_id", "event_id"), "chunk_id", "left").groupBy("chunk_id").agg(F.count("event_id").alias("n"))


sql("ag3_query_stats", f"SELECT event_type AS endpoint, count(*) AS total, count(CASE WHEN {_KIND} = 'full' THEN 1 END) AS full_hits, count(CASE WHEN {_KIND} = 'feature' THEN 1 END) AS feature_hits, count(CASE WHEN {_KIND} = 'none' THEN 1 END) AS misses, round(max_by(value, struct(ts, event_id)), 6) AS last_latency FROM events GROUP BY event_type",
    f"SELECT event_type AS endpoint, count(*) AS total, count(CASE WHEN {_KIND} = 'full' THEN 1 END) AS full_hits, count(CASE WHEN {_KIND} = 'feature' THEN 1 END) AS feature_hits, count(CASE WHEN {_KIND} = 'none' THEN 1 END) AS misses, round(max_by(value, row(ts, event_id)), 6) AS last_latency FROM events GROUP BY event_type")

_P = "max(CASE WHEN r = CAST(floor({p} * (n - 1)) AS BIGINT) + 1 THEN value END) AS {a}"
AG4 = "SELECT event_type, " + ", ".join(_P.format(p=p, a=a) for p, a in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"))) + " FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events) t GROUP BY event_type"


@query("ag4_percentiles", AG4)
def ag4(spark, sf):
    """Exact selection by histograms; only the last bins' rows are sorted."""
    return spread.quantiles(table(spark, sf, "events").select("event_type", "value"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


@query("ag5_histogram", """SELECT event_type, le, count(*) FILTER (value / 100 <= le) AS n, count(*) AS count, round(sum(value / 100), 3) AS sum
 FROM events, (SELECT unnest([0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.0, 5.0, 'Infinity'::DOUBLE]::DOUBLE[]) AS le) b GROUP BY 1, 2""")
def ag5(spark, sf):
    v = table(spark, sf, "events")
    counts = [F.struct(F.lit(float(b)).alias("le"), F.count_if(F.col("value") / 100 <= b).alias("n")) for b in (*BOUNDS, float("inf"))]
    whole = v.groupBy("event_type").agg(F.array(*counts).alias("h"), F.count("*").alias("count"), F.round(F.sum(F.col("value") / 100), 3).alias("sum"))
    return whole.select("event_type", "count", "sum", F.inline("h"))


sql("ag6_counters", f"SELECT event_type AS endpoint, {_KIND} AS cache, count(*) AS n FROM events GROUP BY 1, 2")
sql("ag10_metric_rollup", "SELECT user_id AS device_id, event_type AS metric, date_format(date_trunc('hour', ts), 'yyyy-MM-dd HH') AS hour, CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) / count(*) AS mean, min(value) AS low, max(value) AS high, count(*) AS n FROM events GROUP BY 1, 2, 3",
    "SELECT user_id AS device_id, event_type AS metric, strftime(ts, '%Y-%m-%d %H') AS hour, CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) / count(*) AS mean, min(value) AS low, max(value) AS high, count(*) AS n FROM events GROUP BY 1, 2, 3")
sql("ag11_share_by_category", "SELECT lang, source, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY lang), 6) AS share FROM documents GROUP BY lang, source",
    "SELECT lang, source, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY lang), 6) AS share FROM documents GROUP BY lang, source")
sql("ag11_hourly_peak", "SELECT max(n) AS peak, round(avg(n), 4) AS mean FROM (SELECT date_format(ts, 'yyyy-MM-dd HH') AS h, count(*) AS n FROM events GROUP BY 1)",
    "SELECT max(n) AS peak, round(avg(n), 4) AS mean FROM (SELECT strftime(ts, '%Y-%m-%d %H') AS h, count(*) AS n FROM events GROUP BY 1)")
sql("ag12_outcomes", "SELECT event_type, CASE WHEN value < 20 THEN 'loss' WHEN value < 60 THEN 'neutral' ELSE 'win' END AS outcome, count(*) AS n FROM events GROUP BY 1, 2")


#: Shares of a request's time that its stages take, for want of measured ones; total is all of it.
_STAGES = {"embed": 0.4, "retrieve": 0.25, "feature": 0.1, "ltr": 0.05, "fusion": 0.2, "total": 1.0}


@query("ag13_stage_timing", f"SELECT stage, count(*) AS n, round(avg(ms), 4) AS mean, round(max(ms), 4) AS most FROM (SELECT unnest({list(_STAGES)}) AS stage, unnest([{', '.join(f'value * {s}' for s in _STAGES.values())}]) AS ms FROM events) GROUP BY 1")
def ag13(spark, sf):
    v = table(spark, sf, "events").select("event_id", *((F.col("value") * s).alias(stage) for stage, s in _STAGES.items()))
    long = v.unpivot("event_id", list(_STAGES), "stage", "ms")
    return long.groupBy("stage").agg(F.count("*").alias("n"), F.round(F.avg("ms"), 4).alias("mean"), F.round(F.max("ms"), 4).alias("most"))


sql("ag14_cache_hits", "SELECT c.key, c.hits + count(v.event_id) AS hits FROM (SELECT DISTINCT user_id AS key, user_id % 3 AS hits FROM events) c LEFT JOIN events v ON v.user_id = c.key AND v.event_type = 'click' GROUP BY c.key, c.hits")
sql("ag15_registry_upsert", "SELECT user_id AS model, max_by(event_type, event_id) AS status, max(event_id) AS seq FROM events GROUP BY 1")


def _thirds(spark, sf, columns):
    """events in three parts of rising event_id."""
    v = table(spark, sf, "events")
    a, b = v.agg(F.expr("max(event_id) div 3"), F.expr("2 * max(event_id) div 3")).first()
    return [v.where(cond).selectExpr(*columns) for cond in (f"event_id <= {a}", f"event_id > {a} AND event_id <= {b}", f"event_id > {b}")]


@query("ag14_stored_hits", "SELECT user_id AS key, count(*) FILTER (event_type = 'click') AS hits FROM events GROUP BY 1")
def ag14_stored(spark, sf):
    """Hit counts in a stored table: a base, two updates, the first of which is compacted into the folders that it touches."""
    counts = Stored(spark, folder(spark, "hits"), "key", {"hits": "sum"})
    for n, part in enumerate(_thirds(spark, sf, ["user_id AS key", "event_id AS seq", "CAST(event_type = 'click' AS BIGINT) AS hits"])):
        counts.update(part, n)
        if n < 2:
            counts.compact()
    return counts.rows().select("key", "hits")


@query("ag15_stored_registry", "SELECT user_id AS model, max_by(event_type, event_id) AS status, max(event_id) AS seq FROM events GROUP BY 1")
def ag15_stored(spark, sf):
    """A stored registry after two updates; rows that an update doesn't name stay."""
    registry = Stored(spark, folder(spark, "registry"), "model", {"status": "last"})
    for n, part in enumerate(_thirds(spark, sf, ["user_id AS model", "event_id AS seq", "event_type AS status"])):
        registry.update(part, n)
        if n == 0:
            registry.compact()
    return registry.rows().select("model", "status", "seq")


@query("ag16_context", "SELECT label, string_agg(text, chr(10) || '---' || chr(10) ORDER BY vec_id) AS context FROM (SELECT label, text, vec_id FROM embeddings JOIN documents ON vec_id = doc_id QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) <= 5) GROUP BY label")
def ag16(spark, sf):
    """The first five of each label, whole; texts join after the cut."""
    w = Window.partitionBy("query_id").orderBy("id")
    top = corpus_vectors(spark, sf).select(F.col("label").alias("query_id"), "id").withColumn("rank", F.row_number().over(w)).where("rank <= 5")
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("chunk"))
    return ranking.context(ranking.with_texts(top, texts), "\n---\n").withColumnRenamed("query_id", "label")


_LAST = "SELECT event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) t WHERE n <= 200"
sql("wn3_last_samples", _LAST)
@query("wn3_rolling_mean", "SELECT event_id, CAST(sum(CAST(value AS DECIMAL(18, 2))) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS DOUBLE) / count(*) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS mean FROM events")
def wn3_rolling(spark, sf):
    v = spread.numbered(table(spark, sf, "events").select("event_type", "ts", "event_id", "value"), ["event_type"], ["ts", "event_id"])
    v, keys, own = spread.framed(v, ["event_type"], 199)
    w = Window.partitionBy(*keys).orderBy("pos").rowsBetween(-199, 0)
    mean = F.sum(F.col("value").cast("decimal(18,2)")).over(w).cast("double") / F.count("*").over(w)
    return v.withColumn("mean", mean).where(own).select("event_id", "mean")


sql("wn5_last_per_user", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) t WHERE n <= 3")
sql("so8_history", "SELECT event_id, event_type, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 200")
sql("so9_request_sizes", "SELECT event_id, coalesce(CASE WHEN event_id % 9 = 0 THEN NULL ELSE event_id % 230 END, 10) AS k, coalesce(CASE WHEN event_id % 9 = 0 THEN NULL ELSE event_id % 230 END, 10) BETWEEN 1 AND 200 AS accepted FROM events")
sql("jn8_experiments", "SELECT x.id AS experiment_id, x.name, count(*) AS n, round(avg(v.value), 4) AS latency FROM (SELECT 0 AS id, 'base' AS name UNION ALL SELECT 1, 'a' UNION ALL SELECT 2, 'b') x JOIN events v ON v.event_id % 4 = x.id GROUP BY 1, 2")


@query("jn9_clicked_ids", "SELECT c.user_id, c.chunk_id, label FROM (SELECT user_id, unnest(list(DISTINCT event_id % 50)) AS chunk_id FROM events WHERE event_type = 'click' GROUP BY user_id) c JOIN embeddings ON vec_id = chunk_id")
def jn9(spark, sf):
    v = table(spark, sf, "events").where("event_type = 'click'").groupBy("user_id").agg(F.collect_set(F.col("event_id") % 50).alias("ids"))  # at most 50 values
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), "label")
    return v.select("user_id", F.explode("ids").alias("chunk_id")).join(e.hint("merge"), "chunk_id").select("user_id", "chunk_id", "label")


_CACHE = "CASE WHEN c.k IS NULL THEN 'none' WHEN c.expires <= v.event_id THEN 'none' WHEN c.version = 2 AND abs(c.w - 0.6) <= 1e-9 AND abs(c.u - 0.4) <= 1e-9 THEN 'full' ELSE 'feature' END"
sql("jn10_cache_lookup", f"SELECT v.event_id, {_CACHE} AS kind FROM events v LEFT JOIN (SELECT user_id AS k, event_id % 2 + 5 AS top_k, max(event_id) AS expires, max(event_id % 3) AS version, max(CASE WHEN event_id % 2 = 0 THEN 0.6 ELSE 0.5 END) AS w, min(CASE WHEN event_id % 7 = 0 THEN 0.5 ELSE 0.4 END) AS u FROM events WHERE event_type = 'view' GROUP BY 1, 2) c ON v.user_id = c.k AND v.event_id % 2 + 5 = c.top_k")


@query("io8_monthly_partitions", "SELECT strftime(ts, '%Y_%m') AS month, count(*) AS n, strftime(date_trunc('month', min(ts)) + INTERVAL 1 MONTH, '%Y_%m') AS next_month, min(event_id) AS first_id FROM events GROUP BY 1")
def io8(spark, sf):
    """The log is appended by month and read back; next_month names the partition to come."""
    path = folder(spark, "months")
    files.write_events(table(spark, sf, "events"), path)
    next_month = F.date_format(F.add_months(F.date_trunc("month", F.min("ts")), 1), "yyyy_MM")
    return spark.read.parquet(path).groupBy("month").agg(F.count("*").alias("n"), next_month.alias("next_month"), F.min("event_id").alias("first_id"))


@query("io8_one_month", "SELECT event_id FROM events WHERE strftime(ts, '%Y_%m') = (SELECT min(strftime(ts, '%Y_%m')) FROM events)")
def io8_one(spark, sf):
    """A read of one month touches its folder alone."""
    path = folder(spark, "months")
    files.write_events(table(spark, sf, "events"), path)
    log = spark.read.parquet(path)
    return log.where(F.col("month") == F.lit(log.agg(F.min("month")).first()[0])).select("event_id")


sql("sc26_json_field", "SELECT event_id, variant_get(try_parse_json(props), '$.k', 'bigint') AS k FROM events", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
sql("fp14_payload", "SELECT event_id, CASE WHEN p RLIKE '^[0-9]+$' THEN CAST(p AS BIGINT) END AS id FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN cast(event_id AS string) ELSE props END AS p FROM events)",
    "SELECT event_id, TRY_CAST(p AS BIGINT) AS id FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_id::VARCHAR ELSE props END AS p FROM events)")
