"""Queries: streams, each with a batch twin in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.plans.base import query, table
from skein.plans.corpus import memory_json
from skein.sources.tables import folder
from skein.streaming import jobs


def _message(rows):
    fields = F.struct(F.lit("event").alias("type"), F.col("event_type").alias("channel"), F.col("user_id").alias("chunk_id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))
    return rows.select("event_id", F.to_json(fields).alias("message"))


@query("st2_fan_out", """SELECT event_id, '{"type":"event","channel":"' || event_type || '","chunk_id":' || user_id || ',"ts":"' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '"}' AS message FROM events""")
def st2(spark, sf):
    return jobs.to_table(_message(jobs.events_stream(spark, sf)), "st2")


@query("st3_engagement_refresh", "SELECT user_id AS chunk_id, count(*) FILTER (event_type = 'view') AS impressions, count(*) FILTER (event_type = 'click') AS clicks FROM events GROUP BY 1")
def st3(spark, sf):
    """Batches write partial counts, each under its id; the refresh sums them."""
    out = jobs.each_batch(jobs.events_stream(spark, sf), "st3", jobs.add_engagement)
    return jobs.Batches(spark, out).rows(jobs.ENGAGEMENT).groupBy(F.col("user_id").alias("chunk_id")).agg(F.sum("v").alias("impressions"), F.sum("c").alias("clicks"))


@query("st5_windows", "WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS s, count(*) AS n, round(avg(value), 4) AS mean FROM events GROUP BY 1) SELECT strftime(s, '%Y-%m-%d %H:%M') AS start, n, mean FROM w WHERE s + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR")
def st5(spark, sf):
    v = jobs.events_stream(spark, sf).withWatermark("ts", "2 hours")
    w = v.groupBy(F.window("ts", "1 hour")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"))
    return jobs.to_table(w.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("start"), "n", "mean"), "st5")


@query("st4_build_update", """SELECT event_id, '{"type":"build","content":"' || event_type || '","timestamp":"' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '","user":"' || user_id || '"}' AS message FROM events""")
def st4(spark, sf):
    base = F.create_map(F.lit("type"), F.lit("build"), F.lit("content"), F.col("event_type"), F.lit("timestamp"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    extras = F.create_map(F.lit("user"), F.col("user_id").cast("string"))
    return jobs.to_table(jobs.events_stream(spark, sf).select("event_id", F.to_json(F.map_concat(base, extras)).alias("message")), "st4")


_SESSIONS = "WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k"


def _sessions(v):
    s = v.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("st6_sessions", _SESSIONS)
def st6(spark, sf):
    return _sessions(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")))


@query("st6_closed_sessions", _SESSIONS + " HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR")
def st6_stream(spark, sf):
    """As a stream: a session comes out once the watermark has passed its end."""
    return jobs.to_table(_sessions(jobs.events_stream(spark, sf).withWatermark("ts", "2 hours")), "st6")


@query("st1_memory_ingest", "SELECT sha256(memory) AS content_hash, memory AS text FROM (SELECT DISTINCT CASE WHEN turn % 3 = 2 THEN role || ' | ' || text ELSE text END AS memory FROM conversations)")
def st1(spark, sf):
    """Lines of JSON arrive in two parts that overlap; the second run goes on from the first one's checkpoint and adds what is new."""
    c, lines, out = table(spark, sf, "conversations"), folder(spark, "lines"), None
    for part in ("conv_id % 3 < 2", "conv_id % 3 > 0"):
        memory_json(c.where(part)).write.mode("append").text(lines)
        out = jobs.memory_ingest(spark, lines, out)
    return jobs.Batches(spark, out).rows(jobs.MEMORY).select("content_hash", "text")


def _in_two(spark, sf, name, write, halves=("event_id % 3 > 0", "event_id % 3 = 0"), of=lambda stream: stream, mode="append"):
    """Runs write over the batches of a stream made of the first half of events, then over the rest, under one checkpoint; returns its batches."""
    v = table(spark, sf, "events")
    source, out = folder(spark, "events"), None
    for half in halves:
        v.where(half).write.mode("append").parquet(source)
        stream = spark.readStream.schema(v.schema).parquet(source).withColumn("ts", F.col("ts").cast("timestamp"))
        out = jobs.each_batch(of(stream), name, write, out, mode)
    return jobs.Batches(spark, out)


def _put(batch, batch_id, store):
    store.write(batch, batch_id)


@query("st7_last_samples", "SELECT event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 200")
def st7(spark, sf):
    """The rolling state after two batches, kept by key in the state store."""
    return jobs.samples_now(_in_two(spark, sf, "st7", _put, of=jobs.last_samples, mode="update"))


@query("st8_late_rows", "SELECT event_id, event_id % 3 = 0 AND ts < (SELECT max(ts) FROM events WHERE event_id % 3 > 0) - INTERVAL 2 DAY AS late FROM events")
def st8(spark, sf):
    """Main and late side after two batches."""
    return _in_two(spark, sf, "st8", jobs.split_late).rows(jobs.LATE).select("event_id", "late")


@query("st8_past_the_watermark", "WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS s, count(*) AS n FROM events WHERE event_id % 3 > 0 GROUP BY 1) SELECT strftime(s, '%Y-%m-%d %H:%M') AS start, n FROM w WHERE s + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events WHERE event_id % 3 > 0) - INTERVAL 2 HOUR")
def st8_dropped(spark, sf):
    """Hours that the watermark closed in a first run stay as they were: rows that come for them in a second are dropped."""
    v = table(spark, sf, "events")
    source, out = folder(spark, "events"), folder(spark, "st8")
    for half in (v.where("event_id % 3 > 0"), v.where("event_id % 3 = 0")):
        half.write.mode("append").parquet(source)
        stream = spark.readStream.schema(v.schema).parquet(source).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "2 hours")
        w = stream.groupBy(F.window("ts", "1 hour")).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")
        w.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start(out).awaitTermination()
    last = v.where("event_id % 3 > 0").agg((F.max(F.col("ts").cast("timestamp")) - F.expr("INTERVAL 2 HOURS")).alias("t")).first()["t"]
    rows = spark.read.schema("start timestamp, n long").parquet(out).where(F.col("start") + F.expr("INTERVAL 1 HOUR") <= F.lit(last))
    return rows.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "n")


@query("st9_time_to_live", "SELECT user_id AS key, max(ts) + INTERVAL 300 SECOND > (SELECT max(ts) FROM events) - INTERVAL 1 DAY AS live, strftime(max(ts) + INTERVAL 300 SECOND, '%Y-%m-%d %H:%M:%S') AS expires_at FROM events WHERE event_type = 'view' GROUP BY 1")
def st9(spark, sf):
    """Entries put by views, in two batches of time; the watermark, a day before the last event, is what expires them from the state."""
    v = table(spark, sf, "events")
    middle = v.agg(((F.min("event_id") + F.max("event_id")) / 2).alias("m")).first()["m"]
    at = v.where(F.col("event_id") <= F.lit(middle)).agg(F.max("ts")).first()[0]
    halves = (F.col("ts") <= F.lit(at), F.col("ts") > F.lit(at))
    entries = lambda s: jobs.cache_entries(s.withWatermark("ts", "1 day").select(F.col("user_id").alias("key"), "ts", (F.col("event_type") == "view").alias("put")), 300)
    now = jobs.entries_now(_in_two(spark, sf, "st9", _put, halves, entries, "update"))
    return now.select("key", "live", F.date_format(F.timestamp_micros("expires_at"), "yyyy-MM-dd HH:mm:ss").alias("expires_at"))
