"""Text files, JSON lines, time-stamped logs and partitioned writes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from skein.functions import text
from skein.functions.text import memory_text
from skein.operators import embedding
from skein.sources.tables import exists, written


def text_corpus(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, text) of each file under path, at any depth. Bytes that are no UTF-8 are dropped, as is the sign that stands for them."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.replace(F.make_valid_utf8("value"), F.lit("\ufffd"), F.lit("")).alias("text"))


def memory_lines(spark: SparkSession, path: str) -> DataFrame:
    """(text) of each JSON line that has one; blank, malformed and scalar lines are skipped."""
    return spark.read.text(path).select(memory_text(F.col("value")).alias("text")).where("text IS NOT NULL")


def timed_log(lines: DataFrame) -> DataFrame:
    """(at, message) from lines '- <ISO time> <message>'; other lines are skipped."""
    rx = r"^- (\S+) (.*)$"
    rows = lines.select(F.try_to_timestamp(F.regexp_extract("value", rx, 1)).alias("at"), F.regexp_extract("value", rx, 2).alias("message"))
    return rows.where("at IS NOT NULL")


def write_curated(rows: DataFrame, path: str) -> None:
    """JSON lines, one directory for each language."""
    rows.write.mode("overwrite").partitionBy("language").json(path)


def write_events(events: DataFrame, path: str, time_col: str = "ts") -> None:
    """Appended by month, so that reads of a month touch its directory alone."""
    events.withColumn("month", F.date_format(time_col, "yyyy_MM")).write.mode("append").partitionBy("month").parquet(path)


def append_new(rows: DataFrame, ledger: DataFrame | None) -> DataFrame:
    """rows (text, ...) with content_hash: one for each hash that the ledger (content_hash) lacks."""
    rows = rows.withColumn("content_hash", F.sha2("text", 256)).dropDuplicates(["content_hash"])
    return rows if ledger is None else rows.join(ledger.select("content_hash").distinct(), "content_hash", "left_anti")


def append_rows(rows: DataFrame, path: str, batch_tag: str) -> int:
    """Appends rows under a batch tag and returns their number, which is counted while they are written."""
    seen = Observation("appended")
    rows.withColumn("batch_tag", F.lit(batch_tag)).observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(path)
    return seen.get["n"]


def ingest(texts: DataFrame, store: str, embedder: Callable = embedding.hashing, source: str = "docs", **more) -> int:
    """Chunks of texts (path, text) whose hash the table in folder store lacks, with their vectors, appended to it; returns their number.

    Of chunks alike the first by path and place stays. Vectors are made for new chunks alone.
    """
    spark = texts.sparkSession
    rows = texts.select("path", F.posexplode(text.chunks(F.col("text"))).alias("ordinal", "chunk")).where("chunk <> ''")
    rows = rows.groupBy(text.content_hash(F.col("chunk")).alias("content_hash")).agg(F.min(F.struct("path", "ordinal", "chunk")).alias("first")).select("content_hash", "first.*")
    if exists(spark, store):
        rows = rows.join(spark.read.parquet(store).select("content_hash").hint("merge"), "content_hash", "left_anti")
    rows = embedding.embed(rows, embedder, text_col="chunk", **more).withColumn("source", F.lit(source))
    # the table is read and appended to: what is new is settled first
    return append_rows(written(rows, "new-chunks"), store, "ingest")
