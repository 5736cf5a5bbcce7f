"""Structured Streaming forms of the incremental jobs. Each runs what is there and stops."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from skein.functions.text import content_hash, memory_text
from skein.sources.tables import folder, names, touch


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events.parquet as a stream with a time stamp that watermarks accept."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", False).parquet(sf_dir)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def to_table(stream: DataFrame, name: str) -> DataFrame:
    """Runs an append-mode stream to a Parquet folder and returns what it wrote."""
    spark, out = stream.sparkSession, folder(stream.sparkSession, name)
    stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


class Batches:
    """A folder of batches, each written by its id and then committed: a batch that runs again replaces its own output, and readers see committed batches alone."""

    def __init__(self, spark: SparkSession, out: str):
        self.spark, self.out = spark, out

    @property
    def last(self) -> int:
        """The id of the last committed batch, -1 before the first; ids follow one another."""
        ids = names(self.spark, f"{self.out}/commits")
        return max((int(n) for n in ids if n.isdigit()), default=-1)

    def write(self, rows: DataFrame, batch_id: int, *partitions: str) -> None:
        rows.write.mode("overwrite").partitionBy(*partitions).parquet(f"{self.out}/data/batch={batch_id}")

    def commit(self, batch_id: int) -> None:
        touch(self.spark, f"{self.out}/commits/{batch_id}")

    def before(self, batch_id: int, schema: str) -> DataFrame:
        """Rows, with their batch, of the committed batches before this one: a batch that runs again doesn't see what it left."""
        last = min(self.last, batch_id - 1)
        if last < 0:
            return self.spark.createDataFrame([], f"{schema}, batch long")
        return self.spark.read.schema(f"{schema}, batch long").parquet(f"{self.out}/data").where(F.col("batch") <= last)

    def rows(self, schema: str) -> DataFrame:
        return self.before(1 << 60, schema)


def each_batch(stream: DataFrame, name: str, write: Callable[[DataFrame, int, Batches], None], out: str | None = None, mode: str = "append") -> str:
    """Runs write(batch, id, batches) on each batch and commits it; returns the folder. With the folder of an earlier run it goes on where that one stopped."""
    out = out or folder(stream.sparkSession, name)
    store = Batches(stream.sparkSession, out)

    def run(batch: DataFrame, batch_id: int) -> None:
        write(batch, batch_id, store)
        store.commit(batch_id)

    stream.writeStream.foreachBatch(run).outputMode(mode).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return out


MEMORY = "content_hash string, text string"


def add_memory(batch: DataFrame, batch_id: int, store: Batches) -> None:
    """Texts of JSON lines with their hashes; a hash that an earlier batch has is left out."""
    rows = batch.select(memory_text(F.col("value")).alias("text")).where("text IS NOT NULL")
    fresh = rows.groupBy(content_hash(F.col("text")).alias("content_hash")).agg(F.first("text").alias("text"))
    store.write(fresh.join(store.before(batch_id, MEMORY).select("content_hash").hint("merge"), "content_hash", "left_anti"), batch_id)


def memory_ingest(spark: SparkSession, lines: str, out: str | None = None) -> str:
    """Texts of JSON lines in a folder, appended with their hashes; a hash that the table has is left out, across batches, replays and restarts."""
    return each_batch(spark.readStream.text(lines), "memory", add_memory, out)


ENGAGEMENT = "user_id long, v long, c long"


def add_engagement(batch: DataFrame, batch_id: int, store: Batches) -> None:
    """Partial counts of a batch; the refresh sums them, so no batch reads the history."""
    n = lambda k: F.count_if(F.col("event_type") == k)
    store.write(batch.groupBy("user_id").agg(n("view").alias("v"), n("click").alias("c")), batch_id)


LATE = "event_id long, ts timestamp, late boolean"


def split_late(batch: DataFrame, batch_id: int, store: Batches, delay: str = "2 days") -> None:
    """Rows of a batch that are older than the greatest time of all earlier batches less the delay go to the late side, the rest to the main one."""
    greatest = store.before(batch_id, LATE).agg(F.max("ts")).first()[0]
    late = F.lit(False) if greatest is None else F.coalesce(F.col("ts") < F.lit(greatest) - F.expr(f"INTERVAL {delay}"), F.lit(False))
    store.write(batch.select("event_id", "ts", late.alias("late")), batch_id)


SAMPLES = "event_type string, part int, at long, event_id long, value double"
#: Parts of a key's state, so that the rows of a hot key go to several tasks.
PARTS = 8


def last_samples(events: DataFrame, n: int = 200) -> DataFrame:
    """A stream of the last n samples of each event type, as keyed state: each part of a key keeps its n, and gives them out whenever they change."""

    def keep(key, frames, state):
        held = list(zip(*state.get, strict=True)) if state.exists else []
        for f in frames:
            held = sorted(held + list(zip(f["at"].tolist(), f["event_id"].tolist(), f["value"].tolist(), strict=True)))[-n:]
        state.update(tuple(map(list, zip(*held, strict=True))))
        at, ids, values = state.get
        yield pd.DataFrame({"event_type": key[0], "part": key[1], "at": at, "event_id": ids, "value": values})

    rows = events.select("event_type", F.pmod(F.xxhash64("event_id"), F.lit(PARTS)).cast("int").alias("part"), F.unix_micros("ts").alias("at"), "event_id", "value")
    return rows.groupBy("event_type", "part").applyInPandasWithState(keep, SAMPLES, "at array<long>, ids array<long>, values array<double>", "update", GroupStateTimeout.NoTimeout)


def samples_now(store: Batches, n: int = 200) -> DataFrame:
    """The last n samples of each event type, from what each part gave out last."""
    rows = store.rows(SAMPLES)
    last = rows.groupBy("event_type", "part").agg(F.max("batch").alias("batch"))
    rows = rows.join(last.hint("merge"), ["event_type", "part", "batch"])
    w = Window.partitionBy("event_type").orderBy(F.desc("at"), F.desc("event_id"))
    return rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= n).select("event_type", "event_id", "value")


ENTRIES = "key long, expires_at long, live boolean"
#: Groups over which keys are dealt. The entries of a group share a row of the state and a timer, so Python is called once a group and batch, not once a key.
GROUPS = 1_024


def cache_entries(puts: DataFrame, seconds: int) -> DataFrame:
    """A stream of changes of cache entries, from rows (key, ts, put) with a watermark: an entry's state is when it expires, set by its last put, and a timer.

    A group's timer is that of its entry that expires first. Once the watermark is past it the entry is given out as not live and leaves the state, so the
    state holds live entries alone.
    """

    def change(key, frames, state):
        held, changed = dict(zip(*state.get, strict=True)) if state.exists else {}, {}
        for f in () if state.hasTimedOut else frames:
            for k, at in f.groupby("key")["at"].max().items():
                changed[k] = max(int(at) + seconds * 1_000_000, changed.get(k, held.get(k, int(at))))
        held |= changed
        left = {int(k): at for k, at in held.items() if at // 1000 > state.getCurrentWatermarkMs()}
        if left:
            state.update((list(left), list(left.values())))
            state.setTimeoutTimestamp(min(left.values()) // 1000 - 1)  # it fires once the watermark is past it
        elif state.exists:
            state.remove()
        given = [k for k in held if k in changed or k not in left]
        yield pd.DataFrame({"key": [k if key[0] >= 0 else None for k in given], "expires_at": [held[k] for k in given], "live": [k in left for k in given]})

    # The condition names ts, so it stays above the watermark, which follows all rows.
    rows = puts.select("key", "ts", F.when(F.col("put"), F.unix_micros("ts")).alias("at")).where("at IS NOT NULL")
    group = F.when(F.col("key").isNull(), -1).otherwise(F.pmod(F.xxhash64("key"), F.lit(GROUPS))).cast("int")
    rows = rows.select(group.alias("part"), F.coalesce("key", F.lit(0)).alias("key"), "ts", "at")
    return rows.groupBy("part").applyInPandasWithState(change, ENTRIES, "keys array<long>, expires array<long>", "update", GroupStateTimeout.EventTimeTimeout)


def entries_now(store: Batches) -> DataFrame:
    """The last state of each entry that was ever put."""
    return store.rows(ENTRIES).groupBy("key").agg(F.max_by(F.struct("expires_at", "live"), "batch").alias("last")).select("key", "last.expires_at", "last.live")
