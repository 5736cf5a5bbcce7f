"""Text files that grow: a scan takes up where the one before stopped, file by file."""

from __future__ import annotations

from urllib.parse import urlparse

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.sources.tables import exists, folder, listed, written

#: Bytes of one task.
CHUNK = 16 << 20


class Tail:
    """A ledger of offsets in a folder, a version a scan: (path, stop), the end of the last whole line that was taken."""

    def __init__(self, spark: SparkSession, ledger: str):
        self.spark, self.ledger = spark, ledger

    def _version(self) -> int:
        n = 0
        while exists(self.spark, f"{self.ledger}/{n + 1}/_SUCCESS"):
            n += 1
        return n

    def pending(self, path: str) -> DataFrame:
        """(path, start, stop) of the bytes that no scan has taken, in chunks. Only names and lengths of files are looked at."""
        files = self.spark.createDataFrame([(p, n) for p, n in listed(self.spark, path)], "path string, length long")
        n = self._version()
        if n:
            files = files.join(self.spark.read.parquet(f"{self.ledger}/{n}").hint("merge"), "path", "left")
        else:
            files = files.withColumn("stop", F.lit(None).cast("long"))
        # a file that is shorter than before was written anew
        start = F.when(F.col("stop") <= F.col("length"), F.col("stop")).otherwise(0)
        files = files.select("path", F.coalesce(start, F.lit(0)).alias("from"), "length").where("from < length")
        return files.select("path", "length", F.explode(F.expr(f"sequence(from, length - 1, {CHUNK}L)")).alias("start")).select("path", "start", F.least(F.col("start") + CHUNK, F.col("length")).alias("stop"))

    def lines(self, path: str) -> tuple[DataFrame, int]:
        """(path, at, value) of whole lines that no scan before has given, and the number of bytes read; the ledger then has their ends.

        A line belongs to the chunk in which it starts. A line without an end at the end of its file waits for the next scan. The rows are written before the
        ledger, so a scan that fails is made again.
        """
        pending = written(self.pending(path), "pending").repartition(max(1, self.spark.sparkContext.defaultParallelism), "path", "start")
        rows = written(pending.mapInArrow(_read, "path string, at long, stop long, value string"), "lines")
        ends = rows.groupBy("path").agg(F.max("stop").alias("stop"))
        n = self._version()
        if n:
            ends = ends.unionByName(self.spark.read.parquet(f"{self.ledger}/{n}")).groupBy("path").agg(F.max_by("stop", "stop").alias("stop"))
        ends.write.mode("overwrite").parquet(f"{self.ledger}/{n + 1}")
        read = pending.agg(F.sum(F.col("stop") - F.col("start"))).first()[0]
        return rows.select("path", "at", "value"), read or 0


def _open(path: str):
    if urlparse(path).scheme in ("", "file"):
        return pafs.LocalFileSystem().open_input_file(urlparse(path).path)
    store, inner = pafs.FileSystem.from_uri(path)
    return store.open_input_file(inner)


def _read(batches):
    for batch in batches:
        for r in batch.to_pylist():
            with _open(r["path"]) as f:
                size, at, stop = f.size(), r["start"], r["stop"]
                if at:  # a line that began before belongs to the chunk before
                    f.seek(at - 1)
                    while (part := f.read(1 << 16)) and (k := part.find(b"\n")) < 0:
                        at += len(part)
                    at = at + k if part else size
                rows = []
                f.seek(at)
                data = f.read(max(0, stop - at))
                while data and not data.endswith(b"\n") and (part := f.read(1 << 16)):  # to the end of the last line
                    k = part.find(b"\n")
                    data += part if k < 0 else part[: k + 1]
                    if k >= 0:
                        break
                for line in data.split(b"\n")[:-1]:
                    end = at + len(line) + 1
                    rows.append((r["path"], at, end, line.removesuffix(b"\r").decode("utf-8", "ignore")))
                    at = end
            cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["path", "at", "stop", "value"])


def tail(spark: SparkSession) -> Tail:
    return Tail(spark, folder(spark, "offsets"))
