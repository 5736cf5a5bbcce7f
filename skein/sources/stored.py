"""Stored tables that change: a base in folders, deltas by update, and rewriting of touched folders alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.sources.tables import exists, names, remove, written

BUCKETS = 32


def overwrite_folders(rows: DataFrame, path: str, *partitions: str) -> None:
    """Writes rows over the folders that they fall in; all other folders and their files stay. rows is settled first, as it may come from path itself."""
    rows = written(rows, "touched")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


class Stored:
    """A table by key in path/base (folders by bucket of the key) and path/delta (a folder an update).

    how names the rule for each other column when rows of one key meet: last (of the greatest seq) or sum. An update that runs again under its number writes over
    its own delta. Readers merge base and deltas; `compact` does so for the buckets that deltas touch and leaves the files of the others alone.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, how: dict[str, str], buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.how, self.buckets = spark, path, key, how, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _merged(self, rows: DataFrame) -> DataFrame:
        last = [c for c, h in self.how.items() if h == "last"]
        aggs = [F.max_by(F.struct(*last), "seq").alias("_last")] if last else []
        aggs += [F.sum(c).alias(c) for c, h in self.how.items() if h == "sum"]
        out = rows.groupBy("bucket", self.key).agg(F.max("seq").alias("seq"), *aggs)
        return out.select("bucket", self.key, "seq", *(F.col(f"_last.{c}").alias(c) for c in last), *(c for c, h in self.how.items() if h == "sum"))

    def update(self, rows: DataFrame, number: int) -> None:
        """rows (key, seq, columns of how) as delta number; rows of one key in it are merged before they are written."""
        rows = rows.select(self._bucket().alias("bucket"), self.key, "seq", *self.how)
        self._merged(rows).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/delta/{number}")

    def _read(self, folder: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{folder}")

    def _deltas(self) -> list[str]:
        return [f"delta/{n}" for n in names(self.spark, f"{self.path}/delta") if exists(self.spark, f"{self.path}/delta/{n}/_SUCCESS")]

    def _all(self) -> DataFrame:
        parts = [self._read(f) for f in (["base"] if exists(self.spark, f"{self.path}/base") else []) + self._deltas()]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def rows(self) -> DataFrame:
        return self._merged(self._all()).drop("bucket")

    def compact(self) -> list[int]:
        """Merges deltas into the base; returns the buckets that were written. Deltas go once the base has them. A sum that is cut off between the two must be compacted from a copy; last values may run again."""
        deltas = self._deltas()
        touched = sorted({r["bucket"] for d in deltas for r in self._read(d).select("bucket").distinct().collect()})  # at most the number of buckets
        if touched:
            overwrite_folders(self._merged(self._all().where(F.col("bucket").isin(touched))), f"{self.path}/base", "bucket")
        for d in deltas:
            remove(self.spark, f"{self.path}/{d}")
        return touched


def drop_older(spark: SparkSession, path: str, time_col: str, day_col: str, oldest) -> tuple[int, int]:
    """Deletes rows with a time before oldest from a table in folders by day: whole folders go unread, the folder of that day alone is written again. Returns the folders deleted and written."""
    day = oldest.strftime("%Y-%m-%d")
    days = [n.split("=", 1)[1] for n in names(spark, path) if n.startswith(f"{day_col}=")]
    stale = [d for d in days if d < day]
    torn = day in days and spark.read.parquet(path).where((F.col(day_col) == day) & (F.col(time_col) < F.lit(oldest))).limit(1).count() > 0
    if torn:
        kept = written(spark.read.parquet(path).where((F.col(day_col) == day) & (F.col(time_col) >= F.lit(oldest))), "kept")
        if kept.limit(1).count():
            overwrite_folders(kept, path, day_col)
        else:
            remove(spark, f"{path}/{day_col}={day}")
    for d in stale:
        remove(spark, f"{path}/{day_col}={d}")
    return len(stale), int(torn)
