"""The shared folder, and tables that are written there between steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local_dir: dict[str, str] = {}


def folder(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir. Only a local master may go without that setting and gets a temporary folder; the session's settings stay as they are."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _local_dir.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="skein-"))
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back: computed once, its size known to the planner."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def bytes_of(table: DataFrame) -> int:
    """Bytes of the files of a table that `written` made."""
    fs, p = _path(table.sparkSession, table.written_to)
    return fs.getContentSummary(p).getLength()


#: A written table is broadcast only within both bounds.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20


def broadcastable(table: DataFrame) -> bool:
    return bytes_of(table) <= BROADCAST_BYTES and table.count() <= BROADCAST_ROWS


def known(rows: DataFrame, among: DataFrame, key: str) -> DataFrame:
    """rows whose key is in among (key). Keys that are not are written; within the bounds of a broadcast they are left out where the rows lie, so wide rows aren't shuffled."""
    keys = rows.select(key).where(F.col(key).isNotNull())
    gone = written(keys.join(among.select(key).distinct().hint("merge"), key, "left_anti").distinct(), "gone")
    if broadcastable(gone):
        return rows.where(F.col(key).isNotNull()).join(F.broadcast(gone), key, "left_anti")
    discard(gone)
    return rows.join(among.select(key).distinct().hint("merge"), key, "left_semi")


#: Rows that one task sorts or groups, where a number of parts is given because the session's would let them grow with the table.
TASK_ROWS = 500_000


def parts_of(rows: int, task: int = TASK_ROWS) -> int:
    """Parts of at most about task rows."""
    return max(1, -(-rows // task))


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _path(spark, path)
    fs.delete(p, True)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that `written` made and that nothing reads any more."""
    for t in tables:
        remove(t.sparkSession, t.written_to)


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of what is in a folder; none if there is no such folder."""
    fs, p = _path(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []


def touch(spark: SparkSession, path: str) -> None:
    """Makes an empty file."""
    fs, p = _path(spark, path)
    fs.create(p, True).close()


def listed(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(path, length) of the files right in a folder, without those that Spark hides."""
    fs, p = _path(spark, path)
    files = [f for f in fs.listStatus(p) if f.isFile()] if fs.exists(p) else []
    return [(f.getPath().toString(), f.getLen()) for f in files if f.getPath().getName()[0] not in "._"]
