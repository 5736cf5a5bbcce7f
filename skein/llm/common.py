"""What the operators of this package share: the shared folder, written tables, joins that split hot keys, and text columns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A key is hot if it holds over one in HOT_SHARE of the rows and over MIN_HOT, so there are never more than HOT_SHARE hot keys; rows of each are dealt to SALTS parts.
HOT_SHARE, MIN_HOT, SALTS = 200, 500, 64

_local_dir: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a local master may go without it and gets a temporary one; the session's settings stay as they are."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _local_dir.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="skein-"))


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """df written as Parquet to the shared folder and read back: lineage ends there and sizes are known. options go to the writer."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that `written` made and that nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def join_split(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """big joined to small, whose keys are unique, nulls equal; how is inner or left. No task gets all rows of a hot key.

    Hot keys are found by counts, summed up before the shuffle; there are at most HOT_SHARE of them. Their rows are dealt to
    SALTS parts, and their row of small is copied to each part. All other keys join as they are.
    """
    found = F.xxhash64(*keys)
    counts = big.groupBy(found.alias("h")).agg(F.count("*").alias("n"))
    total, most = counts.agg(F.sum("n"), F.max("n")).first()
    least = max(MIN_HOT, (total or 0) // HOT_SHARE)
    hot = [r["h"] for r in counts.where(F.col("n") > least).collect()] if (most or 0) > least else []
    small = small.select(*(F.col(k).alias(f"_{k}") for k in keys), *(c for c in small.columns if c not in keys))
    on = " AND ".join(f"{k} <=> _{k}" for k in keys)
    if hot:
        salt = F.when(found.isin(hot), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).otherwise(0)
        big = big.withColumn("_salt", salt)
        salts = F.when(F.xxhash64(*(f"_{k}" for k in keys)).isin(hot), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
        small = small.withColumn("_salted", F.explode(salts))
        on += " AND _salt = _salted"
    return big.join(small.hint("merge"), F.expr(on), how).drop(*(f"_{k}" for k in keys), "_salt", "_salted")


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(text, ASCII_UPPER, ASCII_UPPER.lower())


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) alone, so that further columns of any name can't clash; a null text counts as empty."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


#: Rows, and bytes of text, that a Python operator holds at a time; a longer text is held alone.
STEP_ROWS, STEP_BYTES = 512, 1 << 20


def slices(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most STEP_ROWS rows and STEP_BYTES bytes of the named column, one row at least."""
    column = batch.column(batch.schema.get_field_index(text))
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(ends):
        before = ends[first - 1] if first else 0
        last = min(int(np.searchsorted(ends, before + STEP_BYTES, "right")), first + STEP_ROWS)
        last = max(last, first + 1)
        yield batch.slice(first, last - first)
        first = last


def rows_of(batches: Iterator, *names: str) -> Iterator[list]:
    """For mapInArrow: the named columns as lists, in parts that are bounded by the bytes of the last one."""
    for batch in batches:
        for part in slices(batch, names[-1]):
            yield [part.column(part.schema.get_field_index(n)).to_pylist() for n in names]


def let(value: Column, f) -> Column:
    """f(value), with value made once however often f uses it, be it in a lambda over many elements."""
    return F.element_at(F.transform(F.array(value), f), 1)
