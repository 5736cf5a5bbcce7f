"""Text to vectors: a built-in hashing embedder, and any user function in batches."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIM, BATCH = 64, 16


def hashing(text: Column, dim: int = DIM) -> Column:
    """Counts of space-separated words by bucket of their hash, scaled to length 1; zeros for a text without words."""
    bucket = lambda w: F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long") % dim
    buckets = F.transform(F.array_remove(F.split(F.lower(text), " "), ""), bucket)
    counts = F.transform(F.array(buckets), lambda bs: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda b: F.size(F.filter(bs, lambda x: x == b)).cast("double")))
    unit = F.transform(counts, lambda v: F.transform(F.array(F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))), lambda n: F.transform(v, lambda x: F.coalesce(x / F.nullif(n, F.lit(0.0)), F.lit(0.0)))))
    return F.element_at(F.element_at(unit, 1), 1)


def embed(rows: DataFrame, embedder: Callable, text_col: str = "text", out_col: str = "embedding", dim: int | None = None, batch: int = BATCH, allow_zero: bool = False) -> DataFrame:
    """rows with a vector for each text.

    embedder is hashing, or a function of a list of at most batch texts that gives as many lists of floats; the latter runs in Arrow batches and names its dim. If it raises, so does the
    query, unless allow_zero, which puts zeros instead.
    """
    if embedder is hashing:
        return rows.withColumn(out_col, hashing(F.col(text_col), dim or DIM))
    if not dim:
        raise ValueError("a user function needs dim")
    at = rows.columns.index(text_col)
    out = rows.withColumn(out_col, F.lit(None).cast("array<double>")).schema

    def run(batches):
        for whole in batches:
            vectors = []
            for start in range(0, whole.num_rows, batch):
                texts = [t or "" for t in whole.column(at).slice(start, batch).to_pylist()]
                try:
                    got = [[float(x) for x in v] for v in embedder(texts)]
                except Exception:
                    if not allow_zero:
                        raise
                    got = [[0.0] * dim for _ in texts]
                if len(got) != len(texts) or any(len(v) != dim for v in got):
                    raise ValueError("the embedder gives one vector of dim numbers for each text")
                vectors += got
            yield pa.RecordBatch.from_arrays([*whole.columns, pa.array(vectors, pa.list_(pa.float64()))], [*whole.schema.names, out_col])

    return rows.mapInArrow(run, out)
