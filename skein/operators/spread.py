"""Order statistics and windows over keys that hold very many rows: rows are range-partitioned and numbered, so no task gets a whole hot key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.sources.tables import broadcastable, written

#: Rows of one block.
BLOCK = 100_000
#: Bins of one histogram.
BINS = 1_024
_ROW_BITS = 33  # Spark's row numbers hold the partition above these bits


def ranged(rows: DataFrame, order: list[str], block: int = BLOCK) -> DataFrame:
    """rows in a written table of about block rows a range, sorted over all ranges by all of order: _part numbers the range, _row the row in it from 0.

    Bounds come from Spark's range partitioner, so no cut stands in a plan and a row is compared with the logarithm of the number of ranges. Ranges part rows
    that agree in the first columns of order; only rows that agree in all of them share a range.
    """
    parts = max(1, -(-rows.count() // block))
    at = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    at = at.withColumn("_part", F.shiftright("_at", _ROW_BITS).cast("int")).withColumn("_row", F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)))
    return written(at.drop("_at"), "ranged")


def starts(at: DataFrame) -> DataFrame:
    """(_of, _before) of a table that ranged made: the number of rows before each range."""
    sizes = at.groupBy("_part").agg(F.count("*").alias("_n"))
    return sizes.select(F.col("_part").alias("_of"), (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row a range


def ranked(rows: DataFrame, order: list[str], block: int = BLOCK) -> DataFrame:
    """rows with rank, their place from 0 in the order of all rows. One count a range is summed up; a range's rows stay where they are."""
    at = ranged(rows, order, block)
    at = at.join(F.broadcast(starts(at)), F.col("_part") == F.col("_of"))
    return at.withColumn("rank", F.col("_before") + F.col("_row")).drop("_part", "_row", "_of", "_before")


def numbered(rows: DataFrame, keys: list[str], order: list[str], block: int = BLOCK) -> DataFrame:
    """rows with pos, the row number from 1 within the keys by order, and total, the key's number of rows.

    The written ranges run by key and order. For each key and range the first row and the count are kept, and the counts of the ranges before are summed up:
    a key has a row for each range that it reaches into. These rows are broadcast if they are few, and joined by sorting if not.
    """
    at = ranged(rows, [*keys, *order], block)
    sizes = at.groupBy(*keys, "_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_low"))
    w = Window.partitionBy(*keys)
    sizes = sizes.select(
        *(F.col(k).alias(f"_{k}") for k in keys), F.col("_part").alias("_of"), "_low",
        (F.sum("_n").over(w.orderBy("_part")) - F.col("_n")).alias("_before"), F.sum("_n").over(w).alias("total"),
    )
    sizes = written(sizes, "ranges")
    on = " AND ".join([f"{k} <=> _{k}" for k in keys] + ["_part = _of"])
    at = at.join(F.broadcast(sizes) if broadcastable(sizes) else sizes.hint("merge"), F.expr(on))
    return at.withColumn("pos", F.col("_before") + F.col("_row") - F.col("_low") + 1).drop("_part", "_row", "_of", "_low", "_before", *(f"_{k}" for k in keys))


def quantiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float], block: int = BLOCK) -> DataFrame:
    """(keys, a column for each of shares): the value at place floor(share * (n - 1)) of the key's n non-null values in order, from 0; exact.

    Selection by histograms. Values are first counted by sign and power of two; the bin that holds a place is then cut into BINS bins of equal width between
    its own least and greatest value, until it holds at most block rows or one value: seven rounds at most, as the values of a bin agree in ten bits more
    after each. Counting is partial in each task; only rows of the last bins are shuffled and sorted. Infinities have bins of their own and NaN comes last.
    """
    v = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    ends = v.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    places = F.array(*(F.struct(F.lit(name).alias("_share"), F.floor(F.lit(p) * (F.col("_n") - 1)).alias("_at")) for name, p in shares.items()))
    targets = written(ends.select(*keys, "_n", "_lo", "_hi", F.inline(places)), "places")
    power = 2_000 + F.floor(F.log2(F.abs("_v")))
    bin_ = F.when(F.isnan("_v"), 9_001).when(F.col("_v") == float("inf"), 9_000).when(F.col("_v") == float("-inf"), -9_000).when(F.col("_v") > 0, power).when(F.col("_v") < 0, -power).otherwise(0)
    wide = (F.col("_n") > block) & (F.col("_lo") < F.col("_hi"))
    while targets.where(wide).limit(1).count():
        bins = _within(v, targets.where(wide), keys).withColumn("_bin", bin_.cast("int"))
        bins = bins.groupBy(*keys, "_lo", "_hi", "_bin").agg(F.count("*").alias("_m"), F.min("_v").alias("_x"), F.max("_v").alias("_y"))
        before = F.sum("_m").over(Window.partitionBy(*keys, "_lo", "_hi").orderBy("_bin")) - F.col("_m")  # a row a bin
        bins = bins.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_lo").alias("_p"), F.col("_hi").alias("_q"), "_x", "_y", "_m", before.alias("_before"))
        on = " AND ".join([f"{k} <=> _{k}" for k in keys] + ["_lo = _p", "_hi = _q", "_at >= _before", "_at < _before + _m"])
        cut = targets.where(wide).join(bins.hint("merge"), F.expr(on)).select(*keys, F.col("_m").alias("_n"), F.col("_x").alias("_lo"), F.col("_y").alias("_hi"), "_share", (F.col("_at") - F.col("_before")).alias("_at"))
        targets = written(targets.where(~wide).unionByName(cut), "places")
        share = (F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2)
        bin_ = F.least(F.floor(share * BINS), F.lit(BINS - 1))
    rest = targets.where(F.col("_lo") < F.col("_hi"))
    last = _within(v, rest, keys).withColumn("_row", F.row_number().over(Window.partitionBy(*keys, "_lo", "_hi").orderBy("_v")))
    last = last.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_lo").alias("_p"), F.col("_hi").alias("_q"), "_row", "_v")
    on = " AND ".join([f"{k} <=> _{k}" for k in keys] + ["_lo = _p", "_hi = _q", "_row = _at + 1"])
    found = rest.join(last.hint("merge"), F.expr(on)).select(*keys, "_share", "_v")
    found = found.unionByName(targets.where(F.col("_lo") >= F.col("_hi")).select(*keys, "_share", F.col("_lo").alias("_v")))
    return found.groupBy(*keys).agg(*(F.max(F.when(F.col("_share") == name, F.col("_v"))).alias(name) for name in shares))


def _within(v: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """The values that lie in an interval of their key, with the interval. Intervals are broadcast if they are few, and joined by sorting if not."""
    spans = written(targets.select(*(F.col(k).alias(f"_{k}") for k in keys), "_lo", "_hi").distinct(), "spans")
    on = F.expr(" AND ".join([f"{k} <=> _{k}" for k in keys] + ["_v >= _lo", "_v <= _hi"]))
    return v.join(F.broadcast(spans) if broadcastable(spans) else spans.hint("merge"), on).drop(*(f"_{k}" for k in keys))


def framed(rows: DataFrame, keys: list[str], before: int, block: int = BLOCK) -> tuple[DataFrame, list[str], Column]:
    """(rows, keys, own) for a window over numbered rows that looks back at most before rows: each block starts with copies of the last rows of the one before.

    Partition the window by the keys given back, order it by pos, and keep the rows where own holds.
    """
    block = max(block, before)
    at = F.floor((F.col("pos") - 1) / block)
    tail = ((F.col("pos") - 1) % block >= block - before) & (F.col("pos") <= F.floor((F.col("total") - 1) / block) * block)
    rows = rows.withColumn("block", F.explode(F.when(tail, F.array(at, at + 1)).otherwise(F.array(at))))
    return rows, [*keys, "block"], F.col("block") == at


def running_sum(rows: DataFrame, keys: list[str], value: str, name: str, block: int = BLOCK) -> DataFrame:
    """numbered rows with the sum of value from the key's first row to each row: sums within blocks, and the sums of the blocks before."""
    rows = rows.withColumn("block", F.floor((F.col("pos") - 1) / block))
    sums = rows.groupBy(*keys, "block").agg(F.sum(value).alias("_s"))
    sums = sums.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("block").alias("_block"), (F.sum("_s").over(Window.partitionBy(*keys).orderBy("block")) - F.col("_s")).alias("_before"))
    rows = rows.withColumn("_in", F.sum(value).over(Window.partitionBy(*keys, "block").orderBy("pos")))
    on = " AND ".join([f"{k} <=> _{k}" for k in keys] + ["block = _block"])
    rows = rows.join(sums.hint("merge"), F.expr(on)).withColumn(name, F.col("_before") + F.col("_in"))
    return rows.drop("block", "_block", "_before", "_in", *(f"_{k}" for k in keys))
