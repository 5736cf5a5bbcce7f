"""Places of regular-expression matches with built-in functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def spaces(s: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))


def pieces(text: Column, pattern: Column, size) -> Column:
    """For each match in order: size of the text since the match before, size of the match, the match. size maps a string to its length in the unit that is wanted."""
    found, between = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, pattern, -1)
    # both arrays are made once; in a lambda over one of them the other would be made anew for each match
    both = F.zip_with(found, between, lambda m, b: F.struct(size(b).alias("gap"), size(m).alias("size"), m.alias("match")))
    return F.filter(both, lambda x: x.match.isNotNull())


def placed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows (keys, ord, gap, size, ...) with start and stop: sums along ord within the keys. A row that occurs twice counts once."""
    w = Window.partitionBy(*keys).orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.dropDuplicates([*keys, "ord"]).withColumn("stop", F.sum(F.col("gap") + F.col("size")).over(w).cast("long"))
    return rows.withColumn("start", F.col("stop") - F.col("size"))
