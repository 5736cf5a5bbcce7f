"""Joins of intervals of any length by dyadic decomposition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _cut(rows: DataFrame, start: str, end: str, levels: int) -> DataFrame:
    """A row for each dyadic block (level, place) of [start, end]: at most two a level, so their number grows with the logarithm of the length."""
    rows = rows.withColumns({"_low": F.col(start).cast("long"), "_high": F.col(end).cast("long")})
    low, high = "shiftright(_low + shiftleft(1L, _k) - 1, _k)", "shiftright(_high + 1, _k)"
    blocks = F.expr(f"""flatten(transform(sequence(0, {levels}), _k -> filter(array(
        named_struct('level', _k, 'place', IF({low} & 1 = 1, {low}, NULL)), named_struct('level', _k, 'place', IF({high} & 1 = 1, {high} - 1, NULL))), _b -> {low} < {high} AND _b.place IS NOT NULL)))""")
    return rows.select("*", F.inline(blocks)).drop("_low", "_high")


def _points(rows: DataFrame, at: str, levels: int) -> DataFrame:
    """A row for the block of each level that holds the point."""
    return rows.select("*", F.inline(F.expr(f"transform(sequence(0, {levels}), _k -> named_struct('level', _k, 'place', shiftright(CAST({at} AS BIGINT), _k)))")))


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], left_span: tuple[str, str], right_span: tuple[str, str], salts: int = 4) -> DataFrame:
    """left joined to right where keys are equal and the spans (start, end), whole numbers with both ends inside, share a place; each pair once.

    Two spans overlap where one starts within the other. A span is cut into dyadic blocks, a start is looked up in the block of each level, and lies in exactly
    one block of a span that holds it: every match is a pair, none comes twice, and a span of any length has at most two blocks a level. Levels go up
    to the longest span. Starts are dealt to salts parts, to which blocks are copied, so a busy place is shared by several tasks. Spans with a null, or
    that end before they start, meet nothing. Names of other columns must differ.
    """
    (a, b), (c, d) = left_span, right_span
    left, right = left.where(f"{a} <= {b}"), right.where(f"{c} <= {d}")
    longest = left.select(F.expr(f"{b} - {a}").alias("n")).unionByName(right.select(F.expr(f"{d} - {c}").alias("n"))).agg(F.max("n")).first()[0]
    levels = int((longest or 0) + 1).bit_length()
    spread = lambda rows: rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    copied = lambda rows: rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    on = [*keys, "level", "place", "salt"]
    inside = spread(_points(left, a, levels)).join(copied(_cut(right, c, d, levels)).hint("merge"), on)
    # the other way, starts after the left one's own; those equal to it were found above
    after = left.withColumn("_from", F.col(a) + 1).where(f"_from <= {b}")
    around = copied(_cut(after, "_from", b, levels)).drop("_from").join(spread(_points(right, c, levels)).hint("merge"), on)
    return inside.unionByName(around).drop("level", "place", "salt")
