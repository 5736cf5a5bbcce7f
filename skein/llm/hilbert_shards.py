"""Shards along a Hilbert curve, so that files can be skipped by any of several metadata dimensions.

Each dimension is quantised to 2^bits cells of equal shares of the rows; cells of all dimensions name a point of a grid, and the Hilbert curve gives the point
a place such that neighbours on the curve are neighbours in the grid. Rows are sorted by that place over all tasks and cut into runs, one run a shard, whose row
counts differ by one at most. A run covers a compact part of the grid, so its least and greatest value of each dimension rule it out for most filters.
"""

from __future__ import annotations

from os.path import commonprefix

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators import spread
from skein.sources.tables import discard, written

SHARDS, BITS, ROW_BYTES = 40, 4, 16
DIMENSIONS = ("lang", "source", "size", "doc_id")
_CODE_BYTES = 6


def steps(n: int) -> tuple[list[int], list[int]]:
    """The curve in n dimensions as a machine: for state * 2^n + the bits of a level, the next digit of the index and the next state.

    A state is the entry corner and the direction in which a cube is crossed. The cube is turned so that its curve starts at 0 along the first axis; there
    the order of corners is the reflected Gray code.
    """
    size = 1 << n
    turn = lambda x, by: (x << by % n | x >> (n - by % n)) & size - 1
    gray = [x ^ x >> 1 for x in range(size)]
    ones = lambda x: next(k for k in range(n + 1) if not x >> k & 1)  # noqa: E731  ones at the end
    digit, after = [], []
    for state in range(size * n):
        entry, axis = divmod(state, n)
        for level in range(size):
            w = gray.index(turn(level ^ entry, -(axis + 1)))
            digit.append(w)
            into = gray[2 * ((w - 1) // 2)] if w else 0
            along = 0 if w == 0 else ones(w) if w % 2 else ones(w - 1)
            after.append((entry ^ turn(into, axis + 1)) * n + (axis + along + 1) % n)
    return digit, after


def hilbert_index(cells: list[Column], bits: int = BITS) -> Column:
    """The place on the curve of a grid point; each of cells is a whole number from 0 to 2^bits - 1. A table look-up for each bit level."""
    n = len(cells)
    if not 2 <= n <= 6 or n * bits > 62:
        raise ValueError("two to six dimensions, 62 bits in all")
    digit, after = (F.array(*map(F.lit, t)) for t in steps(n))
    level = lambda k: sum((F.shiftleft(F.shiftright(c, k).bitwiseAND(F.lit(1)), j) for j, c in enumerate(cells)), F.lit(0))
    words = F.array(*(level(k).cast("int") for k in reversed(range(bits))))
    at = lambda acc, w: acc.s * (1 << n) + w + 1
    start = F.struct(F.lit(0).cast("long").alias("h"), F.lit(0).cast("int").alias("s"))
    step = lambda acc, w: F.struct((acc.h * (1 << n) + F.element_at(digit, at(acc, w))).cast("long").alias("h"), F.element_at(after, at(acc, w)).cast("int").alias("s"))
    return F.aggregate(words, start, step, lambda acc: acc.h)


def _codes(rows: DataFrame, dimensions: list[str]) -> dict[str, Column]:
    """A double for each dimension that sorts like it. Strings: six bytes after those that all values share; longer ones may share a code, and so a cell."""
    kinds = {d: rows.schema[d].dataType.simpleString() for d in dimensions}
    strings = [d for d in dimensions if kinds[d] == "string"]
    ends = rows.agg(*(f(d).alias(f"{f.__name__}_{d}") for d in strings for f in (F.min, F.max))).first() if strings else None
    out = {}
    for d in dimensions:
        if d in strings:
            same = len(commonprefix([(ends[f"{f}_{d}"] or "").encode() for f in ("min", "max")]))
            part = F.hex(F.substring(F.encode(d, "UTF-8"), same + 1, _CODE_BYTES))
            out[d] = F.conv(F.rpad(part, 2 * _CODE_BYTES, "0"), 16, 10).cast("double")
        elif kinds[d] in ("timestamp", "timestamp_ntz", "date"):
            out[d] = F.unix_micros(F.col(d).cast("timestamp")).cast("double")
        else:
            out[d] = F.col(d).cast("double")
    return out


def quantised(rows: DataFrame, dimensions: list[str], bits: int = BITS) -> tuple[DataFrame, dict[str, list[float]]]:
    """rows with _cell_d from 0 to 2^bits - 1 for each dimension d, and the cuts between cells: the values at places floor(k / 2^bits * (n - 1)), exact. Nulls are in cell 0."""
    codes = {f"_code_{d}": c for d, c in _codes(rows, dimensions).items()}
    rows = rows.withColumns(codes)  # columns of their own, so that each is made once a row
    shares = {f"c{k}": k / (1 << bits) for k in range(1, 1 << bits)}
    long = rows.select(F.inline(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(f"_code_{d}").alias("code")) for d in dimensions))))
    found = {r["dimension"]: [r[s] for s in shares] for r in spread.quantiles(long, ["dimension"], "code", shares).collect()}  # a row a dimension
    cuts = {d: found.get(d, []) for d in dimensions}
    cells = {f"_cell_{d}": sum((F.coalesce((F.col(f"_code_{d}") >= cut).cast("int"), F.lit(0)) for cut in cuts[d]), F.lit(0)) for d in dimensions}
    return rows.withColumns(cells).drop(*codes), cuts


def shards(docs: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS, count: int = SHARDS, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, curve, dimensions, carry columns) for every row of docs.

    size is the bytes of the text and 16 more; a null text has none, and the checksum of an empty one. Dimensions are columns of docs, or size. Rows are sorted by
    place on the curve, then checksum, id and dimensions, so equal texts of one grid point stand together; rows equal in all of these are alike, and any order of
    them gives the same result. Shard s holds ranks from s * n / count; counts differ by one at most, and slots have no gaps. With fewer rows than shards
    some shards are empty; an empty table gives an empty result. Only narrow rows are shuffled unless carry names texts. The tasks that sort get bounded ranges
    of rows, however many share a grid point.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    made = {"doc_id": F.col(id_col), "size": F.octet_length(text).cast("long") + ROW_BYTES, "text_crc32": F.crc32(F.encode(text, "UTF-8")).cast("long")}
    names = list(dict.fromkeys([*dimensions, *carry]))
    slim = docs.select(*(c.alias(k) for k, c in made.items()), *(F.col(n) for n in names if n not in made))
    slim = written(slim, "shard-rows")
    rows, _ = quantised(slim, list(dimensions), bits)
    cells = [f"_cell_{d}" for d in dimensions]
    rows = rows.withColumn("curve", hilbert_index([F.col(c) for c in cells], bits)).drop(*cells)
    total = slim.count()
    ranked = spread.ranked(rows, list(dict.fromkeys(["curve", "text_crc32", "doc_id", *dimensions])))
    discard(slim)
    ranked = ranked.withColumn("shard", F.expr(f"(rank * {count}L) div {max(1, total)}L").cast("int"))
    first = F.expr(f"(shard * {total}L + {count - 1}L) div {count}L")
    return ranked.withColumn("slot", F.col("rank") - first).drop("rank")


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """docs (without columns of their own named size or text_crc32) with shard and slot as Parquet, a folder a shard; each file is a run of the curve, and its footer has the least and greatest value of each dimension.

    Texts are shuffled once. The ranges of rows are written where they were sorted, so a shard of any size is made by many tasks.
    """
    shards(docs, carry=tuple(c for c in docs.columns if c != "doc_id" or options.get("id_col", "doc_id") != "doc_id"), **options).write.partitionBy("shard").parquet(path)


def manifest(stored: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """(file, shard, rows, bytes, low_d, high_d, nulls_d for each dimension) of written shards."""
    ends = [f(d).alias(f"{name}_{d}") for d in dimensions for name, f in (("low", F.min), ("high", F.max))]
    nulls = [F.count_if(F.col(d).isNull()).alias(f"nulls_{d}") for d in dimensions]
    return stored.groupBy(F.col("_metadata.file_path").alias("file"), "shard").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"), *ends, *nulls)


def may_hold(ranges: dict[str, tuple]) -> Column:
    """For a manifest: whether a file may hold a row whose dimensions all lie in the given (low, high), ends included."""
    out = F.lit(True)
    for d, (low, high) in ranges.items():
        out &= F.coalesce((F.col(f"low_{d}") <= F.lit(high)) & (F.col(f"high_{d}") >= F.lit(low)), F.lit(False))
    return out
