"""SimHash near-duplicates by segment popcounts.

A 64-bit fingerprint is cut into 32 segments of two bits. The counts of set bits, one for each
segment, embed it in a grid; the Manhattan distance of two such vectors is at most their Hamming
distance. A count of 0, 1 or 2 is written in thermometer form (00, 01, 11), so that one long holds
the vector and ``bit_count(a ^ b)`` of two such longs *is* their Manhattan distance.

Range join: eight groups of four segments. Within Manhattan distance 4 at most four groups can
differ, so at least four agree and the pair meets in a cell keyed by four equal groups (70 choices).
Cells of one fingerprint drop out. What is left is joined twice: first each fingerprint with the least of its
cell, which puts nearly all near copies into components with one link each; then pairs of a cell, but only across components,
so that a cluster of n near copies sends about n links, not n squared. A cell of more than CELL_BLOCK fingerprints
is dealt to blocks whose pairs are separate keys. Conditions hold the Manhattan bound, then the exact Hamming distance.
"""

from __future__ import annotations

import uuid
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import discard, join_split, rows_of, texts, written

SHINGLE_WORDS = 4
SEED = 42
MAX_DISTANCE = 4
_GROUPS, _EQUAL = 8, 4
#: Fingerprints of one cell that are tested against each other in one key; a larger cell has a key for each pair of its blocks.
CELL_BLOCK = 1_000
#: A cell is hot if it holds more fingerprints than this and than one in HOT_SHARE; _BUCKETS are what cells are first counted by.
HOT_ROWS, HOT_SHARE, _BUCKETS = 10_000, 500, 1024
_LOW_BITS = 0x5555555555555555
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_BLOCK = 1 << 16


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprint(text: str, shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """The unsigned 64-bit fingerprint of one text; bytes.lower and bytes.split know ASCII alone, as wanted."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    n = max(1, len(words) - shingle_words + 1)
    last = ends[min(shingle_words, len(words)) - 1 :] - 1
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, _BLOCK):
        pairs = zip(starts[at : min(n, at + _BLOCK)].tolist(), last[at : at + _BLOCK].tolist(), strict=False)
        h = np.array([digest(line[a:b], seed) for a, b in pairs], np.uint64).view(np.uint8).reshape(-1, 8)
        for k in range(8):
            ones[8 * k : 8 * k + 8] += np.bincount(h[:, k], minlength=256) @ _BITS
    return sum(1 << i for i in np.flatnonzero(2 * ones > n).tolist())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long) for every row; a null or wordless text has fingerprint 0."""
    docs = texts(docs, id_col, text_col)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for ids, rows in rows_of(batches, "doc_id", "text"):
            fps = [_signed(fingerprint(t)) for t in rows]
            yield pa.RecordBatch.from_arrays([pa.array(ids, kind[0]), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    from pyspark.sql.pandas.types import to_arrow_type

    kind = [to_arrow_type(docs.schema["doc_id"].dataType)]
    return docs.mapInArrow(run, f"doc_id {id_type}, fp long")


def hex16(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def popcount_vector(fp: Column) -> Column:
    """The 32 segment counts in thermometer form, as one long."""
    low = F.lit(_LOW_BITS)
    hi, lo = F.shiftrightunsigned(fp, 1).bitwiseAND(low), fp.bitwiseAND(low)
    return hi.bitwiseOR(lo).bitwiseOR(F.shiftleft(hi.bitwiseAND(lo), 1))


def _long(x: int) -> str:
    return f"{x}L" if x > -(1 << 63) else "(-9223372036854775807L - 1L)"


def cells(fps: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(fp, v, choice, cell, n, least) of each distinct fingerprint (column fp, one row each) and cell that it shares with another: the cell's size and least fingerprint.

    Cells of over hot_rows fingerprints and one in HOT_SHARE of all, so at most HOT_SHARE for each choice of groups, are summed up before the shuffle and
    sent to their rows where these lie; a window over the others has no large group. Such cells lie in buckets as large, so only rows of those are counted by cell.
    """
    masks = [_signed(sum(0xFF << 8 * g for g in c)) for c in combinations(range(_GROUPS), _EQUAL)]
    each = fps.select("fp", popcount_vector(F.col("fp")).alias("v")).select("fp", "v", F.posexplode(F.array(*map(F.lit, masks))).alias("choice", "mask"))
    each = each.select("fp", "v", "choice", F.col("v").bitwiseAND(F.col("mask")).alias("cell"))
    hot = max(hot_rows, fps.count() // HOT_SHARE)
    each = each.withColumn("bucket", F.pmod(F.xxhash64("cell"), F.lit(_BUCKETS)).cast("int"))
    buckets = written(each.groupBy("choice", "bucket").agg(F.count("*").alias("n")).where(F.col("n") > hot).drop("n"), "simhash-buckets")
    large = each.join(F.broadcast(buckets), ["choice", "bucket"]).groupBy("choice", "cell").agg(F.count("*").alias("n"), F.min("fp").alias("least"))
    large = written(large.where(F.col("n") > hot), "simhash-hot")
    each = each.drop("bucket").join(F.broadcast(large), ["choice", "cell"], "left")
    w = Window.partitionBy("choice", "cell")
    others = each.where("n IS NULL").withColumns({"n": F.count("*").over(w), "least": F.min("fp").over(w)}).where("n > 1")
    return each.where("n IS NOT NULL").unionByName(others).select("fp", "v", "choice", "cell", "n", "least")


def stars(shared: DataFrame) -> DataFrame:
    """(a, b): links of fingerprints to the least one of a cell."""
    near = f"fp <> least AND bit_count(fp ^ least) <= {MAX_DISTANCE}"
    return shared.where(near).groupBy(F.col("least").alias("a"), F.col("fp").alias("b")).count().drop("count")


def links(shared: DataFrame, block: int = CELL_BLOCK) -> DataFrame:
    """(a, b), a <> b: each pair of fingerprints of different components (cells with a column root) at MAX_DISTANCE bits or fewer, once."""
    choices = list(combinations(range(_GROUPS), _EQUAL))
    # of the groups that agree, the first four name the cell that reports the pair
    first = {c: k for k, c in enumerate(choices)}
    report = [first.get(tuple(g for g in range(_GROUPS) if m >> g & 1)[:_EQUAL], -1) for m in range(256)]
    blocks = F.ceil(F.col("n") / F.lit(block)).cast("int")
    each = shared.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    left = each.withColumn("i", F.col("own")).withColumn("j", F.explode(F.sequence(F.col("own"), F.col("blocks") - 1)))
    right = each.withColumn("j", F.col("own")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("own"))))
    x = "(a.v ^ b.v)"
    agree = " + ".join(f"if(({x} & {_long(_signed(0xFF << 8 * g))}) = 0, {1 << g}, 0)" for g in range(_GROUPS))
    on = f"""a.choice = b.choice AND a.cell = b.cell AND a.i = b.i AND a.j = b.j AND a.root <> b.root AND (a.i < a.j OR a.fp < b.fp)
        AND bit_count({x}) <= {MAX_DISTANCE} AND bit_count(a.fp ^ b.fp) <= {MAX_DISTANCE}
        AND element_at(array({', '.join(map(str, report))}), 1 + {agree}) = a.choice"""
    return left.alias("a").join(right.alias("b").hint("merge"), F.expr(on)).selectExpr("a.fp AS a", "b.fp AS b")


def linked(fps: DataFrame, block: int = CELL_BLOCK, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(node, root): the least fingerprint that each fingerprint of fps (column fp, one row each) reaches, for those that link to another."""
    shared = written(cells(fps, hot_rows), "simhash-cells")
    near = components(stars(shared))
    of = join_split(shared, near.withColumnRenamed("node", "fp"), ["fp"], "left").withColumn("root", F.coalesce("root", "fp"))
    across = written(links(of, block), "simhash-links")
    names = near.select("node", F.col("root").alias("of"))
    # links between components join what the stars have put together
    ends = F.array("a", "b")
    nodes = across.select(F.explode(ends).alias("node")).distinct().join(names.hint("merge"), "node", "left").select("node", F.coalesce("of", "node").alias("of"))
    pairs = join_split(across, nodes.withColumnRenamed("node", "a").withColumnRenamed("of", "x"), ["a"])
    pairs = join_split(pairs, nodes.withColumnRenamed("node", "b").withColumnRenamed("of", "y"), ["b"])
    upper = components(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    every = near.select("node", "root").unionByName(nodes.where("node = of").select("node", F.col("of").alias("root"))).distinct()
    out = written(join_split(every, upper.select(F.col("node").alias("root"), F.col("root").alias("top")), ["root"], "left").select("node", F.coalesce("top", "root").alias("root")), "simhash-roots")
    discard(shared, across, near, upper)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node that each node of edges (a, b) reaches.

    Each round points every node to its least neighbour or itself, jumps once along the pointers, and contracts: edges between roots
    remain, distinct, until there are none. Their number falls by more than half a round. All is written to the shared folder and what no later
    round reads is deleted; sums are partial before every shuffle, and joins are to unique keys whose hot rows are dealt to several tasks.
    """
    edges = written(edges, "cc-edges")
    ends = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    labels = written(ends.select("node", F.col("node").alias("root")), "cc-labels")
    while edges.limit(1).count():
        least = edges.select(F.inline(F.array(F.struct(F.col("a").alias("at"), F.col("b").alias("to")), F.struct(F.col("b").alias("at"), F.col("a").alias("to")))))
        least = written(least.groupBy("at").agg(F.min("to").alias("to")).select("at", F.least("at", "to").alias("to")), "cc-least")
        ahead = least.select(F.col("at").alias("to"), F.col("to").alias("end"))
        step = written(join_split(least, ahead, ["to"]).select("at", F.col("end").alias("to")), "cc-step")
        named = join_split(labels, step.select(F.col("at").alias("root"), "to"), ["root"], "left").select("node", F.coalesce("to", "root").alias("root"))
        named = written(named, "cc-labels")
        left = join_split(edges, step.select(F.col("at").alias("a"), F.col("to").alias("x")), ["a"])
        both = join_split(left, step.select(F.col("at").alias("b"), F.col("to").alias("y")), ["b"]).where("x <> y")
        fewer = written(both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "cc-edges")
        discard(edges, labels, least, step)
        edges, labels = fewer, named
    discard(edges)
    return labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs.

    Copies meet first: links and components are sought among distinct fingerprints. Null, empty
    and wordless texts share fingerprint zero and are linked like any other. Rows repeated under one id
    give repeated rows. A component is named by its least id, and by null only if none of its rows has an id. An empty table gives an empty result.
    """
    fp = written(fingerprints(docs, id_col, text_col), "simhash-fp")
    distinct = written(fp.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "simhash-distinct")
    named = join_split(distinct, linked(distinct).withColumnRenamed("node", "fp"), ["fp"], "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of = join_split(named, least, ["root"]).select("fp", "component_id")
    return join_split(fp, of, ["fp"]).select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Exactly one row of docs from each component; columns and rows are otherwise as they are.

    It is the row of the least id; null ids come last, and of rows that share an id or have none the least hash of the text, then the least
    row number stays. Rows are numbered once, in a written copy.
    """
    number = f"row_{uuid.uuid4().hex}"
    rows = written(docs.withColumn(number, F.monotonically_increasing_id()), "simhash-rows")
    key = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text"), F.col(number).alias("row"))
    keyed = rows.select(key.alias("key"), F.col(text_col).alias("text"))
    keep = near_duplicates(keyed, "key", "text").where("doc_id.row = component_id.row").select(F.col("doc_id.row").alias(number))
    return rows.join(keep.hint("merge"), number, "left_semi").select(*(f"`{c}`" for c in docs.columns))
