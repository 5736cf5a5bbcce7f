"""Document fingerprints: a Merkle tree over the sections and paragraphs of a text.

A section ends with a blank line, a paragraph with a line, a leaf with a sentence; each holds its end, so every character belongs to one leaf
and equal roots mean equal texts. Leaves hash their text, every node above hashes its children's whole digests in order, and each level
hashes a tag of its own first, so that no node can pass for one of another level. Where roots differ, the sections and then the paragraphs
that differ, once those alike from both ends are set aside, tell where the edit lies. Only built-in functions run on the rows.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from skein.llm.common import let, texts

#: Where a section, a paragraph and a leaf end: empty places, so that cutting there loses no character.
SECTION = r"(?<=\n\n)(?=[^\n])"
PARAGRAPH = r"(?<=\n)(?=[^\n])"
LEAF = r"(?<=[.!?\n])(?=[^.!?\n])"
#: Digits of a branch's digest in the printed fingerprint; the root is printed whole.
DIGITS = 16
#: Characters of text in one range of ids, and the most ranges there are: beyond both, ranges grow, and a task sorts its own by spilling.
RANGE_CHARS, MAX_RANGES = 16_000_000, 100_000


def _cut(text: Column, pattern: str) -> Column:
    return F.array_remove(F.split(text, pattern, -1), "")


def _hash(tag: str, x: Column) -> Column:
    return F.sha2(F.concat(F.lit(tag), x), 256)


def tree(text: Column) -> Column:
    """Array of sections, each (digest, paragraphs), each paragraph (digest, leaves)."""
    leaves = lambda p: F.transform(_cut(p, LEAF), lambda x: _hash("leaf:", x))
    node = lambda tag, below: F.struct(_hash(tag, F.array_join(below, "")).alias("digest"), below.alias("below"))
    paragraphs = F.transform(_cut(text, SECTION), lambda s: F.transform(F.transform(_cut(s, PARAGRAPH), leaves), lambda x: node("paragraph:", x)))
    return F.transform(paragraphs, lambda ps: F.struct(_hash("section:", F.array_join(F.transform(ps, lambda p: p.digest), "")).alias("digest"), ps.alias("below")))


def fingerprint(text: Column) -> Column:
    """root/section(paragraph[leaf.leaf...]paragraph[...])/section(...): the root in full, branches by their first digits."""
    root = lambda t: _hash("root:", F.array_join(F.transform(t, lambda s: s.digest), ""))
    short = lambda x: F.substring(x, 1, DIGITS)
    paragraph = lambda p: F.concat(short(p.digest), F.lit("["), F.array_join(F.transform(p.below, short), "."), F.lit("]"))
    section = lambda s: F.concat(short(s.digest), F.lit("("), F.array_join(F.transform(s.below, paragraph), ""), F.lit(")"))
    return let(tree(text), lambda t: F.concat_ws("/", root(t), F.array_join(F.transform(t, section), "/")))


def root(fp: Column) -> Column:
    return F.substring_index(fp, "/", 1)


def _nodes(fp: Column, before: str, after: str) -> Column:
    return F.regexp_extract_all(fp, F.lit(rf"(?<={before})[0-9a-f]{{{DIGITS}}}(?={after})"), F.lit(0))


def sections(fp: Column) -> Column:
    return _nodes(fp, "/", r"\(")


def paragraphs(fp: Column) -> Column:
    return _nodes(fp, r"[(\]]", r"\[")


def leaves(fp: Column) -> Column:
    return _nodes(fp, r"[\[.]", r"[.\]]")


def likeness(a: Column, b: Column) -> Column:
    """1 for equal roots, else the Dice coefficient of the distinct leaves, from 0 to 1."""
    pair = F.struct(F.array_distinct(leaves(a)).alias("x"), F.array_distinct(leaves(b)).alias("y"))
    dice = lambda p: 2.0 * F.size(F.array_intersect(p.x, p.y)) / F.nullif(F.size(p.x) + F.size(p.y), F.lit(0))
    return F.when(root(a) == root(b), 1.0).otherwise(F.coalesce(let(pair, dice), F.lit(0.0)))


def _alike(x: Column, y: Column) -> Column:
    """How many elements are equal from the start on."""
    unlike = F.array_position(F.zip_with(x, y, lambda p, q: ~p.eqNullSafe(q)), True).cast("int")
    return F.when(unlike > 0, unlike - 1).otherwise(F.least(F.size(x), F.size(y)))


def edited(old: Column, new: Column, branches=sections) -> Column:
    """(first, last): numbers, from 0, of the first and last section of the newer fingerprint that an edit touches; null for equal roots.

    Branches alike from the start and from the end are left out, so what stands after an insertion still meets its counterpart. Where branches were only dropped, last is
    first - 1. branches=paragraphs numbers the paragraphs of the whole text.
    """

    def span(p: Column) -> Column:
        behind = F.least(_alike(F.reverse(p.x), F.reverse(p.y)), F.least(F.size(p.x), F.size(p.y)) - _alike(p.x, p.y))
        return F.struct(_alike(p.x, p.y).alias("first"), (F.size(p.y) - behind - 1).alias("last"))

    return F.when(root(old) != root(new), let(F.struct(branches(old).alias("x"), branches(new).alias("y")), span))


def _placed(docs: DataFrame, cuts: list) -> DataFrame:
    """docs with at, the number of the range that holds key, and is_least, whether key is that range's least.

    The plan holds every step-th cut, about the square root of their number; the cuts between stand in a table of a row a step, at most MAX_RANGES cuts in all, so it is broadcast.
    """
    kind = docs.schema["key"].dataType
    step = max(1, isqrt(len(cuts)))
    groups = [cuts[k : k + step] for k in range(0, len(cuts), step)]
    fine = docs.sparkSession.createDataFrame(list(enumerate(groups)), StructType([StructField("coarse", IntegerType()), StructField("cuts", ArrayType(kind))]))
    lit = lambda c: F.struct(F.lit(c[0]).cast(kind["id"].dataType).alias("id"), F.lit(c[1]).alias("h"))
    upto = lambda array: F.array_size(F.filter(array, lambda c: c <= F.col("key")))
    found = docs.withColumn("coarse", F.greatest(upto(F.array(*(lit(g[0]) for g in groups))) - 1, F.lit(0)))
    found = found.join(F.broadcast(fine), "coarse").withColumn("within", F.greatest(upto(F.col("cuts")) - 1, F.lit(0)))
    at, least = F.col("coarse") * step + F.col("within"), F.get("cuts", F.col("within")) == F.col("key")
    return found.withColumns({"at": at, "is_least": least}).drop("coarse", "cuts", "within")


def with_next(docs: DataFrame, range_chars: int = RANGE_CHARS) -> DataFrame:
    """docs (doc_id, text) with next_text, that of the following row by doc_id; after the last comes the first.

    Ids of any type that Spark orders are dealt to ranges of about range_chars characters, so ranges grow in number, not in size. Rows that share an id
    follow each other by a hash of the text, so a frequent id is split too; null ids come first. A window in each range finds the next row; the first row of each
    range is copied to the range before it. Texts are shuffled once.
    """
    key = F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"))
    docs = docs.withColumn("key", key)
    n = min(MAX_RANGES, -(-(docs.agg(F.sum(F.length("text") + 16)).first()[0] or 1) // range_chars))
    least = docs.select("key").repartitionByRange(n, "key").groupBy(F.spark_partition_id()).agg(F.min("key").alias("least"))
    cuts = [(r["least"]["id"], r["least"]["h"]) for r in least.orderBy("least").collect()]  # one for each range
    if not cuts:
        return docs.select("doc_id", "text", F.col("text").alias("next_text"))
    own = lambda at, copied: F.struct(at.cast("int").alias("range"), F.lit(copied).alias("copied"))
    placed = _placed(docs.select("doc_id", "text", "key"), cuts)
    before = F.pmod(F.col("at") - 1, F.lit(len(cuts)))
    rows = placed.select("doc_id", "text", "key", F.inline(F.when(F.col("is_least"), F.array(own(F.col("at"), 0), own(before, 1))).otherwise(F.array(own(F.col("at"), 0)))))
    w = Window.partitionBy("range").orderBy("copied", "key")
    return rows.select("copied", "doc_id", "text", F.lead("text").over(w).alias("next_text")).where("copied = 0").drop("copied")


def edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", range_chars: int = RANGE_CHARS) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, edited_sections, edited_paragraphs) for every row, the last two as told by `edited`.

    The edited text keeps the first half and takes as many characters as the other half has, or all, from the start of the next document's text. Null and empty texts are
    one empty text; a lone document follows itself; ids may be of any type that Spark orders. Repeated rows follow each other. An empty table gives an empty result.
    """
    rows = with_next(texts(docs, id_col, text_col), range_chars)
    half = F.floor(F.length("text") / 2).cast("int")
    after = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half))
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), fingerprint(F.col("text")).alias("fingerprint"), fingerprint(F.col("next_text")).alias("next_fp"), after.alias("edited"))
    rows = rows.withColumn("edited_fingerprint", fingerprint(F.col("edited")))
    own, new = F.col("fingerprint"), F.col("edited_fingerprint")
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), own, new, likeness(own, new).alias("near_edited"), likeness(own, F.col("next_fp")).alias("near_next"),
        edited(own, new).alias("edited_sections"), edited(own, new, paragraphs).alias("edited_paragraphs"),
    )
