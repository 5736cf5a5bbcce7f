"""How filters overlap: five quality filters in every order, from one pass over the bytes of each text.

The pass is a finite-state transducer over UTF-8. Its table maps each byte to the next state (inside or outside a word) and to what the byte adds to the
counts: capitals, code points (bytes that don't continue one), symbols. The next state depends on the byte alone, so one table look-up runs the
machine over all bytes of many documents at once. Where the state turns to inside and back, a word's span comes out; spans go into a hash table keyed by
(document, bytes), which compares the bytes of every hit with those of the entry, so no collision of hashes can merge two words.

Conditions of failure: A few words, B few distinct words, C many capitals, D a symbol, E the text of a smaller id. A document's five outcomes are one
mask; masks are counted by part, and all orders are read off those counts.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import discard, join_split, written

FILTERS = "ABCDE"
SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#$%&*|"
#: Bytes of one step; documents beyond it take several.
STEP = 1 << 20
_WORD = np.array([b not in SPACES for b in range(256)], np.uint8)
#: What a byte adds, in fields of 21 bits: capitals, code points, symbols.
_FIELD, _FIELDS = 21, 3
_ADDS = np.array([(65 <= b <= 90) | (not 0x80 <= b < 0xC0) << _FIELD | (b in SYMBOLS) << 2 * _FIELD for b in range(256)], np.int64)
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_LONG = 64
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


class WordTable:
    """The distinct (document, word) pairs of spans over one buffer: open addressing, every hit verified byte by byte."""

    def __init__(self, data: np.ndarray, size: int = 1024):
        """data has eight bytes more than its last word needs."""
        self.data, self.eight = data, np.ndarray((max(0, len(data) - 7),), "<u8", data, strides=(1,))
        self.n, self.slots = 0, np.full(max(16, 1 << (2 * size).bit_length()), -1, np.int64)
        self.entries = [np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64)]

    def add(self, doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> None:
        size = stop - start
        head = self.eight[start] & _MASK[np.minimum(size, 8)]
        words = [doc, start, size, head, self._hashes(doc, start, size, head)]
        if 2 * (self.n + len(doc)) > len(self.slots):
            self.slots = np.full(1 << (4 * (self.n + len(doc))).bit_length(), -1, np.int64)
            old, self.entries, self.n = [e[: self.n] for e in self.entries], [e[:0] for e in self.entries], 0
            self._put(old)
        self._put(words)

    def per_document(self, documents: int) -> np.ndarray:
        return np.bincount(self.entries[0][: self.n], minlength=documents)

    def _hashes(self, doc, start, size, head):
        h = (head ^ doc.astype(np.uint64) * _M3) * _M1 ^ size.astype(np.uint64) * _M2
        more, at = np.flatnonzero((size > 8) & (size <= _LONG)), 8
        while len(more):
            h[more] = (h[more] ^ h[more] >> np.uint64(29) ^ self._part(start[more], size[more], at)) * _M1
            at += 8
            more = more[size[more] > at]
        for k in np.flatnonzero(size > _LONG):
            h[k] ^= np.uint64(xxhash.xxh64_intdigest(self.data[start[k] : start[k] + size[k]]))
        h = (h ^ h >> np.uint64(32)) * _M2
        return h ^ h >> np.uint64(29)

    def _part(self, start, size, at):
        return self.eight[start + at] & _MASK[np.minimum(size - at, 8)]

    def _same(self, x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
        """Where document, size and all bytes agree."""
        same = (x[4] == y[4]) & (x[0] == y[0]) & (x[2] == y[2]) & (x[3] == y[3])
        more, at = np.flatnonzero(same & (x[2] > 8) & (x[2] <= _LONG)), 8
        while len(more):
            same[more] = self._part(x[1][more], x[2][more], at) == self._part(y[1][more], y[2][more], at)
            at += 8
            more = more[same[more] & (x[2][more] > at)]
        for k in np.flatnonzero(same & (x[2] > _LONG)):
            same[k] = np.array_equal(self.data[x[1][k] : x[1][k] + x[2][k]], self.data[y[1][k] : y[1][k] + x[2][k]])
        return same

    def _put(self, words: list[np.ndarray]) -> None:
        mask, slots = len(self.slots) - 1, self.slots
        at, left = (words[4] & np.uint64(mask)).astype(np.int64), np.arange(len(words[0]))
        if len(self.entries[0]) < self.n + len(left):
            room = max(self.n + len(left), 2 * len(self.entries[0]))
            self.entries = [np.concatenate((e[: self.n], np.empty(room - self.n, e.dtype))) for e in self.entries]
        while len(left):
            free = left[slots[at[left]] < 0]
            if len(free):  # several may claim one slot; the claim that stays there wins
                claim = np.arange(len(free)) + self.n
                slots[at[free]] = claim
                won = free[slots[at[free]] == claim]
                for e, w in zip(self.entries, words, strict=True):
                    e[self.n : self.n + len(won)] = w[won]
                slots[at[won]] = np.arange(len(won)) + self.n
                self.n += len(won)
            there = slots[at[left]]
            left = left[~self._same([w[left] for w in words], [e[there] for e in self.entries])]
            at[left] = at[left] + 1 & mask


def _group(data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The counts of documents that lie one after the other in data, of at most a step in all."""
    out, some = np.zeros((len(sizes), 5), np.int64), np.flatnonzero(sizes)
    if not len(some):
        return out
    edges = (np.cumsum(sizes) - sizes)[some]
    inside = _WORD[data]
    before, after = np.concatenate(([0], inside[:-1])), np.concatenate((inside[1:], [0]))
    before[edges], after[edges[1:] - 1] = 0, 0  # a document's end ends its word
    start, stop = np.flatnonzero(inside > before), np.flatnonzero(inside > after) + 1
    doc = np.searchsorted(edges, start, "right") - 1
    table = WordTable(np.concatenate((data, np.zeros(8, np.uint8))), len(start))
    table.add(doc, start, stop)
    out[some, 0], out[some, 1] = np.bincount(doc, minlength=len(some)), table.per_document(len(some))
    out[some, 2:] = _fields(np.add.reduceat(_ADDS[data], edges))
    return out


def _alone(data: np.ndarray, step: int) -> np.ndarray:
    """The counts of one document of any size: steps hand on the state and the open word's start; memory follows the distinct words."""
    n, out = len(data), np.zeros(5, np.int64)
    table = WordTable(np.concatenate((data, np.zeros(8, np.uint8))))
    state, begun = 0, np.empty(0, np.int64)
    for at in range(0, n, step):
        part = data[at : at + step]
        out[2:] += _fields(_ADDS[part].sum())
        inside = _WORD[part]
        before = np.concatenate(([state], inside[:-1]))
        start, stop = np.concatenate((begun, np.flatnonzero(inside > before) + at)), np.flatnonzero(inside < before) + at
        state = int(inside[-1])
        if state and at + step >= n:
            stop = np.append(stop, n)
        begun = start[len(stop) :]
        table.add(np.zeros(len(stop), np.int64), start[: len(stop)], stop)
        out[0] += len(stop)
    out[1] = table.n
    return out


def _fields(sums: np.ndarray) -> np.ndarray:
    return np.stack([sums >> f * _FIELD & (1 << _FIELD) - 1 for f in range(_FIELDS)], -1)


def count_bytes(data: np.ndarray, ends: np.ndarray, step: int = STEP) -> np.ndarray:
    """A row (words, distinct words, capitals, code points, symbols) for each document; their bytes lie one after the other in data and end at ends."""
    sizes, rows, first = np.diff(ends, prepend=0), [np.zeros((0, 5), np.int64)], 0
    while first < len(ends):
        begin = int(ends[first] - sizes[first])
        last = int(np.searchsorted(ends, begin + step, "right"))
        if last > first:
            rows.append(_group(data[begin : ends[last - 1]], sizes[first:last]))
        else:
            last = first + 1
            rows.append(_alone(data[begin : ends[first]], step)[None])
        first = last
    return np.concatenate(rows)


def counts(docs: DataFrame, part_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, part, digest, words, distinct_words, capitals, code_points, symbols) of every row; a null text counts as empty, a null part as the empty string.

    Ids may be null or repeated, and other columns have any name. A text of any length passes in steps. digest is the SHA-256 of the text.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.sha2(text, 256).alias("digest"), text.alias("text"))
    names = ["words", "distinct_words", "capitals", "code_points", "symbols"]

    def run(batches):
        for batch in batches:
            text = batch.column(3).cast(pa.large_binary()) if batch.column(3).type != pa.large_binary() else batch.column(3)
            _, offsets, bytes_ = text.buffers()
            ends = np.frombuffer(offsets, np.int64)[text.offset : text.offset + len(text) + 1]
            data = np.frombuffer(bytes_, np.uint8)[ends[0] : ends[-1]] if bytes_ is not None else np.empty(0, np.uint8)
            got = count_bytes(data, ends[1:] - ends[0]) if len(text) else np.zeros((0, 5), np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(got[:, k]) for k in range(5))], [*batch.schema.names[:3], *names])

    id_type = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {id_type}, part string, digest string, " + ", ".join(f"{n} long" for n in names))


def failures() -> Column:
    """Filters A to D as bits 1, 2, 4, 8 of a mask over the columns of `counts`."""
    fails = ["words < 100", "100 * distinct_words < 80 * words", "100 * capitals > 10 * code_points", "symbols > 0"]
    return sum((F.when(F.expr(c), 1 << k).otherwise(0) for k, c in enumerate(fails)), F.lit(0)).cast("int")


def masks(docs: DataFrame, labels: DataFrame, part_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, mask, good, toxic, n): documents by part, outcome of the five filters (bits 1 to 16) and labels (1 if any row of labels for the id has it).

    Filter E fails a row whose text some smaller id of the table has; null texts are empty ones. A row without id has no smaller one, is none, and has no
    labels. Rows repeated under one id all count, and none of them is a smaller id of another. Equal texts are counted up before they meet, so a text that a
    third of all rows share sends a few rows a task.
    """
    rows = written(counts(docs, part_col, id_col, text_col).select("doc_id", "part", "digest", failures().alias("mask")), "audit-rows")
    marks = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(*(F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(t) for c, t in (("quality", "good"), ("toxic", "toxic"))))
    known = rows.where("doc_id IS NOT NULL").join(marks.hint("merge"), "doc_id", "left").select("doc_id", "part", "digest", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    each = known.groupBy(*known.columns).agg(F.count("*").alias("n"))
    # of each text, part and labels: all rows, and those under the least id
    least = F.min(F.struct("doc_id", "n"))
    texts = written(each.groupBy("digest", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), least["doc_id"].alias("id"), least["n"].alias("first")), "audit-texts")
    joined = join_split(texts, texts.groupBy("digest").agg(F.min("id").alias("least")), ["digest"])
    first = F.when(F.col("id") == F.col("least"), F.col("first")).otherwise(0)
    split = joined.select("part", "good", "toxic", F.inline(F.array(F.struct("mask", first.alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - first).alias("n")))))
    nameless = rows.where("doc_id IS NULL").groupBy("part", "mask").agg(F.count("*").alias("n")).select("part", F.lit(0).alias("good"), F.lit(0).alias("toxic"), "mask", "n")
    out = written(split.unionByName(nameless).where("n > 0").groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n")), "audit-masks")
    discard(rows, texts)
    return out


def audit(counted: DataFrame) -> DataFrame:
    """The report over `masks`: a row for each part, order of the filters and step.

    What a step counts depends on its filter and on the set of those before it, not on their order; so counts are made for the 80 pairs of filter and set,
    and the 600 steps of all orders look theirs up. A part has at most 128 rows of masks. An empty table has no parts and gives an empty result.
    """
    pairs = [(s, 1 << f) for f in range(len(FILTERS)) for s in range(1 << len(FILTERS)) if not s >> f & 1]
    each = counted.select("part", "mask", "good", "toxic", "n", F.inline(F.array(*(F.struct(F.lit(s).alias("before"), F.lit(b).alias("bit")) for s, b in pairs))))
    n = lambda c: F.sum(F.when(F.expr(c), F.col("n")).otherwise(0)).cast("long")
    here = "mask & bit != 0 AND mask & before = 0"
    sums = each.groupBy("part", "before", "bit").agg(
        n("mask & (bit | before) = 0").alias("kept"), n(here).alias("removed"), n("mask & bit != 0 AND mask & before != 0").alias("redundant"),
        n("mask = bit").alias("unique_fails"), n(f"{here} AND good = 1").alias("good_lost"), n(f"{here} AND toxic = 1").alias("toxic_lost"),
    )
    orders = F.lit(0)  # in so many orders exactly this set comes before the filter
    for size in range(len(FILTERS)):
        orders = F.when(F.bit_count("before") == size, factorial(size) * factorial(len(FILTERS) - 1 - size)).otherwise(orders)
    sums = written(sums.withColumn("weighted", F.col("removed") * orders), "audit-sums")
    shapley = sums.groupBy("part", "bit").agg(F.sum("weighted").alias("shapley"))
    bits = {f: 1 << k for k, f in enumerate(FILTERS)}
    steps = [("".join(o), k + 1, sum(bits[x] for x in o[:k]), bits[f]) for o in permutations(FILTERS) for k, f in enumerate(o)]
    named = counted.sparkSession.createDataFrame(steps, "filter_order string, step int, before int, bit int")  # 600 rows, whatever the input
    out = sums.drop("weighted").join(shapley.hint("merge"), ["part", "bit"]).join(F.broadcast(named), ["before", "bit"])
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
