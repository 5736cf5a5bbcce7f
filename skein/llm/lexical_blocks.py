"""Ranked lexical search over posting lists that are cut into geometric blocks.

Documents are dealt to segments where they lie. In a segment each term's posting list is clustered by the similarity of its documents (all their weighted
terms, not this one alone), and each block keeps the coordinatewise maximum of its documents' vectors. The sum of a summary over a query's terms bounds the
score of every document of the block, so a block is skipped only if that bound stays below a score that ten documents are known to reach; all others are
opened and their documents scored exactly. A query's terms are taken in the order of their greatest parts: a document is met in the list of its first term,
so the bounds of a list's blocks sum that term and those after it, and lists of common words are mostly ruled out. The result equals an exhaustive ranking.

A summary holds each maximum in one byte, rounded up to a multiple of the term's step: a little above the maximum, never below. The known score starts
as the tenth best of a twentieth of all documents, the same share at any size, and rises with what a task finds. A segment has a bounded number of postings,
and a term's list is cut by segments, so a word that most documents hold is spread over all tasks.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from skein.llm.common import discard, texts, written

TOP = 10
#: Terms of the queries that one pass takes; a table of queries with more takes several passes over the documents.
PASS_TERMS = 8_192
SEGMENT_DOCS, SEGMENT_POSTINGS, BLOCK_DOCS = 2_048, 1 << 19, 128
#: Rows of the index are megabytes, so its files are cut.
FILE_SEGMENTS = 4
#: A block of so few documents has no summary, as its documents are no more to read than one; each term's greatest part in the segment bounds it.
BARE_DOCS = 32
#: One document in so many is scored beforehand for the first bounds.
SEED_SHARE = 20
_DIRECTIONS = 16
_LEVELS = 255
_TABLE = bytes(b if chr(b).isalnum() and b < 0x80 or b >= 0x80 else 32 for b in range(256)).lower()
_ARRAYS = {"indptr": "<i4", "terms": "<i4", "impacts": "<i8", "active": "<i4", "scale": "<i8", "lists": "<i4", "blocks": "<i4", "members": "<i4", "summaries": "u1"}


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8: runs of ASCII letters and digits and of all other characters, A-Z lower-cased. Bytes of a longer character are all above ASCII."""
    return text.lower().translate(_TABLE).split()


def impacts(weight: np.ndarray, tf: np.ndarray, n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """A term's part of a document's score, in whole numbers."""
    m = 10 + 90 * n * documents // length
    return weight * (1_000_000_000 * tf // (1_000 * tf + 8 * m))


def weights(df: dict[int, int], documents: int, terms: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df.get(t, 0) + 1))) for t in range(terms)], np.int64)


def build_segment(indptr: np.ndarray, terms: np.ndarray, values: np.ndarray, block: int = BLOCK_DOCS) -> dict[str, np.ndarray]:
    """Posting lists, their blocks and summaries for documents given as rows (indptr, terms, values); each has a term."""
    docs = len(indptr) - 1
    active, local = np.unique(terms, return_inverse=True)
    doc = np.repeat(np.arange(docs), np.diff(indptr))
    order = np.argsort(local, kind="stable")
    starts = np.searchsorted(local[order], np.arange(len(active) + 1))
    top = np.maximum.reduceat(values[order], starts[:-1])
    scale = np.maximum(1, -(-top // _LEVELS))
    levels = np.zeros((docs, len(active)), np.uint8)
    levels[doc, local] = -(-values // scale[local])
    # a few fixed random directions keep angles well enough to cluster by; bounds don't depend on them
    turn = np.random.default_rng(11).standard_normal((len(active), _DIRECTIONS), np.float32)
    seen = np.add.reduceat(values[:, None].astype(np.float32) * turn[local], indptr[:-1], axis=0)
    seen /= np.maximum(np.linalg.norm(seen, axis=1, keepdims=True), 1e-6)
    members, sizes, lists = [], [], np.zeros(len(active) + 1, np.int32)
    for t in range(len(active)):
        list_ = doc[order[starts[t] : starts[t + 1]]]
        parts = -(-len(list_) // block)
        if parts > 1:
            x = seen[list_]
            of = (x @ x[np.arange(parts) * len(list_) // parts].T).argmax(1)
            list_ = list_[np.argsort(of, kind="stable")]
            count = np.bincount(of, minlength=parts)
            sizes += count[count > 0].tolist()
        else:
            sizes.append(len(list_))
        members.append(list_)
        lists[t + 1] = len(sizes)
    members, blocks = np.concatenate(members).astype(np.int32), np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    full = np.flatnonzero(np.array(sizes) > BARE_DOCS)
    summaries = np.empty((len(full), len(active)), np.uint8)
    for row, b in enumerate(full):
        levels[members[blocks[b] : blocks[b + 1]]].max(axis=0, out=summaries[row])
    return dict(indptr=indptr, terms=local, impacts=values, active=active, scale=scale, lists=lists, blocks=blocks, members=members, summaries=summaries)


class Best:
    """The best k (score, id) of each query so far, and the score that a document needs."""

    def __init__(self, queries: int, k: int, known: dict[int, int]):
        self.k, self.found, self.need = k, [[] for _ in range(queries)], [known.get(q, 1) for q in range(queries)]

    def add(self, q: int, scores: list[int], ids: list) -> None:
        both = self.found[q] + [(s, i) for s, i in zip(scores, ids, strict=True) if s >= self.need[q]]
        both.sort(key=lambda x: (-x[0], x[1] is None, x[1]))
        self.found[q] = both[: self.k]
        if len(both) >= self.k:
            self.need[q] = max(self.need[q], self.found[q][-1][0])


class Segment:
    """A stored segment that answers queries."""

    def __init__(self, arrays: dict[str, np.ndarray], ids: list):
        self.ids, self.a = ids, arrays
        self.wanted = np.zeros(len(arrays["active"]), bool)
        self.row = np.cumsum(np.diff(arrays["blocks"]) > BARE_DOCS) - 1 if "blocks" in arrays else None
        self.opened = self.skipped = self.scored = 0

    def local(self, terms: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.a["active"], terms)
        at[at == len(self.a["active"])] = 0
        return at[self.a["active"][at] == terms]

    def score(self, terms: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Exact scores of docs for the given local terms."""
        a = self.a
        start, size = a["indptr"][docs].astype(np.int64), np.diff(a["indptr"])[docs]
        ends = np.cumsum(size)
        at = np.arange(ends[-1]) + np.repeat(start - (ends - size), size)
        self.wanted[terms] = True
        out = np.add.reduceat(a["impacts"][at] * self.wanted[a["terms"][at]], ends - size)
        self.wanted[terms] = False
        self.scored += len(docs)
        return out

    def search(self, q: int, terms: np.ndarray, best: Best) -> None:
        a, terms = self.a, self.local(terms)
        if not len(terms):
            return
        terms = terms[np.argsort(-a["scale"][terms], kind="stable")]
        per = a["lists"][terms + 1] - a["lists"][terms]
        blocks = np.concatenate([np.arange(a["lists"][t], a["lists"][t + 1]) for t in terms])
        # a document was met in the list of its first term, so in a later list only that term and those after it count
        later = np.repeat(np.arange(len(terms)), per)[:, None] <= np.arange(len(terms))
        most = np.full(later.shape, _LEVELS, np.int64)
        full = np.diff(a["blocks"])[blocks] > BARE_DOCS
        most[full] = a["summaries"][self.row[blocks[full]][:, None], terms]
        bounds = (most * later) @ a["scale"][terms]
        order = np.argsort(-bounds, kind="stable")
        blocks, bounds = blocks[order], bounds[order]
        done, at, step = np.zeros(len(self.ids), bool), 0, 1
        while at < len(blocks) and bounds[at] >= best.need[q]:  # in falling order of bounds; what is found meanwhile may rule out the rest
            some = blocks[at : at + step][bounds[at : at + step] >= best.need[q]]
            docs = np.unique(np.concatenate([a["members"][a["blocks"][b] : a["blocks"][b + 1]] for b in some]))
            docs = docs[~done[docs]]
            self.opened += len(some)
            if len(docs):
                done[docs] = True
                scores = self.score(terms, docs)
                high = np.flatnonzero(scores >= best.need[q])
                best.add(q, scores[high].tolist(), [self.ids[docs[k]] for k in high])
            at, step = at + step, 2 * step
        self.skipped += max(0, len(blocks) - at)


def forward(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs) for every row of docs (doc_id, text): its number of terms, and those of the vocabulary with their counts."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        get = shared.value.get
        for batch in batches:
            text = batch.column(1).cast(pa.large_binary())
            lengths, at, terms, tfs = [], [0], [], []
            for x in text:
                words = terms_of(x.as_py())
                counts = Counter(map(get, words))
                counts.pop(None, None)
                lengths.append(len(words))
                terms.extend(counts.keys())
                tfs.extend(counts.values())
                at.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(v, t)) for v, t in ((terms, pa.int32()), (tfs, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    return docs.mapInArrow(run, f"doc_id {id_type}, n long, terms array<int>, tfs array<long>")


def _segments(batches: Iterator, weight: np.ndarray, documents: int, length: int, most: tuple[int, int]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, indptr, terms, impacts) of at most so many documents and postings; documents without a term of the vocabulary are left out."""
    held, docs, postings = [], 0, 0

    def joined():
        ids = pa.concat_arrays([h[0] for h in held])
        return ids, np.concatenate(([0], np.cumsum(np.concatenate([h[1] for h in held])))).astype(np.int64), *(np.concatenate([h[k] for h in held]) for k in (2, 3))

    for batch in batches:
        batch = batch.filter(pc.greater(pc.list_value_length(batch.column(2)), 0))
        sizes = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False).astype(np.int64)
        terms, tfs = (batch.column(k).flatten().to_numpy() for k in (2, 3))
        n = np.repeat(batch.column(1).to_numpy(), sizes)
        values, ends, first = impacts(weight[terms], tfs, n, documents, length), np.cumsum(sizes), 0
        while first < len(sizes):
            begin = ends[first] - sizes[first]
            last = int(min(np.searchsorted(ends, begin + most[1] - postings, "right"), first + most[0] - docs))
            last = max(last, first + (not held))
            if last > first:
                held.append((batch.column(0)[first:last], sizes[first:last], terms[begin : ends[last - 1]], values[begin : ends[last - 1]]))
                docs, postings, first = docs + last - first, postings + int(ends[last - 1] - begin), last
            if first < len(sizes) or docs >= most[0]:
                yield joined()
                held, docs, postings = [], 0, 0
    if held:
        yield joined()


def index(rows: DataFrame, weight: np.ndarray, documents: int, length: int, block: int = BLOCK_DOCS, most: tuple[int, int] = (SEGMENT_DOCS, SEGMENT_POSTINGS)) -> DataFrame:
    """A row a segment: ids of its documents, and the arrays of `build_segment` as bytes. rows is the result of `forward`."""
    id_type = rows.schema["doc_id"].dataType

    def run(batches):
        for ids, indptr, terms, values in _segments(batches, weight, documents, length, most):
            made = build_segment(indptr, terms, values, block)
            cells = [pa.array([np.ascontiguousarray(made[k], t).tobytes()], pa.binary()) for k, t in _ARRAYS.items()]
            yield pa.RecordBatch.from_arrays([pa.array([ids.to_pylist()], pa.list_(ids.type)), *cells], ["ids", *_ARRAYS])

    return rows.mapInArrow(run, f"ids array<{id_type.simpleString()}>, " + ", ".join(f"{k} binary" for k in _ARRAYS))


def _read(batches: Iterator, names: list[str]) -> Iterator[Segment]:
    for batch in batches:
        for row in range(batch.num_rows):
            raw = {k: np.frombuffer(batch.column(batch.schema.get_field_index(k))[row].as_buffer(), _ARRAYS[k]) for k in names}
            if "summaries" in raw:
                raw["summaries"] = raw["summaries"].reshape(-1, len(raw["active"]))
            yield Segment(raw, batch.column(0)[row].as_py())


def search(stored: DataFrame, queries: list[np.ndarray], k: int = TOP) -> DataFrame:
    """(q, doc_id, score): the k best documents of each query, given as arrays of term ids of the index. A task sends k rows a query at most."""
    context = stored.sparkSession.sparkContext
    id_type = stored.schema["ids"].dataType.elementType
    arrow_id, shared = to_arrow_type(id_type), context.broadcast(queries)
    light = ["indptr", "terms", "impacts", "active"]
    top = Window.partitionBy("q").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())

    def told(best: Best):
        rows = [(q, i, s) for q, found in enumerate(best.found) for s, i in found]
        cols = list(zip(*rows, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], arrow_id), pa.array(cols[2], pa.int64())], ["q", "doc_id", "score"])

    def seed(batches):
        best = Best(len(shared.value), k, {})
        for segment in _read(batches, light):
            docs = np.arange(0, len(segment.ids), SEED_SHARE)
            for q, terms in enumerate(shared.value):
                if len(local := segment.local(terms)):
                    scores = segment.score(local, docs)
                    high = np.argsort(-scores, kind="stable")[:k]
                    best.add(q, scores[high].tolist(), [segment.ids[docs[j]] for j in high])
        yield told(best)

    schema = f"q int, doc_id {id_type.simpleString()}, score long"
    seeds = stored.select("ids", *light).mapInArrow(seed, schema).withColumn("_n", F.row_number().over(top)).where(F.col("_n") == k)
    known = context.broadcast({r["q"]: r["score"] for r in seeds.select("q", "score").collect()})  # a row a query of this pass

    def run(batches):
        best = Best(len(shared.value), k, known.value)
        for segment in _read(batches, list(_ARRAYS)):
            for q, terms in enumerate(shared.value):
                segment.search(q, terms, best)
        yield told(best)

    return stored.mapInArrow(run, schema).withColumn("_n", F.row_number().over(top)).where(F.col("_n") <= k).withColumnRenamed("_n", "rank")


def _passes(items: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple]]:
    """The queries (id, terms) in passes of at most PASS_TERMS different terms; a query with more has a pass alone. Rows come to the driver one partition at a time."""
    held, terms = [], set()
    for r in items.select(F.col(item_col).alias("i"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t")).toLocalIterator():
        own = set(terms_of(r["t"].encode("utf-8", "surrogatepass")))
        if held and len(terms | own) > PASS_TERMS:
            yield held
            held, terms = [], set()
        held.append((r["i"], own))
        terms |= own
    if held:
        yield held


def ranked(docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", **segments) -> DataFrame:
    """(item_id, rank, doc_id, score): for each row of items the k documents of the highest score above 0; equal scores by ascending id, null ids last.

    Statistics cover all documents. Null and empty texts have no terms and are never found; an item without terms, or an empty table on either side, gives no
    rows. Each row counts: a document row repeated under one id is ranked as often, and an item that is repeated gets its rows as often. Other columns
    may have any name. The index holds the terms that the items of a pass ask for, since no others can add to a score.
    """
    plain = texts(docs, id_col, text_col)
    spark, out = docs.sparkSession, None
    item_type = items.schema[item_col].dataType.simpleString()
    for part in _passes(items, item_col, item_text_col):
        vocabulary = {t: n for n, t in enumerate(sorted(set().union(*(own for _, own in part))))}
        rows = written(forward(plain, vocabulary), "lexical-forward")
        documents, length = rows.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
        df = {r["t"]: r["count"] for r in rows.select(F.explode("terms").alias("t")).groupBy("t").count().collect()}  # at most the terms of a pass
        stored = written(index(rows, weights(df, documents, len(vocabulary)), documents, length or 1, **segments), "lexical-index", maxRecordsPerFile=FILE_SEGMENTS)
        queries = [np.array(sorted(vocabulary[t] for t in own), np.int32) for _, own in part]
        names = spark.createDataFrame([(q, i) for q, (i, _) in enumerate(part)], f"q int, item_id {item_type}")
        found = written(search(stored, queries, k).join(names.hint("merge"), "q").select("item_id", "rank", "doc_id", "score"), "lexical-found")
        discard(rows, stored)
        out = found if out is None else out.unionByName(found)
    id_type = plain.schema["doc_id"].dataType.simpleString()
    return spark.createDataFrame([], f"item_id {item_type}, rank int, doc_id {id_type}, score long") if out is None else out
