"""Keyword search in a stored inverted index with block maxima, and its blend with vector search."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from skein.functions import scores
from skein.operators import ranking, spread
from skein.sources.tables import BROADCAST_ROWS, broadcastable, parts_of, written

#: Constants of the keyword score; impacts are whole millionths, so sums don't depend on their order.
K1, B, UNIT = 1.2, 0.75, 1_000_000
#: Documents of a range, and folders over which terms are dealt.
RANGE, BUCKETS = 32, 64
#: Bytes of text of which one task counts the words, and documents that one task scores.
TEXT, SCORED = 8 << 20, 10_000
#: Pairs of a query and a term that one pass over the documents serves.
PAIRS = 20_000


def words(text: str = "text"):
    """Space-separated words of a column, lower-cased, repeats included."""
    return F.array_remove(F.split(F.lower(text), " "), "")


def dealt(docs: DataFrame, key: str = "id") -> DataFrame:
    """docs (key, text) by key, in parts of about TEXT bytes: what is counted or ranked by document needs no further shuffle."""
    return docs.repartition(parts_of(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0, TEXT), key)


def counted(docs: DataFrame, key: str = "id") -> DataFrame:
    """(key, term, tf) of docs (key, text), by key."""
    return dealt(docs, key).select(key, F.explode(words()).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def frequent(often: DataFrame, most: int | None = None, bytes_: int = 64) -> DataFrame:
    """The terms of often (term, df) that are in the most documents: at most most (BROADCAST_ROWS), none of over bytes_ bytes, so they can be broadcast."""
    short = often.where(F.octet_length("term") <= bytes_)
    powers = sorted(short.groupBy(F.floor(F.log2("df")).cast("int").alias("power")).count().collect(), reverse=True)  # at most 64 rows
    upto = np.cumsum([r["count"] for r in powers]) <= (BROADCAST_ROWS if most is None else most)
    return short.where(F.col("df") >= F.lit(2 ** min((r["power"] for r, some in zip(powers, upto) if some), default=62)))


@dataclass
class _Asked:
    """A block of queries as the tasks get it: their ids, and the queries of[starts[t]:starts[t + 1]] of each term."""

    ids: pa.Array
    starts: np.ndarray
    of: np.ndarray

    @classmethod
    def made(cls, asked: DataFrame, terms: DataFrame) -> _Asked:
        """From asked (query_id, term) and terms (term, no), numbered from 0."""
        some = asked.join(F.broadcast(terms) if broadcastable(terms) else terms.hint("merge"), "term").select("query_id", "no").toArrow()
        ids, no = some.column("query_id").combine_chunks().dictionary_encode(), some.column("no").to_numpy()
        starts = np.concatenate(([0], np.cumsum(np.bincount(no, minlength=terms.count()))))
        return cls(ids.dictionary, starts, ids.indices.to_numpy()[np.argsort(no, kind="stable")].astype(np.int64))

    def pairs(self, no: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in no, query) for each query of each term in no."""
        many = self.starts[no + 1] - self.starts[no]
        return np.repeat(np.arange(len(no)), many), self.of[_runs(self.starts[no], many)]


def _runs(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """first, first + 1, ... as many as there are, one run after the other."""
    return np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())


class _Best:
    """The k greatest scores that one task has met so far, for each query of a block."""

    def __init__(self, asked: _Asked, k: int, digits: int):
        self.k, self.digits, self.n, self.top = k, digits, len(asked.ids), np.full((k, len(asked.ids)), -np.inf)

    def sift(self, row: np.ndarray, query: np.ndarray, part: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, score) of those among the k best, from parts of the scores of rows, in the order of their ids."""
        cell = row * self.n + query
        score = np.round(np.bincount(cell, part, rows * self.n), self.digits).reshape(rows, self.n)
        row, col = np.nonzero((np.bincount(cell, minlength=rows * self.n) > 0).reshape(rows, self.n) & (score >= self.top[-1]))
        s = score[row, col]
        order = np.lexsort((row, -s, col))
        row, col, s = row[order], col[order], s[order]
        place = np.arange(len(col)) - np.searchsorted(col, col)
        some = place < self.k
        row, col, s, place = row[some], col[some], s[some], place[some]
        hit = np.unique(col)
        mine = np.full((self.k, len(hit)), -np.inf)
        mine[place, np.searchsorted(hit, col)] = s
        self.top[:, hit] = -np.sort(-np.concatenate((self.top[:, hit], mine)), axis=0)[: self.k]
        return col, row, s


def _found(asked: _Asked, ids: np.ndarray, best: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
    who, row, score = best
    return pa.RecordBatch.from_arrays([asked.ids.take(pa.array(who)), pa.array(ids[row]), pa.array(score, pa.float64())], ["query_id", "id", "score"])


def _topmost(found: list[DataFrame], k: int) -> DataFrame:
    """The k best (query_id, id, score) of each query; ties go to the smaller id."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return reduce(DataFrame.unionByName, found).withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).drop("n")


def _numbered(asked: DataFrame) -> DataFrame:
    """(term, no) of the terms of asked, from 0."""
    return written(spread.ranked(asked.select("term").distinct(), ["term"]).select("term", F.col("rank").cast("int").alias("no")), "terms")


def _schema(queries: DataFrame, ids: DataFrame) -> StructType:
    return StructType([queries.schema["query_id"], ids.schema["id"], StructField("score", DoubleType())])


def scored(docs: DataFrame, queries: DataFrame, k: int = 10, digits: int = 4) -> DataFrame:
    """(query_id, id, score): the k best of docs (id, text) by BM25 for each of queries (query_id, text), all documents scored; ties go to the smaller id.

    A document is written with its length and its counts of the terms asked for. Tasks sum up the scores of batches of documents for a block of queries, and send
    on only pairs among the k best so far, so no document is joined to its queries.
    """
    asked = written(queries.select("query_id", F.explode(words()).alias("term")).distinct(), "asked")
    terms = _numbered(asked)
    all_words = dealt(docs).select("id", F.explode(words()).alias("term")).join(F.broadcast(terms) if broadcastable(terms) else terms.hint("merge"), "term", "left")
    each = all_words.groupBy("id", "no").agg(F.count("*").alias("tf")).groupBy("id")
    mine = lambda c: F.collect_list(F.when(F.col("no").isNotNull(), F.struct("no", "tf"))).getField(c)
    rows = written(each.agg(F.sum("tf").alias("len"), mine("no").alias("no"), mine("tf").alias("tf")), "counts")
    n, mean = rows.agg(F.count("*"), F.avg("len")).first()
    df = np.zeros(terms.count())
    held = rows.select(F.explode("no").alias("no")).groupBy("no").count().toArrow()  # a row a term
    df[held.column("no").to_numpy()] = held.column("count").to_numpy()
    schema, spark = _schema(queries, docs), docs.sparkSession

    def over(block: DataFrame) -> DataFrame:
        shared = spark.sparkContext.broadcast((_Asked.made(block, terms), np.log(1 + (n - df + 0.5) / (df + 0.5)), mean))

        def run(batches):
            asked, idf, mean = shared.value
            best = _Best(asked, k, digits)
            for whole in batches:
                for at in range(0, whole.num_rows, step := max(1, (1 << 17) // max(1, best.n))):
                    some = whole.slice(at, step).sort_by("id")
                    many = pc.list_value_length(some.column(2)).to_numpy()
                    row, no, tf = np.repeat(np.arange(len(many)), many), some.column(2).flatten().to_numpy(), some.column(3).flatten().to_numpy()
                    size = some.column(1).to_numpy()[row]
                    weight = idf[no] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean))
                    place, query = asked.pairs(no)
                    yield _found(asked, some.column(0).to_numpy(), best.sift(row[place], query, weight[place], len(many)))

        return rows.select("id", "len", "no", "tf").mapInArrow(run, schema)

    return _topmost([over(block) for block in ranking.blocks_of(asked, PAIRS)], k)


class InvertedIndex:
    """Blocks of postings in folders by bucket of the term: (bucket, term, range, top, postings array of (part, id)).

    Documents are dealt to ranges of RANGE of like length; a block holds a term's postings of one range, and top is their greatest part. A part times the term's
    weight, which a search takes from the lengths of the term's lists, is the impact. As all terms share the ranges, the sum of the impacts of a query's tops in a
    range bounds the score of each of its documents.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.buckets, self.documents = spark.read.parquet(f"{path}/about").select("buckets", "documents").first()

    @property
    def blocks(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/blocks")

    @classmethod
    def build(cls, docs: DataFrame, path: str, buckets: int = BUCKETS, size: int = RANGE) -> InvertedIndex:
        """From docs (id, text). The list of a word that all documents hold is made by many tasks, a range at a time."""
        spark = docs.sparkSession
        rows = docs.select("id", words().alias("w")).withColumn("len", F.size("w")).where("len > 0")
        rows = spread.ranked(rows, ["len", "id"], SCORED).withColumn("range", F.expr(f"rank div {size}"))
        n, mean = rows.agg(F.count("*"), F.avg("len")).first()
        parts = parts_of(int(n * (mean or 0)))
        by_range = rows.select("range", "id", "len", "w").repartition(parts, "range").sortWithinPartitions("range", "id")
        posting = StructType([StructField("part", DoubleType()), docs.schema["id"]])
        schema = StructType([StructField("term", StringType()), StructField("range", LongType()), StructField("top", DoubleType()), StructField("postings", ArrayType(posting))])
        blocks = by_range.mapInArrow(lambda batches: (_blocks(some, mean) for some in _ranges(batches, 64)), schema)
        blocks = blocks.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
        blocks = blocks.repartition(parts, "bucket", F.pmod("range", F.lit(16))).sortWithinPartitions("bucket", "term", "range")
        blocks.write.partitionBy("bucket").parquet(f"{path}/blocks")
        spark.createDataFrame([(buckets, n)], "buckets int, documents long").write.parquet(f"{path}/about")
        return cls(spark, path)

    def asked(self, queries: DataFrame) -> DataFrame:
        """(query_id, term, bucket), each once."""
        q = queries.select("query_id", F.explode(words()).alias("term")).distinct()
        return written(q.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int")), "asked")

    def _mine(self, asked: DataFrame, terms: DataFrame) -> DataFrame:
        """Blocks of terms (term, ...), those of asked; only folders of their buckets are read."""
        folders = [r["bucket"] for r in asked.select("bucket").distinct().collect()]  # at most the number of buckets
        blocks = self.blocks.where(F.col("bucket").isin(folders)).drop("bucket")
        return blocks.join(F.broadcast(terms) if broadcastable(terms) else terms.hint("merge"), "term")

    def _idf(self, df):
        return 1 + (self.documents - df + 0.5) / (df + 0.5)

    def of(self, asked: DataFrame) -> DataFrame:
        """Blocks of the terms in asked with their impacts, joined to query_id."""
        terms = written(asked.select("term").distinct(), "terms")
        often = written(self._mine(asked, terms).groupBy("term").agg(F.sum(F.size("postings")).alias("df")), "often")
        few = broadcastable(asked)
        blocks = self._mine(asked, often).join(F.broadcast(asked.drop("bucket")) if few else asked.drop("bucket").hint("merge"), "term")
        impact = lambda part: F.round(part * F.log(self._idf(F.col("df"))) * UNIT).cast("long")
        postings = F.transform("postings", lambda p: F.struct(impact(p.part).alias("impact"), p.id.alias("id")))
        return blocks.select("query_id", "term", "range", impact(F.col("top")).alias("top"), postings.alias("postings"))

    def _scores(self, mine: DataFrame, ranges: DataFrame, k: int) -> DataFrame:
        """The k best (query_id, id, impact) of the given (query_id, range), scored whole."""
        ranges = written(ranges.select("query_id", "range"), "ranges")
        rows = mine.join(F.broadcast(ranges) if broadcastable(ranges) else ranges.hint("merge"), ["query_id", "range"])
        found = rows.select("query_id", F.inline("postings")).groupBy("query_id", "id").agg(F.sum("impact").alias("impact"))
        top = Window.partitionBy("query_id").orderBy(F.desc("impact"), "id")
        return found.withColumn("n", F.row_number().over(top)).where(F.col("n") <= k)

    def opened(self, mine: DataFrame, k: int) -> DataFrame:
        """(query_id, range, bound, opens): each range that holds a term of the query, and whether it can hold one of the k best.

        The k ranges of the greatest bounds are scored; the score that k of their documents reach rules out the ranges whose bounds are below it. Postings
        of the others aren't read, as bounds need the tops alone.
        """
        bounds = written(mine.groupBy("query_id", "range").agg(F.sum("top").alias("bound")), "bounds")
        best = bounds.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "range"))).where(F.col("n") <= k)
        least = self._scores(mine, best, k).where(F.col("n") == k).select("query_id", F.col("impact").alias("least"))
        return bounds.join(least.hint("merge"), "query_id", "left").select("query_id", "range", "bound", F.coalesce(F.col("bound") >= F.col("least"), F.lit(True)).alias("opens"))

    def search(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """(query_id, id, score): the k best documents of each query (query_id, text) by BM25; ties go to the smaller id. Equal to scoring all documents.

        The blocks of the terms asked for are dealt by range, and no block is joined to its queries: a task adds up the tops of some ranges for a block of queries,
        then the postings of those blocks alone whose range can hold one of a query's k best so far.
        """
        asked = self.asked(queries)
        terms = _numbered(asked)
        mine, df = self._mine(asked, terms), np.zeros(terms.count())
        held = mine.groupBy("no").agg(F.sum(F.size("postings")).alias("df")).toArrow()  # a row a term
        df[held.column("no").to_numpy()] = held.column("df").to_numpy()
        mine = mine.select("range", "no", "top", "postings").repartition(parts_of(self.documents, SCORED), "range").sortWithinPartitions("range")
        ids = self.blocks.select(F.inline("postings"))
        found = [self._over(mine, _Asked.made(block, terms), np.log(self._idf(df)) * UNIT, k, _schema(queries, ids)) for block in ranking.blocks_of(asked, PAIRS)]
        return _topmost(found, k).withColumn("score", F.col("score") / UNIT)

    def _over(self, mine: DataFrame, asked: _Asked, unit: np.ndarray, k: int, schema: StructType) -> DataFrame:
        shared = self.spark.sparkContext.broadcast((asked, unit))

        def run(batches):
            asked, unit = shared.value
            best = _Best(asked, k, 0)
            for some in _ranges(batches, max(1, (1 << 17) // (RANGE * max(1, best.n)))):
                at = np.unique(some.column("range").to_numpy(), return_inverse=True)[1]
                no, lists = some.column("no").to_numpy(), some.column("postings").combine_chunks()
                part, id_ = (lists.flatten().field(c).to_numpy() for c in ("part", "id"))
                many = pc.list_value_length(lists).to_numpy()
                top, impact = np.floor(some.column("top").to_numpy() * unit[no] + 0.5), np.floor(part * np.repeat(unit[no], many) + 0.5)
                block, query = asked.pairs(no)
                cell = at[block] * best.n + query
                opens = np.bincount(cell, top[block])[cell] >= best.top[-1, query]
                block, query = block[opens], query[opens]
                posting, query = _runs((np.cumsum(many) - many)[block], many[block]), np.repeat(query, many[block])
                ids, row = np.unique(id_, return_inverse=True)
                yield _found(asked, ids, best.sift(row[posting], query, impact[posting], len(ids)))

        return mine.mapInArrow(run, schema)


def _blocks(some: pa.Table, mean: float) -> pa.RecordBatch:
    """(term, range, top, postings) of whole ranges of documents (range, id, len, w), in the order of their ranges."""
    ids, size, n = some.column("id").to_numpy(), some.column("len").to_numpy(), some.num_rows
    ranges, at = np.unique(some.column("range").to_numpy(), return_inverse=True)
    lists = some.column("w").combine_chunks()
    word = lists.flatten().dictionary_encode()
    cell, tf = np.unique(word.indices.to_numpy().astype(np.int64) * n + np.repeat(np.arange(n), pc.list_value_length(lists).to_numpy()), return_counts=True)
    term, doc = cell // n, cell % n
    part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[doc] / mean))
    first = np.concatenate(([0], np.flatnonzero(np.diff(term * len(ranges) + at[doc])) + 1))
    postings = pa.StructArray.from_arrays([pa.array(part), pa.array(ids[doc])], ["part", "id"])
    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(part)).astype(np.int32)), postings)
    return pa.RecordBatch.from_arrays([word.dictionary.take(pa.array(term[first])), pa.array(ranges[at[doc[first]]]), pa.array(np.maximum.reduceat(part, first)), lists], ["term", "range", "top", "postings"])


def _ranges(batches, most: int):
    """Tables of at most most whole ranges, from batches in the order of their ranges."""
    left = None
    for whole in batches:
        left = pa.Table.from_batches([whole]) if left is None else pa.concat_tables([left, pa.Table.from_batches([whole])])
        edges = np.flatnonzero(np.diff(left.column("range").to_numpy())) + 1  # the last range may go on in the next batch
        for low, high in zip([0, *edges[most - 1 :: most]], edges[most - 1 :: most]):
            yield left.slice(low, high - low)
        if len(edges) >= most:
            left = left.slice(edges[most - 1 :: most][-1])
    if left is not None and left.num_rows:
        edges = [0, *(np.flatnonzero(np.diff(left.column("range").to_numpy())) + 1), left.num_rows]
        for low in range(0, len(edges) - 1, most):
            yield left.slice(edges[low], edges[min(low + most, len(edges) - 1)] - edges[low])


def blended(keyword: DataFrame, near: DataFrame, k: int = 10, keyword_weight: float = scores.FUSION[0], vector_weight: float = scores.FUSION[1], digits: int = 6) -> DataFrame:
    """(query_id, id, keyword_score, similarity, blend, rank): the k best of the union of both searches' rows, (query_id, id, score) and (query_id, id, distance).

    Keyword scores are divided by the query's greatest; a row that one search didn't find has 0 there. Ties go to the smaller id.
    """
    best = F.max("score").over(Window.partitionBy("query_id"))
    a = keyword.select("query_id", "id", F.round(F.col("score") / F.nullif(best, F.lit(0.0)), digits).alias("keyword_score"))
    b = near.select("query_id", "id", F.round(scores.similarity(F.col("distance")), digits).alias("similarity"))
    both = a.join(b.hint("merge"), ["query_id", "id"], "full").fillna(0.0, ["keyword_score", "similarity"])
    both = both.withColumn("blend", F.round(keyword_weight * F.col("keyword_score") + vector_weight * F.col("similarity"), digits))
    both = both.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("blend"), "id")))
    return both.where(F.col("rank") <= k)
