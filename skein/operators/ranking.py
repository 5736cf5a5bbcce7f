"""Nearest neighbours and fused ranking for a table of queries."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Transformer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from skein.functions import scores, text
from skein.sources.tables import BROADCAST_ROWS, broadcastable, written

Scorer = list[float] | Callable[[DataFrame], Column] | Transformer

#: Queries that one broadcast may hold; more are taken in several passes over the corpus.
QUERY_BLOCK = 2_000
#: Probed lists that a plan names, so that other folders go unread; rows of more are told apart in the tasks.
LISTS_NAMED = 1_000
EPS = 1e-9


def check_k(k: int | None, default: int = 10, most: int = 200) -> int:
    k = default if k is None else k
    if not 1 <= k <= most:
        raise ValueError(f"k must be from 1 to {most}")
    return k


def blocks_of(queries: DataFrame, rows: int | None = None) -> list[DataFrame]:
    """queries in parts of about rows (QUERY_BLOCK) rows, those of a query together."""
    blocks = max(1, -(-queries.count() // (rows or QUERY_BLOCK)))
    return [queries] if blocks == 1 else [queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b) for b in range(blocks)]


def knn(corpus: DataFrame, queries: DataFrame, k: int = 10, metric: str = "l2", digits: int = 6, probes: Callable[[np.ndarray], dict[int, np.ndarray]] | None = None) -> DataFrame:
    """(query_id, distance, corpus columns): the k nearest corpus rows (id, embedding, ...) of each query (query_id, query_vector).

    The corpus is scanned where it lies, in Arrow batches; slices of them are multiplied with a block of queries, and only pairs that are among the k nearest so far
    of their task go on. Ranks are cut to k in each partition again before the one shuffle that all blocks share: a shuffle for each block would have Spark put the
    blocks together in a single task. Ties go to the smaller id; rows without a vector, or with one of another length, are no neighbours. probes gives, for the
    vectors of a block of queries, the queries of each list_id; rows of other lists are no neighbours.
    """
    if metric not in ("l2", "cosine"):
        raise ValueError("metric is l2 or cosine")
    top = Window.partitionBy("query_id").orderBy("distance", "id")
    found = reduce(DataFrame.unionByName, [_near(corpus, some, k, metric, digits, probes) for some in blocks_of(queries)])
    return found.withColumn("_n", F.row_number().over(top)).where(F.col("_n") <= k).drop("_n")


#: Distances that a task holds at a time.
_CELLS = 1 << 20


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.where((n := np.linalg.norm(x, axis=1, keepdims=True)) > 0, n, np.nan)


class Nearest:
    """The k least distances that one task has met so far, for each query of a block."""

    #: Pairs that are compared one by one at a time, where few of a batch are asked for.
    PAIRS = 1 << 14

    def __init__(self, q: np.ndarray, k: int, metric: str, digits: int):
        self.k, self.cosine, self.digits = k, metric == "cosine", digits
        self.q = unit(q) if self.cosine else q
        self.size, self.best = np.zeros(len(q)) if self.cosine else (q * q).sum(1), np.full((k, len(q)), np.inf)

    def _order(self, x: np.ndarray, y: np.ndarray, among: np.ndarray | None) -> np.ndarray:
        """What orders rows by their distance from a query: the cosine distance, or the square of the distance without the query's own; infinite for pairs not asked for."""
        if among is not None and among.mean() < 1 / 8:
            g, (row, col) = np.full(among.shape, np.inf), np.nonzero(among)
            for at in range(0, len(row), self.PAIRS):
                r, c = row[at : at + self.PAIRS], col[at : at + self.PAIRS]
                g[r, c] = np.einsum("ij,ij->i", x[r], y[c])
            g *= -1 if self.cosine else -2
            g[~among] = np.inf
        else:
            g = x @ ((-1 if self.cosine else -2) * y.T)
            if among is not None:
                g[~among] = np.inf
        g += 1 if self.cosine else (x * x).sum(1)[:, None]
        return g

    def sift(self, x: np.ndarray, who: np.ndarray | None = None, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, distance) of the pairs of rows x, in the order of their ids, with the queries who (all) that may be among the k nearest; among marks the pairs that count."""
        who = np.arange(len(self.q)) if who is None else who
        size, least = self.size[who], self.best[-1, who]
        far = lambda g, s: g if self.cosine else np.sqrt(np.maximum(g + s, 0))
        g, bound = self._order(unit(x) if self.cosine else x, self.q[who], among), least
        if np.isinf(least).any():
            g[np.isnan(g)] = np.inf
            bound = np.minimum(least, far(np.partition(g, (n := min(self.k, len(g)) - 1), axis=0)[n], size))
        bound = bound + 10.0**-self.digits
        row, col = np.nonzero(g <= (bound if self.cosine else bound * bound - size))
        d = np.round(far(g[row, col], size[col]), self.digits)
        some = np.isfinite(d) & (d <= least[col])
        row, col, d = row[some], col[some], d[some]
        order = np.lexsort((row, d, col))
        row, col, d = row[order], col[order], d[order]
        place = np.arange(len(col)) - np.searchsorted(col, col)
        some = place < self.k
        row, col, d, place = row[some], col[some], d[some], place[some]
        hit = np.unique(col)
        mine = np.full((self.k, len(hit)), np.inf)
        mine[place, np.searchsorted(hit, col)] = d
        self.best[:, who[hit]] = np.sort(np.concatenate((self.best[:, who[hit]], mine)), axis=0)[: self.k]
        return who[col], row, d


def parts(whole: pa.RecordBatch, dim: int, by: str | None, width):
    """(key, rows, vectors) from an Arrow batch with an embedding: rows with a vector of length dim by key and id, in slices of at most _CELLS cells with width(key) queries."""
    at = whole.schema.get_field_index
    whole = whole.filter(pc.fill_null(pc.equal(pc.list_value_length(whole.column(at("embedding"))), dim), False))
    whole = whole.sort_by([(c, "ascending") for c in ([by] if by else []) + ["id"]])
    keys = whole.column(at(by)).to_numpy() if by else np.zeros(whole.num_rows, np.int64)
    edges = [0, *(np.flatnonzero(np.diff(keys)) + 1), len(keys)] if len(keys) else [0]
    for low, high in zip(edges, edges[1:]):
        if wide := width(keys[low]):
            for start in range(low, high, step := max(1, _CELLS // wide)):
                rows = whole.slice(start, min(step, high - start))
                yield keys[low], rows, rows.column(at("embedding")).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)


def asked(queries: DataFrame, *more: str) -> pa.Table:
    """A block of queries with a vector."""
    return queries.select("query_id", "query_vector", *more).where("query_vector IS NOT NULL").toArrow()


def matrix(some: pa.Table) -> np.ndarray:
    return np.stack(some.column("query_vector").to_numpy()).astype(float)


def _near(corpus: DataFrame, queries: DataFrame, k: int, metric: str, digits: int, probes: Callable[[np.ndarray], dict[int, np.ndarray]] | None = None) -> DataFrame:
    """Candidates of a block of queries: of all rows, or, if probes gives the queries of each list_id, of the rows of their lists."""
    some = asked(queries)
    spark, columns = corpus.sparkSession, [c for c in corpus.columns if c not in ("embedding", *(("list_id",) if probes else ()))]
    schema = StructType([queries.schema["query_id"], StructField("distance", DoubleType()), *(corpus.schema[c] for c in columns)])
    if not some.num_rows:
        return spark.createDataFrame([], schema)
    q = matrix(some)
    lists = probes and probes(q)
    if lists and len(lists) <= LISTS_NAMED:
        corpus = corpus.where(F.col("list_id").isin(list(lists)))
    shared = spark.sparkContext.broadcast((some.column("query_id").combine_chunks(), q, lists))

    def run(batches):
        ids, q, lists = shared.value
        near, width = Nearest(q, k, metric, digits), lambda key: len(q) if lists is None else len(lists.get(key, ()))
        for whole in batches:
            for key, rows, x in parts(whole, q.shape[1], None if lists is None else "list_id", width):
                who, row, d = near.sift(x, None if lists is None else lists[key])
                if len(who):
                    rows = rows.take(pa.array(row))
                    cells = [rows.column(rows.schema.get_field_index(c)) for c in columns]
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(who)), pa.array(d, pa.float64()), *cells], ["query_id", "distance", *columns])

    return corpus.mapInArrow(run, schema)


def distance_sums(corpus: DataFrame, queries: DataFrame, metric: str = "l2", digits: int = 6) -> DataFrame:
    """(query_id, n, total): the number of corpus rows (embedding, ...) and the sum of their rounded distances from each query (query_id, query_vector).

    A task multiplies its batches with a block of queries and sends a row a query; all blocks share one shuffle. Rows without a vector, or with one of another
    length, count without a distance.
    """
    sums = reduce(DataFrame.unionByName, [_sums(corpus.select("embedding"), block, metric, digits) for block in blocks_of(queries)])
    return sums.groupBy("query_id").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def _sums(corpus: DataFrame, queries: DataFrame, metric: str, digits: int) -> DataFrame:
    """What each task adds up for a block of queries."""
    some, spark = queries.select("query_id", "query_vector").toArrow(), corpus.sparkSession
    schema = StructType([queries.schema["query_id"], StructField("n", LongType()), StructField("total", DoubleType())])
    if not some.num_rows:
        return spark.createDataFrame([], schema)
    vector = some.column("query_vector").to_pylist()
    dim = max((len(v) for v in vector if v is not None), default=0)
    q = np.array([v if v is not None and len(v) == dim and None not in v else [np.nan] * dim for v in vector], float).reshape(len(vector), dim)
    shared = spark.sparkContext.broadcast((some.column("query_id").combine_chunks(), q))

    def run(batches):
        ids, q = shared.value
        gone, y = np.isnan(q).any(1), unit(q) if metric == "cosine" else q
        size, seen, used, total = (y * y).sum(1), 0, 0, np.zeros(len(q))
        for whole in batches:
            seen += whole.num_rows
            v = whole.column(0)
            v = v.filter(pc.fill_null(pc.equal(pc.list_value_length(v), q.shape[1]), False))
            for at in range(0, len(v), step := max(1, _CELLS // len(q))):
                flat = v.slice(at, step).flatten()
                x = flat.to_numpy(zero_copy_only=False).astype(float).reshape(-1, q.shape[1])
                if flat.null_count:
                    x = x[~pc.is_null(flat).to_numpy(zero_copy_only=False).reshape(x.shape).any(1)]
                if metric == "cosine":
                    x = unit(x)
                    d = 1 - (x[~np.isnan(x).any(1)]) @ y.T
                else:
                    d = x @ (-2 * y.T)
                    d += (x * x).sum(1)[:, None]
                    d += size
                    np.sqrt(np.maximum(d, 0, out=d), out=d)
                used += len(d)
                total += np.round(d, digits, out=d).sum(0)
        if seen:
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.full(len(q), seen)), pa.array(total, pa.float64(), mask=gone | (used == 0))], ["query_id", "n", "total"])

    return corpus.mapInArrow(run, schema)


def with_texts(candidates: DataFrame, texts: DataFrame, most: int | None = None) -> DataFrame:
    """candidates (id, ...) with the columns of texts (id, ...), after the top-k.

    most is a number of rows that candidates are known not to exceed: within the bound of a broadcast they go to the texts as they are. Otherwise they are
    written and counted, and broadcast or joined by sorting.
    """
    if most is not None and most <= BROADCAST_ROWS:
        return texts.join(F.broadcast(candidates), "id")
    found = written(candidates, "candidates")
    return texts.join(F.broadcast(found) if broadcastable(found) else found.hint("merge"), "id")


def fused(candidates: DataFrame, ltr_weight: float = scores.FUSION[0], concept_weight: float = scores.FUSION[1], digits: int = 6, scorer: Scorer | None = None) -> DataFrame:
    """candidates (query_id, id, chunk, distance) with similarity, ltr, ltr_norm, fused and rank; ties by distance, then id.

    scorer makes ltr: nothing for the sum of the features, a list of weights, a function of a frame with the features that gives a column, or a pyspark.ml
    transformer that adds a column prediction.
    """
    if ltr_weight < 0 or concept_weight < 0:
        raise ValueError("weights are not negative")
    total = ltr_weight + concept_weight
    a, b = (ltr_weight / total, concept_weight / total) if total > 0 else (0.5, 0.5)
    c = candidates.withColumn("similarity", F.round(scores.similarity(F.col("distance")), digits)).withColumn("log_length", F.round(scores.log_length(F.col("chunk")), digits))
    if isinstance(scorer, Transformer):
        c = scorer.transform(c).withColumn("ltr", F.round("prediction", digits)).drop("prediction")
    else:
        made = scorer(c) if callable(scorer) else scores.linear([F.col("similarity"), F.col("log_length"), F.lit(1.0)], scorer)
        c = c.withColumn("ltr", F.round(made, digits))
    w = Window.partitionBy("query_id")
    lo, hi = F.min("ltr").over(w), F.max("ltr").over(w)
    c = c.withColumn("ltr_norm", F.round(F.when(hi - lo <= EPS, 0.5).otherwise((F.col("ltr") - lo) / (hi - lo)), digits))
    c = c.withColumn("fused", F.round(a * F.col("ltr_norm") + b * F.col("similarity"), digits))
    return c.withColumn("rank", F.row_number().over(w.orderBy(F.desc("fused"), "distance", "id")))


def diverse(candidates: DataFrame, k: int = 5, balance: float = 0.7, allow: DataFrame | None = None, block: DataFrame | None = None) -> DataFrame:
    """(query_id, id, rank): k candidates (query_id, id, score, embedding) of each query by maximal marginal relevance.

    Each step takes the candidate of the greatest balance * score - (1 - balance) * its greatest cosine with those taken; ties go to the smaller id. A query has
    at most the candidates that a top-k left it, so its group is small. allow and block are tables of ids (id).
    """
    if allow is not None:
        candidates = candidates.join(allow.select("id").distinct().hint("merge"), "id", "left_semi")
    if block is not None:
        candidates = candidates.join(block.select("id").distinct().hint("merge"), "id", "left_anti")

    def pick(group):
        group = group.sort_values("id")
        x = np.stack(group["embedding"].to_numpy()).astype(float)
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        score, near, taken = group["score"].to_numpy(float), np.zeros(len(group)), []
        for _ in range(min(k, len(group))):
            gain = np.round(balance * score - (1 - balance) * near, 9)
            gain[taken] = -np.inf
            taken.append(int(gain.argmax()))
            cosine = x @ x[taken[-1]]
            near = cosine if len(taken) == 1 else np.maximum(near, cosine)
        return pd.DataFrame({"query_id": group["query_id"].iloc[taken].to_numpy(), "id": group["id"].iloc[taken].to_numpy(), "rank": np.arange(1, len(taken) + 1)})

    return candidates.select("query_id", "id", "score", "embedding").groupBy("query_id").applyInPandas(pick, "query_id long, id long, rank long")


def context(ranked: DataFrame, separator: str = "\n") -> DataFrame:
    """(query_id, context): chunks of each query in rank order; a query has at most k of them."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "chunk")))
    return ranked.groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda x: x.chunk), separator).alias("context"))


def previews(ranked: DataFrame, n: int = 300) -> DataFrame:
    return ranked.withColumn("preview", text.preview(F.col("chunk"), n))


def prompt(context: Column, question: Column, assistant: str = "Assistant") -> Column:
    """The text for a model: preamble, context, question; the assistant's name is a parameter."""
    return F.concat(F.lit(f"You are {assistant}. Use context to answer.\nContext:\n"), context, F.lit("\nQuestion: "), question, F.lit("\nAnswer:"))
