"""Queries: vectors, nearest neighbours, ranking."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import SQLTransformer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import scores, vectors
from skein.operators import ann, ranking, spread
from skein.plans.base import DE, FUSED, KNN, QV, corpus_vectors, doc_embeddings, query, query_vectors, table
from skein.sources.tables import folder, known, written


def _near(spark, sf) -> DataFrame:
    """The ten nearest of each query vector, without texts."""
    return ranking.knn(corpus_vectors(spark, sf), query_vectors(spark, sf), 10)


def texts(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("chunk"))


def _cand(spark, sf) -> DataFrame:
    return ranking.with_texts(_near(spark, sf), texts(spark, sf), 10 * query_vectors(spark, sf).count())


@query("rk1_fused_ranking", FUSED + " SELECT query_id, id, rank, distance, similarity, log_length, ltr, ltr_norm, fused, left(chunk, 300) AS preview FROM fused")
def rk1(spark, sf):
    out = ranking.previews(ranking.fused(_cand(spark, sf)))
    return out.select("query_id", "id", F.col("rank").cast("long").alias("rank"), "distance", "similarity", "log_length", "ltr", "ltr_norm", "fused", "preview")


_CONCEPT = KNN + """, c AS (SELECT *, round(0.7 / (1 + distance) + 0.2 * (CASE WHEN ts IS NULL OR ts = 0 THEN 0.5 ELSE exp(-greatest(0, 1706000000.0 - ts) / 604800) END) + 0.1 * coalesce(len(list_intersect(tags, ['core', 'critical', 'schema'])) / 3.0, 0), 6) AS score FROM cand),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, distance, id) AS rank FROM c)"""


def _conceptual(spark, sf):
    c = _near(spark, sf).withColumn("score", F.round(scores.conceptual(F.col("distance"), F.col("ts"), F.col("tags"), F.lit(1706000000.0)), 6))
    return c.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "distance", "id")))


@query("so4_conceptual_order", _CONCEPT + " SELECT query_id, id, rank, score FROM r")
def so4(spark, sf):
    return _conceptual(spark, sf).select("query_id", "id", F.col("rank").cast("long").alias("rank"), "score")


@query("rk2_conceptual_pipeline", _CONCEPT + " SELECT query_id, string_agg(chunk, chr(10) ORDER BY rank) AS context FROM r GROUP BY query_id")
def rk2(spark, sf):
    return ranking.context(ranking.with_texts(_conceptual(spark, sf), texts(spark, sf)))


_TOP5 = FUSED + ", top AS (SELECT * FROM fused WHERE rank <= 5)"


@query("rk3_prompt", _TOP5 + """ SELECT query_id, 'You are Assistant. Use context to answer.' || chr(10) || 'Context:' || chr(10) || string_agg(left(chunk, 300), chr(10) || '---' || chr(10) ORDER BY rank) || chr(10) || 'Question: ' || any_value(d.text) || chr(10) || 'Answer:' AS prompt
 FROM top JOIN documents d ON d.doc_id = query_id GROUP BY query_id""")
def rk3(spark, sf):
    """The question is the text of the query's own document."""
    top = ranking.previews(ranking.fused(_cand(spark, sf)).where("rank <= 5")).withColumn("chunk", F.col("preview"))
    asked = table(spark, sf, "documents").where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.col("text").alias("question"))
    made = ranking.context(top, "\n---\n").join(asked.hint("merge"), "query_id")
    return made.select("query_id", ranking.prompt(F.col("context"), F.col("question")).alias("prompt"))


@query("rk3_chunks", _TOP5 + " SELECT query_id, id, left(chunk, 300) AS chunk, fused AS score, ltr AS ltr_score, similarity AS conceptual_score, distance FROM top")
def rk3_chunks(spark, sf):
    top = ranking.previews(ranking.fused(_cand(spark, sf)).where("rank <= 5"))
    return top.select("query_id", "id", F.col("preview").alias("chunk"), F.col("fused").alias("score"), F.col("ltr").alias("ltr_score"), F.col("similarity").alias("conceptual_score"), "distance")


@query("so1_knn_one_query", f"WITH {DE}, {QV} SELECT id, round(list_distance(embedding, query_vector), 6) AS distance FROM de, qv WHERE query_id = 0 ORDER BY 2, 1 LIMIT 10")
def so1(spark, sf):
    found = ranking.knn(corpus_vectors(spark, sf), query_vectors(spark, sf).where("query_id = 0"), 10)
    return found.select("id", "distance").orderBy("distance", "id").limit(10)


@query("so2_knn_many_queries", KNN + " SELECT query_id, id, distance FROM cand")
def so2(spark, sf):
    return _near(spark, sf).select("query_id", "id", "distance")


@query("so3_knn_memory_source", f"WITH {DE}, {QV} SELECT query_id, id, distance, round(1 - distance, 6) AS score FROM (SELECT query_id, id, round(list_distance(embedding, query_vector), 6) AS distance FROM de, qv WHERE source = 'memory') QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, id) <= 5")
def so3(spark, sf):
    c = ranking.knn(corpus_vectors(spark, sf).where("source = 'memory'"), query_vectors(spark, sf), 5)
    return c.select("query_id", "id", "distance", F.round(1 - F.col("distance"), 6).alias("score"))


@query("jn3_distance_join", f"WITH {DE}, {QV} SELECT query_id, count(*) AS n, round(sum(round(list_distance(embedding, query_vector), 6)), 3) AS total FROM de, qv GROUP BY 1")
def jn3(spark, sf):
    sums = ranking.distance_sums(corpus_vectors(spark, sf), query_vectors(spark, sf))
    return sums.select("query_id", "n", F.round("total", 3).alias("total"))


@query("sc2_cosine_distance", f"WITH {DE}, {QV} SELECT query_id, id, round(1 - list_dot_product(embedding, query_vector) / (sqrt(list_dot_product(embedding, embedding)) * sqrt(list_dot_product(query_vector, query_vector))), 5) + 0.0 AS cosine FROM de, qv QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY cosine, id) <= 10")
def sc2(spark, sf):
    d = ranking.knn(corpus_vectors(spark, sf), query_vectors(spark, sf), 10, "cosine", 5)
    return d.select("query_id", "id", (F.col("distance") + 0.0).alias("cosine"))


@query("sc25_normalised_vectors", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 5) AS norm_before, 1.0::DOUBLE AS norm_after FROM embeddings")
def sc25(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", F.round(vectors.norm(F.col("embedding")), 5).alias("norm_before"), F.round(vectors.norm(vectors.normalised(F.transform("embedding", lambda x: x * 3))), 5).alias("norm_after"))


@query("sc24_dimension_check", "SELECT len(embedding) AS dim, count(*) AS n, CAST(count(*) FILTER (len(embedding) <> 64) AS BIGINT) AS rejected FROM embeddings GROUP BY 1")
def sc24(spark, sf):
    return table(spark, sf, "embeddings").groupBy(F.size("embedding").cast("long").alias("dim")).agg(F.count("*").alias("n"), F.count_if(F.size("embedding") != 64).alias("rejected"))


@query("ag9_vector_probe", "SELECT round(avg(embedding[1]::DOUBLE), 6) AS mean_first FROM embeddings")
def ag9(spark, sf):
    return table(spark, sf, "embeddings").agg(F.round(F.avg(F.element_at("embedding", 1).cast("double")), 6).alias("mean_first"))


@query("sc8_fusion_weights", "SELECT event_id % 7 AS a, event_id % 5 AS b, round(max(CASE WHEN event_id % 7 + event_id % 5 <= 0 THEN 0.5 ELSE (event_id % 7) / (event_id % 7 + event_id % 5)::DOUBLE END), 6) AS w_ltr, count(*) AS n FROM events GROUP BY 1, 2")
def sc8(spark, sf):
    v = table(spark, sf, "events").select((F.col("event_id") % 7).alias("a"), (F.col("event_id") % 5).alias("b"))
    w, _ = scores.fusion_weights(F.col("a"), F.col("b"))
    return v.groupBy("a", "b").agg(F.round(F.max(w), 6).alias("w_ltr"), F.count("*").alias("n"))


@query("sc8_weight_versions", "WITH u AS (SELECT event_id, event_id % 7 - 1 AS a, event_id % 5 AS b FROM events WHERE event_type = 'click' AND event_id % 7 >= 1) SELECT row_number() OVER (ORDER BY event_id) AS version, round(CASE WHEN a + b <= 0 THEN 0.5 ELSE a / (a + b)::DOUBLE END, 6) AS w_ltr FROM u")
def sc8_versions(spark, sf):
    """Updates of the weights in order of time, negative ones rejected; each that is accepted is one version more."""
    v = table(spark, sf, "events").where("event_type = 'click'").select(F.lit(1).alias("table"), "event_id", (F.col("event_id") % 7 - 1).alias("a"), (F.col("event_id") % 5).alias("b")).where("a >= 0 AND b >= 0")
    w, _ = scores.fusion_weights(F.col("a"), F.col("b"))
    return spread.numbered(v, ["table"], ["event_id"]).select(F.col("pos").alias("version"), F.round(w, 6).alias("w_ltr"))


@query("so6_sorted_by_column", FUSED + " SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(log_length, 0) DESC, id) AS place FROM fused")
def so6(spark, sf):
    w = Window.partitionBy("query_id").orderBy(F.coalesce("log_length", F.lit(0.0)).desc(), "id")
    return ranking.fused(_cand(spark, sf)).select("query_id", "id", F.row_number().over(w).cast("long").alias("place"))


@query("se1_memory_and_documents", KNN + """, m AS (SELECT query_id, id, distance FROM pairs WHERE source = 'memory' QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, id) <= 5),
 d AS (SELECT query_id, id, distance FROM pairs WHERE source = 'docs' QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, id) <= 5)
 SELECT * FROM (SELECT * FROM m UNION ALL SELECT * FROM d) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, id) <= 5""")
def se1(spark, sf):
    de, q = corpus_vectors(spark, sf), query_vectors(spark, sf)
    both = ranking.knn(de.where("source = 'memory'"), q, 5).unionByName(ranking.knn(de.where("source = 'docs'"), q, 5))
    w = Window.partitionBy("query_id").orderBy("distance", "id")
    return both.withColumn("n", F.row_number().over(w)).where("n <= 5").select("query_id", "id", "distance")


@query("jn11_stored_features", FUSED + ", g AS (SELECT *, round(0.3 * ltr_norm + 0.7 * similarity, 6) AS refused FROM fused) SELECT query_id, id, refused, row_number() OVER (PARTITION BY query_id ORDER BY refused DESC, distance, id) AS rank FROM g")
def jn11(spark, sf):
    """Features and distances are stored once; new weights read them, without a search."""
    stored = written(ranking.fused(_cand(spark, sf)).select("query_id", "id", "distance", "similarity", "log_length", "ltr", "ltr_norm"), "features")
    again = stored.withColumn("refused", F.round(0.3 * F.col("ltr_norm") + 0.7 * F.col("similarity"), 6))
    w = Window.partitionBy("query_id").orderBy(F.desc("refused"), "distance", "id")
    return again.select("query_id", "id", "refused", F.row_number().over(w).cast("long").alias("rank"))


@query("wn6_embedding_drift", f"WITH {DE}, l AS (SELECT label, id, embedding, lag(embedding) OVER (PARTITION BY label ORDER BY id) AS prev FROM de) SELECT label, id, round(1 - list_dot_product(embedding, prev) / (sqrt(list_dot_product(embedding, embedding)) * sqrt(list_dot_product(prev, prev))), 5) + 0.0 AS drift FROM l WHERE prev IS NOT NULL")
def wn6(spark, sf):
    rows = spread.numbered(corpus_vectors(spark, sf).select("label", "id", "embedding"), ["label"], ["id"])
    rows, keys, own = spread.framed(rows, ["label"], 1)
    d = rows.withColumn("prev", F.lag("embedding").over(Window.partitionBy(*keys).orderBy("pos"))).where(own & F.col("prev").isNotNull())
    return d.select("label", "id", (F.round(vectors.cosine_distance(F.col("embedding"), F.col("prev")), 5) + 0.0).alias("drift"))


def _index(spark, sf) -> ann.Index:
    return ann.Index.build(corpus_vectors(spark, sf), folder(spark, "lists"))


@query("an1_inverted_lists_all_probed", KNN + " SELECT query_id, id, distance FROM cand")
def an1(spark, sf):
    return _index(spark, sf).knn(query_vectors(spark, sf), 10).select("query_id", "id", "distance")


@query("an1_stored_lists", "SELECT count(*) AS n, count(DISTINCT vec_id) AS ids, CAST(floor(sqrt(count(*))) AS BIGINT) AS lists FROM embeddings JOIN documents ON vec_id = doc_id")
def an1_stored(spark, sf):
    """Every vector is in exactly one of about sqrt(rows) lists."""
    index = _index(spark, sf)
    return index.vectors.agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids")).withColumn("lists", F.lit(index.lists).cast("long"))


def _probed(spark, sf) -> tuple[DataFrame, DataFrame]:
    index, q = _index(spark, sf), query_vectors(spark, sf)
    exact = written(ranking.knn(corpus_vectors(spark, sf), q, 10).select("query_id", "id", "distance"), "exact")
    return index.knn(q, 10, index.calibrated(q, exact)), exact


@query("an1_probed")
def an1_probed(spark, sf):
    """Neighbours from as few lists as give a mean recall of 0.9 on the query set."""
    return _probed(spark, sf)[0].select("query_id", "id", "distance")


@query("an2_random_projections")
def an2(spark, sf):
    """Neighbours by codes, with as few exact comparisons as give a mean recall of 0.9."""
    return _coded(spark, sf)[0].select("query_id", "id", "distance")


def _signs(spark, sf) -> ann.SignIndex:
    """Codes of the vectors whose ids are documents'. Ids without one are told first: where they are few, no vector is shuffled to leave them out."""
    e, d = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), table(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    return ann.SignIndex.build(known(e, d, "id"))


def _coded(spark, sf) -> tuple[DataFrame, DataFrame, int]:
    q, index = query_vectors(spark, sf), _signs(spark, sf)
    exact = written(index.exact(q, 10).select("query_id", "id", "distance"), "exact")
    candidates = index.calibrated(q, exact)
    return index.knn(q, 10, None, candidates), exact, candidates


@query("an2_all_compared", KNN + " SELECT query_id, id, distance FROM cand")
def an2_all(spark, sf):
    """With every code a candidate the second ranking is exact."""
    index = _signs(spark, sf)
    return index.knn(query_vectors(spark, sf), 10, None, index.rows)


@query("an1_two_appends", KNN + " SELECT query_id, id, distance FROM cand")
def an1_appended(spark, sf):
    """An index built on a third of the vectors, with the rest appended in two steps, split and compacted: with all lists probed it is exact."""
    c = corpus_vectors(spark, sf)
    index = ann.Index.build(c.where("id % 3 = 0"), folder(spark, "lists"))
    index = index.append(c.where("id % 3 = 1")).append(c.where("id % 3 = 2")).compacted()
    return index.knn(query_vectors(spark, sf), 10).select("query_id", "id", "distance")


@query("an1_cosine", f"WITH {DE}, {QV}, p AS (SELECT query_id, id, round(1 - list_dot_product(embedding, query_vector) / (sqrt(list_dot_product(embedding, embedding)) * sqrt(list_dot_product(query_vector, query_vector))), 6) + 0.0 AS distance FROM de, qv) SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, id) <= 10")
def an1_cosine(spark, sf):
    """Lists of unit vectors under cosine distance, all probed."""
    index = ann.Index.build(corpus_vectors(spark, sf), folder(spark, "lists"), metric="cosine")
    return index.knn(query_vectors(spark, sf), 10).select("query_id", "id", (F.col("distance") + 0.0).alias("distance"))


@query("an3_recall")
def an3(spark, sf):
    """Recall of each query with the calibrated number of probes; tests hold the mean at 0.9 or more."""
    found, exact = _probed(spark, sf)
    return ann.recall(found, exact, 10)


@query("an3_recall_all_probed", f"WITH {DE}, {QV} SELECT query_id, 1.0::DOUBLE AS recall FROM qv")
def an3_all(spark, sf):
    q = query_vectors(spark, sf)
    return ann.recall(_index(spark, sf).knn(q, 10), ranking.knn(corpus_vectors(spark, sf), q, 10), 10)


@query("ud3_retrieval_modes", KNN + " SELECT mode, query_id, id, distance FROM cand, (SELECT unnest(['exact', 'lists']) AS mode)")
def ud3(spark, sf):
    c, q = corpus_vectors(spark, sf), query_vectors(spark, sf)
    modes = {"exact": None, "lists": _index(spark, sf)}
    return reduce(DataFrame.unionByName, [ann.retrieve(m, c, q, 10, i).select(F.lit(m).alias("mode"), "query_id", "id", "distance") for m, i in modes.items()])


_SCORED = KNN + """, f1 AS (SELECT *, round(1 / (1 + distance), 6) AS similarity, round(ln(greatest(length(chunk), 1)), 6) AS log_length FROM cand),
 s AS (SELECT *, scorer, round(CASE scorer WHEN 'weights' THEN 0.5 * similarity + 0.25 * log_length WHEN 'function' THEN similarity * similarity ELSE 2 * similarity + 0.1 * log_length END, 6) AS ltr FROM f1, (SELECT unnest(['weights', 'function', 'model']) AS scorer)),
 n AS (SELECT *, round(CASE WHEN max(ltr) OVER w - min(ltr) OVER w <= 1e-9 THEN 0.5 ELSE (ltr - min(ltr) OVER w) / (max(ltr) OVER w - min(ltr) OVER w) END, 6) AS ltr_norm FROM s WINDOW w AS (PARTITION BY scorer, query_id))
 SELECT scorer, query_id, id, ltr, round(0.6 * ltr_norm + 0.4 * similarity, 6) AS fused FROM n"""


@query("ud2_scorers", _SCORED)
def ud2(spark, sf):
    """The same candidates under a list of weights, a function and a fitted model's transformer."""
    c = _cand(spark, sf)
    model = SQLTransformer(statement="SELECT *, 2 * similarity + 0.1D * log_length AS prediction FROM __THIS__")
    made = {"weights": [0.5, 0.25], "function": lambda rows: rows["similarity"] * rows["similarity"], "model": model}
    return reduce(DataFrame.unionByName, [ranking.fused(c, scorer=x).select(F.lit(n).alias("scorer"), "query_id", "id", "ltr", "fused") for n, x in made.items()])


@query("pl2_diverse")
def pl2(spark, sf):
    """Five of the ten nearest of each query by maximal marginal relevance, ids of one tag blocked; tests hold it against a plain loop."""
    c = corpus_vectors(spark, sf)
    found = _near(spark, sf).select("query_id", "id", scores.similarity(F.col("distance")).alias("score"))
    return ranking.diverse(ranking.with_texts(found, c.select("id", "embedding")), 5, block=c.where(F.array_contains("tags", "schema")))
