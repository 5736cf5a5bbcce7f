"""Queries: feature vectors, keyword search, ranking metrics, enrichment, and rows for sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import scores, text, vectors
from skein.operators import curation, embedding, keyword, ranking
from skein.operators.keyword import K1, B
from skein.plans.base import DE, IX, KNN, QUERIES, corpus_vectors, doc_embeddings, interactions, query, query_vectors, sql, table
from skein.plans.corpus import SCORED, _scored, test_config
from skein.plans.retrieval import texts
from skein.sources import files
from skein.sources.tables import broadcastable, folder, parts_of, written

_SPACE = r"^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$"
_WORDS = "list_filter(string_split(lower(text), ' '), lambda x: x <> '')"


def terms(docs: DataFrame, *keep: str) -> DataFrame:
    """(*keep, term) of each space-separated word, lower-cased, repeats included."""
    return docs.select(*keep, F.explode(F.array_remove(F.split(F.lower("text"), " "), "")).alias("term"))


def _candidates(spark, sf):
    return QUERIES["so2_knn_many_queries"](spark, sf)


@query("sc6_feature_vector", KNN + ", f AS (SELECT query_id, id, round(1 / (1 + distance), 6) AS similarity_primary, round(1 - distance, 6) AS score, round(ln(greatest(length(chunk), 1)), 6) AS log_length, 1.0::DOUBLE AS bias FROM cand) SELECT *, 'bias,log_length,similarity_primary' AS names FROM f")
def sc6(spark, sf):
    chunks = texts(spark, sf)
    length = F.round(F.log(F.greatest(F.length("chunk"), F.lit(1))), 6)
    near = F.round(scores.similarity(F.col("distance")), 6)
    return ranking.with_texts(_candidates(spark, sf), chunks).select("query_id", "id", scores.named_features(near, length).alias("features"), F.round(1 - F.col("distance"), 6).alias("score")).select(
        "query_id", "id", "score", *(F.element_at("features", n).alias(n) for n in scores.FEATURES), F.array_join(F.array_sort(F.map_keys("features")), ",").alias("names")
    )


@query("sc6b_legacy_vector", KNN + " SELECT query_id, id, 1.0::DOUBLE AS bias, round(1 / (1 + distance), 6) AS similarity, round(ln(greatest(length(chunk), 1)), 6) AS text_length, round(ln(greatest(length(d.text), 1)), 6) AS query_length FROM cand JOIN documents d ON d.doc_id = query_id")
def sc6b(spark, sf):
    length = lambda c: F.round(F.log(F.greatest(F.length(c), F.lit(1))), 6)
    asked = table(spark, sf, "documents").select(F.col("doc_id").alias("query_id"), length("text").alias("query_length"))
    chunks = texts(spark, sf).select("id", length("chunk").alias("text_length"))
    near = F.round(scores.similarity(F.col("distance")), 6)
    return ranking.with_texts(_candidates(spark, sf), chunks).join(asked.hint("merge"), "query_id").select("query_id", "id", F.lit(1.0).alias("bias"), near.alias("similarity"), "text_length", "query_length")


@query("sc11_recency_and_tags", f"WITH {DE}, t AS (SELECT id, CASE WHEN id % 7 = 0 THEN NULL ELSE ts END AS ts, tags FROM de) SELECT id, round(CASE WHEN ts IS NULL OR ts = 0 THEN 0.5 ELSE exp(-greatest(0, 1704672000 - ts) / 604800) END, 6) AS recency, round(coalesce(len(list_intersect(tags, ['core', 'critical', 'schema'])), 0) / 3.0::DOUBLE, 6) AS boost FROM t")
def sc11(spark, sf):
    rows = doc_embeddings(spark, sf).withColumn("ts", F.when(F.col("id") % 7 != 0, F.col("ts")))
    return rows.select("id", F.round(scores.recency(F.col("ts"), F.lit(1704672000.0)), 6).alias("recency"), F.round(scores.tag_boost(F.col("tags")), 6).alias("boost"))


@query("sc16_stripped", f"SELECT doc_id, t FROM (SELECT doc_id, regexp_replace(replace(text, chr(13), ''), '{_SPACE}', '', 'g') AS t FROM documents) WHERE t <> ''")
def sc16(spark, sf):
    stripped = text.strip(F.replace(F.col("text"), F.lit("\r"), F.lit("")))
    return table(spark, sf, "documents").select("doc_id", stripped.alias("t")).where("t <> ''")


sql("sc18_keyword_matches", "SELECT doc_id, CAST(contains(lower(text), 'the') AS INT) + CAST(contains(lower(text), 'que') AS INT) + CAST(contains(lower(text), 'der') AS INT) AS hits FROM documents")
sql("sc23_month", "SELECT event_id, date_format(date_trunc('month', ts), 'yyyy_MM') AS month, date_format(date_trunc('month', ts) + INTERVAL 1 MONTH, 'yyyy_MM') AS next_month FROM events",
    "SELECT event_id, strftime(date_trunc('month', ts), '%Y_%m') AS month, strftime(date_trunc('month', ts) + INTERVAL 1 MONTH, '%Y_%m') AS next_month FROM events")
_CTX, _ASK = "CASE WHEN coalesce(b.text, '') = '' THEN 'No context found.' ELSE b.text END", "d.text"


@query("sc27_prompt", f"""SELECT d.doc_id, 'Context:' || chr(10) || {_CTX} || chr(10) || chr(10) || 'Question: ' || {_ASK} || chr(10) || 'Answer:' AS plain,
 'You are Assistant. Use context to answer.' || chr(10) || 'Context:' || chr(10) || {_CTX} || chr(10) || 'Question: ' || {_ASK} || chr(10) || 'Answer:' AS assistant, 'User: ' || {_ASK} || chr(10) || 'Assistant:' AS character
 FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id""")
def sc27(spark, sf):
    """Three templates: context and question, the same behind a preamble, and a character's turn."""
    rows = table(spark, sf, "documents").join(table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("found")), "doc_id", "left")
    context, asked = F.when(F.coalesce("found", F.lit("")) == "", "No context found.").otherwise(F.col("found")), F.col("text")
    plain = F.concat(F.lit("Context:\n"), context, F.lit("\n\nQuestion: "), asked, F.lit("\nAnswer:"))
    return rows.select("doc_id", plain.alias("plain"), ranking.prompt(context, asked).alias("assistant"), F.concat(F.lit("User: "), asked, F.lit("\nAssistant:")).alias("character"))


sql("sc28_percent_retained", "SELECT lang, count(*) AS total, count_if(n_chars >= 200) AS kept, round(100.0D * count_if(n_chars >= 200) / count(*), 1) AS percent FROM documents GROUP BY lang",
    "SELECT lang, count(*) AS total, count(*) FILTER (n_chars >= 200) AS kept, round(100.0::DOUBLE * count(*) FILTER (n_chars >= 200) / count(*), 1) AS percent FROM documents GROUP BY lang")


@query("io5_append_if_new", "SELECT DISTINCT sha256(text) AS content_hash FROM conversations WHERE sha256(text) NOT IN (SELECT sha256(text) FROM conversations WHERE conv_id % 2 = 0)")
def io5(spark, sf):
    rows = table(spark, sf, "conversations")
    ledger = rows.where("conv_id % 2 = 0").select(F.sha2("text", 256).alias("content_hash"))
    return files.append_new(rows.select("text"), ledger).select("content_hash")


_TAGS7 = "'programming,lang-' || language || ',tech-stack,curated,quality-filtered,relevance-scored' || CASE WHEN any_value(priority) IS NULL THEN '' ELSE ',the,que,der' END"


@query("io7_sidecar", SCORED + f""" SELECT language, any_value(priority) AS priority, {_TAGS7} AS tags, count(*) FILTER (quality >= 0.5) AS sample_count, count(*) AS total, round(coalesce(avg(quality) FILTER (quality >= 0.5), 0), 6) AS mean_quality,
 round(coalesce(avg(relevance) FILTER (quality >= 0.5), 0), 6) AS mean_relevance, coalesce(any_value(boost), 0)::DOUBLE AS boost FROM scored GROUP BY language""")
def io7(spark, sf):
    """The JSON of each language's sidecar, read back."""
    meta = curation.sidecar(curation.statistics(_scored(spark, sf)), test_config(spark))
    m = meta.select("language", F.from_json("meta", curation.SIDECAR_SCHEMA + ", avg_relevance_score double").alias("m"))
    return m.select("language", "m.priority", F.array_join("m.tags", ",").alias("tags"), "m.sample_count", "m.filter_stats.total", F.col("m.avg_quality_score").alias("mean_quality"), F.col("m.avg_relevance_score").alias("mean_relevance"), F.col("m.quality_boost").alias("boost"))


@query("io9_timed_log", "SELECT date_trunc('second', ts) AS at, event_type || ' by ' || user_id AS message FROM events WHERE event_id % 10 <> 0")
def io9(spark, sf):
    said = F.concat(F.lit("- "), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(" "), "event_type", F.lit(" by "), F.col("user_id").cast("string"))
    lines = table(spark, sf, "events").select(F.when(F.col("event_id") % 10 != 0, said).otherwise("no time stamp").alias("value"))
    return files.timed_log(lines)


@query("ud1_hashing_embedder", f"WITH t AS (SELECT doc_id, unnest({_WORDS}) AS term FROM documents), c AS (SELECT doc_id, ('0x' || substr(md5(term), 1, 8))::BIGINT % 64 AS bucket, count(*) AS n FROM t GROUP BY 1, 2) SELECT doc_id, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS weight FROM c")
def ud1(spark, sf):
    bucket = F.conv(F.substring(F.md5("term"), 1, 8), 16, 10).cast("long") % 64
    counts = terms(table(spark, sf, "documents"), "doc_id").groupBy("doc_id", bucket.alias("bucket")).agg(F.count("*").alias("n"))
    total = F.sum(F.col("n") * F.col("n")).over(Window.partitionBy("doc_id"))
    return counts.select("doc_id", "bucket", F.round(F.col("n") / F.sqrt(total), 6).alias("weight"))


@query("pl1_keyword_search", f"""WITH t AS (SELECT doc_id, unnest({_WORDS}) AS term FROM documents), l AS (SELECT doc_id, count(*) AS len FROM t GROUP BY 1), st AS (SELECT count(*) AS n, avg(len) AS mean FROM l),
 q AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_WORDS}) AS term FROM benchmark)), tf AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY 1, 2),
 df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), s AS (SELECT item_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {K1 + 1} / (tf + {K1} * ({1 - B} + {B} * len / mean))), 4) AS score FROM q JOIN tf USING (term) JOIN df USING (term) JOIN l USING (doc_id), st GROUP BY 1, 2)
 SELECT item_id, doc_id, score FROM s QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10""")
def pl1(spark, sf):
    """BM25 of each benchmark item over all documents."""
    docs, items = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return keyword.scored(docs, items).select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), "score")


_KEYWORD = f"""kt AS (SELECT doc_id AS id, unnest({_WORDS}) AS term FROM documents), kl AS (SELECT id, count(*) AS len FROM kt GROUP BY 1), kn AS (SELECT count(*) AS n, avg(len) AS mean FROM kl),
 ktf AS (SELECT id, term, count(*) AS tf FROM kt GROUP BY 1, 2), kdf AS (SELECT term, count(*) AS df FROM ktf GROUP BY 1),
 kq AS (SELECT DISTINCT item_id * 50 AS query_id, unnest({_WORDS}) AS term FROM benchmark WHERE item_id * 50 IN (SELECT vec_id FROM embeddings)),
 ks AS (SELECT query_id, id, sum(round(tf * {K1 + 1} / (tf + {K1} * ({1 - B} + {B} * len / mean)) * ln(1 + (n - df + 0.5) / (df + 0.5)) * 1000000)::BIGINT)::BIGINT AS impact FROM kq JOIN ktf USING (term) JOIN kdf USING (term) JOIN kl USING (id), kn GROUP BY 1, 2),
 kk AS (SELECT query_id, id, impact / 1000000 AS score FROM ks QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY impact DESC, id) <= 10)"""


def _item_queries(spark, sf) -> DataFrame:
    """The benchmark item of each query vector: (query_id, text)."""
    items = table(spark, sf, "benchmark").select((F.col("item_id") * 50).alias("query_id"), "text")
    return items.join(query_vectors(spark, sf).select("query_id").hint("merge"), "query_id", "left_semi")


def _keyword(spark, sf) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return keyword.InvertedIndex.build(docs, folder(spark, "inverted")).search(_item_queries(spark, sf))


@query("pl1_stored_index", f"WITH {_KEYWORD} SELECT query_id, id, round(score, 5) AS score FROM kk")
def pl1_stored(spark, sf):
    """Keyword search that reads only folders of the terms asked for, and of their blocks those whose maxima can matter."""
    return _keyword(spark, sf).select("query_id", "id", F.round("score", 5).alias("score"))


@query("pl1_blend", KNN + f""", {_KEYWORD}, a AS (SELECT query_id, id, round(score / max(score) OVER (PARTITION BY query_id), 6) AS keyword_score FROM kk), b AS (SELECT query_id, id, round(1 / (1 + distance), 6) AS similarity FROM cand WHERE query_id IN (SELECT query_id FROM kq)),
 u AS (SELECT query_id, id, coalesce(keyword_score, 0) AS keyword_score, coalesce(similarity, 0) AS similarity FROM a FULL JOIN b USING (query_id, id)), f AS (SELECT *, round(0.6 * keyword_score + 0.4 * similarity, 6) AS blend FROM u),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY blend DESC, id) AS rank FROM f) SELECT query_id, id, keyword_score, similarity, blend, rank FROM r WHERE rank <= 10""")
def pl1_blend(spark, sf):
    """Keyword and vector search of the same queries, blended by fusion weights."""
    q = query_vectors(spark, sf).join(_item_queries(spark, sf).select("query_id").hint("merge"), "query_id", "left_semi")
    near = ranking.knn(corpus_vectors(spark, sf), q, 10)
    return keyword.blended(_keyword(spark, sf), near).select("query_id", "id", "keyword_score", "similarity", "blend", F.col("rank").cast("long").alias("rank"))


@query("pl3_ranking_metrics", KNN + """, r AS (SELECT query_id, c.id, (c.label = d.label)::INT AS hit, row_number() OVER (PARTITION BY query_id ORDER BY distance, c.id) AS rank FROM cand c JOIN de d ON d.id = query_id),
 g AS (SELECT query_id, coalesce(1.0::DOUBLE / min(rank) FILTER (hit = 1), 0) AS rr, sum(hit / log2(rank + 1)) AS dcg, sum(hit) AS hits FROM r GROUP BY 1),
 i AS (SELECT g.*, coalesce(list_sum(list_transform(range(1, hits::BIGINT + 1), lambda k: 1 / log2(k + 1))), 0) AS ideal FROM g)
 SELECT query_id // 50 % 2 AS arm, count(*) AS n, round(avg(rr), 6) AS mrr, round(avg(CASE WHEN ideal > 0 THEN dcg / ideal ELSE 0 END), 6) AS ndcg FROM i GROUP BY 1""")
def pl3(spark, sf):
    labels = corpus_vectors(spark, sf).select("id", "label")
    asked = labels.select(F.col("id").alias("query_id"), F.col("label").alias("wanted"))
    rows = ranking.with_texts(_candidates(spark, sf), labels).join(asked.hint("merge"), "query_id").withColumn("hit", (F.col("label") == F.col("wanted")).cast("int"))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id")))
    gain = lambda r: 1 / F.log2(r + 1)
    each = rows.groupBy("query_id").agg(F.coalesce(1.0 / F.min(F.when(F.col("hit") == 1, F.col("rank"))), F.lit(0.0)).alias("rr"), F.sum(F.col("hit") * gain(F.col("rank"))).alias("dcg"), F.sum("hit").alias("hits"))
    places = F.when(F.col("hits") > 0, F.sequence(F.lit(1), F.col("hits").cast("int"))).otherwise(F.array().cast("array<int>"))
    ideal = F.aggregate(places, F.lit(0.0), lambda s, k: s + gain(k))
    each = each.withColumn("ndcg", F.when(ideal > 0, F.col("dcg") / ideal).otherwise(0.0))
    return each.groupBy((F.floor(F.col("query_id") / 50) % 2).alias("arm")).agg(F.count("*").alias("n"), F.round(F.avg("rr"), 6).alias("mrr"), F.round(F.avg("ndcg"), 6).alias("ndcg"))


_MAIL, _NUMBER = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+", r"\+[0-9][0-9 ().-]{6,}[0-9]"
sql("pl5_redacted", f"SELECT doc_id, regexp_replace(regexp_replace(text, r'{_MAIL}', '[email]'), r'{_NUMBER}', '[phone]') AS redacted FROM documents",
    f"SELECT doc_id, regexp_replace(regexp_replace(text, '{_MAIL}', '[email]', 'g'), '{_NUMBER}', '[phone]', 'g') AS redacted FROM documents")


@query("pl6_added_features", f"WITH {IX}, m AS (SELECT max(epoch(occurred_at)) AS now FROM ix), g AS (SELECT chunk_id, count(*) AS n, count(*) FILTER (event_type = 'impression') AS shown, count(*) FILTER (event_type IN ('click', 'upvote')) AS acts, max(epoch(occurred_at)) AS last FROM ix GROUP BY 1) SELECT chunk_id, round(coalesce(acts / nullif(shown, 0)::DOUBLE, 0), 6) AS engagement_rate, round(exp(-(now - last) / 604800), 6) AS freshness, round(ln(1 + n), 6) AS authority FROM g, m")
def pl6(spark, sf):
    rows = interactions(spark, sf).withColumn("at", F.unix_micros(F.col("occurred_at").cast("timestamp")) / 1e6)
    now = rows.agg(F.max("at").alias("now"))  # one row
    per = rows.groupBy("chunk_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "impression").alias("shown"), F.count_if(F.col("event_type").isin("click", "upvote")).alias("acts"), F.max("at").alias("last"))
    rate = F.coalesce(F.try_divide(F.col("acts"), F.col("shown")), F.lit(0.0))
    return per.crossJoin(F.broadcast(now)).select("chunk_id", F.round(rate, 6).alias("engagement_rate"), F.round(F.exp(-(F.col("now") - F.col("last")) / scores.TAU), 6).alias("freshness"), F.round(F.log1p("n"), 6).alias("authority"))


@query("pl9_keyphrases", f"WITH t AS (SELECT doc_id, unnest({_WORDS}) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), n AS (SELECT count(*) AS n FROM documents) SELECT doc_id, term, round(tf * ln(n / df::DOUBLE), 4) AS weight FROM tf JOIN df USING (term), n QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(tf * ln(n / df::DOUBLE), 4) DESC, term) <= 3")
def pl9(spark, sf):
    docs = table(spark, sf, "documents")
    counts, n = keyword.counted(docs.select("doc_id", "text"), "doc_id"), docs.count()
    often = written(counts.groupBy("term").agg(F.count("*").alias("df")), "often")
    order = Window.partitionBy("doc_id").orderBy(F.desc("weight"), "term")

    def best(rows):
        return rows.withColumn("rank", F.row_number().over(order)).where("rank <= 3").drop("rank")

    def weighed(rows):
        return rows.select("doc_id", "term", F.round(F.col("tf") * F.log(F.lit(n) / F.col("df")), 4).alias("weight"))

    if broadcastable(often):
        return best(weighed(counts.join(F.broadcast(often), "term")))
    hot = keyword.frequent(often)
    marked = counts.join(F.broadcast(hot), "term", "left")
    rare = often.join(F.broadcast(hot.select("term")), "term", "left_anti")
    parts = parts_of(rare.agg(F.sum("df")).first()[0] or 0)
    rest = marked.where("df IS NULL").select("doc_id", "term", "tf").repartition(parts, "term").join(rare.repartition(parts, "term").hint("merge"), "term")
    return best(best(weighed(marked.where("df IS NOT NULL"))).unionByName(weighed(rest)).repartition(parts, "doc_id"))


@query("ud1_user_embedder", "SELECT doc_id, round(length(text) / sqrt(length(text) * length(text) + 1.0), 6) AS x, round(1 / sqrt(length(text) * length(text) + 1.0), 6) AS y FROM documents")
def ud1_user(spark, sf):
    """A user's function in batches of sixteen texts."""

    def lengths(texts):
        assert len(texts) <= 16
        return [[len(t) / (len(t) ** 2 + 1) ** 0.5, 1 / (len(t) ** 2 + 1) ** 0.5] for t in texts]

    rows = embedding.embed(table(spark, sf, "documents").select("doc_id", "text"), lengths, dim=2)
    return rows.select("doc_id", F.round(F.get("embedding", F.lit(0)), 6).alias("x"), F.round(F.get("embedding", F.lit(1)), 6).alias("y"))


@query("pl9_entities", r"SELECT entity, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]+(?: [A-Z][a-z]+)+')) AS entity FROM documents) GROUP BY 1")
def pl9_entities(spark, sf):
    """Runs of capitalised words."""
    rows = table(spark, sf, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+(?: [A-Z][a-z]+)+"), F.lit(0))).alias("entity"))
    return rows.groupBy("entity").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


@query("pl9_topics")
def pl9_topics(spark, sf):
    """The likeliest of eight topics of each document, by latent Dirichlet allocation over hashed words; seeded."""
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import HashingTF
    from pyspark.ml.functions import vector_to_array

    rows = table(spark, sf, "documents").select("doc_id", F.array_remove(F.split(F.lower("text"), " "), "").alias("words"))
    counted = HashingTF(inputCol="words", outputCol="features", numFeatures=1 << 12).transform(rows).select("doc_id", "features")
    mixed = LDA(k=8, seed=7, maxIter=5).fit(counted).transform(counted).withColumn("share", vector_to_array("topicDistribution"))
    return mixed.select("doc_id", (F.array_position("share", F.array_max("share")) - 1).alias("topic"), F.array_max("share").alias("share"))


@query("pl10_clusters")
def pl10(spark, sf):
    """Cluster of every vector and its distance to the cluster's centre; rows are ordered and seeded, so runs agree."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = table(spark, sf, "embeddings").select("vec_id", "embedding", array_to_vector("embedding").alias("features")).repartitionByRange(8, "vec_id").sortWithinPartitions("vec_id")
    model = KMeans(k=16, seed=7, maxIter=20).fit(rows)
    centres = F.array(*(F.array(*(F.lit(float(x)) for x in c)) for c in model.clusterCenters()))  # sixteen
    placed = model.transform(rows).select("vec_id", F.col("prediction").alias("cluster"), "embedding", F.get(centres, F.col("prediction")).alias("centre"))
    return placed.select("vec_id", "cluster", F.round(vectors.l2_distance(F.col("embedding"), F.col("centre")), 6).alias("distance"))
