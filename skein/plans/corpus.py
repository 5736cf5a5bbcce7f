"""Queries: chunks, hashes, ingest, curation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skein.functions import text
from skein.operators import curation, spread
from skein.plans.base import CHUNKS, chunk_rows, query, sql, table
from skein.sources import files, resume
from skein.sources.tables import folder, written

sql("fp1_preview", "SELECT doc_id, left(text, 300) AS preview, left(text, 120) AS short FROM documents")
sql("io3_by_language", "SELECT lang, count(*) AS n, sum(n_chars) AS chars FROM documents WHERE lang = 'de' GROUP BY lang")
sql("sc14_content_hash", "SELECT doc_id, sha2(text, 256) AS h FROM documents", "SELECT doc_id, sha256(text) AS h FROM documents")
sql("sc15_cache_key", "SELECT doc_id, concat('rag:q:', md5(text)) AS k FROM documents", "SELECT doc_id, 'rag:q:' || md5(text) AS k FROM documents")


@query("sc17_chunks", f"WITH {CHUNKS} SELECT doc_id, ordinal, chunk FROM chunks")
def sc17(spark, sf):
    return chunk_rows(spark, sf).select("doc_id", "ordinal", "chunk")


@query("ag8_ingest_counts", f"WITH {CHUNKS} SELECT source, count(*) AS n_chunks, count(DISTINCT doc_id) AS n_docs FROM chunks GROUP BY 1")
def ag8(spark, sf):
    return chunk_rows(spark, sf).groupBy("source").agg(F.count("*").alias("n_chunks"), F.countDistinct("doc_id").alias("n_docs"))


@query("jn5_parent_chunks", f"WITH {CHUNKS} SELECT c.doc_id, c.ordinal, CASE WHEN c.ordinal > 0 THEN 'child' WHEN n > 1 THEN 'parent' ELSE 'standalone' END AS role, left(coalesce(p.chunk, c.chunk), 80) AS parent FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM chunks) c LEFT JOIN chunks p ON c.doc_id = p.doc_id AND p.ordinal = 0")
def jn5(spark, sf):
    c = chunk_rows(spark, sf)
    w = Window.partitionBy("doc_id")
    c = c.withColumn("n", F.count("*").over(w)).withColumn("first", F.first(F.when(F.col("ordinal") == 0, F.col("chunk")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    role = F.when(F.col("ordinal") > 0, "child").when(F.col("n") > 1, "parent").otherwise("standalone")
    return c.select("doc_id", "ordinal", role.alias("role"), F.left(F.coalesce("first", "chunk"), F.lit(80)).alias("parent"))


@query("wn7_chunk_ordinal", f"WITH {CHUNKS} SELECT doc_id, max(ordinal) AS last_ordinal, count(*) AS n FROM chunks GROUP BY 1")
def wn7(spark, sf):
    return chunk_rows(spark, sf).groupBy("doc_id").agg(F.max("ordinal").alias("last_ordinal"), F.count("*").alias("n"))


@query("jn2_new_by_hash", "WITH h AS (SELECT doc_id, sha256(text) AS h, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS n FROM documents), known AS (SELECT DISTINCT h FROM h WHERE doc_id % 4 = 0) SELECT doc_id, h FROM h WHERE n = 1 AND h NOT IN (SELECT h FROM known)")
def jn2(spark, sf):
    h = table(spark, sf, "documents").select("doc_id", text.content_hash(F.col("text")).alias("h"))
    known = h.where("doc_id % 4 = 0").select("h").distinct()
    return h.groupBy("h").agg(F.min("doc_id").alias("doc_id")).join(known, "h", "left_anti").select("doc_id", "h")


@query("se2_hash_ledger", "SELECT sha256(text) AS h FROM conversations GROUP BY 1")
def se2(spark, sf):
    return table(spark, sf, "conversations").select(text.content_hash(F.col("text")).alias("h")).distinct()


@query("io1_text_files", "SELECT item_id, text FROM benchmark")
def io1(spark, sf):
    """Each item as a text file of its own in a folder of its own, read back from any depth."""
    path = folder(spark, "texts")
    table(spark, sf, "benchmark").select("item_id", "text").write.partitionBy("item_id").text(path)
    return files.text_corpus(spark, path, "*.txt").select(F.regexp_extract("path", "item_id=([0-9]+)", 1).cast("long").alias("item_id"), F.regexp_replace("text", "\n$", "").alias("text"))


def memory_json(c):
    """A line of JSON for each turn, with the text as content, within content, or among other strings; blank and malformed lines follow some of them."""
    k = F.col("turn") % 3
    plain, nested = F.to_json(F.struct("conv_id", F.col("text").alias("content"))), F.to_json(F.struct("conv_id", F.struct("text").alias("content")))
    other = F.to_json(F.struct("conv_id", "role", F.col("text").alias("said")))
    line = F.when(k == 0, plain).when(k == 1, nested).otherwise(other)
    junk = F.when(F.col("turn") % 5 == 0, F.array(F.lit(""), F.concat(F.lit('{"content": '), "text"), F.lit("7"))).otherwise(F.array())
    return c.select(F.explode(F.concat(F.array(line), junk)).alias("value"))


@query("io2_memory_lines", "SELECT CASE WHEN turn % 3 = 2 THEN role || ' | ' || text ELSE text END AS memory FROM conversations")
def io2(spark, sf):
    """Lines of JSON are written and scanned; blank, malformed and scalar ones are skipped."""
    path = folder(spark, "memory")
    memory_json(table(spark, sf, "conversations")).write.text(path)
    return files.memory_lines(spark, path).select(F.col("text").alias("memory"))


@query("io2_resumed", "SELECT CASE WHEN turn % 3 = 2 THEN role || ' | ' || text ELSE text END AS memory, CAST(1 + conv_id % 2 AS INT) AS scan FROM conversations")
def io2_resumed(spark, sf):
    """Two scans of a folder to which lines are added between them; the second reads what is new alone."""
    c, path, out = table(spark, sf, "conversations"), folder(spark, "memory"), None
    offsets = resume.tail(spark)
    for k in (0, 1):
        memory_json(c.where(F.col("conv_id") % 2 == k)).write.mode("append").text(path)
        lines, _ = offsets.lines(path)
        rows = lines.select(text.memory_text(F.col("value")).alias("memory"), F.lit(k + 1).alias("scan")).where("memory IS NOT NULL")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("io4_append", "SELECT batch, count(*) AS inserted, sum(doc_id) AS ids, source FROM (SELECT *, CASE WHEN doc_id % 2 = 0 THEN 'first' ELSE 'second' END AS batch FROM documents) GROUP BY batch, source")
def io4(spark, sf):
    path, docs = folder(spark, "vectors"), table(spark, sf, "documents").select("doc_id", F.col("text").alias("chunk"), "source")
    for k, batch in enumerate(("first", "second")):
        files.append_rows(docs.where(F.col("doc_id") % 2 == k), path, batch)
    return spark.read.parquet(path).groupBy(F.col("batch_tag").alias("batch"), "source").agg(F.count("*").alias("inserted"), F.sum("doc_id").alias("ids"))


_RK5 = CHUNKS.replace("chunks AS", "pieces AS").replace("doc_id, source", "item_id, 'docs' AS source", 1).replace("FROM documents)", "FROM benchmark)")


@query("rk5_ingest", f"""WITH {_RK5}, h AS (SELECT *, sha256(chunk) AS content_hash FROM pieces QUALIFY row_number() OVER (PARTITION BY sha256(chunk) ORDER BY item_id, ordinal) = 1),
 t AS (SELECT content_hash, unnest(list_filter(string_split(lower(chunk), ' '), lambda x: x <> '')) AS term FROM h), c AS (SELECT content_hash, ('0x' || substr(md5(term), 1, 8))::BIGINT % 64 AS bucket, count(*) AS n FROM t GROUP BY 1, 2),
 v AS (SELECT content_hash, max(n) / sqrt(sum(n * n)) AS peak, count(*) AS used FROM c GROUP BY 1)
 SELECT h.content_hash, chunk, round(coalesce(peak, 0), 6) AS peak, coalesce(used, 0) AS used FROM h LEFT JOIN v USING (content_hash)""")
def rk5(spark, sf):
    """Text files are read, chunked, hashed, embedded and appended; a second pass over the same files appends nothing."""
    path, store = folder(spark, "texts"), folder(spark, "ingest")
    table(spark, sf, "benchmark").select("item_id", "text").write.partitionBy("item_id").text(path)
    for _ in range(2):
        files.ingest(files.text_corpus(spark, path).withColumn("text", F.regexp_replace("text", "\n$", "")), store)
    out = spark.read.parquet(store)
    return out.select("content_hash", "chunk", F.round(F.array_max("embedding"), 6).alias("peak"), F.size(F.filter("embedding", lambda x: x > 0)).cast("long").alias("used"))


@query("sc22_text_metrics", r"SELECT doc_id, length(text) AS size, round(length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) / length(text)::DOUBLE, 6) AS alphanum, list_max(list_transform(string_split(text, chr(10)), lambda x: length(x))) AS max_line, round(list_avg(list_transform(string_split(text, chr(10)), lambda x: length(x)::DOUBLE)), 6) AS avg_line FROM documents")
def sc22(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", F.length(t).cast("long").alias("size"), F.round(text.alphanum_fraction(t), 6).alias("alphanum"), text.max_line_length(t).cast("long").alias("max_line"), F.round(text.avg_line_length(t), 6).alias("avg_line"))


@query("sc29_token_count", r"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '')) AS tokens FROM documents")
def sc29(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.token_count(F.col("text")).cast("long").alias("tokens"))


def samples(spark, sf):
    """Code samples from documents; keywords for tests are words that the texts hold."""
    languages = [*(r[0] for r in curation.language_rows()), "cobol"]  # the last has no configuration
    d = table(spark, sf, "documents")
    lic = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("MIT"))).when(F.col("doc_id") % 3 == 1, F.array(F.lit("other"))).otherwise(F.expr("CAST(array() AS array<string>)"))
    language = F.element_at(F.array(*map(F.lit, languages)), (F.col("doc_id") % 12 + 1).cast("int"))
    out = d.select(F.col("doc_id").alias("row_id"), language.alias("language"), F.col("text").alias("content"), F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".py"))).alias("path"), F.col("source").alias("repository_name"), lic.alias("licenses"))
    return curation.with_metrics(out)


def test_config(spark):
    rows = [(name, p, w, ["the", "que", "der", "src1"], [".py", "src2/"], b) for name, p, w, _, _, b in curation.language_rows()]
    return curation.language_config(spark, rows)


_VALUES = ", ".join(f"('{n}', '{p}', {w}, {b})" for n, p, w, _, _, b in curation.language_rows())
_NAMES = ", ".join(f"'{r[0]}'" for r in curation.language_rows()) + ", 'cobol'"
SCORED = rf"""WITH cfg(language, priority, weight_modifier, boost) AS (VALUES {_VALUES}),
 s AS (SELECT doc_id AS row_id, [{_NAMES}][CAST(doc_id % 12 + 1 AS INT)] AS language, text AS content, source || '/' || doc_id || '.py' AS path, source AS repo, doc_id % 3 AS lic, length(text) AS size,
 round(length(regexp_replace(text, '[^\p{{L}}\p{{N}}]', '', 'g')) / nullif(length(text), 0)::DOUBLE, 6) AS a, round(list_avg(list_transform(string_split(text, chr(10)), lambda x: length(x)::DOUBLE)), 6) AS line FROM documents),
 p AS (SELECT s.*, priority, weight_modifier, boost, CASE WHEN language IN ('yaml', 'dockerfile', 'makefile') THEN CASE WHEN a >= 0.4 THEN 1.0 WHEN a >= 0.3 THEN 0.7 ELSE 0.3 END
  ELSE CASE WHEN a BETWEEN 0.55 AND 0.85 THEN 1.0 WHEN a BETWEEN 0.45 AND 0.95 THEN 0.7 WHEN a >= 0.35 THEN 0.4 ELSE 0.0 END END::DOUBLE AS pa,
  CASE WHEN line BETWEEN 35 AND 90 THEN 1.0 WHEN line BETWEEN 25 AND 120 THEN 0.8 WHEN line BETWEEN 20 AND 150 THEN 0.5 ELSE 0.2 END::DOUBLE AS pl,
  CASE WHEN size BETWEEN 200 AND 8000 THEN 1.0 WHEN size BETWEEN 100 AND 25000 THEN 0.8 WHEN size BETWEEN 50 AND 50000 THEN 0.5 ELSE 0.2 END::DOUBLE AS ps,
  CASE lic WHEN 0 THEN 1.0 WHEN 1 THEN 0.6 ELSE 0 END::DOUBLE AS pc, CASE WHEN lic < 2 THEN 4 ELSE 3 END AS factors,
  CASE WHEN priority IS NULL THEN 0 ELSE contains(lower(content), 'the')::INT + contains(lower(content), 'que')::INT + contains(lower(content), 'der')::INT + contains(lower(content), 'src1')::INT END AS hits,
  priority IS NOT NULL AND contains(repo, 'src1') AS repo_hit, CASE WHEN priority IS NULL THEN 0 ELSE 1 + contains(path, 'src2/')::INT END AS paths FROM s LEFT JOIN cfg USING (language)),
 q AS (SELECT *, round(least(1.0, (pa + pl + ps + pc) / factors + least(0.3::DOUBLE, hits * 0.1::DOUBLE) + CASE WHEN repo_hit THEN 0.2 ELSE 0.0 END::DOUBLE + coalesce(boost, 0)::DOUBLE), 6) AS quality, round(hits * 0.2::DOUBLE + paths * 0.3::DOUBLE + CASE WHEN repo_hit THEN 0.5 ELSE 0 END::DOUBLE, 6) AS relevance FROM p),
 scored AS (SELECT *, round(quality + relevance, 6) AS combined FROM q)"""


def _scored(spark, sf):
    return curation.scored(samples(spark, sf), test_config(spark))


@query("sc19_quality", SCORED + " SELECT row_id, language, quality, relevance, combined FROM scored")
def sc19(spark, sf):
    return _scored(spark, sf).select("row_id", "language", "quality", "relevance", "combined")


@query("so5_curation_top", SCORED + " SELECT language, row_id, combined, row_number() OVER (PARTITION BY language ORDER BY combined DESC, row_id DESC) AS rank FROM scored WHERE quality >= 0.5 QUALIFY rank <= 20")
def so5(spark, sf):
    return curation.top(_scored(spark, sf), 20).select("language", "row_id", "combined", F.col("rank").cast("long").alias("rank"))


_STATS = """ SELECT language, count(*) AS total, count(*) FILTER (quality >= 0.5) AS kept, round(count(*) FILTER (quality >= 0.5) / count(*)::DOUBLE, 6) AS ratio, round(coalesce(avg(quality) FILTER (quality >= 0.5), 0), 6) AS mean_quality,
 round(coalesce(min(quality) FILTER (quality >= 0.5), 0), 6) AS min_quality, round(coalesce(max(quality) FILTER (quality >= 0.5), 0), 6) AS max_quality, round(coalesce(avg(relevance) FILTER (quality >= 0.5), 0), 6) AS mean_relevance FROM scored GROUP BY language"""


@query("ag2_curation_statistics", SCORED + _STATS)
def ag2(spark, sf):
    return curation.statistics(_scored(spark, sf))


@query("rk4_curation", SCORED + ", st AS (" + _STATS + ") SELECT t.language, row_id, rank, quality, relevance, total, kept, mean_quality FROM (SELECT *, row_number() OVER (PARTITION BY language ORDER BY combined DESC, row_id DESC) AS rank FROM scored WHERE quality >= 0.5 QUALIFY rank <= 50) t JOIN st USING (language)")
def rk4(spark, sf):
    """Scores are made once and written; the best rows and the statistics read them."""
    s = written(_scored(spark, sf).select("language", "row_id", "quality", "relevance", "combined"), "scored")
    best = curation.top(s, 50).select("language", "row_id", F.col("rank").cast("long").alias("rank"), "quality", "relevance")
    return best.join(F.broadcast(curation.statistics(s).select("language", "total", "kept", "mean_quality")), "language")  # one row for each language


@query("io6_curated_files", SCORED + " SELECT language, row_id, quality FROM scored WHERE quality >= 0.5")
def io6(spark, sf):
    """Lines of JSON, a folder for each language, read back."""
    path = folder(spark, "curated")
    files.write_curated(_scored(spark, sf).where("quality >= 0.5").select("language", "row_id", "content", "quality"), path)
    return spark.read.schema("row_id long, quality double, language string").json(path).select("language", "row_id", "quality")


@query("fp9_min_quality", SCORED + " SELECT row_id, quality FROM scored WHERE quality >= 0.5")
def fp9(spark, sf):
    return _scored(spark, sf).where("quality >= 0.5").select("row_id", "quality")


@query("fp10_thresholds", r"SELECT doc_id AS row_id FROM documents WHERE length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) / nullif(length(text), 0)::DOUBLE >= 0.45 AND list_avg(list_transform(string_split(text, chr(10)), lambda x: length(x)::DOUBLE)) <= 100 AND list_max(list_transform(string_split(text, chr(10)), lambda x: length(x))) <= 400 AND length(text) BETWEEN 30 AND 100000")
def fp10(spark, sf):
    c, m = F.col("content"), curation.LIMITS
    ok = (text.alphanum_fraction(c) >= m["alphanum"]) & (text.avg_line_length(c) <= m["avg_line"]) & (text.max_line_length(c) <= m["max_line"]) & F.length(c).between(m["min_size"], m["max_size"])
    return table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), F.col("text").alias("content")).where(ok).select("row_id")


@query("fp11_priority", SCORED + " SELECT row_id, language FROM scored WHERE priority IN ('critical', 'high')")
def fp11(spark, sf):
    chosen = curation.language_config(spark).where(F.col("priority").isin("critical", "high")).select("language")
    return samples(spark, sf).join(F.broadcast(chosen), "language", "left_semi").select("row_id", "language")


@query("ag7_run_summary", SCORED + " SELECT kept > 0 AS success, count(*) AS languages, sum(kept)::BIGINT AS kept FROM (SELECT language, count(*) FILTER (quality >= 0.5) AS kept FROM scored GROUP BY 1) GROUP BY 1")
def ag7(spark, sf):
    return curation.statistics(_scored(spark, sf)).groupBy((F.col("kept") > 0).alias("success")).agg(F.count("*").alias("languages"), F.sum("kept").alias("kept"))


@query("dq6_changed_files", "WITH m AS (SELECT max(doc_id) AS m FROM documents), a AS (SELECT doc_id, sha256(text) AS h, doc_id % 3 + 1 AS version FROM documents, m WHERE doc_id < 0.7 * m), b AS (SELECT doc_id, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS h FROM documents, m WHERE doc_id > 0.3 * m) SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.h IS NULL THEN 'new' WHEN b.h IS NULL THEN 'removed' WHEN a.h = b.h THEN 'unchanged' ELSE 'changed' END AS state, CASE WHEN a.h IS NULL THEN 1 WHEN a.h <> b.h THEN version + 1 ELSE version END AS version FROM a FULL JOIN b ON a.doc_id = b.doc_id")
def dq6(spark, sf):
    """Two snapshots; a changed file gets the next version."""
    d = table(spark, sf, "documents")
    m = d.agg(F.max("doc_id")).first()[0]
    a = d.where(F.col("doc_id") < 0.7 * m).select("doc_id", text.content_hash(F.col("text")).alias("ha"), (F.col("doc_id") % 3 + 1).alias("was"))
    b = d.where(F.col("doc_id") > 0.3 * m).select("doc_id", text.content_hash(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("hb"))
    state = F.when(F.col("ha").isNull(), "new").when(F.col("hb").isNull(), "removed").when(F.col("ha") == F.col("hb"), "unchanged").otherwise("changed")
    version = F.when(F.col("ha").isNull(), 1).when(F.col("ha") != F.col("hb"), F.col("was") + 1).otherwise(F.col("was"))
    return a.join(b, "doc_id", "full").select("doc_id", state.alias("state"), version.alias("version"))


@query("wn4_versions", "WITH h AS (SELECT source, doc_id, md5(text) AS h FROM documents), c AS (SELECT *, CASE WHEN lag(h) OVER w IS DISTINCT FROM h THEN 1 ELSE 0 END AS changed FROM h WINDOW w AS (PARTITION BY source ORDER BY doc_id)) SELECT source, doc_id, sum(changed) OVER (PARTITION BY source ORDER BY doc_id)::BIGINT AS version, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) = 1 AS latest FROM c")
def wn4(spark, sf):
    h = spread.numbered(table(spark, sf, "documents").select("source", "doc_id", F.md5("text").alias("h")), ["source"], ["doc_id"])
    h, keys, own = spread.framed(h, ["source"], 1)
    h = h.withColumn("changed", (~F.lag("h").over(Window.partitionBy(*keys).orderBy("pos")).eqNullSafe(F.col("h"))).cast("int")).where(own).drop("block")
    return spread.running_sum(h, ["source"], "changed", "version").select("source", "doc_id", "version", (F.col("pos") == F.col("total")).alias("latest"))
