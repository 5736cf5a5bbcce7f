"""Curation of code samples: quality, relevance, filters, top samples, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions import text

# Language, priority, weight, keywords, file patterns, boost.
LANGUAGES = [
    ("javascript", "critical", 1.4, ["react", "expo", "react-native", "next.js", "vite", "node", "npm", "yarn"], [".js", ".jsx", "package.json", "expo", "react"], 0.2),
    ("typescript", "critical", 1.5, ["react", "expo", "react-native", "next.js", "vite", "tsx", "types"], [".ts", ".tsx", "tsconfig", "types"], 0.3),
    ("python", "critical", 1.4, ["fastapi", "uvicorn", "pydantic", "sqlalchemy", "redis", "pandas", "numpy"], [".py", "requirements", "pyproject", "main.py", "api"], 0.2),
    ("dockerfile", "high", 1.3, ["python", "node", "nginx", "redis", "postgres", "alpine"], ["Dockerfile", "docker-compose", ".dockerignore"], 0.1),
    ("yaml", "high", 1.2, ["docker-compose", "github", "ci", "config", "deployment"], [".yml", ".yaml", "compose", "config"], 0.1),
    ("sql", "high", 1.3, ["postgres", "timescale", "pgvector", "supabase", "select", "create"], [".sql", "migration", "schema", "query"], 0.2),
    ("html", "medium", 1.1, ["react", "component", "jsx", "responsive", "css"], [".html", "index", "template"], 0.1),
    ("css", "medium", 1.1, ["responsive", "mobile", "flexbox", "grid", "tailwind"], [".css", ".scss", "style", "theme"], 0.1),
    ("markdown", "medium", 1.0, ["readme", "docs", "api", "guide", "tutorial"], [".md", "README", "docs", "guide"], 0.0),
    ("makefile", "medium", 1.1, ["build", "docker", "deploy", "test", "install"], ["Makefile", "makefile", "build"], 0.1),
    ("shell", "medium", 1.1, ["docker", "deploy", "build", "setup", "install"], [".sh", ".bash", "setup", "deploy"], 0.1),
]
# Preferred licences; limits of the optional filter.
LICENSES = ("MIT", "Apache-2.0", "BSD-3-Clause", "BSD-2-Clause", "ISC", "Unlicense", "CC0-1.0", "GPL-3.0")
LIMITS = {"alphanum": 0.45, "avg_line": 100, "max_line": 400, "min_size": 30, "max_size": 100_000}
LENIENT = ("yaml", "dockerfile", "makefile")


def language_rows() -> list[tuple]:
    return list(LANGUAGES)


def language_config(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    """One row for each language; fixed and small, so joins broadcast it."""
    return spark.createDataFrame(rows or language_rows(), "language string, priority string, weight_modifier double, keywords array<string>, file_patterns array<string>, quality_boost double")


def with_metrics(samples: DataFrame) -> DataFrame:
    c = F.col("content")
    return samples.withColumns({"alphanum_fraction": F.round(text.alphanum_fraction(c), 6), "avg_line_length": F.round(text.avg_line_length(c), 6), "max_line_length": text.max_line_length(c), "size": F.length(c)})


def steps(x: Column, *ladder: tuple[float, float, float], otherwise: float) -> Column:
    """Points of the first rung (low, high, points) that holds x, ends included."""
    out = None
    for low, high, points in ladder:
        test = x.between(low, high)
        out = F.when(test, points) if out is None else out.when(test, points)
    return out.otherwise(otherwise)


def quality(digits: int = 6) -> Column:
    """Mean points of the factors that are present, with bonuses for keywords and repository, plus the language's boost; at most 1."""
    big = float("inf")
    a, line, size, lic = F.col("alphanum_fraction"), F.col("avg_line_length"), F.col("size").cast("double"), F.col("licenses")
    alnum = F.when(F.col("language").isin(*LENIENT), steps(a, (0.4, big, 1.0), (0.3, big, 0.7), otherwise=0.3)).otherwise(
        steps(a, (0.55, 0.85, 1.0), (0.45, 0.95, 0.7), (0.35, big, 0.4), otherwise=0.0)
    )
    parts = [
        F.when(a.isNotNull(), alnum),
        F.when(line.isNotNull(), steps(line, (35, 90, 1.0), (25, 120, 0.8), (20, 150, 0.5), otherwise=0.2)),
        F.when(size.isNotNull(), steps(size, (200, 8000, 1.0), (100, 25000, 0.8), (50, 50000, 0.5), otherwise=0.2)),
        F.when(F.size(lic) > 0, F.when(F.arrays_overlap(lic, F.array(*map(F.lit, LICENSES))), 1.0).otherwise(0.6)),
    ]
    factors = sum((p.isNotNull().cast("int") for p in parts), F.lit(0))
    points = sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0))
    bonus = F.least(F.lit(0.3), F.col("hits") * 0.1) + F.when(F.col("in_repository"), 0.2).otherwise(0.0)
    score = F.when(factors > 0, points / factors + bonus).otherwise(0.5) + F.coalesce("quality_boost", F.lit(0.0))
    return F.round(F.least(F.lit(1.0), score), digits)


def relevance(digits: int = 6) -> Column:
    return F.round(F.col("hits") * 0.2 + F.col("paths") * 0.3 + F.when(F.col("in_repository"), 0.5).otherwise(0.0), digits)


def scored(samples: DataFrame, config: DataFrame) -> DataFrame:
    """samples with quality, relevance and their sum. A language that config lacks has no keywords, patterns or boost."""
    joined = samples.join(F.broadcast(config), "language", "left")  # one row for each language
    found = lambda c, words: F.coalesce(text.keyword_hits(F.col(c), F.col(words)), F.lit(0))
    joined = joined.withColumns({"hits": found("content", "keywords"), "paths": found("path", "file_patterns"), "in_repository": found("repository_name", "keywords") > 0})
    s = joined.withColumn("quality", quality()).withColumn("relevance", relevance()).drop("hits", "paths", "in_repository")
    return s.withColumn("combined", F.round(F.col("quality") + F.col("relevance"), 6))


# Tags of a curated output besides its language's and those of its first keywords; what it is told to be.
TAGS = ("programming", "curated", "quality-filtered", "relevance-scored")
SIDECAR = {"status": "curated", "version": "1.0", "content_type": "curated_code_repository"}


def sidecar(statistics: DataFrame, config: DataFrame, stack: str = "tech-stack") -> DataFrame:
    """(language, meta): a JSON object that describes each language's curated output: tags, counts, statistics and the language's configuration.

    The tags are, in order, programming, lang-<language>, the name of the stack (a parameter), curated, quality-filtered, relevance-scored, and the first three keywords.
    """
    rows = statistics.join(F.broadcast(config), "language", "left")
    first, *rest = map(F.lit, TAGS)
    tags = F.concat(F.array(first, F.concat(F.lit("lang-"), "language"), F.lit(stack), *rest), F.coalesce(F.slice("keywords", 1, 3), F.expr("CAST(array() AS array<string>)")))
    kept = F.struct("total", "kept", "ratio", F.struct("mean_quality", "min_quality", "max_quality", "mean_relevance").alias("quality_stats"))
    meta = F.struct(
        *(F.lit(v).alias(k) for k, v in SIDECAR.items()), "priority", tags.alias("tags"), "language", F.col("kept").alias("sample_count"), "weight_modifier",
        F.coalesce("quality_boost", F.lit(0.0)).alias("quality_boost"), F.col("keywords").alias("target_keywords"), "file_patterns", kept.alias("filter_stats"),
        F.col("mean_quality").alias("avg_quality_score"), F.col("mean_relevance").alias("avg_relevance_score"),
    )
    return rows.select("language", F.to_json(meta).alias("meta"))


SIDECAR_SCHEMA = "priority string, tags array<string>, sample_count long, quality_boost double, avg_quality_score double, filter_stats struct<total:long,kept:long,ratio:double>"


def top(scored_rows: DataFrame, n: int, min_quality: float = 0.5) -> DataFrame:
    """Per language the n best by combined score, ties to the larger row id."""
    w = Window.partitionBy("language").orderBy(F.desc("combined"), F.desc("row_id"))
    return scored_rows.where(F.col("quality") >= min_quality).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def statistics(scored_rows: DataFrame, min_quality: float = 0.5) -> DataFrame:
    keep = F.col("quality") >= min_quality
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return scored_rows.groupBy("language").agg(
        F.count("*").alias("total"), F.count_if(keep).alias("kept"), F.round(F.count_if(keep) / F.count("*"), 6).alias("ratio"),
        zero(F.avg(F.when(keep, F.col("quality")))).alias("mean_quality"), zero(F.min(F.when(keep, F.col("quality")))).alias("min_quality"),
        zero(F.max(F.when(keep, F.col("quality")))).alias("max_quality"), zero(F.avg(F.when(keep, F.col("relevance")))).alias("mean_relevance"),
    )
