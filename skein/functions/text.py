"""Text functions: stripping, chunks, hashes, metrics, extraction from JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK, OVERLAP = 800, 80
_BLANK = r"^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$"


def strip(text: Column) -> Column:
    """Without white space (ASCII) at both ends; trim() would know spaces alone."""
    return F.regexp_replace(text, _BLANK, "")


def chunks(text: Column, size: int = CHUNK, overlap: int = OVERLAP) -> Column:
    """Windows of size characters, each overlapping the one before; the last is the first to reach the end. Stripped; empty ones stay, as ''."""
    step = size - overlap
    n = F.length(text)
    count = F.greatest(F.ceil((n - overlap) / F.lit(step)), F.lit(1)).cast("int")
    starts = F.sequence(F.lit(0), (count - 1) * step, F.lit(step))
    return F.transform(starts, lambda s: strip(F.substring(text, s + 1, F.lit(size))))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def cache_key(namespace: str, key: Column) -> Column:
    return F.concat(F.lit(namespace + ":"), F.md5(key))


def preview(text: Column, n: int = 300) -> Column:
    return F.left(text, F.lit(n))


def keyword_hits(text: Column, keywords: Column) -> Column:
    """How many keywords occur somewhere in the lower-cased text, both lower-cased."""
    # the text is lower-cased once, outside the lambda over keywords
    found = F.transform(F.array(F.lower(text)), lambda t: F.size(F.filter(keywords, lambda k: F.contains(t, F.lower(k)))))
    return F.element_at(found, 1)


def alphanum_fraction(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", "")) / F.nullif(F.length(text), F.lit(0))


def line_lengths(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), F.length)


def avg_line_length(text: Column) -> Column:
    lines = line_lengths(text)
    return F.aggregate(lines, F.lit(0.0), lambda a, x: a + x) / F.size(lines)


def max_line_length(text: Column) -> Column:
    return F.array_max(line_lengths(text))


def token_count(text: Column) -> Column:
    """Words parted by white space, an estimate of tokens."""
    return F.when(strip(text) == "", 0).otherwise(F.size(F.split(strip(text), r"\s+")))


def memory_text(line: Column) -> Column:
    """The text of a JSON line: content.text, else a string content, else an object or array content as JSON, else its top-level
    strings joined by ' | ' in the order of the line. Null for blank, malformed and scalar lines and a null content."""
    v = F.try_parse_json(line)
    is_object = F.schema_of_variant(v).startswith("OBJECT")
    keys = F.json_object_keys(line)
    fields = F.from_json(line, "map<string,variant>")
    strings = F.filter(keys, lambda k: F.schema_of_variant(F.element_at(fields, k)) == "STRING")
    joined = F.array_join(F.transform(strings, lambda k: F.element_at(fields, k).cast("string")), " | ")
    has_content = F.array_contains(keys, "content")
    own = F.coalesce(F.try_variant_get(v, "$.content.text", "string"), F.try_variant_get(v, "$.content", "string"))
    return F.when(is_object, F.when(has_content, own).otherwise(F.nullif(joined, F.lit(""))))
