"""Document-array payloads: elements to rows, and what is rejected with its reason."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.sources.tables import written


def documents(payloads: DataFrame, longest: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """accepted (payload_id, place, id, text) and rejected (payload_id, place, reason, raw) of payloads (payload_id, payload), each a JSON array of objects with id and text.

    Each element is judged by itself: one that is bad takes no other with it. A payload that is no JSON, or no array, is rejected whole, with place null.
    Elements are parsed once and written; both frames read that.
    """
    v = payloads.select("payload_id", "payload", F.expr("try_parse_json(payload)").alias("v"))
    kind = F.when(F.col("payload").isNull(), "no payload").when(F.col("v").isNull(), "malformed").when(~F.expr("schema_of_variant(v)").startswith("ARRAY"), "not an array")
    v = v.withColumn("whole", kind)
    bad = v.where("whole IS NOT NULL").select("payload_id", F.lit(None).cast("int").alias("place"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("text"), F.col("whole").alias("reason"), F.col("payload").alias("raw"))
    each = v.where("whole IS NULL").select("payload_id", F.posexplode(F.expr("CAST(v AS ARRAY<VARIANT>)")).alias("place", "e"))
    each = each.withColumns({"kind": F.expr("schema_of_variant(e)"), "raw": F.expr("to_json(e)")})
    is_object = F.col("kind").startswith("OBJECT")
    # a field of another type than text is told from one that is missing
    field = lambda f: F.when(is_object, F.expr(f"try_variant_get(e, '$.{f}', 'variant')"))
    each = each.withColumns({"i": field("id"), "t": field("text")})
    text = F.when(F.expr("schema_of_variant(t)") == "STRING", F.expr("CAST(t AS STRING)"))
    each = each.withColumns({"id": F.expr("CAST(i AS STRING)"), "text": text})
    reason = (
        F.when(~F.coalesce(is_object, F.lit(False)), "not an object").when(F.col("id").isNull(), "no id").when(F.col("t").isNull() | (F.expr("schema_of_variant(t)") == "VOID"), "no text")
        .when(F.col("text").isNull(), "text is no string").when(F.trim("text") == "", "empty text").when(F.length("text") > longest, "text too long")
    )
    rows = written(each.select("payload_id", "place", "id", "text", reason.alias("reason"), "raw").unionByName(bad), "payloads")
    return rows.where("reason IS NULL").select("payload_id", "place", "id", "text"), rows.where("reason IS NOT NULL").select("payload_id", "place", "reason", "raw")
