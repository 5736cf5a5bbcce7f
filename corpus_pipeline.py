"""A training corpus from raw documents: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skein.llm import bpe_stream, decontam_gst, pii_crf, simhash_grid, toxicity_ws
from skein.llm.common import shared_dir
from skein.llm.queries import table, tokenizer_path


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the classifier does not call toxic. Null and empty texts stay, repeated rows fare alike."""
    return toxicity_ws.keep_clean(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of the least id, of each group of near copies; null ids come last. All null, empty and wordless texts are one group."""
    return simhash_grid.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds no benchmark item; null and empty texts hold none."""
    return decontam_gst.clean(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, personal data replaced by its kind; a null text stays null."""
    return pii_crf.redact(docs, pii_crf.fit(docs))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids) of every row; a null text counts as empty."""
    return bpe_stream.encode_documents(docs, tokenizer_path("byte_bpe_50k.json"), with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("pii", pii),
    ("bpe", bpe),
]

#: The stages learn and search on the data, which SQL can't express; tests/llm/test_pipeline.py holds run() against the same decisions in plain Python, for
#: which it takes the classifier's and compares groups by all pairs, tiles by full search, spans by one scan a pattern, and tokens by the library.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents. Columns of documents beyond doc_id and text pass through all stages but the last; an empty table gives an empty result."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
