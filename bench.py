"""Seconds of the headline queries: one run to warm up, then the median of three. Prints one JSON line."""

from __future__ import annotations

import json
import os
import time
from functools import partial
from statistics import median

from pyspark.sql import SparkSession

from skein.catalog import QUERIES
from skein.operators import ann, ranking
from skein.plans import base
from skein.sources.tables import folder

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = ["rk1_fused_ranking", "so2_knn_many_queries", "sc17_chunks", "rk4_curation", "ag1_engagement", "ag4_percentiles", "jn7_impact_trace", "jn12_span_overlap", "st5_windows"]
#: Search in stored lists: the index is built once, beforehand.
STORED = "an1_probed_stored_lists"


def stored_lists(spark):
    """A function that searches stored lists, with as many probes as give a mean recall of 0.9, and its recall."""
    corpus, asked = base.corpus_vectors(spark, SF_DIR), base.query_vectors(spark, SF_DIR)
    index = ann.Index.build(corpus, folder(spark, "lists"))
    exact = ranking.knn(corpus, asked, 10)
    nprobe = index.calibrated(asked, exact)
    found = ann.recall(index.knn(asked, 10, nprobe), exact, 10).agg({"recall": "avg"}).first()[0]
    return lambda: index.knn(asked, 10, nprobe), round(found, 3), nprobe


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    search, recall, nprobe = stored_lists(spark)
    for name in [*HEADLINE, STORED]:
        make = search if name == STORED else partial(QUERIES[name], spark, SF_DIR)
        runs = []
        for _ in range(4):
            began = time.time()
            make().write.format("noop").mode("overwrite").save()
            runs.append(time.time() - began)
        seconds[name] = round(median(runs[1:]), 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "recall": recall, "nprobe": nprobe, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
