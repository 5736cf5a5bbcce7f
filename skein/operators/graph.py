"""Traces of any length over edges, cycles included."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.sources.tables import discard, written


def reached(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(start, node, depth) for each seed (start) and each node that it reaches over edges (src, dst), itself at depth 0; depth is the least number of edges.

    A frontier is joined to the edges until it finds nothing new. Each round writes only the pairs that are new; those known are kept apart by an anti-join,
    so cycles end. Rounds follow the depth; `closure` takes its logarithm.
    """
    edges = written(edges.select("src", "dst").distinct(), "edges")
    rounds = [written(seeds.select("start", F.col("start").alias("node"), F.lit(0).alias("depth")).distinct(), "reached")]
    while rounds[-1].limit(1).count():
        known = rounds[0]
        for r in rounds[1:]:
            known = known.unionByName(r)
        step = rounds[-1].join(edges.hint("merge"), F.col("node") == F.col("src")).select("start", F.col("dst").alias("node")).distinct()
        rounds.append(written(step.join(known.select("start", "node").hint("merge"), ["start", "node"], "left_anti").withColumn("depth", F.lit(len(rounds))), "reached"))
    out = rounds[0]
    for r in rounds[1:-1]:
        out = out.unionByName(r)
    return out


def closure(edges: DataFrame) -> DataFrame:
    """(src, dst) for each pair of nodes of which the first reaches the second over one edge or more.

    Each round joins all pairs to each other, so paths double and rounds follow the logarithm of the longest; it ends when the number of pairs stays.
    """
    pairs, n = written(edges.select("src", "dst").distinct(), "pairs"), -1
    while (now := pairs.count()) != n:
        n = now
        ahead = pairs.select(F.col("src").alias("dst"), F.col("dst").alias("to"))
        longer = pairs.join(ahead.hint("merge"), "dst").select("src", F.col("to").alias("dst"))
        more = written(pairs.unionByName(longer).distinct(), "pairs")
        discard(pairs)
        pairs = more
    return pairs
