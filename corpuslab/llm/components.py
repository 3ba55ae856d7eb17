"""Connected components of a graph that is held in DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import durable


def _neighbours(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both, least


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (u, v long): component is the smallest node reachable.

    Alternates large-star and small-star steps until nothing changes; each step's minimum is a partial aggregate, so
    that a node with very many neighbours costs no single task its whole list, and the joins on it are plain ones whose hot
    partitions adaptive execution splits. Every round is written to the shared
    folder. Loops and repeated edges are allowed; no edges give an empty result.
    """
    now = durable(edges.select(F.col("u").cast("long"), F.col("v").cast("long")).filter("u <> v").distinct(), "edges")
    seen = None
    while True:
        both, least = _neighbours(now)
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        joined = down.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        now = durable(small.filter("u <> v").distinct(), "edges")
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == seen:
            break
        seen = state
    roots = now.groupBy("v").agg(F.lit(1)).select(F.col("v").alias("node"), F.col("v").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
