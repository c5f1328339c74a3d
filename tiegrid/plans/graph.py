"""Connected components as a loop of Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiegrid.plans.work import join_on_hot_keys, materialize

MAX_ROUNDS = 60


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges (u, v) with u > v."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    large = join_on_hot_keys(both, least, "u", "n").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    large = materialize(large, "components-large")  # four readers below
    low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    others = join_on_hot_keys(large, low, "u", "n").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.union(low.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v); component is its smallest node.

    Alternates large-star and small-star steps (Kiveris et al. 2014) until the
    edges no longer change; only their count and checksum reach the driver.
    Minima are pre-aggregated; the edges of a node with very many of them are
    joined to its minimum where they are (``join_on_hot_keys``), not in one
    task. Self links and null ends are ignored.
    """
    now = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    seen = None
    for _ in range(MAX_ROUNDS):
        now = materialize(_stars(now), "components")
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen:
            break
        seen = tuple(mark)
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
