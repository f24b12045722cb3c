"""Connected components by alternating large-star and small-star over a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored

MAX_ROUNDS = 60


def _star(edges: DataFrame, large: bool, tag: str) -> Stored:
    """One star step on stored undirected edges (u > v). The minima are stored before the join, so both of its sides are
    plain scans and a node with very many edges can be split as a skewed join."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both if large else edges.select("u", "v")
    least = Stored(near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), f"{tag}-min")
    if large:
        linked = both.where("v > u").join(least.df, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        linked = near.join(least.df, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.df.select("u", F.col("m").alias("v")))
    out = Stored(linked.where("u > v").distinct(), tag)
    least.drop()
    return out


def connected_components(edges: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v: long); component is the smallest node reachable.

    Large-star links every larger neighbour of a node to its least neighbour, small-star the others; both keep
    connectivity, and at the fixed point every edge leads to the smallest node of its component. Each step is written to
    the shared folder. Self-loops and null ends are ignored, repeated edges count once; no edges give no rows.
    """
    edges = edges.where("u is not null and v is not null and u <> v")
    now = Stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    for _ in range(max_rounds):
        large = _star(now.df, True, "large")
        small = _star(large.df, False, "small")
        large.drop()
        now.drop()
        now = small
        stamp = now.df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if stamp == mark:
            break
        mark = stamp
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = now.df
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
