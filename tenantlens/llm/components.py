"""Distributed union-find: connected components by alternating stars.

Large-star links every larger neighbour of a node to the node's smallest
neighbour, small-star links the smaller ones. Each step is a minimum per node
joined back to the links, so no task holds a component; the minima are staged,
which lets adaptive execution split a hub in the join. Each round is written to
the shared folder, so a lost executor costs a task, not the history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tenantlens.llm.common import stage


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node with a link; root is the smallest node reachable.

    Self-links and null ends are ignored, repeated links count once, and an
    empty input gives an empty result. Nodes may be of any orderable type.
    """
    x, y = F.col(a), F.col(b)
    e = stage(links.where((x != y)).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct())
    seen = _sign(e)
    while seen[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stage(both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m")))
        large = stage(both.where("v > u or u > v").join(low, "u").where("v > u")
                      .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = stage(large.groupBy("u").agg(F.min("v").alias("m")))
        e = stage(large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                  .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = _sign(e)
        if now == seen:
            break
        seen = now
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def _sign(e: DataFrame) -> tuple:
    """Number of links and a sum of their hashes: equal when a round changed nothing."""
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
