"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014).

``components(edges)`` takes edges (a, b) of long nodes and returns (node, label) with the smallest
node of each component, for nodes that have an edge. Each step is a grouped minimum and a join, so a
hub's edges are never gathered by one task beyond a map-side minimum; no step emits pairs of a
node's neighbours. Steps write to the shared folder, which cuts lineage, and stop at a fixed point.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from townsheet.llm.common import forget, saved


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link neighbours to the smallest node around; edges hold a > b once."""
    if large:  # neighbours larger than the node
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        out = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:  # smaller neighbours, and the node itself
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        near = edges.join(least, "a")
        out = near.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    now = saved(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    for _ in range(most_rounds):
        after = saved(_star(_star(now, True), False), "edges")
        new = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        forget(now)
        now = after
        if new == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
        mark = new
    raise RuntimeError(f"no fixed point after {most_rounds} rounds")
