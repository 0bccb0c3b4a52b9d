"""Connected components by alternating large-star and small-star steps over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraql.llm.shared import cut


def components(edges: DataFrame) -> DataFrame:
    """Edges (u, v) to rows (node, root): root is the smallest node that each node of an edge reaches.

    Minima are aggregated before the shuffle and joined back, so a node of very many edges is never
    gathered. Each round is cut from its lineage in the shared folder; no edge comes to the driver.
    """
    state = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    while seen[0]:
        both = state.union(state.select("v", "u"))
        least = cut(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")))  # as a table, so that a hub's edges can be split
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u")
        small = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        state = cut(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        now = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    roots = state.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(state.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
