"""Recursive queries over edges (parent, child): by level, or depth first in pre- or postorder.

A round joins the frontier with the edges. A frontier is kept in memory or on disk for the next round; every few
rounds it is written to the shared checkpoint folder, so that plans stay short at any depth.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraql.sources.tables import kept

#: Rounds between checkpoints, and between those that also write what was found; a multiple.
ROUNDS, MERGED = 8, 64


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def descend(edges: DataFrame, roots: DataFrame, parent: str, child: str, most: int | None = None) -> DataFrame:
    """node, level and path (from its root) of all nodes reached from roots (column node); cycles are not followed.

    Goes on until no node is new, or to level ``most`` if that is given.
    """
    frontier = roots.select(F.col("node"), F.lit(0).alias("level"), F.array("node").alias("path"))
    parts, level = [[frontier]], 0  # found and not merged yet; merged once, twice and so on
    edge = edges.select(F.col(parent).alias("_p"), F.col(child).alias("_c"))
    while most is None or level < most:
        level += 1
        step = frontier.join(edge, frontier["node"] == edge["_p"]).where(~F.array_contains("path", F.col("_c")))
        frontier = step.select(F.col("_c").alias("node"), F.lit(level).alias("level"), F.concat("path", F.array("_c")).alias("path"))
        frontier = kept(frontier) if level % ROUNDS == 0 else frontier.persist()
        if frontier.isEmpty():
            break
        parts[0].append(frontier)
        n = 0
        while level % MERGED == 0 and len(parts[n]) >= MERGED:
            merged = kept(_union(parts[n]))
            for part in parts[n]:
                part.unpersist()
            parts[n] = []
            n += 1
            if n == len(parts):
                parts.append([])
            parts[n].append(merged)
    return _union([part for group in parts for part in group])


def level_order(found: DataFrame) -> DataFrame:
    return found.orderBy("level", "path")


def preorder(found: DataFrame) -> DataFrame:
    """Parents before their children: a path sorts before its extensions."""
    return found.orderBy("path")


def postorder(found: DataFrame, largest: int = 2**63 - 1) -> DataFrame:
    """Children before their parent: an end mark above every node closes each path."""
    return found.orderBy(F.concat("path", F.array(F.lit(largest))))
