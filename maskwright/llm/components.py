"""Connected components of an edge table, by alternating large-star and small-star
steps.  Every step is one table in the shared folder.  What a node is joined with is
stored before, so that adaptive execution can split the rows of a hot node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage

MOST_STEPS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of its neighbourhood."""
    both = edges.unionByName(edges.selectExpr("b as a", "a as b"))
    least = storage.stored(both.groupBy("a").agg(F.min("b").alias("m")).selectExpr("a", "least(a, m) as m"), "least")
    return both.where("b > a").join(least, "a").selectExpr("b as a", "m as b").where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    down = edges.selectExpr("greatest(a, b) as a", "least(a, b) as b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").selectExpr("b as a", "m as b")
    return moved.unionByName(least.selectExpr("a", "m as b")).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one edge down and none up, or only edges up: then each
    component is a star around its smallest node."""
    ends = edges.selectExpr("a as node", "1 as down", "0 as up").unionByName(edges.selectExpr("b as node", "0 as down", "1 as up"))
    both = ends.groupBy("node").agg(F.sum("down").alias("down"), F.sum("up").alias("up"))
    return not both.where("down > 1 or down > 0 and up > 0").take(1)


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` to (node, component): the smallest node of each component, for
    every node that has an edge to another.  An empty table gives an empty one."""
    now = storage.stored(edges.where("a <> b").select("a", "b"), "edges")
    for _ in range(MOST_STEPS):
        now = storage.stored(_small_star(_large_star(now)), "edges")
        if _settled(now):
            break
    else:
        raise RuntimeError(f"components did not settle in {MOST_STEPS} steps")
    return now.selectExpr("a as node", "b as component").unionByName(now.selectExpr("b as node", "b as component").distinct())
