"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortweave.session import materialize

MAX_ROUNDS = 60


def connected_components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the least node it reaches) for every node of ``edges`` (a, b).

    Each round hangs neighbours under the least node of a neighbourhood, first
    the greater ones, then the lesser ones, until the edges are stars around the
    roots; that takes a number of rounds of the order of log(nodes).  Least nodes are
    found by an aggregate that reduces before its shuffle, and are written before they
    are joined, so both sides of that join are plain shuffles, which
    adaptive execution splits where a node has very many edges.  Every round is
    written to the shared folder: lineage stays short and lost executors cost one round.
    Edges from a node to itself, and null ends, are ignored.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = materialize(edges.filter("a <> b").distinct(), "component-edges")
    for _ in range(MAX_ROUNDS):
        if _are_stars(now):
            stars = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
            roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            return stars.unionByName(roots)
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(_least(both), "a").filter("b > a").select(F.col("b").alias("a"), F.col("root").alias("b"))
        large = materialize(large.distinct(), "component-edges")
        small = large.join(_least(large), "a")
        small = small.select(F.col("b").alias("a"), F.col("root").alias("b")).unionByName(
            small.select("a", F.col("root").alias("b"))
        )
        now = materialize(small.filter("a <> b").distinct(), "component-edges")
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")


def _least(edges: DataFrame) -> DataFrame:
    """The least node among each ``a`` and its neighbours."""
    least = edges.groupBy("a").agg(F.min("b").alias("root"))
    return materialize(least.select("a", F.least("a", "root").alias("root")), "component-least")


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one edge down, or only edges up."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(
        edges.select(F.col("b").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up"))
    )
    nodes = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return nodes.filter("down > 1 OR (down = 1 AND up = 1)").isEmpty()
