"""Connected components by contraction, in rounds that grow with the logarithm of the longest path."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..lineage import cut


def _lowered(edges: DataFrame, towards_all: bool) -> DataFrame:
    """Every node's neighbours (all, or the lesser ones only) linked to the least of them and itself."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if towards_all else edges
    least = both.groupBy("a").agg(F.min("b").alias("_least")).select("a", F.least("a", "_least").alias("_least"))
    joined = both.join(least, "a")
    far = joined.filter(F.col("b") > F.col("a")) if towards_all else joined
    moved = far.select(F.col("b").alias("a"), F.col("_least").alias("b"))
    if not towards_all:
        moved = moved.unionByName(least.select("a", F.col("_least").alias("b")))
    return moved.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b): the least node reachable, itself included.

    Large and small stars alternate until no edge moves: all neighbours of a node hang on its least one, then all lesser ones do. Both are a
    combining minimum and a join, so a node with very many edges is never gathered; adaptive execution splits its join. Nodes may be of any type
    that has an order, structs too; a node without another (a = b) is its own component, null ends are left out.
    """
    whole = edges.select("a", "b").filter("a is not null and b is not null")
    alone = whole.filter("a = b").select("a").distinct()
    links = cut(whole.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        moved = cut(_lowered(_lowered(links, True), False))
        still = moved.count() == links.count() and links.join(moved, ["a", "b"], "left_anti").isEmpty()
        links = moved
        if still:
            break
    hung = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = links.select("b").unionByName(alone.select(F.col("a").alias("b"))).distinct().select(F.col("b").alias("node"), F.col("b").alias("component"))
    return hung.unionByName(roots.join(hung, "node", "left_anti"))
