"""Connected components of an edge list by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apexframe.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of longs -> ``(node, root)``, root the smallest node reachable; nodes without an edge are absent.

    Each round hooks every node to its smallest neighbour, then replaces the edges by those between the
    hooks. A node that is not the smallest of its neighbourhood disappears, so the edges shrink at least by
    half of the nodes per round. The hooks of all rounds, composed backwards, give the roots. Every round is
    written to the shared folder. An empty edge list gives an empty result.
    """
    edges = stored(edges.where("a <> b").select("a", "b").distinct(), "edges")
    hooks = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min("b").alias("m"))
        hook = stored(near.select(F.col("a").alias("node"), F.least("a", "m").alias("up")), "hooks")
        hooks.append(hook)
        left = edges.join(hook.select(F.col("node").alias("a"), F.col("up").alias("x")), "a")
        right = left.join(hook.select(F.col("node").alias("b"), F.col("up").alias("y")), "b")
        edges = stored(right.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    if not hooks:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = hooks[-1].select("node", F.col("up").alias("root"))
    for hook in reversed(hooks[:-1]):
        higher = roots.select(F.col("node").alias("up"), "root")
        roots = hook.join(higher, "up", "left").select("node", F.coalesce("root", "up").alias("root"))
    return roots
