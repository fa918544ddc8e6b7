"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

#: A node with more edges than this gets its least neighbour by a broadcast; there are at most edges / HUB such nodes.
HUB = 100_000


def _with_least(edges: DataFrame) -> DataFrame:
    """(a, b, m): each edge with the least b of its a. A hub's edges are not brought to one task."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    hubs = F.broadcast(least.filter(F.col("n") > HUB).select("a", "m"))
    rest = edges.join(hubs.select("a"), "a", "left_anti").join(least.filter(F.col("n") <= HUB).select("a", "m"), "a")
    return rest.unionByName(edges.join(hubs, "a"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _with_least(both).filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    moved = _with_least(edges).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
    return moved.distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Edges (a, b) of longs to (node, component): the smallest node reachable.

    Only nodes with an edge are returned. Loops and repeated edges are ignored; no edge gives no row. Each round
    writes its edges to the shared folder, so lost executors cost one round at most; the rounds grow with the
    logarithm of the longest path, not with the number of nodes. It ends when a round changes no edge.
    """
    edges = edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = materialize(edges.distinct(), "edges")
    size = edges.count()
    for _ in range(max_rounds):
        if not size:
            break
        new = materialize(_small_star(_large_star(edges)), "edges")
        before, size = size, new.count()
        same = before == size and new.join(edges, ["a", "b"], "left_anti").isEmpty()
        discard(edges)
        edges = new
        if same:
            break
    else:
        raise RuntimeError("components did not settle")
    leaves = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return leaves.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
