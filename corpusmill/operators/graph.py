"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.session import cut_lineage


# nodes whose rows never meet in one task are at most 2 * HUBS, whatever the size of the table
HUBS = 10_000
LEAST_HUB = 128


def _with_smallest(edges: DataFrame, n_edges: int) -> DataFrame:
    """(u, v, m): every row (u, v) with the smallest v of its u.

    The nodes with very many neighbours are so few that they go to every task with their smallest neighbour: the rows of
    a hub are never brought together. All other rows meet their node's smallest neighbour by a join.
    """
    most = max(LEAST_HUB, n_edges // HUBS)
    smallest = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    hubs = F.broadcast(smallest.filter(F.col("n") > most).select("u", F.col("m").alias("hub_m")))
    marked = edges.join(hubs, "u", "left")
    at_hubs = marked.filter("hub_m IS NOT NULL").select("u", "v", F.col("hub_m").alias("m"))
    others = marked.filter("hub_m IS NULL").select("u", "v").join(smallest.filter(F.col("n") <= most).select("u", "m"), "u")
    return at_hubs.union(others.select("u", "v", "m"))


def _large_star(edges: DataFrame, n_edges: int) -> DataFrame:
    """Every node hands its larger neighbours to the smallest node it knows."""
    both = edges.select("u", "v").union(edges.select("v", "u"))
    smallest = F.least("m", "u")
    return _with_smallest(both, 2 * n_edges).filter("v > u").select(F.col("v").alias("u"), smallest.alias("v")).distinct()


def _small_star(edges: DataFrame, n_edges: int) -> DataFrame:
    """Every node hands itself and its smaller neighbours to the smallest of them."""
    moved = _with_smallest(edges, n_edges).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(edges.groupBy("u").agg(F.min("v").alias("v"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    """Order-free mark of an edge table, to see whether a round changed anything."""
    folded = F.expr("bit_xor(xxhash64(u, v))")
    return tuple(edges.agg(F.count("*"), folded).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``; a component is named by its smallest node.

    Alternating large-star and small-star rounds: the edge table never grows beyond its first size, the rows of
    a node with many neighbours stay where they are, and rounds grow with the logarithm of the
    longest chain. Every round is checkpointed, so that the loss of an executor costs one round.
    """
    up, down = F.greatest("a", "b"), F.least("a", "b")
    now = cut_lineage(edges.filter("a <> b").select(up.alias("u"), down.alias("v")).distinct())
    mark = _mark(now)
    while True:
        n_edges = mark[0]
        now = cut_lineage(_small_star(_large_star(now, n_edges), n_edges))
        before, mark = mark, _mark(now)
        if before == mark:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
