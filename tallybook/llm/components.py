"""Connected components of an edge table, as joins and grouped minima with the lineage cut in each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, stored


def _roots(links: DataFrame) -> DataFrame:
    """(node, root): each node's pointer to its smallest neighbour, followed to its end by doubling."""
    both = links.union(links.select("b", "a"))
    tree = stored(both.groupBy("a").agg(F.least("a", F.min("b")).alias("root")).withColumnRenamed("a", "node"), "tree")
    while True:
        up = tree.select(F.col("node").alias("up"), F.col("root").alias("top"))
        step = stored(
            tree.join(up, F.col("root") == F.col("up")).select("node", F.col("top").alias("root"), (F.col("top") != F.col("root")).alias("moved")),
            "tree",
        )
        forget(tree)
        tree, moved = step, step.filter("moved").limit(1).count()
        if not moved:
            return tree.select("node", "root")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): for each node of ``edges`` (a long, b long) the smallest node reachable from it.

    Each round points every node at its smallest neighbour, follows the pointers to their roots and
    replaces the edges by edges between roots; at least half of the nodes that still have an edge go in a
    round. Only edges and nodes with links are held; a hub's rows meet only in map-side minima and in
    joins that adaptive execution may split. Edges with a null end or equal ends say nothing.
    """
    links = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a is not null and b is not null and a < b").distinct(), "links")
    maps: list[DataFrame] = []
    while links.limit(1).count():
        roots = _roots(links)
        maps.append(roots)
        left = roots.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        fresh = links.join(left, "a").join(right, "b").filter("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        old, links = links, stored(fresh, "links")
        forget(old)
    if not maps:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = maps[0]
    for m in maps[1:]:
        up = m.select(F.col("node").alias("root"), F.col("root").alias("top"))
        out = out.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return out.select("node", F.col("root").alias("component"))
