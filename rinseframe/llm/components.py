"""Connected components by stars, all in joins and grouped minima.

Each round links every node's larger neighbours to its smallest one, then its smaller
neighbours (Kiveris et al., "Connected Components in MapReduce and Beyond"); the edges end
as stars around the smallest node of each component. Every round's edges are stored, so a
lost executor costs one round at most. Minima are pre-aggregated before the shuffle, and
joins on hot nodes can be split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinseframe.llm.frames import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node that is not the smallest of its component.

    ``edges`` has columns ``a`` and ``b``; directions, repeats and loops do not matter.
    """
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    current, state = settled(down, scratch)
    while True:
        large, _ = settled(large_star(current), scratch)
        following, after = settled(small_star(large), scratch)
        scratch.drop(current, large)
        current, before, state = following, state, after
        if before == after:
            return scratch.renamed(current, current.select(F.col("u").alias("node"), F.col("v").alias("root")))


def settled(edges: DataFrame, scratch: Scratch) -> tuple[DataFrame, tuple]:
    table = scratch.stored(edges, "edges")
    mark = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    return table, tuple(table.agg(F.count("*"), mark).first())


def large_star(edges: DataFrame) -> DataFrame:
    """(u, v), u > v: link each larger neighbour of a node to the node's smallest neighbour or itself."""
    smallest = edges.groupBy(F.col("u").alias("m_node")).agg(F.min("v").alias("smallest"))
    larger = edges.select(F.col("v").alias("node"), F.col("u").alias("far"))
    linked = larger.join(smallest, F.col("node") == F.col("m_node"), "left")
    rows = linked.select(F.col("far").alias("u"), F.coalesce("smallest", "node").alias("v"))
    return rows.distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """(u, v), u > v: link each smaller neighbour of a node, and the node, to the smallest of them."""
    smallest = edges.groupBy(F.col("u").alias("m_node")).agg(F.min("v").alias("smallest"))
    linked = edges.join(smallest, F.col("u") == F.col("m_node"))
    others = linked.where("v <> smallest").select(F.col("v").alias("u"), F.col("smallest").alias("v"))
    return others.union(smallest.select(F.col("m_node").alias("u"), F.col("smallest").alias("v"))).distinct()


def labelled(nodes: DataFrame, node: str, stars: DataFrame, name: str) -> DataFrame:
    """Add the component of each row's node: its root, or itself."""
    roots = stars.select(F.col("node").alias("star_node"), F.col("root").alias("star_root"))
    found = nodes.join(roots, F.col(node) == F.col("star_node"), "left")
    return found.withColumn(name, F.coalesce("star_root", node)).drop("star_node", "star_root")
