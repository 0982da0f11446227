"""Connected components over tables of links, for groups of any size.

Every node points at its least neighbour, pointers are followed until they rest, each tree becomes
one node, and what links are left between trees are taken through the same steps. Each step is a
grouped minimum, which pre-aggregates, or a join of written tables, whose hot keys can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadaster.llm.shared import saved


def _rest(pointers: DataFrame) -> DataFrame:
    """node, root: pointers (node, root) followed to their ends."""
    while True:
        ahead = pointers.select(F.col("node").alias("root"), F.col("root").alias("next"))
        pointers = saved(pointers.join(ahead, "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "pointers")
        if pointers.where("moved").isEmpty():
            return pointers.drop("moved")


def components(links: DataFrame) -> DataFrame:
    """node, root of every node of links (a, b); root is the least node of its component."""
    out = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        trees = _rest(saved(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("root")), "trees"))
        out = trees if out is None else saved(_moved(out, trees), "roots")
        end = lambda side: trees.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root"))  # noqa: B023, E731
        left = links.join(end("a"), "a").join(end("b"), "b").select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).where("a <> b").distinct()
        links = saved(left, "links")
        if links.isEmpty():
            return out


def _moved(labels: DataFrame, roots: DataFrame) -> DataFrame:
    """labels (node, root) with each root replaced by its own root, where it has one."""
    own = roots.select(F.col("node").alias("root"), F.col("root").alias("next"))
    return labels.join(own, "root", "left").select("node", F.coalesce("next", "root").alias("root"))


def unite(labels: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """labels (node, root) after adding links (a, b) between nodes; None stands for every node by itself."""
    if links.isEmpty():
        return labels
    if labels is None:
        return components(links)
    named = between(labels, links).select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).where("a <> b").distinct()
    named = saved(named, "named")
    if named.isEmpty():
        return labels
    roots = components(named)
    # nodes that have no label yet are their own roots
    unseen = roots.join(labels, "node", "left_anti")
    return saved(_moved(labels, roots).unionByName(unseen), "labels")


def between(labels: DataFrame | None, pairs: DataFrame) -> DataFrame:
    """pairs (a, b, ...) with a_root and b_root."""
    for side in ("a", "b"):
        if labels is None:
            pairs = pairs.withColumn(f"{side}_root", F.col(side))
        else:
            own = labels.select(F.col("node").alias(side), F.col("root").alias("own"))
            pairs = pairs.join(own, side, "left").withColumn(f"{side}_root", F.coalesce("own", side)).drop("own")
    return pairs
