"""Connected components of an undirected graph of ids, in joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _roots(parents: DataFrame, rows: int) -> DataFrame:
    """node and root from node and parent (never larger than the node), ``rows`` at most: parents' parents until none changes."""
    held = parents
    while True:
        ahead = parents.select(F.col("node").alias("parent"), F.col("parent").alias("next"))
        jumped = common.written(common.joined(parents, ahead, "parent", rows=rows).select("node", F.col("next").alias("parent"), (F.col("next") != F.col("parent")).alias("moved")))
        common.drop(held)
        held, parents = jumped, jumped.select("node", "parent")
        if not jumped.where("moved").limit(1).count():
            return parents.withColumnRenamed("parent", "root")


def components(edges: DataFrame) -> DataFrame:
    """node and component (the smallest node reachable) for every node of ``edges`` (u, v).

    Each round points every node at its smallest neighbour, follows the pointers to their
    roots and contracts the edges to roots; edges inside a root go, so rounds shrink fast.
    Loops and repeated edges are allowed; rows with a null are dropped; no edges give no rows.
    Tables of nodes are as large as the graph, so none of many nodes is broadcast.
    """
    some = edges.where("u IS NOT NULL AND v IS NOT NULL")
    left = common.written(some.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    labels = None
    while (n := left.count()) or labels is None:
        low = left.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("parent"))
        ends = left.select(F.col("u").alias("node"), F.col("u").alias("parent")).union(low)
        roots = _roots(common.written(ends.groupBy("node").agg(F.min("parent").alias("parent"))), 2 * n)
        if labels is None:
            labels = roots.withColumnRenamed("root", "component")
        else:
            moved = common.joined(labels, roots.select(F.col("node").alias("component"), "root"), "component", "left", rows=2 * n)
            labels = common.written(moved.select("node", F.coalesce("root", "component").alias("component")))
        a = roots.select(F.col("node").alias("u"), F.col("root").alias("a"))
        b = roots.select(F.col("node").alias("v"), F.col("root").alias("b"))
        joined = common.joined(common.joined(left, a, "u", rows=2 * n), b, "v", rows=2 * n).where("a <> b")
        left = common.written(joined.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
    return labels
