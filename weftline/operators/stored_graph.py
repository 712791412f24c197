"""The property graph as stored tables: edges in both directions bucketed by node, nodes partitioned by label.

A hop joins the frontier to the edges' buckets, so edges are never shuffled, however many hops; only the frontier moves. Each edge row
carries the labels of both ends, so the schema's triples are one count over one table.

Defined cases: an edge whose ends aren't both known nodes isn't stored; a node known under several labels is stored under each, and its
edges carry the least; a null weight stays null until it is read; empty tables store an empty graph.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.registry import Registry
from ..sources.tables import kept, scratch
from . import graph
from .graph import DEFAULT_WEIGHT, TRAVERSED

registry = Registry()

#: Buckets of the edges at least, and rows of a bucket: a task writes and reads one, so buckets grow in number, not in size.
BUCKETS, BUCKET_ROWS = 16, 500_000


@dataclass(frozen=True)
class StoredGraph:
    """``edges``: node, other, forward, edge_id, rel_type, weight, node_label and other_label; ``nodes``: id and label."""

    edges: DataFrame
    nodes: DataFrame


def store(nodes: DataFrame, edges: DataFrame, path: str, name: str | None = None, buckets: int | None = None) -> StoredGraph:
    """Store ``nodes`` (id, label) and ``edges`` (edge_id, source, target, rel_type, weight) below ``path``.

    The edges become a table of the session's catalogue, ``name``, as bucketing is known to tables only; its files are in ``path``.
    There are ``buckets`` buckets, or as many as hold BUCKET_ROWS rows each, BUCKETS at least.
    """
    spark, name = nodes.sparkSession, name or f"edges_{uuid.uuid4().hex}"
    nodes.select("id", "label").write.partitionBy("label").parquet(f"{path}/nodes")
    known = nodes.groupBy("id").agg(F.min("label").alias("label"))
    end = lambda c: known.select(F.col("id").alias(c), F.col("label").alias(f"{c}_label"))
    told = kept(edges.select("edge_id", "source", "target", "rel_type", "weight").join(end("source"), "source").join(end("target"), "target"))
    buckets = buckets or max(BUCKETS, -(-2 * told.count() // BUCKET_ROWS))
    way = lambda a, b, forward: F.struct(F.col(a).alias("node"), F.col(b).alias("other"), F.lit(forward).alias("forward"), F.col(f"{a}_label").alias("node_label"), F.col(f"{b}_label").alias("other_label"))
    both = told.select("edge_id", "rel_type", "weight", F.explode(F.array(way("source", "target", True), way("target", "source", False))).alias("w"))
    rows = both.select("w.node", "w.other", "w.forward", "edge_id", "rel_type", "weight", "w.node_label", "w.other_label")
    # One task writes one bucket whole, so there is a file a bucket.
    rows.repartition(buckets, "node").write.bucketBy(buckets, "node").sortBy("node").option("path", f"{path}/edges").format("parquet").saveAsTable(name)
    return StoredGraph(spark.table(name), spark.read.schema("id string, label string").parquet(f"{path}/nodes"))


def expand(seeds: DataFrame, stored: StoredGraph, active: DataFrame, limit: int = 24, rel_types: tuple[str, ...] = TRAVERSED) -> DataFrame:
    """One hop from ``seeds`` (id) to ``active`` nodes (id), as ``graph.expand`` has it."""
    found = seeds.select(F.col("id").alias("node")).distinct().join(_traversed(stored, rel_types), "node").join(_ends(active), "other")
    rows = found.select(F.col("node").alias("seed"), F.col("other").alias("id"), "rel_type", F.coalesce("weight", F.lit(DEFAULT_WEIGHT)).alias("weight")).distinct()
    return rows.orderBy(F.desc("weight"), "rel_type", "id", "seed").limit(limit)


def expand_twice(seeds: DataFrame, stored: StoredGraph, active: DataFrame, limit: int = 16, rel_types: tuple[str, ...] = TRAVERSED) -> DataFrame:
    """Two hops over different edges, ending away from the seed; the weight is the second edge's."""
    one = seeds.select(F.col("id").alias("node")).distinct().join(_traversed(stored, rel_types), "node")
    one = one.select(F.col("node").alias("seed"), F.col("edge_id").alias("first"), F.col("rel_type").alias("r1"), F.col("other").alias("node"))
    two = one.join(_traversed(stored, rel_types), "node").where("edge_id <> first AND other <> seed").join(_ends(active), "other")
    weight = F.coalesce("weight", F.lit(DEFAULT_WEIGHT)).alias("weight")
    rows = two.select("seed", F.col("other").alias("id"), F.concat("r1", F.lit("->"), "rel_type").alias("rel_type"), weight).distinct()
    return rows.orderBy(F.desc("weight"), "rel_type", "id", "seed").limit(limit)


def _ends(active: DataFrame) -> DataFrame:
    """The nodes that a hop may end at, once each: an inner join stays above the hop, while the optimizer puts a semi-join below it, on all edges."""
    return active.select(F.col("id").alias("other")).distinct()


def _traversed(stored: StoredGraph, rel_types: tuple[str, ...]) -> DataFrame:
    return stored.edges.where(F.col("rel_type").isin(*rel_types)).select("node", "other", "edge_id", "rel_type", "weight")


def schema_triples(stored: StoredGraph) -> DataFrame:
    """source_label, rel_type, target_label and n, from the edges alone."""
    forward = stored.edges.where("forward")
    return forward.groupBy(F.col("node_label").alias("source_label"), "rel_type", F.col("other_label").alias("target_label")).agg(F.count("*").alias("n"))


def _trade(spark: SparkSession, sf_dir: str) -> StoredGraph:
    edges = graph.trade(spark, sf_dir)
    ends = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    return store(ends.select("id", F.when(F.col("id").startswith("p"), "Part").otherwise("Customer").alias("label")), edges, scratch(spark))


@registry.add(graph.registry.sql["graph_expand_1hop"])
def graph_stored_1hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expand(graph._seeds(spark, sf_dir), _trade(spark, sf_dir), graph._active(spark, sf_dir))


@registry.add(graph.registry.sql["graph_expand_2hop"])
def graph_stored_2hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two hops over the stored graph of parts and customers."""
    return expand_twice(graph._seeds(spark, sf_dir), _trade(spark, sf_dir), graph._active(spark, sf_dir))


@registry.add(graph.registry.sql["graph_schema_triples"])
def graph_stored_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The triples of the graph of sources, documents and sections."""
    edges = graph.edges(spark, sf_dir).withColumns({"edge_id": F.concat_ws("-", "source", "rel_type", "target"), "weight": F.lit(None).cast("double")})
    return schema_triples(store(graph.nodes(spark, sf_dir), edges, scratch(spark)))
