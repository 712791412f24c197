"""The stored graph: hops without moving edges, and the same rows as over loose edges."""

from __future__ import annotations

import re

import parity
import pytest

from weftline.operators import graph, stored_graph


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    nodes = spark.createDataFrame([(f"n{i}", "Even" if i % 2 == 0 else "Odd") for i in range(200)], "id string, label string")
    edges = spark.createDataFrame(
        [(f"e{i}", f"n{i * 7 % 200}", f"n{i * i % 200}", "REFERENCES" if i % 3 else "OTHER", None if i % 5 == 0 else i / 10) for i in range(600)] + [("gone", "n1", "unknown", "REFERENCES", 1.0)],
        "edge_id string, source string, target string, rel_type string, weight double",
    )
    return nodes, edges, stored_graph.store(nodes, edges, str(tmp_path_factory.mktemp("graph")), buckets=8)


def edge_scans(plan):
    """For each scan of a bucketed table, the operators between it and the first join above it."""
    lines = [(len(m[1]), m[2]) for m in re.finditer(r"^([ :+\-*]*)(.*)$", plan, re.M) if m[2]]
    for i, (depth, text) in enumerate(lines):
        if "Bucketed: true" in text:
            above, at = [], depth
            for d, t in reversed(lines[:i]):
                if d < at:
                    at = d
                    above.append(t)
                    if "Join" in t:
                        break
            yield above


def test_hops_dont_shuffle_edges(spark, stored):
    nodes, edges, g = stored
    seeds = nodes.where("id IN ('n0', 'n1', 'n7', 'n14')").select("id")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = stored_graph.expand_twice(seeds, g, nodes)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    scans = list(edge_scans(plan))
    assert len(scans) == 2 and all("Join" in above[-1] for above in scans)
    assert not any("Exchange" in t for above in scans for t in above), plan


def test_hops_give_the_same_rows(spark, stored):
    nodes, edges, g = stored
    known = edges.where("target <> 'unknown'")
    seeds, active = nodes.where("id IN ('n0', 'n1', 'n7', 'n14')").select("id"), nodes.where("label = 'Even' OR id < 'n5'").select("id")
    rows = lambda df: [tuple(r) for r in df.collect()]
    assert rows(stored_graph.expand(seeds, g, active, 50)) == rows(graph.expand(seeds, known, active, 50))
    assert rows(stored_graph.expand_twice(seeds, g, active, 500)) == rows(graph.expand_twice(seeds, known, active, 500))
    assert g.edges.where("other = 'unknown'").count() == 0 and g.nodes.count() == 200
    triples = {(r.source_label, r.rel_type, r.target_label): r.n for r in stored_graph.schema_triples(g).collect()}
    assert sum(triples.values()) == 600


def test_buckets_grow_in_number(spark, tmp_path, monkeypatch):
    from weftline.operators import stored_graph

    monkeypatch.setattr(stored_graph, "BUCKET_ROWS", 10)
    nodes = spark.range(101).selectExpr("CAST(id AS STRING) AS id", "'N' AS label")
    edges = spark.range(100).selectExpr("CAST(id AS STRING) AS edge_id", "CAST(id AS STRING) AS source", "CAST(id + 1 AS STRING) AS target", "'NEXT' AS rel_type", "1.0D AS weight")
    stored = stored_graph.store(nodes, edges, str(tmp_path / "g"))
    assert stored.edges.count() == 200 and len(stored.edges.inputFiles()) > stored_graph.BUCKETS


def test_trade_near_its_nodes_only(spark, sf, monkeypatch):
    whole = graph.with_inverse(graph.trade(spark, sf))
    ids = spark.createDataFrame([("p7",), ("p7",), ("c11",), ("c1",), ("p0",), ("other",)], "id string")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    near = rows(graph.trade_near(spark, sf)(ids))
    assert near == rows(whole.where("source IN ('p7', 'c11', 'c1', 'p0')")) and {r[1][0] for r in near} == {"p", "c"}
    monkeypatch.setattr(graph, "SHARE_ROWS", 100)
    small = graph.trade(spark, sf)
    assert small.rdd.getNumPartitions() > 50 and rows(graph.with_inverse(small)) == rows(whole)
    with monkeypatch.context() as m:
        m.setattr(graph, "trade", None)  # the hops build no whole graph
        from weftline.plans import catalogue

        for name in ("graph_expand_1hop", "graph_expand_2hop"):
            parity.compare(catalogue.queries()[name](spark, sf), catalogue.oracle_sql()[name], sf)
