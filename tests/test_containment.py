"""The containment index against walks over plain parent pointers."""

from __future__ import annotations

import numpy as np
import pytest

from weftline.operators import graph

EDGE = "source string, target string, place long"


def check(spark, edges):
    found = {r.id: r for r in graph.containment_index(spark.createDataFrame(edges, EDGE)).collect()}
    parent = {}
    for s, t, p in edges:
        parent[t] = min(parent.get(t, (s, p)), (s, p))
    nodes = {n for s, t, _ in edges for n in (s, t)}

    def ancestors(n):
        out = []
        while n in parent:
            n = parent[n][0]
            out.append(n)
        return out

    up = {n: ancestors(n) for n in nodes}
    assert set(found) == nodes and sorted(r.entry for r in found.values()) == list(range(len(nodes)))
    for n in nodes:
        assert found[n].depth == len(up[n]) and found[n].parent == (up[n][0] if up[n] else None)
        assert {m for m in nodes if found[n].entry < found[m].entry <= found[n].exit} == {m for m in nodes if n in up[m]}
    below = {(r.ancestor, r.descendant, r.depth) for r in graph.descendants(graph.containment_index(spark.createDataFrame(edges, EDGE))).collect()}
    assert below == {(a, n, i + 1) for n in nodes for i, a in enumerate(up[n])}
    return found


def test_random_forests(spark):
    rng = np.random.default_rng(4)
    for n, deep in ((60, False), (40, True)):
        edges = [(f"n{i - 1 if deep and i % 10 else int(rng.integers(0, i))}", f"n{i}", int(rng.integers(0, 3))) for i in range(1, n) if i % 17]
        check(spark, edges)


def test_siblings_go_by_place_and_a_hot_parent(spark):
    found = check(spark, [("r", f"c{i:03}", 300 - i) for i in range(300)] + [("c005", "x", 0), ("other", "y", 1)])
    assert [found[f"c{i:03}"].entry for i in (299, 298, 297)] == [found["r"].entry + 1 + k for k in range(3)] and found["x"].entry == found["c005"].entry + 1


def test_several_parents_cycles_and_nothing(spark):
    found = {r.id: r for r in graph.containment_index(spark.createDataFrame([("b", "c", 0), ("a", "c", 5), (None, "z", 0)], EDGE)).collect()}
    assert found["c"].parent == "a" and found["b"].exit == found["b"].entry and "z" not in found
    assert graph.containment_index(spark.createDataFrame([], EDGE)).count() == 0
    graph_rounds, graph.MOST_ROUNDS = graph.MOST_ROUNDS, 4
    try:
        with pytest.raises(ValueError, match="cycle"):
            graph.containment_index(spark.createDataFrame([("a", "b", 0), ("b", "a", 0)], EDGE))
    finally:
        graph.MOST_ROUNDS = graph_rounds
