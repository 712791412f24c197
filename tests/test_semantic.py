"""Similar pairs with pruning, and entity edges with hot entities, against plain loops."""

from __future__ import annotations

from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest

from weftline.operators import semantic


def clustered(n, clusters, dims=16, spread=0.05, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dims))
    return centres[rng.integers(0, clusters, n)] + spread * rng.normal(size=(n, dims))


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")


def brute(x, threshold):
    u = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-10)
    score = u @ u.T
    return {(i, j): score[i, j] for i, j in combinations(range(len(x)), 2) if score[i, j] >= threshold}


@pytest.mark.parametrize(("threshold", "block_rows"), [(0.9, 2048), (0.9, 16), (0.2, 7), (-1.0, 16), (0.0, 50)])
def test_similar_pairs_are_all(spark, threshold, block_rows):
    x = np.vstack([clustered(150, 12), np.tile(clustered(1, 1), (40, 1)), np.zeros((2, 16))])
    found = semantic.similar_pairs(frame(spark, x), threshold, block_rows).collect()
    want = brute(x, threshold)
    near = {p for p, s in want.items() if abs(s - threshold) < 1e-9}  # rounding may go either way there
    got = {(r.a, r.b): r.score for r in found}
    assert len(got) == len(found) and set(got) - near == set(want) - near
    assert all(abs(got[p] - want[p]) < 1e-9 for p in got if p in want)


def test_best_pairs_are_the_best(spark):
    x = clustered(200, 20, spread=0.3)
    found = semantic.similar_pairs(frame(spark, x), 0.1, 16, best=25).orderBy("score", ascending=False).limit(25).collect()
    want = sorted(brute(x, 0.1).values(), reverse=True)[:25]
    assert np.allclose([r.score for r in found], want)


def test_few_pairs_are_multiplied_on_clusters(spark):
    x = clustered(2000, 40)
    c = semantic.cells(frame(spark, x), 256)
    work, every = semantic.pair_work(c, 0.9), 2000 * 1999 / 2
    assert len(brute(x, 0.9)) <= work < 0.15 * every
    assert semantic.pair_work(c, -1.0) == every


def test_no_vectors(spark):
    none = frame(spark, np.zeros((0, 4)))
    assert semantic.similar_pairs(none, 0.5).count() == 0 and semantic.similar_pairs(none, 0.5, best=3).count() == 0


def test_entity_edges(spark):
    rows = [(d, e) for d in range(60) for e in {f"e{d % 7}", f"r{d // 3}", "all", f"x{d}"}]
    found = semantic.entity_edges(spark.createDataFrame(rows, "doc_id long, entity string"), hot=8).collect()
    docs = defaultdict(set)
    for d, e in rows:
        docs[e].add(d)
    pairs = defaultdict(set)
    for e, members in docs.items():
        if len(members) <= 8:
            for p in combinations(sorted(members), 2):
                pairs[p].add(e)
    assert {(r.a, r.b): set(r.shared) for r in found if r.kind == "pair"} == pairs
    members = {(r.a, r.b, r.shared[0], r.links) for r in found if r.kind == "member"}
    assert members == {(min(m), d, e, len(m) - 1) for e, m in docs.items() if len(m) > 8 for d in m}


def test_shared_entities_shuffle_no_pairs(spark):
    rows = [(d, e) for d in range(60) for e in {f"e{d % 7}", f"r{d // 3}", "all", f"x{d % 2}"}]
    ents = spark.createDataFrame(rows, "doc_id long, entity string")
    docs = defaultdict(set)
    for d, e in rows:
        docs[d].add(e)
    for least in (1, 2, 3):
        found = semantic.shared_entities(ents, least)
        want = {(a, b): sorted(docs[a] & docs[b]) for a, b in combinations(docs, 2) if len(docs[a] & docs[b]) >= least}
        rows_found = found.collect()
        assert {(r.a, r.b): r.shared for r in rows_found} == want and len(rows_found) == len(want)
        assert "Aggregate [a#" not in found._jdf.queryExecution().optimizedPlan().toString()  # pairs aren't made twice and dropped again


def test_shared_entities_in_blocks(spark, monkeypatch):
    """Groups of entities cut in blocks and pairs in slices, sets of one to fourteen words that go on over batches, and ids that are text."""
    monkeypatch.setattr(semantic, "GROUP_ROWS", 7)
    monkeypatch.setattr(semantic, "MET", 5)
    rng = np.random.default_rng(4)
    docs = {f"d{i:03}": {f"wörd{w}" for w in rng.integers(0, 16, rng.integers(1, 15))} for i in range(90)}
    ents = spark.createDataFrame([(d, w) for d, ws in docs.items() for w in ws] + [(None, "wörd1"), ("d000", None)], "doc_id string, entity string")
    for least in (1, 4):
        found = semantic.shared_entities(ents, least)
        want = {(a, b): sorted(docs[a] & docs[b]) for a, b in combinations(docs, 2) if len(docs[a] & docs[b]) >= least}
        rows_found = found.collect()
        assert {(r.a, r.b): r.shared for r in rows_found} == want and len(rows_found) == len(want)
        assert all(r.weight == len(r.shared) for r in rows_found)
        assert "array_intersect" not in found._jdf.queryExecution().optimizedPlan().toString()  # not pair by pair


def test_entities_shuffle_texts_once(spark):
    texts = spark.createDataFrame([(1, "alpha alpha gamma delta"), (2, None), (3, "Alpha ALPHA omega")], "doc_id long, text string")
    found = semantic.entities(texts)
    assert {(r.doc_id, r.entity) for r in found.collect()} == {(1, "alpha"), (1, "gamma"), (1, "delta"), (3, "alpha"), (3, "omega")}
    assert semantic.entities(texts)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_entity_edges_shuffle_no_pairs(spark):
    ents = spark.createDataFrame([(1, "a"), (2, "a")], "doc_id long, entity string")
    plan = semantic.entity_edges(ents)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [a#" not in plan


def test_visits_in_slices_are_all(spark):
    c = semantic.cells(frame(spark, clustered(400, 10)), 4)
    met = semantic.visits(c, -1.0)
    assert semantic.SENT < met.count() == met.distinct().count() and met.where("resident").count() == 400
    assert semantic.pair_work(c, -1.0) == 400 * 399 / 2
