"""Near-duplicates, neighbours and the trained operators against brute force, planted cases and held-out rows."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from weftline.llm import ann, common, graph, language_id, near_dedup, quality_model, quality_rules, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, width):
    words = WORD.findall((text or "").translate(LOWER))
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute_components(texts, width, percent=80):
    sets = {d: shingle_set(t, width) for d, t in texts.items()}
    top = {d: d for d in texts}

    def root(d):
        while top[d] != d:
            d = top[d]
        return d

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                top[y] = x
    return {d: (len(sets[d]), root(d)) for d in ids}


def test_near_duplicates_equal_brute_force(spark, sf, rows):
    found = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in queries.op4_near_dedup(spark, sf).collect()}
    assert found == {d: (n, c, c == d) for d, (n, c) in brute_components(rows, 4).items()}


def test_near_duplicates_in_small_regions_and_blocks(spark):
    """Chains of edits around 0.8 with bounds so small that regions deepen and clumps are cut in blocks."""
    rng = random.Random(5)
    texts, n = {}, 0
    for _ in range(6):
        words = [f"w{rng.randrange(5000)}" for _ in range(120)]
        for _ in range(25):
            texts[n], n = " ".join(words), n + 1
            for _ in range(rng.choice((0, 1, 3))):
                words[rng.randrange(120)] = f"w{rng.randrange(5000)}"
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = near_dedup.near_duplicates(df, 4, 80, region_rows=4, block_shingles=1500).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute_components(texts, 4)


def test_near_duplicate_candidates_are_whole_runs(spark):
    """Rows alone beyond their third value, in runs longer than a region, and a run that borders of partitions cut."""
    rows, runs = [], {}
    for tree in range(2):
        for run in range(3):
            for k in range(40):
                label = np.array([run, 7, 7, k, k, k, k, k] if run else [0, 7, 7, k % 2, 0, 0, 0, k // 20], ">u4")
                rows.append((tree * 1000 + run * 100 + k, tree, label.tobytes()))
                runs[rows[-1][0]] = tree * 1000 + run * 100
    forest = spark.createDataFrame(rows, "doc_id long, tree int, label binary")
    for most in (4, 10_000):
        found = graph.components(near_dedup._candidate_edges(forest, most)).collect()
        assert {r.node: r.component for r in found} == runs


def test_near_duplicates_outside_a_dense_family(spark):
    """Documents at 0.80 to 0.85 to a family of more than region_rows near copies."""
    rng = random.Random(11)
    base = [f"w{i}" for i in range(400)]
    texts = {n: " ".join([*base, f"own{n}"]) for n in range(40)}
    for n in range(40, 60):  # 9 to 10 words changed far apart: 36 to 40 of 397 shingles
        words, at = [*base], rng.sample(range(4, 396, 8), 9 + n % 2)
        for i in at:
            words[i] = f"x{n}_{i}"
        texts[n] = " ".join(words)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = near_dedup.near_duplicates(df, 4, 80, region_rows=4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute_components(texts, 4)


def test_near_duplicates_in_a_clump_of_many_blocks(spark):
    """A large family, a smaller one beside it, and documents alone, all of one run of candidates cut in blocks."""
    rng = random.Random(3)
    common_words = [f"c{i}" for i in range(60)]
    texts, n = {}, 0
    for family, size in ((0, 60), (1, 12), (2, 1), (3, 1), (4, 1)):
        words = [*common_words, *[f"f{family}_{i}" for i in range(60)]]
        for _ in range(size):
            own = [*words]
            own[rng.randrange(120)] = f"x{n}"
            texts[n], n = " ".join(own), n + 1
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for block in (400, 2500):
        found = near_dedup.near_duplicates(df, 4, 80, block_shingles=block).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute_components(texts, 4)


def test_near_duplicates_of_one_id_with_several_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(50)) for x in "abc")
    rows = [(3, a), (5, a), (5, b), (9, b), (7, c), (7, b), (8, None), (8, c), (20, "else")]
    found = {(r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()}
    assert found == {(3, 3, True), (5, 3, False), (9, 3, False), (7, 3, False), (8, 3, False), (20, 20, True)}


def test_near_duplicates_broadcast_no_table_of_many_rows(spark, monkeypatch):
    """Tables of ids grow with the documents: none of many rows goes whole through the driver, however small its files are."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    texts = [" ".join(f"w{i % 7}_{j}" for j in range(40)) for i in range(30)] + [" ".join([f"w{i % 7}_{j}" for j in range(39)] + ["else"]) for i in range(30)]
    rows = [*enumerate(texts), (3, texts[4])]
    near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 80, region_rows=4, block_shingles=50).collect()
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    runs = store.executionsList(before, store.executionsCount() - before)
    plans = [runs.apply(i).physicalPlanDescription() for i in range(runs.size())]
    assert sum("SortMergeJoin" in p for p in plans) > 3 and not any("BroadcastExchange" in p for p in plans)


def test_near_duplicates_odd_rows(odd, empty):
    found = near_dedup.near_duplicates(odd, 4).collect()
    assert len(found) == odd.count()
    by = {r.doc_id: r for r in found}
    assert by[3].component_id == by[4].component_id == 3 and by[6].component_id == by[7].component_id == 6
    assert all(by[d].n_shingles == 0 and by[d].kept for d in (0, 1, 2, 11))
    assert by[None].component_id is None
    assert near_dedup.near_duplicates(empty).count() == 0


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 9), (5, 5), (None, 1), *[(i, i + 1) for i in range(100, 160)]]
    found = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8, 5: 5, **{i: 100 for i in range(100, 161)}}


def brute_nearest(table, every, k):
    ok = {i: np.array(v, float) for i, v in table if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in ok:
        if q % every == 0:
            out[q] = sorted((float(np.sqrt(((ok[q] - v) ** 2).sum())), i) for i, v in ok.items() if i != q)[:k]
    return out


def recall(found, exact):
    hits = sum((r["query_id"], r["vec_id"]) in {(r["query_id"], i) for _, i in exact[r["query_id"]]} for r in found)
    return hits / sum(map(len, exact.values()))


def test_neighbours_reach_recall_with_exact_scores(spark, sf):
    table = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    found = [r.asDict() for r in queries.op5_ann(spark, sf).collect()]
    exact = brute_nearest(table, 100, 10)
    assert set(exact) == {r["query_id"] for r in found} and recall(found, exact) >= 0.9
    vectors = {i: np.array(v, float) for i, v in table}
    for r in found:
        assert r["score"] == pytest.approx(float(np.sqrt(((vectors[r["query_id"]] - vectors[r["vec_id"]]) ** 2).sum())), abs=1e-12)
    for q in exact:
        mine = sorted((r["rank"], r["score"], r["vec_id"]) for r in found if r["query_id"] == q)
        assert [m[0] for m in mine] == list(range(1, len(mine) + 1)) and [m[1:] for m in mine] == sorted(m[1:] for m in mine)


def test_neighbours_over_many_shards(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16)) * 4
    data = [(i, (centres[i % 20] + rng.normal(size=16)).tolist()) for i in range(3000)]
    found = [r.asDict() for r in ann.nearest(spark.createDataFrame(data, "vec_id long, embedding array<double>"), every=100, shard_rows=500).collect()]
    assert len(found) == 300 and recall(found, brute_nearest(data, 100, 10)) >= 0.9


def test_neighbours_odd_vectors(spark):
    data = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [float("inf"), 1.0]), (7, [2.0]), (None, [1.0, 1.0]), (100, [0.0, 1.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumn("rank", F.lit("x"))
    found = {(r.query_id, r["rank"], r.vec_id): r.score for r in ann.nearest(df).collect()}
    assert found == {(0, 1, 1): 0.0, (0, 2, 100): pytest.approx(2**0.5), (100, 1, 0): pytest.approx(2**0.5), (100, 2, 1): pytest.approx(2**0.5)}
    assert ann.nearest(df.where(F.lit(False))).count() == 0


def test_neighbours_of_repeated_rows_and_large_vectors(spark):
    rng = np.random.default_rng(5)
    for size in (1.0, 2.0**100, 2.0**-100, 1e300):
        data = [(i, (rng.normal(size=8) * size).tolist()) for i in range(300)]
        extra = [data[0]] * 3 + [data[7]] * 40 + [(9, (np.array(data[0][1]) * (1 + j / 1000)).tolist()) for j in range(1, 60)]
        found = ann.nearest(spark.createDataFrame(data + extra, "vec_id long, embedding array<double>")).collect()
        vectors = [(i, np.array(v) / size) for i, v in data + extra]
        for q in (0, 100, 200):
            best = {}
            for i, v in vectors:
                if i != q:
                    d = min(float(np.sqrt(((v - w) ** 2).sum())) for j, w in vectors if j == q)
                    best[i] = min(d, best.get(i, math.inf))
            exact = [i for i in sorted(best, key=best.get)[:10]]
            mine = sorted((r["rank"], r.vec_id, r.score / size) for r in found if r.query_id == q)
            assert [m[0] for m in mine] == list(range(1, 11)) and len(set(exact) & {m[1] for m in mine}) >= 9
            assert all(m[2] == pytest.approx(best[m[1]]) for m in mine)


def test_language_of_held_out_documents(spark, docs, sf):
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    found = queries.op6_language_id(spark, sf).collect()
    assert Counter(r.doc_id for r in found) == Counter(list(truth))
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in found)
    apart = [r for r in found if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in apart) >= 0.9 * len(apart)


def plain_prediction(model, text):
    """The vote of every pair of families, then of every pair of languages in the winner, one dot product at a time."""
    x = [float(v) for v in language_id.features(text)]
    score, chosen = 1.0, ""
    for level in ("", None):
        names = model.groups["" if level == "" else chosen + ":"]
        won, total, least = {n: 0 for n in names}, {n: 0.0 for n in names}, {n: math.inf for n in names}
        for i, a in enumerate(names):
            for b in names[i + 1 :]:
                row = model.place["" if level == "" else chosen + ":", a, b]
                margin = sum(w * v for w, v in zip(model.weights[row].tolist(), x, strict=True) if v) + float(model.offsets[row])
                won[a if margin >= 0 else b] += 1
                for n, own in ((a, margin), (b, -margin)):
                    total[n] += own
                    least[n] = min(least[n], own)
        best = sorted(names, key=lambda n: (-won[n], -total[n]))[0]
        score *= 1.0 if len(names) == 1 else 1 / (1 + math.exp(-4 * least[best]))
        chosen = best
    return chosen, score


def test_language_votes_equal_a_plain_count(docs, rows):
    model = language_id.fit(docs.select("doc_id", "text", "lang"))
    some = [t for t in rows.values() if t and any(c.isalpha() for c in t)][:60]
    for text in some:
        (lang, score), (plain, expected) = model.predict(text), plain_prediction(model, text)
        assert lang == plain and abs(score - expected) < 1e-4


def test_pair_training_equals_the_plain_steps():
    """Pegasos with averaging, number by number."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(14, 5))
    y = np.where(rng.random(14) < 0.4, 1.0, -1.0)
    w, b, t, kept, mean_w, mean_b = [0.0] * 5, 0.0, 0, 0, [0.0] * 5, 0.0
    side = {1.0: 2 * float((y < 0).mean()), -1.0: 2 * float((y > 0).mean())}
    order = np.random.default_rng(7)
    for epoch in range(language_id.PASSES):
        for i in order.permutation(14):
            t += 1
            rate = 1 / (language_id.LAMBDA * (t + 1000))
            short = y[i] * (sum(p * q for p, q in zip(x[i], w, strict=True)) + b) < 1
            w = [v * (1 - rate * language_id.LAMBDA) for v in w]
            if short:
                w = [v + rate * side[y[i]] * y[i] * p for v, p in zip(w, x[i], strict=True)]
                b += 0.01 * rate * side[y[i]] * y[i]
        if epoch >= language_id.PASSES // 2:
            mean_w, mean_b, kept = [p + q for p, q in zip(mean_w, w, strict=True)], mean_b + b, kept + 1
    mean_w, mean_b = [v / kept for v in mean_w], mean_b / kept
    scale = float(np.median([abs(sum(p * q for p, q in zip(r, mean_w, strict=True)) + mean_b) for r in x]))
    got_w, got_b = language_id.train_pair(x, y)
    assert np.allclose(got_w, np.array(mean_w) / scale, rtol=1e-4, atol=1e-5) and abs(got_b - mean_b / scale) < 1e-4


def test_too_many_languages_are_an_error(spark, monkeypatch):
    rows = [(i, f"some words {chr(97 + i)}", f"x{i}") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df)
    assert model.langs == sorted(f"x{i}" for i in range(12))
    monkeypatch.setattr(language_id, "MOST_MACHINES", 20)
    with pytest.raises(ValueError, match="machines"):
        language_id.fit(df)


def test_language_odd_rows(odd, empty, docs):
    model = language_id.fit(docs.select("doc_id", "text", "lang"))
    found = language_id.identify(odd, model).collect()
    assert len(found) == odd.count()
    assert all(r.lang_pred == "und" and r.score == 0 for r in found if not (r.text or "").strip())
    assert language_id.fit(empty) is None
    assert {r.lang_pred for r in language_id.identify(odd, None).collect()} == {"und"}
    assert language_id.identify(empty, model).count() == 0


def test_pipeline_drops_texts_in_no_learned_language(spark, docs, sf):
    strange = [
        "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью",
        "人人生而自由,在尊严和权利上一律平等。他们赋有理性和良心",
        "xqzv wkjpt zzrq bvnm qqq xkcd plmkj wqx zxcvb njkl " * 5,
        "1234 5678",
    ]
    own = docs.select("doc_id", "text", "lang", "source", "n_chars")
    extra = spark.createDataFrame([(-1 - i, t, None, "s", len(t)) for i, t in enumerate(strange)], own.schema)
    found = Counter(r.doc_id for r in corpus_pipeline.identify_language(spark, own.union(extra), sf).collect())
    assert found == Counter(r.doc_id for r in own.where(F.col("text").rlike(language_id.LETTER)).collect())


def test_pipeline_stages_keep_columns_of_any_name(spark, sf):
    """Columns with the names that the stages use inside come back with their own values."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    names = "score _score kept told row _row plan copies copy hash size node component_id".split()
    odd = docs.withColumns({c: F.concat(F.lit(c + " "), F.col("doc_id").cast("string")) for c in names})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, odd, sf)
        assert found.columns == odd.columns, name
        rows = found.collect()
        assert rows, name
        assert all(r[c] == f"{c} {r.doc_id}" for r in rows for c in names), name


def test_pipeline_keeps_one_row_of_each_group(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    data = [(5, a), (5, a), (3, a + " end"), (7, b), (7, c), (8, c), (None, b), (None, "one two three"), (None, "one two three"), (9, "...")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    found = corpus_pipeline.drop_near_duplicates(spark, df, "").collect()
    assert Counter(map(tuple, found)) == Counter([(3, a + " end"), (7, b), (7, c), (None, "one two three"), (9, "...")])


def brute_statistics(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_rule_statistics_and_base_rule(spark, sf, rows, odd, empty):
    for r in queries.op7_quality_rules(spark, sf).collect():
        expected = brute_statistics(rows[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expected
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    judged = quality_rules.judge(odd, []).collect()
    texts = Counter(brute_statistics(r.text) for r in odd.collect())
    assert Counter((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in judged) == texts
    assert quality_rules.judge(empty, []).count() == 0


def test_repeated_word_windows(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(12))) + rng.choice(["", "\n", "\n\na a\na a"]) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality_rules.statistics(df).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_statistics(texts[r.doc_id])


def test_rules_find_a_planted_threshold(spark):
    rng = random.Random(3)
    data = []
    for i in range(600):
        bad = i % 3 == 0
        words = [f"w{rng.randrange(400)}" + ("#" if bad and rng.random() < 0.5 else "") for _ in range(80)]
        data.append((i, " ".join(words), 0 if bad else 1))
    df = spark.createDataFrame(data, "doc_id long, text string, quality int")
    rules = quality_rules.fit(df.select("doc_id", "text"), df.select("doc_id", "quality"))
    kept = {r.doc_id: r.kept for r in quality_rules.judge(df, rules).collect()}
    assert rules and all(kept[i] == (q == 1) for i, _, q in data)


def test_rules_of_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_rules.judge(empty, quality_rules.fit(empty, labels)).count() == 0


def test_rules_without_labels(docs, spark):
    labels = spark.createDataFrame([(None, 1), (1, None)], "doc_id long, quality int")
    assert quality_rules.fit(docs.select("doc_id", "text"), labels) == []


def test_weak_labels_agree_with_true_ones(spark, sf, docs):
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    found = {r.doc_id: r for r in queries.op8_quality_model(spark, sf).collect()}
    assert len(found) == docs.count()
    assert sum(found[d].kept == (q == 1) for d, q in truth.items()) >= 0.9 * len(truth)


def test_quality_odd_rows(odd, empty, docs):
    scorer = quality_model.fit(docs.select("doc_id", "text"))
    found = quality_model.classify(odd, scorer).collect()
    assert len(found) == odd.count() and all(0 <= r.score <= 1 for r in found)
    assert all(not r.kept and r.score == 0 for r in found if not (r.text or "").strip())
    assert quality_model.classify(empty, quality_model.fit(empty)).count() == 0
    assert all(r.score == 0 for r in quality_model.classify(odd, quality_model.fit(empty)).collect())


def test_estimation_equals_the_plain_rounds():
    """Expectation-maximisation over votes of whole texts, one probability at a time."""
    rng = random.Random(8)
    k, m = len(quality_model.LABELLERS), 40
    counts = Counter(sum(rng.choice((0, 0, 1, 2)) * 3**j for j in range(k)) for _ in range(m))
    texts = [quality_model.digits(p) for p, n in counts.items() for _ in range(n)]
    junk = [(0.5 if 2 in v else 0.95) if 1 in v else 0.02 for v in texts]
    prior = ((0.02, 0.02, 0.005), (0.02, 0.001, 0.02))
    for _ in range(quality_model.EM_ROUNDS):
        share = min(0.6, max(0.001, sum(junk) / m))
        rates = []
        for side, p in ((junk, prior[0]), ([1 - x for x in junk], prior[1])):
            of_side = max(0.01, sum(side) / m)
            mass = [[sum(w for w, v in zip(side, texts, strict=True) if v[j] == vote) / m + p[vote] * of_side for vote in range(3)] for j in range(k)]
            rates.append([[x / sum(row) for x in row] for row in mass])
        now = []
        for v in texts:
            odds = math.log(share / (1 - share)) + sum(math.log(rates[0][j][v[j]] / rates[1][j][v[j]]) for j in range(k))
            now.append(1 / (1 + math.exp(-max(-30, min(30, odds)))))
        done = max(abs(a - b) for a, b in zip(now, junk, strict=True)) < 1e-6
        if done:
            break
        junk = now
    model = quality_model.estimate(dict(counts))
    assert np.allclose(model[0], rates[0], atol=1e-6) and np.allclose(model[1], rates[1], atol=1e-6) and abs(model[2] - share) < 1e-9
    for pattern in counts:
        v = quality_model.digits(pattern)
        sound, bad = (1 - share) * math.prod(rates[1][j][v[j]] for j in range(k)), share * math.prod(rates[0][j][v[j]] for j in range(k))
        assert abs(quality_model.posterior(pattern, model) - sound / (sound + bad)) < 1e-6


def test_scorer_training_lowers_the_loss_like_plain_descent():
    """The trained scorer's regularised loss is at most a little above that of many plain gradient steps."""
    rng = np.random.default_rng(2)
    x = rng.random((80, 6)).astype(np.float32)
    y = np.clip((x @ np.array([3, -2, 0, 1, 0, -1]) > 0.6) + rng.normal(0, 0.05, 80), 0, 1)
    weight = [0.5 / max(1, sum((z >= 0.5) == (v >= 0.5) for z in y)) for v in y]

    def loss(w):
        p = [1 / (1 + math.exp(-(sum(a * b for a, b in zip(r, w[:-1], strict=True)) + w[-1]))) for r in x.tolist()]
        return -sum(c * (v * math.log(q) + (1 - v) * math.log(1 - q)) for c, v, q in zip(weight, y, p, strict=True)) + quality_model.DECAY / 2 * sum(a * a for a in w)

    w = np.zeros(7)
    full = np.concatenate([x, np.ones((80, 1))], 1)
    for _ in range(20_000):
        w -= 2.0 * (full.T @ (np.array(weight) * (1 / (1 + np.exp(-full @ w)) - y)) + quality_model.DECAY * w)
    assert loss(quality_model.train(x, y).tolist()) <= loss(w.tolist()) + 0.02


def test_estimation_finds_the_accuracies():
    """Votes drawn from known rates: the estimate tells a good labeller from a poor one."""
    rng = np.random.default_rng(4)
    junk = rng.random(20_000) < 0.2
    counts = Counter()
    for j in junk:
        p = 0
        for k in range(4):
            p += (1 if rng.random() < ((0.9 if k < 3 else 0.3) if j else 0.02) else 0) * 3**k
        counts[p] += 1
    rates_junk, rates_sound, share = quality_model.estimate(dict(counts))
    assert abs(share - 0.2) < 0.03 and all(rates_junk[k][1] > 0.8 for k in range(3)) and rates_junk[3][1] < 0.45
    assert all(rates_sound[k][1] < 0.05 for k in range(4))


def test_pipeline(spark, sf, docs, odd, empty, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "language identification", "near-duplicates", "mixing sources to target weights", "byte-level BPE"]
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, sf)
        assert out.columns == docs.columns
        kept = out
        kept.write.parquet(path := str(tmp_path / stage.__name__))
        kept = spark.read.parquet(path)
    final = corpus_pipeline.run(spark, sf)
    assert final.count() == kept.count() and final.where("NOT round_trip").count() == 0
    apart = kept.dropDuplicates(["doc_id"]).collect()
    assert all(d == c for d, (_, c) in brute_components({r.doc_id: r.text for r in apart}, 5).items())
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, sf).count() >= 0 and stage(spark, empty, sf).count() == 0
