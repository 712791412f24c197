"""Conversation repair, URL filters and whitening against SQL, plain loops and numpy."""

from __future__ import annotations

import hashlib
import itertools
import zlib

import numpy as np
import parity
import pytest
from pyspark.sql import functions as F

from weftline.llm import conversation_repair, queries, url_filters, whitening
from weftline.llm.url_filters import Rule

BLANKS = " \t\n\x0b\x0c\r"


@pytest.mark.parametrize("name", ["op11_conversation_repair", "op12_url_filters"])
def test_against_sql(spark, sf, name):
    assert parity.compare(queries.queries()[name](spark, sf), queries.oracle_sql()[name], sf) > 0


# --- conversations


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def plain_faults(rows):
    """Rows of one conversation in order, each with its fault."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    seen, out = set(), []
    for _, _, role, text in rows:
        end = text.rstrip(BLANKS)
        fault = "blank" if not end else "duplicate" if (role, text) in seen else "" if end[-1] in ".!?" else "truncated"
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def all_repairs(rows):
    """The least (cost, audit) and its rows, by trying every edit of every row and up to two insertions before each and at the end."""
    best = None
    choices = [["D"] if f in ("blank", "duplicate") else ["K", "u", "a", "D"] for _, _, f in rows]
    for edits in itertools.product(*choices):
        for gaps in itertools.product(["", "u", "a", "ua", "au"], repeat=len(rows) + 1):
            cost, audit, kept = 0, "", []
            for (role, text, fault), edit, gap in zip(rows, edits, gaps, strict=False):
                audit, cost = audit + "I" * len(gap), cost + 5 * len(gap)
                kept += [({"u": "user", "a": "assistant"}[g], "") for g in gap]
                if edit == "D":
                    audit, cost = audit + "D", cost + 2
                    continue
                cost += 5 * (fault == "truncated") + (edit != "K")
                audit += "K" if edit == "K" else "R"
                kept.append((role if edit == "K" else {"u": "user", "a": "assistant"}[edit], text))
            audit, cost = audit + "I" * len(gaps[-1]), cost + 5 * len(gaps[-1])
            kept += [({"u": "user", "a": "assistant"}[g], "") for g in gaps[-1]]
            initials = "".join(r[:1] for r, _ in kept)
            body = initials[1:] if initials[:1] == "s" else initials
            if body == "ua" * (len(body) // 2) and (body or not initials) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, kept)
    return best


def plain_fold(rows):
    """The same for long conversations, by a walk over states with whole row lists."""
    ways = {"": (0, "", [])}
    less = lambda d, s, w: d.__setitem__(s, w) if s not in d or w[:2] < d[s][:2] else None
    for role, text, fault in [*rows, (None, None, None)]:
        opened = dict(ways)
        for _ in range(2):
            for s, (c, a, k) in list(opened.items()):
                if s in ("", "s", "a"):
                    less(opened, "u", (c + 5, a + "I", [*k, ("user", "")]))
                if s == "u":
                    less(opened, "a", (c + 5, a + "I", [*k, ("assistant", "")]))
        if role is None:
            ways = opened
            break
        after = {}
        for s, (c, a, k) in ways.items():
            less(after, s, (c + 2, a + "D", k))
        if fault not in ("blank", "duplicate"):
            extra = 5 * (fault == "truncated")
            for s, (c, a, k) in opened.items():
                for cost, letter, to in ((0, "K", role), (1, "R", "user"), (1, "R", "assistant")):
                    i = to[:1]
                    if (i == "s" and s == "" and letter == "K") or (i == "u" and s in ("", "s", "a")) or (i == "a" and s == "u"):
                        less(after, i, (c + cost + extra, a + letter, [*k, (to, text)]))
        ways = after
    return min((ways[s] for s in ("", "a") if s in ways), key=lambda w: w[:2])


def expected(talks, damaged, solve):
    out = {}
    for conv in {r[0] for r in talks}:
        rows = [r for r in damaged if r[0] == conv]
        marked = plain_faults(rows)
        turns = [r[1] for r in rows if r[1] is not None]
        cost, audit, kept = solve(marked)
        pairs = ["".join(p) for p in itertools.pairwise([r[0][:1] for r in marked])]
        counts = [sum(f == k for _, _, f in marked) for k in ("blank", "duplicate", "truncated")]
        text = "\n".join(f"{r}:{t}" for r, t in kept)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *counts, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def found(df):
    return {r.conv_id: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in df.collect()}


TALK = "conv_id long, turn long, role string, text string, place int"


def test_repair_is_the_cheapest_of_all_edits(spark):
    rng = np.random.default_rng(3)
    roles, texts = ["user", "assistant", "system", "tool"], ["Well.", "Well", "So?", " ", "Ok!"]
    rows = [(c, t, str(rng.choice(roles)), str(rng.choice(texts))) for c in range(60) for t in range(int(rng.integers(1, 4)))]
    got = found(conversation_repair.repair_report(df := spark.createDataFrame([(*r, 0) for r in rows], TALK), df))
    for conv in got:
        marked = plain_faults([r for r in rows if r[0] == conv])
        assert all_repairs(marked)[:2] == plain_fold(marked)[:2]
    assert got == expected(rows, rows, all_repairs)


def test_stretches_join_to_the_same_repair(spark, monkeypatch):
    monkeypatch.setattr(conversation_repair, "SEGMENT_BITS", 1)
    monkeypatch.setattr(conversation_repair, "FAN", 2)
    rng = np.random.default_rng(5)
    roles = ["user", "assistant", "system"]
    rows = [(c, t, str(rng.choice(roles, p=[0.45, 0.45, 0.1])), f"{'Say' if rng.random() < 0.2 else f'Say {t}'}{rng.choice(['.', ''], p=[0.8, 0.2])}") for c in range(6) for t in range(int(rng.integers(1, 60)))]
    damaged = plain_damage(rows)
    df = spark.createDataFrame([(*r, 0) for r in rows], TALK)
    got = found(conversation_repair.repair_report(df, conversation_repair.damage(df)))
    assert got == expected(rows, damaged, plain_fold)


def test_odd_conversations(spark):
    long = "word " * 40_000 + "end."
    rows = [(None, None, None, None), (None, 3, "user", "Hi."), (1, None, "user", "A."), (1, None, "user", "A."), (1, 2, "", long), (1, 2, "Aide", "b"), (1, 9, "assistant", "")]
    rows += [(2, 7, "user", "Same.")] * 40 + [(3, None, "system", "\t\n")] + [(4, t, "user", None) for t in range(4)]
    df = spark.createDataFrame([(*r, 1) for r in rows], TALK)
    assert found(conversation_repair.repair_report(df, df)) == expected(rows, [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows], plain_fold)
    assert found(conversation_repair.repair_report(df, conversation_repair.damage(df))) == expected(rows, plain_damage(rows), plain_fold)
    none = df.where(F.lit(False))
    assert conversation_repair.repair_report(none, none).count() == 0
    gone = found(conversation_repair.repair_report(df, none))
    assert set(gone.values()) == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_repaired_turns_are_whole_rows(spark):
    df = spark.createDataFrame([(1, 0, "assistant", "One.", 0), (1, 1, "user", "Two.", 0)], TALK)
    fixed = conversation_repair.repair(df)
    assert [tuple(r) for r in fixed.turns.orderBy("place").collect()] == [(1, 1, "rerole", "user", "One."), (1, 2, "rerole", "assistant", "Two.")]
    assert fixed.report.first().audit == "RR"


# --- pages


def test_url_parts_and_rules(spark):
    urls = [None, "", "no scheme/x", "HTTP://WWW.Example.COM/en/1?q#f", "http://example.com", "x://a.net?u=://b/es/", "ftp://net/es/", "https://É.net/fr/\n/x#", "http://u@a.com:80/en/"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id int, url string")
    h, p = url_filters.host(F.col("url")), url_filters.path(F.col("url"))
    rule, verdict = url_filters.rule_of(F.col("h"), F.col("p"), queries.URL_RULES)
    got = [tuple(r) for r in df.select("page_id", h.alias("h"), p.alias("p")).select("h", "p", rule, verdict, "page_id").orderBy("page_id").drop("page_id").collect()]
    assert got == [
        ("", "", None, None), ("", "", None, None), ("", "", None, None), ("www.example.com", "/en/1", "www.example.com/en/", "allow"), ("example.com", "", None, None),
        ("a.net", "", None, None), ("net", "/es/", "net/es/", "block"), ("É.net", "/fr/\n/x", "net/fr/", "block"), ("u@a.com:80", "/en/", None, None),
    ]


def test_tree_finds_bad_templates(spark):
    """One branch of a host is bad: it is split from its siblings, which merge, and its template is rejected, also for pages without a label."""
    rows = []
    for i in range(200):
        rows += [("h.org", f"/news/{i}.html", i % 10 == 0), ("h.org", f"/blog/{i}.html", i % 9 == 0), ("h.org", f"/spam/{i}.html", i % 10 > 0 if i % 2 else None)]
    rows += [("k.org", f"/p{i}/q/r/s/t{i}", False) for i in range(20)] + [("", "", None)] * 3 + [("k.org", "no slash", True)]
    labelled = spark.createDataFrame(rows, "host string, path string, bad boolean")
    tree = url_filters.grow(labelled)
    pages = labelled.select(F.monotonically_increasing_id().alias("page_id"), "host", "path")
    got = url_filters.judge(pages, [Rule("k.org", "/p7/", "block")], tree).collect()
    assert len(got) == len(rows)
    of = {(r.host, r.path): r for r in got}
    assert of["h.org", "/news/3.html"].template == "/{blog|news}/*.html" and of["h.org", "/spam/3.html"].template == "/spam/*.html"
    assert {r.verdict for r in got if "/spam/" in r.path} == {"block"} and {r.verdict for r in got if "/news/" in r.path or "/blog/" in r.path} == {"allow"}
    assert of["k.org", "/p3/q/r/s/t3"].template == "/*/q/r/s/**" and of["k.org", "/p7/q/r/s/t7"].verdict == "block"
    assert of["", ""].verdict == "allow" and of["k.org", "no slash"].template == ""


def test_pages_without_labels_or_rows(spark, sf):
    pages, labels = spark.read.parquet(f"{sf}/pages.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    extra = pages.select("*", F.lit("x").alias("host"), F.lit(None).cast("string").alias("path"), F.lit(1).alias("template"))
    extra = extra.unionByName(extra.withColumn("page_id", F.lit(None).cast("long")).withColumn("url", F.lit(None).cast("string")).limit(2))
    twice = url_filters.judge_pages(extra.unionByName(extra), labels, queries.URL_RULES)
    assert twice.count() == 2 * extra.count()
    bare = url_filters.judge_pages(extra, labels.where(F.lit(False)), queries.URL_RULES)
    assert bare.where("rule is null and verdict = 'block'").count() == 0
    assert url_filters.judge_pages(extra.where(F.lit(False)), labels, queries.URL_RULES).count() == 0


def test_no_python_in_filters(spark, sf):
    plan = queries.op12_url_filters(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


# --- vectors


def plain_whitening(vectors):
    """vec_id, component, n, deviation, whitened, explained by numpy, in whole numbers as far as they go."""
    rows = [(i, [int(np.floor(float(c) * 256)) for c in v]) for i, v in vectors if v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in rows}), dtype=object)
    n, s = len(fit), fit.sum(axis=0)
    centred = ((n * fit - s).astype(float)) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:4], axes[:, ::-1][:, :4]
    out = {}
    for i, x in rows:
        off = n * np.array(x, dtype=object) - s
        out[i] = (n, int((off * off).sum()), (off.astype(float) / n) @ axes / np.sqrt(values), values / np.trace(centred.T @ centred / n))
    return out


def check_whitening(df, vectors):
    want = plain_whitening(vectors)
    got = {}
    for r in df.collect():
        got.setdefault(r.vec_id, {})[r.component] = r
    assert set(got) == set(want)
    signs = None
    for i, (n, deviation, white, explained) in want.items():
        rows = [got[i][c] for c in sorted(got[i])]
        assert [r.component for r in rows] == list(range(1, len(white) + 1)) and {(r.n, r.deviation) for r in rows} == {(n, deviation)}
        mine = np.array([r.whitened for r in rows])
        if signs is None and np.abs(white).min() > 1e-3:
            signs = np.sign(mine * white)
        if signs is not None:
            assert np.allclose(mine, signs * white, atol=1e-8)
        assert np.allclose([r.explained for r in rows], explained, rtol=1e-9) and all(r.identity_error < 1e-9 for r in rows)
    assert signs is not None


def test_whitening_of_the_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    check_whitening(whitening.whitened_rows(rows), [(r.vec_id, r.embedding) for r in rows.collect()])


def test_whitening_of_odd_vectors(spark):
    rng = np.random.default_rng(1)
    kind = "vec_id long, embedding array<double>, n int, component string"
    rows = [(i, [float(x) for x in rng.normal(size=6) * [8, 5, 3, 2, 1, 1]]) for i in range(80)] + [(100 + i, [1.0] * 6) for i in range(50)]
    rows += [(200, [-0.0] * 6), (201, [-0.001, 0.001, 0.0, -7.25, 3.5, 2.0])]
    odd = [(300, None), (301, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (302, [float("nan")] * 6), (303, [float("inf")] + [0.0] * 5)]
    short = [(400, []), (401, [1.0, 2.0]), (402, [1e30] + [0.0] * 5)]
    make = lambda r: spark.createDataFrame([(i, v, 7, "x") for i, v in r], kind)
    check_whitening(whitening.whitened_rows(make(rows + odd + short)), rows + odd)
    empty = whitening.whitened_rows(make(rows).where(F.lit(False)))
    assert empty.count() == 0 and empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whitening.whitened_rows(make([(1, [2.0, 3.0]), (2, [2.0, 3.0])])).count() == 0
    flat = whitening.whitened_rows(make([(1, [2.0, 3.0]), (2, [4.0, 3.0]), (None, [2.0, 3.0])])).collect()
    assert sorted((str(r.vec_id), r.component, round(r.whitened, 9), r.explained) for r in flat) == [("1", 1, -1.0, 1.0), ("2", 1, 1.0, 1.0), ("None", 1, -1.0, 1.0)]


def test_deviation_beyond_a_long():
    w = whitening.Whitener(3_000_000_000, np.array([0, 0]), np.array([1, 2]), np.eye(2), np.ones(2), 2.0)
    got = w.deviation(np.array([[0, 1], [2, 3], [-(1 << 31), 1 << 31]]))
    assert got == [1 + (3_000_000_000 - 2) ** 2 if 1 + (3_000_000_000 - 2) ** 2 < 1 << 63 else None, None, None]
