"""The tokenizer operators, sharding and mixing against the libraries and plain counts."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from weftline.llm import byte_bpe, mixing, queries, sharding, token_counts, token_store

RANKS, JSON, MODEL = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def dicts(df):
    return [r.asDict() for r in df.collect()]


def test_shards_are_gapless_and_grow_only_into_the_new_one(spark, sf, rows):
    found = dicts(queries.op1_sharding(spark, sf))
    assert Counter(r["doc_id"] for r in found) == Counter(list(rows))
    slots = defaultdict(list)
    for r in found:
        data = (rows[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(data) + 1, zlib.crc32(data), "key")
        assert r["grown_shard"] in (r["shard"], 8)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(8))


def test_jump_hash_equals_the_plain_loop(spark):
    def plain(key, n):
        at, shard, k = 0, 0, 0
        while at < n:
            shard = at
            draw = (int(hashlib.md5(f"{key}:{k}".encode()).hexdigest()[:8], 16) + 1) / 2**32
            at, k = int((at + 1) / draw), k + 1
        return shard

    for n in (1, 2, 8, 9, 1000):
        found = spark.range(300).select("id", sharding.jump_hash(F.col("id"), n).alias("s")).collect()
        assert all(r.s == plain(r.id, n) for r in found)


def test_repeated_rows_are_dealt_in_parts(spark, monkeypatch):
    monkeypatch.setattr(sharding, "REPEATED_ROWS", 7)
    monkeypatch.setattr(sharding, "SLOT_GROUP_ROWS", 2)
    df = spark.createDataFrame([(5, "same")] * 40 + [(i, "x") for i in range(60)], "doc_id long, text string")
    rows = sharding.shard_documents(df, 3).collect()
    assert len(rows) == 100
    for s in range(3):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_sharding_odd_rows(odd, empty):
    found = dicts(sharding.shard_documents(odd, 8))
    assert len(found) == odd.count() and all(r["size"] >= 1 for r in found)
    assert sharding.shard_documents(empty, 8).count() == 0


def test_jump_hash_spreads_evenly_and_moves_little(spark):
    df = spark.range(20_000).select(sharding.jump_hash(F.col("id"), 10).alias("a"), sharding.jump_hash(F.col("id"), 11).alias("b"))
    found = df.collect()
    assert all(r.b in (r.a, 10) for r in found)
    assert 0.08 < sum(r.b == 10 for r in found) / 20_000 < 0.102
    assert all(1_800 < n < 2_200 for n in Counter(r.a for r in found).values())
    assert spark.range(5).select(sharding.jump_hash(F.col("id"), 1).alias("a")).agg({"a": "max"}).first()[0] == 0


@pytest.fixture(scope="module")
def tik():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})


def test_byte_bpe_equals_the_library(spark, sf, rows, tik):
    for r in queries.op2_byte_bpe(spark, sf).collect():
        ids = tik.encode_ordinary(rows[r.doc_id] or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((rows[r.doc_id] or "").encode()).hexdigest()


def test_byte_bpe_odd_rows(odd, empty, tik):
    coded = byte_bpe.decode(byte_bpe.encode(odd, RANKS, P.PATTERN), RANKS)
    found = coded.collect()
    assert len(found) == odd.count()
    for r in found:
        assert r.ids == tik.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    assert byte_bpe.encode(empty, RANKS, P.PATTERN).count() == 0


def test_perfect_hash_holds_every_rank_and_nothing_else():
    ranks = byte_bpe.read_ranks(RANKS)
    table = byte_bpe.PerfectHash(ranks).opened()
    assert all(table.get(k) == v for k, v in ranks.items())
    assert table.get(b"no such token here") is None and table.get(b"") is None


def test_heap_merge_equals_the_library_on_long_pieces(tik):
    ranks = byte_bpe.read_ranks(RANKS)
    for piece in ("a" * 3000, "abcab" * 500, "ß" * 700):
        assert byte_bpe.merge(piece.encode(), ranks) == tik._encode_single_piece(piece)


def library_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    return [[*e.ids, 2] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_token_store_equals_the_library(spark, sf, rows):
    found = {r.doc_id: r for r in queries.op3_token_store(spark, sf).collect()}
    start = 0
    for doc, ids in zip(sorted(rows), library_ids([rows[d] for d in sorted(rows)]), strict=True):
        r = found[doc]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_token_store_odd_rows_and_small_shards(odd, empty):
    found = dicts(token_store.stored(odd, JSON, 2, shard_tokens=50))
    expected = Counter(len(i) for i in library_ids([r.text for r in odd.collect()]))
    assert Counter(r["n_tokens"] for r in found) == expected
    ordered = sorted(found, key=lambda r: r["start"])
    assert all(b["start"] == a["start"] + a["n_tokens"] for a, b in zip(ordered, ordered[1:]))
    assert token_store.stored(empty, JSON, 2).count() == 0


def test_store_encoder_equals_the_library_on_odd_spaces(monkeypatch):
    monkeypatch.setattr(token_store, "CACHE_ENTRIES", 40)  # generations change many times
    encoder = token_store.LibraryEncoder(open(JSON, encoding="utf-8").read())
    rng = np.random.default_rng(5)
    bits = [" ", " ", "  ", "\n", "\t", "\xa0", "\r\n", "a", "B", "é", "ª", "1", "²", ".", ",", "'s", "'", "-", "word", "don't", "!?", "…", "日本", "\u0308", "<|endoftext|>"]
    texts = ["".join(rng.choice(bits, rng.integers(0, 12))) for _ in range(5000)]
    expected = [e.ids for e in encoder.library.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, encoder.kind).tolist() for x in encoder.encode(texts)] == expected


def test_wavelet_access_count_and_locate():
    rng = np.random.default_rng(1)
    for n, top in ((1, 2), (511, 3), (2000, 50_000)):
        ids = rng.integers(0, top, n).astype(np.uint16)
        w = token_store.Wavelet.build(ids, 16)
        assert (w.all() == ids).all()
        for i in rng.integers(0, n, 30).tolist():
            v = int(ids[i])
            where = np.flatnonzero(ids == v)
            assert w.access(i) == v and w.count(v) == len(where) and w.count(v, i) == int((where < i).sum())
            assert w.locate(v, len(where) - 1) == where[-1]
        assert w.count(60_000) == 0
        with pytest.raises(IndexError):
            w.locate(60_000, 0)


def test_token_counts_equal_the_library(spark, sf, rows, odd, empty):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for r in queries.op10_token_counts(spark, sf).collect():
        n = len(sp.encode(rows[r.doc_id] or "", num_threads=1))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((rows[r.doc_id] or "").encode()), n, n > 4096)
    for r in token_counts.count_tokens(odd, MODEL).collect():
        assert r.n_tokens == len(sp.encode(r.text or "", num_threads=1))
    assert token_counts.count_tokens(empty, MODEL).count() == 0


def test_token_counts_of_spaces_at_the_end(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = ["a ", "a  ", "a   ", "hello world. ", " ", "  ", "\u2581", "a\u2581", "a\u2581 ", "a \n", "\n ", " a ", "x " * 2048, "x " * 2049]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    found = {r.doc_id: (r.n_tokens, r.over_limit) for r in token_counts.count_tokens(df, MODEL).collect()}
    expected = [len(sp.encode(t, num_threads=1)) for t in texts]
    assert found == {i: (n, n > 4096) for i, n in enumerate(expected)}


def expected_targets(sizes):
    """Water filling, plainly: cap what is above, share the rest again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, target = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total >= 2 * sizes[s]]
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = 2.0 * sizes[s]
        left -= sum(target[s] for s in over)
        open_ -= set(over)
    return target


def check_mix(found, sources):
    sizes, taken, target = Counter(), Counter(), {}
    for r in found:
        s = sources[r["doc_id"]]
        sizes[s] += r["size"]
        taken[s] += r["taken"]
        target[s] = r["target"]
        assert r["taken"] <= 2 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
    for s, t in expected_targets(dict(sizes)).items():
        assert target[s] == pytest.approx(t)
        largest = max(r["size"] for r in found if sources[r["doc_id"]] == s)
        assert abs(taken[s] - t) <= largest
    return sizes


def test_mix_meets_targets(spark, sf, docs, rows):
    sources = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    found = dicts(queries.op9_mixing(spark, sf))
    sizes = check_mix(found, sources)
    assert all(r["size"] == len(WORD.findall(rows[r["doc_id"]] or "")) and r["source_size"] == sizes[sources[r["doc_id"]]] for r in found)
    assert sorted(map(str, found)) == sorted(map(str, dicts(queries.op9_mixing(spark, sf))))


def test_mix_rows_and_odd_tables(spark, odd, empty):
    report = dicts(mixing.mix_report(odd))
    assert len(report) == odd.count()
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns
    words = sum(len(WORD.findall(r.text or "")) for r in mixed.select("text").collect())
    assert words == sum(r["taken"] for r in report)
    assert mixing.mix_report(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_mix_parts_repeated_rows(spark):
    """A source of 60 equal rows and a smaller one meets its target within half a row, in the report and in the mixed rows."""
    rows = [(1, "a", "w " * 100)] * 60 + [(2, "a", "v " * 50)] + [(10 + i, s, "x " * 40) for i in range(100) for s in ("b", "c")] + [(None, "b", None)] * 3
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(7)
    report = dicts(mixing.mix_report(df, weights=(2, 3, 1)))
    assert len(report) == len(rows)
    mixed = {r["source"]: r["n"] for r in dicts(mixing.mix(df, weights=(2, 3, 1)).groupBy("source").agg(F.sum(F.regexp_count("text", F.lit(r"\w+"))).alias("n")))}
    taken = {}
    for (_, source, _), size in ((r, len((r[2] or "").split())) for r in set(rows)):
        mine = [x for x in report if x["size"] == size and x["source_size"] == sum(len((r[2] or "").split()) for r in rows if r[1] == source)]
        assert mine
    for r in report:
        taken.setdefault((r["source_size"], r["target"]), []).append(r["taken"])
    assert all(abs(sum(t) - target) <= 50 for (_, target), t in taken.items())
    one = [r for r in report if r["source_size"] == 6050]
    assert abs(sum(r["taken"] for r in one) - one[0]["target"]) <= 50 and mixed["a"] == sum(r["taken"] for r in one)
    assert sorted(r["taken"] for r in report) == sorted(r["taken"] for r in dicts(mixing.mix_report(df.coalesce(1), weights=(2, 3, 1))))
