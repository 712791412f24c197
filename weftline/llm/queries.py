"""The registered queries of the training-data operators, with their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, byte_bpe, conversation_repair, language_id, mixing, near_dedup, quality_model, quality_rules, sharding, structure_sql, token_counts, token_store, url_filters, whitening
from .url_filters import Rule

SHARDS = 8
#: Rules that come before the templates of paths.
URL_RULES = [
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents").select("doc_id", "text"), SHARDS)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = _tokenizer("byte_bpe_50k.tiktoken")
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = byte_bpe.round_trip(docs, ranks, public_tokenizers.PATTERN)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_store.stored(docs, _tokenizer("byte_bpe_50k.json"), end_id=2)


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"), width=4, percent=80)


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), "embedding", every=100, k=10)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    apart = language_id.held_out(F.col("doc_id"))
    model = language_id.fit(docs.select("doc_id", "text", "lang").where(~apart))
    return language_id.identify(docs.select("doc_id", apart.alias("held_out"), "text"), model).drop("text")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.judge(docs, quality_rules.fit(docs, _table(spark, sf_dir, "labels")))


def op8_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_model.classify(docs, quality_model.fit(docs)).select("doc_id", "score", "kept")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.count_tokens(docs, _tokenizer("piece_bpe_32k.model"))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return conversation_repair.repair_report(talks, conversation_repair.damage(talks))


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, labels = _table(spark, sf_dir, "pages").select("page_id", "url"), _table(spark, sf_dir, "labels")
    return url_filters.judge_pages(pages, labels, URL_RULES)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_rows(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_sharding, op2_byte_bpe, op3_token_store, op4_near_dedup, op5_ann, op6_language_id, op7_quality_rules, op8_quality_model, op9_mixing, op10_token_counts, op11_conversation_repair, op12_url_filters, op13_whitening]
    return {f.__name__: f for f in found}


# CRC-32 byte by byte over a table made from its polynomial, and the chain of jumps as a recursion.
_SHARDS = f"""WITH RECURSIVE t AS (SELECT list(c ORDER BY i) AS tab FROM (
SELECT i, list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i) AS c FROM range(0, 256) r(i))),
d AS (SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) + 1 AS size, xor(4294967295, list_reduce(
list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]),
CAST(4294967295 AS BIGINT))) AS text_crc32 FROM documents, t),
j AS (SELECT doc_id, 0 AS k, CAST(0 AS BIGINT) AS place FROM (SELECT DISTINCT doc_id FROM documents)
UNION ALL SELECT doc_id, k + 1, onward FROM (SELECT doc_id, k,
CAST(floor((place + 1) / ((CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null key') || ':' || k), 1, 8) AS BIGINT) + 1) / 4294967296.0)) AS BIGINT) AS onward FROM j) WHERE onward <= {SHARDS}),
s AS (SELECT doc_id, CAST(max(place) FILTER (WHERE place < {SHARDS}) AS INT) AS shard, CAST(max(place) AS INT) AS grown_shard FROM j GROUP BY 1)
SELECT d.doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY d.doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard
FROM d JOIN s ON d.doc_id IS NOT DISTINCT FROM s.doc_id"""

# All shingles joined to each other, and the smallest document that links reach by recursion.
_NEAR = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS g FROM w),
n AS (SELECT doc_id, len(g) AS n, md5(array_to_string(list_sort(g), chr(10))) AS same FROM g),
k AS (SELECT min(doc_id) AS doc_id, same, min(n) AS n FROM n WHERE n > 0 GROUP BY same),
e AS MATERIALIZED (SELECT doc_id, unnest(g) AS e FROM g WHERE doc_id IN (SELECT doc_id FROM k)),
p AS MATERIALIZED (SELECT a.doc_id AS u, b.doc_id AS v FROM e a JOIN e b ON a.e = b.e AND a.doc_id < b.doc_id JOIN k x ON x.doc_id = a.doc_id JOIN k y ON y.doc_id = b.doc_id
GROUP BY 1, 2, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
b AS MATERIALIZED (SELECT u, v FROM p UNION ALL SELECT v, u FROM p),
r AS (SELECT doc_id, doc_id AS reached FROM k UNION SELECT r.doc_id, b.v FROM r JOIN b ON b.u = r.reached),
c AS (SELECT same, min(reached) AS component_id FROM r JOIN k USING (doc_id) GROUP BY 1)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, coalesce(CASE WHEN n > 0 THEN component_id END, doc_id) AS component_id,
doc_id = coalesce(CASE WHEN n > 0 THEN component_id END, doc_id) AS kept FROM n LEFT JOIN c USING (same)"""

# Water filling by the order in which sources reach their limit; a source's rows in the order of their hash.
_MIXED = r"""WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS hash FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY source_size / weight, source NULLS LAST) AS i, sum(source_size) OVER () AS total FROM s),
f AS (SELECT o.*, coalesce(sum(2.0 * source_size) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before,
sum(weight) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free FROM o),
l AS (SELECT arg_min(greatest(0.0, 1.5 * total - full_before) / free, i) AS level FROM f WHERE 2.0 * source_size > weight * greatest(0.0, 1.5 * total - full_before) / free),
t AS (SELECT source, source_size, least(2.0 * source_size, CAST(weight * coalesce(level, 1e300) AS DOUBLE)) AS target FROM s, (SELECT max(level) AS level FROM l)),
b AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
h AS (SELECT source, hash, CAST(sum(size) AS BIGINT) AS n, count(*) AS rows FROM d GROUP BY 1, 2),
u AS (SELECT h.*, sum(n) OVER (PARTITION BY source ORDER BY hash) AS upto FROM h),
x AS (SELECT u.source, hash, CASE WHEN upto <= target - whole * source_size THEN rows WHEN upto - n > target - whole * source_size THEN 0
ELSE ceil((target - whole * source_size - (upto - n)) * rows / n - 0.5) END AS more FROM u JOIN b ON u.source IS NOT DISTINCT FROM b.source),
y AS (SELECT *, row_number() OVER (PARTITION BY source, hash) AS place FROM d)
SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN size * (whole + CASE WHEN target > whole * source_size AND place <= more THEN 1 ELSE 0 END) ELSE 0 END AS taken
FROM y d JOIN b ON d.source IS NOT DISTINCT FROM b.source JOIN x ON d.source IS NOT DISTINCT FROM x.source AND d.hash = x.hash"""


def oracle_sql() -> dict[str, str]:
    """SQL for the operators whose rows the contract, a repeatable draw or counts fix; the others run tokenizers or trained models."""
    f = url_filters
    judged = structure_sql.filtered([(r.host, r.path, r.verdict) for r in URL_RULES], f.DEPTH, f.LEAST_ROWS, f.MOST_BRANCHES, f.SMOOTHING, f.DEVIATE, f.REJECT)
    return {"op1_sharding": _SHARDS, "op4_near_dedup": _NEAR, "op9_mixing": _MIXED, "op11_conversation_repair": structure_sql.REPAIRED, "op12_url_filters": judged}
