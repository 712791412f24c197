"""The corpus pipeline: stages over documents, each written and read again by the next.

Every stage reads all that its predecessor kept and returns the columns of documents; the last
one returns token ids. Defined cases: a null or blank text goes in the first stage; a document
whose language can't be told (no letter, or a score nearer to a tie than to the lowest of its
language's labelled rows) goes in the second; in the third, one row of each group stays,
the one of the smallest doc_id (null last), whether rows share a doc_id or not; texts of any length
are worked on whole; repeated rows are judged alike by every stage but the third, which keeps one;
ties go to the smaller doc_id, then to the earlier row; columns of any name pass the first four
stages unchanged; an empty table passes every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import byte_bpe, common, language_id, mixing, near_dedup, quality_model

#: Words of a shingle and the similarity in percent from which documents are copies.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier, fitted on these, keeps."""
    common.small_batches(spark)
    score, kept = common.free_names(docs, "score", "kept")
    scored = quality_model.classify(docs, quality_model.fit(docs.select("doc_id", "text")), score=score, kept=kept)
    return scored.where(F.col(kept)).select(*docs.columns)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose language a model of the labelled ones tells well enough."""
    common.small_batches(spark)
    lang, score = common.free_names(docs, "told", "score")
    known = docs.select("doc_id", "text", "lang").where(~language_id.held_out(F.col("doc_id")))
    model = language_id.fit(known)
    told = common.written(language_id.identify(docs, model, lang=lang, score=score))
    least = language_id.least_scores(told, model, lang=lang, score=score)
    if not least:
        return told.where(F.lit(False)).select(*docs.columns)
    bound = F.element_at(F.create_map(*[F.lit(x) for pair in least.items() for x in pair]), F.col(lang))
    return told.where(F.col(score) >= bound).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of similarity SIMILAR_PERCENT or more connect."""
    common.small_batches(spark)
    # Rows are the nodes, as a doc_id can be null, repeated or have several texts.
    (row,) = common.free_names(docs, "row")
    numbered = common.written(docs.withColumn(row, F.monotonically_increasing_id()))
    found = near_dedup.near_duplicates(numbered.select(F.col(row).alias("doc_id"), "text"), SHINGLE_WORDS, SIMILAR_PERCENT)
    groups = found.select(F.col("doc_id").alias("node"), "component_id").join(numbered.select(F.col(row).alias("node"), "doc_id"), "node")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "node"))["node"]
    kept = groups.groupBy("component_id").agg(first.alias(row)).select(row)
    return numbered.join(kept, row, "left_semi").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, each as often as the mix to target weights takes it."""
    common.small_batches(spark)
    return mixing.mix(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, n_tokens, ids, and whether the ids decode to the text's very bytes."""
    common.small_batches(spark)
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = byte_bpe.round_trip(docs.select("doc_id", "source", "lang", "text"), ranks, public_tokenizers.PATTERN)
    exact = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return coded.select(
        "doc_id", "source", "lang", F.size("ids").cast("long").alias("n_tokens"), "ids", exact.alias("round_trip")
    )


STAGES = [
    ("quality classifier", classify_quality),
    ("language identification", identify_language),
    ("near-duplicates", drop_near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE", encode_tokens),
]

#: Trained models and hashed signatures can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, in a session of its own, so that the caller's settings stay.

    A stage's intermediate tables go as soon as its result is written, and that goes when the next one's is.
    """
    own = common.own_settings(spark)
    docs = own.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        with common.clearing(own) as kept:
            found = common.written(stage(own, docs, sf_dir))
            kept.append(found)
        if i:
            common.drop(docs)
        docs = found
    return STAGES[-1][1](own, docs, sf_dir)
