from __future__ import annotations

import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def rows(docs):
    """doc_id to text of the small table."""
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, an empty, a blank and a long text, copies, repeated rows, and extra columns with the names of outputs."""
    long = " ".join(f"word{i % 977} tail{i % 31}" for i in range(30_000))
    texts = [None, "", " \n\t", "one two three four five six seven", "one two three four five six seven", "Ärger über 日本語 <s> <|endoftext|> 123\n\n  x", long, long + " end", "plain text"]
    data = [(i, t, "en", f"s{i % 3}", 1, 0.5, -1) for i, t in enumerate(texts)]
    data += [(None, "a null id", None, None, None, None, None), (3, texts[3], "en", "s0", 1, 0.5, -1), (11, None, None, None, None, None, None)]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, score double, shard int")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where(F.lit(False))
