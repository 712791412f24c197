"""Queries against their SQL on rows that the generated tables hold at larger sizes only."""

from __future__ import annotations

import os

import duckdb
import pytest
from parity import compare

import __spark_entry__


@pytest.fixture()
def folder(sf, tmp_path):
    def make(name: str, sql: str) -> str:
        for f in os.listdir(sf):
            if f != f"{name}.parquet":
                os.symlink(f"{sf}/{f}", tmp_path / f)
        duckdb.sql(f"COPY ({sql}) TO '{tmp_path}/{name}.parquet'")
        return str(tmp_path)

    return make


def same(spark, query: str, sf_dir: str) -> None:
    assert compare(__spark_entry__.queries()[query](spark, sf_dir), __spark_entry__.oracle_sql()[query], sf_dir) > 0


def test_cells_of_large_sums(spark, sf, folder):
    same(spark, "out_cells", folder("orders", f"SELECT * REPLACE (o_totalprice * 100000 AS o_totalprice) FROM '{sf}/orders.parquet'"))


def test_boxes_of_a_long_document(spark, sf, folder):
    text = "array_to_string(list_transform(range(200), lambda i: 'Paragraph ' || i || ' ' || repeat('of words ', 5)), chr(10) || chr(10))"
    same(spark, "ret_box", folder("documents", f"SELECT * REPLACE (CASE WHEN doc_id % 50 = 0 THEN {text} ELSE text END AS text) FROM '{sf}/documents.parquet'"))


def test_routes_of_words_beside_other_letters(spark, sf, folder):
    odd = "['éorders', 'ordersé', 'which product' || chr(13) || 'has the most', 'top' || chr(11) || '5', 'top 0000000012 x', 'top 5é', 'ßphoto sales', 'photoß sales']"
    made = folder("conversations", f"SELECT conv_id, turn, 'user' AS role, ({odd})[(conv_id // 16) % 8 + 1] AS text FROM (SELECT i AS conv_id, 0 AS turn FROM range(128) r(i))")
    same(spark, "conversation_routes", made)


def test_rankings_read_texts_of_candidates_only(spark, sf):
    for name in ("ret_fusion", "ret_precision_pin", "ret_contrast_pin"):
        df = __spark_entry__.queries()[name](spark, sf)
        assert not [f for f in df.inputFiles() if "documents.parquet" in f]
        assert compare(df, __spark_entry__.oracle_sql()[name], sf) > 0
