"""Every registered query with SQL gives DuckDB's rows; the others run."""

from __future__ import annotations

import parity
import pytest

from weftline.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    df = QUERIES[name](spark, sf)
    if name in SQL:
        parity.compare(df, SQL[name], sf)
    else:
        assert df.count() >= 0
