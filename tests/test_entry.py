"""The driver's contract, with and without the training-data subpackage."""

from __future__ import annotations

import subprocess
import sys

import __spark_entry__ as entry


def test_entry_gives_five_suppliers(spark):
    df = entry.entry(spark)
    assert df.columns == ["s_suppkey", "s_name", "revenue", "customers"]
    assert df.count() == 5


def test_sql_names_are_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_the_subpackage(tmp_path):
    code = (
        "import sys, importlib.abc\n"
        "class Block(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name == 'corpus_pipeline' or name.startswith('weftline.llm'): raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Block())\n"
        "import __spark_entry__ as e\n"
        "assert 'pipeline' not in e.queries() and 'supplier_top5_1997' in e.queries()\n"
    )
    root = entry.__file__.rsplit("/", 1)[0]
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
