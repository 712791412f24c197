"""Analytics in several steps: each step is a query over tables and over the rows of the steps before it.

A step's SQL names an earlier step's rows as a table, ``<id>_rows``, or asks for their values by ``$name``: the
distinct values of the columns of that name (or of its singular) in all earlier steps. Both are parts of
one plan, so nothing is gathered between steps. Data reaches later steps under plain names: dots become ``_``.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.registry import Registry
from ..sources.tables import table

registry = Registry()

# Rows of a step that are shown.
PREVIEW_ROWS = 15


@dataclass(frozen=True)
class Step:
    id: str
    purpose: str
    sql: str


def plain_names(df: DataFrame) -> DataFrame:
    """``df`` whose columns can be named in later steps."""
    return df.toDF(*[c.replace(".", "_").strip() for c in df.columns])


def parameters(sql: str) -> list[str]:
    return sorted(set(re.findall(r"\$([A-Za-z_]\w*)", sql)))


def bound(sql: str, done: dict[str, DataFrame], view: dict[str, str]) -> str:
    """``sql`` with each ``$name`` as a subquery of its values in all earlier steps, and each ``<id>_rows`` as that step's view.

    Values come from the columns of that very name; only if no step has one, from those of its singular.
    """
    for name in parameters(sql):
        sources = next((found for c in (name, name.rstrip("s")) if (found := [(view[step], c) for step, df in done.items() if c in df.columns])), [])
        if not sources and name.removesuffix("_rows") not in done:
            raise ValueError(f"no earlier step has values of {name}")
        parts = " UNION ".join(f"SELECT `{c}` FROM {v} WHERE `{c}` IS NOT NULL" for v, c in sources)  # without repeats
        value = f"({parts})" if sources else view[name.removesuffix("_rows")]
        sql = re.sub(rf"\${name}\b", lambda _, v=value: v, sql)
    for step, name in view.items():
        sql = re.sub(rf"\b{step}_rows\b", name, sql)
    return sql


def run(spark: SparkSession, steps: Sequence[Step], tables: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], str | None]:
    """The rows of each step until one can't be planned, and what is wrong with that one.

    Tables and rows are known to the steps alone: they stand under names of this run only, and these go when the steps are planned.
    """
    own = f"w{uuid.uuid4().hex}"
    done: dict[str, DataFrame] = {}
    view: dict[str, str] = {}
    try:
        for name, df in tables.items():
            df.createOrReplaceTempView(f"{own}_{name}")
        named = ", ".join(f"`{name}` AS (SELECT * FROM {own}_{name})" for name in tables)
        for step in steps:
            try:
                sql = bound(step.sql, done, view)
                head = re.match(r"(?i)\s*WITH\b", sql)
                found = plain_names(spark.sql(f"WITH {named}, {sql[head.end() :]}" if head and named else f"WITH {named} {sql}" if named else sql))
            except (PySparkException, ValueError) as error:
                return done, f"{step.id}: {error}"
            view[step.id] = f"{own}__{step.id}"
            found.createOrReplaceTempView(view[step.id])
            done[step.id] = found
    finally:
        for name in [*(f"{own}_{name}" for name in tables), *view.values()]:
            spark.catalog.dropTempView(name)
    return done, None


def previews(steps: Sequence[Step], done: dict[str, DataFrame], order: dict[str, list[str]]) -> DataFrame:
    """id, title, rows and text (the first PREVIEW_ROWS rows as JSON, by ``order``) of each step that ran."""
    out = None
    for step in steps:
        if step.id in done:
            by = order.get(step.id) or done[step.id].columns
            rows = done[step.id].orderBy(*by).limit(PREVIEW_ROWS).select(F.struct(*by).alias("o"), F.to_json(F.struct(*done[step.id].columns)).alias("j"))
            shown = rows.agg(F.array_sort(F.collect_list(F.struct("o", "j"))).alias("s"), F.count("*").alias("rows"))
            text = F.concat(F.lit("["), F.array_join(F.transform("s", lambda x: x["j"]), ","), F.lit("]"))
            shown = shown.select(F.lit(step.id).alias("id"), F.lit(f"{step.id}: {step.purpose}").alias("title"), "rows", text.alias("text"))
            out = shown if out is None else out.unionByName(shown)
    return out


#: The best segments by orders, their best customers, and what these bought most.
PLAN = (
    Step("step1", "best segments", "SELECT c_mktsegment AS segment, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1 ORDER BY orders DESC, segment LIMIT 2"),
    Step("step2", "their best customers", "SELECT o_custkey AS customer, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment IN $segments GROUP BY 1 ORDER BY orders DESC, customer LIMIT 5"),
    Step("step3", "what these bought", "SELECT customer, l_partkey AS part, CAST(sum(l_quantity) AS BIGINT) AS units FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN step2_rows ON o_custkey = customer GROUP BY 1, 2"),
)


@registry.add("""WITH s AS (SELECT c_mktsegment AS segment, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1 ORDER BY orders DESC, segment LIMIT 2),
c AS (SELECT o_custkey AS customer, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment IN (SELECT segment FROM s) GROUP BY 1 ORDER BY orders DESC, customer LIMIT 5)
SELECT customer, l_partkey AS part, CAST(sum(l_quantity) AS BIGINT) AS units FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN c ON o_custkey = customer GROUP BY 1, 2""")
def steps_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    done, error = run(spark, PLAN, {t: table(spark, sf_dir, t) for t in ("orders", "customer", "lineitem")})
    if error:
        raise RuntimeError(error)
    return done["step3"]


@registry.add("""WITH s AS (SELECT c_mktsegment AS segment, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1 ORDER BY orders DESC, segment LIMIT 2)
SELECT 'step1' AS id, 'step1: best segments' AS title, count(*) AS rows, '[' || string_agg('{"segment":"' || segment || '","orders":' || orders || '}', ',' ORDER BY segment) || ']' AS text FROM s""")
def steps_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    done, _ = run(spark, PLAN[:1], {t: table(spark, sf_dir, t) for t in ("orders", "customer")})
    return previews(PLAN[:1], done, {"step1": ["segment"]})
