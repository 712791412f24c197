"""Loading business tables into the graph: orders with their addresses, the bridge to products, typed and counted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.registry import Registry
from ..sources import tables
from ..sources.tables import table

registry = Registry()

# Orders take their customer's name, segment and nation as an address; every fifth has no segment.
_SHIPPED = """(SELECT o_orderkey AS orderID, o_custkey AS customerID, c_name AS shipName, CASE WHEN o_orderkey % 5 > 0 THEN c_mktsegment END AS shipCity, CAST(c_nationkey AS VARCHAR) AS shipCountry FROM orders JOIN customer ON o_custkey = c_custkey)"""


def _shipped(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    city = F.when(F.col("o_orderkey") % 5 > 0, F.col("c_mktsegment"))
    rows = o.select(F.col("o_orderkey").alias("orderID"), F.col("o_custkey").alias("customerID"), F.col("c_name").alias("shipName"), city.alias("shipCity"), F.col("c_nationkey").cast("string").alias("shipCountry"))
    return tables.load_orders(rows, "orderID", "customerID", ["shipName", "shipCity", "shipCountry"])


@registry.add(f"SELECT DISTINCT orderID AS source, shipName || ', ' || coalesce(shipCity, '') || ', ' || coalesce(shipCountry, '') AS target FROM {_SHIPPED}")
def load_shipped_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shipped(spark, sf_dir)["shipped_to"]


@registry.add(f"SELECT DISTINCT shipName || ', ' || coalesce(shipCity, '') || ', ' || coalesce(shipCountry, '') AS address_key, shipName, shipCity, shipCountry FROM {_SHIPPED}")
def load_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shipped(spark, sf_dir)["addresses"]


@registry.add("""WITH k AS (SELECT l_orderkey, l_partkey, l_quantity, l_extendedprice FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 25))
SELECT l_orderkey, l_partkey, l_quantity, l_extendedprice FROM k QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_quantity DESC, l_extendedprice DESC) = 1""")
def load_order_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bridge from finished orders to small parts, with its properties."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice")
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").withColumnRenamed("o_orderkey", "l_orderkey")
    parts = table(spark, sf_dir, "part").where("p_size < 25").withColumnRenamed("p_partkey", "l_partkey")
    return tables.load_details(rows, orders, parts, "l_orderkey", "l_partkey")


@registry.add("""SELECT o_orderkey, CAST(strftime(o_orderdate, '%Y-%m-%d') AS DATE) AS day, TRY_CAST(left(o_orderpriority, 1) AS INT) AS priority, o_orderstatus <> 'F' AS open, epoch_ms(o_orderdate) AS millis FROM orders""")
def load_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts made typed: the first ten characters as a date, a leading digit as a number, a flag, and milliseconds."""
    text = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.to_date(F.substring(text, 1, 10)).alias("day"),
        F.substring("o_orderpriority", 1, 1).try_cast("int").alias("priority"),
        (F.col("o_orderstatus") != "F").alias("open"),
        F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("millis"),
    )
