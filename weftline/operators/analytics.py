"""Business analytics: multi-hop joins, ranks, growth, shares and set operations over orders.

Revenue of a line is its extended price less the discount; sums are exact decimals. A category
is a part's type, a country a nation. Ranks break ties by key, so results are stable.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.registry import Registry
from ..sources.tables import table

registry = Registry()
MONEY = "decimal(38,6)"


def money(value: Column) -> Column:
    """A sum of exact decimals, as a double rounded to cents."""
    return F.round(F.sum(value.cast(MONEY)).cast("double"), 2)


def net() -> Column:
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each group; Spark limits each group before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def orders_of_year(spark: SparkSession, sf_dir: str, *years: int) -> DataFrame:
    """Orders of the years; the range on the date reaches the scan."""
    o = table(spark, sf_dir, "orders")
    low, high = F.lit(f"{min(years)}-01-01").cast("timestamp_ntz"), F.lit(f"{max(years) + 1}-01-01").cast("timestamp_ntz")
    return o.where((F.col("o_orderdate") >= low) & (F.col("o_orderdate") < high))


def lines(spark: SparkSession, sf_dir: str, *years: int) -> DataFrame:
    o = orders_of_year(spark, sf_dir, *years) if years else table(spark, sf_dir, "orders")
    return table(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))


_NET = "CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(38,6))"
_SUM_NET = f"round(CAST(sum({_NET}) AS DOUBLE), 2)"
_Y97 = "o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01'"
_LO = "lineitem JOIN orders ON l_orderkey = o_orderkey"


@registry.add(f"""SELECT s_suppkey, s_name, {_SUM_NET} AS revenue, count(DISTINCT o_custkey) AS customers
FROM {_LO} JOIN supplier ON l_suppkey = s_suppkey WHERE {_Y97} GROUP BY 1, 2 ORDER BY revenue DESC, s_suppkey LIMIT 5""")
def supplier_top5_1997(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = lines(spark, sf_dir, 1997).groupBy("l_suppkey").agg(money(net()).alias("revenue"), F.count_distinct("o_custkey").alias("customers"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    top = by.join(s, F.col("l_suppkey") == F.col("s_suppkey")).orderBy(F.desc("revenue"), "s_suppkey").limit(5)
    return top.select("s_suppkey", "s_name", "revenue", "customers")


@registry.add(f"""WITH p AS (SELECT p_type AS category, p_partkey, sum({_NET}) AS s, round(CAST(sum({_NET}) AS DOUBLE), 2) AS product_revenue FROM {_LO} JOIN part ON l_partkey = p_partkey
WHERE {_Y97} GROUP BY 1, 2), c AS (SELECT category, round(CAST(sum(s) AS DOUBLE), 2) AS category_revenue FROM p GROUP BY 1),
b AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY product_revenue DESC, p_partkey) AS r FROM p)
SELECT category, category_revenue, p_partkey AS best_product, product_revenue AS best_revenue, row_number() OVER (ORDER BY category_revenue DESC, category) AS category_rank
FROM c JOIN b USING (category) WHERE r = 1""")
def category_rank_best_product_1997(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("category"))
    by = lines(spark, sf_dir, 1997).join(part, F.col("l_partkey") == F.col("p_partkey"))
    p = by.groupBy("category", "p_partkey").agg(F.sum(net().cast(MONEY)).alias("s"))
    p = p.withColumn("product_revenue", F.round(F.col("s").cast("double"), 2))
    best = F.max_by(F.struct("p_partkey", "product_revenue"), F.struct("product_revenue", -F.col("p_partkey"))).alias("best")
    c = p.groupBy("category").agg(money(F.col("s")).alias("category_revenue"), best)
    rank = F.row_number().over(Window.orderBy(F.desc("category_revenue"), "category"))  # a row a category
    return c.select("category", "category_revenue", F.col("best.p_partkey").alias("best_product"), F.col("best.product_revenue").alias("best_revenue"), rank.cast("long").alias("category_rank"))


@registry.add(f"""WITH x AS (SELECT n_name AS country, p_type AS category, sum({_NET}) AS s, {_SUM_NET} AS revenue FROM {_LO} JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey WHERE {_Y97} GROUP BY 1, 2),
t AS (SELECT country, round(CAST(sum(s) AS DOUBLE), 2) AS country_revenue FROM x GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5)
SELECT country, country_revenue, category, revenue FROM x JOIN t USING (country) QUALIFY row_number() OVER (PARTITION BY country ORDER BY revenue DESC, category) = 1""")
def country_top_category_1997(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = customers(spark, sf_dir).select("c_custkey", F.col("n_name").alias("country"))
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("category"))
    x = lines(spark, sf_dir, 1997).join(c, F.col("o_custkey") == F.col("c_custkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    x = x.groupBy("country", "category").agg(F.sum(net().cast(MONEY)).alias("s"), money(net()).alias("revenue"))
    top = x.groupBy("country").agg(money(F.col("s")).alias("country_revenue")).orderBy(F.desc("country_revenue"), "country").limit(5)
    best = top_per_group(x, ["country"], [F.desc("revenue"), F.col("category")])
    return best.join(F.broadcast(top), "country").select("country", "country_revenue", "category", "revenue")


@registry.add(f"""SELECT strftime(o_orderdate, '%Y-%m') AS month, {_SUM_NET} AS revenue, count(DISTINCT o_orderkey) AS orders
FROM {_LO} WHERE {_Y97} GROUP BY 1""")
def monthly_revenue_1997(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = F.date_format("o_orderdate", "yyyy-MM").alias("month")
    return lines(spark, sf_dir, 1997).groupBy(month).agg(money(net()).alias("revenue"), F.count_distinct("o_orderkey").alias("orders"))


@registry.add(f"""SELECT strftime(o_orderdate, '%Y-%m') AS month, {_SUM_NET} AS revenue FROM {_LO} WHERE {_Y97} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1""")
def best_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monthly_revenue_1997(spark, sf_dir).select("month", "revenue").orderBy(F.desc("revenue"), "month").limit(1)


@registry.add(f"SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders WHERE {_Y97} GROUP BY 1")
def monthly_order_count_1997(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_of_year(spark, sf_dir, 1997).groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


@registry.add(f"""SELECT p_partkey, p_name, CAST(sum(l_quantity) AS BIGINT) AS units, count(DISTINCT l_orderkey) AS orders
FROM {_LO} JOIN part ON l_partkey = p_partkey WHERE {_Y97} GROUP BY 1, 2 ORDER BY units DESC, p_partkey LIMIT 5""")
def top_products_quantity(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = lines(spark, sf_dir, 1997).groupBy("l_partkey").agg(F.sum("l_quantity").cast("long").alias("units"), F.count_distinct("l_orderkey").alias("orders"))
    top = by.orderBy(F.desc("units"), "l_partkey").limit(5)
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return part.join(F.broadcast(top), F.col("p_partkey") == F.col("l_partkey")).select("p_partkey", "p_name", "units", "orders")


@registry.add(f"""WITH y AS (SELECT o_custkey, year(o_orderdate) AS y, CAST(sum({_NET}) AS DOUBLE) AS r FROM {_LO}
WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1, 2)
SELECT c_custkey, c_name, round(a.r, 2) AS revenue_1996, round(b.r, 2) AS revenue_1997, round(b.r - a.r, 2) AS growth
FROM y a JOIN y b ON a.o_custkey = b.o_custkey AND a.y = 1996 AND b.y = 1997 JOIN customer ON c_custkey = a.o_custkey ORDER BY growth DESC, c_custkey LIMIT 5""")
def customer_growth_1996_1997(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = F.year("o_orderdate")
    of = lambda y: F.sum(F.when(year == y, net().cast(MONEY))).cast("double").alias(f"r{y}")
    by = lines(spark, sf_dir, 1996, 1997).groupBy("o_custkey").agg(of(1996), of(1997)).where("r1996 IS NOT NULL AND r1997 IS NOT NULL")
    grown = by.select("o_custkey", F.round("r1996", 2).alias("revenue_1996"), F.round("r1997", 2).alias("revenue_1997"), F.round(F.col("r1997") - F.col("r1996"), 2).alias("growth"))
    top = grown.orderBy(F.desc("growth"), "o_custkey").limit(5)
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return c.join(F.broadcast(top), F.col("c_custkey") == F.col("o_custkey")).drop("o_custkey")


@registry.add(f"""SELECT n_name AS country, count(DISTINCT o_orderkey) AS orders, round(CAST(sum({_NET}) AS DOUBLE) / count(DISTINCT o_orderkey), 2) AS avg_order_value
FROM {_LO} JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE {_Y97} GROUP BY 1
HAVING count(DISTINCT o_orderkey) >= 5 ORDER BY avg_order_value DESC, country LIMIT 5""")
def avg_order_value_country_min5(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = customers(spark, sf_dir).select("c_custkey", F.col("n_name").alias("country"))
    # One row an order first, so that the second aggregation needs no distinct count.
    per_order = lines(spark, sf_dir, 1997).groupBy("o_orderkey", "o_custkey").agg(F.sum(net().cast(MONEY)).alias("r"))
    by = per_order.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("country").agg(F.count("*").alias("orders"), F.sum("r").cast("double").alias("r"))
    by = by.where("orders >= 5").select("country", "orders", F.round(F.col("r") / F.col("orders"), 2).alias("avg_order_value"))
    return by.orderBy(F.desc("avg_order_value"), "country").limit(5)


@registry.add(f"""WITH x AS (SELECT p_type AS category, c_custkey, c_name, {_SUM_NET} AS revenue FROM {_LO} JOIN customer ON o_custkey = c_custkey
JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3) SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY category ORDER BY revenue DESC, c_custkey) = 1""")
def category_top_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("category"))
    x = lines(spark, sf_dir).join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("category", "o_custkey").agg(money(net()).alias("revenue"))
    best = top_per_group(x, ["category"], [F.desc("revenue"), F.col("o_custkey")])
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return best.join(c, F.col("o_custkey") == F.col("c_custkey")).select("category", "c_custkey", "c_name", "revenue")


@registry.add(f"""SELECT round(CAST(sum(CAST(l_extendedprice AS DECIMAL(38,6))) AS DOUBLE), 2) AS gross,
round(CAST(sum(CAST(l_extendedprice * l_discount AS DECIMAL(38,6))) AS DOUBLE), 2) AS discount, {_SUM_NET} AS net, count(*) AS n_lines FROM {_LO} WHERE {_Y97}""")
def totals_gross_discount_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir, 1997).agg(
        money(F.col("l_extendedprice")).alias("gross"),
        money(F.col("l_extendedprice") * F.col("l_discount")).alias("discount"),
        money(net()).alias("net"),
        F.count("*").alias("n_lines"),
    )


@registry.add(f"""SELECT p_partkey, p_name, p_type, p_brand, {_SUM_NET} AS revenue, count(DISTINCT l_suppkey) AS suppliers
FROM {_LO} JOIN part ON l_partkey = p_partkey WHERE {_Y97} GROUP BY 1, 2, 3, 4 ORDER BY revenue DESC, p_partkey LIMIT 5""")
def product_revenue_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = lines(spark, sf_dir, 1997).groupBy("l_partkey").agg(money(net()).alias("revenue"), F.count_distinct("l_suppkey").alias("suppliers"))
    top = by.orderBy(F.desc("revenue"), "l_partkey").limit(5)
    part = table(spark, sf_dir, "part")
    return part.join(F.broadcast(top), F.col("p_partkey") == F.col("l_partkey")).select("p_partkey", "p_name", "p_type", "p_brand", "revenue", "suppliers")


@registry.add(f"""SELECT p_type AS category, {_SUM_NET} AS revenue, round(100 * CAST(sum({_NET}) AS DOUBLE) / sum(CAST(sum({_NET}) AS DOUBLE)) OVER (), 4) AS share_percent
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def revenue_share_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("category"))
    by = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("category").agg(F.sum(net().cast(MONEY)).cast("double").alias("r"))
    share = F.round(100 * F.col("r") / F.sum("r").over(Window.partitionBy()), 4)  # a row a category
    return by.select("category", F.round("r", 2).alias("revenue"), share.alias("share_percent"))


@registry.add("SELECT p_type AS category, count(*) AS products, round(CAST(sum(CAST(p_retailprice AS DECIMAL(38,6))) AS DOUBLE) / count(*), 4) AS avg_price FROM part GROUP BY 1")
def products_per_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    average = F.round(F.sum(F.col("p_retailprice").cast(MONEY)).cast("double") / F.count("*"), 4)
    return table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("category")).agg(F.count("*").alias("products"), average.alias("avg_price"))


@registry.add("SELECT p_partkey, p_name, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 5")
def expensive_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").orderBy(F.desc("p_retailprice"), "p_partkey").select("p_partkey", "p_name", "p_retailprice").limit(5)


@registry.add("""SELECT DISTINCT c_custkey, c_name FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey
JOIN part ON l_partkey = p_partkey WHERE p_type = (SELECT min(p_type) FROM part) AND year(o_orderdate) = 1997""")
def customers_of_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    first = part.agg(F.min("p_type").alias("first"))
    chosen = part.join(F.broadcast(first), F.col("p_type") == F.col("first"), "left_semi").select("p_partkey")
    buyers = lines(spark, sf_dir, 1997).join(chosen, F.col("l_partkey") == F.col("p_partkey"), "left_semi").select("o_custkey")
    return table(spark, sf_dir, "customer").join(buyers, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@registry.add("SELECT s_suppkey, s_name, count(DISTINCT l_orderkey) AS orders FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2 ORDER BY orders DESC, s_suppkey LIMIT 10")
def supplier_distinct_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count_distinct("l_orderkey").alias("orders"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    return by.join(s, F.col("l_suppkey") == F.col("s_suppkey")).orderBy(F.desc("orders"), "s_suppkey").limit(10).select("s_suppkey", "s_name", "orders")


@registry.add("SELECT c_custkey, c_name, count(*) AS orders FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2 ORDER BY orders DESC, c_custkey LIMIT 12")
def customer_top12_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("orders")).orderBy(F.desc("orders"), "o_custkey").limit(12)
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return c.join(F.broadcast(top), F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "c_name", "orders")


@registry.add("SELECT DISTINCT p_type AS category FROM part WHERE p_type NOT IN (SELECT p_type FROM part JOIN lineitem ON l_partkey = p_partkey)")
def categories_never_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    ordered = part.join(table(spark, sf_dir, "lineitem"), F.col("p_partkey") == F.col("l_partkey"), "left_semi").select("p_type")
    return part.select("p_type").distinct().join(ordered, "p_type", "left_anti").select(F.col("p_type").alias("category"))


@registry.add("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def orders_without_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey", "o_custkey")


@registry.add("""SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey
JOIN part ON l_partkey = p_partkey WHERE p_type = (SELECT min(p_type) FROM part) AND year(o_orderdate) = 1997)""")
def customers_never_bought(spark: SparkSession, sf_dir: str) -> DataFrame:
    bought = customers_of_category(spark, sf_dir).select("c_custkey")
    return table(spark, sf_dir, "customer").join(bought, "c_custkey", "left_anti").select("c_custkey", "c_name")


@registry.add(f"""WITH c AS (SELECT o_custkey, CAST(sum({_NET}) AS DOUBLE) AS r FROM {_LO} GROUP BY 1 ORDER BY r DESC, 1 LIMIT 10),
p AS (SELECT o_custkey, l_partkey, {_SUM_NET} AS revenue FROM {_LO} WHERE o_custkey IN (SELECT o_custkey FROM c) GROUP BY 1, 2)
SELECT o_custkey AS c_custkey, l_partkey AS p_partkey, revenue FROM p QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY revenue DESC, l_partkey) <= 2""")
def top_customers_then_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_lines = lines(spark, sf_dir)
    top = all_lines.groupBy("o_custkey").agg(F.sum(net().cast(MONEY)).cast("double").alias("r")).orderBy(F.desc("r"), "o_custkey").limit(10).select("o_custkey")
    p = all_lines.join(F.broadcast(top), "o_custkey", "left_semi").groupBy("o_custkey", "l_partkey").agg(money(net()).alias("revenue"))
    return top_per_group(p, ["o_custkey"], [F.desc("revenue"), F.col("l_partkey")], 2).select(F.col("o_custkey").alias("c_custkey"), F.col("l_partkey").alias("p_partkey"), "revenue")


def _named(column: str) -> Column:
    """``ALL`` in the rows of a total; a null of the data stays null."""
    return F.when(F.grouping(column) == 1, F.lit("ALL")).otherwise(F.col(column))


def _orders_by_customer(spark: SparkSession, sf_dir: str, *keys: str) -> DataFrame:
    """o_custkey, ``keys`` and n: orders are counted before they meet their customers."""
    return table(spark, sf_dir, "orders").groupBy("o_custkey", *keys).agg(F.count("*").alias("n"))


@registry.add("""SELECT CASE WHEN grouping(r_name) = 1 THEN 'ALL' ELSE r_name END AS region, CASE WHEN grouping(n_name) = 1 THEN 'ALL' ELSE n_name END AS nation, count(*) AS orders
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)""")
def region_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = customers(spark, sf_dir).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    o = _orders_by_customer(spark, sf_dir).join(c, F.col("o_custkey") == F.col("c_custkey"))
    both = o.rollup("r_name", "n_name").agg(_named("r_name").alias("region"), _named("n_name").alias("nation"), F.sum("n").alias("orders"))
    return both.select("region", "nation", "orders")


@registry.add("""SELECT CASE WHEN grouping(c_mktsegment) = 1 THEN 'ALL' ELSE c_mktsegment END AS segment, CASE WHEN grouping(o_orderpriority) = 1 THEN 'ALL' ELSE o_orderpriority END AS priority, count(*) AS orders
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY CUBE (c_mktsegment, o_orderpriority)""")
def segment_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders_by_customer(spark, sf_dir, "o_orderpriority").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    both = o.cube("c_mktsegment", "o_orderpriority").agg(_named("c_mktsegment").alias("segment"), _named("o_orderpriority").alias("priority"), F.sum("n").alias("orders"))
    return both.select("segment", "priority", "orders")


@registry.add("""SELECT o_orderpriority AS priority, o_orderstatus AS status, count(*) AS orders FROM orders
GROUP BY GROUPING SETS ((), (o_orderpriority), (o_orderstatus), (o_orderpriority, o_orderstatus))""")
def priority_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"))
    sets = [[], [F.col("priority")], [F.col("status")], [F.col("priority"), F.col("status")]]
    return o.groupingSets(sets, F.col("priority"), F.col("status")).agg(F.count("*").alias("orders")).select("priority", "status", "orders")


@registry.add("""SELECT 'union' AS op, count(*) AS n FROM (SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1996 UNION SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1997)
UNION ALL SELECT 'intersect', count(*) FROM (SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1996 INTERSECT SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1997)
UNION ALL SELECT 'except', count(*) FROM (SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1996 EXCEPT SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1997)""")
def orders_union_intersect_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (orders_of_year(spark, sf_dir, y).select("o_custkey") for y in (1996, 1997))
    made = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "except": a.subtract(b)}
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(op).alias("op"), "n") for op, df in made.items()]
    return parts[0].union(parts[1]).union(parts[2])


def revenue_by_country(spark: SparkSession, sf_dir: str, year: int, country_of: str = "customer") -> DataFrame:
    """country and revenue of a year: a country is the customer's, unless ``country_of`` says the supplier's, where goods are shipped from."""
    n = table(spark, sf_dir, "nation")
    all_lines = lines(spark, sf_dir, year)
    if country_of == "customer":
        sums = all_lines.groupBy(F.col("o_custkey").alias("key")).agg(F.sum(net().cast(MONEY)).alias("r"))
        owner = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("n_nationkey"))
    elif country_of == "supplier":
        sums = all_lines.groupBy(F.col("l_suppkey").alias("key")).agg(F.sum(net().cast(MONEY)).alias("r"))
        owner = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("n_nationkey"))
    else:
        raise ValueError(f"country_of is customer or supplier, not {country_of}")
    met = sums.join(owner, "key").join(n, "n_nationkey")
    return met.groupBy(F.col("n_name").alias("country")).agg(F.round(F.sum("r").cast("double"), 2).alias("revenue"))


_COUNTRY_SQL = """SELECT n_name AS country, round(CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(38, 6))) AS DOUBLE), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN {0} JOIN nation ON {1} = n_nationkey WHERE year(o_orderdate) = 1997 GROUP BY 1"""


@registry.add(_COUNTRY_SQL.format("customer ON o_custkey = c_custkey", "c_nationkey"))
def customer_country_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revenue_by_country(spark, sf_dir, 1997)


@registry.add(_COUNTRY_SQL.format("supplier ON l_suppkey = s_suppkey", "s_nationkey"))
def supplier_country_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revenue_by_country(spark, sf_dir, 1997, "supplier")
