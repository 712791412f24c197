"""Readers and writers of business tables and of the property graph's node and edge tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Columns of the graph's tables as exported.
NODE_FIELDS = ("id", "type", "title", "text", "order", "page_start", "page_end", "depth", "entities", "cluster_id")
EDGE_FIELDS = ("source_id", "target_id", "rel_type", "weight", "axis", "properties")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder in the place that the cluster shares for intermediate tables: the session's checkpoint folder.

    Only a local master may do without one; a temporary folder takes its place there.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="weftline-")
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """``df`` with a gapless long from 0 in this order: sorted by range and numbered in each partition, so no task holds all rows."""
    stored = kept(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    placed = stored.withColumn("_part", F.shiftright("_at", 33))
    upto = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    firsts = placed.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_first"))
    within = F.col("_at").bitwiseAND((1 << 33) - 1)
    return placed.join(F.broadcast(firsts), "_part").select(*df.columns, (F.col("_first") + within).alias(name))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many tasks as there are cores, for heavy work on a table of few splits; others stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV with a header; a cell that doesn't fit its type becomes null."""
    fields = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in fields])
    raw = spark.read.option("header", True).schema(text).csv(path)
    return raw.select(*[F.expr(f"try_cast(`{f.name}` AS {f.dataType.simpleString()})").alias(f.name) for f in fields])


def read_events(spark: SparkSession, path: str, schema: T.StructType | str, newest_days: int | None = None) -> DataFrame:
    """JSON lines written by ``write_events``; with ``newest_days`` only that many newest days, pruned by partition."""
    events = spark.read.schema(schema).option("basePath", path).json(path)
    if newest_days is None:
        return events
    # The folders' names tell the days; no file is opened for that.
    days = {m[1] for f in events.inputFiles() if (m := re.search("day=([^/]+)/", f))}
    return events.where(F.col("day").cast("string").isin(sorted(days, reverse=True)[:newest_days]))


def write_events(events: DataFrame, path: str, ts: str = "ts") -> None:
    """Append events as JSON lines, one folder a UTC day."""
    events.withColumn("day", F.date_format(ts, "yyyy-MM-dd")).write.mode("append").partitionBy("day").json(path)


def write_nodes(nodes: DataFrame, path: str) -> None:
    """Nodes as CSV, one folder a label; line ends in texts as ``\\n``, entities as JSON."""
    out = nodes.withColumn("text", F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\\n")))
    out = out.withColumn("entities", F.to_json("entities")).withColumn("label", F.col("type"))
    out.select(*NODE_FIELDS, "label").write.mode("overwrite").partitionBy("label").option("header", True).csv(path)


def write_edges(edges: DataFrame, path: str) -> None:
    """Edges as CSV, one folder an axis; properties as JSON."""
    out = edges.withColumn("properties", F.to_json("properties")).withColumn("axis_part", F.col("axis"))
    out.select(*EDGE_FIELDS, "axis_part").write.mode("overwrite").partitionBy("axis_part").option("header", True).csv(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes as Parquet, one folder a label, and edges, one folder a type; a folder that is written again is replaced, others stay."""
    mode = {"partitionOverwriteMode": "dynamic"}
    nodes.write.options(**mode).mode("overwrite").partitionBy("label").parquet(f"{path}/nodes")
    edges.write.options(**mode).mode("overwrite").partitionBy("rel_type").parquet(f"{path}/edges")


# The parts of a shipping address in the order of its key.
ADDRESS = ("shipName", "shipAddress", "shipCity", "shipRegion", "shipPostalCode", "shipCountry")


def address_key(*parts: Column) -> Column:
    """The parts of an address joined; a missing part leaves its place empty."""
    return F.concat_ws(", ", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def load_orders(rows: DataFrame, key: str, customer: str, address: list[str]) -> dict[str, DataFrame]:
    """Orders, addresses and the edges between them from one table: ``orders``, ``addresses`` (one row a key), ``shipped_to`` and ``ordered``."""
    keyed = rows.withColumn("address_key", address_key(*[F.col(c) for c in address]))
    return {
        "orders": keyed.dropDuplicates([key]),
        "addresses": keyed.select("address_key", *address).dropDuplicates(["address_key"]),
        "shipped_to": keyed.select(F.col(key).alias("source"), F.col("address_key").alias("target")).distinct(),
        "ordered": keyed.where(F.col(customer).isNotNull()).select(F.col(customer).alias("source"), F.col(key).alias("target")).distinct(),
    }


def load_details(rows: DataFrame, orders: DataFrame, products: DataFrame, order: str, product: str) -> DataFrame:
    """The rows of a bridge table whose order and product are both known, one for each pair: the last value of each property wins by its order."""
    known = rows.join(orders.select(order), order, "left_semi").join(products.select(product), product, "left_semi")
    rest = [c for c in rows.columns if c not in (order, product)]
    return known.groupBy(order, product).agg(F.max(F.struct(*rest)).alias("p")).select(order, product, "p.*")


_PARTS = re.compile(r"""'(?:[^']|'')*'|"[^"]*"|`[^`]*`|--[^\n]*|/\*.*?\*/|;|[^;'"`]""", re.S)
_NAME = re.compile(r"(?<![:\w]):([A-Za-z_]\w*)")


def statements(script: str) -> list[str]:
    """The statements of a script; semicolons and colons inside literals, names and comments don't count."""
    found, current = [], []
    for part in _PARTS.findall(script):
        if part == ";":
            found.append("".join(current))
            current = []
        elif not part.startswith(("--", "/*")):
            current.append(part)
    return [s.strip() for s in [*found, "".join(current)] if s.strip()]


def run_script(spark: SparkSession, script: str) -> list[DataFrame]:
    """Run the statements of a script; ``:param name => value;`` sets a named parameter for the rest."""
    args: dict[str, object] = {}
    results = []
    for statement in statements(script):
        if statement.startswith(":param"):
            name, _, value = statement[len(":param") :].partition("=>")
            value = value.strip()
            args[name.strip()] = value[1:-1] if value[:1] in "'\"" else float(value) if "." in value else int(value)
        else:
            outside = "".join(p for p in _PARTS.findall(statement) if p[0] not in "'\"`")
            results.append(spark.sql(statement, args={k: args[k] for k in set(_NAME.findall(outside)) & set(args)}))
    return results
