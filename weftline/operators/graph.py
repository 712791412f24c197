"""The property graph as node and edge tables: building, closure, expansion, introspection, degrees.

Nodes are documents' sources, documents and their lines; edges hold containment both ways and
the order of lines. Traversals are equi-joins, and every top list breaks ties by key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.registry import Registry
from ..sources.tables import kept, numbered, table

registry = Registry()

#: Levels that a containment search follows at most, and the edge types that expansion follows.
MOST_LEVELS = 6
#: Rounds after which pointers that still go up mean a cycle, and bits of an entry.
MOST_ROUNDS, BITS = 40, 40
# Edge types that expansion traverses.
TRAVERSED = ("CONTAINS", "PART_OF", "PRECEDES", "FOLLOWS", "REFERENCES", "SEMANTICALLY_SIMILAR", "SHARES_ENTITY", "SAME_CATEGORY", "EXPLAINS")
DEFAULT_WEIGHT = 0.75
#: Rows of the larger table in a task that builds the whole trade graph.
SHARE_ROWS = 1_000_000


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, place and text of each line of each document that isn't empty."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("place", "text"))
    return d.where("text <> ''")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id and label of sources, documents and sections."""
    d = table(spark, sf_dir, "documents")
    s = sections(spark, sf_dir).select(F.concat_ws("_", F.lit("doc"), "doc_id", F.lit("section"), "place").alias("id"), F.lit("Section").alias("label"))
    docs = d.select(F.concat(F.lit("doc_"), "doc_id").alias("id"), F.lit("Document").alias("label"))
    sources = d.select(F.concat(F.lit("source_"), "source").alias("id"), F.lit("Source").alias("label")).distinct()
    return sources.union(docs).union(s)


def contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source and target of containment: a source holds documents, a document its sections."""
    d = table(spark, sf_dir, "documents")
    up = d.select(F.concat(F.lit("source_"), "source").alias("source"), F.concat(F.lit("doc_"), "doc_id").alias("target"))
    s = sections(spark, sf_dir)
    return up.union(s.select(F.concat(F.lit("doc_"), "doc_id").alias("source"), F.concat_ws("_", F.lit("doc"), "doc_id", F.lit("section"), "place").alias("target")))


def following(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, place and next_place of neighbouring sections."""
    order = Window.partitionBy("doc_id").orderBy("place")
    s = sections(spark, sf_dir).select("doc_id", "place")  # only places are sorted
    return s.withColumn("next_place", F.lead("place").over(order)).where("next_place IS NOT NULL")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, target and rel_type, each containment and order edge with its inverse."""
    c = contains(spark, sf_dir)
    name = lambda place: F.concat_ws("_", F.lit("doc"), "doc_id", F.lit("section"), place)
    p = following(spark, sf_dir).select(name("place").alias("source"), name("next_place").alias("target"))
    both = lambda e, rel, inverse: e.select("source", "target", F.lit(rel).alias("rel_type")).union(e.select("target", "source", F.lit(inverse)))
    return both(c, "CONTAINS", "PART_OF").union(both(p, "PRECEDES", "FOLLOWS"))


def closure(edge: DataFrame, levels: int = MOST_LEVELS) -> DataFrame:
    """ancestor, descendant, depth and path of every walk of 1 to ``levels`` edges, one join a level."""
    step = edge.select(F.col("source").alias("_s"), F.col("target").alias("_t"))
    level = edge.select(F.col("source").alias("ancestor"), F.col("target").alias("descendant"), F.lit(1).alias("depth"), F.array("source", "target").alias("path"))
    found = level
    for depth in range(2, levels + 1):
        level = level.join(step, F.col("descendant") == F.col("_s")).where(~F.array_contains("path", F.col("_t")))
        level = level.select("ancestor", F.col("_t").alias("descendant"), F.lit(depth).alias("depth"), F.concat("path", F.array("_t")).alias("path"))
        found = found.union(level)
    return found


def containment_index(edge: DataFrame) -> DataFrame:
    """id, parent, depth, entry and exit of every node of the forest that ``edge`` (source, target, place) makes, written.

    Nodes are numbered from 0 in preorder, siblings by place, then id; the descendants of a node are those with an entry after its own up to its exit.
    Ancestors are found by pointer doubling: each round doubles the steps that a pointer spans, for paths downward and for
    the last entry upward, so a forest of depth d takes log2(d) rounds, whatever its shape. A node with several parents lies below the
    smallest; a cycle is an error.
    """
    parents = edge.where("source IS NOT NULL AND target IS NOT NULL").groupBy(F.col("target").alias("id")).agg(F.min(F.struct("source", "place")).alias("p"))
    roots = edge.select(F.col("source").alias("id")).where("id IS NOT NULL").distinct().join(parents.select("id"), "id", "left_anti")
    own = lambda place: F.array(F.struct(place.alias("place"), F.col("id").alias("id")))
    kind = edge.schema["place"].dataType.simpleString()
    rows = parents.select("id", F.col("p.source").alias("parent"), own(F.col("p.place")).alias("path"))
    rows = rows.unionByName(roots.select("id", F.lit(None).cast(edge.schema["source"].dataType).alias("parent"), own(F.lit(None).cast(kind)).alias("path")))
    rows = kept(rows.select("id", "parent", F.col("parent").alias("above"), "path"))
    jumps = []
    while rows.where("above IS NOT NULL").limit(1).count():
        if len(jumps) > MOST_ROUNDS:
            raise ValueError("the containment edges have a cycle")
        jumps.append(rows.select("id", "above"))
        up = rows.select(F.col("id").alias("_id"), F.col("above").alias("_above"), F.col("path").alias("_path"))
        longer = F.when(F.col("_id").isNull(), F.col("path")).otherwise(F.concat("_path", "path"))
        rows = kept(rows.join(up, rows["above"] == up["_id"], "left").select("id", "parent", F.col("_above").alias("above"), longer.alias("path")))
    found = numbered(rows.select("id", "parent", "path"), ["path"], "entry").select("id", "parent", (F.size("path") - 1).alias("depth"), "entry", F.col("entry").alias("exit"))
    for jump in jumps:
        below = found.join(jump.where("above IS NOT NULL"), "id").groupBy(F.col("above").alias("_id")).agg(F.max("exit").alias("_exit"))
        found = kept(found.join(below, found["id"] == below["_id"], "left").select("id", "parent", "depth", "entry", F.greatest("exit", "_exit").alias("exit")))
    return found


def descendants(index: DataFrame, most: int | None = None) -> DataFrame:
    """ancestor, descendant and depth (levels between them, up to ``most``) from ``containment_index``, by one join.

    An interval of entries is cut into aligned runs of a power of two, of which each entry is in one, so equal runs meet and nothing else does.
    """
    inner = index.where("exit > entry").select(F.col("id").alias("ancestor"), F.col("depth").alias("_d"), (F.col("entry") + 1).alias("_lo"), (F.col("exit") + 1).alias("_hi"))
    levels = range(BITS)
    bit = lambda c, k: F.shiftright(F.col(c), k)
    # At each level the run at the lower end is taken if the bounds, rounded inward so far, leave it alone there; so for the upper end.
    low = lambda k: F.shiftright(F.col("_lo") + ((1 << k) - 1), k)
    parts = [F.when((low(k) < bit("_hi", k)) & (low(k) % 2 == 1), F.struct(F.lit(k).alias("level"), low(k).alias("run"))) for k in levels]
    parts += [F.when((low(k) < bit("_hi", k)) & (bit("_hi", k) % 2 == 1) & ((low(k) % 2 == 0) | (low(k) + 1 < bit("_hi", k))), F.struct(F.lit(k).alias("level"), (bit("_hi", k) - 1).alias("run"))) for k in levels]
    cut = inner.select("ancestor", "_d", F.explode(F.filter(F.array(*parts), lambda p: p.isNotNull())).alias("p")).select("ancestor", "_d", "p.level", "p.run")
    used = cut.select("level").distinct()  # a row for each power of two
    each = index.crossJoin(F.broadcast(used)).select(F.col("id").alias("descendant"), F.col("depth").alias("_e"), "level", F.expr("shiftright(entry, level)").alias("run"))
    found = cut.join(each, ["level", "run"]).select("ancestor", "descendant", (F.col("_e") - F.col("_d")).alias("depth"))
    return found if most is None else found.where(F.col("depth") <= most)


def with_inverse(edge: DataFrame) -> DataFrame:
    """Edges in both directions, for walks that don't mind direction."""
    return edge.select("edge_id", "source", "target", "rel_type", "weight").union(edge.select("edge_id", "target", "source", "rel_type", "weight"))


#: Edges, or a function that gives those that leave the nodes of a table (id), in both directions.
Edges = DataFrame | Callable[[DataFrame], DataFrame]


def leaving(edge: Edges, ids: DataFrame) -> DataFrame:
    """The traversed edges from the nodes ``ids`` (id) in either direction: edge_id, source, target, rel_type and weight."""
    if callable(edge):
        return edge(ids).where(F.col("rel_type").isin(*TRAVERSED))
    both = with_inverse(edge.where(F.col("rel_type").isin(*TRAVERSED)))
    return both.join(ids.select(F.col("id").alias("source")), "source", "left_semi")


def _ending(found: DataFrame, active: DataFrame) -> DataFrame:
    """``found`` whose targets are ``active``; what was found is few beside all nodes, so those are cut to it before they move."""
    ends = active.select(F.col("id").alias("target")).join(found.select("target").distinct(), "target", "left_semi")
    return found.join(ends, "target", "left_semi")


def expand(seeds: DataFrame, edge: Edges, active: DataFrame, limit: int = 24) -> DataFrame:
    """One hop from ``seeds`` (id, score) over traversed edges to ``active`` nodes; ``edge`` has edge_id, source, target, rel_type, weight."""
    found = _ending(kept(leaving(edge, seeds)), active)
    found = found.select(F.col("source").alias("seed"), F.col("target").alias("id"), "rel_type", F.coalesce("weight", F.lit(DEFAULT_WEIGHT)).alias("weight")).distinct()
    return found.orderBy(F.desc("weight"), "rel_type", "id", "seed").limit(limit)


def expand_twice(seeds: DataFrame, edge: Edges, active: DataFrame, limit: int = 16) -> DataFrame:
    """Two hops over different edges, ending away from the seed; the weight is the second edge's.

    The first hop is written, so its size is known when the second one's join is planned.
    """
    one = leaving(edge, seeds).select(F.col("source").alias("seed"), F.col("target").alias("middle"), F.col("edge_id").alias("first"), F.col("rel_type").alias("r1"))
    one = kept(one)
    near = leaving(edge, one.select(F.col("middle").alias("id")).distinct())
    two = one.join(near, F.col("middle") == F.col("source")).where("edge_id <> first AND target <> seed")
    weight = F.coalesce("weight", F.lit(DEFAULT_WEIGHT)).alias("weight")
    two = kept(two.select("seed", "target", F.concat("r1", F.lit("->"), "rel_type").alias("rel_type"), weight).distinct())
    found = _ending(two, active).select("seed", F.col("target").alias("id"), "rel_type", "weight")
    return found.orderBy(F.desc("weight"), "rel_type", "id", "seed").limit(limit)


_S = "(SELECT doc_id, place - 1 AS place FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM documents) WHERE t <> '')"
_CONTAINS = f"""(SELECT 'source_' || source AS source, 'doc_' || doc_id AS target FROM documents
UNION ALL SELECT 'doc_' || doc_id, 'doc_' || doc_id || '_section_' || place FROM {_S})"""
_NEXT = f"(SELECT * FROM (SELECT doc_id, place, lead(place) OVER (PARTITION BY doc_id ORDER BY place) AS next_place FROM {_S}) WHERE next_place IS NOT NULL)"
_EDGES = f"""(SELECT source, target, 'CONTAINS' AS rel_type FROM {_CONTAINS} UNION ALL SELECT target, source, 'PART_OF' FROM {_CONTAINS}
UNION ALL SELECT 'doc_' || doc_id || '_section_' || place, 'doc_' || doc_id || '_section_' || next_place, 'PRECEDES' FROM {_NEXT}
UNION ALL SELECT 'doc_' || doc_id || '_section_' || next_place, 'doc_' || doc_id || '_section_' || place, 'FOLLOWS' FROM {_NEXT})"""
_NODES = f"""(SELECT DISTINCT 'source_' || source AS id, 'Source' AS label FROM documents UNION ALL SELECT 'doc_' || doc_id, 'Document' FROM documents
UNION ALL SELECT 'doc_' || doc_id || '_section_' || place, 'Section' FROM {_S})"""


@registry.add(f"SELECT doc_id, CAST(place AS BIGINT) AS place, CAST(next_place AS BIGINT) AS next_place FROM {_NEXT}")
def graph_next_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    return following(spark, sf_dir).select("doc_id", F.col("place").cast("long").alias("place"), F.col("next_place").cast("long").alias("next_place"))


@registry.add(f"""SELECT a.label AS source_label, rel_type, b.label AS target_label, count(*) AS n FROM {_EDGES} e
JOIN {_NODES} a ON a.id = e.source JOIN {_NODES} b ON b.id = e.target GROUP BY 1, 2, 3""")
def graph_schema_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir)
    a, b = n.select(F.col("id").alias("source"), F.col("label").alias("source_label")), n.select(F.col("id").alias("target"), F.col("label").alias("target_label"))
    return edges(spark, sf_dir).join(a, "source").join(b, "target").groupBy("source_label", "rel_type", "target_label").agg(F.count("*").alias("n"))


@registry.add(f"SELECT id, count(*) AS degree FROM (SELECT source AS id FROM {_EDGES} UNION ALL SELECT target FROM {_EDGES}) GROUP BY 1 ORDER BY degree DESC, id LIMIT 15")
def graph_degree_top15(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    ends = e.select(F.explode(F.array("source", "target")).alias("id"))
    return ends.groupBy("id").agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "id").limit(15)


@registry.add(f"""WITH RECURSIVE c AS (SELECT source AS ancestor, target AS descendant, 1 AS depth FROM {_CONTAINS}
UNION ALL SELECT ancestor, target, depth + 1 FROM c JOIN {_CONTAINS} e ON e.source = descendant WHERE depth < 6)
SELECT ancestor, depth, count(*) AS descendants FROM c GROUP BY 1, 2""")
def graph_containment_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = containment_index(contains(spark, sf_dir).withColumn("place", F.lit(0)))
    return descendants(index, MOST_LEVELS).groupBy("ancestor", "depth").agg(F.count("*").alias("descendants"))


@registry.add(f"""WITH RECURSIVE e AS (SELECT source, target, CAST(coalesce(nullif(regexp_extract(target, '_section_(\\d+)$', 1), ''), '0') AS BIGINT) AS place FROM {_CONTAINS}),
t AS (SELECT DISTINCT source AS id, CAST(NULL AS VARCHAR) AS parent, [lpad('0', 12, '0') || source] AS path FROM e WHERE source NOT IN (SELECT target FROM e)
UNION ALL SELECT target, t.id, list_append(path, lpad(CAST(place AS VARCHAR), 12, '0') || target) FROM t JOIN e ON e.source = t.id),
n AS (SELECT *, row_number() OVER (ORDER BY path) - 1 AS entry FROM t)
SELECT id, parent, len(path) - 1 AS depth, entry, entry + (SELECT count(*) FROM {_CONTAINS} c JOIN {_CONTAINS} d ON d.source = c.target WHERE c.source = n.id) + (SELECT count(*) FROM {_CONTAINS} c WHERE c.source = n.id) AS exit FROM n""")
def graph_containment_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entry and exit of every source, document and section; sections go by their line."""
    edge = contains(spark, sf_dir)
    place = F.coalesce(F.nullif(F.regexp_extract("target", r"_section_(\d+)$", 1), F.lit("")), F.lit("0")).cast("long")
    return containment_index(edge.withColumn("place", place))


# A graph of parts and customers that orders connect: weights are numbers of orders.
_TRADE = """(SELECT 'p' || l_partkey || '-c' || o_custkey AS edge_id, 'p' || l_partkey AS source, 'c' || o_custkey AS target, 'REFERENCES' AS rel_type, count(DISTINCT o_orderkey) AS weight
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_partkey, o_custkey)"""


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole graph. The tables are dealt out by their rows, so a task's share of a join or a count doesn't grow with them."""
    lines, orders = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    shares = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-lines.count() // SHARE_ROWS))
    both = lines.repartition(shares, "l_orderkey").join(orders.repartition(shares, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return _traded(both.select("l_partkey", "o_custkey", "o_orderkey").repartition(shares, "l_partkey", "o_custkey"))


def _traded(bought: DataFrame) -> DataFrame:
    w = bought.groupBy("l_partkey", "o_custkey").agg(F.count_distinct("o_orderkey").cast("double").alias("weight"))
    p, c = F.concat(F.lit("p"), "l_partkey"), F.concat(F.lit("c"), "o_custkey")
    return w.select(F.concat(p, F.lit("-"), c).alias("edge_id"), p.alias("source"), c.alias("target"), F.lit("REFERENCES").alias("rel_type"), "weight")


def trade_near(spark: SparkSession, sf_dir: str) -> Callable[[DataFrame], DataFrame]:
    """The edges of ``trade`` from given nodes in either direction: only those nodes' rows are joined and counted."""
    lines, orders = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    met = F.col("l_orderkey") == F.col("o_orderkey")

    def near(ids: DataFrame) -> DataFrame:
        key = lambda sign, name: ids.where(F.col("id").rlike(rf"^{sign}-?\d+$")).select(F.substring("id", 2, 20).try_cast("long").alias(name)).distinct()
        # What is left of a table is written, so its size is known when the join with the other one is planned.
        parts = kept(lines.join(key("p", "l_partkey"), "l_partkey", "left_semi")).join(orders, met)
        customers = kept(orders.join(key("c", "o_custkey"), "o_custkey", "left_semi")).join(lines, met)
        forward, back = _traded(parts), _traded(customers)
        return forward.union(back.select("edge_id", "target", "source", "rel_type", "weight"))

    return near


def _active(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").where("c_acctbal >= 0").select(F.concat(F.lit("c"), "c_custkey").alias("id"))
    return c.union(table(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id")))


def _seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = table(spark, sf_dir, "part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(12)
    return best.select(F.concat(F.lit("p"), "p_partkey").alias("id"))


_BOTH = f"(SELECT edge_id, source, target, rel_type, weight FROM {_TRADE} UNION ALL SELECT edge_id, target, source, rel_type, weight FROM {_TRADE})"
_ACTIVE = "(SELECT 'c' || c_custkey AS id FROM customer WHERE c_acctbal >= 0 UNION ALL SELECT 'p' || p_partkey FROM part)"
_SEEDS = "(SELECT 'p' || p_partkey AS id FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 12)"


@registry.add(f"""SELECT DISTINCT source AS seed, target AS id, rel_type, CAST(weight AS DOUBLE) AS weight FROM {_BOTH} WHERE source IN (SELECT id FROM {_SEEDS}) AND target IN (SELECT id FROM {_ACTIVE})
ORDER BY weight DESC, rel_type, id, seed LIMIT 24""")
def graph_expand_1hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expand(_seeds(spark, sf_dir), trade_near(spark, sf_dir), _active(spark, sf_dir))


@registry.add(f"""WITH b AS MATERIALIZED (SELECT * FROM {_BOTH}) SELECT DISTINCT x.source AS seed, y.target AS id, x.rel_type || '->' || y.rel_type AS rel_type, CAST(y.weight AS DOUBLE) AS weight
FROM b x JOIN b y ON x.target = y.source WHERE x.source IN (SELECT id FROM {_SEEDS}) AND x.edge_id <> y.edge_id AND y.target <> x.source AND y.target IN (SELECT id FROM {_ACTIVE})
ORDER BY weight DESC, rel_type, id, seed LIMIT 16""")
def graph_expand_2hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expand_twice(_seeds(spark, sf_dir), trade_near(spark, sf_dir), _active(spark, sf_dir))


def neighbourhood(edge: DataFrame, rel_types: tuple[str, ...] = TRAVERSED) -> DataFrame:
    """id, neighbours and rel_types: how many nodes each node touches in either direction, and by what."""
    both = edge.where(F.col("rel_type").isin(*rel_types)).select(F.explode(F.array(F.struct(F.col("source").alias("id"), F.col("target").alias("other"), "rel_type"), F.struct(F.col("target").alias("id"), F.col("source").alias("other"), "rel_type"))).alias("e"))
    return both.select("e.*").groupBy("id").agg(F.count_distinct("other").alias("neighbours"), F.array_join(F.array_sort(F.collect_set("rel_type")), ",").alias("rel_types"))


@registry.add(f"""SELECT id, count(DISTINCT other) AS neighbours, string_agg(DISTINCT rel_type, ',' ORDER BY rel_type) AS rel_types FROM (SELECT source AS id, target AS other, rel_type FROM {_EDGES} UNION ALL SELECT target, source, rel_type FROM {_EDGES}) GROUP BY 1""")
def graph_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbourhood(edges(spark, sf_dir))


_CHAIN = "(SELECT * FROM (SELECT doc_id AS source, lead(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS target FROM documents) WHERE target IS NOT NULL)"


@registry.add(f"""WITH RECURSIVE c AS (SELECT source AS ancestor, target AS descendant, 1 AS depth, source || '>' || target AS path FROM {_CHAIN}
UNION ALL SELECT ancestor, e.target, depth + 1, path || '>' || e.target FROM c JOIN {_CHAIN} e ON e.source = descendant WHERE depth < 5) SELECT * FROM c""")
def graph_prerequisite_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chain of up to five steps from a document to a later one of its source, with its path."""
    following = F.lead("doc_id").over(Window.partitionBy("source").orderBy("doc_id"))
    chain = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source"), following.alias("target")).where("target IS NOT NULL")
    return closure(chain, 5).withColumn("path", F.array_join("path", ">"))


def properties(nodes: dict[str, DataFrame]) -> list[tuple[str, str, int]]:
    """Label, property and place of every property of the node tables, read from their schemas."""
    return [(label, name, place) for label, df in nodes.items() for place, name in enumerate(df.columns, 1)]


@registry.add("SELECT table_name AS label, column_name AS property, CAST(ordinal_position AS INT) AS place FROM information_schema.columns WHERE table_name IN ('customer', 'orders', 'part', 'supplier')")
def graph_schema_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = ("customer", "orders", "part", "supplier")
    return spark.createDataFrame(properties({t: table(spark, sf_dir, t) for t in labels}), "label string, property string, place int")
