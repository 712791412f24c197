"""Revisions of logical documents: hashes, duplicate skipping, activation and id remapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.registry import Registry
from ..sources.tables import table

registry = Registry()


# Lengths that logical ids are cut to.
KEY_LONGEST, SLUG_LONGEST = 160, 120


def file_stem(path: Column, job_id: Column | None = None) -> Column:
    """The file's name without folder and last suffix, and without the job's id that uploads put first."""
    stem = F.regexp_replace(F.regexp_replace(path, r"(?s)^.*/", ""), r"(?s)(?<=.)\.[^.]*$", "")
    if job_id is None:
        return stem
    prefix = F.concat(job_id, F.lit("_"))
    return F.when(stem.startswith(prefix), F.substring(stem, F.length(prefix) + 1, F.length(stem))).otherwise(stem)


def slug_key(stem: Column) -> Column:
    return F.coalesce(F.nullif(F.substring(X.slug(stem), 1, SLUG_LONGEST), F.lit("")), F.lit("document"))


def logical_id(path: Column, doc_key: Column, job_id: Column | None = None) -> Column:
    """The key in lower case and made safe; without one, ``doc_`` and the slug of the file's stem."""
    key = F.substring(F.btrim(F.regexp_replace(F.lower(F.trim(doc_key)), r"[^a-z0-9._-]+", "_"), F.lit("_")), 1, KEY_LONGEST)
    slug = slug_key(file_stem(path, job_id))
    given = F.coalesce(F.trim(doc_key) != "", F.lit(False))
    return F.when(given, F.coalesce(F.nullif(key, F.lit("")), slug)).otherwise(F.concat(F.lit("doc_"), slug))


def revision_id(logical: Column, version: Column) -> Column:
    return F.concat(logical, F.lit(":r"), version.cast("string"))


def revisions(uploads: DataFrame) -> DataFrame:
    """Uploads (logical, seq, content) with hash, version, status and skipped.

    An upload equal to the revision before it is skipped; others count versions up, and the
    last version is active.
    """
    order = Window.partitionBy("logical").orderBy("seq")
    hashed = uploads.withColumn("hash", F.sha2(F.col("content").cast("binary"), 256)).drop("content")
    skipped = F.coalesce(F.lag("hash").over(order) == F.col("hash"), F.lit(False))
    marked = hashed.withColumn("skipped", skipped)
    version = F.sum((~F.col("skipped")).cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    counted = marked.withColumn("version", version)
    last = F.max("version").over(Window.partitionBy("logical"))
    status = F.when(F.col("skipped"), "SKIPPED").when(F.col("version") == last, "ACTIVE").otherwise("EXPIRED")
    return counted.withColumn("status", status)


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Upsert: the last row of each key wins."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_r", rank).where("_r = 1").drop("_r")


def merge_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """Edges unique by source, target and type; a new edge replaces weight and properties."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return latest(both, ["source", "target", "rel_type"], [F.desc("_new")]).drop("_new")


def remap(id_: Column, logical: Column, version: Column) -> Column:
    """``id_`` under its revision's prefix; applying it twice changes nothing."""
    prefix = F.concat(revision_id(logical, version), F.lit("::"))
    return F.when(id_.startswith(prefix), id_).otherwise(F.concat(prefix, id_))


def stamped_nodes(nodes: DataFrame, plan: DataFrame) -> DataFrame:
    """``nodes`` (document, id, type, title) under their revision: ids with its prefix, the document's node as its root, lineage added.

    ``plan`` has document, logical, version, hash, root (an id without prefix) and title, one row a document.
    """
    is_root = F.col("type").isin("Document", "Book")
    id_ = remap(F.when(is_root, F.col("root")).otherwise(F.col("id")), F.col("logical"), F.col("version"))
    title = F.when(is_root, F.coalesce("plan_title", "title")).otherwise(F.col("title"))
    met = nodes.join(plan.withColumnRenamed("title", "plan_title"), "document").withColumn("id", id_).withColumn("title", title)
    met = met.withColumn("revision_id", revision_id(F.col("logical"), F.col("version"))).withColumn("lifecycle_status", F.lit("ACTIVE"))
    return met.select(*nodes.columns, F.col("logical").alias("logical_doc_id"), "revision_id", "lifecycle_status", F.col("hash").alias("content_hash"))


def stamped_edges(edges: DataFrame, plan: DataFrame) -> DataFrame:
    """``edges`` (document, source, target) between prefixed ids, with their revision."""
    met = edges.join(plan.select("document", "logical", "version"), "document")
    ends = {c: remap(F.col(c), F.col("logical"), F.col("version")) for c in ("source", "target")}
    return met.withColumns(ends).select(*edges.columns, revision_id(F.col("logical"), F.col("version")).alias("revision_id"), F.col("logical").alias("logical_doc_id"))


def metadata_edges(plan: DataFrame) -> DataFrame:
    """source, target and rel_type that tie a logical document to its revisions, the active one, and each revision to its root."""
    rev = revision_id(F.col("logical"), F.col("version"))
    edge = lambda a, b, rel: F.struct(a.alias("source"), b.alias("target"), F.lit(rel).alias("rel_type"))
    made = F.array(
        edge(F.col("logical"), rev, "HAS_REVISION"),
        F.when(F.col("status") == "ACTIVE", edge(F.col("logical"), rev, "ACTIVE_REVISION")),
        edge(rev, remap(F.col("root"), F.col("logical"), F.col("version")), "ROOT"),
    )
    return plan.select(F.explode(F.filter(made, lambda e: e.isNotNull())).alias("e")).select("e.*")


def installed(old: DataFrame, new: DataFrame) -> DataFrame:
    """The content rows after an upload: those of the logical documents in ``new`` are replaced, all others stay."""
    return old.join(new.select("logical_doc_id").distinct(), "logical_doc_id", "left_anti").unionByName(new)


def merged_logical(old: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """Logical documents (id, title, created, updated) after the uploads ``new`` (id, title): a new one is created now, a known one gets title and time."""
    met = old.join(new.select("id", F.col("title").alias("new_title"), F.lit(True).alias("met")), "id", "full")
    return met.select(
        "id", F.coalesce("new_title", "title").alias("title"), F.coalesce("created", now).alias("created"), F.when(F.col("met"), now).otherwise(F.col("updated")).alias("updated")
    )


def replaced_roles(user_roles: DataFrame, incoming: DataFrame) -> DataFrame:
    """user_id and role after a sign-in: a user of ``incoming`` has its roles and no others."""
    return user_roles.join(incoming.select("user_id").distinct(), "user_id", "left_anti").unionByName(incoming.distinct())


def is_active(status: Column) -> Column:
    return F.coalesce(status, F.lit("ACTIVE")) == "ACTIVE"


def in_scope(document: str | None, logical: Column, id_: Column) -> Column:
    """Whether a node belongs to a document: null means all."""
    if document is None:
        return F.lit(True)
    return (logical == document) | (id_ == document) | id_.startswith(document + ":") | (logical.isNull() & id_.startswith(document + "_"))


# Sources are logical documents; their documents, in order of id, are uploads.
_UPLOADS = "(SELECT source AS logical, doc_id AS seq, sha256(text) AS hash FROM documents)"
_MARKED = f"(SELECT *, coalesce(lag(hash) OVER (PARTITION BY logical ORDER BY seq) = hash, false) AS skipped FROM {_UPLOADS})"
_VERSIONED = f"(SELECT *, CAST(sum(CASE WHEN skipped THEN 0 ELSE 1 END) OVER (PARTITION BY logical ORDER BY seq) AS BIGINT) AS version FROM {_MARKED})"


def _revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return revisions(d.select(F.col("source").alias("logical"), F.col("doc_id").alias("seq"), F.col("text").alias("content")))


@registry.add("""SELECT doc_id, hash, first_id, doc_id <> first_id AS duplicate FROM (SELECT doc_id, sha256(text) AS hash, min(doc_id) OVER (PARTITION BY sha256(text)) AS first_id FROM documents)""")
def ver_duplicate_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("hash"))
    first = hashed.groupBy("hash").agg(F.min("doc_id").alias("first_id"))
    return hashed.join(first, "hash").select("doc_id", "hash", "first_id", (F.col("doc_id") != F.col("first_id")).alias("duplicate"))


@registry.add(f"""SELECT logical, seq, hash, version, CASE WHEN skipped THEN 'SKIPPED' WHEN version = max(version) OVER (PARTITION BY logical) THEN 'ACTIVE' ELSE 'EXPIRED' END AS status FROM {_VERSIONED}""")
def ver_active_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _revisions(spark, sf_dir).select("logical", "seq", "hash", "version", "status")


@registry.add(f"SELECT seq AS doc_id, logical || ':r' || version || '::doc_' || seq AS id FROM {_VERSIONED}")
def ver_id_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = remap(F.concat(F.lit("doc_"), "seq"), F.col("logical"), F.col("version"))
    again = remap(F.col("id"), F.col("logical"), F.col("version"))
    return _revisions(spark, sf_dir).withColumn("id", once).select(F.col("seq").alias("doc_id"), again.alias("id"))


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as logical documents, each changed document as a revision."""
    root = F.concat(F.lit("doc_"), "seq")
    return _revisions(spark, sf_dir).where("NOT skipped").withColumn("root", root).withColumn("title", F.col("logical")).withColumn("document", F.col("seq"))


_PLAN = f"(SELECT *, CASE WHEN version = max(version) OVER (PARTITION BY logical) THEN 'ACTIVE' ELSE 'EXPIRED' END AS status, logical || ':r' || version AS rev FROM {_VERSIONED} WHERE NOT skipped)"


@registry.add(f"""SELECT logical AS source, rev AS target, 'HAS_REVISION' AS rel_type FROM {_PLAN} UNION ALL SELECT logical, rev, 'ACTIVE_REVISION' FROM {_PLAN} WHERE status = 'ACTIVE'
UNION ALL SELECT rev, rev || '::doc_' || seq, 'ROOT' FROM {_PLAN}""")
def ver_metadata_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata_edges(_plan(spark, sf_dir))


@registry.add(f"""SELECT CASE WHEN place = 0 THEN rev || '::doc_' || seq ELSE rev || '::doc_' || seq || '_line_' || place END AS id, logical AS logical_doc_id, rev AS revision_id, hash AS content_hash
FROM {_PLAN} p JOIN (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))) + 1)) AS place FROM documents) n ON n.doc_id = p.seq WHERE p.status = 'ACTIVE'""")
def ver_installed_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of each source's active revision: its document and lines, under the revision's prefix."""
    active = _plan(spark, sf_dir).where("status = 'ACTIVE'")
    place = F.explode(F.sequence(F.lit(0), F.size(F.split("text", "\n")))).alias("place")
    n = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document"), place)
    own = F.when(F.col("place") == 0, F.concat(F.lit("doc_"), "document")).otherwise(F.concat(F.lit("doc_"), "document", F.lit("_line_"), "place"))
    nodes = n.select("document", own.alias("id"), F.when(F.col("place") == 0, "Document").otherwise("Section").alias("type"), F.lit("").alias("title"))
    return stamped_nodes(nodes, active).select("id", "logical_doc_id", "revision_id", "content_hash")


@registry.add("""WITH o AS (SELECT source AS id, source AS title, min(doc_id) AS created, min(doc_id) AS updated FROM documents WHERE doc_id % 2 = 0 GROUP BY 1),
n AS (SELECT source AS id, upper(source) AS title FROM documents WHERE doc_id % 3 = 0 GROUP BY 1)
SELECT coalesce(o.id, n.id) AS id, coalesce(n.title, o.title) AS title, coalesce(created, 999999) AS created, CASE WHEN n.id IS NOT NULL THEN 999999 ELSE updated END AS updated FROM o FULL JOIN n ON o.id = n.id""")
def ver_merge_logical(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    old = d.where("doc_id % 2 = 0").groupBy(F.col("source").alias("id")).agg(F.first("source").alias("title"), F.min("doc_id").alias("created"), F.min("doc_id").alias("updated"))
    new = d.where("doc_id % 3 = 0").select(F.col("source").alias("id"), F.upper("source").alias("title")).distinct()
    return merged_logical(old, new, F.lit(999999).cast("long"))


@registry.add("""SELECT source, doc_id AS target, CASE WHEN doc_id % 2 = 0 THEN 2.0 ELSE 1.0 END AS weight FROM (SELECT DISTINCT source, doc_id FROM documents)""")
def ver_merge_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containment edges written twice, the second time for every other document with a new weight."""
    old = table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("target"), F.lit("CONTAINS").alias("rel_type"), F.lit(1.0).alias("weight"))
    return merge_edges(old, old.where("target % 2 = 0").withColumn("weight", F.lit(2.0))).select("source", "target", "weight")


@registry.add("""SELECT c_custkey AS user_id, CASE WHEN c_custkey % 3 = 0 THEN 'admin' ELSE c_mktsegment END AS role FROM customer""")
def rbac_replaced_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("role"))
    return replaced_roles(users, users.where("user_id % 3 = 0").withColumn("role", F.lit("admin")))


@registry.add("""SELECT doc_id, 'doc_' || CASE WHEN trim(k, '_') = '' THEN 'document' ELSE trim(k, '_') END AS logical FROM (SELECT doc_id, substr(regexp_replace(lower(substr(text, 1, 30)), '[^a-z0-9]+', '_', 'g'), 1, 120) AS k FROM documents)""")
def ver_logical_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logical ids of uploads whose files are named by the first characters of their text, put behind a job's id."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(F.substring("text", 1, 30), "[/.]", " ").alias("name"))
    path = F.concat(F.lit("/in/job7_"), "name", F.lit(".pdf"))
    return d.select("doc_id", logical_id(path, F.lit(""), F.lit("job7")).alias("logical"))
