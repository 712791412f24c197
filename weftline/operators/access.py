"""Role access over users, roles, areas and documents; every check is a semi-join, none is cached."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.registry import Registry
from ..sources.tables import table

registry = Registry()

# Roles by rank, and the areas that each role may query.
ROLE_RANK = {"public": 0, "regular": 1, "compliance": 2, "admin": 3}
GRANTS = [("admin", "esg"), ("admin", "structured"), ("admin", "policies"), ("compliance", "esg"), ("compliance", "structured"), ("regular", "structured"), ("public", "esg")]
_GRANTS = "(VALUES " + ", ".join(f"('{r}', '{a}')" for r, a in GRANTS) + ") AS g(role, area)"
_USERS = "(VALUES (0, 'admin'), (1, 'compliance'), (2, 'regular'), (3, 'public')) AS u(user_id, role)"


def grants(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(GRANTS, "role string, area string")


def accessible_areas(user_roles: DataFrame, granted: DataFrame) -> DataFrame:
    """user_id and area, once each."""
    return user_roles.join(granted, "role").select("user_id", "area").distinct()


def visible(documents: DataFrame, user_areas: DataFrame) -> DataFrame:
    """``documents`` (with area) that one user's areas open."""
    return documents.join(user_areas, "area", "left_semi")


def role_rank(role: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in ROLE_RANK.items() for x in kv]), role)


def has_role(role: Column, least: str) -> Column:
    return F.coalesce(role_rank(role) >= ROLE_RANK[least], F.lit(False))


def role_of(users: DataFrame, by_email: DataFrame, trusted: list[str], by_group: DataFrame, default: str = "public") -> DataFrame:
    """user_id and role: by e-mail, else regular for a trusted domain, else the highest of the groups, else the default.

    ``users`` has user_id, email and groups; the maps have email and role, group and role.
    """
    groups = users.select("user_id", F.explode("groups").alias("group")).join(by_group, "group")
    best = groups.groupBy("user_id").agg(F.max_by("role", role_rank(F.col("role"))).alias("group_role"))
    mapped = users.join(by_email.withColumnRenamed("role", "email_role"), "email", "left").join(best, "user_id", "left")
    domain = F.when(F.substring_index("email", "@", -1).isin(trusted), F.lit("regular"))
    return mapped.select("user_id", F.coalesce("email_role", domain, "group_role", F.lit(default)).alias("role"))


def _users(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0, "admin"), (1, "compliance"), (2, "regular"), (3, "public")], "user_id int, role string")


_AREA = "CASE doc_id % 3 WHEN 0 THEN 'esg' WHEN 1 THEN 'structured' ELSE 'policies' END"


@registry.add(f"SELECT u.user_id, a.area, EXISTS (SELECT 1 FROM {_GRANTS} WHERE g.role = u.role AND g.area = a.area) AS allowed FROM {_USERS}, (SELECT DISTINCT area FROM {_GRANTS}) a")
def rbac_access_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, u = grants(spark), _users(spark)
    allowed = accessible_areas(u, g).withColumn("allowed", F.lit(True))
    every = u.select("user_id", F.explode(F.array(*map(F.lit, sorted({a for _, a in GRANTS})))).alias("area"))
    return every.join(allowed, ["user_id", "area"], "left").select("user_id", "area", F.coalesce("allowed", F.lit(False)).alias("allowed"))


@registry.add(f"SELECT u.user_id, count(*) AS documents, CAST(sum(doc_id) AS BIGINT) AS id_sum FROM {_USERS} JOIN {_GRANTS} ON g.role = u.role JOIN (SELECT doc_id, {_AREA} AS area FROM documents) d ON d.area = g.area GROUP BY 1")
def rbac_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    area = F.element_at(F.array(F.lit("esg"), F.lit("structured"), F.lit("policies")), (F.col("doc_id") % 3 + 1).cast("int"))
    # One row an area first: users meet areas, not documents.
    by_area = table(spark, sf_dir, "documents").groupBy(area.alias("area")).agg(F.count("*").alias("n"), F.sum("doc_id").alias("s"))
    return accessible_areas(_users(spark), grants(spark)).join(by_area, "area").groupBy("user_id").agg(F.sum("n").alias("documents"), F.sum("s").alias("id_sum"))


def access_report(user_roles: DataFrame, granted: DataFrame, documents: DataFrame, requested: DataFrame) -> DataFrame:
    """user_id, roles, areas, allowed and denied: what each user asked for (user_id, doc_id) by whether one of its areas opens it.

    ``documents`` has doc_id and area. A document that isn't known is denied.
    """
    areas = accessible_areas(user_roles, granted)
    asked = requested.distinct().join(documents, "doc_id", "left").join(areas.withColumn("open", F.lit(True)), ["user_id", "area"], "left")
    seen = asked.groupBy("user_id", "doc_id").agg(F.coalesce(F.bool_or("open"), F.lit(False)).alias("open"))
    counts = seen.groupBy("user_id").agg(F.count_if("open").alias("allowed"), F.count_if(~F.col("open")).alias("denied"))
    listed = lambda df, c, name: df.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set(c)), ",").alias(name))
    out = listed(user_roles, "role", "roles").join(listed(areas, "area", "areas"), "user_id", "left").join(counts, "user_id", "left")
    return out.fillna({"areas": "", "allowed": 0, "denied": 0})


def denied(user_roles: DataFrame, granted: DataFrame, area: str) -> DataFrame:
    """user_id and text for the users who may not query ``area``: what they get instead of a search."""
    allowed = accessible_areas(user_roles, granted).where(F.col("area") == area).select("user_id")
    text = F.concat(F.lit("Access denied: your role may not query "), F.lit(area))
    return user_roles.select("user_id").distinct().join(allowed, "user_id", "left_anti").select("user_id", F.lit("access_denied").alias("id"), text.alias("text"))


def may_edit(user_roles: DataFrame, owners: DataFrame, least: str = "compliance") -> DataFrame:
    """user_id and policy that a user may edit: a policy of its own role, from ``least`` upward; ``owners`` has policy and role."""
    return user_roles.where(has_role(F.col("role"), least)).join(owners, "role").select("user_id", "policy").distinct()


@registry.add(f"""WITH q AS (SELECT u.user_id, u.role, doc_id, {_AREA} AS area FROM {_USERS}, documents WHERE doc_id % 4 = u.user_id),
s AS (SELECT user_id, doc_id, EXISTS (SELECT 1 FROM {_GRANTS} WHERE g.role = q.role AND g.area = q.area) AS open FROM q)
SELECT u.user_id, u.role AS roles, (SELECT string_agg(area, ',' ORDER BY area) FROM {_GRANTS} WHERE g.role = u.role) AS areas,
(SELECT count(*) FROM s WHERE s.user_id = u.user_id AND open) AS allowed, (SELECT count(*) FROM s WHERE s.user_id = u.user_id AND NOT open) AS denied FROM {_USERS}""")
def rbac_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    area = F.element_at(F.array(F.lit("esg"), F.lit("structured"), F.lit("policies")), (F.col("doc_id") % 3 + 1).cast("int"))
    d = table(spark, sf_dir, "documents").select("doc_id", area.alias("area"))
    return access_report(_users(spark), grants(spark), d, d.select((F.col("doc_id") % 4).cast("int").alias("user_id"), "doc_id"))


@registry.add(f"SELECT user_id, 'access_denied' AS id, 'Access denied: your role may not query structured' AS text FROM {_USERS} WHERE NOT EXISTS (SELECT 1 FROM {_GRANTS} WHERE g.role = u.role AND g.area = 'structured')")
def rbac_denied(spark: SparkSession, sf_dir: str) -> DataFrame:
    return denied(_users(spark), grants(spark), "structured")
