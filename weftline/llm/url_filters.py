"""URL filters: host and path rules, and a tree of path templates judged by labelled purity, in Spark functions only.

A host's paths make a tree of segments. At each node a segment that is frequent enough stays as it is; the others
become a wildcard, which keeps a file ending. Then siblings whose labelled shares don't differ
significantly are merged into one branch, in order of their shares. Each level reads the distinct paths' counts
and gives a table of the branches that aren't wildcards, at most MOST_BRANCHES a node; a path finds its template by
one join a level. A template whose smoothed share of bad labels reaches REJECT is rejected; the smoothing draws
towards the host's share, and that towards the share of all.

Defined cases: a null URL, or one without ``://``, has an empty host and an empty path, a node of its own; hosts and paths
of any length are taken whole; segments beyond DEPTH share the template's end ``/**``; repeated URLs count each time; a row
without a label counts for the tree but not for purity; without labels nothing is rejected; an empty table gives an empty
result; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Levels of the tree; rows that a segment needs to stay, and the most segments of a node that stay (each has that share of it).
DEPTH, LEAST_ROWS, MOST_BRANCHES = 4, 8, 32
#: Rows that the wider share counts for in a smoothed one; the normal deviate beyond which shares differ; the share that rejects.
SMOOTHING, DEVIATE, REJECT = 4.0, 1.96, 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str  # allow or block

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Tree:
    """``levels``: for each level host, template, segment and branch; ``rejected``: host and template."""

    levels: list[tuple[DataFrame, int]]
    rejected: tuple[DataFrame, int]
    templates: DataFrame


def host(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    found = F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; empty without a host part."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host_: Column, path_: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits; null if none does. A rule fits its host and all subdomains."""
    name = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host_ == rule.host) | host_.endswith("." + rule.host)) & path_.startswith(rule.path)
        name, verdict = F.when(fits, rule.name).otherwise(name), F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


def _segments(path_: Column) -> Column:
    """The path's segments; none for a path without ``/``. The one after a last ``/`` is empty."""
    return F.when(path_.startswith("/"), F.split(F.substring(path_, 2, 1 << 30), "/")).otherwise(F.array().cast("array<string>"))


def _wildcard(segment: Column) -> Column:
    return F.concat(F.lit("*"), F.regexp_extract(segment, r"(\.[A-Za-z]{1,5})\z", 1))


def _smoothed(bad: Column, labelled: Column, wider: Column) -> Column:
    return (bad + SMOOTHING * wider) / (labelled + SMOOTHING)


def place(rows: DataFrame, levels: Sequence[tuple[DataFrame, int]]) -> DataFrame:
    """``rows`` (with host and segments) with their template, as far as ``levels`` go."""
    placed = rows.withColumn("template", F.lit(""))
    for depth, (branches, n) in enumerate(levels):
        there, key = F.size("segments") > depth, F.get("segments", F.lit(depth))
        named = branches.select(F.col("host").alias("_h"), F.col("template").alias("_t"), F.col("segment").alias("_s"), "branch")
        joined = placed.join(common.small_or_not(named, n), (placed["host"] == F.col("_h")) & (placed["template"] == F.col("_t")) & (key == F.col("_s")), "left")
        step = F.concat("template", F.lit("/"), F.coalesce("branch", _wildcard(key)))
        placed = joined.withColumn("template", F.when(there, step).otherwise(F.col("template"))).drop("_h", "_t", "_s", "branch")
    return placed


def branches(nodes: DataFrame, depth: int) -> DataFrame:
    """host, template, segment and branch of the segments that stay at this level; ``nodes`` has rows, labelled and bad of each path."""
    counts = [F.sum(c).alias(c) for c in ("rows", "labelled", "bad")]
    here = nodes.where(F.size("segments") > depth)
    children = here.groupBy("host", "template", F.get("segments", F.lit(depth)).alias("segment")).agg(*counts).where(F.col("rows") >= LEAST_ROWS)
    node = here.groupBy(F.col("host").alias("_h"), F.col("template").alias("_t")).agg(*[F.sum(c).alias("_" + c) for c in ("rows", "labelled", "bad")])
    frequent = children.join(node, (F.col("host") == F.col("_h")) & (F.col("template") == F.col("_t"))).where(F.col("rows") * MOST_BRANCHES >= F.col("_rows"))
    wider = F.when(F.col("_labelled") > 0, F.col("_bad") / F.col("_labelled")).otherwise(F.lit(0.0))
    share = frequent.withColumn("share", _smoothed(F.col("bad"), F.col("labelled"), wider))
    order = Window.partitionBy("host", "template").orderBy("share", "segment")
    before = {c: F.lag(c).over(order) for c in ("bad", "labelled")}
    pairs = share.withColumn("_b", before["bad"]).withColumn("_l", before["labelled"])
    # Two shares differ if the squared difference passes that many squared deviations under the pooled share.
    pooled = (F.col("bad") + F.col("_b")) / (F.col("labelled") + F.col("_l"))
    gap = F.col("bad") / F.col("labelled") - F.col("_b") / F.col("_l")
    spread = pooled * (1 - pooled) * (1 / F.col("labelled").cast("double") + 1 / F.col("_l").cast("double"))
    differ = F.when((F.col("_l") > 0) & (F.col("labelled") > 0), gap * gap > F.lit(DEVIATE * DEVIATE) * spread).otherwise(F.lit(False))
    groups = pairs.withColumn("_new", differ.cast("int")).withColumn("_group", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    own = Window.partitionBy("host", "template", "_group")
    names = F.sort_array(F.collect_list("segment").over(own))
    merged = F.when(F.size(names) > 1, F.concat(F.lit("{"), F.array_join(names, "|"), F.lit("}"))).otherwise(F.col("segment"))
    return groups.withColumn("branch", merged).select("host", "template", "segment", "branch")


def grow(labelled: DataFrame, depth: int = DEPTH) -> Tree:
    """The tree over all rows of ``labelled``: host, path and bad (true or false, null without a label)."""
    paths = common.written(
        labelled.groupBy("host", "path").agg(F.count(F.lit(1)).alias("rows"), F.count("bad").alias("labelled"), F.count_if("bad").alias("bad"))
        .select("host", _segments(F.col("path")).alias("segments"), "rows", "labelled", "bad")
    )
    levels: list[tuple[DataFrame, int]] = []
    for d in range(depth):
        level = common.written(branches(place(paths, levels), d))
        levels.append((level, level.count()))
    sums = [F.sum(c).alias(c) for c in ("rows", "labelled", "bad")]
    templates = common.written(place(paths, levels).groupBy("host", _ended(depth).alias("template")).agg(*sums))
    total = templates.agg(F.sum("labelled").alias("n"), F.sum("bad").alias("bad")).first()
    base = total["bad"] / total["n"] if total["n"] else 0.0
    hosts = templates.groupBy(F.col("host").alias("_h")).agg(F.sum("labelled").alias("_l"), F.sum("bad").alias("_b"))
    wider = _smoothed(F.col("_b"), F.col("_l"), F.lit(base))
    judged = templates.join(hosts, F.col("host") == F.col("_h")).withColumn("bad_share", _smoothed(F.col("bad"), F.col("labelled"), wider))
    judged = common.written(judged.select("host", "template", "rows", "labelled", "bad", "bad_share"))
    rejected = judged.where((F.col("bad_share") >= REJECT) & (F.col("labelled") > 0)).select("host", "template")
    return Tree(levels, (rejected, rejected.count()), judged)


def _ended(depth: int) -> Column:
    return F.concat("template", F.when(F.size("segments") > depth, "/**").otherwise(""))


def judge(pages: DataFrame, rules: Sequence[Rule], tree: Tree) -> DataFrame:
    """page_id, host, path, template, rule and verdict of every page: the longest rule's, else the template's."""
    placed = place(pages.select("page_id", "host", "path", _segments(F.col("path")).alias("segments")), tree.levels)
    placed = placed.withColumn("template", _ended(len(tree.levels)))
    table, n = tree.rejected
    known = table.select(F.col("host").alias("_h"), F.col("template").alias("_t"))
    joined = placed.join(common.small_or_not(known, n), (placed["host"] == F.col("_h")) & (placed["template"] == F.col("_t")), "left")
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("_h").isNotNull(), "block").otherwise("allow")
    return joined.select("page_id", "host", "path", "template", name.alias("rule"), F.coalesce(verdict, own).alias("verdict"))


def page_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """host, path and bad of every page; a page's label is that of the document its path's last number names.

    A document of low quality, or a toxic one, is bad; of several labels the worst counts.
    """
    marked = labels.where(F.col("quality").isNotNull() | F.col("toxic").isNotNull())
    worst = marked.groupBy(F.col("doc_id").cast("long").alias("_doc")).agg(
        F.max(F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("bad")
    )
    split = pages.select(host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    number = F.regexp_extract("path", r"/([0-9]{1,18})(\.[a-z]+)?/?\z", 1)
    split = split.withColumn("_id", F.when(number != "", number.cast("long")))
    return split.join(worst, split["_id"] == worst["_doc"], "left").select("host", "path", "bad")


def judge_pages(pages: DataFrame, labels: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The verdict of every page, by ``rules`` and by the tree that all pages make."""
    parts = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    return judge(parts, rules, grow(page_labels(pages, labels)))
