"""Document structuring: pages, headings, references, the section tree and outlines of web pages."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.registry import Registry
from ..sources.tables import table

registry = Registry()

#: Columns of a section tree, and characters of text that a batch of it holds before it is given out.
FIELDS = ("doc", "pos", "kind", "level", "parent", "title", "first_page", "last_page", "text")
BATCH_CHARS = 1 << 22

_LINES = r"list_filter(list_transform(string_split({}, chr(10)), lambda s: trim(s, chr(32) || chr(9) || chr(13) || chr(12) || chr(11))), lambda s: s <> '')"
_UPPER = r"(CASE WHEN length(regexp_replace(l, '[^\p{L}]', '', 'g')) > 0 THEN length(regexp_replace(l, '[^\p{Lu}]', '', 'g')) / length(regexp_replace(l, '[^\p{L}]', '', 'g')) ELSE 0 END)"


@registry.add(r"""WITH d AS (SELECT doc_id, length(text) AS n, length(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]', '', 'g')) AS p, len(string_split(text, chr(10))) AS b FROM documents),
c AS (SELECT doc_id, n, greatest(0.0, least(1.0, 0.55 * least(1.0, n / 240) + 0.25 * CASE WHEN n > 0 THEN p / n ELSE 0 END + 0.2 * least(1.0, b / 6))) AS c FROM d)
SELECT doc_id, round(c, 6) AS confidence, c < 0.35 OR n < 120 AS low_confidence, n < 120 OR c < 0.55 AS needs_fallback FROM c""")
def doc_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    c = X.extraction_confidence(F.col("text"), F.size(F.split("text", "\n")), F.lit(False))
    fallback = (F.length("text") < X.LONG_TEXT) | (F.col("c") < 0.55)
    return d.withColumn("c", c).select("doc_id", F.round("c", 6).alias("confidence"), X.is_low_confidence(F.col("text"), F.col("c")).alias("low_confidence"), fallback.alias("needs_fallback"))


@registry.add(rf"""WITH d AS (SELECT doc_id, trim(text, chr(32) || chr(9) || chr(10) || chr(13)) AS body FROM documents),
l AS (SELECT doc_id, body, {_LINES.format('body')} AS ls FROM d),
s AS (SELECT doc_id, length(body) AS c, len(ls) AS n, CASE WHEN regexp_matches(substr(body, 1, 600), '(?im)(?:^|\n)\s*(?:table\s+of\s+contents?|contents)\s*(?:\n|$)') THEN 0.45 ELSE 0 END AS h,
len(list_filter(ls, lambda x: regexp_matches(x, '(?:\.{{2,}}|…+|\s\.\s)\s*\d{{1,4}}\s*$|\s+\d{{1,4}}\s*$'))) AS t,
len(list_filter(range(1, len(ls)), lambda i: regexp_matches(ls[i + 1], '(?i)^(?:\d{{1,4}}|[ivxlcdm]{{1,6}})$') AND regexp_matches(ls[i], '[A-Za-z]'))) AS e FROM l)
SELECT doc_id, round(CASE WHEN c < 40 THEN 0 WHEN n < 3 THEN h ELSE least(1.0, h + least(0.55, 1.1 * (t + e) / n) + CASE WHEN n <= 120 AND c < 14000 THEN 0.05 ELSE 0 END) END, 6) AS toc_score FROM s""")
def doc_toc_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.round(X.toc_score(F.col("text")), 6).alias("toc_score"))


@registry.add(rf"""WITH l AS (SELECT doc_id, unnest({_LINES.format('text')}) AS l FROM documents)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE length(l) BETWEEN 3 AND 160 AND len(regexp_split_to_array(l, '\s+')) <= 18
AND NOT (regexp_matches(l, '{X.TABLE_OR_FIGURE}') AND length(l) > 80)
AND (length(trim(regexp_extract(l, '^(\d+(?:\.\d+)*\.?)\s+(.+)$', 2))) >= 2 OR (regexp_matches(l, '{X.COMMON_HEADING}') AND len(regexp_split_to_array(l, '\s+')) <= 12)
OR ({_UPPER} > 0.72 AND len(regexp_split_to_array(l, '\s+')) BETWEEN 2 AND 10))) AS n_headings FROM l GROUP BY 1""")
def doc_heading_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", X.solid_lines(F.col("text")).alias("ls"))
    headings = F.size(F.filter("ls", lambda x: X.is_heading(x))).cast("long")
    return lines.where(F.size("ls") > 0).select("doc_id", F.size("ls").cast("long").alias("n_lines"), headings.alias("n_headings"))


_LABEL = " , ".join(
    f"CASE WHEN length(regexp_extract(s, '{p}', 1)) BETWEEN 1 AND 12 THEN regexp_extract(s, '{p}', 1) END" for p in X.PAGE_LABELS
)
# Every document with a last line that may be a printed page label: a number, a Roman one, a page's name, or none.
_FOOTED = "CASE doc_id % 5 WHEN 0 THEN concat(doc_id % 300, '') WHEN 1 THEN element_at(array('i', 'iv', 'ix', 'xiv'), CAST(doc_id % 4 + 1 AS INT)) WHEN 2 THEN concat('Page ', doc_id) WHEN 3 THEN '- 17 -' ELSE lang END"
_FOOTED_SQL = _FOOTED.replace("element_at(array('i', 'iv', 'ix', 'xiv'), CAST(doc_id % 4 + 1 AS INT))", "['i', 'iv', 'ix', 'xiv'][doc_id % 4 + 1]")


def _footed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.concat("text", F.lit("\n"), F.expr(_FOOTED)).alias("text"))


_LABELLED = rf"""WITH f AS (SELECT doc_id, text || chr(10) || {_FOOTED_SQL} AS text FROM documents), l AS (SELECT doc_id, {_LINES.format('text')} AS ls FROM f),
c AS (SELECT doc_id, ls[greatest(1, len(ls) - 3):len(ls)] || ls[1:2] AS cs FROM l),
p AS (SELECT doc_id, list_filter(list_transform(cs, lambda s: coalesce({_LABEL})), lambda x: x IS NOT NULL)[1] AS label FROM c)"""


@registry.add(_LABELLED + " SELECT doc_id, label FROM p")
def doc_page_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _footed(spark, sf_dir).select("doc_id", X.page_label(F.col("text")).alias("label"))


_ROMANS = "[" + ", ".join(f"'{r}'" for r in X.ROMAN) + "]"


@registry.add(_LABELLED + rf""", t AS (SELECT doc_id, label, CAST(doc_id AS VARCHAR) AS p, lower(label) AS low, coalesce(regexp_matches(label, '^[0-9]+$'), false) AS d,
nullif(coalesce(list_position({_ROMANS}, lower(label)), 0), 0) AS r FROM p)
SELECT doc_id, concat_ws(',', 'pdf:' || p, 'pdf-page:' || p, 'doc:' || label, 'document-page:' || label, CASE WHEN d THEN 'doc-num:' || label END,
CASE WHEN r IS NOT NULL THEN 'doc-roman:' || low END, 'doc-num:' || r, CASE WHEN label IS NOT NULL THEN CASE WHEN d AND label = p THEN 'pdf-doc-same' ELSE 'pdf-doc-differ' END END) AS tags FROM t""")
def doc_page_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = _footed(spark, sf_dir).select("doc_id", X.page_label(F.col("text")).alias("label"))
    return labelled.select("doc_id", F.array_join(X.page_tags(F.col("doc_id"), F.col("label")), ",").alias("tags"))


#: A region for each document: a table or a figure, with a title that may name others.
_REGION = {
    "id": "doc_id", "kind": "CASE WHEN doc_id % 3 = 1 THEN 'figure' ELSE 'table' END", "page": "doc_id % 50 + 1", "index": "doc_id % 4 + 1",
    "title": "CASE doc_id % 3 WHEN 0 THEN concat('Table A', doc_id % 9, ' ', source) WHEN 1 THEN concat('Figure 2.', doc_id % 5, ' and Table ', doc_id % 7) ELSE concat(lang, ' without a number') END",
}
_REGIONS = "(SELECT " + ", ".join(f"{v} AS {k}" for k, v in _REGION.items()) + " FROM documents)"


_REGION_SQL = r"""concat_ws(',', 'kind:' || kind, 'pdf:' || page, 'region:' || page || ':' || index,
nullif(array_to_string(list_transform(regexp_extract_all(lower(title), '\btable\s+([a-z]?\d+(?:\.\d+)?)\b', 1), lambda x: 'table:' || x), ','), ''),
nullif(array_to_string(list_transform(regexp_extract_all(lower(title), '\bfigure\s+(\d+(?:\.\d+)?)\b', 1), lambda x: 'figure:' || x), ','), ''),
CASE WHEN kind = 'table' AND NOT regexp_matches(lower(title), '\btable\s+([a-z]?\d+(?:\.\d+)?)\b') THEN 'table,table:' || index END, CASE WHEN kind = 'figure' THEN 'figure,figure:' || index END)"""


@registry.add(f"SELECT id, {_REGION_SQL} AS tags FROM {_REGIONS}")
def doc_region_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = table(spark, sf_dir, "documents").select(*[F.expr(v).alias(k) for k, v in _REGION.items()])
    return regions.select("id", F.array_join(X.region_tags(F.col("kind"), F.col("title"), F.col("page"), F.col("index")), ",").alias("tags"))


#: Ten documents in a row as the sections of a book: a part, eight of its subsections and an orphan, whose bodies refer to each other by number, name or place.
_TITLE = {
    "book": "doc_id - doc_id % 10", "id": "doc_id",
    "title": "CASE doc_id % 10 WHEN 0 THEN concat('2 Part ', source) WHEN 9 THEN '4.5 Orphan' ELSE concat('2.', doc_id % 10, ' Topic ', lang, doc_id % 10) END",
    "body": "CASE doc_id % 5 WHEN 0 THEN concat('as shown in Section 2.', doc_id * 7 % 9, ' below') WHEN 1 THEN concat('see Section 2.', doc_id * 3 % 8 + 1, ' and Chapter 2') "
    "WHEN 2 THEN concat('described in Section ', doc_id * 3 % 12 + 1, ' and Section 4.5') WHEN 3 THEN concat('see Section 2.', doc_id % 10) ELSE source END",
}
_TITLES = "(SELECT " + ", ".join(f"{v} AS {k}" for k, v in _TITLE.items()) + " FROM documents)"


def _books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(*[F.expr(v).alias(k) for k, v in _TITLE.items()])


_NUMBER = r"nullif(rtrim(regexp_extract(title, '^(\d+(?:\.\d+)*\.?)\s+(.+)$', 1), '.'), '')"


def document_sections(docs: DataFrame) -> DataFrame:
    """doc_id, id, title and body of the headings of each document: id is the heading's line, the body all lines up to the next.

    Lines before a document's first heading belong to no section.
    """
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = lines.withColumn("line", F.btrim("line", F.lit(" \t\r\f\v"))).withColumn("heading", X.is_heading(F.col("line")))
    order = Window.partitionBy("doc_id").orderBy("pos")
    placed = lines.withColumn("id", F.last(F.when(F.col("heading"), F.col("pos")), ignorenulls=True).over(order)).where("id IS NOT NULL")
    body = F.array_sort(F.collect_list(F.when(~F.col("heading"), F.struct("pos", "line"))))
    found = placed.groupBy("doc_id", "id").agg(F.max(F.when(F.col("heading"), F.col("line"))).alias("title"), body.alias("body"))
    return found.withColumn("body", F.array_join(F.transform("body", lambda s: s["line"]), "\n"))


def reference_edges(sections: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """source, target and mention: each place where ``body`` refers to another section.

    The section of that printed number is the target; without one, the first section whose whole
    title, or whose ``section`` and place in the order of ids, is part of the mention. Of equal titles the
    last is taken, in the first one's place. Only sections that agree on the columns ``within`` meet; these
    come first in the result.
    """
    order = Window.partitionBy(*within).orderBy("id")
    numbered = sections.withColumn("number", X.title_number(F.col("title"))).withColumn("place", F.row_number().over(order))
    mentions = numbered.select(*within, F.col("id").alias("source"), F.explode(F.array_distinct(X.references(F.col("body")))).alias("mention"))
    mentions = mentions.withColumn("printed", F.nullif(F.regexp_extract("mention", r"(\d+(?:\.\d+)*)", 1), F.lit("")))
    printed = numbered.where("number IS NOT NULL").groupBy(*within, F.col("number").alias("printed")).agg(F.max("id").alias("by_number"))
    mentions = mentions.join(printed, [*within, "printed"], "left")
    names = numbered.select(*within, "id", "place", F.explode(F.array(_key(F.col("title")), F.concat(F.lit("section "), "place"))).alias("key"))
    names = names.where("key <> ''").groupBy(*within, "key").agg(F.max("id").alias("target"), F.min("place").alias("place"))
    unmet = mentions.where("by_number IS NULL OR by_number = source").select(*within, "source", "mention")
    same = reduce(and_, [unmet[c].eqNullSafe(names[c]) for c in within], F.lit(True))
    found = unmet.join(names, same & F.contains(F.lower(unmet["mention"]), names["key"]) & (unmet["source"] != names["target"]))
    found = found.groupBy(*[unmet[c] for c in within], "source", "mention").agg(F.min_by("target", F.struct("place", "key")).alias("target"))
    direct = mentions.where("by_number <> source").select(*within, "source", F.col("by_number").alias("target"), "mention")
    return direct.union(found.select(*within, "source", "target", "mention"))


def _key(title: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(title), r"\s+", " "))


def number_hierarchy(sections: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """parent and child of sections whose numbers differ by the last part; a missing parent makes no edge."""
    numbered = sections.select(*within, "id", X.title_number(F.col("title")).alias("number")).where("number IS NOT NULL")
    children = numbered.where(F.col("number").contains(".")).select(*within, F.col("id").alias("child"), F.regexp_replace("number", r"\.[^.]+$", "").alias("number"))
    return children.join(numbered.withColumnRenamed("id", "parent"), [*within, "number"]).select(*within, "parent", "child")


@registry.add()
def document_reference_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reference_edges(document_sections(table(spark, sf_dir, "documents")), ("doc_id",))


@registry.add()
def document_number_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return number_hierarchy(document_sections(table(spark, sf_dir, "documents")), ("doc_id",))


def heading_tags(sections: DataFrame) -> DataFrame:
    """doc_id, id and tags of the headings that name a table or figure; the first one named is the kind, the document the page."""
    named = sections.withColumn("kind", X.region_kind(F.col("title"))).where("kind IS NOT NULL")
    named = named.withColumn("index", F.row_number().over(Window.partitionBy("doc_id").orderBy("id")))
    return named.select("doc_id", "id", F.array_join(X.region_tags(F.col("kind"), F.col("title"), F.col("doc_id"), F.col("index")), ",").alias("tags"))


@registry.add()
def document_region_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heading_tags(document_sections(table(spark, sf_dir, "documents")))


_MENTION = X.REFERENCE.replace(r"[\w\d\.]+", r"[\p{L}\p{N}_.]+")


@registry.add(rf"""WITH s AS (SELECT *, {_NUMBER} AS number, row_number() OVER (PARTITION BY book ORDER BY id) AS place FROM {_TITLES}),
m AS (SELECT DISTINCT book, id AS source, unnest(regexp_extract_all(body, '(?i){_MENTION}')) AS mention FROM s),
n AS (SELECT book, source, mention, max(t.id) AS target FROM m LEFT JOIN s t USING (book) WHERE true GROUP BY 1, 2, 3, regexp_extract(mention, '(\d+(?:\.\d+)*)', 1), t.number HAVING t.number = regexp_extract(mention, '(\d+(?:\.\d+)*)', 1)),
k AS (SELECT book, lower(regexp_replace(trim(title), '\s+', ' ', 'g')) AS key, id, place FROM s UNION ALL SELECT book, 'section ' || place, id, place FROM s),
q AS (SELECT book, key, max(id) AS target, min(place) AS place FROM k WHERE key <> '' GROUP BY 1, 2),
u AS (SELECT m.book, m.source, m.mention, n.target FROM m LEFT JOIN n ON n.book = m.book AND n.source = m.source AND n.mention = m.mention)
SELECT book, source, target, mention FROM u WHERE target <> source UNION ALL
SELECT u.book, source, arg_min(q.target, (q.place, key)) AS target, mention FROM u JOIN q ON q.book = u.book AND contains(lower(mention), key) AND q.target <> source WHERE u.target IS NULL OR u.target = source GROUP BY 1, 2, 4""")
def doc_reference_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reference_edges(_books(spark, sf_dir), ("book",))


@registry.add(rf"""WITH s AS (SELECT book, id, {_NUMBER} AS number FROM {_TITLES})
SELECT p.book, p.id AS parent, c.id AS child FROM s c JOIN s p ON p.book = c.book AND p.number = regexp_replace(c.number, '\.[^.]+$', '') WHERE c.number LIKE '%.%'""")
def doc_number_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return number_hierarchy(_books(spark, sf_dir), ("book",))


def merged_numbers(blocks: DataFrame) -> DataFrame:
    """``blocks`` (doc, pos, text) in which a number on a line of its own goes before the next line's text; of several in a row the last does."""
    order = Window.partitionBy("doc").orderBy("pos")
    alone = X.is_standalone_number(F.trim("text"))
    before = F.lag(F.when(alone, F.rtrim("text", F.lit("."))), 1).over(order)
    merged = blocks.withColumn("_number", before).where(~alone)
    return merged.withColumn("text", F.when(F.col("_number").isNotNull(), F.concat_ws(" ", "_number", "text")).otherwise(F.col("text"))).drop("_number")


def heading_threshold(blocks: DataFrame) -> DataFrame:
    """doc and threshold: the upper median of the text blocks' font sizes and 1.5 more; none without sizes, so no font makes a heading.

    ``blocks`` has doc, kind and font. Sizes are few, so they are counted, not gathered: the median is the first
    size at which the running count passes half.
    """
    sizes = blocks.where("kind = 'text' AND font > 0").groupBy("doc", "font").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("doc").orderBy("font").rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy("doc")
    ranked = sizes.withColumn("upto", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(all_))
    return ranked.where(F.col("upto") > F.floor(F.col("total") / 2)).groupBy("doc").agg((F.min("font") + 1.5).alias("threshold"))


def section_tree(blocks: DataFrame) -> DataFrame:
    """doc, pos, kind, level, parent, title, first_page, last_page and text of the chapters and sections of each document.

    ``blocks`` has doc, pos and text, and may have page, font, bold and low_confidence. Headings are picked and
    numbers read by column expressions; the stack of open headings depends on their order, so it runs over sorted
    blocks, many documents in one stream. A chapter (a number of one part) has level 1. A numbered section lies at its number's depth, one
    lower inside a chapter, and no higher than 2; other headings lie at 2, or one below an open section. Text
    before the first section of a chapter makes a preamble. A box's larger lines are its text. ``parent`` is the
    parent's pos, or -1 for the document; a section's text is its title and the blocks below it.
    """
    fonts = "font" in blocks.columns
    full = merged_numbers(blocks).withColumn("line", F.btrim(F.regexp_replace("text", r"\s*\n\s*", " "), F.lit(" \t\r\f")))
    if fonts:
        full = full.withColumn("kind", F.lit("text")) if "kind" not in full.columns else full
        full = full.join(heading_threshold(full), "doc", "left").withColumn("threshold", F.coalesce("threshold", F.lit(999.0)))
        heading = X.is_heading(F.col("line"), F.col("font"), F.col("bold"), F.col("threshold"))
    else:
        heading = X.is_heading(F.col("line"))
    if "low_confidence" in full.columns:
        heading = heading & ~F.coalesce("low_confidence", F.lit(False))
    number = F.when(heading, X.title_number(F.col("line")))
    page = F.col("page") if "page" in full.columns else F.lit(1)
    # Each task takes whole documents, one after another in the order of their blocks.
    ordered = full.repartition("doc").sortWithinPartitions("doc", "pos")
    read = ordered.where("line <> ''").select(
        F.col("doc"),
        F.col("pos").cast("long").alias("pos"),
        page.cast("int").alias("page"),
        F.btrim("text", F.lit(" \t\r\n")).alias("text"),
        heading.alias("heading"),
        X.is_box_label(F.col("line")).alias("box"),
        F.coalesce(X.number_depth(number), F.lit(0)).alias("depth"),
        X.title_words(F.col("line")).alias("words"),
    )
    doc_type = blocks.schema["doc"].dataType.simpleString()
    return read.mapInArrow(_stacked, f"doc {doc_type}, pos long, kind string, level int, parent long, title string, first_page int, last_page int, text string")


def _stacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sections of documents whose blocks come in order, one document after another.

    A section is given out when the next one begins, a chapter at the next chapter, so only open headings and one section's text are held.
    """
    made: list[dict] = []
    schema, held = None, 0
    open_: list[dict] = []  # from the chapter down
    section = chapter = None
    current = []  # the document, in a list as it may be null

    def add(kind: str, level: int, title: str, depth: int, box: bool) -> dict:
        while open_ and open_[-1]["level"] >= level:
            open_.pop()
        node = {"doc": doc, "pos": pos, "kind": kind, "level": level, "parent": open_[-1]["pos"] if open_ else -1, "title": title}
        node |= {"first_page": page, "last_page": page, "depth": depth, "box": box, "body": []}
        open_.append(node)
        return node

    def close(node: dict | None) -> int:
        """Put a heading that is complete into the result; about the characters that it takes."""
        if node is None:
            return 0
        made.append({f: node[f] for f in FIELDS[:-1]} | {"text": "\n\n".join([node["title"], *node.pop("body")])})
        return len(made[-1]["text"]) + 500

    for batch in batches:
        if schema is None:
            kinds = {"doc": batch.schema.field("doc").type, "pos": pa.int64(), "parent": pa.int64(), "level": pa.int32(), "first_page": pa.int32(), "last_page": pa.int32()}
            schema = pa.schema([(f, kinds.get(f, batch.schema.field("text").type)) for f in FIELDS])
        for doc, pos, page, text, heading, in_box, depth, words in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if held > BATCH_CHARS:
                yield pa.RecordBatch.from_pylist(made, schema)
                made.clear()
                held = 0
            if current != [doc]:
                held += close(section) + close(chapter)
                section = chapter = None
                open_.clear()
                current = [doc]
            if heading and not (section is not None and section["box"] and not in_box):
                held += close(section)
                if depth == 1:
                    held += close(chapter)
                    open_.clear()
                    chapter, section = add("Chapter", 1, words.strip(), depth, in_box), None
                    continue
                level = max(2, depth + (chapter is not None)) if depth else 2
                if section is not None and open_ and open_[-1] is section and level <= section["level"]:
                    both = depth and section["depth"]
                    if not both or depth > section["depth"]:
                        level = section["level"] + 1
                section = add("Section", level, text, depth, in_box)
                continue
            if section is None:
                # A preamble stays open at level 2, below the chapter or the document.
                section = add("Section", 2, "Preamble", 0, False)
            section["body"].append(text)
            for node in (section, chapter):
                if node is not None and page is not None and node["last_page"] is not None:
                    node["last_page"] = max(node["last_page"], page)
    close(section)
    close(chapter)
    if made:
        yield pa.RecordBatch.from_pylist(made, schema)


@registry.add()
def doc_tree_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return section_tree(d.select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("pos", "text")))


_BLOCK_LINES = "(SELECT doc_id AS doc, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, unnest(string_split(text, chr(10))) AS text FROM documents)"


@registry.add(rf"""WITH b0 AS (SELECT doc, pos, CASE WHEN pos % 5 IN (1, 2) AND doc % 3 > 0 THEN pos || '.' || doc % 7 || '.' ELSE text END AS text FROM {_BLOCK_LINES}), b AS (SELECT *, regexp_full_match(trim(text), '\d+(\.\d+)*\.?\s*') AS alone FROM b0),
l AS (SELECT *, lag(CASE WHEN alone THEN rtrim(text, '.') END) OVER (PARTITION BY doc ORDER BY pos) AS number FROM b)
SELECT doc, count(*) AS blocks, count(number) AS merged, CAST(sum(length(text) + coalesce(length(number) + 1, 0)) AS BIGINT) AS chars FROM l WHERE NOT alone GROUP BY 1""")
def doc_merged_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    blocks = d.select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    number = F.concat("pos", F.lit("."), F.col("doc") % 7, F.lit("."))  # of two such lines in a row the last one counts
    blocks = blocks.withColumn("text", F.when((F.col("pos") % 5).isin(1, 2) & (F.col("doc") % 3 > 0), number).otherwise(F.col("text"))).withColumn("before", F.length("text"))
    merged = merged_numbers(blocks)
    return merged.groupBy("doc").agg(
        F.count("*").alias("blocks"), F.count_if(F.length("text") > F.col("before")).alias("merged"), F.sum(F.length("text")).cast("long").alias("chars")
    )


@registry.add(f"""SELECT doc, CAST(list_sort(list(font))[count(*) // 2 + 1] AS DOUBLE) + 1.5 AS threshold FROM (SELECT doc, 8 + length(text) % 7 AS font FROM {_BLOCK_LINES} WHERE text <> '') GROUP BY 1""")
def doc_font_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The upper median rule over lines whose length stands for a font size."""
    d = table(spark, sf_dir, "documents")
    lines = d.select(F.col("doc_id").alias("doc"), F.explode(F.split("text", "\n")).alias("text")).where("text <> ''")
    sized = lines.select("doc", F.lit("text").alias("kind"), (8 + F.length("text") % 7).cast("double").alias("font"))
    return heading_threshold(sized)


def page_parent(pages: DataFrame, sections: DataFrame, chapters: DataFrame | None = None) -> DataFrame:
    """``pages`` (doc, page) with section, the deepest one that spans each page (ties: the later one), and parent.

    ``sections`` and ``chapters`` have doc, id, first, last, depth and order. The parent is the section, else the
    last chapter that spans the page, else null: the document.
    """

    def spanning(rows: DataFrame, name: str) -> DataFrame:
        spanned = rows.select("doc", "id", "depth", "order", F.explode(F.sequence("first", F.greatest("first", "last"))).alias("page"))
        return spanned.groupBy("doc", "page").agg(F.max_by("id", F.struct("depth", "order")).alias(name))

    found = pages.join(spanning(sections, "section"), ["doc", "page"], "left")
    if chapters is None:
        return found.withColumn("parent", F.col("section"))
    last = spanning(chapters.withColumn("depth", F.lit(1)), "chapter")
    return found.join(last, ["doc", "page"], "left").withColumn("parent", F.coalesce("section", "chapter")).drop("chapter")


@registry.add(r"""SELECT page_id, regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1) AS heading, regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1) AS title,
CAST(len(regexp_extract_all(html, '<p[ >]')) AS BIGINT) AS paragraphs, CAST(len(regexp_extract_all(html, '<li[ >]')) AS BIGINT) AS items,
CAST(len(regexp_extract_all(html, '<a ')) AS BIGINT) AS links FROM pages""")
def html_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda p: F.regexp_count("html", F.lit(p)).cast("long")
    return table(spark, sf_dir, "pages").select(
        "page_id",
        F.regexp_extract("html", r"(?s)<h1[^>]*>(.*?)</h1>", 1).alias("heading"),
        F.regexp_extract("html", r"(?s)<title[^>]*>(.*?)</title>", 1).alias("title"),
        count("<p[ >]").alias("paragraphs"),
        count("<li[ >]").alias("items"),
        count("<a ").alias("links"),
    )


def enriched_boxes(sections: DataFrame, pages: DataFrame) -> DataFrame:
    """``sections`` (doc, title, text, first_page) in which a box with little but its label gets the lines below it on its page.

    ``pages`` has doc, page and text.
    """
    page = pages.select("doc", F.col("page").alias("first_page"), F.col("text").alias("_page"))
    number = F.regexp_extract("title", r"(\d+)", 1)
    body = X.box_body(F.split(F.coalesce("_page", F.lit("")), "\n"), number)
    bare = X.is_box_label(F.col("title")) & (F.length(F.trim("text")) <= F.length("title") + 80)
    text = F.when(bare & (body != ""), F.concat("title", F.lit("\n\n"), body)).otherwise(F.col("text"))
    return sections.join(page, ["doc", "first_page"], "left").withColumn("text", text).select(*sections.columns)


def sequential_edges(nodes: DataFrame) -> DataFrame:
    """source, target and rel_type between neighbours of ``nodes`` (doc, label, order, id): chapters, sections and pages each in their own order."""
    following = F.lead("id").over(Window.partitionBy("doc", "label").orderBy("order", "id"))
    pairs = nodes.select("id", following.alias("next")).where("next IS NOT NULL")
    ends = F.array(F.struct(F.col("id").alias("source"), F.col("next").alias("target"), F.lit("PRECEDES").alias("rel_type")), F.struct(F.col("next").alias("source"), F.col("id").alias("target"), F.lit("FOLLOWS").alias("rel_type")))
    return pairs.select(F.explode(ends).alias("e")).select("e.*")


@registry.add(f"""WITH n AS (SELECT doc, 'Page' AS label, page AS o, doc || '_page_' || page AS id FROM {{blocks}} GROUP BY doc, page UNION ALL SELECT doc, 'Section', pos, doc || '_section_' || pos FROM {{blocks}}),
s AS (SELECT id, lead(id) OVER (PARTITION BY doc, label ORDER BY o, id) AS next FROM n)
SELECT id AS source, next AS target, 'PRECEDES' AS rel_type FROM s WHERE next IS NOT NULL UNION ALL SELECT next, id, 'FOLLOWS' FROM s WHERE next IS NOT NULL""".replace("{blocks}", f"(SELECT doc, pos, text, pos // 4 + 1 AS page FROM {_BLOCK_LINES} WHERE text <> '')"))
def doc_sequential_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = paged_blocks(spark, sf_dir)
    pages = b.select("doc", "page").distinct().select("doc", F.lit("Page").alias("label"), F.col("page").alias("order"), F.concat_ws("_", "doc", F.lit("page"), "page").alias("id"))
    return sequential_edges(pages.union(b.select("doc", F.lit("Section"), "pos", F.concat_ws("_", "doc", F.lit("section"), "pos"))))


def region_order(regions: DataFrame) -> DataFrame:
    """Regions (page, pos, text) with their number on the page, duplicates by page and first 200 characters dropped; also by doc, if there is one."""
    keys = [c for c in ("doc", "page") if c in regions.columns]
    first = Window.partitionBy(*keys, F.substring("text", 1, 200)).orderBy("pos")
    place = Window.partitionBy(*keys).orderBy("pos")
    return regions.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r").withColumn("index", F.row_number().over(place))


#: Lines of a document that make a page, where a query takes documents as books.
PAGE_LINES = 4


def paged_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, page, pos and text of the documents' lines that aren't empty: each PAGE_LINES lines are a page."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return d.where("text <> ''").withColumn("page", F.floor(F.col("pos") / PAGE_LINES).cast("int") + 1)


_BLOCKS = f"(SELECT doc, pos, text, pos // {PAGE_LINES} + 1 AS page FROM {_BLOCK_LINES} WHERE text <> '')"


@registry.add(f"""WITH b AS {_BLOCKS}, s AS (SELECT doc, pos AS id, page AS first, coalesce(lead(page) OVER (PARTITION BY doc ORDER BY pos), page) AS last, pos % 3 AS depth FROM b WHERE pos % 5 = 0),
p AS (SELECT DISTINCT doc, page FROM b), x AS (SELECT s.*, unnest(range(first, last + 1)) AS page FROM s)
SELECT p.doc, p.page, arg_max(x.id, (x.depth, x.id)) AS section FROM p LEFT JOIN x ON x.doc = p.doc AND x.page = p.page GROUP BY 1, 2""")
def doc_page_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and the deepest of the sections over them; every fifth line opens a section that lasts up to the next one's page."""
    b = paged_blocks(spark, sf_dir).drop("text")
    following = F.coalesce(F.lead("page").over(Window.partitionBy("doc").orderBy("pos")), F.col("page"))
    s = b.where("pos % 5 = 0").select("doc", F.col("pos").alias("id"), F.col("page").alias("first"), following.alias("last"), (F.col("pos") % 3).alias("depth"), F.col("pos").alias("order"))
    return page_parent(b.select("doc", "page").distinct(), s).select("doc", "page", "section")


@registry.add(f"""WITH b AS {_BLOCKS}, r AS (SELECT *, row_number() OVER (PARTITION BY doc, page, substr(text, 1, 200) ORDER BY pos) AS r FROM b)
SELECT doc, page, pos, row_number() OVER (PARTITION BY doc, page ORDER BY pos) AS index FROM r WHERE r = 1""")
def doc_region_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return region_order(paged_blocks(spark, sf_dir)).select("doc", "page", "pos", F.col("index").cast("long").alias("index"))
