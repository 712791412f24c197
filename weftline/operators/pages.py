"""Pages: their labels and filled texts, fetching by number, pictures and captions, tables of contents.

Requests are rows, so many questions are answered by the same joins: ``requests`` has request, doc, pdf_page and
label (either may be null), ``pages`` has doc, page, label and text, and may have visual.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.registry import Registry
from ..sources.tables import table
from .structure import _BLOCKS, paged_blocks

registry = Registry()

# What a table of contents takes, lengths of excerpts, and the words that hint at pictures.
TOC_PAGES, TOC_LEAST, TOC_SECTION = 40, 0.42, 30
SECTION_EXCERPT, REGION_EXCERPT, PAGE_EXCERPT, VISION_TEXT = 2500, 1500, 1200, 120
VISUAL_HINTS = r"(?i)\btable\b|\bfigure\b|\bfig\.\b|\bannex\b|\[table\]|\[figure\]|chart|diagram|graph\b|flowchart|flow\s+chart|map\b|illustration|screenshot|infographic|box\s+\d+|appendix"
VISUAL_TITLES = r"(?:Tables|Charts and graphs|Diagrams and flowcharts|Shapes, maps, and other figures|Other visible content)"
NEGATIVE_LINE = r"(?i)^\s*-\s*(no\s+.+?\s+(visible|present|on\s+the\s+page|on\s+this\s+page)|none\s*(visible|present|found)?\.?|nothing\s+(visible|present|on\s+the\s+page)\.?|n/?a\.?)\s*\.?\s*$"


def page_nodes(pages: DataFrame, parents: DataFrame) -> DataFrame:
    """``pages`` (doc, page, text) with label, tags, title and text: a sparse page is filled from the section over it.

    ``parents`` has doc, page, section_title and section_text, at most one row a page.
    """
    found = pages.join(parents, ["doc", "page"], "left").withColumn("label", X.page_label(F.col("text")))
    same = F.coalesce(F.col("label").rlike("^[0-9]+$") & (F.col("label").try_cast("long") == F.col("page")), F.lit(False))
    differs = F.concat(F.lit("Page "), "label", F.lit(" (PDF "), "page", F.lit(")"))
    title = F.when(F.col("label").isNotNull() & ~same, differs).otherwise(F.concat(F.lit("Page "), "page"))
    return found.select(
        "doc",
        "page",
        "label",
        title.alias("title"),
        F.array_join(X.page_tags(F.col("page"), F.col("label")), ",").alias("tags"),
        X.filled_page(F.col("text"), F.col("section_title"), F.col("section_text")).alias("text"),
    )


def requested_pages(requests: DataFrame, pages: DataFrame, label_first: bool = False) -> DataFrame:
    """The page of each request: one at its place in the file or with its printed label, case aside, in order of preference, then the earliest."""
    r = requests.select("request", "doc", "pdf_page", F.lower("label").alias("wanted"))
    by_place = pages.join(r.where("pdf_page IS NOT NULL").withColumnRenamed("pdf_page", "page"), ["doc", "page"]).withColumn("by", F.lit("place"))
    by_label = pages.join(r.where("wanted IS NOT NULL"), (pages["doc"] == r["doc"]) & (F.lower(pages["label"]) == F.col("wanted"))).drop(r["doc"]).withColumn("by", F.lit("label"))
    both = by_place.select(*pages.columns, "request", "by").unionByName(by_label.select(*pages.columns, "request", "by"))
    first = F.when(F.col("by") == ("label" if label_first else "place"), 0).otherwise(1)
    rank = F.row_number().over(Window.partitionBy("request").orderBy(first, "page"))
    return both.withColumn("_r", rank).where("_r = 1").drop("_r", "by")


def _listed(rows: DataFrame, keys: list[str], order: str, item: Column, name: str) -> DataFrame:
    """One row for each key with the items joined in order."""
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), item.alias("i"))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(items, lambda x: x["i"]), "\n").alias(name))


def page_passages(requests: DataFrame, pages: DataFrame, sections: DataFrame, regions: DataFrame) -> DataFrame:
    """request, doc, page, title and text of each requested page: its text, then the sections and regions on it.

    ``sections`` has doc, page, pos, title and text, ``regions`` doc, page, pos, title and text.
    """
    body = F.trim(F.coalesce("text", F.lit("")))
    s = sections.where((F.trim("title") != "") & (body != ""))
    s = _listed(s, ["doc", "page"], "pos", F.concat(F.lit("\n## Related section: "), "title", F.lit("\n"), F.substring(body, 1, SECTION_EXCERPT)), "sections")
    g = regions.where(F.coalesce("text", F.lit("")) != "")
    g = _listed(g, ["doc", "page"], "pos", F.concat(F.lit("\n## Region: "), F.coalesce(F.nullif("title", F.lit("")), F.lit("Region")), F.lit("\n"), F.substring("text", 1, REGION_EXCERPT)), "regions")
    found = requested_pages(requests, pages).join(s, ["doc", "page"], "left").join(g, ["doc", "page"], "left")
    visual = F.nullif(F.trim("visual"), F.lit("")) if "visual" in pages.columns else F.lit(None).cast("string")
    head = F.concat(F.lit("Document: "), "doc", F.lit("\nPage: "), "title", F.lit(" (PDF page "), "page", F.lit(", printed label "), F.coalesce("label", F.lit("n/a")), F.lit(")\n\n## Page text"))
    text = F.concat_ws("\n", head, body, F.concat(F.lit("\n## Visual content (tables/figures)\n"), visual), "sections", "regions")
    return found.select("request", "doc", "page", "title", F.trim(text).alias("text"))


def compact_visual(x: Column) -> Column:
    """A description of pictures without the sections that only say that something is absent."""
    blocks = F.split(F.trim(F.coalesce(x, F.lit(""))), rf"(?m)^(?=##|{VISUAL_TITLES}\s*$)")
    is_head = lambda line: line.rlike(rf"^##|^{VISUAL_TITLES}\s*$")

    def kept(block: Column) -> Column:
        lines = F.filter(F.split(block, "\n"), lambda line: (F.trim(line) != "") & ~line.rlike(NEGATIVE_LINE))
        return F.when(F.exists(lines, lambda line: ~is_head(line)), F.array_join(lines, "\n")).otherwise("")

    return F.array_join(F.filter(F.transform(blocks, kept), lambda b: b != ""), "\n\n")


def page_visuals(requests: DataFrame, pages: DataFrame, regions: DataFrame) -> DataFrame:
    """request, doc, page, place, title, text and score of the pictures on each requested page; the page's own description stands in for none.

    ``requests`` may have figure, the number asked for; ``regions`` has doc, page, pos, title and visual. A picture's title
    is the caption of the figure asked for, else of the last one on the page, else its own.
    """
    wanted = requests.select("request", F.col("figure") if "figure" in requests.columns else F.lit(None).cast("string").alias("figure"))
    found = requested_pages(requests, pages, label_first=True).join(wanted, "request").withColumn("captions", X.figure_captions(F.coalesce("text", F.lit(""))))
    seen = regions.withColumn("visual", compact_visual(F.col("visual"))).where("visual <> ''").select("doc", "page", "pos", F.col("title").alias("region_title"), F.col("visual").alias("region_visual"))
    rows = found.withColumn("visual", compact_visual(F.col("visual"))).join(seen, ["doc", "page"], "left").withColumn("shown", F.coalesce("region_visual", F.nullif("visual", F.lit("")))).where("shown IS NOT NULL")
    numbers = F.array_sort(F.transform(F.map_keys("captions"), lambda k: F.struct(F.coalesce(k.try_cast("double"), F.lit(0.0)).alias("n"), k.alias("k"))))
    asked = F.when(F.array_contains(F.map_keys("captions"), F.col("figure")), F.col("figure"))
    number = F.coalesce(asked, F.when(F.size("captions") > 0, F.get(numbers, F.when(F.col("figure").isNotNull(), F.lit(0)).otherwise(F.size(numbers) - 1))["k"]))
    title = F.coalesce(F.concat(F.lit("Fig. "), number, F.lit(": "), F.try_element_at("captions", number)), F.nullif("region_title", F.lit("")), F.concat(F.lit("Figure on PDF page "), "page"))
    place = F.row_number().over(Window.partitionBy("request").orderBy("pos")) - 1
    text = F.concat_ws("\n", F.concat(F.lit("PDF page "), "page"), F.concat(F.lit("\n## "), "display"), F.concat(F.lit("\n[Visual description]\n"), "shown"), F.concat(F.lit("\n## Surrounding page text\n"), F.nullif(F.substring(F.trim("text"), 1, PAGE_EXCERPT), F.lit(""))))
    out = rows.withColumn("place", place).withColumn("display", title).where("figure IS NULL OR place = 0")
    return out.select("request", "doc", "page", "place", F.col("display").alias("title"), text.alias("text"), (1 - F.col("place") * 0.01).alias("score"))


def vision_pages(pages: DataFrame, sections: DataFrame, regions: DataFrame, least_text: int = VISION_TEXT) -> DataFrame:
    """doc and page of the pages worth a look at their picture: under a section or region that hints at one, with little text, or with a hint in it.

    ``sections`` has doc, first, last, title and text, ``regions`` doc and page.
    """
    hinted = sections.where(F.concat_ws("\n", "title", "text").rlike(VISUAL_HINTS))
    spanned = hinted.select("doc", F.explode(F.sequence("first", F.greatest("first", "last"))).alias("page")).union(regions.select("doc", "page")).distinct()
    met = pages.join(spanned.withColumn("under", F.lit(True)), ["doc", "page"], "left")
    text = F.trim(F.coalesce("text", F.lit("")))
    return met.where(F.coalesce("under", F.lit(False)) | (F.length(text) < least_text) | text.rlike(VISUAL_HINTS)).select("doc", "page")


def visual_score(phrases: Column, terms: Column, visual: Column, text: Column, title: Column, tags: Column, exact: Column, wants_image: Column, same_kind: Column) -> Column:
    """How well a page or region answers a question on pictures: its page, then phrases and terms, more for what the picture shows than for print.

    ``exact`` is 1000 for the page in the file, 800 for the printed one, else 0.
    """
    v, t, g = (F.lower(F.coalesce(c, F.lit(""))) for c in (compact_visual(visual), text, tags))
    whole = F.concat_ws(" ", v, t, F.lower(F.coalesce(title, F.lit(""))), g)
    add = lambda items, points: F.aggregate(items, F.lit(0.0), lambda total, x: total + points(x))
    phrase = lambda p: F.when(p == "", 0.0).when(F.contains(v, p), 60.0 + F.least(F.length(p), F.lit(80)) * 0.5).when(F.contains(t, p), 25.0).when(F.contains(whole, p), 12.0).otherwise(0.0)
    term = lambda w: F.when(F.contains(v, w), 10.0).when(F.contains(t, w), 4.0).when(F.contains(g, w), 6.0).otherwise(0.0)
    shown = F.when(wants_image & (F.trim(F.coalesce(visual, F.lit(""))) != ""), 40.0).otherwise(0.0)
    return exact + add(phrases, phrase) + add(terms, term) + shown + F.when(F.coalesce(same_kind, F.lit(False)), 15.0).otherwise(0.0)


def toc_pages(pages: DataFrame, most: int = TOC_PAGES, least: float = TOC_LEAST) -> DataFrame:
    """doc, page, score and text of the page of each document most like a table of contents, of its first ``most`` with text; none scores ``least`` or less."""
    some = pages.where(F.trim(F.coalesce("text", F.lit(""))) != "")
    early = some.withColumn("_n", F.row_number().over(Window.partitionBy("doc").orderBy("page"))).where(F.col("_n") <= most)
    scored = early.withColumn("score", F.round(X.toc_score(F.col("text")), 6)).where(F.col("score") > least)
    best = F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("score"), "page"))
    return scored.withColumn("_n", best).where("_n = 1").select("doc", "page", "score", "text")


def outline(headings: DataFrame) -> DataFrame:
    """doc and text: the headings (doc, order, title, depth, label) that belong to an outline, once each, numbered in order."""
    some = headings.where(X.in_outline(F.col("title"), F.col("depth"), F.col("label"))).withColumn("title", F.trim("title"))
    first = some.groupBy("doc", F.lower("title").alias("k")).agg(F.min(F.struct("order", "title")).alias("h"))
    listed = first.groupBy("doc").agg(F.array_sort(F.collect_list("h")).alias("h"))
    return listed.select("doc", F.array_join(F.transform("h", lambda h, i: F.concat((i + 1).cast("string"), F.lit(". "), h["title"])), "\n").alias("text"))


def toc(docs: DataFrame, pages: DataFrame, headings: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """doc, via and text: each document's table of contents from the page asked for, else its best page, else its section of that name, else an outline."""
    ways = []
    if requests is not None:
        asked = requested_pages(requests, pages).where(F.trim("text") != "")
        ways.append(asked.groupBy("doc").agg(F.min_by("text", "request").alias("text")).select("doc", F.lit("requested_page").alias("via"), F.trim("text").alias("text")))
    ways.append(toc_pages(pages).select("doc", F.lit("toc_page").alias("via"), F.trim("text").alias("text")))
    if "text" in headings.columns:
        named = headings.where(X.is_toc_title(F.col("title")) & (F.length(F.trim("text")) >= TOC_SECTION))
        ways.append(named.groupBy("doc").agg(F.min_by("text", "order").alias("text")).select("doc", F.lit("contents_section").alias("via"), F.trim("text").alias("text")))
    ways.append(outline(headings).select("doc", F.lit("outline").alias("via"), "text"))
    every = None
    for rank, way in enumerate(ways):
        way = way.withColumn("rank", F.lit(rank))
        every = way if every is None else every.unionByName(way)
    best = every.groupBy("doc").agg(F.min(F.struct("rank", "via", "text")).alias("b"))
    return docs.select("doc").distinct().join(best, "doc").select("doc", "b.via", "b.text")


def book_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as books: doc, page and text."""
    return _listed(paged_blocks(spark, sf_dir), ["doc", "page"], "pos", F.col("text"), "text")


_PAGES = f"(SELECT doc, page, string_agg(text, chr(10) ORDER BY pos) AS text FROM {_BLOCKS} GROUP BY 1, 2)"
#: Every fifth line opens a section, which is on its own page.
_HEADS = f"(SELECT doc, page, pos, 'S' || pos AS title, text FROM {_BLOCKS} WHERE pos % 5 = 0)"


def _heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paged_blocks(spark, sf_dir).where("pos % 5 = 0").withColumn("title", F.concat(F.lit("S"), "pos"))


@registry.add(f"""SELECT p.doc AS request, p.doc, p.page, 'Page ' || p.page AS title, trim('Document: ' || p.doc || chr(10) || 'Page: Page ' || p.page || ' (PDF page ' || p.page || ', printed label n/a)' || chr(10) || chr(10) || '## Page text' || chr(10) || trim(p.text)
|| coalesce(chr(10) || (SELECT string_agg(chr(10) || '## Related section: ' || h.title || chr(10) || substr(trim(h.text), 1, 2500), chr(10) ORDER BY h.pos) FROM {_HEADS} h WHERE h.doc = p.doc AND h.page = p.page), '')) AS text
FROM {_PAGES} p WHERE p.page = p.doc % 3 + 1""")
def ret_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page of each document, asked for by its place in the file."""
    pages = book_pages(spark, sf_dir).withColumn("label", F.lit(None).cast("string")).withColumn("title", F.concat(F.lit("Page "), "page"))
    asked = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("request"), F.col("doc_id").alias("doc"), (F.col("doc_id") % 3 + 1).cast("int").alias("pdf_page"), F.lit(None).cast("string").alias("label"))
    heads = _heads(spark, sf_dir)
    return page_passages(asked, pages, heads, heads.where(F.lit(False)))


@registry.add(rf"""WITH p AS {_PAGES}, l AS (SELECT doc, page, CASE WHEN page > 1 AND page % 2 = 0 THEN CAST(page - 1 AS VARCHAR) END AS label FROM p),
r AS (SELECT doc_id AS request, doc_id AS doc, CASE WHEN doc_id % 2 = 0 THEN 2 END AS pdf_page, '1' AS label FROM documents),
m AS (SELECT request, l.doc, l.page, CASE WHEN l.label = r.label THEN 0 ELSE 1 END AS k FROM r JOIN l ON l.doc = r.doc AND (l.page = r.pdf_page OR l.label = r.label))
SELECT request, doc, page FROM m QUALIFY row_number() OVER (PARTITION BY request ORDER BY k, page) = 1""")
def ret_page_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page of requests by place or printed label, the label first; every even page is printed with the number before."""
    pages = book_pages(spark, sf_dir).withColumn("label", F.when((F.col("page") > 1) & (F.col("page") % 2 == 0), (F.col("page") - 1).cast("string"))).select("doc", "page", "label")
    d = F.col("doc_id")
    asked = table(spark, sf_dir, "documents").select(d.alias("request"), d.alias("doc"), F.when(d % 2 == 0, 2).alias("pdf_page"), F.lit("1").alias("label"))
    return requested_pages(asked, pages, label_first=True).select("request", "doc", "page")


@registry.add(rf"""WITH p AS {_PAGES}, h AS (SELECT doc, page, arg_max(title, pos) AS t, arg_max(text, pos) AS x FROM {_HEADS} GROUP BY 1, 2)
SELECT p.doc, p.page, CASE WHEN length(trim(p.text)) >= 40 THEN p.text ELSE concat_ws(chr(10) || chr(10), CASE WHEN t IS NOT NULL THEN '[Section context — ' || t || ']' ELSE '[No section mapped to this PDF page.]' END,
CASE WHEN t IS NOT NULL THEN CASE WHEN trim(x) <> '' THEN substr(trim(x), 1, 2000) || CASE WHEN length(trim(x)) > 2000 THEN chr(10) || '…' ELSE '' END ELSE '(Section has no body text in graph.)' END END,
CASE WHEN trim(p.text) <> '' THEN '[Sparse page extract]' || chr(10) || trim(p.text) END, '{X.SPARSE_NOTE}') END AS text FROM p LEFT JOIN h ON h.doc = p.doc AND h.page = p.page""")
def doc_page_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = _heads(spark, sf_dir).groupBy("doc", "page").agg(F.max_by("title", "pos").alias("section_title"), F.max_by("text", "pos").alias("section_text"))
    return page_nodes(book_pages(spark, sf_dir), heads).select("doc", "page", "text")


_LINES = r"list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(s, chr(32) || chr(9) || chr(13) || chr(12) || chr(11))), lambda s: s <> '')"
_TOC = rf"""(SELECT doc, page, text, round(CASE WHEN c < 40 THEN 0 WHEN n < 3 THEN 0 ELSE least(1.0, least(0.55, 1.1 * (t + e) / n) + CASE WHEN n <= 120 AND c < 14000 THEN 0.05 ELSE 0 END) END, 6) AS score FROM (
SELECT doc, page, text, length(trim(text)) AS c, len(ls) AS n, len(list_filter(ls, lambda x: regexp_matches(x, '(?:\.{{2,}}|…+|\s\.\s)\s*\d{{1,4}}\s*$|\s+\d{{1,4}}\s*$'))) AS t,
len(list_filter(range(1, len(ls)), lambda i: regexp_matches(ls[i + 1], '(?i)^(?:\d{{1,4}}|[ivxlcdm]{{1,6}})$') AND regexp_matches(ls[i], '[A-Za-z]'))) AS e FROM (SELECT *, {_LINES} AS ls FROM p)))"""


@registry.add(rf"""WITH p AS (SELECT doc, page, CASE WHEN doc % 4 = 0 THEN replace(text, chr(10), ' .... ' || page || chr(10)) ELSE text END AS text FROM {_PAGES}), s AS {_TOC},
b AS (SELECT doc, arg_max(trim(text), (score, -page)) AS text FROM s WHERE page <= 40 AND score > 0.42 GROUP BY 1),
o AS (SELECT doc, string_agg(i || '. ' || title, chr(10) ORDER BY pos) AS text FROM (SELECT doc, pos, 'S' || pos AS title, row_number() OVER (PARTITION BY doc ORDER BY pos) AS i FROM {_HEADS}) GROUP BY 1)
SELECT d.doc_id AS doc, CASE WHEN b.text IS NOT NULL THEN 'toc_page' ELSE 'outline' END AS via, coalesce(b.text, o.text) AS text FROM documents d LEFT JOIN b ON b.doc = doc_id LEFT JOIN o ON o.doc = doc_id WHERE coalesce(b.text, o.text) IS NOT NULL""")
def ret_toc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's table of contents; every fourth document's lines end in page numbers."""
    pages = book_pages(spark, sf_dir)
    dotted = F.replace("text", F.lit("\n"), F.concat(F.lit(" .... "), F.col("page").cast("string"), F.lit("\n")))
    pages = pages.withColumn("text", F.when(F.col("doc") % 4 == 0, dotted).otherwise(F.col("text")))
    heads = _heads(spark, sf_dir).select("doc", F.col("pos").alias("order"), "title", F.lit(1).alias("depth"), F.lit("Section").alias("label"))
    return toc(pages, pages, heads)


@registry.add(rf"""WITH p AS {_PAGES}, x AS (SELECT doc, unnest([page, page + 1]) AS page FROM {_HEADS} WHERE regexp_matches(title || chr(10) || text, '{VISUAL_HINTS}'))
SELECT doc, page FROM p WHERE length(trim(text)) < 120 OR regexp_matches(trim(text), '{VISUAL_HINTS}') OR (doc, page) IN (SELECT doc, page FROM x)""")
def doc_vision_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = _heads(spark, sf_dir).select("doc", F.col("page").alias("first"), (F.col("page") + 1).alias("last"), "title", "text")
    pages = book_pages(spark, sf_dir)
    return vision_pages(pages, heads, pages.select("doc", "page").where(F.lit(False)))
