"""Text functions as Column expressions: titles, references, pages, tables of contents, hashes.

All work inside Spark's generated code or its array functions; none needs Python on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and bounds of the document model.
NUMBERED_TITLE = r"^(\d+(?:\.\d+)*\.?)\s+(.+)$"
STANDALONE_NUMBER = r"^\d+(\.\d+)*\.?\s*$"
REFERENCE = r"(?:see|refer(?:s)? to|as (?:discussed|described|shown) in|described in|mentioned in|in)\s+(?:Chapter|Section|Appendix|Figure|Table|Part)\s+[\w\d\.]+"
COMMON_HEADING = r"(?i)^(?:chapter|section|part|appendix|annex|box|table|figure)\b"
TABLE_OR_FIGURE = r"(?i)\b(?:table|figure|fig\.|box)\s+[a-z]?\d+(?:\.\d+)?\b|\[(?:table|figure)\]"
TABLE_WORD = r"(?i)\btable\b|\[table\]"
TABLE_REF, FIGURE_REF = r"\btable\s+([a-z]?\d+(?:\.\d+)?)\b", r"\bfigure\s+(\d+(?:\.\d+)?)\b"
BOX_LABEL = r"(?i)^\s*Box\s+\d+(?:\.\d+)?(?:\s+\(continued\))?\s*$"
BOX_START, BOX_LONGEST = r"(?i)^\s*Box\s+\d+", 40
FIGURE_CAPTION = r"(?i)(?:Fig\.?|Figure)\s*(\d+(?:\.\d+)?)\s*[:.]\s*([^\n]+)"
BROKEN_URL = r"(?i)https?://[^\s\)\]>\"']+(?:\s+[^\s\)\]>\"']+)+"
REPAIRED_URL = r"https?://[^\s\)\]>\"']+"
TOC_TITLE = r"(?i)^table\s+of\s+contents?\.?$|^contents$"
OUTLINE_SKIP, OUTLINE_NUMBERED = r"(?i)^(?:box\s+\d|figure\s*\d|table\s*\d|page\s+\d+)\b", r"^\d+(?:\.\d+)*\.?\s+\S"
THREAD_SUFFIX, USER_ID, THREAD_ID = "^[a-zA-Z0-9_-]{1,64}$", 64, 128
SPARSE_PAGE, SECTION_SNIPPET = 40, 2000
SPARSE_NOTE = "[Note: This PDF page had little extractable text; use visual_content if present or ask about the printed page number shown in the page title.]"
TOC_HEADING = r"(?im)(?:^|\n)\s*(?:table\s+of\s+contents?|contents)\s*(?:\n|$)"
TOC_LINE = r"(?:\.{2,}|…+|\s\.\s)\s*\d{1,4}\s*$|\s+\d{1,4}\s*$"
PAGE_NUMBER_LINE = r"(?i)^(?:\d{1,4}|[ivxlcdm]{1,6})$"
PAGE_LABELS = (
    r"(?i)(?:^|\s)(?:page|p\.?|pg\.?)\s*[:.]?\s*([a-zA-Z0-9ivxlcdm\-]+)\s*$",
    r"(?i)^\s*([ivxlcdm]+)\s*$",
    r"(?i)^\s*([a-z])\s*$",
    r"^\s*(\d{1,4})\s*$",
    r"[-|]\s*(\d{1,4})\s*[-|]\s*$",
)
ROMAN = "i ii iii iv v vi vii viii ix x xi xii xiii xiv xv xvi xvii xviii xix xx".split()
URL = r"https?://[^\s<>\")\]]+"
LONG_TEXT = 120
#: Control characters but tab, line feed and carriage return.
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]"


def slug(x: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "_"), F.lit("_"))


def number_depth(x: Column) -> Column:
    return F.size(F.split(F.rtrim(x, F.lit(".")), r"\."))


def title_number(x: Column) -> Column:
    """The number of a numbered title without its last dot; null without one."""
    return F.nullif(F.rtrim(F.regexp_extract(x, NUMBERED_TITLE, 1), F.lit(".")), F.lit(""))


def title_words(x: Column) -> Column:
    return F.nullif(F.regexp_extract(x, NUMBERED_TITLE, 2), F.lit(""))


def is_standalone_number(x: Column) -> Column:
    return x.rlike(STANDALONE_NUMBER)


def references(x: Column) -> Column:
    """Where the whole text refers to another part, with the words before it, such as ``see Section 2.1``."""
    return F.regexp_extract_all(x, F.lit("(?iU)" + REFERENCE), F.lit(0))


def normalized(x: Column) -> Column:
    """Blanks collapsed in each line, lines stripped, runs of empty lines made one."""
    return F.btrim(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "[ \t]+", " "), r"(?m)^ | $", ""), r"\n{3,}", "\n\n"), F.lit("\n "))


def solid_lines(x: Column) -> Column:
    """Stripped lines that aren't empty."""
    return F.filter(F.transform(F.split(x, "\n"), lambda s: F.btrim(s, F.lit(" \t\r\f\v"))), lambda s: s != "")


def uppercase_ratio(x: Column) -> Column:
    letters = F.length(F.regexp_replace(x, r"[^\p{L}]", ""))
    return F.when(letters > 0, F.length(F.regexp_replace(x, r"[^\p{Lu}]", "")) / letters).otherwise(F.lit(0.0))


def extraction_confidence(x: Column, blocks: Column, has_images: Column) -> Column:
    """0 to 1, from length, share of printable characters and number of blocks."""
    n = F.length(x)
    printable = F.when(n > 0, F.length(F.regexp_replace(x, CONTROL, "")) / n).otherwise(F.lit(0.0))
    raw = 0.55 * F.least(F.lit(1.0), n / (2 * LONG_TEXT)) + 0.25 * printable + 0.2 * F.least(F.lit(1.0), blocks / 6)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw - F.when(has_images & (n < LONG_TEXT), 0.2).otherwise(0.0)))


def is_low_confidence(x: Column, confidence: Column) -> Column:
    return (confidence < 0.35) | (F.length(x) < LONG_TEXT)


def is_heading(x: Column, font: Column | None = None, bold: Column | None = None, threshold: Column | None = None) -> Column:
    """A short line that is numbered, begins as headings do, is mostly capitals, or is set larger than ``threshold``.

    A long caption of a table or figure isn't one. Without fonts, only the words decide.
    """
    words = F.size(F.split(F.btrim(x, F.lit(" \t\n\r\f\u000b")), r"\s+"))
    capitals = (uppercase_ratio(x) > 0.72) & words.between(2, 10)
    found = (x.rlike(NUMBERED_TITLE) & (F.length(F.trim(title_words(x))) >= 2)) | (x.rlike(COMMON_HEADING) & (words <= 12)) | capitals
    if font is not None:
        large = F.coalesce(font >= threshold, F.lit(False))
        larger = F.coalesce(font >= threshold + 1, F.lit(False))
        found = found | (bold & large & (F.length(x) <= 120)) | (larger & (words <= 12))
    # Most lines are longer, so the patterns come behind a condition.
    return F.when(F.length(x).between(3, 160), F.coalesce((words <= 18) & ~(x.rlike(TABLE_OR_FIGURE) & (F.length(x) > 80)) & found, F.lit(False))).otherwise(F.lit(False))


def is_box_label(x: Column) -> Column:
    return x.rlike(BOX_LABEL) | (x.rlike(BOX_START) & (F.length(x) <= BOX_LONGEST))


def toc_score(x: Column) -> Column:
    """How much a page looks like a table of contents, 0 to 1."""
    body = F.btrim(x, F.lit(" \t\r\n"))
    lines = solid_lines(body)
    n = F.size(lines)
    heading = F.when(F.substring(body, 1, 600).rlike(TOC_HEADING), 0.45).otherwise(0.0)
    same = F.size(F.filter(lines, lambda s: s.rlike(TOC_LINE)))
    pairs = F.size(F.filter(F.arrays_zip(F.slice(lines, 1, n - 1).alias("a"), F.slice(lines, 2, n - 1).alias("b")), lambda p: p["b"].rlike(PAGE_NUMBER_LINE) & p["a"].rlike("[A-Za-z]")))
    listed = F.least(F.lit(0.55), 1.1 * (same + pairs) / n)
    short = F.when((n <= 120) & (F.length(body) < 14000), 0.05).otherwise(0.0)
    return F.when(F.length(body) < 40, 0.0).when(n < 3, heading).otherwise(F.least(F.lit(1.0), heading + listed + short))


def page_label(x: Column) -> Column:
    """The printed page number: the first label found in the last four and the first two lines."""
    lines = solid_lines(x)
    n = F.size(lines)
    candidates = F.array_distinct(F.concat(F.slice(lines, F.greatest(F.lit(1), n - 3), F.lit(4)), F.slice(lines, F.lit(1), F.lit(2))))

    def label(s: Column) -> Column:
        found = [F.regexp_extract(s, p, 1) for p in PAGE_LABELS]
        return F.coalesce(*[F.when((f != "") & (F.length(f) <= 12), f) for f in found])

    return F.when(n > 0, F.get(F.filter(F.transform(candidates, label), lambda s: s.isNotNull()), F.lit(0)))


def page_tags(page: Column, label: Column) -> Column:
    """Tags of a page by its place in the file and its printed label."""
    p, low = page.cast("string"), F.lower(label)
    roman = F.nullif(F.array_position(F.array(*map(F.lit, ROMAN)), low), F.lit(0)).cast("string")
    digits = label.rlike("^[0-9]+$")
    tags = F.array(
        F.concat(F.lit("pdf:"), p),
        F.concat(F.lit("pdf-page:"), p),
        F.concat(F.lit("doc:"), label),
        F.concat(F.lit("document-page:"), label),
        F.when(digits, F.concat(F.lit("doc-num:"), label)),
        F.when(roman.isNotNull(), F.concat(F.lit("doc-roman:"), low)),
        F.concat(F.lit("doc-num:"), roman),
        F.when(label.isNotNull(), F.when(digits & (label.cast("string") == p), F.lit("pdf-doc-same")).otherwise(F.lit("pdf-doc-differ"))),
    )
    return F.array_distinct(F.filter(tags, lambda t: t.isNotNull()))


def region_tags(kind: Column, text: Column, page: Column, index: Column, label: Column | None = None) -> Column:
    """Tags of a table or figure: its kind, page, place on it and printed page, then the tables and figures its text names; else itself."""
    p, i, low = page.cast("string"), index.cast("string"), F.lower(F.coalesce(text, F.lit("")))
    named = lambda pattern, name: F.transform(F.regexp_extract_all(low, F.lit(pattern), F.lit(1)), lambda x: F.concat(F.lit(name + ":"), x))
    tables = named(TABLE_REF, "table")
    printed = F.concat(F.lit("doc:"), F.trim(label)) if label is not None else F.lit(None).cast("string")
    own = lambda name: F.array(F.lit(name), F.concat(F.lit(name + ":"), i))
    none = F.array().cast("array<string>")
    tags = F.concat(
        F.array(F.concat(F.lit("kind:"), kind), F.concat(F.lit("pdf:"), p), F.concat(F.lit("region:"), p, F.lit(":"), i), printed),
        tables,
        named(FIGURE_REF, "figure"),
        F.when((kind == "table") & (F.size(tables) == 0), own("table")).otherwise(none),
        F.when(kind == "figure", own("figure")).otherwise(none),
    )
    return F.array_distinct(F.filter(tags, lambda t: t.isNotNull()))


def region_kind(text: Column) -> Column:
    """table or figure for a text that names one, else null."""
    return F.when(text.rlike(TABLE_OR_FIGURE), F.when(text.rlike(TABLE_WORD), "table").otherwise("figure"))


def region_title(kind: Column, text: Column, page: Column, index: Column) -> Column:
    """The first line, 120 characters of it, or what and where it is."""
    first = F.substring(F.substring_index(F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\r\n")), "\n", 1), 1, 120)
    what = F.when(kind == "table", "Table").otherwise("Figure")
    return F.coalesce(F.nullif(first, F.lit("")), F.concat(what, F.lit(" "), index.cast("string"), F.lit(" (PDF page "), page.cast("string"), F.lit(")")))


def box_body(lines: Column, number: Column) -> Column:
    """The lines after ``Box N`` and before the next box, joined; empty without that box. ``lines`` is an array."""
    start = F.array_position(F.transform(lines, lambda x: F.regexp_extract(x, r"(?i)^\s*Box\s+(\d+)", 1)), number.cast("string")).cast("int")

    def cut(rest: Column) -> Column:
        stop = F.array_position(F.transform(rest, lambda x: x.rlike(BOX_START)), True).cast("int")
        body = F.when(stop > 0, F.slice(rest, F.lit(1), stop - 1)).otherwise(rest)
        return F.btrim(F.array_join(body, "\n"), F.lit(" \t\r\n"))

    after = F.slice(lines, start + 1, F.greatest(F.lit(0), F.size(lines) - start))
    return F.when(start > 0, F.element_at(F.transform(F.array(after), cut), 1)).otherwise("")


def figure_captions(x: Column) -> Column:
    """Map from figure number, as printed and without leading zeros, to its caption; the last caption of a number wins."""
    numbers, titles = (F.regexp_extract_all(x, F.lit(FIGURE_CAPTION), F.lit(k)) for k in (1, 2))
    pairs = F.zip_with(numbers, titles, lambda n, t: F.struct(n.alias("n"), F.trim(t).alias("t")))
    plain = F.transform(pairs, lambda p: F.struct(F.coalesce(F.nullif(F.ltrim(p["n"], F.lit("0")), F.lit("")), p["n"]).alias("n"), p["t"].alias("t")))

    def last(all_: Column) -> Column:
        keys = F.array_distinct(F.transform(all_, lambda p: p["n"]))
        return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(all_, lambda p: p["n"] == k), -1)["t"]))

    return F.element_at(F.transform(F.array(F.concat(pairs, plain)), last), 1)


def is_toc_title(x: Column) -> Column:
    return F.coalesce(F.trim(x).rlike(TOC_TITLE), F.lit(False))


def in_outline(title: Column, depth: Column, label: Column) -> Column:
    """Whether a heading belongs to an outline made of headings: chapters, top levels, numbered and capital ones, no boxes or captions."""
    t = F.trim(F.coalesce(title, F.lit("")))
    capitals = (F.upper(t) == t) & t.rlike(r"\p{L}") & (F.length(t) < 100)
    fits = (F.length(t) >= 2) & ~F.lower(t).isin("contents", "content") & ~t.rlike(OUTLINE_SKIP)
    return fits & ((label == "Chapter") | (F.coalesce(depth, F.lit(0)) <= 1) | t.rlike(OUTLINE_NUMBERED) | capitals)


def filled_page(page: Column, title: Column, body: Column) -> Column:
    """The page's text, or for a sparse one the start of the section that spans it and what there is; ``title`` is null without a section."""
    own = F.trim(F.coalesce(page, F.lit("")))
    text = F.trim(F.coalesce(body, F.lit("")))
    snippet = F.concat(F.substring(text, 1, SECTION_SNIPPET), F.when(F.length(text) > SECTION_SNIPPET, "\n…").otherwise(""))
    parts = F.concat_ws(
        "\n\n",
        F.when(title.isNotNull(), F.concat(F.lit("[Section context — "), title, F.lit("]"))).otherwise("[No section mapped to this PDF page.]"),
        F.when(title.isNotNull(), F.when(text != "", snippet).otherwise("(Section has no body text in graph.)")),
        F.when(own != "", F.concat(F.lit("[Sparse page extract]\n"), own)),
        F.lit(SPARSE_NOTE),
    )
    return F.when(F.length(own) >= SPARSE_PAGE, page).otherwise(parts)


def table_markdown(rows: Column) -> Column:
    """A table (array of arrays of cells) as Markdown: the first row heads it, short rows are filled, null cells are empty."""
    width = F.array_max(F.transform(rows, F.size))
    cell = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    full = lambda r: F.concat(F.transform(r, cell), F.array_repeat(F.lit(""), width - F.size(r)))
    line = lambda r: F.concat(F.lit("| "), F.array_join(full(r), " | "), F.lit(" |"))
    lines = F.transform(rows, line)
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    table = F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, F.lit(2), F.greatest(F.lit(0), F.size(lines) - 1)))
    return F.when(F.size(rows) > 0, F.concat(F.lit("[Table]\n"), F.array_join(table, "\n"))).otherwise("")


def clean_title(x: Column) -> Column:
    """A title without the 32 hexadecimal digits that uploads put first."""
    return F.regexp_replace(x, "^[0-9a-fA-F]{32}[_-]?", "")


def question_hash(x: Column) -> Column:
    return F.substring(F.sha2(F.regexp_replace(F.lower(F.trim(F.coalesce(x, F.lit("")))), r"\s+", " ").cast("binary"), 256), 1, 16)


def pattern_hash(x: Column) -> Column:
    return F.substring(F.sha2(F.coalesce(F.nullif(x, F.lit("")), F.lit("general")).cast("binary"), 256), 1, 16)


def urls(x: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(x, F.lit(URL), F.lit(0)))


def percentages(x: Column) -> Column:
    return F.transform(F.regexp_extract_all(x, F.lit(r"(\d+(?:\.\d+)?)\s*%"), F.lit(1)), lambda s: s.cast("double"))


def repaired_urls(x: Column) -> Column:
    """The text with the blanks inside addresses taken out: an address goes on as long as no bracket or quote ends it."""
    pieces = F.regexp_extract_all(x, F.lit(BROKEN_URL), F.lit(0))
    return F.aggregate(pieces, x, lambda text, p: F.replace(text, p, F.regexp_replace(p, r"\s+", "")))


def text_urls(x: Column) -> Column:
    """The addresses of a text whose broken ones are repaired, in order, once each."""
    return F.array_distinct(F.regexp_extract_all(repaired_urls(F.coalesce(x, F.lit(""))), F.lit(REPAIRED_URL), F.lit(0)))


def with_urls(x: Column) -> Column:
    """The text without blanks at its ends, and below it a list of the addresses in it."""
    body, found = F.btrim(F.coalesce(x, F.lit("")), F.lit(" \t\r\n")), text_urls(x)
    listed = F.array_join(F.transform(found, lambda u: F.concat(F.lit("- "), u)), "\n")
    return F.when(F.size(found) > 0, F.concat(body, F.lit("\n\n[Extracted URLs]\n"), listed)).otherwise(body)


def user_key(x: Column) -> Column:
    """A user's name made safe, ``anonymous`` if there is none."""
    plain = F.regexp_replace(F.trim(F.coalesce(F.nullif(x, F.lit("")), F.lit("anonymous"))), "[^a-zA-Z0-9_@.-]", "_")
    return F.coalesce(F.nullif(F.substring(plain, 1, USER_ID), F.lit("")), F.lit("anonymous"))


def thread_key(user: Column, thread: Column) -> Column:
    """The thread under its user: of what the client sends only the part after the first colon counts, and ``default`` replaces any that isn't plain."""
    raw = F.trim(F.coalesce(F.nullif(thread, F.lit("")), F.lit("default")))
    tail = F.when(raw.contains(":"), F.substring(raw, F.instr(raw, ":") + 1, F.length(raw))).otherwise(raw)
    suffix = F.substring(F.trim(tail), 1, 64)
    return F.substring(F.concat(user_key(user), F.lit(":"), F.when(suffix.rlike(THREAD_SUFFIX), suffix).otherwise("default")), 1, THREAD_ID)


def safe_id(x: Column, most: int = 64) -> Column:
    """An identifier of letters, digits and ``_.@-`` alone, cut to ``most``; ``default`` if nothing stays."""
    return F.coalesce(F.nullif(F.substring(F.regexp_replace(F.trim(x), r"[^A-Za-z0-9_.@-]", "_"), 1, most), F.lit("")), F.lit("default"))
