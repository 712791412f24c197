"""Turns of a conversation: what a short reply means after the turn before it, choices of a clarification, and token usage.

All rules are column expressions over turns and the turn before, which a window brings along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.registry import Registry
from ..sources.tables import table

registry = Registry()

# The words of an ambiguous measure and of those that settle it, and the options that are offered.
MEASURE_SETTLED = ("freight", "shipping", "ship cost", "order total", "total", "unitprice", "unit price", "line item")
MEASURES = (
    ("order_total", "Order total (recommended)", ("total", "order total", "line item total", "sum items", "items total")),
    ("freight", "Freight / shipping cost", ("freight", "shipping", "shipping cost", "ship cost")),
    ("unit_price", "Average unit price", ("unit price", "unitprice", "item price")),
)
REPLY_LEAD, ORDINAL, CHILD_ORDINAL = r"^(?:go\s+with|choose|pick|option)\s+", r"^(?:#\s*)?(\d{1,2})\s*\.?$", r"^(?:#|item\s+)?(\d{1,2})\s*\.?$"
SHORT_CHARS, SHORT_WORDS, FOLLOW_UP_CHARS, PAGE_FOLLOW_UP_CHARS, TITLE_CHARS = 40, 4, 100, 80, 3


def needs_measure(question: Column) -> Column:
    """Whether a question asks for an average order price without saying which."""
    q = F.lower(F.trim(F.coalesce(question, F.lit(""))))
    settled = F.lit(False)
    for words in MEASURE_SETTLED:
        settled = settled | q.contains(words)
    return q.contains("order") & q.contains("price") & (q.contains("avg") | q.contains("average")) & ~settled


def needs_document(question_terms: Column, documents: Column) -> Column:
    """Whether a document must be chosen: the question has no term to tell one by, and there are several."""
    return (F.size(question_terms) == 0) & (documents > 1)


def is_short(reply: Column) -> Column:
    """Few enough words to be a reply to a choice and no new question."""
    q = F.trim(F.coalesce(reply, F.lit("")))
    return (F.length(q) <= SHORT_CHARS) & (F.size(F.filter(F.split(q, r"\s+"), lambda w: w != "")) <= SHORT_WORDS)


def choice(reply: Column, options: Column) -> Column:
    """The place, from 1, of the option that a reply chooses: by its number, else by equality, with or without marks.

    ``options`` is an array of arrays of names (id, label and others). A name of four characters or more also
    matches as whole words of the reply. Null if nothing matches.
    """
    q = F.btrim(F.trim(F.regexp_replace(F.lower(F.trim(F.coalesce(reply, F.lit("")))), REPLY_LEAD, "")), F.lit(" ,."))
    plain = lambda x: F.regexp_replace(x, "[^a-z0-9]", "")
    spaced = F.concat(F.lit(" "), F.regexp_replace(q, r"[^\p{L}\p{N}_]+", " "), F.lit(" "))

    def named(name: Column) -> Column:
        n = F.lower(F.trim(name))
        words = F.concat(F.lit(" "), F.regexp_replace(n, r"[^\p{L}\p{N}_]+", " "), F.lit(" "))
        return (n != "") & ((n == q) | ((plain(n) != "") & (plain(n) == plain(q))) | ((F.length(n) >= 4) & F.contains(spaced, words)))

    number = F.nullif(F.regexp_extract(q, ORDINAL, 1), F.lit("")).cast("int")
    hits = F.transform(options, lambda names: F.exists(names, named))
    by_name = F.nullif(F.array_position(hits, True).cast("int"), F.lit(0))
    return F.when(number.between(1, F.size(options)), number).otherwise(by_name)


def child_of(question: Column, titles: Column) -> Column:
    """The place, from 1, of the listed title that a short question is about: its number, or a title that holds it or is in it."""
    q = F.lower(F.trim(F.coalesce(question, F.lit(""))))
    number = F.nullif(F.regexp_extract(q, CHILD_ORDINAL, 1), F.lit("")).cast("int")
    same = lambda t: (F.length(F.trim(t)) >= TITLE_CHARS) & (F.contains(q, F.lower(F.trim(t))) | F.contains(F.lower(F.trim(t)), q))
    by_title = F.nullif(F.array_position(F.transform(titles, lambda t: F.coalesce(same(t), F.lit(False))), True).cast("int"), F.lit(0))
    return F.when(number.between(1, F.size(titles)), number).when((q != "") & (F.length(q) < FOLLOW_UP_CHARS), by_title)


def page_follow_up(question: Column, page: Column) -> Column:
    """A short question after a page was shown, rewritten to name the page; null for others."""
    q = F.lower(F.trim(F.coalesce(question, F.lit(""))))
    cue = q.rlike(r"\b(?:this|that|the|it|its|same)\b.*\b(?:page|image|picture|photo|figure|visual|text|content|words)\b|^(?:the\s+)?(?:image|picture|photo|figure|visual|text|content)\b")
    p = page.cast("string")
    rewritten = (
        F.when(q.rlike(r"\b(image|picture|photo|figure|visual)\b"), F.concat(F.lit("Describe the visual content on PDF page "), p))
        .when(q.rlike(r"\b(text|content|words)\b"), F.concat(F.lit("Give me all the text from PDF page "), p))
        .otherwise(F.concat(F.lit("Tell me about PDF page "), p, F.lit(": "), question))
    )
    return F.when(page.isNotNull() & (F.length(q) < PAGE_FOLLOW_UP_CHARS) & cue, rewritten)


def with_previous(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) with the text of the turn before as ``previous``."""
    return turns.withColumn("previous", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")))


def usage(events: DataFrame) -> DataFrame:
    """model, calls, input and output tokens of each model, and of all in the row whose ``total`` is true.

    ``events`` has model, input_tokens and output_tokens; missing numbers count as none.
    """
    n = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(0))), F.lit(0)).cast("long").alias(c)
    return events.rollup("model").agg(F.grouping("model").cast("boolean").alias("total"), F.count("*").alias("calls"), n("input_tokens"), n("output_tokens")).select(
        "model", "total", "calls", "input_tokens", "output_tokens"
    )


_PREVIOUS = "(SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS previous FROM conversations)"


@registry.add(f"""WITH r AS (SELECT *, string_split(coalesce(previous, ''), chr(10)) AS t FROM {_PREVIOUS} WHERE role = 'user'),
p AS (SELECT conv_id, turn, t, lower(trim(coalesce(CASE (conv_id + turn) % 4 WHEN 0 THEN CAST(conv_id % 5 AS VARCHAR) WHEN 1 THEN substr(t[2], 1, 20) WHEN 2 THEN '#2' ELSE text END, text, ''))) AS q FROM r),
m AS (SELECT *, TRY_CAST(regexp_extract(q, '{CHILD_ORDINAL}', 1) AS INT) AS n, nullif(coalesce(list_position(list_transform(t, lambda x: length(trim(x)) >= {TITLE_CHARS} AND (contains(q, lower(trim(x))) OR contains(lower(trim(x)), q))), true), 0), 0) AS k FROM p)
SELECT conv_id, turn, CASE WHEN n BETWEEN 1 AND len(t) THEN n WHEN q <> '' AND length(q) < 100 THEN CAST(k AS INT) END AS child FROM m""")
def conversation_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which line of the answer before is meant by a user who replies with a number, with the start of the second line, or with their own words."""
    lines, turn = F.split(F.coalesce("previous", F.lit("")), "\n"), (F.col("conv_id") + F.col("turn")) % 4
    c = with_previous(table(spark, sf_dir, "conversations")).where("role = 'user'")
    start = F.substring(F.get(lines, F.lit(1)), 1, 20)
    reply = F.coalesce(F.when(turn == 0, (F.col("conv_id") % 5).cast("string")).when(turn == 1, start).when(turn == 2, "#2").otherwise(F.col("text")), "text", F.lit(""))
    return c.select("conv_id", "turn", child_of(reply, lines).alias("child"))


_OPTIONS = "[['order_total', 'order total (recommended)', 'total', 'order total', 'line item total', 'sum items', 'items total'], ['freight', 'freight / shipping cost', 'freight', 'shipping', 'shipping cost', 'ship cost'], ['unit_price', 'average unit price', 'unit price', 'unitprice', 'item price']]"
_REPLIES = "(SELECT event_id, (['2', 'Option 3', 'go with freight', 'order total', 'none of them', 'the unit price please', '#1.', '7', ''])[event_id % 9 + 1] AS reply FROM events)"


@registry.add(f"""WITH r AS (SELECT event_id, trim(trim(regexp_replace(lower(trim(reply)), '^(?:go\\s+with|choose|pick|option)\\s+', '')), ' ,.') AS q FROM {_REPLIES}),
n AS (SELECT *, TRY_CAST(nullif(regexp_extract(q, '^(?:#\\s*)?(\\d{{1,2}})\\s*\\.?$', 1), '') AS INT) AS k, list_transform({_OPTIONS}, lambda o: len(list_filter(o, lambda x: x = q OR (regexp_replace(q, '[^a-z0-9]', '', 'g') <> '' AND regexp_replace(x, '[^a-z0-9]', '', 'g') = regexp_replace(q, '[^a-z0-9]', '', 'g'))
OR (length(x) >= 4 AND contains(' ' || regexp_replace(q, '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g') || ' ', ' ' || regexp_replace(x, '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g') || ' ')))) > 0) AS h FROM r)
SELECT event_id, CASE WHEN k BETWEEN 1 AND 3 THEN k ELSE CAST(nullif(coalesce(list_position(h, true), 0), 0) AS INT) END AS choice FROM n""")
def conversation_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What replies to the choice of a measure choose; an event's number picks its reply."""
    replies = F.array(*map(F.lit, ("2", "Option 3", "go with freight", "order total", "none of them", "the unit price please", "#1.", "7", "")))
    reply = F.element_at(replies, (F.col("event_id") % 9 + 1).cast("int"))
    options = F.array(*[F.array(*map(F.lit, (i, label.lower(), *others))) for i, label, others in MEASURES])
    return table(spark, sf_dir, "events").select("event_id", choice(reply, options).alias("choice"))


@registry.add("""SELECT role AS model, grouping(role) = 1 AS total, count(*) AS calls, CAST(sum(CASE WHEN turn % 3 = 0 THEN 0 ELSE length(text) END) AS BIGINT) AS input_tokens, CAST(sum(turn) AS BIGINT) AS output_tokens FROM conversations GROUP BY ROLLUP (role)""")
def telemetry_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage by role, as if a turn were a call: characters as input tokens, every third unknown."""
    c = table(spark, sf_dir, "conversations")
    return usage(c.select(F.col("role").alias("model"), F.when(F.col("turn") % 3 != 0, F.length("text")).alias("input_tokens"), F.col("turn").alias("output_tokens")))
