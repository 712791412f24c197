"""Conversation structure repair: faults from windows, then the cheapest edits by a fold of Spark's higher-order functions.

A repaired conversation's role initials match ``(s?(ua)+)?``. Keeping a row costs nothing, giving it the
role user or assistant 1, deleting it 2, inserting an empty row 5, and a truncated row that stays 5
more. aggregate() goes over the sorted turns and carries four (cost, audit) structs: the cheapest way to
have written nothing so far, a system row, a user row last, an assistant row last. ``least`` picks by cost, then
audit; of two audits of one cost neither is the other's start, so the least prefix stays the least.

A conversation may hold any share of the rows. Rows are sorted by range, and each stretch of
2**SEGMENT_BITS rows is folded by itself from all four states; then the stretches' four by four results are joined in
groups of FAN until each conversation has one. Equal rows are counted before any of that and edited as one run. The rows'
texts take no part in the folds; the chosen edits are joined back to them.

Defined cases: a null role or text is one space; a null conv_id is a conversation of its own; null turns come first; rows
of one turn go by role, then text; rows that are equal in all four columns are adjacent; an empty or very long text is
a text like others; an empty table gives empty results; other columns don't matter. A role's initial is its first
character, whatever the role. The audit holds a letter a row, so one conversation can have 2**31 rows at most.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Costs of the edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Rows of a stretch that is folded at once, as a power of two, and results joined at once.
SEGMENT_BITS, FAN = 10, 32
#: The four states, by what was written last.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
#: Neighbouring initials of a sound conversation.
PAIRS = ("su", "ua", "au")
#: ASCII white space.
BLANKS = " \t\n\x0b\x0c\r"
BLANK, DUPLICATE, CUT = "blank", "duplicate", "truncated"
_WAY = "struct<cost:bigint,audit:string,edits:string>"


@dataclass(frozen=True)
class Repaired:
    """``report``: a row for each conversation; ``turns``: conv_id, place (from 1), edit, role and text of each row that stays or comes in."""

    report: DataFrame
    turns: DataFrame


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text of ``conversations`` with planted faults; a CRC-32 of conversation and turn decides which."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    hurt = conversations.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"), kind.alias("_kind")
    ).where(F.col("_kind") != 0)
    twice = F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return hurt.withColumn("_kind", twice).drop("_kind")


def sorted_rows(conversations: DataFrame) -> DataFrame:
    """The distinct rows with their number ``n``, in order of conversation, turn, role and text by ``at``, written.

    ``same`` is the digest of role and text. ``block`` holds 2**SEGMENT_BITS neighbours of one partition at most.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    keys = ["conv_id", "turn", "role", "text"]
    counted = conversations.select("conv_id", "turn", space("role"), space("text")).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    last = F.substring(F.rtrim(F.col("text"), F.lit(BLANKS)), -1, 1)
    ordered = common.written(counted.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()))
    return ordered.select(
        "*",
        F.shiftright("at", SEGMENT_BITS).alias("block"),
        F.sha2(F.concat_ws(":", F.length("role"), "role", "text").cast("binary"), 256).alias("same"),
        F.substring("role", 1, 1).alias("initial"),
        (last == "").alias("blank"),
        (~last.isin("", ".", "!", "?")).alias("cut"),
    )


def faults(rows: DataFrame) -> DataFrame:
    """The rows of ``sorted_rows`` without texts, each with the fault of its first copy, and how many of its copies have it.

    A text seen in an earlier block is known from the first block of each text, one seen in this block from a window.
    """
    slim = rows.select("conv_id", "turn", "at", "block", "same", "initial", "blank", "cut", "n")
    seen = slim.groupBy(F.col("conv_id").alias("_c"), F.col("same").alias("_s")).agg(F.min("block").alias("_first"))
    joined = slim.join(seen, slim["conv_id"].eqNullSafe(seen["_c"]) & (slim["same"] == seen["_s"])).drop("_c", "_s")
    here = Window.partitionBy("conv_id", "block", "same").orderBy("at")
    before = Window.partitionBy("conv_id", "block").orderBy("at")
    known = (F.col("block") > F.col("_first")) | (F.row_number().over(here) > 1)
    fault = F.when(F.col("blank"), BLANK).when(known, DUPLICATE).when(F.col("cut"), CUT).otherwise("")
    pair = F.concat(F.lag("initial").over(before), F.col("initial"))
    double = F.concat("initial", "initial").isin(*PAIRS)
    return (
        joined.repartition("conv_id", "block")
        .withColumn("fault", fault)
        .withColumn("illegal", F.coalesce((~pair.isin(*PAIRS)).cast("long"), F.lit(0)) + (F.col("n") - 1) * (~double).cast("long"))
        .drop("_first", "blank", "cut", "same")
    )


def _add(way: Column, cost: int | Column, letter: str | Column, edits: str) -> Column:
    """``way`` with one more edit; null stays null, which ``least`` passes over."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    longer = F.struct(
        (way["cost"] + lit(cost)).cast("long").alias("cost"), F.concat(way["audit"], lit(letter)).alias("audit"), F.concat(way["edits"], F.lit(edits)).alias("edits")
    )
    return F.when(way.isNotNull(), longer)


def _turn(ways: Column, turn: Column) -> Column:
    """The four ways after one more turn and its copies."""
    dead = turn["fault"].isin(BLANK, DUPLICATE)
    gone = F.transform(ways, lambda w: _add(w, turn["n"] * DELETE, F.repeat(F.lit("D"), turn["n"].cast("int")), "D"))
    extra = F.when(turn["fault"] == CUT, F.lit(TRUNCATED)).otherwise(F.lit(0))
    copies = turn["n"] - 1
    letters = lambda x: F.concat(F.lit(x), F.repeat(F.lit("D"), copies.cast("int")))
    keep = lambda w, initial: F.when(turn["initial"] == initial, _add(w, extra + copies * DELETE, letters("K"), "K"))
    rerole = lambda w, to: _add(w, extra + copies * DELETE + REROLE, letters("R"), to)

    def stays(user: Column, gone: Column) -> Column:
        """``user``: the cheapest way with a user row last, inserted if need be."""
        answered = F.least(ways[ASSISTANT], _add(user, INSERT, "I", "A"))

        def after(answered: Column) -> Column:
            ready = F.least(ways[EMPTY], ways[SYSTEM], answered)
            return common.bind(
                ready,
                lambda r: F.array(
                    gone[EMPTY],
                    F.least(gone[SYSTEM], keep(ways[EMPTY], "s")),
                    F.least(gone[USER], keep(r, "u"), rerole(r, "u")),
                    F.least(gone[ASSISTANT], keep(user, "a"), rerole(user, "a")),
                ),
            )

        return common.bind(answered, after)

    asked = F.least(ways[USER], *[_add(ways[s], INSERT, "I", "U") for s in (EMPTY, SYSTEM, ASSISTANT)])
    kept = common.bind(gone, lambda g: common.bind(asked, lambda u: stays(u, g)))
    return F.when(dead, gone).otherwise(kept)


def _nothing(state: int) -> Column:
    """The four ways at the start of a stretch that is entered in ``state``."""
    start = F.struct(F.lit(0).cast("long").alias("cost"), F.lit("").alias("audit"), F.lit("").alias("edits"))
    return F.array(*[start if s == state else F.lit(None).cast(_WAY) for s in range(4)])


def fold(turns: Column, state: int) -> Column:
    """The four cheapest ways through an array of turns that is entered in ``state``."""
    return F.aggregate(turns, _nothing(state).cast(f"array<{_WAY}>"), lambda ways, t: _turn(ways, t).cast(f"array<{_WAY}>"))


def stretches(flagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counts of each stretch with its number ``k`` in its conversation, and its four by four ways, written.

    A conversation's first stretch is only entered in the state EMPTY; its other three are null.
    """
    turn = F.struct("at", "initial", "fault", "n")
    collected = common.written(
        flagged.groupBy("conv_id", "block").agg(
            F.sort_array(F.collect_list(turn)).alias("turns"),
            F.sum(F.when(F.col("fault") == BLANK, F.col("n")).otherwise(0)).alias(BLANK),
            F.sum(F.when(F.col("fault") == BLANK, 0).when(F.col("fault") == DUPLICATE, F.col("n")).otherwise(F.col("n") - 1)).alias(DUPLICATE),
            F.count_if(F.col("fault") == CUT).alias(CUT),
            F.sum("illegal").alias("illegal"),
            F.min_by("initial", "at").alias("first"),
            F.max_by("initial", "at").alias("last"),
        )
    )
    order = Window.partitionBy("conv_id").orderBy("block")
    border = F.concat(F.lag("last").over(order), F.col("first"))
    counts = (
        collected.drop("turns")
        .withColumn("k", F.row_number().over(order).cast("long") - 1)
        .withColumn("illegal", F.col("illegal") + F.coalesce((~border.isin(*PAIRS)).cast("long"), F.lit(0)))
    )
    number = counts.select(F.col("conv_id").alias("_c"), F.col("block").alias("_b"), "k")
    numbered = collected.select("conv_id", "block", "turns").join(number, collected["conv_id"].eqNullSafe(number["_c"]) & (collected["block"] == number["_b"]))
    later = lambda s: F.when(F.col("k") > 0, fold(F.col("turns"), s))
    ways = F.array(fold(F.col("turns"), EMPTY), *[later(s) for s in (SYSTEM, USER, ASSISTANT)])
    return counts, common.written(numbered.select("conv_id", "block", "k", ways.alias("ways")))


def _joined(ways: Column, then: Column) -> Column:
    """The four ways ``ways`` followed by a stretch whose four by four are ``then``; edits say in which state each stretch was entered."""

    def both(a: Column, b: Column) -> Column:
        one = F.struct((a["cost"] + b["cost"]).alias("cost"), F.concat(a["audit"], b["audit"]).alias("audit"), F.concat(a["edits"], b["edits"]).alias("edits"))
        return F.when(a.isNotNull() & b.isNotNull(), one)

    return F.array(*[F.least(*[both(ways[s], then[s][to]) for s in range(4)]) for to in range(4)])


def cheapest(ways: DataFrame) -> DataFrame:
    """conv_id, cost, audit, and path: the state in which each stretch is entered and, last, the one in which the conversation ends."""
    entered = lambda s: F.transform(
        F.col("ways")[s], lambda w: F.when(w.isNotNull(), F.struct(w["cost"].alias("cost"), w["audit"].alias("audit"), F.lit(str(s)).alias("edits")))
    )
    level = ways.select("conv_id", "k", F.array(*[entered(s) for s in range(4)]).alias("ways"))
    most = ways.agg(F.max("k")).first()[0] or 0
    whole = lambda s: F.when(
        F.col("group")[0]["ways"][s].isNotNull(),
        F.aggregate("group", _nothing(s).cast(f"array<{_WAY}>"), lambda a, x: _joined(a, x["ways"]).cast(f"array<{_WAY}>")),
    )
    while most:
        most //= FAN
        grouped = level.groupBy("conv_id", F.floor(F.col("k") / FAN).cast("long").alias("k")).agg(F.sort_array(F.collect_list(F.struct("k", "ways"))).alias("group"))
        level = common.written(grouped.select("conv_id", "k", F.array(*[whole(s) for s in range(4)]).alias("ways")))
    of = lambda s: F.col("ways")[EMPTY][s]
    ends = F.least(
        _add(of(EMPTY), 0, "", str(EMPTY)), _add(of(ASSISTANT), 0, "", str(ASSISTANT)), _add(of(USER), INSERT, "I", str(USER)), _add(of(SYSTEM), 2 * INSERT, "II", str(SYSTEM))
    )
    return level.select("conv_id", ends.alias("end")).select("conv_id", "end.cost", "end.audit", F.col("end.edits").alias("path"))


def _letters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda x: x != "")


def repaired_turns(rows: DataFrame, ways: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of the repaired conversations: each stretch's edits on the chosen path, joined to the rows they are about."""
    path = found.select(F.col("conv_id").alias("_c"), _letters(F.col("path")).alias("path"))
    steps = path.select("_c", F.size("path").alias("_n"), F.col("path").alias("_path"), F.posexplode(F.slice("path", 1, F.size("path") - 1)).alias("_k", "_in"))
    steps = steps.select("_c", "_k", F.col("_in").cast("int").alias("_in"), F.col("_path")[F.col("_k") + 1].cast("int").alias("_out"), (F.col("_k") + 2 == F.col("_n")).alias("_last"))
    chosen = ways.join(steps, ways["conv_id"].eqNullSafe(steps["_c"]) & (ways["k"] == steps["_k"]))
    tail = F.when(F.col("_last") & (F.col("_out") == USER), "A").when(F.col("_last") & (F.col("_out") == SYSTEM), "UA").otherwise("")
    edits = chosen.select("conv_id", "block", "k", F.concat(F.col("ways")[F.col("_in")][F.col("_out")]["edits"], tail).alias("edits"))
    upto = Window.partitionBy("conv_id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    kept = F.length(F.translate("edits", "D", "")).cast("long")
    offset = edits.select("conv_id", "block", "edits", F.coalesce(F.sum(kept).over(upto), F.lit(0)).alias("offset"))
    running = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    letters = (
        offset.select("conv_id", "block", "offset", F.posexplode(_letters(F.col("edits"))).alias("pos", "edit"))
        .withColumn("place", F.col("offset") + F.count_if(F.col("edit") != "D").over(running))
        .withColumn("i", F.count_if(~F.col("edit").isin("U", "A")).over(running))
        .where(F.col("edit") != "D")
        .select(F.col("conv_id").alias("_c"), F.col("block").alias("_b"), "place", "edit", F.when(~F.col("edit").isin("U", "A"), F.col("i")).alias("_i"))
    )
    own = Window.partitionBy("conv_id", "block").orderBy("at")
    at = rows.select("conv_id", "block", "at").withColumn("i", F.row_number().over(own).cast("long"))
    placed = letters.join(at, letters["_c"].eqNullSafe(at["conv_id"]) & (letters["_b"] == at["block"]) & (letters["_i"] == at["i"]), "left").select("_c", "place", "edit", "at")
    texts = rows.select(F.col("at").alias("_at"), "role", "text")
    to = F.when(F.lower("edit") == "u", "user").when(F.lower("edit") == "a", "assistant").otherwise(F.col("role"))
    return placed.join(texts, placed["at"] == texts["_at"], "left").select(
        F.col("_c").alias("conv_id"),
        "place",
        F.when(F.col("edit") == "K", "keep").when(F.col("edit").isin("u", "a"), "rerole").otherwise("insert").alias("edit"),
        to.alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )


def repair(conversations: DataFrame) -> Repaired:
    """Each conversation's faults, the cheapest edits that make it sound, and the rows that these edits give."""
    rows = sorted_rows(conversations)
    flagged = faults(rows)
    counts, ways = stretches(flagged)
    found = cheapest(ways)
    sums = counts.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in (BLANK, DUPLICATE, CUT, "illegal")])
    turns = rows.groupBy(F.col("conv_id").alias("_t")).agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps")
    )
    best = found.select(F.col("conv_id").alias("_f"), "cost", "audit")
    report = sums.join(turns, sums["conv_id"].eqNullSafe(turns["_t"])).join(best, sums["conv_id"].eqNullSafe(best["_f"]))
    return Repaired(report.select("conv_id", "gaps", BLANK, DUPLICATE, CUT, "illegal", "cost", "audit"), repaired_turns(rows, ways, found))


def digests(turns: DataFrame) -> DataFrame:
    """conv_id and the SHA-256 of its ``role:text`` lines in order.

    The digest goes over the sorted rows as they pass, so a conversation of any length is held a batch at a time.
    """
    schema = T.StructType([turns.schema["conv_id"], T.StructField("repaired_sha256", T.StringType())])
    kind = turns.select("conv_id").limit(0).toArrow().schema.field(0).type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("conv_id", kind), ("repaired_sha256", pa.string())])
        current, digest = None, None
        for batch in batches:
            ids, done = batch.column("conv_id").to_pylist(), []
            for key, role, text in zip(ids, batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if digest is not None and key == current:
                    digest.update(b"\n")
                else:
                    if digest is not None:
                        done.append((current, digest.hexdigest()))
                    current, digest = key, hashlib.sha256()
                digest.update(f"{role}:{text}".encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], kind), pa.array([d for _, d in done])], schema=out)
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([current], kind), pa.array([digest.hexdigest()])], schema=out)

    lined = turns.select("conv_id", "place", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return lined.mapInArrow(run, schema)


def repair_report(conversations: DataFrame, damaged: DataFrame) -> DataFrame:
    """The report of ``damaged`` for every conv_id of ``conversations``, with the digest of what the repair gives."""
    fixed = repair(damaged)
    report, lines = fixed.report.withColumnRenamed("conv_id", "_r"), digests(fixed.turns).withColumnRenamed("conv_id", "_d")
    ids = conversations.select("conv_id").distinct()
    all_ = ids.join(report, ids["conv_id"].eqNullSafe(report["_r"]), "left").join(lines, ids["conv_id"].eqNullSafe(lines["_d"]), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return all_.select(
        "conv_id",
        *map(zero, ("gaps", BLANK, DUPLICATE, CUT, "illegal", "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
