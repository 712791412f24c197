"""Mixing sources to target weights by hash-threshold histograms.

Each row has a fixed 60-bit hash. A source's budget is met by a threshold: rows below it are
taken once more. The threshold comes from sums of sizes by source and hash bucket: the bucket
where the running sum crosses the budget is the boundary, and only its rows are summed again
by their next hash bits, until a bucket is as fine as the hash. Thresholds of growing budgets
are nested, so a larger mix holds every row of a smaller one. Nothing is sorted and no source
is gathered in a task.

Defined cases: a null source is a source of its own and comes last; a null text has size 0;
texts of any length are counted whole; a source of size 0 has target 0 and takes nothing; rows that are
the same in key and text have the same hash, and of those at the boundary as many are taken as come nearest, so a
source comes within half the size of one row of its target; an empty table gives an empty mix;
input columns of any name pass unchanged.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: The mix: weights of the sources in order, repeating; the share of all sizes; the most repeats.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: Bits of the row hash, and bits that a round of histograms resolves.
HASH_BITS, ROUND_BITS = 60, 12
#: Rows of a repeated row that are dealt out at once.
REPEATED_ROWS = 100_000


def row_hash(*cols: Column) -> Column:
    """A long of HASH_BITS bits of the MD5 sum of these columns, joined by ``:``; SQL engines can repeat it."""
    whole = F.md5(F.concat_ws(":", *cols).cast("binary"))
    return F.conv(F.substring(whole, 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``sources`` (source, source_size: one row each) with each one's target.

    Sources are ordered by code point, null last, and weigh ``weights`` in turn. They share
    ``share`` of all sizes by weight; a target stops at ``most`` times its source's size, and
    the excess is shared again by weight until none is above.
    """
    turn = F.pmod(F.col("_turn"), F.lit(len(weights)))
    weight = F.element_at(F.array(*map(F.lit, weights)), turn.cast("int") + 1).cast("double")
    ordered = common.numbered(sources, [F.col("source").asc_nulls_last()], "_turn")
    weighted = common.written(ordered.withColumn("_weight", weight).withColumn("_most", F.col("source_size") * float(most)).drop("_turn"))
    total = weighted.agg(F.sum("source_size")).first()[0] or 0
    budget, level, capped = share * total, 0.0, -1
    while True:
        full = F.col("_most") <= F.col("_weight") * level
        fixed, free, now = weighted.agg(
            F.coalesce(F.sum(F.when(full, F.col("_most"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~full, F.col("_weight"))), F.lit(0.0)),
            F.count_if(full),
        ).first()
        if now == capped or not free:
            break
        level, capped = max(0.0, budget - fixed) / free, now
    return weighted.withColumn("target", F.least(F.col("_most"), F.col("_weight") * level) if free else F.col("_most")).drop("_weight", "_most")


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """source, the hash below which its rows' sizes sum to about its ``budget``, and how many rows of that very hash come nearest to it.

    ``rows`` has source, size, hash and n, the number of rows that these stand for; ``budgets`` has source and budget. Each
    round sums the boundary buckets of the last one by ROUND_BITS more bits: at most a bucket count of rows
    for each source. Only the first two rounds read all rows: the second writes those of the first
    boundaries, about one in 2**ROUND_BITS, for the rest. The last boundary holds rows of one hash.
    """
    same = lambda a, b: a.eqNullSafe(b)
    start = budgets.select("source", F.col("budget").alias("left"), F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("part"), F.lit(True).alias("open"))
    state = common.written(start)
    n = state.count()
    for bits in range(ROUND_BITS, HASH_BITS + 1, ROUND_BITS):
        s = common.small_or_not(state.where("open").select(F.col("source").alias("_s"), "prefix", F.col("left").alias("_left")), n)
        at_border = lambda r: r.join(s, same(r["source"], s["_s"]) & (F.shiftright(r["hash"], HASH_BITS - bits + ROUND_BITS) == s["prefix"]))  # noqa: B023, E731
        if bits == 2 * ROUND_BITS:
            rows = common.written(at_border(rows).select("source", "size", "hash", "n"))
        here = at_border(rows)
        sums = here.groupBy("source", F.shiftright("hash", HASH_BITS - bits).alias("bucket")).agg(
            F.sum(F.col("size") * F.col("n")).alias("sum"), F.sum("n").alias("n"), F.first("_left").alias("_left")
        )
        upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        running = sums.withColumn("upto", F.sum("sum").over(upto)).where(F.col("upto") > F.col("_left"))
        first = running.groupBy(F.col("source").alias("_s")).agg(F.min_by(F.struct("bucket", "sum", "n", "upto"), "bucket").alias("at"))
        crossed = state.join(common.small_or_not(first, n), same(state["source"], first["_s"]), "left")
        rest = F.col("left") - (F.col("at.upto") - F.col("at.sum"))
        still = F.col("open") & F.col("at").isNotNull()
        state = common.written(
            crossed.select(
                "source",
                F.when(still, rest).otherwise(F.col("left")).alias("left"),
                F.when(still, F.col("at.bucket")).otherwise(F.col("prefix")).alias("prefix"),
                F.when(still, F.ceil(rest * F.col("at.n") / F.col("at.sum") - 0.5)).otherwise(F.lit(0)).cast("long").alias("part"),
                still.alias("open"),
            )
        )
    # A source whose rows never pass its budget is taken whole.
    whole = F.lit(1 << HASH_BITS)
    return state.select("source", F.when(F.col("open"), F.col("prefix")).otherwise(whole).alias("threshold"), F.when(F.col("open"), F.col("part")).otherwise(F.lit(0)).alias("part"))


def source_plan(rows: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target, whole (times that all its rows are taken), threshold and part of each source of ``rows``."""
    sizes = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    whole = F.floor(F.col("target") / F.col("source_size"))
    plan = common.written(
        targets(sizes, weights, share, most).withColumn("whole", F.when(F.col("source_size") > 0, whole).otherwise(0).cast("long"))
    )
    cut = thresholds(rows, plan.select("source", (F.col("target") - F.col("whole") * F.col("source_size")).alias("budget")))
    cut = cut.select(F.col("source").alias("_c"), "threshold", "part")
    return common.written(plan.join(cut, plan["source"].eqNullSafe(cut["_c"])).drop("_c"))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words of the text) and hash of the documents, with the number n of rows that are equal in these; written once."""
    slim = docs.select("doc_id", "source", common.word_count(F.col("text")).alias("size"), document_hash().alias("hash"))
    return common.written(slim.groupBy(*slim.columns).agg(F.count(F.lit(1)).alias("n")))


def document_hash() -> Column:
    return row_hash(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(F.coalesce("text", F.lit("")).cast("binary")))


def _planned(rows: DataFrame, plan: DataFrame, name: str) -> DataFrame:
    """``rows`` (with a source) and the row of its source's plan in a struct."""
    plan = common.small_or_not(plan.select(F.struct(*plan.columns).alias(name)), plan.count())
    return rows.join(plan, rows["source"].eqNullSafe(F.col(f"`{name}`.source")))


def _copies(hash_: Column, name: str, among: Column) -> Column:
    """How often a row is taken; ``among``: whether it is one of those that its source's plan takes of the boundary's rows."""
    of = lambda c: F.col(f"`{name}`.{c}")
    rest = ((hash_ < of("threshold")) | ((hash_ == of("threshold")) & among)) & (of("target") > of("whole") * of("source_size"))
    return F.when(of("source_size") > 0, of("whole") + rest.cast("long")).otherwise(F.lit(0).cast("long"))


def mix_report(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """doc_id, size, source_size, target and taken (size times copies) of every document.

    Equal rows at a boundary are parted into those taken once more and those not; then all are dealt out again, REPEATED_ROWS at a time.
    """
    rows = sized(docs)
    planned = _planned(rows, source_plan(rows, weights, share, most), "plan")
    at_border = F.col("hash") == F.col("plan.threshold")
    taken = F.when(at_border, F.least(F.col("n"), F.col("plan.part"))).otherwise(F.col("n"))
    parts = F.filter(F.array(F.struct(F.lit(True).alias("among"), taken.alias("n")), F.struct(F.lit(False).alias("among"), (F.col("n") - taken).alias("n"))), lambda p: p["n"] > 0)
    dealt = planned.withColumn("part", F.explode(parts)).withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("part.n") - 1, F.lit(REPEATED_ROWS).cast("long"))))
    if rows.where(F.col("n") > REPEATED_ROWS).limit(1).count():
        dealt = dealt.repartition("at", "doc_id", "hash")  # the parts of one repeated row to many tasks
    each = dealt.withColumn("at", F.explode(F.sequence(F.col("at") + 1, F.least(F.col("at") + REPEATED_ROWS, F.col("part.n")))))
    copies = _copies(F.col("hash"), "plan", F.col("part.among"))
    return each.select("doc_id", "size", "plan.source_size", "plan.target", (copies * F.col("size")).alias("taken"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """The mixed rows of ``docs``, each as often as the mix takes it: a filter by source, texts aren't shuffled.

    Only where a boundary parts rows that are equal, these are written, numbered by range and counted off.
    """
    rows = sized(docs)
    plan = source_plan(rows, weights, share, most)
    name, copies, copy, number, hash_ = common.free_names(docs, "plan", "copies", "copy", "number", "hash")
    border = rows.join(common.small_or_not(plan.select(F.col("source").alias("_s"), "threshold", "part"), plan.count()), rows["source"].eqNullSafe(F.col("_s")) & (F.col("hash") == F.col("threshold")))
    cut = border.where((F.col("part") > 0) & (F.col("part") < F.col("n"))).limit(1).count()
    planned = _planned(docs, plan, name).withColumn(hash_, document_hash())
    of = lambda c: F.col(f"`{name}`.{c}")
    if not cut:
        taken = planned.withColumn(copies, _copies(F.col(hash_), name, of("part") > 0))
    else:
        at_border = F.col(hash_) == of("threshold")
        counted = common.numbered(planned.where(at_border), [F.col("source")], number)
        firsts = counted.groupBy(F.col("source").alias("_s")).agg(F.min(number).alias("_first"))
        counted = counted.join(common.small_or_not(firsts, plan.count()), counted["source"].eqNullSafe(F.col("_s")))
        off = counted.withColumn(copies, _copies(F.col(hash_), name, F.col(number) - F.col("_first") < of("part")))
        rest = planned.where(~at_border).withColumn(copies, _copies(F.col(hash_), name, F.lit(False)))
        kept = [*docs.columns, copies]
        taken = rest.select(*kept).unionByName(off.select(*kept))
    taken = taken.where(F.col(copies) > 0)
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(*docs.columns)
