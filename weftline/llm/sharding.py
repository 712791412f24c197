"""Sharding by jump consistent hashing, in Spark expressions only.

Law ``key``: the key and the number of shards decide the shard. Going from n to n + 1
shards moves a row only into the new shard, about one row in n + 1. The jumps follow
Lamping and Veach (2014); a jump's pseudo-random draw is the MD5 sum of the key and the jump's number.

Defined cases: a null key is a key of its own; a null text has no bytes; texts of any length
are measured whole; repeated rows keep one slot each, next to each other; an empty table gives an
empty result; input columns that have the name of an output column are replaced. A key jumps
MAX_JUMPS times at most and then keeps the shard it has reached: for a million shards, which take
14 jumps on average, the chance of that is below 1e-60.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Jumps of a key; after k jumps the expected position is beyond 2**k.
MAX_JUMPS = 128
#: Rows that one group of the slot numbering has on average, and rows of a repeated row that are dealt at once.
SLOT_GROUP_ROWS, REPEATED_ROWS = 16_384, 100_000
NULL_KEY = "null key"


def jump_shards(key: Column, *counts: int) -> Column:
    """Array of the shards of ``key`` (ints from 0) among each of ``counts`` shards, from one chain of jumps."""
    if min(counts) < 1:
        raise ValueError("a number of shards must be 1 or more")
    name, most = F.coalesce(key.cast("string"), F.lit(NULL_KEY)), max(counts)
    start = F.struct(F.array(*[F.lit(0).cast("long")] * len(counts)).alias("shards"), F.lit(0).cast("long").alias("at"))

    def jump(state: Column, step: Column) -> Column:
        onward = F.floor((state["at"] + 1) / ((common.md5_draw(name, step) + 1) / F.lit(float(1 << 32)))).cast("long")
        inside = lambda at, n: F.when(at < n, at)
        moved = F.struct(
            F.array(*[F.coalesce(inside(onward, n), state["shards"][i]) for i, n in enumerate(counts)]).alias("shards"), onward.alias("at")
        )
        return F.when(state["at"] < most, moved).otherwise(state)

    steps = F.sequence(F.lit(0), F.lit(min(most, MAX_JUMPS) - 1))
    return F.aggregate(steps, start, jump, lambda state: state["shards"].cast("array<int>"))


def jump_hash(key: Column, n_shards: int) -> Column:
    """Shard of ``key`` among ``n_shards``, an int from 0."""
    return jump_shards(key, n_shards)[0]


def assign(df: DataFrame, key: str, n_shards: int, shard: str = "shard") -> DataFrame:
    """``df`` with its shard number: a projection, nothing is shuffled."""
    return df.withColumn(shard, jump_hash(F.col(key), n_shards))


def number_slots(df: DataFrame, shard: str, order: list[str], n_shards: int, slot: str = "slot") -> DataFrame:
    """``df`` with a gapless long from 0 in each shard; ``order`` and ``shard`` are all that tells two rows apart.

    A shard may hold any share of the rows, so it isn't numbered in one task, and neither is a
    row that repeats: equal rows are counted before the shuffle and numbered as one, with as many slots.
    The distinct rows are spread over hashed groups, the groups' counts give each group its
    first number, and rows are numbered in their group; then a repeated row is dealt out again.
    """
    group, count, first, at = common.free_names(df, "group", "count", "first", "at")
    counted = common.written(df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias(count)))
    groups, rows = 1, counted.count()
    while groups * n_shards * SLOT_GROUP_ROWS < rows:
        groups *= 2
    spread = counted.withColumn(group, F.pmod(F.xxhash64(*order), F.lit(groups)).cast("int"))
    sums = spread.groupBy(shard, group).agg(F.sum(count).alias(count))
    upto = Window.partitionBy(shard).orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
    firsts = common.written(sums.select(shard, group, F.coalesce(F.sum(count).over(upto), F.lit(0)).alias(first)))
    before = Window.partitionBy(shard, group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = spread.join(common.small_or_not(firsts, groups * n_shards), [shard, group])
    placed = placed.withColumn(first, F.col(first) + F.coalesce(F.sum(count).over(before), F.lit(0)))
    parts = placed.withColumn(at, F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1, F.lit(REPEATED_ROWS).cast("long"))))
    if counted.where(F.col(count) > REPEATED_ROWS).limit(1).count():
        parts = parts.repartition(at, *order)  # the parts of one repeated row to many tasks
    last = F.least(F.col(at) + REPEATED_ROWS, F.col(count)) - 1
    return parts.withColumn(slot, F.explode(F.sequence(F.col(first) + F.col(at), F.col(first) + last))).select(*df.columns, slot)


def shard_documents(docs: DataFrame, n_shards: int) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        jump_shards(F.col("doc_id"), n_shards, n_shards + 1).alias("shards"),
    )
    slim = slim.select("doc_id", "size", "text_crc32", F.col("shards")[0].alias("shard"), F.col("shards")[1].alias("grown_shard"))
    numbered = number_slots(slim, "shard", ["doc_id", "text_crc32", "size"], n_shards)
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
