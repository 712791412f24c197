"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: The largest table, in rows, that an operator broadcasts after counting it.
BROADCAST_ROWS = 100_000


#: Rows of a batch that a Python worker gets at once: of whole texts, a few megabytes.
BATCH_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """Let Python workers get BATCH_ROWS rows at once for the rest of the session, if they get more: a batch of texts is held several times."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


#: Folders that ``written`` has made and nothing has deleted yet.
_FOLDERS: list[str] = []


@contextmanager
def clearing(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Deletes, at its end, the folders that ``written`` makes within it, but for those of the tables in the list that it gives."""
    before, kept = set(_FOLDERS), []
    try:
        yield kept
    finally:
        keep = {t._weftline_path for t in kept}
        for path in [p for p in _FOLDERS if p not in before and p not in keep]:
            remove(spark, path)


def own_settings(spark: SparkSession) -> SparkSession:
    """A session with the settings of ``spark`` that can be changed without changing those."""
    own = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(name):
            own.conf.set(name, value)
    return own


def scratch_dir(spark: SparkSession) -> str:
    """A new path in the folder that all executors share.

    The cluster names it in ``spark.checkpoint.dir``, or a program has set it with
    ``setCheckpointDir``. Only a local master, as in tests, may do without: there a temporary
    folder takes its place. Elsewhere its absence is an error, as executors wouldn't see each
    other's files.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = getattr(spark, "_weftline_scratch", None)
        if root is None:
            root = "file://" + tempfile.mkdtemp(prefix="weftline-")
            spark._weftline_scratch = root
    return f"{root.rstrip('/')}/weftline-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of ``scratch_dir`` and all in it; a missing one is no error."""
    if path in _FOLDERS:
        _FOLDERS.remove(path)
    name = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    name.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(name, True)


def written(df: DataFrame, partition_by: list[str] | None = None, options: dict | None = None) -> DataFrame:
    """``df`` written to the shared folder and read again: later jobs start from the files.

    The folder stays while the table is needed; ``drop`` deletes it sooner than the end of the session.
    """
    path = scratch_dir(df.sparkSession)
    writer = df.write.options(**(options or {}))
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    _FOLDERS.append(path)
    writer.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._weftline_path = path
    return back


def drop(*tables: DataFrame) -> None:
    """Delete the files of tables from ``written`` that nothing reads any more."""
    for t in tables:
        remove(t.sparkSession, t._weftline_path)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """For each name the same one with underscores before it, so that no column of ``df`` has it, case aside."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        found.append(name)
    return found


def md5_draw(*keys: Column) -> Column:
    """32 bits of the MD5 sum of ``keys`` joined by ``:``, as a long: a draw that SQL engines can repeat."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *keys).cast("binary")), 1, 8), 16, 10).cast("long")


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with a gapless long from 0 in this order: sorted by range, numbered in each partition, and no task holds all rows."""
    at, part, first = free_names(df, "at", "part", "first")
    sorted_ = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()))
    placed = sorted_.withColumn(part, F.shiftright(at, 33))
    counts = placed.groupBy(part).agg(F.count(F.lit(1)).alias(first))
    upto = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    firsts = counts.select(part, F.coalesce(F.sum(first).over(upto), F.lit(0)).alias(first))
    within = F.col(at).bitwiseAND((1 << 33) - 1)
    return placed.join(F.broadcast(firsts), part).select(*df.columns, (F.col(first) + within).alias(name))


def dealt_out(df: DataFrame) -> DataFrame:
    """``df`` over as many tasks as there are cores, if fewer have rows: heavy work on a table of few splits uses all of them. Others stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.select(F.spark_partition_id().alias("p")).distinct().count() < cores else df


def small_or_not(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for a broadcast if its counted ``rows`` allow it; else left to the planner."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def joined(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner", rows: int = 0) -> DataFrame:
    """``left`` joined with ``right``, whose side that could be broadcast has ``rows`` rows at most: by shuffles if these are many.

    The planner goes by the size of files: compressed tables of ids pass its limit and take many times as much on the driver.
    """
    return left.join(right if rows <= BROADCAST_ROWS else right.hint("merge"), on, how)


def word_count(text: Column) -> Column:
    """Number of words of the whole text as a long; none for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once for each row, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def bounded_share(rows: int, most: int) -> float:
    """The share of ``rows`` that a hash filter keeps so that about ``most`` stay."""
    return 1.0 if rows <= most else most / rows


def hash_below(key: Column, share: float, salt: str) -> Column:
    """True for a fixed pseudo-random ``share`` of the keys."""
    return F.shiftrightunsigned(F.xxhash64(key, F.lit(salt)), 11) < F.lit(int(share * (1 << 53)))
