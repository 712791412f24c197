"""Feedback as a stream: recording, counters that forget, and outcomes that come late.

A stream's sink writes one folder a micro-batch and replaces it if the batch is repeated, so a restart counts
nothing twice. Counters and last values are kept as sums and newest rows of each batch; readers add them up.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.feedback import ATTACH_DAYS, counters
from ..plans.registry import Registry
from ..sources.tables import table

registry = Registry()

# Days that counters are kept, and the newest events that a reader gets.
COUNTER_DAYS, MOST_EVENTS = 90, 100_000
KEYS = ["pattern", "mode"]


class Recorder:
    """A ``foreachBatch`` sink of feedback events: request_id, ts, pattern, mode, route and outcome."""

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def __call__(self, events: DataFrame, batch_id: int) -> None:
        """Write a micro-batch: its events by day, its counters by day, and the newest event of each request."""
        kept = events.withColumn("day", F.date_format("ts", "yyyy-MM-dd")).persist()
        try:
            self._write(kept, "events", batch_id, "day")
            self._write(counters(kept, ["day", *KEYS, "route"]), "counters", batch_id)
            newest = kept.groupBy("request_id").agg(F.max(F.struct("ts", "pattern", "mode", "route", "outcome")).alias("last"))
            self._write(newest, "last", batch_id)
        finally:
            kept.unpersist()

    def _write(self, df: DataFrame, name: str, batch_id: int, *parts: str) -> None:
        df.write.mode("overwrite").partitionBy(*parts).parquet(f"{self.path}/{name}/batch={batch_id}")

    def _read(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.option("basePath", f"{self.path}/{name}").option("recursiveFileLookup", False).parquet(f"{self.path}/{name}/*")

    def stats(self, spark: SparkSession, keys: list[str], today: str, days: int = COUNTER_DAYS) -> DataFrame:
        """queries, passed and failed by ``keys`` over the last ``days``."""
        some = self._read(spark, "counters").where(F.col("day").cast("date") > F.date_sub(F.lit(today).cast("date"), days))
        return some.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("queries", "passed", "failed")])

    def last(self, spark: SparkSession) -> DataFrame:
        """The newest event of each request."""
        return self._read(spark, "last").groupBy("request_id").agg(F.max("last").alias("last")).select("request_id", "last.*")

    def recent(self, spark: SparkSession, most: int = MOST_EVENTS) -> DataFrame:
        """The newest ``most`` events; only their days are read if days are filtered."""
        return self._read(spark, "events").orderBy(F.desc("ts"), "request_id").limit(most)


def forgetting_counters(events: DataFrame, days: int = COUNTER_DAYS) -> DataFrame:
    """pattern, mode, queries, passed and failed in update mode; a key without events for ``days`` of event time is forgotten.

    ``events`` is a stream with a watermark on ts.
    """

    def count(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        queries, passed, failed, newest = state.get if state.exists else (0, 0, 0, 0)
        for pdf in batches:
            known = pdf["outcome"].dropna().astype(bool)
            queries, passed, failed = queries + len(pdf), passed + int(known.sum()), failed + int((~known).sum())
            newest = max(newest, int(pdf["ts"].astype("int64").max()) // 1_000_000)
        state.update((queries, passed, failed, newest))
        state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + days * 86_400_000)
        yield pd.DataFrame({"pattern": [key[0]], "mode": [key[1]], "queries": [queries], "passed": [passed], "failed": [failed]})

    out = "pattern string, mode string, queries long, passed long, failed long"
    typed = events.select(*KEYS, "ts", "outcome")
    return typed.groupBy(*KEYS).applyInPandasWithState(count, out, "queries long, passed long, failed long, newest long", "update", "EventTimeTimeout")


def attached_stream(events: DataFrame, outcomes: DataFrame, days: int = ATTACH_DAYS) -> DataFrame:
    """``events`` with the outcome that comes for their request within ``days``; null is given out once the time is over.

    Both are streams: ``events`` has request_id and ts, ``outcomes`` request_id, ts and outcome. Of several outcomes
    of a request the first to come counts; one for an unknown request is dropped.
    """
    e = events.withWatermark("ts", f"{days} days")
    o = outcomes.withWatermark("ts", f"{days} days").dropDuplicatesWithinWatermark(["request_id"])
    o = o.select(F.col("request_id").alias("_id"), F.col("ts").alias("_ts"), F.col("outcome").alias("outcome"))
    inside = F.col("_ts").between(F.col("ts"), F.col("ts") + F.expr(f"INTERVAL {days} DAYS"))
    return e.join(o, (F.col("request_id") == F.col("_id")) & inside, "left_outer").drop("_id", "_ts")


@registry.add("""WITH e AS (SELECT CAST(ts AS DATE) AS day, strftime(ts, '%H') AS pattern, event_type AS mode, CASE event_type WHEN 'purchase' THEN true WHEN 'error' THEN false END AS outcome FROM events), t AS (SELECT max(day) AS today FROM e)
SELECT pattern, mode, count(*) AS queries, count(*) FILTER (WHERE outcome) AS passed, count(*) FILTER (WHERE NOT outcome) AS failed FROM e, t WHERE day > today - 5 GROUP BY 1, 2""")
def fb_recent_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counters of the last five days, added up from each day's sums as the recorder keeps them."""
    from ..operators.feedback import outcome_of

    e = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), F.date_format("ts", "HH").alias("pattern"), F.col("event_type").alias("mode"), outcome_of(F.col("event_type")).alias("outcome"))
    daily = counters(e, ["day", *KEYS])
    newest = daily.agg(F.max("day").alias("today"))
    some = daily.join(F.broadcast(newest), F.col("day") > F.date_sub("today", 5))  # one row
    return some.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in ("queries", "passed", "failed")])


@registry.add("""SELECT strftime(ts, '%Y-%m-%d') AS pattern, count(*) AS queries FROM events GROUP BY 1 ORDER BY queries DESC, pattern LIMIT 25""")
def fb_top_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dashboard's list of the patterns asked most."""
    e = table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("pattern")).agg(F.count("*").alias("queries"))
    return e.orderBy(F.desc("queries"), "pattern").limit(25)
