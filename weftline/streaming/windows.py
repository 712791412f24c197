"""Event-time windows and stateful counters; the same expressions serve batch and Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.registry import Registry
from ..sources.tables import table

registry = Registry()
#: How late an event may come.
LATE = "2 hours"
#: Milliseconds of event time for which a user's last value is held.
STATE_MS = 7 * 24 * 3600 * 1000


def events_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Parquet files of events as a stream; a watermark needs a timestamp with time zone."""
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATE)


def tumbling(events: DataFrame, length: str = "1 hour") -> DataFrame:
    return _flat(events.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")))


def sliding(events: DataFrame, length: str = "2 hours", step: str = "1 hour") -> DataFrame:
    return _flat(events.groupBy(F.window("ts", length, step).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")))


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    return _flat(events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")))


def _flat(df: DataFrame) -> DataFrame:
    rest = [c for c in df.columns if c != "w"]
    return df.select(F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"), *rest)


def running_counters(events: DataFrame) -> DataFrame:
    """Counters by user and event type for update mode; state is one row a key."""
    return events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.max("ts").alias("last_ts"))


def last_values(events: DataFrame) -> DataFrame:
    """The newest event of each user; a user's state goes seven days of event time after it.

    The timeout follows the watermark: one by processing time would keep a stream that ends
    with its input (``availableNow``) planning batches for ever.
    """

    def newest(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        best = state.get if state.exists else (0, "")
        for pdf in batches:
            for micros, kind in zip((pdf["ts"].astype("int64") // 1000).tolist(), pdf["event_type"].tolist(), strict=True):
                best = max(best, (micros, kind))
        state.update(best)
        state.setTimeoutTimestamp(max(best[0] // 1000, state.getCurrentWatermarkMs()) + STATE_MS)
        yield pd.DataFrame({"user_id": [key[0]], "last_ts": pd.to_datetime([best[0]], unit="us"), "event_type": [best[1]]})

    typed = events.select("user_id", "ts", "event_type")
    return typed.groupBy("user_id").applyInPandasWithState(
        newest, "user_id long, last_ts timestamp, event_type string", "micros long, event_type string", "update", "EventTimeTimeout"
    )


def _batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


_HOUR = "time_bucket(INTERVAL 1 HOUR, ts)"


@registry.add(f"SELECT {_HOUR} AS start, {_HOUR} + INTERVAL 1 HOUR AS \"end\", event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2, 3")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tumbling(_batch(spark, sf_dir))


@registry.add(f"""SELECT s AS start, s + INTERVAL 2 HOUR AS "end", event_type, count(*) AS n, round(sum(value), 2) AS total
FROM (SELECT unnest([{_HOUR}, {_HOUR} - INTERVAL 1 HOUR]) AS s, event_type, value FROM events) GROUP BY 1, 2, 3""")
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sliding(_batch(spark, sf_dir))


@registry.add("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", user_id, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(_batch(spark, sf_dir))
