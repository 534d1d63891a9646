"""Windows over event streams, each usable on a batch table and on a stream.

A stream gets a watermark first; late rows beyond it are left out by Spark, and
a window comes out once the watermark has passed its end.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timed(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Events with ``ts`` as a timestamp, watermarked where they are a stream."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.withWatermark("ts", delay) if rows.isStreaming else rows


def _flat(df: DataFrame) -> DataFrame:
    return df.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *[c for c in df.columns if c != "w"])


def tumbling(events: DataFrame, size: str = "1 day") -> DataFrame:
    grouped = timed(events).groupBy(F.window("ts", size).alias("w"), "event_type")
    return _flat(grouped.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")))


def sliding(events: DataFrame, size: str = "2 days", step: str = "1 day") -> DataFrame:
    grouped = timed(events).groupBy(F.window("ts", size, step).alias("w"), "event_type")
    return _flat(grouped.agg(F.count("*").alias("n"), F.max("value").alias("highest")))


def sessions(events: DataFrame, gap: str = "12 hours") -> DataFrame:
    grouped = timed(events).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return _flat(grouped.agg(F.count("*").alias("n")))


def first_sightings(events: DataFrame) -> DataFrame:
    """One row per event_id however often it is delivered within the watermark."""
    rows = timed(events)
    return rows.dropDuplicatesWithinWatermark(["event_id"]) if rows.isStreaming else rows.dropDuplicates(["event_id"])


def red_latch(batches: DataFrame, needed: int = 3) -> DataFrame:
    """Stream of (key, alert, level) rows to (key, reds, latched): latched once ``needed`` reds came in a row.

    The state per key is two numbers, so that it does not grow with the stream.
    """

    def step(key, frames, state):
        reds, latched = state.get if state.exists else (0, False)
        for frame in frames:
            for level in frame.sort_values("batch_no").level:
                reds = reds + 1 if level == "RED" else 0
                latched = bool(latched or reds >= needed)
        state.update((reds, latched))
        yield pd.DataFrame({"key": [key[0]], "reds": [reds], "latched": [latched]})

    return batches.groupBy("key").applyInPandasWithState(step, "key string, reds int, latched boolean", "reds int, latched boolean", "update", "NoTimeout")
