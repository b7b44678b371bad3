"""Streams of records: quiet sessions, once-only signals, and running upserts.

All take a streaming DataFrame with an event time ``at`` and keep bounded
state: a watermark drops what is older than ``late``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def quiet_sessions(records: DataFrame, quiet: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(session_id, began, ended, n): stretches of a session that an hour without records ended."""
    windows = records.withWatermark("at", late).groupBy(F.session_window("at", quiet).alias("w"), "session_id").agg(F.count("*").alias("n"), F.max("at").alias("ended"))
    return windows.select("session_id", F.col("w.start").alias("began"), "ended", "n")


def first_signals(signals: DataFrame, within: str = "120 seconds") -> DataFrame:
    """The first signal of each session within ``within``; later ones are repeats."""
    return signals.withWatermark("at", within).dropDuplicatesWithinWatermark(["session_id"])


def activity(records: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """(began, event_type, n, total): records by window and type."""
    windows = records.withWatermark("at", late).groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return windows.select(F.col("w.start").alias("began"), "event_type", "n", "total")


def upsert_each_batch(target: str, key: str, newest: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that keeps the newest row of each ``key`` under ``target``/state-N.

    Each batch writes a folder named by its number from the one before, so a
    batch that is run again after a failure writes the same state again.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch
        if number > 0:
            rows = spark.read.schema(batch.schema).parquet(f"{target}/state-{number - 1}").unionByName(batch)
        order = F.struct(newest, *[F.xxhash64(*batch.columns)])
        last = rows.groupBy(key).agg(F.max(order).alias("__last"))
        rows.join(last, key).where(order == F.col("__last")).drop("__last").dropDuplicates([key]).write.mode("overwrite").parquet(f"{target}/state-{number}")

    return run
