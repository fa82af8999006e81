"""Streams of events and of listed files: turns of sessions, windowed counts, sync."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strandwork.operators.guard import reminder
from strandwork.operators.lifecycle import sync_status


def turns(events: DataFrame) -> DataFrame:
    """(session, turn) of each event of a stream (session string): the number of the event in its session, kept as state."""

    def count(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState):
        (n,) = state.get if state.exists else (0,)
        for pdf in batches:
            yield pd.DataFrame({"session": key[0], "turn": range(n + 1, n + 1 + len(pdf))})
            n += len(pdf)
        state.update((n,))

    return events.groupBy("session").applyInPandasWithState(count, "session string, turn int", "n int", "append", GroupStateTimeout.NoTimeout)


def reminders(events: DataFrame) -> DataFrame:
    """Turns of a stream that call for a reminder."""
    return turns(events).withColumn("reminder", reminder(F.col("turn"))).where("reminder IS NOT NULL")


def activity(events: DataFrame, window: str = "1 hour", late: str = "10 minutes", ts: str = "ts", kind: str = "event_type") -> DataFrame:
    """Events by window and kind; rows later than the watermark are dropped by the stream."""
    counted = events.withWatermark(ts, late).groupBy(F.window(ts, window), kind).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), kind, "n")


def sync_stream(listing: DataFrame, index_path: str, out_path: str, checkpoint: str):
    """Compare each batch of a listing stream (source, mtime) with the index table and append what is new or modified."""

    def batch(df: DataFrame, _: int) -> None:
        status = sync_status(df, df.sparkSession.read.parquet(index_path))
        status.where("status IN ('new', 'modified')").write.mode("append").parquet(out_path)

    return listing.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
