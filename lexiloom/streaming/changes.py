"""Sync as a stream: change events keep each source's last fingerprint, and micro-batches bring the stored chunks up to date."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.library import first_of_each
from ..operators.sync import Snapshots


def latest_changes(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """(key, window, changes, last_fp) per day: late events within the delay still count, state older than that is dropped."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", delay)
    return timed.groupBy(F.window("at", "1 day"), "key").agg(F.count(F.lit(1)).alias("changes"), F.max_by("fp", "at").alias("last_fp"))


def follow(sources: DataFrame, store: Snapshots, build: Callable[[DataFrame], DataFrame], checkpoint: str, order: str = "ts", available_now: bool = True) -> StreamingQuery:
    """Write each micro-batch's sources (source_id, ..., and a column that orders them) as chunks, whole sources at a time.

    Of a source that a batch has more than once the latest by order counts. Only the touched buckets are rewritten; a batch that
    is run again replaces itself.
    """

    def batch(rows: DataFrame, _: int) -> None:
        latest = first_of_each(rows, ["source_id"], [F.desc(order), F.xxhash64(*rows.columns)])
        store.commit({"chunks": (build(latest), latest.select("source_id"), None)})

    writer = sources.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
