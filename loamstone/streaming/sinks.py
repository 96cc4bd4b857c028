"""Incremental append, daily counts and event output of streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def append_chunks(chunks: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends new chunks to a store partitioned by session, each batch once: a batch's files are replaced if it runs again."""

    def put(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session_id", "epoch").parquet(path)

    return chunks.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_counts(events: DataFrame, ts: str, key: str, late: str = "1 day") -> DataFrame:
    """Events per key and day of a stream, with late ones up to ``late``."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, "1 day").alias("day"), key).agg(F.count("*").alias("n"))


def live_entries(entries: DataFrame, ts: str, ttl: str) -> DataFrame:
    """Cache entries of a stream, each key once within its time to live."""
    return entries.withWatermark(ts, ttl).dropDuplicatesWithinWatermark(["session_id", "query"])


def event_lines(events: DataFrame) -> DataFrame:
    """Lines of an event stream (kind, payload) with the payload as JSON, so that no payload breaks the framing."""
    return events.select(F.concat(F.lit("data: "), "kind", F.lit(": "), F.to_json(F.struct("payload")), F.lit("\n\n")).alias("line"))
