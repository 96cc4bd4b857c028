"""Chunk store, answer cache and telemetry as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Adds chunks to a store partitioned by session, so that one session's search reads its own files."""
    chunks.write.mode("append").partitionBy("session_id").parquet(path)


def read_chunks(spark: SparkSession, path: str, session: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if session is None else df.where(F.col("session_id") == session)


def live(cache: DataFrame, now: str, ttl_s: int = 86400) -> DataFrame:
    """Entries (session_id, query, response, created_at) that haven't expired at ``now``."""
    age = F.to_timestamp(F.lit(now)).cast("double") - F.col("created_at").cast("timestamp").cast("double")
    return cache.where((age >= 0) & (age < ttl_s))


def put(cache: DataFrame, entries: DataFrame) -> DataFrame:
    """The cache with new entries in place of old ones of the same session and query."""
    return cache.join(entries.select("session_id", "query"), ["session_id", "query"], "left_anti").unionByName(entries)


def clear(cache: DataFrame, session: str) -> DataFrame:
    return cache.where(F.col("session_id") != session)


def telemetry(df: DataFrame, path: str) -> None:
    """Rows as JSON lines."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("append").text(path)
