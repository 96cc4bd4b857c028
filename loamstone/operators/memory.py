"""Conversation state as windows over turns (session, turn, query, response)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamstone.functions.text import is_continuation, strip, topic

CAPACITY, BULLETS = 5, 6


def working_memory(turns: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """What is remembered before each turn: the last ``capacity`` exchanges of its session."""
    w = Window.partitionBy("session").orderBy("turn").rowsBetween(-capacity, -1)
    said = F.concat(F.lit("User: "), F.coalesce("query", F.lit("")), F.lit("\nAssistant: "), F.coalesce("response", F.lit("")))
    return turns.withColumn("memory", F.array_join(F.collect_list(said).over(w), "\n\n"))


def episodic_summary(turns: DataFrame, bullets: int = BULLETS) -> DataFrame:
    """The last few topics discussed before each turn; a blank question adds none."""
    asked = turns.withColumn("q", strip(F.coalesce("query", F.lit(""))))
    cut = F.when(F.length("q") > 80, F.concat(F.lit("Discussed: '"), F.substring("q", 1, 80), F.lit("...'"))).otherwise(F.concat(F.lit("Discussed: '"), "q", F.lit("'")))
    # a bounded frame: a session may be as long as a table
    w = Window.partitionBy("session").orderBy("turn").rowsBetween(-bullets, -1)
    return asked.withColumn("summary", F.array_join(F.collect_list(F.when(F.col("q") != "", cut)).over(w), " | ")).drop("q")


def topics(turns: DataFrame) -> DataFrame:
    """Active topic of each turn and whether it is a shift: a follow-up keeps the topic, anything else sets it."""
    w = Window.partitionBy("session").orderBy("turn")
    q = F.coalesce("query", F.lit(""))
    t = turns.withColumn("continuation", is_continuation(q)).withColumn("detected", topic(q)).withColumn("first", F.row_number().over(w) == 1)
    t = t.withColumn("active", F.last(F.when(~F.col("continuation") | F.col("first"), F.col("detected")), True).over(w))
    before = F.lag("active").over(w)
    return t.withColumn("shift", before.isNull() | (before != F.col("active"))).drop("detected", "first")


def recent(turns: DataFrame, limit: int) -> DataFrame:
    """The last ``limit`` turns of every session."""
    w = Window.partitionBy("session").orderBy(F.col("turn").desc())
    return turns.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= limit).drop("rn")


def cache_hits(requests: DataFrame, ttl_s: int) -> DataFrame:
    """Per request (session, query, ts, id) the answer's source: the last equal question of its session within the time to live."""
    w = Window.partitionBy("session", "query").orderBy("ts", "id")
    b = requests.withColumn("source", F.lag("id").over(w)).withColumn("at", F.lag("ts").over(w))
    fresh = F.col("ts").cast("timestamp").cast("double") - F.col("at").cast("timestamp").cast("double") <= ttl_s
    return b.withColumn("source", F.when(fresh, F.col("source"))).drop("at")


def cache_lookup(requests: DataFrame, entries: DataFrame, threshold: float = 0.95) -> DataFrame:
    """(id, source_id, how, score) of requests (id, session, query, v) found among entries of the same form.

    An entry of the session with the same question comes first (the one with the greatest id); failing that the most similar of
    the session's, if it reaches ``threshold``. A request isn't its own source. Requests found nowhere are left out.
    """
    from loamstone.operators import vectors
    from loamstone.plans.tables import cut

    e = entries.where("session is not null")
    last = e.select(F.col("id").alias("source_id"), "session", "query")
    exact = cut(requests.join(last, ["session", "query"]).where("source_id <> id").groupBy("id").agg(F.max("source_id").alias("source_id")).select("id", "source_id", F.lit("exact").alias("how"), F.lit(1.0).alias("score")))
    left = requests.join(exact.select("id"), "id", "left_anti")
    near = vectors.cosine_topk(e.select("id", "v", "session"), left.select("id", "v", "session"), 1, same="session", min_score=threshold)
    return exact.unionByName(near.select(F.col("query_id").alias("id"), F.col("id").alias("source_id"), F.lit("semantic").alias("how"), "score"))


def numbered(turns: DataFrame) -> DataFrame:
    """Turns (session, turn, ts) with their index in the session (from 0), a UTC stamp, and the milliseconds since the turn before."""
    w = Window.partitionBy("session").orderBy("turn")
    ms = lambda c: F.unix_millis(c.cast("timestamp"))
    return turns.withColumn("turn_index", F.row_number().over(w) - 1).withColumn("stamp", F.date_format(F.col("ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'")).withColumn("since_ms", ms(F.col("ts")) - ms(F.lag("ts").over(w)))


def rank_in_day(events: DataFrame, key: str, ts: str, order: Column) -> DataFrame:
    """Place of each event among its key's of the same day."""
    w = Window.partitionBy(key, F.to_date(ts)).orderBy(ts, order)
    return events.withColumn("day_rank", F.row_number().over(w))


def request_metrics(requests: DataFrame, by: list[str]) -> DataFrame:
    """Counts, rates, latency and tokens of requests (latency_ms, cache_hit, input_tokens, output_tokens, blocked, error)."""
    n = F.count("*")
    failed = F.count_if(F.col("error").isNotNull() | F.coalesce("blocked", F.lit(False)))
    hits = F.count_if(F.coalesce("cache_hit", F.lit(False)) & ~F.coalesce("blocked", F.lit(False)))
    return requests.groupBy(*by).agg(
        n.alias("requests"), failed.alias("errors"), F.round(failed / F.greatest(n, F.lit(1)), 6).alias("error_rate"), F.round(F.coalesce(F.avg("latency_ms"), F.lit(0.0)), 4).alias("avg_latency_ms"), F.round(hits / F.greatest(n, F.lit(1)), 6).alias("hit_rate"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"), F.count_if(F.coalesce("blocked", F.lit(False))).alias("blocks"),
    )
