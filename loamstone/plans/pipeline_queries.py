"""Questions to answers, chunking and the folds over streams."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamstone.functions import text as T
from loamstone.operators import chunking, layout, lexical, memory, plugins, presentation, vectors
from loamstone.plans.search_queries import LOW_CONTEXT
from loamstone.plans.tables import cut, spread, table
from loamstone.streaming import blocks, breaker


def recursive_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "document_elements").select("element_id", "text").distinct()
    return chunking.chunks(e, "element_id", "text")


def _fed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every answer, word by word."""
    t = table(spark, sf_dir, "chat_turns").select(F.col("turn_id").cast("string").alias("stream"), F.col("ai_response").alias("r")).distinct().where("r is not null")
    return t.select("stream", F.posexplode(F.regexp_extract_all("r", F.lit(r"(\s*\S+\s?|\s+$)"), F.lit(1))).alias("seq", "token"))


def block_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of every answer, fed word by word."""
    return blocks.fold_blocks(_fed(spark, sf_dir))


def answer_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of every answer as it is told: stages, tokens, finished blocks, the whole."""
    return blocks.fold_events(_fed(spark, sf_dir))


def answer_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per answer: its tokens, whether the events end as they should, and its text as the last event gives it."""
    e = answer_events(spark, sf_dir)
    last = F.get_json_object(F.max_by("payload", "seq"), "$.content")
    g = e.groupBy("stream").agg(F.count_if(F.col("kind") == "token").alias("n_tokens"), (F.max_by("kind", "seq") == "final_transformed").alias("complete"), F.md5(F.regexp_replace(last, _BLANK, "")).alias("text_md5"))
    return g.select(F.col("stream").cast("long").alias("turn_id"), "n_tokens", "complete", "text_md5")


_BLANK = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def block_stream_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of every answer's blocks, in order and without blanks: nothing may be lost on the way."""
    b = block_stream(spark, sf_dir).groupBy("stream").agg(F.array_sort(F.collect_list(F.struct("block", "content"))).alias("bs"))
    joined = F.regexp_replace(F.array_join(F.transform("bs", lambda x: x["content"]), ""), _BLANK, "")
    return b.select(F.col("stream").cast("long").alias("turn_id"), F.md5(joined).alias("text_md5"))


def breaker_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A breaker per session over its requests in order."""
    r = table(spark, sf_dir, "requests").where("ts is not null").select(
        F.col("session_id").alias("service"), F.col("request_id").alias("seq"), F.col("ts").cast("timestamp").cast("double").alias("at"), F.col("error").isNull().alias("ok")
    )
    return breaker.fold_breaker(r.where("service is not null"))


def _searched(d: DataFrame, dv: DataFrame, q: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fused hits (query_id, id, rank) of questions (id, t), and per question the best scores and whether they are too low."""
    v = cut(vectors.cosine_topk(dv, q.select("id", plugins.embed(F.col("t")).alias("v")), 10))
    b = cut(lexical.bm25_topk(d, q.select("id", "t"), 5))
    # equal texts are one entry: told by their digest, so that no text is shuffled for it
    hit = v.select("id").unionByName(b.select("id")).distinct()
    digest = cut(d.join(hit, "id", "left_semi").select("id", F.md5("t").alias("text")).distinct())
    fused = cut(lexical.fuse([v.join(digest, "id"), b.join(digest, "id")], [0.5, 0.5], 10))
    best = fused.groupBy("query_id").agg(F.max("score").alias("max_rrf"))
    top = v.groupBy("query_id").agg(F.max("score").alias("top_vector"))
    scores = q.select(F.col("id").alias("query_id")).join(best, "query_id", "left").join(top, "query_id", "left")
    low = (F.coalesce("top_vector", F.lit(0.0)) < 0.25) | (F.coalesce("max_rrf", F.lit(0.0)) < 0.008)
    return fused.select("query_id", "id", "rank"), cut(scores.withColumn("low", low))


def answer_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way of a question, for the turns whose id is divisible by 100.

    Screen and mask; search by vector and by terms and fuse; with too little context rewrite the question and search once more, or
    answer with the error; put the hits' sections and what is remembered into their parts of the window; generate, and correct what isn't
    grounded; validate and present. Vectors and answers are those of the stand-ins of ``plugins``.
    """
    t = table(spark, sf_dir, "chat_turns").select("turn_id", F.col("session_id").alias("session"), "turn", F.col("user_query").alias("query"), F.col("ai_response").alias("response")).distinct()
    known = memory.topics(memory.episodic_summary(memory.working_memory(t))).where("turn_id % 100 = 0 and query is not null")
    q = cut(
        known.select(F.col("turn_id").alias("id"), T.suspicion(F.col("query")).alias("blocked"), T.mask_pii(T.sanitise(F.col("query"))).alias("t"), "memory", "summary", F.col("shift").alias("render_header"))
    )
    d = table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("id"), F.col("text").alias("t"))
    dv = cut(spread(d).select("id", plugins.embed(F.col("t")).alias("v")).dropDuplicates(["id"]))
    asked = q.where("blocked is null").select("id", "t")
    first, scores = _searched(d, dv, asked)
    poor = cut(asked.join(scores.where("low").select(F.col("query_id").alias("id")), "id", "left_semi").select("id", plugins.rewritten(F.col("t")).alias("t")))
    second, again = _searched(d, dv, poor)
    hits = cut(first.join(scores.where("low").select("query_id"), "query_id", "left_anti").unionByName(second.join(again.where("not low").select("query_id"), "query_id", "left_semi")))
    texts = d.join(hits.select("id").distinct(), "id", "left_semi").dropDuplicates(["id"]).withColumnRenamed("id", "doc").withColumnRenamed("t", "text")
    sections = layout.document_sections(texts, "\n")
    context = layout.context(layout.within_budget(hits, sections, T.budget()[0]))
    parts = q.join(context, q["id"] == context["query_id"], "left").select(
        "id", "t", "blocked", "render_header", F.col("context").isNull().alias("low"), T.route(F.col("t")).alias("route"), T.allocate(F.col("context"), F.col("summary"), F.lit(""), F.col("memory")).alias("a")
    )
    rows = parts.select("id", "t", "blocked", "render_header", "low", "route", F.col("a.context").alias("context"), T.token_estimate(T.prompt(F.col("a.context"), F.col("a.memory"), F.col("t"))).alias("prompt_tokens"))
    done = plugins.generate(rows, "t", "context")
    fit = plugins.grounded(F.col("answer"), F.col("context"))
    done = done.withColumn("grounded", fit).withColumn("final", plugins.corrected(F.coalesce("answer", F.lit("")), F.col("context"), fit))
    v = done.withColumn("v", T.validated(F.col("final"))).select("id", "blocked", "low", "route", "grounded", "render_header", F.col("v.valid").alias("valid"), F.col("v.text").alias("t"), "prompt_tokens")
    v = cut(v)
    shown = presentation.present(v.select("id", "t", "render_header"))
    answer = F.when(F.col("blocked").isNotNull(), F.concat(F.lit("[BLOCKED: "), "blocked", F.lit("]"))).when(F.col("low"), F.lit(json.dumps(LOW_CONTEXT))).otherwise(F.col("presented"))
    return v.join(shown, "id").select("id", "route", answer.alias("answer"), "valid", "grounded", "prompt_tokens")


def smart_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut where successive sentences are farthest apart (90th percentile), longer pieces split again."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    s = d.select("doc_id", F.posexplode(F.split("text", r"(?<=[.?!])\s+")).alias("pos", "sentence")).where("sentence <> ''")
    w = Window.partitionBy("doc_id").orderBy("pos")
    near = F.concat_ws(" ", F.lag("sentence").over(w), "sentence", F.lead("sentence").over(w))
    v = s.withColumn("near", near).withColumn("v", plugins.embed(F.col("near"))).drop("near")
    v = v.withColumn("next", F.lead("v").over(w))
    dot = F.aggregate(F.zip_with("v", "next", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    v = v.select("doc_id", "pos", "sentence", (1 - dot).alias("distance"))
    v = v.withColumn("p90", F.expr("percentile(distance, 0.9) over (partition by doc_id)"))
    v = v.withColumn("chunk", F.coalesce(F.sum((F.col("distance") > F.col("p90")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "sentence")))
    pieces = v.groupBy("doc_id", "chunk").agg(F.array_join(F.transform(ordered, lambda x: x["sentence"]), " ").alias("t"))
    named = pieces.select(F.concat_ws(":", "doc_id", "chunk").alias("key"), "t")
    return chunking.chunks(named, "key", "t")


QUERIES = {q.__name__: q for q in (recursive_chunks, block_stream, block_stream_text, answer_events, answer_event_counts, breaker_fold, answer_questions, smart_chunks)}
SQL = {
    "answer_event_counts": f"SELECT DISTINCT turn_id, len(regexp_extract_all(ai_response, '(\\s*\\S+\\s?|\\s+$)', 1)) AS n_tokens, true AS complete, md5(regexp_replace(ai_response, '{_BLANK}', '', 'g')) AS text_md5 FROM chat_turns WHERE ai_response <> ''",
    "block_stream_text": f"SELECT DISTINCT turn_id, md5(regexp_replace(ai_response, '{_BLANK}', '', 'g')) AS text_md5 FROM chat_turns WHERE regexp_replace(ai_response, '{_BLANK}', '', 'g') <> ''",
    "breaker_fold": f"""WITH RECURSIVE r AS (SELECT session_id AS service, request_id AS seq, epoch(ts) AS at_s, error IS NULL AS ok, row_number() OVER (PARTITION BY session_id ORDER BY request_id) AS rn FROM requests WHERE ts IS NOT NULL AND session_id IS NOT NULL),
f AS (
  SELECT DISTINCT service, CAST(0 AS BIGINT) AS rn, 0 AS failures, CAST(0 AS DOUBLE) AS last_s, 'closed' AS state, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS BOOLEAN) AS allowed FROM r
  UNION ALL
  SELECT service, rn, CASE WHEN st = 'open' THEN failures WHEN ok AND st = 'half-open' THEN 0 WHEN ok THEN failures ELSE failures + 1 END, CASE WHEN st = 'open' OR ok THEN last_s ELSE at_s END,
    CASE WHEN st = 'open' THEN 'open' WHEN ok AND st = 'half-open' THEN 'closed' WHEN ok THEN st WHEN failures + 1 >= {breaker.THRESHOLD} THEN 'open' ELSE st END, seq, st <> 'open'
  FROM (SELECT r.*, f.failures, f.last_s, CASE WHEN f.state = 'open' AND r.at_s - f.last_s > {breaker.RECOVERY_S} THEN 'half-open' ELSE f.state END AS st FROM f JOIN r ON r.service = f.service AND r.rn = f.rn + 1)
)
SELECT service, seq, allowed, state FROM f WHERE seq IS NOT NULL""",
}
