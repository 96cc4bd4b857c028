"""Vector, lexical and hybrid search. Queries are the rows whose id is divisible by 100."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamstone.functions import text as T
from loamstone.operators import lexical, memory, plugins, vectors
from loamstone.plans.tables import cut, table
from loamstone.plans.text_queries import quoted


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _vectors(spark, sf_dir)
    return vectors.cosine_topk(e, e.where("id % 100 = 0"), 10)


def filtered_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only rows with the query's label: the filter comes before the ranking."""
    e = _vectors(spark, sf_dir)
    return vectors.cosine_topk(e, e.where("id % 100 = 0"), 10, same="label")


def recall_then_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two nearest of all rows, and of them those with label 0: the filter comes after the ranking, so fewer may be left."""
    e = _vectors(spark, sf_dir)
    return vectors.cosine_topk(e, e.where("id % 100 = 0"), 2).join(e.where("label = 0").select("id"), "id", "left_semi")


def semantic_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per query the most similar stored entry of its session (label), if similar enough."""
    e = _vectors(spark, sf_dir)
    return vectors.cosine_topk(e, e.where("id % 100 = 0"), 1, same="label", min_score=0.2).select("query_id", F.col("id").alias("entry_id"), "score")


def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _vectors(spark, sf_dir)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    most = F.array_max(F.transform("v", lambda x: F.abs(x).cast("double")))
    return e.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(norm), 6).alias("mean_norm"), F.round(F.max(most), 6).alias("largest"))


def semantic_breakpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Successive vectors of a label farther apart than the 90th percentile of its distances."""
    w = Window.partitionBy("label").orderBy("id")
    d = _vectors(spark, sf_dir).withColumn("next", F.lead("v").over(w)).where("next is not null")
    d = d.select("id", "label", F.round(1 - vectors.cosine(F.col("v"), F.col("next")), 6).alias("distance"))
    limit = d.groupBy("label").agg(F.expr("percentile(distance, 0.9)").alias("p90"))
    return d.join(limit, "label").where("distance > p90").select("id", "label", "distance", F.round("p90", 5).alias("p90"))


def pca_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = vectors.project(_vectors(spark, sf_dir))
    return p.select("id", *[F.round(c, 4).alias(c) for c in "xyz"])


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("t"))


def _titles(docs: DataFrame) -> DataFrame:
    return docs.where("id % 100 = 0").select("id", F.substring_index("t", "\n", 1).alias("t"))


def bm25_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir)
    size, idf = lexical.statistics(d)
    return size.select("n", F.round("avgdl", 4).alias("avgdl"), F.round("mean_idf", 6).alias("mean_idf")).join(idf.agg(F.count("*").alias("n_terms"), F.max("df").alias("max_df")))


def _bm25(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    d = _docs(spark, sf_dir)
    return lexical.bm25_topk(d, _titles(d), k)


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bm25(spark, sf_dir, 5)


def _fuse(d: DataFrame, v: DataFrame, b: DataFrame, k: int = 10) -> DataFrame:
    ids = v.select("id").unionByName(b.select("id")).distinct()
    texts = cut(d.join(ids, "id", "left_semi").withColumnRenamed("t", "text"))
    return lexical.fuse([v.join(texts, "id"), b.join(texts, "id")], [0.5, 0.5], k)


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, e = _docs(spark, sf_dir), _vectors(spark, sf_dir)
    v = cut(vectors.cosine_topk(e, e.where("id % 100 = 0"), 10, keep_self=True))
    # only what has a vector is asked for by terms
    asked = _titles(d).join(v.select(F.col("query_id").alias("id")).distinct(), "id", "left_semi")
    return _fuse(d, v, cut(lexical.bm25_topk(d, asked, 5)))


#: Hits a session's search is asked for, before its bounds.
WISHED = 10


def _in_session(e: DataFrame, b: DataFrame) -> DataFrame:
    """Hits (query_id, id, ...) whose document is of the query's session (label)."""
    return b.join(e.select("id", F.col("label").alias("ls")), "id").join(e.select(F.col("id").alias("query_id"), F.col("label").alias("lq")), "query_id").where("ls = lq").drop("ls", "lq")


def _session_lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, vectors with their session, and the vector hits: the session's filter comes before the vector ranking."""
    d, e = _docs(spark, sf_dir), _vectors(spark, sf_dir)
    return d, e, cut(vectors.cosine_topk(e, e.where("id % 100 = 0"), WISHED, same="label", keep_self=True))


def session_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid search within a session: vectors are filtered before their ranking, the best five by terms after theirs."""
    d, e, v = _session_lists(spark, sf_dir)
    asked = _titles(d).join(v.select(F.col("query_id").alias("id")).distinct(), "id", "left_semi")
    b = cut(_in_session(e, lexical.bm25_topk(d, asked, 5)))
    fused = _fuse(d, v, b, 15).where(F.col("rank") <= T.clamp_k(F.lit(WISHED)))
    return fused.select("query_id", "id", "score", "rank")


# What is answered where there is too little context.
LOW_CONTEXT = {
    "error": "LowContextError",
    "message": "I don't have enough context to answer accurately.",
    "actions": [
        {"label": "Search the web instead?", "action": "web_search"},
        {"label": "Escalate to human support?", "action": "escalate"},
        {"label": "Did you mean to ask a different question?", "action": "suggest"},
    ],
}


def low_context_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per query: after which search there was context enough (first, rewritten), or none and the error that is answered.

    A query with too little context is rewritten and searched once more; its vector stays, as the tables have no model for a new one.
    """
    d, e, v = _session_lists(spark, sf_dir)
    near = cut(vectors.cosine_topk(e, e.where("id % 100 = 0"), 1, same="label").select("query_id", F.col("score").alias("top_vector")))
    titles = _titles(d).join(v.select(F.col("query_id").alias("id")).distinct(), "id", "left_semi")

    def searched(queries: DataFrame) -> DataFrame:
        of = queries.select(F.col("id").alias("query_id"))
        b = cut(_in_session(e, lexical.bm25_topk(d, queries, 5)))
        best = _fuse(d, v.join(of, "query_id", "left_semi"), b).groupBy("query_id").agg(F.max("score").alias("max_rrf"))
        low = (F.coalesce("top_vector", F.lit(0.0)) < 0.25) | (F.coalesce("max_rrf", F.lit(0.0)) < 0.017)
        return cut(of.join(best, "query_id", "left").join(near, "query_id", "left").select("query_id", "max_rrf", "top_vector", low.alias("low")))

    first = searched(titles)
    poor = titles.join(first.where("low").select(F.col("query_id").alias("id")), "id", "left_semi")
    second = searched(cut(poor.select("id", plugins.rewritten(F.col("t")).alias("t"))))
    rows = first.where("not low").withColumn("stage", F.lit("first")).unionByName(second.withColumn("stage", F.when(F.col("low"), "none").otherwise("rewritten")))
    return rows.select("query_id", "stage", "max_rrf", "top_vector", F.when(F.col("low"), F.lit(json.dumps(LOW_CONTEXT))).alias("error"))


#: Similarity asked of a stored question in ``cache_exact_then_semantic``: the vectors of the tables are at random, so the usual 0.95 would find none.
ALIKE = 0.3


def cache_exact_then_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored answers for questions (titles) of a session (label): the same question first, failing that the most similar."""
    d, e = _docs(spark, sf_dir), _vectors(spark, sf_dir)
    entries = cut(e.join(d.select("id", F.substring_index("t", "\n", 1).alias("query")), "id").select("id", F.col("label").alias("session"), "query", "v"))
    return memory.cache_lookup(entries.where("id % 100 = 0"), entries, ALIKE)


def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid retrieval: nearest ten by vector and best five by terms, fused by rank."""
    return _fused(spark, sf_dir).select("query_id", "id", "score", "rank")


def low_context_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per query: best fused score, best vector score, and whether there is too little context."""
    e = _vectors(spark, sf_dir)
    v = vectors.cosine_topk(e, e.where("id % 100 = 0"), 1).select("query_id", F.col("score").alias("top_vector"))
    f = _fused(spark, sf_dir).groupBy("query_id").agg(F.max("score").alias("max_rrf"))
    low = (F.coalesce("top_vector", F.lit(0.0)) < 0.25) | (F.col("max_rrf") < 0.008)
    return f.join(v, "query_id", "left").select("query_id", "max_rrf", "top_vector", low.alias("low_context"))


QUERIES = {q.__name__: q for q in (session_hybrid, low_context_answers, cache_exact_then_semantic, cosine_topk, filtered_cosine_topk, recall_then_filter, semantic_cache, vector_norms, semantic_breakpoints, pca_projection, bm25_statistics, bm25_topk, rrf_fusion, low_context_gate)}

_E = "e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)"


def _top(k: int, on: str = "true", self_too: bool = False) -> str:
    return f"""SELECT * FROM (SELECT q.id AS query_id, r.id AS id, round(list_cosine_similarity(r.v, q.v), 6) AS score, row_number() OVER (PARTITION BY q.id ORDER BY round(list_cosine_similarity(r.v, q.v), 6) DESC, r.id) AS rank
 FROM e q JOIN e r ON {on} {'' if self_too else 'AND r.id <> q.id'} WHERE q.id % 100 = 0) WHERE rank <= {k}"""


def _bm(k: int) -> str:
    return f"""d AS (SELECT doc_id AS id, text AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\s\\x0b]+'), lambda x: x <> '') AS w FROM documents),
size AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM d),
post AS (SELECT id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT id, len(w) AS dl, unnest(w) AS term FROM d) GROUP BY id, term),
raw AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT term, count(*) AS df FROM post GROUP BY term), size),
mean AS (SELECT avg(raw) AS mean_idf FROM raw),
idf AS (SELECT term, df, CASE WHEN raw < 0 THEN {lexical.EPSILON} * mean_idf ELSE raw END AS idf FROM raw, mean),
q AS (SELECT id AS query_id, term, count(*) AS qtf FROM (SELECT id, unnest(list_filter(regexp_split_to_array(split_part(t, chr(10), 1), '[\\s\\x0b]+'), lambda x: x <> '')) AS term FROM d WHERE id % 100 = 0) GROUP BY ALL),
scored AS (SELECT query_id, id, round(sum(qtf * idf * tf * {lexical.K1 + 1} / (tf + {lexical.K1} * (1 - {lexical.B} + {lexical.B} * dl / avgdl))), 6) AS score FROM post JOIN q USING (term) JOIN idf USING (term), size GROUP BY query_id, id),
bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored) WHERE rank <= {k})"""


_FUSED = f"""WITH {_E}, {_bm(5)}, v AS ({_top(10, 'true', True)}),
lists AS (SELECT query_id, id, rank, rank AS pos FROM v UNION ALL SELECT query_id, id, rank, 1000000 + rank FROM bm WHERE query_id IN (SELECT query_id FROM v)),
fused AS (SELECT query_id, text, round(sum(0.5 / (60 + rank)), 9) AS score, min(id) AS id, min(pos) AS pos FROM lists JOIN documents ON doc_id = id GROUP BY query_id, text),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos, id) AS rank FROM fused) WHERE rank <= 10)"""

def _session_sql(title: str, k: int) -> str:
    """The session's fused list for questions that are ``title`` of a document's first line."""
    bm = _bm(5).replace("split_part(t, chr(10), 1)", title)
    return f"""WITH {_E}, {bm}, v AS ({_top(WISHED, 'r.label = q.label', True)}),
bs AS (SELECT bm.* FROM bm JOIN e a ON a.id = bm.id JOIN e b ON b.id = bm.query_id WHERE a.label = b.label),
lists AS (SELECT query_id, id, rank, rank AS pos FROM v UNION ALL SELECT query_id, id, rank, 1000000 + rank FROM bs),
fused AS (SELECT query_id, text, round(sum(0.5 / (60 + rank)), 9) AS score, min(id) AS id, min(pos) AS pos FROM lists JOIN documents ON doc_id = id GROUP BY query_id, text),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos, id) AS rank FROM fused) WHERE rank <= {k})"""


_PLAIN = r"trim(regexp_replace(regexp_replace(lower(split_part(t, chr(10), 1)), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"
_ASKED = "a AS (SELECT doc_id AS query_id FROM documents JOIN embeddings ON vec_id = doc_id WHERE doc_id % 100 = 0)"
_LOW = "coalesce(top_vector, 0) < 0.25 OR coalesce(max_rrf, 0) < 0.017"


def _low_sql() -> str:
    best = "SELECT query_id, max(score) AS max_rrf FROM ({}) GROUP BY query_id"
    return f"""WITH {_E}, {_ASKED}, t AS (SELECT query_id, score AS top_vector FROM ({_top(1, 'r.label = q.label')})),
one AS ({best.format(_session_sql('split_part(t, chr(10), 1)', 10) + ' SELECT * FROM f')}), two AS ({best.format(_session_sql(_PLAIN, 10) + ' SELECT * FROM f')}),
x AS (SELECT a.query_id, one.max_rrf AS m1, two.max_rrf AS m2, top_vector, {_LOW.replace('max_rrf', 'one.max_rrf')} AS low1, {_LOW.replace('max_rrf', 'two.max_rrf')} AS low2 FROM a LEFT JOIN one USING (query_id) LEFT JOIN two USING (query_id) LEFT JOIN t USING (query_id))
SELECT query_id, CASE WHEN NOT low1 THEN 'first' WHEN low2 THEN 'none' ELSE 'rewritten' END AS stage, CASE WHEN low1 THEN m2 ELSE m1 END AS max_rrf, top_vector, CASE WHEN low1 AND low2 THEN {quoted(json.dumps(LOW_CONTEXT))} END AS error FROM x"""


SQL = {
    "session_hybrid": _session_sql("split_part(t, chr(10), 1)", 10) + " SELECT query_id, id, score, rank FROM f",
    "low_context_answers": _low_sql(),
    "cache_exact_then_semantic": f"""WITH {_E}, n AS (SELECT e.id, label, v, split_part(text, chr(10), 1) AS q FROM e JOIN documents ON doc_id = e.id),
x AS (SELECT a.id, max(b.id) AS source_id, 'exact' AS how, 1.0::DOUBLE AS score FROM n a JOIN n b ON a.label = b.label AND a.q = b.q AND a.id <> b.id WHERE a.id % 100 = 0 GROUP BY a.id),
s AS (SELECT * FROM (SELECT a.id, b.id AS source_id, 'semantic' AS how, round(list_cosine_similarity(b.v, a.v), 6) AS score FROM n a JOIN n b ON a.label = b.label AND a.id <> b.id WHERE a.id % 100 = 0 AND a.id NOT IN (SELECT id FROM x)) WHERE score >= {ALIKE} QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, source_id) = 1)
SELECT * FROM x UNION ALL SELECT * FROM s""",
    "cosine_topk": f"WITH {_E} {_top(10)}",
    "filtered_cosine_topk": f"WITH {_E} {_top(10, 'r.label = q.label')}",
    "recall_then_filter": f"WITH {_E} SELECT * FROM ({_top(2)}) WHERE id IN (SELECT id FROM e WHERE label = 0)",
    "semantic_cache": f"WITH {_E} SELECT query_id, id AS entry_id, score FROM ({_top(1, 'r.label = q.label AND round(list_cosine_similarity(r.v, q.v), 6) >= 0.2')})",
    "vector_norms": f"WITH {_E} SELECT label, count(*) AS n, round(avg(sqrt(list_inner_product(v, v))), 6) AS mean_norm, round(max(list_max(list_transform(v, lambda x: abs(x)))), 6) AS largest FROM e GROUP BY label",
    "semantic_breakpoints": f"""WITH {_E}, d AS (SELECT id, label, round(1 - list_cosine_similarity(v, nxt), 6) AS distance FROM (SELECT *, lead(v) OVER (PARTITION BY label ORDER BY id) AS nxt FROM e) WHERE nxt IS NOT NULL),
p AS (SELECT label, quantile_cont(distance, 0.9) AS p90 FROM d GROUP BY label) SELECT id, d.label, distance, round(p90, 5) AS p90 FROM d JOIN p USING (label) WHERE distance > p90""",
    "bm25_statistics": f"WITH {_bm(5)} SELECT n, round(avgdl, 4) AS avgdl, round(mean_idf, 6) AS mean_idf, (SELECT count(*) FROM idf) AS n_terms, (SELECT max(df) FROM idf) AS max_df FROM size, mean",
    "bm25_topk": f"WITH {_bm(5)} SELECT query_id, id, score, rank FROM bm",
    "rrf_fusion": _FUSED + " SELECT query_id, id, score, rank FROM f",
    "low_context_gate": _FUSED + f", t AS ({_top(1)}) SELECT f.query_id, max_rrf, t.score AS top_vector, coalesce(t.score, 0) < 0.25 OR max_rrf < 0.008 AS low_context FROM (SELECT query_id, max(score) AS max_rrf FROM f GROUP BY query_id) f LEFT JOIN t USING (query_id)",
}
