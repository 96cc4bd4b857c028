"""Queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamstone.llm import encoding, leakage, near_duplicates, packing, pairs, personal, scans, shared_spans, splitting
from loamstone.plans.tables import cut, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.broken_pairs(table(spark, sf_dir, "chat_turns"), "turn_id", "user_query", "ai_response")


def _similar(spark: SparkSession, sf_dir: str) -> near_duplicates.Similar:
    return near_duplicates.Similar(table(spark, sf_dir, "document_elements"), "element_id", "text", n=3, similarity=0.7, least_words=25)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _similar(spark, sf_dir).pairs().select(F.col("a").alias("element_id_a"), F.col("b").alias("element_id_b"))


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per element in a group of near duplicates: the group and its number of links."""
    return _similar(spark, sf_dir).groups().withColumnRenamed("doc", "element_id")


def _personal_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    chat = personal.long_form(table(spark, sf_dir, "chat_turns"), "turn_id", ["user_query", "ai_response"])
    elements = personal.long_form(table(spark, sf_dir, "document_elements"), "element_id", ["text"])
    return chat.unionByName(elements)


def _named(df: DataFrame) -> DataFrame:
    kind = F.when(F.col("field") == "text", "document_elements").otherwise("chat_turns").alias("record_table")
    return df.select(kind, F.col("k").alias("record_id"), F.col("field").alias("field_name"), *[c for c in df.columns if c not in ("k", "field")])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(personal.personal_types(_personal_rows(spark, sf_dir)))


def p3_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text that holds personal information, with typed placeholders in its place."""
    return _named(personal.masked(_personal_rows(spark, sf_dir)))


def p5_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per affected element: the text restored as far as it can be, and whether that is all of it."""
    return encoding.repair_encoding(table(spark, sf_dir, "document_elements"), "element_id", "text")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_restored(spark, sf_dir).select("element_id")


def p6_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per element whose text changes: the kinds of noise, and its text as continuous paragraphs."""
    return scans.repair_scans(table(spark, sf_dir, "document_elements"), "element_id", "text", "element_type")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_repaired(spark, sf_dir).select("element_id", F.explode("noise").alias("noise"))


def p7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.pieces(table(spark, sf_dir, "document_elements"), "element_id", "text", F.col("provenance.page"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_pieces(spark, sf_dir).where("piece_no = 0").select("element_id", "page")


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the containers are filled."""
    return packing.container_report(p8_containers(spark, sf_dir))


def p8_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents placed, containers that hold too much, and pieces that lie over another or beyond the end."""
    packed = cut(p8_containers(spark, sf_dir))
    p = packed.where("container_id is not null and n_tokens > 0")
    next_at = F.lead("position").over(Window.partitionBy("container_id").orderBy("position"))
    wrong = F.col("position") + F.col("n_tokens") > F.coalesce(next_at, F.lit(packing.CAPACITY))
    docs = packed.agg(F.countDistinct("doc_id").alias("docs"))
    full = p.groupBy("container_id").agg(F.sum("n_tokens").alias("used")).agg(F.count_if(F.col("used") > packing.CAPACITY).alias("overfull"))
    return docs.join(full).join(p.withColumn("wrong", wrong).agg(F.count_if("wrong").alias("misplaced")))


def p7_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per element that is cut: its length, whether its pieces keep to the limit and the overlap, and give its text again."""
    p = p7_pieces(spark, sf_dir)
    ordered = F.array_sort(F.collect_list(F.struct("piece_no", "start", "stop", "text")))
    g = p.groupBy("element_id").agg(ordered.alias("ps"))
    fits = F.forall("ps", lambda x: (F.length(x["text"]) <= splitting.LIMIT) & (F.length(x["text"]) == x["stop"] - x["start"]))
    joined = F.aggregate("ps", F.struct(F.lit("").alias("t"), F.lit(True).alias("ok")), lambda a, x: F.struct(
        F.concat(a["t"], F.substring(x["text"], F.length(a["t"]) - x["start"] + 1, F.lit(2**30))).alias("t"),
        (a["ok"] & (F.length(a["t"]) - x["start"]).between(0, splitting.OVERLAP)).alias("ok"),
    ))
    r = g.select("element_id", fits.alias("fits"), joined.alias("j"))
    return r.select("element_id", F.length("j.t").cast("long").alias("chars"), F.md5("j.t").alias("text_md5"), (F.col("fits") & F.col("j.ok")).alias("sound"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_leaks(spark, sf_dir).select("doc_id", "item_id")


def p9_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document and leaked item: the item's words found in runs, their share of the item, its question and its answer, and where they begin."""
    found = leakage.leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text")
    return found.withColumnsRenamed({"doc": "doc_id", "item": "item_id"})


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans.shared_pairs(table(spark, sf_dir, "documents"), "doc_id", "text").select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"))


def p10_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans, and the documents that hold each, with its place in them."""
    return shared_spans.shared_spans(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("doc", "doc_id")


def p10_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the portion of it that others hold."""
    return shared_spans.shared_portion(table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES = {q.__name__: q for q in (p1_found, p2_found, p2_groups, p3_found, p3_masked, p5_found, p5_restored, p6_found, p6_repaired, p7_found, p7_pieces, p7_checks, p8_containers, p8_report, p8_checks, p9_found, p9_leaks, p10_found, p10_spans, p10_shared)}

SQL = {
    "p2_found": r"""WITH t AS (SELECT DISTINCT element_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM document_elements),
s AS (SELECT DISTINCT element_id, hash(w[i], w[i+1], w[i+2]) AS g FROM (SELECT element_id, w, unnest(range(1, len(w) - 1)) AS i FROM t WHERE len(w) >= 25)),
n AS (SELECT element_id, count(*) AS n FROM s GROUP BY element_id),
f AS (SELECT g, count(*) AS df FROM s GROUP BY g),
p AS (SELECT element_id, g FROM s JOIN f USING (g) JOIN n USING (element_id) QUALIFY row_number() OVER (PARTITION BY element_id ORDER BY df, g) <= n - ceil(0.7 * n) + 1),
c AS (SELECT DISTINCT a.element_id AS a, b.element_id AS b FROM p a JOIN p b USING (g) JOIN n x ON x.element_id = a.element_id JOIN n y ON y.element_id = b.element_id WHERE a.element_id < b.element_id AND least(x.n, y.n) >= 0.7 * greatest(x.n, y.n)),
o AS (SELECT c.a, c.b, count(*) AS common FROM c JOIN s x ON x.element_id = c.a JOIN s y ON y.element_id = c.b AND y.g = x.g GROUP BY ALL)
SELECT a AS element_id_a, b AS element_id_b FROM o JOIN n x ON x.element_id = a JOIN n y ON y.element_id = b WHERE common >= 0.7 * (x.n + y.n - common) - 1e-9""",
    "p7_found": "SELECT DISTINCT element_id, provenance.page AS page FROM document_elements WHERE length(text) > 2000",
    "p7_checks": "SELECT DISTINCT element_id, length(text) AS chars, md5(text) AS text_md5, true AS sound FROM document_elements WHERE length(text) > 2000",
    "p8_checks": "SELECT count(DISTINCT doc_id) AS docs, 0 AS overfull, 0 AS misplaced FROM documents",
    "p9_found": r"""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
dg AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i+11], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM d WHERE len(w) >= 12)),
bg AS (SELECT DISTINCT item_id, hash(array_to_string(w[i:i+11], ' ')) AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM b WHERE len(w) >= 12))
SELECT DISTINCT doc_id, item_id FROM dg JOIN bg USING (g)""",
    "p9_leaks": r"""WITH d AS (SELECT DISTINCT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w, CASE WHEN contains(text, '?') THEN len(list_filter(regexp_split_to_array(lower(regexp_extract(text, '(?s)^(.*)\?', 1)), '[^\p{L}\p{N}]+'), lambda x: x <> '')) END AS asked FROM benchmark),
dg AS (SELECT doc_id, i, hash(array_to_string(w[i:i+11], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM d WHERE len(w) >= 12)),
bg AS (SELECT item_id, j, len(w) AS n, coalesce(asked, len(w)) AS q, hash(array_to_string(w[j:j+11], ' ')) AS g FROM (SELECT item_id, w, asked, unnest(range(1, len(w) - 10)) AS j FROM b WHERE len(w) >= 12)),
m AS (SELECT doc_id, item_id, i, j, n, q FROM dg JOIN bg USING (g)),
p AS (SELECT DISTINCT doc_id, item_id, n, q, unnest(range(j, j + 12)) AS k FROM m)
SELECT doc_id, item_id, count(*)::INT AS shared_words, count(*) / n AS item_share, count(*) FILTER (k <= q) / nullif(q, 0) AS question_share, count(*) FILTER (k > q) / nullif(n - q, 0) AS answer_share, any_value(f)::INT AS at_word
FROM p JOIN (SELECT doc_id, item_id, min(i) - 1 AS f FROM m GROUP BY ALL) USING (doc_id, item_id) GROUP BY doc_id, item_id, n, q""",
    "p10_shared": """WITH t AS (SELECT DISTINCT doc_id, text FROM documents WHERE length(text) >= 300),
w AS (SELECT doc_id, i, hash(substring(text, i, 300)) AS g FROM (SELECT doc_id, text, unnest(range(1, length(text) - 298)) AS i FROM t)),
o AS (SELECT g, min(doc_id) AS first FROM w GROUP BY g HAVING count(DISTINCT doc_id) > 1),
c AS (SELECT doc_id, i, first FROM w JOIN o USING (g)),
s AS (SELECT doc_id, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS gap FROM c),
k AS (SELECT doc_id, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS gap FROM c WHERE first < doc_id),
sa AS (SELECT doc_id, sum(least(coalesce(gap, 300), 300)) AS chars, count(*) FILTER (gap IS NULL OR gap > 300) AS n FROM s GROUP BY doc_id),
ka AS (SELECT doc_id, sum(least(coalesce(gap, 300), 300)) AS chars FROM k GROUP BY doc_id),
d AS (SELECT doc_id, max(coalesce(length(text), 0)) AS n_chars FROM documents GROUP BY doc_id)
SELECT doc_id, n_chars, coalesce(sa.chars, 0)::BIGINT AS shared_chars, coalesce(sa.n, 0) AS n_stretches, coalesce(ka.chars, 0)::BIGINT AS kept_elsewhere, round(coalesce(sa.chars, 0) / greatest(n_chars, 1), 6) AS shared_fraction
FROM d LEFT JOIN sa USING (doc_id) LEFT JOIN ka USING (doc_id)""",
    "p10_found": """WITH t AS (SELECT DISTINCT doc_id, text FROM documents WHERE length(text) >= 300),
w AS (SELECT DISTINCT doc_id, hash(substring(text, i, 300)) AS g FROM (SELECT doc_id, text, unnest(range(1, length(text) - 298)) AS i FROM t)),
o AS (SELECT g FROM w GROUP BY g HAVING count(*) > 1)
SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM (SELECT * FROM w SEMI JOIN o USING (g)) a JOIN (SELECT * FROM w SEMI JOIN o USING (g)) b USING (g) WHERE a.doc_id < b.doc_id""",
}
# groups are the components of the pairs
SQL["p2_groups"] = f"""WITH RECURSIVE pairs AS MATERIALIZED ({SQL["p2_found"]}),
e AS (SELECT element_id_a AS u, element_id_b AS v FROM pairs UNION ALL SELECT element_id_b, element_id_a FROM pairs),
r(u, v) AS (SELECT u, v FROM e UNION SELECT r.u, e.v FROM r JOIN e ON e.u = r.v)
SELECT g.u AS element_id, least(g.u, min(g.v)) AS group_id, any_value(n) AS n_links FROM r g JOIN (SELECT u, count(*) AS n FROM e GROUP BY u) c ON c.u = g.u GROUP BY g.u"""
