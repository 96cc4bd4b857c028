"""Layout, sections, context, presentation, conversation state, cache and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamstone.functions import text as T
from loamstone.operators import ingest, layout, lexical, memory, presentation
from loamstone.plans.tables import cut, spread, table
from loamstone.plans.text_queries import _PII_KIND, _STRIP, _WORDS, _bounded, _like, _table_case, quoted


def _elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")
    return layout.paragraphs(d, "\n")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text"))


def paragraph_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = layout._parts(_texts(spark, sf_dir), "\n")
    chars = F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + F.length(p["text"]))
    return d.select("doc", F.size("parts").cast("long").alias("n"), F.size(F.filter("parts", lambda p: p["kind"] == "HEADING")).cast("long").alias("headings"), chars.alias("chars"), (F.size("parts") - 1).alias("last"))


def layout_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.document_parents(_texts(spark, sf_dir), "\n")


def section_breadcrumbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.document_sections(_texts(spark, sf_dir), "\n").withColumn("section", F.col("section").cast("long"))


def context_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context of the hybrid search's hits: all sections of each hit in order, each under its breadcrumb."""
    from loamstone.plans.search_queries import rrf_fusion

    hits = cut(rrf_fusion(spark, sf_dir))
    d = _texts(spark, sf_dir).join(hits.select(F.col("id").alias("doc")).distinct(), "doc", "left_semi")
    s = layout.document_sections(d, "\n")
    return layout.context(hits.join(s, hits["id"] == s["doc"]).select("query_id", "rank", "section", "text", "breadcrumb"))


FILES = ((-1, "blank.txt", "   \n \n"), (-2, "nothing.txt", ""), (-3, "marked.txt", "# Report\n\n first \nSKILLS\n- a\x07b\n\x01"), (-4, "gone.txt", None))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"), "text")
    return spread(d).unionByName(spark.createDataFrame(FILES, "doc long, filename string, text string"))


def ingested_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingestion from end to end: validation, parsing, cleaning, sections and parents, and a notice for a file without text."""
    return layout.documents_of(layout.ingest(_files(spark, sf_dir), "\n"))


def ingestion_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per file: why it was refused, its elements, those without a parent, and the characters kept."""
    i = layout.ingest(_files(spark, sf_dir), "\n")
    status = F.when(F.col("problem").isNotNull(), "REJECTED").when(F.size("elements") == 0, "LOW_CONFIDENCE").otherwise("SUCCESS")
    return i.select(
        "doc", "size", "problem", status.alias("status"), F.size("elements").alias("n_elements"), F.size(F.filter("elements", lambda e: e["parent_pos"].isNull())).alias("n_roots"),
        F.aggregate("elements", F.lit(0).cast("long"), lambda n, e: n + F.length(e["text"])).alias("chars"),
    )


def turn_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index of each turn in its session, its UTC stamp, and the milliseconds since the turn before."""
    return memory.numbered(_turns(spark, sf_dir)).select("turn_id", F.col("turn_index").cast("long").alias("turn_index"), "stamp", "since_ms")


def memory_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt of each turn, with what is remembered before the context."""
    t = memory.working_memory(_turns(spark, sf_dir))
    return t.select("turn_id", T.prompt(F.coalesce("response", F.lit("")), F.col("memory"), F.coalesce("query", F.lit(""))).alias("prompt"))


def metadata_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements whose metadata meet every one of several equalities."""
    wanted = {"page": "1"}
    e = table(spark, sf_dir, "document_elements").where(" and ".join(f"metadata['{k}'] = '{v}'" for k, v in wanted.items()) + " and element_type = 'PARAGRAPH'")
    return e.select("element_id").distinct()


def flattened_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provenance and metadata flattened; metadata outranks what the parser set."""
    e = table(spark, sf_dir, "document_elements").dropDuplicates(["element_id"])
    own = F.map_filter(F.create_map(F.lit("page"), F.col("provenance.page").cast("string"), F.lit("parser_version"), F.col("provenance.parser_version")), lambda k, v: v.isNotNull())
    over = F.coalesce("metadata", F.create_map().cast("map<string,string>"))
    merged = F.map_concat(F.map_filter(own, lambda k, v: ~F.map_contains_key(over, k)), over)
    return e.select("element_id", F.col("provenance.parser_name").alias("parser"), F.element_at(merged, "page").alias("page"), F.element_at(merged, "parser_version").alias("parser_version"), F.size(merged).alias("n_keys"), F.size(F.coalesce("child_ids", F.array().cast("array<string>"))).alias("n_children"))


def highlighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements whose text holds, or lies in, a retrieved chunk: those of the elements whose id, by its last eight hexadecimal digits, is divisible by 100."""
    e = table(spark, sf_dir, "document_elements").select(F.col("element_id").alias("id"), F.col("text").alias("t"))
    asked = e.where(F.conv(F.right("id", F.lit(8)), 16, 10).cast("long") % 100 == 0)
    return lexical.highlights(e, asked).withColumnRenamed("id", "element_id")


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chat_turns").select("turn_id", F.col("session_id").alias("session"), "turn", F.col("user_query").alias("query"), F.col("ai_response").alias("response"), "ts").distinct()


def working_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.working_memory(_turns(spark, sf_dir)).select("turn_id", "memory")


def episodic_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.episodic_summary(_turns(spark, sf_dir)).select("turn_id", "summary")


def topic_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.topics(_turns(spark, sf_dir)).select("turn_id", "continuation", "active", "shift")


def recent_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.recent(_turns(spark, sf_dir), 2).select("turn_id", "session", "turn")


def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context and memory of each turn cut to a small window's budget."""
    t = memory.episodic_summary(memory.working_memory(_turns(spark, sf_dir)))
    a = T.allocate(F.coalesce("response", F.lit("")), F.col("summary"), F.lit(""), F.col("memory"), 400)
    return t.select("turn_id", a.alias("a")).select("turn_id", "a.context", "a.memory")


def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _turns(spark, sf_dir).where("ts is not null and query is not null").select("session", "query", "ts", F.col("turn_id").alias("id"))
    return memory.cache_hits(r, 86400).select("id", "source")


def session_clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns left after the sessions that have a blocked request are cleared."""
    gone = table(spark, sf_dir, "requests").where("blocked").select(F.col("session_id").alias("session")).distinct()
    return _turns(spark, sf_dir).join(gone, "session", "left_anti").select("turn_id", "session")


def request_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.request_metrics(table(spark, sf_dir, "requests"), [])


def session_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.request_metrics(table(spark, sf_dir, "requests"), ["session_id"])


def upload_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every accepted upload among its address's of the day."""
    u = table(spark, sf_dir, "uploads").where("accepted")
    return memory.rank_in_day(u, "ip", "ts", F.col("upload_id")).select("upload_id", "ip", "day_rank")


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per day and type."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.date_format(F.date_trunc("day", "ts"), "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def parser_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The attempt that holds for each file, from its history."""
    f = table(spark, sf_dir, "source_files").select("file_path", F.posexplode("fallback_history").alias("ord", "h")).select("file_path", "ord", "h.*")
    return ingest.fallback_choice(f, "file_path")


def tenant_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and bytes by tenant tier; files without a tenant count as such."""
    f, t = table(spark, sf_dir, "source_files"), table(spark, sf_dir, "tenants")
    return f.join(t.select("tenant_id", "tier"), "tenant_id", "left").groupBy(F.coalesce("tier", F.lit("none")).alias("tier"), "mime_type").agg(F.count("*").alias("files"), F.sum("file_size_bytes").alias("bytes"), F.count_if("is_scanned").alias("scanned"))


MARKDOWN = (
    "Intro text### Education\nSome place", "### Skills\n- Python, Java, Git, Docker\n- one, two", "### Technical Skills\nTools: React, Node, LangChain\n## Next\n- a, b, c", "SummaryBorn in a town.### Experience\n- x",
    "\n".join(f"- item {i}" for i in range(13)) + "\ntext\n* a\n* b", "##Title\nbody", "no marks here", "", "end### Last", "### A\n\n\n\nb",
)


def _markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes = spark.createDataFrame([(-i - 1, s) for i, s in enumerate(MARKDOWN)], "id long, t string")
    t = table(spark, sf_dir, "chat_turns").select(F.col("turn_id").alias("id"), F.col("ai_response").alias("t")).distinct().where("t is not null")
    return probes.unionByName(t)


def header_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _markdown(spark, sf_dir).select("id", T.repair_headers(F.col("t")).alias("repaired"))


def bullet_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return presentation.spaced_bullets(_markdown(spark, sf_dir)).groupBy("id").agg(F.count("*").alias("n_lines"), F.count_if("gap").alias("gaps"), F.max(F.when(F.col("gap"), F.col("n"))).alias("last_gap"))


def badge_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return presentation.badges(presentation.badge_items(_markdown(spark, sf_dir)))


def section_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _elements(spark, sf_dir).where("kind = 'HEADING'")
    return e.groupBy(T.section_priority(F.col("text")).alias("priority")).agg(F.count("*").alias("n"))


BODIES = (
    "data: stage: retrieving\n\ndata: retrieved_chunks: [1, 2]\n\ndata: Hello \n\ndata: world\n\ndata: block_commit: {\"id\": 1}\n\ndata: final_transformed: {\"content\": \"x\"}\n\n",
    "data: error: no model\n\n", "", "plain line\n\ndata: stage:done",
)
ERRORS = ('{"error": "LowContext", "message": "too little", "actions": ["a", "b"]}', ' {"error": "Down"} ', '{"ok": 1}', "no json", '{"error": broken', "")
VERDICTS = ('{"safe": true, "reason": "fine"}', '{"safe": false, "reason": "asks for a key"}', "I think it is safe", '{"reason": "x"}', "")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return presentation.stream_events(spark.createDataFrame(list(enumerate(BODIES)), "id int, body string"))


def error_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.createDataFrame(list(enumerate(ERRORS)), "id int, t string").select("id", presentation.error_payload(F.col("t")).alias("e"))
    return e.select("id", "e.error", "e.message", F.size(F.coalesce("e.actions", F.array().cast("array<string>"))).alias("n_actions"))


def guard_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spark.createDataFrame(list(enumerate(VERDICTS)), "id int, t string").select("id", presentation.guard_verdict(F.col("t")).alias("v"))
    return v.select("id", "v.safe", "v.reason")


def presented_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers as they are shown: headers, badges, rhythm, and no first header where the turn goes on with its topic."""
    shown = memory.topics(_turns(spark, sf_dir)).select(F.col("turn_id").alias("id"), "shift")
    m = _markdown(spark, sf_dir).join(shown, "id", "left")
    return presentation.present(m.select("id", "t", F.coalesce("shift", F.col("id") % 2 == 0).alias("render_header")))


QUERIES = {
    q.__name__: q
    for q in (ingested_documents, ingestion_telemetry, turn_index, memory_prompts, metadata_filter, event_stream, error_payloads, guard_verdicts, presented_answers, paragraph_elements, layout_parents, section_breadcrumbs, context_blocks, flattened_elements, highlighted, working_memory, episodic_summary, topic_shift, recent_turns, context_budget, cache_lookup, session_clear, request_metrics, session_metrics, upload_ranks, event_windows, parser_choice, tenant_files, header_repair, bullet_density, badge_groups, section_priority)
}

# ---- the same in SQL -----------------------------------------------------------------------------------

_STRIPPED = lambda c: _STRIP.format(c=c)
_P = f"""p AS (SELECT doc, unnest(range(len(ps))) AS pos, unnest(ps) AS p FROM (SELECT doc_id AS doc, list_filter(list_transform(string_split(text, chr(10)), lambda x: {_STRIPPED('x')}), lambda x: x <> '') AS ps FROM documents)),
el AS (SELECT doc, pos, CASE WHEN length(p) < 80 AND NOT ends_with(p, '.') AND (starts_with(p, '#') OR pos = 0) THEN 'HEADING' ELSE 'PARAGRAPH' END AS kind, {_STRIPPED("regexp_replace(p, '^#+', '')")} AS text FROM p)"""
_HEAD = (
    "(lower(kind) IN ('heading', 'title', 'header') OR starts_with(text, '#') OR (upper(text) = text AND lower(text) <> text) OR (len(" + _WORDS.format(c="text") + ") <= 5 AND ("
    + " OR ".join(f"contains(lower(text), '{w}')" for w in T.HEADING_WORDS) + ")))"
)
_S = f"""s1 AS (SELECT *, {_HEAD} AS h FROM el),
s2 AS (SELECT *, sum(CAST(h AS INT)) OVER (PARTITION BY doc ORDER BY pos) AS section, coalesce(last_value(CASE WHEN h THEN {_STRIPPED("regexp_replace(text, '^[# ]+|[# ]+$', '', 'g')")} END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY pos), 'General Document Content') AS breadcrumb FROM s1),
sec AS (SELECT doc, CAST(section AS BIGINT) AS section, breadcrumb, count(*) AS n, coalesce(string_agg(text, chr(10) ORDER BY pos) FILTER (text <> ''), '') AS text FROM s2 GROUP BY ALL)"""
_TURN = "t AS (SELECT DISTINCT turn_id, session_id AS session, turn, user_query AS query, ai_response AS response, ts FROM chat_turns)"
_MEM = "coalesce(string_agg('User: ' || coalesce(query, '') || chr(10) || 'Assistant: ' || coalesce(response, ''), chr(10) || chr(10)) OVER (PARTITION BY session ORDER BY turn ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), '')"
_Q = _STRIPPED("coalesce(query, '')")
_SUM = f"coalesce(string_agg(CASE WHEN {_Q} = '' THEN NULL WHEN length({_Q}) > 80 THEN 'Discussed: ''' || substring({_Q}, 1, 80) || '...''' ELSE 'Discussed: ''' || {_Q} || '''' END, ' | ') OVER (PARTITION BY session ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), '')"
_METRICS = """count(*) AS requests, count(*) FILTER (error IS NOT NULL OR coalesce(blocked, false)) AS errors, round(count(*) FILTER (error IS NOT NULL OR coalesce(blocked, false)) / count(*), 6) AS error_rate, round(coalesce(avg(latency_ms), 0), 4) AS avg_latency_ms,
 round(count(*) FILTER (coalesce(cache_hit, false) AND NOT coalesce(blocked, false)) / count(*), 6) AS hit_rate, CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS input_tokens, CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS output_tokens, count(*) FILTER (coalesce(blocked, false)) AS blocks FROM requests"""


_SHIFT = f"""sa AS (SELECT *, {_like("lower(coalesce(query, ''))", _bounded(T.CONTINUATION))} AS continuation, {_table_case("coalesce(query, '')", T.TOPICS, 'General Inquiry')} AS detected, row_number() OVER (PARTITION BY session ORDER BY turn) AS rn FROM t),
sb AS (SELECT *, last_value(CASE WHEN NOT continuation OR rn = 1 THEN detected END IGNORE NULLS) OVER (PARTITION BY session ORDER BY turn) AS active FROM sa),
sh AS (SELECT turn_id, coalesce(lag(active) OVER (PARTITION BY session ORDER BY turn) <> active, true) AS shift FROM sb)"""
_HEAD_OF = _HEAD.replace("starts_with(text, '#')", f"starts_with({_STRIPPED('text')}, '#')").replace("(upper(text) = text AND lower(text) <> text)", "(upper(text) = text AND lower(text) <> text)")


def _probe_text(s: str | None) -> str:
    if s is None:
        return "NULL"
    return " || ".join([f"chr({ord(ch)})" if ord(ch) < 32 else quoted(ch) for ch in s]) or "''"


_INGEST = f"""WITH fs AS (SELECT *, octet_length(encode(text)) AS size, CASE WHEN text IS NULL THEN 'missing' WHEN text = '' THEN 'empty' WHEN octet_length(encode(text)) > {layout.LARGEST_FILE} THEN 'too large' END AS problem
 FROM (SELECT doc_id AS doc, CAST(doc_id AS VARCHAR) || '.txt' AS filename, text FROM documents UNION ALL SELECT * FROM (VALUES {', '.join(f"({d}, {quoted(n)}, {_probe_text(t)})" for d, n, t in FILES)}))),
p AS (SELECT doc, unnest(range(len(ps))) AS pos, unnest(ps) AS p FROM (SELECT doc, list_filter(list_transform(string_split(text, chr(10)), lambda x: {_STRIPPED('x')}), lambda x: x <> '') AS ps FROM fs WHERE problem IS NULL)),
el0 AS (SELECT doc, pos AS pos0, CASE WHEN length(p) < 80 AND NOT ends_with(p, '.') AND (starts_with(p, '#') OR pos = 0) THEN 'HEADING' ELSE 'PARAGRAPH' END AS kind, {_STRIPPED("regexp_replace(" + _STRIPPED("regexp_replace(p, '^#+', '')") + ", '[\\x00-\\x08\\x0b-\\x1f]', '', 'g')")} AS text FROM p),
el AS (SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY pos0) - 1 AS pos, kind, text FROM el0 WHERE text <> ''),
s1 AS (SELECT *, {_HEAD_OF} AS h FROM el),
s3 AS (SELECT *, sum(CAST(h AS INT)) OVER (PARTITION BY doc ORDER BY pos) AS section, coalesce(last_value(CASE WHEN h THEN {_STRIPPED("regexp_replace(text, '^[# ]+|[# ]+$', '', 'g')")} END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY pos), 'General Document Content') AS breadcrumb,
 CASE WHEN kind <> 'HEADING' THEN last_value(CASE WHEN kind = 'HEADING' THEN pos END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY pos) END AS parent_pos FROM s1)
"""


def _sql_text(s: str) -> str:
    return " || chr(10) || ".join(quoted(x) for x in s.split("\n"))


_MD = "m AS (SELECT * FROM (VALUES " + ", ".join(f"({-i - 1}, {_sql_text(s)})" for i, s in enumerate(MARKDOWN)) + ") AS v(id, t) UNION ALL SELECT DISTINCT turn_id, ai_response FROM chat_turns WHERE ai_response IS NOT NULL)"
_LINES = "l AS (SELECT id, unnest(range(len(ls))) AS n, unnest(ls) AS line FROM (SELECT id, string_split(t, chr(10)) AS ls FROM m))"


def _repair(c: str) -> str:
    c = _STRIPPED(f"coalesce({c}, '')")
    for p, r in (
        (r"([^\n#])[^\S\n]*(#{2,})", "\\1\n\n\\2"), (r"(?m)^(#+)[^\S\n]*([A-Za-z0-9])", "\\1 \\2"), (rf"^({T.TITLES})([A-Z])", "### \\1\n\n\\2"), (rf"([a-z0-9.:)])({T.TITLES})([A-Z])", "\\1\n\n### \\2\n\n\\3"),
        (r"([^\n])\n(#+ )", "\\1\n\n\\2"), (r"(?m)^(#+ [^\n]+)\n([^\n])", "\\1\n\n\\2"), (r"\n{3,}", "\n\n"),
    ):
        c = f"regexp_replace({c}, {quoted(p)}, {quoted(r)}, 'g')"
    return _STRIPPED(c)


def _context_sql() -> str:
    from loamstone.plans.search_queries import _FUSED

    return _FUSED + f", {_P}, {_S}, hit AS (SELECT DISTINCT ON (query_id, text) query_id, rank, text, breadcrumb, section FROM (SELECT f.query_id, f.rank, sec.text, sec.breadcrumb, sec.section FROM f JOIN sec ON sec.doc = f.id) ORDER BY query_id, text, rank, section) SELECT query_id, string_agg(CASE WHEN breadcrumb <> '' THEN '[Category: ' || breadcrumb || ']' || chr(10) || text ELSE text END, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank, section) AS context FROM hit GROUP BY query_id"


def _valued(rows: tuple[str, ...], name: str) -> str:
    return "(VALUES " + ", ".join(f"({i}, {_sql_text(s)})" for i, s in enumerate(rows)) + f") AS v(id, {name})"


SQL = {
    "event_stream": f"""WITH l AS (SELECT id, unnest(range(len(ls))) AS seq, unnest(ls) AS line FROM (SELECT id, list_filter(list_transform(string_split(body, chr(10) || chr(10)), lambda x: regexp_replace(x, '^data: ?', '')), lambda x: x <> '') AS ls FROM {_valued(BODIES, 'body')})),
k AS (SELECT *, CASE {' '.join(f"WHEN starts_with(line, '{x}:') THEN '{x}'" for x in presentation.STAGES)} ELSE 'token' END AS kind FROM l) SELECT id, CAST(seq AS INT) AS seq, kind, CASE WHEN kind = 'token' THEN line ELSE regexp_replace(line, '^[a-z_]+:\\s*', '') END AS payload FROM k""",
    "error_payloads": f"""WITH j AS (SELECT id, CASE WHEN json_valid(t) AND starts_with(trim(t), '{{') AND json_extract_string(t, '$.error') IS NOT NULL THEN CAST(t AS JSON) END AS j FROM {_valued(ERRORS, 't')})
SELECT id, json_extract_string(j, '$.error') AS error, CASE WHEN j IS NOT NULL THEN coalesce(json_extract_string(j, '$.message'), '') END AS message, CAST(coalesce(json_array_length(j, '$.actions'), 0) AS INT) AS n_actions FROM j""",
    "guard_verdicts": f"""WITH j AS (SELECT id, CASE WHEN json_valid(t) THEN CAST(t AS JSON) END AS j FROM {_valued(VERDICTS, 't')})
SELECT id, coalesce(CAST(json_extract_string(j, '$.safe') AS BOOLEAN), false) AS safe, coalesce(json_extract_string(j, '$.reason'), 'unreadable') AS reason FROM j""",
    "presented_answers": f"""WITH {_TURN}, {_SHIFT}, {_MD.replace('m AS (', 'raw AS (', 1)}, m AS (SELECT raw.id, coalesce(sh.shift, raw.id % 2 = 0) AS render, {_repair('t')} AS t FROM raw LEFT JOIN sh ON sh.turn_id = raw.id), {_LINES},
o AS (SELECT *, {_STRIPPED('line')} AS t, {' OR '.join(f"contains(lower({_STRIPPED('line')}), '{h}')" for h in presentation.SKILL_HEADS)} AS opens FROM l), oc AS (SELECT *, starts_with(t, '### ') OR starts_with(t, '## ') AS closes FROM o),
i AS (SELECT *, coalesce(last_value(CASE WHEN opens THEN true WHEN closes THEN false END IGNORE NULLS) OVER (PARTITION BY id ORDER BY n), false) AND NOT opens AND NOT closes AS inside FROM oc),
x AS (SELECT *, CASE WHEN inside AND (starts_with(t, '- ') OR contains(t, ',') OR contains(t, ':')) THEN list_filter(list_transform(regexp_split_to_array(t, '[,:\\-*]'), lambda y: {_STRIPPED('y')}), lambda y: y <> '') ELSE [] END AS items FROM i),
e AS (SELECT id, n, k, regexp_replace(raw, '^[,.*\\-]+|[,.*\\-]+$', '', 'g') AS item FROM (SELECT id, n, unnest(range(len(items))) AS k, unnest(items) AS raw FROM x WHERE len(items) >= 3)),
c AS (SELECT id, n, category, min(k) AS sub, string_agg('`' || item || '`', ' ' ORDER BY k) AS pills FROM (SELECT *, {_table_case('item', T.TAXONOMY, 'General Details')} AS category FROM e WHERE item <> '') GROUP BY ALL),
nl AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY n, sub) AS n, line FROM (SELECT id, n, 0 AS sub, line FROM x WHERE len(items) < 3 UNION ALL SELECT id, n, sub, '- **' || category || '**: ' || pills FROM c)),
b AS (SELECT *, starts_with({_STRIPPED('line')}, '- ') OR starts_with({_STRIPPED('line')}, '* ') AS bullet FROM nl), r AS (SELECT *, sum(CASE WHEN bullet THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY n) AS island FROM b),
p AS (SELECT *, row_number() OVER (PARTITION BY id, island, bullet ORDER BY n) AS place FROM r),
g AS (SELECT id, {_STRIPPED("string_agg(CASE WHEN bullet AND place > 1 AND (place - 1) % 5 = 0 THEN chr(10) || line ELSE line END, chr(10) ORDER BY n)")} AS p FROM p GROUP BY id)
SELECT m.id, CASE WHEN render THEN coalesce(p, '') ELSE {_STRIPPED("regexp_replace(coalesce(p, ''), '^###[ \\t\\r\\n\\f\\x0b]+[^\\n]+\\n+', '')")} END AS presented FROM m LEFT JOIN g ON g.id = m.id""",
    "turn_index": f"WITH {_TURN} SELECT turn_id, row_number() OVER w - 1 AS turn_index, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS stamp, epoch_ms(ts) - epoch_ms(lag(ts) OVER w) AS since_ms FROM t WINDOW w AS (PARTITION BY session ORDER BY turn)",
    "memory_prompts": f"WITH {_TURN}, a AS (SELECT turn_id, coalesce(query, '') AS q, coalesce(response, '') AS r, {_MEM} AS m FROM t) SELECT turn_id, 'Context:' || chr(10) || CASE WHEN m <> '' THEN 'Memory History:' || chr(10) || m || chr(10) || chr(10) || 'Document Context:' || chr(10) || r ELSE r END || chr(10) || chr(10) || 'Question:' || chr(10) || q AS prompt FROM a",
    "metadata_filter": "SELECT DISTINCT element_id FROM document_elements WHERE metadata['page'] = '1' AND element_type = 'PARAGRAPH'",
    "ingested_documents": _INGEST + f"""SELECT doc, CAST(doc AS VARCHAR) || ':' || CAST(pos AS VARCHAR) AS element_id, kind, CAST(section AS INT) AS section, breadcrumb, CASE WHEN parent_pos IS NOT NULL THEN CAST(doc AS VARCHAR) || ':' || CAST(parent_pos AS VARCHAR) END AS parent_id, text, false AS is_fallback FROM s3
UNION ALL SELECT doc, filename, NULL, NULL, NULL, NULL, '[Document: ' || filename || ' - No extractable text content]', true FROM fs WHERE problem IS NULL AND doc NOT IN (SELECT doc FROM s3)""",
    "ingestion_telemetry": _INGEST + """SELECT fs.doc, any_value(size) AS size, any_value(problem) AS problem, CASE WHEN any_value(problem) IS NOT NULL THEN 'REJECTED' WHEN count(s3.doc) = 0 THEN 'LOW_CONFIDENCE' ELSE 'SUCCESS' END AS status, CAST(count(s3.doc) AS INT) AS n_elements, CAST(count(s3.doc) FILTER (parent_pos IS NULL) AS INT) AS n_roots, CAST(coalesce(sum(length(s3.text)), 0) AS BIGINT) AS chars FROM fs LEFT JOIN s3 ON s3.doc = fs.doc GROUP BY fs.doc""",
    "paragraph_elements": f"WITH {_P} SELECT doc, count(*) AS n, count(*) FILTER (kind = 'HEADING') AS headings, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(max(pos) AS INT) AS last FROM el GROUP BY doc",
    "layout_parents": f"WITH {_P} SELECT doc, CAST(pos AS INT) AS pos, kind, CAST(CASE WHEN kind <> 'HEADING' THEN last_value(CASE WHEN kind = 'HEADING' THEN pos END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS INT) AS parent_pos FROM el",
    "section_breadcrumbs": f"WITH {_P}, {_S} SELECT * FROM sec",
    "context_blocks": _context_sql(),
    "flattened_elements": """SELECT DISTINCT element_id, provenance.parser_name AS parser, coalesce(metadata['page'], CAST(provenance.page AS VARCHAR)) AS page, coalesce(metadata['parser_version'], provenance.parser_version) AS parser_version,
 CAST(coalesce(cardinality(metadata), 0) + CASE WHEN provenance.page IS NOT NULL AND metadata['page'] IS NULL THEN 1 ELSE 0 END + CASE WHEN provenance.parser_version IS NOT NULL AND metadata['parser_version'] IS NULL THEN 1 ELSE 0 END AS INT) AS n_keys, CAST(coalesce(len(child_ids), 0) AS INT) AS n_children FROM document_elements""",
    "highlighted": "WITH e AS (SELECT DISTINCT element_id, lower(text) AS t FROM document_elements WHERE text <> ''), c AS (SELECT DISTINCT t FROM e WHERE CAST('0x' || right(element_id, 8) AS BIGINT) % 100 = 0) SELECT DISTINCT element_id FROM e WHERE EXISTS (SELECT 1 FROM c WHERE contains(e.t, c.t) OR contains(c.t, e.t))",
    "working_memory": f"WITH {_TURN} SELECT turn_id, {_MEM} AS memory FROM t",
    "episodic_summary": f"WITH {_TURN} SELECT turn_id, {_SUM} AS summary FROM t",
    "topic_shift": f"""WITH {_TURN}, a AS (SELECT *, {_like("lower(coalesce(query, ''))", _bounded(T.CONTINUATION))} AS continuation, {_table_case("coalesce(query, '')", T.TOPICS, 'General Inquiry')} AS detected, row_number() OVER (PARTITION BY session ORDER BY turn) AS rn FROM t),
b AS (SELECT *, last_value(CASE WHEN NOT continuation OR rn = 1 THEN detected END IGNORE NULLS) OVER (PARTITION BY session ORDER BY turn) AS active FROM a)
SELECT turn_id, continuation, active, coalesce(lag(active) OVER (PARTITION BY session ORDER BY turn) <> active, true) AS shift FROM b""",
    "recent_turns": f"WITH {_TURN} SELECT turn_id, session, turn FROM t QUALIFY row_number() OVER (PARTITION BY session ORDER BY turn DESC) <= 2",
    "context_budget": f"""WITH {_TURN}, a AS (SELECT turn_id, coalesce(response, '') AS r, {_SUM} AS s, {_MEM} AS m FROM t)
SELECT turn_id, substring(r, 1, {T.budget(400)[0]}) AS context, substring({_STRIPPED("concat_ws(chr(10) || chr(10), CASE WHEN s <> '' THEN 'Episodic Summary:' || chr(10) || s END, CASE WHEN m <> '' THEN 'Recent Exchange:' || chr(10) || m END)")}, 1, {T.budget(400)[1]}) AS memory FROM a""",
    "cache_lookup": f"WITH {_TURN}, b AS (SELECT turn_id AS id, ts, lag(turn_id) OVER w AS source, lag(ts) OVER w AS prev_ts FROM t WHERE ts IS NOT NULL AND query IS NOT NULL WINDOW w AS (PARTITION BY session, query ORDER BY ts, turn_id)) SELECT id, CASE WHEN epoch(ts) - epoch(prev_ts) <= 86400 THEN source END AS source FROM b",
    "session_clear": f"WITH {_TURN} SELECT turn_id, session FROM t WHERE session NOT IN (SELECT session_id FROM requests WHERE blocked AND session_id IS NOT NULL)",
    "request_metrics": f"SELECT {_METRICS}",
    "session_metrics": f"SELECT session_id, {_METRICS} GROUP BY session_id",
    "upload_ranks": "SELECT upload_id, ip, CAST(row_number() OVER (PARTITION BY ip, CAST(ts AS DATE) ORDER BY ts, upload_id) AS INT) AS day_rank FROM uploads WHERE accepted",
    "event_windows": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "parser_choice": """WITH f AS (SELECT file_path, unnest(range(len(fallback_history))) AS ord, unnest(fallback_history) AS h FROM source_files), a AS (SELECT file_path, CAST(ord AS INT) AS ord, h.strategy AS strategy, h.status AS status, h.confidence AS confidence, h.status = 'SUCCESS' AND coalesce(h.confidence, 1.0) >= 0.5 AS ok FROM f)
SELECT file_path, strategy, status, confidence, ord FROM a QUALIFY row_number() OVER (PARTITION BY file_path ORDER BY CASE WHEN ok THEN 0 ELSE 1 END, CASE WHEN ok THEN ord END NULLS FIRST, coalesce(confidence, -1) DESC, ord) = 1""",
    "tenant_files": "SELECT coalesce(tier, 'none') AS tier, mime_type, count(*) AS files, CAST(sum(file_size_bytes) AS BIGINT) AS bytes, count(*) FILTER (is_scanned) AS scanned FROM source_files LEFT JOIN tenants USING (tenant_id) GROUP BY ALL",
    "header_repair": f"WITH {_MD} SELECT id, {_repair('t')} AS repaired FROM m",
    "bullet_density": f"""WITH {_MD}, {_LINES}, b AS (SELECT *, starts_with({_STRIPPED('line')}, '- ') OR starts_with({_STRIPPED('line')}, '* ') AS bullet FROM l), i AS (SELECT *, sum(CASE WHEN bullet THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY n) AS island FROM b),
p AS (SELECT *, row_number() OVER (PARTITION BY id, island, bullet ORDER BY n) AS place FROM i), g AS (SELECT id, n, bullet AND place > 1 AND (place - 1) % 5 = 0 AS gap FROM p)
SELECT id, count(*) AS n_lines, count(*) FILTER (gap) AS gaps, CAST(max(n) FILTER (gap) AS INT) AS last_gap FROM g GROUP BY id""",
    "badge_groups": f"""WITH {_MD}, {_LINES}, a AS (SELECT id, n, {_STRIPPED('line')} AS t FROM l), o AS (SELECT *, {' OR '.join(f"contains(lower(t), '{h}')" for h in presentation.SKILL_HEADS)} AS opens, starts_with(t, '### ') OR starts_with(t, '## ') AS closes FROM a),
i AS (SELECT *, coalesce(last_value(CASE WHEN opens THEN true WHEN closes THEN false END IGNORE NULLS) OVER (PARTITION BY id ORDER BY n), false) AND NOT opens AND NOT closes AS inside FROM o),
x AS (SELECT id, n, list_filter(list_transform(regexp_split_to_array(t, '[,:\\-*]'), lambda y: {_STRIPPED('y')}), lambda y: y <> '') AS items FROM i WHERE inside AND (starts_with(t, '- ') OR contains(t, ',') OR contains(t, ':'))),
e AS (SELECT id, n, k, regexp_replace(raw, '^[,.*\\-]+|[,.*\\-]+$', '', 'g') AS item FROM (SELECT id, n, unnest(range(len(items))) AS k, unnest(items) AS raw FROM x WHERE len(items) >= 3))
SELECT id, CAST(n AS INT) AS n, {_table_case('item', T.TAXONOMY, 'General Details')} AS category, string_agg('`' || item || '`', ' ' ORDER BY k) AS badges FROM e WHERE item <> '' GROUP BY ALL""",
    "section_priority": f"WITH {_P} SELECT {_table_case('text', T.PRIORITY, 'LOW')} AS priority, count(*) AS n FROM el WHERE kind = 'HEADING' GROUP BY 1",
}
