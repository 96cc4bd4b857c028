import random
import re

import pytest
from pyspark.sql import functions as F

from loamstone.functions import text as T
from loamstone.operators import layout, lexical, memory, plugins, presentation
from loamstone.plans import tables
from loamstone.streaming.blocks import fold_events, stream_blocks, stream_events
from loamstone.streaming.breaker import Breaker, fold_breaker


def texts(n, seed):
    r = random.Random(seed)
    parts = ["# Head", "SKILLS", "plain text.", "short", "", "  ", "## Sub ", "a longer paragraph that ends with a stop.", "my projects here", "#", "1 2 3"]
    return [(i, "\n".join(r.choice(parts) for _ in range(r.randint(0, 12)))) for i in range(n)] + [(n, None), (n + 1, "")]


def test_sections_and_parents_of_a_row_equal_those_of_windows(spark):
    d = spark.createDataFrame(texts(60, 1), "doc long, text string")
    e = layout.paragraphs(d, "\n")
    want = {tuple(r) for r in layout.section_texts(layout.with_sections(e)).select("doc", "section", "breadcrumb", "n", "text").collect()}
    assert {tuple(r) for r in layout.document_sections(d, "\n").collect()} == want and want
    want = {tuple(r) for r in layout.with_parents(e).select("doc", "pos", "kind", "parent_pos").collect()}
    assert {tuple(r) for r in layout.document_parents(d, "\n").collect()} == want


def test_ingestion_from_end_to_end(spark):
    rows = [(1, "a.txt", "# Title\n\nbody one.\n\nSKILLS\n\nmo\x07re"), (2, "b.txt", " \n\n \x01"), (3, "c.txt", ""), (4, "d.txt", None)]
    i = layout.ingest(spark.createDataFrame(rows, "doc long, filename string, text string"))
    assert {r.doc: (r.problem, len(r.elements)) for r in i.collect()} == {1: (None, 4), 2: (None, 0), 3: ("empty", 0), 4: ("missing", 0)}
    got = sorted(tuple(r) for r in layout.documents_of(i).select("element_id", "kind", "section", "breadcrumb", "parent_id", "text", "is_fallback").collect())
    assert got == [
        ("1:0", "HEADING", 1, "Title", None, "Title", False), ("1:1", "PARAGRAPH", 1, "Title", "1:0", "body one.", False), ("1:2", "PARAGRAPH", 2, "SKILLS", "1:0", "SKILLS", False), ("1:3", "PARAGRAPH", 2, "SKILLS", "1:0", "more", False),
        ("b.txt", None, None, None, None, "[Document: b.txt - No extractable text content]", True),
    ]


def shown(spark, text, header=True):
    return presentation.present(spark.createDataFrame([(1, text, header)], "id long, t string, render_header boolean")).first().presented


def test_presentation(spark):
    assert shown(spark, "### Skills Overview\n- Python\n- React", False).startswith("- Python")
    got = shown(spark, "### Skills\nPython, Java, Git, Docker\n\n### Other\na, b, c")
    assert got == "### Skills\n\n- **Languages**: `Python` `Java`\n- **Tools & Cloud**: `Git` `Docker`\n\n### Other\n\na, b, c"
    assert shown(spark, None) == "" and shown(spark, "") == ""
    lines = shown(spark, "\n".join(["- b"] * 12)).split("\n")
    assert [i for i, x in enumerate(lines) if x == ""] == [5, 11]


def test_rhythm_equals_the_rule_line_by_line(spark):
    r = random.Random(2)
    rows = [(i, "\n".join(r.choice(["- a", "* b", "t", "", " - c"]) for _ in range(r.randint(1, 25)))) for i in range(40)]

    def rule(text):
        out, n = [], 0
        for line in text.split("\n"):
            if line.strip().startswith(("- ", "* ")):
                n += 1
                if n > 5:
                    out.append("")
                    n = 1
            else:
                n = 0
            out.append(line)
        return "\n".join(out)

    df = spark.createDataFrame(rows, "id long, t string").select("id", F.split("t", "\n").alias("lines"))
    got = {x.id: x.t for x in presentation.with_rhythm(df).select("id", F.array_join("lines", "\n").alias("t")).collect()}
    assert got == {i: rule(t) for i, t in rows}


def test_cache_looks_for_the_same_question_first(spark):
    e = [(1, "s", "how", [1.0, 0.0]), (2, "s", "why", [0.0, 1.0]), (3, "t", "how", [1.0, 0.0]), (4, "s", "how", [0.6, 0.8]), (5, None, "how", [1.0, 0.0]), (6, "s", None, None)]
    r = [(10, "s", "how", [0.0, 1.0]), (11, "s", "what", [0.01, 1.0]), (12, "s", "what", [0.9, 0.5]), (13, "u", "how", [1.0, 0.0]), (1, "s", "how", [1.0, 0.0])]
    kind = "id long, session string, query string, v array<double>"
    got = {x.id: (x.source_id, x.how) for x in memory.cache_lookup(spark.createDataFrame(r, kind), spark.createDataFrame(e, kind)).collect()}
    assert got == {10: (4, "exact"), 11: (2, "semantic"), 1: (4, "exact")}


def test_highlights_in_both_directions(spark, monkeypatch):
    monkeypatch.setattr(lexical, "SEARCHED", 60)
    r = random.Random(3)
    rows = [(i, "".join(r.choice("abcA é") for _ in range(r.choice([0, 1, 3, 9, 14, 40])))) for i in range(200)] + [(500, None)]
    asked = [(t,) for _, t in r.sample(rows[:200], 25)] + [(None,)]
    rows += [(600 + i, f"xx{t}yy") for i, (t,) in enumerate(asked) if t]
    got = {x.id for x in lexical.highlights(spark.createDataFrame(rows, "id long, t string"), spark.createDataFrame(asked, "t string")).collect()}
    want = {i for i, t in rows if t and any(c and (c.lower() in t.lower() or t.lower() in c.lower()) for (c,) in asked)}
    assert got == want and len(want) < len(rows)
    assert lexical.highlights(spark.createDataFrame(rows, "id long, t string"), spark.createDataFrame([], "t string")).count() == 0


def test_postings(spark):
    d = spark.createDataFrame([(1, "a b b c"), (2, None), (3, " ")], "id long, t string")
    assert sorted(tuple(x) for x in lexical.postings(d).collect()) == [(1, "a", 1, 4), (1, "b", 2, 4), (1, "c", 1, 4)]


def test_pii_findings_prompts_and_bounds(spark):
    row = spark.createDataFrame([("x@y.de, 10.0.0.1, a@b.co, x@y.de",)], "t string").select(T.pii_findings(F.col("t")).alias("m"), T.prompt(F.lit("c"), F.lit("m"), F.lit("q")).alias("p"), T.prompt(F.lit("c"), F.lit(""), F.lit("q")).alias("n")).first()
    assert row.m == {"email": ["x@y.de", "a@b.co"], "ip_address": ["10.0.0.1"]}
    assert row.p.startswith("Context:\nMemory History:\nm\n\nDocument Context:\nc") and row.n == "Context:\nc\n\nQuestion:\nq"
    assert [r.k for r in spark.createDataFrame([(1,), (7,), (99,)], "k int").select(T.clamp_k(F.col("k")).alias("k")).collect()] == [3, 7, 15]


def test_rewriting_and_correction(spark):
    def broken(q):
        raise ConnectionError

    df = spark.createDataFrame([("What IS the Torque?",), (None,)], "q string")
    assert [r.a for r in df.select(plugins.rewritten(F.col("q")).alias("a")).collect()] == ["what is the torque", None]
    assert [r.a for r in df.select(plugins.rewritten(F.col("q"), broken).alias("a")).collect()] == ["What IS the Torque?", None]
    c = spark.createDataFrame([("The pump turns slowly. Martians invented bananas.", "the pump turns slowly", False), ("Unknown words only.", "", False), ("Kept as it stands.", "", True)], "d string, c string, g boolean")
    assert [r.x for r in c.select(plugins.corrected(F.col("d"), F.col("c"), F.col("g")).alias("x")).collect()] == ["The pump turns slowly.", "Unknown words only.", "Kept as it stands."]


def test_an_open_breaker_passes_a_model_over():
    calls = []

    def down(p, c):
        calls.append(1)
        raise ConnectionError

    breakers, models = {}, [("down", down), ("up", lambda p, c: "yes")]
    for _ in range(4):
        assert plugins.call_with_fallback(models, "p", "c", wait=lambda s: None, breakers=breakers, clock=lambda: 5.0) == ("yes", "up")
    assert len(calls) == 3 and breakers["down"].state == "open"
    plugins.call_with_fallback(models, "p", "c", wait=lambda s: None, breakers=breakers, clock=lambda: 40.0)
    assert len(calls) == 4


def test_traced_models_and_the_retry_loop():
    ticks = iter(range(100))
    m = plugins.Traced(lambda p, c: f"{p} done" if p else 1 / 0, clock=lambda: next(ticks))
    m("a b", "c")
    with pytest.raises(ZeroDivisionError):
        m("", "c")
    assert (m.calls, m.failures, m.words_in, m.words_out, m.seconds) == (2, 1, 4, 3, 2)
    left = [2]

    def step(state):
        left[0] -= 1
        if left[0] >= 0:
            raise ValueError("again")
        return {"answer": "x"}

    done = plugins.retry_graph(step)({"question": "q"})
    assert done["success"] and done["answer"] == "x" and done["retry_count"] == 2 and done["messages"] == ["error: again"] * 2
    left[0] = 99
    assert plugins.retry_graph(step, 2)({})["success"] is False


def test_a_hot_service_is_folded_over_batches(spark, request):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch"))
    r = random.Random(4)
    rows = [(s, i, float(i * 9), r.random() < 0.4) for s in ("hot", "cold") for i in range(200 if s == "hot" else 5)] + [("hot", 200, 1e6, False)]
    got = {(x.service, x.seq): (x.allowed, x.state) for x in fold_breaker(spark.createDataFrame(rows, "service string, seq long, at double, ok boolean").repartition(5)).collect()}
    want = {}
    for s in ("hot", "cold"):
        b = Breaker()
        for _, i, at, ok in sorted(x for x in rows if x[0] == s):
            want[s, i] = (b.call(at, ok), b.state)
    assert got == want


def test_an_idle_stream_is_flushed(spark, tmp_path):
    df = spark.createDataFrame([("a", 0, "One para"), ("a", 1, " goes on")], "stream string, seq long, token string")
    df.write.parquet(str(tmp_path / "in"))
    q = stream_blocks(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), idle_ms=1).writeStream.format("memory").queryName("idle").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="200 milliseconds").start()
    for _ in range(40):
        if q.awaitTermination(0.5) or spark.sql("select * from idle").count():
            break
    q.stop()
    assert [tuple(r) for r in spark.sql("select * from idle").collect()] == [("a", 1, "One para goes on")]


def test_answer_events_in_batch_and_stream(spark, tmp_path):
    rows = [(s, i, t) for s in ("a", "b") for i, t in enumerate(["One ", "para", "\n\n", "Two ", "more text", "\n\n", "Three é"])]
    df = spark.createDataFrame(rows, "stream string, seq long, token string")
    want = {tuple(r) for r in fold_events(df).collect()}
    mine = [r[2:] for r in sorted(want) if r[0] == "a"]
    assert [k for k, _ in mine].count("token") == 7 and [k for k, _ in mine].count("block_commit") == 3
    assert mine[0] == ("stage", "generating") and mine[-1][0] == "final_transformed" and "Three é" in mine[-1][1]
    df.unionByName(spark.createDataFrame([("a", 99, None), ("b", 99, None)], "stream string, seq long, token string")).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = stream_events(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), idle_ms=None).writeStream.format("memory").queryName("events_told").outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert {tuple(r) for r in spark.sql("select * from events_told").collect()} == want


def test_turns_are_numbered(spark):
    df = spark.createDataFrame([("s", 5, "2025-01-01 00:00:00"), ("s", 7, "2025-01-01 00:00:02.5"), ("t", 1, None)], "session string, turn int, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = sorted(tuple(r) for r in memory.numbered(df).select("session", "turn_index", "stamp", "since_ms").collect())
    assert got == [("s", 0, "2025-01-01T00:00:00Z", None), ("s", 1, "2025-01-01T00:00:02Z", 2500), ("t", 0, None, None)]


def test_cut_tables_can_be_cleared(spark):
    df = tables.cut(spark.range(5))
    path = tables._CUTS[-1]
    assert df.count() == 5 and re.search(r"cut-[0-9a-f]{32}$", path)
    keep = tables._CUTS[:-1]
    tables._CUTS[:] = [path]
    tables.clear(spark)
    tables._CUTS[:] = keep
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
