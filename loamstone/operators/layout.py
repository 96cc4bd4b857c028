"""Paragraph elements, sections, breadcrumbs and context blocks, over rows in reading order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamstone.functions.text import clean_element, is_heading, strip


def paragraphs(docs: DataFrame, sep: str = "\n\n") -> DataFrame:
    """(doc, pos, kind, text) of docs (doc, text): stripped non-empty parts; short first parts and marked ones are headings."""
    parts = F.filter(F.transform(F.split("text", sep), strip), lambda x: x != "")
    p = docs.select("doc", F.posexplode(parts).alias("pos", "p"))
    head = (F.length("p") < 80) & ~F.col("p").endswith(".") & (F.col("p").startswith("#") | (F.col("pos") == 0))
    return p.select("doc", "pos", F.when(head, "HEADING").otherwise("PARAGRAPH").alias("kind"), strip(F.regexp_replace("p", r"^#+", "")).alias("text"))


def _parts(docs: DataFrame, sep: str) -> DataFrame:
    """(doc, parts): each document's elements as one array of (kind, text)."""
    head = lambda x, i: (F.length(x) < 80) & ~x.endswith(".") & (x.startswith("#") | (i == 0))
    found = docs.select("doc", F.filter(F.transform(F.split("text", sep), strip), lambda x: x != "").alias("ps"))
    return found.select("doc", F.transform("ps", lambda x, i: F.struct(F.when(head(x, i), "HEADING").otherwise("PARAGRAPH").alias("kind"), strip(F.regexp_replace(x, r"^#+", "")).alias("text"))).alias("parts")).where(F.size("parts") > 0)


def _stretches(starts: Column, n: Column) -> Column:
    """Of ascending starts, each with where it ends (before the next, or at ``n``)."""
    return F.transform(starts, lambda s, k: F.struct(s.alias("start"), F.coalesce(F.get(starts, k + 1), n).alias("stop")))


def document_parents(docs: DataFrame, sep: str = "\n\n") -> DataFrame:
    """(doc, pos, kind, parent_pos) of docs (doc, text), as ``with_parents`` gives it; a document is one row, so nothing is shuffled."""
    d = _parts(docs, sep).withColumn("n", F.size("parts"))
    heads = F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get("parts", i)["kind"] == "HEADING")
    d = d.withColumn("starts", heads)
    d = d.withColumn("starts", F.when(F.coalesce(F.get("starts", F.lit(0)), F.lit(-1)) == 0, F.col("starts")).otherwise(F.concat(F.array(F.lit(0)), "starts")))
    rows = F.flatten(
        F.transform(
            _stretches(F.col("starts"), F.col("n")),
            lambda s: F.transform(
                F.sequence(s["start"], s["stop"] - 1),
                lambda i: F.struct(
                    i.alias("pos"), F.get("parts", i)["kind"].alias("kind"),
                    F.when((i > s["start"]) & (F.get("parts", s["start"])["kind"] == "HEADING"), s["start"]).alias("parent_pos"),
                ),
            ),
        )
    )
    return d.select("doc", F.inline(rows))


def document_sections(docs: DataFrame, sep: str = "\n\n") -> DataFrame:
    """(doc, section, breadcrumb, n, text) of docs (doc, text): sections from one heading to the next, cut out of the document's own row.

    What comes before the first heading is section 0, under a general breadcrumb.
    """
    d = _parts(docs, sep).withColumn("n", F.size("parts"))
    heads = F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda i: is_heading(F.get("parts", i)["kind"], F.get("parts", i)["text"]))
    d = d.withColumn("heads", heads)
    d = d.withColumn("led", F.coalesce(F.get("heads", F.lit(0)), F.lit(-1)) == 0)
    d = d.withColumn("starts", F.when(F.col("led"), F.col("heads")).otherwise(F.concat(F.array(F.lit(0)), "heads")))
    d = d.select("doc", "parts", "led", F.posexplode(_stretches(F.col("starts"), F.col("n"))).alias("k", "s"))
    inside = F.slice("parts", F.col("s.start") + 1, F.col("s.stop") - F.col("s.start"))
    section = F.col("k") + F.col("led").cast("int")
    crumb = F.when(section > 0, strip(F.regexp_replace(F.get("parts", F.col("s.start"))["text"], r"^[# ]+|[# ]+$", ""))).otherwise(F.lit("General Document Content"))
    text = F.array_join(F.filter(F.transform(inside, lambda x: x["text"]), lambda x: x != ""), "\n")
    return d.select("doc", section.alias("section"), crumb.alias("breadcrumb"), (F.col("s.stop") - F.col("s.start")).cast("long").alias("n"), text.alias("text"))


def with_parents(elements: DataFrame) -> DataFrame:
    """Position of the last heading before each element of (doc, pos, kind, text); headings are roots."""
    w = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("kind") == "HEADING", F.col("pos")), True).over(w)
    return elements.withColumn("parent_pos", F.when(F.col("kind") != "HEADING", last))


def with_sections(elements: DataFrame, marks: Column | None = None) -> DataFrame:
    """Section number and breadcrumb of each element: a new section begins at every heading."""
    marks = is_heading(F.col("kind"), F.col("text")) if marks is None else marks
    w = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    e = elements.withColumn("is_heading", marks)
    e = e.withColumn("section", F.sum(F.col("is_heading").cast("int")).over(w))
    crumb = F.last(F.when(F.col("is_heading"), strip(F.regexp_replace("text", r"^[# ]+|[# ]+$", ""))), True).over(w)
    return e.withColumn("breadcrumb", F.coalesce(crumb, F.lit("General Document Content")))


def section_texts(sections: DataFrame) -> DataFrame:
    """(doc, section, breadcrumb, n, text): the texts of each section, joined in order."""
    ordered = F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("pos", "text"))))
    return sections.groupBy("doc", "section", "breadcrumb").agg(F.count("*").alias("n"), F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("text"))


def context(blocks: DataFrame) -> DataFrame:
    """(query_id, context): per query the distinct section texts of its hits in rank order, each under its breadcrumb.

    Blocks (query_id, rank, text, breadcrumb), and section where a hit has several: a text seen at a better rank isn't repeated. A query's hits are few (top k).
    """
    blocks = blocks if "section" in blocks.columns else blocks.withColumn("section", F.lit(0))
    w = Window.partitionBy("query_id", "text").orderBy("rank", "section")
    once = blocks.withColumn("rn", F.row_number().over(w)).where("rn = 1")
    block = F.when(F.coalesce("breadcrumb", F.lit("")) != "", F.concat(F.lit("[Category: "), "breadcrumb", F.lit("]\n"), "text")).otherwise(F.col("text"))
    ordered = F.array_sort(F.collect_list(F.struct("rank", "section", block.alias("b"))))
    return once.groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda x: x["b"]), "\n\n---\n\n").alias("context"))


def within_budget(hits: DataFrame, sections: DataFrame, chars: int) -> DataFrame:
    """Blocks for ``context``: of the sections (doc, section, breadcrumb, text) of hits (query_id, id, rank) those that begin within the first ``chars`` characters.

    Places are found by lengths and digests alone, so that only texts that come into a context are moved.
    """
    meta = sections.select(F.col("doc").alias("id"), "section", F.md5("text").alias("digest"), (F.length("text") + F.when(F.col("breadcrumb") != "", F.length("breadcrumb") + len("[Category: ]\n")).otherwise(0) + len("\n\n---\n\n")).alias("n"))
    placed = hits.join(meta, "id")
    once = placed.withColumn("rn", F.row_number().over(Window.partitionBy("query_id", "digest").orderBy("rank", "section"))).where("rn = 1")
    before = F.sum("n").over(Window.partitionBy("query_id").orderBy("rank", "section").rowsBetween(Window.unboundedPreceding, -1))
    kept = once.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < chars).select("query_id", "rank", F.col("id").alias("doc"), "section")
    return kept.join(sections.select("doc", "section", "breadcrumb", "text"), ["doc", "section"]).select("query_id", "rank", "section", "text", "breadcrumb")


#: Bytes above which a file isn't read.
LARGEST_FILE = 100 * 1024 * 1024


def ingest(files: DataFrame, sep: str = "\n\n") -> DataFrame:
    """One row a file of (doc, filename, text): (doc, filename, size, problem, elements), through validation, parsing, cleaning and layout.

    ``elements`` holds (pos, kind, text, section, breadcrumb, parent_pos) in reading order. A file that is missing, empty or too
    large has a ``problem`` and no elements; one without any text has none either, and no problem.
    """
    f = files.select("doc", "filename", F.octet_length("text").alias("size"), F.coalesce("text", F.lit("")).alias("text"))
    problem = F.when(F.col("size").isNull(), F.lit("missing")).when(F.col("size") == 0, F.lit("empty")).when(F.col("size") > LARGEST_FILE, F.lit("too large"))
    head = lambda x, i: (F.length(x) < 80) & ~x.endswith(".") & (x.startswith("#") | (i == 0))
    f = f.select("doc", "filename", "size", problem.alias("problem"), F.filter(F.transform(F.split(F.when(problem.isNull(), F.col("text")).otherwise(F.lit("")), sep), strip), lambda x: x != "").alias("ps"))
    parsed = F.transform("ps", lambda x, i: F.struct(F.when(head(x, i), "HEADING").otherwise("PARAGRAPH").alias("kind"), clean_element(strip(F.regexp_replace(x, r"^#+", ""))).alias("text")))
    f = f.select("doc", "filename", "size", "problem", F.filter(parsed, lambda p: p["text"] != "").alias("parts")).withColumn("n", F.size("parts"))
    places = F.when(F.col("n") > 0, F.sequence(F.lit(0), F.col("n") - 1)).otherwise(F.array().cast("array<int>"))

    def starts(marks: Column) -> Column:
        found = F.filter(places, lambda i: F.get(marks, i))
        return F.when(F.coalesce(F.get(marks, F.lit(0)), F.lit(True)), found).otherwise(F.concat(F.array(F.lit(0)), found))

    f = f.withColumn("heads", F.transform("parts", lambda p: is_heading(p["kind"], p["text"]))).withColumn("kinds", F.transform("parts", lambda p: p["kind"] == "HEADING"))
    f = f.withColumn("s", _stretches(starts(F.col("heads")), F.col("n"))).withColumn("k", _stretches(starts(F.col("kinds")), F.col("n")))
    over = lambda stretches, make: F.flatten(F.transform(stretches, lambda s, j: F.transform(F.sequence(s["start"], s["stop"] - 1), lambda i: make(s["start"], j, i))))
    f = f.withColumn("parents", over(F.col("k"), lambda a, j, i: F.when((i > a) & F.get("kinds", a), a)))
    first = F.coalesce(F.get("heads", F.lit(0)), F.lit(False)).cast("int")
    title = lambda a: F.when(F.get("heads", a), strip(F.regexp_replace(F.get("parts", a)["text"], r"^[# ]+|[# ]+$", ""))).otherwise(F.lit("General Document Content"))
    return f.select(
        "doc", "filename", "size", "problem",
        over(F.col("s"), lambda a, j, i: F.struct(i.alias("pos"), F.get("parts", i)["kind"].alias("kind"), F.get("parts", i)["text"].alias("text"), (j + first).alias("section"), title(a).alias("breadcrumb"), F.get("parents", i).alias("parent_pos"))).alias("elements"),
    )


def documents_of(ingested: DataFrame) -> DataFrame:
    """(doc, element_id, kind, section, breadcrumb, parent_id, text, is_fallback): what is indexed; a file without text has one notice."""
    e = ingested.where("problem is null").select("doc", "filename", F.explode_outer("elements").alias("e"))
    name = lambda c: F.when(c.isNotNull(), F.concat_ws(":", F.col("doc").cast("string"), c.cast("string")))
    notice = F.concat(F.lit("[Document: "), "filename", F.lit(" - No extractable text content]"))
    return e.select(
        "doc", F.coalesce(name(F.col("e.pos")), F.col("filename")).alias("element_id"), "e.kind", "e.section", "e.breadcrumb", name(F.col("e.parent_pos")).alias("parent_id"),
        F.coalesce("e.text", notice).alias("text"), F.col("e").isNull().alias("is_fallback"),
    )
