"""Rules for answers in Markdown, line by line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamstone.functions.text import category, contains_any, strip

SKILL_HEADS = ("### skills", "### technical skills", "### tools", "### tech stack")


def lines(df: DataFrame) -> DataFrame:
    """(id, n, line) of (id, t)."""
    return df.select("id", F.posexplode(F.split(F.coalesce("t", F.lit("")), "\n")).alias("n", "line"))


def spaced_bullets(df: DataFrame) -> DataFrame:
    """(id, n, line, gap): whether a blank line goes before a bullet, so that no more than five follow each other."""
    trimmed = strip(F.col("line"))
    rows = lines(df).withColumn("bullet", trimmed.startswith("- ") | trimmed.startswith("* "))
    w = Window.partitionBy("id").orderBy("n")
    rows = rows.withColumn("island", F.sum(F.when(F.col("bullet"), 0).otherwise(1)).over(w))
    place = F.row_number().over(Window.partitionBy("id", "island", "bullet").orderBy("n"))
    return rows.withColumn("place", place).select("id", "n", "line", (F.col("bullet") & (F.col("place") > 1) & (F.pmod(F.col("place") - 1, F.lit(5)) == 0)).alias("gap"))


def badge_items(df: DataFrame) -> DataFrame:
    """(id, n, items): the items of lists under a skills header, where a line has three or more."""
    trimmed = strip(F.col("line"))
    rows = lines(df).withColumn("t", trimmed)
    opens, closes = contains_any(F.lower("t"), SKILL_HEADS), F.col("t").startswith("### ") | F.col("t").startswith("## ")
    w = Window.partitionBy("id").orderBy("n")
    rows = rows.withColumn("inside", F.coalesce(F.last(F.when(opens, True).when(closes, False), True).over(w), F.lit(False)) & ~opens & ~closes)
    items = F.filter(F.transform(F.split("t", r"[,:\-*]"), strip), lambda x: x != "")
    listed = F.col("t").startswith("- ") | F.col("t").contains(",") | F.col("t").contains(":")
    return rows.where(F.col("inside") & listed).select("id", "n", items.alias("items")).where(F.size("items") >= 3)


def badges(items: DataFrame) -> DataFrame:
    """(id, n, category, badges): a line's items by category, in order of appearance."""
    rows = items.select("id", "n", F.posexplode("items").alias("k", "raw")).withColumn("item", F.regexp_replace("raw", r"^[,.*\-]+|[,.*\-]+$", "")).where("item <> ''")
    rows = rows.withColumn("category", category(F.col("item")))
    ordered = F.array_sort(F.collect_list(F.struct("k", "item")))
    return rows.groupBy("id", "n", "category").agg(F.array_join(F.transform(ordered, lambda x: F.concat(F.lit("`"), x["item"], F.lit("`"))), " ").alias("badges"))


def _runs(marks: Column, n: Column) -> Column:
    """Stretches from each marked line to the next; what comes before the first is one as well, from -1 on."""
    starts = F.concat(F.array(F.lit(-1)), F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get(marks, i)))
    return F.transform(starts, lambda s, k: F.struct(s.alias("start"), F.coalesce(F.get(starts, k + 1), n).alias("stop")))


def _badge_lines(line: Column) -> Column:
    """The lines that take the place of a list of three or more: one a category, in order of appearance. NULL for other lines."""
    t = strip(line)
    raw = F.filter(F.transform(F.split(t, r"[,:\-*]"), strip), lambda x: x != "")
    items = F.filter(F.transform(raw, lambda x: F.regexp_replace(x, r"^[,.*\-]+|[,.*\-]+$", "")), lambda x: x != "")
    known = F.transform(items, lambda x: F.struct(category(x).alias("c"), x.alias("x")))
    cats = F.array_distinct(F.transform(known, lambda k: k["c"]))
    pills = lambda c: F.array_join(F.transform(F.filter(known, lambda k: k["c"] == c), lambda k: F.concat(F.lit("`"), k["x"], F.lit("`"))), " ")
    listed = (t.startswith("- ") | t.contains(",") | t.contains(":")) & (F.size(raw) >= 3)
    return F.when(listed, F.transform(cats, lambda c: F.concat(F.lit("- **"), c, F.lit("**: "), pills(c))))


def with_badges(df: DataFrame) -> DataFrame:
    """(id, lines, ...) of (id, lines, ...): lists under a skills header written as badges. A text is one row, so nothing is shuffled."""
    opens = F.transform("lines", lambda x: contains_any(F.lower(strip(x)), SKILL_HEADS))
    heads = F.transform("lines", lambda x: contains_any(F.lower(strip(x)), SKILL_HEADS) | strip(x).startswith("### ") | strip(x).startswith("## "))
    d = df.withColumn("opens", opens).withColumn("heads", heads).withColumn("n", F.size("lines"))
    first = lambda s: (s["start"] < 0) & (s["stop"] == 0)
    runs = F.filter(_runs(F.col("heads"), F.col("n")), lambda s: ~first(s))
    made = F.transform(runs, lambda s: F.flatten(F.transform(
        F.sequence(F.greatest(s["start"], F.lit(0)), s["stop"] - 1),
        lambda i: F.when((i > s["start"]) & (s["start"] >= 0) & F.coalesce(F.get("opens", s["start"]), F.lit(False)), F.coalesce(_badge_lines(F.get("lines", i)), F.array(F.get("lines", i)))).otherwise(F.array(F.get("lines", i))),
    )))
    return d.withColumn("lines", F.flatten(made)).drop("opens", "heads", "n")


def with_rhythm(df: DataFrame) -> DataFrame:
    """(id, lines, ...): a blank line in long runs of bullets, so that no more than five follow each other."""
    plain = F.transform("lines", lambda x: ~(strip(x).startswith("- ") | strip(x).startswith("* ")))
    d = df.withColumn("plain", plain).withColumn("n", F.size("lines"))
    runs = F.filter(_runs(F.col("plain"), F.col("n")), lambda s: ~((s["start"] < 0) & (s["stop"] == 0)))
    out = F.transform(
        runs,
        lambda s: F.transform(
            F.sequence(F.greatest(s["start"], F.lit(0)), s["stop"] - 1),
            lambda i: F.when((i - s["start"] > 1) & (F.pmod(i - s["start"] - 1, F.lit(5)) == 0), F.concat(F.lit("\n"), F.get("lines", i))).otherwise(F.get("lines", i)),
        ),
    )
    return d.withColumn("lines", F.flatten(out)).drop("plain", "n")


def present(df: DataFrame) -> DataFrame:
    """(id, presented) of (id, t, render_header): headers repaired, skill lists as badges, long runs of bullets broken; the first H3 goes on a continued topic."""
    from loamstone.functions.text import repair_headers

    lines = df.select("id", "render_header", F.split(repair_headers(F.col("t")), "\n").alias("lines"))
    done = with_rhythm(with_badges(lines)).select("id", "render_header", strip(F.array_join("lines", "\n")).alias("p"))
    return done.select("id", F.when(F.col("render_header"), F.col("p")).otherwise(strip(F.regexp_replace("p", r"^###\s+[^\n]+\n+", ""))).alias("presented"))


STAGES = ("stage", "retrieved_chunks", "block_commit", "final_transformed", "error")


def stream_line(c: Column) -> Column:
    """Struct(kind, payload) of a line of an event stream; a line without a known prefix is a token."""
    chain = F.when(F.lit(False), F.lit(""))
    for kind in STAGES:
        chain = chain.when(c.startswith(f"{kind}:"), F.lit(kind))
    kind = chain.otherwise(F.lit("token"))
    return F.struct(kind.alias("kind"), F.when(kind == "token", c).otherwise(F.regexp_replace(c, r"^[a-z_]+:\s*", "")).alias("payload"))


def stream_events(df: DataFrame) -> DataFrame:
    """(id, seq, kind, payload) of (id, body): the data lines between blank lines."""
    parts = F.filter(F.transform(F.split("body", "\n\n"), lambda x: F.regexp_replace(x, r"^data: ?", "")), lambda x: x != "")
    return df.select("id", F.posexplode(parts).alias("seq", "line")).select("id", "seq", stream_line(F.col("line")).alias("e")).select("id", "seq", "e.kind", "e.payload")


def error_payload(c: Column) -> Column:
    """Struct(error, message, actions) of an answer that is a JSON object with an error, else NULL."""
    j = F.from_json(c, "error string, message string, actions array<string>")
    ok = strip(c).startswith("{") & strip(c).endswith("}") & c.contains('"error"') & j["error"].isNotNull()
    return F.when(ok, F.struct(j["error"].alias("error"), F.coalesce(j["message"], F.lit("")).alias("message"), F.coalesce(j["actions"], F.array().cast("array<string>")).alias("actions")))


def guard_verdict(c: Column) -> Column:
    """Struct(safe, reason) of a guard model's JSON; what can't be read is unsafe."""
    j = F.from_json(c, "safe boolean, reason string")
    return F.struct(F.coalesce(j["safe"], F.lit(False)).alias("safe"), F.coalesce(j["reason"], F.lit("unreadable")).alias("reason"))
