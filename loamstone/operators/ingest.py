"""File checks and the choice of parsers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UPLOAD_LIMIT, INGEST_LIMIT = 50 * 1024 * 1024, 100 * 1024 * 1024
# First bytes (hex) and types, in order; extensions by treatment.
MAGIC = (
    ("25504446", "application/pdf"), ("89504E47", "image/png"), ("FFD8FF", "image/jpeg"), ("47494638", "image/gif"),
    ("49492A00", "image/tiff"), ("4D4D002A", "image/tiff"), ("504B0304", "application/zip"),
)
ALLOWED = (".pdf", ".txt", ".docx", ".doc", ".pptx", ".ppt", ".xlsx", ".xls", ".png", ".jpg", ".jpeg", ".bmp", ".tiff", ".html", ".md", ".csv", ".json")
DENIED = (".exe", ".py", ".sh", ".php", ".js", ".bat", ".vbs", ".dll", ".cmd", ".ps1", ".jar")
TEXT_LIKE = (".txt", ".md", ".csv", ".json", ".html", ".xml")
OPEN_OFFICE = (".docx", ".pptx", ".xlsx")
OFFICE = (".docx", ".pptx", ".xlsx", ".xls")
IMAGES = (".png", ".jpg", ".jpeg", ".tiff", ".bmp")
#: Files for the branches of the checks: path, size, first bytes in hex, rank among the day's uploads.
PROBE_FILES = (
    ("/u/a.pdf", 1000, "255044462d312e37", 1), ("/u/b.pdf", 1000, "504b030414000600", 2), ("/u/c.docx", 2000, "504b030414000600", 3), ("/u/d.docx", 2000, "255044462d312e37", 4), ("/u/e.exe", 10, "4d5a900003000000", 5),
    ("/u/f", 10, "68656c6c6f20776f", 6), ("/u/g.zip", 10, "504b030414000600", 7), ("/u/h.txt", 0, "", 8), ("/u/i.png", 60000000, "89504e470d0a1a0a", 9), ("/u/j.json", 120000000, "7b2261223a317d0a", 10), ("/u/k.md", 12, "2320546974656c0a", 11), ("/u/l.tiff", 12, "4d4d002a00000008", 3),
)


def candidates(ext: Column, scanned: Column) -> Column:
    """Parsers to try for a file, in order."""
    a = lambda *xs: F.array(*[F.lit(f"{x}ParserStrategy") for x in xs])
    return (
        F.when(ext.isin(*IMAGES), a("OCR", "Text")).when((ext == ".pdf") & scanned, a("OCR", "PDF", "Text")).when(ext == ".pdf", a("PDF", "OCR", "Text"))
        .when(ext.isin(*OFFICE), a("Office", "OCR", "Text")).otherwise(a("Text"))
    )


def validate_file(size: Column, head_hex: Column, ext: Column) -> Column:
    """Struct(mime, problem); a text-like extension outranks the first bytes."""
    magic = F.when(F.lit(False), F.lit(""))
    for h, m in MAGIC:
        magic = magic.when(F.startswith(head_hex, F.lit(h)), F.lit(m))
    magic = magic.otherwise(F.lit("text/plain"))
    name = F.substring(ext, 2, 20)
    problem = F.when(size == 0, F.lit("empty")).when(size > INGEST_LIMIT, F.lit("too large"))
    mime = (
        F.when(problem.isNotNull(), F.lit("unknown")).when(ext.isin(*TEXT_LIKE), F.concat(F.lit("text/"), name))
        .when(ext.isin(*OPEN_OFFICE) & (magic == "application/zip"), F.concat(F.lit("application/vnd.openxmlformats-officedocument."), name)).otherwise(magic)
    )
    return F.struct(mime.alias("mime"), problem.alias("problem"))


def gate(size: Column, head_hex: Column, ext: Column, rank: Column, limit: int) -> Column:
    """Why an upload is refused; the first reason in this order."""
    return (
        F.when(rank > limit, F.lit("limit")).when(size > UPLOAD_LIMIT, F.lit("too large")).when(ext == "", F.lit("no extension")).when(ext.isin(*DENIED), F.lit("denied")).when(~ext.isin(*ALLOWED), F.lit("not allowed"))
        .when((ext == ".pdf") & ~F.startswith(head_hex, F.lit("255044462D")), F.lit("bad signature")).when(ext.isin(*OPEN_OFFICE) & ~F.startswith(head_hex, F.lit("504B0304")), F.lit("bad signature"))
    )


def fallback_choice(attempts: DataFrame, key: str) -> DataFrame:
    """First successful attempt of each key, else the most confident one; attempts carry ord, status, confidence, strategy.

    Confidence below a half counts as no success. Ties go to the earlier attempt; NULL confidence is the least.
    """
    ok = (F.col("status") == "SUCCESS") & (F.coalesce("confidence", F.lit(1.0)) >= 0.5)
    w = Window.partitionBy(key).orderBy(F.when(ok, 0).otherwise(1), F.when(ok, F.col("ord")), F.coalesce("confidence", F.lit(-1.0)).desc(), "ord")
    return attempts.withColumn("rn", F.row_number().over(w)).where("rn = 1").select(key, "strategy", "status", F.col("confidence"), "ord")
