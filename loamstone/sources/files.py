"""Reading uploaded files of any kind into elements, with parsers as plug-ins and fallbacks between them."""

from __future__ import annotations

import importlib.util
import io
import re
import shutil
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ELEMENT = "path string, pos int, element_type string, text string, page int, confidence double, parser_name string, status string"
#: (element_type, text, page, confidence) of the content of one file.
Parser = Callable[[bytes, str], list[tuple[str, str, int, float]]]
_REGISTRY: dict[str, Parser] = {}


def register(name: str) -> Callable[[Parser], Parser]:
    def put(f: Parser) -> Parser:
        _REGISTRY[name] = f
        return f

    return put


def parser(name: str) -> Parser:
    if name not in _REGISTRY:
        raise KeyError(f"no parser is registered as {name}")
    return _REGISTRY[name]


def has_parser(name: str) -> bool:
    return name in _REGISTRY


def capabilities() -> dict[str, dict[str, bool]]:
    """What this machine can use, by category."""
    have = lambda m: importlib.util.find_spec(m) is not None
    return {
        "ocr": {"tesseract": shutil.which("tesseract") is not None and have("pytesseract"), "unstructured": have("unstructured")},
        "pdf": {"pymupdf": have("fitz"), "pypdf": have("pypdf")},
        "office": {"docx": True, "pptx": True, "xlsx": True},  # read from their XML here
    }


def best_available(category: str, priority: list[str]) -> str | None:
    states = capabilities().get(category, {})
    return next((p for p in priority if states.get(p)), None)


@register("TextParserStrategy")
def parse_text(content: bytes, path: str) -> list[tuple[str, str, int, float]]:
    """Paragraphs between blank lines; a short first one, or one with a mark, is a heading."""
    out = []
    parts = [p.strip() for p in content.decode("utf-8", "replace").split("\n\n")]
    for i, p in enumerate(p for p in parts if p):
        head = len(p) < 80 and not p.endswith(".") and (p.startswith("#") or i == 0)
        out.append(("HEADING" if head else "PARAGRAPH", p.lstrip("#").strip(), 1, 1.0))
    return out


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_X = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _cells(rows: list[list[str]]) -> str:
    return "\n".join(" | ".join(r) for r in rows if any(c.strip() for c in r))


@register("OfficeParserStrategy")
def parse_office(content: bytes, path: str) -> list[tuple[str, str, int, float]]:
    """Documents, slides and sheets, read from the XML in their containers."""
    z = zipfile.ZipFile(io.BytesIO(content))
    names = z.namelist()
    out: list[tuple[str, str, int, float]] = []
    if "word/document.xml" in names:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        n = 0
        for el in body if body is not None else []:
            if el.tag == f"{_W}p":
                text = "".join(t.text or "" for t in el.iter(f"{_W}t")).strip()
                if text:
                    style = el.find(f"{_W}pPr/{_W}pStyle")
                    head = n == 0 or style is not None and (style.get(f"{_W}val") or "").startswith("Heading")
                    out.append(("HEADING" if head else "PARAGRAPH", text, 1, 0.98))
                    n += 1
            elif el.tag == f"{_W}tbl":
                rows = [["".join(t.text or "" for t in c.iter(f"{_W}t")).strip() for c in r.iter(f"{_W}tc")] for r in el.iter(f"{_W}tr")]
                if text := _cells(rows):
                    out.append(("TABLE", text, 1, 0.95))
    elif any(n.startswith("ppt/slides/slide") for n in names):
        slides = sorted((n for n in names if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))  # type: ignore[index]
        for page, n in enumerate(slides, 1):
            for body in ElementTree.fromstring(z.read(n)).iter():
                if body.tag.endswith("}txBody"):
                    text = "\n".join("".join(t.text or "" for t in p.iter(f"{_A}t")) for p in body.iter(f"{_A}p")).strip()
                    if text:
                        out.append(("PARAGRAPH", text, page, 0.95))
    elif "xl/workbook.xml" in names:
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in s.iter(f"{_X}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_X}si")]
        titles = [s.get("name") or "" for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_X}sheet")]
        for page, title in enumerate(titles, 1):
            if f"xl/worksheets/sheet{page}.xml" not in names:
                continue
            rows = []
            for r in ElementTree.fromstring(z.read(f"xl/worksheets/sheet{page}.xml")).iter(f"{_X}row"):
                row = []
                for c in r.iter(f"{_X}c"):
                    v, inline = c.find(f"{_X}v"), "".join(t.text or "" for t in c.iter(f"{_X}t"))
                    raw = v.text or "" if v is not None else inline
                    row.append(shared[int(raw)] if c.get("t") == "s" and raw.isdigit() and int(raw) < len(shared) else raw)
                rows.append(row)
            if text := _cells(rows):
                out.append(("TABLE", f"Sheet: {title}\n{text}", page, 0.95))
    return out


@register("PDFParserStrategy")
def parse_pdf(content: bytes, path: str) -> list[tuple[str, str, int, float]]:
    """Paragraphs by page where a PDF library is installed; else nothing, so that the next parser is tried."""
    if importlib.util.find_spec("fitz"):
        import fitz

        out = []
        for page, p in enumerate(fitz.open(stream=content, filetype="pdf"), 1):
            out += [("PARAGRAPH", t.strip(), page, 0.95) for t in p.get_text().split("\n\n") if t.strip()]
        return out
    if importlib.util.find_spec("pypdf"):
        import pypdf

        pages = ((i, p.extract_text().strip()) for i, p in enumerate(pypdf.PdfReader(io.BytesIO(content)).pages, 1))
        return [("PARAGRAPH", t, i, 0.85) for i, t in pages if t]
    return []


@register("OCRParserStrategy")
def parse_image(content: bytes, path: str) -> list[tuple[str, str, int, float]]:
    """Text of an image where an OCR program is installed; else nothing."""
    if not capabilities()["ocr"]["tesseract"]:
        return []
    import pytesseract
    from PIL import Image

    text = pytesseract.image_to_string(Image.open(io.BytesIO(content))).strip()
    return [("PARAGRAPH", text, 1, 0.75)] if text else []


def parse_with_fallback(content: bytes, path: str, names: list[str]) -> tuple[list[tuple[str, str, int, float]], str | None, str]:
    """Elements, parser and status: the first parser with a confidence of a half or more, else the most confident."""
    best: tuple[list[tuple[str, str, int, float]], str | None, str] = ([], None, "FAILED")
    most = -1.0
    for name in names:
        if not has_parser(name):
            continue
        try:
            got = parser(name)(content, path)
        except Exception:  # a parser that fails is one fallback more, whatever went wrong in it
            continue
        sure = sum(e[3] for e in got) / len(got) if got else 0.0
        if got and sure >= 0.5:
            return got, name, "SUCCESS"
        if sure > most:
            best, most = (got, name, "LOW_CONFIDENCE"), sure
    return best


def load_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Elements of all files under a folder. A file without any gives one row that says so, with status NULL text kept visible."""
    from loamstone.functions.text import file_extension
    from loamstone.operators.ingest import candidates

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    todo = files.select("path", "content", candidates(file_extension(F.col("path")), F.lit(False)).alias("names"))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for p, content, names in zip(pdf["path"], pdf["content"], pdf["names"]):
                got, name, status = parse_with_fallback(bytes(content), p, list(names))
                if not got:
                    title = p.rsplit("/", 1)[-1]
                    out.append((p, 0, "UNKNOWN", f"[Document: {title} - No extractable text content]", None, 0.0, name, status))
                out += [(p, i, kind, text, page, sure, name, status) for i, (kind, text, page, sure) in enumerate(got)]
            made = pd.DataFrame(out, columns=["path", "pos", "element_type", "text", "page", "confidence", "parser_name", "status"])
            made["page"] = made["page"].astype("Int32")
            yield made

    return todo.mapInPandas(parse, ELEMENT)


def literal_text(spark: SparkSession, text: str, **metadata: str) -> DataFrame:
    return spark.createDataFrame([(text, metadata)], "text string, metadata map<string,string>")
