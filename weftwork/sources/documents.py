"""Plain text, Markdown, note exports, printed pages and office files."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.functions import text as T

PARSED = "path string, text string, title string, author string, date string, subject string, recipients array<string>, metadata map<string,string>"


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, title, date): title is the first line if it is short, date the first ISO date in the name, then in the text."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    first = F.trim(F.regexp_extract("text", r"\A\s*([^\n]*)", 1))
    date = F.coalesce(*[F.nullif(F.regexp_extract(c, r"(\d{4}-\d{2}-\d{2})", 1), F.lit("")) for c in ("path", "text")])
    return rows.select("path", "text", F.when((first != "") & (F.length(first) <= 100), first).alias("title"), date.alias("date"))


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, title, front): the text without front matter, its fields as a map, and the title from there or the first heading."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("raw"))
    front = F.regexp_extract("raw", r"(?s)\A---\s*\n(.*?)\n---\s*(?:\n|\z)", 1)
    pairs = F.filter(F.split(front, "\n"), lambda line: line.rlike(r"^\s*[\w-]+\s*:"))
    fields = F.map_from_entries(F.transform(pairs, lambda line: F.struct(F.trim(F.regexp_extract(line, r"^\s*([\w-]+)\s*:", 1)), F.trim(F.regexp_replace(F.regexp_extract(line, r":(.*)$", 1), "^[\\s\"']+|[\\s\"']+$", "")))))
    body = F.regexp_replace("raw", r"(?s)\A---\s*\n.*?\n---\s*(?:\n|\z)", "")
    heading = F.nullif(F.trim(F.regexp_extract(body, r"(?m)^#\s+(.+)$", 1)), F.lit(""))
    return rows.select("path", body.alias("text"), F.coalesce(fields["title"], heading).alias("title"), fields.alias("front"))


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    """(path, note_id, title, text, links): pages of a note export, named "title 32-hex-id.md", with the wiki links in them."""
    rows = read_markdown(spark, path)
    name = F.url_decode(F.element_at(F.split("path", "/"), -1))
    return rows.select(
        "path", F.nullif(F.regexp_extract(name, r"([a-f0-9]{32})\.md$", 1), F.lit("")).alias("note_id"), F.coalesce("title", F.regexp_replace(name, r"\s*[a-f0-9]{32}\.md$|\.md$", "")).alias("title"), "text",
        F.array_distinct(F.regexp_extract_all("text", F.lit(r"\[\[([^\]|]+)"), F.lit(1))).alias("links"),
    )


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def docx_text(content: bytes) -> tuple[str, dict]:
    """Paragraphs and table rows of a word-processor file, in order, and its core properties."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
        inside = {id(p) for row in root.iter(f"{_W}tr") for p in row.iter(f"{_W}p")}
        plain = []
        for block in root.iter():
            if block.tag == f"{_W}tr":
                plain.append(" | ".join("".join(t.text or "" for t in cell.iter(f"{_W}t")) for cell in block.iter(f"{_W}tc")))
            elif block.tag == f"{_W}p" and id(block) not in inside:
                plain.append("".join(t.text or "" for t in block.iter(f"{_W}t")))
        props = {}
        if "docProps/core.xml" in z.namelist():
            props = {e.tag.rpartition("}")[2]: e.text or "" for e in ElementTree.fromstring(z.read("docProps/core.xml"))}
    return "\n".join(p for p in plain if p.strip()), props


def xlsx_rows(content: bytes) -> list[tuple[str, list[str]]]:
    """(sheet, cells) of each row of a spreadsheet."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        names = [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet")]
        out = []
        for k, name in enumerate(names, 1):
            for row in ElementTree.fromstring(z.read(f"xl/worksheets/sheet{k}.xml")).iter(f"{_S}row"):
                cells = []
                for c in row.iter(f"{_S}c"):
                    value = c.find(f"{_S}v")
                    text = "".join(t.text or "" for t in c.iter(f"{_S}t")) if c.get("t") == "inlineStr" else "" if value is None else value.text or ""
                    cells.append(shared[int(text)] if c.get("t") == "s" and text else text)
                out.append((name, cells))
    return out


def pdf_text(content: bytes) -> tuple[str, dict]:
    """Text of a PDF, pages divided by form feeds; needs the optional library pypdf."""
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise RuntimeError("reading PDF needs pypdf") from e
    reader = PdfReader(io.BytesIO(content))
    return "\f".join(p.extract_text() or "" for p in reader.pages), {"pages": str(len(reader.pages))}


def read_office(files: DataFrame) -> DataFrame:
    """(path, text, title, author, metadata, error) of docx, xlsx and pdf files (path, content); what can't be read has its error."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    low = path.lower()
                    if low.endswith(".docx"):
                        text, props = docx_text(bytes(content))
                    elif low.endswith((".xlsx", ".xlsm")):
                        text, props = "\n".join(f"{sheet}: " + " | ".join(cells) for sheet, cells in xlsx_rows(bytes(content))), {}
                    else:
                        text, props = pdf_text(bytes(content))
                    rows.append((path, text, props.get("title"), props.get("creator"), props, None))
                except Exception as e:  # noqa: BLE001 - a broken file is a row, not the end of the job
                    rows.append((path, None, None, None, {}, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "text", "title", "author", "metadata", "error"])

    return files.select("path", "content").mapInPandas(parse, "path string, text string, title string, author string, metadata map<string,string>, error string").withColumn(
        "text", F.when(F.col("path").endswith(".pdf"), T.clean_pages(F.col("text"))).otherwise(F.col("text"))
    )


def load(documents: DataFrame, source_type: str | None = None, since: str | None = None, until: str | None = None, themes: list[str] | None = None, source_id: str | None = None) -> DataFrame:
    """Documents or insights of a store, filtered; every filter is a predicate the scan can take."""
    out = documents
    if source_type:
        out = out.where(F.col("source") == source_type)
    if source_id:
        out = out.where(F.col("source_ref") == source_id)
    if since:
        out = out.where(F.col("created_at") >= F.lit(since).cast("timestamp"))
    if until:
        out = out.where(F.col("created_at") <= F.lit(until).cast("timestamp"))
    if themes:
        out = out.where(F.arrays_overlap("themes", F.array(*[F.lit(t) for t in themes])))
    return out

