"""Scans of document files: plain text, HTML, and the zip formats whose text is XML.

Files are found by Spark's own reader and read on executors; a task holds one file at a time. A file that cannot
be read gives no text and an error, never a failed job; blank texts are left out by ``load``.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import doc_hash
from lectern.operators.registry import FORMATS, suffix

# Elements without visible text, and namespaces of the formats.
SILENT = ("script", "style", "nav", "footer")
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
OPEN_TEXT = "{urn:oasis:names:tc:opendocument:xmlns:text:1.0}"
SCHEMA = "path string, modified timestamp, size long, text string, error string"


class Visible(HTMLParser):
    """Lines of visible text; headings become # of their level."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[str] = []
        self.title = ""
        self.silent = 0
        self.mark = ""
        self.in_title = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.silent += tag in SILENT
        self.in_title |= tag == "title"
        if re.fullmatch("h[1-6]", tag):
            self.mark = "#" * int(tag[1]) + " "

    def handle_endtag(self, tag: str) -> None:
        self.silent -= tag in SILENT and self.silent > 0
        if tag == "title":
            self.in_title = False
        if re.fullmatch("h[1-6]", tag):
            self.mark = ""

    def handle_data(self, data: str) -> None:
        words = " ".join(data.split())
        if self.in_title:
            self.title += words
        elif words and not self.silent:
            self.lines.append(self.mark + words)


def from_html(raw: bytes) -> str:
    page = Visible()
    page.feed(raw.decode("utf-8", "ignore"))
    return "\n".join(page.lines).strip()


def from_docx(raw: bytes) -> str:
    """Paragraphs; the styles Heading 1 to 3 become # of their level."""
    with zipfile.ZipFile(io.BytesIO(raw)) as archive:
        body = ElementTree.fromstring(archive.read("word/document.xml"))
    out = []
    for paragraph in body.iter(f"{WORD}p"):
        text = "".join(t.text or "" for t in paragraph.iter(f"{WORD}t"))
        style = paragraph.find(f"{WORD}pPr/{WORD}pStyle")
        level = re.fullmatch(r"Heading ?([1-3])", style.get(f"{WORD}val", "")) if style is not None else None
        if text.strip():
            out.append(("#" * int(level[1]) + " " if level else "") + text)
    return "\n\n".join(out)


def from_odt(raw: bytes) -> str:
    """Paragraphs with text of their own, apart by blank lines."""
    with zipfile.ZipFile(io.BytesIO(raw)) as archive:
        body = ElementTree.fromstring(archive.read("content.xml"))
    return "\n\n".join(p.text.strip() for p in body.iter(f"{OPEN_TEXT}p") if p.text and p.text.strip())


def from_epub(raw: bytes) -> str:
    """The book's title as first heading, then the visible text of its pages in the order of the archive."""
    with zipfile.ZipFile(io.BytesIO(raw)) as archive:
        names = archive.namelist()
        title = ""
        for name in names:
            if name.endswith(".opf"):
                found = ElementTree.fromstring(archive.read(name)).find(".//{http://purl.org/dc/elements/1.1/}title")
                title = (found.text or "").strip() if found is not None else ""
        pages = [from_html(archive.read(n)) for n in names if n.endswith((".xhtml", ".html", ".htm"))]
    return "\n\n".join([f"# {title}"] * bool(title) + [p for p in pages if p])


def from_rtf(raw: bytes) -> str:
    """Text of a rich text file: paragraphs end at its own mark, control words and groups of settings go."""
    text = raw.decode("latin-1")
    for k, escaped in enumerate(("\\\\", "\\{", "\\}")):  # put aside until the marks are gone
        text = text.replace(escaped, chr(k + 1))
    text = re.sub(r"\{\\(?:\*|fonttbl|colortbl|stylesheet|info)[^{}]*(?:\{[^{}]*\}[^{}]*)*\}", "", text)
    text = re.sub(r"\\(?:par|line)\b ?", "\n", text)
    text = re.sub(r"\\'([0-9a-fA-F]{2})", lambda m: bytes([int(m[1], 16)]).decode("cp1252", "ignore"), text)
    text = re.sub(r"\\u(-?\d+) ?\??", lambda m: chr(int(m[1]) % 65536), text)
    text = re.sub(r"\\[a-z]+-?\d* ?|[{}]", "", text)
    return text.translate({1: "\\", 2: "{", 3: "}"}).strip()


READERS = {
    "md": lambda raw: raw.decode("utf-8", "ignore"),
    "txt": lambda raw: raw.decode("utf-8", "ignore"),
    "html": from_html,
    "htm": from_html,
    "docx": from_docx,
    "odt": from_odt,
    "epub": from_epub,
    "rtf": from_rtf,
}


def extract(files: DataFrame) -> DataFrame:
    """path, modified, size, text, error of files as Spark's binaryFile source gives them."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts: list[str | None] = []
            errors: list[str | None] = []
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
                read = READERS.get(path.rsplit(".", 1)[-1].lower())
                try:
                    text, error = (None, "no reader for this format") if read is None else (read(raw or b""), None)
                except Exception as problem:  # noqa: BLE001 - one bad file must not end the scan
                    text, error = None, " ".join(f"{type(problem).__name__}: {problem}".split())[:400]
                texts.append(re.sub(r"(?m)^\s*==>.*<==\s*\n?", "", text) if text else text)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=["path", "modified", "size", "text", "error"])

    return files.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"), "content").mapInArrow(run, SCHEMA)


def scan(spark: SparkSession, root: str) -> DataFrame:
    """All files below ``root`` of a format that can be named, with their text or an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return extract(files.filter(suffix(F.col("path")).isin(*FORMATS)))


def load(spark: SparkSession, root: str) -> DataFrame:
    """path, text, doc_hash of all files with a text."""
    return scan(spark, root).filter(F.trim("text") != "").select("path", "text", doc_hash(F.col("text")).alias("doc_hash"))
