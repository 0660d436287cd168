"""Word files as blocks, read from a folder with Spark's binary files.

Each file is one row of bytes; the archive is opened inside the task that holds it, under limits on entries, size and expansion. Files that
can't be read give a row with the reason instead of blocks; Spark's reader leaves out files of no bytes. Only the body is read: paragraphs in order with style, list and table places.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Limits of an archive, and first bytes by which files are told apart.
MAX_ENTRIES, MAX_BYTES, MAX_RATIO, RATIO_FROM, MAX_FILE = 2000, 100 << 20, 200, 1 << 20, 20 << 20
ZIP, OLE = b"PK\x03\x04", b"\xd0\xcf\x11\xe0"
# Fixed value: the name space of the format's main part.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
WORDS_PER_PAGE = (80, 900)
SCHEMA = "path string, error string, ord int, kind string, level int, tbl int, row int, col int, text string"


def problem(content: Column, path: Column) -> Column:
    """What is wrong with a file by its first bytes and its name, null if nothing."""
    head = F.substring(content, 1, 4)
    return (
        F.when(F.octet_length(content) == 0, "EMPTY_DOCUMENT").when(F.octet_length(content) > MAX_FILE, "FILE_TOO_LARGE").when(head == F.lit(OLE), F.when(F.lower(path).endswith(".docx"), "PASSWORD_PROTECTED").otherwise("LEGACY_DOC_FORMAT"))
        .when(F.lower(path).endswith(".docm") | ~F.lower(path).endswith(".docx"), "UNSUPPORTED_FORMAT").when(head != F.lit(ZIP), "CORRUPTED_FILE")
    )


def plausible_pages(declared: Column, words: Column) -> Column:
    """A declared number of pages, if it makes pages of a usual size."""
    return F.when((declared > 0) & (words / declared).between(*WORDS_PER_PAGE), declared)


def open_part(content: bytes, name: str) -> bytes:
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        entries = archive.infolist()
        if len(entries) > MAX_ENTRIES or sum(e.file_size for e in entries) > MAX_BYTES or any(e.flag_bits & 1 for e in entries):
            raise ValueError("archive over the limits")
        if any(e.file_size > RATIO_FROM and e.file_size > MAX_RATIO * max(1, e.compress_size) for e in entries):
            raise ValueError("archive expands too much")
        data = archive.read(name)
    if re.search(rb"<!(?:DOCTYPE|ENTITY)", data):
        raise ValueError("declarations are refused")
    return data


def text_of(paragraph: ElementTree.Element) -> str:
    parts = []
    for node in paragraph.iter():
        if node.tag == W + "t":
            parts.append(node.text or "")
        elif node.tag in (W + "tab", W + "br"):
            parts.append("\t" if node.tag == W + "tab" else "\n")
    return "".join(parts)


def kind_of(paragraph: ElementTree.Element, in_table: bool) -> tuple[str, int | None]:
    style = paragraph.find(f"{W}pPr/{W}pStyle")
    name = (style.get(W + "val") or "").lower() if style is not None else ""
    level = re.match(r"(?:heading|titre) ?(\d)", name)
    if name.startswith(("toc", "tm")) and name[-1:].isdigit():
        return "toc_entry", None
    if in_table:
        return "table_cell", None
    if level or name in ("title", "titre"):
        return "heading", int(level[1]) if level else 1
    if name in ("caption", "lgende"):
        return "caption", None
    return ("list_item", None) if paragraph.find(f"{W}pPr/{W}numPr") is not None else ("paragraph", None)


def body_blocks(xml: bytes) -> Iterator[tuple]:
    """(kind, level, table, row, column, text) of every paragraph that isn't blank, in reading order."""
    table = 0
    for node in ElementTree.fromstring(xml).find(W + "body") or []:
        if node.tag == W + "p":
            places = [(node, None, None, None)]
        elif node.tag == W + "tbl":
            table += 1
            places = [(p, table, r, c) for r, row in enumerate(node.iter(W + "tr"), 1) for c, cell in enumerate(row.findall(W + "tc"), 1) for p in cell.iter(W + "p")]
        else:
            places = [(p, None, None, None) for p in node.iter(W + "p")]
        for paragraph, t, r, c in places:
            text = text_of(paragraph)
            if text.strip():
                yield (*kind_of(paragraph, t is not None), t, r, c, text)


def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
    for batch in batches:
        rows = []
        for path, content, error in zip(*(batch[c].to_pylist() for c in ("path", "content", "error")), strict=True):
            found = []
            if error is None:
                try:
                    found = list(body_blocks(open_part(content, "word/document.xml")))
                    error = None if found else "EMPTY_DOCUMENT"
                except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError):
                    error = "CORRUPTED_FILE"
            rows += [(path, None, i, *block) for i, block in enumerate(found)] if error is None else [(path, error, *[None] * 7)]
        columns = list(zip(*rows, strict=True)) or [[]] * len(types)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["path", "error", "ord", "kind", "level", "tbl", "row", "col", "text"])


def blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks of all files below a folder, a row with ``error`` for a file that has none."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "content")
    return files.select("path", "content", problem(F.col("content"), F.col("path")).alias("error")).mapInArrow(parse, SCHEMA)


def inferred_headings(found: DataFrame) -> DataFrame:
    """Where a file has no styled heading, short numbered lines without a final mark are taken for headings."""
    from pyspark.sql import Window

    styled = F.max((F.col("kind") == "heading").cast("int")).over(Window.partitionBy("path"))
    number = F.regexp_extract("text", r"^\s*(\d+(?:\.\d+)*)[.)]?\s+\S", 1)
    fits = (F.col("kind") == "paragraph") & (number != "") & (F.length("text") <= 120) & (F.size(F.split(F.trim("text"), r"\s+")) <= 15) & ~F.trim("text").rlike("[.;,:]$")
    made = (styled == 0) & fits
    depth = F.least(F.size(F.split(number, r"\.")), F.lit(9))
    return found.withColumns({"level": F.when(made, depth).otherwise(F.col("level")), "kind": F.when(made, "heading").otherwise(F.col("kind"))})
