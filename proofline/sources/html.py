"""Web pages as blocks: headings, paragraphs, list items and table cells, in reading order."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = {"p": "paragraph", "li": "list_item", "td": "table_cell", "th": "table_cell"} | {f"h{n}": "heading" for n in range(1, 7)}
SCHEMA = "page_id long, ord int, kind string, level int, text string"


class Reader(HTMLParser):
    """Collects (kind, level, text). A block that opens inside another begins anew; line breaks stay, superscripts go."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, int | None, str]] = []
        self.open: list[tuple[str, list[str]]] = []
        self.hidden = 0

    def close_block(self) -> None:
        tag, parts = self.open.pop()
        text = "\n".join(" ".join(line.split()) for line in "".join(parts).split("\n")).strip()
        if text:
            self.blocks.append((KINDS[tag], int(tag[1]) if KINDS[tag] == "heading" else None, text))

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "sup"):
            self.hidden += 1
        elif tag == "br" and self.open:
            self.open[-1][1].append("\n")
        elif tag in KINDS:
            while self.open and (self.open[-1][0] in (tag, "p") or KINDS[self.open[-1][0]] == "heading" or tag == "li"):
                self.close_block()
            self.open.append((tag, []))

    def handle_endtag(self, tag):
        if tag in ("script", "style", "sup"):
            self.hidden = max(0, self.hidden - 1)
        elif tag in ("ul", "ol") and self.open and self.open[-1][0] == "li":
            self.close_block()
        elif tag in [t for t, _ in self.open]:
            while self.open[-1][0] != tag:
                self.close_block()
            self.close_block()

    def handle_data(self, data):
        if self.open and not self.hidden:
            self.open[-1][1].append(data.replace("\n", " "))

    def read(self, html: str) -> list[tuple[str, int | None, str]]:
        self.feed(html)
        self.close()
        while self.open:
            self.close_block()
        return self.blocks


def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(page, i, *block) for page, html in zip(batch["page_id"].to_pylist(), batch["html"].to_pylist(), strict=True) for i, block in enumerate(Reader().read(html or ""))]
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        types = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["page_id", "ord", "kind", "level", "text"])


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html").mapInArrow(parse, SCHEMA)


def queries() -> dict:
    return {"html_blocks": blocks, "html_kinds": lambda spark, sf: blocks(spark, sf).groupBy("kind", "level").agg(F.count("*").alias("n"))}
