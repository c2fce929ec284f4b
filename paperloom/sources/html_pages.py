"""Blocks of HTML pages by a real parser; nested blocks repeat their text, as each block is a row."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from paperloom import schemas

TAGS = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "div", "li")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
#: Characters of blocks that are handed on together, a block at least.
BATCH_CHARS = 1 << 20
NAMES = ["file_id", "pos", "tag", "text", "content_html", "latex_formulas", "images"]
TYPES = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string())]


class _Blocks(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[dict] = []
        self.done: list[dict] = []
        self.count, self.math = 0, False

    def _markup(self, text: str) -> None:
        for b in self.open:
            b["html"].append(text)

    def handle_starttag(self, tag, attrs):
        self._markup(self.get_starttag_text() or "")
        held = dict(attrs)
        self.math = tag == "script" and (held.get("type") or "").startswith("math/tex")
        if tag == "img" and held.get("src"):
            for b in self.open:
                b["images"].append(held["src"])
        if tag in TAGS:
            self.open.append({"tag": tag, "at": self.count, "html": [], "text": [], "latex": [], "images": []})
            self.count += 1

    def handle_endtag(self, tag):
        self.math = False
        if tag in TAGS and any(b["tag"] == tag for b in self.open):
            while self.open:
                b = self.open.pop()
                self.done.append(b)
                if b["tag"] == tag:
                    break
        if tag not in VOID:
            self._markup(f"</{tag}>")

    def handle_data(self, data):
        for b in self.open:
            b["html"].append(data)
            b["latex" if self.math else "text"].append(data.strip() if self.math else data)

    def blocks(self) -> list[dict]:
        return sorted(self.done + self.open, key=lambda b: b["at"])


def block_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    held = 0

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), TYPES, strict=True)], names=NAMES)  # noqa: B023

    for batch in batches:
        for file_id, html in zip(*batch.select(["file_id", "html"]).columns, strict=True):
            parser = _Blocks()
            parser.feed(html.as_py() or "")
            parser.close()
            pos = 0
            for b in parser.blocks():
                text = "".join(b["text"]).strip()
                if text or b["latex"] or b["images"]:
                    rows.append((file_id.as_py(), pos, b["tag"], text, "".join(b["html"]), b["latex"], b["images"]))
                    held += len(rows[-1][3]) + len(rows[-1][4])
                    pos += 1
                # A block holds the markup of those inside it, so a page's blocks may be much larger than the page.
                if held > BATCH_CHARS or len(rows) >= 1000:
                    yield made()
                    rows, held = [], 0
    if rows:
        yield made()


def html_blocks(pages: DataFrame) -> DataFrame:
    """``pages`` (file_id, html) in the HTML_BLOCKS schema; blocks without text, formulas or images are left out."""
    return pages.select("file_id", "html").mapInArrow(block_batches, schemas.HTML_BLOCKS)
