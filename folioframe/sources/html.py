"""HTML to block rows, without a detour over pages."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import slices

#: Tags that open a block, and the block's type.
BLOCK_TYPES = {"p": "Text", "li": "ListItem", "pre": "Code", "blockquote": "Quote", "table": "Table", "figcaption": "Caption", "td": "TableCell", "th": "TableCell", "title": "Title"} | {f"h{n}": "SectionHeader" for n in range(1, 7)}
SKIPPED = {"script", "style", "noscript", "template", "svg"}
VOID = {"br", "hr", "img", "input", "meta", "link", "wbr", "source", "area", "base", "col", "embed", "track"}
BLOCKS = T.ArrayType(T.StructType([T.StructField("ord", T.IntegerType()), T.StructField("type", T.StringType()), T.StructField("level", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("anchor", T.StringType()), T.StructField("links", T.ArrayType(T.StringType()))]))


class BlockReader(HTMLParser):
    """Blocks in reading order; text outside of any block tag is a Text block of its own."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[dict] = []
        self.now: dict | None = None
        self.skipping = 0

    def close_block(self) -> None:
        if self.now is not None:
            self.now["text"] = " ".join("".join(self.now["text"]).split())
            if self.now["text"] or self.now["links"]:
                self.blocks.append(self.now | {"ord": len(self.blocks)})
        self.now = None

    def open_block(self, kind: str, level: int | None = None, anchor: str | None = None) -> None:
        self.close_block()
        self.now = {"type": kind, "level": level, "text": [], "anchor": anchor, "links": []}

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED:
            self.skipping += 1
        elif tag in BLOCK_TYPES:
            self.open_block(BLOCK_TYPES[tag], int(tag[1]) if BLOCK_TYPES[tag] == "SectionHeader" else None, dict(attrs).get("id"))
        elif tag in ("div", "section", "article", "nav", "header", "footer", "ul", "ol", "tr", "body", "main"):
            self.close_block()
        elif tag == "br" and self.now:
            self.now["text"].append(" ")
        if tag == "a" and dict(attrs).get("href"):
            if self.now is None:
                self.open_block("Text")
            self.now["links"].append(dict(attrs)["href"])

    def handle_endtag(self, tag):
        if tag in SKIPPED:
            self.skipping = max(0, self.skipping - 1)
        elif tag in BLOCK_TYPES or tag in ("div", "section", "article", "nav", "header", "footer", "ul", "ol", "tr", "body", "main"):
            self.close_block()

    def handle_data(self, data):
        if self.skipping:
            return
        if self.now is None:
            if not data.strip():
                return
            self.open_block("Text")
        self.now["text"].append(data)


def read_blocks(html: str | None) -> list[dict]:
    reader = BlockReader()
    reader.feed(html or "")
    reader.close()
    reader.close_block()
    return reader.blocks


def blocks_of(pages: DataFrame, ident: str, html: str = "html") -> DataFrame:
    """One row per block: ident, ord, type, level, text, anchor, links."""

    @F.pandas_udf(BLOCKS)
    def parse(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        # a page's blocks take many times its size, so a batch's pages leave part by part
        for batch in batches:
            for part in slices(batch):
                yield part.map(read_blocks)

    return pages.select(ident, F.explode(parse(html)).alias("b")).select(ident, "b.*")
