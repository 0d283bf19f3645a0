"""Outputs of recognition tools as block and line rows: layout JSON, Tesseract TSV and hOCR."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.documents import canonical_type

ITEM = "struct<type:string,label:string,category:string,text:string,content:string,bbox:array<double>,box:array<double>,polygon:array<array<double>>,confidence:double,score:double>"


def layout_blocks(pages: DataFrame, ident: list[str], json: str) -> DataFrame:
    """Blocks of a page's layout JSON, whatever names its tool gives to type, text, box and confidence.

    A polygon becomes its bounds; an item without any box keeps null sides; malformed JSON has no blocks.
    """
    items = F.from_json(json, f"struct<blocks:array<{ITEM}>,items:array<{ITEM}>>")
    rows = pages.select(*ident, items.alias("j")).select(*ident, F.posexplode(F.coalesce("j.blocks", "j.items")).alias("ord", "b"))
    side = lambda k, fold: F.when(F.size("b.polygon") > 0, fold(F.transform("b.polygon", lambda p: F.element_at(p, k))))
    box = F.coalesce("b.bbox", "b.box")
    at = lambda n, k, fold: F.coalesce(F.try_element_at(box, F.lit(n)), side(k, fold))
    return rows.select(
        *ident, "ord", canonical_type(F.coalesce("b.type", "b.label", "b.category", F.lit(""))).alias("type"), F.coalesce("b.text", "b.content", F.lit("")).alias("text"),
        at(1, 1, F.array_min).alias("x0"), at(2, 2, F.array_min).alias("y0"), at(3, 1, F.array_max).alias("x1"), at(4, 2, F.array_max).alias("y1"), F.coalesce("b.confidence", "b.score").alias("confidence"),
    )


def detected_blocks(results: DataFrame, pages: DataFrame, least: float = 0.0) -> DataFrame:
    """A layout model's boxes (page, label, score, box in pixels of an image of image_width x image_height) as blocks of the page, in reading order.

    pages: page, width, height. Boxes are scaled to the page and clipped to it; those under `least` are left out.
    """
    rows = results.where(F.coalesce("score", F.lit(1.0)) >= least).join(pages, "page")
    at = lambda c, size, image: F.greatest(F.lit(0.0), F.least(F.col(size), F.col(c) * F.col(size) / F.col(image)))
    rows = rows.select("page", canonical_type(F.col("label")).alias("type"), F.col("label").alias("raw_label"), at("x0", "width", "image_width").alias("x0"), at("y0", "height", "image_height").alias("y0"), at("x1", "width", "image_width").alias("x1"), at("y1", "height", "image_height").alias("y1"), F.col("score").alias("confidence"))
    return rows.withColumn("ord", F.row_number().over(Window.partitionBy("page").orderBy("y0", "x0", "raw_label", "x1", "y1")) - 1)


def external_document(pages: DataFrame, layout: str, items: DataFrame) -> DataFrame:
    """A whole document from two outside sources: blocks from the pages' layout JSON, texts from recognised items (page, id, text, box).

    A block with a text of its own keeps it; others get the items they hold; items that no block holds are blocks of their own.
    """
    from ..operators.middle import merged_items

    blocks = layout_blocks(pages, ["page"], layout).withColumn("id", F.col("ord").cast("long"))
    found = merged_items(items, blocks.select("page", "id", F.col("type").alias("kind"), "x0", "y0", "x1", "y1"))
    texts = found.where("kind = 'merged'").select("page", F.col("block").alias("id"), F.col("text").alias("seen"))
    own = blocks.join(texts, ["page", "id"], "left").select("page", "id", "type", F.coalesce(F.nullif("text", F.lit("")), "seen", F.lit("")).alias("text"))
    return own.unionByName(found.where("kind = 'new'").select("page", F.col("block").alias("id"), F.lit("Text").alias("type"), "text"))


def tesseract_lines(tsv: DataFrame, ident: str, text: str) -> DataFrame:
    """Lines of Tesseract's TSV: page, block, par, line, text, box and mean confidence of its words."""
    rows = tsv.select(ident, F.explode(F.split(text, "\n")).alias("row")).select(ident, F.split("row", "\t").alias("c")).where((F.size("c") >= 12) & (F.element_at("c", 1) == "5"))
    num = lambda k: F.try_element_at("c", F.lit(k)).try_cast("double")
    words = rows.select(ident, *(num(k).cast("int").alias(n) for k, n in ((2, "page"), (3, "block"), (4, "par"), (5, "line"), (6, "word"))), num(7).alias("x0"), num(8).alias("y0"), (num(7) + num(9)).alias("x1"), (num(8) + num(10)).alias("y1"), num(11).alias("conf"), F.element_at("c", 12).alias("text"))
    kept = words.where(F.trim("text") != "")
    lines = kept.groupBy(ident, "page", "block", "par", "line").agg(F.array_sort(F.collect_list(F.struct("word", "text"))).alias("w"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.avg("conf").alias("confidence"))
    return lines.withColumn("text", F.array_join(F.transform("w", lambda x: x["text"]), " ")).drop("w")


class _Hocr(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[dict] = []
        self.depth = 0

    def handle_starttag(self, tag, attrs):
        given = dict(attrs)
        if self.depth:
            self.depth += tag not in ("br", "img")
        elif "ocr_line" in (given.get("class") or "").split():
            box = next((p.split()[1:5] for p in (given.get("title") or "").split(";") if p.strip().startswith("bbox")), [None] * 4)
            self.lines.append({"text": "", "bbox": [None if b is None else float(b) for b in box]})
            self.depth = 1

    def handle_endtag(self, tag):
        self.depth = max(0, self.depth - 1)

    def handle_data(self, data):
        if self.depth:
            self.lines[-1]["text"] += data


def read_hocr(text: str | None) -> list[dict]:
    reader = _Hocr()
    reader.feed(text or "")
    return [{"text": " ".join(x["text"].split()), "bbox": x["bbox"]} for x in reader.lines]


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("bbox", T.ArrayType(T.DoubleType()))])))
def hocr_lines(texts: pd.Series) -> pd.Series:
    return texts.map(read_hocr)


def drop_aggregates(blocks: DataFrame, page: list[str], coverage: float = 0.75) -> DataFrame:
    """Blocks without those that only sum up others: at least two blocks of the page lie in them, cover
    enough of them and hold most of their words."""
    area = lambda p: (F.col(f"{p}x1") - F.col(f"{p}x0")) * (F.col(f"{p}y1") - F.col(f"{p}y0"))
    inner = blocks.select(*page, *(F.col(c).alias(f"i_{c}") for c in ("id", "x0", "y0", "x1", "y1", "text")))
    across = F.greatest(F.lit(0.0), F.least("x1", "i_x1") - F.greatest("x0", "i_x0")) / F.nullif(F.col("i_x1") - F.col("i_x0"), F.lit(0.0))
    down = F.greatest(F.lit(0.0), F.least("y1", "i_y1") - F.greatest("y0", "i_y0")) / F.nullif(F.col("i_y1") - F.col("i_y0"), F.lit(0.0))
    parts = blocks.join(inner, page).where((F.col("id") != F.col("i_id")) & (across >= 0.6) & (down >= 0.7) & (area("i_") < area("")))
    sums = parts.groupBy(*page, "id", "text", area("").alias("size")).agg(F.count("*").alias("n"), F.sum(area("i_")).alias("covered"), F.flatten(F.collect_list(F.split("i_text", r"\s+"))).alias("words"))
    own = F.split("text", r"\s+")
    held = F.size(F.array_intersect(own, F.col("words"))) / F.size(F.array_distinct(own))
    whole = sums.where((F.col("n") >= 2) & (F.col("covered") >= coverage * F.col("size")) & (held >= 0.82)).select(*page, "id")
    return blocks.join(whole, [*page, "id"], "left_anti")


def merged_batches(batches: DataFrame, doc: str) -> DataFrame:
    """The rows of a document's batches in their order, numbered through."""
    return batches.withColumn("ord", F.row_number().over(Window.partitionBy(doc).orderBy("batch", "pos")) - 1)


def components(package: DataFrame, ident: str = "doc") -> DataFrame:
    """What a package's manifest says of each component: records, bytes and a digest over its lines in order."""
    rows = package.groupBy(ident, "kind").agg(F.array_sort(F.collect_list(F.struct("ord", F.to_json(F.struct("id", "type", "text")).alias("l")))).alias("r"))
    whole = F.concat(F.array_join(F.transform("r", lambda x: x["l"]), "\n"), F.lit("\n"))
    return rows.select(ident, "kind", F.size("r").alias("records"), F.octet_length(whole).alias("bytes"), F.sha2(whole, 256).alias("sha256"))


def broken_components(manifest: DataFrame, found: DataFrame, ident: str = "doc") -> DataFrame:
    """Components that are missing or differ from the manifest."""
    return manifest.join(found, [ident, "kind", "records", "bytes", "sha256"], "left_anti").select(ident, "kind")
