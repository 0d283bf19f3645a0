"""The interchange form of documents: span storage, page ranges, labels, components."""

from __future__ import annotations

import base64
import hashlib
import json
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.trees import shared_table

STORED = T.StructType([T.StructField("codec", T.StringType()), T.StructField("count", T.IntegerType()), T.StructField("raw_bytes", T.IntegerType()), T.StructField("sha256", T.StringType()), T.StructField("data", T.StringType())])


def encode_spans(text: str | None, least: int = 4, least_bytes: int = 1024) -> dict | None:
    """A JSON array of spans as zlib in base64, if it has enough spans and bytes and gets smaller."""
    raw = (text or "[]").encode()
    count = len(json.loads(raw))
    if count < least or len(raw) < least_bytes:
        return None
    data = base64.b64encode(zlib.compress(raw, 6)).decode()
    return {"codec": "zlib+base64", "count": count, "raw_bytes": len(raw), "sha256": hashlib.sha256(raw).hexdigest(), "data": data} if len(data) < len(raw) else None


def decode_spans(stored: dict) -> str:
    """The JSON text; a payload that fails its length, digest or count is an error."""
    raw = zlib.decompress(base64.b64decode(stored["data"], validate=True))
    if len(raw) != stored["raw_bytes"] or hashlib.sha256(raw).hexdigest() != stored["sha256"] or len(json.loads(raw)) != stored["count"]:
        raise ValueError("damaged span storage")
    return raw.decode()


@F.pandas_udf(STORED)
def stored(texts: pd.Series) -> pd.DataFrame:
    empty = dict.fromkeys(f.name for f in STORED)
    return pd.DataFrame([encode_spans(t) or empty for t in texts], columns=[f.name for f in STORED], dtype=object)


@F.pandas_udf(T.StringType())
def restored(rows: pd.DataFrame) -> pd.Series:
    return pd.Series([None if r["data"] is None else decode_spans(r) for r in rows.to_dict("records")], dtype=object)


def page_range(spec: Column) -> Column:
    """`0,5-10,20` as its distinct numbers in order."""
    parts = F.filter(F.transform(F.split(spec, ","), lambda p: F.trim(p)), lambda p: p != "")
    bounds = F.transform(parts, lambda p: F.transform(F.split(p, "-"), lambda x: x.cast("int")))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(bounds, lambda b: F.sequence(F.element_at(b, 1), F.element_at(b, -1))))))


def label_lines(spec: Column) -> Column:
    """`0-3,7,10-20/2,IMG1`: the line numbers, each range with its step; images are left out."""
    parts = F.filter(F.transform(F.split(spec, ","), lambda p: F.trim(p)), lambda p: p.rlike(r"^\d+(-\d+(/\d+)?)?$"))
    number = lambda p, group: F.nullif(F.regexp_extract(p, r"^(\d+)(?:-(\d+))?(?:/(\d+))?$", group), F.lit("")).cast("int")
    return F.flatten(F.transform(parts, lambda p: F.sequence(number(p, 1), F.coalesce(number(p, 2), number(p, 1)), F.coalesce(number(p, 3), F.lit(1)))))


def read_labels(lines: DataFrame, ident: str, order: str, line: str) -> DataFrame:
    """Label files as rows: ident, page, ord, type, lines. A `[page]` line heads the blocks below it."""
    clean = lines.withColumn("_l", F.trim(F.split_part(F.col(line), F.lit("#"), F.lit(1)))).where("_l <> ''")
    head = F.nullif(F.regexp_extract("_l", r"^\[(.+)\]$", 1), F.lit(""))
    page = F.last(head, True).over(Window.partitionBy(ident).orderBy(order))
    blocks = clean.withColumn("page", page).where(~F.col("_l").rlike(r"^\[.+\]$") & F.col("page").isNotNull())
    return blocks.select(ident, "page", F.col(order).alias("ord"), F.split_part("_l", F.lit(" "), F.lit(1)).alias("type"), label_lines(F.split_part("_l", F.lit(" "), F.lit(2))).alias("lines"))


def anchored_pages(docs: DataFrame, ident: str, text: str) -> DataFrame:
    """Markdown by its `{n}` lines: ident, pdf_page, printed (from `<!-- Page: x -->`) and body; fenced lines are no anchors."""
    hide = lambda part, i: F.when(i % 2 == 1, F.regexp_replace(part, r"\n\{", "\n\u0001{")).otherwise(part)
    plain = F.array_join(F.transform(F.split(text, "```"), hide), "```")
    parts = F.slice(F.split(F.concat(F.lit("\n"), plain), r"\n(?=\{\d+\}(?:\n|$))"), 2, 1_000_000)
    rows = docs.select(ident, F.posexplode(parts).alias("ord", "part")).where(~F.col("part").rlike(r"^\{\d+\}$"))  # the closing anchor
    printed = F.nullif(F.trim(F.regexp_extract("part", r"<!-- Page: ([^>]*?)\.? ?-->", 1)), F.lit(""))
    body = F.regexp_replace(F.regexp_replace("part", r"^\{\d+\}\n", ""), r"<!-- Page: [^>]*-->", "")
    body = F.regexp_replace(F.regexp_replace(body, "\u0001", ""), r"^\s+|\s+$", "")
    return rows.select(ident, "ord", F.regexp_extract("part", r"^\{(\d+)\}", 1).cast("int").alias("pdf_page"), printed.alias("printed"), body.alias("body"))


def join_pages(pages: DataFrame, ident: str, page: str, body: str) -> DataFrame:
    """The pages of a document as Markdown with anchors, from 0, two empty lines apart, and a closing anchor."""
    rows = pages.groupBy(ident).agg(F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), F.col(body).alias("b")))).alias("r"))
    parts = F.transform("r", lambda x: F.concat(F.lit("{"), x["p"], F.lit("}\n"), x["b"]))
    return rows.select(ident, F.concat(F.array_join(parts, "\n\n"), F.lit("\n\n{"), F.element_at("r", -1)["p"] + 1, F.lit("}")).alias("markdown"))


def line_index(records: DataFrame, order: str, line: str) -> DataFrame:
    """Byte offset of each JSON line in the file that holds them in order."""
    # sorted by ranges: offsets add up within one, and only one sum a range is added up over all
    ranged = shared_table(records.select(order, F.octet_length(line).alias("bytes")).repartitionByRange(F.col(order)).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.sum(F.col("bytes") + 1).alias("_size"), F.min(order).alias("_low"))
    start = sizes.select("_part", F.coalesce(F.sum("_size").over(Window.orderBy("_low").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    within = F.sum(F.col("bytes") + 1).over(Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    rows = ranged.withColumn("_within", F.coalesce(within, F.lit(0))).join(F.broadcast(start), "_part")
    return rows.select(order, (F.col("_start") + F.col("_within")).alias("offset"), "bytes")


def file_kind(content: Column, name: Column) -> Column:
    """A file's kind by its first bytes, then by HTML signs, then by its name; else pdf."""
    start = F.hex(F.substring(content, 1, 4))
    head = F.lower(F.decode(F.substring(content, 1, 512), "ISO-8859-1"))
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    zipped = F.when(ext.isin("epub", "docx", "xlsx", "pptx"), ext).otherwise("zip")
    return (
        F.when(start == "25504446", "pdf").when(start == "89504E47", "png").when(start.startswith("FFD8FF"), "jpeg").when(start == "504B0304", zipped)
        .when(head.rlike(r"^\s*(<!doctype html|<html)"), "html").when(head.rlike(r"<tei[\s>]"), "tei")
        .when(ext.isin("html", "htm"), "html").when(ext.isin("epub", "docx", "xlsx", "pptx", "xml", "md"), ext).otherwise("pdf")
    )
