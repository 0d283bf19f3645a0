"""Outputs of single recognition tools as block rows: content lists, labelled HTML chunks, line XML, text and polygon lists, render trees."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.documents import canonical_type

SIDES = ("x0", "y0", "x1", "y1")


def _boxed(rows: DataFrame, box: str = "bbox") -> list:
    return [F.try_element_at(F.col(box), F.lit(i + 1)).alias(c) for i, c in enumerate(SIDES)]


def content_list(files: DataFrame, ident: str, text: str) -> DataFrame:
    """Blocks of a content list: an array of items with type, text or table_body or latex, text_level, page_idx and bbox.

    A text with a level is a heading; malformed JSON has no blocks; an unknown type is a ComplexRegion.
    """
    item = "struct<type:string,text:string,table_body:string,latex:string,img_path:string,text_level:int,page_idx:int,bbox:array<double>>"
    rows = files.select(ident, F.posexplode(F.from_json(text, f"array<{item}>")).alias("ord", "b")).select(ident, "ord", "b.*")
    kind = F.when((F.col("type") == "text") & (F.col("text_level") > 0), "SectionHeader").when(F.col("type") == "image", "Picture").when(F.col("type") == "equation", "Equation").otherwise(canonical_type(F.coalesce("type", F.lit(""))))
    return rows.select(ident, "ord", F.col("page_idx").alias("page"), kind.alias("type"), F.when(kind == "SectionHeader", F.col("text_level")).alias("level"), F.coalesce("text", "table_body", "latex", "img_path", F.lit("")).alias("text"), *_boxed(rows))


def labelled_chunks(pages: DataFrame, ident: list[str], html: str) -> DataFrame:
    """Blocks of `<div data-label="…" data-bbox="x0 y0 x1 y1">…</div>` chunks, tags inside left out."""
    found = F.regexp_extract_all(html, F.lit(r"(?s)(<div[^>]*data-label=.*?</div>)"), 1)
    rows = pages.select(*ident, F.posexplode(found).alias("ord", "d"))
    box = F.transform(F.split(F.regexp_extract("d", r'data-bbox="([^"]*)"', 1), r"[ ,]+"), lambda x: x.try_cast("double"))
    said = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace("d", "<[^>]*>", " "), "&amp;", "&"), r"\s+", " "))
    rows = rows.select(*ident, "ord", canonical_type(F.regexp_extract("d", r'data-label="([^"]*)"', 1)).alias("type"), said.alias("text"), box.alias("bbox"))
    return rows.select(*ident, "ord", "type", "text", *_boxed(rows))


def line_xml(pages: DataFrame, ident: list[str], xml: str) -> DataFrame:
    """Lines of `<Line …>text</Line>` XML, in order; the element around them (Header, Footer, MarginalNote, else Text) is the type."""
    part = F.regexp_extract_all(xml, F.lit(r"(?s)(<(?:Header|Footer|MarginalNote|Paragraph)[ >].*?</(?:Header|Footer|MarginalNote|Paragraph)>)"), 1)
    rows = pages.select(*ident, F.posexplode(part).alias("part", "p"))
    name = F.regexp_extract("p", r"^<([A-Za-z]+)", 1)
    kind = F.when(name == "Header", "PageHeader").when(name == "Footer", "PageFooter").when(name == "MarginalNote", "MarginalNote").otherwise("Text")
    lines = rows.select(*ident, "part", kind.alias("type"), F.posexplode(F.regexp_extract_all("p", F.lit(r"(?s)<Line[^>]*>(.*?)</Line>"), 1)).alias("line", "text"))
    return lines.withColumn("text", F.trim(F.regexp_replace("text", "<[^>]*>", "")))


def text_polygons(pages: DataFrame, ident: list[str], text: str, least: float = 0.0) -> DataFrame:
    """Lines of `{"rec_texts": […], "rec_scores": […], "rec_polys": [[[x, y], …], …]}`; a line under `least` is left out."""
    parsed = F.from_json(text, "struct<rec_texts:array<string>,rec_scores:array<double>,rec_polys:array<array<array<double>>>>")
    rows = pages.select(*ident, parsed.alias("j")).select(*ident, F.posexplode(F.arrays_zip("j.rec_texts", "j.rec_scores", "j.rec_polys")).alias("ord", "l"))
    side = lambda k, fold: fold(F.transform("l.rec_polys", lambda p: F.element_at(p, k)))
    return rows.where(F.coalesce("l.rec_scores", F.lit(1.0)) >= least).select(*ident, "ord", F.col("l.rec_texts").alias("text"), side(1, F.array_min).alias("x0"), side(2, F.array_min).alias("y0"), side(1, F.array_max).alias("x1"), side(2, F.array_max).alias("y1"), F.col("l.rec_scores").alias("confidence"))


NODE = T.ArrayType(T.StructType([T.StructField("id", T.StringType()), T.StructField("parent", T.StringType()), T.StructField("place", T.IntegerType()), T.StructField("depth", T.IntegerType()), T.StructField("type", T.StringType()), T.StructField("html", T.StringType())]))


def tree_rows(text: str | None) -> list[dict]:
    """The blocks of a render tree in pre-order; a tree that breaks the form (no id, no type, children that are no list, an id twice) is an error."""
    rows: list[dict] = []
    seen: set[str] = set()
    todo = [(json.loads(text), None, 0)] if text else []
    while todo:
        node, parent, depth = todo.pop()
        if not isinstance(node, dict) or not node.get("block_type") or not isinstance(node.get("children") or [], list):
            raise ValueError("not a block of a render tree")
        ident = node.get("id")
        if not ident or ident in seen:
            raise ValueError(f"block id {ident!r} is missing or stands twice")
        seen.add(ident)
        rows.append({"id": ident, "parent": parent, "place": len(rows), "depth": depth, "type": node["block_type"], "html": node.get("html") or ""})
        todo += [(child, ident, depth + 1) for child in reversed(node.get("children") or [])]
    return rows


@F.pandas_udf(NODE)
def render_tree(texts: pd.Series) -> pd.Series:
    return texts.map(tree_rows)


def mended_json(text: str | None) -> str | None:
    """JSON from a model's answer as canonical text: fences and words around it, commas before a closing bracket, and brackets or a quote that
    were left open are mended; null if it still cannot be read."""
    value = (text or "").strip()
    if value.startswith("```"):
        value = value.split("\n", 1)[-1].rsplit("```", 1)[0]
    starts = [i for i in (value.find("{"), value.find("[")) if i >= 0]
    if not starts:
        return None
    value = value[min(starts) :]
    out, open_, quoted, escaped = [], [], False, False
    for ch in value:
        if quoted:
            quoted = ch != '"' or escaped
            escaped = ch == "\\" and not escaped
        elif ch == '"':
            quoted = True
        elif ch in "{[":
            open_.append("}" if ch == "{" else "]")
        elif ch in "}]":
            while out and out[-1] in " \n\t,":
                out.pop()
            if not open_ or open_[-1] != ch:
                return None
            open_.pop()
        out.append(ch)
        if not open_ and not quoted:
            break
    if quoted:
        out.append('"')
    while out and out[-1] in " \n\t,":
        out.pop()
    out += reversed(open_)
    try:
        return json.dumps(json.loads("".join(out)), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    except ValueError:
        return None


@F.pandas_udf(T.StringType())
def recovered_json(texts: pd.Series) -> pd.Series:
    return texts.map(mended_json)
