"""Office files and images as rows: workbooks with merged cells, text documents, slides; image sizes from their first bytes."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .packages import check_archive

CELL = "doc string, sheet string, row int, col int, rowspan int, colspan int, text string"
BLOCK = "doc string, ord int, page int, type string, level int, text string"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _tag(node) -> str:
    return node.tag.rsplit("}", 1)[-1]


def _named(node, name: str) -> list:
    return [n for n in node.iter() if _tag(n) == name]


def place(ref: str) -> tuple[int, int]:
    """`B3` as (row, column) from 0."""
    letters, digits = re.fullmatch(r"\$?([A-Z]+)\$?([0-9]+)", ref).groups()
    col = 0
    for ch in letters:
        col = col * 26 + ord(ch) - 64
    return int(digits) - 1, col - 1


def _targets(book: zipfile.ZipFile, part: str) -> dict[str, str]:
    """Parts that a part names, by relation id."""
    folder, name = posixpath.split(part)
    rels = f"{folder}/_rels/{name}.rels"
    if rels not in book.namelist():
        return {}
    return {n.get("Id"): posixpath.normpath(posixpath.join(folder, n.get("Target"))).lstrip("/") for n in _named(ElementTree.fromstring(book.read(rels)), "Relationship")}


def _opened(data: bytes) -> zipfile.ZipFile:
    book = zipfile.ZipFile(io.BytesIO(data))
    if why := check_archive(book.infolist()):
        raise ValueError(why)
    return book


def read_xlsx(doc: str, data: bytes) -> list[tuple]:
    """Cells of every sheet in the workbook's order; a merged range is one cell with its spans, the rest of it is left out."""
    rows: list[tuple] = []
    with _opened(data) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = ["".join(t.text or "" for t in _named(si, "t")) for si in _named(ElementTree.fromstring(book.read("xl/sharedStrings.xml")), "si")]
        parts = _targets(book, "xl/workbook.xml")
        for sheet in _named(ElementTree.fromstring(book.read("xl/workbook.xml")), "sheet"):
            root = ElementTree.fromstring(book.read(parts[sheet.get(REL + "id")]))
            spans, hidden = {}, set()
            for merged in _named(root, "mergeCell"):
                (r0, c0), (r1, c1) = map(place, merged.get("ref").split(":"))
                spans[r0, c0] = r1 - r0 + 1, c1 - c0 + 1
                hidden |= {(r, c) for r in range(r0, r1 + 1) for c in range(c0, c1 + 1)} - {(r0, c0)}
            for cell in _named(root, "c"):
                at = place(cell.get("r"))
                value = next((n.text or "" for n in cell if _tag(n) == "v"), "")
                if cell.get("t") == "s":
                    value = shared[int(value)]
                elif cell.get("t") == "inlineStr":
                    value = "".join(t.text or "" for t in _named(cell, "t"))
                if at not in hidden and (value or at in spans):
                    rows.append((doc, sheet.get("name"), *at, *spans.get(at, (1, 1)), value))
    return rows


def read_docx(doc: str, data: bytes) -> list[tuple]:
    """Paragraphs, headings, list items and tables (cells joined by tabs, rows by line ends) in order; page counts hard breaks."""
    rows: list[tuple] = []
    page = 0
    with _opened(data) as book:
        body = next(n for n in ElementTree.fromstring(book.read("word/document.xml")) if _tag(n) == "body")
        said = lambda node: "".join(n.text or "" if _tag(n) == "t" else "\t" if _tag(n) == "tab" else "" for n in node.iter())
        for node in body:
            if _tag(node) == "tbl":
                text = "\n".join("\t".join(said(c) for c in row if _tag(c) == "tc") for row in node if _tag(row) == "tr")
                rows.append((doc, len(rows), page, "Table", None, text))
            elif _tag(node) == "p":
                style = next((v for n in _named(node, "pStyle") for k, v in n.attrib.items() if k.endswith("val")), "")
                level = re.fullmatch(r"(?i)heading\s*([1-9])", style)
                kind = "SectionHeader" if level or style.lower() == "title" else "ListItem" if _named(node, "numPr") else "Text"
                if any(v == "page" for n in _named(node, "br") for k, v in n.attrib.items() if k.endswith("type")):
                    page += 1
                if text := said(node).strip():
                    rows.append((doc, len(rows), page, kind, int(level[1]) if level else 1 if kind == "SectionHeader" else None, text))
    return rows


def read_pptx(doc: str, data: bytes) -> list[tuple]:
    """Shapes of every slide in order, groups opened: titles, texts, tables and pictures; the slide is the page."""
    rows: list[tuple] = []
    with _opened(data) as book:
        parts = _targets(book, "ppt/presentation.xml")
        slides = [parts[n.get(REL + "id")] for n in _named(ElementTree.fromstring(book.read("ppt/presentation.xml")), "sldId")]
        said = lambda node: "\n".join(t for p in _named(node, "p") if (t := "".join(x.text or "" for x in _named(p, "t"))))

        def walk(node, page: int) -> None:
            for shape in node:
                name = _tag(shape)
                if name == "grpSp":
                    walk(shape, page)
                elif name == "sp":
                    title = any(n.get("type") in ("title", "ctrTitle") for n in _named(shape, "ph"))
                    if text := said(shape).strip():
                        rows.append((doc, len(rows), page, "SectionHeader" if title else "Text", 1 if title else None, text))
                elif name == "graphicFrame" and _named(shape, "tbl"):
                    text = "\n".join("\t".join(said(c).replace("\n", " ") for c in row if _tag(c) == "tc") for row in _named(shape, "tr"))
                    rows.append((doc, len(rows), page, "Table", None, text))
                elif name == "pic":
                    rows.append((doc, len(rows), page, "Picture", None, next((n.get("descr") or n.get("name") or "" for n in _named(shape, "cNvPr")), "")))

        for page, part in enumerate(slides):
            for tree in _named(ElementTree.fromstring(book.read(part)), "spTree"):
                walk(tree, page)
    return rows


def office_rows(files: DataFrame, reader, schema: str, name: str = "path", content: str = "content") -> DataFrame:
    """Rows of every file; one that cannot be read gives none and is listed by `unreadable`."""
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc, data in zip(batch[name], batch[content], strict=True):
                try:
                    yield pd.DataFrame(reader(doc, bytes(data)), columns=columns).astype({c.split()[0]: "Int32" for c in schema.split(", ") if c.endswith(" int")})
                except (ElementTree.ParseError, zipfile.BadZipFile, KeyError, StopIteration, ValueError, AttributeError, IndexError):
                    continue

    return files.select(name, content).mapInPandas(run, schema)


def unreadable(files: DataFrame, rows: DataFrame, name: str = "path") -> DataFrame:
    """Files that no row came from."""
    return files.select(F.col(name).alias("doc")).join(rows.select("doc").distinct(), "doc", "left_anti")


def image_size(content: Column) -> Column:
    """struct(width, height) of a PNG, GIF or baseline JPEG by its first bytes, else null; each image is one page."""
    head = F.hex(F.substring(content, 1, 4096))
    number = lambda at, digits: F.conv(F.substring(head, at, digits), 16, 10).cast("int")
    frame = F.regexp_extract(head, "^FFD8(?:FF[CDE][0-9A-F](?:[0-9A-F]{2})*?)??FFC[012][0-9A-F]{4}08([0-9A-F]{8})", 1)
    jpeg = F.when(frame != "", F.struct(F.conv(F.substring(frame, 5, 4), 16, 10).cast("int").alias("width"), F.conv(F.substring(frame, 1, 4), 16, 10).cast("int").alias("height")))
    swapped = lambda at: F.conv(F.concat(F.substring(head, at + 2, 2), F.substring(head, at, 2)), 16, 10).cast("int")
    return (
        F.when(head.startswith("89504E470D0A1A0A"), F.struct(number(33, 8).alias("width"), number(41, 8).alias("height")))
        .when(head.startswith("474946383"), F.struct(swapped(13).alias("width"), swapped(17).alias("height"))).when(head.startswith("FFD8"), jpeg)
    )


def scanned(spark, folder: str, pattern: str = "*") -> DataFrame:
    """Files under a folder and all below it: path, name, length. Only their listing is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length")


def listed(manifest: DataFrame, files: DataFrame, line: str = "line") -> tuple[DataFrame, DataFrame]:
    """(files that a manifest names, its lines that name no file); empty lines and `#` comments count for nothing, a name counts once."""
    wanted = manifest.select(F.trim(line).alias("name")).where("name <> '' and not startswith(name, '#')").distinct()
    return files.join(wanted, "name", "left_semi"), wanted.join(files, "name", "left_anti")
