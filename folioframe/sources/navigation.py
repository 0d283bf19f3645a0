"""Trees of contents of an EPUB: NCX, lists of an EPUB 3, guide and headings, and where in the text their entries lead.

Reading gives rows of entries and of places; they meet in a join, with the fragment first and the file after.
"""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html import read_blocks
from .packages import _name, _said, check_archive

ENTRY = "doc string, row string, nav int, kind string, source string, ord int, parent int, depth int, label string, file string, fragment string, block int"
EPUB_TYPE = "{http://www.idpf.org/2007/ops}type"
#: Kinds of lists by their name in the file.
KINDS = {"toc": "toc", "page-list": "page_list", "landmarks": "landmarks"}


def resolve(base: str, href: str) -> tuple[str, str]:
    """File within the archive and fragment that a link in file `base` leads to."""
    path, _, fragment = href.partition("#")
    joined = posixpath.normpath(posixpath.join(posixpath.dirname(base), unquote(path))) if path else base
    return joined, unquote(fragment)


def ncx_entries(root: ElementTree.Element, base: str) -> Iterator[tuple[str, list[tuple]]]:
    """(kind, entries) of an NCX: its map as toc, its page list. An entry: parent, depth, label, file, fragment."""
    for node in root.iter():
        kind = {"navMap": "toc", "pageList": "page_list"}.get(_name(node.tag))
        if not kind:
            continue
        entries: list[tuple] = []
        # points yet to read, the next one last
        todo = [(p, None, 0) for p in reversed(node) if _name(p.tag) in ("navPoint", "pageTarget")]
        while todo:
            point, parent, depth = todo.pop()
            label = next((_said(n) for n in point if _name(n.tag) == "navLabel"), "")
            src = next((n.get("src") or "" for n in point if _name(n.tag) == "content"), "")
            own = len(entries)
            entries.append((parent, depth, label, *(resolve(base, src) if src else ("", ""))))
            todo += [(p, own, depth + 1) for p in reversed(point) if _name(p.tag) == "navPoint"]
        yield kind, entries


def nav_entries(root: ElementTree.Element, base: str) -> Iterator[tuple[str, list[tuple]]]:
    """(kind, entries) of an EPUB 3 file's lists: an item is its link or heading, and the list in it what hangs below."""
    for nav in root.iter():
        if _name(nav.tag) != "nav":
            continue
        kind = next((KINDS[t] for t in (nav.get(EPUB_TYPE) or nav.get("role") or "").replace("doc-", "").split() if t in KINDS), "other")
        top = next((n for n in nav if _name(n.tag) == "ol"), None)
        entries: list[tuple] = []
        todo = [(li, None, 0) for li in reversed(top if top is not None else []) if _name(li.tag) == "li"]
        while todo:
            item, parent, depth = todo.pop()
            link = next((n for n in item.iter() if _name(n.tag) in ("a", "span") and not _inside_list(item, n)), None)
            href = (link.get("href") or "") if link is not None else ""
            own = len(entries)
            entries.append((parent, depth, _said(link) if link is not None else "", *(resolve(base, href) if href else ("", ""))))
            for below in item:
                if _name(below.tag) == "ol":
                    todo += [(li, own, depth + 1) for li in reversed(below) if _name(li.tag) == "li"]
        yield kind, entries


def _inside_list(item: ElementTree.Element, node: ElementTree.Element) -> bool:
    return any(n is node for part in item if _name(part.tag) == "ol" for n in part.iter())


def read_navigation(doc: str, data: bytes) -> list[tuple]:
    """Rows of entries (row `entry`), and of places in the text (row `place`: file, fragment, block)."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        if why := check_archive(book.infolist()):
            return [(doc, "refused", 0, why, None, 0, None, 0, "", "", "", None)]
        box = ElementTree.fromstring(book.read("META-INF/container.xml"))
        opf = posixpath.normpath(next(n.get("full-path") for n in box.iter() if _name(n.tag) == "rootfile"))
        package = ElementTree.fromstring(book.read(opf))
        items = {n.get("id"): (resolve(opf, n.get("href") or "")[0], n.get("properties") or "") for n in package.iter() if _name(n.tag) == "item"}
        spine = next((n for n in package.iter() if _name(n.tag) == "spine"), None)
        files = [items[r.get("idref")][0] for r in (spine if spine is not None else []) if r.get("idref") in items]
        rows: list[tuple] = []
        block, headings = 0, []
        for file in files:
            rows.append((doc, "place", None, None, None, len(rows), None, None, None, file, "", block))
            for b in read_blocks(book.read(file).decode("utf-8", "replace")):
                if b["anchor"]:
                    rows.append((doc, "place", None, None, None, len(rows), None, None, None, file, b["anchor"], block))
                if b["type"] == "SectionHeader":
                    headings.append((b["level"], b["text"], file, block))
                block += 1
        lists: list[tuple[str, str, list[tuple]]] = []
        toc = spine.get("toc") if spine is not None else None
        if toc in items:
            lists += [(kind, "ncx", e) for kind, e in ncx_entries(ElementTree.fromstring(book.read(items[toc][0])), items[toc][0])]
        for path, properties in items.values():
            if "nav" in properties.split():
                lists += [(kind, "epub3_nav", e) for kind, e in nav_entries(ElementTree.fromstring(book.read(path)), path)]
        guide = [(None, 0, r.get("title") or r.get("type") or "", *resolve(opf, r.get("href") or "")) for g in package.iter() if _name(g.tag) == "guide" for r in g if _name(r.tag) == "reference"]
        lists += [("landmarks", "epub2_guide", guide)] if guide else []
        for nav, (kind, source, entries) in enumerate(lists):
            rows += [(doc, "entry", nav, kind, source, i, parent, depth, label, file, fragment, None) for i, (parent, depth, label, file, fragment) in enumerate(entries)]
        # what the headings themselves say; a file's headings hang below those before them of a higher rank
        above: list[tuple[int, int, str]] = []
        for i, (level, label, file, at) in enumerate(headings):
            while above and (above[-1][0] >= level or above[-1][2] != file):
                above.pop()
            rows.append((doc, "entry", len(lists), "generated_toc", "headings", i, above[-1][1] if above else None, len(above), label, file, None, at))
            above.append((level, i, file))
        return rows


def navigation(files: DataFrame, name: str = "path", content: str = "content") -> DataFrame:
    """(doc, nav, kind, source, ord, parent, depth, label, file, fragment, block) of the entries of every file; block: where an entry leads, null if nowhere.

    A file that cannot be read, or may not be, gives one entry of kind `refused`.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, data in zip(batch[name], batch[content], strict=True):
                try:
                    rows += read_navigation(doc, bytes(data))
                except (ElementTree.ParseError, zipfile.BadZipFile, KeyError, StopIteration, TypeError) as why:
                    rows.append((doc, "refused", 0, type(why).__name__, None, 0, None, 0, "", "", "", None))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in ENTRY.split(", ")], dtype=object)

    read = files.select(name, content).mapInPandas(run, ENTRY)
    # of places with one name the first
    places = read.where("row = 'place'").groupBy("doc", "file", "fragment").agg(F.min("block").alias("at"))
    exact = places.select(F.col("doc").alias("d"), F.col("file").alias("f"), F.col("fragment").alias("g"), F.col("at").alias("there"))
    whole = places.where("fragment = ''").select(F.col("doc").alias("d2"), F.col("file").alias("f2"), F.col("at").alias("begins"))
    entries = read.where("row <> 'place'").withColumn("kind", F.when(F.col("row") == "refused", "refused").otherwise(F.col("kind")))
    met = entries.join(exact, (F.col("doc") == F.col("d")) & (F.col("file") == F.col("f")) & (F.col("fragment") == F.col("g")), "left").join(whole, (F.col("doc") == F.col("d2")) & (F.col("file") == F.col("f2")), "left")
    return met.select("doc", "nav", "kind", "source", "ord", "parent", "depth", "label", "file", "fragment", F.coalesce("block", "there", "begins").alias("block"))


def printed_pages(entries: DataFrame) -> DataFrame:
    """(doc, label, block) of the pages that a book's page lists name, where they lead somewhere."""
    return entries.where("kind = 'page_list' and block is not null and label <> ''").select("doc", "label", "block")
