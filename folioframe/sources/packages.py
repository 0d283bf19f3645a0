"""TEI and EPUB files to block, structure, anchor and relation rows."""

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

from .html import read_blocks

ROW = "doc string, kind string, ord int, id string, type string, parent string, target string, text string"
#: Limits of an EPUB: entries, unpacked bytes, unpacked over packed.
MOST_ENTRIES, MOST_BYTES, MOST_RATIO = 20_000, 1 << 30, 200


def _name(tag: str) -> str:
    return tag.rsplit("}", 1)[-1] if isinstance(tag, str) else ""


def _said(node) -> str:
    return " ".join("".join(node.itertext()).split())


def _id(node) -> str | None:
    return node.get("{http://www.w3.org/XML/1998/namespace}id")


def tei_type(node) -> str | None:
    """The block type of a TEI element; None for what only holds others."""
    place = (node.get("place") or "").lower()
    kinds = {"head": "SectionHeader", "p": "Text", "ab": "Text", "l": "Text", "item": "ListItem", "quote": "Quote", "table": "Table", "figure": "Figure"}
    if _name(node.tag) == "note":
        return "MarginalNote" if place.startswith("margin") or place in ("left", "right") else "Footnote"
    return kinds.get(_name(node.tag))


#: What a header says of the collection it is from, and the profile's name.
PROFILES = {"deutsches textarchiv": "dta", "text creation partnership": "tcp"}


def tei_profile(header: str) -> str:
    """The profile of one file's header, where a reader has it at hand."""
    return next((profile for said, profile in PROFILES.items() if said in header.lower()), "generic")


def tei_profile_of(header: Column) -> Column:
    """The profile of a TEI file by its header: the first collection that it names, else generic."""
    out = F.lit("generic")
    for said, profile in reversed(PROFILES.items()):
        out = F.when(F.contains(F.lower(header), F.lit(said)), profile).otherwise(out)
    return out


def read_tei(doc: str, data: bytes) -> list[tuple]:
    """Rows of blocks, structures (div), anchors (pb) and relations (ref, by target)."""
    root = ElementTree.fromstring(data)
    rows: list[tuple] = []
    count = {"block": 0, "structure": 0, "anchor": 0, "relation": 0}

    def add(kind: str, node, type_: str, parent: str | None, target: str | None, text: str) -> str:
        name = _id(node) or f"{kind[0]}{count[kind]}"
        rows.append((doc, kind, count[kind], name, type_, parent, target, text))
        count[kind] += 1
        return name

    def walk(node, parent: str | None) -> None:
        name = _name(node.tag)
        if name == "pb":
            add("anchor", node, "page", parent, None, node.get("n") or "")
        elif name in ("div", "div1", "div2", "div3", "body", "front", "back"):
            parent = add("structure", node, node.get("type") or name, parent, None, "")
        elif kind := tei_type(node):
            own = add("block", node, kind, parent, None, _said(node))
            for ref in node.iter():
                if _name(ref.tag) == "ref" and ref.get("target"):
                    add("relation", ref, "ref", own, ref.get("target"), _said(ref))
            for inner in node.iter():
                if inner is not node and _name(inner.tag) in ("pb", "note"):
                    walk(inner, own)
            return
        for child in node:
            walk(child, parent)

    text = next((n for n in root.iter() if _name(n.tag) == "text"), root)
    walk(text, None)
    return rows


def safe_member(name: str) -> bool:
    """A member path that stays inside the archive."""
    parts = name.replace("\\", "/").split("/")
    return not (name.startswith(("/", "\\")) or ".." in parts or re.match(r"^[A-Za-z]:", name) or "\0" in name)


def check_archive(infos: list[zipfile.ZipInfo]) -> str | None:
    """Why an archive is refused, or None."""
    if len(infos) > MOST_ENTRIES:
        return "too_many_entries"
    if any(i.flag_bits & 1 for i in infos):
        return "encrypted"
    if not all(safe_member(i.filename) for i in infos):
        return "unsafe_path"
    size, packed = sum(i.file_size for i in infos), sum(i.compress_size for i in infos)
    return "too_large" if size > MOST_BYTES else "ratio" if packed and size / packed > MOST_RATIO else None


def read_epub(doc: str, data: bytes) -> list[tuple]:
    """Rows of blocks in spine order, of sections by heading level, and of links as relations."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        if why := check_archive(book.infolist()):
            return [(doc, "refused", 0, why, why, None, None, "")]
        box = ElementTree.fromstring(book.read("META-INF/container.xml"))
        opf = next(n.get("full-path") for n in box.iter() if _name(n.tag) == "rootfile")
        package, base = ElementTree.fromstring(book.read(opf)), posixpath.dirname(opf)
        files = {n.get("id"): n.get("href") for n in package.iter() if _name(n.tag) == "item"}
        spine = [files[n.get("idref")] for n in package.iter() if _name(n.tag) == "itemref" and n.get("idref") in files]
        rows: list[tuple] = []
        place: dict[str, str] = {}
        links: list[tuple[str, str]] = []
        above: list[tuple[int, str]] = []
        n = 0
        for href in spine:
            path = posixpath.normpath(posixpath.join(base, href))
            place.setdefault(path, f"b{n}")
            for b in read_blocks(book.read(path).decode("utf-8", "replace")):
                name = f"b{n}"
                if b["anchor"]:
                    place[f"{path}#{b['anchor']}"] = name
                if b["type"] == "SectionHeader":
                    while above and above[-1][0] >= b["level"]:
                        above.pop()
                    rows.append((doc, "structure", n, f"s{n}", str(b["level"]), above[-1][1] if above else None, name, b["text"]))
                    above.append((b["level"], f"s{n}"))
                rows.append((doc, "block", n, name, b["type"], above[-1][1] if above else None, None, b["text"]))
                links += [(name, posixpath.normpath(posixpath.join(posixpath.dirname(path), to)) if not to.startswith("#") else path + to) for to in b["links"] if "://" not in to]
                n += 1
        # with its fragment, else the file
        rows += [(doc, "relation", i, f"r{i}", "link", source, place.get(to) or place.get(to.split("#")[0]), to) for i, (source, to) in enumerate(links)]
        return rows


def package_rows(files: DataFrame, reader, name: str = "path", content: str = "content") -> DataFrame:
    """Rows of every file; a file that cannot be read gives one row of kind `refused`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, data in zip(batch[name], batch[content], strict=True):
                try:
                    rows += reader(doc, bytes(data))
                except (ElementTree.ParseError, zipfile.BadZipFile, KeyError, StopIteration) as why:
                    rows.append((doc, "refused", 0, type(why).__name__, "unreadable", None, None, ""))
            yield pd.DataFrame(rows, columns=["doc", "kind", "ord", "id", "type", "parent", "target", "text"])

    return files.select(name, content).mapInPandas(run, ROW)
