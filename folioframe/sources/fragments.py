"""TEI elements that run over pages: the pieces of each element by page, and the places where both begin and end."""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

from ..functions.text import slices
from .packages import _id, _name, tei_type

FRAGMENT = "doc string, block int, id string, type string, parent int, part int, parts int, page int, label string, begin int, end int, text string"


class _Open:
    """An element whose end is not read: where it began, the pieces that pages have cut off, and what came since."""

    __slots__ = ("begin", "block", "id", "parent", "pieces", "type")

    def __init__(self, block: int, name: str | None, kind: str, parent: int | None, begin: int):
        self.block, self.id, self.type, self.parent, self.begin = block, name, kind, parent, begin
        self.pieces: list[tuple[int, str, int, int]] = []


class _Tag:
    """A start tag as the readers of elements see one."""

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.get = tag, attributes.get


class _Reader:
    """Events of a file, one after the other; open elements are kept, closed ones listed."""

    def __init__(self):
        self.text: list[str] = []
        self.size, self.page, self.label, self.count = 0, 0, "", 0
        self.space = False  # one is due before the next word
        self.tags: list[_Open | None] = []  # every open tag, with its element if it is one
        self.done: list[_Open] = []
        self.inside = 0  # depth within <text>

    def _add(self, said: str) -> None:
        self.text.append(said)
        self.size += len(said)

    def _settle(self) -> None:
        """A space that is due belongs before what begins now."""
        if self.space and self.size and self.text[-1] != " " and self.text[-1][-1] != " ":
            self._add(" ")
        self.space = False

    def _cut(self, element: _Open) -> None:
        if self.size > element.begin:
            element.pieces.append((self.page, self.label, element.begin, self.size))
        element.begin = self.size

    def start(self, tag: str, attributes: dict[str, str]) -> None:
        name, node, element = _name(tag), _Tag(tag, attributes), None
        if self.inside and name == "pb":
            self._settle()
            for open_ in self.tags:
                if open_:
                    self._cut(open_)
            self.page, self.label = self.page + 1, attributes.get("n", "")
        elif self.inside and (kind := tei_type(node)):
            self._settle()
            above = next((t.block for t in reversed(self.tags) if t), None)
            element = _Open(self.count, _id(node), kind, above, self.size)
            self.count += 1
        self.inside += bool(self.inside) or name == "text"
        self.tags.append(element)

    def data(self, said: str) -> None:
        if not self.inside or not said:
            return
        words = said.split()
        self.space = self.space or said[0].isspace()
        if words:
            self._settle()
            self._add(" ".join(words))
            self.space = said[-1].isspace()

    def end(self, tag: str) -> None:
        element = self.tags.pop()
        self.inside -= bool(self.inside)
        if element:
            self._cut(element)
            self.done.append(element)

    def close(self) -> None:
        pass


def read_fragments(doc: str, data: bytes) -> list[tuple]:
    """A row for each page that an element stands on: the element's number, its piece and how many there are, and the piece's begin and end.

    Begin and end are places in the text of the file with single spaces, [begin, end): an element holds another one if its
    interval does, and pages are intervals of the same line, so that elements and pages may overlap as they like. The
    elements that are open at a page break are all cut there; pieces without text are left out, but an element that has
    none at all keeps one. Page 0 comes before the first break. One pass over the events of the file; what stands outside of its
    <text> is not read.
    """
    reader = _Reader()
    parser = ElementTree.XMLParser(target=reader)
    parser.feed(data)
    parser.close()
    whole = "".join(reader.text)
    rows = []
    for e in sorted(reader.done, key=lambda e: e.block):
        pieces = [p for p in e.pieces if whole[p[2] : p[3]].strip()] or [(reader.page, reader.label, e.begin, e.begin)]
        for part, (at, name, begin, end) in enumerate(pieces):
            rows.append((doc, e.block, e.id, e.type, e.parent, part, len(pieces), at, name, begin, end, whole[begin:end].strip()))
    return rows


def fragments(files: DataFrame, name: str = "path", content: str = "content") -> DataFrame:
    """FRAGMENT rows of every file; a file that cannot be read has one row of type `refused`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # a file's pieces take many times its size, so a batch's files leave part by part
        for batch in batches:
            for part in slices(batch[content]):
                rows = []
                for doc, data in zip(batch[name].loc[part.index], part, strict=True):
                    try:
                        rows += read_fragments(doc, bytes(data))
                    except ElementTree.ParseError:
                        rows.append((doc, 0, None, "refused", None, 0, 0, 0, "", 0, 0, ""))
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in FRAGMENT.split(", ")], dtype=object)

    return files.select(name, content).mapInPandas(run, FRAGMENT)
