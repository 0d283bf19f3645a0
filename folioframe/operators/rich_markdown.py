"""HTML as Markdown with its structure: spanned tables as grids, nested lists, notes, math, page anchors, and escapes by context.

A page's HTML becomes a small tree, which is read once with the context of each piece of text: what stands at a
line's start, in a table or in code is escaped there and nowhere else.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import slices

SKIPPED = {"script", "style", "noscript", "template", "svg", "head"}
VOID = {"br", "hr", "img", "input", "meta", "link", "wbr", "source", "area", "base", "col", "embed", "track"}
#: What an opening tag ends, as authors leave such tags open.
ENDS = {"li": {"li"}, "p": {"p"}, "tr": {"td", "th", "tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
BLOCKS = {"p", "div", "section", "article", "main", "body", "html", "nav", "header", "footer", "ul", "ol", "li", "table", "pre", "blockquote", "figure", "figcaption", "aside", "hr", "dl", "dt", "dd", *(f"h{n}" for n in range(1, 7))}
MARKS = {"b": "**", "strong": "**", "i": "*", "em": "*", "del": "~~", "s": "~~"}
KEPT = {"sup", "sub", "u"}
#: Levels that a tree keeps; what hangs lower stands beside its last one.
DEEPEST = 150


class Node:
    __slots__ = ("attributes", "children", "name")

    def __init__(self, name: str, attributes: dict[str, str | None] | None = None):
        self.name, self.attributes, self.children = name, attributes or {}, []

    def get(self, name: str) -> str:
        return self.attributes.get(name) or ""

    def found(self, *names: str) -> Iterator[Node]:
        """Nodes of these names below, those in a table of their own left out."""
        for child in self.children:
            if isinstance(child, Node):
                if child.name in names:
                    yield child
                elif child.name != "table":
                    yield from child.found(*names)

    def said(self) -> str:
        return "".join(c if isinstance(c, str) else c.said() for c in self.children)


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html")
        self.open = [self.root]
        self.skipping = self.beyond = 0

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED:
            self.skipping += 1
        if self.skipping:
            return
        closing = ENDS.get(tag, ())
        while len(self.open) > 1 and self.open[-1].name in closing:
            self.open.pop()
        node = Node(tag, dict(attrs))
        self.open[-1].children.append(node)
        if tag not in VOID and len(self.open) < DEEPEST:
            self.open.append(node)
        elif tag not in VOID:
            self.beyond += 1
            self.open[-1].children.append(" ")

    def handle_endtag(self, tag):
        if tag in SKIPPED:
            self.skipping = max(0, self.skipping - 1)
        elif self.beyond and tag not in VOID:
            self.beyond -= 1
            self.open[-1].children.append(" ")
        elif any(n.name == tag for n in self.open[1:]):
            while self.open.pop().name != tag:
                pass

    def handle_data(self, data):
        if not self.skipping:
            self.open[-1].children.append(data)


def span_of(cell: Node, name: str) -> int:
    """A cell's rows or columns, 1 where it says nothing or nonsense, and no more than 1000."""
    said = cell.get(name).strip()
    return max(1, min(1000, int(said))) if re.fullmatch(r"\d{1,9}", said) else 1


def grid(rows: list[list[tuple[str, int, int]]]) -> list[list[str]]:
    """Cells (text, rows, columns) at their places: each takes the first free place of its row, and what it spans is empty. Rows get the length of the longest; what hangs below the last row is cut."""
    taken: dict[tuple[int, int], str] = {}
    for i, row in enumerate(rows):
        j = 0
        for text, down, across in row:
            while (i, j) in taken:
                j += 1
            for y in range(i, min(i + down, len(rows))):
                for x in range(j, j + across):
                    taken.setdefault((y, x), text if (y, x) == (i, j) else "")
            j += across
    width = max((x + 1 for _, x in taken), default=0)
    return [[taken.get((i, x), "") for x in range(width)] for i in range(len(rows))]


def table_lines(cells: list[list[str]]) -> list[str]:
    """A pipe table in columns of even width; empty rows before the first with text are left out, and that one is its head."""
    first = next((i for i, row in enumerate(cells) if any(row)), None)
    if first is None:
        return []
    rows = cells[first:]
    sizes = [max(len(row[x]) for row in rows) for x in range(len(rows[0]))]
    line = lambda row: "|" + "|".join(f" {c}{' ' * (n - len(c))} " for c, n in zip(row, sizes, strict=True)) + "|"
    return [line(rows[0]), "|" + "|".join("-" * (n + 2) for n in sizes) + "|", *map(line, rows[1:])]


def escaped(text: str) -> str:
    """Prose whose signs would mean something in Markdown, but for underscores inside a word."""
    text = re.sub(r"([\\`*\[\]<$])", r"\\\1", text)
    return re.sub(r"(?<![A-Za-z0-9])_|_(?![A-Za-z0-9])", r"\\_", text)


def line_start(text: str) -> str:
    """A paragraph that would open as a heading, list, quote or rule, so that it does not."""
    text = re.sub(r"^(\d{1,9})([.)])(?=\s|$)", r"\1\\\2", text)
    return re.sub(r"^(#{1,6}(?=\s|$)|[-+](?=\s|$)|>|={3,}$|-{3,}$)", r"\\\1", text)


def fenced(code: str, language: str = "") -> list[str]:
    ticks = "`" * max(3, 1 + max((len(r) for r in re.findall("`+", code)), default=0))
    return [ticks + language, *code.split("\n"), ticks]


class Renderer:
    """Blocks of a tree as lists of lines. The math delimiters and what becomes of marginal notes are choices."""

    def __init__(self, inline: tuple[str, str] = ("$", "$"), display: tuple[str, str] = ("$$", "$$"), margins: str = "comment"):
        if margins not in ("comment", "plain", "drop"):
            raise ValueError(f"unknown form of marginal notes: {margins}")
        self.inline, self.display, self.margins = inline, display, margins

    def text(self, nodes: list, cell: bool = False) -> str:
        """The inline Markdown of nodes, with single spaces; in a cell bars become spaces."""
        out = []
        for node in nodes:
            if isinstance(node, str):
                said = re.sub(r"\s+", " ", node)
                out.append(escaped(said.replace("|", " ") if cell else said))
                continue
            inner = self.text(node.children, cell) if node.name not in ("code", "math", "table") else ""
            if node.name == "br":
                out.append(" " if cell else "\n")
            elif node.name == "code":
                said = re.sub(r"\s+", " ", node.said()).replace("|", " " if cell else "|")
                ticks = "`" * (1 + max((len(r) for r in re.findall("`+", said)), default=0)) if said else ""
                pad = " " if said.startswith("`") or said.endswith("`") else ""
                out.append(f"{ticks}{pad}{said}{pad}{ticks}")
            elif node.name == "math":
                start, end = self.display if node.get("display") == "block" else self.inline
                out.append(f" {start}{node.said().strip()}{end} ")
            elif node.name in MARKS and inner.strip():
                lead, tail = inner[: len(inner) - len(inner.lstrip())], inner[len(inner.rstrip()) :]
                out.append(f"{lead}{MARKS[node.name]}{inner.strip()}{MARKS[node.name]}{tail}")
            elif node.name in KEPT and inner.strip():
                out.append(f"<{node.name}>{inner.strip()}</{node.name}>")
            elif node.name == "a" and node.get("href") and inner.strip():
                out.append(f"[{inner.strip()}]({node.get('href').replace(' ', '%20').replace(')', '%29')})")
            elif node.name == "img" and node.get("src"):
                out.append(f"![{escaped(node.get('alt'))}]({node.get('src').replace(' ', '%20')})")
            elif node.name == "table":
                out.append(" ".join(node.said().replace("|", " ").split()))
            else:
                out.append(inner)
        return re.sub(r" *\n *", "\n", re.sub(r" {2,}", " ", "".join(out)))

    def table(self, node: Node) -> list[str]:
        rows = [[(self.text(c.children, True).replace("\n", " ").strip(), span_of(c, "rowspan"), span_of(c, "colspan")) for c in tr.found("td", "th")] for tr in node.found("tr")]
        return table_lines(grid(rows))

    def list_lines(self, node: Node) -> list[str]:
        """A list's items; what hangs below an item is indented as far as its mark is wide."""
        out: list[str] = []
        number = span_of(node, "start")
        for item in (c for c in node.children if isinstance(c, Node) and c.name == "li"):
            mark = f"{number}. " if node.name == "ol" else "- "
            number += 1
            blocks = self.blocks(item.children, item=True)
            lines = [line for b in blocks for line in b] or [""]
            out += [(mark if i == 0 else " " * len(mark) if line else "") + line for i, line in enumerate(lines)]
        return out

    def aside(self, node: Node) -> list[str]:
        said = " ".join(node.said().split()).replace("--", "- -")
        if not said or self.margins == "drop":
            return []
        if self.margins == "plain":
            return [line_start(escaped(said))]
        side = next((s for s in ("left", "right") if s in node.get("class").split()), "")
        return [f"<!-- Line: {said} -->" if re.fullmatch(r"\d{1,4}", said) else f"<!-- Margin{':' + side if side else ''}: {said} -->"]

    def page(self, node: Node) -> list[str]:
        """A page's anchor, rule and comments: header, footer and printed number, each said once."""
        printed = node.get("data-printed-page").strip()
        out, told = ["{" + node.get("data-page-id") + "}", "---"], {printed.casefold()}
        for kind, name in (("PageHeader", "data-page-header"), ("PageFooter", "data-page-footer")):
            said = " ".join(node.get(name).split()).replace("--", "- -")
            if said and said.casefold() not in told:
                told.add(said.casefold())
                out.append(f"<!-- {kind}: {said} -->")
        return out + ([f"<!-- Page: {printed} -->"] if printed else [])

    def blocks(self, nodes: list, item: bool = False) -> list[list[str]]:
        """Blocks in order, each as its lines; what stands between blocks is a paragraph of its own."""
        out: list[list[str]] = []
        run: list = []

        def flush() -> None:
            said = self.text(run).strip()
            run.clear()
            if said:
                out.append([line_start(line) for line in said.split("\n")])

        for node in nodes:
            if isinstance(node, str) or not (node.name in BLOCKS or (node.name == "math" and node.get("display") == "block") or any(isinstance(c, Node) and c.name in BLOCKS for c in node.children)):
                run.append(node)
                continue
            flush()
            out += [b for b in self.block(node, item) if b]
        flush()
        return out

    def block(self, node: Node, item: bool) -> list[list[str]]:
        name = node.name
        if name == "div" and "page" in node.get("class").split() and node.get("data-page-id"):
            return [self.page(node), *self.blocks(node.children)]
        if name == "math":
            return [[self.display[0] + node.said().strip() + self.display[1]]]
        if re.fullmatch("h[1-6]", name):
            said = self.text(node.children).replace("\n", " ").strip()
            return [["#" * int(name[1]) + " " + said]] if said else []
        if name == "pre":
            code = next((c for c in node.children if isinstance(c, Node) and c.name == "code"), node)
            language = next((c[9:] for c in code.get("class").split() if c.startswith("language-")), "")
            return [fenced(node.said().strip("\n"), language)] if node.said().strip() else []
        if name == "table":
            return [self.table(node)]
        if name in ("ul", "ol"):
            return [self.list_lines(node)]
        if name == "hr":
            return [["---"]]
        if name == "aside" and "marginal-annotation" in node.get("class").split():
            return [self.aside(node)]
        if name == "blockquote":
            inner = self.blocks(node.children)
            return [[("> " + line).rstrip() for i, b in enumerate(inner) for line in ([""] if i else []) + b]]
        return self.blocks(node.children, item)


def rich_markdown_of(html: str | None, **choices) -> str:
    """A text of HTML as Markdown; null and empty ones are empty."""
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    return formatted("\n\n".join("\n".join(b) for b in Renderer(**choices).blocks(tree.root.children)))


#: Words before a number that is a reference and no note.
REFERENCED = ("paragraph", "paragraphs", "para.", "para", "chap.", "chap", "chapter", "book", "sec.", "sec", "section", "page", "p.", "pp.", "line", "vol.", "vol", "volume", "no.", "no", "number", "§")
_NUMBERED = re.compile(r"^([ \t]*)(?:[-+*][ \t]+)?(\d{1,4})(\\?)([.)])([ \t]+)(\S.*)$")


def numbered_paragraphs(lines: list[str]) -> list[str]:
    """Numbered paragraphs that would turn into lists are escaped, their bullets dropped: those of a run that counts on, long ones, and numbers of two digits.

    A short item 1, and short ones under 10, stay as they are; so does what opens with an anchor, a comment or a rule.
    """
    found = {i: m for i, line in enumerate(lines) if (m := _NUMBERED.match(line)) and not m[6].startswith(("{", "<!--", "---"))}
    order, counted = list(found), set()
    for a, b in zip(order, order[1:], strict=False):
        if int(found[a][2]) > 0 and int(found[b][2]) == int(found[a][2]) + 1:
            counted |= {a, b}
    out = list(lines)
    for i, m in found.items():
        number, body = int(m[2]), m[6]
        plain = (number == 1 and len(body) < 80) or (number < 10 and len(body) < 24)
        if not m[3] and (i in counted or not plain):
            out[i] = f"{'' if re.match(r'[ 	]*[-+*]', lines[i]) else m[1]}{m[2]}\\{m[4]}{m[5]}{body}"
    return out


#: Page numbers of front matter, which may stick to the title before them in contents.
FRONT_PAGES = ("i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x", "xi", "xii", "xiii", "xiv", "xv", "xvi")
_SUPERSCRIPT = re.compile(r"(?:<|&lt;)sup(?:>|&gt;)([^<>&]*)(?:<|&lt;)/sup(?:>|&gt;)")


def _full_sign(found: re.Match) -> str:
    """A superscript with a note sign in it in full notation, without a bracket; others as they are."""
    said = found[1].strip().removesuffix(")").strip()
    is_sign = (said.isascii() and said.isdigit() and len(said) <= 4) or (0 < len(said) <= 12 and not set(said.lower()) - set("ivxlcdm")) or (said and not set(said) - {"*"})
    return f"<sup>{said}</sup>" if is_sign else found[0]


def _page_apart(line: str) -> str:
    """A title of contents that ends in a page of the front matter without a space gets one; two letters at least are left."""
    for page in sorted(FRONT_PAGES[1:], key=len, reverse=True):
        if len(page) > 1 and line.lower().endswith(page) and line[: -len(page)][-2:].isalpha() and len(line) > len(page) + 1:
            return f"{line[: -len(page)]} {line[-len(page) :]}"
    return line


def formatted(text: str, escape_numbers: bool = False) -> str:
    """Markdown after its last repairs, code left alone: note signs in full, references out of superscripts, page numbers of contents apart, no more than one empty line.

    escape_numbers: numbered paragraphs too, as scholarly texts have them.
    """
    out: list[str] = []
    fence, contents = "", False
    prose: list[str] = []

    def flush() -> None:
        nonlocal contents
        lines = numbered_paragraphs(prose) if escape_numbers else list(prose)
        prose.clear()
        for line in lines:
            line = _SUPERSCRIPT.sub(_full_sign, line)
            line = re.sub(r"(\S+\s+)<sup>(\w+)</sup>", lambda m: m[1] + m[2] if m[1].split()[0].lower().lstrip("(") in REFERENCED else m[0], line)
            if re.match(r"#{1,6}\s", line):
                contents = line.strip("#* \t").lower() == "contents"
            elif contents:
                line = _page_apart(line)
            out.append(line)

    for line in text.split("\n"):
        mark = re.match(r"\s*(`{3,}|~{3,})", line)
        if fence:
            out.append(line)
            fence = "" if mark and mark[1].startswith(fence) and line.strip() == mark[1] else fence
        elif mark:
            flush()
            out.append(line)
            fence = mark[1]
        elif line.strip() or (prose and prose[-1]) or (not prose and out and out[-1]):
            prose.append(line)
    flush()
    return "\n".join(out).strip("\n")


@F.pandas_udf(T.StringType())
def rich_markdown(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Whole pages of HTML as Markdown; what is made of a part of a batch leaves before the next is read."""
    for batch in batches:
        for part in slices(batch):
            yield part.map(rich_markdown_of)
