"""Numbered notes that Markdown has turned into links or nested lists, and what pages have cut off from them.

Line by line over the prose of a text; guarded regions (code, tables, math) stay as they are.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .markdown import regions

#: The form of a link that only names a page, and of the lines that stand between pages.
PAGE_LINK = re.compile(r"#page--\d+(-\d+)?", re.I)
ANCHOR, RULE, COMMENT = re.compile(r"\{\d+\}"), re.compile(r"-{3,}"), re.compile(r"<!--\s*Page(Header|Footer)?:.*-->", re.I)
BULLETS = "•●○◦■▪▫–—·*-"


class Note(NamedTuple):
    """A numbered line: how it is indented, whether a bullet stands before it, its number and mark, its link, and the rest."""

    indent: str
    bullet: bool
    number: str
    mark: str
    link: str | None
    body: str


def note_of(line: str) -> Note | None:
    """A line that opens with a number and a point or bracket, or with a link whose text is a number, perhaps with the first letter of what follows; else None."""
    rest = line.lstrip(" \t")
    indent, bullet = line[: len(line) - len(rest)], False
    if rest[:1] in ("-", "*", "+") and rest[1:2] in (" ", "\t"):
        bullet, rest = True, rest[1:].lstrip()
    if rest.startswith("["):
        said, ends, after = rest[1:].partition("](")
        link, closed, body = after.partition(")")
        words = said.split()
        if not (ends and closed and link and words and len(words) <= 2):
            return None
        number, mark = words[0].removesuffix("."), "." if words[0].endswith(".") else ""
        letter = words[1] if len(words) == 2 else ""
        if not (number.isascii() and number.isdigit() and len(number) <= 4) or len(letter) > 1 or (letter and not letter.isascii()):
            return None
        body = body.lstrip() if letter else body
        # a point after the link is the number's
        if body.lstrip().startswith(".") and not letter:
            mark, body = ".", body.lstrip()[1:]
        return Note(indent, bullet, number, mark or ".", link, letter + body.lstrip())
    digits = re.match(r"\d{1,4}", rest)
    if not digits:
        return None
    number, rest = digits[0], rest[len(digits[0]) :].removeprefix("\\")
    return Note(indent, bullet, number, rest[0], None, rest[1:].strip()) if rest[:1] in (".", ")") and rest[1:2].isspace() and rest[1:].strip() else None


def flat(line: str) -> str:
    """A note in the first column: its link goes if it only names a page, or if the line was indented; other lines are as they were."""
    note = note_of(line)
    if note is None or not (note.indent or (note.link and PAGE_LINK.fullmatch(note.link))):
        return line
    return f"{note.number}{note.mark} {note.body}".rstrip()


def without_emphasis(text: str) -> str:
    """Text without the marks and tags of emphasis that open it."""
    return re.sub(r"^(?:[*_]{1,3}|</?(?:i|em|b|strong)\b[^>]*>|\s)+", "", text, flags=re.I)


def goes_on(before: str, line: str) -> bool:
    """A line is the rest of the one before: that ends in a hyphen, or this opens in lower case, with a closing sign, or with a bracket where no sentence ended."""
    end, text = re.sub(r"(?:[*_]{1,3}|</(?:i|em|b|strong)>|\s)+$", "", before, flags=re.I), without_emphasis(line)
    if not end or not text or note_of(text) or (text[0] in BULLETS and text[1:2] in ("", " ", "\t")):
        return False
    if re.search(r"[^\W_A-Z][-—¬]$", end):
        return True
    return text[0].islower() or text[0] in ",;:)]}" or (text[0] == "(" and end[-1] not in ".?!。？！")


def between_pages(line: str) -> bool:
    text = line.strip()
    return not text or any(p.fullmatch(text) for p in (ANCHOR, RULE, COMMENT))


def repaired_lists_of(text: str | None) -> str:
    """A text whose notes are siblings in the first column, and whose pages do not open with an indented rest."""
    lines = [(flat(line) if not guarded else line, guarded) for guarded, part in regions(text or "") for line in part]
    out: list[str] = []
    last, opened = "", False  # the last line of text, and whether a page has begun since
    for line, guarded in lines:
        if between_pages(line):
            opened = opened or bool(ANCHOR.fullmatch(line.strip()))
            out.append(line)
            continue
        out.append(line.lstrip() if opened and not guarded and goes_on(last, line) else line)
        last, opened = line, False
    return "\n".join(out)


@F.pandas_udf(T.StringType())
def repaired_lists(texts: pd.Series) -> pd.Series:
    return texts.map(repaired_lists_of)
