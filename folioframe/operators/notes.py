"""Footnotes and page furniture: marker sequences, note entries, calls, imprints and recurring annotations."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as fn

ENTRY = T.ArrayType(T.StructType([T.StructField("marker", T.StringType()), T.StructField("body", T.StringType())]))
#: A numbered marker that cannot be running text: a tag, an enclosed number or superscript digits.
_STRONG = re.compile(rf"<sup[^>]*>\s*(?P<tag>[0-9]{{1,4}})\s*</sup>|(?P<ring>[{''.join(fn.ENCLOSED)}])|(?P<sup>[{fn.SUPERSCRIPTS}]+)")
_DIGITS = str.maketrans(fn.SUPERSCRIPTS, fn.PLAIN_DIGITS)


def _number(m: re.Match) -> tuple[str, int]:
    kind = m.lastgroup
    return ("enclosed", fn.ENCLOSED[m[kind]]) if kind == "ring" else ("numeric", int(m[kind].translate(_DIGITS)))


def entries_of(text: str | None) -> list[dict]:
    """The notes that a text holds: it opens with a strong marker, and each next one of its style counts on by one."""
    value = (text or "").strip()
    found = list(_STRONG.finditer(value))
    if not found or found[0].start():
        return []
    kept = [found[0]]
    style, last = _number(found[0])
    for m in found[1:]:
        if _number(m) == (style, last + 1):
            kept.append(m)
            last += 1
    ends = [m.start() for m in kept[1:]] + [len(value)]
    rows = [{"marker": m[m.lastgroup], "body": value[m.end() : e].lstrip(".) ").strip()} for m, e in zip(kept, ends, strict=True)]
    return [r for r in rows if r["body"]]


@F.pandas_udf(ENTRY)
def note_entries(texts: pd.Series) -> pd.Series:
    return texts.map(entries_of)


def call_decision(marker: Column, defined: Column, before: Column, enabled: Column) -> Column:
    """What becomes of a superscript: reference, unwrap or keep.

    Tried in order: notes are off; a note of the page has the marker; a citation within the last 80
    characters and two digits or more; a single letter; three digits or more; else it stays as it looks.
    """
    digits = marker.rlike("^[0-9]+$")
    cited = F.rlike(F.right(before, F.lit(80)), F.lit(r"(?i)(§|\bart\.|\bvgl\.|\bcf\.|\bvol\.|\bbd\.|\bp\.|\bs\.)"))
    return (
        F.when(~enabled, "unwrap").when(defined, "reference").when(cited & digits & (F.length(marker) >= 2), "unwrap")
        .when(marker.rlike("^[A-Za-z]$"), "unwrap").when(digits & (F.length(marker) >= 3), "unwrap").otherwise("keep")
    )


def decided_calls(calls: DataFrame, notes: DataFrame, doc: str, enabled: bool = True) -> DataFrame:
    """Calls (doc, page, ord, marker, before) with the note they reach on their page, the first of its marker, and the decision."""
    first = notes.groupBy(doc, "page", "marker").agg(F.min("ord").alias("note"))
    rows = calls.join(first, [doc, "page", "marker"], "left")
    return rows.withColumn("decision", call_decision(F.col("marker"), F.col("note").isNotNull(), F.col("before"), F.lit(enabled)))


def note_policy(blocks: DataFrame, enabled: Column) -> DataFrame:
    """Footnotes as plain text where notes are off."""
    return blocks.withColumn("type", F.when((F.col("type") == "Footnote") & ~enabled, "Text").otherwise(F.col("type")))


def resolved(blocks: DataFrame, doc: str) -> DataFrame:
    """By document: notes, calls, calls that reach a note, and notes that no call reaches. blocks: type, marker."""
    notes = blocks.where("type = 'Footnote' and marker is not null").select(doc, "page", "marker", "ord")
    calls = blocks.where("type = 'Text' and marker is not null").select(doc, "page", "marker", F.col("ord").alias("call"))
    first = notes.groupBy(doc, "page", "marker").agg(F.count("*").alias("n"))
    called = calls.groupBy(doc, "page", "marker").agg(F.count("*").alias("c"))
    both = first.join(called, [doc, "page", "marker"], "full").na.fill(0, ["n", "c"])
    return both.groupBy(doc).agg(F.sum("n").alias("notes"), F.sum("c").alias("calls"), F.sum(F.when(F.col("n") > 0, F.col("c")).otherwise(0)).alias("resolved"), F.sum(F.when(F.col("c") == 0, F.col("n")).otherwise(0)).alias("uncalled"))


#: How a printer's imprint opens, who reserves what, and other signs of a copyright page.
IMPRINTS = ("satz und druck", "druck und verlag", "printed by")
RESERVED = ("alle rechte", "all rights reserved")
COPYRIGHT = ("archiv nr", "archivnr", "©", "copyright", "printed in")


def is_imprint(text: Column, page: Column) -> Column:
    """A printer's imprint: it opens like one, its page reserves rights and has another sign of a copyright page, and no note marker stands before it."""
    spoken = lambda c: F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.regexp_replace(c, "©", " © ")), r"[^\p{L}\p{N}©]+", " ")), F.lit(" "))
    own, there = spoken(text), spoken(page)
    opens = F.exists(F.array(*map(F.lit, IMPRINTS)), lambda p: own.startswith(F.concat(F.lit(" "), p, F.lit(" "))))
    holds = lambda phrases: F.exists(F.array(*map(F.lit, phrases)), lambda p: there.contains(F.concat(F.lit(" "), p)))
    return opens & holds(RESERVED) & holds(COPYRIGHT) & fn.marker_of(text).isNull()


def annotation_signature(text: Column) -> Column:
    """What a recurring annotation has in common: no page number at either end, case folded."""
    t = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    folio = r"(?:[0-9]{1,5}|[IVXLCDMivxlcdm]{1,8})"
    return F.lower(F.regexp_replace(F.regexp_replace(t, rf"^{folio}\s+", ""), rf"\s+{folio}$", ""))


def recorded(annotations: DataFrame, doc: str, least: int = 3) -> DataFrame:
    """(kind, signature) that stand on at least `least` pages of a document: furniture rather than text."""
    rows = annotations.withColumn("signature", annotation_signature(F.col("text")))
    return rows.groupBy(doc, "kind", "signature").agg(F.countDistinct("page").alias("pages")).where(F.col("pages") >= least)


#: Opening brackets of a page label and what closes them.
BRACKETS = {"(": ")", "[": "]", "{": "}", "<": ">", "（": "）", "［": "］", "【": "】", "〔": "〕"}
_LABEL = r"([0-9]{1,4}|[ivxlcdmIVXLCDM]{1,8})"


def page_labels(line: Column) -> Column:
    """Page labels at the edges of a line: array of struct(label, priority).

    Priority 5: the whole line; 4: in brackets at the end; 3: in brackets at the start; 2: bare at the end; 1: bare at the
    start. Brackets must match; a whole line that is a label has no other candidates.
    """
    opening, closing = ("[" + "".join("\\" + b for b in side) + "]" for side in (BRACKETS, BRACKETS.values()))
    pair = F.create_map(*(F.lit(x) for p in BRACKETS.items() for x in p))
    got = lambda p, n: F.nullif(F.regexp_extract(line, p, n), F.lit(""))

    def bracketed(pattern: str, priority: int) -> Column:
        return F.when(F.try_element_at(pair, got(pattern, 1)) == got(pattern, 3), F.struct(got(pattern, 2).alias("label"), F.lit(priority).alias("priority")))

    whole = rf"^\s*({opening})?\s*{_LABEL}\s*({closing})?\s*$"
    is_whole = line.rlike(whole)
    fits = F.coalesce(F.try_element_at(pair, got(whole, 1)) == got(whole, 3), got(whole, 1).isNull() & got(whole, 3).isNull())
    alone = F.when(is_whole & fits, F.struct(got(whole, 2).alias("label"), F.lit(5).alias("priority")))
    bare = lambda p, priority: F.when(line.rlike(p), F.struct(got(p, 1).alias("label"), F.lit(priority).alias("priority")))
    parts = F.array(
        bracketed(rf"\s({opening})\s*{_LABEL}\s*({closing})\s*$", 4), bracketed(rf"^\s*({opening})\s*{_LABEL}\s*({closing})\s", 3), bare(rf"\s{_LABEL}\s*$", 2), bare(rf"^\s*{_LABEL}\s", 1)
    )
    return F.filter(F.when(is_whole, F.array(alone)).otherwise(parts), lambda x: x.isNotNull())


def is_bullet(text: Column) -> Column:
    """Opens like an item of a list: a bullet, a dash, or a number or letter with a point or bracket."""
    return text.rlike(r"^\s*(?:[•●▪‣◦·*–—-]|[0-9]{1,3}[.)]|[a-zA-Z][.)])\s+\S")


def wrapped(text: Column, before: Column) -> Column:
    """Goes on what stands before: that has no end of a sentence, and this opens in lower case and not as an item."""
    return ~before.rlike(r"[.!?:;]\s*$") & text.rlike(r"^\s*\p{Ll}") & ~is_bullet(text)


def item_number(text: Column) -> Column:
    """The number that opens an item, or null."""
    return F.nullif(F.regexp_extract(text, r"^\s*\(?([0-9]{1,4})[.)]\s", 1), F.lit("")).cast("int")
