"""Marks in the margins of classical texts: what each is, which hold as locators of their book, and what span of a page they cite.

blocks: doc, page, id, type, text, x0, y0, x1, y1. pages: doc, page, width, height, printed (label or null).
Everything is a column expression or a window over a page, but for the chain of a book's locators.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import folded

#: The forms of marks that stand a line each, of a page and column, a page of an old edition, a number, a section and a numeral.
LINE_FORM = r"(?i)^(\d{1,4}[ab]?|[ab]|\[\d{1,4}\]|\d{1,3}\.\d{1,3})$"
COLUMN_FORM, OLD_PAGE_FORM, NUMBER_FORM, SECTION_FORM, NUMERAL_FORM = r"^\d{3}[ab]$", r"^\[\d{1,4}\]$", r"^\d{1,4}$", r"^\d{1,3}(\.\d{1,3})?$", r"(?i)^[ivxlcdm]{1,8}$"
WORD_FORM = r"^[a-zà-ÿ]{1,4}$"
#: Line numbers count by fives, to 35; a step of a ladder is 30 at most.
STEP, LAST_LINE, LONGEST_STEP = 5, 35, 30
PROSE, WIDE = ("Text", "ListItem"), ("Text", "Footnote", "SectionHeader", "ListItem")


def body_bands(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """pages with left and right of the text: the outermost sides of blocks of text as wide as a quarter of the page; null where there is none."""
    wide = blocks.join(pages.select("doc", "page", "width"), ["doc", "page"]).where(F.col("type").isin(*WIDE) & (F.col("x1") - F.col("x0") >= 0.25 * F.col("width")))
    sides = wide.groupBy("doc", "page").agg(F.min("x0").alias("_x0"), F.max("x1").alias("_x1"))
    return pages.join(sides, ["doc", "page"], "left").withColumns({"left": F.greatest(F.lit(0.0), F.col("_x0") - 2), "right": F.least(F.col("width").cast("double"), F.col("_x1") + 2)}).drop("_x0", "_x1")


def candidates(blocks: DataFrame, bands: DataFrame) -> DataFrame:
    """Marks (doc, page, id, part, kind, text, box) with their page's band: lines of margin notes, and page columns among small texts.

    A note all of whose lines look like locators is a mark a line; a page and a column letter on two lines are one. Other
    notes stay whole. Notes without text are none.
    """
    notes = blocks.where("type = 'MarginalNote'")
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    rows = notes.withColumn("_lines", lines).where("size(_lines) > 0")
    split = (F.size("_lines") > 1) & F.forall("_lines", lambda x: x.rlike(LINE_FORM))
    joins = split & F.col("_lines")[0].rlike(r"^\d{3}$") & F.col("_lines")[1].rlike("(?i)^[ab]$")
    tall = (F.col("y1") - F.col("y0")) / F.size("_lines")
    first = F.when(joins, 2).otherwise(0)
    part = lambda n, text, y0, y1: F.struct(n.alias("part"), text.alias("mark"), y0.alias("top"), y1.alias("low"))
    single = lambda text: F.array(part(F.lit(0), text, F.col("y0"), F.col("y1")))
    each = F.transform(F.sequence(first, F.size("_lines") - 1), lambda k: part(k, F.get("_lines", k), F.col("y0") + k * tall, F.col("y0") + (k + 1) * tall))
    parts = F.when(joins & (F.size("_lines") == 2), single(F.concat(F.col("_lines")[0], F.lower(F.col("_lines")[1])))).when(joins, F.concat(single(F.concat(F.col("_lines")[0], F.lower(F.col("_lines")[1]))), each)).when(split, each).otherwise(single(F.trim("text")))
    marks = rows.withColumn("_p", F.explode(parts)).select("doc", "page", "id", "_p.part", F.lit("note").alias("kind"), F.col("_p.mark").alias("text"), "x0", F.col("_p.top").alias("y0"), "x1", F.col("_p.low").alias("y1"))
    small = blocks.where((F.col("type") == "Text") & (F.length(F.trim("text")) <= 8) & ~F.trim("text").contains("\n") & F.regexp_replace("text", r"\s", "").rlike(r"^\d{3}[ab]?$"))
    strays = small.select("doc", "page", "id", F.lit(0).alias("part"), F.lit("stray").alias("kind"), F.trim("text").alias("text"), "x0", "y0", "x1", "y1")
    centre = (F.col("x0") + F.col("x1")) / 2
    found = marks.unionByName(strays).join(bands, ["doc", "page"]).withColumns({"cx": centre, "cy": (F.col("y0") + F.col("y1")) / 2, "compact": F.regexp_replace("text", r"\s", "")})
    outside = F.coalesce((F.col("cx") < F.col("left") - 1) | (F.col("cx") > F.col("right") + 1), F.lit(False))
    return found.withColumn("outside", outside).where("kind = 'note' or outside")


def classified(marks: DataFrame, blocks: DataFrame) -> DataFrame:
    """Marks with role (locator, printed_page, misplaced_word, text or undetermined), scheme, column (page * 2 + letter), line and weight.

    A number is a line only below a page column of its page; without one, a number on a ladder of fives stays open.
    """
    tiny = F.col("x1") - F.col("x0") <= F.greatest(F.lit(12.0), 0.08 * F.col("width"))
    by_page = Window.partitionBy("doc", "page")
    reading = by_page.orderBy("cy", "cx", "id", "part")
    is_column = F.col("compact").rlike(COLUMN_FORM) & (F.col("outside") | tiny | (F.col("cy") <= F.col("y0") + 24) | (F.col("kind") == "stray"))
    column = F.when(is_column, F.substring("compact", 1, 3).cast("int") * 2 + F.when(F.substring("compact", 4, 1) == "b", 1).otherwise(0))
    at_edge = (F.col("cy") <= 0.15 * F.col("height")) | (F.col("cy") >= 0.8 * F.col("height"))
    repeats = F.coalesce((F.col("compact") == F.regexp_replace("printed", r"\s", "")) & at_edge, F.lit(False))
    number = F.when((F.col("kind") == "note") & F.col("text").rlike(NUMBER_FORM), F.col("text").cast("int"))
    rows = marks.withColumns({"tiny": tiny, "repeats": repeats, "own": F.when(~repeats, column), "number": F.when(~repeats, number)})
    # a ladder on this page, or a page column or ladder anywhere in the book
    rung = F.when((F.length("text") <= 3) & (F.col("number") % STEP == 0) & F.col("number").between(STEP, 40), F.col("number"))
    rungs = F.array_sort(F.collect_list(rung).over(by_page))
    steps = F.transform(F.sequence(F.lit(0), F.size("rungs") - 2), lambda k: F.get("rungs", k + 1) - F.get("rungs", k))
    rows = rows.withColumn("rungs", rungs).withColumn("ladder", (F.size("rungs") > 1) & F.when(F.size("rungs") > 1, F.forall(steps, lambda s: s.between(STEP, LONGEST_STEP))).otherwise(False))
    book = rows.groupBy("doc").agg(F.bool_or(F.col("ladder") | F.col("own").isNotNull()).alias("lined"))
    rows = rows.join(book, "doc").withColumn("above", F.last("own", True).over(reading.rowsBetween(Window.unboundedPreceding, -1)))
    near = F.col("outside") | F.coalesce(F.col("cx") <= F.greatest(F.col("left") + 2, 0.1 * F.col("width")), F.lit(False)) | F.col("tiny") | (F.col("y1") - F.col("y0") <= 12)
    fives = F.col("number") % STEP == 0
    is_line = F.col("above").isNotNull() & near & fives & F.col("number").between(STEP, LAST_LINE)
    stays_open = (F.col("above").isNotNull() & near & fives) | (F.col("lined") & near & fives & (F.col("number") >= STEP)) | F.col("ladder")
    aside = F.col("outside") | F.col("tiny")
    inside = F.coalesce(F.col("cx").between(F.col("left") - 1, F.col("right") + 1), F.lit(False))
    is_word = (F.col("kind") == "note") & F.col("text").rlike(WORD_FORM) & inside
    told = [
        (F.col("repeats"), "printed_page", None),
        (F.col("own").isNotNull(), "locator", "bekker"),
        (F.col("text").rlike(OLD_PAGE_FORM), "locator", "old_page"),
        (is_line, "locator", "bekker"),
        (F.col("number").isNotNull() & stays_open, "undetermined", None),
        (F.col("number").isNotNull() & near, "locator", "paragraph"),
        (F.col("number").isNotNull(), "undetermined", None),
        (F.col("text").rlike(SECTION_FORM) & aside, "undetermined", None),
        (F.col("text").rlike(NUMERAL_FORM) & aside, "locator", "paragraph"),
        (is_word, "word", None),
    ]
    role, scheme = F.lit("text"), F.lit(None).cast("string")
    for test, r, s in reversed(told):
        role, scheme = F.when(test, F.lit(r)).otherwise(role), F.when(test, F.lit(s)).otherwise(scheme)
    rows = rows.withColumns({"role": role, "scheme": scheme})
    # a short word is one of the text if prose of its column stands above and below it
    prose = blocks.where(F.col("type").isin(*PROSE)).select(F.col("doc").alias("d"), F.col("page").alias("p"), F.col("x0").alias("px0"), F.col("x1").alias("px1"), F.col("y0").alias("py0"), F.col("y1").alias("py1"))
    words = rows.where("role = 'word'").select("doc", "page", "id", "part", "cx", "y0", "y1")
    met = words.join(prose, (F.col("doc") == F.col("d")) & (F.col("page") == F.col("p")) & F.col("cx").between(F.col("px0"), F.col("px1")))
    held = met.groupBy("doc", "page", "id", "part").agg((F.bool_or(F.col("py1") <= F.col("y0") + 1) & F.bool_or(F.col("py0") >= F.col("y1") - 1)).alias("held"))
    rows = rows.join(held, ["doc", "page", "id", "part"], "left").withColumn("role", F.when(F.col("role") != "word", F.col("role")).when(F.col("held"), "misplaced_word").otherwise("undetermined"))
    is_bekker = F.col("scheme") == "bekker"
    return rows.select(
        "doc", "page", "id", "part", "text", "x0", "y0", "x1", "y1", "cx", "cy", "width", "height", "left", "right", "role", "scheme",
        F.when(is_bekker, F.coalesce("own", "above")).alias("column"),
        F.when(is_bekker & F.col("own").isNull(), F.col("number")).alias("line"),
        F.when(F.col("role") == "locator", F.when(F.col("outside"), 3).otherwise(2)).alias("weight"),
    )


def heaviest_chain(places: np.ndarray, weights: np.ndarray) -> list[int]:
    """Indexes of the rising subsequence of the highest total weight; of equal ones that which ends first, and before each the first.

    For each item in turn the best chain that ends below its place is looked up in a binary indexed tree of prefix maxima: n log n steps.
    """
    rank = np.unique(places, return_inverse=True)[1] + 1
    tree: list[tuple[int, int]] = [(0, 1)] * (int(rank.max(initial=0)) + 1)  # total, minus the index (1: none)
    before, total = [], []
    for i, (r, w) in enumerate(zip(rank.tolist(), weights.tolist(), strict=True)):
        best, k = (0, 1), r - 1
        while k:
            best = max(best, tree[k])
            k &= k - 1
        before.append(-best[1])
        total.append(best[0] + w)
        while r < len(tree):
            tree[r] = max(tree[r], (total[i], -i))
            r += r & -r
    out = []
    at = max(range(len(total)), key=lambda i: (total[i], -i)) if total else -1
    while at >= 0:
        out.append(at)
        at = before[at]
    return out[::-1]


def chained(marks: DataFrame, by: list[str], order: list[str], place: str, weight: str) -> DataFrame:
    """Marks with `holds`: it is on the heaviest rising chain of its group. One misread mark, high or low, then costs itself alone.

    A group (a book) is folded in one task. Marks whose place is null hold nothing.
    """
    keys = [*by, *order]
    narrow = marks.where(F.col(place).isNotNull()).select(*keys, F.col(place).cast("long").alias("_place"), F.col(weight).cast("long").alias("_weight"))

    def run(rows: pd.DataFrame, bounds: np.ndarray) -> pd.DataFrame:
        places, weights = rows["_place"].to_numpy(), rows["_weight"].to_numpy()
        on = [a + i for a, b in zip(bounds[:-1], bounds[1:], strict=True) for i in heaviest_chain(places[a:b], weights[a:b])]
        return rows.iloc[on][keys]

    kept = folded(narrow, by, order, run, narrow.select(*keys).schema)
    return marks.join(kept.withColumn("holds", F.lit(True)), keys, "left").withColumn("holds", F.coalesce("holds", F.lit(False)))


def held_locators(marks: DataFrame) -> DataFrame:
    """Bekker locators with stream (the side of the page) and holds: they rise through the book, stream by stream. Other roles are left out."""
    rows = marks.where("scheme = 'bekker'").withColumn("stream", F.when(F.col("cx") < F.col("width") / 2, "left").otherwise("right"))
    rows = rows.withColumn("place", F.col("column").cast("long") * 100 + F.coalesce("line", F.lit(0)))
    return chained(rows, ["doc", "stream"], ["page", "cy", "cx", "id", "part"], "place", "weight")


def spans(held: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc, page, stream, span, display, extends_before, extends_after) that a page's locators cite.

    A run of a column's lines is one span while the lines rise by fives; a column goes on in the next one (a to b, b to a of
    the page after) if both are named. A column named without lines before any is a span by itself. A span extends
    where prose of its lane stands beyond its first or last mark.
    """
    lane = Window.partitionBy("doc", "page", "stream")
    along = lane.orderBy("cy", "cx", "id", "part")
    rows = held.where("holds").withColumn("named", F.col("line").isNull())
    rises = (F.col("line") - F.lag("line").over(along)).between(STEP, LONGEST_STEP) & ((F.col("line") - F.lag("line").over(along)) % STEP == 0)
    first_line = F.lag("line").over(along).isNull()
    new = F.coalesce(F.lag("column").over(along) != F.col("column"), F.lit(True)) | (F.col("line").isNotNull() & ~first_line & ~F.coalesce(rises, F.lit(False)))
    rows = rows.withColumn("run", F.sum(new.cast("int")).over(along))
    box = F.struct("cx", "y0", "y1")
    lines = F.col("line").isNotNull()
    runs = rows.groupBy("doc", "page", "stream", "run").agg(
        F.first("column").alias("column"),
        F.bool_or("named").alias("named"),
        F.min("line").alias("low"),
        F.max("line").alias("high"),
        F.min_by(box, F.when(lines, F.col("cy"))).alias("first_line"),
        F.max_by(box, F.when(lines, F.col("cy"))).alias("last_line"),
        F.min_by(box, "cy").alias("name"),
        *(F.first(c).alias(c) for c in ("width", "height", "left", "right")),
    )
    order = lane.orderBy("run")
    linked = F.coalesce(F.col("named") & F.lag("named").over(order) & (F.col("column") == F.lag("column").over(order) + 1), F.lit(False))
    runs = runs.withColumn("chain", F.sum((~linked).cast("int")).over(order))
    # names that no line came before in their chain stand alone
    seen = F.max(F.col("low").isNotNull().cast("int")).over(Window.partitionBy("doc", "page", "stream", "chain").orderBy("run"))
    runs = runs.withColumn("alone", seen == 0)
    runs = runs.withColumn("span", F.sum((F.col("alone") | ~linked | F.coalesce(F.lag("alone").over(order), F.lit(False))).cast("int")).over(order))
    start = F.struct("column", F.col("low").alias("line"), F.coalesce("first_line", "name").alias("box"))
    end = F.struct("column", F.col("high").alias("line"), F.coalesce("last_line", "name").alias("box"))
    found = runs.groupBy("doc", "page", "stream", "span").agg(F.min_by(start, "run").alias("s"), F.max_by(end, "run").alias("e"), *(F.first(c).alias(c) for c in ("width", "height", "left", "right")))
    letter = lambda c: F.when(c % 2 == 1, "b").otherwise("a")
    leaf = lambda c: F.floor(c / 2).cast("string")
    number = lambda x: F.coalesce(x.cast("string"), F.lit(""))
    head = F.concat(leaf(F.col("s.column")), letter(F.col("s.column")), number(F.col("s.line")))
    tail = F.concat(letter(F.col("e.column")), number(F.col("e.line")))
    whole = F.concat(leaf(F.col("e.column")), tail)
    display = F.when(head == whole, head).when(leaf(F.col("s.column")) == leaf(F.col("e.column")), F.concat(head, F.lit("-"), tail)).otherwise(F.concat(head, F.lit("-"), whole))
    found = found.withColumn("display", display)
    prose = blocks.where(F.col("type").isin(*PROSE)).select(F.col("doc").alias("d"), F.col("page").alias("p"), F.col("x0").alias("px0"), F.col("y0").alias("py0"), F.col("x1").alias("px1"), F.col("y1").alias("py1"))
    met = found.join(prose, (F.col("doc") == F.col("d")) & (F.col("page") == F.col("p")) & (F.col("px1") - F.col("px0") >= 0.2 * F.col("width")), "left")
    reach, far = F.greatest(F.lit(12.0), 0.08 * F.col("width")), F.greatest(F.lit(4.0), 0.015 * F.col("height"))

    def in_lane(x: Column) -> Column:
        return F.when(x < F.col("left"), F.abs(F.col("px0") - F.col("left")) <= reach).when(x > F.col("right"), F.abs(F.col("px1") - F.col("right")) <= reach).otherwise(x.between(F.col("px0"), F.col("px1")))

    before = F.bool_or(F.coalesce(in_lane(F.col("s.box.cx")) & (F.col("py1") < F.col("s.box.y0") - far), F.lit(False)))
    after = F.bool_or(F.coalesce(in_lane(F.col("e.box.cx")) & (F.col("py0") > F.col("e.box.y1") + far), F.lit(False)))
    return met.groupBy("doc", "page", "stream", "span", "display").agg(before.alias("extends_before"), after.alias("extends_after"))


def span_comments(found: DataFrame) -> DataFrame:
    """spans with `comment`: the span as a Markdown comment, an ellipsis on the sides where it extends."""
    dots = lambda c: F.when(F.col(c), "…").otherwise("")
    return found.withColumn("comment", F.concat(F.lit("<!-- "), dots("extends_before"), "display", dots("extends_after"), F.lit(" -->")))
