"""Headers, footers, folios, signatures, margin numbers and headings by size."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as fn
from .trees import shared_table


def candidate_score(zone: Column, typed: Column, distance: Column, text: Column, number: Column) -> Column:
    """How well a number in a header or footer serves as the page's number."""
    tokens = F.regexp_count(text, F.lit("[0-9]+"))
    clean = F.trim(text)
    length = F.length(clean)
    edge = clean.startswith(number) | clean.endswith(number)
    return (
        F.when(zone == "footer", 1.0).otherwise(0.85)
        + F.when(typed, 0.65).otherwise(0.2)
        + (1 - distance) * 0.35
        + F.when(length <= 8, 0.45).when(length <= 20, 0.2).otherwise(-0.35)
        + F.when(clean == number, 0.45).when(F.contains(clean, number), 0.2).otherwise(0.0)
        + F.when(tokens == 1, 0.35).otherwise(-0.3)
        + F.when(clean.rlike(r"(?i)\b(page|p\.|pag\.|seite|s\.)"), 0.2).otherwise(0.0)
        + F.when(edge & (length > F.length(number)), 0.55).otherwise(0.0)
    )


def looks_like_year(number: Column, text: Column) -> Column:
    """A four-digit year, or a number beside a month's name."""
    months = "january|february|march|april|may|june|july|august|september|october|november|december"
    return number.rlike("^1[4-9][0-9]{2}$|^20[0-9]{2}$") | F.rlike(F.lower(text), F.concat(F.lit(rf"\b(?:{months})\b[^0-9]*(?:[0-9]{{1,2}},?\s*)?"), number, F.lit(r"\b")))


#: Months by their first letters with what may follow them, and the signs of a date in Chinese before and after its number.
MONTHS = "(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)[.]?"
DATE_BEFORE, DATE_AFTER, ERAS = "年月日号號期卷", "年", "(?:年代?|世纪|世紀)"


def in_a_date(number: Column, text: Column) -> Column:
    """A number that is a date's: beside a month as its day or with its day as the year, or beside the signs of a year, also of one that is split in two."""
    day, n = r"\d{1,2}(?:st|nd|rd|th)?", F.concat(number, F.lit("(?:st|nd|rd|th)?"))
    end = r"[\s,.\])]*"
    english = [
        F.concat(F.lit(rf"\b{MONTHS}\s+"), n, F.lit(rf"\b{end}\d{{2,4}}\b")),  # May 3, 1864
        F.concat(F.lit(r"\b"), n, F.lit(rf"\s+{MONTHS}(?![a-z])")),  # 3rd May
        F.concat(F.lit(rf"\b{MONTHS}\s+{day}{end}"), number, F.lit(r"\b")),  # May 3, N
        F.concat(F.lit(rf"\b{day}\s+{MONTHS}{end}"), number, F.lit(r"\b")),  # 3 May N
    ]
    low = F.lower(text)
    found = F.lit(False)
    for pattern in english:
        found = found | F.rlike(low, pattern)
    chinese = F.rlike(text, F.concat(number, F.lit(rf"\s*{DATE_AFTER}"))) | F.rlike(text, F.concat(F.lit(rf"[{DATE_BEFORE}]\s*"), number))
    part = r"\s*[\s.\-_/]?\s*\d{2,3}\s*"
    split = number.rlike(r"^\d{1,2}$") & (F.rlike(text, F.concat(number, F.lit(part + ERAS))) | F.rlike(text, F.concat(F.lit(r"\d{2,3}\s*[\s.\-_/]?\s*"), number, F.lit(r"\s*" + ERAS))))
    return F.coalesce(found | chinese | split, F.lit(False))


def best_two(candidates: DataFrame, page: list[str], least: float = 1.5, gap: float = 0.2) -> DataFrame:
    """The best candidate of each page, unless it is weak or the next one, of another number, is as good."""
    order = Window.partitionBy(*page).orderBy(F.desc("score"), "number")
    ranked = candidates.withColumn("place", F.row_number().over(order)).withColumn("second", F.lead("score").over(order))
    return ranked.where((F.col("place") == 1) & (F.col("score") >= least)).select(*page, "number", "score", F.coalesce(F.col("score") - F.col("second") < gap, F.lit(False)).alias("ambiguous"))


def signature(text: Column) -> Column:
    """A sheet signature such as `3* Title, Bd. II`: struct(number, mark, title, volume), or null."""
    pattern = r"^\s*([0-9]{1,3})\s*([*]{0,3})\s+([^,]+?)(?:,\s*(?:Bd|Vol|Band)\.?\s*([0-9IVXLC]+))?\s*$"
    part = lambda n: F.nullif(F.regexp_extract(text, pattern, n), F.lit(""))
    volume = F.coalesce(fn.roman_value(part(4)).cast("string"), part(4))
    return F.when(text.rlike(pattern), F.struct(part(1).cast("int").alias("number"), F.length(F.coalesce(part(2), F.lit(""))).alias("mark"), part(3).alias("title"), volume.alias("volume")))


def repeated_signatures(marks: DataFrame, doc: str) -> DataFrame:
    """Signatures that stand on another page of the document too, with the same title and volume and near the same place."""
    other = marks.select(*(F.col(c).alias(f"o_{c}") for c in (doc, "page", "title", "volume", "x", "y")))
    near = (F.abs(F.col("x") - F.col("o_x")) < 0.08) & (F.abs(F.col("y") - F.col("o_y")) < 0.025)
    on = (F.col(doc) == F.col(f"o_{doc}")) & (F.col("title") == F.col("o_title")) & F.col("volume").eqNullSafe(F.col("o_volume")) & (F.col("page") != F.col("o_page")) & near
    return marks.join(other, on, "left_semi")


def running_furniture(blocks: DataFrame, page: list[str], zone: float = 0.08, most_chars: int = 80) -> DataFrame:
    """Short blocks in the outer zones of a page, outside of its long blocks."""
    over = Window.partitionBy(*page)
    body = F.length("text") > most_chars
    top, bottom = F.min(F.when(body, F.col("y0"))).over(over), F.max(F.when(body, F.col("y1"))).over(over)
    low, high = F.min("y0").over(over), F.max("y1").over(over)
    marked = blocks.withColumns({"top": F.coalesce(top, high), "bottom": F.coalesce(bottom, low), "low": low, "high": high})
    edge = (F.col("y1") <= F.col("low") + zone * (F.col("high") - F.col("low"))) | (F.col("y0") >= F.col("high") - zone * (F.col("high") - F.col("low")))
    outside = (F.col("y1") <= F.col("top")) | (F.col("y0") >= F.col("bottom"))
    return marked.where(~body & edge & outside).select(*blocks.columns)


def line_number_columns(spans: DataFrame, page: list[str], line: str, share: float = 0.6) -> DataFrame:
    """Pages on which more than `share` of the lines open with a bare number: page, lines, numbered."""
    first = spans.groupBy(*page, line).agg(F.min_by("text", F.struct("x0", "text")).alias("first"))
    sums = first.groupBy(*page).agg(F.count("*").alias("lines"), F.count_if(F.trim("first").rlike("^[0-9]+$")).alias("numbered"))
    return sums.where(F.col("numbered") > share * F.col("lines"))


def margin_numbers(spans: DataFrame, margin: float = 0.08, header: float = 0.06, footer: float = 0.94) -> DataFrame:
    """Purely numeric spans whose centre is in the left or right margin, between header and footer; x, y relative."""
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    side = F.when(x <= margin, "left").when(x >= 1 - margin, "right")
    return spans.where(F.trim("text").rlike("^[0-9]+$") & y.between(header, footer)).withColumn("side", side).where("side is not null")


def size_levels(headings: DataFrame, doc: str, size: str, levels: int = 4, merge: float = 0.25) -> DataFrame:
    """headings with a level from their size: at most `levels` groups of least variance, the largest first.

    The groups are the optimal ones on a line, so the result has no seed; a group whose mean exceeds
    the next larger one's by less than `merge` of its own joins it.
    """

    def cluster(values: np.ndarray) -> np.ndarray:
        distinct, weight = np.unique(values, return_counts=True)
        n, k = len(distinct), min(levels, len(distinct))
        w, s, q = (np.concatenate([[0], np.cumsum(x)]) for x in (weight, weight * distinct, weight * distinct**2))
        cost = lambda i, j: q[j] - q[i] - (s[j] - s[i]) ** 2 / (w[j] - w[i])
        best = np.full((k + 1, n + 1), np.inf)
        cut = np.zeros((k + 1, n + 1), int)
        best[0, 0] = 0
        for c in range(1, k + 1):
            for j in range(c, n + 1):
                for i in range(c - 1, j):
                    v = best[c - 1, i] + cost(i, j)
                    if v < best[c, j] - 1e-12:
                        best[c, j], cut[c, j] = v, i
        bounds, j = [n], n
        for c in range(k, 0, -1):
            j = int(cut[c, j])
            bounds.append(j)
        bounds = bounds[::-1]
        means = [(s[b] - s[a]) / (w[b] - w[a]) for a, b in zip(bounds, bounds[1:], strict=False)]
        level, of = 0, {}
        for c in range(len(means) - 1, -1, -1):
            if c == len(means) - 1 or means[c + 1] - means[c] >= merge * means[c + 1]:
                level += 1
            of.update(dict.fromkeys(distinct[bounds[c] : bounds[c + 1]].tolist(), level))
        return np.array([of[v] for v in values.tolist()])

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.assign(level=cluster(rows[size].to_numpy(float)).astype("int32"))

    schema = headings.schema.simpleString()[len("struct<") : -1].replace(":", " ")
    return headings.groupBy(doc).applyInPandas(fold, f"{schema}, level int")


def anchor_classes(pages: DataFrame) -> DataFrame:
    """pages (normalized, raw, both_sides, any_side, boundary, anomaly) with score and class A to D of an anchor."""
    lexical = F.when(F.col("normalized").isNotNull(), 0.96).when(F.col("raw").isNotNull(), 0.18).otherwise(0.0)
    local = F.when(F.col("both_sides"), 1.0).when(F.col("any_side"), 0.55).otherwise(0.2)
    offset = F.when(F.col("both_sides"), 1.0).when(F.col("any_side"), 0.5).otherwise(0.2)
    odd = F.when(F.col("anomaly"), 0.85).otherwise(0.05)
    score = F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), lexical * 0.3 + local * 0.35 + offset * 0.25 - odd * 0.3)), 4)
    out = pages.withColumn("score", score)
    return out.withColumn("class", F.when((F.col("score") >= 0.82) & ~F.col("boundary"), "A").when(F.col("score") >= 0.62, "B").when(F.col("score") >= 0.35, "C").otherwise("D"))


def split_combined_rows(cells: DataFrame, table: str, least: float = 0.5) -> DataFrame:
    """Cells (row, col, lines) of rows that hold several rows each, one row per line; later rows move down.

    A row splits if all its cells have the same number of lines over one, and it has more than one
    cell; a table changes only if at least `least` of its rows do.
    """
    # all is read off the cells in one order, so they are dealt and sorted once and joined with nothing
    along = Window.partitionBy(table).orderBy("row")
    of_row = Window.partitionBy(table, "row")
    cells = cells.where(F.col(table).isNotNull() & F.col("row").isNotNull())
    opens = (F.row_number().over(of_row.orderBy("col")) == 1).cast("int")
    rows = cells.withColumn("opens", opens).withColumns({"most": F.max(F.size("lines")).over(of_row), "fewest": F.min(F.size("lines")).over(of_row), "n": F.count("*").over(of_row)})
    rows = rows.withColumn("splits", (F.col("most") > 1) & (F.col("most") == F.col("fewest")) & (F.col("n") > 1))
    share = F.avg(F.when(F.col("opens") == 1, F.col("splits").cast("int"))).over(Window.partitionBy(table))
    out = rows.withColumn("parts", F.when(F.col("splits") & (share >= least), F.col("most")).otherwise(1))
    # a row's first cell counts for the row; the frame ends with the row itself, which does not move
    out = out.withColumn("shift", F.sum((F.col("parts") - 1) * F.col("opens")).over(along) - (F.col("parts") - 1))
    lines = F.when(F.col("parts") > 1, F.transform("lines", lambda x: F.array(x))).otherwise(F.array("lines"))
    return out.select(table, "col", (F.col("row") + F.col("shift")).alias("base"), F.posexplode(lines).alias("k", "lines")).select(table, (F.col("base") + F.col("k")).cast("int").alias("row"), "col", F.array_join("lines", " ").alias("text"))


def code_lines(lines: DataFrame, block: list[str]) -> DataFrame:
    """A code block's text, each line set in by its distance from the leftmost in mean letter widths."""
    of = Window.partitionBy(*block)
    letter = F.sum(F.col("x1") - F.col("x0")).over(of) / F.sum(F.length("text")).over(of)
    spaces = F.when(letter > 0, F.floor((F.col("x0") - F.min("x0").over(of)) / letter)).otherwise(0).cast("int")
    rows = lines.withColumn("line", F.concat(F.repeat(F.lit(" "), spaces), "text")).groupBy(*block).agg(F.array_sort(F.collect_list(F.struct("line_idx", "line"))).alias("r"))
    return rows.select(*block, F.array_join(F.transform("r", lambda x: x["line"]), "\n").alias("code"))


def edge_runs(lines: DataFrame, by: str, order: list[str], edge: str) -> DataFrame:
    """(by, edge, n) of each run of rows that stand next to each other in `order` and have one edge text.

    The rows are dealt by ranges of (by, order), so that a document of very many pages is many tasks; a
    range finds its runs, and those at the ends of ranges, two a range at most, are put together after.
    """
    dealt = lines.select(by, *order, edge).repartitionByRange(by, *order).sortWithinPartitions(by, *order)
    stood = shared_table(dealt.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)))
    along = Window.partitionBy(by, "_part").orderBy("_at")
    marked = stood.withColumn("_new", F.coalesce(F.col(edge) != F.lag(edge).over(along), F.lit(True)).cast("int")).withColumn("_run", F.sum("_new").over(along))
    found = marked.groupBy(by, "_part", "_run").agg(F.first(edge).alias(edge), F.count("*").alias("n"))
    runs = shared_table(found.withColumn("_last", F.max("_run").over(Window.partitionBy(by, "_part"))))
    at_end = (F.col("_run") == 1) | (F.col("_run") == F.col("_last"))
    ranges = Window.partitionBy(by).orderBy("_part", "_run")
    goes_on = (F.lag(edge).over(ranges) == F.col(edge)) & (F.lag("_part").over(ranges) != F.col("_part"))
    ends = runs.where(at_end).withColumn("_chain", F.sum((~F.coalesce(goes_on, F.lit(False))).cast("int")).over(ranges))
    whole = ends.groupBy(by, "_chain").agg(F.first(edge).alias(edge), F.sum("n").alias("n"))
    return runs.where(~at_end).select(by, edge, "n").unionByName(whole.select(by, edge, "n"))


def common_edges(lines: DataFrame, by: str, order: list[str], text: str, share: float = 0.2, streak: int = 3, least: int = 3) -> DataFrame:
    """Texts that recur at the pages' edges: by, edge, n, longest streak of equal neighbours.

    Common: on at least `share` of a document's pages or `streak` in a row, and more than `least` times.
    """
    runs = edge_runs(lines.withColumn("edge", fn.edge_text(F.col(text))), by, order, "edge")
    totals = lines.groupBy(by).agg(F.count("*").alias("pages"))
    counted = runs.groupBy(by, "edge").agg(F.sum("n").alias("n"), F.max("n").alias("streak")).join(totals, by)
    return counted.where(((F.col("n") >= F.col("pages") * share) | (F.col("streak") >= streak)) & (F.col("n") > least)).select(by, "edge", "n", "streak")


def near_common_edges(lines: DataFrame, common: DataFrame, by: str, text: str, ratio: float = 90) -> DataFrame:
    """The rows of `lines` whose edge text is a common one of its document, or alike in over `ratio` per cent.

    Each text is compared once a document, however many pages it stands on; lengths rule out most pairs before the alignment.
    """
    marked = lines.withColumn("_edge", fn.edge_text(F.col(text)))
    known = common.select(F.col(by).alias("_by"), F.col("edge").alias("_common"))
    a, b = F.length("_edge"), F.length("_common")
    near = (a + b > 0) & (200 * F.least(a, b) > ratio * (a + b))
    pairs = marked.select(by, "_edge").distinct().join(known, (F.col(by) == F.col("_by")) & near)
    alike = pairs.where((F.col("_edge") == F.col("_common")) | (fn.indel_ratio("_edge", "_common") > ratio)).select(by, "_edge").distinct()
    return marked.join(alike, [by, "_edge"], "left_semi").select(*lines.columns)
