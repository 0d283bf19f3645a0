"""Pages and places: intervals, folio choice in two passes, reading order, margin notes, lines and cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import layout


def children(blocks: DataFrame, parents: DataFrame) -> DataFrame:
    """The direct children of each parent in their order: parent, id, place from 0. blocks: id, parent, ord."""
    rows = blocks.join(parents.select(F.col("id").alias("parent")), "parent", "left_semi")
    return rows.select("parent", "id", (F.row_number().over(Window.partitionBy("parent").orderBy("ord", "id")) - 1).alias("place"))


def held_pages(ranges: DataFrame, start: str = "anchor_start", end: str = "anchor_end") -> DataFrame:
    """ranges with each page they hold; half-open, so an empty or reversed range holds none."""
    return ranges.where(F.col(start) < F.col(end)).withColumn("page", F.explode(F.sequence(start, F.col(end) - 1)))


def page_spans(boundaries: DataFrame, doc: str, order: str) -> DataFrame:
    """Digital pages between boundaries: each lasts to the next one, the last to the document's end (null)."""
    return boundaries.withColumn("until", F.lead("id").over(Window.partitionBy(doc).orderBy(order, "id")))


def deduplicated(candidates: DataFrame, key: list[str], score: str = "score", order: str = "pos") -> DataFrame:
    """One candidate of each key: the best, ties to the first."""
    rest = [c for c in candidates.columns if c not in key]
    best = candidates.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(F.col(score), -F.col(order))).alias("b"))
    return best.select(*key, *(f"b.{c}" for c in rest))


def typed_or_guessed(candidates: DataFrame, page: list[str]) -> DataFrame:
    """The candidates that have a type; on pages without any, those that were guessed."""
    typed = F.max(F.col("typed").cast("int")).over(Window.partitionBy(*page))
    return candidates.withColumn("_t", typed).where((F.col("_t") == 0) | F.col("typed")).drop("_t")


def select_folios(candidates: DataFrame, doc: str, anchor: float = 2.2, least: float = 1.5, gap: float = 0.2) -> DataFrame:
    """Printed page numbers in two passes. candidates: page, number, zone, alignment, score.

    First the zone and alignment that most pages' best candidates share gains .25 and .2. Then the best
    candidates of at least `anchor` vouch for their neighbours: by the number that the nearest one before and the nearest
    one after tell to expect, .55 if it is met, .15 if it is missed by one, -.25 by three or more, each. A page's best
    candidate is chosen if it has `least`; it is ambiguous if another number comes within `gap`.
    """
    order = [F.desc("score"), "number", "zone", "alignment"]
    best = candidates.withColumn("_k", F.row_number().over(Window.partitionBy(doc, "page").orderBy(*order))).where("_k = 1")
    shared = best.groupBy(doc, "zone", "alignment").agg(F.count("*").alias("n"), F.min("page").alias("first"))
    profile = shared.groupBy(doc).agg(F.min_by(F.struct("zone", "alignment"), F.struct(-F.col("n"), "first")).alias("p"))
    rows = candidates.join(profile, doc).withColumn("score", F.col("score") + F.when(F.col("zone") == F.col("p.zone"), 0.25).otherwise(0.0) + F.when(F.col("alignment") == F.col("p.alignment"), 0.2).otherwise(0.0)).drop("p")
    anchors = rows.withColumn("_k", F.row_number().over(Window.partitionBy(doc, "page").orderBy(*order))).where((F.col("_k") == 1) & (F.col("score") >= anchor)).select(doc, "page", F.struct("page", "number").alias("a"))
    # a frame up to the end is read anew for every row; from the end backwards it grows row by row
    along, back = (Window.partitionBy(doc).orderBy(c).rowsBetween(Window.unboundedPreceding, -1) for c in ("page", F.desc("page")))
    pages = candidates.select(doc, "page").distinct().join(anchors, [doc, "page"], "left")
    pages = pages.withColumn("before", F.last("a", True).over(along)).withColumn("after", F.last("a", True).over(back))

    def bonus(side: str) -> Column:
        off = F.abs(F.col("number") - (F.col(side)["number"] + F.col("page") - F.col(side)["page"]))
        return F.when(off == 0, 0.55).when(off == 1, 0.15).when(off >= 3, -0.25).otherwise(0.0)

    rows = rows.join(pages.select(doc, "page", "before", "after"), [doc, "page"]).withColumn("score", F.round(F.col("score") + bonus("before") + bonus("after"), 6))
    ranked = rows.withColumn("_k", F.row_number().over(Window.partitionBy(doc, "page").orderBy(*order)))
    first = ranked.where((F.col("_k") == 1) & (F.col("score") >= least)).select(doc, "page", "number", "score")
    other = ranked.join(first.select(doc, "page", F.col("number").alias("chosen")), [doc, "page"]).where("number <> chosen").groupBy(doc, "page").agg(F.max("score").alias("second"))
    return first.join(other, [doc, "page"], "left").select(doc, "page", "number", "score", F.coalesce(F.round(F.col("score") - F.col("second"), 6) < gap, F.lit(False)).alias("ambiguous"))


def repaired_order(blocks: DataFrame, page: list[str]) -> DataFrame:
    """Blocks (ord, position of their spans or null) with their place by position.

    A block without spans stands as many steps behind the last one before it that has some, else as many before the next.
    """
    along = Window.partitionBy(*page).orderBy("ord")
    n = F.row_number().over(along)
    known = F.when(F.col("position") > 0, F.struct(F.col("position").alias("p"), F.col("_n").alias("n")))
    rows = blocks.withColumn("_n", n)
    back = Window.partitionBy(*page).orderBy(F.desc("_n"))
    before, after = (F.last(known, True).over(w.rowsBetween(Window.unboundedPreceding, 0)) for w in (along, back))
    rows = rows.withColumn("_b", before).withColumn("_a", after)
    at = F.coalesce(F.col("_b.p") + F.col("_n") - F.col("_b.n"), F.col("_a.p") - (F.col("_a.n") - F.col("_n")), F.lit(0.0))
    rows = rows.withColumn("_at", at)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*page).orderBy("_at", "ord"))).drop("_n", "_b", "_a", "_at")


def render_order(blocks: DataFrame, page: list[str]) -> DataFrame:
    """Blocks with their place on the page: by order, restored fragments after the rest of an order and from the top, then by id."""
    restored = F.coalesce("restored", F.lit(False))
    key = [F.coalesce("ord", F.lit(0.0)), restored.cast("int"), F.when(restored, F.coalesce("top", F.lit(0.0))).otherwise(0.0), "id"]
    return blocks.withColumn("place", F.row_number().over(Window.partitionBy(*page).orderBy(*key)))


def margin_notes(spans: DataFrame, notes: DataFrame, edge: float = 0.08, body: tuple[float, float] = (0.05, 0.95), near: float = 0.02) -> DataFrame:
    """Line numbers in the margin: page, id, side, note, from spans in shares of the page.

    A span counts if it is a number, its centre lies within `edge` of a side and inside the body. It goes to the nearest note
    of its page and side with the same text but for bars, at most `near` away in height; else note is null: it becomes one.
    """
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    side = F.when(x <= edge, "left").when(x >= 1 - edge, "right")
    numbers = spans.where(F.trim("text").rlike("^[0-9]{1,4}$") & y.between(*body)).select("page", "id", side.alias("side"), F.trim("text").alias("key"), y.alias("y")).where("side is not null")
    known = notes.select("page", "side", F.trim(F.regexp_replace("text", r"\|", "")).alias("key"), F.col("id").alias("note"), F.col("y").alias("note_y"))
    dy = F.abs(F.col("y") - F.col("note_y"))
    pairs = numbers.join(known, ["page", "side", "key"]).where(dy <= near)
    best = pairs.groupBy("page", "id").agg(F.min_by("note", F.struct(dy, "note")).alias("note"))
    return numbers.join(best, ["page", "id"], "left").select("page", "id", "side", "note")


def merged_math_lines(lines: DataFrame, reach: float = 10.0, share: float = 0.8) -> DataFrame:
    """Runs of neighbouring lines of which one holds mathematics: page, first, n and the box of the run.

    Neighbours join when they share over `share` of the lower height, their gap is under `reach` and one of the two is mathematics.
    """
    along = Window.partitionBy("page").orderBy("x0", "id")
    rows = lines.withColumn("row", F.floor(F.col("y0") / 10))
    along = Window.partitionBy("page", "row").orderBy("x0", "id")
    common = F.least("y1", F.lag("y1").over(along)) - F.greatest("y0", F.lag("y0").over(along))
    low = F.least(F.col("y1") - F.col("y0"), F.lag("y1").over(along) - F.lag("y0").over(along))
    joins = (common > share * low) & (F.col("x0") - F.lag("x1").over(along) < reach) & (F.col("math") | F.lag("math").over(along))
    runs = rows.withColumn("new", F.coalesce(~joins, F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(along))
    return runs.groupBy("page", "row", "run").agg(F.min_by("id", F.struct("x0", "id")).alias("first"), F.count("*").alias("n"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.bool_or("math").alias("math")).drop("row", "run")


def cell_lines(lines: DataFrame, cells: DataFrame) -> DataFrame:
    """Cells (page, block) with the texts of the lines that they overlap most, from the top."""
    held = layout.best_overlap(lines.drop("text"), cells)
    rows = held.join(lines.select("page", F.col("id").alias("line"), "text", "y0", "x0"), ["page", "line"])
    texts = rows.groupBy("page", "block").agg(F.array_sort(F.collect_list(F.struct("y0", "x0", "line", "text"))).alias("r"))
    return texts.select("page", "block", F.array_join(F.transform("r", lambda x: x["text"]), "\n").alias("text"), F.size("r").alias("lines"))


def label_problems(labels: DataFrame, pages: DataFrame) -> DataFrame:
    """What is wrong with hand-made labels: page, code, n. labels: page, block, lines, images; pages: page, line_count, image_count.

    Every line and image must be labelled once; blocks must not be empty; pages must be known.
    """
    unknown = labels.join(pages, "page", "left_anti").groupBy("page").agg(F.count("*").alias("n")).select("page", F.lit("no_geometry").alias("code"), "n")
    empty = labels.where((F.size("lines") == 0) & (F.size("images") == 0)).groupBy("page").agg(F.count("*").alias("n")).select("page", F.lit("empty_block").alias("code"), "n")
    out = unknown.unionByName(empty)
    for kind, count in (("lines", "line_count"), ("images", "image_count")):
        given = labels.select("page", "block", F.explode(kind).alias("i")).groupBy("page", "i").agg(F.count("*").alias("times"))
        there = pages.where(F.col(count) > 0).select("page", F.explode(F.sequence(F.lit(0), F.col(count) - 1)).alias("i"), F.lit(1).alias("there"))
        both = given.join(there, ["page", "i"], "full").join(pages.select("page"), "page", "left_semi")
        code = F.when(F.col("there").isNull(), f"{kind}_not_there").when(F.col("times").isNull(), f"{kind}_unlabelled").when(F.col("times") > 1, f"{kind}_twice")
        out = out.unionByName(both.withColumn("code", code).where("code is not null").groupBy("page", "code").agg(F.count("*").alias("n")).select("page", "code", "n"))
    return out


def merged_metadata(rows: DataFrame, by: str, order: str, numbers: list[str], texts: list[str]) -> DataFrame:
    """Metadata of a group as one: numbers add up, texts are joined in order."""
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(c, F.lit("")).alias("t")))), lambda x: x["t"]), "").alias(c)
    return rows.groupBy(by).agg(*(F.sum(c).alias(c) for c in numbers), *(joined(c) for c in texts))


def merged_dollars(cells: DataFrame, table: str) -> DataFrame:
    """Cells (row, col, text) whose column of `$` signs only is put before the next column's texts; columns are numbered anew."""
    columns = cells.groupBy(table, "col").agg((F.bool_and(F.trim("text").isin("$", "")) & F.bool_or(F.trim("text") == "$")).alias("sign"))
    along = Window.partitionBy(table).orderBy("col")
    # a sign column counts only if another column follows it
    columns = columns.withColumn("sign", F.col("sign") & F.lead("col").over(along).isNotNull()).withColumn("after_sign", F.coalesce(F.lag("sign").over(along), F.lit(False))).withColumn("before", F.lag("col").over(along))
    columns = columns.withColumn("at", F.sum((~F.col("sign")).cast("int")).over(along) - 1)
    rows = cells.join(columns, [table, "col"])
    marks = cells.select(table, "row", F.col("col").alias("before"), F.trim("text").alias("mark"))
    rows = rows.where("not sign").join(marks, [table, "row", "before"], "left")
    return rows.select(table, "row", F.col("at").alias("col"), F.when(F.col("after_sign") & (F.col("mark") == "$"), F.concat(F.lit("$"), F.trim("text"))).otherwise(F.col("text")).alias("text"))


def continued(blocks: DataFrame, doc: str, full: float = 0.9, indent: float = 0.02) -> DataFrame:
    """Text blocks that the next text block goes on: id of both. blocks: ord, text, column, x0, width, last_width (of the last line).

    The last line fills its block or ends in a hyphen and no sentence ends there; the next block opens without an indent and in another
    column or page.
    """
    along = Window.partitionBy(doc).orderBy("ord")
    rows = blocks.withColumns({f"next_{c}": F.lead(c).over(along) for c in ("ord", "text", "column", "first_indent")})
    open_end = (F.col("last_width") >= full * F.col("width")) | F.rtrim("text").rlike(r"[-‐¬]$")
    return rows.where(open_end & ~F.rtrim("text").rlike(r"[.!?]$") & (F.col("next_column") != F.col("column")) & (F.col("next_first_indent") <= indent)).select(doc, "ord", "next_ord")


def in_zone(top: Column, bottom: Column, height: Column, share: float) -> Column:
    """header, footer or body by the share of the page's height that the first two take."""
    return F.when(bottom <= share * height, "header").when(top >= (1 - share) * height, "footer").otherwise("body")


def kept_boxes_of(rows: list[tuple[int, float, float, float, float, float]], most: float) -> list[int]:
    """Ids of boxes (id, score, x0, y0, x1, y1) that no better kept box overlaps by IoU over `most`; ties to the lower id."""
    kept: list[tuple] = []
    for box in sorted(rows, key=lambda b: (-b[1], b[0])):
        _, _, x0, y0, x1, y1 = box
        for _, _, a0, b0, a1, b1 in kept:
            common = max(0.0, min(x1, a1) - max(x0, a0)) * max(0.0, min(y1, b1) - max(y0, b0))
            if common > most * ((x1 - x0) * (y1 - y0) + (a1 - a0) * (b1 - b0) - common):
                break
        else:
            kept.append(box)
    return [b[0] for b in kept]


def suppressed(boxes: DataFrame, most: float = 0.5) -> DataFrame:
    """Raw layout boxes (page, kind, id, score, box) without those that a better one of their kind covers, page by page."""
    import pandas as pd

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        kept = kept_boxes_of(list(rows[["id", "score", "x0", "y0", "x1", "y1"]].itertuples(index=False, name=None)), most)
        return rows[rows["id"].isin(kept)][["page", "kind", "id"]]

    return boxes.groupBy("page", "kind").applyInPandas(run, "page long, kind string, id long")


def checked_decisions(decisions: DataFrame, texts: DataFrame, doc: str, most: float = 2.0) -> DataFrame:
    """Edits of a text (start, end, original, replacement) with whether each may be applied, else why not.

    The original must stand at its place, edits must not overlap an earlier one, and a replacement must not be longer than `most` times the original.
    """
    rows = decisions.join(texts, doc)
    along = Window.partitionBy(doc).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_upto", F.max("end").over(along))
    there = F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start")) == F.col("original")
    why = F.when((F.col("start") < 0) | (F.col("end") <= F.col("start")) | ~there, "not_there").when(F.col("start") < F.col("_upto"), "overlap").when(F.length("replacement") > most * F.length("original"), "too_long")
    return rows.select(doc, "start", F.coalesce(why, F.lit("applied")).alias("verdict"))
