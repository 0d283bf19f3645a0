"""Decisions on printed page numbers: what may be chosen, which choices of a span agree, and their sparse application.

Everything is a column expression or a window over the pages of a book.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as fn

#: What a decision may do, and how sure the candidates are.
ACTIONS = ("replace", "fill_null", "leave_null", "delete_to_null", "keep")
SURE_OWN, SURE_EMPTY = 0.9, 0.7


def review_pages(proposals: DataFrame) -> DataFrame:
    """Proposals with `candidates`, the (value, action, reason, confidence) that a decision may choose from: each value and action once, the first stands.

    proposals: page, action, proposed, kind (arabic or roman), current, raw, reason, confidence. Others than repairs of a known kind are left out.
    """
    rows = proposals.where(F.col("action").isin("replace", "fill_null", "delete_to_null") & F.col("kind").isin("arabic", "roman"))
    offer = lambda value, action, reason, sure: F.struct(value.cast("string").alias("value"), action.alias("action"), reason.alias("reason"), sure.cast("double").alias("confidence"))
    none = F.lit(None).cast("string")
    has = F.col("current").isNotNull()
    own = F.when(has, offer(F.col("current"), F.lit("keep"), F.lit("current_value"), F.lit(SURE_OWN))).otherwise(offer(none, F.lit("leave_null"), F.lit("current_value"), F.lit(SURE_OWN)))
    proposed = offer(F.col("proposed"), F.col("action"), F.coalesce("reason", F.lit("segment_review_proposal")), F.coalesce("confidence", F.lit(0.9)))
    fills = F.col("action") != "delete_to_null"
    empty = F.when(fills & has, offer(none, F.lit("leave_null"), F.lit("conservative_null"), F.lit(SURE_EMPTY)))
    dropped = F.when(fills & ~has & F.col("raw").isNotNull(), offer(none, F.lit("delete_to_null"), F.lit("conservative_null"), F.lit(SURE_EMPTY)))
    return rows.withColumn("candidates", F.filter(F.array(own, proposed, empty, dropped), lambda x: x.isNotNull()))


def review_spans(reviewed: DataFrame, pages: DataFrame, doc: str) -> DataFrame:
    """Reviewed pages with `span`, a run of neighbouring pages of one kind, and the nearest numbers of that kind before and after it (left, right).

    pages: page, kind, current of the whole book.
    """
    along = Window.partitionBy(doc).orderBy("page")
    new = ~F.coalesce((F.lag("page").over(along) == F.col("page") - 1) & (F.lag("kind").over(along) == F.col("kind")), F.lit(False))
    spans = reviewed.withColumn("span", F.sum(new.cast("int")).over(along))
    inside = spans.select(doc, "page", "span", F.col("kind").alias("_kind"))
    rows = pages.select(doc, "page", F.col("kind").alias("own"), "current").join(inside, [doc, "page"], "left")
    # a frame up to the end is read anew for every row; from the end backwards it grows row by row
    order, back = (Window.partitionBy(doc).orderBy(c).rowsBetween(Window.unboundedPreceding, -1) for c in ("page", F.desc("page")))
    for kind in ("arabic", "roman"):
        value = F.when(F.col("own") == kind, F.col("current"))
        # a number inside the span itself is no anchor of it
        outside = F.when(F.col("span").isNull() | (F.col("_kind") != kind), value)
        rows = rows.withColumn(f"_left_{kind}", F.last(outside, True).over(order)).withColumn(f"_right_{kind}", F.last(outside, True).over(back))
    side = lambda s: F.when(F.col("_kind") == "arabic", F.col(f"_{s}_arabic")).otherwise(F.col(f"_{s}_roman"))
    ends = rows.where("span is not null").groupBy(doc, "span").agg(F.min_by(side("left"), "page").alias("left"), F.max_by(side("right"), "page").alias("right"))
    return spans.join(ends, [doc, "span"])


def number_of(value: Column, kind: Column) -> Column:
    """A label's number in its kind; null if it has none."""
    return F.when(kind == "arabic", F.when(value.rlike("^[0-9]{1,9}$"), value.cast("int"))).otherwise(fn.roman_value(value))


def judged(spans: DataFrame, decisions: DataFrame, doc: str, anchored: bool = False) -> DataFrame:
    """Pages of spans with chosen, action and verdict (accepted, none, or why not).

    decisions: page, action, chosen; of two for a page the first by action and value counts. A decision must be one of the page's
    candidates and fit the span's kind. What then stands in a span must neither fall nor leap twice: from the left each
    page is bounded by the highest number before it, from the right by the lowest after it, and steps other
    than 0 and 1 may occur once. A page out of bounds rejects all decisions of its span. anchored: the numbers
    beside the span bound it too.
    """
    first = decisions.groupBy(doc, "page").agg(F.min(F.struct("action", "chosen")).alias("d"))
    rows = spans.join(first, [doc, "page"], "left")
    action, chosen = F.col("d.action"), F.nullif(F.trim("d.chosen"), F.lit(""))
    fits = F.exists("candidates", lambda c: c["value"].eqNullSafe(chosen) & (c["action"] == action))
    wrong_kind = chosen.isNotNull() & F.when(F.col("kind") == "arabic", ~chosen.rlike("^[0-9]+$")).otherwise(chosen.rlike("^[0-9]+$"))
    why = (
        F.when(F.col("d").isNull() | (action == "keep"), "none")
        .when(~action.isin(*ACTIONS), "invalid_action")
        .when(~fits, "decision_not_in_candidates")
        .when(action.isin("replace", "fill_null") & chosen.isNull(), "value_action_requires_value")
        .when(wrong_kind, "segment_kind_mismatch")
        .otherwise("accepted")
    )
    rows = rows.withColumns({"verdict": why, "chosen": chosen, "action": action}).withColumn("final", F.when(F.col("verdict") == "accepted", F.col("chosen")).otherwise(F.col("current")))
    rows = rows.withColumn("number", number_of(F.col("final"), F.col("kind")))
    along = Window.partitionBy(doc, "span").orderBy("page")
    low = F.max("number").over(along.rowsBetween(Window.unboundedPreceding, -1))
    high = F.min("number").over(Window.partitionBy(doc, "span").orderBy(F.desc("page")).rowsBetween(Window.unboundedPreceding, -1))
    if anchored:
        low, high = F.greatest(low, number_of(F.col("left"), F.col("kind"))), F.least(high, number_of(F.col("right"), F.col("kind")))
    step = F.col("number") - F.last("number", True).over(along.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumns({"_out": F.coalesce((F.col("number") < low) | (F.col("number") > high), F.lit(False)), "_odd": F.col("final").isNotNull() & F.col("number").isNull(), "_leap": F.coalesce(~step.isin(0, 1), F.lit(False))})
    whole = Window.partitionBy(doc, "span")
    fault = F.when(F.max("_odd").over(whole), "span_continuity_kind_mismatch").when(F.max("_out").over(whole), "span_continuity_regression").when(F.count_if("_leap").over(whole) > 1, "span_continuity_large_jumps")
    verdict = F.when((F.col("verdict") == "accepted") & fault.isNotNull(), fault).otherwise(F.col("verdict"))
    return rows.withColumn("verdict", verdict).select(doc, "span", "page", "kind", "current", "left", "right", "action", "chosen", "verdict")


#: A page's comment in Markdown.
COMMENT = r"<!-- Page: [^>]*? -->"


def applied(blocks: DataFrame, verdicts: DataFrame, doc: str) -> DataFrame:
    """blocks (page, block: a page's Markdown) with the accepted choices in their comments, and `changed`; other pages stay byte by byte."""
    chosen = verdicts.where((F.col("verdict") == "accepted") & ~F.col("chosen").eqNullSafe(F.col("current"))).select(doc, "page", F.col("chosen").alias("_chosen"), F.lit(True).alias("_take"))
    rows = blocks.join(chosen, [doc, "page"], "left")
    fresh = F.concat(F.lit("<!-- Page: "), F.coalesce("_chosen", F.lit("null")), F.lit(" -->"))
    return rows.select(*blocks.columns[: blocks.columns.index("block")], F.when(F.col("_take"), F.regexp_replace("block", F.lit(COMMENT), fresh)).otherwise(F.col("block")).alias("block"), F.coalesce("_take", F.lit(False)).alias("changed"))
