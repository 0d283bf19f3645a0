"""The reading view of a document: proven edits of characters applied, restored notes in their places, and what is body text.

The source blocks stay as they are; the view is made of them by joins and windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What an edit may do, the one that a person must have asked for, and what counts as evidence.
ACTIONS, BY_PERSON, PERSON = ("remove_locator_token", "remove_text", "separate_native_margin"), "remove_text", "human_page_audit"
EVIDENCE, EVIDENCE_KINDS = (PERSON, "pdf_word:margin_position"), ("position:", "geometry:", "shape:", "sequence:", "pitch_match:")
#: Types that are no body text.
NO_BODY = ("PageHeader", "PageFooter", "PageNumber", "Footnote", "MarginalNote", "LineNumber", "Picture", "Figure", "TableOfContents")


def proven(evidence: Column) -> Column:
    """At least one piece of evidence is of a known kind."""
    kinds = F.array(*map(F.lit, EVIDENCE_KINDS))
    return F.exists(F.coalesce(evidence, F.array().cast("array<string>")), lambda e: e.isin(*EVIDENCE) | F.exists(kinds, lambda k: e.startswith(k)))


def judged_edits(edits: DataFrame, blocks: DataFrame, doc: str) -> DataFrame:
    """edits (block, action, begin, end, original, evidence, fingerprint) with verdict: applied, or why not.

    blocks: block, text, fingerprint (of the document as it was when the edits were made). An edit twice is one. Of edits that
    overlap none is applied, whatever their order, as nothing says which is right.
    """
    source = blocks.select(doc, "block", F.coalesce("text", F.lit("")).alias("_text"), F.col("fingerprint").alias("_print"))
    rows = edits.withColumn("evidence", F.coalesce("evidence", F.array().cast("array<string>"))).distinct().join(source, [doc, "block"], "left")
    there = (F.col("begin") >= 0) & (F.col("end") > F.col("begin")) & (F.col("end") <= F.length("_text")) & (F.substring(F.col("_text"), F.col("begin") + 1, F.col("end") - F.col("begin")) == F.col("original"))
    why = (
        F.when(F.col("_text").isNull(), "missing_source_block")
        .when(~F.coalesce(F.col("action").isin(*ACTIONS), F.lit(False)), "unsupported_edit_action")
        .when((F.col("action") == BY_PERSON) & ~F.array_contains("evidence", PERSON), "human_text_edit_without_human_evidence")
        .when(~F.coalesce((F.col("fingerprint") == F.col("_print")) & (F.col("fingerprint") != ""), F.lit(False)), "edit_source_fingerprint_missing_or_mismatched")
        .when(~proven(F.col("evidence")), "edit_evidence_missing_or_unsupported")
        .when(F.col("begin").isNull() | F.col("end").isNull(), "invalid_char_range")
        .when(~F.coalesce(there, F.lit(False)), "source_text_mismatch")
    )
    rows = rows.withColumn("_why", why)
    # ranges of a block that touch each other's inside are a group
    ranges = rows.where("_why is null").select(doc, "block", "begin", "end").distinct()
    along = Window.partitionBy(doc, "block").orderBy("begin", "end")
    reach = F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1))
    grouped = ranges.withColumn("_group", F.sum(F.coalesce(F.col("begin") >= reach, F.lit(True)).cast("int")).over(along))
    alone = grouped.withColumn("_alone", F.count("*").over(Window.partitionBy(doc, "block", "_group")) == 1).select(doc, "block", "begin", "end", "_alone")
    told = rows.join(alone, [doc, "block", "begin", "end"], "left")
    verdict = F.coalesce("_why", F.when(F.col("_alone"), "applied").otherwise("overlapping_edits"))
    return told.select(*edits.columns, verdict.alias("verdict"))


def without_ranges(text: Column, ranges: Column) -> Column:
    """A text without the given apart ranges (array of struct begin, end), each gap closed to one space where spaces stood on both sides."""
    sorted_ = F.array_sort(ranges)
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def joined(left: Column, right: Column) -> Column:
        return F.when((F.right(left, F.lit(1)) == " ") & right.startswith(" "), F.concat(left, F.substring(right, F.lit(2), F.length(right)))).otherwise(F.concat(left, right))

    piece = lambda acc, end: F.substring(text, acc["at"] + 1, end - acc["at"])
    step = lambda acc, r: F.struct(joined(acc["out"], piece(acc, r["begin"])).alias("out"), r["end"].cast("int").alias("at"))
    return F.trim(F.aggregate(sorted_, start, step, lambda acc: joined(acc["out"], piece(acc, F.length(text)))))


def reading_view(blocks: DataFrame, verdicts: DataFrame, restored: DataFrame, doc: str) -> DataFrame:
    """(block, ord, part, type, text, edits): blocks after their applied edits, and restored notes after the block that they were taken from.

    restored: block (their source), number, type, text. A place is the source's ord and a part, 0 for the block itself and
    from 1 for its notes, so that nothing is numbered or sorted anew. Blocks that lose all their text stay, empty.
    """
    ranges = verdicts.where("verdict = 'applied'").select(doc, "block", F.struct("begin", "end").alias("r")).distinct().groupBy(doc, "block").agg(F.collect_list("r").alias("_ranges"))
    rows = blocks.join(ranges, [doc, "block"], "left")
    text = F.coalesce("text", F.lit(""))
    after = F.when(F.col("_ranges").isNotNull(), without_ranges(text, F.col("_ranges"))).otherwise(text)
    own = rows.select(doc, F.col("block").cast("string").alias("block"), "ord", F.lit(0).alias("part"), "type", after.alias("text"), F.coalesce(F.size("_ranges"), F.lit(0)).alias("edits"))
    place = blocks.select(doc, "block", "ord")
    notes = restored.join(place, [doc, "block"]).select(doc, F.concat(F.col("block").cast("string"), F.lit("::note-"), "number").alias("block"), "ord", (F.col("number") + 1).alias("part"), "type", "text", F.lit(0).alias("edits"))
    return own.unionByName(notes.select(*own.columns))


def body_of(view: DataFrame, doc: str) -> DataFrame:
    """(body, chars) of each document: its body blocks in order, an empty line between them; blocks without text are left out."""
    rows = view.where(~F.col("type").isin(*NO_BODY) & (F.trim("text") != ""))
    listed = F.array_sort(F.collect_list(F.struct("ord", "part", "block", "text")))
    return rows.groupBy(doc).agg(F.array_join(F.transform(listed, lambda x: x["text"]), "\n\n").alias("body")).withColumn("chars", F.length("body"))
