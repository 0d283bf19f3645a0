"""Middle documents as tables of pages, blocks, spans and provenance: checks, fingerprints, slimmer forms.

pages: doc, page, pos, width, height, anchor_start, anchor_end. blocks: doc, page, pos, id, type, page_index, ord,
anchor_start, anchor_end, x0 to y1, confidence, polygon. spans: doc, page, pos, span, text, x0 to y1, confidence.
provenance: doc, path, item, backend, stage, confidence. Only the columns that a check names must be there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import layout
from .documents import TYPES, canonical_type

SIDES = ("x0", "y0", "x1", "y1")


def _finite(c: str) -> Column:
    return ~F.isnan(F.col(c).cast("double")) & (F.abs(c) < F.lit(float("inf")))


def _found(rows: DataFrame, rules: list[tuple[str, str, str, Column]]) -> DataFrame:
    """One row for each (severity, path suffix, code, test) that a row breaks; a null test breaks nothing."""
    hits = F.array(*(F.when(test, F.struct(F.lit(severity).alias("severity"), F.concat("path", F.lit(suffix)).alias("path"), F.lit(code).alias("code"))) for severity, suffix, code, test in rules))
    return rows.select("doc", F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("x")).select("doc", "x.severity", "x.path", "x.code")


def box_rules() -> list[tuple[str, str, str, Column]]:
    """Rules for a box inside a page of `width` and `height`: one error at most, then warnings."""
    some, whole = F.lit(False), F.lit(True)
    for c in SIDES:
        some |= F.col(c).isNotNull()
        whole &= F.coalesce(_finite(c), F.lit(False))
    reversed_ = (F.col("x1") < F.col("x0")) | (F.col("y1") < F.col("y0"))
    good = whole & ~reversed_
    return [
        ("error", ".bbox", "not_four_numbers", some & ~whole),
        ("error", ".bbox", "reversed", whole & reversed_),
        ("warning", ".bbox", "no_area", good & ((F.col("x1") == F.col("x0")) | (F.col("y1") == F.col("y0")))),
        ("warning", ".bbox", "outside_width", good & (F.col("width") > 0) & ((F.col("x0") < 0) | (F.col("x1") > F.col("width")))),
        ("warning", ".bbox", "outside_height", good & (F.col("height") > 0) & ((F.col("y0") < 0) | (F.col("y1") > F.col("height")))),
    ]


def confidence_rules() -> list[tuple[str, str, str, Column]]:
    c = F.col("confidence")
    return [("error", ".confidence", "not_a_number", c.isNotNull() & ~_finite("confidence")), ("warning", ".confidence", "not_normalized", _finite("confidence") & ((c < 0) | (c > 1)))]


def _page_path() -> Column:
    return F.concat(F.lit("$.pages["), F.col("page"), F.lit("]"))


def document_issues(documents: DataFrame, pages: DataFrame, version: str) -> DataFrame:
    """documents: doc, schema_version, page_count. A version of another kind, and a count that is not the pages'."""
    counted = pages.groupBy("doc").agg(F.count("*").alias("found"))
    rows = documents.join(counted, "doc", "left").withColumn("path", F.lit("$"))
    return _found(rows, [("error", ".schema_version", "unknown_version", ~F.col("schema_version").eqNullSafe(F.lit(version))), ("error", ".page_count", "not_the_number_of_pages", F.col("page_count") != F.coalesce("found", F.lit(0)))])


def page_issues(pages: DataFrame) -> DataFrame:
    """pages: page is the place in the file, index its own number."""
    first = F.row_number().over(Window.partitionBy("doc", "index").orderBy("page"))
    rows = pages.withColumn("nth", first).withColumn("path", _page_path())
    rules = [
        ("error", ".index", "not_an_integer", F.col("index").isNull()),
        ("error", ".index", "duplicate", F.col("index").isNotNull() & (F.col("nth") > 1)),
        ("error", ".anchor_start", "not_the_index", F.col("index").isNotNull() & ~F.col("anchor_start").eqNullSafe(F.col("index"))),
        ("error", ".anchor_end", "not_the_next_index", F.col("index").isNotNull() & ~F.col("anchor_end").eqNullSafe(F.col("index") + 1)),
    ]
    for c in ("width", "height"):
        rules += [("error", f".{c}", "not_a_number", F.col("index").isNotNull() & F.col(c).isNotNull() & ~_finite(c)), ("error", f".{c}", "not_positive", F.col("index").isNotNull() & _finite(c) & (F.col(c) <= 0))]
    return _found(rows, rules)


def block_issues(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Blocks against their page (by `page`, with index, width and height) and against each other."""
    within = Window.partitionBy("doc", "page").orderBy("pos")
    before = F.max("ord").over(within.rowsBetween(Window.unboundedPreceding, -1))
    # the order before is that of the last block that has one
    last = F.last("ord", True).over(within.rowsBetween(Window.unboundedPreceding, -1))
    rows = blocks.join(pages.select("doc", "page", "index", "width", "height"), ["doc", "page"]).where("index is not null")
    rows = rows.withColumn("path", F.concat(_page_path(), F.lit(".blocks["), F.col("pos"), F.lit("]")))
    rows = rows.withColumn("nth_id", F.row_number().over(Window.partitionBy("doc", "id").orderBy("page", "pos"))).withColumn("nth_ord", F.row_number().over(Window.partitionBy("doc", "page", "ord").orderBy("pos")))
    rows = rows.withColumn("last_ord", last).withColumn("top_ord", before)
    named = F.coalesce(F.col("id"), F.lit("")) != ""
    anchored = F.col("anchor_start").isNotNull() & F.col("anchor_end").isNotNull()
    rules = [
        ("error", ".id", "missing", ~named),
        ("error", ".id", "duplicate", named & (F.col("nth_id") > 1)),
        ("error", ".type", "not_canonical", ~F.coalesce(F.col("type").isin(*TYPES), F.lit(False))),
        ("error", ".page_index", "not_the_page", ~F.col("page_index").eqNullSafe(F.col("index"))),
        ("error", ".order", "not_an_integer", F.col("ord").isNull()),
        ("warning", ".order", "duplicate", F.col("ord").isNotNull() & (F.col("nth_ord") > 1)),
        ("warning", ".order", "not_sorted", F.col("ord") < F.col("last_ord")),
        ("error", ".anchors", "not_integers", ~anchored),
        ("error", ".anchors", "not_around_the_page", anchored & ~((F.col("anchor_start") <= F.col("index")) & (F.col("index") < F.col("anchor_end")))),
        ("error", ".polygon", "not_four_points", F.size("polygon") != 4),
        *confidence_rules(),
        *box_rules(),
    ]
    return _found(rows, rules)


def span_issues(spans: DataFrame, pages: DataFrame) -> DataFrame:
    path = F.concat(_page_path(), F.lit(".blocks["), F.col("pos"), F.lit("].spans["), F.col("span"), F.lit("]"))
    rows = spans.join(pages.select("doc", "page", "width", "height"), ["doc", "page"]).withColumn("path", path)
    blank = F.col("text").isNotNull() & (F.length(F.regexp_replace("text", r"(?U)\s", "")) == 0)
    return _found(rows, [("error", ".text", "not_a_string", F.col("text").isNull()), ("warning", ".text", "empty", blank), *confidence_rules(), *box_rules()])


def provenance_issues(holders: DataFrame, provenance: DataFrame) -> DataFrame:
    """holders: doc, path of what must name its source; provenance: doc, path, item, backend, stage, confidence."""
    lacking = holders.join(provenance.select("doc", "path").distinct(), ["doc", "path"], "left_anti")
    none = lacking.select("doc", F.lit("warning").alias("severity"), F.concat("path", F.lit(".provenance")).alias("path"), F.lit("missing").alias("code"))
    rows = provenance.withColumn("path", F.concat("path", F.lit(".provenance["), F.col("item"), F.lit("]")))
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return none.unionByName(_found(rows, [("warning", ".backend", "unnamed", empty("backend")), ("warning", ".stage", "unnamed", empty("stage")), *confidence_rules()]))


def publishable(issues: DataFrame, documents: DataFrame, blocks: DataFrame) -> DataFrame:
    """documents with whether they may be published: they have blocks and no errors."""
    errors = issues.where("severity = 'error'").groupBy("doc").agg(F.count("*").alias("errors"))
    sizes = blocks.groupBy("doc").agg(F.count("*").alias("blocks"))
    rows = documents.select("doc").join(errors, "doc", "left").join(sizes, "doc", "left").na.fill(0, ["errors", "blocks"])
    return rows.withColumn("publishable", (F.col("errors") == 0) & (F.col("blocks") > 0))


def fingerprint(blocks: DataFrame) -> DataFrame:
    """(doc, sha256) over all that decides a document's meaning: id, type, text, box and confidence of its blocks in order."""
    said = F.concat_ws("\u001f", "id", "type", F.coalesce("text", F.lit("")), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (*SIDES, "confidence")))
    rows = blocks.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("page", "ord", said.alias("s")))).alias("r"))
    return rows.select("doc", F.sha2(F.array_join(F.transform("r", lambda x: x["s"]), "\u001e"), 256).alias("sha256"))


def from_live(blocks: DataFrame) -> DataFrame:
    """Blocks of the live tree (doc, page, type, n, text, box) as Middle blocks: path ids, canonical types, anchors."""
    ident = F.concat(F.lit("/page/"), F.col("page"), F.lit("/"), F.col("type"), F.lit("/"), F.col("n"))
    along = Window.partitionBy("doc", "page").orderBy("ord", "n")
    return blocks.select(
        "doc", F.col("page").alias("page_index"), ident.alias("id"), canonical_type(F.col("type")).alias("type"), F.col("type").alias("raw_label"), (F.row_number().over(along) - 1).alias("ord"),
        F.trim("text").alias("text"), *SIDES, F.col("page").alias("anchor_start"), (F.col("page") + 1).alias("anchor_end"),
    )


#: What a compact span keeps of its attributes and of its provenance.
SPAN_ATTRS = ("font_size", "formats", "has_superscript", "has_subscript", "char_range")
PROVENANCE_KEYS = ("backend", "stage")


def compact_spans(spans: DataFrame, attrs: str = "attrs", provenance: str = "provenance") -> DataFrame:
    """Spans whose attribute and provenance maps hold only what readers need."""
    keep = lambda c, names: F.map_filter(F.coalesce(F.col(c), F.create_map().cast("map<string,string>")), lambda k, v: k.isin(*names) & v.isNotNull())
    return spans.withColumn(attrs, keep(attrs, SPAN_ATTRS)).withColumn(provenance, keep(provenance, PROVENANCE_KEYS))


def lean(spans: DataFrame, options: Column, blockers: tuple[str, ...] = ("word_boxes", "ocr_merge", "line_numbers")) -> DataFrame:
    """Spans without those of single words (kind word), but for documents one of whose `options` needs them."""
    return spans.where((F.col("kind") != "word") | F.arrays_overlap(options, F.array(*(F.lit(b) for b in blockers))))


def merged_items(items: DataFrame, blocks: DataFrame, least: float = 0.5) -> DataFrame:
    """Recognised items (page, id, text, box) put to blocks: page, block, kind, texts in order.

    An item goes to the block that holds most of it, at least `least`; one without a box goes to the page's
    first text block; one that no block takes becomes a Text block of its own (kind new).
    """
    boxed = items.where("x0 is not null")
    held = layout.contained_best(boxed.drop("text"), blocks.drop("kind"), least)
    first = blocks.where("kind = 'Text'").groupBy("page").agg(F.min("id").alias("block"))
    to = held.select("page", F.col("item").alias("id"), "block").unionByName(items.where("x0 is null").select("page", "id").distinct().join(first, "page", "left").select("page", "id", "block"))
    rows = items.select("page", "id", "text").dropDuplicates(["page", "id"]).join(to, ["page", "id"])
    rows = rows.withColumn("kind", F.when(F.col("block").isNull(), "new").otherwise("merged")).withColumn("block", F.coalesce("block", "id"))
    texts = rows.groupBy("page", "block", "kind").agg(F.array_sort(F.collect_list(F.struct("id", "text"))).alias("r"))
    return texts.select("page", "block", "kind", F.array_join(F.transform("r", lambda x: x["text"]), "\n").alias("text"))


def smoke(blocks: DataFrame, expected: DataFrame) -> DataFrame:
    """expected (doc, required: array of types, least) with what of it a document fails: missing types, too few blocks."""
    seen = blocks.groupBy("doc").agg(F.collect_set("type").alias("types"), F.count("*").alias("blocks"))
    rows = expected.join(seen, "doc", "left")
    missing = F.array_sort(F.array_except("required", F.coalesce("types", F.array().cast("array<string>"))))
    return rows.select("doc", F.coalesce("blocks", F.lit(0)).alias("blocks"), F.array_join(missing, ",").alias("missing"), ((F.size(missing) == 0) & (F.coalesce("blocks", F.lit(0)) >= F.col("least"))).alias("passed"))


def options(explicit: Column, stored: Column, default: Column) -> Column:
    """An option's value: what is asked for, else what the document was made with, else the default."""
    return F.coalesce(explicit, stored, default)


def agreed(a: Column, b: Column, name: str) -> Column:
    """The value of an option that has two names; an error where both are given and differ."""
    return F.when(a != b, F.raise_error(F.lit(f"{name} is given twice, with different values"))).otherwise(F.coalesce(a, b))


def review_status(blocks: DataFrame, low: float = 0.5) -> DataFrame:
    """By document: blocks to look at (no text, low confidence, table without markup) and the status they lead to."""
    empty = F.coalesce(F.trim("text"), F.lit("")) == ""
    sums = blocks.groupBy("doc").agg(F.count_if(empty).alias("empty"), F.count_if(F.col("confidence") < low).alias("doubtful"), F.count_if((F.col("type") == "Table") & ~F.col("text").contains("<table")).alias("tables"), F.count("*").alias("blocks"))
    return sums.withColumn("status", F.when(F.col("empty") + F.col("tables") > 0, "needs_review").when(F.col("doubtful") > 0.2 * F.col("blocks"), "check").otherwise("ready"))
