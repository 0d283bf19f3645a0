"""Block trees: hierarchy, neighbours, summaries, checks, links and renderings."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Canonical block types.
TYPES = ("SectionHeader", "Text", "Table", "Figure", "Picture", "Caption", "Code", "Equation", "Footnote", "ListItem", "PageHeader", "PageFooter", "PageNumber", "Reference", "Quote", "MarginalNote", "ComplexRegion", "Form", "Handwriting", "TableOfContents", "Line")
#: Other names of block types.
ALIASES = {
    "heading": "SectionHeader", "title": "SectionHeader", "doc_title": "SectionHeader", "document_title": "SectionHeader", "paragraph_title": "SectionHeader", "section_title": "SectionHeader", "subtitle": "SectionHeader", "chapter_title": "SectionHeader", "headline": "SectionHeader",
    "paragraph": "Text", "plain_text": "Text", "body": "Text", "content": "Text", "abstract": "Text", "aside_text": "Text", "vertical_text": "Text",
    "list_item": "ListItem", "list": "ListItem", "bullet": "ListItem", "image": "Picture", "img": "Picture", "photo": "Picture", "seal": "Picture", "chart": "Figure", "diagram": "Figure", "figure_body": "Figure", "table_body": "Table",
    "formula": "Equation", "display_formula": "Equation", "isolate_formula": "Equation", "interline_equation": "Equation", "math": "Equation", "header": "PageHeader", "running_header": "PageHeader", "header_image": "PageHeader", "footer": "PageFooter", "running_footer": "PageFooter", "footer_image": "PageFooter",
    "table_caption": "Caption", "figure_caption": "Caption", "image_caption": "Caption", "figure_title": "Caption", "table_title": "Caption", "chart_title": "Caption", "table_footnote": "Footnote", "image_footnote": "Footnote", "note": "Footnote", "endnote": "Footnote",
    "number": "PageNumber", "folio": "PageNumber", "bibliography": "Reference", "references": "Reference", "reference_content": "Reference", "blockquote": "Quote", "block_quote": "Quote", "margin_note": "MarginalNote", "marginalia": "MarginalNote", "sidenote": "MarginalNote", "code_block": "Code", "algorithm": "Code", "listing": "Code",
    "toc": "TableOfContents", "contents": "TableOfContents", "handwritten": "Handwriting",
}


def section_path(blocks: DataFrame, doc: str, levels: int = 6) -> DataFrame:
    """blocks with s1 to s6: the heading each level stands under; a heading clears its own level and those below."""
    along = Window.partitionBy(doc).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    out = blocks
    for n in range(1, levels + 1):
        # the last heading of this level or a higher one; it counts if it is of this level
        last = F.last(F.when(F.col("level") <= n, F.struct("level", "id")), True).over(along)
        out = out.withColumn(f"s{n}", F.when(last["level"] == n, last["id"]))
    return out


def section_ends(headings: DataFrame, doc: str, end: str) -> DataFrame:
    """headings with the place of the next heading at their level or above, or the document's end."""
    later = headings.select(F.col(doc).alias("d"), F.col("ord").alias("o"), F.col("level").alias("l"))
    pairs = headings.join(later, (F.col(doc) == F.col("d")) & (F.col("o") > F.col("ord")) & (F.col("l") <= F.col("level")), "left")
    return pairs.groupBy(*headings.columns).agg(F.coalesce(F.min("o"), F.first(end)).alias("section_end"))


def neighbours(blocks: DataFrame, doc: str, ignored: tuple[str, ...] = ()) -> DataFrame:
    """Blocks of other than the ignored types with the ids before and after them, across pages."""
    along = Window.partitionBy(doc).orderBy("page", "ord")
    return blocks.where(~F.col("type").isin(*ignored)).withColumns({"previous": F.lag("id").over(along), "next": F.lead("id").over(along)})


def relabel(blocks: DataFrame, rules: DataFrame) -> DataFrame:
    """blocks whose type a rule (old, new, threshold) renames where their confidence is at most the threshold."""
    matched = blocks.join(F.broadcast(rules), F.col("type") == F.col("old"), "left")
    return matched.withColumn("type", F.when(F.col("confidence") <= F.col("threshold"), F.col("new")).otherwise(F.col("type"))).select(*blocks.columns)


def canonical_type(raw: Column) -> Column:
    """A canonical type by its own name, an alias, or in PascalCase; else ComplexRegion."""
    alias = F.create_map(*(F.lit(x) for p in ALIASES.items() for x in p))
    pascal = F.regexp_replace(F.initcap(F.regexp_replace(raw, "[_-]", " ")), " ", "")
    return F.when(raw.isin(*TYPES), raw).otherwise(F.coalesce(F.try_element_at(alias, F.lower(raw)), F.when(pascal.isin(*TYPES), pascal), F.lit("ComplexRegion")))


def heading_level(*given: Column) -> Column:
    """The first level that is known, else 2, held between 1 and 6."""
    return F.greatest(F.lit(1), F.least(F.lit(6), F.coalesce(*given, F.lit(2))))


#: Keys that may say a heading's level, in the order in which they count; labels of a document's own title.
LEVEL_KEYS = ("heading_level", "raw_heading_level", "text_level", "level")
TITLE_LABELS = ("doc_title", "doctitle", "document_title")
SECTION_LABELS = ("paragraph_title", "section_header", "sectionheader", "heading")


def told_level(attributes: Column) -> Column:
    """The first key of a JSON object that says a level above 0; null if none does."""
    number = lambda k: F.regexp_extract(F.get_json_object(attributes, f"$.{k}"), r"^\s*(\d{1,9})\s*$", 1)
    values = [F.nullif(F.nullif(number(k), F.lit("")).cast("int"), F.lit(0)) for k in LEVEL_KEYS]
    return F.coalesce(*values)


def heading_levels(headings: DataFrame) -> DataFrame:
    """headings (attributes, raw: JSON objects; text) with level, level_source (own, upstream, inferred or default) and title_role.

    What the heading's own keys say counts first, then those of its raw form, then its label (a document's title is 1) and
    the depth of a number that opens it (`2.1` is 2), else 2; all held between 1 and 6.
    """
    first = lambda *keys: F.coalesce(*(F.get_json_object(c, f"$.{k}") for c, k in keys))
    label = first(("attributes", "raw_label"), ("attributes", "raw_block_type"), ("raw", "block_label"), ("raw", "label"), ("raw", "type"))
    name = F.translate(F.lower(F.trim(F.coalesce(label, F.lit("")))), "- ", "__")
    numbered = F.regexp_extract("text", r"^\s*(\d{1,3}(?:\.\d{1,3})*)\.?\s+\S", 1)
    inferred = F.when(name.isin(*TITLE_LABELS), 1).when(numbered != "", F.size(F.split(numbered, r"\.")))
    own, upstream = told_level(F.col("attributes")), told_level(F.col("raw"))
    source = F.when(own.isNotNull(), "own").when(upstream.isNotNull(), "upstream").when(inferred.isNotNull(), "inferred").otherwise("default")
    role = F.when(name.isin(*TITLE_LABELS), "doc_title").when(name == "title", "title").when(name.isin(*SECTION_LABELS), "section_title").otherwise("unknown")
    return headings.withColumns({"level": heading_level(own, upstream, inferred), "level_source": source, "title_role": role})


def summary(blocks: DataFrame, doc: str) -> DataFrame:
    """Pages, blocks and the number of blocks by type of each document."""
    types = blocks.groupBy(doc, "type").agg(F.count("*").alias("n")).groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("type", "n"))).alias("types"))
    whole = blocks.groupBy(doc).agg(F.countDistinct("page").alias("pages"), F.count("*").alias("blocks"), F.sum(F.length("text")).alias("chars"))
    return whole.join(types, doc)


def issues(blocks: DataFrame, doc: str) -> DataFrame:
    """What breaks the rules for blocks, one row each: doc, severity, code, path."""
    path = F.concat(F.lit("pages["), F.col("page"), F.lit("].blocks["), F.col("ord"), F.lit("]"))
    finite = F.lit(True)
    for c in ("x0", "y0", "x1", "y1"):
        finite &= ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    rules = [
        ("error", "unknown_type", ~F.col("type").isin(*TYPES)),
        ("error", "not_finite", ~finite),
        ("error", "bbox_reversed", (F.col("x1") < F.col("x0")) | (F.col("y1") < F.col("y0"))),
        ("warning", "bbox_empty", (F.col("x1") == F.col("x0")) | (F.col("y1") == F.col("y0"))),
        ("warning", "confidence_range", (F.col("confidence") < 0) | (F.col("confidence") > 1)),
        ("error", "empty_id", F.coalesce(F.col("id"), F.lit("")) == ""),
    ]
    found = F.filter(F.array(*(F.when(test, F.struct(F.lit(s).alias("severity"), F.lit(c).alias("code"))) for s, c, test in rules)), lambda x: x.isNotNull())
    own = blocks.select(doc, F.explode(found).alias("x"), path.alias("path")).select(doc, "x.severity", "x.code", "path")
    twice = blocks.groupBy(doc, "id").agg(F.count("*").alias("n")).where("n > 1").select(doc, F.lit("error").alias("severity"), F.lit("duplicate_id").alias("code"), F.col("id").alias("path"))
    return own.unionByName(twice)


def dangling(relations: DataFrame, blocks: DataFrame, key: str, target: str) -> DataFrame:
    """Relations whose target is not there."""
    return relations.where(F.col(target).isNotNull()).join(blocks.select(F.col(key).alias(target)), target, "left_anti")


def resolve_links(links: DataFrame, anchors: DataFrame) -> DataFrame:
    """links (href) with the anchor they reach: by the whole reference, else without its fragment."""
    whole = anchors.select(F.col("ref").alias("href"), F.col("anchor").alias("a1"))
    bare = anchors.select(F.col("ref").alias("base"), F.col("anchor").alias("a2"))
    out = links.withColumn("base", F.regexp_replace("href", "#.*$", "")).join(whole, "href", "left").join(bare, "base", "left")
    return out.withColumn("target", F.coalesce("a1", "a2")).drop("a1", "a2", "base")


def resolve_notes(calls: DataFrame, notes: DataFrame, doc: str) -> DataFrame:
    """Footnote calls with the first note of their marker on the same page."""
    first = notes.groupBy(doc, "page", "marker").agg(F.min("ord").alias("note"))
    return calls.join(first, [doc, "page", "marker"], "left")


def page_chunks(pages: DataFrame, doc: str, size: int, text: str = "text") -> DataFrame:
    """Runs of `size` pages with their texts in order."""
    place = F.row_number().over(Window.partitionBy(doc).orderBy("page")) - 1
    rows = pages.withColumn("chunk", F.floor(place / size).cast("int")).groupBy(doc, "chunk")
    return rows.agg(F.array_sort(F.collect_list(F.struct("page", F.col(text).alias("t")))).alias("r")).select(doc, "chunk", F.size("r").alias("pages"), F.array_join(F.transform("r", lambda x: x["t"]), "\n\n").alias("text"))


def page_slices(parts: DataFrame, doc: str) -> DataFrame:
    """Half-open [start, end) of each page in the joined text."""
    upto = F.sum("size").over(Window.partitionBy(doc).orderBy("page").rowsBetween(Window.unboundedPreceding, 0))
    return parts.withColumn("end", upto).withColumn("start", F.col("end") - F.col("size"))


def chunks(blocks: DataFrame, doc: str) -> DataFrame:
    """One row per block with its HTML and the headings above it."""
    level = heading_level(F.col("level")).cast("string")
    tag = F.when(F.col("type") == "SectionHeader", F.concat(F.lit("h"), level)).when(F.col("type") == "ListItem", "li").when(F.col("type") == "Code", "pre").when(F.col("type") == "Quote", "blockquote").otherwise("p")
    safe = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", "&", "&amp;"), "<", "&lt;"), ">", "&gt;")
    path = section_path(blocks, doc)
    above = F.filter(F.array(*(F.col(f"s{n}") for n in range(1, 7))), lambda x: x.isNotNull())
    return path.select(doc, "id", "type", F.concat(F.lit("<"), tag, F.lit(">"), safe, F.lit("</"), tag, F.lit(">")).alias("html"), above.alias("sections"))


def markdown(blocks: DataFrame, doc: str) -> DataFrame:
    """A document as Markdown, its blocks in order; footnotes last, the same one once."""
    line = (
        F.when(F.col("type") == "SectionHeader", F.concat(F.repeat(F.lit("#"), heading_level(F.col("level"))), F.lit(" "), "text"))
        .when(F.col("type") == "ListItem", F.concat(F.lit("- "), "text"))
        .when(F.col("type") == "Quote", F.concat(F.lit("> "), "text"))
        .when(F.col("type") == "Caption", F.concat(F.lit("*"), "text", F.lit("*")))
        .when(F.col("type") == "Code", F.concat(F.lit("```\n"), "text", F.lit("\n```")))
        .when(F.col("type") == "Footnote", F.concat(F.lit("**Footnote** "), "text"))
        .otherwise(F.regexp_replace("text", r"^\{(\d+)\}$", r"\\{$1\\}"))
    )
    zone = F.when(F.col("type") == "Footnote", 1).otherwise(0)
    rows = blocks.where(F.coalesce(F.trim("text"), F.lit("")) != "").withColumn("md", line).withColumn("zone", zone)
    once = F.row_number().over(Window.partitionBy(doc, "zone", F.when(F.col("zone") == 1, F.col("md")).otherwise(F.col("id"))).orderBy("ord"))
    kept = rows.withColumn("_n", once).where("_n = 1").groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("zone", "ord", "md"))).alias("r"))
    return kept.select(doc, F.array_join(F.transform("r", lambda x: x["md"]), "\n\n").alias("markdown"))


def cells_to_html(cells: DataFrame, table: str) -> DataFrame:
    """Tables from their cells, by row and column, with spans."""
    span = lambda c, name: F.when(F.col(c) > 1, F.concat(F.lit(f' {name}="'), F.col(c), F.lit('"'))).otherwise(F.lit(""))
    cell = F.concat(F.lit("<td"), span("colspan", "colspan"), span("rowspan", "rowspan"), F.lit(">"), "text", F.lit("</td>"))
    rows = cells.groupBy(table, "row").agg(F.array_sort(F.collect_list(F.struct("col", cell.alias("h")))).alias("r"))
    made = rows.select(table, "row", F.concat(F.lit("<tr>"), F.array_join(F.transform("r", lambda x: x["h"]), ""), F.lit("</tr>")).alias("h"))
    whole = made.groupBy(table).agg(F.array_sort(F.collect_list(F.struct("row", "h"))).alias("r"))
    return whole.select(table, F.concat(F.lit("<table>"), F.array_join(F.transform("r", lambda x: x["h"]), ""), F.lit("</table>")).alias("html"))


def quote_levels(blocks: DataFrame, doc: str, share: float = 0.1, near: float = 0.01) -> DataFrame:
    """blocks with `quote_level`: a block set in by `share` of the one before opens level 1, one that
    aligns with it goes on, one set in further adds a level. Each depends on the one before it."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ord")
        levels, last = [], None
        for x0, x1 in zip(rows["x0"], rows["x1"], strict=True):
            level = 0
            if last is not None:
                a0, a1, above = last
                width = a1 - a0
                if x0 - a0 > share * width and x1 <= a1:
                    level = above + 1
                elif above and abs(x0 - a0) <= near * width:
                    level = above
            levels.append(level)
            last = (x0, x1, level)
        return rows.assign(quote_level=levels)

    schema = blocks.schema.simpleString()[len("struct<") : -1].replace(":", " ")
    return blocks.groupBy(doc).applyInPandas(fold, f"{schema}, quote_level int")


def list_levels(blocks: DataFrame, doc: str, step: float = 5.0) -> DataFrame:
    """list items with `list_level`, from a stack of indents."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ord")
        stack: list[float] = []
        levels = []
        for x0 in rows["x0"]:
            while stack and x0 < stack[-1] - step:
                stack.pop()
            if not stack or x0 > stack[-1] + step:
                stack.append(x0)
            levels.append(len(stack) - 1)
        return rows.assign(list_level=levels)

    schema = blocks.schema.simpleString()[len("struct<") : -1].replace(":", " ")
    return blocks.groupBy(doc).applyInPandas(fold, f"{schema}, list_level int")


def page_statistics(blocks: DataFrame, doc: str) -> DataFrame:
    """By page: the most frequent block type, ties to the first name, the number of blocks and of characters."""
    counted = blocks.groupBy(doc, "page", "type").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    return counted.groupBy(doc, "page").agg(F.min_by("type", F.struct(-F.col("n"), "type")).alias("type"), F.sum("n").alias("blocks"), F.sum("chars").alias("chars"))


def raw_texts(lines: DataFrame, by: list[str]) -> DataFrame:
    """The text of each group from its parts in order (ord, text): a line end after each part that has none, but the last."""
    rows = lines.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("ord", F.coalesce("text", F.lit("")).alias("t")))).alias("r"))
    ended = F.transform("r", lambda x: F.when(x["t"].endswith("\n"), x["t"]).otherwise(F.concat(x["t"], F.lit("\n"))))
    return rows.select(*by, F.regexp_replace(F.array_join(ended, ""), r"\n$", "").alias("text"))


def table_of_contents(blocks: DataFrame, doc: str) -> DataFrame:
    """(doc, entries): the headings of a document in order as structs of ord, page, level and title."""
    heads = blocks.where("type = 'SectionHeader'")
    return heads.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("ord", "page", heading_level(F.col("level")).alias("level"), F.trim("text").alias("title")))).alias("entries"))


def reusable(results: DataFrame, wanted: DataFrame) -> DataFrame:
    """The newest result of each wanted (sha256, config)."""
    return results.join(wanted.select("sha256", "config").distinct(), ["sha256", "config"], "left_semi").groupBy("sha256", "config").agg(F.max_by("id", F.struct("at", "id")).alias("id"))
