"""Renderings of documents: scholarly Markdown, HTML and JSON trees, recognised lines, body text, artifacts and run records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as fn
from .documents import heading_level

#: The line that closes a page's head.
SEPARATOR = "---"


def escaped_html(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "&", "&amp;"), "<", "&lt;"), ">", "&gt;")


def _fenced(text: Column) -> Column:
    """Code in a fence that is longer than any run of backticks inside."""
    runs = F.transform(F.regexp_extract_all(text, F.lit("(`+)"), 1), lambda r: F.length(r))
    fence = F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1))
    return F.concat(fence, F.lit("\n"), text, F.lit("\n"), fence)


def block_markdown(kind: Column, text: Column, level: Column, margin: str = "plain") -> Column:
    """A block as Markdown by its type; empty texts give null, and so do margin notes if `margin` is drop."""
    body = F.regexp_replace(text, r"(?m)^\{(\d+)\}$", r"\\{$1\\}")
    item = F.regexp_replace(text, r"^(\d{1,3})([.)])", r"$1\\$2")
    note = {"drop": F.lit(None).cast("string"), "plain": text, "margin_comments": F.concat(F.lit("<!-- Margin: "), text, F.lit(" -->"))}[margin]
    made = (
        F.when(kind == "SectionHeader", F.concat(F.repeat(F.lit("#"), heading_level(level)), F.lit(" "), text))
        .when(kind == "Code", _fenced(text)).when(kind == "Equation", F.concat(F.lit("$$\n"), text, F.lit("\n$$"))).when(kind == "Caption", F.concat(F.lit("*"), text, F.lit("*")))
        .when(kind == "Quote", F.concat(F.lit("> "), F.regexp_replace(text, "\n", "\n> "))).when(kind == "ListItem", F.when(text.rlike(r"^\d{1,3}[.)]"), item).otherwise(F.concat(F.lit("- "), text)))
        .when(kind == "MarginalNote", note).when(kind == "ComplexRegion", F.regexp_replace(body, "\n", "  \n")).otherwise(body)
    )
    return F.when(F.trim(F.coalesce(text, F.lit(""))) != "", made)


def scholarly_markdown(pages: DataFrame, blocks: DataFrame, margin: str = "plain") -> DataFrame:
    """(doc, markdown) from pages (doc, page, printed) and blocks (doc, page, ord, type, text, level, marker).

    A page is its anchor, a separator, its printed number, headers, footers, the body in order and the
    notes last: a confirmed note by its marker, any other one as `**Footnote**`, each once a page. Pages stand three line
    ends apart; the anchor after the last page and a separator close the document.
    """
    comment = lambda name, c: F.concat(F.lit(f"<!-- {name}: "), c, F.lit(" -->"))
    text = F.trim(F.coalesce("text", F.lit("")))
    zone = F.when(F.col("type") == "PageHeader", 0).when(F.col("type") == "PageFooter", 1).when(F.col("type") == "Footnote", 3).otherwise(2)
    note = F.when(F.col("marker").isNotNull(), F.concat(F.lit("<sup>"), "marker", F.lit("</sup> "), text)).otherwise(F.concat(F.lit("**Footnote** "), text))
    md = F.when(text == "", F.lit(None)).when(F.col("type") == "PageNumber", F.lit(None)).when(F.col("type") == "PageHeader", comment("PageHeader", text)).when(F.col("type") == "PageFooter", comment("PageFooter", text)).when(F.col("type") == "Footnote", note).otherwise(block_markdown(F.col("type"), text, F.col("level"), margin))
    rows = blocks.withColumn("zone", zone).withColumn("md", md).where("md is not null")
    # a note stands once a page, by its marker or else by its words
    once = F.when(F.col("zone") == 3, F.coalesce("marker", F.regexp_replace(text, r"\s+", " "))).otherwise(F.col("ord").cast("string"))
    rows = rows.withColumn("_once", F.row_number().over(Window.partitionBy("doc", "page", "zone", once).orderBy("ord"))).where("_once = 1")
    body = rows.groupBy("doc", "page").agg(F.array_sort(F.collect_list(F.struct("zone", "ord", "md"))).alias("r"))
    number = blocks.where("type = 'PageNumber'").groupBy("doc", "page").agg(F.min_by("text", "ord").alias("seen"))
    whole = pages.join(body, ["doc", "page"], "left").join(number, ["doc", "page"], "left")
    printed = F.coalesce("printed", "seen")
    head = F.concat(F.lit("\n{"), "page", F.lit("}\n\n" + SEPARATOR), F.when(printed.isNotNull(), F.concat(F.lit("\n"), comment("Page", printed))).otherwise(F.lit("")))
    parts = F.concat(F.array(head), F.coalesce(F.transform("r", lambda x: x["md"]), F.array().cast("array<string>")))
    made = whole.select("doc", "page", F.array_join(parts, "\n\n").alias("md"))
    joined = made.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("page", "md"))).alias("r"), F.max("page").alias("last"))
    return joined.select("doc", F.concat(F.array_join(F.transform("r", lambda x: x["md"]), "\n\n\n"), F.lit("\n\n\n{"), F.col("last") + 1, F.lit("}\n\n" + SEPARATOR + "\n")).alias("markdown"))


def _folded(blocks: DataFrame, depth: int, own: Callable[[Column], Column], join: str) -> DataFrame:
    """The roots of a tree (id, parent, ord, level from 0) with their whole rendering, built from the deepest level up."""
    below = None
    for level in range(depth, -1, -1):
        rows = blocks.where(F.col("level") == level)
        rows = rows.withColumn("inner", F.lit("")) if below is None else rows.join(below, F.col("id") == F.col("_p"), "left").drop("_p").withColumn("inner", F.coalesce("inner", F.lit("")))
        made = rows.select("id", "parent", "ord", own(F.col("inner")).alias("made"))
        if not level:
            return made.select("id", "made")
        below = made.groupBy(F.col("parent").alias("_p")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "id", "made"))), lambda x: x["made"]), join).alias("inner"))
    raise ValueError("depth must not be negative")


def html_tree(blocks: DataFrame, depth: int) -> DataFrame:
    """(id, made) of the root blocks as HTML: each block's tag holds its text and then its children, depth first."""
    return _folded(blocks, depth, lambda inner: F.concat(F.lit("<"), "tag", F.lit(' id="'), "id", F.lit('">'), escaped_html(F.coalesce("text", F.lit(""))), inner, F.lit("</"), "tag", F.lit(">")), "")


def json_tree(blocks: DataFrame, depth: int) -> DataFrame:
    """(id, made) of the root blocks as JSON with their children in order."""
    said = lambda c: F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"([\\\"])", r"\\$1"), "\n", r"\\n"), F.lit('"'))
    return _folded(blocks, depth, lambda inner: F.concat(F.lit('{"id":'), said(F.col("id")), F.lit(',"block_type":'), said(F.col("tag")), F.lit(',"text":'), said(F.col("text")), F.lit(',"children":['), inner, F.lit("]}")), ",")


def ocr_json(lines: DataFrame, doc: str) -> DataFrame:
    """(doc, json): the pages of a document with their lines in order, text and box."""
    pages = lines.groupBy(doc, "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "text", "bbox"))), lambda x: F.struct(x["text"].alias("text"), x["bbox"].alias("bbox"))).alias("lines"))
    whole = pages.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("page", "lines"))).alias("pages"))
    return whole.select(doc, F.to_json(F.struct("pages")).alias("json"))


#: What retrieval reads of a document.
BODY = ("SectionHeader", "Text", "ListItem", "Quote", "Table", "Caption", "Code", "Equation", "Reference")


def body_text(blocks: DataFrame, doc: str) -> DataFrame:
    """(doc, body): the body blocks' texts in order, an empty line apart; furniture and notes are left out."""
    rows = blocks.where(F.col("type").isin(*BODY) & (F.trim(F.coalesce("text", F.lit(""))) != "")).groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("page", "ord", F.trim("text").alias("t")))).alias("r"))
    return rows.select(doc, F.array_join(F.transform("r", lambda x: x["t"]), "\n\n").alias("body"))


def source_markdown(rows: DataFrame) -> DataFrame:
    """(doc, markdown) of a source package's rows: blocks in order, headings by the depth of their structure, page anchors as comments."""
    level = F.coalesce(F.col("level"), F.lit(1))
    md = F.when(F.col("kind") == "anchor", F.concat(F.lit("<!-- Page: "), "text", F.lit(" -->"))).when(F.col("type") == "Footnote", F.concat(F.lit("[^"), "id", F.lit("]: "), "text")).otherwise(block_markdown(F.col("type"), F.col("text"), level))
    made = rows.where(F.col("kind").isin("block", "anchor")).withColumn("md", md).where("md is not null")
    whole = made.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct((F.col("type") == "Footnote").alias("last"), "place", "md"))).alias("r"))
    return whole.select("doc", F.array_join(F.transform("r", lambda x: x["md"]), "\n\n").alias("markdown"))


def text_layer_markdown(docs: DataFrame, ident: str, text: str) -> DataFrame:
    """The fast path of a text layer: its lines cleaned, empty ones dropped, cut words joined, and what its quality asks for."""
    lines = docs.select(ident, F.posexplode(F.split(fn.nfc(fn.text_of(F.col(text))), "\n")).alias("n", "line")).withColumn("line", fn.clean_composed(F.col("line"))).where("line <> ''")
    whole = lines.groupBy(ident).agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("r"), F.sum(F.length(F.translate("line", " ", ""))).alias("visible"))
    joined = fn.repair_hyphens(F.array_join(F.transform("r", lambda x: x["line"]), "\n"))
    return whole.select(ident, joined.alias("markdown"), (F.col("visible") < 24).alias("sparse"))


def safe_name(name: Column) -> Column:
    """A file name of letters, digits, points, lines and dashes; never empty, hidden or a way up."""
    made = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"[^\p{L}\p{N}._-]+", "_"), r"\.{2,}", "."), r"^[._]+|[._]+$", "")
    return F.when(made == "", "document").otherwise(made)


def bundle_names(files: DataFrame, source: str = "source", kind: str = "kind") -> DataFrame:
    """Names in a flat archive: `<source>.<kind>.<extension>`, numbered where two sources would share one."""
    extension = {"markdown": "md", "html": "html", "json": "json", "chunks": "chunks.json", "middle": "middle.json"}
    ext = F.try_element_at(F.create_map(*(F.lit(x) for p in extension.items() for x in p)), F.col(kind))
    stem = F.regexp_replace(safe_name(F.col(source)), r"\.[A-Za-z0-9]{1,5}$", "")
    rows = files.withColumn("_stem", stem)
    n = F.row_number().over(Window.partitionBy(F.lower("_stem"), kind).orderBy(source))
    return rows.withColumn("name", F.concat("_stem", F.when(n > 1, F.concat(F.lit("-"), n)).otherwise(F.lit("")), F.lit("."), F.coalesce(ext, F.lit("bin")))).drop("_stem")


def artifacts(results: DataFrame, ident: str, kinds: list[str]) -> DataFrame:
    """One row per artifact of a result: ident, kind, content, bytes, sha256; kinds that a result lacks are left out."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("content")) for k in kinds)))
    rows = results.select(ident, each.alias("a")).select(ident, "a.kind", "a.content").where("content is not null")
    return rows.withColumn("bytes", F.octet_length("content")).withColumn("sha256", F.sha2("content", 256))


def save_artifacts(rows: DataFrame, folder: str) -> None:
    """Write artifacts by kind; a later run replaces only the kinds it has. Spark's commit keeps a failed run from showing."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("kind").parquet(folder)


def append_records(records: DataFrame, folder: str) -> None:
    """Append records of sources (source, status, at) to a log of JSON lines."""
    records.write.mode("append").json(folder)


def latest_records(records: DataFrame) -> DataFrame:
    """The last status of each source: submitted, completed, failed or skipped; equal times go by that order."""
    rank = F.array_position(F.array(*(F.lit(s) for s in ("submitted", "skipped", "failed", "completed"))), F.col("status"))
    return records.groupBy("source").agg(F.max_by("status", F.struct("at", rank)).alias("status"), F.count("*").alias("records"))


def run_summary(records: DataFrame, by: str) -> DataFrame:
    """Sources by status, pages and seconds of a run, and pages a second over completed ones."""
    done = F.col("status") == "completed"
    return records.groupBy(by).agg(
        F.count("*").alias("sources"), F.count_if(done).alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"), F.sum(F.when(done, F.col("pages")).otherwise(0)).alias("pages"),
        F.round(F.sum(F.when(done, F.col("pages"))) / F.nullif(F.sum(F.when(done, F.col("seconds"))), F.lit(0.0)), 6).alias("pages_a_second"),
    )


def canonical_json(pairs: Column) -> Column:
    """A map of strings as JSON with its keys in order, nulls left out: equal maps give equal texts."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.map_filter(pairs, lambda k, v: v.isNotNull())))))
