"""Decisions on pages and blocks, comparisons of runs, and small rewrites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def admissible_pages(objects: DataFrame, page: list[str], full: float = 0.65) -> DataFrame:
    """Whether a page's text layer may be used, from its objects (kind, render_mode, embedded, share).

    Not if all text is invisible, a font is not embedded, or an image fills the page under the text.
    """
    text = F.col("kind") == "text"
    sums = objects.groupBy(*page).agg(
        F.count_if(text).alias("texts"),
        F.bool_and(F.when(text, F.col("render_mode") == 3)).alias("hidden"),
        F.bool_or(F.when(text, ~F.col("embedded"))).alias("foreign"),
        F.max(F.when(F.col("kind") == "image", F.col("share"))).alias("image"),
    )
    usable = (F.col("texts") > 0) & ~F.coalesce("hidden", F.lit(False)) & ~F.coalesce("foreign", F.lit(False)) & (F.coalesce("image", F.lit(0.0)) < full)
    return sums.select(*page, usable.alias("usable"))


def text_source(pages: DataFrame, least: float = 0.25, overlaps: float = 0.2) -> DataFrame:
    """pages (bad, covered, blocks, overlapping, lines) with where their text is to come from."""
    spoilt = F.col("bad") | (F.col("covered") < least * F.col("blocks")) | (F.col("overlapping") > overlaps * F.col("lines"))
    return pages.withColumn("source", F.when((F.col("lines") == 0) | spoilt, "ocr").otherwise("text_layer"))


def leaves(blocks: DataFrame, ident: str, parent: str) -> DataFrame:
    """Blocks that no block names as its parent."""
    return blocks.join(blocks.select(F.col(parent).alias(ident)).where(F.col(ident).isNotNull()).distinct(), ident, "left_anti")


def annotation_kind(ratio: Column, text: Column, doubled: Column) -> Column:
    """The kind of a small-type annotation inside a text, or null: bracketed, double line, by size and length."""
    bracketed = F.trim(text).rlike(r"^(\(.*\)|\[.*\]|\{.*\}|<.*>|（.*）|［.*］|〔.*〕|【.*】)$")
    small = ratio < 0.85
    return F.when(bracketed, "bracket").when(small & doubled, "double_line").when((ratio < 0.7) & (F.length(text) < 30), "note").when((ratio < 0.7) & (F.length(text) < 100), "comment").when(small, "other")


def merged_tags(html: Column, tag: str, rounds: int = 4) -> Column:
    """Neighbouring elements of one tag as one."""
    out = html
    for _ in range(rounds):
        out = F.regexp_replace(out, rf"</{tag}>(\s*)<{tag}>", "$1")
    return out


def unwrapped_math(text: Column) -> Column:
    """Math that only holds a number or a word, as plain text."""
    t = F.regexp_replace(text, r"\$([A-Za-z0-9 .,]+)\$", "$1")
    return F.regexp_replace(t, r"\\\(\s*([A-Za-z0-9 .,]+?)\s*\\\)", "$1")


def extracted_page(text: Column, patterns: list[str]) -> Column:
    """The first pattern's first group that is a page label: a number from 1 to 9999 or a Roman numeral."""
    tried = [F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns]
    good = F.filter(F.array(*tried), lambda x: x.rlike("^[1-9][0-9]{0,3}$") | F.lower(x).rlike("^[ivxlcdm]{1,12}$"))
    return F.try_element_at(good, F.lit(1))


def contents_entry(line: Column) -> Column:
    """A line of a table of contents: struct(title, page), or null."""
    pattern = r"^\s*(.*\p{L}.*?)[\s.·…]+([0-9]{1,4}|[ivxlcdm]{1,8})\s*$"
    return F.when(line.rlike(pattern), F.struct(F.trim(F.regexp_extract(line, pattern, 1)).alias("title"), F.regexp_extract(line, pattern, 2).alias("page")))


def expired(tasks: DataFrame, now: Column, attempt: float, lease: float, queue: float) -> DataFrame:
    """Tasks (status, started, updated, queued) that ran, were silent or waited too long, with the reason."""
    run = F.col("status") == "running"
    why = F.when(run & (now - F.col("started") >= attempt), "attempt_timeout").when(run & (now - F.col("updated") >= lease), "lease_expired").when((F.col("status") == "queued") & (now - F.col("queued") >= queue), "queue_timeout")
    return tasks.withColumn("reason", why).where("reason is not null")


def compared(reports: DataFrame, case: list[str], backend: str, backends: list[str], value: str) -> DataFrame:
    """One row a case with each backend's value and the best one's name."""
    wide = reports.groupBy(*case).pivot(backend, backends).agg(F.max(value))
    best = F.array_sort(F.filter(F.array(*(F.struct((-F.col(b)).alias("v"), F.lit(b).alias("b")) for b in backends)), lambda x: x["v"].isNotNull()))
    return wide.withColumn("best", F.try_element_at(best, F.lit(1))["b"])


def dominant_profile(candidates: DataFrame, doc: str, least: float) -> DataFrame:
    """The zone and alignment that most pages' best candidates share, ties to the one seen first."""
    best = candidates.where(F.col("score") >= least).groupBy(doc, "page").agg(F.max_by(F.struct("zone", "alignment"), F.struct("score", "zone", "alignment")).alias("p"))
    counted = best.groupBy(doc, "p").agg(F.count("*").alias("n"), F.min("page").alias("first"))
    return counted.groupBy(doc).agg(F.min_by(F.struct("p", "n"), F.struct(-F.col("n"), "first")).alias("x")).select(doc, "x.p.zone", "x.p.alignment", "x.n")


def package_version(source: Column, profile: Column, transform: Column) -> Column:
    """A version that only the content decides."""
    return F.substring(F.sha2(F.concat_ws("|", source, profile, transform), 256), 1, 12)


def page_coordinates(value: Column, space: Column, size: Column) -> Column:
    """A coordinate in page units from its declared space: normalized (0 to 1), thousandths or pixels."""
    return F.when(space == "normalized", value * size).when(space == "thousandths", value / 1000 * size).otherwise(value)


def without_trailing_hyphen(lines: DataFrame, order: Window) -> DataFrame:
    """lines whose hyphen at the end is dropped where the next line goes on in lower case."""
    on = F.lead("line").over(order).rlike("^[a-zà-ÿ]")
    return lines.withColumn("line", F.when(F.coalesce(on, F.lit(False)), F.regexp_replace("line", r"(?<=\p{L})[-‐¬]\s*$", "")).otherwise(F.col("line")))
