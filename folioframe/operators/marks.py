"""Marks in margins and lines, sheet marks, plain LaTeX, replies of models, checks of packages and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import layout


def volume_key(volume: Column) -> Column:
    """A volume as its key: upper case, and in a Roman head the signs that are misread for I; blanks go from the parts after it."""
    whole = F.upper(F.trim(volume))
    head, rest = F.regexp_extract(whole, r"^([^/.,\\]*)", 1), F.regexp_replace(F.regexp_extract(whole, r"^[^/.,\\]*(.*)$", 1), " ", "")
    return F.concat(F.when(head.rlike("[IVXLCDM]"), F.translate(head, "1|", "II")).otherwise(head), rest)


def margin_kind(text: Column, x: Column, height: Column, width: Column, edge: float = 0.1) -> Column:
    """What a short text in the margin is: a section of Plato or of Aristotle by its form, a line number, the spine, a note; null in the body."""
    t = F.trim(text)
    return F.when(
        (x <= edge) | (x >= 1 - edge),
        F.when(t.rlike(r"^[0-9]{1,3}[a-e]([0-9]{1,2})?$"), "stephanus").when(t.rlike(r"^[0-9]{3,4}\s?[ab]\s?[0-9]{0,2}$"), "bekker").when(t.rlike(r"^[0-9]{1,4}$"), "line_number").when((height > 8 * width) & (F.length(t) > 3), "spine").otherwise("note"),
    )


def note_heads(spans: DataFrame, block: list[str]) -> DataFrame:
    """Spans of footnotes with `superscript`: the first of a note, if it is a number or a sign in smaller type than the next one."""
    along = Window.partitionBy(*block).orderBy("span", "size", "text")
    first = F.row_number().over(along) == 1
    small = F.lead("size").over(along).isNull() | (F.col("size") < F.lead("size").over(along))
    return spans.withColumn("superscript", first & F.trim("text").rlike(r"^([0-9]{1,4}|[*†‡§¶]+)$") & small)


def unnumbered(lines: DataFrame, block: list[str], share: float = 0.6, least: int = 4) -> DataFrame:
    """Lines without the numbers that run along a block: where over `share` of at least `least` lines open, or end, with a number, it goes from all of them."""
    counted = lines.groupBy(*block).agg(F.count("*").alias("n"), F.count_if(F.col("text").rlike(r"^\s*[0-9]{1,4}\s")).alias("heads"), F.count_if(F.col("text").rlike(r"\s[0-9]{1,4}\s*$")).alias("tails"))
    rows = lines.join(counted, block)
    many = lambda c: (F.col("n") >= least) & (F.col(c) > share * F.col("n"))
    text = F.when(many("heads"), F.regexp_replace("text", r"^\s*[0-9]{1,4}\s+", "")).otherwise(F.col("text"))
    text = F.when(many("tails"), F.regexp_replace(text, r"\s+[0-9]{1,4}\s*$", "")).otherwise(text)
    return rows.withColumn("text", text).drop("n", "heads", "tails")


def ladders(numbers: DataFrame, page: list[str], least: int = 3) -> DataFrame:
    """Runs of margin numbers (y, value) that grow by one step from the top down: first, step, n; shorter runs than `least` are chance."""
    along = Window.partitionBy(*page).orderBy("y", "value")
    rows = numbers.withColumn("step", F.col("value") - F.lag("value").over(along))
    rows = rows.withColumn("before", F.lag("step").over(along))
    # a number ends a run, and may open the next one: a run is told from its second number on
    new = F.col("step").isNull() | (F.col("step") <= 0) | F.col("before").isNull() | (F.col("step") != F.col("before"))
    rows = rows.withColumn("run", F.sum(new.cast("int")).over(along)).where("step > 0")
    runs = rows.groupBy(*page, "run", "step").agg(F.count("*").alias("steps"), F.min(F.col("value") - F.col("step")).alias("first"))
    return runs.where(F.col("steps") + 1 >= least).select(*page, "first", "step", (F.col("steps") + 1).alias("n"))


def wrapped_prose(lines: DataFrame, block: list[str], near: float = 0.1, share: float = 0.6) -> DataFrame:
    """(block, lines, wrapped): whether a block's lines are prose that was wrapped: all but the last reach the right side, and they share the left one."""
    sides = lines.groupBy(*block).agg(F.min("x0").alias("left"), F.max("x1").alias("right"), F.max("line").alias("last"), F.count("*").alias("lines"))
    rows = lines.join(sides, block)
    wide = F.col("right") - F.col("left")
    inner = F.col("line") < F.col("last")
    sums = rows.groupBy(*block, "lines").agg(F.count_if(inner & (F.col("right") - F.col("x1") <= near * wide)).alias("full"), F.count_if(inner).alias("inner"), F.count_if(F.col("x0") - F.col("left") <= near * wide).alias("aligned"))
    return sums.select(*block, "lines", ((F.col("inner") > 0) & (F.col("full") >= share * F.col("inner")) & (F.col("aligned") >= share * F.col("lines"))).alias("wrapped"))


def plain_latex(text: Column) -> Column:
    """Text commands opened, escaped signs plain, and ties as blanks; mathematics stays."""
    t = F.regexp_replace(text, r"\\(?:text|textit|textbf|emph|mathrm|mathit|mathbf)\{([^{}]*)\}", "$1")
    return F.regexp_replace(F.regexp_replace(t, r"\\([%&#_$])", "$1"), "~", " ")


def outer_unwrapped(html: Column, tag: str) -> Column:
    """HTML without the element that holds all of it; two elements side by side stay."""
    inner = F.regexp_extract(html, rf"(?is)^\s*<{tag}(?:\s[^>]*)?>(.*)</{tag}>\s*$", 1)
    alone = html.rlike(rf"(?is)^\s*<{tag}(?:\s[^>]*)?>.*</{tag}>\s*$") & ~inner.rlike(rf"(?is)^((?!<{tag}[\s>]).)*</{tag}>")
    return F.when(alone, inner).otherwise(html)


def clamped(score: Column) -> Column:
    """Between 0 and 1, to four places, halves to the even digit."""
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 4)


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, or null where there is nothing."""
    return part / F.nullif(whole, F.lit(0))


def lint_counts(docs: DataFrame, ident: str, text: str) -> DataFrame:
    """What a scholarly Markdown text holds: anchors, page, header and footer comments, notes by kind, old note forms, and comments left open."""
    count = lambda p: F.regexp_count(text, F.lit(p))
    return docs.select(
        ident, count(r"(?m)^\{\d+\}$").alias("anchors"), count("<!-- Page: ").alias("pages"), count("<!-- PageHeader: ").alias("headers"), count("<!-- PageFooter: ").alias("footers"), count(r"(?m)^<sup>[^<]+</sup> ").alias("notes"), count(r"(?m)^\*\*Footnote\*\* ").alias("unconfirmed"),
        count(r"(?m)^\[\^[^\]]+\]:|\*\*Footnote [0-9]+\*\*").alias("old_notes"), F.abs(count("<!--") - count("-->")).alias("open_comments"),
    )


def summary_table(rows: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """(markdown): rows as one Markdown table in the order of `by`; null cells are a dash. The rows are a report's, so few."""
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("–")) for c in [by, *columns])), F.lit(" |"))
    whole = rows.groupBy().agg(F.array_sort(F.collect_list(F.struct(by, cells.alias("line")))).alias("r"))
    head = "| " + " | ".join([by, *columns]) + " |\n|" + " --- |" * (len(columns) + 1)
    return whole.select(F.concat_ws("\n", F.lit(head), F.transform("r", lambda x: x["line"])).alias("markdown"))


def component_problems(lines: DataFrame, manifest: DataFrame, ident: list[str]) -> DataFrame:
    """What is wrong with JSON-lines components (ident, ord, line) against a manifest (ident, records): blank lines, lines that are no objects, counts, missing ones."""
    blank = F.trim("line") == ""
    broken = ~blank & F.get_json_object("line", "$").isNull() | ~blank & ~F.trim("line").startswith("{")
    sums = lines.groupBy(*ident).agg(F.count("*").alias("found"), F.count_if(blank).alias("blank"), F.count_if(broken).alias("no_object"))
    both = manifest.join(sums, ident, "left")
    codes = F.array(F.when(F.col("found").isNull(), "missing"), F.when(F.col("blank") > 0, "blank_line"), F.when(F.col("no_object") > 0, "no_object"), F.when(F.col("found") != F.col("records"), "count"))
    return both.select(*ident, F.explode(F.filter(codes, lambda c: c.isNotNull())).alias("code"))


def accepted_replies(blocks: DataFrame, replies: DataFrame, ident: str, most: float = 2.0, least: float = 0.5) -> DataFrame:
    """blocks with the text of a model's reply (JSON with `text` and `score`), if it may stand: it is whole, keeps the length within bounds and scores 3 or more."""
    parsed = F.from_json("reply", "text string, score int")
    rows = blocks.join(replies.select(ident, parsed.alias("p")), ident, "left")
    size = F.length("text")
    good = F.col("p.text").isNotNull() & (F.length("p.text").between(least * size, most * size)) & (F.coalesce("p.score", F.lit(0)) >= 3)
    return rows.withColumn("rewritten", F.coalesce(good, F.lit(False))).withColumn("text", F.when(F.col("rewritten"), F.col("p.text")).otherwise(F.col("text"))).drop("p")


def built(blocks: DataFrame, lines: DataFrame, items: DataFrame) -> DataFrame:
    """(page, block, source, n): the layout's blocks with their text layer's lines, or, where no line lies, with recognised items; none has neither."""
    given = layout.best_overlap(lines, blocks).groupBy("page", "block").agg(F.count("*").alias("lines"))
    seen = layout.contained_best(items, blocks).where("block is not null").groupBy("page", "block").agg(F.count("*").alias("items"))
    rows = blocks.select("page", F.col("id").alias("block")).join(given, ["page", "block"], "left").join(seen, ["page", "block"], "left")
    source = F.when(F.col("lines").isNotNull(), "text_layer").when(F.col("items").isNotNull(), "ocr").otherwise("none")
    return rows.select("page", "block", source.alias("source"), F.coalesce("lines", "items", F.lit(0)).alias("n"))


def reusable_artifacts(kept: DataFrame, manifest: DataFrame, ident: str) -> DataFrame:
    """Results all of whose artifacts (kind, content) still have the digest that the manifest says."""
    now = kept.select(ident, "kind", F.sha2("content", 256).alias("now"))
    rows = manifest.join(now, [ident, "kind"], "left")
    return rows.groupBy(ident).agg(F.bool_and(F.col("sha256").eqNullSafe(F.col("now"))).alias("whole")).where("whole").select(ident)


def page_items(pages: DataFrame, ident: list[str], json: str) -> DataFrame:
    """Items of a model's page JSON in page units: its declared space is normalized, thousandths or pixels, with the page's size in these."""
    item = "struct<type:string,text:string,bbox:array<double>>"
    parsed = F.from_json(json, f"struct<coordinate_space:string,width:double,height:double,items:array<{item}>>")
    rows = pages.select(*ident, "width", "height", parsed.alias("j"))
    rows = rows.select(*ident, "width", "height", F.col("j.coordinate_space").alias("space"), F.col("j.width").alias("w"), F.col("j.height").alias("h"), F.posexplode("j.items").alias("ord", "b"))

    def to(n: int, size: str, own: str) -> Column:
        v = F.try_element_at("b.bbox", F.lit(n))
        return F.when(F.col("space") == "normalized", v * F.col(size)).when(F.col("space") == "thousandths", v / 1000 * F.col(size)).otherwise(v * F.col(size) / F.col(own))

    return rows.select(*ident, "ord", F.col("b.type").alias("type"), F.coalesce("b.text", F.lit("")).alias("text"), to(1, "width", "w").alias("x0"), to(2, "height", "h").alias("y0"), to(3, "width", "w").alias("x1"), to(4, "height", "h").alias("y1"))
