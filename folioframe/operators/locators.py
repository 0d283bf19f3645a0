"""Classical locators: which scheme a book is cited by, which marks of it hold, and what range of the text each governs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .marginalia import chained

#: The forms of a page and section of Plato, and of a page, column and line of Aristotle.
STEPHANUS, BEKKER = r"^([0-9]{1,3})([a-e])([0-9]{1,2})?$", r"^([0-9]{3,4})\s?([ab])\s?([0-9]{1,2})?$"


def _parts(text: Column, pattern: str, letters: int) -> Column:
    """A locator's place as one number: page, letter, line."""
    part = lambda n: F.nullif(F.regexp_extract(text, pattern, n), F.lit(""))
    return (part(1).cast("long") * letters + F.ascii(part(2)) - F.ascii(F.lit("a"))) * 100 + F.coalesce(part(3).cast("long"), F.lit(0))


def parsed(text: Column) -> Column:
    """array of struct(scheme, place): how a mark reads in each scheme; forms of three digits and a or b fit both."""
    t = F.lower(F.trim(text))
    read = lambda scheme, pattern, letters: F.when(t.rlike(pattern), F.struct(F.lit(scheme).alias("scheme"), _parts(t, pattern, letters).alias("place")))
    return F.filter(F.array(read("stephanus", STEPHANUS, 5), read("bekker", BEKKER, 2)), lambda x: x.isNotNull())


def schemes(marks: DataFrame, doc: str, least: int = 3, share: float = 0.6) -> DataFrame:
    """(doc, scheme): the scheme that most of a book's marks read in, if it has `least` of them and `share` of all; of equals the first by name."""
    each = marks.select(doc, F.explode(parsed(F.col("text"))).alias("p")).groupBy(doc, "p.scheme").agg(F.count("*").alias("n"))
    best = each.groupBy(doc).agg(F.min_by(F.struct("scheme", "n"), F.struct(-F.col("n"), "scheme")).alias("b"))
    whole = marks.groupBy(doc).agg(F.count("*").alias("all"))
    return best.join(whole, doc).where((F.col("b.n") >= least) & (F.col("b.n") >= share * F.col("all"))).select(doc, "b.scheme")


def ranges(marks: DataFrame, doc: str) -> DataFrame:
    """Marks (ord, text) of a book's scheme with the half-open range [ord, until) that each governs, to the next one or the end (null).

    Two passes: the scheme is told from the whole book first, then the marks that hold: those on the longest chain of rising
    places. A mark beside it is a misreading, be it too high or too low, and governs nothing.
    """
    rows = marks.join(schemes(marks, doc), doc).withColumn("p", F.explode(parsed(F.col("text")))).where("p.scheme = scheme")
    told = rows.select(doc, "scheme", "ord", F.trim("text").alias("text"), F.col("p.place").alias("place"), F.lit(1).alias("weight"))
    kept = chained(told, [doc], ["ord"], "place", "weight").where("holds")
    return kept.select(doc, "scheme", "ord", "text", "place", F.lead("ord").over(Window.partitionBy(doc).orderBy("ord")).alias("until"))


def governed(blocks: DataFrame, found: DataFrame, doc: str) -> DataFrame:
    """blocks (ord) with the locator that governs them; those before the first one have none. One window over both, no range join."""
    starts = found.select(doc, "ord", F.lit(0).alias("kind"), F.col("text").alias("locator"))
    both = blocks.select(doc, "ord", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("locator")).unionByName(starts)
    last = F.last("locator", True).over(Window.partitionBy(doc).orderBy("ord", "kind").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("locator", last).where("kind = 1").drop("kind")


def blank_pages(pages: DataFrame, dark: float = 0.005) -> DataFrame:
    """Pages (blocks with text, share of dark points, pictures) to leave out: no text, no picture, and hardly a dark point."""
    return pages.where((F.col("texts") == 0) & (F.col("pictures") == 0) & (F.coalesce("dark", F.lit(0.0)) < dark))


def contents_kinds(lines: DataFrame, doc: str) -> DataFrame:
    """Lines of a table of contents with `kind` (heading, credit, entry, title) and `entry`, the number of the entry that they belong to.

    A heading names the table; an entry ends in a page; a title without one goes on in the next line; a line that opens with `by`, `von` or `par` names the author of the
    entry before.
    """
    t = F.trim("text")
    kind = F.when(t.rlike(r"(?i)^(table of )?contents$|^inhalt(sverzeichnis)?$|^sommaire$|^índice$"), "heading").when(t.rlike(r"(?i)^(by|von|par|por)\s+\p{Lu}"), "credit").when(t.rlike(r"\p{L}.*[\s.·…]([0-9]{1,4}|[ivxlcdm]{1,8})$"), "entry").otherwise("title")
    rows = lines.withColumn("kind", kind)
    along = Window.partitionBy(doc).orderBy("line")
    body = F.col("kind").isin("entry", "title")
    # an entry's lines end with the one that has the page
    ended = F.sum((F.col("kind") == "entry").cast("int")).over(along.rowsBetween(Window.unboundedPreceding, -1))
    upto = F.sum((F.col("kind") == "entry").cast("int")).over(along.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("entry", F.when(body, F.coalesce(ended, F.lit(0)) + 1).when((F.col("kind") == "credit") & (upto > 0), upto).cast("int"))
