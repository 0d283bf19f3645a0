"""Recognition outputs, Markdown regions and packages, made from the tables' texts and numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import list_repair as lists
from ..operators import markdown as md
from ..operators import rich_markdown as rich
from ..sources import layout_json as lj
from .base import read


def layout_json_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part as a page with one item, in one of two dialects, with a box or a polygon."""
    a = F.concat(F.lit('{"blocks":[{"type":"heading","text":"'), "p_brand", F.lit('","bbox":['), "p_size", F.lit(",1,"), F.col("p_size") + 9, F.lit(',5],"confidence":0.5}]}'))
    b = F.concat(F.lit('{"items":[{"label":"formula","content":"'), "p_brand", F.lit('","polygon":[['), "p_size", F.lit(",1],["), F.col("p_size") + 9, F.lit(',5]],"score":0.25}]}'))
    pages = read(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, a).when(F.col("p_partkey") % 3 == 1, b).otherwise(F.lit("{")).alias("j"))
    return lj.layout_blocks(pages, ["p_partkey"], "j")


def tesseract_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's items as the words of a TSV, three lines to a page."""
    row = F.concat_ws("\t", F.lit("5"), F.lit("1"), F.lit("1"), F.lit("1"), (F.col("l_linenumber") % 3).cast("string"), F.col("l_linenumber").cast("string"), F.col("l_linenumber").cast("string"), F.lit("10"), F.lit("5"), F.lit("4"), F.lit("90"), F.col("l_returnflag"))
    files = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list(row)), "\n").alias("t"))
    found = lj.tesseract_lines(files, "l_orderkey", "t")
    return found.select("l_orderkey", "line", F.length("text").alias("size"), "x0", "x1", "confidence")


def aggregate_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of two stacked blocks and, on two of three of them, one that sums them up."""
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("page"), "p_name")
    piece = lambda i, y0, y1, text: F.struct(F.lit(i).alias("id"), F.lit(0.0).alias("x0"), F.lit(y0).alias("y0"), F.lit(9.0).alias("x1"), F.lit(y1).alias("y1"), text.alias("text"))
    three = piece(3, 0.0, 20.0, F.when(F.col("page") % 3 > 0, F.concat(F.lit("a b "), "p_name")).otherwise(F.lit("quite other words stand here")))
    rows = part.select("page", F.explode(F.array(piece(1, 0.0, 9.0, F.lit("a b")), piece(2, 10.0, 20.0, F.col("p_name")), three)).alias("b")).select("page", "b.*")
    return lj.drop_aggregates(rows, ["page"]).select("page", "id")


def package_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components whose digest differs from the manifest after one row of every seventh package has changed."""
    rows = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.col("role").alias("kind"), F.col("turn").alias("ord"), F.concat(F.lit("b"), "turn").alias("id"), F.lit("Text").alias("type"), "text")
    changed = rows.withColumn("text", F.when((F.col("doc") % 7 == 0) & (F.col("ord") == 0), "x").otherwise(F.col("text")))
    return lj.broken_components(lj.components(rows), lj.components(changed))


def merged_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), (F.col("turn") % 2).alias("batch"), F.col("turn").alias("pos"))
    return lj.merged_batches(rows, "doc")


def markdown_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank runs shrink and lines join outside of fences only."""
    text = F.concat(F.lit("one\ntwo\n\n\n\nthree  \n```\na\n\n\n\nb\n```\n| x |\n| y |\n$$\nq\nr\n$$\n- item\n"), F.col("role"))
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", text.alias("t"))
    return rows.select("conv_id", "turn", F.length(md.cleaned("t")).alias("cleaned"), F.length(md.flowing("t")).alias("flowing"))


def page_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as Markdown: lines of it by kind."""
    pages = read(spark, sf_dir, "pages").select("page_id", md.html_markdown("html").alias("m"))
    count = lambda p: F.regexp_count("m", F.lit(p))
    return pages.select("page_id", count("(?m)^# ").alias("h1"), count("(?m)^- ").alias("items"), count("(?m)^> ").alias("quotes"), F.length("m").alias("size"))


def rich_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole web pages as Markdown with tables, nested lists, code and escapes; beside it how many lines and table rows it has."""
    pages = read(spark, sf_dir, "pages").select("page_id", rich.rich_markdown("html").alias("m"))
    return pages.select("page_id", F.md5(F.col("m").cast("binary")).alias("md5"), F.size(F.split("m", "\n")).alias("lines"), F.regexp_count("m", F.lit(r"(?m)^\|")).alias("rows"))


def repaired_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with its lines as notes: numbered, linked, indented in turn, a page's anchor before each fifth one."""
    line = lambda x, i: F.when(i % 5 == 4, F.concat(F.lit("{"), i, F.lit("}\n   "), x)).when(i % 5 == 1, F.concat(F.lit("- ["), i % 1000 + 1, F.lit(".](#page-1-0) "), x)).when(i % 5 == 2, F.concat(F.lit("["), i % 1000 + 1, F.lit("](#page--1-0). "), x)).when(i % 5 == 3, F.concat(F.lit("   - "), i % 1000 + 1, F.lit(") "), x)).otherwise(x)
    docs = read(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(F.split("text", "\n"), line), "\n").alias("given"))
    done = docs.withColumn("text", lists.repaired_lists("given"))
    return done.select("doc_id", F.md5(F.col("text").cast("binary")).alias("md5"), (F.length("given") - F.length("text")).alias("shorter"))


def dotted_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name among dots and stray marks."""
    text = F.concat(F.lit("a . . · … b ... "), "p_name", F.lit(" ## -- x\n> y #"))
    return read(spark, sf_dir, "part").select("p_partkey", md.without_marks(md.without_dots(text), 3, True).alias("plain"))


def repaired_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), (F.col("o_orderkey") % 50).alias("pdf_page"), F.col("o_orderkey").alias("printed"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey") + 1).alias("proposed"))
    return md.repaired(rows, "doc").select("doc", "printed", "label")


def otsl_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table with a wide and a tall cell; every third one is ragged."""
    text = F.concat(F.lit("<fcel>"), "p_brand", F.lit("<lcel><nl><fcel>a<fcel>b<nl><ucel>"), F.when(F.col("p_partkey") % 3 == 0, "").otherwise("<ecel>"), F.lit("<nl>"))
    html = md.otsl_tables(text)
    return read(spark, sf_dir, "part").select("p_partkey", F.length(html).alias("size"), html.isNull().alias("review"))


QUERIES = {f.__name__: f for f in (layout_json_blocks, tesseract_lines, aggregate_blocks, package_manifest, merged_batches, markdown_prose, page_markdown, rich_pages, repaired_lists, dotted_noise, repaired_labels, otsl_tables)}
ORACLES = {
    "layout_json_blocks": """SELECT p_partkey, 0 AS ord, CASE p_partkey % 3 WHEN 0 THEN 'SectionHeader' ELSE 'Equation' END AS type, p_brand AS text, CAST(p_size AS DOUBLE) AS x0, 1.0::DOUBLE AS y0, CAST(p_size + 9 AS DOUBLE) AS x1, 5.0::DOUBLE AS y1, CASE p_partkey % 3 WHEN 0 THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END AS confidence FROM part WHERE p_partkey % 3 < 2""",
    "tesseract_lines": "SELECT l_orderkey, CAST(l_linenumber % 3 AS INTEGER) AS line, CAST(2 * count(*) - 1 AS INTEGER) AS size, CAST(min(l_linenumber) AS DOUBLE) AS x0, CAST(max(l_linenumber) + 5 AS DOUBLE) AS x1, 90.0::DOUBLE AS confidence FROM lineitem GROUP BY l_orderkey, l_linenumber % 3",
    "aggregate_blocks": "SELECT p_partkey AS page, id FROM part, (VALUES (1), (2), (3)) t(id) WHERE id < 3 OR p_partkey % 3 = 0",
    "package_manifest": "SELECT conv_id AS doc, role AS kind FROM conversations WHERE conv_id % 7 = 0 AND turn = 0 AND text <> 'x'",
    "merged_batches": "SELECT conv_id AS doc, turn % 2 AS batch, turn AS pos, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn % 2, turn) - 1 AS INTEGER) AS ord FROM conversations",
    "dotted_noise": "SELECT p_partkey, 'a  b ... ' || p_name || ' x' || chr(10) || '> y #' AS plain FROM part",
    "repaired_labels": "SELECT o_custkey AS doc, o_orderkey AS printed, CASE WHEN count(*) OVER (PARTITION BY o_custkey, o_orderkey % 50) = 1 AND o_orderkey % 2 = 0 THEN o_orderkey + 1 ELSE o_orderkey END AS label FROM orders",
    "otsl_tables": "SELECT p_partkey, CASE WHEN p_partkey % 3 > 0 THEN CAST(length('<table><tr><td colspan=\"2\">' || p_brand || '</td></tr><tr><td rowspan=\"2\">a</td><td>b</td></tr><tr><td></td></tr></table>') AS INTEGER) END AS size, p_partkey % 3 = 0 AS review FROM part",
}
