"""Books with marks at their margins: suppliers are books or pages, orders pages, and line items marks or lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import folio_segments, ladders, marginalia, reflow
from ..operators.trees import shared_table
from .base import read, tasks_for
from .numbering import pages_of


def _margin_blocks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as pages of a customer's book: two texts, and a mark for each line item, by its number a page column, lines by fives, and some misread or notes."""
    items = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("doc")), "l_orderkey")
    page, n, k = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")
    column = F.concat((F.floor(page / 70) % 900 + 100).cast("string"), F.when(page % 2 == 0, "a").otherwise("b"))
    text = F.when(n == 1, column).when(k % 23 == 0, "945b").when(k % 19 == 0, F.concat(F.lit("["), k % 500, F.lit("]"))).when(k % 17 == 0, "a note of the editor").when(k % 13 == 0, "iv").when(k % 11 == 0, (n * 5 + 1).cast("string")).otherwise(((n - 1) * 5).cast("string"))
    left = F.col("l_suppkey") % 5 > 0
    y = 80.0 + n * 60
    marks = items.select("doc", page.alias("page"), (n.cast("long") * 1_000_000_000 + k).alias("id"), F.lit("MarginalNote").alias("type"), text.alias("text"), F.when(left, 20.0).otherwise(560.0).alias("x0"), y.alias("y0"), F.when(left, 44.0).otherwise(584.0).alias("x1"), (y + 9).alias("y1"))
    orders = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("page"))
    prose = orders.select("doc", "page", F.posexplode(F.when(F.col("page") % 3 == 0, F.array(F.lit(60.0), F.lit(400.0))).otherwise(F.array(F.lit(120.0), F.lit(300.0)))).alias("part", "y0"))
    prose = prose.select("doc", "page", F.col("part").cast("long").alias("id"), F.lit("Text").alias("type"), F.lit("prose").alias("text"), F.lit(60.0).alias("x0"), "y0", F.lit(540.0).alias("x1"), (F.col("y0") + 150).alias("y1"))
    pages = orders.select("doc", "page", F.lit(600).alias("width"), F.lit(800).alias("height"), F.lit(None).cast("string").alias("printed"))
    return marks.unionByName(prose), pages


def _classified(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    blocks, pages = _margin_blocks(spark, sf_dir)
    return marginalia.classified(marginalia.candidates(blocks, marginalia.body_bands(blocks, pages)), blocks), blocks


def margin_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks, _ = _classified(spark, sf_dir)
    return marks.groupBy("doc", "role", "scheme").agg(F.count("*").alias("n"), F.sum("column").alias("columns"), F.sum("line").alias("lines"))


def locator_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks, blocks = _classified(spark, sf_dir)
    return marginalia.span_comments(marginalia.spans(marginalia.held_locators(marks), blocks)).select("doc", "page", "stream", "span", "comment")


def reflowed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as pages, orders as their blocks, line items as lines; every seventh part is a mark beside its line, some of them too far down for any."""
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    tasks = tasks_for(items)
    items = items.repartition(tasks, "l_orderkey").join(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("page")), "l_orderkey")
    line = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")) - 1
    rows = shared_table(items.withColumn("line", line).withColumn("cy", F.col("l_orderkey") * 300.0 + F.col("line") * 30))
    lines = rows.select("page", F.col("l_orderkey").alias("block"), "line", "cy")
    kind = F.when(F.col("block") % 5 == 0, "Table").when(F.col("block") % 11 == 0, "PageHeader").otherwise("Text")
    blocks = lines.groupBy("page", "block").agg(F.avg("cy").alias("cy")).select("page", F.col("block").alias("id"), F.col("block").alias("ord"), kind.alias("type"), "cy")
    seventh = rows.where("l_partkey % 7 = 0")
    shift = F.when(F.col("l_partkey") % 3 == 0, 1e9 + F.col("line")).otherwise(F.col("l_suppkey") % 9 - 4.0)
    margins = seventh.select("page", (F.col("l_orderkey") * 1000 + F.col("line")).alias("id"), (F.col("l_suppkey") % 2 * 600.0).alias("cx"), (F.col("cy") + shift).alias("cy"))
    done = reflow.reflowed(blocks, lines, margins, 12.0, tasks).repartition(tasks, "page")
    place = F.row_number().over(Window.partitionBy("page").orderBy("at"))
    return done.select("page", place.alias("place"), "kind", "id", "block", "first", "last")


def margin_ladders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as pages whose line items are numbers by fives at the margin, every sixth misread and every tenth lower than it should be."""
    n, k = F.col("l_linenumber"), F.col("l_partkey")
    value = n * 5 + F.when(k % 6 == 0, 5 * (1 + k % 4)).otherwise(0)
    y = n * 60.0 + F.when(k % 10 == 0, 37.0).otherwise(0.0)
    marks = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), (n.cast("long") * 1_000_000_000 + k).alias("id"), F.lit("left").alias("side"), value.cast("int").alias("value"), F.lit(20.0).alias("x0"), y.alias("y0"), F.lit(36.0).alias("x1"), (y + 8).alias("y1"))
    pages = marks.select("page").distinct()
    pitches = pages.select("page", F.lit(12.0).alias("pitch"), F.lit(9.0).alias("size"))
    return ladders.ladders(marks, pitches, pages.where("false").select("page", F.lit(0.0).alias("y0"), F.lit(0.0).alias("y1"))).select("page", "id", "value", "ladder")


def _observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the pages of their source's book, with numbers that are missing, misread or shifted, and signs of doubt."""
    i = F.col("page_idx")
    pages = pages_of(spark, sf_dir)
    return pages.withColumns({"score": F.when(F.col("number").isNull(), 0.2).otherwise(0.8), "boundary": i % 37 == 9, "anomaly": (i % 41 == 3) | (F.col("number").isNotNull() & (F.abs(F.col("number") - i) > 60))})


def settled_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = folio_segments.folio_segments(_observed(spark, sf_dir), "source")
    return found.withColumn("confidence", F.round("confidence", 9))


def query_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folio_segments.query_zones(settled_segments(spark, sf_dir), "source")


QUERIES = {f.__name__: f for f in (margin_roles, locator_spans, reflowed_pages, margin_ladders, settled_segments, query_zones)}
_ITEMS = "i AS (SELECT l.*, o_custkey AS doc FROM lineitem l JOIN orders ON o_orderkey = l_orderkey)"
ORACLES = {
    # marks of a page stand at heights of their own number; a line's column is the last page column above it on the page
    "margin_roles": f"""WITH {_ITEMS}, t AS (SELECT doc, l_orderkey AS page, CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey AS id, l_linenumber AS n, l_suppkey % 5 > 0 AS lft, CASE WHEN l_linenumber = 1 THEN (l_orderkey // 70 % 900 + 100) || CASE WHEN l_orderkey % 2 = 0 THEN 'a' ELSE 'b' END
    WHEN l_partkey % 23 = 0 THEN '945b' WHEN l_partkey % 19 = 0 THEN '[' || l_partkey % 500 || ']' WHEN l_partkey % 17 = 0 THEN 'a note of the editor' WHEN l_partkey % 13 = 0 THEN 'iv' WHEN l_partkey % 11 = 0 THEN CAST(l_linenumber * 5 + 1 AS VARCHAR) ELSE CAST((l_linenumber - 1) * 5 AS VARCHAR) END AS text FROM i),
c AS (SELECT *, CASE WHEN regexp_full_match(text, '\\d{{3}}[ab]') THEN CAST(left(text, 3) AS INTEGER) * 2 + CASE WHEN text[4] = 'b' THEN 1 ELSE 0 END END AS own, TRY_CAST(text AS INTEGER) AS v FROM t),
a AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY doc, page ORDER BY n, CASE WHEN lft THEN 0 ELSE 1 END, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above, list(CASE WHEN v % 5 = 0 AND v BETWEEN 5 AND 40 THEN v END) OVER (PARTITION BY doc, page) AS raw FROM c),
s AS (SELECT *, list_sort(list_filter(raw, lambda x: x IS NOT NULL)) AS rungs FROM a),
l AS (SELECT *, len(rungs) > 1 AND list_bool_and(list_transform(range(1, len(rungs)), lambda k: rungs[k + 1] - rungs[k] BETWEEN 5 AND 30)) AS ladder FROM s),
b AS (SELECT *, bool_or(ladder OR own IS NOT NULL) OVER (PARTITION BY doc) AS lined FROM l),
r AS (SELECT *, CASE WHEN own IS NOT NULL THEN 'bekker' WHEN starts_with(text, '[') THEN 'old_page' WHEN v IS NOT NULL AND above IS NOT NULL AND v % 5 = 0 AND v BETWEEN 5 AND 35 THEN 'bekker' WHEN v IS NOT NULL AND ((v % 5 = 0 AND (above IS NOT NULL OR (lined AND v >= 5))) OR ladder) THEN NULL WHEN v IS NOT NULL OR text = 'iv' THEN 'paragraph' END AS scheme FROM b)
SELECT doc, CASE WHEN scheme IS NOT NULL THEN 'locator' WHEN v IS NOT NULL THEN 'undetermined' ELSE 'text' END AS role, scheme, count(*) AS n, CAST(sum(CASE WHEN scheme = 'bekker' THEN coalesce(own, above) END) AS BIGINT) AS columns, CAST(sum(CASE WHEN scheme = 'bekker' AND own IS NULL THEN v END) AS BIGINT) AS lines FROM r GROUP BY ALL""",
    "reflowed_pages": """WITH i AS (SELECT l.*, o_custkey AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS line FROM lineitem l JOIN orders ON o_orderkey = l_orderkey),
l AS (SELECT *, l_orderkey AS block, l_orderkey * 300.0 + line * 30 AS cy, CASE WHEN l_orderkey % 5 = 0 THEN 'Table' WHEN l_orderkey % 11 = 0 THEN 'PageHeader' ELSE 'Text' END AS type FROM i),
b AS (SELECT page, block, type, avg(cy) AS cy FROM l GROUP BY ALL),
m AS (SELECT page, l_orderkey * 1000 + line AS id, l_suppkey % 2 * 600.0 AS cx, CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE block END AS near, type, line, CASE WHEN l_partkey % 3 = 0 THEN cy + 1e9 + line ELSE cy + l_suppkey % 9 - 4 END AS cy FROM l WHERE l_partkey % 7 = 0),
g AS (SELECT *, near IS NOT NULL AND type = 'Text' AS held FROM m),
c AS (SELECT DISTINCT page, near AS block, line FROM g WHERE held),
p AS (SELECT l.page, l.block, l.line, l.cy, sum(CASE WHEN c.line IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY l.page, l.block ORDER BY l.line) AS piece FROM l LEFT JOIN c ON c.page = l.page AND c.block = l.block AND c.line = l.line WHERE l.type = 'Text'),
s AS (SELECT page, block, min(line) AS first, max(line) AS last, avg(cy) AS cy, piece FROM p WHERE (page, block) IN (SELECT page, block FROM c) GROUP BY page, block, piece),
body AS (SELECT page, 'piece' AS kind, block || '/' || dense_rank() OVER (PARTITION BY page, block ORDER BY first) AS id, block, first, last, cy, 'Text' AS type, first AS at_line FROM s
  UNION ALL SELECT page, 'block', CAST(block AS VARCHAR), block, NULL, NULL, cy, type, 0 FROM b WHERE (page, block) NOT IN (SELECT page, block FROM c)),
near AS (SELECT g.page, g.id, min_by(struct_pack(block := y.block, cy := y.cy, at_line := y.at_line), (abs(y.cy - g.cy), y.block, y.at_line)) AS n FROM g LEFT JOIN body y ON y.page = g.page AND y.type <> 'PageHeader' WHERE NOT g.held GROUP BY ALL),
every AS (SELECT page, kind, id, block, first, last, block AS o, at_line AS ln, 2 AS k, 0.0 AS y, 0.0 AS x, 0 AS mark FROM body
  UNION ALL SELECT page, 'mark', CAST(id AS VARCHAR), near, NULL, NULL, near, line, 0, cy, cx, id FROM g WHERE held
  UNION ALL SELECT g.page, 'mark', CAST(g.id AS VARCHAR), n.block, NULL, NULL, coalesce(n.block, -1), coalesce(n.at_line, 0), CASE WHEN g.cy > n.cy THEN 3 ELSE 1 END, g.cy, g.cx, g.id FROM g JOIN near ON near.page = g.page AND near.id = g.id)
SELECT page, CAST(row_number() OVER (PARTITION BY page ORDER BY o, ln, k, y, x, mark) AS INTEGER) AS place, kind, id, block, CAST(first AS INTEGER) AS first, CAST(last AS INTEGER) AS last FROM every""",
}
