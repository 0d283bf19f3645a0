"""Decisions, comparisons and small rewrites; their inputs are made from the order tables and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import review as ops
from .base import lines_of, read


def admissible_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as a page's objects: the order is the page."""
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", F.when(F.col("l_linenumber") == 3, "image").otherwise("text").alias("kind"), F.when(F.col("l_suppkey") % 2 == 0, 3).otherwise(0).alias("render_mode"), (F.col("l_partkey") % 9 > 0).alias("embedded"), (F.col("l_quantity") / 50).alias("share"))
    return ops.admissible_pages(rows, ["l_orderkey"])


def text_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    pages = read(spark, sf_dir, "orders").select("o_orderkey", (k % 13 == 0).alias("bad"), (k % 5).alias("covered"), (k % 7).alias("blocks"), (k % 3).alias("overlapping"), (k % 11).alias("lines"))
    return ops.text_source(pages).select("o_orderkey", "source")


def leaf_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without an order, as blocks without a child; every third customer's orders are left out."""
    orders = read(spark, sf_dir, "orders").where("o_custkey % 3 > 0").select(F.concat(F.lit("o"), "o_orderkey").alias("id"), F.concat(F.lit("c"), "o_custkey").alias("parent"))
    blocks = orders.unionByName(read(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.lit(None).cast("string").alias("parent")))
    return ops.leaves(blocks, "id", "parent").where("id like 'c%'").select("id")


def annotation_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit(" ["), "p_name", F.lit("]"))).otherwise(F.col("p_name"))
    return read(spark, sf_dir, "part").select("p_partkey", ops.annotation_kind(F.col("p_size") / 50, text, F.col("p_partkey") % 3 == 0).alias("kind"))


def merged_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.concat(F.lit("<b>"), "p_brand", F.lit("</b> <b>x</b><b>"), "p_name", F.lit(r"</b> $5$ \( a \) $x^2$"))
    return read(spark, sf_dir, "part").select("p_partkey", ops.unwrapped_math(ops.merged_tags(html, "b")).alias("html"))


def extracted_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("p. "), F.col("o_orderkey") % 2000)).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("Seite xiv / "), "o_orderkey")).otherwise(F.lit("p. 0012"))
    return read(spark, sf_dir, "orders").select("o_orderkey", ops.extracted_page(said, [r"p\. ([0-9]+)", r"Seite ([a-z]+)"]).alias("page"))


def contents_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, " ..... ").otherwise(" … "), F.when(F.col("p_partkey") % 5 == 0, "none").otherwise(F.col("p_size").cast("string")))
    rows = read(spark, sf_dir, "part").select("p_partkey", ops.contents_entry(line).alias("e")).where("e is not null")
    return rows.select("p_partkey", "e.title", "e.page")


def expired_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    tasks = read(spark, sf_dir, "orders").select("o_orderkey", F.when(k % 3 == 0, "running").when(k % 3 == 1, "queued").otherwise("done").alias("status"), (k % 500).cast("double").alias("started"), (k % 90 + 500).cast("double").alias("updated"), (k % 700).cast("double").alias("queued"))
    return ops.expired(tasks, F.lit(600.0), 400.0, 60.0, 300.0).groupBy("reason").agg(F.count("*").alias("n"))


def compared_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest price by customer and kind of order, the kinds side by side as backends."""
    rows = read(spark, sf_dir, "orders").select("o_custkey", F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("backend"), "o_totalprice")
    means = rows.groupBy("o_custkey", "backend").agg(F.max("o_totalprice").alias("v"))
    return ops.compared(means, ["o_custkey"], "backend", ["a", "b", "c"], "v")


def dominant_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc"), F.col("l_orderkey").alias("page"), F.when(F.col("l_linestatus") == "O", "footer").otherwise("header").alias("zone"), F.when(F.col("l_partkey") % 3 == 0, "left").otherwise("right").alias("alignment"), F.col("l_quantity").alias("score"))
    return ops.dominant_profile(rows, "doc", 25.0)


def package_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", ops.package_version(F.sha2("text", 256), F.col("lang"), F.lit("1")).alias("version"))


def page_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = F.element_at(F.array(F.lit("normalized"), F.lit("thousandths"), F.lit("pixels")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return read(spark, sf_dir, "part").select("p_partkey", F.round(ops.page_coordinates(F.col("p_size").cast("double"), space, F.lit(600.0)), 6).alias("x"))


def trailing_hyphens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second line gets a hyphen at its end, and every third goes on in small letters."""
    made = F.concat(F.when(F.col("line_idx") % 3 == 0, F.lit("low ")).otherwise(F.lit("Up ")), "line", F.when(F.col("line_idx") % 2 == 0, "x-").otherwise(""))
    rows = lines_of(read(spark, sf_dir, "documents")).withColumn("line", made)
    done = ops.without_trailing_hyphen(rows, Window.partitionBy("doc_id").orderBy("line_idx"))
    return done.groupBy("doc_id").agg(F.count_if(F.col("line").endswith("-")).alias("hyphens"), F.count("*").alias("lines"))


def benchmark_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted rates by category and backend over scored rows, with counts of the rest."""
    rows = read(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", (F.col("l_partkey") % 7 > 0).alias("scored"), F.when(F.col("l_suppkey") % 5 > 0, F.col("l_discount")).alias("cer"), F.col("l_quantity").alias("chars"), F.col("l_tax").alias("seconds"))
    s = F.col("scored")
    chars = F.sum(F.when(s, F.col("chars")))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("entries"), F.count_if(s).alias("scored"), F.count_if(~s).alias("unscored"), F.round(F.sum(F.when(s, F.coalesce("cer", F.lit(0.0)) * F.col("chars"))) / F.nullif(chars, F.lit(0.0)), 9).alias("cer"), F.round(F.avg("seconds"), 9).alias("seconds"))


QUERIES = {f.__name__: f for f in (admissible_pages, text_source, leaf_blocks, annotation_kinds, merged_markup, extracted_pages, contents_entries, expired_tasks, compared_reports, dominant_profiles, package_versions, page_coordinates, trailing_hyphens, benchmark_summary)}
ORACLES = {
    "admissible_pages": """WITH s AS (SELECT l_orderkey, count(*) FILTER (l_linenumber <> 3) AS texts, coalesce(bool_and(l_suppkey % 2 = 0) FILTER (l_linenumber <> 3), false) AS hidden, coalesce(bool_or(l_partkey % 9 = 0) FILTER (l_linenumber <> 3), false) AS foreign_, coalesce(max(l_quantity / 50) FILTER (l_linenumber = 3), 0) AS image FROM lineitem GROUP BY 1)
SELECT l_orderkey, texts > 0 AND NOT hidden AND NOT foreign_ AND image < 0.65 AS usable FROM s""",
    "text_source": "SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 OR o_orderkey % 13 = 0 OR o_orderkey % 5 < 0.25 * (o_orderkey % 7) OR o_orderkey % 3 > 0.2 * (o_orderkey % 11) THEN 'ocr' ELSE 'text_layer' END AS source FROM orders",
    "leaf_blocks": "SELECT 'c' || c_custkey AS id FROM customer WHERE c_custkey % 3 = 0 OR NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "annotation_kinds": "WITH t AS (SELECT p_partkey, p_size / 50 AS r, CASE WHEN p_partkey % 4 = 0 THEN ' [' || p_name || ']' ELSE p_name END AS t FROM part) SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'bracket' WHEN r < 0.85 AND p_partkey % 3 = 0 THEN 'double_line' WHEN r < 0.7 AND length(t) < 30 THEN 'note' WHEN r < 0.7 AND length(t) < 100 THEN 'comment' WHEN r < 0.85 THEN 'other' END AS kind FROM t",
    "merged_markup": "SELECT p_partkey, '<b>' || p_brand || ' x' || p_name || '</b> 5 a $x^2$' AS html FROM part",
    "extracted_pages": "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN CASE WHEN o_orderkey % 2000 > 0 THEN CAST(o_orderkey % 2000 AS VARCHAR) END WHEN 1 THEN 'xiv' END AS page FROM orders",
    "contents_entries": "SELECT p_partkey, p_name AS title, CAST(p_size AS VARCHAR) AS page FROM part WHERE p_partkey % 5 > 0",
    "expired_tasks": """WITH t AS (SELECT CASE WHEN o_orderkey % 3 = 0 AND 600 - o_orderkey % 500 >= 400 THEN 'attempt_timeout' WHEN o_orderkey % 3 = 0 AND 600 - (o_orderkey % 90 + 500) >= 60 THEN 'lease_expired' WHEN o_orderkey % 3 = 1 AND 600 - o_orderkey % 700 >= 300 THEN 'queue_timeout' END AS reason FROM orders) SELECT reason, count(*) AS n FROM t WHERE reason IS NOT NULL GROUP BY 1""",
    "compared_reports": """WITH m AS (SELECT o_custkey, ['a', 'b', 'c'][o_orderkey % 3 + 1] AS k, max(o_totalprice) AS v FROM orders GROUP BY ALL), w AS (SELECT o_custkey, max(v) FILTER (k = 'a') AS a, max(v) FILTER (k = 'b') AS b, max(v) FILTER (k = 'c') AS c FROM m GROUP BY 1)
SELECT w.*, (SELECT k FROM m WHERE m.o_custkey = w.o_custkey ORDER BY v DESC, k LIMIT 1) AS best FROM w""",
    "dominant_profiles": """WITH r AS (SELECT l_suppkey AS doc, l_orderkey AS page, CASE WHEN l_linestatus = 'O' THEN 'footer' ELSE 'header' END AS zone, CASE WHEN l_partkey % 3 = 0 THEN 'left' ELSE 'right' END AS alignment, l_quantity AS score FROM lineitem WHERE l_quantity >= 25),
b AS (SELECT *, row_number() OVER (PARTITION BY doc, page ORDER BY score DESC, zone DESC, alignment DESC) AS k FROM r), c AS (SELECT doc, zone, alignment, count(*) AS n, min(page) AS first FROM b WHERE k = 1 GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY n DESC, first) AS j FROM c) SELECT doc, zone, alignment, n FROM o WHERE j = 1""",
    "package_versions": "SELECT doc_id, substr(sha256(sha256(text) || '|' || lang || '|1'), 1, 12) AS version FROM documents",
    "page_coordinates": "SELECT p_partkey, round(CASE p_partkey % 3 WHEN 0 THEN p_size * 600.0::DOUBLE WHEN 1 THEN p_size / 1000.0::DOUBLE * 600 ELSE p_size END, 6) AS x FROM part",
    "trailing_hyphens": """WITH d AS (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents), l AS (SELECT doc_id, n, unnest(range(n)) AS i FROM d)
SELECT doc_id, count(*) FILTER (i % 2 = 0 AND NOT ((i + 1) % 3 = 0 AND i + 1 < n)) AS hyphens, count(*) AS lines FROM l GROUP BY doc_id""",
    "benchmark_summary": """SELECT l_returnflag, l_linestatus, count(*) AS entries, count(*) FILTER (l_partkey % 7 > 0) AS scored, count(*) FILTER (l_partkey % 7 = 0) AS unscored,
  round(sum(CASE WHEN l_suppkey % 5 > 0 THEN l_discount ELSE 0 END * l_quantity) FILTER (l_partkey % 7 > 0) / sum(l_quantity) FILTER (l_partkey % 7 > 0), 9) AS cer, round(avg(l_tax), 9) AS seconds FROM lineitem GROUP BY ALL""",
}
