"""Headers, folios, signatures and headings. The tables have none, so they are made from their columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import furniture as ops
from .base import read, tasks_for


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = (F.col("o_orderkey") % 300 + 1).cast("string")
    text = F.when(F.col("o_orderkey") % 3 == 0, number).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("Page "), number)).otherwise(F.concat(F.lit("March "), number, F.lit(", 1864 of the year")))
    zone = F.when(F.col("o_orderkey") % 2 == 0, "footer").otherwise("header")
    distance = F.col("o_custkey") % 10 / 10
    rows = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", number.alias("number"), text.alias("text"), zone.alias("zone"), distance.alias("distance"))
    return rows.withColumn("score", F.round(ops.candidate_score(F.col("zone"), F.col("o_orderkey") % 5 == 0, F.col("distance"), F.col("text"), F.col("number")), 6))


def folio_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir).select("o_orderkey", "score", ops.looks_like_year(F.col("number"), F.col("text")).alias("dated"))


def folio_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' numbers in headers that are dates, and in some that only look like them."""
    number = (F.col("o_orderkey") % 28 + 1).cast("string")
    forms = [("May ", ", 1864"), ("the ", "rd of March"), ("", "th Sept. 1901"), ("Dec. 3, ", ""), ("3 July, ", ""), ("", "年"), ("第3期 ", ""), ("18 ", "年代"), ("page ", " of May"), ("Mayor ", " and 1864")]
    k = (F.col("o_orderkey") % len(forms) + 1).cast("int")
    pick = lambda i: F.element_at(F.array(*(F.lit(f[i]) for f in forms)), k)
    return read(spark, sf_dir, "orders").select("o_orderkey", ops.in_a_date(number, F.concat(pick(0), number, pick(1))).alias("dated"))


def folio_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.best_two(_candidates(spark, sf_dir), ["o_custkey"])


def _marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.col("p_size"), F.repeat(F.lit("*"), (F.col("p_partkey") % 3).cast("int")), F.lit(" "), "p_brand", F.when(F.col("p_partkey") % 2 == 0, F.lit(", Bd. IV")).otherwise(F.lit("")))
    rows = read(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 50).alias("doc"), F.col("p_partkey").alias("page"), ops.signature(said).alias("s"), (F.col("p_partkey") % 10 / 20).alias("x"), (F.col("p_size") % 3 / 50).alias("y"))
    return rows.select("doc", "page", "s.*", "x", "y")


def sheet_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marks(spark, sf_dir).select("page", "number", "mark", "title", "volume")


def repeated_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.repeated_signatures(_marks(spark, sf_dir), "doc").select("doc", "page")


def line_number_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when((F.col("l_partkey") % 3 > 0) | (F.col("l_suppkey") % 4 == 0), F.col("l_linenumber").cast("string")).otherwise(F.lit("word"))
    spans = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("page"), F.col("l_orderkey").alias("line"), F.col("l_quantity").alias("x0"), text.alias("text"))
    return ops.line_number_columns(spans, ["page"], "line")


def margin_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("l_quantity") / 50
    spans = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", x.alias("x0"), x.alias("x1"), (F.col("l_suppkey") % 100 / 100).alias("y0"), (F.col("l_suppkey") % 100 / 100).alias("y1"), F.when(F.col("l_partkey") % 2 == 0, "17").otherwise("x").alias("text"))
    return ops.margin_numbers(spans).groupBy("side").agg(F.count("*").alias("n"))


def heading_levels_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = read(spark, sf_dir, "part").select(F.col("p_brand").alias("doc"), "p_partkey", F.col("p_size").cast("double").alias("height"))
    return ops.size_levels(heads, "doc", "height").groupBy("doc", "level").agg(F.count("*").alias("n"), F.min("height").alias("low"), F.max("height").alias("high"))


def anchor_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    pages = read(spark, sf_dir, "orders").select("o_orderkey", F.when(k % 5 > 0, 1).alias("normalized"), F.when(k % 7 > 0, 1).alias("raw"), (k % 3 == 0).alias("both_sides"), (k % 2 == 0).alias("any_side"), (k % 11 == 0).alias("boundary"), (k % 13 == 0).alias("anomaly"))
    return ops.anchor_classes(pages).select("o_orderkey", F.round("score", 4).alias("score"), "class")


def split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tables of two columns; every line but those with odd suppliers has two lines of text in both."""
    lines = F.when(F.col("l_suppkey") % 3 > 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("c")))
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    rows = items.repartition(tasks_for(items), "l_orderkey").groupBy("l_orderkey", F.col("l_linenumber").alias("row")).agg(F.max("l_suppkey").alias("l_suppkey"))
    cells = rows.select("l_orderkey", "row", F.explode(F.array(F.lit(0), F.lit(1))).alias("col"), lines.alias("lines"))
    return ops.split_combined_rows(cells, "l_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("cells"), F.max("row").alias("last"))


def running_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .documents import blocks_of

    return ops.running_furniture(blocks_of(spark, sf_dir), ["doc", "page"], zone=0.2, most_chars=60).select("doc", "page", "ord")


def code_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    x0 = F.col("l_linenumber") * 10.0
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("line_idx"), x0.alias("x0"), (x0 + 25.0).alias("x1"), F.lit("let x").alias("text"))
    return ops.code_lines(lines, ["l_orderkey"]).select("l_orderkey", F.length("code").alias("size"))


QUERIES = {f.__name__: f for f in (folio_candidates, folio_dates, folio_choice, sheet_signatures, repeated_signatures, line_number_pages, margin_numbers, heading_levels_by_size, anchor_classes, split_rows, running_blocks, code_blocks)}

_CANDIDATES = r"""WITH c AS (
  SELECT o_custkey, o_orderkey, CAST(o_orderkey % 300 + 1 AS VARCHAR) AS number, CASE o_orderkey % 3 WHEN 0 THEN CAST(o_orderkey % 300 + 1 AS VARCHAR) WHEN 1 THEN 'Page ' || (o_orderkey % 300 + 1) ELSE 'March ' || (o_orderkey % 300 + 1) || ', 1864 of the year' END AS text FROM orders
), s AS (
  SELECT *, round(CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0.85 END + CASE WHEN o_orderkey % 5 = 0 THEN 0.65 ELSE 0.2 END + (1 - o_custkey % 10 / 10) * 0.35 + CASE WHEN length(text) <= 8 THEN 0.45 WHEN length(text) <= 20 THEN 0.2 ELSE -0.35 END
    + CASE WHEN text = number THEN 0.45 ELSE 0.2 END + CASE WHEN o_orderkey % 3 = 2 THEN -0.3 ELSE 0.35 END + CASE WHEN o_orderkey % 3 = 1 THEN 0.2 ELSE 0 END + CASE WHEN ends_with(text, number) AND length(text) > length(number) THEN 0.55 ELSE 0 END, 6) AS score FROM c
)"""
_MARKS = """WITH m AS (SELECT p_partkey // 50 AS doc, p_partkey AS page, p_size AS number, CAST(p_partkey % 3 AS INTEGER) AS mark, p_brand AS title, CASE WHEN p_partkey % 2 = 0 THEN '4' END AS volume, p_partkey % 10 / 20 AS x, p_size % 3 / 50 AS y FROM part)"""
_MADE = """WITH parts AS (SELECT conv_id AS doc, CAST(turn AS INTEGER) AS page, list_filter(string_split(regexp_replace(text, '\\. ', '.' || chr(1), 'g'), chr(1)), lambda x: length(x) > 0) AS p FROM conversations),
b AS (SELECT doc, page, unnest(p) AS t, generate_subscripts(p, 1) - 1 AS i FROM parts), c AS (SELECT doc, page, CAST(page * 1000 + i AS INTEGER) AS ord, length(t) > 60 AS body, i * 10 AS y0, i * 10 + (doc * 7 + page * 5 + i * 3) % 4 AS y1 FROM b)"""
ORACLES = {
    "folio_dates": "SELECT o_orderkey, o_orderkey % 10 IN (0, 2, 3, 4, 5, 6, 7) AS dated FROM orders",
    "running_blocks": f"""{_MADE}, w AS (SELECT *, min(CASE WHEN body THEN y0 END) OVER p AS top, max(CASE WHEN body THEN y1 END) OVER p AS bottom, min(y0) OVER p AS low, max(y1) OVER p AS high FROM c WINDOW p AS (PARTITION BY doc, page))
SELECT doc, page, ord FROM w WHERE NOT body AND (y1 <= low + 0.2 * (high - low) OR y0 >= high - 0.2 * (high - low)) AND (y1 <= coalesce(top, high) OR y0 >= coalesce(bottom, low))""",
    "folio_candidates": f"{_CANDIDATES} SELECT o_orderkey, CAST(score AS DOUBLE) AS score, o_orderkey % 3 = 2 AS dated FROM s",
    "folio_choice": f"""{_CANDIDATES}, r AS (SELECT *, row_number() OVER w AS place, lead(score) OVER w AS second FROM s WINDOW w AS (PARTITION BY o_custkey ORDER BY score DESC, number))
SELECT o_custkey, number, CAST(score AS DOUBLE) AS score, coalesce(CAST(score AS DOUBLE) - CAST(second AS DOUBLE) < 0.2, false) AS ambiguous FROM r WHERE place = 1 AND score >= 1.5""",
    "sheet_signatures": f"{_MARKS} SELECT page, number, mark, title, volume FROM m",
    "repeated_signatures": f"{_MARKS} SELECT doc, page FROM m a WHERE EXISTS (SELECT 1 FROM m b WHERE a.doc = b.doc AND a.title = b.title AND a.volume IS NOT DISTINCT FROM b.volume AND a.page <> b.page AND abs(a.x - b.x) < 0.08 AND abs(a.y - b.y) < 0.025)",
    "line_number_pages": """WITH f AS (SELECT l_suppkey AS page, l_orderkey, arg_min(t, (l_quantity, t)) AS first FROM (SELECT *, CASE WHEN l_partkey % 3 > 0 OR l_suppkey % 4 = 0 THEN CAST(l_linenumber AS VARCHAR) ELSE 'word' END AS t FROM lineitem) GROUP BY ALL),
s AS (SELECT page, count(*) AS lines, count(*) FILTER (first <> 'word') AS numbered FROM f GROUP BY page) SELECT * FROM s WHERE numbered > 0.6 * lines""",
    "margin_numbers": "WITH s AS (SELECT CASE WHEN l_quantity / 50 <= 0.08 THEN 'left' WHEN l_quantity / 50 >= 1 - 0.08 THEN 'right' END AS side FROM lineitem WHERE l_partkey % 2 = 0 AND l_suppkey % 100 / 100 BETWEEN 0.06 AND 0.94) SELECT side, count(*) AS n FROM s WHERE side IS NOT NULL GROUP BY side",
    "anchor_classes": """WITH p AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 > 0 THEN 0.96 WHEN o_orderkey % 7 > 0 THEN 0.18 ELSE 0 END AS lex, CASE WHEN o_orderkey % 3 = 0 THEN 1 WHEN o_orderkey % 2 = 0 THEN 0.55 ELSE 0.2 END AS loc, CASE WHEN o_orderkey % 3 = 0 THEN 1 WHEN o_orderkey % 2 = 0 THEN 0.5 ELSE 0.2 END AS ofs, CASE WHEN o_orderkey % 13 = 0 THEN 0.85 ELSE 0.05 END AS odd FROM orders),
s AS (SELECT k, round(CAST(greatest(0, least(1, lex * 0.3 + loc * 0.35 + ofs * 0.25 - odd * 0.3)) AS DOUBLE), 4) AS score FROM p) SELECT k AS o_orderkey, score, CASE WHEN score >= 0.82 AND k % 11 <> 0 THEN 'A' WHEN score >= 0.62 THEN 'B' WHEN score >= 0.35 THEN 'C' ELSE 'D' END AS class FROM s""",
    "split_rows": """WITH r AS (SELECT l_orderkey, l_linenumber AS row, CASE WHEN max(l_suppkey) % 3 > 0 THEN 2 ELSE 1 END AS k FROM lineitem GROUP BY ALL), s AS (SELECT *, avg(k - 1) OVER (PARTITION BY l_orderkey) AS share FROM r),
p AS (SELECT *, CASE WHEN share >= 0.5 THEN k ELSE 1 END AS parts FROM s), m AS (SELECT l_orderkey, row, parts, coalesce(sum(parts - 1) OVER (PARTITION BY l_orderkey ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shift FROM p)
SELECT l_orderkey, CAST(2 * sum(parts) AS BIGINT) AS cells, CAST(max(row + shift + parts - 1) AS INTEGER) AS last FROM m GROUP BY l_orderkey""",
    "code_blocks": "WITH l AS (SELECT l_orderkey, l_linenumber * 10.0::DOUBLE AS x0, count(*) OVER (PARTITION BY l_orderkey) AS n, min(l_linenumber * 10.0::DOUBLE) OVER (PARTITION BY l_orderkey) AS lft FROM lineitem) SELECT l_orderkey, CAST(sum(5 + floor((x0 - lft) / 5)) + count(*) - 1 AS INTEGER) AS size FROM l GROUP BY l_orderkey",
}
