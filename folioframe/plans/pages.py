"""Places on pages, on the made boxes of `layout`, the order tables and the conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import layout as spatial
from ..operators import pages as ops
from . import layout
from .base import read
from .documents import _BLOCKS, blocks_of

SIDES = ("x0", "y0", "x1", "y1")


def structure_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("long").alias("parent"), (-F.col("c_custkey")).alias("ord"))
    return ops.children(customers, read(spark, sf_dir, "nation").where("n_regionkey < 2").select(F.col("n_nationkey").cast("long").alias("id")))


def anchor_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = read(spark, sf_dir, "orders").select((F.col("o_orderkey") % 50).alias("anchor_start"), (F.col("o_orderkey") % 50 + F.col("o_custkey") % 5 - 1).alias("anchor_end"))
    return ops.held_pages(ranges).groupBy("page").agg(F.count("*").alias("ranges"))


def page_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("pb"), "turn").alias("id"))
    return ops.page_spans(marks, "conv_id", "turn").select("conv_id", "turn", "id", "until")


def _folios(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_orderkey")
    number = F.when(F.col("l_partkey") % 4 > 0, (k / 8).cast("long") + 10).otherwise((k / 8).cast("long") + 10 + F.col("l_partkey") % 5)
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("doc"), (k / 8).cast("long").alias("page"), number.alias("number"), F.when(F.col("l_linenumber") % 3 > 0, "footer").otherwise("header").alias("zone"), F.when(F.col("l_partkey") % 2 == 0, "left").otherwise("right").alias("alignment"),
        F.round(1 + F.col("l_quantity") / 25, 6).alias("score"), (k * 10 + F.col("l_linenumber")).alias("pos"),
    )


def deduplicated_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ops.deduplicated(_folios(spark, sf_dir), ["doc", "zone", "alignment", "number"])
    return found.select("doc", "zone", "alignment", "number", "page", "score")


def typed_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 5 == 0).alias("typed"))
    return ops.typed_or_guessed(rows, ["l_orderkey"]).groupBy("l_orderkey").agg(F.count("*").alias("candidates"), F.count_if("typed").alias("typed"))


def selected_folios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.select_folios(_folios(spark, sf_dir).groupBy("doc", "page", "number", "zone", "alignment").agg(F.max("score").alias("score")), "doc")


def span_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third block has no spans; the others stand in reverse."""
    blocks = blocks_of(spark, sf_dir).select("doc", "page", "ord", F.when(F.col("ord") % 3 > 0, (10000 - F.col("ord") * 5 % 997).cast("double")).alias("position"))
    return ops.repaired_order(blocks, ["doc", "page"]).select("doc", "page", "ord", "place")


def render_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    blocks = read(spark, sf_dir, "part").select("p_brand", F.concat(F.lit("b"), k).alias("id"), F.when(k % 7 > 0, (k % 4).cast("double")).alias("ord"), (k % 3 == 0).alias("restored"), (F.col("p_size") * 1.0).alias("top"))
    return ops.render_order(blocks, ["p_brand"]).select("id", "place")


def margin_line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("l_quantity") / 50, F.col("l_linenumber") / 10
    spans = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("id"), x.alias("x0"), x.alias("x1"), y.alias("y0"), y.alias("y1"), (F.col("l_suppkey") % 3).cast("string").alias("text"))
    notes = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page"), F.col("o_orderkey").alias("id"), F.when(F.col("o_custkey") % 2 == 0, "left").otherwise("right").alias("side"), F.concat(F.lit("|"), F.col("o_custkey") % 3, F.lit("| ")).alias("text"), (F.col("o_orderkey") % 8 / 10).alias("y"))
    return ops.margin_notes(spans, notes, near=0.15)


def merged_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = layout.lines_of(spark, sf_dir).withColumn("math", F.col("id") % 4 == 0)
    return ops.merged_math_lines(lines, reach=60.0)


def table_cell_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = layout.lines_of(spark, sf_dir).withColumn("text", F.col("id").cast("string"))
    found = ops.cell_lines(lines, layout.blocks_of(spark, sf_dir).drop("kind"))
    return found.select("page", "block", "lines", F.md5(F.col("text").cast("binary")).alias("md5"))


def best_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made blocks as recognised lines, and the line items that hold them."""
    blocks = layout.blocks_of(spark, sf_dir).drop("kind")
    items = blocks.withColumn("x1", F.col("x0") + 20.0).withColumn("y1", F.col("y0") + 8.0)
    return spatial.contained_best(items, layout.lines_of(spark, sf_dir), 0.3)


def label_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    n = (F.col("p_size") % 6).cast("int")
    lines = F.when(k % 11 == 0, F.array().cast("array<int>")).otherwise(F.array(n, n + 1))
    labels = read(spark, sf_dir, "part").select(F.floor(k / 4).alias("page"), k.alias("block"), lines.alias("lines"), F.when(k % 5 == 0, F.array(F.lit(0))).otherwise(F.array().cast("array<int>")).alias("images"))
    pages = labels.select("page").distinct().where("page % 10 > 0").select("page", F.lit(6).alias("line_count"), (F.col("page") % 2).cast("int").alias("image_count"))
    return ops.label_problems(labels, pages)


def merged_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderkey") % 10).alias("requests"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderstatus")).alias("previous"))
    return ops.merged_metadata(rows, "o_custkey", "o_orderkey", ["requests"], ["previous"])


def dollar_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations' customers as tables of three columns; the middle one has dollar signs only, but in odd nations."""
    k = F.col("c_custkey")
    texts = F.array("c_mktsegment", F.when((F.col("c_nationkey") % 2 == 1) & (k % 50 == 0), "x").when(k % 4 == 0, "").otherwise(" $ "), k.cast("string"))
    cells = read(spark, sf_dir, "customer").select("c_nationkey", k.alias("row"), F.posexplode(texts).alias("col", "text"))
    return ops.merged_dollars(cells, "c_nationkey").groupBy("c_nationkey").agg(F.max("col").alias("last"), F.count("*").alias("cells"), F.count_if(F.col("text").startswith("$")).alias("signs"))


def continued_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text blocks in columns of three, of which some lose their full stop, end short or open with an indent."""
    n = F.col("doc") + F.col("ord")
    text = F.when(n % 2 == 0, F.regexp_replace("text", r"[.!?]+$", "")).otherwise(F.col("text"))
    rows = blocks_of(spark, sf_dir).where("type in ('Text', 'Quote')").select("doc", "ord", text.alias("text"), F.floor(F.col("ord") / 3).alias("column"), F.lit(100.0).alias("width"), F.when(n % 5 == 0, 40.0).otherwise(95.0).alias("last_width"), F.when(n % 7 == 0, 0.1).otherwise(0.0).alias("first_indent"))
    return ops.continued(rows, "doc")


def zone_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = layout.blocks_of(spark, sf_dir)
    return blocks.select("id", ops.in_zone(F.col("y0"), F.col("y1"), F.lit(layout.HEIGHT), 0.1).alias("zone"))


def suppressed_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = layout.blocks_of(spark, sf_dir).withColumn("score", F.col("id") % 17 / 17).withColumn("kind", F.when(F.col("kind") == "Table", "Table").otherwise("Text"))
    return ops.suppressed(boxes, 0.1)


def checked_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three edits of a part's name: at its start, one that overlaps it, and one of a word that is not there."""
    parts = read(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("text"))
    edit = lambda s, e, original, new: F.struct(F.lit(s).alias("start"), F.lit(e).alias("end"), original.alias("original"), new.alias("replacement"))
    made = F.array(edit(0, 4, F.substring("text", 1, 4), F.lit("xxxx")), edit(2, 5, F.substring("text", 3, 3), F.lit("y")), edit(5, 8, F.lit("§§§"), F.lit("z")), edit(6, 7, F.substring("text", 7, 1), F.lit("long one")))
    edits = parts.select("p_partkey", F.explode(made).alias("e")).select("p_partkey", "e.*")
    return ops.checked_decisions(edits, parts, "p_partkey")


def label_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The confidence that a block's map has for its type; null where the map lacks it."""
    top = F.map_from_arrays(F.array(F.lit("Text"), F.lit("ListItem")), F.array(F.col("id") % 10 / 10, F.col("id") % 7 / 7))
    return layout.blocks_of(spark, sf_dir).select("id", F.round(F.try_element_at(top, F.col("kind")), 6).alias("confidence"))


QUERIES = {
    f.__name__: f
    for f in (
        structure_children, anchor_pages, page_boundaries, deduplicated_candidates, typed_candidates, selected_folios, span_order, render_places, margin_line_numbers, merged_math, table_cell_lines, best_lines, label_problems, merged_metadata, dollar_columns, continued_texts, zone_flags,
        suppressed_boxes, checked_edits, label_confidence,
    )
}

_FOLIOS = """fo AS (SELECT l_suppkey AS doc, l_orderkey // 8 AS page, l_orderkey // 8 + 10 + CASE WHEN l_partkey % 4 > 0 THEN 0 ELSE l_partkey % 5 END AS number, CASE WHEN l_linenumber % 3 > 0 THEN 'footer' ELSE 'header' END AS zone, CASE WHEN l_partkey % 2 = 0 THEN 'left' ELSE 'right' END AS alignment,
  round(1 + l_quantity / 25, 6) AS score, l_orderkey * 10 + l_linenumber AS pos FROM lineitem)"""
_O = "ORDER BY score DESC, number, zone, alignment"
_OFF = "CASE abs(number - (a.{0}.number + page - a.{0}.page)) WHEN 0 THEN 0.55 WHEN 1 THEN 0.15 WHEN 2 THEN 0 ELSE -0.25 END"
ORACLES = {
    "suppressed_boxes": f"""WITH RECURSIVE {layout._BLOCKS}, b AS (SELECT page, id, CASE WHEN kind = 'Table' THEN 'Table' ELSE 'Text' END AS kind, x0, y0, x1, y1, id % 17 / 17 AS score FROM blocks),
r AS (SELECT *, row_number() OVER (PARTITION BY page, kind ORDER BY score DESC, id) AS k, count(*) OVER (PARTITION BY page, kind) AS n FROM b),
l AS (SELECT a.page, a.kind, a.k, list(b.k) AS bs FROM r a JOIN r b ON a.page = b.page AND a.kind = b.kind AND a.k < b.k WHERE {layout._COMMON} > 0.1 * ({layout._AREA.format("a")} + {layout._AREA.format("b")} - {layout._COMMON}) GROUP BY ALL),
f(page, kind, k, n, gone) AS (SELECT DISTINCT page, kind, 0::BIGINT, n, []::BIGINT[] FROM r UNION ALL
  SELECT f.page, f.kind, f.k + 1, f.n, CASE WHEN list_contains(f.gone, f.k + 1) THEN f.gone ELSE list_concat(f.gone, coalesce(l.bs, [])) END FROM f LEFT JOIN l ON l.page = f.page AND l.kind = f.kind AND l.k = f.k + 1 WHERE f.k < f.n)
SELECT r.page, r.kind, r.id FROM r JOIN f ON f.page = r.page AND f.kind = r.kind AND f.k = f.n WHERE NOT list_contains(f.gone, r.k)""",
    "structure_children": "SELECT CAST(c_nationkey AS BIGINT) AS parent, c_custkey AS id, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey DESC) - 1 AS INTEGER) AS place FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 2)",
    "anchor_pages": "WITH r AS (SELECT unnest(range(o_orderkey % 50, o_orderkey % 50 + o_custkey % 5 - 1)) AS page FROM orders) SELECT page, count(*) AS ranges FROM r GROUP BY page",
    "page_boundaries": "SELECT conv_id, turn, 'pb' || turn AS id, 'pb' || lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS until FROM conversations",
    "deduplicated_candidates": f"WITH {_FOLIOS} SELECT doc, zone, alignment, number, page, score FROM (SELECT *, row_number() OVER (PARTITION BY doc, zone, alignment, number ORDER BY score DESC, pos) AS k FROM fo) WHERE k = 1",
    "typed_candidates": "WITH t AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_partkey % 5 = 0) AS t FROM lineitem GROUP BY 1) SELECT l_orderkey, CASE WHEN t > 0 THEN t ELSE n END AS candidates, t AS typed FROM t",
    "selected_folios": f"""WITH {_FOLIOS}, c AS (SELECT doc, page, number, zone, alignment, max(score) AS score FROM fo GROUP BY ALL), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc, page {_O}) AS k FROM c) WHERE k = 1),
g AS (SELECT doc, zone, alignment, count(*) AS n, min(page) AS first FROM b GROUP BY ALL), pr AS (SELECT doc, arg_min(struct_pack(z := zone, a := alignment), (-n, first)) AS p FROM g GROUP BY doc),
r AS (SELECT c.doc, page, number, zone, alignment, score + CASE WHEN zone = p.z THEN 0.25 ELSE 0 END + CASE WHEN alignment = p.a THEN 0.2 ELSE 0 END AS score FROM c JOIN pr USING (doc)),
an AS (SELECT doc, page, struct_pack(page := page, number := number) AS a FROM (SELECT *, row_number() OVER (PARTITION BY doc, page {_O}) AS k FROM r) WHERE k = 1 AND score >= 2.2),
pg AS (SELECT doc, page, last_value(a IGNORE NULLS) OVER (PARTITION BY doc ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, first_value(a IGNORE NULLS) OVER (PARTITION BY doc ORDER BY page ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM (SELECT DISTINCT doc, page FROM c) LEFT JOIN an USING (doc, page)),
s AS (SELECT r.doc, r.page, number, zone, alignment, round(score + CASE WHEN before IS NULL THEN 0 ELSE CASE abs(r.number - (before.number + r.page - before.page)) WHEN 0 THEN 0.55 WHEN 1 THEN 0.15 WHEN 2 THEN 0 ELSE -0.25 END END + CASE WHEN after IS NULL THEN 0 ELSE CASE abs(r.number - (after.number + r.page - after.page)) WHEN 0 THEN 0.55 WHEN 1 THEN 0.15 WHEN 2 THEN 0 ELSE -0.25 END END, 6) AS score FROM r JOIN pg ON pg.doc = r.doc AND pg.page = r.page),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc, page {_O}) AS k FROM s) WHERE k = 1 AND score >= 1.5), o AS (SELECT s.doc, s.page, max(s.score) AS second FROM s JOIN f ON f.doc = s.doc AND f.page = s.page WHERE s.number <> f.number GROUP BY ALL)
SELECT f.doc, f.page, f.number, f.score, coalesce(round(f.score - o.second, 6) < 0.2, false) AS ambiguous FROM f LEFT JOIN o ON o.doc = f.doc AND o.page = f.page""",
    "span_order": f"""{_BLOCKS}, p AS (SELECT doc, page, ord, row_number() OVER (PARTITION BY doc, page ORDER BY ord) AS n, CASE WHEN ord % 3 > 0 THEN 10000 - ord * 5 % 997 END AS p FROM blocks),
k AS (SELECT *, last_value(p IGNORE NULLS) OVER w AS bp, last_value(CASE WHEN p IS NOT NULL THEN n END IGNORE NULLS) OVER w AS bn, first_value(p IGNORE NULLS) OVER v AS ap, first_value(CASE WHEN p IS NOT NULL THEN n END IGNORE NULLS) OVER v AS an FROM p WINDOW w AS (PARTITION BY doc, page ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), v AS (PARTITION BY doc, page ORDER BY ord ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT doc, page, ord, CAST(row_number() OVER (PARTITION BY doc, page ORDER BY coalesce(bp + n - bn, ap - (an - n), 0), ord) AS INTEGER) AS place FROM k""",
    "render_places": "SELECT 'b' || p_partkey AS id, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN p_partkey % 7 > 0 THEN p_partkey % 4 ELSE 0 END, CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END, CASE WHEN p_partkey % 3 = 0 THEN p_size ELSE 0 END, 'b' || p_partkey) AS INTEGER) AS place FROM part",
    "margin_line_numbers": """WITH s AS (SELECT l_orderkey AS page, l_linenumber * 1000000 + l_partkey AS id, CASE WHEN l_quantity / 50 <= 0.08 THEN 'left' WHEN l_quantity / 50 >= 1 - 0.08 THEN 'right' END AS side, l_suppkey % 3 AS t, l_linenumber / 10 AS y FROM lineitem),
n AS (SELECT o_orderkey AS page, CASE WHEN o_custkey % 2 = 0 THEN 'left' ELSE 'right' END AS side, o_custkey % 3 AS t, o_orderkey AS note, o_orderkey % 8 / 10 AS y FROM orders)
SELECT s.page, s.id, s.side, min(n.note) AS note FROM s LEFT JOIN n ON n.page = s.page AND n.side = s.side AND n.t = s.t AND abs(s.y - n.y) <= 0.15 WHERE s.side IS NOT NULL AND s.y BETWEEN 0.05 AND 0.95 GROUP BY s.page, s.id, s.side, s.y""",
    "merged_math": f"""WITH {layout._LINES}, l AS (SELECT *, id % 4 = 0 AS math, floor(y0 / 10) AS row FROM lines), n AS (SELECT *, coalesce(NOT (least(y1, lag(y1) OVER w) - greatest(y0, lag(y0) OVER w) > 0.8 * 9 AND x0 - lag(x1) OVER w < 60 AND (math OR lag(math) OVER w)), true) AS new FROM l WINDOW w AS (PARTITION BY page, row ORDER BY x0, id)),
r AS (SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY page, row ORDER BY x0, id ROWS UNBOUNDED PRECEDING) AS run FROM n) SELECT page, arg_min(id, (x0, id)) AS first, count(*) AS n, min(x0) AS x0, max(x1) AS x1, bool_or(math) AS math FROM r GROUP BY page, row, run""",
    "table_cell_lines": f"WITH {layout._BLOCKS}, {layout._LINES}, {layout._BEST} SELECT b.page, b.block, CAST(count(*) AS INTEGER) AS lines, md5(string_agg(CAST(b.line AS VARCHAR), chr(10) ORDER BY l.y0, l.x0, b.line)) AS md5 FROM best b JOIN lines l ON l.id = b.line AND l.page = b.page WHERE r = 1 GROUP BY b.page, b.block",
    "best_lines": f"""WITH {layout._BLOCKS}, {layout._LINES}, i AS (SELECT page, id, x0, y0, x0 + 20 AS x1, y0 + 8 AS y1 FROM blocks), s AS (SELECT a.page, a.id AS item, b.id AS block, {layout._COMMON} / 160 AS score FROM i a LEFT JOIN lines b ON a.page = b.page),
r AS (SELECT *, row_number() OVER (PARTITION BY page, item ORDER BY score DESC NULLS LAST, block) AS k FROM s) SELECT page, item, CASE WHEN score >= 0.3 THEN block END AS block FROM r WHERE k = 1""",
    "label_problems": """WITH l AS (SELECT p_partkey // 4 AS page, p_partkey AS block, CASE WHEN p_partkey % 11 = 0 THEN [] ELSE [p_size % 6, p_size % 6 + 1] END AS ls, p_partkey % 5 = 0 AS img FROM part), p AS (SELECT DISTINCT page FROM l WHERE page % 10 > 0),
li AS (SELECT page, i, count(*) AS t FROM (SELECT page, unnest(ls) AS i FROM l) GROUP BY ALL), ln AS (SELECT p.page, r.i FROM p, (SELECT unnest(range(0, 6)) AS i) r),
f AS (SELECT page, CASE WHEN ln.i IS NULL THEN 'lines_not_there' WHEN li.t IS NULL THEN 'lines_unlabelled' WHEN li.t > 1 THEN 'lines_twice' END AS code FROM li FULL JOIN ln USING (page, i) WHERE page IN (SELECT page FROM p)),
g AS (SELECT page, count(*) FILTER (img) AS t FROM l GROUP BY page),
h AS (SELECT page, CASE WHEN page % 2 = 0 AND t > 0 THEN 'images_not_there' WHEN page % 2 = 1 AND t = 0 THEN 'images_unlabelled' WHEN page % 2 = 1 AND t > 1 THEN 'images_twice' END AS code FROM g WHERE page IN (SELECT page FROM p))
SELECT page, code, count(*) AS n FROM (SELECT * FROM f UNION ALL SELECT * FROM h) WHERE code IS NOT NULL GROUP BY ALL UNION ALL SELECT page, 'no_geometry', count(*) FROM l WHERE page NOT IN (SELECT page FROM p) GROUP BY 1 UNION ALL SELECT page, 'empty_block', count(*) FROM l WHERE len(ls) = 0 AND NOT img GROUP BY 1""",
    "merged_metadata": "SELECT o_custkey, CAST(sum(o_orderkey % 10) AS BIGINT) AS requests, string_agg(CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus ELSE '' END, '' ORDER BY o_orderkey) AS previous FROM orders GROUP BY 1",
    "dollar_columns": """WITH c AS (SELECT c_nationkey, count(*) AS n, count(*) FILTER (c_custkey % 4 > 0 AND NOT (c_nationkey % 2 = 1 AND c_custkey % 50 = 0)) AS d, count(*) FILTER (c_nationkey % 2 = 1 AND c_custkey % 50 = 0) AS x FROM customer GROUP BY 1)
SELECT c_nationkey, CASE WHEN x = 0 AND d > 0 THEN 1 ELSE 2 END AS last, CASE WHEN x = 0 AND d > 0 THEN 2 ELSE 3 END * n AS cells, CASE WHEN x = 0 AND d > 0 THEN d ELSE 0 END AS signs FROM c""",
    "continued_texts": f"""{_BLOCKS}, t AS (SELECT doc, ord, doc + ord AS n, CASE WHEN (doc + ord) % 2 = 0 THEN regexp_replace(text, '[.!?]+$', '') ELSE text END AS text, ord // 3 AS col FROM blocks WHERE type IN ('Text', 'Quote')), x AS (SELECT *, lead(ord) OVER w AS nx, lead(col) OVER w AS nc, lead(n) OVER w AS nn FROM t WINDOW w AS (PARTITION BY doc ORDER BY ord))
SELECT doc, ord, nx AS next_ord FROM x WHERE (n % 5 > 0 OR regexp_matches(rtrim(text), '[-‐¬]$')) AND NOT regexp_matches(rtrim(text), '[.!?]$') AND nc <> col AND nn % 7 > 0""",
    "zone_flags": f"WITH {layout._BLOCKS} SELECT id, CASE WHEN y1 <= 60 THEN 'header' WHEN y0 >= 540 THEN 'footer' ELSE 'body' END AS zone FROM blocks",
    "checked_edits": "SELECT p_partkey, s AS start, v AS verdict FROM part, (VALUES (0, 'applied'), (2, 'overlap'), (5, 'not_there')) t(s, v) UNION ALL SELECT p_partkey, 6, CASE WHEN length(p_name) >= 7 THEN 'overlap' ELSE 'not_there' END FROM part",
    "label_confidence": f"WITH {layout._BLOCKS} SELECT id, CASE kind WHEN 'Text' THEN round(id % 10 / 10, 6) WHEN 'ListItem' THEN round(id % 7 / 7, 6) END AS confidence FROM blocks",
}
