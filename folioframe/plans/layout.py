"""Spatial queries. No table has boxes, so they are made: a supplier is a page, its parts are the
blocks and its line items the lines, with sides from their numeric columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..operators import layout as ops
from .base import read

HEIGHT = 600.0


def blocks_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    x0, y0 = F.col("p_size") * 8.0, (F.col("p_partkey") % 20) * 30.0
    kind = F.element_at(F.array(*(F.lit(k) for k in ("Text", "ListItem", "ListItem", "Caption", "Table", "Picture", "PageHeader", "Footnote", "PageFooter"))), (F.col("p_partkey") % 9 + 1).cast("int"))
    return read(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 20).alias("page"), F.col("p_partkey").alias("id"), kind.alias("kind"), x0.alias("x0"), y0.alias("y0"), (x0 + 120.0 + F.col("p_partkey") % 7 * 40.0).alias("x1"), (y0 + 20.0 + F.col("p_partkey") % 5 * 15.0).alias("y1"))


def lines_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    x0, y0 = F.col("l_quantity") * 9.0, (F.col("l_orderkey") % 60) * 10.0
    return read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("page"), ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 100000 + F.col("l_partkey")).alias("id"), x0.alias("x0"), y0.alias("y0"), (x0 + 40.0 + F.col("l_linenumber") * 10.0).alias("x1"), (y0 + 9.0).alias("y1"))


def geometry_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = geo.box()
    b = geo.Box(F.lit(100.0), F.lit(100.0), F.lit(300.0), F.lit(300.0))
    g, c = geo.grown(a, 0.1, 0.2), geo.clipped(a, b)
    values = {"area": geo.area(a), "share": geo.share_of(a, b), "iou": geo.iou(a, b), "gap": geo.gap(a, b), "centre": geo.centre_distance(a, b), "weighted": geo.centre_distance(a, b, 5.0, 1.0, True), "corner": geo.corner_distance(a, b), "grown": geo.area(g), "clipped": geo.area(c)}
    return blocks_of(spark, sf_dir).select("id", *(F.round(v, 6).alias(k) for k, v in values.items()))


def line_block_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.best_overlap(lines_of(spark, sf_dir), blocks_of(spark, sf_dir))


def nearest_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.nearest_block(lines_of(spark, sf_dir), blocks_of(spark, sf_dir)).select("page", "line", "block", F.round("distance", 6).alias("distance"))


def new_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of lines that no block overlaps, numbered in reading order."""
    lines, blocks = lines_of(spark, sf_dir), blocks_of(spark, sf_dir)
    order = ops.reading_order(lines)
    got = ops.best_overlap(lines, blocks).select("page", F.col("line").alias("id"), "block")
    return ops.leftovers(order.join(got, ["page", "id"], "left").select("page", F.col("place").alias("line"), "block"))


def char_smallest_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.smallest_holder(lines_of(spark, sf_dir), blocks_of(spark, sf_dir))


def ocr_item_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.contained_best(lines_of(spark, sf_dir), blocks_of(spark, sf_dir))


def iou_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = blocks_of(spark, sf_dir)
    shifted = blocks.select("page", "id", (F.col("x0") + 15.0).alias("x0"), (F.col("y0") + 3.0).alias("y0"), (F.col("x1") + 15.0).alias("x1"), (F.col("y1") + F.col("id") % 3 * 20.0).alias("y1")).where("id % 4 <> 0")
    return ops.matched(blocks, shifted).select("page", "id")


def enclosed_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = blocks_of(spark, sf_dir)
    return ops.outside(lines_of(spark, sf_dir), blocks.where("kind = 'Table'").drop("kind")).select("page", "id")


def least_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.least_gap(blocks_of(spark, sf_dir).drop("kind")).select("page", "id", F.round("gap", 6).alias("gap"))


def page_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.page_bounds(blocks_of(spark, sf_dir))


def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.reading_order(lines_of(spark, sf_dir))


def zone_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.zone_order(blocks_of(spark, sf_dir), F.col("kind")).select("page", "id", "place")


def list_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.list_groups(blocks_of(spark, sf_dir), HEIGHT)


def caption_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.caption_pairs(blocks_of(spark, sf_dir), HEIGHT)


def nearest_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector, as a point by its first two numbers, and the nearest anchor of its label (ids divisible by ten)."""
    points = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    anchors = points.where("id % 10 = 0").select("label", F.col("id").alias("anchor"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    return ops.nearest_anchor(points, anchors, "label").select(F.col("id").alias("vec_id"), "anchor")


def caption_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = blocks_of(spark, sf_dir).withColumn("ord", F.col("id"))
    found = ops.caption_groups(blocks, blocks.select("page", F.lit(HEIGHT).alias("height")).distinct(), 0.1)
    return found.select("page", "owner", "kind", F.array_join(F.col("members").cast("array<string>"), ",").alias("members"), *(f"group_{c}" for c in ("x0", "y0", "x1", "y1")))


QUERIES = {f.__name__: f for f in (caption_groups, geometry_measures, line_block_assign, nearest_block, new_blocks, char_smallest_box, ocr_item_block, iou_semi, enclosed_anti, least_gaps, page_bounds, reading_order, zone_order, list_groups, caption_pairs, nearest_reference)}

_BLOCKS = """blocks AS (
  SELECT p_partkey // 20 AS page, p_partkey AS id, ['Text', 'ListItem', 'ListItem', 'Caption', 'Table', 'Picture', 'PageHeader', 'Footnote', 'PageFooter'][p_partkey % 9 + 1] AS kind,
         p_size * 8.0::DOUBLE AS x0, (p_partkey % 20) * 30.0::DOUBLE AS y0, p_size * 8.0::DOUBLE + 120 + p_partkey % 7 * 40 AS x1, (p_partkey % 20) * 30.0::DOUBLE + 20 + p_partkey % 5 * 15 AS y1 FROM part
)"""
_LINES = """lines AS (
  SELECT l_suppkey AS page, (l_orderkey * 8 + l_linenumber) * 100000 + l_partkey AS id, l_quantity * 9 AS x0, (l_orderkey % 60) * 10.0::DOUBLE AS y0, l_quantity * 9 + 40 + l_linenumber * 10 AS x1, (l_orderkey % 60) * 10.0::DOUBLE + 9 AS y1 FROM lineitem
)"""
_AREA = "greatest(0, {0}.x1 - {0}.x0) * greatest(0, {0}.y1 - {0}.y0)"
_COMMON = "greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0))"
_PLACED = "placed AS (SELECT page, id, row_number() OVER (PARTITION BY page ORDER BY round_even(y0 / 1.25, 0) * 1.25, x0, id) AS place FROM lines)"
_BEST = f"""pairs AS (SELECT a.page, a.id AS line, b.id AS block, {_COMMON} AS area FROM lines a JOIN blocks b ON a.page = b.page),
best AS (SELECT *, row_number() OVER (PARTITION BY page, line ORDER BY area DESC, block) AS r FROM pairs WHERE area > 0)"""
_DIST = "sqrt(((a.x0 + a.x1) / 2 - (b.x0 + b.x1) / 2) ** 2 * 5 + ((a.y0 + a.y1) / 2 - (b.y0 + b.y1) / 2) ** 2)"
ORACLES = {
    "geometry_measures": f"""WITH {_BLOCKS}, m AS (SELECT a.*, b.x0 AS bx0, {_AREA.format("a")} AS area, {_COMMON} AS common, greatest(0, b.x0 - a.x1, a.x0 - b.x1) AS dx, greatest(0, b.y0 - a.y1, a.y0 - b.y1) AS dy,
  (a.x0 + a.x1) / 2 - 200 AS cx, (a.y0 + a.y1) / 2 - 200 AS cy FROM blocks a, (SELECT 100.0::DOUBLE AS x0, 100.0::DOUBLE AS y0, 300.0::DOUBLE AS x1, 300.0::DOUBLE AS y1) b)
SELECT id, round(area, 6) AS area, round(common / area, 6) AS share, round(common / (area + 40000 - common), 6) AS iou, round(sqrt(dx * dx + dy * dy), 6) AS gap, round(sqrt(cx * cx + cy * cy), 6) AS centre,
       round(abs(cx) * 5 + abs(cy), 6) AS weighted, round(sqrt((x0 - 100) ** 2 + (y0 - 100) ** 2), 6) AS corner, round(area * 1.2 * 1.4, 6) AS grown,
       round((least(greatest(x1, 100), 300) - least(greatest(x0, 100), 300)) * (least(greatest(y1, 100), 300) - least(greatest(y0, 100), 300)), 6) AS clipped FROM m""",
    "line_block_assign": f"WITH {_BLOCKS}, {_LINES}, {_BEST} SELECT page, line, block, area FROM best WHERE r = 1",
    "nearest_block": f"""WITH {_BLOCKS}, {_LINES}, d AS (SELECT a.page, a.id AS line, b.id AS block, {_DIST} AS distance FROM lines a LEFT JOIN blocks b ON a.page = b.page),
r AS (SELECT *, row_number() OVER (PARTITION BY page, line ORDER BY distance, block) AS r FROM d)
SELECT DISTINCT page, line, CASE WHEN distance < 20 THEN block END AS block, CASE WHEN distance < 20 THEN round(distance, 6) END AS distance FROM r WHERE r = 1""",
    "new_blocks": f"""WITH {_BLOCKS}, {_LINES}, {_BEST}, {_PLACED}, left_ AS (SELECT p.page, p.place FROM placed p LEFT JOIN best b ON b.page = p.page AND b.line = p.id AND b.r = 1 WHERE b.block IS NULL),
i AS (SELECT *, place - row_number() OVER (PARTITION BY page ORDER BY place) AS island FROM left_)
SELECT page, CAST(min(place) AS INTEGER) AS first, CAST(max(place) AS INTEGER) AS last, count(*) AS n FROM i GROUP BY page, island""",
    "char_smallest_box": f"""WITH {_BLOCKS}, {_LINES}, c AS (SELECT a.page, a.id AS point, b.id AS block, {_AREA.format("b")} AS size FROM lines a LEFT JOIN blocks b ON a.page = b.page AND (a.x0 + a.x1) / 2 BETWEEN b.x0 AND b.x1 AND (a.y0 + a.y1) / 2 BETWEEN b.y0 AND b.y1),
r AS (SELECT *, row_number() OVER (PARTITION BY page, point ORDER BY size, block) AS r FROM c) SELECT page, point, block FROM r WHERE r = 1""",
    "ocr_item_block": f"""WITH {_BLOCKS}, {_LINES}, s AS (SELECT a.page, a.id AS item, b.id AS block, {_COMMON} / ({_AREA.format("a")}) AS score FROM lines a LEFT JOIN blocks b ON a.page = b.page),
r AS (SELECT *, row_number() OVER (PARTITION BY page, item ORDER BY score DESC, block) AS r FROM s) SELECT page, item, CASE WHEN score >= 0.5 THEN block END AS block FROM r WHERE r = 1""",
    "iou_semi": f"""WITH {_BLOCKS}, p AS (SELECT page, x0 + 15 AS x0, y0 + 3 AS y0, x1 + 15 AS x1, y1 + id % 3 * 20 AS y1 FROM blocks WHERE id % 4 <> 0)
SELECT page, id FROM blocks a WHERE EXISTS (SELECT 1 FROM p b WHERE a.page = b.page AND {_COMMON} / ({_AREA.format("a")} + {_AREA.format("b")} - {_COMMON}) >= 0.5)""",
    "enclosed_anti": f"""WITH {_BLOCKS}, {_LINES} SELECT page, id FROM lines a WHERE NOT EXISTS (SELECT 1 FROM blocks b WHERE b.kind = 'Table' AND a.page = b.page AND {_COMMON} / ({_AREA.format("a")}) >= 0.95)""",
    "least_gaps": f"""WITH {_BLOCKS} SELECT a.page, a.id, round(min(sqrt(greatest(0, b.x0 - a.x1, a.x0 - b.x1) ** 2 + greatest(0, b.y0 - a.y1, a.y0 - b.y1) ** 2)), 6) AS gap FROM blocks a JOIN blocks b ON a.page = b.page AND a.id <> b.id GROUP BY a.page, a.id""",
    "page_bounds": f"WITH {_BLOCKS} SELECT page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS n FROM blocks GROUP BY page",
    "reading_order": f"WITH {_LINES}, {_PLACED} SELECT page, id, CAST(place AS INTEGER) AS place FROM placed",
    "zone_order": f"""WITH {_BLOCKS} SELECT page, id, CAST(row_number() OVER (PARTITION BY page ORDER BY CASE kind WHEN 'PageHeader' THEN 0 WHEN 'PageFooter' THEN 2 WHEN 'Footnote' THEN 3 ELSE 1 END, y0, x0, id) AS INTEGER) AS place FROM blocks""",
    "list_groups": f"""WITH {_BLOCKS}, n AS (SELECT *, CASE WHEN lag(kind) OVER w = 'ListItem' AND y0 - lag(y1) OVER w < 60 THEN 0 ELSE 1 END AS new FROM blocks WINDOW w AS (PARTITION BY page ORDER BY y0, id)),
r AS (SELECT *, sum(new) OVER (PARTITION BY page ORDER BY y0, id) AS run FROM n) SELECT page, arg_min(id, (y0, id)) AS first, count(*) AS n FROM r WHERE kind = 'ListItem' GROUP BY page, run""",
    # neighbours of the order as joins; a caption that the block before it has taken is gone
    "caption_groups": f"""WITH {_BLOCKS}, r AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY id) AS k FROM blocks),
n AS (SELECT a.page, a.k AS ka, b.k AS kb, a.id AS ia, b.id AS ib, a.kind IN ('Table', 'Figure', 'Picture') AS oa, b.kind IN ('Table', 'Figure', 'Picture') AS ob, a.kind IN ('Caption', 'Footnote') AS na, b.kind IN ('Caption', 'Footnote') AS nb,
  sqrt(pow(greatest(0, a.x0 - b.x1, b.x0 - a.x1), 2) + pow(greatest(0, a.y0 - b.y1, b.y0 - a.y1), 2)) < 60 AS near FROM r a JOIN r b ON a.page = b.page AND b.k = a.k + 1),
t AS (SELECT page, kb AS k FROM n WHERE oa AND nb AND near),
m AS (SELECT page, ka AS k, ib AS member, 1 AS side FROM n WHERE oa AND nb AND near UNION ALL SELECT n.page, kb, ia, -1 FROM n LEFT JOIN t ON t.page = n.page AND t.k = n.ka WHERE ob AND na AND near AND t.k IS NULL),
w AS (SELECT page, k, member, side FROM m UNION ALL SELECT DISTINCT m.page, m.k, r.id, 0 FROM m JOIN r ON r.page = m.page AND r.k = m.k)
SELECT w.page, o.id AS owner, o.kind || 'Group' AS kind, string_agg(CAST(w.member AS VARCHAR), ',' ORDER BY side) AS members, min(b.x0) AS group_x0, min(b.y0) AS group_y0, max(b.x1) AS group_x1, max(b.y1) AS group_y1
FROM w JOIN r o ON o.page = w.page AND o.k = w.k JOIN blocks b ON b.id = w.member GROUP BY ALL""",
    "caption_pairs": f"""WITH {_BLOCKS}, n AS (SELECT *, lag(kind) OVER w AS pk, lag(y1) OVER w AS py, lag(id) OVER w AS pi, lead(kind) OVER w AS nk, lead(y0) OVER w AS ny, lead(id) OVER w AS ni FROM blocks WINDOW w AS (PARTITION BY page ORDER BY y0, id)),
o AS (SELECT page, id AS caption, CASE WHEN pk IN ('Table', 'Picture', 'Figure') AND y0 - py < 30 THEN pi WHEN nk IN ('Table', 'Picture', 'Figure') AND ny - y1 < 30 THEN ni END AS owner FROM n WHERE kind = 'Caption') SELECT * FROM o WHERE owner IS NOT NULL""",
    "nearest_reference": """WITH p AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings),
r AS (SELECT p.vec_id, a.vec_id AS anchor, row_number() OVER (PARTITION BY p.vec_id ORDER BY (p.x - a.x) * (p.x - a.x) + (p.y - a.y) * (p.y - a.y), a.vec_id) AS r FROM p JOIN p a ON p.label = a.label AND a.vec_id % 10 = 0) SELECT vec_id, anchor FROM r WHERE r = 1""",
}
