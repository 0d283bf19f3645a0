"""Layout models' raw boxes: parts as boxes of a page, as the spatial queries have them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import detections as ops
from . import layout

WIDTH, HEIGHT = 700, 650
LABELS = ("text", "text", "table", "image", "inline_formula", "header", "reference", "chart", "text")


def _detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes with labels, scores and places; every second one leans, its outline with it, and every third is seen twice."""
    k = F.col("id")
    label = F.element_at(F.array(*map(F.lit, LABELS)), (k % 9 + 1).cast("int"))
    boxes = layout.blocks_of(spark, sf_dir).select("page", "id", label.alias("label"), (k * 7 % 20 / 20).alias("score"), *((F.col(c) + d).alias(c) for c, d in (("x0", 0.4), ("y0", -0.3), ("x1", 0.2), ("y1", 0.1))), (k * 13 % 17).alias("hint"))
    again = boxes.where("id % 3 = 0").select("page", (k + 1_000_000_000_000).alias("id"), F.when(k % 2 == 0, F.col("label")).otherwise("text").alias("label"), (k * 11 % 20 / 20).alias("score"), *((F.col(c) + 2.0).alias(c) for c in ("x0", "y0", "x1", "y1")), F.lit(None).cast("long").alias("hint"))
    rows = boxes.unionByName(again)
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    lean = F.array(point(x0, y0), point(x1, y0 + (y1 - y0) / 5), point(x1, y1), point(x0, y1 - (y1 - y0) / 5))
    return rows.withColumn("outline", F.when(k % 2 == 0, lean))


def _pages(boxes: DataFrame) -> DataFrame:
    return boxes.select("page", F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height")).distinct()


def finished_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = _detections(spark, sf_dir)
    done = ops.finished(boxes, _pages(boxes), threshold=0.3, ratios=(1.1, 1.05), shape="rect")
    return done.select("page", "id", "label", "x0", "y0", "x1", "y1", F.col("order").cast("long").alias("ord"))


def finished_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of corners and place of each block's shape, by shape that fits."""
    boxes = _detections(spark, sf_dir)
    done = ops.finished(boxes, _pages(boxes), threshold=0.3, modes="large", shape="auto")
    return done.select("page", "id", F.size("outline").alias("corners"), F.round(F.get("outline", 0)["x"], 6).alias("x"), F.round(F.get("outline", 0)["y"], 6).alias("y"), F.col("order").cast("long").alias("ord"))


QUERIES = {f.__name__: f for f in (finished_boxes, finished_shapes)}

_LABEL_LIST = ", ".join(f"'{x}'" for x in LABELS)
_COMMON = "greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0))"
_PIXELS = "greatest(0, least(a.x1, b.x1) + 1 - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) + 1 - greatest(a.y0, b.y0))"
_SIZE = "(({0}.x1 - {0}.x0) * ({0}.y1 - {0}.y0))"
_PIXEL_SIZE = "(({0}.x1 - {0}.x0 + 1) * ({0}.y1 - {0}.y0 + 1))"
_UNORDERED = ", ".join(f"'{x}'" for x in ops.UNORDERED)
ORACLES = {
    "finished_boxes": f"""WITH RECURSIVE {layout._BLOCKS}, one AS (SELECT page, id, [{_LABEL_LIST}][id % 9 + 1] AS label, id * 7 % 20 / 20 AS score, x0 + 0.4 AS x0, y0 - 0.3 AS y0, x1 + 0.2 AS x1, y1 + 0.1 AS y1, id * 13 % 17 AS hint FROM blocks),
seen AS (SELECT * FROM one UNION ALL SELECT page, id + 1000000000000, CASE WHEN id % 2 = 0 THEN label ELSE 'text' END, id * 11 % 20 / 20, x0 + 2, y0 + 2, x1 + 2, y1 + 2, NULL FROM one WHERE id % 3 = 0),
likely AS (SELECT page, id, label, score, hint, round(x0) AS x0, round(y0) AS y0, round(x1) AS x1, round(y1) AS y1 FROM seen WHERE score > 0.3),
ranked AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY score DESC, id) AS k, count(*) OVER (PARTITION BY page) AS n FROM likely),
losers AS (SELECT a.page, a.k, list(b.k) AS bs FROM ranked a JOIN ranked b ON a.page = b.page AND a.k < b.k WHERE {_PIXELS} / ({_PIXEL_SIZE.format("a")} + {_PIXEL_SIZE.format("b")} - {_PIXELS}) >= CASE WHEN a.label = b.label THEN 0.6 ELSE 0.98 END GROUP BY a.page, a.k),
fold(page, k, n, gone) AS (SELECT DISTINCT page, 0::BIGINT, n, []::BIGINT[] FROM ranked UNION ALL SELECT f.page, f.k + 1, f.n, CASE WHEN list_contains(f.gone, f.k + 1) THEN f.gone ELSE list_concat(f.gone, coalesce(l.bs, [])) END FROM fold f LEFT JOIN losers l ON l.page = f.page AND l.k = f.k + 1 WHERE f.k < f.n),
kept AS (SELECT r.* FROM ranked r JOIN fold f ON f.page = r.page AND f.k = f.n WHERE NOT list_contains(f.gone, r.k)),
filled AS (SELECT *, label = 'image' AND (least(x1, {WIDTH}) - greatest(x0, 0)) * (least(y1, {HEIGHT}) - greatest(y0, 0)) > 0.82 * {WIDTH} * {HEIGHT} AS fills FROM kept),
chosen AS (SELECT * FROM filled QUALIFY NOT fills OR count(*) FILTER (NOT fills) OVER (PARTITION BY page) = 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY hint NULLS LAST, score DESC, id) AS place FROM chosen),
grown AS (SELECT page, id, label, place, floor(greatest(0, (x0 + x1) / 2 - (x1 - x0) * 1.1 / 2)) AS x0, floor(greatest(0, (y0 + y1) / 2 - (y1 - y0) * 1.05 / 2)) AS y0, floor(least({WIDTH}, (x0 + x1) / 2 + (x1 - x0) * 1.1 / 2)) AS x1, floor(least({HEIGHT}, (y0 + y1) / 2 + (y1 - y0) * 1.05 / 2)) AS y1 FROM placed),
cut AS (SELECT * FROM grown WHERE x1 > x0 AND y1 > y0 AND label <> 'reference'),
met AS (SELECT a.page, a.place AS turn, b.place AS nxt, a.label AS la, b.label AS lb, {_SIZE.format("a")} >= {_SIZE.format("b")} AS larger, {_COMMON} / least({_SIZE.format("a")}, {_SIZE.format("b")}) AS part FROM cut a JOIN cut b ON a.page = b.page AND a.place < b.place),
told AS (SELECT *, (la = 'inline_formula' OR lb = 'inline_formula') AND part > 0.5 AS formula, la <> lb AND (la IN ('image', 'seal', 'chart', 'table') OR lb IN ('image', 'seal', 'chart', 'table')) AND ((la <> 'table' AND lb <> 'table') OR (la IN ('image', 'seal', 'chart', 'table') AND lb IN ('image', 'seal', 'chart', 'table'))) AS may FROM met),
events AS (SELECT page, turn, nxt, CASE WHEN formula THEN la = 'inline_formula' ELSE NOT larger END AS fa, CASE WHEN formula THEN lb = 'inline_formula' ELSE larger END AS fb FROM told WHERE formula OR (part > 0.7 AND NOT may)
  UNION ALL SELECT page, place, NULL, true, false FROM cut WHERE x1 - x0 < 6 OR y1 - y0 < 6),
steps AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY turn, nxt NULLS FIRST) AS k, count(*) OVER (PARTITION BY page) AS n FROM events),
falls(page, k, n, gone) AS (SELECT DISTINCT page, 0::BIGINT, n, []::BIGINT[] FROM steps UNION ALL
  SELECT f.page, f.k + 1, f.n, CASE WHEN list_contains(f.gone, s.turn) OR (s.nxt IS NOT NULL AND list_contains(f.gone, s.nxt)) THEN f.gone ELSE list_concat(f.gone, list_concat(CASE WHEN s.fa THEN [s.turn] ELSE [] END, CASE WHEN s.fb THEN [s.nxt] ELSE [] END)) END FROM falls f JOIN steps s ON s.page = f.page AND s.k = f.k + 1),
stays AS (SELECT c.* FROM cut c LEFT JOIN falls f ON f.page = c.page AND f.k = f.n WHERE f.gone IS NULL OR NOT list_contains(f.gone, c.place))
SELECT page, id, label, x0, y0, x1, y1, CASE WHEN label NOT IN ({_UNORDERED}) THEN count(*) FILTER (label NOT IN ({_UNORDERED})) OVER (PARTITION BY page ORDER BY place) END AS ord FROM stays""",
}
