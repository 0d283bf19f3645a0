"""Trees and spatial leftovers, on the nation tree, the made boxes of `layout` and the texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import trees as ops
from . import layout
from .base import read


def contained_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and nations under the first region; nations with odd keys over ten are removed."""
    nations = read(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.col("n_nationkey").cast("long").alias("ord"), F.lit("nation").alias("type"), ((F.col("n_nationkey") > 10) & (F.col("n_nationkey") % 2 == 1)).alias("removed"))
    customers = read(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.concat(F.lit("n"), "c_nationkey").alias("parent"), F.col("c_custkey").alias("ord"), F.lower("c_mktsegment").alias("type"), F.lit(False).alias("removed"))
    return ops.contained(nations.unionByName(customers), "r0", ["nation", "building"])


def line_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ops.coverage(layout.lines_of(spark, sf_dir), layout.blocks_of(spark, sf_dir).drop("kind"))
    return found.select("page", F.round("covered", 6).alias("covered"), "overlapping", "lines")


def grown_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ops.grown_to_gap(layout.blocks_of(spark, sf_dir).drop("kind"))
    return found.select("page", "id", *(F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1")))


def margin_note_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = layout.blocks_of(spark, sf_dir).where("kind in ('Footnote', 'Caption')").drop("kind")
    return ops.note_lines(notes, layout.lines_of(spark, sf_dir))


def legacy_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as notes: the legacy form of each has lost its end, or belongs to another marker."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    legacy = turns.select("conv_id", "turn", F.when(F.col("turn") % 3 == 0, F.col("turn") + 1).otherwise(F.col("turn")).alias("marker"), F.substring("text", 1, 130).alias("body"))
    resolved = turns.select("conv_id", F.col("turn").alias("marker"), F.col("text").alias("body"))
    return ops.same_notes(legacy, resolved, "conv_id").select("conv_id", "turn")


def unassigned_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines, as a multiset of (part, quantity), less those of even orders."""
    lines = read(spark, sf_dir, "lineitem")
    return ops.missing(lines.select("l_partkey", "l_linenumber"), lines.where("l_orderkey % 2 = 0").select("l_partkey", "l_linenumber")).groupBy("l_partkey").agg(F.count("*").alias("n"))


def first_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ops.first_seen(read(spark, sf_dir, "conversations"), "conv_id", "turn", "role")
    return found.select("conv_id", F.array_join("values", ",").alias("roles"))


def contents_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part").select("p_brand", F.col("p_partkey").alias("line_idx"), F.col("p_name").alias("title"), F.when(F.col("p_partkey") % 3 > 0, F.col("p_size")).alias("page"))
    return ops.contents_groups(rows, "p_brand").groupBy("p_brand").agg(F.max("entry").alias("entries"), F.count("*").alias("lines"))


QUERIES = {f.__name__: f for f in (contained_blocks, line_coverage, grown_blocks, margin_note_lines, legacy_notes, unassigned_lines, first_roles, contents_groups)}
_B, _L = layout._BLOCKS, layout._LINES
ORACLES = {
    "contained_blocks": """WITH RECURSIVE t AS (SELECT 'n' || n_nationkey AS id, 'r' || n_regionkey AS parent, CAST(n_nationkey AS BIGINT) AS ord, 'nation' AS type FROM nation WHERE NOT (n_nationkey > 10 AND n_nationkey % 2 = 1) UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_custkey, lower(c_mktsegment) FROM customer),
b(id, type, path) AS (SELECT id, type, lpad(CAST(ord AS VARCHAR), 9, '0') FROM t WHERE parent = 'r0' UNION ALL SELECT t.id, t.type, b.path || '/' || lpad(CAST(t.ord AS VARCHAR), 9, '0') FROM t JOIN b ON t.parent = b.id) SELECT * FROM b WHERE type IN ('nation', 'building')""",
    "line_coverage": f"""WITH {_B}, {_L}, p AS (SELECT a.page, a.id, {layout._AREA.format("a")} AS size, CASE WHEN b.id IS NULL THEN 0 ELSE {layout._COMMON} END AS common FROM lines a LEFT JOIN blocks b ON a.page = b.page), m AS (SELECT page, id, max(common) AS best, count(*) FILTER (common > 0) AS met, any_value(size) AS size FROM p GROUP BY ALL)
SELECT page, round(sum(best) / sum(size), 6) AS covered, count(*) FILTER (met > 1) AS overlapping, count(*) AS lines FROM m GROUP BY page""",
    "grown_blocks": f"""WITH {_B}, g AS (SELECT a.id, min(sqrt(greatest(0, b.x0 - a.x1, a.x0 - b.x1) ** 2 + greatest(0, b.y0 - a.y1, a.y0 - b.y1) ** 2)) AS gap FROM blocks a JOIN blocks b ON a.page = b.page AND a.id <> b.id GROUP BY a.id),
s AS (SELECT blocks.*, least(coalesce(gap, 0) / 2, (x1 - x0) * 0.05) AS sx, least(coalesce(gap, 0) / 2, (y1 - y0) * 0.05) AS sy FROM blocks LEFT JOIN g USING (id)) SELECT page, id, round(x0 - sx, 6) AS x0, round(y0 - sy, 6) AS y0, round(x1 + sx, 6) AS x1, round(y1 + sy, 6) AS y1 FROM s""",
    "margin_note_lines": f"""WITH {_B}, {_L}, p AS (SELECT b.page, b.id, l.id AS line, (l.y0 + l.y1) / 2 AS ly, abs((l.y0 + l.y1) / 2 - (b.y0 + b.y1) / 2) AS dy FROM blocks b JOIN lines l ON l.page = b.page WHERE b.kind IN ('Footnote', 'Caption')),
r AS (SELECT *, row_number() OVER (PARTITION BY page, id ORDER BY dy, ly, line) AS k FROM p WHERE dy <= 12) SELECT page, id, line FROM r WHERE k = 1""",
    "legacy_notes": "SELECT a.conv_id, a.turn FROM conversations a WHERE EXISTS (SELECT 1 FROM conversations b WHERE b.conv_id = a.conv_id AND b.turn = CASE WHEN a.turn % 3 = 0 THEN a.turn + 1 ELSE a.turn END AND (starts_with(substr(a.text, 1, 120), substr(b.text, 1, 120)) OR starts_with(substr(b.text, 1, 120), substr(a.text, 1, 120))))",
    "unassigned_lines": "SELECT l_partkey, count(*) AS n FROM (SELECT l_partkey, l_linenumber FROM lineitem EXCEPT ALL SELECT l_partkey, l_linenumber FROM lineitem WHERE l_orderkey % 2 = 0) GROUP BY 1",
    "first_roles": "WITH f AS (SELECT conv_id, role, min(turn) AS t FROM conversations GROUP BY ALL) SELECT conv_id, string_agg(role, ',' ORDER BY t) AS roles FROM f GROUP BY conv_id",
    "contents_groups": "WITH l AS (SELECT p_brand, p_partkey, CASE WHEN lag(p_partkey) OVER w IS NULL OR lag(p_partkey) OVER w % 3 > 0 THEN 1 ELSE 0 END AS s FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey)) SELECT p_brand, CAST(sum(s) AS BIGINT) AS entries, count(*) AS lines FROM l GROUP BY p_brand",
}
