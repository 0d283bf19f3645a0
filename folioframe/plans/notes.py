"""Notes, furniture and page labels, on texts made from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import notes as ops
from .base import read
from .documents import _BLOCKS, blocks_of


def note_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block of three notes in one of three notations; a number out of order belongs to the note before it."""
    k = F.col("p_partkey") % 3
    one, two, far, three = (F.when(k == 0, f"<sup>{n}</sup>").when(k == 1, "①②③④⑤⑥⑦⑧⑨"[n - 1]).otherwise("⁰¹²³⁴⁵⁶⁷⁸⁹"[n]) for n in (1, 2, 7, 3))
    text = F.concat(one, F.lit(" "), "p_brand", F.lit(" "), two, F.lit(". "), "p_type", far, F.lit(" x"), three, F.lit(" end"))
    rows = read(spark, sf_dir, "part").select("p_partkey", F.posexplode(ops.note_entries(text)).alias("n", "e"))
    return rows.select("p_partkey", "n", "e.marker", "e.body")


def _calls(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    blocks = blocks_of(spark, sf_dir)
    k = F.col("doc") + F.col("ord")
    marker = F.when(k % 5 == 0, "a").when(k % 5 == 1, "123").when(k % 5 == 2, "12").otherwise((F.col("ord") % 3).cast("string"))
    calls = blocks.where("type = 'Text'").select("doc", "page", "ord", marker.alias("marker"), F.when(k % 2 == 0, F.concat("text", F.lit(" vgl. Bd. 3 "))).otherwise(F.regexp_replace("text", r"[^a-z ]", "")).alias("before"))
    return calls, blocks.where("type = 'Footnote'").select("doc", "page", "ord", (F.col("ord") % 3).cast("string").alias("marker"))


def call_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ops.decided_calls(*_calls(spark, sf_dir), "doc")
    return found.select("doc", "page", "ord", "note", "decision")


def note_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = blocks_of(spark, sf_dir).withColumn("marker", F.when(F.col("ord") % 4 > 0, (F.col("ord") % 3).cast("string")))
    return ops.resolved(rows, "doc")


def imprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    text = F.when(k % 2 == 0, F.concat(F.lit(" Druck  und Verlag "), "p_brand")).otherwise(F.concat(F.lit("Gedruckt von "), "p_brand"))
    page = F.concat(text, F.when(k % 3 > 0, " Alle Rechte vorbehalten").otherwise(""), F.when(k % 5 > 0, " © 1999").otherwise(""))
    return read(spark, sf_dir, "part").select("p_partkey", ops.is_imprint(text, page).alias("imprint"))


def recorded_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as the pages of a customer; their priorities, with a page number before or after, recur as running heads."""
    # a printed page number has five digits at most, as the signature reads it
    number = (F.col("o_orderkey") % 100_000).cast("string")
    text = F.when(F.col("o_orderkey") % 2 == 0, F.concat(number, F.lit("  "), "o_orderpriority", F.lit(" Head"))).otherwise(F.concat("o_orderpriority", F.lit(" HEAD xiv")))
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("page"), F.col("o_orderstatus").alias("kind"), text.alias("text"))
    return ops.recorded(rows, "doc")


def page_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 9
    n = (F.col("o_custkey") % 900 + 1).cast("string")
    line = (
        F.when(k == 0, n).when(k == 1, F.concat(F.lit("["), n, F.lit("]"))).when(k == 2, F.concat(F.lit("1 Introduction "), n)).when(k == 3, F.concat(F.lit("(xiv) Preface"))).when(k == 4, F.concat(F.lit("Part ["), n, F.lit("]")))
        .when(k == 5, F.concat(F.lit("("), n, F.lit("]"))).when(k == 6, F.lit("no label at all")).when(k == 7, F.concat(F.lit("Part ("), n, F.lit("]"))).otherwise(F.concat(n, F.lit(" Notes")))
    )
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.explode(ops.page_labels(line)).alias("c"))
    return rows.select("o_orderkey", "c.label", "c.priority")


def list_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a list: items of several kinds, and lines that go on."""
    k = F.col("p_partkey") % 6
    text = F.when(k == 0, F.concat(F.lit("• "), "p_name")).when(k == 1, F.concat(F.lit("12. "), "p_name")).when(k == 2, F.concat(F.lit("b) "), "p_name")).when(k == 3, F.lower("p_name")).when(k == 4, F.concat(F.lit("– "), "p_name")).otherwise(F.concat(F.lit("The "), "p_name"))
    before = F.when(F.col("p_partkey") % 4 == 0, "ends here.").otherwise("goes on")
    rows = read(spark, sf_dir, "part").select("p_partkey", text.alias("t"), before.alias("b"))
    return rows.select("p_partkey", ops.is_bullet(F.col("t")).alias("bullet"), ops.wrapped(F.col("t"), F.col("b")).alias("wrapped"), ops.item_number(F.col("t")).alias("number"))


QUERIES = {f.__name__: f for f in (note_entries, call_decisions, note_resolution, imprints, recorded_annotations, page_labels, list_lines)}
ORACLES = {
    "note_entries": """WITH m AS (SELECT p_partkey, p_brand, p_type, CASE p_partkey % 3 WHEN 0 THEN ['1', '2', '3', '<sup>7</sup>'] WHEN 1 THEN ['①', '②', '③', '⑦'] ELSE ['¹', '²', '³', '⁷'] END AS k FROM part)
SELECT p_partkey, 0 AS n, k[1] AS marker, p_brand AS body FROM m UNION ALL SELECT p_partkey, 1, k[2], p_type || k[4] || ' x' FROM m UNION ALL SELECT p_partkey, 2, k[3], 'end' FROM m""",
    "call_decisions": f"""{_BLOCKS}, f AS (SELECT doc, page, CAST(ord % 3 AS VARCHAR) AS marker, min(ord) AS note FROM blocks WHERE type = 'Footnote' GROUP BY ALL),
c AS (SELECT doc, page, ord, doc + ord AS k, CASE (doc + ord) % 5 WHEN 0 THEN 'a' WHEN 1 THEN '123' WHEN 2 THEN '12' ELSE CAST(ord % 3 AS VARCHAR) END AS marker FROM blocks WHERE type = 'Text')
SELECT c.doc, c.page, c.ord, f.note, CASE WHEN f.note IS NOT NULL THEN 'reference' WHEN k % 2 = 0 AND c.marker IN ('123', '12') THEN 'unwrap' WHEN c.marker IN ('a', '123') THEN 'unwrap' ELSE 'keep' END AS decision FROM c LEFT JOIN f ON f.doc = c.doc AND f.page = c.page AND f.marker = c.marker""",
    "note_resolution": f"""{_BLOCKS}, b AS (SELECT doc, page, type, ord % 3 AS marker FROM blocks WHERE ord % 4 > 0 AND type IN ('Footnote', 'Text')), g AS (SELECT doc, page, marker, count(*) FILTER (type = 'Footnote') AS n, count(*) FILTER (type = 'Text') AS c FROM b GROUP BY ALL)
SELECT doc, CAST(sum(n) AS BIGINT) AS notes, CAST(sum(c) AS BIGINT) AS calls, CAST(sum(CASE WHEN n > 0 THEN c ELSE 0 END) AS BIGINT) AS resolved, CAST(sum(CASE WHEN c = 0 THEN n ELSE 0 END) AS BIGINT) AS uncalled FROM g GROUP BY doc""",
    "imprints": "SELECT p_partkey, p_partkey % 2 = 0 AND p_partkey % 3 > 0 AND p_partkey % 5 > 0 AS imprint FROM part",
    "recorded_annotations": "SELECT o_custkey AS doc, o_orderstatus AS kind, lower(o_orderpriority) || ' head' AS signature, count(DISTINCT o_orderkey) AS pages FROM (SELECT *, regexp_replace(o_orderpriority, '^[0-9]{1,5}\\s+', '') AS p FROM orders) GROUP BY ALL HAVING count(DISTINCT o_orderkey) >= 3",
    "page_labels": """WITH l AS (SELECT o_orderkey, o_orderkey % 9 AS k, CAST(o_custkey % 900 + 1 AS VARCHAR) AS n FROM orders)
SELECT o_orderkey, n AS label, CASE k WHEN 0 THEN 5 WHEN 1 THEN 5 WHEN 2 THEN 2 WHEN 4 THEN 4 ELSE 1 END AS priority FROM l WHERE k IN (0, 1, 2, 4, 8) UNION ALL SELECT o_orderkey, '1', 1 FROM l WHERE k = 2 UNION ALL SELECT o_orderkey, 'xiv', 3 FROM l WHERE k = 3""",
    "list_lines": "SELECT p_partkey, p_partkey % 6 IN (0, 1, 2, 4) AS bullet, p_partkey % 4 > 0 AND p_partkey % 6 = 3 AS wrapped, CASE WHEN p_partkey % 6 = 1 THEN 12 END AS number FROM part",
}
