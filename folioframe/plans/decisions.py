"""Decisions on page numbers and annotations by type size: customers are books, orders pages or blocks, line items spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import annotations, decisions, reading_view
from .base import read, tasks_for
from .numbering import pages_of


def _reviewed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents as the pages of a source's book; wherever a page's number is not what its place says, one is proposed."""
    i = F.col("page_idx")
    pages = pages_of(spark, sf_dir).select("source", i.alias("page"), F.col("kind"), F.col("number").cast("string").alias("current"))
    kind = F.when(i < 6, "roman").otherwise("arabic")
    wanted = F.when(F.col("page") < 6, F.element_at(F.array(*map(F.lit, ("i", "ii", "iii", "iv", "v", "vi"))), F.least(F.col("page") + 1, F.lit(6)).cast("int"))).otherwise((F.col("page") + 1).cast("string"))
    asked = pages.withColumn("wanted", wanted).where("page % 3 > 0 or current is null")
    told = asked.select("source", "page", F.when(F.col("current").isNull(), "fill_null").when(F.col("page") % 5 == 4, "delete_to_null").otherwise("replace").alias("action"), F.when((F.col("page") % 5 == 4) & F.col("current").isNotNull(), None).otherwise(F.col("wanted")).alias("proposed"), F.when(F.col("page") < 6, "roman").otherwise("arabic").alias("kind"), F.when(F.col("page") >= 6, F.col("current")).alias("current"), F.lit("?").alias("raw"), F.lit(None).cast("string").alias("reason"), F.lit(0.96).alias("confidence"))
    return told, pages.withColumn("kind", F.when(F.col("page") < 6, None).otherwise(F.col("kind"))).withColumn("kind", F.col("kind").cast("string"))


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    told, pages = _reviewed(spark, sf_dir)
    spans = decisions.review_spans(decisions.review_pages(told), pages, "source")
    k = F.col("page") % 7
    made = told.select("source", "page", F.when(k == 0, "keep").when(k == 1, "guess").otherwise(F.col("action")).alias("action"), F.when(k == 2, "9999").otherwise(F.col("proposed")).alias("chosen"))
    return decisions.judged(spans, made, "source")


def judged_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).select("source", "span", "page", "left", "right", "verdict")


def applied_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with their comment and the text of the document, after the accepted decisions."""
    _, pages = _reviewed(spark, sf_dir)
    blocks = pages.select("source", "page", F.concat(F.lit("{"), "page", F.lit("}\n<!-- Page: "), F.coalesce("current", F.lit("null")), F.lit(" -->\ntext <!-- note -->")).alias("block"))
    return decisions.applied(blocks, _judged(spark, sf_dir), "source")


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as pages, orders as blocks, line items as spans, whose quantity is their size."""
    items = read(spark, sf_dir, "lineitem")
    tasks = tasks_for(items)
    items = items.repartition(tasks, "l_orderkey").join(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("page")), "l_orderkey")
    size = F.when(F.col("l_partkey") % 9 > 0, F.when(F.col("l_suppkey") % 4 == 0, 6.0).otherwise(10.0) + F.col("l_quantity") % 2)
    text = F.when(F.col("l_orderkey") % 6 == 0, F.concat(F.lit("("), "l_returnflag", F.lit(")"))).otherwise(F.repeat(F.col("l_returnflag"), (F.col("l_partkey") % 12).cast("int")))
    return items.select("page", F.col("l_orderkey").alias("block"), ((F.col("l_linenumber").cast("long") * 10_000_000 + F.col("l_partkey")) * 100_000 + F.col("l_suppkey") % 1000 * 100 + F.col("l_quantity").cast("long")).alias("ord"), text.alias("text"), size.alias("size"), (F.col("l_partkey") % 50 == 7).alias("small")).repartition(tasks, "page")


def inline_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotations.inline_annotations(_spans(spark, sf_dir)).withColumn("ratio", F.round("ratio", 9))


def small_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotations.small_runs(_spans(spark, sf_dir)).withColumn("ratio", F.round("ratio", 9))


def _edited(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents as blocks of their source's book, each with edits of its characters: proven, twice, overlapping, misplaced, unproven."""
    blocks = read(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("block"), F.col("doc_id").alias("ord"), F.when(F.col("doc_id") % 6 == 0, "Footnote").otherwise("Text").alias("type"), "text", F.md5("source").alias("fingerprint"))
    made = [(0, 3, "remove_locator_token", "shape:digit", 0), (0, 3, "remove_locator_token", "shape:digit", 0), (10, 14, "remove_locator_token", "position:x", 0), (12, 14, "remove_text", "human_page_audit", 0), (20, 22, "remove_locator_token", "guess", 0), (24, 26, "remove_text", "shape:digit", 0), (28, 30, "remove_locator_token", "shape:digit", 1), (30, 34, "separate_native_margin", "sequence:step5", 0), (34, 35, "cut", "shape:digit", 0)]
    edit = lambda b, e, action, evidence, off: F.struct(F.lit(b).alias("begin"), F.lit(e).alias("end"), F.lit(action).alias("action"), F.array(F.lit(evidence)).alias("evidence"), F.concat(F.substring("text", b + 1, e - b), F.lit("§" * off)).alias("original"))
    edits = blocks.withColumn("e", F.explode(F.array(*(edit(*m) for m in made)))).select("source", "block", "e.*", "fingerprint")
    return blocks, edits


def judged_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks, edits = _edited(spark, sf_dir)
    return reading_view.judged_edits(edits, blocks, "source").groupBy("source", "begin", "verdict").agg(F.count("*").alias("n"))


def reading_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document after its edits, and for each third one a note restored beside it."""
    blocks, edits = _edited(spark, sf_dir)
    notes = blocks.where("block % 3 = 0").select("source", "block", F.lit(0).alias("number"), F.lit("Footnote").alias("type"), F.substring("text", 1, 9).alias("text"))
    view = reading_view.reading_view(blocks, reading_view.judged_edits(edits, blocks, "source"), notes, "source")
    return view.select("source", "block", "ord", "part", "type", F.md5(F.col("text").cast("binary")).alias("md5"), "edits")


def body_texts_of_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks, edits = _edited(spark, sf_dir)
    view = reading_view.reading_view(blocks, reading_view.judged_edits(edits, blocks, "source"), blocks.where("false").select("source", "block", F.lit(0).alias("number"), "type", "text"), "source")
    return reading_view.body_of(view, "source").select("source", "chars")


QUERIES = {f.__name__: f for f in (judged_edits, reading_views, body_texts_of_sources, judged_decisions, applied_decisions, inline_annotations, small_runs)}

_SPANS = """i AS (SELECT o_custkey AS page, l_orderkey AS block, (CAST(l_linenumber AS BIGINT) * 10000000 + l_partkey) * 100000 + l_suppkey % 1000 * 100 + CAST(l_quantity AS BIGINT) AS ord, CASE WHEN l_orderkey % 6 = 0 THEN '(' || l_returnflag || ')' ELSE repeat(l_returnflag, l_partkey % 12) END AS text,
  CASE WHEN l_partkey % 9 > 0 THEN CASE WHEN l_suppkey % 4 = 0 THEN 6.0 ELSE 10.0 END + l_quantity % 2 END::DOUBLE AS size, l_partkey % 50 = 7 AS small FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
m AS (SELECT page, median(size) AS main FROM i WHERE size IS NOT NULL GROUP BY page)"""
# which ranges stand in a text of a length, and what is left of it; a gap between two spaces closes to one
_VIEW = """d AS (SELECT source, doc_id, coalesce(text, '') AS t, text FROM documents),
a AS (SELECT *, length(t) >= 3 AS one, length(t) >= 34 AS two, substr(t, 4, 27) AS mid, CASE WHEN length(t) >= 34 THEN substr(t, 35) END AS tail FROM d),
v AS (SELECT *, CASE WHEN NOT one THEN t WHEN NOT two THEN trim(substr(t, 4), ' ') ELSE trim(CASE WHEN ends_with(mid, ' ') AND starts_with(tail, ' ') THEN mid || substr(tail, 2) ELSE mid || tail END, ' ') END AS after, CAST(one AS INTEGER) + CAST(two AS INTEGER) AS edits FROM a)"""
ORACLES = {
    "reading_views": f"""WITH {_VIEW} SELECT source, CAST(doc_id AS VARCHAR) AS block, doc_id AS ord, 0 AS part, CASE WHEN doc_id % 6 = 0 THEN 'Footnote' ELSE 'Text' END AS type, md5(after) AS md5, edits FROM v
UNION ALL SELECT source, doc_id || '::note-0', doc_id, 1, 'Footnote', md5(substr(text, 1, 9)), 0 FROM v WHERE doc_id % 3 = 0""",
    "body_texts_of_sources": f"""WITH {_VIEW} SELECT source, CAST(sum(length(after)) + 2 * (count(*) - 1) AS INTEGER) AS chars FROM v WHERE doc_id % 6 > 0 AND trim(after, ' ') <> '' GROUP BY source""",
    "judged_edits": """WITH d AS (SELECT source, coalesce(text, '') AS t FROM documents), e(b, e, kind) AS (VALUES (0, 3, 'applied'), (10, 14, 'overlapping_edits'), (12, 14, 'overlapping_edits'), (20, 22, 'edit_evidence_missing_or_unsupported'), (24, 26, 'human_text_edit_without_human_evidence'), (28, 30, 'source_text_mismatch'), (30, 34, 'applied'), (34, 35, 'unsupported_edit_action')),
j AS (SELECT source, b, CASE WHEN kind IN ('edit_evidence_missing_or_unsupported', 'human_text_edit_without_human_evidence', 'unsupported_edit_action') THEN kind WHEN length(t) < e THEN 'source_text_mismatch' ELSE kind END AS verdict FROM d, e)
SELECT source, b AS begin, verdict, count(*) AS n FROM j GROUP BY ALL""",
    "inline_annotations": f"""WITH {_SPANS}, b AS (SELECT page, block, trim(string_agg(text, ' ' ORDER BY ord, text)) AS t, avg(size) AS mean, min(size) AS low, max(size) AS high, count(size) AS n, bool_or(small) AS small FROM i GROUP BY ALL),
r AS (SELECT b.*, coalesce(mean / main, 1) AS ratio, starts_with(t, '(') AND ends_with(t, ')') AS bracketed, coalesce(n > 1 AND (high - low) / high > 0.3, false) AS mixed FROM b LEFT JOIN m USING (page))
SELECT page, block, CASE WHEN bracketed THEN '括号注' WHEN mixed THEN '双行小字' WHEN ratio < 0.7 AND length(t) < 30 THEN '夹注' WHEN ratio < 0.7 AND length(t) < 100 THEN '割注' ELSE '其他小字注' END AS subtype, round(ratio, 9) AS ratio
FROM r WHERE length(t) BETWEEN 1 AND 100 AND (ratio < 0.75 OR small OR bracketed OR mixed)""",
    # in two rounds as well: islands of a level, and those of under two signs between others turn
    "small_runs": f"""WITH {_SPANS}, l AS (SELECT i.*, main, coalesce(last_value(CASE WHEN size IS NOT NULL THEN size < 0.75 * main END IGNORE NULLS) OVER (PARTITION BY page, block ORDER BY ord, text), false) AS v FROM i LEFT JOIN m USING (page)),
a1 AS (SELECT *, CASE WHEN v = lag(v) OVER (PARTITION BY page, block ORDER BY ord, text) THEN 0 ELSE 1 END AS t FROM l), b1 AS (SELECT *, sum(t) OVER (PARTITION BY page, block ORDER BY ord, text) AS run FROM a1),
c1 AS (SELECT *, sum(length(trim(text))) OVER (PARTITION BY page, block, run) AS signs, max(run) OVER (PARTITION BY page, block) AS runs FROM b1), d1 AS (SELECT * EXCLUDE (v, t, run, signs, runs), CASE WHEN signs < 2 AND run > 1 AND run < runs THEN NOT v ELSE v END AS v FROM c1),
a2 AS (SELECT *, CASE WHEN v = lag(v) OVER (PARTITION BY page, block ORDER BY ord, text) THEN 0 ELSE 1 END AS t FROM d1), b2 AS (SELECT *, sum(t) OVER (PARTITION BY page, block ORDER BY ord, text) AS run FROM a2),
c2 AS (SELECT *, sum(length(trim(text))) OVER (PARTITION BY page, block, run) AS signs, max(run) OVER (PARTITION BY page, block) AS runs FROM b2), d2 AS (SELECT * EXCLUDE (v, t, run, signs, runs), CASE WHEN signs < 2 AND run > 1 AND run < runs THEN NOT v ELSE v END AS v FROM c2),
a3 AS (SELECT *, CASE WHEN v = lag(v) OVER (PARTITION BY page, block ORDER BY ord, text) THEN 0 ELSE 1 END AS t FROM d2), b3 AS (SELECT *, sum(t) OVER (PARTITION BY page, block ORDER BY ord, text) AS run FROM a3)
SELECT page, block, min(ord) AS first, max(ord) AS last, string_agg(text, ' ' ORDER BY ord, text) AS text, round(avg(size) / any_value(main), 9) AS ratio FROM b3 WHERE v GROUP BY page, block, run""",
}
