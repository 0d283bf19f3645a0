"""Printed page numbers: each `source` is a document and its texts, by doc_id, are the pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import numbering as ops
from .base import read


def pages_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, page_idx, number and kind; the tables print no numbers, so they are made from the index
    with gaps (doc_id % 7), slips (doc_id % 11) and a change of kind."""
    idx = (F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1).cast("int")
    docs = read(spark, sf_dir, "documents").select("source", "doc_id", idx.alias("page_idx"))
    number = F.when(F.col("doc_id") % 7 == 0, None).when(F.col("doc_id") % 11 == 0, F.col("doc_id") % 97 + 1).otherwise(F.col("page_idx") + 1 + F.floor(F.col("page_idx") / 20) * 3)
    kind = F.when(F.col("doc_id") % 7 == 0, None).when(F.col("page_idx") < 6, "roman").otherwise("arabic")
    return docs.select("source", "page_idx", number.cast("int").alias("number"), kind.alias("kind"))


def printed_page_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.consecutive_runs(pages_of(spark, sf_dir), "source")


def printed_page_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.candidate_segments(pages_of(spark, sf_dir), "source").withColumn("confidence", F.round("confidence", 9))


def printed_page_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.corrected(pages_of(spark, sf_dir), "source")


def kind_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.local_kind(pages_of(spark, sf_dir), "source").select("source", "page_idx", "segment_kind")


def page_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ops.segments(pages_of(spark, sf_dir), "source")
    return found.groupBy("source", "segment").agg(F.min("page_idx").alias("start"), F.max("page_idx").alias("end"), F.count("*").alias("pages"), F.count("number").alias("numbered"))


def nearest_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.nearest_of_kind(pages_of(spark, sf_dir), "source").select("source", "page_idx", "previous", "next", "projected")


def folio_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.folio_support(pages_of(spark, sf_dir), "source").select("source", "page_idx", "support")


def page_number_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers from 1 to 999 without a leading zero, and Roman numerals, in the texts of `conversations`."""
    tokens = F.filter(F.regexp_extract_all("text", F.lit("([0-9]+)"), 1), lambda t: (F.length(t) <= 3) & ~t.startswith("0"))
    roman = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda t: t.rlike("^[ivxlcdm]{1,12}$"))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(tokens).alias("arabic"), F.array_join(tokens, ",").alias("numbers"), F.size(roman).alias("roman"))


def nearest_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values of a user's purchases before and after each event: an as-of lookup both ways."""
    along, back = (Window.partitionBy("user_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1) for order in (("ts", "event_id"), (F.desc("ts"), F.desc("event_id"))))
    bought = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    events = read(spark, sf_dir, "events")
    return events.select("event_id", F.last(bought, True).over(along).alias("before"), F.last(bought, True).over(back).alias("after"))


def edge_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two candidates a page: the right one in the footer, a stray one in the header."""
    pages = pages_of(spark, sf_dir).where("number is not null")
    both = F.explode(F.array(F.struct(F.lit("footer").alias("zone"), F.col("number").alias("number")), F.struct(F.lit("header").alias("zone"), (F.col("page_idx") * 7 % 50).alias("number"))))
    return ops.edge_sequences(pages.select("source", "page_idx", both.alias("c")).select("source", "page_idx", "c.*"), "source")


def repair_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = ops.local_kind(ops.nearest_of_kind(pages_of(spark, sf_dir), "source"), "source")
    i = F.col("page_idx")
    made = pages.withColumns({"raw": F.col("number"), "segment": F.floor(i / 16), "boundary": i % 16 == 8, "anomaly": i % 9 == 0})
    made = made.withColumn("status", F.when(F.col("segment") % 2 == 0, "stable").otherwise("anomaly"))
    return ops.repair_proposals(made, "source").select("source", "page_idx", "action", "confidence", "reason")


QUERIES = {f.__name__: f for f in (printed_page_runs, printed_page_segments, printed_page_correct, kind_window, page_segments, nearest_numbers, folio_support, page_number_candidates, nearest_anchor, edge_sequences, repair_proposals)}

_PAGES = """WITH idx AS (SELECT source, doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS INTEGER) AS page_idx FROM documents),
pages AS (
  SELECT source, page_idx, CAST(CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 11 = 0 THEN doc_id % 97 + 1 ELSE page_idx + 1 + page_idx // 20 * 3 END AS INTEGER) AS number,
         CASE WHEN doc_id % 7 = 0 THEN NULL WHEN page_idx < 6 THEN 'roman' ELSE 'arabic' END AS kind
  FROM idx
)"""
ORACLES = {
    "printed_page_runs": f"""{_PAGES}, n AS (SELECT source, page_idx, number - page_idx AS "offset" FROM pages WHERE number IS NOT NULL),
i AS (SELECT *, page_idx - row_number() OVER (PARTITION BY source, "offset" ORDER BY page_idx) AS island FROM n)
SELECT source, "offset", min(page_idx) AS start, max(page_idx) AS "end", count(*) AS n FROM i GROUP BY source, "offset", island HAVING count(*) >= 4""",
    "printed_page_segments": f"""{_PAGES}, s AS (SELECT source, page_idx, step, number - page_idx * step AS "offset" FROM pages, (VALUES (1), (2)) t(step) WHERE number > 0),
g AS (SELECT source, CAST(step AS INTEGER) AS step, "offset", min(page_idx) AS start, max(page_idx) AS "end", count(*) AS n FROM s GROUP BY ALL)
SELECT *, round(least(1.0, n / ("end" - start + 1)), 9) AS confidence FROM g WHERE n >= 2 AND (n / ("end" - start + 1) >= 0.7 OR n >= 3)""",
    # the segments of a source in the order of their rank; each is taken if it shares no page with one that is
    "printed_page_correct": f"""{_PAGES.replace("WITH idx", "WITH RECURSIVE idx", 1)}, s AS (SELECT source, page_idx, step, number - page_idx * step AS off FROM pages, (VALUES (1), (2)) t(step) WHERE number > 0),
g AS (SELECT source, step, off, min(page_idx) AS a, max(page_idx) AS b, count(*) AS n FROM s GROUP BY ALL), k AS (SELECT *, least(1.0, n / (b - a + 1)) AS c FROM g WHERE n >= 2 AND (n / (b - a + 1) >= 0.7 OR n >= 3)),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, c DESC, b - a DESC, step, a, off) AS k, count(*) OVER (PARTITION BY source) AS m FROM k),
f(source, k, m, taken) AS (SELECT DISTINCT source, 0::BIGINT, m, []::STRUCT(a INTEGER, b INTEGER, step INTEGER, off INTEGER)[] FROM r UNION ALL
  SELECT f.source, f.k + 1, f.m, CASE WHEN len(list_filter(f.taken, lambda x: r.b >= x.a AND r.a <= x.b)) = 0 THEN list_append(f.taken, struct_pack(a := r.a, b := r.b, step := r.step, off := CAST(r.off AS INTEGER))) ELSE f.taken END FROM f JOIN r ON r.source = f.source AND r.k = f.k + 1),
i AS (SELECT source, unnest(taken) AS t FROM f WHERE k = m), e AS (SELECT p.*, i.t.step * p.page_idx + i.t.off AS expected FROM pages p LEFT JOIN i ON i.source = p.source AND p.page_idx BETWEEN i.t.a AND i.t.b)
SELECT source, page_idx, number, kind, CAST(CASE WHEN expected > 0 THEN CASE WHEN coalesce(abs(number - expected) <= 1, false) THEN number ELSE expected END END AS INTEGER) AS corrected FROM e""",
    "kind_window": f"""{_PAGES}, c AS (SELECT *, count(*) FILTER (kind = 'arabic') OVER w AS a, count(*) FILTER (kind = 'roman') OVER w AS r FROM pages WINDOW w AS (PARTITION BY source ORDER BY page_idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING))
SELECT source, page_idx, CASE WHEN a > 0 AND r > 0 THEN 'mixed' WHEN a > 0 THEN 'arabic' WHEN r > 0 THEN 'roman' ELSE 'unknown' END AS segment_kind FROM c""",
    "page_segments": f"""{_PAGES}, l AS (SELECT *, lag(kind) OVER w AS k, lag(number) OVER w AS v, lag(page_idx) OVER w AS p FROM pages WINDOW w AS (PARTITION BY source ORDER BY page_idx)),
b AS (SELECT *, CASE WHEN k <> kind THEN 1 WHEN k = kind AND (number - v <= 0 OR abs(number - v - (page_idx - p)) >= 20) THEN 1 ELSE 0 END AS brk FROM l),
s AS (SELECT *, CAST(sum(brk) OVER (PARTITION BY source ORDER BY page_idx) AS BIGINT) AS segment FROM b)
SELECT source, segment, min(page_idx) AS start, max(page_idx) AS "end", count(*) AS pages, count(number) AS numbered FROM s GROUP BY source, segment""",
    "edge_sequences": f"""{_PAGES}, c AS (SELECT source, page_idx, 'footer' AS zone, number FROM pages WHERE number IS NOT NULL UNION SELECT source, page_idx, 'header', page_idx * 7 % 50 FROM pages WHERE number IS NOT NULL),
w AS (SELECT c.*, d AS distance, s AS step, number * d - page_idx * s AS line, page_idx % d AS lane FROM c, (VALUES (1), (2)) t(d), (VALUES (1), (2)) u(s)),
i AS (SELECT *, page_idx // distance - row_number() OVER (PARTITION BY source, zone, distance, step, line, lane ORDER BY page_idx) AS island FROM w),
r AS (SELECT *, count(*) OVER g AS run, min(page_idx) OVER g AS start FROM i WINDOW g AS (PARTITION BY source, zone, distance, step, line, lane, island)),
b AS (SELECT *, row_number() OVER (PARTITION BY source, page_idx ORDER BY run DESC, distance, step, zone, start, number) AS k FROM r WHERE run >= CASE WHEN distance = 1 THEN 3 ELSE 4 END)
SELECT source, page_idx, CAST(number AS INTEGER) AS number, run FROM b WHERE k = 1""",
    "nearest_numbers": f"""{_PAGES}, n AS (
  SELECT source, page_idx,
         last_value(CASE WHEN number IS NOT NULL THEN number END IGNORE NULLS) OVER b AS previous, last_value(CASE WHEN number IS NOT NULL THEN page_idx END IGNORE NULLS) OVER b AS pi,
         first_value(CASE WHEN number IS NOT NULL THEN number END IGNORE NULLS) OVER a AS next, first_value(CASE WHEN number IS NOT NULL THEN page_idx END IGNORE NULLS) OVER a AS ni
  FROM pages WINDOW b AS (PARTITION BY source, kind ORDER BY page_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY source, kind ORDER BY page_idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)
)
SELECT source, page_idx, previous, next, CASE WHEN previous + page_idx - pi = next - ni + page_idx THEN previous + page_idx - pi END AS projected FROM n""",
    "folio_support": f"""{_PAGES}
SELECT source, page_idx, CASE WHEN number IS NOT NULL THEN count(*) OVER (PARTITION BY source, number - page_idx ORDER BY page_idx RANGE BETWEEN 4 PRECEDING AND 4 FOLLOWING) - 1 END AS support FROM pages""",
    "page_number_candidates": r"""
WITH t AS (SELECT conv_id, turn, list_filter(regexp_extract_all(text, '[0-9]+'), lambda x: length(x) <= 3 AND NOT starts_with(x, '0')) AS n, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: regexp_full_match(x, '[ivxlcdm]{1,12}')) AS r FROM conversations)
SELECT conv_id, turn, CAST(len(n) AS INTEGER) AS arabic, coalesce(array_to_string(n, ','), '') AS numbers, CAST(len(r) AS INTEGER) AS roman FROM t""",
    "nearest_anchor": """
SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
       first_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
}
