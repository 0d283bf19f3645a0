"""Middle documents made from `conversations` (a conversation is a document, a turn a page, a sentence a block), with planted faults."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chain, documents, notes
from ..operators import middle as ops
from . import layout
from .base import read
from .documents import _BLOCKS, blocks_of


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc")).agg(F.count("*").alias("n"))
    return turns.select("doc", F.when(F.col("doc") % 9 > 0, "middle/1").alias("schema_version"), (F.col("n") + F.when(F.col("doc") % 7 == 0, 1).otherwise(0)).alias("page_count"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, turn = F.col("conv_id") + F.col("turn"), F.col("turn").cast("int")
    size = lambda n: F.when(k % n == 0, float("nan")).when(k % n == 1, -1.0).when(k % n == 2, F.lit(None)).otherwise(60.0)
    index = F.when(k % 23 == 0, F.lit(None)).when((F.col("turn") > 0) & (k % 11 == 0), turn - 1).otherwise(turn)
    return read(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc"), turn.alias("page"), index.alias("index"), F.when(k % 13 > 0, index).alias("anchor_start"), (index + F.when(k % 17 == 0, 2).otherwise(1)).alias("anchor_end"), size(19).alias("width"), size(29).alias("height")
    )


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The made blocks with faults: ids that are empty or stand twice, orders, anchors, boxes and confidences that break a rule."""
    b = blocks_of(spark, sf_dir)
    pos = (F.col("ord") % 1000).cast("int")
    n = F.col("doc") * 3 + F.col("ord")
    points = F.transform(F.sequence(F.lit(1), F.when(n % 37 == 0, 3).otherwise(4)), lambda i: i.cast("double"))
    return b.select(
        "doc", "page", pos.alias("pos"), F.when(n % 41 > 0, F.col("id")).alias("id"), "type", "text", F.when(n % 31 > 0, F.col("page")).otherwise(F.col("page") + 1).alias("page_index"),
        F.when(n % 43 == 0, F.lit(None)).when(n % 7 == 0, pos - 2).otherwise(pos).cast("int").alias("ord"), F.when(n % 47 > 0, F.col("page")).alias("anchor_start"), (F.col("page") + F.when(n % 53 == 0, 0).otherwise(1)).alias("anchor_end"),
        F.when(n % 59 > 0, F.col("x0")).alias("x0"), "y0", "x1", "y1", F.when(n % 61 == 0, float("nan")).otherwise(F.col("confidence")).alias("confidence"), points.alias("polygon"),
    )


def document_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.document_issues(_documents(spark, sf_dir), _pages(spark, sf_dir), "middle/1")


def page_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.page_issues(_pages(spark, sf_dir))


def block_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a document breaks each rule for blocks."""
    return ops.block_issues(_blocks(spark, sf_dir), _pages(spark, sf_dir)).groupBy("doc", "severity", "code").agg(F.count("*").alias("n"))


def span_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block's words as spans; every ninth is blank, every eleventh null."""
    words = _blocks(spark, sf_dir).select("doc", "page", "pos", "x0", "y0", "x1", "y1", "confidence", F.posexplode(F.split("text", " ")).alias("span", "text"))
    k = F.col("doc") + F.col("pos") + F.col("span")
    spans = words.withColumn("text", F.when(k % 11 == 0, F.lit(None)).when(k % 9 == 0, "  ").otherwise(F.col("text")))
    return ops.span_issues(spans, _pages(spark, sf_dir)).groupBy("severity", "code").agg(F.count("*").alias("n"))


def _provenance(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    path = F.concat(F.lit("$.pages["), "page", F.lit("].blocks["), "pos", F.lit("]"))
    holders = _blocks(spark, sf_dir).select("doc", path.alias("path"), "pos", "confidence")
    k = F.col("doc") + F.col("pos")
    named = holders.where(k % 5 > 0).select("doc", "path", F.lit(0).alias("item"), F.when(k % 3 > 0, "reader").otherwise("").alias("backend"), F.when(k % 4 > 0, "layout").alias("stage"), "confidence")
    return holders.select("doc", "path"), named


def provenance_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.provenance_issues(*_provenance(spark, sf_dir)).groupBy("doc", "severity", "code").agg(F.count("*").alias("n"))


def publishable_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, pages = _documents(spark, sf_dir), _pages(spark, sf_dir)
    return ops.publishable(ops.document_issues(docs, pages, "middle/1").unionByName(ops.page_issues(pages)), docs, blocks_of(spark, sf_dir))


def semantic_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = blocks_of(spark, sf_dir).withColumns({c: F.col(c).cast("int") for c in ops.SIDES}).withColumn("confidence", (F.col("ord") % 3).cast("int"))
    return ops.fingerprint(rows)


def live_to_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = blocks_of(spark, sf_dir).select("doc", "page", F.when(F.col("type") == "Quote", "list_item").otherwise(F.col("type")).alias("type"), (F.col("ord") % 1000).alias("n"), "ord", F.concat(F.lit(" "), "text").alias("text"), *ops.SIDES)
    return ops.from_live(live).select("doc", "id", "type", "raw_label", "ord", F.length("text").alias("size"), "anchor_start", "anchor_end")


def compact_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    attrs = F.map_from_arrays(F.array(F.lit("font_size"), F.lit("colour"), F.lit("formats")), F.array(F.col("p_size").cast("string"), F.col("p_brand"), F.when(F.col("p_size") % 2 == 0, "bold")))
    given = F.map_from_arrays(F.array(F.lit("backend"), F.lit("notes")), F.array(F.col("p_type"), F.col("p_name")))
    spans = ops.compact_spans(read(spark, sf_dir, "part").select("p_partkey", attrs.alias("attrs"), F.when(F.col("p_partkey") % 5 > 0, given).alias("provenance")))
    said = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return spans.select("p_partkey", said("attrs").alias("attrs"), said("provenance").alias("provenance"))


def lean_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = F.when(F.col("l_orderkey") % 3 == 0, F.array(F.lit("ocr_merge"), F.lit("x"))).otherwise(F.array(F.lit("y")))
    spans = read(spark, sf_dir, "lineitem").select("l_orderkey", F.when(F.col("l_linenumber") % 2 == 0, "word").otherwise("line").alias("kind"), options.alias("options"))
    return ops.lean(spans, F.col("options")).groupBy("l_orderkey").agg(F.count("*").alias("spans"))


def merged_ocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as recognised items on the made blocks; every seventh has no box."""
    items = layout.lines_of(spark, sf_dir)
    boxless = F.col("id") % 7 == 0
    items = items.select("page", "id", F.concat(F.lit("t"), "id").alias("text"), *(F.when(~boxless, F.col(c)).alias(c) for c in ops.SIDES))
    found = ops.merged_items(items, layout.blocks_of(spark, sf_dir))
    return found.select("page", "block", "kind", F.md5(F.col("text").cast("binary")).alias("md5"))


def smoke_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc")).distinct()
    expected = docs.withColumn("required", F.when(F.col("doc") % 2 == 0, F.array(F.lit("Text"), F.lit("Table"))).otherwise(F.array(F.lit("SectionHeader")))).withColumn("least", F.col("doc") % 8)
    return ops.smoke(blocks_of(spark, sf_dir), expected)


def rerender_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An option under two names, a stored value and a default."""
    k = F.col("o_orderkey")
    asked = ops.agreed(F.when(k % 3 == 0, "drop"), F.when(k % 6 == 0, "drop"), "margin")
    return read(spark, sf_dir, "orders").select("o_orderkey", ops.options(asked, F.when(k % 5 == 0, "comments"), F.lit("plain")).alias("margin"))


def review_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = blocks_of(spark, sf_dir)
    text = F.when(F.col("ord") % 17 == 0, " ").otherwise(F.col("text"))
    kind = F.when(F.col("ord") % 13 == 0, "Table").otherwise(F.col("type"))
    return ops.review_status(b.withColumn("text", text).withColumn("type", kind))


def processor_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relabelling, the note policy and a step whose gate is closed, then the types that are left."""
    rules = spark.createDataFrame([("Quote", "Text", 0.5)], "old string, new string, threshold double")

    def policy(blocks: DataFrame, notes_enabled: bool = True) -> dict[str, DataFrame]:
        return {"blocks": notes.note_policy(blocks, F.lit(notes_enabled))}

    steps = [
        chain.Processor("relabel", lambda blocks, relabel_rules: {"blocks": documents.relabel(blocks, relabel_rules)}),
        chain.Processor("note_policy", policy),
        chain.Processor("drop_lists", lambda blocks: {"blocks": blocks.where("type <> 'ListItem'")}, "drop_lists", default=False),
        chain.Processor("needs_lines", lambda lines: {"blocks": lines}),
    ]
    now, ran = chain.run({"blocks": blocks_of(spark, sf_dir), "relabel_rules": rules}, steps, {"notes_enabled": False})
    return now["blocks"].groupBy("type").agg(F.count("*").alias("n")).withColumn("ran", F.lit(",".join(ran)))


QUERIES = {
    f.__name__: f
    for f in (document_issues, page_issues, block_issues, span_issues, provenance_issues, publishable_documents, semantic_fingerprints, live_to_middle, compact_spans, lean_spans, merged_ocr, smoke_evaluation, rerender_options, review_status, processor_chain)
}

_SIZE = "CASE WHEN k % {0} = 0 THEN 'NaN'::DOUBLE WHEN k % {0} = 1 THEN -1 WHEN k % {0} = 2 THEN NULL ELSE 60 END"
_PAGES = f"""pk AS (SELECT conv_id AS doc, CAST(turn AS INTEGER) AS page, conv_id + turn AS k FROM conversations),
pi AS (SELECT *, CASE WHEN k % 23 = 0 THEN NULL WHEN page > 0 AND k % 11 = 0 THEN page - 1 ELSE page END AS idx, {_SIZE.format(19)} AS width, {_SIZE.format(29)} AS height FROM pk),
pages_ AS (SELECT doc, page, idx, CASE WHEN k % 13 > 0 THEN idx END AS a0, idx + CASE WHEN k % 17 = 0 THEN 2 ELSE 1 END AS a1, width, height, '$.pages[' || page || ']' AS path, row_number() OVER (PARTITION BY doc, idx ORDER BY page) AS nth FROM pi)"""
_PAGE_ISSUES = "page_issues_ AS (" + " UNION ALL ".join(
    f"SELECT doc, 'error' AS severity, path || '{suffix}' AS path, '{code}' AS code FROM pages_ WHERE {test}"
    for suffix, code, test in [
        (".index", "not_an_integer", "idx IS NULL"), (".index", "duplicate", "idx IS NOT NULL AND nth > 1"), (".anchor_start", "not_the_index", "idx IS NOT NULL AND a0 IS DISTINCT FROM idx"), (".anchor_end", "not_the_next_index", "idx IS NOT NULL AND a1 IS DISTINCT FROM idx + 1"),
        *((f".{c}", "not_a_number", f"idx IS NOT NULL AND isnan({c})") for c in ("width", "height")), *((f".{c}", "not_positive", f"idx IS NOT NULL AND NOT isnan({c}) AND {c} <= 0") for c in ("width", "height")),
    ]
) + ")"
_DOCS = "docs AS (SELECT conv_id AS doc, count(*) AS n FROM conversations GROUP BY 1)"
_DOC_ISSUES = "doc_issues AS (SELECT doc, 'error' AS severity, '$.schema_version' AS path, 'unknown_version' AS code FROM docs WHERE doc % 9 = 0 UNION ALL SELECT doc, 'error', '$.page_count', 'not_the_number_of_pages' FROM docs WHERE doc % 7 = 0)"
_FAULTY = f"""{_BLOCKS}, {_PAGES}, fb AS (SELECT doc, page, CAST(ord % 1000 AS INTEGER) AS pos, doc * 3 + ord AS n, id, type, text, ord AS o, x0, y0, x1, y1, confidence FROM blocks),
f AS (SELECT doc, page, pos, n, CASE WHEN n % 41 > 0 THEN id END AS id, type, text, CASE WHEN n % 31 > 0 THEN page ELSE page + 1 END AS pidx, CASE WHEN n % 43 = 0 THEN NULL WHEN n % 7 = 0 THEN pos - 2 ELSE pos END AS ord,
  CASE WHEN n % 47 > 0 THEN page END AS a0, page + CASE WHEN n % 53 = 0 THEN 0 ELSE 1 END AS a1, CASE WHEN n % 59 > 0 THEN CAST(x0 AS DOUBLE) END AS x0, CAST(y0 AS DOUBLE) AS y0, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1, CASE WHEN n % 61 = 0 THEN 'NaN'::DOUBLE ELSE confidence END AS c FROM fb),
g AS (SELECT f.*, p.idx, p.width, p.height FROM f JOIN pages_ p ON p.doc = f.doc AND p.page = f.page WHERE p.idx IS NOT NULL),
h AS (SELECT *, coalesce(id, '') <> '' AS named, row_number() OVER (PARTITION BY doc, id ORDER BY page, pos) AS nid, row_number() OVER (PARTITION BY doc, page, ord ORDER BY pos) AS nord, last_value(ord IGNORE NULLS) OVER (PARTITION BY doc, page ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lord FROM g)"""
_BOXES = [
    ("error", "not_four_numbers", "x0 IS NULL"), ("error", "reversed", "x0 IS NOT NULL AND (x1 < x0 OR y1 < y0)"), ("warning", "no_area", "x0 IS NOT NULL AND NOT (x1 < x0 OR y1 < y0) AND (x1 = x0 OR y1 = y0)"),
    ("warning", "outside_width", "x0 IS NOT NULL AND NOT (x1 < x0 OR y1 < y0) AND width > 0 AND (x0 < 0 OR x1 > width)"), ("warning", "outside_height", "x0 IS NOT NULL AND NOT (x1 < x0 OR y1 < y0) AND height > 0 AND (y0 < 0 OR y1 > height)"),
    ("error", "not_a_number", "isnan(c)"), ("warning", "not_normalized", "NOT isnan(c) AND (c < 0 OR c > 1)"),
]
_COUNTED = " UNION ALL ".join(
    f"SELECT doc, '{s}' AS severity, '{code}' AS code FROM h WHERE {test}"
    for s, code, test in [
        ("error", "missing", "NOT named"), ("error", "duplicate", "named AND nid > 1"), ("error", "not_canonical", "type = 'Unknown'"), ("error", "not_the_page", "pidx IS DISTINCT FROM idx"), ("error", "not_an_integer", "ord IS NULL"),
        ("warning", "duplicate", "ord IS NOT NULL AND nord > 1"), ("warning", "not_sorted", "ord < lord"), ("error", "not_integers", "a0 IS NULL"), ("error", "not_around_the_page", "a0 IS NOT NULL AND NOT (a0 <= idx AND idx < a1)"), ("error", "not_four_points", "n % 37 = 0"), *_BOXES,
    ]
)
_SPANS = " UNION ALL ".join(f"SELECT '{s}' AS severity, '{code}' AS code FROM w WHERE {test}" for s, code, test in [("error", "not_a_string", "k % 11 = 0"), ("warning", "empty", "k % 11 > 0 AND (k % 9 = 0 OR word = '')"), *_BOXES])
_LIVE = f"{_BLOCKS}, v AS (SELECT doc, page, ord, CASE WHEN type = 'Quote' THEN 'list_item' ELSE type END AS raw, text FROM blocks)"
ORACLES = {
    "document_issues": f"WITH {_DOCS}, {_DOC_ISSUES} SELECT * FROM doc_issues",
    "page_issues": f"WITH {_PAGES}, {_PAGE_ISSUES} SELECT * FROM page_issues_",
    "block_issues": f"{_FAULTY} SELECT doc, severity, code, count(*) AS n FROM ({_COUNTED}) GROUP BY ALL",
    "span_issues": f"{_FAULTY}, wl AS (SELECT f.*, string_split(f.text, ' ') AS ws, p.width, p.height FROM f JOIN pages_ p ON p.doc = f.doc AND p.page = f.page), w AS (SELECT * EXCLUDE (ws), doc + pos + i AS k FROM (SELECT *, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS i FROM wl)) SELECT severity, code, count(*) AS n FROM ({_SPANS}) GROUP BY ALL",
    "provenance_issues": f"""{_FAULTY}, q AS (SELECT doc, doc + pos AS k, c FROM f) SELECT doc, severity, code, count(*) AS n FROM (SELECT doc, 'warning' AS severity, 'missing' AS code FROM q WHERE k % 5 = 0 UNION ALL SELECT doc, 'warning', 'unnamed' FROM q WHERE k % 5 > 0 AND k % 3 = 0
UNION ALL SELECT doc, 'warning', 'unnamed' FROM q WHERE k % 5 > 0 AND k % 4 = 0 UNION ALL SELECT doc, 'error', 'not_a_number' FROM q WHERE k % 5 > 0 AND isnan(c) UNION ALL SELECT doc, 'warning', 'not_normalized' FROM q WHERE k % 5 > 0 AND NOT isnan(c) AND (c < 0 OR c > 1)) GROUP BY ALL""",
    "publishable_documents": f"""{_BLOCKS}, {_PAGES}, {_PAGE_ISSUES}, {_DOCS}, {_DOC_ISSUES}, e AS (SELECT doc, count(*) AS errors FROM (SELECT doc FROM page_issues_ UNION ALL SELECT doc FROM doc_issues) GROUP BY doc), s AS (SELECT doc, count(*) AS blocks FROM blocks GROUP BY doc)
SELECT doc, coalesce(errors, 0) AS errors, coalesce(blocks, 0) AS blocks, coalesce(errors, 0) = 0 AND coalesce(blocks, 0) > 0 AS publishable FROM docs LEFT JOIN e USING (doc) LEFT JOIN s USING (doc)""",
    "semantic_fingerprints": f"{_BLOCKS} SELECT doc, sha256(string_agg(concat_ws(chr(31), id, type, text, CAST(x0 AS BIGINT), CAST(y0 AS BIGINT), CAST(x1 AS BIGINT), CAST(y1 AS BIGINT), ord % 3), chr(30) ORDER BY page, ord)) AS sha256 FROM blocks GROUP BY doc",
    "live_to_middle": f"{_LIVE} SELECT doc, '/page/' || page || '/' || raw || '/' || ord % 1000 AS id, CASE raw WHEN 'list_item' THEN 'ListItem' WHEN 'Unknown' THEN 'ComplexRegion' ELSE raw END AS type, raw AS raw_label, CAST(ord % 1000 AS INTEGER) AS ord, CAST(length(trim(text)) AS INTEGER) AS size, page AS anchor_start, page + 1 AS anchor_end FROM v",
    "compact_spans": "SELECT p_partkey, 'font_size=' || p_size || CASE WHEN p_size % 2 = 0 THEN ',formats=bold' ELSE '' END AS attrs, CASE WHEN p_partkey % 5 > 0 THEN 'backend=' || p_type ELSE '' END AS provenance FROM part",
    "lean_spans": "SELECT l_orderkey, count(*) AS spans FROM lineitem WHERE l_linenumber % 2 = 1 OR l_orderkey % 3 = 0 GROUP BY 1",
    "merged_ocr": f"""WITH {layout._BLOCKS}, {layout._LINES}, s AS (SELECT a.page, a.id AS item, b.id AS block, {layout._COMMON} / ({layout._AREA.format("a")}) AS score FROM lines a LEFT JOIN blocks b ON a.page = b.page WHERE a.id % 7 <> 0),
r AS (SELECT page, item, CASE WHEN score >= 0.5 THEN block END AS block FROM (SELECT *, row_number() OVER (PARTITION BY page, item ORDER BY score DESC NULLS LAST, block) AS k FROM s) WHERE k = 1 UNION ALL SELECT DISTINCT l.page, l.id, (SELECT min(b.id) FROM blocks b WHERE b.page = l.page AND b.kind = 'Text') FROM lines l WHERE l.id % 7 = 0)
SELECT page, coalesce(block, item) AS block, CASE WHEN block IS NULL THEN 'new' ELSE 'merged' END AS kind, md5(string_agg('t' || item, chr(10) ORDER BY item)) AS md5 FROM r GROUP BY ALL""",
    "smoke_evaluation": f"""{_BLOCKS}, t AS (SELECT doc, list(DISTINCT type) AS types, count(*) AS n FROM blocks GROUP BY doc), e AS (SELECT DISTINCT conv_id AS doc, CASE WHEN conv_id % 2 = 0 THEN ['Table', 'Text'] ELSE ['SectionHeader'] END AS req, conv_id % 8 AS least FROM conversations),
m AS (SELECT doc, coalesce(n, 0) AS n, least, list_filter(req, lambda x: NOT list_contains(coalesce(types, []), x)) AS missing FROM e LEFT JOIN t USING (doc)) SELECT doc, n AS blocks, array_to_string(missing, ',') AS missing, len(missing) = 0 AND n >= least AS passed FROM m""",
    "rerender_options": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'drop' WHEN o_orderkey % 5 = 0 THEN 'comments' ELSE 'plain' END AS margin FROM orders",
    "review_status": f"""{_BLOCKS}, b AS (SELECT doc, confidence, CASE WHEN ord % 13 = 0 THEN 'Table' ELSE type END AS type, ord % 17 = 0 OR trim(text) = '' AS gone FROM blocks), s AS (SELECT doc, count(*) FILTER (gone) AS empty, count(*) FILTER (confidence < 0.5) AS doubtful, count(*) FILTER (type = 'Table') AS tables, count(*) AS blocks FROM b GROUP BY doc)
SELECT *, CASE WHEN empty + tables > 0 THEN 'needs_review' WHEN doubtful > 0.2 * blocks THEN 'check' ELSE 'ready' END AS status FROM s""",
    "processor_chain": f"{_BLOCKS} SELECT CASE WHEN type = 'Footnote' OR (type = 'Quote' AND confidence <= 0.5) THEN 'Text' ELSE type END AS type, count(*) AS n, 'relabel,note_policy' AS ran FROM blocks GROUP BY ALL",
}
