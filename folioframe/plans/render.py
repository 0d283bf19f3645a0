"""Renderings and run records, on the made blocks of `documents` and the nation tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import render as ops
from .base import read
from .documents import _BLOCKS, blocks_of


def _rich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The made blocks with page furniture, code, equations, margin notes and markers."""
    n = F.col("doc") + F.col("ord")
    kind = F.when(n % 13 == 0, "PageHeader").when(n % 17 == 0, "PageFooter").when(n % 19 == 0, "Code").when(n % 23 == 0, "Equation").when(n % 29 == 0, "MarginalNote").when(n % 31 == 0, "PageNumber").otherwise(F.col("type"))
    text = F.when(n % 19 == 0, "a ```` b").when(n % 31 == 0, (n % 400).cast("string")).when(n % 11 == 0, "{12}").when(n % 7 == 0, F.concat(F.lit("3. "), "text")).when(n % 37 == 0, " ").otherwise(F.col("text"))
    return blocks_of(spark, sf_dir).withColumn("text", text).withColumn("type", kind).withColumn("marker", F.when((F.col("type") == "Footnote") & (n % 2 == 0), (n % 3).cast("string")))


def scholarly_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").cast("int").alias("page"), F.when(F.col("turn") % 2 == 0, (F.col("turn") + 100).cast("string")).alias("printed"))
    found = ops.scholarly_markdown(pages, _rich(spark, sf_dir))
    return found.select("doc", F.md5(F.col("markdown").cast("binary")).alias("md5"), F.length("markdown").alias("size"))


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = read(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_regionkey").cast("long").alias("ord"), F.lit(0).alias("level"), F.lit("section").alias("tag"), F.col("r_name").alias("text"))
    nation = read(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"), F.col("n_nationkey").cast("long"), F.lit(1), F.lit("div"), F.concat("n_name", F.lit(" <&> \"x\"")))
    customer = read(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey"), F.concat(F.lit("n"), "c_nationkey"), F.col("c_custkey"), F.lit(2), F.lit("p"), F.col("c_name"))
    return region.union(nation).union(customer)


def html_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.html_tree(_tree(spark, sf_dir), 2).select("id", F.md5(F.col("made").cast("binary")).alias("md5"))


def json_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.json_tree(_tree(spark, sf_dir), 2).select("id", F.md5(F.col("made").cast("binary")).alias("md5"))


def ocr_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = blocks_of(spark, sf_dir).select("doc", "page", F.col("ord").alias("line"), F.regexp_replace("text", r"[^A-Za-z ]", "").alias("text"), F.array(F.col("x0").cast("int"), F.col("y0").cast("int")).alias("bbox"))
    return ops.ocr_json(lines, "doc").select("doc", F.md5(F.col("json").cast("binary")).alias("md5"))


def body_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.body_text(_rich(spark, sf_dir), "doc").select("doc", F.md5(F.col("body").cast("binary")).alias("md5"))


def source_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = blocks_of(spark, sf_dir).select("doc", F.lit("block").alias("kind"), "id", "type", F.lit(None).cast("int").alias("level"), F.col("ord").cast("long").alias("place"), "text")
    pages = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.lit("anchor").alias("kind"), F.lit("p").alias("id"), F.lit("page").alias("type"), F.lit(None).cast("int").alias("level"), (F.col("turn") * 1000 - 1).alias("place"), F.col("turn").cast("string").alias("text"))
    found = ops.source_markdown(rows.unionByName(pages))
    return found.select("doc", F.md5(F.col("markdown").cast("binary")).alias("md5"))


def text_layer_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = F.regexp_replace("text", r"([A-Za-z]{3})([a-z]{3,}) ", "$1-\n$2 ")
    found = ops.text_layer_markdown(read(spark, sf_dir, "documents").select("doc_id", cut.alias("text")), "doc_id", "text")
    return found.select("doc_id", F.md5(F.col("markdown").cast("binary")).alias("md5"), "sparse")


def bundle_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(F.lit("markdown"), F.lit("html"), F.lit("middle")), (F.col("p_partkey") % 3 + 1).cast("int"))
    files = read(spark, sf_dir, "part").select(F.concat(F.lit("../"), "p_name", F.lit("/"), "p_partkey", F.lit(".pdf")).alias("source"), kind.alias("kind"))
    return ops.bundle_names(files).select("source", "name")


def result_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("markdown"), F.when(F.col("doc_id") % 3 == 0, F.col("lang")).alias("html"))
    return ops.artifacts(results, "doc_id", ["markdown", "html"]).select("doc_id", "kind", "bytes", "sha256")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.element_at(F.array(*(F.lit(s) for s in ("submitted", "completed", "failed", "skipped"))), (F.col("event_id") % 4 + 1).cast("int"))
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("source"), status.alias("status"), (F.col("event_id") % 50).alias("at"), "event_type", (F.col("event_id") % 9).alias("pages"), (F.col("event_id") % 5 + 1).cast("double").alias("seconds"))


def latest_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.latest_records(_records(spark, sf_dir))


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.run_summary(_records(spark, sf_dir), "event_type")


def canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = F.map_from_arrays(F.array(F.lit("size"), F.lit("brand"), F.lit("type")), F.array(F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 3 > 0, F.col("p_brand")), F.col("p_type")))
    return read(spark, sf_dir, "part").select("p_partkey", ops.canonical_json(pairs).alias("json"))


QUERIES = {
    f.__name__: f
    for f in (scholarly_documents, html_tree, json_tree, ocr_json, body_texts, source_markdown, text_layer_documents, bundle_names, result_artifacts, latest_records, run_summary, canonical_json)
}

_RICH = f"""{_BLOCKS}, rich AS (SELECT doc, page, ord, level, doc + ord AS k, CASE WHEN (doc + ord) % 13 = 0 THEN 'PageHeader' WHEN (doc + ord) % 17 = 0 THEN 'PageFooter' WHEN (doc + ord) % 19 = 0 THEN 'Code' WHEN (doc + ord) % 23 = 0 THEN 'Equation' WHEN (doc + ord) % 29 = 0 THEN 'MarginalNote' WHEN (doc + ord) % 31 = 0 THEN 'PageNumber' ELSE type END AS type,
  CASE WHEN (doc + ord) % 19 = 0 THEN 'a ```` b' WHEN (doc + ord) % 31 = 0 THEN CAST((doc + ord) % 400 AS VARCHAR) WHEN (doc + ord) % 11 = 0 THEN '{{12}}' WHEN (doc + ord) % 7 = 0 THEN '3. ' || text WHEN (doc + ord) % 37 = 0 THEN ' ' ELSE text END AS text FROM blocks)"""
_ZONES = f"""{_RICH}, z AS (SELECT *, trim(text) AS t, CASE type WHEN 'PageHeader' THEN 0 WHEN 'PageFooter' THEN 1 WHEN 'Footnote' THEN 3 ELSE 2 END AS zone, CASE WHEN type = 'Footnote' AND k % 2 = 0 THEN CAST(k % 3 AS VARCHAR) END AS marker FROM rich),
m AS (SELECT *, CASE type WHEN 'PageHeader' THEN '<!-- PageHeader: ' || t || ' -->' WHEN 'PageFooter' THEN '<!-- PageFooter: ' || t || ' -->' WHEN 'Footnote' THEN CASE WHEN marker IS NOT NULL THEN '<sup>' || marker || '</sup> ' || t ELSE '**Footnote** ' || t END
  WHEN 'SectionHeader' THEN repeat('#', coalesce(level, 2)) || ' ' || t WHEN 'Code' THEN repeat('`', CASE WHEN contains(t, '````') THEN 5 ELSE 3 END) || chr(10) || t || chr(10) || repeat('`', CASE WHEN contains(t, '````') THEN 5 ELSE 3 END) WHEN 'Equation' THEN '$$' || chr(10) || t || chr(10) || '$$'
  WHEN 'Caption' THEN '*' || t || '*' WHEN 'Quote' THEN '> ' || replace(t, chr(10), chr(10) || '> ') WHEN 'ListItem' THEN CASE WHEN starts_with(t, '3.') THEN '3\\.' || substr(t, 3) ELSE '- ' || t END WHEN 'MarginalNote' THEN t ELSE CASE WHEN t = '{{12}}' THEN '\\{{12\\}}' ELSE t END END AS md FROM z WHERE t <> '' AND type <> 'PageNumber')"""
_SMALL_TREE = """c AS (SELECT c_nationkey, {leaf} AS made, c_custkey FROM customer), cc AS (SELECT c_nationkey, string_agg(made, '{join}' ORDER BY c_custkey) AS inner_ FROM c GROUP BY 1), n AS (SELECT n_regionkey, n_nationkey, {mid} AS made FROM nation LEFT JOIN cc ON c_nationkey = n_nationkey), nn AS (SELECT n_regionkey, string_agg(made, '{join}' ORDER BY n_nationkey) AS inner_ FROM n GROUP BY 1)
SELECT 'r' || r_regionkey AS id, md5({top}) AS md5 FROM region LEFT JOIN nn ON n_regionkey = r_regionkey"""
ORACLES = {
    "scholarly_documents": f"""{_ZONES}, o AS (SELECT *, row_number() OVER (PARTITION BY doc, page, zone, CASE WHEN zone = 3 THEN coalesce(marker, regexp_replace(t, '\\s+', ' ', 'g')) ELSE CAST(ord AS VARCHAR) END ORDER BY ord) AS once FROM m),
b AS (SELECT doc, page, string_agg(md, chr(10) || chr(10) ORDER BY zone, ord) AS body FROM o WHERE once = 1 GROUP BY ALL), num AS (SELECT doc, page, arg_min(text, ord) AS seen FROM rich WHERE type = 'PageNumber' GROUP BY ALL),
p AS (SELECT conv_id AS doc, CAST(turn AS INTEGER) AS page, CASE WHEN turn % 2 = 0 THEN CAST(turn + 100 AS VARCHAR) END AS printed FROM conversations),
w AS (SELECT p.doc, p.page, chr(10) || '{{' || p.page || '}}' || chr(10) || chr(10) || '---' || coalesce(chr(10) || '<!-- Page: ' || coalesce(printed, seen) || ' -->', '') || coalesce(chr(10) || chr(10) || body, '') AS md FROM p LEFT JOIN b ON b.doc = p.doc AND b.page = p.page LEFT JOIN num ON num.doc = p.doc AND num.page = p.page),
d AS (SELECT doc, string_agg(md, chr(10) || chr(10) || chr(10) ORDER BY page) || chr(10) || chr(10) || chr(10) || '{{' || (max(page) + 1) || '}}' || chr(10) || chr(10) || '---' || chr(10) AS t FROM w GROUP BY doc) SELECT doc, md5(t) AS md5, CAST(length(t) AS INTEGER) AS size FROM d""",
    "html_tree": "WITH " + _SMALL_TREE.format(join="", leaf="""'<p id="c' || c_custkey || '">' || c_name || '</p>'""", mid="""'<div id="n' || n_nationkey || '">' || n_name || ' &lt;&amp;&gt; "x"' || coalesce(inner_, '') || '</div>'""", top="""'<section id="r' || r_regionkey || '">' || r_name || coalesce(inner_, '') || '</section>'"""),
    "json_tree": "WITH " + _SMALL_TREE.format(
        join=",", leaf="""'{"id":"c' || c_custkey || '","block_type":"p","text":"' || c_name || '","children":[]}'""", mid="""'{"id":"n' || n_nationkey || '","block_type":"div","text":"' || n_name || ' <&> \\"x\\"","children":[' || coalesce(inner_, '') || ']}'""",
        top="""'{"id":"r' || r_regionkey || '","block_type":"section","text":"' || r_name || '","children":[' || coalesce(inner_, '') || ']}'""",
    ),
    "ocr_json": f"""{_BLOCKS}, l AS (SELECT doc, page, string_agg('{{"text":"' || regexp_replace(text, '[^A-Za-z ]', '', 'g') || '","bbox":[' || CAST(x0 AS BIGINT) || ',' || CAST(y0 AS BIGINT) || ']}}', ',' ORDER BY ord) AS ls FROM blocks GROUP BY ALL)
SELECT doc, md5('{{"pages":[' || string_agg('{{"page":' || page || ',"lines":[' || ls || ']}}', ',' ORDER BY page) || ']}}') AS md5 FROM l GROUP BY doc""",
    "body_texts": f"{_RICH} SELECT doc, md5(string_agg(trim(text), chr(10) || chr(10) ORDER BY page, ord)) AS md5 FROM rich WHERE type IN ({', '.join(repr(t) for t in ops.BODY)}) AND trim(text) <> '' GROUP BY doc",
    "source_markdown": f"""{_BLOCKS}, r AS (SELECT doc, CAST(ord AS BIGINT) AS place, type = 'Footnote' AS last, CASE type WHEN 'Footnote' THEN '[^' || id || ']: ' || text WHEN 'SectionHeader' THEN '# ' || text WHEN 'Caption' THEN '*' || text || '*' WHEN 'Quote' THEN '> ' || replace(text, chr(10), chr(10) || '> ') WHEN 'ListItem' THEN '- ' || text ELSE text END AS md FROM blocks
UNION ALL SELECT conv_id, turn * 1000 - 1, false, '<!-- Page: ' || turn || ' -->' FROM conversations) SELECT doc, md5(string_agg(md, chr(10) || chr(10) ORDER BY last, place, md)) AS md5 FROM r GROUP BY doc""",
    "text_layer_documents": r"""WITH cut AS (SELECT doc_id, string_split(regexp_replace(text, '([A-Za-z]{3})([a-z]{3,}) ', '\1-' || chr(10) || '\2 ', 'g'), chr(10)) AS ls FROM documents), l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS n FROM cut),
c AS (SELECT doc_id, n, trim(regexp_replace(regexp_replace(replace(replace(nfc_normalize(line), chr(65533), ''), chr(8203), ''), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', ' ', 'g'), '[\s\x0b\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g')) AS line FROM l),
j AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY n) AS t, sum(length(replace(line, ' ', ''))) AS v FROM c WHERE line <> '' GROUP BY doc_id) SELECT doc_id, md5(regexp_replace(t, '([A-Za-z]{2,})-\n([a-z][A-Za-z]{1,})', '\1\2', 'g')) AS md5, v < 24 AS sparse FROM j""",
    "bundle_names": "SELECT '../' || p_name || '/' || p_partkey || '.pdf' AS source, regexp_replace(p_name, '[^A-Za-z0-9._-]+', '_', 'g') || '_' || p_partkey || ['.md', '.html', '.middle.json'][p_partkey % 3 + 1] AS name FROM part",
    "result_artifacts": "SELECT doc_id, 'markdown' AS kind, CAST(strlen(text) AS INTEGER) AS bytes, sha256(text) AS sha256 FROM documents UNION ALL SELECT doc_id, 'html', CAST(strlen(lang) AS INTEGER), sha256(lang) FROM documents WHERE doc_id % 3 = 0",
    "latest_records": "WITH r AS (SELECT user_id AS source, ['submitted', 'completed', 'failed', 'skipped'][event_id % 4 + 1] AS status, event_id % 50 AS moment, [1, 4, 3, 2][event_id % 4 + 1] AS k FROM events) SELECT source, arg_max(status, (moment, k)) AS status, count(*) AS records FROM r GROUP BY source",
    "run_summary": """WITH r AS (SELECT event_type, event_id % 4 AS s, event_id % 9 AS pages, event_id % 5 + 1 AS seconds FROM events) SELECT event_type, count(*) AS sources, count(*) FILTER (s = 1) AS completed, count(*) FILTER (s = 2) AS failed, CAST(coalesce(sum(pages) FILTER (s = 1), 0) AS BIGINT) AS pages,
  round(sum(pages) FILTER (s = 1) / sum(seconds) FILTER (s = 1), 6) AS pages_a_second FROM r GROUP BY event_type""",
    "canonical_json": """SELECT p_partkey, '{' || CASE WHEN p_partkey % 3 > 0 THEN '"brand":"' || p_brand || '",' ELSE '' END || '"size":"' || p_size || '","type":"' || p_type || '"}' AS json FROM part""",
}
