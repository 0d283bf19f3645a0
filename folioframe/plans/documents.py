"""Document trees: `pages` as HTML sources, `conversations` as documents whose turns are pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import documents as ops
from ..sources import html, storage
from .base import read

KINDS = ("SectionHeader", "Text", "ListItem", "Quote", "Caption", "Footnote", "Unknown")


def blocks_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence of a conversation is a block; type, level, box and confidence are made from its place."""
    parts = F.filter(F.split("text", r"(?<=\.) "), lambda t: F.length(t) > 0)
    rows = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").cast("int").alias("page"), F.posexplode(parts).alias("i", "text"))
    n = F.col("doc") * 7 + F.col("page") * 5 + F.col("i") * 3
    kind = F.element_at(F.array(*(F.lit(k) for k in KINDS)), (n % 7 + 1).cast("int"))
    out = rows.withColumn("ord", (F.col("page") * 1000 + F.col("i")).cast("int")).withColumn("type", kind)
    return out.select(
        "doc", "page", "ord", "type", "text",
        F.concat(F.lit("b"), F.when(n % 31 == 0, 0).otherwise(F.col("ord"))).alias("id"),
        F.when(F.col("type") == "SectionHeader", (n % 4 + 1).cast("int")).alias("level"),
        (n % 50).cast("double").alias("x0"), (F.col("i") * 10).cast("double").alias("y0"),
        (n % 50 + n % 9 * 10 - 5).cast("double").alias("x1"), (F.col("i") * 10 + n % 4).cast("double").alias("y1"),
        ((n % 13) / 11).alias("confidence"),
    )


def html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.blocks_of(read(spark, sf_dir, "pages"), "page_id")
    return found.groupBy("page_id", "type").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


def html_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First-level headings, links and list items of a page, counted in its markup."""
    count = lambda p: F.regexp_count("html", F.lit(p))
    return read(spark, sf_dir, "pages").select("page_id", count("(?i)<h1[ >]").alias("h1"), count("(?i)<a [^>]*href=").alias("links"), count("(?i)<li[ >]").alias("items"))


def html_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.blocks_of(read(spark, sf_dir, "pages"), "page_id").withColumn("id", F.concat(F.lit("b"), "ord"))
    return ops.chunks(found, "page_id").select("page_id", "id", "type", F.md5(F.col("html").cast("binary")).alias("html_md5"), F.array_join("sections", "/").alias("sections"))


def html_links_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    links = html.blocks_of(pages, "page_id").select("page_id", F.explode("links").alias("href"))
    anchors = pages.select(F.regexp_replace("url", "#.*$", "").alias("ref"), F.col("page_id").alias("anchor")).groupBy("ref").agg(F.min("anchor").alias("anchor"))
    found = ops.resolve_links(links, anchors)
    return found.groupBy("page_id").agg(F.count("*").alias("links"), F.count("target").alias("resolved"))


def section_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.section_path(blocks_of(spark, sf_dir), "doc").select("doc", "ord", "s1", "s2", "s3", "s4")


def section_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = blocks_of(spark, sf_dir)
    size = blocks.groupBy("doc").agg((F.max("ord") + 1).alias("end"))
    heads = blocks.where("type = 'SectionHeader'").select("doc", "ord", "level").join(size, "doc")
    return ops.section_ends(heads, "doc", "end").select("doc", "ord", "level", "section_end")


def table_of_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ops.table_of_contents(blocks_of(spark, sf_dir), "doc")
    return found.select("doc", F.size("entries").alias("entries"), F.array_join(F.transform("entries", lambda x: F.concat(x["level"], F.lit(" "), x["title"])), "|").alias("titles"))


def block_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.neighbours(blocks_of(spark, sf_dir).withColumn("id", F.col("ord")), "doc", ("Footnote", "Caption")).select("doc", "ord", "previous", "next")


def block_relabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame([("Quote", "Text", 0.5), ("ListItem", "Reference", 0.2)], "old string, new string, threshold double")
    return ops.relabel(blocks_of(spark, sf_dir), rules).groupBy("doc", "type").agg(F.count("*").alias("n"))


def canonical_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.element_at(F.array(*(F.lit(x) for x in ("heading", "table-of-contents", "page_header", "Text", "blob", "formula"))), (F.col("p_partkey") % 6 + 1).cast("int"))
    return read(spark, sf_dir, "part").select("p_partkey", ops.canonical_type(raw).alias("type"), ops.heading_level(F.when(F.col("p_size") % 3 > 0, F.col("p_size"))).cast("int").alias("level"))


def middle_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ops.summary(blocks_of(spark, sf_dir), "doc")
    return found.select("doc", "pages", "blocks", "chars", F.array_join(F.transform("types", lambda t: F.concat(t["type"], F.lit("="), t["n"])), ",").alias("types"))


def middle_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.issues(blocks_of(spark, sf_dir), "doc")


def dangling_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items whose part was withdrawn (keys divisible by 17)."""
    parts = read(spark, sf_dir, "part").where("p_partkey % 17 > 0")
    return ops.dangling(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), parts, "p_partkey", "l_partkey").groupBy("l_partkey").agg(F.count("*").alias("n"))


def resolved_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = blocks_of(spark, sf_dir).withColumn("marker", (F.col("ord") % 3).cast("string"))
    calls = blocks.where("type = 'Text'").select("doc", "page", "ord", "marker")
    return ops.resolve_notes(calls, blocks.where("type = 'Footnote'"), "doc").select("doc", "page", "ord", "note")


def join_pages_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = storage.join_pages(read(spark, sf_dir, "conversations"), "conv_id", "turn", "text")
    return found.select("conv_id", F.md5(F.col("markdown").cast("binary")).alias("md5"), F.length("markdown").alias("size"))


def anchored_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The joined pages cut at their anchors again."""
    joined = storage.join_pages(read(spark, sf_dir, "conversations"), "conv_id", "turn", "text")
    found = storage.anchored_pages(joined, "conv_id", "markdown")
    return found.select("conv_id", "pdf_page", F.length("body").alias("size"))


def page_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("page"), F.length("text").cast("long").alias("size"))
    return ops.page_slices(parts, "doc")


def page_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("page"), "text")
    return ops.page_chunks(pages, "doc", 3).select("doc", "chunk", "pages", F.md5(F.col("text").cast("binary")).alias("md5"))


def markdown_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ops.markdown(blocks_of(spark, sf_dir).withColumn("id", F.col("ord").cast("string")), "doc")
    return found.select("doc", F.md5(F.col("markdown").cast("binary")).alias("md5"), F.length("markdown").alias("size"))


def table_cells_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines as a table: number and part, the part across two columns where the tax is high."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("row"), "l_partkey", F.when(F.col("l_tax") > 0.05, 2).otherwise(1).alias("colspan"))
    cells = lines.select("l_orderkey", "row", F.posexplode(F.array(F.col("row").cast("string"), F.col("l_partkey").cast("string"))).alias("col", "text"), "colspan", F.lit(1).alias("rowspan"))
    cells = cells.withColumn("colspan", F.when(F.col("col") == 1, F.col("colspan")).otherwise(1)).dropDuplicates(["l_orderkey", "row", "col", "text", "colspan"])
    return ops.cells_to_html(cells, "l_orderkey").select("l_orderkey", F.length("html").alias("size"))


def quote_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks that share their right side, set in more or less."""
    return ops.quote_levels(blocks_of(spark, sf_dir).select("doc", "ord", "x0", F.lit(150.0).alias("x1")), "doc")


def list_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.list_levels(blocks_of(spark, sf_dir).where("type = 'ListItem'").select("doc", "ord", "x0"), "doc")


def storage_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of a conversation as spans: encoded if that pays, decoded again, and equal."""
    spans = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("turn", "text")))).alias("raw"))
    done = spans.withColumn("s", storage.stored("raw")).withColumn("back", storage.restored("s"))
    return done.select("conv_id", F.col("s.count").alias("spans"), F.col("s.data").isNotNull().alias("stored"), (F.coalesce("back", "raw") == F.col("raw")).alias("equal"))


def page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = F.concat(F.col("c_custkey") % 5, F.lit(","), F.col("c_custkey") % 7, F.lit("-"), F.col("c_custkey") % 7 + 3, F.lit(", 20"))
    return read(spark, sf_dir, "customer").select("c_custkey", F.array_join(storage.page_range(spec).cast("array<string>"), ",").alias("pages"))


def label_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label file for each nation: a page heading, and lines in ranges and steps."""
    nations = read(spark, sf_dir, "nation")
    lines = F.array(F.lit("# labels"), F.concat(F.lit("["), "n_name", F.lit("]")), F.concat(F.lit("Text 0-"), F.col("n_nationkey"), F.lit(",40-50/5")), F.lit("Picture IMG0"), F.concat(F.lit("["), "n_regionkey", F.lit("]  # next")), F.lit("ListItem 7"))
    rows = nations.select("n_nationkey", F.posexplode(lines).alias("no", "line"))
    found = storage.read_labels(rows, "n_nationkey", "no", "line")
    return found.select("n_nationkey", "page", "type", F.array_join(F.col("lines").cast("array<string>"), ",").alias("lines"))


def line_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte offsets of the nations' JSON lines, by key: a small file by its nature."""
    line = F.to_json(F.struct("n_nationkey", "n_name"))
    return storage.line_index(read(spark, sf_dir, "nation").select("n_nationkey", line.alias("line")), "n_nationkey", "line")


def content_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest document of each text that was met more than once."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("sha256"), F.col("lang").alias("config"), F.col("doc_id").alias("at"))
    again = docs.groupBy("sha256", "config").agg(F.count("*").alias("n")).where("n > 1")
    return ops.reusable(docs, again)


def raw_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's text from its blocks, a line each."""
    return ops.raw_texts(blocks_of(spark, sf_dir), ["doc", "page"]).select("doc", "page", F.md5(F.col("text").cast("binary")).alias("md5"))


def page_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.page_statistics(blocks_of(spark, sf_dir), "doc")


def heading_key_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as headings whose own or raw keys say a level, or whose label or number does, or nothing."""
    k, size = F.col("p_partkey") % 8, F.col("p_size").cast("string")
    attributes = F.when(k == 0, F.concat(F.lit('{"heading_level":"0","text_level":'), size, F.lit("}"))).when(k == 1, F.concat(F.lit('{"level":"'), size, F.lit('"}'))).when(k == 2, '{"raw_label":"Doc-Title"}').when(k == 3, '{"heading_level":"x","raw_block_type":"heading"}').otherwise("{}")
    raw = F.when(k == 4, '{"level":3,"label":"title"}').when(k == 5, F.concat(F.lit('{"block_label":"paragraph title","text_level":-'), size, F.lit("}")))
    text = F.when(k == 6, F.concat(F.lit(" 2."), F.col("p_size") % 9, F.lit(".1 "), F.col("p_name"))).otherwise(F.col("p_name"))
    rows = read(spark, sf_dir, "part").select("p_partkey", attributes.alias("attributes"), raw.alias("raw"), text.alias("text"))
    return ops.heading_levels(rows).select("p_partkey", "level", "level_source", "title_role")


QUERIES = {f.__name__: f for f in (heading_key_levels, html_blocks, html_headings, html_chunks, html_links_resolved, section_hierarchy, section_ends, table_of_contents, block_neighbours, block_relabel, canonical_types, middle_summary, middle_validate, dangling_relations, resolved_notes, join_pages_markdown, anchored_pages, page_slices, page_chunks, markdown_documents, table_cells_html, quote_levels, list_levels, storage_round_trip, page_ranges, label_files, line_index, content_reuse, raw_texts, page_statistics)}

_BLOCKS = r"""WITH parts AS (SELECT conv_id AS doc, CAST(turn AS INTEGER) AS page, list_filter(string_split(regexp_replace(text, '\. ', '.' || chr(1), 'g'), chr(1)), lambda x: length(x) > 0) AS p FROM conversations),
rows AS (SELECT doc, page, unnest(p) AS text, generate_subscripts(p, 1) - 1 AS i FROM parts), n AS (SELECT *, doc * 7 + page * 5 + i * 3 AS n, CAST(page * 1000 + i AS INTEGER) AS ord FROM rows),
blocks AS (
  SELECT doc, page, ord, ['SectionHeader', 'Text', 'ListItem', 'Quote', 'Caption', 'Footnote', 'Unknown'][n % 7 + 1] AS type, text, 'b' || CASE WHEN n % 31 = 0 THEN 0 ELSE ord END AS id, CASE WHEN n % 7 = 0 THEN CAST(n % 4 + 1 AS INTEGER) END AS level,
         n % 50 AS x0, i * 10 AS y0, n % 50 + n % 9 * 10 - 5 AS x1, i * 10 + n % 4 AS y1, (n % 13) / 11 AS confidence FROM n
)"""
_TYPES = ", ".join(f"'{t}'" for t in ops.TYPES)
_LAST = ", ".join(f"last_value(CASE WHEN level <= {k} THEN level END IGNORE NULLS) OVER w AS l{k}, last_value(CASE WHEN level <= {k} THEN id END IGNORE NULLS) OVER w AS i{k}" for k in range(1, 5))
ORACLES = {
    "heading_key_levels": """SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN least(6, p_size) WHEN 1 THEN least(6, p_size) WHEN 2 THEN 1 WHEN 4 THEN 3 WHEN 6 THEN 3 ELSE 2 END AS level,
  CASE p_partkey % 8 WHEN 0 THEN 'own' WHEN 1 THEN 'own' WHEN 2 THEN 'inferred' WHEN 4 THEN 'upstream' WHEN 6 THEN 'inferred' ELSE 'default' END AS level_source,
  CASE p_partkey % 8 WHEN 2 THEN 'doc_title' WHEN 3 THEN 'section_title' WHEN 4 THEN 'title' WHEN 5 THEN 'section_title' ELSE 'unknown' END AS title_role FROM part""",
    "html_headings": "SELECT page_id, CAST(len(regexp_extract_all(html, '(?i)<h1[ >]')) AS INTEGER) AS h1, CAST(len(regexp_extract_all(html, '(?i)<a [^>]*href=')) AS INTEGER) AS links, CAST(len(regexp_extract_all(html, '(?i)<li[ >]')) AS INTEGER) AS items FROM pages",
    "section_hierarchy": f"{_BLOCKS}, h AS (SELECT doc, ord, {_LAST} FROM blocks WINDOW w AS (PARTITION BY doc ORDER BY ord ROWS UNBOUNDED PRECEDING)) SELECT doc, ord, {', '.join(f'CASE WHEN l{k} = {k} THEN i{k} END AS s{k}' for k in range(1, 5))} FROM h",
    "section_ends": f"""{_BLOCKS}, e AS (SELECT doc, max(ord) + 1 AS e FROM blocks GROUP BY doc), h AS (SELECT doc, ord, level FROM blocks WHERE type = 'SectionHeader')
SELECT h.doc, h.ord, h.level, CAST(coalesce(min(k.ord), any_value(e.e)) AS INTEGER) AS section_end FROM h JOIN e ON e.doc = h.doc LEFT JOIN h k ON k.doc = h.doc AND k.ord > h.ord AND k.level <= h.level GROUP BY h.doc, h.ord, h.level""",
    "table_of_contents": f"{_BLOCKS} SELECT doc, CAST(count(*) AS INTEGER) AS entries, string_agg(level || ' ' || trim(text), '|' ORDER BY ord) AS titles FROM blocks WHERE type = 'SectionHeader' GROUP BY doc",
    "block_neighbours": f"{_BLOCKS} SELECT doc, ord, lag(ord) OVER w AS previous, lead(ord) OVER w AS next FROM blocks WHERE type NOT IN ('Footnote', 'Caption') WINDOW w AS (PARTITION BY doc ORDER BY page, ord)",
    "block_relabel": f"{_BLOCKS} SELECT doc, CASE WHEN type = 'Quote' AND confidence <= 0.5 THEN 'Text' WHEN type = 'ListItem' AND confidence <= 0.2 THEN 'Reference' ELSE type END AS type, count(*) AS n FROM blocks GROUP BY ALL",
    "canonical_types": "SELECT p_partkey, ['SectionHeader', 'TableOfContents', 'PageHeader', 'Text', 'ComplexRegion', 'Equation'][p_partkey % 6 + 1] AS type, CAST(greatest(1, least(6, CASE WHEN p_size % 3 > 0 THEN p_size ELSE 2 END)) AS INTEGER) AS level FROM part",
    "middle_summary": f"""{_BLOCKS}, t AS (SELECT doc, type, count(*) AS n FROM blocks GROUP BY ALL), s AS (SELECT doc, string_agg(type || '=' || n, ',' ORDER BY type) AS types FROM t GROUP BY doc)
SELECT doc, count(DISTINCT page) AS pages, count(*) AS blocks, CAST(sum(length(text)) AS BIGINT) AS chars, any_value(types) AS types FROM blocks JOIN s USING (doc) GROUP BY doc""",
    "middle_validate": f"""{_BLOCKS}, p AS (SELECT *, 'pages[' || page || '].blocks[' || ord || ']' AS path FROM blocks)
SELECT doc, 'error' AS severity, 'unknown_type' AS code, path FROM p WHERE type NOT IN ({_TYPES}) UNION ALL SELECT doc, 'error', 'bbox_reversed', path FROM p WHERE x1 < x0 OR y1 < y0 UNION ALL SELECT doc, 'warning', 'bbox_empty', path FROM p WHERE x1 = x0 OR y1 = y0
UNION ALL SELECT doc, 'warning', 'confidence_range', path FROM p WHERE confidence < 0 OR confidence > 1 UNION ALL SELECT doc, 'error', 'duplicate_id', id FROM p GROUP BY doc, id HAVING count(*) > 1""",
    "dangling_relations": "SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 17 > 0) GROUP BY 1",
    "resolved_notes": f"""{_BLOCKS}, f AS (SELECT doc, page, ord % 3 AS marker, min(ord) AS note FROM blocks WHERE type = 'Footnote' GROUP BY ALL)
SELECT b.doc, b.page, b.ord, f.note FROM blocks b LEFT JOIN f ON f.doc = b.doc AND f.page = b.page AND f.marker = b.ord % 3 WHERE b.type = 'Text'""",
    "join_pages_markdown": "WITH m AS (SELECT conv_id, string_agg('{' || turn || '}' || chr(10) || text, chr(10) || chr(10) ORDER BY turn, text) || chr(10) || chr(10) || '{' || (max(turn) + 1) || '}' AS md FROM conversations GROUP BY 1) SELECT conv_id, md5(md) AS md5, CAST(length(md) AS INTEGER) AS size FROM m",
    "anchored_pages": r"SELECT conv_id, CAST(turn AS INTEGER) AS pdf_page, CAST(length(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS INTEGER) AS size FROM conversations",
    "page_slices": "WITH s AS (SELECT conv_id AS doc, turn AS page, CAST(length(text) AS BIGINT) AS size, CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS e FROM conversations) SELECT doc, page, size, e AS \"end\", e - size AS start FROM s",
    "page_chunks": "WITH p AS (SELECT conv_id AS doc, turn, text, CAST((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 3 AS INTEGER) AS chunk FROM conversations) SELECT doc, chunk, CAST(count(*) AS INTEGER) AS pages, md5(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS md5 FROM p GROUP BY ALL",
    "markdown_documents": f"""{_BLOCKS}, m AS (SELECT doc, ord, CASE WHEN type = 'Footnote' THEN 1 ELSE 0 END AS zone, CASE type WHEN 'SectionHeader' THEN repeat('#', level) || ' ' || text WHEN 'ListItem' THEN '- ' || text WHEN 'Quote' THEN '> ' || text WHEN 'Caption' THEN '*' || text || '*' WHEN 'Footnote' THEN '**Footnote** ' || text ELSE text END AS md FROM blocks WHERE trim(text) <> ''),
o AS (SELECT *, row_number() OVER (PARTITION BY doc, zone, CASE WHEN zone = 1 THEN md ELSE CAST(ord AS VARCHAR) END ORDER BY ord) AS k FROM m), d AS (SELECT doc, string_agg(md, chr(10) || chr(10) ORDER BY zone, ord) AS t FROM o WHERE k = 1 GROUP BY doc) SELECT doc, md5(t) AS md5, CAST(length(t) AS INTEGER) AS size FROM d""",
    "storage_round_trip": """WITH j AS (SELECT conv_id, count(*) AS n, 1 + sum(strlen('{"turn":' || turn || ',"text":' || CAST(to_json(text) AS VARCHAR) || '}') + 1) AS raw FROM conversations GROUP BY 1)
SELECT conv_id, CASE WHEN n >= 4 AND raw >= 1024 THEN CAST(n AS INTEGER) END AS spans, n >= 4 AND raw >= 1024 AS stored, true AS equal FROM j""",
    "table_cells_html": """WITH l AS (SELECT l_orderkey, l_linenumber AS r, l_partkey, CASE WHEN l_tax > 0.05 THEN 2 ELSE 1 END AS s FROM lineitem), c AS (SELECT DISTINCT l_orderkey, r, 0 AS col, CAST(r AS VARCHAR) AS t, 1 AS s FROM l UNION SELECT DISTINCT l_orderkey, r, 1, CAST(l_partkey AS VARCHAR), s FROM l)
SELECT l_orderkey, CAST(15 + 9 * count(DISTINCT r) + sum(9 + length(t) + CASE WHEN s > 1 THEN 12 ELSE 0 END) AS INTEGER) AS size FROM c GROUP BY 1""",
    "quote_levels": f"""WITH RECURSIVE {_BLOCKS.removeprefix("WITH ")}, o AS (SELECT doc, ord, CAST(x0 AS DOUBLE) AS x0, row_number() OVER (PARTITION BY doc ORDER BY ord) AS k FROM blocks),
q(doc, k, ord, x0, lv) AS (SELECT doc, k, ord, x0, 0 FROM o WHERE k = 1 UNION ALL SELECT o.doc, o.k, o.ord, o.x0, CASE WHEN o.x0 - q.x0 > 0.1 * (150 - q.x0) THEN q.lv + 1 WHEN q.lv > 0 AND abs(o.x0 - q.x0) <= 0.01 * (150 - q.x0) THEN q.lv ELSE 0 END FROM q JOIN o ON o.doc = q.doc AND o.k = q.k + 1)
SELECT doc, ord, x0, 150.0::DOUBLE AS x1, lv AS quote_level FROM q""",
    "page_ranges": "WITH r AS (SELECT c_custkey, list_sort(list_distinct([c_custkey % 5, 20] || range(c_custkey % 7, c_custkey % 7 + 4))) AS l FROM customer) SELECT c_custkey, array_to_string(l, ',') AS pages FROM r",
    "label_files": "SELECT n_nationkey, n_name AS page, 'Text' AS type, array_to_string(range(0, n_nationkey + 1), ',') || ',40,45,50' AS lines FROM nation UNION ALL SELECT n_nationkey, n_name, 'Picture', '' FROM nation UNION ALL SELECT n_nationkey, CAST(n_regionkey AS VARCHAR), 'ListItem', '7' FROM nation",
    "line_index": """WITH l AS (SELECT n_nationkey, strlen('{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}') AS b FROM nation) SELECT n_nationkey, CAST(coalesce(sum(b + 1) OVER (ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset", CAST(b AS INTEGER) AS bytes FROM l""",
    "content_reuse": "SELECT sha256(text) AS sha256, lang AS config, max(doc_id) AS id FROM documents GROUP BY 1, 2 HAVING count(*) > 1",
    "raw_texts": f"{_BLOCKS} SELECT doc, page, md5(string_agg(text, chr(10) ORDER BY ord)) AS md5 FROM blocks GROUP BY doc, page",
    "page_statistics": f"{_BLOCKS}, c AS (SELECT doc, page, type, count(*) AS n, sum(length(text)) AS s FROM blocks GROUP BY ALL) SELECT doc, page, arg_min(type, (-n, type)) AS type, CAST(sum(n) AS BIGINT) AS blocks, CAST(sum(s) AS BIGINT) AS chars FROM c GROUP BY doc, page",
}
ORACLES = {k: v for k, v in ORACLES.items() if v}
