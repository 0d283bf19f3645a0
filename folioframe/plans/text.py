"""Text quality, cleaning and markers, on the lines and texts of `documents`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators import furniture
from .base import LINES_SQL, lines_of, read


def text_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("reasons", fn.quality_reasons(F.col("text")))
    return docs.select("doc_id", F.when(F.size("reasons") == 0, "good").otherwise("bad").alias("status"), F.array_join("reasons", ",").alias("reasons"))


def bad_ocr_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return docs.select("doc_id", fn.alnum_ratio(F.col("text")).alias("alnum_ratio"), fn.looks_badly_read(F.col("text"), spaces=0.1, alnum=0.8).alias("bad"))


def page_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnose(lines_of(read(spark, sf_dir, "documents"))).select("doc_id", "line_idx", "visible", "reason", "accepted")


def diagnose(pages: DataFrame, text: str = "line", least: int = 24) -> DataFrame:
    """visible characters, reason (sparse_page, invalid_characters or null) and accepted, of each page text."""
    spoilt = fn.count_of(F.col(text), "�") + fn.count_of(F.col(text), fn.CONTROL)
    out = pages.withColumn("visible", fn.visible(F.col(text))).withColumn("spoilt", spoilt)
    out = out.withColumn("reason", F.when(F.col("visible") < least, "sparse_page").when(F.col("spoilt") > 0, "invalid_characters"))
    return out.withColumn("accepted", F.coalesce(F.col("reason") == "sparse_page", F.lit(True)))


def text_layer_recommendation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recommend(diagnose(lines_of(read(spark, sf_dir, "documents"), keep=("source",))), "source")


def recommend(pages: DataFrame, by: str, valid: float = 0.9, sparse: float = 0.25) -> DataFrame:
    """Whether a document's text layer should be read anew, from its diagnosed pages."""
    weighty = (F.col("visible") >= 24) | (F.col("spoilt") > 0)
    sums = pages.groupBy(by).agg(
        F.count("*").alias("pages"),
        F.count_if(weighty).alias("substantive"),
        F.count_if(weighty & F.col("accepted")).alias("valid"),
        F.count_if(F.col("reason") == "sparse_page").alias("sparse"),
    )
    share, thin = F.coalesce(F.col("valid") / F.nullif("substantive", F.lit(0)), F.lit(0.0)), F.col("sparse") / F.col("pages")
    reason = F.when(F.col("substantive") == 0, "no_substantive_text").when(share < valid, "low_valid_text_ratio").when(thin > sparse, "too_many_sparse_pages")
    return sums.select(by, "pages", "substantive", "valid", "sparse", reason.isNotNull().alias("read_anew"), reason.alias("reason"))


def hyphen_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cut every text after its fourth letter runs first, as no driver text is hyphenated."""
    cut = F.regexp_replace("text", r"([A-Za-z]{3})([a-z]{3,}) ", "$1-\n$2 ")
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(fn.repair_hyphens(cut).cast("binary")).alias("joined_md5"), F.regexp_count(cut, F.lit("-\n")).alias("hyphens"))


def typography_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.translate("text", "'.,", "’—•")
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(fn.fold_typography(marked).cast("binary")).alias("folded_md5"))


def markdown_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.regexp_replace("text", r"\n(\S)", "\n## $1")
    return read(spark, sf_dir, "documents").select("doc_id", *(F.length(fn.strip_markdown_noise(marked, n)).alias(f"length_{n}") for n in (1, 2, 3)))


def _first_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "source", F.split_part("text", F.lit("\n"), F.lit(1)).alias("first"))


def common_edge_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the pages of their source: whole first lines that recur."""
    return furniture.common_edges(_first_lines(spark, sf_dir), "source", ["doc_id"], "first")


def common_edge_lines_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First lines that are a common one of their source, or alike in over 90 %."""
    docs = _first_lines(spark, sf_dir)
    return furniture.near_common_edges(docs, furniture.common_edges(docs, "source", ["doc_id"], "first"), "source", "first").select("doc_id").distinct()


def common_page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as the edges of a document's pages: those that recur in it."""
    return furniture.common_edges(lines_of(read(spark, sf_dir, "documents")), "doc_id", ["line_idx"], "line")


def footnote_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The markers that open the lines of `documents`, given every kind of one by the line's number."""
    opened = F.concat(F.element_at(F.array(*(F.lit(x) for x in MARKS)), (F.pmod(F.col("doc_id") + F.col("line_idx"), F.lit(len(MARKS))) + 1).cast("int")), F.col("line"))
    found = lines_of(read(spark, sf_dir, "documents")).withColumn("m", fn.marker_of(opened))
    return found.where("m is not null").groupBy("m.style", "m.normalized").agg(F.count("*").alias("n"))


MARKS = ["<sup>3</sup> ", "③ ", "³ ", r"\( ^{3} \) ", "^3 ", "(3) ", "a) ", "3. ", "iv. ", "* ", "z. B. ", ""]


def superscript_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.regexp_replace("text", r"\. ", r"^{2}^\\( ^{4} \\)¹². ")
    return read(spark, sf_dir, "documents").select("doc_id", F.regexp_count(fn.superscript_calls(marked), F.lit("<sup>[0-9]+</sup>")).alias("calls"))


def roman_numerals(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbers = read(spark, sf_dir, "orders").select((F.col("o_orderkey") % 3999 + 1).cast("int").alias("n")).distinct()
    return numbers.select("n", fn.roman_text(F.col("n")).alias("roman"), fn.roman_value(fn.roman_text(F.col("n"))).alias("back"))


def chinese_numerals(spark: SparkSession, sf_dir: str) -> DataFrame:
    digits = "零一二三四五六七八九"
    numbers = read(spark, sf_dir, "orders").select((F.col("o_orderkey") % 9999 + 1).alias("n")).distinct()
    return numbers.select("n", fn.chinese_number(F.translate(F.col("n").cast("string"), "0123456789", digits)).alias("value"))


def repeated_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a whole text's halves are alike; texts under 200 characters have none."""
    t = fn.without(F.coalesce("text", F.lit("")), r"\s+")
    docs = read(spark, sf_dir, "documents").select("doc_id", t.alias("t")).withColumn("alike", fn.halves_alike("t"))
    return docs.select("doc_id", ((F.length("t") >= 200) & F.col("alike")).alias("repeated"))


def credential_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.concat(F.lit("https://u"), F.col("user_id"), F.lit(":pw@host/x?token="), F.col("event_id"), F.lit("&k=1"))
    return read(spark, sf_dir, "events").select("event_id", fn.redact_credentials(given).alias("safe"))


def cell_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.concat(F.col("p_name"), F.lit(r" . . . . . \text{about} 5\% "), F.col("p_brand"))
    return read(spark, sf_dir, "part").select("p_partkey", fn.cell_text(given).alias("cell"))


def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", fn.slug(F.col("p_type")).alias("slug"), F.sha2("p_type", 256).alias("sha256"))


def rtl_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.when(F.col("doc_id") % 3 == 0, F.translate("text", "aeiou", "אבגדה")).otherwise(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", fn.mostly_rtl(given).alias("rtl"))


def clean_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines_of(read(spark, sf_dir, "documents")).select("doc_id", fn.clean_line(F.col("line")).alias("line"))
    return found.where("line <> ''").groupBy("doc_id").agg(F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars"))


QUERIES = {f.__name__: f for f in (text_quality, bad_ocr_flags, page_diagnostics, text_layer_recommendation, hyphen_repair, typography_fold, markdown_noise, common_edge_lines, common_edge_lines_fuzzy, common_page_lines, footnote_markers, superscript_calls, roman_numerals, chinese_numerals, repeated_halves, credential_redaction, cell_texts, slugs, rtl_texts, clean_lines)}

_VISIBLE = r"length(regexp_replace(line, '[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]', '', 'g'))"
_CONTROL = r"'[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]'"
_DIAGNOSED = f"""{LINES_SQL}, seen AS (
  SELECT *, {_VISIBLE} AS visible, len(regexp_extract_all(line, chr(65533))) + len(regexp_extract_all(line, {_CONTROL})) AS spoilt FROM lines
), judged AS (
  SELECT *, CASE WHEN visible < 24 THEN 'sparse_page' WHEN spoilt > 0 THEN 'invalid_characters' END AS reason FROM seen
)"""
_EDGE = r"regexp_replace(regexp_replace(trim(replace(first, chr(10), '')), '^\d+\s*', ''), '\s*\d+$', '')"

_SPACES = r"[\s\x0b\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_SUP = fn.SUPERSCRIPTS
_MARK_LIST = ", ".join(f"'{m}'" for m in MARKS)
#: What the planted marks must give, by their place; the last two have none of their own.
_PLANTED = [("numeric", "3"), ("enclosed", "3"), *[("numeric", "3")] * 4, ("alpha", "a"), ("numeric", "3"), ("roman", "iv"), ("symbol", "*")]
_PLANTED_SQL = ", ".join(f"{{'style': '{s}', 'normalized': '{n}'}}" for s, n in _PLANTED)
_RINGS = ", ".join(f"{{'sign': '{c}', 'n': '{n}'}}" for c, n in fn.ENCLOSED.items())
_EDGES = f"""f AS (SELECT doc_id, source, split_part(text, chr(10), 1) AS first FROM documents),
e AS (SELECT *, {_EDGE} AS edge FROM f),
n AS (SELECT *, CASE WHEN edge = lag(edge) OVER w THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY source ORDER BY doc_id)),
r AS (SELECT *, sum(new) OVER (PARTITION BY source ORDER BY doc_id) AS run FROM n),
s AS (SELECT source, edge, run, count(*) AS n FROM r GROUP BY ALL),
t AS (SELECT source, count(*) AS pages FROM f GROUP BY source),
c AS (SELECT source, edge, CAST(sum(n) AS BIGINT) AS n, max(n) AS streak FROM s GROUP BY ALL),
common AS (SELECT source, edge, n, streak FROM c JOIN t USING (source) WHERE (n >= pages * 0.2 OR streak >= 3) AND n > 3)"""

ORACLES = {
    # planted marks must give what they are; a line of its own is told from its first word without patterns
    "footnote_markers": f"""WITH {LINES_SQL}, o AS (SELECT line, CAST((doc_id + line_idx) % {len(MARKS)} AS INTEGER) AS k FROM lines),
w AS (SELECT k, [{_PLANTED_SQL}][k + 1] AS planted, CASE WHEN k = {len(MARKS) - 1} THEN ltrim(line, ' ' || chr(9) || chr(13)) END AS t FROM o),
v AS (SELECT *, CASE WHEN strpos(translate(t, chr(9) || chr(13), '  '), ' ') > 0 THEN split_part(translate(t, chr(9) || chr(13), '  '), ' ', 1) END AS word, list_filter([{_RINGS}], lambda x: x.sign = t[1])[1].n AS ring FROM w),
x AS (SELECT *, CASE WHEN ends_with(word, '.') OR ends_with(word, ')') THEN left(word, length(word) - 1) ELSE word END AS core, length(t) - length(ltrim(t, '{_SUP}')) AS raised FROM v),
y AS (SELECT *, CASE WHEN starts_with(core, '(') AND ends_with(core, ')') THEN core[2:-2] WHEN starts_with(core, '(') AND ends_with(word, ')') THEN core[2:] END AS inner_core FROM x),
z AS (SELECT CASE WHEN planted IS NOT NULL THEN planted
                  WHEN ring IS NOT NULL THEN {{'style': 'enclosed', 'normalized': ring}}
                  WHEN raised > 0 THEN {{'style': 'numeric', 'normalized': CAST(CAST(translate(left(t, raised), '{_SUP}', '0123456789') AS INTEGER) AS VARCHAR)}}
                  WHEN length(inner_core) BETWEEN 1 AND 4 AND translate(inner_core, '0123456789', '') = '' THEN {{'style': 'numeric', 'normalized': CAST(CAST(inner_core AS INTEGER) AS VARCHAR)}}
                  WHEN length(core) BETWEEN 1 AND 4 AND translate(core, '0123456789', '') = '' THEN {{'style': 'numeric', 'normalized': CAST(CAST(core AS INTEGER) AS VARCHAR)}}
                  WHEN length(core) BETWEEN 1 AND 12 AND translate(lower(core), 'ivxlcdm', '') = '' THEN {{'style': 'roman', 'normalized': lower(core)}}
                  WHEN length(core) = 1 AND core <> word AND lower(core) BETWEEN 'a' AND 'z' THEN {{'style': 'alpha', 'normalized': lower(core)}}
                  WHEN length(core) > 0 AND translate(core, '*†‡§¶#', '') = '' THEN {{'style': 'symbol', 'normalized': core}} END AS m FROM y)
SELECT m.style AS style, m.normalized AS normalized, count(*) AS n FROM z WHERE m IS NOT NULL GROUP BY ALL""",
    "clean_lines": f"""WITH {LINES_SQL}, c AS (SELECT doc_id, trim(regexp_replace(regexp_replace(replace(replace(nfc_normalize(line), chr(65533), ''), chr(8203), ''), {_CONTROL}, ' ', 'g'), '{_SPACES}+', ' ', 'g')) AS line FROM lines)
SELECT doc_id, count(*) AS lines, CAST(sum(length(line)) AS BIGINT) AS chars FROM c WHERE line <> '' GROUP BY doc_id""",
    "text_quality": rf"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS t, greatest(1, length(coalesce(text, ''))) AS n, regexp_extract_all(coalesce(text, ''), '\S+') AS w FROM documents
), r AS (
  SELECT doc_id, list_filter([
    CASE WHEN trim(regexp_replace(t, '\s', '', 'g')) = '' THEN 'empty_text' END,
    CASE WHEN len(regexp_extract_all(t, {_CONTROL})) / n > 0.02 THEN 'control_characters' END,
    CASE WHEN len(regexp_extract_all(t, chr(65533))) / n > 0.01 THEN 'replacement_characters' END,
    CASE WHEN len(w) >= 8 AND len(list_distinct(w)) <= greatest(1, len(w) // 4) THEN 'repeated_text' END,
    CASE WHEN length(t) > 0 AND (length(t) - len(regexp_extract_all(t, '\p{{C}}')) + len(regexp_extract_all(t, '[\n\t]'))) / n < 0.95 THEN 'low_printable_ratio' END
  ], lambda x: x IS NOT NULL) AS reasons FROM t
)
SELECT doc_id, CASE WHEN len(reasons) = 0 THEN 'good' ELSE 'bad' END AS status, coalesce(array_to_string(reasons, ','), '') AS reasons FROM r""",
    "bad_ocr_flags": r"""
WITH t AS (
  SELECT doc_id, text AS t, regexp_replace(text, '[ \n]', '', 'g') AS solid,
         len(regexp_extract_all(text, '\s+')) AS gaps, length(regexp_replace(text, '\s+', '', 'g')) AS chars,
         len(regexp_extract_all(text, '\n+')) AS breaks, length(regexp_replace(text, '\n+', '', 'g')) AS rest
  FROM documents
), a AS (
  SELECT *, CASE WHEN solid = '' THEN 1.0 ELSE len(regexp_extract_all(solid, '[\p{L}\p{N}]')) / length(solid) END AS alnum_ratio FROM t
)
SELECT doc_id, CAST(alnum_ratio AS DOUBLE) AS alnum_ratio,
       t = '' OR gaps / (chars + gaps) > 0.1 OR breaks / (breaks + rest) > 0.6 OR alnum_ratio < 0.8 OR len(regexp_extract_all(t, chr(65533))) > greatest(6.0, length(t) * 0.03) AS bad
FROM a""",
    "page_diagnostics": f"WITH {_DIAGNOSED} SELECT doc_id, CAST(line_idx AS INTEGER) AS line_idx, CAST(visible AS INTEGER) AS visible, reason, coalesce(reason = 'sparse_page', true) AS accepted FROM judged",
    "text_layer_recommendation": f"""WITH {_DIAGNOSED}, sums AS (
  SELECT source, count(*) AS pages, count(*) FILTER (visible >= 24 OR spoilt > 0) AS substantive,
         count(*) FILTER ((visible >= 24 OR spoilt > 0) AND coalesce(reason = 'sparse_page', true)) AS valid, count(*) FILTER (reason = 'sparse_page') AS sparse
  FROM judged GROUP BY source
), told AS (
  SELECT *, CASE WHEN substantive = 0 THEN 'no_substantive_text' WHEN valid / substantive < 0.9 THEN 'low_valid_text_ratio' WHEN sparse / pages > 0.25 THEN 'too_many_sparse_pages' END AS reason FROM sums
)
SELECT source, pages, substantive, valid, sparse, reason IS NOT NULL AS read_anew, reason FROM told""",
    "hyphen_repair": r"""
WITH cut AS (SELECT doc_id, regexp_replace(text, '([A-Za-z]{3})([a-z]{3,}) ', '\1-' || chr(10) || '\2 ', 'g') AS t FROM documents)
SELECT doc_id, md5(regexp_replace(t, '([A-Za-z]{2,})-\n([a-z][A-Za-z]{1,})', '\1\2', 'g')) AS joined_md5, CAST(len(regexp_extract_all(t, '-\n')) AS INTEGER) AS hyphens FROM cut""",
    "typography_fold": "SELECT doc_id, md5(translate(translate(text, '''.,', '’—•'), '" + fn.FOLD_FROM + "', '" + fn.FOLD_TO.replace("'", "''") + "')) AS folded_md5 FROM documents",
    "markdown_noise": r"""
WITH m AS (SELECT doc_id, regexp_replace(text, '\n(\S)', chr(10) || '## \1', 'g') AS t FROM documents)
SELECT doc_id, CAST(length(regexp_replace(t, '(?m)^([ \t]*)[#]+[ \t]+', '\1', 'g')) AS INTEGER) AS length_1,
       CAST(length(regexp_replace(t, '(?m)^([ \t]*)[#*+\-]+[ \t]+', '\1', 'g')) AS INTEGER) AS length_2,
       CAST(length(regexp_replace(t, '(?m)^([ \t]*)[#*+\->|=_~]+[ \t]+', '\1', 'g')) AS INTEGER) AS length_3 FROM m""",
    "common_edge_lines": f"WITH {_EDGES} SELECT * FROM common",
    "common_page_lines": f"""WITH {LINES_SQL}, e AS (SELECT doc_id, line_idx, {_EDGE.replace("first", "line")} AS edge FROM lines),
n AS (SELECT *, CASE WHEN edge = lag(edge) OVER w THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY doc_id ORDER BY line_idx)), r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY line_idx) AS run FROM n),
s AS (SELECT doc_id, edge, run, count(*) AS n FROM r GROUP BY ALL), t AS (SELECT doc_id, count(*) AS pages FROM e GROUP BY 1), c AS (SELECT doc_id, edge, CAST(sum(n) AS BIGINT) AS n, max(n) AS streak FROM s GROUP BY ALL)
SELECT doc_id, edge, n, streak FROM c JOIN t USING (doc_id) WHERE (n >= pages * 0.2 OR streak >= 3) AND n > 3""",
    # the longest common subsequence, a row of its table for each sign of the common text
    "common_edge_lines_fuzzy": f"""WITH RECURSIVE {_EDGES}, p AS (SELECT DISTINCT e.edge AS a, c.edge AS b FROM e JOIN common c USING (source) WHERE length(e.edge) + length(c.edge) > 0),
l(a, b, j, row) AS (SELECT a, b, 0, list_transform(range(length(a) + 1), lambda i: 0) FROM p
  UNION ALL SELECT a, b, j + 1, list_transform(range(length(a) + 1), lambda i: list_max(list_transform(range(i + 1), lambda k: CASE WHEN k > 0 AND substr(a, k, 1) = substr(b, j + 1, 1) THEN row[k] + 1 ELSE row[k + 1] END))) FROM l WHERE j < length(b)),
alike AS (SELECT a, b FROM l WHERE j = length(b) AND 200.0 * list_max(row) / (length(a) + length(b)) > 90)
SELECT DISTINCT doc_id FROM e JOIN common c USING (source) JOIN alike ON alike.a = e.edge AND alike.b = c.edge""",
    "superscript_calls": r"""
WITH m AS (SELECT doc_id, regexp_replace(text, '\. ', '^{2}^\\( ^{4} \\)¹². ', 'g') AS t FROM documents),
a AS (SELECT doc_id, regexp_replace(t, '\\\(\s*\^\s*\{?([0-9]{1,4})\}?\s*\\\)', '<sup>\1</sup>', 'g') AS t FROM m),
b AS (SELECT doc_id, regexp_replace(regexp_replace(t, '\$\s*\^\s*\{?([0-9]{1,4})\}?\s*\$', '<sup>\1</sup>', 'g'), '\^([0-9]{1,4})\^', '<sup>\1</sup>', 'g') AS t FROM a),
c AS (SELECT doc_id, replace(replace(replace(t, '¹', '<sup>1</sup>'), '²', '<sup>2</sup>'), '</sup><sup>', '') AS t FROM b)
SELECT doc_id, CAST(len(regexp_extract_all(t, '<sup>[0-9]+</sup>')) AS INTEGER) AS calls FROM c""",
    "credential_redaction": "SELECT event_id, 'https://u' || user_id || ':***@host/x?token=***&k=1' AS safe FROM events",
    "cell_texts": "SELECT p_partkey, trim(regexp_replace(p_name || ' about 5% ' || p_brand, '\\s+', ' ', 'g')) AS cell FROM part",
    "slugs": "SELECT p_partkey, regexp_replace(regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, sha256(p_type) AS sha256 FROM part",
    "rtl_texts": r"""
WITH g AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN translate(text, 'aeiou', 'אבגדה') ELSE text END AS t FROM documents)
SELECT doc_id, len(regexp_extract_all(t, '[\x{590}-\x{8ff}\x{fb1d}-\x{fdff}\x{fe70}-\x{feff}]')) > 0.3 * len(regexp_extract_all(t, '\p{L}')) AS rtl FROM g""",
    "chinese_numerals": "SELECT DISTINCT o_orderkey % 9999 + 1 AS n, CAST(o_orderkey % 9999 + 1 AS INTEGER) AS value FROM orders",
    "roman_numerals": """
WITH n AS (SELECT DISTINCT CAST(o_orderkey % 3999 + 1 AS INTEGER) AS n FROM orders)
SELECT n, ['','m','mm','mmm'][n // 1000 + 1] || ['','c','cc','ccc','cd','d','dc','dcc','dccc','cm'][n // 100 % 10 + 1] || ['','x','xx','xxx','xl','l','lx','lxx','lxxx','xc'][n // 10 % 10 + 1] || ['','i','ii','iii','iv','v','vi','vii','viii','ix'][n % 10 + 1] AS roman, n AS back FROM n""",
}
