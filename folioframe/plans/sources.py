"""Readers on files that are made from the tables: packages, office files, images, recognition outputs, folders."""

from __future__ import annotations

import io
import uuid
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.trees import shared_folder
from ..sources import fragments, layout_json, navigation, office, package_writer, packages, storage, tools
from .base import read


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("path"), F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("r"))


def file_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 8
    pick = lambda *values: F.element_at(F.array(*values), (k + 1).cast("int"))
    content = pick(F.lit("%PDF-1.7").cast("binary"), F.unhex(F.lit("89504E470D0A1A0A")), F.unhex(F.lit("FFD8FFE0")), F.unhex(F.lit("504B0304")), F.lit(" <!DOCTYPE HTML>").cast("binary"), F.lit("<?xml?><TEI xmlns='x'>").cast("binary"), F.lit("text").cast("binary"), F.lit("text").cast("binary"))
    name = pick(F.lit("a.html"), F.lit("b"), F.lit("c.png"), F.lit("d.epub"), F.lit("e.pdf"), F.lit("f.xml"), F.lit("g.HTM"), F.lit("h.unknown"))
    return read(spark, sf_dir, "part").select("p_partkey", storage.file_kind(content, name).alias("kind"))


def tei_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nation as a text of two divisions with a page break, a note in the margin, an item and a reference."""
    xml = F.concat(
        F.lit('<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader/><text><body><div type="chapter" xml:id="c1"><pb n="'), "k", F.lit('"/><head>'), "name", F.lit('</head><p>one <ref target="#c2">two</ref></p><note place="margin">m</note></div><div xml:id="c2"><list><item>'), "r", F.lit("</item></list>"),
        F.when(F.col("k") % 5 == 0, "<oops>").otherwise(""), F.lit("</div></body></text></TEI>"),
    )
    files = _nations(spark, sf_dir).select("path", xml.cast("binary").alias("content"))
    return packages.package_rows(files, packages.read_tei)


def tei_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    header = F.when(F.col("k") % 3 == 0, F.concat("name", F.lit(" Deutsches Textarchiv"))).when(F.col("k") % 3 == 1, "the Text Creation Partnership").otherwise(F.col("name"))
    return _nations(spark, sf_dir).select("k", packages.tei_profile_of(header).alias("profile"))


def _zipped(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        for name, text in parts.items():
            book.writestr(name, text)
    return out.getvalue()


def _files(make):
    """A column of files from (number, name, region) by `make`."""

    @F.pandas_udf(T.BinaryType())
    def made(k: pd.Series, name: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series([make(int(a), b, int(c)) for a, b, c in zip(k, name, r, strict=True)], dtype=object)

    return made("k", "name", "r")


def _epub(k: int, name: str, r: int) -> bytes:
    parts = {
        "META-INF/container.xml": '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></container>',
        "o/p.opf": '<package xmlns="http://www.idpf.org/2007/opf"><manifest><item id="a" href="a.xhtml"/><item id="b" href="b.xhtml"/></manifest><spine><itemref idref="b"/><itemref idref="a"/></spine></package>',
        "o/a.xhtml": f"<html><body><h2>{name}</h2><p>see <a href='b.xhtml#t'>there</a></p></body></html>",
        "o/b.xhtml": f"<html><body><h1 id='t'>Region {r}</h1><p>text</p></body></html>",
    }
    return _zipped(parts | ({"../escape": "x"} if k % 7 == 0 else {}))


def epub_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nation as a book of two chapters, the second file first; every seventh archive has an unsafe path."""
    files = _nations(spark, sf_dir).select("path", _files(_epub).alias("content"))
    return packages.package_rows(files, packages.read_epub)


def tei_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a TEI text: a division a text, its lines paragraphs, with a page break after each third word of every fourth line."""
    line = lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "&", "&amp;"), "<", "&lt;"), r"[\x00-\x08\x0b-\x1f\ufffe\uffff]", "")
    broken = lambda x: F.regexp_replace(x, r"((?:\S+\s+){3})", '$1<pb n="p"/>')
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.lit("<p>"), F.when(i % 4 == 3, broken(line(x))).otherwise(line(x)), F.lit("</p>")))
    xml = F.concat(F.lit("<TEI><teiHeader><p>no</p></teiHeader><text><body><div>"), F.array_join(lines, "\n"), F.lit("</div></body></text></TEI>"))
    files = read(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("path"), xml.cast("binary").alias("content"))
    found = fragments.fragments(files)
    return found.groupBy("doc").agg(F.count("*").alias("pieces"), F.max("page").alias("pages"), F.count_distinct("block").alias("blocks"), F.max("end").alias("size"), F.sum(F.length("text")).alias("chars"))


def written_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as packages, a component a role: written twice to the shared folder, and read again by their manifests."""
    turns = read(spark, sf_dir, "conversations").select(F.concat(F.lit("c"), "conv_id").alias("package"), F.concat("role", F.lit(".jsonl")).alias("component"), F.col("turn").alias("ord"), F.to_json(F.struct("turn", "text")).alias("line"))
    folder = f"{shared_folder(spark)}/packages-{uuid.uuid4().hex}"
    for _ in range(2):
        package_writer.write_packages(turns, folder)
    return package_writer.package_components(spark, folder).select("package", "component", "bytes", "records")


def _navigated(k: int, name: str, r: int) -> bytes:
    """A book of two chapters with an NCX, lists of an EPUB 3 and a guide; some entries lead nowhere."""
    point = lambda i, label, src, below="": f'<navPoint id="n{i}"><navLabel><text>{label}</text></navLabel><content src="{src}"/>{below}</navPoint>'
    ops = 'xmlns:epub="http://www.idpf.org/2007/ops"'
    return _zipped({
        "META-INF/container.xml": '<container><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></container>',
        "o/p.opf": '<package><manifest><item id="a" href="a.xhtml"/><item id="b" href="t/b.xhtml"/><item id="x" href="toc.ncx"/><item id="v" href="nav.xhtml" properties="nav"/></manifest><spine toc="x"><itemref idref="a"/><itemref idref="b"/></spine><guide><reference type="cover" href="a.xhtml"/></guide></package>',
        "o/toc.ncx": f'<ncx><navMap>{point(1, name, "a.xhtml", point(2, "part", "t/b.xhtml#s"))}{point(3, "lost", "gone.xhtml")}</navMap><pageList><pageTarget><navLabel><text>{k}</text></navLabel><content src="t/b.xhtml#s"/></pageTarget></pageList></ncx>',
        "o/nav.xhtml": f'<html {ops}><body><nav epub:type="toc"><ol><li><a href="a.xhtml">{name}</a><ol><li><span>no link</span></li><li><a href="t/b.xhtml#s">in <b>b</b></a></li></ol></li></ol></nav></body></html>',
        "o/a.xhtml": f"<html><body><h1>{name}</h1><p>one</p><h2>two</h2></body></html>",
        "o/t/b.xhtml": f"<html><body><h2>Region {r}</h2><p id='s'>text</p></body></html>",
    })


def epub_navigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _nations(spark, sf_dir).select("path", _files(_navigated).alias("content"))
    return navigation.navigation(files).select("doc", "nav", "kind", "source", "ord", "parent", "depth", "label", "block")


def _xlsx(k: int, name: str, r: int) -> bytes:
    if k % 6 == 0:
        return b"no workbook"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    cells = f'<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1"/><c r="C1"><v>{k}</v></c></row><row r="2"><c r="A2" t="inlineStr"><is><t>x</t></is></c><c r="AB2"><v>{r}</v></c></row>'
    return _zipped({
        "xl/workbook.xml": f'<workbook xmlns:r="{rel}"><sheets><sheet name="S{k}" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="rId1" Target="worksheets/s.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst><si><r><t>{name[:2]}</t></r><r><t>{name[2:]}</t></r></si></sst>",
        "xl/worksheets/s.xml": f'<worksheet><sheetData>{cells}</sheetData><mergeCells><mergeCell ref="A1:B1"/></mergeCells></worksheet>',
    })


def workbook_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nation as a workbook with a merged range and shared, inline and plain values; every sixth file is none."""
    files = _nations(spark, sf_dir).select("path", _files(_xlsx).alias("content"))
    return office.office_rows(files, office.read_xlsx, office.CELL)


def unreadable_workbooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _nations(spark, sf_dir).select("path", _files(_xlsx).alias("content"))
    return office.unreadable(files, office.office_rows(files, office.read_xlsx, office.CELL))


def _docx(k: int, name: str, r: int) -> bytes:
    p = lambda text, props="": f"<w:p><w:pPr>{props}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>"
    cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
    body = p(name, f'<w:pStyle w:val="Heading{r + 1}"/>') + p("") + p("text") + '<w:p><w:r><w:br w:type="page"/><w:t>next</w:t></w:r></w:p>' + p("item", "<w:numPr/>") + f"<w:tbl><w:tr>{cell('a')}{cell(str(k))}</w:tr><w:tr>{cell('b')}{cell('c')}</w:tr></w:tbl>"
    return _zipped({"word/document.xml": f'<w:document xmlns:w="urn:w"><w:body>{body}</w:body></w:document>'})


def text_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _nations(spark, sf_dir).select("path", _files(_docx).alias("content"))
    return office.office_rows(files, office.read_docx, office.BLOCK)


def _pptx(k: int, name: str, r: int) -> bytes:
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    text = lambda t: f"<a:p><a:r><a:t>{t}</a:t></a:r></a:p>"
    shape = lambda t, ph="": f"<p:sp><p:nvPr>{ph}</p:nvPr><p:txBody>{text(t)}</p:txBody></p:sp>"
    tree = shape(name, '<p:ph type="title"/>') + f"<p:grpSp>{shape(f'in {k}')}</p:grpSp>" + '<p:pic><p:cNvPr name="n" descr="picture"/></p:pic>' + f"<p:graphicFrame><a:tbl><a:tr><a:tc>{text('a')}</a:tc><a:tc>{text('b')}</a:tc></a:tr></a:tbl></p:graphicFrame>"
    head = 'xmlns:a="urn:a" xmlns:p="urn:p"'
    return _zipped({
        "ppt/presentation.xml": f'<p:presentation xmlns:p="urn:p" xmlns:r="{rel}"><p:sldIdLst><p:sldId r:id="rId2"/><p:sldId r:id="rId1"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": '<Relationships><Relationship Id="rId1" Target="slides/one.xml"/><Relationship Id="rId2" Target="slides/two.xml"/></Relationships>',
        "ppt/slides/one.xml": f"<p:sld {head}><p:spTree>{shape(f'last {r}')}</p:spTree></p:sld>", "ppt/slides/two.xml": f"<p:sld {head}><p:spTree>{tree}</p:spTree></p:sld>",
    })


def slide_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _nations(spark, sf_dir).select("path", _files(_pptx).alias("content"))
    return office.office_rows(files, office.read_pptx, office.BLOCK)


def image_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First bytes of images of as many kinds; the fourth is none."""
    k, w = F.col("p_partkey") % 4, F.col("p_size") + 256
    wide = lambda n: F.lpad(F.hex(w.cast("long")), n, "0")
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), wide(8), F.lit("00000100"))
    gif = F.concat(F.lit("474946383961"), F.substring(wide(4), 3, 2), F.substring(wide(4), 1, 2), F.lit("0001"))
    jpeg = F.concat(F.lit("FFD8FFE000040000FFC0001108"), F.lit("0100"), wide(4), F.lit("03"))
    content = F.unhex(F.when(k == 0, png).when(k == 1, gif).when(k == 2, jpeg).otherwise(F.lit("0011")))
    return read(spark, sf_dir, "part").select("p_partkey", office.image_size(content).alias("s")).select("p_partkey", "s.width", "s.height")


def scanned_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The web pages' paths as a list of names, with comments and empty lines: which of them name a page in English."""
    path = F.regexp_extract("url", r"^[^:]*://[^/]*/?([^?#]*)", 1)
    pages = read(spark, sf_dir, "pages").select("page_id", path.alias("name"))
    manifest = pages.select(F.when(F.col("page_id") % 10 == 0, F.concat(F.lit("# "), "name")).when(F.col("page_id") % 10 == 1, " ").otherwise(F.concat(F.lit(" "), "name")).alias("line"))
    there, gone = office.listed(manifest, pages.where("startswith(name, 'en/')").select("name").distinct())
    return there.select("name", F.lit(True).alias("found")).unionByName(gone.select("name", F.lit(False).alias("found")))


def hocr_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.concat(F.lit('<div class="ocr_page"><span class="ocr_line" title="bbox '), "p_size", F.lit(' 2 30 4; x_wconf 9"><b>'), "p_brand", F.lit('</b>  <i>x</i></span><p>no</p><span class="ocr_line">bare</span></div>'))
    rows = read(spark, sf_dir, "part").select("p_partkey", F.posexplode(layout_json.hocr_lines(html)).alias("n", "l"))
    return rows.select("p_partkey", "n", "l.text", F.try_element_at("l.bbox", F.lit(1)).alias("x0"), F.try_element_at("l.bbox", F.lit(4)).alias("y1"))


def content_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit('[{"type":"text","text":"'), "p_brand", F.lit('","text_level":2,"page_idx":0,"bbox":['), "p_size", F.lit(',1,9,5]},{"type":"text","text":"plain","page_idx":1},{"type":"table","table_body":"<table/>","page_idx":1},{"type":"equation","latex":"x^2","page_idx":2},{"type":"odd","text":"?","page_idx":2}'), F.when(F.col("p_partkey") % 7 > 0, "]").otherwise(""))
    return tools.content_list(read(spark, sf_dir, "part").select("p_partkey", text.alias("j")), "p_partkey", "j").select("p_partkey", "ord", "page", "type", "level", "text", "x0")


def labelled_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.concat(F.lit('<div data-bbox="1 2 '), "p_size", F.lit(' 9" data-label="heading"><h2>'), "p_brand", F.lit(' &amp; <i>x</i></h2></div>\n<div class="a" data-label="formula" data-bbox="x"><p>y</p></div><p>no chunk</p>'))
    return tools.labelled_chunks(read(spark, sf_dir, "part").select("p_partkey", html.alias("h")), ["p_partkey"], "h").select("p_partkey", "ord", "type", "text", "x1")


def xml_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    xml = F.concat(F.lit("<Page><Header><Line>"), "p_brand", F.lit('</Line></Header><Paragraph id="1"><Line n="1">one <hi>two</hi></Line><Line>'), "p_size", F.lit("</Line></Paragraph><MarginalNote><Line>m</Line></MarginalNote></Page>"))
    return tools.line_xml(read(spark, sf_dir, "part").select("p_partkey", xml.alias("x")), ["p_partkey"], "x")


def polygon_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit('{"rec_texts":["'), "p_brand", F.lit('","low"],"rec_scores":[0.75,0.125],"rec_polys":[[['), "p_size", F.lit(",2],[70,1],[71,9]],[[0,0],[1,1]]]}"))
    return tools.text_polygons(read(spark, sf_dir, "part").select("p_partkey", text.alias("j")), ["p_partkey"], "j", least=0.5)


def render_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaf = lambda i, html: F.concat(F.lit(f'{{"id":"{i}","block_type":"Text","html":"'), html, F.lit('","children":null}'))
    text = F.concat(F.lit('{"id":"d","block_type":"Document","children":[{"id":"p0","block_type":"Page","children":['), leaf("a", F.col("p_brand")), F.lit(","), leaf("b", F.col("p_size").cast("string")), F.lit(']},{"id":"p1","block_type":"Page","children":[]}]}'))
    rows = read(spark, sf_dir, "part").select("p_partkey", F.explode(tools.render_tree(text)).alias("n"))
    return rows.select("p_partkey", "n.*")


def recovered_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties as a model would answer with them: fenced, with words before, cut short or with a comma too many."""
    k = F.col("event_id") % 5
    cut = F.regexp_replace("props", r"\}$", "")
    text = F.when(k == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(k == 1, F.concat(F.lit("Here: "), "props", F.lit(" done"))).when(k == 2, F.concat(cut, F.lit(', "b": [1, 2,'))).when(k == 3, F.concat(cut, F.lit(",}"))).otherwise(F.lit("no json"))
    return read(spark, sf_dir, "events").select("event_id", tools.recovered_json(text).alias("json"))


QUERIES = {
    f.__name__: f
    for f in (
        file_kinds, tei_rows, tei_profiles, tei_fragments, epub_rows, epub_navigation, written_packages, workbook_cells, unreadable_workbooks, text_documents, slide_shapes, image_sizes, scanned_files, hocr_lines, content_lists, labelled_chunks, xml_lines, polygon_lines, render_trees, recovered_json,
    )
}


def _rows(template: str, rows: list[tuple], names: str) -> str:
    """One SELECT per row of literal SQL parts."""
    columns = names.split(", ")
    return " UNION ALL ".join("SELECT " + ", ".join(f"{v} AS {n}" for v, n in zip(row, columns, strict=True)) + f" FROM {template}" for row in rows)


_N = "(SELECT CAST(n_nationkey AS VARCHAR) AS doc, n_nationkey AS k, n_name AS name, n_regionkey AS r FROM nation)"
_PACKAGE = "doc, kind, ord, id, type, parent, target, text"
_BOOK = "doc, ord, page, type, level, text"
_P = "(SELECT p_partkey, p_brand AS brand, p_size AS size FROM part)"
ORACLES = {
    "file_kinds": "SELECT p_partkey, ['pdf', 'png', 'jpeg', 'epub', 'html', 'tei', 'html', 'pdf'][p_partkey % 8 + 1] AS kind FROM part",
    "tei_rows": _rows(
        _N + " WHERE k % 5 > 0",
        [
            ("doc", "'structure'", "0", "'s0'", "'body'", "CAST(NULL AS VARCHAR)", "CAST(NULL AS VARCHAR)", "''"), ("doc", "'structure'", "1", "'c1'", "'chapter'", "'s0'", "NULL", "''"), ("doc", "'anchor'", "0", "'a0'", "'page'", "'c1'", "NULL", "CAST(k AS VARCHAR)"), ("doc", "'block'", "0", "'b0'", "'SectionHeader'", "'c1'", "NULL", "name"),
            ("doc", "'block'", "1", "'b1'", "'Text'", "'c1'", "NULL", "'one two'"), ("doc", "'relation'", "0", "'r0'", "'ref'", "'b1'", "'#c2'", "'two'"), ("doc", "'block'", "2", "'b2'", "'MarginalNote'", "'c1'", "NULL", "'m'"), ("doc", "'structure'", "2", "'c2'", "'div'", "'s0'", "NULL", "''"), ("doc", "'block'", "3", "'b3'", "'ListItem'", "'c2'", "NULL", "CAST(r AS VARCHAR)"),
        ],
        _PACKAGE,
    ) + f" UNION ALL SELECT doc, 'refused', 0, 'ParseError', 'unreadable', NULL, NULL, '' FROM {_N} WHERE k % 5 = 0",
    "tei_profiles": "SELECT n_nationkey AS k, ['dta', 'tcp', 'generic'][n_nationkey % 3 + 1] AS profile FROM nation",
    "epub_rows": _rows(
        _N + " WHERE k % 7 > 0",
        [
            ("doc", "'structure'", "0", "'s0'", "'1'", "CAST(NULL AS VARCHAR)", "'b0'", "'Region ' || r"), ("doc", "'block'", "0", "'b0'", "'SectionHeader'", "'s0'", "CAST(NULL AS VARCHAR)", "'Region ' || r"), ("doc", "'block'", "1", "'b1'", "'Text'", "'s0'", "NULL", "'text'"),
            ("doc", "'structure'", "2", "'s2'", "'2'", "'s0'", "'b2'", "name"), ("doc", "'block'", "2", "'b2'", "'SectionHeader'", "'s2'", "NULL", "name"), ("doc", "'block'", "3", "'b3'", "'Text'", "'s2'", "NULL", "'see there'"), ("doc", "'relation'", "0", "'r0'", "'link'", "'b3'", "'b0'", "'o/b.xhtml#t'"),
        ],
        _PACKAGE,
    ) + f" UNION ALL SELECT doc, 'refused', 0, 'unsafe_path', 'unsafe_path', NULL, NULL, '' FROM {_N} WHERE k % 7 = 0",
    "workbook_cells": _rows(_N + " WHERE k % 6 > 0", [("doc", "'S' || k", "0", "0", "1", "2", "name"), ("doc", "'S' || k", "0", "2", "1", "1", "CAST(k AS VARCHAR)"), ("doc", "'S' || k", "1", "0", "1", "1", "'x'"), ("doc", "'S' || k", "1", "27", "1", "1", "CAST(r AS VARCHAR)")], "doc, sheet, row, col, rowspan, colspan, text"),
    "unreadable_workbooks": f"SELECT doc FROM {_N} WHERE k % 6 = 0",
    "text_documents": _rows(_N, [("doc", "0", "0", "'SectionHeader'", "r + 1", "name"), ("doc", "1", "0", "'Text'", "NULL", "'text'"), ("doc", "2", "1", "'Text'", "NULL", "'next'"), ("doc", "3", "1", "'ListItem'", "NULL", "'item'"), ("doc", "4", "1", "'Table'", "NULL", "'a' || chr(9) || k || chr(10) || 'b' || chr(9) || 'c'")], _BOOK),
    # words joined by single spaces; a break after each third word, while another follows in the line
    "tei_fragments": r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, i, list_filter(string_split_regex(regexp_replace(line, '[\x00-\x08\x0b-\x1f]', '', 'g'), '[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+'), lambda x: x <> '') AS ws, regexp_replace(line, '[\x00-\x08\x0b-\x1f]', '', 'g') AS line FROM l),
n AS (SELECT *, len(ws) AS n, CASE WHEN i % 4 = 3 THEN (len(ws) - CASE WHEN regexp_matches(line, '\s$') THEN 0 ELSE 1 END) // 3 ELSE 0 END AS breaks FROM w),
s AS (SELECT doc_id, greatest(1, CASE WHEN i % 4 = 3 AND n > 0 THEN CAST(ceil(n / 3) AS BIGINT) ELSE 1 END) AS pieces, breaks, i, CASE WHEN n > 0 THEN length(array_to_string(ws, ' ')) END AS size,
  CASE WHEN n > 0 THEN length(array_to_string(ws, ' ')) - CASE WHEN i % 4 = 3 THEN CAST(ceil(n / 3) AS BIGINT) - 1 ELSE 0 END END AS chars FROM n)
SELECT CAST(doc_id AS VARCHAR) AS doc, CAST(sum(pieces) AS BIGINT) AS pieces, CAST(sum(breaks) AS INTEGER) AS pages, count(*) AS blocks, CAST(coalesce(sum(size), 0) + greatest(0, count(size) - 1) AS INTEGER) AS size, CAST(coalesce(sum(chars), 0) AS BIGINT) AS chars FROM s GROUP BY doc_id""",
    "written_packages": """WITH l AS (SELECT 'c' || conv_id AS package, role || '.jsonl' AS component, strlen(text) + len(regexp_extract_all(text, '["\\\\\n\t\r]')) AS said, length(CAST(turn AS VARCHAR)) AS t FROM conversations)
SELECT package, component, CAST(sum(said + t + length('{"turn":,"text":""}') + 1) AS BIGINT) AS bytes, count(*) AS records FROM l GROUP BY ALL""",
    "epub_navigation": """WITH e(nav, kind, source, ord, parent, depth, label, block) AS (VALUES (0, 'toc', 'ncx', 0, NULL, 0, '*', 0), (0, 'toc', 'ncx', 1, 0, 1, 'part', 4), (0, 'toc', 'ncx', 2, NULL, 0, 'lost', NULL), (1, 'page_list', 'ncx', 0, NULL, 0, '#', 4),
  (2, 'toc', 'epub3_nav', 0, NULL, 0, '*', 0), (2, 'toc', 'epub3_nav', 1, 0, 1, 'no link', NULL), (2, 'toc', 'epub3_nav', 2, 0, 1, 'in b', 4), (3, 'landmarks', 'epub2_guide', 0, NULL, 0, 'cover', 0),
  (4, 'generated_toc', 'headings', 0, NULL, 0, '*', 0), (4, 'generated_toc', 'headings', 1, 0, 1, 'two', 2), (4, 'generated_toc', 'headings', 2, NULL, 0, 'r', 3))
SELECT CAST(n_nationkey AS VARCHAR) AS doc, nav, kind, source, ord, parent, depth, CASE label WHEN '*' THEN n_name WHEN '#' THEN CAST(n_nationkey AS VARCHAR) WHEN 'r' THEN 'Region ' || n_regionkey ELSE label END AS label, block FROM nation, e""",
    "slide_shapes": _rows(_N, [("doc", "0", "0", "'SectionHeader'", "1", "name"), ("doc", "1", "0", "'Text'", "NULL", "'in ' || k"), ("doc", "2", "0", "'Picture'", "NULL", "'picture'"), ("doc", "3", "0", "'Table'", "NULL", "'a' || chr(9) || 'b'"), ("doc", "4", "1", "'Text'", "NULL", "'last ' || r")], _BOOK),
    "image_sizes": "SELECT p_partkey, CASE WHEN p_partkey % 4 < 3 THEN p_size + 256 END AS width, CASE WHEN p_partkey % 4 < 3 THEN 256 END AS height FROM part",
    "scanned_files": r"SELECT DISTINCT name, starts_with(name, 'en/') AS found FROM (SELECT page_id, trim(coalesce(regexp_extract(url, '^[^:]*://[^/]*/?([^?#]*)', 1), '')) AS name FROM pages) WHERE page_id % 10 > 1 AND name <> '' AND NOT starts_with(name, '#')",
    "hocr_lines": _rows(_P, [("p_partkey", "0", "brand || ' x'", "CAST(size AS DOUBLE)", "4.0::DOUBLE"), ("p_partkey", "1", "'bare'", "NULL", "NULL")], "p_partkey, n, text, x0, y1"),
    "content_lists": _rows(
        _P + " WHERE p_partkey % 7 > 0",
        [("p_partkey", "0", "0", "'SectionHeader'", "2", "brand", "CAST(size AS DOUBLE)"), ("p_partkey", "1", "1", "'Text'", "NULL", "'plain'", "NULL"), ("p_partkey", "2", "1", "'Table'", "NULL", "'<table/>'", "NULL"), ("p_partkey", "3", "2", "'Equation'", "NULL", "'x^2'", "NULL"), ("p_partkey", "4", "2", "'ComplexRegion'", "NULL", "'?'", "NULL")],
        "p_partkey, ord, page, type, level, text, x0",
    ),
    "labelled_chunks": _rows(_P, [("p_partkey", "0", "'SectionHeader'", "brand || ' & x'", "CAST(size AS DOUBLE)"), ("p_partkey", "1", "'Equation'", "'y'", "NULL")], "p_partkey, ord, type, text, x1"),
    "xml_lines": _rows(_P, [("p_partkey", "0", "'PageHeader'", "0", "brand"), ("p_partkey", "1", "'Text'", "0", "'one two'"), ("p_partkey", "1", "'Text'", "1", "CAST(size AS VARCHAR)"), ("p_partkey", "2", "'MarginalNote'", "0", "'m'")], "p_partkey, part, type, line, text"),
    "polygon_lines": "SELECT p_partkey, 0 AS ord, p_brand AS text, CAST(least(p_size, 70) AS DOUBLE) AS x0, 1.0::DOUBLE AS y0, 71.0::DOUBLE AS x1, 9.0::DOUBLE AS y1, 0.75::DOUBLE AS confidence FROM part",
    "render_trees": _rows(_P, [("p_partkey", "'d'", "CAST(NULL AS VARCHAR)", "0", "0", "'Document'", "''"), ("p_partkey", "'p0'", "'d'", "1", "1", "'Page'", "''"), ("p_partkey", "'a'", "'p0'", "2", "2", "'Text'", "brand"), ("p_partkey", "'b'", "'p0'", "3", "2", "'Text'", "CAST(size AS VARCHAR)"), ("p_partkey", "'p1'", "'d'", "4", "1", "'Page'", "''")], "p_partkey, id, parent, place, depth, type, html"),
    "recovered_json": """WITH v AS (SELECT event_id, json_extract_string(props, '$.k') AS k FROM events) SELECT event_id, CASE event_id % 5 WHEN 2 THEN '{"b":[1,2],"k":' || k || '}' WHEN 4 THEN NULL ELSE '{"k":' || k || '}' END AS json FROM v""",
}
