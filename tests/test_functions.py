"""Column functions and grouped operators on small cases worked out by hand or by brute force."""

import io
import json
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioframe.functions import text as fn
from folioframe.operators import documents, evaluation, numbering
from folioframe.sources import html, packages, storage


def values(spark, given, make):
    rows = spark.createDataFrame([(i, g) for i, g in enumerate(given)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(make(F.col("v"))).collect()]


def test_footnote_markers(spark):
    given = ["<sup>3</sup> x", "③ x", "³ x", r"\( ^{3} \) x", "^3 x", "(3) x", "a) x", "3. x", "iv. x", "* x", "z. B. x", "Anm. x", "", None]
    got = [m and (m["normalized"], m["style"]) for m in values(spark, given, fn.marker_of)]
    assert got == [("3", "numeric"), ("3", "enclosed"), ("3", "numeric"), ("3", "numeric"), ("3", "numeric"), ("3", "numeric"), ("a", "alpha"), ("3", "numeric"), ("iv", "roman"), ("*", "symbol"), None, None, None, None]


def test_numerals(spark):
    assert values(spark, ["xiv", "MCMXCIX", "iiii", "abc", None], fn.roman_value) == [14, 1999, 4, None, None]
    assert [fn.chinese_value(x) for x in ("三十二", "十", "一百零五", "一九八四", "x", "", None)] == [32, 10, 105, 1984, None, None, None]


def test_quality_reasons(spark):
    given = ["fine words all the way through here", "", "  \n", "a b " * 20, "x\x01" * 30, "ok" + "�" * 3]
    got = values(spark, given, fn.quality_reasons)
    assert got[0] == [] and got[1] == ["empty_text"] and got[2] == ["empty_text"] and got[3] == ["repeated_text"]
    assert "control_characters" in got[4] and "replacement_characters" in got[5]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        row, before = [i + 1], row
        for j, y in enumerate(b):
            row.append(min(row[j] + 1, before[j + 1] + 1, before[j] + (x != y)))
    return row[-1]


@settings(max_examples=60, deadline=None)
@given(st.text("abc", max_size=12), st.text("abc", max_size=12))
def test_distances(a, b):
    assert fn.sequence_distance(list(a), list(b)) == edits(a, b)
    common = max((k for k in range(len(a) + 1)), key=lambda k: k if any(True for _ in [0]) and k <= _lcs(a, b) else -1)
    assert fn._common_length(a, b) == common


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b):
            row[j + 1] = before[j] + 1 if x == y else max(before[j + 1], row[j])
    return row[-1]


def test_levenshtein_column(spark):
    rows = spark.createDataFrame([("kitten", "sitting"), ("", "abc"), ("flaw", "lawn")], "a string, b string")
    got = rows.select(F.levenshtein("a", "b").alias("d"), "a", "b").collect()
    assert all(r["d"] == edits(r["a"], r["b"]) for r in got)


def test_printed_pages(spark):
    def run(numbers):
        rows = spark.createDataFrame([("d", i, n) for i, n in enumerate(numbers)], "doc string, page_idx int, number int")
        return [r["corrected"] for r in numbering.corrected(rows, "doc").orderBy("page_idx").collect()]

    assert run([1, 2, None, 4]) == [1, 2, 3, 4]
    assert run([1, 3, 5]) == [1, 3, 5]
    assert run([None, 77, None]) == [None, None, None]
    assert run([10, 11, 12, 99, 14]) == [10, 11, 12, 13, 14]


def test_tables():
    one = "<table><tr><td>a</td><td>b</td></tr><tr><td>c</td><td>d</td></tr></table>"
    assert evaluation.table_similarity(one, one) == 1.0
    assert evaluation.table_similarity(one, one.replace("<td>d</td>", "")) == pytest.approx(1 - 1 / 7)
    assert evaluation.table_similarity("", "") == 1.0
    assert evaluation.table_shape_of("<table><tr><td rowspan=2>a</td><td>b</td></tr><tr><td colspan=2>c</td></tr></table>") == (2, 3)
    assert evaluation.table_shape_of(None) == (0, 0)


def test_tables_of_one_form_are_parsed_and_measured_once(monkeypatch):
    parsed = []
    monkeypatch.setattr(evaluation, "parse_table", lambda html, parse=evaluation.parse_table: parsed.append(html) or parse(html))
    tables = [f"<table><tr><td>form {i}</td><td>{'x' * (i % 7)}</td></tr></table>" for i in range(200)]
    others = [t.replace("form", "from") for t in tables]
    found = evaluation.table_similarities(tables, others)
    assert len(parsed) <= 4
    # two signs of a cell's text are changed, of four nodes
    assert found == pytest.approx([1 - 2 / len(f"form {i}") / 4 for i in range(200)])
    assert found[:3] == [evaluation.table_similarity(a, b) for a, b in zip(tables[:3], others[:3], strict=True)]


def test_shapes_of_one_form_are_laid_out_once(monkeypatch):
    parsed = []
    monkeypatch.setattr(evaluation, "parse_table", lambda html, parse=evaluation.parse_table: parsed.append(html) or parse(html))
    shapes = [evaluation.table_shape_of(f"<table><tr><td rowspan=3>shape {i}</td><td>{i}</td></tr></table>") for i in range(200)]
    assert shapes == [(3, 2)] * 200 and len(parsed) <= 1


@pytest.mark.parametrize("cell", ["a > b", "a &lt; b", '<b>a', "0,", "<!-- a", '<i title="x', "a,<br>0,", "<script>0,"])
def test_odd_cells_are_parsed_whole(cell):
    one = f"<table><tr><td>{cell}</td><td>c</td></tr></table>"
    labels, leftmost, texts = evaluation._postorder(evaluation.parse_table(one))
    assert evaluation._ordered(one) == (labels, leftmost, [" ".join(t.split()) for t in texts])
    assert evaluation._ordered(one + "0,")[2][-1] == evaluation._postorder(evaluation.parse_table(one + "0,"))[2][-1]


def test_html_blocks():
    found = html.read_blocks("<title>T</title><h2 id=x>Head</h2><p>one<b>two<script>no</script><ul><li>a <a href='/b#c'>l</a><li>b</ul>tail")
    assert [(b["type"], b["text"]) for b in found] == [("Title", "T"), ("SectionHeader", "Head"), ("Text", "onetwo"), ("ListItem", "a l"), ("ListItem", "b"), ("Text", "tail")]
    assert found[1]["anchor"] == "x" and found[3]["links"] == ["/b#c"] and html.read_blocks(None) == []


def test_quote_and_list_levels(spark):
    rows = spark.createDataFrame([("d", i, float(x), 100.0) for i, x in enumerate([0, 20, 20, 45, 0])], "doc string, ord int, x0 double, x1 double")
    assert [r["quote_level"] for r in documents.quote_levels(rows, "doc").orderBy("ord").collect()] == [0, 1, 1, 2, 0]
    rows = spark.createDataFrame([("d", i, float(x)) for i, x in enumerate([0, 10, 20, 10, 0])], "doc string, ord int, x0 double")
    assert [r["list_level"] for r in documents.list_levels(rows, "doc").orderBy("ord").collect()] == [0, 1, 2, 1, 0]


def test_storage():
    raw = json.dumps([{"text": "x" * 300} for _ in range(5)])
    kept = storage.encode_spans(raw)
    assert storage.decode_spans(kept) == raw and kept["count"] == 5
    assert storage.encode_spans("[]") is None and storage.encode_spans(None) is None
    for damage in ({"sha256": "0" * 64}, {"count": 4}, {"raw_bytes": 3}):
        with pytest.raises(ValueError):
            storage.decode_spans(kept | damage)


def test_tei():
    doc = b"""<TEI><teiHeader>Deutsches Textarchiv</teiHeader><text><body><div><head>H</head><pb n="2"/><p>one <ref target="#n1">1</ref></p><note place="foot" xml:id="n1">note</note></div></body></text></TEI>"""
    rows = packages.read_tei("a", doc)
    assert [(r[1], r[4]) for r in rows] == [("structure", "body"), ("structure", "div"), ("block", "SectionHeader"), ("anchor", "page"), ("block", "Text"), ("relation", "ref"), ("block", "Footnote")]
    assert packages.tei_profile(doc.decode()) == "dta"


def epub(extra=()):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></container>')
        z.writestr("o/p.opf", '<package><manifest><item id="a" href="a.html"/><item id="b" href="b.html"/></manifest><spine><itemref idref="a"/><itemref idref="b"/></spine></package>')
        z.writestr("o/a.html", '<h1>One</h1><p>x <a href="b.html#y">go</a></p>')
        z.writestr("o/b.html", '<h2 id="y">Two</h2><p>z</p>')
        for name in extra:
            z.writestr(name, "x")
    return out.getvalue()


def test_epub(spark):
    rows = packages.read_epub("e", epub())
    assert [r[7] for r in rows if r[1] == "block"] == ["One", "x go", "Two", "z"]
    assert [(r[3], r[5], r[6]) for r in rows if r[1] == "relation"] == [("r0", "b1", "b2")]
    assert [r[5] for r in rows if r[1] == "structure"] == [None, "s0"]
    assert packages.read_epub("e", epub(["../evil"]))[0][3] == "unsafe_path"
    files = spark.createDataFrame([("e", bytearray(epub())), ("bad", bytearray(b"no zip"))], "path string, content binary")
    assert {(r["doc"], r["kind"]) for r in packages.package_rows(files, packages.read_epub).collect()} >= {("bad", "refused"), ("e", "block")}


def test_file_kinds(spark):
    rows = spark.createDataFrame([(bytearray(b"%PDF-1"), "a"), (bytearray(b"\x89PNG"), "a"), (bytearray(b"PK\x03\x04"), "a.epub"), (bytearray(b" <!DOCTYPE html>"), "a"), (bytearray(b"??"), "x.docx"), (bytearray(b"??"), "x")], "c binary, n string")
    assert [r[0] for r in rows.select(storage.file_kind(F.col("c"), F.col("n"))).collect()] == ["pdf", "png", "epub", "html", "docx", "pdf"]


def test_prose_only():
    from folioframe.operators import markdown

    text = "a 12 `x  y` b\nnext 3\n\n\n\nend  \n```\n1\n\n\n\n2\n```\n$5 1$ z\n| a |\n| b |\ncut-\nting"
    assert markdown.on_prose(text, markdown.fewer_blanks) == text.replace("\n\n\n\nend  ", "\n\nend")
    assert markdown.on_prose(text, markdown.joined_lines) == text.replace("b\nnext", "b next").replace("end  ", "end").replace("cut-\nting", "cutting")
    assert markdown.on_prose(None, markdown.fewer_blanks) == ""


def test_otsl():
    from folioframe.operators import markdown

    assert markdown.otsl_html("<fcel>a<lcel><nl><ucel><xcel><nl>") == '<table><tr><td rowspan="2" colspan="2">a</td></tr><tr></tr></table>'
    assert markdown.otsl_html("<fcel>a<nl><fcel>b<fcel>c<nl>") is None and markdown.otsl_html("<lcel>") is None and markdown.otsl_html(None) is None


def test_size_levels(spark):
    from folioframe.operators import furniture

    rows = spark.createDataFrame([("d", i, float(x)) for i, x in enumerate([30, 30.5, 20, 19.8, 12, 12.1, 12.2, 11])], "doc string, i int, size double")
    got = [r["level"] for r in furniture.size_levels(rows, "doc", "size").orderBy("i").collect()]
    assert got == [1, 1, 2, 2, 3, 3, 3, 3]


def test_repair_proposals(spark):
    from folioframe.operators import numbering

    # page, raw, number, kind, projected, segment, status, segment_kind, boundary, anomaly
    given = [(i, str(i), i, "arabic", i, 0, "stable", "arabic", False, False) for i in range(8)] + [(8 + i, None, None, None, None, 1, "anomaly", "unknown", False, False) for i in range(2)]
    given[1] = (1, None, None, "arabic", 1, 0, "stable", "arabic", False, False)
    given[2] = (2, "9", 9, "arabic", 2, 0, "stable", "arabic", False, False)
    given[3] = (3, "9", 9, "roman", 3, 0, "stable", "roman", False, False)
    given[4] = (4, "x", None, "arabic", None, 0, "stable", "arabic", False, False)
    rows = spark.createDataFrame([("d", *g) for g in given], "doc string, page_idx int, raw string, number int, kind string, projected int, segment int, status string, segment_kind string, boundary boolean, anomaly boolean")
    got = [(r["action"], r["reason"]) for r in numbering.repair_proposals(rows, "doc").orderBy("page_idx").collect()]
    assert got == [("keep", None), ("fill_null", "two_sided"), ("replace", "two_sided"), ("abstain", "roman_replace"), ("delete_to_null", "unparsable"), ("keep", None), ("keep", None), ("abstain", "guard_band"), ("abstain", "unstable_segment"), ("abstain", "unstable_segment")]


def test_hocr():
    from folioframe.sources import layout_json

    found = layout_json.read_hocr("<div><span class='ocr_line' title='bbox 1 2 3 4; x'>a <b>b</b></span><span class=\"ocr_line\" title=''>c</span></div>")
    assert found == [{"text": "a b", "bbox": [1.0, 2.0, 3.0, 4.0]}, {"text": "c", "bbox": [None] * 4}]


def test_what_no_rewrite_touches():
    from folioframe.operators import markdown

    text = "a | b\n--|--\n1 | 2\n\n\n\nx  \n~~~\n``` \n\n\n\n~~~~\nsee \\[ a\n\n\n\nb \\]\ny  \n<PRE>\n\n\n\n</pre>\n$$ open\n\n\n\nnever"
    got = markdown.on_prose(text, markdown.fewer_blanks)
    assert got == text.replace("2\n\n\n\nx  ", "2\n\n\nx").replace("y  ", "y").replace("open\n\n\n\nnever", "open\n\nnever")
    upper = lambda t: markdown.on_prose(t, str.upper)
    assert upper("a `` b ` c `` d `e` $x$ \\(y\\) 5$ f $6") == "A `` b ` c `` D `e` $x$ \\(y\\) 5$ F $6"
    assert upper("```x\na\n```\nb") == "```x\na\n```\nB" and upper("\ue000 a `b`") == "\ue000 A `b`"
    assert [g for g, _ in markdown.regions("a\n    b\nc", (*markdown.REGIONS, markdown.INDENTED))] == [False] and [g for g, _ in markdown.regions("\n    b\nc", (*markdown.REGIONS, markdown.INDENTED))] == [False, True, False]


def test_markdown_of_blocks():
    from folioframe.operators import markdown

    b = lambda kind, text, level=None: {"type": kind, "text": text, "level": level}
    got = markdown.from_blocks([b("SectionHeader", "h", 9), b("ListItem", "x"), b("ListItem", "y"), b("TableCell", "a|b"), b("TableCell", "c"), b("Text", "3. z"), b("Code", "k ``` l"), b("Quote", " q "), b("Text", " ")])
    assert got == "###### h\n\n- x\n- y\n\n| a\\|b | c |\n\n3\\. z\n\n````\nk ``` l\n````\n\n> q"


def test_steps_of_the_shorter_text_only(monkeypatch):
    steps = []
    monkeypatch.setattr(fn, "enumerate", lambda signs, start=0: (start and steps.append(len(signs))) or enumerate(signs, start), raising=False)
    short, long = "an old page", "the page of an old book, " * 400
    assert fn.edit_distance(short, long, 20_000) == fn.edit_distance(long, short, 20_000) == len(long) - len(short)
    assert steps == [len(short)] * 2
    assert fn.edit_distance("", "abc", 9) == fn.edit_distance("abc", "", 9) == 3 and fn.edit_distance("", "", 9) == 0
