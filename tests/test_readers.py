"""Readers on odd files, packages that are written once and whole, decisions of spans and small type."""

import io
import json
import os
import random
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from folioframe.functions import text as fn
from folioframe.operators import annotations, decisions
from folioframe.sources import fragments, html, navigation, package_writer

# elements over pages


def pieces(xml):
    return [(r[1], r[3], r[5], r[6], r[8], r[11]) for r in fragments.read_fragments("d", xml.encode())]


def test_a_paragraph_over_three_pages():
    xml = '<TEI><teiHeader><p>no</p></teiHeader><text><body><pb n="1"/><div><head>Head</head><p xml:id="p">one <hi>two</hi> <pb n="2"/>three four <pb n="3"/> five</p><p>six</p></div></body></text></TEI>'
    assert pieces(xml) == [(0, "SectionHeader", 0, 1, "1", "Head"), (1, "Text", 0, 3, "1", "one two"), (1, "Text", 1, 3, "2", "three four"), (1, "Text", 2, 3, "3", "five"), (2, "Text", 0, 1, "3", "six")]
    rows = fragments.read_fragments("d", xml.encode())
    assert rows[1][2] == "p" and [r[9:11] for r in rows[1:4]] == [(4, 12), (12, 23), (23, 27)]


def test_pieces_of_odd_texts():
    assert pieces("<TEI><text/></TEI>") == [] and pieces("<TEI><body><p>outside of a text</p></body></TEI>") == []
    # notes hold and are held; the break cuts both; what has no text keeps one piece
    nested = pieces('<TEI><text><p>a<note>b<pb n="x"/>c</note>d</p><p/><p>  <pb n="y"/>e</p></text></TEI>')
    assert nested == [(0, "Text", 0, 2, "", "ab"), (0, "Text", 1, 2, "x", "cd"), (1, "Footnote", 0, 2, "", "b"), (1, "Footnote", 1, 2, "x", "c"), (2, "Text", 0, 1, "y", ""), (3, "Text", 0, 1, "y", "e")]
    deep = "<TEI><text>" + "<p>x " * 3000 + "</p>" * 3000 + "</text></TEI>"
    assert len(pieces(deep)) == 3000


def test_pieces_tile_their_elements():
    rng = random.Random(2)
    for _ in range(30):
        words = [f"w{i}" for i in range(rng.randrange(1, 60))]
        body = " ".join(w + ('<pb n="q"/>' if rng.random() < 0.2 else "") for w in words)
        rows = fragments.read_fragments("d", f"<TEI><text><p>{body}</p></text></TEI>".encode())
        assert "".join(r[11].replace(" ", "") for r in rows) == "".join(words)
        assert all(a[10] <= b[9] for a, b in zip(rows, rows[1:])) and [r[5] for r in rows] == list(range(len(rows)))


def test_fragments_of_files(spark):
    files = spark.createDataFrame([("a", bytearray(b"<TEI><text><p>x<pb/>y</p></text></TEI>")), ("b", bytearray(b"<TEI><oops></TEI>")), ("c", bytearray(b""))], "path string, content binary")
    got = sorted((r["doc"], r["type"], r["page"], r["text"]) for r in fragments.fragments(files).collect())
    assert got == [("a", "Text", 0, "x"), ("a", "Text", 1, "y"), ("b", "refused", 0, ""), ("c", "refused", 0, "")]


# trees of contents


def epub(parts, opf):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as book:
        book.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="p.opf"/></rootfiles></container>')
        book.writestr("p.opf", opf)
        for name, text in parts.items():
            book.writestr(name, text)
    return out.getvalue()


def entries(spark, data):
    files = spark.createDataFrame([("d", bytearray(data))], "path string, content binary")
    return [(r["nav"], r["kind"], r["ord"], r["parent"], r["depth"], r["label"], r["block"]) for r in navigation.navigation(files).orderBy("nav", "ord").collect()]


OPF = '<package><manifest><item id="a" href="a%20b.xhtml"/><item id="n" href="nav.xhtml" properties="scripted nav"/>{more}</manifest><spine{toc}><itemref idref="a"/><itemref idref="gone"/></spine></package>'
TEXT = "<html><body><h1>One</h1><p id='x'>text</p><h3>Three</h3><h2>Two</h2><p>end</p></body></html>"


def test_nested_lists_of_contents(spark):
    nav = '<html xmlns:epub="http://www.idpf.org/2007/ops"><body><nav epub:type="toc"><h1>Contents</h1><ol><li><a href="a%20b.xhtml">One</a><ol><li><span>Part</span><ol><li><a href="a%20b.xhtml#x">deep <i>er</i></a></li></ol></li><li><a href="#here">own</a></li></ol></li><li><a href="other.xhtml">lost</a></li></ol></nav><nav role="doc-landmarks"><ol/></nav><nav epub:type="page-list"><ol><li><a href="a%20b.xhtml#x">iv</a></li></ol></nav></body></html>'
    got = entries(spark, epub({"a b.xhtml": TEXT, "nav.xhtml": nav}, OPF.format(more="", toc="")))
    assert got == [
        (0, "toc", 0, None, 0, "One", 0), (0, "toc", 1, 0, 1, "Part", None), (0, "toc", 2, 1, 2, "deep er", 1), (0, "toc", 3, 0, 1, "own", None), (0, "toc", 4, None, 0, "lost", None),
        (2, "page_list", 0, None, 0, "iv", 1),
        (3, "generated_toc", 0, None, 0, "One", 0), (3, "generated_toc", 1, 0, 1, "Three", 2), (3, "generated_toc", 2, 0, 1, "Two", 3),
    ]


def test_contents_of_odd_books(spark):
    deep = "".join(f'<navPoint><navLabel><text>{i}</text></navLabel><content src="a%20b.xhtml#none"/>' for i in range(900)) + "</navPoint>" * 900
    got = entries(spark, epub({"a b.xhtml": TEXT, "t.ncx": f"<ncx><navMap>{deep}</navMap></ncx>", "nav.xhtml": "<html/>"}, OPF.format(more='<item id="t" href="t.ncx"/>', toc=' toc="t"')))
    assert [g[4] for g in got if g[1] == "toc"] == list(range(900)) and got[0][6] == 0  # a fragment that is nowhere leads to its file
    assert [g[1] for g in entries(spark, b"no archive")] == ["refused"]
    assert [g[1] for g in entries(spark, epub({"../x": ""}, OPF.format(more="", toc="")))] == ["refused"]
    assert [g[1] for g in entries(spark, epub({}, OPF.format(more="", toc="")))] == ["refused"]


# packages

LINES = "package string, component string, ord long, line string"


def test_packages_are_written_once_and_whole(spark, tmp_path):
    folder = str(tmp_path / "out")
    rows = [(f"p{i % 7}", f"c{i % 3}.jsonl", i, json.dumps({"i": i})) for i in range(200)] + [("p0", "empty.md", 0, None), ("p1", "é.txt", 0, "ü")]
    df = spark.createDataFrame(rows, LINES).repartition(5)
    package_writer.write_packages(df, folder)
    first = {d: {f: (os.stat(f"{folder}/{d}/{f}").st_mtime_ns, open(f"{folder}/{d}/{f}", "rb").read()) for f in os.listdir(f"{folder}/{d}")} for d in os.listdir(folder)}
    assert sorted(d.split(".")[0] for d in first) == [f"p{i}" for i in range(7)]
    want = "".join(r[3] + "\n" for r in sorted(rows[:200], key=lambda r: r[2]) if r[:2] == ("p3", "c1.jsonl"))
    assert next(f["c1.jsonl"][1].decode() for d, f in first.items() if d.startswith("p3.")) == want
    package_writer.write_packages(df, "file://" + folder)
    assert {d: {f: (os.stat(f"{folder}/{d}/{f}").st_mtime_ns, open(f"{folder}/{d}/{f}", "rb").read()) for f in os.listdir(f"{folder}/{d}")} for d in os.listdir(folder)} == first
    told = package_writer.package_components(spark, folder).collect()
    assert sum(r["records"] for r in told) == len(rows) and all(r["bytes"] == len(first[f"{r['package']}.source.{r['version']}"][r["component"]][1]) for r in told)
    assert package_writer.damaged(spark, folder).count() == 0
    # another content is another version beside it; a changed file is found
    package_writer.write_packages(df.where("package = 'p2' and ord < 100"), folder)
    assert len([d for d in os.listdir(folder) if d.startswith("p2.")]) == 2
    open(f"{folder}/{next(d for d in first if d.startswith('p3.'))}/c1.jsonl", "a").write("{}\n")
    assert [(r["package"], r["component"]) for r in package_writer.damaged(spark, folder).collect()] == [("p3", "c1.jsonl")]
    package_writer.write_packages(df.where("false"), folder)
    assert len(os.listdir(folder)) == 8


def row(*values):
    from pyspark.sql import Row

    return Row(package=values[0], component=values[1], ord=values[2], line=values[3])


def test_lost_and_repeated_tasks_leave_one_package(tmp_path):
    writer = package_writer.PackageWriter(str(tmp_path))
    lines = [row("p", "a", 0, "x"), row("p", "a", 1, "y"), row("q", "a", 0, "z")]

    def lost():
        yield lines[0]
        raise OSError("the executor is gone")

    with pytest.raises(OSError):
        writer.write(lost())
    once, twice = writer.write(iter(lines)), writer.write(iter(lines))  # a task that ran twice
    assert len(os.listdir(tmp_path)) == 5 and all(d.startswith(".") for d in os.listdir(tmp_path))
    writer.commit([once, None])
    assert sorted(d.split(".")[0] for d in os.listdir(tmp_path)) == ["p", "q"]
    assert open(tmp_path / next(d for d in os.listdir(tmp_path) if d[0] == "p") / "a").read() == "x\ny\n"
    other = package_writer.PackageWriter(str(tmp_path))
    again = other.write(iter(lines))
    other.commit([again])
    assert len(os.listdir(tmp_path)) == 2
    third = package_writer.PackageWriter(str(tmp_path))
    third.write(iter(lines))
    third.abort([])
    assert len(os.listdir(tmp_path)) == 2 and twice.packages
    with pytest.raises(ValueError):
        third.write(iter([row("p", "../a", 0, "x")]))
    with pytest.raises(ValueError):
        package_writer.folder_of("hdfs://x/y")


# decisions

PROPOSAL = "doc string, page int, action string, proposed string, kind string, current string, raw string, reason string, confidence double"
PAGE = "doc string, page int, kind string, current string"


def judged(spark, labels, proposals, chosen, **more):
    """labels: by page; proposals: page -> (action, value, kind); chosen: page -> (action, value)."""
    kind = lambda v: None if v is None else "arabic" if v.isdigit() else "roman"
    pages = spark.createDataFrame([("d", i, kind(v), v) for i, v in enumerate(labels)], PAGE)
    told = spark.createDataFrame([("d", p, a, v, k, labels[p], "?", None, None) for p, (a, v, k) in proposals.items()], PROPOSAL)
    spans = decisions.review_spans(decisions.review_pages(told), pages, "doc")
    made = spark.createDataFrame([("d", p, a, v) for p, (a, v) in chosen.items()], "doc string, page int, action string, chosen string")
    return {r["page"]: (r["span"], r["left"], r["right"], r["verdict"]) for r in decisions.judged(spans, made, "doc", **more).collect()}


def test_decisions_of_a_span_stand_or_fall_together(spark):
    labels = ["1", "2", None, "9", "5", "6", None, "8", "iv"]
    asked = {2: ("fill_null", "3", "arabic"), 3: ("replace", "4", "arabic"), 6: ("fill_null", "7", "arabic"), 8: ("replace", "v", "roman")}
    good = {2: ("fill_null", "3"), 3: ("replace", "4"), 6: ("fill_null", "7"), 8: ("replace", "v")}
    assert judged(spark, labels, asked, good) == {2: (1, "2", "5", "accepted"), 3: (1, "2", "5", "accepted"), 6: (2, "6", "8", "accepted"), 8: (3, None, None, "accepted")}
    # a page that falls below the one before takes the whole span with it
    falling = asked | {3: ("replace", "2", "arabic")}
    assert {p: v[3] for p, v in judged(spark, labels, falling, good | {3: ("replace", "2")}).items()} == {2: "span_continuity_regression", 3: "span_continuity_regression", 6: "accepted", 8: "accepted"}
    # beside the span counts only where asked
    alone = {2: ("fill_null", "30", "arabic")}
    assert judged(spark, labels, alone, {2: ("fill_null", "30")})[2][3] == "accepted"
    assert judged(spark, labels, alone, {2: ("fill_null", "30")}, anchored=True)[2][3] == "span_continuity_regression"
    jumps = {p: ("replace", str(v), "arabic") for p, v in ((3, 10), (4, 20), (5, 30))}
    assert {v[3] for v in judged(spark, labels, jumps, {p: v[:2] for p, v in jumps.items()}).values()} == {"span_continuity_large_jumps"}


def test_single_decisions(spark):
    labels = [None] * 7
    asked = {p: ("fill_null", str(p), "arabic") for p in range(7)}
    got = judged(spark, labels, asked, {0: ("fill_null", "0"), 1: ("guess", "1"), 2: ("fill_null", "99"), 3: ("leave_null", None), 4: ("keep", None), 5: ("delete_to_null", " ")})
    assert {p: v[3] for p, v in got.items()} == {0: "accepted", 1: "invalid_action", 2: "decision_not_in_candidates", 3: "accepted", 4: "none", 5: "accepted", 6: "none"}
    assert judged(spark, ["v"], {0: ("replace", "7", "roman")}, {0: ("replace", "7")})[0][3] == "segment_kind_mismatch"
    assert judged(spark, ["1"], {}, {}) == {}


def test_sparse_application(spark):
    blocks = spark.createDataFrame([("d", 0, "{0}\n<!-- Page: 1 -->\nx <!-- note -->"), ("d", 1, "{1}\n<!-- Page: null -->\n$1"), ("d", 2, "<!-- Page: 3 -->")], "doc string, page int, block string")
    verdicts = spark.createDataFrame([("d", 0, "1", None, "accepted"), ("d", 1, None, "2", "accepted"), ("d", 2, "3", "4", "overlap")], "doc string, page int, current string, chosen string, verdict string")
    got = {r["page"]: (r["block"], r["changed"]) for r in decisions.applied(blocks, verdicts, "doc").collect()}
    assert got == {0: ("{0}\n<!-- Page: null -->\nx <!-- note -->", True), 1: ("{1}\n<!-- Page: 2 -->\n$1", True), 2: ("<!-- Page: 3 -->", False)}


# small type

SPAN = "page int, block int, ord int, text string, size double, small boolean"


def test_planted_runs_of_small_type(spark):
    sizes = [10, 10, 6, 6, None, 6, 10, 6.1, 10, 6, 6]
    texts = ["big", "big", "sm", "all", "er", "x", "big", ".", "big", "en", "d"]
    rows = [(0, 0, i, t, None if s is None else float(s), False) for i, (t, s) in enumerate(zip(texts, sizes, strict=True))] + [(0, 1, i, "body", 10.0, False) for i in range(9)]
    got = sorted((r["block"], r["first"], r["last"], r["text"], round(r["ratio"], 3)) for r in annotations.small_runs(spark.createDataFrame(rows, SPAN)).collect())
    assert got == [(0, 2, 5, "sm all er x", 0.6), (0, 9, 10, "en d", 0.6)]
    assert annotations.small_runs(spark.createDataFrame([(0, 0, 0, "x", None, False)], SPAN)).count() == 0


def test_kinds_of_annotations(spark):
    body = [(0, 0, i, "word " * 9, 10.0, False) for i in range(9)]
    given = {1: [("（short）", 10.0, False)], 2: [("tiny", 6.0, False)], 3: [("t" * 40, 6.0, False)], 4: [("a", 10.0, False), ("b", 6.0, False)], 5: [("seven", 7.2, False)], 6: [("marked", 10.0, True)], 7: [("plain", 10.0, False)], 8: [("y" * 101, 6.0, False)], 9: [("", 6.0, False)], 10: [(None, None, False)], 11: [("(open]", 10.0, False)]}
    rows = body + [(0, b, i, t, s, m) for b, spans in given.items() for i, (t, s, m) in enumerate(spans)]
    got = {r["block"]: r["subtype"] for r in annotations.inline_annotations(spark.createDataFrame(rows, SPAN)).collect()}
    assert got == {1: annotations.BRACKETED, 2: annotations.SHORT, 3: annotations.LONGER, 4: annotations.DOUBLED, 5: annotations.OTHER, 6: annotations.OTHER}


# the reading view

BLOCK = "doc string, block int, ord int, type string, text string, fingerprint string"
EDIT = "doc string, block int, action string, begin int, end int, original string, evidence array<string>, fingerprint string"


def test_edits_and_the_reading_view(spark):
    from folioframe.operators import reading_view as view

    blocks = spark.createDataFrame([("d", 0, 5, "Text", "415a The text 10 goes on", "f"), ("d", 1, 6, "Text", "abcdef", "f"), ("d", 2, 7, "Footnote", "note", "f"), ("d", 3, 8, "Text", None, "f")], BLOCK)
    cut, good = "remove_locator_token", ["shape:digit"]
    rows = [
        ("d", 0, cut, 0, 4, "415a", good, "f"), ("d", 0, cut, 0, 4, "415a", good, "f"), ("d", 0, "separate_native_margin", 14, 16, "10", ["pitch_match:body"], "f"),
        ("d", 1, cut, 0, 3, "abc", good, "f"), ("d", 1, cut, 2, 4, "cd", good, "f"), ("d", 1, cut, 4, 5, "e", good, "f"), ("d", 1, "remove_text", 5, 6, "f", good, "f"),
        ("d", 2, cut, 0, 9, "note", good, "f"), ("d", 2, cut, 0, 4, "note", good, "g"), ("d", 2, cut, 0, 4, "note", ["guess"], "f"), ("d", 2, cut, 0, 4, "note", None, "f"), ("d", 2, cut, None, 4, "note", good, "f"), ("d", 3, cut, 0, 1, "x", good, "f"), ("d", 9, cut, 0, 1, "x", good, "f"), ("d", 2, "burn", 0, 1, "n", good, "f"),
    ]
    verdicts = view.judged_edits(spark.createDataFrame(rows, EDIT), blocks, "doc")
    got = sorted((r["block"], r["begin"] if r["begin"] is not None else -1, r["verdict"]) for r in verdicts.collect())
    assert got == sorted([(0, 0, "applied"), (0, 14, "applied"), (1, 0, "overlapping_edits"), (1, 2, "overlapping_edits"), (1, 4, "applied"), (1, 5, "human_text_edit_without_human_evidence"), (2, 0, "source_text_mismatch"), (2, 0, "edit_source_fingerprint_missing_or_mismatched"), (2, 0, "edit_evidence_missing_or_unsupported"), (2, 0, "edit_evidence_missing_or_unsupported"), (2, -1, "invalid_char_range"), (3, 0, "source_text_mismatch"), (9, 0, "missing_source_block"), (2, 0, "unsupported_edit_action")])
    notes = spark.createDataFrame([("d", 0, 0, "Footnote", "first"), ("d", 0, 1, "Footnote", "second")], "doc string, block int, number int, type string, text string")
    whole = view.reading_view(blocks, verdicts, notes, "doc")
    assert [(r["block"], r["text"], r["edits"]) for r in whole.orderBy("ord", "part").collect()] == [("0", "The text goes on", 2), ("0::note-0", "first", 0), ("0::note-1", "second", 0), ("1", "abcdf", 1), ("2", "note", 0), ("3", "", 0)]
    assert [tuple(r) for r in view.body_of(whole, "doc").collect()] == [("d", "The text goes on\n\nabcdf", 23)]


def test_batches_leave_part_by_part():
    texts = pd.Series(["aa", None, "b" * 9, "c", "", "dd"])
    parts = list(fn.slices(texts, 4))
    assert [p.tolist() for p in parts] == [["aa", None], ["b" * 9], ["c", "", "dd"]]
    assert [len(p) for p in fn.slices(texts.iloc[:0], 4)] == [0]


def test_long_pages_and_files_of_one_batch(spark):
    pages = [(i, f"<h1>page {i}</h1>" + "<p>word</p>" * 60_000) for i in range(4)]
    got = html.blocks_of(spark.createDataFrame(pages, "page_id long, html string").coalesce(1), "page_id").groupBy("page_id").count().collect()
    assert {r["page_id"]: r["count"] for r in got} == {i: 60_001 for i in range(4)}
    files = [(str(i), b"<TEI><text><body>" + b"<p>word</p>" * 50_000 + b"</body></text></TEI>") for i in range(3)] + [("bad", b"<TEI>")]
    found = fragments.fragments(spark.createDataFrame(files, "path string, content binary").coalesce(1)).where("type <> 'refused'").groupBy("doc").agg(F.max("end").alias("end")).collect()
    assert {r["doc"]: r["end"] for r in found} == {str(i): 50_000 * 4 for i in range(3)}
