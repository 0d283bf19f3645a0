"""List repairs, superscripts, headings, layers and captions on cases worked out by hand."""

import pytest
from pyspark.sql import functions as F

from folioframe.functions import text as fn
from folioframe.operators import documents, evaluation, furniture, layout
from folioframe.operators import list_repair as lists

from test_functions import values


def test_notes_are_siblings():
    given = "1. first\n   2. second\n  - 3) third\n- [4. L](#page--1-0)ev said\n[5](#page--2). five\n[6.](x.html) six\n  [7](x.html) seven\n- [8](x.html) eight\n- plain\n  - nested\n12345. year\n9\\. nine"
    want = "1. first\n2. second\n3) third\n4. Lev said\n5. five\n[6.](x.html) six\n7. seven\n- [8](x.html) eight\n- plain\n  - nested\n12345. year\n9\\. nine"
    assert lists.repaired_lists_of(given) == want and lists.repaired_lists_of(want) == want
    assert lists.repaired_lists_of("```\n   2. code\n```") == "```\n   2. code\n```" and lists.repaired_lists_of(None) == ""


def test_rests_at_page_starts():
    page = lambda before, after: lists.repaired_lists_of(f"{before}\n\n{{4}}\n---\n<!-- Page: 3 -->\n\n{after}").rsplit("\n", 1)[1]
    assert page("the word-", "   Rest") == "Rest" and page("a sentence", "    goes on") == "goes on" and page("a sentence", "  (in brackets") == "(in brackets"
    assert page("an end.", "  (in brackets") == "  (in brackets" and page("an end.", "  New text") == "  New text" and page("a sentence", "  - an item") == "  - an item" and page("a sentence", "  *emphasis* goes") == "*emphasis* goes"
    assert lists.repaired_lists_of("a sentence\n  goes on") == "a sentence\n  goes on"  # no page begins
    assert lists.goes_on("", "x") is False and lists.goes_on("x", "") is False


def test_calls_with_brackets_and_on_their_own_lines(spark):
    given = ["a<sup>3)</sup> b", "end.\n\n<sup> iv )</sup>\nnext", "end\n<sup>4</sup> text", "<sup>5</sup>\nx", "x^{2}^ y", None]
    assert values(spark, given, fn.superscript_calls) == ["a<sup>3</sup> b", "end.<sup>iv</sup>\nnext", "end\n<sup>4</sup> text", "<sup>5</sup>\nx", "x^{2}^ y", None]


def test_numbers_of_dates(spark):
    rows = [("12", "May 12, 1864"), ("1864", "May 12, 1864"), ("12", "12th of nothing"), ("3", "3rd Sept. 1901"), ("1901", "3 September 1901"), ("5", "Mayor 5"), ("64", "18 64年"), ("64", "1864 words"), ("7", "第7期"), ("7", "期7"), (None, "x"), ("7", None)]
    df = spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(rows)], "i int, n string, t string")
    got = [r[0] for r in df.orderBy("i").select(furniture.in_a_date(F.col("n"), F.col("t"))).collect()]
    assert got == [True, True, False, True, True, False, True, False, False, True, False, False]


def test_levels_of_headings(spark):
    rows = [('{"level":9,"heading_level":2}', None, "x"), ('{"level":"3"}', '{"level":1}', "x"), ('{"level":0}', '{"text_level":4}', "x"), ("{}", "{}", "3.2.1 Part"), ("{}", None, "3 4"), (None, None, None), ('{"raw_label":"document title"}', None, "x"), ("no json", None, "x")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, attributes string, raw string, text string")
    got = [(r["level"], r["level_source"]) for r in documents.heading_levels(df).orderBy("i").collect()]
    assert got == [(2, "own"), (3, "own"), (4, "upstream"), (3, "inferred"), (1, "inferred"), (2, "default"), (1, "inferred"), (2, "default")]


@pytest.mark.parametrize("embedded", [False, True])
def test_layers(spark, embedded):
    long = "a layer with thirty signs and some more of them, all unlike"
    rows = [(0, long, 0), (1, long, len(long)), (2, long, 10), (3, "short", 0), (4, long + "�", None), (5, None, None), (6, "half of this is said twice here and there " * 2, 0), (7, long + "\x02", 2)]
    got = {r["i"]: (r["kind"], r["reasons"], r["trusted"]) for r in evaluation.layer_verdicts(spark.createDataFrame(rows, "i int, text string, unseen int"), embedded).collect()}
    seen = "visible_text_layer"
    assert got[0] == (seen, [], True) and got[3] == (seen, ["too_few_visible_chars"], False) and got[4] == (seen, ["bad_characters"], False) and got[5] == (seen, ["too_few_visible_chars"], False) and got[6] == (seen, ["duplicated_text_layer"], False)
    assert got[1] == (("embedded_ocr_layer", [], True) if embedded else (seen, ["invisible_text_layer"], False))
    assert got[2] == (seen, ["mixed_visible_and_invisible_layers" if embedded else "invisible_text_layer"], False) and got[7][1] == ["bad_characters"]


def test_captions_are_taken_once(spark):
    box = lambda y: (0.0, float(y), 100.0, float(y) + 20)
    kinds = ["Caption", "Table", "Caption", "Figure", "Footnote", "Text", "Caption", "Picture", "Table"]
    rows = [(0, 10 + i, i, k, *box(30 * i + (500 if i == 8 else 0))) for i, k in enumerate(kinds)]
    blocks = spark.createDataFrame(rows, "page int, id long, ord int, kind string, x0 double, y0 double, x1 double, y1 double")
    pages = spark.createDataFrame([(0, 400.0)], "page int, height double")
    got = {r["owner"]: (r["kind"], list(r["members"]), r["group_y0"], r["group_y1"]) for r in layout.caption_groups(blocks, pages).collect()}
    assert got == {11: ("TableGroup", [10, 11, 12], 0.0, 80.0), 13: ("FigureGroup", [13, 14], 90.0, 140.0), 17: ("PictureGroup", [16, 17], 180.0, 230.0)}
    assert layout.caption_groups(blocks, pages, 0.001).count() == 0


def test_runs_over_the_ends_of_ranges(spark):
    import itertools
    import random

    rng = random.Random(6)
    rows = [(d, i, rng.choice("aaab")) for d, n in (("x", 900), ("y", 3), ("z", 400)) for i in range(n)] + [("w", i, "same") for i in range(700)]
    df = spark.createDataFrame(rows, "doc string, at int, line string").repartition(7)
    got = sorted((r["doc"], r["line"], r["n"]) for r in furniture.edge_runs(df, "doc", ["at"], "line").collect())
    want = sorted((d, line, len(list(run))) for (d, line), run in itertools.groupby(sorted(rows), key=lambda r: (r[0], r[2])))
    assert got == want
    assert [tuple(r) for r in furniture.common_edges(df.where("doc = 'w'"), "doc", ["at"], "line").collect()] == [("w", "same", 700, 700)]
    assert furniture.common_edges(df.where("false"), "doc", ["at"], "line").count() == 0
