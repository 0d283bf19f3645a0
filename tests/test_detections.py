"""Polygons against a raster, and the layout post-processing against a plain fold over all pairs of a page."""

import math
import random

import numpy as np
import pytest

from folioframe.functions import polygons as poly
from folioframe.operators import detections as ops

GRID = 400


def raster(points, scale=4.0):
    """Inside by the parity of crossings, at the middles of small cells."""
    ys, xs = (np.mgrid[0:GRID, 0:GRID] + 0.5) / scale
    inside = np.zeros((GRID, GRID), bool)
    for (x0, y0), (x1, y1) in zip(points, np.roll(points, -1, axis=0), strict=True):
        if y0 != y1:
            hit = ((y0 <= ys) != (y1 <= ys)) & (xs < x0 + (ys - y0) / (y1 - y0) * (x1 - x0))
            inside ^= hit
    return inside


def star(rng, n):
    """A polygon about a centre, standing out and going in."""
    cx, cy = rng.uniform(30, 70), rng.uniform(30, 70)
    return np.array([(cx + r * math.cos(t), cy + r * math.sin(t)) for t, r in ((2 * math.pi * k / n, rng.uniform(6, 28)) for k in range(n))])


@pytest.mark.parametrize("seed", range(12))
def test_areas_and_overlaps(seed):
    rng = random.Random(seed)
    a, b = star(rng, rng.randrange(3, 12)), star(rng, rng.randrange(3, 12))
    if seed % 3 == 0:
        b = np.array([(rng.uniform(20, 80), rng.uniform(20, 80)) for _ in range(6)])  # crosses itself
    p, q = raster(a), raster(b)
    cell = 1 / 16
    assert poly.area(a) == pytest.approx(p.sum() * cell, abs=12)
    assert poly.common_area(a, b) == pytest.approx((p & q).sum() * cell, abs=12) and poly.common_area(a, b) == pytest.approx(poly.common_area(b, a))
    assert poly.overlap(a, b) == pytest.approx((p & q).sum() / (p | q).sum(), abs=0.02)
    assert poly.overlap(a, b, "small") >= poly.overlap(a, b, "large") >= poly.overlap(a, b) - 1e-9


def test_areas_by_hand():
    square, other = poly.rectangle(0, 0, 10, 10), poly.rectangle(5, -5, 15, 5)
    assert poly.area(square) == 100 and poly.area(square[::-1]) == 100 and poly.common_area(square, other) == 25
    hollow = np.array([(0, 0), (10, 0), (10, 10), (8, 10), (8, 2), (2, 2), (2, 10), (0, 10)], float)
    assert poly.area(hollow) == 52 and poly.common_area(hollow, poly.rectangle(2, 2, 8, 10)) == 0 and poly.overlap(hollow, square, "small") == 1
    bow = np.array([(0, 0), (10, 10), (10, 0), (0, 10)], float)
    assert poly.area(bow) == pytest.approx(50)
    assert poly.overlap(poly.rectangle(0, 0, 0, 5), square) == 0 and poly.common_area(np.zeros((0, 2)), square) == 0


@pytest.mark.parametrize("seed", range(6))
def test_least_rectangle(seed):
    rng = random.Random(seed)
    points = np.array([(rng.uniform(0, 50), rng.uniform(0, 20)) for _ in range(rng.randrange(3, 30))])
    turn = rng.uniform(0, math.pi)
    points = points @ np.array([[math.cos(turn), math.sin(turn)], [-math.sin(turn), math.cos(turn)]])
    quad = poly.least_rectangle(points)
    for t in np.linspace(0, math.pi / 2, 400):
        r = points @ np.array([[math.cos(t), -math.sin(t)], [math.sin(t), math.cos(t)]])
        assert poly.area(quad) <= np.prod(r.max(0) - r.min(0)) + 1e-6
    x, y = quad.T
    assert (x * np.roll(y, -1) - np.roll(x, -1) * y).sum() > 0 and int(np.argmin(quad.sum(1))) == 0
    sides = np.roll(quad, -1, axis=0) - quad
    assert abs((sides[0] * sides[1]).sum()) < 1e-6
    for p in points:
        for q, d in zip(quad, sides, strict=True):
            assert d[0] * (p - q)[1] - d[1] * (p - q)[0] > -1e-6
    assert poly.least_rectangle(np.array([(0, 0), (1, 1), (2, 2)], float)) is None


def test_outlines_of_masks():
    mask = np.zeros((12, 14), bool)
    mask[2:9, 3:11] = True
    mask[4:6, 5:7] = False  # a hole
    mask[8, 3:6] = False
    mask[0, 0] = mask[9, 11] = True  # a speck, and one that meets a corner
    ring = poly.outline(mask)
    assert {tuple(p) for p in ring} == {(3, 2), (11, 2), (11, 9), (6, 9), (6, 8), (3, 8)} and poly.area(ring) == 53
    assert poly.outline(np.zeros((3, 3))) is None
    ys, xs = np.mgrid[0:60, 0:60]
    disc = (ys - 30) ** 2 + (xs - 30) ** 2 < 20**2
    ring = poly.outline(disc)
    assert poly.area(ring) == disc.sum()
    less = poly.simplified(ring, 1.5)
    assert len(less) < len(ring) / 3 and poly.overlap(ring, less) > 0.95
    assert len(poly.mask_polygon(disc, 60)) >= 8 and poly.overlap(poly.mask_polygon(disc, 60), ring) > 0.85
    slab = np.zeros((40, 60), bool)
    slab[5:35, 4:50] = True
    assert poly.mask_polygon(slab, 60).tolist() == [[4, 5], [50, 5], [50, 35], [4, 35]]


def test_leading_corners():
    notch = np.array([(0, 0), (40, 0), (40, 30), (22, 30), (20, 28), (18, 30), (0, 30)], float)
    assert (20.0, 28.0) not in {tuple(p) for p in poly.walked(notch, 100)}  # one corner that goes in by itself
    step = np.array([(0, 0), (40, 0), (40, 30), (30, 30), (25, 26), (15, 26), (10, 30), (0, 30)], float)
    assert {(25.0, 26.0), (15.0, 26.0)} <= {tuple(p) for p in poly.walked(step, 100)}
    dense = np.array([(0, 0), (40, 0), (40, 30), (30, 30), (20, 29), (10, 30), (0, 30)], float)
    assert (20.0, 29.0) in {tuple(p) for p in poly.walked(dense, 15)}


def test_settled_shapes():
    box = poly.rectangle(0, 0, 100, 40)
    near = np.array([(0, 0), (100, 1), (100, 40), (0, 39)], float)
    assert poly.settled(box, near, None).tolist() == box.tolist()
    leaning = np.array([(10, 0), (100, 30), (90, 40), (0, 10)], float)
    assert poly.overlap(poly.settled(box, leaning, None), poly.least_rectangle(leaning)) > 0.99
    assert poly.settled(box, leaning, poly.rectangle(0, 0, 50, 40)).tolist() == leaning.tolist()
    ell = np.array([(0, 0), (100, 0), (100, 10), (20, 10), (20, 40), (0, 40)], float)
    assert poly.settled(box, ell, None).tolist() == box.tolist() or poly.settled(box, ell, None).tolist() == ell.tolist()
    assert poly.settled(box, ell[:3], None, "poly").tolist() == box.tolist() and poly.settled(box, None, None, "quad").tolist() == box.tolist()
    with pytest.raises(ValueError):
        poly.settled(box, ell, None, "oval")


# the steps on a page

KINDS = ["text", "image", "table", "inline_formula", "header", "reference", "chart"]
ROW = "page long, id long, label string, score double, x0 double, y0 double, x1 double, y1 double, hint long, outline array<struct<x:double,y:double>>"


def made(seed, n=60):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x, y = rng.randrange(0, 260), rng.randrange(0, 360)
        w, h = rng.choice([4, 30, 80, 200]), rng.choice([5, 20, 60, 200])
        outline = [(x, y), (x + w, y + h * 0.2), (x + w, y + h), (x, y + h * 0.8)] if i % 3 == 0 else []
        rows.append((i % 2, i, rng.choice(KINDS), round(rng.uniform(0.3, 1), 3), x + 0.4, y - 0.3, x + w + 0.2, y + h + 0.1, None if i % 7 == 0 else rng.randrange(30), outline))
        if i % 4 == 0:
            rows.append((i % 2, 1000 + i, rows[-1][2] if i % 8 else "text", round(rng.uniform(0.3, 1), 3), x + 1.0, y + 1.0, x + w + 1.0, y + h + 2.0, 5, []))
    rows.append((2, 5000, "image", 0.9, 0.0, 0.0, 300.0, 400.0, None, []))
    rows.append((3, 5001, "image", 0.9, 0.0, 0.0, 300.0, 400.0, None, []))
    rows.append((3, 5002, "text", 0.9, 10.0, 10.0, 90.0, 40.0, None, []))
    return rows


def shared(p, q):
    return max(0, min(p[2], q[2]) - max(p[0], q[0])) * max(0, min(p[3], q[3]) - max(p[1], q[1]))


def size(p):
    return max(0, p[2] - p[0]) * max(0, p[3] - p[1])


def plain(rows, mode, modes, ratio):
    out = {}
    for page in sorted({r[0] for r in rows}):
        boxes = [[r[1], r[2], r[3], [float(round(v)) for v in r[4:8]], r[8], r[9]] for r in rows if r[0] == page and r[3] > 0.5]
        kept = []
        for b in sorted(boxes, key=lambda b: (-b[2], b[0])):
            grown = lambda p: [p[0], p[1], p[2] + 1, p[3] + 1]
            iou = lambda p, q: shared(p, q) / (size(p) + size(q) - shared(p, q))
            if all(iou(grown(b[3]), grown(k[3])) < (0.6 if k[1] == b[1] else 0.98) for k in kept):
                kept.append(b)
        fills = [b for b in kept if b[1] == "image" and size([max(0, b[3][0]), max(0, b[3][1]), min(300, b[3][2]), min(400, b[3][3])]) > 0.93 * 300 * 400]
        kept = [b for b in kept if b not in fills] or kept
        if modes == "large":
            kept = [b for b in kept if not any(o is not b and size(b[3]) and shared(b[3], o[3]) >= 0.9 * size(b[3]) for o in kept)]
        kept.sort(key=lambda b: (b[4] is None, b[4] or 0, -b[2], b[0]))
        before, done = None, []
        for b in kept:
            points = np.array(b[5], float) if b[5] else None
            before = poly.settled(poly.rectangle(*b[3]), points, before, mode)
            x0, y0, x1, y1 = b[3]
            cx, cy, w, h = (x0 + x1) / 2, (y0 + y1) / 2, (x1 - x0) * ratio[0], (y1 - y0) * ratio[1]
            box = [float(math.trunc(v)) for v in (max(0, cx - w / 2), max(0, cy - h / 2), min(300, cx + w / 2), min(400, cy + h / 2))]
            if box[2] > box[0] and box[3] > box[1]:
                done.append((b[0], b[1], box, before))
        rest = [d for d in done if d[1] != "reference"]
        gone = set()
        for i, a in enumerate(rest):
            if a[2][2] - a[2][0] < 6 or a[2][3] - a[2][1] < 6:
                gone.add(i)
            for j in range(i + 1, len(rest)):
                b = rest[j]
                if i in gone or j in gone:
                    continue
                part = shared(a[2], b[2]) / min(size(a[2]), size(b[2]))
                labels = {a[1], b[1]}
                if "inline_formula" in labels:
                    if part > 0.5:
                        gone |= {k for k, x in ((i, a), (j, b)) if x[1] == "inline_formula"}
                        continue
                if part > 0.7 and (mode == "rect" or poly.overlap(a[3], b[3], "small") >= 0.7):
                    apart = len(labels) > 1 and labels & {"image", "table", "seal", "chart"} and ("table" not in labels or labels <= {"image", "table", "seal", "chart"})
                    if not apart:
                        gone.add(j if size(a[2]) >= size(b[2]) else i)
        order = 0
        for i, r in enumerate(rest):
            if i not in gone:
                skip = r[1] in ops.UNORDERED
                order += not skip
                out[r[0]] = (r[1], tuple(r[2]), None if skip else order)
    return out


@pytest.mark.parametrize(("mode", "modes", "ratio"), [("rect", "union", (1.0, 1.0)), ("auto", "large", (1.1, 1.05)), ("poly", "union", (1.0, 1.2))])
def test_finished_pages(spark, mode, modes, ratio):
    rows = made(3) + [(4 + r[0], 9000 + r[1], *r[2:]) for r in made(8)]
    given = spark.createDataFrame([(*r[:9], [{"x": float(x), "y": float(y)} for x, y in r[9]]) for r in rows], ROW)
    pages = spark.createDataFrame([(p, 300, 400) for p in range(10)], "page long, width int, height int")
    got = {r["id"]: (r["label"], (r["x0"], r["y0"], r["x1"], r["y1"]), r["order"]) for r in ops.finished(given, pages, modes=modes, ratios=ratio, shape=mode).collect()}
    assert got == plain(rows, mode, modes, ratio) and len(got) > 20
    assert ops.finished(given.where("false"), pages).count() == 0


def test_modes_by_label(spark):
    rows = [(0, 1, "table", 0.9, 0.0, 0.0, 100.0, 100.0, 1, []), (0, 2, "text", 0.9, 10.0, 10.0, 40.0, 40.0, 2, []), (0, 3, "formula", 0.9, 12.0, 12.0, 20.0, 20.0, 3, []), (0, 4, "text", 0.9, 200.0, 0.0, 260.0, 50.0, 4, [])]
    given = spark.createDataFrame(rows, ROW)
    ids = lambda **k: sorted(r["id"] for r in ops.merged(given, **k).collect())
    assert ids(modes="large") == [1, 4] and ids(modes="large", formula="formula") == [1, 3, 4] and ids(modes="small") == [2, 3, 4]
    assert ids(modes={"table": "large"}) == [1, 4] and ids(modes={"text": "small"}) == [2, 3, 4] and ids(modes={"text": "union"}) == [1, 2, 3, 4]
    with pytest.raises(ValueError):
        ids(modes="none")


def test_shapes_in_order_are_those_of_one_after_the_other():
    rng = random.Random(4)
    boxes = [poly.rectangle(x, y, x + 40, y + 20) for x, y in ((rng.randrange(30), rng.randrange(30)) for _ in range(60))]
    turns = [rng.uniform(0, 0.6) for _ in boxes]
    given = [None if k % 7 == 0 else (b - b.mean(0)) @ np.array([[math.cos(t), math.sin(t)], [-math.sin(t), math.cos(t)]]) + b.mean(0) for k, (b, t) in enumerate(zip(boxes, turns, strict=True))]
    first = [k % 9 == 0 for k in range(60)]
    before, wanted = None, []
    for box, polygon, opens in zip(boxes, given, first, strict=True):
        before = poly.settled(box, polygon, None if opens else before)
        wanted.append(before)
    got = poly.settled_in_order(boxes, given, first)
    assert all(np.array_equal(a, b) for a, b in zip(wanted, got, strict=True)) and len({len(g) for g in got}) == 1


def test_steps_are_done_once(spark, capsys):
    rows = spark.range(40).selectExpr("id % 2 as page", "id", "'text' as label", "1.0 as score", "id * 1.0 as x0", "id * 30.0 as y0", "id + 50.0 as x1", "id * 30.0 + 20 as y1", "id as hint", f"cast(null as {ops.OUTLINE}) as outline")
    done = ops.finished(rows, spark.createDataFrame([(0, 900, 2000), (1, 900, 2000)], "page long, width int, height int"), modes="large")
    capsys.readouterr()
    done.explain()
    assert capsys.readouterr().out.count("Join") < 12 and done.count() == 40
