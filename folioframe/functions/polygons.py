"""Polygon algebra on numpy points (n x 2), y pointing down: areas, overlaps, outlines of masks, simpler outlines, least rectangles."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

Points = np.ndarray
#: Fixed value: pairs of sides that are compared at once.
AT_ONCE = 1 << 20


def rectangle(x0: float, y0: float, x1: float, y1: float) -> Points:
    return np.array([[x0, y0], [x1, y0], [x1, y1], [x0, y1]], float)


def _sides(points: np.ndarray) -> np.ndarray:
    """... x n x 4: each point with the next one."""
    return np.concatenate([points, np.roll(points, -1, axis=-2)], axis=-1)


def _crossings(sides: np.ndarray) -> np.ndarray:
    """Heights at which sides of a pair cross each other, k x n x n; nan where they do not, and for level ones and those of no length."""
    p, q = sides[:, :, None], sides[:, None]
    d, e = p[..., 2:] - p[..., :2], q[..., 2:] - q[..., :2]
    turn = d[..., 0] * e[..., 1] - d[..., 1] * e[..., 0]
    gap = q[..., :2] - p[..., :2]
    with np.errstate(divide="ignore", invalid="ignore"):
        t = (gap[..., 0] * e[..., 1] - gap[..., 1] * e[..., 0]) / turn
        u = (gap[..., 0] * d[..., 1] - gap[..., 1] * d[..., 0]) / turn
        hit = (turn != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1) & (d[..., 1] != 0) & (e[..., 1] != 0)
        return np.where(hit, p[..., 1] + t * d[..., 1], np.nan)


def _spans(sides: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sorted x at which the sides of each pair stand at its height y: inside from each odd one to the next; nan after the last."""
    y = y[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        at = sides[..., 0] + (y - sides[..., 1]) / (sides[..., 3] - sides[..., 1]) * (sides[..., 2] - sides[..., 0])
        met = (np.minimum(sides[..., 1], sides[..., 3]) < y) & (y < np.maximum(sides[..., 1], sides[..., 3]))
    return np.sort(np.where(met, at, np.nan), axis=1)


def _common_areas(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """common_area of pairs of polygons of the same numbers of points: k x n x 2 and k x m x 2."""
    p, q = _sides(a), _sides(b)
    both = np.concatenate([p, q], axis=1)
    steep = both[..., 1] != both[..., 3]
    top_of = lambda sides, level: np.where(level[..., None], sides[..., [1, 3]], np.inf).min((1, 2))
    low_of = lambda sides, level: np.where(level[..., None], sides[..., [1, 3]], -np.inf).max((1, 2))
    n = p.shape[1]
    low = np.maximum(top_of(p, steep[:, :n]), top_of(q, steep[:, n:]))
    high = np.minimum(low_of(p, steep[:, :n]), low_of(q, steep[:, n:]))
    ends = np.where(steep[..., None], both[..., [1, 3]], np.nan).reshape(len(both), -1)
    heights = np.concatenate([ends, _crossings(both).reshape(len(both), -1), low[:, None], high[:, None]], axis=1)
    with np.errstate(invalid="ignore"):
        heights = np.where((heights >= low[:, None]) & (heights <= high[:, None]), heights, np.nan)
    heights = np.sort(heights, axis=1)
    heights[:, 1:][heights[:, 1:] == heights[:, :-1]] = np.nan
    heights = np.sort(heights, axis=1)
    total = np.zeros(len(both))
    for k in range(int((~np.isnan(heights)).sum(1).max(initial=1)) - 1):
        top, bottom = heights[:, k], heights[:, k + 1]
        y = (top + bottom) / 2
        s, t = _spans(p, y), _spans(q, y)
        s, t = s[:, : s.shape[1] // 2 * 2], t[:, : t.shape[1] // 2 * 2]
        wide = np.minimum(s[:, 1::2, None], t[:, None, 1::2]) - np.maximum(s[:, ::2, None], t[:, None, ::2])
        total += np.nan_to_num(np.nansum(np.clip(wide, 0, None), axis=(1, 2)) * (bottom - top), nan=0.0)
    return total


def common_areas(a: Sequence[Points], b: Sequence[Points]) -> np.ndarray:
    """Area that the two polygons of each pair share, whatever their shape; where one crosses itself, odd turns are inside.

    Between the heights of corners and crossings no edges change places, so what is shared there are
    trapezoids, whose width at half height times the height is their area. Pairs of the same numbers of points go side by side.
    """
    out = np.zeros(len(a))
    forms: dict[tuple[int, int], list[int]] = {}
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        if len(x) and len(y):
            forms.setdefault((len(x), len(y)), []).append(i)
    for (n, m), rows in forms.items():
        step = max(1, AT_ONCE // (n + m) ** 2)
        for start in range(0, len(rows), step):
            some = rows[start : start + step]
            out[some] = _common_areas(np.array([a[i] for i in some], float), np.array([b[i] for i in some], float))
    return out


def common_area(a: Points, b: Points) -> float:
    return float(common_areas([a], [b])[0])


def area(points: Points) -> float:
    return common_area(points, points)


def overlaps(a: Sequence[Points], b: Sequence[Points], of: str = "union") -> np.ndarray:
    """What the two polygons of each pair share, as a part of their union, or of the smaller or the larger one; 0 where that has no area."""
    one, two, both = common_areas(a, a), common_areas(b, b), common_areas(a, b)
    whole = {"union": one + two - both, "small": np.minimum(one, two), "large": np.maximum(one, two)}[of]
    return np.divide(both, whole, out=np.zeros(len(both)), where=whole > 0)


def overlap(a: Points, b: Points, of: str = "union") -> float:
    return float(overlaps([a], [b], of)[0])


def hull(points: Points) -> Points:
    """The convex hull's corners, clockwise as seen with y down."""
    given = np.unique(np.asarray(points, float), axis=0)
    if len(given) < 3:
        return given

    def half(rows: Points) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for r in rows:
            while len(out) > 1 and np.linalg.det(np.array([out[-1] - out[-2], r - out[-1]])) <= 0:
                out.pop()
            out.append(r)
        return out

    lower, upper = half(given), half(given[::-1])
    return np.array(lower[:-1] + upper[:-1])


def least_rectangle(points: Points) -> Points | None:
    """The four corners of the least rectangle, turned as need be, that holds all points: clockwise from the one nearest to the top left. None where the points have no area.

    One of its sides lies on a side of the hull, so each is tried.
    """
    corners = hull(points)
    if len(corners) < 3:
        return None
    along = np.roll(corners, -1, axis=0) - corners
    along /= np.linalg.norm(along, axis=1, keepdims=True)
    across = np.stack([-along[:, 1], along[:, 0]], 1)
    u, v = along @ corners.T, across @ corners.T
    best = int(np.argmin((u.max(1) - u.min(1)) * (v.max(1) - v.min(1))))
    low_u, high_u, low_v, high_v = u[best].min(), u[best].max(), v[best].min(), v[best].max()
    out = np.array([x * along[best] + y * across[best] for x, y in ((low_u, low_v), (high_u, low_v), (high_u, high_v), (low_u, high_v))])
    return np.roll(out, -int(np.argmin(out.sum(1))), axis=0)


def simplified(points: Points, reach: float) -> Points:
    """A closed outline without the points that lie within `reach` of the line between those that stay."""
    points = np.asarray(points, float)
    if len(points) < 4:
        return points
    far = int(np.argmax(np.linalg.norm(points - points[0], axis=1)))
    ring = np.vstack([points, points[:1]])
    keep = np.zeros(len(ring), bool)
    keep[[0, far, len(points)]] = True
    todo = [(0, far), (far, len(points))]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        line, rest = ring[b] - ring[a], ring[a + 1 : b] - ring[a]
        size = np.hypot(*line)
        off = np.abs(line[0] * rest[:, 1] - line[1] * rest[:, 0]) / size if size else np.hypot(*rest.T)
        worst = int(np.argmax(off))
        if off[worst] > reach:
            keep[a + 1 + worst] = True
            todo += [(a, a + 1 + worst), (a + 1 + worst, b)]
    return points[keep[:-1]]


def outline(mask: np.ndarray) -> Points | None:
    """The outer outline of a mask's largest region, along the pixels' borders, clockwise; regions that meet at a corner are two.

    Border steps keep the region on their right; at a corner where four meet, the step turns right.
    """
    cells = np.pad(np.asarray(mask, bool), 1)
    if not cells.any():
        return None
    steps: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for dy, dx, at, way in ((-1, 0, (0, 0), (1, 0)), (0, 1, (1, 0), (0, 1)), (1, 0, (1, 1), (-1, 0)), (0, -1, (0, 1), (0, -1))):
        ys, xs = np.nonzero(cells & ~np.roll(cells, (-dy, -dx), (0, 1)))
        for y, x in zip((ys - 1).tolist(), (xs - 1).tolist(), strict=True):
            steps.setdefault((x + at[0], y + at[1]), []).append(way)
    best, size = None, 0.0
    while steps:
        here = start = min(steps)
        way, ring = steps[here][0], []
        while True:
            choices = steps[here]
            right = (-way[1], way[0])
            taken = right if right in choices and ring else way if way in choices else choices[0]
            choices.remove(taken)
            if not choices:
                del steps[here]
            if not ring or taken != way:
                ring.append(here)
            way, here = taken, (here[0] + taken[0], here[1] + taken[1])
            if here == start:
                break
        points = np.array(ring, float)
        x, y = points.T
        turned = float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum()) / 2  # holes turn the other way
        if turned > size:
            best, size = points, turned
    return best


def walked(points: Points, longest: float, flat: float = 120, sharp: float = 45) -> Points:
    """An outline's leading corners: those that stand out, and runs of two or more that go in at `flat` degrees or wider.

    Where two that stay are farther apart than `longest`, corners between them stay too, evenly; a corner that stands out
    at `sharp` degrees is moved inwards by the mean length of its sides. points: clockwise.
    """
    points = np.asarray(points, float)
    n = len(points)
    back, on = np.roll(points, 1, axis=0) - points, np.roll(points, -1, axis=0) - points
    sizes = np.linalg.norm(back, axis=1), np.linalg.norm(on, axis=1)
    if not all(s.all() for s in sizes):
        return points
    unit_back, unit_on = back / sizes[0][:, None], on / sizes[1][:, None]
    angle = np.degrees(np.arccos(np.clip((unit_back * unit_on).sum(1), -1, 1)))
    out = on[:, 1] * -back[:, 0] - on[:, 0] * -back[:, 1] > 0
    # a corner that goes in beside another one, the ring closed
    paired = ~out & (~np.roll(out, 1) | ~np.roll(out, -1))
    stay = np.flatnonzero(out | (paired & (angle >= flat)))
    if not len(stay):
        return points
    kept = set(stay.tolist())
    for a, b in zip(stay, np.roll(stay, -1), strict=True):
        far = float(np.hypot(*(points[a] - points[b])))
        between = [(a + k) % n for k in range(1, (b - a) % n or n)]
        if far > longest and between:
            wanted = int(np.ceil(far / longest)) - 1
            kept.update(int(between[min(k * len(between) // wanted, len(between) - 1)]) for k in range(min(wanted, len(between))))
    moved = points.copy()
    pointed = out & (np.abs(angle - sharp) < 1)
    inward = unit_back + unit_on
    inward /= np.maximum(np.linalg.norm(inward, axis=1, keepdims=True), 1e-12)
    moved[pointed] += (inward * ((sizes[0] + sizes[1]) / 2)[:, None])[pointed]
    return moved[sorted(kept)]


def mask_polygon(mask: np.ndarray, longest: float, fine: float = 0.004) -> Points | None:
    """A mask's polygon: its outline, simpler by `fine` of its length, and its leading corners."""
    ring = outline(mask)
    if ring is None:
        return None
    length = float(np.linalg.norm(np.roll(ring, -1, axis=0) - ring, axis=1).sum())
    return walked(simplified(ring, fine * length), 0.3 * longest)


def settled_in_order(boxes: Sequence[Points], polygons: Sequence[Points | None], first: Sequence[bool], mode: str = "auto") -> list[Points]:
    """The shapes that blocks are given, one after the other: their box (`rect`), polygon (`poly`), least rectangle (`quad`) or, by `auto`, what fits. first: no block stands before.

    auto: the box where it is nearly the least rectangle; that rectangle where the polygon fills it and the block before
    does not reach into the box; else the polygon. A polygon of under four corners is no shape.
    Which rectangles fill is told for all blocks at once, as is how far the shapes that the block before may have reach.
    """
    if mode not in ("rect", "poly", "quad", "auto"):
        raise ValueError(f"unknown shape: {mode}")
    out: list[Points] = list(boxes)
    if mode == "rect":
        return out
    given = [i for i, p in enumerate(polygons) if p is not None and len(p) >= 4]
    quads = {i: least_rectangle(polygons[i]) for i in given} if mode != "poly" else {}
    if mode == "quad":
        for i, quad in quads.items():
            out[i] = boxes[i] if quad is None else quad
        return out
    for i in given:
        out[i] = polygons[i]
    if mode == "poly":
        return out
    known = [i for i in given if quads[i] is not None]
    boxed = overlaps([boxes[i] for i in known], [quads[i] for i in known]) >= 0.95
    for i in np.array(known, int)[boxed].tolist():
        out[i] = boxes[i]
    turned = np.array(known, int)[~boxed].tolist()
    filled = overlaps([polygons[i] for i in turned], [quads[i] for i in turned]) >= 0.8
    pending = set(np.array(turned, int)[filled].tolist())
    # the block before is its rectangle or its polygon where that is open too, else what it is now
    asked = [(i, shape) for i in sorted(pending) if not first[i] for shape in ([out[i - 1], quads[i - 1]] if i - 1 in pending else [out[i - 1]])]
    reach: dict[int, list[bool]] = {}
    for (i, _), part in zip(asked, overlaps([shape for _, shape in asked], [boxes[i] for i, _ in asked], "small"), strict=True):
        reach.setdefault(i, []).append(bool(part < 0.01))
    as_quad: set[int] = set()
    for i in sorted(pending):
        if first[i] or reach[i][1 if i - 1 in as_quad else 0]:
            as_quad.add(i)
    for i in as_quad:
        out[i] = quads[i]
    return out


def settled(box: Points, polygon: Points | None, before: Points | None, mode: str = "auto") -> Points:
    """The shape of one block, whatever the shape of the one before."""
    if before is None:
        return settled_in_order([box], [polygon], [True], mode)[0]
    return settled_in_order([before, box], [None, polygon], [True, False], mode)[1]
