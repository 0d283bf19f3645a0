"""Line numbers at a page's margin: the ladders that they form, missing and misread rungs notwithstanding."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .folds import folded

#: Numbers count by fives; the bounds of a step against the lines it counts, without and with pictures or headings between.
STEP, LEAST, MOST, MOST_BROKEN = 5, 0.75, 1.25, 1.5


def line_pitch(words: DataFrame) -> DataFrame:
    """(page, pitch, size, rows, top, bottom) of pages by their words (page, y, size): the median distance of neighbouring rows.

    Words whose middles are within 0.6 of the page's median size of the row before are one row; only words of 0.8 of that size count.
    """
    sizes = words.groupBy("page").agg(F.median("size").alias("_size"))
    kept = words.join(sizes, "page").where("size >= 0.8 * _size")
    along = Window.partitionBy("page").orderBy("y")
    new = F.coalesce(F.col("y") - F.lag("y").over(along) > 0.6 * F.col("_size"), F.lit(True))
    rows = kept.withColumn("row", F.sum(new.cast("int")).over(along)).groupBy("page", "row").agg(F.median("y").alias("y"), F.first("_size").alias("size"))
    gap = F.col("y") - F.lag("y").over(along)
    near = F.when((gap > 0.8 * F.col("size")) & (gap < 2.4 * F.col("size")), gap)
    return rows.withColumn("gap", near).groupBy("page").agg(F.median("gap").alias("pitch"), F.first("size").alias("size"), F.count("*").alias("rows"), F.min("y").alias("top"), F.max("y").alias("bottom"))


def voted_pitch(y: np.ndarray, values: np.ndarray) -> float | None:
    """Height of a line that most pairs of rungs agree on within a tenth, each pair voting for its own; None without a pair that rises."""
    i, j = np.triu_indices(len(y), 1)
    up = values[j] - values[i]
    good = (up > 0) & (y[j] > y[i])
    if not good.any():
        return None
    votes = np.sort((y[j] - y[i])[good] / up[good])
    ends = np.searchsorted(votes, votes * 1.1, side="right")
    best = int(np.argmax(ends - np.arange(len(votes))))
    return float(np.median(votes[best : ends[best]]))


def best_ladder(y: np.ndarray, values: np.ndarray, pitch: float, blocked: np.ndarray) -> list[int]:
    """Indexes of the longest ladder down a margin: values rise by fives, and the heights with them by `pitch` a line.

    blocked: n x n, height of pictures and headings between two marks; where there is any, it is taken off
    and more is allowed. A rung may lack or be misread: any two marks may be neighbours. Of equal ladders the one with
    more plain steps, then the first.
    """
    if not len(y):
        return []
    count = [(1, 0)] * len(y)
    before = [-1] * len(y)
    y, values, blocked = y.tolist(), values.tolist(), blocked.tolist()
    for b in range(len(y)):
        for a in range(b):
            up = values[b] - values[a]
            if up <= 0 or up % STEP:
                continue
            wanted, there = up * pitch, y[b] - y[a]
            plain = LEAST * wanted <= there <= MOST * wanted
            broken = blocked[a][b] > 0 and LEAST * wanted <= there - blocked[a][b] <= MOST_BROKEN * wanted
            if (plain or broken) and (count[a][0] + 1, count[a][1] + plain) > count[b]:
                count[b], before[b] = (count[a][0] + 1, count[a][1] + plain), a
    at = max(range(len(y)), key=lambda k: (count[k], -k))
    out = []
    while at >= 0:
        out.append(at)
        at = before[at]
    return out[::-1]


def _edge_groups(x0: np.ndarray, x1: np.ndarray, reach: float) -> np.ndarray:
    """Numbers of groups of marks that share their left or their right edge within `reach`, neighbour by neighbour."""
    group = np.arange(len(x0))
    for edge in (x0, x1):
        order = np.argsort(edge, kind="stable")
        for p, q in zip(order[:-1], order[1:], strict=True):
            if edge[q] - edge[p] <= reach and group[p] != group[q]:
                group[group == group[q]] = group[p]
    return group


def ladders(marks: DataFrame, pitches: DataFrame, obstacles: DataFrame, least: int = 3, least_alone: int = 5) -> DataFrame:
    """marks with ladder (number within the page) and null where a mark is on none: what was misread, or a chance run.

    marks: page, id, side, value, x0, y0, x1, y1 of numbers beside the text. pitches: as line_pitch gives;
    without one for the page the pitch is voted by the marks, and a ladder needs `least_alone` rungs, a first one of 15 at most
    and a quarter of the page's marks' height. obstacles: page, y0, y1 of what stands between lines and is not counted.
    Two plain steps at least make a ladder. A page's marks are one task's; groups share a side and an edge.
    """
    things = obstacles.groupBy("page").agg(F.collect_list(F.struct("y0", "y1")).alias("things"))
    rows = marks.join(pitches.select("page", "pitch", "size"), "page", "left").join(things, "page", "left")

    def numbered(side: np.ndarray, value: np.ndarray, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray, given: float, size: float, boxes: np.ndarray) -> np.ndarray:
        """A page's marks, by side, height and id: the number of each one's ladder, or none."""
        found = np.full(len(side), np.nan)
        middle = (y0 + y1) / 2
        number = 0
        for name in sorted({s for s in side.tolist() if s is not None}):
            at = np.flatnonzero(side == name)
            if len(at) < least:
                continue
            reach = max(3.0, 0.65 * (size if size == size else float(np.median((y1 - y0)[at]))))
            groups = _edge_groups(x0[at], x1[at], reach)
            for g in dict.fromkeys(groups.tolist()):
                rest = at[groups == g]
                rest = rest[np.argsort(middle[rest], kind="stable")]
                while len(rest) >= least:
                    y, values = middle[rest], value[rest]
                    pitch = given if given == given else voted_pitch(y, values)
                    if pitch is None:
                        break
                    blocked = np.zeros((len(y), len(y)))
                    for low, high in boxes:
                        blocked += ((low > y[:, None]) & (high < y[None, :])) * (high - low)
                    way = best_ladder(y, values, pitch, blocked)
                    steps = [(y[b] - y[a]) / (values[b] - values[a]) for a, b in zip(way, way[1:], strict=False)]
                    plain = sum(LEAST * pitch <= s <= MOST * pitch for s in steps)
                    height = float(y1.max() - y0.min())
                    enough = len(way) >= least and plain >= 2 and (given == given or (len(way) >= least_alone and values[way[0]] <= 3 * STEP and y[way[-1]] - y[way[0]] >= height / 4))
                    if not enough:
                        break
                    number += 1
                    found[rest[way]] = number
                    rest = np.delete(rest, way)
        return found

    def run(rows: pd.DataFrame, bounds: np.ndarray) -> pd.DataFrame:
        side, value, x0, y0, x1, y1 = (rows[c].to_numpy() for c in ("side", "value", "x0", "y0", "x1", "y1"))
        pitch, size = (rows[c].to_numpy("float64", na_value=np.nan) for c in ("pitch", "size"))
        found = np.full(len(rows), np.nan)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= least:
                things = rows["things"].iat[a]
                boxes = np.zeros((0, 2)) if things is None else np.array([(t["y0"], t["y1"]) for t in things])
                found[a:b] = numbered(side[a:b], value[a:b], x0[a:b], y0[a:b], x1[a:b], y1[a:b], float(pitch[a]), float(size[a]), boxes)
        return rows[["page", "id"]].assign(ladder=pd.array(found, dtype="Int32"))

    narrow = rows.select("page", "id", "side", "value", "x0", "y0", "x1", "y1", "pitch", "size", "things")
    told = folded(narrow, ["page"], ["side", "y0", "id"], run, "page long, id long, ladder int")
    return marks.join(told, ["page", "id"], "left")
