"""Boxes as four columns x0, y0, x1, y1 (a prefix names the box); all arithmetic stays in the JVM."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box(NamedTuple):
    x0: Column
    y0: Column
    x1: Column
    y1: Column


def box(prefix: str = "") -> Box:
    return Box(*(F.col(f"{prefix}{c}") for c in ("x0", "y0", "x1", "y1")))


def width(a: Box) -> Column:
    return a.x1 - a.x0


def height(a: Box) -> Column:
    return a.y1 - a.y0


def area(a: Box) -> Column:
    return F.greatest(F.lit(0.0), width(a)) * F.greatest(F.lit(0.0), height(a))


def centre(a: Box) -> tuple[Column, Column]:
    return (a.x0 + a.x1) / 2, (a.y0 + a.y1) / 2


def overlap_x(a: Box, b: Box) -> Column:
    return F.greatest(F.lit(0.0), F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0))


def overlap_y(a: Box, b: Box) -> Column:
    return F.greatest(F.lit(0.0), F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0))


def common_area(a: Box, b: Box) -> Column:
    return overlap_x(a, b) * overlap_y(a, b)


def share_of(a: Box, b: Box) -> Column:
    """The part of `a` that lies in `b`; 0 for a box without area."""
    return F.when(area(a) == 0, F.lit(0.0)).otherwise(common_area(a, b) / area(a))


def iou(a: Box, b: Box) -> Column:
    union = area(a) + area(b) - common_area(a, b)
    return F.when(union == 0, F.lit(0.0)).otherwise(common_area(a, b) / union)


def holds(a: Box, x: Column, y: Column) -> Column:
    return (a.x0 <= x) & (x <= a.x1) & (a.y0 <= y) & (y <= a.y1)


def meets(a: Box, b: Box) -> Column:
    """The boxes share some area."""
    return (a.x0 < b.x1) & (b.x0 < a.x1) & (a.y0 < b.y1) & (b.y0 < a.y1)


def centre_distance(a: Box, b: Box, x_weight: float = 1.0, y_weight: float = 1.0, absolute: bool = False) -> Column:
    (ax, ay), (bx, by) = centre(a), centre(b)
    if absolute:
        return F.abs(ax - bx) * x_weight + F.abs(ay - by) * y_weight
    return F.sqrt((ax - bx) * (ax - bx) * x_weight + (ay - by) * (ay - by) * y_weight)


def corner_distance(a: Box, b: Box) -> Column:
    return F.sqrt((a.x0 - b.x0) * (a.x0 - b.x0) + (a.y0 - b.y0) * (a.y0 - b.y0))


def gap(a: Box, b: Box) -> Column:
    """0 for boxes that touch or overlap, else the shortest way between them."""
    dx = F.greatest(F.lit(0.0), b.x0 - a.x1, a.x0 - b.x1)
    dy = F.greatest(F.lit(0.0), b.y0 - a.y1, a.y0 - b.y1)
    return F.sqrt(dx * dx + dy * dy)


def grown(a: Box, by_x: float, by_y: float) -> Box:
    """Each side moved out by a fraction of the box."""
    dx, dy = width(a) * by_x, height(a) * by_y
    return Box(a.x0 - dx, a.y0 - dy, a.x1 + dx, a.y1 + dy)


def rescaled(a: Box, from_size: tuple, to_size: tuple) -> Box:
    sx, sy = F.lit(to_size[0]) / F.lit(from_size[0]), F.lit(to_size[1]) / F.lit(from_size[1])
    return Box(a.x0 * sx, a.y0 * sy, a.x1 * sx, a.y1 * sy)


def clipped(a: Box, b: Box) -> Box:
    """`a` held inside `b`."""
    hold = lambda v, low, high: F.least(F.greatest(v, low), high)
    return Box(hold(a.x0, b.x0, b.x1), hold(a.y0, b.y0, b.y1), hold(a.x1, b.x0, b.x1), hold(a.y1, b.y0, b.y1))


def reading_key(a: Box, tolerance: float = 1.25) -> tuple[Column, Column]:
    """Order of lines on a page: rows of `tolerance`, rounded half to even, then from the left."""
    return F.bround(a.y0 / tolerance) * tolerance, a.x0
