"""Raw boxes of a layout model to blocks of a page: thresholds, suppression, containment, shapes and order.

detections: page, id, label, score, x0, y0, x1, y1, hint (place that the model gives, or null) and
outline (array of struct x, y; null or empty where the model gives none). pages: page, width, height.
Pairs are found by a join that deals boxes by page and band of height; only pairs that conflict reach
the fold that decides them, page by page in the order of the boxes.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as geo
from ..functions import polygons
from .folds import folded
from .layout import meeting
from .trees import shared_table

#: Labels without a place in reading order, and those of pictures and tables.
UNORDERED = ("figure_title", "vision_footnote", "image", "chart", "table", "header", "header_image", "footer", "footer_image", "footnote", "aside_text")
PICTURES = ("image", "seal", "chart")
OUTLINE = "array<struct<x:double,y:double>>"


def by_label(values: Mapping[str, float], default: float | None) -> Column:
    """A label's value, or the default."""
    if not values:
        return F.lit(default)
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in values.items() for x in p)), F.col("label")), F.lit(default))


def likely(boxes: DataFrame, thresholds: Mapping[str, float] | None = None, default: float = 0.5) -> DataFrame:
    """Boxes with sides as whole numbers, halves to the even one, whose score is over their label's threshold."""
    return boxes.withColumns({c: F.rint(c) for c in ("x0", "y0", "x1", "y1")}).where(F.col("score") > by_label(thresholds or {}, default))


def fallen(conflicts: DataFrame) -> DataFrame:
    """(page, id) of the boxes that fall: conflicts (page, turn, next, a, b, a_falls, b_falls) count in the order of turn and next, where neither has fallen yet.

    b is null where a box falls by itself. A task holds the conflicts of its pages one after the other, not their boxes or pairs.
    """

    def fold(rows: pd.DataFrame, bounds: np.ndarray) -> pd.DataFrame:
        pages, out = [], []
        one, two = rows["a"].tolist(), rows["b"].tolist()
        alone, falls = rows["b"].isna().tolist(), list(zip(rows["a_falls"].tolist(), rows["b_falls"].tolist(), strict=True))
        for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            gone: set[int] = set()
            for i in range(start, end):
                a, b = one[i], None if alone[i] else int(two[i])
                if a not in gone and b not in gone:
                    gone.update(x for x, falls_ in zip((a, b), falls[i], strict=True) if falls_)
            pages.extend([rows["page"].iloc[start]] * len(gone))
            out.extend(sorted(gone))
        return pd.DataFrame({"page": pd.array(pages, dtype="Int64"), "id": pd.array(out, dtype="Int64")})

    return folded(conflicts, ["page"], ["turn", "next"], fold, "page long, id long")


def without(boxes: DataFrame, gone: DataFrame) -> DataFrame:
    return boxes.join(gone, ["page", "id"], "left_anti")


def suppressed(boxes: DataFrame, same: float = 0.6, other: float = 0.98) -> DataFrame:
    """Boxes without those that a better kept one covers by IoU of `same` of its own label or `other` of another; pixels count whole, ties to the lower id."""
    ranked = boxes.withColumn("rank", F.row_number().over(Window.partitionBy("page").orderBy(F.desc("score"), "id"))).select("page", "id", "label", "rank", "x0", "y0", "x1", "y1")
    pixels = lambda p: geo.Box(F.col(f"{p}x0"), F.col(f"{p}y0"), F.col(f"{p}x1") + 1, F.col(f"{p}y1") + 1)
    most = F.when(F.col("l_label") == F.col("b_label"), same).otherwise(other)
    pairs = meeting(ranked, ranked).where((F.col("l_rank") < F.col("b_rank")) & (geo.iou(pixels("l_"), pixels("b_")) >= most))
    found = pairs.select("page", F.col("l_rank").alias("turn"), F.col("b_rank").alias("next"), F.col("l_id").alias("a"), F.col("b_id").alias("b"), F.lit(False).alias("a_falls"), F.lit(True).alias("b_falls"))
    return without(boxes, fallen(found))


def without_page_images(boxes: DataFrame, pages: DataFrame, label: str = "image") -> DataFrame:
    """Boxes without images that fill a page, over 0.82 of one wider than high and 0.93 of another; a page keeps them where nothing else is left, or they are its only box."""
    a = geo.Box(F.greatest("x0", F.lit(0.0)), F.greatest("y0", F.lit(0.0)), F.least("x1", F.col("width").cast("double")), F.least("y1", F.col("height").cast("double")))
    fills = (F.col("label") == label) & (geo.width(a) * geo.height(a) > F.when(F.col("width") > F.col("height"), 0.82).otherwise(0.93) * F.col("width") * F.col("height"))
    rows = boxes.join(pages, "page").withColumn("_fills", fills)
    counted = rows.withColumn("_left", F.count_if(~F.col("_fills")).over(Window.partitionBy("page")))
    return counted.where("not _fills or _left = 0").select(*boxes.columns)


def merged(boxes: DataFrame, modes: str | Mapping[str, str] = "union", formula: str | None = None) -> DataFrame:
    """Boxes after merging: by `large` those inside another one go, by `small` those that hold another one and are in none; `union` keeps all.

    Inside: 0.9 of the box. A box of the label `formula` is inside only others of it. Modes by label look at the
    boxes of that label alone: what stands inside one of them (`large`), or what one of them is inside of (`small`).
    """
    if modes == "union":
        return boxes
    narrow = boxes.select("page", "id", "label", "x0", "y0", "x1", "y1")
    a, b = geo.box("l_"), geo.box("b_")
    inside = meeting(narrow, narrow).where((F.col("l_id") != F.col("b_id")) & (geo.area(a) > 0) & (geo.common_area(a, b) >= 0.9 * geo.area(a)))
    if formula is not None:
        inside = inside.where((F.col("l_label") != formula) | (F.col("b_label") == formula))

    def seen(pairs: DataFrame) -> DataFrame:
        held = pairs.select("page", F.col("l_id").alias("id"), F.lit(True).alias("held"), F.lit(False).alias("holds"))
        holds = pairs.select("page", F.col("b_id").alias("id"), F.lit(False).alias("held"), F.lit(True).alias("holds"))
        return held.unionByName(holds).groupBy("page", "id").agg(F.bool_or("held").alias("held"), F.bool_or("holds").alias("holds"))

    out = boxes
    for label, mode in (modes.items() if isinstance(modes, Mapping) else [(None, modes)]):
        if mode not in ("union", "large", "small"):
            raise ValueError(f"unknown mode: {mode}")
        if mode != "union":
            side = "b_label" if mode == "large" else "l_label"
            pairs = inside if label is None else inside.where(F.col(side) == label)
            out = without(out, seen(pairs).where("held" if mode == "large" else "holds and not held").select("page", "id"))
    return out


def shaped(boxes: DataFrame, mode: str = "auto") -> DataFrame:
    """Boxes, in the order of their hints (then of their scores and ids), with `place` from 1 and the outline that a block of the page is given.

    The shape of the box before takes part in the choice, so a page is folded in order, in one task, many pages a call.
    """
    by = Window.partitionBy("page").orderBy(F.col("hint").asc_nulls_last(), F.desc("score"), "id")
    rows = boxes.withColumn("place", F.row_number().over(by))
    if mode == "rect":
        corner = lambda x, y: F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
        return rows.withColumn("outline", F.array(corner("x0", "y0"), corner("x1", "y0"), corner("x1", "y1"), corner("x0", "y1")))

    def fold(part: pd.DataFrame, bounds: np.ndarray) -> pd.DataFrame:
        given = [None if o is None or not len(o) else _points(o) for o in part["outline"]]
        boxes = [polygons.rectangle(*sides) for sides in part[["x0", "y0", "x1", "y1"]].to_numpy(float)]
        first = np.zeros(len(part), bool)
        first[bounds[:-1]] = True
        shapes = polygons.settled_in_order(boxes, given, first, mode)
        return pd.DataFrame({"page": part["page"], "id": part["id"], "shape": [[{"x": x, "y": y} for x, y in s.tolist()] for s in shapes]})

    narrow = rows.select("page", "id", "place", "x0", "y0", "x1", "y1", "outline")
    shapes = folded(narrow, ["page"], ["place"], fold, f"page long, id long, shape {OUTLINE}")
    return rows.drop("outline").join(shapes, ["page", "id"]).withColumnRenamed("shape", "outline")


def unclipped(boxes: DataFrame, ratios: tuple[float, float] | Mapping[str, tuple[float, float]] | None) -> DataFrame:
    """Boxes whose width and height grow by the ratios about their centre, all or by label."""
    if not ratios:
        return boxes
    wide, high = (by_label({k: float(v[i]) for k, v in ratios.items()}, 1.0) if isinstance(ratios, Mapping) else F.lit(float(ratios[i])) for i in (0, 1))
    sides = {}
    for low, end, ratio in (("x0", "x1", wide), ("y0", "y1", high)):
        centre, half = (F.col(low) + F.col(end)) / 2, (F.col(end) - F.col(low)) * ratio / 2
        sides |= {low: centre - half, end: centre + half}
    return boxes.withColumns(sides)


def on_page(boxes: DataFrame, pages: DataFrame) -> DataFrame:
    """Boxes cut to their page, in whole numbers; those that have no area there go."""
    whole = lambda c: F.when(c < 0, F.ceil(c)).otherwise(F.floor(c)).cast("double")
    rows = boxes.join(pages, "page")
    cut = {c: whole(F.greatest(F.lit(0.0), F.col(c))) for c in ("x0", "y0")} | {c: whole(F.least(F.col(size).cast("double"), F.col(c))) for c, size in (("x1", "width"), ("y1", "height"))}
    return rows.withColumns(cut).where("x1 > x0 and y1 > y0").select(*boxes.columns)


def _points(outline: Sequence[Mapping[str, float]]) -> np.ndarray:
    return np.array([(p["x"], p["y"]) for p in outline], float).reshape(-1, 2)


@F.pandas_udf(T.DoubleType())
def outline_overlap(a: pd.Series, b: pd.Series) -> pd.Series:
    """What two outlines share, as a part of the smaller one."""
    return pd.Series(polygons.overlaps([_points(p) for p in a], [_points(q) for q in b], "small"))


def without_overlaps(boxes: DataFrame, mode: str = "auto", least: float = 6, share: float = 0.7, formula_share: float = 0.5) -> DataFrame:
    """Boxes of a page, by place, without references, those narrower or lower than `least`, and the smaller of two that overlap over `share` of it.

    Where both have outlines these must overlap so too. Inline formulas go where they overlap over `formula_share`.
    Pictures may overlap with other kinds; a table only with pictures.
    """
    rows = boxes.where("label <> 'reference'")
    narrow = rows.select("page", "id", "label", "place", "x0", "y0", "x1", "y1", *(["outline"] if mode != "rect" else []))
    a, b = geo.box("l_"), geo.box("b_")
    smaller = F.least(geo.area(a), geo.area(b))
    pairs = meeting(narrow, narrow).where("l_place < b_place").withColumn("part", F.when(smaller > 0, geo.common_area(a, b) / smaller).otherwise(0.0))
    l_formula, b_formula = F.col("l_label") == "inline_formula", F.col("b_label") == "inline_formula"
    formula = (l_formula | b_formula) & (F.col("part") > formula_share)
    two = F.array("l_label", "b_label")
    pictured = F.arrays_overlap(two, F.array(*map(F.lit, (*PICTURES, "table")))) & (F.col("l_label") != F.col("b_label"))
    may = pictured & (~F.array_contains(two, "table") | F.forall(two, lambda x: x.isin("table", *PICTURES)))
    pairs = pairs.where(formula | ((F.col("part") > share) & ~may))
    if mode != "rect":
        pairs = pairs.where(formula | (outline_overlap("l_outline", "b_outline") >= share))
    larger = geo.area(a) >= geo.area(b)
    found = pairs.select("page", F.col("l_place").alias("turn"), F.col("b_place").alias("next"), F.col("l_id").alias("a"), F.col("b_id").alias("b"), F.when(formula, l_formula).otherwise(~larger).alias("a_falls"), F.when(formula, b_formula).otherwise(larger).alias("b_falls"))
    small = rows.where((F.col("x1") - F.col("x0") < least) | (F.col("y1") - F.col("y0") < least)).select("page", F.col("place").alias("turn"), F.lit(-1).alias("next"), F.col("id").alias("a"), F.lit(None).cast("long").alias("b"), F.lit(True).alias("a_falls"), F.lit(False).alias("b_falls"))
    return without(rows, fallen(found.unionByName(small)))


def ordered(boxes: DataFrame, skipped: Sequence[str] = UNORDERED) -> DataFrame:
    """Boxes with `order`, their number among those of the page that have a place in reading order; null for the skipped labels."""
    counts = ~F.col("label").isin(*skipped)
    upto = F.count_if(counts).over(Window.partitionBy("page").orderBy("place"))
    return boxes.withColumn("order", F.when(counts, upto))


def finished(
    detections: DataFrame,
    pages: DataFrame,
    thresholds: Mapping[str, float] | None = None,
    threshold: float = 0.5,
    modes: str | Mapping[str, str] = "union",
    ratios: tuple[float, float] | Mapping[str, tuple[float, float]] | None = None,
    shape: str = "auto",
    formula: str | None = None,
    skipped: Sequence[str] = UNORDERED,
) -> DataFrame:
    """All steps in their order: page, id, label, score, box, place, outline and order of the blocks that stay.

    Each step reads the boxes several times, so they are written between the steps: else a step would do all before it as often.
    """
    boxes = shared_table(likely(detections, thresholds, threshold))
    boxes = shared_table(without_page_images(suppressed(boxes), pages))
    if modes != "union":
        boxes = shared_table(merged(boxes, modes, formula))
    boxes = shared_table(on_page(unclipped(shaped(boxes, shape), ratios), pages))
    return ordered(without_overlaps(boxes, shape), skipped)
