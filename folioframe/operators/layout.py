"""Spatial joins and groupings of boxes on a page.

Rows carry `page` and a box; a join always has the page as its equality, so it is dealt by page and
the overlap tests are the rest of the condition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as geo

SIDES = ("x0", "y0", "x1", "y1")


def _with(prefix: str, rows: DataFrame) -> DataFrame:
    return rows.select([F.col(c).alias(c if c == "page" else prefix + c) for c in rows.columns])


#: Height of the bands of a page by which boxes meet.
BAND = 64.0


def _banded(rows: DataFrame, low: Column, high: Column, name: str) -> DataFrame:
    """A row for each band between two heights, with the first one."""
    first = F.floor(low / BAND)
    return rows.withColumn(f"{name}_first", first).withColumn("band", F.explode(F.sequence(first, F.greatest(first, F.floor(high / BAND)))))


def meeting(left: DataFrame, right: DataFrame, reach: Column | None = None) -> DataFrame:
    """Pairs of a page whose boxes (l_ and b_) meet, or come as near as `reach` of the left one.

    Rows are dealt by page and band of height, and the test is part of the join, so neither a page with very many boxes nor one
    whose boxes do not meet yields all its pairs; a pair that shares bands counts in the first of them.
    """
    grow = F.lit(0.0) if reach is None else reach
    a = _banded(_with("l_", left).withColumn("l_reach", grow), F.col("l_y0") - F.col("l_reach"), F.col("l_y1") + F.col("l_reach"), "l")
    b = _banded(_with("b_", right), F.col("b_y0"), F.col("b_y1"), "b")
    near = (F.col("b_x0") <= F.col("l_x1") + F.col("l_reach")) & (F.col("b_x1") >= F.col("l_x0") - F.col("l_reach")) & (F.col("b_y0") <= F.col("l_y1") + F.col("l_reach")) & (F.col("b_y1") >= F.col("l_y0") - F.col("l_reach"))
    b = b.withColumnsRenamed({"page": "b_page", "band": "b_band"})
    on = (F.col("page") == F.col("b_page")) & (F.col("band") == F.col("b_band")) & (F.col("band") == F.greatest("l_first", "b_first")) & near
    return a.join(b, on).drop("band", "b_band", "b_page", "l_first", "b_first")


def best_overlap(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """page, line, block, area: the block that covers most of each line; ties to the first block."""
    a, b = geo.box("l_"), geo.box("b_")
    pairs = meeting(lines, blocks).withColumn("area", geo.common_area(a, b))
    best = F.max_by(F.struct(F.col("b_id").alias("block"), "area"), F.struct("area", -F.col("b_id")))
    return pairs.where("area > 0").groupBy("page", F.col("l_id").alias("line")).agg(best.alias("best")).select("page", "line", "best.block", "best.area")


def nearest_block(lines: DataFrame, blocks: DataFrame, x_weight: float = 5.0, most: float = 20.0) -> DataFrame:
    """page, line, block, distance: the block of the nearest centre, x counting more, nearer than `most`; null where there is none."""
    a, b = geo.box("l_"), geo.box("b_")
    middle = lambda rows: rows.select("page", "id", *SIDES, ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"))
    left = _with("l_", middle(lines)).withColumn("band", F.floor(F.col("l_cy") / most))
    right = _with("b_", middle(blocks)).withColumn("band", F.explode(F.sequence(F.floor(F.col("b_cy") / most) - 1, F.floor(F.col("b_cy") / most) + 1)))
    distance = geo.centre_distance(a, b, x_weight)
    pairs = left.join(right, ["page", "band"]).withColumn("distance", distance).where(F.col("distance") < most)
    best = F.min_by(F.struct(F.col("b_id").alias("block"), "distance"), F.struct("distance", "b_id"))
    found = pairs.groupBy("page", F.col("l_id").alias("line")).agg(best.alias("best")).select("page", "line", "best.block", "best.distance")
    return lines.select("page", F.col("id").alias("line")).distinct().join(found, ["page", "line"], "left")


def leftovers(assigned: DataFrame) -> DataFrame:
    """Lines without a block in runs of neighbours: page, first, last, n: each run is a new block."""
    alone = assigned.where("block is null")
    island = F.col("line") - F.row_number().over(Window.partitionBy("page").orderBy("line"))
    return alone.withColumn("island", island).groupBy("page", "island").agg(F.min("line").alias("first"), F.max("line").alias("last"), F.count("*").alias("n")).drop("island")


def smallest_holder(points: DataFrame, blocks: DataFrame) -> DataFrame:
    """page, point, block: the smallest box that holds the centre, ties to the first; null where none does."""
    x, y = geo.centre(geo.box())
    centres = points.select("page", "id", x.alias("x0"), y.alias("y0"), x.alias("x1"), y.alias("y1"))
    held = meeting(centres, blocks).groupBy("page", F.col("l_id").alias("point")).agg(F.min_by("b_id", F.struct(geo.area(geo.box("b_")), "b_id")).alias("block"))
    return points.select("page", F.col("id").alias("point")).distinct().join(held, ["page", "point"], "left")


def contained_best(items: DataFrame, blocks: DataFrame, least: float = 0.5) -> DataFrame:
    """page, item, block: the block that holds the largest share of an item, at least `least`; else null."""
    a, b = geo.box("l_"), geo.box("b_")
    pairs = meeting(items, blocks).withColumn("score", geo.share_of(a, b)).where(F.col("score") >= least)
    found = pairs.groupBy("page", F.col("l_id").alias("item")).agg(F.max_by("b_id", F.struct("score", -F.col("b_id"))).alias("block"))
    return items.select("page", F.col("id").alias("item")).distinct().join(found, ["page", "item"], "left")


def matched(truth: DataFrame, predicted: DataFrame, least: float = 0.5) -> DataFrame:
    """The truth boxes that some predicted box of the page matches by IoU."""
    b = geo.Box(*(F.col(f"b_{c}") for c in ("x0", "y0", "x1", "y1")))
    there = _with("b_", predicted)
    return truth.join(there, (truth["page"] == there["page"]) & geo.meets(geo.box(), b) & (geo.iou(geo.box(), b) >= least), "left_semi")


def outside(children: DataFrame, holders: DataFrame, share: float = 0.95) -> DataFrame:
    """The children of which no holder on the page covers at least `share`."""
    b = geo.Box(*(F.col(f"b_{c}") for c in ("x0", "y0", "x1", "y1")))
    there = _with("b_", holders)
    return children.join(there, (children["page"] == there["page"]) & geo.meets(geo.box(), b) & (geo.share_of(geo.box(), b) >= share), "left_anti")


def least_gap(blocks: DataFrame) -> DataFrame:
    """page, id, gap: the least gap to another block of the page."""
    a, b = geo.box("l_"), geo.box("b_")
    pairs = _with("l_", blocks).join(_with("b_", blocks), "page").where("l_id <> b_id")
    return pairs.groupBy("page", F.col("l_id").alias("id")).agg(F.min(geo.gap(a, b)).alias("gap"))


def page_bounds(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("page").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count("*").alias("n"))


def reading_order(lines: DataFrame) -> DataFrame:
    """page, id and its place from 1, by rows of 1.25 and then from the left."""
    row, x = geo.reading_key(geo.box())
    return lines.select("page", "id", F.row_number().over(Window.partitionBy("page").orderBy(row, x, "id")).alias("place"))


def zone_order(blocks: DataFrame, kind: Column) -> DataFrame:
    """Headers first, footers and then footnotes last; within a zone from the top and the left."""
    zone = F.when(kind == "PageHeader", 0).when(kind == "PageFooter", 2).when(kind == "Footnote", 3).otherwise(1)
    return blocks.withColumn("place", F.row_number().over(Window.partitionBy("page").orderBy(zone, "y0", "x0", "id")))


def list_groups(blocks: DataFrame, page_height: float, share: float = 0.1) -> DataFrame:
    """Runs of neighbouring list items whose gap is under `share` of the page: page, first, n; a run of one is text."""
    along = Window.partitionBy("page").orderBy("y0", "id")
    gap = F.col("y0") - F.lag("y1").over(along)
    starts = (F.lag("kind").over(along) != "ListItem") | (gap >= share * page_height)
    runs = blocks.withColumn("new", F.coalesce(starts, F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(along)).where("kind = 'ListItem'")
    return runs.groupBy("page", "run").agg(F.min_by("id", F.struct("y0", "id")).alias("first"), F.count("*").alias("n")).drop("run")


def caption_pairs(blocks: DataFrame, page_height: float, share: float = 0.05) -> DataFrame:
    """Captions and the table or picture just above or, failing that, below them, within `share` of the page."""
    along = Window.partitionBy("page").orderBy("y0", "id")
    kinds = ("Table", "Picture", "Figure")
    above = F.lag("kind").over(along).isin(*kinds) & (F.col("y0") - F.lag("y1").over(along) < share * page_height)
    below = F.lead("kind").over(along).isin(*kinds) & (F.lead("y0").over(along) - F.col("y1") < share * page_height)
    owner = F.when(above, F.lag("id").over(along)).when(below, F.lead("id").over(along))
    return blocks.withColumn("owner", owner).where("kind = 'Caption' and owner is not null").select("page", F.col("id").alias("caption"), "owner")


def caption_groups(blocks: DataFrame, pages: DataFrame, share: float = 0.05) -> DataFrame:
    """(page, owner, kind, members, box): tables, figures and pictures with the captions and footnotes next to them in order, within `share` of the page's height.

    blocks: page, id, ord, kind, box. What a block has taken from behind it is not there for the next one any more.
    """
    owners, notes = ("Table", "Figure", "Picture"), ("Caption", "Footnote")
    along = Window.partitionBy("page").orderBy("ord")
    sides = ("id", "kind", "x0", "y0", "x1", "y1")
    rows = blocks.join(pages.select("page", "height"), "page").withColumns({f"{p}_{c}": F.lag(c, n).over(along) for p, n in (("a", 1), ("aa", 2), ("b", -1)) for c in sides})
    box = lambda p: geo.Box(*(F.col(f"{p}{c}") for c in sides[2:]))
    near = lambda p, q: F.coalesce(geo.gap(box(p), box(q)) < share * F.col("height"), F.lit(False))
    is_note, is_owner = (lambda p: F.coalesce(F.col(f"{p}_kind").isin(*notes), F.lit(False))), (lambda p: F.coalesce(F.col(f"{p}_kind").isin(*owners), F.lit(False)))
    taken = is_owner("aa") & near("aa_", "a_")
    before, after = is_note("a") & near("a_", "") & ~taken, is_note("b") & near("b_", "")
    found = rows.where(F.col("kind").isin(*owners)).withColumns({"_before": before, "_after": after}).where("_before or _after")
    members = F.filter(F.array(F.when(F.col("_before"), F.col("a_id")), F.col("id"), F.when(F.col("_after"), F.col("b_id"))), lambda x: x.isNotNull())
    side = lambda c, pick: pick(F.col(c), F.when(F.col("_before"), F.col(f"a_{c}")).otherwise(F.col(c)), F.when(F.col("_after"), F.col(f"b_{c}")).otherwise(F.col(c))).alias(f"group_{c}")
    return found.select("page", F.col("id").alias("owner"), F.concat("kind", F.lit("Group")).alias("kind"), members.alias("members"), *(side(c, F.least if c[1] == "0" else F.greatest) for c in sides[2:]))


def _tamed(x: Column, y: Column) -> tuple[Column, Column]:
    """A point with a null, a NaN or an infinite part as one of the few that is as far from every anchor."""
    null, nan, beyond = x.isNull() | y.isNull(), F.isnan(x) | F.isnan(y), lambda c: F.abs(c) == float("inf")
    side = lambda c: F.when(null, None).when(nan, float("nan")).when((beyond(x) | beyond(y)) & ~beyond(c), 0.0).otherwise(c)
    return side(x), side(y)


def nearest_anchor(points: DataFrame, anchors: DataFrame, by: str, each: int = 2) -> DataFrame:
    """id and the nearest anchor (anchor, ax, ay) of its group, ties to the lower one; anchors at no or an endless distance come last.

    Points and anchors of one place are one. A group's box is cut into squares of `each` anchors in the mean; what a point meets in its
    own and the eight squares around is the nearest if it is nearer than a square is wide. Points that are left go on with squares twice
    as wide, and the last of them, and those without a distance, meet all anchors of their group.
    """
    from .trees import shared_table

    x, y = _tamed(F.col("x").cast("double"), F.col("y").cast("double"))
    spots = shared_table(points.where(F.col(by).isNotNull()).select(by, "id", x.alias("x"), y.alias("y")))
    ax, ay = _tamed(F.col("ax").cast("double"), F.col("ay").cast("double"))
    known = shared_table(anchors.where(F.col(by).isNotNull()).groupBy(by, ax.alias("ax"), ay.alias("ay")).agg(F.min("anchor").alias("anchor")))
    finite = lambda *c: F.coalesce(sum((F.abs(F.col(x)) for x in c), F.lit(0.0)) < float("inf"), F.lit(False))
    asked = spots.select(by, "x", "y").distinct()
    placed = asked.where(finite("x", "y")).select(by, "x", "y", F.lit(0).alias("n")).unionByName(known.where(finite("ax", "ay")).select(by, F.col("ax").alias("x"), F.col("ay").alias("y"), F.lit(1).alias("n")))
    span = F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"))
    cut = F.ceil(F.sqrt(F.sum("n") / each))
    boxes = shared_table(placed.groupBy(by).agg(F.min("x").alias("lx"), F.min("y").alias("ly"), cut.alias("cut"), (F.when((span > 0) & (span < float("inf")), span).otherwise(1.0) / F.greatest(cut, F.lit(1))).alias("wide")))
    away = lambda a: (F.col("x") - a["ax"]) * (F.col("x") - a["ax"]) + (F.col("y") - a["ay"]) * (F.col("y") - a["ay"])
    best = F.array_min(F.transform("near", lambda a: F.struct(away(a).isNull().alias("none"), away(a).alias("d"), a["anchor"].alias("anchor"))))
    listed = F.collect_list(F.struct("ax", "ay", "anchor")).alias("near")
    most = boxes.agg(F.max("cut")).first()[0] or 0
    left, done, times = asked, [], 1
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while times < most:
        wide = F.col("wide") * times
        square = lambda c, low: F.floor((F.col(c) - F.col(low)) / wide)  # noqa: B023, E731
        around = lambda c, low: F.explode(F.sequence(square(c, low) - 1, square(c, low) + 1))
        there = known.where(finite("ax", "ay")).join(boxes, by).withColumn("sx", around("ax", "lx")).withColumn("sy", around("ay", "ly")).groupBy(by, "sx", "sy").agg(listed)
        here = left.join(boxes, by, "left").withColumns({"sx": square("x", "lx"), "sy": square("y", "ly")})
        here = here.repartition(tasks, by, "sx", "sy")  # few rows that meet many: not put together again
        # written before it is read, as Spark would else search the list anew for each use of the best
        met = shared_table(here.join(there, [by, "sx", "sy"], "left").select(by, "x", "y", wide.alias("reach"), best.alias("best")))
        near = F.coalesce(finite("x", "y") & (F.col("best.d") < F.pow(F.col("reach") * 0.999, 2)), F.lit(False))  # a little less, for squares told by rounded numbers
        met = met.select(by, "x", "y", "best.anchor", near.alias("found"))
        done.append(met.where("found").select(by, "x", "y", "anchor"))
        left, times = met.where("not found").select(by, "x", "y"), times * 2
    found = left.join(known.groupBy(by).agg(listed), by).select(by, "x", "y", best["anchor"].alias("anchor"))
    for some in done:
        found = found.unionByName(some)
    found = found.select(F.col(by).alias("f_by"), F.col("x").alias("fx"), F.col("y").alias("fy"), "anchor")
    return spots.join(found, (F.col(by) == F.col("f_by")) & F.col("x").eqNullSafe(F.col("fx")) & F.col("y").eqNullSafe(F.col("fy"))).select("id", "anchor")


def height_figures(blocks: DataFrame, by: str, height: str) -> DataFrame:
    """Mean, median and mode (the lowest of equals) of a group's heights: what heading levels and body size are told from."""
    return blocks.groupBy(by).agg(F.avg(height).alias("mean"), F.median(height).alias("median"), F.mode(height, True).alias("mode"))
