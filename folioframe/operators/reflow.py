"""A body reflowed around the marks at its margin: blocks are cut at marked lines, and everything gets a place between its old neighbours.

Only windows over the lines of a block and joins by page and band of height; no page is numbered anew.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .trees import shared_table


def marked_lines(margins: DataFrame, lines: DataFrame, reach: float = 18.0, tasks: int | None = None) -> DataFrame:
    """margins (page, id, cx, cy) with block and line of the nearest line (page, block, line, cy) of a text, `reach` away at most; null for others. Ties go to the first line.

    Both sides are dealt by page and band of height as high as the reach, so a line meets the margins of three bands only.
    """
    there = lines.select(F.col("page").alias("p"), F.col("block").alias("b"), F.col("line").alias("l"), F.col("cy").alias("ly"), F.floor(F.col("cy") / reach).alias("lband"))
    near = margins.select("page", "id", "cy", F.explode(F.sequence(F.floor(F.col("cy") / reach) - 1, F.floor(F.col("cy") / reach) + 1)).alias("band"))
    away = F.abs(F.col("ly") - F.col("cy"))
    if tasks:
        near, there, margins = near.repartition(tasks, "page", "band"), there.repartition(tasks, "p", "lband"), margins.repartition(tasks, "page", "id")
    met = near.join(there, (F.col("page") == F.col("p")) & (F.col("band") == F.col("lband"))).where(away <= reach)
    best = met.groupBy("page", "id").agg(F.min_by(F.struct("b", "l"), F.struct(away, "ly", "b", "l")).alias("at"))
    return margins.join(best, ["page", "id"], "left").select(*margins.columns, F.col("at.b").alias("block"), F.col("at.l").alias("line"))


def reflowed(blocks: DataFrame, lines: DataFrame, margins: DataFrame, reach: float = 18.0, tasks: int | None = None) -> DataFrame:
    """(page, kind, id, block, first, last, at) of what a page holds, in the order of `at`: whole blocks, pieces of blocks, and margin marks.

    blocks: page, id, ord, type, cy. lines: page, block, line (from 0), cy. margins: page, id, cx, cy.
    A text is cut before each line that marks stand at: they come between the piece before and the piece that
    starts with the line. Pieces are named by their block and number. A mark that no line is near stands
    before or after the block or piece nearest in height, whichever side it is on, headers and footers left out.
    What is read several times is written between the steps, and large tables are dealt to `tasks` tasks (the
    session's number if null), so that a task holds few sorts of few rows.
    """
    dealt = lambda rows, *by: rows.repartition(*([tasks] if tasks else []), *by)
    order = dealt(blocks.select("page", F.col("id").alias("block"), "ord", "type", F.col("cy").alias("own_cy")), "page", "block")
    texts = order.where("type = 'Text'")
    marked = shared_table(marked_lines(margins, dealt(lines, "page", "block").join(texts.select("page", "block"), ["page", "block"]), reach, tasks))
    held = marked.where("block is not null").groupBy("page", "block").agg(F.collect_set("line").alias("cut_at"))
    along = Window.partitionBy("page", "block").orderBy("line")
    cut = F.coalesce(F.array_contains("cut_at", F.col("line")), F.lit(False)).cast("int")
    pieces = dealt(lines, "page", "block").join(texts.join(held, ["page", "block"]), ["page", "block"]).withColumn("piece", F.sum(cut).over(along))
    spans = pieces.groupBy("page", "block", "ord", "type", "piece").agg(F.min("line").alias("first"), F.max("line").alias("last"), F.avg("cy").alias("cy"))
    # at a line: its marks (0), marks before what starts there (1), that (2), marks after it (3)
    nothing = F.lit(None)
    place = lambda line, kind: F.struct(F.col("ord").cast("double").alias("ord"), line.cast("long").alias("line"), F.lit(kind).alias("kind"), F.lit(0.0).alias("y"), F.lit(0.0).alias("x"), F.lit(0).cast("long").alias("id"))
    cut_blocks = spans.select("page", F.lit("piece").alias("kind"), F.concat(F.col("block").cast("string"), F.lit("/"), F.dense_rank().over(Window.partitionBy("page", "block").orderBy("first"))).alias("id"), "block", "first", "last", place(F.col("first"), 2).alias("at"), "cy", "type")
    whole = order.join(held, ["page", "block"], "left_anti").select("page", F.lit("block").alias("kind"), F.col("block").cast("string").alias("id"), "block", nothing.cast("int").alias("first"), nothing.cast("int").alias("last"), place(F.lit(0), 2).alias("at"), F.col("own_cy").alias("cy"), "type")
    body = shared_table(cut_blocks.unionByName(whole))
    at_line = marked.where("block is not null").join(order, ["page", "block"])
    mark = lambda at: [F.col("page"), F.lit("mark").alias("kind"), F.col("id").cast("string").alias("id"), F.col("block"), nothing.cast("int").alias("first"), nothing.cast("int").alias("last"), at.alias("at")]
    ordered = lambda ord_, line, kind: F.struct(ord_.cast("double").alias("ord"), line.cast("long").alias("line"), kind.alias("kind"), F.col("cy").cast("double").alias("y"), F.col("cx").cast("double").alias("x"), F.col("id").cast("long").alias("id"))
    placed = at_line.select(*mark(ordered(F.col("ord"), F.col("line"), F.lit(0))))
    beside = beside_nearest(marked.where("block is null").drop("block", "line"), body, dealt)
    side = F.when(F.col("cy") > F.col("n.n_cy"), 3).otherwise(1)
    loose = beside.withColumn("block", F.col("n.block")).select(*mark(ordered(F.coalesce("n.n_at.ord", F.lit(-1.0)), F.coalesce("n.n_at.line", F.lit(0)), side)))
    return body.drop("cy", "type").unionByName(placed).unionByName(loose)


def beside_nearest(free: DataFrame, body: DataFrame, dealt: Callable[..., DataFrame]) -> DataFrame:
    """free marks with n (n_at, block, n_cy), the part of their page nearest in height, ties to the first in order; null on a page without any.

    Read downwards, what stands last before a mark is the nearest above it, and upwards the nearest below: marks and parts are sorted by
    height twice and not paired. Parts of one height come in falling order, so that the last of them is the first in order.
    """
    part = F.struct(F.col("at").alias("n_at"), F.col("block"), F.col("cy").cast("double").alias("n_cy"))
    parts = body.where("type not in ('PageHeader', 'PageFooter')").select("page", part.alias("part"), F.col("cy").cast("double").alias("h"), F.lit(None).alias("m"))
    marks = free.select("page", F.lit(None).alias("part"), F.col("cy").cast("double").alias("h"), F.struct(*free.columns).alias("m"))
    both = dealt(parts.unionByName(marks).where("page is not null or m is not null"), "page")
    page = Window.partitionBy("page")
    seen = F.last(F.when(F.col("h").isNotNull(), F.col("part")), True)
    # a mark stands after the parts of its own height both ways
    down = page.orderBy(F.col("h").asc(), F.col("m").isNotNull(), F.col("part.n_at").desc()).rowsBetween(Window.unboundedPreceding, 0)
    up = page.orderBy(F.col("h").desc(), F.col("m").isNotNull(), F.col("part.n_at").desc()).rowsBetween(Window.unboundedPreceding, 0)
    rows = both.withColumn("any", F.min("part").over(page)).withColumn("above", seen.over(down)).withColumn("below", seen.over(up)).where("m is not null")
    away = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(f"{c}.n_cy") - F.col("h")).alias("d"), F.col(f"{c}.n_at").alias("at"), F.col(c).alias("p")))
    near = F.when(F.col("h").isNotNull(), F.least(away("above"), away("below"))["p"])
    return rows.select("m.*", F.when(F.col("page").isNotNull(), F.coalesce(near, "any")).alias("n"))
