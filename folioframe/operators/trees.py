"""Descendants, coverage, margin notes and older note forms."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as geo
from .layout import meeting


def levels_below(edges: DataFrame, root: str, write: Callable[[DataFrame], DataFrame] | None = None) -> list[DataFrame]:
    """The rows of `edges` (id, parent, …) level by level under a root; `above` is the row's parent's `path`.

    A join a level, each written to the shared folder (or by `write`), so neither depth nor rows meet a limit and no view is named.
    """
    save = write or shared_table
    now = save(edges.where(F.col("parent") == root).withColumn("path", F.lpad(F.col("ord").cast("string"), 9, "0")))
    out = []
    while not now.isEmpty():
        out.append(now)
        above = now.select(F.col("id").alias("_p"), F.col("path").alias("_path"))
        now = save(edges.join(above, F.col("parent") == F.col("_p")).withColumn("path", F.concat("_path", F.lit("/"), F.lpad(F.col("ord").cast("string"), 9, "0"))).drop("_p", "_path"))
    return out


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; where it is unset, a temporary one on one machine and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="folioframe-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def shared_table(rows: DataFrame) -> DataFrame:
    """A table in the folder that all executors share."""
    spark = rows.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def contained(blocks: DataFrame, root: str, types: list[str]) -> DataFrame:
    """(id, type, path) of the blocks under a root, of the given types, in pre-order by path.

    blocks: id, parent, ord, type, removed. A removed block hides all below it; paths are order numbers, padded so that they sort as text.
    """
    found = levels_below(blocks.where("not removed").select("id", "parent", "ord", "type"), root)
    out = blocks.sparkSession.createDataFrame([], "id string, type string, path string")
    for level in found:
        out = out.unionByName(level.select("id", "type", "path"))
    return out.where(F.col("type").isin(*types))


def coverage(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """By page: the share of the lines' area that their best block covers, and lines that overlap two blocks or more."""
    common = geo.common_area(geo.box("l_"), geo.box("b_"))
    best = meeting(lines, blocks).groupBy("page", F.col("l_id").alias("id")).agg(F.max(common).alias("best"), F.count_if(common > 0).alias("met"))
    once = lines.groupBy("page", "id").agg(F.first(geo.area(geo.box())).alias("size")).join(best, ["page", "id"], "left").na.fill(0, ["best", "met"])
    return once.groupBy("page").agg((F.sum("best") / F.sum("size")).alias("covered"), F.count_if(F.col("met") > 1).alias("overlapping"), F.count("*").alias("lines"))


def grown_to_gap(blocks: DataFrame, most: float = 0.05) -> DataFrame:
    """Blocks moved out by half the least gap to another one of the page, by `most` of their size at the most.

    Only blocks nearer than twice that bound can hold a block back; a block that is alone on its page stays.
    """
    a = geo.box()
    reach = 2 * most * F.greatest(F.col("l_x1") - F.col("l_x0"), F.col("l_y1") - F.col("l_y0"))
    near = meeting(blocks, blocks, reach).where("l_id <> b_id").groupBy("page", F.col("l_id").alias("id")).agg(F.min(geo.gap(geo.box("l_"), geo.box("b_"))).alias("gap"))
    alone = blocks.groupBy("page").agg((F.count_distinct("id") < 2).alias("alone"))
    rows = blocks.join(near, ["page", "id"], "left").join(alone, "page")
    step = lambda size: F.when(F.col("alone"), 0.0).otherwise(F.least(F.coalesce(F.col("gap") / 2, F.lit(float("inf"))), size * most))
    return rows.select("page", "id", (F.col("x0") - step(geo.width(a))).alias("x0"), (F.col("y0") - step(geo.height(a))).alias("y0"), (F.col("x1") + step(geo.width(a))).alias("x1"), (F.col("y1") + step(geo.height(a))).alias("y1"))


def note_lines(notes: DataFrame, lines: DataFrame, reach: float = 12.0) -> DataFrame:
    """Margin notes with the nearest line of their page within `reach` in height; ties to the upper line."""
    there = lines.select("page", F.col("id").alias("line"), ((F.col("y0") + F.col("y1")) / 2).alias("ly"))
    dy = F.abs(F.col("ly") - (F.col("y0") + F.col("y1")) / 2)
    pairs = notes.join(there, "page").withColumn("dy", dy).where(F.col("dy") <= reach)
    return pairs.groupBy("page", "id").agg(F.min_by("line", F.struct("dy", "ly", "line")).alias("line"))


def same_notes(legacy: DataFrame, resolved: DataFrame, doc: str, size: int = 120) -> DataFrame:
    """Legacy notes whose text begins like a resolved note of the same marker, or the other way round."""
    a, b = F.substring("body", 1, size), F.substring("r_body", 1, size)
    there = resolved.select(F.col(doc).alias("r_doc"), F.col("marker").alias("r_marker"), F.col("body").alias("r_body"))
    on = (F.col(doc) == F.col("r_doc")) & (F.col("marker") == F.col("r_marker")) & (a.startswith(b) | b.startswith(a))
    return legacy.join(there, on, "left_semi")


def missing(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of `left` that `right` lacks, as a multiset."""
    return left.exceptAll(right)


def first_seen(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """The distinct values of a group in the order they came."""
    listed = rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))).alias("r"))
    return listed.select(by, F.array_distinct(F.transform("r", lambda x: x["v"])).alias("values"))


def contents_groups(lines: DataFrame, doc: str) -> DataFrame:
    """Lines of a table of contents (line_idx, title, page) with `entry`: a title without a page goes on in the next line."""
    along = Window.partitionBy(doc).orderBy("line_idx")
    ended = F.lag(F.col("page").isNotNull()).over(along)
    return lines.withColumn("entry", F.sum(F.coalesce(ended, F.lit(True)).cast("int")).over(along))
