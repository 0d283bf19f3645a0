"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


#: Links up to which the least neighbours are broadcast to them; beyond, both sides are shuffled.
BROADCAST_ROWS = 50_000


def _stars(edges: DataFrame, few: bool) -> DataFrame:
    """edges (u, v), v below u: hang each u's neighbours on the least of them and u itself."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    # a join and not a window: a node with very many neighbours can be split over tasks
    return edges.join(F.broadcast(least) if few else least, "u")


def _large(edges: DataFrame, few: bool) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    joined = _stars(both, few).withColumn("m", F.least("m", "u"))
    return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(edges: DataFrame, few: bool) -> DataFrame:
    joined = _stars(edges, few)
    hung = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
    return hung.where("u <> v").distinct()


def _state(edges: DataFrame) -> tuple[int, bool]:
    """How many links there are, and whether all are stars: no node hangs on two, nor on one that hangs itself."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    sums = nodes.agg(F.sum("up").alias("links"), F.count_if(F.expr("up > 1 or (up = 1 and down = 1)")).alias("open")).first()
    return sums["links"] or 0, not sums["open"]


def components(edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of `edges` (u, v): the root is its component's least node.

    Every round is written to the shared folder and the one before it deleted. It ends when each
    component is a star; no link reaches the driver, but for the few of a small graph that it broadcasts.
    """
    now = scratch.write(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for left in range(rounds, -1, -1):
        links, settled = _state(now)
        if settled:
            break
        if not left:
            raise RuntimeError("components did not settle")
        few = links <= BROADCAST_ROWS
        after = scratch.write(_small(_large(now, few), few))
        scratch.drop(now)
        now = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
