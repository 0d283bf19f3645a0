"""Task queue relations: what may start, who waits, what belongs to what."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .trees import levels_below, shared_table


def claimable(tasks: DataFrame) -> DataFrame:
    """Queued leaf tasks whose siblings of the stage before are done, fairest parent first.

    tasks: id, parent, kind (prepare, extract, merge, book), status, scheduled, created.
    """
    waits_for = {"extract": "prepare", "merge": "extract"}
    before = F.create_map(*(F.lit(x) for pair in waits_for.items() for x in pair))
    open_ = tasks.where("status <> 'done'").select(F.col("parent").alias("p"), F.col("kind").alias("k")).distinct()
    queued = tasks.where("status = 'queued' and kind not in ('book', 'group')").withColumn("before", F.try_element_at(before, F.col("kind")))
    free = queued.join(open_, (F.col("parent") == F.col("p")) & (F.col("before") == F.col("k")), "left_anti")
    parents = tasks.select(F.col("id").alias("pid"), F.col("scheduled").alias("parent_scheduled"))
    return free.join(parents, F.col("parent") == F.col("pid"), "left").select("id", "parent", "kind", F.coalesce("parent_scheduled", "scheduled").alias("turn"), "created")


def descendants(edges: DataFrame, root: str) -> DataFrame:
    """(id, depth) of everything under a root, from edges (id, parent), a join a level."""
    out = edges.sparkSession.createDataFrame([], "id string, depth int")
    for depth, level in enumerate(levels_below(edges.select("id", "parent", F.lit(0).alias("ord")), root), 1):
        out = out.unionByName(level.select("id", F.lit(depth).alias("depth")))
    return out


def numbered(rows: DataFrame, order: str, into: str = "place") -> DataFrame:
    """rows with their place from 0 in the order of a column: sorted by ranges, numbered within, offsets by range.

    No window goes over all rows; only the ranges' sizes are added up, and there is one a partition.
    """
    ranged = rows.repartitionByRange(F.col(order)).withColumn("_part", F.spark_partition_id())
    ranged = shared_table(ranged)
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"), F.min(order).alias("_low"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_low").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_before")
    place = F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1
    return ranged.withColumn("_k", place).join(F.broadcast(before), "_part").withColumn(into, F.col("_k") + F.col("_before")).drop("_part", "_k", "_before")


def in_runs(rows: DataFrame, order: str, runs: int) -> DataFrame:
    """rows with `chunk`: runs of ceil(n / runs) rows each, by place in the order of a column."""
    size = max(1, -(-rows.count() // runs))
    return numbered(rows, order).withColumn("chunk", F.floor(F.col("place") / size).cast("int")).drop("place")


def page_of(rows: DataFrame, order: list, limit: int, offset: int) -> DataFrame:
    """One page of a listing; the order must be total."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def rolling_rate(events: DataFrame, scope: str, samples: int = 16) -> DataFrame:
    """events with the mean value of the last `samples` of their scope, and how many there were."""
    recent = Window.partitionBy(scope).orderBy("ts", "event_id").rowsBetween(1 - samples, 0)
    return events.withColumn("rate", F.avg("value").over(recent)).withColumn("samples", F.count("*").over(recent))


def leases(events: DataFrame, scope: str, gap: int = 60) -> DataFrame:
    """Leases: a scope's events with less than `gap` seconds between neighbours. scope, start, last, beats."""
    session = F.session_window(F.col("ts").cast("timestamp"), f"{gap} seconds")
    return events.groupBy(scope, session.alias("w")).agg(F.min("ts").alias("start"), F.max("ts").alias("last"), F.count("*").alias("beats")).drop("w")
