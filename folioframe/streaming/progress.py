"""Progress rates, leases and ingest as Structured Streaming jobs; each also runs on a bounded source."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.trees import shared_folder


def read_events(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """A stream of event files, a few at a time: the next ones are taken when those are done."""
    schema = spark.read.parquet(path).schema
    # as a glob, so that a single file will do
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{path[:-1]}[{path[-1]}]")


def lease_sessions(events: DataFrame, scope: str, gap: str = "60 seconds", late: str = "1 minute") -> DataFrame:
    """Leases that have ended: heartbeats of a scope with smaller gaps, once the watermark has passed them."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(scope, F.session_window("at", gap).alias("w")).agg(F.min("at").alias("start"), F.max("at").alias("last"), F.count("*").alias("beats")).drop("w")


def once_only(events: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    """Submissions by key, the first of each."""
    return events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "1 hour") -> DataFrame:
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    counted = timed.groupBy(F.window("at", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def rolling_rates(events: DataFrame, scope: str, samples: int = 16, quiet_ms: int | None = None) -> DataFrame:
    """After each batch: a scope's mean over its last `samples` values.

    With `quiet_ms`, the state of a scope that was quiet for so long is dropped.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = list(state.get[0]) if state.exists else []
        total = state.get[1] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        kept = (kept + rows["value"].tolist())[-samples:]
        total += len(rows)
        state.update((kept, total))
        if quiet_ms:
            state.setTimeoutDuration(quiet_ms)
        yield pd.DataFrame({"scope": [key[0]], "rate": [sum(kept) / len(kept)], "seen": [total]})

    return events.groupBy(scope).applyInPandasWithState(update, "scope long, rate double, seen long", "kept array<double>, total long", "update", GroupStateTimeout.ProcessingTimeTimeout if quiet_ms else GroupStateTimeout.NoTimeout)


def ingest(pages: DataFrame, target: str, identity: str, checkpoint: str):
    """Append pages to a table under an identity; a batch that was written before is not written again."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("identity", F.lit(identity)).write.mode("overwrite").parquet(f"{target}/identity={identity}/batch={number}")

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", f"{checkpoint}/{identity}").trigger(availableNow=True).start()


def collected(stream: DataFrame, mode: str, key: list[str] | None = None) -> DataFrame:
    """What a stream over a bounded source has given when the source is used up, as a table in the shared folder.

    complete: the whole result after the last batch, open windows too. update: the last row of each `key`. Executors
    write every batch; the driver keeps only the batches' numbers.
    """
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    written: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/{number}")
        written.append(number)

    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    if not written:
        return spark.createDataFrame([], stream.schema)
    if mode == "complete":
        return spark.read.parquet(f"{folder}/{max(written)}").drop("_batch")
    rows = spark.read.parquet(*(f"{folder}/{n}" for n in sorted(set(written))))
    if key is None:
        return rows.drop("_batch")
    rest = [c for c in stream.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "_batch").alias("r")).select(*key, *(f"r.{c}" for c in rest))
