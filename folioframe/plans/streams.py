"""Structured Streaming queries over the events, run until the source is used up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import progress
from .base import read
from .queue import _LEASES


def stream_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All hours, those that the watermark has not closed too."""
    events = progress.read_events(spark, f"{sf_dir}/events.parquet")
    found = progress.collected(progress.windowed_counts(events), "complete")
    return found.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


def stream_leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = progress.read_events(spark, f"{sf_dir}/events.parquet")
    found = progress.collected(progress.lease_sessions(events, "user_id", "1 hour"), "complete")
    return found.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("last").cast("timestamp_ntz").alias("last"), "beats")


def stream_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = progress.read_events(spark, f"{sf_dir}/events.parquet")
    found = progress.collected(progress.rolling_rates(events, "user_id"), "update", ["scope"])
    return found.select("scope", F.round("rate", 6).alias("rate"), "seen")


def stream_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submissions under a key that comes again: each is taken once."""
    events = progress.read_events(spark, f"{sf_dir}/events.parquet").withColumn("key", F.concat("user_id", F.lit("-"), "event_type"))
    found = progress.collected(progress.once_only(events, "key", "3650 days"), "append")
    return found.select("key").join(read(spark, sf_dir, "events").select(F.concat("user_id", F.lit("-"), "event_type").alias("key")).distinct(), "key", "left_semi").groupBy("key").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (stream_window_counts, stream_leases, stream_rates, stream_submissions)}
ORACLES: dict[str, str] = {
    "stream_window_counts": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL",
    "stream_leases": _LEASES.format(gap=3600) + " SELECT * FROM l",
    "stream_rates": "WITH n AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k, count(*) OVER (PARTITION BY user_id) AS seen FROM events) SELECT user_id AS scope, round(avg(value), 6) AS rate, any_value(seen) AS seen FROM n WHERE k <= 16 GROUP BY user_id",
    "stream_submissions": "SELECT DISTINCT user_id || '-' || event_type AS key, CAST(1 AS BIGINT) AS n FROM events",
}
