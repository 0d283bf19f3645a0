"""The queue's relational shapes on the order tables: orders are tasks, customers their parents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import queue as ops
from .base import read


def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    kind = F.element_at(F.array(F.lit("prepare"), F.lit("extract"), F.lit("merge")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    status = F.when(F.col("o_orderkey") % 5 < 4, "done").otherwise("queued")
    work = orders.select(F.concat(F.lit("o"), "o_orderkey").alias("id"), F.concat(F.lit("c"), "o_custkey").alias("parent"), kind.alias("kind"), status.alias("status"), F.col("o_totalprice").alias("scheduled"), F.col("o_orderdate").alias("created"))
    books = read(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.lit("").alias("parent"), F.lit("book").alias("kind"), F.lit("running").alias("status"), F.col("c_acctbal").alias("scheduled"), F.lit(None).cast("timestamp_ntz").alias("created"))
    return work.unionByName(books)


def queue_claimable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.claimable(_tasks(spark, sf_dir)).select("id", "parent", "kind", "turn")


def queue_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks and pages by status and nation, the pages from JSON with a default."""
    customers = read(spark, sf_dir, "customer").join(F.broadcast(read(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    given = F.when(F.col("o_orderkey") % 4 > 0, F.concat(F.lit('{"pages": '), F.col("o_orderkey") % 10, F.lit("}"))).otherwise(F.lit("{}"))
    pages = F.coalesce(F.get_json_object(given, "$.pages").cast("bigint"), F.lit(1))
    orders = read(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", pages.alias("pages"))
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).groupBy("n_name", "o_orderstatus").agg(F.count("*").alias("tasks"), F.sum("pages").alias("pages"))


def queue_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return ops.page_of(orders, [F.desc("o_orderdate"), F.desc("o_orderkey")], 20, 40)


def queue_left_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with the date of their last order, or their account's default; aggregated before the join."""
    last = read(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.max("o_totalprice").alias("top"))
    customers = read(spark, sf_dir, "customer")
    return customers.join(last, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("top", "c_acctbal").alias("value"), F.col("top").isNull().alias("defaulted"))


def task_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that hangs below the first region: nations, customers, by a recursive query."""
    nations = read(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    customers = read(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.concat(F.lit("n"), "c_nationkey").alias("parent"))
    return ops.descendants(nations.unionByName(customers), "r0").groupBy("depth").agg(F.count("*").alias("n"), F.min("id").alias("first"))


def file_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts in eight runs of ceil(n / 8), by their place in key order."""
    parts = read(spark, sf_dir, "part").select("p_partkey")
    place = ops.in_runs(parts, "p_partkey", 8)
    return place.groupBy("chunk").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"))


def progress_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ops.rolling_rate(read(spark, sf_dir, "events"), "user_id")
    return found.select("event_id", F.round("rate", 6).alias("rate"), "samples")


def lease_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.leases(read(spark, sf_dir, "events"), "user_id")


def lease_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expired leases by user: the gap to the next one of the same user is over the limit."""
    found = ops.leases(read(spark, sf_dir, "events"), "user_id", gap=3600)
    again = F.lead("start").over(Window.partitionBy("user_id").orderBy("start"))
    return found.withColumn("next", again).groupBy("user_id").agg(F.count("*").alias("leases"), F.count("next").alias("retries"), F.max("beats").alias("longest"))


def shipped_semi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a late line (IN) and without any returned one (NOT EXISTS), by priority."""
    lines = read(spark, sf_dir, "lineitem")
    late = lines.where("l_shipdate > timestamp_ntz'1997-01-01'").select(F.col("l_orderkey").alias("o_orderkey"))
    returned = lines.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    orders = read(spark, sf_dir, "orders").join(late, "o_orderkey", "left_semi").join(returned, "o_orderkey", "left_anti")
    return orders.groupBy("o_orderpriority").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (queue_claimable, queue_overview, queue_page, queue_left_default, task_tree, file_chunks, progress_rate, lease_sessions, lease_summary, shipped_semi_anti)}

_LEASES = """WITH e AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL {gap} SECOND THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM e),
l AS (SELECT user_id, min(ts) AS start, max(ts) AS last, count(*) AS beats FROM s GROUP BY user_id, run)"""
ORACLES = {
    "queue_claimable": """
WITH t AS (
  SELECT 'o' || o_orderkey AS id, 'c' || o_custkey AS parent, ['prepare', 'extract', 'merge'][o_orderkey % 3 + 1] AS kind, CASE WHEN o_orderkey % 5 < 4 THEN 'done' ELSE 'queued' END AS status, o_totalprice AS scheduled FROM orders
  UNION ALL SELECT 'c' || c_custkey, '', 'book', 'running', c_acctbal FROM customer
)
SELECT t.id, t.parent, t.kind, coalesce(p.scheduled, t.scheduled) AS turn FROM t LEFT JOIN t p ON t.parent = p.id
WHERE t.status = 'queued' AND t.kind <> 'book'
  AND (t.kind <> 'merge' OR NOT EXISTS (SELECT 1 FROM t s WHERE s.parent = t.parent AND s.kind = 'extract' AND s.status <> 'done'))
  AND (t.kind <> 'extract' OR NOT EXISTS (SELECT 1 FROM t s WHERE s.parent = t.parent AND s.kind = 'prepare' AND s.status <> 'done'))""",
    "queue_overview": """
SELECT n_name, o_orderstatus, count(*) AS tasks, CAST(sum(CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 10 ELSE 1 END) AS BIGINT) AS pages
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL""",
    "queue_page": "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20 OFFSET 40",
    "queue_left_default": """
WITH l AS (SELECT o_custkey, max(o_totalprice) AS top FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT c_custkey, coalesce(top, c_acctbal) AS value, top IS NULL AS defaulted FROM customer LEFT JOIN l ON c_custkey = o_custkey""",
    "task_tree": """
WITH RECURSIVE e AS (SELECT 'n' || n_nationkey AS id, 'r' || n_regionkey AS parent FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer),
b(id, depth) AS (SELECT id, 1 FROM e WHERE parent = 'r0' UNION ALL SELECT e.id, depth + 1 FROM e JOIN b ON e.parent = b.id)
SELECT depth, count(*) AS n, min(id) AS first FROM b GROUP BY depth""",
    "file_chunks": "WITH p AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS k, count(*) OVER () AS n FROM part) SELECT CAST(k // CAST(ceil(n / 8) AS BIGINT) AS INTEGER) AS chunk, count(*) AS n, min(p_partkey) AS first FROM p GROUP BY 1",
    "progress_rate": "SELECT event_id, round(avg(value) OVER w, 6) AS rate, count(*) OVER w AS samples FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 15 PRECEDING AND CURRENT ROW)",
    "lease_sessions": _LEASES.format(gap=60) + " SELECT * FROM l",
    "lease_summary": _LEASES.format(gap=3600) + ", n AS (SELECT *, lead(start) OVER (PARTITION BY user_id ORDER BY start) AS nx FROM l) SELECT user_id, count(*) AS leases, count(nx) AS retries, max(beats) AS longest FROM n GROUP BY user_id",
    "shipped_semi_anti": """
SELECT o_orderpriority, count(*) AS n FROM orders
WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_shipdate > TIMESTAMP '1997-01-01') AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') GROUP BY 1""",
}
