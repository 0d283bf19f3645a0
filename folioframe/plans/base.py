"""Shared by the query modules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a task gets where a query deals its rows itself, so that a task's memory does not grow with the tables.
TASK_ROWS = 300_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks_for(rows: DataFrame) -> int:
    """How many tasks a table read from a file is dealt to: the session's number, more if they would get more than TASK_ROWS rows each."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // TASK_ROWS))


def lines_of(docs: DataFrame, ident: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per line of a text: ident, what is kept, line_idx (from 0), line. Null texts have none."""
    return docs.select(ident, *keep, F.posexplode(F.split(text, "\n")).alias("line_idx", "line"))


#: DuckDB text of the same, for use in a WITH clause.
LINES_SQL = """lines AS (
  SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_idx
  FROM documents
)"""
