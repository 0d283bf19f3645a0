"""The corpus pipeline: quality, near duplicates, repeated passages, benchmark leaks, tokens.

Every stage takes all that its predecessor kept and returns a DataFrame, with the columns of
documents but for the last. `run` writes each stage's rows to the shared folder and reads them again.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.llm import bpe, common, decontamination, ngram_join, quality, substring_dedup
from folioframe.llm.queries import table, tokenizer


def aside(stage):
    """The stage on columns that no operator's own can clash with: all but the id, the text and its length wait under other names."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = {c: c if c in ("doc_id", "text", "n_chars") else f"waiting {i}" for i, c in enumerate(docs.columns)}
        done = stage(spark, docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items())), sf_dir)
        return done.select(*(F.col(f"`{n}`").alias(c) for c, n in names.items()))

    return run_stage


@aside
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier scores under 0.3; it learns from `labels`.

    Null and empty texts are scored like any; without a label every document scores 0.5 and stays.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return quality.score(docs, model, out="_score").where("_score >= 0.3").drop("_score")


@aside
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the lowest id (null is the lowest) of each group linked by 5-word Jaccard of 0.8 or more.

    Texts without words (null and empty ones too) are one group; of repeated rows one stays.
    """
    common.bounded_batches(spark)
    return ngram_join.drop_near_duplicates(docs)


@aside
def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut every byte covered by a 200-byte string that starts twice in the corpus; all rows stay.

    A character that loses some of its bytes goes whole, and n_chars counts what is left. Null texts stay null.
    """
    common.bounded_batches(spark)
    left = substring_dedup.remove_repeats(docs).withColumn("text", F.when(F.col("text").isNotNull(), F.col("kept_text")))
    return left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


@aside
def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that overlap with an item of `benchmark`; null and empty texts and items overlap with none."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the ids of the text, their number, and the text decoded from them."""
    common.bounded_batches(spark)
    ranks, pattern = tokenizer()
    out = bpe.encode(docs.select("doc_id", "lang", "source", "text"), ranks, pattern, words=True, decoded="decoded")
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.col("decoded").cast("string").alias("text"))


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", remove_repeated_passages),
    ("decontamination", drop_leaks),
    ("tokens", tokenize),
]

#: SQL expresses neither the classifier nor the byte pairs; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = common.Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.write(docs)
    return docs
