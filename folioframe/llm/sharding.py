"""Sharding by histogram sort: exact byte counts below probes refine splitters, then one exchange.

Only DataFrame expressions run on the executors. The order is (key, id), the key being 60 bits of the
text's MD5, so that equal texts stand together. Shard i ends where the bytes of all rows before the
splitter come nearest to i/n of the total; a group of equal texts of at most `whole_group` of a
shard's bytes is never cut.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, utf8_size

#: Largest keys and ids, both ends included.
KEY_END, ID_LOW, ID_HIGH = (1 << 60) - 1, -(1 << 63), (1 << 63) - 1
#: Probes that one round places inside each splitter's bracket.
PROBES = 64


class Bracket(NamedTuple):
    """An interval [low, high] known to hold the splitter, and the exact bytes below it and in it."""

    low: int
    high: int
    below: int
    inside: int


def text_key(text: Column) -> Column:
    """60 bits of the MD5 of the text in UTF-8; null counts as empty."""
    return F.conv(F.substring(F.md5(F.coalesce(text, F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def _refine(rows: DataFrame, column: str, brackets: dict[int, Bracket], targets: dict[int, int], scope: dict[int, int] | None = None) -> dict[int, Bracket]:
    """Narrow each bracket to the one value of `column` in which its target lies.

    Each round counts, in one aggregation, the exact bytes in PROBES slots of every open bracket and
    keeps the slot of the target, cut to the values that occur: at most splitters x PROBES counts reach the driver a round.
    `scope`: the key whose rows a bracket is about, where `column` is the id.
    """
    done: dict[int, Bracket] = {}
    open_ = dict(brackets)
    while open_:
        slot = F.lit(None).cast("long")
        steps: dict[int, int] = {}
        # brackets are equal or apart; the first of equal ones counts for all
        first = {i: next(j for j in sorted(open_) if open_[j] == b and (scope is None or scope[j] == scope[i])) for i, b in open_.items()}
        for i, b in open_.items():
            steps[i] = step = max(1, -(-(b.high - b.low + 1) // PROBES))
            if first[i] != i:
                continue
            inside = F.col(column).between(b.low, b.high)
            if scope:
                inside &= F.col("_key") == scope[i]
            # (x - low) may pass 63 bits on the widest id bracket, so halves are divided apart
            at = F.floor((F.col(column).cast("decimal(20,0)") - F.lit(b.low).cast("decimal(20,0)")) / F.lit(step).cast("decimal(20,0)")) if b.high - b.low > KEY_END else F.expr(f"({column} - {b.low}L) div {step}L")
            slot = F.when(inside, F.lit(i * PROBES).cast("long") + at.cast("long")).otherwise(slot)
        counted = rows.select(slot.alias("slot"), "_size", column).where("slot is not null").groupBy("slot").agg(F.sum("_size").alias("bytes"), F.min(column).alias("low"), F.max(column).alias("high")).collect()
        sums = {r["slot"]: r for r in counted}
        for i, b in list(open_.items()):
            narrower, below = b, b.below
            for probe in range(PROBES):
                seen = sums.get(first[i] * PROBES + probe)
                if seen and below + seen["bytes"] > targets[i]:
                    narrower = Bracket(seen["low"], seen["high"], below, seen["bytes"])
                    break
                below += seen["bytes"] if seen else 0
            if narrower.low == narrower.high:
                done[i] = narrower
                del open_[i]
            else:
                open_[i] = narrower
    return done


def splitters(rows: DataFrame, shards: int, whole_group: float = 0.002) -> list[tuple[int, int]]:
    """(key, id) pairs: a row is in the shard numbered by how many of them are at or below it.

    `rows` has _key, _id and _size. Rows alike in key and id share a shard.
    """
    total = rows.agg(F.sum("_size")).first()[0] or 0
    if not total or shards < 2:
        return []
    targets = {i: total * i // shards for i in range(1, shards)}
    slack = int(total / shards * whole_group)
    found = _refine(rows, "_key", {i: Bracket(0, KEY_END, 0, total) for i in targets}, targets)
    cut: dict[int, tuple[int, int]] = {}
    wide = {i: b for i, b in found.items() if b.inside > slack}
    for i, b in found.items():
        if i not in wide:
            cut[i] = (b.low, ID_LOW) if targets[i] - b.below <= b.below + b.inside - targets[i] else (b.low + 1, ID_LOW)
    if wide:
        keys = sorted({b.low for b in wide.values()})
        ends = {r["_key"]: (r["a"], r["b"]) for r in rows.where(F.col("_key").isin(keys)).groupBy("_key").agg(F.min("_id").alias("a"), F.max("_id").alias("b")).collect()}
        inner = _refine(rows, "_id", {i: Bracket(*ends[b.low], b.below, b.inside) for i, b in wide.items()}, targets, {i: b.low for i, b in wide.items()})
        for i, b in inner.items():
            before = targets[i] - b.below <= b.below + b.inside - targets[i]
            cut[i] = (wide[i].low, b.low) if before else (wide[i].low, b.low + 1) if b.low < ID_HIGH else (wide[i].low + 1, ID_LOW)
    return [cut[i] for i in sorted(cut)]


def shard_of(cuts: list[tuple[int, int]], key: Column, ident: Column) -> Column:
    """How many cuts are at or below (key, id)."""
    out = F.lit(len(cuts))
    for i in range(len(cuts) - 1, -1, -1):
        k, d = cuts[i]
        out = F.when((key < k) | ((key == k) & (ident < d)), F.lit(i)).otherwise(out)
    return out.cast("int")


def shard_by_bytes(df: DataFrame, shards: int = 16, text: str = "text", ident: str = "doc_id", whole_group: float = 0.002, bin_bytes: int = 16 << 20) -> DataFrame:
    """Append shard and slot (gapless from 0 in each shard) so that shards have near-equal bytes.

    A row's size is its text's UTF-8 bytes plus 1. A shard is off by at most one row, or by
    `whole_group` of a shard where that keeps equal texts together. Null texts count as empty; a null
    id sorts as the lowest; rows alike in text and id share a shard and take its next slots; an empty
    table gives an empty result. Columns named shard or slot are replaced, all others are kept.

    Slots: each shard is dealt into bins by a digest of the id, whatever text is frequent; a bin's
    first slot is the sum of those before it and rows in a bin follow (key, id). One exchange moves
    the rows, about `bin_bytes` of text to a task (65,536 bins a shard at most, so the starts are a small
    table whatever the input).
    """
    spark = df.sparkSession
    kept = [c for c in df.columns if c not in ("shard", "slot")]
    key, size = text_key(F.col(f"`{text}`")), utf8_size(f"`{text}`") + 1
    number = F.coalesce(F.col(f"`{ident}`").cast("long"), F.lit(ID_LOW))
    # the caller's columns wait under names that clash with none here
    given = {c: f"c{i}" for i, c in enumerate(kept)}
    full = df.select(*(F.col(f"`{c}`").alias(n) for c, n in given.items()), key.alias("_key"), number.alias("_id"), size.alias("_size"))
    narrow = Scratch(spark, "shard").write(full.select("_key", "_id", "_size"))
    cuts = splitters(narrow, shards, whole_group)
    total = narrow.agg(F.sum("_size")).first()[0] or 0
    bins = max(1, min(65_536, -(-total // (bin_bytes * shards))))
    digest = F.conv(F.substring(F.md5(F.col("_id").cast("string")), 1, 4), 16, 10).cast("int") % bins
    placed = narrow.select(shard_of(cuts, F.col("_key"), F.col("_id")).alias("shard"), digest.alias("_bin"))
    counts = placed.groupBy("shard", "_bin").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "_bin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    full = full.drop("_size").withColumns({"shard": shard_of(cuts, F.col("_key"), F.col("_id")), "_bin": digest})
    inside = Window.partitionBy("shard", "_bin").orderBy("_key", "_id")
    ranked = full.withColumn("_rank", F.row_number().over(inside) - 1)
    # at most shards x 65,536 starts of 16 bytes
    out = ranked.join(F.broadcast(starts), ["shard", "_bin"])
    return out.select(*(F.col(n).alias(c) for c, n in given.items()), "shard", (F.col("_start") + F.col("_rank")).cast("long").alias("slot"))
