"""Mixing sources to target weights by hash thresholds: histograms of words by source and slot of the hash.

Only DataFrame expressions run on the executors. A document's place in its source is a hash of its id
and text, so a larger budget takes what a smaller one takes and more. A source's threshold is found by
histograms: the first counts the words of all documents in SLOTS slots of the hash, each later one
only those of the slot that the budget ends in. Nothing is sorted, and no source comes to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Slots that one histogram cuts a bracket into.
SLOTS = 1024
#: Largest hash.
HASH_END = (1 << 60) - 1
#: Sources whose figures may be broadcast: at most some 10 MB; beyond it both sides are shuffled.
FEW_SOURCES = 100_000

_OWN = ("size", "source_size", "target", "copies")


def words(text: str) -> Column:
    """Number of stretches without space, tab, line or page ends in the text; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def place_hash(ident: Column, text: Column) -> Column:
    """60 bits of the MD5 of the id (null: `-`), a colon and the text (null: empty)."""
    whole = F.concat(F.coalesce(ident.cast("string"), F.lit("-")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(whole.cast("binary")), 1, 15), 16, 10).cast("long")


def _numbered(sources: DataFrame, scratch: Scratch) -> DataFrame:
    """Append number, the place of a source by code point with null last, from 0: dealt by ranges, not in one task."""
    dealt = sources.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    placed = scratch.write(dealt.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)))
    counts = placed.groupBy("part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    # a row a partition
    starts = counts.select("part", "first", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    return placed.join(starts, "part").select(*sources.columns, (F.col("start") + F.col("at") - F.col("first")).alias("number"))


def targets(sources: DataFrame, weights: Sequence[float], share: float, limit: float, scratch: Scratch) -> DataFrame:
    """(source, source_size) with number, weight and target: `share` of all words by weight, none above `limit` times its source.

    What is above is shared again by weight among the others until none is above; a round is one
    aggregate of three sums. Where the limits of all sources are under the budget, all get their limit.
    """
    cycle = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("number") % len(weights) + 1).cast("int"))
    known = scratch.write(_numbered(sources, scratch).withColumn("weight", cycle).withColumn("most", F.col("source_size") * F.lit(float(limit))))
    budget = float(share) * (known.agg(F.sum("source_size")).first()[0] or 0)
    level, held = 0.0, -1
    while True:
        # a source is held to its limit if its share at the level so far is above it; the level only rises
        above = F.col("weight") * F.lit(level) > F.col("most")
        found = known.agg(F.sum(F.when(above, 1).otherwise(0)), F.sum(F.when(above, F.col("most")).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("weight")))).first()
        if found[0] is None or found[0] == held or not found[2]:
            break
        held, level = found[0], (budget - found[1]) / found[2]
    return known.withColumn("target", F.when(F.col("weight") * F.lit(level) > F.col("most"), F.col("most")).otherwise(F.col("weight") * F.lit(level))).drop("most")


def _beside(rows: DataFrame, figures: DataFrame, few: bool) -> DataFrame:
    """Put a source's figures beside its rows; a source with very many rows is split by adaptive execution where the figures are not broadcast."""
    figures = figures.withColumnRenamed("source", "of")
    return rows.join(F.broadcast(figures) if few else figures, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")


def _narrowed(rows: DataFrame, brackets: DataFrame, column: str, few: bool, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """One histogram: brackets (source, want, below, low, high) over `column` become those of the slot that `want` ends in, and the rows those inside."""
    slotted = _beside(rows, brackets, few).where(F.col(column).between(F.col("low"), F.col("high"))).withColumn("slot", F.expr(f"({column} - low) div ((high - low) div {SLOTS} + 1)"))
    sums = slotted.groupBy("source", "slot").agg(F.sum("size").alias("inside"), F.min(column).alias("low"), F.max(column).alias("high"), F.first("want").alias("want"), F.first("below").alias("below"))
    # SLOTS rows a source at most
    running = sums.withColumn("upto", F.col("below") + F.sum("inside").over(Window.partitionBy("source").orderBy("slot")))
    found = running.where((F.col("upto") - F.col("inside") <= F.col("want")) & (F.col("want") < F.col("upto"))).select("source", "want", (F.col("upto") - F.col("inside")).alias("below"), "low", "high")
    brackets = scratch.write(found)
    kept = _beside(rows, brackets.select("source", "low", "high"), few).where(F.col(column).between(F.col("low"), F.col("high"))).drop("low", "high")
    return brackets, kept


def _refined(rows: DataFrame, brackets: DataFrame, column: str, few: bool, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Narrow all brackets to one value of `column`; rows: those of the brackets' values."""
    kept = rows
    while brackets.where("low < high").limit(1).count():
        brackets, kept = _narrowed(kept, brackets, column, few, scratch)
        kept = scratch.write(kept)
    return brackets, kept


def mix_sources(
    df: DataFrame,
    weights: Sequence[float],
    share: float = 1.5,
    limit: int = 2,
    size: Column | None = None,
    place: Column | None = None,
    source: str = "source",
    ident: str = "doc_id",
    text: str = "text",
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Append size, source_size, target (words of the row's source in the mix) and copies (how often the mix takes the row, 0 to `limit`).

    The sources, by code point with null last, have the given weights in turn and share `share` times
    all words; a target stops at `limit` times its source. A source's rows are taken as often as the
    target holds the whole source, and once more where their place is below the source's threshold;
    the row at the threshold is taken if that comes nearer, so a source is off by half a row at most.

    size: words of a row (default: those of `text`); place: its hash, 0 to HASH_END (default: of id and
    text). Rows alike in both are told by where they stand, so that a large group of copies is cut
    like any other; as copies are alike, reruns agree. Null texts and texts without words have size 0
    and cost nothing. A null source is a source. An empty table gives an empty result. `keep`: columns of
    `df` to return, all if unset; any name may clash, those named like the new columns are replaced.
    The kept columns go once through the shared folder; texts do only if they are kept.
    """
    kept = [c for c in (df.columns if keep is None else keep) if c not in _OWN]
    size = words(text) if size is None else size
    place = place_hash(F.col(ident), F.col(text)) if place is None else place
    scratch = Scratch(df.sparkSession, "mix")
    given = {c: f"c{i}" for i, c in enumerate(kept)}
    # what the caller keeps waits under names that clash with none here
    rows = scratch.write(df.select(*(F.col(f"`{c}`").alias(n) for c, n in given.items()), F.col(source).alias("source"), size.cast("long").alias("size"), place.alias("h")).withColumn("at", F.monotonically_increasing_id()))
    plain = rows.select("source", "size", "h", "at")
    known = scratch.write(targets(plain.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, limit, scratch))
    few = known.count() <= FEW_SOURCES
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = known.select("source", "source_size", "target", whole.alias("whole")).withColumn("want", F.col("target") - F.col("whole") * F.col("source_size"))
    open_ = plan.where("want > 0").select("source", "want", F.lit(0).cast("long").alias("below"), F.lit(0).cast("long").alias("low"), F.lit(HASH_END).alias("high"))
    by_hash, inside = _refined(plain, open_, "h", few, scratch)
    # of the rows of one hash, where they stand decides
    spans = inside.groupBy("source").agg(F.min("at").alias("low"), F.max("at").alias("high"))
    by_hash = by_hash.select("source", "want", "below", F.col("low").alias("cut"))
    tied = _beside(by_hash, spans, few).select("source", "want", "below", "low", "high")
    by_place, inside = _refined(inside, scratch.write(tied), "at", few, scratch)
    last = by_place.select("source", "want", "below", F.col("low").alias("cut_at"))
    at_cut = inside.groupBy("source").agg(F.max("size").alias("own"))
    ends = _beside(_beside(by_hash.select("source", "cut"), last, few), at_cut, few)
    ends = scratch.write(ends.select("source", "cut", "cut_at", (F.col("want") - F.col("below") > F.col("below") + F.col("own") - F.col("want")).alias("over")))
    figures = _beside(plan.select("source", "source_size", "target", "whole"), ends, few)
    below = (F.col("h") < F.col("cut")) | ((F.col("h") == F.col("cut")) & ((F.col("at") < F.col("cut_at")) | ((F.col("at") == F.col("cut_at")) & F.col("over"))))
    copies = F.least(F.col("whole") + F.coalesce(below, F.lit(False)).cast("int"), F.lit(limit)).cast("int")
    return _beside(rows, figures, few).select(*(F.col(n).alias(c) for c, n in given.items()), "size", "source_size", "target", copies.alias("copies"))
