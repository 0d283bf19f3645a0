"""Printed page numbers: runs, corrections, neighbours and segments, per document."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def consecutive_runs(pages: DataFrame, doc: str, least: int = 4) -> DataFrame:
    """Islands of neighbouring pages whose number minus index is constant: doc, start, end, offset, n."""
    numbered = pages.where("number is not null").withColumn("offset", F.col("number") - F.col("page_idx"))
    place = F.row_number().over(Window.partitionBy(doc, "offset").orderBy("page_idx"))
    runs = numbered.withColumn("island", F.col("page_idx") - place)
    out = runs.groupBy(doc, "offset", "island").agg(F.min("page_idx").alias("start"), F.max("page_idx").alias("end"), F.count("*").alias("n"))
    return out.where(F.col("n") >= least).drop("island")


def candidate_segments(pages: DataFrame, doc: str, least: int = 2, confidence: float = 0.7) -> DataFrame:
    """Anchors on one line number = index * step + offset, for steps 1 and 2, that are dense or at least three."""
    steps = pages.where("number > 0").withColumn("step", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("offset", F.col("number") - F.col("page_idx") * F.col("step"))
    found = steps.groupBy(doc, "step", "offset").agg(F.min("page_idx").alias("start"), F.max("page_idx").alias("end"), F.count("*").alias("n"))
    found = found.withColumn("confidence", F.least(F.lit(1.0), F.col("n") / (F.col("end") - F.col("start") + 1)))
    return found.where((F.col("n") >= least) & ((F.col("confidence") >= confidence) | (F.col("n") >= 3)))


def choose_segments(segments: DataFrame, doc: str) -> DataFrame:
    """Greedily the longest segments of a document that share no page."""

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        ranked = rows.assign(length=rows["end"] - rows["start"]).sort_values(["n", "confidence", "length", "step", "start", "offset"], ascending=[False, False, False, True, True, True])
        taken: list[tuple[int, int]] = []
        kept = []
        for i, (a, b) in enumerate(zip(ranked["start"], ranked["end"], strict=True)):
            if all(b < c or a > d for c, d in taken):
                taken.append((a, b))
                kept.append(i)
        return ranked.iloc[kept][rows.columns]

    return segments.groupBy(doc).applyInPandas(choose, segments.schema)


def corrected(pages: DataFrame, doc: str) -> DataFrame:
    """pages with `corrected`: what the page's segment says, unless the number is at most one off."""
    chosen = choose_segments(candidate_segments(pages, doc), doc)
    inside = chosen.withColumn("page_idx", F.explode(F.sequence("start", "end"))).select(doc, "page_idx", (F.col("page_idx") * F.col("step") + F.col("offset")).alias("expected"))
    keep = F.abs(F.col("number") - F.col("expected")) <= 1
    value = F.when(F.col("expected") > 0, F.when(F.coalesce(keep, F.lit(False)), F.col("number")).otherwise(F.col("expected")))
    return pages.join(inside, [doc, "page_idx"], "left").withColumn("corrected", value).drop("expected")


def local_kind(pages: DataFrame, doc: str, reach: int = 3) -> DataFrame:
    """pages with `segment_kind`: the kinds of numbers within `reach` pages, or mixed, or unknown."""
    near = Window.partitionBy(doc).orderBy("page_idx").rowsBetween(-reach, reach)
    arabic, roman = (F.count_if(F.col("kind") == k).over(near) for k in ("arabic", "roman"))
    kind = F.when((arabic > 0) & (roman > 0), "mixed").when(arabic > 0, "arabic").when(roman > 0, "roman").otherwise("unknown")
    return pages.withColumn("segment_kind", kind)


def segments(pages: DataFrame, doc: str, jump: int = 20) -> DataFrame:
    """pages with `transition` from the page before and the running `segment` it starts."""
    along = Window.partitionBy(doc).orderBy("page_idx")
    kind, value, at = (F.lag(c).over(along) for c in ("kind", "number", "page_idx"))
    step, gap = F.col("number") - value, F.col("page_idx") - at
    same = (kind == F.col("kind")) & F.col("kind").isin("arabic", "roman")
    other = kind.isin("arabic", "roman") & F.col("kind").isin("arabic", "roman") & (kind != F.col("kind"))
    told = F.when(other, "kind_transition").when(same & ((step <= 0) | (F.abs(step - gap) >= jump)), "restart_transition")
    return pages.withColumn("transition", told).withColumn("segment", F.sum(F.col("transition").isNotNull().cast("int")).over(along))


def nearest_of_kind(pages: DataFrame, doc: str) -> DataFrame:
    """pages with the previous and next number of their kind, and the number both project, if they agree."""
    along = Window.partitionBy(doc, "kind").orderBy("page_idx")
    place = F.when(F.col("number").isNotNull(), F.struct("page_idx", "number"))
    before = F.last(place, True).over(along.rowsBetween(Window.unboundedPreceding, -1))
    # a frame up to the end is read anew for every row; from the end backwards it grows row by row
    after = F.last(place, True).over(Window.partitionBy(doc, "kind").orderBy(F.desc("page_idx")).rowsBetween(Window.unboundedPreceding, -1))
    out = pages.withColumn("_b", before).withColumn("_a", after)
    down, up = F.col("_b.number") + F.col("page_idx") - F.col("_b.page_idx"), F.col("_a.number") - F.col("_a.page_idx") + F.col("page_idx")
    return out.select(*pages.columns, F.col("_b.number").alias("previous"), F.col("_a.number").alias("next"), F.when(down == up, down).alias("projected"))


def folio_support(pages: DataFrame, doc: str, reach: int = 4) -> DataFrame:
    """pages with how many pages within `reach` have a number that supports theirs."""
    near = Window.partitionBy(doc, F.col("number") - F.col("page_idx")).orderBy("page_idx").rangeBetween(-reach, reach)
    return pages.withColumn("support", F.when(F.col("number").isNotNull(), F.count("*").over(near) - 1))


def edge_sequences(candidates: DataFrame, doc: str) -> DataFrame:
    """The number of each page that the longest regular run gives it: doc, page_idx, number, run.

    candidates: page_idx, zone, number. A run stays in one zone, on every page (of three at least) or on
    every second one (of four), its numbers growing by one or two a step; ties go to the denser run, the
    smaller step, the zone's name and the earlier start.
    """
    ways = F.explode(F.array(*(F.struct(F.lit(d).alias("distance"), F.lit(s).alias("step")) for d in (1, 2) for s in (1, 2))))
    rows = candidates.withColumn("w", ways).select(doc, "page_idx", "zone", "number", "w.*").distinct()
    rows = rows.withColumn("line", F.col("number") * F.col("distance") - F.col("page_idx") * F.col("step")).withColumn("lane", F.col("page_idx") % F.col("distance"))
    key = [doc, "zone", "distance", "step", "line", "lane"]
    island = F.floor(F.col("page_idx") / F.col("distance")) - F.row_number().over(Window.partitionBy(*key).orderBy("page_idx"))
    rows = rows.withColumn("island", island)
    size = F.count("*").over(Window.partitionBy(*key, "island"))
    start = F.min("page_idx").over(Window.partitionBy(*key, "island"))
    runs = rows.withColumns({"run": size, "start": start}).where(F.col("run") >= F.when(F.col("distance") == 1, 3).otherwise(4))
    best = F.row_number().over(Window.partitionBy(doc, "page_idx").orderBy(F.desc("run"), "distance", "step", "zone", "start", "number"))
    return runs.withColumn("_k", best).where("_k = 1").select(doc, "page_idx", "number", "run")


def repair_proposals(pages: DataFrame, doc: str) -> DataFrame:
    """pages with action, confidence and reason of a repair of the printed number.

    pages: page_idx, raw, number, kind, projected, segment, status, segment_kind, boundary, anomaly.
    Only stable segments are repaired; their pages next to an unstable one are guarded: an eighth of
    the segment, one to three pages, and as many again in which no empty number is filled.
    """
    of = Window.partitionBy(doc, "segment")
    out = pages.withColumns({"_n": F.count("*").over(of), "_i": F.row_number().over(of.orderBy("page_idx")) - 1})
    ends = out.groupBy(doc, "segment").agg(F.first("status").alias("s"))
    order = Window.partitionBy(doc).orderBy("segment")
    sides = ends.select(doc, "segment", (F.lag("s").over(order) != "stable").alias("_left"), (F.lead("s").over(order) != "stable").alias("_right"))
    out = out.join(sides, [doc, "segment"])
    band = F.when(F.col("_n") >= 6, F.least(F.lit(3), F.greatest(F.lit(1), F.floor(F.col("_n") / 8)))).otherwise(0)
    from_edge = F.least(F.when(F.col("_left"), F.col("_i")).otherwise(10**6), F.when(F.col("_right"), F.col("_n") - 1 - F.col("_i")).otherwise(10**6))
    trust = F.when(F.col("kind") == "roman", 0.94).otherwise(0.96)
    blank, off = F.col("number").isNull(), F.col("number") != F.col("projected")
    told = (
        F.when(F.col("status") != "stable", F.struct(F.lit("abstain").alias("action"), F.lit(None).cast("double").alias("confidence"), F.lit("unstable_segment").alias("reason")))
        .when(F.col("segment_kind") == "mixed", _told("abstain", None, "mixed_window"))
        .when(F.col("boundary"), _told("abstain", None, "boundary"))
        .when(from_edge < band, _told("abstain", None, "guard_band"))
        .when(blank & F.col("projected").isNotNull() & (from_edge < 2 * band), _told("abstain", None, "near_band"))
        .when(blank & F.col("projected").isNotNull(), _told("fill_null", trust, "two_sided"))
        .when(off & (F.col("kind") == "roman"), _told("abstain", None, "roman_replace"))
        .when(off, _told("replace", trust, "two_sided"))
        .when(blank & F.col("raw").isNotNull(), _told("delete_to_null", 0.8, "unparsable"))
        .when(F.col("anomaly"), _told("delete_to_null", 0.78, "anomaly"))
        .otherwise(_told("keep", None, None))
    )
    return out.withColumn("_t", told).select(*pages.columns, "_t.action", "_t.confidence", "_t.reason")


def _told(action: str, confidence, reason: str | None):
    sure = confidence if hasattr(confidence, "cast") else F.lit(confidence)
    return F.struct(F.lit(action).alias("action"), sure.cast("double").alias("confidence"), F.lit(reason).cast("string").alias("reason"))
