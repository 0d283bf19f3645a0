"""Small type among the text: runs of it along a block, and blocks that are annotations as a whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Brackets that enclose an annotation, and the names of its kinds: in brackets, in double lines, short and longer small type, other.
ENCLOSING = (("(", ")"), ("（", "）"), ("[", "]"), ("【", "】"), ("{", "}"), ("〔", "〕"), ("〈", "〉"), ("《", "》"))
BRACKETED, DOUBLED, SHORT, LONGER, OTHER = "括号注", "双行小字", "夹注", "割注", "其他小字注"
SMALL, SMALLER, LONGEST, SPREAD = 0.75, 0.7, 100, 0.3


def enclosed(text: Column) -> Column:
    """The text begins with a bracket and ends with the one that closes it."""
    pair = F.create_map(*(F.lit(x) for p in ENCLOSING for x in p))
    t = F.trim(text)
    return F.coalesce(F.try_element_at(pair, F.substring(t, 1, 1)) == F.substring(t, -1, 1), F.lit(False))


def page_sizes(spans: DataFrame) -> DataFrame:
    """(page, main): the median type size of a page's spans."""
    return spans.where("size is not null").groupBy("page").agg(F.median("size").alias("main"))


def inline_annotations(spans: DataFrame) -> DataFrame:
    """(page, block, subtype, ratio) of the texts that are annotations: in small type, of mixed sizes or in brackets, LONGEST signs at most.

    spans: page, block, ord, text, size (or null), small (marked so by the source).
    """
    listed = F.array_sort(F.collect_list(F.struct("ord", F.coalesce("text", F.lit("")).alias("text"))))
    blocks = spans.groupBy("page", "block").agg(F.trim(F.array_join(F.transform(listed, lambda x: x["text"]), " ")).alias("text"), F.avg("size").alias("mean"), F.min("size").alias("low"), F.max("size").alias("high"), F.count("size").alias("sized"), F.coalesce(F.bool_or("small"), F.lit(False)).alias("small"))
    rows = blocks.join(page_sizes(spans), "page", "left")
    ratio = F.coalesce(F.col("mean") / F.col("main"), F.lit(1.0))
    mixed = F.coalesce((F.col("sized") > 1) & ((F.col("high") - F.col("low")) / F.col("high") > SPREAD), F.lit(False))
    length = F.length("text")
    rows = rows.withColumns({"ratio": ratio, "bracketed": enclosed(F.col("text")), "mixed": mixed})
    found = rows.where(length.between(1, LONGEST) & ((F.col("ratio") < SMALL) | F.col("small") | F.col("bracketed") | F.col("mixed")))
    subtype = F.when(F.col("bracketed"), BRACKETED).when(F.col("mixed"), DOUBLED).when((F.col("ratio") < SMALLER) & (length < 30), SHORT).when((F.col("ratio") < SMALLER) & (length < LONGEST), LONGER).otherwise(OTHER)
    return found.select("page", "block", subtype.alias("subtype"), "ratio")


def small_runs(spans: DataFrame, least: int = 2, rounds: int = 2) -> DataFrame:
    """(page, block, first, last, text, ratio): where along a block its type turns small and where it turns back.

    A span is small under SMALL of its page's main size; spans without a size go with the span before. Runs of under `least` signs
    between two of the other kind are noise and go with them; this is done `rounds` times, as each round joins runs.
    """
    block = Window.partitionBy("page", "block")
    along = block.orderBy("ord", "text")
    # one order serves what is read along a block, of a page and of a run: each further order would be one more sort of all spans in the same task
    rows = spans.withColumn("known", F.last("size", True).over(along))
    # the sizes are read through what is known, as Spark would else put this window first, in an order of its own
    main = F.median(F.when(F.col("known").isNotNull(), F.col("size"))).over(Window.partitionBy("page"))
    rows = rows.withColumn("main", F.when(F.col("page").isNotNull(), main))
    rows = rows.withColumn("level", F.coalesce(F.col("known") < SMALL * F.col("main"), F.lit(False))).drop("known")
    for k in range(rounds):
        run = f"run{k}"
        turn = F.coalesce(F.lag("level").over(along) != F.col("level"), F.lit(True))
        rows = rows.withColumn(run, F.sum(turn.cast("int")).over(along))
        along = block.orderBy(run, "ord", "text")
        of_run = Window.partitionBy("page", "block", run).orderBy("ord", "text").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        rows = rows.withColumns({"signs": F.sum(F.length(F.trim("text"))).over(of_run), "runs": F.max(run).over(block)})
        noise = (F.col("signs") < least) & (F.col(run) > 1) & (F.col(run) < F.col("runs"))
        rows = rows.withColumn("level", F.when(noise, ~F.col("level")).otherwise(F.col("level"))).drop("signs", "runs")
    turn = F.coalesce(F.lag("level").over(along) != F.col("level"), F.lit(True))
    rows = rows.withColumn("run", F.sum(turn.cast("int")).over(along)).where("level")
    listed = F.array_sort(F.collect_list(F.struct("ord", F.coalesce("text", F.lit("")).alias("text"))))
    return rows.groupBy("page", "block", "run").agg(F.min("ord").alias("first"), F.max("ord").alias("last"), F.array_join(F.transform(listed, lambda x: x["text"]), " ").alias("text"), (F.avg("size") / F.first("main")).alias("ratio")).drop("run")
