"""N-gram Jaccard self-join: a MinHash LSH forest proposes, exact set comparison decides."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, claim, fresh, map_texts, texts_of
from .decontamination import _HASHES, word_hashes
from .graph import components

#: Prefix tries, the minima on a path from root to leaf, and the bytes of one in a signature.
TREES, MAX_DEPTH, MINIMUM_BYTES = 24, 8, 2
#: Sets compared with each other in one step of a task, and their bytes.
BLOCK, BLOCK_BYTES = 400, 16 << 20
#: Rows of 16-byte keys up to which a side is broadcast; beyond, both sides are shuffled.
BROADCAST_ROWS = 300_000
#: Steps of similarity by which links are counted, and the margin kept for rounding.
STEP, MARGIN = 0.01, 1e-6


def meeting(similarity: float, depth: int, trees: int = TREES) -> float:
    """The probability that two sets share a prefix of `depth` minima in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def found_share(links: dict[float, int], depth: int, threshold: float) -> float:
    """The recall that the links found at a depth tell of, by their similarities.

    A link of similarity s stands for 1 / meeting(s) links, as so many of its kind are met. One more at
    the threshold is taken as given, so that few links do not tell of a sure recall.
    """
    known = {**links, threshold: links.get(threshold, 0) + 1}
    return sum(known.values()) / sum(n / meeting(max(s, threshold), depth) for s, n in known.items())


def next_depth(links: dict[float, int], depth: int, threshold: float, recall: float) -> int:
    """The longest prefix under `depth` that is to tell of that recall, going by the links found at `depth`: those between cost a comparison each and would not end the search."""
    for shorter in range(depth - 1, 1, -1):
        likely = {s: n * meeting(max(s, threshold), shorter) / meeting(max(s, threshold), depth) for s, n in links.items()}
        if found_share(likely, shorter, threshold) >= recall:
            return shorter
    return 1


def shingles(text: str, words: int = 5) -> np.ndarray:
    """Hashes of the distinct word n-grams; a text of fewer words has one, of all of them; none without words."""
    h = word_hashes(text)
    n = len(h)
    if n == 0:
        return h
    width = min(words, n)
    out = np.full(n - width + 1, width, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(width):
            out ^= h[j : n - width + 1 + j]
            out *= np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(31)
    return np.unique(out)


def _factors(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(1, 1 << 32, n, np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, np.uint32)


def signature(sets: np.ndarray, depth: int = MAX_DEPTH, trees: int = TREES) -> bytes:
    """Tree by tree, the path of a set: its minima, most significant byte first, so that paths sort as bytes."""
    a, b = _factors(trees * depth)
    low = np.full(trees * depth, 0xFFFFFFFF, np.uint32)
    folded = (sets ^ (sets >> np.uint64(32))).astype(np.uint32)
    for at in range(0, len(folded), 4096):
        x = folded[None, at : at + 4096] * a[:, None] + b[:, None]
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        np.minimum(low, x.min(1), out=low)
    # a minimum is small by nature: its low bytes are the ones that tell sets apart
    low = (low * np.uint32(0x9E3779B1)) >> np.uint32(32 - 8 * MINIMUM_BYTES)
    return low.astype(f">u{MINIMUM_BYTES}").tobytes()


def path(tree: int, depth: int, column: str = "signature"):
    """The prefix of `depth` minima on a tree's path, after the tree's number."""
    start = tree * MAX_DEPTH * MINIMUM_BYTES + 1
    return F.concat(F.lit(bytes([tree])), F.substring(column, start, depth * MINIMUM_BYTES))


def node_of(sets: np.ndarray) -> bytes:
    return xxhash.xxh128_digest(sets.tobytes())


def _overlaps(first: list[np.ndarray], second: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of all intersections, by products over the n-grams that occur in more than one set."""
    every = first + (second or [])
    flat = np.concatenate(every)
    owner = np.repeat(np.arange(len(every)), [len(x) for x in every])
    values, place, n = np.unique(flat, return_inverse=True, return_counts=True)
    shared = n[place] > 1
    place, owner = (np.cumsum(n > 1) - 1)[place[shared]], owner[shared]
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    m = len(first)
    out = np.zeros((m, len(second) if second is not None else m), np.int64)
    step = 4096
    for at in range(0, int(place[-1]) + 1 if len(place) else 0, step):
        low, high = np.searchsorted(place, [at, at + step])
        marks = np.zeros((len(every), step), np.float32)
        marks[owner[low:high], place[low:high] - at] = 1
        # a step's sums are at most its width, so they are whole numbers
        out += (marks[:m] @ (marks[m:] if second is not None else marks).T).astype(np.int64)
    return out


def _roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least member of each one's component; links are given by positions."""
    root = np.arange(n)
    while True:
        before = root.copy()
        np.minimum.at(root, left, before[right])
        np.minimum.at(root, right, before[left])
        root = root[root]
        if (root == before).all():
            return root


def link_block(sets: list[np.ndarray], weights: np.ndarray, second_block: np.ndarray | None, threshold: float, slack: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, dict[float, int]]:
    """By set: the weight of its links here, and its root among the linked; and the links by similarity.

    `second_block` marks the sets of the second of two blocks that meet; None: all meet each other.
    Pairs whose `slack` already proves their link are left out.
    """
    sizes = np.array([len(x) for x in sets], np.int64)
    across = second_block is not None
    first = np.flatnonzero(~second_block) if across else np.arange(len(sets))
    second = np.flatnonzero(second_block) if across else first
    if not len(first) or not len(second):
        return np.zeros(len(sets), np.int64), np.arange(len(sets)), {}
    common = _overlaps([sets[i] for i in first], [sets[i] for i in second] if across else None)
    union = sizes[first][:, None] + sizes[second][None, :] - common
    linked = common >= threshold * union - MARGIN
    if slack is not None:
        linked &= ~proven(slack[first][:, None], slack[second][None, :])
    if not across:
        np.fill_diagonal(linked, False)
    links = np.zeros(len(sets), np.int64)
    links[first] += linked @ weights[second]
    if across:
        links[second] += linked.T @ weights[first]
    i, j = np.nonzero(linked)
    alike = np.floor(common[i, j] / np.maximum(union[i, j], 1) / STEP + MARGIN).astype(np.int64)
    values, counts = np.unique(alike if across else alike[i < j], return_counts=True)
    return links, _roots(len(sets), first[i], second[j]), {round(v * STEP, 6): int(n) for v, n in zip(values.tolist(), counts.tolist(), strict=True)}


def proven(a, b):
    """Whether two slacks prove a link.

    Sets are linked when their symmetric difference is at most r = (1 - t) / (1 + t) times both sizes. The
    differences to a third set bound it, so with slack = difference to it - r * size a sum of 0 is enough.
    """
    return a + b <= -MARGIN


def _meet(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """Join with `right` broadcast while it has few rows; else both sides are shuffled."""
    return left.join(F.broadcast(right) if right.count() <= BROADCAST_ROWS else right, on, how)


def _id_of(ident: str):
    """Ids as numbers; the lowest one where there is none."""
    return F.coalesce(F.col(ident).cast("long"), F.lit(-(1 << 63)))


def _signed(docs: DataFrame, words: int) -> DataFrame:
    """By row: given (its id), id, node (its set's digest), size (of the set) and signature (empty without words)."""

    def make():
        claim("words", _HASHES.clear)

        def run(part: pa.RecordBatch) -> list[pa.Array]:
            sets = [shingles(t, words) for t in texts_of(part, "text")]
            return [pa.array([node_of(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array([signature(s) if len(s) else b"" for s in sets], pa.binary())]

        return run

    fields = [T.StructField("node", T.BinaryType()), T.StructField("size", T.LongType()), T.StructField("signature", T.BinaryType())]
    return map_texts(docs, "text", fields, make, keep=["given", "id"])


def _hung(nodes: DataFrame, depth: int, scratch: Scratch) -> tuple[DataFrame, tuple]:
    """(u, v): each node that shares a prefix of `depth` minima with others hangs on the least of them; and a mark of all rows.

    A trie's inner nodes are its sorted prefixes; even a huge group below one has a row a node.
    """
    entries = nodes.where("size > 0").select("node", F.explode(F.array(*(path(t, depth) for t in range(TREES)))).alias("prefix"))
    shared = scratch.write(entries.groupBy("prefix").agg(F.min("node").alias("lead"), F.count("*").alias("c")).where("c > 1").select("prefix", "lead"))
    hung = scratch.write(entries.join(shared, "prefix").where("node <> lead").select(F.col("node").alias("u"), F.col("lead").alias("v")).distinct())
    scratch.drop(shared)
    return hung, tuple(hung.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def _groups(hung: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root, pivot) of the nodes that hang together, over any number of steps; the pivot is the one that most of a group hang on."""
    near = scratch.write(components(hung, scratch))
    leads = hung.groupBy(F.col("v").alias("node")).agg(F.count("*").alias("degree"))
    pivots = scratch.write(near.join(leads, "node").groupBy("root").agg(F.max_by("node", F.struct("degree", "node")).alias("pivot")))
    out = scratch.write(near.join(pivots, "root"))
    scratch.drop(hung, near, pivots)
    return out


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """`wanted` (id, node and more) with the set of each node, from the text of the row that stands for it."""

    def make():
        claim("words", _HASHES.clear)

        def run(part: pa.RecordBatch) -> list[pa.Array]:
            sets = [shingles(t, words) for t in texts_of(part, "text")]
            return [pa.array([node_of(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())]

        return run

    fields = [T.StructField("own", T.BinaryType()), T.StructField("set", T.BinaryType())]
    kept = [c for c in wanted.columns if c != "id"]
    return map_texts(_meet(docs.select("id", "text"), wanted, "id"), "text", fields, make, keep=kept).where("own = node").dropDuplicates(["node"]).drop("own")


FOUND = "root binary, node binary, links long, to binary, alike double, pairs long"


def _large(sets: DataFrame, threshold: float, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """For groups of more than a block: (links that differences to the pivot prove, the members that need comparison).

    A set that is close enough to its group's pivot is linked to all others by the triangle inequality, and how
    many that are is counted by slack; only sets whose slack leaves some pair open are compared.
    """
    ratio = (1 - threshold) / (1 + threshold)
    pivots = scratch.write(sets.where("node = pivot").select("root", F.col("set").alias("pivot_set")))
    kept = ["root", "node", "n", "size", "members", "bytes", "set"]
    beside = sets.select(*kept).join(pivots, "root")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                slack = []
                for own, other in zip(part.column("set"), part.column("pivot_set"), strict=True):
                    a, b = np.frombuffer(own.as_buffer(), np.uint64), np.frombuffer(other.as_buffer(), np.uint64)
                    slack.append(len(np.setxor1d(a, b, assume_unique=True)) - ratio * len(a))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(slack, pa.float64())], names=[*kept, "slack"])

    schema = T.StructType([sets.schema[c] for c in kept] + [T.StructField("slack", T.DoubleType())])
    told = scratch.write(beside.mapInArrow(run, schema))
    levels = told.groupBy("root", "slack").agg(F.sum("n").alias("w"), F.min("node").alias("one"))

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["slack", "one"])
        slack = rows["slack"].to_numpy()
        upto = np.append(0, np.cumsum(rows["w"].to_numpy(np.int64)))
        sure = upto[np.searchsorted(slack, -MARGIN - slack, side="right")]
        return pd.DataFrame({"root": rows["root"], "slack": slack, "sure": sure, "centre": rows["one"].iloc[0], "least": slack[0], "worst": slack[-1]})

    counted = scratch.write(levels.groupBy("root").applyInPandas(count, "root binary, slack double, sure long, centre binary, least double, worst double"))
    told = told.join(counted, ["root", "slack"])
    own = F.when(2 * F.col("slack") <= -MARGIN, F.col("n")).otherwise(0)
    to = F.when((F.col("slack") + F.col("least") <= -MARGIN) & (F.col("node") != F.col("centre")), F.col("centre")).otherwise(F.col("node"))
    sure = told.select("root", "node", (F.col("sure") - own).cast("long").alias("links"), to.alias("to"), F.lit(None).cast("double").alias("alike"), F.lit(0).cast("long").alias("pairs")).where("links > 0")
    return sure, told.where(F.col("slack") + F.col("worst") > -MARGIN).select(*kept, "slack")


def _compared(sets: DataFrame, packs: int, threshold: float) -> DataFrame:
    """Exact comparison of the sets of each group, in blocks of bounded sets and bytes: rows of FOUND."""
    blocks = F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES), F.lit(1)).cast("int")
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    pack = F.struct(F.lit(None).cast("binary").alias("root"), F.pmod(F.xxhash64("root"), F.lit(packs)).cast("int").alias("i"), F.lit(-1).alias("j"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.col("root").alias("root"), F.least(o, F.col("mine")).alias("i"), F.greatest(o, F.col("mine")).alias("j")))
    placed = sets.withColumn("blocks", blocks).withColumn("mine", mine)
    dealt = placed.withColumn("at", F.explode(F.when(F.col("blocks") == 1, F.array(pack)).otherwise(pairs))).select("node", "n", "set", "root", "slack", "mine", F.col("at.root").alias("k"), "at.i", "at.j")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        out, alike = [], {}
        for key, part in rows.groupby("root", sort=False):
            ids = part["node"].tolist()
            arrays = [np.frombuffer(x, np.uint64) for x in part["set"]]
            i, j = int(part["i"].iloc[0]), int(part["j"].iloc[0])
            slack = part["slack"].to_numpy(np.float64)
            links, root, seen = link_block(arrays, part["n"].to_numpy(np.int64), part["mine"].to_numpy() == j if i != j and j >= 0 else None, threshold, None if np.isnan(slack).any() else slack)
            out += [(key, ids[i], int(links[i]), ids[root[i]], None, 0) for i in np.flatnonzero(links)]
            out += [(key, None, 0, None, s, n) for s, n in seen.items()]
        return pd.DataFrame(out, columns=["root", "node", "links", "to", "alike", "pairs"])

    return dealt.groupBy("k", "i", "j").applyInPandas(compare, FOUND)


def _verified(docs: DataFrame, plan: DataFrame, threshold: float, words: int, scratch: Scratch) -> DataFrame:
    """The links within the groups of `plan` (id, node, n, size, root, pivot, members, bytes): rows of FOUND."""
    small = (F.col("members") <= BLOCK) & (F.col("bytes") <= BLOCK_BYTES)
    sums = plan.agg(F.sum(F.when(small, 1)).alias("rows"), F.sum(F.when(small, 8 * F.col("size"))).alias("bytes"), F.count_if(~small).alias("large")).first()
    packs = max(1, -(-(sums["rows"] or 0) // BLOCK), -(-(sums["bytes"] or 0) // BLOCK_BYTES))
    sets = _sets(docs, plan, words)
    columns = ["root", "node", "n", "set", "members", "bytes", "slack"]
    if not sums["large"]:
        return scratch.write(_compared(sets.withColumn("slack", F.lit(None).cast("double")).select(*columns), packs, threshold))
    sets = scratch.write(sets)
    sure, opened = _large(sets.where(~small), threshold, scratch)
    opened = scratch.write(opened)
    left = opened.groupBy("root").agg(F.count("*").alias("members"), F.sum(8 * F.col("size")).alias("bytes"))
    opened = opened.drop("members", "bytes").join(left, "root")
    out = _compared(sets.where(small).withColumn("slack", F.lit(None).cast("double")).select(*columns).unionByName(opened.select(*columns)), packs, threshold)
    return scratch.write(out.unionByName(sure))


def _classes(df: DataFrame, text: str = "text", ident: str = "doc_id", threshold: float = 0.8, words: int = 5, recall: float = 0.999) -> tuple[DataFrame, DataFrame]:
    """By row: given, id, node (its set); by node: rep (its lowest id), root, class_id, n_links."""
    spark = df.sparkSession
    scratch = Scratch(spark, "jaccard")
    docs = df.select(F.col(ident).alias("given"), _id_of(ident).alias("id"), F.col(text).alias("text"))
    signed = scratch.write(_signed(docs, words))
    nodes = scratch.write(signed.groupBy("node").agg(F.min("id").alias("rep"), F.min("given").alias("low"), F.count("*").alias("n"), F.first("size").alias("size"), F.first("signature").alias("signature")))
    before = verified = mark = None
    depth, seen = MAX_DEPTH + 1, {}
    while depth > 1:
        depth = MAX_DEPTH if depth > MAX_DEPTH else next_depth(seen, depth, threshold, recall)
        hung, now_mark = _hung(nodes, depth, scratch)
        if now_mark == mark:  # nothing more hangs together than at the longer prefix
            if found_share(seen, depth, threshold) >= recall:
                break
            continue
        mark = now_mark
        near = _groups(hung, scratch)
        member = near.join(nodes.select("node", "rep", "n", "size"), "node")
        groups = scratch.write(member.groupBy("root").agg(F.count("*").alias("members"), F.sum(8 * F.col("size")).alias("bytes"), F.bit_xor(F.xxhash64("node")).alias("mark")))
        # a shorter prefix only adds to groups: those that stay as they were are not compared again
        fresh = groups if before is None else groups.join(before.select("root", "members", "mark"), ["root", "members", "mark"], "left_anti")
        plan = scratch.write(member.join(fresh.drop("mark"), "root").select(F.col("rep").alias("id"), "node", "n", "size", "root", "pivot", "members", "bytes"))
        now = _verified(docs, plan, threshold, words, scratch)
        if verified is not None:
            same = groups.join(before.select("root", "members", "mark"), ["root", "members", "mark"], "left_semi").select("root")
            now = scratch.write(now.unionByName(verified.join(same, "root", "left_semi").select(*now.columns)))
        before, verified = groups, now
        scratch.drop(near, plan)
        seen = {r["alike"]: r["pairs"] for r in verified.where("alike is not null").groupBy("alike").agg(F.sum("pairs").alias("pairs")).collect()}
        if found_share(seen, depth, threshold) >= recall:
            break
    links = verified.where("node is not null")
    linked = links.groupBy("node").agg(F.sum("links").alias("links"))
    joined = scratch.write(components(links.select(F.col("node").alias("u"), F.col("to").alias("v")), scratch))
    classes = scratch.write(joined.join(nodes.select("node", "low"), "node").groupBy("root").agg(F.min("low").alias("class_id"), F.min("node").alias("least")))
    extra = scratch.write(joined.join(classes, "root").join(linked, "node").select("node", "root", "class_id", "links"))
    of = nodes.select("node", "rep", "low", "n").join(extra, "node", "left").select("node", "rep", F.coalesce("root", "node").alias("root"), F.when(F.col("root").isNotNull(), F.col("class_id")).otherwise(F.col("low")).alias("class_id"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"))
    # written, so that a set that very many rows have can be split in the join with the rows
    return signed.select("given", "id", "node"), scratch.write(of)


def jaccard_classes(df: DataFrame, text: str = "text", ident: str = "doc_id", threshold: float = 0.8, words: int = 5, recall: float = 0.999) -> DataFrame:
    """One row per row of `df`: ident, class_id (the lowest id linked to it, over any number of links) and n_links.

    Rows are linked when the Jaccard similarity of their sets of `words`-word n-grams is at least
    `threshold`; n_links counts the other rows it is linked to. Equal sets are one node with a weight
    from the first step on, so copies are never paired. Texts without words (null and empty ones
    too) have the empty set and are linked to each other only; shorter texts than `words` have one
    n-gram; a row with a null id keeps it, and the class_id is the lowest id that is not null (null, if none
    is); rows that share an id are one document in class_id but are counted one by one; an empty table
    gives an empty result. Other columns are not read.

    TREES prefix tries hold the signatures. Matching starts at whole paths; while the links found
    tell by their similarities that more than 1 - `recall` of all are missed, the matched prefix is
    shortened to where they tell of enough and the groups that have grown are compared again. Comparison is exact:
    set against set in blocks of bounded bytes, and in groups of more than a block only the pairs
    that the distances to the group's pivot leave open. Only counts and roots leave a task, never pairs.
    """
    signed, of = _classes(df, text, ident, threshold, words, recall)
    return signed.join(of, "node").select(F.col("given").alias(ident), "class_id", "n_links")


def drop_near_duplicates(df: DataFrame, text: str = "text", ident: str = "doc_id", words: int = 5, **how) -> DataFrame:
    """One document of each class of `df`: the row of the lowest id, where a null id is the lowest.

    Of rows with the same id (or none) the one with the lowest set stays, and one of equal sets.
    """
    signed, of = _classes(df, text, ident, words=words, **how)
    lowest = of.groupBy("root").agg(F.min("rep").alias("keeps"))
    gone = signed.join(Scratch(df.sparkSession, "keeps").write(of.join(lowest, "root").select("node", "keeps")), "node").where("id <> keeps").select(F.col("given").alias(ident)).distinct()
    key, mark = fresh(df, "_id"), fresh(df, "_node")
    again = Scratch(df.sparkSession, "again").write(signed.groupBy("id").agg(F.count("*").alias("c")).where("c > 1").select(F.col("id").alias(key)))
    if again.isEmpty():
        return _meet(df, gone, ident, "left_anti")

    def make():
        claim("words", _HASHES.clear)
        return lambda part: [pa.array([node_of(shingles(t, words)) for t in texts_of(part, text)], pa.binary())]

    rows = df.withColumn(key, _id_of(ident))
    once = _meet(_meet(rows, again, key, "left_anti"), gone.withColumnRenamed(ident, key), key, "left_anti")
    stays = of.groupBy("root").agg(F.min(F.struct("rep", "node")).alias("k")).select(F.col("k.rep").alias(key), F.col("k.node").alias(mark))
    told = map_texts(_meet(rows, again, key, "left_semi"), text, [T.StructField(mark, T.BinaryType())], make)
    one = told.join(stays, [key, mark], "left_semi").dropDuplicates([key, mark])
    return once.select(*df.columns).unionByName(one.select(*df.columns))
