"""Merkle manifest of a table: contiguous digest matrices by aligned blocks, with every row's proof.

A group's leaves stand by id and are cut into aligned blocks of BLOCK. A task holds a block's leaves as
one matrix of 64-byte hex digests, reshapes it by the fanout and hashes its rows level by level; the
siblings of a node are found by index arithmetic. The blocks' tops are the leaves of the next table,
until a group has one node, its subroot; the subroots are a group of their own. On the way back each
block gets the path of its top, which its leaves share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch

FANOUT = 8
#: Levels that a block spans, and so fanout ** LEVELS leaves of 64 bytes.
LEVELS = 3
WIDTH = 64


def field(value: Column) -> Column:
    """The bytes that a value adds to a leaf: `-` for null, else its UTF-8 byte count, a colon and itself."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*values: Column) -> Column:
    """Lowercase hex SHA-256 of the values' fields, one after the other."""
    return F.sha2(F.concat(*(field(v) for v in values)).cast("binary"), 256)


def matrix(digests: pa.ChunkedArray) -> np.ndarray:
    """Hex digests as the rows of one contiguous byte matrix."""
    return np.frombuffer("".join(digests.to_pylist()).encode("ascii"), np.uint8).reshape(-1, WIDTH)


def level_up(nodes: np.ndarray, fanout: int) -> np.ndarray:
    """One digest for each `fanout` rows; the last run may be shorter."""
    whole = len(nodes) // fanout
    runs = [row.tobytes() for row in nodes[: whole * fanout].reshape(whole, fanout * WIDTH)]
    if whole * fanout < len(nodes):
        runs.append(nodes[whole * fanout :].tobytes())
    return np.frombuffer("".join(hashlib.sha256(r).hexdigest() for r in runs).encode("ascii"), np.uint8).reshape(-1, WIDTH)


def levels_of(count: int, fanout: int) -> int:
    """Levels above `count` leaves until one node is left."""
    out = 0
    while count > 1:
        count, out = -(-count // fanout), out + 1
    return out


def climb(nodes: np.ndarray, levels: int, fanout: int) -> list[np.ndarray]:
    """The leaves of an aligned block and the nodes of each level above them."""
    out = [nodes]
    for _ in range(levels):
        out.append(level_up(out[-1], fanout))
    return out


def path_of(tree: list[np.ndarray], at: int, fanout: int) -> tuple[str, list[int], list[int]]:
    """Of leaf `at`: its siblings' digests joined, level by level; its place in each run; each run's length."""
    siblings, places, lengths = [], [], []
    for nodes in tree[:-1]:
        first = at - at % fanout
        run = nodes[first : first + fanout]
        place = at - first
        siblings += [run[:place].tobytes(), run[place + 1 :].tobytes()]
        places.append(place)
        lengths.append(len(run))
        at //= fanout
    return b"".join(siblings).decode("ascii"), places, lengths


def fold(leaf: str, proof: str, places: Sequence[int], lengths: Sequence[int]) -> str:
    """The root that a leaf leads to by its proof."""
    at = 0
    for place, length in zip(places, lengths, strict=True):
        own = at + WIDTH * place
        end = at + WIDTH * (length - 1)
        leaf = hashlib.sha256((proof[at:own] + leaf + proof[own:end]).encode("ascii")).hexdigest()
        at = end
    return leaf


def _tree_of(part: pa.Table, fanout: int, levels: int) -> list[np.ndarray]:
    return climb(matrix(part.column("digest")), min(levels, levels_of(part.column("n")[0].as_py(), fanout)), fanout)


def _blocked(nodes: DataFrame, scratch: Scratch, fanout: int, levels: int) -> tuple[DataFrame, DataFrame]:
    """The nodes with their block b, and the blocks' tops as nodes (g, i, n, digest) of the next table."""
    size = fanout**levels
    blocks = nodes.withColumn("b", F.expr(f"i div {size}"))

    def top(part: pa.Table) -> pa.Table:
        part = part.sort_by("i")
        n = part.column("n")[0].as_py()
        return pa.table({"g": part.column("g").slice(0, 1), "i": [part.column("i")[0].as_py() // size], "n": [-(-n // size)], "digest": [_tree_of(part, fanout, levels)[-1].tobytes().decode("ascii")]})

    narrow = blocks.select("g", "i", "n", "digest", "b")
    return blocks, scratch.write(narrow.groupBy("g", "b").applyInArrow(top, "g string, i long, n long, digest string"))


UP = "g string, b long, top string, proof string, places array<int>, lengths array<int>"


def _paths(nodes: DataFrame, scratch: Scratch, fanout: int, levels: int) -> DataFrame:
    """UP: for each node b of nodes (g, i, n, digest) its path to the one node that group g ends in."""
    if not nodes.where("n > 1").limit(1).count():
        none = F.array().cast("array<int>")
        return nodes.select("g", F.col("i").alias("b"), F.col("digest").alias("top"), F.lit("").alias("proof"), none.alias("places"), none.alias("lengths"))
    blocks, above = _blocked(nodes, scratch, fanout, levels)
    up = _paths(above, scratch, fanout, levels)

    def down(part: pa.Table, over: pa.Table) -> pa.Table:
        part = part.sort_by("i")
        path = _own_paths(part, over, fanout, levels)
        return pa.table({"g": part.column("g"), "b": part.column("i"), "top": pa.array([over.column("top")[0].as_py()] * len(part), pa.string()), **path})

    return scratch.write(blocks.groupBy("g", "b").cogroup(up.groupBy("g", "b")).applyInArrow(down, UP))


def _own_paths(part: pa.Table, over: pa.Table, fanout: int, levels: int) -> dict[str, pa.Array]:
    """proof, places and lengths of a block's nodes: their own within the block, then the block's, which all share."""
    tree = _tree_of(part, fanout, levels)
    proof, places, lengths = (over.column(c)[0].as_py() for c in ("proof", "places", "lengths"))
    own = [path_of(tree, at, fanout) for at in range(len(part))]
    ints = pa.list_(pa.int32())
    return {"proof": pa.array([p + proof for p, _, _ in own], pa.string()), "places": pa.array([x + places for _, x, _ in own], ints), "lengths": pa.array([x + lengths for _, _, x in own], ints)}


def _placed(rows: DataFrame, keys: Sequence[Column], scratch: Scratch) -> DataFrame:
    """Append i, the place in group g by `keys`, and n, the group's rows, both from counts by range of the order (g, keys)."""
    order = [F.col("g").asc_nulls_first(), *keys]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    stood = scratch.write(dealt.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)))
    counts = stood.groupBy("g", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    # a row for each range and group that meet
    by_group = Window.partitionBy("g")
    starts = scratch.write(counts.select(F.col("g").alias("of"), F.col("part").alias("in"), "first", F.coalesce(F.sum("n").over(by_group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"), F.sum("n").over(by_group).alias("n")))
    joined = stood.join(starts, (F.col("part") == F.col("in")) & F.col("g").eqNullSafe(F.col("of")))
    return joined.select(*rows.columns, (F.col("start") + F.col("at") - F.col("first")).alias("i"), "n")


def merkle_manifest(df: DataFrame, values: Sequence[str], ident: str = "doc_id", group: str = "lang", claimed: Column | None = None, keep: Sequence[str] = (), fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """Each row's leaf, subroot, root, proof, places, lengths, folded_root and verified.

    A leaf is the digest of the row's `values`; leaves stand by group, id (null first) and digest; rows alike
    in these stand side by side, each with a proof of its own. Groups (null first) stand by the bytes of
    their names. proof: the siblings' hex digests joined, level by level up to the root; places and
    lengths: where the row's node stands in each run and how long the run is. folded_root is where
    `claimed` (a digest of what is to be checked; default: the leaf) leads by that proof, and verified
    says whether that is the root. Null values are told from empty ones; an empty table gives none.
    Texts are read once and do not leave their task. `keep`: further columns to return, named as the caller
    likes; those named like the new ones or the id are left out.

    A task holds a block of fanout ** levels rows, whatever the group; the proofs of a block are written
    to the shared folder as the rows of the result are (64 bytes a sibling, some fanout log(rows)).
    """
    new = ("leaf", "subroot", "root", "proof", "places", "lengths", "folded_root", "verified")
    kept = [c for c in keep if c not in new and c != ident]
    waiting = {c: f"k{j}" for j, c in enumerate(kept)}
    scratch = Scratch(df.sparkSession, "manifest")
    leaf = leaf_digest(*(F.col(f"`{v}`") for v in values))
    own = df.select(F.col(f"`{ident}`").alias("id"), F.col(f"`{group}`").cast("string").alias("group"), leaf.alias("digest"), (claimed if claimed is not None else leaf).alias("claimed"), *(F.col(f"`{c}`").alias(k) for c, k in waiting.items()))
    # the row's place in its file is the last key, so that a large group of copies is dealt over ranges
    rows = scratch.write(own.withColumn("copy", F.monotonically_increasing_id()))
    named = rows.withColumn("g", F.when(F.col("group").isNotNull(), F.concat(F.lit("="), F.col("group"))).otherwise(F.lit("")))
    leaves = scratch.write(_placed(named, [F.col("id").asc_nulls_first(), F.col("digest"), F.col("copy")], scratch))
    blocks, above = _blocked(leaves, scratch, fanout, levels)
    up = _paths(above, scratch, fanout, levels)
    subroots = up.where("b = 0").select(F.lit("").alias("g"), F.col("g").alias("name"), F.col("top").alias("digest"))
    groups = scratch.write(_placed(subroots, [F.col("name")], scratch))
    roofs = _paths(groups.select("g", "i", "n", "digest"), scratch, fanout, levels)
    roofs = groups.join(roofs.withColumnRenamed("b", "i").drop("g"), "i").select(F.col("name").alias("g"), F.col("top").alias("root"), *(F.col(c).alias(f"{c}_over") for c in ("proof", "places", "lengths")))
    # a row a block: far smaller than the leaves
    whole = up.join(roofs, "g").select("g", "b", "top", "root", *(F.concat(c, f"{c}_over").alias(c) for c in ("proof", "places", "lengths")))
    names = list(waiting.values())
    kinds = leaves.select("id", *names)

    def prove(part: pa.Table, over: pa.Table) -> pa.Table:
        part = part.sort_by("i")
        path = _own_paths(part, over, fanout, levels)
        subroot, root = over.column("top")[0].as_py(), over.column("root")[0].as_py()
        proofs = zip(part.column("claimed").to_pylist(), *(path[c].to_pylist() for c in ("proof", "places", "lengths")), strict=True)
        ends = [leaf and fold(leaf, *p) for leaf, *p in proofs]
        return pa.table(
            {c: part.column(c) for c in ["id", *names]}
            | {"digest": part.column("digest"), "subroot": pa.array([subroot] * len(part), pa.string()), "root": pa.array([root] * len(part), pa.string())}
            | path
            | {"folded_root": pa.array(ends, pa.string()), "verified": pa.array([e == root for e in ends], pa.bool_())}
        )

    schema = T.StructType([*kinds.schema.fields, *T.StructType.fromDDL("digest string, subroot string, root string, proof string, places array<int>, lengths array<int>, folded_root string, verified boolean").fields])
    proven = blocks.groupBy("g", "b").cogroup(whole.groupBy("g", "b")).applyInArrow(prove, schema)
    return proven.select(F.col("id").alias(ident), *(F.col(k).alias(c) for c, k in waiting.items()), F.col("digest").alias("leaf"), *new[1:])
