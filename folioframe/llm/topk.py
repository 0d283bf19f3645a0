"""Exact top-k inner products by no-random-access aggregation over sorted component lists."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import exact_products, integer_components, integers, product_bound

#: Rows of a block: expected queries, expected candidates.
QUERY_BLOCK, CANDIDATE_BLOCK = 2048, 4096
#: Queries whose bounds are held at once.
BATCH = 256
#: Shares of the lists after which bounds are compared.
DEPTHS = (0.125, 0.25, 0.5, 0.75)


def search_block(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> pd.DataFrame:
    """The k best of a block's candidates for each query, ties to the smaller id, own id left out.

    Each component has a list of the block's values in falling order, read from the top for queries
    with a positive weight there and from the bottom for the others, to the same depth for all. An
    unread value lies between the list's frontiers, so a candidate's score is at most the upper and
    at least the lower bound made of read values and frontiers. Reading stops when few candidates
    could still pass a query's k-th lower bound; only those get their final scores.
    """
    n, dims = c.shape
    plus, minus = np.maximum(q, 0), np.minimum(q, 0)
    order = np.argsort(-c, axis=0, kind="stable")
    lists = np.take_along_axis(c, order, 0)
    column = np.arange(dims)
    own = c_ids[None, :] == q_ids[:, None]
    open_ = ~own
    high = np.broadcast_to(lists[0], c.shape).copy()  # upper bound of each value, read from the top
    low = np.broadcast_to(lists[-1], c.shape).copy()  # lower bound, read from the bottom
    read = 0
    large = product_bound(q, c) >= 1 << 63  # no room for bounds: all are scored
    for share in DEPTHS:
        if n <= 4 * k or large:
            break
        depth = max(1, int(n * share))
        for at, bound, values in ((order[read:depth], high, lists[read:depth]), (order[n - depth : n - read], low, lists[n - depth : n - read])):
            bound[at, column] = values
        unread_top = np.ones(c.shape, bool)
        unread_top[order[:depth], column] = False
        unread_low = np.ones(c.shape, bool)
        unread_low[order[n - depth :], column] = False
        high = np.where(unread_top, lists[depth - 1], high)
        low = np.where(unread_low, lists[n - depth], low)
        read = depth
        # a value read from either end is known to both bounds
        known_high = np.where(unread_low, high, low)
        known_low = np.where(unread_top, low, high)
        upper = exact_products(plus, known_high) + exact_products(minus, known_low)
        lower = exact_products(plus, known_low) + exact_products(minus, known_high)
        floor = np.where(own, np.iinfo(np.int64).min, lower)
        kth = np.partition(floor, n - k, axis=1)[:, n - k]
        open_ &= upper >= kth[:, None]
        if open_.sum() <= 4 * k * len(q):
            break
    out_q, out_c, out_s = [], [], []
    for i in range(len(q)):
        left = np.flatnonzero(open_[i])
        scores = exact_products(q[i : i + 1], c[left])[0] if len(left) else np.zeros(0, np.int64)
        best = np.lexsort((c_ids[left], ~scores))[:k]
        out_q.append(np.full(len(best), q_ids[i]))
        out_c.append(c_ids[left][best])
        out_s.append(scores[best])
    whole = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_q, out_c, out_s)]
    return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), whole, strict=True)))


def top_k(vectors: DataFrame, is_query, k: int = 5, ident: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """The k highest integer inner products of each query row with every other row: query_id, rank, vec_id, score.

    Components become floor(scale * x). Rows whose id or vector is null, or whose vector holds a null
    or non-finite component, take no part, nor do rows of another length than a query's. Ties go to
    the smaller id; a repeated row (equal id and vector) counts once; rows of one id with unlike vectors are
    candidates and queries of that id each, merged in its one ranking; a query with fewer than k others has fewer
    rows; an empty table gives none. A score beyond 63 bits counts as the largest or smallest such number.

    Queries and candidates are dealt into blocks by a digest of their id, and each pair of blocks is
    a task of bounded size: the stated query set meets all rows in blocks. A block keeps k rows a
    query, and the blocks' results are merged by rank.
    """
    rows = vectors.select(F.col(ident).cast("long").alias("vec_id"), integer_components(F.col(vector), scale).alias("v"), is_query.alias("asks")).where("vec_id is not null and v is not null").dropDuplicates(["vec_id", "v"])
    sizes = rows.agg(F.count("*").alias("n"), F.sum(F.col("asks").cast("long")).alias("q")).first()
    n_query, n_block = (max(1, -(-(x or 0) // most)) for x, most in ((sizes["q"], QUERY_BLOCK), (sizes["n"], CANDIDATE_BLOCK)))
    numbered = rows.withColumns({"d": F.size("v"), "qb": F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(n_query)).cast("int"), "cb": F.pmod(F.xxhash64(F.lit(2), "vec_id"), F.lit(n_block)).cast("int")})
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    asked = numbered.where("asks").select("vec_id", "v", "d", "qb", every(n_block).alias("cb"))
    there = numbered.select("vec_id", "v", "d", "cb", every(n_query).alias("qb"))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({c: np.zeros(0, np.int64) for c in ("query_id", "vec_id", "score")})
        as_array = lambda x: (x["vec_id"].to_numpy(np.int64), integers(np.stack(x["v"].to_numpy())))
        (q_ids, q), there = as_array(left), as_array(right)
        return pd.concat([search_block(q_ids[at : at + BATCH], q[at : at + BATCH], *there, k) for at in range(0, len(q), BATCH)])

    keys = ["qb", "cb", "d"]
    found = asked.groupBy(*keys).cogroup(there.groupBy(*keys)).applyInPandas(run, "query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
