"""Hard negatives by bit-sliced integer products: most significant planes first, intervals tighten, candidates leave.

A candidate's components, less their least value, are cut into bit-planes. After a plane the score of
a pair lies between the planes read so far plus the least and plus the most that the planes left can
add. Pairs whose interval cannot reach what is asked leave after each plane; the few that stay get
their last planes at once, so their scores are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, exact_products, integer_components, integers

#: Rows of a block: expected anchors, expected candidates.
ANCHOR_BLOCK, CANDIDATE_BLOCK = 2048, 8192
#: Anchors whose intervals are held at once.
BATCH = 128
#: A share of pairs that is finished pair by pair.
FEW = 1 / 32


class Planes:
    """Candidates' components cut into bit-planes."""

    def __init__(self, values: np.ndarray):
        self.least = int(values.min()) if values.size else 0
        self.rest = values - self.least
        self.count = int(self.rest.max()).bit_length() if values.size else 0

    def plane(self, bit: int) -> np.ndarray:
        return ((self.rest >> bit) & 1).astype(np.float64)


def bit_sliced(anchors: np.ndarray, planes: Planes, open_: np.ndarray, settle: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, candidate, exact score) of the pairs that stay open; `settle(low, high, open_)` says which do, of intervals that hold each score.

    All sums are exact in float64: components stay under `wide_from`.
    """
    weights = anchors.astype(np.float64)
    read = np.zeros(open_.shape)
    base = weights.sum(1) * planes.least
    plus, minus = np.maximum(weights, 0).sum(1), np.minimum(weights, 0).sum(1)
    bit = planes.count
    while bit and open_.sum() > FEW * open_.size:
        bit -= 1
        read += (weights @ planes.plane(bit).T) * (1 << bit)
        left = (1 << bit) - 1
        middle = read + base[:, None]
        open_ = settle(middle + (minus * left)[:, None], middle + (plus * left)[:, None], open_)
    a, c = np.nonzero(open_)
    scores = read[a, c] + base[a]
    tail = planes.rest & ((1 << bit) - 1)
    if bit:
        for at in range(0, len(a), 1 << 16):
            part = slice(at, at + (1 << 16))
            scores[part] += np.einsum("ij,ij->i", weights[a[part]], tail[c[part]].astype(np.float64))
    return a, c, scores.astype(np.int64)


def _kth_highest(values: np.ndarray, k: int) -> np.ndarray:
    """Each row's k-th highest value; -inf if it has fewer columns."""
    if values.shape[1] < k:
        return np.full(len(values), -np.inf)
    return np.partition(values, values.shape[1] - k, axis=1)[:, values.shape[1] - k]


def highest(k: int) -> Callable:
    """Keep pairs that may be among their anchor's k highest."""

    def settle(low: np.ndarray, high: np.ndarray, open_: np.ndarray) -> np.ndarray:
        return open_ & (high >= _kth_highest(np.where(open_, low, -np.inf), k)[:, None])

    return settle


def within(floor: np.ndarray, roof: np.ndarray, k: int) -> Callable:
    """Keep pairs that may be among the k highest scores in one of their anchor's windows [floor, roof] (anchors x windows; NaN: none)."""

    def settle(low: np.ndarray, high: np.ndarray, open_: np.ndarray) -> np.ndarray:
        needed = np.zeros_like(open_)
        for f, r in zip(floor.T[:, :, None], roof.T[:, :, None], strict=True):
            may = open_ & (high >= f) & (low <= r)
            sure = may & (low >= f) & (high <= r)
            needed |= may & (high >= _kth_highest(np.where(sure, low, -np.inf), k)[:, None])
        return needed

    return settle


def wide_from(dims: int) -> int:
    """Components from which a row is compared outside the planes: below it a sum of products stays under 2^53."""
    return 1 << ((52 - dims.bit_length()) // 2)


def _pairs(q: np.ndarray, c: np.ndarray, open_: np.ndarray, settle: Callable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, candidate, score) that `settle` leaves, rows with large components outside the planes."""
    wide_q, wide_c = (np.array((np.abs(x) >= wide_from(x.shape[1])).any(1), bool) for x in (q, c))
    found = []
    if not wide_q.all() and not wide_c.all():
        qs, cs = np.flatnonzero(~wide_q), np.flatnonzero(~wide_c)
        both = np.ix_(qs, cs)
        # the settling rules are by anchor, so rules of all anchors are cut to those here
        a, b, s = bit_sliced(q[qs].astype(np.int64), Planes(c[cs].astype(np.int64)), open_[both], lambda lo, hi, o: _cut(settle, lo, hi, o, qs, len(q)))
        found.append((qs[a], cs[b], s))
    for qs, cs in ((np.flatnonzero(wide_q), np.arange(len(c))), (np.flatnonzero(~wide_q), np.flatnonzero(wide_c))):
        if len(qs) and len(cs):
            scores = exact_products(q[qs], c[cs])
            a, b = np.nonzero(open_[np.ix_(qs, cs)])
            found.append((qs[a], cs[b], scores[a, b]))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _cut(settle: Callable, low: np.ndarray, high: np.ndarray, open_: np.ndarray, rows: np.ndarray, count: int) -> np.ndarray:
    if len(rows) == count:
        return settle(low, high, open_)
    fill = lambda x, value: _spread(x, rows, count, value)
    return settle(fill(low, -np.inf), fill(high, np.inf), fill(open_, False))[rows]


def _spread(x: np.ndarray, rows: np.ndarray, count: int, value) -> np.ndarray:
    out = np.full((count, x.shape[1]), value, x.dtype)
    out[rows] = x
    return out


def _batches(part: pd.DataFrame) -> Iterator[pd.DataFrame]:
    for at in range(0, len(part), BATCH):
        yield part.iloc[at : at + BATCH]


def _best(a: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of each a's k highest scores, ties to the smaller id."""
    order = np.lexsort((ids, ~scores, a))
    sorted_a = a[order]
    rank = np.arange(len(order)) - np.searchsorted(sorted_a, sorted_a)
    return order[rank < k]


def _vectors(part: pd.DataFrame) -> np.ndarray:
    return integers(np.stack(part["v"].to_numpy()))


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    label: Column | None = None,
    positives: int = 5,
    negatives: int = 10,
    least: int = 30,
    most: int = 90,
    ident: str = "vec_id",
    vector: str = "embedding",
    scale: int = 256,
) -> DataFrame:
    """For each anchor and each of its positives the negatives next below it: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become floor(scale * x), x as double; a score is the integer inner product with the
    anchor, higher first, ties by smaller id. Positives: the first `positives` other rows of the
    anchor's label; negatives: the first `negatives` rows of other labels whose score is from `least`
    to `most` hundredths of the positive's. Fewer where there are fewer; a positive without any has no row,
    and so none below zero has.

    Rows whose id, label or vector is null, or whose vector holds a null or non-finite component, take no part;
    nor do rows of another length than the anchor's. Rows alike in id, label and vector count once;
    unlike rows of one id are anchors, positives and negatives each, and a row is no other to itself alone.
    A score beyond 63 bits counts as the largest or smallest such number. An empty table gives none;
    no other column matters, whatever its name.

    Anchors and candidates are dealt into blocks by a digest of their id, not by label, and each pair
    of blocks is a task of bounded size, once for positives, once for negatives: the stated anchors meet
    all rows in blocks. A block keeps what its own rows can give, and results are merged by rank.
    """
    kind = F.col("label") if label is None else label
    v = integer_components(F.col(vector), scale)
    rows = vectors.select(F.col(ident).cast("long").alias("vec_id"), kind.cast("long").alias("label"), v.alias("v"), is_anchor.alias("asks")).where("vec_id is not null and label is not null and v is not null")
    scratch = Scratch(vectors.sparkSession, "negatives")
    rows = scratch.write(rows.dropDuplicates(["vec_id", "label", "v"]).withColumns({"d": F.size("v"), "row": F.xxhash64("vec_id", "label", "v")}))
    sizes = rows.agg(F.count("*").alias("n"), F.sum(F.col("asks").cast("long")).alias("q")).first()
    n_anchor, n_block = (max(1, -(-(x or 0) // size)) for x, size in ((sizes["q"], ANCHOR_BLOCK), (sizes["n"], CANDIDATE_BLOCK)))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    block = lambda seed, count: F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(count)).cast("int")
    keys = ["ab", "cb", "d"]
    there = rows.select("vec_id", "label", "v", "row", "d", block(2, n_block).alias("cb"), every(n_anchor).alias("ab"))

    def nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({c: np.zeros(0, np.int64) for c in ("row", "anchor_id", "anchor_label", "positive_row", "positive_id", "positive_score")})]
        if len(left) and len(right):
            c, ids = _vectors(right), right["vec_id"].to_numpy(np.int64)
            for part in _batches(left):
                open_ = (part["label"].to_numpy()[:, None] == right["label"].to_numpy()[None]) & (part["row"].to_numpy()[:, None] != right["row"].to_numpy()[None])
                a, b, s = _pairs(_vectors(part), c, open_, highest(positives))
                best = _best(a, ids[b], s, positives)
                of, to = part.iloc[a[best]], right.iloc[b[best]]
                out.append(pd.DataFrame({"row": of["row"].to_numpy(), "anchor_id": of["vec_id"].to_numpy(), "anchor_label": of["label"].to_numpy(), "positive_row": to["row"].to_numpy(), "positive_id": to["vec_id"].to_numpy(), "positive_score": s[best]}))
        return pd.concat(out)

    asked = rows.where("asks").select("vec_id", "label", "v", "row", "d", block(1, n_anchor).alias("ab"), every(n_block).alias("cb"))
    near = asked.groupBy(*keys).cogroup(there.groupBy(*keys)).applyInPandas(nearest, "row long, anchor_id long, anchor_label long, positive_row long, positive_id long, positive_score long")
    place = F.row_number().over(Window.partitionBy("row", "anchor_id", "anchor_label").orderBy(F.desc("positive_score"), "positive_id", "positive_row"))
    near = scratch.write(near.withColumn("place", place).where(F.col("place") <= positives))

    # at most `positives` windows an anchor
    windows = near.groupBy("row", F.col("anchor_id").alias("vec_id")).agg(F.sort_array(F.collect_list("positive_score"), asc=False).alias("scores"))
    asked = rows.where("asks").toDF(*rows.columns).join(windows, ["row", "vec_id"]).select("vec_id", "label", "v", "row", "d", "scores", block(1, n_anchor).alias("ab"), every(n_block).alias("cb"))

    def below(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({c: np.zeros(0, np.int64) for c in ("row", "anchor_id", "window", "negative_row", "negative_id", "negative_score")})]
        if len(left) and len(right):
            c, ids, rows_ = _vectors(right), right["vec_id"].to_numpy(np.int64), right["row"].to_numpy()
            for part in _batches(left):
                # Python's integers: a hundred times a score may pass 63 bits
                floors = [[-(-least * int(s) // 100) for s in scores] for scores in part["scores"]]
                roofs = [[most * int(s) // 100 for s in scores] for scores in part["scores"]]
                deep = max(map(len, floors))
                floor, roof = (np.array([[*map(float, x), *[np.nan] * (deep - len(x))] for x in given]) for given in (floors, roofs))
                # floats next to a bound that is past 53 bits may round into it: widen there
                floor, roof = (np.where(np.abs(x) < 2.0**53, x, np.nextafter(x, to)) for x, to in ((floor, -np.inf), (roof, np.inf)))
                open_ = part["label"].to_numpy()[:, None] != right["label"].to_numpy()[None]
                a, b, s = _pairs(_vectors(part), c, open_, within(floor, roof, negatives))
                own_rows, own_ids = part["row"].to_numpy(), part["vec_id"].to_numpy()
                for w in range(deep):
                    f, r = (np.array([x[w] if w < len(x) else empty for x in given], object) for given, empty in ((floors, 1), (roofs, 0)))
                    fits = np.flatnonzero(np.array((s >= f[a]) & (s <= r[a]), bool))
                    best = fits[_best(a[fits], ids[b[fits]], s[fits], negatives)]
                    out.append(pd.DataFrame({"row": own_rows[a[best]], "anchor_id": own_ids[a[best]], "window": w + 1, "negative_row": rows_[b[best]], "negative_id": ids[b[best]], "negative_score": s[best]}))
        return pd.concat(out)

    found = asked.groupBy(*keys).cogroup(there.groupBy(*keys)).applyInPandas(below, "row long, anchor_id long, window int, negative_row long, negative_id long, negative_score long")
    rank = F.row_number().over(Window.partitionBy("row", "anchor_id", "window").orderBy(F.desc("negative_score"), "negative_id", "negative_row"))
    merged = found.withColumn("rank", rank).where(F.col("rank") <= negatives)
    return near.withColumnRenamed("place", "window").join(merged, ["row", "anchor_id", "window"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
