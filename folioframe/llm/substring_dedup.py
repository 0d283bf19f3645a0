"""Suffix-array dedup: prefix doubling over sorted position-rank pairs, thinned to synchronised positions.

A string of `length` bytes that occurs twice is found in three steps.

1. Thinning. Of the SEED-byte strings inside each `length`-byte window, the one with the least hash is
   the window's anchor, so equal windows have equal anchors at equal places. Windows whose anchor's
   SEED bytes stand nowhere else are unique and leave; where all anchors of a kind agree in every byte
   of their windows, all those windows repeat and leave too. One of each other kind goes on.
2. Doubling. What goes on is parsed at denser anchors, about one in 24 bytes. A position's first rank
   is that of the phrase up to the next position. Round by round Spark joins each position's rank to
   that of the position 1, 2, 4, ... places on, sorts the pairs and ranks them anew by their least
   position; a pair that stands once is unique and its position leaves. The rounds end when no run of
   positions inside a window is that long. From here on no rank comes from bytes: the string that STRETCH
   neighbouring windows share is the pair of ranks that cover it from both ends.
3. Ends. Where strings of equal rank lie in unequal windows, an exact check of the few bytes beside them
   tells which windows repeat, for four and then for single windows.

Within a text of period q, a window and the one q bytes before it are equal without any rank: all but
the first q windows leave at the start, so a long run of one letter costs no more than other text.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, claim, fresh, map_texts, slices, texts_of

#: Bytes that the thinning ranks, and the bytes whose hash picks an anchor of either kind.
SEED, GRAM = 32, 8
#: Starts among which the denser anchors of the doubling are picked.
SPAN = 48
#: Windows that share a ranked string, then those of the exact check; each divides the one before it.
STRETCH, ENDS = 24, (4, 1)
#: Windows for which anchors are looked up at once; positions take the low bits beside a hash.
CHUNK, POSITION_BITS = 1 << 20, 24
#: The longest period that is looked for, and the equal gaps between anchors that tell of one.
MOST_PERIOD, EQUAL_GAPS = 64, 8
#: Documents (12-byte keys) up to which the ones a round looks at are broadcast to the scan.
BROADCAST_ROWS = 500_000
#: Rows of an Arrow batch that leaves a worker, and places left free between two parses.
FLUSH, APART = 100_000, 1 << 10
NODE = "id long, h int, a int, c int, lo int, hi int, k long, u long, w long"
PART = NODE + ", x long, y long, level int, p long, q long"
COLUMNS = {"id": np.int64, "h": np.int32, "a": np.int32, "c": np.int32, "lo": np.int32, "hi": np.int32, "k": np.uint64, "u": np.uint64, "w": np.int64, "x": np.uint64, "y": np.uint64, "level": np.int32, "p": np.int64, "q": np.int64}


def _hashes(data: bytes, start: int, count: int) -> np.ndarray:
    """64-bit hashes of `count` GRAM-byte strings from `start`, the place among them in the low bits:
    of equal hashes the leftmost is the least."""
    x = np.frombuffer(data, np.uint8, count + GRAM - 1, start)
    h = np.lib.stride_tricks.sliding_window_view(x, GRAM).copy().view(np.uint64).ravel()
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h >> np.uint64(POSITION_BITS) << np.uint64(POSITION_BITS) | np.arange(count, dtype=np.uint64)


def _least(h: np.ndarray, span: int) -> np.ndarray:
    """The place of the least hash among each `span` neighbours."""
    n = len(h) - span + 1
    padded = np.full(-(-len(h) // span) * span, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(h)] = h
    rows = padded.reshape(-1, span)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(back[:n], ahead[span - 1 : span - 1 + n]) & np.uint64((1 << POSITION_BITS) - 1)).astype(np.int32)


def _again(data: bytes, length: int, at: int, n: int, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """(equal to the window some period before it, or after it) for n windows from `at`; None without a period."""
    gaps = np.diff(anchor[np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))])
    if len(gaps) < EQUAL_GAPS:
        return None
    ends = np.append(np.flatnonzero(gaps[1:] != gaps[:-1]), len(gaps) - 1)
    runs = np.diff(np.append(-1, ends))
    periods = np.unique(gaps[ends[(runs >= EQUAL_GAPS) & (gaps[ends] <= MOST_PERIOD)]])
    if not len(periods):
        return None
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    for q in periods.tolist():
        start, stop = max(0, at - q), min(len(data), at + n - 1 + length + q)
        if stop - start < length + q:
            continue
        x = np.frombuffer(data, np.uint8, stop - start, start)
        unlike = np.append(np.int32(0), np.cumsum(x[q:] != x[:-q], dtype=np.int32))
        same = unlike[length:] == unlike[: len(unlike) - length]  # by start: a window equals the one q after it
        later = np.arange(at, at + n)
        fits = later - start < len(same)
        after[fits] |= same[later[fits] - start]
        earlier = later - q - start
        fits = (earlier >= 0) & (earlier < len(same))
        before[fits] |= same[earlier[fits]]
    return before, after


def _runs(marks: np.ndarray, *apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of the runs of marked places, cut where a value of `apart` changes."""
    if not len(marks):
        return (np.zeros(0, np.int64),) * 2
    new = np.append(True, ~marks[:-1])
    for values in apart:
        new[1:] |= values[1:] != values[:-1]
    first = np.flatnonzero(marks & new)
    last = np.flatnonzero(marks & np.append(new[1:] | ~marks[1:], True))
    return first, last


def anchors_of(data: bytes, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Chunk by chunk, (anchor, first window, last window) and (first, last) of the windows that a period repeats.

    Every window belongs to one anchor, but for those that equal the window a period before them.
    """
    windows = len(data) - length + 1
    span = length - SEED + 1
    for at in range(0, windows, CHUNK):
        n = min(CHUNK, windows - at)
        anchor = _least(_hashes(data, at, n + span - 1), span)
        known = _again(data, length, at, n, anchor)
        if known is None:
            first, last = _runs(np.ones(n, bool), anchor)
            yield anchor[first] + at, first + at, last + at, first[:0], first[:0]
        else:
            before, after = known
            first, last = _runs(~before, anchor)
            again = _runs(before | after)
            yield anchor[first] + at, first + at, last + at, again[0] + at, again[1] + at


class _Rows:
    """Columns of rows, gathered as arrays and handed on in Arrow batches of bounded size."""

    def __init__(self, names: list[str]):
        self.names, self.parts, self.count = names, [], 0

    def add(self, n: int, **values) -> None:
        """`n` rows; a column that is not named is 0, a single value stands for all rows."""
        if n:
            self.parts.append((n, values))
            self.count += n

    def take(self) -> pa.RecordBatch:
        arrays = []
        for name in self.names:
            kind = COLUMNS[name]
            # names of strings are 64 bits whose sign does not matter
            whole = np.concatenate([np.asarray(v[name], kind) if np.ndim(v.get(name, 0)) else np.full(n, v.get(name, 0), kind) for n, v in self.parts])
            arrays.append(pa.array(whole.view(np.int64) if kind is np.uint64 else whole))
        self.parts, self.count = [], 0
        return pa.RecordBatch.from_arrays(arrays, names=self.names)


def _emit(df: DataFrame, schema: str, extra: list[str], add_rows) -> DataFrame:
    """Rows made from each document; `add_rows(rows, key, data, state, extras)` gathers them."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("repeats", lambda: None)
        rows, state = _Rows(names), {"next": TaskContext.get().partitionId() << 38}
        for batch in batches:
            for part in slices(batch, "text"):
                ids, hashes = part.column("id").to_pylist(), part.column("h").to_pylist()
                extras = [part.column(c) for c in extra]
                for row, text in enumerate(texts_of(part, "text")):
                    add_rows(rows, {"id": ids[row], "h": hashes[row]}, text.encode(), state, *(e[row].values for e in extras))
                    if rows.count >= FLUSH:
                        yield rows.take()
        if rows.count:
            yield rows.take()

    return df.select("id", "h", "text", *extra).mapInArrow(run, schema)


def _names(data: bytes, starts, stops) -> list[int]:
    digest = xxhash.xxh64_intdigest
    return [digest(data[s:e]) for s, e in zip(starts.tolist(), stops.tolist(), strict=True)]


def _thinned(length: int):
    """Rows of the thinning; those of weight 0 are windows that a period repeats."""

    def add(rows, key, data, state):
        digest = xxhash.xxh64_intdigest
        for a, lo, hi, first, last in anchors_of(data, length):
            whole = [digest(data[s : e + length], p - s) for p, s, e in zip(a.tolist(), lo.tolist(), hi.tolist(), strict=True)]
            rows.add(len(a), **key, a=a, lo=lo, hi=hi, k=_names(data, a, a + SEED), u=whole, w=1)
            rows.add(len(first), **key, a=first, lo=first, hi=last)

    return add


def _wanted(given: pa.Array) -> dict[str, np.ndarray]:
    """A document's rows by column, in the order of its windows."""
    found = {name: given.field(name).to_numpy(zero_copy_only=False) for name in ("a", "c", "lo", "hi", "k", "w")}
    order = np.lexsort((found["c"], found["lo"]))
    return {name: values[order] for name, values in found.items()}


def _cells(want: dict[str, np.ndarray], reach: int, before: int, size: int) -> dict[str, np.ndarray]:
    """The stretches of `size` windows within rows of `before`: their row, place c, first and last window."""
    c = want["c"][:, None] + np.arange(0, before, size)[None, :]
    s1 = want["a"][:, None] - reach + c
    stop = np.minimum(want["c"] + before, reach + 1)[:, None]
    s2 = want["a"][:, None] - reach + np.minimum(c + size, stop) - 1
    there = (c < stop) & (s2 >= want["lo"][:, None]) & (s1 <= want["hi"][:, None])
    row, _ = np.nonzero(there)
    return {"row": row, "c": c[there], "s1": s1[there], "s2": s2[there]}


def _whole(data: bytes, s1, s2, length: int) -> list[int]:
    """Names of all bytes of stretches; what the text's ends cut off counts."""
    digest, n = xxhash.xxh64_intdigest, len(data)
    return [digest(data[max(0, a) : b + length], max(0, -a) << 32 | max(0, b + length - n)) for a, b in zip(s1.tolist(), s2.tolist(), strict=True)]


def _parsed(length: int):
    """Positions with their first rank pair (level -1), and stretches with the two positions that cover them.

    A stretch's shared bytes run from window s2 to the end of window s1. Between the first and the last
    dense anchor in them they are t phrases: the positions p and q begin the two runs of 2^level phrases that cover these;
    k names the bytes outside, and their place.
    """
    reach = length - SEED

    def add(rows, key, data, state, given):
        want = _wanted(given)
        cells = _cells(want, reach, reach + 1, STRETCH)
        if not len(cells["row"]):
            return
        digest = xxhash.xxh64_intdigest
        s1, s2 = cells["s1"], cells["s2"]
        by = np.argsort(s2, kind="stable")
        # stretches that overlap are parsed together; one apart by more than a span is parsed alone
        new = np.append(True, s2[by][1:] > np.maximum.accumulate(s1[by] + length)[:-1] + 4 * SPAN)
        for group in np.split(by, np.flatnonzero(new)[1:]):
            start, stop = int(s2[group].min()), int((s1[group] + length).max())
            for near in _pieces(group, s1, s2, start, stop, length):
                start, stop = int(s2[near].min()), int((s1[near] + length).max())
                least = _least(_hashes(data, start, stop - start - GRAM + 1), SPAN)
                step = np.append(True, least[1:] != least[:-1])
                anchor, index = least[step].astype(np.int64) + start, np.cumsum(step, dtype=np.int64) - 1
                j, m = index[s2[near] - start], index[s1[near] + length - GRAM - SPAN + 1 - start]
                used = np.zeros(len(anchor) + 1, np.int32)
                np.add.at(used, j, 1)
                np.add.at(used, m, -1)
                place = np.flatnonzero(np.cumsum(used)[:-1] > 0)
                phrase = _names(data, anchor[place], anchor[place + 1] + GRAM)
                x = np.zeros(len(anchor) + 1, np.uint64)
                x[place] = phrase
                base = state["next"]
                state["next"] += len(anchor) + APART
                rows.add(len(place), p=base + place, x=x[place], y=x[place + 1], level=-1)
                t = m - j
                level = np.frexp(t.astype(np.float64))[1] - 1
                left, right = anchor[j], anchor[m] + GRAM
                ends = [
                    digest(data[e:f], digest(data[s:l], c))
                    for s, l, e, f, c in zip(s2[near].tolist(), left.tolist(), right.tolist(), (s1[near] + length).tolist(), cells["c"][near].tolist(), strict=True)
                ]
                own = cells["row"][near]
                rows.add(len(near), **key, a=want["a"][own], c=cells["c"][near], lo=want["lo"][own], hi=want["hi"][own], k=ends, u=_whole(data, s1[near], s2[near], length), w=want["w"][own], x=t, level=level, p=base + j, q=base + m - (1 << level))

    return add


def _pieces(group, s1, s2, start: int, stop: int, length: int) -> list[np.ndarray]:
    """A group of stretches, cut so that no more than about CHUNK bytes are parsed at once."""
    if stop - start <= CHUNK:
        return [group]
    return [x for x in np.split(group, np.searchsorted(s2[group], np.arange(start + CHUNK // 2, stop, CHUNK // 2))) if len(x)]


def _ended(length: int, before: int, size: int):
    """Finer stretches; k names the rank of the wider stretch and the bytes that are shared beyond it."""
    reach = length - SEED

    def add(rows, key, data, state, given):
        want = _wanted(given)
        cells = _cells(want, reach, before, size)
        own, s1, s2 = cells["row"], cells["s1"], cells["s2"]
        if not len(own):
            return
        digest = xxhash.xxh64_intdigest
        first = want["a"][own] - reach + want["c"][own]
        last = want["a"][own] - reach + np.minimum(want["c"][own] + before, reach + 1) - 1
        names = [
            digest(data[s:e] + data[f:l] + struct.pack("<qi", k, c))
            for s, e, f, l, k, c in zip(s2.tolist(), last.tolist(), (first + length).tolist(), (s1 + length).tolist(), want["k"][own].tolist(), cells["c"].tolist(), strict=True)
        ]
        rows.add(len(own), **key, a=want["a"][own], c=cells["c"], lo=want["lo"][own], hi=want["hi"][own], k=names, u=_whole(data, s1, s2, length), w=want["w"][own])

    return add


def _ranked(pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """(p, rank) of the positions whose pair (x, y) stands twice: Spark sorts the pairs, and the rank of a pair is its least position."""
    # written first: a join right above the aggregate could not be split where a pair is frequent
    ranks = scratch.write(pairs.groupBy("x", "y").agg(F.min("p").alias("rank"), F.count("*").alias("n")).where("n > 1").drop("n"))
    out = scratch.write(pairs.join(ranks, ["x", "y"]).select("p", "rank"))
    scratch.drop(ranks)
    return out


def _doubled(parts: DataFrame, scratch: Scratch) -> DataFrame:
    """The stretches whose two covering runs stand twice, with k as the rank of what a stretch's windows share."""
    stretches = parts.where("level >= 0")
    top = stretches.agg(F.max("level")).first()[0]
    levels = []
    now = _ranked(parts.where("level < 0 and y <> 0").select("p", "x", "y"), scratch)
    for level in range(1, (top or 0) + 1):
        levels.append(now.withColumn("level", F.lit(level)))
        if level < top:
            ahead = now.select((F.col("p") - (1 << level)).alias("p"), F.col("rank").alias("y"))
            pairs = scratch.write(now.withColumnRenamed("rank", "x").join(ahead, "p"))
            now = _ranked(pairs, scratch)
            scratch.drop(pairs)
    ranks = now.withColumn("level", F.lit(0)) if not levels else levels[0]
    for more in levels[1:]:
        ranks = ranks.unionByName(more)
    both = stretches.join(ranks.withColumnRenamed("rank", "r1"), ["level", "p"]).join(ranks.select("level", F.col("p").alias("q"), F.col("rank").alias("r2")), ["level", "q"])
    return scratch.write(both.select("id", "h", "a", "c", "lo", "hi", F.xxhash64("level", "x", "r1", "r2", "k").alias("k"), "u", "w"))


def _told(nodes: DataFrame, scratch: Scratch, length: int, size: int, last: bool) -> tuple[DataFrame, DataFrame | None]:
    """Part the rows of equal rank: (spans of repeated windows, what must be looked at more finely).

    Frequent ranks are summed before they are shuffled, and the sums come back by joins whose large
    partitions Spark can split, so a rank may hold any share of the rows.
    """
    sums = nodes.groupBy("k").agg(F.sum("w").alias("n"), F.min("u").alias("u1"), F.max("u").alias("u2")).where("n > 1")
    # written first: a join right above the aggregate could not be split
    ranks = scratch.write(sums.select("k", (F.col("u1") == F.col("u2")).alias("same")))
    shared = scratch.write(nodes.join(ranks, "k"))
    low = F.greatest("lo", F.col("a") - (length - SEED) + F.col("c"))
    high = F.least("hi", F.col("a") - (length - SEED) + F.col("c") + size - 1)
    span = ("id", "h", low.alias("start"), (high + length).alias("end"))
    if last:
        return scratch.write(shared.select(*span)), None
    place = F.struct("id", "h", "a", "c", "lo")
    mixed = shared.where("not same")
    kinds = scratch.write(mixed.groupBy("k", "u").agg(F.sum("w").alias("n"), F.min(place).alias("one")))
    sorted_out = scratch.write(mixed.join(kinds, ["k", "u"]).select("id", "h", "a", "c", "lo", "hi", "k", "n", (place == F.col("one")).alias("speaks")))
    spans = scratch.write(shared.where("same").select(*span).unionByName(sorted_out.where("n > 1").select(*span)))
    scratch.drop(shared, ranks, kinds)
    # one speaker a string: of rows repeated whole, each would speak
    return spans, sorted_out.where("speaks").drop("speaks").dropDuplicates().withColumnRenamed("n", "w")


def mark_repeats(df: DataFrame, text: str = "text", ident: str = "doc_id", length: int = 200, out: str = "repeats") -> DataFrame:
    """Append the byte spans [start, end) of a text covered by `length`-byte strings that start twice.

    The text is its UTF-8 bytes, null counts as empty; strings do not cross rows; both occurrences
    may lie in one row and may overlap; every occurrence is marked, the first one too. Texts under
    `length` bytes have no span. Repeated rows mark each other; rows are told apart by id and 32 bits of
    their text, those without an id by 96 bits of it. A column named `out` is replaced, others are kept; an empty table
    gives an empty result. `length` is 180 at least, so that what a stretch shares always holds two phrases.
    """
    if length < 180:
        raise ValueError("length must be 180 at least")
    spark = df.sparkSession
    scratch = Scratch(spark, "repeats")
    key = {"id": F.coalesce(F.col(ident).cast("long"), F.xxhash64(text)), "h": F.hash(text)}
    docs = df.select(key["id"].alias("id"), key["h"].alias("h"), F.col(text).alias("text"))
    long_ones = docs.where(F.octet_length("text") >= length)

    def again(left: DataFrame, schema: str, add_rows) -> DataFrame:
        wanted = left.groupBy("id", "h").agg(F.collect_list(F.struct("a", "c", "lo", "hi", "k", "w")).alias("wanted"))
        few = left.select("id", "h").distinct()
        there = long_ones.join(F.broadcast(few), ["id", "h"], "left_semi") if few.count() <= BROADCAST_ROWS else long_ones
        return scratch.write(_emit(there.join(wanted, ["id", "h"]), schema, ["wanted"], add_rows))

    nodes = scratch.write(_emit(long_ones, NODE, [], _thinned(length)))
    spans = [nodes.where("w = 0").select("id", "h", F.col("lo").alias("start"), (F.col("hi") + length).alias("end"))]
    found, left = _told(nodes.where("w > 0"), scratch, length, length - SEED + 1, last=False)
    spans.append(found)
    parts = again(left, PART, _parsed(length))
    ranked = _doubled(parts, scratch)
    scratch.drop(parts)
    before = STRETCH
    found, left = _told(ranked, scratch, length, before, last=False)
    spans.append(found)
    scratch.drop(ranked)
    for size in ENDS:
        nodes = again(left, NODE, _ended(length, before, size))
        found, left = _told(nodes, scratch, length, size, last=size == 1)
        scratch.drop(nodes)
        spans.append(found)
        before = size
    every = spans[0]
    for more in spans[1:]:
        every = every.unionByName(more)
    one, two, found = (fresh(df, name) for name in ("_id", "_h", "_spans"))
    by_row = every.groupBy("id", "h").agg(F.collect_set(F.struct("start", "end")).alias(found))
    kept = [c for c in df.columns if c != out]
    marked = df.select(*kept, key["id"].alias(one), key["h"].alias(two)).join(by_row.withColumnsRenamed({"id": one, "h": two}), [one, two], "left")
    return marked.select(*kept, F.coalesce(found, F.array().cast("array<struct<start:int,end:int>>")).alias(out))


def joined_spans(spans: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs covered by the spans."""
    out: list[tuple[int, int]] = []
    for start, end in sorted((s["start"], s["end"]) for s in spans):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], end)
        else:
            out.append((start, end))
    return out


def remove_repeats(df: DataFrame, text: str = "text", ident: str = "doc_id", length: int = 200) -> DataFrame:
    """Append what `mark_repeats` leaves: n_bytes, n_removed, n_spans, kept_sha256, kept
    (bytes) and kept_text (of the bytes, without characters that were cut into)."""
    spans_of = fresh(df, "_repeats")
    marked = mark_repeats(df, text, ident, length, out=spans_of)

    def make():
        def run(part: pa.RecordBatch) -> list[pa.Array]:
            n, removed, runs, digests, kept, left = [], [], [], [], [], []
            for value, spans in zip(texts_of(part, text), part.column(spans_of).to_pylist(), strict=True):
                data, whole = value.encode(), joined_spans(spans)
                parts = [data[a:b] for a, b in zip([0, *(e for _, e in whole)], [*(s for s, _ in whole), len(data)], strict=True)]
                rest = b"".join(parts)
                n.append(len(data))
                removed.append(len(data) - len(rest))
                runs.append(len(whole))
                digests.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest)
                left.append("".join(x.decode("utf-8", "ignore") for x in parts))
            return [pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digests), pa.array(kept, pa.binary()), pa.array(left, pa.string())]

        return run

    fields = [T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")] + [T.StructField("kept_sha256", T.StringType()), T.StructField("kept", T.BinaryType()), T.StructField("kept_text", T.StringType())]
    return map_texts(marked, text, fields, make).drop(spans_of)
