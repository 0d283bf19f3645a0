"""Benchmark decontamination by spaced-seed hashing and substitution-tolerant verification."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, claim, fresh, map_texts, texts_of

#: Fixed masks: word positions with 1 make the hash, those with 0 may be substituted.
MASKS = ("1101011", "11001101", "101100011")
BITMAP_BITS = 20
MEMO_ENTRIES = 150_000
_WORD = re.compile(r"\w+")


class WordHashes(dict):
    """word -> 64 bits, worked out once per word."""

    def __missing__(self, word: str) -> int:
        code = xxhash.xxh64_intdigest(word)
        if len(self) >= MEMO_ENTRIES:
            self.clear()
        if len(word) <= 64:
            self[word] = code
        return code


_HASHES = WordHashes()


def word_hashes(text: str) -> np.ndarray:
    """Hashes of the lower-cased words (runs of letters, digits and underscores) of a whole text."""
    words = _WORD.findall(text.lower())
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def seed_hashes(words: np.ndarray, mask: str, salt: int) -> np.ndarray:
    """The mask's hash at each position where it fits."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, salt + 1, np.uint64)
    with np.errstate(over="ignore"):
        for j, bit in enumerate(mask):
            if bit == "1":
                out ^= words[j : j + n]
                out *= np.uint64(0x9E3779B97F4A7C15)
                out ^= out >> np.uint64(29)
    return out


def masks_for(words: int, window: int) -> list[tuple[int, str]]:
    """(salt, mask) for an item of so many words.

    Any two substitutions in 13 words leave one of MASKS whole somewhere. Items under the window may have
    a fifth of their words substituted, rounded down: one of up to nine words, two of up to twelve. A word
    stands in two places of `101` and in three of `1101`; five words hold three places of the first, seven
    words four of the second and ten words seven, so that one is always left whole.
    """
    if words >= window:
        return [(salt, mask) for salt, mask in enumerate(MASKS) if len(mask) <= words]
    return [(100, "101")] if words < 7 else [(101, "1101")]


@dataclass
class SeedIndex:
    """The seeds of a block of test items, sorted by hash, under a bitmap of their leading bits."""

    items: list[np.ndarray]
    hashes: np.ndarray
    item: np.ndarray
    offset: np.ndarray
    bitmap: np.ndarray
    window: int
    share: float
    masks: list[tuple[int, str]]

    @classmethod
    def build(cls, texts: list[str], window: int, share: float, least: int) -> SeedIndex:
        items = [word_hashes(t) for t in texts]
        found = []
        for i, words in enumerate(items):
            if len(words) < least:
                continue
            for salt, mask in masks_for(len(words), window):
                h = seed_hashes(words, mask, salt)
                found.append((h, np.full(len(h), i), np.arange(len(h))))
        cat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)]
        order = np.argsort(cat[0], kind="stable")
        hashes = cat[0][order].astype(np.uint64)
        bitmap = np.zeros(1 << BITMAP_BITS, bool)
        bitmap[hashes >> np.uint64(64 - BITMAP_BITS)] = True
        masks = sorted({m for words in items if len(words) >= least for m in masks_for(len(words), window)})
        return cls(items, hashes, cat[1][order], cat[2][order], bitmap, window, share, masks)

    def hits(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, item, offset) of equal seeds."""
        out = []
        for salt, mask in self.masks:
            h = seed_hashes(words, mask, salt)
            at = np.flatnonzero(self.bitmap[h >> np.uint64(64 - BITMAP_BITS)])
            if len(at):
                low, high = (np.searchsorted(self.hashes, h[at], side) for side in ("left", "right"))
                n = high - low
                which = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                out.append((np.repeat(at, n), self.item[which], self.offset[which]))
        if not out:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def verify(self, words: np.ndarray, item: int, start: int) -> tuple[int, float, int, int] | None:
        """The alignment of an item at `start` in a document's words, if a window of it overlaps enough."""
        test = self.items[item]
        low, high = max(0, start), min(len(words), start + len(test))
        width = min(self.window, len(test))
        if high - low < width:
            return None
        same = words[low:high] == test[low - start : high - start]
        total = np.concatenate([[0], np.cumsum(same)])
        good = total[width:] - total[:-width] >= np.ceil(width * self.share - 1e-9)
        if not good.any():
            return None
        places = np.flatnonzero(good)
        a, b = int(places[0]), int(places[-1]) + width
        n = int(total[b] - total[a])
        return n, n / (b - a), low + a, low + b

    def search(self, words: np.ndarray, ends: np.ndarray) -> list[list[dict]]:
        """Overlaps of each document; `ends` are where documents end in the joined words."""
        out: list[list[dict]] = [[] for _ in ends]
        at, item, offset = self.hits(words)
        if not len(at):
            return out
        doc = np.searchsorted(ends, at, side="right")
        seen = np.unique(np.stack([doc, item, at - offset]), axis=1)
        best: dict[tuple[int, int], tuple[int, float, int, int]] = {}
        for d, i, start in seen.T.tolist():
            base = int(ends[d - 1]) if d else 0
            got = self.verify(words[base : ends[d]], i, start - base)
            if got and ((d, i) not in best or (got[0], -got[2]) > (best[d, i][0], -best[d, i][2])):
                best[d, i] = got
        for (d, i), (n, share, a, b) in sorted(best.items()):
            out[d].append({"item": i, "words": n, "similarity": share, "start": a, "end": b})
        return out


def find_overlaps(df: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", out: str = "overlaps", window: int = 13, share: float = 0.8, least: int = 5, block_words: int = 2_000_000) -> DataFrame:
    """Append the overlaps of each whole text with the test items, one for each item that is found.

    An overlap is an alignment without gaps in which some window of `window` words (the whole item,
    if shorter) agrees in at least `share` of them: item_id, words that agree, similarity, and the
    first and one past the last word of the overlap in the text. Items of fewer than `least` words
    (null and empty ones too) are not looked for; null and empty texts have no overlaps; repeated
    items each count; a column named `out` is replaced.

    The test items are broadcast in blocks of at most `block_words` words, each a map over the texts;
    nothing is shuffled, however many texts share a passage. With several blocks the texts are written to the
    shared folder after each, and its broadcast is dropped: one block is held at a time.
    """
    sized = F.size(F.split(F.coalesce(F.col(item_text), F.lit("")), r"\W+"))
    tests = benchmark.select(F.col(item).cast("long").alias("id"), F.coalesce(F.col(item_text), F.lit("")).alias("text"), sized.alias("n"))
    blocks = max(1, -(-(tests.agg(F.sum("n")).first()[0] or 0) // block_words))
    base = df.drop(out)
    schema = T.ArrayType(T.StructType([T.StructField(n, k) for n, k in (("item_id", T.LongType()), ("words", T.IntegerType()), ("similarity", T.DoubleType()), ("start", T.IntegerType()), ("end", T.IntegerType()))]))
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("words", pa.int32()), ("similarity", pa.float64()), ("start", pa.int32()), ("end", pa.int32())]))
    done, parts, last = base, [], None
    scratch = Scratch(df.sparkSession, "overlaps")
    for k in range(blocks):
        mine = tests if blocks == 1 else tests.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k)
        rows = sorted((r["id"] if r["id"] is not None else -1, r["text"], r["id"]) for r in mine.collect())
        index = SeedIndex.build([r[1] for r in rows], window, share, least)
        shared = df.sparkSession.sparkContext.broadcast((index, [r[2] for r in rows]))

        def make(shared=shared):
            claim("words", _HASHES.clear)

            def run(part: pa.RecordBatch) -> list[pa.Array]:
                seeds, ids = shared.value
                words = [word_hashes(t) for t in texts_of(part, text)]
                found = seeds.search(np.concatenate(words) if words else np.zeros(0, np.uint64), np.cumsum([len(w) for w in words]))
                return [pa.array([[{"item_id": ids[x.pop("item")], **x} for x in one] for one in found], kind)]

            return run

        parts.append(out if blocks == 1 else fresh(base, f"_overlaps_{k}"))
        done = map_texts(done, text, [T.StructField(parts[-1], schema)], make)
        if blocks > 1:
            done = scratch.write(done)
            shared.unpersist()
            if k:
                scratch.drop(last)
            last = done
    if blocks == 1:
        return done
    return done.withColumn(out, F.concat(*parts)).drop(*parts)


def decontaminate(df: DataFrame, benchmark: DataFrame, text: str = "text", **how) -> DataFrame:
    """The rows without an overlap, with the columns of `df`."""
    found = fresh(df, "_overlaps")
    return find_overlaps(df, benchmark, text, out=found, **how).where(F.size(found) == 0).drop(found)
