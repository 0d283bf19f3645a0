"""Byte-level BPE: merges picked from a queue of rank buckets under a hierarchical bitmap."""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Mapping
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import claim, map_texts, texts_of

#: Ranks under one word of the lower bitmap.
WORD_BITS = 8
WORD_MASK = (1 << WORD_BITS) - 1
#: Single bits of both levels: vocabularies of up to a million ranks.
BIT = [1 << i for i in range(1 << 12)]
SIGNS = ".,;:!?|"
#: Stretches and pre-tokens a worker remembers with their ids, in each of two generations; longer ones are not kept.
MEMO_ENTRIES, PIECE_ENTRIES, MEMO_CHARS = 250_000, 100_000, 64


def load_ranks(path: str, max_entries: int = 1_000_000) -> dict[bytes, int]:
    """Read a rank file (base64 token, space, rank per line), at most `max_entries` of them."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    if len(ranks) > max_entries:
        raise ValueError(f"{len(ranks)} ranks; the broadcast vocabulary is bounded to {max_entries}")
    return ranks


class Merger:
    """Merges within one pre-token, over a vocabulary's table of mergeable id pairs."""

    def __init__(self, ranks: Mapping[bytes, int]):
        self.ranks = ranks
        self.shift = shift = max(ranks.values(), default=0).bit_length()
        self.pairs = {ranks[t[:i]] << shift | ranks[t[i:]]: rank for t, rank in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        self.single = single = [ranks[bytes([i])] for i in range(256)]
        self.first = [[self.pairs.get(a << shift | b) for b in single] for a in single]  # of two bytes, with which every piece begins
        self.blank = [0] * ((max(ranks.values(), default=0) >> WORD_BITS) + 1)

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one pre-token: the lowest-ranked pair merges first, the leftmost of equals.

        Positions stand in a bucket per merge rank, and two bitmap levels say which buckets hold
        any: the lowest set bit of the upper word names a lower word, whose lowest set bit names the
        rank. Entries stay when their pair changes and are skipped as stale when they come up.
        """
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        n, shift, find = len(piece), self.shift, self.pairs.get
        single = self.single
        token = list(map(single.__getitem__, piece))
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair = [-1] * n  # the rank a position's pair has now; -1: none, or the position is merged away
        buckets: dict[int, list[int]] = {}
        lower = self.blank[:]
        upper = 0
        i, first = 0, self.first
        follows = first[piece[0]]
        for right in piece[1:]:
            rank = follows[right]
            if rank is not None:
                pair[i] = rank
                if rank in buckets:
                    buckets[rank].append(i)
                else:
                    buckets[rank] = [i]
                    word = rank >> WORD_BITS
                    lower[word] |= BIT[rank & WORD_MASK]
                    upper |= BIT[word]
            i += 1
            follows = first[right]
        while upper:
            word = (upper & -upper).bit_length() - 1
            bits = lower[word]
            rank = word << WORD_BITS | (bits & -bits).bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                i = heappop(bucket)
            else:
                i = bucket.pop()
                lower[word] = bits = bits & bits - 1
                if not bits:
                    upper &= upper - 1
            if pair[i] != rank:
                continue  # stale
            gone = after[i]
            end = after[gone]
            pair[gone] = pair[i] = -1
            after[i] = end
            token[i] = rank
            if end < n:
                before[end] = i
                made = find(rank << shift | token[end])
                if made is not None:
                    pair[i] = made
                    bucket = buckets.get(made)
                    if bucket:
                        heappush(bucket, i)
                    else:
                        buckets[made] = [i]
                        word = made >> WORD_BITS
                        lower[word] |= BIT[made & WORD_MASK]
                        upper |= BIT[word]
            i = before[i]
            if i >= 0:
                made = find(token[i] << shift | rank)
                if made is None:
                    pair[i] = -1
                else:
                    pair[i] = made
                    bucket = buckets.get(made)
                    if bucket:
                        heappush(bucket, i)
                    else:
                        buckets[made] = [i]
                        word = made >> WORD_BITS
                        lower[word] |= BIT[made & WORD_MASK]
                        upper |= BIT[word]
        ids, i = [], 0
        while i < n:
            ids.append(token[i])
            i = after[i]
        return tuple(ids)


class Memo:
    """The ids of what was met lately: a full generation becomes the old one, and what is asked for again is kept."""

    __slots__ = ("most", "old", "young")

    def __init__(self, most: int):
        self.most = most
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def keep(self, text: str, ids: bytes) -> None:
        if len(text) <= MEMO_CHARS:
            if len(self.young) >= self.most:
                self.old, self.young = self.young, {}
            self.young[text] = ids


class Encoder:
    """Splits a text by the pattern and merges each match; common stretches are remembered.

    `words`: the pattern always starts a match at a space that follows a non-space, a match takes a
    single space before a non-space along, a run of letters is one match, and so is a run of SIGNS
    between it and a space. Then a stretch between such spaces splits alike wherever it stands, and
    its ids are kept whole.
    """

    def __init__(self, ranks: Mapping[bytes, int], pattern: str, words: bool = False):
        self.merger = Merger(ranks)
        self.split = regex.compile(pattern).findall
        self.words = words
        self.pieces, self.stretches = Memo(PIECE_ENTRIES), Memo(MEMO_ENTRIES)

    def _piece(self, piece: str) -> bytes:
        memo = self.pieces
        ids = memo.young.get(piece)
        if ids is None:
            ids = memo.old.get(piece) or array("i", self.merger.merge(piece.encode())).tobytes()
            memo.keep(piece, ids)
        return ids

    def encode(self, text: str) -> bytearray:
        """The ids as 32-bit integers in the machine's byte order."""
        out, split, piece = bytearray(), self.split, self._piece
        if not self.words:
            for match in split(text):
                out += piece(match)
            return out
        memo = self.stretches
        known = memo.young
        waiting, *rest = text.split(" ")  # waiting: what has not come to a place where it may be cut
        for part in rest:
            if waiting is None:
                ids = known.get(part)
                if ids is not None:
                    out += ids
                    continue
                ids = memo.old.get(part)
                if ids is not None:
                    out += ids
                    memo.keep(part, ids)
                    known = memo.young
                    continue
            closed = bool(part) and not part[0].isspace()
            if waiting is not None:
                if not closed or not waiting or waiting[-1].isspace():
                    waiting += " " + part
                    continue
                out += b"".join(map(piece, split(waiting)))
                waiting = None
            if closed and not part[-1].isspace():
                core = part.rstrip(SIGNS)
                if core.isalpha():
                    ids = piece(" " + core) + piece(part[len(core) :]) if len(core) < len(part) else piece(" " + part)
                else:
                    ids = b"".join(map(piece, split(" " + part)))
                out += ids
                memo.keep(part, ids)
                known = memo.young
            else:
                waiting = " " + part
        if waiting:
            out += b"".join(map(piece, split(waiting)))
        return out


#: A Python worker's coders by vocabulary, so that its later tasks find the memos filled.
_CODERS: dict[str, tuple] = {}


class Decoder:
    """The bytes that ids stand for, by gathers from one array of all tokens' bytes."""

    #: Ids that are decoded at once.
    STEP = 200_000

    def __init__(self, ranks: Mapping[bytes, int]):
        top = max(ranks.values(), default=-1) + 1
        token = [b""] * top
        for t, i in ranks.items():
            token[i] = t
        self.known = np.zeros(top, bool)
        self.known[list(ranks.values())] = True
        self.size = np.array([len(t) for t in token], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.letters = np.frombuffer(b"".join(token), np.uint8)

    def _some(self, ids: np.ndarray) -> bytes:
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.known) or not self.known[ids].all()):
            raise ValueError("an id that the vocabulary does not have")
        n = self.size[ids]
        ends = np.cumsum(n)
        return self.letters[np.repeat(self.first[ids] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)].tobytes()

    def decode(self, flat: np.ndarray, counts: list[int]) -> list[bytes]:
        """Texts of the ids in `flat`, of which each text has its count."""
        out, at = [], 0
        while at < len(counts):
            stop, n = at + 1, counts[at]
            while stop < len(counts) and n + counts[stop] <= self.STEP:
                n += counts[stop]
                stop += 1
            data = b"".join(self._some(flat[i : min(i + self.STEP, n)]) for i in range(0, n, self.STEP))
            ends = np.append(0, np.cumsum(self.size[flat[:n]]))[np.cumsum([0, *counts[at:stop]])].tolist()
            out += [data[a:b] for a, b in zip(ends, ends[1:], strict=False)]
            flat, at = flat[n:], stop
        return out


def encode(df: DataFrame, ranks: Mapping[bytes, int], pattern: str, text: str = "text", ids: str = "ids", words: bool = False, decoded: str | None = None) -> DataFrame:
    """Append the ids (array<int>) of each whole text; null and empty texts have none.

    Rows are independent: no shuffle, repeated rows get equal ids, a column named `ids` is replaced.
    Ids stand for the same tokens as the usual lowest-rank-first rule gives, special tokens excluded.
    The vocabulary is broadcast; `load_ranks` bounds it. `words`: see `Encoder`. With `decoded`, a
    column of that name has the bytes decoded from the ids, in the same pass.
    """
    name = hashlib.sha256(repr((sorted(ranks.items()), pattern, words)).encode()).hexdigest()
    shared = df.sparkSession.sparkContext.broadcast(dict(ranks))

    def make():
        claim("bpe", _CODERS.clear)
        if name not in _CODERS:
            _CODERS[name] = Encoder(shared.value, pattern, words), Decoder(shared.value)
        encoder, decoder = _CODERS[name]

        def run(part: pa.RecordBatch) -> list[pa.Array]:
            flat, ends = bytearray(), [0]
            for t in texts_of(part, text):
                flat += encoder.encode(t)
                ends.append(len(flat) // 4)
            whole = np.frombuffer(flat, np.int32)
            out = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(whole))]
            if decoded:
                out.append(pa.array(decoder.decode(whole, np.diff(ends).tolist()), pa.binary()))
            return out

        return run

    fields = [T.StructField(ids, T.ArrayType(T.IntegerType()))] + ([T.StructField(decoded, T.BinaryType())] if decoded else [])
    return map_texts(df, text, fields, make)


def decode(df: DataFrame, ranks: Mapping[bytes, int], ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Append the bytes that the ids stand for; null ids give empty bytes, an unknown id is an error."""
    shared = df.sparkSession.sparkContext.broadcast(dict(ranks))
    kept = [c for c in df.columns if c != out]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(out, T.BinaryType())])

    def run(batches):
        decoder = Decoder(shared.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                rows = part.column(ids)
                flat = rows.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
                made = decoder.decode(flat, pc.fill_null(pc.list_value_length(rows), 0).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + [pa.array(made, pa.binary())], names=[*kept, out])

    return df.select(*kept).mapInArrow(run, schema)
