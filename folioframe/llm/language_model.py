"""Language-model scoring: smoothed n-grams as the states of a weighted automaton with failure arcs."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, dropping_shuffles, give_back, utf8_size

#: The end of a text counts as a token; its key is no word's (words have the lowest bit set).
END = 0


#: Bytes between words, and the bytes of a word that are hashed side by side with those of others.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
SIDE_BY_SIDE = 64


def key(word: bytes) -> int:
    """63 bits of a word's hash, with the lowest bit set."""
    return xxhash.xxh64_intdigest(word) >> 1 | 1


def _mixed(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    """64 bits of a context's hash."""
    h = a * np.uint64(0x9E3779B97F4A7C15)
    h += np.asarray(b, np.uint64)
    for shift, odd in ((32, 0xD6E8FEB86659FD93), (29, 0xC2B2AE3D27D4EB4F)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(odd)
    h ^= h >> np.uint64(32)
    return h


#: What a word's hash begins with, by its length; the bits that its last, cut eight bytes keep.
LENGTHS = _mixed(np.arange(SIDE_BY_SIDE + 1, dtype=np.uint64), 1)
KEPT = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def token_keys(texts: list[str | None]) -> np.ndarray:
    """Keys of the words between the bytes x20 and x09-x0D, A-Z in lower case, END after each text's last.

    Words are hashed eight bytes a step, all words of a step at once; those of more than SIDE_BY_SIDE bytes by `key`.
    """
    encoded = [(t or "").encode() for t in texts]
    offsets = np.cumsum([1, *(len(t) + 1 for t in encoded)])[:-1]
    data = b"".join([b" ", b" ".join(encoded).lower(), bytes([0x20]) * 8])
    del encoded
    blank = BLANK[np.frombuffer(data, np.uint8)]
    edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    del blank
    start, size = edges[::2], edges[1::2] - edges[::2]
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=1)
    h = LENGTHS[np.minimum(size, SIDE_BY_SIDE)]
    todo, at, left = np.arange(len(start)), start, size
    for _ in range(0, SIDE_BY_SIDE, 8):
        h[todo] = _mixed(h[todo], eight[at] & KEPT[np.minimum(left, 8)])
        more = np.flatnonzero(left > 8)
        if not len(more):
            break
        todo, at, left = todo[more], at[more] + 8, left[more] - 8
    h = h >> np.uint64(1) | np.uint64(1)
    for i in np.flatnonzero(size > SIDE_BY_SIDE).tolist():
        h[i] = key(data[start[i] : start[i] + size[i]])
    ends = np.append(np.searchsorted(start, offsets[1:]), len(start))
    out = np.full(len(start) + len(texts), END, np.uint64)
    out[np.arange(len(start)) + np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))] = h
    return out


@dataclass
class Figures:
    """The training texts' tokens and types, and the discount of a token's own count."""

    tokens: int
    types: int
    discount: float

    def single(self, count: np.ndarray) -> np.ndarray:
        """Probability of a token without context, by absolute discounting."""
        if not self.tokens:
            return np.full(len(count), 1 / (self.types + 1))
        return (np.maximum(count - self.discount, 0) + min(self.discount * self.types, self.tokens) / (self.types + 1)) / self.tokens

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 0.1) / (self.tokens + 0.1 * (self.types + 1)))


#: Tokens that one lane of a walk takes; a text's lanes overlap by the two tokens that a state can hold.
LANE, MEMORY = 512, 2
#: Arcs that are made at once.
ARCS_AT_ONCE = 500_000


class Automaton:
    """The states, arcs and failure arcs of the model that a batch's texts can meet.

    State 0 is the empty context, 1 + w the word w, 1 + size + k the batch's k-th pair; only contexts of the
    training texts are entered. An arc leaves a state for a word that followed it in training: it adds the
    word's log10 probability there and leads to the longest context that the text then ends in. Where a state has no arc,
    its failure arc adds the mass that is left and leads to the next shorter context; in state 0
    a word has its own probability.
    """

    def __init__(self, single: np.ndarray):
        self.size = len(single)
        self.single = np.log10(single)
        self.start = np.zeros(self.size, np.int32)  # by word: the state after it, read in state 0
        self.codes = np.zeros(0, np.int64)  # of arcs: state * size + word, rising
        self.weight = np.zeros(0)
        self.next = np.zeros(0, np.int32)
        self.fail = np.zeros(1, np.int32)
        self.cost = np.zeros(1)

    def add_pairs(self, context: np.ndarray, of: np.ndarray, word: np.ndarray, own: np.ndarray, left: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Word states with their arcs. By context: its word, the mass it leaves, and whether it is one of training; by pair: its context's place, its word and the share its own count gives it. Returns the pairs' probabilities."""
        share = left[of]
        share *= 10 ** self.single[word]
        share += own
        entered = context[known]
        self.start[entered] = 1 + entered
        self.fail, self.cost = np.zeros(1 + self.size, np.int32), np.zeros(1 + self.size)
        self.cost[1 + context] = np.log10(left)
        self._pairs = arcs = np.flatnonzero(own > 0).astype(np.int32)
        self.codes = (1 + context)[of[arcs]] * self.size
        self.codes += word[arcs]
        self.weight, self.next = np.log10(share[arcs]), self.start[word[arcs]]
        return share

    def add_triples(self, context: np.ndarray, of: np.ndarray, word: np.ndarray, own: np.ndarray, left: np.ndarray, known: np.ndarray, second: np.ndarray, last: np.ndarray, chance: np.ndarray) -> None:
        """Pair states with their arcs. By context: its pair, and left and known as above; by triple: of, word and own as above, and last, the pair its last two words are; by pair: second, its second word, and its probability."""
        shorter = self.start[second]
        to = shorter.copy()
        to[context[known]] = 1 + self.size + context[known]
        self.next = to[self._pairs]
        del self._pairs
        self.fail = np.concatenate([self.fail, shorter])
        del shorter
        cost = np.zeros(len(second))
        cost[context] = np.log10(left)
        self.cost = np.concatenate([self.cost, cost])
        del cost
        n, arcs = len(self.codes), np.flatnonzero(own > 0).astype(np.int32)
        for name in ("codes", "weight", "next"):
            before = getattr(self, name)
            setattr(self, name, np.concatenate([before, np.zeros(len(arcs), before.dtype)]))
        for at in range(0, len(arcs), ARCS_AT_ONCE):
            some = arcs[at : at + ARCS_AT_ONCE]
            place, mine = slice(n + at, n + at + len(some)), of[some]
            self.codes[place] = (1 + self.size + context[mine]) * self.size + word[some]
            self.weight[place] = np.log10(own[some] + left[mine] * chance[last[some]])
            self.next[place] = to[last[some]]

    def walk(self, x: np.ndarray, length: np.ndarray) -> np.ndarray:
        """log10 probability of each text of a line of tokens: one pass from left to right that carries the state.

        Texts are walked side by side, long ones in lanes: a state tells at most the last MEMORY tokens, so a lane
        that begins so many tokens early in state 0 is in the text's own state where it begins to count.
        """
        lanes = -(-length // LANE)
        of = np.repeat(np.arange(len(length)), lanes)
        number = np.arange(len(of)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        begin = np.repeat(np.cumsum(length) - length, lanes)
        counted = begin + number * LANE
        at = np.maximum(begin, counted - MEMORY)
        stop = np.minimum(counted + LANE, begin + length[of])
        order = np.argsort(at - stop, kind="stable")  # the longest first, so that those still walking are a prefix
        counted, at, stop = counted[order], at[order], stop[order]
        total, state, live = np.zeros(len(of)), np.zeros(len(of), np.int64), len(of)
        step = 0
        while True:
            live = int(np.searchsorted(-(stop - at)[:live], -step, side="left"))
            if not live:
                break
            word = x[at[:live] + step].astype(np.int64)
            gain, now = np.zeros(live), state[:live]
            todo = np.flatnonzero(now)
            fresh = np.flatnonzero(now == 0)
            while len(todo):
                code = now[todo] * self.size + word[todo]
                place = np.minimum(np.searchsorted(self.codes, code), max(len(self.codes) - 1, 0))
                hit = self.codes[place] == code if len(self.codes) else np.zeros(len(todo), bool)
                took, place = todo[hit], place[hit]
                gain[took] += self.weight[place]
                now[took] = self.next[place]
                todo = todo[~hit]
                gain[todo] += self.cost[now[todo]]
                now[todo] = self.fail[now[todo]]
                empty = now[todo] == 0
                fresh = np.concatenate([fresh, todo[empty]])
                todo = todo[~empty]
            gain[fresh] += self.single[word[fresh]]
            now[fresh] = self.start[word[fresh]]
            total[:live] += np.where(at[:live] + step >= counted[:live], gain, 0)
            step += 1
        return np.bincount(of[order], total, len(length))


def _packed(values: np.ndarray, width: int) -> bytes:
    """The low `width` bytes of each value."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _unpacked(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel().astype(np.int64)


def _squeezed(numbers: np.ndarray) -> bytes:
    """Counts, compressed after all their lowest bytes, then all the next ones: most are small."""
    return zlib.compress(np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, numbers.itemsize).T).tobytes(), 1)


def _spread(data: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


class Order:
    """A batch's distinct n-grams of one order, sorted by context; the order is that of the words' keys,
    so it is the same whenever the batch is read, whatever the order of its rows.

    `at`: by place in the batch's line, the n-gram that begins there (in the order of `places`).
    """

    def __init__(self, codes: np.ndarray, places: np.ndarray, size: int, parts: int, hashed):
        self.places = places
        by = np.argsort(codes)
        codes = codes[by]
        new = np.append(True, codes[1:] != codes[:-1])[: len(codes)]
        self.at = np.empty(len(codes), np.int32)
        self.at[by] = np.cumsum(new, dtype=np.int32) - 1
        del by
        codes = codes[new]
        self.word = (codes % size).astype(np.int32)
        codes //= size
        new = np.append(True, codes[1:] != codes[:-1])[: len(codes)]
        self.context, self.of = codes[new], np.cumsum(new, dtype=np.int32) - 1
        self.hash = hashed(self.context)
        self.part = (self.hash >> np.uint64(8 * CONTEXT_BYTES)).astype(np.int32) % np.int32(parts)
        self.contexts = np.argsort(self.part, kind="stable").astype(np.int32)
        self.grams = np.argsort(self.part[self.of], kind="stable").astype(np.int32)
        self.context_cuts = np.searchsorted(self.part[self.contexts], np.arange(parts + 1))
        self.gram_cuts = np.searchsorted(self.part[self.of[self.grams]], np.arange(parts + 1))

    def asked(self, part: int) -> tuple[np.ndarray, np.ndarray]:
        """The contexts of a part and the n-grams of these, one context's after the other's."""
        return tuple(x[c[part] : c[part + 1]] for x, c in ((self.contexts, self.context_cuts), (self.grams, self.gram_cuts)))


class Line:
    """The tokens of a batch of texts in one line, as ranks of their words' keys (the end is 0)."""

    def __init__(self, texts, parts: int):
        texts = list(texts)
        # few texts at a time, so that their bytes are never held again as a whole
        upto = np.cumsum([len(t or "") for t in texts]) // TEXT_AT_ONCE
        cuts = [0, *(np.flatnonzero(np.diff(upto)) + 1).tolist(), len(texts)]
        found = pa.array(np.concatenate([token_keys(texts[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)])).dictionary_encode()
        self.keys, rank = np.unique(np.append(np.uint64(END), found.dictionary.to_numpy()), return_inverse=True)
        self.x = rank.astype(np.int32)[1:][found.indices.to_numpy()]
        del found
        self.length = np.diff(np.flatnonzero(self.x == 0), prepend=-1).astype(np.int64)
        self.parts = parts

    def orders(self):
        """The pairs, then the triples; only one of them is held, if the caller drops the first."""
        x, size, keys = self.x, len(self.keys), self.keys
        places = np.flatnonzero(x[:-1]).astype(np.int32)
        two = Order(x[places].astype(np.int64) * size + x[places + 1], places, size, self.parts, lambda u: _mixed(keys[u], 1))
        pair = np.zeros(len(x), np.int32)
        pair[places] = two.at
        first, second = two.context[two.of].astype(np.int32), two.word
        yield 2, two
        del two
        places = places[x[places + 1] > 0]
        codes = pair[places].astype(np.int64) * size + x[places + 2]
        del pair
        three = [Order(codes, places, size, self.parts, lambda g: _mixed(keys[first[g]], keys[second[g]]))]
        del codes, places, first, second
        yield 3, three.pop()


ASKED = "b int, p int, n int, keys binary, counts binary"
ANSWERED = "b int, p int, n int, found binary, total long, types long, n1 long, n2 long"
#: Of a context's hash, beside the two bytes that choose its part; of a word's key.
CONTEXT_BYTES, WORD_BYTES = 6, 5
GRAMS_AT_ONCE, TEXT_AT_ONCE = 4_000_000, 1 << 20


def _ask(rows: pd.DataFrame, parts: int, size: int) -> pd.DataFrame:
    """What a batch gives to the counts of n-grams of one size and wants to know of them, dealt by their contexts."""
    line = Line(rows["text"], parts)
    train = np.repeat(rows["train"].to_numpy(bool), line.length)
    out = []
    for n, order in line.orders():
        if n < size:
            continue
        counts = np.bincount(order.at, train[order.places], len(order.word)).astype("<u4")
        sizes = np.bincount(order.of, minlength=len(order.context)).astype("<u4")
        for part in np.unique(order.part).tolist():
            contexts, grams = order.asked(part)
            keys = _packed(order.hash[contexts], CONTEXT_BYTES) + _packed(line.keys[order.word[grams]] >> np.uint64(1), WORD_BYTES)
            out.append((rows["b"].iloc[0], part, n, keys, _squeezed(np.concatenate([sizes[contexts], counts[grams]]))))
        break
    line = order = counts = None
    give_back()
    return pd.DataFrame(out, columns=["b", "p", "n", "keys", "counts"])


def _asking(size: int, parts: int):
    return lambda rows: _ask(rows, parts, size)


def _answer(rows: pd.DataFrame) -> pd.DataFrame:
    """The counts of a part's n-grams and contexts over all batches, for each batch in its own order.

    All n-grams of a context are in one part, so its count and the number of words that follow it
    are sums here. Those of a large part are counted in turns, by word.
    """
    out = []
    figures = [0, 0, 0, 0]
    for n, group in rows.groupby("n"):
        asked = []
        contexts = []
        for keys, packed in zip(group["keys"], group["counts"], strict=True):
            numbers = _spread(packed, "<u4")
            # both lengths are sums over the contexts and the n-grams: two equations
            size = (len(keys) - WORD_BYTES * len(numbers)) // (CONTEXT_BYTES - WORD_BYTES)
            contexts.append(_unpacked(keys[: CONTEXT_BYTES * size], CONTEXT_BYTES))
            asked.append((size, keys, numbers))
        known, back = np.unique(np.concatenate(contexts), return_inverse=True)
        back = np.split(back, np.cumsum([len(c) for c in contexts])[:-1])
        turns = -(-sum(len(x) - s for s, _, x in asked) // GRAMS_AT_ONCE)
        total, types = np.zeros(len(known), np.int64), np.zeros(len(known), np.int64)
        found = [np.zeros(len(x) - s, "<u8") for s, _, x in asked]
        for turn in range(turns):
            codes, counts, picked = [], [], []
            for (size, keys, numbers), of in zip(asked, back, strict=True):
                words = _unpacked(keys[CONTEXT_BYTES * size :], WORD_BYTES)
                mine = np.flatnonzero(words % turns == turn)
                codes.append((np.repeat(of, numbers[:size])[mine] << 8 * WORD_BYTES) | words[mine])
                counts.append(numbers[size:][mine])
                picked.append(mine)
            grams, at = np.unique(np.concatenate(codes), return_inverse=True)
            count = np.bincount(at, np.concatenate(counts), len(grams)).astype(np.int64)
            of = grams >> 8 * WORD_BYTES
            total += np.bincount(of, count, len(known)).astype(np.int64)
            types += np.bincount(of, count > 0, len(known)).astype(np.int64)
            ends = np.cumsum([len(m) for m in picked])[:-1]
            for mine, there, result in zip(picked, np.split(at, ends), found, strict=True):
                result[mine] = count[there]
        if n == 2:  # the contexts are the words, each in one part
            figures = [int(total.sum()), *(int(x.sum()) for x in (total > 0, total == 1, total == 2))]
        for b, of, result in zip(group["b"], back, found, strict=True):
            data = _squeezed(np.concatenate([result, total[of].astype("<u8"), types[of].astype("<u8")]))
            out.append((b, rows["p"].iloc[0], n, data, None, None, None, None))
    out.append((-1, rows["p"].iloc[0], 0, None, *figures))
    frame = pd.DataFrame(out, columns=["b", "p", "n", "found", "total", "types", "n1", "n2"])
    return frame.astype({c: "Int64" for c in ("total", "types", "n1", "n2")})


def _settled(order: Order, answers: pd.DataFrame, cut: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By n-gram of the batch: its arc's own share; by context: the mass its failure arc keeps, and its count."""
    count = np.zeros(len(order.word))
    total, types = np.zeros(len(order.context)), np.zeros(len(order.context))
    for part, data in zip(answers["p"].tolist(), answers["found"], strict=True):
        contexts, grams = order.asked(part)
        numbers = _spread(data, "<u8")
        count[grams] = numbers[: len(grams)]
        total[contexts], types[contexts] = numbers[len(grams) :].reshape(2, -1)
    del order.hash, order.part, order.contexts, order.grams  # nothing more is asked
    seen = np.maximum(total, 1)
    left = np.where(total > 0, np.maximum(cut * types / seen, 1e-9), 1.0)
    count -= cut
    np.maximum(count, 0, out=count)
    count /= seen[order.of]
    return count, left, total


def score_batch(line: Line, found: pd.DataFrame, figures: Figures, ends: int, cut: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By text of a batch: known tokens, base score and the score of its walk. found: the answers to what the batch asked."""
    x, at = line.x, np.cumsum(line.length) - line.length
    for n, order in line.orders():
        own, left, seen = _settled(order, found[found["n"] == n], cut)
        if n == 2:
            count = np.zeros(len(line.keys))
            count[0], count[order.context] = ends, seen
            base = np.add.reduceat(figures.base(count)[x], at)
            known = np.add.reduceat((count > 0)[x].astype(np.int64), at)
            automaton = Automaton(figures.single(count))
            second = order.word
            chance = automaton.add_pairs(order.context, order.of, second, own, left, seen > 0)
            pair = np.zeros(len(x), np.int32)  # by place: the pair that begins there
            pair[order.places] = order.at
        else:
            last = np.zeros(len(order.word), np.int32)
            last[order.at] = pair[order.places + 1]
            del pair, order.at, order.places
            automaton.add_triples(order.context, order.of, order.word, own, left, seen > 0, second, last, chance)
            del second, last, chance
        del order, own, left, seen
    give_back()
    return known, base, automaton.walk(x, line.length)


def score_texts(df: DataFrame, allowed: Column, ident: str = "doc_id", text: str = "text", batch_bytes: int = 16 << 20, cut: float = 0.75) -> DataFrame:
    """Score every whole text by a model of the texts `allowed` for training.

    Returns ident, n_tokens, n_known, train_tokens, base_score and score, the last two in log10.
    Null and empty texts are one token, the end; repeated rows are scored one by one and, if allowed,
    counted one by one; an empty table gives an empty result; with no training text every token is
    unknown; a text of any length is walked whole. Other columns are not read.

    All words, pairs and triples of the training texts are counted over the cluster, so the automaton
    grows with the corpus: every word and pair is a state and every pair and triple an arc, however
    rare. Nobody holds it whole. A batch of about `batch_bytes` sends its own distinct n-grams, with
    their counts, to the parts that their contexts belong to, gets back what its texts can meet, makes the
    states, arcs and failure arcs of it, and walks each text once from left to right.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "lm")
    docs = df.select(F.col(ident).alias("ident"), F.col(text).alias("text"), F.coalesce(allowed, F.lit(False)).alias("train"))
    sums = docs.agg(F.sum(utf8_size("text")).alias("size"), F.count_if("train").alias("ends")).first()
    size, ends = sums["size"] or 0, sums["ends"]
    batches = max(1, -(-size // batch_bytes))
    parts = max(1, min(1 << 16, -(-size // (8 << 20)) if batch_bytes >= 1 << 20 else -(-size // (batch_bytes // 3))))
    dealt = docs.select("ident", "text", "train", F.pmod(F.xxhash64("ident", "text"), F.lit(batches)).cast("int").alias("b"))

    answered = []
    for n in (2, 3):  # one size after the other, so that the keys of one alone are on disk
        asked = dealt.groupBy("b").applyInPandas(_asking(n, parts), ASKED)
        with dropping_shuffles(spark):
            answered.append(scratch.write(asked.groupBy("p").applyInPandas(_answer, ANSWERED)))
    answers = answered[0].unionByName(answered[1])
    sums = answers.where("b < 0").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total", "types", "n1", "n2"))).first()
    n1, n2 = sums["n1"] + (ends == 1), sums["n2"] + (ends == 2)
    figures = Figures(sums["total"] + ends, sums["types"] + (ends > 0), n1 / (n1 + 2 * n2) if n1 else 0.5)

    def walk(rows: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame(columns=["ident", "n_tokens", "n_known", "base_score", "score"])
        line = Line(rows["text"], parts)
        known, base, score = score_batch(line, found, figures, ends, cut)
        return pd.DataFrame({"ident": rows["ident"], "n_tokens": line.length, "n_known": known, "base_score": base, "score": score})

    schema = T.StructType([T.StructField("ident", docs.schema["ident"].dataType), *(T.StructField(n, T.LongType()) for n in ("n_tokens", "n_known")), *(T.StructField(n, T.DoubleType()) for n in ("base_score", "score"))])
    scored = dealt.groupBy("b").cogroup(answers.where("b >= 0").select("b", "p", "n", "found").groupBy("b")).applyInPandas(walk, schema)
    return scored.select(F.col("ident").alias(ident), "n_tokens", "n_known", F.lit(int(figures.tokens)).cast("long").alias("train_tokens"), "base_score", "score")
