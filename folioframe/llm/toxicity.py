"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import claim, map_texts, texts_of
from .quality import labelled_sample

#: Embedding tables, rows of each (as a power of two) and their width. Two hash the word, one its
#: first four letters and one its first five, which speak for forms that were never seen.
TABLES, TABLE_BITS, TABLE_DIMS = 4, 15, 4
ROWS, DIMS = 1 << TABLE_BITS, TABLES * TABLE_DIMS
HASH_BITS = TABLES * TABLE_BITS
#: Filter widths in words, and filters of each.
WIDTHS, FILTERS = (1, 2, 3), 8
#: Frequent words that tell the languages apart, for the calibration.
LANGUAGE_WORDS = {
    "en": "the of and to in is that for it with as was on are be this by at from an",
    "fr": "le les des et un une du dans pour qui sur au par pas avec ne aux ce il elle",
    "de": "der die und das ist nicht ein eine den dem mit sich von zu auf für im als auch sie",
    "es": "el los y las del una por con para es su al lo como más o se no sus este",
}
LANGUAGES = ("other", *LANGUAGE_WORDS)
_LANGUAGE_OF = {w: i for i, words in enumerate(LANGUAGE_WORDS.values(), 1) for w in words.split()}
MEMO_ENTRIES = 150_000


class WordCodes(dict):
    """word -> its rows in the tables and, above those bits, the language it speaks for (or 0)."""

    def __missing__(self, word: str) -> int:
        low = word.lower()
        bare = low.strip("".join({ch for ch in low if not ch.isalnum()})) if not low.isalnum() else low
        code = xxhash.xxh64_intdigest(bare) & (1 << 2 * TABLE_BITS) - 1 | _LANGUAGE_OF.get(bare, 0) << HASH_BITS
        for t, letters in ((2, 4), (3, 5)):
            code |= (xxhash.xxh64_intdigest(bare[:letters], seed=t) & ROWS - 1) << t * TABLE_BITS
        if len(self) >= MEMO_ENTRIES:
            self.clear()
        if len(word) <= 64:
            self[word] = code
        return code


_CODES = WordCodes()


def codes_of(text: str) -> np.ndarray:
    words = text.split()
    return np.fromiter(map(_CODES.__getitem__, words), np.int64, len(words))


def language_of(codes: np.ndarray) -> int:
    """The language most of whose frequent words occur; 0 where none does."""
    found = np.bincount(codes >> HASH_BITS, minlength=len(LANGUAGES))
    found[0] = 0
    return int(found.argmax()) if found.any() else 0


@dataclass
class ToxicityModel:
    """All of fixed size. `cut`: by language, the raw probability that becomes `at` in a score."""

    tables: np.ndarray  # TABLES x ROWS x TABLE_DIMS
    filters: list[np.ndarray]  # per width: width x DIMS x FILTERS
    bias: np.ndarray
    out: np.ndarray
    constant: float
    cut: dict[int, float] = field(default_factory=dict)
    at: float = 0.3

    def embed(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([self.tables[t][(codes >> (t * TABLE_BITS)) & ROWS - 1] for t in range(TABLES)], axis=1)

    def convolve(self, words: np.ndarray, width: int) -> np.ndarray:
        f = self.filters[WIDTHS.index(width)]
        n = len(words) - width + 1
        out = words[:n] @ f[0]
        for j in range(1, width):
            out += words[j : n + j] @ f[j]
        return out

    def pool(self, texts: list[np.ndarray], block: int = 200_000) -> np.ndarray:
        """Max-pooled filters of whole texts, of which each is padded with blank words at its end."""
        out = np.zeros((len(texts), len(WIDTHS) * FILTERS), np.float32)
        pad = max(WIDTHS) - 1
        for i, codes in enumerate(texts):
            for at in range(0, len(codes), block):
                part = codes[at : at + block + pad]
                words = np.zeros((len(part) + pad, DIMS), np.float32)
                words[: len(part)] = self.embed(part)
                for w, width in enumerate(WIDTHS):
                    here = out[i, w * FILTERS : (w + 1) * FILTERS]
                    np.maximum(here, self.convolve(words, width).max(0) + self.bias[w], out=here)
        return out

    def raw(self, texts: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.pool(texts) @ self.out + self.constant, -30, 30, dtype=np.float64)))

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """Raw odds, shifted so that the language's threshold comes to lie on `at`."""
        p = np.clip(self.raw(texts), 1e-9, 1 - 1e-9)
        cut = np.array([self.cut.get(language_of(c), 0.5) for c in texts])
        odds = np.log(p / (1 - p)) - np.log(cut / (1 - cut)) + np.log(self.at / (1 - self.at))
        return 1 / (1 + np.exp(-odds))


def _train(texts: list[np.ndarray], y: np.ndarray, epochs: int, rate: float, seed: int, least: int) -> ToxicityModel:
    rng = np.random.default_rng(seed)
    tables = np.zeros((TABLES, ROWS, TABLE_DIMS), np.float32)
    # words of fewer than `least` texts stay blank; the others start at their log odds
    for t in range(TABLES):
        seen = np.zeros((2, ROWS))
        for codes, label in zip(texts, y, strict=True):
            seen[int(label), np.unique((codes >> (t * TABLE_BITS)) & ROWS - 1)] += 1
        frequent = seen.sum(0) >= least
        share = np.log((seen[1] + 0.5) / (y.sum() + 1)) - np.log((seen[0] + 0.5) / ((1 - y).sum() + 1))
        # drawn to 0 where few texts speak
        tables[t, frequent, 0] = (np.clip(share, -3, 3) / 3 * seen.sum(0) / (seen.sum(0) + 10))[frequent]
        tables[t, frequent, 1:] = rng.normal(0, 0.02, (int(frequent.sum()), TABLE_DIMS - 1))
    filters = [rng.normal(0, 0.1, (w, DIMS, FILTERS)).astype(np.float32) for w in WIDTHS]
    for f in filters:
        f[0, ::TABLE_DIMS, : FILTERS // 2] += 0.4
    model = ToxicityModel(tables, filters, np.full((len(WIDTHS), FILTERS), -0.1, np.float32), rng.normal(0.3, 0.1, len(WIDTHS) * FILTERS).astype(np.float32), -1.0)
    grown = [np.full_like(f, 1e-3) for f in filters], np.full_like(model.out, 1e-3), np.full_like(tables, 1e-3), np.full_like(model.bias, 1e-3)
    pad = max(WIDTHS) - 1
    for _ in range(epochs):
        for i in rng.permutation(len(texts)):
            codes = texts[i]
            if not len(codes):
                continue
            words = np.zeros((len(codes) + pad, DIMS), np.float32)
            words[: len(codes)] = model.embed(codes)
            tops, pooled = [], np.zeros(len(WIDTHS) * FILTERS, np.float32)
            for w, width in enumerate(WIDTHS):
                values = model.convolve(words, width) + model.bias[w]
                top = values.argmax(0)
                tops.append(top)
                pooled[w * FILTERS : (w + 1) * FILTERS] = np.maximum(values[top, np.arange(FILTERS)], 0)
            odds = float(pooled @ model.out) + model.constant
            slope = 1 / (1 + np.exp(-np.clip(odds, -30, 30))) - y[i]
            back = slope * model.out * (pooled > 0)
            for w, width in enumerate(WIDTHS):
                for k in np.flatnonzero(back[w * FILTERS : (w + 1) * FILTERS]):
                    g, at = back[w * FILTERS + k], tops[w][k]
                    window = words[at : at + width]
                    into = g * filters[w][:, :, k]
                    step = g * window
                    grown[0][w][:, :, k] += step * step
                    filters[w][:, :, k] -= rate * step / np.sqrt(grown[0][w][:, :, k])
                    grown[3][w, k] += g * g
                    model.bias[w, k] -= rate * g / np.sqrt(grown[3][w, k])
                    for j in range(min(width, len(codes) - at)):
                        for t in range(TABLES):
                            row = int(codes[at + j]) >> (t * TABLE_BITS) & ROWS - 1
                            if tables[t, row].any():
                                d = into[j, t * TABLE_DIMS : (t + 1) * TABLE_DIMS]
                                grown[2][t, row] += d * d
                                tables[t, row] -= rate * d / np.sqrt(grown[2][t, row])
            step = slope * pooled
            grown[1][:] += step * step
            model.out -= rate * step / np.sqrt(grown[1])
            model.constant -= rate * 0.2 * slope
    return model


def _calibrate(model: ToxicityModel, texts: list[np.ndarray], y: np.ndarray, least: int = 10) -> dict[int, float]:
    """The threshold of each language that parts its labels best; languages with few use that of all."""

    def best(p: np.ndarray, labels: np.ndarray) -> float:
        order = np.argsort(-p)
        p, hits = p[order], np.cumsum(labels[order])
        f1 = 2 * hits / (np.arange(1, len(p) + 1) + labels.sum())
        f1[:-1][p[:-1] == p[1:]] = -1
        k = int(f1.argmax())
        low = p[k + 1] if k + 1 < len(p) else 0.0
        # in the middle of the gap, on the scale of the odds
        a, b = (np.log(np.clip(x, 1e-4, 1 - 1e-4) / (1 - np.clip(x, 1e-4, 1 - 1e-4))) for x in (p[k], low))
        return float(np.clip(1 / (1 + np.exp(-(a + b) / 2)), 0.02, 0.98))

    p = model.raw(texts)
    of = np.array([language_of(c) for c in texts])
    whole = best(p, y) if y.any() else 0.5
    return {i: best(p[of == i], y[of == i]) if y[of == i].sum() >= least else whole for i in range(len(LANGUAGES))}


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, text: str = "text", ident: str = "doc_id", label: str = "toxic", bound: int = 6000, max_chars: int = 20_000, epochs: int = 3, rate: float = 0.02, seed: int = 7, least: int = 4) -> ToxicityModel:
    """Train on a bounded sample of the labelled rows `allowed`: `bound` rows, texts of up to `max_chars`.

    Texts reach the driver as 8 bytes a word. A quarter of the sample is left for the thresholds.
    """
    sample = labelled_sample(docs.select(ident, text), labels, label, allowed, bound, ident).where(F.coalesce(F.length(text), F.lit(0)) <= max_chars)

    def make():
        claim("toxicity", _CODES.clear)
        return lambda part: [pa.array([codes_of(t).tobytes() for t in texts_of(part, text)], pa.binary())]

    found = sorted(map_texts(sample, text, [T.StructField("codes", T.BinaryType())], make, keep=[ident, "_label"]).collect())
    # copies would make the rare words of a text look frequent
    rows = list({r["codes"]: r for r in found}.values())
    texts = [np.frombuffer(r["codes"], np.int64) for r in rows]
    y = np.array([float(r["_label"] == 1) for r in rows])
    held = np.arange(len(y)) % 4 == 3 if y.sum() >= 200 else np.zeros(len(y), bool)
    model = _train([t for t, h in zip(texts, held, strict=True) if not h], y[~held], epochs, rate, seed, least)
    use = held if held.any() else ~held
    if len(y):
        model.cut = _calibrate(model, [t for t, u in zip(texts, use, strict=True) if u], y[use])
    return model


def score(df: DataFrame, model: ToxicityModel, text: str = "text", out: str = "score") -> DataFrame:
    """Append the toxicity score (0 to 1) of each whole text, in one pass without a shuffle.

    The language that picks the threshold is told from the text. Null and empty texts have no word
    and get the score of none; repeated rows get equal scores; a column named `out` is replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        claim("toxicity", _CODES.clear)

        def run(part: pa.RecordBatch) -> list[pa.Array]:
            return [pa.array(shared.value.score([codes_of(t) for t in texts_of(part, text)]), pa.float64())]

        return run

    return map_texts(df, text, [T.StructField(out, T.DoubleType())], make)
