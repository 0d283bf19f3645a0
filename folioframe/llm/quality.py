"""Quality classifier: similarity-weighted votes of the nearest labelled latent-semantic vectors."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import claim, map_texts, texts_of

#: Hash bins of words, of word shapes, and the figures of a whole text.
WORD_BINS, SHAPE_BINS, FIGURES = 1024, 512, 8
WIDTH = WORD_BINS + SHAPE_BINS + FIGURES
#: Weight of each block in a vector.
WORD_WEIGHT, SHAPE_WEIGHT, FIGURE_WEIGHT = 0.5, 1.0, 0.7
MEMO_ENTRIES = 150_000


class WordCodes(dict):
    """word -> word bin + shape bin * WORD_BINS, worked out once per word."""

    def __missing__(self, word: str) -> int:
        shape, last = [], ""
        for ch in word:
            kind = "x" if ch.islower() else "X" if ch.isupper() else "d" if ch.isdigit() else "a" if ch.isalpha() else ch
            if kind != last:
                shape.append(kind)
                last = kind
        bare = "".join(ch for ch in word.lower() if ch.isalnum())
        code = zlib.crc32(bare.encode()) % WORD_BINS + zlib.crc32(("".join(shape)[:12] + str(min(len(word), 24) // 4)).encode()) % SHAPE_BINS * WORD_BINS
        if len(self) >= MEMO_ENTRIES:
            self.clear()
        if len(word) <= 64:
            self[word] = code
        return code


_CODES = WordCodes()


def features(text: str) -> np.ndarray:
    """The raw features of a whole text; an empty one has zeros but for the length figure."""
    out = np.zeros(WIDTH, np.float32)
    words = text.split()
    n = len(words)
    if n:
        codes = np.fromiter(map(_CODES.__getitem__, words), np.int64, n)
        out[:WORD_BINS] = np.bincount(codes % WORD_BINS, minlength=WORD_BINS)
        out[WORD_BINS : WORD_BINS + SHAPE_BINS] = np.bincount(codes // WORD_BINS, minlength=SHAPE_BINS)
        out[: WORD_BINS + SHAPE_BINS] = np.sqrt(out[: WORD_BINS + SHAPE_BINS] / n)
        lines = [x for x in text.split("\n") if x.strip()]
        out[WORD_BINS + SHAPE_BINS :] = (
            np.mean(codes[1:] == codes[:-1]) if n > 1 else 0.0,
            1 - len(set(words)) / n,
            1 - len(set(lines)) / max(1, len(lines)),
            min(1.0, len(text) / n / 20),
            sum(map(text.count, "|#*&%$!<>{}")) / len(text) * 4,
            min(1.0, n / len(text) * 4),
            min(1.0, len(lines) / n),
            0.0,
        )
    out[-1] = min(1.0, np.log1p(n) / 10)
    return out


@dataclass
class QualityModel:
    """Labelled vectors in the latent space; its size is bounded by the sample and `dims`."""

    scale: np.ndarray  # per feature
    axes: np.ndarray  # WIDTH x dims
    vectors: np.ndarray  # sample x dims, of unit length
    labels: np.ndarray
    neighbours: int
    power: float

    def embed(self, raw: np.ndarray) -> np.ndarray:
        z = (raw * self.scale) @ self.axes
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def score(self, raw: np.ndarray, block: int = 512) -> np.ndarray:
        """Exact cosines to every labelled vector, a block of texts at a time."""
        if not len(self.labels):
            return np.full(len(raw), 0.5)
        k = min(self.neighbours, len(self.labels))
        out = np.empty(len(raw))
        for at in range(0, len(raw), block):
            near = self.embed(raw[at : at + block]) @ self.vectors.T
            best = np.argpartition(-near, k - 1, axis=1)[:, :k]
            weight = np.clip(np.take_along_axis(near, best, 1), 1e-6, None).astype(np.float64) ** self.power
            out[at : at + block] = (weight * self.labels[best]).sum(1) / weight.sum(1)
        return np.clip(out, 0.0, 1.0)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, bound: int, ident: str = "doc_id", per_class: bool = True) -> DataFrame:
    """At most `bound` labelled rows of docs (half of them a class), the first in a digest's order.

    Only ids and labels are sorted; the texts of the chosen ids then come by a broadcast of at most
    `bound` ids. Rows without a label or an id take no part; a repeated id has its highest label and its
    lowest text, so that no more than `bound` rows come of it.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(ident).isNotNull() & allowed).groupBy(ident).agg(F.max(label).cast("int").alias("_label"))
    order = [F.xxhash64(ident), F.col(ident)]
    picked = known.where("_label = 1").orderBy(*order).limit(bound // 2).unionByName(known.where("_label <> 1").orderBy(*order).limit(bound // 2)) if per_class else known.orderBy(*order).limit(bound)
    found = docs.join(F.broadcast(picked), ident)
    rest = [c for c in docs.columns if c != ident]
    return found.groupBy(ident, "_label").agg(*(F.min(c).alias(c) for c in rest))


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, text: str = "text", ident: str = "doc_id", label: str = "quality", bound: int = 3000, dims: int = 48, neighbours: int = 15, power: float = 4.0) -> QualityModel:
    """Latent-semantic vectors of a bounded sample (`bound` rows) of the labelled rows `allowed`."""
    sample = labelled_sample(docs.select(ident, text), labels, label, allowed, bound, ident).select(ident, text, "_label")

    def make():
        claim("quality", _CODES.clear)
        return lambda part: [pa.array([features(t).tobytes() for t in texts_of(part, text)], pa.binary())]

    rows = sorted(map_texts(sample, text, [T.StructField("raw", T.BinaryType())], make, keep=[ident, "_label"]).collect())
    if not rows:
        return QualityModel(np.ones(WIDTH, np.float32), np.zeros((WIDTH, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), neighbours, power)
    raw = np.stack([np.frombuffer(r["raw"], np.float32) for r in rows])
    weight = np.concatenate([np.full(WORD_BINS, WORD_WEIGHT), np.full(SHAPE_BINS, SHAPE_WEIGHT), np.full(FIGURES, FIGURE_WEIGHT)])
    rarity = np.log((len(raw) + 1) / (1 + (raw > 0).sum(0))) + 1
    scale = (weight * np.where(np.arange(WIDTH) < WORD_BINS + SHAPE_BINS, np.sqrt(rarity), 1)).astype(np.float32)
    axes = np.linalg.eigh((raw * scale).T @ (raw * scale))[1][:, ::-1][:, :dims].astype(np.float32)
    model = QualityModel(scale, np.ascontiguousarray(axes), np.zeros((0, dims), np.float32), np.array([float(r["_label"] == 1) for r in rows]), neighbours, power)
    model.vectors = model.embed(raw)
    return model


def score(df: DataFrame, model: QualityModel, text: str = "text", out: str = "score") -> DataFrame:
    """Append the quality score (0 to 1) of each whole text, in one pass without a shuffle.

    Null and empty texts are scored like texts without words; without any labelled row each score is
    0.5. Repeated rows get equal scores; a column named `out` is replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        claim("quality", _CODES.clear)

        def run(part: pa.RecordBatch) -> list[pa.Array]:
            texts = texts_of(part, text)
            found = [shared.value.score(np.stack([features(t) for t in texts[at : at + 512]])) for at in range(0, len(texts), 512)]
            return [pa.array(np.concatenate(found), pa.float64())]

        return run

    return map_texts(df, text, [T.StructField(out, T.DoubleType())], make)
