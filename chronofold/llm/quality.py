"""Quality classifier: logistic regression on hashed word n-grams, trained by FTRL-proximal.

A text's features are its distinct words and neighbouring word pairs, hashed into 2**BITS
slots; the n-grams' vector has length one. Beside the raw words, each word's shape (its kinds
of characters, runs shortened) is a word of its own, which carries over to words never
seen, and a few marks tell the text's length and repetition. Training is follow-the-regularised-leader with per-coordinate rates over a bounded
sample of labelled rows; scoring is a sparse dot product with the learned weights.
"""

from __future__ import annotations

import functools
import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import released, text_of
from .lexicon import labelled_sample

#: Labelled rows that are trained on, at most.
SAMPLE = 8_000
BITS = 18
EPOCHS = 4
_LOWER = re.compile(r"[^\W\d_A-ZÀ-Þ]+")
_UPPER = re.compile(r"[A-ZÀ-Þ]+")
_DIGIT = re.compile(r"[0-9]+")
REMEMBERED = 100_000


@functools.lru_cache(maxsize=65_536)
def _shape_code(word: str) -> int:
    shape = _DIGIT.sub("9", _UPPER.sub("X", _LOWER.sub("x", word)))
    return zlib.crc32(b"\1" + re.sub(r"(.)\1+", r"\1", shape).encode("utf-8", "surrogatepass"))


class Hasher:
    """Slots of a text's features; word codes are remembered, up to a bound, by each worker."""

    def __init__(self, bits: int = BITS):
        self.mask = np.uint64((1 << bits) - 1)
        self.known: dict[str, tuple[int, int]] = {}

    def codes(self, words: list[str]) -> np.ndarray:
        known = self.known
        missing = {w for w in words if w not in known}
        if len(known) + len(missing) > REMEMBERED:
            known.clear()
            missing = set(words)
        for w in missing:
            known[w] = (zlib.crc32(w.encode("utf-8", "surrogatepass")), _shape_code(w))
        out = np.empty((len(words), 2), np.uint64)
        out[:, 0] = [known[w][0] for w in words]
        out[:, 1] = [known[w][1] for w in words]
        return out

    def features(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(slots, values): distinct n-grams with equal values of length one together, and marks of value one.

        The marks are the text's order of length, the rough share of distinct words, of
        words that repeat the word before, and of each frequent pair of shapes.
        """
        words = (text or "").split()
        marks = [b"\2%d" % int(math.log2(len(words) + 1))]
        code = self.codes(words) if words else np.empty((0, 2), np.uint64)
        pairs = [code[:-1, k] * np.uint64(0x9E3779B97F4A7C15) ^ code[1:, k] * np.uint64(0xC2B2AE3D27D4EB4F) for k in (0, 1)]
        if len(words) > 1:
            n = len(words) - 1
            marks.append(b"\3%d" % (10 * len(np.unique(code[:, 0])) // len(words)))
            marks.append(b"\4%d" % (10 * int(np.count_nonzero(code[:-1, 0] == code[1:, 0])) // n))
            shapes, counts = np.unique(pairs[1], return_counts=True)
            marks += [b"\5%d:%d" % (c, -int(math.log2(k / n))) for c, k in zip(shapes.tolist(), counts.tolist()) if 32 * k >= n]
        dense = self._slots(np.array([zlib.crc32(m) for m in marks], np.uint64))
        sparse = self._slots(np.concatenate([code[:, 0], code[:, 1], *(p >> np.uint64(17) for p in pairs)]))
        sparse = np.setdiff1d(sparse, dense, assume_unique=True)
        return np.concatenate([dense, sparse]), np.concatenate([np.ones(len(dense)), np.full(len(sparse), 1 / math.sqrt(max(1, len(sparse))))])

    def _slots(self, codes: np.ndarray) -> np.ndarray:
        return np.unique(((codes * np.uint64(0xFF51AFD7ED558CCD)) >> np.uint64(40)) & self.mask).astype(np.int64)


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, x))))


class Ftrl:
    """FTRL-proximal: z and n per slot; weights are nonzero only where |z| exceeds l1."""

    def __init__(self, bits: int = BITS, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(1 << bits), np.zeros(1 << bits)
        self.bias_z = self.bias_n = 0.0

    def _weights(self, z, n):
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def _bias(self) -> float:
        return -self.bias_z / ((self.beta + math.sqrt(self.bias_n)) / self.alpha)

    def weights(self) -> tuple[np.ndarray, float]:
        return self._weights(self.z, self.n).astype(np.float32), self._bias()

    def update(self, slots: np.ndarray, values: np.ndarray, y: int) -> float:
        z, n = self.z[slots], self.n[slots]
        w, b = self._weights(z, n), self._bias()
        p = _sigmoid(b + float(w @ values))
        g = (p - y) * values
        self.z[slots] = z + g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[slots] = n + g * g
        gb = p - y
        self.bias_z += gb - (math.sqrt(self.bias_n + gb * gb) - math.sqrt(self.bias_n)) / self.alpha * b
        self.bias_n += gb * gb
        return p


def train(rows: list[tuple[str | None, int]], bits: int = BITS, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """(weights, bias) from labelled texts, in an order fixed by the texts' checksums."""
    rows = sorted(rows, key=lambda r: (zlib.crc32((r[0] or "").encode("utf-8", "surrogatepass")), r[0] or "", r[1]))
    hasher, model = Hasher(bits), Ftrl(bits)
    data = [(*hasher.features(t), y) for t, y in rows]
    data = [(s.astype(np.int32), v.astype(np.float32), y) for s, v, y in data]
    for _ in range(epochs):
        for slots, values, y in data:
            model.update(slots, values, y)
    return model.weights()


def _train_one(bits: int, epochs: int):
    def run(batches):
        rows = [r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        weights, bias = train(rows, bits, epochs)
        yield pa.RecordBatch.from_arrays([pa.array([weights.astype("<f4").tobytes()], pa.binary()), pa.array([bias], pa.float64())], ["weights", "bias"])

    return run


def learn_from(docs: DataFrame, labels: DataFrame, label: str, keep: Column, limit: int = SAMPLE, bits: int = BITS) -> tuple[np.ndarray, float]:
    """Train in one task over at most ``limit`` labelled rows; 2**bits weights come to the driver."""
    sample = labelled_sample(docs, labels, label, keep, limit)
    # an exchange, not coalesce: the texts are read by all executors, only the sample meets in one task
    got = sample.repartition(1).mapInArrow(released(_train_one(bits, EPOCHS)), "weights binary, bias double").first()
    if got is None:
        return np.zeros(1 << bits, np.float32), 0.0
    return np.frombuffer(got.weights, "<f4").copy(), got.bias


def score_texts(df: DataFrame, weights: np.ndarray, bias: float, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``df`` with quality_score (0 to 1) added.

    The 2**bits weights are a broadcast of fixed size. Null and empty texts have the one
    feature of their length; a model without training rows scores one half; a column with
    the added name is replaced; repeated rows stay; an empty table gives an empty result.
    """
    shared = df.sparkSession.sparkContext.broadcast(weights)
    bits = int(math.log2(len(weights)))
    hashers: dict[int, Hasher] = {}

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        hasher = hashers.setdefault(bits, Hasher(bits))
        w = shared.value
        out = []
        for t in (t for k in range(0, len(texts), 256) for t in texts.slice(k, 256).to_pylist()):
            slots, values = hasher.features(t)
            out.append(_sigmoid(bias + float(w[slots] @ values)))
        return pa.array(out, pa.float64())

    return df.withColumn("quality_score", scored(text_of(text_col)))
