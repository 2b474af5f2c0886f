"""Quality classifier: ordinal cumulative-link regression on graded ratings over hashed text.

P(grade > k) = sigmoid(w.x - t_k): one weight vector for all grades, ordered thresholds between them. x holds hashed
byte pairs and triples of the whole text (square roots of their shares) and a few shares that hashing cannot see. The
model is fitted on a bounded sample of rated rows; what is broadcast is its weights, whose number is fixed.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from souba.llm.common import hash60, with_columns

BUCKETS = 1024           # for pairs, and as many for triples
SHAPES = 5
WIDTH = 2 * BUCKETS + SHAPES
MAX_RATED = 8000         # rated rows the model is fitted on, the lowest by a hash of their id
STEPS = 400
_SHIFT = np.uint64(64 - BUCKETS.bit_length() + 1)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _shares(codes: np.ndarray) -> np.ndarray:
    buckets = (codes * _ODD >> _SHIFT).astype(np.int64)
    return np.sqrt(np.bincount(buckets, minlength=BUCKETS)[:BUCKETS] / max(1, len(codes)))


def features(text: str | None) -> np.ndarray:
    """Features of one whole text; all zero for null and empty texts."""
    out = np.zeros(WIDTH, dtype=np.float32)
    if not text:
        return out
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    wide = raw.astype(np.uint64)
    pairs = wide[:-1] << np.uint64(8) | wide[1:]
    out[:BUCKETS] = _shares(pairs)
    out[BUCKETS:2 * BUCKETS] = _shares(pairs[:-1] << np.uint64(8) | wide[2:])
    words = text.split()
    letters = (raw >= 97) & (raw <= 122) | (raw >= 65) & (raw <= 90) | (raw >= 128)
    again = sum(map(str.__eq__, words, words[1:]))
    out[2 * BUCKETS:] = (again / max(1, len(words)), 1 - len(set(words)) / max(1, len(words)) ** 0.8 if words else 0,
                         np.count_nonzero((raw >= 65) & (raw <= 90)) / len(raw), 1 - np.count_nonzero(letters | (raw == 32)) / len(raw),
                         min(1.0, math.log1p(len(words)) / 10))
    return out


@dataclass(frozen=True)
class OrdinalModel:
    """Weights shared by all grades and one threshold below each grade but the lowest."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, x: np.ndarray) -> np.ndarray:
        """P(grade > k) per row and threshold."""
        return 1 / (1 + np.exp(-np.clip((x @ self.weights)[:, None] - self.thresholds, -40, 40)))


def fit_ordinal(x: np.ndarray, grades: np.ndarray, n_grades: int, penalty: float = 2e-4, steps: int = STEPS) -> OrdinalModel:
    """Maximum likelihood by Adam; thresholds stay ordered as sums of exponentials.

    Each row counts once for its own grade's interval: P(grade = k) = P(> k-1) - P(> k). Without rows the thresholds
    stand at even odds.
    """
    gaps = np.zeros(n_grades - 1)
    w = np.zeros(x.shape[1])
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(gaps), np.zeros_like(gaps)]
    rows = np.arange(len(grades))
    for step in range(1, steps + 1 if len(grades) else 1):
        t = gaps[0] + np.concatenate([[0], np.cumsum(np.exp(gaps[1:]))])
        upper = np.concatenate([t, [np.inf]])[grades]          # grade k lies between t[k-1] and t[k]
        lower = np.concatenate([[-np.inf], t])[grades]
        z = (x @ w.astype(x.dtype)).astype(float)
        hi = 1 / (1 + np.exp(-np.clip(upper - z, -40, 40)))
        lo = 1 / (1 + np.exp(-np.clip(lower - z, -40, 40)))
        p = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = np.where(np.isinf(upper), 0, hi * (1 - hi)) / p, np.where(np.isinf(lower), 0, lo * (1 - lo)) / p
        g_w = ((d_hi - d_lo).astype(x.dtype) @ x).astype(float) / len(rows) + penalty * w
        g_t = np.zeros(n_grades + 1)
        np.add.at(g_t, grades + 1, -d_hi / len(rows))
        np.add.at(g_t, grades, d_lo / len(rows))
        g_t = g_t[1:-1]
        g_gap = np.concatenate([[g_t.sum()], np.exp(gaps[1:]) * np.cumsum(g_t[::-1])[::-1][1:]])
        for k, (value, g) in enumerate(((w, g_w), (gaps, g_gap))):
            state[2 * k] = 0.9 * state[2 * k] + 0.1 * g
            state[2 * k + 1] = 0.99 * state[2 * k + 1] + 0.01 * g * g
            value -= 0.1 * (state[2 * k] / (1 - 0.9 ** step)) / (np.sqrt(state[2 * k + 1] / (1 - 0.99 ** step)) + 1e-8)
    return OrdinalModel(w.astype(np.float32), gaps[0] + np.concatenate([[0], np.cumsum(np.exp(gaps[1:]))]))


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            rows = [features(t).astype(np.float16).tobytes() for t in part.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("_grade"), pa.array(rows, pa.binary())], names=["grade", "x"])


def train(docs: DataFrame, ratings: DataFrame, n_grades: int, key: str = "doc_id", text: str = "text", max_rated: int = MAX_RATED) -> OrdinalModel:
    """Fit on at most ``max_rated`` rated documents: ``ratings`` has the key and ``grade`` (0 to ``n_grades`` - 1).

    Ratings without a document, of an unknown grade, or with a null key are not used.
    """
    rated = ratings.select(F.col(key).alias("_rated"), F.col("grade").cast("int").alias("_grade")).filter(F.col("_grade").between(0, n_grades - 1) & F.col("_rated").isNotNull())
    sample = rated.orderBy(hash60(F.col("_rated").cast("string")), "_rated", "_grade").limit(max_rated)
    joined = docs.select(F.col(f"`{key}`").alias("_rated"), F.col(f"`{text}`").alias("_text")).join(F.broadcast(sample), "_rated")  # at most max_rated rows
    rows = joined.select("_grade", "_text").mapInArrow(_feature_rows, "grade int, x binary").orderBy(F.md5("x"), "grade").toArrow()
    x = np.frombuffer(b"".join(rows.column("x").to_pylist()), dtype=np.float16).reshape(-1, WIDTH).astype(np.float32)
    return fit_ordinal(x, np.array(rows.column("grade").to_pylist(), dtype=np.int64), n_grades)


def _score(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: OrdinalModel = shared.value
        for batch in batches:
            texts = batch.column("_text")
            tails = [model.tails(np.array([features(t.as_py()) for t in texts.slice(at, 256)])) for at in range(0, batch.num_rows, 256)]
            tails = np.concatenate(tails) if tails else np.zeros((0, len(model.thresholds)))
            yield with_columns(batch.drop_columns(["_text"]), expected_grade=pa.array(tails.sum(axis=1), pa.float64()),
                               tail_probability=pa.array(tails[:, 0].astype(float), pa.float64()))
    return score


def grade(docs: DataFrame, model: OrdinalModel, text: str = "text") -> DataFrame:
    """``docs`` with ``expected_grade`` and ``tail_probability`` (that the grade is above the lowest).

    Null and empty texts have no features: the thresholds alone grade them. Equal texts have equal grades. Columns
    named like a result give way.
    """
    results = ("expected_grade", "tail_probability")
    own = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in results], F.col(f"`{text}`").alias("_text"))
    schema = StructType([StructField(f.name, f.dataType) for f in own.schema.fields[:-1]] + StructType.fromDDL(", ".join(f"{r} double" for r in results)).fields)
    return own.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model)), schema)


def graded_labels(labels: DataFrame) -> DataFrame:
    """Ratings from labels: 0 for low quality, 1 for good but toxic text, 2 for the rest; one row per document, the lowest."""
    level = F.when(F.col("quality") == 0, 0).when((F.col("quality") == 1) & (F.col("toxic") == 1), 1).when(F.col("quality") == 1, 2)
    return labels.select("doc_id", level.alias("grade")).groupBy("doc_id").agg(F.min("grade").alias("grade"))
