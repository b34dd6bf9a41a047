"""Quality by ordinal regression (cumulative links) on graded ratings.

P(grade <= k) = sigmoid(threshold_k - w.x) with one weight vector w over hashed text features for all grades, and
ordered thresholds. A document gets its expected grade and the probability of each upper tail; selection asks
that the tail from ``grade`` on be probable enough.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, small_batches
from .text_kernel import buffers, word_spans
from .text_model import DIMS, SAMPLE, Sample, descend, labelled_sample, scores, sigmoid

#: Features are shares of the text's words.
POWER = 1.0
STEPS, RATE, SHRINK = 120, 0.15, 2e-5
#: The least tail probability of a document that is kept.
KEEP_FROM = 0.5


@dataclass
class CumulativeLink:
    grades: np.ndarray  # ordered
    weights: np.ndarray  # (DIMS,)
    thresholds: np.ndarray  # one fewer than grades, ascending

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > grades[k]) for each text and threshold."""
        return sigmoid(score[:, None] - self.thresholds[None, :])


def _thresholds(p: np.ndarray) -> np.ndarray:
    """The first as it is, each next one by a positive step above."""
    return p[0] + np.concatenate([[0.0], np.cumsum(np.exp(p[1:]))])


def fit(sample: Sample, steps: int = STEPS) -> CumulativeLink:
    """Maximum likelihood with a slight shrinkage. A single grade gives a model that knows only that grade."""
    grades = np.unique(sample.label)
    cuts = len(grades) - 1
    if cuts < 1:
        return CumulativeLink(grades if len(grades) else np.array([0]), np.zeros(DIMS), np.zeros(0))
    y = np.searchsorted(grades, sample.label)
    share = np.clip(np.cumsum(np.bincount(y, minlength=cuts + 1))[:-1] / len(y), 1e-3, 1 - 1e-3)
    first = np.log(share / (1 - share))
    start = np.concatenate([np.zeros(DIMS), first[:1], np.log(np.maximum(np.diff(first), 1e-2))])

    def gradient(p: np.ndarray) -> np.ndarray:
        w, theta = p[:DIMS], _thresholds(p[DIMS:])
        s = sample.times(w)
        below = np.concatenate([np.zeros((len(s), 1)), sigmoid(theta[None, :] - s[:, None]), np.ones((len(s), 1))], axis=1)
        rows = np.arange(len(s))
        upper, lower = below[rows, y + 1], below[rows, y]
        inside = np.maximum(upper - lower, 1e-9)
        d_up, d_low = upper * (1 - upper) / inside, lower * (1 - lower) / inside
        g_theta = np.zeros(cuts)
        for k in range(cuts):
            g_theta[k] = (-(d_up * (y == k)).sum() + (d_low * (y == k + 1)).sum()) / len(s)
        g_p = np.concatenate([[g_theta.sum()], [g_theta[k:].sum() * np.exp(p[DIMS + k]) for k in range(1, cuts)]])
        return np.concatenate([sample.back((d_up - d_low) / len(s)) + SHRINK * w, g_p])

    p = descend(gradient, start, steps, RATE)
    return CumulativeLink(grades, p[:DIMS], _thresholds(p[DIMS:]))


def train(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> CumulativeLink:
    return fit(labelled_sample(docs, labels, F.col("quality"), POWER, limit))


def judge(raw: np.ndarray, off: np.ndarray, model: CumulativeLink, grade: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Expected grade and tail probability of each text."""
    k = len(model.grades) - 2 if grade is None else int(np.searchsorted(model.grades, grade)) - 1
    n = np.diff(word_spans(raw, off)[2])
    tails = model.tails(scores(raw, off, model.weights[:, None], POWER)[:, 0])
    expected = model.grades[0] + (tails * np.diff(model.grades)[None, :]).sum(axis=1)
    tail = tails[:, k] if tails.shape[1] and k >= 0 else np.ones(len(n))
    return np.where(n == 0, float(model.grades[0]), expected), np.where(n == 0, 0.0, tail)


def rate(docs: DataFrame, model: CumulativeLink, grade: int | None = None, keep_from: float = KEEP_FROM) -> DataFrame:
    """One row per row of docs: doc_id, expected_grade, tail (P(grade >= ``grade``), by default the highest), kept.
    Null and empty texts have nothing to rate: the lowest grade, tail 0, not kept. Repeated rows are rated alike;
    without labels every text with words has grade 0 and is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            expected, tail = judge(*buffers(batch.column(1)), model, grade)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(expected), pa.array(tail), pa.array(tail >= keep_from)], ["doc_id", "expected_grade", "tail", "kept"])

    small_batches(docs.sparkSession)
    return documents(docs).mapInArrow(run, "doc_id long, expected_grade double, tail double, kept boolean")


def select(docs: DataFrame, model: CumulativeLink, grade: int | None = None, keep_from: float = KEEP_FROM) -> DataFrame:
    """The rows of docs, with all their columns, whose text is kept: judged and filtered where they are, without a shuffle."""
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, tail = judge(*buffers(batch.column(text).fill_null("")), model, grade)
            yield batch.filter(pa.array(tail >= keep_from))

    small_batches(docs.sparkSession)
    return docs.where(F.col("doc_id").isNotNull()).mapInArrow(run, docs.schema)
