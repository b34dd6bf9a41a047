"""Hashed text features and the small models fitted on them.

A model is fitted on the driver from a bounded sample of labelled documents (``SAMPLE`` rows, whatever the size
of the input); scoring runs where the documents are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, small_batches, stored
from .text_kernel import BYTE_CODE, BYTE_CODE_FOLDED, buffers, mix, prefix_hash, span_hash, word_spans

#: Labelled documents that a model is fitted on, at most.
SAMPLE = 6000
DIMS = 1 << 16
#: Features that the sample's documents may have in all (8 bytes each on the driver): with very long texts fewer documents are taken.
FEATURES = 50_000_000
#: Bytes by kind: letters of either case, digits and bytes beyond ASCII are merged, marks stay as they are.
_kind = np.arange(256)
_kind[65:91], _kind[97:123], _kind[128:], _kind[48:58] = 65, 97, 97, 48
SHAPE_CODE = BYTE_CODE[_kind]


def word_features(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word four hashed features (the word, the shape of its end, the shapes of its end and the end
    before, whether it repeats one of the two words before), and for each text the number of words before it."""
    start, end, first = word_spans(raw, off)
    if not len(start):
        return np.zeros((0, 4), np.int32), first
    words = span_hash(prefix_hash(BYTE_CODE_FOLDED[raw]), start, end)
    shapes = prefix_hash(SHAPE_CODE[raw])
    tail = span_hash(shapes, np.maximum(start, end - 4), end)
    short = span_hash(shapes, np.maximum(start, end - 2), end)
    before = np.concatenate([short[:1], short[:-1]])
    again = (words == np.concatenate([words[-1:], words[:-1]])).astype(np.uint64) + 2 * (words == np.concatenate([words[-2:], words[:-2]])[: len(words)]).astype(np.uint64)
    out = np.stack([words, mix(tail + np.uint64(1)), mix(short * np.uint64(3) + before * np.uint64(5)), mix(again + np.uint64(0x5EED))], axis=1)
    return (out % np.uint64(DIMS)).astype(np.int32), first


def scores(raw: np.ndarray, off: np.ndarray, weights: np.ndarray, power: float) -> np.ndarray:
    """weights: (DIMS, outputs). For each text the sum over its words' features, divided by words**power."""
    idx, first = word_features(raw, off)
    n = np.diff(first)
    out = np.zeros((len(n), weights.shape[1]))
    for k in range(weights.shape[1]):
        by_word = np.concatenate([[0.0], np.cumsum(weights[:, k][idx].sum(axis=1))])
        out[:, k] = (by_word[first[1:]] - by_word[first[:-1]]) / np.maximum(n, 1) ** power
    return out


def scores_of_present(raw: np.ndarray, off: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """weights: (DIMS, outputs). For each text the sum over its distinct features, however often they occur."""
    idx, first = word_features(raw, off)
    live = (weights != 0).any(axis=1)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    heavy = live[idx]
    found = np.unique((doc[:, None] * DIMS + idx)[heavy])
    doc, feature = found // DIMS, found % DIMS
    return np.stack([np.bincount(doc, weights=weights[feature, k], minlength=len(off) - 1) for k in range(weights.shape[1])], axis=1)


@dataclass
class Sample:
    """Rows of hashed features: feature ``idx[j]`` with ``value[j]`` for at[i] <= j < at[i + 1]; and the labels."""

    idx: np.ndarray
    value: np.ndarray
    at: np.ndarray
    label: np.ndarray
    doc_id: np.ndarray

    def times(self, w: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(w[self.idx] * self.value)])
        return total[self.at[1:]] - total[self.at[:-1]]

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.idx, weights=np.repeat(g, np.diff(self.at)) * self.value, minlength=DIMS)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: Column, power: float, limit: int = SAMPLE) -> Sample:
    """The features of at most ``limit`` labelled documents, and of at most as many as have FEATURES in all: those with the smallest
    hashes of their ids, so from all parts of the input. Labels or ids that are null don't count; of repeated ids any one row may."""
    some = labels.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), label.cast("int").alias("label")).where("label is not null")
    some = some.orderBy(F.xxhash64("doc_id"), "label").limit(limit).dropDuplicates(["doc_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            idx, first = word_features(*buffers(batch.column(1)))
            rows_i, rows_v, rows_n = [], [], []
            for a, b in zip(first[:-1], first[1:], strict=True):
                some_idx, n = np.unique(idx[a:b].ravel(), return_counts=True)
                rows_i.append(some_idx.astype("<i4").tobytes())
                rows_v.append((n / max(1, b - a) ** power).astype("<f4").tobytes())
                rows_n.append(len(some_idx))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(rows_n, pa.int64()), pa.array(rows_i, pa.binary()), pa.array(rows_v, pa.binary())], ["doc_id", "label", "n", "idx", "value"])

    small_batches(docs.sparkSession)
    joined = documents(docs).join(F.broadcast(some), "doc_id").select("doc_id", "text", "label")  # at most ``limit`` rows of 12 bytes
    held = stored(joined.mapInArrow(run, "doc_id long, label int, n long, idx binary, value binary").withColumn("turn", F.xxhash64("doc_id")), "sample")
    running, last = 0, None
    for turn, n in sorted((r.turn, r.n) for r in held.select("turn", "n").collect()):  # at most ``limit`` rows (and repeated ones)
        running += n
        if running > FEATURES:
            break
        last = turn
    rows = held.where(F.col("turn") <= F.lit(last)).toArrow().sort_by("doc_id")
    idx = [np.frombuffer(x.as_buffer(), "<i4") for x in rows["idx"]]
    value = [np.frombuffer(x.as_buffer(), "<f4") for x in rows["value"]]
    at = np.concatenate([[0], np.cumsum([len(x) for x in idx])]).astype(np.int64)
    none = np.zeros(0)
    return Sample(np.concatenate(idx) if idx else none.astype(np.int32), np.concatenate(value) if value else none, at, np.array(rows["label"].to_pylist(), np.int64), np.array(rows["doc_id"].to_pylist(), np.int64))


def descend(gradient, start: np.ndarray, steps: int, rate: float) -> np.ndarray:  # noqa: ANN001
    """Adam from ``start``; gradient: a function of the parameters."""
    x, m, v = start.astype(float), np.zeros_like(start, float), np.zeros_like(start, float)
    for t in range(1, steps + 1):
        g = gradient(x)
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        x = x - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return x


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))
