"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A document's features are the hashes of its lower-cased words, their stems (the first 4 to 8
bytes), its word pairs, and the pairs that skip one word, each counted once. Training follows
each coordinate at its own rate and keeps a weight at 0 until its gradients sum to more than the
L1 strength, so that few weights remain; those are broadcast. Scoring hashes whole texts with
array operations and looks the hashes up among the kept weights.

Nulls and empty texts have the bias as their only feature. Without labelled rows of both kinds
every score is the share of label 1 (0 without any). Repeated rows are scored alike; a text
that is repeated in the labelled rows counts as often as it is labelled. Long texts are whole.
Empty tables give no rows. Extra columns are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import Hashes, labelled, mapped, mixed, raw, spans, texts

#: Labelled rows of each label that training takes, about (chosen by a hash of the id).
SAMPLE_ROWS = 8000
#: Buckets of the hash.
BUCKETS = 1 << 22
STEMS = (4, 5, 6, 7, 8)
#: The L1 strength for the root of the rows of the rarer label, and the most that it may be.
L1_SLOPE, MOST_L1 = 0.55, 10.0
#: Characters that belong to no word: ASCII but letters and digits.
GAPS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


class Weights(NamedTuple):
    """Kept coordinates in rising order, their weights, and the bias."""

    at: np.ndarray
    weight: np.ndarray
    bias: float


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(coordinates, rows) of all features of a run of texts, with repeats."""
    lower = pa.array([(t or "").lower() for t in column.to_pylist()], pa.large_string())
    data, offsets = raw(lower)
    starts, ends, edge = spans(data, offsets, GAPS)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(edge))
    hashes = Hashes(data)
    word = hashes(starts, ends)
    codes, rows = [word], [row]
    for k in STEMS:
        longer = np.flatnonzero(ends - starts > k)
        codes.append(mixed(hashes(starts[longer], starts[longer] + k) + np.uint64(k)))
        rows.append(row[longer])
    for k in (1, 2):
        same = np.flatnonzero(row[:-k] == row[k:]) if len(row) > k else np.zeros(0, np.int64)
        codes.append(mixed(word[same] * np.uint64(2 * k + 1) + word[same + k]))
        rows.append(row[same])
    return (np.concatenate(codes) & np.uint64(BUCKETS - 1)).astype(np.int32), np.concatenate(rows)


def _distinct(at: np.ndarray, rows: np.ndarray, count: int) -> list[np.ndarray]:
    pairs = np.unique(rows.astype(np.int64) * BUCKETS + at)
    return np.split((pairs % BUCKETS).astype(np.int32), np.searchsorted(pairs, np.arange(1, count) * BUCKETS))


class Ftrl:
    """FTRL-proximal with per-coordinate learning rates."""

    def __init__(self, *, alpha: float = 1.0, beta: float = 1.0, l1: float = 10.0, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        strength = np.where(at == BUCKETS, 0.0, self.l1)
        w = (np.sign(z) * strength - z) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)
        return np.where(np.abs(z) <= strength, 0.0, w)

    def learn(self, at: np.ndarray, y: int) -> None:
        at = np.append(at, BUCKETS)
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - y
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] += g * g

    def kept(self) -> Weights:
        found = np.flatnonzero(np.abs(self.z[:BUCKETS]) > self.l1).astype(np.int32)
        w = self.weights(found)
        return Weights(found[w != 0], w[w != 0], float(self.weights(np.array([BUCKETS]))[0]))


def train(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", rows_each: int = SAMPLE_ROWS, epochs: int = 5) -> Weights:
    """Weights from the labelled documents, at most about rows_each of each label.

    The sample, bounded in rows and in bytes, meets in one task, sorted by a hash of the id; only the
    kept weights (index, weight) come to the driver.
    """
    sample = labelled(docs, labels, label, limit=rows_each)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[np.ndarray] = []
        marks: list[int] = []
        ids: list[int] = []
        for part in texts(batches):
            rows += _distinct(*features(part.column("text")), part.num_rows)
            marks += part.column("y").to_pylist()
            ids += part.column("doc_id").to_pylist()
        y = np.array(marks)
        share = float(np.mean(y)) if len(y) else 0.0
        # the noise that L1 must hold down grows with the root of the rows of the rarer label
        model = Ftrl(l1=min(MOST_L1, L1_SLOPE * np.sqrt(len(y) * min(share, 1 - share))))
        if 0 < share < 1:
            order = np.lexsort((y, mixed(np.array(ids, np.int64).view(np.uint64))))
            for _ in range(epochs):
                for i in order:
                    model.learn(rows[i], marks[i])
            found = model.kept()
        else:
            found = Weights(np.zeros(0, np.int32), np.zeros(0), float(np.log((share + 1e-9) / (1 - share + 1e-9))))
        yield pa.RecordBatch.from_arrays([pa.array([*found.at, BUCKETS], pa.int32()), pa.array([*found.weight, found.bias], pa.float64())], ["at", "weight"])

    learnt = sample.repartition(1).mapInArrow(fit, "at int, weight double").toArrow()
    at, weight = learnt.column("at").to_numpy(), learnt.column("weight").to_numpy()
    bias = float(weight[at == BUCKETS][0]) if (at == BUCKETS).any() else -20.0
    return Weights(at[at < BUCKETS], weight[at < BUCKETS], bias)


def scores(column: pa.Array, weights: Weights) -> np.ndarray:
    """Probabilities that the texts carry label 1."""
    at, rows = features(column)
    table = np.zeros(BUCKETS >> 3, np.uint8)
    np.bitwise_or.at(table, weights.at >> 3, np.uint8(1) << (weights.at & 7).astype(np.uint8))
    seen = np.flatnonzero(table[at >> 3] >> (at & 7).astype(np.uint8) & 1)
    pairs = np.unique(rows[seen].astype(np.int64) * BUCKETS + at[seen])
    w = weights.weight[np.searchsorted(weights.at, pairs % BUCKETS)] if len(pairs) else np.zeros(0)
    total = weights.bias + np.bincount(pairs // BUCKETS, w, minlength=len(column))
    return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def score(docs: DataFrame, weights: Weights, *, key: str = "doc_id") -> DataFrame:
    """(key, score) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(weights))

    def scored(part: pa.RecordBatch) -> list:
        return [part.column(key), scores(part.column("text"), Weights(*shared.value))]

    kind = docs.schema[key].dataType.simpleString()
    return mapped(docs.select(key, "text"), scored, f"{key} {kind}, score double")
