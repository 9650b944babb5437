"""Quality by histogram gradient-boosted trees over document statistics.

Statistics of whole texts are binned by quantiles; trees grow leaf by leaf from histograms of
gradients and curvatures, the sibling's histogram being the parent's less the other child's; the
forest is flattened into arrays and scored by stepping all documents down all trees at once.

Nulls and empty texts have statistics of 0 and get a score like any other. Without labelled rows
of both kinds every score is the share of label 1 (0.5 without any). Repeated rows are scored
alike. Long texts are whole. Empty tables give no rows. Extra columns are left out by `score` and kept
by `accepted`, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import filtered, labelled, mapped

#: Labelled rows of each label that training takes, about (chosen by a hash of the id).
SAMPLE_ROWS = 8000
SYMBOLS = "#*$%&|<>"
STATISTICS = ["words", "letters_a_word", "symbols_a_word", "bars_a_word", "shouts_a_word", "capitals", "digits", "beyond_ascii",
    "stops_a_word", "commas_a_word", "lines", "words_a_line", "repeated_lines", "distinct_words", "commonest_word", "repeated_threes",
    "short_words", "long_words", "letters", "links"]
_CAPITAL = re.compile("[A-ZÀ-ÖØ-Þ]")
_DIGIT = re.compile("[0-9]")


def statistics(text: str | None) -> list[float]:
    """STATISTICS of one text; counts as logarithms, the others as ratios."""
    text = text or ""
    words = text.split()
    n, size = max(1, len(words)), max(1, len(text))
    lines = [line for line in text.split("\n") if line.strip()]
    counts = Counter(words)
    lengths = np.array([len(w) for w in words] or [0])
    threes = Counter(zip(words, words[1:], words[2:]))
    spaces = len(text) - int(lengths.sum())
    symbols = sum(map(text.count, SYMBOLS))
    stops, commas, shouts, digits = text.count("."), text.count(","), text.count("!"), len(_DIGIT.findall(text))
    return [
        np.log1p(len(words)), lengths.mean(), symbols / n, text.count("|") / n, shouts / n, len(_CAPITAL.findall(text)) / size,
        digits / size, (len(text.encode("utf-8", "replace")) - len(text)) / size,
        stops / n, commas / n, np.log1p(len(lines)), n / max(1, len(lines)), 1 - len(set(lines)) / max(1, len(lines)), len(counts) / n,
        max(counts.values(), default=0) / n,
        sum(c for c in threes.values() if c > 1) / n, float((lengths <= 2).mean()), float((lengths >= 12).mean()),
        (len(text) - spaces - symbols - stops - commas - shouts - digits) / size, (text.count("http") + text.count("@")) / n,
    ]


class Forest(NamedTuple):
    """Trees one after another: roots; feature (-1: a leaf), threshold and children of each node; leaf values."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    base: float

    def margins(self, x: np.ndarray) -> np.ndarray:
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            feature = self.feature[at]
            down = np.where(x[rows, np.maximum(feature, 0)] <= self.threshold[at], self.left[at], self.right[at])
            at = np.where(feature < 0, at, down)
        return self.base + self.value[at].sum(axis=1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(x), -30, 30)))


class Node:
    def __init__(self, rows: np.ndarray, hist: np.ndarray, depth: int):
        self.rows, self.hist, self.depth = rows, hist, depth


def grow(x: np.ndarray, y: np.ndarray, *, trees: int = 80, leaves: int = 12, rate: float = 0.15, bins: int = 64, l2: float = 1.0,
        least_rows: int = 5, least_gain: float = 1e-3) -> Forest:
    """A forest for labels y in 0, 1 by second-order boosting of the logistic loss."""
    share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6)) if len(y) else 0.5
    base, count = float(np.log(share / (1 - share))), x.shape[1]
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(count)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(count)], axis=1) if len(x) else np.zeros((0, count), int)
    place = binned + np.arange(count) * bins
    roots, feature, threshold, left, right, value = [], [], [], [], [], []
    deepest, margin = 0, np.full(len(y), base)

    def histogram(rows: np.ndarray) -> np.ndarray:
        at, size = place[rows].ravel(), count * bins
        return np.stack([np.bincount(at, np.repeat(v[rows], count), size) for v in (g, h, ones)]).reshape(3, count, bins)

    def best(node: Node) -> tuple[float, int, int]:
        gl, hl, nl = np.cumsum(node.hist, axis=2)
        gt, ht, nt = gl[:, -1:], hl[:, -1:], nl[:, -1:]
        gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
        gain[(nl < least_rows) | (nt - nl < least_rows)] = -np.inf
        j, b = np.unravel_index(np.argmax(gain), gain.shape)
        return float(gain[j, b]), int(j), int(b)

    def add(f=-1, t=0.0, v=0.0) -> int:
        for column, item in zip((feature, threshold, left, right, value), (f, t, 0, 0, v)):
            column.append(item)
        return len(feature) - 1

    ones = np.ones(len(y))
    for _ in range(trees if 0 < y.mean() < 1 else 0) if len(y) else ():
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        root = Node(np.arange(len(y)), histogram(np.arange(len(y))), 0)
        open_ = [(best(root), add(), root)]
        roots.append(open_[0][1])
        for _ in range(leaves - 1):
            k = max(range(len(open_)), key=lambda i: open_[i][0][0])
            (gain, j, b), at, node = open_[k]
            if gain <= least_gain:
                break
            goes = binned[node.rows, j] <= b
            a, c = node.rows[goes], node.rows[~goes]
            small, other = (a, c) if len(a) <= len(c) else (c, a)
            one = histogram(small)
            hists = (one, node.hist - one) if small is a else (node.hist - one, one)
            feature[at], threshold[at] = j, float(cuts[j][b])
            children = [Node(r, hh, node.depth + 1) for r, hh in zip((a, c), hists)]
            left[at], right[at] = add(), add()
            deepest = max(deepest, node.depth + 1)
            open_[k] = (best(children[0]), left[at], children[0])
            open_.append((best(children[1]), right[at], children[1]))
            del other
        for _, at, node in open_:
            value[at] = -rate * float(node.hist[0, 0].sum() / (node.hist[1, 0].sum() + l2))
            margin[node.rows] += value[at]
    return Forest(np.array(roots, np.int64), np.array(feature, np.int64), np.array(threshold, float), np.array(left, np.int64),
        np.array(right, np.int64), np.array(value, float), deepest, base)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array([statistics(t) for t in column.to_pylist()], float).reshape(-1, len(STATISTICS))


def train(docs: DataFrame, labels: DataFrame, *, label: str = "quality", rows_each: int = SAMPLE_ROWS, **options) -> Forest:
    """A forest from the labelled documents, at most about rows_each of each label: their
    statistics (not their texts) come to the driver."""

    def counted(part: pa.RecordBatch) -> list:
        return [part.column("doc_id"), list(_matrix(part.column("text"))), part.column("y")]

    sample = labelled(docs, labels, label, limit=rows_each).select("doc_id", "text", "y")
    found = mapped(sample, counted, "doc_id bigint, x array<double>, y int").toArrow().sort_by([("doc_id", "ascending")])
    x = np.array(found.column("x").to_pylist(), float).reshape(-1, len(STATISTICS))
    return grow(x, found.column("y").to_numpy().astype(float), **options)


def score(docs: DataFrame, forest: Forest, *, key: str = "doc_id") -> DataFrame:
    """(key, score) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(forest))

    def scored(part: pa.RecordBatch) -> list:
        return [part.column(key), Forest(*shared.value).scores(_matrix(part.column("text")))]

    kind = docs.schema[key].dataType.simpleString()
    return mapped(docs.select(key, "text"), scored, f"{key} {kind}, score double")


def accepted(docs: DataFrame, forest: Forest, *, least: float = 0.5) -> DataFrame:
    """The documents that score at least `least`."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(forest))
    return filtered(docs, lambda part: Forest(*shared.value).scores(_matrix(part.column("text"))) >= least)
