"""Periodic runs of words by a harmonic grid of longest common extensions.

A run is a stretch of consecutive words with smallest period q (words q apart are equal) of at least
max(`least`, 2 * q) words that no neighbouring word extends. For each period p the grid takes the places jp
and (j + 1)p and asks how far the words from them on agree (forward) and how far the words before them do
(backward). Where both together reach p there is a stretch of period p from jp - backward to (j + 1)p +
forward; each stretch of at least 2p words holds such a pair of places. A stretch that comes up for several
periods has the smallest of them. Extensions are range minima over the longest common prefixes of
neighbours in a suffix array: that of the words and that of the reversed words.

Most texts have no run. All words of a run lie in windows of ceil(least / 2) words that the text holds twice:
of L words of period q, the first L - q come again q later, and these are at least that many. So the arrays
are built over stretches of such words alone, all those of a batch of texts at a time; others hold no run.
Words are compared by 64-bit hashes.

Nulls: a null text has no words, no runs and an empty collapsed text; null keys stay null. Texts are taken
whole; one text's arrays take about 1 kB for each word that it repeats, at most. Repeated rows get equal
results, each its own row; empty tables give none. Columns other than key and text are not read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Hashes, mapped, mixed, raw, spans

#: Least words of a run, and queries of the grid that are answered at a time.
LEAST = 12
QUERIES = 1 << 18
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Extensions:
    """Longest common extensions of any two places of x, by suffix array, prefix lengths and range minima.

    Places whose extension reaches the end of x must differ there: x ends with a value of its own.
    """

    def __init__(self, x: np.ndarray):
        n = len(x)
        rank = np.unique(x, return_inverse=True)[1].astype(np.int64)
        levels, step = [rank], 1
        while n and int(rank.max()) + 1 < n:
            after = np.zeros(n, np.int64)
            after[: n - step] = rank[step:] + 1
            rank = np.unique(rank * (n + 1) + after, return_inverse=True)[1].astype(np.int64)
            levels.append(rank)
            step *= 2
        order = np.empty(n, np.int64)
        order[rank] = np.arange(n)
        i, j = order[:-1].copy(), order[1:].copy()
        common = np.zeros(max(n - 1, 0), np.int32)
        for level in range(len(levels) - 2, -1, -1):
            more = (levels[level][i] == levels[level][j]).astype(np.int64) << level
            common += more.astype(np.int32)
            i += more
            j += more
        self.rank, self.least, width = rank.astype(np.int32), [common], 1
        while 2 * width <= len(common):
            last = self.least[-1]
            self.least.append(np.minimum(last[:-width], last[width:]))
            width *= 2
        # all widths in one array, so that queries of any widths are answered at once
        self.starts = np.concatenate([[0], np.cumsum([len(t) for t in self.least])[:-1]]).astype(np.int64)
        self.least = np.concatenate(self.least)

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = self.rank[i], self.rank[j]
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((high - low).astype(np.float64))[1] - 1  # of the widest power of two that fits
        at = self.starts[level]
        return np.minimum(self.least[at + low], self.least[at + high - (1 << level)])


def repeated(words: np.ndarray, offsets: np.ndarray, size: int) -> np.ndarray:
    """Which words lie in a window of `size` words that its row holds at least twice."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(len(words), bool)
    window = words[:n].copy()
    for k in range(1, size):
        window = window * _STEP + words[k : k + n]
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n]
    at = np.flatnonzero(np.arange(size, n + size) <= offsets[row + 1])
    key = mixed(window[at] + row[at].astype(np.uint64) * (_STEP ^ np.uint64(0x5555)))
    order = np.argsort(key)
    key = key[order]
    same = key[1:] == key[:-1]
    twice = at[order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]]
    edge = np.zeros(len(words) + 1, np.int64)
    edge[twice] += 1
    edge[twice + size] -= 1
    return np.cumsum(edge[:-1]) > 0


def stretches(words: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, starts, ends) of the stretches of at least `least` words that may hold runs."""
    size = -(-least // 2)
    row, start, end = np.arange(len(offsets) - 1), offsets[:-1].astype(np.int64), offsets[1:].astype(np.int64)
    for _ in range(2):  # the second time, windows must come twice within their stretch
        place = np.repeat(start, end - start) + _within(end - start)
        inner = np.concatenate([[0], np.cumsum(end - start)])
        mask = repeated(words[place], inner, size)
        edge = np.zeros(len(mask) + 1, bool)
        edge[inner] = True
        first = np.flatnonzero(mask & (edge[:-1] | ~np.concatenate([[False], mask[:-1]])))
        last = np.flatnonzero(mask & (edge[1:] | ~np.concatenate([mask[1:], [False]]))) + 1
        long = last - first >= least
        first, last = first[long], last[long]
        owner = np.searchsorted(inner, first, side="right") - 1
        shift = (start - inner[:-1])[owner]
        row, start, end = row[owner], first + shift, last + shift
    return row, start, end


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... within each of the sizes."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - sizes, sizes)


def grid(words: np.ndarray, start: np.ndarray, end: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, periods) of the runs of the stretches, as places of `words`, by start, then end."""
    none = np.zeros(0, np.int64)
    if not len(start):
        return none, none, none
    sizes = end - start
    base = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]  # each stretch ends with a value of its own
    ids = np.unique(words[np.repeat(start, sizes) + _within(sizes)], return_inverse=True)[1]
    total = int((sizes + 1).sum())
    x = np.empty(total, np.int64)
    ends = base + sizes
    x[ends] = len(ids) + np.arange(len(ends))
    inside = np.ones(total, bool)
    inside[ends] = False
    x[inside] = ids
    forward = Extensions(x)
    # reversed, the values that end stretches come before them; the last place gets another one
    backward = Extensions(np.concatenate([x[::-1], [-1]]))
    owner = np.repeat(np.arange(len(sizes)), sizes // 2)
    period = _within(sizes // 2) + 1
    pairs = (sizes[owner] - 1) // period
    upto, at = np.cumsum(pairs), 0
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while at < len(pairs):
        done = int(upto[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(upto, done + QUERIES, side="right")))
        p = np.repeat(period[at:to], pairs[at:to])
        s = np.repeat(owner[at:to], pairs[at:to])
        i = base[s] + _within(pairs[at:to]) * p
        k = i + p
        on = forward(i, k).astype(np.int64)
        back = backward(total - i, total - k).astype(np.int64)
        hit = (on + back >= p) & (on + back + p >= least)
        shift = (start - base)[s[hit]]
        found.append((i[hit] - back[hit] + shift, k[hit] + on[hit] + shift, p[hit]))
        at = to
    s, e, p = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((p, e, s))
    s, e, p = s[order], e[order], p[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (e[1:] != e[:-1])
    return s[new], e[new], p[new]


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray, rows: int) -> pa.Array:
    """For each row its words joined by one space."""
    sizes = ends - starts
    last = np.ones(len(row), bool)
    last[:-1] = row[1:] != row[:-1]
    width = sizes + ~last
    out = data[np.minimum(np.repeat(starts, width) + _within(width), max(len(data) - 1, 0))] if len(row) else np.zeros(0, np.uint8)
    out[(np.cumsum(width) - 1)[~last]] = 0x20
    bytes_of = np.bincount(row, weights=width, minlength=rows).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(bytes_of)]).astype(np.int32)
    return pa.StringArray.from_buffers(rows, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(out)))


def runs_of(column: pa.Array, least: int = LEAST) -> list[pa.Array]:
    """n_words, starts, lengths, periods and collapsed of each text."""
    data, offsets = raw(column)
    rows = len(offsets) - 1
    first, last, at = spans(data, offsets)
    words = Hashes(data)(first, last)
    _, start, end = stretches(words, at, least)
    start, end, period = grid(words, start, end, least)
    owner = np.searchsorted(at, start, side="right") - 1
    order = np.lexsort((period, start, owner))
    start, end, period, owner = start[order], end[order], period[order], owner[order]
    cut = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=rows))]).astype(np.int32)
    drop = np.zeros(len(words) + 1, np.int64)
    np.add.at(drop, start + period, 1)
    np.add.at(drop, end, -1)
    kept = np.cumsum(drop[:-1]) == 0
    row = np.repeat(np.arange(rows), np.diff(at))[kept]
    lists = [pa.ListArray.from_arrays(pa.array(cut), pa.array(v.astype(np.int64))) for v in (start - at[owner], end - start, period)]
    return [pa.array(np.diff(at).astype(np.int64)), *lists, _joined(data, first[kept], last[kept], row, rows)]


def find_runs(docs: DataFrame, *, key: str = "doc_id", least: int = LEAST, prepare: Callable[[pa.RecordBatch], pa.Array] | None = None,
        more: dict[str, Column] | None = None) -> DataFrame:
    """(key, n_words, starts, lengths, periods, collapsed): the runs by start, then period, and the words
    left, joined by one space, where each run keeps its first period.

    `prepare` makes the texts from a batch of key, text and the columns of `more`.
    """
    kind = docs.schema[key].dataType.simpleString()

    def found(part: pa.RecordBatch) -> list:
        return [part.column(key), *runs_of(prepare(part) if prepare else part.column("text"), least)]

    read = docs.select(key, "text", *[c.alias(name) for name, c in (more or {}).items()])
    return mapped(read, found, f"{key} {kind}, n_words bigint, starts array<bigint>, lengths array<bigint>, periods array<bigint>, collapsed string")


def repeat_tails(part: pa.RecordBatch) -> pa.Array:
    """The texts of a batch; where _crc (unsigned, of the key) is a multiple of 10, the words from one on
    that it chooses go round in a period that it chooses."""
    text, crc = part.column("text"), part.column("_crc").to_numpy(zero_copy_only=False)
    chosen, out = crc % 10 == 0, []  # a null one is NaN here, which is not 0
    for value, h in zip(text.filter(pa.array(chosen)).to_pylist(), crc[chosen].tolist()):
        words, g = (value or "").encode("utf-8").split(), int(h) // 10
        if n := len(words):
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words[a:] = (words[a : a + p] * (-(-(n - a) // p)))[: n - a]
        out.append(b" ".join(words).decode("utf-8"))
    return pc.replace_with_mask(text, pa.array(chosen), pa.array(out, text.type))


def run_digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Number of runs, the longest (smallest start, then period, of equals), and digests of runs and text."""
    at = lambda name, i: F.get(F.col(name), i)
    best = F.array_min(F.transform("starts", lambda s, i: F.struct((-at("lengths", i)).alias("less"), s.alias("start"), at("periods", i).alias("period"))))
    lines = F.transform("starts", lambda s, i: F.concat(F.concat_ws(",", s.cast("string"), at("lengths", i).cast("string"), at("periods", i).cast("string")), F.lit("\n")))
    out = found.select(key, F.size("starts").cast("bigint").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length = -F.col("best.less")
    return out.select(key, "n_runs", F.col("best.start").alias("start"), length.alias("length"), F.col("best.period").alias("period"),
        F.floor(length * 1000 / F.col("best.period")).cast("bigint").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
