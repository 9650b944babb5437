"""Language identification by bit-sliced Bloom filters over character n-grams.

Training counts the n-grams of letters in each language and puts an n-gram into the filter of
every language in which it is frequent. The filters of all languages share their positions: the
filter is one array of language masks, so that the AND of the masks at an n-gram's positions
gives all languages that contain it at once. A text's n-grams are looked up, the hits of each
language are counted, the hits that a filter of its fill gives by chance are taken off, and the
language with the most hits decides.

Nulls and texts without a letter are `und` with score 0. Ties go to the language that sorts
first. Without labelled rows every text is `und`. Repeated rows and extra columns do not matter.
Very long texts are counted whole, in slices.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import filtered, mapped, mixed, written

#: Labelled documents of each language that training takes, about (chosen by a hash of the id).
SAMPLE_DOCS = 4000
#: Lengths of n-grams in characters; a word's end and start count as a character.
NGRAMS = (2, 3, 4)
#: An n-gram belongs to a language in which its share of n-grams of its length is at least this
#: (so a language has at most 1/LEAST of each length),
LEAST = 2e-5
#: and not under this part of its share in the language that has the most.
CONTRAST = 0.2
#: Bits for each n-gram and language, and positions of each n-gram.
BITS, PROBES = 10, 3
#: Bytes of text that are held as arrays at a time: an n-gram takes about 50 bytes on its way.
RUN_BYTES = 1 << 18
_GAP = 0x20


class Filters(NamedTuple):
    """languages in order; masks: positions x ceil(languages / 64) words; fills: set bits of each."""

    languages: list[str]
    masks: np.ndarray
    chance: np.ndarray


def _letters() -> np.ndarray:
    import sys

    codes = np.zeros(sys.maxunicode + 1, bool)
    codes[[c for c in range(sys.maxunicode + 1) if chr(c).isalpha()]] = True
    return codes


def _codes(texts: list[str | None], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of all texts, everything but letters as one gap, and each text's
    offsets; every text begins and ends with a gap."""
    joined = "".join([" " + (t or "").lower() + " " for t in texts])
    points = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    sizes = np.array([len((t or "").lower()) + 2 for t in texts], np.int64)
    row = np.repeat(np.arange(len(texts)), sizes)
    is_letter = letters[points]
    edge = np.concatenate([[0], np.cumsum(sizes)])
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # the gap behind a word
    keep[edge[:-1]] = True
    points, row = np.where(is_letter, points, _GAP)[keep], row[keep]
    return points, np.searchsorted(row, np.arange(len(texts) + 1))


def _ngrams(points: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams that hold a letter and do not cross a word's or text's end; offsets."""
    if len(points) < n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    count = len(points) - n + 1
    wide = points.astype(np.uint64)
    code, inner = np.zeros(count, np.uint64), np.ones(count, bool)
    for k in range(n):
        code = code * np.uint64(1_114_112) + wide[k : k + count] if n < 4 else mixed(code) + wide[k : k + count]
        if 0 < k < n - 1:
            inner &= points[k : k + count] != _GAP
    inner &= (points[:count] != _GAP) | (points[n - 1 :] != _GAP)
    starts = np.flatnonzero(inner)
    edges = np.zeros(len(points) + 1, bool)
    edges[offsets[1:-1]] = True
    crossing = np.zeros(count, bool)
    for k in range(1, n):
        crossing |= edges[k : k + count]
    starts = starts[~crossing[starts]]
    return mixed(code[starts] * np.uint64(8) + np.uint64(n)), np.searchsorted(starts, offsets)


def _pieces(texts: list[str | None], limit: int = RUN_BYTES) -> tuple[list[str], np.ndarray]:
    """Texts cut at `limit` characters, which loses no n-gram inside a word, and each piece's row."""
    out, rows = [], []
    for i, t in enumerate(texts):
        t = t or ""
        at = 0
        while at == 0 or at < len(t):
            to = at + limit
            if to < len(t):
                cut = max(t.rfind(" ", at + 1, to), t.rfind("\n", at + 1, to))
                to = cut if cut > at else to
            out.append(t[at:to])
            rows.append(i)
            at = to
    return out, np.array(rows, np.int64)


def ngram_counts(known: DataFrame) -> DataFrame:
    """(lang, n, code, hits): each language's n-grams, added up first in each run of rows."""
    letters = _letters()

    def counted(part: pa.RecordBatch) -> list:
        langs = np.array(part.column("lang").to_pylist(), object)
        texts = part.column("text").to_pylist()
        rows: list[tuple] = []
        for lang in sorted(set(langs)):
            mine, _ = _pieces([texts[i] for i in np.flatnonzero(langs == lang)])
            points, offsets = _codes(mine, letters)
            for n in NGRAMS:
                codes, counts = np.unique(_ngrams(points, offsets, n)[0], return_counts=True)
                rows.append((np.full(len(codes), lang, object), np.full(len(codes), n), codes.view(np.int64), counts))
        return [np.concatenate(c) for c in zip(*rows, strict=True)]

    partial = mapped(known, counted, "lang string, n int, code bigint, hits bigint")
    return partial.groupBy("lang", "n", "code").agg(F.sum("hits").alias("hits"))


def train(known: DataFrame, *, docs_each: int = SAMPLE_DOCS) -> Filters:
    """Filters from (doc_id, text, lang); rows without text or lang teach nothing. The driver holds at
    most 1 / LEAST n-grams of each length and language."""
    known = known.select("doc_id", "text", "lang").where("lang is not null and text is not null")
    sizes = written(known.groupBy("lang").agg(F.count("*").alias("_n")), "langid-sizes")
    if not sizes.head(1):
        return Filters([], np.zeros((1, 1), np.uint64), np.zeros(0))
    chance = F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(1 << 20)) / float(1 << 20)
    known = known.join(sizes, "lang").where(chance < docs_each / F.col("_n"))
    counts = written(ngram_counts(known.select("lang", "text")), "langid-ngrams")
    totals = counts.groupBy("lang", "n").agg(F.sum("hits").alias("all"))
    shares = counts.join(F.broadcast(totals), ["lang", "n"]).select("lang", "n", "code", (F.col("hits") / F.col("all")).alias("share"))
    best = shares.groupBy("n", "code").agg(F.max("share").alias("best"))
    found = shares.where(F.col("share") >= LEAST).join(best, ["n", "code"]).where(F.col("share") >= CONTRAST * F.col("best"))
    return build(found.select("lang", "code").toArrow())


def build(found: pa.Table) -> Filters:
    """Filters from the (lang, code) pairs that languages contain."""
    languages = sorted(set(found.column("lang").to_pylist()))
    of = found.column("lang").to_numpy(zero_copy_only=False)
    codes = found.column("code").to_numpy().view(np.uint64)
    most = max([np.sum(of == k) for k in languages], default=1)
    size = 1 << int(max(64, BITS * most) - 1).bit_length()
    masks = np.zeros((size, -(-max(1, len(languages)) // 64)), np.uint64)
    chance = np.zeros(len(languages))
    for i, lang in enumerate(languages):
        word, bit = i // 64, np.uint64(1 << i % 64)
        for at in _probes(codes[of == lang], size):
            masks[at, word] |= bit
        chance[i] = np.mean((masks[:, word] & bit) != 0) ** PROBES
    return Filters(languages, masks, chance)


def _probes(codes: np.ndarray, size: int) -> list[np.ndarray]:
    step = (codes >> np.uint64(32)) | np.uint64(1)
    return [((codes + np.uint64(k) * step) & np.uint64(size - 1)).astype(np.int64) for k in range(PROBES)]


def hits(filters: Filters, texts: list[str | None], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams of each text, hits of each text and language less those expected by chance)."""
    pieces, rows = _pieces(texts)
    points, offsets = _codes(pieces, letters)
    total, found = np.zeros(len(texts), np.int64), np.zeros((len(texts), len(filters.languages)))
    for n in NGRAMS:
        codes, at = _ngrams(points, offsets, n)
        np.add.at(total, rows, np.diff(at))
        first, *others = _probes(codes, len(filters.masks))
        for word in range(filters.masks.shape[1]):
            column = filters.masks[:, word]
            held = column[first]
            for more in others:
                held &= column[more]
            for i in range(word * 64, min(len(filters.languages), word * 64 + 64)):
                sums = np.concatenate([[0], np.cumsum((held >> np.uint64(i % 64)) & np.uint64(1))]).astype(np.int64)
                np.add.at(found[:, i], rows, sums[at[1:]] - sums[at[:-1]])
    expected = total[:, None] * filters.chance
    return total, np.maximum(0, (found - expected) / np.maximum(1e-9, 1 - filters.chance))


def predict(docs: DataFrame, filters: Filters, *, key: str = "doc_id", unknown: str = "und") -> DataFrame:
    """(key, lang_pred, score): the score is the winner's part of all languages' hits, times the
    part of the text's n-grams that it knows, to the power of a quarter."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(filters))
    held: list[np.ndarray] = []

    def predicted(part: pa.RecordBatch) -> list:
        if not held:
            held.append(_letters())
        own = Filters(*shared.value)
        total, found = hits(own, part.column("text").to_pylist(), held[0])
        names = np.array([*own.languages, unknown], object)
        if not own.languages:
            return [part.column(key), [unknown] * len(total), np.zeros(len(total))]
        best = np.argmax(found, axis=1)
        most = found[np.arange(len(best)), best]
        known = total > 0
        score = np.where(known, most / np.maximum(found.sum(axis=1), 1e-9) * np.minimum(1, most / np.maximum(total, 1)) ** 0.25, 0.0)
        return [part.column(key), names[np.where(known, best, len(names) - 1)], score]

    kind = docs.schema[key].dataType.simpleString()
    return mapped(docs.select(key, "text"), predicted, f"{key} {kind}, lang_pred string, score double", limit=RUN_BYTES)


def accepted(docs: DataFrame, filters: Filters, *, least: float = 0.0) -> DataFrame:
    """The documents with a language: text with letters, of whose n-grams the predicted language
    knows at least the part `least`."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(filters))
    held: list[np.ndarray] = []

    def keep(part: pa.RecordBatch) -> np.ndarray:
        if not held:
            held.append(_letters())
        total, found = hits(Filters(*shared.value), part.column("text").to_pylist(), held[0])
        return (total > 0) & (found.max(axis=1, initial=0) >= least * total)

    return filtered(docs, keep, limit=RUN_BYTES)
