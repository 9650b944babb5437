"""Runs of words, near-duplicate vectors and centroids against brute force, hard and empty tables."""

import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from oracle_check import rows_of_query, rows_of_sql
from tidemark.llm import centroids, queries, runs, vectordup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(words, least=12):
    found, n = [], len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                part = words[i : j + q]
                if not any(all(part[x] == part[x + p] for x in range(len(part) - p)) for p in range(1, q)):
                    found.append((i, len(part), q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def planted(doc_id, text):
    words = WORD.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def test_runs_of_random_words():
    rng = random.Random(5)
    texts = ["", None, " ", "a" * 50, " ".join("ab" * 40), " ".join("a" * 30), " ".join("aab" * 9 + "aabaab")]
    for n in range(300):
        parts = []
        for _ in range(rng.randint(1, 4)):
            unit = [rng.choice("abc"[: rng.randint(1, 3)]) for _ in range(rng.randint(1, 9))]
            parts += unit * rng.randint(1, 7) + [rng.choice("abcdef") for _ in range(rng.randint(0, 6))]
        texts.append(" \t"[n % 2].join(parts))
    n_words, starts, lengths, periods, left = (c.to_pylist() for c in runs.runs_of(pa.array(texts)))
    some = 0
    for text, n, s, size, p, rest in zip(texts, n_words, starts, lengths, periods, left):
        words = WORD.findall(text or "")
        want = brute_runs(words)
        some += len(want)
        assert n == len(words) and list(zip(s, size, p)) == want and rest == collapsed(words, want)
    assert some > 300


@pytest.mark.parametrize("least", [2, 5, 20])
def test_runs_of_other_lengths(least):
    rng = random.Random(least)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 60))) for _ in range(100)]
    _, starts, lengths, periods, _ = (c.to_pylist() for c in runs.runs_of(pa.array(texts), least))
    for text, s, n, p in zip(texts, starts, lengths, periods):
        assert list(zip(s, n, p)) == brute_runs(text.split(), least)


def test_extensions():
    rng = np.random.default_rng(3)
    x = np.append(rng.integers(0, 2, 200), 9)
    x[50:90] = x[100:140]
    common, (i, j) = runs.Extensions(x), np.triu_indices(201, 1)
    for a, b, n in zip(i.tolist(), j.tolist(), common(i, j).tolist()):
        want = 0
        while b + want < 201 and x[a + want] == x[b + want]:
            want += 1
        assert n == want


def check_runs(rows, texts):
    for r in rows:
        words = planted(r.doc_id, texts[r.doc_id])
        found = brute_runs(words)
        best = min(found, key=lambda f: (-f[1], f[0], f[2]), default=(None, None, None))
        assert (r.n_runs, r.start, r.length, r.period) == (len(found), *best)
        assert r.exponent_milli == (1000 * r.length // r.period if found else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(words, found).encode()).hexdigest()


def test_runs_query(spark, small):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = queries.op11_periodic_runs(spark, small).collect()
    assert len(rows) == len(docs) and any(r.n_runs for r in rows)
    check_runs([r for r in rows if len(docs[r.doc_id] or "") < 6000], docs)


def test_runs_of_hard_rows(hard, none):
    crc = {"_crc": F.crc32(F.col("doc_id").cast("string").cast("binary"))}
    rows = runs.run_digests(runs.find_runs(hard, prepare=runs.repeat_tails, more=crc)).collect()
    assert len(rows) == hard.count()
    texts = {r.doc_id: r.text for r in hard.collect()}
    check_runs([r for r in rows if r.doc_id is not None and len(texts[r.doc_id] or "") < 5000], texts)
    assert runs.run_digests(runs.find_runs(none)).count() == 0
    again = runs.run_digests(runs.find_runs(hard, prepare=runs.repeat_tails, more=crc)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def unit(rng, size):
    x = rng.standard_normal(size)
    return x / np.linalg.norm(x)


def hard_vectors():
    """Two dense clusters, chains, copies, scaled copies, unusable vectors, other lengths, repeated rows."""
    rng = np.random.default_rng(8)
    out = [(i, unit(rng, 64).tolist(), int(i % 3)) for i in range(150)]
    centre = unit(rng, 64)
    out += [(1000 + i, (centre + rng.standard_normal(64) * 0.012).tolist(), 1) for i in range(260)]
    out += [(2000 + i, (centre + rng.standard_normal(64) * 0.018).tolist(), 2) for i in range(60)]
    x = unit(rng, 64)
    for i in range(30):  # a chain of small turns
        x = x + unit(rng, 64) * 0.15
        x /= np.linalg.norm(x)
        out.append((3000 + i, x.tolist(), 0))
    out += [(4000 + i, out[5][1], 2) for i in range(5)] + [(4100, [v * 7 for v in out[5][1]], 2), (4101, [-v for v in out[5][1]], 2)]
    out += [out[7], out[7], (7, out[9][1], 0), (None, out[9][1], 0), (None, unit(rng, 64).tolist(), 0)]
    out += [(5000, None, 1), (5001, [0.0] * 64, 1), (5002, [float("nan")] + out[0][1][1:], 1), (5003, [None] + out[0][1][1:], 1),
        (5004, [float("inf")] + out[0][1][1:], 1), (5005, centre.tolist(), None), (5006, [], 1), (None, None, None)]
    out += [(6000 + i, [1.0, 2.0, 3.0 + i * 1e-3], 1) for i in range(4)] + [(6100, [1e300, 1e300], 1), (6101, [1e-300, 1e-300], 1)]
    return [(*r, "x", 1) for r in out]


def brute_links(rows, least=0.98):
    good = [i for i, (_, v, label, *_) in enumerate(rows) if label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    near = {i: [] for i in range(len(rows))}
    scaled = {i: np.array(rows[i][1]) / np.abs(rows[i][1]).max() for i in good}
    scaled = {i: v / np.linalg.norm(v) for i, v in scaled.items()}
    for a in good:
        for b in good:
            if a != b and rows[a][2] == rows[b][2] and len(scaled[a]) == len(scaled[b]) and scaled[a] @ scaled[b] >= least:
                near[a].append(b)
    out, seen = [], {}
    for i in near:
        if i not in seen:
            part, queue = {i}, [i]
            while queue:
                more = [j for j in near[queue.pop()] if j not in part]
                part |= set(more)
                queue += more
            ids = [rows[j][0] for j in part if rows[j][0] is not None]
            seen |= dict.fromkeys(part, min(ids, default=None))
        out.append((rows[i][0], len(near[i]), seen[i], seen[i] == rows[i][0]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [512, 40])
def test_linked_vectors(spark, block, monkeypatch):
    monkeypatch.setattr(vectordup, "BLOCK", block)
    rows = hard_vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, node string, n_links int").repartition(3)
    got = sorted((tuple(r) for r in vectordup.linked_vectors(df).collect()), key=repr)
    want = brute_links(rows)
    assert max(r[1] for r in want) > 200
    assert got == want
    assert vectordup.linked_vectors(df.limit(0)).count() == 0


def test_agreement_and_shape():
    rng = np.random.default_rng(4)
    for d in (0.2, 1.0, math.sqrt(2)):
        a, b = rng.standard_normal(400_000) * d, rng.uniform(0, vectordup.WIDTH, 400_000)
        assert np.mean(np.floor((a + b) / vectordup.WIDTH) == 0) == pytest.approx(vectordup.agreement(d), abs=0.004)
    small, large = vectordup.shape(1000, 0.98), vectordup.shape(10**9, 0.98)
    assert small[0] < large[0] and small[1] < large[1] < 8 * small[1]


def brute_clusters(rows, k=8, rounds=10, size=64):
    kept = [(i, v) for i, v, *_ in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    kept = [(i, [math.floor(Fraction(x) * 1024) for x in v]) for i, v in kept]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centres = [v for _, v in order[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for last in range(rounds + 1):
        at = [min((far(v, c), n) for n, c in enumerate(centres)) for _, v in kept]
        if last < rounds:
            for n in range(len(centres)):
                own = [v for (_, v), (_, m) in zip(kept, at) if m == n]
                if own:
                    centres[n] = [sum(column) // len(own) for column in zip(*own)]
    spread = [sum(d for d, m in at if m == n) for n in range(len(centres))]
    fits = lambda v: v if v < 1 << 63 else None
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, m, fits(d), fits(spread[m]), fits(sum(spread)), names[m]) for (i, _), (d, m) in zip(kept, at)), key=repr)


@pytest.mark.parametrize("times", [1, 2.0**20, 2.0**33, 2.0**80])
def test_centroids(spark, times):
    rng = np.random.default_rng(2)
    rows = [(i, (unit(rng, 64) * times * (1 + i % 4)).tolist()) for i in range(60)]
    rows += [rows[0], rows[0], (None, rows[1][1]), (90, None), (91, [1.0] * 63), (92, [None] * 64), (93, [float("nan")] * 64), (94, [0.0] * 64)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, cluster string, distance int").repartition(3)
    got = sorted((tuple(r) for r in centroids.cluster(df).drop("centroid").collect()), key=repr)
    assert got == brute_clusters(rows)
    assert centroids.cluster(df.limit(0)).count() == 0


def test_few_vectors(spark):
    rows = [(i, [float(i)] * 64) for i in range(3)]
    got = centroids.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).drop("centroid").collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_clusters(rows)


@pytest.mark.parametrize("name", ["op12_pstable_vectors", "op13_centroids"])
def test_vector_queries(spark, small, name):
    assert rows_of_query(queries.QUERIES[name](spark, small)) == rows_of_sql(queries.ORACLE[name], small)
