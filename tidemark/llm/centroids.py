"""Centroid clustering (Lloyd's rounds) in exact integers.

Components become the integers floor(scale * x). Squared distances are |x|^2 - 2 x.c + |c|^2, a matrix
product of blocks in float64. With components of at most X and C in size, every partial sum is an integer
of at most size * (X + C)^2; below 2^53 float64 holds all of them exactly, so the order of additions does not
matter. A block beyond that bound is computed by differences in int64 (below 2^62), and beyond that in whole
numbers of any size. Sums of the clusters are whole numbers of any size, combined by treeAggregate; a
round's centroid is the exact floor(sum / count), and an empty cluster keeps its own.

The integers are written once, as blocks of the narrowest type that holds them; each round reads the
blocks and sends `k` sums from each task. Only the k centroids come to the driver.

Nulls: vectors that are null, of another size, or hold a null or non-finite component (also where scale * x
is not finite) are left out; a null id has no hash, so it is among the first centroids only where fewer than k
others are kept. Repeated rows count each. With fewer than k vectors there are as many centroids; an empty table
gives no rows. A distance or sum beyond a long is null. Columns other than key and vector are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import removed, written

#: float64 holds all integers below EXACT; int64 sums stay below WIDE.
EXACT, WIDE = 1 << 53, 1 << 62
MOST = (1 << 63) - 1
#: Vectors of a block.
ROWS = 8192


def usable(vector: Column, size: int, scale: int) -> Column:
    """Vectors of `size` components whose scaled values are all finite numbers."""
    fits = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < float("inf"))
    return F.coalesce((F.size(vector) == size) & F.forall(vector, fits), F.lit(False))


def _matrix(column: pa.Array, size: int, scale: int) -> np.ndarray:
    return np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale).reshape(-1, size)


def _largest(x: np.ndarray) -> int:
    return int(np.abs(x).max()) if x.size else 0


def _whole(x: np.ndarray) -> np.ndarray:
    """x as Python's whole numbers."""
    return np.array([int(v) for v in x.ravel().tolist()], object).reshape(x.shape)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, the smaller of equals; squared distance) of integer rows x."""
    bound = x.shape[1] * (_largest(x) + _largest(centroids)) ** 2
    if bound < EXACT:
        c = centroids.astype(np.float64)
        d = (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)
        at = d.argmin(axis=1)
        return at, d[np.arange(len(x)), at].astype(np.int64)
    x, c = (x.astype(np.int64), centroids.astype(np.int64)) if bound < WIDE else (_whole(x), centroids)
    d = np.stack([((x - row) ** 2).sum(axis=1) for row in c], axis=1)
    at = np.array([min(range(len(c)), key=row.__getitem__) for row in d.tolist()], np.int64)
    return at, d[np.arange(len(x)), at]


def totals(x: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Sums of the rows of each cluster, as whole numbers."""
    if len(x) * _largest(x) < EXACT:
        return _whole((np.arange(k)[:, None] == at).astype(np.float64) @ x)
    x = _whole(x)
    return np.stack([x[at == c].sum(axis=0) if (at == c).any() else np.full(x.shape[1], 0, object) for c in range(k)])


def _blocks(batches: Iterator[pa.RecordBatch], size: int, scale: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for s in range(0, batch.num_rows, ROWS):
            x = _matrix(batch.column(0).slice(s, ROWS), size, scale)
            kind = next((t for t in ("i2", "i4") if _largest(x) <= np.iinfo(t).max), "f8")
            yield pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([x.astype("<" + kind).tobytes()], pa.binary())], ["kind", "data"])


def _open(row, size: int) -> np.ndarray:
    return np.frombuffer(row["data"], "<" + row["kind"]).reshape(-1, size).astype(np.float64)


def train(vectors: DataFrame, first: np.ndarray, rounds: int, size: int, scale: int) -> tuple[np.ndarray, list[int]]:
    """The centroids after the rounds, and the squared distances of the clusters' vectors to them, summed."""
    k = len(first)
    blocks = written(vectors.mapInArrow(lambda batches: _blocks(batches, size, scale), "kind string, data binary"), "vectors")
    empty = (np.full((k, size), 0, object), np.full(k, 0, object), np.full(k, 0, object))

    def gathered(centroids: np.ndarray):
        def add(so_far, row):
            x = _open(row, size)
            at, d = nearest(x, centroids)
            spread = np.array([sum(d[at == c].tolist()) for c in range(k)], object)
            return so_far[0] + totals(x, at, k), so_far[1] + np.bincount(at, minlength=k).astype(object), so_far[2] + spread

        return blocks.rdd.treeAggregate(empty, add, lambda a, b: tuple(x + y for x, y in zip(a, b)), 2)

    centroids = first
    for _ in range(rounds):
        sums, counts, _ = gathered(centroids)
        centroids = np.stack([[s // n for s in row] if n else old for row, n, old in zip(sums, counts, centroids)]).astype(object)
    spread = gathered(centroids)[2].tolist()
    removed(blocks)
    return centroids, spread


def cluster(df: DataFrame, *, k: int = 8, rounds: int = 10, size: int = 64, scale: int = 1024, salt: str = "3", key: str = "vec_id",
        vector: str = "embedding") -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid): each usable vector's cluster, its squared
    distance, the sums of distances over the cluster and over all, and the cluster's centroid.

    First centroids are the k vectors with the smallest SHA-256 of '<salt>:<key>'. k is small: centroids are sent
    to all tasks.
    """
    kept = df.select(F.col(key).alias("key"), F.col(vector).alias("vector")).where(usable(F.col(vector), size, scale))
    order = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("key").cast("string")), 256)
    chosen = kept.orderBy(order.asc_nulls_last(), "vector").limit(k).collect()
    kind = df.schema[key].dataType.simpleString()
    schema = f"key {kind}, cluster int, distance bigint"
    if not chosen:
        centroids, spread = np.zeros((0, size), object), []
    else:
        first = _whole(np.floor(np.array([r.vector for r in chosen], np.float64) * scale))
        centroids, spread = train(kept.select("vector"), first, rounds, size, scale)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, ROWS):
                part = batch.slice(s, ROWS)
                at, d = nearest(_matrix(part.column("vector"), size, scale), centroids)
                d = pa.array([v if v <= MOST else None for v in d.tolist()], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(at.astype(np.int32)), d], ["key", "cluster", "distance"])

    long = lambda v: F.lit(v if v <= MOST else None).cast("bigint")
    of = lambda values: F.get(F.array(*values), F.col("cluster")) if values else F.lit(None)
    names = [",".join(map(str, row)) for row in centroids.tolist()]
    return kept.mapInArrow(placed, schema).select(F.col("key").alias(key), "cluster", "distance",
        of([long(v) for v in spread]).cast("bigint").alias("cluster_inertia"), long(sum(spread)).alias("inertia"),
        of([F.lit(v) for v in names]).cast("string").alias("centroid"),
        of([F.lit(hashlib.sha256(v.encode()).hexdigest()) for v in names]).cast("string").alias("centroid_sha256"))
