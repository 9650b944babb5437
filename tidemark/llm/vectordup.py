"""Near-duplicate vectors by Euclidean p-stable hashing, checked by exact cosines.

Vectors are compared within a label. Equal vectors of a label are made one first, with their number. Of
normalised vectors, cosine c is distance sqrt(2 - 2c). A table's bucket is the list of floor((a.x + b) / width)
for `projections` normal a and uniform b; two vectors at a distance d agree in one of them with probability
p(d) = 1 - 2 Phi(-w/d) - 2d / (w sqrt(2 pi)) * (1 - exp(-w^2 / 2d^2)). Projections are as many as leave a vector
about STRAY unrelated ones in a bucket, from the number of vectors of the largest label; tables are as many
as leave a pair at the least cosine in no common bucket with probability MISS (closer pairs much less).

Buckets of one vector end there. The members of a bucket are dealt to blocks of BLOCK vectors, and each pair
of blocks is a unit of work: a matrix product, so a bucket that holds a third of all rows is many small
tasks. Each vector brings the list of its shared buckets; a pair is counted in the first bucket that both
share and in no other. A unit gives one row for each vector with links, and a spanning forest of its links;
no pair is emitted beyond that. Components come from the forests.

Nulls: vectors of a null label, and vectors that are null, zero or hold null or non-finite components, link with
nothing and are components of their own. Vectors of different lengths do not link. A null id takes part; its
component is null only if all of its ids are. Repeated rows are linked like other equal vectors. Empty
tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Memo, mixed, removed, written
from tidemark.llm.neardup import components

LEAST = 0.98
#: Width of a bucket, probability of a pair at the least cosine to be missed, unrelated vectors of a bucket.
WIDTH, MISS, STRAY = 2.0, 1e-6, 0.05
#: Vectors of a block, about.
BLOCK = 512
SEED = 12


def agreement(distance: float, width: float = WIDTH) -> float:
    """The probability that one quantised projection of two vectors at that distance is equal."""
    r = width / max(distance, 1e-12)
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def shape(vectors: int, least: float) -> tuple[int, int]:
    """(projections, tables) for so many vectors that are compared with each other."""
    near, far = agreement(math.sqrt(max(2 - 2 * least, 0))), agreement(math.sqrt(2))
    k = max(4, math.ceil(math.log(max(vectors, 2) / STRAY) / -math.log(far)))
    return k, max(1, math.ceil(math.log(MISS) / math.log1p(-(near**k)))) if near < 1 else 1


_DRAWN = Memo()


def _projections(size: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    if (size, count) not in _DRAWN:
        rng = np.random.default_rng((SEED, size))
        _DRAWN.clear()
        _DRAWN[size, count] = rng.standard_normal((count, size)).T.copy(), rng.uniform(0, WIDTH, count)
    return _DRAWN[size, count]


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length, normalised in float64; the largest component is taken out first."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def bucket_keys(x: np.ndarray, label: np.ndarray, k: int, tables: int) -> np.ndarray:
    """(rows, tables): 64-bit keys of the buckets of normalised rows."""
    a, b = _projections(x.shape[1], k * tables)
    cells = np.floor((x @ a + b) / WIDTH).astype(np.int64).view(np.uint64).reshape(len(x), tables, k)
    key = np.broadcast_to(mixed(label.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(x.shape[1]))[:, None], cells.shape[:2])
    key = mixed(key + np.arange(1, tables + 1, dtype=np.uint64))
    for i in range(k):
        key = mixed(key * np.uint64(0xD6E8FEB86659FD93) + cells[:, :, i])
    return key.view(np.int64)


def _by_length(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    sizes = batch.column("vector").value_lengths().to_numpy()
    for size in np.unique(sizes):
        part = batch.filter(pa.array(sizes == size))
        for s in range(0, part.num_rows, 4096):
            yield part.slice(s, 4096)


def buckets(nodes: DataFrame, k: int, tables: int) -> DataFrame:
    """(bucket, node): a row for each vector and table."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _by_length(batch):
                key = bucket_keys(matrix(part.column("vector")), part.column("mark").to_numpy(), k, tables)
                node = np.repeat(part.column("node").to_numpy(), tables)
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(node)], ["bucket", "node"])

    return nodes.select("node", "mark", "vector").mapInArrow(keyed, "bucket bigint, node bigint")


def _first_shared(left: list, right: list, bucket: int) -> np.ndarray:
    """Which pairs share no bucket smaller than this one."""
    earlier = lambda rows: {b for row in rows for b in row if b < bucket}
    both = sorted(earlier(left) & earlier(right))
    if not both:
        return np.ones((len(left), len(right)), bool)
    place = {b: i for i, b in enumerate(both)}

    def marks(rows: list) -> np.ndarray:
        out = np.zeros((len(rows), len(both)), np.float32)
        for r, row in enumerate(rows):
            out[r, [place[b] for b in row if b in place]] = 1
        return out

    return marks(left) @ marks(right).T == 0


def _forest(linked: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of the matrix; its rows are the nodes a, its columns b."""
    rows_left, cols_left, out = np.ones(len(a), bool), np.ones(len(b), bool), []
    for first in range(len(a)):
        if not rows_left[first]:
            continue
        queue, rows_left[first] = [first], False
        while queue:
            row = queue.pop()
            cols = np.flatnonzero(linked[row] & cols_left)
            cols_left[cols] = False
            out += [(a[row], b[c]) for c in cols]
            for c in cols:
                rows = np.flatnonzero(linked[:, c] & rows_left)
                rows_left[rows] = False
                out += [(a[r], b[c]) for r in rows]
                queue += rows.tolist()
    found = np.array(out, np.int64).reshape(-1, 2)
    return found[:, 0], found[:, 1]


def _solved(unit: pa.Table, least: float) -> list[tuple[np.ndarray, ...]]:
    """(node, other, links) rows of one pair of blocks: links counted by node, and forest links of 0."""
    side = unit.column("side").to_numpy()
    bucket = unit.column("bucket")[0].as_py()
    x = matrix(unit.column("vector").combine_chunks())
    node, copies = unit.column("node").to_numpy(), unit.column("copies").to_numpy()
    shared = unit.column("shared").to_pylist()
    one, two = np.flatnonzero(side != 1), np.flatnonzero(side != 0)  # side 2: one block with itself
    if len(one) < 2 and (side == 2).all() or not len(one) or not len(two):
        return []
    linked = x[one] @ x[two].T >= least
    if (side == 2).all():
        linked &= ~np.eye(len(one), dtype=bool)
    if not linked.any():
        return []
    linked &= _first_shared([shared[i] for i in one], [shared[i] for i in two], bucket)
    counts = [(node[one], linked @ copies[two])]
    if (side != 2).any():
        counts.append((node[two], copies[one] @ linked))
    out = []
    for who, n in counts:
        some = n > 0
        out.append((who[some], np.full(some.sum(), -1), n[some]))
    a, b = _forest(linked, node[one], node[two])
    keep = a != b
    out.append((a[keep], b[keep], np.zeros(keep.sum(), np.int64)))
    return out


def _pairs(batch: pa.RecordBatch, at: np.ndarray, least: float) -> list[tuple[np.ndarray, ...]]:
    """As _solved, for all units of two rows of a batch at once: those that start at `at`."""
    sizes, near = batch.column("vector").value_lengths().to_numpy(), np.zeros(len(at), bool)
    for size in np.unique(sizes[at]):
        some = np.flatnonzero(sizes[at] == size)
        for s in range(0, len(some), 4096):
            own = some[s : s + 4096]
            x, y = (matrix(batch.column("vector").take(pa.array(at[own] + d))) for d in (0, 1))
            near[own] = np.einsum("ij,ij->i", x, y) >= least
    node, copies, shared, bucket = (batch.column(c) for c in ("node", "copies", "shared", "bucket"))
    first = [s for s in at[near].tolist() if min(set(shared[s].as_py()) & set(shared[s + 1].as_py())) == bucket[s].as_py()]
    if not first:
        return []
    a, first = node.to_numpy(), np.array(first)
    n, none = copies.to_numpy(), np.full(len(first), -1)
    return [(a[first], none, n[first + 1]), (a[first + 1], none, n[first]), (a[first], a[first + 1], np.zeros(len(first), np.int64))]


def _units(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Solves the units of a partition sorted by unit; one unit is held at a time. Most have two rows: those that
    lie in one batch are solved together."""
    names = ["bucket", "i", "j"]
    held: list[pa.RecordBatch] = []

    def solved(rows: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        if rows:
            node, other, n = (np.concatenate(c).astype(np.int64) for c in zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(other, mask=other < 0), pa.array(n)], ["node", "other", "links"])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in names], axis=1)
        edge = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [batch.num_rows]])
        whole = np.zeros(len(edge) - 1, bool)
        whole[1:-1] = np.diff(edge)[1:-1] == 2
        yield from solved(_pairs(batch, edge[:-1][whole], least))
        for s, e in zip(edge[:-1][~whole].tolist(), edge[1:][~whole].tolist()):
            if held and tuple(held[-1].column(c)[0].as_py() for c in names) != tuple(keys[s].tolist()):
                yield from solved(_solved(pa.Table.from_batches(held), least))
                held = []
            held.append(batch.slice(s, e - s))
    if held:
        yield from solved(_solved(pa.Table.from_batches(held), least))


def counted(nodes: DataFrame, crowded: DataFrame, least: float) -> DataFrame:
    """(node, other, links): from the nodes and their shared buckets (node, bucket, n)."""
    lists = crowded.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("at"))
    rows = nodes.select("node", "vector", "copies").join(lists, "node")
    rows = rows.select("node", "vector", "copies", F.col("at.bucket").alias("shared"), F.explode("at").alias("b"))
    blocks = F.ceil(F.col("b.n") / BLOCK).cast("int")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("met", F.explode(F.sequence(F.lit(0), blocks - 1)))
    side = F.when(F.col("own") == F.col("met"), 2).when(F.col("own") < F.col("met"), 0).otherwise(1)
    unit = rows.select(F.col("b.bucket").alias("bucket"), F.least("own", "met").alias("i"), F.greatest("own", "met").alias("j"),
        side.alias("side"), "node", "copies", "vector", "shared")
    key = ["bucket", "i", "j"]
    return unit.repartition(*key).sortWithinPartitions(*key).mapInArrow(lambda batches: _units(batches, least), "node bigint, other bigint, links bigint")


def usable(vector: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def linked_vectors(df: DataFrame, *, least: float = LEAST, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(key, n_links, component_id, kept) of each row: links counts other rows at a cosine of at least
    `least`; component_id is the smallest key reachable over links."""
    compared = F.col("label").isNotNull() & usable(F.col("vector"))
    rows = df.select(F.col(key).alias("key"), F.col(vector).alias("vector"), F.col(label).alias("label"))
    mark = F.xxhash64("label", F.lit(SEED))
    # 128 bits stand for a vector of a label
    print_of = [F.xxhash64("label", "vector").alias("h1"), F.xxhash64(F.lit(SEED), "vector", "label").alias("h2")]
    classes = rows.where(compared).groupBy("label", "vector").agg(F.count("*").alias("copies"), F.min("key").alias("least"))
    nodes = written(classes.select(F.monotonically_increasing_id().alias("node"), mark.alias("mark"), "vector", "copies", "least", *print_of), "nodes")
    most = nodes.groupBy("mark").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    k, tables = shape(most, least)
    keyed = written(buckets(nodes, k, tables), "buckets")
    shared = keyed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    found = written(counted(nodes, keyed.join(shared, "bucket"), least), "links")
    removed(keyed)
    counts = found.where("links > 0").groupBy("node").agg(F.sum("links").alias("links"))
    roots = written(components(found.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b"))), "roots")
    named = nodes.join(counts, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = named.groupBy("root").agg(F.min("least").alias("component_id"))
    marked = named.join(first, "root").select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    solved = written(marked, "solved")
    for table in (nodes, found, roots):
        removed(table)
    prints = [F.when(compared, c) for c in (F.xxhash64("label", "vector"), F.xxhash64(F.lit(SEED), "vector", "label"))]
    all_rows = rows.select("key", prints[0].alias("h1"), prints[1].alias("h2"))
    out = all_rows.join(solved, ["h1", "h2"], "left")
    component = F.when(F.col("n_links").isNull(), F.col("key")).otherwise(F.col("component_id"))
    return out.select(F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
        component.eqNullSafe(F.col("key")).alias("kept"))
