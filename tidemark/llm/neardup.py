"""SimHash near-duplicates by Golay-code fuzzy hashing.

Fingerprints are 64-bit SimHashes of 3-word shingles. Two of them link if they differ in at most
3 bits. Of four blocks of 16 bits, one then is equal in both (pigeonhole); of the two segments of
24 bits that the other 48 make up, one then has at most one error. The first 23 bits of a segment
are decoded in the perfect (23, 12) Golay code, and a fingerprint's keys are, for each block and
segment, the block's value with the index of every codeword within distance 3 of the segment, or
within 4 where the nearest is at 3 (one or six codewords). Segments with at most one error share
such a codeword: if c is the nearest of x, then y is within 4 of c, and at 4 no codeword is nearer
to y than 3. The last bit of a segment is not part of its key. So linked fingerprints share a key.

Equal fingerprints are made one first. Fingerprints of a key meet in one task as 8 bytes each;
there a search over the ones not yet reached yields a spanning forest of the exact links, so a
group of n near copies gives n - 1 rows, not n squared. Components come from the forests by
repeated hooking to the smallest neighbour, in tables.

Near copies, which the pipeline's stage links as well, are another relation: pairs of texts whose sets of 5-word shingles
have a Jaccard similarity of at least 0.8, which differ in about 10 of 64 SimHash bits, beyond what
Golay keys reach. Their candidates share a MinHash key; each is verified on the whole sets.

Nulls: a null text has no words and fingerprint 0, as an empty one; documents of fingerprint 0 link
like any others. A null id takes part and gets its component, of which it is the smallest only if all
ids are null (then null). Repeated rows fall into one component. Long texts are hashed whole. Empty
tables give no rows. Extra columns are left out; `deduplicated` keeps them, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Memo, mapped, written

#: Most differing bits of a link.
RADIUS = 3
WORDS = 3
SEED = 42
#: Near copies: words of a shingle, least Jaccard similarity, and keys (BANDS of ROWS minima each).
#: A pair of similarity 0.8 shares no key with probability (1 - 0.8**5)**40, about 1e-7.
COPY_WORDS = 5
LEAST_ALIKE = 0.8
BANDS, ROWS = 40, 5
#: Pairs whose share of equal least bytes is further than SLACK below the least similarity are not
#: compared; one of similarity 0.8 is lost so with about 1e-7 as well. Keys of over FEW sets are
#: searched in blocks of at most about BLOCK_SETS sets and BLOCK_SHINGLES shingles; the centre of such
#: a key is found from SAMPLE of its sets (which decides how fast links are found, not which).
FEW, SLACK = 16, 0.16
BLOCK_SETS, BLOCK_SHINGLES, SAMPLE = 2048, 1 << 20, 48
#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, which generates the binary Golay code.
GENERATOR = 0b101011100011


def shingles(text: str | None, words: int) -> np.ndarray:
    """XXH64 of each run of `words` words, or of the whole text if it has no more words."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    joined = b" ".join(parts)
    if len(parts) > words:
        ends = np.cumsum([len(p) + 1 for p in parts])
        starts = np.concatenate([[0], ends[: -words]])
        return np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts.tolist(), (ends[words - 1 :] - 1).tolist())], np.uint64)
    return np.array([xxhash.xxh64_intdigest(joined, SEED)] if parts else [], np.uint64)


def fingerprints(column: pa.Array, words: int = WORDS) -> np.ndarray:
    """SimHash of each text: bit i is set if it is set in over half of the shingles' XXH64."""
    out = np.zeros(len(column), np.uint64)
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for r, text in enumerate(column.to_pylist()):
        hashes = shingles(text, words)
        if not len(hashes):
            continue
        ones = np.zeros(64, np.int64)
        for at in range(0, len(hashes), 1 << 14):
            ones += np.unpackbits(hashes[at : at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1,
                bitorder="little").sum(axis=0, dtype=np.int64)
        out[r] = weights[ones * 2 > len(hashes)].sum()
    return out


def _digest() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")), F.col("text").isNull())


def with_fingerprints(docs: DataFrame, *, key: str = "doc_id", words: int = WORDS) -> DataFrame:
    """(key, digest, fp) of every whole text; fp as a signed long, digest a hash of the text."""

    def hashed(part: pa.RecordBatch) -> list:
        return [part.column(key), part.column("digest"), fingerprints(part.column("text"), words).view(np.int64)]

    kind = docs.schema[key].dataType.simpleString()
    return mapped(docs.select(key, _digest().alias("digest"), "text"), hashed, f"{key} {kind}, digest bigint, fp bigint")


def _syndrome(v: np.ndarray) -> np.ndarray:
    """The remainder of v (23 bits) modulo the generator."""
    v = v.astype(np.int64)
    for bit in range(22, 10, -1):
        v = np.where(v >> bit & 1, v ^ (GENERATOR << (bit - 11)), v)
    return v


_MADE = Memo()


def _decoder() -> tuple[np.ndarray, np.ndarray]:
    if "decoder" not in _MADE:
        _MADE["decoder"] = _make_decoder()
    return _MADE["decoder"]


def _make_decoder() -> tuple[np.ndarray, np.ndarray]:
    """For each of the 2048 syndromes, the error patterns of weight up to 3 (the one there is)
    or, where it has weight 3, also the five of weight 4; and how many there are."""
    patterns = {w: np.array([sum(1 << b for b in c) for c in combinations(range(23), w)], np.int64) for w in (0, 1, 2, 3, 4)}
    found: list[list[int]] = [[] for _ in range(2048)]
    for w in (0, 1, 2, 3):
        for s, e in zip(_syndrome(patterns[w]).tolist(), patterns[w].tolist()):
            found[s].append(e)
    threes = set(_syndrome(patterns[3]).tolist())
    for s, e in zip(_syndrome(patterns[4]).tolist(), patterns[4].tolist()):
        if s in threes:
            found[s].append(e)
    table = np.zeros((2048, 6), np.int64)
    for s, es in enumerate(found):
        table[s, : len(es)] = es
    return table, np.array([len(es) for es in found])


def codewords(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, indices): the 12-bit indices of the codewords near each 23-bit value."""
    table, counts = _decoder()
    s = _syndrome(v)
    n = counts[s]
    rows = np.repeat(np.arange(len(v)), n)
    place = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
    return rows, (v[rows] ^ table[s[rows], place]) >> 11


def keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, keys) of fingerprints: 8 families of an exact block and a codeword."""
    rows, out = [], []
    for block in range(4):
        exact = (fp >> np.uint64(16 * block) & np.uint64(0xFFFF)).astype(np.int64)
        low = fp & np.uint64((1 << 16 * block) - 1)
        high = (fp >> np.uint64(16 * (block + 1))) << np.uint64(16 * block) if block < 3 else np.zeros_like(fp)
        rest = (low | high).astype(np.int64)
        for half in range(2):
            at, index = codewords(rest >> (24 * half) & 0x7FFFFF)
            rows.append(at)
            out.append((((block * 2 + half) << 16 | exact[at]) << 12) | index)
    return np.concatenate(rows), np.concatenate(out)


def forest(fp: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between distinct fingerprints, by search over the rest."""
    left, a, b = np.unique(fp), [], []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(left ^ at) <= radius
            if near.any():
                found = left[near]
                a.append(np.full(len(found), at))
                b.append(found)
                queue += list(found)
                left = left[~near]
    none = np.zeros(0, np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): for each key a spanning forest of its fingerprints' links; distinct: (fp)."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False)
            rows, key = keys(fp.view(np.uint64))
            for at in range(0, len(rows), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(key[at : at + (1 << 17)]), pa.array(fp[rows[at : at + (1 << 17)]])], ["key", "fp"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def solved(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch | None:
            edge = np.flatnonzero(np.diff(key)) + 1
            starts, ends = np.concatenate([[0], edge]), np.concatenate([edge, [len(key)]])
            size = ends - starts
            a, b = [], []
            twos = starts[size == 2]
            near = np.bitwise_count(fp[twos] ^ fp[twos + 1]) <= radius
            a.append(fp[twos[near]])
            b.append(fp[twos[near] + 1])
            for s, e in zip(starts[size > 2].tolist(), ends[size > 2].tolist()):
                x, y = forest(fp[s:e], radius)
                a.append(x)
                b.append(y)
            a, b = np.concatenate(a), np.concatenate(b)
            if not len(a):
                return None
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1]))], ["a", "b"])

        for batch in batches:
            key, fp = batch.column("key").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)
            if not len(key):
                continue
            if held and held[-1][0][-1] != key[0]:
                out = solved(*(np.concatenate(c) for c in zip(*held)))
                held = []
                if out:
                    yield out
            last = int(np.searchsorted(key, key[-1]))
            if last:
                held.append((key[:last], fp[:last]))
                out = solved(*(np.concatenate(c) for c in zip(*held)))
                held = []
                if out:
                    yield out
            held.append((key[last:], fp[last:]))
        if held and (out := solved(*(np.concatenate(c) for c in zip(*held)))):
            yield out

    rows = distinct.select("fp").mapInArrow(keyed, "key bigint, fp bigint")
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(joined, "a bigint, b bigint").distinct()


def components(edges: DataFrame, *, rounds: int = 100) -> DataFrame:
    """(node, root): the smallest node of each component of (a, b).

    In each round every node hooks its larger neighbours, and then its smaller ones, to the
    smallest (large star, small star); rows never outnumber the edges. A hub's neighbours are
    aggregated before they are shuffled. Rounds end when the edges are stars; their number grows with
    the logarithm of the edges, and an error is raised if `rounds` are not enough.
    """
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    mark = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")),
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        edges = written(small, "links", instead_of=edges)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components are not complete after {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"),
        F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", words: int = WORDS) -> DataFrame:
    """(key, fp, component_id): component_id is the smallest key reachable over links."""
    found = written(with_fingerprints(docs, key=key, words=words), "fingerprints")
    return _labelled(found, _groups(found, links, key), key)


def _groups(found: DataFrame, edges: Callable[[DataFrame], DataFrame], key: str) -> DataFrame:
    """(fp, root, least): for each distinct fp its component and the smallest row, a struct that
    sorts null keys last, of those with that fp. found: (key, digest, fp); edges: from distinct fp
    to links."""
    least = F.min(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), "digest")).alias("least")
    groups = written(found.groupBy("fp").agg(least), "distinct")
    roots = written(components(edges(groups)), "roots")
    own = groups.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    return own.select("fp", F.coalesce("root", "fp").alias("root"), "least")


def _labelled(found: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    groups = written(groups, "groups")
    least = groups.groupBy("root").agg(F.min("least").alias("least")).select("root", F.col("least.key").alias("component_id"))
    return found.join(groups.join(least, "root").select("fp", "component_id"), "fp").select(key, "fp", "component_id")


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    if "multipliers" not in _MADE:
        _MADE["multipliers"] = _draw_multipliers()
    return _MADE["multipliers"]


def _draw_multipliers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    draw = lambda: rng.integers(0, 1 << 64, BANDS * ROWS, np.uint64)
    return draw(), draw() | np.uint64(1)


def band_keys(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One key for each band of a set, of the least values under ROWS hash functions; and a byte of
    each of all those values."""
    flip, times = _multipliers()
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 1 << 10):
        np.minimum(least, ((hashes[at : at + (1 << 10), None] ^ flip) * times).min(axis=0), out=least)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        out = (out ^ (row >> np.uint64(7))) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out, (least >> np.uint64(16)).astype(np.uint8)


def with_sketches(docs: DataFrame, *, key: str = "doc_id", words: int = COPY_WORDS) -> DataFrame:
    """(key, digest, fp, size, sketch, keys) of every whole text: a digest and the size of its set of
    shingles, and the set's least bytes and keys (none of an empty set)."""

    def hashed(part: pa.RecordBatch) -> list:
        sets = [np.unique(shingles(t, words)) for t in part.column("text").to_pylist()]
        fp = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets], np.uint64).view(np.int64)
        none = (np.zeros(0, np.uint64), np.zeros(0, np.uint8))
        keys, least = zip(*(band_keys(x) if len(x) else none for x in sets))
        sizes = pa.array([len(x) for x in sets], pa.int32())
        sketches = pa.array([x.tobytes() for x in least], pa.binary())
        return [part.column(key), part.column("digest"), pa.array(fp), sizes, sketches, pa.array([x.view(np.int64) for x in keys], pa.list_(pa.int64()))]

    kind = docs.schema[key].dataType.simpleString()
    out = f"{key} {kind}, digest bigint, fp bigint, size int, sketch binary, keys array<bigint>"
    return mapped(docs.select(key, _digest().alias("digest"), "text"), hashed, out)


def sets_of(docs: DataFrame, wanted: DataFrame, *, words: int = COPY_WORDS) -> DataFrame:
    """(fp, shingles): the sets, as sorted bytes, of the distinct texts that wanted (fp, digest) names."""

    def hashed(part: pa.RecordBatch) -> list:
        sets = [np.unique(shingles(t, words)).astype("<u8").tobytes() for t in part.column("text").to_pylist()]
        return [part.column("fp"), pa.array(sets, pa.binary())]

    texts = docs.select(_digest().alias("digest"), "text").join(wanted, "digest").dropDuplicates(["fp"])
    return mapped(texts.select("fp", "text"), hashed, "fp bigint, shingles binary")


def _sides(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """pairs (a, b) with the column of both ends as _x and _y; table: (fp, column)."""
    side = lambda end, name: table.select(F.col("fp").alias(end), F.col(column).alias(name))
    return pairs.join(side("a", "_x"), "a").join(side("b", "_y"), "b").select("a", "b", "_x", "_y")


def likely(pairs: DataFrame, sketches: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose share of equal least bytes is no further than SLACK below `least`."""

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keep = (_bytes(batch, "_x") == _bytes(batch, "_y")).sum(axis=1) >= (least - SLACK) * BANDS * ROWS
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return _sides(pairs, sketches, "sketch").mapInArrow(checked, "a bigint, b bigint")


def alike(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard similarity of at least `least`; sets: (fp, shingles)."""

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("_x"), batch.column("_y")):
                x, y = np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8")
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common >= least * (len(x) + len(y) - common) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return _sides(pairs, sets, "shingles").mapInArrow(checked, "a bigint, b bigint")


def _centres(large: DataFrame, sketches: DataFrame) -> DataFrame:
    """(key, centre): of each key the set whose sketch agrees most with what is commonest, byte by byte, in
    the sketches of some of its sets. Near copies of one text gather around it, so that its star joins
    most of them. large: (key, fp)."""
    order = Window.partitionBy("key").orderBy(F.xxhash64("fp"), "fp")
    some = large.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= SAMPLE).select("key", "fp").join(sketches, "fp")

    def common(group: pa.Table) -> pa.Table:
        x = np.stack([np.frombuffer(b, np.uint8) for b in group.column("sketch").to_pylist()])
        votes = (x[:, None, :] == x[None, :, :]).sum(axis=1)
        best = x[votes.argmax(axis=0), np.arange(x.shape[1])]
        return pa.table({"key": pa.array(group.column("key").to_pylist()[:1], pa.int64()), "common": pa.array([best.tobytes()], pa.binary())})

    commonest = some.groupBy("key").applyInArrow(common, "key bigint, common binary")

    def agreed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = _bytes(batch, "sketch"), _bytes(batch, "common")
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("fp"), pa.array((x == y).sum(axis=1), pa.int64())], ["key", "fp", "same"])

    near = large.join(sketches, "fp").join(commonest, "key").select("key", "fp", "sketch", "common").mapInArrow(agreed, "key bigint, fp bigint, same bigint")
    return near.groupBy("key").agg(F.max_by("fp", F.struct("same", "fp")).alias("centre"))


def _bytes(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(column).to_pylist()), np.uint8).reshape(batch.num_rows, -1)


def _block_links(placed: DataFrame, sketches: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(a, b): links between sets of one key and different components, found block by block.

    placed: (key, fp, size, root). A key's sets are dealt to blocks of a bounded number of sets and
    shingles. Those of its largest component need not be compared with each other and stay in one block;
    the others visit all blocks of the key. A block is a task's work, which compares sketches, then
    whole sets, and yields a spanning forest of the links, not all pairs.
    """
    by_root = placed.groupBy("key", "root").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    blocks = F.ceil(F.greatest(F.sum("n") / BLOCK_SETS, F.sum("size") / BLOCK_SHINGLES)).cast("int")
    by_key = by_root.groupBy("key").agg(blocks.alias("_blocks"), F.max_by("root", F.struct("n", "root")).alias("_base"))
    dealt = placed.join(by_key, "key").withColumn("home", F.pmod(F.xxhash64("fp", F.lit(3)),
        F.col("_blocks")).cast("int")).withColumn("base", F.col("root") == F.col("_base"))
    visits = F.when(F.col("base"), F.array("home")).otherwise(F.sequence(F.lit(0), F.col("_blocks") - 1))
    rows = dealt.join(sketches, "fp").join(sets, "fp").select("key", F.explode(visits).alias("block"), "home", "base", "fp", "size", "root",
        "sketch", "shingles")

    def linked(group: pa.Table) -> pa.Table:
        fp, size, root, home = (group.column(c).to_numpy() for c in ("fp", "size", "root", "home"))
        base, here = group.column("base").to_numpy(zero_copy_only=False), home == group.column("block").to_numpy()
        sketch = np.stack([np.frombuffer(x, np.uint8) for x in group.column("sketch").to_pylist()])
        shingles_of = [np.frombuffer(x, "<u8") for x in group.column("shingles").to_pylist()]
        names, at = np.unique(root, return_inverse=True)
        parent = list(range(len(names)))

        def top(i: int) -> int:
            while parent[i] != i:
                parent[i] = i = parent[parent[i]]
            return i

        a, b = [], []
        for i in np.flatnonzero(~base).tolist():
            # two visitors are compared where the one of the smaller number is at home
            meets = base | (fp[i] < fp) if here[i] else base
            j = np.flatnonzero(meets & (root != root[i]) & (np.minimum(size, size[i]) >= least * np.maximum(size, size[i]) - 1e-9))
            same = (sketch[j] == sketch[i]).sum(axis=1)
            for k in j[same >= (least - SLACK) * BANDS * ROWS].tolist():
                x, y = top(at[i]), top(at[k])
                if x == y:
                    continue
                shared = len(np.intersect1d(shingles_of[i], shingles_of[k], assume_unique=True))
                if shared >= least * (len(shingles_of[i]) + len(shingles_of[k]) - shared) - 1e-9:
                    parent[max(x, y)] = min(x, y)
                    a.append(fp[i])
                    b.append(fp[k])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.groupBy("key", "block").applyInArrow(linked, "a bigint, b bigint")


def copy_links(docs: DataFrame, found: DataFrame, least: float = LEAST_ALIKE, words: int = COPY_WORDS) -> DataFrame:
    """(a, b): links of similarity `least` or more between sets that share a key, enough of them to
    join every component. found: with_sketches of docs, written.

    First every set is compared with a centre of each of its keys; then, of each key, the sets that those
    links have left in different components with each other: pairwise in keys of at most FEW sets, block
    against block in the others. Pairs whose least bytes say that they are far apart go no further; of
    the others the whole sets are made and compared.
    """
    distinct = found.where("size > 0").groupBy("fp").agg(F.min("digest").alias("digest"), F.first("size").alias("size"),
        F.first("sketch").alias("sketch"), F.first("keys").alias("keys"))
    distinct = written(distinct, "sketches")
    sketches = distinct.select("fp", "sketch")
    keyed = distinct.select("fp", "size", F.explode("keys").alias("key"))
    group = Window.partitionBy("key")
    members = keyed.select("key", "fp", "size", F.count("*").over(group).alias("n"), F.min("fp").over(group).alias("centre"))
    members = written(members.where("n > 1"), "members")
    near = lambda x, y: F.least(x, y) >= least * F.greatest(x, y) - 1e-9

    def sets_for(rows: DataFrame) -> DataFrame:
        wanted = distinct.select("fp", "digest").join(rows.select("fp").distinct(), "fp", "left_semi")
        return written(sets_of(docs, wanted, words=words), "sets")

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = written(likely(pairs, sketches, least), "likely")
        return written(alike(pairs, sets_for(pairs.select(F.explode(F.array("a", "b")).alias("fp"))), least), "linked")

    def placed(links: DataFrame) -> DataFrame:
        """Members, with their components, of the keys that hold several."""
        roots = written(components(links), "roots").withColumnRenamed("node", "fp")
        out = members.select("key", "fp", "size", "n").join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        split = out.groupBy("key").agg(F.min("root").alias("_low"), F.max("root").alias("_high")).where("_low <> _high").select("key")
        return written(out.join(split, "key", "left_semi"), "placed")

    few, many = F.col("n") <= FEW, F.col("n") > FEW
    centres = written(_centres(members.where(many).select("key", "fp"), sketches), "centres")
    sizes = distinct.select(F.col("fp").alias("centre"), F.col("size").alias("_size"))
    stars = members.where(few).select("fp", "size", "centre").unionByName(members.where(many).drop("centre").join(centres,
        "key").select("fp", "size", "centre"))
    stars = stars.where("fp <> centre").distinct().join(sizes, "centre").where(near(F.col("size"), F.col("_size")))
    stars = written(stars.select(F.least("centre", "fp").alias("a"), F.greatest("centre", "fp").alias("b")).distinct(), "stars")
    links = verified(stars)

    rows = placed(links).where(few)
    left = rows.select("key", F.col("fp").alias("a"), F.col("size").alias("_size"), F.col("root").alias("_root"))
    right = rows.select("key", F.col("fp").alias("b"), "size", "root")
    on = (left["key"] == right["key"]) & (F.col("a") < F.col("b")) & (F.col("_root") != F.col("root")) & near(F.col("_size"), F.col("size"))
    pairs = left.join(right, on).select("a", "b").distinct().join(stars, ["a", "b"], "left_anti")
    links = links.unionByName(verified(pairs))

    rows = placed(links).where(many).drop("n")
    if rows.head(1):
        links = links.unionByName(written(_block_links(rows, sketches, sets_for(rows), least), "linked"))
    return links


def near_copies(docs: DataFrame, *, key: str = "doc_id", words: int = COPY_WORDS, least: float = LEAST_ALIKE) -> DataFrame:
    """(key, fp, component_id) as near_duplicates, where fp is a digest of the set of shingles and
    links are pairs of sets with a Jaccard similarity of at least `least`."""
    found = written(with_sketches(docs, key=key, words=words), "found")
    return _labelled(found, _groups(found, lambda _: copy_links(docs, found, least, words), key), key)


def deduplicated_copies(docs: DataFrame, *, words: int = COPY_WORDS, least: float = LEAST_ALIKE) -> DataFrame:
    """docs with one row of each component, as deduplicated, over the links of SimHash (near_duplicates) and of
    near_copies together."""
    prints = written(with_fingerprints(docs), "fingerprints")
    found = written(with_sketches(docs, words=words), "found")

    def stars(rows: DataFrame, edges: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """(a, b): of each component of one relation its smallest digest with each digest."""
        held = rows.select("digest", "fp").distinct().join(_groups(rows, edges, "doc_id").select("fp", "root"), "fp")
        held = written(held.select("digest", "root"), "held")
        return held.join(held.groupBy("root").agg(F.min("digest").alias("a")), "root").select("a", F.col("digest").alias("b"))

    both = stars(prints, links).unionByName(stars(found, lambda _: copy_links(docs, found, least, words)))
    texts = prints.select("doc_id", "digest", F.col("digest").alias("fp"))
    return _one_of_each(docs, _groups(texts, lambda _: both, "doc_id"))


def deduplicated(docs: DataFrame, *, words: int = WORDS) -> DataFrame:
    """docs with one row of each component: that of the smallest id, a null id last. Of rows that
    share an id, the text's hash decides, then the hash of all columns."""
    found = written(with_fingerprints(docs, words=words), "fingerprints")
    return _one_of_each(docs, _groups(found, links, "doc_id"))


def _one_of_each(docs: DataFrame, groups: DataFrame) -> DataFrame:
    kept = groups.groupBy("root").agg(F.min("least").alias("least"))
    kept = written(kept.select(F.col("least.key").alias("_kept_id"), F.col("least.digest").alias("_kept_digest")), "kept")
    named = docs.withColumn("_digest", _digest())
    same = F.col("doc_id").eqNullSafe(F.col("_kept_id")) & (F.col("_digest") == F.col("_kept_digest"))
    order = Window.partitionBy("doc_id", "_digest").orderBy(F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns)))
    return named.join(kept, same, "left_semi").withColumn("_place",
        F.row_number().over(order)).where("_place = 1").select(*(F.col(f"`{c}`") for c in docs.columns))
