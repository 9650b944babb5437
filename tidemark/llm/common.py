"""What the operators of this subpackage share: written tables, Arrow batches and vectorised text."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.tables import removed as removed
from tidemark.plans.tables import shared_dir as shared_dir
from tidemark.plans.tables import written as written

# Functions sent to executors carry this package's code, so executors need no copy of it. What goes by
# reference all the same must not be in such code: functools caches, and classes in broadcast values.
cloudpickle.register_pickle_by_value(sys.modules[__name__.split(".")[0]])


class Memo(dict):
    """A cache of one process: it travels empty."""

    def __reduce__(self):
        return Memo, ()


#: Word characters of the contracts: all but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that vectorised code holds as arrays at a time (a longer text is held alone).
SLICE_BYTES = 1 << 21


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(n: int, key: str = "doc_id") -> Column:
    """crc32 of the id's decimal text, modulo n (null for a null id)."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % n


#: Text of the labelled rows of each label that training takes, about.
SAMPLE_BYTES = 64 << 20


def labelled(docs: DataFrame, labels: DataFrame, label: str, *, limit: int, size: int = SAMPLE_BYTES) -> DataFrame:
    """(doc_id, text, y) of documents that labels marks 0 or 1, at most about `limit` rows and `size`
    bytes of text of each label.

    The bounds are kept by a hash of the id, so that reruns take the same rows. Labels of other
    values, null ids and null labels are left out; a label that repeats counts once; ids
    marked both ways take the larger label.
    """
    marks = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    counts = {r["y"]: r["n"] for r in marks.groupBy("y").agg(F.count("*").alias("n")).collect()}
    shares = [F.when(F.col("y") == y, F.lit(min(1.0, limit / max(n, 1)))) for y, n in counts.items()]
    share = F.coalesce(*shares, F.lit(0.0))
    chance = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 20)) / float(1 << 20)
    # a table of that bound is safe to broadcast; texts are not shuffled
    with_texts = lambda part: docs.select("doc_id", "text").join(F.broadcast(marks.where(chance < part)), "doc_id").select("doc_id", "text", "y")
    sizes = {r["y"]: r["n"] for r in with_texts(share).groupBy("y").agg(F.sum(F.octet_length("text")).alias("n")).collect()}
    if any((n or 0) > size for n in sizes.values()):
        less = [F.when(F.col("y") == y, F.lit(min(1.0, size / max(n or 0, 1)))) for y, n in sizes.items()]
        share = share * F.coalesce(*less, F.lit(1.0))
    return with_texts(share)


def texts(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Rows of the batches in runs whose texts hold at most `limit` bytes (a longer text alone)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at = np.cumsum(sizes), 0
        while at < len(sizes):
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def mapped(df: DataFrame, f: Callable[[pa.RecordBatch], list], schema: str, *, limit: int = SLICE_BYTES, column: str = "text") -> DataFrame:
    """df through f, one run of rows at a time; f returns the columns of `schema`."""
    out = _arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in texts(batches, column, limit):
            if part.num_rows:
                yield pa.RecordBatch.from_arrays([_as(c, t.type) for c, t in zip(f(part), out, strict=True)], schema=out)

    return df.mapInArrow(run, schema)


def _as(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    return values if isinstance(values, pa.Array) and values.type == kind else values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, kind)


def arrow_kind(name: str) -> pa.DataType:
    """The Arrow type of a type that columns of this subpackage have."""
    plain = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}
    return pa.list_(plain[name[6:-1]]) if name.startswith("array<") else plain[name]


def _arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.types import StructType

    return pa.schema([(f.name, arrow_kind(f.dataType.simpleString())) for f in StructType.fromDDL(ddl)])


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes of all rows one after another, offsets of the rows); null is empty."""
    filled = pc.fill_null(column.cast(pa.large_binary()), b"")
    buffers = filled.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[filled.offset : filled.offset + len(filled) + 1]
    if buffers[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(filled) + 1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True


def spans(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all rows, and the rows' offsets in that list."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~gap[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[0], before[1:] = True, ~word[:-1]
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = True, ~word[1:]
    starts = np.flatnonzero(word & (before | edge[:-1]))
    ends = np.flatnonzero(word & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))


_POWERS = Memo()


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n not in _POWERS:
        up, down = np.full(n, _BASE), np.full(n, _BACK)
        up[0] = down[0] = 1
        _POWERS.clear()  # one size is enough: runs of texts are much alike
        _POWERS[n] = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _POWERS[n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: all bits of the result depend on all bits of h."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Hashes:
    """64-bit hashes of any byte ranges of `data`, each in constant time, by prefix sums."""

    def __init__(self, data: np.ndarray):
        size = 1 << max(12, int(len(data)).bit_length())
        up, self.down = _powers(size)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


def per_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values between the offsets (empty rows: 0)."""
    sums = np.zeros(len(values) + 1, np.result_type(values.dtype, np.int64) if values.dtype.kind != "f" else values.dtype)
    np.cumsum(values, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def filtered(docs: DataFrame, keep: Callable[[pa.RecordBatch], np.ndarray], *, column: str = "text", limit: int = SLICE_BYTES) -> DataFrame:
    """The rows of docs, with all their columns, for which keep says True."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in texts(batches, column, limit):
            if part.num_rows:
                yield part.filter(pa.array(keep(part), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
