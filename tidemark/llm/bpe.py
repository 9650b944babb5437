"""BPE encoding and decoding through a table of distinct words.

Texts are split at white space, which no token of the vocabularies used here crosses, and every
distinct word of the corpus is encoded once:

1. Each task numbers the distinct words of a chunk of its texts, so that a text is an array of numbers.
2. The chunks' words meet by bucket, a hash of the word. A bucket's words are one part of the table: each
   is encoded once, by the tokenizers library, and its ids go back to every chunk that has the word.
3. A chunk's ids meet its texts: a text's ids are those of its words, position by position. Decoding joins
   ids with the vocabulary's pieces, an array by id (its size is fixed, so it is sent to all tasks).

So a word crosses the network once a chunk, not once an occurrence, and a frequent word is one entry
a chunk. Words, ids and texts travel as packed arrays. Chunks are cut twice, for their words and for
their texts: rows must come in the same order both times, as those of stored tables do; a checksum of
each chunk's words raises an error where they do not. Memory is bounded by a chunk (CHUNK_BYTES of text,
or one text that is longer) and by TABLE_WORDS.

Nulls and empty texts have no ids and decode to "". Rows are encoded one by one: repeated rows, null
and repeated keys, and row order do not matter; extra columns are left out, whatever their names.
Very long texts are whole. Empty tables give no rows.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_kind, texts

#: White space of str.split() that may be part of a token; texts that hold such are encoded whole.
ODD_SPACE = re.compile("[\x1c-\x1f\x85]")
#: Text of a chunk.
CHUNK_BYTES = 16 << 20
#: Parts of the table of distinct words.
BUCKETS = 512
#: Words of a part that a task keeps at a time (at that many it begins anew).
TABLE_WORDS = 400_000
#: Words of the texts that travel together.
GROUP_WORDS = 1 << 16


def load(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def pieces_of(tokenizer) -> dict[int, str]:
    return {i: piece for piece, i in tokenizer.get_vocab(with_added_tokens=True).items()}


def split(text: str | None) -> list[str]:
    """The words of a text; one that white space cannot split safely stays whole."""
    if not text:
        return []
    return [text] if ODD_SPACE.search(text) else text.split()


def packed(numbers: np.ndarray) -> bytes:
    """Numbers below 2**32 as bytes: the least bytes of all, then the next, compressed."""
    numbers = np.ascontiguousarray(numbers, np.uint32)
    width = max(1, (int(numbers.max(initial=0)).bit_length() + 7) // 8)
    planes = numbers.view(np.uint8).reshape(-1, 4)[:, :width].T.tobytes()
    data = pa.Codec("zstd").compress(planes, asbytes=True)
    return struct.pack("<IBI", len(numbers), width, len(data)) + data


def unpacked(data: bytes, at: int = 0) -> tuple[np.ndarray, int]:
    """(numbers, where the next ones begin) of what packed() made."""
    n, width, size = struct.unpack_from("<IBI", data, at)
    at += 9
    planes = pa.Codec("zstd").decompress(data[at : at + size], n * width, asbytes=True)
    out = np.zeros((n, 4), np.uint8)
    out[:, :width] = np.frombuffer(planes, np.uint8).reshape(width, n).T
    return out.view(np.uint32).ravel(), at + size


def packed_words(words: list[bytes]) -> bytes:
    return packed(np.array([len(w) for w in words])) + packed(np.frombuffer(b"".join(words), np.uint8))


def unpacked_words(data: bytes) -> list[bytes]:
    sizes, at = unpacked(data)
    raw, _ = unpacked(data, at)
    raw, ends = raw.astype(np.uint8).tobytes(), np.cumsum(sizes).tolist()
    return [raw[a:b] for a, b in zip([0, *ends], ends)]


class Chunk(NamedTuple):
    """Texts as numbers of words (the most frequent are the least), and the distinct words by bucket;
    place: where each word is in the list of all buckets' words."""

    number: int
    keys: list
    codes: list[np.ndarray]
    buckets: dict[int, list[bytes]]
    place: np.ndarray

    def mark(self) -> int:
        return sum(zlib.crc32(b"\0".join(words)) for words in self.buckets.values()) & 0xFFFFFFFF


def _closed(number: int, words: dict[str, int], keys: list, codes: list[np.ndarray]) -> Chunk:
    counts = np.bincount(np.concatenate([*codes, np.zeros(0, np.int64)]), minlength=len(words))
    rank = np.empty(len(words), np.int64)
    rank[np.argsort(-counts, kind="stable")] = np.arange(len(words))
    raw = [w.encode("utf-8", "surrogatepass") for w in words]
    bucket = np.array([zlib.crc32(w) % BUCKETS for w in raw], np.int64)
    order = np.argsort(bucket, kind="stable")
    place = np.empty(len(words), np.int64)
    place[rank[order]] = np.arange(len(words))
    buckets: dict[int, list[bytes]] = {}
    for i in order.tolist():
        buckets.setdefault(int(bucket[i]), []).append(raw[i])
    return Chunk(number, keys, [rank[c] for c in codes], buckets, place)


def chunks(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[Chunk]:
    """The chunks of a task's texts, in order."""
    number, held = TaskContext.get().partitionId() << 32, 0
    words: dict[str, int] = {}
    keys, codes = [], []
    for part in texts(batches):
        for k, text in zip(part.column(key).to_pylist(), part.column("text").to_pylist()):
            code = words.setdefault
            keys.append(k)
            codes.append(np.array([code(w, len(words)) for w in split(text)], np.int64))
            held += len(text or "")
            if held >= CHUNK_BYTES:
                yield _closed(number, words, keys, codes)
                number, held, words, keys, codes = number + 1, 0, {}, [], []
    if keys:
        yield _closed(number, words, keys, codes)


def chunk_words(docs: DataFrame, key: str) -> DataFrame:
    """(bucket, chunk, words): the distinct words of every chunk."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks(batches, key):
            if c.buckets:
                found = [packed_words(words) for words in c.buckets.values()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c.buckets), pa.int32()), pa.array([c.number] * len(found), pa.int64()),
                    pa.array(found, pa.binary())], ["bucket", "chunk", "words"])

    return docs.select(key, "text").mapInArrow(rows, "bucket int, chunk bigint, words binary")


def chunk_texts(docs: DataFrame, key: str) -> DataFrame:
    """(chunk, at, keys, data): a row at 0 with the words' places and their checksum, and rows behind it
    with the keys and word numbers of some texts each."""
    kind = docs.schema[key].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks(batches, key):
            keys, data = [[]], [packed(np.array([c.mark()])) + packed(c.place)]
            sizes = np.array([len(x) for x in c.codes])
            group = (np.cumsum(sizes) - sizes) // GROUP_WORDS
            for a, b in zip(edges := np.flatnonzero(np.diff(group, prepend=-1)).tolist(), [*edges[1:], len(group)]):
                keys.append(c.keys[a:b])
                data.append(packed(sizes[a:b]) + packed(np.concatenate(c.codes[a:b])))
            at = np.arange(len(data), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([c.number] * len(data), pa.int64()), pa.array(at),
                pa.array(keys, pa.list_(arrow_kind(kind))), pa.array(data, pa.binary())], ["chunk", "at", "keys", "data"])

    return docs.select(key, "text").mapInArrow(rows, f"chunk bigint, at int, keys array<{kind}>, data binary")


def encoded_words(words: DataFrame, path: str) -> DataFrame:
    """(chunk, at, data) from chunk_words: the ids of a chunk's words in each bucket. Rows of a bucket come
    one after another; each of its distinct words is encoded when it is first met."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path)
        bucket, table = None, {}
        for batch in batches:
            out = []
            for own, raw in zip(batch.column("bucket").to_pylist(), batch.column("words").to_pylist()):
                if own != bucket or len(table) > TABLE_WORDS:
                    bucket, table = own, {}
                words = unpacked_words(raw)
                for w in words:
                    if w not in table:
                        table[w] = np.array(tokenizer.encode(w.decode("utf-8", "surrogatepass"), add_special_tokens=False).ids, np.uint32)
                ids = [table[w] for w in words]
                out.append(packed(np.array([zlib.crc32(b"\0".join(words))])) + packed(np.array([len(x) for x in ids])) + packed(np.concatenate(ids)))
            yield pa.RecordBatch.from_arrays([batch.column("chunk"), batch.column("bucket"), pa.array(out, pa.binary())], ["chunk", "at", "data"])

    sorted_rows = words.repartition("bucket").sortWithinPartitions("bucket")
    return sorted_rows.mapInArrow(rows, "chunk bigint, at int, data binary")


def encode_documents(docs: DataFrame, path: str, *, key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids, decoded) of every whole text; path: the vocabulary, on all machines."""
    kind = docs.schema[key].dataType.simpleString()
    ids = encoded_words(chunk_words(docs, key), path)
    names = pieces_of(load(path))
    pieces = docs.sparkSession.sparkContext.broadcast([names.get(i, "") for i in range(max(names) + 1)])

    def texts_of(keys: list, data: bytes, words: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
        flat, edges, spelt = words
        sizes, at = unpacked(data)
        codes = unpacked(data, at)[0].astype(np.int64)
        own = edges[codes + 1] - edges[codes]
        total = np.concatenate([[0], np.cumsum(own)])
        found = flat[np.repeat(edges[codes] - total[:-1], own) + np.arange(total[-1])]
        ends = np.cumsum(sizes.astype(np.int64))
        bounds = total[np.concatenate([[0], ends])]
        decoded = [" ".join(spelt[c[n > 0]].tolist()) for c, n in zip(np.split(codes, ends[:-1]), np.split(own, ends[:-1]))]
        lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(found, pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array(keys, arrow_kind(kind)), pa.array(np.diff(bounds)), lists,
            pa.array(decoded, pa.string())], [key, "n_tokens", "ids", "decoded"])

    def put_together(ids: pa.Table, rows: pa.Table) -> pa.Table:
        if not rows.num_rows:
            raise ValueError("texts came in another order when they were read again")
        held, mark = [], 0
        for data in ids.sort_by("at").column("data").to_pylist():
            crc, at = unpacked(data)
            mark = (mark + int(crc[0])) & 0xFFFFFFFF
            sizes, at = unpacked(data, at)
            held.append((sizes, unpacked(data, at)[0]))
        rows = rows.sort_by("at")
        (_, first), *groups = zip(rows.column("keys").to_pylist(), rows.column("data").to_pylist())
        crc, at = unpacked(first)
        if int(crc[0]) != mark:
            raise ValueError("texts came in another order when they were read again")
        words = _in_order(held, unpacked(first, at)[0].astype(np.int64), pieces.value)
        return pa.Table.from_batches([texts_of(keys, data, words) for keys, data in groups])

    side = lambda df: df.groupBy("chunk")
    out = f"{key} {kind}, n_tokens bigint, ids array<int>, decoded string"
    return side(ids).cogroup(side(chunk_texts(docs, key))).applyInArrow(put_together, out)


def _in_order(held: list, place: np.ndarray, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of a chunk's words by their numbers: all ids, their edges, and the words' decoded texts."""
    sizes = np.concatenate([*(s for s, _ in held), np.zeros(0, np.uint32)]).astype(np.int64)
    flat = np.concatenate([*(f for _, f in held), np.zeros(0, np.uint32)]).astype(np.int32)
    starts = np.cumsum(sizes) - sizes
    edges = np.concatenate([[0], np.cumsum(sizes[place])])
    flat = flat[np.repeat(starts[place] - edges[:-1], sizes[place]) + np.arange(edges[-1])]
    names, bounds = [pieces[i] for i in flat.tolist()], edges.tolist()
    spelt = np.empty(len(place), object)
    spelt[:] = [names[a] if b - a == 1 else " ".join(names[a:b]) for a, b in zip(bounds, bounds[1:])]
    return flat, edges, spelt


def decode_by_join(encoded: DataFrame, path: str, *, key: str = "doc_id") -> DataFrame:
    """(key, decoded) from (key, ids): ids to pieces by a join with the vocabulary, then in order.

    key must be unique. The vocabulary is broadcast: its size is fixed.
    """
    pieces = encoded.sparkSession.createDataFrame(sorted(pieces_of(load(path)).items()), "id int, piece string")
    at = encoded.select(key, F.posexplode("ids").alias("pos", "id")).join(F.broadcast(pieces), "id", "left")
    spelt = F.array_sort(F.collect_list(F.struct("pos", F.coalesce("piece", F.lit("")).alias("piece"))))
    text = at.groupBy(key).agg(spelt.alias("p")).select(key, F.concat_ws(" ", "p.piece").alias("decoded"))
    return encoded.select(key).join(text, key, "left").select(key, F.coalesce("decoded", F.lit("")).alias("decoded"))
