"""WARC archives with an index: offset, length, URL and digest of every record.

Writing: pages of equal payloads (100 bytes or more) are found by digest; that with the smallest
id becomes a response record, the others revisit it. Every task writes archives of its own, a
gzip member for each record, and yields the index rows; the index is a table, written with the
archives' names, so that files of attempts that were lost or run twice are in no index.

Reading: selected index rows are sorted by archive and offset, and neighbouring ranges are read
at once. Response payloads are hashed again and held against their digests.

Archives are written and read by pyarrow's file systems in the shared folder, so a cluster's
folder may be on any store that these reach. Nulls: a null html is an empty payload, a null url
an empty target; of equal payloads whose ids are all null each is a response. Rows that repeat
the smallest id with its payload are responses as well. Long payloads are records like any others. Empty
tables give no archives and no rows. Extra columns are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import shared_dir, texts, written

#: Payloads of fewer bytes are never revisited.
LEAST_BYTES = 100
#: Bytes at which a task begins another archive.
ARCHIVE_BYTES = 256 << 20
#: Ranges at most so far apart are read at once, up to so many bytes.
GAP_BYTES, READ_BYTES = 64 << 10, 4 << 20
DATE = "2000-01-01T00:00:00Z"
INDEX = "page_id bigint, url string, archive string, offset bigint, length bigint, digest string, record_type string"
RECORDS = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string, payload binary"


def _file_system(uri: str):
    """(file system, path) of a URI; a path without a scheme is local."""
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _id(name: str) -> int | None:
    number = name.strip("<>").rpartition(":")[2]
    return None if number == "none" else int(number)


def _line(text: str) -> str:
    return "".join(c if c not in "\r\n" else " " for c in text)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None = None, *, revisit: bool = False) -> bytes:
    """One record as a gzip member; a revisit has the response's headers but no payload."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_line(url or '')}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_name(refers_to)}"]
    else:
        block += payload
    head.append(f"Content-Length: {len(block)}")
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(record headers, HTTP headers, payload) of one uncompressed record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


def planned(pages: DataFrame, *, least: int = LEAST_BYTES) -> DataFrame:
    """(page_id, url, html, digest, refers_to): refers_to is the page that a revisit repeats."""
    html = F.coalesce("html", F.lit(""))
    marked = pages.select("page_id", "url", html.alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"))
    # only payloads that repeat are joined; hot ones are one row here and split by AQE there
    first = marked.where(F.octet_length("html") >= least).groupBy("digest").agg(F.min("page_id").alias("_first"),
        F.count("*").alias("_n")).where("_n > 1 and _first is not null").select("digest", "_first")
    refers = F.when(F.col("page_id").eqNullSafe(F.col("_first")), F.lit(None)).otherwise(F.col("_first"))
    return marked.join(first, "digest", "left").select("page_id", "url", "html", "digest", refers.alias("refers_to"))


def write_archives(pages: DataFrame, *, folder: str | None = None, least: int = LEAST_BYTES) -> DataFrame:
    """The index of archives written for all pages."""
    folder = folder or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"

    def archived(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, at = None, "", 0
        system, base = _file_system(folder)
        system.create_dir(base, recursive=True)
        try:
            for part in texts(batches, "html"):
                rows = []
                for page, url, html, digest, refers in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to"))):
                    if out is None or at >= ARCHIVE_BYTES:
                        if out:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = system.open_output_stream(f"{base}/{name}", compression=None)
                    made = record(page, url, html.encode("utf-8", "replace"), digest, refers, revisit=refers is not None)
                    out.write(made)
                    rows.append((page, url, f"{folder}/{name}", at, len(made), digest, "response" if refers is None else "revisit"))
                    at += len(made)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c,
                    t in zip(zip(*rows), (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))],
                    INDEX.replace(" bigint", "").replace(" string", "").split(", "))
        finally:
            if out:
                out.close()

    return written(planned(pages, least=least).mapInArrow(archived, INDEX), "warc-index")


def read_records(index: DataFrame, *, payloads: bool = True) -> DataFrame:
    """The records of the index rows (all or a selection), read back from their archives."""
    names = RECORDS.split(", ")
    schema = RECORDS if payloads else ", ".join(names[:-1])

    def fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, name = None, ""
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length", "digest"))))
            at = 0
            while at < len(rows):
                to, end = at + 1, rows[at][1] + rows[at][2]
                while to < len(rows) and rows[to][0] == rows[at][0] and rows[to][1] - end <= GAP_BYTES and rows[to][1] + rows[to][2] - rows[at][1] <= READ_BYTES:
                    end, to = max(end, rows[to][1] + rows[to][2]), to + 1
                if name != rows[at][0]:
                    if source:
                        source.close()
                    name = rows[at][0]
                    system, path = _file_system(name)
                    source = system.open_input_file(path)
                data = source.read_at(end - rows[at][1], rows[at][1])
                found = [_found(zlib.decompress(data[o - rows[at][1] : o - rows[at][1] + n], 31), digest) for _, o, n, digest in rows[at:to]]
                columns = list(zip(*found))[: 7 if payloads else 6]
                yield pa.RecordBatch.from_arrays([pa.array(c,
                    pa.int64() if "bigint" in t else pa.binary() if "binary" in t else pa.string()) for c, t in zip(columns, names)],
                    [t.split()[0] for t in names[: len(columns)]])
                at = to
        if source:
            source.close()

    parts = max(1, int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return index.select("archive", "offset", "length", "digest").repartitionByRange(parts, "archive",
        "offset").sortWithinPartitions("archive", "offset").mapInArrow(fetched, schema)


def _found(data: bytes, digest: str) -> tuple:
    fields, http, payload = parse(data)
    kind = fields["WARC-Type"]
    named = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    size = int(http["Content-Length"])
    if named != digest or kind == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != size):
        raise ValueError(f"record {fields['WARC-Record-ID']} does not hold what its index row names")
    refers = _id(fields["WARC-Refers-To"]) if kind == "revisit" else None
    return _id(fields["WARC-Record-ID"]), size, named, kind, refers, fields["WARC-Target-URI"], payload if kind == "response" else None
