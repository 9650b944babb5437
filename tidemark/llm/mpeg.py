"""MPEG audio columns: writing, resynchronised reading, tags, variable bit rates, checksums.

The reader takes the bytes of MPEG-1, -2 and -2.5 audio of all three layers: ID3v2 and ID3v1
tags, frame headers found by their sync bits and believed when a header of the same stream
follows where the frame ends (or the data end there), Xing/Info and VBRI tables, the CRC-16 of
protected Layer III frames, exact durations (samples over the sampling rate) and a byte offset
for every frame. Bytes between frames are skipped and counted.

The writer makes Layer III streams whose frames carry given bytes as their main data, so that
any payload can be stored and read back losslessly.

Nulls: a null value is read as no bytes, a null text is stored as an empty one. Bytes without a frame
give zero frames and duration 0. Long texts are stored whole, in as many frames as they need. Equal
texts have equal streams; repeated rows are rows of their own. Empty tables give no rows. Extra columns
are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from fractions import Fraction
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import Memo, mapped

# Fixed values of the MPEG audio standards: kilobits a second by (version is 1, layer), sampling
# rates of MPEG-1 (halved for MPEG-2, quartered for MPEG-2.5), and samples in a frame.
KBITS = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = (44100, 48000, 32000)
VERSIONS = {3: 1.0, 2: 2.0, 0: 2.5}
SAMPLES = {(True, 1): 384, (True, 2): 1152, (True, 3): 1152, (False, 1): 384, (False, 2): 1152, (False, 3): 576}


def _crc_table() -> list[int]:
    out = []
    for b in range(256):
        c = b << 8
        for _ in range(8):
            c = (c << 1) ^ (0x8005 if c & 0x8000 else 0)
        out.append(c & 0xFFFF)
    return out


CRC = _crc_table()


def crc16(data: bytes, c: int = 0xFFFF) -> int:
    """CRC-16 of the audio standard: polynomial 0x8005, from 0xFFFF, high bit first."""
    for b in data:
        c = ((c << 8) & 0xFFFF) ^ CRC[(c >> 8) ^ b]
    return c


class Header(NamedTuple):
    version: float
    layer: int
    protected: bool
    kbits: int
    rate: int
    mono: bool
    size: int
    samples: int

    @property
    def side(self) -> int:
        """Bytes of side information (Layer III)."""
        return (17 if self.mono else 32) if self.version == 1.0 else (9 if self.mono else 17)


_seen = Memo()


def header(word: bytes) -> Header | None:
    """The frame header in four bytes; None if they are none (or of free format)."""
    if word not in _seen:
        if len(_seen) > 4096:
            _seen.clear()
        _seen[word] = _header(word)
    return _seen[word]


def _header(word: bytes) -> Header | None:
    if len(word) < 4 or word[0] != 0xFF or word[1] < 0xE0:
        return None
    version, layer = VERSIONS.get(word[1] >> 3 & 3), 4 - (word[1] >> 1 & 3)
    bits, rate = word[2] >> 4, word[2] >> 2 & 3
    if version is None or layer == 4 or bits in (0, 15) or rate == 3 or word[3] & 3 == 2:
        return None
    first = version == 1.0
    kbits, hz = KBITS[first, layer][bits], RATES[rate] // int({1.0: 1, 2.0: 2, 2.5: 4}[version])
    pad, samples = word[2] >> 1 & 1, SAMPLES[first, layer]
    size = (12 * kbits * 1000 // hz + pad) * 4 if layer == 1 else samples // 8 * kbits * 1000 // hz + pad
    return Header(version, layer, not word[1] & 1, kbits, hz, word[3] >> 6 == 3, size, samples)


def _synchsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def tags(data: bytes) -> tuple[dict[str, str], int, int]:
    """(tags, where audio begins, where it ends): ID3v2 text frames at the start, ID3v1 at the end."""
    found: dict[str, str] = {}
    at, end = 0, len(data)
    while data[at : at + 3] == b"ID3" and len(data) >= at + 10:
        major, flags, size = data[at + 3], data[at + 5], _synchsafe(data[at + 6 : at + 10])
        stop, i = min(len(data), at + 10 + size), at + 10
        if flags & 0x40 and stop - i >= 4:
            i += _synchsafe(data[i : i + 4]) if major == 4 else int.from_bytes(data[i : i + 4]) + 4
        while major in (3, 4) and i + 10 <= stop and data[i]:
            n = _synchsafe(data[i + 4 : i + 8]) if major == 4 else int.from_bytes(data[i + 4 : i + 8])
            name, body = data[i : i + 4].decode("latin-1"), data[i + 10 : min(stop, i + 10 + n)]
            if name[0] == "T" and body:
                text = body[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1"), "replace").rstrip("\0")
                key, _, value = text.partition("\0") if name == "TXXX" else (name, "", text)
                found[key] = value
            i += 10 + n
        at = min(len(data), at + 10 + size + (10 if flags & 0x10 and major == 4 else 0))
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        for key, lo, hi in (("title1", 3, 33), ("artist1", 33, 63), ("album1", 63, 93), ("year1", 93, 97)):
            if value := data[end + lo : end + hi].split(b"\0")[0].decode("latin-1").strip():
                found[key] = value
    return found, at, end


class Audio(NamedTuple):
    tags: dict[str, str]
    table: dict[str, object]
    offsets: list[int]
    sizes: list[int]
    samples: int
    duration: Fraction
    skipped: int
    checked: int
    wrong: int
    bodies: list[bytes]


def vbr_table(data: bytes, at: int, h: Header) -> dict[str, object]:
    """The Xing, Info or VBRI table in the frame at `at`; {} if it has none."""
    i = at + 4 + 2 * h.protected + h.side
    if data[i : i + 4] in (b"Xing", b"Info"):
        out: dict[str, object] = {"kind": data[i : i + 4].decode()}
        flags, i = int.from_bytes(data[i + 4 : i + 8]), i + 8
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[name], i = int.from_bytes(data[i : i + 4]), i + 4
        if flags & 4:
            out["toc"], i = list(data[i : i + 100]), i + 100
        if flags & 8:
            out["quality"] = int.from_bytes(data[i : i + 4])
        return out
    i = at + 36
    if data[i : i + 4] == b"VBRI" and len(data) >= i + 26:
        size, frames, n, scale, width, each = *struct.unpack(">II", data[i + 10 : i + 18]), *struct.unpack(">HHHH", data[i + 18 : i + 26])
        toc = [int.from_bytes(data[i + 26 + k * width : i + 26 + (k + 1) * width]) * scale for k in range(n)]
        return {"kind": "VBRI", "bytes": size, "frames": frames, "toc": toc, "frames_each": each}
    return {}


def read(data: bytes | None) -> Audio:
    """All frames of a stream, with what stands before, between and after them left out."""
    data = data or b""
    found, at, end = tags(data)
    kind, table, samples, rates, skipped, checked, wrong = None, {}, 0, {}, 0, 0, 0
    offsets, sizes, bodies = [], [], []
    while at + 4 <= end:
        h = header(data[at : at + 4])
        same = h and (h.version, h.layer, h.rate)
        follows = h and at + h.size <= end and (at + h.size == end or kind == same and bool(offsets) and offsets[-1] + sizes[-1] == at or (n := header(data[at + h.size : at + h.size + 4])) is not None and (n.version,
            n.layer, n.rate) == same)
        if not follows or kind and kind != same:
            to = data.find(b"\xff", at + 1, end)
            to = end if to < 0 else to
            skipped, at = skipped + to - at, to
            continue
        kind = same
        if h.layer == 3 and h.protected:
            checked += 1
            own = crc16(data[at + 2 : at + 4] + data[at + 6 : at + 6 + h.side])
            wrong += own != int.from_bytes(data[at + 4 : at + 6])
        if h.layer == 3 and not offsets and not table and (table := vbr_table(data, at, h)):
            at += h.size  # a frame with a table has no sound
            continue
        offsets.append(at)
        sizes.append(h.size)
        samples += h.samples
        rates[h.rate] = rates.get(h.rate, 0) + h.samples
        bodies.append(data[at + 4 + 2 * h.protected + (h.side if h.layer == 3 else 0) : at + h.size])
        at += h.size
    skipped += max(0, end - at)
    return Audio(found, table, offsets, sizes, samples, sum((Fraction(n, r) for r, n in rates.items()), Fraction(0)), skipped, checked, wrong, bodies)


# The writer's streams: MPEG-1 Layer III, protected, 32 kHz, two channels.
_BITS = KBITS[True, 3]
_ROOM = {k: 144 * k * 1000 // 32000 - 4 - 2 - 32 for k in _BITS[1:]}
#: Main data bytes of the largest frame.
FULL = _ROOM[320]


def _frame(kbits: int, body: bytes, side: bytes = bytes(32)) -> bytes:
    tail = bytes([_BITS.index(kbits) << 4 | 2 << 2, 0])
    return b"\xff\xfa" + tail + crc16(tail + side).to_bytes(2) + side + body + bytes(_ROOM[kbits] - len(body))


def _text_frame(name: bytes, text: bytes) -> bytes:
    n = len(text) + 1
    return name + bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127]) + b"\0\0\x03" + text


def write(payload: bytes) -> bytes:
    """A stream whose frames carry the payload: a tag with its length, a frame with the table of
    frames, bytes and seek points, full frames, a last one of the least bit rate that holds the rest,
    and an empty tag at the end, so that none is found in the payload."""
    bodies = [payload[i : i + FULL] for i in range(0, len(payload), FULL)]
    kbits = [next(k for k in _BITS[1:] if _ROOM[k] >= len(b)) for b in bodies]
    sound = [_frame(k, b) for k, b in zip(kbits, bodies)]
    size = len(_frame(64, b"")) + sum(map(len, sound))
    ends = [0]
    for f in sound:
        ends.append(ends[-1] + len(f))
    toc = bytes(min(255, 256 * (size - ends[-1] + ends[p * len(sound) // 100]) // size) for p in range(100))
    # the table lies where main data begin, behind the side information
    table = b"Xing" + struct.pack(">III", 7, len(sound), size) + toc
    tag = _text_frame(b"TSSE", b"tidemark") + _text_frame(b"TXXX", b"payload\0%d" % len(payload))
    n = len(tag)
    return b"ID3\x04\0\0" + bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127]) + tag + _frame(64,
        table) + b"".join(sound) + b"TAG" + bytes(124) + b"\xff"


def payload_of(audio: Audio) -> bytes:
    """What write() was given."""
    return b"".join(audio.bodies)[: int(audio.tags["payload"])]


def padded(text: bytes, unit: int = 64) -> bytes:
    """Bytes 0 appended up to a positive multiple of the unit."""
    return text + bytes(max(unit, -(-len(text) // unit) * unit) - len(text))


READ_SCHEMA = "duration_num bigint, duration_den bigint, frames bigint, samples bigint, skipped bigint, checked bigint, wrong bigint, table_kind string, table_frames bigint, table_bytes bigint, tags array<string>, offsets array<bigint>"


def read_column(df: DataFrame, *, column: str = "media", key: str = "doc_id") -> DataFrame:
    """(key and what the stream of each row holds): the exact duration in seconds as a fraction,
    and the byte offset of every frame, in order, for seeking."""

    def parsed(part: pa.RecordBatch) -> list:
        found = [read(b) for b in part.column(column).to_pylist()]
        rows = [(a.duration.numerator, a.duration.denominator, len(a.offsets), a.samples, a.skipped, a.checked, a.wrong,
            a.table.get("kind"), a.table.get("frames"), a.table.get("bytes"), [f"{k}={v}" for k, v in sorted(a.tags.items())], a.offsets) for a in found]
        return [part.column(key), *map(list, zip(*rows, strict=True))]

    kind = df.schema[key].dataType.simpleString()
    return mapped(df.select(key, column), parsed, f"{key} {kind}, {READ_SCHEMA}", column=column)


def store_texts(docs: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, media): every whole text, padded, as a stream."""

    def stored(part: pa.RecordBatch) -> list:
        raw = [(t or "").encode() for t in part.column("text").to_pylist()]
        return [part.column(key), [len(b) for b in raw], [write(padded(b)) for b in raw]]

    kind = docs.schema[key].dataType.simpleString()
    return mapped(docs.select(key, "text"), stored, f"{key} {kind}, n_bytes bigint, media binary")


FEATURES_SCHEMA = "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, seek_offsets array<bigint>"


def media_features(media: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, ...) read back from the stored bytes alone; fails on a wrong checksum."""

    def features(part: pa.RecordBatch) -> list:
        rows = []
        for data in part.column("media").to_pylist():
            audio = read(data)
            if audio.wrong or audio.skipped or audio.table.get("frames") != len(audio.offsets):
                raise ValueError(f"stored stream is damaged: {audio.wrong} checksums, {audio.skipped} bytes skipped")
            body = payload_of(audio)
            feature = f"mpeg1/3;frames={len(audio.offsets)};samples={audio.samples};seconds={audio.duration};crc={audio.checked - audio.wrong}/{audio.checked};seek={audio.offsets[0]}-{audio.offsets[-1]};table={audio.table['kind']}:{audio.table['bytes']}"
            rows.append((len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-64:]), len(data), hashlib.sha256(data).hexdigest(),
                feature, audio.offsets))
        return [part.column(key), part.column("n_bytes"), *map(list, zip(*rows, strict=True))]

    kind = media.schema[key].dataType.simpleString()
    return mapped(media.select(key, "n_bytes", "media"), features, f"{key} {kind}, n_bytes bigint, {FEATURES_SCHEMA}", column="media")
