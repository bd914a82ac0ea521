"""Media columns: declared types checked against signatures, and embedded media carved.

Aho-Corasick finds the magic bytes of all formats in one pass over a blob. A validator of
each format then walks its structure (chunk sizes, checksums, ends) from there, so that
a magic number that occurs by chance is no find and a find has an exact length.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT = 576  # payloads are padded to a multiple of so many bytes
RATE = 8_000


class Blob(bytes):
    """Bytes that remember where a pattern stands next, so that many magic numbers in one blob
    cost one search in all."""

    def next(self, pattern: bytes, at: int) -> int:
        known = self.__dict__.setdefault("known", {})
        since, place = known.get(pattern, (0, -2))
        if place == -2 or at < since or -1 < place < at:
            known[pattern] = since, place = at, self.find(pattern, at)
        return place


@dataclass(frozen=True)
class Found:
    """A validated medium: type, place in the blob, and what its header says."""

    kind: str
    start: int
    end: int
    detail: str


def _wav(b: bytes, at: int) -> tuple[int, str] | None:
    if len(b) < at + 44 or b[at + 8 : at + 12] != b"WAVE":
        return None
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    form, p = None, at + 12
    if end > len(b):
        return None
    while p + 8 <= end:
        name, size = b[p : p + 4], struct.unpack_from("<I", b, p + 4)[0]
        if p + 8 + size > end:
            return None
        if name == b"fmt " and size >= 16:
            form = struct.unpack_from("<HHIIHH", b, p + 8)
        if name == b"data":
            if form is None or not form[1] or form[4] != form[1] * form[5] // 8:
                return None
            return end, f"channels={form[1]};rate={form[2]};bits={form[5]};bytes={size}"
        p += 8 + size + size % 2
    return None


def _bmp(b: bytes, at: int) -> tuple[int, str] | None:
    if len(b) < at + 54:
        return None
    size, _, _, offset, head, width, height, planes, bits = struct.unpack_from("<IHHIIiiHH", b, at + 2)
    if planes != 1 or bits not in (1, 4, 8, 16, 24, 32) or width <= 0 or height == 0 or head < 40 or at + size > len(b):
        return None
    row = (width * bits + 31) // 32 * 4
    return (at + size, f"width={width};height={abs(height)};bits={bits}") if offset + row * abs(height) == size else None


def _png(b: bytes, at: int) -> tuple[int, str] | None:
    p, detail = at + 8, ""
    while p + 12 <= len(b):
        size, name = struct.unpack_from(">I4s", b, p)
        if p + 12 + size > len(b) or zlib.crc32(b[p + 4 : p + 8 + size]) != struct.unpack_from(">I", b, p + 8 + size)[0]:
            return None
        if name == b"IHDR":
            width, height, bits, color = struct.unpack_from(">IIBB", b, p + 8)
            detail = f"width={width};height={height};bits={bits};color={color}"
        p += 12 + size
        if name == b"IEND":
            return (p, detail) if detail else None
        if not detail:
            return None
    return None


def _gif(b: bytes, at: int) -> tuple[int, str] | None:
    if len(b) < at + 14 or b[at + 3 : at + 6] not in (b"87a", b"89a"):
        return None
    width, height, flags = struct.unpack_from("<HHB", b, at + 6)
    p = at + 13 + (3 << (flags & 7) + 1 if flags & 128 else 0)

    def blocks(p: int) -> int:
        while p < len(b) and b[p]:
            p += b[p] + 1
        return p + 1

    while p < len(b):
        if b[p] == 0x3B:
            return p + 1, f"width={width};height={height}"
        if b[p] == 0x21:
            p = blocks(p + 2)
        elif b[p] == 0x2C and p + 10 <= len(b):
            p = blocks(p + 11 + (3 << (b[p + 9] & 7) + 1 if b[p + 9] & 128 else 0))
        else:
            return None
    return None


def _jpeg(b: Blob, at: int) -> tuple[int, str] | None:
    p, detail = at + 2, ""
    while p + 4 <= len(b) and b[p] == 0xFF:
        mark, size = b[p + 1], struct.unpack_from(">H", b, p + 2)[0]
        if 0xC0 <= mark <= 0xC2 and p + 9 <= len(b):
            height, width = struct.unpack_from(">HH", b, p + 5)
            detail = f"width={width};height={height}"
        if mark == 0xDA:
            end = b.next(b"\xff\xd9", p + 2 + size)
            return (end + 2, detail) if end >= 0 and detail else None
        p += 2 + size
    return None


def _pdf(b: Blob, at: int) -> tuple[int, str] | None:
    end, start = b.next(b"%%EOF", at), b.next(b"startxref", at)
    return (end + 5, f"version={b[at + 5 : at + 8].decode('ascii', 'replace')}") if 0 <= start < end else None


def _gzip(b: bytes, at: int) -> tuple[int, str] | None:
    if len(b) < at + 18 or b[at + 2] != 8 or b[at + 3] & 0xE0:
        return None
    undo, view, n, p = zlib.decompressobj(31), memoryview(b), 0, at
    try:
        while not undo.eof:
            part = undo.unconsumed_tail
            if not part:
                part, p = view[p : p + (1 << 14)], p + (1 << 14)
                if not part:
                    return None
            n += len(undo.decompress(part, 1 << 20))
    except zlib.error:
        return None
    return min(p, len(b)) - len(undo.unused_data), f"bytes={n}"


#: Magic bytes of each format.
FORMATS: tuple[tuple[str, bytes, Callable[[Blob, int], tuple[int, str] | None]], ...] = (
    ("audio/wav", b"RIFF", _wav),
    ("image/bmp", b"BM", _bmp),
    ("image/png", b"\x89PNG\r\n\x1a\n", _png),
    ("image/gif", b"GIF8", _gif),
    ("image/jpeg", b"\xff\xd8\xff", _jpeg),
    ("application/pdf", b"%PDF-", _pdf),
    ("application/gzip", b"\x1f\x8b\x08", _gzip),
)


def _machine(cache: list = []) -> ahocorasick.Automaton:  # noqa: B006
    if not cache:
        made = ahocorasick.Automaton()
        for kind, magic, check in FORMATS:
            made.add_word(magic.decode("latin-1"), (kind, len(magic), check))
        made.make_automaton()
        cache.append(made)
    return cache[0]


def sniff(blob: bytes) -> list[Found]:
    """All validated media of a blob that don't lie within an earlier one, by place."""
    found, upto, blob = [], 0, Blob(blob)
    for last, (kind, size, check) in _machine().iter(blob.decode("latin-1")):
        start = last - size + 1
        if start < upto:
            continue
        held = check(blob, start)
        if held:
            found.append(Found(kind, start, held[0], held[1]))
            upto = held[0]
    return found


def _pieces(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that few blobs are held at once."""
    for batch in batches:
        yield from (batch.slice(at, rows) for at in range(0, batch.num_rows, rows))


def inspect(rows: DataFrame, blob: str = "media", declared: str = "declared_type") -> DataFrame:
    """rows with detected_type (of a medium at place 0, else of the first carved one, else
    null), corrected (declared type differs from it) and carved: type, start, end and
    detail of every medium found in the blob.

    A null or empty blob has none; a null declared type is corrected by any detected one.
    Columns of these names in rows are replaced.
    """
    new = ("detected_type", "corrected", "carved")
    kept = [c for c in rows.columns if c not in new]
    schema = rows.select(*kept).schema
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + ", detected_type string, corrected boolean, carved array<struct<type:string,start:long,end:long,detail:string>>"
    carved = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("detail", pa.string())]))

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            finds = [sniff(x or b"") for x in batch.column(blob).to_pylist()]
            kinds = [f[0].kind if f else None for f in finds]
            told = batch.column(declared).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(kinds, pa.string()), pa.array([k is not None and k != d for k, d in zip(kinds, told, strict=True)], pa.bool_()), pa.array([[{"type": x.kind, "start": x.start, "end": x.end, "detail": x.detail} for x in f] for f in finds], carved)],
                names=[*batch.schema.names, *new],
            )

    return rows.select(*kept).mapInArrow(seen, out)


def to_wav(payload: bytes) -> bytes:
    """The bytes as unsigned 8-bit mono samples."""
    pad = len(payload) % 2
    data = b"data" + struct.pack("<I", len(payload)) + payload + b"\0" * pad
    body = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


def samples(wav: bytes) -> bytes:
    """The samples of a RIFF file, found by its chunks."""
    p = 12
    while p + 8 <= len(wav):
        size = struct.unpack_from("<I", wav, p + 4)[0]
        if wav[p : p + 4] == b"data":
            return wav[p + 8 : p + 8 + size]
        p += 8 + size + size % 2
    raise ValueError("no samples")


#: What a sound may come with, by the checksum of its payload: nothing, the headers of a
#: mail part before it, a cover (a picture of one point) before it and a note behind it.
_COVER = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + b"\0\0\0\xff\xff\xff" + b"," + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02D\x01\0;"
_FRAMES = ((b"", b""), (b"Content-Transfer-Encoding: binary\r\n\r\n", b""), (_COVER, b"-- end of part --"))
#: What it is declared to be: what it is, something else, too little, nothing.
_DECLARED = ("audio/wav", "image/png", "application/octet-stream", None)


def stored(payload: bytes) -> tuple[bytes, str | None]:
    """The stored form of a payload, and its declared type; equal payloads give equal ones."""
    kind = zlib.crc32(payload)
    before, after = _FRAMES[kind % len(_FRAMES)]
    return before + to_wav(payload) + after, _DECLARED[kind // len(_FRAMES) % len(_DECLARED)]


def pack(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (texts as 8-bit sound, padded with 255 to units of 576, some of
    them within other bytes) and declared_type, which is right, wrong, too little or null.

    A null text is an empty one, which is stored as one unit of padding. Rows of null doc_id
    and repeated rows give rows each; an empty table gives an empty result."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            raw = [(x or "").encode() for x in batch.column("text").to_pylist()]
            media = [stored(x + b"\xff" * (-len(x) % UNIT if x else UNIT)) for x in raw]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) for x in raw], pa.int64()), pa.array([m for m, _ in media], pa.binary()), pa.array([d for _, d in media], pa.string())], names=["doc_id", "n_bytes", "media", "declared_type"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(packed, "doc_id long, n_bytes long, media binary, declared_type string")


def feature(payload: bytes) -> str:
    """Sound features of the samples: energy, crossings of the middle line, peak, and a
    hash of which tenths are louder than the whole. Without samples all are 0."""
    if not payload:
        return f"energy=0;crossings=0;peak=0;loud={'0' * 10}"
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    parts = np.array([int(np.abs(p).sum()) * 10 for p in np.array_split(x, 10)])
    loud = "".join("1" if p > np.abs(x).sum() else "0" for p in parts)
    return f"energy={int((x * x).sum())};crossings={crossings};peak={int(np.abs(x).max())};loud={loud}"


def digest(media: DataFrame) -> DataFrame:
    """Per row of `inspect(pack(docs))`: what the stored bytes hold when read back through
    the sound that was found in them, the types, and n_carved, the media found.

    A row without a sound (a null or broken blob) has nulls for what would be read of it, and
    the bytes it has; repeated rows give rows each, and an empty table an empty result."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            rows = []
            for blob, carved in zip(batch.column("media").to_pylist(), batch.column("carved").to_pylist(), strict=True):
                sound = next((c for c in carved if c["type"] == "audio/wav"), None)
                own = (None, None) if blob is None else (len(blob), hashlib.sha256(blob).hexdigest())
                if sound is None:
                    rows.append((None, None, None, *own, None, len(carved)))
                    continue
                payload = samples(blob[sound["start"] : sound["end"]])
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), *own, f"{sound['type']};{sound['detail']};{feature(payload)}", len(carved)))
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_carved"]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32()]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "n_bytes")), *columns, *(batch.column(c) for c in ("detected_type", "corrected"))], names=["doc_id", "n_bytes", *names, "detected_type", "corrected"])

    return media.select("doc_id", "n_bytes", "media", "detected_type", "corrected", "carved").mapInArrow(
        read, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_carved int, detected_type string, corrected boolean"
    )
