"""Media columns by signature sniffing.

One Aho-Corasick pass finds every magic number in a blob; a validator per format
then confirms the structure (chunk walks, block walks, checksums, lengths) and
gives the exact extent. The outermost valid media that starts a blob corrects
its declared type; other valid media, not inside one already found, are carved.

Edge cases: a null blob is an empty one and has type application/octet-stream.
Chance signatures without valid structure are counted and dropped. Truncated
media aren't carved. Equal blobs give equal rows. A blob is scanned whole, of any
length: validators that look for an end (zip, pdf) find it in tables made in one
pass, and a walk over the blocks of a gif, jpeg or png stops where an earlier one
came through and failed. Rows that repeat each come out; of signatures at one place
the longest valid one counts. An empty table gives an empty result. Only the
columns named are read, so others can't clash.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

UNKNOWN = "application/octet-stream"
#: Payload sizes of the digest are positive multiples of this, padded with PAD.
UNIT, PAD = 576, b"\xff"
RATE = 8000


class Blob:
    """Bytes, with where the ends of zip and pdf files are and where walks have failed; each is found once."""

    def __init__(self, raw: bytes) -> None:
        self.raw = raw
        self.failed: set[tuple] = set()

    @cached_property
    def archives(self) -> dict[int, int]:
        """Start of an archive -> its extent, by the end records that point at their start."""
        b, out = self.raw, {}
        for end in self.places(b"PK\x05\x06"):
            if end + 22 <= len(b):
                n, start, note = struct.unpack_from("<IIH", b, end + 12)
                at = end - start - n
                if at >= 0 and end + 22 + note <= len(b):
                    out.setdefault(at, end + 22 + note - at)
        return out

    @cached_property
    def pdf_ends(self) -> list[int]:
        return self.places(b"%%EOF")

    @cached_property
    def pdf_tables(self) -> list[int]:
        return self.places(b"startxref")

    def places(self, what: bytes) -> list[int]:
        return [m.start() for m in re.finditer(re.escape(what), self.raw)]

    def walk(self, kind: str, steps: Iterator[tuple]) -> int:
        """The end of the media that ``steps`` walks through, or 0; each step is a state, the last one True and its end."""
        seen = []
        for state in steps:
            if state[0] is True:
                return state[1]
            state = (kind, *state)
            if state in self.failed:
                break
            seen.append(state)
        self.failed.update(seen)
        return 0


def _riff(blob: Blob, at: int) -> int:
    """Extent of a RIFF/WAVE file with a fmt chunk before its data chunk, or 0."""
    b = blob.raw
    if len(b) - at < 12 or b[at + 8 : at + 12] != b"WAVE":
        return 0
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    if end > len(b):
        return 0

    def steps() -> Iterator[tuple]:
        p, fmt, data = at + 12, False, False
        while p + 8 <= end:
            yield p, end, fmt, data
            kind, n = struct.unpack_from("<4sI", b, p)
            fmt = fmt or kind == b"fmt "
            data = data or (fmt and kind == b"data")
            p += 8 + n + (n & 1)
        if p == end and data:
            yield True, end

    stop = blob.walk("wav", steps())
    return stop - at if stop else 0


def _png(blob: Blob, at: int) -> int:
    b = blob.raw

    def steps() -> Iterator[tuple]:
        p, first = at + 8, True
        while p + 12 <= len(b):
            yield p, first
            n, kind = struct.unpack_from(">I4s", b, p)
            if p + 12 + n > len(b) or (first and (kind != b"IHDR" or n != 13)):
                return
            if zlib.crc32(memoryview(b)[p + 4 : p + 8 + n]) != struct.unpack_from(">I", b, p + 8 + n)[0]:
                return
            first, p = False, p + 12 + n
            if kind == b"IEND":
                yield True, p

    stop = blob.walk("png", steps())
    return stop - at if stop else 0


def _gif(blob: Blob, at: int) -> int:
    b = blob.raw
    if len(b) - at < 13:
        return 0

    def steps() -> Iterator[tuple]:
        flags = b[at + 10]
        p = at + 13 + (3 << (flags & 7) + 1 if flags & 0x80 else 0)
        images = False
        while p < len(b):
            yield p, images
            if b[p] == 0x3B:
                if images:
                    yield True, p + 1
                return
            if b[p] == 0x21 and p + 2 < len(b):
                p += 2
            elif b[p] == 0x2C and p + 10 < len(b):
                f = b[p + 9]
                p += 11 + (3 << (f & 7) + 1 if f & 0x80 else 0)
                images = True
            else:
                return
            while p < len(b) and b[p]:
                yield p, "data", images
                p += 1 + b[p]
            p += 1

    stop = blob.walk("gif", steps())
    return stop - at if stop else 0


def _jpeg(blob: Blob, at: int) -> int:
    b = blob.raw

    def steps() -> Iterator[tuple]:
        p, scans = at + 2, False
        while p + 4 <= len(b):
            yield p, scans
            if b[p] != 0xFF or b[p + 1] in (0x00, 0xFF):
                return
            kind = b[p + 1]
            if kind == 0xD9:
                if scans:
                    yield True, p + 2
                return
            n = struct.unpack_from(">H", b, p + 2)[0]
            if n < 2:
                return
            p += 2 + n
            if kind == 0xDA:
                scans = True
                while (p := b.find(b"\xff", p)) >= 0 and p + 1 < len(b) and (b[p + 1] == 0 or 0xD0 <= b[p + 1] <= 0xD7):
                    yield p, "scan"
                    p += 2
                if p < 0 or p + 1 >= len(b):
                    return
                if b[p + 1] == 0xD9:
                    yield True, p + 2

    stop = blob.walk("jpeg", steps())
    return stop - at if stop else 0


def _bmp(blob: Blob, at: int) -> int:
    b = blob.raw
    if len(b) - at < 54:
        return 0
    size, reserved, start, header = struct.unpack_from("<IIII", b, at + 2)
    planes, depth = struct.unpack_from("<HH", b, at + 26)
    ok = header in (40, 52, 56, 108, 124) and reserved == 0 and planes == 1 and depth in (1, 4, 8, 16, 24, 32) and 14 + header <= start < size <= len(b) - at
    return size if ok else 0


def _zip(blob: Blob, at: int) -> int:
    return blob.archives.get(at, 0)


def _pdf(blob: Blob, at: int) -> int:
    """To the first end mark, if a cross-reference table stands before it."""
    ends, tables = blob.pdf_ends, blob.pdf_tables
    i = bisect_left(ends, at)
    j = bisect_left(tables, at)
    return ends[i] + 5 - at if i < len(ends) and j < len(tables) and tables[j] < ends[i] else 0


#: Magic bytes, media type, validator (extent from an offset, or 0).
FORMATS: tuple[tuple[bytes, str, Callable[[Blob, int], int]], ...] = (
    (b"RIFF", "audio/wav", _riff),
    (b"\x89PNG\r\n\x1a\n", "image/png", _png),
    (b"GIF87a", "image/gif", _gif),
    (b"GIF89a", "image/gif", _gif),
    (b"\xff\xd8\xff", "image/jpeg", _jpeg),
    (b"BM", "image/bmp", _bmp),
    (b"PK\x03\x04", "application/zip", _zip),
    (b"%PDF-", "application/pdf", _pdf),
)

_SCAN = ahocorasick.Automaton()
for _i, (_magic, _, _) in enumerate(FORMATS):
    _SCAN.add_word(_magic.decode("latin-1"), (_i, len(_magic)))
_SCAN.make_automaton()


@dataclass(frozen=True)
class Found:
    media_type: str
    offset: int
    length: int


def sniff(blob: bytes | None) -> tuple[list[Found], int]:
    """Valid media in a blob, outermost ones only and in order, and the number of signatures that weren't valid."""
    known = Blob(blob or b"")
    found: list[Found] = []
    false, end = 0, 0
    for last, (i, n) in _SCAN.iter(known.raw.decode("latin-1")):
        at = last - n + 1
        if at < end:
            continue  # inside media already found
        extent = FORMATS[i][2](known, at)
        if extent:
            found.append(Found(FORMATS[i][1], at, extent))
            end = at + extent
        else:
            false += 1
    return found, false


def media_type(found: list[Found], declared: str | None = None) -> str:
    """The type of media that a blob begins with; else what was declared, unless that is a type whose structure can be checked."""
    if found and found[0].offset == 0:
        return found[0].media_type
    return declared if declared and declared not in {f[1] for f in FORMATS} else UNKNOWN


def _sniffed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for blob, declared in zip(b.column(1), b.column(2), strict=True):
            raw = blob.as_py() or b""
            found, false = sniff(raw)
            rows.append((media_type(found, declared.as_py()), false, [{"media_type": f.media_type, "offset": f.offset, "content": raw[f.offset : f.offset + f.length]} for f in found if (f.offset, f.length) != (0, len(raw))]))
        carved = pa.list_(pa.struct([("media_type", pa.string()), ("offset", pa.int64()), ("content", pa.binary())]))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], carved)], names=["id", "media_type", "false_signatures", "carved"])


def sniff_column(df: DataFrame, id_: str, blob: str, declared: str) -> DataFrame:
    """id, corrected media_type, false_signatures and the embedded media carved from each blob."""
    d = df.select(F.col(id_).cast("long"), F.col(blob).cast("binary"), F.col(declared).cast("string"))
    return map_arrow(d, _sniffed, "id long, media_type string, false_signatures long, carved array<struct<media_type:string,offset:bigint,content:binary>>")


def store(payload: bytes) -> bytes:
    """A payload as the 8-bit samples of a mono WAVE file."""
    body = b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload + b"\0" * (len(payload) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WAVE" + body


def samples(media: bytes, found: Found) -> bytes:
    """The sample bytes of a WAVE file found in ``media``."""
    p, end = found.offset + 12, found.offset + found.length
    while p + 8 <= end:
        kind, n = struct.unpack_from("<4sI", media, p)
        if kind == b"data":
            return media[p + 8 : p + 8 + n]
        p += 8 + n + (n & 1)
    raise ValueError("no data chunk")


def digest(text: str | None) -> tuple:
    """What the digest query returns of one text, doc_id aside."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    payload = raw + PAD * ((-len(raw)) % UNIT or UNIT * (not raw))
    media = store(payload)
    found, false = sniff(media)
    kind = media_type(found, "application/pdf")
    back = samples(media, found[0])
    levels = np.frombuffer(back, np.uint8)
    inside = sniff(back)
    feature = f"{kind};false={false + inside[1]};carved={len(inside[0])};mean={levels.mean():.4f};deviation={levels.std():.4f};levels={len(np.unique(levels))}"
    return len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature


_COLUMNS = (("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [digest(t.as_py()) for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(_COLUMNS))], names=["doc_id", *(c for c, _ in _COLUMNS)])


def media_report(docs: DataFrame) -> DataFrame:
    """Every whole text stored as media, found again by its signature, validated and read back."""
    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), _digests, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
