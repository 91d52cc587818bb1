"""Media columns: what bytes really are, and what media lies inside them.

An Aho-Corasick automaton finds all magic byte strings in one pass. Where one stands, the validator of its format walks the
structure (chunks, pages, boxes, checksums where there are any) and returns the exact length, or None (a last MP4 box without
a size ends with the bytes; of a PDF whose offsets are wrong the first section is taken). The format confirmed
at the start of the bytes corrects a declared type; formats confirmed further in are carved as (type, offset, length),
first come, none inside another.

Defined cases: null bytes are none (declared type kept, nothing carved); a null text is stored as an empty payload; the
payload of a text of up to 4 GB fits (the size field of WAV); repeated rows give repeated rows; further columns are not used.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

UNIT = 64
RATE = 8000


class _Marks:
    """Where a validator's end marks stand, looked for once in all bytes, so many beginnings cost no search each."""

    def __init__(self, b: memoryview):
        self.b = b

    @cached_property
    def pdf_ends(self) -> list[tuple[int, int, int]]:
        """(begin, end, offset named there) of each complete tail."""
        return [(m.start(), m.end(), int(m[1])) for m in _PDF_END.finditer(self.b) if len(m[1]) < 20]

    @cached_property
    def pdf_tails(self) -> list[int]:
        return [m.start() for m in re.finditer(rb"startxref", self.b)]

    @cached_property
    def pdf_marks(self) -> list[int]:
        return [m.start() for m in re.finditer(rb"%%EOF", self.b)]

    @cached_property
    def pdf_owned(self) -> dict[int, list[int]]:
        """Beginning of a PDF -> the numbers of the tails that are its own: the last table before a tail lies as far behind the beginning as the tail says."""
        heads = {m.start() for m in _PDF_HEAD.finditer(self.b)}
        tables = [m.start() for m in re.finditer(rb"(?<!start)xref\b", self.b)]
        streams, objects = [m.start() for m in re.finditer(rb"/XRef\b", self.b)], [m.start() for m in re.finditer(rb"\b\d{1,10}\s{1,4}\d{1,5}\s{1,4}obj\b", self.b)]
        out: dict[int, list[int]] = {}
        for k, (begin, _, start) in enumerate(self.pdf_ends):
            places = [tables[i - 1] for i in (bisect_left(tables, begin),) if i]
            if i := bisect_left(streams, begin):
                places += [objects[j - 1] for j in (bisect_left(objects, streams[i - 1]),) if j]
            for place in places:
                if place - start in heads:
                    out.setdefault(place - start, []).append(k)
        return out

    @cached_property
    def pdf_unowned(self) -> list[int]:
        """The numbers of the tails of no beginning."""
        return sorted(set(range(len(self.pdf_ends))) - {k for own in self.pdf_owned.values() for k in own})

    @cached_property
    def archives(self) -> dict[int, int]:
        """Archive start -> length: an end record gives size and offset of its directory, which ends where the record begins."""
        b, out = self.b, {}
        far_records = [m.start() for m in re.finditer(rb"PK\x06\x06", b)]
        for found in re.finditer(rb"PK\x05\x06", b):
            end = found.start()
            if end + 22 > len(b):
                continue
            size, start, note = struct.unpack_from("<IIH", b, end + 12)
            last = end  # where the directory ends
            if end >= 76 and b[end - 20 : end - 16] == b"PK\x06\x07":  # 64-bit archives: a locator before the record, a longer record before that
                k = bisect_left(far_records, end - 75) - 1
                if k >= 0:
                    last = far_records[k]
                    size, start = struct.unpack_from("<QQ", b, last + 40)
                    if struct.unpack_from("<Q", b, end - 12)[0] != start + size:
                        continue
            begin = last - size - start
            if begin >= 0 and end >= begin + 30 and b[begin + start : begin + start + 4] == b"PK\x01\x02" and end + 22 + note <= len(b):
                out.setdefault(begin, end + 22 + note - begin)
        return out


def _riff(b: memoryview, at: int, marks: _Marks) -> tuple[str, int] | None:
    if at + 12 > len(b):
        return None
    size, kind = struct.unpack_from("<I", b, at + 4)[0] + 8, bytes(b[at + 8 : at + 12])
    if size < 12 or at + size > len(b) or kind not in (b"WAVE", b"WEBP", b"AVI "):
        return None
    p, seen = at + 12, set()
    while p + 8 <= at + size:
        seen.add(bytes(b[p : p + 4]))
        n = struct.unpack_from("<I", b, p + 4)[0]
        p += 8 + n + (n & 1)
    if p not in (at + size, at + size + 1) or kind == b"WAVE" and not {b"fmt ", b"data"} <= seen:
        return None
    return {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/avi"}[kind], size


def _png(b: memoryview, at: int, marks: _Marks) -> tuple[str, int] | None:
    p, first = at + 8, True
    while p + 12 <= len(b):
        n, kind = struct.unpack_from(">I", b, p)[0], bytes(b[p + 4 : p + 8])
        if p + 12 + n > len(b) or first and kind != b"IHDR" or zlib.crc32(b[p + 4 : p + 8 + n]) != struct.unpack_from(">I", b, p + 8 + n)[0]:
            return None
        p, first = p + 12 + n, False
        if kind == b"IEND":
            return "image/png", p - at
    return None


def _gif(b: memoryview, at: int, marks: _Marks) -> tuple[str, int] | None:
    if at + 13 > len(b):
        return None
    table = lambda flags: 3 << ((flags & 7) + 1) if flags & 0x80 else 0
    p = at + 13 + table(b[at + 10])
    while p < len(b):
        if b[p] == 0x3B:
            return "image/gif", p + 1 - at
        if b[p] == 0x21:
            p += 2
        elif b[p] == 0x2C and p + 10 < len(b):
            p += 11 + table(b[p + 9])
        else:
            return None
        while p < len(b) and b[p]:
            p += b[p] + 1
        p += 1
    return None


_JPEG_MARK = re.compile(rb"\xff[^\x00\xd0-\xd7]", re.DOTALL)


def _jpeg(b: memoryview, at: int, marks: _Marks) -> tuple[str, int] | None:
    p, scan = at + 2, False
    while p + 4 <= len(b):
        if b[p] != 0xFF:
            return None
        kind = b[p + 1]
        if kind == 0xD9:
            return ("image/jpeg", p + 2 - at) if scan else None
        n = struct.unpack_from(">H", b, p + 2)[0]
        if n < 2:
            return None
        p += 2 + n
        if kind == 0xDA:
            scan = True
            found = _JPEG_MARK.search(b, p)
            p = found.start() if found else max(p, len(b) - 1)
    if scan and p + 2 <= len(b) and bytes(b[p : p + 2]) == b"\xff\xd9":
        return "image/jpeg", p + 2 - at
    return None


def _bmp(b: memoryview, at: int, marks: _Marks) -> tuple[str, int] | None:
    if at + 26 > len(b):
        return None
    size, zero, pixels, header = struct.unpack_from("<IIII", b, at + 2)
    ok = zero == 0 and header in (12, 40, 52, 56, 64, 108, 124) and 14 + header <= pixels <= size and at + size <= len(b)
    return ("image/bmp", size) if ok else None


_PDF_HEAD = re.compile(rb"%PDF-\d\.\d")
_PDF_END = re.compile(rb"startxref\s+(\d+)\s+%%EOF")
_PDF_TABLE = re.compile(rb"xref\b|\d+\s+\d+\s+obj\b(?:(?!stream).)*?/XRef\b", re.DOTALL)


def _pdf(b: memoryview, at: int, marks: _Marks) -> tuple[str, int] | None:
    """To the end mark of the last section: a later one counts if it is this file's own and its table was written after the section before. In a linearised file the second one names the table of the first section, so it is looked for there."""
    if not _PDF_HEAD.match(b, at):
        return None
    size, first = 0, bisect_left(marks.pdf_ends, (at,))
    if first < len(marks.pdf_ends):
        size = marks.pdf_ends[first][1] - at
        if b"/Linearized" in bytes(b[at : at + 1024]):
            k = bisect_left(marks.pdf_unowned, first + 1)
            begin, end, start = marks.pdf_ends[marks.pdf_unowned[k]] if k < len(marks.pdf_unowned) else (0, 0, 0)
            if at + start < begin and _PDF_TABLE.match(b, at + start, begin):
                size = end - at
        for k in marks.pdf_owned.get(at, ()):
            begin, end, start = marks.pdf_ends[k]
            if k > first and start >= size and _PDF_TABLE.match(b, at + start, begin):
                size = end - at
    if not size:
        k = bisect_left(marks.pdf_tails, at)
        e = bisect_left(marks.pdf_marks, marks.pdf_tails[k]) if k < len(marks.pdf_tails) else len(marks.pdf_marks)
        size = marks.pdf_marks[e] + 5 - at if e < len(marks.pdf_marks) else 0
    return ("application/pdf", size) if size else None


def _gzip(b: memoryview, at: int, marks: _Marks) -> tuple[str, int] | None:
    d = zlib.decompressobj(31)
    p = at
    try:
        while p < len(b) and not d.eof:  # the output of a step is bounded, and dropped
            step = d.unconsumed_tail or bytes(b[p : p + 65536])
            p += 0 if d.unconsumed_tail else len(step)
            d.decompress(step, 1 << 20)
    except zlib.error:
        return None
    return ("application/gzip", p - len(d.unused_data) - at) if d.eof else None


def _zip(b: memoryview, at: int, marks: _Marks) -> tuple[str, int] | None:
    """To the end record that names this place as the archive's start."""
    size = marks.archives.get(at)
    return ("application/zip", size) if size else None


def _ogg(b: memoryview, at: int, marks: _Marks) -> tuple[str, int] | None:
    p = at
    while p + 27 <= len(b) and bytes(b[p : p + 5]) == b"OggS\0":
        n = b[p + 26]
        if p + 27 + n > len(b):
            return None
        last = b[p + 5] & 4
        p += 27 + n + sum(b[p + 27 : p + 27 + n])
        if p > len(b):
            return None
        if last:
            return "audio/ogg", p - at
    return None


_LAST_BOX = {b"mdat", b"moov", b"moof", b"mfra", b"meta", b"free", b"skip", b"wide", b"uuid", b"udta", b"sidx", b"ssix", b"styp", b"pdin"}


def _mp4(b: memoryview, at: int, marks: _Marks) -> tuple[str, int] | None:
    p, seen = at, set()
    while p + 8 <= len(b):
        n, kind, least = struct.unpack_from(">I", b, p)[0], bytes(b[p + 4 : p + 8]), 8
        if n == 1 and p + 16 <= len(b):  # a 64-bit size after the kind
            n, least = struct.unpack_from(">Q", b, p + 8)[0], 16
        elif n == 0 and seen and kind in _LAST_BOX:  # to the end of the bytes; zeros behind a file are no box
            n = len(b) - p
        if n < least or p + n > len(b) or not kind.isalnum():
            break
        p += n
        seen.add(kind)
    return ("video/mp4", p - at) if {b"ftyp", b"moov"} <= seen else None


#: Magic bytes, where they stand in the format, its validator.
MAGIC = (
    (b"RIFF", 0, _riff), (b"\x89PNG\r\n\x1a\n", 0, _png), (b"GIF87a", 0, _gif), (b"GIF89a", 0, _gif), (b"\xff\xd8\xff", 0, _jpeg), (b"BM", 0, _bmp),
    (b"%PDF-", 0, _pdf), (b"\x1f\x8b\x08", 0, _gzip), (b"PK\x03\x04", 0, _zip), (b"OggS", 0, _ogg), (b"ftyp", 4, _mp4),
)
_AUTOMATON = None


def _automaton():
    global _AUTOMATON
    if _AUTOMATON is None:
        import ahocorasick

        a = ahocorasick.Automaton()
        for magic, offset, check in MAGIC:
            a.add_word(magic.decode("latin-1"), (len(magic) - 1 + offset, check))
        a.make_automaton()
        _AUTOMATON = a
    return _AUTOMATON


def sniff(data: bytes | None, declared: str | None = None, carve: bool = True) -> dict:
    """The confirmed type of ``data`` (else the declared one), whether that corrects it, and the media carved from inside it."""
    found = {"type": declared, "corrected": False, "length": None, "embedded": []}
    if not data:
        return found
    view, past = memoryview(data), 0
    marks = _Marks(view)
    for end, (back, check) in _automaton().iter(data.decode("latin-1")):
        at = end - back
        if at < 0 or at < past and at > 0 or at > 0 and not carve:
            continue
        confirmed = check(view, at, marks)
        if confirmed is None:
            continue
        if at == 0:
            found |= {"type": confirmed[0], "corrected": confirmed[0] != declared, "length": confirmed[1]}
        else:
            found["embedded"].append((confirmed[0], at, confirmed[1]))
            past = at + confirmed[1]
    return found


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 with bytes 0 up to a positive multiple of UNIT; the length without them."""
    b = (text or "").encode("utf-8", "surrogatepass")
    return b.ljust(max(UNIT, -(-len(b) // UNIT) * UNIT), b"\0"), len(b)


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    """8-bit mono PCM: a sample is a byte."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples)) + samples


def from_wav(stored: bytes) -> bytes:
    """The samples of an 8-bit PCM file, found by walking its chunks."""
    p = 12
    while p + 8 <= len(stored):
        kind, n = struct.unpack_from("<4sI", stored, p)
        if kind == b"data":
            return stored[p + 8 : p + 8 + n]
        p += 8 + n + (n & 1)
    raise ValueError("no data chunk")


def features(stored: bytes, declared: str) -> tuple[bytes, str]:
    """The samples read back from stored bytes, and a line that says what they are."""
    found, samples = sniff(stored, declared), from_wav(stored)
    x = np.frombuffer(samples, np.uint8)
    crossings = int(np.count_nonzero(np.diff((x >= 128).view(np.int8))))
    inside = ",".join(f"{kind}@{at}+{n}" for kind, at, n in found["embedded"])
    return samples, f"{found['type']};corrected={int(found['corrected'])};length={found['length']};samples={len(x)};min={x.min()};max={x.max()};sum={int(x.sum(dtype=np.int64))};crossings={crossings};embedded={inside}"


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column(1):
            payload, n = payload_of(text.as_py())
            stored = to_wav(payload)
            samples, line = features(stored, "application/octet-stream")
            rows.append((n, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-UNIT:]), len(stored), hashlib.sha256(stored).hexdigest(), line))
        columns = list(zip(*rows, strict=True)) or [()] * 7
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=[x.split()[0] for x in SCHEMA.split(", ")])


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text stored as 8-bit WAV, read back, sniffed and described."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(_described, SCHEMA)


def _sniffed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [sniff(data.as_py(), declared.as_py()) for data, declared in zip(batch.column(1), batch.column(2), strict=True)]
        carved = pa.list_(pa.struct([("type", pa.string()), ("at", pa.int64()), ("length", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([x["type"] for x in out], pa.string()), pa.array([x["corrected"] for x in out], pa.bool_()), pa.array([x["length"] for x in out], pa.int64()), pa.array([[dict(zip(("type", "at", "length"), e, strict=True)) for e in x["embedded"]] for x in out], carved)],
            names=["id", "type", "corrected", "length", "embedded"],
        )


def sniffed(media: DataFrame, id_col: str, data_col: str, declared_col: str) -> DataFrame:
    """(id, type, corrected, length, embedded) of a binary column with declared types."""
    rows = media.select(media[id_col].cast("long").alias("id"), media[data_col].alias("data"), media[declared_col].cast("string").alias("declared"))
    return rows.mapInArrow(_sniffed, "id long, type string, corrected boolean, length long, embedded array<struct<type:string,at:long,length:long>>")


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(spark.read.parquet(f"{sf_dir}/documents.parquet"))
