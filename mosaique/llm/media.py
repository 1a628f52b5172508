"""Media columns: store bytes as media, tell a column's true types, carve what is embedded.

:func:`store` writes a text's UTF-8 bytes, padded with spaces to a positive
multiple of 192, losslessly as media: rows of 64 RGB pixels of a PNG or BMP
picture, or the samples of an 8-bit mono WAV sound; a checksum of the payload
chooses among them. :func:`sniff` judges any binary column: an Aho-Corasick
automaton finds the magic bytes of all formats in one scan, and a format's
validator confirms each find by its structure and lengths. The one at offset 0
names the value's type, whatever was declared; those further on that are whole
are carved, files within the value's own file among them. Ends of PDF and ZIP
files are collected in one pass over a value, so long values take linear time.

Rows: a null text is empty; a null or empty binary has no type and nothing
embedded. Null and repeated ids keep their rows. An empty table gives an empty
result. Other columns pass :func:`sniff` unchanged. Texts of any length are
stored whole. Fixed values are the formats' published signatures.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT, WIDTH, RATE = 192, 64, 8000
PNG, JPEG, GIF, BMP, WAV = "image/png", "image/jpeg", "image/gif", "image/bmp", "audio/wav"

# Magic bytes, their offset in a file, and the family whose validator they call.
MAGIC = [
    (b"\x89PNG\r\n\x1a\n", 0, "png"),
    (b"\xff\xd8\xff", 0, "jpeg"),
    (b"GIF87a", 0, "gif"),
    (b"GIF89a", 0, "gif"),
    (b"BM", 0, "bmp"),
    (b"RIFF", 0, "riff"),
    (b"%PDF-", 0, "pdf"),
    (b"PK\x03\x04", 0, "zip"),
    (b"\x1f\x8b\x08", 0, "gzip"),
    (b"fLaC", 0, "flac"),
    (b"OggS", 0, "ogg"),
    (b"ftyp", 4, "mp4"),
    (b"II*\x00", 0, "tiff"),
    (b"MM\x00*", 0, "tiff"),
]

Found = tuple[str, int, str]  # type, length, detail


def _png(b: bytes, at: int) -> Found | None:
    """Chunks with right checksums from a header to an end mark."""
    pos, size = at + 8, ""
    while pos + 12 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, pos)
        stop = pos + 12 + n
        if stop > len(b) or zlib.crc32(b[pos + 4 : stop - 4]) != struct.unpack_from(">I", b, stop - 4)[0]:
            return None
        if (pos == at + 8) != (kind == b"IHDR"):
            return None
        if kind == b"IHDR":
            if n != 13:
                return None
            size = "{}x{}".format(*struct.unpack_from(">II", b, pos + 8))
        if kind == b"IEND":
            return PNG, stop - at, size
        pos = stop
    return None


def _jpeg(b: bytes, at: int) -> Found | None:
    """Segments of stated length up to a scan, then an end mark; a frame header gives the size."""
    pos, size = at + 2, ""
    while pos + 4 <= len(b) and b[pos] == 0xFF:
        mark = b[pos + 1]
        if mark == 0xFF:
            pos += 1
            continue
        (n,) = struct.unpack_from(">H", b, pos + 2)
        if n < 2 or pos + 2 + n > len(b):
            return None
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC) and n >= 8:
            high, wide = struct.unpack_from(">HH", b, pos + 5)
            size = f"{wide}x{high}"
        pos += 2 + n
        if mark == 0xDA:
            while (pos := b.find(b"\xff", pos)) >= 0 and pos + 1 < len(b):
                follow = b[pos + 1]
                if follow == 0xD9:
                    return (JPEG, pos + 2 - at, size) if size else None
                if follow and not 0xD0 <= follow <= 0xD7 and follow != 0xFF:
                    break  # another segment, as between the scans of a progressive picture
                pos += 1 if follow == 0xFF else 2
            if pos < 0:
                return None
    return None


def _gif(b: bytes, at: int) -> Found | None:
    """Blocks of stated length up to the trailer."""
    if at + 13 > len(b):
        return None
    wide, high, flags = struct.unpack_from("<HHB", b, at + 6)
    pos = at + 13 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0)
    while pos < len(b):
        kind = b[pos]
        if kind == 0x3B:
            return GIF, pos + 1 - at, f"{wide}x{high}"
        if kind == 0x21:
            pos += 2
        elif kind == 0x2C and pos + 10 <= len(b):
            local = b[pos + 9]
            pos += 11 + (3 << ((local & 7) + 1) if local & 0x80 else 0)
        else:
            return None
        while pos < len(b) and b[pos]:
            pos += b[pos] + 1
        pos += 1
    return None


def _bmp(b: bytes, at: int) -> Found | None:
    if at + 54 > len(b):
        return None
    size, zero, offset, head, wide, high, planes, depth, packed = struct.unpack_from("<IIIIiiHHI", b, at + 2)
    if zero or planes != 1 or head not in (40, 52, 56, 108, 124) or depth not in (1, 4, 8, 16, 24, 32):
        return None
    if wide <= 0 or not high or offset < 14 + head or at + size > len(b):
        return None
    if packed == 0 and offset + (wide * depth + 31) // 32 * 4 * abs(high) > size:
        return None
    return BMP, size, f"{wide}x{abs(high)}x{depth}"


def _riff(b: bytes, at: int) -> Found | None:
    """A form whose chunks fill its stated length."""
    if at + 12 > len(b):
        return None
    size, form = struct.unpack_from("<I4s", b, at + 4)
    stop = at + 8 + size
    kind = {b"WAVE": WAV, b"WEBP": "image/webp", b"AVI ": "video/avi"}.get(form)
    if kind is None or stop > len(b):
        return None
    pos, detail = at + 12, ""
    while pos + 8 <= stop:
        name, n = struct.unpack_from("<4sI", b, pos)
        if name == b"fmt " and n >= 16 and pos + 24 <= stop:
            _, channels, rate, _, _, depth = struct.unpack_from("<HHIIHH", b, pos + 8)
            detail = f"{channels}x{rate}x{depth}"
        pos += 8 + n + (n & 1)
    return (kind, size + 8, detail) if pos in (stop, stop + 1) else None


_PDF_PARTS = re.compile(rb"%PDF-(?=\d\.\d)|startxref\s{1,4}(\d{1,12})\s{1,4}%%EOF|(?<![a-z])xref|(?<!\d)\d{1,10} \d{1,5} obj")
_XREF = re.compile(rb"xref|\d{1,10} \d{1,5} obj")


def _pdf_ends(b: bytes) -> dict[int, int]:
    """Where each PDF of ``b`` ends, by the offset of its header: after the last ``%%EOF`` whose cross-reference
    table lies where ``startxref`` says, from that header.

    One pass; a table belongs to the header that its own place and offset point to, or to the last one
    open or closed, as in files whose last section refers to the first table (an offset of 0 refers to a later one).
    """
    ends: dict[int, int] = {}
    headers: set[int] = set()
    opened: list[int] = []
    table = closed = -1
    for m in _PDF_PARTS.finditer(b):
        what = m[0]
        if what.startswith(b"%PDF-"):
            headers.add(m.start())
            opened.append(m.start())
        elif not what.startswith(b"startxref"):
            table = m.start()
        else:
            offset = int(m[1])
            for at in (table - offset, opened[-1] if opened else -1, closed):
                if at in headers and offset and at + offset < m.start() and _XREF.match(b, at + offset):
                    ends[at] = m.end()
                    closed = at
                    while opened and opened[-1] >= at:  # what was opened within it was no file
                        opened.pop()
                    break
    return ends


def _zip_ends(b: bytes) -> dict[int, int]:
    """Where each archive of ``b`` ends, by its first offset: an end record tells where its directory and archive begin."""
    ends, e = {}, b.find(b"PK\x05\x06")
    while e >= 0 and e + 22 <= len(b):
        n, size, offset, note = struct.unpack_from("<HIIH", b, e + 10)
        at = e - size - offset
        if at >= 0 and 46 * n <= size and b[e - size : e - size + 4] == b"PK\x01\x02" and e + 22 + note <= len(b):
            ends[at] = e + 22 + note
        e = b.find(b"PK\x05\x06", e + 1)
    return ends


class _Ends:
    """End records of a value, looked for once and only where a header of their family is found."""

    def __init__(self, b: bytes):
        self.b = b

    @cached_property
    def pdf(self) -> dict[int, int]:
        return _pdf_ends(self.b)

    @cached_property
    def zip(self) -> dict[int, int]:
        return _zip_ends(self.b)


def _pdf(b: bytes, at: int, ends: _Ends) -> Found | None:
    stop = ends.pdf.get(at)
    return ("application/pdf", stop - at, b[at + 5 : at + 8].decode("ascii")) if stop else None


def _zip(b: bytes, at: int, ends: _Ends) -> Found | None:
    stop = ends.zip.get(at)
    return ("application/zip", stop - at, "") if stop else None


def _gzip(b: bytes, at: int) -> Found | None:
    """A stream that decompresses to the end, in bounded memory."""
    work = zlib.decompressobj(31)
    pos = at
    try:
        while pos < len(b) and not work.eof:
            data = b[pos : pos + 65536]
            pos += len(data)
            work.decompress(data, 1 << 20)
            while work.unconsumed_tail:
                work.decompress(work.unconsumed_tail, 1 << 20)
    except zlib.error:
        return None
    return ("application/gzip", pos - len(work.unused_data) - at, "") if work.eof else None


def _flac(b: bytes, at: int) -> Found | None:
    """Metadata blocks, the first one the stream's; the frames run to the end."""
    pos, first = at + 4, True
    while pos + 4 <= len(b):
        kind, n = b[pos] & 0x7F, int.from_bytes(b[pos + 1 : pos + 4], "big")
        if first and (kind or n != 34) or pos + 4 + n > len(b):
            return None
        last, first, pos = b[pos] & 0x80, False, pos + 4 + n
        if last:
            return ("audio/flac", len(b) - at, "") if b[pos : pos + 2] in (b"\xff\xf8", b"\xff\xf9") else None
    return None


def _ogg(b: bytes, at: int) -> Found | None:
    """Pages of stated length, the last of them marked."""
    pos = at
    while b[pos : pos + 4] == b"OggS" and pos + 27 <= len(b):
        n = b[pos + 26]
        if pos + 27 + n > len(b) or b[pos + 4] or pos == at and not b[pos + 5] & 2:
            return None
        stop, last = pos + 27 + n + sum(b[pos + 27 : pos + 27 + n]), b[pos + 5] & 4
        if stop > len(b):
            return None
        if last:
            return "audio/ogg", stop - at, ""
        pos = stop
    return None


def _mp4(b: bytes, at: int) -> Found | None:
    """Boxes of stated length; a brand in the first and a movie among the others."""
    pos, movie = at, False
    while pos + 8 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, pos)
        if n == 1 and pos + 16 <= len(b):
            (n,) = struct.unpack_from(">Q", b, pos + 8)
        if n < 8 or pos + n > len(b) or not kind.isalnum():
            break
        movie |= kind in (b"moov", b"moof")
        pos += n
    brand = b[at + 8 : at + 12]
    return ("video/mp4", pos - at, brand.decode("latin-1")) if movie else None


#: Tags of a TIFF directory that hold places of data, with the tags of their lengths: strips, tiles, a JPEG stream.
TIFF_DATA = {273: 279, 324: 325, 513: 514}
TIFF_SIZES = (0, 1, 1, 2, 4, 8, 1, 1, 2, 4, 8, 4, 8)


def _tiff(b: bytes, at: int) -> Found | None:
    """Directories whose entries and data lie inside; the length is that of the furthest of them."""
    e = "<" if b[at : at + 1] == b"I" else ">"
    if at + 8 > len(b):
        return None
    (pos,) = struct.unpack_from(e + "I", b, at + 4)
    stop, seen = 8, set()
    while pos:
        if pos < 8 or pos in seen or at + pos + 2 > len(b):
            return None
        seen.add(pos)
        (n,) = struct.unpack_from(e + "H", b, at + pos)
        if not n or at + pos + 6 + 12 * n > len(b):
            return None
        stop = max(stop, pos + 6 + 12 * n)
        tags, values = [], {}
        for i in range(n):
            place = pos + 2 + 12 * i
            tag, kind, count, value = struct.unpack_from(e + "HHII", b, at + place)
            if not 1 <= kind <= 12:
                return None
            size = count * TIFF_SIZES[kind]
            place = value if size > 4 else place + 8
            if at + place + size > len(b):
                return None
            stop = max(stop, place + size)
            tags.append(tag)
            if kind in (3, 4) and (tag in TIFF_DATA or tag in TIFF_DATA.values()):
                values[tag] = struct.unpack_from(f"{e}{count}{'H' if kind == 3 else 'I'}", b, at + place)
        if tags != sorted(tags):
            return None
        for places, lengths in TIFF_DATA.items():
            stop = max([stop, *(x + y for x, y in zip(values.get(places, ()), values.get(lengths, ())))])
        (pos,) = struct.unpack_from(e + "I", b, at + pos + 2 + 12 * n)
    return ("image/tiff", stop, str(len(seen))) if seen and at + stop <= len(b) else None


VALIDATORS: dict[str, Callable[[bytes, int], Found | None]] = {
    "png": _png, "jpeg": _jpeg, "gif": _gif, "bmp": _bmp, "riff": _riff,
    "gzip": _gzip, "flac": _flac, "ogg": _ogg, "mp4": _mp4, "tiff": _tiff,
}
#: Families whose ends are told by records further on.
ENDED = {"pdf": _pdf, "zip": _zip}


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for magic, offset, family in MAGIC:
        a.add_word(magic.decode("latin-1"), (len(magic) + offset - 1, family))
    a.make_automaton()
    return a


def finds(content: bytes) -> list[tuple[int, Found]]:
    """Confirmed media in ``content`` as (offset, found), by offset; the longest of those at one offset."""
    best: dict[int, Found] = {}
    ends = _Ends(content)
    for end, (back, family) in _automaton().iter(content.decode("latin-1")):
        at = end - back
        if at < 0:
            continue
        x = ENDED[family](content, at, ends) if family in ENDED else VALIDATORS[family](content, at)
        if x and x[1] > best.get(at, ("", 0, ""))[1]:
            best[at] = x
    return sorted(best.items())


def judge(content: bytes | None) -> tuple[Found | None, list[tuple[int, Found]]]:
    """(what the value is, what is embedded in it); of media that overlap, the first is carved."""
    all_of_it = finds(content) if content else []
    own = all_of_it[0][1] if all_of_it and all_of_it[0][0] == 0 else None
    inner, free = [], 0
    for at, x in all_of_it:
        if at and at >= free:
            inner.append((at, x))
            free = at + x[1]
    return own, inner


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(payload: bytes) -> bytes:
    """``payload``, a positive multiple of 192 bytes, as a file."""
    rows = len(payload) // UNIT
    kind = zlib.crc32(payload) % 3
    if kind == 0:
        raw = b"".join(b"\0" + payload[i : i + UNIT] for i in range(0, len(payload), UNIT))
        head = struct.pack(">IIBBBBB", WIDTH, rows, 8, 2, 0, 0, 0)
        return MAGIC[0][0] + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw, 1)) + _chunk(b"IEND", b"")
    if kind == 1:  # top-down rows, a multiple of 4 bytes each
        head = struct.pack("<IiiHHIIiiII", 40, WIDTH, -rows, 1, 24, 0, len(payload), 2835, 2835, 0, 0)
        return b"BM" + struct.pack("<III", 54 + len(payload), 0, 54) + head + payload
    head = b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8)
    body = b"WAVE" + head + b"data" + struct.pack("<I", len(payload)) + payload
    return b"RIFF" + struct.pack("<I", len(body)) + body


def decode(content: bytes, kind: str) -> bytes:
    """The payload of a file that :func:`encode` wrote, by its true type."""
    if kind == PNG:
        raw, pos = b"", 8
        while pos < len(content):
            n, name = struct.unpack_from(">I4s", content, pos)
            if name == b"IDAT":
                raw += content[pos + 8 : pos + 8 + n]
            pos += 12 + n
        raw = zlib.decompress(raw)
        return b"".join(raw[i + 1 : i + 1 + UNIT] for i in range(0, len(raw), UNIT + 1))
    if kind == BMP:
        (offset,) = struct.unpack_from("<I", content, 10)
        wide, high = struct.unpack_from("<ii", content, 18)
        return content[offset : offset + 3 * wide * abs(high)]
    if kind == WAV:
        pos = 12
        while pos < len(content):
            name, n = struct.unpack_from("<4sI", content, pos)
            if name == b"data":
                return content[pos + 8 : pos + 8 + n]
            pos += 8 + n + (n & 1)
    raise ValueError(f"no payload in {kind}")


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, declared, content): each text as a file, declared to be plain bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in pdf["text"]]
            padded = [b.ljust(max(UNIT, -(-len(b) // UNIT) * UNIT)) for b in raw]
            yield pd.DataFrame(
                {"doc_id": pdf["doc_id"], "n_bytes": [len(b) for b in raw], "content": [encode(p) for p in padded]}
            )

    return (
        docs.select(F.col("doc_id").cast("string"), "text")
        .mapInPandas(run, "doc_id string, n_bytes long, content binary")
        .select(F.col("doc_id").cast("long"), "n_bytes", F.lit("application/octet-stream").alias("declared"), "content")
    )


SNIFFED = "type string, detail string, length long, embedded array<struct<offset: long, length: long, type: string>>"


def sniff(df: DataFrame, content: str = "content", out: str = "sniffed") -> DataFrame:
    """``df`` with a struct ``out``: type, detail, length and embedded media of the binary column ``content``."""

    @F.pandas_udf(SNIFFED)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for b in part:
                own, inner = judge(b)
                carved = [{"offset": at, "length": x[1], "type": x[0]} for at, x in inner]
                rows.append((*(own[i] if own else None for i in (0, 2, 1)), carved))
            rows = pd.DataFrame(rows, columns=["type", "detail", "length", "embedded"])
            yield rows.astype({"length": "Int64"})

    return df.withColumn(out, run(content))


def carve(df: DataFrame, content: str = "content") -> DataFrame:
    """A row per embedded file: the columns of ``df`` but ``content``, then offset, type and bytes of the file."""
    found = sniff(df, content, "_sniffed").withColumn("_file", F.explode("_sniffed.embedded"))
    cut = F.expr(f"substring(`{content}`, int(_file.offset) + 1, int(_file.length))")
    others = [F.col(f"`{c}`") for c in df.columns if c != content]
    return found.select(*others, F.col("_file.offset").alias("offset"), F.col("_file.type").alias("type"), cut.alias("bytes"))


def digest(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: what was stored, told by its true type and read back."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for content, s, declared in zip(pdf["content"], pdf["sniffed"], pdf["declared"]):
                payload = decode(content, s["type"])
                right = "" if s["type"] == declared else f";declared={declared}"
                feature = f"{s['type']};{s['detail']};embedded={len(s['embedded'])}{right}"
                sha = hashlib.sha256
                rows.append(
                    (len(payload), sha(payload).hexdigest(), zlib.crc32(payload[-16:]), len(content), sha(content).hexdigest(), feature)
                )
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pd.DataFrame(rows, columns=names).assign(doc_id=pdf["doc_id"], n_bytes=pdf["n_bytes"])

    schema = (
        "doc_id string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
        "media_bytes long, media_sha256 string, feature string"
    )
    return (
        sniff(store(docs))
        .withColumn("doc_id", F.col("doc_id").cast("string"))
        .mapInPandas(run, schema)
        .withColumn("doc_id", F.col("doc_id").cast("long"))
    )
