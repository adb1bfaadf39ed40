"""Media columns: lossless storage, signature sniffing, type correction and carving.

``sniff`` runs one Aho-Corasick automaton over the magic bytes of all known formats, lets a validator
for each format confirm structure and length at every hit, corrects the declared type from what starts
at offset 0, and carves confirmed media found further in.  Validators walk headers and chunk lengths;
hits inside a carved medium are skipped.  End markers, and chains of chunks found broken, are remembered
for each payload, so a payload full of false starts is read a bounded number of times.

``store_wav`` keeps a payload as the samples of an 8-bit mono WAV file, byte for byte.

Null payload: empty.  An empty text is stored as one block of zeros.  Very long payloads are sniffed
whole.  Repeated rows give equal values.  Ties (two formats at one offset): the earlier in FORMATS.
Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import batch_of, slices, table

RATE, BLOCK = 8000, 64


def _u32(b: bytes, at: int, order: str = "<") -> int:
    return struct.unpack_from(f"{order}I", b, at)[0] if at + 4 <= len(b) else -1


class Payload:
    """A payload with what validators learned about it; they ask at rising offsets."""

    def __init__(self, data: bytes) -> None:
        self.data = data
        self._ends: dict[bytes, tuple[int, int]] = {}
        self._broken: dict[str, set[int]] = {}

    def find(self, marker: bytes, at: int) -> int:
        """The first ``marker`` at ``at`` or after, -1 if there is none."""
        asked, found = self._ends.get(marker, (0, at - 1))
        if not (asked <= at and (found < 0 <= asked and marker in self._ends or found >= at)):
            found = self.data.find(marker, at)
            self._ends[marker] = (at, found)
        return found

    def walk(self, kind: str, places: Iterator[int]) -> int:
        """The last of ``places`` that a chain of chunks visits (negative: broken); broken chains are not walked twice."""
        broken, seen, p = self._broken.setdefault(kind, set()), [], -1
        for p in places:
            if p in broken:
                p = -1
            if p < 0:
                break
            seen.append(p)
        if p < 0:
            broken.update(seen)
        return p


def _wav(payload: Payload, at: int) -> int:
    """Length of a RIFF/WAVE file whose chunks fill it exactly, else 0."""
    b = payload.data
    size = _u32(b, at + 4)
    if size < 4 or b[at + 8 : at + 12] != b"WAVE" or at + 8 + size > len(b):
        return 0
    p, end, seen = at + 12, at + 8 + size, set()
    while p + 8 <= end:
        n = _u32(b, p + 4)
        seen.add(b[p : p + 4])
        p += 8 + n + (n & 1)
    return 8 + size if p == end and {b"fmt ", b"data"} <= seen else 0


def _png(payload: Payload, at: int) -> int:
    b = payload.data
    if b[at + 12 : at + 16] != b"IHDR" or _u32(b, at + 8, ">") != 13:
        return 0

    def chunks() -> Iterator[int]:
        p = at + 8
        while p + 12 <= len(b):
            n, kind = _u32(b, p, ">"), b[p + 4 : p + 8]
            if not kind.isalpha() or p + 12 + n > len(b):
                break
            yield p
            p += 12 + n
            if kind == b"IEND":
                if zlib.crc32(b"IEND") == _u32(b, p - 4, ">"):
                    return
                break
        yield -1

    last = payload.walk("png", chunks())
    return last + 12 + _u32(b, last, ">") - at if last >= 0 else 0


def _gif(payload: Payload, at: int) -> int:
    b = payload.data
    if at + 13 > len(b):
        return 0
    colours = lambda flags: 3 << ((flags & 7) + 1) if flags & 0x80 else 0

    def blocks() -> Iterator[int]:
        p = at + 13 + colours(b[at + 10])
        while p < len(b):
            yield p
            if b[p] == 0x3B:
                return
            if b[p] == 0x2C and p + 10 < len(b):
                p += 11 + colours(b[p + 9])
            elif b[p] == 0x21:
                p += 2
            else:
                break
            while p < len(b) and b[p]:
                p += b[p] + 1
            p += 1
        yield -1

    last = payload.walk("gif", blocks())
    return last + 1 - at if last >= 0 else 0


def _jpeg(payload: Payload, at: int) -> int:
    b = payload.data

    def segments() -> Iterator[int]:
        p = at + 2
        while p + 4 <= len(b) and b[p] == 0xFF:
            kind, n = b[p + 1], struct.unpack_from(">H", b, p + 2)[0]
            if kind in (0x00, 0xFF, 0xD8) or n < 2:
                break
            yield p
            p += 2 + n
            if kind == 0xDA:
                return
        yield -1

    last = payload.walk("jpeg", segments())
    if last < 0:
        return 0
    # entropy-coded data runs to the end marker
    end = payload.find(b"\xff\xd9", last + 2 + struct.unpack_from(">H", b, last + 2)[0])
    return end + 2 - at if end >= 0 else 0


def _bmp(payload: Payload, at: int) -> int:
    b = payload.data
    size, offset, header = _u32(b, at + 2), _u32(b, at + 10), _u32(b, at + 14)
    return size if header in (12, 40, 52, 56, 108, 124) and 14 + header <= offset <= size <= len(b) - at else 0


def _pdf(payload: Payload, at: int) -> int:
    end, start = payload.find(b"%%EOF", at), payload.find(b"startxref", at)
    return end + 5 - at if 0 <= start < end else 0


def _zip(payload: Payload, at: int) -> int:
    b, end = payload.data, payload.find(b"PK\x05\x06", at)
    if end < 0 or end + 22 > len(b):
        return 0
    size, offset = _u32(b, end + 12), _u32(b, end + 16)
    return end + 22 + struct.unpack_from("<H", b, end + 20)[0] - at if at + offset + size == end else 0


def _gzip(payload: Payload, at: int) -> int:
    b = payload.data
    unpack, p = zlib.decompressobj(31), at
    try:
        while p < len(b) and not unpack.eof:
            unpack.decompress(b[p : p + 65536])
            p += 65536
    except zlib.error:
        return 0
    return min(p, len(b)) - len(unpack.unused_data) - at if unpack.eof else 0


def _flac(payload: Payload, at: int) -> int:
    """Metadata blocks must be whole and begin with stream information; audio runs to the end."""
    b = payload.data
    p, first = at + 4, True
    while p + 4 <= len(b):
        n = int.from_bytes(b[p + 1 : p + 4], "big")
        if first and (b[p] & 0x7F or n != 34):
            return 0
        last, p, first = b[p] & 0x80, p + 4 + n, False
        if last:
            return len(b) - at if p <= len(b) else 0
    return 0


def _ogg(payload: Payload, at: int) -> int:
    b = payload.data
    p = at
    while b[p : p + 5] == b"OggS\0" and p + 27 <= len(b):
        k = b[p + 26]
        p += 27 + k + sum(b[p + 27 : p + 27 + k])
        if p > len(b):
            return 0
    return p - at


#: Media type, magic bytes, validator.
FORMATS: tuple[tuple[str, bytes, Callable[[Payload, int], int]], ...] = (
    ("audio/wav", b"RIFF", _wav),
    ("image/png", b"\x89PNG\r\n\x1a\n", _png),
    ("image/gif", b"GIF87a", _gif),
    ("image/gif", b"GIF89a", _gif),
    ("image/jpeg", b"\xff\xd8\xff", _jpeg),
    ("image/bmp", b"BM", _bmp),
    ("application/pdf", b"%PDF-", _pdf),
    ("application/zip", b"PK\x03\x04", _zip),
    ("application/gzip", b"\x1f\x8b\x08", _gzip),
    ("audio/flac", b"fLaC", _flac),
    ("audio/ogg", b"OggS\0", _ogg),
)


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, magic, check in FORMATS:
        found.add_word(magic.decode("latin-1"), (kind, len(magic), check))
    found.make_automaton()
    return found


def find_media(data: bytes) -> list[tuple[int, int, str]]:
    """Confirmed media as (offset, length, type), by offset, not nested; text never confirms."""
    out, end, payload = [], 0, Payload(data)
    for last, (kind, n, check) in _automaton().iter(data.decode("latin-1")):
        at = last + 1 - n
        if at >= end and (length := check(payload, at)):
            out.append((at, length, kind))
            end = at + length
    return out


def store_wav(payload: bytes) -> bytes:
    """The payload as samples of an 8-bit mono WAV file; an odd payload gets RIFF's pad byte."""
    pad = len(payload) & 1
    head = b"RIFF" + struct.pack("<I", 36 + len(payload) + pad) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8)
    return head + b"data" + struct.pack("<I", len(payload)) + payload + b"\0" * pad


def read_wav(media: bytes) -> bytes:
    """The samples of a WAV file, found by walking its chunks."""
    p = 12
    while p + 8 <= len(media):
        n = _u32(media, p + 4)
        if media[p : p + 4] == b"data":
            return media[p + 8 : p + 8 + n]
        p += 8 + n + (n & 1)
    raise ValueError("no data chunk")


STORED = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("declared", pa.string()), ("media", pa.binary())])


def store(rows: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """id, n_bytes, declared, media: each text padded with zeros to a positive multiple of 64, as WAV."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column):
            texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
            media = [store_wav(t.ljust(max(BLOCK, -(-len(t) // BLOCK) * BLOCK), b"\0")) for t in texts]
            yield batch_of(STORED, id=batch.column(0), n_bytes=[len(t) for t in texts], declared=["application/octet-stream"] * len(texts), media=media)

    return rows.select(key, column).mapInArrow(run, "id long, n_bytes long, declared string, media binary")


SNIFFED = pa.schema([
    ("id", pa.int64()), ("n_bytes", pa.int64()), ("type", pa.string()), ("corrected", pa.bool_()), ("payload_bytes", pa.int64()),
    ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()),
    ("carved", pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string()), ("bytes", pa.binary())]))),
])
SNIFFED_SQL = (
    "id long, n_bytes long, type string, corrected boolean, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, carved array<struct<offset:long,length:long,type:string,bytes:binary>>"
)


def _sniffed(media: bytes, declared: str | None) -> dict:
    found = find_media(media)
    kind = found[0][2] if found and found[0][0] == 0 else "application/octet-stream"
    payload = read_wav(media) if kind == "audio/wav" else media
    inner = find_media(payload) if kind == "audio/wav" else [f for f in found if f[0]]
    return {
        "type": kind, "corrected": kind != declared, "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(),
        "tail_crc32": zlib.crc32(payload[-BLOCK:]), "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(),
        "carved": [{"offset": at, "length": n, "type": k, "bytes": payload[at : at + n]} for at, n, k in inner],
    }


def sniff(stored: DataFrame) -> DataFrame:
    """Reads the stored bytes (id, n_bytes, declared, media) back: true type, payload features, embedded media."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media"):
            rows = [_sniffed(m or b"", d) for m, d in zip(batch.column(3).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield batch_of(SNIFFED, id=batch.column(0), n_bytes=batch.column(1), **{k: [r[k] for r in rows] for k in SNIFFED.names[2:]})

    return stored.select("id", "n_bytes", "declared", "media").mapInArrow(run, SNIFFED_SQL)


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sniff(store(table(spark, sf_dir, "documents")))
    return found.selectExpr(
        "id AS doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256",
        f"concat(type, ';rate={RATE};bits=8;channels=1;corrected=', corrected, ';embedded=', array_join(transform(carved, c -> concat(c.type, '@', c.offset, '+', c.length)), ',')) AS feature",
    )


#: The stored form is a WAV header of 44 bytes before the payload; texts hold no other media, so nothing is carved.
SQL = r"""
WITH t AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
p AS (SELECT doc_id, octet_length(b) AS n, greatest(64, (octet_length(b) + 63) // 64 * 64)::BIGINT AS m, b FROM t),
q AS (SELECT doc_id, n, m, b || unhex(repeat('00', (m - n)::INT)) AS pay FROM p),
le AS (SELECT *, lambda_x FROM (SELECT *, hex(pay) AS h, [36 + m, m] AS sizes FROM q) s, LATERAL (SELECT list_transform(s.sizes, lambda v: format('{:02X}{:02X}{:02X}{:02X}', v & 255, (v >> 8) & 255, (v >> 16) & 255, (v >> 24) & 255)) AS lambda_x) x),
w AS (SELECT doc_id, n, m, pay, right(h, 128) AS tail, unhex('52494646' || lambda_x[1] || '57415645666D742010000000' || '01000100' || '401F0000' || '401F0000' || '01000800' || '64617461' || lambda_x[2]) || pay AS media FROM le),
c AS (SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(0, 64), lambda i: ('0x' || substr(tail, (2 * i + 1)::INT, 2))::BIGINT)),
  lambda a, v: list_reduce(list_concat([xor(a, v)], list_transform(range(0, 8), lambda k: 0::BIGINT)), lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) AS crc FROM w)
SELECT doc_id, n::BIGINT AS n_bytes, m AS payload_bytes, sha256(pay) AS payload_sha256, crc::BIGINT AS tail_crc32, (m + 44)::BIGINT AS media_bytes, sha256(media) AS media_sha256,
  'audio/wav;rate=8000;bits=8;channels=1;corrected=true;embedded=' AS feature FROM c
"""
