"""Byte-level BPE encoding and decoding through a global shuffle of distinct words.

Texts are split into pre-tokens.  Rows are grouped into chunks of about ``CHUNK_CHARS`` characters; a
chunk's pre-tokens are exploded into its distinct words and, for each row, the packed positions at
which they stand.  The words are dealt by hash to word buckets, where each distinct word is encoded exactly
once whatever number of chunks hold it; its ids are joined back to the chunks and put together by position.
A word costs one entry per chunk, so no word, however frequent, is a hot key, and a document costs its own
size.  Buckets grow in number with the input's bytes (``BUCKET_BYTES`` each, ``BUCKETS`` at least), so a
bucket's words fit in a task at any size.

``decode`` joins exploded ids with the table of token bytes (as many rows as the vocabulary) and puts the bytes
together by position.  ``digests`` joins a chunk's ids with the same table as arrays where the chunk is put
together; to shuffle a row per token again for this would write several times the input.

Both kinds of packed rows leave one Python pass over the texts and share one exchange: word rows are
dealt by bucket and row parts by chunk (column ``route``).  Chunks are named by the hash of all that they
hold, so a part that is computed anew gives the same chunks, in any order of its chunks.  ``documents`` must give the
rows of a part in the same order when read again, as a table does; where it does not and an executor is lost,
words are missing and the job fails instead of giving wrong ids.

Null text: empty, no ids.  A very long text is a chunk of its own, encoded whole.  Repeated rows come
out once each.  Extra columns are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_of, slices, table, written

CHUNK_CHARS, BUCKETS, BUCKET_BYTES = 12 << 20, 96, 8 << 20
PACKED = "route long, chunk long, ids binary, blob binary"
PACKED_SCHEMA = pa.schema([("route", pa.int64()), ("chunk", pa.int64()), ("ids", pa.binary()), ("blob", pa.binary())])


def _pack(data: bytes | np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data if isinstance(data, bytes) else data.tobytes())


def _unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


@lru_cache(maxsize=2)
def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=2)
def _splitter(pattern: str):
    import regex

    return regex.compile(pattern)


@lru_cache(maxsize=2)
def _encoder(path: str):
    """The library's encoder of single pre-tokens: its pattern takes any text whole."""
    import tiktoken

    return tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks_of(path), special_tokens={}).encode_ordinary


def _words_packed(words: list[str]) -> bytes:
    raw = [w.encode() for w in words]
    return _pack(np.array([len(w) for w in raw], np.uint32).tobytes() + b"".join(raw))


def _words_unpacked(blob: bytes, n: int) -> list[bytes]:
    data = _unpack(blob)
    ends = (4 * n + np.cumsum(np.frombuffer(data, np.uint32, n))).tolist()
    return [data[a:b] for a, b in zip([4 * n, *ends], ends, strict=False)]


class _Chunk:
    """Rows gathered so far: each distinct word's number, and each row's word numbers in order."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.rows: list[tuple[int | None, np.ndarray]] = []
        self.chars = 0

    def add(self, key: int | None, words: list[str], chars: int) -> None:
        number = self.number
        for w in words:
            if w not in number:
                number[w] = len(number)
        self.rows.append((key, np.fromiter(map(number.__getitem__, words), np.uint32, len(words))))
        self.chars += chars

    def packed(self, buckets: int) -> Iterator[tuple[int, int, bytes, bytes]]:
        """(route, chunk, ids, blob): words by bucket at routes below zero, positions at the chunk's."""
        keys = np.array([[k is not None, k or 0] for k, _ in self.rows], np.int64)
        sizes = np.array([len(p) for _, p in self.rows], np.uint32)
        positions = np.concatenate([p for _, p in self.rows])
        named = hashlib.blake2b(keys.tobytes() + sizes.tobytes(), digest_size=8)
        named.update(positions)
        at: dict[int, list[str]] = {}
        for w in self.number:
            raw = w.encode()
            named.update(len(raw).to_bytes(4, "little") + raw)
            at.setdefault(int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little") % buckets, []).append(w)
        name = int.from_bytes(named.digest(), "little") >> 1
        for b, words in sorted(at.items()):
            words.sort()
            numbers = np.fromiter(map(self.number.__getitem__, words), np.uint32, len(words))
            yield -1 - b, name, _pack(numbers), _words_packed(words)
        planes = b"".join(((positions >> np.uint32(s)) & np.uint32(255)).astype(np.uint8).tobytes() for s in (0, 8, 16, 24))
        yield name, name, _pack(keys), _pack(np.uint64(len(sizes)).tobytes() + sizes.tobytes() + planes)


def bucket_count(documents: DataFrame) -> int:
    """Word buckets for the input by its size as planned; a size that isn't known counts as full shuffle partitions."""
    partitions = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(documents._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > 1 << 50:
        size = partitions << 27
    return max(BUCKETS, partitions, size // BUCKET_BYTES)


def pre_tokens(documents: DataFrame, pattern: str, buckets: int) -> DataFrame:
    """Chunks of ``documents`` (key, text) as packed rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, chunk = _splitter(pattern).findall, _Chunk()

        def done() -> Iterator[pa.RecordBatch]:
            rows = list(chunk.packed(buckets))
            for at in range(0, len(rows), 4096):
                route, names, ids, blobs = zip(*rows[at : at + 4096], strict=True)
                yield batch_of(PACKED_SCHEMA, route=route, chunk=names, ids=ids, blob=blobs)

        for batch in slices(batches):
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = t or ""
                if chunk.rows and chunk.chars + len(text) > CHUNK_CHARS:
                    yield from done()
                    chunk = _Chunk()
                chunk.add(k, find(text), len(text))
        if chunk.rows:
            yield from done()

    return documents.mapInArrow(run, PACKED)


def _encode_bucket(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, known = _encoder(path), {}
        ranks, bucket = ranks_of(path), None
        for batch in batches:
            for route, chunk, numbers, blob in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if route >= 0:
                    continue
                if route != bucket:  # a bucket's words come one chunk after another
                    bucket, known = route, {}
                n = len(_unpack(numbers)) // 4
                words = _words_unpacked(blob, n)
                for w in words:
                    if w not in known:
                        known[w] = (r,) if (r := ranks.get(w)) is not None else tuple(encode(w.decode()))
                ids = [known[w] for w in words]
                sizes = np.array([len(i) for i in ids], np.uint32)
                flat = np.fromiter((x for i in ids for x in i), np.uint32, int(sizes.sum()))
                yield batch_of(PACKED_SCHEMA, route=[chunk], chunk=[chunk], ids=[numbers], blob=[_pack(sizes.tobytes() + flat.tobytes())])

    return run


ENCODED = pa.schema([("key", pa.int64()), ("ids", pa.list_(pa.int64()))])


def _joined(words: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A chunk's encoded words by number: how many ids (-1: not there), where they start, and all ids."""
    numbers, sizes, flats = [np.zeros(0, np.uint32)], [np.zeros(0, np.uint32)], [np.zeros(0, np.uint32)]
    for number, blob in words:
        n = np.frombuffer(_unpack(number), np.uint32)
        data = np.frombuffer(_unpack(blob), np.uint32)
        numbers.append(n)
        sizes.append(data[: len(n)])
        flats.append(data[len(n) :])
    number, size, flat = np.concatenate(numbers), np.concatenate(sizes).astype(np.int64), np.concatenate(flats)
    top = int(number.max()) + 1 if len(number) else 0
    width, start = np.full(top + 1, -1, np.int64), np.zeros(top + 1, np.int64)
    width[number], start[number] = size, np.cumsum(size) - size
    return width, start, flat


def _assemble(words: tuple[np.ndarray, np.ndarray, np.ndarray], part: tuple[bytes, bytes]) -> tuple[list, list[np.ndarray]]:
    """Joins the ids of a chunk's words back at their positions: each row's key and ids."""
    width, start, flat = words
    keys = np.frombuffer(_unpack(part[0]), np.int64).reshape(-1, 2)
    data = _unpack(part[1])
    n = int(np.frombuffer(data, np.uint64, 1)[0])
    rows = np.frombuffer(data, np.uint32, n, 8)
    planes = np.frombuffer(data, np.uint8, offset=8 + 4 * n).reshape(4, -1)
    out, at = [], 0
    for r in rows.tolist():
        p = planes[:, at : at + r].astype(np.uint32)
        p = p[0] | p[1] << np.uint32(8) | p[2] << np.uint32(16) | p[3] << np.uint32(24)
        at += r
        if not r:
            out.append(np.zeros(0, np.uint32))
            continue
        w = width[np.minimum(p, len(width) - 1)]
        if (w < 0).any():
            raise ValueError("words of a chunk are missing: its part was read again in another order; write the documents first")
        ends = np.cumsum(w)
        out.append(flat[np.repeat(start[p] - (ends - w), w) + np.arange(ends[-1])])
    return [int(k) if has else None for has, k in keys.tolist()], out


def _encode(documents: DataFrame, path: str, pattern: str, key: str, result, schema: pa.Schema, sql: str) -> DataFrame:
    rows = documents.select(F.col(key).cast("long").alias("key"), "text")
    buckets = bucket_count(rows)
    packed = pre_tokens(rows, pattern, buckets)
    # as many partitions as buckets where the input asks for more than the session's
    many = buckets > max(BUCKETS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    packed = packed.repartition(buckets, "route") if many else packed.repartition("route")
    encoded = packed.sortWithinPartitions("route").mapInArrow(_encode_bucket(path), PACKED)

    def reassemble(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or left.column("route")[0].as_py() < 0:
            return schema.empty_table()
        words = _joined([(w["ids"], w["blob"]) for w in right.to_pylist()])
        made = []
        for part in left.to_pylist():  # more than one: chunks that are equal in all
            keys, ids = _assemble(words, (part["ids"], part["blob"]))
            made += list(result(keys, ids))
        return pa.Table.from_batches(made, schema=schema)

    return packed.groupBy("route").cogroup(encoded.groupBy("route")).applyInArrow(reassemble, sql)


def encode(documents: DataFrame, path: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """key and ids (array of long) of each row's whole text, without special tokens."""

    def result(keys, ids):
        yield batch_of(ENCODED, key=keys, ids=[i.astype(np.int64) for i in ids])

    return _encode(documents, path, pattern, key, result, ENCODED, "key long, ids array<long>")


def token_table(spark: SparkSession, path: str) -> DataFrame:
    """id and bytes of each token of the vocabulary."""
    tokens = pa.table({"id": pa.array(list(ranks_of(path).values()), pa.int64()), "bytes": pa.array(list(ranks_of(path)), pa.binary())})
    return spark.createDataFrame(tokens)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """key and bytes of each row of ids (null ids: null), by a join with the table of token bytes."""
    rows = written(encoded.select("key", "ids").withColumn("row", F.monotonically_increasing_id()))
    tokens = rows.select("row", F.posexplode("ids").alias("at", "id")).join(token_table(encoded.sparkSession, path), "id", "left")
    spelled = F.coalesce(F.hex("bytes"), F.raise_error(F.concat(F.lit("no token has id "), F.col("id"))).cast("string"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", spelled.alias("hex")))), lambda x: x["hex"]), "")
    put = tokens.groupBy("row").agg(F.unhex(whole).alias("bytes"))
    return rows.join(put, "row", "left").select("key", F.when(F.col("ids").isNotNull(), F.coalesce("bytes", F.lit(b""))).alias("bytes"))


DIGEST = pa.schema([("key", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def digests(documents: DataFrame, path: str, pattern: str, key: str = "doc_id", keep_ids: bool = False) -> DataFrame:
    """Encodes each row, decodes the ids by the token-byte table, and returns counts and digests of both, and the ids if asked."""
    schema, sql = DIGEST, "key long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if keep_ids:
        schema, sql = DIGEST.append(ENCODED.field("ids")), f"{sql}, ids array<long>"

    def result(keys, ids):
        token = sorted(ranks_of(path).items(), key=lambda x: x[1])
        place = np.full(token[-1][1] + 1, -1, np.int64)
        place[[r for _, r in token]] = np.arange(len(token))
        sizes = np.array([len(t) for t, _ in token], np.int64)
        starts = np.cumsum(sizes) - sizes
        flat = np.frombuffer(b"".join(t for t, _ in token), np.uint8)
        decoded = []
        for i in ids:
            p = place[i]
            w = sizes[p]
            ends = np.cumsum(w)
            data = flat[np.repeat(starts[p] - (ends - w), w) + np.arange(int(w.sum()))].tobytes()
            decoded.append(hashlib.sha256(data).hexdigest())
        sha = [hashlib.sha256(i.astype("<u4").tobytes()).hexdigest() for i in ids]
        more = {"ids": [i.astype(np.int64) for i in ids]} if keep_ids else {}
        yield batch_of(schema, key=keys, n_tokens=[len(i) for i in ids], ids_sha256=sha, decoded_sha256=decoded, **more)

    return _encode(documents, path, pattern, key, result, schema, sql)


def op6_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return digests(table(spark, sf_dir, "documents"), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).withColumnRenamed("key", "doc_id")
