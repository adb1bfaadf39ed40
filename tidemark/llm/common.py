"""Helpers shared by the operators: tables, the shared folder, and vectorised words.

Words are maximal runs of bytes outside 0x20 and 0x09-0x0D of the UTF-8 text, which is what
``bytes.split()`` yields.  Word hashes are 64-bit and depend on the word's bytes alone.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at once by the vectorised kernels.
SLICE_BYTES = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode one set here when unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        found = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_cleaning: dict[str, list] = {}
_lock = threading.Lock()


@contextmanager
def _shuffle_files_removed(spark: SparkSession) -> Iterator[None]:
    """Has the session remove shuffle files as a query ends, until the last of several threads here is done."""
    session = spark._jsparkSession.sessionUUID()
    with _lock:
        users = _cleaning.setdefault(session, [0, spark.conf.get(_CLEANUP, None)])
        users[0] += 1
        spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        with _lock:
            users[0] -= 1
            if not users[0]:
                del _cleaning[session]
                spark.conf.unset(_CLEANUP) if users[1] is None else spark.conf.set(_CLEANUP, users[1])


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage, survives lost executors.

    The write's own shuffle files are removed as it ends, so disk holds one step's files at a time.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    with _shuffle_files_removed(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Deletes a table of ``written`` that nothing reads any more."""
    spark = table.sparkSession
    for path in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
        if path.rsplit("/", 2)[-2] == "tables":
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def named(column: str) -> Column:
    """A column by its exact name, dots and quotes included."""
    return F.col("`" + column.replace("`", "``") + "`")


def map_batches(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """Arrow batches of ``rows`` through ``run``, columns unchanged; inside, the i-th column is called c<i>."""
    inner = rows.toDF(*[f"c{i}" for i in range(len(rows.columns))])
    return inner.mapInArrow(run, inner.schema).toDF(*rows.columns)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Each batch cut into runs of rows of about ``limit`` bytes in ``column`` (one row at least)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
        run = np.cumsum(sizes.to_numpy(zero_copy_only=False))
        at = 0
        while at < n:
            before = run[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(run, before + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def batch_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64); a bijection on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_POW: dict[int, np.ndarray] = {}


def powers(n: int, base: int = _BASE) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept and grown by doubling."""
    have = _POW.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        steps = np.full(size, base & _MASK, np.uint64)
        steps[0] = 1
        have = _POW[base] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


_INVERSE = pow(_BASE, -1, 1 << 64)


def _hash_slice(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    a = np.frombuffer(data, np.uint8)
    space = _SPACE[a]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    run = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(_BYTE[a] * powers(len(a)), out=run[1:])
    return starts, mix((run[ends] - run[starts]) * powers(len(a) + 1, _INVERSE)[starts] + (ends - starts).astype(np.uint64))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and offsets of each text's words (len(texts) + 1)."""
    hashes, counts, group, size = [], np.zeros(len(texts) + 1, np.int64), [], 0

    def flush() -> None:
        nonlocal group, size
        if group:
            begins = np.cumsum([0] + [len(t) + 1 for _, t in group])
            starts, h = _hash_slice(b" ".join(t for _, t in group))
            hashes.append(h)
            where = np.searchsorted(starts, begins)
            for k, (i, _) in enumerate(group):
                counts[i + 1] += where[k + 1] - where[k]
        group, size = [], 0

    for i, t in enumerate(texts):
        at = 0
        while len(t) - at > SLICE_BYTES:  # cut a long text where a word ends
            to = at + SLICE_BYTES
            while to < len(t) and not _SPACE[t[to]]:
                to += 1
            group.append((i, t[at:to]))
            flush()
            at = to
        if size + len(t) - at > SLICE_BYTES:
            flush()
        group.append((i, t[at:] if at else t))
        size += len(t) - at
    flush()
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.cumsum(counts)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words (len(words) - k + 1 of them, none if shorter)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out += words[i : i + n] * np.uint64(pow(_BASE, i + 1, 1 << 64))
    return mix(out)
