"""Substring deduplication by seed and extend.

Seeds: of every ``LENGTH``-word window the least ``GRAM``-word hash (leftmost of equals) is its anchor, so
equal windows have equal anchors at equal places, and about one word in twenty is an anchor.  Documents
are joined on anchors; an anchor in one document only ends there.

Extend: an anchor stands for the run of windows that chose it.  The words of that whole run, both ways from the
anchor, are compared by hash: an occurrence whose run is that of an earlier document is covered by it as a
whole, however many documents share it.  Where runs of one anchor differ (at the ends of a repeat), only
their first documents are extended window by window, and each window is kept if an earlier document
holds it.  Covered windows that touch or overlap join into maximal repeats of LENGTH words or more.

No pairs of documents are made: groups are aggregated to their smallest doc_id before and after the shuffle,
and joins on an anchor held by a third of all rows are split by adaptive execution.  Texts travel twice,
once for the documents with differing runs and once for the cut.

Null or short text: nothing is covered.  Null doc_id: neither removed nor compared.  Repeated rows (equal doc_id)
are not earlier than one another and each is cut alike.  Repeats within one document stay, unless an
earlier document holds them.  Different texts of one doc_id are rows of their own.  Very long texts are read whole,
a block at a time, in a few times the text's size of memory.
Empty tables give no rows.  Extra columns are ignored by ``repeats``.

Words are equal if two independent 64-bit hashes of them are: that of the anchor and that of the run or window.
Among 10**13 windows a false match has a chance of about 10**-12.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_of, discard, gram_hashes, mix, powers, slices, table, word_hashes, written

LENGTH, GRAM = 50, 12
#: Windows, or words, handled at once, and bytes of text: what a kernel's arrays cover.
BLOCK, SLICE = 1 << 16, 1 << 20
_GAP = re.compile(rb"[\x20\x09-\x0D]")
_SPAN = 0xD1342543DE82EF95
_SPAN_INVERSE = pow(_SPAN, -1, 1 << 64)


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """For each full window of ``width`` values, the index of its least value, leftmost of equals."""
    if len(values) < width:
        return np.zeros(0, np.int64)
    at, span = np.arange(len(values)), 1
    better = lambda x, y: np.where(values[y] < values[x], y, x)
    while span * 2 <= width:
        at = better(at[:-span], at[span:])
        span *= 2
    return better(at[: len(values) - width + 1], at[width - span : len(values) - span + 1])


def span_sums(words: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(mix(words) * powers(len(words), _SPAN), out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of words a..b-1, the same wherever they stand."""
    return mix((sums[b] - sums[a]) * powers(len(sums), _SPAN_INVERSE)[a] + (b - a).astype(np.uint64))


def seeds_of(texts: list[bytes], length: int, gram: int) -> Iterator[dict[str, np.ndarray]]:
    """text (index), anchor, context, lo and hi (first and last window start) of each run of windows, a block of windows at a time."""
    words, offsets = word_hashes(texts)
    at, end = 0, len(words) - length + 1
    while at < end:
        to = min(end, at + max(BLOCK, 2 * length))
        here = words[at : to + length - 1]
        grams = gram_hashes(here, gram)
        start = np.arange(at, to)
        of = np.searchsorted(offsets, start, side="right") - 1
        inside = start + length <= offsets[of + 1]
        of, start = of[inside], start[inside] - at
        chosen = sliding_argmin(grams, length - gram + 1)[start]
        new = np.ones(len(of), bool)
        new[1:] = (chosen[1:] != chosen[:-1]) | (of[1:] != of[:-1])
        first = np.flatnonzero(new)
        base, at = at, to
        if to < end and len(of) and start[-1] == to - base - 1:  # the last run may go on: the next block begins with it
            at, first, until = base + start[first[-1]], first[:-1], first[-1]
        else:
            until = len(of)
        if not len(first):
            continue
        lo, hi = start[first], start[np.append(first[1:], until) - 1]
        anchor, text = chosen[first], of[first]
        context = span_hash(span_sums(here), lo, hi + length)
        context = mix(context + (anchor - lo).astype(np.uint64) * np.uint64(_SPAN))
        away = base - offsets[text]
        yield {"text": text, "anchor": grams[anchor].view(np.int64), "context": context.view(np.int64), "lo": lo + away, "hi": hi + away}


def windows_of(texts: list[bytes], of: np.ndarray, lo: np.ndarray, hi: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """run (index), start in its text and hash of each window of runs lo..hi of texts ``of``, a block of words at a time."""
    words, offsets = word_hashes(texts)
    begin = offsets[of] + lo
    order = np.argsort(begin, kind="stable")
    for runs in np.split(order, np.flatnonzero(np.diff(begin[order] // BLOCK)) + 1) if len(order) else []:
        base, many = begin[runs[0]], (hi - lo + 1)[runs]
        step = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        start = np.repeat(begin[runs] - base, many) + step
        sums = span_sums(words[base : base + int(start.max()) + length])
        yield np.repeat(runs, many), np.repeat(lo[runs], many) + step, span_hash(sums, start, start + length)


def pieces(text: bytes) -> Iterator[bytes]:
    """``text`` cut into pieces of about SLICE bytes where words end."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + SLICE)
        to = gap.start() if gap else len(text)
        yield text[at:to]
        at = to


def merged(lo: np.ndarray, hi: np.ndarray) -> list[tuple[int, int]]:
    """Spans, sorted by ``lo``, with those that touch or overlap joined."""
    if not len(lo):
        return []
    top = np.maximum.accumulate(hi)
    new = np.flatnonzero(np.append(True, lo[1:] > top[:-1]))
    return list(zip(lo[new].tolist(), top[np.append(new[1:], len(lo)) - 1].tolist(), strict=True))


def cut(text: bytes, spans: list[tuple[int, int]], put: Callable[[bytes], object]) -> tuple[int, int]:
    """Numbers of words and of removed ones; ``put`` gets the words outside ``spans``, joined by spaces, part by part."""
    n = kept = i = 0
    for piece in pieces(text):
        words = piece.split()
        left, at, end = [], n, n + len(words)
        while i < len(spans) and spans[i][0] < end:
            left += words[at - n : max(spans[i][0], at) - n]
            at = min(end, spans[i][1])
            if spans[i][1] > end:
                break
            i += 1
        left += words[at - n :]
        if left:
            put(b" " + b" ".join(left) if kept else b" ".join(left))
        n, kept = end, kept + len(left)
    return n, n - kept


def _rows(documents: DataFrame, key: str, text: str) -> DataFrame:
    return documents.select(F.col(key).cast("long").alias("doc"), F.xxhash64(text).alias("row"), F.col(text).alias("text"))


SEEDS = pa.schema([("doc", pa.int64()), ("row", pa.int64()), ("anchor", pa.int64()), ("context", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])
WINDOWS = pa.schema([("anchor", pa.int64()), ("window", pa.int64()), ("doc", pa.int64()), ("row", pa.int64()), ("lo", pa.int32())])


def repeats(documents: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc, row, spans: the maximal runs of words (lo, hi exclusive) that earlier documents hold."""
    rows = _rows(documents, key, text).where("doc IS NOT NULL AND text IS NOT NULL")

    def seeded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SLICE):
            for s in seeds_of(batch.column(2).cast(pa.binary()).to_pylist(), length, gram):
                at = pa.array(s.pop("text"))
                yield batch_of(SEEDS, doc=batch.column(0).take(at), row=batch.column(1).take(at), **s)

    def extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SLICE):
            runs = batch.column(3)
            of = np.repeat(np.arange(batch.num_rows), pa.compute.list_value_length(runs).to_numpy(zero_copy_only=False))
            lo, hi, anchor = (runs.flatten().field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1, 2))
            for run, start, window in windows_of(batch.column(2).cast(pa.binary()).to_pylist(), of, lo, hi, length):
                at = pa.array(of[run])
                yield batch_of(WINDOWS, anchor=anchor[run], window=window.view(np.int64), doc=batch.column(0).take(at), row=batch.column(1).take(at), lo=start)

    seeds = written(rows.mapInArrow(seeded, "doc long, row long, anchor long, context long, lo int, hi int"))
    # aggregates are written before they are joined back: next to a plain exchange a hot key can be split
    shared = written(seeds.groupBy("anchor").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").select("anchor"))
    hits = written(seeds.join(shared, "anchor"))
    discard(seeds)
    contexts = written(hits.groupBy("anchor", "context").agg(F.min("doc").alias("first")))
    mixed = written(contexts.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"))
    whole = hits.join(contexts, ["anchor", "context"]).where("doc > first").select("doc", "row", "lo", F.col("hi") + length)
    edge = contexts.join(mixed, "anchor").select("anchor", "context", F.col("first").alias("doc"))
    asked = hits.join(edge, ["anchor", "context", "doc"]).groupBy("doc", "row").agg(F.collect_set(F.struct("lo", "hi", "anchor")).alias("runs"))
    windows = written(rows.join(asked, ["doc", "row"]).select("doc", "row", "text", "runs").mapInArrow(extended, "anchor long, window long, doc long, row long, lo int"))
    firsts = written(windows.groupBy("anchor", "window").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").select("anchor", "window", "first"))
    parts = windows.join(firsts, ["anchor", "window"]).where("doc > first").select("doc", "row", "lo", F.col("lo") + length)
    return whole.union(parts).toDF("doc", "row", "lo", "hi").groupBy("doc", "row").agg(F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("spans"))


CUT = pa.schema([("doc", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary())])


def cut_repeats(documents: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, digest: bool = False) -> DataFrame:
    """doc, n_words, n_removed, kept: the words left of each row, joined by spaces (their SHA-256 if ``digest``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SLICE):
            many = pa.compute.fill_null(pa.compute.list_value_length(batch.column(2)), 0).to_numpy(zero_copy_only=False)
            lo, hi = (batch.column(2).flatten().field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            counts, removed, kept, at = [], [], [], 0
            for t, k in zip(batch.column(1).cast(pa.binary()).to_pylist(), many.tolist(), strict=True):
                whole = hashlib.sha256() if digest else bytearray()
                n, gone = cut(t or b"", merged(lo[at : at + k], hi[at : at + k]), whole.update if digest else whole.extend)
                at += k
                counts.append(n)
                removed.append(gone)
                kept.append(whole.digest() if digest else bytes(whole))
            yield batch_of(CUT, doc=batch.column(0), n_words=counts, n_removed=removed, kept=kept)

    found = repeats(documents, key, text, length)
    rows = _rows(documents, key, text).join(found, ["doc", "row"], "left")
    return rows.select("doc", "text", "spans").mapInArrow(run, "doc long, n_words long, n_removed long, kept binary")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = cut_repeats(table(spark, sf_dir, "documents"), digest=True)
    return cut.select(F.col("doc").alias("doc_id"), "n_words", "n_removed", F.lower(F.hex("kept")).alias("kept_sha256"))


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(ws) - 48)) AS i, ws FROM w WHERE len(ws) >= 50),
h AS (SELECT doc_id, i, sha256(array_to_string(ws[i:i + 49], ' ')) AS k FROM s),
f AS (SELECT k, min(doc_id) AS first FROM h GROUP BY k),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM h JOIN f USING (k) WHERE doc_id > first),
x AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM w),
g AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.p) AS kept, count(*) AS n FROM x LEFT JOIN c ON c.doc_id = x.doc_id AND c.p = x.p WHERE c.p IS NULL GROUP BY x.doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN g USING (doc_id)
"""
