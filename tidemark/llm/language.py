"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over a bounded sample of its labelled text.  A text is
parsed greedily into phrases, each the longest match that starts where the last one ended; a language
needs ``phrases * log2(sample length) / characters`` bits per character, and the least wins.

Text is folded first: lower case, letters kept, every run of other characters becomes one space.  Each letter
of the samples has its own code, however many there are; a letter that no sample has matches nothing.
Parsing follows one transition per character, for many blocks of ``BLOCK`` characters and all
languages at once.  Blocks do not cut phrases: each block is parsed as if a phrase began with it, then
the parse that really comes in from the block before runs on until one of its phrases begins where one of
the block's own does; from there on both are the same.  So counts are those of one parse of the whole text.

The sample (fit): rows whose hash of doc_id falls under a threshold set from each language's row count,
so about ``SAMPLE_ROWS`` rows of a language, of which in hash order the first ``SAMPLE_CHARS`` folded
characters are kept, at most ``ROW_CHARS`` a row.  Row counts cover all rows.  The model is these texts,
so its size is bounded by SAMPLE_CHARS per language; workers build the automata from them once.

Null text or text without a letter: ``und``, score 0.  Very long texts are parsed whole.  Ties go to the
language with more labelled rows, then by name.  Repeated rows get equal results.  No labelled rows
at all: every text is ``und``.  Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_of, map_batches, slices, table

SAMPLE_ROWS, SAMPLE_CHARS, ROW_CHARS = 400, 40_000, 2_000
BLOCK, DENSE = 256, 62
#: Bytes of text parsed at once; bounds a worker's arrays.
SLICE = 1 << 20
UND = "und"
Model = tuple[tuple[str, str], ...]  # (language, folded sample), by rank: more rows first


def fold(text: str) -> str:
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def fit(labelled: DataFrame, lang: str = "lang", key: str = "doc_id") -> Model:
    """Samples labelled rows (key, text, lang) as described above; rows without a label are left out."""
    rows = labelled.select(key, "text", lang).where(F.col(lang).isNotNull() & F.col("text").isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang).count().collect()}
    if not counts:
        return ()
    at = F.pmod(F.xxhash64(key), F.lit(1 << 40))
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, int(min(1.0, SAMPLE_ROWS / n) * (1 << 40)))])
    taken = rows.where(at < share[F.col(lang)]).select(lang, at.alias("at"), F.left("text", F.lit(4 * ROW_CHARS)).alias("text"))
    by: dict[str, list] = {k: [] for k in counts}
    for r in taken.collect():
        by[r[0]].append((r["at"], r["text"]))
    model = []
    for k in sorted(counts, key=lambda k: (-counts[k], k)):
        texts, size = [], 0
        for t in dict.fromkeys(fold(t)[:ROW_CHARS] for _, t in sorted(by[k])):
            if size < SAMPLE_CHARS:
                texts.append(t)
                size += len(t)
        if folded := " ".join(texts)[:SAMPLE_CHARS].strip():
            model.append((k, f" {folded} "))
    return tuple(model)


def automaton(text: list[int]) -> list[dict[int, int]]:
    """The suffix automaton's transitions: of each state, the next by letter."""
    after, link, length, last, n = [dict()], [-1], [0], 0, 1
    for c in text:
        cur = n
        after.append({})
        length.append(length[last] + 1)
        link.append(0)
        n += 1
        p = last
        while p >= 0 and c not in after[p]:
            after[p][c] = cur
            p = link[p]
        if p >= 0:
            q = after[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                after.append(dict(after[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and after[p].get(c) == q:
                    after[p][c] = n
                    p = link[p]
                link[q] = link[cur] = n
                n += 1
        last = cur
    return after


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """1 for each code point that is a letter, 0 for others."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), np.int32, 0x110000)


class Parser:
    """All languages' automata in one table, whose entries below zero also end a phrase.

    The table has a column for each of the ``DENSE`` most frequent letters; transitions by others are few
    and are kept as sorted keys (state, letter).
    """

    def __init__(self, model: Model) -> None:
        seen = Counter(c for _, t in model for c in t if c != " ")
        code = {c: i + 2 for i, (c, _) in enumerate(sorted(seen.items(), key=lambda x: (-x[1], x[0])))}
        self.codes_ = len(code) + 2  # 0: space, 1: any letter that no sample has
        self.letters = min(self.codes_, DENSE + 2)
        self.code = _letters().copy()
        for c, i in code.items():
            self.code[ord(c)] = i
        self.names, self.bits, tables, self.root, self.lone, base = [], [], [], [], [], 0
        keys, targets = [], []
        for name, text in model:
            after = automaton([0 if c == " " else code[c] for c in text])
            # no transition: the phrase ends and the next begins at this character; one that the sample
            # lacks is a phrase of its own, in a last state without transitions
            t = np.full((len(after) + 1, self.letters), -1, np.int32)
            for s, d in enumerate(after):
                for c, to in d.items():
                    if c < self.letters:
                        t[s, c] = to
                    else:
                        keys.append((base + s) * self.codes_ + c)
                        targets.append(base + to)
            start = t[0]
            fresh = (np.where(start >= 0, start, len(t) - 1) + base).astype(np.int32)
            tables.append(np.where(t >= 0, t + np.int32(base), -1 - fresh[None, :]).astype(np.int32, copy=False))
            self.names.append(name)
            self.bits.append(math.log2(len(text)))
            self.root.append(base)
            base += len(t)
            self.lone.append(base - 1)
        self.step = np.concatenate(tables).ravel()
        self.root, self.lone = np.array(self.root, np.int64), np.array(self.lone, np.int64)
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.targets = np.array(keys, np.int64)[order], np.array(targets, np.int32)[order]

    def _find(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The next states by letters outside the table, -1 where there is none."""
        key = state * self.codes_ + letter
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.targets[at], -1)

    def _next(self, state: np.ndarray, letter: np.ndarray, lang: np.ndarray) -> np.ndarray:
        """Entries of the table for states [..., text], the texts' letters and languages that fit states' shape."""
        to = self.step[state * self.letters + np.minimum(letter, self.letters - 1)]
        if len(rare := np.flatnonzero(letter >= self.letters)):
            of = lang[..., rare] if lang.shape[-1] == len(letter) else lang
            found, first = self._find(state[..., rare], letter[rare]), self._find(self.root[of], letter[rare])
            to[..., rare] = np.where(found >= 0, found, -1 - np.where(first >= 0, first, self.lone[of]))
        return to

    def codes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Folded codes of all texts, each text between two spaces, and each code's text."""
        whole = "".join(f"\0{t} " for t in [*texts, ""]).lower()
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        out = self.code[points]
        owner = np.cumsum(points == 0) - 1
        keep = np.ones(len(out), bool)
        keep[1:] = (out[1:] > 0) | (out[:-1] > 0) | (owner[1:] != owner[:-1])
        keep &= owner < len(texts)
        return out[keep], owner[keep]

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases [text, language] and folded characters of each text (0 if it has no letter)."""
        codes, owner = self.codes(texts)
        n, k = len(texts), len(self.names)
        letters = np.bincount(owner[codes > 0], minlength=n)
        size = np.bincount(owner, minlength=n)
        first = np.cumsum(size) - size
        blocks = -(-size // BLOCK)
        of = np.repeat(np.arange(n), blocks)
        start = np.repeat(first, blocks) + (np.arange(len(of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)) * BLOCK
        limit = (first + size)[of]
        end = np.minimum(start + BLOCK, limit)
        begins, state = self._parse(codes, start, end)
        cuts = np.flatnonzero(end < limit)  # blocks with a next one in their text
        extra, enter = np.zeros((k, len(of)), np.int64), np.repeat(start[None], k, 0)
        more, meet = self._run_on(codes, begins, state[:, cuts], end[cuts], limit[cuts])
        extra[:, cuts], enter[:, cuts + 1] = more, meet
        total = np.zeros((n, k), np.int64)
        for i in range(k):
            run = np.concatenate(([0], np.cumsum(begins[i], dtype=np.int32)))
            total[:, i] = np.bincount(of, weights=run[end] - run[np.minimum(enter[i], end)] + extra[i], minlength=n)
            for t in np.unique(of[(enter[i] >= end) & (end < limit)]):  # a block was passed without meeting: follow
                at, b, last = 0, int(np.searchsorted(of, t)), int(np.searchsorted(of, t, side="right")) - 1
                base, here = b, int(start[b])
                while True:
                    at += int(run[end[b]] - run[here] + extra[i, b])
                    if b == last or enter[i, b + 1] >= limit[b]:
                        break
                    here = int(enter[i, b + 1])
                    b = base + (here - int(start[base])) // BLOCK
                total[t, i] = at
        return total, np.where(letters > 0, size, 0)

    def _parse(self, codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where phrases begin [language, character] and last states [language, block], each block parsed on its own."""
        lang = np.arange(len(self.names))[:, None]
        begins = np.zeros((len(lang), len(codes)), bool)
        order = np.argsort(start - end, kind="stable")
        at, width = start[order], (end - start)[order]
        state = np.repeat(self.root[:, None], len(at), 1)
        for t in range(int(width[0]) if len(width) else 0):
            live = int(np.searchsorted(-width, -t, side="left"))
            here = at[:live] + t
            to = self._next(state[:, :live], codes[here], lang)
            ended = to < 0
            begins[:, here] = ended if t else True
            state[:, :live] = np.where(ended, -1 - to, to)
        out = np.empty_like(state)
        out[:, order] = state
        return begins, out

    def _run_on(self, codes: np.ndarray, begins: np.ndarray, state: np.ndarray, at: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Goes on from each block's end to the first phrase that also begins in ``begins`` (or the text's end):
        phrases begun before it, and its place, each [language, block]."""
        k, m = state.shape
        more, meet = np.zeros(k * m, np.int64), np.tile(limit, k)
        pair, lang, state, at, limit = np.arange(k * m), np.repeat(np.arange(k), m), state.ravel(), np.tile(at, k), np.tile(limit, k)
        while len(pair):
            to = self._next(state, codes[at], lang)
            ended = to < 0
            met = ended & begins[lang, at]
            meet[pair[met]] = at[met]
            more[pair[ended & ~met]] += 1
            at = at + 1
            on = ~met & (at < limit)
            pair, lang, state, at, limit = pair[on], lang[on], np.where(ended, -1 - to, to)[on], at[on], limit[on]
        return more.reshape(k, m), meet.reshape(k, m)


@lru_cache(maxsize=2)
def parser(model: Model) -> Parser:
    return Parser(model)


def identify(model: Model, texts: list[str]) -> tuple[list[str], list[float]]:
    """Language and score of each text; the score is the winner's margin over the next, 0 to 1."""
    if not model or not texts:
        return [UND] * len(texts), [0.0] * len(texts)
    p = parser(model)
    phrases, size = p.phrases([t.replace("\0", " ") for t in texts])
    cost = phrases * np.array(p.bits) / np.maximum(size, 1)[:, None]
    best = np.argmin(cost, 1)
    low = np.sort(cost, 1)
    score = 1 - low[:, 0] / low[:, 1] if len(model) > 1 else np.ones(len(texts))
    return [p.names[b] if s else UND for b, s in zip(best, size, strict=True)], np.where(size > 0, score, 0.0).tolist()


def _slice(model: Model) -> int:
    """Bytes of text at once: a parse keeps a mark per character and language."""
    return SLICE * 8 // max(8, len(model))


SCHEMA = pa.schema([("id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])


def predict(documents: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """id, lang_pred, score of every row of ``documents`` (key, text); nothing but the text is looked at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=_slice(model)):
            langs, scores = identify(model, [t or "" for t in batch.column(1).to_pylist()])
            yield batch_of(SCHEMA, id=batch.column(0), lang_pred=langs, score=scores)

    return documents.select(key, "text").mapInArrow(run, "id long, lang_pred string, score double")


def keep_known(documents: DataFrame, model: Model, text: str = "text", lang: str | None = None) -> DataFrame:
    """The rows of ``documents`` whose text has a language (without a model: a letter), all columns unchanged, but
    that a null in column ``lang``, if one is named, becomes the predicted language."""

    body, label = documents.columns.index(text), None if lang is None else documents.columns.index(lang)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, f"c{body}", _slice(model)):
            texts = [t or "" for t in batch.column(body).to_pylist()]
            if model:
                found = [None if x == UND else x for x in identify(model, texts)[0]]
                kept = [x is not None for x in found]
                if label is not None:
                    field = batch.schema.field(label)
                    batch = batch.set_column(label, field, pa.compute.coalesce(batch.column(label), pa.array(found, field.type)))
            else:
                kept = [any(c.isalpha() for c in t) for t in texts]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return map_batches(documents, run)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = fit(documents.where(~held_out()))
    found = predict(documents, model).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
