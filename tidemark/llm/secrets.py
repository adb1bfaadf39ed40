"""Secret scans: fixed patterns and a linear-chain conditional random field.

Base spans come from three patterns, leftmost and non-overlapping for each kind; a span is the whole
match.  The tagger labels tokens B, I or O (secret begin, inside, outside) from their shape, their
neighbours and a feature of the file, and Viterbi decodes the best labelling; a token is inside only if it touches the one before; spans of its secrets that
lie in no base span are added with kind ``crf``.  Base spans always stay.

Tokens are runs of letters, digits and ``_ + / . -``, or runs of other characters outside white space.
A text's labelling is the best one of the whole text, of any length.  A token is surely outside if any labelling
gets better by setting it outside, by the weights of its own and its neighbours' labels; runs of
other tokens between two such are decoded apart, many at once, which gives the same best labelling.  Of
labellings with equal scores the one with more outside, then more begin, wins.

Training: ``SNIPPETS`` seeded configuration lines, prose and decoys with known secrets, made here; no row
of the corpus is used, so the model is the same for every input.

Null text: empty, no spans.  Offsets are code points, ends exclusive.  Repeated rows get equal results.
Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import batch_of, map_batches, mix, powers, slices, table

KINDS = ("assign", "access", "hex", "crf")
#: The base patterns.  Runs shorter than 16 (hex) and 18 (access) fail, so they are left out here.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
LEAST_VALUE = 12

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    found: list[Span] = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


# Tokens and features

HASHED = 512
_LOWER, _UPPER, _DIGIT, _MARK, _OTHER, _WHITE = 1, 2, 4, 8, 16, 0
_CLASS = np.full(0x3000, _OTHER, np.uint8)
for _c in range(0x3000):
    _CLASS[_c] = _WHITE if chr(_c).isspace() else _LOWER if chr(_c).isalpha() else _OTHER
_CLASS[ord("A") : ord("Z") + 1] = _UPPER
_CLASS[ord("0") : ord("9") + 1] = _DIGIT
for _c in "_+/.-":
    _CLASS[ord(_c)] = _MARK
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Sizes of the features: length, shape, shape and digits, changes, own word, the two before, their shapes, the next, the file.
SIZES = (16, 64, 128, 32, HASHED, HASHED, HASHED, 64, 64, 64, 8)
_OFFSETS = np.cumsum((0, *SIZES))


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature indices [token, feature], token starts and ends (in their text), and offsets of texts' tokens."""
    points = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le"), np.uint32)
    begin = np.cumsum([0] + [len(t) + 1 for t in texts])
    cls = np.where(points < len(_CLASS), _CLASS[np.minimum(points, len(_CLASS) - 1)], _LOWER).astype(np.uint8)
    kind = np.where(cls == _WHITE, 0, np.where(cls == _OTHER, 2, 1)).astype(np.int8)
    edge = np.flatnonzero(np.diff(np.concatenate(([0], kind))))
    ends = np.append(edge[1:], len(points)) if len(edge) else edge
    word = kind[edge] > 0
    starts, ends = edge[word], ends[word]
    n = len(starts)
    size = ends - starts
    run = lambda x: (lambda c: c[ends] - c[starts])(np.concatenate(([0], np.cumsum(x))))
    digits, uppers, lowers = run(cls == _DIGIT), run(cls == _UPPER), run(cls == _LOWER)
    far_hex = run(((cls == _LOWER) & ((points < 97) | (points > 102))) | (cls == _UPPER) | (cls == _MARK))
    plain = run(points >= 128)
    step = np.zeros(len(cls), bool)
    step[1:] = (cls[1:] != cls[:-1]) & (cls[1:] > 0) & (cls[:-1] > 0)
    changes = run(step)
    low = np.where(cls == _UPPER, points + 32, points).astype(np.uint64)
    total = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(mix(low + np.uint64(7)) * powers(len(points)), out=total[1:])
    own = (mix((total[ends] - total[starts]) * powers(len(points) + 1, _INVERSE)[starts]) % np.uint64(HASHED)).astype(np.int64)
    length = np.minimum(15, (2 * np.log2(np.maximum(size, 1))).astype(np.int64))
    shape = (lowers > 0) + 2 * (uppers > 0) + 4 * (digits > 0) + 8 * (kind[starts] == 2) + 16 * ((far_hex == 0) & (kind[starts] == 1)) + 32 * (plain > 0)
    digit_share = np.minimum(7, (8 * digits) // np.maximum(size, 1))
    change_share = np.minimum(7, (16 * changes) // np.maximum(size, 1))
    offsets = np.searchsorted(starts, begin)
    of = np.repeat(np.arange(len(texts)), np.diff(offsets))
    shift = lambda x, k, fill: np.where((np.arange(n) + k >= offsets[of]) & (np.arange(n) + k < offsets[of + 1]), x[np.clip(np.arange(n) + k, 0, max(n - 1, 0))], fill) if n else x
    long_ = np.bincount(of[(size >= 16) & (digits > 0)], minlength=len(texts))
    file = np.minimum(7, (200 * long_) // np.maximum(np.diff(offsets), 1))
    columns = (
        length, shape, np.minimum(length, 15) * 8 + digit_share, np.minimum(length // 4, 3) * 8 + change_share, own,
        shift(own, -1, 0), shift(own, -2, 0), shift(shape, -1, 0), shift(shape, -2, 0), shift(shape, 1, 0), file[of],
    )
    index = np.stack([c.astype(np.int64) + o for c, o in zip(columns, _OFFSETS, strict=False)], 1) if n else np.zeros((0, len(SIZES)), np.int64)
    return index, starts - begin[of], ends - begin[of], offsets


def apart(starts: np.ndarray, ends: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Tokens that do not touch the one before; those are never inside."""
    gap = np.ones(len(starts), bool)
    gap[1:] = starts[1:] != ends[:-1]
    gap[offsets[:-1][np.diff(offsets) > 0]] = True
    return gap


# The field: labels O, B, I; I follows only B or I that it touches

ALLOWED = np.array([[0, 0, -1e9], [0, 0, 0], [0, 0, 0]])
FIRST = np.array([0, 0, -1e9])


def sure_outside(emission: np.ndarray, offsets: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Tokens that are outside in every best labelling: whatever the neighbours' labels are, begin or inside
    is worse there.  An inside token that follows becomes a begin in the comparison."""
    n = len(emission)
    if not n:
        return np.zeros(0, bool)
    last = np.zeros(n, bool)
    last[offsets[1:][np.diff(offsets) > 0] - 1] = True
    following = np.zeros(n)  # the next token as begin instead of inside
    following[:-1] = emission[1:, 1] - emission[1:, 2]
    after = min((move[1, c] - move[2, c] for c in range(3)), default=0.0)
    sure = np.ones(n, bool)
    for y in (1, 2):
        before = min([move[a, 0] - move[a, y] for a in range(3) if move[a, y] > -1e8] + [0.0])
        plain = min(move[0, 0] - move[y, 0], move[0, 1] - move[y, 1], 0.0)
        inside = move[0, 1] - move[y, 2] + following + min(after, 0.0)
        gain = emission[:, 0] - emission[:, y] + before + np.where(last, 0.0, np.minimum(plain, inside))
        sure &= gain > 1e-6
    return sure


def viterbi(emission: np.ndarray, offsets: np.ndarray, move: np.ndarray) -> np.ndarray:
    """The best labels of all tokens (0 outside, 1 begin, 2 inside)."""
    n = len(emission)
    labels = np.zeros(n, np.int8)
    if not n:
        return labels
    sure = sure_outside(emission, offsets, move)
    first, last = np.zeros(n, bool), np.zeros(n, bool)
    bounds = offsets[1:][np.diff(offsets) > 0]
    first[offsets[:-1][np.diff(offsets) > 0]] = last[bounds - 1] = True
    starts = np.flatnonzero(~sure & (first | np.concatenate(([True], sure[:-1]))))
    ends = np.flatnonzero(~sure & (last | np.concatenate((sure[1:], [True])))) + 1
    order = np.argsort(starts - ends, kind="stable")
    start, width = starts[order], (ends - starts)[order]
    if not len(start):
        return labels
    best = emission[start] + np.where(first[start][:, None], FIRST, move[0])
    back = []
    for t in range(1, int(width[0])):
        live = int(np.searchsorted(-width, -t, side="left"))
        through = best[:live, :, None] + move
        back.append(through.argmax(1).astype(np.int8))
        best[:live] = through.max(1) + emission[start[:live] + t]
    best += np.where(last[start + width - 1][:, None], 0.0, move[:, 0])
    at = best.argmax(1).astype(np.int8)
    for t in range(int(width[0]) - 1, -1, -1):
        live = int(np.searchsorted(-width, -t, side="left"))
        labels[start[:live] + t] = at[:live]
        if t:
            at[:live] = np.take_along_axis(back[t - 1], at[:live, None].astype(np.int64), 1)[:, 0]
    return labels


SNIPPETS, ROUNDS, SEED = 1000, 40, 5
#: Names before a secret, separators, and words of decoys.
NAMES = "password passwd secret token api_key apikey access_key private_key auth client_secret credential pwd bearer signature".split()
PLAIN_NAMES = "name size count color version date path host port user width limit region commit order phone mail card page".split()
SYLLABLES = "the re ing er on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce ción ß ü ä é è mente keit schung heit tion eau llo ñ que aux".split()


def snippets(seed: int = SEED) -> list[tuple[str, list[tuple[int, int]]]]:
    """Training texts with their secrets' spans."""
    r = random.Random(seed)
    pick = lambda chars, a, b: "".join(r.choice(chars) for _ in range(r.randint(a, b)))
    mixed, hexes = string.ascii_letters + string.digits, "0123456789abcdef"

    def word() -> str:
        w = "".join(r.choice(SYLLABLES) for _ in range(r.choice((1, 1, 2, 2, 3, 4, 5, 7, 10))))
        return w.capitalize() if r.random() < 0.15 else w.upper() if r.random() < 0.08 else w

    def punctuated() -> str:
        parts = [pick(mixed, 2, 7) for _ in range(r.randint(3, 5))]
        return "".join(p + r.choice("!@#$%^&*?~") for p in parts[:-1]) + parts[-1] + r.choice(("", "", "!", "#", "$"))

    def secret() -> str:
        if r.random() < 0.3:  # secrets of several tokens
            return r.choice((punctuated, punctuated, lambda: pick(mixed + "+/", 22, 62) + r.choice(("=", "==")), lambda: f"{word()}:{pick(mixed, 8, 20)}@{word()}.example.com"))()
        return r.choice((
            lambda: pick(hexes, 20, 64), lambda: pick(mixed, 20, 48), lambda: pick(mixed + "+/", 24, 64), lambda: "AKIA" + pick(string.ascii_uppercase + string.digits, 16, 16),
            lambda: r.choice(("ghp_", "glpat-", "sk_live_", "xoxb-")) + pick(mixed, 24, 40), lambda: pick(mixed, 16, 20), lambda: "eyJ" + pick(mixed, 20, 30) + "." + pick(mixed, 20, 40),
        ))()

    def decoy() -> str:
        return r.choice((
            lambda: pick(string.digits, 1, 19), lambda: f"{word()}.{r.randint(1, 99)}@{word()}.example.com", lambda: f"+1 ({pick(string.digits, 3, 3)}) 555-{pick(string.digits, 4, 4)}",
            lambda: f"20{r.randint(10, 29)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}T{pick(string.digits, 2, 2)}:{pick(string.digits, 2, 2)}", lambda: "#" + pick(hexes, 6, 6),
            lambda: f"https://www.{word()}.com/{word()}/{word()}-{word()}_{r.randint(1, 9999)}.html", lambda: f"{word()}_{word()}_{word()}", lambda: f"v{r.randint(0, 20)}.{r.randint(0, 20)}.{r.randint(0, 99)}",
            lambda: "".join(word() for _ in range(3)), lambda: r.choice("!?.|*&%$#-=") * r.randint(1, 60), lambda: f"{word()}&{word()}", lambda: f"{word()}!{word()}?", lambda: f"{word()}#{r.randint(1, 99)}",
            lambda: f"{word()}({word()}, {r.randint(0, 99)})", lambda: f"{word()}={word()}&{word()}={r.randint(0, 9999)}", lambda: "$" + pick(string.digits, 1, 4) + "." + pick(string.digits, 2, 2), lambda: f"{pick(string.digits, 1, 2)}%", lambda: f"{word()}'{word()}",
 lambda: f"{pick(string.digits, 1, 3)}.{pick(string.digits, 1, 3)}.{pick(string.digits, 1, 3)}.{pick(string.digits, 1, 3)}",
        ))()

    out = []
    for _ in range(SNIPPETS):
        text, spans = "", []
        for _ in range(r.randint(1, 12)):
            p = r.random()
            if p < 0.16:
                q = r.choice(("", "", '"', "'"))
                text += r.choice(NAMES if r.random() < 0.75 else PLAIN_NAMES) + r.choice((" = ", "=", ": ", '": ', " ")) + q
                s = secret()
                spans.append((len(text), len(text) + len(s)))
                text += s + q
            elif p < 0.32:
                text += r.choice(PLAIN_NAMES if r.random() < 0.8 else NAMES) + r.choice((" = ", "=", ": ")) + decoy()
            elif p < 0.42:
                text += decoy()
            elif p < 0.45:
                text += " ".join([word()] * r.randint(3, 30))
            else:
                text += " ".join(word() + r.choice(("", "", "", ",", ".")) for _ in range(r.randint(2, 12)))
            text += r.choice((" ", " ", "\n", ", "))
        out.append((text, spans))
    return out


@lru_cache(maxsize=1)
def trained() -> tuple[np.ndarray, np.ndarray]:
    """Emission weights [feature, label] and moves [label, label], by gradient ascent on the likelihood."""
    made = snippets()
    index, starts, ends, offsets = features([t for t, _ in made])
    gap = apart(starts, ends, offsets)
    gold = np.zeros(len(index), np.int64)
    for i, (_, spans) in enumerate(made):
        a, b = offsets[i], offsets[i + 1]
        for s, e in spans:
            inside = np.flatnonzero((starts[a:b] < e) & (ends[a:b] > s)) + a
            gold[inside] = 2
            gold[inside[:1]] = 1
    start, width = offsets[:-1], np.diff(offsets)
    steps, lanes = int(width.max()), len(start)
    live = np.arange(steps)[:, None] < width
    at = np.where(live, start + np.arange(steps)[:, None], 0)
    weight, move = np.zeros((int(_OFFSETS[-1]), 3)), np.zeros((3, 3))
    moments = [np.zeros_like(weight), np.zeros_like(weight), np.zeros_like(move), np.zeros_like(move)]
    lse = lambda x, axis: (m := x.max(axis)) + np.log(np.exp(x - np.expand_dims(m, axis)).sum(axis))
    both = live[1:] & live[:-1]
    pairs = np.zeros((3, 3))
    np.add.at(pairs, (gold[at[:-1]][both], gold[at[1:]][both]), 1)
    for k in range(1, ROUNDS + 1):
        emission = weight[index].sum(1)
        emission[gap, 2] = -1e9
        full = move + ALLOWED
        fore, aft = np.zeros((steps, lanes, 3)), np.zeros((steps, lanes, 3))
        fore[0] = emission[at[0]] + FIRST
        for t in range(1, steps):
            fore[t] = np.where(live[t][:, None], lse(fore[t - 1][:, :, None] + full, 1) + emission[at[t]], fore[t - 1])
        for t in range(steps - 2, -1, -1):
            aft[t] = np.where(live[t + 1][:, None], lse(full[None] + (emission[at[t + 1]] + aft[t + 1])[:, None, :], 2), 0)
        log_z = lse(fore[-1], 1)
        belief = np.exp(fore + aft - log_z[None, :, None])
        wrong = np.zeros((len(index), 3))
        wrong[at[live]] = -belief[live]
        wrong[np.arange(len(index)), gold] += 1
        grad = np.zeros_like(weight)
        for f in range(index.shape[1]):
            for label in range(3):
                grad[:, label] += np.bincount(index[:, f], weights=wrong[:, label], minlength=len(weight))
        joint = np.exp(fore[:-1, :, :, None] + full + (emission[at[1:]] + aft[1:])[:, :, None, :] - log_z[None, :, None, None])
        grad_move = pairs - joint[both].sum(0)
        for value, g, m, v, decay in ((weight, grad, moments[0], moments[1], 0.02), (move, grad_move, moments[2], moments[3], 0.0)):
            g = g / len(made) - decay * value / 100
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            value += 0.15 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-6)
    return weight, move + ALLOWED


def tagged_spans(texts: list[str], model: tuple[np.ndarray, np.ndarray]) -> list[list[Span]]:
    """Spans of the secrets that the tagger finds in each text."""
    weight, move = model
    index, starts, ends, offsets = features(texts)
    emission = np.zeros((len(index), 3))
    for f in range(index.shape[1]):
        emission += weight[index[:, f]]
    emission[apart(starts, ends, offsets), 2] = -1e9
    labels = viterbi(emission, offsets, move)
    out: list[list[Span]] = [[] for _ in texts]
    hits = np.flatnonzero(labels)
    for i, h in zip((np.searchsorted(offsets, hits, side="right") - 1).tolist(), hits.tolist(), strict=True):
        spans = out[i]
        if labels[h] == 2 and spans and h > offsets[i] and labels[h - 1]:
            spans[-1] = ("crf", spans[-1][1], int(ends[h]))
        else:
            spans.append(("crf", int(starts[h]), int(ends[h])))
    return out


def outside(spans: list[Span], base: list[Span]) -> list[Span]:
    """Those of ``spans`` that lie in no span of ``base``; both by start, so one pass over each."""
    free, reach, at = [], -1, 0
    for s in spans:
        while at < len(base) and base[at][1] <= s[1]:
            reach = max(reach, base[at][2])
            at += 1
        if reach < s[2]:
            free.append(s)
    return free


def all_spans(texts: list[str], model: tuple[np.ndarray, np.ndarray]) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text, by start and then kind."""
    out = []
    for text, more in zip(texts, tagged_spans(texts, model), strict=True):
        base = base_spans(text)
        out.append((base, sorted(base + outside(more, base), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))))
    return out


SPANS = pa.schema([("id", pa.int64()), ("base", pa.list_(pa.string())), ("spans", pa.list_(pa.string()))])


def joined(spans: list[Span]) -> list[str]:
    return [f"{k}:{a}:{b}" for k, a, b in spans]


def scan(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """id, base and spans (arrays of kind:start:end) of every row of ``documents`` (key, text)."""
    model = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=1 << 20):
            found = all_spans([t or "" for t in batch.column(1).to_pylist()], model)
            yield batch_of(SPANS, id=batch.column(0), base=[joined(b) for b, _ in found], spans=[joined(s) for _, s in found])

    return documents.select(key, "text").mapInArrow(run, "id long, base array<string>, spans array<string>")


MASKED = "[SECRET]"


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each run of overlapping spans replaced by MASKED."""
    out, at = [], 0
    for _, a, b in spans:
        if a >= at:
            out += [text[at:a], MASKED]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(documents: DataFrame, text: str = "text") -> DataFrame:
    """``documents`` with secrets masked in ``text``; a text without secrets, or null, is left as it is."""
    model, at = trained(), documents.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, f"c{at}", 1 << 20):
            texts = batch.column(at).to_pylist()
            found = all_spans([t or "" for t in texts], model)
            new = [t if t is None or not s else redacted(t, s) for t, (_, s) in zip(texts, found, strict=True)]
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))

    return map_batches(documents, run)


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    count = lambda kind: F.size(F.filter("base", lambda s: s.startswith(f"{kind}:"))).cast("long").alias(f"n_{kind}")
    found = scan(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), count("assign"), count("access"), count("hex"), F.sha2(F.array_join("base", ","), 256).alias("base_sha256"), F.array_join("spans", ",").alias("spans")
    )
