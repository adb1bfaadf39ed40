"""Token counts with a whole-token shortcut.

The vocabulary file is read once per worker process.  A string of the vocabulary *encodes alone* when
the library, given just that string, returns exactly one token; these strings are proved offline
with the library itself and counted directly.  Any other pre-token is merged by the library, once per
distinct pre-token of a slice of rows.

Texts of all scripts take this path.  The steps before the merges (Unicode composition, white space, lower
case, the split pattern) are read from the file, and it must have just these.  Each assigned code point
is put through the library's own steps once, and those that come out otherwise than here (other
versions of Unicode) are ``odd``.  Only texts that hold an odd or unassigned character or a special token's string
go through the library whole.

Null text: empty, 0 tokens.  Very long texts are counted whole.  Repeated rows are counted each; there are
no ties.  Extra columns are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import batch_of, slices, table

#: Western texts: Latin-1 and general punctuation but for its spaces; composition leaves them as they are.
_LATIN = re.compile("[\\x00-\\xff\\u2010-\\u2027\\u2030-\\u205e]*")
#: Distinct merged pre-tokens kept between slices.
KEPT_WORDS = 1 << 18
SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])


def _byte_names() -> list[str]:
    """How the file spells bytes: printable Latin-1 as itself, the others by the next free characters."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    names, free = [], 256
    for b in range(256):
        names.append(chr(b if b in plain else free))
        free += b not in plain
    return names


_BYTE_NAMES = _byte_names()


class Counter:
    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        spec = json.load(open(path, encoding="utf-8"))
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.split, self.fine = self._steps(spec)
        self.plain = all(chr(c) in self.fine for c in range(0x2100) if _LATIN.fullmatch(chr(c)))
        self.latin = self._latin(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        suffix = spec["model"].get("end_of_word_suffix") or ""
        whole = [w for w in self._readable(spec["model"]["vocab"], suffix) if not self._strange(w) and self._pieces(w) == [w]]
        self.alone = {w: 1 for w, n in zip(whole, self._merged(whole), strict=True) if n == 1}
        self.known = dict(self.alone)

    def _steps(self, spec: dict) -> tuple:
        """The split pattern, and the code points that the library treats as ``_pieces`` does."""
        import regex

        before, cuts = spec["normalizer"], spec["pre_tokenizer"]
        steps = [(n["type"], n.get("pattern"), n.get("content")) for n in before.get("normalizers", [before])]
        split = cuts.get("pretokenizers", [cuts])
        if steps != [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)] or [c["type"] for c in split] != ["Split", "ByteLevel"]:
            raise ValueError("the vocabulary file has other steps than composition, white space, lower case and one split")
        if split[0]["behavior"] != "Removed" or not split[0]["invert"] or split[1]["use_regex"] or split[1]["add_prefix_space"]:
            raise ValueError("the vocabulary file splits otherwise than into the pattern's matches")
        self.split, self.latin = regex.compile(split[0]["pattern"]["Regex"]).findall, None
        assigned = [chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) not in ("Cn", "Cs", "Co")]
        fine = set()
        for at in range(0, len(assigned), 4096):
            part = assigned[at : at + 4096]
            # between letters: one piece for a letter, none for white space, its own for others
            probes = "\n".join(f"x{c}x" for c in part)
            theirs = [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(probes))]
            mine = [self._spelled(p) for p in self._pieces(probes)]
            if theirs == mine:
                fine.update(part)
                continue
            for c in part:
                theirs = [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(f"x{c}x"))]
                if theirs == [self._spelled(p) for p in self._pieces(f"x{c}x")]:
                    fine.add(c)
        return self.split, frozenset(fine)

    def _latin(self, pattern: str):
        """The split of lower-case Western texts by the faster engine, if it comes out alike for each of their characters."""
        for name, chars in ((r"\p{L}", "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff"), (r"\p{N}", "0-9\xb2\xb3\xb9\xbc-\xbe"), (r"\s", " \t-\r\x85\xa0")):
            pattern = pattern.replace(name, chars)
        try:
            found = re.compile(pattern.replace("[[", "[").replace("]]", "]")).findall
        except re.error:
            return None
        probes = [f"x{chr(c)}{y}" for c in range(0x2100) if _LATIN.fullmatch(chr(c)) for y in ("x", "7", " ", "'s", "..")]
        return found if all(found(t.lower()) == self._pieces(t) for t in probes) else None

    def _strange(self, text: str) -> bool:
        plain = self.plain and (text.isascii() or _LATIN.fullmatch(text))
        return any(s in text for s in self.special) or not (plain or self.fine.issuperset(text))

    def _pieces(self, text: str) -> list[str]:
        if self.latin and (text.isascii() or _LATIN.fullmatch(text)):
            return self.latin(text.lower())
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3")  # one by one, a last sigma is like others
        return self.split(text.lower())

    @staticmethod
    def _spelled(piece: str) -> str:
        return "".join(map(_BYTE_NAMES.__getitem__, piece.encode()))

    @staticmethod
    def _readable(vocabulary: Iterable[str], suffix: str) -> Iterator[str]:
        """Vocabulary entries that end a word, as text (entries spell bytes as printable characters)."""
        byte_of = {c: b for b, c in enumerate(_BYTE_NAMES)}
        for entry in vocabulary:
            if entry.endswith(suffix):
                try:
                    yield bytes(byte_of[c] for c in entry[: len(entry) - len(suffix)]).decode()
                except (KeyError, UnicodeDecodeError):
                    continue

    def _merged(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def counts(self, texts: list[str]) -> list[int]:
        if len(self.known) > KEPT_WORDS:
            self.known = dict(self.alone)
        out, pieces, whole = [0] * len(texts), {}, []
        for i, text in enumerate(texts):
            if self._strange(text):
                whole.append(i)
            else:
                pieces[i] = self._pieces(text)
        known = self.known
        new = list(set().union(*pieces.values()) - known.keys())
        known.update(zip(new, self._merged(new), strict=True))
        for i, p in pieces.items():
            out[i] = sum(map(known.__getitem__, p))
        for i in whole:
            out[i] = self._merged([texts[i]])[0]
        return out


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_bytes (UTF-8) and n_tokens of every row of ``documents`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        count = counter(path)
        for batch in slices(batches):
            ids, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            yield batch_of(SCHEMA, doc_id=ids, n_bytes=[len(t.encode()) for t in texts], n_tokens=count.counts(texts))

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return counted.withColumn("over_limit", counted["n_tokens"] > 2048)
