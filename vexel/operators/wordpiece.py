"""WordPiece token ids: basic splitting, then the longest pieces from the left."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPECIAL = ("[UNK]", "[CLS]", "[SEP]", "[PAD]")
WORD_LIMIT = 100
_BLANK = frozenset(map(chr, (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_HAN = ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B820, 0x2CEAF), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F))


@lru_cache(1 << 16)
def _kind(c: str) -> str:
    """'_' blank, 'x' dropped, 'p' stands alone, 'w' part of a word."""
    code = ord(c)
    if c in _BLANK:
        return "_"
    if code in (0, 0xFFFD) or unicodedata.category(c) in ("Cc", "Cf"):
        return "x"
    if any(a <= code <= b for a, b in _HAN) or 33 <= code <= 47 or 58 <= code <= 64 or 91 <= code <= 96 or 123 <= code <= 126 or unicodedata.category(c)[0] == "P":
        return "p"
    return "w"


class _Spaced(dict):
    """For str.translate: blanks as spaces, dropped characters gone, those that stand alone between spaces."""

    def __missing__(self, code: int) -> str | None:
        kind = _kind(chr(code))
        self[code] = out = {"_": " ", "x": None, "p": f" {chr(code)} ", "w": chr(code)}[kind]
        return out


class _Bare(dict):
    """For str.translate: characters without the marks that decomposing set apart."""

    def __missing__(self, code: int) -> str | None:
        self[code] = out = None if unicodedata.category(chr(code)) == "Mn" else chr(code)
        return out


_SPACED, _BARE = _Spaced(), _Bare()
_CAPITALS = {0x130: "i", 0x3A3: "σ"}
#: Words whose pieces a worker remembers, of so many letters at most; beyond it starts anew.
REMEMBERED, SHORT = 1 << 16, 32
#: Bytes of texts that a worker holds as strings, and letters that it splits at once.
HELD, PIECE = 1 << 20, 1 << 12


class WordPiece:
    def __init__(self, tokens: Iterable[str], lower: bool = True) -> None:
        """A token's id is its place; of equal ones the first counts, and the others still take a number."""
        self.ids: dict[str, int] = {}
        for n, token in enumerate(tokens):
            self.ids.setdefault(token, n)
        missing = [s for s in SPECIAL if s not in self.ids]
        if missing:
            raise ValueError(f"the vocabulary has no {', '.join(missing)}")
        self.lower = lower
        self._known: dict[str, list[int]] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_known": {}}

    @classmethod
    def read(cls, spark: SparkSession, path: str, lower: bool = True) -> WordPiece:
        """A vocabulary file of one token a line, read through Spark's file systems."""
        whole = spark.read.text(path, wholetext=True).first()
        lines = (whole.value if whole else "").split("\n")
        if lines and not lines[-1]:
            lines.pop()
        return cls((line.removesuffix("\r") for line in lines), lower)

    def split(self, text: str) -> list[str]:
        """The words and single characters of a text, with empty strings between."""
        if self.lower:
            text = text.lower() if text.isascii() else unicodedata.normalize("NFD", text.translate(_CAPITALS).lower()).translate(_BARE)
        return text.translate(_SPACED).split(" ")

    def words(self, text: str) -> Iterator[str]:
        """The words of a text in order, split piece by piece; a space never joins what stands beside it."""
        at = 0
        while at < len(text):
            end = text.find(" ", at + PIECE)
            end = len(text) if end < 0 else end + 1
            yield from filter(None, self.split(text[at:end]))
            at = end

    def pieces(self, word: str) -> list[int]:
        unknown = [self.ids["[UNK]"]]
        if len(word) > WORD_LIMIT:
            return unknown
        out, at = [], 0
        while at < len(word):
            for end in range(len(word), at, -1):
                piece = self.ids.get(word[at:end] if not at else "##" + word[at:end])
                if piece is not None:
                    out.append(piece)
                    at = end
                    break
            else:
                return unknown
        return out

    def encode(self, text: str, max_len: int = 256) -> list[int]:
        """[CLS] ... [SEP], max_len ids at most."""
        out, room, known = [self.ids["[CLS]"]], max(max_len - 2, 0), self._known
        for word in self.words(text):
            if len(out) - 1 >= room:
                break
            found = known.get(word)
            if found is None:
                found = self.pieces(word)
                if len(word) <= SHORT:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[word] = found
            out += found
        return [*out[: room + 1], self.ids["[SEP]"]]

    def column(self, text: Column | str, max_len: int = 256) -> Column:
        """An Arrow function over a text column; null texts give null."""

        @F.arrow_udf("array<bigint>")
        def ids(texts: pa.Array) -> pa.Array:
            return self.encode_array(texts, max_len)

        return ids(text)

    def encode_array(self, texts: pa.Array, max_len: int = 256) -> pa.Array:
        """Ids of each text, or null; HELD bytes of texts, and their ids, are Python's at a time."""
        parts = []
        size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        first = 0
        while first < len(texts):
            limit = HELD + (size[first - 1] if first else 0)
            stop = max(first + 1, min(int(np.searchsorted(size, limit, "right")), first + REMEMBERED // 64))
            rows = [None if t is None else self.encode(t, max_len) for t in texts.slice(first, stop - first).to_pylist()]
            parts.append(pa.array(rows, pa.list_(pa.int64())))
            first = stop
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int64()))

    def encode_table(self, texts: DataFrame, text_col: str = "text", out_col: str = "ids", max_len: int = 256) -> DataFrame:
        return texts.withColumn(out_col, self.column(text_col, max_len))


def padded(rows: list[list[int]], pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids as a matrix, and 1 where they are real."""
    longest = max(map(len, rows), default=0)
    ids, mask = np.full((len(rows), longest), pad, np.int64), np.zeros((len(rows), longest), np.int64)
    for k, row in enumerate(rows):
        ids[k, : len(row)] = row
        mask[k, : len(row)] = 1
    return ids, mask
