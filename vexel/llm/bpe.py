"""Byte-pair vocabularies as numpy tables: splitting text into words, and looking up pairs.

``Vocabulary`` reads a public rank file (base64 token, rank on each line; a token's rank is
its id). ``pretokens`` cuts a block of text where the published pattern cuts it

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

without running a regular expression over it: characters become classes through one table
and cuts follow from where classes change. A file's path must be readable on every
executor; each Python worker reads it once.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import regex

from vexel.llm.blocks import Block, Words, span_hash, spread

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
NONE = np.int64(1 << 40)
_SPACE, _LETTER, _NUMBER, _OTHER = range(4)


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of every code point."""
    table = np.full(0x110000, _OTHER, np.uint8)
    table[0xD800:0xE000] = _OTHER
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for number, pattern in ((_SPACE, r"\s+"), (_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, every):
            a, b = (x + 0x800 if x >= 0xD800 else x for x in (m.start(), m.end()))
            table[a:b] = number
    table[0xD800:0xE000] = _OTHER
    return table


def pretokens(block: Block) -> Words:
    """The block's words by the published pattern; they cover every byte."""
    data = block.data
    at = np.flatnonzero((data & 0xC0) != 0x80)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    n = len(points)
    kind = classes()[points]
    heads = np.zeros(n + 1, bool)
    heads[np.searchsorted(at, block.offsets)] = True
    heads[n] = True
    run = heads[:-1].copy()
    run[1:] |= kind[1:] != kind[:-1]
    space = kind == _SPACE
    cut = run.copy()
    if n:
        # The last character of white space before something else stands apart; a blank joins what follows.
        last = np.flatnonzero(space[:-1] & ~space[1:] & ~heads[1:-1])
        cut[last] = True
        joined = last[points[last] == 32]
        cut[joined + 1] = False
        # A quote that begins a word takes s, t, m, d, re, ve or ll with it.
        quote = np.flatnonzero((points == 39) & cut)
        quote = quote[(quote + 1 < n)]
        quote = quote[~heads[quote + 1]]
        one, two = points[quote + 1], np.zeros(len(quote), np.uint32)
        more = (quote + 2 < n) & ~heads[np.minimum(quote + 2, n)]
        two[more] = points[quote[more] + 2]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        cut[quote[short | long] + 1] = False
        for where, size in ((short, 2), (long, 3)):
            after = quote[where] + size
            cut[after[after < n]] = True
            if size == 3:
                cut[quote[where] + 2] = False
        # A blank after the quoted letters begins its own word already; letters' own runs are cut above.
    starts = at[cut]
    ends = np.append(starts[1:], len(data)) if len(starts) else starts
    first = np.searchsorted(starts, block.offsets)
    row = np.repeat(np.arange(block.rows), np.diff(first))
    return Words(starts, ends, row, span_hash(data, starts, ends), first)


class Vocabulary:
    """Tokens, and for pairs of tokens the rank of what they merge into."""

    def __init__(self, path: str = DEFAULT_VOCABULARY) -> None:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.ranks, self.size = ranks, max(ranks.values()) + 1
        self.tokens = [b""] * self.size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        keys, values = [], []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                left, right = ranks.get(token[:k]), ranks.get(token[k:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
        order = np.argsort(keys)
        self.keys, self.values = np.array(keys, np.int64)[order], np.array(values, np.int64)[order]
        left, right = self.keys >> 32, self.keys & 0xFFFFFFFF
        least = np.full(self.size, NONE)
        np.minimum.at(least, left, self.values)
        np.minimum.at(least, right, self.values)
        #: Whether all that a token can take part in ranks above it; then equal pairs of one word can merge at once.
        self.rising = least > np.arange(self.size)
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.joined = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.offsets = np.concatenate(([0], np.cumsum(self.lengths)))

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of adjacent tokens, NONE where they don't merge."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], NONE)

    def decode(self, ids: np.ndarray) -> bytes:
        lengths = self.lengths[ids]
        return self.joined[np.repeat(self.offsets[ids], lengths) + spread(lengths)].tobytes()


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    """The worker's own copy."""
    return Vocabulary(path)


def alternate(hit: np.ndarray) -> np.ndarray:
    """Of positions in a row, every second from the first: those that merge where all overlap."""
    at = np.flatnonzero(hit)
    fresh = np.ones(len(at), bool)
    fresh[1:] = np.diff(at) != 1
    start = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
    out = np.zeros_like(hit)
    out[at[(np.arange(len(at)) - start) % 2 == 0]] = True
    return out


def merge(v: Vocabulary, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact ids of byte spans, one after another, and how many each span has.

    In every round each span merges its own lowest pair, leftmost first; all words advance
    together, and finished ones leave the arrays.
    """
    n = len(starts)
    ids = v.byte[data[np.repeat(starts, lengths) + spread(lengths)]]
    word = np.repeat(np.arange(n), lengths)
    done_ids, done_word = [], []
    rank = np.full(len(ids), NONE)
    same = word[1:] == word[:-1]
    rank[:-1][same] = v.pair(ids[:-1][same], ids[1:][same])
    while len(ids):
        first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        low = np.minimum.reduceat(rank, first)
        sizes = np.diff(np.append(first, len(ids)))
        over = np.repeat(low == NONE, sizes)
        if over.any():
            done_ids.append(ids[over])
            done_word.append(word[over])
            ids, word, rank = ids[~over], word[~over], rank[~over]
            keep = low != NONE
            low, sizes = low[keep], sizes[keep]
            if not len(ids):
                break
            first = np.cumsum(sizes) - sizes
        hit = rank == np.repeat(low, sizes)
        at = np.flatnonzero(hit)
        lone = ~v.rising[rank[at]]
        if lone.any():  # only the leftmost of each such word
            owner = word[at]
            leftmost = np.ones(len(at), bool)
            leftmost[1:] = owner[1:] != owner[:-1]
            hit[at[lone & ~leftmost]] = False
        hit = alternate(hit)
        at = np.flatnonzero(hit)
        ids[at] = rank[at]
        keep = np.ones(len(ids), bool)
        keep[at + 1] = False
        new = np.cumsum(keep) - 1
        ids, word = ids[keep], word[keep]
        rank = rank[keep]
        at = new[at]
        touched = np.concatenate((at, at[at > 0] - 1))
        inner = touched[touched + 1 < len(ids)]
        inner = inner[word[inner] == word[inner + 1]]
        rank[touched] = NONE
        rank[inner] = v.pair(ids[inner], ids[inner + 1])
    if not done_ids:
        return np.zeros(0, np.int64), np.zeros(n, np.int64)
    ids, word = np.concatenate(done_ids), np.concatenate(done_word)
    order = np.argsort(word, kind="stable")
    return ids[order], np.bincount(word, minlength=n)
