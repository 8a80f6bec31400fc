"""Vectorised reading of text columns inside Arrow workers.

Everything here works on *blocks*: a few rows of an Arrow string column seen as one byte
array with row offsets. Blocks bound a worker's memory by bytes of text, not by rows; a
single document longer than a block forms a block of its own.

Words are maximal runs of bytes other than the six ASCII white-space characters. A null
text counts as empty everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

BLOCK_BYTES = 1 << 21
SPACE = np.zeros(256, dtype=bool)
SPACE[list(b" \t\n\r\x0b\x0c")] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes up to which spans are hashed eight at a time, all spans together; longer ones are hashed one by one.
SHORT = 256
_SIZE, _NEXT = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15)
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser; equal inputs keep equal outputs."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Block:
    """Rows [first, last) of a batch: their bytes and where each row begins and ends."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return self.last - self.first


def blocks(column: pa.Array, max_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """The column in blocks of at most max_bytes of text, or of one row if that is longer."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    bytes_ = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + max_bytes, "right")) - 1)
        last = min(last, len(column))
        yield Block(first, last, bytes_[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; zeros follow the end."""
    longer = np.zeros(len(data) + 8, np.uint8)
    longer[: len(data)] = data
    return np.ndarray(len(data) + 1, "<u8", longer, strides=(1,))


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans: equal for equal bytes, wherever they stand.

    Spans of one length up to eight bytes have different hashes if they differ. Beyond that a
    hash alone is no proof; ``equal_spans`` compares bytes.
    """
    eight, size = eights(data), ends - starts
    out = mix((eight[starts] & _MASK[np.minimum(size, 8)]) + size.astype(np.uint64) * _SIZE)
    at, step = np.flatnonzero((size > 8) & (size <= SHORT)), 8
    while len(at):
        x = eight[starts[at] + step] & _MASK[np.minimum(size[at] - step, 8)]
        out[at] = mix((out[at] ^ x) * _NEXT + x)
        step += 8
        at = at[size[at] > step]
    for k in np.flatnonzero(size > SHORT).tolist():
        out[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]])
    return out


def equal_spans(data: np.ndarray, starts: np.ndarray, size: np.ndarray, others: np.ndarray, other_starts: np.ndarray, other_size: np.ndarray) -> np.ndarray:
    """Whether each span of data has the bytes of its fellow in others."""
    out = size == other_size
    a, b = eights(data), eights(others) if others is not data else None
    b = a if b is None else b
    at, step = np.flatnonzero(out & (size <= SHORT)), 0
    while len(at):
        mask = _MASK[np.minimum(size[at] - step, 8)]
        out[at] = same = (a[starts[at] + step] & mask) == (b[other_starts[at] + step] & mask)
        step += 8
        at = at[same & (size[at] > step)]
    for k in np.flatnonzero(out & (size > SHORT)).tolist():
        n = size[k]
        out[k] = np.array_equal(data[starts[k] : starts[k] + n], others[other_starts[k] : other_starts[k] + n])
    return out


def distinct(data: np.ndarray, starts: np.ndarray, size: np.ndarray, hash_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One span of each content, and for every span which of those has its content. Bytes decide, hashes only help."""
    _, spot, which = np.unique(hash_, return_index=True, return_inverse=True)
    rep = spot[which]
    odd = size != size[rep]
    long = np.flatnonzero((size > 8) & ~odd & (rep != np.arange(len(rep))))
    odd[long] = ~equal_spans(data, starts[long], size[long], data, starts[rep[long]], size[rep[long]])
    if odd.any():  # words that share a hash with another word
        own: dict[bytes, int] = {}
        more = []
        for k in np.flatnonzero(odd).tolist():
            word = data[starts[k] : starts[k] + size[k]].tobytes()
            if word not in own:
                own[word] = len(spot) + len(more)
                more.append(k)
            which[k] = own[word]
        spot = np.append(spot, more)
    return spot, which


@dataclass
class Words:
    """Words of a block in order: byte spans, row numbers (in the block) and hashes."""

    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # first word of each row, with the total at the end

    @property
    def index(self) -> np.ndarray:
        """Each word's place in its own row."""
        return np.arange(len(self.row)) - self.first[self.row]


def words(block: Block, lower: bool = False) -> Words:
    data = LOWER[block.data] if lower else block.data
    inside = ~SPACE[data]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    cut = block.offsets[1:-1]
    cut = cut[cut < len(data)]
    before[cut] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    after[cut[cut > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    first = np.searchsorted(starts, block.offsets)
    row = np.repeat(np.arange(block.rows), np.diff(first))
    return Words(starts, ends, row, span_hash(data, starts, ends), first)


def row_names(w: Words) -> np.ndarray:
    """Two 64-bit names of each row's words: a column each."""
    raw = b"".join(xxhash.xxh3_128_digest(w.hash[a:b]) for a, b in zip(w.first[:-1], w.first[1:]))
    return np.frombuffer(raw, "<u8").reshape(-1, 2)


def chars_before(data: np.ndarray) -> np.ndarray:
    """Number of characters (not UTF-8 bytes) before each byte."""
    sums = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=sums[1:])
    return sums


def groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that sorts keys, and where each run of equal keys begins in that order (total at the end)."""
    order = np.argsort(keys, kind="stable")
    if not len(keys):
        return order, np.zeros(1, np.int64)
    ranked = keys[order]
    new = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
    return order, np.append(new, len(keys))


def spread(lengths: np.ndarray) -> np.ndarray:
    """0..l-1 for each l of lengths, one after another."""
    total = int(lengths.sum())
    return np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)
