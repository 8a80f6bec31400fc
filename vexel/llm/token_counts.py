"""Token counts by heap-and-linked-list byte-pair merging, without emitting identifiers.

The symbols of many words stand in one doubly linked list, closed off between words. A
heap holds the ranks at which adjacent pairs can merge, each with the places waiting there;
the lowest is popped, its places that still hold are merged and the pairs this makes are
pushed. Words don't touch each other, so every word sees its own pairs in ascending order,
leftmost first, as if it had a heap to itself. A word's count is its bytes less its merges.

Words recur, so a worker counts each new word once and remembers its bytes and count.

Edge cases: a null or empty text counts 0. Each row is counted by itself: repeated rows get
equal counts, an empty table gives an empty result, and a text or word of any length is
counted whole. Only the id and text columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vexel.llm.blocks import blocks, distinct, equal_spans, spread
from vexel.llm.bpe import DEFAULT_VOCABULARY, NONE, Vocabulary, alternate, pretokens, vocabulary

#: Words a worker remembers; beyond it starts anew, which costs time and changes nothing.
REMEMBERED = 1 << 21


def count_merges(v: Vocabulary, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Tokens of each byte span: initial symbols less merges."""
    count = lengths.astype(np.int64)
    total = int(count.sum())
    ids = v.byte[data[np.repeat(starts, lengths) + spread(lengths)]]
    word = np.repeat(np.arange(len(starts)), lengths)
    after = np.arange(1, total + 1)
    before = np.arange(-1, total - 1)
    if total:
        ends = np.flatnonzero(np.concatenate((word[1:] != word[:-1], [True])))
        after[ends] = -1
        before[np.append(0, ends[:-1] + 1)] = -1
    waits = np.full(total, NONE)  # the rank at which a place and its successor merge
    heap: list[int] = []
    places: dict[int, list[np.ndarray]] = {}

    def push(at: np.ndarray) -> None:
        at = at[at >= 0]
        waits[at] = NONE
        at = at[after[at] >= 0]
        rank = v.pair(ids[at], ids[after[at]])
        waits[at] = rank
        at, rank = at[rank < NONE], rank[rank < NONE]
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        first = np.flatnonzero(np.concatenate(([True], rank[1:] != rank[:-1]))) if len(rank) else []
        for r, part in zip(rank[first].tolist() if len(rank) else [], np.split(at, first[1:]) if len(rank) else []):
            if r in places:
                places[r].append(part)
            else:
                places[r] = [part]
                heapq.heappush(heap, r)

    push(np.arange(total))
    while heap:
        r = heapq.heappop(heap)
        at = np.concatenate(places.pop(r))
        at = np.unique(at[waits[at] == r])
        if not len(at):
            continue
        if not v.rising[r]:  # something lower may come up in between: one merge of each word at a time
            leftmost = np.ones(len(at), bool)
            leftmost[1:] = word[at[1:]] != word[at[:-1]]
            if not leftmost.all():
                places[r] = [at[~leftmost]]
                heapq.heappush(heap, r)
                at = at[leftmost]
        elif len(at) > 1:
            near = np.flatnonzero(after[at[:-1]] == at[1:])
            if len(near):  # overlapping pairs: every second of a chain, from its left end
                chained = np.zeros(len(at) * 2, bool)
                link = np.ones(len(at), np.int64) * 2
                link[near + 1] = 1
                spot = np.cumsum(link) - 1
                chained = np.zeros(spot[-1] + 1, bool)
                chained[spot] = True
                at = at[alternate(chained)[spot]]
        gone = after[at]
        ids[at] = r
        follow = after[gone]
        after[at] = follow
        before[follow[follow >= 0]] = at[follow >= 0]
        waits[gone] = NONE
        after[gone] = -2
        count -= np.bincount(word[at], minlength=len(count)) if len(at) > len(count) // 8 else 0
        if len(at) <= len(count) // 8:
            np.subtract.at(count, word[at], 1)
        push(np.unique(np.concatenate((at, before[at]))))
    return count


class Counter:
    """A worker's memory of words that it has counted, by hash and bytes."""

    def __init__(self, v: Vocabulary) -> None:
        self.v = v
        self._forget()

    def _forget(self) -> None:
        self.keys, self.pool = np.zeros(0, np.uint64), np.zeros(0, np.uint8)
        self.starts, self.size, self.counts = (np.zeros(0, np.int64) for _ in range(3))

    def _find(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Each word's place in the memory, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        known = np.flatnonzero(self.keys[at] == keys)
        same = equal_spans(data, starts[known], size[known], self.pool, self.starts[at[known]], self.size[at[known]])
        out = np.full(len(keys), -1)
        out[known[same]] = at[known[same]]
        return out

    def _keep(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, size: np.ndarray, counts: np.ndarray) -> None:
        """Of words with one hash the first is kept; the others are counted whenever they come."""
        keys, first = np.unique(np.concatenate((self.keys, keys)), return_index=True)
        if len(keys) > REMEMBERED:
            return self._forget()
        self.starts = np.concatenate((self.starts, starts + len(self.pool)))[first]
        self.pool = np.concatenate((self.pool, data))
        self.keys, self.size, self.counts = keys, np.concatenate((self.size, size))[first], np.concatenate((self.counts, counts))[first]

    def __call__(self, column: pa.Array) -> np.ndarray:
        """Tokens of each text."""
        met, fresh = [], []
        for block in blocks(column):
            w = pretokens(block)
            spot, which = distinct(block.data, w.starts, w.ends - w.starts, w.hash)
            keys, starts, size = w.hash[spot], w.starts[spot], w.ends[spot] - w.starts[spot]
            number = self._find(keys, block.data, starts, size)
            new = np.flatnonzero(number < 0)
            fresh.append((keys[new], size[new], block.data[np.repeat(starts[new], size[new]) + spread(size[new])]))
            met.append((number, new, which.astype(np.int32), w.first))
        if not met:
            return np.zeros(0, np.int64)
        keys, size, data = (np.concatenate(x) for x in zip(*fresh))
        starts = np.cumsum(size) - size
        spot, which = distinct(data, starts, size, keys)
        counts = count_merges(self.v, data, starts[spot], size[spot])
        each_new, out, at = counts[which], [], 0
        for number, new, which, first in met:
            each = np.zeros(len(number), np.int64)
            each[number >= 0] = self.counts[number[number >= 0]]
            each[new] = each_new[at : at + len(new)]
            at += len(new)
            upto = np.concatenate(([0], np.cumsum(each[which])))
            out.append(upto[first[1:]] - upto[first[:-1]])
        self._keep(keys[spot], data, starts[spot], size[spot], counts)
        return np.concatenate(out)


def count(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary_path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """doc_id and n_tokens for each row of docs; no shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary(vocabulary_path))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counter(batch.column(1)), pa.int64())], ["doc_id", "n_tokens"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id bigint, n_tokens bigint")
