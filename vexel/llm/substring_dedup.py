"""Repeated passages found by recompression.

A text is a sequence of words. Recompression rewrites it in rounds: a run of one symbol
becomes one symbol named after the symbol and the run's length, then the symbols of the
round's left half of the alphabet pair with followers of its right half, and a pair becomes
one symbol named after both. Names are 64-bit mixes of what they stand for and halves are
drawn from the names, so all workers give the same name and the same cuts to equal
content: equal passages receive equal symbols except for a few at their borders. Symbols
that span ``GRAIN`` words or more are complete.

Spark then groups all complete symbols of the corpus by name. Those met at one place only
are done with. Where symbols are shared, the next round names every window of ``LENGTH``
words that holds one (two independent 64-bit names), groups these, and so verifies the
repeats to the word: a window is a repeat if an equal one stands at a lesser (doc_id,
word). Documents that are word for word the same have one name at the top and are settled
by it, without their windows.

``spans`` gives maximal stretches of repeated words: doc_id, start and end (word numbers,
end excluded), in first_doc_id, first_start where the first window of the stretch stands for
the first time, and in text_key some bits of the name of the row's whole text. ``remove``
cuts the stretches out.

Edge cases: null, empty and short texts (fewer than LENGTH words) have no windows, hence no
repeats; rows with a null id are never repeats and keep their text. Rows that share an id
and a text are one document; those that share an id only are different documents in the
order of text_key, and lose their own repeats only (two such texts in 32,768 have one key and
lose the words found in either). Overlapping repeats in one text count from their second
window. An empty table gives no spans. Any length of text is processed whole. ``spans``
reads id and text only; ``remove`` returns the caller's columns in place, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vexel.llm.blocks import Block, Words, blocks, mix, row_names, spread, words
from vexel.llm.tables import free_name

LENGTH, GRAIN = 50, 6
_G1, _G2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)
_TOP = np.uint64(63)
#: Places are numbers of the text's key (15 bits) and the word in it.
_WORD, _KEY = 40, np.uint64(49)


def text_keys(names: np.ndarray) -> np.ndarray:
    """15 bits of each row's name."""
    return (names[:, 0] >> _KEY).astype(np.int64)


def symbols(token: np.ndarray, row: np.ndarray, grain: int = GRAIN) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Names, first words, lengths and rows of the symbols once no live pair is left."""
    name, start, size = mix(token), np.arange(len(token)), np.ones(len(token), np.int64)
    level = 0
    while len(name) > 1:
        live = size < grain
        same = live[1:] & (name[1:] == name[:-1]) & (row[1:] == row[:-1])
        if same.any():  # a run becomes blocks that reach the grain, and what is left over
            first = np.flatnonzero(np.concatenate(([True], ~same)))
            place = np.arange(len(name)) - np.repeat(first, np.diff(np.append(first, len(name))))
            head = np.flatnonzero(~live | (place % -(-grain // size) == 0))
            count = np.diff(np.append(head, len(name)))
            name, start, size, row = name[head], start[head], size[head] * count, row[head]
            name = np.where(count > 1, mix(name * _G1 + count.astype(np.uint64)), name)
            live = size < grain
        able = live[:-1] & live[1:] & (row[1:] == row[:-1])
        if not able.any():
            break
        right = (mix(name + np.uint64(level * int(_G2) % (1 << 64))) >> _TOP).astype(bool)
        level += 1
        at = np.flatnonzero(able & ~right[:-1] & right[1:])
        name[at] = mix(mix(name[at] ^ _G2) * _G1 + name[at + 1])
        size[at] += size[at + 1]
        keep = np.ones(len(name), bool)
        keep[at + 1] = False
        name, start, size, row = name[keep], start[keep], size[keep], row[keep]
    return name, start, size, row


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """base**i modulo 2**64 for i in 0..n."""
    power = np.full(n + 1, base, np.uint64)
    power[0] = 1
    return np.cumprod(power, dtype=np.uint64)


def _names(w: Words, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Two independent names of stretches of words: equal for equal words, in whatever block they stand."""
    out, n = [], len(w.hash)
    for base, seed in ((_G1, _G2), (_G2, _G1)):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(w.hash ^ seed) * _powers(base, n)[:-1], out=sums[1:])
        down = _powers(np.uint64(pow(int(base), -1, 1 << 64)), n)
        out.append(mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)))
    return out


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))


def _wholes(length: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                w = words(block)
                long = np.flatnonzero(np.diff(w.first) >= length)
                k1, k2 = row_names(w)[long].T.copy()
                ids = batch.column(0).slice(block.first, block.rows).take(pa.array(long))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(k.view(np.int64)) for k in (k1, k2)), pa.array(np.diff(w.first)[long])], ["doc_id", "k1", "k2", "n"])

    return run


def _symbols(length: int, grain: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for block in blocks(batch.column(1)):
                w = words(block)
                count = np.diff(w.first)
                names = row_names(w)
                key, part = np.ascontiguousarray(names[:, 0]).view(np.int64), text_keys(names) << (_WORD + 8)
                use = count[w.row] >= length
                origin = np.flatnonzero(use)
                name, start, size, row = symbols(w.hash[use], w.row[use], grain)
                whole = size >= grain
                name, start, size, row = name[whole], origin[start[whole]], size[whole], row[whole]
                spot = part[row] | (start - w.first[row]) << 8 | np.minimum(size, 255)
                yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(key[row]), pa.array(spot), pa.array(ids[block.first + row])], ["name", "k1", "spot", "doc_id"])

    return run


def _shared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of symbols sorted by (name, k1, spot, doc_id): each place once, of names met at two places or more."""
    last, told = None, False
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        name, key, spot, doc = (batch.column(k).to_numpy() for k in range(4))
        if last is not None:
            name, key, spot, doc = (np.append(x, y) for x, y in zip(last, (name, key, spot, doc)))
        same = name[1:] == name[:-1]
        again = same & (key[1:] == key[:-1]) & (spot[1:] == spot[:-1])
        fresh = np.concatenate(([True], ~again))
        group = np.cumsum(np.concatenate(([True], ~same))) - 1
        shared = (np.bincount(group[fresh]) > 1)[group]
        if last is not None and told:
            shared[group == 0] = True
        out = fresh & shared
        # The last place stays for the next batch, which may hold its equals.
        at = int(np.flatnonzero(fresh)[-1])
        if last is not None and told:
            out[0] = False
        told = bool(shared[at])
        yield pa.RecordBatch.from_arrays([pa.array(doc[out]), pa.array(spot[out])], ["doc_id", "spot"])
        last = (name[at : at + 1], key[at : at + 1], spot[at : at + 1], doc[at : at + 1])


def _windows(length: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            spots = batch.column(2)
            for block in blocks(batch.column(1)):
                w = words(block)
                mine = spots.slice(block.first, block.rows)
                count = np.diff(np.concatenate(([0], np.cumsum(mine.value_lengths().to_numpy()))))
                spot, row = mine.flatten().to_numpy(), np.repeat(np.arange(block.rows), count)
                part = text_keys(row_names(w))
                start, size, n = spot >> 8 & (1 << _WORD) - 1, spot & 255, np.diff(w.first)[row]
                low, high = np.maximum(start + size - length, 0), np.minimum(start, n - length)
                ok = (high >= low) & (size <= length) & (spot >> _WORD + 8 == part[row])
                edge = np.zeros(len(w.row) + 1, np.int64)
                np.add.at(edge, w.first[row[ok]] + low[ok], 1)
                np.add.at(edge, w.first[row[ok]] + high[ok] + 1, -1)
                at = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
                h1, h2 = _names(w, at, at + length)
                yield pa.RecordBatch.from_arrays([*(pa.array(h.view(np.int64)) for h in (h1, h2)), pa.array(ids[block.first + w.row[at]]), pa.array(part[w.row[at]] << _WORD | at - w.first[w.row[at]])], ["h1", "h2", "doc_id", "at"])

    return run


def _later(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of windows sorted by (h1, h2, doc_id, at): all but the first of each name, with that first."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy() for k in range(4)]
        if last is not None:
            cols = [np.append(x, y) for x, y in zip(last, cols)]
        h1, h2, doc, at = cols
        head = np.concatenate(([True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])))
        first = np.flatnonzero(head)[np.cumsum(head) - 1]
        out = ~head & ((doc != doc[first]) | (at != at[first]))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (doc[out], at[out], doc[first][out], at[first][out])], ["doc_id", "at", "first_doc_id", "first_start"])
        last = tuple(x[first[-1] : first[-1] + 1] for x in cols)


def _stretches(length: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of repeated windows sorted by (doc_id, at): maximal stretches. An open one is carried on."""
        held: tuple | None = None

        def out(doc: np.ndarray, start: np.ndarray, end: np.ndarray, of: np.ndarray, its: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (doc, start, end, of, its)], ["doc_id", "start", "end", "first_doc_id", "first_start"])

        for batch in batches:
            if not batch.num_rows:
                continue
            doc, at, of, its = (batch.column(k).to_numpy() for k in range(4))
            end = at + length
            if held is not None:
                doc, at, end, of, its = (np.append(x, y) for x, y in zip(held, (doc, at, end, of, its)))
            head = np.concatenate(([True], (doc[1:] != doc[:-1]) | (at[1:] > end[:-1])))
            first = np.flatnonzero(head)
            stop = np.append(first[1:], len(doc)) - 1
            cols = (doc[first], at[first], end[stop], of[first], its[first])
            yield out(*(c[:-1] for c in cols))
            held = tuple(c[-1:] for c in cols)
        if held is not None:
            yield out(*held)

    return run


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, grain: int = GRAIN) -> DataFrame:
    """doc_id, text_key, start, end, first_doc_id, first_start of every repeated stretch of words."""
    texts = _texts(docs, id_col, text_col)
    wholes = texts.mapInArrow(_wholes(length), "doc_id bigint, k1 bigint, k2 bigint, n bigint")
    least = wholes.groupBy("k1", "k2").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    key = F.shiftrightunsigned("k1", int(_KEY)).cast("int").alias("text_key")
    none = F.lit(0).cast("bigint")
    copies = wholes.join(least, ["k1", "k2"]).where("doc_id <> first").select("doc_id", key, none.alias("start"), F.col("n").alias("end"), F.col("first").alias("first_doc_id"), none.alias("first_start")).distinct()

    named = texts.mapInArrow(_symbols(length, grain), "name bigint, k1 bigint, spot bigint, doc_id bigint")
    shared = named.repartition("name").sortWithinPartitions("name", "k1", "spot", "doc_id").mapInArrow(_shared, "doc_id bigint, spot bigint")
    where = shared.groupBy("doc_id").agg(F.array_sort(F.collect_set("spot")).alias("spots"))
    windows = texts.join(where, "doc_id").select("doc_id", "text", "spots").mapInArrow(_windows(length), "h1 bigint, h2 bigint, doc_id bigint, at bigint")
    later = windows.repartition("h1", "h2").sortWithinPartitions("h1", "h2", "doc_id", "at").mapInArrow(_later, "doc_id bigint, at bigint, first_doc_id bigint, first_start bigint")
    found = later.repartition("doc_id").sortWithinPartitions("doc_id", "at", "first_doc_id", "first_start").mapInArrow(_stretches(length), "doc_id bigint, start bigint, end bigint, first_doc_id bigint, first_start bigint")
    word = lambda c: F.col(c).bitwiseAND(F.lit((1 << _WORD) - 1)).alias(c)
    return copies.union(found.select("doc_id", F.shiftright("start", _WORD).cast("int").alias("text_key"), word("start"), word("end"), "first_doc_id", word("first_start")))


def cut(block: Block, row: np.ndarray, start: np.ndarray, end: np.ndarray, key: np.ndarray | None = None) -> list[bytes]:
    """Texts of the block's rows without the given words (of rows that have the key given); each goes with the white space after it."""
    w = words(block)
    if key is not None:
        mine = text_keys(row_names(w))[row] == key
        row, start, end = row[mine], start[mine], end[mine]
    edge = np.zeros(len(w.row) + 1, np.int64)
    stop = np.minimum(end, np.diff(w.first)[row])
    start = np.minimum(start, stop)
    np.add.at(edge, w.first[row] + start, 1)
    np.add.at(edge, w.first[row] + stop, -1)
    gone = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
    after = np.append(w.starts[1:], len(block.data))
    after[w.first[1:][w.first[1:] > 0] - 1] = block.offsets[1:][w.first[1:] > 0]
    size = after[gone] - w.starts[gone]
    keep = np.ones(len(block.data), bool)
    keep[np.repeat(w.starts[gone], size) + spread(size)] = False
    return [block.data[a:b][keep[a:b]].tobytes() for a, b in zip(block.offsets[:-1], block.offsets[1:])]


def remove(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the words in found (as from spans); a document left without words goes, if it had any."""
    columns, schema = docs.columns, docs.schema
    of, inside = free_name(columns, "of"), free_name(columns, "spans")
    lists = found.groupBy(F.col("doc_id").alias(of)).agg(F.collect_list(F.struct("start", "end", "text_key")).alias(inside))
    at = columns.index(text_col)
    joined = docs.join(lists, docs[id_col].cast("bigint") == lists[of], "left").drop(of)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(columns))
            out = pa.RecordBatch.from_arrays(batch.columns[:-1], schema=pa.schema([batch.schema.field(k) for k in range(len(columns))]))
            hit = lists.is_valid().to_numpy(zero_copy_only=False)
            if hit.any():
                texts, keep = batch.column(at).to_pylist(), np.ones(batch.num_rows, bool)
                rows = np.flatnonzero(hit)
                part = batch.column(at).take(pa.array(rows))
                inside = lists.take(pa.array(rows))
                count = inside.value_lengths().to_numpy()
                pairs = inside.flatten()
                start, end, key = (pairs.field(k).to_numpy() for k in range(3))
                owner = np.repeat(np.arange(len(rows)), count)
                for block in blocks(part):
                    a, b = np.searchsorted(owner, (block.first, block.last))
                    for k, text in enumerate(cut(block, owner[a:b] - block.first, start[a:b], end[a:b], key[a:b])):
                        row = rows[block.first + k]
                        keep[row] = bool(text.strip())
                        texts[row] = text.decode("utf-8")
                out = out.set_column(at, out.schema.field(at), pa.array(texts, out.schema.field(at).type)).filter(pa.array(keep))
            yield out

    return joined.mapInArrow(run, schema)
