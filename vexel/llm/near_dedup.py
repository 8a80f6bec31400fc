"""Near duplicates by SuperMinHash signatures, banding, verification and union-find.

A document's elements are its runs of three lower-cased words (all its words where it has
fewer). Every element draws its own permutation of the signature's slots, one place at a
time: at level j it offers j plus a random fraction to the slot that comes j-th, and a
document stops as soon as each slot holds a value below the next level. Ranks of one
element are correlated across slots, which gives estimates of lower variance than
independent hashes; long documents need a level or two.

Documents with equal signatures are one class, named by its least id. Classes meet in
buckets of equal bands; within a bucket pairs are compared, apart from pairs that are
connected already, and joined where the share of agreeing slots reaches the threshold. A
bucket of more than ``PART`` classes is cut into parts, and every two parts meet in a task of
their own, so no task holds a bucket that grows with the corpus and no pair is passed over;
a bucket of n mutually unlike classes costs n squared comparisons, spread over those tasks.
With ``exact``, as in the query and the pipeline, signatures only choose candidates: pairs
whose agreeing slots reach the threshold less a slack, apart from those that pairs far
above it connect. They are joined if the Jaccard index of the elements themselves reaches
the threshold. Groups are the connected components of all joins; copies get their class's.

``group`` gives for each document that has near duplicates group_id (the least id of the
group), class_id, n_links (how many other classes its class was joined with; pairs that
others connect aren't searched for, so this is no degree) and keep, true for one of each
group.

Edge cases: null and empty texts, and those of white space only, have no elements and are
in no group, nor are rows with a null id. Rows that share an id are one document, and join
whatever their texts join. Group and keeper are the least id, so ties cannot arise; an empty
table gives no groups. Only id and text are read, so other columns cannot clash, and
``keep_one`` returns the caller's. A text of any length is read whole, a piece at a time.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vexel.llm.blocks import SPACE, Block, Words, blocks, mix, words
from vexel.llm.tables import components, drop, free_name, kept

SLOTS, BAND, SHINGLE, THRESHOLD = 128, 3, 3, 0.5
#: Slots, of 128, by which candidates may fall short of the threshold (3.5 standard errors at 0.5), and by which pairs exceed it that spare others.
SLACK, SURE = 20, 32
#: Elements of pairs that are compared at once; elements that draw at once; bytes of a text that are read at once; classes of a bucket in one part.
MOST, DRAWN, PIECE, PART = 1 << 21, 1 << 16, 1 << 21, 4096
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_LOW = np.uint64(0xFFFFFFFF)
_HALF = np.uint64(32)


def shingles(block: Block, n: int = SHINGLE, w: Words | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Element hashes and their rows; w: the block's words, if they are known."""
    w = w or words(block, lower=True)
    size = np.diff(w.first)
    index = w.index
    at = np.flatnonzero((index + n <= size[w.row]) | (index == 0))
    out = w.hash[at].copy()
    for k in range(1, n):
        inside = index[at] + k < size[w.row[at]]
        out = out * np.uint64(0x9FB21C651E98DF25) + np.where(inside, w.hash[np.minimum(at + k, len(w.hash) - 1)], np.uint64(0))
    return mix(out), w.row[at]


def signatures(element: np.ndarray, row: np.ndarray, rows: int, slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash values (level in the upper half, fraction in the lower) of each row; row ascends."""
    sig = np.full((rows, slots), _EMPTY, np.uint64)
    for a in range(0, len(element), DRAWN):
        _draw(sig, element[a : a + DRAWN], row[a : a + DRAWN])
    return sig


def _draw(sig: np.ndarray, element: np.ndarray, row: np.ndarray) -> None:
    """Let elements offer their values to the slots of their rows."""
    slots, flat = sig.shape[1], sig.reshape(-1)
    order = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16), (len(element), 1))
    low, high = int(row[0]), int(row[-1]) + 1
    for level in range(slots):
        over = sig[low:high].max(axis=1) < np.uint64(level << 32)
        stay = ~over[row - low]
        if stay.mean() < 0.7:
            element, row, order = element[stay], row[stay], order[stay]
        if not len(element):
            break
        x = mix(element + np.uint64((level + 1) * int(_GOLD) % (1 << 64)))
        pick = level + (((x >> _HALF) * np.uint64(slots - level)) >> _HALF).astype(np.int64)
        i = np.arange(len(element))
        slot = order[i, pick]
        order[i, pick] = order[:, level]
        np.minimum.at(flat, row * slots + slot, np.uint64(level << 32) | (x & _LOW))


def pieces(block: Block, n: int, size: int) -> Iterator[np.ndarray]:
    """The elements of a block of one row, a piece of its text at a time; pieces overlap by n - 1 words."""
    data, at = block.data, 0
    while True:
        end = at + size
        while end < len(data):  # on to the next white space
            ahead = np.flatnonzero(SPACE[data[end : end + size]])
            end += int(ahead[0]) if len(ahead) else size
            if len(ahead):
                break
        end = min(end, len(data))
        part = Block(0, 1, data[at:end], np.array([0, end - at]))
        w = words(part, lower=True)
        if end < len(data) and len(w.row) < n:  # too few words to overlap by
            size *= 2
            continue
        if len(w.row) >= n or not at:
            yield shingles(part, n, w)[0]
        if end == len(data):
            return
        at = at + int(w.starts[-(n - 1)]) if n > 1 else end


def _sign(text: str, id_: str, docs: DataFrame, slots: int, n: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1), 1 << 19):
                if block.rows == 1 and len(block.data) > PIECE:
                    sig = np.full((1, slots), _EMPTY, np.uint64)
                    for element in pieces(block, n, PIECE):
                        for a in range(0, len(element), DRAWN):
                            _draw(sig, element[a : a + DRAWN], np.zeros(len(element[a : a + DRAWN]), np.int64))
                    has = (sig != _EMPTY).any(axis=1)
                else:
                    element, row = shingles(block, n)
                    sig = signatures(element, row, block.rows, slots)
                    has = np.bincount(row, minlength=block.rows) > 0
                sig = sig[has]
                weight = mix(np.arange(1, slots + 1, dtype=np.uint64) * _GOLD) | np.uint64(1)
                k1 = mix((mix(sig) * weight).sum(axis=1, dtype=np.uint64))
                k2 = mix((mix(sig ^ _GOLD) * mix(weight)).sum(axis=1, dtype=np.uint64))
                short = mix(sig).astype(np.uint16)
                ids = batch.column(0).slice(block.first, block.rows).filter(pa.array(has))
                packed = pa.Array.from_buffers(pa.binary(slots * 2), len(short), [None, pa.py_buffer(np.ascontiguousarray(short))])
                yield pa.RecordBatch.from_arrays([ids, pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), packed.cast(pa.binary())], ["doc_id", "k1", "k2", "sig"])

    schema = "doc_id bigint, k1 bigint, k2 bigint, sig binary"
    return docs.where(F.col(id_).isNotNull()).select(F.col(id_).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    if not n:
        return np.zeros((0, 1), np.uint16)
    column = column.cast(pa.large_binary())
    where = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[where[0] : where[-1]].view(np.uint16).reshape(n, -1)


def _bands(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        sig = _matrix(batch.column(1)).astype(np.uint64)
        count = sig.shape[1] // BAND
        key = np.repeat(np.arange(count, dtype=np.uint64)[None, :], len(sig), axis=0)
        for k in range(BAND):
            key = (key << np.uint64(16)) ^ sig[:, k : count * BAND : BAND]
        yield pa.RecordBatch.from_arrays([pa.array(mix(key).ravel().view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), count))], ["key", "rep"])


def runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of rows sorted by their first column, cut so that equal keys come together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy()
        change = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        if held and held[-1].column(0)[-1].as_py() != keys[0]:
            change = np.append(0, change)
        if not len(change):
            held.append(batch)
            continue
        cut = int(change[-1])
        if held or cut:
            yield pa.concat_batches([*held, batch.slice(0, cut)])
        held = [batch.slice(cut)]
    if held:
        yield pa.concat_batches(held)


def _buckets(most: int):
    """Members of each bucket of two or more: key, part, hot, members. Rows come sorted by (key, rep).

    A bucket of more than `most` is hot and comes in parts; no more than a part is held.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, part = None, np.zeros(0, np.int64), 0  # the bucket that may go on, what of it isn't out yet, parts out
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, reps = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if key is not None:
                keys, reps = np.append(np.full(len(held), key), keys), np.append(held, reps)
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            size = np.diff(np.append(first, len(keys)))
            special = size > most
            special[-1] = True
            special[0] |= part > 0
            plain = ~special & (size > 1)
            if plain.any():
                yield _parts(keys[first[plain]], 0, False, size[plain], reps[np.repeat(plain, size)])
            number, part = part, 0
            for k in np.flatnonzero(special).tolist():
                a, b = int(first[k]), int(first[k] + size[k])
                while b - a > most:
                    yield _parts(keys[a : a + 1], number, True, [most], reps[a : a + most])
                    a, number = a + most, number + 1
                if k == len(first) - 1:
                    key, held, part = keys[a], reps[a:b], number
                elif number:
                    yield _parts(keys[a : a + 1], number, True, [b - a], reps[a:b])
                number = 0
        if key is not None and (part or len(held) > 1):
            yield _parts(np.array([key]), part, part > 0, [len(held)], held)

    return run


def _parts(keys: np.ndarray, part: int, hot: bool, size: Sequence[int], members: np.ndarray) -> pa.RecordBatch:
    n = len(keys)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32)), pa.array(members))
    return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, hot)), lists], ["key", "part", "hot", "members"])


def forest(sig: np.ndarray, need: int) -> list[tuple[int, int]]:
    """Pairs that agree in `need` slots, enough to connect what all such pairs connect; the first of a pair is connected before."""
    edges, rest = [], np.arange(len(sig))
    while len(rest) > 1:
        rest, ask = rest[1:], [rest[0]]
        while ask and len(rest):
            one = ask.pop()
            hit = (sig[rest] == sig[one]).sum(axis=1) >= need
            edges += [(one, x) for x in rest[hit]]
            ask += rest[hit].tolist()
            rest = rest[~hit]
    return edges


def candidates(sig: np.ndarray, low: int, high: int) -> list[tuple[int, int]]:
    """Pairs that agree in `low` slots; of those inside a component of pairs that agree in `high`, what connects it."""
    edges = forest(sig, high)
    if low >= high:
        return edges
    root = np.arange(len(sig))
    for a, b in edges:
        root[b] = root[a]
    for r in np.unique(root):
        rest = np.flatnonzero(root > r)
        for i in np.flatnonzero(root == r) if len(rest) else ():
            hit = (sig[rest] == sig[i]).sum(axis=1) >= low
            edges += [(i, x) for x in rest[hit]]
    return edges


def across(sig: np.ndarray, side: np.ndarray, low: int, high: int) -> list[tuple[int, int]]:
    """Of candidates among all rows, those between the sides; what each side connects by itself counts as connected."""
    label = np.arange(len(sig))
    for one in (0, 1):
        own = np.flatnonzero(side == one)
        for a, b in forest(sig[own], high):
            label[own[b]] = label[own[a]]
    met, edges = set(), []
    for a, b in candidates(sig, low, high):
        if side[a] == side[b]:  # found where the part meets itself
            continue
        if (sig[a] == sig[b]).sum() >= high:
            pair = (label[a], label[b]) if side[a] < side[b] else (label[b], label[a])
            if pair in met:
                continue
            met.add(pair)
        edges.append((a, b))
    return edges


def _choose(low: int, high: int):
    """Candidates of each bucket or, where side isn't null, of two parts of one. Rows come sorted by bucket."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches):
            keys, reps, sig = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2))
            side = batch.column(3).fill_null(-1).to_numpy()
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            size = np.diff(np.append(first, len(keys)))
            two = first[(size == 2) & (side[first] < 0)]
            two = two[(sig[two] == sig[two + 1]).sum(axis=1) >= low]
            a, b = [reps[two]], [reps[two + 1]]
            more = (size > 2) | (side[first] >= 0)
            for at, n in zip(first[more].tolist(), size[more].tolist()):
                own = sig[at : at + n]
                found = across(own, side[at : at + n], low, high) if side[at] >= 0 else candidates(own, low, high)
                if found:
                    x, y = np.array(found).T
                    a.append(reps[at + x])
                    b.append(reps[at + y])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return run


def _elements(n: int):
    """The distinct elements of each text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                element, row = shingles(block, n)
                order = np.lexsort((element, row))
                element, row = element[order], row[order]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (element[1:] != element[:-1])
                offsets = np.concatenate(([0], np.cumsum(np.bincount(row[new], minlength=block.rows)))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, block.rows), pa.ListArray.from_arrays(pa.array(offsets), pa.array(element[new].view(np.int64)))], ["doc_id", "elements"])

    return run


def _similar(threshold: float):
    """Pairs (a, b, elements of a, elements of b) whose Jaccard index reaches the threshold."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = [batch.column(k).value_lengths().to_numpy() for k in (2, 3)]
            part = np.cumsum(size[0] + size[1]) // MOST
            heads = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else []
            for first, last in zip(heads, np.append(heads[1:], len(part))):
                element = np.concatenate([batch.column(k).slice(first, last - first).flatten().to_numpy() for k in (2, 3)])
                row = np.concatenate([np.repeat(np.arange(last - first), s[first:last]) for s in size])
                order = np.lexsort((element, row))
                element, row = element[order], row[order]
                both = np.bincount(row[1:][(row[1:] == row[:-1]) & (element[1:] == element[:-1])], minlength=last - first)
                either = size[0][first:last] + size[1][first:last] - both
                yield batch.slice(first, last - first).select(["a", "b"]).filter(pa.array((either > 0) & (both >= threshold * either)))

    return run


def _met(reps: DataFrame) -> DataFrame:
    """bucket, rep, sig, side: who is compared with whom. Side tells two parts of a bucket apart and is null elsewhere."""
    banded = reps.select("rep", "sig").mapInArrow(_bands, "key bigint, rep bigint")
    buckets = kept(banded.repartition("key").sortWithinPartitions("key", "rep").mapInArrow(_buckets(PART), "key bigint, part int, hot boolean, members array<bigint>"), "buckets")
    cold = buckets.where("not hot").select("members").distinct()
    plain = cold.select(F.xxhash64("members").alias("bucket"), F.explode("members").alias("rep"), F.lit(None).cast("int").alias("side"))
    # Bands of one hot bucket often hold the same members; one of them is enough.
    hot = buckets.where("hot")
    name = F.xxhash64("part", "members")
    keys = hot.groupBy("key").agg(F.count("*").cast("int").alias("parts"), F.bit_xor(name).alias("x"), F.sum(name.cast("decimal(38,0)")).alias("s"))
    keys = keys.groupBy("parts", "x", "s").agg(F.min("key").alias("key")).select("key", "parts")
    tiles = hot.join(keys, "key").select("key", "part", "members", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    side = F.when(F.col("part") != F.col("other"), (F.col("part") > F.col("other")).cast("int"))
    split = tiles.select(F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")).alias("bucket"), F.explode("members").alias("rep"), side.alias("side"))
    return plain.union(split).join(reps.select("rep", "sig"), "rep").select("bucket", "rep", "sig", "side")


def joins(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, slots: int = SLOTS, shingle: int = SHINGLE, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """(doc_id, rep, copied): each document's class and whether others are of it; (a, b): pairs that suffice to connect all classes that the threshold connects."""
    signed = kept(_sign(text_col, id_col, docs, slots, shingle), "signatures")
    reps = kept(signed.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), (F.max("doc_id") > F.min("doc_id")).alias("copied"), F.any_value("sig").alias("sig")), "distinct")
    members = kept(signed.select("doc_id", "k1", "k2").join(reps.select("k1", "k2", "rep", "copied"), ["k1", "k2"]).select("doc_id", "rep", "copied"), "members")
    need = threshold * slots
    low, high = (int(np.ceil(need + x * slots / SLOTS * exact)) for x in (-SLACK, SURE))
    chosen = _met(reps).repartition("bucket").sortWithinPartitions("bucket", "rep").mapInArrow(_choose(max(low, 1), high), "a bigint, b bigint").where("a <> b")
    pairs = kept(chosen.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "candidates")
    drop(signed, reps)
    if not exact:
        return members, pairs
    asked = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    # Candidates grow with the corpus, so they are merged and not broadcast, whatever its size.
    sets = kept(texts.join(asked.hint("merge"), "doc_id").select("doc_id", "text").mapInArrow(_elements(shingle), "doc_id bigint, elements array<bigint>"), "elements").hint("merge")
    both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("elements").alias("x")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("elements").alias("y")), "b")
    close = kept(both.select("a", "b", "x", "y").mapInArrow(_similar(threshold), "a bigint, b bigint").distinct(), "links")
    drop(pairs, sets)
    return members, close


def group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, exact: bool = False) -> DataFrame:
    """doc_id, group_id, class_id, n_links and keep for each document that has near duplicates."""
    members, links = joins(docs, id_col, text_col, threshold, exact=exact)
    twice = members.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b").drop("b")
    same = members.join(twice, "doc_id").select("a", F.col("rep").alias("b")).where("a < b")
    roots = components(links.union(same)).withColumnRenamed("node", "rep")
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n"))
    found = members.join(roots, "rep", "left").join(degree, "rep", "left").where("copied or root is not null")
    out = found.groupBy("doc_id").agg(F.min(F.coalesce("root", "rep")).alias("group_id"), F.min("rep").alias("class_id"), F.sum(F.coalesce("n", F.lit(0))).alias("n_links"))
    return out.select("doc_id", "group_id", "class_id", "n_links", (F.col("doc_id") == F.col("group_id")).alias("keep"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, exact: bool = False) -> DataFrame:
    """The rows of docs without the documents whose group keeps another one."""
    gone = free_name(docs.columns, "gone")
    lost = group(docs, id_col, text_col, threshold, exact).where("not keep").select(F.col("doc_id").alias(gone))
    return docs.join(lost, docs[id_col].cast("bigint") == lost[gone], "left_anti")
