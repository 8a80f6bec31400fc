"""Approximate nearest neighbours by NN-descent, searched greedily.

``build`` starts every vector with neighbours from random hyperplane cells, then joins: each
round the neighbours of a vector, forward and reverse, meet each other in the vector's
neighbourhood, and every one keeps the closest it meets. Only pairs of which one member is
new to the neighbourhood are compared, and neighbourhoods without new members don't travel.
Rounds end once hardly any list improves. ``search`` walks the graph for any queries: each
begins in its own hyperplane cells and looks, a few a round, at the neighbours of the
nearest nodes that it hasn't looked at yet, until its best are all looked at. ``nearest``, the
registered query, searches for the rows of a table that a condition picks.

Similarity is the cosine. Vectors travel as unit vectors of 32-bit floats, whose products
tell neighbours in tight clusters apart; the last step computes the similarities from the
vectors themselves.

Nothing is unbounded: a cell of more than ``CUT`` vectors is cut by hash into parts, whose
members meet in other trees and through the joins; of a vector's reverse neighbours each
round draws ``REVERSE`` by hash, others in another round, so a popular vector costs what any
other costs. These bounds are part of the index; every row is in it and can be found.

Edge cases: null vectors, empty ones, those with a null, NaN or infinite entry, those of
another dimension than most (of the least on a tie) and rows with a null id are left out.
Rows that repeat an id count once, by the vector that sorts first. A zero vector has
similarity 0 to all. Of nodes of equal similarity the lesser ids among those met come first;
which are met is as approximate as all else, but for tables of one cell. Equal vectors are
neighbours like others. Vectors of any length are compared whole. With fewer than k + 1
vectors lists are shorter; an empty table gives an empty result. Only the id and vector
columns are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vexel.llm.near_dedup import runs
from vexel.llm.tables import drop, kept

#: Neighbours of a node; random trees, vectors aimed at in a cell, and neighbours from each for the start; reverse neighbours of a round; closest that a neighbourhood hands on to each member; rounds at most; share of new entries that ends them.
K, TREES, CELL, START, REVERSE, OFFERS, ROUNDS, SETTLED = 32, 8, 512, 12, 32, 6, 6, 0.03
#: Vectors of one part of a cell, which are compared with each other at once.
CUT = 2048
#: For search: nodes that a query keeps; nearest that it looks at in a round; trees that it begins in; rounds at most.
WIDTH, BEAM, ENTRIES, STEPS = 160, 24, 2, 30
_ROW = "id bigint, code binary"


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)


def pack_codes(x: np.ndarray) -> pa.Array:
    """Unit vectors as the bytes of their float32 entries."""
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    raw = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0).astype("<f4")
    width = raw.shape[1] * 4
    return pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer((np.arange(len(raw) + 1) * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw))])


def unpack_codes(column: pa.Array) -> np.ndarray:
    n = len(column)
    where = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[where[0] : where[-1]].view("<f4").reshape(n, -1)


def clean(table: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(id, v) of the rows that count, one for each id, and their dimension."""
    v = F.col("v")
    rows = table.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & (F.size(v) > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    sizes = rows.groupBy(F.size(v).alias("n")).count().orderBy(F.desc("count"), "n").first()
    dim = sizes.n if sizes else 1
    return rows.where(F.size(v) == dim).groupBy("id").agg(F.min("v").alias("v")), dim


def vectors(table: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(id, code) of the rows that count, and their dimension."""
    one, dim = clean(table, id_col, vector_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pack_codes(_vectors(batch.column(1), dim))], ["id", "code"])

    return one.mapInArrow(run, _ROW), dim


def best(query: np.ndarray, node: np.ndarray, sim: np.ndarray, k: int) -> np.ndarray:
    """Positions of each query's k closest distinct nodes, by query, similarity and id."""
    order = np.lexsort((node, -sim, query))
    q, n = query[order], node[order]
    seen = np.lexsort((np.arange(len(order)), n, q))
    again = np.zeros(len(order), bool)
    again[seen[1:]] = (q[seen[1:]] == q[seen[:-1]]) & (n[seen[1:]] == n[seen[:-1]])
    order = order[~again]
    q = query[order]
    first = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1]))) if len(q) else np.zeros(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    return order[rank < k]


def _offers(query: np.ndarray, node: np.ndarray, sim: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(query), pa.array(node), pa.array(sim.astype(np.float32))], ["id", "node", "sim"])


def _cells(trees: int, depth: int, dim: int, mean: np.ndarray):
    planes = np.random.default_rng(7).normal(size=(dim, trees * depth)).astype(np.float32)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            side = ((unpack_codes(batch.column(1)) - mean) @ planes > 0).reshape(batch.num_rows, trees, depth)
            cell = side.astype(np.int64) @ (1 << np.arange(depth, dtype=np.int64)) + (np.arange(trees) << depth)
            for t in range(trees):
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(cell[:, t])), *batch.columns], ["cell", "id", "code"])

    return run


def _largest(sim: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Columns of each row's n largest; of equal ones those of the least ids."""
    if n >= sim.shape[1]:
        return np.broadcast_to(np.arange(sim.shape[1]), sim.shape)
    order = np.argsort(ids, kind="stable")
    ranked = sim[:, order]
    near = np.argpartition(-ranked, n - 1, axis=1)[:, :n]
    edge = np.take_along_axis(ranked, near, 1).min(axis=1, keepdims=True)
    for row in np.flatnonzero((ranked >= edge).sum(axis=1) > n):  # a tie at the edge
        above = np.flatnonzero(ranked[row] > edge[row])
        near[row] = np.append(above, np.flatnonzero(ranked[row] == edge[row])[: n - len(above)])
    return order[near]


def _compare(k: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches):
            cell, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            x = unpack_codes(batch.column(2))
            heads = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
            for a, b in zip(heads, np.append(heads[1:], len(cell))):
                sim = x[a:b] @ x[a:b].T
                np.fill_diagonal(sim, -2)
                n = min(k, b - a - 1)
                if n > 0:
                    near = _largest(sim, ids[a:b], n)
                    yield _offers(np.repeat(ids[a:b], n), ids[a:b][near.ravel()], np.take_along_axis(sim, near, 1).ravel())

    return run


def _parted(celled: DataFrame, name: str, codes: int) -> DataFrame:
    """Rows with their cell's part: cells of more than CUT are cut by hash of the id."""
    size = celled.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > codes)
    parts = F.coalesce(F.pmod(F.xxhash64("id", "cell"), F.ceil(F.col("n") / codes)), F.lit(0))
    return celled.join(size, "cell", "left").select(F.xxhash64("cell", parts).alias(name), "id", "code")


def _merge(k: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches):
            q, n, s = (batch.column(c).to_numpy() for c in range(3))
            keep = best(q, n, s, k)
            yield batch.take(pa.array(keep))

    return run


def _lists(offers: DataFrame, k: int) -> DataFrame:
    """id, node, sim and what else offers hold: the k closest of each id."""
    return offers.repartition("id").sortWithinPartitions("id").mapInArrow(_merge(k), offers.schema)


def _gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (hub, member, new) sorted by hub: each member once, of hubs that have a new one."""
    for batch in runs(batches):
        hub, member, new = (batch.column(k).to_numpy() for k in range(3))
        order = np.lexsort((-new, member, hub))
        hub, member, new = hub[order], member[order], new[order]
        once = np.concatenate(([True], (hub[1:] != hub[:-1]) | (member[1:] != member[:-1])))
        hub, member, new = hub[once], member[once], new[once]
        first = np.flatnonzero(np.concatenate(([True], hub[1:] != hub[:-1])))
        some = np.repeat(np.maximum.reduceat(new, first) > 0, np.diff(np.append(first, len(hub))))
        yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (hub, member, new)], ["hub", "member", "new"])


def _meet(k: int):
    """Rows (hub, member, new, code, floor) sorted by hub: members of a hub meet, and each is offered its k closest."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches):
            hub, member, new = (batch.column(c).to_numpy() for c in range(3))
            x, floor = unpack_codes(batch.column(3)), batch.column(4).to_numpy()
            heads = np.flatnonzero(np.concatenate(([True], hub[1:] != hub[:-1])))
            asked, met, close = [], [], []
            for a, b in zip(heads, np.append(heads[1:], len(hub))):
                fresh = np.flatnonzero(new[a:b]) + a
                old = np.flatnonzero(new[a:b] == 0) + a
                # New ones look at all, old ones at the new.
                for who, whom in ((fresh, np.arange(a, b)), (old, fresh)):
                    if not len(who) or not len(whom):
                        continue
                    sim = x[who] @ x[whom].T
                    sim[member[who][:, None] == member[whom][None, :]] = -2
                    n = min(k, len(whom))
                    near = np.argpartition(-sim, n - 1, axis=1)[:, :n]
                    value = np.take_along_axis(sim, near, 1)
                    row, col = np.nonzero(value > floor[who][:, None])
                    asked.append(member[who[row]])
                    met.append(member[whom[near[row, col]]])
                    close.append(value[row, col])
            if asked:
                q, n, s = map(np.concatenate, (asked, met, close))
                once = best(q, n, s, len(q))
                yield _offers(q[once], n[once], s[once])

    return run


@dataclass
class Index:
    """A graph over vectors: codes (id, code), edges (id, node, sim), and the trees whose cells searches begin in."""

    codes: DataFrame
    edges: DataFrame
    dim: int
    mean: np.ndarray
    depth: int

    def cells(self, table: DataFrame, trees: int) -> DataFrame:
        """table (id, code) with the cells of its rows in so many trees."""
        return table.mapInArrow(_cells(trees, self.depth, self.dim, self.mean), "cell bigint, id bigint, code binary")


def build(codes: DataFrame, dim: int, k: int = K) -> Index:
    """The index over codes, a kept table."""
    n = codes.count()
    spark = codes.sparkSession

    def total(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim)), pa.array(unpack_codes(batch.column(1)).sum(axis=0, dtype=np.float64))], ["d", "s"])

    mean = np.zeros(dim, np.float32)
    for r in codes.mapInArrow(total, "d bigint, s double").groupBy("d").agg(F.sum("s").alias("s")).collect():
        mean[r.d] = r.s / n
    depth = ceil(log2(max(n, 1) / CELL)) if n > CELL else 0
    index = Index(codes, codes, dim, mean, depth)
    cells = _parted(index.cells(codes, TREES if depth else 1), "cell", CUT)
    offers = cells.repartition("cell").sortWithinPartitions("cell", "id").mapInArrow(_compare(START if depth else k), "id bigint, node bigint, sim float")
    edges = kept(_lists(offers, k).withColumn("new", F.lit(1)), "graph")
    for turn in range(ROUNDS):
        floor = edges.groupBy("id").agg(F.when(F.count("*") >= k, F.min("sim")).otherwise(F.lit(-2.0).cast("float")).alias("floor"))
        nodes = codes.join(floor, "id", "left").select("id", "code", F.coalesce("floor", F.lit(-2.0).cast("float")).alias("floor"))
        # A popular node draws as many of its reverse neighbours as others have.
        popular = edges.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") > REVERSE)
        drawn = F.pmod(F.xxhash64("id", "node", F.lit(turn)), F.lit(1 << 32)) * F.col("n") < F.lit(REVERSE << 32)
        reverse = edges.join(popular, "node", "left").where(F.col("n").isNull() | drawn).select(F.col("node").alias("hub"), F.col("id").alias("member"), "new")
        pairs = edges.select(F.col("id").alias("hub"), F.col("node").alias("member"), "new").union(reverse)
        hoods = pairs.repartition("hub").sortWithinPartitions("hub").mapInArrow(_gather, "hub bigint, member bigint, new int")
        full = hoods.join(nodes.withColumnRenamed("id", "member"), "member").select("hub", "member", "new", "code", "floor")
        met = full.repartition("hub").sortWithinPartitions("hub").mapInArrow(_meet(OFFERS), "id bigint, node bigint, sim float")
        # Of a node held and met again the row that is held comes first.
        told = Observation()
        both = edges.withColumn("new", F.lit(0)).union(met.withColumn("new", F.lit(1)))
        last, edges = edges, kept(_lists(both, k).observe(told, F.sum("new").alias("new")), "graph")
        drop(last)
        spark.sparkContext._jvm.System.gc()  # lets go of the round's shuffle files
        if (told.get["new"] or 0) < SETTLED * n * k:
            break
    return replace(index, edges=edges.drop("new"))


def _score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Similarities of (id, code, node, other's code)."""
    for batch in batches:
        if batch.num_rows:
            sim = (unpack_codes(batch.column(1)) * unpack_codes(batch.column(3))).sum(axis=1)
            yield _offers(batch.column(0).to_numpy(), batch.column(2).to_numpy(), sim)


def search(queries: DataFrame, index: Index, k: int = 10, width: int = WIDTH, beam: int = BEAM, entries: int = ENTRIES, rounds: int = STEPS) -> DataFrame:
    """Greedy graph search: query (id, code) -> id, node, sim of k nodes.

    Every query keeps its `width` closest nodes met; each round it meets the neighbours of
    the `beam` closest whose neighbours it hasn't met yet, and it ends when there are none (or
    after `rounds`). It begins with the nodes of its cells in `entries` trees, a part of each
    where a cell is large; a node that is the query itself counts like any other.
    """
    asked = kept(queries.select("id", "code"), "queries")
    node = lambda table: table.select("cell", F.col("id").alias("node"), F.col("code").alias("other"))
    trees = entries if index.depth else 1
    homes = index.cells(index.codes, trees)
    size = homes.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > CUT)
    homes = homes.join(size, "cell", "left").where(F.col("n").isNull() | (F.pmod(F.xxhash64("id"), F.lit(1 << 32)) * F.col("n") < F.lit(CUT << 32)))
    begin = index.cells(asked, trees).join(node(homes), "cell").select("id", "code", "node", "other")
    score = lambda pairs: pairs.mapInArrow(_score, "id bigint, node bigint, sim float").withColumn("seen", F.lit(0))
    state = kept(_lists(score(begin), width), "search")
    graph = kept(index.edges.groupBy("id").agg(F.collect_list("node").alias("nodes")), "adjacency")
    for _ in range(rounds):
        rows = state.where("seen = 0").repartition("id").sortWithinPartitions("id").mapInArrow(_merge(beam), state.schema)
        front = kept(rows.select("id", "node"), "front")
        if not front.limit(1).count():
            break
        ahead = front.join(graph.withColumnRenamed("id", "node"), "node").select("id", F.explode("nodes").alias("node")).distinct()
        fresh = ahead.join(state.select("id", "node"), ["id", "node"], "left_anti")
        pairs = fresh.join(index.codes.select(F.col("id").alias("node"), F.col("code").alias("other")), "node").join(asked, "id").select("id", "code", "node", "other")
        marked = state.join(front.withColumn("now", F.lit(1)), ["id", "node"], "left").select("id", "node", "sim", F.coalesce("now", "seen").alias("seen"))
        last, state = state, kept(_lists(marked.union(score(pairs)), width), "search")
        drop(last, front)
    return _lists(state, k).select("id", "node", "sim")


def exact(pairs: DataFrame, queries: DataFrame, table: DataFrame, k: int) -> DataFrame:
    """id, rank, neighbour and cosine of each id's k best pairs (id, node); queries and table: (id, v)."""
    both = pairs.select("id", "node").join(queries.select("id", "v"), "id").join(table.select(F.col("id").alias("node"), F.col("v").alias("u")), "node")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n = batch.column(2).value_lengths()[0].as_py()
                a, b = _vectors(batch.column(2), n), _vectors(batch.column(3), n)
                scale = np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1)
                cosine = np.divide((a * b).sum(axis=1), scale, out=np.zeros(len(a)), where=scale > 0)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cosine)], ["id", "node", "sim"])

    scored = both.select("id", "node", "v", "u").mapInArrow(run, "id bigint, node bigint, sim double")
    top = _lists(scored, k)
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("sim"), "node"))
    return top.select("id", rank.alias("rank"), F.col("node").alias("neighbour"), F.col("sim").alias("cosine"))


def answer(queries: DataFrame, table: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", size: int = K, others: bool = False) -> DataFrame:
    """id (of the query), rank, neighbour and cosine: the k nearest vectors of table by greedy search; with others, none of the query's own id."""
    found, dim = vectors(table, id_col, vector_col)
    codes = kept(found, "vectors")
    asked, own = vectors(queries, id_col, vector_col)
    index = build(codes, dim, max(size, k + 6))
    if own != dim:
        asked = asked.limit(0)
    # A few more than k by packed similarity, so that exact ones decide.
    near = search(asked, index, k + 6, max(WIDTH, 4 * k))
    return exact(near.where("id <> node") if others else near, clean(queries, id_col, vector_col)[0], clean(table, id_col, vector_col)[0], k)


def nearest(table: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", which: Column | None = None) -> DataFrame:
    """id, rank, neighbour and cosine: the k nearest others, among all rows, of the rows that `which` picks (every row if None)."""
    return answer(table if which is None else table.where(which), table, k, id_col, vector_col, others=True)
