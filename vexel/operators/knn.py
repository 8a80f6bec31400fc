"""Exact nearest neighbours: one query by top-k, many by blocks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vexel.functions.metric import Metric

#: Vectors of the store that are compared at once, and how far (relative) a rough score in doubles may be off.
BLOCK, ROUGH = 2048, 1e-6
#: Answers that a task holds before it hands them on; queries that a task takes at most, and from which on there is one task more.
HELD, MOST, SHARE = 1 << 22, 1 << 16, 1 << 12
#: Elements of pairs that are scored exactly at once.
CELLS = 1 << 20
#: Steps along a dimension in the Manhattan distance's rough form (four gaps fit a byte), and the dimensions whose sum fits 15 bits.
STEPS, NARROW = 63, 512


def literal(vector: Sequence[float]) -> Column:
    return F.lit([float(x) for x in vector]) if len(vector) else F.array().cast("array<double>")


def search(store: DataFrame, query: Sequence[float], k: int, metric: Metric, seq: str = "seq", vector: str = "vector") -> DataFrame:
    """The store's rows with rank and distance of the k best for one query; ties by seq.

    The query is a constant of the plan and Spark keeps k rows of each partition: no join, no full sort.
    """
    scored = store.withColumn("distance", metric.score(F.col(vector), literal(query)))
    top = scored.orderBy(*metric.order(), seq).limit(max(k, 0))
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*metric.order(), seq)))


def search_each_plain(queries: DataFrame, store: DataFrame, k: int, metric: Metric, query_id: str = "query_id", query: str = "query", seq: str = "seq", vector: str = "vector") -> DataFrame:
    """query_id, rank, seq and distance by a cross join and a ranking window; the definition that search_each keeps to."""
    pairs = queries.select(F.col(query_id).alias("query_id"), F.col(query).alias("__q")).crossJoin(store.select(F.col(seq).alias("seq"), F.col(vector).alias("__v")))
    scored = pairs.select("query_id", "seq", metric.score("__v", "__q").alias("distance"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*metric.order(), "seq"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "seq", "distance")


def _rough(q: np.ndarray, v: np.ndarray, metric: Metric) -> np.ndarray:
    """Scores in any order of summing; smaller is better."""
    if metric is Metric.MANHATTAN:
        out = np.zeros((len(q), len(v)))
        for d in range(q.shape[1]):
            out += np.abs(q[:, d, None] - v[None, :, d])
        return out
    dots = q @ v.T
    if metric is Metric.DOT_PRODUCT:
        return -dots
    a, b = (q * q).sum(axis=1), (v * v).sum(axis=1)
    if metric is Metric.EUCLIDEAN:
        return np.sqrt(np.maximum(a[:, None] + b[None, :] - 2 * dots, 0))
    length = np.sqrt(a[:, None] * b[None, :])
    return 1 - np.divide(dots, length, out=np.zeros_like(dots), where=length != 0)


def _exact(q: np.ndarray, v: np.ndarray, metric: Metric) -> np.ndarray:
    """Row by row, in the order that the Column functions sum."""

    def total(x: np.ndarray) -> np.ndarray:
        return np.cumsum(x, axis=1)[:, -1] if x.shape[1] else np.zeros(len(x))

    if metric is Metric.MANHATTAN:
        return total(np.abs(v - q))
    if metric is Metric.EUCLIDEAN:
        return np.sqrt(total((v - q) * (v - q)))
    dots = total(v * q)
    if metric is Metric.DOT_PRODUCT:
        return dots
    length = np.sqrt(total(v * v) * total(q * q))
    return 1.0 - np.divide(dots, length, out=np.zeros(len(dots)), where=length != 0)


def _ranked(query: np.ndarray, seq: np.ndarray, score: np.ndarray, k: int, metric: Metric) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query."""
    key = np.where(np.isnan(score), np.inf, score if metric.ascending else -score)
    order = np.lexsort((seq, key, np.isnan(score), query))
    query, seq, score = query[order], seq[order], score[order]
    keep = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[keep], seq[keep], score[keep]


def _tame(x: np.ndarray) -> np.ndarray:
    """Rows that float32 can compare: finite, neither huge nor tiny."""
    most = np.abs(x).max(axis=1, initial=0)
    return np.isfinite(x).all(axis=1) & (most <= 1e12) & ((most == 0) | (most >= 1e-12))


def _float32_error(dim: int) -> float:
    """How far a sum of dim products in float32 may be off, of the product of the norms."""
    return (dim + 16) * 2.0**-23


class _Products:
    """Rough scores by one matrix product in float32: rows of queries, greater is better."""

    rows = 256

    def __init__(self, q: np.ndarray, metric: Metric) -> None:
        self.metric, self.error = metric, _float32_error(q.shape[1])
        self.origin = q.mean(axis=0) if metric is Metric.EUCLIDEAN else np.zeros(q.shape[1])
        self.far = float(self.origin @ self.origin)
        q = q - self.origin
        self.square = (q * q).sum(axis=1)
        self.norm = np.sqrt(self.square)
        if metric is Metric.COSINE:
            q = np.divide(q, self.norm[:, None], out=np.zeros_like(q), where=self.norm[:, None] > 0)
        self.q = q.astype(np.float32)
        if metric is Metric.EUCLIDEAN:
            self.q = np.column_stack((self.q, np.ones(len(q), np.float32)))

    def block(self, v: np.ndarray) -> None:
        v = v - self.origin
        square = (v * v).sum(axis=1)
        norm = np.sqrt(square)
        self.longest = float(norm.max())
        if self.metric is Metric.COSINE:
            v = np.divide(v, norm[:, None], out=np.zeros_like(v), where=norm[:, None] > 0)
        v = v.astype(np.float32)
        if self.metric is Metric.EUCLIDEAN:
            v = np.column_stack((v, (square / -2).astype(np.float32)))
        self.v = v

    def rough(self, at: slice) -> np.ndarray:
        return self.q[at] @ self.v.T

    def least(self, at: slice, edge: np.ndarray) -> np.ndarray:
        """The rough score that whatever has an exact one of edge or better reaches."""
        if self.metric is Metric.COSINE:
            need, off = 1 - edge, np.full(len(edge), 2 * self.error)
        elif self.metric is Metric.DOT_PRODUCT:
            need, off = -edge, self.error * self.norm[at] * self.longest
        else:
            a, b = self.square[at], self.longest**2
            need = (a - edge * edge) / 2
            off = self.error * (self.norm[at] * self.longest + a + b) + 1e-12 * self.far
        off = off + 1e-6 * self.error * np.where(np.isfinite(need), np.abs(need), 0)
        return np.nextafter((need - off).astype(np.float32), np.float32(-np.inf))[:, None]


class _Steps:
    """The Manhattan distance of vectors in whole steps, summed in bytes; smaller is better, so its sign is turned.

    Vectors are clipped to where most queries lie, which brings none further apart; what a
    vector is off its steps is known exactly, so the sum bounds the distance from below.
    """

    rows = 128

    def __init__(self, q: np.ndarray, metric: Metric) -> None:
        self.low, high = np.quantile(q, (0.001, 0.999), axis=0)
        self.step = max(float((high - self.low).max()) / STEPS, 1e-13)
        self.q, self.off = self._taken(q)

    def _taken(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = np.clip((x - self.low) / self.step, 0, STEPS)
        taken = np.rint(place)
        off = np.abs(place - taken).sum(axis=1)
        return np.ascontiguousarray(np.pad(taken.astype(np.int8), ((0, 0), (0, -x.shape[1] % 4))).T), off

    def block(self, v: np.ndarray) -> None:
        self.v, self.v_off = self._taken(v)
        self.most = float(self.v_off.max())

    def rough(self, at: slice) -> np.ndarray:
        q, n = self.q[:, at], self.v.shape[1]
        v = np.pad(self.v, ((0, 0), (0, n % 2)))
        four, gap = np.empty((q.shape[1], v.shape[1]), np.int8), np.empty((q.shape[1], v.shape[1]), np.int8)
        pairs = four.view("<u2")  # of neighbours' bytes, added up together and told apart by the upper ones' own sum
        both, upper = np.zeros_like(pairs), np.zeros_like(pairs)
        for d in range(0, len(v), 4):
            np.subtract(v[d][None, :], q[d][:, None], out=four)
            np.absolute(four, out=four)
            for e in range(d + 1, d + 4):
                np.subtract(v[e][None, :], q[e][:, None], out=gap)
                np.absolute(gap, out=gap)
                np.add(four.view(np.uint8), gap.view(np.uint8), out=four.view(np.uint8))
            np.add(both, pairs, out=both)
            np.right_shift(pairs, 8, out=pairs)
            np.add(upper, pairs, out=upper)
        total = np.empty(four.shape, np.int16)
        total[:, 1::2] = upper
        total[:, 0::2] = both - (upper << np.uint16(8))
        return np.negative(total, out=total)[:, :n]

    def least(self, at: slice, edge: np.ndarray) -> np.ndarray:
        steps = np.floor(edge * (1 + 1e-9) / self.step + self.off[at] + self.most + 1)
        return -np.minimum(steps, 32_000).astype(np.int16)[:, None]


class _Doubles:
    """Rough scores of any vectors, NaN and infinite ones among them."""

    rows = 256

    def __init__(self, q: np.ndarray, metric: Metric) -> None:
        self.q, self.metric = q, metric
        self.norm = np.sqrt((q**2).sum(axis=1))

    def block(self, v: np.ndarray) -> None:
        self.v, self.longest = v, np.sqrt((v**2).sum(axis=1).max(initial=0))

    def rough(self, at: slice) -> np.ndarray:
        out = -_rough(self.q[at], self.v, self.metric)
        return np.where(np.isnan(out), np.inf, out)  # what can't be told is scored exactly

    def least(self, at: slice, edge: np.ndarray) -> np.ndarray:
        size = self.norm[at] + self.longest
        off = ROUGH * np.maximum(1, np.where(np.isfinite(size), size, np.inf) ** (2 if self.metric is Metric.DOT_PRODUCT else 1))
        return np.where(np.isfinite(edge) & np.isfinite(off), -edge - off, -np.inf)[:, None]


class _Group:
    """Queries of one dimension and the k best that each has met so far."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int, metric: Metric, held: int) -> None:
        tame = _tame(q)
        order = np.argsort(~tame, kind="stable")
        self.ids, self.q, self.tame = ids[order], q[order], int(tame.sum())
        self.k, self.metric, self.most = k, metric, held
        self.dim = q.shape[1]
        fast = _Steps if metric is Metric.MANHATTAN else _Products
        self.quick = fast(self.q[: self.tame], metric) if self.tame and 0 < self.dim <= (NARROW if metric is Metric.MANHATTAN else 1 << 16) else None
        self.slow = _Doubles(self.q, metric)
        #: No answer beyond it can be among the k best.
        self.edge = np.full(len(ids), np.inf)
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size, self.ranked = 0, 0
        self.others = np.empty(0, np.int64)

    def _key(self, score: np.ndarray) -> np.ndarray:
        return np.where(np.isnan(score), np.inf, score if self.metric.ascending else -score)

    def meet(self, seq: np.ndarray, v: np.ndarray) -> Iterator[pa.RecordBatch]:
        tame = _tame(v) if self.quick else np.zeros(len(v), bool)
        if tame.any():
            yield from self._compare(self.quick, 0, self.tame, seq[tame], v[tame])
            if self.tame < len(self.ids):
                yield from self._compare(self.slow, self.tame, len(self.ids), seq[tame], v[tame])
        if not tame.all():
            yield from self._compare(self.slow, 0, len(self.ids), seq[~tame], v[~tame])

    def pass_by(self, seq: np.ndarray) -> None:
        """Vectors of another dimension score a constant, so the first k by seq count."""
        self.others = np.sort(np.concatenate((self.others, seq)))[: self.k]

    def _compare(self, form, low: int, high: int, seq: np.ndarray, v: np.ndarray) -> Iterator[pa.RecordBatch]:
        form.block(v)
        for a in range(low, high, form.rows):
            at = slice(a, min(a + form.rows, high))
            rough = form.rough(at)
            edge = self.edge[at]
            if np.isinf(edge).any() and len(v) > self.k:
                # k pairs' exact scores bound the k best.
                some = np.argpartition(rough, len(v) - self.k, axis=1)[:, len(v) - self.k :]
                row = np.repeat(np.arange(a, at.stop), self.k)
                edge = self.edge[at] = np.minimum(edge, self._key(self._exact(row, v, some.ravel())).reshape(-1, self.k).max(axis=1))
            row, col = np.divmod(np.flatnonzero(rough >= form.least(at, edge)), len(v))
            row += a
            for b in range(0, len(row), max(1, self.most)):
                r, c = row[b : b + self.most], col[b : b + self.most]
                score = self._exact(r, v, c)
                good = self._key(score) <= self.edge[r]
                self.parts.append((r[good], seq[c[good]], score[good]))
                self.size += int(good.sum())
                if self.size > max(2 * self.ranked, self.k * len(self.ids), 1 << 16) or self.size > self.most:
                    yield from self._merge()

    def _exact(self, row: np.ndarray, v: np.ndarray, col: np.ndarray) -> np.ndarray:
        step = max(1, CELLS // max(1, self.dim))
        parts = [_exact(self.q[row[a : a + step]], v[col[a : a + step]], self.metric) for a in range(0, len(row), step)]
        return np.concatenate(parts) if parts else np.empty(0)

    def _merge(self) -> Iterator[pa.RecordBatch]:
        row, seq, score = _ranked(*map(np.concatenate, zip(*self.parts)), self.k, self.metric)
        self.parts, self.size, self.ranked = [(row, seq, score)], len(row), len(row)
        last = np.flatnonzero(np.arange(len(row)) - np.searchsorted(row, row) == self.k - 1)
        self.edge[row[last]] = np.minimum(self.edge[row[last]], self._key(score[last]))
        if self.size > self.most // 2:
            yield from self._out()

    def _out(self) -> Iterator[pa.RecordBatch]:
        for row, seq, score in self.parts:
            yield pa.RecordBatch.from_arrays([pa.array(self.ids[row]), pa.array(seq), pa.array(score)], ["query_id", "seq", "distance"])
        self.parts, self.size, self.ranked = [], 0, 0

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            yield from self._merge()
        yield from self._out()
        n = len(self.others)
        for a in range(0, len(self.ids) if n else 0, max(1, CELLS // max(1, n))):
            own = self.ids[a : a + max(1, CELLS // n)]
            score = np.full(len(own) * n, 1.0 if self.metric is Metric.COSINE else 0.0)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, n)), pa.array(np.tile(self.others, len(own))), pa.array(score)], ["query_id", "seq", "distance"])


def _by_dim(batch: pa.RecordBatch, first: int, stop: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of the rows from first to stop, one dimension at a time."""
    ids, lists = batch.column(2)[first:stop].to_numpy(), batch.column(3)[first:stop]
    sizes = lists.value_lengths().fill_null(0).to_numpy()
    for dim in np.unique(sizes):
        at = np.flatnonzero(sizes == dim)
        yield ids[at], lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), dim)


def _closest(k: int, metric: Metric, block: int, held: int):
    """For rows of cell, kind (0: query, 1: stored vector), id and vector, in the order of cell and kind."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, asked, groups = None, [], None
        for batch in batches:
            mark = batch.column(0).to_numpy().astype(np.int64) * 2 + batch.column(1).to_numpy()
            bounds = [0, *(np.flatnonzero(np.diff(mark)) + 1).tolist(), len(mark)]
            for first, stop in zip(bounds, bounds[1:]):
                if mark[first] // 2 != cell:
                    for g in groups or []:
                        yield from g.end()
                    cell, asked, groups = mark[first] // 2, [], None
                if mark[first] % 2 == 0:
                    asked += _by_dim(batch, first, stop)
                    continue
                if groups is None:
                    by: dict[int, list] = {}
                    for ids, q in asked:
                        by.setdefault(q.shape[1], []).append((ids, q))
                    with np.errstate(all="ignore"):
                        asked, groups = [], [_Group(*map(np.concatenate, zip(*parts)), k, metric, held) for parts in by.values()]
                with np.errstate(all="ignore"):
                    for seq, v in _by_dim(batch, first, stop):
                        for g in groups:
                            if v.shape[1] != g.dim:
                                g.pass_by(seq)
                                continue
                            for a in range(0, len(v), block):
                                yield from g.meet(seq[a : a + block], v[a : a + block])
        for g in groups or []:
            yield from g.end()

    return run


def search_each(queries: DataFrame, store: DataFrame, k: int, metric: Metric, query_id: str = "query_id", query: str = "query", seq: str = "seq", vector: str = "vector") -> DataFrame:
    """As search_each_plain, by matrix products of blocks.

    Queries are dealt into parts of bounded size, stored vectors into as many as there are
    tasks left; each part of the one meets each of the other in a task, which holds its
    queries and their k best while the stored vectors stream by. Rough scores pick what may be
    among the k best, exact ones decide. query_id must be an integer.
    """
    if k <= 0:
        return search_each_plain(queries, store, 0, metric, query_id, query, seq, vector)
    narrow = all(df.schema[c].dataType.simpleString() == "array<float>" for df, c in ((queries, query), (store, vector)))
    side = lambda df, id, v: df.select(F.col(id).cast("bigint").alias("id"), F.col(v).cast("array<float>" if narrow else "array<double>").alias("v"))
    left, right = side(queries, query_id, query), side(store, seq, vector)
    n, tasks = queries.count(), 2 * queries.sparkSession.sparkContext.defaultParallelism
    parts = max(1, min(tasks, -(-n // SHARE)), -(-n // max(256, min(MOST, HELD // (4 * k)))))
    splits = -(-tasks // parts)
    own = lambda many: F.pmod(F.xxhash64("id"), F.lit(many)).cast("int")
    each = lambda many: F.explode(F.sequence(F.lit(0), F.lit(many - 1)))
    asked = left.select(own(parts).alias("p"), each(splits).alias("s"), F.lit(0).alias("kind"), "id", "v")
    stored = right.select(each(parts).alias("p"), own(splits).alias("s"), F.lit(1).alias("kind"), "id", "v")
    cells = asked.union(stored).select((F.col("p") * splits + F.col("s")).alias("cell"), "kind", "id", "v")
    met = cells.repartitionById(parts * splits, "cell").sortWithinPartitions("cell", "kind")
    near = met.mapInArrow(_closest(k, metric, BLOCK, HELD), "query_id bigint, seq bigint, distance double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*metric.order(), "seq"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "seq", "distance")
