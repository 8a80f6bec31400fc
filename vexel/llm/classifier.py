"""A text classifier by naive Bayes support vectors.

Features are indicators of a document's one- and two-word sequences (lower case), hashed
into a fixed number of buckets. For each label, Spark counts over all labelled documents
how many of either class have a bucket; the smoothed log ratio of the classes' shares
scales the indicator. Rows are brought to unit length, and a linear model with hinge loss,
weighted so that both classes count the same, is fitted by dual coordinate descent on a
bounded sample of the labelled rows (``fit_rows``, about; drawn by hash of the id).

``fit`` returns a ``Model``; ``score`` gives each document's margin for each label and
``keep``, whether every label is on its wanted side.

Edge cases: null and empty texts have no features and score the bias alone. Rows whose
label is null don't take part in that label's fit; label rows that repeat an id count as
often as they join. A label with one class only, or without rows, gets a constant score of
that class (0.0 without rows, which counts as wanted). Documents are scored one by one, so
repeated rows, null ids and ties change nothing: equal texts get equal scores, and a score
of exactly 0 counts as the positive class. An empty table gives an empty result. Only the
named columns are read, so others cannot clash. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vexel.llm.blocks import Block, blocks, mix, words
from vexel.llm.tables import kept

#: Buckets; rows of the fit's sample, about; rows of labels up to which Spark is told to send them to the documents, beyond it both sides shuffle.
BUCKETS, FIT_ROWS, BROADCAST_ROWS = 1 << 18, 8192, 1_000_000
EPOCHS, COST, SMOOTH = 12, 1.0, 1.0
_STEP = np.uint64(0x9FB21C651E98DF25)


def features(block: Block, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, bucket) pairs of a block, in order."""
    w = words(block, lower=True)
    one = mix(w.hash)
    two = mix(w.hash[:-1] * _STEP + w.hash[1:])
    inside = w.row[1:] == w.row[:-1]
    row = np.concatenate((w.row, w.row[1:][inside]))
    key = np.concatenate((one, two[inside])) % np.uint64(buckets)
    pairs = np.unique(row * buckets + key.astype(np.int64))
    return pairs // buckets, pairs % buckets


@dataclass
class Head:
    """One label: weights of the buckets before scaling to unit length, log ratios, and the bias."""

    ratio: np.ndarray
    weight: np.ndarray
    bias: float

    def margin(self, row: np.ndarray, bucket: np.ndarray, rows: int) -> np.ndarray:
        r = self.ratio[bucket]
        norm = np.sqrt(np.bincount(row, r * r, rows))
        dot = np.bincount(row, r * self.weight[bucket], rows)
        return np.divide(dot, norm, out=np.zeros(rows), where=norm > 0) + self.bias


@dataclass
class Model:
    labels: list[str]
    wanted: dict[str, int]
    heads: list[Head]
    buckets: int = BUCKETS


def descend(starts: np.ndarray, index: np.ndarray, value: np.ndarray, sign: np.ndarray, size: int, epochs: int = EPOCHS, cost: float = COST, seed: int = 0) -> tuple[np.ndarray, float]:
    """Weights and bias of the hinge-loss model; rows are sparse and of unit length."""
    n = len(sign)
    w, bias, alpha = np.zeros(size), 0.0, np.zeros(n)
    top = np.where(sign > 0, 0.5 / max((sign > 0).sum(), 1), 0.5 / max((sign < 0).sum(), 1)) * n * cost
    rng = np.random.default_rng(seed)
    rows = [(index[a:b], value[a:b]) for a, b in zip(starts[:-1], starts[1:])]
    square = np.array([float(v @ v) for _, v in rows]) + 1.0 if n else np.zeros(0)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(n):
            at, v = rows[i]
            y = sign[i]
            gradient = y * (w[at] @ v + bias) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), top[i])
            step = (new - alpha[i]) * y
            if step:
                w[at] += step * v
                bias += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w, bias


def _labelled(docs: DataFrame, labels: DataFrame, names: list[str], id_col: str, text_col: str) -> DataFrame:
    left = docs.select(F.col(id_col).cast("bigint").alias("__id"), F.col(text_col).alias("text"))
    right = labels.select(F.col(id_col).cast("bigint").alias("__id"), *[F.col(n).cast("int").alias(n) for n in names])
    return left.join(F.broadcast(right) if right.count() <= BROADCAST_ROWS else right, "__id")


def _count(names: list[str], buckets: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(names), 2, buckets), np.int32)
        rows = np.zeros((len(names), 2), np.int64)
        for batch in batches:
            truth = [batch.column(k + 2).fill_null(-1).to_numpy() for k in range(len(names))]
            for block in blocks(batch.column(1)):
                row, bucket = features(block, buckets)
                for k, y in enumerate(truth):
                    y = y[block.first : block.last]
                    for c in (0, 1):
                        total[k, c] += np.bincount(bucket[y[row] == c], minlength=buckets).astype(np.int32)
                        rows[k, c] += (y == c).sum()
        for k in range(len(names)):
            for c in (0, 1):
                some = np.flatnonzero(total[k, c])
                n = np.append(total[k, c, some], rows[k, c]).astype(np.int64)
                some = np.append(some, -1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), 2 * k + c, np.int32)), pa.array(some.astype(np.int32)), pa.array(n)], ["side", "bucket", "n"])

    return run


def _sample(names: list[str], buckets: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                row, bucket = features(block, buckets)
                offsets = np.searchsorted(row, np.arange(block.rows + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(bucket.astype(np.int32)))
                keep = [batch.column(k).slice(block.first, block.rows) for k in (0, *range(2, 2 + len(names)))]
                yield pa.RecordBatch.from_arrays([keep[0], lists, *keep[1:]], ["__id", "buckets", *names])

    return run


def fit(docs: DataFrame, labels: DataFrame, wanted: dict[str, int], id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS, buckets: int = BUCKETS) -> Model:
    """wanted: label columns (0/1) and the class of each that score() keeps."""
    names = list(wanted)
    table = kept(_labelled(docs, labels, names, id_col, text_col), "labelled")
    # At most 2 x labels x buckets rows, whatever the corpus.
    counted = table.mapInArrow(_count(names, buckets), "side int, bucket int, n bigint").groupBy("side", "bucket").agg(F.sum("n").alias("n")).toArrow()
    side, bucket, n = (counted.column(k).to_numpy() for k in range(3))
    share = min(1.0, fit_rows / max(table.count(), 1))
    drawn = table.where(F.xxhash64("__id", F.lit(20240229)) <= F.lit(min(int(share * (1 << 64)), (1 << 64) - 1) - (1 << 63)).cast("bigint"))
    fields = ", ".join(f"{x} int" for x in names)
    sample = drawn.mapInArrow(_sample(names, buckets), f"__id bigint, buckets array<int>, {fields}").toArrow()
    order = np.argsort(sample.column(0).to_numpy(), kind="stable")
    lists = sample.column(1).combine_chunks()
    size = lists.value_lengths().to_numpy() if len(lists) else np.zeros(0, np.int64)
    flat = lists.flatten().to_numpy() if len(lists) else np.zeros(0, np.int32)
    ends = np.cumsum(size, dtype=np.int64)
    heads = []
    for k, name in enumerate(names):
        share_of = []
        for c in (0, 1):
            own = side == 2 * k + c
            count = np.full(buckets, SMOOTH)
            here = own & (bucket >= 0)
            count[bucket[here]] += n[here]
            share_of.append((count / count.sum(), int(n[own & (bucket < 0)].sum())))
        (negative, n0), (positive, n1) = share_of
        if not n0 or not n1:
            heads.append(Head(np.zeros(buckets, np.float32), np.zeros(buckets, np.float32), float(n1 > 0) - float(n0 > 0) if n0 or n1 else 0.0))
            continue
        ratio = np.log(positive / negative)
        truth = sample.column(k + 2).to_numpy(zero_copy_only=False)
        use = [i for i in order if truth[i] in (0, 1)]
        starts = np.concatenate(([0], np.cumsum(size[use], dtype=np.int64)))
        index, value = np.empty(starts[-1], np.int32), np.empty(starts[-1], np.float32)
        for at, i in zip(starts, use):
            part = flat[ends[i] - size[i] : ends[i]]
            v = ratio[part]
            index[at : at + len(part)] = part
            value[at : at + len(part)] = v / (np.sqrt(v @ v) or 1)
        weight, bias = descend(starts, index, value, np.where(truth[use].astype(np.int64) == 1, 1.0, -1.0), buckets)
        heads.append(Head(ratio.astype(np.float32), weight.astype(np.float32), float(bias)))
    return Model(names, wanted, heads, buckets)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, a margin for each label, and keep, for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two arrays of `buckets` numbers for each label
    names, wanted = model.labels, model.wanted

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            parts, keeps = [[] for _ in names], []
            for block in blocks(batch.column(1)):
                row, bucket = features(block, m.buckets)
                keep = np.ones(block.rows, bool)
                for k, head in enumerate(m.heads):
                    margin = head.margin(row, bucket, block.rows)
                    parts[k].append(margin)
                    keep &= (margin >= 0) == (wanted[names[k]] == 1) if head.bias or head.ratio.any() else True
                keeps.append(keep)
            margins = [np.concatenate([*p, np.zeros(0)]) for p in parts]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, margins), pa.array(np.concatenate([*keeps, np.zeros(0, bool)]))], ["doc_id", *[f"{n}_score" for n in names], "keep"])

    fields = ", ".join(f"{n}_score double" for n in names)
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id bigint, {fields}, keep boolean")
