"""Text embedding by sparse random projection.

Each word of a fitted vocabulary has a row of -1, 0 and +1 (one sixth, two thirds, one
sixth) drawn by hash of seed, word and dimension, so the matrix needs no order and no
state. A text's vector is the sum of its words' rows, brought to unit length; common scale
factors cancel, so sums are of whole numbers and don't depend on partitioning. Unknown
words add nothing; a text without known words has the zero vector.

Workers draw rows as they need them and sum whole texts in one pass. Which words count is
told by a copy of a small vocabulary (``SMALL`` bytes), else by a copy of the texts' unknown
words, which one pass over their distinct words finds (a text of the corpus has none), else by
a copy of the larger vocabulary; where neither fits in ``COPIED`` bytes, by a join of words.
The vectors are the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from math import sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vexel.functions.text import tokenize
from vexel.sources import scratch

SEED = 42
VOCABULARY = "tok_idx BIGINT, token STRING, entries ARRAY<STRUCT<dim: INT, val: FLOAT>>"
#: Bytes of words and signs that a worker may be given; cells that are summed at once.
SMALL, COPIED, CELLS = 1 << 20, 64 << 20, 1 << 22
#: Words that are drawn and summed at once; a text isn't divided.
WORDS = 1 << 18


def signs(tokens: list[str], dims: int, seed: int) -> np.ndarray:
    """The words' rows: 16 bits of SHA-256 of seed, word and dimension // 16, modulo 6; 0 is minus, 1 is plus."""
    if not tokens:
        return np.zeros((0, dims), np.int8)
    parts = [f":{block}".encode() for block in range(-(-dims // 16))]
    raw = bytearray()
    for token in tokens:
        begun = hashlib.sha256(f"{seed}:{token}".encode())
        for part in parts:
            drawn = begun.copy()
            drawn.update(part)
            raw += drawn.digest()
    cell = np.frombuffer(raw, ">u2").reshape(len(tokens), -1)[:, :dims] % 6
    return (cell == 1).astype(np.int8) - (cell == 0).astype(np.int8)


def _draw(dims: int, seed: int, scale: float):
    """The words' non-zero cells."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matrix = signs(batch.column(1).to_pylist(), dims, seed)
            row, dim = np.nonzero(matrix)
            offsets = np.searchsorted(row, np.arange(len(matrix) + 1)).astype(np.int32)
            cells = pa.StructArray.from_arrays([pa.array(dim.astype(np.int32)), pa.array((matrix[row, dim] * scale).astype(np.float32))], ["dim", "val"])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(offsets), cells)], ["tok_idx", "token", "entries"])

    return run


def _total(matrix: np.ndarray, place: np.ndarray, times: np.ndarray | None, text: np.ndarray, texts: int) -> np.ndarray:
    """Sums of the rows at place (where not -1, so many times), by text; text ascends."""
    known = place >= 0
    place, text = place[known], text[known]
    times = None if times is None else times[known]
    out = np.zeros((texts, matrix.shape[1]), np.int64)
    step = max(1, CELLS // matrix.shape[1])
    for a in range(0, len(place), step):
        rows = matrix[place[a : a + step]].astype(np.int64)
        if times is not None:
            rows *= times[a : a + step, None]
        own = text[a : a + step]
        first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        out[own[first]] += np.add.reduceat(rows, first, axis=0)
    return out


def _unit(total: np.ndarray) -> pa.Array:
    length = np.sqrt((total * total).sum(axis=1, keepdims=True).astype(np.float64))
    unit = np.divide(total, length, out=np.zeros(total.shape), where=length > 0)
    offsets = np.arange(len(total) + 1, dtype=np.int32) * total.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(unit.ravel()))


def _few(words: DataFrame, each: int, most: int) -> pa.Array | None:
    """The words, if they take most bytes or less, with so many more for each."""
    n, size = words.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("token")), F.lit(0))).first()
    return words.toArrow().column(0).combine_chunks() if n * each + size <= most else None


class RandomProjection:
    def __init__(self, dims: int, seed: int = SEED) -> None:
        if dims < 1:
            raise ValueError("a projection needs one dimension or more")
        self._dims, self.seed = dims, seed
        self.vocabulary: DataFrame | None = None

    @property
    def dims(self) -> int:
        return self._dims

    @property
    def scale(self) -> float:
        """Size of the matrix's non-zero cells."""
        return sqrt(3 / self._dims)

    def fit(self, corpus: DataFrame, text_col: str = "text", order_col: str | None = None) -> RandomProjection:
        """Take the corpus's words, in the order of order_col (else of the words themselves); any earlier vocabulary goes.

        Words are sorted by ranges and numbered within them; the driver only adds up the
        ranges' sizes. The vocabulary is written once and read from then on.
        """
        if order_col is None:
            met = corpus.select(F.explode(tokenize(text_col)).alias("token")).distinct().withColumn("first", F.col("token"))
        else:
            words = corpus.select(F.col(order_col).alias("at"), F.posexplode(tokenize(text_col)).alias("pos", "token"))
            met = words.groupBy("token").agg(F.min(self._place(corpus, order_col)).alias("first"))
        met = met.repartitionByRange("first").sortWithinPartitions("first")
        row = F.monotonically_increasing_id()
        ranged = scratch.kept(met.select("token", F.shiftright(row, 33).cast("int").alias("range"), row.bitwiseAND(F.lit((1 << 33) - 1)).alias("row")), "words")
        before, at = {}, 0
        for number, n in sorted(map(tuple, ranged.groupBy("range").count().collect())):  # a row for each range
            before[number], at = at, at + n
        starts = ranged.sparkSession.createDataFrame(list(before.items()), "range INT, start BIGINT")
        numbered = ranged.join(F.broadcast(starts), "range").select((F.col("start") + F.col("row")).alias("tok_idx"), "token")
        self.vocabulary = scratch.kept(numbered.mapInArrow(_draw(self._dims, self.seed, self.scale), VOCABULARY), "vocabulary")
        return self

    @staticmethod
    def _place(corpus: DataFrame, order_col: str) -> Column:
        """Order of at and pos: one number where it fits, which Spark aggregates by hash, else both, which it must sort."""
        if isinstance(corpus.schema[order_col].dataType, T.IntegralType):
            at = F.col(order_col)
            low, high, nulls = corpus.agg(F.min(at), F.max(at), F.count_if(at.isNull())).first()
            if low is not None and not nulls and -(1 << 33) <= low and high < 1 << 33:  # a text has less than 2**30 words
                return F.shiftleft(F.col("at").cast("bigint"), 30) + F.col("pos")
        return F.struct("at", "pos")

    def _fitted(self) -> DataFrame:
        if self.vocabulary is None:
            raise ValueError("the projection isn't fitted")
        return self.vocabulary

    def vocab_size(self) -> int:
        return self._fitted().count() if self.vocabulary is not None else 0

    def _copied(self, most: int) -> pa.Array | None:
        """The vocabulary's words, if they and their rows are few enough for every worker."""
        return _few(self._fitted().select("token"), self._dims + 8, most)

    def embed(self, texts: DataFrame, text_col: str = "text", out_col: str = "embedding") -> DataFrame:
        """texts with a vector of doubles; a null text has the zero vector. Texts are read twice where the vocabulary isn't small."""
        dims, seed, columns = self._dims, self.seed, texts.columns
        schema = T.StructType([*texts.schema.fields, T.StructField(out_col, T.ArrayType(T.DoubleType()))])
        words = self._copied(min(SMALL, COPIED))
        if words is None:
            met = texts.select(F.explode(tokenize(text_col)).alias("token"), F.lit(0).alias("known")).union(self._fitted().select("token", F.lit(1).alias("known")))
            unknown = _few(scratch.kept(met.groupBy("token").agg(F.max("known").alias("known")).where("known = 0").select("token"), "unknown"), 8, COPIED)
            if unknown is not None:
                return self._embed_without(unknown, texts, text_col, schema)
            words = self._copied(COPIED)
        if words is None:
            return self._embed_by_join(texts, text_col, schema)
        shared = texts.sparkSession.sparkContext.broadcast(words)  # COPIED bytes at most, with its rows

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, matrix = shared.value, None
            for batch in batches:
                if matrix is None:
                    matrix = signs(known.to_pylist(), dims, seed)
                lists = batch.column(len(columns))
                count = lists.value_lengths().fill_null(0).to_numpy()
                place = pc.index_in(lists.flatten(), known).fill_null(-1).to_numpy()
                total = _total(matrix, place, None, np.repeat(np.arange(len(count)), count), len(count))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], _unit(total)], schema.names)

        tokens = scratch.free_name(columns, "tokens")
        return texts.withColumn(tokens, tokenize(text_col)).mapInArrow(run, schema)

    def _embed_without(self, unknown: pa.Array, texts: DataFrame, text_col: str, schema: T.StructType) -> DataFrame:
        """All words count but the unknown ones; workers draw rows for the words they meet."""
        dims, seed, columns = self._dims, self.seed, texts.columns
        shared = texts.sparkSession.sparkContext.broadcast(unknown)  # COPIED bytes at most

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            strange = shared.value
            for batch in batches:
                lists = batch.column(len(columns))
                ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy())
                first = 0
                while first < len(ends):
                    limit = WORDS + (ends[first - 1] if first else 0)
                    stop = max(first + 1, int(np.searchsorted(ends, limit, "right")))
                    own = lists.slice(first, stop - first)
                    count = own.value_lengths().fill_null(0).to_numpy()
                    words = own.flatten().dictionary_encode()
                    matrix = signs(words.dictionary.to_pylist(), dims, seed)
                    if len(strange):
                        matrix[pc.is_in(words.dictionary, strange).to_numpy(zero_copy_only=False)] = 0
                    total = _total(matrix, words.indices.to_numpy(), None, np.repeat(np.arange(len(count)), count), len(count))
                    yield pa.RecordBatch.from_arrays([*(c.slice(first, stop - first) for c in batch.columns[:-1]), _unit(total)], schema.names)
                    first = stop

        tokens = scratch.free_name(columns, "tokens")
        return texts.withColumn(tokens, tokenize(text_col)).mapInArrow(run, schema)

    def _embed_by_join(self, texts: DataFrame, text_col: str, schema: T.StructType) -> DataFrame:
        """Rows are numbered, their words joined with the vocabulary and gathered again by number."""
        dims, seed, columns = self._dims, self.seed, texts.columns
        row, inside = scratch.free_name(columns, "row"), scratch.free_name(columns, "words")
        rows = scratch.kept(texts.withColumn(row, F.monotonically_increasing_id()), "texts")
        counts = rows.select(row, F.explode(tokenize(text_col)).alias("token")).groupBy(row, "token").count()
        lists = counts.join(self._fitted().select("token"), "token", "left_semi").groupBy(row).agg(F.collect_list(F.struct("token", "count")).alias(inside))

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists = batch.column(len(columns))
                count = lists.value_lengths().fill_null(0).to_numpy()
                pairs = lists.flatten()
                words = pairs.field(0).dictionary_encode()
                total = _total(signs(words.dictionary.to_pylist(), dims, seed), words.indices.to_numpy(), pairs.field(1).to_numpy(), np.repeat(np.arange(len(count)), count), len(count))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], _unit(total)], schema.names)

        return rows.join(lists, row, "left").select(*[F.col(f"`{c}`") for c in columns], inside).mapInArrow(run, schema)

    def cells(self, texts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """id, dim, value of the vectors' non-zero elements."""
        vectors = self.embed(texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", "vector")
        return vectors.select("id", F.posexplode("vector").alias("dim", "value")).where("value <> 0")

    def save(self, path: str) -> None:
        meta = {"output_dim": self._dims, "seed": self.seed}
        self._fitted().select("tok_idx", F.col("token").alias("token", metadata=meta), "entries").write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> RandomProjection:
        rows = spark.read.parquet(path)
        meta = rows.schema["token"].metadata
        out = cls(meta["output_dim"], meta["seed"])
        out.vocabulary = rows
        return out
