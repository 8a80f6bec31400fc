"""A vector store: a DataFrame of seq, id and vector, with a metric.

seq is the order of insertion. Ids may repeat, vectors may differ in length: a vector whose
length isn't the query's scores 0 under the Euclidean and Manhattan distances (so it comes
first), 1 under cosine and 0 under the dot product. Stores don't change: ``add`` and
``remove`` return others.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vexel.functions.metric import Metric
from vexel.operators import knn
from vexel.sources import store_files

SCHEMA = "seq BIGINT, id STRING, vector ARRAY<FLOAT>"


class VectorStore:
    def __init__(self, spark: SparkSession, metric: Metric | int = Metric.COSINE, rows: DataFrame | None = None) -> None:
        self.spark, self.metric = spark, Metric(metric)
        self.rows = spark.createDataFrame([], SCHEMA) if rows is None else rows

    @classmethod
    def of(cls, rows: DataFrame, metric: Metric | int = Metric.COSINE, seq: str = "seq", id: str = "id", vector: str = "vector") -> VectorStore:
        """A store over any table: seq is a column that orders it."""
        kept = rows.select(F.col(seq).cast("bigint").alias("seq"), F.col(id).cast("string").alias("id"), F.coalesce(F.col(vector).cast("array<float>"), F.array().cast("array<float>")).alias("vector"))
        return cls(rows.sparkSession, metric, kept)

    def add(self, items: Iterable[tuple[str, Sequence[float] | None]] | DataFrame) -> VectorStore:
        """Append many rows at once: (id, vector) pairs, or a DataFrame of seq, id, vector in which seq orders the new rows."""
        if not isinstance(items, DataFrame):
            items = self.spark.createDataFrame([(n, i, None if v is None else [float(x) for x in v]) for n, (i, v) in enumerate(items)], SCHEMA)
        new = VectorStore.of(items).rows
        last = self.rows.agg(F.coalesce(F.max("seq"), F.lit(-1).cast("bigint")).alias("__last"))
        low = new.agg(F.min("seq").alias("__low"))
        moved = new.crossJoin(last).crossJoin(low).select((F.col("seq") - F.col("__low") + F.col("__last") + 1).alias("seq"), "id", "vector")
        return VectorStore(self.spark, self.metric, self.rows.unionByName(moved))

    def __len__(self) -> int:
        return self.rows.count()

    def search(self, query: Sequence[float], k: int) -> DataFrame:
        """rank, id, distance, vector of the k nearest, best first; none for k <= 0."""
        return knn.search(self.rows, query, k, self.metric).select("rank", "id", "distance", "vector")

    def search_each(self, queries: DataFrame, k: int, query_id: str = "query_id", query: str = "query") -> DataFrame:
        """query_id, rank, id and distance for each row of queries."""
        near = knn.search_each(queries, self.rows, k, self.metric, query_id, query)
        return near.join(self.rows.select("seq", "id"), "seq").select("query_id", "rank", "id", "distance")

    def get(self, id: str) -> DataFrame:
        """The first row of that id, or none."""
        return self.rows.where(F.col("id") == id).orderBy("seq").limit(1)

    def remove(self, id: str) -> tuple[VectorStore, bool]:
        """Without the first row of that id, whose place the last row takes; and whether there was one."""
        first, last = self.rows.agg(F.min(F.when(F.col("id") == id, F.col("seq"))), F.max("seq")).first()
        if first is None:
            return self, False
        left = self.rows.where(F.col("seq") != first).withColumn("seq", F.when(F.col("seq") == last, F.lit(first)).otherwise(F.col("seq")))
        return VectorStore(self.spark, self.metric, left), True

    def validate_dims(self) -> VectorStore:
        """Raise ValueError unless all vectors have one length."""
        sizes = [r.n for r in self.rows.select(F.size("vector").alias("n")).distinct().limit(2).collect()]
        if len(sizes) > 1:
            raise ValueError(f"vectors of {sizes[0]} and of {sizes[1]} dimensions")
        return self

    def save(self, path: str) -> None:
        store_files.save_parquet(self.rows, self.metric, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> VectorStore:
        rows, metric = store_files.load_parquet(spark, path)
        return cls(spark, metric, rows)

    def save_json(self, path: str) -> None:
        store_files.save_json(self.rows, self.metric, path)

    @classmethod
    def load_json(cls, spark: SparkSession, path: str) -> VectorStore:
        rows, metric = store_files.load_json(spark, path)
        return cls(spark, metric, rows)
