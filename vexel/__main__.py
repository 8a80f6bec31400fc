"""python -m vexel demo | embed | persist | onnx MODEL VOCABULARY: small tours of the store and the text embedders."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from vexel.functions import Metric, cosine
from vexel.operators import OnnxEmbedder, RandomProjection, VectorStore
from vexel.sources import scratch

ANIMALS = [("otter", [0.9, 0.7, 0.2]), ("seal", [1.0, 0.6, 0.1]), ("bicycle", [0.1, 0.1, 1.0]), ("tram", [0.0, 0.2, 0.9])]
LINES = ["rivers carry snow water to the sea", "the tram follows the river", "snow falls on the hills", "fresh bread needs flour and water", "flour comes from the mill"]


def demo(spark: SparkSession) -> None:
    """The three nearest of four vectors."""
    VectorStore(spark).add(ANIMALS).search([0.95, 0.65, 0.1], 3).select("rank", "id", "distance").show()


def embed(spark: SparkSession) -> None:
    """Fit five lines, embed them and search with one more."""
    texts = spark.createDataFrame(list(enumerate(LINES)), "n BIGINT, text STRING")
    projection = RandomProjection(64).fit(texts, order_col="n")
    store = VectorStore.of(projection.embed(texts), Metric.COSINE, "n", "text", "embedding")
    query = projection.embed(spark.createDataFrame([("water in the river",)], "text STRING")).first()
    store.search(query.embedding, 3).select("rank", "id", "distance").show(truncate=False)


def persist(spark: SparkSession) -> None:
    """Save a store and load it again; the metric comes with it."""
    path = scratch.folder(spark, "store")
    VectorStore(spark, Metric.EUCLIDEAN).add(ANIMALS).save(path)
    store = VectorStore.load(spark, path)
    print(store.metric.name, len(store))
    store.search([0.0, 0.1, 1.0], 2).select("rank", "id", "distance").show()


def onnx(spark: SparkSession, model: str, vocabulary: str) -> None:
    """Embed five lines by a local model, and show how alike each two are."""
    show_alike(spark, OnnxEmbedder.load(spark, model, vocabulary))


def show_alike(spark: SparkSession, embedder: OnnxEmbedder) -> None:
    embedder = embedder.probe()
    print(f"{embedder.dims} dimensions")
    rows = embedder.embed(spark.createDataFrame(list(enumerate(LINES)), "n BIGINT, text STRING"))
    a, b = (rows.select(F.col("n").alias(f"n{k}"), F.col("text").alias(f"text{k}"), F.col("embedding").cast("array<double>").alias(f"v{k}")) for k in "ab")
    pairs = a.join(b, F.col("na") < F.col("nb"))
    pairs.select("texta", "textb", F.round(cosine("va", "vb"), 4).alias("cosine")).orderBy(F.desc("cosine"), "texta", "textb").show(truncate=False)


COMMANDS = {f.__name__: f for f in (demo, embed, persist, onnx)}
ARGUMENTS = {"onnx": 2}


def main(args: list[str]) -> int:
    if not args or args[0] not in COMMANDS or len(args) != 1 + ARGUMENTS.get(args[0], 0):
        print("usage: python -m vexel demo | embed | persist | onnx MODEL VOCABULARY", file=sys.stderr)
        return 1
    spark = SparkSession.builder.appName("vexel").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    COMMANDS[args[0]](spark, *args[1:])
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
