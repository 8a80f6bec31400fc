"""Queries over this subpackage's operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vexel.llm import ann, bpe_codec, classifier, near_dedup, packing, quality_rules, secret_scan, substring_dedup, token_counts, token_shards

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queries are the rows whose id is divisible by 100; they are searched for among all rows."""
    return ann.nearest(_table(spark, sf_dir, "embeddings"), which=F.col("vec_id") % 100 == 0)


def op2_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, _ = token_shards.write_texts(_table(spark, sf_dir, "documents"))
    return index


def op3_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    lexicon = bpe_codec.publish(spark, bpe_codec.compile_words(bpe_codec.frequent(docs)))
    return bpe_codec.decode(bpe_codec.encode(docs, lexicon=lexicon))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.group(_table(spark, sf_dir, "documents"), exact=True)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(token_counts.count(_table(spark, sf_dir, "documents")))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.spans(_table(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return classifier.score(docs, classifier.fit(docs, _table(spark, sf_dir, "labels"), {"quality": 1, "toxic": 0}))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.measure(_table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(_table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_table(spark, sf_dir, "documents"), secret_scan.Ledger(spark))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_nearest_neighbours, op2_token_shards, op3_bpe_codec, op4_near_dedup, op5_packing, op6_substring_dedup, op7_quality_classifier, op8_quality_rules, op9_token_counts, op10_secret_scan)}


def oracle_sql() -> dict[str, str]:
    return {"op10_secret_scan": secret_scan.oracle()}
