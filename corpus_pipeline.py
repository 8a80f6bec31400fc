"""The corpus pipeline: stages over documents, each kept as Parquet for the next.

quality_rules drops documents whose rules fail; near_dedup keeps one document of each
group; substring_dedup cuts passages that stand earlier in the corpus; secret_scan masks
credentials; packing assigns every piece of every document to a training sequence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vexel.llm import near_dedup, packing, quality_rules, secret_scan, substring_dedup, token_counts
from vexel.llm.tables import kept

#: The rules' rolling hashes, signatures, symbols and the packing program have no SQL form; the tests hold them to brute force.
ORACLE_SQL = None


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs, exact=True)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = substring_dedup.remove(docs, substring_dedup.spans(docs))
    return cut.withColumn("n_chars", F.length("text").cast("bigint"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = secret_scan.mask(docs, secret_scan.Ledger(spark))
    return masked.withColumn("n_chars", F.length("text").cast("bigint"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(token_counts.count(docs))


STAGES = [("quality_rules", rules), ("near_dedup", near), ("substring_dedup", substrings), ("secret_scan", secrets), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
