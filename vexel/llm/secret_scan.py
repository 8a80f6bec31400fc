"""Secret scans over an incremental ledger of blobs.

A *blob* is a distinct content, addressed by the SHA-256 of its UTF-8 bytes; a *version* is
a path that holds or once held it. ``Ledger`` keeps two tables in a folder: which blobs
were scanned under which version of the rules, and what was found. ``scan`` looks only at
pairs of blob and rules version that the ledger hasn't got, each once however many paths
hold the blob, appends to the ledger, and joins the findings back to all paths. All of it
is built-in expressions: no Python touches the texts.

A run writes its batch (scanned and found) under one name and publishes it by a marker
last, so one that dies leaves a batch which nobody reads, and the next scans it again.

Findings: path columns, blob, rule, at (characters before the match, from 0), match, and
rules_version. Rules are Java regular expressions; matches of one rule don't overlap.

Edge cases: null texts are no blob and give nothing; the empty text is a blob without
findings. Repeated rows are repeated versions: each gets the blob's findings. Null ids stay
null. An empty table gives no findings, and no batch. Texts are scanned whole. Only the id
and text columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vexel.llm.tables import free_name, kept, new_folder

#: Patterns of credentials by their published forms. Character classes are ASCII, so other engines agree.
RULES = {
    "aws_access_key": r"(?:AKIA|ASIA)[0-9A-Z]{16}",
    "assigned_secret": r"(?i:password|passwd|pwd|secret|token|api_key|apikey)[ ]?[=:][ ]?[\"']?[A-Za-z0-9+/_\-]{16,}",
    "github_token": r"gh[pousr]_[A-Za-z0-9]{36}",
    "google_api_key": r"AIza[0-9A-Za-z_\-]{35}",
    "private_key": r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----",
    "slack_token": r"xox[abprs]-[0-9A-Za-z\-]{10,}",
    "web_token": r"eyJ[A-Za-z0-9_\-]{10,}\.eyJ[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,}",
}
MASK = "[SECRET]"
_SCANNED = "blob string, rules_version string"
_FOUND = "blob string, rules_version string, rule string, at bigint, match string"


def rules_version(rules: dict[str, str]) -> str:
    return hashlib.sha256(json.dumps(rules, sort_keys=True).encode()).hexdigest()[:16]


class Ledger:
    """Scanned pairs and findings, in batches under a folder."""

    def __init__(self, spark: SparkSession, folder: str | None = None) -> None:
        self.spark, self.folder = spark, folder or new_folder(spark, "ledger")

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def batches(self) -> list[str]:
        fs, at = self._fs(f"{self.folder}/done")
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def _read(self, name: str, schema: str) -> DataFrame:
        paths = [f"{self.folder}/{name}/{b}" for b in self.batches()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def scanned(self) -> DataFrame:
        return self._read("scanned", _SCANNED)

    def found(self) -> DataFrame:
        return self._read("found", _FOUND)

    def append(self, scanned: DataFrame, found: DataFrame) -> None:
        batch = uuid.uuid4().hex
        found.write.parquet(f"{self.folder}/found/{batch}")
        scanned.write.parquet(f"{self.folder}/scanned/{batch}")
        fs, at = self._fs(f"{self.folder}/done/{batch}")
        fs.create(at).close()


def matches(texts: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """blob, rule, at and match in each row of (blob, text, nth); nth is a number from 0."""
    # One pass tells which rows hold anything; only those are searched rule by rule.
    some = texts.where(F.col("text").rlike("|".join(f"(?:{p})" for p in rules.values())) | (F.col("nth") < 0))
    each = F.array(*[F.struct(F.lit(rule).alias("rule"), F.regexp_extract_all("text", F.lit(f"({p})"), 1).alias("hits"), F.split("text", p, -1).alias("gaps")) for rule, p in rules.items()])
    one = some.select("blob", F.explode(each).alias("r")).where(F.size("r.hits") > 0).select("blob", "r.rule", "r.hits", F.transform("r.gaps", lambda x: F.length(x)).alias("gaps"))
    hit = one.select("blob", "rule", F.posexplode("hits").alias("k", "match"), "hits", "gaps")
    before = F.expr("aggregate(slice(gaps, 1, k + 1), 0L, (s, x) -> s + x) + aggregate(slice(hits, 1, k), 0L, (s, x) -> s + length(x))")
    return hit.select("blob", "rule", before.alias("at"), "match")


def scan(docs: DataFrame, ledger: Ledger, id_col: str = "doc_id", text_col: str = "text", rules: dict[str, str] = RULES) -> DataFrame:
    """Findings of every version in docs; the ledger has all their blobs afterwards."""
    version = rules_version(rules)
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    versions = kept(texts.select("doc_id", F.sha2("text", 256).alias("blob")), "versions")
    seen = ledger.scanned().where(F.col("rules_version") == version).select("blob")
    # A blob is read where it stands under its least id; rows of equal id and blob are one by the last distinct.
    fresh = kept(versions.groupBy("blob").agg(F.min("doc_id").alias("doc_id")).join(seen, "blob", "left_anti"), "unseen")
    here = fresh.select(F.col("doc_id").alias("__doc")).distinct()
    rest = versions.select(F.col("doc_id").alias("__doc")).distinct().join(here.withColumnRenamed("__doc", "__here"), F.col("__doc").eqNullSafe(F.col("__here")), "left_anti")
    # Documents are picked by the shorter of two lists that say the same, so that a short one can be broadcast.
    few = here.count() <= rest.count()
    due = texts.join(here if few else rest, F.col("doc_id").eqNullSafe(F.col("__doc")), "left_semi" if few else "left_anti")
    # Numbering keeps the optimiser from searching texts before the join has dropped those seen.
    due = due.select(F.sha2("text", 256).alias("blob"), "text", F.monotonically_increasing_id().alias("nth"))
    known = fresh.select("blob", F.lit(version).alias("rules_version"))
    found = matches(due, rules).distinct().select("blob", F.lit(version).alias("rules_version"), "rule", F.col("at"), "match")
    ledger.append(known, found)
    mine = ledger.found().where(F.col("rules_version") == version).distinct()
    return versions.join(mine, "blob").select("doc_id", "blob", "rule", "at", "match", "rules_version")


def mask(docs: DataFrame, ledger: Ledger, id_col: str = "doc_id", text_col: str = "text", rules: dict[str, str] = RULES) -> DataFrame:
    """docs with every finding replaced by MASK; rows and columns stay as they are.

    The ledger tells which documents have findings, so others aren't searched again.
    """
    mark = free_name(docs.columns, "hit")
    hit = scan(docs, ledger, id_col, text_col, rules).select(F.col("doc_id").alias(mark)).distinct()
    text = reduce(lambda c, p: F.regexp_replace(c, p, MASK.replace("[", "\\[").replace("]", "\\]")), rules.values(), F.col(text_col))
    marked = docs.join(hit, docs[id_col].cast("bigint").eqNullSafe(hit[mark]), "left")
    out = [F.when(F.col(mark).isNotNull() | F.col(id_col).isNull(), text).otherwise(F.col(text_col)).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    return marked.select(*out)


def oracle(rules: dict[str, str] = RULES) -> str:
    """DuckDB SQL for the findings of a first scan of documents."""
    lists = " union all ".join(
        f"""select doc_id, sha256(text) blob, '{rule}' rule, regexp_extract_all(text, {(q := "'" + p.replace("'", "''") + "'")}) hits, list_transform(string_split_regex(text, {q}), lambda x: length(x)) gaps from documents where text is not null"""
        for rule, p in rules.items()
    )
    return f"""with found as ({lists}),
each as (select doc_id, blob, rule, hits, gaps, unnest(range(1, len(hits) + 1)) k from found where len(hits) > 0)
select doc_id, blob, rule, cast(list_sum(gaps[1:k]) + coalesce(list_sum(list_transform(hits[1:k - 1], lambda x: length(x))), 0) as bigint) "at", hits[k] as "match", '{rules_version(rules)}' rules_version from each"""
