"""Tables kept in the shared folder, and what several operators do with tables.

Long plans are cut by writing a table to the folder that the session names in
``spark.checkpoint.dir``, which every executor reaches; a lost executor then costs no more
than the tasks it ran. Where no folder is set, as in tests, one is made under the working
machine's temporary folder and the setting is filled in; on a cluster, whose executors
wouldn't share it, that is an error.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; set only where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """df, written once and read back: its plan begins anew."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Delete tables made by kept() that no later plan reads."""
    for df in tables:
        for file in df.inputFiles()[:1]:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file.rpartition("/")[0])
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def free_name(columns: list[str], name: str) -> str:
    """name, drawn out until no column has it, whatever its case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Union-find over edges as alternating star rounds: (node, root) with the least node as root.

    Each round hangs every neighbour on the least of its neighbourhood, first among the
    greater ones, then among the lesser; rounds end when no edge changes. Every node of an
    edge appears once. Loops and repeated edges change nothing; null ends are dropped.
    """
    e = edges.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).where(f"{a} is not null and {b} is not null").distinct()
    e, seen, old = kept(e, "edges"), None, None
    while True:
        apart = e.where("u <> v")
        both = apart.select("v", "u").union(apart.select(F.col("u").alias("v"), F.col("v").alias("u")))
        # Least neighbours are aggregated before they are shuffled, so a hub costs a row of each task.
        least = both.groupBy("v").agg(F.min("u").alias("m"))
        large = both.where("u > v").join(least, "v").select(F.col("u").alias("v"), F.least("v", "m").alias("u")).distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u")).union(least.select("v", F.col("m").alias("u"))).distinct()
        told = Observation()
        new = kept(small.observe(told, F.count("*").alias("n"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("s")), "edges")
        if old is not None:
            drop(old)
        old = e
        e = new
        if (state := told.get) == seen:
            break
        seen = state
    roots = e.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct()
    return e.select(F.col("v").alias("node"), F.col("u").alias("root")).union(roots)
