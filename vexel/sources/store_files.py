"""Stores on disk: Parquet with the metric in a column's metadata, and the JSON interchange form."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vexel.functions.metric import Metric

#: Letters that the driver gathers before it writes them.
WRITTEN = 1 << 20


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _replace(spark: SparkSession, staged: str, path: str) -> None:
    fs, old = _path(spark, path)
    _, new = _path(spark, staged)
    fs.delete(old, True)
    if not fs.rename(new, old):
        raise OSError(f"{staged} can't be moved to {path}")


def save_parquet(rows: DataFrame, metric: Metric, path: str) -> None:
    """Written beside the target first, so a store may be saved to where it was loaded from."""
    spark, path = rows.sparkSession, path.rstrip("/")
    seq = F.col("seq").alias("seq", metadata={"metric": int(metric)})
    rows.select(seq, "id", "vector").write.mode("overwrite").parquet(path + ".staged")
    _replace(spark, path + ".staged", path)


def load_parquet(spark: SparkSession, path: str) -> tuple[DataFrame, Metric]:
    rows = spark.read.parquet(path)
    spot = rows.schema["seq"].metadata
    if "metric" not in spot:
        raise ValueError(f"{path} isn't a saved store: it names no metric")
    return rows, Metric(spot["metric"])


def save_json(rows: DataFrame, metric: Metric, path: str) -> None:
    """One object in one file, with a line for each vector and id. The driver writes it from lines that stream through, a partition at a time."""
    fs, at = _path(rows.sparkSession, path)
    staged = at.suffix(".staged")
    out = fs.create(staged, True)
    ordered = rows.orderBy("seq")

    def part(name: str, column: str) -> None:
        first, lines, size = True, [f'  "{name}": ['], 0
        for r in ordered.select("seq", column).toLocalIterator():
            cell = [float(x) for x in r[1]] if column == "vector" else r[1]
            if column == "vector" and any(not math.isfinite(x) for x in cell):
                raise ValueError("NaN and infinity have no JSON form")
            lines.append(("" if first else ",") + "\n    " + json.dumps(cell))
            first, size = False, size + len(lines[-1])
            if size > WRITTEN:
                out.write(bytearray("".join(lines).encode()))
                lines, size = [], 0
        out.write(bytearray(("".join(lines) + ("" if first else "\n  ") + "],\n").encode()))

    try:
        out.write(bytearray(b"{\n"))
        part("Vectors", "vector")
        part("IDs", "id")
        out.write(bytearray(f'  "Metric": {int(metric)}\n}}'.encode()))
    except BaseException:
        out.close()
        fs.delete(staged, False)
        raise
    out.close()
    fs.delete(at, False)
    if not fs.rename(staged, at):
        raise OSError(f"{staged} can't be moved to {path}")


def _load_lines(spark: SparkSession, path: str) -> tuple[DataFrame, Metric] | None:
    """A file as save_json lays it out, by as many tasks as it has splits; None for any other layout.

    Lines are numbered by the splits' sizes, which the driver adds up, and the places within.
    """
    block = F.col("_metadata.file_block_start").alias("block")
    lines = spark.read.text(path).select(F.col("value"), block, F.monotonically_increasing_id().alias("n"))
    mark = F.col("value").isin("{", '  "Vectors": [', '  "Vectors": [],', '  "IDs": [', '  "IDs": [],', "  ],", "}") | F.col("value").startswith('  "Metric": ')
    blocks = lines.groupBy("block").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.count("*").alias("size"), F.count_if(mark).alias("marks"), F.count_if(~mark & ~F.col("value").rlike(r'^    (\[.*\]|".*"|null),?$')).alias("others")).orderBy("block").collect()
    if not blocks or sum(b.marks for b in blocks) > 8 or any(b.others or b.high - b.low + 1 != b.size for b in blocks):
        return None
    starts, at = [], 0
    for b in blocks:
        starts.append((b.block, at - b.low))
        at += b.size
    shifts = F.broadcast(spark.createDataFrame(starts, "block BIGINT, shift BIGINT"))
    placed = lines.join(shifts, "block").select((F.col("n") + F.col("shift")).alias("line"), "value")
    marks = {r.value: r.line for r in placed.where(mark).collect()}
    metric = next((int(v.removeprefix('  "Metric": ')) for v in marks if v.startswith('  "Metric": ') and v[12:].isdigit()), None)
    if metric is None or sum(v.startswith('  "Vectors": [') for v in marks) != 1 or sum(v.startswith('  "IDs": [') for v in marks) != 1:
        return None
    head, ids = next(n for v, n in marks.items() if v.startswith('  "Vectors"')), next(n for v, n in marks.items() if v.startswith('  "IDs"'))
    end, tail = marks.get("}"), next(n for v, n in marks.items() if v.startswith('  "Metric"'))
    n, m = max(ids - head - 2, 0), max(tail - ids - 2, 0)
    if (marks.get("{"), head, end) != (0, 1, at - 1) or tail != at - 2:
        return None
    if n != m:
        raise ValueError(f"{path} has {n} vectors and {m} ids")
    own = lambda first, kind, to: placed.where(F.col("line").between(first + 1, first + n)).select((F.col("line") - (first + 1)).alias("seq"), F.from_json(F.concat(F.lit('{"x":'), F.regexp_replace("value", ",$", ""), F.lit("}")), f"x {kind}", {"mode": "FAILFAST"})["x"].alias(to))
    return own(head, "ARRAY<FLOAT>", "vector").join(own(ids, "STRING", "id"), "seq").select("seq", "id", "vector"), Metric(metric)


def load_json(spark: SparkSession, path: str) -> tuple[DataFrame, Metric]:
    """A store's object; the layout of save_json is read by many tasks, any other by one."""
    if (lined := _load_lines(spark, path)) is not None:
        return lined
    whole = spark.read.schema("Vectors ARRAY<ARRAY<FLOAT>>, IDs ARRAY<STRING>, Metric INT").json(path, multiLine=True, mode="FAILFAST")
    head = whole.select("Metric", F.coalesce(F.size("Vectors"), F.lit(0)).alias("n"), F.coalesce(F.size("IDs"), F.lit(0)).alias("m")).first()
    if head is None or head.n != head.m:
        raise ValueError(f"{path} has {head.n if head else 'no'} vectors and {head.m if head else 'no'} ids")
    rows = whole.select(F.posexplode(F.arrays_zip("IDs", "Vectors")).alias("seq", "x")).select(F.col("seq").cast("bigint").alias("seq"), F.col("x.IDs").alias("id"), F.col("x.Vectors").alias("vector"))
    return rows, Metric(head.Metric)
