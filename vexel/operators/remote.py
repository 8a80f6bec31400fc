"""What embedders that call out to a model share: texts go through Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

Work = Callable[[list[str]], list[list[float]]]


def embed_table(texts: DataFrame, text_col: str, out_col: str, batch: int, worker: Callable[[], Work]) -> DataFrame:
    """texts with a vector of floats; null texts get null and aren't sent.

    worker() runs once a task and returns what turns a list of texts into vectors. A task
    that runs twice asks twice: write the result before using it more than once.
    """
    schema = T.StructType([*texts.schema.fields, T.StructField(out_col, T.ArrayType(T.FloatType()))])
    at = texts.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for rows in batches:
            work = work or worker()
            values = rows.column(at).to_pylist()
            some = [k for k, t in enumerate(values) if t is not None]
            out: list[list[float] | None] = [None] * len(values)
            for a in range(0, len(some), batch):
                part = some[a : a + batch]
                for k, vector in zip(part, work([values[k] for k in part])):
                    out[k] = vector
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(out, pa.list_(pa.float32()))], [*rows.schema.names, out_col])

    return texts.mapInArrow(run, schema)
