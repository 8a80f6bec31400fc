"""Nearest neighbours of queries that arrive on a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from vexel.operators.store import VectorStore


def search_stream(queries: DataFrame, store: VectorStore, k: int, sink: Callable[[DataFrame, int], None], checkpoint: str, query_id: str = "query_id", query: str = "query") -> StreamingQuery:
    """Answer each micro-batch of a stream of queries; sink gets the answers and the batch's number.

    The number lets a sink write each batch once even if Spark repeats it.
    """
    answer = lambda batch, number: sink(store.search_each(batch, k, query_id, query), number)
    return queries.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
