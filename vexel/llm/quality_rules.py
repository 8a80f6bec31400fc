"""Quality rules by repetition coverage.

For each document, rolling hashes over its words tell which n-grams occur more than once;
the rules bound how much of the document's characters lie in them, in one n-gram alone, or
in lines seen before. n runs upwards and only places whose shorter n-gram repeats are
hashed again, for an n-gram can repeat only where both of its (n-1)-grams do.

Measures (all are shares of characters, or of lines, 0 where there is nothing to share):

* ``dup_line_frac``, ``dup_line_char_frac``: non-empty lines equal to an earlier line.
* ``top_2`` .. ``top_4``: the largest count x length over n-grams that repeat, at most 1.
* ``dup_5`` .. ``dup_10``: words inside any n-gram that repeats, each word once.

Edge cases: a null or empty text, or one of white space only, has no words; all its
measures are 0 and it is rejected. Rows are judged one by one, so repeated rows and ties
each get the same answer; an empty table gives an empty result. Only the id and text
columns are read by ``measure``; ``keep_good`` hands the caller's columns through as they
are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vexel.llm.blocks import Block, blocks, chars_before, groups, span_hash, words

TOP, DUP = (2, 3, 4), (5, 6, 7, 8, 9, 10)
#: The highest admissible shares; published with the MassiveText corpus.
LIMITS = {
    "dup_line_frac": 0.30, "dup_line_char_frac": 0.20, "top_2": 0.20, "top_3": 0.18, "top_4": 0.16,
    "dup_5": 0.15, "dup_6": 0.14, "dup_7": 0.13, "dup_8": 0.12, "dup_9": 0.11, "dup_10": 0.10,
}
MEASURES = ["n_words", *LIMITS]
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)


def _lines(block: Block, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = block.data
    breaks = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate((block.offsets[:-1], breaks + 1)))
    starts = starts[starts < len(data)]
    ends = np.minimum(np.append(starts[1:], len(data)), np.append(breaks, len(data))[np.searchsorted(breaks, starts)])
    starts, ends = starts[ends > starts], ends[ends > starts]
    row = np.searchsorted(block.offsets, starts, "right") - 1
    size = chars[ends] - chars[starts]
    keys = span_hash(data, starts, ends) + row.astype(np.uint64) * _STEP
    order, at = groups(keys)
    again = np.ones(len(keys), bool)
    again[order[at[:-1]]] = False
    share = []
    for weight in (np.ones(len(keys)), size):
        whole = np.bincount(row, weight, block.rows)
        share.append(np.divide(np.bincount(row[again], weight[again], block.rows), whole, out=np.zeros(block.rows), where=whole > 0))
    return share[0], share[1]


def measure_block(block: Block) -> dict[str, np.ndarray]:
    """The measures of a block's rows."""
    w, chars = words(block), chars_before(block.data)
    size = (chars[w.ends] - chars[w.starts]).astype(np.float64)
    upto = np.concatenate(([0.0], np.cumsum(size)))
    whole = upto[w.first[1:]] - upto[w.first[:-1]]
    out = {"n_words": np.diff(w.first)}
    out["dup_line_frac"], out["dup_line_char_frac"] = _lines(block, chars)
    at = np.arange(len(w.row))
    rolled = w.hash + w.row.astype(np.uint64) * _STEP
    last = w.first[1:][w.row] if len(w.row) else w.row
    for n in range(2, max(DUP) + 1):
        go = at + n <= last[at]
        at, rolled = at[go], rolled[go]
        rolled = rolled * np.uint64(0x9FB21C651E98DF25) + w.hash[at + n - 1]
        order, runs = groups(rolled)
        count = np.diff(runs)
        if n in TOP:
            share = np.zeros(block.rows)
            head = order[runs[:-1][count > 1]]
            np.maximum.at(share, w.row[at[head]], count[count > 1] * (upto[at[head] + n] - upto[at[head]]))
            out[f"top_{n}"] = np.minimum(1, np.divide(share, whole, out=np.zeros(block.rows), where=whole > 0))
        again = np.zeros(len(at), bool)
        again[order] = np.repeat(count > 1, count)
        at, rolled = at[again], rolled[again]
        if n in DUP:
            edge = np.zeros(len(w.row) + 1, np.int64)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + n, -1)
            covered = np.cumsum(edge[:-1]) > 0
            out[f"dup_{n}"] = np.divide(np.bincount(w.row[covered], size[covered], block.rows), whole, out=np.zeros(block.rows), where=whole > 0)
    return out


def good(measures: dict[str, np.ndarray], limits: dict[str, float] = LIMITS) -> np.ndarray:
    keep = measures["n_words"] > 0
    for name, limit in limits.items():
        keep = keep & (measures[name] <= limit)
    return keep


def _measured(column: pa.Array) -> dict[str, np.ndarray]:
    parts = [measure_block(b) for b in blocks(column)]
    return {m: np.concatenate([p[m] for p in parts]) if parts else np.zeros(0) for m in MEASURES}


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: dict[str, float] = LIMITS) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, the measures, and whether it passes."""
    schema = "doc_id bigint, n_words bigint, " + ", ".join(f"{m} double" for m in LIMITS) + ", keep boolean"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                m = _measured(batch.column(1))
                columns = [batch.column(0), pa.array(m["n_words"], pa.int64()), *(pa.array(m[x], pa.float64()) for x in LIMITS)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(good(m, limits))], ["doc_id", *MEASURES, "keep"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def keep_good(docs: DataFrame, text_col: str = "text", limits: dict[str, float] = LIMITS) -> DataFrame:
    """The rows of docs that pass, with all their columns; no shuffle."""
    at = docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(good(_measured(batch.column(at)), limits)))

    return docs.mapInArrow(run, docs.schema)
