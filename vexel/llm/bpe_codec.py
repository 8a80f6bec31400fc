"""Byte-pair encoding and decoding with a transducer lexicon.

``frequent`` counts the words of the whole corpus and takes the most frequent; ``compile``
makes a minimal acyclic transducer of them, with their exact ids as outputs, and hands it
to every executor as a file, which workers map into memory. ``encode`` looks words up in it
and merges all others exactly, pair by pair in order of rank, so the lexicon's size changes
the time and never the ids. ``decode`` joins the ids' bytes.

Edge cases: a null text has null ids and a null id list decodes to null; an empty text has
no ids. Strings of special tokens are ordinary text. Decoding ids that break a character
gives U+FFFD there; an id outside the vocabulary raises ValueError. Rows are encoded one by
one, so repeated rows and ties change nothing (equally frequent words enter the lexicon
together); an empty table gives an empty result and an empty lexicon. Texts
of any length are encoded whole. Only the id and text columns are read, so other columns
cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vexel.llm.blocks import Block, blocks, distinct, spread
from vexel.llm.bpe import DEFAULT_VOCABULARY, Vocabulary, merge, pretokens, vocabulary
from vexel.llm.lexicon import Lexicon, opened
from vexel.llm.tables import kept, new_folder

#: Words compiled into the lexicon: a matter of speed and of the file's size (about 25 MB).
LEXICON_WORDS = 1 << 15
BLOCK = 1 << 20


def _counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in blocks(batch.column(0), BLOCK):
            w = pretokens(block)
            spot, which = distinct(block.data, w.starts, w.ends - w.starts, w.hash)
            count = np.bincount(which, minlength=len(spot))
            lengths = w.ends[spot] - w.starts[spot]
            flat = block.data[np.repeat(w.starts[spot], lengths) + spread(lengths)]
            offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
            word = pa.Array.from_buffers(pa.binary(), len(spot), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
            yield pa.RecordBatch.from_arrays([word, pa.array(count)], ["word", "n"])


def counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """word (bytes) and n over all documents."""
    return docs.select(F.col(text_col).alias("text")).mapInArrow(_counts, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(docs: DataFrame, text_col: str = "text", size: int = LEXICON_WORDS) -> list[bytes]:
    """The most frequent words, in the order of their bytes; the driver gets no more than size of them.

    Equally frequent words enter together or not at all, so there can be fewer than size.
    """
    table = kept(counts(docs, text_col), "words")
    least, total = None, 0
    for n, words in sorted(map(tuple, table.groupBy("n").count().collect()), reverse=True):  # at most about sqrt(2 x words) rows
        total += words
        if total > size:
            break
        least = n
    return sorted(bytes(r.word) for r in table.where(F.col("n") >= least).select("word").collect()) if least else []


def compile_words(words: list[bytes], vocabulary_path: str = DEFAULT_VOCABULARY) -> Lexicon:
    lengths = np.array([len(w) for w in words], np.int64)
    ids, n = merge(vocabulary(vocabulary_path), np.frombuffer(b"".join(words), np.uint8), np.cumsum(lengths) - lengths, lengths)
    return Lexicon.build(words, [part.tolist() for part in np.split(ids, np.cumsum(n)[:-1])] if len(words) else [])


def publish(spark: SparkSession, lexicon: Lexicon) -> str:
    """Write the lexicon to the shared folder; executors fetch it from there. Returns its name."""
    path = new_folder(spark, "lexicon")
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
    out.write(bytearray(lexicon.save()))
    out.close()
    spark.sparkContext.addFile(path)
    return path.rpartition("/")[2]


def encode_block(v: Vocabulary, lexicon: Lexicon | None, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the block's rows, and how many each row has."""
    w = pretokens(block)
    spot, which = distinct(block.data, w.starts, w.ends - w.starts, w.hash)
    starts, lengths = w.starts[spot], w.ends[spot] - w.starts[spot]
    number = lexicon.find(block.data, starts, lengths) if lexicon is not None else np.full(len(spot), -1)
    known = number >= 0
    count = np.zeros(len(spot), np.int64)
    fresh, count[~known] = merge(v, block.data, starts[~known], lengths[~known])
    where = np.zeros(len(spot), np.int64)
    where[~known] = np.cumsum(count[~known]) - count[~known]
    pool = fresh
    if known.any():
        count[known] = lexicon.offsets[number[known] + 1] - lexicon.offsets[number[known]]
        where[known] = lexicon.offsets[number[known]] + len(fresh)
        pool = np.concatenate((fresh, lexicon.ids))
    each = count[which]
    ids = pool[np.repeat(where[which], each) + spread(each)]
    upto = np.concatenate(([0], np.cumsum(each)))
    return ids, upto[w.first[1:]] - upto[w.first[:-1]]


def encoder(vocabulary_path: str, lexicon: str | None) -> Callable[[pa.Array], Iterator[tuple[Block, np.ndarray, np.ndarray]]]:
    """What a worker runs over a column of texts: blocks with ids and counts."""

    def run(column: pa.Array) -> Iterator[tuple[Block, np.ndarray, np.ndarray]]:
        v = vocabulary(vocabulary_path)
        lex = opened(SparkFiles.get(lexicon)) if lexicon else None
        for block in blocks(column, BLOCK):
            yield block, *encode_block(v, lex, block)

    return run


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary_path: str = DEFAULT_VOCABULARY, lexicon: str | None = None) -> DataFrame:
    """doc_id and ids of each row of docs; lexicon: a name from publish()."""
    work = encoder(vocabulary_path, lexicon)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            valid = batch.column(1).is_valid()
            for block, ids, count in work(batch.column(1)):
                offsets = pa.array(np.concatenate(([0], np.cumsum(count))).astype(np.int32))
                mask = pa.array(~valid.slice(block.first, block.rows).to_numpy(zero_copy_only=False))
                lists = pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32)), mask=mask)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, block.rows), lists], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary_path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """doc_id, ids and the text that the ids stand for."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(vocabulary_path)
        for batch in batches:
            lists = batch.column(1)
            count = lists.value_lengths().fill_null(0).to_numpy()
            step = max(1, len(count) // (1 + int(count.sum()) // BLOCK))
            for a in range(0, len(count), step):
                part = lists.slice(a, step)
                ids = part.flatten().to_numpy(zero_copy_only=False)
                if len(ids) and (ids.min() < 0 or ids.max() >= v.size):
                    raise ValueError("an id is outside the vocabulary")
                upto = np.concatenate(([0], np.cumsum(v.lengths[ids])))
                ends = np.concatenate(([0], np.cumsum(count[a : a + step])))
                data = v.decode(ids)
                offsets = upto[ends]
                try:
                    data.decode("utf-8")
                    text = pa.Array.from_buffers(pa.large_string(), len(part), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)]).cast(pa.string())
                except UnicodeDecodeError:
                    text = pa.array([data[x:y].decode("utf-8", "replace") for x, y in zip(offsets[:-1], offsets[1:])], pa.string())
                if part.null_count:
                    text = pa.array([t if ok else None for t, ok in zip(text.to_pylist(), part.is_valid().to_pylist())], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, step), part, text], ["doc_id", "ids", "text"])

    return encoded.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id bigint, ids array<int>, text string")
