"""Token ids as binary shards that are read document by document.

Every document is one independent zstandard frame of little-endian ids (two bytes each
where the vocabulary has at most 65,536, else four), with the frame's own content checksum.
A shard ends with a skippable frame of its doc_ids and a seek table in the public seekable
layout: for each frame its two sizes and 32 bits of the content's XXH64, then the number of
frames. Readers fetch the table, then only the frames they want, and check each.

``write`` makes one shard of each partition and returns the index: doc_id, shard, frame,
position, size, n_tokens, checksum. Tasks write under names of their own attempts, so a
task that runs twice leaves a file which the index doesn't name. ``read`` returns doc_id
and ids for rows of an index.

Edge cases: null ids are written as no ids, and both read back as an empty list; a null
doc_id stays null in the index and is stored as the least 64-bit number. Repeated rows and
ids make a frame each. An empty table gives an empty index and no shards. A negative id,
or one too large for the width, raises ValueError. A damaged frame raises ValueError on
reading. Only the two columns named are read, so other columns cannot clash.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vexel.llm.bpe import DEFAULT_VOCABULARY
from vexel.llm.bpe_codec import encoder
from vexel.llm.tables import kept, new_folder

LEVEL = 3
_SKIP, _TABLE, _SEEKABLE = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
_NULL_ID = -(1 << 63)
INDEX = "doc_id bigint, shard string, frame bigint, position bigint, size bigint, n_tokens bigint, checksum bigint"


class ShardWriter:
    def __init__(self, sink, width: int) -> None:
        self.sink, self.width = sink, width
        self.zstd = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True)
        self.ids: list[int] = []
        self.table: list[tuple[int, int, int]] = []
        self.position = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> tuple[int, int, int, int, int]:
        """Frame number, position, size, tokens and checksum."""
        if len(ids) and (ids.min() < 0 or int(ids.max()) >> (8 * self.width)):
            raise ValueError(f"an id doesn't fit {self.width} bytes")
        raw = ids.astype(f"<u{self.width}").tobytes()
        frame = self.zstd.compress(raw)
        check = xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF
        self.sink.write(frame)
        self.ids.append(_NULL_ID if doc_id is None else doc_id)
        self.table.append((len(frame), len(raw), check))
        at, self.position = self.position, self.position + len(frame)
        return len(self.table) - 1, at, len(frame), len(ids), check

    def close(self) -> None:
        ids = np.array(self.ids, "<i8").tobytes()
        self.sink.write(struct.pack("<II", _SKIP, len(ids)) + ids)
        table = np.array(self.table, "<u4").tobytes() + struct.pack("<IBI", len(self.table), 0x80, _SEEKABLE)
        self.sink.write(struct.pack("<II", _TABLE, len(table)) + table)
        self.sink.close()


class ShardReader:
    def __init__(self, file, size: int, width: int) -> None:
        self.file, self.width = file, width
        frames, _, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != _SEEKABLE:
            raise ValueError("no seek table at the end")
        entries = np.frombuffer(self._at(size - 9 - 12 * frames, 12 * frames), "<u4").reshape(-1, 3).astype(np.int64)
        self.sizes, self.raw, self.checks = entries.T if frames else np.zeros((3, 0), np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self._ids_at = int(self.sizes.sum()) + 8

    def _at(self, position: int, size: int) -> bytes:
        self.file.seek(position)
        return self.file.read(size)

    def doc_ids(self) -> np.ndarray:
        return np.frombuffer(self._at(self._ids_at, 8 * len(self.sizes)), "<i8")

    def frame(self, k: int) -> np.ndarray:
        data = self._at(int(self.starts[k]), int(self.sizes[k]))
        try:
            raw = zstandard.ZstdDecompressor().decompress(data, max_output_size=int(self.raw[k]))
        except zstandard.ZstdError as e:
            raise ValueError(f"frame {k} is damaged: {e}") from None
        if len(raw) != self.raw[k] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.checks[k]:
            raise ValueError(f"frame {k} doesn't match its checksum")
        return np.frombuffer(raw, f"<u{self.width}")


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[int | None, np.ndarray]]:
    lists = batch.column(1)
    count = lists.value_lengths().fill_null(0).to_numpy()
    ends = np.cumsum(count)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    yield from zip(batch.column(0).to_pylist(), (flat[b - n : b] for b, n in zip(ends, count)))


def _write(rows_of, folder: str, width: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = FileSystem.from_uri(folder)
        name = f"shard-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.zst"
        writer = None
        for batch in batches:
            for rows in rows_of(batch):
                out = []
                for doc_id, ids in rows:
                    if writer is None:
                        fs.create_dir(root, recursive=True)
                        writer = ShardWriter(fs.open_output_stream(f"{root}/{name}", compression=None), width)
                    out.append((doc_id, name, *writer.add(doc_id, ids)))
                if out:
                    kinds = [pa.int64(), pa.string(), *[pa.int64()] * 5]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["doc_id", "shard", "frame", "position", "size", "n_tokens", "checksum"])
        if writer is not None:
            writer.close()

    return run


def write(tokens: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary_size: int = 50257, folder: str | None = None) -> tuple[DataFrame, str]:
    """Shards of lists of ids; the index and the folder."""
    folder = folder or new_folder(tokens.sparkSession, "shards")
    pairs = tokens.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(ids_col).cast("array<bigint>").alias("ids"))
    return kept(pairs.mapInArrow(_write(lambda batch: [_rows(batch)], folder, width(vocabulary_size)), INDEX), "shard-index"), folder


def width(vocabulary_size: int) -> int:
    return 2 if vocabulary_size <= 1 << 16 else 4


def write_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary_path: str = DEFAULT_VOCABULARY, lexicon: str | None = None, vocabulary_size: int = 50257, folder: str | None = None) -> tuple[DataFrame, str]:
    """Like write, of texts: workers encode and write in one pass, so ids never travel."""
    folder = folder or new_folder(docs.sparkSession, "shards")
    work = encoder(vocabulary_path, lexicon)

    def rows_of(batch: pa.RecordBatch) -> Iterator[Iterator[tuple[int | None, np.ndarray]]]:
        for block, ids, count in work(batch.column(1)):
            ends = np.cumsum(count)
            yield zip(batch.column(0).slice(block.first, block.rows).to_pylist(), (ids[b - n : b] for b, n in zip(ends, count)))

    pairs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return kept(pairs.mapInArrow(_write(rows_of, folder, width(vocabulary_size)), INDEX), "shard-index"), folder


def read(index: DataFrame, folder: str, vocabulary_size: int = 50257) -> DataFrame:
    """doc_id and ids of the index's rows; each shard's table is fetched once by a task, and no other frames."""
    wide = width(vocabulary_size)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = FileSystem.from_uri(folder)
        name, reader = None, None
        for batch in batches:
            out = []
            for shard, frame in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if shard != name:
                    path = f"{root}/{shard}"
                    name, reader = shard, ShardReader(fs.open_input_file(path), fs.get_file_info(path).size, wide)
                out.append(reader.frame(frame))
            if out:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.astype(np.int32) for x in out], pa.list_(pa.int32()))], ["doc_id", "ids"])

    rows = index.select("doc_id", "shard", "frame")
    return rows.repartition("shard").sortWithinPartitions("shard", "frame").mapInArrow(run, "doc_id bigint, ids array<int>")
