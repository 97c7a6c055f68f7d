"""Token ids in Arrow IPC files of equal-length sequences, read back without copying."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import landed, shared_folder, text_bytes
from tracewell.llm.tokens import encoder

LENGTH = 2048
ROWS_PER_BATCH = 256
TYPES = {2: (pa.uint16(), "<u2"), 4: (pa.uint32(), "<u4")}


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder given as a URI or a plain path."""
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


class SequenceWriter:
    """Cuts a stream of ids into rows of ``length`` and writes them in batches; the last row is padded and masked."""

    def __init__(self, folder: str, name: str, width: int, length: int = LENGTH):
        self.store, base = _store(folder)
        self.store.create_dir(base, recursive=True)
        self.path, self.length = f"{base}/{name}", length
        self.kind, self.code = TYPES[width]
        self.row_bytes = length * width
        self.schema = pa.schema({"ids": pa.list_(self.kind, length), "mask": pa.list_(pa.bool_(), length)})
        # another attempt of the same task may write at the same time
        self.own = f"{self.path}.{TaskContext.get().taskAttemptId() if TaskContext.get() else 0}"
        self.sink = self.store.open_output_stream(self.own)
        self.file = pa.ipc.new_file(self.sink, self.schema)
        self.held = bytearray()

    def add(self, ids: bytes) -> None:
        self.held += ids
        while len(self.held) >= (full := self.row_bytes * ROWS_PER_BATCH):
            self._write(bytes(self.held[:full]), full)
            del self.held[:full]

    def _write(self, data: bytes, real: int) -> None:
        width = self.row_bytes // self.length
        ids = pa.Array.from_buffers(self.kind, len(data) // width, [None, pa.py_buffer(data)])
        mask = np.arange(len(data) // width) < real // width
        self.file.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(ids, self.length),
                                               pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length)], schema=self.schema))

    def close(self) -> None:
        if self.held:
            real = len(self.held)
            self._write(bytes(self.held) + bytes(-real % self.row_bytes), real)
        self.file.close()
        self.sink.close()
        self.store.move(self.own, self.path)


class SequenceReader:
    """Random access to the ids and masks of one file; local files are mapped, not read."""

    def __init__(self, folder: str, name: str):
        store, base = _store(folder)
        path = f"{base}/{name}"
        source = pa.memory_map(path) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(path)
        self.file = pa.ipc.open_file(source)
        self.length = self.file.schema.field("ids").type.list_size
        self.at, self.batch = -1, None

    def _values(self, number: int) -> np.ndarray:
        if number != self.at:
            self.at, self.batch = number, self.file.get_batch(number)
        return self.batch.column(0).values.to_numpy(zero_copy_only=True)

    def sequence(self, row: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of one sequence."""
        number, row = divmod(row, ROWS_PER_BATCH)
        ids = self._values(number)[row * self.length:(row + 1) * self.length]
        mask = self.batch.column(1).values.slice(row * self.length, self.length).to_numpy(zero_copy_only=False)
        return ids, mask

    def read(self, start: int, count: int) -> list[np.ndarray]:
        """Views of ``count`` ids from ``start``, one for each batch they lie in."""
        step, found = ROWS_PER_BATCH * self.length, []
        while count > 0:
            number, low = divmod(start, step)
            view = self._values(number)[low:low + count]
            found.append(view)
            start, count = start + len(view), count - len(view)
        return found


def write_sequences(docs: DataFrame, folder: str, tokenizer: str, *, end_id: int = 1, length: int = LENGTH,
                    drops_space: bool = True, partitions: int | None = None) -> DataFrame:
    """Encode whole texts and write their ids, document after document by ascending doc_id, into one file per range of ids.

    Returns (doc_id, file, start, n_tokens): the place of each document inside its file. A null text is empty and gives its
    end id alone; null ids come first; rows with one id follow each other by a hash of the text; an empty table writes no
    file. Memory holds one batch of texts and one batch of sequences.
    """
    spark = docs.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("h"))
    dealt = rows.repartitionByRange(parts, "doc_id", "h").sortWithinPartitions("doc_id", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, writer, start = TaskContext.get().partitionId(), None, 0
        encode = encoder(tokenizer, drops_space)
        end = end_id.to_bytes(encode.width, "little")
        for batch in batches:
            writer = writer or SequenceWriter(folder, f"part-{number:06d}.arrow", encode.width, length)
            counts = []
            for ids in encode.encode(text_bytes(batch.column(1))):
                writer.add(ids + end)
                counts.append(len(ids) // encode.width + 1)
            starts = start + np.cumsum([0, *counts])
            start = int(starts[-1])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([number] * len(counts), pa.int64()), pa.array(starts[:-1], pa.int64()), pa.array(counts, pa.int64())],
                names=["doc_id", "file", "start", "n_tokens"])
        if writer:
            writer.close()

    return landed(dealt.mapInArrow(run, "doc_id long, file long, start long, n_tokens long"), "sequence-index")


def read_digests(index: DataFrame, folder: str, partitions: int | None = None) -> DataFrame:
    """Read every document's ids back from the files: (doc_id, start, n_tokens, ids_crc32), start counted over all files."""
    spark = index.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    bases = index.groupBy("file").agg(F.sum("n_tokens").alias("n")).select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # a file belongs to one task, and no file holds more than one range of ids
    rows = index.join(F.broadcast(bases), "file").repartition(parts, "file").sortWithinPartitions("file", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, reader = -1, None
        for batch in batches:
            crcs = []
            for file, start, count in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "n_tokens"))):
                if file != opened:
                    opened, reader = file, SequenceReader(folder, f"part-{file:06d}.arrow")
                crc = 0
                for view in reader.read(start, count):
                    crc = zlib.crc32(np.ascontiguousarray(view, "<u4"), crc)
                crcs.append(crc)
            start = np.array(batch.column("base")) + np.array(batch.column("start"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(start, pa.int64()), batch.column("n_tokens"), pa.array(crcs, pa.int64())],
                                             names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def sequence_digests(docs: DataFrame, tokenizer: str, *, end_id: int = 1, length: int = LENGTH) -> DataFrame:
    """Write the files into the shared folder and return what they hold of each document."""
    folder = shared_folder(docs.sparkSession, "sequences")
    return read_digests(write_sequences(docs, folder, tokenizer, end_id=end_id, length=length), folder)
