"""Token ids in Arrow files of equal-length sequences with masks (operator 7)."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from tokenizers import Tokenizer

from feedledger.llm.units import tokenizer_cache
from feedledger.llm.worker import kept, ship
from feedledger.session import shared_dir, stage

ship(__name__)

SEQUENCE = 1024
ROWS_PER_BATCH = 256


def open_folder(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system a folder is in and its path there."""
    parts = urlsplit(uri)
    if parts.scheme in ("", "file"):
        return pa.fs.LocalFileSystem(), unquote(parts.path) if parts.scheme else uri
    return pa.fs.FileSystem.from_uri(uri)


def file_name(part: int) -> str:
    return f"part-{part:06d}.arrow"


class SequenceWriter:
    """Writes a stream of ids as record batches of ``ROWS_PER_BATCH`` sequences.

    The columns ``ids`` (unsigned, 16 bits where the vocabulary allows, else 32) and ``mask``
    (true for an id, false for padding, a bit each) are fixed-size lists, so position ``p`` of the stream lies in batch ``p // (rows * length)`` at
    a place found by arithmetic. Only the last sequence of a file is padded. A file appears
    under its own name when it is complete, so a lost or repeated attempt leaves no half file.
    """

    def __init__(self, folder: str, part: int, length: int, narrow: bool):
        self.fs, path = open_folder(folder)
        self.path, self.length = f"{path}/{file_name(part)}", length
        self.draft = f"{path}/.{file_name(part)}.{uuid.uuid4().hex}"
        self.schema = pa.schema([("ids", pa.list_(pa.uint16() if narrow else pa.uint32(), length)), ("mask", pa.list_(pa.bool_(), length))])
        self.kind = np.dtype("<u2" if narrow else "<u4")
        self.fs.create_dir(path, recursive=True)
        self.out = self.fs.open_output_stream(self.draft)
        self.file = pa.ipc.new_file(self.out, self.schema)
        self.waiting = bytearray()

    def add(self, ids: bytes) -> None:
        self.waiting += np.frombuffer(ids, "<u4").astype(self.kind).tobytes()
        size = self.kind.itemsize * self.length * ROWS_PER_BATCH
        whole = len(self.waiting) // size * size
        for at in range(0, whole, size):
            self._batch(bytes(self.waiting[at:at + size]), self.length * ROWS_PER_BATCH)
        del self.waiting[:whole]

    def _batch(self, raw: bytes, used: int) -> None:
        ids = np.frombuffer(raw, self.kind)
        mask = np.arange(len(ids)) < used
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(values), self.length) for values in (ids, mask)]
        self.file.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> None:
        used = len(self.waiting) // self.kind.itemsize
        if used:
            self._batch(bytes(self.waiting) + bytes(self.kind.itemsize * (-used % self.length)), used)
        self.file.close()
        self.out.close()
        self.fs.move(self.draft, self.path)


class SequenceReader:
    """Opens one file; ``slices`` yields views of a range of its ids without copying them."""

    def __init__(self, folder: str, part: int):
        fs, path = open_folder(folder)
        path = f"{path}/{file_name(part)}"
        local = isinstance(fs, pa.fs.LocalFileSystem)
        self.file = pa.ipc.open_file(pa.memory_map(path) if local else fs.open_input_file(path))
        self.length = self.file.schema.field("ids").type.list_size
        self.per_batch = self.length * ROWS_PER_BATCH
        self.at, self.ids = -1, None

    def stream(self, number: int) -> np.ndarray:
        """The ids of one batch, end to end, as they lie in the file."""
        if number != self.at:
            self.at, self.ids = number, self.file.get_batch(number).column("ids").flatten().to_numpy()
        return self.ids

    def slices(self, start: int, count: int) -> Iterator[np.ndarray]:
        while count:
            number, inside = divmod(start, self.per_batch)
            view = self.stream(number)[inside:inside + count]
            yield view
            start += len(view)
            count -= len(view)


def write_sequences(docs: DataFrame, folder: str, tokenizer_path: str, length: int = SEQUENCE, end_id: int = 0,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the ids of all texts in ascending id order; returns where each row's ids are.

    One row per row of ``docs``: ``part`` (file), id, ``start`` in that file, ``n_tokens`` with
    the end id. Each file holds one range of ids; a null id sorts first, equal ids sort by
    text. Null and empty texts hold the end id alone; an empty table writes no file.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, end, writer, start = tokenizer_cache(tokenizer_path), int(end_id).to_bytes(4, "little"), None, 0
        narrow = kept(("vocabulary", tokenizer_path), lambda: Tokenizer.from_file(tokenizer_path).get_vocab_size()) <= 1 << 16
        part = TaskContext.get().partitionId()
        for batch in batches:
            if writer is None and batch.num_rows:
                writer = SequenceWriter(folder, part, length, narrow)
            starts, counts = [], []
            for encoded in cache.many(v.as_py() for v in batch.column(1)):
                raw = encoded + end
                writer.add(raw)
                starts.append(start)
                counts.append(len(raw) // 4)
                start += counts[-1]
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * batch.num_rows, pa.int32()), batch.column(0), pa.array(starts, pa.int64()), pa.array(counts, pa.int64())],
                names=["part", id_col, "start", "n_tokens"])
        if writer is not None:
            writer.close()

    texts = docs.select(id_col, text_col)
    kind = texts.schema[id_col].dataType.simpleString()
    # The width of the range sort is fixed, so that a file's number is its place in the order.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = texts.repartitionByRange(parts, id_col).sortWithinPartitions(id_col, text_col)
    return stage(ordered.mapInArrow(run, f"part int, `{id_col}` {kind}, start long, n_tokens long"), "sequence-index")


def read_sequences(index: DataFrame, folder: str, id_col: str = "doc_id") -> DataFrame:
    """Reads every row of ``index`` from the files: id, ``ids``, whole and in order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, reader = None, None
        for batch in batches:
            ids = []
            for at, _, start, count in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != part:
                    part, reader = at, SequenceReader(folder, at)
                ids.append(np.concatenate(list(reader.slices(start, count))).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(ids, pa.list_(pa.int64()))], names=[id_col, "ids"])

    kind = index.schema[id_col].dataType.simpleString()
    return index.select("part", id_col, "start", "n_tokens").mapInArrow(run, f"`{id_col}` {kind}, ids array<long>")


def digest_sequences(index: DataFrame, folder: str, id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``index``, read back: id, ``start`` over all files, ``n_tokens``, ``ids_crc32``.

    Files are mapped into memory and read in the index's own order, so a task opens each file
    once; checksums run over views. ``start`` adds the sizes of the files before, a table of
    one row per file, whose number is the number of shuffle partitions.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, reader = None, None
        for batch in batches:
            sums, read = [], []
            for at, _, start, count in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != part:
                    part, reader = at, SequenceReader(folder, at)
                value = n = 0
                for view in reader.slices(start, count):
                    value = crc32(view.astype("<u4"), value)
                    n += len(view)
                sums.append(value)
                read.append(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(read, pa.int64()), pa.array(sums, pa.int64())],
                names=["part", id_col, "start", "n_tokens", "ids_crc32"])

    kind = index.schema[id_col].dataType.simpleString()
    read = index.select("part", id_col, "start", "n_tokens").mapInArrow(
        run, f"part int, `{id_col}` {kind}, start long, n_tokens long, ids_crc32 long")
    sizes = index.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    before = F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    files = sizes.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    return (read.join(F.broadcast(files), "part")
            .select(id_col, (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"))


def sequence_folder(spark) -> str:
    """A new folder for the files, in the folder that all executors share."""
    return f"{shared_dir(spark).rstrip('/')}/sequences-{uuid.uuid4().hex}"
