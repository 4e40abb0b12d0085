"""What the training-data operators share: shared folders, Arrow text access and vectorised word hashing."""

from __future__ import annotations

import ctypes
import functools
import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step handles; a longer single text makes a step of its own.
STEP_BYTES = 1 << 19
#: Spans of more bytes are hashed one by one.
LONG_SPAN = 1 << 12
_CHUNK_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where it is unset and all runs on one machine (tests), a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        set_dir = context._jsc.sc().getCheckpointDir()
        if set_dir.isDefined():
            return set_dir.get()
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="shared-")
        context.setCheckpointDir(found)
        found = context._jsc.sc().getCheckpointDir().get()
    return found


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new, not yet existing, folder in the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a checkpoint in the shared folder; a lost executor loses nothing of it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _release() -> None:
    """Freed memory back to the system: Python workers live on after a task, beside those of later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not every C library has it
        pass


def tidy(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function for mapInArrow, with the memory that it has freed given back at its end."""

    @functools.wraps(function)
    def run(batches):
        try:
            yield from function(batches)
        finally:
            _release()

    return run


def filesystem_of(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or url, and the path there."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def stash(df: DataFrame) -> DataFrame:
    """df written to the shared folder by Python workers and read back: its lineage is cut as by ``cut``, but executors' JVMs create no files.

    On local file systems a JVM starts a command for every file that it creates, to set its permissions, and for that moment may count twice; where many tasks with much in memory write, that is what fills an executor.
    A task's file has a name of its own and is listed only if the task succeeds, so attempts that fail leave nothing that is read.
    """
    spark, folder = df.sparkSession, fresh_dir(df.sparkSession, "stash")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, path = filesystem_of(folder)
        writer = sink = None
        name = f"{uuid.uuid4().hex}.parquet"
        for batch in batches:
            if batch.num_rows:
                if writer is None:
                    filesystem.create_dir(path, recursive=True)
                    sink = filesystem.open_output_stream(f"{path}/{name}")
                    writer = pq.ParquetWriter(sink, batch.schema)
                writer.write_batch(batch)
        if writer is not None:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([name])], names=["name"])

    names = [r[0] for r in df.mapInArrow(tidy(write), "name string").collect()]  # one a task
    return spark.read.schema(df.schema).parquet(*[f"{folder}/{n}" for n in names]) if names else spark.createDataFrame([], df.schema)


def short_batches(spark: SparkSession, rows: int = 2_000) -> None:
    """Arrow batches of fewer rows than the usual 10,000, since rows hold whole texts; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name, "10000")) > rows:
        spark.conf.set(name, str(rows))


def text_or_empty(column: str | Column) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("string"), F.lit(""))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string or binary column, and the len + 1 offsets of its rows (null: no bytes)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_large_binary(column.type) else "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def steps(batch: pa.RecordBatch, column: str, limit: int = STEP_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batch with about ``limit`` bytes of text each, with the text's bytes and offsets."""
    data, offsets = buffers(batch.column(column))
    at = 0
    while at < len(offsets) - 1:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield batch.slice(at, end - at), data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit hashes."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _chunks(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of the data on, as one number."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of the bytes of each span, eight at a time, each mixed in before the next; spans over LONG_SPAN by BLAKE2.

    Of spans of up to eight bytes no two different ones of a length have the same hash.
    """
    size, chunks = end - start, _chunks(data)
    out = mix((size.astype(np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15))
    out = mix(out ^ (chunks[start] & _CHUNK_MASK[np.minimum(size, 8)]))
    long = np.flatnonzero(size > LONG_SPAN)
    for k in long.tolist():
        out[k] = int.from_bytes(hashlib.blake2b(data[start[k] : end[k]].tobytes(), digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little")
    at, open_ = 8, np.flatnonzero((size > 8) & (size <= LONG_SPAN))
    while len(open_):
        left = np.minimum(size[open_] - at, 8)
        out[open_] = mix((out[open_] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (chunks[start[open_] + at] & _CHUNK_MASK[left]))
        at += 8
        open_ = open_[size[open_] > at]
    return out


def same_spans(one: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray, start2: np.ndarray, end2: np.ndarray, spare: bool = False) -> np.ndarray:
    """Whether the bytes of each span are those of its opposite; ``spare`` says that eight bytes at the end of ``other`` belong to no span, so it need not be copied."""
    size, a = end - start, _chunks(one)
    b = np.ndarray(len(other) - 7, "<u8", other, strides=(1,)) if spare else _chunks(other)
    same = size == end2 - start2
    for k in np.flatnonzero(same & (size > LONG_SPAN)).tolist():
        same[k] = np.array_equal(one[start[k] : end[k]], other[start2[k] : end2[k]])
    open_ = np.flatnonzero(same & (size <= LONG_SPAN))
    at = 0
    while len(open_):
        mask = _CHUNK_MASK[np.minimum(size[open_] - at, 8)]
        equal = (a[start[open_] + at] ^ b[start2[open_] + at]) & mask == 0
        same[open_[~equal]] = False
        at += 8
        open_ = open_[equal & (size[open_] > at)]
    return same


#: Maps A-Z to a-z; 0 marks bytes that are in no word. Words are runs of 0-9, a-z and bytes of non-ASCII characters.
WORD_BYTES = np.zeros(256, np.uint8)
WORD_BYTES[0x30:0x3A] = np.arange(0x30, 0x3A)
WORD_BYTES[0x61:0x7B] = np.arange(0x61, 0x7B)
WORD_BYTES[0x41:0x5B] = np.arange(0x61, 0x7B)
WORD_BYTES[0x80:] = np.arange(0x80, 0x100)


@dataclass
class Words:
    """Words of some texts: byte ranges, 64-bit hashes, and the index of each text's first word (and the end)."""

    folded: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def of(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    folded = WORD_BYTES[data]
    n = len(folded)
    inside = folded != 0
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    hashed = span_hashes(folded, start, end)
    return Words(folded, start, end, hashed, np.searchsorted(start, offsets))


def ngrams(hashed: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words; texts' ends are the caller's matter."""
    out = np.full(max(0, len(hashed) - n + 1), n, np.uint64)
    for k in range(n):
        out ^= hashed[k : len(hashed) - n + 1 + k]
        out = mix(out) * np.uint64(0xD6E8FEB86659FD93)
    return mix(out)
