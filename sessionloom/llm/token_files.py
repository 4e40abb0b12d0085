"""Files of token ids in document order: range-coded blocks, a document index and checksums."""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.common import cut, fresh_dir, steps, text_or_empty, tidy
from sessionloom.llm.id_coder import BLOCK_IDS, HEAD_BYTES, block_bytes, decode_block, encode_block
from sessionloom.llm.tokens import encoder

#: Fixed values of the format. A file is FILE_MAGIC and its segments; a segment is a head, the index (doc_ids and
#: lengths, each as little-endian 64-bit numbers, under Zstandard) and its blocks, each with a head of its own.
FILE_MAGIC = b"TIDF0001"
_SEGMENT = struct.Struct("<4sIIIII")  # magic, documents, blocks, symbols, index bytes, CRC-32 of the index
_SEGMENT_MAGIC = b"TIDS"
_NO_ID = -(1 << 63)
#: Bytes of text that one file stands for.
PART_BYTES = 24 << 20


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def encode_segment(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """Documents with all their ids, in order; blocks hold about BLOCK_IDS ids, a quarter more at most, and ignore where documents end."""
    symbols = int(ids.max()) + 1 if len(ids) else 1
    index = zstandard.ZstdCompressor(level=3).compress(doc_ids.astype("<i8").tobytes() + lengths.astype("<i8").tobytes())
    # blocks of equal size: one with few ids costs several times as much an id
    edges = len(ids) * np.arange((n := -(-4 * len(ids) // (5 * BLOCK_IDS))) + 1) // max(n, 1)
    blocks = [encode_block(ids[a:b], symbols) for a, b in zip(edges.tolist(), edges[1:].tolist())]
    return _SEGMENT.pack(_SEGMENT_MAGIC, len(doc_ids), len(blocks), symbols, len(index), zlib.crc32(index)) + index + b"".join(blocks)


def _exactly(source, size: int) -> bytes:
    got = source.read(size)
    if len(got) != size:
        raise ValueError("a file of ids ends too early")
    return got


def read_segments(uri: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(doc_ids, lengths, ids) of each segment; damage is a ValueError."""
    filesystem, path = _filesystem(uri)
    with filesystem.open_input_stream(path, compression=None) as source:
        if _exactly(source, len(FILE_MAGIC)) != FILE_MAGIC:
            raise ValueError(f"{uri} is no file of ids")
        while head := source.read(_SEGMENT.size):
            magic, documents, blocks, _, size, check = _SEGMENT.unpack(head)
            index = _exactly(source, size)
            if magic != _SEGMENT_MAGIC or zlib.crc32(index) != check:
                raise ValueError(f"damaged segment in {uri}")
            numbers = np.frombuffer(zstandard.ZstdDecompressor().decompress(index), "<i8")
            parts = []
            for _ in range(blocks):
                head = _exactly(source, HEAD_BYTES)
                parts.append(decode_block(head, _exactly(source, block_bytes(head))))
            yield numbers[:documents], numbers[documents:], np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def write_token_files(documents: DataFrame, folder: str, tokenizer_file: str, text: str = "text", doc_id: str = "doc_id", end_id: int = 1) -> DataFrame:
    """Tokenise whole texts, append ``end_id`` to each, and write the ids in ascending doc_id order; returns a row per file: part, path, documents, ids.

    Rows are dealt by ranges of doc_id and sorted in their range, so files in order of ``part`` hold the corpus in order;
    a null doc_id comes first, rows that share a doc_id are in order of their texts. A null text is empty. A task writes one file under a name
    that no other attempt uses, and the result, which is checkpointed, names those of the successful attempts only.
    ``folder`` must be shared by all executors.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("t"))
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_BYTES))
    dealt = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "t")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        filesystem, path = _filesystem(folder)
        filesystem.create_dir(path, recursive=True)
        name = f"part-{part:06d}-{uuid.uuid4().hex[:8]}.ids"
        codes, sink, written, documents_ = encoder(tokenizer_file), None, 0, 0
        waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush() -> None:
            nonlocal waiting, sink, written, documents_
            if not waiting:
                return
            if sink is None:
                sink = filesystem.open_output_stream(f"{path}/{name}", compression=None)
                sink.write(FILE_MAGIC)
            docs, lengths, ids = (np.concatenate(x) for x in zip(*waiting))
            waiting, written, documents_ = [], written + len(ids), documents_ + len(docs)
            sink.write(encode_segment(docs, lengths, ids))

        for batch in batches:
            for rows_, data, offsets in steps(batch, "t"):
                ids, ends = codes.encode(data, offsets)
                whole = np.full(len(ids) + len(ends) - 1, end_id, np.uint32)
                whole[np.arange(len(ids)) + np.repeat(np.arange(len(ends) - 1), np.diff(ends))] = ids
                waiting.append((rows_.column("doc_id").fill_null(_NO_ID).to_numpy(), np.diff(ends) + 1, whole))
                if sum(len(w[2]) for w in waiting) >= 2 * BLOCK_IDS:
                    flush()
        flush()
        if sink is not None:
            sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([f"{folder.rstrip('/')}/{name}"]), pa.array([documents_], pa.int64()), pa.array([written], pa.int64())], names=["part", "path", "documents", "ids"])

    return cut(dealt.mapInArrow(tidy(write), "part int, path string, documents long, ids long"))


def read_token_files(files: DataFrame, with_ids: bool = True) -> DataFrame:
    """Every document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked, ids.

    Where a file begins is a sum over the earlier parts' numbers of ids: one number per file goes to the driver.
    """
    before, at = {}, 0
    for part, n in files.select("part", "ids").orderBy("part").collect():
        before[part] = at
        at += n
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, path in zip(batch.column("part").to_pylist(), batch.column("path").to_pylist()):
                start = before[part]
                for doc_ids, lengths, ids in read_segments(path):
                    ends = np.concatenate([[0], np.cumsum(lengths)])
                    raw = memoryview(ids.astype("<u4").tobytes())
                    checks = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends.tolist(), ends[1:].tolist())]
                    columns = [pa.array(doc_ids, pa.int64(), mask=doc_ids == _NO_ID), pa.array(start + ends[:-1]), pa.array(lengths), pa.array(checks, pa.int64())]
                    if with_ids:
                        columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.astype(np.int32))))
                    yield pa.RecordBatch.from_arrays(columns, names=names)
                    start += len(ids)

    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    spread = files.select("part", "path").repartition(max(1, len(before)), "part")
    return spread.mapInArrow(tidy(read), schema)


def manifest(files: DataFrame) -> str:
    """The files in order, as JSON: what a reader outside Spark needs besides the files."""
    return json.dumps([r.asDict() for r in files.orderBy("part").collect()])


def token_round_trip(documents: DataFrame, tokenizer_file: str, folder: str | None = None) -> DataFrame:
    """Documents' ids written to files and read back; other columns are ignored, an empty table has no files and no rows."""
    folder = folder or fresh_dir(documents.sparkSession, "token-ids")
    return read_token_files(write_token_files(documents, folder, tokenizer_file), with_ids=False)
