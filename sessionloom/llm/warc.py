"""WARC archives with per-record Zstandard frames and a dictionary in a leading skippable frame."""

from __future__ import annotations

import base64
import hashlib
import struct
import urllib.parse
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.common import cut, fresh_dir, text_or_empty, tidy

#: Fixed values of the formats.
SKIPPABLE_MAGIC = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

DICTIONARY_BYTES = 64 << 10
#: Bytes of a file's first records that its dictionary is built from.
SAMPLE_BYTES = 4 << 20
#: Compressed bytes at which a writer begins a new file.
FILE_BYTES = 64 << 20
LEVEL = 3
#: Parts of the rows of one payload.
SALTS = 16
READ_BYTES = 256 << 10

PAGES_READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def target_uri(url: str) -> str:
    """The url as it is written: what is no visible ASCII character is percent-encoded, all else stays, also what is encoded already."""
    return "".join(c if "!" <= c <= "~" else urllib.parse.quote(c, safe="") for c in url)


def encode_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One WARC/1.1 record: the response with its payload, or a revisit with the HTTP head alone."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + (b"" if revisit else payload)
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _record_id(page_id, digest)), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", target_uri(url)))
        if target_uri(url) != url:  # as it came, to be read back
            fields.append(("X-URL", urllib.parse.quote(url, safe="")))
    fields += [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    if revisit:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", _record_id(refers_to, digest)), ("X-Refers-To-Page-ID", str(refers_to))]
    fields.append(("Content-Length", str(len(block))))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def decode_record(record: bytes) -> dict:
    """What a record says, checked: the block's length, and a response's payload against its digest."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    size = int(fields["Content-Length"])
    block = rest[:size]
    if version != "WARC/1.1" or len(block) != size or rest[size:] != b"\r\n\r\n":
        raise ValueError("damaged WARC record")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != length or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError("a payload does not have its digest")
    url = fields.get("WARC-Target-URI")
    return {
        "page_id": int(fields["X-Page-ID"]) if "X-Page-ID" in fields else None,
        "url": urllib.parse.unquote(fields["X-URL"]) if "X-URL" in fields else url,
        "payload_bytes": length,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": int(fields["X-Refers-To-Page-ID"]) if kind == "revisit" else None,
        "payload": payload if kind == "response" else None,
    }


def _dictionary(records: list[bytes]) -> bytes:
    """A trained dictionary, or plain content of the records where there is too little to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, records).as_bytes()
    except zstandard.ZstdError:
        return b"".join(records)[-DICTIONARY_BYTES:]


class ArchiveWriter:
    """Writes records to files of about FILE_BYTES: a skippable frame with the dictionary, then a frame per record."""

    def __init__(self, folder: str, stem: str):
        self.filesystem, self.path = pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        self.filesystem.create_dir(self.path, recursive=True)
        self.folder, self.stem, self.files = folder, stem, []
        self.waiting: list[bytes] = []
        self.waiting_bytes, self.sink, self.written, self.records = 0, None, 0, 0

    def _open(self) -> None:
        dictionary = _dictionary(self.waiting)
        name = f"{self.stem}-{len(self.files):05d}.warc.zst"
        self.name, self.sink = name, self.filesystem.open_output_stream(f"{self.path}/{name}", compression=None)
        self.sink.write(struct.pack("<II", SKIPPABLE_MAGIC, len(dictionary)) + dictionary)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=True)
        self.written, self.records = 8 + len(dictionary), 0

    def _put(self, record: bytes) -> None:
        frame = self.compressor.compress(record)
        self.sink.write(frame)
        self.written += len(frame)
        self.records += 1

    def add(self, record: bytes) -> None:
        if self.sink is None:
            self.waiting.append(record)
            self.waiting_bytes += len(record)
            if self.waiting_bytes >= SAMPLE_BYTES:
                self._start()
        else:
            self._put(record)
            if self.written >= FILE_BYTES:
                self._end()

    def _start(self) -> None:
        self._open()
        for record in self.waiting:
            self._put(record)
        self.waiting, self.waiting_bytes = [], 0

    def _end(self) -> None:
        self.sink.close()
        self.files.append((f"{self.folder.rstrip('/')}/{self.name}", self.records, self.written))
        self.sink = None

    def close(self) -> list[tuple[str, int, int]]:
        if self.waiting:
            self._start()
        if self.sink is not None:
            self._end()
        return self.files


def read_archive(uri: str) -> Iterator[bytes]:
    """The records of one file, one frame at a time."""
    filesystem, path = pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
    with filesystem.open_input_stream(path, compression=None) as source:
        magic, size = struct.unpack("<II", source.read(8))
        if magic != SKIPPABLE_MAGIC:
            raise ValueError(f"{uri} does not begin with a dictionary frame")
        reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(source.read(size)))
        rest = b""
        while rest or (rest := source.read(READ_BYTES)):
            frame, parts = reader.decompressobj(), []
            while True:
                parts.append(frame.decompress(rest))
                if frame.eof:
                    rest = frame.unused_data
                    break
                rest = source.read(READ_BYTES)
                if not rest:
                    raise ValueError(f"{uri} ends within a record")
            yield b"".join(parts)


def write_archives(pages: DataFrame, folder: str, min_revisit_bytes: int = 0, page_id: str = "page_id", url: str = "url", html: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write a record per page into archives in ``folder``, which all executors must share; returns path, records, bytes of each.

    Of pages with equal payloads of at least ``min_revisit_bytes``, those with the largest page_id are responses
    and the others revisit that page; with no page_id at all, all are responses. A null html is an empty payload. The digest and the largest page_id are found in
    Spark; each task writes files of its own under names no other attempt uses, and only a successful attempt's files
    are in the result (which is checkpointed), so a lost executor leaves unread files but no damage.
    """
    payload = text_or_empty(html)
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    # payloads never travel by digest, of which one may be a third of all: digests and ids do, salted by the id, where a payload repeats
    small = rows.select("digest", F.col("page_id").alias("page"), F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).alias("salt"))
    last = small.groupBy("digest").agg(F.max("page").alias("last"), F.count("*").alias("n")).where("n > 1").select("digest", "last", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    revisits = small.join(last, ["digest", "salt"]).select("page", F.col("digest").alias("of"), "last").distinct()
    rows = rows.join(revisits, F.col("page_id").eqNullSafe(F.col("page")) & (F.col("digest") == F.col("of")), "left").select("page_id", "url", "payload", "last")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        writer = ArchiveWriter(folder, f"pages-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex[:8]}")
        for batch in batches:
            for page, link, text, newest in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "last"))):
                body, page, newest = text.as_buffer().to_pybytes(), page.as_py(), newest.as_py()
                revisit = newest is not None and page != newest and len(body) >= min_revisit_bytes
                writer.add(encode_record(page, link.as_py(), body, newest if revisit else None, revisit, date))
        files = writer.close()
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in files], pa.string()), *(pa.array([f[i] for f in files], pa.int64()) for i in (1, 2))], names=["path", "records", "bytes"])

    return cut(rows.mapInArrow(tidy(write), "path string, records long, bytes long"))


def read_archives(files: DataFrame, payloads: bool = True) -> DataFrame:
    """Every record of the archives in column ``path``; files are read where they are dealt, record by record."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(found: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(found, schema=schema)

        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for path in batch.column("path").to_pylist():
                found, held = [], 0
                for record in read_archive(path):
                    row = decode_record(record)
                    if not payloads:
                        row["payload"] = None
                    found.append(row)
                    held += len(row["payload"] or b"") + 200
                    if held > READ_BYTES * 16:
                        yield emit(found)
                        found, held = [], 0
                yield emit(found)

    return files.select("path").mapInArrow(tidy(read), PAGES_READ)


def archive_round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Pages written to archives and read back; see ``write_archives`` and ``read_archives``. Repeated rows have a record each; other columns are ignored."""
    folder = folder or fresh_dir(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder), payloads=False).drop("payload")
