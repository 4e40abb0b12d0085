"""Log files that are followed while they grow, as a streaming source of lines."""

from __future__ import annotations

import fnmatch
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.window import Window

from sessionloom.sources.agent_logs import parse

LINES = "value string, file string, session_id string, at bigint, modified_ms bigint"
#: Bytes at a file's start by which it is known again.
HEAD = 256
#: Bytes of a file that one task reads, unless told otherwise.
SPLIT_BYTES = 32 << 20
#: Bytes read at once to find a line's end.
BLOCK = 1 << 16


@dataclass
class LineRange(InputPartition):
    """Lines of a file that begin in [start, end); ``base`` begins a line."""

    path: str
    inode: str
    base: int
    start: int
    end: int


def local_path(path: str) -> str:
    """A path of a mounted file system, of which a ``file:`` url is one."""
    if path.startswith("file:"):
        return "/" + path[len("file:") :].lstrip("/")
    if "://" in path:
        raise ValueError(f"only files of a mounted file system can be followed, not {path}")
    return path


def _head(path: str, at: int) -> int:
    with open(path, "rb") as f:
        return zlib.crc32(f.read(min(HEAD, at)))


def _lines_end(path: str, size: int) -> int:
    """Where the last whole line within the first ``size`` bytes ends."""
    with open(path, "rb") as f:
        while size > 0:
            start = max(0, size - BLOCK)
            f.seek(start)
            found = f.read(size - start).rfind(b"\n")
            if found >= 0:
                return start + found + 1
            size = start
    return 0


class TailReader(DataSourceStreamReader):
    """Offsets are the bytes read of each file, kept by inode, so a renamed file goes on where it was and a new file of an old name starts anew."""

    def __init__(self, options: dict):
        self.path, self.glob = local_path(options["path"]), options.get("glob", "*.jsonl")
        self.split = int(options.get("splitBytes", SPLIT_BYTES))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        found = {}
        for folder, _, names in os.walk(self.path):
            for name in fnmatch.filter(names, self.glob):
                path = os.path.join(folder, name)
                try:
                    told = os.stat(path)
                    at = _lines_end(path, told.st_size)
                    found[str(told.st_ino)] = {"path": path, "at": at, "head": _head(path, at)}
                except FileNotFoundError:  # gone since it was listed
                    continue
        return found

    def _from(self, known: dict | None, now: dict) -> int:
        """Where reading goes on: at the known place if the file still begins as it did and is no shorter, else at its start."""
        if not known or known["at"] > now["at"]:
            return 0
        try:
            return known["at"] if _head(now["path"], known["at"]) == known["head"] else 0
        except FileNotFoundError:
            return known["at"]

    def partitions(self, start: dict, end: dict) -> list[LineRange]:
        ranges = []
        for inode, now in sorted(end.items(), key=lambda kv: kv[1]["path"]):
            begin = self._from(start.get(inode), now)
            ranges += [LineRange(now["path"], inode, begin, a, min(a + self.split, now["at"])) for a in range(begin, now["at"], self.split)]
        return ranges

    def read(self, partition: LineRange) -> Iterator[pa.RecordBatch]:
        path = partition.path
        if not os.path.exists(path) or str(os.stat(path).st_ino) != partition.inode:
            moved = [e.path for e in os.scandir(os.path.dirname(path)) if e.is_file() and str(e.inode()) == partition.inode] if os.path.isdir(os.path.dirname(path)) else []
            if not moved:  # its lines are gone with it
                return
            path = moved[0]
        session, modified = os.path.basename(os.path.dirname(partition.path)) or "unknown", int(os.stat(path).st_mtime * 1000)
        values: list[str] = []
        places: list[int] = []
        size = 0

        def batch() -> pa.RecordBatch:
            n = len(values)
            columns = [pa.array(values, pa.string()), pa.array([partition.path] * n, pa.string()), pa.array([session] * n, pa.string()), pa.array(places, pa.int64()), pa.array([modified] * n, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in LINES.split(", ")])

        with open(path, "rb") as f:
            if partition.start > partition.base:  # the line that begins before this range is another task's
                f.seek(partition.start - 1)
                f.readline()
            else:
                f.seek(partition.start)
            at = f.tell()
            while at < partition.end and (line := f.readline()).endswith(b"\n"):
                values.append(line.rstrip(b"\r\n").decode("utf-8", "replace"))
                places.append(at)
                at += len(line)
                size += len(line)
                if size >= 4 << 20 or len(values) >= 10_000:
                    yield batch()
                    values, places, size = [], [], 0
        if values:
            yield batch()


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tailed_lines"

    def schema(self) -> str:
        return LINES

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options)


def tail_lines(spark: SparkSession, path: str, glob: str = "*.jsonl", split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Lines of the files under ``path``, in any depth, as they are written: value, file, session_id (the name of the file's folder), at (the line's first byte), modified_ms.

    A trigger brings all whole lines that are new; a last line without its end waits until it has one. A file that became shorter or begins otherwise was truncated or replaced
    and is read from its start; a file renamed within the glob goes on where it was; one that is gone is forgotten. Bytes that are no UTF-8 are replaced. A restart from the checkpoint repeats no line
    and leaves none out, as long as the bytes are still there. Large growth is split over tasks by bytes. The folder is listed by the driver at each trigger and read by executors, so it must be mounted on all.
    """
    spark.dataSource.register(TailSource)
    return spark.readStream.format("tailed_lines").option("glob", glob).option("splitBytes", split_bytes).load(path)


def tail_log(spark: SparkSession, path: str, glob: str = "*.jsonl") -> DataFrame:
    """Agent log events of files that grow."""
    return parse(tail_lines(spark, path, glob))


def placed(lines: DataFrame) -> DataFrame:
    """Lines (value, file) with the byte at which each begins in its file, in order of the text, and the file's size."""
    size = (F.octet_length("value") + 1).cast("long")
    so_far = Window.partitionBy("file").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("file")
    rows = lines.select("value", "file", size.alias("n"))
    return rows.select("value", "file", (F.sum("n").over(so_far) - F.col("n")).alias("at"), F.sum("n").over(whole).alias("size"))


def grow(placed_lines: DataFrame, folder: str, share: float) -> None:
    """Write the first part of each file, as many bytes as its share, whatever was there before.

    Each line is written at its own place, so a task that runs twice changes nothing. This stands for the program that keeps the logs.
    """
    folder, upto = local_path(folder), F.floor(F.col("size") * share)

    def write(batches):
        for batch in batches:
            for value, file, at, end in zip(*(c.to_pylist() for c in batch.columns)):
                path = os.path.join(folder, file)
                os.makedirs(os.path.dirname(path), exist_ok=True)
                handle = os.open(path, os.O_CREAT | os.O_WRONLY)
                try:
                    os.pwrite(handle, (value + "\n").encode()[: end - at], at)
                finally:
                    os.close(handle)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    placed_lines.where(F.col("at") < upto).select("value", "file", "at", upto.cast("long").alias("upto")).mapInArrow(write, "n long").agg(F.sum("n")).collect()
