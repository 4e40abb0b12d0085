"""A store whose tables are changed by commits: appended by part, merged by key, pruned, and read at any kept version.

Every commit is one small file of the log that names the folders of each part of each table. A writer puts new folders beside the old ones and then creates the next
log file, which only one writer can; the others look whether their parts have changed meanwhile and do their work anew only then. Readers see whole commits.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from datetime import UTC, datetime
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sessionloom.operators.store import upsert

#: Parts of a table that is merged by key.
BUCKETS = 64
_PART = "__part"

#: What a commit does to a part: the folders it had, or None where only a folder is added, and those that it has from now on.
Change = tuple[list[str] | None, list[str]]


def day_of(ts_ms: str | Column) -> Column:
    """The part of a table by day (UTC)."""
    return F.date_format(F.to_date(F.timestamp_millis(ts_ms)), "yyyy-MM-dd")


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.format_string("%05d", F.pmod(F.xxhash64(*keys), F.lit(buckets)))


class Store:
    """Tables under one root and one log, so a commit may change several of them."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # --- the log ---

    def _fs(self, path: str):
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()), hadoop

    def versions(self) -> list[int]:
        files, folder = self._fs(f"{self.root}/_log")
        if not files.exists(folder):
            return []
        names = [x.getPath().getName() for x in files.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """Version, and by table its schema, folders by part, and the last batch of each streaming writer."""
        known = self.versions()
        if not known:
            return {"version": 0, "tables": {}}
        version = known[-1] if version is None else version
        if version not in known:
            raise ValueError(f"no version {version} is kept of {self.root}")
        files, path = self._fs(f"{self.root}/_log/{version:012d}.json")
        stream = files.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _create(self, manifest: dict) -> bool:
        """Put a log file in its place, unless there is one."""
        target = f"{self.root}/_log/{manifest['version']:012d}.json"
        files, path = self._fs(target)
        own = f"{self.root}/_log/.{uuid.uuid4().hex}"
        _, own_path = self._fs(own)
        out = files.create(own_path, True)
        out.write(json.dumps(manifest).encode())
        out.close()
        try:
            if files.getScheme() == "file":
                # a hard link is made by one writer only
                try:
                    os.link(own_path.toUri().getPath(), path.toUri().getPath())
                except FileExistsError:
                    return False
                return True
            # the name node lets one rename to a new name succeed; a store of objects needs conditional writes
            return not files.exists(path) and files.rename(own_path, path)
        finally:
            files.delete(own_path, False)

    def _commit(self, plan: Callable[[dict], dict[str, dict[str, Change]]], schemas: dict[str, str] | None = None, writer: tuple[str, int] | None = None) -> int:
        """Make a commit of what ``plan`` changes, by table and part, against a manifest. The plan is made anew only if a part that it replaces has changed meanwhile."""
        while True:
            base = self.manifest()
            if writer and base.get("writers", {}).get(writer[0], -1) >= writer[1]:
                return base["version"]  # this batch is there already
            changes = plan(base)
            while True:
                head = self.manifest()
                folders = lambda m, table, part: m["tables"].get(table, {}).get("parts", {}).get(part, [])
                if any(before is not None and folders(head, t, p) != before for t, parts in changes.items() for p, (before, _) in parts.items()):
                    break
                for table, parts in changes.items():
                    entry = head["tables"].setdefault(table, {"schema": (schemas or {}).get(table), "parts": {}})
                    for part, (before, after) in parts.items():
                        now = entry["parts"].get(part, []) + after if before is None else after
                        entry["parts"] |= {part: now}
                        if not now:
                            del entry["parts"][part]
                if writer:
                    head.setdefault("writers", {})[writer[0]] = writer[1]
                head["version"] += 1
                head["at"] = datetime.now(UTC).isoformat()
                if self._create(head):
                    return head["version"]

    # --- reading ---

    def _folders(self, manifest: dict, table: str, parts: list[str] | None = None) -> DataFrame:
        entry = manifest["tables"].get(table)
        if entry is None:
            raise ValueError(f"no table {table} in {self.root}")
        schema = StructType.fromJson(json.loads(entry["schema"]))
        paths = [f"{self.root}/{f}" for p, fs in sorted(entry["parts"].items()) if parts is None or p in parts for f in fs]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, table: str, version: int | None = None, parts: Callable[[str], bool] | None = None) -> DataFrame:
        """A table at a version, the newest by default; ``parts`` tells by its name whether a part is read."""
        manifest = self.manifest(version)
        names = list(manifest["tables"].get(table, {}).get("parts", {}))
        return self._folders(manifest, table, None if parts is None else [p for p in names if parts(p)])

    # --- writing ---

    def _write(self, table: str, rows: DataFrame, part: Column) -> dict[str, str]:
        """Rows in a new folder, by part; the folder of each part. A part's rows come together first, as else each task would make a file in each part."""
        folder = f"{table}/{uuid.uuid4().hex}"
        rows.withColumn(_PART, F.coalesce(part, F.lit("none"))).hint("rebalance", _PART).write.partitionBy(_PART).parquet(f"{self.root}/{folder}")
        files, path = self._fs(f"{self.root}/{folder}")
        found = [x.getPath().getName() for x in files.listStatus(path) if x.isDirectory()]
        return {n.partition("=")[2]: f"{folder}/{n}" for n in found if n.startswith(f"{_PART}=")}

    def append(self, table: str, rows: DataFrame, part: Column, writer: tuple[str, int] | None = None) -> int:
        """Add rows, by part. ``writer`` is a stream's name and batch number: a batch that has been added is not added again."""
        added: dict[str, str] = {}

        def plan(_: dict) -> dict[str, dict[str, Change]]:
            if not added:
                added.update(self._write(table, rows, part))
            return {table: {p: (None, [f]) for p, f in added.items()}}

        return self._commit(plan, {table: rows.schema.json()}, writer)

    def merge(self, table: str, rows: DataFrame, keys: list[str], buckets: int = BUCKETS, writer: tuple[str, int] | None = None) -> int:
        """New rows in place of old ones with the same keys (of new rows with equal keys: as ``operators.store.upsert``). Only the buckets that new keys fall into are read and written."""
        part = bucket_of(keys, buckets)
        # what the plan may need more than once
        rows = rows.checkpoint()
        touched = [r[0] for r in rows.select(part.alias("p")).distinct().collect()]  # at most ``buckets``

        def plan(base: dict) -> dict[str, dict[str, Change]]:
            entry = base["tables"].get(table, {"parts": {}})
            old = self._folders(base, table, touched) if any(p in entry["parts"] for p in touched) else rows.limit(0)
            written = self._write(table, upsert(old, rows.select(old.columns), keys), part)
            return {table: {p: (entry["parts"].get(p, []), [written[p]]) for p in touched}}

        return self._commit(plan, {table: rows.schema.json()}, writer) if touched else self.manifest()["version"]

    def replace(self, table: str, rows: DataFrame, writer: tuple[str, int] | None = None) -> int:
        """The rows as all that a table has."""

        def plan(base: dict) -> dict[str, dict[str, Change]]:
            old = base["tables"].get(table, {"parts": {}})["parts"]
            gone: dict[str, Change] = {p: (fs, []) for p, fs in old.items()}
            return {table: gone | {p: (old.get(p, []), [f]) for p, f in self._write(table, rows, F.lit("all")).items()}}

        return self._commit(plan, {table: rows.schema.json()}, writer)

    def _without(self, base: dict, table: str, keep: Column, suspects: list[str] | None = None) -> tuple[dict[str, Change], int]:
        """Changes that take out of a table the rows that are not to be kept, and their number; parts without such rows stay as they are."""
        parts, changes, gone = base["tables"][table]["parts"], {}, 0
        names = sorted(parts if suspects is None else set(suspects) & set(parts))
        if not names:
            return {}, 0
        # a part is known by the folder that its file lies in
        at = F.regexp_extract(F.col("_metadata.file_path"), f"/{_PART}=([^/]*)/", 1)
        counts = self._folders(base, table, names).where(~F.coalesce(keep, F.lit(True))).select(at.alias("p")).groupBy("p").count().collect()
        hit = {p: n for p in names for q, n in counts if q in (p, quote(p))}
        if hit:
            kept = self._folders(base, table, list(hit))
            written = self._write(table, kept.where(F.coalesce(keep, F.lit(True))).select("*", at.alias("__at")), F.col("__at"))
            changes = {p: (parts[p], [written[p]] if p in written else []) for p in hit}
            gone = sum(hit.values())
        return changes, gone

    def prune(self, now_ms: int, days: float, events: str = "events", ts: str = "ts_ms", others: dict[str, str] | None = None, nodes: str | None = None, edges: str | None = None) -> dict[str, int]:
        """Delete what is older than so many days, in one commit over all tables; returns the rows that went, by table (those of whole days as their files' footers tell).

        ``events`` is a table by ``day_of(ts)``: whole days go by the log alone, without a read, and only the day of the cutoff is written anew. ``others`` are tables by the
        column of their time in ms: only buckets that hold old rows are written anew. Nodes (node_id, ts_ms) go by their time, and with them the edges (source, target) that lose an end. Rows without a time stay.
        The files stay for readers of earlier versions until ``vacuum``.
        """
        cutoff = int(now_ms - days * 86_400_000)
        last = datetime.fromtimestamp(cutoff / 1000, UTC).strftime("%Y-%m-%d")
        gone: dict[str, int] = {}

        def plan(base: dict) -> dict[str, dict[str, Change]]:
            changes: dict[str, dict[str, Change]] = {}
            tables = base["tables"]
            if events in tables:
                parts = tables[events]["parts"]
                edge, n = self._without(base, events, F.col(ts) >= cutoff, [last])
                old: dict[str, Change] = {p: (fs, []) for p, fs in parts.items() if p < last and p != "none"}
                changes[events], gone[events] = old | edge, n + (self._folders(base, events, list(old)).count() if old else 0)
            for table, column in (others or {}).items():
                if table in tables:
                    changes[table], gone[table] = self._without(base, table, F.col(column) >= cutoff)
            if nodes in tables:
                lost = self._folders(base, nodes).where(F.col("ts_ms") < cutoff).select("node_id").distinct().checkpoint()
                changes[nodes], gone[nodes] = self._without(base, nodes, F.col("ts_ms") >= cutoff)
                if edges in tables:
                    all_edges = self._folders(base, edges)
                    left = all_edges.join(lost, all_edges.source == lost.node_id, "left_anti").join(lost, F.col("target") == lost.node_id, "left_anti")
                    if changes[nodes]:
                        old_edges = tables[edges]["parts"]
                        written = self._write(edges, left, bucket_of(["source"], BUCKETS))
                        changes[edges] = {p: (fs, []) for p, fs in old_edges.items()} | {p: (old_edges.get(p, []), [f]) for p, f in written.items()}
                        gone[edges] = all_edges.count() - left.count()
            return {t: c for t, c in changes.items() if c}

        self._commit(plan)
        return gone

    def compact(self, table: str) -> int:
        """Put the folders of each part that has several into one."""

        def plan(base: dict) -> dict[str, dict[str, Change]]:
            parts = {p: fs for p, fs in base["tables"][table]["parts"].items() if len(fs) > 1}
            if not parts:
                return {}
            at = F.regexp_extract(F.col("_metadata.file_path"), f"/{_PART}=([^/]*)/", 1)
            written = self._write(table, self._folders(base, table, list(parts)).select("*", at.alias("__at")), F.col("__at"))
            return {table: {p: (fs, [written[p]]) for p, fs in parts.items()}}

        return self._commit(plan)

    def vacuum(self, keep: int = 2) -> int:
        """Delete all but the newest versions' log files, and the folders that no kept version names; returns how many folders went. Writers that are at work must have ended."""
        known = self.versions()
        named = {f for v in known[-keep:] for t in self.manifest(v)["tables"].values() for fs in t["parts"].values() for f in fs}
        gone = 0
        for table in sorted({t for v in known for t in self.manifest(v)["tables"]}):
            files, folder = self._fs(f"{self.root}/{table}")
            for commit in files.listStatus(folder):
                name = commit.getPath().getName()
                inside = [x.getPath() for x in files.listStatus(commit.getPath()) if x.isDirectory()]
                left = [x for x in inside if f"{table}/{name}/{x.getName()}" in named]
                for x in inside:
                    if x not in left:
                        gone += 1
                        files.delete(x, True)
                if not left:
                    files.delete(commit.getPath(), True)
        for v in known[:-keep]:
            files, path = self._fs(f"{self.root}/_log/{v:012d}.json")
            files.delete(path, False)
        return gone
