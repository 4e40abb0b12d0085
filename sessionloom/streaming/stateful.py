"""Sessions as stateful processors: typed state, event-time timers, and state that is read back and handed to another stream.

State lives in RocksDB. Sessions are dealt to BUCKETS keys by a hash, and a key's sessions are one value, so what a micro-batch asks of the store grows with the keys and not with sessions or events. A session has in it its
counters, last tools and up to READ_AT_ONCE different files; more files are entries of maps, so an event touches only its own file's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from sessionloom.operators import realtime
from sessionloom.streaming.sessions import _EVENT, DELAY, EVENT_STATES, RUNNING, Running, as_frame, in_order, said, shared_folder, with_event_time

#: The value of a session: all of its running state but the files, how many of those there are, and when a prediction was last due.
_FILES = ("read_paths", "edited_files")
_PLAIN = [c for c in RUNNING.split(", ") if c.split()[0] not in _FILES]
COUNTERS = ", ".join([*_PLAIN, "files_read bigint", "files_edited bigint", "since_ms bigint", "since_version bigint", "since_tokens double", "due_at bigint", "ends_at bigint"])
_TYPES = dict(c.split() for c in COUNTERS.split(", "))
_NAMES = list(_TYPES)
#: An event with the state after it, and why a prediction is due at it; a time that passed without an event has type ``timer`` and no id.
LIVE = EVENT_STATES + ", reason string"
_LIVE = [c.split()[0] for c in LIVE.split(", ")]
#: State to begin with: a session's counters, and a row for each file.
KEPT = f"session_id string, part string, path string, {COUNTERS}"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Keys of the state.
BUCKETS = 1_024
#: What a key holds: its sessions, each with its counters and files, and the time that is registered.
_HELD = ["session_id", *_NAMES, *_FILES]
HELD = f"sessions array<struct<session_id: string, {', '.join(f'{k}: {v}' for k, v in _TYPES.items())}, read_paths: array<string>, edited_files: array<string>>>, timer bigint"
#: Files of a session up to which they are read at once; of more, each is asked for.
READ_AT_ONCE = 256


class _Seen:
    """The different files of a session, in a map of the state store, which is asked once for all of few files and never for none."""

    def __init__(self, entries, n: int):
        self.entries, self.n, self.known, self.whole = entries, n, set(), n == 0

    def __setitem__(self, path: str, _) -> None:
        if path not in self.known and not self.whole and self.n <= READ_AT_ONCE:
            self.known.update(k[0] for k in self.entries.keys())
            self.whole = True
        if path in self.known:
            return
        self.known.add(path)
        if self.whole or not self.entries.containsKey((path,)):
            self.entries.updateValue((path,), (True,))
            self.n += 1

    def __len__(self) -> int:
        return self.n


class _Of:
    """A session's entries of a map."""

    def __init__(self, entries, session: str):
        self.entries, self.session = entries, session

    def containsKey(self, key) -> bool:
        return self.entries.containsKey((self.session, *key))

    def updateValue(self, key, value) -> None:
        self.entries.updateValue((self.session, *key), value)


class _Files:
    """The different files of a session: few are held, more are entries of a map (``_Seen``)."""

    def __init__(self, entries, session: str, held, n: int):
        self.entries, self.known = _Of(entries, session), dict.fromkeys(held or ())
        self.more = _Seen(self.entries, n) if n > len(self.known) else None

    def __setitem__(self, path: str, _) -> None:
        if self.more is not None:
            self.more[path] = None
            return
        self.known[path] = None
        if len(self.known) > READ_AT_ONCE:
            for one in self.known:
                self.entries.updateValue((one,), (True,))
            self.more, self.known = _Seen(self.entries, len(self.known)), {}

    def __len__(self) -> int:
        return len(self.known) if self.more is None else len(self.more)


class LiveSession(StatefulProcessor):
    """Moves the states of a key's sessions on by their events, and tells when a prediction is due: after so many events or tokens, or so much time; with ``timers``, a time also comes due by the watermark alone."""

    def __init__(self, max_events: int, max_tokens: float, max_ms: int, keep_ms: int, timers: bool):
        self.max_events, self.max_tokens, self.max_ms, self.keep_ms, self.timers = max_events, max_tokens, max_ms, keep_ms, timers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("sessions", HELD)
        self.read = handle.getMapState("read", "session_id string, path string", "seen boolean")
        self.edited = handle.getMapState("edited", "session_id string, path string", "seen boolean")

    def _load(self) -> tuple[dict[str, dict], int | None]:
        held = self.held.get()
        return ({row[0]: dict(zip(_HELD, row)) for row in held[0]}, held[1]) if held is not None else ({}, None)

    def _store(self, sessions: dict[str, dict], timer: int | None) -> None:
        """All sessions, and the first of their times as the one that is registered."""
        first = min((at for kept in sessions.values() for at in (kept["due_at"], kept["ends_at"]) if at is not None), default=None)
        if first != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if first is not None:
                self.handle.registerTimer(first)
        if sessions:
            self.held.update(([tuple(kept[k] for k in _HELD) for kept in sessions.values()], first))
        else:
            self.held.clear()

    def _opened(self, session: str, kept: dict | None) -> tuple[Running, dict]:
        running = Running(None)
        if kept:
            running.__dict__.update({k: kept[k] for k in (c.split()[0] for c in _PLAIN)})
            running.recent_tools = list(running.recent_tools or [])
        extra = {k: kept[k] if kept else None for k in ("since_ms", "due_at", "ends_at")} | {"since_version": kept["since_version"] if kept else 0, "since_tokens": kept["since_tokens"] if kept else 0.0}
        files = (_Files(entries, session, kept[held] if kept else (), kept[n] if kept else 0) for entries, held, n in ((self.read, "read_paths", "files_read"), (self.edited, "edited_files", "files_edited")))
        running.read_paths, running.edited_files = files
        return running, extra

    @staticmethod
    def _kept(session: str, running: Running, extra: dict) -> dict:
        counted = {"files_read": len(running.read_paths), "files_edited": len(running.edited_files)}
        return running.__dict__ | extra | counted | {"session_id": session, "read_paths": list(running.read_paths.known), "edited_files": list(running.edited_files.known)}

    def _forget(self, session: str, kept: dict) -> None:
        for entries, held, n in ((self.read, "read_paths", "files_read"), (self.edited, "edited_files", "files_edited")):
            if kept[n] > len(kept[held] or ()):
                for key in [k for k in entries.keys() if k[0] == session]:
                    entries.removeKey(tuple(key))

    def _reason(self, running: Running, extra: dict, now: int, tokens: float) -> str | None:
        if extra["since_ms"] is None:
            extra["since_ms"] = now  # the first event starts the clock
        reason = None
        if running.version - extra["since_version"] >= self.max_events:
            reason = "events"
        elif tokens - extra["since_tokens"] >= self.max_tokens:
            reason = "tokens"
        elif now - extra["since_ms"] >= self.max_ms and running.version > extra["since_version"]:
            reason = "time"
        if reason:
            extra |= {"since_ms": now, "since_version": running.version, "since_tokens": tokens}
        return reason

    def _overdue(self, sessions: dict[str, dict], upto: int) -> list[dict]:
        """What has come due up to a moment of event time; sessions that have ended by then are left out of the states."""
        out = []
        for session, kept in list(sessions.items()):
            if kept["due_at"] is not None and kept["due_at"] <= upto:
                at, (running, extra) = kept["due_at"], self._opened(session, kept)
                if running.version > extra["since_version"]:
                    used = running.sum_prompt + running.sum_completion
                    values = running.__dict__ | {"files_read": len(running.read_paths), "files_edited": len(running.edited_files), "context_tokens": used, "usage": used / running.limit if running.limit else 0.0}
                    values |= {"session_id": session, "type": "timer", "ts_ms": at, "elapsed_ms": at - running.first_ms, "is_transition": 0, "reason": "time"}
                    out.append({c: values.get(c) for c in _LIVE})
                    kept |= {"since_ms": at, "since_version": running.version, "since_tokens": used}
                kept["due_at"] = None
            if kept["ends_at"] is not None and kept["ends_at"] <= upto:
                self._forget(session, sessions.pop(session))
        return out

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        sessions, timer = self._load()
        # rows of a batch come before its timers
        out = self._overdue(sessions, watermark)
        arrived: dict[str, list[dict]] = {}
        for session, *row in in_order(rows, ["session_id", *_EVENT]):
            arrived.setdefault(session, []).append(dict(zip(_EVENT, row)))
        for session, events in arrived.items():
            running, extra = self._opened(session, sessions.get(session))
            for event in events:
                state = running.step(event) | {"session_id": session}
                out.append(state | {"reason": self._reason(running, extra, event["ts_ms"], state["context_tokens"])})
            if self.timers:
                extra["due_at"] = max(extra["since_ms"] + self.max_ms, watermark + 1) if running.version > extra["since_version"] else None
            extra["ends_at"] = max(running.last_ms + self.keep_ms, watermark + 1)
            sessions[session] = self._kept(session, running, extra)
        self._store(sessions, timer)
        yield as_frame(out, _LIVE)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        sessions, timer = self._load()
        out = self._overdue(sessions, max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()))
        self._store(sessions, timer)
        if out:
            yield as_frame(out, _LIVE)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        sessions, timer = self._load()
        # pandas has numbers beside missing ones as floats
        as_type = {"bigint": int, "double": float, "boolean": bool, "string": str, "array<string>": list}
        for row in initialState.astype(object).itertuples(index=False):
            kept = sessions.setdefault(row.session_id, dict.fromkeys(_HELD) | {"session_id": row.session_id, "read_paths": [], "edited_files": []})
            if row.part == "counters":
                values = {k: None if k != "recent_tools" and said(getattr(row, k)) is None else as_type[kind](getattr(row, k) if getattr(row, k) is not None else ()) for k, kind in _TYPES.items()}
                # the timers of the stream before are not those of this one
                kept |= values | {"due_at": None, "ends_at": None}
            elif row.part in ("read", "edited"):
                kept["read_paths" if row.part == "read" else "edited_files"] += [row.path]
        self._store(sessions, timer)

    def close(self) -> None:
        pass


@contextmanager
def _set(spark: SparkSession, name: str, value: str):
    """A setting for a while; the session's own comes back afterwards."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


@contextmanager
def rocksdb(spark: SparkSession):
    """Stateful processors need the RocksDB provider."""
    with _set(spark, "spark.sql.streaming.stateStore.providerClass", PROVIDER):
        yield


def live_states(
    log: DataFrame, max_events: int = 5, max_tokens: float = 5000, max_ms: int = 30_000, timers: bool = False, keep_ms: int = 24 * 3_600_000, delay: str = DELAY, initial: DataFrame | None = None
) -> DataFrame:
    """Every event of a stream with its session's state after it and, under ``reason``, why a prediction is due: ``events``, ``tokens`` or ``time``.

    The columns are those of ``realtime.running_state`` and ``realtime.phases``, and the reasons those of ``realtime.prediction_triggers``. With ``timers``, a session of which something is new becomes due
    once the watermark passes ``max_ms`` after the last time, as a row of type ``timer``. A session's state ends when the watermark passes its last event by ``keep_ms``.
    ``initial`` is state to begin with (KEPT, as from ``kept_states``). Start the stream within ``rocksdb(spark)``.
    """
    types = dict(c.split() for c in realtime.LOG_COLUMNS.split(", "))
    rows = with_event_time(log, delay).select(_bucket(), "session_id", "event_time", *[F.col(c) if c in log.columns else F.lit(None).cast(types[c]).alias(c) for c in _EVENT])
    processor = LiveSession(max_events, max_tokens, max_ms, keep_ms, timers)
    schema = StructType.fromDDL(LIVE)
    first = initial.select(_bucket(), "*").groupBy("bucket") if initial is not None else None
    return rows.groupBy("bucket").transformWithStateInPandas(processor, schema, "Append", "EventTime", initialState=first)


def _bucket() -> Column:
    return F.pmod(F.xxhash64("session_id"), F.lit(BUCKETS)).alias("bucket")


def run(stream: DataFrame, folder: str, sink: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Run a stream over what is there now, from the checkpoint in the folder, and return all rows that it has written so far."""
    spark = stream.sparkSession

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")
        if sink:
            sink(batch, number)

    # each task of a stateful processor starts a worker of its own, so there are not more of them than can run in two rounds
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    with rocksdb(spark), _set(spark, "spark.sql.shuffle.partitions", str(parts)):
        stream.writeStream.outputMode("append").foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def kept_states(spark: SparkSession, checkpoint: str, batch: int | None = None) -> DataFrame:
    """The state of all sessions in a stream's checkpoint (after a batch, or the last), as it may be handed to another stream: KEPT."""

    def state(name: str) -> DataFrame:
        reader = spark.read.format("statestore").option("stateVarName", name)
        return (reader.option("batchId", batch) if batch is not None else reader).load(checkpoint)

    with rocksdb(spark):
        nothing = {k: F.lit(None).cast(kind).alias(k) for k, kind in _TYPES.items()}
        sessions = state("sessions").select(F.explode("value.sessions").alias("s")).select("s.*")
        kept = sessions.select("session_id", F.lit("counters").alias("part"), F.lit(None).cast("string").alias("path"), *_NAMES)
        for name, held in zip(("read", "edited"), _FILES):
            few = sessions.select("session_id", F.lit(name).alias("part"), F.explode(held).alias("path"), *nothing.values())
            more = state(name).select(F.col("user_map_key.session_id").alias("session_id"), F.lit(name).alias("part"), F.col("user_map_key.path").alias("path"), *nothing.values())
            kept = kept.unionByName(few).unionByName(more)
        # read while the provider is set
        return kept.select(*[c.split()[0] for c in KEPT.split(", ")]).checkpoint()


def without(states: DataFrame, sessions: DataFrame) -> DataFrame:
    """States but those of some sessions: these start anew."""
    return states.join(sessions.select("session_id").distinct(), "session_id", "left_anti").select(states.columns)


def live_rows(log: DataFrame, **options) -> DataFrame:
    """All rows of ``live_states`` over a bounded stream."""
    return run(live_states(log, **options), shared_folder(log.sparkSession, "live"))
