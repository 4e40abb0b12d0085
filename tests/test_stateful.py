"""Sessions with kept state: timers, and state that is read back."""

import pytest
from pyspark.sql import functions as F

from sessionloom.operators import realtime
from sessionloom.streaming import stateful
from sessionloom.streaming.sessions import shared_folder


def rows(*events):
    names = [c.split()[0] for c in realtime.LOG_COLUMNS.split(", ")]
    return [tuple(({"session_id": "s", "success": None} | e).get(n) for n in names) for e in events]


def stream(spark, folder, *parts):
    """A stream of one micro-batch a part."""
    for k, part in enumerate(parts):
        spark.createDataFrame(rows(*part), realtime.LOG_COLUMNS).coalesce(1).write.mode("append").parquet(f"{folder}/{k:03}")
    return reader(spark, folder)


def reader(spark, folder):
    schema = spark.createDataFrame([], realtime.LOG_COLUMNS).schema
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(folder)


def event(id_, ts, type_="llm_request", **more):
    return {"id": id_, "ts_ms": ts, "type": type_, **more}


def test_time_comes_due_by_the_watermark_alone(spark, tmp_path):
    """Session s has two events within five seconds and is silent then; another session's later event moves the watermark."""
    first = [event(1, 1_000, prompt_tokens=10.0), event(2, 6_000, prompt_tokens=20.0)]
    later = [event(9, 3_600_000) | {"session_id": "other"}]
    for timers in (False, True):
        live = stateful.live_states(stream(spark, f"{tmp_path}/{timers}/in", first, later), timers=timers, delay="1 second")
        got = stateful.run(live, f"{tmp_path}/{timers}/out").where("session_id = 's'").orderBy("ts_ms").collect()
        assert [r["id"] for r in got if r["type"] != "timer"] == [1, 2]
        fired = [r for r in got if r["type"] == "timer"]
        assert len(fired) == timers
        if timers:
            assert (fired[0]["reason"], fired[0]["ts_ms"], fired[0]["id"], fired[0]["version"], fired[0]["sum_prompt"]) == ("time", 31_000, None, 2, 30.0)


def test_a_due_time_needs_something_new(spark, tmp_path):
    """After a prediction by tokens nothing is new, so the watermark makes nothing due; an event then starts the wait anew."""
    parts = [[event(1, 1_000), event(2, 2_000, prompt_tokens=9_000.0)], [event(8, 900_000) | {"session_id": "o"}], [event(3, 901_000)], [event(9, 3_600_000) | {"session_id": "o"}]]
    got = stateful.run(stateful.live_states(stream(spark, f"{tmp_path}/in", *parts), timers=True, delay="1 second"), f"{tmp_path}/out")
    assert [(r["id"], r["type"], r["reason"]) for r in got.where("session_id = 's' AND reason IS NOT NULL").orderBy("ts_ms").collect()] == [(2, "llm_request", "tokens"), (3, "llm_request", "time")]


def test_state_ends(spark, tmp_path):
    """A session silent for longer than its state is kept starts anew."""
    parts = [[event(1, 1_000, "tool_call", tool="read_file", path="p")], [event(9, 900_000) | {"session_id": "o"}], [event(2, 950_000, "tool_call", tool="read_file", path="p")]]
    got = stateful.run(stateful.live_states(stream(spark, f"{tmp_path}/in", *parts), keep_ms=60_000, delay="1 second"), f"{tmp_path}/out")
    assert [(r["version"], r["files_read"]) for r in got.where("session_id = 's'").orderBy("ts_ms").collect()] == [(1, 1), (1, 1)]
    assert {r["session_id"] for r in stateful.kept_states(spark, f"{tmp_path}/out/checkpoint").where("part = 'counters'").collect()} <= {"s", "o"}


@pytest.fixture(scope="module")
def events():
    kinds = ["session_start", "tool_call", "llm_request", "edit", "tool_call", "tool_result", "error", "session_end"]
    out = []
    for k in range(120):
        kind = kinds[k * 7 % 8]
        out.append(event(k, 1_000 * (k + 1), kind, session_id=f"s{k % 3}", tool="read_file" if k % 2 else f"t{k % 5}", path=f"p{k % 11}", file=f"f{k % 4}", prompt_tokens=100.0 * k, completion_tokens=1.0, success=k % 6 != 0, model_limit=5000.0 if k % 5 else None))
    return out


COMPARED = "session_id id version sum_prompt sum_completion tool_calls read_files edits retries files_read files_edited limit elapsed_ms recent_tools context_tokens usage".split()


def plain(df):
    return sorted(map(str, df.select(*COMPARED).collect()))


def test_state_read_back(spark, tmp_path, events):
    """Stop after two of four batches, go on in another stream from the kept state: the rows are those of one run, which are those of the batch form."""
    parts = [events[k : k + 30] for k in range(0, 120, 30)]
    whole = stateful.run(stateful.live_states(stream(spark, f"{tmp_path}/all/in", *parts)), f"{tmp_path}/all/out")
    first = stateful.run(stateful.live_states(stream(spark, f"{tmp_path}/a/in", *parts[:2])), f"{tmp_path}/a/out")
    kept = stateful.kept_states(spark, f"{tmp_path}/a/out/checkpoint")
    assert kept.where("part = 'counters'").count() == 3
    second = stateful.run(stateful.live_states(stream(spark, f"{tmp_path}/b/in", *parts[2:]), initial=kept), f"{tmp_path}/b/out")
    assert plain(first.unionByName(second)) == plain(whole)
    log = spark.createDataFrame(rows(*events), realtime.LOG_COLUMNS)
    assert plain(whole) == plain(realtime.running_state(log))
    # predictions, too, come when they would have come
    due = lambda df: sorted((r["id"], r["reason"]) for r in df.where("reason IS NOT NULL").collect())
    assert due(first.unionByName(second)) == due(whole)
    # a session that is left out starts at its first version
    fresh = stateful.without(kept, spark.createDataFrame([("s1",)], "session_id string"))
    third = stateful.run(stateful.live_states(stream(spark, f"{tmp_path}/c/in", *parts[2:]), initial=fresh), f"{tmp_path}/c/out")
    began = {r["session_id"]: r["v"] for r in third.groupBy("session_id").agg(F.min("version").alias("v")).collect()}
    assert began == {"s0": 21, "s1": 1, "s2": 21}
    # an earlier batch's state
    early = stateful.kept_states(spark, f"{tmp_path}/a/out/checkpoint", 0).where("part = 'counters'").collect()
    assert {r["version"] for r in early} == {10}


def test_setting_comes_back(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    with stateful.rocksdb(spark):
        assert spark.conf.get(name) == stateful.PROVIDER
    assert spark.conf.get(name, None) == before and shared_folder(spark, "x")


class Held:
    """A value or a map of a state store that counts what it is asked."""

    def __init__(self, *_):
        self.value, self.entries, self.asked = None, {}, 0

    def get(self):
        self.asked += 1
        return self.value

    def update(self, value):
        self.asked += 1
        self.value = value

    def clear(self):
        self.asked, self.value = self.asked + 1, None

    def keys(self):
        return iter(list(self.entries))

    def containsKey(self, key):
        return key in self.entries

    def updateValue(self, key, value):
        self.entries[key] = value

    def removeKey(self, key):
        del self.entries[key]


class Handle:
    def __init__(self):
        self.timers = set()
        self.getValueState = self.getMapState = Held
        self.registerTimer, self.deleteTimer = self.timers.add, self.timers.remove


class Now:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: ms


def test_a_key_of_many_sessions_asks_the_store_twice(monkeypatch):
    """Fifty sessions of a key: one read and one write of their states. Files beyond the bound are in a map, are counted once whenever they come, and go with their session."""
    pd = pytest.importorskip("pandas")
    from sessionloom.streaming.sessions import _EVENT

    monkeypatch.setattr(stateful, "READ_AT_ONCE", 4)
    handle, live = Handle(), stateful.LiveSession(5, 5000, 30_000, 60_000, False)
    live.init(handle)

    def batch(watermark, *events):
        frame = pd.DataFrame([{c: e.get(c) for c in ["session_id", *_EVENT]} for e in events])
        return {r.id: r for out in live.handleInputRows((1,), iter([frame]), Now(watermark)) for r in out.itertuples()}

    got = batch(0, *[event(100 * s + k, 1_000 + k, "tool_call", session_id=f"s{s}", tool="read_file", path=f"p{k % (6 if s == 7 else 3)}") for s in range(50) for k in range(8)])
    assert live.held.asked == 2 and len(got) == 400 and {r.files_read for i, r in got.items() if i % 100 == 7} == {3, 6}
    assert {k[0] for k in live.read.entries} == {"s7"} and len(live.read.entries) == 6 and handle.timers == {61_007}
    got = batch(0, event(9_000, 2_000, "tool_call", session_id="s7", tool="read_file", path="p1"), event(9_001, 2_001, "tool_call", session_id="s7", tool="read_file", path="new"))
    assert (got[9_000].files_read, got[9_001].files_read, got[9_001].version) == (6, 7, 10)
    assert list(live.handleExpiredTimer((1,), Now(61_500), Now(61_007))) == [] and [row[0] for row in live.held.value[0]] == ["s7"] and handle.timers >= {62_001}
    list(live.handleExpiredTimer((1,), Now(62_001), Now(62_001)))
    assert live.held.value is None and not live.read.entries


def test_states_of_a_key_are_handed_over_in_parts():
    """State to begin with comes in several frames, files before counters: all of it is there, and the next event goes on from it."""
    pd = pytest.importorskip("pandas")
    from sessionloom.streaming.sessions import _EVENT

    names = [c.split()[0] for c in stateful.KEPT.split(", ")]
    known = {c: 0 for c in stateful._NAMES} | {"recent_tools": ["a"], "limit": 8.0, "named": "Idle", "thought": False, "ended": False, "phase": None, "first_ms": 1, "last_ms": 9, "due_at": 5, "ends_at": 70, "since_ms": 1, "version": 4, "files_read": 2}
    rows = [{"session_id": f"s{s}", "part": part, "path": path} | (known if part == "counters" else {}) for s in range(3) for part, path in (("read", "p"), ("read", "q"), ("counters", None))]
    handle, live = Handle(), stateful.LiveSession(5, 5000, 30_000, 60_000, False)
    live.init(handle)
    for k in range(0, 9, 2):
        live.handleInitialState((1,), pd.DataFrame(rows[k : k + 2], columns=names), Now(0))
    assert [row[0] for row in live.held.value[0]] == ["s0", "s1", "s2"] and not handle.timers
    frame = pd.DataFrame([{c: event(7, 10, "tool_call", session_id="s1", tool="read_file", path=path).get(c) for c in ["session_id", *_EVENT]} for path in ("q", "r")])
    got = [r for out in live.handleInputRows((1,), iter([frame]), Now(0)) for r in out.itertuples()]
    assert [(r.version, r.files_read) for r in got] == [(5, 2), (6, 3)]
