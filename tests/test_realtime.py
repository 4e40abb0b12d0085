"""State, rules, phases, health, advice and triggers; streams against the batch form."""

import json
import os
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sessionloom.operators import canonical, features, realtime
from sessionloom.sources import agent_logs, tables
from sessionloom.sources.logged import Store

T = 1_700_000_000_000


def log(spark, events, session="s"):
    names = [c.split()[0] for c in realtime.LOG_COLUMNS.split(", ")]
    rows = [{"id": i + 1, "ts_ms": T + 1000 * i, "session_id": session, **e} for i, e in enumerate(events)]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], realtime.LOG_COLUMNS)


def fired(spark, events, rules=None):
    return sorted(r["rule_id"] for r in realtime.alerts(realtime.running_state(log(spark, events)), rules).collect())


CALL = {"type": "tool_call", "tool": "grep", "success": True}
READ = {"type": "tool_call", "tool": "read_file", "path": "a", "success": True}


@pytest.mark.parametrize(
    "events, rule, times",
    [
        ([{"type": "llm_request", "prompt_tokens": 80.0, "completion_tokens": 0.0}], "context-too-large", 1),
        ([{"type": "llm_request", "prompt_tokens": 79.0, "completion_tokens": 0.0}], "context-too-large", 0),
        ([READ] * 20, "read-file-storm", 1),
        ([READ] * 19, "read-file-storm", 0),
        ([READ, {**CALL, "tool": "edit"}] * 4, "tool-loop", 1),
        ([READ, {**CALL, "tool": "edit"}] * 3, "tool-loop", 0),
        ([{**CALL, "success": False}] * 3, "retry-spike", 1),
        ([{**CALL, "success": False}] * 2, "retry-spike", 0),
        ([{"type": "llm_request", "prompt_tokens": 1000.0}, {"type": "llm_request", "prompt_tokens": 11000.0}], "prompt-explosion", 1),
        ([{"type": "edit", "file": "a", "diff_lines": 100.0}], "large-diff", 1),
        ([{"type": "edit", "file": "a", "diff_lines": 99.0}], "large-diff", 0),
        ([{"type": "llm_request", "model": "some-Sonnet-4"}], "model-switch", 1),
        ([{"type": "llm_request", "model": "base"}], "model-switch", 0),
    ],
)
def test_rules(spark, events, rule, times):
    limit = 100.0 if rule == "context-too-large" else 1e9
    assert fired(spark, [{"type": "session_start", "model_limit": limit}, *events]).count(rule) == times


def test_custom_thresholds_and_severity(spark):
    rules = realtime.default_rules(realtime.RuleLimits(reads=2, retries=1))
    assert fired(spark, [READ, READ, {**CALL, "success": False}], rules) == ["read-file-storm", "retry-spike"]
    start = {"type": "session_start", "model_limit": 100.0}
    states = realtime.running_state(log(spark, [start, {"type": "llm_request", "prompt_tokens": 95.0}]))
    assert realtime.alerts(states).where("rule_id = 'context-too-large'").first()["severity"] == "critical"


def test_scenario(spark):
    lines = spark.createDataFrame([(x, "demo", 0) for x in tables.scenario_lines()], "value string, session_id string, modified_ms bigint")
    events = agent_logs.parse(lines).withColumn("id", F.monotonically_increasing_id()).withColumn("sub_agents", F.lit(None).cast("double"))
    last = realtime.final_state(realtime.running_state(events)).first()
    assert (last["sum_prompt"], last["sum_completion"], last["tool_calls"], last["read_files"], last["edits"], last["retries"]) == (16000, 2400, 6, 5, 4, 2)


def phase_fold(types):
    phase, out = "Idle", []
    for t in types:
        if t in realtime.ABSOLUTE_PHASES:
            phase = realtime.ABSOLUTE_PHASES[t]
        elif t == "llm_request" and phase == "Planning":
            phase = "Thinking"
        elif t == "session_end" and phase != "Failed":
            phase = "Finished"
        out.append(phase)
    return out


KINDS = ["session_start", "llm_request", "tool_call", "tool_result", "edit", "review", "session_end", "error", "other"]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(KINDS), min_size=1, max_size=12), min_size=8, max_size=16))
def test_phases_agree_with_a_fold(spark, sequences):
    all_ = None
    for n, types in enumerate(sequences):
        part = log(spark, [{"type": t} for t in types], f"s{n}")
        all_ = part if all_ is None else all_.unionAll(part)
    got = {}
    for r in realtime.phases(all_.coalesce(1)).select("session_id", "id", "phase").collect():
        got.setdefault(r["session_id"], {})[r["id"]] = r["phase"]
    for n, types in enumerate(sequences):
        ends = [k for k, t in enumerate(types) if t == "session_end"]
        want = phase_fold(types)
        # after an end, an unnamed event keeps the phase that the end gave
        assert [got[f"s{n}"][i + 1] for i in range(len(types))] == want, (types, ends)


def trigger_fold(rows, max_events=5, max_tokens=5000, max_ms=30_000):
    ts, version, tokens, out = rows[0][0], 0, 0.0, []
    for t, i, v, k in rows:
        if v - version >= max_events:
            reason = "events"
        elif k - tokens >= max_tokens:
            reason = "tokens"
        elif t - ts >= max_ms and v > version:
            reason = "time"
        else:
            continue
        out.append((i, reason))
        ts, version, tokens = t, v, k
    return out


def test_triggers_agree_with_a_fold(spark):
    events = [{"type": "llm_request", "prompt_tokens": float(100 * (i % 7) ** 3), "ts_ms": T + 4000 * i * (1 + i % 3)} for i in range(40)]
    states = realtime.running_state(log(spark, events))
    rows = [(r["ts_ms"], r["id"], r["version"], r["context_tokens"]) for r in states.orderBy("ts_ms", "id").collect()]
    got = [(r["id"], r["reason"]) for r in realtime.prediction_triggers(states).orderBy("id").collect()]
    assert got == sorted(trigger_fold(rows))


def test_health_and_advice(spark):
    small = realtime.final_state(realtime.running_state(log(spark, [{"type": "session_start"}, {"type": "llm_request", "prompt_tokens": 100.0}])))
    assert realtime.health(small).first()["health_label"] == "Excellent"
    assert realtime.advice(small).first()["model"] == "mini"
    votes = {r["source"]: r["model"] for r in realtime.predictions(small, F.lit(100)).collect()}
    assert votes == {"rule": "mini", "heuristic": "mini"}
    text = realtime.render_timeline(realtime.timeline(log(spark, [{"type": "session_start"}, {"type": "error"}]))).first()["timeline"]
    assert len(text.splitlines()) == 2 and "Failed" in text


def write_log(folder, name, events, session="s1"):
    (folder / session).mkdir(parents=True, exist_ok=True)
    (folder / session / name).write_text("".join(json.dumps({"type": e["type"], "timestamp": T + e["at"], "sessionId": session, **{k: v for k, v in e.items() if k not in ("type", "at")}}) + "\n" for e in events))


def test_stream_state_equals_batch(spark, tmp_path):
    from sessionloom.streaming import sessions

    logs = tmp_path / "logs"
    for s in ("s1", "s2"):
        write_log(logs, "a.jsonl", [{"type": "session_start", "at": 0}, {"type": "llm_request", "at": 10, "promptTokens": 500, "completionTokens": 20}, {"type": "tool", "at": 20, "tool": "read_file"}], s)
    stream = sessions.log_stream(spark, str(logs)).withColumn("id", F.col("ts_ms"))
    query = sessions.session_state(stream).writeStream.format("memory").queryName("states").outputMode("update").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    query.awaitTermination()
    write_log(logs, "b.jsonl", [{"type": "edit", "at": 30, "file": "x", "success": False}, {"type": "session_end", "at": 40}], "s1")
    rows = {r["session_id"]: r for r in spark.table("states").where("NOT closed").collect()}
    batch = agent_logs.parse(agent_logs.read_lines(spark, str(logs))).where("ts_ms < %d" % (T + 30)).withColumn("id", F.col("ts_ms")).withColumn("sub_agents", F.lit(None).cast("double"))
    want = {r["session_id"]: r for r in realtime.final_state(realtime.running_state(batch)).collect()}
    assert set(rows) == set(want) == {"s1", "s2"}
    for s in want:
        assert all(rows[s][c] == want[s][c] for c in ("sum_prompt", "sum_completion", "tool_calls", "read_files", "edits", "retries", "context_tokens"))


def test_event_store_stream(spark, tmp_path):
    from sessionloom.streaming import sessions

    logs = tmp_path / "logs"
    write_log(logs, "a.jsonl", [{"type": "session_start", "at": 0}, {"type": "request", "at": 10, "promptTokens": 500}, {"type": "edit", "at": 20, "file": "x"}, {"type": "session_end", "at": 40}])
    stream = sessions.log_stream(spark, str(logs)).withColumn("id", F.col("ts_ms"))
    root = str(tmp_path / "store")
    sessions.start_event_store(stream, root, str(tmp_path / "c")).awaitTermination()
    store = Store(spark, root)
    kinds = [r["event_type"] for r in store.read("events").orderBy("ts_ms", "ordinal").collect()]
    assert kinds == ["session_start", "chat", "completion", "accept", "session_end"]
    assert store.read("features").first()["accept_rate"] == 1
    # the session goes on the next day and ends again: one row of features, over both days
    write_log(logs, "b.jsonl", [{"type": "request", "at": 86_400_010, "promptTokens": 7}, {"type": "edit", "at": 86_400_020, "file": "y"}, {"type": "session_end", "at": 86_400_040}])
    sessions.start_event_store(stream, root, str(tmp_path / "c")).awaitTermination()
    rows = store.read("features").collect()
    assert len(rows) == 1 and store.read("events").count() == 9
    whole = features.session_view(canonical.complete(store.read("events"))).first()
    assert rows[0].asDict() == whole.asDict()
    assert [tuple(r) for r in store.read("sessions").select("first", "last").collect()] == [("2023-11-14", "2023-11-15")]


def test_stream_alerts_over_several_batches(spark, tmp_path):
    from sessionloom.streaming import sessions

    logs = tmp_path / "logs"
    files = [[{"type": "tool", "at": 10 * n, "tool": "run", "success": False}, {"type": "request", "at": 10 * n + 5, "promptTokens": 60_000}] for n in range(4)]
    for n, events in enumerate(files):
        write_log(logs, f"{n}.jsonl", events)
    order = sorted((logs / "s1").iterdir())
    for n, f in enumerate(order):
        os.utime(f, (1_700_000_000 + n, 1_700_000_000 + n))
    stream = sessions.log_stream(spark, str(logs), files_per_trigger=1).withColumn("id", F.col("ts_ms"))
    got, batches = [], []

    def sink(batch, number):
        batches.append(number)
        got.extend((r["rule_id"], r["id"], r["severity"], r["message"]) for r in batch.collect())

    sessions.start_alerts(stream, sink, str(tmp_path / "c")).awaitTermination()
    batch = agent_logs.parse(agent_logs.read_lines(spark, str(logs))).withColumns({"id": F.col("ts_ms"), "sub_agents": F.lit(None).cast("double")})
    want = [(r["rule_id"], r["id"], r["severity"], r["message"]) for r in realtime.alerts(realtime.running_state(batch)).collect()]
    assert len(set(batches)) >= 4 and sorted(got) == sorted(want)
    assert [x[0] for x in got].count("retry-spike") == 2 and ("context-too-large" in [x[0] for x in got])


def test_event_states_equal_running_state_and_phases(spark, tmp_path):
    from sessionloom.streaming import sessions

    kinds = ["session_start", "llm_request", "tool_call", "tool_result", "edit", "review", "error", "session_end", "other"]
    rng = random.Random(4)
    rows = []
    for k in range(240):
        kind = rng.choice(kinds)
        rows.append((k, T + 100 * k + rng.randrange(2), f"s{k % 3}", kind, rng.choice(["read_file", "run", None, "grep"]), rng.choice(["a", "b", "", None]), rng.choice(["x", "y", None]), rng.choice([10.0, None, 20_000.0]), 5.0, "m", rng.choice([None, 1000.0]), rng.choice([True, False, None]), 3.0, rng.choice([None, 1.0])))
    schema = realtime.LOG_COLUMNS
    for n in range(4):
        spark.createDataFrame(rows[60 * n : 60 * n + 60], schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(n)))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    sessions.event_states(stream).writeStream.foreachBatch(lambda b, n: b.write.parquet(str(tmp_path / "out" / f"batch={n}"))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    whole = spark.createDataFrame(rows, schema)
    want = realtime.running_state(whole).join(realtime.phases(whole).select("id", "phase", "is_transition", "planning_run"), "id")
    names = [c.split()[0] for c in sessions.EVENT_STATES.split(", ")]
    got = spark.read.parquet(str(tmp_path / "out")).select(names)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*[F.col(c).cast(t).alias(c) for c, t in got.dtypes]).collect()))
