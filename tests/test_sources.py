"""Raw logs to events."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from sessionloom.operators import canonical
from sessionloom.sources import agent_logs, chat_patches, session_store, tables, transcripts, workspace


def lines(spark, items):
    text = [x if isinstance(x, str) else json.dumps(x) for x in items]
    return spark.createDataFrame([(t, "given", 7) for t in text], "value string, session_id string, modified_ms bigint")


def debug(type_, name="n", status="ok", attrs=None, **more):
    return {"ts": 1784197530000, "dur": 1200, "sid": "real", "type": type_, "name": name, "status": status, "attrs": attrs or {}, **more}


def test_debug_log(spark):
    edit = json.dumps([{"role": "a", "parts": [{"type": "tool_call", "name": "edit_file", "arguments": json.dumps({"filePath": "/tmp/x.ts"})}]}])
    got = agent_logs.parse(
        lines(spark, [debug("llm_request", attrs={"model": "m", "inputTokens": 23995, "outputTokens": 163, "cachedTokens": 23680}), debug("tool_call", "run_in_terminal", "error"), debug("agent_response", attrs={"response": edit}), debug("turn_start"), "not json"])
    ).collect()
    by = {r["type"]: r for r in got}
    assert set(by) == {"llm_request", "tool_call", "edit"}
    assert (by["llm_request"]["prompt_tokens"], by["llm_request"]["completion_tokens"], by["llm_request"]["cached_tokens"], by["llm_request"]["session_id"]) == (23995, 163, 23680, "real")
    assert by["tool_call"]["success"] is False and by["tool_call"]["tool"] == "run_in_terminal"
    assert by["edit"]["file"] == "/tmp/x.ts" and by["edit"]["diff_lines"] == 0


def test_broken_edit(spark):
    broken = '[{"parts": [{"name": "edit_file", "arguments": "{\\"filePath\\": \\"/tmp/y.ts\\", \\"code\\": \\"a\\\\nb\\\\nc'
    row = agent_logs.parse(lines(spark, [debug("agent_response", attrs={"response": broken})])).first()
    assert row["file"] == "/tmp/y.ts" and row["diff_lines"] == 2


def test_legacy_log(spark):
    got = agent_logs.parse(lines(spark, [{"kind": "request", "promptTokens": 1500, "completionTokens": 300}, {"type": "heartbeat"}, {"type": "file_edit", "file": "a", "diffLines": 3}, {"kind": "session_start"}])).collect()
    by = {r["type"]: r for r in got}
    assert (by["llm_request"]["prompt_tokens"], by["llm_request"]["completion_tokens"], by["llm_request"]["ts_ms"]) == (1500, 300, 7)
    assert set(by) == {"llm_request", "edit", "session_start"} and by["session_start"]["model_limit"] == 256000


def test_arguments(spark):
    rows = spark.createDataFrame([('{"a":1}',), ("plain",)], "s string").select(F.to_json(agent_logs.arguments(F.col("s"))).alias("j")).collect()
    assert [json.loads(r["j"]) for r in rows] == [{"a": 1}, {"raw": "plain"}]


def test_bridges(spark):
    log = spark.createDataFrame([(1, 1, "s", "llm_request", None, None), (2, 2, "s", "edit", None, False), (3, 3, "s", "edit", None, True), (4, 4, "s", "tool_call", "run_test", True), (5, 5, "s", "tool_call", "x_terminal", True), (6, 6, "s", "llm_request", None, None)], "id bigint, ts_ms bigint, session_id string, type string, tool string, success boolean")
    assert [r["event_type"] for r in canonical.bridge_one_row(log).orderBy("id").collect()] == ["completion", "retry", "accept", "run_test", "terminal", "completion"]
    twice = canonical.bridge_with_chat(log).orderBy("id", "ordinal").collect()
    assert [r["event_type"] for r in twice] == ["chat", "completion", "retry", "accept", "run_test", "terminal", "chat", "completion"]
    assert [r["prompt_id"] for r in twice if r["prompt_id"]] == ["s-p1", "s-p1", "s-p2", "s-p2"]


def test_chat_patches(spark):
    request = {"requestId": "r1", "timestamp": 100, "modelId": "auto", "message": {"text": "hi"}, "response": [{"kind": "other"}, {"kind": "autoModeResolution", "resolvedModel": "m", "predictedLabel": "needs_reasoning", "confidence": 0.43}], "result": {"timings": {"totalElapsed": 8808}, "metadata": {"promptTokens": 19023, "outputTokens": 473}}}
    patches = [{"kind": 0, "v": {"sessionId": "c1", "requests": []}}, {"kind": 2, "k": ["requests"], "v": [request]}, {"kind": 1, "k": ["customTitle"], "v": "Title"}, {"kind": 1, "k": ["requests", 0, "state"], "v": 1}, {"kind": 2, "k": ["requests"], "v": {"requestId": "r2", "timestamp": 200}}]
    text = "\n".join([*map(json.dumps, patches), "broken {"])
    states = chat_patches.replay(spark.createDataFrame([("f", text), ("e", "")], "file string, value string")).cache()
    assert states.count() == 1
    head = chat_patches.sessions(states).first()
    assert (head["session_id"], head["title"], head["requests"]) == ("c1", "Title", 2)
    asked = chat_patches.requests(states)
    row = asked.where("request_id = 'r1'").first()
    assert (row["prompt_tokens"], row["output_tokens"], row["auto_label"], row["auto_confidence"], row["resolved_model"]) == (19023, 473, "needs_reasoning", 0.43, "m")
    assert chat_patches.auto_signals(asked).first()["auto_label"] == "needs_reasoning"
    assert [r["event_type"] for r in chat_patches.request_events(asked, "w").orderBy("ts_ms").collect()] == ["chat", "completion", "session_end", "chat"]


def test_models(spark):
    model = {"id": "gpt-5.4", "name": "n", "vendor": "v", "capabilities": {"family": "gpt-5"}, "billing": {"token_prices": {"batch_size": 1_000_000, "default": {"input_price": 50, "output_price": 150, "cache_price": 27}}}}
    catalog = workspace.models(spark.createDataFrame([("f", json.dumps([model]))], "file string, value string"))
    wanted = spark.createDataFrame([("gpt-5.4",), ("some-prefix-gpt-5.4-suffix",), ("other",)], "model string")
    found = workspace.find_models(wanted, catalog)
    assert {r["model"]: r["model_id"] for r in found.collect()} == {"gpt-5.4": "gpt-5.4", "some-prefix-gpt-5.4-suffix": "gpt-5.4", "other": None}
    priced = found.join(catalog, found.model_id == catalog.id, "left").select("model", workspace.cost(F.lit(1000.0), F.lit(500.0), F.lit(0.0)).alias("c"), workspace.cost(F.lit(1000.0), F.lit(500.0), F.lit(500.0)).alias("d"))
    got = {r["model"]: (r["c"], r["d"]) for r in priced.collect()}
    assert got["gpt-5.4"] == pytest.approx((0.125, 0.1135)) and got["other"] == (0, 0)


def test_tools_and_prompts(spark):
    names = ["read_file", "open_browser_page", "run_in_terminal", "semantic_search", "mystery"]
    files = spark.createDataFrame([("t", json.dumps({"content": json.dumps([{"name": n} for n in names])}))], "file string, value string")
    assert {r["category"]: r["n"] for r in workspace.tool_histogram(workspace.tools(files)).collect()} == {"file": 1, "browser": 1, "terminal": 1, "search": 1, "unknown": 1}
    text = "<skill>\n<name>chronicle</name>\n<description>d</description>\n<file>f</file>\n</skill> <skill><name>chronicle</name><description>later</description></skill> <agent><name>Explore</name><description>x</description></agent>"
    prompts = workspace.prompt_texts(spark.createDataFrame([("p", json.dumps({"content": json.dumps([{"content": text}])}))], "file string, value string"))
    assert [(r["name"], r["description"]) for r in workspace.skills(prompts).collect()] == [("chronicle", "d")]
    assert [r["name"] for r in workspace.subagents(prompts).collect()] == ["Explore"]


def test_editing_state_and_host_log(spark):
    state = {"version": 2, "timeline": {"checkpoints": [{"checkpointId": "a", "epoch": 0}, {"checkpointId": "b", "epoch": 1, "requestId": "r"}], "currentEpoch": 2, "epochCounter": 2, "operations": [], "fileBaselines": []}}
    rows = workspace.editing_states(spark.createDataFrame([("x", json.dumps(state)), ("y", "not json")], "file string, value string")).collect()
    assert len(rows) == 1 and rows[0]["current_epoch"] == 2 and [c["checkpointId"] for c in rows[0]["checkpoints"]] == ["a", "b"]
    text = ["2026-07-13 08:10:26.075 [info] start", "x Chat: 0.56.0, VS Code: 1.128.0", "token sku: free", "MCP server started.", "[code-referencing] Public code references are enabled.", "activationBlocker from 'f' took for 279ms"]
    row = workspace.host_logs(spark.createDataFrame([("l", i, t) for i, t in enumerate(text)], "file string, line_no int, value string")).first()
    assert (row["first_seen"], row["agent_version"], row["editor_version"], row["token_sku"], row["activation_blocker_ms"], row["mcp_server_started"], row["code_referencing_enabled"]) == ("2026-07-13 08:10:26.075", "0.56.0", "1.128.0", "free", 279, True, True)


def test_transcripts(spark):
    def at(s, type_, **data):
        return {"type": type_, "timestamp": f"2026-07-16T14:25:{s:02d}.000Z", "data": data}

    items = [
        at(0, "session.start", sessionId="t1", producer="p", copilotVersion="0.57.0", vscodeVersion="1.129.0"), at(1, "user.message", content="hello"),
        at(2, "assistant.message", content="ok", toolRequests=[{"name": "read_file", "toolCallId": "c1", "arguments": "{}"}]), at(3, "tool.execution_start", toolCallId="c1", toolName="read_file", arguments={"filePath": "a.ts"}),
        at(5, "tool.execution_complete", toolCallId="c1", success=True), at(6, "tool.execution_start", toolCallId="c2", toolName="create_file", arguments={"filePath": "b.ts"}), at(7, "tool.execution_complete", toolCallId="c2", success=False), at(8, "tool.execution_complete", toolCallId="c9", success=True),
    ]
    rows = spark.createDataFrame([("/x/file1.jsonl", i, json.dumps(e)) for i, e in enumerate(items)] + [("/x/file1.jsonl", 99, "bad")], "file string, line_no int, value string")
    typed = transcripts.entries(rows)
    life = transcripts.lifecycle(typed).first()
    assert (life["session_id"], life["agent_version"], life["editor_version"], life["entries"]) == ("t1", "0.57.0", "1.129.0", 8)
    got = transcripts.transcript_events(typed).orderBy("ts_ms", "line_no", "ordinal").collect()
    assert [r["event_type"] for r in got] == ["session_start", "chat", "tool_call", "completion", "read_file", "accept", "retry", "session_end"]
    assert got[5]["duration_ms"] == 2000 and got[6]["file"] == "b.ts"


def test_session_store(spark, tmp_path):
    path = str(tmp_path / "store.db")
    db = sqlite3.connect(path)
    db.executescript("CREATE TABLE sessions (id TEXT, workspace_id TEXT, created_at, updated_at, repository TEXT, cwd TEXT); CREATE TABLE turns (session_id TEXT, turn_index INT, user_message TEXT, assistant_response TEXT, timestamp); CREATE TABLE session_files (session_id TEXT, file_path TEXT, first_seen_at)")
    db.execute("INSERT INTO sessions VALUES ('s1', NULL, '2024-01-01T00:00:00.000Z', '2024-01-01T00:00:05.000Z', 'aea', '/x')")
    db.execute("INSERT INTO turns VALUES ('s1', 0, 'refactor', 'OK', '2024-01-01T00:00:01.000Z')")
    db.execute("INSERT INTO session_files VALUES ('s1', 'src/u.ts', '2024-01-01T00:00:00.500Z')")
    db.commit()
    db.close()
    got = session_store.store_events(session_store.sessions(spark, [path]), session_store.turns(spark, [path]), session_store.session_files(spark, [path])).orderBy("ts_ms", "ordinal").collect()
    assert [r["event_type"] for r in got] == ["session_start", "read_file", "chat", "completion", "session_end"]
    assert got[0]["workspace_id"] == "repo:aea" and got[3]["ts_ms"] - got[2]["ts_ms"] == 1


def test_tables(spark, tmp_path):
    root = str(tmp_path)
    tables.write(spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int"), root, "labels")
    tables.upsert_table(spark.createDataFrame([("b", 2), ("c", 3)], "k string, v int"), root, "labels", ["k"])
    assert sorted(map(tuple, tables.read(spark, root, "labels").collect())) == [("a", 1), ("b", 2), ("c", 3)]
    rows = tables.feedback(spark.createDataFrame([("x", "mini", 0.9), ("y", "mini", 0.2), ("z", "mini", 0.6)], "session_id string, predicted string, score double"))
    assert {r["session_id"]: r["label"] for r in rows.collect()} == {"x": "mini", "y": "medium"}
    tables.write_training_csv(tables.synthetic_sizes(spark, 20), root + "/csv")
    assert spark.read.option("header", "true").csv(root + "/csv").count() == 20


def test_tool_categories_and_tags(spark):
    from sessionloom.plans.source_queries import TOOL_SAMPLES

    got = spark.createDataFrame([(n,) for n in TOOL_SAMPLES], "name string").select("name", workspace.tool_category(F.col("name")).alias("c")).collect()
    assert {r["name"]: r["c"] for r in got} == TOOL_SAMPLES
    text = "<skill><name>a</name><file>f</file></skill><skill><description>x</description></skill><skill><name>a</name></skill><skill><name>b"
    rows = workspace.skills(spark.createDataFrame([("p", text)], "file string, text string")).collect()
    assert [(r["name"], r["description"], r["skill_file"]) for r in rows] == [("a", None, "f")]
