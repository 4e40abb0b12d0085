"""Summaries, scans, registries and texts."""

import json

import pytest
from pyspark.sql import functions as F

from sessionloom.operators import canonical, plugins, realtime
from sessionloom.plans import analysis
from tests.test_features import EXPLODE, GOOD, RETRY, rows_of


def test_summary_and_registry(spark):
    events = canonical.from_rows(spark, rows_of("good", GOOD) + rows_of("retry", RETRY) + rows_of("explode", EXPLODE)).cache()
    row = analysis.summary(events).first()
    assert (row["sessions"], row["failed_sessions"], row["top_failure"], row["top_start"], row["health_direction"]) == (3, 2, "retry_loop", "session_start", "stable")
    registry = plugins.core_registry()
    assert registry.analyze(events)["workflow.edges"].count() == 13
    with pytest.raises(ValueError):
        registry.add_rule(realtime.default_rules()[0])
    registry.remove("roi")
    assert "roi.contributions" not in registry.analyze(events)
    registry.add_measure("twice", F.col("id") * 2)
    assert registry.measured(events).where("twice <> 2 * id").count() == 0
    assert "sessions: 3" in analysis.render_rows("Summary", [row])


def test_scan(spark, tmp_path):
    for folder in ("chats", "tools", "runs", "host"):
        (tmp_path / folder).mkdir()
    (tmp_path / "chats" / "a.jsonl").write_text(json.dumps({"kind": 0, "v": {"sessionId": "c", "requests": [{"requestId": "r", "timestamp": 5}]}}))
    (tmp_path / "tools" / "t.json").write_text(json.dumps({"content": json.dumps([{"name": "read_file"}])}))
    (tmp_path / "runs" / "r.jsonl").write_text(json.dumps({"type": "session.start", "timestamp": "2026-07-16T14:25:34.091Z", "data": {"sessionId": "t"}}) + "\n\n")
    (tmp_path / "host" / "h.log").write_text("2026-07-13 08:10:26.075 [info] x\ntoken sku: free\n")
    got = analysis.scan(spark, chats=str(tmp_path / "chats"), tools=str(tmp_path / "tools"), runs=str(tmp_path / "runs"), host=str(tmp_path / "host"))
    assert got["chat_sessions"].first()["session_id"] == "c" and got["tools"].first()["category"] == "file" and got["host_logs"].first()["token_sku"] == "free"
    assert [r["event_type"] for r in got["transcript_events"].orderBy("line_no").collect()] == ["session_start", "session_end"]


def test_line_numbers(spark, tmp_path):
    """Lines keep their numbers where a file is read in many splits."""
    (tmp_path / "a.log").write_text("".join(f"line {k}\r\n" if k % 2 else f"line {k}\n" for k in range(3000)) + "\nlast")
    (tmp_path / "b.log").write_text("one\n\nthree")
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "1000")
    try:
        got = analysis._lines(spark, str(tmp_path), "*.log").collect()
    finally:
        spark.conf.set(name, before)
    rows = {(r["file"].rpartition("/")[2], r["line_no"]): r["value"] for r in got}
    assert [rows["a.log", k] for k in range(3002)] == [f"line {k}" for k in range(3000)] + ["", "last"]
    assert [rows["b.log", k] for k in range(3)] == ["one", "", "three"] and len(rows) == 3005


def test_evaluator(spark):
    row = spark.createDataFrame([('a """quoted""" task', 2, 1, "d")], "task string, tool_calls int, files int, final_diff string").select(analysis.evaluator_prompt()).first()[0]
    assert 'a "quoted" task' in row
    answers = spark.createDataFrame([('```json\n{"complexity": 3, "smallerModelPossible": true}\n```',), ("none",)], "a string").select(analysis.parse_evaluation(F.col("a")).alias("e")).collect()
    assert answers[0]["e"]["complexity"] == 3 and answers[1]["e"] is None


def test_catalog(spark):
    known = canonical.catalog(spark)
    assert canonical.by_provider(known, "git").count() == 1
    events = spark.createDataFrame([("edit", "{}"), ("edit", '{"file":"a"}')], "event_type string, json string")
    assert [r["missing"] for r in canonical.missing_fields(events, known).collect()] == [["file"], []]
