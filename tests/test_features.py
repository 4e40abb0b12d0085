"""The three core sessions and their expected features."""

import pytest
from pyspark.sql import functions as F

from sessionloom.operators import canonical, features, graph, mining, modelsize, vectors

T = 1_700_000_000_000
START = '{"model":"base","languages":["TypeScript"],"dependencies":["react"]}'
GOOD = [
    ("session_start", START), ("read_file", '{"path":"src/index.ts"}'), ("read_file", '{"path":"src/utils.ts"}'),
    ("chat", '{"promptId":"p1","tokenCount":1000,"retrievedFiles":2,"contextToken":1200,"historyToken":0}'), ("completion", '{"tokenCount":300}'),
    ("accept", None), ("edit", '{"file":"src/index.ts"}'), ("commit", '{"branch":"main","author":"tester"}'), ("session_end", None),
]
RETRY = [
    ("session_start", START), ("chat", '{"promptId":"p2","tokenCount":3000,"retrievedFiles":5,"contextToken":4000,"historyToken":800}'),
    ("completion", '{"tokenCount":600}'), ("retry", None), ("retry", None), ("retry", None), ("reject", None), ("session_end", None),
]
EXPLODE = [
    ("session_start", START), ("read_file", '{"path":"README.md"}'), ("read_file", '{"path":"package.json"}'), ("read_file", '{"path":"tsconfig.json"}'), ("read_file", '{"path":"src/store/schema.ts"}'),
    ("chat", '{"promptId":"p3","tokenCount":8000,"retrievedFiles":10,"contextToken":12000,"historyToken":0}'), ("completion", '{"tokenCount":1500}'), ("retry", None), ("reject", None), ("session_end", None),
]


def rows_of(session, events, workspace="ws-test"):
    return [(T + i, session, workspace, kind, meta) for i, (kind, meta) in enumerate(events)]


@pytest.fixture(scope="module")
def events(spark):
    return canonical.from_rows(spark, rows_of("good", GOOD) + rows_of("retry", RETRY) + rows_of("explode", EXPLODE)).cache()


def by(df, key="session_id"):
    return {r[key]: r.asDict() for r in df.collect()}


def test_session_features(events):
    got = by(features.session_features(events))
    assert [got[s]["duration"] for s in ("good", "retry", "explode")] == [8, 7, 9]
    assert [got[s]["accept_rate"] for s in ("good", "retry", "explode")] == [1, 0, 0]
    assert [got[s]["retry_rate"] for s in ("good", "retry", "explode")] == [0, 3, 1]


@pytest.mark.parametrize(
    "column, good, retry, explode",
    [
        ("avg_read_before_ask", 1, 0, 2), ("avg_retry_distance", 0, 1, 0), ("tool_switch_frequency", 0.875, 0.714, 0.667), ("context_expansion_speed", 144.444, 450, 950),
        ("workflow_entropy", 0.930, 0.802, 0.759), ("retry_burst_score", 0, 1, 1), ("edit_after_accept_ratio", 1, 0, 0), ("workflow_length", 9, 8, 10),
    ],
)
def test_behavior_features(events, column, good, retry, explode):
    got = by(features.behavior_features(events))
    assert [round(got[s][column], 3) for s in ("good", "retry", "explode")] == pytest.approx([good, retry, explode], abs=1.1e-3)


def test_prompt_features(events):
    got = by(features.prompt_features(events), "prompt")
    assert [round(got[p]["prompt_density"], 3) for p in ("p1", "p2", "p3")] == [0.833, 0.75, 0.667]
    assert round(got["p2"]["history_ratio"], 3) == 0.267


def test_failure_classes(events):
    got = by(features.failure_classes(events))
    assert [got[s]["failure_type"] for s in ("good", "retry", "explode")] == ["none", "retry_loop", "retry_loop"]
    assert got["retry"]["confidence"] == 1


def test_failure_runs(events):
    assert [(r["session_id"], r["failure_type"], r["length"]) for r in features.failure_runs(events).collect()] == [("retry", "retry_loop", 3)]


def test_markov(events):
    model = {(r["from_type"], r["to_type"]): (r["count"], round(r["probability"], 4)) for r in mining.transitions(events).collect()}
    assert model["chat", "completion"] == (3, 1) and model["read_file", "read_file"] == (4, 0.6667) and model["retry", "retry"] == (2, 0.5)
    score = mining.anomaly_score(mining.transitions(events)).first()
    assert (score["distinct_transitions"], score["transitions"]) == (13, 24) and round(score["anomaly_score"], 3) == 0.087
    edges = {(r["from_type"], r["to_type"]): r["dependency"] for r in mining.directly_follows(events).collect()}
    assert edges["chat", "completion"] == 0.75 and edges["retry", "retry"] == 0


def test_daily(events):
    day = mining.daily_metrics(events).first()
    assert (round(day["accept_rate"], 3), round(day["retry_rate"], 3), day["avg_tokens"], day["session_count"], day["event_count"]) == (0.333, 1.333, 533, 3, 27)


def test_vectors(events):
    got = {r["session_id"]: r["vector"] for r in vectors.session_vectors(features.session_view(events)).collect()}
    for name, want in (("good", [0.15900, 0, 0.14960, 0.17097, 0.11851, 0, 0.85139, 0.39367, 0.17097, 0]), ("explode", [0.10099, 0.13306, 0.08875, 0, 0.14618, 0, 0.91244, 0.31906, 0, 0.09223])):
        assert got[name] == pytest.approx(want, abs=2e-4)
    cosine = sum(a * b for a, b in zip(got["good"], got["retry"]))
    assert cosine == pytest.approx(0.92194, abs=1e-4)


def test_graph(events, spark):
    nodes, edges = graph.graph(events.where("session_id = 'good'"))
    count = {r["type"]: r["n"] for r in graph.type_stats(nodes).collect()}
    assert (count["prompt"], count["completion"], count["accept"], count["file"]) == (1, 1, 1, 2)
    assert {r["type"]: r["n"] for r in graph.type_stats(edges).collect()}["prompt_file"] == 2
    recovered = canonical.from_rows(spark, rows_of("s", [("session_start", None), ("chat", None), ("completion", None), ("retry", None), ("retry", None), ("retry", None), ("accept", None), ("session_end", None)]))
    row = graph.retry_recovery(graph.graph(recovered)[1]).first()
    assert (row["session_id"], row["retry_count"], row["accept_count"]) == ("s", 3, 1)
    two = canonical.from_rows(spark, rows_of("a", GOOD, "w") + rows_of("b", GOOD, "w"))
    nodes, edges = graph.graph(two)
    assert edges.where("type = 'workspace_language'").count() == 1 and nodes.where("node_id = 'file:src/index.ts'").count() == 1


def test_labels(events):
    sizes = modelsize.session_size_features(events)
    got = by(modelsize.behavior_labels(events, sizes))
    assert [got[s]["label"] for s in ("good", "retry", "explode")] == ["mini", "large", "large"]
    assert round(got["retry"]["reward"], 2) == -0.28 and round(got["explode"]["reward"], 3) == -0.267
    assert round(by(modelsize.heuristic_labels(sizes))["good"]["complexity"], 1) == 16.3
    assert len(modelsize.model_size_features(events).columns) == 35


def test_variants(spark):
    rows = canonical.from_rows(spark, rows_of("x", [("session_start", None), ("chat", None), ("completion", None), ("retry", None), ("reject", None)]))
    assert mining.failure_patterns(rows).first()["pattern"].endswith("reject")
    loops = canonical.from_rows(spark, rows_of("y", [("chat", None), ("chat", None), ("completion", None)]))
    assert mining.variants(loops).first()["variant"] == "chat>completion"


def test_promotion_keeps_types(spark):
    rows = canonical.from_rows(spark, [(1, "s", "w", "chat", '{"tokenCount":"many"}'), (2, "s", "w", "chat", '{"tokenCount":7}')])
    assert [r[0] for r in rows.orderBy("id").select("token_count").collect()] == [None, 7.0]
    assert features.workspace_features(canonical.from_rows(spark, [(1, "s", "w", "edit", '{"loc":5,"dependencies":3}'), (2, "s", "w", "session_start", '{"dependencies":["a"]}')])).select(F.col("dependency_count")).first()[0] == 3
