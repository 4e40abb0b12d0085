"""Evaluation, calibration, drift, decisions and learners."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sessionloom import functions as fn
from sessionloom.operators import learn, modelsize, store, trust, vectors
from sessionloom.operators.vectors import similar_to
from sessionloom.sources.tables import synthetic_sizes

FEATURES = ["prompt_tokens", "completion_tokens", "tool_calls", "edits", "retries"]


@pytest.fixture(scope="module")
def sizes(spark):
    return learn.with_index(synthetic_sizes(spark, 240)).cache()


@pytest.mark.parametrize("kind, least", [("logistic", 0.8), ("bayes", 0.8), ("boosting", 0.8)])
def test_models(spark, sizes, kind, least):
    model = learn.fit(sizes, kind, FEATURES, **({"rounds": 10, "depth": 3} if kind == "boosting" else {}))
    got = learn.predict(model, sizes)
    assert got.select("confidence").distinct().count() > 3
    assert learn.accuracy(got) > least
    assert got.agg(F.max(F.abs(F.aggregate("probabilities", F.lit(0.0), lambda s, p: s + p) - 1))).first()[0] < 1e-6


def test_perceptron_and_folds(spark, sizes):
    assert learn.accuracy(learn.predict(learn.fit(sizes, "perceptron", FEATURES), sizes)) > 0.8
    assert learn.fold_count(sizes) == 5 and learn.folds(sizes).select("fold").distinct().count() == 5


def test_stack_and_conformal(spark, sizes):
    stacked = learn.stack(sizes, FEATURES)
    got = learn.predict_stack(stacked, sizes).checkpoint()
    assert learn.accuracy(got) > 0.8 and set(stacked.temperatures) == {"online", "knn", "bayes"}
    rows = learn.conformal_reject(got, learn.conformal_scores(got))
    assert 0 <= rows.agg(F.min("p_value")).first()[0] and rows.agg(F.max("p_value")).first()[0] <= 1
    scores = [r[0] for r in learn.conformal_scores(got).collect()]
    sample = rows.select("confidence", "p_value", "rejected").limit(20).collect()
    limit = sorted(scores)[math.ceil(0.9 * len(scores)) - 1]
    for r in sample:
        assert r["p_value"] == pytest.approx((sum(s >= 1 - r["confidence"] for s in scores) + 1) / (len(scores) + 1))
        assert r["rejected"] == (1 - r["confidence"] > limit)


def test_online(spark, sizes):
    model = learn.OnlineLogistic(FEATURES, rate=0.5)
    for _ in range(12):
        model.partial_fit(sizes)
    assert sizes.agg(F.avg((fn.argmax(model.probabilities()) == F.col("y")).cast("double"))).first()[0] > 0.75


def test_propagation_and_pseudo_labels(spark):
    rows = spark.createDataFrame([(f"s{i}", float(i % 2) * 8 + i / 100, (i % 2) * 2 if i < 4 else None) for i in range(20)], "session_id string, f double, anchor int")
    got = {r["session_id"]: r["label"] for r in learn.propagate_labels(rows, ["f"], rounds=10, sigma=0.5).collect()}
    assert all(got[f"s{i}"] == ("large" if i % 2 else "mini") for i in range(20))
    sizes = learn.with_index(synthetic_sizes(spark, 120))
    more = learn.pseudo_labels(sizes.where("pmod(xxhash64(session_id), 2) = 0"), sizes.where("pmod(xxhash64(session_id), 2) = 1").drop("y"), "logistic", FEATURES, rounds=1)
    assert more.where("weight < 1").count() <= 50 and more.count() > sizes.where("pmod(xxhash64(session_id), 2) = 0").count()


def test_propagation_over_all_labels_in_passes(spark, monkeypatch):
    table = pytest.importorskip("pandas").read_parquet("/root/testdata/sf0.001/embeddings.parquet")
    monkeypatch.setattr(vectors, "PASS_ROWS", 200)
    got = entry.queries()["label_propagation_all"](spark, "/root/testdata/sf0.001").toPandas().pivot(index="vec_id", columns="class", values="p").sort_index()
    table = table.sort_values("vec_id")
    x, y = np.stack(table["embedding"]).astype(float), table["label"].to_numpy()
    assert list(got.index) == list(table["vec_id"]) and list(got.columns) == sorted(set(y)) == list(range(10))
    w = np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / 2)
    np.fill_diagonal(w, 0)
    own, anchor = np.eye(10)[y], (table["vec_id"] % 2 == 0).to_numpy()[:, None]
    want = np.where(anchor, own, w @ np.where(anchor, own, 0.1) / w.sum(1, keepdims=True))
    assert np.abs(got.to_numpy() - want).max() < 1e-5


def test_propagation_in_passes(spark, monkeypatch):
    rows = spark.createDataFrame([(f"s{i}", float(i % 2) * 8 + i / 100, (i % 2) * 2 if i < 4 else None) for i in range(20)], "session_id string, f double, anchor int")
    run = lambda: {r["session_id"]: r["probabilities"] for r in learn.propagate_labels(rows, ["f"], rounds=3, sigma=0.5).collect()}
    want = run()
    monkeypatch.setattr(vectors, "PASS_ROWS", 8)
    got = run()
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_nearest_by_cosine_against_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.integers(-2, 3, (150, 4)).astype(float)
    rows = [(i, v.tolist(), int(i % 3)) for i, v in enumerate(x)] + [(150, None, 1), (151, [1.0], 1), (152, [None, 1.0, 1.0, 1.0], 2)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").repartition(3)
    monkeypatch.setattr(vectors, "PASS_ROWS", 20)
    got = {}
    for r in vectors.nearest_by_cosine(frame, frame.where("vec_id % 2 = 0 AND vec_id < 150"), 5).orderBy("query", "r").collect():
        got.setdefault(r["query"], []).append((r["vec_id"], r["label"]))
    for q in range(0, 150, 2):
        pairs = []
        for j in range(150):
            dot = lambda a, b: float(np.add.accumulate(a * b)[-1])
            size = math.sqrt(dot(x[j], x[j])) * math.sqrt(dot(x[q], x[q]))
            pairs.append((max(1 - (dot(x[j], x[q]) / size if size else 0.0), 1e-10), j, j % 3))
        assert got[q] == [(j, label) for _, j, label in sorted(p for p in pairs if p[1] != q)[:5]]
    assert vectors.knn_vote(frame, frame.where("vec_id = 999"), 3).count() == 0


def test_nearest_model(spark, sizes):
    model = learn.fit(sizes, "knn", FEATURES)
    assert model.k == 15 and model.leave_one_out(sizes) > 0.7
    assert learn.accuracy(learn.predict(model, sizes)) >= model.leave_one_out(sizes) - 0.05


def test_conformal_counts_of_many_equal_scores(spark, monkeypatch):
    monkeypatch.setattr(learn, "SCORE_BINS", 8)
    scores = [0.0] * 500 + [i / 1000 for i in range(300)] + [0.25] * 50 + [1.0]
    frame = spark.createDataFrame([(s,) for s in scores], "score double")
    for alpha in (0.01, 0.1, 0.5, 0.9):
        assert learn.conformal_threshold(frame, alpha).first()["threshold"] == sorted(scores)[math.ceil(len(scores) * (1 - alpha)) - 1]
    asked = [1.0, 0.99, 0.75, 0.7513, 0.0]
    got = learn.conformal_reject(spark.createDataFrame([(c,) for c in asked], "confidence double"), frame).collect()
    for r in got:
        assert r["p_value"] == pytest.approx((sum(s >= 1 - r["confidence"] - 1e-12 for s in scores) + 1) / (len(scores) + 1))
    assert len(got) == len(asked)
    assert learn.conformal_threshold(frame.limit(0)).first()["n"] == 0


def test_training_run_and_saved_model(spark, tmp_path):
    sizes = learn.with_index(synthetic_sizes(spark, 90)).checkpoint()
    half = "pmod(xxhash64(session_id), 2) = "
    got = learn.training_run(sizes.where(half + "0"), sizes.where(half + "1").drop("y"), FEATURES, baseline=sizes, kinds=("logistic", "knn"), rounds=2)
    assert got["propagated"].count() == 90 and got["drift"].first()["recommendation"] in ("stable", "monitor", "retrain")
    assert learn.accuracy(learn.predict_stack(got["stack"], sizes)) > 0.7
    assert learn.weight_importance(got["models"]["logistic"], FEATURES, spark).count() == len(FEATURES)
    model = learn.fit(sizes, "online", FEATURES)
    model.save(str(tmp_path / "online"), spark)
    again = learn.OnlineLogistic.load(str(tmp_path / "online"), spark)
    assert again.weights == model.weights and again.scale == model.scale


def test_calibration(spark):
    rows = spark.createDataFrame([(i % 2, [0.99, 0.01] if i % 4 < 2 else [0.01, 0.99]) for i in range(40)], "actual int, probabilities array<double>")
    assert trust.fit_temperature(rows) > 2
    assert trust.calibration_error(spark.createDataFrame([(0.95, True), (0.95, False)], "confidence double, correct boolean")).first()[0] == pytest.approx(0.45)


def test_sampling_and_decision(spark):
    rows = spark.createDataFrame([("a", [0.34, 0.33, 0.33], 0.34), ("b", [0.9, 0.05, 0.05], 0.9)], "entity_id string, probabilities array<double>, confidence double")
    for strategy, want in (("random", {"a", "b"}), ("confidence", {"a"}), ("uncertainty", {"a"}), ("active", {"a"})):
        assert {r["entity_id"] for r in trust.sampling(rows, strategy, 0.5, F.lit(0.1)).where("sampled").collect()} == want
    votes = spark.createDataFrame([("x", "r", "mini", 0.8), ("x", "h", "large", 0.6)], "entity_id string, source string, model string, confidence double")
    decision = trust.decide(trust.weighted_fusion(votes)).first()
    assert decision["model"] == "mini" and decision["alternatives"] == ["large", "medium"]


def test_explanations(spark):
    rows = spark.createDataFrame([(str(i), float(i), 1.0, float(i > 10)) for i in range(20)], "entity_id string, a double, b double, actual double")
    decide = lambda c: F.when(c["a"] > 10, 1.0).otherwise(0.0)
    cut = trust.counterfactual(rows.where("entity_id = '19'"), decide, ["a", "b"]).first()
    assert cut["feature"] == "a" and cut["changed_to"] <= 10
    assert {r["feature"]: r["contribution"] for r in trust.contributions(rows.where("entity_id = '3'"), lambda c: c["a"] * 2 + c["b"], ["a", "b"]).collect()} == {"a": 6, "b": 1}
    more = spark.range(600).select(F.col("id").cast("string").alias("entity_id"), (F.col("id") % 20).cast("double").alias("a"), F.lit(1.0).alias("b"), F.when(F.col("id") % 20 > 10, 1.0).otherwise(0.0).alias("actual"))
    got = {r["feature"]: r["importance"] for r in trust.permutation_importance(more, decide, ["a", "b"], rounds=2).collect()}
    assert got["b"] == 0 and got["a"] > 0.2
    grade = spark.range(1).select(trust.scorecard(*map(F.lit, (1.0, 1.0, 0.0, 0.0, 100.0, 0.0, 0.0)))).first()[0]
    assert grade == "A"


def test_store(spark):
    rows = spark.createDataFrame([("s", 1, 5, 1.0), ("s", 2, 4, 2.0)], "entity_id string, version int, computed_at bigint, x double")
    assert store.latest(rows, ["entity_id"], ["version"]).first()["x"] == 2.0
    kept = store.feature_rows(rows.select("entity_id", "x"), "entity_id", "session", 3)
    assert store.read_features(kept, "session", version=3).count() == 2 and store.by_domain(store.feature_catalog(spark), "tool").count() == 4
    nodes = spark.createDataFrame([("a",), ("b",)], "node_id string")
    edges = spark.createDataFrame([("a", "b", "t")], "source string, target string, type string")
    left, joined = store.retain_graph(nodes, edges, spark.createDataFrame([("a", 0)], "node_id string, ts_ms bigint"), 10**13)
    assert left.count() == 1 and joined.count() == 0
    assert store.first_source([rows, rows.withColumn("x", F.lit(9.0))], "entity_id").where("x = 9").count() == 0


def test_traces(spark):
    rows = spark.createDataFrame([("t", 1000, 100, 3000, [{"n": "a"}], ["x.ts"], "a\nb", ["r"])], "id string, inputTokens bigint, outputTokens bigint, contextTokens bigint, toolCalls array<map<string,string>>, filesChanged array<string>, finalDiff string, reasoningSteps array<string>")
    got = modelsize.trace_evaluation(rows).first()
    assert got["complexity"] == 2 and got["smaller_model_possible"] and [x.split(":")[0] for x in got["reasons"]] == ["for"] * 4
    tested = rows.withColumn("finalDiff", F.lit("--- a/x\n+++ b/src/x.spec.ts\n+1"))
    assert "tests" in modelsize.trace_evaluation(tested).first()["reasons"][-1] and not any("tests" in x for x in got["reasons"])
    assert modelsize.features_from_traces(rows).first()["prompt_tokens"] == 1000
    assert spark.range(1).select(modelsize.success_score(*[F.lit(True)] * 4)).first()[0] == pytest.approx(1.0)


def test_vector_functions(spark):
    one = spark.range(1)
    a, b = F.lit([1.0, 0.0]), F.lit([0.0, 1.0])
    got = one.select(fn.cosine(a, a), fn.cosine(a, b), fn.cosine(a, F.lit([-1.0, 0.0])), fn.norm(fn.normalized(F.lit([3.0, 4.0]))), fn.cosine(a, F.lit([0.0, 0.0]))).first()
    assert list(got) == [1, 0, -1, 1, 0]
    table = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.9, 0.1]), ("c", [0.0, 1.0])], "vec_id string, embedding array<double>")
    assert [r["vec_id"] for r in similar_to(table, "a", 2).collect()] == ["b", "c"] and similar_to(table, "zz").count() == 0


def test_whole_decisions_and_shadow_runs(spark):
    votes = spark.createDataFrame([("a", "r", "large", 0.55), ("a", "h", "mini", 0.5), ("b", "r", "mini", 0.9)], "entity_id string, source string, model string, confidence double")
    rows = spark.createDataFrame([("a", 60_000.0, 1000.0, 2.0, 1.0, 0.9), ("b", 100.0, 10.0, 0.0, 0.0, 0.1)], "entity_id string, prompt_tokens double, completion_tokens double, retries double, has_loop double, context_utilization double")
    score = lambda c: c["prompt_tokens"] / 1000 + c["retries"] * 10
    got = {r["entity_id"]: r for r in trust.whole_decisions(trust.weighted_fusion(votes), rows, score, lambda c: modelsize.label_of(score(c)), ["prompt_tokens", "retries"]).collect()}
    assert got["a"]["model"] == "large" and got["a"]["risk"] == "high" and len(got["a"]["risk_factors"]) == 4
    assert got["a"]["reasons"][0]["feature"] == "prompt_tokens" and got["a"]["counterfactual"]["feature"] in ("prompt_tokens", "retries")
    assert got["b"]["model"] == "mini" and got["b"]["risk"] == "low" and got["b"]["counterfactual"] is None and got["b"]["success"] == 0.87
    drawn = trust.sampling(spark.createDataFrame([(str(i), [0.4, 0.3, 0.3], 0.4) for i in range(10)], "entity_id string, probabilities array<double>, confidence double"), "random", 0.5, F.lit(0.1))
    told = trust.within_budget(drawn, 3).groupBy("sampled", "reason").count().collect()
    assert {(r["sampled"], r["reason"], r["count"]) for r in told} == {(True, "sampled", 3), (False, "beyond the budget", 7)}
    states = spark.createDataFrame([("s1", "mini", 10.0, 1, 0, 0), ("s2", "medium", 90_000.0, 1, 0, 0)], "session_id string, model string, sum_prompt double, tool_calls int, files_edited int, retries int")
    ran, stats = trust.shadow_run(states, 0.5, F.lit(0.2), lambda df: trust.heuristic_shadow(df, F.lit(0.1)))
    assert {(r["session_id"], r["label"]) for r in ran.collect()} == {("s1", "mini"), ("s2", "large")} and stats.first()["rate"] == 1.0
    cal = trust.calibration_report(spark.createDataFrame([(0, [0.9, 0.1]), (1, [0.9, 0.1])], "actual int, probabilities array<double>"), 4.0).first()
    assert cal["pre_ece"] == pytest.approx(0.4) and cal["post_ece"] < cal["pre_ece"] and cal["brier"] == pytest.approx((0.01 + 0.81) / 2)


def test_samples_anchors_and_settings(spark):
    from sessionloom.operators import realtime

    sizes = synthetic_sizes(spark, 60)
    assert set(sizes.columns) == {"session_id", "label", *modelsize.BASE_FEATURES, *modelsize.TEMPORAL_FEATURES} and sizes.na.drop().count() == 60
    assert {r["label"]: r["n"] for r in store.label_histogram(sizes).collect()} == {"mini": 30, "medium": 18, "large": 12}
    ranges = {r["feature"]: r for r in store.feature_ranges(sizes, ["prompt_tokens", "context_utilization"]).collect()}
    assert ranges["prompt_tokens"]["least"] >= 500 and ranges["context_utilization"]["greatest"] <= 0.95
    assert tuple(store.label_agreement(sizes, sizes.withColumn("label", F.lit("mini"))).first()) == (30, 30)
    labels = spark.createDataFrame([("a", "session", "x", "mini", 1), ("a", "session", "y", "large", 2)], "entity_id string, domain string, source string, label string, created_at bigint")
    assert store.labels_of(labels, "session").count() == 2 and store.labels_of(labels, "session", "y").first()["label"] == "large" and store.labels_of(labels, "tool").count() == 0
    signals = spark.createDataFrame([("synthetic-0", "large", 0.9), ("synthetic-1", "large", 0.5)], "session_id string, auto_label string, confidence double")
    got = {r["session_id"]: (r["label"], r["is_anchor"]) for r in modelsize.anchors(sizes.select("session_id", "label"), signals).collect()}
    assert got["synthetic-0"] == ("large", True) and got["synthetic-1"] == ("mini", False) and len(got) == 60
    assert realtime.limits_from({"SESSIONLOOM_RULE_READS": "7", "SESSIONLOOM_RULE_DIFF_LINES": "x", "SESSIONLOOM_RULE_MODEL_WORDS": " Tiny, "}) == realtime.RuleLimits(reads=7, model_words=("tiny",))
    assert store.retention_days({"SESSIONLOOM_RETENTION_DAYS": "30"}) == 30 and store.retention_days({"SESSIONLOOM_RETENTION_DAYS": "-1"}) == store.retention_days({}) == 90


def test_versioned_tables(spark, tmp_path):
    from sessionloom.sources import tables

    root = str(tmp_path)
    rows = spark.createDataFrame([("a", 1, 5, 1.0), ("b", 1, 5, 2.0)], "entity_id string, version int, computed_at bigint, x double")
    tables.write(rows, root, "features")
    new = spark.createDataFrame([("a", 1, 9, 3.0), ("a", 1, 7, 8.0), ("c", 1, 1, 4.0)], rows.schema)
    tables.upsert_table(new, root, "features", ["entity_id", "version"])
    assert {(r["entity_id"], r["x"]) for r in tables.read(spark, root, "features").collect()} == {("a", 3.0), ("b", 2.0), ("c", 4.0)}
    # a version without its mark is not read
    (tmp_path / "features" / "v000000009").mkdir()
    assert tables.read(spark, root, "features").count() == 3
    tables.drop_versions(spark, root, "features", 1)
    assert tables.read(spark, root, "features").count() == 3
    assert tables.drift_from_baseline(rows, root, ["x"]) is None
    assert tables.drift_from_baseline(rows.withColumn("x", F.col("x") * 5), root, ["x"]).count() == 1
    tables.append_feedback(spark.createDataFrame([("s", "mini", 0.9)], "session_id string, predicted string, score double"), root)
    tables.append_feedback(spark.createDataFrame([("t", "mini", 0.1)], "session_id string, predicted string, score double"), root)
    assert {r["label"] for r in tables.read(spark, root, "feedback").collect()} == {"mini", "medium"}
