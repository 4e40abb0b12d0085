"""The registered queries: each applies operators to the driver's tables; doubles are rounded to six places, as in the SQL beside them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.functions import has_tail_loop, tail_repeats
from sessionloom.operators import canonical, features, graph, mining, modelsize, realtime, store, trust, vectors
from sessionloom.plans import source_queries, whole_queries  # noqa: F401 the second registers its queries
from sessionloom.plans.adapter import agent_log, agent_log_of, canonical_events, event_files, event_slices, event_stream, table, turns
from sessionloom.plans.oracles import ORACLES

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.transform(c, lambda x: F.round(x, places)).alias(c) if t == "array<double>" else F.col(c) for c, t in df.dtypes])


def _on_events(build: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: rounded(build(canonical_events(spark, sf_dir)))


def _on_log(build: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: rounded(build(agent_log(spark, sf_dir)))


def query(name: str):
    def keep(f):
        _QUERIES[name] = f
        return f

    return keep


def _behavior(column: str) -> Callable[[SparkSession, str], DataFrame]:
    return _on_events(lambda e: features.behavior_features(e).select("session_id", column))


KEYS = ("id", "ts_ms", "session_id", "workspace_id", "event_type")

_QUERIES |= {
    "event_type_counts": _on_events(canonical.type_counts),
    "distinct_sessions": _on_events(canonical.sessions),
    "events_by_type_limit": _on_events(lambda e: canonical.by_type(e, "chat", 1000).select("id", "ts_ms", "session_id")),
    "events_in_range": _on_events(lambda e: canonical.by_workspace(e, "ws3", 1_704_153_600_000, 1_704_758_400_000).select("id", "ts_ms", "event_type")),
    "session_features": _on_events(features.session_features),
    "tool_features": _on_events(features.tool_features),
    "prompt_features": _on_events(features.prompt_features),
    "workspace_features": _on_events(features.workspace_features),
    "behavior_read_before_ask": _behavior("avg_read_before_ask"),
    "behavior_retry_distance": _behavior("avg_retry_distance"),
    "behavior_switch_freq": _behavior("tool_switch_frequency"),
    "behavior_ctx_speed": _behavior("context_expansion_speed"),
    "behavior_entropy": _behavior("workflow_entropy"),
    "behavior_retry_burst": _behavior("retry_burst_score"),
    "behavior_edit_after_accept": _behavior("edit_after_accept_ratio"),
    "session_view": _on_events(features.session_view),
    "failure_classes": _on_events(lambda e: features.failure_classes(e).drop("evidence")),
    "failure_runs": _on_events(features.failure_runs),
    "markov_transitions": _on_events(mining.transitions),
    "markov_start_dist": _on_events(mining.start_distribution),
    "markov_anomaly": _on_events(lambda e: mining.anomaly_score(mining.transitions(e))),
    "sequence_logprob": _on_events(lambda e: mining.sequence_log_probability(e, mining.transitions(e))),
    "markov_typical_workflow": _on_events(mining.typical_workflow),
    "dfg_edges": _on_events(mining.directly_follows),
    "dfg_nodes": _on_events(mining.workflow_nodes),
    "workflow_variants": _on_events(mining.variants),
    "failure_patterns": _on_events(mining.failure_patterns),
    "daily_metrics": _on_events(mining.daily_metrics),
    "trend_slopes": _on_events(lambda e: mining.trends(mining.daily_metrics(e))),
    "trend_summary": _on_events(lambda e: mining.trend_summary(mining.daily_metrics(e))),
    "rolling7": _on_events(lambda e: mining.rolling_mean(mining.daily_metrics(e), "accept_rate")),
    "context_roi": _on_events(mining.context_roi),
    "outcome_to_completion_asof": _on_events(graph.outcomes),
    "prompt_file_links": _on_events(graph.prompt_files),
    "tool_call_pairing": _on_events(graph.tool_pairs),
    "graph_node_stats": _on_events(lambda e: graph.type_stats(graph.graph(e)[0])),
    "graph_edge_stats": _on_events(lambda e: graph.type_stats(graph.graph(e)[1])),
    "graph_neighbors": _on_events(lambda e: graph.neighbors(*reversed(graph.graph(e)), "session:u5", "session_file").select("node_id", "type", "name")),
    "graph_two_hop": _on_events(lambda e: graph.two_hop(graph.graph(e)[1], "session_completion", "completion_outcome").groupBy("source").agg(F.count("*").alias("n"))),
    "retry_recovery": _on_events(lambda e: graph.retry_recovery(graph.graph(e)[1])),
    "workspace_failures": _on_events(lambda e: graph.workspace_failures(e).drop("failures")),
    "tool_impact": _on_events(graph.tool_impact),
    "failure_clusters": _on_events(lambda e: graph.failure_clusters(e).select("failure_type", "session_count", F.array_join("top_workspaces", ",").alias("top_workspaces"), F.array_join("top_files", ",").alias("top_files"))),
    "session_embedding": _on_events(lambda e: vectors.session_vectors(features.session_view(e)).select("session_id", F.posexplode("vector").alias("pos", "x"))),
    "model_size_features": _on_events(modelsize.session_size_features),
    "temporal_features": _on_events(modelsize.temporal_features),
    "rolling_session_stats": _on_events(lambda e: modelsize.rolling_features(modelsize.session_history(e)).drop("ema_tokens", "ema_retry_rate")),
    "session_ema": _on_events(lambda e: modelsize.rolling_features(modelsize.session_history(e)).select("session_id", "ema_tokens", "ema_retry_rate")),
    "heuristic_label": _on_events(lambda e: modelsize.heuristic_labels(modelsize.session_size_features(e))),
    "behavior_label": _on_events(lambda e: modelsize.behavior_labels(e, modelsize.session_size_features(e))),
    "retention_prune": _on_events(lambda e: canonical.type_counts(store.retain(e, "ts_ms", 1_706_659_200_000, 15))),
    "running_state": _on_log(lambda g: realtime.running_state(g).select("id", "session_id", "version", "sum_prompt", "sum_completion", "tool_calls", "read_files", "edits", "retries", "files_read", "files_edited", "usage", "elapsed_ms")),
    "rule_alerts": _on_log(lambda g: realtime.alerts(realtime.running_state(g)).groupBy("session_id", "rule_id", "severity").agg(F.count("*").alias("n"))),
    "health_score": _on_log(lambda g: realtime.health(realtime.final_state(realtime.running_state(g))).select("session_id", "health", "health_label")),
    "advice": _on_log(lambda g: realtime.advice(realtime.final_state(realtime.running_state(g)))),
    "phase_timeline": _on_log(realtime.timeline),
    "live_metrics": _on_log(lambda g: realtime.metrics(realtime.final_state(realtime.running_state(g))).withColumn("cost", F.col("cost") * 1e6)),
    "prediction_triggers": _on_log(lambda g: realtime.prediction_triggers(realtime.running_state(g))),
    "multi_health": _on_log(lambda g: realtime.multi_health(realtime.metrics(realtime.final_state(realtime.running_state(g)))).select("session_id", "h_execution", "h_reasoning", "h_context", "h_tool", "h_planning", "h_memory", "overall")),
}


@query("json_predicate")
def _json_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").where(F.get_json_object("props", "$.k").cast("int") > 90)
    return rows.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("registry_by_domain")
def _registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.by_domain(store.feature_catalog(spark)).groupBy("domain").agg(F.count("*").alias("n"))


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = canonical_events(spark, sf_dir)
    return rows.select(F.col("session_id").alias("entity_id"), (F.col("id") % 3 + 1).alias("version"), F.col("ts_ms").alias("computed_at"), F.col("id").cast("double").alias("score"))


@query("latest_feature_version")
def _latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.latest(_versions(spark, sf_dir), ["entity_id"], ["version", "computed_at", "score"])


@query("upsert_latest")
def _upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = store.latest(_versions(spark, sf_dir), ["entity_id", "version"], ["computed_at", "score"])
    return store.upsert(rows.where("version < 3"), rows.where("version = 2").withColumn("score", -F.col("score")), ["entity_id", "version"])


@query("training_matrix")
def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return store.training_matrix(documents, table(spark, sf_dir, "labels"), "doc_id")


def _query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return [float(x) for x in table(spark, sf_dir, "embeddings").where("vec_id = 7").first()["embedding"]]


@query("cosine_topk")
def _cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(vectors.top_similar(table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), 10))


@query("similar_sessions")
def _similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = vectors.session_vectors(features.session_view(canonical_events(spark, sf_dir)))
    return rounded(vectors.similar_to(view, "u5", 5, "session_id", "vector"))


@query("knn_vote")
def _knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return rounded(vectors.knn_vote(rows, rows.where("vec_id % 50 = 0"), 5))


@query("label_propagation_all")
@query("label_propagation_step")
def _propagate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One step over every row and label of the table; every second row keeps its label."""
    rows = table(spark, sf_dir, "embeddings")
    labels = sorted(r[0] for r in rows.where("label IS NOT NULL").select("label").distinct().collect())
    rows = rows.select("vec_id", "embedding", F.when(F.col("vec_id") % 2 == 0, F.col("label")).alias("label"))
    step = vectors.propagation_step(rows, labels).select("vec_id", F.posexplode("distribution").alias("pos", "p"))
    return rounded(step.select("vec_id", F.get(F.lit(labels), F.col("pos")).cast("int").alias("class"), "p"))


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three sources' labels of each labelled document."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    size = F.when(F.col("n_chars") < 1000, "mini").when(F.col("n_chars") < 4000, "medium").otherwise("large")
    each = F.array(
        F.struct(F.lit("size").alias("source"), size.alias("label"), F.lit(0.7).alias("confidence")),
        F.struct(F.lit("quality").alias("source"), F.when(F.col("quality") == 1, "large").otherwise("mini").alias("label"), F.lit(0.6).alias("confidence")),
        F.struct(F.lit("id").alias("source"), F.get(F.array(*map(F.lit, modelsize.CLASSES)), (F.col("doc_id") % 3).cast("int")).alias("label"), F.lit(0.5).alias("confidence")),
    )
    return rows.select(F.col("doc_id").alias("entity_id"), F.inline(each))


@query("weak_label_fusion")
def _fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    accuracies = spark.sql("SELECT * FROM VALUES ('size', 0.8D), ('quality', 0.7D), ('id', 0.4D) AS t(source, accuracy)")
    told = votes(spark, sf_dir).withColumn("probabilities", modelsize.label_distribution(F.col("label")))
    return rounded(modelsize.fuse_weak_labels(told, accuracies).select("entity_id", "label", "confidence"))


@query("source_accuracy")
def _accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(modelsize.source_accuracy(votes(spark, sf_dir)))


@query("weighted_fusion")
def _weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(trust.weighted_fusion(votes(spark, sf_dir).withColumnRenamed("label", "model")))


@query("bayesian_fusion")
def _bayesian(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(trust.bayesian_fusion(votes(spark, sf_dir).withColumnRenamed("label", "model")))


@query("stacking_fusion")
def _stacking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(trust.stacking_fusion(votes(spark, sf_dir).withColumnRenamed("label", "model"), {"size": 0.5, "quality": 0.3, "id": 0.2}))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with a fixed logistic score of their length for quality."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang"), "doc_id")
    p = 1 / (1 + F.exp(-(F.col("n_chars") / 1000.0 - 2) / 2))
    rows = rows.withColumn("p1", p).withColumn("p0", 1 - F.col("p1"))
    return rows.select(F.col("doc_id"), F.col("quality").alias("actual"), (F.col("p1") >= 0.5).cast("int").alias("predicted"), "p0", "p1", F.greatest("p0", "p1").alias("confidence"), ((F.col("p1") >= 0.5).cast("int") == F.col("quality")).alias("correct"), "n_chars", "lang")


@query("confusion_metrics")
def _confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(trust.class_metrics(trust.confusion(_scored(spark, sf_dir))))


@query("evaluation_summary")
def _evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(trust.summary_metrics(trust.confusion(_scored(spark, sf_dir))))


@query("ece")
def _ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(trust.calibration_error(_scored(spark, sf_dir)))


@query("brier")
def _brier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(trust.brier(_scored(spark, sf_dir), ["p0", "p1"]))


@query("temperature_grid")
def _temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir).select("actual", F.array("p0", "p1").alias("probabilities"))
    return rounded(trust.temperature_losses(rows, [0.5, 1.0, 1.5, 2.0, 3.0]))


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, list[str]]:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag")
    return rows.where("l_orderkey % 2 = 0"), rows.where("l_orderkey % 2 = 1 AND l_quantity > 5"), ["l_quantity", "l_extendedprice", "l_discount"]


@query("psi_drift")
def _psi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(trust.population_stability(*_halves(spark, sf_dir)))


@query("drift_report")
def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(trust.drift_report(trust.population_stability(*_halves(spark, sf_dir))))


@query("kl_drift")
def _kl(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new, _ = _halves(spark, sf_dir)
    return rounded(trust.label_divergence(old, new, "l_returnflag"))


@query("concept_drift")
def _concept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(trust.concept_drift(*_halves(spark, sf_dir)))


@query("model_drift")
def _model_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(trust.model_drift(_scored(spark, sf_dir), 0.9))


@query("ablation")
def _ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = modelsize.session_size_features(canonical_events(spark, sf_dir))
    return rounded(trust.contributions(sizes, lambda c: c["prompt_tokens"] / 1000 + c["tool_calls"] * 2 + c["edits"] * 15, ["prompt_tokens", "tool_calls", "edits"], "session_id"))


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical_events(spark, sf_dir).where("event_type = 'tool_call'")


@query("loop_detection")
def _loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.last_of(_calls(spark, sf_dir), 15).select("session_id", has_tail_loop(F.col("sequence")).alias("has_loop"), tail_repeats(F.col("sequence"), 10, 2).alias("repeats"))


@query("count_loops")
def _count_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.repeated_sequences(_calls(spark, sf_dir))


@query("session_store_events")
def _store_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sessionloom.sources.session_store import turn_events

    return turn_events(turns(spark, sf_dir)).groupBy("session_id", "event_type").agg(F.count("*").alias("n"), F.sum("token_count").alias("tokens"))


@query("order_trend")
def _order_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.avg("o_totalprice").alias("price"))
    numbered = rows.select(F.datediff("day", F.lit("1992-01-01").cast("date")).alias("x"), "price")
    return numbered.agg(F.round(F.regr_slope("price", "x"), 4).alias("slope"), F.count("*").alias("days"))


@query("customer_part_paths")
def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three hops over the trade tables: customers' segments to part brands by order lines."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return lines.join(orders, "l_orderkey").join(customers, "c_custkey").join(parts, "l_partkey").groupBy("c_mktsegment", "p_brand").agg(F.count("*").alias("n"))


@query("streaming_session_state")
def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sessionloom.streaming.sessions import final_states

    rows = final_states(agent_log_of(event_stream(spark, sf_dir)))
    return rounded(rows.select("session_id", "events", "sum_prompt", "sum_completion", "tool_calls", "read_files", "edits", "retries", "first_ms", "last_ms", "usage"))


@query("streaming_rule_alerts")
def _stream_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules over the state kept from micro-batch to micro-batch."""
    from sessionloom.streaming.sessions import all_alerts, shared_folder

    got = all_alerts(agent_log_of(event_slices(spark, sf_dir, shared_folder(spark, "event-slices"))))
    return got.groupBy("session_id", "rule_id", "severity").agg(F.count("*").alias("n"))


FOREVER_MS = 366 * 24 * 3_600_000


@query("streaming_triggers")
def _stream_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When predictions come due, from state kept in the store over four micro-batches."""
    from sessionloom.streaming import stateful
    from sessionloom.streaming.sessions import shared_folder

    log = agent_log_of(event_slices(spark, sf_dir, shared_folder(spark, "event-slices")))
    return stateful.live_rows(log, keep_ms=FOREVER_MS).where("reason IS NOT NULL").select("session_id", "id", "reason")


@query("rehydrated_states")
def _rehydrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream stopped after half of the events, its state read back, and another stream that goes on from it: every event with its state."""
    from sessionloom.streaming import stateful
    from sessionloom.streaming.sessions import shared_folder

    slices, folder = shared_folder(spark, "event-slices"), shared_folder(spark, "halves")
    event_slices(spark, sf_dir, slices)
    first = stateful.run(stateful.live_states(agent_log_of(event_files(spark, sf_dir, f"{slices}/[01]")), keep_ms=FOREVER_MS), f"{folder}/first")
    kept = stateful.kept_states(spark, f"{folder}/first/checkpoint")
    second = stateful.run(stateful.live_states(agent_log_of(event_files(spark, sf_dir, f"{slices}/[23]")), keep_ms=FOREVER_MS, initial=kept), f"{folder}/second")
    return rounded(first.unionByName(second).select("id", "session_id", F.col("version").cast("int").alias("version"), "sum_prompt", "sum_completion", "tool_calls", "read_files", "edits", "retries", "files_read", "files_edited", "usage", "elapsed_ms"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _QUERIES | source_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in ORACLES.items() if k in _QUERIES} | source_queries.SQL
