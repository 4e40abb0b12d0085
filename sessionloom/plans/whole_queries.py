"""Queries that compare whole rows of operators, sinks and loops; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.operators import features, graph, learn, mining, modelsize, realtime, trust, vectors
from sessionloom.plans import analysis
from sessionloom.plans.adapter import agent_log, agent_log_of, canonical_events, event_slices, table
from sessionloom.plans.oracles import LOG, ORACLES
from sessionloom.plans.source_queries import _BRIDGED, KNN_FEATURES, _distributions, anchored_sizes, query
from sessionloom.sources import tables
from sessionloom.sources.logged import Store
from sessionloom.streaming.sessions import shared_folder, start_event_store

# --- vectors, failures, phases ------------------------------------------------------------------------------------

_LOGS = ", ".join(f"CASE WHEN {c} > 0 THEN ln(1 + {c}) ELSE 0 END" for c in vectors.PROMPT_LOGS)


@query(
    "prompt_vector",
    f"WITH p AS ({ORACLES['prompt_features'].strip()}), x AS (SELECT prompt, [prompt_density, history_ratio, {_LOGS}]::DOUBLE[] AS x FROM p WHERE prompt IS NOT NULL) SELECT prompt, unnest(range(5))::INT AS pos, round(unnest(CASE WHEN list_dot_product(x, x) > 0 THEN list_transform(x, lambda v: v / sqrt(list_dot_product(x, x))) ELSE x END), 4) AS x FROM x",
)
def _prompt_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every component of every prompt's vector."""
    prompts = features.prompt_features(canonical_events(spark, sf_dir))
    rounded = prompts.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in prompts.dtypes])
    rows = vectors.prompt_vectors(rounded).where("prompt IS NOT NULL")
    return rows.select("prompt", F.posexplode("vector").alias("pos", "x")).withColumn("x", F.round("x", 4))


@query("stored_embeddings", f"WITH s AS ({ORACLES['session_embedding'].strip()}) SELECT 'session' AS entity_type, session_id AS entity_id, 'features' AS model, CASE WHEN substr(session_id, 2)::INT < 5 THEN 2 ELSE 1 END AS version, pos, x FROM s")
def _stored_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors computed for all sessions and prompts and kept with model and version, then again for the first sessions as version 2; those of sessions are read back."""
    store, events = Store(spark, shared_folder(spark, "embeddings")), canonical_events(spark, sf_dir)
    analysis.embed_all(events, store, 1)
    analysis.embed_all(events.where(F.substring("session_id", 2, 20).cast("int") < 5), store, 2, version=2)
    rows = store.read("embeddings").where("entity_type = 'session'")
    return rows.select("entity_type", "entity_id", "model", "version", F.posexplode("vector").alias("pos", "x")).withColumn("x", F.round("x", 6))


_CLASSES = ORACLES["failure_classes"].strip()
_PROOF = {"retry_loop": "retryBurstScore,retryRate", "context_explosion": "contextExpansionSpeed", "wrong_context": "workflowEntropy,retryRate", "user_cancel": "nothing was accepted and the last event is a reject", "none": ""}


@query("failure_evidence", f"WITH f AS ({_CLASSES}) SELECT session_id, failure_type, CASE failure_type {' '.join(f'''WHEN '{k}' THEN '{v}' ''' for k, v in _PROOF.items())} END AS evidence FROM f")
def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each class rests on, by name; the figures are those that other queries compare."""
    rows = features.failure_classes(canonical_events(spark, sf_dir))
    return rows.select("session_id", "failure_type", F.array_join(F.transform("evidence", lambda e: F.substring_index(e, "=", 1)), ",").alias("evidence"))


@query("workspace_failure_types", f"WITH f AS ({_CLASSES}), w AS (SELECT DISTINCT 'u' || user_id AS session_id, 'ws' || (user_id % 10) AS workspace_id FROM events) SELECT workspace_id, failure_type, count(*) AS n FROM w JOIN f USING (session_id) WHERE failure_type <> 'none' GROUP BY 1, 2")
def _failure_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.workspace_failures(canonical_events(spark, sf_dir)).select("workspace_id", F.explode("failures").alias("failure_type", "n"))


_TIMELINE = ORACLES["phase_timeline"].strip()
#: Every event with its phase: the SQL of the timeline up to its CTE ``p``.
_PHASES = _TIMELINE[: _TIMELINE.index("      t AS (SELECT *, lag(phase)")].rstrip().rstrip(",")


@query(
    "annotated_timeline",
    f"""{_PHASES}, a AS (SELECT session_id, id, phase, coalesce(lag(phase) OVER (PARTITION BY session_id ORDER BY ts_ms, id), 'Idle') AS before FROM p)
    SELECT session_id, id, phase, CASE WHEN phase <> before THEN before || ' -> ' || phase END AS annotation FROM a""",
)
def _annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return realtime.annotated(agent_log(spark, sf_dir)).select("session_id", "id", "phase", "annotation")


_TAIL = "(len(rt) >= 8 AND ((rt[-2:] = rt[-4:-3] AND rt[-4:-3] = rt[-6:-5]) OR (len(rt) >= 9 AND rt[-3:] = rt[-6:-4] AND rt[-6:-4] = rt[-9:-7]) OR (len(rt) >= 12 AND rt[-4:] = rt[-8:-5] AND rt[-8:-5] = rt[-12:-9])))"


@query(
    "snapshot_rules",
    f"""{_PHASES}, s AS (SELECT st.session_id, st.id, st.type, usage, coalesce(tools, [])[-12:] AS rt, phase FROM st JOIN p USING (id)),
    r AS (SELECT session_id, id, unnest([CASE WHEN usage >= 0.8 THEN 'ctx-too-large:' || CASE WHEN usage >= 0.95 THEN 'critical' ELSE 'warning' END END, CASE WHEN type = 'tool_call' AND {_TAIL} THEN 'tool-loop-v5:warning' END, CASE WHEN phase = 'Failed' THEN 'phase-failed:critical' END]) AS a FROM s)
    SELECT session_id, id, split_part(a, ':', 1) AS rule_id, split_part(a, ':', 2) AS severity FROM r WHERE a IS NOT NULL""",
)
def _snapshot_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All four rules over all events. No event reaches a fourth transition to Planning in a row, so one rule gives nothing in either form."""
    log = agent_log(spark, sf_dir)
    states = realtime.running_state(log).join(realtime.phases(log).select("id", "phase", "planning_run"), "id")
    return realtime.alerts(states, realtime.snapshot_rules()).select("session_id", "id", "rule_id", "severity")


# --- decisions ----------------------------------------------------------------------------------------------------

_SAMPLES = """WITH d AS (SELECT doc_id, doc_id % 97 / 100.0::DOUBLE AS a, 0.99 - doc_id % 97 / 100.0::DOUBLE AS b, doc_id % 10 / 10.0::DOUBLE AS draw FROM labels),
  e AS (SELECT *, greatest(a, b, 0.01) AS best, greatest(least(a, b), least(greatest(a, b), 0.01)) AS second, -(CASE WHEN a > 0 THEN a * ln(a) ELSE 0 END + CASE WHEN b > 0 THEN b * ln(b) ELSE 0 END + 0.01 * ln(0.01)) / ln(3) AS h FROM d)"""


@query(
    "sampled_by_strategy",
    f"""{_SAMPLES} SELECT 'random' AS strategy, doc_id FROM e WHERE draw < 0.3 UNION ALL SELECT 'confidence', doc_id FROM e WHERE draw < least(0.6, greatest(0, (0.7 - best) / 0.7) * 0.6)
    UNION ALL SELECT 'uncertainty', doc_id FROM e WHERE h >= 0.9 AND draw < 0.3 UNION ALL SELECT 'active', doc_id FROM e WHERE best - second <= 0.15 AND draw < 0.3""",
)
def _by_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that each of the four strategies draws."""
    rows, out = _distributions(spark, sf_dir), None
    for strategy in ("random", "confidence", "uncertainty", "active"):
        part = trust.sampling(rows, strategy, 0.3, F.col("doc_id") % 10 / 10).where("sampled").select(F.lit(strategy).alias("strategy"), "doc_id")
        out = part if out is None else out.unionAll(part)
    return out


_FUSED = ORACLES["weighted_fusion"].strip()
_THREE = "[{'p': mini, 'm': 'mini'}, {'p': medium, 'm': 'medium'}, {'p': large, 'm': 'large'}]"


@query(
    "whole_decisions",
    f"""WITH h AS ({_FUSED}), r AS (SELECT entity_id, greatest(mini, medium, large) AS c, list_sort({_THREE}, 'DESC') AS o FROM h),
    x AS (SELECT entity_id, c, o, entity_id % 4000 AS pt, entity_id % 300 AS ct, entity_id % 3 AS rt, entity_id % 2 AS lp, entity_id % 10 / 10.0 AS cu FROM r),
    y AS (SELECT *, (c < 0.6)::INT + (rt > 0)::INT + (lp > 0)::INT + (cu > 0.7)::INT AS n FROM x)
    SELECT entity_id, o[1].m AS model, round(c, 5) AS confidence, o[2].m || ',' || o[3].m AS alternatives, CASE WHEN n >= 3 THEN 'high' WHEN n >= 1 THEN 'medium' ELSE 'low' END AS risk, n::INT AS factors,
      CASE o[1].m WHEN 'mini' THEN 0.87 WHEN 'medium' THEN 0.92 ELSE 0.95 END::DOUBLE AS success, (pt + ct)::DOUBLE AS tokens,
      round((pt * CASE o[1].m WHEN 'mini' THEN 0.15 WHEN 'medium' THEN 3 ELSE 15 END + ct * CASE o[1].m WHEN 'mini' THEN 0.6 WHEN 'medium' THEN 15 ELSE 75 END)::DOUBLE / 1e6, 4) AS cost,
      CASE o[1].m WHEN 'mini' THEN 60 WHEN 'medium' THEN 25 ELSE 0 END::INT AS saving_percent, concat_ws(',', CASE WHEN rt * 50 > pt / 1000.0 THEN 'retries' END, CASE WHEN pt > 0 THEN 'prompt_tokens' END, CASE WHEN rt > 0 AND rt * 50 <= pt / 1000.0 THEN 'retries' END) AS reasons FROM y""",
)
def _whole_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions over features that differ from entity to entity, with all that they say but the counterfactual."""
    from sessionloom.plans.queries import votes

    rows = votes(spark, sf_dir)
    e = F.col("entity_id")
    known = {"prompt_tokens": e % 4000, "completion_tokens": e % 300, "retries": e % 3, "has_loop": e % 2}
    sizes = rows.select("entity_id").distinct().select("entity_id", *[v.cast("double").alias(k) for k, v in known.items()], (e % 10 / 10).alias("context_utilization"))
    score = lambda c: c["prompt_tokens"] / 1000 + c["retries"] * 50
    # the same digits as the SQL's fusion has
    fused = trust.weighted_fusion(rows.withColumnRenamed("label", "model"))
    fused = fused.select("entity_id", *[F.round(c, 6).alias(c) for c in modelsize.CLASSES])
    got = trust.whole_decisions(fused, sizes, score, lambda c: modelsize.label_of(score(c)), ["prompt_tokens", "retries"])
    return got.select(
        "entity_id", "model", F.round("confidence", 5).alias("confidence"), F.array_join("alternatives", ",").alias("alternatives"), "risk", F.size("risk_factors").alias("factors"), "success", "tokens", F.round("cost", 4).alias("cost"), "saving_percent",
        F.array_join(F.transform("reasons", lambda r: r["feature"]), ",").alias("reasons"),
    )


@query(
    "shadow_runs",
    f"""WITH {LOG}, s AS (SELECT session_id, substr(session_id, 2)::BIGINT AS u, sum_prompt < 8000 AND tool_calls <= 5 AND files_edited <= 2 AND retries = 0 AS small, CASE WHEN sum_prompt < 50000 THEN 'mini' ELSE 'medium' END AS model FROM fin),
    d AS (SELECT *, small OR u * 7 % 10 / 10.0 > 0.3 AS ok FROM s WHERE u % 10 / 10.0 < 0.4)
    SELECT session_id, 'mini' AS shadow_model, ok::INT AS shadow_success, CASE WHEN ok THEN model WHEN model = 'mini' THEN 'medium' ELSE 'large' END AS label, CASE WHEN ok THEN 0.95 ELSE 0.6 END::DOUBLE AS label_confidence, (SELECT count(*) FROM s) AS total, (SELECT count(*) FROM d) AS sampled FROM d""",
)
def _shadow(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = realtime.final_state(realtime.running_state(agent_log(spark, sf_dir))).withColumn("model", F.when(F.col("sum_prompt") < 50_000, "mini").otherwise("medium"))
    user = F.substring("session_id", 2, 20).cast("bigint")
    ran, stats = trust.shadow_run(states, 0.4, user % 10 / 10, lambda rows: trust.heuristic_shadow(rows, user * 7 % 10 / 10))
    return ran.crossJoin(F.broadcast(stats)).select("session_id", "shadow_model", F.col("shadow_success").cast("int").alias("shadow_success"), "label", "label_confidence", "total", "sampled")


@query(
    "scorecards",
    """WITH x AS (SELECT doc_id, doc_id % 11 / 10.0::DOUBLE AS a, doc_id % 7 / 6.0::DOUBLE AS f, doc_id % 3 / 10.0::DOUBLE AS b, doc_id % 5 / 10.0::DOUBLE AS e, (doc_id % 101)::DOUBLE AS c, (doc_id % 13)::DOUBLE AS i, (doc_id % 1500)::DOUBLE AS l, doc_id % 2 = 0 AS t, doc_id % 3 = 0 AS m, doc_id % 5 = 0 AS n, doc_id % 7 = 0 AS v FROM labels),
    s AS (SELECT *, a * 30 + f * 25 + (1 - b) * 15 + (1 - e) * 10 + c / 10 - i * 0.15 - least(l / 1000, 1) * 5 AS score FROM x)
    SELECT doc_id, CASE WHEN score >= 85 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' WHEN score >= 45 THEN 'D' ELSE 'F' END AS grade, round(t::INT * 0.4 + m::INT * 0.3 + n::INT * 0.2 + v::INT * 0.1, 6)::DOUBLE AS success FROM s""",
)
def _scorecards(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    part = lambda m, by: (d % m).cast("double") / by
    grade = trust.scorecard(part(11, 10), part(7, 6), part(3, 10), part(5, 10), part(101, 1), part(13, 1), part(1500, 1))
    return table(spark, sf_dir, "labels").select("doc_id", grade.alias("grade"), F.round(modelsize.success_score(*[d % k == 0 for k in (2, 3, 5, 7)]), 6).alias("success"))


# --- samples and sinks --------------------------------------------------------------------------------------------

_SIZES = f"WITH f AS ({ORACLES['model_size_features'].strip()})"


@query("active_sessions", f"{_SIZES}, n AS (SELECT 'u' || user_id AS session_id, count(*) AS n FROM events GROUP BY 1) SELECT session_id, prompt_tokens FROM f JOIN n USING (session_id) WHERE n >= 60 AND greatest(abs(prompt_tokens), abs(completion_tokens), abs(tool_calls), abs(read_files)) > 0")
def _active(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that can teach something, here of sixty events or more."""
    events = canonical_events(spark, sf_dir)
    return modelsize.with_activity(events, modelsize.session_size_features(events), 60).select("session_id", F.round("prompt_tokens", 6).alias("prompt_tokens"))


@query("training_csv", f"{_SIZES}, h AS ({ORACLES['heuristic_label'].strip()}) SELECT session_id, label, {', '.join(f'{c}::DOUBLE AS {c}' for c in KNN_FEATURES)}, 'session_id:Auxiliary,label:Label,{','.join(f'{c}:Num' for c in KNN_FEATURES)}' AS described FROM f JOIN h USING (session_id)")
def _training_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training matrix written as CSV with its description, and both read back."""
    sizes = modelsize.session_size_features(canonical_events(spark, sf_dir))
    rows = sizes.join(modelsize.heuristic_labels(sizes).select("session_id", "label"), "session_id").select("session_id", "label", *[F.round(c, 6).cast("double").alias(c) for c in KNN_FEATURES])
    path = shared_folder(spark, "csv")
    tables.write_training_csv(rows, path)
    told = spark.read.schema("position int, kind string, name string").option("sep", "\t").csv(f"{path}.cd")
    # a row a column
    line = told.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "name", "kind"))), lambda c: F.concat(c["name"], F.lit(":"), c["kind"])), ",").alias("described"))
    return spark.read.schema(rows.schema).option("header", "true").csv(path).crossJoin(F.broadcast(line))


@query("kept_traces", "SELECT doc_id AS id, source AS task, n_chars AS tokens FROM documents")
def _kept_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces that were appended in two goes, as they are read back."""
    path = shared_folder(spark, "traces")
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("task"), F.col("n_chars").alias("tokens"))
    for k in range(2):
        tables.append_traces(rows.where(F.col("id") % 2 == k), path)
    return tables.read_traces(spark, path).select("id", "task", "tokens")


@query(
    "stored_events",
    f"""WITH {LOG}, b AS (SELECT session_id, ts_ms, {_BRIDGED} AS event_type FROM lg), c AS (SELECT session_id, ts_ms, unnest(CASE event_type WHEN 'completion' THEN ['chat', 'completion'] ELSE [event_type] END) AS event_type FROM b WHERE event_type IS NOT NULL),
    e AS (SELECT DISTINCT session_id FROM c WHERE event_type = 'session_end') SELECT session_id, strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%d') AS day, event_type, count(*) AS n, (session_id IN (SELECT session_id FROM e))::INT AS has_features FROM c GROUP BY 1, 2, 3, 5""",
)
def _stored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event store after four micro-batches: its events by session and day, and which sessions have features, of which each has one row."""
    root = shared_folder(spark, "event-store")
    start_event_store(agent_log_of(event_slices(spark, sf_dir, f"{root}/in")), f"{root}/store", f"{root}/checkpoint").awaitTermination()
    store = Store(spark, f"{root}/store")
    known = store.read("features").groupBy("session_id").agg(F.count("*").cast("int").alias("has_features"))
    counts = store.read("events").groupBy("session_id", F.date_format(F.timestamp_millis("ts_ms"), "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("n"))
    return counts.join(known, "session_id", "left").withColumn("has_features", F.coalesce("has_features", F.lit(0)))


@query(
    "insight",
    f"""WITH a AS ({ORACLES['markov_anomaly'].strip()}), t AS ({ORACLES['trend_summary'].strip()}) SELECT count(*) AS events, count(DISTINCT user_id) AS sessions, any_value(round(anomaly_score, 4)) AS anomaly_score, any_value(health_direction) AS health_direction,
    count(DISTINCT user_id) || ' sessions with ' || count(*) || ' events' AS said FROM events, a, t""",
)
def _insight(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = mining.insight(canonical_events(spark, sf_dir))
    return row.select("events", "sessions", F.round("anomaly_score", 4).alias("anomaly_score"), "health_direction", F.substring_index("insight", ";", 1).alias("said"))


# --- a loop of label propagation ----------------------------------------------------------------------------------

ROUNDS = 10


def _propagated() -> str:
    """SQL of ROUNDS rounds, one after the other."""
    width = range(1, len(KNN_FEATURES) + 1)
    parts = [
        f"f AS ({ORACLES['model_size_features'].strip()})",
        f"h AS ({ORACLES['heuristic_label'].strip()})",
        f"r AS (SELECT f.session_id AS s, label, [{', '.join(KNN_FEATURES)}]::DOUBLE[] AS raw FROM f JOIN h USING (session_id))",
        f"st AS (SELECT {', '.join(f'avg(raw[{i}]) AS m{i}, stddev_pop(raw[{i}]) AS s{i}' for i in width)} FROM r)",
        f"z AS MATERIALIZED (SELECT s, CASE WHEN substr(s, 2)::INT % 2 = 0 THEN list_position(['mini', 'medium', 'large'], label) - 1 END AS a, [{', '.join(f'(raw[{i}] - m{i}) / CASE WHEN s{i} > 0 THEN s{i} ELSE 1 END' for i in width)}] AS x FROM r, st)",
        "w AS MATERIALIZED (SELECT i.s, j.s AS o, exp(-list_sum(list_transform(list_zip(i.x, j.x), lambda q: (q[1] - q[2]) * (q[1] - q[2]))) / 2) AS w FROM z i, z j WHERE i.s <> j.s)",
        "p0 AS (SELECT s, a, c, CASE WHEN a = c THEN 1.0 WHEN a IS NULL THEN 1.0::DOUBLE / 3 ELSE 0 END::DOUBLE AS p FROM z, range(3) AS k(c))",
    ]
    for n in range(ROUNDS):
        parts.append(f"q{n} AS (SELECT w.s, c, sum(w * p) / sum(w) AS p FROM w JOIN p{n} ON p{n}.s = w.o GROUP BY 1, 2 HAVING sum(w) > 0)")
        parts.append(f"p{n + 1} AS MATERIALIZED (SELECT p{n}.s, a, p{n}.c, CASE WHEN a IS NOT NULL THEN p{n}.p ELSE coalesce(q{n}.p, 0) END AS p FROM p{n} LEFT JOIN q{n} ON q{n}.s = p{n}.s AND q{n}.c = p{n}.c)")
    return f"WITH {', '.join(parts)} SELECT s AS session_id, c::INT AS class, round(p, 4) AS p FROM p{ROUNDS}"


@query("propagated_labels", _propagated())
def _propagated_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of every second session spread to all in ROUNDS rounds: every distribution."""
    found = learn.propagate_labels(anchored_sizes(spark, sf_dir), KNN_FEATURES, rounds=ROUNDS, tolerance=0)
    return found.select("session_id", F.posexplode("probabilities").alias("class", "p")).withColumn("p", F.round("p", 4))
