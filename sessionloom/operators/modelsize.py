"""What size of model a session needs: 34 features, heuristic and behavioural labels, and the fusion of weak labels."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sessionloom.functions import argmax, count_if, has_tail_loop, ratio
from sessionloom.operators.canonical import is_type, session_order

#: Fixed values.
CLASSES = ("mini", "medium", "large")
EDIT_TOOLS = ("edit_file", "apply_edit", "write_to_file", "create_file", "insert_edit", "replace_string_in_file", "multi_replace_string_in_file")
DEFAULT_LIMIT = 256_000
IDLE_MS, IDLE_MOST_MS, DAY_MS = 5_000, 3_600_000, 86_400_000
REWARDS = {"accept": 1.0, "retry": -0.3, "reject": -0.5, "abandon": -0.8, "cancel": -1.0}
BASE_FEATURES = (
    "prompt_tokens completion_tokens context_tokens tool_calls read_files edits retries unique_files_read unique_files_edited elapsed_ms context_utilization read_to_edit_ratio retry_rate has_loop sub_agents auto_label_code auto_confidence".split()
)
TEMPORAL_FEATURES = (
    "hour_of_day day_of_week is_weekend chat_duration_ms tool_duration_ms idle_ms chat_to_tool_ratio accept_rate cancel_rate switch_rate tool_success_rate rolling_avg_tokens rolling_avg_duration rolling_accept_rate ema_tokens ema_retry_rate sessions_today".split()
)


def _given(name: str) -> Column:
    """The value, unless it is 0 or missing."""
    return F.nullif(F.col(name), F.lit(0.0))


def session_size_features(events: DataFrame) -> DataFrame:
    """The 17 base features of each session, in one aggregation.

    A chat counts its tokens, else its context, else a quarter of its length, as prompt; a completion adds prompt and completion tokens. Sessions with
    chats but no real counts get an estimate. Elapsed is the last reported total, else first event to session end, a day at most.
    """
    real = F.coalesce(_given("token_count"), _given("context_token"))
    chat, completion, call = is_type("chat"), is_type("completion"), is_type("tool_call")
    has = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    edit_like = is_type("edit") | (is_type("accept") & (F.coalesce("tool", F.lit("")).isin(*EDIT_TOOLS) | has("file") | has("path")))
    at = F.struct("ts_ms", "id")
    zero = F.lit(0.0)
    sums = events.groupBy("session_id").agg(
        F.coalesce(F.sum(F.when(chat, F.coalesce(real, F.ceil(_given("message_length") / 4))).when(completion, F.coalesce("prompt_tokens", _given("token_count")))), zero).alias("told_prompt"),
        F.coalesce(F.sum(F.when(completion, F.coalesce(F.col("completion_tokens"), _given("response_length")))), zero).alias("completion_tokens"),
        F.coalesce(F.bool_or(chat & real.isNotNull()), F.lit(False)).alias("real"),
        count_if(chat).alias("chats"),
        count_if(call).alias("tool_calls"),
        count_if(is_type("read_file") | (call & has("path"))).alias("read_files"),
        count_if(edit_like).alias("edits"),
        count_if(is_type("retry")).alias("retries"),
        F.count_distinct(F.when((is_type("read_file") | call) & has("path"), F.col("path"))).alias("unique_files_read"),
        F.size(F.array_distinct(F.flatten(F.collect_set(F.when(edit_like, F.array_compact(F.array(F.when(has("file"), F.col("file")), F.when(has("path"), F.col("path"))))))))).alias("unique_files_edited"),
        F.coalesce(F.sum(F.when(is_type("terminal"), F.col("sub_agents"))), zero).alias("sub_agents"),
        F.max_by("elapsed_ms", F.when(completion & F.col("elapsed_ms").isNotNull(), at)).alias("told_elapsed"),
        F.min_by("ts_ms", at).alias("started"),
        F.min_by("ts_ms", F.when(is_type("session_end"), at)).alias("ended"),
        F.max_by("ts_ms", at).alias("last_ts"),
        F.min_by("model_limit", F.when(is_type("session_start"), at)).alias("told_limit"),
        F.max_by("auto_label", F.when(completion & F.col("auto_label").isNotNull(), at)).alias("auto_label"),
        F.max_by("auto_confidence", F.when(completion & F.col("auto_confidence").isNotNull(), at)).alias("told_confidence"),
        F.transform(F.array_sort(F.collect_list(F.when(call, F.struct("ts_ms", "id", F.coalesce("tool", F.lit("unknown")).alias("tool"))))), lambda x: x["tool"]).alias("sequence"),
    )
    guess = F.when(~F.col("real") & (F.col("chats") > 0), 2000 + 500 * F.col("chats") + 200 * F.col("unique_files_read")).otherwise(0)
    limit = F.coalesce("told_limit", F.lit(float(DEFAULT_LIMIT)))
    elapsed = F.coalesce(F.nullif(F.col("told_elapsed"), F.lit(0.0)), F.greatest(F.coalesce("ended", "last_ts") - F.col("started"), F.lit(0)).cast("double"))
    return (
        sums.withColumn("prompt_tokens", F.col("told_prompt") + guess)
        .withColumn("context_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))
        .withColumns(
            {
                "elapsed_ms": F.least(elapsed, F.lit(float(DAY_MS))),
                "context_utilization": F.when(limit > 0, F.col("context_tokens") / limit).otherwise(0.0),
                "read_to_edit_ratio": ratio(F.col("read_files"), F.col("edits"), F.col("read_files").cast("double")),
                "retry_rate": ratio(F.col("retries"), F.col("tool_calls")),
                "has_loop": has_tail_loop(F.col("sequence")).cast("int"),
                "auto_label_code": F.when(F.col("auto_label") == "no_reasoning", 1).when(F.col("auto_label") == "needs_reasoning", 2).otherwise(0),
                "auto_confidence": F.coalesce("told_confidence", zero),
            }
        )
        .select("session_id", *[F.col(c).cast("double").alias(c) for c in BASE_FEATURES])
    )


def temporal_features(events: DataFrame) -> DataFrame:
    """Time of day (UTC), durations, idle time and rates of each session by its own events."""
    order = session_order()
    calls = events.where(is_type("accept", "retry") & F.col("tool_call_id").isNotNull()).groupBy("session_id", "tool_call_id").agg(F.max("ts_ms").alias("done_ts"))
    rows = events.withColumns({"gap": F.col("ts_ms") - F.lag("ts_ms").over(order), "until": F.coalesce(F.lead("ts_ms").over(order), F.col("ts_ms")) - F.col("ts_ms")})
    rows = rows.join(calls, ["session_id", "tool_call_id"], "left")
    took = F.coalesce("duration_ms", F.greatest(F.col("until"), F.lit(0)).cast("double"))
    tool_took = F.when(is_type("tool_call"), F.greatest(F.col("done_ts") - F.col("ts_ms"), F.lit(0)).cast("double")).when(is_type("read_file", "run_test", "terminal"), took)
    start = F.timestamp_millis(F.min("ts_ms"))
    got = rows.groupBy("session_id").agg(
        F.hour(start).alias("hour_of_day"),
        (F.dayofweek(start) - 1).alias("day_of_week"),
        F.coalesce(F.sum(F.when(is_type("chat"), took)), F.lit(0.0)).alias("chat_duration_ms"),
        F.coalesce(F.sum(tool_took), F.lit(0.0)).alias("tool_duration_ms"),
        F.least(F.coalesce(F.sum(F.when(F.col("gap") > IDLE_MS, F.col("gap"))), F.lit(0)), F.lit(IDLE_MOST_MS)).alias("idle_ms"),
        count_if(is_type("chat")).alias("chats"),
        count_if(is_type("tool_call", "read_file", "run_test", "terminal")).alias("tools"),
        count_if(is_type("accept")).alias("accepts"),
        count_if(is_type("accept", "retry", "reject")).alias("feedback"),
        count_if(is_type("accept") & F.coalesce(F.col("success"), F.lit(True))).alias("successes"),
    )
    return got.select(
        "session_id",
        "hour_of_day",
        "day_of_week",
        F.col("day_of_week").isin(0, 6).cast("int").alias("is_weekend"),
        "chat_duration_ms",
        "tool_duration_ms",
        "idle_ms",
        ratio(F.col("chats"), F.col("tools"), F.col("chats").cast("double")).alias("chat_to_tool_ratio"),
        ratio(F.col("accepts"), F.col("feedback")).alias("accept_rate"),
        ratio(F.col("successes"), F.col("feedback")).alias("tool_success_rate"),
    )


def session_history(events: DataFrame) -> DataFrame:
    """Per session what later sessions of its workspace look back on."""
    sizes = session_size_features(events).select("session_id", (F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"), F.col("elapsed_ms").alias("duration"), "retry_rate")
    rates = events.groupBy("session_id").agg(
        F.first("workspace_id").alias("workspace_id"),
        F.min("ts_ms").alias("started"),
        ratio(count_if(is_type("accept")), count_if(is_type("accept", "retry", "reject"))).alias("accept_rate"),
        ((F.count("*") < 3) & (count_if(is_type("accept")) == 0)).alias("cancelled"),
    )
    return rates.join(sizes, "session_id")


def rolling_features(history: DataFrame, last: int = 10, alpha: float = 0.3) -> DataFrame:
    """For each session, means and exponential means of the sessions before it in its workspace, the share of cancelled ones, and those of the same UTC day.

    Sessions of a workspace are ordered by start; frames hold ``last`` rows, so the state of a task is small whatever the workspace's size.
    """
    order = Window.partitionBy("workspace_id").orderBy("started", "session_id")
    recent, before = order.rowsBetween(-last, -1), order.rowsBetween(Window.unboundedPreceding, -1)
    day = Window.partitionBy("workspace_id", F.floor(F.col("started") / DAY_MS)).orderBy("started", "session_id").rowsBetween(Window.unboundedPreceding, -1)

    def ema(name: str) -> Column:
        values = F.collect_list(name).over(recent)
        return F.coalesce(F.aggregate(F.slice(values, 2, last), F.get(values, F.lit(0)), lambda s, x: alpha * x + (1 - alpha) * s), F.lit(0.0))

    return history.select(
        "session_id",
        *[F.coalesce(F.avg(c).over(recent), F.lit(0.0)).alias(n) for c, n in (("total_tokens", "rolling_avg_tokens"), ("duration", "rolling_avg_duration"), ("accept_rate", "rolling_accept_rate"))],
        ema("total_tokens").alias("ema_tokens"),
        ema("retry_rate").alias("ema_retry_rate"),
        F.coalesce(F.avg(F.col("cancelled").cast("double")).over(before), F.lit(0.0)).alias("cancel_rate"),
        F.count("*").over(day).alias("sessions_today"),
    )


def model_size_features(events: DataFrame) -> DataFrame:
    """All 34 features in order, as doubles."""
    rolling = rolling_features(session_history(events)).withColumn("switch_rate", F.lit(0.0))
    rows = session_size_features(events).join(temporal_features(events), "session_id").join(rolling, "session_id")
    return rows.select("session_id", *[F.col(c).cast("double").alias(c) for c in (*BASE_FEATURES, *TEMPORAL_FEATURES)])


def features_from_traces(traces: DataFrame) -> DataFrame:
    """Size features of legacy traces: nested tool calls, changed files and token counts."""
    calls, files = F.size("toolCalls").cast("double"), F.size(F.array_distinct("filesChanged")).cast("double")
    return traces.select(
        "id",
        F.col("inputTokens").cast("double").alias("prompt_tokens"),
        F.col("outputTokens").cast("double").alias("completion_tokens"),
        F.col("contextTokens").cast("double").alias("context_tokens"),
        calls.alias("tool_calls"),
        calls.alias("read_files"),
        files.alias("edits"),
        files.alias("unique_files_edited"),
        (F.col("contextTokens") / DEFAULT_LIMIT).alias("context_utilization"),
        ratio(calls, files, calls).alias("read_to_edit_ratio"),
    )


#: What a trace's calls, files, thoughts and lines of diff add to its complexity, beside 3 for each 20,000 context tokens. Decimals, so that a product such as 3 files of 0.7 is 2.1 and not the double below it.
TRACE_WEIGHTS = {"calls": Decimal("0.5"), "files": Decimal("0.7"), "thoughts": Decimal("0.4"), "diff": Decimal("0.02")}


def _is_test(path: Column) -> Column:
    """Whether a part of a path, cut at slashes, dots, underscores and dashes, says test or spec."""
    return F.arrays_overlap(F.split(F.lower(path), "[/._-]+"), F.array(*map(F.lit, ("test", "tests", "spec", "specs"))))


def trace_evaluation(traces: DataFrame) -> DataFrame:
    """Complexity 1 to 10 of legacy traces, if a smaller model would do, how sure that is, and what speaks for and against it, with the numbers."""
    changed = F.concat(F.coalesce("filesChanged", F.array()), F.transform(F.filter(F.split("finalDiff", "\n"), lambda x: x.startswith("+++ ")), lambda x: F.substring(x, 5, 4096)))
    rows = traces.select(
        "id",
        "contextTokens",
        F.size("toolCalls").alias("calls"),
        F.size(F.array_distinct("filesChanged")).alias("files"),
        F.size(F.split("finalDiff", "\n")).alias("diff"),
        F.size("reasoningSteps").alias("thoughts"),
        F.exists(changed, _is_test).alias("has_tests"),
    )
    raw = sum((F.col(c) * F.lit(w) for c, w in TRACE_WEIGHTS.items()), F.col("contextTokens") / 20000 * 3)
    rows = rows.withColumn("complexity", F.least(F.lit(10), F.greatest(F.lit(1), F.floor(raw + 0.5))))
    small = (F.col("complexity") <= 4) & (F.col("files") <= 3) & (F.col("calls") <= 5)
    notes = {
        "files": F.when(F.col("files") <= 2, F.format_string("for: changes in %d files", "files")).when(F.col("files") > 4, F.format_string("against: changes in %d files", "files")),
        "calls": F.when(F.col("calls") <= 3, F.format_string("for: %d calls of tools", "calls")),
        "thoughts": F.when(F.col("thoughts") <= 2, F.format_string("for: %d steps of reasoning", "thoughts")),
        "context": F.when(F.col("contextTokens") < 4000, F.format_string("for: %d tokens of context", F.col("contextTokens").cast("long"))),
        "tests": F.when(F.col("has_tests"), F.lit("for: tests are among the changes")),
    }
    why = F.array_compact(F.array(*notes.values()))
    return rows.select("id", "complexity", small.alias("smaller_model_possible"), F.when(small, 0.82).otherwise(0.65).alias("confidence"), F.when(F.size(why) > 0, why).otherwise(F.array(F.lit("nothing stands out"))).alias("reasons"))


def success_score(tests: Column, committed: Column, no_retry: Column, no_revert: Column) -> Column:
    """Weighted outcome of a trace, 0 to 1."""
    return tests.cast("int") * 0.4 + committed.cast("int") * 0.3 + no_retry.cast("int") * 0.2 + no_revert.cast("int") * 0.1


# --- labels -------------------------------------------------------------------------------------------------------


def complexity() -> Column:
    return F.col("prompt_tokens") / 1000 + F.col("tool_calls") * 2 + F.col("edits") * 15 + F.col("retries") * 50 + F.col("has_loop") * 100 + F.col("sub_agents") * 30


def label_of(value: Column) -> Column:
    return F.when(value <= 20, "mini").when(value <= 60, "medium").otherwise("large")


def heuristic_labels(sizes: DataFrame) -> DataFrame:
    return sizes.select("session_id", complexity().alias("complexity"), label_of(complexity()).alias("label"))


def behavior_labels(events: DataFrame, sizes: DataFrame, rewards: dict[str, float] = REWARDS) -> DataFrame:
    """Labels by what users did: a negative mean reward asks for a large model, else complexity decides; without any signal the heuristic does."""
    counts = events.groupBy("session_id").agg(
        F.count("*").alias("n"), *[count_if(is_type(t)).alias(f"{t}s") for t in ("accept", "retry", "reject", "chat")]
    )
    rows = counts.join(sizes, "session_id")
    abandoned = (F.col("n") < 3) & (F.col("elapsed_ms") < 30_000)
    cancelled = (F.col("accepts") == 0) & (F.col("chats") <= 1) & (F.col("retrys") == 0)
    total = F.col("accepts") * rewards["accept"] + F.col("retrys") * rewards["retry"] + F.col("rejects") * rewards["reject"] + F.when(abandoned, rewards["abandon"]).otherwise(0.0) + F.when(cancelled, rewards["cancel"]).otherwise(0.0)
    interactions = F.col("accepts") + F.col("retrys") + F.col("rejects") + F.col("chats")
    signals = F.col("accepts") + F.col("retrys") + F.col("rejects") > 0
    rows = rows.withColumn("reward", ratio(total, interactions, total))
    label = F.when(signals & (F.col("reward") < 0), "large").otherwise(label_of(complexity()))
    return rows.select("session_id", "reward", label.alias("label"), F.when(signals, "behavior").otherwise("heuristic").alias("label_source"))


#: Fixed value: events that a session has at least to be learnt from.
LEAST_EVENTS = 3


def with_activity(events: DataFrame, sizes: DataFrame, least_events: int = LEAST_EVENTS) -> DataFrame:
    """Size features of the sessions that can teach something: with so many events, and not without any tokens, calls and reads."""
    enough = events.groupBy("session_id").agg(F.count("*").alias("n")).where(F.col("n") >= least_events).select("session_id")
    active = F.greatest(*[F.coalesce(F.abs(c), F.lit(0.0)) for c in ("prompt_tokens", "completion_tokens", "tool_calls", "read_files")]) > 0
    return sizes.where(active).join(enough, "session_id", "left_semi")


def real_samples(events: DataFrame, by_behavior: bool = True) -> DataFrame:
    """What to learn from real sessions: features, label, its source and reward; ids of sessions that only the heuristic labels begin with ``heuristic:``, for the pseudo-labeller."""
    sizes = with_activity(events, session_size_features(events))
    if by_behavior:
        labels = behavior_labels(events, sizes)
    else:
        labels = heuristic_labels(sizes).select("session_id", F.lit(None).cast("double").alias("reward"), "label", F.lit("heuristic").alias("label_source"))
    rows = sizes.join(labels, "session_id")
    return rows.withColumn("session_id", F.when(F.col("label_source") == "heuristic", F.concat(F.lit("heuristic:"), "session_id")).otherwise(F.col("session_id")))


def anchors(rows: DataFrame, signals: DataFrame, least_confidence: float = 0.7) -> DataFrame:
    """rows: session_id, label; signals: session_id, auto_label, confidence. Rows with the label to start propagation from, and if it is an anchor, which the sure automatic choices are."""
    sure = signals.where(F.col("confidence") >= least_confidence).groupBy("session_id").agg(F.max_by("auto_label", "confidence").alias("auto_label"))
    known = F.col("auto_label").isNotNull()
    return rows.join(sure, "session_id", "left").select(*[c for c in rows.columns if c != "label"], F.coalesce("auto_label", "label").alias("label"), known.alias("is_anchor"), F.when(known, "autoMode").otherwise("heuristic").alias("anchor_source"))


def label_distribution(label: Column) -> Column:
    """0.9 for the label, 0.05 for either other class."""
    return F.array(*[F.when(label == c, 0.9).otherwise(0.05) for c in CLASSES])


def fuse_weak_labels(votes: DataFrame, accuracies: DataFrame) -> DataFrame:
    """votes: entity_id, source, probabilities (mini, medium, large); accuracies: source, accuracy. Mean of the distributions weighted by the odds of each source; sources are few, so they are broadcast."""
    rows = votes.join(F.broadcast(accuracies), "source").withColumn("w", F.col("accuracy") / (1 - F.col("accuracy") + 1e-8))
    sums = rows.groupBy("entity_id").agg(F.sum("w").alias("w"), *[F.sum(F.col("w") * F.get("probabilities", F.lit(i))).alias(f"s{i}") for i in range(3)])
    mixed = F.when(F.col("w") > 0, F.array(*[F.col(f"s{i}") / F.col("w") for i in range(3)])).otherwise(F.array(*[F.lit(1 / 3)] * 3))
    label = F.when(F.col("w") > 0, F.get(F.array(*map(F.lit, CLASSES)), argmax(F.col("probabilities")))).otherwise("medium")
    return sums.withColumn("probabilities", mixed).select("entity_id", "probabilities", label.alias("label"), F.array_max("probabilities").alias("confidence"))


def source_accuracy(votes: DataFrame) -> DataFrame:
    """votes: entity_id, source, label. How often each source agrees with the majority (ties: the lower class) of entities with two votes or more."""
    code = F.array_position(F.array(*map(F.lit, CLASSES)), F.col("label")) - 1
    rows = votes.withColumn("c", code)
    counts = rows.groupBy("entity_id", "c").agg(F.count("*").alias("n"))
    majority = counts.groupBy("entity_id").agg(F.sum("n").alias("total"), F.max_by("c", F.struct("n", -F.col("c"))).alias("m")).where("total >= 2")
    return rows.join(majority, "entity_id").groupBy("source").agg(F.count("*").alias("votes"), F.avg((F.col("c") == F.col("m")).cast("double")).alias("accuracy"))
