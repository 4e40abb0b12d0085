"""Session, tool, behaviour, prompt and workspace features from canonical events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sessionloom.functions import count_if, ratio
from sessionloom.operators.canonical import ASKS, READS, is_type, session_order


def ordered(events: DataFrame) -> DataFrame:
    """Events with their place in the session, neighbours and session-wide counts: what the sequence features share. One exchange by session, one sort."""
    whole, order = Window.partitionBy("session_id"), session_order()
    run_starts = F.when(F.lag("event_type").over(order).eqNullSafe(F.col("event_type")), 0).otherwise(1)
    return (
        events.withColumns(
            {
                "pos": F.row_number().over(order),
                "n": F.count("*").over(whole),
                "prev_type": F.lag("event_type").over(order),
                "next_type": F.lead("event_type").over(order),
                "prev_ts": F.lag("ts_ms").over(order),
                "next_ts": F.lead("ts_ms").over(order),
                "run_start": run_starts,
            }
        )
        .withColumn("run", F.sum("run_start").over(order))
        .withColumn("last_ask", F.max(F.when(is_type(*ASKS), F.col("pos"))).over(whole))
    )


def _session_sums() -> list[Column]:
    return [
        F.min("ts_ms").alias("first_ts"),
        F.max("ts_ms").alias("last_ts"),
        count_if(is_type("completion")).alias("completion_count"),
        count_if(is_type("retry")).alias("retry_count"),
        count_if(is_type("accept")).alias("accept_count"),
        count_if(is_type("reject")).alias("reject_count"),
    ]


def _session_rates(sums: DataFrame) -> DataFrame:
    return sums.withColumns(
        {
            "duration": F.col("last_ts") - F.col("first_ts"),
            "accept_rate": ratio(F.col("accept_count"), F.col("accept_count") + F.col("reject_count")),
            "retry_rate": ratio(F.col("retry_count"), F.col("completion_count")),
        }
    )


def session_features(events: DataFrame) -> DataFrame:
    """First and last time, duration, counts and rates per session; a rate without denominator is 0."""
    return _session_rates(events.groupBy("session_id").agg(*_session_sums()))


def tool_kind() -> Column:
    """terminal, git, mcp or filesystem, in this precedence; null for events without a tool's part."""
    tool = F.coalesce("tool", F.lit(""))
    return (
        F.when(is_type("terminal") | tool.contains("terminal"), "terminal")
        .when(is_type("commit") | tool.contains("git"), "git")
        .when(tool.contains("mcp"), "mcp")
        .when(is_type("read_file", "edit", "tool_call") | tool.contains("read") | tool.contains("file") | tool.contains("edit"), "filesystem")
    )


def tool_features(events: DataFrame) -> DataFrame:
    kinds = events.withColumn("kind", tool_kind())
    return kinds.groupBy("session_id").agg(*[count_if(F.col("kind") == k).alias(f"{k}_calls") for k in ("terminal", "git", "mcp", "filesystem")])


SESSION_COLUMNS = ("first_ts", "last_ts", "completion_count", "retry_count", "accept_count", "reject_count", "duration", "accept_rate", "retry_rate")
BEHAVIOR_COLUMNS = ("avg_read_before_ask", "avg_retry_distance", "tool_switch_frequency", "context_expansion_speed", "workflow_entropy", "retry_burst_score", "edit_after_accept_ratio", "workflow_length")


def _course(events: DataFrame) -> DataFrame:
    """Session and behaviour features and the type of the last event, by one exchange and one aggregation over the ordered events."""
    rows = ordered(events)
    of_type, of_run = Window.partitionBy("session_id", "event_type"), Window.partitionBy("session_id", "run")
    rows = rows.withColumns({"type_n": F.count("*").over(of_type), "run_n": F.count("*").over(of_run)})
    retry = is_type("retry")
    after_accept = F.col("prev_type") == "accept"
    sums = rows.groupBy("session_id").agg(
        *_session_sums(),
        F.count("*").alias("workflow_length"),
        count_if(is_type(*ASKS)).alias("asks"),
        count_if(is_type(*READS) & (F.col("pos") < F.col("last_ask"))).alias("reads"),
        F.max(F.when(retry, F.col("pos"))).alias("last_retry"),
        F.min(F.when(retry, F.col("pos"))).alias("first_retry"),
        count_if(F.col("prev_type") != F.col("event_type")).alias("switches"),
        F.sum(F.coalesce("prompt_tokens", "token_count", F.lit(0.0))).alias("tokens"),
        F.sum(-F.ln(F.col("type_n") / F.col("n")) / F.col("n")).alias("entropy"),
        F.max(F.when(retry, F.col("run_n"))).alias("longest"),
        count_if(after_accept).alias("accepts_followed"),
        count_if(after_accept & is_type("edit")).alias("edits_after"),
        F.max(F.when(F.col("pos") == F.col("n"), F.col("event_type"))).alias("last_type"),
    )
    length = F.col("workflow_length")
    return _session_rates(sums).withColumns(
        {
            "avg_read_before_ask": ratio(F.col("reads"), F.col("asks")),
            "avg_retry_distance": F.when(F.col("retry_count") > 1, (F.col("last_retry") - F.col("first_retry")) / (F.col("retry_count") - 1)).otherwise(0.0),
            "tool_switch_frequency": F.when(length > 1, F.col("switches") / (length - 1)).otherwise(0.0),
            "context_expansion_speed": F.col("tokens") / length,
            "workflow_entropy": F.when(length > 1, F.col("entropy") / F.ln(length)).otherwise(0.0),
            "retry_burst_score": ratio(F.coalesce("longest", F.lit(0)), F.col("retry_count")),
            "edit_after_accept_ratio": ratio(F.col("edits_after"), F.col("accepts_followed")),
        }
    )


def behavior_features(events: DataFrame) -> DataFrame:
    """The eight measures of a session's course.

    Reads before an ask count if an ask follows; retry distance is the mean gap of places; entropy of the types is
    relative to ln(number of events); burst is the longest run of retries by all retries; edits after accepts by accepts that have a successor.
    """
    return _course(events).select("session_id", *BEHAVIOR_COLUMNS)


def prompt_features(events: DataFrame) -> DataFrame:
    """Per prompt the first chat's numbers, the share of tokens in context and of history in tokens."""
    chats = events.where(is_type("chat")).withColumn("prompt", F.coalesce("prompt_id", F.concat(F.lit("prompt-"), F.col("ts_ms").cast("string"))))
    first = F.min_by(F.struct("session_id", "ts_ms", "token_count", "context_token", "history_token", "retrieved_files", "retrieved_symbols"), F.struct("ts_ms", "id"))
    got = chats.groupBy("prompt").agg(first.alias("f"))
    zero = F.lit(0.0)
    numbers = [F.coalesce(f"f.{c}", zero).alias(c) for c in ("token_count", "context_token", "history_token", "retrieved_files", "retrieved_symbols")]
    return got.select("prompt", "f.session_id", "f.ts_ms", *numbers).withColumns(
        {"prompt_density": ratio(F.col("token_count"), F.col("context_token")), "history_ratio": ratio(F.col("history_token"), F.col("token_count"))}
    )


def workspace_features(events: DataFrame) -> DataFrame:
    """Per workspace, over all its sessions: distinct files, languages and branches, lines of code, dependencies, complexity."""
    file = F.nullif(F.coalesce("path", "file"), F.lit(""))
    return (
        events.groupBy("workspace_id")
        .agg(
            F.count_distinct(file).alias("files"),
            F.count_distinct("language").alias("language_count"),
            F.count_distinct("branch").alias("branch_count"),
            F.coalesce(F.sum("loc"), F.lit(0.0)).alias("total_loc"),
            F.coalesce(F.max(F.coalesce("dependency_count", F.size("dependencies").cast("double"))), F.lit(0.0)).alias("dependency_count"),
        )
        .withColumn("total_files", F.greatest("files", F.lit(1)))
        .withColumn("complexity", 0.4 * F.ln("total_files") + 0.3 * F.col("language_count") + 0.3 * F.greatest("dependency_count", F.lit(0.0)))
        .drop("files")
    )


def session_view(events: DataFrame) -> DataFrame:
    """Session and behaviour features side by side, of one pass over the events."""
    return _course(events).select("session_id", *SESSION_COLUMNS, *BEHAVIOR_COLUMNS)


def failure_classes(events: DataFrame) -> DataFrame:
    """The first failure class whose thresholds a session meets, with its confidence and evidence."""
    rows = _course(events)
    burst, rate, speed, spread = (F.col(c) for c in ("retry_burst_score", "retry_rate", "context_expansion_speed", "workflow_entropy"))
    kind = (
        F.when((burst > 0.5) & (rate > 0.3), "retry_loop")
        .when((speed > 500) | ((rate > 0.3) & (speed > 200)), "context_explosion")
        .when((spread < 0.7) & (rate > 0.2), "wrong_context")
        .when((F.col("last_type") == "reject") & (F.col("accept_count") == 0), "user_cancel")
        .otherwise("none")
    )
    sure = (
        F.when(F.col("failure_type") == "retry_loop", F.least(F.lit(1.0), burst + rate))
        .when(F.col("failure_type") == "context_explosion", F.least(F.lit(1.0), speed / 1000))
        .when(F.col("failure_type") == "wrong_context", 0.6)
        .when(F.col("failure_type") == "user_cancel", 0.8)
        .otherwise(0.0)
    )
    evidence = (
        F.when(F.col("failure_type") == "retry_loop", F.array(F.format_string("retryBurstScore=%.2f", burst), F.format_string("retryRate=%.2f", rate)))
        .when(F.col("failure_type") == "context_explosion", F.array(F.format_string("contextExpansionSpeed=%.0f", speed)))
        .when(F.col("failure_type") == "wrong_context", F.array(F.format_string("workflowEntropy=%.2f", spread), F.format_string("retryRate=%.2f", rate)))
        .when(F.col("failure_type") == "user_cancel", F.array(F.lit("nothing was accepted and the last event is a reject")))
        .otherwise(F.array().cast("array<string>"))
    )
    return rows.withColumn("failure_type", kind).select("session_id", "failure_type", sure.alias("confidence"), evidence.alias("evidence"))


def failure_runs(events: DataFrame) -> DataFrame:
    """Failures in the course of sessions: each run of three retries or more, and an ending in a reject without any accept."""
    rows = ordered(events)
    runs = (
        rows.where(is_type("retry"))
        .groupBy("session_id", "run")
        .agg(F.count("*").alias("length"), F.min("ts_ms").alias("ts_ms"))
        .where("length >= 3")
        .select("session_id", F.lit("retry_loop").alias("failure_type"), F.lit(0.7).alias("confidence"), "length", "ts_ms")
    )
    ends = (
        events.groupBy("session_id")
        .agg(F.max_by(F.struct("event_type", "ts_ms"), F.struct("ts_ms", "id")).alias("last"), count_if(is_type("accept")).alias("accepts"))
        .where("last.event_type = 'reject' AND accepts = 0")
        .select("session_id", F.lit("user_cancel").alias("failure_type"), F.lit(0.8).alias("confidence"), F.lit(1).cast("bigint").alias("length"), "last.ts_ms")
    )
    return runs.unionByName(ends)
