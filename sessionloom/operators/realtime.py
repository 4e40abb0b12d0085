"""Running session state, alert rules, health, advice, phases and prediction triggers over agent log events.

The batch forms here and the streaming forms in ``sessionloom.streaming`` agree; time is event time throughout.
"""

from __future__ import annotations

import math
import os
from collections.abc import Mapping
from dataclasses import dataclass, fields

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sessionloom.functions import count_loops, has_tail_loop, ratio, round_half_up, tail_repeats

#: Fixed values.
DEFAULT_LIMIT = 256_000.0
BYTES_PER_TOKEN = 4
RECENT_TOOLS = 12
READ_TOOLS = ("read_file", "readfile")
HEALTH_WEIGHTS = {"context": 0.4, "retry": 0.2, "loop": 0.2, "latency": 0.1, "prompt": 0.1}
SAVINGS = {"mini": 60, "medium": 25, "large": 0}

#: Columns of agent log events, ordered by (ts_ms, id) in a session.
LOG_COLUMNS = "id bigint, ts_ms bigint, session_id string, type string, tool string, path string, file string, prompt_tokens double, completion_tokens double, model string, model_limit double, success boolean, diff_lines double, sub_agents double"


def _order():
    return Window.partitionBy("session_id").orderBy("ts_ms", "id").rowsBetween(Window.unboundedPreceding, 0)


def _reads() -> Column:
    return (F.col("type") == "tool_call") & F.lower("tool").isin(*READ_TOOLS)


def running_state(log: DataFrame) -> DataFrame:
    """Every event with the session's counters up to it. One exchange by session; all counters share one window, the list of tools keeps the last RECENT_TOOLS."""
    so_far = _order()
    llm, call, edit = (F.col("type") == t for t in ("llm_request", "tool_call", "edit"))
    zero = F.lit(0.0)
    total = lambda c, when: F.sum(F.when(when, F.coalesce(c, zero)).otherwise(zero)).over(so_far)
    number = lambda when: F.count(F.when(when, 1)).over(so_far)
    failed = (call | edit) & (F.coalesce(F.col("success"), F.lit(True)) == F.lit(False))
    calls = Window.partitionBy("session_id").orderBy("call_no").rangeBetween(-(RECENT_TOOLS - 1), 0)
    path = F.nullif(F.coalesce("path", "file"), F.lit(""))
    first_read = F.row_number().over(Window.partitionBy("session_id", "read_path").orderBy("ts_ms", "id"))
    first_edit = F.row_number().over(Window.partitionBy("session_id", "edit_file").orderBy("ts_ms", "id"))
    rows = log.withColumns({"call_no": number(call), "read_path": F.when(_reads(), path), "edit_file": F.when(edit, F.coalesce("file", F.lit("unknown")))})
    rows = rows.withColumns({"new_read": (F.col("read_path").isNotNull() & (first_read == 1)).cast("int"), "new_edit": (F.col("edit_file").isNotNull() & (first_edit == 1)).cast("int")})
    return rows.withColumns(
        {
            "version": F.row_number().over(Window.partitionBy("session_id").orderBy("ts_ms", "id")),
            "sum_prompt": total(F.col("prompt_tokens"), llm),
            "sum_completion": total(F.col("completion_tokens"), llm),
            "tool_calls": F.col("call_no"),
            "read_files": number(_reads()),
            "edits": number(edit),
            "retries": number(failed),
            "files_read": F.sum("new_read").over(so_far),
            "files_edited": F.sum("new_edit").over(so_far),
            "sum_agents": total(F.col("sub_agents"), F.lit(True)),
            "limit": F.coalesce(F.last(F.when(F.col("type") == "session_start", F.col("model_limit")), ignorenulls=True).over(so_far), F.lit(DEFAULT_LIMIT)),
            "elapsed_ms": F.col("ts_ms") - F.min("ts_ms").over(so_far),
            "recent_tools": F.collect_list(F.when(call, F.coalesce("tool", F.lit("unknown")))).over(calls),
        }
    ).withColumns({"context_tokens": F.col("sum_prompt") + F.col("sum_completion"), "usage": ratio(F.col("sum_prompt") + F.col("sum_completion"), F.col("limit"))}).drop("call_no", "read_path", "edit_file", "new_read", "new_edit")


def at_version(states: DataFrame, version: int) -> DataFrame:
    """Sessions as they were after so many events (from 1)."""
    return states.where(F.col("version") == version)


def final_state(states: DataFrame) -> DataFrame:
    """The last state of each session."""
    names = [c for c in states.columns if c != "session_id"]
    return states.groupBy("session_id").agg(F.max_by(F.struct(*names), F.struct("ts_ms", "id")).alias("s")).select("session_id", "s.*")


# --- rules --------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    """A rule: columns over a running state say when it fires, how grave it is, and its message."""

    id: str
    fires: Column
    severity: Column
    message: Column


@dataclass(frozen=True)
class RuleLimits:
    """Fixed defaults of the rules' thresholds."""

    context_warning: float = 0.8
    context_critical: float = 0.95
    reads: int = 20
    loop_window: int = 10
    loop_repeats: int = 4
    retries: int = 3
    prompt_growth: float = 10_000
    diff_lines: float = 100
    model_words: tuple[str, ...] = ("mini", "large", "sonnet")


def limits_from(environment: Mapping[str, str] = os.environ) -> RuleLimits:
    """Limits by SESSIONLOOM_RULE_ and the name of a limit in capitals, where that is a number (model_words: words between commas); others keep their defaults."""
    given: dict[str, object] = {}
    for field in fields(RuleLimits):
        value = environment.get(f"SESSIONLOOM_RULE_{field.name.upper()}", "").strip()
        if field.name == "model_words":
            words = tuple(w.strip().lower() for w in value.split(",") if w.strip())
            given |= {field.name: words} if words else {}
        elif value:
            try:
                number = float(value)
            except ValueError:
                continue
            given |= {field.name: number if isinstance(field.default, float) else int(number)} if math.isfinite(number) else {}
    return RuleLimits(**given)


def default_rules(limits: RuleLimits = RuleLimits()) -> list[Rule]:
    llm, call, edit = (F.col("type") == t for t in ("llm_request", "tool_call", "edit"))
    failed = (call | edit) & (F.coalesce(F.col("success"), F.lit(True)) == F.lit(False))
    warn = F.lit("warning")
    percent = F.floor(F.col("usage") * 100 + 0.5).cast("int")
    return [
        Rule("context-too-large", llm & (F.col("usage") >= limits.context_warning), F.when(F.col("usage") >= limits.context_critical, "critical").otherwise("warning"), F.format_string("Context at %d%%", percent)),
        Rule("read-file-storm", _reads() & (F.col("read_files") >= limits.reads), warn, F.format_string("%d files read", "read_files")),
        Rule("tool-loop", call & tail_repeats(F.col("recent_tools"), limits.loop_window, limits.loop_repeats), warn, F.concat(F.lit("Tools repeat: "), F.array_join(F.slice("recent_tools", -2, 2), " > "))),
        Rule("retry-spike", failed & (F.col("retries") >= limits.retries), warn, F.format_string("%d failures", "retries")),
        Rule("prompt-explosion", llm & (F.coalesce("prompt_tokens", F.lit(0.0)) >= limits.prompt_growth), warn, F.format_string("Prompt grew by %.0f tokens", "prompt_tokens")),
        Rule("large-diff", edit & (F.coalesce("diff_lines", F.lit(0.0)) >= limits.diff_lines), F.lit("info"), F.format_string("%.0f lines changed", "diff_lines")),
        Rule("model-switch", llm & F.lower(F.coalesce("model", F.lit(""))).rlike("|".join(limits.model_words)), F.lit("info"), F.concat(F.lit("Model "), F.col("model"))),
    ]


def alerts(states: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """A row per rule that fires at an event; ids come from the event, so a rerun gives the same alerts."""
    fired = [F.when(r.fires, F.struct(F.lit(r.id).alias("rule_id"), r.severity.alias("severity"), r.message.alias("message"))) for r in rules or default_rules()]
    rows = states.select("session_id", "id", "ts_ms", F.explode(F.array_compact(F.array(*fired))).alias("a"))
    return rows.select(F.concat("a.rule_id", F.lit("-"), F.col("id").cast("string")).alias("alert_id"), "session_id", "id", "ts_ms", "a.*")


def snapshot_rules() -> list[Rule]:
    """Rules over states with phases (see ``phases``): usage at any event, stuck planning, a loop of tools, a failed phase."""
    stuck = (F.col("type") == "llm_request") & (F.col("planning_run") >= 4)
    return [
        Rule("ctx-too-large", F.col("usage") >= 0.8, F.when(F.col("usage") >= 0.95, "critical").otherwise("warning"), F.format_string("Context at %d%%", F.floor(F.col("usage") * 100 + 0.5).cast("int"))),
        Rule("stuck-planning", stuck, F.lit("warning"), F.format_string("Planning for the %d. time in a row", "planning_run")),
        Rule("tool-loop-v5", (F.col("type") == "tool_call") & has_tail_loop(F.col("recent_tools")), F.lit("warning"), F.concat(F.lit("The last tools repeat, up to "), F.element_at("recent_tools", -1))),
        Rule("phase-failed", F.col("phase") == "Failed", F.lit("critical"), F.lit("The session has failed")),
    ]


# --- phases -------------------------------------------------------------------------------------------------------

#: The phase that an event leads to whatever came before.
ABSOLUTE_PHASES = {"session_start": "Planning", "tool_call": "CallingTool", "tool_result": "WaitingTool", "edit": "Editing", "review": "Reviewing", "error": "Failed"}


def phases(log: DataFrame) -> DataFrame:
    """Every event with the phase it leaves the session in.

    Most events name their phase. An LLM request turns Planning into Thinking; the end gives Finished unless the phase is Failed; others keep the phase.
    So an event's phase follows from the last naming event before it and what came since, which windows give: no fold is needed.
    """
    so_far = _order()
    named = F.lit(None).cast("string")
    for kind, phase in ABSOLUTE_PHASES.items():
        named = F.when(F.col("type") == kind, phase).otherwise(named)
    rows = log.withColumn("named", named)
    rows = rows.withColumn("block", F.count("named").over(so_far))
    inside = Window.partitionBy("session_id", "block").orderBy("ts_ms", "id").rowsBetween(Window.unboundedPreceding, 0)
    base = F.coalesce(F.max("named").over(inside), F.lit("Idle"))
    thought = F.max(F.when(F.col("type") == "llm_request", 1).otherwise(0)).over(inside)
    ended = F.max(F.when(F.col("type") == "session_end", 1).otherwise(0)).over(inside)
    phase = F.when(base == "Failed", base).when(ended == 1, "Finished").when((base == "Planning") & (thought == 1), "Thinking").otherwise(base)
    rows = rows.withColumn("phase", phase)
    starts = F.when(F.col("phase").eqNullSafe(F.lag("phase").over(Window.partitionBy("session_id").orderBy("ts_ms", "id"))), 0).otherwise(1)
    rows = rows.withColumn("is_transition", starts)
    # how many transitions to Planning, one after the other, the last ones were
    other = F.sum(F.when((F.col("is_transition") == 1) & (F.col("phase") != "Planning"), 1).otherwise(0)).over(so_far)
    rows = rows.withColumn("others", other)
    run = Window.partitionBy("session_id", "others").orderBy("ts_ms", "id").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("planning_run", F.sum(F.when((F.col("is_transition") == 1) & (F.col("phase") == "Planning"), 1).otherwise(0)).over(run)).drop("named", "block", "others")


def timeline(log: DataFrame) -> DataFrame:
    """A row per change of phase: when, to what, by which event, and how long it held."""
    order = Window.partitionBy("session_id").orderBy("ts_ms", "id")
    changes = phases(log).where("is_transition = 1").select("session_id", "id", "ts_ms", "type", "phase")
    return changes.withColumn("held_ms", F.lead("ts_ms").over(order) - F.col("ts_ms"))


def annotated(log: DataFrame) -> DataFrame:
    """Every event with the phase it leaves the session in, and where that is another than before, ``annotation``: from what to what."""
    order = Window.partitionBy("session_id").orderBy("ts_ms", "id")
    before = F.coalesce(F.lag("phase").over(order), F.lit("Idle"))
    rows = phases(log).withColumn("before", before)
    return rows.withColumn("annotation", F.when(F.col("phase") != F.col("before"), F.concat("before", F.lit(" -> "), "phase"))).drop("before")


def render_timeline(rows: DataFrame) -> DataFrame:
    """One text per session: a line for each change of phase."""
    line = F.concat(F.col("ts_ms").cast("string"), F.lit(" "), F.rpad("phase", 12, " "), F.lit(" <- "), "type")
    got = rows.select("session_id", F.struct("ts_ms", "id", line.alias("line")).alias("x")).groupBy("session_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return got.select("session_id", F.array_join(F.transform("x", lambda e: e["line"]), "\n").alias("timeline"))


# --- health and advice --------------------------------------------------------------------------------------------


def health(states: DataFrame) -> DataFrame:
    """Health 0 to 100 and its label from five weighted parts; parts are not held above 0, as failures can outnumber calls."""
    usage, retry = F.least(F.col("usage"), F.lit(1.0)), ratio(F.col("retries"), F.col("tool_calls"))
    parts = {
        "context": (1 - usage) * 100,
        "retry": (1 - retry) * 100,
        "loop": F.when(count_loops(F.col("recent_tools")) > 0, 30.0).otherwise(100.0),
        "latency": (1 - F.least(F.col("elapsed_ms") / 60000, F.lit(1.0))) * 100,
        "prompt": (1 - F.least(F.col("sum_prompt") / 50000, F.lit(1.0))) * 100,
    }
    score = sum((parts[k] * w for k, w in HEALTH_WEIGHTS.items()), F.lit(0.0))
    rows = states.withColumn("health", round_half_up(score).cast("int"))
    label = F.when(F.col("health") >= 90, "Excellent").when(F.col("health") >= 75, "Good").when(F.col("health") >= 50, "Warning").otherwise("Critical")
    return rows.withColumn("health_label", label)


def metrics(states: DataFrame) -> DataFrame:
    """Live numbers of a state: cost in dollars, latency, loops, and the eight normalised measures."""
    tools = F.col("recent_tools")
    return states.select(
        "session_id",
        "id",
        "context_tokens",
        "tool_calls",
        (F.col("sum_prompt") * 5e-6 + F.col("sum_completion") * 15e-6).alias("cost"),
        F.col("elapsed_ms").alias("latency"),
        "retries",
        count_loops(tools).alias("loops"),
        F.col("usage").alias("context_usage"),
        ratio(F.col("retries"), F.col("tool_calls") + F.col("edits")).alias("retry_rate"),
        has_tail_loop(tools).cast("int").alias("loop_detected"),
        F.least(F.col("sum_prompt") / 50000, F.lit(1.0)).alias("prompt_growth_rate"),
        ratio(F.size(F.array_distinct(tools)), F.col("tool_calls")).alias("tool_diversity"),
        F.least((F.col("files_read") + F.col("files_edited")) / 30, F.lit(1.0)).alias("file_entropy"),
        F.least(F.col("sum_agents") / 5, F.lit(1.0)).alias("subagent_pressure"),
    )


def multi_health(measured: DataFrame, stuck: Column | None = None) -> DataFrame:
    """Six dimensions of health and their mean, from ``metrics``; ``stuck`` says if a session is stuck in planning."""
    stuck = F.lit(0) if stuck is None else stuck.cast("int")
    loop = F.col("loop_detected") == 0
    one = F.lit(1.0)
    dims = {
        "execution": (1 - F.col("retry_rate")) * 60 + F.when(loop, 40).otherwise(10),
        "reasoning": 100 - F.least(F.col("prompt_growth_rate"), one) * 60 - stuck * 40,
        "context": (1 - F.least(F.col("context_usage"), one)) * 100,
        "tool": (1 - F.least(F.col("tool_diversity"), one) / 2) * 50 + F.when(loop, 50).otherwise(15),
        "planning": F.when(stuck == 0, 90).otherwise(30),
        "memory": 100 - F.least(F.col("file_entropy") * 100, F.lit(60.0)) - F.least(F.col("subagent_pressure") * 100, F.lit(30.0)),
    }
    rows = measured.withColumns({f"h_{k}": round_half_up(v.cast("double")) for k, v in dims.items()})
    return rows.withColumn("overall", round_half_up(sum((F.col(f"h_{k}") for k in dims), F.lit(0.0)) / len(dims)))


def advice(states: DataFrame, alerted: DataFrame | None = None) -> DataFrame:
    """Task complexity and the model to use for final states; ``alerted`` has alerts, of which tool loops count."""
    looped = alerted.where(F.col("rule_id") == "tool-loop").select("session_id").distinct().withColumn("looped", F.lit(True)) if alerted is not None else None
    rows = states.join(looped, "session_id", "left") if looped is not None else states.withColumn("looped", F.lit(False))
    looped_ = F.coalesce(F.col("looped"), F.lit(False))
    prompt, calls, edited, read = (F.col(c) for c in ("sum_prompt", "tool_calls", "files_edited", "files_read"))
    score = (
        F.when(prompt < 8000, 10).when(prompt < 30000, 30).otherwise(50)
        + F.when(calls <= 5, 5).otherwise(20)
        + F.when((edited <= 2) & (read <= 5), 5).otherwise(20)
        + F.when(F.col("retries") > 0, 15).otherwise(0)
        + F.when(looped_, 20).otherwise(0)
        + F.when(F.col("sum_agents") > 0, 20).otherwise(0)
    )
    mini = (prompt < 8000) & (calls <= 5) & (edited <= 2) & (F.col("retries") == 0) & (F.col("sum_agents") == 0)
    rows = rows.withColumn("raw_complexity", score)
    model = F.when(mini & (F.col("raw_complexity") <= 30), "mini").when(F.col("raw_complexity") <= 60, "medium").otherwise("large")
    rows = rows.withColumn("model", model)
    return rows.select(
        "session_id",
        F.least("raw_complexity", F.lit(100)).alias("complexity"),
        "model",
        F.when(F.col("model") == "mini", 0.85).when(F.col("model") == "medium", 0.7).otherwise(0.75).alias("confidence"),
        F.when(F.col("model") == "mini", SAVINGS["mini"]).when(F.col("model") == "medium", SAVINGS["medium"]).otherwise(SAVINGS["large"]).alias("saving_percent"),
    )


def predictions(states: DataFrame, health_overall: Column) -> DataFrame:
    """Votes of the rule and the heuristic predictor per session: entity_id, source, model, confidence; to be fused."""
    prompt, calls, edited = F.col("sum_prompt"), F.col("tool_calls"), F.col("files_edited")
    mini = (prompt < 8000) & (calls <= 5) & (edited <= 2) & (F.col("retries") == 0) & (F.col("sum_agents") == 0)
    large = (F.col("context_tokens") > 60000) | (calls > 30) | (F.col("sum_agents") > 1) | (health_overall < 50)
    one = F.lit(1.0)
    score = F.least(prompt / 80000, one) * 30 + F.least(calls / 40, one) * 25 + F.least(edited / 10, one) * 15 + F.least(F.col("retries") / 5, one) * 15 + F.least(F.col("sum_agents") / 3, one) * 15
    rule = F.struct(F.lit("rule").alias("source"), F.when(mini, "mini").when(large, "large").otherwise("medium").alias("model"), F.when(mini, 0.8).when(large, 0.75).otherwise(0.7).alias("confidence"))
    heuristic = F.struct(F.lit("heuristic").alias("source"), F.when(score < 30, "mini").when(score < 65, "medium").otherwise("large").alias("model"), (0.6 + F.least(score / 200, F.lit(0.2))).alias("confidence"))
    return states.select(F.col("session_id").alias("entity_id"), F.inline(F.array(rule, heuristic)))


def prediction_triggers(states: DataFrame, max_events: int = 5, max_tokens: float = 5000, max_ms: int = 30_000) -> DataFrame:
    """Events at which a prediction is due: so many events, tokens or so much time after the last one; the first event seeds the clock.

    Whether one is due depends on the last that was, so each session's events go through a fold in order, which holds three numbers and no events however long the session is.
    """
    kind = states.schema["session_id"].dataType.simpleString()
    rows = states.select("session_id", F.col("id").cast("bigint").alias("id"), F.col("ts_ms").cast("bigint").alias("ts_ms"), F.col("version").cast("bigint").alias("version"), F.coalesce(F.col("context_tokens"), F.lit(0.0)).cast("double").alias("tokens"))

    def fold(batches):
        session, since = None, (0, 0, 0.0)
        for batch in batches:
            out: list[tuple] = []
            for own, id_, ts, version, tokens in zip(*(c.to_pylist() for c in batch.columns)):
                if own != session:
                    session, since = own, (ts, 0, 0.0)
                if version - since[1] >= max_events:
                    reason = "events"
                elif tokens - since[2] >= max_tokens:
                    reason = "tokens"
                elif ts - since[0] >= max_ms and version > since[1]:
                    reason = "time"
                else:
                    continue
                out.append((own, id_, reason))
                since = ts, version, tokens
            columns = list(zip(*out)) if out else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field(0).type), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], names=["session_id", "id", "reason"])

    ordered = rows.repartition("session_id").sortWithinPartitions("session_id", "ts_ms", "id")
    return ordered.mapInArrow(fold, f"session_id {kind}, id bigint, reason string")
