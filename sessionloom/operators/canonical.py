"""The canonical event table: raw metadata as VARIANT, promoted to typed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Promoted columns: name, type, metadata keys in order of preference. The keys are those that log writers use.
PROMOTED: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    ("tool", "string", ("tool", "toolName")),
    ("path", "string", ("path",)),
    ("file", "string", ("file",)),
    ("prompt_id", "string", ("promptId",)),
    ("token_count", "double", ("tokenCount",)),
    ("prompt_tokens", "double", ("promptTokens",)),
    ("completion_tokens", "double", ("outputTokens", "completionTokens")),
    ("context_token", "double", ("contextToken",)),
    ("history_token", "double", ("historyToken",)),
    ("retrieved_files", "double", ("retrievedFiles",)),
    ("retrieved_symbols", "double", ("retrievedSymbols",)),
    ("message_length", "double", ("messageLength",)),
    ("response_length", "double", ("responseLength",)),
    ("duration_ms", "double", ("durationMs",)),
    ("elapsed_ms", "double", ("totalElapsedMs",)),
    ("tool_call_id", "string", ("toolCallId",)),
    ("success", "boolean", ("success",)),
    ("language", "string", ("language",)),
    ("languages", "array<string>", ("languages",)),
    ("dependencies", "array<string>", ("dependencies",)),
    ("dependency_count", "double", ("dependencies",)),
    ("loc", "double", ("loc",)),
    ("branch", "string", ("branch",)),
    ("author", "string", ("author",)),
    ("model", "string", ("model",)),
    ("model_limit", "double", ("modelLimit",)),
    ("diff_lines", "double", ("diffLines",)),
    ("sub_agents", "double", ("subAgents",)),
    ("auto_label", "string", ("autoModePredictedLabel",)),
    ("auto_confidence", "double", ("autoModeConfidence",)),
)
KEYS = ("id", "ts_ms", "session_id", "workspace_id", "event_type")
KEY_TYPES = {"id": "bigint", "ts_ms": "bigint", "session_id": "string", "workspace_id": "string", "event_type": "string"}

#: The canonical event types.
EVENT_TYPES = ("open_file", "read_file", "chat", "completion", "accept", "reject", "retry", "edit", "run_test", "terminal", "tool_call", "commit", "session_start", "session_end", "switch_model")
ASKS = ("chat", "completion")
READS = ("read_file", "open_file")


def promote(events: DataFrame, metadata: str = "metadata") -> DataFrame:
    """Typed columns from the VARIANT ``metadata``; a value of another type than its column's is null."""
    names = [
        F.coalesce(*[F.try_variant_get(metadata, f"$.{key}", kind) for key in keys]).alias(name) for name, kind, keys in PROMOTED
    ]
    return events.select(*[F.col(k).cast(KEY_TYPES[k]).alias(k) for k in KEYS], *names)


def complete(events: DataFrame) -> DataFrame:
    """Events with all promoted columns, null where there are none."""
    have = set(events.columns)
    return events.select(*[F.col(k).cast(KEY_TYPES[k]).alias(k) for k in KEYS], *[(F.col(n) if n in have else F.lit(None)).cast(t).alias(n) for n, t, _ in PROMOTED])


def from_rows(spark: SparkSession, rows: list[tuple], start: int = 1) -> DataFrame:
    """Events of (ts_ms, session_id, workspace_id, event_type, metadata JSON or None), numbered in order, promoted: for fixtures and small imports."""
    numbered = [(start + i, *row) for i, row in enumerate(rows)]
    raw = spark.createDataFrame(numbered, "id bigint, ts_ms bigint, session_id string, workspace_id string, event_type string, json string")
    return promote(raw.withColumn("metadata", F.try_parse_json(F.coalesce("json", F.lit("{}")))))


def session_order() -> object:
    """One order for all sequence operators, so Spark plans one exchange and one sort for them."""
    return Window.partitionBy("session_id").orderBy("ts_ms", "id")


def is_type(*types: str) -> Column:
    return F.col("event_type").isin(*types)


def catalog(spark: SparkSession) -> DataFrame:
    """The event catalog: type, version, providers, metadata fields, whether it bounds a session. Fixed values."""
    kinds = [
        ("read_file", ["ide", "agent"], ["path"], False),
        ("chat", ["ide", "agent"], ["promptId", "tokenCount"], False),
        ("completion", ["agent"], ["tokenCount"], False),
        ("accept", ["ide"], [], False),
        ("reject", ["ide"], [], False),
        ("retry", ["ide", "agent"], [], False),
        ("edit", ["ide", "agent"], ["file"], False),
        ("run_test", ["agent"], ["toolName"], False),
        ("terminal", ["agent"], ["command"], False),
        ("tool_call", ["agent"], ["toolName"], False),
        ("commit", ["git"], ["branch", "author"], False),
        ("session_start", ["ide"], [], True),
        ("session_end", ["ide"], [], True),
        ("switch_model", ["ide"], ["model"], False),
    ]
    return spark.createDataFrame([(t, 1, p, {f: "string" for f in m}, b) for t, p, m, b in kinds], "type string, version int, providers array<string>, metadata_fields map<string,string>, is_session_boundary boolean")


def by_provider(events_catalog: DataFrame, provider: str) -> DataFrame:
    return events_catalog.where(F.array_contains("providers", provider))


def missing_fields(events: DataFrame, events_catalog: DataFrame) -> DataFrame:
    """Events with raw JSON metadata (``json``) and the catalogued fields that they lack; nothing is rejected."""
    known = events_catalog.select(F.col("type").alias("event_type"), "metadata_fields")
    return events.join(F.broadcast(known), "event_type", "left").withColumn("missing", F.array_except(F.map_keys("metadata_fields"), F.coalesce(F.json_object_keys("json"), F.array().cast("array<string>"))))


# --- selections ---------------------------------------------------------------------------------------------------


def by_session(events: DataFrame, session_id: str) -> DataFrame:
    return events.where(F.col("session_id") == session_id).orderBy("ts_ms", "id")


def by_type(events: DataFrame, event_type: str, limit: int = 1000) -> DataFrame:
    return events.where(F.col("event_type") == event_type).orderBy("ts_ms", "id").limit(limit)


def by_workspace(events: DataFrame, workspace_id: str, from_ms: int | None = None, to_ms: int | None = None) -> DataFrame:
    """A workspace's events in a closed range of time."""
    found = events.where(F.col("workspace_id") == workspace_id)
    found = found.where(F.col("ts_ms") >= from_ms) if from_ms is not None else found
    return found.where(F.col("ts_ms") <= to_ms) if to_ms is not None else found


def type_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count("*").alias("n"))


def sessions(events: DataFrame) -> DataFrame:
    return events.select("session_id").distinct()


# --- agent log events to canonical events -------------------------------------------------------------------------


def _tool_type(tool: Column) -> Column:
    """The canonical type of a tool's call."""
    name = F.lower(tool)
    return (
        F.when(name.isin("read_file", "readfile"), "read_file")
        .when(name.isin("run_test", "run_tests", "runtests") | name.contains("test"), "run_test")
        .when(name.contains("terminal"), "terminal")
        .when(name.contains("commit"), "commit")
        .otherwise("tool_call")
    )


def bridge_one_row(log: DataFrame) -> DataFrame:
    """Agent log events (type, session_id, ts_ms, tool, success, ...) to one canonical event each: an LLM request is a completion; an edit is an accept, or a retry if it failed. Rows of other types go."""
    failed = F.coalesce(F.col("success"), F.lit(True)) == F.lit(False)
    kind = (
        F.when(F.col("type").isin("session_start", "session_end", "commit"), F.col("type"))
        .when(F.col("type") == "llm_request", "completion")
        .when(F.col("type") == "tool_call", _tool_type(F.coalesce("tool", F.lit(""))))
        .when((F.col("type") == "edit") & failed, "retry")
        .when(F.col("type") == "edit", "accept")
    )
    return log.withColumn("event_type", kind).where("event_type IS NOT NULL").drop("type")


def bridge_with_chat(log: DataFrame) -> DataFrame:
    """As bridge_one_row, but an LLM request is a chat and a completion at the same time, in that order, under a prompt id counted in the session; ``ordinal`` keeps them apart."""
    number = F.sum(F.when(F.col("type") == "llm_request", 1).otherwise(0)).over(Window.partitionBy("session_id").orderBy("ts_ms", "id"))
    log = log.withColumn("prompt_no", number)
    rows = bridge_one_row(log)
    twice = rows.withColumn("event_type", F.explode(F.when(F.col("event_type") == "completion", F.array(F.lit("chat"), F.lit("completion"))).otherwise(F.array("event_type"))))
    prompt = F.when(F.col("event_type").isin(*ASKS), F.concat("session_id", F.lit("-p"), "prompt_no"))
    return twice.withColumn("prompt_id", prompt).withColumn("ordinal", F.when(F.col("event_type") == "completion", 1).otherwise(0)).drop("prompt_no")
