"""The driver's test tables as canonical events, agent logs and chat sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.operators.canonical import complete


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream."""
    return spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def event_slices(spark: SparkSession, sf_dir: str, folder: str, slices: int = 4, files: int = 4) -> DataFrame:
    """The events table as a stream of so many micro-batches, each a stretch of time, from files that are written to ``folder`` one stretch after the other. Sessions go on from batch to batch."""
    rows = table(spark, sf_dir, "events")
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    first, last = rows.agg(F.min(at), F.max(at)).first()
    stretch = F.floor((at - first) * slices / (last - first + 1)) if first is not None else F.lit(0)
    for k in range(slices):
        rows.where(stretch == k).repartition(files).write.parquet(f"{folder}/{k}")
    return event_files(spark, sf_dir, folder, files)


def event_files(spark: SparkSession, sf_dir: str, folder: str, files: int = 4) -> DataFrame:
    """Files that ``event_slices`` wrote as a stream."""
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files).parquet(folder)


def _events(raw: DataFrame) -> DataFrame:
    return raw.select(
        F.col("event_id").alias("id"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("session_id"),
        F.concat(F.lit("ws"), (F.col("user_id") % 10).cast("string")).alias("workspace_id"),
        F.col("event_type").alias("raw"),
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table by its plain columns: id, ts_ms, session_id, workspace_id, raw (the type), value and k, a number from 0 to 99."""
    return _events(table(spark, sf_dir, "events"))


def canonical_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user are a session: clicks are chats, signups completions, purchases accepts, errors retries or rejects, views reads, edits or tool calls."""
    raw, k = F.col("raw"), F.col("k")
    kind = (
        F.when(raw == "click", "chat")
        .when(raw == "signup", "completion")
        .when(raw == "purchase", "accept")
        .when(raw == "error", F.when(k % 2 == 0, "retry").otherwise("reject"))
        .when(k % 3 == 0, "read_file")
        .when(k % 3 == 1, "edit")
        .otherwise("tool_call")
    )
    rows = _events(table(spark, sf_dir, "events")).withColumn("event_type", kind)
    asks = F.col("event_type").isin("chat", "completion")
    chat = F.col("event_type") == "chat"
    return complete(
        rows.withColumns(
            {
                "token_count": F.when(asks, F.col("value")),
                "path": F.when(F.col("event_type").isin("read_file", "edit"), F.concat(F.lit("file"), k.cast("string"))),
                "tool": F.when(F.col("event_type") == "tool_call", F.concat(F.lit("tool"), (k % 7).cast("string"))),
                "tool_call_id": F.when(F.col("event_type").isin("tool_call", "accept", "retry"), F.concat(F.lit("c"), (k % 10).cast("string"))),
                "prompt_id": F.when(chat, F.concat(F.col("session_id"), F.lit("-"), k.cast("string"))),
                "context_token": F.when(chat, F.col("value") * 2),
                "history_token": F.when(chat, F.col("value") * (k % 4) / 4),
                "language": F.when(k % 5 == 0, F.concat(F.lit("lang"), (k % 3).cast("string"))),
                "branch": F.when(k % 11 == 0, F.concat(F.lit("b"), (k % 2).cast("string"))),
                "loc": F.when(F.col("event_type") == "edit", k.cast("double")),
                "dependency_count": F.when(k % 13 == 0, (k % 6).cast("double")),
            }
        )
    )


def agent_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agent_log_of(table(spark, sf_dir, "events"))


def agent_log_of(events: DataFrame) -> DataFrame:
    """The same events as an agent's log: clicks are LLM requests, purchases edits, views and even errors tool calls, odd errors errors, signups starts, ends or tool results."""
    raw, k = F.col("raw"), F.col("k")
    kind = (
        F.when(raw == "click", "llm_request")
        .when(raw == "purchase", "edit")
        .when(raw == "view", "tool_call")
        .when(raw == "error", F.when(k % 2 == 0, "tool_call").otherwise("error"))
        .otherwise(F.when(k % 10 == 0, "session_start").when(k % 10 == 1, "session_end").otherwise("tool_result"))
    )
    rows = _events(events).withColumn("type", kind)
    llm, call, edit = (F.col("type") == t for t in ("llm_request", "tool_call", "edit"))
    return rows.select(
        "id",
        "ts_ms",
        "session_id",
        "type",
        F.when(call, F.when(k % 4 == 0, "read_file").otherwise(F.concat(F.lit("tool"), (k % 3).cast("string")))).alias("tool"),
        F.when(call, F.concat(F.lit("file"), k.cast("string"))).alias("path"),
        F.when(edit, F.concat(F.lit("file"), k.cast("string"))).alias("file"),
        F.when(llm, F.col("value") * 100).alias("prompt_tokens"),
        F.when(llm, F.col("value") * 10).alias("completion_tokens"),
        F.when(llm, F.when(k % 10 == 0, "some-mini").otherwise("base")).alias("model"),
        F.lit(None).cast("double").alias("model_limit"),
        F.when(call | edit, ~((raw == "error") | (edit & (k % 5 == 0)))).alias("success"),
        F.when(edit, F.col("value")).alias("diff_lines"),
        F.lit(None).cast("double").alias("sub_agents"),
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as turns of chat sessions."""
    return table(spark, sf_dir, "conversations").select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("session_id"), F.col("turn").alias("turn_index"), "role", "text")
