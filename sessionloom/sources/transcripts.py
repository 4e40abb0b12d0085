"""Transcripts of agent runs: lines with a type, data and an ISO time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sessionloom.operators.modelsize import EDIT_TOOLS


def entries(lines: DataFrame) -> DataFrame:
    """lines: value, file, line_no. Typed entries; lines without a valid time or type go. The session is named by its start, else by the file."""
    rows = lines.withColumn("v", F.try_parse_json("value"))
    get = lambda path, kind="string": F.try_variant_get("v", path, kind)
    rows = rows.withColumns({"type": get("$.type"), "ts_ms": F.unix_millis(F.try_to_timestamp(get("$.timestamp")))})
    # a filter would be moved before the parsing and parse each line again
    rows = rows.select("file", "line_no", F.inline(F.when(F.col("type").isNotNull() & F.col("ts_ms").isNotNull(), F.array(F.struct("type", "ts_ms", "v")))))
    name = F.regexp_extract("file", r"([^/]+?)(?:\.jsonl)?$", 1)
    told = F.first(F.when(F.col("type") == "session.start", get("$.data.sessionId")), ignorenulls=True).over(Window.partitionBy("file"))
    return rows.withColumn("session_id", F.coalesce(told, name))


def lifecycle(typed: DataFrame) -> DataFrame:
    """Per file: session, producer, versions, first and last time, number of entries."""
    get = lambda path: F.max(F.when(F.col("type") == "session.start", F.try_variant_get("v", path, "string")))
    return typed.groupBy("file").agg(
        F.first("session_id").alias("session_id"), get("$.data.producer").alias("producer"), get("$.data.copilotVersion").alias("agent_version"), get("$.data.vscodeVersion").alias("editor_version"), F.min("ts_ms").alias("started_ms"), F.max("ts_ms").alias("ended_ms"), F.count("*").alias("entries")
    )


def transcript_events(typed: DataFrame, workspace_id: str = "transcript-workspace") -> DataFrame:
    """Canonical events of transcripts: starts, chats, tool calls and completions of messages, reads, and an accept or retry for each tool that completes after its start.

    A completion belongs to the latest start of the same call before it that no other completion has taken: the n-th completion of a call meets its n-th start.
    Each file gets a session end if it has none. Order in a file is (ts_ms, line_no, ordinal).
    """
    get = lambda path, kind="string": F.try_variant_get("v", path, kind)
    of = lambda path: get(f"$.data.arguments{path[1:]}")
    kind = F.col("type")
    begins, completes, said = kind == "tool.execution_start", kind == "tool.execution_complete", kind == "assistant.message"
    # what is taken out of an entry is taken once; the entry itself goes no further
    rows = typed.select(
        "session_id", "ts_ms", "file", "line_no", "type", get("$.data.toolCallId").alias("call_id"), get("$.data.toolName").alias("tool_name"), F.length(F.coalesce(get("$.data.content"), F.lit(""))).cast("double").alias("characters"),
        F.when(said, get("$.data.toolRequests", "array<struct<name: string, toolCallId: string>>")).alias("requests"), F.coalesce(get("$.data.success", "boolean"), F.lit(False)).alias("ok"),
        F.when(begins, F.coalesce(of("$.filePath"), of("$.path"), F.lit("unknown"))).alias("read"), F.when(begins, F.coalesce(*[F.nullif(of(p), F.lit("")) for p in ("$.filePath", "$.path", "$.file", "$.replacements[0].filePath")])).alias("edited"),
    )
    # the n-th start and the n-th completion of a call stand in one partition; all windows need no other exchange than that by file
    rows = rows.withColumn("side", F.when(begins, 1).when(completes, 2)).withColumn("nth", F.when(F.col("side").isNotNull(), F.row_number().over(Window.partitionBy("file", "call_id", "side").orderBy("line_no"))))
    start = F.max(F.when(begins, F.struct("line_no", "ts_ms", F.coalesce("tool_name", F.lit("unknown")).alias("used"), "edited"))).over(Window.partitionBy("file", "call_id", "nth"))
    rows = rows.withColumn("begun", F.when(completes & F.col("call_id").isNotNull(), start))
    line = typed.schema["line_no"].dataType
    fields = {"line_no": line, "ordinal": "int", "event_type": "string", "message_length": "double", "tool": "string", "tool_call_id": "string", "response_length": "double", "path": "string", "file": "string", "duration_ms": "double", "success": "boolean"}

    def event(event_type, ordinal=0, **parts):
        parts = {"line_no": F.col("line_no"), "ordinal": F.lit(ordinal) if isinstance(ordinal, int) else ordinal, "event_type": F.lit(event_type) if isinstance(event_type, str) else event_type} | parts
        return F.struct(*[parts.get(c, F.lit(None)).cast(t).alias(c) for c, t in fields.items()])

    calls = F.transform("requests", lambda q, i: event("tool_call", i, tool=F.coalesce(q["name"], F.lit("unknown")), tool_call_id=q["toolCallId"]))
    answer = F.array(event("completion", 1_000_000, response_length=F.col("characters")))
    used = F.col("begun.used")
    ends = event(
        F.when(F.col("ok"), "accept").otherwise("retry"), file=F.when(used.isin(*EDIT_TOOLS), F.col("begun.edited")), tool=used, tool_call_id=F.col("call_id"), duration_ms=F.col("ts_ms") - F.col("begun.ts_ms"), success=F.col("ok")
    )
    told = (
        F.when(kind == "session.start", F.array(event("session_start")))
        .when(kind == "user.message", F.array(event("chat", message_length=F.col("characters"))))
        .when(said, F.when(F.col("requests").isNull(), answer).otherwise(F.concat(calls, answer)))
        .when(begins & F.col("tool_name").isin("read_file", "read"), F.array(event("read_file", path=F.col("read"), tool=F.col("tool_name"), tool_call_id=F.col("call_id"))))
        .when(F.col("begun.line_no") < F.col("line_no"), F.array(ends))
    )
    # the last entry that tells something closes its file
    rows = rows.select("session_id", "ts_ms", F.col("file").alias("source_file"), told.alias("told")).where("told IS NOT NULL")
    latest = F.row_number().over(Window.partitionBy("source_file").orderBy(F.desc("ts_ms"))) == 1
    closing = F.array(event("session_end", line_no=F.lit((1 << 31) - 1)))
    whole = rows.withColumn("latest", latest).withColumn("told", F.when(F.col("latest"), F.concat("told", closing)).otherwise(F.col("told")))
    return whole.select("session_id", F.lit(workspace_id).alias("workspace_id"), "ts_ms", "source_file", F.inline("told"))
