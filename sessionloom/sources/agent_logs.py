"""Agent log lines, in the current debug format and in older flat ones, as agent log events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names of tools that edit files, as they appear in a response's parts.
EDIT_PARTS = ("edit_file", "apply_edit", "write_to_file")
DEFAULT_LIMIT = 256_000.0
_RESPONSE = "array<struct<parts: array<struct<name: string, type: string, arguments: string>>>>"


def read_lines(spark: SparkSession, path: str, glob: str = "*.jsonl") -> DataFrame:
    """Lines of log files in any depth: value, file, session_id (the name of the file's folder), modified_ms."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path)
    return rows.select("value", F.col("_metadata.file_path").alias("file"), F.unix_millis("_metadata.file_modification_time").alias("modified_ms")).withColumn("session_id", F.element_at(F.split("file", "/"), -2))


def _get(path: str, kind: str, of: str = "v") -> Column:
    return F.try_variant_get(of, path, kind)


def arguments(text: Column) -> Column:
    """A tool's arguments as VARIANT: an object as it is, text parsed, other text under ``raw``."""
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(F.to_json(F.struct(text.alias("raw")))))


def file_edit(response: Column) -> tuple[Column, Column]:
    """(file, changed lines) of the first editing part of an agent's response, from its JSON, or by pattern where that is broken."""
    parsed = F.from_json(response, _RESPONSE)
    parts = F.filter(F.flatten(F.transform(F.filter(parsed, lambda m: m["parts"].isNotNull()), lambda m: m["parts"])), lambda p: p["name"].isin(*EDIT_PARTS))
    first = F.get(parts, F.lit(0))
    args = F.try_parse_json(first["arguments"])
    names = r'"(?:edit_file|apply_edit|write_to_file)"'
    path = r'\\*"(?:filePath|path|file)\\*"\s*:\s*\\*"([^"\\]+)'
    broken = parsed.isNull() & response.rlike(names)
    found = F.coalesce(*[F.try_variant_get(args, f"$.{k}", "string") for k in ("filePath", "path", "file")])
    file = F.when(first.isNotNull(), F.coalesce(found, F.lit("unknown"))).when(broken, F.coalesce(F.nullif(F.regexp_extract(response, path, 1), F.lit("")), F.lit("unknown")))
    return file, F.when(first.isNotNull(), 0).when(broken, F.regexp_count(response, F.lit(r"\\n"))).cast("double")


#: What older logs call the types.
LEGACY_TYPES = {"request": "llm_request", "llm_request": "llm_request", "tool": "tool_call", "tool_call": "tool_call", "file_edit": "edit", "edit": "edit", "session_start": "session_start", "session_end": "session_end"}


def _parsed(lines: DataFrame, current: Column) -> DataFrame:
    """Lines as agent log events, each parsed once; ``current`` says of a parsed line ``v`` whether it is of the debug format."""
    rows = lines.withColumn("v", F.try_parse_json("value")).withColumn("current", current)
    rows = rows.withColumn("kind", F.when(F.col("current"), _get("$.type", "string")).otherwise(F.coalesce(_get("$.kind", "string"), _get("$.type", "string"))))
    file, changed = file_edit(_get("$.attrs.response", "string"))
    now, kind = F.col("current"), F.col("kind")
    rows = rows.withColumn("edit", F.when(now & (kind == "agent_response"), F.struct(file.alias("path"), changed.alias("lines"))))
    edited = F.col("edit.path").isNotNull()
    named = F.try_element_at(F.create_map(*[F.lit(x) for kv in LEGACY_TYPES.items() for x in kv]), kind)
    type_ = F.when(now, F.when(kind.isin("session_start", "session_end", "llm_request", "tool_call"), kind).when((kind == "agent_response") & edited, "edit")).otherwise(named)
    rows = rows.withColumn("of", type_)
    llm, call, edit, start = (F.col("of") == t for t in ("llm_request", "tool_call", "edit", "session_start"))

    def either(path: str, old: str, kind: str) -> Column:
        return F.when(now, _get(path, kind)).otherwise(_get(old, kind))

    args = arguments(_get("$.attrs.args", "string"))
    path = F.when(now, F.coalesce(*[F.try_variant_get(args, f"$.{k}", "string") for k in ("path", "filePath", "file")])).otherwise(F.coalesce(_get("$.args.path", "string"), _get("$.args.file", "string")))
    ok = F.when(now, F.coalesce(_get("$.status", "string"), F.lit("ok")) == "ok").otherwise(F.coalesce(_get("$.success", "boolean"), F.lit(True)))
    told = F.struct(
        F.coalesce(either("$.sid", "$.sessionId", "string"), F.col("session_id")).alias("session_id"),
        F.col("of").alias("type"),
        F.when(now, _get("$.ts", "bigint")).otherwise(F.coalesce(_get("$.timestamp", "bigint"), _get("$.ts", "bigint"), F.col("modified_ms"))).alias("ts_ms"),
        F.when(call, F.coalesce(either("$.name", "$.tool", "string"), _get("$.name", "string"), F.lit("unknown"))).alias("tool"),
        F.when(call, path).alias("path"),
        F.when(edit, F.when(now, F.col("edit.path")).otherwise(F.coalesce(_get("$.file", "string"), F.lit("unknown")))).alias("file"),
        F.when(llm, F.coalesce(either("$.attrs.inputTokens", "$.promptTokens", "double"), F.lit(0.0))).alias("prompt_tokens"),
        F.when(llm, F.coalesce(either("$.attrs.outputTokens", "$.completionTokens", "double"), F.lit(0.0))).alias("completion_tokens"),
        F.when(llm, F.coalesce(either("$.attrs.cachedTokens", "$.cachedTokens", "double"), F.lit(0.0))).alias("cached_tokens"),
        F.when(llm, either("$.attrs.model", "$.model", "string")).alias("model"),
        F.when(start, F.coalesce(either("$.attrs.modelLimit", "$.modelLimit", "double"), F.lit(DEFAULT_LIMIT))).alias("model_limit"),
        F.when(call | edit, ok).alias("success"),
        F.when(edit, F.when(now, F.col("edit.lines")).otherwise(F.coalesce(_get("$.diffLines", "double"), F.lit(0.0)))).alias("diff_lines"),
        either("$.dur", "$.durationMs", "double").alias("duration_ms"),
    )
    # rows without a type go here: a filter would be moved before the parsing and parse each line again
    return rows.select(F.inline(F.when(F.col("of").isNotNull(), F.array(told))))


def parse_debug(lines: DataFrame) -> DataFrame:
    """Debug-log lines to agent log events; lines that are no JSON object of a known type go."""
    return _parsed(lines, F.lit(True))


def parse_legacy(lines: DataFrame) -> DataFrame:
    """Flat log lines (kind or type, and fields beside it); an event without its own time has the file's."""
    return _parsed(lines, F.lit(False))


def parse(lines: DataFrame) -> DataFrame:
    """Lines of either format: those with ``attrs`` or ``sid`` are of the current one."""
    return _parsed(lines, _get("$.attrs", "variant").isNotNull() | _get("$.sid", "string").isNotNull())


def parse_generic(lines: DataFrame) -> DataFrame:
    """Any object with a type: type, session_id, ts_ms and the whole as VARIANT."""
    rows = lines.withColumn("payload", F.try_parse_json("value"))
    return rows.select("session_id", F.try_variant_get("payload", "$.type", "string").alias("type"), F.try_variant_get("payload", "$.timestamp", "bigint").alias("ts_ms"), "payload").where("type IS NOT NULL")
