"""Queries over logs, transcripts and stores that are made from the events table, over lookups and over labels; each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sessionloom.operators import canonical, features, graph, learn, modelsize, realtime, store, trust, vectors
from sessionloom.plans.adapter import agent_log, canonical_events, raw_events, table, turns
from sessionloom.plans.oracles import EV, LOG, ORACLES
from sessionloom.sources import agent_logs, chat_patches, session_store, tables, tail, transcripts, workspace
from sessionloom.sources.logged import Store, day_of
from sessionloom.streaming.sessions import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
BASE = EV.split("typed AS")[0].rstrip().rstrip(",")


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def _json(**parts: Column) -> Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in parts.items()]))


def _object(**parts: Column) -> Column:
    return F.struct(*[v.alias(k) for k, v in parts.items()])


# --- log lines ----------------------------------------------------------------------------------------------------

DEBUG_KINDS = ("session_start", "llm_request", "tool_call", "agent_response", "session_end", "turn_start")


def _debug_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = raw_events(spark, sf_dir)
    k = F.col("k")
    kind = F.get(F.array(*map(F.lit, DEBUG_KINDS)), k % 6)
    part = F.array(_object(role=F.lit("a"), parts=F.array(_object(type=F.lit("tool_call"), name=F.lit("apply_edit"), arguments=_json(path=F.concat(F.lit("e"), (k % 9).cast("string")))))))
    attrs = _object(
        modelLimit=F.when(kind == "session_start", k * 1000),
        model=F.when(kind == "llm_request", F.concat(F.lit("m"), (k % 4).cast("string"))),
        inputTokens=F.when(kind == "llm_request", k * 10),
        outputTokens=F.when(kind == "llm_request", k),
        cachedTokens=F.when(kind == "llm_request", k * 2),
        args=F.when(kind == "tool_call", _json(filePath=F.concat(F.lit("f"), (k % 7).cast("string")))),
        response=F.when(kind == "agent_response", F.to_json(part)),
    )
    value = _json(ts=F.col("ts_ms"), sid=F.col("session_id"), type=kind, name=F.when(kind == "tool_call", "read_file"), status=F.when(k % 4 == 0, "error").otherwise("ok"), attrs=attrs)
    return rows.select(value.alias("value"), F.lit("x").alias("session_id"), F.lit(0).cast("bigint").alias("modified_ms"))


@query(
    "debug_log_events",
    f"""WITH {BASE}, d AS (SELECT *, ['session_start', 'llm_request', 'tool_call', 'agent_response', 'session_end', 'turn_start'][k % 6 + 1] AS kind FROM base)
    SELECT CASE kind WHEN 'agent_response' THEN 'edit' ELSE kind END AS type, count(*) AS n, count(DISTINCT session_id) AS sessions, sum(CASE WHEN kind = 'llm_request' THEN k * 10 END)::DOUBLE AS prompt, sum(CASE WHEN kind = 'llm_request' THEN k * 2 END)::DOUBLE AS cached,
      count(DISTINCT CASE WHEN kind = 'llm_request' THEN k % 4 END) AS models, count(DISTINCT CASE WHEN kind = 'tool_call' THEN k % 7 END) AS paths, count(DISTINCT CASE WHEN kind = 'agent_response' THEN k % 9 END) AS files,
      max(CASE WHEN kind = 'session_start' THEN k * 1000 END)::DOUBLE AS limit_, count(*) FILTER (kind IN ('tool_call', 'agent_response') AND k % 4 = 0) AS failed, min(ts_ms) AS first FROM d WHERE kind <> 'turn_start' GROUP BY 1""",
)
def _debug(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = agent_logs.parse(_debug_lines(spark, sf_dir))
    return rows.groupBy("type").agg(
        F.count("*").alias("n"), F.count_distinct("session_id").alias("sessions"), F.sum("prompt_tokens").alias("prompt"), F.sum("cached_tokens").alias("cached"), F.count_distinct("model").alias("models"),
        F.count_distinct("path").alias("paths"), F.count_distinct("file").alias("files"), F.max("model_limit").alias("limit_"), F.count(F.when(~F.col("success"), 1)).alias("failed"), F.min("ts_ms").alias("first"),
    )


TAILED_FILES, TAILED_STEPS = 16, 3


@query(
    "tailed_log_events",
    f"""WITH {BASE}, d AS (SELECT *, ['session_start', 'llm_request', 'tool_call', 'agent_response', 'session_end', 'turn_start'][k % 6 + 1] AS kind FROM base)
    SELECT session_id, CASE kind WHEN 'agent_response' THEN 'edit' ELSE kind END AS type, ts_ms, CASE WHEN kind = 'tool_call' THEN 'read_file' END AS tool, CASE WHEN kind = 'tool_call' THEN 'f' || (k % 7) END AS path, CASE WHEN kind = 'agent_response' THEN 'e' || (k % 9) END AS file,
      CASE WHEN kind = 'llm_request' THEN k * 10 END::DOUBLE AS prompt_tokens, CASE WHEN kind = 'llm_request' THEN k END::DOUBLE AS completion_tokens, CASE WHEN kind = 'llm_request' THEN 'm' || (k % 4) END AS model, CASE WHEN kind = 'session_start' THEN k * 1000 END::DOUBLE AS model_limit,
      CASE WHEN kind IN ('tool_call', 'agent_response') THEN CAST(k % 4 <> 0 AS VARCHAR) END AS success FROM d WHERE kind <> 'turn_start'""",
)
def _tailed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log files that grow between triggers, also within a line; each trigger goes on from the checkpoint, and what all have brought is returned."""
    folder = shared_folder(spark, "tailed")
    lines = _debug_lines(spark, sf_dir).withColumn("file", F.concat(F.lit("b"), F.pmod(F.xxhash64("value"), F.lit(TAILED_FILES)).cast("string"), F.lit("/log.jsonl")))
    files = tail.placed(lines)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    for step in range(1, TAILED_STEPS + 1):
        tail.grow(files, f"{folder}/logs", step / TAILED_STEPS)
        log = tail.tail_log(spark, f"{folder}/logs")
        log.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(log.schema).parquet(f"{folder}/rows").select("session_id", "type", "ts_ms", "tool", "path", "file", "prompt_tokens", "completion_tokens", "model", "model_limit", F.col("success").cast("string").alias("success"))


LEGACY_KINDS = ("request", "tool", "file_edit", "session_start", "session_end", "noise")


def _legacy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = raw_events(spark, sf_dir)
    k = F.col("k")
    value = _json(
        kind=F.get(F.array(*map(F.lit, LEGACY_KINDS)), k % 6), sessionId=F.col("session_id"), timestamp=F.when(k % 5 != 0, F.col("ts_ms")), tool=F.when(k % 6 == 1, F.concat(F.lit("t"), (k % 3).cast("string"))), args=_object(file=F.when(k % 6 == 1, F.lit("a"))),
        file=F.when((k % 6 == 2) & (k % 4 == 0), F.lit("z")), promptTokens=F.when(k % 6 == 0, k), success=F.when(k % 7 == 0, F.lit(False)), diffLines=F.when(k % 6 == 2, k),
    )
    return rows.select(F.when(k % 11 == 0, F.concat(F.lit("{"), value)).otherwise(value).alias("value"), F.lit("x").alias("session_id"), F.lit(7).cast("bigint").alias("modified_ms"))


@query(
    "legacy_log_events",
    f"""WITH {BASE}, d AS (SELECT *, ['llm_request', 'tool_call', 'edit', 'session_start', 'session_end', NULL][k % 6 + 1] AS type FROM base WHERE k % 11 <> 0)
    SELECT type, count(*) AS n, sum(CASE WHEN k % 5 <> 0 THEN ts_ms ELSE 7 END)::BIGINT AS times, count(DISTINCT CASE WHEN type = 'tool_call' THEN k % 3 END) AS tools, count(CASE WHEN type = 'tool_call' THEN 1 END) AS paths,
      count(CASE WHEN type = 'edit' AND k % 4 <> 0 THEN 1 END) AS unknown_files, sum(CASE WHEN type = 'llm_request' THEN k END)::DOUBLE AS prompt, count(*) FILTER (type IN ('tool_call', 'edit') AND k % 7 = 0) AS failed, sum(CASE WHEN type = 'edit' THEN k END)::DOUBLE AS diff, sum(CASE WHEN type = 'session_start' THEN 256000 END)::DOUBLE AS limits
    FROM d WHERE type IS NOT NULL GROUP BY 1""",
)
def _legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = agent_logs.parse(_legacy_lines(spark, sf_dir))
    return rows.groupBy("type").agg(
        F.count("*").alias("n"), F.sum("ts_ms").alias("times"), F.count_distinct("tool").alias("tools"), F.count("path").alias("paths"), F.count(F.when(F.col("file") == "unknown", 1)).alias("unknown_files"),
        F.sum("prompt_tokens").alias("prompt"), F.count(F.when(~F.col("success"), 1)).alias("failed"), F.sum("diff_lines").alias("diff"), F.sum("model_limit").alias("limits"),
    )


@query("generic_log_events", f"WITH {BASE} SELECT ['session_start', 'llm_request', 'tool_call', 'agent_response', 'session_end', 'turn_start'][k % 6 + 1] AS type, count(*) AS n FROM base GROUP BY 1")
def _generic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agent_logs.parse_generic(_debug_lines(spark, sf_dir)).groupBy("type").agg(F.count("*").alias("n"))


_BRIDGED = "CASE type WHEN 'llm_request' THEN 'completion' WHEN 'session_start' THEN type WHEN 'session_end' THEN type WHEN 'tool_call' THEN CASE WHEN tool = 'read_file' THEN 'read_file' ELSE 'tool_call' END WHEN 'edit' THEN CASE WHEN failed = 0 THEN 'accept' ELSE 'retry' END END"


@query("bridged_events", f"WITH {LOG}, b AS (SELECT session_id, {_BRIDGED} AS event_type FROM lg) SELECT event_type, count(*) AS n, count(DISTINCT session_id) AS sessions FROM b WHERE event_type IS NOT NULL GROUP BY 1")
def _bridged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.bridge_one_row(agent_log(spark, sf_dir)).groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("session_id").alias("sessions"))


@query(
    "bridged_with_chat",
    f"WITH {LOG}, b AS (SELECT session_id, {_BRIDGED} AS event_type FROM lg), c AS (SELECT session_id, unnest(CASE event_type WHEN 'completion' THEN ['chat', 'completion'] ELSE [event_type] END) AS event_type FROM b WHERE event_type IS NOT NULL) SELECT event_type, count(*) AS n, CASE WHEN event_type IN ('chat', 'completion') THEN count(*) ELSE 0 END AS prompts FROM c GROUP BY 1",
)
def _with_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.bridge_with_chat(agent_log(spark, sf_dir)).groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("prompt_id").alias("prompts"))


# --- transcripts, chat logs and stores ----------------------------------------------------------------------------


def _transcript_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = raw_events(spark, sf_dir).withColumn("line_no", F.row_number().over(Window.partitionBy("session_id").orderBy("ts_ms", "id")))
    k = F.col("k")
    kind = F.get(F.array(*map(F.lit, ("user.message", "assistant.message", "tool.execution_start", "tool.execution_complete", "other"))), k % 5)
    call = F.concat(F.lit("c"), (k % 3).cast("string"))
    data = _object(
        content=F.when(k % 5 < 2, F.repeat(F.lit("x"), k)), toolRequests=F.when(k % 5 == 1, F.array(_object(name=F.lit("read_file"), toolCallId=call))), toolCallId=F.when(k % 5 > 1, call), toolName=F.when(k % 5 == 2, F.when(k % 2 == 0, "read_file").otherwise("create_file")),
        arguments=F.when(k % 5 == 2, _object(filePath=F.concat(F.lit("p"), (k % 8).cast("string")))), success=F.when(k % 5 == 3, k % 2 == 0),
    )
    value = _json(type=kind, timestamp=F.date_format(F.timestamp_millis("ts_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"), data=data)
    return rows.select(value.alias("value"), F.concat(F.lit("/t/"), "session_id", F.lit(".jsonl")).alias("file"), "line_no")


@query(
    "transcript_events",
    f"""WITH {BASE}, t AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts_ms, id) AS line_no FROM base),
    st AS (SELECT *, row_number() OVER (PARTITION BY session_id, k % 3 ORDER BY line_no) AS nth FROM t WHERE k % 5 = 2), dn AS (SELECT *, row_number() OVER (PARTITION BY session_id, k % 3 ORDER BY line_no) AS nth FROM t WHERE k % 5 = 3),
    e AS (SELECT session_id, 'chat' AS event_type, k AS ml, NULL AS rl, NULL AS dur FROM t WHERE k % 5 = 0
      UNION ALL SELECT session_id, 'completion', NULL, k, NULL FROM t WHERE k % 5 = 1 UNION ALL SELECT session_id, 'tool_call', NULL, NULL, NULL FROM t WHERE k % 5 = 1
      UNION ALL SELECT session_id, 'read_file', NULL, NULL, NULL FROM t WHERE k % 5 = 2 AND k % 2 = 0
      UNION ALL SELECT dn.session_id, CASE WHEN dn.k % 2 = 0 THEN 'accept' ELSE 'retry' END, NULL, NULL, dn.ts_ms - st.ts_ms FROM dn JOIN st ON dn.session_id = st.session_id AND dn.k % 3 = st.k % 3 AND dn.nth = st.nth AND st.line_no < dn.line_no)
    SELECT event_type, count(*) AS n, sum(ml)::DOUBLE AS asked, sum(rl)::DOUBLE AS answered, sum(dur)::DOUBLE AS took FROM e GROUP BY 1 UNION ALL SELECT 'session_end', count(DISTINCT session_id), NULL, NULL, NULL FROM e""",
)
def _transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = transcripts.transcript_events(transcripts.entries(_transcript_lines(spark, sf_dir)))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("message_length").alias("asked"), F.sum("response_length").alias("answered"), F.sum("duration_ms").alias("took"))


@query("transcript_lifecycle", f"WITH {BASE} SELECT session_id, min(ts_ms) AS started_ms, max(ts_ms) AS ended_ms, count(*) AS entries FROM base GROUP BY 1")
def _lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.lifecycle(transcripts.entries(_transcript_lines(spark, sf_dir))).select("session_id", "started_ms", "ended_ms", "entries")


def _patch_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A patch log a session: its start, then a request for each click, by turns appended as a whole or set at its place."""
    rows = raw_events(spark, sf_dir).where("raw = 'click'").withColumn("pos", F.row_number().over(Window.partitionBy("session_id").orderBy("ts_ms", "id")) - 1)
    k = F.col("k")
    auto = F.array(_object(kind=F.lit("autoModeResolution"), resolvedModel=F.lit("auto"), predictedLabel=F.concat(F.lit("l"), (k % 3).cast("string")), confidence=k / 100))
    asked = _object(requestId=F.col("id").cast("string"), timestamp=F.col("ts_ms"), message=_object(text=F.repeat(F.lit("y"), k)), response=F.when(k % 4 == 0, auto), result=F.when(k % 3 != 0, _object(metadata=_object(promptTokens=k * 3, outputTokens=k))))
    append, put = _json(kind=F.lit(2), k=F.array(F.lit("requests")), v=F.array(asked)), F.concat(F.lit('{"kind":1,"k":["requests",'), F.col("pos").cast("string"), F.lit('],"v":'), F.to_json(asked), F.lit("}"))
    line = F.when(k % 2 == 0, append).otherwise(put)
    head = F.concat(F.lit('{"kind":0,"v":{"sessionId":"'), F.col("session_id"), F.lit('","customTitle":"old","requests":[]}}\n{"kind":1,"k":["customTitle"],"v":"Chat '), F.col("session_id"), F.lit('"}\nbroken\n'))
    logs = rows.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))), lambda x: x["line"]), "\n").alias("body"))
    return logs.select(F.col("session_id").alias("file"), F.concat(head, "body").alias("value"))


@query("chat_log_sessions", f"WITH {BASE} SELECT session_id, 'Chat ' || session_id AS title, count(*)::INT AS requests FROM base WHERE raw = 'click' GROUP BY 1")
def _chat_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_patches.sessions(chat_patches.replay(_patch_logs(spark, sf_dir))).select("session_id", "title", "requests")


@query(
    "chat_log_events",
    f"""WITH {BASE}, r AS (SELECT * FROM base WHERE raw = 'click'), e AS (SELECT session_id, 'chat' AS event_type, k AS ml, NULL AS p FROM r UNION ALL SELECT session_id, unnest(['completion', 'session_end']), NULL, unnest([k * 3, NULL]) FROM r WHERE k % 3 <> 0)
    SELECT event_type, count(*) AS n, sum(ml)::DOUBLE AS asked, sum(p)::DOUBLE AS prompt FROM e GROUP BY 1""",
)
def _chat_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = chat_patches.requests(chat_patches.replay(_patch_logs(spark, sf_dir)))
    return chat_patches.request_events(asked, "w").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("message_length").alias("asked"), F.sum("prompt_tokens").alias("prompt"))


@query("auto_signals", f"WITH {BASE} SELECT session_id, 'l' || (arg_min(k, (ts_ms, id)) % 3) AS auto_label, round(arg_min(k, (ts_ms, id)) / 100, 6) AS auto_confidence FROM base WHERE raw = 'click' AND k % 4 = 0 GROUP BY 1")
def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_patches.auto_signals(chat_patches.requests(chat_patches.replay(_patch_logs(spark, sf_dir)))).withColumn("auto_confidence", F.round("auto_confidence", 6))


def _store_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = turns(spark, sf_dir)
    number = F.substring("session_id", 2, 20).cast("bigint")
    sessions = rows.select("session_id").distinct().select(
        "session_id", F.when(number % 4 == 0, F.concat(F.lit("w"), (number % 5).cast("string"))).alias("workspace_id"), F.when(number % 4 < 2, F.lit("r")).alias("repository"), F.when(number % 4 < 3, F.lit("/home")).alias("cwd"),
        F.when(number % 2 == 0, (number * 1000).cast("string")).otherwise(F.date_format(F.timestamp_millis(number * 1000), "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("created_at"), (number * 1000 + 500_000).cast("string").alias("updated_at"),
    )
    pairs = rows.groupBy("session_id", F.floor(F.col("turn_index") / 2).alias("turn_index")).agg(F.max(F.when(F.col("turn_index") % 2 == 0, F.col("text"))).alias("user_message"), F.max(F.when(F.col("turn_index") % 2 == 1, F.col("text"))).alias("assistant_response"))
    asked = pairs.withColumn("timestamp", (F.substring("session_id", 2, 20).cast("bigint") * 1000 + F.col("turn_index") * 10).cast("string"))
    files = sessions.where(number % 3 == 0).select("session_id", F.lit("a.py").alias("file_path"), F.lit("not a time").alias("first_seen_at"))
    return sessions, asked, files


@query(
    "stored_sessions",
    """WITH s AS (SELECT DISTINCT conv_id AS n FROM conversations), t AS (SELECT conv_id AS n, CAST(floor(turn / 2) AS BIGINT) AS i, max(CASE WHEN turn % 2 = 0 THEN text END) AS u, max(CASE WHEN turn % 2 = 1 THEN text END) AS a FROM conversations GROUP BY 1, 2),
    w AS (SELECT n, CASE n % 4 WHEN 0 THEN 'w' || (n % 5) WHEN 1 THEN 'repo:r' WHEN 2 THEN 'cwd:/home' ELSE 'default' END AS workspace_id FROM s),
    e AS (SELECT n, 'session_start' AS event_type, n * 1000 AS ts, NULL AS ml FROM s UNION ALL SELECT n, 'session_end', n * 1000 + 500000, NULL FROM s UNION ALL SELECT n, 'read_file', 0, NULL FROM s WHERE n % 3 = 0
      UNION ALL SELECT n, 'chat', n * 1000 + i * 10, length(u) FROM t UNION ALL SELECT n, 'completion', n * 1000 + i * 10 + 1, length(a) FROM t)
    SELECT workspace_id, event_type, count(*) AS n, sum(ts)::BIGINT AS times, sum(ml)::DOUBLE AS characters FROM e JOIN w USING (n) GROUP BY 1, 2""",
)
def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = session_store.store_events(*_store_tables(spark, sf_dir))
    return rows.groupBy("workspace_id", "event_type").agg(F.count("*").alias("n"), F.sum("ts_ms").alias("times"), F.sum(F.coalesce("message_length", "response_length")).alias("characters"))


# --- workspace files ----------------------------------------------------------------------------------------------

CATALOG = '[{"id":"alpha","name":"A","is_chat_fallback":true,"billing":{"token_prices":{"batch_size":100,"default":{"input_price":2,"output_price":3,"cache_price":1}}}},{"id":"beta-large","capabilities":{"family":"beta"},"model_picker_category":"powerful"},{"id":"gamma","family":"gam","model_picker_price_category":"low"}]'


@query(
    "model_lookup",
    f"""WITH {BASE}, m AS (SELECT *, ['alpha', 'alpha-2', 'beta', 'my-beta-x', 'delta', NULL, 'my-alpha-x', 'an unknown one', 'a gamma model'][k % 9 + 1] AS model FROM base)
    SELECT coalesce(model, '-') AS model, ['alpha', 'alpha', 'beta-large', 'beta-large', '-', '-', '-', 'alpha', 'gamma'][k % 9 + 1] AS model_id, count(*) AS n, round(sum(CASE WHEN k % 9 IN (0, 1, 7) THEN (greatest(k * 10 - k, 0) * 2 + k * 3 + k) / 100 ELSE 0 END), 4)::DOUBLE AS cost, count(*) FILTER (k % 9 IN (0, 1, 7, 8)) AS light FROM m GROUP BY 1, 2""",
)
def _model_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = workspace.models(spark.createDataFrame([("models.json", CATALOG)], "file string, value string"))
    k = F.col("k").cast("double")
    wanted = raw_events(spark, sf_dir).select("k", F.get(F.array(*map(F.lit, ("alpha", "alpha-2", "beta", "my-beta-x", "delta", None, "my-alpha-x", "an unknown one", "a gamma model"))), F.col("k") % 9).alias("model"))
    rows = workspace.find_models(wanted, catalog).join(F.broadcast(catalog.withColumnRenamed("id", "model_id")), "model_id", "left")
    return rows.groupBy(F.coalesce("model", F.lit("-")).alias("model"), F.coalesce("model_id", F.lit("-")).alias("model_id")).agg(
        F.count("*").alias("n"), F.round(F.sum(workspace.cost(k * 10, k, k)), 4).alias("cost"), F.count(F.when(F.coalesce(workspace.lightweight(), F.lit(False)), 1)).alias("light")
    )


#: Names of tools and the category of each, as they are expected.
TOOL_SAMPLES = {
    "read_file": "file", "GREP_search": "file", "click_element": "browser", "run_in_terminal": "terminal", "memory": "memory", "github_text_search": "search", "mcp_provides_tool_pylanceRun": "python", "vscode_open": "vscode", "get_task_output": "vscode",
    "manage_todo_list": "task", "runSubagent": "subagent", "fetch_webpage": "web", "copilot_getNotebookSummary": "notebook", "mcp_provides_tool_x": "mcp", "else": "unknown",
}


@query(
    "tool_categories",
    f"WITH {BASE}, s AS (SELECT id, k % {len(TOOL_SAMPLES)} AS i FROM base) SELECT {list(TOOL_SAMPLES.values())!r}[i + 1] AS category, count(*) AS n FROM s GROUP BY 1",
)
def _categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.get(F.array(*map(F.lit, TOOL_SAMPLES)), F.col("k") % len(TOOL_SAMPLES))
    files = raw_events(spark, sf_dir).select(F.col("id").cast("string").alias("file"), _json(content=F.to_json(F.array(_object(name=name, description=F.lit("d"))))).alias("value"))
    return workspace.tool_histogram(workspace.tools(files))


def _prompt_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation")
    key = F.col("n_nationkey")
    skill = F.concat(F.lit("<skill>\n<name>"), "n_name", F.lit("</name>\n"), F.when(key % 2 == 0, F.lit("<description>about</description>")).otherwise(F.lit("")), F.when(key % 3 == 0, F.concat(F.lit("<file>s"), key.cast("string"), F.lit("</file>"))).otherwise(F.lit("")), F.lit("</skill>"))
    agent = F.concat(F.lit("<agent><name> "), "n_name", F.lit(" </name><argumentHint>h</argumentHint></agent>"))
    text = F.concat(F.lit("Intro <skill> open "), skill, skill, F.lit("\n"), agent)
    return workspace.prompt_texts(rows.select(key.cast("string").alias("file"), _json(content=F.to_json(F.array(_object(text=text)))).alias("value")))


@query("prompt_skills", "SELECT n_nationkey::VARCHAR AS file, n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'about' END AS description, CASE WHEN n_nationkey % 3 = 0 THEN 's' || n_nationkey END AS skill_file FROM nation")
def _skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspace.skills(_prompt_files(spark, sf_dir))


@query("prompt_subagents", "SELECT n_nationkey::VARCHAR AS file, n_name AS name, CAST(NULL AS VARCHAR) AS description, 'h' AS argument_hint FROM nation")
def _subagents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspace.subagents(_prompt_files(spark, sf_dir))


@query(
    "editing_states",
    "SELECT n_nationkey::VARCHAR AS file, 2 AS version, n_nationkey::INT AS current_epoch, (n_nationkey % 4)::INT AS checkpoints, (n_nationkey % 3)::INT AS operations, 1 AS file_baselines FROM nation WHERE n_nationkey % 5 <> 0",
)
def _editing(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey").cast("int")
    points = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: _object(checkpointId=i.cast("string"), epoch=i))
    state = _json(version=F.lit(2), timeline=_object(currentEpoch=key, checkpoints=F.slice(points, 1, key % 4), operations=F.slice(F.array(F.lit("a"), F.lit("b"), F.lit("c")), 1, key % 3)), fileBaselines=F.array(F.lit("f")))
    files = table(spark, sf_dir, "nation").select(key.cast("string").alias("file"), F.when(key % 5 == 0, "{broken").otherwise(state).alias("value"))
    return workspace.editing_states(files).select("file", "version", "current_epoch", F.size("checkpoints").alias("checkpoints"), "operations", "file_baselines")


@query(
    "host_logs",
    "SELECT n_nationkey::VARCHAR AS file, '2026-01-02 03:04:05.678' AS first_seen, '0.' || n_nationkey AS agent_version, '1.9' AS editor_version, 'free_' || (n_nationkey % 3) AS token_sku, (n_nationkey + 10)::INT AS activation_blocker_ms, n_nationkey % 2 = 0 AS mcp_server_started, false AS code_referencing_enabled FROM nation",
)
def _host(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey").cast("string")
    at = F.lit("2026-01-02 03:04:05.678 ")
    said = F.array(
        F.lit("no time here"), F.concat(at, F.lit("[info] Chat: 0."), key, F.lit(", VS Code: 1.9")), F.concat(F.lit("2026-01-02 03:04:06.000 token sku: free_"), (F.col("n_nationkey") % 3).cast("string"), F.lit(" end")),
        F.concat(F.lit("activationBlocker from x took for "), (F.col("n_nationkey") + 10).cast("string"), F.lit("ms")), F.when(F.col("n_nationkey") % 2 == 0, "MCP server started").otherwise("code-referencing off"),
    )
    lines = table(spark, sf_dir, "nation").select(key.alias("file"), F.posexplode(said).alias("line_no", "value"))
    return workspace.host_logs(lines)


# --- lookups, labels and samples ----------------------------------------------------------------------------------


@query("events_of_session", f"WITH {EV} SELECT id, ts_ms, event_type FROM ev WHERE session_id = 'u5'")
def _of_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.by_session(canonical_events(spark, sf_dir), "u5").select("id", "ts_ms", "event_type")


@query("event_at_version", f"WITH {LOG} SELECT session_id, id, round(sum_prompt, 6) AS sum_prompt FROM st WHERE version = 3")
def _at_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return realtime.at_version(realtime.running_state(agent_log(spark, sf_dir)), 3).select("session_id", "id", F.round("sum_prompt", 6).alias("sum_prompt"))


@query("last_events", f"WITH {BASE} SELECT id, ts_ms FROM base ORDER BY ts_ms DESC, id DESC LIMIT 25")
def _last(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = raw_events(spark, sf_dir).withColumn("place", F.struct("ts_ms", "id"))
    return tables.last_rows(rows, "place", 25).select("id", "ts_ms")


@query("graph_lookups", f"WITH {EV} SELECT 'session:u5' AS node_id, count(DISTINCT 'file:' || path) AS files FROM ev WHERE session_id = 'u5' AND event_type IN ('read_file', 'edit')")
def _lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = graph.graph(canonical_events(spark, sf_dir))
    found = graph.edges_of(edges, "session_file", source="session:u5").agg(F.count_distinct("target").alias("files"))
    return graph.nodes_of(nodes, "session:u5").select("node_id").crossJoin(found)


@query("reverse_neighbors", f"WITH {EV} SELECT DISTINCT 'session:' || session_id AS node_id FROM ev WHERE path = 'file3' AND event_type IN ('read_file', 'edit')")
def _reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = graph.graph(canonical_events(spark, sf_dir))
    target = nodes.where("type = 'file' AND name = 'file3'").select("node_id").first()
    return graph.reverse_neighbors(edges, nodes, target[0] if target else "", "session_file").select("node_id").distinct()


def _session_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = modelsize.session_size_features(canonical_events(spark, sf_dir))
    heuristic = modelsize.heuristic_labels(sizes).select(F.col("session_id").alias("entity_id"), F.lit("session").alias("domain"), F.lit("heuristic").alias("source"), "label", F.lit(1).alias("created_at"))
    return heuristic.unionAll(heuristic.select("entity_id", "domain", F.lit("even").alias("source"), F.when(F.substring("entity_id", 2, 9).cast("int") % 2 == 0, F.col("label")).otherwise("mini").alias("label"), "created_at"))


_HEURISTIC = f"WITH h AS ({ORACLES['heuristic_label'].strip()})"


@query("labels_of_source", f"{_HEURISTIC} SELECT session_id AS entity_id, CASE WHEN substr(session_id, 2)::INT % 2 = 0 THEN label ELSE 'mini' END AS label FROM h")
def _labels_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.labels_of(_session_labels(spark, sf_dir), "session", "even").select("entity_id", "label")


@query("label_histogram", f"{_HEURISTIC} SELECT label, count(*) AS n FROM h GROUP BY 1")
def _histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.label_histogram(store.labels_of(_session_labels(spark, sf_dir), "session", "heuristic"))


@query("label_agreement", f"{_HEURISTIC} SELECT count(*) FILTER (label = 'mini' OR substr(session_id, 2)::INT % 2 = 0) AS agree, count(*) FILTER (label <> 'mini' AND substr(session_id, 2)::INT % 2 <> 0) AS differ FROM h")
def _agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _session_labels(spark, sf_dir)
    return store.label_agreement(*[store.labels_of(rows, "session", s) for s in ("heuristic", "even")], key="entity_id")


@query(
    "feature_ranges",
    "SELECT 'n_chars' AS feature, min(n_chars)::DOUBLE AS least, max(n_chars)::DOUBLE AS greatest, round(avg(n_chars), 6) AS mean FROM documents UNION ALL SELECT 'doc_id', min(doc_id)::DOUBLE, max(doc_id)::DOUBLE, round(avg(doc_id), 6) FROM documents",
)
def _ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.feature_ranges(table(spark, sf_dir, "documents"), ["n_chars", "doc_id"]).withColumn("mean", F.round("mean", 6))


@query("label_anchors", f"{_HEURISTIC} SELECT session_id, CASE WHEN substr(session_id, 2)::INT % 5 = 0 THEN 'large' ELSE label END AS label, substr(session_id, 2)::INT % 5 = 0 AS is_anchor FROM h")
def _anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = modelsize.heuristic_labels(modelsize.session_size_features(canonical_events(spark, sf_dir))).select("session_id", "label")
    number = F.substring("session_id", 2, 9).cast("int")
    signals = rows.select("session_id", F.lit("large").alias("auto_label"), F.when(number % 5 == 0, 0.9).otherwise(0.3).alias("confidence"))
    return modelsize.anchors(rows, signals).select("session_id", "label", "is_anchor")


@query("first_source", "SELECT doc_id, 'labels' AS source FROM labels UNION ALL SELECT doc_id, 'documents' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _first_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = [table(spark, sf_dir, t).select("doc_id", F.lit(t).alias("source")) for t in ("labels", "documents")]
    return store.first_source(frames, "doc_id")


@query(
    "feedback_labels",
    "SELECT doc_id::VARCHAR AS session_id, CASE WHEN doc_id % 10 >= 8 THEN m ELSE CASE m WHEN 'mini' THEN 'medium' ELSE 'large' END END AS label FROM (SELECT doc_id, ['mini', 'medium', 'large'][doc_id % 3 + 1] AS m FROM documents) WHERE doc_id % 10 >= 8 OR doc_id % 10 < 5",
)
def _feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = F.get(F.array(*map(F.lit, modelsize.CLASSES)), (F.col("doc_id") % 3).cast("int"))
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("session_id"), model.alias("predicted"), ((F.col("doc_id") % 10) / 10).alias("score"))
    return tables.feedback(rows).select("session_id", "label")


@query(
    "prompt_embedding",
    f"""WITH {EV}, {{prompts}} SELECT 1""".replace("{prompts} SELECT 1", "x AS (SELECT 1) SELECT prompt, count(*) AS n FROM (SELECT DISTINCT prompt_id AS prompt FROM ev WHERE event_type = 'chat' AND prompt_id IS NOT NULL) GROUP BY 1"),
)
def _prompt_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors.prompt_vectors(features.prompt_features(canonical_events(spark, sf_dir)))
    return rows.where("prompt IS NOT NULL").groupBy("prompt").agg(F.count("*").alias("n"))


# --- streams' rules, predictions and learners ---------------------------------------------------------------------


@query(
    "predictions",
    f"""WITH {LOG}, p AS (SELECT session_id, sum_prompt AS sp, sum_prompt + sum_completion AS ct, tool_calls AS tc, files_edited AS fe, retries AS rt FROM fin),
    s AS (SELECT *, least(sp / 80000, 1) * 30 + least(tc / 40, 1) * 25 + least(fe / 10, 1) * 15 + least(rt / 5, 1) * 15 AS score, sp < 8000 AND tc <= 5 AND fe <= 2 AND rt = 0 AS mini, ct > 60000 OR tc > 30 AS big FROM p)
    SELECT session_id AS entity_id, 'rule' AS source, CASE WHEN mini THEN 'mini' WHEN big THEN 'large' ELSE 'medium' END AS model, CASE WHEN mini THEN 0.8 WHEN big THEN 0.75 ELSE 0.7 END::DOUBLE AS confidence FROM s
    UNION ALL SELECT session_id, 'heuristic', CASE WHEN score < 30 THEN 'mini' WHEN score < 65 THEN 'medium' ELSE 'large' END, round(0.6 + least(score / 200, 0.2), 6)::DOUBLE FROM s""",
)
def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = realtime.predictions(realtime.final_state(realtime.running_state(agent_log(spark, sf_dir))), F.lit(100))
    return got.withColumn("confidence", F.round("confidence", 6))


@query(
    "snapshot_alerts",
    f"WITH {LOG} SELECT session_id, 'ctx-too-large' AS rule_id, CASE WHEN usage >= 0.95 THEN 'critical' ELSE 'warning' END AS severity, count(*) AS n FROM st WHERE usage >= 0.8 GROUP BY 1, 2, 3",
)
def _snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = agent_log(spark, sf_dir)
    states = realtime.running_state(log).join(realtime.phases(log).select("id", "phase", "planning_run"), "id")
    return realtime.alerts(states, realtime.snapshot_rules()[:1]).groupBy("session_id", "rule_id", "severity").agg(F.count("*").alias("n"))


def _distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels")
    p = F.array(F.col("doc_id") % 97 / 100, F.lit(0.01), 0.99 - F.col("doc_id") % 97 / 100)
    return rows.select("doc_id", p.alias("probabilities"), F.array_max(p).alias("confidence"), (F.col("quality") * 2).cast("double").alias("y"))


@query(
    "conformal_reject",
    """WITH d AS (SELECT doc_id, doc_id % 97 / 100 AS a, 0.99 - doc_id % 97 / 100 AS b, quality FROM labels), c AS (SELECT round(1 - CASE WHEN quality = 1 THEN b ELSE a END, 9) AS s FROM d), t AS (SELECT s AS threshold, n FROM (SELECT s, row_number() OVER (ORDER BY s) AS r, count(*) OVER () AS n FROM c) WHERE r = CAST(ceil(0.9 * n - 1e-9) AS BIGINT)),
    q AS (SELECT doc_id, round(1 - greatest(a, b, 0.01), 9) AS strange FROM d)
    SELECT doc_id, round(((SELECT count(*) FROM c WHERE s >= strange) + 1) / (n + 1), 6)::DOUBLE AS p_value, strange > threshold AS rejected FROM q, t""",
)
def _conformal(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _distributions(spark, sf_dir)
    rows = rows.withColumns({"probabilities": F.transform("probabilities", lambda p: F.round(p, 9)), "confidence": F.round("confidence", 9)})
    scores = learn.conformal_scores(rows).withColumn("score", F.round("score", 9))
    return learn.conformal_reject(rows, scores).select("doc_id", F.round("p_value", 6).alias("p_value"), "rejected")


KNN_FEATURES = ["prompt_tokens", "completion_tokens", "tool_calls", "edits", "retries", "elapsed_ms"]


@query(
    "knn_model",
    f"""WITH f AS ({ORACLES['model_size_features'].strip()}), h AS ({ORACLES['heuristic_label'].strip()}), r AS (SELECT f.session_id, label, [{', '.join(KNN_FEATURES)}]::DOUBLE[] AS raw FROM f JOIN h USING (session_id)),
    st AS (SELECT count(*) AS n, {', '.join(f'avg(raw[{i}]) AS m{i}, stddev_pop(raw[{i}]) AS s{i}' for i in range(1, len(KNN_FEATURES) + 1))} FROM r),
    z AS (SELECT session_id, label, [{', '.join(f'(raw[{i}] - m{i}) / CASE WHEN s{i} > 0 THEN s{i} ELSE 1 END' for i in range(1, len(KNN_FEATURES) + 1))}] AS x, greatest(3, CAST(floor(sqrt(n)) AS INT)) AS k FROM r, st),
    p AS (SELECT a.session_id, b.label, a.k, greatest(1 - CASE WHEN list_dot_product(a.x, a.x) * list_dot_product(b.x, b.x) > 0 THEN list_dot_product(a.x, b.x) / (sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x))) ELSE 0 END, 1e-10) AS d, b.session_id AS other FROM z a JOIN z b ON a.session_id <> b.session_id),
    q AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY d, other) AS r FROM p), v AS (SELECT *, (SELECT 1) AS one FROM q WHERE r <= k), s AS (SELECT session_id, max(CASE WHEN r = CAST(floor(k / 2) AS INT) + 1 THEN d END) AS s FROM v GROUP BY 1),
    w AS (SELECT session_id, label, sum(exp(-d * d / (s * s))) AS w FROM v JOIN s USING (session_id) GROUP BY 1, 2)
    SELECT session_id, round(coalesce(max(CASE WHEN label = 'mini' THEN w END), 0) / sum(w), 5)::DOUBLE AS mini, round(coalesce(max(CASE WHEN label = 'large' THEN w END), 0) / sum(w), 5)::DOUBLE AS large FROM w GROUP BY 1""",
)
def _knn_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each session's shares by its neighbours without itself."""
    rows = learn.with_index(labelled_sizes(spark, sf_dir)).select("session_id", "y", *KNN_FEATURES)
    got = learn.fit(rows, "knn", KNN_FEATURES).transform(rows, leave_out=True)
    return got.select("session_id", F.round(F.get("probabilities", F.lit(0)), 5).alias("mini"), F.round(F.get("probabilities", F.lit(2)), 5).alias("large"))


def labelled_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features and heuristic label of each session, worked out once for all that read them."""
    sizes = modelsize.session_size_features(canonical_events(spark, sf_dir))
    return sizes.select("session_id", modelsize.label_of(modelsize.complexity()).alias("label"), *KNN_FEATURES).checkpoint()


def anchored_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same; the label of every second session is an anchor."""
    anchor = F.when(F.substring("session_id", 2, 20).cast("bigint") % 2 == 0, F.array_position(F.array(*map(F.lit, modelsize.CLASSES)), F.col("label")) - 1)
    return labelled_sizes(spark, sf_dir).withColumn("anchor", anchor.cast("int"))


@query("label_propagation")
def _propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of every second session spread to all, until no distribution moves any more; SQL has no such loop over distributions, a test has."""
    return learn.propagate_labels(anchored_sizes(spark, sf_dir), KNN_FEATURES).select("session_id", "label")


@query("decisions", f"WITH h AS ({ORACLES['weighted_fusion'].strip()}) SELECT entity_id, model, round(greatest(mini, medium, large), 6) AS confidence, CASE WHEN greatest(mini, medium, large) < 0.6 THEN 'medium' ELSE 'low' END AS risk FROM h")
def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sessionloom.plans.queries import votes

    rows = votes(spark, sf_dir)
    sizes = rows.select("entity_id").distinct().select("entity_id", F.lit(10.0).alias("prompt_tokens"), F.lit(0.0).alias("retries"))
    score = lambda c: c["prompt_tokens"] / 1000 + c["retries"] * 10
    got = trust.whole_decisions(trust.weighted_fusion(rows.withColumnRenamed("label", "model")), sizes, score, lambda c: modelsize.label_of(score(c)), ["prompt_tokens", "retries"])
    return got.select("entity_id", "model", F.round("confidence", 6).alias("confidence"), "risk")


@query("advice_after_alerts", ORACLES["advice"].replace("+ CASE WHEN retries > 0 THEN 15 ELSE 0 END AS x FROM fin", "+ CASE WHEN retries > 0 THEN 15 ELSE 0 END + CASE WHEN session_id IN (SELECT session_id FROM al WHERE a LIKE 'tool-loop:%') THEN 20 ELSE 0 END AS x FROM fin"))
def _advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Advice that counts loops of tools among the alerts."""
    states = realtime.running_state(agent_log(spark, sf_dir))
    return realtime.advice(realtime.final_state(states), realtime.alerts(states))


def _bridged_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log events of all kinds as canonical events: tools by names that tests, terminals, commits and remote tools have."""
    rows = raw_events(spark, sf_dir)
    k = F.col("k")
    kind = F.get(F.array(*map(F.lit, ("session_start", "llm_request", "tool_call", "edit", "session_end"))), k % 5)
    tool = F.get(F.array(*map(F.lit, ("read_file", "run_tests", "x_terminal", "git_commit", "mcp_ask", "other"))), k % 6)
    return rows.select("id", "ts_ms", "session_id", "workspace_id", kind.alias("type"), F.when(kind == "tool_call", tool).alias("tool"), (k % 4 != 0).alias("success"), F.when(kind == "session_start", F.array(F.concat(F.lit("lang"), (k % 3).cast("string")))).alias("languages"))


_KINDS = f"""WITH {BASE}, c AS (SELECT *, ['session_start', 'completion', 'tool', 'edit', 'session_end'][k % 5 + 1] AS kind, ['read_file', 'run_tests', 'x_terminal', 'git_commit', 'mcp_ask', 'other'][k % 6 + 1] AS tool FROM base),
  b AS (SELECT id, ts_ms, session_id, workspace_id, k, tool, CASE kind WHEN 'tool' THEN ['read_file', 'run_test', 'terminal', 'commit', 'tool_call', 'tool_call'][k % 6 + 1] WHEN 'edit' THEN CASE WHEN k % 4 <> 0 THEN 'accept' ELSE 'retry' END ELSE kind END AS event_type FROM c)"""


@query("bridged_tool_kinds", f"{_KINDS} SELECT event_type, count(*) AS n, count(DISTINCT CASE WHEN event_type IN ('read_file', 'run_test', 'terminal', 'commit', 'tool_call') THEN tool END) AS tools FROM b GROUP BY 1")
def _tool_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.bridge_one_row(_bridged_log(spark, sf_dir)).groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("tool").alias("tools"))


@query(
    "tools_used",
    f"{_KINDS} SELECT tool AS tool_name, CASE tool WHEN 'x_terminal' THEN 'terminal' WHEN 'git_commit' THEN 'git' WHEN 'run_tests' THEN 'test' WHEN 'mcp_ask' THEN 'mcp' ELSE 'generic' END AS tool_kind, count(DISTINCT session_id) AS sessions FROM b WHERE event_type IN ('run_test', 'terminal', 'commit', 'tool_call') GROUP BY 1, 2",
)
def _tools_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.tools_used(canonical.complete(canonical.bridge_one_row(_bridged_log(spark, sf_dir)))).groupBy("tool_name", "tool_kind").agg(F.count("*").alias("sessions"))


@query("workspace_languages", f"{_KINDS} SELECT workspace_id, 'lang' || (k % 3) AS name FROM b WHERE event_type = 'session_start' GROUP BY 1, 2")
def _languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.entities(canonical.complete(canonical.bridge_one_row(_bridged_log(spark, sf_dir))))["languages"].select("workspace_id", "name").distinct()


@query("missing_fields", f"WITH {BASE} SELECT k % 3 AS kind, count(*) AS n, CASE WHEN k % 3 = 0 THEN count(*) ELSE 0 END AS missing FROM base GROUP BY 1")
def _missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = raw_events(spark, sf_dir).select((F.col("k") % 3).alias("kind"), F.lit("switch_model").alias("event_type"), F.get(F.array(F.lit("{}"), F.lit('{"model":1}'), F.lit('{"model":null,"x":2}')), F.col("k") % 3).alias("json"))
    got = canonical.missing_fields(rows, canonical.catalog(spark))
    return got.groupBy("kind").agg(F.count("*").alias("n"), F.count(F.when(F.array_contains("missing", "model"), 1)).alias("missing"))


def _all_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = features.session_view(canonical_events(spark, sf_dir))
    return store.feature_rows(view, "session_id", "session", 1, 5).unionByName(store.feature_rows(view, "session_id", "session", 2, 3))


@query("features_read_back", f"WITH h AS ({ORACLES['session_view'].strip()}) SELECT session_id AS entity_id, 2 AS version, round(accept_rate, 6)::DOUBLE AS accept_rate FROM h")
def _read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = store.read_features(_all_features(spark, sf_dir), "session")
    return got.select("entity_id", "version", F.round(F.col("features")["accept_rate"], 6).alias("accept_rate"))


@query("traces_evaluated", "SELECT doc_id AS id, least(10, greatest(1, floor(n_chars / 20000.0 * 3 + (doc_id % 7) * 0.5 + (doc_id % 5) * 0.7 + (doc_id % 3) * 0.4 + (doc_id % 40 + 1) * 0.02 + 0.5)))::BIGINT AS complexity FROM documents")
def _traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda n: (F.col("doc_id") % n).cast("int")
    files = F.transform(F.slice(F.sequence(F.lit(1), F.lit(9)), 1, part(5)), lambda i: F.concat(F.lit("f"), i.cast("string")))
    rows = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("n_chars").alias("contextTokens"), F.slice(F.array_repeat(F.lit("c"), 9), 1, part(7)).alias("toolCalls"), files.alias("filesChanged"), F.concat(F.lit("x"), F.repeat(F.lit("\n+"), part(40))).alias("finalDiff"), F.slice(F.array_repeat(F.lit("r"), 9), 1, part(3)).alias("reasoningSteps")
    )
    return modelsize.trace_evaluation(rows).select("id", F.col("complexity").cast("bigint").alias("complexity"))


@query("evaluations_parsed", "SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN (doc_id % 10)::DOUBLE END AS complexity FROM documents")
def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sessionloom.plans.analysis import parse_evaluation

    body = _json(complexity=(F.col("doc_id") % 10), smallerModelPossible=F.lit(True))
    answer = F.when(F.col("doc_id") % 3 == 0, body).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise("no JSON")
    return table(spark, sf_dir, "documents").select("doc_id", parse_evaluation(answer)["complexity"].alias("complexity"))


@query("sampled_decisions", "SELECT 'random' AS strategy, count(*) FILTER (doc_id % 10 / 10.0 < 0.3) AS sampled FROM labels UNION ALL SELECT 'confidence', count(*) FILTER (doc_id % 10 / 10.0 < least(0.6, greatest(0, (0.7 - greatest(doc_id % 97 / 100.0, 0.99 - doc_id % 97 / 100.0)) / 0.7) * 0.6)) FROM labels")
def _sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, out = _distributions(spark, sf_dir), None
    for strategy in ("random", "confidence"):
        part = trust.sampling(rows, strategy, 0.3, F.col("doc_id") % 10 / 10).agg(F.count(F.when(F.col("sampled"), 1)).alias("sampled")).select(F.lit(strategy).alias("strategy"), "sampled")
        out = part if out is None else out.unionAll(part)
    return out


@query("retained_graph", f"WITH {EV} SELECT count(DISTINCT session_id) AS sessions FROM ev WHERE substr(session_id, 2)::INT % 2 = 1")
def _retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = graph.graph(canonical_events(spark, sf_dir))
    times = nodes.where("type = 'session'").select("node_id", F.when(F.element_at(F.split("node_id", ":u"), 2).cast("int") % 2 == 0, 0).otherwise(10**13).alias("ts_ms"))
    return store.retain_graph(nodes, edges, times, 10**13)[0].where("type = 'session'").agg(F.count("*").alias("sessions"))


# --- tables that are changed by commits ----------------------------------------------------------------------------


@query(
    "merged_features",
    f"WITH {BASE} SELECT session_id, CASE WHEN substr(session_id, 2)::BIGINT % 7 = 0 THEN 2 ELSE 1 END AS version, count(*) AS events, CASE WHEN substr(session_id, 2)::BIGINT % 7 = 0 THEN sum(k) ELSE max(k) END::BIGINT AS value FROM base GROUP BY 1",
)
def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of all sessions, then new ones of every seventh: the second merge writes only the buckets of those."""
    store_ = Store(spark, shared_folder(spark, "merged"))
    number = F.substring("session_id", 2, 20).cast("bigint")
    rows = raw_events(spark, sf_dir).groupBy("session_id").agg(F.count("*").alias("events"), F.max("k").cast("bigint").alias("first"), F.sum("k").alias("second"))
    store_.merge("features", rows.select("session_id", F.lit(1).alias("version"), "events", F.col("first").alias("value")), ["session_id"])
    store_.merge("features", rows.where(number % 7 == 0).select("session_id", F.lit(2).alias("version"), "events", F.col("second").alias("value")), ["session_id"])
    return store_.read("features")


RETAINED_DAYS = 7


@query(
    "pruned_store",
    f"""WITH {BASE}, c AS (SELECT max(ts_ms) - {RETAINED_DAYS} * 86400000 AS cut FROM base), s AS (SELECT session_id, max(ts_ms) AS last FROM base GROUP BY 1), g AS (SELECT DISTINCT session_id, workspace_id FROM base)
    SELECT 'events' AS name, id::VARCHAR AS entity, ts_ms FROM base, c WHERE ts_ms >= cut UNION ALL SELECT 'embeddings', session_id, last FROM s, c WHERE last >= cut UNION ALL SELECT 'nodes', session_id, last FROM s, c WHERE last >= cut
    UNION ALL SELECT 'edges', g.session_id || '>' || workspace_id, NULL FROM g JOIN s USING (session_id), c WHERE last >= cut""",
)
def _pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store of events, embeddings and a graph after one prune over all of them: what is left of each."""
    store_ = Store(spark, shared_folder(spark, "pruned"))
    rows = raw_events(spark, sf_dir)
    last = rows.groupBy("session_id").agg(F.max("ts_ms").alias("ts_ms"))
    store_.append("events", rows.select("id", "ts_ms", "session_id"), day_of("ts_ms"))
    store_.merge("embeddings", last.select(F.col("session_id").alias("entity_id"), F.col("ts_ms").alias("created_at"), F.array(F.lit(1.0)).alias("vector")), ["entity_id"])
    nodes = last.select(F.col("session_id").alias("node_id"), "ts_ms").unionByName(rows.select(F.col("workspace_id").alias("node_id"), F.lit(None).cast("bigint").alias("ts_ms")).distinct())
    store_.merge("nodes", nodes, ["node_id"])
    store_.append("edges", rows.select(F.col("session_id").alias("source"), F.col("workspace_id").alias("target")).distinct(), F.lit("all"))
    now = rows.agg(F.max("ts_ms")).first()[0] or 0
    store_.prune(now, RETAINED_DAYS, others={"embeddings": "created_at"}, nodes="nodes", edges="edges")
    left = [
        store_.read("events").select(F.lit("events").alias("name"), F.col("id").cast("string").alias("entity"), "ts_ms"),
        store_.read("embeddings").select(F.lit("embeddings").alias("name"), F.col("entity_id").alias("entity"), F.col("created_at").alias("ts_ms")),
        store_.read("nodes").where("ts_ms IS NOT NULL").select(F.lit("nodes").alias("name"), F.col("node_id").alias("entity"), "ts_ms"),
        store_.read("edges").select(F.lit("edges").alias("name"), F.concat("source", F.lit(">"), "target").alias("entity"), F.lit(None).cast("bigint").alias("ts_ms")),
    ]
    out = left[0]
    for part in left[1:]:
        out = out.unionByName(part)
    return out


# --- learners -----------------------------------------------------------------------------------------------------

_WIDTH = 64
_POINTS = f"""x AS (SELECT vec_id, label % 3 AS y, unnest(range({_WIDTH})) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings)"""


def _points(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    names = [f"e{i}" for i in range(_WIDTH)]
    rows = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") % 3).alias("y"), *[F.get("embedding", F.lit(i)).cast("double").alias(n) for i, n in enumerate(names)])
    return rows, names


@query(
    "gaussian_bayes",
    f"""WITH {_POINTS}, s AS (SELECT 1e-6 * max(v) AS e FROM (SELECT var_pop(v) AS v FROM x GROUP BY i)), m AS (SELECT y AS c, i, avg(v) AS mean, var_pop(v) + any_value(e) AS var FROM x, s GROUP BY 1, 2),
    n AS (SELECT label % 3 AS c, ln(count(*) / (SELECT count(*) FROM embeddings)) AS prior FROM embeddings GROUP BY 1),
    l AS (SELECT vec_id, c, any_value(prior) + sum(-0.5 * ln(2 * pi() * var) - 0.5 * (v - mean) * (v - mean) / var) AS l FROM x JOIN m USING (i) JOIN n USING (c) GROUP BY 1, 2),
    p AS (SELECT vec_id, c, exp(l - max(l) OVER (PARTITION BY vec_id)) AS e FROM l) SELECT vec_id, c::INT AS class, round(e / sum(e) OVER (PARTITION BY vec_id), 6) AS p FROM p""",
)
def _bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, names = _points(spark, sf_dir)
    found = learn.fit(rows, "bayes", names).transform(rows)
    return found.select("vec_id", F.posexplode("probabilities").alias("class", "p")).withColumn("p", F.round("p", 6))


@query(
    "online_step",
    f"""WITH {_POINTS}, t AS (SELECT i, avg(v) AS m, stddev_pop(v) AS s FROM x GROUP BY 1), z AS (SELECT y, i, (v - m) / s AS z FROM x JOIN t USING (i) UNION ALL SELECT label % 3, {_WIDTH}, 1 FROM embeddings),
    g AS (SELECT c, i, avg((1.0::DOUBLE / 3 - (y = c)::INT) * z) AS g FROM z, range(3) AS k(c) GROUP BY 1, 2) SELECT c::INT AS class, i::INT AS i, round(-0.1 * g / sqrt(1e-8 + g * g), 5) AS weight FROM g""",
)
def _online(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One step of the online learner over the whole table as a stream of one micro-batch."""
    folder = shared_folder(spark, "online")
    schema = table(spark, sf_dir, "embeddings").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "embeddings.parquet").parquet(sf_dir) if not _is_folder(spark, f"{sf_dir}/embeddings.parquet") else spark.readStream.schema(schema).parquet(f"{sf_dir}/embeddings.parquet")
    names = [f"e{i}" for i in range(_WIDTH)]
    rows = stream.select((F.col("label") % 3).alias("y"), *[F.get("embedding", F.lit(i)).cast("double").alias(n) for i, n in enumerate(names)])
    learn.learn_from_stream(rows, names, f"{folder}/model", f"{folder}/checkpoint").awaitTermination()
    model = learn.latest_online(f"{folder}/model", spark)
    weights = [(c, i, round(float(w), 5)) for c, own in enumerate(model.weights) for i, w in enumerate(own)] if model else []
    return spark.createDataFrame(weights, "class int, i int, weight double")


def _is_folder(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory()
