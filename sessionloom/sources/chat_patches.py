"""Chat sessions kept as logs of patches: replay, requests, and their events."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_RESULT = "struct<timings: struct<firstProgress: double, totalElapsed: double>, metadata: struct<promptTokens: double, outputTokens: double>, resolvedModel: string>"
_REQUEST = f"struct<requestId: string, timestamp: bigint, modelId: string, responseId: string, message: struct<text: string>, completionTokens: double, result: {_RESULT}>"
_RESPONSE = "struct<response: array<struct<kind: string, resolvedModel: string, predictedLabel: string, confidence: double>>>"


def _apply(state, patch: dict):
    """A state after one patch: kind 0 replaces it, 1 sets a path, 2 appends at a path. Keys are names, or numbers in arrays."""
    kind, path, value = patch.get("kind"), patch.get("k"), patch.get("v")
    if kind == 0:
        return value if value is not None else {}
    if kind not in (1, 2) or not path:
        return state
    at = state
    for key in path[:-1]:
        inner = at[key] if isinstance(at, list) else at.get(key)
        if inner is None:
            inner = {}
            at[key] = inner
        at = inner
    last = path[-1]
    if kind == 1:
        if isinstance(at, list) and last == len(at):
            at.append(value)
        else:
            at[last] = value
        return state
    old = at[last] if isinstance(at, list) else at.get(last)
    if not isinstance(old, list):
        old = []
        at[last] = old
    old.extend(value if isinstance(value, list) else [value])
    return state


def replay(files: DataFrame) -> DataFrame:
    """files: file, value (the whole text of a patch log). Returns file and state (JSON); broken lines are left out, a log without lines gives no row.

    A patch changes a tree that the patches before it made, which is a fold over one file's lines and nothing else in this library.
    """

    def play(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, states = [], []
            for file, text in zip(batch.column("file").to_pylist(), batch.column("value").to_pylist()):
                lines = [x for x in (text or "").splitlines() if x.strip()]
                state: object = {}
                for line in lines:
                    try:
                        state = _apply(state, json.loads(line))
                    except (ValueError, KeyError, IndexError, TypeError, AttributeError):
                        continue
                if lines:
                    names.append(file)
                    states.append(json.dumps(state, ensure_ascii=False))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(states, pa.string())], names=["file", "state"])

    return files.select("file", "value").mapInArrow(play, "file string, state string")


def sessions(states: DataFrame) -> DataFrame:
    """One row per replayed session: id, title, when made, default model, number of requests."""
    top = F.from_json("state", "struct<sessionId: string, customTitle: string, creationDate: bigint, inputState: struct<selectedModel: struct<identifier: string>>, requests: array<string>>")
    return states.select("file", top.alias("s")).select("file", F.col("s.sessionId").alias("session_id"), F.col("s.customTitle").alias("title"), F.col("s.creationDate").alias("created_ms"), F.col("s.inputState.selectedModel.identifier").alias("model"), F.coalesce(F.size("s.requests"), F.lit(0)).alias("requests"))


def requests(states: DataFrame) -> DataFrame:
    """One row per request of replayed sessions, with the first automatic choice of a model among its response's parts."""
    top = F.from_json("state", "struct<sessionId: string, requests: array<string>>")
    rows = states.select("file", top.alias("s")).select("file", F.col("s.sessionId").alias("session_id"), F.posexplode("s.requests").alias("pos", "raw"))
    rows = rows.select("file", "session_id", "pos", F.from_json("raw", _REQUEST).alias("r"), F.from_json("raw", _RESPONSE).alias("o"))
    auto = F.get(F.filter("o.response", lambda p: p["kind"] == "autoModeResolution"), F.lit(0))
    return rows.withColumn("auto", auto).select(
        "file",
        "session_id",
        "pos",
        F.col("r.requestId").alias("request_id"),
        F.col("r.timestamp").alias("ts_ms"),
        F.col("r.modelId").alias("model_id"),
        F.col("r.message.text").alias("message"),
        F.col("r.result.metadata.promptTokens").alias("prompt_tokens"),
        F.coalesce("r.result.metadata.outputTokens", "r.completionTokens").alias("output_tokens"),
        F.col("r.result.timings.totalElapsed").alias("elapsed_ms"),
        F.coalesce("r.result.resolvedModel", "auto.resolvedModel").alias("resolved_model"),
        F.col("auto.predictedLabel").alias("auto_label"),
        F.col("auto.confidence").alias("auto_confidence"),
    )


def auto_signals(asked: DataFrame) -> DataFrame:
    """Per session the first request that has both a label and a confidence."""
    rows = asked.where("auto_label IS NOT NULL AND auto_confidence IS NOT NULL")
    return rows.groupBy("session_id").agg(F.min_by(F.struct("auto_label", "auto_confidence"), F.struct("ts_ms", "pos")).alias("a")).select("session_id", "a.*")


def request_events(asked: DataFrame, workspace_id: str) -> DataFrame:
    """Requests as events: a chat; and for a request with an answer a completion and a session end, one and two milliseconds later."""
    answered = F.col("output_tokens").isNotNull()
    kinds = F.when(answered, F.array(F.lit("chat"), F.lit("completion"), F.lit("session_end"))).otherwise(F.array(F.lit("chat")))
    rows = asked.select("*", F.posexplode(kinds).alias("ordinal", "event_type"))
    completion = F.col("event_type") == "completion"
    return rows.select(
        "session_id",
        F.lit(workspace_id).alias("workspace_id"),
        (F.col("ts_ms") + F.col("ordinal")).alias("ts_ms"),
        "event_type",
        "ordinal",
        F.when(F.col("event_type") == "chat", F.col("request_id")).alias("prompt_id"),
        F.when(F.col("event_type") == "chat", F.length("message").cast("double")).alias("message_length"),
        *[F.when(completion, F.col(c)).alias(n) for c, n in (("prompt_tokens", "prompt_tokens"), ("output_tokens", "completion_tokens"), ("elapsed_ms", "elapsed_ms"), ("resolved_model", "model"), ("auto_label", "auto_label"), ("auto_confidence", "auto_confidence"))],
    )
