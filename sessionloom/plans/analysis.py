"""Whole analyses: a summary of many sessions, a scan of a workspace's files, prompts for an evaluator, and texts to show."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sessionloom.operators import mining, vectors
from sessionloom.operators.features import failure_classes, prompt_features, session_view
from sessionloom.sources import chat_patches, transcripts, workspace
from sessionloom.sources.logged import Store


def summary(events: DataFrame) -> DataFrame:
    """One row: sessions, events, anomaly, days and health, the most frequent failure, start, variant and the strongest contribution."""
    totals = events.agg(F.count_distinct("session_id").alias("sessions"), F.count("*").alias("events"))
    failed = failure_classes(events).where("failure_type <> 'none'")
    failures = failed.groupBy("failure_type").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("failed_sessions"), F.max_by("failure_type", F.struct("n", "failure_type")).alias("top_failure"))
    start = mining.start_distribution(events).agg(F.max_by("event_type", F.struct("count", "event_type")).alias("top_start"))
    variant = mining.variants(events, 1).agg(F.max("variant").alias("top_variant"))
    roi = mining.context_roi(events, top=1).agg(F.max("feature").alias("top_feature"))
    score = mining.anomaly_score(mining.transitions(events)).select("anomaly_score")
    trend = mining.trend_summary(mining.daily_metrics(events)).select("days_analyzed", "health_direction")
    out = totals
    for one in (score, trend, failures, start, variant, roi):
        out = out.crossJoin(one)
    return out


def _files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("wholetext", "true").text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), "value")


def _lines(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """Lines with their number in the file, from 0. Files are read by lines and in splits, so none has to fit in a row; the number follows the place of the split and the order within it."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path)
    rows = rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    order = Window.partitionBy("file").orderBy("block", "at")
    return rows.select("file", (F.row_number().over(order) - 1).alias("line_no"), F.regexp_replace("value", r"\r$", "").alias("value"))


def scan(spark: SparkSession, chats: str | None = None, models: str | None = None, prompts: str | None = None, tools: str | None = None, editing: str | None = None, runs: str | None = None, host: str | None = None) -> dict[str, DataFrame]:
    """The files of a workspace by kind, each as a lazy DataFrame; folders that are not given are left out. Each file is read once, whatever workspaces name it."""
    out: dict[str, DataFrame] = {}
    if chats:
        states = chat_patches.replay(_files(spark, chats, "*.jsonl"))
        asked = chat_patches.requests(states)
        out |= {"chat_sessions": chat_patches.sessions(states), "requests": asked, "auto_signals": chat_patches.auto_signals(asked)}
    if models:
        out["models"] = workspace.models(_files(spark, models, "*.json"))
    if tools:
        out["tools"] = workspace.tools(_files(spark, tools, "*.json"))
    if prompts:
        texts = workspace.prompt_texts(_files(spark, prompts, "*.json"))
        out |= {"skills": workspace.skills(texts), "subagents": workspace.subagents(texts)}
    if editing:
        out["editing_states"] = workspace.editing_states(_files(spark, editing, "state.json"))
    if runs:
        typed = transcripts.entries(_lines(spark, runs, "*.jsonl"))
        out |= {"transcripts": transcripts.lifecycle(typed), "transcript_events": transcripts.transcript_events(typed)}
    if host:
        out["host_logs"] = workspace.host_logs(_lines(spark, host, "*.log"))
    return out


def embed_all(events: DataFrame, store: Store, created_at: int, model: str = "features", version: int = 1, table: str = "embeddings") -> int:
    """Vectors of all sessions and prompts of these events, merged into the store: entity_type, entity_id, model, version, created_at, vector. One row an entity and model; returns the store's version."""
    made = [
        vectors.session_vectors(session_view(events)).select(F.lit("session").alias("entity_type"), F.col("session_id").alias("entity_id"), "vector"),
        vectors.prompt_vectors(prompt_features(events)).where("prompt IS NOT NULL").select(F.lit("prompt").alias("entity_type"), F.col("prompt").alias("entity_id"), "vector"),
    ]
    rows = made[0].unionByName(made[1]).select("entity_type", "entity_id", F.lit(model).alias("model"), F.lit(version).alias("version"), F.lit(created_at).cast("bigint").alias("created_at"), "vector")
    return store.merge(table, rows, ["entity_type", "entity_id", "model"])


# --- evaluation by a language model: what is asked and what is made of answers; asking is the caller's matter ----------


def evaluator_prompt(characters: int = 800) -> Column:
    """The question about a trace with columns task, tool_calls, files and final_diff; of task and diff it quotes so many first characters, as a model's context is bounded."""
    clean = lambda c: F.substring(F.replace(F.coalesce(F.col(c), F.lit("")), F.lit('"""'), F.lit('"')), 1, characters)
    return F.concat(F.lit('Rate the complexity of this task from 1 to 10 and say if a smaller model would do. Answer as JSON with complexity, smallerModelPossible, confidence and reason.\nTask: """'), clean("task"), F.lit('"""\nTools: '), F.col("tool_calls").cast("string"), F.lit("\nFiles: "), F.col("files").cast("string"), F.lit('\nDiff: """'), clean("final_diff"), F.lit('"""'))


def parse_evaluation(answer: Column) -> Column:
    """An answer's JSON, with or without a fence around it; null where it is broken."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(answer), r"^```(?:json)?\n?", ""), r"\n?```$", "")
    got = F.from_json(bare, "struct<complexity: double, smallerModelPossible: boolean, confidence: double, reason: array<string>>")
    return F.when(got["complexity"].isNotNull(), got)


def render_rows(title: str, rows: Iterable, width: int = 60) -> str:
    """A title and lines of ``name: value`` from a few collected rows, for a terminal."""
    out = [title, "-" * min(width, max(1, len(title)))]
    for r in rows:
        out += ["  ".join(f"{k}: {round(v, 3) if isinstance(v, float) else v}" for k, v in r.asDict().items())[: width * 2]]
    return "\n".join(out)
