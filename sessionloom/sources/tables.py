"""Tables of the store as Parquet, samples for training, and synthetic sessions."""

from __future__ import annotations

import itertools
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.operators.modelsize import BASE_FEATURES, TEMPORAL_FEATURES
from sessionloom.operators.store import upsert
from sessionloom.operators.trust import drift_report, population_stability

TABLES = ("events", "features", "labels", "embeddings", "nodes", "edges", "catalog", "baseline", "feedback")


def location(root: str, name: str) -> str:
    if name not in TABLES:
        raise ValueError(f"no such table: {name}")
    return f"{root.rstrip('/')}/{name}"


def append_events(events: DataFrame, root: str) -> None:
    """Events by day, so that ranges of time and retention touch few files."""
    events.withColumn("day", F.to_date(F.timestamp_millis("ts_ms"))).write.mode("append").partitionBy("day").parquet(location(root, "events"))


def _versions(spark: SparkSession, path: str) -> list[str]:
    """The complete versions of a table, oldest first: those whose last file, the mark of success, is there."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    names = sorted(str(x.getPath().getName()) for x in files.listStatus(folder))
    return [f"{path}/{n}" for n in names if n.startswith("v") and files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table's newest complete version; the events table has none but itself."""
    path = location(root, name)
    versions = _versions(spark, path)
    return spark.read.parquet(versions[-1] if versions else path)


def write(df: DataFrame, root: str, name: str, mode: str = "overwrite") -> None:
    """A new version of a table, or more rows for its newest one. Readers see a version once it is complete, so a failed write leaves the one before."""
    path = location(root, name)
    versions = _versions(df.sparkSession, path)
    if mode == "append" and versions:
        df.write.mode("append").parquet(versions[-1])
        return
    last = int(versions[-1].rpartition("/v")[2]) if versions else 0
    df.write.mode("overwrite").parquet(f"{path}/v{last + 1:09d}")


def upsert_table(new: DataFrame, root: str, name: str, keys: list[str]) -> None:
    """New rows in place of old ones with the same keys, as a new version of the table. For one writer at a time; several, or large tables, use ``logged.Store``, which writes only the buckets that change."""
    spark = new.sparkSession
    old = read(spark, root, name) if _versions(spark, location(root, name)) else new.limit(0)
    write(upsert(old, new, keys), root, name)


def drop_versions(spark: SparkSession, root: str, name: str, keep: int = 2) -> None:
    """Delete all but the newest versions of a table; a reader of one that goes fails."""
    for path in _versions(spark, location(root, name))[:-keep]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def drift_from_baseline(current: DataFrame, root: str, features: list[str]) -> DataFrame | None:
    """The drift report of features against the baseline kept in the store (None for the first), and these features as the next baseline."""
    spark, report = current.sparkSession, None
    if _versions(spark, location(root, "baseline")):
        report = drift_report(population_stability(read(spark, root, "baseline"), current, features)).checkpoint()
    write(current.select(*features), root, "baseline")
    return report


def append_traces(traces: DataFrame, path: str) -> None:
    traces.write.mode("append").json(path)


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """All traces that were appended; their number is its count."""
    return spark.read.json(path)


def append_feedback(outcomes: DataFrame, root: str) -> None:
    """What outcomes teach (see ``feedback``), added to the store's table."""
    write(feedback(outcomes), root, "feedback", "append")


def last_rows(df: DataFrame, order: str, n: int) -> DataFrame:
    """The n rows that come last in an order: a bounded top of each partition, then of these."""
    return df.orderBy(F.desc(order)).limit(n)


def write_training_csv(matrix: DataFrame, path: str, label: str = "label") -> None:
    """Features and label as CSV with a header, and a description of the columns beside them."""
    spark = matrix.sparkSession
    matrix.write.mode("overwrite").option("header", "true").csv(path)
    kinds = [(i, "Label" if c == label else "Num" if t in ("double", "bigint", "int", "float") else "Auxiliary", c) for i, (c, t) in enumerate(matrix.dtypes)]
    spark.createDataFrame(kinds, "position int, kind string, name string").coalesce(1).write.mode("overwrite").option("sep", "\t").csv(path.rstrip("/") + ".cd")


def feedback(outcomes: DataFrame) -> DataFrame:
    """outcomes: session_id, predicted, score. What to learn: a good outcome confirms the prediction, a bad one asks for the next size, others say nothing."""
    larger = F.when(F.col("predicted") == "mini", "medium").otherwise("large")
    return outcomes.withColumn("label", F.when(F.col("score") >= 0.8, F.col("predicted")).when(F.col("score") < 0.5, larger)).where("label IS NOT NULL")


#: Fixed values of the invented sessions, for small, medium and large ones: centre and spread of the logarithmic normal draws, bounds of the even ones, and chances.
SYNTHETIC = {
    "prompt": ((3000, 0.5, 500), (15000, 0.6, 3000), (60000, 0.7, 10000)),
    "completion": ((600, 0.5, 100), (4000, 0.6, 800), (20000, 0.7, 3000)),
    "elapsed": ((6000, 0.6, 1000), (40000, 0.7, 5000), (150000, 0.8, 20000)),
    "tools": ((0, 6), (6, 25), (20, 80)),
    "edits": ((0, 2), (2, 8), (5, 20)),
    "retries": ((0, 0), (1, 2), (2, 10)),
    "retry_chance": (0.0, 0.4, 1.0),
    "loop_chance": (0.0, 0.1, 0.5),
    "agents": ((0, 0), (0, 1), (0, 4)),
    "agent_chance": (0.0, 0.1, 1.0),
    "accept": ((0.85, 1.0), (0.65, 0.85), (0.45, 0.7)),
    "today": ((1, 5), (1, 6), (2, 8)),
    "files_read_share": (0.5, 0.4, 0.4),
    "most_usage": (0.1, 0.5, 0.95),
    "chat_share": (0.4, 0.35, 0.3),
    "tool_share": (0.3, 0.45, 0.5),
    "chat_to_tool": ((1.0, 2.0), (0.5, 1.3), (0.3, 0.9)),
    "cancel": ((0.0, 0.0), (0.0, 0.08), (0.05, 0.15)),
    "switch": ((0.0, 0.0), (0.0, 0.05), (0.02, 0.08)),
    "success": ((1.0, 1.0), (0.9, 1.0), (0.85, 1.0)),
    "auto_confidence": ((0.5, 0.8), (0.4, 0.7), (0.7, 0.9)),
}
SYNTHETIC_LIMIT = 200_000.0


def synthetic_sizes(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """All 34 size features and labels of n invented sessions: half small, three in ten medium, the rest large."""
    part = F.col("id") / n
    label = F.when(part < 0.5, "mini").when(part < 0.8, "medium").otherwise("large")
    draws = itertools.count(seed)
    pick = lambda name, i=None: F.when(F.col("label") == "mini", _value(name, 0, i)).when(F.col("label") == "medium", _value(name, 1, i)).otherwise(_value(name, 2, i))
    _value = lambda name, size, i: float(SYNTHETIC[name][size] if i is None else SYNTHETIC[name][size][i])
    even = lambda name: pick(name, 0) + F.rand(next(draws)) * (pick(name, 1) - pick(name, 0))
    whole = lambda name: F.floor(pick(name, 0) + F.rand(next(draws)) * (pick(name, 1) - pick(name, 0) + 1)).cast("double")
    chance = lambda name: F.rand(next(draws)) < pick(name)
    normal = lambda name: F.greatest(pick(name, 2), F.round(F.exp(F.ln(pick(name, 0)) + pick(name, 1) * F.randn(next(draws)))))
    between = lambda low, high: F.lit(low) + F.rand(next(draws)) * (high - low)
    rows = spark.range(n).withColumn("label", label).withColumns(
        {
            "prompt_tokens": normal("prompt"),
            "completion_tokens": normal("completion"),
            "elapsed_ms": normal("elapsed"),
            "tool_calls": whole("tools"),
            "edits": whole("edits"),
            "retries": F.when(chance("retry_chance"), whole("retries")).otherwise(0.0),
            "has_loop": chance("loop_chance").cast("double"),
            "sub_agents": F.when(chance("agent_chance"), whole("agents")).otherwise(0.0),
            "accept_rate": even("accept"),
            "day_of_week": F.floor(F.rand(next(draws)) * 7).cast("double"),
        }
    )
    prompt, tools, edits, elapsed, accept = (F.col(c) for c in ("prompt_tokens", "tool_calls", "edits", "elapsed_ms", "accept_rate"))
    rows = rows.withColumns(
        {
            "context_tokens": prompt + F.col("completion_tokens"),
            "read_files": F.greatest(F.lit(0.0), tools - edits),
            "unique_files_read": F.round(tools * pick("files_read_share")),
            "unique_files_edited": F.when(F.col("label") == "mini", F.least(edits, F.lit(2.0))).otherwise(F.round(edits * 0.7)),
            "read_to_edit_ratio": F.when(edits > 0, tools / edits).otherwise(tools),
            "retry_rate": F.col("retries") / F.greatest(F.lit(1.0), tools + F.col("retries")),
            "auto_label_code": F.when(F.col("label") == "mini", 1.0).when((F.col("label") == "medium") & (F.rand(next(draws)) < 0.5), 1.0).otherwise(2.0),
            "auto_confidence": even("auto_confidence"),
            "hour_of_day": F.floor(F.rand(next(draws)) * 24).cast("double"),
            "is_weekend": (F.rand(next(draws)) < 0.3).cast("double"),
            "chat_duration_ms": F.round(elapsed * pick("chat_share")),
            "tool_duration_ms": F.round(elapsed * pick("tool_share")),
            "idle_ms": F.round(elapsed * 0.2),
            "chat_to_tool_ratio": F.when(tools > 0, even("chat_to_tool")).otherwise(1.0),
            "cancel_rate": even("cancel"),
            "switch_rate": even("switch"),
            "tool_success_rate": accept * even("success"),
            "rolling_avg_tokens": F.round(prompt * between(0.7, 1.3)),
            "rolling_avg_duration": F.round(elapsed * between(0.7, 1.3)),
            "rolling_accept_rate": accept * between(0.8, 1.1),
            "ema_tokens": F.round(prompt * between(0.5, 1.0)),
            "sessions_today": whole("today"),
        }
    ).withColumns({"context_utilization": F.least(pick("most_usage"), F.col("context_tokens") / SYNTHETIC_LIMIT), "ema_retry_rate": F.col("retry_rate") * between(0.5, 1.5)})
    return rows.select(F.concat(F.lit("synthetic-"), F.col("id").cast("string")).alias("session_id"), "label", *BASE_FEATURES, *TEMPORAL_FEATURES)


#: A session of fifteen events as an agent logs it. Offset in ms, type and payload.
SCENARIO = (
    (0, "session_start", {"modelLimit": 256000}),
    (1000, "llm_request", {"promptTokens": 4000, "completionTokens": 600, "model": "base"}),
    (2000, "tool_call", {"tool": "read_file", "args": {"path": "src/a.ts"}, "success": True}),
    (3000, "tool_call", {"tool": "read_file", "args": {"path": "src/b.ts"}, "success": True}),
    (4000, "tool_call", {"tool": "read_file", "args": {"path": "src/c.ts"}, "success": True}),
    (5000, "edit", {"file": "src/a.ts", "diffLines": 20, "success": True}),
    (6000, "tool_call", {"tool": "run_test", "success": False}),
    (7000, "llm_request", {"promptTokens": 6000, "completionTokens": 900, "model": "base"}),
    (8000, "edit", {"file": "src/a.ts", "diffLines": 12, "success": True}),
    (9000, "tool_call", {"tool": "read_file", "args": {"path": "src/d.ts"}, "success": True}),
    (10000, "edit", {"file": "src/b.ts", "diffLines": 40, "success": False}),
    (11000, "llm_request", {"promptTokens": 6000, "completionTokens": 900, "model": "base"}),
    (12000, "tool_call", {"tool": "read_file", "args": {"path": "src/e.ts"}, "success": True}),
    (13000, "edit", {"file": "src/b.ts", "diffLines": 8, "success": True}),
    (14000, "session_end", {}),
)


def scenario_lines(session_id: str = "demo", start: int = 1_700_000_000_000) -> list[str]:
    """The scenario as log lines of the flat format."""
    return [json.dumps({"type": t, "timestamp": start + at, "sessionId": session_id, **payload}) for at, t, payload in SCENARIO]
