"""Entities and the property graph of sessions, prompts, tools, files and outcomes, with its canonical questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sessionloom.functions import count_if
from sessionloom.operators.canonical import READS, is_type, session_order
from sessionloom.operators.features import failure_classes, failure_runs, session_features

#: The types of nodes and edges.
NODE_TYPES = ("session", "prompt", "workspace", "commit", "completion", "accept", "reject", "retry", "file", "language", "dependency", "tool")
EDGE_TYPES = ("session_workspace", "session_prompt", "session_completion", "session_commit", "session_file", "session_tool", "completion_outcome", "prompt_file", "workspace_language", "workspace_dependency")

OUTCOMES = ("accept", "reject", "retry")


def _event_key(kind: str):
    return F.concat(F.lit(f"{kind}-"), F.col("id").cast("string"))


def outcomes(events: DataFrame) -> DataFrame:
    """Each accept, reject or retry with the session's latest completion before it, null if there is none."""
    before = F.last(F.when(is_type("completion"), F.col("id")), ignorenulls=True).over(session_order())
    return events.withColumn("completion_id", before).where(is_type(*OUTCOMES)).select("id", "session_id", "ts_ms", "event_type", "completion_id")


def prompt_files(events: DataFrame) -> DataFrame:
    """(prompt_event_id, path): the files read in the session since the prompt before."""
    later = Window.partitionBy("session_id").orderBy(F.desc("ts_ms"), F.desc("id"))
    # counted from the end, all reads before a chat and after the previous one have its number
    rows = events.where(is_type("chat", *READS)).withColumn("segment", F.sum(F.when(is_type("chat"), 1).otherwise(0)).over(later))
    chat = F.max(F.when(is_type("chat"), F.col("id"))).over(Window.partitionBy("session_id", "segment"))
    rows = rows.withColumn("prompt_event_id", chat)
    return rows.where(is_type(*READS) & F.col("prompt_event_id").isNotNull() & F.col("path").isNotNull() & (F.col("path") != "")).select("session_id", "prompt_event_id", "path").distinct()


def tool_pairs(events: DataFrame) -> DataFrame:
    """Tool calls with the last accept or retry of the same call id in the session, and the time between."""
    calls = events.where(is_type("tool_call") & F.col("tool_call_id").isNotNull()).select("session_id", "tool_call_id", "id", "ts_ms")
    done = events.where(is_type("accept", "retry") & F.col("tool_call_id").isNotNull()).groupBy("session_id", "tool_call_id").agg(F.max("ts_ms").alias("done_ts"))
    return calls.join(done, ["session_id", "tool_call_id"], "left").withColumn("took_ms", F.greatest(F.col("done_ts") - F.col("ts_ms"), F.lit(0)))


def tools_used(events: DataFrame) -> DataFrame:
    """The first use of each tool in each session; a tool is named by its call, or by the type of its event."""
    named = events.where(is_type("tool_call", "run_test", "terminal", "commit")).withColumn("tool_name", F.coalesce(F.nullif("tool", F.lit("")), "event_type"))
    kind = F.when(F.col("event_type") == "terminal", "terminal").when(F.col("event_type") == "commit", "git").when(F.col("event_type") == "run_test", "test").when(F.lower("tool_name").contains("mcp"), "mcp").otherwise("generic")
    return named.groupBy("session_id", "tool_name").agg(F.min_by(F.struct("id", "ts_ms", "event_type"), F.struct("ts_ms", "id")).alias("f")).select("session_id", "tool_name", "f.*").withColumn("tool_kind", kind)


def entities(events: DataFrame) -> dict[str, DataFrame]:
    """All entities of a set of events, one DataFrame a kind."""
    named = events.where(is_type("session_start")).select("workspace_id", F.explode(F.concat(F.coalesce("languages", F.array().cast("array<string>")), F.when(F.col("language").isNotNull(), F.array("language")).otherwise(F.array().cast("array<string>")))).alias("name")).distinct()
    needs = events.where(is_type("session_start")).select("workspace_id", F.explode("dependencies").alias("name")).distinct()
    files = events.where(is_type(*READS, "edit")).select("session_id", F.nullif(F.coalesce("path", "file"), F.lit("")).alias("path"), is_type("edit").alias("edited"))
    return {
        "sessions": events.groupBy("session_id").agg(F.min_by("workspace_id", F.struct("ts_ms", "id")).alias("workspace_id"), F.min("ts_ms").alias("started_ms"), F.max("ts_ms").alias("ended_ms"), F.count("*").alias("events")),
        "workspaces": events.select("workspace_id").distinct(),
        "prompts": events.where(is_type("chat")).select("id", "session_id", "ts_ms", "prompt_id", "token_count", "context_token"),
        "completions": events.where(is_type("completion")).select("id", "session_id", "ts_ms", "token_count"),
        "tools": tools_used(events),
        "failures": failure_runs(events),
        "outcomes": outcomes(events),
        "files": files.where("path IS NOT NULL").groupBy("session_id", "path").agg(F.bool_or("edited").alias("edited")),
        "commits": events.where(is_type("commit")).select("id", "session_id", "ts_ms", "branch", "author"),
        "prompt_files": prompt_files(events),
        "languages": named,
        "dependencies": needs,
    }


def graph(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a full build. Nodes: node_id, type, entity_id, name; edges: source, target, type, each once.

    Every part reads the same events; with events stored or cached once, parts are narrow projections and small distinct sets.
    """
    e = entities(events)

    def node(df: DataFrame, kind: str, key, name=None) -> DataFrame:
        key = F.col(key) if isinstance(key, str) else key
        return df.select(F.concat(F.lit(f"{kind}:"), key.cast("string")).alias("node_id"), F.lit(kind).alias("type"), key.cast("string").alias("entity_id"), (key if name is None else F.col(name)).cast("string").alias("name"))

    tool_key = F.concat("tool_name", F.lit("@"), "session_id")
    parts = [
        node(e["sessions"], "session", "session_id"),
        node(e["workspaces"], "workspace", "workspace_id"),
        node(e["prompts"], "prompt", "id"),
        node(e["completions"], "completion", "id"),
        *[node(e["outcomes"].where(F.col("event_type") == k), k, "id") for k in OUTCOMES],
        node(e["commits"], "commit", "id"),
        node(e["files"].select("path").distinct(), "file", "path"),
        node(e["languages"].select("name").distinct(), "language", "name"),
        node(e["dependencies"].select("name").distinct(), "dependency", "name"),
        node(e["tools"], "tool", tool_key, "tool_name"),
    ]

    def edge(df: DataFrame, kind: str, source: tuple, target: tuple) -> DataFrame:
        ends = [F.concat(F.lit(f"{k}:") if isinstance(k, str) else F.concat(k, F.lit(":")), (F.col(c) if isinstance(c, str) else c).cast("string")) for k, c in (source, target)]
        return df.select(ends[0].alias("source"), ends[1].alias("target"), F.lit(kind).alias("type"))

    session = ("session", "session_id")
    edges = [
        edge(e["sessions"], "session_workspace", session, ("workspace", "workspace_id")),
        edge(e["prompts"], "session_prompt", session, ("prompt", "id")),
        edge(e["completions"], "session_completion", session, ("completion", "id")),
        edge(e["commits"], "session_commit", session, ("commit", "id")),
        edge(e["files"], "session_file", session, ("file", "path")),
        edge(e["tools"], "session_tool", session, ("tool", tool_key)),
        edge(e["outcomes"].where("completion_id IS NOT NULL"), "completion_outcome", ("completion", "completion_id"), (F.col("event_type"), "id")),
        edge(e["prompt_files"], "prompt_file", ("prompt", "prompt_event_id"), ("file", "path")),
        edge(e["languages"], "workspace_language", ("workspace", "workspace_id"), ("language", "name")),
        edge(e["dependencies"], "workspace_dependency", ("workspace", "workspace_id"), ("dependency", "name")),
    ]

    def together(frames: list[DataFrame]) -> DataFrame:
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    return together(parts), together(edges)


def type_stats(rows: DataFrame) -> DataFrame:
    """Nodes or edges by type."""
    return rows.groupBy("type").agg(F.count("*").alias("n"))


def nodes_of(nodes: DataFrame, node_id: str | None = None, type_: str | None = None) -> DataFrame:
    """Nodes by id or type."""
    nodes = nodes.where(F.col("node_id") == node_id) if node_id is not None else nodes
    return nodes.where(F.col("type") == type_) if type_ is not None else nodes


def edges_of(edges: DataFrame, type_: str | None = None, source: str | None = None, target: str | None = None) -> DataFrame:
    """Edges by type, source or target."""
    for column, value in (("type", type_), ("source", source), ("target", target)):
        edges = edges.where(F.col(column) == value) if value is not None else edges
    return edges


def neighbors(edges: DataFrame, nodes: DataFrame, source: str, edge_type: str | None = None) -> DataFrame:
    """Nodes that an edge of the source points to."""
    found = edges.where(F.col("source") == source)
    found = found.where(F.col("type") == edge_type) if edge_type else found
    return found.select(F.col("target").alias("node_id")).join(nodes, "node_id")


def reverse_neighbors(edges: DataFrame, nodes: DataFrame, target: str, edge_type: str | None = None) -> DataFrame:
    found = edges.where(F.col("target") == target)
    found = found.where(F.col("type") == edge_type) if edge_type else found
    return found.select(F.col("source").alias("node_id")).join(nodes, "node_id")


def two_hop(edges: DataFrame, first: str, second: str) -> DataFrame:
    """(source, middle, target) along an edge of the first type and one of the second."""
    a = edges.where(F.col("type") == first).select("source", F.col("target").alias("middle"))
    b = edges.where(F.col("type") == second).select(F.col("source").alias("middle"), "target")
    return a.join(b, "middle").select("source", "middle", "target")


def retry_recovery(edges: DataFrame, min_retries: int = 3) -> DataFrame:
    """Sessions whose completions had so many retries and yet an accept; most retries first."""
    hops = two_hop(edges, "session_completion", "completion_outcome")
    counts = hops.groupBy("source").agg(count_if(F.col("target").startswith("retry:")).alias("retry_count"), count_if(F.col("target").startswith("accept:")).alias("accept_count"))
    return counts.where((F.col("retry_count") >= min_retries) & (F.col("accept_count") > 0)).select(F.substring("source", 9, 1_000_000).alias("session_id"), "retry_count", "accept_count").orderBy(F.desc("retry_count"), "session_id")


def workspace_failures(events: DataFrame) -> DataFrame:
    """Per workspace with a failed session: sessions, failed ones, and how many of each class."""
    of = events.select("session_id", "workspace_id").distinct()
    rows = of.join(failure_classes(events).select("session_id", "failure_type"), "session_id", "left")
    failed = F.col("failure_type") != "none"
    by_class = rows.groupBy("workspace_id", "failure_type").agg(F.count("*").alias("n"))
    per = by_class.groupBy("workspace_id").agg(
        F.sum("n").alias("total_sessions"), F.coalesce(F.sum(F.when(failed, F.col("n"))), F.lit(0)).alias("failed_sessions"), F.map_from_entries(F.array_sort(F.collect_list(F.when(failed, F.struct("failure_type", "n"))))).alias("failures")
    )
    return per.where("failed_sessions > 0").orderBy(F.desc("failed_sessions"), "workspace_id")


def tool_impact(events: DataFrame) -> DataFrame:
    """Per tool: the sessions that used it and the means of their rates."""
    uses = tools_used(events).select("session_id", "tool_name")
    rows = uses.join(session_features(events).select("session_id", "accept_rate", "retry_rate"), "session_id")
    return rows.groupBy("tool_name").agg(F.count("*").alias("session_count"), F.avg("accept_rate").alias("avg_accept_rate"), F.avg("retry_rate").alias("avg_retry_rate")).orderBy(F.desc("session_count"), "tool_name")


def _top(rows: DataFrame, name: str, most: int) -> DataFrame:
    counts = rows.groupBy("failure_type", name).agg(F.count("*").alias("n"))
    best = counts.withColumn("r", F.row_number().over(Window.partitionBy("failure_type").orderBy(F.desc("n"), name))).where(F.col("r") <= most)
    return best.groupBy("failure_type").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", name))), lambda x: x[name]).alias(f"top_{name}s"))


def failure_clusters(events: DataFrame) -> DataFrame:
    """Per failure class: its sessions, and their most frequent workspaces, files and languages."""
    failed = failure_classes(events).where("failure_type <> 'none'").select("session_id", "failure_type")
    counts = failed.groupBy("failure_type").agg(F.count("*").alias("session_count"))
    e = entities(events)
    where = failed.join(events.select("session_id", "workspace_id").distinct(), "session_id")
    files = failed.join(e["files"].withColumnRenamed("path", "file"), "session_id")
    spoken = where.join(e["languages"].withColumnRenamed("name", "language"), "workspace_id")
    out = counts
    for rows, name, most in ((spoken, "language", 5), (where.withColumnRenamed("workspace_id", "workspace"), "workspace", 3), (files, "file", 5)):
        out = out.join(_top(rows, name, most), "failure_type", "left")
    return out.orderBy(F.desc("session_count"), "failure_type")
