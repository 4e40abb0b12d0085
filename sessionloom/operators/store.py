"""Versioned tables: upserts, latest rows, retention, features and labels."""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOMAINS = ("workspace", "session", "prompt", "tool", "behavior")
#: Fixed value: days that events are kept unless the configuration says otherwise.
RETENTION_DAYS = 90


def retention_days(environment: Mapping[str, str] = os.environ) -> int | float:
    """Days to keep: SESSIONLOOM_RETENTION_DAYS if it is a positive number, else the fixed value."""
    try:
        days = float(environment.get("SESSIONLOOM_RETENTION_DAYS", ""))
    except ValueError:
        return RETENTION_DAYS
    return days if 0 < days < float("inf") else RETENTION_DAYS


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is last in ``order``; an aggregation with partial results, so a key with many versions is no burden to one task."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("b"))
    return best.select(*keys, *[F.col(f"b.{c}").alias(c) for c in rest]).select(rows.columns)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Old rows with new ones in place of those with the same keys. Of new rows with equal keys the last in ``order`` stays (computed_at or created_at, where there is one, and then the other columns)."""
    rest = [c for c in new.columns if c not in keys]
    order = order or [c for c in ("computed_at", "created_at") if c in rest]
    fresh = new.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order, *[c for c in rest if c not in order])).alias("b")).select(*keys, *[F.col(f"b.{c}").alias(c) for c in rest]).select(old.columns)
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(fresh)


def labels_of(labels: DataFrame, domain: str, source: str | None = None, entity_id: str | None = None) -> DataFrame:
    """Labels (entity_id, domain, source, label, created_at) of a domain, of one source or entity if asked."""
    for column, value in (("domain", domain), ("source", source), ("entity_id", entity_id)):
        labels = labels.where(F.col(column) == value) if value is not None else labels
    return labels


def label_histogram(labels: DataFrame, label: str = "label") -> DataFrame:
    return labels.groupBy(label).agg(F.count("*").alias("n"))


def feature_ranges(rows: DataFrame, features: list[str]) -> DataFrame:
    """Least, greatest and mean value of each feature, a row a feature, from one pass."""
    got = rows.agg(*[F.struct(F.min(F.col(f).cast("double")).alias("least"), F.max(F.col(f).cast("double")).alias("greatest"), F.avg(F.col(f).cast("double")).alias("mean")).alias(f) for f in features])
    return got.select(F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), f"{f}.least", f"{f}.greatest", f"{f}.mean") for f in features])))


def label_agreement(one: DataFrame, other: DataFrame, key: str = "session_id", label: str = "label") -> DataFrame:
    """How often two sources agree on the entities that both label: agree, differ."""
    both = one.select(key, F.col(label).alias("a")).join(other.select(key, F.col(label).alias("b")), key)
    return both.agg(F.count(F.when(F.col("a") == F.col("b"), 1)).alias("agree"), F.count(F.when(F.col("a") != F.col("b"), 1)).alias("differ"))


def feature_rows(features: DataFrame, entity: str, domain: str, version: int = 1, computed_at: int = 0) -> DataFrame:
    """Typed features as (domain, entity_id, version, computed_at, features map)."""
    names = [c for c, t in features.dtypes if c != entity and t in ("bigint", "int", "double", "float", "smallint", "tinyint")]
    pairs = F.create_map(*[x for c in names for x in (F.lit(c), F.col(c).cast("double"))])
    return features.select(F.lit(domain).alias("domain"), F.col(entity).alias("entity_id"), F.lit(version).alias("version"), F.lit(computed_at).cast("bigint").alias("computed_at"), pairs.alias("features"))


def read_features(store: DataFrame, domain: str, entity_id: str | None = None, version: int | None = None) -> DataFrame:
    """Features of a domain: one entity's or all; a version's, or the latest."""
    rows = store.where(F.col("domain") == domain)
    rows = rows.where(F.col("entity_id") == entity_id) if entity_id is not None else rows
    return rows.where(F.col("version") == version) if version is not None else latest(rows, ["domain", "entity_id"], ["version", "computed_at"])


def retain(rows: DataFrame, column: str, now_ms: int, days: int = RETENTION_DAYS) -> DataFrame:
    """Rows not older than so many days before ``now_ms``; a filter that prunes files by their least and greatest values."""
    return rows.where(F.col(column) >= now_ms - days * 86_400_000)


def retain_graph(nodes: DataFrame, edges: DataFrame, node_times: DataFrame, now_ms: int, days: int = RETENTION_DAYS) -> tuple[DataFrame, DataFrame]:
    """The graph without nodes whose time (node_id, ts_ms) is too old, and without edges that lose an end."""
    gone = node_times.where(F.col("ts_ms") < now_ms - days * 86_400_000).select("node_id").distinct()
    kept = edges.join(gone, edges.source == gone.node_id, "left_anti").join(gone, edges.target == gone.node_id, "left_anti")
    return nodes.join(gone, "node_id", "left_anti"), kept


def training_matrix(features: DataFrame, labels: DataFrame, key: str = "entity_id") -> DataFrame:
    """Features with their labels; rows without a label go."""
    return features.join(labels, key)


def first_source(frames: list[DataFrame], key: str) -> DataFrame:
    """Rows of several sources, of equal keys those of the first source that has them."""
    out = None
    for i, f in enumerate(frames):
        f = f.withColumn("source_no", F.lit(i))
        out = f if out is None else out.unionByName(f)
    best = out.groupBy(key).agg(F.min("source_no").alias("source_no"))
    return out.join(best, [key, "source_no"]).drop("source_no")


def feature_catalog(spark: SparkSession) -> DataFrame:
    """Name, domain, version of the built-in features. Fixed values."""
    names = {
        "workspace": "total_files language_count branch_count total_loc dependency_count complexity",
        "session": "duration completion_count retry_count accept_count reject_count accept_rate retry_rate",
        "prompt": "token_count context_token history_token retrieved_files retrieved_symbols prompt_density history_ratio",
        "tool": "terminal_calls git_calls mcp_calls filesystem_calls",
        "behavior": "avg_read_before_ask avg_retry_distance tool_switch_frequency context_expansion_speed workflow_entropy retry_burst_score edit_after_accept_ratio workflow_length",
    }
    return spark.createDataFrame([(n, d, 1, "core") for d, all_ in names.items() for n in all_.split()], "name string, domain string, version int, owner string")


def by_domain(catalog: DataFrame, domain: str | None = None) -> DataFrame:
    rows = catalog.where(F.col("domain") == domain) if domain else catalog
    return rows.orderBy("domain", "name")
