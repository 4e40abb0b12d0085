"""Chat session stores: sessions, turns and files as canonical events."""

from __future__ import annotations

import sqlite3

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a store's table is read by.
FETCH = 50_000


def to_ms(value: Column) -> Column:
    """Milliseconds as they are, ISO times parsed, else 0."""
    text = value.cast("string")
    return F.coalesce(text.try_cast("bigint"), F.unix_millis(F.try_to_timestamp(text)), F.lit(0))


def workspace_of(workspace: Column, repository: Column, folder: Column) -> Column:
    """The workspace's id, else by repository, else by folder, else a default."""
    given = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(given(workspace), F.concat(F.lit("repo:"), given(repository)), F.concat(F.lit("cwd:"), given(folder)), F.lit("default"))


def read_store(spark: SparkSession, files: list[str], query: str, schema: str) -> DataFrame:
    """Rows of a query over SQLite files, each file read where it is dealt; every executor must see the files. Spark has no such reader, and files are the unit of work."""

    def read(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as connection:
                    cursor = connection.execute(query)
                    names = [d[0] for d in cursor.description]
                    while rows := cursor.fetchmany(FETCH):
                        yield pa.RecordBatch.from_arrays([pa.array(c, arrow.field(n).type) for n, c in zip(names, zip(*rows))], names=names)

    from pyspark.sql.pandas.types import to_arrow_schema

    frame = spark.createDataFrame([], schema)
    arrow = to_arrow_schema(frame.schema)
    return spark.createDataFrame([(f,) for f in files], "path string").repartition(max(1, len(files))).mapInArrow(read, schema)


def sessions(spark: SparkSession, files: list[str]) -> DataFrame:
    return read_store(spark, files, "SELECT id AS session_id, workspace_id, repository, cwd, CAST(created_at AS TEXT) AS created_at, CAST(updated_at AS TEXT) AS updated_at FROM sessions", "session_id string, workspace_id string, repository string, cwd string, created_at string, updated_at string")


def turns(spark: SparkSession, files: list[str]) -> DataFrame:
    return read_store(spark, files, "SELECT session_id, turn_index, user_message, assistant_response, CAST(timestamp AS TEXT) AS timestamp FROM turns", "session_id string, turn_index bigint, user_message string, assistant_response string, timestamp string")


def session_files(spark: SparkSession, files: list[str]) -> DataFrame:
    return read_store(spark, files, "SELECT session_id, file_path, CAST(first_seen_at AS TEXT) AS first_seen_at FROM session_files", "session_id string, file_path string, first_seen_at string")


def store_events(sessions_: DataFrame, turns_: DataFrame, files: DataFrame) -> DataFrame:
    """Canonical events of stored sessions: start, reads of files, a chat and a completion (a millisecond later) per turn, end. Ordered in a session by (ts_ms, ordinal)."""
    start, end = to_ms(F.col("created_at")), to_ms(F.col("updated_at"))
    head = sessions_.select("session_id", workspace_of(F.col("workspace_id"), F.col("repository"), F.col("cwd")).alias("workspace_id"), start.alias("start"), end.alias("end"))
    keyed = head.select("session_id", "workspace_id")
    begun = head.select("session_id", "workspace_id", F.col("start").alias("ts_ms"), F.lit("session_start").alias("event_type"), F.lit(0).alias("ordinal"))
    ended = head.select("session_id", "workspace_id", F.col("end").alias("ts_ms"), F.lit("session_end").alias("event_type"), F.lit(9).alias("ordinal"))
    read = files.join(keyed, "session_id").select("session_id", "workspace_id", to_ms(F.col("first_seen_at")).alias("ts_ms"), F.lit("read_file").alias("event_type"), F.lit(1).alias("ordinal"), F.col("file_path").alias("path"))
    both = F.array(
        F.struct(F.lit(0).alias("later"), F.lit("chat").alias("event_type"), F.lit(2).alias("ordinal"), F.length("user_message").cast("double").alias("message_length"), F.lit(None).cast("double").alias("response_length")),
        F.struct(F.lit(1).alias("later"), F.lit("completion").alias("event_type"), F.lit(3).alias("ordinal"), F.lit(None).cast("double").alias("message_length"), F.length("assistant_response").cast("double").alias("response_length")),
    )
    asked = turns_.join(keyed, "session_id").select("session_id", "workspace_id", to_ms(F.col("timestamp")).alias("at"), "turn_index", F.inline(both))
    asked = asked.withColumn("ts_ms", F.col("at") + F.col("later")).drop("at", "later")
    return begun.unionByName(ended).unionByName(read, allowMissingColumns=True).unionByName(asked, allowMissingColumns=True)


def turn_events(turns_: DataFrame) -> DataFrame:
    """Turns with a role (session_id, turn_index, role, text) as events: users chat, assistants complete, the system starts; tokens are a quarter of the characters."""
    kind = F.when(F.col("role") == "user", "chat").when(F.col("role") == "assistant", "completion").when(F.col("role") == "system", "session_start")
    return turns_.select("session_id", F.col("turn_index").alias("ts_ms"), kind.alias("event_type"), F.ceil(F.length("text") / 4).cast("double").alias("token_count")).where("event_type IS NOT NULL")
