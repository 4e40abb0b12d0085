"""Several sinks of one stream, each by itself."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Sink = Callable[[DataFrame, int], None]


def _there(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def _mark(spark: SparkSession, path: str, text: str = "") -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, True)
    out.write(text.encode())
    out.close()


def fan_out(sinks: dict[str, Sink], folder: str, attempts: int = 3, wait_s: float = 1.0, needed: tuple[str, ...] = ()) -> Sink:
    """A function for foreachBatch that gives every batch to every sink.

    A sink that raises is tried again, ``attempts`` times in all, and then left out for this batch: the error is kept in the folder (see ``failures``) and the other sinks have the batch all the same. A sink in ``needed`` stops the
    stream instead. What a sink has taken is noted by batch number, so a batch that comes again after a failure goes only to those that had not taken it.
    """

    def give(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.persist()
        try:
            lost: list[Exception] = []
            for name, sink in sinks.items():
                done = f"{folder}/taken/{name}/{number}"
                if _there(spark, done):
                    continue
                for attempt in range(1, attempts + 1):
                    try:
                        sink(batch, number)
                        _mark(spark, done)
                        break
                    except Exception as e:  # noqa: BLE001 a sink may raise anything
                        if attempt < attempts:
                            time.sleep(wait_s)
                        else:
                            said = str(e).splitlines() or [""]
                            _mark(spark, f"{folder}/failed/sink={name}/batch={number}/error.txt", f"{type(e).__name__}: {said[0]}")
                            lost += [e] if name in needed else []
            if lost:
                raise lost[0]
        finally:
            batch.unpersist()

    return give


def failures(spark: SparkSession, folder: str) -> DataFrame:
    """sink, batch and error of what was not delivered."""
    if not _there(spark, f"{folder}/failed"):
        return spark.createDataFrame([], "error string, sink string, batch bigint")
    return spark.read.schema("value string, sink string, batch bigint").text(f"{folder}/failed").withColumnRenamed("value", "error")
