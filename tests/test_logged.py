"""Tables that are changed by commits."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from sessionloom.sources import logged
from sessionloom.sources.logged import Store, day_of

DAY = 86_400_000


def rows(spark, *pairs, n="v bigint"):
    return spark.createDataFrame(list(pairs), f"k string, {n}")


def got(store, table, **at):
    return sorted(map(tuple, store.read(table, **at).collect()))


def files(root):
    return {os.path.join(d, n): os.stat(os.path.join(d, n)).st_mtime_ns for d, _, names in os.walk(root) for n in names if n.endswith(".parquet")}


def test_merge_and_versions(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    with pytest.raises(ValueError):
        store.read("t")
    store.merge("t", rows(spark, ("a", 1), ("b", 2), ("b", 1)), ["k"])
    store.merge("t", rows(spark, ("b", 5), ("c", None)), ["k"])
    store.merge("t", rows(spark, ("b", 5)).limit(0), ["k"])
    assert got(store, "t") == [("a", 1), ("b", 5), ("c", None)] and got(store, "t", version=1) == [("a", 1), ("b", 2)]
    assert store.versions() == [1, 2]
    with pytest.raises(ValueError):
        store.read("t", version=9)


def test_a_merge_writes_its_share(spark, tmp_path):
    """One key of a thousand touches one bucket of 64."""
    store = Store(spark, f"file://{tmp_path}")
    store.merge("t", spark.range(1000).select(F.col("id").cast("string").alias("k"), F.col("id").alias("v")), ["k"])
    before = store.manifest()["tables"]["t"]["parts"]
    store.merge("t", rows(spark, ("17", -1)), ["k"])
    after = store.manifest()["tables"]["t"]["parts"]
    assert len(before) == len(after) == 64 and sum(before[p] != after[p] for p in after) == 1
    assert store.read("t").where("k = '17'").first()["v"] == -1 and store.read("t").count() == 1000


def test_writers_at_once(spark, tmp_path):
    store, failed = Store(spark, str(tmp_path)), []

    def work(n):
        try:
            for k in range(3):
                store.merge("t", rows(spark, (f"{n}-{k}", k), ("shared", n)), ["k"], buckets=2)
                store.append("log", rows(spark, (f"{n}", k)), F.lit("p"))
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=work, args=(n,)) for n in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed
    merged = dict(got(store, "t"))
    assert {k: v for k, v in merged.items() if k != "shared"} == {f"{n}-{k}": k for n in range(3) for k in range(3)} and merged["shared"] in range(3)
    assert len(got(store, "log")) == 9 and store.versions() == list(range(1, 19))
    store.compact("log")
    assert len(store.manifest()["tables"]["log"]["parts"]["p"]) == 1 and len(got(store, "log")) == 9


def test_a_batch_is_added_once(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    for batch, value in ((0, 1), (1, 2), (1, 2), (0, 1), (2, 3)):
        store.append("t", rows(spark, ("a", value)), F.lit("p"), writer=("w", batch))
    assert got(store, "t") == [("a", 1), ("a", 2), ("a", 3)]
    store.replace("t", rows(spark, ("z", 0)))
    assert got(store, "t") == [("z", 0)]


def events(spark, *times):
    return spark.createDataFrame([(i, t) for i, t in enumerate(times)], "id bigint, ts_ms bigint")


def test_prune(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    times = [d * DAY + h * 3_600_000 for d in range(10, 16) for h in (0, 11, 13)] + [None]
    store.append("events", events(spark, *times), day_of("ts_ms"))
    store.merge("embeddings", spark.createDataFrame([(f"e{i}", i * DAY, [float(i)]) for i in range(10, 16)] + [("none", None, None)], "entity_id string, created_at bigint, vector array<double>"), ["entity_id"])
    store.merge("nodes", spark.createDataFrame([(f"n{i}", i * DAY) for i in range(10, 16)], "node_id string, ts_ms bigint"), ["node_id"])
    store.append("edges", spark.createDataFrame([("n10", "n15"), ("n14", "n15"), ("n15", "n11")], "source string, target string"), F.lit("all"))
    before = files(tmp_path / "events")
    now = 20 * DAY + 12 * 3_600_000
    gone = store.prune(now, 7, others={"embeddings": "created_at"}, nodes="nodes", edges="edges")
    cutoff = now - 7 * DAY
    assert sorted(r["ts_ms"] or 0 for r in store.read("events").collect()) == sorted([t for t in times if t and t >= cutoff] + [0])
    assert [r["entity_id"] for r in store.read("embeddings").orderBy("entity_id").collect()] == ["e14", "e15", "none"]
    assert [r["node_id"] for r in store.read("nodes").orderBy("node_id").collect()] == ["n14", "n15"]
    assert [tuple(r) for r in store.read("edges").collect()] == [("n14", "n15")]
    assert gone == {"events": 11, "embeddings": 4, "nodes": 4, "edges": 2}
    assert store.versions()[-1] == 5  # one commit for all
    # of the events, only the day of the cutoff is written anew
    new = [f for f in files(tmp_path / "events") if f not in before]
    assert new and all("1970-01-14" in f for f in new)
    assert store.read("events", version=4).count() == len(times)
    kept = sum(len(fs) for t in store.manifest()["tables"].values() for fs in t["parts"].values())
    assert store.vacuum(1) > 0 and store.versions() == [5] and store.read("events").count() == 8
    assert sum(len(fs) for t in store.manifest()["tables"].values() for fs in t["parts"].values()) == kept
    assert store.prune(now, 7, others={"embeddings": "created_at"}, nodes="nodes", edges="edges") == {"events": 0, "embeddings": 0, "nodes": 0}


def test_parts_are_read_by_name(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.append("events", events(spark, 0, DAY, 2 * DAY), day_of("ts_ms"))
    assert store.read("events", parts=lambda d: d >= "1970-01-02").count() == 2
    assert logged.BUCKETS == 64


def test_a_part_is_one_file_whatever_tasks_rows_come_from(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    numbers = spark.range(400).repartition(8).select(F.col("id").cast("string").alias("k"), F.col("id").alias("v"))
    store.append("log", numbers, F.format_string("%d", F.col("v") % 4))
    assert len(list(tmp_path.glob("log/*/*/*.parquet"))) == 4
    assert got(store, "log", parts="2".__eq__) == sorted((str(v), v) for v in range(2, 400, 4))
