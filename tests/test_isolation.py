"""What users add fails by itself; draws over all rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionloom.operators import plugins, realtime, trust
from sessionloom.streaming import fanout


@pytest.fixture(scope="module")
def states(spark):
    return spark.createDataFrame([(1, "s", 10, 4.0, 2, "7"), (2, "s", 20, 8.0, 0, "x"), (3, "t", 30, None, 1, None)], "id bigint, session_id string, ts_ms bigint, tokens double, calls int, said string")


def test_measures(spark, states):
    registry = plugins.Registry()
    registry.add_measure("good", F.col("tokens") * 2)
    registry.add_measure("missing", F.col("no_such_column") + 1)
    registry.add_measure("by_zero", F.col("tokens") / F.col("calls"))
    registry.add_measure("bad_cast", F.col("said").cast("int"))
    registry.add_measure("own", lambda row: 10 / row["calls"])
    registry.add_measure("other", lambda row: row["id"] + 0.5)
    ansi = spark.conf.get("spark.sql.ansi.enabled")
    rows = registry.measured(states).orderBy("id").collect()
    assert spark.conf.get("spark.sql.ansi.enabled") == ansi
    plain = lambda name: [None if math.isnan(r[name]) else r[name] for r in rows]
    assert plain("good") == [8.0, 16.0, None] and plain("missing") == [None] * 3 and plain("by_zero") == [2.0, None, None]
    assert plain("bad_cast") == [7.0, None, None] and plain("own") == [5.0, None, 10.0] and plain("other") == [1.5, 2.5, 3.5]
    errors = [{e["measure"]: e["error"] for e in r["errors"]} for r in rows]
    assert all("no_such_column" in e["missing"] for e in errors)
    assert [e.get("own") for e in errors] == [None, "ZeroDivisionError: division by zero", None]
    assert rows[0]["session_id"] == "s" and plugins.Registry().measured(states).where("size(errors) > 0").count() == 0


def test_rules_and_analyzers(states):
    registry = plugins.Registry()
    registry.add_rule(realtime.Rule("good", F.col("tokens") > 3, F.lit("info"), F.lit("m")))
    registry.add_rule(realtime.Rule("broken", F.col("nothing") > 3, F.lit("info"), F.lit("m")))
    registry.add_rule(realtime.Rule("by-zero", F.col("tokens") / F.col("calls") > 1, F.lit("info"), F.lit("m")))
    assert sorted((r["id"], r["rule_id"]) for r in registry.alerts(states).collect()) == [(1, "by-zero"), (1, "good"), (2, "good")]
    assert list(registry.rule_errors(states)) == ["broken"]
    registry.add_analyzer("fine", lambda e: {"n": e.groupBy().count()})
    registry.add_analyzer("bad", lambda e: 1 / 0)
    errors = {}
    assert list(registry.analyze(states, errors)) == ["fine.n"] and errors == {"bad": "division by zero"}
    with pytest.raises(ZeroDivisionError):
        registry.analyze(states)


def test_sinks(spark, tmp_path):
    spark.createDataFrame([(1,)], "id int").write.parquet(f"{tmp_path}/in")
    got, tries = {"a": [], "b": [], "flaky": []}, []

    def flaky(batch, number):
        tries.append(number)
        if len(tries) < 3:
            raise RuntimeError("not yet\nmore")
        got["flaky"].append(batch.count())

    def broken(batch, number):
        raise OSError("gone")

    sinks = {"a": lambda b, n: got["a"].append(b.count()), "broken": broken, "flaky": flaky, "b": lambda b, n: got["b"].append(b.count())}
    give = fanout.fan_out(sinks, f"{tmp_path}/told", wait_s=0)
    batch = spark.read.parquet(f"{tmp_path}/in")
    assert fanout.failures(spark, f"{tmp_path}/told").count() == 0
    give(batch, 7)
    assert got == {"a": [1], "b": [1], "flaky": [1]}
    assert [tuple(r) for r in fanout.failures(spark, f"{tmp_path}/told").collect()] == [("OSError: gone", "broken", 7)]
    give(batch, 7)  # the same batch again goes to those alone that have not taken it
    assert got == {"a": [1], "b": [1], "flaky": [1]}
    with pytest.raises(OSError):
        fanout.fan_out(sinks, f"{tmp_path}/told", attempts=1, needed=("broken",))(batch, 8)
    assert got["b"] == [1, 1]
    # as the sink of a stream
    stream = spark.readStream.schema("id int").parquet(f"{tmp_path}/in")
    stream.writeStream.foreachBatch(fanout.fan_out(sinks, f"{tmp_path}/stream", wait_s=0)).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert got["a"] == [1, 1, 1] and fanout.failures(spark, f"{tmp_path}/stream").first()["batch"] == 0


def test_numbers_over_all_rows(spark):
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("id")).repartition(7)
    assert [(r["id"], r["number"]) for r in trust.numbered(rows, ["id"]).orderBy("id").collect()] == [(i, i) for i in range(1000)]
    assert trust.numbered(rows.limit(0), ["id"]).count() == 0


def test_permutation_importance_like_numpy(spark):
    n, rounds, seed = 400, 3, 11
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=n), rng.normal(size=n)
    actual = ((a + 0.2 * b) > 0).astype(float)
    rows = spark.createDataFrame([(f"k{i:04}", float(a[i]), float(b[i]), float(actual[i])) for i in range(n)], "entity_id string, a double, b double, actual double").repartition(5)
    decide = lambda c: F.when(c["a"] + 0.2 * c["b"] > 0, 1.0).otherwise(0.0)
    got = {r["feature"]: (r["importance"], r["deviation"]) for r in trust.permutation_importance(rows, decide, ["a", "b"], seed=seed, rounds=rounds).collect()}
    draws = {(r["entity_id"], k): r[f"d{k}"] for r in rows.select("entity_id", *[trust.draw("entity_id", seed, F.lit(k), n).alias(f"d{k}") for k in range(rounds)]).collect() for k in range(rounds)}
    for name in ("a", "b"):
        hits = []
        for k in range(rounds):
            from_ = np.array([draws[f"k{i:04}", k] for i in range(n)])
            x, y = (a[from_], b) if name == "a" else (a, b[from_])
            hits.append((((x + 0.2 * y) > 0) == actual).mean())
        assert got[name] == pytest.approx((1 - np.mean(hits), np.std(hits)))
    assert all(r["importance"] is None for r in trust.permutation_importance(rows.limit(0), decide, ["a", "b"]).collect())
