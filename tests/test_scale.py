"""Results and work of queries on inputs that the smallest tables do not have."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sessionloom.operators import vectors


def test_complexity_of_traces_on_the_edge_between_two(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rows = [(doc_id, chars) for doc_id in (28, 43, 113, 128, 623, 778) for chars in (0, 800, 2800, 20000, 69999)]
    spark.createDataFrame(rows, "doc_id bigint, n_chars bigint").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in entry.queries()["traces_evaluated"](spark, str(tmp_path)).select("id", "complexity").collect())
    with duckdb.connect() as connection:
        connection.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        want = sorted(connection.sql(f"SELECT id, complexity FROM ({entry.oracle_sql()['traces_evaluated']})").fetchall())
    assert got == want


@pytest.mark.parametrize("k, leave_out", [(3, True), (7, True), (7, False), (60, True), (500, True)])
def test_shares_by_vector_against_shares_by_row(spark, k, leave_out):
    """Equal vectors with several labels, so ties are cut within a place and around the query itself."""
    rng = np.random.default_rng(k)
    places = rng.integers(-2, 3, (9, 3)).astype(float)
    rows = [(f"s{i}", places[j].tolist(), int(label)) for i, (j, label) in enumerate(zip(rng.integers(0, 9, 120), rng.integers(0, 3, 120)))]
    frame = spark.createDataFrame([*rows, ("none", None, 1)], "vec_id string, embedding array<double>, label int").repartition(3).cache()
    asked = frame.where("vec_id <> 's7'")
    told = lambda got: {(r["query"], r["label"]): r["p"] for r in got.collect()}
    got, want = (told(f(frame, asked, k, leave_out=leave_out)) for f in (vectors.shares_by_vector, vectors.knn_shares))
    assert len({q for q, _ in want}) == 119 and got == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("nth", [None, 1])
def test_neighbours_left_by_a_guess_are_all_neighbours(monkeypatch, nth):
    """Products in single precision and a bound from a few rows leave out only what is farther, with ties and zeros; a bound that is too narrow (nth 1) is not believed."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(300, 3)), rng.integers(-1, 2, (100, 3)).astype(float)])
    labels, ranks = rng.integers(0, 3, 400), rng.permutation(400)
    for name, value in (("GUESSED", 64), ("SCAN_ROWS", 50), ("SCAN_QUERIES", 7)):
        monkeypatch.setattr(vectors, name, value)
    held = vectors.Neighbours(x, labels, ranks, 6)
    held.nth = nth or held.nth
    looked = []
    plain = held._exact
    monkeypatch.setattr(held, "_exact", lambda at, *rest: (looked.append(at), plain(at, *rest))[1])
    for q, (d, r, kinds) in zip(x, held.search(x)):
        every = sorted(zip(np.maximum(1 - vectors._exact_cosine(x, np.broadcast_to(q, x.shape)), 1e-10).tolist(), ranks.tolist(), labels.tolist()))[:7]
        assert [(b, c) for _, b, c in every] == list(zip(r.tolist(), kinds.tolist())) and np.allclose(d, [a for a, _, _ in every], atol=1e-12)
    narrow = sum(not isinstance(at, slice) for at in looked)
    assert len(looked) == 400 and (narrow > 300 if nth is None else narrow < 400)


def test_neighbours_are_not_exchanged(spark):
    """No row of the plan after the search is a neighbour: it ends in what each query is told."""
    rows = spark.createDataFrame([(f"s{i}", [float(i % 7), 1.0], i % 3) for i in range(40)], "vec_id string, embedding array<double>, label int")
    plan = vectors.shares_by_vector(rows, rows, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.splitlines()[0].startswith("MapInArrow") and plan.count("MapInArrow") == 1


def test_propagation_goes_through_places(spark, monkeypatch):
    """A round multiplies different places, however many rows are there; the distributions are those of all pairs of rows."""
    from sessionloom.operators import learn

    seen, plain = [], learn.affinity_sums
    monkeypatch.setattr(learn, "affinity_sums", lambda rows, others, *a: (seen.append((rows.count(), others.count())), plain(rows, others, *a))[1])
    rows = [(f"s{i}", float(i % 4), float(i % 2), i % 3 if i % 4 == 0 and i % 3 else None) for i in range(60)]
    got = {r["session_id"]: r["probabilities"] for r in learn.propagate_labels(spark.createDataFrame(rows, "session_id string, f double, g double, anchor int"), ["f", "g"], rounds=3, tolerance=0).collect()}
    assert seen == [(6, 6)] * 3
    x = np.array([r[1:3] for r in rows])
    x = (x - x.mean(0)) / x.std(0)
    w = np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / 2)
    np.fill_diagonal(w, 0)
    fixed = np.array([r[3] is not None for r in rows])[:, None]
    p = start = np.array([[1 / 3] * 3 if r[3] is None else np.eye(3)[r[3]] for r in rows])
    for _ in range(3):
        p = np.where(fixed, start, w @ p / w.sum(1, keepdims=True))
    assert np.abs(np.array([got[r[0]] for r in rows]) - p).max() < 1e-9


@pytest.mark.parametrize("features", [["f", "g"], ["f", "k", "c"], ["k", "l"]])
def test_propagation_by_features_against_all_pairs(spark, monkeypatch, features):
    """Of many different rows no pairs are made: components of many and of few values, equal rows, rows far from all, and one whose affinities are below the features' error."""
    from sessionloom.operators import learn

    rng = np.random.default_rng(5)
    n = 600
    f, g = rng.normal(size=n), rng.gamma(2, 1, n)
    f[:3], g[3] = [60.0, 61.0, 9.5], 300.0
    f[20:40], g[20:40] = f[19], g[19]
    table = {"f": f, "g": g, "k": rng.integers(0, 9, n).astype(float), "l": rng.integers(0, 5, n).astype(float), "c": np.full(n, 7.0)}
    anchor = [int(a) if b else None for a, b in zip(rng.integers(0, 3, n), rng.random(n) < 0.3)]
    x = np.column_stack([table[c] for c in features])
    frame = spark.createDataFrame([(f"s{i}", *map(float, r), a) for i, (r, a) in enumerate(zip(x, anchor))], f"session_id string, {', '.join(f'{c} double' for c in features)}, anchor int")
    monkeypatch.setattr(learn, "MANY", 10)
    monkeypatch.setattr(learn, "affinity_sums", None)
    got = {r["session_id"]: (r["probabilities"], r["label"]) for r in learn.propagate_labels(frame, features, rounds=6, tolerance=0).collect()}
    x = (x - x.mean(0)) / np.where(x.std(0) > 0, x.std(0), 1)
    w = np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / 2)
    np.fill_diagonal(w, 0)
    fixed = np.array([a is not None for a in anchor])[:, None]
    p = start = np.array([[1 / 3] * 3 if a is None else np.eye(3)[a] for a in anchor])
    total = w.sum(1, keepdims=True)
    for _ in range(6):
        p = np.where(fixed, start, np.divide(w @ p, total, out=np.zeros_like(p), where=total > 0))
    assert len(got) == n and np.abs(np.array([got[f"s{i}"][0] for i in range(n)]) - p).max() < 1e-8
    assert all((got[f"s{i}"][1] is None) == (not p[i].any()) for i in range(n))


def test_labels_are_spread_to_the_end(spark, tmp_path):
    """Four anchors among twenty sessions, which take 47 rounds to settle: after ten of them eight labels are others."""
    rng = np.random.default_rng(2766)
    values = np.round(rng.gamma(1, 8000, 24) + 5) * 10
    users = np.concatenate([np.arange(4) * 2, np.arange(20) * 2 + 1])
    rows = [(i, int(u), "click", float(v), '{"k": 1}') for i, (u, v) in enumerate(zip(users, values))]
    frame = spark.createDataFrame(rows, "event_id bigint, user_id bigint, event_type string, value double, props string").withColumn("ts", F.timestamp_seconds("event_id"))
    frame.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = {r["session_id"]: r["label"] for r in entry.queries()["label_propagation"](spark, str(tmp_path)).collect()}
    x = (values - values.mean()) / values.std()
    w = np.exp(-((x[:, None] - x) ** 2) / 2)
    np.fill_diagonal(w, 0)
    fixed, own = (users % 2 == 0)[:, None], np.eye(3)[np.digitize(values, [20_000.5, 60_000.5])]
    p, seen = np.where(fixed, own, 1 / 3), []
    while len(seen) < 2 or np.abs(seen[-1] - seen[-2]).max() >= 1e-4:
        p = np.where(fixed, own, w @ p / w.sum(1, keepdims=True))
        seen.append(p)
    assert len(seen) == 47 and (seen[9].argmax(1) != p.argmax(1)).sum() == 8
    assert got == {f"u{u}": ("mini", "medium", "large")[k] for u, k in zip(users, p.argmax(1))}


def test_a_task_has_few_numbers_of_a_matrix_at_a_time():
    assert sum(s.stop - s.start for s in vectors._slices(10_000, 4_096)) == 10_000
    assert max((s.stop - s.start) * 4_096 for s in vectors._slices(10_000, 4_096)) <= vectors.SLICE_CELLS
    assert len(vectors._slices(3, 1 << 30)) == 3


@pytest.mark.parametrize("name", ["transcript_events", "legacy_log_events", "debug_log_events"])
def test_lines_are_read_and_parsed_once(spark, name):
    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    # log lines also have texts in them that are parsed
    assert plan.count("Relation [") == 1
    assert name != "transcript_events" or plan.count("parseJson") == 1


def test_rows_of_a_key_in_order_whatever_their_batches():
    pd = pytest.importorskip("pandas")
    from sessionloom.streaming.sessions import in_order

    batches = [pd.DataFrame({"ts_ms": [5, 1], "id": [2, 9], "x": [None, 1.5]}), pd.DataFrame({"ts_ms": [5], "id": [1], "x": [float("nan")]})]
    assert in_order(iter(batches), ["id", "ts_ms", "x"]) == [(9, 1, 1.5), (1, 5, None), (2, 5, None)]


def test_files_of_a_session_are_asked_for_once():
    from sessionloom.streaming.stateful import _Seen

    class Entries(dict):
        asked = 0

        def keys(self):
            self.asked += 1
            return iter(list(super().keys()))

        def containsKey(self, key):
            self.asked += 1
            return key in self

        def updateValue(self, key, value):
            self[key] = value

    new, old = Entries(), Entries({("a",): (True,), ("b",): (True,)})
    seen, more = _Seen(new, 0), _Seen(old, 2)
    for path in ("a", "b", "c", "a"):
        seen[path] = more[path] = None
    assert (len(seen), new.asked) == (3, 0) and (len(more), old.asked, set(old)) == (3, 1, {("a",), ("b",), ("c",)})
