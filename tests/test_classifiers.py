"""Own classifiers against plain numpy, and models that are written and read."""

import math

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from sessionloom.operators import classifiers, learn
from sessionloom.sources.tables import synthetic_sizes

FEATURES = ["prompt_tokens", "completion_tokens", "tool_calls", "edits", "retries"]


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (200, 4))
    y = (x[:, 0] + 0.3 * rng.normal(size=200) > 0.4).astype(int) + (x[:, 1] * x[:, 0] > 0.5)
    return x, y


@pytest.fixture(scope="module")
def frame(spark, data):
    x, y = data
    return spark.createDataFrame([(i, int(c), *map(float, r)) for i, (r, c) in enumerate(zip(x, y))], "id bigint, y int, a double, b double, c double, d double").repartition(3).cache()


def predicted(model, frame):
    rows = model.transform(frame).orderBy("id").select("probabilities", "predicted").collect()
    return np.array([r["probabilities"] for r in rows]), np.array([r["predicted"] for r in rows])


def test_bayes(frame, data):
    x, y = data
    p, best = predicted(classifiers.GaussianBayes(list("abcd"), ["b"]).fit(frame), frame)
    z = x.copy()
    z[:, 1] = np.log1p(np.maximum(z[:, 1], 0))
    mean, var = np.array([z[y == c].mean(0) for c in range(3)]), np.array([z[y == c].var(0) for c in range(3)]) + 1e-6 * z.var(0).max()
    log = np.log(np.bincount(y) / len(y)) - 0.5 * (np.log(2 * math.pi * var).sum(1) + ((z[:, None] - mean) ** 2 / var).sum(2))
    want = np.exp(log - log.max(1, keepdims=True))
    want /= want.sum(1, keepdims=True)
    assert np.allclose(p, want, atol=1e-9) and (best == want.argmax(1)).all()


def test_bayes_without_a_class_or_a_spread(spark):
    rows = spark.createDataFrame([(0, 0, 1.0, None), (1, 2, 1.0, float("nan")), (2, 2, 1.0, 5.0)], "id bigint, y int, a double, b double")
    p, best = predicted(classifiers.GaussianBayes(["a", "b"]).fit(rows), rows)
    assert np.isfinite(p).all() and (p[:, 1] == 0).all() and best[2] == 2
    with pytest.raises(ValueError):
        classifiers.GaussianBayes(["a"]).fit(rows.limit(0))


def plain_perceptron(x, y, parts, hidden, epochs, rate, seed):
    w, adam, losses = classifiers.first_weights(x.shape[1], hidden, 3, seed), None, []
    m, v, t = np.zeros(len(w)), np.zeros(len(w)), 0
    x = (x - x.mean(0)) / x.std(0)
    for _ in range(epochs):
        for part in sorted(set(parts)):
            xs, ys = x[parts == part], y[parts == part]
            a = w[: x.shape[1] * hidden].reshape(x.shape[1], hidden)
            b = w[a.size : a.size + hidden]
            c = w[a.size + hidden : a.size + hidden + hidden * 3].reshape(hidden, 3)
            e = w[-3:]
            h = xs @ a + b
            r = np.where(h > 0, h, 0)
            z = r @ c + e
            p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
            losses.append(-np.log(p[range(len(ys)), ys]).mean())
            dz = (p - np.eye(3)[ys]) / len(ys)
            dh = (dz @ c.T) * (h > 0)
            g = np.concatenate([(xs.T @ dh).reshape(-1), dh.sum(0), (r.T @ dz).reshape(-1), dz.sum(0)])
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w, losses


@pytest.mark.parametrize("steps", [1, 3])
def test_perceptron(spark, frame, data, steps):
    x, y = data
    model = classifiers.Perceptron(list("abcd"), hidden=8, epochs=12, steps=steps, seed=3).fit(frame)
    parts = np.array([r[0] for r in frame.orderBy("id").select(F.pmod(F.xxhash64(classifiers.inputs(list("abcd")), "y"), F.lit(steps))).collect()])
    w, losses = plain_perceptron(x, y, parts, 8, 12, 0.01, 3)
    assert np.allclose(model.numbers["weights"], w, atol=1e-8) and np.allclose(model.numbers["losses"], losses, atol=1e-8)
    assert losses[-1] < losses[0]


def plain_boosting(x, y, borders, rounds, depth, bins, rate=0.1, l2=3.0):
    """Trees by trying every split of every feature."""
    b = np.stack([[sum(t < v for t in borders[i]) for v in x[:, i]] for i in range(x.shape[1])], 1)
    scores, trees, losses = np.zeros((len(x), 3)), [], []
    for _ in range(rounds):
        p = np.exp(scores) / np.exp(scores).sum(1, keepdims=True)
        losses.append(-np.log(p[range(len(y)), y]).mean())
        g, h = p - np.eye(3)[y], p * (1 - p)
        leaf, splits = np.zeros(len(x), int), []
        for k in range(depth):
            tried = []
            for f in range(x.shape[1]):
                for cut in range(bins - 1):
                    new = leaf + (b[:, f] > cut) * 2**k
                    tried.append((sum(((g[new == n].sum(0) ** 2) / (h[new == n].sum(0) + l2)).sum() for n in set(new)), f, cut))
            top = max(t[0] for t in tried)
            _, f, cut = next(t for t in tried if t[0] >= top - 1e-9 * abs(top))
            splits.append((f, cut))
            leaf = leaf + (b[:, f] > cut) * 2**k
        values = np.array([-rate * g[leaf == n].sum(0) / (h[leaf == n].sum(0) + l2) for n in range(2**depth)])
        scores = scores + values[leaf]
        trees.append((splits, values))
    return trees, losses, scores


def test_boosting(frame, data, monkeypatch):
    x, y = data
    monkeypatch.setattr(classifiers, "KEPT_ROUNDS", 2)
    model = classifiers.Boosting(list("abcd"), rounds=5, depth=3, bins=8).fit(frame)
    trees, losses, scores = plain_boosting(x, y, model.numbers["borders"], 5, 3, 8)
    assert [[tuple(s) for s in t[0]] for t in model.numbers["trees"]] == [t[0] for t in trees]
    assert all(np.allclose(mine[1], want[1], atol=1e-9) for mine, want in zip(model.numbers["trees"], trees))
    assert np.allclose(model.numbers["losses"], losses) and losses == sorted(losses, reverse=True) and losses[0] == pytest.approx(math.log(3))
    p, best = predicted(model, frame)
    assert np.allclose(p, classifiers.softmax_rows(scores)) and (best == scores.argmax(1)).mean() > 0.99


def test_boosting_learns(frame, data):
    model = classifiers.Boosting(list("abcd"), rounds=25, depth=4).fit(frame)
    assert model.numbers["losses"][-1] < 0.35 and (predicted(model, frame)[1] == data[1]).mean() > 0.9


@pytest.fixture(scope="module")
def sizes(spark):
    return learn.with_index(synthetic_sizes(spark, 90)).cache()


SETTINGS = {"boosting": {"rounds": 3, "depth": 2}, "perceptron": {"epochs": 5}}


@pytest.mark.parametrize("kind", ["logistic", "bayes", "boosting", "perceptron", "knn", "online", "stack"])
def test_written_and_read(spark, sizes, tmp_path, kind):
    model = learn.stack(sizes, FEATURES, ("online", "bayes")) if kind == "stack" else learn.fit(sizes, kind, FEATURES, **SETTINGS.get(kind, {}))
    learn.save_model(model, str(tmp_path / "m"), spark)
    again = learn.load_model(str(tmp_path / "m"), spark)
    assert type(again) is type(model)
    plain = lambda m: sorted((r["session_id"], [round(p, 12) for p in r["probabilities"]], r["predicted"]) for r in learn.predict(m, sizes).select("session_id", "probabilities", "predicted").collect())
    assert plain(model) == plain(again)


def test_calibration_written_and_read(spark, sizes, tmp_path):
    rows = learn.predict(learn.fit(sizes, "bayes", FEATURES), sizes).checkpoint()
    inside, out = learn.held_out(sizes)
    assert inside.count() + out.count() == 90 and 10 < out.count() < 45 and inside.join(out, "session_id").count() == 0
    for model in (learn.Temperature.fit(sizes, "bayes", FEATURES), learn.Conformal.fit(sizes, "bayes", FEATURES, alpha=0.2)):
        learn.save_model(model, str(tmp_path / type(model).__name__), spark)
        again = learn.load_model(str(tmp_path / type(model).__name__), spark)
        one, two = (sorted(map(str, m.transform(rows).select("session_id", "confidence", *(["p_value", "rejected"] if isinstance(model, learn.Conformal) else [])).collect())) for m in (model, again))
        assert one == two
    assert learn.load_model(str(tmp_path / "Conformal"), spark).scores.count() == out.count()


def test_in_a_pipeline(frame, tmp_path):
    model = Pipeline(stages=[classifiers.GaussianBayes(list("abcd"))]).fit(frame)
    model.write().overwrite().save(str(tmp_path / "p"))
    again = PipelineModel.load(str(tmp_path / "p"))
    assert np.array_equal(predicted(model, frame)[0], predicted(again, frame)[0])


def test_learning_from_a_stream(spark, tmp_path, data):
    """A batch that comes again is not learnt twice, and the model is that of the same steps by hand."""
    x, y = data
    names = list("abcd")
    for k in range(3):
        spark.createDataFrame([(int(c), *map(float, r)) for r, c in zip(x[60 * k : 60 * k + 60], y[60 * k : 60 * k + 60])], "y int, a double, b double, c double, d double").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema("y int, a double, b double, c double, d double").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    learn.learn_from_stream(stream, names, f"{tmp_path}/m", f"{tmp_path}/c").awaitTermination()
    by_hand = learn.OnlineLogistic(names)
    for k in range(3):
        by_hand.partial_fit(spark.read.parquet(f"{tmp_path}/in/{k}"))
    got = learn.latest_online(f"{tmp_path}/m", spark)
    assert np.allclose(got.weights, by_hand.weights, atol=1e-12) and got.scale == by_hand.scale
    # a checkpoint that was lost: all batches come again, and are known
    learn.learn_from_stream(stream, names, f"{tmp_path}/m", f"{tmp_path}/c2").awaitTermination()
    assert learn.latest_online(f"{tmp_path}/m", spark).weights == got.weights
    by_hand.partial_fit(spark.read.parquet(f"{tmp_path}/in/0").limit(0))
    assert np.allclose(got.weights, by_hand.weights, atol=1e-12)


def test_a_step_is_the_mean_gradient(spark, frame, data):
    x, y = data
    model = learn.OnlineLogistic(list("abcd"), rate=0.5, l2=0.01)
    w, squares = np.zeros((3, 5)), np.full((3, 5), 1e-8)
    z = np.hstack([(x - x.mean(0)) / x.std(0), np.ones((200, 1))])
    for _ in range(3):
        model.partial_fit(frame)
        p = np.exp(z @ w.T) / np.exp(z @ w.T).sum(1, keepdims=True)
        g = (p - np.eye(3)[y]).T @ z / 200 + 0.01 * w
        squares += g * g
        w = w - 0.5 * g / np.sqrt(squares)
    assert np.allclose(model.weights, w, atol=1e-9)
