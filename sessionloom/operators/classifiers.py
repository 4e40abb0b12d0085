"""Classifiers that ``pyspark.ml`` lacks, as its estimators and models: Gaussian Bayes with its own smoothing, a perceptron with ReLU and Adam, and multiclass boosting of symmetric trees.

Each learns from sums that tasks make of their Arrow batches and Spark adds up, so what reaches the driver has a fixed size, whatever the number of rows. Models are numbers that are
kept as JSON; they are written, read and put in pipelines as others are. Rows have a class index ``y`` and feature columns; a missing feature counts as 0.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.functions import argmax

CLASSES = 3


def inputs(features: list[str], logs: list[str] = ()):
    """The features as an array column; those in ``logs`` as log(1 + x), not below 0."""
    value = lambda f: F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(0.0)), F.lit(0.0))
    return F.array(*[F.log1p(F.greatest(value(f), F.lit(0.0))) if f in logs else value(f) for f in features])


def softmax_rows(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def summed(rows: DataFrame, sums: Callable[[Iterator[pa.RecordBatch]], np.ndarray], size: int) -> np.ndarray:
    """The sum over all tasks of ``size`` numbers that each makes of its batches; a task sends those that are not 0."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = sums(batches)
        at = np.flatnonzero(made)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(made[at])], names=["slot", "value"])

    out = np.zeros(size)
    added = rows.mapInArrow(task, "slot int, value double").groupBy("slot").agg(F.sum("value").alias("value")).toArrow()
    out[added.column("slot").to_numpy()] = added.column("value").to_numpy()
    return out


#: Rows for which a task of its own is worth while.
TASK_ROWS = 20_000


def _dealt(rows: DataFrame, n: int) -> DataFrame:
    """n rows in no more tasks than they are worth: passes over them are many and short."""
    return rows.coalesce(max(1, -(-n // TASK_ROWS)))


class _Writer(MLWriter):
    def __init__(self, model: NumbersModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession, extraMetadata={"features": self.model.features, "numbers": self.model.numbers})


class _Reader(MLReader):
    def __init__(self, cls: type[NumbersModel]):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> NumbersModel:
        said = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.cls(said["features"], said["numbers"])
        model._resetUid(said["uid"])
        return model


class NumbersModel(Model, MLWritable, MLReadable):
    """A model that is a few numbers, which every task gets; ``transform`` adds probabilities (an array) and predicted, the first index of the largest."""

    def __init__(self, features: list[str], numbers: dict):
        super().__init__()
        self.features, self.numbers = list(features), numbers

    @staticmethod
    def score(numbers: dict, x: np.ndarray) -> np.ndarray:
        """Probabilities of rows of features."""
        raise NotImplementedError

    def _transform(self, dataset: DataFrame) -> DataFrame:
        score, numbers, width = type(self).score, self.numbers, len(self.features)

        @F.pandas_udf("array<double>")
        def probabilities(x: pd.Series) -> pd.Series:
            return pd.Series(list(score(numbers, np.stack(x.to_numpy()) if len(x) else np.zeros((0, width)))))

        out = dataset.withColumn("probabilities", probabilities(inputs(self.features, self.numbers.get("logs", ()))))
        return out.withColumn("predicted", argmax(F.col("probabilities")).cast("double"))

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


# --- Gaussian Bayes -----------------------------------------------------------------------------------------------


class GaussianBayesModel(NumbersModel):
    @staticmethod
    def score(numbers: dict, x: np.ndarray) -> np.ndarray:
        means, variances, priors = (np.array(numbers[k]) for k in ("means", "variances", "priors"))
        with np.errstate(divide="ignore"):
            log = np.log(priors) - 0.5 * np.log(2 * math.pi * variances).sum(1)
        return softmax_rows(log - 0.5 * ((x[:, None, :] - means) ** 2 / variances).sum(2))


class GaussianBayes(Estimator):
    """Means and variances of each feature by class, from one pass; every variance is raised by ``smoothing`` times the greatest variance of a feature."""

    def __init__(self, features: list[str], logs: list[str] = (), smoothing: float = 1e-6, classes: int = CLASSES):
        super().__init__()
        self.features, self.logs, self.smoothing, self.classes = list(features), list(logs), smoothing, classes

    def _fit(self, dataset: DataFrame) -> GaussianBayesModel:
        d = len(self.features)
        rows = dataset.where(F.col("y").isNotNull()).select(F.col("y").cast("int").alias("y"), inputs(self.features, self.logs).alias("x"))
        column = lambda i: F.get("x", F.lit(i))
        per = rows.groupBy("y").agg(F.count("*"), *[F.avg(column(i)) for i in range(d)], *[F.var_pop(column(i)) for i in range(d)]).collect()  # a row a class
        count, means, variances = np.zeros(self.classes), np.zeros((self.classes, d)), np.zeros((self.classes, d))
        for y, n, *moments in per:
            count[y], means[y], variances[y] = n, moments[:d], moments[d:]
        if not per:
            raise ValueError("no rows to learn from")
        share = count / count.sum()
        whole = share @ variances + share @ (means - share @ means) ** 2
        variances += max(self.smoothing * whole.max(), 1e-300)
        return GaussianBayesModel(self.features, {"means": means.tolist(), "variances": variances.tolist(), "priors": share.tolist(), "logs": self.logs})


# --- perceptron ---------------------------------------------------------------------------------------------------


def _layers(w: np.ndarray, d: int, hidden: int, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    cuts = np.cumsum([d * hidden, hidden, hidden * classes])
    a, b, c, e = np.split(w, cuts)
    return a.reshape(d, hidden), b, c.reshape(hidden, classes), e


def perceptron_gradient(w: np.ndarray, x: np.ndarray, y: np.ndarray, hidden: int, classes: int) -> tuple[np.ndarray, float]:
    """Sums over rows of the gradient of the cross entropy, and of that itself."""
    a, b, c, e = _layers(w, x.shape[1], hidden, classes)
    inner = x @ a + b
    active = np.maximum(inner, 0)
    p = softmax_rows(active @ c + e)
    loss = -np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)).sum()
    p[np.arange(len(y)), y] -= 1
    back = (p @ c.T) * (inner > 0)
    return np.concatenate([(x.T @ back).reshape(-1), back.sum(0), (active.T @ p).reshape(-1), p.sum(0)]), float(loss)


class Adam:
    """Adam's state: a step for each gradient."""

    def __init__(self, size: int, rate: float, beta1: float = 0.9, beta2: float = 0.999, epsilon: float = 1e-8):
        self.m, self.v, self.t = np.zeros(size), np.zeros(size), 0
        self.rate, self.beta1, self.beta2, self.epsilon = rate, beta1, beta2, epsilon

    def step(self, g: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m = self.beta1 * self.m + (1 - self.beta1) * g
        self.v = self.beta2 * self.v + (1 - self.beta2) * g * g
        return -self.rate * (self.m / (1 - self.beta1**self.t)) / (np.sqrt(self.v / (1 - self.beta2**self.t)) + self.epsilon)


def first_weights(d: int, hidden: int, classes: int, seed: int) -> np.ndarray:
    """Uniform within one over the root of a layer's inputs."""
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.uniform(-1, 1, n) / math.sqrt(fan) for n, fan in ((d * hidden, d), (hidden, d), (hidden * classes, hidden), (classes, hidden))])


class PerceptronModel(NumbersModel):
    @staticmethod
    def score(numbers: dict, x: np.ndarray) -> np.ndarray:
        a, b, c, e = _layers(np.array(numbers["weights"]), x.shape[1], numbers["hidden"], numbers["classes"])
        scaled = (x - np.array(numbers["means"])) / np.array(numbers["deviations"])
        return softmax_rows(np.maximum(scaled @ a + b, 0) @ c + e)


class Perceptron(Estimator):
    """One hidden layer of ReLU over standardised features, cross entropy, Adam. An epoch is one step, or ``steps`` steps, each on the rows of one part of a hash; a step's gradient is a sum over tasks, and the driver holds the weights and Adam's state."""

    def __init__(self, features: list[str], hidden: int = 64, epochs: int = 300, rate: float = 0.01, steps: int = 1, seed: int = 42, classes: int = CLASSES):
        super().__init__()
        self.features, self.hidden, self.epochs, self.rate, self.steps, self.seed, self.classes = list(features), hidden, epochs, rate, steps, seed, classes

    def _fit(self, dataset: DataFrame) -> PerceptronModel:
        d, hidden, classes = len(self.features), self.hidden, self.classes
        rows = dataset.where(F.col("y").isNotNull()).select(F.col("y").cast("int").alias("y"), inputs(self.features).alias("x"))
        column = lambda i: F.get("x", F.lit(i))
        n, *stats = rows.agg(F.count("*"), *[F.avg(column(i)) for i in range(d)], *[F.stddev_pop(column(i)) for i in range(d)]).first()
        if not n:
            raise ValueError("no rows to learn from")
        means, deviations = np.array(stats[:d]), np.array([s or 1.0 for s in stats[d:]])
        rows = _dealt(rows.withColumn("part", F.pmod(F.xxhash64("x", "y"), F.lit(self.steps))), n).checkpoint()
        sizes = {r["part"]: r["count"] for r in rows.groupBy("part").count().collect()}
        w, adam, losses = first_weights(d, hidden, classes, self.seed), Adam((d + classes + 1) * hidden + classes, self.rate), []

        def gradient(weights: np.ndarray):
            def sums(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
                total = np.zeros(len(weights) + 1)
                for batch in batches:
                    x = (_matrix(batch.column("x"), d) - means) / deviations
                    g, loss = perceptron_gradient(weights, x, batch.column("y").to_numpy(), hidden, classes)
                    total[:-1] += g
                    total[-1] += loss
                return total

            return sums

        for _ in range(self.epochs):
            for part, size in sorted(sizes.items()):
                total = summed(rows.where(F.col("part") == part) if self.steps > 1 else rows, gradient(w), len(w) + 1) / size
                losses.append(float(total[-1]))
                w = w + adam.step(total[:-1])
        return PerceptronModel(self.features, {"weights": w.tolist(), "hidden": hidden, "classes": classes, "means": means.tolist(), "deviations": deviations.tolist(), "losses": losses})


# --- boosting -----------------------------------------------------------------------------------------------------


def leaves(binned: np.ndarray, splits: list[tuple[int, int]]) -> np.ndarray:
    """Each row's leaf of a symmetric tree: a bit for each split (feature, bin), set where the row's bin is above."""
    out = np.zeros(len(binned), np.int64)
    for k, (feature, cut) in enumerate(splits):
        out |= (binned[:, feature] > cut).astype(np.int64) << k
    return out


def best_split(g: np.ndarray, h: np.ndarray, l2: float) -> tuple[int, int]:
    """The (feature, bin) that parts all leaves best, of sums by (leaf, feature, bin, class); of equal ones the first."""
    gl, hl = g.cumsum(2), h.cumsum(2)
    gr, hr = gl[:, :, -1:] - gl, hl[:, :, -1:] - hl
    gain = (gl**2 / (hl + l2) + gr**2 / (hr + l2)).sum((0, 3))[:, :-1]
    scale = max(abs(gain).max(), 1e-300)
    feature, cut = np.unravel_index(np.argmax(np.round(gain / scale, 10)), gain.shape)
    return int(feature), int(cut)


def leaf_values(g: np.ndarray, h: np.ndarray, split: tuple[int, int], rate: float, l2: float) -> np.ndarray:
    """Values by (leaf, class) after a last split, the new bit the highest."""
    feature, cut = split
    gl, hl = g[:, feature, : cut + 1].sum(1), h[:, feature, : cut + 1].sum(1)
    gr, hr = g[:, feature].sum(1) - gl, h[:, feature].sum(1) - hl
    return np.concatenate([-rate * gl / (hl + l2), -rate * gr / (hr + l2)])


def histogram(binned: np.ndarray, y: np.ndarray, scores: np.ndarray, splits: list[tuple[int, int]], bins: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Sums of gradients and of second derivatives of the softmax loss by (leaf, feature, bin, class), and the loss."""
    n, d = binned.shape
    classes = scores.shape[1]
    p = softmax_rows(scores)
    loss = float(-np.log(np.maximum(p[np.arange(n), y], 1e-300)).sum())
    second = p * (1 - p)
    p[np.arange(n), y] -= 1
    cell = (leaves(binned, splits)[:, None] * d + np.arange(d)) * bins + binned
    size = (1 << len(splits)) * d * bins
    shape = (1 << len(splits), d, bins, classes)
    sums = [np.stack([np.bincount(cell.reshape(-1), np.repeat(of[:, c], d), size) for c in range(classes)], 1).reshape(shape) for of in (p, second)]
    return sums[0], sums[1], loss


class BoostingModel(NumbersModel):
    @staticmethod
    def binned(borders: list[list[float]], x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(np.array(b), x[:, i], "left") for i, b in enumerate(borders)], 1) if len(borders) else np.zeros((len(x), 0), np.int64)

    @staticmethod
    def add(scores: np.ndarray, binned: np.ndarray, trees: list) -> np.ndarray:
        for splits, values in trees:
            scores = scores + np.array(values)[leaves(binned, splits)]
        return scores

    @staticmethod
    def score(numbers: dict, x: np.ndarray) -> np.ndarray:
        binned = BoostingModel.binned(numbers["borders"], x)
        return softmax_rows(BoostingModel.add(np.zeros((len(x), numbers["classes"])), binned, numbers["trees"]))


#: Rounds after which the scores so far are written.
KEPT_ROUNDS = 20


class Boosting(Estimator):
    """Gradient boosting with the softmax loss over symmetric trees, which split all leaves of a level alike.

    Features are cut into ``bins`` once, at quantiles. A level of a tree is one pass, in which tasks sum gradients and second derivatives by (leaf, feature, bin, class); the driver gets those
    2^level x features x bins x classes sums and chooses the split. Rows keep their scores, which are written every KEPT_ROUNDS rounds; the trees since are applied on the fly.
    """

    def __init__(self, features: list[str], rounds: int = 200, depth: int = 6, rate: float = 0.1, bins: int = 32, l2: float = 3.0, classes: int = CLASSES):
        super().__init__()
        self.features, self.rounds, self.depth, self.rate, self.bins, self.l2, self.classes = list(features), rounds, depth, rate, bins, l2, classes

    def borders(self, rows: DataFrame) -> list[list[float]]:
        """Up to bins - 1 different quantiles of each feature."""
        at = [k / self.bins for k in range(1, self.bins)]
        found = rows.agg(*[F.percentile_approx(F.get("x", F.lit(i)), at, 10_000) for i in range(len(self.features))]).first()
        return [sorted(set(b or [])) for b in found]

    def _fit(self, dataset: DataFrame) -> BoostingModel:
        d, bins, classes = len(self.features), self.bins, self.classes
        rows = dataset.where(F.col("y").isNotNull()).select(F.col("y").cast("int").alias("y"), inputs(self.features).alias("x"))
        borders = self.borders(rows)

        def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                binned = BoostingModel.binned(borders, _matrix(batch.column("x"), d)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array([r.tobytes() for r in binned], pa.binary()), pa.array([bytes(8 * classes)] * len(binned), pa.binary())], names=["y", "bins", "scores"])

        def opened(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            parts = [b"".join(batch.column(c).to_pylist()) for c in ("bins", "scores")]
            return batch.column("y").to_numpy(), np.frombuffer(parts[0], np.uint8).reshape(-1, d).astype(np.int64), np.frombuffer(parts[1], np.float64).reshape(-1, classes)

        schema = "y int, bins binary, scores binary"
        n = rows.count()
        if not n:
            raise ValueError("no rows to learn from")
        rows = _dealt(rows.mapInArrow(prepare, schema), n).checkpoint()
        trees: list = []
        losses: list[float] = []
        written = 0

        def level(splits: list[tuple[int, int]], since: list):
            def sums(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
                size = (1 << len(splits)) * d * bins * classes
                total = np.zeros(2 * size + 1)
                for batch in batches:
                    y, binned, scores = opened(batch)
                    if len(y):
                        g, h, loss = histogram(binned, y, BoostingModel.add(scores, binned, since), splits, bins)
                        total += np.concatenate([g.reshape(-1), h.reshape(-1), [loss]])
                return total

            return sums

        def apply(since: list):
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    _, binned, scores = opened(batch)
                    yield batch.set_column(2, "scores", pa.array([r.tobytes() for r in BoostingModel.add(scores, binned, since)], pa.binary()))

            return run

        for number in range(self.rounds):
            splits: list[tuple[int, int]] = []
            for k in range(self.depth):
                size = (1 << k) * d * bins * classes
                total = summed(rows, level(splits, trees[written:]), 2 * size + 1)
                g, h = (total[i * size : (i + 1) * size].reshape(1 << k, d, bins, classes) for i in range(2))
                if not k:
                    losses.append(float(total[-1] / n))
                splits = [*splits, best_split(g, h, self.l2)]
            trees.append([splits, leaf_values(g, h, splits[-1], self.rate, self.l2).tolist()])
            if len(trees) - written >= KEPT_ROUNDS and number + 1 < self.rounds:
                rows = rows.mapInArrow(apply(trees[written:]), schema).checkpoint()
                written = len(trees)
        return BoostingModel(self.features, {"borders": borders, "trees": trees, "classes": classes, "losses": losses})


def load(path: str, spark: SparkSession) -> NumbersModel:
    """A model of any of these classes."""
    said = DefaultParamsReader.loadMetadata(path, spark)
    kinds = {c.__name__: c for c in (GaussianBayesModel, PerceptronModel, BoostingModel)}
    return kinds[said["class"].rpartition(".")[2]].load(path)
