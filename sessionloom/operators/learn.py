"""Model-size classifiers on ``pyspark.ml``, and what surrounds them: folds, stacking, conformal rejection, propagation, pseudo labels.

Rows have an id, a label index (0 mini, 1 medium, 2 large) and feature columns of doubles.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import Bucketizer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sessionloom.functions import argmax, ratio, softmax
from sessionloom.operators import classifiers, kernel, propagation
from sessionloom.operators.modelsize import CLASSES
from sessionloom.operators.trust import drift_report, fit_temperature, population_stability, with_temperature
from sessionloom.operators.vectors import affinity_sums, shares_by_vector

PER_SAMPLE_C = 100.0
#: Decimals of scaled features by which rows are taken to be at the same place; what rounding takes away is far below what the order of a sum does to a result's last shown digit.
PLACES = 11
#: Different places among which labels are spread pair by pair.
MANY = 4_096


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def _read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path).first()[0]


def save_model(model, path: str, spark: SparkSession) -> None:
    """Any model of this module, where Spark can write: what it is, and itself."""
    path = path.rstrip("/")
    _write_text(spark, f"{path}/kind", type(model).__name__)
    if isinstance(model, PipelineModel | classifiers.NumbersModel):
        model.write().overwrite().save(f"{path}/model")
    else:
        model.save(f"{path}/model", spark)


def load_model(path: str, spark: SparkSession):
    """What ``save_model`` has written."""
    path = path.rstrip("/")
    kind = _read_text(spark, f"{path}/kind")
    if kind == "PipelineModel":
        return PipelineModel.load(f"{path}/model")
    own = {c.__name__: c for c in (NearestModel, OnlineLogistic, Stack, Temperature, Conformal)}
    return own[kind].load(f"{path}/model", spark) if kind in own else classifiers.load(f"{path}/model", spark)


def with_index(rows: DataFrame, label: str = "label") -> DataFrame:
    """Rows with the class index of a label's name."""
    return rows.withColumn("y", (F.array_position(F.array(*map(F.lit, CLASSES)), F.col(label)) - 1).cast("double"))


#: The features of tokens and times, which Gaussian Bayes takes as log(1 + x).
LOG_FEATURES = (
    "prompt_tokens completion_tokens context_tokens tool_calls read_files edits retries unique_files_read unique_files_edited elapsed_ms chat_duration_ms tool_duration_ms idle_ms rolling_avg_tokens rolling_avg_duration ema_tokens".split()
)
#: Fixed values of boosting.
BOOSTING_ROUNDS, BOOSTING_DEPTH = 200, 6


def estimator(kind: str, features: list[str], n: int, classes: int = 3, seed: int = 42, rounds: int = BOOSTING_ROUNDS, depth: int = BOOSTING_DEPTH, epochs: int = 300) -> Estimator:
    """An estimator of kind 'logistic', 'bayes', 'boosting' or 'perceptron' over the features; n is the number of training rows, by which the strength of regularisation goes; rounds and depth are those of boosting, epochs those of the perceptron."""
    if kind == "bayes":
        return classifiers.GaussianBayes(features, [f for f in features if f in LOG_FEATURES], classes=classes)
    if kind == "boosting":
        return classifiers.Boosting(features, rounds, depth, classes=classes)
    if kind == "perceptron":
        return classifiers.Perceptron(features, epochs=epochs, seed=seed, classes=classes)
    if kind != "logistic":
        raise ValueError(f"no such kind of model: {kind}")
    gather = VectorAssembler(inputCols=features, outputCol="raw", handleInvalid="keep")
    scale = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True)
    model = LogisticRegression(family="multinomial", maxIter=500, regParam=1 / (PER_SAMPLE_C * max(n, 1)), probabilityCol="p", standardization=False, featuresCol="features", labelCol="y", predictionCol="predicted")
    return Pipeline(stages=[gather, scale, model])


def fit(rows: DataFrame, kind: str, features: list[str], **settings) -> Model:
    """A model of a kind: see ``estimator``; 'knn' is a ``NearestModel``, 'online' an ``OnlineLogistic`` after ten steps."""
    if kind == "knn":
        return NearestModel(rows, features, **settings)
    if kind == "online":
        model = OnlineLogistic(features, rate=0.5)
        for _ in range(10):
            model.partial_fit(rows)
        return model
    return estimator(kind, features, rows.count() if kind == "logistic" else 0, **settings).fit(rows)


def predict(model: Model, rows: DataFrame) -> DataFrame:
    """Rows with predicted index, probabilities as an array, and confidence."""
    out = model.transform(rows)
    if "probabilities" not in out.columns:
        out = out.withColumn("probabilities", vector_to_array("p"))
    return out.withColumn("confidence", F.array_max("probabilities")).drop("raw", "features", "rawPrediction", "p")


class NearestModel:
    """Nearest neighbours over features less their means by their population deviations: k is the root of the number of rows, 3 at least, by cosine distance.

    The reference rows stay a DataFrame; means and deviations are one row on the driver.
    """

    def __init__(self, rows: DataFrame | None, features: list[str], key: str = "session_id", k: int | None = None):
        self.features, self.key = features, key
        if rows is None:  # to be filled by ``load``
            return
        n, *stats = rows.agg(F.count("*"), *[F.avg(f) for f in features], *[F.stddev_pop(f) for f in features]).first()
        self.means, self.deviations = [m or 0.0 for m in stats[: len(features)]], [d or 1.0 for d in stats[len(features) :]]
        self.k = k or min(max(3, math.isqrt(n)), max(n, 1))
        self.rows = rows.select(key, F.col("y").cast("int").alias("label"), self._scaled().alias("embedding"))

    def save(self, path: str, spark: SparkSession) -> None:
        """The reference rows as Parquet, the rest as one row of JSON."""
        self.rows.write.mode("overwrite").parquet(f"{path}/rows")
        _write_text(spark, f"{path}/told", json.dumps({"features": self.features, "key": self.key, "k": self.k, "means": self.means, "deviations": self.deviations}))

    @classmethod
    def load(cls, path: str, spark: SparkSession) -> NearestModel:
        told = json.loads(_read_text(spark, f"{path}/told"))
        model = cls(None, told["features"], told["key"])
        model.k, model.means, model.deviations, model.rows = told["k"], told["means"], told["deviations"], spark.read.parquet(f"{path}/rows")
        return model

    def _scaled(self) -> Column:
        """Rounded to PLACES, so that sums in another order give the same vector."""
        return F.array(*[F.round((F.col(f) - m) / d, PLACES) for f, m, d in zip(self.features, self.means, self.deviations)])

    def transform(self, rows: DataFrame, leave_out: bool = False) -> DataFrame:
        """Rows with probabilities and predicted index (the first of the largest); ``leave_out`` asks without the row of the same key."""
        shares = shares_by_vector(self.rows, rows.select(self.key, self._scaled().alias("embedding")), self.k, self.key, leave_out=leave_out)
        each = shares.groupBy("query").agg(F.array(*[F.coalesce(F.max(F.when(F.col("label") == c, F.col("p"))), F.lit(0.0)) for c in range(3)]).alias("probabilities"))
        out = rows.join(each.withColumnRenamed("query", self.key), self.key, "left").withColumn("probabilities", F.coalesce("probabilities", F.array(*[F.lit(1 / 3)] * 3)))
        return out.withColumn("predicted", argmax(F.col("probabilities")).cast("double"))

    def leave_one_out(self, rows: DataFrame) -> float:
        """Accuracy on the rows that the model was made of, each by its neighbours without itself."""
        return accuracy(self.transform(rows, leave_out=True))


def accuracy(predicted: DataFrame) -> float:
    return predicted.agg(F.avg((F.col("predicted") == F.col("y")).cast("double"))).first()[0] or 0.0


def folds(rows: DataFrame, k: int = 5, key: str = "session_id") -> DataFrame:
    """Rows with a fold, dealt round within each class in the order of a hash; each class of a class window's partition is split by the hash, so no task has a whole class."""
    part = F.pmod(F.xxhash64(key), F.lit(32))
    order = Window.partitionBy("y", "part").orderBy(F.xxhash64(key, F.lit(1)), key)
    return rows.withColumn("part", part).withColumn("fold", F.pmod(F.row_number().over(order) + F.col("part"), F.lit(k)).cast("int")).drop("part")


def fold_count(rows: DataFrame) -> int:
    """Five folds, fewer for few rows, none (0) for under four."""
    n, classes = rows.agg(F.count("*"), F.count_distinct("y")).first()
    return 0 if n < 4 else min(5, max(2, n // max(classes, 1)))


def out_of_fold(rows: DataFrame, kind: str, features: list[str], key: str = "session_id", **settings) -> DataFrame:
    """Predictions of each row by a model that has not seen its fold."""
    k = fold_count(rows)
    # every fold reads it several times
    dealt, out = folds(rows, k, key).checkpoint(), None
    for i in range(k):
        part = predict(fit(dealt.where(F.col("fold") != i), kind, features, **settings), dealt.where(F.col("fold") == i))
        out = part if out is None else out.unionByName(part)
    return out


@dataclass
class Stack:
    """Base models, the temperature of each, and a logistic model over their calibrated probabilities."""

    bases: dict[str, object]
    temperatures: dict[str, float]
    meta: Model
    key: str

    def transform(self, rows: DataFrame) -> DataFrame:
        wide = rows
        for kind, model in self.bases.items():
            wide = wide.join(_calibrated(predict(model, rows), kind, self.temperatures[kind], self.key), self.key)
        return predict(self.meta, wide)


    def save(self, path: str, spark: SparkSession) -> None:
        for kind, model in self.bases.items():
            save_model(model, f"{path}/bases/{kind}", spark)
        save_model(self.meta, f"{path}/meta", spark)
        _write_text(spark, f"{path}/told", json.dumps({"kinds": list(self.bases), "temperatures": self.temperatures, "key": self.key}))

    @classmethod
    def load(cls, path: str, spark: SparkSession) -> Stack:
        told = json.loads(_read_text(spark, f"{path}/told"))
        return cls({k: load_model(f"{path}/bases/{k}", spark) for k in told["kinds"]}, told["temperatures"], load_model(f"{path}/meta", spark), told["key"])


def _calibrated(predicted: DataFrame, kind: str, temperature: float, key: str) -> DataFrame:
    p = with_temperature(F.col("probabilities"), temperature)
    return predicted.select(key, *[F.get(p, F.lit(i)).alias(f"{kind}_{i}") for i in range(3)])


def stack(rows: DataFrame, features: list[str], kinds: tuple[str, ...] = ("online", "knn", "bayes"), key: str = "session_id") -> Stack:
    """Base models on all rows, and a logistic model over their out-of-fold probabilities, each base's by the temperature that suits them best."""
    meta, temperatures = rows.select(key, "y"), {}
    for kind in kinds:
        part = out_of_fold(rows, kind, features, key).checkpoint()
        temperatures[kind] = fit_temperature(part.select(F.col("y").cast("int").alias("actual"), "probabilities"))
        meta = meta.join(_calibrated(part, kind, temperatures[kind], key), key)
    names = [f"{k}_{i}" for k in kinds for i in range(3)]
    return Stack({k: fit(rows, k, features) for k in kinds}, temperatures, fit(meta, "logistic", names), key)


def predict_stack(stacked: Stack, rows: DataFrame) -> DataFrame:
    return stacked.transform(rows)


# --- conformal rejection ------------------------------------------------------------------------------------------


def conformal_scores(predicted: DataFrame) -> DataFrame:
    """How unlike its true class each calibration row looked: 1 - p(true)."""
    return predicted.select((1 - F.get("probabilities", F.col("y").cast("int"))).alias("score"))


#: Bins of a pass over the scores.
SCORE_BINS = 1024


def conformal_threshold(scores: DataFrame, alpha: float = 0.1) -> DataFrame:
    """One row: the score at place ceil((1 - alpha) n) of the ascending order, and n. Counts in SCORE_BINS bins say in which the place lies, and
    that bin is cut again, until it holds few different scores; a pass brings its counts to the driver and no scores."""
    counts = scores.where("score IS NOT NULL").groupBy("score").agg(F.count("*").alias("c")).persist()
    n, low, high = counts.agg(F.sum("c"), F.min("score"), F.max("score")).first()
    place, found = max(-(-(n or 0) * (1 - alpha) // 1), 1), None
    while n and found is None:
        width = (high - low) / SCORE_BINS
        inside = counts.where(F.col("score").between(low, high))
        bin_ = F.least(F.floor((F.col("score") - low) / width), F.lit(SCORE_BINS - 1)) if width > 0 else F.lit(0)
        for r in inside.groupBy(bin_.alias("b")).agg(F.sum("c").alias("c"), F.count("*").alias("different"), F.min("score").alias("low"), F.max("score").alias("high")).orderBy("b").collect():
            if place <= r["c"]:
                break
            place -= r["c"]
        low, high = r["low"], r["high"]
        if r["different"] <= SCORE_BINS:
            for score, c in counts.where(F.col("score").between(low, high)).orderBy("score").collect():
                place -= c
                if place <= 0:
                    found = score
                    break
    counts.unpersist()
    return scores.sparkSession.createDataFrame([(found, n or 0)], "threshold double, n bigint")


def conformal_reject(predicted: DataFrame, scores: DataFrame, alpha: float = 0.1) -> DataFrame:
    """Predictions that are rejected if 1 - their best probability exceeds the threshold, and their p-values: (scores at least as large + 1) / (n + 1).

    Scores and predictions are counted per different value; values are dealt to SCORE_BINS bins of about as many values each, and counts run within a bin, so no task has them all.
    """
    limit = F.broadcast(conformal_threshold(scores, alpha))
    strange = F.round(1 - F.col("confidence"), 12)
    values = scores.where("score IS NOT NULL").groupBy(F.round("score", 12).alias("v")).agg(F.count("*").alias("c")).unionAll(predicted.select(strange.alias("v")).where("v IS NOT NULL").distinct().select("v", F.lit(0).cast("bigint").alias("c")))
    cuts = sorted(set(values.agg(F.percentile_approx("v", [i / SCORE_BINS for i in range(1, SCORE_BINS)], 10_000)).first()[0] or []))
    dealt = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="v", outputCol="bin").transform(values)
    above = dealt.groupBy("bin").agg(F.sum("c").alias("c"))
    # one row a bin
    above = above.select("bin", F.coalesce(F.sum("c").over(Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("more"))
    running = dealt.groupBy("bin", "v").agg(F.sum("c").alias("c")).withColumn("own", F.sum("c").over(Window.partitionBy("bin").orderBy(F.desc("v"))))
    at_least = running.join(F.broadcast(above), "bin").select("v", (F.col("own") + F.col("more")).alias("at_least"))
    rows = predicted.withColumn("strange", strange).join(at_least.withColumnRenamed("v", "strange"), "strange", "left").crossJoin(limit)
    return rows.withColumn("p_value", (F.col("at_least") + 1) / (F.col("n") + 1)).withColumn("rejected", 1 - F.col("confidence") > F.col("threshold")).drop("strange", "at_least", "threshold", "n")


#: Share of the rows by whose predictions temperatures and thresholds are fitted; the others are what the model learns from.
HELD_OUT = 0.3


def held_out(rows: DataFrame, key: str = "session_id", share: float = HELD_OUT) -> tuple[DataFrame, DataFrame]:
    """(rows to learn from, rows to calibrate with), parted by a hash of the key."""
    out = F.pmod(F.xxhash64(key, F.lit(7)), F.lit(1000)) < int(1000 * share)
    return rows.where(~out), rows.where(out)


class Temperature:
    """One number by which a model's log probabilities are divided."""

    def __init__(self, value: float):
        self.value = value

    @classmethod
    def fit(cls, rows: DataFrame, kind: str, features: list[str], key: str = "session_id", **settings) -> Temperature:
        """The value that suits a model of the other rows best on those held out."""
        learnt, out = held_out(rows, key)
        predicted = predict(fit(learnt, kind, features, **settings), out)
        return cls(fit_temperature(predicted.select(F.col("y").cast("int").alias("actual"), "probabilities")))

    def transform(self, predicted: DataFrame) -> DataFrame:
        p = with_temperature(F.col("probabilities"), self.value)
        return predicted.withColumn("probabilities", p).withColumn("confidence", F.array_max("probabilities"))

    def save(self, path: str, spark: SparkSession) -> None:
        _write_text(spark, path, json.dumps(self.value))

    @classmethod
    def load(cls, path: str, spark: SparkSession) -> Temperature:
        return cls(json.loads(_read_text(spark, path)))


class Conformal:
    """Rejection of what looks stranger than a share of the calibration rows; their scores are counted by value."""

    def __init__(self, scores: DataFrame, alpha: float = 0.1):
        self.scores, self.alpha = scores, alpha

    @classmethod
    def fit(cls, rows: DataFrame, kind: str, features: list[str], alpha: float = 0.1, key: str = "session_id", **settings) -> Conformal:
        """Scores of the rows held out, by a model of the others."""
        learnt, out = held_out(rows, key)
        return cls(conformal_scores(predict(fit(learnt, kind, features, **settings), out)).checkpoint(), alpha)

    def transform(self, predicted: DataFrame) -> DataFrame:
        return conformal_reject(predicted, self.scores, self.alpha)

    def save(self, path: str, spark: SparkSession) -> None:
        self.scores.write.mode("overwrite").parquet(f"{path}/scores")
        _write_text(spark, f"{path}/told", json.dumps(self.alpha))

    @classmethod
    def load(cls, path: str, spark: SparkSession) -> Conformal:
        return cls(spark.read.parquet(f"{path}/scores"), json.loads(_read_text(spark, f"{path}/told")))


# --- labels from few labels ---------------------------------------------------------------------------------------


def standardized(rows: DataFrame, features: list[str]) -> DataFrame:
    """Features less their means by their population deviations (1 where there is none), as an array ``x``."""
    stats = rows.agg(*[F.avg(f).alias(f"m_{f}") for f in features], *[F.stddev_pop(f).alias(f"s_{f}") for f in features])
    wide = rows.crossJoin(F.broadcast(stats))
    x = F.array(*[(F.col(f) - F.col(f"m_{f}")) / F.when(F.col(f"s_{f}") > 0, F.col(f"s_{f}")).otherwise(1.0) for f in features])
    return wide.withColumn("x", x).select(*rows.columns, "x")


def propagate_labels(rows: DataFrame, features: list[str], key: str = "session_id", anchor: str = "anchor", sigma: float = 1.0, rounds: int | None = None, tolerance: float = 1e-4) -> DataFrame:
    """Label distributions spread from anchors (class index, null for others) over affinities exp(-d^2 / (2 sigma^2)); anchors keep theirs. Rounds go on until none moves a distribution by the tolerance, or for ``rounds``.

    Rows at the same place (features equal to PLACES decimals) with the same anchor have the same distribution after every round, so a round goes through different places, each with the number of its rows. Up to MANY
    of them are taken pair by pair (``vectors.affinity_sums``). Of more, a round's sums come from features of the kernel (``propagation``), and its work grows with the places and not with their square; only where that would take
    too many features (many dimensions of many values each) all pairs are gone through in passes. A checkpoint cuts each round. Rows without any affinity have no label.
    """
    if rounds is None and tolerance <= 0:
        raise ValueError("without a number of rounds there must be a tolerance")
    scaled = standardized(rows, features).select(key, anchor, F.transform("x", lambda v: F.round(v, PLACES)).alias("x")).checkpoint()
    points = scaled.groupBy("x", anchor).agg(F.min(key).alias(key), F.count("*").alias("m")).checkpoint()
    start = [F.when(F.col(anchor) == i, 1.0).when(F.col(anchor).isNull(), 1 / 3).otherwise(0.0).alias(f"p{i}") for i in range(3)]
    basis = kernel.features_of(points, "x", len(features), sigma) if points.count() > MANY else None
    found = propagation.spread(points, basis, anchor, sigma, rounds, tolerance) if basis else None
    if found is not None:
        held = scaled.where(F.col(anchor).isNotNull()).select(key, *start)
        now = held.unionByName(scaled.where(F.col(anchor).isNull()).select(key, "x").join(found, "x").drop("x"))
    else:
        now = _propagated_by_pairs(scaled, points, start, key, anchor, sigma, rounds, tolerance)
    p = F.array("p0", "p1", "p2")
    return now.select(key, p.alias("probabilities"), F.when(F.array_max(p) > 0, F.get(F.array(*map(F.lit, CLASSES)), (F.array_position(p, F.array_max(p)) - 1).cast("int"))).alias("label"))


def _propagated_by_pairs(scaled: DataFrame, points: DataFrame, start: list[Column], key: str, anchor: str, sigma: float, rounds: int | None, tolerance: float) -> DataFrame:
    now = points.select(key, anchor, *start).checkpoint()
    for _ in count() if rounds is None else range(rounds):
        others = now.select(F.col(key).alias("other"), F.array("p0", "p1", "p2").alias("p")).join(points.select(F.col(key).alias("other"), F.col("x").alias("o"), "m"), "other")
        spread = affinity_sums(points, others, 3, sigma, key, "x").where("total > 0").withColumnRenamed("total", "w")
        moved = now.join(spread, key, "left").select(
            key, anchor, *[F.when(F.col(anchor).isNotNull(), F.col(f"p{i}")).otherwise(F.coalesce(F.col(f"s{i}") / F.col("w"), F.lit(0.0))).alias(f"p{i}") for i in range(3)], F.greatest(*[F.abs(F.coalesce(F.col(f"s{i}") / F.col("w"), F.lit(0.0)) - F.col(f"p{i}")) for i in range(3)]).alias("gap")
        ).checkpoint()
        gap = moved.where(F.col(anchor).isNull()).agg(F.max("gap")).first()[0] or 0.0
        now = moved.drop("gap")
        if gap < tolerance:
            break
    places = points.select(F.col("x").alias("at"), F.col(anchor).alias("at_anchor"), F.col(key).alias("place")).join(now.withColumnRenamed(key, "place").drop(anchor), "place")
    return scaled.join(places, F.col("x").eqNullSafe(F.col("at")) & F.col(anchor).eqNullSafe(F.col("at_anchor")))


def pseudo_labels(labelled: DataFrame, rest: DataFrame, kind: str, features: list[str], rounds: int = 3, most: int = 50, threshold: float = 0.85, decay: float = 0.95, floor: float = 0.65, key: str = "session_id") -> DataFrame:
    """Labelled rows and those that a model, fitted anew each round, is sure of: up to ``most`` a round, the surest first, by a threshold that falls from round to round. ``weight`` tells them apart."""
    have = labelled.select(key, "y", *features).withColumn("weight", F.lit(1.0))
    left = rest.select(key, *features)
    for r in range(rounds):
        found = predict(fit(have, kind, features), left).where(F.col("confidence") >= max(floor, threshold * decay**r))
        chosen = found.orderBy(F.desc("confidence"), key).limit(most).select(key, F.col("predicted").alias("y"), *features, F.col("confidence").alias("weight")).checkpoint()
        if chosen.isEmpty():
            break
        have = have.unionByName(chosen)
        left = left.join(chosen.select(key), key, "left_anti")
    return have


class OnlineLogistic:
    """Softmax regression with per-weight rates (AdaGrad), fed by micro-batches; weights are a small table on the driver, gradients are summed in Spark."""

    def __init__(self, features: list[str], rate: float = 0.1, l2: float = 0.001):
        self.features, self.rate, self.l2 = features, rate, l2
        self.weights = [[0.0] * (len(features) + 1) for _ in range(3)]
        self.squares = [[1e-8] * (len(features) + 1) for _ in range(3)]
        self.scale: list[tuple[float, float]] | None = None

    def _inputs(self) -> Column:
        return F.array(*[(F.col(f) - m) / s for f, (m, s) in zip(self.features, self.scale)], F.lit(1.0))

    def probabilities(self) -> Column:
        x = self._inputs()
        return softmax(F.array(*[F.aggregate(F.zip_with(x, F.lit(w), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) for w in self.weights]))

    def transform(self, rows: DataFrame) -> DataFrame:
        """Rows with probabilities and predicted index."""
        return rows.withColumn("probabilities", self.probabilities()).withColumn("predicted", argmax(F.col("probabilities")).cast("double"))

    def save(self, path: str, spark: SparkSession) -> None:
        """Weights, rates and scale as one row of JSON, where Spark can write."""
        spark.createDataFrame([(json.dumps({"features": self.features, "rate": self.rate, "l2": self.l2, "weights": self.weights, "squares": self.squares, "scale": self.scale}),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, path: str, spark: SparkSession) -> OnlineLogistic:
        said = json.loads(spark.read.text(path).first()[0])
        model = cls(said["features"], said["rate"], said["l2"])
        model.weights, model.squares, model.scale = said["weights"], said["squares"], said["scale"] and [tuple(x) for x in said["scale"]]
        return model

    def partial_fit(self, batch: DataFrame) -> None:
        """One step on a batch with ``y``; the first batch with rows sets the features' scale for good. A batch without rows changes nothing."""
        rows = batch.where(F.col("y").isNotNull()).select(F.col("y").cast("int").alias("y"), classifiers.inputs(self.features).alias("x"))
        d = len(self.features)
        if self.scale is None:
            stats = rows.agg(F.count("*"), *[F.struct(F.avg(F.get("x", F.lit(i))), F.stddev_pop(F.get("x", F.lit(i)))) for i in range(d)]).first()
            if not stats[0]:
                return
            self.scale = [(m or 0.0, s or 1.0) for m, s in stats[1:]]
        weights, (means, deviations) = np.array(self.weights), np.array(self.scale).T

        def sums(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            total = np.zeros(3 * (d + 1) + 1)
            for part in batches:
                if part.num_rows:
                    x = part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                    x = np.hstack([(x - means) / deviations, np.ones((len(x), 1))])
                    p = classifiers.softmax_rows(x @ weights.T)
                    p[np.arange(len(x)), part.column("y").to_numpy()] -= 1
                    total += np.r_[(p.T @ x).reshape(-1), len(x)]
            return total

        total = classifiers.summed(rows, sums, 3 * (d + 1) + 1)
        if not total[-1]:
            return
        g = total[:-1].reshape(3, d + 1) / total[-1] + self.l2 * weights
        squares = np.array(self.squares) + g * g
        self.weights, self.squares = (weights - self.rate * g / np.sqrt(squares)).tolist(), squares.tolist()


def _batches(path: str, spark: SparkSession) -> list[int]:
    """Numbers of the batches whose model is whole, in order."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in files.listStatus(folder)] if files.exists(folder) else []
    whole = lambda n: files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))
    return sorted(int(n[6:]) for n in names if n.startswith("batch=") and whole(n))


def latest_online(path: str, spark: SparkSession) -> OnlineLogistic | None:
    """The model after the last batch that a stream has learnt from."""
    known = _batches(path, spark)
    return OnlineLogistic.load(f"{path}/batch={known[-1]}", spark) if known else None


def learn_from_stream(stream: DataFrame, features: list[str], path: str, checkpoint: str, rate: float = 0.1, l2: float = 0.001, keep: int = 3, trigger: dict | None = None):
    """Start a stream whose every micro-batch is one step of an ``OnlineLogistic``.

    The model after a batch is written under the batch's number, so a batch that comes again after a failure is not learnt twice: the step starts from the batch before, and is left out where its own model is whole.
    The last ``keep`` models stay.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = _batches(path, spark)
        if number in known:
            return
        before = [k for k in known if k < number]
        model = OnlineLogistic.load(f"{path}/batch={before[-1]}", spark) if before else OnlineLogistic(features, rate, l2)
        model.partial_fit(batch)
        model.save(f"{path}/batch={number}", spark)
        for old in before[: max(0, len(before) + 1 - keep)]:
            folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch={old}")
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def importance(rows: DataFrame, features: list[str]) -> DataFrame:
    """How far classes lie apart by each feature: the deviation of class means by the mean deviation within classes."""
    per = rows.groupBy("y").agg(*[F.struct(F.avg(f).alias("m"), F.stddev_pop(f).alias("s")).alias(f) for f in features])
    parts = per.select(F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"{f}.m").alias("m"), F.col(f"{f}.s").alias("s")) for f in features])))
    return parts.groupBy("feature").agg(ratio(F.stddev_pop("m"), F.avg("s")).alias("importance"))


def weight_importance(model: Model, features: list[str], spark: SparkSession) -> DataFrame:
    """The mean size of a logistic model's weights over the classes, per feature (which are scaled alike)."""
    rows = np.abs(model.stages[-1].coefficientMatrix.toArray()).mean(0)
    return spark.createDataFrame([(f, float(w)) for f, w in zip(features, rows)], "feature string, importance double")


def train_all(rows: DataFrame, features: list[str], kinds: tuple[str, ...] = ("logistic", "bayes", "knn", "boosting", "perceptron"), report: Callable[[str, float, float], None] | None = None, **boosting) -> dict[str, object]:
    """Models of all kinds; ``report`` gets each kind's accuracy on its own rows and out of fold (nearest neighbours: leaving one out), a gap of over 0.1 being a sign of fitting too closely."""
    models: dict[str, object] = {}
    for kind in kinds:
        settings = boosting if kind == "boosting" else {}
        models[kind] = fit(rows, kind, features, **settings)
        if report:
            beyond = models[kind].leave_one_out(rows) if kind == "knn" else accuracy(out_of_fold(rows, kind, features, **settings)) if fold_count(rows) else float("nan")
            report(kind, accuracy(predict(models[kind], rows)), beyond)
    return models


def training_run(labelled: DataFrame, rest: DataFrame, features: list[str], baseline: DataFrame | None = None, key: str = "session_id", kinds: tuple[str, ...] = ("logistic", "bayes", "knn"), rounds: int = 10) -> dict[str, object]:
    """One run of training: labels are propagated from the labelled rows to the rest, rows that models are sure of join as pseudo labels, models of the kinds and a stack of them are fitted, and drift from a baseline is told.

    Returns propagated (key, probabilities, label), rows (what was learnt from), models, stack and drift (None without a baseline).
    """
    both = labelled.select(key, F.col("y").cast("int").alias("anchor"), *features).unionByName(rest.select(key, F.lit(None).cast("int").alias("anchor"), *features))
    propagated = propagate_labels(both, features, key, rounds=rounds)
    rows = pseudo_labels(labelled, rest, kinds[0], features, key=key).checkpoint()
    drift = drift_report(population_stability(baseline, both, features)) if baseline is not None else None
    return {"propagated": propagated, "rows": rows, "models": train_all(rows, features, kinds), "stack": stack(rows, features, kinds, key), "drift": drift}
