"""Evaluation, calibration, fusion, drift, sampling and decisions over predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sessionloom.functions import count_if, entropy, ratio
from sessionloom.operators.modelsize import CLASSES

BINS = 10


def confusion(rows: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    return rows.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def class_metrics(matrix: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of each class, from the confusion matrix alone."""
    both = matrix.select("predicted", F.explode(F.array(F.struct(F.col("actual").alias("class"), F.lit(True).alias("own")), F.struct(F.col("predicted").alias("class"), F.lit(False).alias("own")))).alias("k"), "actual", "n")
    hit = F.col("actual") == F.col("predicted")
    sums = both.select("k.class", "k.own", hit.alias("hit"), "n").groupBy("class").agg(
        F.coalesce(F.sum(F.when(F.col("own") & F.col("hit"), F.col("n"))), F.lit(0)).alias("tp"), F.coalesce(F.sum(F.when(F.col("own"), F.col("n"))), F.lit(0)).alias("support"), F.coalesce(F.sum(F.when(~F.col("own"), F.col("n"))), F.lit(0)).alias("guessed")
    )
    p, r = ratio(F.col("tp"), F.col("guessed")), ratio(F.col("tp"), F.col("support"))
    return sums.select("class", p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"), "support")


def summary_metrics(matrix: DataFrame) -> DataFrame:
    """One row: accuracy and macro F1 over the classes that occur."""
    acc = matrix.agg(ratio(F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)), F.sum("n")).alias("accuracy"))
    return acc.crossJoin(class_metrics(matrix).where("support > 0").agg(F.avg("f1").alias("macro_f1")))


def calibration_error(rows: DataFrame, confidence: str = "confidence", correct: str = "correct", bins: int = BINS) -> DataFrame:
    """One row: the mean gap of confidence and accuracy over equal bins, weighted by size."""
    bin_ = F.least(F.floor(F.col(confidence) * bins), F.lit(bins - 1))
    per = rows.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.avg(confidence).alias("c"), F.avg(F.col(correct).cast("double")).alias("a"))
    return per.agg((F.sum(F.col("n") * F.abs(F.col("a") - F.col("c"))) / F.sum("n")).alias("ece"))


def brier(rows: DataFrame, probabilities: list[str], actual: str = "actual") -> DataFrame:
    """One row: mean squared gap of probabilities and outcomes, over rows times classes. Columns of ``probabilities`` are those of classes 0, 1, ..."""
    gaps = [F.pow(F.col(p) - F.when(F.col(actual) == i, 1.0).otherwise(0.0), 2) for i, p in enumerate(probabilities)]
    return rows.agg((F.sum(sum(gaps[1:], gaps[0])) / (F.count("*") * len(probabilities))).alias("brier"))


def with_temperature(probabilities: Column, t: Column | float) -> Column:
    """A distribution sharpened (t < 1) or flattened (t > 1)."""
    powers = F.transform(probabilities, lambda p: F.exp(F.ln(F.greatest(p, F.lit(1e-9))) / t))
    total = F.aggregate(powers, F.lit(0.0), lambda s, x: s + x)
    return F.transform(powers, lambda x: x / total)


def temperature_losses(rows: DataFrame, grid: list[float], probabilities: str = "probabilities", actual: str = "actual") -> DataFrame:
    """Mean negative log-likelihood at each temperature; rows are read once, the grid is exploded beside them."""
    each = rows.select(actual, probabilities, F.explode(F.lit([float(t) for t in grid])).alias("t"))
    p = F.get(with_temperature(F.col(probabilities), F.col("t")), F.col(actual))
    return each.groupBy("t").agg(F.avg(-F.ln(F.greatest(p, F.lit(1e-9)))).alias("nll"))


def fit_temperature(rows: DataFrame, rounds: int = 3, probabilities: str = "probabilities", actual: str = "actual") -> float:
    """The temperature of least loss: a grid from 0.1 to 5, narrowed around its best point round by round. A grid's losses are all that reaches the driver."""
    low, high, best = 0.1, 5.0, 1.0
    for _ in range(rounds):
        gap = (high - low) / 49
        grid = [low + i * gap for i in range(50)]
        best = temperature_losses(rows, grid, probabilities, actual).orderBy("nll", "t").first()["t"]
        low, high = max(0.05, best - gap), best + gap
    return best


def weighted_fusion(votes: DataFrame) -> DataFrame:
    """votes: entity_id, source, model, confidence. Shares of confidence per class, and the first best class."""
    sums = votes.groupBy("entity_id").agg(*[F.coalesce(F.sum(F.when(F.col("model") == m, F.col("confidence"))), F.lit(0.0)).alias(m) for m in CLASSES])
    total = F.col("mini") + F.col("medium") + F.col("large")
    return _top(sums.select("entity_id", *[ratio(F.col(m), total).alias(m) for m in CLASSES]))


def bayesian_fusion(votes: DataFrame) -> DataFrame:
    """Votes as independent evidence: confidence for the class voted for, half of the rest for each other."""
    logs = [F.sum(F.ln(F.greatest(F.when(F.col("model") == m, F.col("confidence")).otherwise((1 - F.col("confidence")) / 2), F.lit(1e-9)))).alias(m) for m in CLASSES]
    sums = votes.groupBy("entity_id").agg(*logs).withColumn("top", F.greatest(*CLASSES))
    powers = sums.select("entity_id", *[F.exp(F.col(m) - F.col("top")).alias(m) for m in CLASSES])
    total = F.col("mini") + F.col("medium") + F.col("large")
    return _top(powers.select("entity_id", *[(F.col(m) / total).alias(m) for m in CLASSES]))


def stacking_fusion(votes: DataFrame, weights: dict[str, float] | None = None, bias: float = 0.0) -> DataFrame:
    """Votes weighted by their sources; a source without a weight has an equal share."""
    known = F.create_map(*[x for k, w in weights.items() for x in (F.lit(k), F.lit(float(w)))]) if weights else F.lit(None).cast("map<string,double>")
    rows = votes.withColumn("w", F.coalesce(F.try_element_at(known, F.col("source")), 1 / F.count("*").over(Window.partitionBy("entity_id"))))
    sums = rows.groupBy("entity_id").agg(*[(F.coalesce(F.sum(F.when(F.col("model") == m, F.col("w") * F.col("confidence"))), F.lit(0.0)) + bias).alias(m) for m in CLASSES])
    kept = sums.select("entity_id", *[F.greatest(F.col(m), F.lit(0.0)).alias(m) for m in CLASSES])
    total = F.col("mini") + F.col("medium") + F.col("large")
    return _top(kept.select("entity_id", *[ratio(F.col(m), total).alias(m) for m in CLASSES]))


def _top(rows: DataFrame) -> DataFrame:
    best = F.greatest(*CLASSES)
    model = F.when(F.col("mini") == best, "mini").when(F.col("medium") == best, "medium").otherwise("large")
    return rows.withColumns({"model": model, "confidence": best})


# --- drift --------------------------------------------------------------------------------------------------------


def _histograms(baseline: DataFrame, current: DataFrame, columns: list[str], bins: int) -> DataFrame:
    """feature, side, bin, n over equal bins of the joint range; constant features have none."""
    cast = [F.col(c).cast("double").alias(c) for c in columns]
    both = baseline.select(F.lit("b").alias("side"), *cast).unionAll(current.select(F.lit("c").alias("side"), *cast)).unpivot("side", columns, "feature", "v").where("v IS NOT NULL")
    spans = both.groupBy("feature").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).where("lo < hi")
    bin_ = F.least(F.floor((F.col("v") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)), F.lit(bins - 1))
    return both.join(F.broadcast(spans), "feature").groupBy("feature", "side", bin_.alias("bin")).agg(F.count("*").alias("n"))


def population_stability(baseline: DataFrame, current: DataFrame, columns: list[str], bins: int = BINS) -> DataFrame:
    """The stability index of each feature between two sets of rows: equal bins of the joint range, half a row added to each. Constant features have 0."""
    counts = _histograms(baseline, current, columns, bins).groupBy("feature", "bin").agg(*[F.coalesce(F.sum(F.when(F.col("side") == s, F.col("n"))), F.lit(0)).alias(s) for s in "bc"])
    spark = baseline.sparkSession
    grid = spark.range(bins).select(F.col("id").alias("bin")).crossJoin(counts.select("feature").distinct())
    whole = Window.partitionBy("feature")
    full = grid.join(counts, ["feature", "bin"], "left").select("feature", *[F.coalesce(s, F.lit(0)).alias(s) for s in "bc"])
    p = [(F.col(s) + 0.5) / (F.sum(s).over(whole) + bins * 0.5) for s in "bc"]
    psi = full.select("feature", ((p[1] - p[0]) * F.ln(p[1] / p[0])).alias("term")).groupBy("feature").agg(F.abs(F.sum("term")).alias("psi"))
    names = spark.createDataFrame([(c,) for c in columns], "feature string")
    return F.broadcast(names).join(psi, "feature", "left").select("feature", F.coalesce("psi", F.lit(0.0)).alias("psi"))


def drift_report(stability: DataFrame) -> DataFrame:
    """One row: greatest and mean index, how many features to watch, and if to retrain."""
    got = stability.agg(F.max("psi").alias("max_psi"), F.avg("psi").alias("avg_psi"), count_if(F.col("psi") > 0.1).alias("drifted_features"))
    return got.withColumn("recommendation", F.when((F.col("max_psi") > 0.25) | (F.col("avg_psi") > 0.1), "retrain").when(F.col("max_psi") > 0.1, "monitor").otherwise("stable"))


def label_divergence(baseline: DataFrame, current: DataFrame, label: str = "label") -> DataFrame:
    """One row: the divergence of the current labels' shares from the baseline's; labels absent on either side are left out."""
    shares = []
    for side, rows in (("p", current), ("q", baseline)):
        counts = rows.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
        shares.append(counts.crossJoin(counts.agg(F.sum("n").alias("t"))).select("label", (F.col("n") / F.col("t")).alias(side)))
    return shares[0].join(shares[1], "label").agg(F.coalesce(F.abs(F.sum(F.col("p") * F.ln(F.col("p") / F.col("q")))), F.lit(0.0)).alias("kl"))


def concept_drift(baseline: DataFrame, current: DataFrame, columns: list[str], threshold: float = 0.3) -> DataFrame:
    """One row: the mean relative shift of the features' means, the worst feature, and how grave it is."""
    means = lambda df: df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in columns])
    old, new = means(baseline).select(F.struct("*").alias("o")), means(current).select(F.struct("*").alias("n"))
    rows = old.crossJoin(new).select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), ratio(F.abs(F.col(f"n.{c}") - F.col(f"o.{c}")), F.abs(F.col(f"o.{c}")), F.abs(F.col(f"n.{c}"))).alias("shift")) for c in columns])).alias("r")).select("r.*")
    got = rows.agg(F.avg("shift").alias("avg_shift"), F.max_by("feature", "shift").alias("worst_feature"))
    return got.withColumn("severity", severity(F.col("avg_shift"), threshold))


def severity(value: Column, threshold: float) -> Column:
    return F.when(value >= threshold * 2, "high").when(value >= threshold, "medium").when(value >= threshold * 0.5, "low").otherwise("none")


def model_drift(recent: DataFrame, baseline_accuracy: float, threshold: float = 0.05, correct: str = "correct") -> DataFrame:
    """One row: accuracy now, its drop from the baseline, and how grave it is."""
    got = recent.agg(F.avg(F.col(correct).cast("double")).alias("accuracy"))
    return got.withColumn("drop", F.lit(baseline_accuracy) - F.col("accuracy")).withColumn("severity", severity(F.col("drop"), threshold))


# --- decisions ----------------------------------------------------------------------------------------------------


def sampling(rows: DataFrame, strategy: str, rate: float, draw: Column, probabilities: str = "probabilities", confidence: str = "confidence") -> DataFrame:
    """Which decisions to check by a shadow run: 'random', 'confidence', 'uncertainty' or 'active'. ``draw`` is a number from 0 to 1 per row, as F.rand(seed)."""
    if strategy == "random":
        chosen = draw < rate
    elif strategy == "confidence":
        chosen = draw < F.least(F.lit(rate * 2), F.greatest(F.lit(0.0), (0.7 - F.col(confidence)) / 0.7) * rate * 2)
    elif strategy == "uncertainty":
        chosen = (entropy(F.col(probabilities)) / F.ln(F.lit(3.0)) >= 0.9) & (draw < rate)
    elif strategy == "active":
        best = F.sort_array(probabilities, asc=False)
        chosen = (F.get(best, F.lit(0)) - F.coalesce(F.get(best, F.lit(1)), F.lit(0.0)) <= 0.15) & (draw < rate)
    else:
        raise ValueError(f"no such strategy: {strategy}")
    return rows.withColumn("sampled", chosen)


def decide(fused: DataFrame, temperature: float = 1.0) -> DataFrame:
    """Fused shares to a decision: calibrated distribution, model, confidence, alternatives in order, risk, and if it needs a look."""
    p = with_temperature(F.array(*CLASSES), F.lit(temperature))
    rows = fused.select("entity_id", p.alias("probabilities"))
    pairs = F.sort_array(F.zip_with("probabilities", F.array(*map(F.lit, CLASSES)), lambda x, m: F.struct(x.alias("p"), m.alias("model"))), asc=False)
    rows = rows.withColumn("ranked", pairs)
    confidence = F.get("ranked", F.lit(0))["p"]
    margin = confidence - F.get("ranked", F.lit(1))["p"]
    return rows.select(
        "entity_id",
        "probabilities",
        F.get("ranked", F.lit(0))["model"].alias("model"),
        confidence.alias("confidence"),
        F.transform(F.slice("ranked", 2, 2), lambda x: x["model"]).alias("alternatives"),
        F.when(confidence < 0.5, "high").when(margin < 0.15, "medium").otherwise("low").alias("risk"),
    )


def scorecard(accuracy: Column, macro_f1: Column, brier_score: Column, ece: Column, cost_saved: Column, failure_increase: Column, latency_ms: Column) -> Column:
    """Grade A to F of an advisor; percentages from 0 to 100."""
    score = accuracy * 30 + macro_f1 * 25 + (1 - brier_score) * 15 + (1 - ece) * 10 + cost_saved / 10 - failure_increase * 0.15 - F.least(latency_ms / 1000, F.lit(1.0)) * 5
    return F.when(score >= 85, "A").when(score >= 75, "B").when(score >= 60, "C").when(score >= 45, "D").otherwise("F")


def contributions(rows: DataFrame, score, features: list[str], key: str = "entity_id") -> DataFrame:
    """Ablation: how much each feature adds to a row's score. ``score`` builds a column from a dict of columns, so all ablations are one projection."""
    columns = {f: F.col(f).cast("double") for f in features}
    full = score(columns)
    parts = [F.struct(F.lit(f).alias("feature"), (full - score({**columns, f: F.lit(0.0)})).alias("contribution")) for f in features]
    return rows.select(key, F.inline(F.array(*parts)))


def counterfactual(rows: DataFrame, decide_, features: list[str], steps: int = 10, key: str = "entity_id") -> DataFrame:
    """The least cut of one feature that changes a row's decision: features by value, each cut in tenths; ``decide_`` builds the decision from a dict of columns."""
    columns = {f: F.col(f).cast("double") for f in features}
    now = decide_(columns)
    tries = [F.struct(F.lit(f).alias("feature"), columns[f].alias("value"), F.lit(k).alias("step"), (columns[f] * (1 - k / steps)).alias("changed_to"), decide_({**columns, f: columns[f] * (1 - k / steps)}).alias("decision")) for f in features for k in range(1, steps + 1)]
    found = rows.select(key, now.alias("now"), F.inline(F.array(*tries))).where("decision <> now")
    return found.groupBy(key).agg(F.min_by(F.struct("feature", "changed_to", "decision"), F.struct(-F.col("value"), "feature", "step")).alias("c")).select(key, "c.*")


def numbered(rows: DataFrame, order: list[str], name: str = "number") -> DataFrame:
    """Rows with a number from 0 in an order over all of them: sorted by range, numbered within a range, and moved by the rows of the ranges before, of which the driver sees only the counts."""
    spark = rows.sparkSession
    at = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()).checkpoint()
    place = F.shiftright("at", 33)
    counts = sorted(at.groupBy(place.alias("p")).count().collect())
    bases, so_far = [], 0
    for p, n in counts:
        bases.append((p, so_far - (p << 33)))
        so_far += n
    base = F.broadcast(spark.createDataFrame(bases, "p bigint, base bigint"))  # a row a range
    return at.withColumn("p", place).join(base, "p").withColumn(name, F.col("at") + F.col("base")).drop("p", "at", "base")


def draw(key: str, seed: int, round_: Column, n: int) -> Column:
    """The number of the row that a row draws in a round, of all n."""
    return F.pmod(F.xxhash64(key, F.lit(seed), round_), F.lit(n))


def permutation_importance(rows: DataFrame, decide_, features: list[str], actual: str = "actual", key: str = "entity_id", seed: int = 42, rounds: int = 5) -> DataFrame:
    """Mean loss of accuracy, and its deviation over the rounds, when a feature's values come from other rows, drawn with replacement from all.

    Rows are numbered over all partitions (see ``numbered``), and each draws a number in each round, so one equi-join on numbers brings what is drawn. ``decide_`` builds the decision from a dict of columns.
    No rows give no importance.
    """
    columns = {f: F.col(f).cast("double") for f in features}
    rows = numbered(rows.select(key, actual, *features), [key])
    n = rows.count()
    base = rows.agg(F.avg((decide_(columns) == F.col(actual)).cast("double")).alias("base"))
    given = rows.select(F.col("number").alias("drawn"), *[F.col(f).cast("double").alias(f"o_{f}") for f in features])
    asked = rows.drop("number").withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))).withColumn("drawn", draw(key, seed, F.col("round"), max(n, 1)))
    hit = lambda f: F.avg((decide_({**columns, f: F.col(f"o_{f}")}) == F.col(actual)).cast("double"))
    hits = asked.join(given, "drawn").groupBy("round").agg(*[hit(f).alias(f) for f in features])
    each = hits.unpivot(["round"], features, "feature", "accuracy")
    # one row
    return each.groupBy("feature").agg(F.avg("accuracy").alias("a"), F.stddev_pop("accuracy").alias("deviation")).crossJoin(base).select("feature", (F.col("base") - F.col("a")).alias("importance"), "deviation")


# --- whole decisions and shadow runs --------------------------------------------------------------------------------

#: Chance that a size does the work, and dollars for a million tokens in and out.
SUCCESS = {"mini": 0.87, "medium": 0.92, "large": 0.95}
PRICES = {"mini": (0.15, 0.6), "medium": (3.0, 15.0), "large": (15.0, 75.0)}
SAVED = {"mini": 60, "medium": 25, "large": 0}
#: Fixed values of the risk: least confidence, most of the context used.
RISK_CONFIDENCE, RISK_USAGE = 0.6, 0.7


def whole_decisions(fused: DataFrame, rows: DataFrame, score, decide_, features: list[str], temperature: float = 1.0, key: str = "entity_id", prices: dict[str, tuple[float, float]] = PRICES) -> DataFrame:
    """Decisions (see ``decide``) with what they rest on and what they lead to.

    rows has the key and the features; of these prompt_tokens, completion_tokens, retries, has_loop and context_utilization are looked at where they are. ``score`` and ``decide_`` build a score and a size from a dict of columns.
    Adds reasons (the five features that move the score most, each way), risk_factors and by their number the risk, success, tokens, cost and saving of the chosen size, and counterfactual: the least cut of one feature that leads to a smaller size.
    """
    parts = contributions(rows, score, features, key)
    reasons = parts.where("contribution <> 0").groupBy(key).agg(F.slice(F.sort_array(F.collect_list(F.struct(F.abs("contribution").alias("size"), "feature", "contribution")), asc=False), 1, 5).alias("r"))
    reasons = reasons.select(key, F.transform("r", lambda x: F.struct(x["feature"].alias("feature"), x["contribution"].alias("contribution"))).alias("reasons"))
    order = F.array(*map(F.lit, CLASSES))
    smaller = counterfactual(rows, decide_, features, key=key)
    smaller = smaller.join(rows.select(key, decide_({f: F.col(f).cast("double") for f in features}).alias("now")), key).where(F.array_position(order, F.col("decision")) < F.array_position(order, F.col("now")))
    smaller = smaller.select(key, F.struct("feature", "changed_to", "decision").alias("counterfactual"))
    value = lambda name: F.coalesce(F.col(name).cast("double"), F.lit(0.0)) if name in rows.columns else F.lit(0.0)
    seen = rows.select(key, *[value(c).alias(c) for c in ("prompt_tokens", "completion_tokens", "retries", "has_loop", "context_utilization")])
    got = decide(fused.withColumnRenamed("entity_id", key) if key != "entity_id" else fused, temperature).join(seen, key).join(reasons, key, "left").join(smaller, key, "left")
    factors = F.array_compact(
        F.array(
            F.when(F.col("confidence") < RISK_CONFIDENCE, F.lit("the choice is not sure")),
            F.when(F.col("retries") > 0, F.format_string("%d tries failed", F.col("retries").cast("int"))),
            F.when(F.col("has_loop") > 0, F.lit("tools repeat themselves")),
            F.when(F.col("context_utilization") > RISK_USAGE, F.lit("the context is nearly full")),
        )
    )
    of = lambda table: F.element_at(F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))]), F.col("model"))
    cost = (F.col("prompt_tokens") * of({k: float(v[0]) for k, v in prices.items()}) + F.col("completion_tokens") * of({k: float(v[1]) for k, v in prices.items()})) / 1e6
    return got.withColumn("risk_factors", factors).select(
        key,
        "probabilities",
        "model",
        "confidence",
        "alternatives",
        F.when(F.size("risk_factors") >= 3, "high").when(F.size("risk_factors") >= 1, "medium").otherwise("low").alias("risk"),
        "risk_factors",
        F.coalesce("reasons", F.array().cast("array<struct<feature:string,contribution:double>>")).alias("reasons"),
        of(SUCCESS).alias("success"),
        (F.col("prompt_tokens") + F.col("completion_tokens")).alias("tokens"),
        F.round(cost, 4).alias("cost"),
        of(SAVED).alias("saving_percent"),
        F.when(F.col("model") != CLASSES[0], F.col("counterfactual")).alias("counterfactual"),
    )


def within_budget(sampled: DataFrame, budget: int, order: str = "entity_id") -> DataFrame:
    """Of the rows that ``sampling`` chose, the first so many by ``order`` stay chosen; the others lose to the budget. Both are told by ``reason``."""
    chosen = sampled.where("sampled").orderBy(order).limit(max(budget, 0)).select(F.col(order).alias("within"))
    rows = sampled.join(F.broadcast(chosen) if budget <= 100_000 else chosen, F.col(order) == F.col("within"), "left")
    inside = F.col("within").isNotNull()
    return rows.withColumn("reason", F.when(inside, "sampled").when(F.col("sampled"), "beyond the budget").otherwise("not drawn")).withColumn("sampled", inside).drop("within")


def heuristic_shadow(states: DataFrame, draw: Column, shadow_model: str = "mini") -> DataFrame:
    """A stand-in for running a task again with another model, for tests: small tasks succeed, of others seven in ten; adds shadow_model and shadow_success. ``draw`` is a number from 0 to 1 per row."""
    small = (F.col("sum_prompt") < 8000) & (F.col("tool_calls") <= 5) & (F.col("files_edited") <= 2) & (F.col("retries") == 0)
    return states.withColumns({"shadow_model": F.lit(shadow_model), "shadow_success": small | (draw > 0.3)})


def shadow_run(states: DataFrame, rate: float, draw: Column, runner, model: str = "model") -> tuple[DataFrame, DataFrame]:
    """Check a share of recommendations by running them again. ``states`` has the recommended ``model``; ``runner`` turns the drawn rows into rows with shadow_success, as ``heuristic_shadow`` or a caller's own that asks a model.

    Returns the drawn rows with the label that they teach (the recommended size if the shadow succeeded, else the next larger) and how sure it is; and one row: total, sampled and rate.
    """
    marked = states.withColumn("drawn", draw < rate)
    label = F.when(F.col("shadow_success"), F.col(model)).when(F.col(model) == "mini", "medium").otherwise("large")
    ran = runner(marked.where("drawn").drop("drawn")).withColumns({"label": label, "label_confidence": F.when(F.col("shadow_success"), 0.95).otherwise(0.6)})
    stats = marked.agg(F.count("*").alias("total"), count_if(F.col("drawn")).alias("sampled")).withColumn("rate", ratio(F.col("sampled"), F.col("total")))
    return ran, stats


def calibration_report(rows: DataFrame, temperature: float, probabilities: str = "probabilities", actual: str = "actual") -> DataFrame:
    """One row: calibration error before and after the temperature, and the Brier score before it."""
    arrays = {"pre": F.col(probabilities), "post": with_temperature(F.col(probabilities), temperature)}
    told = rows.select(actual, *[p.alias(k) for k, p in arrays.items()])
    out = None
    for k in arrays:
        one = told.select(F.array_max(k).alias("confidence"), (F.array_position(k, F.array_max(k)) - 1 == F.col(actual)).alias("correct"))
        part = calibration_error(one).withColumnRenamed("ece", f"{k}_ece")
        out = part if out is None else out.crossJoin(part)
    gap = F.aggregate(F.transform(probabilities, lambda p, i: F.pow(p - F.when(i == F.col(actual), 1.0).otherwise(0.0), 2)), F.lit(0.0), lambda s, x: s + x) / F.size(probabilities)
    return out.crossJoin(rows.agg(F.avg(gap).alias("brier"))).withColumn("temperature", F.lit(float(temperature)))
