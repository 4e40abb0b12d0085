"""Workflow mining: Markov transitions, directly-follows graphs, variants, daily trends, correlation with outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sessionloom.functions import count_if, ratio, round_half_up
from sessionloom.operators.canonical import is_type, session_order
from sessionloom.operators.features import session_view


def steps_taken(events: DataFrame) -> DataFrame:
    """(session_id, pos, from_type, to_type) for neighbouring events."""
    order = session_order()
    rows = events.select("session_id", F.row_number().over(order).alias("pos"), F.col("event_type").alias("from_type"), F.lead("event_type").over(order).alias("to_type"))
    return rows.where("to_type IS NOT NULL")


def transitions(events: DataFrame) -> DataFrame:
    """from_type, to_type, count and the share of to_type after from_type. The share's window runs over pairs of types, not events."""
    counts = steps_taken(events).groupBy("from_type", "to_type").agg(F.count("*").alias("count"))
    return counts.withColumn("probability", F.col("count") / F.sum("count").over(Window.partitionBy("from_type")))


def start_distribution(events: DataFrame) -> DataFrame:
    """How many sessions begin with each type, and their share."""
    firsts = events.groupBy("session_id").agg(F.min_by("event_type", F.struct("ts_ms", "id")).alias("event_type"))
    counts = firsts.groupBy("event_type").agg(F.count("*").alias("count"))
    return counts.crossJoin(counts.agg(F.sum("count").alias("total"))).select("event_type", "count", (F.col("count") / F.col("total")).alias("probability"))


def anomaly_score(model: DataFrame) -> DataFrame:
    """One row: the mean surprise of a transition by its share to four places, a fifth of it, 1 at most."""
    rounded = model.withColumn("p", F.round("probability", 4))
    return rounded.agg(F.sum("count").alias("transitions"), F.count("*").alias("distinct_transitions"), F.least(F.lit(1.0), F.sum(-F.ln(F.col("p") + 1e-10) * F.col("count")) / F.sum("count") / 5).alias("anomaly_score"))


def sequence_log_probability(events: DataFrame, model: DataFrame) -> DataFrame:
    """Per session the sum of ln(share + 1e-10) over its steps; unknown steps have share 0. The model has a row per pair of types, so it is broadcast."""
    known = steps_taken(events).join(F.broadcast(model.select("from_type", "to_type", "probability")), ["from_type", "to_type"], "left")
    return known.groupBy("session_id").agg(F.count("*").alias("steps"), F.sum(F.ln(F.coalesce("probability", F.lit(0.0)) + 1e-10)).alias("log_probability"))


def typical_workflow(events: DataFrame, length: int = 8, least: float = 0.01) -> DataFrame:
    """From the most frequent first type on, always the likeliest next type: pos, event_type, probability. Ends at session_end, below ``least``, or at ``length``. Rows are pairs of types at most."""
    model = transitions(events)
    best = model.groupBy("from_type").agg(F.max_by(F.struct("to_type", "probability"), F.struct("probability", F.col("to_type"))).alias("b")).select(F.col("from_type").alias("at"), "b.to_type", "b.probability")
    begin = start_distribution(events).orderBy(F.desc("count"), F.desc("event_type")).limit(1)
    path = begin.select(F.array(F.struct(F.lit(1).alias("pos"), "event_type", "probability")).alias("path"), F.col("event_type").alias("at"))
    for pos in range(2, length + 1):
        nxt = path.join(F.broadcast(best), "at", "left")
        on = (F.col("at") != "session_end") & (F.col("probability") >= least)
        step = F.struct(F.lit(pos).alias("pos"), F.col("to_type").alias("event_type"), "probability")
        path = nxt.select(F.when(on, F.concat("path", F.array(step))).otherwise(F.col("path")).alias("path"), F.when(on, F.col("to_type")).alias("at"))
    return path.select(F.inline("path"))


def directly_follows(events: DataFrame) -> DataFrame:
    """Edges: frequency and dependency (ab - ba) / (ab + ba + 1), which is 0 for a loop."""
    edges = steps_taken(events).groupBy("from_type", "to_type").agg(F.count("*").alias("frequency"))
    back = edges.select(F.col("from_type").alias("to_type"), F.col("to_type").alias("from_type"), F.col("frequency").alias("reverse"))
    both = edges.join(back, ["from_type", "to_type"], "left").withColumn("reverse", F.coalesce("reverse", F.lit(0)))
    return both.withColumn("dependency", (F.col("frequency") - F.col("reverse")) / (F.col("frequency") + F.col("reverse") + 1)).drop("reverse")


def workflow_nodes(events: DataFrame) -> DataFrame:
    """Types with how often they occur and how many different edges go in and out."""
    edges = directly_follows(events)
    out, into = edges.groupBy(F.col("from_type").alias("event_type")).agg(F.count("*").alias("out_degree")), edges.groupBy(F.col("to_type").alias("event_type")).agg(F.count("*").alias("in_degree"))
    counts = events.groupBy("event_type").agg(F.count("*").alias("frequency"))
    return counts.join(into, "event_type", "left").join(out, "event_type", "left").select("event_type", "frequency", F.coalesce("in_degree", F.lit(0)).alias("in_degree"), F.coalesce("out_degree", F.lit(0)).alias("out_degree"))


def session_paths(events: DataFrame) -> DataFrame:
    """Each session's types in order, neighbours of the same type as one."""
    order = session_order()
    rows = events.select("session_id", "ts_ms", "id", "event_type", F.lag("event_type").over(order).alias("before")).where("before IS NULL OR before <> event_type")
    pairs = rows.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("ts_ms", "id", "event_type"))).alias("p"))
    return pairs.select("session_id", F.transform("p", lambda x: x["event_type"]).alias("path"))


def variants(events: DataFrame, top: int = 5) -> DataFrame:
    counts = session_paths(events).groupBy(F.array_join("path", ">").alias("variant")).agg(F.count("*").alias("frequency"))
    return counts.orderBy(F.desc("frequency"), "variant").limit(top)


def failure_patterns(events: DataFrame, top: int = 3) -> DataFrame:
    """The most frequent paths with a retry but no accept, or with a reject at the end."""
    paths = session_paths(events)
    failing = (F.array_contains("path", "retry") & ~F.array_contains("path", "accept")) | (F.element_at("path", -1) == "reject")
    counts = paths.where(failing).groupBy(F.array_join("path", ">").alias("pattern")).agg(F.count("*").alias("frequency"))
    return counts.orderBy(F.desc("frequency"), "pattern").limit(top)


def daily_metrics(events: DataFrame) -> DataFrame:
    """Per UTC day: rates, mean tokens to whole numbers, sessions and events."""
    day = F.to_date(F.timestamp_millis("ts_ms"))
    return (
        events.groupBy(day.alias("day"))
        .agg(
            F.count("*").alias("event_count"),
            F.count_distinct("session_id").alias("session_count"),
            count_if(is_type("completion")).alias("completions"),
            count_if(is_type("retry")).alias("retries"),
            count_if(is_type("accept")).alias("accepts"),
            count_if(is_type("reject")).alias("rejects"),
            F.sum(F.coalesce("token_count", "prompt_tokens", F.lit(0.0))).alias("tokens"),
        )
        .select(
            "day",
            ratio(F.col("accepts"), F.col("accepts") + F.col("rejects")).alias("accept_rate"),
            ratio(F.col("retries"), F.col("completions")).alias("retry_rate"),
            round_half_up(F.col("tokens") / F.col("event_count")).alias("avg_tokens"),
            "session_count",
            "event_count",
        )
    )


def trends(daily: DataFrame) -> DataFrame:
    """Per metric the slope over the days' order, its direction, its size by the mean, and the mean of the last seven days. The days are few, whatever the events."""
    names = ["accept_rate", "retry_rate", "avg_tokens", "session_count"]
    long = daily.unpivot("day", [F.col(c).cast("double").alias(c) for c in names], "metric", "value")
    order = Window.partitionBy("metric").orderBy("day")
    rows = long.withColumns({"x": F.row_number().over(order) - 1, "back": F.row_number().over(Window.partitionBy("metric").orderBy(F.desc("day")))})
    got = rows.groupBy("metric").agg(
        F.count("*").alias("days"), F.sum("x").alias("sx"), F.sum("value").alias("sy"), F.sum(F.col("x") * F.col("value")).alias("sxy"), F.sum(F.col("x") * F.col("x")).alias("sxx"), F.avg("value").alias("mean"), F.avg(F.when(F.col("back") <= 7, F.col("value"))).alias("rolling_avg")
    )
    slope = ratio(F.col("days") * F.col("sxy") - F.col("sx") * F.col("sy"), F.col("days") * F.col("sxx") - F.col("sx") * F.col("sx"))
    got = got.withColumn("slope", slope)
    direction = F.when(F.col("slope") > 0.001 * F.col("mean"), "increasing").when(F.col("slope") < -0.001 * F.col("mean"), "decreasing").otherwise("stable")
    return got.select("metric", "slope", direction.alias("direction"), ratio(F.abs("slope"), F.col("mean")).alias("magnitude"), "rolling_avg")


def trend_summary(daily: DataFrame) -> DataFrame:
    """One row: days, sessions summed over days, events, and whether acceptance improves or retries grow."""
    directions = trends(daily).groupBy().agg(F.max(F.when(F.col("metric") == "accept_rate", F.col("direction"))).alias("a"), F.max(F.when(F.col("metric") == "retry_rate", F.col("direction"))).alias("r"))
    totals = daily.agg(F.count("*").alias("days_analyzed"), F.sum("session_count").alias("total_sessions"), F.sum("event_count").alias("total_events"))
    health = F.when((F.col("a") == "increasing") & (F.col("r") != "increasing"), "improving").when((F.col("r") == "increasing") & (F.col("a") != "increasing"), "declining").otherwise("stable")
    return totals.crossJoin(directions).select("days_analyzed", "total_sessions", "total_events", health.alias("health_direction"))


def rolling_mean(daily: DataFrame, column: str, days: int = 7) -> DataFrame:
    order = Window.orderBy("day").rowsBetween(-(days - 1), 0)
    return daily.select("day", F.avg(column).over(order).alias("rolling"))


ROI_FEATURES = (
    "duration completion_count retry_count accept_count reject_count accept_rate retry_rate avg_read_before_ask avg_retry_distance tool_switch_frequency context_expansion_speed workflow_entropy retry_burst_score edit_after_accept_ratio workflow_length".split()
)


def context_roi(events: DataFrame, least: float = 0.1, top: int = 8) -> DataFrame:
    """Features whose correlation with the accept rate over sessions exceeds ``least``; 0 without variance, nothing for under two sessions.

    One aggregation takes the covariances and deviations of all features, merged from partial moments.
    """
    view = session_view(events).select([F.col(c).cast("double").alias(c) for c in ROI_FEATURES])
    rate = F.col("accept_rate")
    sums = view.agg(F.count("*").alias("sessions_n"), *[F.struct(F.covar_pop(F.col(c), rate).alias("xy"), (F.stddev_pop(c) * F.stddev_pop(rate)).alias("d")).alias(c) for c in ROI_FEATURES])
    rows = sums.where("sessions_n >= 2").select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), f"{c}.xy", f"{c}.d") for c in ROI_FEATURES])).alias("r")).select("r.*")
    found = rows.select("feature", ratio(F.col("xy"), F.col("d")).alias("contribution"))
    return found.where(F.abs("contribution") > least).orderBy(F.desc(F.abs("contribution")), "feature").limit(top)


def insight(events: DataFrame) -> DataFrame:
    """One row with the numbers of a report and the text of its template, without any model."""
    daily = daily_metrics(events)
    totals = events.agg(F.count("*").alias("events"), F.count_distinct("session_id").alias("sessions"))
    score = anomaly_score(transitions(events)).select("anomaly_score")
    row = totals.crossJoin(score).crossJoin(trend_summary(daily).select("health_direction"))
    text = F.format_string("%d sessions with %d events; workflow anomaly %.3f; health is %s.", "sessions", "events", "anomaly_score", "health_direction")
    return row.withColumn("insight", text)


def repeated_sequences(events: DataFrame, of: str = "tool", longest: int = 5) -> DataFrame:
    """(session_id, loops): how often two to ``longest`` events in a row are followed by the same again, over whole sessions.

    A run of n repeats at once where each of its events equals the one n later, so lead windows and a moving sum tell it, and no session is held as an array.
    """
    order = Window.partitionBy("session_id").orderBy("ts_ms", "id")
    rows = events.select("session_id", "ts_ms", "id", F.coalesce(of, F.lit("unknown")).alias("x"))
    rows = rows.select("*", *[(F.col("x") == F.lead("x", n).over(order)).cast("int").alias(f"same{n}") for n in range(2, longest + 1)])
    found = [F.coalesce((F.sum(f"same{n}").over(order.rowsBetween(0, n - 1)) == n).cast("int"), F.lit(0)) for n in range(2, longest + 1)]
    return rows.select("session_id", sum(found[1:], found[0]).alias("found")).groupBy("session_id").agg(F.sum("found").cast("int").alias("loops"))


def last_of(events: DataFrame, n: int, of: str = "tool") -> DataFrame:
    """(session_id, sequence): the last n values of each session, in order."""
    back = Window.partitionBy("session_id").orderBy(F.desc("ts_ms"), F.desc("id"))
    rows = events.select("session_id", "ts_ms", "id", of).withColumn("r", F.row_number().over(back)).where(F.col("r") <= n)
    got = rows.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("ts_ms", "id", of))).alias("s"))
    return got.select("session_id", F.transform("s", lambda x: x[of]).alias("sequence"))
