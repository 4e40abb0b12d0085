"""Registries of what users add: rules, measures, predictors, analyzers, vector providers."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass, field

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.operators import features, mining, realtime

Analyzer = Callable[[DataFrame], dict[str, DataFrame]]
Measure = Column | Callable[[dict], float]


@contextmanager
def lenient(spark: SparkSession):
    """Expressions that are made within give null where they would raise: a division by zero, a cast, an index."""
    name = "spark.sql.ansi.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def fault(states: DataFrame, *columns: Column) -> str | None:
    """Why these states do not allow the columns, or None."""
    try:
        states.select(*columns)
    except AnalysisException as e:
        return str(e).splitlines()[0]
    return None


def _called(functions: dict[str, Callable[[dict], float]]):
    kind = ", ".join(f"`{n}` struct<value: double, error: string>" for n in functions)

    @F.pandas_udf(kind)
    def call(states: pd.DataFrame) -> pd.DataFrame:
        rows = states.astype(object).where(states.notna(), None).to_dict("records")
        out = {}
        for name, function in functions.items():
            values = []
            for row in rows:
                try:
                    values.append({"value": float(function(row)), "error": None})
                except Exception as e:  # noqa: BLE001 what users add may raise anything
                    values.append({"value": float("nan"), "error": f"{type(e).__name__}: {e}"})
            out[name] = values
        return pd.DataFrame(out, columns=list(functions))

    return call


@dataclass
class Registry:
    """Named builders by kind; a name is taken once until it is given up."""

    rules: dict[str, realtime.Rule] = field(default_factory=dict)
    measures: dict[str, Measure] = field(default_factory=dict)
    analyzers: dict[str, Analyzer] = field(default_factory=dict)
    providers: dict[str, Callable[[DataFrame], DataFrame]] = field(default_factory=dict)

    def _add(self, kind: dict, name: str, what) -> None:
        if name in kind:
            raise ValueError(f"{name} is registered already")
        kind[name] = what

    def add_rule(self, rule: realtime.Rule) -> None:
        self._add(self.rules, rule.id, rule)

    def add_measure(self, name: str, measure: Measure) -> None:
        """A column over states, or a Python function of a state (a dict) that gives a number."""
        self._add(self.measures, name, measure)

    def add_analyzer(self, name: str, analyzer: Analyzer) -> None:
        self._add(self.analyzers, name, analyzer)

    def add_provider(self, name: str, provider: Callable[[DataFrame], DataFrame]) -> None:
        self._add(self.providers, name, provider)

    def remove(self, name: str) -> None:
        for kind in (self.rules, self.measures, self.analyzers, self.providers):
            kind.pop(name, None)

    def alerts(self, states: DataFrame) -> DataFrame:
        """Alerts of the rules that can be evaluated over these states; ``rule_errors`` has the others."""
        broken = self.rule_errors(states)
        with lenient(states.sparkSession):
            return realtime.alerts(states, [r for r in self.rules.values() if r.id not in broken])

    def rule_errors(self, states: DataFrame) -> dict[str, str]:
        """Rules that these states cannot be put to, and why."""
        found = {r.id: fault(states, r.fires, r.severity, r.message) for r in self.rules.values()}
        return {name: why for name, why in found.items() if why}

    def measured(self, states: DataFrame) -> DataFrame:
        """States with all registered measures, and ``errors``, an array of (measure, error).

        A measure that fails is NaN and does not touch the others: a column that these states do not allow is NaN in every row; division by zero, bad casts and the like give NaN in their row;
        what a Python function raises is the error of its row. Columns are one projection, and all Python functions one pass over Arrow batches.
        """
        columns = {n: m for n, m in self.measures.items() if isinstance(m, Column)}
        functions = {n: m for n, m in self.measures.items() if n not in columns}
        why = {n: fault(states, c) for n, c in columns.items()}
        nan = F.lit(float("nan"))
        with lenient(states.sparkSession):
            out = states.withColumns({n: nan if why[n] else F.coalesce(c.cast("double"), nan) for n, c in columns.items()})
        error = lambda name, text: F.struct(F.lit(name).alias("measure"), text.alias("error"))
        errors = [error(n, F.lit(w)) for n, w in why.items() if w]
        if functions:
            out = out.withColumn("__own", _called(functions)(F.struct(*states.columns)))
            out = out.withColumns({n: F.coalesce(F.col("__own")[n]["value"], nan) for n in functions})
            errors += [F.when(F.col("__own")[n]["error"].isNotNull(), error(n, F.col("__own")[n]["error"])) for n in functions]
        told = F.array_compact(F.array(*errors)) if errors else F.array().cast("array<struct<measure: string, error: string>>")
        return out.withColumn("errors", told).drop("__own")

    def analyze(self, events: DataFrame, errors: dict[str, str] | None = None) -> dict[str, DataFrame]:
        """What all analyzers make of the events, lazily, by analyzer and name; an analyzer that fails is left out and named in ``errors``."""
        out: dict[str, DataFrame] = {}
        for name, analyzer in self.analyzers.items():
            try:
                out |= {f"{name}.{part}": df for part, df in analyzer(events).items()}
            except Exception as e:  # noqa: BLE001 what users add may raise anything
                if errors is None:
                    raise
                errors[name] = str(e).splitlines()[0]
        return out


def core_registry() -> Registry:
    """The built-in rules and analyzers."""
    out = Registry()
    for rule in realtime.default_rules():
        out.add_rule(rule)
    out.add_analyzer("behavior", lambda e: {"transitions": mining.transitions(e), "starts": mining.start_distribution(e), "anomaly": mining.anomaly_score(mining.transitions(e))})
    out.add_analyzer("workflow", lambda e: {"edges": mining.directly_follows(e), "nodes": mining.workflow_nodes(e), "variants": mining.variants(e), "failures": mining.failure_patterns(e)})
    out.add_analyzer("trend", lambda e: {"daily": mining.daily_metrics(e), "trends": mining.trends(mining.daily_metrics(e)), "summary": mining.trend_summary(mining.daily_metrics(e))})
    out.add_analyzer("failure", lambda e: {"classes": features.failure_classes(e), "runs": features.failure_runs(e)})
    out.add_analyzer("roi", lambda e: {"contributions": mining.context_roi(e)})
    return out
