"""Experiment and walk-forward metrics: aggregates, condition checks, best runs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitfactors.functions.columns import COMPARISONS

AGGREGATES = ("mean", "median", "min", "max", "p10", "p25", "stdev", "iqr", "range", "snr", "count")


def window_metrics(metrics: DataFrame, by: Sequence[str] = ("experiment", "metric")) -> DataFrame:
    """Summary of one metric over evaluation windows; ``metrics`` has a ``value`` per window."""
    v = "value"
    a = metrics.filter(F.col(v).isNotNull()).groupBy(*by).agg(
        F.avg(v).alias("mean"), F.percentile(v, 0.5).alias("median"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.percentile(v, 0.1).alias("p10"), F.percentile(v, 0.25).alias("p25"), F.percentile(v, 0.75).alias("_p75"),
        F.stddev_samp(v).alias("stdev"), F.count(v).alias("count"))
    many = F.col("count") >= 2
    return a.select(
        *by, "mean", "median", "min", "max", "p10", "p25", "stdev", F.when(many, F.col("_p75") - F.col("p25")).alias("iqr"),
        F.when(many, F.col("max") - F.col("min")).alias("range"),
        (F.col("mean") / F.greatest("stdev", F.lit(1e-6))).alias("snr"), "count")


def namespace(overall: DataFrame, windows: DataFrame) -> DataFrame:
    """``(experiment, name, value)``: bare metrics and ``<metric>.<aggregate>``."""
    agg = windows.select("experiment", "metric", *[F.col(a).cast("double") for a in AGGREGATES]).unpivot(
        ["experiment", "metric"], list(AGGREGATES), "agg", "value")
    agg = agg.select("experiment", F.concat_ws(".", "metric", "agg").alias("name"), "value")
    return overall.select("experiment", F.col("metric").alias("name"), "value").unionByName(agg).filter(F.col("value").isNotNull())


def check_conditions(names: DataFrame, conditions: Sequence[tuple[str, str, float]]) -> DataFrame:
    """Whether each experiment meets all conditions; a missing value does not meet one."""
    rows = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(n).alias("name"), F.lit(o).alias("op"), F.lit(float(v)).alias("target")) for i, (n, o, v) in enumerate(conditions)])
    grid = names.select("experiment").distinct().select("experiment", F.inline(rows))
    j = grid.join(names, ["experiment", "name"], "left")
    test = None
    for op, fn in COMPARISONS.items():
        hit = fn(F.col("value"), F.col("target"))
        test = F.when(F.col("op") == op, hit) if test is None else test.when(F.col("op") == op, hit)
    j = j.withColumn("met", F.coalesce(test, F.lit(False)))
    return j.groupBy("experiment").agg(F.every("met").alias("all_met"), F.count_if("met").alias("n_met"))


def higher_is_better(metric: str, aggregate: str = "overall", lower: Sequence[str] = ("max_drawdown_pct", "volatility")) -> bool:
    if aggregate in ("stdev", "iqr", "range"):
        return False
    return True if aggregate == "snr" else metric not in lower


def improvements(experiments: DataFrame, metric: str, aggregate: str = "overall") -> DataFrame:
    """Experiments in order with the best value so far and whether each improved on it."""
    w = Window.partitionBy("run").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    up = higher_is_better(metric, aggregate)
    best = (F.max if up else F.min)("value").over(w)
    better = (F.col("value") > F.col("best_before")) if up else (F.col("value") < F.col("best_before"))
    return experiments.withColumn("best_before", best).withColumn("improved", F.col("best_before").isNull() | better)


def best_per_run(experiments: DataFrame, metric: str, aggregate: str = "overall") -> DataFrame:
    """Best experiment of each run and the run's counts."""
    pick = F.max_by if higher_is_better(metric, aggregate) else F.min_by
    extreme = F.max if higher_is_better(metric, aggregate) else F.min
    return experiments.groupBy("run").agg(
        F.count(F.lit(1)).alias("n_experiments"), pick("experiment", F.struct("value", "experiment")).alias("best_experiment"),
        extreme("value").alias("best_value"))


def in_and_out(inside: DataFrame, outside: DataFrame) -> DataFrame:
    """In-sample and out-of-sample results of the same experiment."""
    return inside.select("experiment", F.col("value").alias("is_value")).join(outside.select("experiment", F.col("value").alias("oos_value")), "experiment")


def filtered(runs: DataFrame, at_least: Mapping[str, float] | None = None, at_most: Mapping[str, float] | None = None, sort: str = "value", limit: int = 50) -> DataFrame:
    """Search by metric thresholds, best first."""
    for c, v in (at_least or {}).items():
        runs = runs.filter(F.col(c) >= v)
    for c, v in (at_most or {}).items():
        runs = runs.filter(F.col(c) <= v)
    return runs.orderBy(F.desc(sort), "experiment").limit(limit)
