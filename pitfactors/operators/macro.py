"""Derived macro series; input and output are long ``(date, series, value)``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from pitfactors.functions.columns import full, ratio
from pitfactors.operators import asof


def by_series() -> WindowSpec:
    return Window.partitionBy("series").orderBy("date")


def pick(macro: DataFrame, series: str) -> DataFrame:
    return macro.filter(F.col("series") == series)


def _named(df: DataFrame, name: str, value) -> DataFrame:
    return df.select("date", F.lit(name).alias("series"), value.alias("value")).filter(F.col("value").isNotNull())


def moving_average(macro: DataFrame, source: str, window: int, name: str) -> DataFrame:
    """Mean of full windows that include today."""
    w = by_series().rowsBetween(1 - window, 0)
    return _named(pick(macro, source), name, full(F.avg("value"), w, window, F.col("value")))


def versus_average(macro: DataFrame, source: str, window: int, name: str) -> DataFrame:
    """Percent distance to the moving average."""
    ma = moving_average(macro, source, window, "ma")
    j = asof.aligned(pick(macro, source), ma)
    return _named(j, name, ratio(F.col("a") - F.col("b"), F.col("b")) * 100)


def year_on_year(macro: DataFrame, source: str, name: str) -> DataFrame:
    """Percent change to the same calendar date a year before; 29 February has none."""
    s = pick(macro, source)
    same = F.add_months("date", 12)
    prev = s.filter(~((F.month("date") == 2) & (F.dayofmonth("date") == 29))).select(same.alias("date"), F.col("value").alias("b"))
    prev = prev.filter(~((F.month("date") == 2) & (F.dayofmonth("date") == 29)))
    j = s.select("date", F.col("value").alias("a")).join(prev, "date")
    return _named(j, name, ratio(F.col("a") - F.col("b"), F.col("b")) * 100)


def change(macro: DataFrame, source: str, name: str) -> DataFrame:
    """Percent change to the previous observation."""
    prev = F.lag("value").over(by_series())
    return _named(pick(macro, source), name, ratio(F.col("value") - prev, prev) * 100)


def spread(macro: DataFrame, a: str, b: str, name: str) -> DataFrame:
    return _named(asof.aligned(pick(macro, a), pick(macro, b)), name, F.col("a") - F.col("b"))


def quotient(macro: DataFrame, a: str, b: str, name: str) -> DataFrame:
    return _named(asof.aligned(pick(macro, a), pick(macro, b)), name, ratio(F.col("a"), F.col("b")))


def zscore(macro: DataFrame, source: str, window: int, name: str) -> DataFrame:
    """Rolling z-score with the population deviation, today included."""
    w = by_series().rowsBetween(1 - window, 0)
    sd = F.stddev_pop("value").over(w)
    z = F.when(F.count("value").over(w) == window, ratio(F.col("value") - F.avg("value").over(w), sd))
    return _named(pick(macro, source), name, z)


def real_rate(macro: DataFrame, nominal: str, inflation: DataFrame, name: str) -> DataFrame:
    """Nominal value minus the inflation of its month."""
    j = asof.month_key_join(pick(macro, nominal).select("date", "value"), inflation)
    return _named(j, name, F.col("value") - F.col("monthly"))


BUILDERS = {"ma": moving_average, "vs_ma": versus_average, "yoy": year_on_year, "mom": change, "spread": spread, "ratio": quotient, "zscore": zscore}


def derive(macro: DataFrame, plan: Sequence[tuple]) -> DataFrame:
    """Union of derived series; a plan entry is ``(kind, *arguments, name)``."""
    return reduce(DataFrame.unionByName, [BUILDERS[kind](macro, *args) for kind, *args in plan])


def quality_issues(macro: DataFrame, expected: DataFrame, max_gap: int = 7, ranges: Mapping[str, tuple[float, float]] | None = None) -> DataFrame:
    """Missing series, gaps between observations, values out of range."""
    missing = expected.select("series").distinct().join(macro.select("series").distinct(), "series", "left_anti").select(
        F.lit("missing").alias("issue"), "series", F.lit(None).cast("date").alias("date"), F.lit(None).cast("double").alias("detail"))
    gap = F.datediff("date", F.lag("date").over(by_series()))
    gaps = macro.withColumn("gap", gap).filter(F.col("gap") > max_gap).select(F.lit("gap").alias("issue"), "series", "date", F.col("gap").cast("double").alias("detail"))
    out = missing.unionByName(gaps)
    for series, (low, high) in (ranges or {}).items():
        odd = pick(macro, series).filter((F.col("value") < low) | (F.col("value") > high))
        out = out.unionByName(odd.select(F.lit("range").alias("issue"), "series", "date", F.col("value").alias("detail")))
    return out
