"""Signals from quarterly statements: growth and margin streaks, dated by announcement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitfactors.functions.columns import by_symbol, half_up, ratio
from pitfactors.operators import asof



def quarters(income: DataFrame, earnings: DataFrame) -> DataFrame:
    """Quarters with their announcement date; missing amounts count as zero."""
    q = asof.available_from(income.filter(F.col("period").startswith("Q")), earnings)
    amounts = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("revenue", "net_income", "operating_income")}
    return q.filter(F.col("available_from") >= F.col("date")).select(
        "symbol", "date", "fiscal_year", "period", F.col("available_from").alias("signal_date"),
        *[v.alias(k) for k, v in amounts.items()],
    )


def year_on_year(q: DataFrame) -> DataFrame:
    """Growth in percent, margins in percent, margin changes in basis points (rounded)."""
    j = asof.same_period_last_year(q, ["revenue", "net_income", "operating_income"])
    has = F.col("prior_revenue") > 0

    def margin(num, den):
        return F.coalesce(ratio(F.col(num), F.col(den)) * 100, F.lit(0.0))

    nm, om = margin("net_income", "revenue"), margin("operating_income", "revenue")
    return j.select(
        "symbol", "date", "period", "signal_date", "revenue",
        half_up(F.when(has, (ratio(F.col("revenue"), F.col("prior_revenue")) - 1) * 100), 2).alias("revenue_yoy"),
        half_up(nm, 2).alias("net_margin"), half_up(om, 2).alias("op_margin"),
        half_up(F.when(has, (nm - margin("prior_net_income", "prior_revenue")) * 100), 0).alias("net_margin_yoy_bps"),
        half_up(F.when(has, (om - margin("prior_operating_income", "prior_revenue")) * 100), 0).alias("op_margin_yoy_bps"),
    )


def with_streak(df: DataFrame, on: Column) -> DataFrame:
    """Length of the current run of quarters where ``on`` holds (islands between breaks)."""
    df = df.withColumn("_on", F.coalesce(on, F.lit(False)))
    df = df.withColumn("_island", F.sum((~F.col("_on")).cast("int")).over(by_symbol()))
    run = Window.partitionBy("symbol", "_island").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("streak", F.sum(F.col("_on").cast("int")).over(run))


def revenue_breakouts(yoy: DataFrame, threshold: float = 50.0) -> DataFrame:
    return yoy.filter(F.col("revenue_yoy") >= threshold).select(
        "symbol", "signal_date", "date", "period", "revenue_yoy", "revenue", "net_margin", "op_margin")


def revenue_acceleration(yoy: DataFrame, quarters_: int = 2) -> DataFrame:
    v = yoy.filter(F.col("revenue_yoy").isNotNull()).withColumn("prev_revenue_yoy", F.lag("revenue_yoy").over(by_symbol()))
    v = with_streak(v, F.col("revenue_yoy") > F.col("prev_revenue_yoy"))
    return v.filter(F.col("streak") >= quarters_).select(
        "symbol", "signal_date", "date", "period", "revenue_yoy", "prev_revenue_yoy", "streak")


def _margin_rows(yoy, metric):
    return yoy.filter(F.col(f"{metric}_yoy_bps").isNotNull()).withColumns(
        {"margin": F.col(metric), "margin_yoy_bps": F.col(f"{metric}_yoy_bps")})


def _margin_out(v, least):
    return v.filter(F.col("streak") >= least).select(
        "symbol", "signal_date", "date", "period", "margin", "margin_yoy_bps", "streak")


def margin_expansion(yoy: DataFrame, metric: str = "net_margin", quarters_: int = 2) -> DataFrame:
    v = _margin_rows(yoy, metric)
    on = (F.col("margin_yoy_bps") > 0) & (F.col("margin") > F.lag("margin").over(by_symbol()))
    return _margin_out(with_streak(v, on), quarters_)


def margin_turnaround(yoy: DataFrame, metric: str = "net_margin", threshold_bps: float = 1000.0, quarters_: int = 2) -> DataFrame:
    return _margin_out(with_streak(_margin_rows(yoy, metric), F.col("margin_yoy_bps") >= threshold_bps), quarters_)


def margin_collapse(yoy: DataFrame, metric: str = "net_margin", threshold_bps: float = -500.0, quarters_: int = 2) -> DataFrame:
    return _margin_out(with_streak(_margin_rows(yoy, metric), F.col("margin_yoy_bps") <= threshold_bps), quarters_)


def revenue_deceleration(yoy: DataFrame, quarters_: int = 2, metric: str = "net_margin", need_compression: bool = True) -> DataFrame:
    v = yoy.filter(F.col("revenue_yoy").isNotNull()).withColumns(
        {"prev_revenue_yoy": F.lag("revenue_yoy").over(by_symbol()), "margin_yoy_bps": F.col(f"{metric}_yoy_bps")})
    v = with_streak(v, F.col("revenue_yoy") < F.col("prev_revenue_yoy"))
    run = Window.partitionBy("symbol", "_island").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    squeezed = F.coalesce(F.col("_on") & (F.col("margin_yoy_bps") < 0), F.lit(False))
    v = v.withColumn("squeezed", F.max(squeezed).over(run)).filter(F.col("streak") >= quarters_)
    if need_compression:
        v = v.filter("squeezed")
    return v.select("symbol", "signal_date", "date", "period", "revenue_yoy", "prev_revenue_yoy", "margin_yoy_bps", "streak")
