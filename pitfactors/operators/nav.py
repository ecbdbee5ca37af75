"""Return, risk and benchmark analytics of NAV series ``(series_id, date, nav, …)``."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from pitfactors.functions.columns import between_dates, ratio
from pitfactors.operators import asof

YEAR = 252
MIN_ROWS = 60


def by_series() -> WindowSpec:
    return Window.partitionBy("series_id").orderBy("date")


def so_far() -> WindowSpec:
    return by_series().rowsBetween(Window.unboundedPreceding, 0)


def daily_returns(nav: DataFrame) -> DataFrame:
    """Return against the previous point of the series."""
    prev = F.lag("nav").over(by_series())
    return nav.withColumn("ret", F.when(prev > 0, F.col("nav") / prev - 1))


def total_return(nav: DataFrame) -> DataFrame:
    """Total and annualised return; no annual figure under 60 points."""
    a = nav.groupBy("series_id").agg(F.count("nav").alias("n_nav"), F.min_by("nav", "date").alias("first"), F.max_by("nav", "date").alias("last"))
    growth = F.col("last") / F.col("first")
    return a.select("series_id", "n_nav", ((growth - 1) * 100).alias("total_return_pct"), _annual(growth, F.col("n_nav")).alias("ann_return_pct"))


def _annual(growth: Column, n_nav: Column) -> Column:
    return F.when((n_nav >= MIN_ROWS) & (growth > 0), (F.pow(growth, F.lit(float(YEAR)) / n_nav) - 1) * 100)


def max_drawdown(nav: DataFrame) -> DataFrame:
    """Deepest fall from a running peak and its date."""
    peak = F.max("nav").over(so_far())
    dd = nav.withColumn("dd", F.when(peak > 0, (F.col("nav") - peak) / peak * 100))
    return dd.groupBy("series_id").agg(F.min("dd").alias("max_drawdown_pct"), F.min_by("date", F.struct("dd", "date")).alias("max_drawdown_date"))


def return_stats(returns: DataFrame, risk_free_pct: float | Column = 0.0, by: Sequence[str] = ("series_id",)) -> DataFrame:
    """Volatility, Sharpe (period basis under a year) and Sortino from daily returns.

    One aggregation; growth is compounded as a sum of logs, and is 0 after a total loss.
    """
    rf = F.lit(float(risk_free_pct)) if not isinstance(risk_free_pct, Column) else risk_free_pct
    short = F.least(F.col("ret") - rf / 100 / YEAR, F.lit(0.0))
    a = returns.filter(F.col("ret").isNotNull()).groupBy(*by).agg(
        F.count("ret").alias("n"), F.when(F.min("ret") > -1, F.sum(F.log1p("ret"))).alias("log"), F.coalesce(F.stddev_samp("ret"), F.lit(0.0)).alias("sd"),
        F.sqrt(F.avg(short * short)).alias("down"))
    n_nav = F.col("n") + 1
    annual = F.when(n_nav >= MIN_ROWS, F.expm1(F.col("log") * float(YEAR) / n_nav) * 100)  # from logs: growth itself may overflow
    total = F.when(F.col("log").isNull(), -100.0).otherwise(F.expm1("log") * 100)
    vol = F.col("sd") * math.sqrt(YEAR) * 100
    ok = annual.isNotNull()
    sharpe_ann = F.when(ok, F.coalesce(ratio(annual - rf, vol), F.lit(0.0)))
    period = F.coalesce(ratio(total - rf * F.col("n") / YEAR, F.col("sd") * F.sqrt(F.col("n")) * 100), F.lit(0.0))
    sharpe_period = F.when(ok, period)
    basis = F.when(ok, F.when(n_nav < YEAR, "period").otherwise("annualized"))
    sortino = F.coalesce(ratio(annual - rf, F.col("down") * math.sqrt(YEAR) * 100), F.lit(0.0))
    return a.select(
        *by, n_nav.alias("n_nav"), total.alias("total_return_pct"), annual.alias("ann_return_pct"), F.when(ok, vol).alias("ann_vol_pct"),
        F.when(n_nav < YEAR, sharpe_period).otherwise(sharpe_ann).alias("sharpe"), sharpe_ann.alias("sharpe_annualized"),
        sharpe_period.alias("sharpe_period"), basis.alias("sharpe_basis"), F.when(ok, sortino).alias("sortino"))


def average_rate(rates: DataFrame, start, end, value: str = "value") -> DataFrame:
    """Mean risk-free rate over the window, zero when there is none."""
    return between_dates(rates, start, end).agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("risk_free_pct"))


def calmar(nav: DataFrame) -> DataFrame:
    t = total_return(nav).join(max_drawdown(nav), "series_id")
    return t.select("series_id", "ann_return_pct", "max_drawdown_pct", ratio(F.col("ann_return_pct"), F.abs("max_drawdown_pct")).alias("calmar"))


def utilisation(nav: DataFrame) -> DataFrame:
    """Average share of capital invested and the return on that capital."""
    a = nav.groupBy("series_id").agg(
        (F.avg(ratio(F.col("positions_value"), F.col("nav"))) * 100).alias("utilisation_pct"),
        ((F.max_by("nav", "date") / F.min_by("nav", "date") - 1) * 100).alias("total_return_pct"))
    return a.withColumn("return_on_utilised_pct", ratio(F.col("total_return_pct"), F.col("utilisation_pct") / 100))


def trade_metrics(trades: DataFrame, by: Sequence[str] = ("book",), skip_end: bool = True) -> DataFrame:
    """Win rate, averages and profit factor of closed trades.

    ``skip_end`` leaves out positions closed only because the test ended and reports
    999.99 without losses; otherwise every closed trade counts and losses are at least 0.01.
    """
    closed = trades.filter((F.col("action") == "SELL") & F.col("pnl_units").isNotNull())
    if skip_end:
        closed = closed.filter(F.col("reason") != "backtest_end")
    win, loss = F.col("pnl_units") > 0, F.col("pnl_units") <= 0
    unit = F.lit(10000.0)
    a = closed.groupBy(*by).agg(
        F.count(F.lit(1)).alias("closed"), F.count_if(win).alias("wins"), F.count_if(loss).alias("losses"),
        (F.coalesce(F.sum(F.when(win, F.col("pnl_units"))), F.lit(0)) / unit).alias("gross_profit"),
        (F.abs(F.coalesce(F.sum(F.when(loss, F.col("pnl_units"))), F.lit(0))) / unit).alias("gross_loss"),
        F.avg(F.when(win, F.col("pnl_pct"))).alias("avg_win_pct"), F.avg(F.when(loss, F.col("pnl_pct"))).alias("avg_loss_pct"),
        F.avg(F.col("days_held").cast("double")).alias("avg_days"))
    if skip_end:
        factor = F.when(F.col("gross_loss") > 0, F.least(F.col("gross_profit") / F.nullif("gross_loss", F.lit(0.0)), F.lit(999.99))).otherwise(999.99)
    else:
        factor = F.col("gross_profit") / F.greatest("gross_loss", F.lit(0.01))
    return a.withColumns({"win_rate_pct": F.col("wins") / F.col("closed") * 100, "profit_factor": factor})


def exit_reasons(trades: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    sold = trades.filter(F.col("action") == "SELL")
    return sold.groupBy(*by, "reason").agg(F.count(F.lit(1)).alias("n"), (F.sum("pnl_units") / F.lit(10000.0)).alias("pnl"), F.avg("pnl_pct").alias("avg_pnl_pct"))


# ---------------------------------------------------------------- benchmarks


def buy_and_hold(bars: DataFrame, capital: float = 100.0) -> DataFrame:
    """NAV of each symbol held from its first close."""
    first = bars.groupBy("symbol").agg(F.min_by("close", "date").alias("first"))
    return bars.join(first, "symbol").select(F.col("symbol").alias("series_id"), "date", (F.col("close") / F.col("first") * capital).alias("nav"))


def first_available(bars: DataFrame, candidates: Sequence[str], capital: float = 100.0) -> DataFrame:
    """Benchmark NAV of the first candidate that has bars."""
    order = F.array_position(F.array(*[F.lit(c) for c in candidates]), F.col("symbol"))
    found = bars.filter(F.col("symbol").isin(list(candidates)))
    chosen = found.select("symbol").distinct().agg(F.min_by("symbol", order)).scalar()
    return buy_and_hold(found.filter(F.col("symbol") == chosen), capital)


def blended_benchmark(bars: DataFrame, weights: DataFrame, name: str = "blend", capital: float = 100.0) -> DataFrame:
    """Weighted mix of rebased series on the dates all of them have.

    ``weights`` is ``(symbol, weight)`` and may be unscaled.
    """
    k = weights.agg(F.count(F.lit(1))).scalar()
    total = weights.agg(F.sum("weight")).scalar()
    j = bars.select("symbol", "date", "close").join(weights, "symbol")
    common = j.groupBy("date").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") == k).select("date")
    on = j.join(common, "date", "left_semi")
    base = on.groupBy("symbol").agg(F.min_by("close", "date").alias("base"))
    out = on.join(base, "symbol").groupBy("date").agg((F.sum(F.col("weight") / total * F.col("close") / F.col("base")) * capital).alias("nav"))
    return out.select(F.lit(name).alias("series_id"), "date", "nav")


def cap_weights(profiles: DataFrame) -> DataFrame:
    """Sector weights by market cap."""
    total = profiles.agg(F.sum("market_cap")).scalar()
    return profiles.groupBy("sector").agg((F.sum("market_cap") / total).alias("weight"))


def benchmark_returns(calendar: DataFrame, bars: DataFrame) -> DataFrame:
    """Daily returns on a calendar; a missing pair of consecutive closes counts as zero."""
    w = Window.orderBy("date")
    j = calendar.select("date").distinct().join(bars.select("date", "close"), "date", "left")
    prev = F.lag("close").over(w)
    out = j.select("date", F.row_number().over(w).alias("_i"), F.coalesce(F.when(prev > 0, F.col("close") / prev - 1), F.lit(0.0)).alias("bench_ret"))
    return out.filter("_i > 1").drop("_i")


def relative_stats(returns: DataFrame, benchmark: DataFrame, least: int = 20) -> DataFrame:
    """Beta, tracking error, volatility ratio, information ratio and annual alphas on common dates."""
    j = returns.filter(F.col("ret").isNotNull()).join(benchmark.select("date", "bench_ret"), "date").filter(F.col("bench_ret").isNotNull())
    diff = F.col("ret") - F.col("bench_ret")
    a = j.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n"), F.covar_samp("ret", "bench_ret").alias("cov"), F.var_samp("bench_ret").alias("vb"),
        F.stddev_samp("ret").alias("s"), F.stddev_samp("bench_ret").alias("sb"), F.stddev_samp(diff).alias("te"), F.avg(diff).alias("active"),
        F.avg("ret").alias("mr"), F.avg("bench_ret").alias("mb")).filter(F.col("n") >= least)
    beta = ratio(F.col("cov"), F.col("vb"))
    return a.select(
        "series_id", "n", beta.alias("beta"), (F.col("te") * math.sqrt(YEAR) * 100).alias("tracking_error_pct"),
        ratio(F.col("s"), F.col("sb")).alias("vol_ratio"), (F.col("active") * YEAR * 100).alias("alpha_pct"),
        ratio(F.col("active") * math.sqrt(YEAR), F.col("te")).alias("information_ratio"),
        ((F.col("mr") - beta * F.col("mb")) * YEAR * 100).alias("beta_adjusted_alpha_pct"))


def pnl_with_benchmark(nav: DataFrame, bench: DataFrame) -> DataFrame:
    """Daily P&L beside the benchmark's latest earlier-or-equal level, both rebased to 100."""
    prev = F.lag("nav").over(by_series())
    base = F.first("nav").over(so_far())
    p = nav.select("series_id", "date", "nav", (F.col("nav") - prev).alias("pnl"), ((F.col("nav") / prev - 1) * 100).alias("pnl_pct"), (F.col("nav") / base * 100).alias("rebased"))
    b = nav.select("series_id").distinct()
    bench = bench.select("date", F.col("nav").alias("bench"))
    dates = p.select("date").distinct().withColumn("_k", F.lit(1))
    held = asof.backward(dates, bench.withColumn("_k", F.lit(1)), on="_k", cols=["bench"]).select("date", "bench")
    del b
    return p.join(held, "date", "left")


def rolling_vol(nav: DataFrame, points: int = 30) -> DataFrame:
    """Annual volatility of the last ``points`` values (population deviation)."""
    w = by_series().rowsBetween(2 - points, 0)
    r = daily_returns(nav)
    return r.select("series_id", "date", F.when(F.count("ret").over(w) == points - 1, F.stddev_pop("ret").over(w) * math.sqrt(YEAR) * 100).alias("rolling_vol_pct"))


# ---------------------------------------------------------------- calendars of returns


def monthly_returns(nav: DataFrame) -> DataFrame:
    """Month-end against the prior month-end; the first month against its first point."""
    m = nav.groupBy("series_id", F.trunc("date", "month").alias("month")).agg(F.min_by("nav", "date").alias("first"), F.max_by("nav", "date").alias("last"))
    w = Window.partitionBy("series_id").orderBy("month")
    base = F.coalesce(F.lag("last").over(w), F.col("first"))
    return m.select("series_id", "month", ((F.col("last") / base - 1) * 100).alias("ret_pct"))


def within_period(nav: DataFrame, unit: str = "month") -> DataFrame:
    """Last over first inside each month or year."""
    g = nav.groupBy("series_id", F.trunc("date", unit).alias("period"))
    return g.agg(((F.max_by("nav", "date") / F.min_by("nav", "date") - 1) * 100).alias("ret_pct"))


def month_grid(nav: DataFrame) -> DataFrame:
    """Year by month table of within-month returns."""
    p = within_period(nav, "month")
    cells = [F.max(F.when(F.month("period") == m, F.col("ret_pct"))).alias(f"m{m:02d}") for m in range(1, 13)]
    return p.groupBy("series_id", F.year("period").alias("year")).agg(*cells)


def latest_month(nav: DataFrame) -> DataFrame:
    """Return of the last month that is over."""
    end = nav.groupBy("series_id").agg(F.trunc(F.max("date"), "month").alias("open_month"))
    m = monthly_returns(nav).join(end, "series_id").filter(F.col("month") < F.col("open_month"))
    return m.groupBy("series_id").agg(F.max("month").alias("month"), F.max_by("ret_pct", "month").alias("ret_pct"))


def rebased(nav: DataFrame, start, level: float = 100.0) -> DataFrame:
    """Series scaled to ``level`` at its first date on or after ``start``."""
    inside = between_dates(nav, start)
    first = inside.groupBy("series_id").agg(F.min_by("nav", "date").alias("first"))
    return inside.join(first, "series_id").select("series_id", "date", (F.col("nav") / F.col("first") * level).alias("nav"))


def histogram(df: DataFrame, value: str, bins: int = 40) -> DataFrame:
    """Counts in equal bins between the extremes, one pass for the range and one to count."""
    span = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    lo, hi = span.select("lo").scalar(), span.select("hi").scalar()
    x = F.col(value)
    spot = F.when(hi > lo, F.least(F.floor((x - lo) / (hi - lo) * bins), F.lit(bins - 1))).otherwise(0).cast("int")
    return df.filter(x.isNotNull()).withColumn("bin", spot).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def sleeve_contribution(sleeves: DataFrame, capital: float) -> DataFrame:
    """Contribution of each sleeve: allocation times return over the initial capital."""
    return sleeves.withColumn("contribution_pct", F.col("allocated") * F.col("return_pct") / F.lit(float(capital)))
