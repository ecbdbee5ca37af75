"""Feature library: quarterly facts, the point-in-time panel and the feature registry.

All per-symbol work runs on one shuffle.  Bars and every dated fact are unioned into one
timeline per symbol, facts are carried forward by windows over it, and the price windows
reuse the same partitioning.  A symbol's timeline is bounded by the calendar.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitfactors.functions.columns import between_dates, clip, full, half_up, keep, positive, rows
from pitfactors.operators import asof

YEAR_ROWS = 252
INCOME = ("revenue", "net_income", "ebitda", "gross_profit", "operating_income")
CASH = ("free_cash_flow", "dividends_paid", "operating_cf")


# ---------------------------------------------------------------- quarterly facts


def _quarters() -> Window:
    return Window.partitionBy("symbol").orderBy("available_from", "date")


def ttm(col: str) -> Column:
    """Sum of the last four visible quarters, NULL when one is missing."""
    return full(F.sum(col), _quarters().rowsBetween(-3, 0), 4, F.col(col))


def yoy_pct(col: str, back: int = 0) -> Column:
    """Percent change against four quarters earlier, seen ``back`` quarters ago."""
    now, then = F.lag(col, back).over(_quarters()), F.lag(col, back + 4).over(_quarters())
    return F.when(then != 0, (now - then) / F.abs(then) * 100.0)


def margin_delta(col: str) -> Column:
    w = _quarters()
    margin = lambda k: F.lag(col, k).over(w) / F.nullif(F.lag("revenue", k).over(w), F.lit(0.0)) * 100.0
    return margin(0) - margin(4)


def income_facts(income: DataFrame) -> DataFrame:
    """Per announced quarter: shares, trailing sums and year-on-year changes."""
    w = _quarters()
    shares, prior = F.col("shares_diluted"), F.lag("shares_diluted", 4).over(w)
    issued = F.when((shares != 0) & (prior > 0), (shares / prior - 1.0) * 100.0)
    out = income.select(
        "symbol", "available_from", "date", shares.alias("shares"),
        *[ttm(c).alias(f"ttm_{c}") for c in INCOME],
        yoy_pct("eps_diluted").alias("eps_yoy"),
        yoy_pct("revenue").alias("rev_yoy"),
        margin_delta("net_income").alias("net_margin_yoy_delta"),
        margin_delta("operating_income").alias("op_margin_yoy_delta"),
        (yoy_pct("revenue") - yoy_pct("revenue", 1)).alias("rev_yoy_accel"),
        (yoy_pct("eps_diluted") - yoy_pct("eps_diluted", 1)).alias("eps_yoy_accel"),
        F.when(issued.between(-100.0, 500.0), issued).alias("net_issuance"),
    )
    return _last_announced(out)


def balance_facts(balance: DataFrame) -> DataFrame:
    assets, prior = F.col("total_assets"), F.lag("total_assets", 4).over(_quarters())
    growth = F.when(prior > 0, (assets / prior - 1.0) * 100.0)
    return _last_announced(balance.select(
        "symbol", "available_from", "date", "total_equity", "total_debt", "net_debt", "total_assets",
        F.when(growth.between(-100.0, 1000.0), growth).alias("asset_growth"),
    ))


def cash_facts(cashflow: DataFrame) -> DataFrame:
    return _last_announced(cashflow.select(
        "symbol", "available_from", "date", *[ttm(c).alias(f"ttm_{c}") for c in CASH]
    ))


def surprise_facts(earnings: DataFrame, n: int = 8, least: int = 4) -> DataFrame:
    """Per report: standardised surprise over the last ``n`` reports."""
    known = earnings.filter(F.col("eps_actual").isNotNull() & F.col("eps_estimated").isNotNull())
    diff = F.col("eps_actual") - F.col("eps_estimated")
    w = Window.partitionBy("symbol").orderBy("date").rowsBetween(1 - n, 0)
    sd, seen = F.stddev_samp("diff").over(w), F.count("diff").over(w)
    score = F.when((seen >= least) & (sd > 0), clip(F.col("diff") / sd, -20.0, 20.0))
    return known.withColumn("diff", diff).select("symbol", "date", "diff", seen.alias("n_surprises"), score.alias("sue"))


def grade_counts(grades: DataFrame) -> DataFrame:
    """Net upgrades per symbol and day, summed map-side."""
    sign = F.when(F.col("action") == "upgrade", 1).when(F.col("action") == "downgrade", -1).otherwise(0)
    return grades.groupBy("symbol", "date").agg(F.sum(sign).alias("net"))


def _last_announced(df: DataFrame) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy("available_from", "date")
    return df.withColumn("_next", F.lead("available_from").over(w)).filter(
        F.col("_next").isNull() | (F.col("_next") > F.col("available_from"))
    ).drop("_next", "date")


# ---------------------------------------------------------------- the panel


def panel(
    bars: DataFrame,
    income: DataFrame,
    balance: DataFrame,
    cashflow: DataFrame,
    earnings: DataFrame,
    grades: DataFrame,
    features: Sequence[str] | None = None,
    fundamentals_only: bool = True,
) -> DataFrame:
    """``(symbol, date, <features>)`` for every bar that has visible fundamentals.

    Only the facts the chosen features read are joined.  Grouped features run on the bars of
    one symbol at a time, behind the windows and on the same shuffle.
    """
    chosen = [REGISTRY[f] for f in (features or materialised())]
    grouped = _functions(chosen)
    inputs = [i for g in grouped for i in g.inputs if i in REGISTRY]
    columns = {f.name: f for f in [*chosen, *(REGISTRY[i] for i in inputs)] if f.grouped is None}
    needs = {n for f in columns.values() for n in f.needs}
    if fundamentals_only:
        needs.add("income")
    parts = [_bar_rows(bars)]
    if needs & {"income", "balance", "cash"}:
        reports = earnings.select("symbol", "date")
        inc = income_facts(asof.available_from(income, reports))
        parts.append(_fact_rows(inc, "available_from", "income"))
        if "balance" in needs:
            parts.append(_fact_rows(balance_facts(asof.available_from(balance, reports)), "available_from", "balance"))
        if "cash" in needs:
            parts.append(_fact_rows(cash_facts(asof.available_from(cashflow, reports)), "available_from", "cash"))
    if "surprise" in needs:
        parts.append(_fact_rows(surprise_facts(earnings), "date", "surprise"))
    if "reports" in needs:
        parts.append(_fact_rows(earnings.select("symbol", "date", F.col("date").alias("report")).distinct(), "date", "reports"))
    if "grades" in needs:
        parts.append(_fact_rows(grade_counts(grades), "date", "grades"))
    line = parts[0]
    for p in parts[1:]:
        line = line.unionByName(p, allowMissingColumns=True)
    past = Window.partitionBy("symbol").orderBy("date", "side").rowsBetween(Window.unboundedPreceding, 0)
    carried = {k: F.last(k, ignorenulls=True).over(past) for k in sorted(needs & {"income", "balance", "cash", "surprise"})}
    if "reports" in needs:
        ahead = Window.partitionBy("symbol").orderBy(F.col("date").desc(), F.col("side").desc())
        ahead = ahead.rowsBetween(Window.unboundedPreceding, 0)
        carried["last_report"] = F.last("reports.report", ignorenulls=True).over(past)
        carried["next_report"] = F.last("reports.report", ignorenulls=True).over(ahead)
    if "grades" in needs:
        for n in (30, 90):
            span = Window.partitionBy("symbol").orderBy("day").rangeBetween(1 - n, 0)
            carried[f"net_{n}"] = F.coalesce(F.sum("grades.net").over(span), F.lit(0))
    line = line.withColumn("day", F.unix_date("date")).withColumns(carried)
    on_bars = line.filter(F.col("side") == 1).select(
        "symbol", "date", "bar.*", *carried
    )
    out = on_bars.withColumns({f"f_{f.name}": f.expr() for f in columns.values()})
    shown = (F.col("income.shares") > 0) & (F.col("close") > 0) if fundamentals_only else F.lit(True)
    if grouped:
        out = _run_grouped(out.withColumn("_shown", shown), grouped, list(columns))
        shown = F.col("_shown")
    return out.filter(shown).select("symbol", "date", *[F.col(f"f_{f.name}").cast("double").alias(f.name) for f in chosen])


def _functions(chosen: Sequence[Feature]) -> list[Grouped]:
    """Functions behind the chosen features and behind their inputs, in order of registration, which respects inputs."""
    found, todo = set(), [f.grouped for f in chosen if f.grouped is not None]
    while todo:
        g = todo.pop()
        found.add(g.name)
        todo += [REGISTRY[i].grouped for i in g.inputs if i in REGISTRY and REGISTRY[i].grouped is not None]
    return [g for g in GROUPED.values() if g.name in found]


def _run_grouped(bars: DataFrame, functions: Sequence[Grouped], columns: Sequence[str]) -> DataFrame:
    """Add the outputs of grouped functions; only what they read and what the panel returns goes through Python."""
    fields = [f for f in BAR_FIELDS if any(f in g.inputs for g in functions)]
    outputs = [o for g in functions for o in g.outputs]
    sent = bars.select("symbol", "date", F.coalesce("_shown", F.lit(False)).alias("_shown"), *fields, *[F.col(f"f_{c}").cast("double").alias(f"f_{c}") for c in columns])
    kept = [c for c in sent.columns if c not in fields]
    schema = ", ".join(f"`{n}` {t}" for n, t in sent.select(*kept).dtypes) + "".join(f", `f_{o}` double" for o in outputs)
    at = {**{f: f for f in BAR_FIELDS}, **{name: f"f_{name}" for name in REGISTRY}}

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("date")
        for g in functions:
            given = pa.table({"date": table.column("date"), **{i: table.column(at[i]) for i in g.inputs}})
            made = g.fn(given)
            if len(made) != len(table):
                raise ValueError(f"{g.name} returned {len(made)} rows for {len(table)}")
            for o in g.outputs:
                table = table.append_column(f"f_{o}", pa.chunked_array(made.column(o)).cast(pa.float64()))
        return table.select([*kept, *[f"f_{o}" for o in outputs]])

    return sent.groupBy("symbol").applyInArrow(run, schema)


def _bar_rows(bars):
    return bars.filter(F.col("close").isNotNull()).select(
        "symbol", "date", F.lit(1).alias("side"), F.struct("close", "volume").alias("bar"))


def _fact_rows(df, date, name):
    rest = [c for c in df.columns if c not in ("symbol", date)]
    return df.select("symbol", F.col(date).alias("date"), F.lit(0).alias("side"), F.struct(*rest).alias(name))


# ---------------------------------------------------------------- registry


@dataclass(frozen=True)
class Grouped:
    """A function over one symbol's history: a table of date and inputs in date order gives a table of outputs."""

    name: str
    fn: Callable[[pa.Table], pa.Table]
    inputs: tuple[str, ...]
    outputs: tuple[str, ...]


@dataclass(frozen=True)
class Feature:
    name: str
    expr: Callable[[], Column] | None
    needs: tuple[str, ...]
    category: str
    unit: str = "ratio"
    materialised: bool = True
    factor: bool = True
    grouped: Grouped | None = None


BAR_FIELDS = ("close", "volume")
REGISTRY: dict[str, Feature] = {}
GROUPED: dict[str, Grouped] = {}


def register(name: str, expr: Callable[[], Column], needs: Sequence[str] = (), category: str = "other", **kw) -> Feature:
    """Add a feature: a function that returns a Column over the panel's fields."""
    if name in REGISTRY:
        raise ValueError(f"feature {name} exists")
    REGISTRY[name] = Feature(name, expr, tuple(needs), category, **kw)
    return REGISTRY[name]


def register_grouped(name: str, fn: Callable[[pa.Table], pa.Table], inputs: Sequence[str] = ("close",), outputs: Mapping[str, Mapping] | Sequence[str] = (), category: str = "other", **kw) -> list[Feature]:
    """Add features that need a symbol's whole history in order, such as recursions.

    ``fn`` gets an Arrow table of ``date`` and ``inputs``, sorted by date, and returns one with
    a column for each of ``outputs`` (default: ``name``), row for row; a mapping gives an output its own unit
    or category.  Inputs are bar fields, features, or outputs of functions registered before,
    so the order of registration is the order of evaluation.  A symbol's history is bounded
    by the calendar and is the only thing a worker holds.
    """
    details = outputs if isinstance(outputs, Mapping) else {o: {} for o in (outputs or (name,))}
    unknown = [i for i in inputs if i not in BAR_FIELDS and i not in REGISTRY]
    taken = [o for o in details if o in REGISTRY or o in BAR_FIELDS]
    if name in GROUPED or taken:
        raise ValueError(f"feature {', '.join(taken) or name} exists")
    if unknown:
        raise ValueError(f"{name} reads {', '.join(unknown)}, which is neither a bar field nor a feature")
    GROUPED[name] = Grouped(name, fn, tuple(inputs), tuple(details))
    for o, own in details.items():
        REGISTRY[o] = Feature(o, None, (), **{"category": category, "materialised": False, **kw, **own}, grouped=GROUPED[name])
    return [REGISTRY[o] for o in details]


def materialised() -> list[str]:
    return [f.name for f in REGISTRY.values() if f.materialised]


def c(name: str) -> Column:
    return F.col(name)


def mcap() -> Column:
    return c("close") * c("income.shares")


def ev() -> Column:
    return mcap() + c("balance.net_debt")


def trailing_return(lookback: int, skip: int = 0) -> Column:
    w = Window.partitionBy("symbol").orderBy("date")
    then, now = F.lag("close", skip + lookback).over(w), F.lag("close", skip).over(w)
    return F.when(then > 0, (now / then - 1.0) * 100.0)


def realised_vol(n: int) -> Column:
    """Sample deviation of the last ``n`` returns; evaluated over a returns column."""
    w = Window.partitionBy("symbol").orderBy("date")
    prev = F.lag("close").over(w)
    ret = F.when(prev > 0, c("close") / prev - 1.0)
    return full(F.stddev_samp(ret), rows(n - 1), n, ret) * math.sqrt(YEAR_ROWS) * 100.0


def drawdown(n: int | None) -> Column:
    w = Window.partitionBy("symbol").orderBy("date")
    frame = w.rowsBetween(Window.unboundedPreceding if n is None else 1 - n, 0)
    peak = F.max("close").over(frame)
    return F.when(peak > 0, (c("close") - peak) / peak * 100.0)


def volume_z(n: int = 20) -> Column:
    w = rows(n, 1)
    v = c("volume").cast("double")
    sd = F.stddev_samp(v).over(w)
    return F.when((F.count(v).over(w) == n) & (sd > 0), (v - F.avg(v).over(w)) / sd)


def dollar_volume(n: int = 20) -> Column:
    traded = c("close") * c("volume")
    return full(F.avg(traded), rows(n, 1), n, traded)


def _over(num: Callable[[], Column], den: Callable[[], Column], scale: float = 1.0) -> Callable[[], Column]:
    return lambda: num() / positive(den()) * scale if scale != 1.0 else num() / positive(den())


def _col(name: str) -> Callable[[], Column]:
    return lambda: c(name)


def _register_all() -> None:
    ni, rev, ebitda = _col("income.ttm_net_income"), _col("income.ttm_revenue"), _col("income.ttm_ebitda")
    gp, oi = _col("income.ttm_gross_profit"), _col("income.ttm_operating_income")
    eq, debt, assets = _col("balance.total_equity"), _col("balance.total_debt"), _col("balance.total_assets")
    inc, bal = ("income",), ("income", "balance")
    cash = ("income", "cash")
    for name, num, den, scale, needs in [
        ("pe", mcap, ni, 1.0, inc), ("ps", mcap, rev, 1.0, inc), ("p_b", mcap, eq, 1.0, bal),
        ("ev_ebitda", ev, ebitda, 1.0, bal), ("ev_sales", ev, rev, 1.0, bal),
        ("earnings_yield", ni, mcap, 100.0, inc), ("book_to_price", eq, mcap, 100.0, bal),
        ("sales_to_price", rev, mcap, 100.0, inc), ("ebitda_to_ev", ebitda, ev, 100.0, bal),
        ("sales_to_ev", rev, ev, 100.0, bal),
    ]:
        register(name, _over(num, den, scale), needs, "value")
    register("fcf_yield", _over(_col("cash.ttm_free_cash_flow"), mcap, 100.0), cash, "yield")
    register("div_yield", _over(lambda: F.abs("cash.ttm_dividends_paid"), mcap, 100.0), cash, "yield")
    for name in ("eps_yoy", "rev_yoy"):
        register(name, _col(f"income.{name}"), inc, "growth", unit="pct")
    for name, num in (("net_margin", ni), ("op_margin", oi), ("gross_margin", gp)):
        register(name, _over(num, rev, 100.0), inc, "quality", unit="pct")
    for name in ("net_margin_yoy_delta", "op_margin_yoy_delta", "rev_yoy_accel", "eps_yoy_accel"):
        register(name, _col(f"income.{name}"), inc, "growth", unit="pp")
    register("roe", _over(ni, eq, 100.0), bal, "quality", unit="pct")
    invested = lambda: (
        F.greatest(F.coalesce(eq(), F.lit(0.0)), F.lit(0.0)) + F.greatest(F.coalesce(debt(), F.lit(0.0)), F.lit(0.0)))
    register("roic", _over(oi, invested, 100.0), bal, "quality", unit="pct")
    register("debt_to_equity", _over(debt, eq), bal, "quality")
    register("gross_profitability", lambda: keep(gp() / positive(assets()), -5.0, 10.0), bal, "quality")
    register("accruals", lambda: keep((ni() - c("cash.ttm_operating_cf")) / positive(assets()), -5.0, 5.0),
             ("income", "balance", "cash"), "quality")
    register("net_issuance", _col("income.net_issuance"), inc, "investment", unit="pct")
    register("asset_growth", _col("balance.asset_growth"), bal, "investment", unit="pct")
    register("sue", _col("surprise.sue"), ("surprise",), "sentiment")
    for name, n in (("ret_1m", 21), ("ret_3m", 63), ("ret_6m", 126), ("ret_12m", 252)):
        register(name, lambda n=n: trailing_return(n), (), "momentum", unit="pct")
    register("ret_12_1m", lambda: trailing_return(231, 21), (), "momentum", unit="pct")
    for n in (60, 252):
        register(f"realized_vol_{n}", lambda n=n: realised_vol(n), (), "risk", unit="pct")
    for n in (30, 90):
        register(f"analyst_net_upgrades_{n}d", _col(f"net_{n}"), ("grades",), "sentiment", unit="count")
    to_next = lambda: F.datediff("next_report", "date")
    register("days_to_next_earnings", to_next, ("reports",), "calendar", unit="days", factor=False)
    register("days_since_last_earnings", lambda: F.datediff("date", "last_report"), ("reports",), "calendar",
             unit="days", factor=False)
    register("pre_earnings_window_5d", lambda: F.when(to_next().isNotNull(), (to_next() <= 5).cast("int")),
             ("reports",), "calendar", unit="flag", factor=False)
    for name, n in (("drawdown_60d", 60), ("drawdown_252d", 252), ("drawdown_alltime", None)):
        register(name, lambda n=n: drawdown(n), (), "momentum", unit="pct", materialised=False)
    register("vol_z_20", volume_z, (), "volume", materialised=False)
    register("dollar_vol_20", dollar_volume, (), "volume", unit="dollars", materialised=False)


_register_all()


# ---------------------------------------------------------------- recursive smoothing


def smoothed(x: np.ndarray, period: int) -> np.ndarray:
    """Wilder averages of ``x``: the mean of the first ``period`` values, then ``a = a * r + x / period``; NaN before.

    Weighted running sums, block by block: a block is as long as its weights fit doubles.
    """
    if period == 1:
        return x.astype(float)
    out = np.full(len(x), np.nan)
    if len(x) < period:
        return out
    r = (period - 1) / period
    block = int(345 / -math.log(r))
    out[period - 1] = last = x[:period].mean()
    for first in range(period, len(x), block):
        part = x[first : first + block] / period
        grow = r ** -np.arange(1, len(part) + 1)
        out[first : first + block] = (last + np.cumsum(part * grow)) / grow
        last = out[min(first + block, len(x)) - 1]
    return out


def _rsi_of(period: int) -> Callable[[pa.Table], pa.Table]:
    def fn(table: pa.Table) -> pa.Table:
        close = table.column("close").to_numpy().astype(float)
        change = np.diff(close)
        up, down = smoothed(np.maximum(change, 0), period), smoothed(np.maximum(-change, 0), period)
        with np.errstate(divide="ignore", invalid="ignore"):
            value = np.where(down == 0, 100.0, 100 - 100 / (1 + up / down))
        value = np.concatenate([np.full(min(1, len(close)), np.nan), np.floor(value * 100.0 + 0.5) / 100.0])
        return pa.table({f"rsi_{period}": pa.array(value, from_pandas=True)})  # NaN is no value yet

    return fn


register_grouped("rsi_14", _rsi_of(14), ("close",), category="momentum", unit="index")


def wilder(df: DataFrame, cols: Sequence[str], period: int, step: str = "k") -> DataFrame:
    """Replace each column by its Wilder average; ``step`` counts the changes from 1.

    The recursion ``a = a * r + x / period`` is a weighted running sum.  Weights would
    overflow on long histories, so rows are grouped into blocks short enough for doubles
    and a block starts from the value the previous one ended with (older blocks have
    decayed below double precision by then).
    """
    r = (period - 1) / period
    block = int(345 / -math.log(r))
    k = F.col(step)
    by = Window.partitionBy("symbol").orderBy("date")
    seed_frame = by.rowsBetween(1 - period, 0)
    inside = Window.partitionBy("symbol", "_block").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("symbol").orderBy("_block").rangeBetween(-1, -1)
    out = df.withColumns({"_block": F.floor(k / block), "_off": k % block})
    for col in cols:
        part = F.when(k == period, F.avg(col).over(seed_frame)).when(k > period, F.col(col) / period)
        out = out.withColumn("_part", part)
        local = F.pow(F.lit(r), F.col("_off")) * F.sum(F.col("_part") * F.pow(F.lit(1 / r), F.col("_off"))).over(inside)
        out = out.withColumn("_local", local)
        carry = F.max_by("_local", step).over(before)
        value = F.col("_local") + F.coalesce(F.pow(F.lit(r), F.col("_off") + 1) * carry, F.lit(0.0))
        out = out.withColumn(col, F.when(k >= period, value))
    return out.drop("_block", "_off", "_part", "_local")


def rsi(bars: DataFrame, period: int = 14) -> DataFrame:
    """Wilder RSI on a symbol's own bars, rounded to two places."""
    by = Window.partitionBy("symbol").orderBy("date")
    change = F.col("close") - F.lag("close").over(by)
    moves = bars.select(
        "symbol", "date", (F.row_number().over(by) - 1).alias("k"),
        F.greatest(change, F.lit(0.0)).alias("up"), F.greatest(-change, F.lit(0.0)).alias("down"),
    )
    moves = moves.withColumns({
        "up": F.when(F.col("k") > 0, F.col("up")), "down": F.when(F.col("k") > 0, F.col("down"))})
    smooth = wilder(moves, ["up", "down"], period)
    value = F.when(F.col("down") == 0, F.lit(100.0)).otherwise(
        100 - 100 / (1 + F.col("up") / F.nullif(F.col("down"), F.lit(0.0))))
    return smooth.filter(F.col("k") >= period).select("symbol", "date", half_up(value, 2).alias("rsi"))


# ---------------------------------------------------------------- maintenance and access


def recent(panel_df: DataFrame, bars: DataFrame, days: int = 7) -> DataFrame:
    """Rows of the last ``days`` calendar days; the windows have seen full history."""
    last = bars.agg(F.max("date")).scalar()
    return panel_df.filter(F.col("date") >= F.date_sub(last, days))


def coverage(panel_df: DataFrame) -> DataFrame:
    """Non-null count per feature, one pass."""
    cols = [x for x in panel_df.columns if x not in ("symbol", "date")]
    counts = panel_df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(x).alias(x) for x in cols])
    pairs = F.array(*[F.struct(F.lit(x).alias("feature"), F.col(x).alias("non_null"), F.col("_rows").alias("rows")) for x in cols])
    return counts.select(F.inline(pairs))


def long_form(panel_df: DataFrame, features: Sequence[str]) -> DataFrame:
    """``(symbol, date, feature, value)`` without NULL values."""
    out = panel_df.unpivot(["symbol", "date"], list(features), "feature", "value")
    return out.filter(F.col("value").isNotNull())


def series(panel_df: DataFrame, feature: str, start=None, end=None, pad_days: int = 365) -> DataFrame:
    """One feature with a left pad, so that an as-of at ``start`` finds a value."""
    out = panel_df.select("symbol", "date", F.col(feature).alias("value")).filter(F.col("value").isNotNull())
    if start is not None:
        out = out.filter(F.col("date") >= F.date_sub(F.lit(start).cast("date"), pad_days))
    return between_dates(out, None, end)
