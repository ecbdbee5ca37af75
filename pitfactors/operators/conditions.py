"""Entry and exit conditions as daily signal sets.

A signal set is ``(symbol, date, value, meta)``: a number for ranking and a string map
with what was observed.  Conditions are declared as small dictionaries
(``{"type": "rsi", "operator": "<=", "value": 30}``).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitfactors.functions import ranks
from pitfactors.functions.columns import between_dates, compare, half_up, meta
from pitfactors.operators import asof, calendars, events, features, quarterly


@dataclass(frozen=True)
class Data:
    """Inputs a condition may read; leave out what the chosen conditions do not need."""

    bars: DataFrame
    income: DataFrame | None = None
    earnings: DataFrame | None = None
    grades: DataFrame | None = None
    profiles: DataFrame | None = None
    benchmark: DataFrame | None = None
    pe: DataFrame | None = None
    panel: DataFrame | None = None
    calendar: DataFrame | None = None

    def dates(self, start=None, end=None) -> Column:
        """Trading dates as one array: from ``calendar`` where given, else from the bars."""
        source = self.bars if self.calendar is None else self.calendar
        return calendars.date_array(between_dates(source.select("date"), start, end))


def signal(data: Data, cfg: Mapping, start=None, end=None) -> DataFrame:
    """Daily signal set of one condition."""
    if cfg["type"] not in CONDITIONS:
        raise ValueError(f"unknown condition {cfg['type']!r}")
    return between_dates(CONDITIONS[cfg["type"]](data, cfg, start, end), start, end)


def _out(df: DataFrame, value: Column | str, date: str = "date", **observed) -> DataFrame:
    v = F.col(value) if isinstance(value, str) else value
    return df.select("symbol", F.col(date).alias("date"), v.cast("double").alias("value"),
                     meta(**(observed or {"value": v})).alias("meta"))


def _seasoned(bars: DataFrame, least: int = 20) -> DataFrame:
    """Bars of symbols with enough history."""
    known = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    return bars.join(known.select("symbol"), "symbol", "left_semi")


def _current_drop(d, cfg, start, end):
    n = calendars.calendar_to_rows(cfg.get("window_days", 90))
    return _out(events.current_drops(_seasoned(d.bars), n, cfg.get("threshold", -15.0)), "drawdown_pct")


def _period_drop(d, cfg, start, end):
    n = calendars.calendar_to_rows(cfg.get("window_days", 90))
    return _out(events.period_drops(_seasoned(d.bars), n, cfg.get("threshold", -15.0)), "drawdown_pct", "signal_date")


def _daily_drop(d, cfg, start, end):
    return _out(events.daily_drops(_seasoned(d.bars), cfg.get("threshold", -5.0)), "change_pct")


def _selloff(d, cfg, start, end):
    bars = _seasoned(d.bars)
    found = events.selloffs(bars, cfg.get("threshold", -20.0), cfg.get("peak_window", "all_time"))
    spans = found.select("symbol", F.col("trigger_date").alias("date"), "current_date", "drawdown_pct")
    # Events of a symbol do not overlap, so the last trigger decides.
    held = asof.backward(bars.select("symbol", "date"), spans, cols=["current_date", "drawdown_pct"])
    return _out(held.filter(F.col("date") <= F.col("current_date")), "drawdown_pct")


def _hold(df: DataFrame, last: Column, end, value: str, **observed) -> DataFrame:
    """Repeat a signal on every calendar day up to ``last`` (and ``end``)."""
    stop = last if end is None else F.least(last, F.lit(end).cast("date"))
    df = df.withColumn("_stop", stop).filter(F.col("_stop") >= F.col("signal_date"))
    days = df.withColumn("day", F.explode(F.sequence("signal_date", "_stop")))
    return _out(days, value, "day", **observed)


def _earnings_momentum(d, cfg, start, end):
    k, least = cfg.get("lookback_quarters", 4), cfg.get("min_beats", 2)
    by = Window.partitionBy("symbol").orderBy("date")
    recent = by.rowsBetween(1 - k, 0)
    known = d.earnings.filter(F.col("eps_actual").isNotNull() & F.col("eps_estimated").isNotNull())
    beat = (F.col("eps_actual") > F.col("eps_estimated")).cast("int")
    surprise = F.when(F.col("eps_estimated") != 0,
                      (F.col("eps_actual") - F.col("eps_estimated")) / F.abs("eps_estimated") * 100)
    out = known.select(
        "symbol", F.col("date").alias("signal_date"), beat.alias("beat"), F.sum(beat).over(recent).alias("beats"),
        F.count(F.lit(1)).over(recent).alias("quarters"),
        F.coalesce(F.avg(surprise).over(recent), F.lit(0.0)).alias("avg_surprise"),
        F.lead("date").over(by).alias("next_date"),
    ).filter((F.col("quarters") >= min(2, k)) & (F.col("beats") >= least))
    if cfg.get("min_avg_surprise_pct") is not None:
        out = out.filter(F.col("avg_surprise") >= cfg["min_avg_surprise_pct"])
    if cfg.get("no_recent_miss", False):
        out = out.filter(F.col("beat") == 1)
    final = F.lit(end).cast("date") if end is not None else d.bars.agg(F.max("date")).scalar()
    last = F.coalesce(F.date_sub("next_date", 1), final)
    return _hold(out, last, end, "beats", beats=F.col("beats"), avg_surprise=half_up(F.col("avg_surprise"), 2),
                 no_recent_miss=F.col("beat"), quarters_analyzed=F.col("quarters"))


def _cheapest(snap: DataFrame, by: Sequence[str], percent: float, least: int = 3) -> DataFrame:
    """Lowest ``percent`` of each group with at least ``least`` names, at least one name."""
    ranked = ranks.ordinal(snap, by, ["v", "symbol"], "rn", "n")
    cut = F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(float(percent)) / 100))
    return ranked.filter((F.col("n") >= least) & (F.col("rn") <= cut))


def _as_of_values(d: Data, series: DataFrame, start, end) -> DataFrame:
    """``(symbol, date, v)`` on every trading date from each symbol's first value on."""
    dates = d.dates(start, end)
    grid = d.bars.select("symbol").distinct().select("symbol", F.explode(dates).alias("date"))
    held = asof.backward(grid, series.select("symbol", "date", F.col("value").alias("v")), cols=["v"])
    return held.filter(F.col("v").isNotNull()).drop("asof_date")


def _pe_percentile(d, cfg, start, end):
    snap = _as_of_values(d, d.pe.withColumnRenamed("pe", "value"), start, end)
    snap = snap.filter(F.col("v").between(cfg.get("min_pe", 0.0), cfg.get("max_pe", 500.0)))
    return _out(_cheapest(snap, ["date"], cfg.get("max_percentile", 30.0)), "v")


def _feature(d: Data, cfg) -> DataFrame:
    return d.panel.select("symbol", "date", F.col(cfg["feature"]).alias("value")).filter(F.col("value").isNotNull())


def _feature_threshold(d, cfg, start, end):
    return _out(_feature(d, cfg).filter(compare(F.col("value"), cfg.get("operator", ">="), cfg["value"])), "value")


def _feature_percentile(d, cfg, start, end):
    snap = _as_of_values(d, _feature(d, cfg), start, end)
    for bound, op in (("min_value", ">="), ("max_value", "<=")):
        if cfg.get(bound) is not None:
            snap = snap.filter(compare(F.col("v"), op, cfg[bound]))
    if cfg.get("scope", "universe") == "sector":
        sectors = d.profiles.select("symbol", F.coalesce("sector", F.lit("UNKNOWN")).alias("sector"))
        snap = snap.join(sectors, "symbol", "left").fillna("UNKNOWN", ["sector"])
        enough = snap.groupBy("date").agg(F.count(F.lit(1)).alias("k")).filter("k >= 3").select("date")
        return _out(_cheapest(snap.join(enough, "date"), ["date", "sector"], cfg.get("max_percentile", 30.0)), "v")
    return _out(_cheapest(snap, ["date"], cfg.get("max_percentile", 30.0)), "v")


def _quarterly(find):
    """Hold a quarterly signal until the day before the next signal, or 100 days."""

    def run(d, cfg, start, end):
        q = quarterly.year_on_year(quarterly.quarters(d.income, d.earnings))
        found, value, observed = find(q, cfg)
        found = between_dates(found, start, end, "signal_date")
        by = Window.partitionBy("symbol").orderBy("date")
        last = F.coalesce(F.date_sub(F.col("next_signal"), 1), F.date_add("signal_date", 100))
        found = found.withColumn("next_signal", F.lead("signal_date").over(by))
        return _hold(found, last, end, value, **{c: F.col(c) for c in observed})

    return run


_growth = _quarterly(lambda q, c: (
    quarterly.revenue_breakouts(q, c.get("threshold", 50.0)), "revenue_yoy", ("revenue_yoy", "revenue", "net_margin", "op_margin")))
_accelerating = _quarterly(lambda q, c: (
    quarterly.revenue_acceleration(q, c.get("min_quarters", 2)), "revenue_yoy", ("revenue_yoy", "prev_revenue_yoy", "streak")))
_expanding = _quarterly(lambda q, c: (
    quarterly.margin_expansion(q, c.get("metric", "net_margin"), c.get("min_quarters", 2)), "margin",
    ("margin", "margin_yoy_bps", "streak")))
_turnaround = _quarterly(lambda q, c: (
    quarterly.margin_turnaround(q, c.get("metric", "net_margin"), c.get("threshold_bps", 1000.0), c.get("min_quarters", 2)),
    "margin", ("margin", "margin_yoy_bps", "streak")))


def _relative(d, cfg, start, end):
    out = events.relative_outperformance(d.bars, d.benchmark, cfg.get("window_days", 126), cfg.get("threshold", 20.0))
    return _out(out, "own_return_pct", own_return_pct=F.col("own_return_pct"),
                bench_return_pct=F.col("bench_return_pct"), spread_pp=F.col("spread_pp"))


def _conviction(d, cfg, start, end):
    out = events.volume_conviction(d.bars, cfg.get("short_window", 60), cfg.get("long_window", 252), cfg.get("ratio", 0.8))
    return _out(out, "short_vol", short_vol=F.col("short_vol"), long_vol=F.col("long_vol"), ratio=F.col("ratio"))


def _indicator(make, column, default_op="<="):
    def run(d, cfg, start, end):
        out = make(d, cfg)
        return _out(out.filter(compare(F.col(column), cfg.get("operator", default_op), cfg.get("value", 0))), column,
                    **{column: F.col(column)})

    return run


_rsi = _indicator(lambda d, c: features.rsi(d.bars, c.get("period", 14)), "rsi")
_momentum = _indicator(lambda d, c: events.momentum_rank(d.bars, c.get("lookback", 63)), "momentum_rank")
_crossover = _indicator(lambda d, c: events.ma_crossover(d.bars, c.get("fast", 50), c.get("slow", 200)), "ma_signal")


def _capitulation(d, cfg, start, end):
    out = events.volume_capitulation(d.bars, cfg.get("window", 20), cfg.get("multiplier", 3.0))
    return _out(out, "volume_ratio", volume_ratio=F.col("volume_ratio"))


def _always(d, cfg, start, end):
    dates = d.dates(start, end)
    return _out(d.bars.select("symbol").distinct().select("symbol", F.explode(dates).alias("date")), F.lit(0.0))


def _days_to_earnings(d, cfg, start, end):
    dates = d.dates(start, end)
    reports = between_dates(d.earnings.select("symbol", "date"), start).distinct()
    grid = reports.select("symbol").distinct().select("symbol", F.explode(dates).alias("date"))
    ahead = asof.forward(grid, reports).withColumn("days", F.datediff("next_date", "date"))
    return _out(ahead.filter(F.col("days").between(cfg.get("min_days", 0), cfg.get("max_days", 7))), "days")


def _analyst_upgrades(d, cfg, start, end):
    """Net upgrades over ``[d - N, d]``: one day wider than the feature of that name."""
    n = cfg.get("window_days", 90)
    moves = d.grades.filter(F.col("action").isin("upgrade", "downgrade"))
    net = features.grade_counts(moves).withColumns({"on": F.lit(False)})
    dates = d.dates(start, end)
    grid = net.select("symbol").distinct().select("symbol", F.explode(dates).alias("date"))
    line = grid.withColumns({"net": F.lit(0).cast("long"), "on": F.lit(True)}).unionByName(net)
    span = Window.partitionBy("symbol").orderBy(F.unix_date("date")).rangeBetween(-n, 0)
    out = line.withColumn("total", F.sum("net").over(span)).filter("on")
    return _out(out.filter(F.col("total") >= cfg.get("min_net_upgrades", 2)), "total")


CONDITIONS = {
    "current_drop": _current_drop, "period_drop": _period_drop, "daily_drop": _daily_drop, "selloff": _selloff,
    "earnings_momentum": _earnings_momentum, "pe_percentile": _pe_percentile, "revenue_growth_yoy": _growth,
    "revenue_accelerating": _accelerating, "margin_expanding": _expanding, "margin_turnaround": _turnaround,
    "relative_performance": _relative, "volume_conviction": _conviction, "rsi": _rsi, "momentum_rank": _momentum,
    "ma_crossover": _crossover, "volume_capitulation": _capitulation, "always": _always,
    "feature_threshold": _feature_threshold, "feature_percentile": _feature_percentile,
    "days_to_earnings": _days_to_earnings, "analyst_upgrades": _analyst_upgrades,
}


def exit_signals(data: Data, conditions: Sequence[Mapping], start=None, end=None) -> DataFrame:
    """Fundamental exits, any condition; on one date the first listed condition wins."""
    q = quarterly.year_on_year(quarterly.quarters(data.income, data.earnings))
    parts = []
    for i, c in enumerate(conditions):
        metric, k = c.get("metric", "net_margin"), c.get("min_quarters", 2)
        if c["type"] == "revenue_deceleration":
            found = quarterly.revenue_deceleration(q, k, metric, c.get("require_margin_compression", True))
        elif c["type"] == "margin_collapse":
            found = quarterly.margin_collapse(q, metric, c.get("threshold_bps", -500.0), k)
        else:
            raise ValueError(f"unknown exit condition {c['type']!r}")
        parts.append(found.select("symbol", F.col("signal_date").alias("date"), F.lit(c["type"]).alias("reason"),
                                  "streak", "margin_yoy_bps", F.lit(i).alias("_order"), F.col("date").alias("quarter_end")))
    both = between_dates(reduce(DataFrame.unionByName, parts), start, end)
    first = F.min_by(F.struct("reason", "streak", "margin_yoy_bps", "quarter_end"), F.struct("_order", "quarter_end"))
    return both.groupBy("symbol", "date").agg(first.alias("b")).select("symbol", "date", "b.*")


# ---------------------------------------------------------------- combination


def _prefixed(df: DataFrame, i: int) -> DataFrame:
    keyed = F.transform_keys("meta", lambda k, _: F.concat(F.lit(f"condition_{i}_"), k))
    return df.select("symbol", "date", F.lit(i).alias("i"), F.col("value"), keyed.alias("meta"))


def combine(signals: Sequence[DataFrame], logic: str = "all") -> DataFrame:
    """Intersection (``all``) or union (``any``) of signal sets, metadata prefixed.

    One union and one aggregation by ``(symbol, date)``: the number of shuffles does not
    grow with the number of conditions.  The value is that of the first condition.
    """
    if logic not in ("all", "any"):
        raise ValueError(f"unknown logic {logic!r}")
    if len(signals) == 1:
        return signals[0]
    line = reduce(DataFrame.unionByName, [_prefixed(s, i) for i, s in enumerate(signals)])
    entries = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("i", F.map_entries("meta").alias("m")))), lambda x: x["m"]))
    both = line.groupBy("symbol", "date").agg(
        F.countDistinct("i").alias("n"), F.min_by("value", "i").alias("value"), F.map_from_entries(entries).alias("meta"))
    if logic == "all":
        both = both.filter(F.col("n") == len(signals))
    return both.drop("n")


def priority(signals: DataFrame, default: float = -25.0) -> DataFrame:
    """One number per signal for ranking; ``default`` where nothing numeric was observed."""
    return signals.select("symbol", "date", F.coalesce("value", F.lit(default)).alias("priority"))


def records(signals: Sequence[DataFrame], configs: Sequence[Mapping], logic: str = "all") -> DataFrame:
    """``array<struct(type, config, observed)>`` per signal, in condition order."""
    parts = []
    for i, (s, cfg) in enumerate(zip(signals, configs, strict=True)):
        config = {k: str(v) for k, v in cfg.items() if k != "type"}
        pairs = F.create_map(*[F.lit(x) for kv in config.items() for x in kv]) if config else F.create_map().cast("map<string,string>")
        rec = F.struct(F.lit(i).alias("i"), F.lit(cfg["type"]).alias("type"), pairs.alias("config"), F.map_entries("meta").alias("observed"))
        parts.append(s.select("symbol", "date", rec.alias("r")))
    line = reduce(DataFrame.unionByName, [p.withColumn("r", F.col("r").withField("config", F.map_entries("r.config"))) for p in parts])
    packed = F.transform(F.array_sort(F.collect_list("r")), lambda r: F.struct(
        r["type"].alias("type"), F.map_from_entries(r["config"]).alias("config"), F.map_from_entries(r["observed"]).alias("observed")))
    out = line.groupBy("symbol", "date").agg(packed.alias("records"))
    return out.filter(F.size("records") == len(signals)) if logic == "all" else out
