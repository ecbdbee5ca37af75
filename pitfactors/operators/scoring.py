"""Cross-sectional scores, ranks, selection and sizing.

Long panels ``(date, symbol, feature, value)``.  Ranks use ``functions.ranks``; moments are
aggregated per cross-section and joined back.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitfactors.functions import ranks
from pitfactors.functions.columns import by_symbol, ratio
from pitfactors.operators import asof

# ---------------------------------------------------------------- standardisation


def standardise(long: DataFrame, by: Sequence[str], method: str = "rank", value: str = "value", least: int = 2) -> DataFrame:
    """Add ``z`` per cross-section; groups under ``least`` names drop.

    ``rank``: centred average ranks over their population deviation.  ``z``: values clipped
    to the median plus or minus three scaled absolute deviations (else the 1st and 99th
    percentiles), then a population z-score.  A degenerate group scores zero.
    """
    by = list(by)
    ok = long.filter(F.col(value).isNotNull())
    strategy = ranks.plan(ok, by)
    if method == "rank":
        x = ranks.average(ok, by, value, "symbol", "_x", "_c", strategy=strategy).filter(F.col("_c") >= least).drop("_c")
    elif method == "z":
        x = _clipped(ok, by, value, least)
    else:
        raise ValueError(f"unknown method {method!r}")
    z = F.coalesce(ratio(F.col("_x") - F.col("_m"), F.col("_s")), F.lit(0.0))
    return ranks.moments(x, by, "_x", "_m", "_s", strategy=strategy).withColumn("z", z).drop("_x", "_m", "_s")


def _clipped(ok, by, value, least):
    size = ok.groupBy(*by).agg(F.count(F.lit(1)).alias("_c")).filter(F.col("_c") >= least).drop("_c")
    ok = ok.join(size, by, "left_semi")
    q = ranks.quantiles(ok, by, value, "symbol", {"_p01": 0.01, "_med": 0.5, "_p99": 0.99})
    j = ok.join(q, by).withColumn("_dev", F.abs(F.col(value) - F.col("_med")))
    mad = ranks.quantiles(j, by, "_dev", "symbol", {"_mad": 0.5})
    j = j.drop("_dev").join(mad, by)
    width = 3.0 * 1.4826 * F.col("_mad")
    lo = F.when(width > 0, F.col("_med") - width).otherwise(F.col("_p01"))
    hi = F.when(width > 0, F.col("_med") + width).otherwise(F.col("_p99"))
    return j.withColumn("_x", F.least(F.greatest(F.col(value), lo), hi)).drop("_p01", "_med", "_p99", "_mad")


# ---------------------------------------------------------------- composite score


@dataclass(frozen=True)
class Bucket:
    """Weighted group of factors; signs are +1 or -1."""

    name: str
    weight: float
    factors: Mapping[str, int] = field(default_factory=dict)


def composite(long: DataFrame, buckets: Sequence[Bucket], method: str = "rank", sectors: DataFrame | None = None, by: Sequence[str] = ("date",)) -> DataFrame:
    """Weighted score per symbol with its drill-down.

    A missing factor is skipped, a bucket without factors adds nothing and the weights are
    not rescaled, a symbol without any factor has no score.  With ``sectors`` the factors
    are standardised inside each sector (unknown sectors form one group).
    """
    by = list(by)
    total = sum(b.weight for b in buckets) or 1.0
    wanted = sorted({f for b in buckets for f in b.factors})
    ok = long.filter(F.col("feature").isin(wanted) & F.col("value").isNotNull() & ~F.isnan("value"))
    ok = ok.select(*by, "symbol", "feature", "value")
    groups = [*by, "feature"]
    if sectors is not None:
        ok = ok.join(sectors.select("symbol", "sector"), "symbol", "left").fillna("(none)", ["sector"])
        groups = [*groups, "sector"]
    z = standardise(ok, groups, method)
    places = F.create_map(*[
        x for f in wanted for x in (
            F.lit(f),
            F.array(*[F.struct(F.lit(i).alias("bucket"), F.lit(b.factors[f]).alias("sign")) for i, b in enumerate(buckets) if f in b.factors]),
        )
    ])
    placed = z.withColumn("_p", F.explode(places[F.col("feature")]))
    part = F.struct(F.col("feature").alias("factor"), F.col("value"), F.col("z"), F.col("_p.sign").alias("sign"))
    per_bucket = placed.groupBy(*by, "symbol", F.col("_p.bucket").alias("bucket")).agg(
        F.avg(F.col("z") * F.col("_p.sign")).alias("bucket_score"), F.array_sort(F.collect_list(part)).alias("factors"))
    weight = F.element_at(F.array(*[F.lit(b.weight / total) for b in buckets]), F.col("bucket") + 1)
    name = F.element_at(F.array(*[F.lit(b.name) for b in buckets]), F.col("bucket") + 1)
    detail = F.struct("bucket", name.alias("name"), weight.alias("weight"), F.col("bucket_score").alias("score"), "factors")
    return per_bucket.groupBy(*by, "symbol").agg(
        F.sum(weight * F.col("bucket_score")).alias("score"), F.array_sort(F.collect_list(detail)).alias("buckets"))


def rank_candidates(candidates: DataFrame, scores: DataFrame, descending: bool = True, by: Sequence[str] = ("date",)) -> DataFrame:
    """Candidates in score order, unscored ones last; only scored ones get a rank."""
    by = list(by)
    j = candidates.join(scores.select(*by, "symbol", "score"), [*by, "symbol"], "left")
    placed = ranks.ordinal(j, by, ["score", "symbol"], "position", "n_candidates", descending=descending)
    return placed.withColumn("rank", F.when(F.col("score").isNotNull(), F.col("position")))


def select_top(ranked: DataFrame, slots: int, top_n: int | None = None) -> DataFrame:
    """First ``min(slots, top_n)`` candidates of every date."""
    n = slots if top_n is None else min(slots, top_n)
    return ranked.filter(F.col("position") <= n)


def by_worst_signal(signals: DataFrame, slots: int, by: Sequence[str] = ("date",)) -> DataFrame:
    """Default priority: the most negative signal values first."""
    return ranks.ordinal(signals, by, ["priority", "symbol"], "position").filter(F.col("position") <= slots)


def leaderboard(ranked: DataFrame, by: Sequence[str] = ("date",), top: int = 20) -> DataFrame:
    """Ranking event per date: candidate count and the leading entries as an array.

    The array holds at most ``top`` entries: it is a report, the full ranking is the input.
    """
    entry = F.struct("position", "symbol", "score")
    head = F.array_sort(F.collect_list(F.when(F.col("position") <= top, entry)))
    return ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n_candidates"), F.count("score").alias("n_scored"), head.alias("leaders"))


def score_panel(scores: DataFrame, holdings: DataFrame, top_n: int) -> DataFrame:
    """Daily scores with rank, whether selected and whether held."""
    ranked = ranks.ordinal(scores.select("date", "symbol", "score"), ["date"], ["score", "symbol"], "rank", descending=True)
    held = holdings.select("date", "symbol").distinct().withColumn("held", F.lit(True))
    out = ranked.join(held, ["date", "symbol"], "left")
    return out.select("date", "symbol", "score", "rank", (F.col("rank") <= top_n).alias("selected"), F.coalesce("held", F.lit(False)).alias("held"))


# ---------------------------------------------------------------- sizing


def risk_parity(vols: DataFrame, by: Sequence[str] = ("date",)) -> DataFrame:
    """Weights in proportion to 1/volatility; a missing one counts as the date's median."""
    by = list(by)
    med = ranks.quantiles(vols.filter(F.col("vol") > 0), by, "vol", "symbol", {"_med": 0.5})
    j = vols.join(med, by, "left").withColumn("_iv", 1.0 / F.coalesce(F.when(F.col("vol") > 0, F.col("vol")), F.col("_med"), F.lit(1.0)))
    total = j.groupBy(*by).agg(F.sum("_iv").alias("_t"))
    return j.join(total, by).select(*by, "symbol", "vol", (F.col("_iv") / F.col("_t")).alias("weight"))


def equal_weight(members: DataFrame, by: Sequence[str] = ("date",)) -> DataFrame:
    n = members.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    return members.join(n, list(by)).select(*by, "symbol", (1.0 / F.col("_n")).alias("weight"))


def band_target(current: Column, target: Column, band: float) -> Column:
    """No trade inside the band, else trade to its near edge (relative to the target)."""
    low, high = target * (1 - band), target * (1 + band)
    return F.when(current < low, low).when(current > high, high).otherwise(current)


def rank_hysteresis(ranked: DataFrame, dates: Column, entry: int, leave: int) -> DataFrame:
    """Membership: in at ``rank <= entry``, out at ``rank > leave`` or without a rank.

    ``ranked`` is ``(symbol, date, rank)``, ``dates`` the sorted array of all dates.
    """
    grid = ranked.select("symbol").distinct().select("symbol", F.explode(dates).alias("date"))
    line = grid.join(ranked.select("symbol", "date", "rank"), ["symbol", "date"], "left")
    event = F.when(F.col("rank") <= entry, 1).when(F.col("rank").isNull() | (F.col("rank") > leave), 0)
    state = F.last(event, ignorenulls=True).over(by_symbol().rowsBetween(Window.unboundedPreceding, 0))
    return line.withColumn("member", F.coalesce(state, F.lit(0)) == 1)


def drift_orders(holdings: DataFrame, targets: DataFrame, value: str = "market_value", band: float = 0.0, by: Sequence[str] = ("book",)) -> DataFrame:
    """Orders that bring holdings to target weights; names inside the band stay.

    ``holdings`` is ``(book, symbol, market_value)``, ``targets`` ``(book, symbol, weight)``.
    """
    by = list(by)
    nav = holdings.groupBy(*by).agg(F.sum(value).alias("nav"))
    j = holdings.select(*by, "symbol", value).join(targets.select(*by, "symbol", "weight"), [*by, "symbol"], "full").join(nav, by)
    now = F.coalesce(F.col(value), F.lit(0.0))
    goal = F.coalesce("weight", F.lit(0.0)) * F.col("nav")
    dest = band_target(now, goal, band)
    out = j.select(*by, "symbol", now.alias("current_value"), goal.alias("target_value"), (dest - now).alias("delta"))
    return out.filter(F.abs("delta") > 1e-9).withColumn("side", F.when(F.col("delta") > 0, "BUY").otherwise("SELL"))


def trim_to_cap(holdings: DataFrame, cap: float, value: str = "market_value", by: Sequence[str] = ("book",)) -> DataFrame:
    """Sell orders for names above ``cap`` of the book."""
    by = list(by)
    nav = holdings.groupBy(*by).agg(F.sum(value).alias("nav"))
    over = F.col(value) - cap * F.col("nav")
    return holdings.join(nav, by).withColumn("trim", over).filter(F.col("trim") > 0).select(
        *by, "symbol", F.col(value).alias("current_value"), (F.col(value) / F.col("nav")).alias("weight"), "trim")


def subscription_orders(cash: DataFrame, targets: DataFrame, prices: DataFrame, fractional: bool = False) -> DataFrame:
    """Share orders that invest a cash amount at target weights.

    ``cash`` is ``(book, cash)``.  Names without a price are flagged, whole shares are
    floored, fractional ones rounded to six places; residual and drift come per book.
    """
    j = targets.join(cash, "book").join(prices.select("symbol", "price"), "symbol", "left")
    money = F.col("weight") * F.col("cash")
    raw = ratio(money, F.col("price"))
    shares = F.floor(raw * 1e6 + 0.5) / 1e6 if fractional else F.floor(raw).cast("double")
    lines = j.withColumns({"shares": shares, "skipped": F.coalesce(F.col("price") <= 0, F.lit(True)) | (shares <= 0)})
    lines = lines.withColumn("cost", F.when(F.col("skipped"), 0.0).otherwise(F.col("shares") * F.col("price")))
    spent = lines.groupBy("book").agg(F.sum("cost").alias("spent"))
    lines = lines.join(spent, "book")
    return lines.select(
        "book", "symbol", "weight", "price", "shares", "cost", "skipped", (F.col("cash") - F.col("spent")).alias("residual"),
        F.abs(ratio(F.col("cost"), F.col("cash")) - F.col("weight")).alias("drift"))


def rebalance_orders(positions: DataFrame, targets: DataFrame, aum: DataFrame, dust: float = 1.0) -> DataFrame:
    """Target weight times assets minus market value, without dust."""
    j = positions.select("book", "symbol", "market_value").join(targets.select("book", "symbol", "weight"), ["book", "symbol"], "full").join(aum, "book")
    delta = F.coalesce("weight", F.lit(0.0)) * F.col("aum") - F.coalesce("market_value", F.lit(0.0))
    return j.select("book", "symbol", F.when(delta > 0, "BUY").otherwise("SELL").alias("side"), F.abs(delta).alias("est_value")).filter(
        F.col("est_value") >= dust)


def earnings_directives(holdings: DataFrame, earnings: DataFrame, lookback_days: int = 5, add_pct: float = 0.25, trim_pct: float = 0.5) -> DataFrame:
    """Add to holdings after a beat, trim after a miss, for reports of the last days.

    ``holdings`` is ``(book, symbol, date, market_value)``.
    """
    e = earnings.filter(F.col("eps_actual").isNotNull() & F.col("eps_estimated").isNotNull()).select(
        "symbol", F.col("date").alias("report_date"), (F.col("eps_actual") > F.col("eps_estimated")).alias("beat"))
    days = holdings.select("symbol", "date").distinct()  # one lookup per symbol and day, however many books hold it
    seen = asof.backward(days, e, right_date="report_date", cols=["beat"], max_age_days=lookback_days)
    seen = seen.filter(F.col("beat").isNotNull()).withColumnRenamed("asof_date", "report_date")
    last = holdings.join(seen, ["symbol", "date"]).select("book", "symbol", "date", "market_value", "report_date", "beat")
    change = F.when(F.col("beat"), F.col("market_value") * add_pct).otherwise(-F.col("market_value") * trim_pct)
    return last.withColumns({"directive": F.when(F.col("beat"), "add").otherwise("trim"), "amount": change})


def metric_scores(metric: str, **tables: DataFrame) -> DataFrame:
    """``(date, symbol, score)`` of one ranking metric.

    ``pe_percentile`` needs ``pe`` and ``dates``-aligned bars, ``current_drop``, ``rsi`` and
    ``momentum_rank`` need ``bars``, a feature name needs ``panel``.
    """
    from pitfactors.operators import events, features

    if metric == "pe_percentile":
        held = asof.backward(tables["bars"].select("symbol", "date"), tables["pe"], cols=["pe"])
        out = held.filter((F.col("pe") > 0) & (F.col("pe") < 500)).withColumn("score", F.col("pe"))
    elif metric == "current_drop":
        w = by_symbol().rowsBetween(-62, 0)
        peak = F.max("close").over(w)
        b = tables["bars"].withColumns({"_p": peak, "_n": F.row_number().over(by_symbol())})
        out = b.filter((F.col("_n") >= 20) & (F.col("_p") > 0)).withColumn("score", (F.col("close") - F.col("_p")) / F.col("_p") * 100)
    elif metric == "rsi":
        out = features.rsi(tables["bars"]).withColumnRenamed("rsi", "score")
    elif metric == "momentum_rank":
        out = events.momentum_rank(tables["bars"]).withColumnRenamed("momentum_rank", "score")
    elif metric in ("revenue_growth_yoy", "margin_expanding"):
        w = Window.partitionBy("symbol").orderBy("date")
        prev = F.lag("revenue").over(w)
        margin = F.coalesce(ratio(F.col("net_income"), F.col("revenue")), F.lit(0.0))
        value = ratio(F.col("revenue") - prev, prev) if metric == "revenue_growth_yoy" else (margin - F.lag(margin).over(w)) * 100
        q = tables["income"].withColumn("score", value).filter(F.col("score").isNotNull())
        out = asof.backward(tables["bars"].select("symbol", "date"), q, cols=["score"]).filter(F.col("score").isNotNull())
    else:
        panel = tables["panel"].select("symbol", "date", F.col(metric).alias("score")).filter(F.col("score").isNotNull())
        out = asof.backward(tables["bars"].select("symbol", "date"), panel, cols=["score"], max_age_days=365)
        out = out.filter(F.col("score").isNotNull())
    return out.select("date", "symbol", "score")
