"""Factor evaluation: forward returns, rank correlations, quantile spreads, combination.

Cross-sections are groups of one date (and feature, horizon, universe).  Ranks come from
``functions.ranks``, which cuts a group that is too big for one task; moments are plain
aggregations joined back, so no row moves for them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitfactors.functions import ranks, scale
from pitfactors.functions.columns import between_dates, by_symbol, names, ratio
from pitfactors.operators import asof, calendars, nav


def correlation(a: str | Column, b: str | Column) -> Column:
    """Pearson correlation aggregate, NULL without variance on either side."""
    return ratio(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def rank_correlation(a: str, b: str) -> Column:
    """Correlation of ranks from plain sums: half-integers add exactly, so a zero is zero."""
    x, y, n = F.col(a), F.col(b), F.count(F.lit(1)).cast("double")
    xy = n * F.sum(x * y) - F.sum(x) * F.sum(y)
    xx = n * F.sum(x * x) - F.sum(x) * F.sum(x)
    yy = n * F.sum(y * y) - F.sum(y) * F.sum(y)
    return ratio(xy, F.sqrt(xx) * F.sqrt(yy))


# ---------------------------------------------------------------- labels


def forward_returns(bars: DataFrame, horizon: int, name: str = "fwd") -> DataFrame:
    """Return over the next ``horizon`` bars of the symbol itself."""
    priced = bars.filter(F.col("close") > 0)
    return priced.select("symbol", "date", (F.lead("close", horizon).over(by_symbol()) / F.col("close") - 1).alias(name)).filter(
        F.col(name).isNotNull())


def forward_prices(bars: DataFrame, horizons: Sequence[int], dates: DataFrame | None = None) -> DataFrame:
    """Close ``h`` rows ahead on the union calendar, from ``dates`` (default: all).

    The calendar position is the window's range key, so the frame ``[h, h]`` holds the one
    bar that many calendar rows ahead, or none: one shuffle, no self-join.
    """
    priced = bars.filter(F.col("close") > 0).select("symbol", "date", "close").join(calendars.calendar(bars), "date")
    ahead = Window.partitionBy("symbol").orderBy("idx")
    hits = []
    for h in horizons:
        w = ahead.rangeBetween(int(h), int(h))
        hits.append(F.struct(F.lit(int(h)).alias("h"), F.max("date").over(w).alias("fwd_date"), F.max("close").over(w).alias("fwd_close")))
    out = priced.withColumn("_hits", F.array(*hits))
    if dates is not None:
        out = out.join(dates.select("date").distinct(), "date", "left_semi")
    return out.select("symbol", "date", "close", F.inline("_hits")).filter(F.col("fwd_close").isNotNull())


def forward_returns_calendar(bars: DataFrame, horizons: Sequence[int], dates: DataFrame | None = None) -> DataFrame:
    """``(symbol, date, h, fwd)`` on the union calendar."""
    p = forward_prices(bars, horizons, dates)
    return p.select("symbol", "date", "h", ((F.col("fwd_close") - F.col("close")) / F.col("close")).alias("fwd"))


def features_on(dates: DataFrame, series: DataFrame) -> DataFrame:
    """Feature values as of the given dates: ``series`` is ``(symbol, date, feature, value)``."""
    grid = series.select("symbol", "feature").distinct().select("symbol", "feature", F.explode(calendars.date_array(dates)).alias("date"))
    out = asof.backward(grid, series, on=["symbol", "feature"], cols=["value"])
    return out.filter(F.col("value").isNotNull()).drop("asof_date")


# ---------------------------------------------------------------- rank correlation


def rank_ic(panel: DataFrame, by: Sequence[str] = ("date",), value: str = "value", label: str = "fwd", min_names: int = 10) -> DataFrame:
    """Spearman correlation of value and label per group, average ranks."""
    by = list(by)
    both = panel.filter(F.col(value).isNotNull() & F.col(label).isNotNull())
    strategy = ranks.plan(both, by)
    ranked = ranks.average(both, by, value, "symbol", "_rv", strategy=strategy)
    ranked = ranks.average(ranked, by, label, "symbol", "_rl", strategy=strategy)
    out = ranked.groupBy(*by).agg(rank_correlation("_rv", "_rl").alias("ic"), F.count(F.lit(1)).alias("n"))
    return out.filter((F.col("n") >= min_names) & F.col("ic").isNotNull())


def ic_summary(ic: DataFrame, by: Sequence[str], min_dates: int = 5) -> DataFrame:
    """Mean, sample deviation, information ratio and hit rate of an IC series."""
    out = ic.groupBy(*by).agg(
        F.count("ic").alias("n_obs"), F.avg("ic").alias("mean"), F.stddev_samp("ic").alias("std"),
        F.avg((F.col("ic") > 0).cast("double")).alias("hit_rate"),
    )
    enough = F.col("n_obs") >= min_dates
    ir = F.coalesce(ratio(F.col("mean"), F.col("std")), F.lit(0.0))
    return out.select(*by, "n_obs", *[F.when(enough, c).alias(n) for n, c in (
        ("mean", F.col("mean")), ("std", F.col("std")), ("ir", ir), ("hit_rate", F.col("hit_rate")))])


def overlap_lags(horizon: int, step: int = 21) -> int:
    return max(0, math.ceil(horizon / step) - 1)


def newey_west(ic: DataFrame, by: Sequence[str], lags: int) -> DataFrame:
    """t-statistic of the mean IC with a Bartlett-weighted long-run variance."""
    group = Window.partitionBy(*by)
    line = group.orderBy("date")
    dev = ic.withColumn("_dev", F.col("ic") - F.avg("ic").over(group))
    dev = dev.withColumns({f"_p{k}": F.col("_dev") * F.lag("_dev", k).over(line) for k in range(lags + 1)})
    agg = dev.groupBy(*by).agg(F.count("ic").alias("n"), F.avg("ic").alias("mu"), *[F.avg(f"_p{k}").alias(f"g{k}") for k in range(lags + 1)])
    var = F.col("g0")
    for k in range(1, lags + 1):
        var = var + 2.0 * (1.0 - k / (lags + 1)) * F.col(f"g{k}")
    se = F.sqrt(F.greatest(var, F.lit(1e-18)) / F.col("n"))
    return agg.select(*by, F.when(F.col("n") >= max(5, lags + 2), F.col("mu") / se).alias("t_nw"))


def neutralise(panel: DataFrame, n_sectors: int, by: Sequence[str] = ("date",), value: str = "value") -> DataFrame:
    """Residual of the value on sector dummies and log market cap, per group.

    Sector dummies are removed by demeaning within the sector, the slope on the demeaned
    log size is one ratio of sums.  Needs columns ``sector`` and ``market_cap``; names without
    a sector form the group "Unknown".
    """
    by = list(by)
    ok = panel.filter(F.col(value).isNotNull() & (F.col("market_cap") > 0)).withColumn("_m", F.ln("market_cap"))
    ok = ok.withColumn("_sector", F.coalesce("sector", F.lit("Unknown")))
    means = ok.groupBy(*by, "_sector").agg(F.avg(value).alias("_fv"), F.avg("_m").alias("_fm"))
    centred = ok.join(means, [*by, "_sector"]).withColumns(
        {"_f": F.col(value) - F.col("_fv"), "_x": F.col("_m") - F.col("_fm")})
    slopes = centred.groupBy(*by).agg(
        F.sum(F.col("_f") * F.col("_x")).alias("_fx"), F.sum(F.col("_x") * F.col("_x")).alias("_xx"), F.count(F.lit(1)).alias("_n"))
    slopes = slopes.filter(F.col("_n") >= n_sectors + 2).select(*by, F.coalesce(ratio(F.col("_fx"), F.col("_xx")), F.lit(0.0)).alias("_b"))
    return centred.join(slopes, by).withColumn("neutral", F.col("_f") - F.col("_b") * F.col("_x")).select(*panel.columns, "neutral")


# ---------------------------------------------------------------- buckets and spreads


def in_buckets(panel: DataFrame, by: Sequence[str], buckets: int = 5, value: str = "value") -> DataFrame:
    """Rows with their quantile bucket (0 lowest); groups under two names per bucket drop."""
    ranked = ranks.ordinal(panel.filter(F.col(value).isNotNull()), by, [value, "symbol"], "_rn", "_n")
    return ranked.filter(F.col("_n") >= 2 * buckets).withColumn("bucket", ranks.bucket(F.col("_rn"), F.col("_n"), buckets)).drop("_rn", "_n")


def bucket_returns(panel: DataFrame, by: Sequence[str] = ("date",), buckets: int = 5, value: str = "value", label: str = "fwd") -> DataFrame:
    """Mean label per group and bucket."""
    b = in_buckets(panel.filter(F.col(label).isNotNull()), by, buckets, value)
    return b.groupBy(*by, "bucket").agg(F.avg(label).alias("ret"), F.count(F.lit(1)).alias("n"))


def spreads(buckets_df: DataFrame, by: Sequence[str] = ("date",), buckets: int = 5) -> DataFrame:
    """Top minus bottom bucket per group."""
    top = F.max(F.when(F.col("bucket") == buckets - 1, F.col("ret")))
    low = F.max(F.when(F.col("bucket") == 0, F.col("ret")))
    return buckets_df.groupBy(*by).agg((top - low).alias("spread"))


def spread_summary(buckets_df: DataFrame, by: Sequence[str], horizon: int, buckets: int = 5) -> DataFrame:
    """Annualised spread, Sharpe ratio and monotonicity over complete dates."""
    by = list(by)
    cells = [F.max(F.when(F.col("bucket") == b, F.col("ret"))).alias(f"b{b}") for b in range(buckets)]
    wide = buckets_df.groupBy(*by, "date").agg(*cells).dropna(subset=[f"b{b}" for b in range(buckets)])
    spread = F.col(f"b{buckets - 1}") - F.col("b0")
    year = 252.0 / horizon
    agg = [F.count(F.lit(1)).alias("n_periods"), F.avg(spread).alias("_m"), F.stddev_samp(spread).alias("_s")]
    agg += [F.avg(f"b{b}").alias(f"m{b}") for b in range(buckets)]
    out = (wide.groupBy(*by) if by else wide.groupBy()).agg(*agg).filter(F.col("n_periods") >= 5)
    means = F.array(*[F.col(f"m{b}") for b in range(buckets)])

    def rank_of(x):
        below = F.size(F.filter(means, lambda y: y < x))
        same = F.size(F.filter(means, lambda y: y == x))
        return below + (same + 1) / 2.0

    rank = F.transform(means, rank_of)
    mid = (buckets + 1) / 2.0
    xy = sum(((b + 1 - mid) * (rank[b] - mid) for b in range(buckets)), F.lit(0.0))
    yy = sum(((rank[b] - mid) * (rank[b] - mid) for b in range(buckets)), F.lit(0.0))
    xx = sum((b + 1 - mid) ** 2 for b in range(buckets))
    return out.select(
        *by, "n_periods", (F.col("_m") * year * 100.0).alias("spread_ann_pct"),
        F.coalesce(ratio(F.col("_m") * year, F.col("_s") * math.sqrt(year)), F.lit(0.0)).alias("spread_sharpe"),
        F.coalesce(ratio(xy, F.sqrt(yy * xx)), F.lit(0.0)).alias("monotonicity"),
        *[(F.col(f"m{b}") * year * 100.0).alias(f"bucket{b}_ann_pct") for b in range(buckets)],
    )


def top_turnover(panel: DataFrame, dates: DataFrame, by: Sequence[str] = (), buckets: int = 5, value: str = "value") -> DataFrame:
    """Average share of the top bucket that changes between consecutive dates."""
    by = list(by)
    step = dates.select("date").distinct().withColumn("_t", F.row_number().over(Window.orderBy("date")))
    top = in_buckets(panel, [*by, "date"], buckets, value).filter(F.col("bucket") == buckets - 1)
    top = top.select(*by, "date", "symbol").join(step, "date").drop("date")
    sizes = top.groupBy(*by, "_t").agg(F.count(F.lit(1)).alias("size"))
    both = top.join(top.withColumn("_t", F.col("_t") + 1), [*by, "_t", "symbol"]).groupBy(*by, "_t").agg(F.count(F.lit(1)).alias("both"))
    prev = sizes.select(*by, (F.col("_t") + 1).alias("_t"), F.col("size").alias("prev_size"))
    change = sizes.join(prev, [*by, "_t"]).join(both, [*by, "_t"], "left")
    moved = F.col("size") + F.col("prev_size") - 2 * F.coalesce("both", F.lit(0))
    return (change.groupBy(*by) if by else change.groupBy()).agg(F.avg(moved / (2.0 * F.col("size"))).alias("turnover"))


# ---------------------------------------------------------------- relations between factors


def pairwise_ic(wide: DataFrame, features: Sequence[str], min_names: int = 10) -> DataFrame:
    """Spearman per date and feature pair on the names that have both.

    Pairs are exploded inside the row; facts are never joined with themselves.
    """
    pairs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).alias("va"), F.col(b).alias("vb"))
             for a, b in combinations(sorted(features), 2)]
    long = wide.select("date", "symbol", F.inline(F.array(*pairs)))
    return rank_ic(long, ["date", "a", "b"], "va", "vb", min_names)


def factor_rank_correlation(wide: DataFrame, features: Sequence[str], min_names: int = 10) -> DataFrame:
    """Pairwise rank correlation averaged over dates."""
    per_date = pairwise_ic(wide, features, min_names)
    return per_date.groupBy("a", "b").agg(F.avg("ic").alias("corr"), F.count(F.lit(1)).alias("n_dates"))


def spread_correlation(spread_series: DataFrame, min_overlap: int = 10) -> DataFrame:
    """Correlation of spread series per feature pair on common dates."""
    a = spread_series.select("date", F.col("feature").alias("a"), F.col("spread").alias("sa"))
    b = spread_series.select("date", F.col("feature").alias("b"), F.col("spread").alias("sb"))
    pairs = a.join(b, "date").filter((F.col("a") < F.col("b")) & F.col("sa").isNotNull() & F.col("sb").isNotNull())
    out = pairs.groupBy("a", "b").agg(correlation("sa", "sb").alias("corr"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("corr", F.when(F.col("n") >= min_overlap, F.coalesce("corr", F.lit(0.0))).otherwise(0.0))


def neighbours(pairs: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` features most related to each feature, by absolute correlation."""
    both = pairs.select(F.col("a").alias("feature"), F.col("b").alias("neighbour"), "corr").unionByName(
        pairs.select(F.col("b").alias("feature"), F.col("a").alias("neighbour"), "corr"))
    w = Window.partitionBy("feature").orderBy(F.abs("corr").desc(), "neighbour")
    return both.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def label_agreement(groups: DataFrame) -> DataFrame:
    """Dominant label per group and the share of members that carry it."""
    counts = groups.groupBy("group", "label").agg(F.count(F.lit(1)).alias("c"))
    return counts.groupBy("group").agg(
        F.min_by("label", F.struct(-F.col("c"), "label")).alias("dominant"), F.sum("c").alias("size"),
        (F.max("c") / F.sum("c")).alias("agreement"))


def factor_cards(panel: DataFrame, horizons: Sequence[int], buckets: int = 5, step: int = 21, min_names: int = 10) -> DataFrame:
    """One row per feature and horizon: IC block, spread block.

    ``panel`` is ``(symbol, date, feature, h, value, fwd)``; one shuffle by
    ``(feature, h, date)`` serves ranks and buckets.
    """
    keys = ["feature", "h"]
    ic = rank_ic(panel, [*keys, "date"], min_names=min_names)
    out = ic_summary(ic, keys)
    tests = [newey_west(ic.filter(F.col("h") == h), keys, overlap_lags(h, step)) for h in horizons]
    t = tests[0]
    for other in tests[1:]:
        t = t.unionByName(other)
    b = bucket_returns(panel, [*keys, "date"], buckets)
    parts = [spread_summary(b.filter(F.col("h") == h), keys, h, buckets) for h in horizons]
    s = parts[0]
    for other in parts[1:]:
        s = s.unionByName(other)
    return out.join(t, keys, "left").join(s, keys, "left")


def whole_cards(panel: DataFrame, labels: DataFrame, n_sectors: int, horizons: Sequence[int], categories: dict[str, str], buckets: int = 5, step: int = 21, min_names: int = 10, k: int = 5) -> DataFrame:
    """One row per feature and horizon with everything a factor card shows.

    ``panel`` is ``(symbol, date, feature, value, sector, market_cap)``, ``labels`` ``(symbol, date, h,
    fwd)``.  Beside the blocks of ``factor_cards``: the IC of the values neutral to sector and
    size (``neutral_*``), the turnover of the top bucket between rebalancing dates, the ``k``
    features most correlated in rank, and the share of those in the feature's own category.
    """
    keys = ["feature", "h"]
    ok = panel.filter(F.col("value").isNotNull())
    cards = factor_cards(ok.select("symbol", "date", "feature", "value").join(labels, ["symbol", "date"]), horizons, buckets, step, min_names)
    flat = neutralise(ok, n_sectors, ["feature", "date"]).select("symbol", "date", "feature", "neutral").join(labels, ["symbol", "date"])
    ic = rank_ic(flat, [*keys, "date"], "neutral", min_names=min_names)
    tests = None
    for h in horizons:
        one = newey_west(ic.filter(F.col("h") == h), keys, overlap_lags(h, step))
        tests = one if tests is None else tests.unionByName(one)
    block = ic_summary(ic, keys).join(tests, keys, "left")
    block = block.select(*keys, *[F.col(c).alias(f"neutral_{c}") for c in block.columns if c not in keys])
    names_ = sorted(categories)
    wide = ok.groupBy("symbol", "date").pivot("feature", names_).agg(F.first("value"))
    near = neighbours(factor_rank_correlation(wide, names_, min_names), k)
    category = F.create_map(*[F.lit(x) for kv in categories.items() for x in kv])
    near = near.groupBy("feature").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "neighbour"))), lambda x: x["neighbour"]).alias("_near"),
        F.avg((category[F.col("neighbour")] == category[F.col("feature")]).cast("double")).alias("category_agreement"))
    near = near.select("feature", F.array_join("_near", ",").alias("neighbours"), "category_agreement")
    turnover = top_turnover(ok, ok.select("date"), ["feature"], buckets)
    out = cards.join(block, keys, "left").join(turnover, "feature", "left").join(near, "feature", "left")
    return out.withColumn("category", F.coalesce(category[F.col("feature")], F.lit("unknown")))


def daily_factor_spreads(panel: DataFrame, profiles: DataFrame, directions: dict[str, int], min_all: int = 50, min_sector: int = 20, buckets: int = 5) -> DataFrame:
    """Daily top-bottom spread in percentage points per factor and universe.

    The universes (everything and each sector) are exploded per row; ``fwd`` is a ratio.
    """
    ok = panel.filter(F.col("value").isNotNull() & F.col("fwd").isNotNull())
    ok = ok.join(profiles.select("symbol", "sector"), "symbol", "left")
    universes = F.array_compact(F.array(F.lit("all"), F.col("sector")))
    rows = ok.withColumn("universe", F.explode(universes))
    keys = ["universe", "feature", "date"]
    ranked = ranks.ordinal(rows, keys, ["value", "symbol"], "_rn", "n_symbols")
    least = F.when(F.col("universe") == "all", min_all).otherwise(min_sector)
    ranked = ranked.filter(F.col("n_symbols") >= least).withColumn("bucket", ranks.bucket(F.col("_rn"), F.col("n_symbols"), buckets))
    pp = F.col("fwd") * 100.0
    out = ranked.groupBy(*keys).agg(
        F.avg(F.when(F.col("bucket") == 0, pp)).alias("q1_mean_pp"),
        F.avg(F.when(F.col("bucket") == buckets - 1, pp)).alias("q5_mean_pp"), F.max("n_symbols").alias("n_symbols"))
    sign = F.create_map(*[F.lit(x) for kv in directions.items() for x in kv])[F.col("feature")]
    return out.filter(F.col("q1_mean_pp").isNotNull() & F.col("q5_mean_pp").isNotNull()).select(
        "date", F.col("feature").alias("factor"), "universe", "q1_mean_pp", "q5_mean_pp",
        (sign * (F.col("q5_mean_pp") - F.col("q1_mean_pp"))).alias("spread_pp"), "n_symbols")


def cumulative_factor_returns(spreads_df: DataFrame, start, end) -> DataFrame:
    """Sum of log factor returns over ``(start, end]``, in percentage points."""
    r = F.col("spread_pp") / 100.0
    inside = spreads_df.filter((F.col("date") > F.lit(start).cast("date")) & (F.col("date") <= F.lit(end).cast("date")))
    return inside.filter(r > -0.99999).groupBy("factor", "universe").agg(
        (F.sum(F.log1p(r)) * 100.0).alias("cum_log_pp"), F.count(F.lit(1)).alias("n_days"))


def annual_factor_table(spreads_df: DataFrame, universes: Sequence[str]) -> DataFrame:
    """Annualised mean factor return per universe and its difference to everything."""
    mean = {u: F.avg(F.when(F.col("universe") == u, F.col("spread_pp"))) * 252.0 for u in ["all", *universes]}
    out = spreads_df.groupBy("factor").agg(*[c.alias(f"{u}_ann_pp") for u, c in mean.items()])
    extra = [(F.col(f"{u}_ann_pp") - F.col("all_ann_pp")).alias(f"{u}_minus_all_pp") for u in universes]
    return out.select("*", *extra)


# ---------------------------------------------------------------- combination


def ranked_panel(panel: DataFrame, factors: Sequence[str], label: str = "fwd") -> DataFrame:
    """Complete rows with factors and label as ordinal ranks in [-0.5, 0.5] per date.

    The ranks share one exchange by date, and groups are counted once for all of them; a
    column costs a sort in place.
    """
    out = panel.select("symbol", "date", *factors, label).dropna()
    strategy = ranks.plan(out, ["date"])
    for c in [*factors, label]:
        out = ranks.ordinal(out, ["date"], [c, "symbol"], "_rn", "_n", strategy=strategy)
        scaled = F.when(F.col("_n") > 1, (F.col("_rn") - 1) / (F.col("_n") - 1) - 0.5).otherwise(0.0)
        out = out.withColumn(f"r_{c}", scaled).drop("_rn", "_n")
    return out.select("symbol", "date", *[f"r_{c}" for c in factors], F.col(f"r_{label}").alias("r_y"))


def date_moments(ranked: DataFrame, factors: Sequence[str]) -> DataFrame:
    """Per date: counts, sums and products; everything later is a sum of these rows."""
    cols = [f"r_{f}" for f in factors]
    agg = [F.count(F.lit(1)).alias("n"), F.sum("r_y").alias("sy"), F.sum(F.col("r_y") * F.col("r_y")).alias("syy")]
    agg += [F.sum(c).alias(f"s{i}") for i, c in enumerate(cols)]
    agg += [F.sum(F.col(c) * F.col("r_y")).alias(f"y{i}") for i, c in enumerate(cols)]
    agg += [F.sum(F.col(cols[i]) * F.col(cols[j])).alias(f"x{i}_{j}") for i in range(len(cols)) for j in range(i, len(cols))]
    out = ranked.groupBy("date").agg(*agg)
    return out.withColumn("t", F.row_number().over(Window.orderBy("date")) - 1)


def _factor_ic(i: int) -> Column:
    xy = F.col(f"y{i}") - F.col(f"s{i}") * F.col("sy") / F.col("n")
    xx = F.col(f"x{i}_{i}") - F.col(f"s{i}") * F.col(f"s{i}") / F.col("n")
    yy = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    return F.coalesce(ratio(xy, F.sqrt(xx) * F.sqrt(yy)), F.lit(0.0))


def mean_factor_ic(moments: DataFrame, factors: Sequence[str], min_names: int = 5) -> DataFrame:
    """Mean rank IC per factor over dates with enough names."""
    big = moments.filter(F.col("n") >= min_names)
    one = big.agg(*[F.avg(_factor_ic(i)).alias(f) for i, f in enumerate(factors)])
    return one.unpivot([], list(factors), "factor", "ic")


def _combined(weights: Sequence[float]) -> Column:
    """IC of the weighted score on one date, from its moments."""
    k = len(weights)
    lit = [F.lit(float(w)) for w in weights]
    s = sum((lit[i] * F.col(f"s{i}") for i in range(k)), F.lit(0.0))
    y = sum((lit[i] * F.col(f"y{i}") for i in range(k)), F.lit(0.0))
    x = sum((lit[i] * lit[j] * F.col(f"x{min(i, j)}_{max(i, j)}") for i in range(k) for j in range(k)), F.lit(0.0))
    n = F.col("n")
    den = F.sqrt(F.greatest((x - s * s / n) * (F.col("syy") - F.col("sy") * F.col("sy") / n), F.lit(0.0)))
    return F.when(den > 1e-12, (y - s * F.col("sy") / n) / den)


def combined_ic(moments: DataFrame, weights: Sequence[float], min_names: int = 5) -> DataFrame:
    return moments.filter(F.col("n") >= min_names).agg(F.coalesce(F.avg(_combined(weights)), F.lit(0.0)).alias("combined_ic"))


def factor_covariance(ranked: DataFrame, factors: Sequence[str]) -> DataFrame:
    """Pooled sample covariance of the ranked factors, one row per pair."""
    pairs = [(a, b) for i, a in enumerate(factors) for b in factors[i:]]
    one = ranked.agg(*[F.covar_samp(f"r_{a}", f"r_{b}").alias(f"{a}|{b}") for a, b in pairs])
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}|{b}").alias("cov")) for a, b in pairs])
    return one.select(F.inline(cells))


OFF_DIAGONAL, RIDGE = 0.8, 1e-4  # fixed values: damping of covariances, added to variances


def solve_weights(ic: np.ndarray, cov: np.ndarray, method: str = "ic_optimal", shrinkage: float = 0.3) -> np.ndarray:
    """Non-negative weights that sum to one (a k-by-k solve on the driver).

    What a method leaves positive is spread over ``1 - shrinkage``, the rest is shared equally.
    """
    k = len(ic)
    if method == "equal":
        return np.full(k, 1 / k)
    if method == "ic_weighted":
        gain = np.maximum(ic, 0)
    elif method == "ic_optimal":
        own = np.eye(k)
        gain = np.maximum(np.linalg.solve(cov * (OFF_DIAGONAL + (1 - OFF_DIAGONAL) * own) + RIDGE * own, ic), 0)
    else:
        raise ValueError(f"unknown method {method!r}")
    earned = gain / gain.sum() if gain.any() else np.full(k, 1 / k)
    return shrinkage / k + (1 - shrinkage) * earned


def _pooled(row, k: int, signs: np.ndarray):
    """(n, mean IC, covariance) from summed moments."""
    n = row["n"]
    s = np.array([row[f"s{i}"] for i in range(k)]) * signs
    x = np.array([[row[f"x{min(i, j)}_{max(i, j)}"] * signs[i] * signs[j] for j in range(k)] for i in range(k)])
    cov = (x - np.outer(s, s) / n) / (n - 1)
    ic = np.array([row[f"ic{i}"] or 0.0 for i in range(k)]) * signs
    return n, ic, cov


def _summed(moments: DataFrame, k: int) -> list:
    sums = [F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(k)]]
    sums += [F.sum(f"x{i}_{j}").alias(f"x{i}_{j}") for i in range(k) for j in range(i, k)]
    sums += [F.avg(F.when(F.col("n") >= 5, _factor_ic(i))).alias(f"ic{i}") for i in range(k)]
    return sums


def purged_oos_ic(moments: DataFrame, k: int, signs: Sequence[float], method: str, shrinkage: float, folds: int = 5, embargo: int = 63) -> DataFrame:
    """Out-of-sample IC per contiguous fold; weights come from the other dates outside the embargo.

    Two small jobs on the per-date moments: one row per fold for training, then the
    scored test dates.
    """
    spark = moments.sparkSession
    total = moments.count()
    if total < 2 * folds:
        return spark.createDataFrame([], "fold int, oos_ic double")
    edges = [int(total * i / folds) for i in range(folds + 1)]
    fold = sum((F.when(F.col("t") >= e, 1).otherwise(0) for e in edges[1:-1]), F.lit(0))
    bounds = [F.struct(F.lit(i).alias("fold"), F.lit(max(0, edges[i] - embargo)).alias("lo"), F.lit(min(total, edges[i + 1] + embargo)).alias("hi")) for i in range(folds)]
    train = moments.select("*", F.inline(F.array(*bounds))).filter((F.col("t") < F.col("lo")) | (F.col("t") >= F.col("hi")))
    learned = {r["fold"]: r for r in train.groupBy("fold").agg(*_summed(moments, k)).collect()}
    tested = {r["fold"]: r["n"] for r in moments.groupBy(fold.alias("fold")).agg(F.sum("n").alias("n")).collect()}
    signs = np.asarray(signs, dtype=float)
    score = None
    for i in range(folds):
        if i not in learned or learned[i]["n"] < 100 or tested.get(i, 0) < 50:
            continue
        _, ic, cov = _pooled(learned[i], k, signs)
        w = solve_weights(np.clip(ic, 0, None), cov, method, shrinkage) * signs
        hit = F.when(F.col("fold") == i, _combined(w))
        score = hit if score is None else F.coalesce(score, hit)
    if score is None:
        return spark.createDataFrame([], "fold int, oos_ic double")
    scored = moments.filter(F.col("n") >= 5).withColumn("fold", fold).withColumn("ic", score)
    return scored.groupBy("fold").agg(F.coalesce(F.avg("ic"), F.lit(0.0)).alias("oos_ic"))


def combine_factors(panel: DataFrame, factors: Sequence[str], label: str = "fwd", method: str = "ic_optimal", shrinkage: float = 0.3, folds: int = 5, embargo: int = 63, min_rows: int = 200) -> dict:
    """Weight block and diagnostics of a factor combination; only small aggregates are collected."""
    k = len(factors)
    moments = date_moments(ranked_panel(panel, factors, label), factors).cache()
    try:
        row = moments.agg(*_summed(moments, k), F.count(F.lit(1)).alias("dates")).first()
        if (row["n"] or 0) < min_rows:
            return {"error": f"insufficient labeled rows ({row['n'] or 0})"}
        raw = np.array([row[f"ic{i}"] or 0.0 for i in range(k)])
        signs = np.where(raw >= 0, 1.0, -1.0)
        n, ic, cov = _pooled(row, k, signs)
        w = solve_weights(np.abs(ic), cov, method, shrinkage)
        inside = combined_ic(moments, w * signs).first()[0]
        mean = lambda rows: float(np.mean(rows)) if rows else None
        oos = [r["oos_ic"] for r in purged_oos_ic(moments, k, signs, method, shrinkage, folds, embargo).orderBy("fold").collect()]
        equal = [r["oos_ic"] for r in purged_oos_ic(moments, k, signs, "equal", shrinkage, folds, embargo).collect()]
    finally:
        moments.unpersist()
    return {
        "weights": {f: float(x) for f, x in zip(factors, w, strict=True)},
        "signs": {f: "+" if s > 0 else "-" for f, s in zip(factors, signs, strict=True)},
        "rank_ic": {f: float(x) for f, x in zip(factors, raw, strict=True)},
        "n_rows": int(n), "n_dates": int(row["dates"]), "combined_ic_in_sample": inside,
        "combined_ic_oos": mean(oos), "combined_ic_oos_folds": oos, "equal_weight_ic_oos": mean(equal),
        "verdict": combination_verdict(mean(oos), mean(equal), inside),
    }


def combination_verdict(oos, equal, inside) -> str:
    if oos is None:
        return "insufficient data"
    if oos <= 0:
        text = "does not generalise"
    elif equal is not None and oos < equal:
        text = "equal weights do better out of sample"
    else:
        text = "generalises"
    if inside and inside > 2 * max(oos, 1e-6):
        text += "; large in-sample gap"
    return text


# ---------------------------------------------------------------- signal portfolios


def signal_portfolio(entries: DataFrame, bars: DataFrame, hold: int, by: Sequence[str] = ()) -> DataFrame:
    """Daily return of equal-weighted open entries, each held ``hold`` days from the next day.

    An entry is two change points of its symbol's number of open entries; the running sum of
    these meets the symbol's bars, so rows grow with entries and bars and not with the
    calendar.  ``by`` names portfolios in ``entries`` that are evaluated together.
    """
    by = list(by)
    cal = calendars.calendar(bars)
    opened = entries.groupBy(*by, "symbol", "date").agg(F.count(F.lit(1)).alias("n")).join(cal, "date")
    points = F.array(*[F.struct((F.col("idx") + after).alias("idx"), (F.col("n") * sign).alias("n")) for after, sign in ((1, 1), (hold + 1, -1))])
    points = opened.select(*by, "symbol", F.inline(points)).withColumn("ret", F.lit(None).cast("double"))
    path = Window.partitionBy("symbol").orderBy("idx")
    prev = F.when(F.lag("idx").over(path) == F.col("idx") - 1, F.lag("close").over(path))  # the day before, or none
    moves = bars.join(cal, "date").select("symbol", "idx", F.when(prev > 0, (F.col("close") - prev) / prev).alias("ret")).filter(F.col("ret").isNotNull())
    used = opened.select(*by, "symbol").distinct()
    moves = moves.join(used, "symbol").select(*by, "symbol", "idx", F.lit(0).cast("long").alias("n"), "ret")
    w = Window.partitionBy(*by, "symbol").orderBy("idx", F.col("ret").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    live = points.unionByName(moves).withColumn("open", F.sum("n").over(w)).filter(F.col("ret").isNotNull() & (F.col("open") > 0))
    day = live.groupBy(*by, "idx").agg(F.sum(F.col("open") * F.col("ret")).alias("gain"), F.sum("open").alias("positions")).join(cal, "idx").drop("idx")
    named = entries.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 0").drop("_n")  # portfolios with entries get every day
    days = calendars.date_array(bars)
    dates = named.select(*by, F.explode(F.slice(days, 2, F.size(days))).alias("date"))
    out = dates.join(day, [*by, "date"], "left")
    return out.select(*by, "date", F.coalesce(ratio(F.col("gain"), F.col("positions").cast("double")), F.lit(0.0)).alias("ret"), F.coalesce("positions", F.lit(0)).cast("long").alias("positions"))


def signal_metrics(entries: DataFrame, bars: DataFrame, hold: int, market: DataFrame, sector: DataFrame | None = None, risk_free_pct: float = 0.0) -> DataFrame:
    """The metric block of a signal's portfolio, with its excess return over market and sector.

    ``market`` and ``sector`` are ``(date, close)``; a day that lacks a price, or whose day before
    on the calendar does, counts as zero.  All
    series are one aggregation over the same days, annualised alike; the drawdown is taken in
    logs, so it holds for any growth, and is total from a total loss on.
    """
    own = signal_portfolio(entries, bars, hold).select("date", F.lit("signal").alias("series_id"), "ret")
    series = own
    for name, prices in (("market", market), ("sector", sector)):
        if prices is not None:
            line = calendars.calendar(bars).join(prices.select("date", "close"), "date", "left")
            prev = F.lag("close").over(Window.orderBy("idx"))  # one row per date
            moves = line.select("date", "idx", F.lit(name).alias("series_id"), F.coalesce(F.when(prev > 0, (F.col("close") - prev) / prev), F.lit(0.0)).alias("ret"))
            series = series.unionByName(moves.filter("idx > 1").drop("idx"))
    stats = nav.return_stats(series, risk_free_pct)
    path = Window.partitionBy("series_id").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    grown = own.withColumns({"lost": F.min("ret").over(path) <= -1, "log": F.sum(F.when(F.col("ret") > -1, F.log1p("ret"))).over(path)})
    under = F.when(F.col("lost"), -1.0).otherwise(F.expm1(F.col("log") - F.greatest(F.max("log").over(path), F.lit(0.0))))
    low = grown.select(under.alias("dd")).agg((F.min("dd") * 100).alias("max_drawdown_pct"))
    annual = lambda name: F.max(F.when(F.col("series_id") == name, F.col("ann_return_pct")))
    alphas = stats.agg((annual("signal") - annual("market")).alias("alpha_vs_market_pct"), (annual("signal") - annual("sector")).alias("alpha_vs_sector_pct"))
    one = lambda df: df.withColumn("series_id", F.lit("signal"))
    return stats.filter("series_id = 'signal'").join(one(low), "series_id").join(one(alphas), "series_id").drop("series_id")


def event_returns(entries: DataFrame, bars: DataFrame, horizon: int) -> DataFrame:
    """Entries with their forward return on the union calendar."""
    fwd = forward_returns_calendar(bars, [horizon]).drop("h")
    return entries.select("symbol", "date").join(fwd, ["symbol", "date"])


def event_stats(events: DataFrame, key: Column, name: str) -> DataFrame:
    """Triggers, win rate and average return per year, symbol, …"""
    return events.groupBy(key.alias(name)).agg(
        F.count(F.lit(1)).alias("triggers"), F.avg((F.col("fwd") > 0).cast("double")).alias("win_rate"),
        F.avg("fwd").alias("avg_return"))


def best_and_worst(stats: DataFrame, k: int = 20) -> DataFrame:
    """Top and bottom ``k`` symbols by average return."""
    top = stats.orderBy(F.desc("avg_return"), "symbol").limit(k).withColumn("side", F.lit("top"))
    low = stats.orderBy(F.asc("avg_return"), F.desc("symbol")).limit(k).withColumn("side", F.lit("bottom"))
    return top.unionByName(low)


def portfolio_correlation(returns: DataFrame, key: str = "signal") -> DataFrame:
    """Correlation of daily returns for every pair of signal portfolios."""
    a = returns.select("date", F.col(key).alias("a"), F.col("ret").alias("ra"))
    b = returns.select("date", F.col(key).alias("b"), F.col("ret").alias("rb"))
    pairs = a.join(b, "date").filter(F.col("a") < F.col("b"))
    return pairs.groupBy("a", "b").agg(F.coalesce(correlation("ra", "rb"), F.lit(0.0)).alias("corr"))


def forward_selection(signals: dict[str, DataFrame], bars: DataFrame, hold: int, max_corr: float = 0.8, min_entries: int = 5) -> list[dict]:
    """Greedy selection of signals that must fire together, by Sharpe ratio.

    The driver only steps; every step evaluates all remaining candidates in one job,
    with the candidate as a grouping key.
    """
    line = None
    for name, s in sorted(signals.items()):
        e = s.select("symbol", "date", F.lit(name).alias("signal")).distinct()
        line = e if line is None else line.unionByName(e)
    fired = scale.stable(line)  # every step reads the signals again
    chosen: list[str] = []
    steps: list[dict] = []
    best = -math.inf
    while len(chosen) < len(signals):
        running = None
        if chosen:
            running = fired.filter(F.col("signal").isin(chosen)).groupBy("symbol", "date").agg(F.count(F.lit(1)).alias("_c"))
            running = running.filter(F.col("_c") == len(chosen)).drop("_c")
        left = fired.filter(~F.col("signal").isin(chosen)) if chosen else fired
        if running is not None:
            left = left.join(running, ["symbol", "date"], "left_semi")
        sized = left.groupBy("signal").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") >= min_entries)
        rets = signal_portfolio(left.join(sized.select("signal"), "signal", "left_semi"), bars, hold, ["signal"])
        sharpe = F.coalesce(ratio(F.avg("ret"), F.stddev_samp("ret")) * math.sqrt(252), F.lit(0.0))
        if running is not None:
            combo = signal_portfolio(running, bars, hold).select("date", F.col("ret").alias("_combo"))
            score = rets.join(combo, "date").groupBy("signal").agg(sharpe.alias("sharpe"), correlation("ret", "_combo").alias("corr"))
        else:
            score = rets.groupBy("signal").agg(sharpe.alias("sharpe"), F.lit(None).cast("double").alias("corr"))
        rows = score.orderBy(F.desc("sharpe"), "signal").collect()  # one row per candidate
        pick = next((r for r in rows if r["corr"] is None or abs(r["corr"]) <= max_corr), None)
        if pick is None or pick["sharpe"] <= best:
            break
        steps.append({"step": len(steps) + 1, "signal": pick["signal"], "sharpe": pick["sharpe"],
                      "gain": None if best == -math.inf else pick["sharpe"] - best, "corr": pick["corr"]})
        best = pick["sharpe"]
        chosen.append(pick["signal"])
    return steps


# ---------------------------------------------------------------- stability of an IC series


def rolling_ic(ic: DataFrame, window: int, by: Sequence[str] = (), min_share: float = 1.2) -> DataFrame:
    """Trailing mean, deviation and information ratio; series shorter than 1.2 windows drop."""
    by = list(by)
    group = Window.partitionBy(*(by or [F.lit(0)]))
    w = group.orderBy("date").rowsBetween(1 - window, 0)
    out = ic.withColumns({
        "ic_mean": F.avg("ic").over(w), "ic_std": F.stddev_samp("ic").over(w), "k": F.count("ic").over(w),
        "total": F.count("ic").over(group)})
    out = out.filter((F.col("k") == window) & (F.col("total") >= int(window * min_share)))
    ir = F.coalesce(ratio(F.col("ic_mean"), F.col("ic_std")), F.lit(0.0))
    return out.select(*by, "date", "ic_mean", "ic_std", ir.alias("ir"))


def ir_distribution(rolling: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Percentiles of the rolling ratio and where its last value sits."""
    by = list(by)
    last = F.max_by("ir", "date")
    agg = [F.percentile("ir", p / 100).alias(f"p{p}") for p in (10, 25, 50, 75, 90)]
    group = rolling.groupBy(*by) if by else rolling.groupBy()
    out = group.agg(*agg, F.count("ir").alias("n"), last.alias("last"), F.collect_list("ir").alias("_all"))
    below = F.size(F.filter("_all", lambda x: x <= F.col("last")))
    return out.withColumn("current_percentile", below / F.col("n") * 100).drop("_all")


def largest_shifts(rolling: DataFrame, by: Sequence[str], lookback: int = 60, top: int = 5) -> DataFrame:
    """Largest changes of the mean ratio between the rows before and after a date."""
    by = list(by)
    group = Window.partitionBy(*by)
    line = group.orderBy("date")
    near = rolling.withColumns({
        "i": F.row_number().over(line), "n": F.count(F.lit(1)).over(group),
        "before": F.avg("ir").over(line.rowsBetween(-lookback, -1)), "after": F.avg("ir").over(line.rowsBetween(0, lookback - 1))})
    full = F.col("i").between(lookback + 1, F.col("n") - lookback)
    near = near.filter((F.col("n") >= 2 * lookback + 2) & full).withColumn("shift", F.col("after") - F.col("before"))
    peak = F.struct((-F.abs("shift")).alias("order"), "i", "date", "before", "after", "shift")
    # one bounded series per group: its rows by size of the shift, thinned to those far enough apart
    series = near.groupBy(*by).agg(F.sort_array(F.collect_list(peak)).alias("peaks"), F.stddev_samp("shift").alias("sd")).filter("sd > 0")

    def thin(kept: Column, p: Column) -> Column:
        apart = F.forall(kept, lambda k: F.abs(k["i"] - p["i"]) >= lookback // 2)
        return F.when((F.size(kept) < top) & apart, F.concat(kept, F.array(p))).otherwise(kept)

    kept = series.select(*by, "sd", F.inline(F.aggregate("peaks", F.slice("peaks", 1, 0), thin)))
    return kept.select(*by, "date", "before", "after", (F.col("shift") / F.col("sd")).alias("z"))


BRIDGE_TERMS = range(1, 5)  # of the alternating series


def bridge_p_value(stat: float) -> float:
    """Tail probability of the supremum of a Brownian bridge."""
    if stat <= 0:
        return 1.0
    return float(min(1.0, max(0.0, 2 * sum((-1) ** (k + 1) * math.exp(-2 * (k * stat) ** 2) for k in BRIDGE_TERMS))))


def _bridge_tail(stat: Column) -> Column:
    """``bridge_p_value`` as a column."""
    terms = sum((F.exp(-2.0 * k * k * stat * stat) * (2.0 if k % 2 else -2.0) for k in BRIDGE_TERMS), F.lit(0.0))
    return F.when(stat > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), terms))).otherwise(1.0)


def change_points(rolling: DataFrame, by: Sequence[str], alpha: float = 0.05, depth: int = 2, least: int = 60) -> DataFrame:
    """Breaks in the mean by CUSUM: all parts of all series at once, split ``depth`` times.

    A part too short, flat, or without a significant break leaves; a break takes its date
    out and halves the part, whose number doubles.
    """
    by = list(by)
    rows = rolling.select(*by, "date", "ir", F.lit(1).alias("part"))
    part = Window.partitionBy(*by, "part")
    path = part.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    found = None
    for level in range(depth + 1):
        rows = rows.withColumns({"n": F.count("ir").over(part), "mean": F.avg("ir").over(part), "sd": F.stddev_samp("ir").over(part)})
        rows = rows.filter((F.col("n") >= least) & (F.col("sd") > 0))
        drift = F.abs(F.sum(F.col("ir") - F.col("mean")).over(path)) / (F.col("sd") * F.sqrt("n"))
        rows = rows.withColumn("stat", drift)
        rows = rows.withColumn("top", F.max(F.struct("stat", (-F.unix_date("date")).alias("early"))).over(part))
        rows = rows.select(*by, "date", "ir", "part", _bridge_tail(F.col("top.stat")).alias("p_value"), F.date_from_unix_date(-F.col("top.early")).alias("at"))
        rows = rows.filter(F.col("p_value") < alpha)
        here = rows.filter(F.col("date") == F.col("at")).select(*by, "date", "p_value", F.lit(level).alias("depth"))
        found = here if found is None else found.unionByName(here)
        side = F.col("part") * 2 + (F.col("date") > F.col("at")).cast("int")
        rows = rows.filter(F.col("date") != F.col("at")).select(*by, "date", "ir", side.alias("part"))
    return found


# ---------------------------------------------------------------- exposure and attribution


def zscores(long: DataFrame, by: Sequence[str] = ("date", "feature"), min_names: int = 5) -> DataFrame:
    """Population z-score per cross-section with at least ``min_names`` names."""
    by = list(by)
    ok = long.filter(F.col("value").isNotNull())
    m = ok.groupBy(*by).agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"), F.count(F.lit(1)).alias("_n"))
    m = m.filter((F.col("_n") >= min_names) & (F.col("_s") > 0)).drop("_n")
    return ok.join(m, by).withColumn("z", (F.col("value") - F.col("_m")) / F.col("_s")).drop("_m", "_s")


def exposure(weights: DataFrame, z: DataFrame, by: Sequence[str] = ("feature",)) -> DataFrame:
    """Weighted mean z per factor over the holdings that have it."""
    j = weights.join(z, [c for c in weights.columns if c in z.columns and c != "weight"])
    return j.groupBy(*by).agg(
        ratio(F.sum(F.col("weight") * F.col("z")), F.sum("weight")).alias("exposure"), F.sum("weight").alias("coverage"),
        F.count(F.lit(1)).alias("n"))


def contributors(weights: DataFrame, z: DataFrame, by: Sequence[str] = ("feature",), k: int = 5) -> DataFrame:
    """Holdings that move each exposure most."""
    j = weights.join(z, [c for c in weights.columns if c in z.columns and c != "weight"])
    j = j.withColumn("contribution", F.col("weight") * F.col("z"))
    w = Window.partitionBy(*by).orderBy(F.abs("contribution").desc(), "symbol")
    return j.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(*by, "symbol", "weight", "z", "contribution", "rank")


def category_bets(exposures: DataFrame, categories: dict[str, tuple[str, int]]) -> DataFrame:
    """Mean exposure per category, factors that want a low value counted with a minus."""
    table = F.create_map(*[x for k, (c, s) in categories.items() for x in (F.lit(k), F.struct(F.lit(c).alias("c"), F.lit(s).alias("s")))])
    e = exposures.withColumn("_k", table[F.col("feature")]).filter(F.col("_k").isNotNull())
    return e.groupBy(F.col("_k.c").alias("category")).agg(F.avg(F.col("exposure") * F.col("_k.s")).alias("bet"), F.count(F.lit(1)).alias("n_factors"))


def concentration(weights: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Herfindahl index, effective number of names, largest weight."""
    g = weights.groupBy(*by) if by else weights.groupBy()
    hhi = F.sum(F.col("weight") * F.col("weight"))
    return g.agg(hhi.alias("hhi"), (1.0 / F.nullif(hhi, F.lit(0.0))).alias("effective_n"), F.max("weight").alias("max_weight"), F.count(F.lit(1)).alias("n"))


def attribution(exposures: DataFrame, factor_returns: DataFrame, total_log_pp: float, loading: float = 1.0) -> DataFrame:
    """Contribution of each factor to a log return, with residual and share explained."""
    j = exposures.join(factor_returns, exposures["feature"] == factor_returns["factor"]).select(
        "factor", "exposure", "cum_log_pp", (F.col("exposure") * F.col("cum_log_pp") * loading).alias("contribution"))
    total = F.sum("contribution").over(Window.partitionBy(F.lit(0)))
    return j.select("*", total.alias("explained"), (total_log_pp - total).alias("residual"),
                    ratio(total, F.lit(float(total_log_pp))).alias("share_explained"))


def cohort_spearman(df: DataFrame, a: str, b: str, key: str, by: Sequence[str] = ()) -> DataFrame:
    """Rank correlation and moments of paired metrics (in-sample against out-of-sample)."""
    ok = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumn("_g", F.lit(0))
    cols = [*names(list(by)), "_g"]
    strategy = ranks.plan(ok, cols)
    r = ranks.average(ranks.average(ok, cols, a, key, "_ra", strategy=strategy), cols, b, key, "_rb", strategy=strategy)
    return r.groupBy(*cols).agg(
        rank_correlation("_ra", "_rb").alias("spearman"), F.count(F.lit(1)).alias("n"), F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"),
        F.stddev_samp(a).alias("std_a"), F.stddev_samp(b).alias("std_b")).drop("_g")
