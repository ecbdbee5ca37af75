import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import day
from pitfactors.functions import ranks
from pitfactors.operators import claims, conditions, evaluation, scoring


@pytest.fixture(scope="module")
def planted(spark):
    """40 names, 120 dates: ``good`` follows the label, ``noise`` does not."""
    rng = np.random.default_rng(0)
    rows = []
    for t in range(120):
        fwd = rng.normal(0, 1, 40)
        good, noise = fwd + rng.normal(0, 0.3, 40), rng.normal(0, 1, 40)
        rows += [(f"s{i:02d}", day(t), float(good[i]), float(noise[i]), float(fwd[i])) for i in range(40)]
    return spark.createDataFrame(rows, "symbol string, date date, good double, noise double, fwd double").repartition(5)


def test_combination_finds_the_planted_factor(planted):
    out = evaluation.combine_factors(planted, ["good", "noise"], embargo=5)
    assert out["signs"]["good"] == "+" and out["weights"]["good"] > out["weights"]["noise"]
    assert out["combined_ic_oos"] > 0.5 and abs(sum(out["weights"].values()) - 1) < 1e-9 and len(out["combined_ic_oos_folds"]) == 5


def test_ranked_moments_share_one_exchange(planted, monkeypatch):
    counted = []
    monkeypatch.setattr(ranks.scale, "has_large_group", lambda df, by, most=0: counted.append(tuple(by)) or False)
    moments = evaluation.date_moments(evaluation.ranked_panel(planted, ["good", "noise"]), ["good", "noise"]).drop("t")
    plan = moments._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(date") == 1 and counted == [("date",)]


def test_rank_plans_agree_when_groups_are_counted_once(planted, monkeypatch):
    def both():
        ic = evaluation.rank_ic(planted.withColumnRenamed("good", "value")).collect()
        spread = claims.double_sort(planted.withColumnsRenamed({"good": "primary", "noise": "conditioning"}), min_top=5).collect()
        z = scoring.standardise(planted.withColumnRenamed("good", "value"), ["date"]).select("symbol", "date", "z").collect()
        return [sorted((*r[:-1], round(r[-1], 9)) for r in rows) for rows in (ic, spread, z)]

    window = both()
    monkeypatch.setattr(ranks.scale, "has_large_group", lambda df, by, most=0: True)
    assert both() == window and all(window)


def test_purged_folds_match_numpy(planted):
    """Fold scores from per-date moments equal scores computed from the rows."""
    pdf = planted.toPandas().sort_values(["date", "symbol"])
    r = {c: pdf.groupby("date")[c].rank(method="first").sub(1).div(39).sub(0.5).to_numpy().reshape(120, 40) for c in ("good", "noise", "fwd")}
    moments = evaluation.date_moments(evaluation.ranked_panel(planted, ["good", "noise"]), ["good", "noise"])
    got = {x["fold"]: x["oos_ic"] for x in evaluation.purged_oos_ic(moments, 2, [1, 1], "ic_optimal", 0.3, 5, 5).collect()}
    for f in range(5):
        t0, t1 = 24 * f, 24 * (f + 1)
        train = [t for t in range(120) if t < t0 - 5 or t >= t1 + 5]
        ic = np.array([np.mean([np.corrcoef(r[c][t], r["fwd"][t])[0, 1] for t in train]) for c in ("good", "noise")])
        cov = np.cov(np.stack([r[c][train].ravel() for c in ("good", "noise")]))
        w = evaluation.solve_weights(np.clip(ic, 0, None), cov, "ic_optimal", 0.3)
        want = np.mean([np.corrcoef(w[0] * r["good"][t] + w[1] * r["noise"][t], r["fwd"][t])[0, 1] for t in range(t0, t1)])
        assert abs(got[f] - want) < 1e-9


def test_neutralised_equals_least_squares(spark):
    rng = np.random.default_rng(2)
    n = 60
    sector, cap, v = rng.integers(0, 4, n), rng.lognormal(3, 1, n), rng.normal(0, 1, n)
    df = spark.createDataFrame([(f"s{i}", day(0), float(v[i]), f"S{sector[i]}", float(cap[i])) for i in range(n)], "symbol string, date date, value double, sector string, market_cap double")
    got = {r["symbol"]: r["neutral"] for r in evaluation.neutralise(df, 4).collect()}
    x = np.column_stack([(sector == k).astype(float) for k in range(4)] + [np.log(cap)])
    resid = v - x @ np.linalg.lstsq(x, v, rcond=None)[0]
    assert np.allclose([got[f"s{i}"] for i in range(n)], resid)


def test_newey_west_by_hand(spark):
    x = np.random.default_rng(3).normal(0.1, 1, 50)
    df = spark.createDataFrame([("f", day(i), float(v)) for i, v in enumerate(x)], "feature string, date date, ic double")
    d = x - x.mean()
    var = (d * d).mean() + 2 * sum((1 - k / 4) * (d[k:] * d[:-k]).mean() for k in (1, 2, 3))
    assert abs(evaluation.newey_west(df, ["feature"], 3).first()["t_nw"] - x.mean() / np.sqrt(var / 50)) < 1e-9


def test_signal_portfolio_counts_open_entries(spark, make_bars):
    b = make_bars(A=[10, 11, 12, 12, 6], B=[10, 10, 5, 10, 10])
    e = spark.createDataFrame([("A", day(0)), ("A", day(0)), ("B", day(1))], "symbol string, date date")
    got = [round(r["ret"], 6) for r in evaluation.signal_portfolio(e, b, 2).orderBy("date").collect()]
    # day 1: A twice; day 2: A twice and B; day 3: B only; day 4: empty
    assert got == [0.1, round((2 / 11 - 0.5) / 3, 6), 1.0, 0.0]


def test_change_points_and_shifts_find_the_break(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(0, 1, 200), rng.normal(3, 1, 200)])
    df = spark.createDataFrame([("f", day(i), float(v)) for i, v in enumerate(x)], "feature string, date date, ir double")
    breaks = evaluation.change_points(df, ["feature"]).collect()
    top = min(breaks, key=lambda r: r["p_value"])
    assert abs((top["date"] - day(0)).days - 199) <= 3 and top["depth"] == 0 and top["p_value"] < 1e-6
    shifts = evaluation.largest_shifts(df, ["feature"], 60, 3).collect()
    best = max(shifts, key=lambda r: abs(r["z"]))
    assert abs((best["date"] - day(0)).days - 200) <= 3
    gaps = sorted((r["date"] - day(0)).days for r in shifts)
    assert all(b - a >= 30 for a, b in zip(gaps, gaps[1:]))
    assert evaluation.bridge_p_value(0.0) == 1.0 and abs(evaluation.bridge_p_value(1.358) - 0.05) < 1e-3


def test_forward_selection_stops_without_gain(spark, make_bars):
    rng = np.random.default_rng(6)
    closes = {s: 100 * np.exp(np.cumsum(rng.normal(0.001, 0.02, 120))) for s in "ABCD"}
    b = make_bars(**closes)
    up = b.filter("symbol = 'A'").select("symbol", "date")
    steps = evaluation.forward_selection({"one": up, "same": up}, b, 5)
    assert len(steps) == 1 and steps[0]["step"] == 1


def test_composite_missing_rules(spark):
    rows = [("a", "x", 1.0), ("b", "x", 2.0), ("c", "x", 3.0), ("a", "y", 5.0), ("b", "y", 1.0), ("d", "z", 1.0)]
    df = spark.createDataFrame([(day(0), s, f, v) for s, f, v in rows], "date date, symbol string, feature string, value double")
    got = {r["symbol"]: r["score"] for r in scoring.composite(df, [scoring.Bucket("p", 3.0, {"x": 1}), scoring.Bucket("q", 1.0, {"y": -1, "z": 1})]).collect()}
    z = np.sqrt(1.5)
    assert set(got) == {"a", "b", "c"}  # d has only a factor that cannot be standardised
    assert np.allclose([got["a"], got["b"], got["c"]], [-0.75 * z - 0.25, 0.25, 0.75 * z])


def test_hysteresis_and_band(spark):
    import datetime as dt

    ranks_ = [1, 3, 5, 7, 3, 2, None]
    df = spark.createDataFrame([("A", day(i), r) for i, r in enumerate(ranks_) if r], "symbol string, date date, rank int")
    dates = F.array(*[F.lit(day(i)) for i in range(7)])
    got = [r["member"] for r in scoring.rank_hysteresis(df, dates, 2, 5).orderBy("date").collect()]
    assert got == [True, True, True, False, False, True, False]
    one = spark.range(1).select(*[scoring.band_target(F.lit(v), F.lit(100.0), 0.1).alias(f"v{i}") for i, v in enumerate((80.0, 95.0, 130.0))]).first()
    assert [round(x, 6) for x in one] == [90.0, 95.0, 110.0]
    assert isinstance(day(0), dt.date)


def test_combined_signals_keep_every_condition(spark):
    from pitfactors.functions.columns import meta

    base = spark.createDataFrame([("A", day(0), 1.0), ("A", day(1), 2.0)], "symbol string, date date, value double").withColumn("meta", meta(rsi=F.col("value")))
    other = base.filter(F.col("date") == day(1)).withColumn("value", F.lit(9.0))
    both = conditions.combine([base, other], "all").collect()
    assert len(both) == 1 and both[0]["meta"] == {"condition_0_rsi": "2.0", "condition_1_rsi": "2.0"} and both[0]["value"] == 2.0
    assert conditions.combine([base, other], "any").count() == 2
    recs = conditions.records([base, other], [{"type": "rsi", "value": 3}, {"type": "always"}]).first()["records"]
    assert [r["type"] for r in recs] == ["rsi", "always"] and recs[0]["config"] == {"value": "3"}


def test_double_sort_spread(spark):
    """Fifty names: the cheap two of the top ten earn 0.1, the dear two lose 0.05."""
    rows = []
    for i in range(50):
        fwd = {40: 0.1, 41: 0.1, 48: -0.05, 49: -0.05}.get(i, 0.0)
        rows.append((day(0), f"s{i:02d}", float(i), float(i), fwd))
    df = spark.createDataFrame(rows, "date date, symbol string, primary double, conditioning double, fwd double")
    assert abs(claims.double_sort(df).first()["spread"] - 0.15) < 1e-12
    assert claims.double_sort(df.filter("primary < 24")).count() == 0
    a, b = (claims.double_sort(df.repartition(n), seed=1).first()["spread"] for n in (1, 6))
    assert a == b


def test_regime_summary_and_verdict(spark):
    s = spark.createDataFrame([(day(0), 0.02), (day(1), 0.04), (day(2), -0.06)], "date date, spread double")
    labels = spark.createDataFrame([(day(0), ["bull"]), (day(1), ["bull"]), (day(2), ["bear"])], "date date, active array<string>")
    got = {r["regime"]: r for r in claims.by_regime(s, labels, 63).collect()}
    assert round(got["bull"]["mean_ann_pct"], 6) == 12.0 and round(got["bear"]["mean_ann_pct"], 6) == -24.0 and got["bull"]["hit_rate"] == 1.0
    per = spark.createDataFrame([("__overall__", 40, 5.0, 2.0), ("a", 20, 6.0, 2.0), ("b", 20, 4.0, 1.6)], "regime string, n long, mean_ann_pct double, t_stat double")
    assert claims.verdicts(per).first()["status"] == "unconditional"
    flipped = per.withColumn("t_stat", F.when(F.col("regime") == "b", -2.0).otherwise(F.col("t_stat")))
    assert claims.verdicts(flipped).first()["status"] == "regime_reversing"
