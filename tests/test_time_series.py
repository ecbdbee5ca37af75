import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import day
from pitfactors.operators import asof, calendars, events, features, quarterly


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def wilder_rsi(closes, n):
    d = np.diff(closes)
    up, down = np.maximum(d, 0), np.maximum(-d, 0)
    a, b = up[:n].mean(), down[:n].mean()
    out = []
    for i in range(n - 1, len(d)):
        if i >= n:
            a, b = (a * (n - 1) + up[i]) / n, (b * (n - 1) + down[i]) / n
        out.append(100.0 if b == 0 else 100 - 100 / (1 + a / b))
    return out


@pytest.mark.parametrize("period,length", [(14, 60), (2, 1500), (3, 900)])
def test_rsi_matches_the_recursion(spark, make_bars, period, length):
    closes = (100 + np.cumsum(np.random.default_rng(1).normal(0, 1, length))).round(2)
    got = [r["rsi"] for r in features.rsi(make_bars(A=closes), period).orderBy("date").collect()]
    assert np.allclose(got, wilder_rsi(closes, period), atol=0.0051)


def test_rsi_without_losses_is_100(make_bars):
    assert {r["rsi"] for r in features.rsi(make_bars(A=range(1, 30)), 14).collect()} == {100.0}


@pytest.mark.parametrize("strategy", ["timeline", "interval"])
def test_asof_ties_strictness_and_age(spark, strategy):
    left = spark.createDataFrame([("A", day(i)) for i in (0, 2, 3, 9, 40)] + [("B", day(1))], "symbol string, date date")
    right = spark.createDataFrame([("A", day(2), 1, 10.0), ("A", day(2), 2, 20.0), ("A", day(5), 1, None)], "symbol string, date date, seq int, v double")
    got = asof.backward(left, right, cols=["v"], tie="seq", strategy=strategy)
    assert [tuple(r)[1:] for r in got.orderBy("symbol", "date").collect()] == [
        (day(0), None, None), (day(2), day(2), 20.0), (day(3), day(2), 20.0), (day(9), day(5), None), (day(40), day(5), None), (day(1), None, None)]
    strict = asof.backward(left, right, cols=["v"], tie="seq", strategy=strategy, inclusive=False)
    assert strict.filter("symbol = 'A'").orderBy("date").collect()[1]["v"] is None
    fresh = asof.backward(left, right, cols=["v"], tie="seq", strategy=strategy, max_age_days=10)
    assert fresh.filter(F.col("date") == day(40)).first()["asof_date"] is None


def test_asof_result_does_not_depend_on_partitions(spark, sf):
    from pitfactors.sources import adapters as A

    inc = A.income(spark, sf)
    facts = asof.available_from(inc, A.earnings(inc))
    bars = A.bars(spark, sf).select("symbol", "date")
    answers = [
        rows(asof.backward(bars.repartition(n), facts.repartition(n), right_date="available_from", cols=["revenue"], tie="date"), "symbol", "date", "revenue")
        for n in (1, 8)
    ]
    assert len(answers[0]) == len(answers[1]) and repr(answers[0]) == repr(answers[1])


def test_availability_uses_report_within_sixty_days_else_lag(spark):
    st = spark.createDataFrame([("A", dt.date(2020, 3, 31)), ("A", dt.date(2020, 6, 30)), ("B", dt.date(2020, 3, 31))], "symbol string, date date")
    e = spark.createDataFrame([("A", dt.date(2020, 4, 20)), ("A", dt.date(2020, 9, 15))], "symbol string, date date")
    got = rows(asof.available_from(st, e), "symbol", "date", "available_from")
    assert got == [("A", dt.date(2020, 3, 31), dt.date(2020, 4, 20)), ("A", dt.date(2020, 6, 30), dt.date(2020, 8, 14)), ("B", dt.date(2020, 3, 31), dt.date(2020, 5, 15))]


def test_range_pairs_by_month_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    left = [(f"e{i}", "AB"[i % 2], day(int(rng.integers(0, 300)))) for i in range(60)]
    right = [("AB"[i % 2], day(i)) for i in range(400)]
    a = spark.createDataFrame([(e, s, d, d + dt.timedelta(days=45)) for e, s, d in left], "e string, symbol string, a date, b date")
    b = spark.createDataFrame(right, "symbol string, date date")
    got = rows(asof.within(a, b, "symbol", "a", "b", "date"), "e", "date")
    want = sorted((e, d) for e, s, x in left for t, d in right if s == t and x < d <= x + dt.timedelta(days=45))
    assert got == want


def test_calendar_helpers(spark):
    dates = spark.createDataFrame([(day(i),) for i in (0, 3, 31, 32, 45, 70)], "date date")
    assert rows(calendars.spaced(dates, 30), "date") == [(day(0),), (day(31),), (day(70),)]
    assert rows(calendars.month_starts(dates), "date") == [(day(0),), (day(31),), (day(70),)]
    assert calendars.trading_rows("3m") == 63 and calendars.duration_days("3mo") == 90 and calendars.duration_days("x") is None
    spans = calendars.walk_forward(dt.date(2015, 1, 1), dt.date(2020, 12, 31), "2y", "6m")
    assert [(s[1].year, s[1].month) for s in spans] == [(2015, 1), (2016, 7), (2018, 1)]
    with pytest.raises(ValueError):
        calendars.walk_forward(dt.date(2015, 1, 1), dt.date(2020, 1, 1), "1y", "1y")


def test_selloff_life_cycle(make_bars):
    b = make_bars(A=[100, 90, 70, 60, 80, 100, 120, 90, 85, 95])
    got = events.selloffs(b, -20.0).orderBy("trigger_date").collect()
    assert [(r["peak_price"], r["trough_price"], r["status"]) for r in got] == [(100.0, 60.0, "recovered"), (120.0, 85.0, "recovering")]
    assert got[0]["current_date"] == day(5) and got[0]["drawdown_pct"] == -40.0


def test_selloff_with_moving_peak_keeps_its_peak(make_bars):
    closes = [100] + [70] * 300 + [100, 90]
    got = events.selloffs(make_bars(A=closes), -20.0, "52w").collect()
    assert len(got) == 1 and got[0]["status"] == "recovered" and got[0]["current_date"] == day(301)


def test_period_drops_brute_force(make_bars):
    rng = np.random.default_rng(7)
    c = (50 * np.exp(np.cumsum(rng.normal(0, 0.1, 80)))).round(1)
    got = {r["signal_date"]: (r["peak_price"], r["trough_price"]) for r in events.period_drops(make_bars(A=c), 10, -15.0).collect()}
    want = {}
    for i in range(9, len(c)):
        w = c[i - 9: i + 1]
        best = min(((w[t] - w[: t + 1].max()) / w[: t + 1].max() * 100, t) for t in range(10))
        if best[0] <= -15:
            want[day(i)] = (w[: best[1] + 1].max(), w[best[1]])
    assert got == want and got


def test_drop_clusters_restart_from_an_anchor(make_bars):
    c = [100] * 5 + [80] + [100] * 10 + [70] + [100] * 10
    raw = events.period_drops(make_bars(A=c), 5, -15.0)
    ev = events.period_drop_events(raw, make_bars(A=c), 5).orderBy("trough_date").collect()
    assert [(r["trough_price"], r["signal_count"]) for r in ev] == [(80.0, 4), (70.0, 4)]


def test_anchors_of_many_troughs(spark):
    rng = np.random.default_rng(3)
    hits = {"A": sorted(rng.choice(40_000, 10_000, replace=False).tolist()), "B": [7], "C": [1, 1, 3, 4, 7]}
    df = spark.createDataFrame([(s, i) for s, v in hits.items() for i in v], "symbol string, idx int")
    got = {(r["symbol"], r["idx"]): r["anchor"] for r in events.anchored(df, 2).collect()}
    want = {}
    for s, v in hits.items():
        anchor = None
        for i in v:
            anchor = i if anchor is None or i - anchor > 2 else anchor
            want[s, i] = anchor
    assert got == want
    assert events.anchored(df.filter("false"), 2).count() == 0


def test_recovery_grammar(spark):
    one = spark.range(1).select(*[events.recovery_target(t, F.lit(50.0), F.lit(100.0)).alias(n) for n, t in (
        ("a", "peak"), ("b", "+10% from bottom"), ("c", "-5% from peak"), ("d", "+10% above peak"), ("e", "20%"))]).first()
    assert [round(x, 6) for x in one] == [100.0, 55.0, 95.0, 110.0, 60.0]
    assert events.recovery_target("soon", F.lit(1.0), F.lit(1.0)) is None


def test_truncation_changes_nothing_before_the_cut(spark, sf):
    """No look-ahead: dropping later bars leaves earlier results as they were."""
    from pitfactors.sources import adapters as A

    bars = A.bars(spark, sf)
    cut = "1998-12-31"
    past = bars.filter(F.col("date") <= cut)
    for make in (features.rsi, lambda b: events.running_peak(b, "52w"), events.atr, events.ma_crossover, lambda b: events.momentum_rank(b, 21)):
        a = [tuple(r) for r in make(bars).filter(F.col("date") <= cut).orderBy("symbol", "date").collect()]
        b = [tuple(r) for r in make(past).orderBy("symbol", "date").collect()]
        assert a == b


def test_streak_needs_consecutive_quarters(spark):
    q = [("A", dt.date(2018 + i // 4, 3 * (i % 4) + 3, 28), f"Q{i % 4 + 1}", day(i), float(v)) for i, v in enumerate([1, 2, 3, 2, 3, 4, 5])]
    df = spark.createDataFrame(q, "symbol string, date date, period string, signal_date date, revenue_yoy double")
    got = rows(quarterly.revenue_acceleration(df, 2), "date", "streak")
    assert [g[1] for g in got] == [2, 2, 3]
