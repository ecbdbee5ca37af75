import json

import numpy as np
import pytest
from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import day
from pitfactors.functions import ranks
from pitfactors.operators import funds, ledger, lookup, regimes
from pitfactors.sources import documents, sinks
from pitfactors.streaming import jobs

TRADE = "book long, symbol string, date date, action string, shares double, amount_cents long, pnl_units long"


def trades(spark, rows):
    return spark.createDataFrame([(1, s, day(d), a, float(n), int(n * p * 100), int(pnl * 10000)) for s, d, a, n, p, pnl in rows[::-1]], TRADE)


def test_positions_average_cost(spark):
    t = trades(spark, [
        ("A", 0, "BUY", 10, 100, 0), ("A", 1, "BUY", 10, 120, 0), ("A", 2, "SELL", 5, 130, 100),     # scale in, partial exit
        ("B", 0, "BUY", 4, 50, 0), ("B", 1, "SELL", 4, 60, 40), ("B", 3, "BUY", 2, 70, 0),           # round trip, re-entry
        ("C", 0, "SELL", 3, 10, 30), ("C", 0, "BUY", 3, 9, 0),                                       # same day: buy first
    ])
    marks = spark.createDataFrame([("A", 140.0), ("B", 80.0)], "symbol string, price double")
    p = {r["symbol"]: r for r in ledger.positions(t, marks).collect()}
    assert (p["A"]["shares_held"], p["A"]["avg_entry"], p["A"]["unrealized_pnl"]) == (15.0, 110.0, 450.0)
    assert (p["B"]["shares_held"], p["B"]["avg_entry"], p["B"]["num_round_trips"]) == (2.0, 70.0, 1)
    assert p["C"]["status"] == "closed" and p["C"]["open_cost"] == 0.0
    s = ledger.book_summary(ledger.positions(t, marks), 10000.0).first()
    assert s["portfolio_value"] == pytest.approx(10000 + 170 + 450 + 20) and s["cash"] == pytest.approx(10000 - 1650 - 140 + 170)


def test_replayed_nav_moves_with_prices(spark, make_bars):
    t = trades(spark, [("A", 1, "BUY", 10, 100, 0), ("A", 3, "SELL", 10, 110, 100)])
    nav = ledger.replay_nav(t, make_bars(A=[100, 100, 105, 110, 90]), 5000.0).orderBy("date").collect()
    assert [r["nav"] for r in nav] == [5000.0, 5050.0, 5100.0, 5100.0]


def test_violations_are_found(spark, make_bars):
    t = trades(spark, [("A", 0, "SELL", 5, 10, 1), ("B", 0, "BUY", 1, 10, 0), ("B", 1, "SELL", 3, 10, 1), ("B", 9, "BUY", 1, 10, 0)])
    t = t.withColumns({"reason": F.lit("entry"), "sleeve": F.lit("s"), "trade_key": F.lit("k")})
    rules = {r["rule"] for r in ledger.violations(t, make_bars(A=[1] * 5, B=[1] * 5), known_reasons=["entry"]).collect()}
    assert rules == {"I1_no_bar", "I2_naked_sell", "I3_negative_shares"}


def test_first_touch_precedence(spark, make_bars):
    b = make_bars(A=[100, 90, 70, 200] + [100] * 40, B=[100, 165, 60] + [100] * 40, C=[100] * 45)
    e = spark.createDataFrame([(s, s, day(0), 100.0) for s in "ABC"], "entry_id string, symbol string, entry_date date, entry_price double")
    got = {r["entry_id"]: (r["reason"], (r["exit_date"] - day(0)).days) for r in ledger.first_touch(e, b, -25.0, 60.0, 30).collect()}
    assert got == {"A": ("stop_loss", 2), "B": ("take_profit", 1), "C": ("time_stop", 30)}


def test_first_touch_waits_for_the_next_bar(spark):
    b = spark.createDataFrame([("A", day(i), 100.0) for i in (0, 5, 110, 111)], "symbol string, date date, close double")
    e = spark.createDataFrame([("a", "A", day(0), 100.0), ("b", "A", day(110), 100.0)], "entry_id string, symbol string, entry_date date, entry_price double")
    got = {r["entry_id"]: (r["reason"], r["exit_date"]) for r in ledger.first_touch(e, b, -25.0, 60.0, 30).collect()}
    assert got == {"a": ("time_stop", day(110)), "b": ("open", None)}


def test_xirr():
    days, account = np.array([0.0, 365.0, 0.0, 365.0, 0.0, 1.0]), np.array([0, 0, 1, 1, 2, 2])
    got = funds.xirr(days, np.array([-100.0, 110.0, -100.0, 20.0, 5.0, 10.0]), account)
    assert got[0] == pytest.approx(0.10) and got[1] == pytest.approx(-0.8) and np.isnan(got[2])


def test_xirr_of_accounts_of_a_few_days():
    cases = [(3, 1040.0), (10, 1140.0), (1, 1500.0), (1, 5000.0), (300, 1100.0)]
    days = np.array([float(d) for n, _ in cases for d in (0, n)])
    amounts = np.array([x for _, end in cases for x in (-1000.0, end)])
    got = funds.xirr(days, amounts, np.repeat(np.arange(len(cases)), 2))
    assert got == pytest.approx([(end / 1000) ** (365 / n) - 1 for n, end in cases], rel=1e-6, abs=1e-6)
    # below -99.99 % a year there is none, as in the reference
    assert np.isnan(funds.xirr(np.array([0.0, 3.0]), np.array([-1000.0, 900.0]), np.array([0, 0]))[0])


def test_xirr_of_two_close_rates():
    a, b = np.exp(0.05), np.exp(0.09)
    got = funds.xirr(np.array([0.0, 365.0, 730.0]), 1000 * np.array([1, -a - b, a * b]), np.array([0, 0, 0]))
    assert got[0] == pytest.approx(b - 1, abs=1e-6)


def test_alerts_stay_unique_however_late_they_repeat(spark, tmp_path):
    feed, out, check = (str(tmp_path / n) for n in ("feed", "out", "check"))
    for ids in (["a", "b", "a"], ["c"], ["a", "d"]):
        df = spark.createDataFrame([(i,) for i in ids], "alert_id string")
        df.coalesce(1).write.mode("append").parquet(feed)
        jobs.unique_alerts(jobs.files(spark, feed, df.schema), out, check).start().awaitTermination()
    assert sorted(r["alert_id"] for r in spark.read.parquet(out).collect()) == ["a", "b", "c", "d"]


def test_fund_values_reconcile(spark):
    nav = spark.createDataFrame([("f", day(i), 100.0 + i) for i in range(10)], "fund string, date date, nav double")
    series = funds.nav_per_unit(nav)
    flows = spark.createDataFrame([("f", 1, day(0), 1, 100000), ("f", 2, day(5), 2, 210000), ("f", 1, day(9), 3, -50000)], "fund string, investor long, date date, flow_id long, amount_cents long")
    tx = funds.unit_transactions(flows, series)
    r = funds.reconciliation(tx, series).first()
    assert r["sum_of_values"] == pytest.approx(r["aum"], abs=0.02) and r["investor_count"] == 2
    s = {x["investor"]: x for x in funds.statements(tx, series).collect()}
    assert s[2]["units_held"] == 20.0 and s[2]["current_value"] == 2180.0
    irr = {x["investor"]: x["irr"] for x in funds.money_weighted(tx, series).collect()}
    assert irr[2] == pytest.approx((2180 / 2100) ** (365 / 4) - 1, rel=1e-3)


FLAGS = "regime string, date date, entry boolean, leave boolean, hold int, need_in int, need_out int"


def flag_rows(n=60):
    rng = np.random.default_rng(8)
    return [(g, day(i), bool(rng.random() < 0.5), bool(rng.random() < 0.4), h, a, b) for g, h, a, b in (("x", 3, 2, 2), ("y", 0, 1, 1)) for i in range(n)]


def test_regime_machine_by_hand():
    state, seen = (0, 0, 0), []
    for entry, leave in [(1, 0), (0, 0), (1, 0), (1, 0), (0, 1), (0, 1), (0, 1), (0, 1), (0, 1)]:
        state, flags = regimes.step(state, bool(entry), bool(leave), 2, 2, 2)
        seen.append(flags[0])
    # two entries in a row switch on, two days of minimum hold, two exits in a row switch off
    assert seen == [False, False, False, True, True, True, True, False, False]


def test_regime_stream_equals_batch(spark, tmp_path):
    rows = flag_rows()
    df = spark.createDataFrame(rows, FLAGS)
    batch = {(r["regime"], r["date"]): r["active"] for r in df.groupBy("regime").applyInPandas(regimes._walk, regimes.STATE_SCHEMA).collect()}
    feed, out = tmp_path / "feed", tmp_path / "out"
    for part, (lo, hi) in enumerate([(0, 20), (20, 40), (35, 60)]):  # the last file repeats five days
        cut = df.filter((F.col("date") >= day(lo)) & (F.col("date") < day(hi)))
        cut.coalesce(1).write.mode("append").parquet(str(feed))
        jobs.run_to_folder(jobs.regime_states(jobs.files(spark, str(feed), df.schema)), str(out), str(tmp_path / "check"))
    got = {(r["regime"], r["date"]): r["active"] for r in spark.read.parquet(str(out)).collect()}
    assert got == batch


def test_regime_stream_goes_on_from_a_batch(spark, tmp_path):
    df = spark.createDataFrame(flag_rows(), FLAGS)
    batch = {(r["regime"], r["date"]): r["active"] for r in df.groupBy("regime").applyInPandas(regimes._walk, regimes.STATE_SCHEMA).collect()}
    start = regimes.carried(df.filter((F.col("date") < day(25)) & (F.col("regime") == "x")))  # regime y has no state yet
    feed, out = str(tmp_path / "feed"), str(tmp_path / "out")
    for lo, hi in ((0, 30), (30, 60)):
        df.filter((F.col("date") >= day(lo)) & (F.col("date") < day(hi))).coalesce(1).write.mode("append").parquet(feed)
        jobs.run_to_folder(jobs.regime_states(jobs.files(spark, feed, df.schema), start), out, str(tmp_path / "check"))
    got = {(r["regime"], r["date"]): r["active"] for r in spark.read.parquet(out).collect()}
    assert got == {k: v for k, v in batch.items() if k[0] == "y" or k[1] >= day(25)}
    assert spark.conf.get(jobs.STORE, "").rpartition(".")[2] != "RocksDBStateStoreProvider"


def test_carried_refresh_equals_the_panel_of_all_bars(spark, tmp_path):
    rng = np.random.default_rng(5)
    bars = [(s, day(i), float(c)) for s in "AB" for i, c in enumerate((50 * np.exp(np.cumsum(rng.normal(0, 0.1, 60)))).round(2))]
    bars[10] = ("A", day(10), None)
    df = spark.createDataFrame(bars, "symbol string, date date, close double")

    def build(b):
        w = Window.partitionBy("symbol").orderBy("date")
        b = b.filter("close is not null")
        return b.select("symbol", "date", F.lag("close", 5).over(w).alias("then"), F.sum("close").over(w.rowsBetween(-5, 0)).alias("sum"),
                        F.max("close").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("peak"))

    feed, out, state, check = (str(tmp_path / n) for n in ("feed", "out", "state", "check"))
    fixed = spark.createDataFrame([("A", day(39), 500.0), ("B", day(2), 1.0), ("C", day(41), 3.0), (None, day(41), 1.0)], df.schema)
    tails = []
    for part in (df.filter(F.col("date") < day(30)), df.filter(F.col("date").between(day(30), day(40))), fixed, df.filter(F.col("date") > day(40))):
        part.coalesce(1).write.mode("append").parquet(feed)
        jobs.carried_refresh(jobs.files(spark, feed, df.schema), check, build, out, state, days=3, history=5).start().awaitTermination()
        tails.append(spark.read.parquet(f"{state}/tail-{(len(tails)) % 2}").groupBy("symbol").count().agg(F.max("count")).first()[0])
    whole = sinks.upsert(df, fixed.filter("symbol != 'B'"), ["symbol", "date"])
    key = lambda rows: {r[:2]: tuple(None if x is None else round(x, 6) for x in r[2:]) for r in rows}
    assert key(map(tuple, spark.read.parquet(out).select("symbol", "date", "then", "sum", "peak").collect())) == key(map(tuple, build(whole).collect()))
    assert max(tails) <= 4 + 5 + 1
    late = spark.read.parquet(f"{state}/late").collect()
    assert [(r["symbol"], r["date"], r["close"]) for r in late] == [("B", day(2), 1.0)]


def test_stream_upsert_is_idempotent_and_takes_corrections(spark, tmp_path):
    feed, out, check = (str(tmp_path / n) for n in ("feed", "out", "check"))
    schema = "symbol string, date date, close double"
    first = spark.createDataFrame([("A", day(0), 1.0), ("A", day(400), 2.0), ("B", day(0), 3.0)], schema)
    fixed = spark.createDataFrame([("A", day(0), 9.0), ("C", day(1), 4.0)], schema)
    for df in (first, fixed):
        df.coalesce(1).write.mode("append").parquet(feed)
        for _ in range(2):  # a second run has nothing to do
            jobs.corrections(jobs.files(spark, feed, df.schema), out, check, "prices").start().awaitTermination()
    sinks.upsert_table(fixed, out, ["symbol", "date"])  # a replayed batch changes nothing
    got = sorted((r["symbol"], r["date"], r["close"]) for r in spark.read.parquet(out).collect())
    assert got == [("A", day(0), 9.0), ("A", day(400), 2.0), ("B", day(0), 3.0), ("C", day(1), 4.0)]


def test_insert_absent_never_changes_published_rows(spark, tmp_path):
    path = str(tmp_path / "published")
    schema = "fund string, date date, nav double"
    sinks.insert_absent(spark.createDataFrame([("f", day(0), 1.0)], schema), path, ["fund", "date"])
    sinks.insert_absent(spark.createDataFrame([("f", day(0), 7.0), ("f", day(1), 2.0)], schema), path, ["fund", "date"])
    assert sorted(r["nav"] for r in spark.read.parquet(path).collect()) == [1.0, 2.0]


def test_wrapped_files_and_bad_documents(spark, tmp_path):
    good = {"_fetched_at": "2024-01-01T00:00:00", "data": [{"date": "2020-01-02", "close": 5.0, "changePercent": 1.5}, {"date": "2020-01-03", "close": None}]}
    (tmp_path / "BRK.B.json").write_text(json.dumps(good, indent=1))
    (tmp_path / "BAD.json").write_text("{ not json")
    got = documents.map_prices(documents.read_documents(spark, str(tmp_path / "*.json"), "prices")).orderBy("date").collect()
    assert [(r["symbol"], r["close"], r["change_pct"]) for r in got] == [("BRK.B", 5.0, 1.5), ("BRK.B", None, None)]


def test_unknown_macro_text_drops(spark):
    o = spark.createDataFrame([(day(0), "X1", "1.5"), (day(1), "X1", "."), (day(2), "ZZ", "3")], "date date, series_id string, value string")
    assert [(r["series"], r["value"]) for r in documents.map_macro(o, {"X1": "x"}, "s").collect()] == [("x", 1.5)]


def test_news_merges_by_address_or_title(spark):
    schema = "symbol string, url string, publishedDate string, title string, body string"
    old = spark.createDataFrame([("A", "u1", "d1", "t1", "old"), ("A", None, "d2", "t2", "old"), ("A", "u3", "d3", "t3", "old")], schema)
    new = spark.createDataFrame([("A", "u1", "d9", "t9", "new"), ("A", "", "d2", "t2", "new")], schema)
    got = sorted(r["body"] for r in sinks.merge_history(old, new, "news").collect())
    assert got == ["new", "new", "old"]


def test_sandbox_hides_the_future_and_other_sectors(spark, make_bars):
    b = make_bars(A=[1, 2, 3], B=[4, 5, 6], X=[7, 8, 9])
    p = spark.createDataFrame([("A", "T"), ("B", "U"), ("X", None)], "symbol string, sector string")
    got = lookup.sandbox({"prices": b}, "select symbol, max(date) as d from {prices} group by symbol", day(1), ["T"], p, ["X"]).collect()
    assert sorted((r["symbol"], r["d"]) for r in got) == [("A", day(1)), ("X", day(1))]
    with pytest.raises(ValueError):
        lookup.sandbox({"prices": b}, "drop table x", day(1))
    with pytest.raises((ParseException, ValueError)):
        lookup.sandbox({"prices": b}, "with x as (select 1) insert into t select * from x", day(1))
    late = lookup.sandbox({"trades": b.withColumnRenamed("date", "transaction_date")}, "select max(transaction_date) as d from {trades}", day(1), dates={"trades": "transaction_date"})
    assert late.first()["d"] == day(1)


def test_split_ranks_equal_the_window_for_nan_null_and_dates(spark):
    rows = [(i % 2, v, day(i)) for i, v in enumerate([float("nan"), 2.0, 1.0, None, 2.0, float("nan"), -1.0, None, 5.0])]
    df = spark.createDataFrame(rows, "g int, v double, d date")
    for order in (["v", "d"], ["d", "v"]):
        for down in (False, True):
            plans = [ranks.ordinal(df, ["g"], order, descending=down, strategy=s, group_rows=1) for s in ("window", "split")]
            a, b = (sorted((r["g"], r["d"], r["rn"]) for r in p.collect()) for p in plans)
            assert a == b


def test_sandbox_reads_nothing_but_its_tables(spark, make_bars, tmp_path):
    b = make_bars(A=[1, 2, 3], B=[4, 5, 6])
    path = str(tmp_path / "bars")
    b.write.parquet(path)
    b.createOrReplaceTempView("open_view")
    spark.read.parquet(path).write.saveAsTable("open_table")
    run = lambda sql, **kw: lookup.sandbox({"prices": spark.read.parquet(path)}, sql, day(1), **kw)
    try:
        for text in (
            f"select * from parquet.`{path}`", "select * from open_view", "select * from open_table", "select * from default.open_table", "select * from range(5)",
            "select * from {prices} where close in (select close from open_view)", "select (select max(date) from open_table) as d", "with x as (select * from open_view) select * from x",
            "with prices as (select 1) select * from open_view", "select 1) union all (select 1", "select * from {prices} union all select * from open_view",
            "select reflect('java.lang.System', 'getProperty', 'user.home')", "select * from {other}", "select * from {prices} p join lateral (select * from open_table) o",
            "select exists (select 1 from open_view) as x", "select * from explode(array(1))", "show tables", "select * from {prices} /* open",
        ):
            with pytest.raises((ValueError, ParseException, AnalysisException)):
                run(text).collect()
    finally:
        spark.sql("drop table open_table")
        spark.catalog.dropTempView("open_view")
    for text, n in (
        ("select * from {prices}", 4), ("with x as (select * from {prices}), y as (select * from x) select * from y join x using (symbol, date) -- end", 4),
        ("select a.symbol from {prices} a where a.date = (select max(date) from {prices})", 2), ("select 1 as one", 1), ("select * from values (1), (2) as v(a)", 2),
    ):
        got = run(text)
        assert got.count() == n and not any(r["truncated"] for r in got.collect())
    cut = run("select * from {prices}", cap=3).collect()
    assert len(cut) == 3 and all(r["truncated"] for r in cut)
    assert not [v for v in spark.catalog.listTables() if v.name.startswith("sandbox_")]


def test_grouped_features_share_the_panel_shuffle(spark, make_bars):
    import numpy as np
    import pyarrow as pa

    from pitfactors.operators import features

    rng = np.random.default_rng(4)
    b = make_bars(A=list(100 + rng.normal(0, 1, 400).cumsum()), B=[5.0] * 30, C=[1.0, 2.0])
    panel = lambda bars, names: features.panel(bars, None, None, None, None, None, names, False)
    got = panel(b, ["rsi_14", "ret_1m"])
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    native = {(r.symbol, r.date): r.rsi for r in features.rsi(b).collect()}
    mine = {(r.symbol, r.date): r.rsi_14 for r in got.collect()}
    assert len(mine) == 432 and {k: v for k, v in mine.items() if v is not None} == native
    cut = {(r.symbol, r.date): r.rsi_14 for r in panel(b.filter(b.date < day(200)), ["rsi_14"]).collect()}  # no look-ahead
    assert cut == {k: v for k, v in mine.items() if k[1] < day(200)}

    def sums(t):
        return pa.table({"up_to": pa.array(np.cumsum(t.column("close").to_numpy())), "n": pa.array(range(1, len(t) + 1))})

    try:
        features.register_grouped("totals", sums, ("close",), ["up_to", "n"])
        features.register_grouped("mean", lambda t: pa.table({"mean": pa.array(t.column("up_to").to_numpy() / t.column("n").to_numpy())}), ("up_to", "n"))
        row = [r for r in panel(b, ["mean"]).collect() if r.symbol == "C" and r.date == day(1)]
        assert row[0].mean == 1.5
        with pytest.raises(ValueError):
            features.register_grouped("early", sums, ("later_feature",))
        with pytest.raises(ValueError):
            features.register_grouped("mean", sums)
    finally:
        for name in ("up_to", "n", "mean"):
            features.REGISTRY.pop(name, None)
        for name in ("totals", "mean"):
            features.GROUPED.pop(name, None)


def test_smoothed_equals_the_recursion():
    import numpy as np

    from pitfactors.operators.features import smoothed

    rng = np.random.default_rng(8)
    for n, period in ((0, 3), (2, 3), (3, 3), (20_000, 14), (9000, 2), (50, 1)):
        x = rng.normal(0, 1, n) ** 2
        want, a = [], None
        for i, v in enumerate(x):
            a = x[:period].mean() if i == period - 1 else (a * (period - 1) + v) / period if a is not None else None
            want.append(np.nan if a is None else a)
        assert np.allclose(smoothed(x, period), want, equal_nan=True, rtol=1e-9)
