"""Rows at the edges: NULL key parts, total losses, names without a sector."""

import random
import time

import pytest

from pitfactors.functions import folds
from pitfactors.operators import evaluation, ledger, nav
from pitfactors.sources import documents, sinks
from tests.conftest import day


def test_history_keeps_rows_with_a_null_key_part(spark):
    schema = "symbol string, date date, grading_company string, grade string"
    stored = spark.createDataFrame([("A", None, None, "old")], "symbol string, date date, grading_company string, grade string")
    stored = stored.unionByName(spark.sql("SELECT 'A' symbol, date'2020-01-02' date, CAST(NULL AS string) grading_company, 'kept' grade"))
    fetched = spark.createDataFrame([("A", None, "X", "undated")], schema).unionByName(spark.sql("SELECT 'A' symbol, date'2020-01-03' date, CAST(NULL AS string) grading_company, 'new' grade"))
    got = sorted(r.grade for r in sinks.merge_history(stored, fetched, "analyst_grades").collect())
    assert got == ["kept", "new", "old"]


def test_insert_absent_compares_null_keys(spark):
    rows = spark.createDataFrame([("a", None), ("b", 1)], "k string, n int")
    more = spark.createDataFrame([("a", None), ("b", 2)], "k string, n int")
    assert [tuple(r) for r in sinks.absent(rows, more, ["k", "n"]).collect()] == [("b", 2)]


def test_total_loss_is_compounded(spark):
    returns = spark.createDataFrame([("s", 0.01)] * 99 + [("s", -1.0)], "series_id string, ret double")
    assert nav.return_stats(returns).first().total_return_pct == -100.0
    days = spark.sql("SELECT 's' sleeve, date_add(date'2020-01-01', i) date, CASE i WHEN 1 THEN -1D ELSE 0.5D END ret FROM (SELECT explode(sequence(0, 2)) i)")
    weights = spark.createDataFrame([("s", 1.0)], "sleeve string, weight double")
    assert [r.nav for r in ledger.combined_nav(days, weights).orderBy("date").collect()][1:] == [0.0, 0.0]


def test_names_without_sector_stay(spark):
    rows = spark.createDataFrame([(f"s{i}", 1, None if i % 4 == 0 else "T", float(i), 1.0 + i) for i in range(20)], "symbol string, date int, sector string, value double, market_cap double")
    assert evaluation.neutralise(rows, 2).count() == 20


def test_last_loaded_record_wins(spark, tmp_path):
    schema = "symbol string, date string, close double"
    stored = spark.createDataFrame([("A", "2020-01-01", 1.0), ("B", "2020-01-01", 7.0)], schema)
    fetched = spark.createDataFrame([("A", "2020-01-01", float(i)) for i in range(2, 40)] + [("C", "2020-01-01", 1.0), ("C", "2020-01-01", 0.5)], schema)
    for f in (fetched, fetched.coalesce(2)):
        got = {r.symbol: r.close for r in sinks.merge_history(stored, f, "prices").collect()}
        assert got == {"A": 39.0, "B": 7.0, "C": 0.5}
    path = str(tmp_path / "feed")
    for part in ([("A", "2020-01-01", 5.0)], [("A", "2020-01-01", 4.0), ("A", "2020-01-01", 3.0)]):  # the second file is newer
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    merged = sinks.merge_history(stored, spark.read.parquet(path), "prices")
    assert merged.columns == ["symbol", "date", "close"]
    assert {r.symbol: r.close for r in merged.collect()} == {"A": 3.0, "B": 7.0}


def test_documents_keep_their_order(spark, tmp_path):
    text = '{"_fetched_at": "2024-01-01T00:00:00", "data": [{"date": "2020-01-02", "close": 1}, {"date": "2020-01-02", "close": 2}]}'
    (tmp_path / "A.json").write_text(text)
    fetched = documents.read_documents(spark, str(tmp_path), "prices", position=True).select("symbol", "date", "close", "load_order")
    stored = fetched.drop("load_order").filter("false")
    assert [r.close for r in sinks.merge_history(stored, fetched, "prices").collect()] == [2.0]


def test_upsert_keeps_rows_without_a_date(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "symbol string, date date, v int"
    sinks.upsert_table(spark.createDataFrame([("A", None, 1), ("B", None, 2)], schema), path, ["symbol", "date"])
    sinks.upsert_table(spark.createDataFrame([("C", None, 3), ("B", None, 4)], schema), path, ["symbol", "date"])
    assert sorted((r.symbol, r.v) for r in spark.read.parquet(path).collect()) == [("A", 1), ("B", 4), ("C", 3)]


def test_universe_detail_keeps_all_symbols(spark):
    names = [f"S{i}" for i in range(35)]
    df = spark.sql("SELECT named_struct('universe', named_struct('type', 'symbols', 'sector', CAST(NULL AS string), 'symbols', array(" + ",".join(f"'{n}'" for n in names) + "))) AS config")
    assert df.select(documents.universe_detail().alias("d")).first().d == ",".join(names)
    assert df.select(documents.universe_detail(2).alias("d")).first().d == "S0,S1"


def test_positions_compose_over_blocks(spark, monkeypatch):
    def walk(days):
        held = cost = 0.0
        for bought, paid, sold, n in days:
            if bought > 0:
                held, cost = (bought, paid) if held <= ledger.SHARE_EPS else (held + bought, cost + paid)
            if n:
                left = held - sold
                held, cost = (left, cost * left / held) if left > ledger.SHARE_EPS else (0.0, 0.0)
            yield held, cost

    r = random.Random(6)
    rows, want = [], {}
    for symbol in ("A", "B", "C"):
        days = []
        for i in sorted(r.sample(range(900), 150)):
            trades = [(action, r.choice([1.0, 2.5, 7.0, 0.0005, 40.0]), r.randrange(100, 9000)) for action in r.choice([["BUY"], ["BUY"], ["SELL"], ["BUY", "SELL"], ["SELL", "SELL"]])]
            rows += [(1, symbol, day(i), a, n, cents, 10) for a, n, cents in trades]
            total = lambda a, k: sum(t[k] for t in trades if t[0] == a)  # noqa: E731, B023
            days.append((i, (total("BUY", 1), total("BUY", 2) / 100, total("SELL", 1), sum(t[0] == "SELL" for t in trades))))
        for (i, _), state in zip(days, walk([d for _, d in days])):
            want[symbol, day(i)] = state
    trades = spark.createDataFrame(rows, "book int, symbol string, date date, action string, shares double, amount_cents long, pnl_units long").repartition(3)
    for size, chunk in ((4096, 64), (30, 4), (1, 1)):
        monkeypatch.setattr(folds, "BLOCK_DAYS", size)
        monkeypatch.setattr(folds, "CHUNK", chunk)
        states = ledger.position_states(trades)
        assert "Python" not in states._jdf.queryExecution().executedPlan().toString()
        got = {(x.symbol, x.date): (x.held, x.cost) for x in states.collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-9, abs=1e-9) for k in want)
    assert ledger.position_states(trades.filter("false")).count() == 0
