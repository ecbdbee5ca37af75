"""First crossings against a scan over all later bars."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitfactors.functions import crossing, scale
from pitfactors.operators import events, ledger
from tests.conftest import day


def test_first_equals_a_scan():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 7, 8, 9, 100):
        close = r.integers(1, 12, n).astype(float)
        close[r.random(n) < 0.1] = np.nan
        t = crossing.Track(np.arange(n), close)
        start, level = r.integers(0, n + 1, 200), r.integers(0, 13, 200).astype(float)
        up = t.first("max", start, lambda x, q: x >= level[q])
        low = t.first("min", start, lambda x, q: x <= level[q])
        scan = lambda ok: [next((j for j in range(s, n) if ok(close[j], v)), n) for s, v in zip(start, level)]
        assert up.tolist() == scan(lambda x, v: x >= v) and low.tolist() == scan(lambda x, v: x <= v)


def test_fall_from_peak_equals_a_scan():
    r = np.random.default_rng(2)
    for n in (0, 1, 5, 60):
        for keep in (0.5, 0.9, 1.0, 1.2):
            close = r.integers(1, 20, n).astype(float)
            want = []
            for i in range(n):
                want.append(next((j for j in range(i, n) if close[j] <= keep * close[i : j + 1].max()), n))
            assert crossing.Track(np.arange(n), close).fall_from_peak(keep).tolist() == want


def scan_exit(entry, bars, stop, take, days, trail, exits):
    _, symbol, date, price = entry
    high = price
    for d, close in bars.get(symbol, []):
        if d <= date:
            continue
        high = max(high, close) if price is not None else close
        gain = None if price is None else (close - price) / price * 100
        if gain is not None and gain <= stop:
            return d, close, gain, "stop_loss"
        if gain is not None and trail is not None and high > price * (1 + trail[1] / 100) and close <= high * (1 - trail[0] / 100):
            return d, close, gain, "take_profit"
        if gain is not None and trail is None and take is not None and gain >= take:
            return d, close, gain, "take_profit"
        if (d - date).days >= days:
            return d, close, gain, "time_stop"
        if (symbol, d) in exits:
            return d, close, gain, "fundamental_exit"
    return None, None, None, "open"


@pytest.mark.parametrize("pieces", [False, True])
def test_exits_equal_a_scan(spark, monkeypatch, pieces):
    if pieces:  # a hot symbol: its entries are cut into pieces, each with the symbol's bars
        monkeypatch.setattr(crossing, "PIECE_ROWS", 20)
        monkeypatch.setattr(scale, "SMALL_INPUT_BYTES", 0)
    r = random.Random(3)
    bars = {s: sorted((day(i), float(r.randrange(5, 30))) for i in r.sample(range(200), 120)) for s in ("A", "B", "C")}
    entries = [(i, r.choice("AAAABZ"), day(r.randrange(-5, 210)), r.choice([None, 10.0, 12.0, 20.0])) for i in range(150)]
    exits = {(s, d) for s, rows in bars.items() for d, _ in rows if r.random() < 0.03} | {("A", day(1000))}
    e = spark.createDataFrame(entries, "entry_id int, symbol string, entry_date date, entry_price double")
    b = spark.createDataFrame([(s, *x) for s, rows in bars.items() for x in rows], "symbol string, date date, close double").repartition(3)
    x = spark.createDataFrame(sorted(exits), "symbol string, date date")
    for stop, take, days, trail, use in ((-25.0, 60.0, 40, None, True), (-60.0, None, 5000, (20.0, 20.0), False), (-60.0, None, 30, (20.0, -10.0), True), (-90.0, None, 0, None, False)):
        got = {g.entry_id: (g.exit_date, g.exit_price, g.pnl_pct, g.reason) for g in ledger.first_touch(e, b, stop, take, days, trail, x if use else None).collect()}
        assert got == {v[0]: scan_exit(v, bars, stop, take, days, trail, exits if use else set()) for v in entries}


def test_no_row_is_made_for_the_bars_between(spark, make_bars):
    b = make_bars(A=[100.0, 50.0] + [60.0] * 300 + [100.0])
    found = events.recoveries(events.selloffs(b, -40.0), b)
    assert [(r.recovery_date, r.recovered, r.days_from_trough) for r in found.collect()] == [(day(302), True, 301)]
    near = events.recoveries(events.selloffs(b, -40.0), b, "peak", 300).collect()
    assert [(r.recovery_date, r.target_price) for r in near] == [(None, None)]
    at = events.recoveries(events.selloffs(b, -40.0), b, "peak", 301).collect()
    assert at[0].recovered
    assert "Join" not in found.select("symbol", "recovery_date")._jdf.queryExecution().analyzed().toString().split("CoGroup")[0]
    assert events.recoveries(events.selloffs(b.where("false"), -40.0), b).count() == 0
    gone = events.recoveries(events.selloffs(b, -40.0), b.where(F.lit(False))).collect()
    assert len(gone) == 1 and not gone[0].recovered and isinstance(gone[0].trough_date, dt.date)
