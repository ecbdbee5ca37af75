"""Price-event detectors and quarterly signals over the driver's tables."""

from pyspark.sql import functions as F

from pitfactors.operators import events as E
from pitfactors.operators import quarterly as G
from pitfactors.plans.catalogue import query
from pitfactors.plans.features_q import RSI_SQL, RSI_VIEWS
from pitfactors.plans.joins_q import AVAILABLE
from pitfactors.sources import adapters as A

OWN = "PARTITION BY symbol ORDER BY date"


def r(expr, n):
    return f"floor(({expr}) * 1e{n} + 0.5) / 1e{n}"


PEAK_ALL = f"""SELECT b.symbol, b.date, b.close, b.peak, max(h.date) AS peak_date, {r('(b.close - b.peak) / b.peak * 100', 2)} AS drawdown_pct FROM
  (SELECT symbol, date, close, max(close) OVER ({OWN}) AS peak FROM bars) b JOIN bars h ON h.symbol = b.symbol AND h.date <= b.date AND h.close = b.peak
  GROUP BY ALL"""
PEAK_52 = f"""SELECT b.symbol, b.date, b.close, b.peak, min(h.date) AS peak_date, {r('(b.close - b.peak) / b.peak * 100', 2)} AS drawdown_pct FROM
  (SELECT symbol, date, close, max(close) OVER ({OWN} ROWS 252 PRECEDING) AS peak, first_value(date) OVER ({OWN} ROWS 252 PRECEDING) AS lo FROM bars) b
  JOIN bars h ON h.symbol = b.symbol AND h.date <= b.date AND h.date >= b.lo AND h.close = b.peak GROUP BY ALL"""
PEAK_YTD = f"""SELECT b.symbol, b.date, b.close, b.peak, max(h.date) AS peak_date, {r('(b.close - b.peak) / b.peak * 100', 2)} AS drawdown_pct FROM
  (SELECT symbol, date, close, max(close) OVER (PARTITION BY symbol, year(date) ORDER BY date) AS peak FROM bars) b
  JOIN bars h ON h.symbol = b.symbol AND h.date <= b.date AND year(h.date) = year(b.date) AND h.close = b.peak GROUP BY ALL"""


@query("e01_peak_all_time", PEAK_ALL, "close peak")
def e01(spark, sf):
    return E.running_peak(A.bars(spark, sf))


@query("e01_peak_52w", PEAK_52, "close peak")
def e01b(spark, sf):
    return E.running_peak(A.bars(spark, sf), "52w")


@query("e01_peak_ytd", PEAK_YTD, "close peak")
def e01c(spark, sf):
    return E.running_peak(A.bars(spark, sf), "ytd")


@query("e01_peak_from_date", PEAK_ALL.replace("FROM bars)", "FROM bars WHERE date >= DATE '1999-01-01')").replace("h.date <= b.date", "h.date <= b.date AND h.date >= DATE '1999-01-01'"), "close peak")
def e01d(spark, sf):
    return E.running_peak(A.bars(spark, sf), "1999-01-01")


# A state machine walked row by row: an open event keeps its peak until the close is back.
def _selloff_views(peak, thr):
    return {
        "pk": peak,
        "pkn": "SELECT pk.*, row_number() OVER (PARTITION BY symbol ORDER BY date) AS rn FROM pk",
        "walk": f"""SELECT symbol, rn, CASE WHEN drawdown_pct <= {thr} THEN rn END AS ev, CASE WHEN drawdown_pct <= {thr} THEN peak END AS fp, FALSE AS closed FROM pkn WHERE rn = 1
  UNION ALL SELECT w.symbol, p.rn,
    CASE WHEN w.ev IS NOT NULL AND NOT w.closed THEN w.ev WHEN p.drawdown_pct <= {thr} THEN p.rn END,
    CASE WHEN w.ev IS NOT NULL AND NOT w.closed THEN w.fp WHEN p.drawdown_pct <= {thr} THEN p.peak END,
    coalesce(w.ev IS NOT NULL AND NOT w.closed AND p.close >= w.fp, FALSE)
  FROM walk w JOIN pkn p ON p.symbol = w.symbol AND p.rn = w.rn + 1""",
        "ends": "SELECT symbol, max(date) AS end_date, arg_max(close, date) AS end_close FROM bars GROUP BY 1",
    }


SELLOFF = f"""SELECT symbol, peak_price, peak_date, trigger_date, trigger_price, trough_price, trough_date,
  {r('(trough_price - peak_price) / peak_price * 100', 2)} AS drawdown_pct,
  coalesce(rec_close, end_close) AS current_price, coalesce(rec_date, end_date) AS current_date,
  CASE WHEN rec_date IS NOT NULL THEN 'recovered' WHEN end_close > trough_price THEN 'recovering' ELSE 'active' END AS status
  FROM (SELECT w.symbol, w.ev, arg_min(p.peak, p.rn) AS peak_price, arg_min(p.peak_date, p.rn) AS peak_date, min(p.date) AS trigger_date,
    arg_min(p.close, p.rn) AS trigger_price, min(p.close) AS trough_price, arg_min(p.date, struct_pack(a := p.close, b := p.date)) AS trough_date,
    max(CASE WHEN w.closed THEN p.date END) AS rec_date, max(CASE WHEN w.closed THEN p.close END) AS rec_close
    FROM walk w JOIN pkn p USING (symbol, rn) WHERE w.ev IS NOT NULL GROUP BY 1, 2) JOIN ends USING (symbol)"""
EV = "peak_price trigger_price trough_price current_price"


@query("e02_selloffs_all_time", SELLOFF, EV, _selloff_views(PEAK_ALL, -40))
def e02(spark, sf):
    return E.selloffs(A.bars(spark, sf), -40.0)


@query("e02_selloffs_52w", SELLOFF, EV, _selloff_views(PEAK_52, -50))
def e02b(spark, sf):
    return E.selloffs(A.bars(spark, sf), -50.0, "52w")


@query("e02_selloffs_ytd", SELLOFF, EV, _selloff_views(PEAK_YTD, -40))
def e02c(spark, sf):
    return E.selloffs(A.bars(spark, sf), -40.0, "ytd")


def _recovery(target, within=None):
    limit = f" AND b.date <= e.trough_date + {within}" if within else ""
    return f"""SELECT e.*, v.recovery_date, v.recovery_price, CASE WHEN v.recovery_date IS NOT NULL THEN {r('e.target', 2)} END AS target_price,
  CAST(v.recovery_date - e.trough_date AS INTEGER) AS days_from_trough, v.recovery_date IS NOT NULL AS recovered
  FROM (SELECT *, {target} AS target FROM evt) e LEFT JOIN (SELECT e.symbol, e.trough_date, e.peak_date, min(b.date) AS recovery_date, arg_min(b.close, b.date) AS recovery_price
   FROM (SELECT *, {target} AS target FROM evt) e JOIN bars b ON b.symbol = e.symbol AND b.date > e.trough_date AND b.close >= e.target{limit} GROUP BY 1, 2, 3) v
  USING (symbol, trough_date, peak_date)"""


RV = {**_selloff_views(PEAK_ALL, -40), "evt": SELLOFF}


@query("e03_recoveries", f"SELECT * EXCLUDE (target) FROM ({_recovery('peak_price * 0.5', 90)})", EV + " recovery_price", RV)
def e03(spark, sf):
    b = A.bars(spark, sf)
    return E.recoveries(E.selloffs(b, -40.0), b, "-50% from peak", 90)


@query("e04_recovery_target", f"SELECT * EXCLUDE (target) FROM ({_recovery('trough_price * (1 + 10.0::DOUBLE / 100)')})", EV + " recovery_price", RV)
def e04(spark, sf):
    b = A.bars(spark, sf)
    return E.recoveries(E.selloffs(b, -40.0), b, "+10% from bottom")


@query("e03_recoveries_ever", f"SELECT * EXCLUDE (target) FROM ({_recovery('peak_price')})", EV + " recovery_price", RV)
def e03b(spark, sf):
    """The return to the peak, however late."""
    b = A.bars(spark, sf)
    return E.recoveries(E.selloffs(b, -40.0), b)


@query("e10_scan_selloffs", f"SELECT * EXCLUDE (target) FROM ({_recovery('peak_price * 0.5', 90)}) WHERE recovered", EV + " recovery_price", RV)
def e10(spark, sf):
    return E.scan_selloffs(A.bars(spark, sf), -40.0, condition="-50% from peak", within_days=90)


def _period_views(n, thr):
    return {
        "nb": f"SELECT symbol, date, close, row_number() OVER ({OWN}) AS rn, count(*) OVER (PARTITION BY symbol) AS nb FROM bars",
        "inwin": f"""SELECT a.symbol, a.rn AS i, a.date AS signal_date, a.close AS sc, b.rn, b.date, b.close,
  max(b.close) OVER (PARTITION BY a.symbol, a.rn ORDER BY b.rn) AS pk
  FROM nb a JOIN nb b ON b.symbol = a.symbol AND b.rn BETWEEN a.rn - {n - 1} AND a.rn WHERE a.rn >= {n} AND a.nb > {n}""",
        "lowpt": """SELECT symbol, i, signal_date, sc, arg_min(struct_pack(rn := rn, date := date, close := close, pk := pk, dd := (close - pk) / pk * 100),
   struct_pack(a := (close - pk) / pk * 100, b := rn)) AS t FROM inwin GROUP BY 1, 2, 3, 4""",
        "drops": f"""SELECT l.symbol, l.signal_date, l.sc AS close, max(w.date) AS peak_date, l.t.pk AS peak_price, l.t.date AS trough_date, l.t.close AS trough_price,
  {r('l.t.dd', 2)} AS drawdown_pct, l.t.rn AS trn FROM lowpt l JOIN inwin w ON w.symbol = l.symbol AND w.i = l.i AND w.rn <= l.t.rn AND w.close = l.t.pk
  WHERE l.t.dd <= {thr} AND l.t.dd < 0 GROUP BY ALL""",
        "anchors": f"""SELECT symbol, min(trn) AS a FROM drops GROUP BY 1 UNION ALL
  SELECT n.symbol, (SELECT min(d.trn) FROM drops d WHERE d.symbol = n.symbol AND d.trn > n.a + {n}) AS a FROM anchors n
  WHERE EXISTS (SELECT 1 FROM drops d WHERE d.symbol = n.symbol AND d.trn > n.a + {n})""",
        "evt": """SELECT symbol, arg_min(peak_date, k) AS peak_date, arg_min(peak_price, k) AS peak_price, arg_min(trough_date, k) AS trough_date,
  arg_min(trough_price, k) AS trough_price, min(drawdown_pct) AS drawdown_pct, min(signal_date) AS first_signal, max(signal_date) AS last_signal,
  count(DISTINCT signal_date) AS signal_count FROM (SELECT d.*, (SELECT max(a.a) FROM anchors a WHERE a.symbol = d.symbol AND a.a <= d.trn) AS anchor,
   struct_pack(x := drawdown_pct, y := trough_date, z := signal_date) AS k FROM drops d) GROUP BY symbol, anchor""",
    }


PD = _period_views(21, -80)
PEV = "peak_price trough_price"


@query("e05_period_drops", "SELECT * EXCLUDE (trn) FROM drops", "close " + PEV, PD)
def e05(spark, sf):
    return E.period_drops(A.bars(spark, sf), 21, -80.0)


@query("e06_current_drops",
       f"""SELECT b.symbol, b.date, b.close, min(h.date) AS peak_date, b.pk AS peak_price, {r('(b.close - b.pk) / b.pk * 100', 2)} AS drawdown_pct
  FROM (SELECT symbol, date, close, max(close) OVER w AS pk, min(date) OVER w AS lo, count(*) OVER w AS k FROM bars WINDOW w AS ({OWN} ROWS BETWEEN 63 PRECEDING AND 1 PRECEDING)) b
  JOIN bars h ON h.symbol = b.symbol AND h.date >= b.lo AND h.date < b.date AND h.close = b.pk WHERE b.k = 63 AND (b.close - b.pk) / b.pk * 100 <= -70 GROUP BY ALL""", "close peak_price")
def e06(spark, sf):
    return E.current_drops(A.bars(spark, sf), 63, -70.0)


@query("e07_period_drop_events", "SELECT * FROM evt", PEV, PD)
def e07(spark, sf):
    b = A.bars(spark, sf)
    return E.period_drop_events(E.period_drops(b, 21, -80.0), b, 21)


PREC = f"SELECT * EXCLUDE (target) FROM ({_recovery('trough_price * (1 + 50.0::DOUBLE / 100)', 10)})"


@query("e08_period_drops_recovery", PREC, PEV + " recovery_price", PD)
def e08(spark, sf):
    return E.period_drops_with_recovery(A.bars(spark, sf), 21, -80.0, "+50% from bottom", 10)


@query("e09_daily_drops",
       f"""SELECT symbol, date, close, prev_date, prev_close, {r('(close - prev_close) / prev_close * 100', 2)} AS change_pct FROM
  (SELECT symbol, date, close, lag(date) OVER w AS prev_date, lag(close) OVER w AS prev_close FROM bars WINDOW w AS ({OWN}))
  WHERE (close - prev_close) / prev_close * 100 <= -50""", "close prev_close")
def e09(spark, sf):
    return E.daily_drops(A.bars(spark, sf), -50.0)


@query("e11_scan_period_drops", "SELECT * FROM evt", PEV,
       {**PD, "nb": PD["nb"].replace("FROM bars", "FROM bars WHERE date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31'")})
def e11(spark, sf):
    return E.scan_period_drops(A.bars(spark, sf), 21, -80.0, "1997-01-01", "1999-12-31")


@query("e08_period_drops_recovery_ever", f"SELECT * EXCLUDE (target) FROM ({_recovery('trough_price * (1 + 50.0::DOUBLE / 100)')})", PEV + " recovery_price", PD)
def e08b(spark, sf):
    """Period drops with their recovery at any distance."""
    return E.period_drops_with_recovery(A.bars(spark, sf), 21, -80.0, "+50% from bottom")


@query("e12_scan_period_drops_recovery", PREC + " WHERE recovered", PEV + " recovery_price",
       {**PD, "nb": PD["nb"].replace("FROM bars", "FROM bars WHERE date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31'")})
def e12(spark, sf):
    return E.scan_period_drops(A.bars(spark, sf), 21, -80.0, "1997-01-01", "1999-12-31", "+50% from bottom", 10, True)


@query("e13_scan_daily_drops",
       f"""SELECT symbol, date, close, prev_date, prev_close, {r('(close - prev_close) / prev_close * 100', 2)} AS change_pct FROM
  (SELECT symbol, date, close, lag(date) OVER w AS prev_date, lag(close) OVER w AS prev_close FROM bars WINDOW w AS ({OWN}))
  WHERE (close - prev_close) / prev_close * 100 <= -50 AND date BETWEEN DATE '1998-01-01' AND DATE '1998-06-30'""", "close prev_close")
def e13(spark, sf):
    return E.daily_drops(A.bars(spark, sf), -50.0, "1998-01-01", "1998-06-30")


@query("e14_relative_outperformance",
       f"""SELECT x.symbol, x.date, {r('(x.close / x.c0 - 1) * 100', 2)} AS own_return_pct, {r('(m1.close / m0.close - 1) * 100', 2)} AS bench_return_pct,
  {r('(x.close / x.c0 - 1) * 100 - (m1.close / m0.close - 1) * 100', 2)} AS spread_pp FROM
  (SELECT symbol, date, close, lag(close, 126) OVER w AS c0, lag(date, 126) OVER w AS d0 FROM bars WINDOW w AS ({OWN})) x
  JOIN market m1 ON m1.date = x.date JOIN market m0 ON m0.date = x.d0 WHERE (x.close / x.c0 - 1) * 100 - (m1.close / m0.close - 1) * 100 >= 20""")
def e14(spark, sf):
    return E.relative_outperformance(A.bars(spark, sf), A.market(spark, sf))


CONVICTION = f"""SELECT symbol, date, floor(sv) AS short_vol, floor(lv) AS long_vol, {r('sv / lv', 3)} AS ratio, close, {r('pa', 2)} AS price_avg FROM
  (SELECT symbol, date, close, avg(volume) OVER s AS sv, avg(volume) OVER l AS lv, avg(close) OVER l AS pa, count(*) OVER l AS k FROM bars
   WINDOW s AS ({OWN} ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING), l AS ({OWN} ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING))
  WHERE k = 252 AND sv / lv <= 0.9 AND close > pa"""


@query("e15_volume_conviction", CONVICTION, "close")
def e15(spark, sf):
    out = E.volume_conviction(A.bars(spark, sf), max_ratio=0.9)
    return out.withColumns({c: F.col(c).cast("double") for c in ("short_vol", "long_vol")})


@query("e16_rsi", RSI_SQL, "rsi:2", RSI_VIEWS)
def e16(spark, sf):
    from pitfactors.operators import features

    return features.rsi(A.bars(spark, sf), 14)


MOMENTUM = {"mom": f"""SELECT symbol, date, {r('(row_number() OVER (PARTITION BY date ORDER BY ret, symbol) - 1) / (count(*) OVER (PARTITION BY date) - 1) * 100', 1)} AS momentum_rank,
  count(*) OVER (PARTITION BY date) AS n FROM (SELECT b.symbol, b.date, (b.close - f.close) / f.close AS ret FROM bars b JOIN calendar c ON c.date = b.date
  JOIN calendar d ON d.idx = c.idx - 63 JOIN bars f ON f.symbol = b.symbol AND f.date = d.date)"""}


@query("e17_momentum_rank", "SELECT symbol, date, momentum_rank FROM mom WHERE n > 1", "momentum_rank", MOMENTUM)
def e17(spark, sf):
    return E.momentum_rank(A.bars(spark, sf))


CROSS = f"""SELECT symbol, date, CAST(sign(f - s) AS INTEGER) AS ma_signal FROM (SELECT symbol, date, row_number() OVER ({OWN}) AS rn,
  avg(close) OVER ({OWN} ROWS 49 PRECEDING) AS f, avg(close) OVER ({OWN} ROWS 199 PRECEDING) AS s FROM bars) WHERE rn > 200"""


@query("e18_ma_crossover", CROSS)
def e18(spark, sf):
    return E.ma_crossover(A.bars(spark, sf))


CAPITULATION = f"""SELECT symbol, date, {r('volume / av', 2)} AS volume_ratio FROM (SELECT symbol, date, close, volume, lag(close) OVER ({OWN}) AS pc,
  row_number() OVER ({OWN}) AS rn, avg(volume) OVER ({OWN} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS av FROM bars) WHERE rn > 20 AND close < pc AND volume / av >= 3"""


@query("e19_volume_capitulation", CAPITULATION)
def e19(spark, sf):
    return E.volume_capitulation(A.bars(spark, sf))


@query("e20_recent_peak", f"SELECT symbol, date, max(close) OVER ({OWN} ROWS 127 PRECEDING) AS recent_peak FROM bars", "recent_peak")
def e20(spark, sf):
    return E.recent_peak(A.bars(spark, sf), 64)


ATR = f"""SELECT symbol, date, close, CASE WHEN count(tr) OVER w = 14 THEN avg(tr) OVER w END AS atr FROM (SELECT symbol, date, close,
  CASE WHEN pc IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr FROM (SELECT *, lag(close) OVER ({OWN}) AS pc FROM bars))
  WINDOW w AS ({OWN} ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING)"""
LOGRET = {"lr": f"SELECT symbol, date, close, row_number() OVER ({OWN}) AS rn, ln(close / lag(close) OVER ({OWN})) AS lr FROM bars"}


@query("e21_atr", ATR, "close atr")
def e21(spark, sf):
    return E.atr(A.bars(spark, sf))


VOL = f"SELECT symbol, date, close, CASE WHEN count(lr) OVER w = 20 THEN stddev_samp(lr) OVER w END AS vol FROM lr WINDOW w AS ({OWN} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"


@query("e22_realised_vol", VOL, "close vol", LOGRET)
def e22(spark, sf):
    return E.realised_vol(A.bars(spark, sf))


@query("e22_ewma_vol",
       f"""SELECT a.symbol, a.date, a.close, CASE WHEN count(b.lr) = 20 THEN sqrt(any_value(v.seed) * pow(0.94::DOUBLE, 20) + sum(0.06::DOUBLE * b.lr * b.lr * pow(0.94::DOUBLE, a.rn - 1 - b.rn))) END AS vol
  FROM lr a JOIN (SELECT symbol, date, var_pop(lr) OVER ({OWN} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS seed FROM lr) v USING (symbol, date)
  LEFT JOIN lr b ON b.symbol = a.symbol AND b.rn BETWEEN a.rn - 20 AND a.rn - 1 GROUP BY 1, 2, 3""", "close vol", LOGRET)
def e22b(spark, sf):
    return E.realised_vol(A.bars(spark, sf), method="ewma")


@query("e23_atr_stops", f"SELECT symbol, date, close, CASE WHEN close - 2 * atr > 0 THEN close - 2 * atr END AS stop_price, close + 3 * atr AS take_price FROM ({ATR})", "close stop_price take_price")
def e23(spark, sf):
    return E.stop_levels(E.atr(A.bars(spark, sf)))


@query("e23_vol_stops", f"SELECT symbol, date, close, CASE WHEN close * (1 - 2 * vol) > 0 THEN close * (1 - 2 * vol) END AS stop_price, close * (1 + 3 * vol) AS take_price FROM ({VOL})", "close stop_price take_price", LOGRET)
def e23b(spark, sf):
    return E.stop_levels(E.realised_vol(A.bars(spark, sf)), "vol")


# ---------------------------------------------------------------- quarterly signals

QV = {
    "avail": AVAILABLE,
    "yoy": f"""SELECT a.symbol, a.date, a.period, a.available_from AS signal_date, a.revenue, {r('(a.revenue / b.revenue - 1) * 100', 2)} AS revenue_yoy,
  {r('a.net_income / a.revenue * 100', 2)} AS net_margin, {r('a.operating_income / a.revenue * 100', 2)} AS op_margin,
  {r('(a.net_income / a.revenue * 100 - b.net_income / b.revenue * 100) * 100', 0)} AS net_margin_yoy_bps,
  {r('(a.operating_income / a.revenue * 100 - b.operating_income / b.revenue * 100) * 100', 0)} AS op_margin_yoy_bps
  FROM avail a LEFT JOIN avail b ON b.symbol = a.symbol AND b.period = a.period AND b.fiscal_year = a.fiscal_year - 1""",
    "valid": f"""SELECT *, lag(revenue_yoy) OVER ({OWN}) AS prev_yoy, lag(net_margin) OVER ({OWN}) AS prev_margin, row_number() OVER ({OWN}) AS rn FROM yoy WHERE revenue_yoy IS NOT NULL""",
}


def _streaks(cond):
    # Streak = rows since the last row where the condition failed.
    return {**QV, "runs": f"""SELECT *, rn - coalesce(max(CASE WHEN NOT coalesce({cond}, FALSE) THEN rn END) OVER ({OWN}), 0) AS streak FROM valid"""}


def yoy(spark, sf):
    inc = A.statements(spark, sf)
    return G.year_on_year(G.quarters(inc, A.earnings(inc)))


@query("g01_quarters", "SELECT symbol, date, fiscal_year, period, available_from AS signal_date, revenue, net_income, operating_income FROM avail",
       "revenue:4 net_income:4 operating_income:4", QV)
def g01(spark, sf):
    inc = A.income(spark, sf)
    return G.quarters(inc, A.earnings(inc))


@query("g02_year_on_year", "SELECT * FROM yoy", "revenue:4", QV)
def g02(spark, sf):
    return yoy(spark, sf)


@query("g03_revenue_breakouts", "SELECT symbol, signal_date, date, period, revenue_yoy, revenue, net_margin, op_margin FROM yoy WHERE revenue_yoy >= 15", "revenue:4", QV)
def g03(spark, sf):
    return G.revenue_breakouts(yoy(spark, sf), 15.0)


@query("g04_revenue_acceleration", "SELECT symbol, signal_date, date, period, revenue_yoy, prev_yoy AS prev_revenue_yoy, streak FROM runs WHERE streak >= 2",
       views=_streaks("revenue_yoy > prev_yoy"))
def g04(spark, sf):
    return G.revenue_acceleration(yoy(spark, sf))


MARGIN = "SELECT symbol, signal_date, date, period, net_margin AS margin, net_margin_yoy_bps AS margin_yoy_bps, streak FROM runs WHERE streak >= 2"


@query("g05_margin_expansion", MARGIN, views=_streaks("net_margin_yoy_bps > 0 AND net_margin > prev_margin"))
def g05(spark, sf):
    return G.margin_expansion(yoy(spark, sf))


@query("g06_margin_turnaround", MARGIN, views=_streaks("net_margin_yoy_bps >= 5"))
def g06(spark, sf):
    return G.margin_turnaround(yoy(spark, sf), threshold_bps=5.0)


@query("g07_revenue_deceleration",
       """SELECT symbol, signal_date, date, period, revenue_yoy, prev_yoy AS prev_revenue_yoy, net_margin_yoy_bps AS margin_yoy_bps, streak FROM runs a WHERE streak >= 2
  AND EXISTS (SELECT 1 FROM runs b WHERE b.symbol = a.symbol AND b.rn <= a.rn AND b.rn > a.rn - a.streak AND b.net_margin_yoy_bps < 0)""",
       views=_streaks("revenue_yoy < prev_yoy"))
def g07(spark, sf):
    return G.revenue_deceleration(yoy(spark, sf))


@query("g08_margin_collapse", MARGIN, views=_streaks("net_margin_yoy_bps <= -5"))
def g08(spark, sf):
    return G.margin_collapse(yoy(spark, sf), threshold_bps=-5.0)
