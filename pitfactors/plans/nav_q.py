"""NAV, benchmark, ledger and fund analytics over the driver's tables."""

from pyspark.sql import functions as F

from pitfactors.operators import asof, calendars
from pitfactors.operators import funds as U
from pitfactors.operators import ledger as L
from pitfactors.operators import nav as N
from pitfactors.plans.catalogue import query
from pitfactors.sources import adapters as A

SER = "PARTITION BY series_id ORDER BY date"
NV = {
    "wnav": "SELECT symbol AS series_id, date, close AS nav FROM wbars",
    "wret": f"SELECT series_id, date, nav, nav / lag(nav) OVER ({SER}) - 1 AS ret FROM wnav",
    "wmr": "SELECT date, coalesce(close / lag(close) OVER (ORDER BY date) - 1, 0) AS bench_ret, row_number() OVER (ORDER BY date) AS i FROM wmarket",
}


def wnav(spark, sf):
    return A.bars(spark, sf, grain="week").select(F.col("symbol").alias("series_id"), "date", F.col("close").alias("nav"))


@query("n01_daily_returns", "SELECT * FROM wret", "nav ret", NV)
def n01(spark, sf):
    return N.daily_returns(wnav(spark, sf))


@query("n02_total_return",
       "SELECT series_id, n AS n_nav, (l / f - 1) * 100 AS total_return_pct, CASE WHEN n >= 60 THEN (pow(l / f, 252.0 / n) - 1) * 100 END AS ann_return_pct FROM (SELECT series_id, count(*) AS n, arg_min(nav, date) AS f, arg_max(nav, date) AS l FROM wnav GROUP BY 1)",
       "total_return_pct ann_return_pct", NV)
def n02(spark, sf):
    return N.total_return(wnav(spark, sf))


DD = {**NV, "dds": f"SELECT series_id, date, (nav - max(nav) OVER ({SER})) / max(nav) OVER ({SER}) * 100 AS dd FROM wnav"}


@query("n03_max_drawdown", "SELECT series_id, min(dd) AS max_drawdown_pct, arg_min(date, dd) AS max_drawdown_date FROM dds GROUP BY 1", "max_drawdown_pct", DD)
def n03(spark, sf):
    return N.max_drawdown(wnav(spark, sf))


STATS = """SELECT series_id, n + 1 AS n_nav, (g - 1) * 100 AS total_return_pct, ann AS ann_return_pct, sd * sqrt(252.0) * 100 AS ann_vol_pct,
  CASE WHEN n + 1 < 252 THEN per ELSE (ann - 2) / (sd * sqrt(252.0) * 100) END AS sharpe, (ann - 2) / (sd * sqrt(252.0) * 100) AS sharpe_annualized, per AS sharpe_period,
  CASE WHEN n + 1 < 252 THEN 'period' ELSE 'annualized' END AS sharpe_basis, (ann - 2) / (down * sqrt(252.0) * 100) AS sortino FROM
  (SELECT *, (pow(g, 252.0 / (n + 1)) - 1) * 100 AS ann, ((g - 1) * 100 - 2 * n / 252.0) / (sd * sqrt(n) * 100) AS per FROM (SELECT series_id, count(ret) AS n, exp(sum(ln(1 + ret))) AS g, stddev_samp(ret) AS sd,
   sqrt(avg(pow(least(ret - 0.02 / 252, 0), 2))) AS down FROM wret WHERE ret IS NOT NULL GROUP BY 1))"""


@query("n04_return_stats", STATS, "total_return_pct ann_return_pct ann_vol_pct sharpe sharpe_annualized sharpe_period sortino", NV)
def n04(spark, sf):
    return N.return_stats(N.daily_returns(wnav(spark, sf)), 2.0)


@query("n05_average_rate", "SELECT avg(value) AS risk_free_pct FROM macro WHERE series = '5-LOW' AND date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'", "risk_free_pct:4")
def n05(spark, sf):
    return N.average_rate(A.macro(spark, sf).filter("series = '5-LOW'"), "1996-01-01", "1998-12-31")


@query("n06_calmar", """SELECT series_id, ann AS ann_return_pct, mdd AS max_drawdown_pct, ann / abs(mdd) AS calmar FROM (SELECT series_id, (pow(arg_max(nav, date) / arg_min(nav, date), 252.0 / count(*)) - 1) * 100 AS ann FROM wnav GROUP BY 1)
  JOIN (SELECT series_id, min(dd) AS mdd FROM dds GROUP BY 1) USING (series_id)""", "ann_return_pct max_drawdown_pct calmar", DD)
def n06(spark, sf):
    return N.calmar(wnav(spark, sf))


@query("n06_utilisation", "SELECT series_id, avg(low / close) * 100 AS utilisation_pct, (arg_max(close, date) / arg_min(close, date) - 1) * 100 AS total_return_pct, (arg_max(close, date) / arg_min(close, date) - 1) * 100 / avg(low / close) AS return_on_utilised_pct FROM (SELECT symbol AS series_id, * FROM wbars) GROUP BY 1",
       "utilisation_pct total_return_pct return_on_utilised_pct")
def n06b(spark, sf):
    b = A.bars(spark, sf, grain="week")
    return N.utilisation(b.select(F.col("symbol").alias("series_id"), "date", F.col("close").alias("nav"), F.col("low").alias("positions_value")))


def _trade_sql(where, factor):
    return f"""SELECT *, wins * 100.0::DOUBLE / closed AS win_rate_pct, {factor} AS profit_factor FROM (SELECT book, count(*) AS closed, count(*) FILTER (WHERE pnl_units > 0) AS wins, count(*) FILTER (WHERE pnl_units <= 0) AS losses,
  CAST(coalesce(sum(pnl_units) FILTER (WHERE pnl_units > 0), 0) AS DOUBLE) / 10000 AS gross_profit, abs(CAST(coalesce(sum(pnl_units) FILTER (WHERE pnl_units <= 0), 0) AS DOUBLE) / 10000) AS gross_loss,
  avg(pnl_pct) FILTER (WHERE pnl_units > 0) AS avg_win_pct, avg(pnl_pct) FILTER (WHERE pnl_units <= 0) AS avg_loss_pct, avg(CAST(days_held AS DOUBLE)) AS avg_days FROM trades WHERE action = 'SELL' {where} GROUP BY 1)"""


TD = "gross_profit:4 gross_loss:4 avg_win_pct avg_loss_pct avg_days win_rate_pct profit_factor"


@query("n07_trade_metrics", _trade_sql("AND reason <> 'backtest_end'", "CASE WHEN gross_loss > 0 THEN least(gross_profit / gross_loss, 999.99) ELSE 999.99 END"), TD)
def n07(spark, sf):
    return N.trade_metrics(A.trades(spark, sf))


@query("n07_trade_metrics_all_closed", _trade_sql("", "gross_profit / greatest(gross_loss, 0.01)"), TD)
def n07b(spark, sf):
    return N.trade_metrics(A.trades(spark, sf), skip_end=False)


@query("n08_exit_reasons", "SELECT reason, count(*) AS n, CAST(sum(pnl_units) AS DOUBLE) / 10000 AS pnl, avg(pnl_pct) AS avg_pnl_pct FROM trades WHERE action = 'SELL' GROUP BY 1", "pnl:4 avg_pnl_pct")
def n08(spark, sf):
    return N.exit_reasons(A.trades(spark, sf))


@query("n09_buy_and_hold", f"SELECT series_id, date, nav / first_value(nav) OVER ({SER}) * 100 AS nav FROM wnav", "nav", NV)
def n09(spark, sf):
    return N.buy_and_hold(A.bars(spark, sf, grain="week"))


@query("n09_first_available", f"SELECT series_id, date, nav / first_value(nav) OVER ({SER}) * 100 AS nav FROM wnav WHERE series_id = 'Brand#3'", "nav", NV)
def n09b(spark, sf):
    return N.first_available(A.bars(spark, sf, grain="week"), ["Brand#99", "Brand#3", "Brand#4"])


BL = {"bw": "SELECT symbol, market_cap AS weight FROM profiles WHERE sector = 'S1'",
      "bj": "SELECT b.symbol, b.date, b.close, w.weight, count(*) OVER (PARTITION BY b.date) AS c FROM bars b JOIN bw w USING (symbol)",
      "bc": "SELECT *, first_value(close) OVER (PARTITION BY symbol ORDER BY date) AS base FROM bj WHERE c = (SELECT count(*) FROM bw)"}


@query("n10_blended_benchmark", "SELECT 'blend' AS series_id, date, sum(weight / (SELECT sum(weight) FROM bw) * close / base) * 100 AS nav FROM bc GROUP BY 2", "nav", BL)
def n10(spark, sf):
    w = A.profiles(spark, sf).filter("sector = 'S1'").select("symbol", F.col("market_cap").alias("weight"))
    return N.blended_benchmark(A.bars(spark, sf), w)


@query("n10_cap_weights", "SELECT sector, sum(market_cap) / (SELECT sum(market_cap) FROM profiles) AS weight FROM profiles GROUP BY 1", "weight")
def n10b(spark, sf):
    return N.cap_weights(A.profiles(spark, sf))


def bench(spark, sf):
    m = A.market(spark, sf, grain="week")
    return N.benchmark_returns(m, m)


@query("n11_relative_stats",
       """SELECT series_id, n, beta, te * sqrt(252.0) * 100 AS tracking_error_pct, s / sb AS vol_ratio, act * 252 * 100 AS alpha_pct, act * sqrt(252.0) / te AS information_ratio, (mr - beta * mb) * 252 * 100 AS beta_adjusted_alpha_pct FROM
  (SELECT series_id, count(*) AS n, covar_samp(ret, bench_ret) / var_samp(bench_ret) AS beta, stddev_samp(ret - bench_ret) AS te, stddev_samp(ret) AS s, stddev_samp(bench_ret) AS sb, avg(ret - bench_ret) AS act, avg(ret) AS mr, avg(bench_ret) AS mb
   FROM wret JOIN wmr USING (date) WHERE ret IS NOT NULL AND i > 1 GROUP BY 1 HAVING count(*) >= 20)""",
       "beta tracking_error_pct vol_ratio alpha_pct information_ratio beta_adjusted_alpha_pct", NV)
def n11(spark, sf):
    return N.relative_stats(N.daily_returns(wnav(spark, sf)), bench(spark, sf))


@query("n12_pnl_with_benchmark",
       f"""SELECT w.series_id, w.date, w.nav, w.nav - lag(w.nav) OVER x AS pnl, (w.nav / lag(w.nav) OVER x - 1) * 100 AS pnl_pct, w.nav / first_value(w.nav) OVER x * 100 AS rebased, m.close AS bench
  FROM wnav w ASOF LEFT JOIN (SELECT * FROM market) m ON w.date >= m.date WINDOW x AS (PARTITION BY w.series_id ORDER BY w.date)""", "nav pnl pnl_pct rebased bench", NV)
def n12(spark, sf):
    return N.pnl_with_benchmark(wnav(spark, sf), A.market(spark, sf).select("date", F.col("close").alias("nav")))


@query("n13_rolling_vol", "SELECT series_id, date, CASE WHEN count(ret) OVER x = 29 THEN stddev_pop(ret) OVER x * sqrt(252.0) * 100 END AS rolling_vol_pct FROM wret WINDOW x AS (PARTITION BY series_id ORDER BY date ROWS 28 PRECEDING)", "rolling_vol_pct", NV)
def n13(spark, sf):
    return N.rolling_vol(wnav(spark, sf))


MON = {**NV, "mon": "SELECT series_id, CAST(date_trunc('month', date) AS DATE) AS month, arg_min(nav, date) AS f, arg_max(nav, date) AS l FROM wnav GROUP BY 1, 2",
       "mret": "SELECT series_id, month, (l / coalesce(lag(l) OVER (PARTITION BY series_id ORDER BY month), f) - 1) * 100 AS ret_pct FROM mon"}


@query("n14_monthly_returns", "SELECT * FROM mret", "ret_pct", MON)
def n14(spark, sf):
    return N.monthly_returns(wnav(spark, sf))


@query("n15_within_month", "SELECT series_id, month AS period, (l / f - 1) * 100 AS ret_pct FROM mon", "ret_pct", MON)
def n15(spark, sf):
    return N.within_period(wnav(spark, sf), "month")


@query("n15_within_year", "SELECT series_id, CAST(date_trunc('year', date) AS DATE) AS period, (arg_max(nav, date) / arg_min(nav, date) - 1) * 100 AS ret_pct FROM wnav GROUP BY 1, 2", "ret_pct", NV)
def n15b(spark, sf):
    return N.within_period(wnav(spark, sf), "year")


@query("n15_month_grid", "SELECT series_id, CAST(year(month) AS INTEGER) AS year, " + ", ".join(f"max(CASE WHEN month(month) = {m} THEN (l / f - 1) * 100 END) AS m{m:02d}" for m in range(1, 13)) + " FROM mon GROUP BY 1, 2",
       " ".join(f"m{m:02d}" for m in range(1, 13)), MON)
def n15c(spark, sf):
    return N.month_grid(wnav(spark, sf))


@query("n16_histogram", "SELECT CAST(CASE WHEN hi > lo THEN least(floor((pnl - lo) / (hi - lo) * 40), 39) ELSE 0 END AS INTEGER) AS bin, count(*) AS n FROM trades, (SELECT min(pnl) AS lo, max(pnl) AS hi FROM trades) WHERE pnl IS NOT NULL GROUP BY 1")
def n16(spark, sf):
    return N.histogram(A.trades(spark, sf), "pnl")


@query("n17_latest_month", "SELECT series_id, max(month) AS month, arg_max(ret_pct, month) AS ret_pct FROM mret JOIN (SELECT series_id, CAST(date_trunc('month', max(date)) AS DATE) AS open_month FROM wnav GROUP BY 1) USING (series_id) WHERE month < open_month GROUP BY 1", "ret_pct", MON)
def n17(spark, sf):
    return N.latest_month(wnav(spark, sf))


@query("n18_rebased", f"SELECT series_id, date, nav / first_value(nav) OVER ({SER}) * 100 AS nav FROM wnav WHERE date >= DATE '1998-03-03'", "nav", NV)
def n18(spark, sf):
    return N.rebased(wnav(spark, sf), "1998-03-03")


@query("n19_benchmark_returns", "SELECT date, bench_ret FROM (SELECT c.date, row_number() OVER (ORDER BY c.date) AS i, coalesce(b.close / lag(b.close) OVER (ORDER BY c.date) - 1, 0) AS bench_ret FROM calendar c LEFT JOIN (SELECT * FROM bars WHERE symbol = 'Brand#5') b USING (date)) WHERE i > 1", "bench_ret")
def n19(spark, sf):
    b = A.bars(spark, sf)
    return N.benchmark_returns(A.market(spark, sf), b.filter("symbol = 'Brand#5'"))


@query("n20_sleeve_contribution",
       "SELECT sleeve, count(*) AS n, CAST(sum(amount_cents) AS DOUBLE) / 100 AS allocated, CAST(sum(pnl_units) AS DOUBLE) / sum(amount_cents) AS return_pct, CAST(sum(amount_cents) AS DOUBLE) / 100 * (CAST(sum(pnl_units) AS DOUBLE) / sum(amount_cents)) / 1000000000 AS contribution_pct, avg(CASE WHEN pnl_units > 0 THEN 1.0::DOUBLE ELSE 0 END) AS win_rate FROM trades WHERE action = 'SELL' GROUP BY 1",
       "allocated:2 return_pct contribution_pct win_rate")
def n20(spark, sf):
    t = A.trades(spark, sf).filter("action = 'SELL'")
    s = t.groupBy("sleeve").agg(
        F.count(F.lit(1)).alias("n"), (F.sum("amount_cents") / 100.0).alias("allocated"), (F.sum("pnl_units") / F.sum("amount_cents")).alias("return_pct"),
        F.avg((F.col("pnl_units") > 0).cast("double")).alias("win_rate"))
    return N.sleeve_contribution(s, 1e9)


# ---------------------------------------------------------------- ledger

POS = {
    "dtot": """SELECT book, symbol, date, CAST(coalesce(sum(shares) FILTER (WHERE action = 'BUY'), 0) AS DOUBLE) AS b, CAST(coalesce(sum(amount_cents) FILTER (WHERE action = 'BUY'), 0) AS DOUBLE) / 100 AS bc,
  CAST(coalesce(sum(shares) FILTER (WHERE action = 'SELL'), 0) AS DOUBLE) AS s, CAST(coalesce(sum(pnl_units), 0) AS BIGINT) AS pu, count(*) FILTER (WHERE action = 'SELL') AS ns FROM trades GROUP BY 1, 2, 3""",
    "dnum": "SELECT *, row_number() OVER (PARTITION BY book, symbol ORDER BY date) AS rn FROM dtot",
    "walkp": """SELECT book, symbol, CAST(0 AS BIGINT) AS rn, 0.0::DOUBLE AS held, 0.0::DOUBLE AS cost FROM (SELECT DISTINCT book, symbol FROM dnum)
  UNION ALL SELECT book, symbol, rn, CASE WHEN ns = 0 THEN h WHEN h - s > 1e-3 THEN h - s ELSE 0 END, CASE WHEN ns = 0 THEN c WHEN h - s > 1e-3 THEN c * (h - s) / h ELSE 0 END FROM
   (SELECT d.book, d.symbol, d.rn, d.ns, d.s, CASE WHEN d.b > 0 AND w.held <= 1e-3 THEN d.b ELSE w.held + d.b END AS h, CASE WHEN d.b > 0 AND w.held <= 1e-3 THEN d.bc ELSE w.cost + d.bc END AS c
    FROM walkp w JOIN dnum d ON d.book = w.book AND d.symbol = w.symbol AND d.rn = w.rn + 1)""",
    "states": "SELECT d.*, w.held, w.cost FROM walkp w JOIN dnum d USING (book, symbol, rn)",
    "lastm": "SELECT symbol, arg_max(close, date) AS price FROM bars GROUP BY 1",
    "pos": """SELECT book, symbol, CASE WHEN held > 0 THEN 'open' ELSE 'closed' END AS status, held AS shares_held, coalesce(cost / nullif(held, 0), 0) AS avg_entry, cost AS open_cost, held * coalesce(price, 0) AS market_value,
  CASE WHEN held > 0 THEN held * coalesce(price, 0) - cost ELSE 0 END AS unrealized_pnl, realized_pnl, num_round_trips FROM (SELECT book, symbol, arg_max(held, date) AS held, arg_max(cost, date) AS cost, CAST(sum(pu) AS DOUBLE) / 10000 AS realized_pnl,
   CAST(sum(ns) AS BIGINT) AS num_round_trips FROM states GROUP BY 1, 2) LEFT JOIN lastm USING (symbol)""",
}


def marks(spark, sf):
    return asof.last_on(A.bars(spark, sf), "2100-01-01").select("symbol", F.col("close").alias("price"))


def pos(spark, sf):
    return L.positions(A.trades(spark, sf), marks(spark, sf))


PDG = "shares_held avg_entry open_cost:5 market_value:4 unrealized_pnl:4 realized_pnl:4"


@query("l01_positions", "SELECT * FROM pos", PDG, POS)
def l01(spark, sf):
    return pos(spark, sf)


@query("l01_book_summary", """SELECT book, 1e9 - sum(open_cost) + sum(realized_pnl) AS cash, sum(market_value) AS positions_value, 1e9 - sum(open_cost) + sum(realized_pnl) + sum(market_value) AS portfolio_value,
  sum(realized_pnl) + sum(unrealized_pnl) AS total_pnl, count(*) FILTER (WHERE status = 'open') AS open_count, count(*) FILTER (WHERE status = 'closed') AS closed_count FROM pos GROUP BY 1""", "cash:4 positions_value:4 portfolio_value:4 total_pnl:4", POS)
def l01b(spark, sf):
    return L.book_summary(pos(spark, sf), 1e9)


@query("l02_merged_book", "SELECT symbol, sum(shares_held) AS shares_held, sum(market_value) AS market_value, sum(realized_pnl) AS realized_pnl, sum(unrealized_pnl) AS unrealized_pnl, CAST(sum(num_round_trips) AS BIGINT) AS num_round_trips, count(DISTINCT book) AS n_books FROM pos GROUP BY 1",
       "shares_held market_value:5 realized_pnl:4 unrealized_pnl:5", POS)
def l02(spark, sf):
    return L.merged_book(pos(spark, sf))


@query("l03_holding_weights", "SELECT book, symbol, net_shares, net_shares * price AS value, net_shares * price / sum(net_shares * price) OVER (PARTITION BY book) AS weight FROM (SELECT book, symbol, sum(CASE action WHEN 'BUY' THEN shares ELSE -shares END) AS net_shares FROM trades GROUP BY 1, 2 HAVING sum(CASE action WHEN 'BUY' THEN shares ELSE -shares END) > 1e-9) JOIN lastm USING (symbol)",
       "net_shares value:4 weight", POS)
def l03(spark, sf):
    return L.holding_weights(A.trades(spark, sf), marks(spark, sf))


def sleeve_books(spark, sf):
    return A.trades(spark, sf).drop("book").withColumnRenamed("sleeve", "book")


SB = {k: (v.replace("FROM trades", "FROM (SELECT * REPLACE (sleeve AS book) FROM trades)")) for k, v in POS.items()}
SB["realz"] = "SELECT *, CAST(sum(pu) OVER (PARTITION BY book, symbol ORDER BY date) AS DOUBLE) / 10000 AS real FROM states"
SB["lnav"] = """SELECT book, date, sum(CASE WHEN held > 0 THEN coalesce(held * close, cost) ELSE 0 END) AS positions_value, 1e9 - sum(cost) + sum(real) AS cash, count(*) FILTER (WHERE held > 0) AS num_positions,
  1e9 - sum(cost) + sum(real) + sum(CASE WHEN held > 0 THEN coalesce(held * close, cost) ELSE 0 END) AS nav FROM (SELECT g.book, g.symbol, g.date, r.held, r.cost, r.real, b.close FROM
   (SELECT k.book, k.symbol, c.date FROM (SELECT DISTINCT book, symbol FROM states) k, calendar c) g ASOF JOIN (SELECT * FROM realz) r ON r.book = g.book AND r.symbol = g.symbol AND g.date >= r.date
   ASOF LEFT JOIN (SELECT symbol, date, close FROM bars) b ON b.symbol = g.symbol AND g.date >= b.date) GROUP BY 1, 2"""
NAVD = "positions_value:2 cash:2 nav:2"


def lnav(spark, sf):
    return L.replay_nav(sleeve_books(spark, sf), A.bars(spark, sf), 1e9)


@query("l04_replay_nav", "SELECT * FROM lnav", NAVD, SB)
def l04(spark, sf):
    return lnav(spark, sf)


@query("l04_downsampled_nav", "SELECT book, date, nav FROM (SELECT *, row_number() OVER (PARTITION BY book ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY book) AS n FROM lnav) WHERE n <= 260 OR i = 0 OR i = n - 1 OR floor(i * 260 / n::DOUBLE) <> floor((i - 1) * 260 / n::DOUBLE)", "nav:2", SB)
def l04b(spark, sf):
    return L.downsample(lnav(spark, sf), "book").select("book", "date", "nav")


CON = {"con": "SELECT symbol, CAST(sum(pnl_units) AS DOUBLE) / 10000 AS realized_pnl, count(*) AS n_trades, avg(pnl_pct) AS avg_pnl_pct, CAST(sum(pnl_units) AS DOUBLE) / (SELECT sum(pnl_units) FROM trades) * 100 AS share_pct FROM trades WHERE action = 'SELL' GROUP BY 1"}
CD = "realized_pnl:4 avg_pnl_pct share_pct"


@query("l05_contribution", "SELECT * FROM con", CD, CON)
def l05(spark, sf):
    return L.contribution(A.trades(spark, sf))


@query("l05_winners_losers", "SELECT * FROM (SELECT *, 'best' AS side FROM con ORDER BY realized_pnl DESC, symbol LIMIT 3) UNION ALL SELECT * FROM (SELECT *, 'worst' AS side FROM con ORDER BY realized_pnl, symbol LIMIT 3)", CD, CON)
def l05b(spark, sf):
    return L.extremes(L.contribution(A.trades(spark, sf)), "realized_pnl", 3)


@query("l06_pnl_distribution", "SELECT count(*) AS n, CAST(sum(pnl_units) AS DOUBLE) / 10000 AS total_pnl, " + ", ".join(f"quantile_cont(pnl_pct, {p / 100}) AS p{p}" for p in (10, 25, 50, 75, 90)) + ", avg(CAST(days_held AS DOUBLE)) AS avg_days, max(days_held) AS max_days FROM trades WHERE action = 'SELL'",
       "total_pnl:4 p10 p25 p50 p75 p90 avg_days")
def l06(spark, sf):
    return L.pnl_distribution(A.trades(spark, sf))


GRP = "count(*) AS n, CAST(sum(pnl_units) AS DOUBLE) / 10000 AS pnl, avg(CASE WHEN pnl_units > 0 THEN 1.0::DOUBLE ELSE 0 END) AS win_rate, avg(pnl_pct) AS avg_pnl_pct FROM trades WHERE action = 'SELL' GROUP BY ALL"
for _name, _cols in (("by_reason", ["reason"]), ("by_sleeve", ["sleeve"]), ("by_window", ["window_year", "sleeve"])):
    @query(f"l06_{_name}", f"SELECT {', '.join(_cols)}, {GRP}", "pnl:4 win_rate avg_pnl_pct")
    def run(spark, sf, cols=_cols):
        return L.grouped_pnl(A.trades(spark, sf), cols)


@query("l06_monthly", f"SELECT CAST(date_trunc('month', date) AS DATE) AS month, {GRP}", "pnl:4 win_rate avg_pnl_pct")
def l06m(spark, sf):
    return L.monthly_pnl(A.trades(spark, sf))


@query("l07_trade_summary", "SELECT * FROM (SELECT trade_key, book, symbol, pnl, 'best' AS side FROM trades WHERE action = 'SELL' ORDER BY pnl DESC, trade_key LIMIT 3) UNION ALL SELECT * FROM (SELECT trade_key, book, symbol, pnl, 'worst' AS side FROM trades WHERE action = 'SELL' ORDER BY pnl, trade_key LIMIT 3)", "pnl:4")
def l07(spark, sf):
    t = A.trades(spark, sf).filter("action = 'SELL'").select("trade_key", "book", "symbol", "pnl")
    return L.extremes(t, "pnl", 3, "trade_key")


GATE = {"gate": "SELECT 'sleeve' || i AS sleeve, date FROM calendar, range(0, 3) r(i) WHERE (idx + i) % 7 <> 0",
        "viol": """SELECT 'I1_no_bar' AS rule, book, symbol, date, trade_key AS detail FROM trades WHERE action = 'BUY' AND (symbol, date) NOT IN (SELECT (symbol, date) FROM bars WHERE volume > 20)
  UNION ALL SELECT 'I2_naked_sell', book, symbol, date, '' FROM (SELECT *, sum(b) OVER w AS bt FROM dtot WINDOW w AS (PARTITION BY book, symbol ORDER BY date)) WHERE s > 0 AND bt = 0
  UNION ALL SELECT 'I3_negative_shares', book, symbol, date, '' FROM (SELECT *, sum(b - s) OVER w AS net FROM dtot WINDOW w AS (PARTITION BY book, symbol ORDER BY date)) WHERE s > 0 AND net < -1e-3
  UNION ALL SELECT 'I4_entry_gated_off', book, symbol, date, sleeve FROM trades WHERE action = 'BUY' AND (sleeve, date) NOT IN (SELECT (sleeve, date) FROM gate)
  UNION ALL SELECT 'I7_unknown_reason', book, symbol, date, reason FROM trades WHERE reason NOT IN ('entry_signal', 'stop_loss', 'take_profit', 'backtest_end')
  UNION ALL SELECT 'I10_duplicate', book, symbol, date, '' FROM trades GROUP BY book, symbol, date, action, reason, shares HAVING count(*) > 1
  UNION ALL SELECT 'I11_end_only', book, symbol, date, action FROM trades WHERE reason = 'backtest_end' AND (action <> 'SELL' OR date < (SELECT max(date) FROM trades))"""}


@query("l08_violations", "SELECT rule, book, symbol, date, count(*) AS n FROM viol GROUP BY ALL", views={**POS, **GATE})
def l08(spark, sf):
    cal = calendars.calendar(A.market(spark, sf).select("date"))
    three = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(f"sleeve{i}").alias("sleeve")) for i in range(3)]))
    gates = cal.withColumn("g", three).filter((F.col("idx") + F.col("g.i")) % 7 != 0).select("g.sleeve", "date")
    v = L.violations(A.trades(spark, sf), A.bars(spark, sf).filter("volume > 20"), gates, ["entry_signal", "stop_loss", "take_profit", "backtest_end"])
    return v.groupBy("rule", "book", "symbol", "date").agg(F.count(F.lit(1)).alias("n"))


@query("l08_nav_violations", "SELECT 'I9_negative_nav' AS rule, book, nav AS detail FROM lnav WHERE nav < -1e-3 UNION ALL SELECT 'I8_nav_mismatch', book, f FROM (SELECT book, arg_max(nav, date) AS f FROM lnav GROUP BY 1) WHERE abs(f - 1e9 * 1.1::DOUBLE) >= 1e6", "detail:2", SB)
def l08b(spark, sf):
    n = lnav(spark, sf)
    totals = A.trades(spark, sf).select(F.col("sleeve").alias("book")).distinct().withColumn("total_return_pct", F.lit(10.0))
    return L.nav_violations(n, totals, 1e9)


ALERT = {"alr": """SELECT substr(md5(book || ':' || date || ':' || sleeve || ':' || symbol || ':' || action), 1, 12) AS alert_id, book, date, sleeve, symbol, action, sum(shares) AS shares,
  CAST(sum(amount_cents) AS DOUBLE) / 100 / sum(shares) AS target_price FROM trades GROUP BY ALL"""}


@query("l09_alerts", "SELECT * FROM alr", "shares target_price", ALERT)
def l09(spark, sf):
    return L.alerts(A.trades(spark, sf))


@query("l09_alerts_on_date", "SELECT * FROM alr WHERE date = DATE '1998-06-30'", "shares target_price", ALERT)
def l09b(spark, sf):
    return L.alerts(A.trades(spark, sf), "1998-06-30")


FILL = {**ALERT, "fq": "SELECT a.*, b.close AS fill_price, (b.close - a.target_price) / a.target_price * 100 AS slippage_pct FROM alr a LEFT JOIN (SELECT * FROM bars WHERE volume > 100) b USING (symbol, date)"}


def quality(spark, sf):
    a = L.alerts(A.trades(spark, sf))
    b = A.bars(spark, sf).filter("volume > 100").select("symbol", "date", F.col("close").alias("fill_price"))
    return L.fill_quality(a, a.join(b, ["symbol", "date"]).select("alert_id", "fill_price"))


@query("l10_fill_quality", "SELECT alert_id, target_price, fill_price, slippage_pct FROM fq", "target_price fill_price slippage_pct", FILL)
def l10(spark, sf):
    return quality(spark, sf).select("alert_id", "target_price", "fill_price", "slippage_pct")


@query("l10_execution_summary", "SELECT action, count(*) AS n_alerts, count(fill_price) AS n_filled, count(fill_price) * 100.0::DOUBLE / count(*) AS follow_through_pct, avg(slippage_pct) AS avg_slippage_pct FROM fq GROUP BY 1", "follow_through_pct avg_slippage_pct", FILL)
def l10b(spark, sf):
    return L.execution_summary(quality(spark, sf))


FT = {"ent": "SELECT symbol || ':' || date AS entry_id, symbol, date AS entry_date, close AS entry_price FROM bars WHERE volume > 100",
      "xs": "SELECT symbol, date FROM earnings",
      "tj": "SELECT e.*, b.date, b.close, (b.close - e.entry_price) / e.entry_price * 100 AS gain, x.date AS xd FROM (SELECT ent.*, n.date AS until FROM ent ASOF LEFT JOIN bars n ON n.symbol = ent.symbol AND ent.entry_date + 30 <= n.date) e JOIN bars b ON b.symbol = e.symbol AND b.date > e.entry_date AND b.date <= coalesce(e.until, e.entry_date + 30) LEFT JOIN xs x ON x.symbol = b.symbol AND x.date = b.date",
      "th": "SELECT *, CASE WHEN gain <= -25 THEN 'stop_loss' WHEN gain >= 60 THEN 'take_profit' WHEN date - entry_date >= 30 THEN 'time_stop' WHEN xd IS NOT NULL THEN 'fundamental_exit' END AS hit FROM tj",
      "touch": "SELECT e.*, h.exit_date, h.exit_price, h.pnl_pct, coalesce(h.reason, 'open') AS reason FROM ent e LEFT JOIN (SELECT entry_id, min(date) AS exit_date, arg_min(close, date) AS exit_price, arg_min(gain, date) AS pnl_pct, arg_min(hit, date) AS reason FROM th WHERE hit IS NOT NULL GROUP BY 1) h USING (entry_id)"}


def entries(spark, sf):
    b = A.bars(spark, sf).filter("volume > 100")
    return b.select(F.concat_ws(":", "symbol", F.col("date").cast("string")).alias("entry_id"), "symbol", F.col("date").alias("entry_date"), F.col("close").alias("entry_price"))


def touches(spark, sf):
    return L.first_touch(entries(spark, sf), A.bars(spark, sf), -25.0, 60.0, 30, exits=A.earnings(A.income(spark, sf)))


@query("l11_first_touch", "SELECT * FROM touch", "entry_price exit_price pnl_pct", FT)
def l11(spark, sf):
    return touches(spark, sf)


@query("l11_trailing_peak",
       """SELECT e.*, h.exit_date, h.exit_price, h.pnl_pct, coalesce(h.reason, 'open') AS reason FROM ent e LEFT JOIN (SELECT entry_id, min(date) AS exit_date, arg_min(close, date) AS exit_price, arg_min(gain, date) AS pnl_pct, arg_min(hit, date) AS reason FROM
  (SELECT *, CASE WHEN gain <= -50 THEN 'stop_loss' WHEN high > entry_price * 1.2::DOUBLE AND close <= high * 0.8::DOUBLE THEN 'take_profit' WHEN date - entry_date >= 30 THEN 'time_stop' END AS hit FROM
   (SELECT *, greatest(entry_price, max(close) OVER (PARTITION BY entry_id ORDER BY date)) AS high FROM tj)) WHERE hit IS NOT NULL GROUP BY 1) h USING (entry_id)""", "entry_price exit_price pnl_pct", FT)
def l11b(spark, sf):
    return L.first_touch(entries(spark, sf), A.bars(spark, sf), -50.0, None, 30, trail=(20.0, 20.0))


@query("l12_after_cooldown",
       """SELECT e.symbol, e.entry_date AS date FROM ent e JOIN calendar c ON c.date = e.entry_date ASOF LEFT JOIN (SELECT t.symbol, t.exit_date, c2.idx AS si FROM (SELECT DISTINCT symbol, exit_date FROM touch WHERE reason = 'stop_loss') t JOIN calendar c2 ON c2.date = t.exit_date) s
  ON s.symbol = e.symbol AND e.entry_date >= s.exit_date WHERE s.si IS NULL OR c.idx - s.si >= 10""", views=FT)
def l12(spark, sf):
    b = A.bars(spark, sf)
    stops = touches(spark, sf).filter("reason = 'stop_loss'").select("symbol", F.col("exit_date").alias("date"))
    e = entries(spark, sf).select("symbol", F.col("entry_date").alias("date"))
    return L.after_cooldown(e, stops, calendars.calendar(b), 10)


@query("l13_next_day_fills", "SELECT symbol, date, fill_date, p * 1.001::DOUBLE AS fill_price FROM (SELECT symbol, date, volume, lead(date) OVER w AS fill_date, lead(open) OVER w AS p FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)) WHERE volume > 100 AND fill_date IS NOT NULL", "fill_price")
def l13(spark, sf):
    b = A.bars(spark, sf)
    return L.next_day_fills(b.filter("volume > 100").select("symbol", "date"), b, "open", 10.0)


CN = {**NV, "slr": "SELECT series_id AS sleeve, date, ret * 0.1::DOUBLE AS ret FROM wret WHERE ret IS NOT NULL"}


@query("l14_combined_nav", "SELECT date, ret, 100 * exp(sum(ln(1 + ret)) OVER (ORDER BY date)) AS nav FROM (SELECT date, sum(ret * (1.0::DOUBLE / (SELECT count(DISTINCT sleeve) FROM slr))) AS ret FROM slr GROUP BY 1)", "ret nav", CN)
def l14(spark, sf):
    r = N.daily_returns(wnav(spark, sf)).filter("ret IS NOT NULL")
    r = r.select(F.col("series_id").alias("sleeve"), "date", (F.col("ret") * 0.1).alias("ret"))
    sleeves = r.select("sleeve").distinct()
    n = r.agg(F.countDistinct("sleeve")).scalar()
    return L.combined_nav(r, sleeves.withColumn("weight", 1.0 / n))


# ---------------------------------------------------------------- funds

FU = {
    "fnav": "SELECT CAST(r_regionkey AS VARCHAR) AS fund, date, close + r_regionkey AS nav FROM market, region WHERE date >= DATE '1995-01-10'",
    "npu": """SELECT fund, date, floor(100 * nav / f * 1e4 + 0.5) / 1e4 AS nav_per_unit, nav, floor((nav / f - 1) * 100 * 1e4 + 0.5) / 1e4 AS return_pct FROM
  (SELECT *, first_value(nav) OVER (PARTITION BY fund ORDER BY date) AS f FROM fnav)""",
    "tx": """SELECT fund, investor, flow_id, nav_date, CASE WHEN c > 0 THEN 'subscription' ELSE 'redemption' END AS type, CASE WHEN c > 0 THEN c / 100.0::DOUBLE ELSE -floor(u * p * 100 + 0.5) / 100 END AS amount, p AS nav_per_unit, CASE WHEN c > 0 THEN u ELSE -u END AS units FROM
  (SELECT a.fund, a.investor, a.flow_id, a.amount_cents AS c, n.date AS nav_date, n.nav_per_unit AS p, floor(abs(a.amount_cents / 100.0::DOUBLE) / n.nav_per_unit * 1e6 + 0.5) / 1e6 AS u
   FROM accounts a ASOF JOIN (SELECT * FROM npu) n ON n.fund = a.fund AND a.date >= n.date)""",
    "lastn": "SELECT fund, max(date) AS as_of, arg_max(nav_per_unit, date) AS nav_now FROM npu GROUP BY 1",
    "stm": """SELECT *, gain / nullif(net_invested, 0) * 100 AS return_on_capital_pct, (nav_now / entry_nav - 1) * 100 AS fund_return_pct FROM (SELECT *, floor((current_value - net_invested) * 100 + 0.5) / 100 AS gain FROM (SELECT a.*, l.as_of, l.nav_now, floor(units_held * nav_now * 100 + 0.5) / 100 AS current_value FROM
  (SELECT fund, investor, floor(sum(units) * 1e6 + 0.5) / 1e6 AS units_held, floor(sum(amount) * 100 + 0.5) / 100 AS net_invested, floor(sum(CASE WHEN amount > 0 THEN amount ELSE 0 END) * 100 + 0.5) / 100 AS contributions, min(nav_date) AS entry_date, arg_min(nav_per_unit, nav_date) AS entry_nav FROM tx GROUP BY 1, 2) a JOIN lastn l USING (fund)))""",
}


def npu(spark, sf):
    r = A.table(spark, sf, "region").select("r_regionkey")
    m = A.market(spark, sf)
    ids = r.agg(F.sort_array(F.collect_set("r_regionkey"))).scalar()  # regions are a fixed handful
    nav = m.select("date", "close", F.explode(ids).alias("k")).select(F.col("k").cast("string").alias("fund"), "date", (F.col("close") + F.col("k")).alias("nav"))
    return U.nav_per_unit(nav, 100.0, "1995-01-10")


def tx(spark, sf):
    return U.unit_transactions(A.accounts(spark, sf), npu(spark, sf))


@query("fu1_nav_per_unit", "SELECT * FROM npu", "nav_per_unit nav return_pct", FU)
def fu1(spark, sf):
    return npu(spark, sf)


@query("fu2_weekly", "SELECT fund, max(date) AS date, arg_max(nav_per_unit, date) AS nav_per_unit, arg_max(nav, date) AS nav, arg_max(return_pct, date) AS return_pct FROM npu GROUP BY fund, isoyear(date), week(date)", "nav_per_unit nav return_pct", FU)
def fu2(spark, sf):
    return U.weekly(npu(spark, sf))


@query("fu3_nav_on", "SELECT d.fund, d.date, n.date AS asof_date, n.nav_per_unit FROM (SELECT DISTINCT fund, date FROM accounts) d ASOF LEFT JOIN (SELECT * FROM npu) n ON n.fund = d.fund AND d.date >= n.date", "nav_per_unit", FU)
def fu3(spark, sf):
    return U.nav_on(A.accounts(spark, sf).select("fund", "date").distinct(), npu(spark, sf))


@query("fu4_unit_transactions", "SELECT * FROM tx", "amount:2 nav_per_unit units", FU)
def fu4(spark, sf):
    return tx(spark, sf)


@query("fu4_exits", "SELECT fund, investor, as_of AS nav_date, -units_held AS units, -floor(units_held * nav_now * 100 + 0.5) / 100 AS amount FROM stm WHERE units_held > 1e-6", "units amount:2", FU)
def fu4b(spark, sf):
    s = npu(spark, sf)
    return U.exits(tx(spark, sf), s)


@query("fu4_over_redemptions", "SELECT * FROM (SELECT fund, investor, nav_date, u AS units, sum(u) OVER (PARTITION BY fund, investor ORDER BY nav_date) AS balance FROM (SELECT fund, investor, nav_date, sum(units) AS u FROM tx GROUP BY 1, 2, 3)) WHERE balance < -1e-6", "units:5 balance:5", FU)
def fu4c(spark, sf):
    return U.over_redemptions(tx(spark, sf))


SD = "units_held net_invested:2 contributions:2 entry_nav nav_now current_value:2 gain:2 return_on_capital_pct fund_return_pct"


@query("fu5_statements", "SELECT * FROM stm", SD, FU)
def fu5(spark, sf):
    s = npu(spark, sf)
    return U.statements(tx(spark, sf), s)


@query("fu6_money_weighted")
def fu6(spark, sf):
    s = npu(spark, sf)
    return U.money_weighted(tx(spark, sf), s)


@query("fu7_investor_positions", "SELECT fund, investor, units_held, current_value, gain FROM stm WHERE abs(units_held) > 1e-9", "units_held current_value:2 gain:2", FU)
def fu7(spark, sf):
    s = npu(spark, sf)
    return U.investor_positions(tx(spark, sf), s).select("fund", "investor", "units_held", "current_value", "gain")


@query("fu7_reconciliation", "SELECT fund, sum(units_held) AS units_outstanding, sum(current_value) AS sum_of_values, count(*) AS investor_count, max(nav_now) AS nav_now, sum(units_held) * max(nav_now) AS aum FROM stm WHERE abs(units_held) > 1e-9 GROUP BY 1", "units_outstanding:4 sum_of_values:2 nav_now aum:1", FU)
def fu7b(spark, sf):
    s = npu(spark, sf)
    return U.reconciliation(tx(spark, sf), s)


FB = {"fills": "SELECT CAST(s_nationkey % 5 AS VARCHAR) AS fund, symbol, action AS side, shares, price, amount_cents AS cents FROM trades JOIN supplier ON book = s_suppkey",
      "mk": "SELECT symbol, arg_max(close, date) AS price FROM bars WHERE symbol <> 'Brand#1' GROUP BY 1", "fb": "SELECT symbol, arg_max(close, date) AS p2 FROM bars GROUP BY 1",
      "abook": "SELECT fund, symbol, shares, coalesce(price, p2, 0) AS price, shares * coalesce(price, p2, 0) AS market_value FROM (SELECT fund, symbol, sum(CASE side WHEN 'BUY' THEN shares ELSE -shares END) AS shares FROM fills GROUP BY 1, 2) LEFT JOIN mk USING (symbol) LEFT JOIN fb USING (symbol) WHERE abs(shares) >= 1e-4"}


def fills(spark, sf):
    s = A.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("book"), (F.col("s_nationkey") % 5).cast("string").alias("fund"))
    return A.trades(spark, sf).join(s, "book").select("fund", "symbol", F.col("action").alias("side"), "shares", "price", F.col("amount_cents").alias("cents"))


def abook(spark, sf):
    m = marks(spark, sf)
    return U.actual_book(fills(spark, sf), A.accounts(spark, sf), m.filter("symbol <> 'Brand#1'"), m)


@query("fu8_actual_book", "SELECT * FROM abook", "shares price market_value:5", FB)
def fu8(spark, sf):
    return abook(spark, sf)


@query("fu8_book_cash", "SELECT fund, CAST(coalesce(i, 0) - coalesce(o, 0) AS DOUBLE) / 100 AS cash FROM (SELECT fund, sum(amount_cents) AS i FROM accounts GROUP BY 1) FULL JOIN (SELECT fund, sum(CASE side WHEN 'BUY' THEN cents ELSE -cents END) AS o FROM fills GROUP BY 1) USING (fund)", "cash:2", FB)
def fu8b(spark, sf):
    return U.book_cash(fills(spark, sf), A.accounts(spark, sf))


@query("fu9_sector_exposure", "SELECT fund, sector, sum(market_value) AS market_value, sum(market_value) / any_value(t) * 100 AS weight_pct FROM abook LEFT JOIN (SELECT symbol, sector FROM profiles) USING (symbol) JOIN (SELECT fund, sum(market_value) AS t FROM abook GROUP BY 1) USING (fund) GROUP BY 1, 2", "market_value:4 weight_pct", FB)
def fu9(spark, sf):
    return U.sector_exposure(abook(spark, sf), A.profiles(spark, sf))


@query("fu9_top_contributors", "SELECT * FROM (SELECT *, 'best' AS side FROM con ORDER BY realized_pnl DESC, symbol LIMIT 5) UNION ALL SELECT * FROM (SELECT *, 'worst' AS side FROM con ORDER BY realized_pnl, symbol LIMIT 5)", CD, CON)
def fu9b(spark, sf):
    return L.extremes(L.contribution(A.trades(spark, sf)), "realized_pnl", 5)
