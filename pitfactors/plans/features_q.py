"""Every registered feature over the driver's tables."""

from pyspark.sql import functions as F

from pitfactors.operators import features as X
from pitfactors.plans.catalogue import query
from pitfactors.plans.joins_q import AVAILABLE
from pitfactors.sources import adapters as A


def _ttm(col):
    return f"CASE WHEN count({col}) OVER w4 = 4 THEN sum({col}) OVER w4 END AS ttm_{col}"


def _yoy(col, back=0):
    now, then = f"lag({col}, {back}) OVER w", f"lag({col}, {back + 4}) OVER w"
    return f"CASE WHEN {then} <> 0 THEN ({now} - {then}) / abs({then}) * 100.0::DOUBLE END"


def _margin(col, k):
    return f"lag({col}, {k}) OVER w / nullif(lag(revenue, {k}) OVER w, 0) * 100.0::DOUBLE"


VIEWS = {
    "avail": AVAILABLE,
    "avail_bal": "SELECT b.*, a.available_from FROM balance b JOIN avail a USING (symbol, date)",
    "avail_cash": "SELECT b.*, a.available_from FROM cashflow b JOIN avail a USING (symbol, date)",
    "facts_inc": f"""SELECT symbol, available_from, shares_diluted AS shares,
  {', '.join(_ttm(x) for x in X.INCOME)},
  {_yoy('eps_diluted')} AS eps_yoy, {_yoy('revenue')} AS rev_yoy,
  {_margin('net_income', 0)} - {_margin('net_income', 4)} AS net_margin_yoy_delta,
  {_margin('operating_income', 0)} - {_margin('operating_income', 4)} AS op_margin_yoy_delta,
  {_yoy('revenue')} - {_yoy('revenue', 1)} AS rev_yoy_accel, {_yoy('eps_diluted')} - {_yoy('eps_diluted', 1)} AS eps_yoy_accel,
  (shares_diluted / lag(shares_diluted, 4) OVER w - 1) * 100.0::DOUBLE AS issued FROM avail
  WINDOW w AS (PARTITION BY symbol ORDER BY available_from), w4 AS (PARTITION BY symbol ORDER BY available_from ROWS 3 PRECEDING)""",
    "facts_bal": """SELECT symbol, available_from, total_equity, total_debt, net_debt, total_assets,
  (total_assets / lag(total_assets, 4) OVER w - 1) * 100.0::DOUBLE AS growth FROM avail_bal
  WINDOW w AS (PARTITION BY symbol ORDER BY available_from)""",
    "facts_cash": f"""SELECT symbol, available_from, {', '.join(_ttm(x) for x in X.CASH)} FROM avail_cash
  WINDOW w4 AS (PARTITION BY symbol ORDER BY available_from ROWS 3 PRECEDING)""",
    "facts_sue": """SELECT symbol, date, diff, count(diff) OVER w AS n_surprises, CASE WHEN count(diff) OVER w >= 4 AND stddev_samp(diff) OVER w > 0
  THEN greatest(-20.0, least(20.0, diff / stddev_samp(diff) OVER w)) END AS sue
  FROM (SELECT symbol, date, eps_actual - eps_estimated AS diff FROM earnings WHERE eps_estimated IS NOT NULL)
  WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 7 PRECEDING)""",
    "net_grades": """SELECT symbol, date, sum(CASE action WHEN 'upgrade' THEN 1 WHEN 'downgrade' THEN -1 ELSE 0 END) AS net FROM grades GROUP BY 1, 2""",
    "wide": """SELECT b.symbol, b.date, b.close, b.close * i.shares AS mcap, i.* EXCLUDE (symbol), f.* EXCLUDE (symbol, available_from),
  b.close * i.shares + f.net_debt AS ev, k.* EXCLUDE (symbol, available_from)
  FROM bars b ASOF JOIN facts_inc i ON b.symbol = i.symbol AND b.date >= i.available_from
  ASOF LEFT JOIN facts_bal f ON b.symbol = f.symbol AND b.date >= f.available_from
  ASOF LEFT JOIN facts_cash k ON b.symbol = k.symbol AND b.date >= k.available_from WHERE i.shares > 0""",
    "own": "SELECT symbol, date, close, volume, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS ret FROM bars",
    "priced": "SELECT p.*, row_number() OVER (PARTITION BY symbol ORDER BY date) AS rn FROM own p",
    "visible": "SELECT symbol, min(available_from) AS since FROM avail GROUP BY 1",
    "next_reports": """SELECT b.symbol, b.date, CAST(n.date - b.date AS INTEGER) AS ahead, CAST(b.date - l.date AS INTEGER) AS behind
  FROM bars b JOIN visible v ON v.symbol = b.symbol AND b.date >= v.since
  ASOF LEFT JOIN (SELECT symbol, date FROM earnings) n ON n.symbol = b.symbol AND b.date < n.date
  ASOF LEFT JOIN (SELECT symbol, date FROM earnings) l ON l.symbol = b.symbol AND b.date >= l.date""",
}


def _on_bars(expr, window=""):
    return f"""SELECT symbol, date, value FROM (SELECT symbol, date, {expr} AS value FROM priced {window}) JOIN visible USING (symbol) WHERE date >= since"""


def _wide(expr):
    return f"SELECT symbol, date, {expr} AS value FROM wide"


def _pos(num, den, scale=1.0):
    return f"CASE WHEN {den} > 0 THEN {num} / {den} * {scale}::DOUBLE END"


W = "WINDOW w AS (PARTITION BY symbol ORDER BY date)"


def _ret(n, skip=0):
    return _on_bars(f"CASE WHEN lag(close, {n + skip}) OVER w > 0 THEN (lag(close, {skip}) OVER w / lag(close, {n + skip}) OVER w - 1) * 100.0::DOUBLE END", W)


def _vol(n):
    return _on_bars(f"CASE WHEN rn > {n} THEN stddev_samp(ret) OVER w * sqrt(252.0) * 100.0::DOUBLE END",
                    f"WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS {n - 1} PRECEDING)")


def _upgrades(n):
    return f"""SELECT b.symbol, b.date, CAST(coalesce(sum(g.net), 0) AS DOUBLE) AS value FROM bars b JOIN visible v ON v.symbol = b.symbol AND b.date >= v.since
  LEFT JOIN net_grades g ON g.symbol = b.symbol AND g.date <= b.date AND g.date > b.date - {n} GROUP BY 1, 2"""


def _dd(frame):
    return f"SELECT symbol, date, (close - max(close) OVER w) / max(close) OVER w * 100.0::DOUBLE AS value FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS {frame} PRECEDING)"


ORACLE = {
    "pe": _wide(_pos("mcap", "ttm_net_income")),
    "ps": _wide(_pos("mcap", "ttm_revenue")),
    "p_b": _wide(_pos("mcap", "total_equity")),
    "ev_ebitda": _wide(_pos("ev", "ttm_ebitda")),
    "ev_sales": _wide(_pos("ev", "ttm_revenue")),
    "earnings_yield": _wide(_pos("ttm_net_income", "mcap", 100.0)),
    "book_to_price": _wide(_pos("total_equity", "mcap", 100.0)),
    "sales_to_price": _wide(_pos("ttm_revenue", "mcap", 100.0)),
    "ebitda_to_ev": _wide(_pos("ttm_ebitda", "ev", 100.0)),
    "sales_to_ev": _wide(_pos("ttm_revenue", "ev", 100.0)),
    "fcf_yield": _wide(_pos("ttm_free_cash_flow", "mcap", 100.0)),
    "div_yield": _wide(_pos("abs(ttm_dividends_paid)", "mcap", 100.0)),
    "eps_yoy": _wide("eps_yoy"),
    "rev_yoy": _wide("rev_yoy"),
    "net_margin": _wide(_pos("ttm_net_income", "ttm_revenue", 100.0)),
    "op_margin": _wide(_pos("ttm_operating_income", "ttm_revenue", 100.0)),
    "gross_margin": _wide(_pos("ttm_gross_profit", "ttm_revenue", 100.0)),
    "net_margin_yoy_delta": _wide("net_margin_yoy_delta"),
    "op_margin_yoy_delta": _wide("op_margin_yoy_delta"),
    "rev_yoy_accel": _wide("rev_yoy_accel"),
    "eps_yoy_accel": _wide("eps_yoy_accel"),
    "roe": _wide(_pos("ttm_net_income", "total_equity", 100.0)),
    "roic": _wide(_pos("ttm_operating_income", "(greatest(coalesce(total_equity, 0), 0) + greatest(coalesce(total_debt, 0), 0))", 100.0)),
    "debt_to_equity": _wide(_pos("total_debt", "total_equity")),
    "gross_profitability": _wide("CASE WHEN ttm_gross_profit / total_assets > -5 AND ttm_gross_profit / total_assets < 10 THEN ttm_gross_profit / total_assets END"),
    "accruals": _wide("CASE WHEN abs((ttm_net_income - ttm_operating_cf) / total_assets) < 5 THEN (ttm_net_income - ttm_operating_cf) / total_assets END"),
    "net_issuance": _wide("CASE WHEN issued BETWEEN -100 AND 500 THEN issued END"),
    "asset_growth": _wide("CASE WHEN growth BETWEEN -100 AND 1000 THEN growth END"),
    "sue": """SELECT b.symbol, b.date, s.sue AS value FROM bars b JOIN visible v ON v.symbol = b.symbol AND b.date >= v.since
  ASOF LEFT JOIN facts_sue s ON s.symbol = b.symbol AND b.date >= s.date""",
    "ret_1m": _ret(21), "ret_3m": _ret(63), "ret_6m": _ret(126), "ret_12m": _ret(252), "ret_12_1m": _ret(231, 21),
    "realized_vol_60": _vol(60), "realized_vol_252": _vol(252),
    "analyst_net_upgrades_30d": _upgrades(30), "analyst_net_upgrades_90d": _upgrades(90),
    "days_to_next_earnings": "SELECT symbol, date, CAST(ahead AS DOUBLE) AS value FROM next_reports",
    "days_since_last_earnings": "SELECT symbol, date, CAST(behind AS DOUBLE) AS value FROM next_reports",
    "pre_earnings_window_5d": "SELECT symbol, date, CASE WHEN ahead <= 5 THEN 1.0::DOUBLE WHEN ahead > 5 THEN 0.0::DOUBLE END AS value FROM next_reports",
    "rsi_14": "",
    "drawdown_60d": _dd(59), "drawdown_252d": _dd(251), "drawdown_alltime": _dd("UNBOUNDED"),
    "vol_z_20": """SELECT symbol, date, CASE WHEN count(volume) OVER w = 20 AND stddev_samp(volume) OVER w > 0 THEN (volume - avg(volume) OVER w) / stddev_samp(volume) OVER w END AS value
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)""",
    "dollar_vol_20": """SELECT symbol, date, CASE WHEN count(volume) OVER w = 20 THEN avg(close * volume) OVER w END AS value
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)""",
}

RSI_VIEWS = {
    "moves": """SELECT symbol, date, rn - 1 AS k, greatest(d, 0) AS up, greatest(-d, 0) AS down FROM (SELECT symbol, date,
  row_number() OVER w AS rn, close - lag(close) OVER w AS d FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)) WHERE rn > 1""",
    "smooth": """SELECT symbol, CAST(14 AS BIGINT) AS k, avg(up) AS up, avg(down) AS down FROM moves WHERE k <= 14 GROUP BY symbol HAVING count(*) = 14
  UNION ALL SELECT s.symbol, s.k + 1, (s.up * 13 + m.up) / 14, (s.down * 13 + m.down) / 14 FROM smooth s JOIN moves m ON m.symbol = s.symbol AND m.k = s.k + 1""",
}
RSI_SQL = """SELECT m.symbol, m.date, floor((CASE WHEN s.down = 0 THEN 100 ELSE 100 - 100 / (1 + s.up / s.down) END) * 100 + 0.5) / 100 AS rsi
  FROM smooth s JOIN moves m USING (symbol, k)"""


def build(spark, sf, names=None, only=True):
    inc = A.statements(spark, sf)
    return X.panel(A.bars(spark, sf), inc, A.balance(inc), A.cashflow(inc), A.earnings(inc), A.grades(spark, sf), names, only)


def _add(i, name):
    if name == "rsi_14":
        @query(f"f{i}_rsi_14", RSI_SQL, "rsi:2", RSI_VIEWS)
        def run(spark, sf):
            found = build(spark, sf, ["rsi_14"], False).withColumnRenamed("rsi_14", "rsi")
            return found.filter(F.col("rsi").isNotNull())
        return
    digits = "value:4" if name == "dollar_vol_20" else "value"

    @query(f"f{i:02d}_{name}", ORACLE[name], digits, VIEWS)
    def run(spark, sf):
        on_facts = X.REGISTRY[name].materialised
        return build(spark, sf, [name], on_facts).withColumnRenamed(name, "value")


for _i, _name in enumerate(ORACLE, 1):
    _add(_i, _name)


@query("fa_ttm_sum", "SELECT symbol, available_from, ttm_revenue, ttm_net_income FROM facts_inc", "ttm_revenue:3 ttm_net_income:3", VIEWS)
def fa(spark, sf):
    from pitfactors.plans.joins_q import _income

    return X.income_facts(_income(spark, sf)).select("symbol", "available_from", "ttm_revenue", "ttm_net_income")


@query("fb_yoy", "SELECT symbol, available_from, rev_yoy, eps_yoy FROM facts_inc", "rev_yoy eps_yoy", VIEWS)
def fb(spark, sf):
    from pitfactors.plans.joins_q import _income

    return X.income_facts(_income(spark, sf)).select("symbol", "available_from", "rev_yoy", "eps_yoy")


X.register("market_cap", X.mcap, ("income",), "size", unit="dollars", materialised=False, factor=False)
X.register("enterprise_value", X.ev, ("income", "balance"), "size", unit="dollars", materialised=False, factor=False)


@query("fc_market_cap", _wide("mcap"), "value:2", VIEWS)
def fc(spark, sf):
    return build(spark, sf, ["market_cap"]).withColumnRenamed("market_cap", "value")


@query("fd_enterprise_value", _wide("ev"), "value:2", VIEWS)
def fd(spark, sf):
    return build(spark, sf, ["enterprise_value"]).withColumnRenamed("enterprise_value", "value")


@query("fe_trailing_return", _ret(10, 5).replace("JOIN visible USING (symbol) WHERE date >= since", ""), "value", VIEWS)
def fe(spark, sf):
    return A.bars(spark, sf).select("symbol", "date", X.trailing_return(10, 5).alias("value"))


@query("ff_daily_returns", "SELECT symbol, date, ret AS value FROM own", "value", VIEWS)
def ff(spark, sf):
    return A.bars(spark, sf).select("symbol", "date", (X.trailing_return(1) / 100.0).alias("value"))


@query("fg_surprises", "SELECT symbol, date, diff, n_surprises, sue FROM facts_sue", "diff sue", VIEWS)
def fg(spark, sf):
    return X.surprise_facts(A.earnings(A.income(spark, sf)))


@query("fh_report_distance", "SELECT symbol, date, CAST(ahead AS DOUBLE) AS days_to_next_earnings, CAST(behind AS DOUBLE) AS days_since_last_earnings FROM next_reports", views=VIEWS)
def fh(spark, sf):
    return build(spark, sf, ["days_to_next_earnings", "days_since_last_earnings"])


@query("fi_net_grades", "SELECT symbol, date, CAST(net AS BIGINT) AS net FROM net_grades", views=VIEWS)
def fi(spark, sf):
    return X.grade_counts(A.grades(spark, sf))


SOME = ["pe", "roe", "rev_yoy", "ret_1m", "realized_vol_60", "accruals", "days_since_last_earnings"]
_JOINED = " JOIN ".join(f"(SELECT symbol, date, value AS {n} FROM ({ORACLE[n]}))" + ("" if i == 0 else " USING (symbol, date)") for i, n in enumerate(SOME))


@query("f48_panel", f"SELECT * FROM {_JOINED.replace(') JOIN', ') JOIN')}", " ".join(SOME), VIEWS)
def f48(spark, sf):
    return build(spark, sf, SOME)


@query("f48_panel_recent", f"SELECT * FROM {_JOINED} WHERE date >= (SELECT max(date) FROM bars) - 7", " ".join(SOME), VIEWS)
def f48b(spark, sf):
    return X.recent(build(spark, sf, SOME), A.bars(spark, sf))


def _spread(table):
    """A feature of a feature: gap between two smoothings of the RSI, from two functions that feed each other."""
    import numpy as np
    import pyarrow as pa

    rsi = table.column("rsi_14").to_numpy(zero_copy_only=False).astype(float)
    return pa.table({"rsi_change": pa.array(np.concatenate([[np.nan], np.diff(rsi)]), from_pandas=True), "rsi_gap": pa.array(rsi - table.column("ret_1m").to_numpy(zero_copy_only=False).astype(float), from_pandas=True)})


X.register_grouped("rsi_moves", _spread, ("rsi_14", "ret_1m"), {"rsi_change": {"unit": "points"}, "rsi_gap": {"unit": "points"}}, "momentum", factor=False)


@query("fj_grouped_features",
       f"""SELECT p.symbol, p.date, r.rsi AS rsi_14, r.rsi - lag(r.rsi) OVER (PARTITION BY p.symbol ORDER BY p.date) AS rsi_change, r.rsi - m.value AS rsi_gap, q.value AS pe
  FROM priced p LEFT JOIN (SELECT symbol, date, floor(rsi * 100 + 0.5) / 100 AS rsi FROM ({RSI_SQL})) r USING (symbol, date) LEFT JOIN ({ORACLE['ret_1m'].replace("JOIN visible USING (symbol) WHERE date >= since", "")}) m USING (symbol, date)
  LEFT JOIN ({ORACLE['pe']}) q USING (symbol, date)""", "rsi_14:2 rsi_change:2 rsi_gap:4 pe", {**VIEWS, **RSI_VIEWS})
def fj(spark, sf):
    """Two grouped functions, one fed by the other and by a window feature, beside a fundamental."""
    return build(spark, sf, ["rsi_14", "rsi_change", "rsi_gap", "pe"], False)


@query("f49_coverage", " UNION ALL ".join(f"SELECT '{n}' AS feature, count(value) AS non_null, count(*) AS rows FROM ({ORACLE[n]})" for n in SOME), views=VIEWS)
def f49(spark, sf):
    return X.coverage(build(spark, sf, SOME))


@query("f50_series", f"SELECT symbol, date, value FROM ({ORACLE['roe']}) WHERE value IS NOT NULL AND date >= DATE '1999-01-01' - 365 AND date <= DATE '1999-12-31'", "value", VIEWS)
def f50(spark, sf):
    return X.series(build(spark, sf, ["roe"]), "roe", "1999-01-01", "1999-12-31")
