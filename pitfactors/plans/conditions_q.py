"""Entry and exit conditions over the driver's tables."""

from pyspark.sql import functions as F

from pitfactors.operators import conditions as C
from pitfactors.plans import events_q as EQ
from pitfactors.plans import features_q as FQ
from pitfactors.plans.catalogue import query
from pitfactors.sources import adapters as A

FIRST, LAST = "(SELECT min(date) FROM calendar)", "(SELECT max(date) FROM calendar)"
SPAN = f"date BETWEEN {FIRST} AND {LAST}"


def whole(spark, sf):
    """First and last date of the calendar."""
    ends = A.dates(spark, sf).agg(F.min("date"), F.max("date")).first()
    return tuple(str(d) for d in ends)


def data(spark, sf, *names):
    inc = A.statements(spark, sf) if set(names) & {"income", "earnings", "pe"} else None
    make = {
        "income": lambda: inc, "earnings": lambda: A.earnings(inc), "grades": lambda: A.grades(spark, sf),
        "profiles": lambda: A.profiles(spark, sf), "benchmark": lambda: A.market(spark, sf),
        "pe": lambda: pe_series(inc), "panel": lambda: FQ.build(spark, sf, ["roe", "pe"]),
        "series": lambda: FQ.build(spark, sf, ["rsi_14"], False),
    }
    named = {"panel" if n == "series" else n: make[n]() for n in names}
    return C.Data(bars=A.bars(spark, sf), calendar=A.dates(spark, sf), **named)


def pe_series(inc):
    """Quarterly price-earnings series: a deterministic stand-in for vendor key metrics."""
    pe = F.col("shares_diluted") * 100.0 / F.col("net_income")
    return inc.filter(F.col("net_income") > 0).select("symbol", "date", pe.alias("pe"))


PE = {"pe_q": "SELECT symbol, date, shares_diluted * 100.0::DOUBLE / net_income AS pe FROM income WHERE net_income > 0"}


def _cond(name, cfg, sql, needs=(), views=None, digits="value"):
    @query(name, sql, digits, views)
    def run(spark, sf):
        return C.signal(data(spark, sf, *needs), cfg, *whole(spark, sf)).select("symbol", "date", "value")


def _val(sql, col, date="date"):
    return f"SELECT symbol, {date} AS date, CAST({col} AS DOUBLE) AS value FROM ({sql}) WHERE {SPAN.replace('date BETWEEN', date + ' BETWEEN')}"


_drop = """SELECT symbol, date, floor(((close - pk) / pk * 100) * 1e2 + 0.5) / 1e2 AS dd FROM (SELECT symbol, date, close, max(close) OVER w AS pk, count(*) OVER w AS k FROM bars
  WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 64 PRECEDING AND 1 PRECEDING)) WHERE k = 64 AND (close - pk) / pk * 100 <= -75"""
_cond("c01_current_drop", {"type": "current_drop", "threshold": -75.0}, _val(_drop, "dd"))
_cond("c02_period_drop", {"type": "period_drop", "window_days": 29, "threshold": -80.0}, _val("SELECT * FROM drops", "drawdown_pct", "signal_date"), views=EQ.PD)
_cond("c03_daily_drop", {"type": "daily_drop", "threshold": -50.0},
      _val("""SELECT symbol, date, floor((close - p) / p * 100 * 1e2 + 0.5) / 1e2 AS ch FROM (SELECT symbol, date, close, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS p FROM bars)
  WHERE (close - p) / p * 100 <= -50""", "ch"))
_cond("c04_selloff", {"type": "selloff", "threshold": -40.0},
      _val('SELECT b.symbol, b.date, e.drawdown_pct FROM bars b JOIN evt e ON e.symbol = b.symbol AND b.date >= e.trigger_date AND b.date <= e."current_date"', "drawdown_pct"), views=EQ.RV)

MOMENTUM = f"""SELECT symbol, CAST(unnest(generate_series(since, least(coalesce(nxt - 1, {LAST}), {LAST}), INTERVAL 1 DAY)) AS DATE) AS date, CAST(beats AS DOUBLE) AS value FROM
  (SELECT symbol, date AS since, sum(CASE WHEN eps_actual > eps_estimated THEN 1 ELSE 0 END) OVER w AS beats, count(*) OVER w AS n,
   lead(date) OVER (PARTITION BY symbol ORDER BY date) AS nxt FROM earnings WHERE eps_estimated IS NOT NULL
   WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 3 PRECEDING)) WHERE n >= 2 AND beats >= 2"""
_cond("c05_earnings_momentum", {"type": "earnings_momentum"}, f"SELECT * FROM ({MOMENTUM}) WHERE {SPAN}", ("earnings",))


def _percentile(source, value, part="date", extra=""):
    return f"""SELECT symbol, date, v AS value FROM (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY v, symbol) AS rn, count(*) OVER (PARTITION BY {part}) AS n,
   count(*) OVER (PARTITION BY date) AS all_n FROM
  (SELECT s.symbol, c.date, x.{value} AS v, p.sector FROM (SELECT date FROM calendar WHERE {SPAN}) c JOIN (SELECT DISTINCT symbol FROM {source}) s ON TRUE
   ASOF JOIN (SELECT * FROM {source}) x ON x.symbol = s.symbol AND c.date >= x.date LEFT JOIN profiles p ON p.symbol = s.symbol) WHERE {extra or 'TRUE'})
  WHERE n >= 3 AND all_n >= 3 AND rn <= greatest(1, floor(n * 30.0 / 100))"""


_cond("c06_pe_percentile", {"type": "pe_percentile"}, _percentile("pe_q", "pe", extra="v BETWEEN 0 AND 500"), ("pe",), PE)


def _held(sql, value):
    return f"""SELECT symbol, CAST(unnest(generate_series(signal_date, least(coalesce(nxt - 1, signal_date + 100), {LAST}), INTERVAL 1 DAY)) AS DATE) AS date, CAST({value} AS DOUBLE) AS value
  FROM (SELECT *, lead(signal_date) OVER (PARTITION BY symbol ORDER BY date) AS nxt FROM ({sql}) WHERE signal_date BETWEEN {FIRST} AND {LAST})"""


Q = ("income", "earnings")
_cond("c07_revenue_growth", {"type": "revenue_growth_yoy", "threshold": 15.0},
      _held("SELECT * FROM yoy WHERE revenue_yoy >= 15", "revenue_yoy"), Q, EQ.QV)
_cond("c08_revenue_accelerating", {"type": "revenue_accelerating"}, _held("SELECT * FROM runs WHERE streak >= 2", "revenue_yoy"), Q,
      EQ._streaks("revenue_yoy > prev_yoy"))
_cond("c09_margin_expanding", {"type": "margin_expanding"}, _held("SELECT * FROM runs WHERE streak >= 2", "net_margin"), Q,
      EQ._streaks("net_margin_yoy_bps > 0 AND net_margin > prev_margin"))
_cond("c10_margin_turnaround", {"type": "margin_turnaround", "threshold_bps": 5.0}, _held("SELECT * FROM runs WHERE streak >= 2", "net_margin"), Q,
      EQ._streaks("net_margin_yoy_bps >= 5"))
_cond("c11_relative_performance", {"type": "relative_performance"}, _val(f"""SELECT x.symbol, x.date, floor((x.close / x.c0 - 1) * 100 * 1e2 + 0.5) / 1e2 AS own FROM
  (SELECT symbol, date, close, lag(close, 126) OVER w AS c0, lag(date, 126) OVER w AS d0 FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)) x
  JOIN market m1 ON m1.date = x.date JOIN market m0 ON m0.date = x.d0 WHERE (x.close / x.c0 - 1) * 100 - (m1.close / m0.close - 1) * 100 >= 20""", "own"), ("benchmark",))
_cond("c12_volume_conviction", {"type": "volume_conviction", "ratio": 0.9}, _val(EQ.CONVICTION, "short_vol"))
_cond("c13_rsi", {"type": "rsi", "operator": "<=", "value": 45}, _val(EQ.RSI_SQL, "rsi") + " AND rsi <= 45", views=EQ.RSI_VIEWS)
_cond("c14_momentum_rank", {"type": "momentum_rank", "operator": ">=", "value": 75}, _val("SELECT * FROM mom WHERE n > 1 AND momentum_rank >= 75", "momentum_rank"), views=EQ.MOMENTUM)
_cond("c15_ma_crossover", {"type": "ma_crossover", "operator": "==", "value": 1}, _val(EQ.CROSS, "ma_signal") + " AND ma_signal = 1")
_cond("c16_volume_capitulation", {"type": "volume_capitulation"}, _val(EQ.CAPITULATION, "volume_ratio"))
_cond("c17_always", {"type": "always"}, f"SELECT p.symbol, c.date, 0.0::DOUBLE AS value FROM profiles p, calendar c WHERE {SPAN}")
ROE = f"SELECT * FROM ({FQ.ORACLE['roe']}) WHERE value IS NOT NULL"
_cond("c18_feature_threshold", {"type": "feature_threshold", "feature": "roe", "operator": ">", "value": 2.0}, _val(ROE + " AND value > 2.0", "value"), ("panel",), FQ.VIEWS)
_cond("c18_feature_threshold_rsi", {"type": "feature_threshold", "feature": "rsi_14", "operator": "<=", "value": 45}, _val(EQ.RSI_SQL, "rsi") + " AND rsi <= 45", ("series",), EQ.RSI_VIEWS)
ROEV = {**FQ.VIEWS, "roe_s": ROE}
_cond("c19_feature_percentile", {"type": "feature_percentile", "feature": "roe"}, _percentile("roe_s", "value"), ("panel",), ROEV)
_cond("c19_feature_percentile_sector", {"type": "feature_percentile", "feature": "roe", "scope": "sector", "min_value": 0.5},
      _percentile("roe_s", "value", "date, sector", "v >= 0.5"), ("panel", "profiles"), ROEV)
_cond("c20_days_to_earnings", {"type": "days_to_earnings"},
      f"""SELECT symbol, date, CAST(days AS DOUBLE) AS value FROM (SELECT s.symbol, c.date, min(e.date) - c.date AS days FROM calendar c JOIN (SELECT DISTINCT symbol FROM earnings) s ON TRUE
  JOIN earnings e ON e.symbol = s.symbol AND e.date >= c.date WHERE c.date BETWEEN {FIRST} AND {LAST} GROUP BY 1, 2) WHERE days BETWEEN 0 AND 7""", ("earnings",))
_cond("c21_analyst_upgrades", {"type": "analyst_upgrades", "min_net_upgrades": 5},
      f"""SELECT s.symbol, c.date, CAST(sum(n.net) AS DOUBLE) AS value FROM (SELECT date FROM calendar WHERE {SPAN}) c JOIN (SELECT DISTINCT symbol FROM net_grades) s ON TRUE
  JOIN net_grades n ON n.symbol = s.symbol AND n.date BETWEEN c.date - 90 AND c.date GROUP BY 1, 2 HAVING sum(n.net) >= 5""", ("grades",), FQ.VIEWS)


EXITS = {**EQ._streaks("revenue_yoy < prev_yoy"),
         "runs2": EQ._streaks("net_margin_yoy_bps <= -5")["runs"]}


@query("c22_exit_signals",
       f"""SELECT symbol, date, reason, streak, margin_yoy_bps, quarter_end FROM (SELECT *, row_number() OVER (PARTITION BY symbol, date ORDER BY o) AS k FROM
  (SELECT symbol, signal_date AS date, 'revenue_deceleration' AS reason, streak, net_margin_yoy_bps AS margin_yoy_bps, date AS quarter_end, 0 AS o FROM runs a WHERE streak >= 2
    AND EXISTS (SELECT 1 FROM runs b WHERE b.symbol = a.symbol AND b.rn <= a.rn AND b.rn > a.rn - a.streak AND b.net_margin_yoy_bps < 0)
   UNION ALL SELECT symbol, signal_date, 'margin_collapse', streak, net_margin_yoy_bps, date, 1 FROM runs2 WHERE streak >= 2)) WHERE k = 1 AND {SPAN}""", views=EXITS)
def c22(spark, sf):
    return C.exit_signals(data(spark, sf, "income", "earnings"),
                          [{"type": "revenue_deceleration"}, {"type": "margin_collapse", "threshold_bps": -5.0}], *whole(spark, sf))


@query("c23_comparison_operators", " UNION ALL ".join(
    f"SELECT '{o}' AS op, count(*) AS n FROM profiles WHERE length(symbol) {o.replace('==', '=')} 8" for o in (">", ">=", "<", "<=", "==", "!=")))
def c23(spark, sf):
    from pitfactors.functions.columns import COMPARISONS, compare

    p = A.profiles(spark, sf)
    counts = p.agg(*[F.count_if(compare(F.length("symbol"), o, 8)).alias(o) for o in COMPARISONS])
    return counts.unpivot([], [F.col(f"`{o}`") for o in COMPARISONS], "op", "n")


DROP = {"type": "current_drop", "threshold": -60.0}
REP = {"type": "days_to_earnings", "max_days": 30}
DROP_SQL = f"SELECT symbol, date, dd FROM ({_drop.replace('-75', '-60')}) WHERE {SPAN}"
REP_SQL = f"""SELECT symbol, date, CAST(days AS DOUBLE) AS value FROM (SELECT s.symbol, c.date, min(e.date) - c.date AS days FROM calendar c JOIN (SELECT DISTINCT symbol FROM earnings) s ON TRUE
  JOIN earnings e ON e.symbol = s.symbol AND e.date >= c.date WHERE c.date BETWEEN {FIRST} AND {LAST} GROUP BY 1, 2) WHERE days BETWEEN 0 AND 30"""
UV = {"sig_a": DROP_SQL, "sig_b": REP_SQL}


def _two(spark, sf):
    d = data(spark, sf, "earnings")
    ends = whole(spark, sf)
    return [C.signal(d, c, *ends) for c in (DROP, REP)]


def _flat(df):
    m = F.col("meta")
    return df.select("symbol", "date", "value", m["condition_0_value"].cast("double").alias("drop"), m["condition_1_value"].cast("double").alias("days"))


@query("u10_combine_all", "SELECT a.symbol, a.date, a.dd AS value, a.dd AS drop, b.value AS days FROM sig_a a JOIN sig_b b USING (symbol, date)", "value drop days", UV)
def u10(spark, sf):
    return _flat(C.combine(_two(spark, sf), "all"))


@query("u11_combine_any", "SELECT symbol, date, coalesce(a.dd, b.value) AS value, a.dd AS drop, b.value AS days FROM sig_a a FULL JOIN sig_b b USING (symbol, date)", "value drop days", UV)
def u11(spark, sf):
    return _flat(C.combine(_two(spark, sf), "any"))


@query("u12_priority", "SELECT symbol, date, coalesce(a.dd, b.value) AS priority FROM sig_a a FULL JOIN sig_b b USING (symbol, date)", "priority", UV)
def u12(spark, sf):
    return C.priority(C.combine(_two(spark, sf), "any"))


@query("u13_records", """SELECT symbol, date, CAST((a.dd IS NOT NULL)::INT + (b.value IS NOT NULL)::INT AS INTEGER) AS n,
  CASE WHEN a.dd IS NULL THEN 'days_to_earnings' ELSE 'current_drop' END AS first_type, coalesce(a.dd, b.value) AS observed FROM sig_a a FULL JOIN sig_b b USING (symbol, date)""", "observed", UV)
def u13(spark, sf):
    out = C.records(_two(spark, sf), [DROP, REP], "any")
    first = F.col("records")[0]
    return out.select("symbol", "date", F.size("records").alias("n"), first["type"].alias("first_type"), first["observed"]["value"].cast("double").alias("observed"))
