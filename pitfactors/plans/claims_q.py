"""Claims, run metrics and lookups over the driver's tables."""

from pyspark.sql import functions as F

from pitfactors.operators import calendars
from pitfactors.operators import claims as C
from pitfactors.operators import features as X
from pitfactors.operators import lookup as Q
from pitfactors.operators import macro as M
from pitfactors.operators import regimes as R
from pitfactors.operators import runs as W
from pitfactors.functions.columns import by_symbol
from pitfactors.plans import features_q as FQ
from pitfactors.plans import nav_q as NQ
from pitfactors.plans import regimes_q as RQ
from pitfactors.plans.catalogue import query
from pitfactors.plans.joins_q import WINDOWS, windows
from pitfactors.sources import adapters as A

DSV = {
    "dsp": """SELECT symbol, date, (close / lag(close, 3) OVER w - 1) * 100.0::DOUBLE AS prim, close AS cond, lead(close, 1) OVER w / close - 1 AS fwd FROM sbars WINDOW w AS (PARTITION BY symbol ORDER BY date)""",
    "ds1": "SELECT *, row_number() OVER (PARTITION BY date ORDER BY prim DESC, symbol) AS r1, count(*) OVER (PARTITION BY date) AS n FROM dsp WHERE prim IS NOT NULL AND cond IS NOT NULL",
    "ds2": "SELECT *, row_number() OVER (PARTITION BY date ORDER BY cond, symbol) AS r2, count(*) OVER (PARTITION BY date) AS k FROM ds1 WHERE n >= 25 AND r1 <= greatest(floor(n * 0.2), 5) AND greatest(floor(n * 0.2), 5) >= 10",
    "dsx": "SELECT * FROM (SELECT date, avg(CASE WHEN r2 <= greatest(floor(k / 5), 1) THEN fwd END) - avg(CASE WHEN r2 > k - greatest(floor(k / 5), 1) THEN fwd END) AS spread FROM ds2 GROUP BY 1) WHERE spread IS NOT NULL",
}


def panel(spark, sf):
    b = A.bars(spark, sf, symbol="l_suppkey", grain="month")
    return b.select("symbol", "date", X.trailing_return(3).alias("primary"), F.col("close").alias("conditioning"),
                    (F.lead("close", 1).over(by_symbol()) / F.col("close") - 1).alias("fwd"))


@query("v36_double_sort", "SELECT * FROM dsx", "spread", DSV)
def v36(spark, sf):
    return C.double_sort(panel(spark, sf))


@query("v37_random_control")
def v37(spark, sf):
    return C.double_sort(panel(spark, sf), seed=42)


def labels(spark, sf):
    """Active regimes on month starts."""
    m = A.macro(spark, sf)
    dates = calendars.date_array(A.bars(spark, sf, symbol="l_suppkey", grain="month"))
    wide = R.macro_wide(m, dates, [RQ.U, RQ.H, RQ.L])
    return R.active_lists(R.stateless(wide, RQ.RS))


LAB = {**DSV,
       "lmw": RQ.RV["mw"].replace("FROM calendar c", "FROM scalendar c"),
       "lab": "SELECT date, list_filter([CASE WHEN coalesce(u < 250000 AND h < 260000, FALSE) THEN 'calm' END, CASE WHEN coalesce(u > 270000, FALSE) OR coalesce(l > 290000, FALSE) THEN 'hot' END], lambda x: x IS NOT NULL) AS active FROM lmw",
       "lrows": "SELECT x.date, x.spread, unnest(CASE WHEN len(l.active) > 0 THEN l.active ELSE ['neutral'] END) AS regime FROM dsx x LEFT JOIN lab l USING (date) UNION ALL SELECT date, spread, '__overall__' FROM dsx",
       "preg": "SELECT regime, count(*) AS n, avg(spread) * 12 * 100 AS mean_ann_pct, CASE WHEN count(*) > 1 AND stddev_pop(spread) > 0 THEN avg(spread) / (stddev_pop(spread) / sqrt(count(*))) ELSE 0 END AS t_stat, avg(CASE WHEN spread > 0 THEN 1.0::DOUBLE ELSE 0 END) AS hit_rate FROM lrows GROUP BY 1"}
SUM = "mean_ann_pct t_stat hit_rate"


@query("v38_by_regime", "SELECT * FROM preg", SUM, LAB)
def v38(spark, sf):
    return C.by_regime(C.double_sort(panel(spark, sf)), labels(spark, sf), 21)


VERD = """SELECT *, CASE WHEN holds > 0 AND reverses > 0 THEN 'regime_reversing' WHEN abs(overall_t) >= 1.5 AND holds > 0 THEN CASE WHEN ag = 0 THEN 'unconditional' ELSE 'validated_conditional' END
  WHEN holds > 0 OR reverses > 0 THEN 'validated_conditional' ELSE 'rejected' END AS status FROM (SELECT count(*) FILTER (WHERE big AND t_stat >= 1.5) AS holds, count(*) FILTER (WHERE big AND t_stat <= -1.5) AS reverses, max(o) AS overall_t, max(om) AS overall_mean,
   count(*) FILTER (WHERE big AND ((om0 >= 0) <> (mean_ann_pct >= 0))) + count(*) FILTER (WHERE big AND abs(t_stat) < 0.5) AS ag FROM
   (SELECT *, regime <> '__overall__' AND n >= 8 AS big, CASE WHEN regime = '__overall__' THEN t_stat END AS o, CASE WHEN regime = '__overall__' THEN mean_ann_pct END AS om, (SELECT mean_ann_pct FROM preg WHERE regime = '__overall__') AS om0 FROM preg))"""


@query("v39_verdict", f"SELECT * EXCLUDE (ag), CASE status WHEN 'unconditional' THEN 'high' WHEN 'rejected' THEN 'low' ELSE 'medium' END AS confidence FROM ({VERD})", "overall_t overall_mean", LAB)
def v39(spark, sf):
    return C.verdicts(C.by_regime(C.double_sort(panel(spark, sf)), labels(spark, sf), 21))


WV = {**LAB, "wins": WINDOWS,
      "pwin": """SELECT label, start, "end", count(*) AS n, avg(spread) * 12 * 100 AS mean_ann_pct, CASE WHEN count(*) > 1 AND stddev_pop(spread) > 0 THEN avg(spread) / (stddev_pop(spread) / sqrt(count(*))) ELSE 0 END AS t_stat,
  avg(CASE WHEN spread > 0 THEN 1.0::DOUBLE ELSE 0 END) AS hit_rate, NOT (start <= DATE '1997-12-31' AND DATE '1996-01-01' <= "end") AS is_oos FROM dsx JOIN wins ON date >= start AND date <= "end" GROUP BY 1, 2, 3"""}


def per_window(spark, sf):
    return C.by_window(C.double_sort(panel(spark, sf)), windows(spark, sf), 21, ("1996-01-01", "1997-12-31"))


@query("v40_by_window", "SELECT * FROM pwin", SUM, WV)
def v40(spark, sf):
    return per_window(spark, sf)


@query("v40_oos_persistence", "SELECT count(*) FILTER (WHERE is_oos) AS n_oos, count(*) FILTER (WHERE is_oos AND abs(t_stat) >= 1.5) AS n_hold FROM pwin", views=WV)
def v40b(spark, sf):
    return C.oos_persistence(per_window(spark, sf))


GATE = {**RQ.RV, "epi": "SELECT regime, sum(CASE WHEN p IS NULL OR idx - p > 5 THEN 1 ELSE 0 END) AS episodes, count(*) AS active_days FROM (SELECT regime, idx, lag(idx) OVER (PARTITION BY regime ORDER BY idx) AS p FROM rs JOIN calendar USING (date) WHERE active) GROUP BY 1",
        "mf": "SELECT a.date, b.close / a.close - 1 AS fwd FROM (SELECT m.*, idx FROM market m JOIN calendar USING (date)) a JOIN (SELECT m.*, idx FROM market m JOIN calendar USING (date)) b ON b.idx = a.idx + 21"}


@query("v41_regime_gate",
       """SELECT regime, CAST(episodes AS BIGINT) AS episodes, active_days, d * 100 AS diff_pct, t AS t_stat, CASE WHEN episodes >= 3 AND active_days >= 60 AND ni >= 20 AND no >= 20 AND abs(t) >= 1.5 THEN 'validated' ELSE 'rejected' END AS status,
  CASE WHEN NOT (episodes >= 3 AND active_days >= 60) THEN 'insufficient recurrence' WHEN NOT (ni >= 20 AND no >= 20) THEN 'too few observations' WHEN abs(t) >= 1.5 THEN 'recurring and conditioning' ELSE 'no conditioning power' END AS reason FROM
  (SELECT *, d / sqrt(vi / ni + vo / no) AS t FROM (SELECT regime, count(*) FILTER (WHERE active) AS ni, count(*) FILTER (WHERE NOT active) AS no, avg(fwd) FILTER (WHERE active) - avg(fwd) FILTER (WHERE NOT active) AS d, var_pop(fwd) FILTER (WHERE active) AS vi, var_pop(fwd) FILTER (WHERE NOT active) AS vo
   FROM rs JOIN mf USING (date) GROUP BY 1)) JOIN epi USING (regime)""", "diff_pct t_stat", GATE)
def v41(spark, sf):
    m = A.market(spark, sf)
    return C.regime_gate(R.stateful(RQ.wide(spark, sf), RQ.RS), calendars.calendar(m), m)


# ---------------------------------------------------------------- claims

KNOWN = ("mom", "rev", "vol")
USABLE = "SELECT id, run, universe, test_spec, status, regime_conditions, promotions, created, p AS primary_factor, o AS conditioning_factor, CAST(h AS INTEGER) AS horizon_days, y AS hypothesis FROM claims WHERE p <> o AND h <> '0' AND y = 'cheap_beats_expensive'"


def known(spark, sf):
    """Factor names that exist: the features of the evaluation panel."""
    from pitfactors.plans.evaluation_q import long

    return long(spark, sf).select(F.col("feature").alias("factor")).distinct()


@query("w07_usable_specs", USABLE)
def w07(spark, sf):
    return C.usable_specs(A.claims(spark, sf), known(spark, sf))


FOLD = {"items": "SELECT *, substr(md5(universe || '|' || canon), 1, 16) AS claim_id, CASE status WHEN 'validated' THEN 2 WHEN 'regime_reversing' THEN 3 WHEN 'validated_conditional' THEN 4 WHEN 'rejected' THEN 5 ELSE 6 END AS pl FROM claims",
        "runl": "SELECT run, claim_id, universe, canon, ['unconditional', 'validated', 'regime_reversing', 'validated_conditional', 'rejected', 'candidate'][min(pl)] AS run_status, count(*) AS n_items FROM items GROUP BY 1, 2, 3, 4",
        "regs": "SELECT claim_id, string_agg(DISTINCT trim(r), '; ' ORDER BY trim(r)) AS t FROM (SELECT claim_id, unnest(string_split(regime_conditions, ';')) AS r FROM items WHERE regime_conditions IS NOT NULL) GROUP BY 1"}


@query("w05_fold_claims",
       """SELECT claim_id, universe, canon, count(*) AS repetition_count, count(*) FILTER (WHERE run_status IN ('validated', 'regime_reversing', 'validated_conditional')) AS times_validated, count(*) FILTER (WHERE run_status = 'rejected') AS times_rejected,
  coalesce(any_value(t), '') AS regime_conditions, arg_max(run_status, run) AS latest_status, coalesce(any_value(t) LIKE '%holds in%' AND any_value(t) LIKE '%REVERSES%', FALSE) AS has_conflict FROM runl LEFT JOIN regs USING (claim_id) GROUP BY 1, 2, 3""", views=FOLD)
def w05(spark, sf):
    return C.fold_claims(A.claims(spark, sf))


@query("w06_run_report", "SELECT run, CAST(sum(n_items) AS BIGINT) AS n_items, count(*) AS n_distinct, count(*) FILTER (WHERE run_status IN ('validated', 'regime_reversing', 'validated_conditional')) AS n_validated, count(*) FILTER (WHERE run_status = 'rejected') AS n_rejected FROM runl GROUP BY 1", views=FOLD)
def w06(spark, sf):
    return C.run_report(A.claims(spark, sf))


VC = {"u": USABLE, "spec": "SELECT DISTINCT primary_factor AS pf, conditioning_factor AS cf FROM u WHERE horizon_days = 21",
      "pan": """SELECT symbol, date, (close / lag(close, 21) OVER w - 1) * 100.0::DOUBLE AS mom, (close / lag(close, 5) OVER w - 1) * 100.0::DOUBLE AS rev, CAST(volume AS DOUBLE) AS vol, lead(close, 21) OVER w / close - 1 AS fwd FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)""",
      "lp": "SELECT symbol, date, fwd, 'mom' AS f, mom AS v FROM pan WHERE mom IS NOT NULL UNION ALL SELECT symbol, date, fwd, 'rev', rev FROM pan WHERE rev IS NOT NULL UNION ALL SELECT symbol, date, fwd, 'vol', vol FROM pan",
      "vr": "SELECT s.pf, s.cf, a.symbol, a.date, a.v AS prim, b.v AS cond, a.fwd FROM spec s JOIN lp a ON a.f = s.pf JOIN lp b ON b.f = s.cf AND b.symbol = a.symbol AND b.date = a.date",
      "v1": "SELECT *, row_number() OVER (PARTITION BY pf, cf, date ORDER BY prim DESC, symbol) AS r1, count(*) OVER (PARTITION BY pf, cf, date) AS n FROM vr",
      "v2": "SELECT *, row_number() OVER (PARTITION BY pf, cf, date ORDER BY cond, symbol) AS r2, count(*) OVER (PARTITION BY pf, cf, date) AS k FROM v1 WHERE n >= 12 AND r1 <= greatest(floor(n * 0.2), 5)",
      "vx": "SELECT * FROM (SELECT pf, cf, date, avg(CASE WHEN r2 <= greatest(floor(k / 5), 1) THEN fwd END) - avg(CASE WHEN r2 > k - greatest(floor(k / 5), 1) THEN fwd END) AS spread FROM v2 GROUP BY 1, 2, 3) WHERE spread IS NOT NULL",
      "vrows": "SELECT x.*, unnest(CASE WHEN len(l.active) > 0 THEN l.active ELSE ['neutral'] END) AS regime FROM vx x LEFT JOIN (SELECT * FROM act) l USING (date) UNION ALL SELECT *, '__overall__' FROM vx",
      "vp": "SELECT pf, cf, regime, count(*) AS n, avg(spread) AS m, avg(spread) / (stddev_pop(spread) / sqrt(count(*))) AS t FROM vrows GROUP BY 1, 2, 3",
      "vv": """SELECT pf, cf, count(*) FILTER (WHERE regime <> '__overall__' AND n >= 8 AND t >= 1.5) AS holds, count(*) FILTER (WHERE regime <> '__overall__' AND n >= 8 AND t <= -1.5) AS reverses, max(CASE WHEN regime = '__overall__' THEN t END) AS overall_t,
   count(*) FILTER (WHERE regime <> '__overall__' AND n >= 8 AND (m >= 0) <> (om >= 0)) + count(*) FILTER (WHERE regime <> '__overall__' AND n >= 8 AND abs(t) < 0.5) AS ag FROM (SELECT *, max(CASE WHEN regime = '__overall__' THEN m END) OVER (PARTITION BY pf, cf) AS om FROM vp) GROUP BY 1, 2""",
      **{k: RQ.RV[k] for k in ("mw", "fl", "fr", "st", "rs", "act")}}


@query("w08_validate_claims",
       """SELECT u.id, u.primary_factor, u.conditioning_factor, u.horizon_days, CASE WHEN v.pf IS NULL THEN 'rejected' WHEN holds > 0 AND reverses > 0 THEN 'regime_reversing' WHEN abs(overall_t) >= 1.5 AND holds > 0 THEN CASE WHEN ag = 0 THEN 'unconditional' ELSE 'validated_conditional' END
  WHEN holds > 0 OR reverses > 0 THEN 'validated_conditional' ELSE 'rejected' END AS status, holds, reverses, overall_t FROM u LEFT JOIN vv v ON v.pf = u.primary_factor AND v.cf = u.conditioning_factor AND u.horizon_days = 21""", "overall_t", VC)
def w08(spark, sf):
    from pitfactors.plans.evaluation_q import long

    states = R.stateful(RQ.wide(spark, sf), RQ.RS)
    rows = long(spark, sf).withColumn("horizon", F.lit(21))
    return C.validate(A.claims(spark, sf), rows, R.active_lists(states), known(spark, sf), 12, 1)


# ---------------------------------------------------------------- runs

WM = {"wmet": "SELECT CAST(book AS VARCHAR) AS experiment, 'return_pct' AS metric, CAST(sum(pnl_units) AS DOUBLE) / sum(amount_cents) AS value FROM trades WHERE action = 'SELL' GROUP BY book, window_year UNION ALL SELECT CAST(book AS VARCHAR), 'win_rate', avg(CASE WHEN pnl_units > 0 THEN 1.0::DOUBLE ELSE 0 END) FROM trades WHERE action = 'SELL' GROUP BY book, window_year",
      "omet": "SELECT CAST(book AS VARCHAR) AS experiment, 'return_pct' AS metric, CAST(sum(pnl_units) AS DOUBLE) / sum(amount_cents) AS value FROM trades WHERE action = 'SELL' GROUP BY book",
      "wagg": "SELECT experiment, metric, avg(value) AS mean, quantile_cont(value, 0.5) AS median, min(value) AS min, max(value) AS max, quantile_cont(value, 0.1) AS p10, quantile_cont(value, 0.25) AS p25, stddev_samp(value) AS stdev, CASE WHEN count(*) >= 2 THEN quantile_cont(value, 0.75) - quantile_cont(value, 0.25) END AS iqr, CASE WHEN count(*) >= 2 THEN max(value) - min(value) END AS range, avg(value) / greatest(stddev_samp(value), 1e-6) AS snr, count(*) AS count FROM wmet GROUP BY 1, 2"}
AGGD = "mean median min max p10 p25 stdev iqr range snr"


def _pnl(t, *by):
    sold = t.filter("action = 'SELL'").groupBy(F.col("book").cast("string").alias("experiment"), *by)
    a = sold.agg((F.sum("pnl_units") / F.sum("amount_cents")).alias("return_pct"), F.avg((F.col("pnl_units") > 0).cast("double")).alias("win_rate"))
    return a.unpivot(["experiment", *by], ["return_pct", "win_rate"], "metric", "value")


@query("w02_window_metrics", "SELECT * FROM wagg", AGGD, WM)
def w02(spark, sf):
    return W.window_metrics(_pnl(A.trades(spark, sf), "window_year"))


CONDS = [("return_pct", ">", 0.0), ("return_pct.min", ">", -0.5), ("win_rate.mean", ">=", 0.4), ("absent.metric", ">", 0.0)]


@query("w03_check_conditions",
       "SELECT o.experiment, FALSE AS all_met, CAST((o.value > 0)::INT + (a.min > -0.5)::INT + (b.mean >= 0.4)::INT AS BIGINT) AS n_met FROM omet o JOIN wagg a ON a.experiment = o.experiment AND a.metric = 'return_pct' JOIN wagg b ON b.experiment = o.experiment AND b.metric = 'win_rate'", views=WM)
def w03(spark, sf):
    t = A.trades(spark, sf)
    return W.check_conditions(W.namespace(_pnl(t).filter("metric = 'return_pct'"), W.window_metrics(_pnl(t, "window_year"))), CONDS)


EXP = {"exps": "SELECT s_nationkey AS run, o.experiment, s_suppkey AS seq, floor(o.value * 1e9 + 0.5) / 1e9 AS value FROM omet o JOIN supplier ON CAST(s_suppkey AS VARCHAR) = o.experiment", **WM}


def exps(spark, sf):
    s = A.table(spark, sf, "supplier").select(F.col("s_nationkey").alias("run"), F.col("s_suppkey").alias("seq"), F.col("s_suppkey").cast("string").alias("experiment"))
    v = _pnl(A.trades(spark, sf)).filter("metric = 'return_pct'").select("experiment", (F.floor(F.col("value") * 1e9 + 0.5) / 1e9).alias("value"))
    return v.join(s, "experiment")


@query("w04_improvements", "SELECT run, experiment, seq, value, best AS best_before, best IS NULL OR value > best AS improved FROM (SELECT *, max(value) OVER (PARTITION BY run ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM exps)", "value best_before", EXP)
def w04(spark, sf):
    return W.improvements(exps(spark, sf), "return_pct")


@query("w04_best_per_run", "SELECT run, count(*) AS n_experiments, arg_max(experiment, struct_pack(a := value, b := experiment)) AS best_experiment, max(value) AS best_value FROM exps GROUP BY 1", "best_value", EXP)
def w04b(spark, sf):
    return W.best_per_run(exps(spark, sf), "return_pct")


@query("j17_in_and_out_of_sample", "SELECT experiment, a AS is_value, b AS oos_value FROM (SELECT CAST(book AS VARCHAR) AS experiment, CAST(sum(pnl_units) FILTER (WHERE window_year <= 1997) AS DOUBLE) / sum(amount_cents) FILTER (WHERE window_year <= 1997) AS a, CAST(sum(pnl_units) FILTER (WHERE window_year > 1997) AS DOUBLE) / sum(amount_cents) FILTER (WHERE window_year > 1997) AS b FROM trades WHERE action = 'SELL' GROUP BY 1)", "is_value oos_value")
def j17(spark, sf):
    t = A.trades(spark, sf)
    one = "metric = 'return_pct'"
    return W.in_and_out(_pnl(t.filter("window_year <= 1997")).filter(one), _pnl(t.filter("window_year > 1997")).filter(one))


# ---------------------------------------------------------------- lookups


@query("q01_price_range", "SELECT * FROM bars WHERE symbol = 'Brand#7' AND date BETWEEN DATE '1998-01-01' AND DATE '1998-12-31'", "open high low close")
def q01(spark, sf):
    return Q.prices(A.bars(spark, sf, start="1998-01-01", end="1998-12-31"), "Brand#7")


@query("q02_universe_screen", "SELECT *, (SELECT count(*) FROM profiles WHERE sector IN ('S1') AND country = 'US' AND active) AS total FROM profiles WHERE sector = 'S1' AND country = 'US' AND active ORDER BY market_cap DESC, symbol LIMIT 2 OFFSET 0", "market_cap")
def q02(spark, sf):
    return Q.page(Q.screen(A.profiles(spark, sf), sector="s1", country="us", active=True), "market_cap", limit=2)


@query("q03_text_search", "SELECT *, CAST(CASE WHEN lower(symbol) = 'brand#2' THEN 0 WHEN lower(symbol) LIKE 'brand#2%' THEN 1 ELSE 2 END AS INTEGER) AS match FROM profiles WHERE lower(symbol) LIKE '%brand#2%' OR lower(name) LIKE '%brand#2%' ORDER BY match, market_cap DESC, symbol LIMIT 4", "market_cap")
def q03(spark, sf):
    return Q.search(A.profiles(spark, sf), "Brand#2", 4)


@query("q04_statement_history", "SELECT * EXCLUDE (rev_u) FROM income WHERE symbol = 'Brand#3' ORDER BY date DESC LIMIT 8 OFFSET 2", "revenue:4 gross_profit:4 operating_income:4 net_income:4 ebitda:4 eps_diluted shares_diluted")
def q04(spark, sf):
    return Q.history(A.income(spark, sf), "Brand#3", 8, 2).drop("revenue_units")


@query("q05_grades_by_action", "SELECT * FROM grades WHERE symbol = 'Brand#3' AND action IN ('upgrade', 'downgrade')")
def q05(spark, sf):
    return Q.events_of(A.grades(spark, sf), "Brand#3", "action", ["upgrade", "downgrade"])


@query("q06_identifier", "SELECT * FROM profiles WHERE cik = '0000000012'", "market_cap")
def q06(spark, sf):
    return Q.by_identifier(A.profiles(spark, sf), "12")


@query("q06_bulk_identifiers", "SELECT DISTINCT CAST(p_size AS VARCHAR) AS value, 'cik' AS kind, symbol FROM part JOIN profiles ON cik = lpad(CAST(p_size AS VARCHAR), 10, '0')")
def q06b(spark, sf):
    v = A.table(spark, sf, "part").select(F.col("p_size").cast("string").alias("value")).distinct()
    return Q.resolve_identifiers(v, A.profiles(spark, sf))


@query("q07_row_counts", 'SELECT \'bars\' AS "table", count(*) AS rows FROM bars UNION ALL SELECT \'income\', count(*) FROM income UNION ALL SELECT \'grades\', count(*) FROM grades')
def q07(spark, sf):
    return Q.row_counts({"bars": A.bars(spark, sf), "income": A.income(spark, sf), "grades": A.grades(spark, sf)})


@query("q08_macro_catalogue", "SELECT series, count(*) AS rows, min(date) AS first, max(date) AS last FROM macro GROUP BY 1")
def q08(spark, sf):
    return Q.catalogue(A.macro(spark, sf))


@query("q09_macro_range", f"SELECT date, series, value, 'raw' AS kind FROM macro WHERE series = '{RQ.H}' AND date BETWEEN DATE '1998-01-01' AND DATE '1998-06-30' UNION ALL SELECT date, series, value, 'derived' FROM ({RQ.MA}) WHERE date BETWEEN DATE '1998-01-01' AND DATE '1998-06-30'", "value:5")
def q09(spark, sf):
    m = A.macro(spark, sf)
    return Q.macro_range(m, M.derive(m, RQ.PLAN[:1]), [RQ.H, "ma50"], "1998-01-01", "1998-06-30")


@query("q10_latest_values", "SELECT series, max(date) AS date, arg_max(value, date) AS value FROM macro GROUP BY 1", "value")
def q10(spark, sf):
    return Q.latest(A.macro(spark, sf))


@query("q11_dashboard", "SELECT series, v AS value, (v - w) / abs(w) * 100 AS change_1w, (v - m) / abs(m) * 100 AS change_1m FROM (SELECT series, max(CASE WHEN i = 0 THEN value END) AS v, max(CASE WHEN i = 5 THEN value END) AS w, max(CASE WHEN i = 21 THEN value END) AS m FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY date DESC) - 1 AS i FROM macro) GROUP BY 1)", "value change_1w change_1m")
def q11(spark, sf):
    return Q.dashboard(A.macro(spark, sf))


LED = "action = 'SELL' AND sleeve IN ('sleeve1', 'sleeve2') AND pnl >= 100 AND date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31'"


@query("q12_ledger", f"SELECT trade_key, date, symbol, pnl, (SELECT count(*) > 200 FROM trades WHERE {LED}) AS truncated FROM trades WHERE {LED} ORDER BY date DESC, trade_key LIMIT 200", "pnl:4")
def q12(spark, sf):
    out = Q.ledger(A.trades(spark, sf), "1997-01-01", "1999-12-31", {"action": "SELL", "sleeve": ["sleeve1", "sleeve2"]}, min_pnl=100)
    return out.select("trade_key", "date", "symbol", "pnl", "truncated")


@query("q13_trades_with_features", f"SELECT t.trade_key, t.symbol, t.date, f.value AS roe FROM trades t LEFT JOIN ({FQ.ORACLE['roe']}) f USING (symbol, date) WHERE t.action = 'SELL'", "roe", FQ.VIEWS)
def q13(spark, sf):
    t = A.trades(spark, sf).filter("action = 'SELL'")
    return Q.with_features(t, FQ.build(spark, sf, ["roe"])).select("trade_key", "symbol", "date", "roe")


@query("q14_run_search", "SELECT run, experiment, seq, value FROM exps WHERE value >= 0.0 ORDER BY value DESC, experiment LIMIT 10", "value", EXP)
def q14(spark, sf):
    return W.filtered(exps(spark, sf), {"value": 0.0}, limit=10)


@query("q15_alert_feed", "SELECT a.alert_id, a.book, f.close AS fill_price, s_name AS deployment FROM alr a LEFT JOIN (SELECT * FROM bars WHERE volume > 100) f USING (symbol, date) LEFT JOIN supplier ON book = s_suppkey", "fill_price", NQ.ALERT)
def q15(spark, sf):
    from pitfactors.operators import ledger

    a = ledger.alerts(A.trades(spark, sf))
    b = A.bars(spark, sf).filter("volume > 100").select("symbol", "date", F.col("close").alias("fill_price"))
    e = a.join(b, ["symbol", "date"]).select("alert_id", "fill_price")
    d = A.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("book"), F.col("s_name").alias("deployment"))
    return Q.alert_feed(a, e, d).select("alert_id", "book", "fill_price", "deployment")


@query("q16_recall_claims", "SELECT id, run, universe, status, promotions, created FROM claims WHERE universe = 'BUILDING' AND status = 'validated' ORDER BY promotions DESC, created DESC, id LIMIT 20")
def q16(spark, sf):
    return Q.recall(A.claims(spark, sf), universe="BUILDING", status="validated").select("id", "run", "universe", "status", "promotions", "created")


@query("q17_sandbox", "SELECT symbol, count(*) AS n, max(date) AS last FROM bars WHERE date <= DATE '1998-06-30' AND (symbol IN (SELECT symbol FROM profiles WHERE sector = 'S1') OR symbol = 'Brand#2') GROUP BY 1 ORDER BY symbol LIMIT 500".replace("max(date) AS last", "max(date) AS last, false AS truncated"))
def q17(spark, sf):
    return Q.sandbox({"prices": A.bars(spark, sf)}, "SELECT symbol, count(*) AS n, max(date) AS last FROM {prices} GROUP BY symbol ORDER BY symbol", "1998-06-30", ["S1"], A.profiles(spark, sf), ["Brand#2"])


INSIDERS = "SELECT symbol, date AS transaction_date, book, action, shares FROM trades"


@query("q17_sandbox_transactions",
       f"""SELECT symbol, action, count(*) AS n, max(transaction_date) AS last, count(*) OVER () > 500 AS truncated FROM ({INSIDERS})
  WHERE transaction_date <= DATE '1997-03-31' AND symbol IN (SELECT symbol FROM profiles WHERE sector IN ('S1', 'S2')) GROUP BY 1, 2""")
def q17b(spark, sf):
    """A table that is cut by its transaction date, read through a WITH clause."""
    t = A.trades(spark, sf).withColumnRenamed("date", "transaction_date").select("symbol", "transaction_date", "book", "action", "shares")
    sql = "WITH t AS (SELECT * FROM {insider_trades}) SELECT symbol, action, count(*) AS n, max(transaction_date) AS last FROM t GROUP BY symbol, action"
    return Q.sandbox({"insider_trades": t}, sql, "1997-03-31", ["S1", "S2"], A.profiles(spark, sf))


@query("q17_sandbox_truncated", "SELECT DISTINCT symbol, 3 AS cap, true AS truncated FROM bars WHERE date <= DATE '1996-12-31' ORDER BY symbol LIMIT 3")
def q17c(spark, sf):
    """More rows than the cap: the first ones in the statement's order, and the flag."""
    return Q.sandbox({"prices": A.bars(spark, sf)}, "SELECT DISTINCT symbol, 3 AS cap FROM {prices} ORDER BY symbol", "1996-12-31", cap=3)


@query("q18_score_series", "SELECT symbol, date, (close / lag(close, 21) OVER (PARTITION BY symbol ORDER BY date) - 1) * 100 AS score FROM bars WHERE symbol = 'Brand#9'", "score")
def q18(spark, sf):
    b = A.bars(spark, sf)
    return Q.score_series(b.select("symbol", "date", X.trailing_return(21).alias("score")), "Brand#9")


@query("q19_filtered_lists", "SELECT run, experiment, seq, value FROM exps WHERE value <= 0.02 AND seq <= 50 ORDER BY value DESC, experiment LIMIT 15", "value", EXP)
def q19(spark, sf):
    return W.filtered(exps(spark, sf), at_most={"value": 0.02, "seq": 50}, limit=15)
