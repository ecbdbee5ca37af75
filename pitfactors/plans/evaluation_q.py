"""Factor evaluation over the driver's tables."""

from pyspark.sql import functions as F

from pitfactors.functions import scale
from pitfactors.functions.columns import by_symbol
from pitfactors.operators import calendars
from pitfactors.operators import evaluation as V
from pitfactors.operators import features as X
from pitfactors.plans.catalogue import query
from pitfactors.sources import adapters as A

FACTORS = ["mom", "rev", "vol"]
OWN = "PARTITION BY symbol ORDER BY date"
BASE = {
    "pan": f"""SELECT symbol, date, close, (close / lag(close, 21) OVER w - 1) * 100.0::DOUBLE AS mom, (close / lag(close, 5) OVER w - 1) * 100.0::DOUBLE AS rev,
  CAST(volume AS DOUBLE) AS vol, lead(close, 21) OVER w / close - 1 AS fwd, lead(close, 1) OVER w / close - 1 AS fwd1 FROM bars WINDOW w AS ({OWN})""",
    "long_pan": """SELECT symbol, date, 'mom' AS feature, mom AS value, fwd, fwd1 FROM pan WHERE mom IS NOT NULL UNION ALL
  SELECT symbol, date, 'rev', rev, fwd, fwd1 FROM pan WHERE rev IS NOT NULL UNION ALL SELECT symbol, date, 'vol', vol, fwd, fwd1 FROM pan WHERE vol IS NOT NULL""",
}


def avg_rank(col, part):
    return f"rank() OVER (PARTITION BY {part} ORDER BY {col}) + (count(*) OVER (PARTITION BY {part}, {col}) - 1) / 2.0::DOUBLE"


def ic_view(source, value, label, part="date", least=10):
    return f"""SELECT {part}, (count(*) * sum(rv * rl) - sum(rv) * sum(rl)) / (sqrt(count(*) * sum(rv * rv) - sum(rv) * sum(rv)) * sqrt(count(*) * sum(rl * rl) - sum(rl) * sum(rl))) AS ic, count(*) AS n FROM (SELECT {part}, {avg_rank(value, part)} AS rv, {avg_rank(label, part)} AS rl
  FROM {source} WHERE {value} IS NOT NULL AND {label} IS NOT NULL) GROUP BY {part} HAVING count(*) >= {least} AND stddev_pop(rv) > 0 AND stddev_pop(rl) > 0"""


def bucket_view(source, value, label, part="date", b=5):
    return f"""SELECT {part}, bucket, avg({label}) AS ret, count(*) AS n FROM (SELECT *, CAST(floor(({b} * row_number() OVER (PARTITION BY {part} ORDER BY {value}, symbol) - 1) / CAST(count(*) OVER (PARTITION BY {part}) AS DOUBLE)) AS INTEGER) AS bucket,
  count(*) OVER (PARTITION BY {part}) AS total FROM {source} WHERE {value} IS NOT NULL AND {label} IS NOT NULL) WHERE total >= {2 * b} GROUP BY {part}, bucket"""


def pan(spark, sf):
    b = A.bars(spark, sf)
    return b.select("symbol", "date", "close", X.trailing_return(21).alias("mom"), X.trailing_return(5).alias("rev"),
                    F.col("volume").cast("double").alias("vol"),
                    (F.lead("close", 21).over(by_symbol()) / F.col("close") - 1).alias("fwd"),
                    (F.lead("close", 1).over(by_symbol()) / F.col("close") - 1).alias("fwd1"))


def long(spark, sf, label="fwd"):
    return pan(spark, sf).unpivot(["symbol", "date", label], FACTORS, "feature", "value").filter(F.col("value").isNotNull())


IC = {**BASE, "ic_all": ic_view("long_pan", "value", "fwd", "feature, date")}
BK = {**BASE, "bk": bucket_view("pan", "mom", "fwd"), "bkf": bucket_view("long_pan", "value", "fwd", "feature, date")}
SP = {**BK, "spr": "SELECT date, max(CASE WHEN bucket = 4 THEN ret END) - max(CASE WHEN bucket = 0 THEN ret END) AS spread FROM bk GROUP BY 1",
      "sprf": "SELECT feature, date, max(CASE WHEN bucket = 4 THEN ret END) - max(CASE WHEN bucket = 0 THEN ret END) AS spread FROM bkf GROUP BY 1, 2"}


@query("v01_forward_returns", "SELECT symbol, date, fwd FROM pan WHERE fwd IS NOT NULL", "fwd", BASE)
def v01(spark, sf):
    return V.forward_returns(A.bars(spark, sf), 21)


@query("v01_forward_pp", "SELECT symbol, date, fwd1 * 100 AS fwd FROM pan WHERE fwd1 IS NOT NULL", "fwd", BASE)
def v01b(spark, sf):
    return V.forward_returns(A.bars(spark, sf), 1).withColumn("fwd", F.col("fwd") * 100)


MONTHS = "SELECT min(date) AS date FROM calendar GROUP BY year(date), month(date)"


@query("v02_forward_calendar",
       """SELECT b.symbol, b.date, CAST(h.h AS INTEGER) AS h, (f.close - b.close) / b.close AS fwd FROM bars b JOIN rebal r ON r.date = b.date JOIN calendar c ON c.date = b.date
  JOIN (VALUES (21), (63)) h(h) ON TRUE JOIN calendar d ON d.idx = c.idx + h.h JOIN bars f ON f.symbol = b.symbol AND f.date = d.date""", "fwd", {"rebal": MONTHS})
def v02(spark, sf):
    b = A.bars(spark, sf)
    return V.forward_returns_calendar(b, [21, 63], calendars.month_starts(A.dates(spark, sf)))


@query("v03_features_on_dates",
       """SELECT s.symbol, s.feature, r.date, x.value FROM rebal r JOIN (SELECT DISTINCT symbol, feature FROM long_pan) s ON TRUE
  ASOF JOIN long_pan x ON x.symbol = s.symbol AND x.feature = s.feature AND r.date >= x.date""", "value", {**BASE, "rebal": MONTHS})
def v03(spark, sf):
    return V.features_on(calendars.month_starts(A.dates(spark, sf)), long(spark, sf).drop("fwd"))


@query("v04_rank_ic", "SELECT * FROM ic_all", "ic", IC)
def v04(spark, sf):
    return V.rank_ic(long(spark, sf), ["feature", "date"])


SUMMARY = "SELECT feature, count(*) AS n_obs, avg(ic) AS mean, stddev_samp(ic) AS std, avg(ic) / stddev_samp(ic) AS ir, avg(CASE WHEN ic > 0 THEN 1.0::DOUBLE ELSE 0.0 END) AS hit_rate FROM ic_all GROUP BY 1"


@query("v05_ic_summary", SUMMARY, "mean std ir hit_rate", IC)
def v05(spark, sf):
    return V.ic_summary(V.rank_ic(long(spark, sf), ["feature", "date"]), ["feature"])


NW = """SELECT feature, mu / sqrt(greatest(g0 + 2 * (1 - 1 / 3.0) * g1 + 2 * (1 - 2 / 3.0) * g2, 1e-18) / n) AS t_nw FROM
  (SELECT feature, count(*) AS n, any_value(m) AS mu, avg(d * d) AS g0, avg(d * l1) AS g1, avg(d * l2) AS g2 FROM
   (SELECT feature, m, d, lag(d, 1) OVER w AS l1, lag(d, 2) OVER w AS l2 FROM (SELECT feature, date, ic - avg(ic) OVER (PARTITION BY feature) AS d, avg(ic) OVER (PARTITION BY feature) AS m FROM ic_all)
    WINDOW w AS (PARTITION BY feature ORDER BY date)) GROUP BY 1)"""


@query("v06_newey_west", NW, "t_nw:5", IC)
def v06(spark, sf):
    return V.newey_west(V.rank_ic(long(spark, sf), ["feature", "date"]), ["feature"], 2)


SUPP = {"spanel": """SELECT b.symbol, b.date, b.close, p.sector, p.market_cap, (b.close / lag(b.close, 3) OVER w - 1) * 100.0::DOUBLE AS value, lead(b.close, 1) OVER w / b.close - 1 AS fwd
  FROM sbars b JOIN sprofiles p USING (symbol) WINDOW w AS (PARTITION BY b.symbol ORDER BY b.date)"""}


def spanel(spark, sf):
    b = A.bars(spark, sf, symbol="l_suppkey", grain="month")
    out = b.select("symbol", "date", "close", X.trailing_return(3).alias("value"), (F.lead("close", 1).over(by_symbol()) / F.col("close") - 1).alias("fwd"))
    return out.join(A.supplier_profiles(spark, sf), "symbol")


@query("v07_neutralised",
       """SELECT symbol, date, f - coalesce(sum(f * x) OVER d / nullif(sum(x * x) OVER d, 0), 0) * x AS neutral FROM
  (SELECT symbol, date, value - avg(value) OVER s AS f, ln(market_cap) - avg(ln(market_cap)) OVER s AS x, count(*) OVER (PARTITION BY date) AS n FROM spanel WHERE value IS NOT NULL
   WINDOW s AS (PARTITION BY date, sector)) WHERE n >= 7 WINDOW d AS (PARTITION BY date)""", "neutral", SUPP)
def v07(spark, sf):
    return V.neutralise(spanel(spark, sf), 5).select("symbol", "date", "neutral")


@query("v08_bucket_returns", "SELECT * FROM bk", "ret", BK)
def v08(spark, sf):
    return V.bucket_returns(pan(spark, sf), value="mom")


@query("v09_spread_series", "SELECT * FROM spr", "spread", SP)
def v09(spark, sf):
    """Flagship: one-month return, quintiles per date, top minus bottom forward return."""
    return V.spreads(V.bucket_returns(pan(spark, sf), value="mom"))


WIDE_B = "SELECT feature, date, " + ", ".join(f"max(CASE WHEN bucket = {b} THEN ret END) AS b{b}" for b in range(5)) + " FROM bkf GROUP BY 1, 2"
SPS = {**SP, "wb": WIDE_B,
       "sps": "SELECT feature, count(*) AS n_periods, avg(b4 - b0) AS m, stddev_samp(b4 - b0) AS s, " + ", ".join(f"avg(b{b}) AS m{b}" for b in range(5)) + " FROM wb GROUP BY 1",
       "mono": "SELECT feature, corr(b, r) AS monotonicity FROM (SELECT feature, b, rank() OVER (PARTITION BY feature ORDER BY v) AS r FROM (" + " UNION ALL ".join(f"SELECT feature, {b} AS b, m{b} AS v FROM sps" for b in range(5)) + ")) GROUP BY 1"}
SPREAD_SQL = """SELECT feature, n_periods, m * 12 * 100 AS spread_ann_pct, m * 12 / (s * sqrt(12.0::DOUBLE)) AS spread_sharpe, monotonicity, """ + ", ".join(
    f"m{b} * 12 * 100 AS bucket{b}_ann_pct" for b in range(5)) + " FROM sps JOIN mono USING (feature)"
SPD = "spread_ann_pct spread_sharpe monotonicity " + " ".join(f"bucket{b}_ann_pct" for b in range(5))


@query("v10_spread_summary", SPREAD_SQL, SPD, SPS)
def v10(spark, sf):
    return V.spread_summary(V.bucket_returns(long(spark, sf), ["feature", "date"]), ["feature"], 21)


TOPS = {**BASE, "tops": """SELECT date, symbol FROM (SELECT date, symbol, row_number() OVER (PARTITION BY date ORDER BY mom, symbol) AS rn, count(*) OVER (PARTITION BY date) AS n FROM pan WHERE mom IS NOT NULL)
  WHERE n >= 10 AND floor((5 * rn - 1) / CAST(n AS DOUBLE)) = 4""",
        "tsize": "SELECT c.idx, count(t.symbol) AS k FROM calendar c JOIN tops t ON t.date = c.date GROUP BY 1"}


@query("v11_top_turnover",
       """SELECT avg(moved / (2.0::DOUBLE * k)) AS turnover FROM (SELECT s.idx, s.k, s.k + p.k - 2 * (SELECT count(*) FROM tops a JOIN tops b ON a.symbol = b.symbol
    JOIN calendar ca ON ca.date = a.date JOIN calendar cb ON cb.date = b.date WHERE ca.idx = s.idx AND cb.idx = s.idx - 1) AS moved
   FROM tsize s JOIN tsize p ON p.idx = s.idx - 1)""", "turnover", TOPS)
def v11(spark, sf):
    return V.top_turnover(pan(spark, sf), A.market(spark, sf), value="mom")


PAIRS = {**BASE, "pair_rows": """SELECT date, symbol, 'mom' AS a, 'rev' AS b, mom AS va, rev AS vb FROM pan UNION ALL SELECT date, symbol, 'mom', 'vol', mom, vol FROM pan
  UNION ALL SELECT date, symbol, 'rev', 'vol', rev, vol FROM pan"""}
PAIRS["pair_ic"] = ic_view("pair_rows", "va", "vb", "date, a, b")
PAIRS["pair_corr"] = "SELECT a, b, avg(ic) AS corr, count(*) AS n_dates FROM pair_ic GROUP BY 1, 2"


@query("v12_factor_rank_correlation", "SELECT * FROM pair_corr", "corr", PAIRS)
def v12(spark, sf):
    return V.factor_rank_correlation(pan(spark, sf), FACTORS)


@query("v13_spread_correlation",
       "SELECT x.feature AS a, y.feature AS b, corr(x.spread, y.spread) AS corr, count(*) AS n FROM sprf x JOIN sprf y ON x.date = y.date AND x.feature < y.feature GROUP BY 1, 2", "corr", SP)
def v13(spark, sf):
    s = V.spreads(V.bucket_returns(long(spark, sf), ["feature", "date"]), ["feature", "date"])
    return V.spread_correlation(s)


@query("v14_neighbours",
       """SELECT feature, neighbour, corr, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY abs(corr) DESC, neighbour) AS rank FROM
  (SELECT a AS feature, b AS neighbour, corr FROM pair_corr UNION ALL SELECT b, a, corr FROM pair_corr)) WHERE rank <= 1""", "corr", PAIRS)
def v14(spark, sf):
    return V.neighbours(V.factor_rank_correlation(pan(spark, sf), FACTORS), 1)


@query("v15_label_agreement",
       """SELECT "group", arg_min(label, struct_pack(a := -c, b := label)) AS dominant, CAST(sum(c) AS BIGINT) AS size, max(c) / sum(c)::DOUBLE AS agreement FROM
  (SELECT industry AS "group", sector AS label, count(*) AS c FROM profiles GROUP BY 1, 2) GROUP BY 1""", "agreement")
def v15(spark, sf):
    p = A.profiles(spark, sf)
    return V.label_agreement(p.select(F.col("industry").alias("group"), F.col("sector").alias("label")))


@query("v16_factor_cards",
       f"SELECT s.*, CAST(21 AS INTEGER) AS h, t.t_nw, p.* EXCLUDE (feature) FROM ({SUMMARY}) s JOIN ({NW.replace('g0 + 2 * (1 - 1 / 3.0) * g1 + 2 * (1 - 2 / 3.0) * g2', 'g0')}) t USING (feature) JOIN ({SPREAD_SQL}) p USING (feature)",
       "mean std ir hit_rate t_nw:5 " + SPD, {**IC, **SPS})
def v16(spark, sf):
    return V.factor_cards(long(spark, sf).withColumn("h", F.lit(21)), [21])


CATEGORY = {"mom": "momentum", "rev": "momentum", "vol": "volume"}
CARD = {**BASE,
        "lab": f"SELECT symbol, date, 21 AS h, lead(close, 21) OVER w / close - 1 AS fwd FROM bars WINDOW w AS ({OWN}) UNION ALL SELECT symbol, date, 63, lead(close, 63) OVER w / close - 1 FROM bars WINDOW w AS ({OWN})",
        "hp": "SELECT l.symbol, l.date, l.feature, l.value, b.h, b.fwd FROM long_pan l JOIN lab b USING (symbol, date) WHERE b.fwd IS NOT NULL",
        "ntr": """SELECT symbol, date, feature, f - coalesce(sum(f * x) OVER d / nullif(sum(x * x) OVER d, 0), 0) * x AS value FROM (SELECT l.symbol, l.date, l.feature, value - avg(value) OVER s AS f,
   ln(p.market_cap) - avg(ln(p.market_cap)) OVER s AS x, count(*) OVER (PARTITION BY l.feature, l.date) AS n FROM long_pan l JOIN profiles p USING (symbol) WINDOW s AS (PARTITION BY l.feature, l.date, p.sector)) WHERE n >= 7 WINDOW d AS (PARTITION BY feature, date)""",
        "hn": "SELECT l.symbol, l.date, l.feature, l.value, b.h, b.fwd FROM ntr l JOIN lab b USING (symbol, date) WHERE b.fwd IS NOT NULL",
        "hic": ic_view("hp", "value", "fwd", "feature, h, date"), "hnic": ic_view("hn", "value", "fwd", "feature, h, date"),
        "hbk": bucket_view("hp", "value", "fwd", "feature, h, date"),
        "hwb": "SELECT feature, h, date, " + ", ".join(f"max(CASE WHEN bucket = {b} THEN ret END) AS b{b}" for b in range(5)) + " FROM hbk GROUP BY 1, 2, 3",
        "hsp": "SELECT feature, h, 252.0::DOUBLE / h AS y, count(*) AS n_periods, avg(b4 - b0) AS m, stddev_samp(b4 - b0) AS s, " + ", ".join(f"avg(b{b}) AS m{b}" for b in range(5)) + " FROM hwb WHERE " + " AND ".join(f"b{b} IS NOT NULL" for b in range(5)) + " GROUP BY 1, 2",
        "hmono": "SELECT feature, h, corr(b, r) AS monotonicity FROM (SELECT feature, h, b, rank() OVER (PARTITION BY feature, h ORDER BY v) AS r FROM (" + " UNION ALL ".join(f"SELECT feature, h, {b} AS b, m{b} AS v FROM hsp" for b in range(5)) + ")) GROUP BY 1, 2",
        "ftop": "SELECT feature, symbol, idx FROM (SELECT feature, symbol, date, row_number() OVER v AS rn, count(*) OVER (PARTITION BY feature, date) AS n FROM long_pan WINDOW v AS (PARTITION BY feature, date ORDER BY value, symbol)) JOIN (SELECT date, row_number() OVER (ORDER BY date) AS idx FROM (SELECT DISTINCT date FROM long_pan)) USING (date) WHERE n >= 10 AND floor((5 * rn - 1) / CAST(n AS DOUBLE)) = 4",
        "fsize": "SELECT feature, idx, count(*) AS k FROM ftop GROUP BY 1, 2", "fboth": "SELECT a.feature, a.idx, count(*) AS c FROM ftop a JOIN ftop b ON a.feature = b.feature AND a.symbol = b.symbol AND b.idx = a.idx - 1 GROUP BY 1, 2",
        "fturn": "SELECT s.feature, avg((s.k + p.k - 2 * coalesce(c.c, 0)) / (2.0::DOUBLE * s.k)) AS turnover FROM fsize s JOIN fsize p ON p.feature = s.feature AND p.idx = s.idx - 1 LEFT JOIN fboth c ON c.feature = s.feature AND c.idx = s.idx GROUP BY 1"}
CARD |= {k: v for k, v in PAIRS.items() if k not in CARD}
CARD["cats"] = "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in CATEGORY.items()) + ") t(feature, category)"
CARD["near"] = """SELECT n.feature, string_agg(n.other, ',' ORDER BY abs(n.corr) DESC, n.other) AS neighbours, avg(CASE WHEN a.category = b.category THEN 1.0::DOUBLE ELSE 0 END) AS category_agreement
  FROM (SELECT a AS feature, b AS other, corr FROM pair_corr UNION ALL SELECT b, a, corr FROM pair_corr) n JOIN cats a ON a.feature = n.feature JOIN cats b ON b.feature = n.other GROUP BY 1"""


def _ic_block(view):
    """Summary and t-statistic of an IC series by feature and horizon; weights of the lags by horizon (0 and 2)."""
    return f"""SELECT feature, h, count(*) AS n_obs, any_value(m) AS mean, stddev_samp(ic) AS std, any_value(m) / stddev_samp(ic) AS ir, avg(CASE WHEN ic > 0 THEN 1.0::DOUBLE ELSE 0.0 END) AS hit_rate,
  any_value(m) / sqrt(greatest(avg(d * d) + CASE h WHEN 63 THEN 2 * (1 - 1 / 3.0::DOUBLE) * avg(d * l1) + 2 * (1 - 2 / 3.0::DOUBLE) * avg(d * l2) ELSE 0 END, 1e-18) / count(*)) AS t_nw FROM
  (SELECT *, lag(d, 1) OVER w AS l1, lag(d, 2) OVER w AS l2 FROM (SELECT *, avg(ic) OVER g AS m, ic - avg(ic) OVER g AS d FROM {view} WINDOW g AS (PARTITION BY feature, h)) WINDOW w AS (PARTITION BY feature, h ORDER BY date)) GROUP BY 1, 2"""


CARD["hsum"], CARD["hnsum"] = _ic_block("hic"), _ic_block("hnic")
_ICS = ["n_obs", "mean", "std", "ir", "hit_rate", "t_nw"]


@query("v16_whole_cards",
       "SELECT r.*, p.n_periods, p.m * p.y * 100 AS spread_ann_pct, p.m * p.y / (p.s * sqrt(p.y)) AS spread_sharpe, o.monotonicity, " + ", ".join(f"p.m{b} * p.y * 100 AS bucket{b}_ann_pct" for b in range(5)) + ", "
       + ", ".join(f"n.{c} AS neutral_{c}" for c in _ICS) + ", t.turnover, e.neighbours, e.category_agreement, c.category FROM hsum r JOIN hsp p ON p.feature = r.feature AND p.h = r.h JOIN hmono o ON o.feature = r.feature AND o.h = r.h "
       "JOIN hnsum n ON n.feature = r.feature AND n.h = r.h JOIN fturn t ON t.feature = r.feature JOIN near e ON e.feature = r.feature JOIN cats c ON c.feature = r.feature",
       " ".join([*(c for c in _ICS[1:5]), "t_nw:5", SPD, *(f"neutral_{c}" for c in _ICS[1:5]), "neutral_t_nw:5", "turnover", "category_agreement"]), CARD)
def v16b(spark, sf):
    """The whole card of every feature at one and three months."""
    b = A.bars(spark, sf)
    rows = pan(spark, sf).unpivot(["symbol", "date"], FACTORS, "feature", "value").join(A.profiles(spark, sf).select("symbol", "sector", "market_cap"), "symbol")
    labels = V.forward_returns(b, 21).withColumn("h", F.lit(21)).unionByName(V.forward_returns(b, 63).withColumn("h", F.lit(63)))
    return V.whole_cards(rows, labels, 5, [21, 63], CATEGORY)


FR = {"fpan": """SELECT s.symbol, s.date, s.feature, s.value, s.fwd, p.sector FROM (SELECT symbol, date, 'ret_3' AS feature, value, fwd FROM spanel UNION ALL
   SELECT symbol, date, 'close', close, fwd FROM spanel) s JOIN sprofiles p USING (symbol) WHERE value IS NOT NULL AND fwd IS NOT NULL""",
      "urows": "SELECT *, 'all' AS universe FROM fpan UNION ALL SELECT *, sector FROM fpan",
      "fsp": """SELECT date, feature AS factor, universe, avg(CASE WHEN b = 0 THEN fwd * 100 END) AS q1_mean_pp, avg(CASE WHEN b = 4 THEN fwd * 100 END) AS q5_mean_pp,
   CASE feature WHEN 'close' THEN -1 ELSE 1 END * (avg(CASE WHEN b = 4 THEN fwd * 100 END) - avg(CASE WHEN b = 0 THEN fwd * 100 END)) AS spread_pp, max(n) AS n_symbols FROM
   (SELECT *, floor((5 * row_number() OVER (PARTITION BY universe, feature, date ORDER BY value, symbol) - 1) / CAST(count(*) OVER (PARTITION BY universe, feature, date) AS DOUBLE)) AS b,
    count(*) OVER (PARTITION BY universe, feature, date) AS n FROM urows) WHERE n >= CASE universe WHEN 'all' THEN 50 ELSE 15 END GROUP BY 1, 2, 3""", **SUPP}


def factor_spreads(spark, sf):
    p = spanel(spark, sf)
    rows = p.withColumnRenamed("value", "ret_3").unpivot(["symbol", "date", "fwd"], ["ret_3", "close"], "feature", "value")
    return V.daily_factor_spreads(rows, A.supplier_profiles(spark, sf), {"ret_3": 1, "close": -1}, 50, 15)


@query("v17_daily_factor_spreads", "SELECT * FROM fsp", "q1_mean_pp q5_mean_pp spread_pp", FR)
def v17(spark, sf):
    return factor_spreads(spark, sf)


@query("v18_cumulative_factor_returns",
       "SELECT factor, universe, sum(ln(1 + spread_pp / 100)) * 100 AS cum_log_pp, count(*) AS n_days FROM fsp WHERE date > DATE '1996-01-01' AND date <= DATE '1999-12-31' AND spread_pp / 100 > -0.99999 GROUP BY 1, 2", "cum_log_pp", FR)
def v18(spark, sf):
    return V.cumulative_factor_returns(factor_spreads(spark, sf), "1996-01-01", "1999-12-31")


@query("v47_annual_factor_table",
       """SELECT factor, a AS all_ann_pp, s AS S1_ann_pp, s - a AS S1_minus_all_pp FROM (SELECT factor, avg(CASE WHEN universe = 'all' THEN spread_pp END) * 252 AS a, avg(CASE WHEN universe = 'S1' THEN spread_pp END) * 252 AS s FROM fsp GROUP BY 1)""",
       'all_ann_pp:4 S1_ann_pp:4 S1_minus_all_pp:4', FR)
def v47(spark, sf):
    out = V.annual_factor_table(factor_spreads(spark, sf), ["S1"])
    return out


RK = {**BASE, "complete": "SELECT symbol, date, mom, rev, vol, fwd FROM pan WHERE mom IS NOT NULL AND rev IS NOT NULL AND vol IS NOT NULL AND fwd IS NOT NULL",
      "rk": "SELECT symbol, date, " + ", ".join(
          f"CASE WHEN count(*) OVER d > 1 THEN (row_number() OVER (PARTITION BY date ORDER BY {c}, symbol) - 1) / CAST(count(*) OVER d - 1 AS DOUBLE) - 0.5 ELSE 0 END AS {n}"
          for c, n in (("mom", "r_mom"), ("rev", "r_rev"), ("vol", "r_vol"), ("fwd", "r_y"))) + " FROM complete WINDOW d AS (PARTITION BY date)",
      "fic": "SELECT factor, avg(coalesce(ic, 0)) AS ic FROM (SELECT date, 'mom' AS factor, corr(r_mom, r_y) AS ic FROM rk GROUP BY date HAVING count(*) >= 5 UNION ALL SELECT date, 'rev', corr(r_rev, r_y) FROM rk GROUP BY date HAVING count(*) >= 5 UNION ALL SELECT date, 'vol', corr(r_vol, r_y) FROM rk GROUP BY date HAVING count(*) >= 5) GROUP BY 1"}


@query("v19_ranked_panel", "SELECT * FROM rk", "r_mom r_rev r_vol r_y", RK)
def v19(spark, sf):
    return V.ranked_panel(pan(spark, sf), FACTORS)


@query("v20_mean_factor_ic", "SELECT * FROM fic", "ic", RK)
def v20(spark, sf):
    return V.mean_factor_ic(V.date_moments(V.ranked_panel(pan(spark, sf), FACTORS), FACTORS), FACTORS)


@query("v21_factor_covariance", " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, covar_samp(r_{a}, r_{b}) AS cov FROM rk" for i, a in enumerate(FACTORS) for b in FACTORS[i:]), "cov", RK)
def v21(spark, sf):
    return V.factor_covariance(V.ranked_panel(pan(spark, sf), FACTORS), FACTORS)


IC_WEIGHTS = "SELECT factor, ic, 0.7 * abs(ic) / sum(abs(ic)) OVER () + 0.3 / 3 AS weight FROM fic"


@query("v22_ic_weights", IC_WEIGHTS, "ic weight", RK)
def v22(spark, sf):
    r = V.combine_factors(pan(spark, sf), FACTORS, method="ic_weighted")
    return spark.createDataFrame([(f, r["rank_ic"][f], r["weights"][f]) for f in FACTORS], "factor string, ic double, weight double")


_CELLS = {"a": "mom mom", "b": "mom rev", "c": "mom vol", "d": "rev rev", "e": "rev vol", "f": "vol vol"}
OPT = {**RK,
       "facic": "SELECT " + ", ".join(f"max(CASE WHEN factor = '{n}' THEN ic END) AS ic_{n}, max(CASE WHEN factor = '{n}' THEN CASE WHEN ic >= 0 THEN 1 ELSE -1 END END) AS s_{n}" for n in FACTORS) + " FROM fic",
       "cells": "SELECT " + ", ".join(f"covar_samp(r_{x}, r_{y}) AS {cell}" for cell, (x, y) in ((k, v.split()) for k, v in _CELLS.items())) + " FROM rk",
       "damped": "SELECT s.*, abs(ic_mom) AS i, abs(ic_rev) AS j, abs(ic_vol) AS k, a + 1e-4 AS a, 0.8 * b * s_mom * s_rev AS b, 0.8 * c * s_mom * s_vol AS c, d + 1e-4 AS d, 0.8 * e * s_rev * s_vol AS e, f + 1e-4 AS f FROM cells, facic s",
       "gains": """SELECT *, greatest((i * (d*f - e*e) - j * (b*f - c*e) + k * (b*e - c*d)) / det, 0) AS g_mom, greatest((j * (a*f - c*c) - i * (b*f - c*e) - k * (a*e - b*c)) / det, 0) AS g_rev,
  greatest((i * (b*e - c*d) - j * (a*e - b*c) + k * (a*d - b*b)) / det, 0) AS g_vol FROM (SELECT *, a * (d*f - e*e) - b * (b*f - c*e) + c * (b*e - c*d) AS det FROM damped)"""}


@query("v22_ic_optimal", " UNION ALL ".join(f"SELECT '{n}' AS factor, ic_{n} AS ic, 0.3 / 3 + 0.7 * coalesce(g_{n} / nullif(g_mom + g_rev + g_vol, 0), 1.0 / 3) AS weight FROM gains" for n in FACTORS), "ic weight", OPT)
def v22_optimal(spark, sf):
    """The damped solve; the SQL solves the three equations by determinants."""
    r = V.combine_factors(pan(spark, sf), FACTORS, method="ic_optimal")
    return spark.createDataFrame([(f, r["rank_ic"][f], r["weights"][f]) for f in FACTORS], "factor string, ic double, weight double")


@query("v23_combined_ic", "SELECT avg(ic) AS combined_ic FROM (SELECT corr(0.5 * r_mom - 0.3 * r_rev + 0.2 * r_vol, r_y) AS ic FROM rk GROUP BY date HAVING count(*) >= 5)", "combined_ic", RK)
def v23(spark, sf):
    return V.combined_ic(V.date_moments(V.ranked_panel(pan(spark, sf), FACTORS), FACTORS), [0.5, -0.3, 0.2])


FOLDS = {**RK, "dts": "SELECT date, row_number() OVER (ORDER BY date) - 1 AS t, count(*) OVER () AS total FROM (SELECT DISTINCT date FROM rk)",
         "foldd": "SELECT date, t, total, CAST((SELECT max(i) FROM range(0, 5) r(i) WHERE t >= floor(total * i / 5)) AS INTEGER) AS fold FROM dts"}


@query("v24_purged_oos_ic",
       """SELECT fold, avg(ic) AS oos_ic FROM (SELECT f.fold, r.date, corr((r_mom * s.mom + r_rev * s.rev + r_vol * s.vol) / 3, r_y) AS ic FROM rk r JOIN foldd f USING (date),
   (SELECT max(CASE WHEN factor = 'mom' THEN CASE WHEN ic >= 0 THEN 1 ELSE -1 END END) AS mom, max(CASE WHEN factor = 'rev' THEN CASE WHEN ic >= 0 THEN 1 ELSE -1 END END) AS rev,
     max(CASE WHEN factor = 'vol' THEN CASE WHEN ic >= 0 THEN 1 ELSE -1 END END) AS vol FROM fic) s GROUP BY 1, 2 HAVING count(*) >= 5) GROUP BY 1""", "oos_ic", FOLDS)
def v24(spark, sf):
    m = scale.stable(V.date_moments(V.ranked_panel(pan(spark, sf), FACTORS), FACTORS))
    ic = {r["factor"]: r["ic"] for r in V.mean_factor_ic(m, FACTORS).collect()}
    return V.purged_oos_ic(m, 3, [1 if ic[f] >= 0 else -1 for f in FACTORS], "equal", 0.3, embargo=21)


@query("v25_combine_report", f"SELECT factor, ic AS rank_ic, weight, CASE WHEN ic >= 0 THEN '+' ELSE '-' END AS sign, (SELECT count(*) FROM rk) AS n_rows, (SELECT count(DISTINCT date) FROM rk) AS n_dates FROM ({IC_WEIGHTS})", "rank_ic weight", RK)
def v25(spark, sf):
    r = V.combine_factors(pan(spark, sf), FACTORS, method="ic_weighted", embargo=21)
    rows = [(f, r["rank_ic"][f], r["weights"][f], r["signs"][f], r["n_rows"], r["n_dates"]) for f in FACTORS]
    return spark.createDataFrame(rows, "factor string, rank_ic double, weight double, sign string, n_rows long, n_dates long")


ENT = {"entries": f"SELECT symbol, date FROM (SELECT symbol, date, close, lag(close) OVER ({OWN}) AS p FROM bars) WHERE (close - p) / p * 100 <= -60",
       "grid": "SELECT s.symbol, c.date, c.idx, b.close, CASE WHEN e.symbol IS NULL THEN 0 ELSE 1 END AS o FROM (SELECT DISTINCT symbol FROM entries) s JOIN calendar c ON TRUE LEFT JOIN bars b ON b.symbol = s.symbol AND b.date = c.date LEFT JOIN entries e ON e.symbol = s.symbol AND e.date = c.date",
       "held": "SELECT symbol, date, idx, coalesce(sum(o) OVER (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 0) AS q, (close - lag(close) OVER w) / lag(close) OVER w AS r FROM grid WINDOW w AS (PARTITION BY symbol ORDER BY idx)",
       "pnav": "SELECT date, coalesce(sum(CASE WHEN r IS NOT NULL THEN q * r END) / nullif(sum(CASE WHEN r IS NOT NULL THEN q END), 0), 0) AS ret, CAST(coalesce(sum(CASE WHEN r IS NOT NULL THEN q END), 0) AS BIGINT) AS positions FROM held WHERE idx > 1 GROUP BY 1"}


def entries(spark, sf, thr=-60.0):
    from pitfactors.operators import events

    return events.daily_drops(A.bars(spark, sf), thr).select("symbol", "date")


@query("v26_signal_portfolio", "SELECT * FROM pnav", "ret", ENT)
def v26(spark, sf):
    return V.signal_portfolio(entries(spark, sf), A.bars(spark, sf), 10)


EVT = {**ENT, "evr": """SELECT e.symbol, e.date, (f.close - b.close) / b.close AS fwd FROM entries e JOIN bars b USING (symbol, date) JOIN calendar c ON c.date = e.date
  JOIN calendar d ON d.idx = c.idx + 21 JOIN bars f ON f.symbol = e.symbol AND f.date = d.date"""}
STATS = "count(*) AS triggers, avg(CASE WHEN fwd > 0 THEN 1.0::DOUBLE ELSE 0 END) AS win_rate, avg(fwd) AS avg_return FROM evr GROUP BY 1"


@query("v27_events_by_year", f"SELECT CAST(year(date) AS INTEGER) AS year, {STATS}", "win_rate avg_return", EVT)
def v27(spark, sf):
    return V.event_stats(V.event_returns(entries(spark, sf), A.bars(spark, sf), 21), F.year("date"), "year")


@query("v27_best_and_worst",
       f"SELECT * FROM (SELECT *, 'top' AS side FROM (SELECT symbol, {STATS}) ORDER BY avg_return DESC, symbol LIMIT 5) UNION ALL SELECT * FROM (SELECT *, 'bottom' AS side FROM (SELECT symbol, {STATS}) ORDER BY avg_return, symbol DESC LIMIT 5)", "win_rate avg_return", EVT)
def v27b(spark, sf):
    stats = V.event_stats(V.event_returns(entries(spark, sf), A.bars(spark, sf), 21), F.col("symbol"), "symbol")
    return V.best_and_worst(stats, 5)


def _walked(name, prices):
    return f"SELECT '{name}' AS series, c.date, coalesce((b.close - lag(b.close) OVER w) / lag(b.close) OVER w, 0) AS ret, c.idx FROM calendar c LEFT JOIN ({prices}) b ON b.date = c.date WINDOW w AS (ORDER BY c.idx)"


SIG = {**ENT, "walks": f"SELECT 'signal' AS series, date, ret, 2 AS idx FROM pnav UNION ALL {_walked('market', 'SELECT date, close FROM market')} UNION ALL " + _walked("sector", "SELECT date, close FROM bars WHERE symbol = 'Brand#2'"),
       "sums": """SELECT series, count(*) AS n, sum(ln(1 + ret)) AS g, stddev_samp(ret) AS sd, sqrt(avg(least(ret - 2.0::DOUBLE / 100 / 252, 0) * least(ret - 2.0::DOUBLE / 100 / 252, 0))) AS down FROM walks WHERE idx > 1 GROUP BY 1""",
       "yearly": "SELECT series, n, g, sd, down, (exp(g * 252.0::DOUBLE / (n + 1)) - 1) * 100 AS ann, sd * sqrt(252.0) * 100 AS vol FROM sums",
       "under": "SELECT min(exp(l - greatest(0, m)) - 1) * 100 AS dd FROM (SELECT l, max(l) OVER (ORDER BY date) AS m FROM (SELECT date, sum(ln(1 + ret)) OVER (ORDER BY date) AS l FROM pnav))"}


#: The table's prices jump, so compounded figures span a hundred orders of magnitude: they are compared as inverse hyperbolic sines.
WIDE = ["ann_return_pct", "sharpe_annualized", "sortino", "alpha_vs_market_pct", "alpha_vs_sector_pct"]


@query("v28_signal_metrics",
       "SELECT " + ", ".join(f"asinh({c}) AS {c}" for c in WIDE) + """, ann_vol_pct, max_drawdown_pct, trigger_count FROM (SELECT ann AS ann_return_pct, vol AS ann_vol_pct, (ann - 2.0) / vol AS sharpe_annualized,
  (ann - 2.0) / (down * sqrt(252.0) * 100) AS sortino, (SELECT dd FROM under) AS max_drawdown_pct, ann - (SELECT ann FROM yearly WHERE series = 'market') AS alpha_vs_market_pct,
  ann - (SELECT ann FROM yearly WHERE series = 'sector') AS alpha_vs_sector_pct, (SELECT count(*) FROM entries) AS trigger_count FROM yearly WHERE series = 'signal')""",
       " ".join(WIDE) + " ann_vol_pct:4 max_drawdown_pct", SIG)
def v28(spark, sf):
    """Metrics of a signal's portfolio on its own returns, and what it earned beyond market and sector a year."""
    b = A.bars(spark, sf)
    e = entries(spark, sf)
    stats = V.signal_metrics(e, b, 10, A.market(spark, sf), b.filter("symbol = 'Brand#2'"), 2.0)
    return stats.select(*[F.asinh(c).alias(c) for c in WIDE], "ann_vol_pct", "max_drawdown_pct").withColumn("trigger_count", e.agg(F.count(F.lit(1))).scalar())


@query("v28_market_metrics",
       """SELECT m.ann - s.ann AS alpha_vs_market_pct, m.ann AS ann_return_pct, s.ann AS other_pct FROM yearly m JOIN yearly s ON m.series = 'market' AND s.series = 'market'""".replace("m.ann - s.ann", "0.0::DOUBLE"),
       "alpha_vs_market_pct:4 ann_return_pct:4 other_pct:4", SIG)
def v28b(spark, sf):
    """The market held as a signal of one symbol on every date earns the market's return: no alpha."""
    m = A.market(spark, sf).withColumn("symbol", F.lit("M"))
    stats = V.signal_metrics(m, m, 1, m.drop("symbol"), m.drop("symbol"), 2.0)
    return stats.select("alpha_vs_market_pct", "ann_return_pct", (F.col("ann_return_pct") - F.col("alpha_vs_sector_pct")).alias("other_pct"))


ROLL = {**IC, "roll": """SELECT feature, date, m AS ic_mean, s AS ic_std, m / s AS ir FROM (SELECT feature, date, avg(ic) OVER w AS m, stddev_samp(ic) OVER w AS s, count(*) OVER w AS k, count(*) OVER (PARTITION BY feature) AS total FROM ic_all
   WINDOW w AS (PARTITION BY feature ORDER BY date ROWS 62 PRECEDING)) WHERE k = 63 AND total >= 75"""}


def rolling(spark, sf):
    return V.rolling_ic(V.rank_ic(long(spark, sf), ["feature", "date"]), 63, ["feature"])


@query("v29_rolling_ic", "SELECT * FROM roll", "ic_mean ic_std ir", ROLL)
def v29(spark, sf):
    return rolling(spark, sf)


@query("v30_ir_distribution",
       """SELECT r.feature, """ + ", ".join(f"quantile_cont(r.ir, {p / 100}) AS p{p}" for p in (10, 25, 50, 75, 90)) + """, count(*) AS n, any_value(l.last) AS last,
  avg(CASE WHEN r.ir <= l.last THEN 1.0::DOUBLE ELSE 0 END) * 100 AS current_percentile FROM roll r JOIN (SELECT feature, arg_max(ir, date) AS last FROM roll GROUP BY 1) l USING (feature) GROUP BY 1""",
       "p10 p25 p50 p75 p90 last current_percentile:4", ROLL)
def v30(spark, sf):
    return V.ir_distribution(rolling(spark, sf), ["feature"])


@query("v31_largest_shifts")
def v31(spark, sf):
    return V.largest_shifts(rolling(spark, sf), ["feature"])


@query("v32_change_points")
def v32(spark, sf):
    return V.change_points(rolling(spark, sf), ["feature"])


@query("v33_daily_ic", ic_view("calpan", "mom", "fwd"), "ic",
       {**BASE, "calpan": """SELECT p.symbol, p.date, p.mom, (f.close - p.close) / p.close AS fwd FROM pan p JOIN calendar c ON c.date = p.date JOIN calendar d ON d.idx = c.idx + 5
  JOIN bars f ON f.symbol = p.symbol AND f.date = d.date"""})
def v33(spark, sf):
    fwd = V.forward_returns_calendar(A.bars(spark, sf), [5]).drop("h")
    values = pan(spark, sf).select("symbol", "date", F.col("mom").alias("value"))
    return V.rank_ic(values.join(fwd, ["symbol", "date"]))


def _two_portfolios(spark, sf):
    e = entries(spark, sf).withColumn("signal", F.lit("drop")).unionByName(
        entries(spark, sf, -80.0).withColumn("signal", F.lit("crash")))
    return V.signal_portfolio(e, A.bars(spark, sf), 10, ["signal"])


ENT2 = {k + "2": v.replace("entries", "entries2").replace("FROM grid", "FROM grid2").replace("FROM held", "FROM held2").replace("-60", "-80") for k, v in ENT.items()}


@query("v34_portfolio_correlation", "SELECT 'crash' AS a, 'drop' AS b, corr(x.ret, y.ret) AS corr FROM pnav2 x JOIN pnav y USING (date)", "corr", {**ENT, **ENT2})
def v34(spark, sf):
    return V.portfolio_correlation(_two_portfolios(spark, sf))


@query("v35_forward_selection")
def v35(spark, sf):
    from pitfactors.operators import events

    b = A.bars(spark, sf)
    signals = {"drop": entries(spark, sf), "quiet": events.volume_conviction(b, max_ratio=1.0).select("symbol", "date"),
               "uptrend": events.ma_crossover(b).filter("ma_signal = 1").select("symbol", "date")}
    steps = V.forward_selection(signals, b, 10)
    return spark.createDataFrame([(s["step"], s["signal"], s["sharpe"]) for s in steps], "step int, signal string, sharpe double")


ZV = {**BASE, "zs": """SELECT symbol, date, feature, value, (value - m) / s AS z FROM (SELECT symbol, date, feature, value, avg(value) OVER w AS m, stddev_pop(value) OVER w AS s, count(*) OVER w AS n FROM long_pan
   WINDOW w AS (PARTITION BY date, feature)) WHERE n >= 5 AND s > 0""",
      "wts": "SELECT symbol, date, close * volume / sum(close * volume) OVER (PARTITION BY date) AS weight FROM bars",
      "expo": "SELECT date, feature, sum(weight * z) / sum(weight) AS exposure, sum(weight) AS coverage, count(*) AS n FROM zs JOIN wts USING (symbol, date) GROUP BY 1, 2"}


def _weights(spark, sf):
    b = A.bars(spark, sf).withColumn("mv", F.col("close") * F.col("volume"))
    total = b.groupBy("date").agg(F.sum("mv").alias("total"))
    return b.join(total, "date").select("symbol", "date", (F.col("mv") / F.col("total")).alias("weight"))


def _z(spark, sf):
    return V.zscores(long(spark, sf).drop("fwd"))


@query("v42_exposure", "SELECT * FROM expo", "exposure coverage", ZV)
def v42(spark, sf):
    return V.exposure(_weights(spark, sf), _z(spark, sf), ["date", "feature"])


@query("v42_contributors",
       """SELECT date, feature, symbol, weight, z, contribution, CAST(rank AS INTEGER) AS rank FROM (SELECT *, weight * z AS contribution, row_number() OVER (PARTITION BY date, feature ORDER BY abs(weight * z) DESC, symbol) AS rank
  FROM zs JOIN wts USING (symbol, date)) WHERE rank <= 2""", "weight z contribution", ZV)
def v42b(spark, sf):
    return V.contributors(_weights(spark, sf), _z(spark, sf), ["date", "feature"], 2)


@query("v43_category_bets",
       """SELECT CASE WHEN feature = 'vol' THEN 'size' ELSE 'momentum' END AS category, avg(exposure * CASE feature WHEN 'rev' THEN -1 ELSE 1 END) AS bet, count(*) AS n_factors FROM
  (SELECT feature, avg(exposure) AS exposure FROM expo GROUP BY 1) GROUP BY 1""", "bet", ZV)
def v43(spark, sf):
    e = V.exposure(_weights(spark, sf), _z(spark, sf), ["date", "feature"]).groupBy("feature").agg(F.avg("exposure").alias("exposure"))
    return V.category_bets(e, {"mom": ("momentum", 1), "rev": ("momentum", -1), "vol": ("size", 1)})


@query("v44_concentration", "SELECT date, sum(weight * weight) AS hhi, 1 / sum(weight * weight) AS effective_n, max(weight) AS max_weight, count(*) AS n FROM wts GROUP BY 1", "hhi effective_n max_weight", ZV)
def v44(spark, sf):
    return V.concentration(_weights(spark, sf), ["date"])


ATT = {**FR, "cum": "SELECT factor, sum(ln(1 + spread_pp / 100)) * 100 AS cum_log_pp FROM fsp WHERE universe = 'all' AND date > DATE '1996-01-01' AND date <= DATE '1999-12-31' AND spread_pp / 100 > -0.99999 GROUP BY 1",
       "sz": """SELECT feature, avg(z) AS exposure FROM (SELECT symbol, feature, (value - avg(value) OVER w) / stddev_pop(value) OVER w AS z FROM (SELECT symbol, date, 'ret_3' AS feature, value FROM spanel UNION ALL SELECT symbol, date, 'close', close FROM spanel)
   WHERE value IS NOT NULL WINDOW w AS (PARTITION BY date, feature)) WHERE symbol IN (SELECT symbol FROM sprofiles WHERE sector = 'S1') GROUP BY 1"""}


@query("v45_attribution",
       """SELECT factor, exposure, cum_log_pp, contribution, t AS explained, 12.5 - t AS residual, t / 12.5 AS share_explained FROM
  (SELECT factor, exposure, cum_log_pp, exposure * cum_log_pp AS contribution, sum(exposure * cum_log_pp) OVER () AS t FROM sz JOIN cum ON feature = factor)""",
       "exposure cum_log_pp contribution explained residual share_explained", ATT)
def v45(spark, sf):
    p = spanel(spark, sf)
    rows = p.withColumnRenamed("value", "ret_3").unpivot(["symbol", "date", "sector"], ["ret_3", "close"], "feature", "value")
    held = V.zscores(rows).filter("sector = 'S1'").groupBy("feature").agg(F.avg("z").alias("exposure"))
    cum = V.cumulative_factor_returns(factor_spreads(spark, sf).filter("universe = 'all'"), "1996-01-01", "1999-12-31")
    return V.attribution(held, cum, 12.5)


@query("v46_cohort_spearman",
       f"""SELECT corr(ra, rb) AS spearman, count(*) AS n, avg(a) AS mean_a, avg(b) AS mean_b, stddev_samp(a) AS std_a, stddev_samp(b) AS std_b FROM
  (SELECT *, {avg_rank('a', '1')} AS ra, {avg_rank('b', '1')} AS rb FROM (SELECT symbol, avg(CASE WHEN year(date) <= 1997 THEN fwd1 END) AS a, avg(CASE WHEN year(date) > 1997 THEN fwd1 END) AS b FROM pan GROUP BY 1))""",
       "spearman mean_a mean_b std_a std_b", BASE)
def v46(spark, sf):
    early = F.year("date") <= 1997
    per = pan(spark, sf).groupBy("symbol").agg(F.avg(F.when(early, F.col("fwd1"))).alias("a"), F.avg(F.when(~early, F.col("fwd1"))).alias("b"))
    return V.cohort_spearman(per, "a", "b", "symbol")


@query("j13_features_with_labels", "SELECT symbol, date, mom, rev, vol, fwd FROM pan WHERE mom IS NOT NULL AND rev IS NOT NULL AND vol IS NOT NULL AND fwd IS NOT NULL", "mom rev vol fwd", BASE)
def j13(spark, sf):
    b = A.bars(spark, sf)
    x = b.select("symbol", "date", X.trailing_return(21).alias("mom"), X.trailing_return(5).alias("rev"), F.col("volume").cast("double").alias("vol"))
    return x.join(V.forward_returns(b, 21), ["symbol", "date"]).dropna()


@query("j16_factor_pairs", "SELECT date, a, b, ic, n FROM pair_ic", "ic", PAIRS)
def j16(spark, sf):
    return V.pairwise_ic(pan(spark, sf), FACTORS)


WK = {"wpan": """SELECT symbol, date, (close / lag(close, 4) OVER w - 1) * 100.0::DOUBLE AS value, lead(close, 4) OVER w / close - 1 AS fwd FROM wbars WINDOW w AS (PARTITION BY symbol ORDER BY date)"""}
WK["wbk"] = bucket_view("wpan", "value", "fwd")


@query("v09_weekly_spread", "SELECT date, max(CASE WHEN bucket = 4 THEN ret END) - max(CASE WHEN bucket = 0 THEN ret END) AS spread FROM wbk GROUP BY 1", "spread", WK)
def v09w(spark, sf):
    """Flagship on weekly bars, dense enough at every scale."""
    b = A.bars(spark, sf, grain="week")
    rows = b.select("symbol", "date", X.trailing_return(4).alias("value"), (F.lead("close", 4).over(by_symbol()) / F.col("close") - 1).alias("fwd"))
    return V.spreads(V.bucket_returns(rows))
