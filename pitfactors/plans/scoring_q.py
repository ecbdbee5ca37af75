"""Scores, ranks, selection and sizing over the driver's tables."""

from pyspark.sql import functions as F

from pitfactors.operators import calendars
from pitfactors.operators import events as E
from pitfactors.operators import scoring as S
from pitfactors.plans import events_q as EQ
from pitfactors.plans import features_q as FQ
from pitfactors.plans.catalogue import query
from pitfactors.plans.conditions_q import PE, pe_series
from pitfactors.plans.evaluation_q import BASE, avg_rank, long, pan
from pitfactors.sources import adapters as A


def _rank_z(part, source="long_pan"):
    return f"""SELECT *, coalesce((x - avg(x) OVER g) / nullif(stddev_pop(x) OVER g, 0), 0) AS z FROM
  (SELECT *, {avg_rank('value', part)} AS x, count(*) OVER (PARTITION BY {part}) AS cnt FROM {source}) WHERE cnt >= 2 WINDOW g AS (PARTITION BY {part})"""


RZ = {**BASE, "rz": _rank_z("feature, date")}
ROBUST = {**BASE,
          "qs": "SELECT feature, date, quantile_cont(value, 0.5) AS med, quantile_cont(value, 0.01) AS p1, quantile_cont(value, 0.99) AS p99 FROM long_pan GROUP BY 1, 2 HAVING count(*) >= 2",
          "mads": "SELECT feature, date, 3 * 1.4826 * quantile_cont(abs(value - med), 0.5) AS w FROM long_pan JOIN qs USING (feature, date) GROUP BY 1, 2",
          "clipped": """SELECT symbol, feature, date, value, least(greatest(value, CASE WHEN w > 0 THEN med - w ELSE p1 END), CASE WHEN w > 0 THEN med + w ELSE p99 END) AS x
   FROM long_pan JOIN qs USING (feature, date) JOIN mads USING (feature, date)""",
          "zz": "SELECT symbol, feature, date, value, coalesce((x - avg(x) OVER g) / nullif(stddev_pop(x) OVER g, 0), 0) AS z FROM clipped WINDOW g AS (PARTITION BY feature, date)"}


def _z(spark, sf, method, sectors=False):
    rows = long(spark, sf).drop("fwd")
    by = ["feature", "date"]
    if sectors:
        rows = rows.join(A.profiles(spark, sf).select("symbol", "sector"), "symbol", "left")
        by.append("sector")
    return S.standardise(rows, by, method).select("symbol", "feature", "date", "value", "z")


@query("x01_rank_standardise", "SELECT symbol, feature, date, value, z FROM rz", "value z", RZ)
def x01(spark, sf):
    return _z(spark, sf, "rank")


@query("x02_robust_z", "SELECT * FROM zz", "value z:5", ROBUST)
def x02(spark, sf):
    return _z(spark, sf, "z")


SECT = {**BASE, "lps": "SELECT l.*, p.sector FROM long_pan l LEFT JOIN profiles p USING (symbol)", "rzs": _rank_z("feature, date, sector", "lps")}


@query("x03_sector_neutral", "SELECT symbol, feature, date, value, z FROM rzs", "value z", SECT)
def x03(spark, sf):
    return _z(spark, sf, "rank", True)


BUCKETS = [S.Bucket("trend", 2.0, {"mom": 1, "rev": -1}), S.Bucket("activity", 1.0, {"vol": 1})]


def _comp(z):
    return f"""SELECT date, symbol, sum(w * s) AS score, count(*) AS n_buckets, CAST(sum(k) AS BIGINT) AS n_factors FROM (SELECT date, symbol, CASE feature WHEN 'vol' THEN 'activity' ELSE 'trend' END AS b,
  CASE WHEN feature = 'vol' THEN 1 / 3.0::DOUBLE ELSE 2 / 3.0::DOUBLE END AS w, avg(CASE feature WHEN 'rev' THEN -z ELSE z END) AS s, count(*) AS k FROM {z} GROUP BY 1, 2, 3, 4) GROUP BY 1, 2"""


COMP = {**RZ, "comp": _comp("rz")}


def scores(spark, sf):
    return S.composite(long(spark, sf).drop("fwd"), BUCKETS)


@query("x04_composite_score", "SELECT date, symbol, score FROM comp", "score", COMP)
def x04(spark, sf):
    return scores(spark, sf).select("date", "symbol", "score")


@query("x04_composite_sector_neutral", "SELECT date, symbol, score FROM comp", "score", {**SECT, "comp": _comp("rzs")})
def x04b(spark, sf):
    return S.composite(long(spark, sf).drop("fwd"), BUCKETS, sectors=A.profiles(spark, sf)).select("date", "symbol", "score")


@query("x05_score_drilldown",
       """SELECT date, symbol, CASE feature WHEN 'vol' THEN 'activity' ELSE 'trend' END AS bucket, CASE WHEN feature = 'vol' THEN 1 / 3.0::DOUBLE ELSE 2 / 3.0::DOUBLE END AS weight,
  feature AS factor, value, z, CASE feature WHEN 'rev' THEN -1 ELSE 1 END AS sign FROM rz""", "weight value z", RZ)
def x05(spark, sf):
    b = scores(spark, sf).select("date", "symbol", F.explode("buckets").alias("b"))
    f = b.select("date", "symbol", F.col("b.name").alias("bucket"), F.col("b.weight").alias("weight"), F.explode("b.factors").alias("f"))
    return f.select("date", "symbol", "bucket", "weight", "f.*")


DROP63 = """SELECT date, symbol, (close - pk) / pk * 100 AS score FROM (SELECT date, symbol, close, max(close) OVER (PARTITION BY symbol ORDER BY date ROWS 62 PRECEDING) AS pk,
  row_number() OVER (PARTITION BY symbol ORDER BY date) AS rn FROM bars) WHERE rn >= 20"""


@query("x06_metric_current_drop", DROP63, "score")
def x06(spark, sf):
    return S.metric_scores("current_drop", bars=A.bars(spark, sf))


@query("x06_metric_pe", "SELECT b.date, b.symbol, p.pe AS score FROM bars b ASOF JOIN pe_q p ON p.symbol = b.symbol AND b.date >= p.date WHERE p.pe > 0 AND p.pe < 500", "score", PE)
def x06b(spark, sf):
    return S.metric_scores("pe_percentile", bars=A.bars(spark, sf), pe=pe_series(A.income(spark, sf)))


@query("x06_metric_rsi", f"SELECT date, symbol, rsi AS score FROM ({EQ.RSI_SQL})", "score:2", EQ.RSI_VIEWS)
def x06c(spark, sf):
    return S.metric_scores("rsi", bars=A.bars(spark, sf))


@query("x06_metric_momentum", "SELECT date, symbol, momentum_rank AS score FROM mom WHERE n > 1", "score", EQ.MOMENTUM)
def x06d(spark, sf):
    return S.metric_scores("momentum_rank", bars=A.bars(spark, sf))


GROWTH = {"gq": """SELECT symbol, date, (revenue - lag(revenue) OVER w) / lag(revenue) OVER w AS growth, (net_income / revenue - lag(net_income / revenue) OVER w) * 100 AS margin FROM income
  WINDOW w AS (PARTITION BY symbol ORDER BY date)"""}


@query("x06_metric_growth", "SELECT b.date, b.symbol, g.growth AS score FROM bars b ASOF JOIN (SELECT * FROM gq WHERE growth IS NOT NULL) g ON g.symbol = b.symbol AND b.date >= g.date", "score", GROWTH)
def x06e(spark, sf):
    return S.metric_scores("revenue_growth_yoy", bars=A.bars(spark, sf), income=A.income(spark, sf))


@query("x06_metric_margin", "SELECT b.date, b.symbol, g.margin AS score FROM bars b ASOF JOIN (SELECT * FROM gq WHERE margin IS NOT NULL) g ON g.symbol = b.symbol AND b.date >= g.date", "score", GROWTH)
def x06f(spark, sf):
    return S.metric_scores("margin_expanding", bars=A.bars(spark, sf), income=A.income(spark, sf))


@query("x06_metric_feature", f"SELECT date, symbol, value AS score FROM ({FQ.ORACLE['roe']}) WHERE value IS NOT NULL", "score", FQ.VIEWS)
def x06g(spark, sf):
    return S.metric_scores("roe", bars=A.bars(spark, sf), panel=FQ.build(spark, sf, ["roe"]))


RANKED = {**COMP, "cand": "SELECT b.date, b.symbol, c.score, CAST(row_number() OVER (PARTITION BY b.date ORDER BY CASE WHEN c.score IS NULL THEN 1 ELSE 0 END, c.score DESC, b.symbol) AS INTEGER) AS position, count(*) OVER (PARTITION BY b.date) AS n_candidates FROM bars b LEFT JOIN (SELECT date, symbol, floor(score * 1e9 + 0.5) / 1e9 AS score FROM comp WHERE n_factors >= 2) c USING (date, symbol)"}


def ranked(spark, sf):
    nine = F.floor(F.col("score") * 1e9 + 0.5) / 1e9  # equal scores stay equal whatever the summation order
    n = F.aggregate("buckets", F.lit(0), lambda a, b: a + F.size(b["factors"]))
    s = scores(spark, sf).filter(n >= 2).select("date", "symbol", nine.alias("score"))
    return S.rank_candidates(A.bars(spark, sf).select("date", "symbol"), s)


@query("x07_rank_candidates", "SELECT date, symbol, score, position, n_candidates, CASE WHEN score IS NOT NULL THEN position END AS rank FROM cand", "score", RANKED)
def x07(spark, sf):
    return ranked(spark, sf)


@query("x08_select_top", "SELECT date, symbol, position FROM cand WHERE position <= 5", views=RANKED)
def x08(spark, sf):
    return S.select_top(ranked(spark, sf), 8, 5).select("date", "symbol", "position")


@query("x08_worst_signal", f"SELECT date, symbol, priority, CAST(position AS INTEGER) AS position FROM (SELECT date, symbol, score AS priority, row_number() OVER (PARTITION BY date ORDER BY score, symbol) AS position FROM ({DROP63})) WHERE position <= 3", "priority")
def x08b(spark, sf):
    s = S.metric_scores("current_drop", bars=A.bars(spark, sf)).withColumnRenamed("score", "priority")
    return S.by_worst_signal(s, 3)


@query("x09_leaderboard", "SELECT date, count(*) AS n_candidates, count(score) AS n_scored, arg_min(symbol, position) AS leader, CAST(least(count(*), 10) AS INTEGER) AS n_listed FROM cand GROUP BY 1", views=RANKED)
def x09(spark, sf):
    out = S.leaderboard(ranked(spark, sf), top=10)
    return out.select("date", "n_candidates", "n_scored", F.col("leaders")[0]["symbol"].alias("leader"), F.size("leaders").alias("n_listed"))


@query("x10_score_panel",
       "SELECT date, symbol, score, CAST(rank AS INTEGER) AS rank, rank <= 5 AS selected, held FROM (SELECT c.date, c.symbol, c.score, row_number() OVER (PARTITION BY c.date ORDER BY c.score DESC, c.symbol) AS rank, t.symbol IS NOT NULL AS held FROM cand c LEFT JOIN (SELECT DISTINCT date, symbol FROM trades WHERE action = 'BUY') t USING (date, symbol) WHERE c.score IS NOT NULL)",
       "score", RANKED)
def x10(spark, sf):
    s = ranked(spark, sf).filter(F.col("score").isNotNull())
    return S.score_panel(s, A.trades(spark, sf).filter("action = 'BUY'"), 5)


@query("x11_zscores", """SELECT symbol, date, feature, value, (value - m) / s AS z FROM (SELECT symbol, date, feature, value, avg(value) OVER w AS m, stddev_pop(value) OVER w AS s, count(*) OVER w AS n FROM long_pan
   WINDOW w AS (PARTITION BY date, feature)) WHERE n >= 5 AND s > 0""", "value z", BASE)
def x11(spark, sf):
    from pitfactors.operators import evaluation

    return evaluation.zscores(long(spark, sf).drop("fwd"))


VOLS = {"vols": f"SELECT symbol, date, vol FROM ({EQ.VOL})", **EQ.LOGRET}


@query("x12_risk_parity",
       """SELECT date, symbol, vol, iv / sum(iv) OVER (PARTITION BY date) AS weight FROM (SELECT v.date, v.symbol, v.vol, 1 / coalesce(v.vol, m.med, 1) AS iv FROM vols v LEFT JOIN
  (SELECT date, quantile_cont(vol, 0.5) AS med FROM vols WHERE vol > 0 GROUP BY 1) m USING (date))""", "vol weight", VOLS)
def x12(spark, sf):
    return S.risk_parity(E.realised_vol(A.bars(spark, sf)).select("symbol", "date", "vol"))


@query("x13_equal_weight", "SELECT date, symbol, 1.0::DOUBLE / count(*) OVER (PARTITION BY date) AS weight FROM bars", "weight")
def x13(spark, sf):
    return S.equal_weight(A.bars(spark, sf).select("date", "symbol"))


HOLD = {"pos": "SELECT CAST(book AS BIGINT) AS book, symbol, CAST(sum(CASE action WHEN 'BUY' THEN amount_cents ELSE 0 END) AS DOUBLE) / 100 AS market_value FROM trades GROUP BY 1, 2",
        "navb": "SELECT book, sum(market_value) AS nav FROM pos GROUP BY 1"}


def positions(spark, sf):
    bought = F.when(F.col("action") == "BUY", F.col("amount_cents")).otherwise(0)
    return A.trades(spark, sf).groupBy("book", "symbol").agg((F.sum(bought) / 100.0).alias("market_value"))


def targets(spark, sf):
    return S.equal_weight(positions(spark, sf).filter("symbol <> 'Brand#1'").select("book", "symbol"), ["book"])


TGT = {**HOLD, "tgt": "SELECT book, symbol, 1.0::DOUBLE / count(*) OVER (PARTITION BY book) AS weight FROM pos WHERE symbol <> 'Brand#1'"}


@query("x14_band_target", "SELECT book, symbol, CASE WHEN market_value < nav / 25 * 0.8::DOUBLE THEN nav / 25 * 0.8::DOUBLE WHEN market_value > nav / 25 * 1.2::DOUBLE THEN nav / 25 * 1.2::DOUBLE ELSE market_value END AS dest FROM pos JOIN navb USING (book)", "dest:3", HOLD)
def x14(spark, sf):
    p = positions(spark, sf)
    j = p.join(p.groupBy("book").agg(F.sum("market_value").alias("nav")), "book")
    return j.select("book", "symbol", S.band_target(F.col("market_value"), F.col("nav") / 25, 0.2).alias("dest"))


HYST = {"mr": f"SELECT date, symbol, rank() OVER (PARTITION BY date ORDER BY score, symbol) AS rank FROM ({DROP63})",
        "hgrid": "SELECT s.symbol, c.date, m.rank, CASE WHEN m.rank <= 3 THEN 1 WHEN m.rank IS NULL OR m.rank > 6 THEN 0 END AS e FROM (SELECT DISTINCT symbol FROM mr) s JOIN calendar c ON TRUE LEFT JOIN mr m USING (symbol, date)"}


@query("x15_rank_hysteresis", "SELECT symbol, date, CAST(rank AS INTEGER) AS rank, coalesce(last_value(e IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date), 0) = 1 AS member FROM hgrid", views=HYST)
def x15(spark, sf):
    from pitfactors.functions import ranks

    b = A.bars(spark, sf)
    r = ranks.ordinal(S.metric_scores("current_drop", bars=b), ["date"], ["score", "symbol"], "rank")
    return S.rank_hysteresis(r, calendars.date_array(b), 3, 6)


@query("x16_drift_orders",
       """SELECT book, symbol, cur AS current_value, goal AS target_value, dest - cur AS delta, CASE WHEN dest > cur THEN 'BUY' ELSE 'SELL' END AS side FROM (SELECT *, CASE WHEN cur < goal * 0.9::DOUBLE THEN goal * 0.9::DOUBLE WHEN cur > goal * 1.1::DOUBLE THEN goal * 1.1::DOUBLE ELSE cur END AS dest FROM
  (SELECT p.book, p.symbol, p.market_value AS cur, coalesce(t.weight, 0) * n.nav AS goal FROM pos p LEFT JOIN tgt t USING (book, symbol) JOIN navb n USING (book))) WHERE abs(dest - cur) > 1e-9""",
       "current_value:6 target_value:6 delta:6", TGT)
def x16(spark, sf):
    return S.drift_orders(positions(spark, sf), targets(spark, sf), band=0.1)


@query("x16_trim_to_cap", "SELECT book, symbol, market_value AS current_value, market_value / nav AS weight, market_value - 0.05::DOUBLE * nav AS trim FROM pos JOIN navb USING (book) WHERE market_value - 0.05::DOUBLE * nav > 0", "current_value:4 weight trim:4", HOLD)
def x16b(spark, sf):
    return S.trim_to_cap(positions(spark, sf), 0.05)


LASTP = {"lastp": "SELECT symbol, arg_max(close, date) AS price FROM bars WHERE symbol <> 'Brand#2' GROUP BY 1"}


@query("x17_subscription_orders",
       """SELECT book, symbol, weight, price, shares, cost, skipped, 100000 - sum(cost) OVER (PARTITION BY book) AS residual, abs(cost / 100000 - weight) AS drift FROM (SELECT *, CASE WHEN skipped THEN 0 ELSE shares * price END AS cost FROM
  (SELECT t.book, t.symbol, t.weight, l.price, floor(t.weight * 100000 / l.price) AS shares, coalesce(floor(t.weight * 100000 / l.price) <= 0, TRUE) AS skipped FROM tgt t LEFT JOIN lastp l USING (symbol)))""",
       "weight price shares cost:3 residual:3 drift", {**TGT, **LASTP})
def x17(spark, sf):
    from pitfactors.operators import asof

    b = A.bars(spark, sf).filter("symbol <> 'Brand#2'")
    price = asof.last_on(b, "2100-01-01").select("symbol", F.col("close").alias("price"))
    t = targets(spark, sf)
    return S.subscription_orders(t.select("book").distinct().withColumn("cash", F.lit(100000.0)), t, price)


@query("x18_rebalance_orders",
       "SELECT book, symbol, CASE WHEN d > 0 THEN 'BUY' ELSE 'SELL' END AS side, abs(d) AS est_value FROM (SELECT p.book, p.symbol, coalesce(t.weight, 0) * n.nav - p.market_value AS d FROM pos p LEFT JOIN tgt t USING (book, symbol) JOIN navb n USING (book)) WHERE abs(d) >= 1000", "est_value:6", TGT)
def x18(spark, sf):
    p = positions(spark, sf)
    return S.rebalance_orders(p, targets(spark, sf), p.groupBy("book").agg(F.sum("market_value").alias("aum")), 1000.0)


@query("x20_earnings_directives",
       """SELECT book, symbol, date, market_value, report_date, beat, CASE WHEN beat THEN 'add' ELSE 'trim' END AS directive, CASE WHEN beat THEN market_value * 0.25::DOUBLE ELSE -market_value * 0.5::DOUBLE END AS amount FROM
  (SELECT h.book, h.symbol, h.date, h.market_value, max(e.date) AS report_date, arg_max(e.eps_actual > e.eps_estimated, e.date) AS beat FROM
   (SELECT book, symbol, date, CAST(sum(amount_cents) AS DOUBLE) / 100 AS market_value FROM trades WHERE action = 'BUY' GROUP BY 1, 2, 3) h
   JOIN earnings e ON e.symbol = h.symbol AND e.date BETWEEN h.date - 5 AND h.date WHERE e.eps_estimated IS NOT NULL GROUP BY 1, 2, 3, 4)""", "market_value:3 amount:3")
def x20(spark, sf):
    h = A.trades(spark, sf).filter("action = 'BUY'").groupBy("book", "symbol", "date").agg((F.sum("amount_cents") / 100.0).alias("market_value"))
    return S.earnings_directives(h, A.earnings(A.income(spark, sf)))
