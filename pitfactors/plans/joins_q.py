"""Point-in-time joins, calendars and universes over the driver's tables."""

from pyspark.sql import functions as F

from pitfactors.operators import asof, calendars, universe
from pitfactors.plans.catalogue import query
from pitfactors.sources import adapters as A

AVAILABLE = """SELECT i.*, coalesce((SELECT min(e.date) FROM earnings e WHERE e.symbol = i.symbol AND e.date >= i.date
  AND e.date <= i.date + 60), CAST(i.date + 45 AS DATE)) AS available_from FROM income i"""
V = {"avail": AVAILABLE}
DAY = "1998-06-30"


def _income(spark, sf):
    inc = A.statements(spark, sf)
    return asof.available_from(inc, A.earnings(inc))


J01 = """SELECT b.symbol, b.date, b.close, a.available_from AS asof_date, a.revenue FROM bars b LEFT JOIN avail a
  ON a.symbol = b.symbol AND a.available_from = (SELECT max(x.available_from) FROM avail x WHERE x.symbol = b.symbol AND x.available_from <= b.date)"""


def _j01(spark, sf, strategy):
    facts = _income(spark, sf)
    return asof.backward(
        A.bars(spark, sf).select("symbol", "date", "close"), facts,
        right_date="available_from", cols=["revenue"], tie="date", strategy=strategy,
    )


@query("j01_asof_backward", J01, "close revenue:4", V)
def j01(spark, sf):
    return _j01(spark, sf, "timeline")


@query("j01_asof_backward_interval", J01, "close revenue:4", V)
def j01b(spark, sf):
    return _j01(spark, sf, "interval")


@query("j02_asof_stale_cap",
       """SELECT b.symbol, b.date, max(m.date) AS asof_date, arg_max(m.eps_actual, m.date) AS eps_actual
  FROM bars b LEFT JOIN earnings m ON m.symbol = b.symbol AND m.date <= b.date AND m.date >= b.date - 30 GROUP BY 1, 2""", "eps_actual")
def j02(spark, sf):
    e = A.earnings(A.income(spark, sf))
    return asof.backward(A.bars(spark, sf).select("symbol", "date"), e, cols=["eps_actual"], max_age_days=30)


@query("j03_macro_asof",
       """SELECT c.date, s.series, arg_max(m.value, m.date) AS value, max(m.date) AS asof_date
  FROM calendar c, (SELECT DISTINCT series FROM macro) s LEFT JOIN macro m ON m.series = s.series AND m.date <= c.date GROUP BY 1, 2""", "value")
def j03(spark, sf):
    m = A.macro(spark, sf)
    dates = calendars.date_array(A.dates(spark, sf))
    grid = m.select("series").distinct().select("series", F.explode(dates).alias("date"))
    return asof.backward(grid, m, on="series", cols=["value"])


@query("j04_asof_price",
       """SELECT t.trade_key, t.book, t.symbol, t.date, b.close AS mark FROM trades t JOIN bars b ON b.symbol = t.symbol
  AND b.date = (SELECT max(x.date) FROM bars x WHERE x.symbol = t.symbol AND x.date <= t.date)""", "mark")
def j04(spark, sf):
    marks = A.bars(spark, sf).select("symbol", "date", F.col("close").alias("mark"))
    t = A.trades(spark, sf).select("trade_key", "book", "symbol", "date")
    days = t.select("symbol", "date").distinct()  # one row per symbol and day before the as-of
    priced = asof.backward(days, marks, cols=["mark"]).drop("asof_date")
    return t.join(priced, ["symbol", "date"])


@query("j04_last_price_on",
       f"SELECT symbol, max(date) AS asof_date, arg_max(close, date) AS close FROM bars WHERE date <= DATE '{DAY}' GROUP BY 1", "close")
def j04b(spark, sf):
    return asof.last_on(A.bars(spark, sf), DAY)


def _next(spark, sf, inclusive):
    e = A.earnings(A.income(spark, sf))
    out = asof.forward(A.bars(spark, sf).select("symbol", "date"), e, inclusive=inclusive)
    return out.withColumn("days", F.datediff("next_date", "date"))


@query("j05_asof_forward",
       """SELECT b.symbol, b.date, min(e.date) AS next_date, CAST(min(e.date) - b.date AS INTEGER) AS days
  FROM bars b LEFT JOIN earnings e ON e.symbol = b.symbol AND e.date >= b.date GROUP BY 1, 2""")
def j05(spark, sf):
    return _next(spark, sf, True)


@query("j05_asof_forward_strict",
       """SELECT b.symbol, b.date, min(e.date) AS next_date, CAST(min(e.date) - b.date AS INTEGER) AS days
  FROM bars b LEFT JOIN earnings e ON e.symbol = b.symbol AND e.date > b.date GROUP BY 1, 2""")
def j05b(spark, sf):
    return _next(spark, sf, False)


@query("j06_available_from", "SELECT symbol, date, period, available_from FROM avail", views=V)
def j06(spark, sf):
    return _income(spark, sf).select("symbol", "date", "period", "available_from")


MEMBER_AT = """SELECT s.symbol, c.date FROM calendar c, spans s WHERE CASE
  WHEN c.date < s.first THEN FALSE WHEN s.left_early THEN c.date < s.last ELSE TRUE END"""


@query("j07_membership_interval", "SELECT t.trade_key, t.book, t.symbol, t.date FROM trades t JOIN spans s USING (symbol) WHERE t.date >= s.first AND (NOT s.left_early OR t.date < s.last)")
def j07(spark, sf):
    log, now = A.membership(A.bars(spark, sf))
    return universe.members_only(A.trades(spark, sf).select("trade_key", "book", "symbol", "date"), log, now)


@query("u06_members_by_date", MEMBER_AT)
def u06(spark, sf):
    log, now = A.membership(A.bars(spark, sf))
    return universe.members_by_date(log, now, calendars.date_array(A.dates(spark, sf)))


@query("j08_same_period_last_year",
       """SELECT a.symbol, a.date, a.period, a.revenue, b.revenue AS prior_revenue FROM income a LEFT JOIN income b
  ON b.symbol = a.symbol AND b.period = a.period AND b.fiscal_year = a.fiscal_year - 1""", "revenue:4 prior_revenue:4")
def j08(spark, sf):
    q = A.income(spark, sf).select("symbol", "date", "period", "fiscal_year", "revenue")
    return asof.same_period_last_year(q, ["revenue"]).drop("fiscal_year")


@query("j09_forward_price",
       """SELECT b.symbol, b.date, f.date AS fwd_date, f.close AS fwd_close FROM bars b JOIN calendar c ON c.date = b.date
  JOIN calendar d ON d.idx = c.idx + 21 JOIN bars f ON f.symbol = b.symbol AND f.date = d.date""", "fwd_close")
def j09(spark, sf):
    from pitfactors.operators import evaluation

    return evaluation.forward_prices(A.bars(spark, sf), [21]).select("symbol", "date", "fwd_date", "fwd_close")


@query("j10_calendar_grid", "SELECT p.symbol, c.date FROM profiles p, calendar c")
def j10(spark, sf):
    dates = calendars.date_array(A.dates(spark, sf))
    return A.profiles(spark, sf).select("symbol", F.explode(dates).alias("date"))


@query("j11_dimension_join",
       "SELECT b.symbol, b.date, b.close, p.sector, p.industry FROM bars b LEFT JOIN profiles p USING (symbol)", "close")
def j11(spark, sf):
    dims = A.profiles(spark, sf).select("symbol", "sector", "industry")
    return A.bars(spark, sf).select("symbol", "date", "close").join(dims, "symbol", "left")


@query("j12_semi_sector", "SELECT symbol, date, close FROM bars WHERE symbol IN (SELECT symbol FROM profiles WHERE sector = 'S1')", "close")
def j12(spark, sf):
    members = universe.in_sector(A.profiles(spark, sf), "s1")
    return A.bars(spark, sf).select("symbol", "date", "close").join(members, "symbol", "left_semi")


@query("j12_anti_no_prices",
       "SELECT CAST(s_suppkey AS VARCHAR) AS symbol FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE date_trunc('week', l_shipdate) = DATE '1998-06-29')")
def j12b(spark, sf):
    week = A.bars(spark, sf, symbol="l_suppkey", grain="week").filter(F.col("date") == F.lit("1998-06-29").cast("date"))
    return universe.missing(A.supplier_profiles(spark, sf), week)


@query("j14_aligned_series",
       "SELECT a.date, a.value AS a, b.value AS b FROM macro a JOIN macro b USING (date) WHERE a.series = '1-URGENT' AND b.series = '2-HIGH'", "a b")
def j14(spark, sf):
    m = A.macro(spark, sf)
    return asof.aligned(m.filter("series = '1-URGENT'"), m.filter("series = '2-HIGH'"))


@query("j15_month_key",
       """SELECT d.date, strftime(d.date, '%Y-%m') AS month, d.value, m.monthly FROM macro d JOIN
  (SELECT strftime(date, '%Y-%m') AS month, arg_max(value, date) AS monthly FROM macro WHERE series = '5-LOW' GROUP BY 1) m
  ON m.month = strftime(d.date, '%Y-%m') WHERE d.series = '1-URGENT'""", "value monthly")
def j15(spark, sf):
    m = A.macro(spark, sf)
    return asof.month_key_join(m.filter("series = '1-URGENT'").select("date", "value"), m.filter("series = '5-LOW'"))


@query("j18_window_overlap",
       """SELECT a.symbol, a.start AS a_start, b.start AS b_start FROM spans_y a JOIN spans_y b ON a.symbol = b.symbol AND a.start < b."end" AND b.start < a."end" """,
       views={"spans_y": 'SELECT symbol, min(date) AS start, max(date) AS "end" FROM wbars GROUP BY symbol, year(date)'})
def j18(spark, sf):
    b = A.bars(spark, sf, grain="week")
    w = b.groupBy("symbol", F.year("date").alias("y")).agg(F.min("date").alias("start"), F.max("date").alias("end"))
    return asof.range_overlap(w, w, "symbol").select("a.symbol", F.col("a.start").alias("a_start"), F.col("b.start").alias("b_start"))


MEMBERS = f"SELECT symbol FROM spans WHERE first <= DATE '{DAY}' AND (NOT left_early OR last > DATE '{DAY}')"


@query("u01_resolve_sector_anchored",
       f"""SELECT symbol FROM profiles WHERE (sector IN ('S1', 'S2') OR industry IN ('S1', 'S2')) AND symbol IN
  (SELECT symbol FROM spans WHERE first <= DATE '2001-10-25' AND (NOT left_early OR last >= DATE '{DAY}')) AND symbol <> 'Brand#1'""")
def u01(spark, sf):
    log, now = A.membership(A.bars(spark, sf))
    return universe.resolve("sector", profiles=A.profiles(spark, sf), log=log, snapshot=now, sectors=["S1", "s2"],
                            start=DAY, end="2001-10-25", anchored=True, exclude=["Brand#1"])


@query("u02_sector_match", "SELECT symbol FROM profiles WHERE lower(sector) = 'i3' OR lower(industry) = 'i3'")
def u02(spark, sf):
    return universe.in_sector(A.profiles(spark, sf), "I3")


@query("u03_members_as_of", MEMBERS)
def u03(spark, sf):
    log, now = A.membership(A.bars(spark, sf))
    return universe.members_as_of(log, now, DAY)


@query("u04_ever_members",
       "SELECT symbol FROM spans WHERE first <= DATE '2001-10-31' AND (NOT left_early OR last >= DATE '2001-10-25')")
def u04(spark, sf):
    log, now = A.membership(A.bars(spark, sf))
    return universe.ever_members(log, now, "2001-10-25", "2001-10-31")


@query("u05_members_by_replay",
       "SELECT symbol FROM spans WHERE first <= DATE '2001-10-28' AND (NOT left_early OR last > DATE '2001-10-28')")
def u05(spark, sf):
    log, _ = A.membership(A.bars(spark, sf))
    return universe.members_by_replay(log, "2001-10-28")


@query("u07_missing_symbols", "SELECT CAST(s_suppkey AS VARCHAR) AS symbol FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_shipdate = TIMESTAMP '1998-06-30')")
def u07(spark, sf):
    day = A.bars(spark, sf, symbol="l_suppkey").filter(F.col("date") == F.lit(DAY).cast("date"))
    return universe.missing(A.supplier_profiles(spark, sf), day)


@query("u08_sector_counts", f"SELECT sector, count(*) AS n FROM profiles WHERE symbol IN ({MEMBERS}) GROUP BY 1")
def u08(spark, sf):
    log, now = A.membership(A.bars(spark, sf))
    return universe.sector_counts(universe.members_as_of(log, now, DAY), A.profiles(spark, sf))


@query("u08_modal_sector", "SELECT sector, count(*) AS n FROM sprofiles GROUP BY 1 ORDER BY n DESC, sector LIMIT 1")
def u08b(spark, sf):
    p = A.supplier_profiles(spark, sf)
    return universe.modal_sector(p.select("symbol"), p)


@query("u09_merged_universe", "SELECT symbol FROM profiles WHERE sector = 'S0' OR industry = 'I2' OR symbol = 'Brand#7'")
def u09(spark, sf):
    p = A.profiles(spark, sf)
    return universe.merged([
        universe.resolve("sector", profiles=p, sectors=["S0"]),
        universe.resolve("sector", profiles=p, sectors=["I2"]),
        universe.resolve("symbols", profiles=p, symbols=["Brand#7"]),
    ])


@query("x19_month_starts", "SELECT min(date) AS date FROM calendar GROUP BY year(date), month(date)")
def x19(spark, sf):
    return calendars.month_starts(A.dates(spark, sf))


@query("x19_spaced_dates",
       "SELECT date FROM pick", views={"pick": """SELECT min(date) AS date FROM calendar UNION ALL
  SELECT (SELECT min(c.date) FROM calendar c WHERE c.date >= pick.date + 30) FROM pick
  WHERE EXISTS (SELECT 1 FROM calendar c WHERE c.date >= pick.date + 30)"""})
def x19b(spark, sf):
    return calendars.spaced(A.dates(spark, sf), 30)


#: Walk-forward windows of two years over the table's dates, each six months before the end of the one before.
WINDOWS = """SELECT 'w' || (n + 1) AS label, CAST(first + to_months(CAST(18 * n AS INTEGER)) AS DATE) AS start, CAST(first + to_months(CAST(18 * n + 24 AS INTEGER)) AS DATE) AS "end"
  FROM (SELECT min(date) AS first, max(date) AS last FROM calendar), range(0, 400) t(n) WHERE first + to_months(CAST(18 * n + 24 AS INTEGER)) <= last"""


def windows(spark, sf):
    first, last = A.dates(spark, sf).agg(F.min("date"), F.max("date")).first()
    return calendars.walk_forward(first, last, "2y", "6m")


@query("w01_walk_forward", 'SELECT label, start, "end", (SELECT count(*) FROM bars WHERE date >= start AND date <= "end") AS n_bars FROM wins', views={"wins": WINDOWS})
def w01(spark, sf):
    spans = windows(spark, sf)
    per_day = A.bars(spark, sf).groupBy("date").agg(F.count(F.lit(1)).alias("n"))
    return calendars.in_windows(per_day, spans).groupBy("label", "start", "end").agg(F.sum("n").alias("n_bars"))
