"""Source mappers, sinks and streaming jobs over the driver's tables."""

import uuid

from pyspark.sql import functions as F

from pitfactors.functions import scale
from pitfactors.operators import ledger as L
from pitfactors.operators import regimes as R
from pitfactors.operators import features as X
from pitfactors.plans import features_q as FQ
from pitfactors.plans import regimes_q as RQ
from pitfactors.plans.catalogue import query
from pitfactors.sources import adapters as A
from pitfactors.sources import documents as D
from pitfactors.sources import sinks as S
from pitfactors.streaming import jobs as J


def workspace(spark, name):
    """Fresh folder in the cluster's shared folder."""
    return f"{scale.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def documents(df, kind, **fields):
    """Wrap rows as vendor documents, one per symbol and year, and parse them back."""
    names = [x.split()[0] for x in D.RECORDS[kind].split(", ")]
    record = F.struct(*[fields[n].alias(n) for n in names if n in fields])
    data = df.select("symbol", F.year("date").alias("y"), record.alias("r")).groupBy("symbol", "y").agg(F.collect_list("r").alias("data"))
    text = F.to_json(F.struct(F.lit("2024-01-01T00:00:00").alias("_fetched_at"), "data"))
    return D.parse_documents(data.select("symbol", text.alias("text")), kind)


BAR = "open high low close"


@query("src01_wrapped_documents", "SELECT symbol, date, open, high, low, close, volume FROM bars", BAR)
def src01(spark, sf):
    b = A.bars(spark, sf)
    r = documents(b, "prices", date=F.col("date"), open=F.col("open"), high=F.col("high"), low=F.col("low"), close=F.col("close"), volume=F.col("volume"))
    return r.select("symbol", "date", "open", "high", "low", "close", "volume")


@query("src02_map_prices", "SELECT symbol, date, open, high, low, close, volume, (close / open - 1) * 100 AS change_pct, close AS vwap FROM bars", BAR + " change_pct vwap")
def src02(spark, sf):
    b = A.bars(spark, sf).withColumns({"changePercent": (F.col("close") / F.col("open") - 1) * 100, "vwap": F.col("close")})
    return D.map_prices(b)


INC = "revenue:4 gross_profit:4 operating_income:4 net_income:4 ebitda:4 eps eps_diluted shares_diluted"


@query("src03_map_income", "SELECT symbol, date, CAST(fiscal_year AS VARCHAR) AS fiscal_year, period, revenue, gross_profit, operating_income, net_income, ebitda, eps_diluted AS eps, eps_diluted, shares_diluted FROM income", INC)
def src03(spark, sf):
    c = F.col
    r = documents(A.income(spark, sf), "income", date=c("date"), fiscalYear=c("fiscal_year").cast("string"), period=c("period"), revenue=c("revenue"), grossProfit=c("gross_profit"),
                  operatingIncome=c("operating_income"), netIncome=c("net_income"), ebitda=c("ebitda"), eps=c("eps_diluted"), epsDiluted=c("eps_diluted"), weightedAverageShsOutDil=c("shares_diluted"))
    return D.map_income(r)


@query("src04_map_balance", "SELECT symbol, date, coalesce(cash, 0) AS cash, coalesce(short, 0) + coalesce(long, 0) AS total_debt, coalesce(short, 0) + coalesce(long, 0) - coalesce(cash, 0) AS net_debt FROM (SELECT symbol, date, CASE WHEN period <> 'Q1' THEN total_assets * 0.1::DOUBLE END AS cash, CASE WHEN period <> 'Q2' THEN total_assets * 0.2::DOUBLE END AS short, total_debt AS long FROM balance)", "cash:4 total_debt:4 net_debt:4")
def src04(spark, sf):
    b = A.balance(A.income(spark, sf))
    c = F.col
    r = b.select("symbol", "date", c("fiscal_year").alias("fiscalYear"), "period", F.when(c("period") != "Q1", c("total_assets") * 0.1).alias("cashAndCashEquivalents"), F.lit(None).cast("double").alias("inventory"),
                 F.lit(None).cast("double").alias("totalCurrentAssets"), c("total_assets").alias("totalAssets"), F.lit(None).cast("double").alias("totalCurrentLiabilities"),
                 F.when(c("period") != "Q2", c("total_assets") * 0.2).alias("shortTermDebt"), c("total_debt").alias("longTermDebt"), F.lit(None).cast("double").alias("totalLiabilities"), c("total_equity").alias("totalStockholdersEquity"))
    return D.map_balance(r).select("symbol", "date", "cash", "total_debt", "net_debt")


@query("src05_map_cashflow", "SELECT symbol, date, operating_cf, CASE WHEN period <> 'Q3' THEN -0.2::DOUBLE * operating_cf END AS capex, CASE WHEN period <> 'Q3' THEN operating_cf + -0.2::DOUBLE * operating_cf END AS free_cash_flow FROM cashflow", "operating_cf:5 capex:5 free_cash_flow:5")
def src05(spark, sf):
    c = F.col
    f = A.cashflow(A.income(spark, sf))
    r = f.select("symbol", "date", c("fiscal_year").alias("fiscalYear"), "period", c("operating_cf").alias("netCashProvidedByOperatingActivities"), F.when(c("period") != "Q3", -0.2 * c("operating_cf")).alias("investmentsInPropertyPlantAndEquipment"),
                 c("dividends_paid").alias("commonDividendsPaid"), F.lit(None).cast("double").alias("commonStockRepurchased"))
    return D.map_cashflow(r).select("symbol", "date", "operating_cf", "capex", "free_cash_flow")


@query("src06_map_earnings", "SELECT * FROM earnings", "eps_actual eps_estimated revenue_actual:4 revenue_estimated:4")
def src06(spark, sf):
    c = F.col
    r = documents(A.earnings(A.income(spark, sf)), "earnings", date=c("date"), epsActual=c("eps_actual"), epsEstimated=c("eps_estimated"), revenueActual=c("revenue_actual"), revenueEstimated=c("revenue_estimated"))
    return D.map_earnings(r)


@query("src07_map_insider_trades", "SELECT symbol, date AS transaction_date, trade_key AS reporting_name, action AS transaction_type, coalesce(s, 0) AS shares, coalesce(p, 0) AS price, coalesce(s, 0) * coalesce(p, 0) AS value FROM (SELECT *, CASE WHEN sleeve <> 'sleeve0' THEN shares END AS s, CASE WHEN reason <> 'stop_loss' THEN price END AS p FROM trades)", "shares price value:3")
def src07(spark, sf):
    c = F.col
    t = A.trades(spark, sf).select("symbol", c("date").alias("transactionDate"), c("trade_key").alias("reportingName"), c("reason").alias("typeOfOwner"), c("action").alias("transactionType"),
                                   F.when(c("sleeve") != "sleeve0", c("shares")).alias("securitiesTransacted"), F.when(c("reason") != "stop_loss", c("price")).alias("price"), c("shares").alias("securitiesOwned"))
    return D.map_insider_trades(t).select("symbol", "transaction_date", "reporting_name", "transaction_type", "shares", "price", "value")


@query("src08_map_grades", "SELECT symbol, date, grading_company, NULL::VARCHAR AS previous_grade, action AS new_grade, action FROM grades")
def src08(spark, sf):
    g = A.grades(spark, sf).select("symbol", "date", F.col("grading_company").alias("gradingCompany"), F.lit(None).cast("string").alias("previousGrade"), F.col("action").alias("newGrade"), "action")
    return D.map_analyst_grades(g)


@query("src09_index_bars", "SELECT symbol, date, close FROM bars UNION ALL SELECT 'GSPC', date, close FROM market", "close")
def src09(spark, sf):
    return D.with_index_bars(A.bars(spark, sf).select("symbol", "date", "close"), A.market(spark, sf).select(F.lit("^GSPC").alias("symbol"), "date", "close"))


@query("src10_pe_series", "SELECT symbol, date, 1 / y AS pe FROM (SELECT symbol, date, net_income / revenue - 0.05::DOUBLE AS y FROM income) WHERE y > 0", "pe:4")
def src10(spark, sf):
    return D.pe_series(A.income(spark, sf).select("symbol", "date", (F.col("net_income") / F.col("revenue") - 0.05).alias("earningsYield")))


@query("src11_index_changes", "SELECT 'brands' AS index_name, symbol, first AS event_date, 'added' AS action, CASE WHEN left_early THEN symbol || 'x' END AS replaced, 'swap' AS reason FROM spans UNION ALL SELECT 'brands', symbol || 'x', first, 'removed', symbol, 'swap' FROM spans WHERE left_early")
def src11(spark, sf):
    b = A.bars(spark, sf)
    final = b.agg(F.max("date")).scalar()
    s = b.groupBy("symbol").agg(F.min("date").alias("date"), F.max("date").alias("last"))
    r = s.select("date", "symbol", F.when(F.col("last") < final, F.concat("symbol", F.lit("x"))).alias("removedTicker"), F.lit("swap").alias("reason"))
    return D.map_index_changes(r, "brands")


@query("src12_delisted", "SELECT p.symbol, name AS company_name, exchange, first AS ipo_date, last AS delisted_date FROM profiles p JOIN spans s USING (symbol) WHERE exchange IN ('NYSE', 'NASDAQ')")
def src12(spark, sf):
    s = A.bars(spark, sf).groupBy("symbol").agg(F.min("date").alias("ipoDate"), F.max("date").alias("delistedDate"))
    return D.map_delisted(A.profiles(spark, sf).join(s, "symbol").select("symbol", F.col("name").alias("companyName"), "exchange", "ipoDate", "delistedDate"))


@query("src13_macro_observations", "SELECT CAST(o_orderdate AS DATE) AS date, CASE o_orderpriority WHEN '1-URGENT' THEN 'urgent' ELSE 'low' END AS series, o_totalprice AS value, 'vendor' AS source FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') AND o_orderstatus <> 'P'", "value:2")
def src13(spark, sf):
    o = A.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("date"), F.col("o_orderpriority").alias("series_id"), F.when(F.col("o_orderstatus") == "P", ".").otherwise(F.col("o_totalprice").cast("string")).alias("value"))
    return D.map_macro(o, {"1-URGENT": "urgent", "5-LOW": "low"}, "vendor")


@query("src14_index_as_macro", "SELECT date, 'spx' AS series, close AS value, 'index' AS source FROM bars WHERE symbol = 'Brand#1' AND date >= DATE '1996-01-01'", "value")
def src14(spark, sf):
    return D.index_as_macro(A.bars(spark, sf), "Brand#1", start="1996-01-01")


def results(spark, sf):
    """One stored-result document per order and sleeve, as text: an order has few lines."""
    t = A.trades(spark, sf).filter("action = 'SELL'").withColumn("order", F.split("trade_key", ":")[0].cast("long"))
    trade = F.struct("date", "action", "symbol", "shares", "price", "amount", "reason", "pnl")
    s = t.groupBy("order", "sleeve").agg(F.collect_list(trade).alias("trades"))
    config = F.struct(
        F.struct(F.when(F.col("order") % 2 == 0, "sector").otherwise("symbols").alias("type"), F.lit("S1").alias("sector"), F.array(F.lit("Brand#1"), F.lit("Brand#2")).alias("symbols")).alias("universe"),
        F.struct(F.lit(-25.0).alias("value")).alias("stop_loss"))
    doc = s.select(F.concat_ws("-", F.lit("run"), "order", "sleeve").alias("run_id"), F.lit("s").alias("strategy"), config.alias("config"),
                   F.struct(F.size("trades").alias("total_trades")).alias("metrics"), F.array(F.struct(F.col("sleeve").alias("label"), "trades")).alias("sleeves"))
    return D.parse_results(doc.select(F.to_json(F.struct("*")).alias("text")))


SOLD = {"sold": "SELECT *, CAST(split_part(trade_key, ':', 1) AS BIGINT) AS ord FROM trades WHERE action = 'SELL'"}


@query("src15_run_metrics", "SELECT 'run-' || ord || '-' || sleeve AS run_id, CASE WHEN ord % 2 = 0 THEN 'sector' ELSE 'symbols' END AS universe_type, CASE WHEN ord % 2 = 0 THEN 'S1' ELSE 'Brand#1,Brand#2' END AS universe_detail, -25.0::DOUBLE AS stop_loss, CAST(count(*) AS INTEGER) AS total_trades FROM sold GROUP BY ord, sleeve", "stop_loss", SOLD)
def src15(spark, sf):
    return D.run_metrics(results(spark, sf)).select("run_id", "universe_type", "universe_detail", "stop_loss", "total_trades")


@query("src16_result_trades", "SELECT 'backtest' AS source_type, 'run-' || ord || '-' || sleeve AS source_id, sleeve, date, action, symbol, shares, price, amount, reason, pnl FROM sold", "shares price amount:2 pnl:4", SOLD)
def src16(spark, sf):
    return D.result_trades(results(spark, sf)).drop("id")


SPLIT = "SELECT *, date >= DATE '1999-01-01' AS late FROM bars"


def halves(spark, sf):
    """A stored table and an update that overlaps it and corrects closes."""
    b = A.bars(spark, sf).select("symbol", "date", "close")
    old = b.filter(F.col("date") < F.lit("1999-06-01").cast("date"))
    new = b.filter(F.col("date") >= F.lit("1999-01-01").cast("date")).withColumn("close", F.col("close") * 2)
    return old, new


UPS = "SELECT symbol, date, close * CASE WHEN date >= DATE '1999-01-01' THEN 2 ELSE 1 END AS close FROM bars"


@query("snk1_upsert", UPS, "close")
def snk1(spark, sf):
    return S.upsert(*halves(spark, sf), ["symbol", "date"])


@query("snk2_insert_absent", "SELECT symbol, date, close * 2 AS close FROM bars WHERE date >= DATE '1999-06-01'", "close")
def snk2(spark, sf):
    old, new = halves(spark, sf)
    return S.absent(old, new, ["symbol", "date"])


@query("snk3_replace_symbols", "SELECT symbol, date, close FROM bars WHERE symbol NOT IN ('Brand#1', 'Brand#2') UNION ALL SELECT symbol, date, close * 2 FROM bars WHERE symbol IN ('Brand#1', 'Brand#2') AND date >= DATE '1999-01-01'", "close")
def snk3(spark, sf):
    b = A.bars(spark, sf).select("symbol", "date", "close")
    return S.replace_symbols(b, halves(spark, sf)[1].filter("symbol IN ('Brand#1', 'Brand#2')"))


@query("snk4_merge_history", UPS, "close")
def snk4(spark, sf):
    old, new = halves(spark, sf)
    return S.merge_history(old, new, "prices")


@query("snk4_load_order", "SELECT symbol, date, CASE WHEN date >= DATE '1999-01-01' THEN close * 3 ELSE close END AS close FROM bars", "close")
def snk4b(spark, sf):
    """Fetched documents that hold every record twice: the one later in the document wins."""
    old, new = halves(spark, sf)
    twice = new.select("symbol", F.year("date").alias("y"), F.struct("date", "close").alias("r")).groupBy("symbol", "y").agg(F.sort_array(F.collect_list("r")).alias("data"))
    later = F.transform("data", lambda r: F.struct(r["date"].alias("date"), (r["close"] * 1.5).alias("close")))
    text = F.to_json(F.struct(F.lit("2024-01-01T00:00:00").alias("_fetched_at"), F.concat("data", later).alias("data")))
    fetched = D.parse_documents(twice.select("symbol", text.alias("text")), "prices", position=True)
    return S.merge_history(old, fetched.select("symbol", "date", "close", "load_order"), "prices")


@query("snk1_upsert_null_dates",
       """SELECT symbol, CASE WHEN date >= DATE '1998-01-01' THEN date END AS date, CAST(count(*) AS BIGINT) AS n, sum(CAST(volume AS BIGINT))::BIGINT AS volume FROM (
  SELECT symbol, date, volume FROM bars WHERE date >= DATE '1998-01-01' UNION ALL SELECT symbol, NULL, any_value(v) FROM (SELECT symbol, sum(volume) AS v FROM bars WHERE date < DATE '1998-01-01' GROUP BY 1) GROUP BY 1) GROUP BY 1, 2""")
def snk1b(spark, sf):
    """Rows without a date on both sides of an upsert into a table by year: those not updated stay."""
    out = workspace(spark, "snk1b")
    b = A.bars(spark, sf).select("symbol", "date", F.col("volume").cast("long").alias("volume"))
    early = b.filter(F.col("date") < F.lit("1998-01-01").cast("date")).groupBy("symbol").agg(F.sum("volume").alias("volume"))
    undated = early.select("symbol", F.lit(None).cast("date").alias("date"), "volume")
    even = F.length("symbol") % 2 == 0
    S.upsert_table(b.filter(F.col("date") >= F.lit("1998-01-01").cast("date")).unionByName(undated.withColumn("volume", F.when(even, F.col("volume")).otherwise(-1))), out, ["symbol", "date"], ["volume"])
    S.upsert_table(undated.filter(~even), out, ["symbol", "date"], ["volume"])
    return spark.read.parquet(out).groupBy("symbol", "date").agg(F.count(F.lit(1)).alias("n"), F.sum("volume").alias("volume"))


@query("snk5_content_ids", "SELECT trade_key, date, substr(md5(trade_key || ':' || date), 1, 12) AS id FROM trades")
def snk5(spark, sf):
    return A.trades(spark, sf).select("trade_key", "date", L.row_id("trade_key", F.col("date").cast("string")).alias("id"))


@query("snk6_tagged_ledger", "SELECT trade_key, sleeve, date, symbol, action, 'experiment' AS source_type, 'e1' AS source_id, NULL::VARCHAR AS window_label, substr(md5('experiment:e1:' || sleeve || '::' || date || ':' || symbol || ':' || action || ':' || trade_key), 1, 12) AS id FROM trades")
def snk6(spark, sf):
    t = A.trades(spark, sf).select("trade_key", "sleeve", "date", "symbol", "action")
    return S.tagged(t, "experiment", "e1")


# ---------------------------------------------------------------- streams


def tick_stream(spark, sf):
    schema = A.table(spark, sf, "events").schema
    s = J.files(spark, sf, schema, "events.parquet")
    return s.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.to_date("ts").alias("date"), F.col("value").alias("price"), "event_id")


@query("st1_stream_upsert", "SELECT symbol, date, arg_max(price, event_id) AS price, max(event_id) AS event_id FROM (SELECT event_type AS symbol, CAST(ts AS DATE) AS date, value AS price, event_id FROM events) GROUP BY 1, 2", "price")
def st1(spark, sf):
    out, check = workspace(spark, "st1"), workspace(spark, "st1-check")
    J.upserts(tick_stream(spark, sf), out, check, ["symbol", "date"], ["event_id"]).start().awaitTermination()
    return spark.read.parquet(out).select("symbol", "date", "price", "event_id")


@query("st2_feature_refresh", "SELECT symbol, date, avg(price) AS mean_price FROM (SELECT event_type AS symbol, CAST(ts AS DATE) AS date, value AS price FROM events) WHERE date >= (SELECT CAST(max(ts) AS DATE) FROM events) - 7 GROUP BY 1, 2", "mean_price:5")
def st2(spark, sf):
    out, check = workspace(spark, "st2"), workspace(spark, "st2-check")
    build = lambda: A.ticks(spark, sf).groupBy("symbol", F.to_date("ts").alias("date")).agg(F.avg("price").alias("mean_price"))
    J.feature_refresh(tick_stream(spark, sf), check, build, out).start().awaitTermination()
    return spark.read.parquet(out).select("symbol", "date", "mean_price")


CARRIED = ["pe", "roe", "ret_12m", "realized_vol_252", "drawdown_alltime"]
_CARRIED = " JOIN ".join(f"(SELECT symbol, date, value AS {n} FROM ({FQ.ORACLE[n]}))" + ("" if i == 0 else " USING (symbol, date)") for i, n in enumerate(CARRIED))


@query("st2_carried_panel", f"SELECT * FROM {_CARRIED}", " ".join(CARRIED), FQ.VIEWS)
def st2_carried(spark, sf):
    """The panel kept by three runs of a stream, each from the carried tail of the one before."""
    out, feed, state, check = (workspace(spark, n) for n in ("st2c", "st2c-feed", "st2c-state", "st2c-check"))
    b, income = A.bars(spark, sf), A.income(spark, sf)
    facts = income, A.balance(income), A.cashflow(income), A.earnings(income), A.grades(spark, sf)
    first, last = b.agg(F.min("date"), F.max("date")).first()
    third = (last - first) / 3
    for lo, hi in ((first, first + third), (first + third, last - third), (last - third, last)):
        part = F.col("date") > F.lit(lo) if lo > first else F.lit(True)
        b.filter(part & (F.col("date") <= F.lit(hi))).write.mode("append").parquet(feed)
        stream = J.files(spark, feed, b.schema)
        J.carried_refresh(stream, check, lambda bars: X.panel(bars, *facts, CARRIED), out, state).start().awaitTermination()
    return spark.read.parquet(out).select("symbol", "date", *CARRIED)


@query("st3_score_append", "SELECT symbol, date, max(price) AS score FROM (SELECT event_type AS symbol, CAST(ts AS DATE) AS date, value AS price FROM events) GROUP BY 1, 2", "score")
def st3(spark, sf):
    out, check = workspace(spark, "st3"), workspace(spark, "st3-check")
    build = lambda: A.ticks(spark, sf).groupBy("symbol", F.to_date("ts").alias("date")).agg(F.max("price").alias("score"))
    S.append_after_last(build().filter(F.col("date") < F.lit("2024-01-15").cast("date")), out)
    J.score_append(tick_stream(spark, sf), check, build, out).start().awaitTermination()
    return spark.read.parquet(out)


@query("st4_unique_alerts", "SELECT DISTINCT event_type || ':' || CAST(ts AS DATE) AS alert_id FROM events")
def st4(spark, sf):
    out, check = workspace(spark, "st4"), workspace(spark, "st4-check")
    s = tick_stream(spark, sf).select(F.concat_ws(":", "symbol", F.col("date").cast("string")).alias("alert_id"), "ts")
    J.unique_alerts(s, out, check).start().awaitTermination()
    return spark.read.parquet(out).select("alert_id")


@query("st5_regime_stream", "SELECT regime, date, active FROM rs", views=RQ.RV)
def st5(spark, sf):
    flags, out, check = (workspace(spark, n) for n in ("st5-flags", "st5", "st5-check"))
    rules = R.rule_flags(RQ.wide(spark, sf), RQ.RS)
    rules.write.parquet(flags)
    J.run_to_folder(J.regime_states(J.files(spark, flags, rules.schema)), out, check)
    return spark.read.parquet(out)


@query("st5_regime_stream_resumed", "SELECT regime, date, active FROM rs", views=RQ.RV)
def st5_resumed(spark, sf):
    """The first half of the calendar as a batch, the rest as a stream that starts from the batch's state."""
    flags, out, check = (workspace(spark, n) for n in ("st5r-flags", "st5r", "st5r-check"))
    rules = scale.stable(R.rule_flags(RQ.wide(spark, sf), RQ.RS))
    middle = rules.agg(F.date_add(F.min("date"), F.floor(F.datediff(F.max("date"), F.min("date")) / 2).cast("int")).alias("d")).first()["d"]
    before = rules.filter(F.col("date") <= F.lit(middle))
    rules.filter(F.col("date") > F.lit(middle)).write.parquet(flags)
    J.run_to_folder(J.regime_states(J.files(spark, flags, rules.schema), R.carried(before)), out, check)
    batch = before.groupBy("regime").applyInPandas(R._walk, schema=R.STATE_SCHEMA).select("regime", "date", "active")
    return batch.unionByName(spark.read.parquet(out).select("regime", "date", "active"))


@query("st6_late_corrections", UPS, "close")
def st6(spark, sf):
    out, feed, check = (workspace(spark, n) for n in ("st6", "st6-feed", "st6-check"))
    old, new = halves(spark, sf)
    S.upsert_table(old, out, ["symbol", "date"])
    new.write.parquet(feed)
    J.corrections(J.files(spark, feed, new.schema), out, check, "prices").start().awaitTermination()
    return spark.read.parquet(out).select("symbol", "date", "close")


@query("q20_vendor_documents", "SELECT symbol, date, eps_actual, eps_estimated FROM earnings WHERE symbol = 'Brand#4'", "eps_actual eps_estimated")
def q20(spark, sf):
    c = F.col
    r = documents(A.earnings(A.income(spark, sf)), "earnings", date=c("date"), epsActual=c("eps_actual"), epsEstimated=c("eps_estimated"))
    return D.map_earnings(r.filter("symbol = 'Brand#4'")).select("symbol", "date", "eps_actual", "eps_estimated")
